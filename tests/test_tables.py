"""Stored tables give what the views give."""

import pytest

from punctuo import tables
from punctuo.plans.registry import PLANS
from punctuo.views import VIEWS, Views

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return tables.build(spark, DATA, f"file://{tmp_path_factory.mktemp('stored')}/t", 3)


def shown(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views(spark, stored, name):
    assert shown(getattr(stored, name)) == shown(getattr(Views(spark, DATA), name))


@pytest.mark.parametrize("name", ["journey_metrics", "operator_league", "leadtime_accuracy", "direct_journeys"])
def test_queries(spark, stored, name):
    assert shown(PLANS[name](stored)) == shown(PLANS[name](Views(spark, DATA)))
