"""Queries over the given tables, by name, with the SQL that an independent engine answers them by."""

from __future__ import annotations

from punctuo.plans import boards, explorer, files, links, live, models, network, reports, states, trains
from punctuo.views import Views, oracle

_ALL = [*reports.LIST, *links.LIST, *boards.LIST, *states.LIST, *live.LIST, *trains.LIST, *models.LIST, *network.LIST, *files.LIST, *explorer.LIST]

#: Queries over any views, among them stored ones.
PLANS = {name: f for name, f, _ in _ALL}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f, _ in _ALL}
ORACLE_SQL = {name: oracle(sql) for name, _, sql in _ALL if sql}
