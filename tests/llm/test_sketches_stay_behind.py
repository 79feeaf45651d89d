"""What is still open goes round without sketches, and few blocks are compared at once; either way gives the same links."""

import random

import pytest

from punctuo.llm import jaccard


def texts():
    """30 texts of one passage and words of their own, and of each a near copy that shares more."""
    rng, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(30)]
    for i in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        rows += [(i, " ".join(passage + own)), (100 + i, " ".join(passage + own + [f"z{i}"]))]
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_open_sets_are_narrow_and_compared_at_once(spark, monkeypatch, block):
    kept, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "cut", lambda df, name: kept.append((name, df.columns)) or cut(df, name))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark.createDataFrame(texts(), "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i in got} and len(got) == 60
    still = [columns for name, columns in kept if name in ("jaccard-open", "jaccard-still")]
    assert still and all("sketch" not in columns for columns in still)
    assert any(name == "jaccard-tried" for name, _ in kept) == (block == 2)


def test_coarse_sketches_rule_out_no_link(spark):
    known = spark.createDataFrame([(i, 200, i, bytearray(bytes([255, i]) * 128)) for i in range(4)], "set_id long, size long, rep long, sketch binary")
    coarse = jaccard._with_coarse(known).collect()
    assert all(len(r["coarse"]) == 64 and max(r["coarse"]) == 255 for r in coarse)
    pairs = spark.createDataFrame([(0, 1), (0, 3), (2, 3)], "a long, b long")
    got = jaccard._promising(pairs, jaccard._with_coarse(known), 75).collect()
    assert sorted(map(tuple, got)) == []  # 128 buckets apart by 1 and more, 57 at most
    wide = jaccard._promising(pairs, jaccard._with_coarse(known), 20).collect()
    assert sorted(map(tuple, wide)) == [(0, 1), (2, 3)]
