"""What is still open is worked out once a turn and kept; homes are looked up once a main; the sample holds only buckets that count."""

import numpy as np

from punctuo.llm import jaccard, toxicity


def test_still_open_is_kept_for_its_turn(spark, monkeypatch):
    asked, kept = [], []
    still, cut = jaccard._still_open, jaccard.cut
    monkeypatch.setattr(jaccard, "_still_open", lambda *a: asked.append(1) or still(*a))
    monkeypatch.setattr(jaccard, "cut", lambda df, name: kept.append(name) or cut(df, name))
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:20], f"x{i}", *base[20:]])) for i in range(12)]
    found = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert asked and kept.count("jaccard-still") == len(asked)


def test_homes_and_counts_of_what_is_open(spark):
    rest = spark.createDataFrame([(1, s, 0, 5, b"x") for s in (1, 2, 3, 4)] + [(7, s, 0, 5, b"x") for s in (7, 8)], "main long, set_id long, component long, size long, sketch binary")
    joined = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (8, 7)], "node long, component long")
    out = jaccard._still_open(rest, joined)
    got = sorted((r["main"], r["set_id"], r["component"], r["home"], r["sets"], r["others"]) for r in out.collect())
    chains = jaccard._chains(out.localCheckpoint(), "main")
    assert "Join" not in chains._jdf.queryExecution().optimizedPlan().toString()
    assert got == [(1, 1, 1, 1, 4, 2), (1, 2, 1, 1, 4, 2), (1, 3, 3, 1, 4, 2), (1, 4, 4, 1, 4, 2)]


def test_only_buckets_that_count_reach_the_driver(spark):
    texts = [(i, f"plain words number{i} " + ("vile" if i % 3 == 0 else "kind")) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = toxicity._sample(docs, labels, "doc_id", "text", 10_000, 50_000_000, 1 << 18)
    words = {int(x) for row in got["plain"].to_pylist() for x in row}
    assert got.num_rows > 200 and set(toxicity.features_of("vile", 1 << 18)) <= words
    assert len(words) < 40  # each text has a word of its own, whose buckets do not count
    assert np.all(np.diff(got["id"].to_numpy()) > 0)
