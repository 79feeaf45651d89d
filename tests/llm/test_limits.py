"""Operators on long texts, hot keys and null or repeated ids."""

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from punctuo.llm import exact_dedup, jaccard, repeats, secrets
from punctuo.llm.shingles import words_of


def test_slug_of_any_length_is_allowed(spark):
    slug = "ab" + "-12-cd" * 17_000
    rows = spark.createDataFrame([(1, slug), (2, f"see {slug} and secret=abcdefgh")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(rows)).collect()}
    assert (got[1]["spans"], got[1]["n_entropy"]) == ("", 0)
    assert (got[2]["n_assign"], got[2]["n_entropy"]) == (1, 0)


def test_path_pattern_fits_the_same_strings(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(["ab", "C", "1", "2345", "_", "/", "-", "="]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    plain = re.compile(r"(?i)^[a-z]+([_/-][a-z]+|[_/-][0-9]{1,4})+$")
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.col("v").rlike(secrets.ALLOW[-1]).alias("fits"))
    found = {r["v"]: r["fits"] for r in got.collect()}
    assert found == {v: bool(plain.match(v)) for v in values}
    assert any(found.values())


def test_common_phrase_is_spread(spark, monkeypatch):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    phrase = [f"p{i}" for i in range(12)]
    lists = {i: words(6) + phrase + words(6) for i in range(2500)}
    first, want = {}, {}
    for i, w in lists.items():
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in lists.items():
        stay = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                stay[j : j + 13] = [False] * 13
        kept = " ".join(x for x, s in zip(w, stay) if s)
        want[i] = (stay.count(False), hashlib.sha256(kept.encode()).hexdigest())
    locate = repeats.locate

    def guarded(shard, window):
        assert shard.groupby("anchor").size().max() <= repeats.HOT_PLACES
        return locate(shard, window)

    monkeypatch.setattr(repeats, "locate", guarded)
    monkeypatch.setattr(repeats, "HOT_PLACES", 1000)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in lists.items()], "doc_id long, text string")
    got = repeats.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_shard_with_more_words_than_letters():
    rows = [(i % 7, i, i, 0, " ".join(f"x{i}_{j}" for j in range(20))) for i in range(60_000)]
    rows += [(3, -i, i, i, "same " * 12 + "same") for i in (1, 2)]
    got = repeats.locate(pd.DataFrame(rows, columns=["anchor", "text", "doc", "first", "words"]), 13)
    assert got.values.tolist() == [[-2, [2]]]


def test_pieces_hold_each_window_once():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 5, 12, 13, 14, 40, 300)] + ["x " * 500, None]
    words = words_of(pa.array(texts))
    own, anchors, first, count = repeats.pieces(words.hashes, words.sizes, 13, 5)
    windows = {}
    for t, a, f, c in zip(own.tolist(), anchors.tolist(), first.tolist(), count.tolist()):
        assert 1 <= c <= repeats.LONGEST
        for i in range(f, f + c):
            key = tuple((texts[t] or "").split()[i : i + 13])
            assert len(key) == 13 and windows.setdefault(key, a) == a
    assert count.sum() == sum(max(0, len((t or "").split()) - 12) for t in texts)
    text, ends = repeats.joined(words)
    assert [text[a:b].decode() for a, b in zip(ends, ends[1:])] == [" ".join((t or "").split()) for t in texts]


def test_near_dedup_with_null_and_repeated_ids(spark):
    long = [f"a{i}" for i in range(60)]
    text, near = " ".join(long), " ".join([*long, "tail"])
    rows = [(None, text), (7, text), (8, near), (8, "another text of the same id that nothing is near to"), (None, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect())
    assert got == [(0, 56, None), (0, 57, None), (7, 56, 7), (8, 7, 8), (8, 57, 7)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted((r for r in rows if r != (8, near)), key=str)


def test_exact_dedup_with_null_and_repeated_ids(spark):
    head = "h" * 64
    rows = [(None, head + " one"), (None, head + " two"), (5, head + " one"), (3, head + " six"), (3, head + " ten"), (4, head + " TEN")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted((rows[i] for i in (1, 2, 3, 5)), key=str)


def test_entropy_is_that_of_every_window(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    values = ["".join(rng.choice(letters[: rng.randint(2, 64)]) for _ in range(rng.choice([20, 21, 45, 200]))) for _ in range(200)]
    values.append("".join(rng.choice(letters) for _ in range(40_000)))
    terms = lambda v: sum(c / 20 * math.log2(20 / c) for c in Counter(v).values())
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.window_entropy(F.col("v"), 20).alias("e"))
    for r in rows.collect():
        assert abs(r["e"] - max(terms(r["v"][i : i + 20]) for i in range(len(r["v"]) - 19))) < 1e-9


def test_base_spans_by_hand(spark):
    """The kinds of base spans, recomputed with Python's regular expressions, over the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kinds = {
        "assign": (r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I),
        "access": (r"AKIA[A-Z0-9]+", 0, 20, 0),
        "hex": (r"[0-9a-f]+", 0, 24, 0),
    }
    want = {}
    for r in docs.collect():
        found = []
        for order, (kind, (pattern, group, least, flags)) in enumerate(kinds.items()):
            for m in re.finditer(pattern, r["text"] or "", flags):
                if len(m[group]) >= least:
                    found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        want[r["doc_id"]] = hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
    got = {r["doc_id"]: r["base_sha256"] for r in secrets.digest(secrets.scan(docs)).collect()}
    assert got == want


def test_rest_of_a_candidate_is_judged(spark):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    access, run = "AKIA" + "Q7" * 8, "0a" * 12
    texts = {
        1: f"x {access}/{key} y",  # the rest after a base span
        2: f"{key}-{run}_{key}",  # the rests around one
        3: f"{access}/{key[:12]}",  # a rest shorter than the window
        4: f"{access}/plain-words-without-a-digit",  # a rest on the allow-list
        5: f"é {key}",  # no base span
        6: None,
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(rows)).collect()}
    assert got == {
        1: "access:2:22,entropy:22:63",
        2: "entropy:0:41,hex:41:65,entropy:65:106",
        3: "access:0:20",
        4: "access:0:20",
        5: "entropy:2:42",
        6: "",
    }
