"""Archives, collocations and whitening against brute force, and on nulls, empty and long texts, repeats, clashes and no rows."""

import base64
import glob
import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctuo.llm import collocations, registry, top_k, warc, whitening
from punctuo.llm.common import cut

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, run int, place string"


def stamp():
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod("page_id", F.lit(1000)), F.lit(0)))


def oracle(name, **tables):
    con = duckdb.connect()
    for table, value in tables.items():
        if isinstance(value, str):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{value}')")
        else:
            con.register(table, value)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    return sorted(names), sorted(tuple(map(str, (dict(zip(names, r))[c] for c in sorted(names)))) for r in found.fetchall())


def shown(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect())


@pytest.mark.parametrize("name,table", [("op11_warc", "pages"), ("op12_collocations", "documents")])
def test_small_tables_match_sql(spark, name, table):
    want = oracle(name, **{table: f"{SMALL}/{table}.parquet"})
    assert shown(registry.QUERIES[name](spark, SMALL)) == want


# Archives


LONG = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 40_000
ROWS = [
    (5, "https://www.A.example/b?c=1#d", "same", 1, "x"), (3, "http://a.example/b?c=1", "same", 1, "x"), (9, None, "same", 1, "x"),
    (None, "no url", "same", 1, "x"), (1, "http://b.example\r\nWARC-Type: revisit", None, 1, None), (2, "http://b.example", "", 1, None),
    (7, "http://é.example/ü", LONG, 1, "x"), (8, "http://é.example/ü", LONG + "!", 1, "x"), (4, "://", "日本\x00 ", 1, "x"),
    (6, "http://c.example", "once", 1, "x"), (6, "http://c.example", "once", 1, "x"),
]


def expected(rows, least=0):
    first = {}
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= least and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        refers = first.get(body) if len(body) >= least else None
        refers = None if refers == i else refers
        kind = "response" if refers is None else "revisit"
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, refers))
    return Counter(out)


def digest(found):
    return Counter(tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archives_come_back(spark, least):
    pages = spark.createDataFrame(ROWS, PAGES)
    found = warc.archive(pages, stamp(), per_task=3, least_bytes=least, records_per_file=2)
    assert digest(found) == expected(ROWS, least)
    rows = found.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(ROWS)))
    keys = [(r["url_key"], r["captured"], r["page_id"] is None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    spans = {r["url_key"]: r for r in warc.histories(found).collect()}
    both = spans["example,a)/b?c=1"]
    assert (both["captures"], both["to"] - both["from"]) == (2, 1)


def test_archives_of_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], PAGES), stamp()).count() == 0


def test_hot_payloads_do_not_meet_in_a_join(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 7}.example", rng.choice(["hot", "hot", f"p{i // 2}", f"u{i}"]), 1, "x") for i in range(3000)]
    found = warc.archive(spark.createDataFrame(rows, PAGES), stamp(), per_task=500)
    assert digest(found) == expected(rows)


def test_files_are_archives(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame(ROWS, PAGES), path, stamp())
    found = 0
    for name in glob.glob(f"{tmp_path}/a/part-*"):
        data = open(name, "rb").read()
        for *_, offset, length in warc.records(data):
            assert data[offset:].startswith(b"WARC/1.1\r\nWARC-Type: re") and data[offset + length :][:4] == b"\r\n\r\n"
            found += 1
    assert found == len(ROWS)


def test_a_changed_payload_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame([(1, "http://a", "text", 1, "x")], PAGES), path, stamp())
    (name,) = (n for n in glob.glob(f"{tmp_path}/a/part-*") if open(n, "rb").read())
    data = open(name, "rb").read()
    with pytest.raises(ValueError, match="does not hold"):
        list(warc.records(data.replace(b"text\r\n\r\n", b"texT\r\n\r\n")))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    keys = [sorted(rng.randrange(9) for _ in range(rng.choice([0, 1, 4, 20]))) for _ in range(k)]
    got = [keys[r][i] for r, i in warc.merged_order(keys)]
    assert got == list(heapq.merge(*keys))


# Collocations


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, table in f.items():
        often = {p: a for p, a in table.items() if a >= least}
        held = set()
        for p, a in often.items():
            for k in range(2, len(p)):
                held |= {q for i in range(len(p) - k + 1) if a >= often[q := p[i : i + k]]}
        rows = []
        for p, a in often.items():
            if len(p) > 1 and p not in held:
                score, k = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    common = ["the", "of", "a", "in", "to", "is"]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = []
        while len(words) < 60:
            words += rng.choice([[rng.choice(common)], ["new", "york"], passage[:12], passage, [f"r{rng.randrange(500)}"], ["ha"] * rng.randint(1, 9), ["É", "x y"]])
            if rng.random() < 0.2:
                words[-1] += rng.choice([".", ",", "\n", "!?", " ;\t"])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows + [("en", None), (None, ""), ("fr", " ,;\r\n "), ("en", "THE New YORK " * 20_000), ("x", "solo")]


@pytest.mark.parametrize("least,top,bits", [(20, 50, 26), (20, 2000, 8), (3, 30, 18), (70_000, 9, 16)])
def test_collocations(spark, monkeypatch, least, top, bits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"size": F.lit(1), "weight": F.lit(2), "gram": F.lit("x")})
    got = sorted(tuple(r) for r in collocations.mine(docs.repartition(3), least=least, top=top, bits=bits).collect())
    assert got == brute(rows, least, top)


def test_chunks_change_nothing(spark, monkeypatch):
    rows = corpus()
    batch = spark.createDataFrame(rows, "lang string, text string").selectExpr("coalesce(lang, 'und')", "CAST(coalesce(text, '') AS BINARY)").toArrow().to_batches()
    monkeypatch.setattr(collocations, "CHUNK", 500)
    sizes = Counter()
    for langs, texts in collocations._chunks(iter(batch)):
        c = collocations._Chunk(langs, texts)
        sizes.update(collocations._per_lang(c))
        assert len(c.follows) == max(0, len(c.one) - 1)
    want = Counter()
    for lang, text in rows:
        want[lang or "und"] += sum(map(len, pieces(text)))
    assert +sizes == +want


def test_collocations_of_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_unary_paths(spark):
    """A passage of 40 words that always comes whole is one path; its windows have its count."""
    passage = [f"p{i}" for i in range(40)]
    rows = [("en", f"a{i} b{i} " + " ".join(passage) + f" c{i} d{i}") for i in range(30)]
    texts = spark.createDataFrame(rows, "lang string, text string").withColumn("text", F.col("text").cast("binary"))
    found = cut(collocations.edges(texts, 10), "test-edges")
    long = collocations.paths(found, collocations.nodes(found), 10).collect()
    assert [(r["words"], r["edges"], r["weight"]) for r in long] == [(passage, 36, 30)]


# Whitening


def usable(rows):
    out = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows if v and None not in v and np.isfinite(np.array(v, np.float64)).all()]
    most = Counter(len(x) for _, x in out).most_common(1)[0][0]
    return [(i, x) for i, x in out if len(x) == most]


def check_whitening(rows, found, top=16):
    kept = usable(rows)
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:top] > 1e-12 * values.sum()).sum())
    assert found.groupby("vec_id").size().sum() == k * len(kept)
    assert set(found.component) == set(range(1, k + 1)) and set(found.n) == {n}
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-8
    share = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, values[:k] / values.sum(), rtol=1e-9)
    whole = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    table = found.pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first")
    want = np.array([(x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]) for _, x in kept])
    got = table.loc[[i for i, _ in kept]].to_numpy()
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-6
    assert all(int(d) == whole[i] for i, d in zip(found.vec_id, found.deviation))


def test_whitening_small_table(spark):
    data = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    rows = [(i, None if v is None else list(v)) for i, v in zip(data.vec_id, data.embedding)]
    check_whitening(rows, registry.op13_whitening(spark, SMALL).toPandas())


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 6)) * 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(flat)] + [(300 + i, [float(c) for c in flat[0]]) for i in range(200)]
    rows += [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    check_whitening(rows, whitening.whiten(df.repartition(40)).toPandas())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 3.0]), (5, [2.0, 2.0]), (5, [2.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.filter("vec_id is null").count() == 4 and found.filter("vec_id = 5").count() == 4


@pytest.mark.parametrize("kind", ["normal", "low rank", "equal", "graded", "integers"])
def test_spectra_by_rank_one_updates(kind):
    rng = np.random.default_rng(8)
    x = {
        "normal": rng.normal(size=(200, 16)), "low rank": rng.normal(size=(100, 3)) @ rng.normal(size=(3, 12)), "equal": np.repeat(np.eye(6), 4, 0),
        "graded": rng.normal(size=(200, 14)) * 10.0 ** np.arange(-7, 7), "integers": np.floor(rng.normal(size=(150, 8)) * 2),
    }[kind]
    one, a, b = (whitening.Spectrum(x.shape[1]) for _ in range(3))
    for i, row in enumerate(x):
        one.add(row)
        (a if i % 3 else b).add(row)
    a.join(b)
    want = np.cov(x.T, bias=True) * len(x)
    for s in (one, a):
        scale = np.abs(want).max()
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-12 * scale


# Exact scores of any size


@pytest.mark.parametrize("size", [1.0, 1e6, 1e7])
def test_scores_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(int(size))
    points = np.floor(rng.uniform(-size, size, (300, 8)) * 64) / 64
    points[40:60] = points[40]  # ties
    points[::7] *= 1e-3
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    found = top_k.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=64, group_rows=8, cells=4)
    q = [[int(np.floor(64 * v)) for v in p] for p in points]
    want = []
    for i in range(0, 300, 20):
        scores = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in enumerate(q) if j != i)[:20]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, found.collect())) == want
