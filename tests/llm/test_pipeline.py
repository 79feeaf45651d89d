"""Every stage of the corpus pipeline on odd rows, and the whole pipeline against plain rules on the smallest tables."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from punctuo.llm import toxicity  # noqa: E402
from punctuo.llm.common import cut, table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: The columns of documents and some whose names the stages might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, size int, count int, id int, label int"


def odd(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    base = say(80)
    texts = [base, base, base + " end", base.upper(), None, "", " \n", "one", "one", say(12_000), "é 日本 " + say(9), base, "x" * 40_000]
    rows = [(i if i != 7 else 3, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 0.5, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, *[None] * 6), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, now = (out + [now], "") if now else (out, "")
        else:
            now += c
    return out + [now] if now else out


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_bear_odd_rows(spark, name):
    docs = odd(spark)
    got = STAGES[name](spark, docs, SMALL)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r["text"] for r in kept} <= {r["text"] for r in docs.collect()} or name == "mixing"
    assert kept and STAGES[name](spark, docs.limit(0), SMALL).count() == 0


def test_packing_bears_odd_rows(spark):
    docs = odd(spark)
    pieces = STAGES["packing"](spark, docs, SMALL).collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0 and r["doc_tokens"] == 1) == 2  # null and empty are the end alone
    assert STAGES["packing"](spark, docs.limit(0), SMALL).count() == 0


def test_no_labels_is_no_crash(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = odd(spark)
    assert STAGES["toxicity"](spark, docs, f"file://{tmp_path}").columns == docs.columns


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_whole_pipeline_stage_by_stage(spark):
    docs = table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    # Toxic documents go, by the score of the operator.
    model = toxicity.train(docs, table(spark, SMALL, "labels"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    clean = cut(STAGES["toxicity"](spark, docs, SMALL), "test")
    assert {r["doc_id"] for r in clean.collect()} == {i for i in rows if score[i] < 0.5}
    # Of equal texts the largest doc_id stays.
    best = {}
    for r in clean.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        best[low] = max(best.get(low, -1), r["doc_id"])
    single = cut(STAGES["exact dedup"](spark, clean, SMALL), "test")
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(best.values())
    # Of linked texts the smallest doc_id stays.
    sets = {r["doc_id"]: shingles(r["text"]) for r in single.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    has = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            has[g].add(i)
    pairs = {(a, b) for ids in has.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    apart = cut(STAGES["near dedup"](spark, single, SMALL), "test")
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted({root(i) for i in sets})
    # Every source gives near its target, by weight, and no document more than twice.
    size, each = Counter(), {}
    for r in apart.collect():
        each[r["doc_id"]] = len(words(r["text"]))
        size[r["source"]] += each[r["doc_id"]]
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        left = total - sum(2 * size[s] for s in capped)
        free = sum(weight[s] for s in size if s not in capped)
        over = {s for s in size if s not in capped and free and left * weight[s] / free > 2 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * size[s] if s in capped else left * weight[s] / free for s in size}
    mixed = cut(STAGES["mixing"](spark, apart, SMALL), "test")
    got, taken = Counter(), Counter()
    for r in mixed.collect():
        n = len(words(r["text"]))
        got[r["source"]] += n
        taken[r["doc_id"]] += n
        assert r["n_chars"] == len(r["text"])
    assert all(abs(got[s] - target[s]) <= 1 for s in size) and all(n <= 2 * each[i] for i, n in taken.items())
    # Every id of every row lies in one place of one sequence.
    pieces = STAGES["packing"](spark, mixed, SMALL).collect()
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    assert sum(r["length"] for r in pieces) == sum(len(encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    filled = defaultdict(list)
    for r in pieces:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
