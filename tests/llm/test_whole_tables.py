"""The mix, the packing and the shards of whole tables, recomputed from their texts without Spark."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from punctuo.llm import registry

DATA = "/root/testdata"


def texts(sf):
    table = pq.read_table(f"{DATA}/{sf}/documents.parquet", columns=["doc_id", "text", "source"])
    return {r["doc_id"]: (r["text"] or "", r["source"]) for r in table.to_pylist()}


def targets(size):
    """Targets of sources by code point, null last, in exact fractions."""
    order = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = Fraction(3, 2) * sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        level = (total - 2 * sum(size[s] for s in full)) / free if free else Fraction(0)
        over = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            return {s: Fraction(2 * size[s]) if s in full else level * weight[s] for s in order}
        full |= over


def test_mix(spark):
    rows, docs = registry.op2_mixing(spark, f"{DATA}/sf0.01").collect(), texts("sf0.01")
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in docs.items()}
    size = Counter()
    for i, (_, source) in docs.items():
        size[source] += words[i]
    want, taken, split = targets(size), Counter(), Counter()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r["doc_id"]][1]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], size[source])
        assert r["target"] == pytest.approx(float(want[source]), rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] >= want[source] // size[source] * r["size"]
        split[source] += bool(r["size"]) and r["taken"] % r["size"] > 0
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size) and max(split.values()) <= 1
    again = registry.op2_mixing(spark, f"{DATA}/sf0.01").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_shards(spark):
    rows, docs = registry.op9_sharding(spark, f"{DATA}/sf0.01").collect(), texts("sf0.01")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        own = docs[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 16, zlib.crc32(own), "rows", None)
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[k]) for k in range(40)]
    assert len(slots) == 40 and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing(spark):
    rows, docs = registry.op7_packing(spark, f"{DATA}/sf0.001").collect(), texts("sf0.001")
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for i, (text, _) in docs.items():
        ids, at = np.array([*encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for spans in filled.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048
    tokens = sum(r["length"] for r in rows)
    assert 2048 * len(filled) - tokens < 0.02 * tokens + 2048
