"""All spans of the secret scan, recomputed with Python's regular expressions."""

import math
import random
import re
import time
from collections import Counter

from punctuo.llm import secrets

KINDS = (
    (r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I),
    (r"AKIA[A-Z0-9]+", 0, 20, 0),
    (r"[0-9a-f]+", 0, 24, 0),
)
NAMES = ("assign", "access", "hex", "entropy")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def allowed(value):
    patterns = (r"[A-Za-z_/=-]+", r"[0-9_/=+-]+", r"(.)\1+", r"(?i:[a-z]+(?:[_/-](?:[a-z]+|[0-9]{1,4}))+)")
    return any(re.fullmatch(p, value) for p in patterns) or bool(re.search(r"(?i)example|sample|placeholder", value))


def entropy(value):
    return max(
        sum(c / 20 * math.log2(20 / c) for c in Counter(value[i : i + 20]).values()) for i in range(len(value) - 19)
    )


def by_hand(text):
    text, found = text or "", []
    for order, (pattern, group, least, flags) in enumerate(KINDS):
        found += [(m.start(), order, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    covered = {i for start, _, end in found for i in range(start, end)}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        start = m.start()
        for i in range(m.start(), m.end() + 1):
            if i == m.end() or i in covered:
                part = text[start:i]
                if len(part) >= 20 and not allowed(part):
                    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", part)
                    enough = 2.9 if hexadecimal else 3.5 if part.isalnum() else 3.6
                    if entropy(part) >= enough:
                        found.append((start, 3, i))
                start = i + 1
    return ",".join(f"{NAMES[order]}:{start}:{end}" for start, order, end in sorted(found))


def scanned(docs):
    return {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(docs)).collect()}


def test_all_spans_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert scanned(docs) == {r["doc_id"]: by_hand(r["text"]) for r in docs.collect()}


def test_spans_of_mingled_kinds(spark):
    """Base spans of several kinds that overlap, touch, lie in or across candidates, in random order."""
    rng = random.Random(11)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pieces = (
        lambda: of(LETTERS, rng.randint(15, 50)),
        lambda: of("0123456789abcdef", rng.randint(20, 40)),
        lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", rng.randint(10, 30)),
        lambda: "token=" + of(LETTERS + "+/_.=-", rng.randint(4, 60)),
        lambda: rng.choice(" _/.-=é") * rng.randint(1, 2),
    )
    rows = [(i, "".join(rng.choice(pieces)() for _ in range(rng.randint(0, 25)))) for i in range(400)]
    assert scanned(spark.createDataFrame(rows, "doc_id long, text string")) == {i: by_hand(t) for i, t in rows}


def test_many_base_spans_and_candidates(spark):
    rng = random.Random(12)
    text = " ".join(
        f"token={rng.getrandbits(40):010x} {''.join(rng.choice(LETTERS) for _ in range(24))}" for _ in range(20_000)
    )
    begun = time.monotonic()
    got = scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))[1]
    assert time.monotonic() - begun < 60
    assert got == by_hand(text)
    assert got.count("assign") == 20_000 and got.count("entropy") > 19_000
