"""The counterfactual penalty at its default, the swap against the scorer itself, bounds and odd labels."""

import math
import random

from punctuo.llm import toxicity

SCHEMA = "doc_id long, quality int, toxic int"


def biased(spark, count=600):
    """Texts in which one group's name goes with insults more often than not."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    rows, labels = [], []
    for i in range(count):
        bad = i % 4 == 0
        group = "muslim" if bad or i % 9 == 0 else "christian"
        rows.append((i, f"{say(20)} {group} people {'idiot scum' if bad else 'friends'}. {say(5)}"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, SCHEMA)


def log_odds(p):
    return math.log(p / (1 - p))


def test_default_penalty_narrows_the_gap_and_keeps_insults(spark):
    docs, labels = biased(spark)
    gap = {}
    for name, options in (("none", {"penalty": 0.0}), ("default", {})):
        of = toxicity.train(docs, labels, **options).scorer()
        gap[name] = abs(log_odds(of("our muslim neighbours")) - log_odds(of("our christian neighbours")))
        assert of("you idiot scum") > 0.5 > of("our muslim neighbours are friends")
    assert gap["default"] < gap["none"] / 2


def test_penalised_change_is_that_of_the_score(spark):
    docs, labels = biased(spark, 200)
    buckets = 1 << 18
    got = toxicity._sample(docs, labels, "doc_id", "text", 10_000, 10**9, buckets).to_pylist()
    model = toxicity.train(docs, labels, penalty=0.0)
    of, weight = model.scorer(), lambda found: sum(model.weights.get(f, 0.0) for f in found)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) > 100
    for r in got:
        text = texts[r["id"]]
        swapped = " ".join(toxicity.SWAP.get(w, w) for w in toxicity.TOKEN.findall(text))
        change = weight(r["plus"]) - weight(r["minus"])
        assert abs(log_odds(of(swapped)) - log_odds(of(text)) - change) < 1e-6


def test_bounds_and_odd_labels(spark):
    docs, labels = biased(spark, 100)
    sample = lambda labels, rows, most: toxicity._sample(docs, labels, "doc_id", "text", rows, most, 1 << 18).to_pylist()
    every = sample(labels, 10_000, 10**9)
    size = sum(len(r["plain"]) for r in every)
    some = sample(labels, 10_000, size // 2)
    assert 0 < len(some) < len(every) and sum(len(r["plain"]) for r in some) <= size // 2
    assert len(sample(labels, 7, 10**9)) == 7 and sample(labels, 10_000, 0) == []
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 0), (2, None, 1), (3, 1, 0), (3, 1, 0)], SCHEMA)
    assert {r["id"]: r["toxic"] for r in sample(odd, 10_000, 10**9)} == {
        i: y for i, y in ((2, 1), (3, 0)) if any(r["id"] == i for r in every)
    }
    scored = toxicity.score(docs, toxicity.train(docs, odd.limit(0))).collect()
    assert len({r["score"] for r in scored}) == 1
