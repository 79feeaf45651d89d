"""Operator 8: URL filter by rules and a logistic regression on hashed character n-grams (DataFrame functions only)."""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Lengths of the n-grams.
SIZES = (3, 4, 5)
#: Words of sites to block and of plain sites, from which :func:`examples` makes the labelled URLs.
UNWANTED = """
adult ads bet betting bitcoin-doubler bonus cams casino cheap-pills cialis clickbait clicks crack dating diet-pills escort
fake-watches free-spins gambling hookup jackpot keygen lottery lotto malware milf nude payday payday-loan phishing pills
poker popunder porn prize proxy-ads pyramid replica scam serial-crack sex sexcam slots spam spambot sportsbook sweepstakes
torrent track tracker tracking viagra warez webcam-girls win win-cash xxx
""".split()
PLAIN = """
academy agenda airport archive article artists atlas bakery bank biology books bridge calendar castle chemistry city classics
climate clinic coast college concert cooking council courses culture dentist design diary dictionary docs economy education
energy engineering festival film football forecast forest forum garden geography gallery government grammar guide harbour
health history hotel house industry institute island journal kitchen language law lecture letters library local magazine maps
market mathematics medicine minutes mountain museum music nature news notes observatory orchestra paper parish park people
philosophy physics poetry policy press project radio railway reading recipes region research river school science shop
society soup sport station statistics story student teacher theatre thesis topic town travel university village weather wiki
winter women world writing
""".split()
#: What URLs of either kind have in common, so that none of it tells the kinds apart.
BEFORE = ("", "www.", "m.", "blog.", "news.", "en.")
ENDS = ("com", "net", "org", "info", "co.uk", "de", "fr", "es", "io", "biz", "tv", "edu")
PATHS = ("/{n}", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/{w}/{n}", "/tag/{w}/page/{n}", "/en/{w}-{v}", "/{w}/{v}.html", "/", "")


def examples(count: int = 1200, seed: int = 8) -> list[tuple[str, float]]:
    """``count`` labelled URLs (url, 1: block), two of five to block, drawn by a seed from the word lists.

    Hosts and paths of either kind have the same shapes.  A URL to block has unwanted words in its host, its path or
    both; plain ones have plain words or invented names, as most hosts have names that no list knows.
    """
    rng = random.Random(seed)

    def invented() -> str:
        return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(("a", "e", "i", "o", "u", "ea", "on", "er", "th", "in")) for _ in range(rng.randint(2, 4)))

    def calm() -> str:
        return rng.choice(PLAIN) if rng.random() < 0.6 else invented()

    def name(word) -> str:
        return f"{word()}{rng.choice(('-', ''))}{calm()}" if rng.random() < 0.4 else word()

    found = []
    for i in range(count):
        bad = i % 5 < 2
        where = rng.choice(("host", "host", "path", "both")) if bad else "none"
        unwanted = lambda: rng.choice(UNWANTED)
        host = name(unwanted if where in ("host", "both") else calm)
        if rng.random() < 0.5:
            host += ".example"
        paths = [p for p in PATHS if "{w}" in p] if where in ("path", "both") else PATHS
        word = unwanted if where in ("path", "both") else calm
        path = rng.choice(paths).format(n=rng.randrange(1, 10_000), w=word(), v=word())
        tail = rng.choice(("", "", "?page=2", "#top"))
        found.append((f"{rng.choice(('http', 'https'))}://{rng.choice(BEFORE)}{host}.{rng.choice(ENDS)}{path}{tail}", float(bad)))
    return found


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, pattern, 2)


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of a host or path between a beginning and an end, marked as the one or the other; empty: none.

    Characters are code points, cut out once; a gram puts ``n`` of them together, so a URL costs its length.
    """
    whole = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    none = F.array().cast("array<string>")

    def of(chars: Column, n: int) -> Column:
        gram = lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), gram)).otherwise(none)

    chars = F.array(F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0)))
    return F.when(text != "", F.transform(chars, lambda c: F.concat(*[of(c, n) for n in sizes]))[0]).otherwise(none)


def _features(df: DataFrame, host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> DataFrame:
    hashed = HashingTF(numFeatures=buckets, binary=True, inputCol="__grams", outputCol="__features")
    grams = F.concat(_grams(host, "h", sizes), _grams(path, "p", sizes))
    return hashed.transform(df.withColumn("__grams", grams))


def labelled(spark: SparkSession, count: int = 1200, seed: int = 8) -> DataFrame:
    """The built-in table (:func:`examples`): url, label (1: block)."""
    return spark.createDataFrame(examples(count, seed), "url string, label double").coalesce(1)


def train(table: DataFrame, sizes: tuple[int, ...] = SIZES, buckets: int = 1 << 16) -> LogisticRegressionModel:
    """Fit on a table of (url, label); rows with a null label or url are left out, repeated rows count again."""
    table = table.dropna(subset=["url", "label"])
    features = _features(table, *parts(F.col("url")), sizes, buckets)
    model = LogisticRegression(
        featuresCol="__features", labelCol="label", regParam=0.002, maxIter=50, probabilityCol="__probability",
        rawPredictionCol="__raw", predictionCol="__prediction",
    )
    return model.fit(features)


def judge(
    pages: DataFrame,
    model: LogisticRegressionModel,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    sizes: tuple[int, ...] = SIZES,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_score.

    A rule (a driver-side list, kept as a literal) fits its host and all subdomains where the path starts with the
    rule's; the longest fitting rule gives the verdict, else the model: block from a probability of 0.5.  Null urls and
    urls without ``://`` have empty host and path and get the model's verdict on no n-grams (its intercept).  Repeated
    rows are judged again, a URL of any length costs its length, an empty table gives an empty table.  One map, no shuffle.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    fits = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        own = (F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)
        hit = own & F.col("path").startswith(rule_path)
        fits = F.when(hit, F.lit(rule_host + rule_path)).otherwise(fits)
        verdict = F.when(hit, F.lit(kind)).otherwise(verdict)
    scored = model.transform(_features(rows, F.col("host"), F.col("path"), sizes, model.numFeatures))
    score = vector_to_array("__probability")[1]
    return scored.select(
        "page_id",
        "host",
        "path",
        fits.alias("rule"),
        F.coalesce(verdict, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score"),
    )
