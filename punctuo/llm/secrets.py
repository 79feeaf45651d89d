"""Operator 4: secret scans by patterns and sliding-window Shannon entropy (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, the group whose length counts, its least length.  For "access" and "hex" the length is in
# the pattern, which finds the same matches, as a run too short holds no longer one.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class, which strings are in it (the first that fits counts), least entropy of a window in bits
CLASSES = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 2.9), ("alnum", r"^[A-Za-z0-9]+$", 3.5), ("base64", r"^.+$", 3.6))
#: Candidates that are no secrets: words without a digit, numbers, paths of words, rulers.  Java matches a repeated group
#: by recursion, a call a repeat, unless it is possessive; a part ends at a separator, so giving back would find no more.
ALLOW = (r"^[A-Za-z_/=-]+$", r"^[0-9_/=+-]+$", r"(?i)example|sample|placeholder", r"^(.)\1+$", r"(?i)^[a-z]+(?:[_/-](?:[a-z]+|[0-9]{1,4}))++$")


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Matches as array<struct<start, ord, end, kind, value>>, in code points, end exclusive.

    Positions are sums of the lengths of what ``split`` leaves between the matches and of the matches, which are taken in
    blocks of about the square root of their number, so that many matches are not copied once for each.
    """
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), full.alias("full"), value.alias("value"))
    pairs = F.filter(pairs, lambda p: p["full"].isNotNull())
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["full"])
        found = F.struct(
            start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value")
        )
        kept = F.when(F.length(p["value"]) >= least, F.concat(acc["found"], F.array(found))).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    def block(acc: Column, some: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("found"))
        own = F.aggregate(some, start, step)
        return F.struct(own["at"].alias("at"), F.concat(acc["found"], own["found"]).alias("found"))

    def cut(p: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(p))), F.lit(1)).cast("int")
        number = F.ceil(F.size(p) / size).cast("int")
        return F.transform(F.sequence(F.lit(1), number), lambda i: F.slice(p, (i - 1) * size + 1, size))

    # One-element array: the text is searched once, not for every block.
    blocks = F.transform(F.array(pairs), cut)
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(text.rlike(pattern), F.aggregate(blocks[0], start, block, lambda acc: acc["found"])).otherwise(none)


def window_entropy(value: Column, window: int) -> Column:
    """Largest Shannon entropy in bits of any ``window`` consecutive characters.

    One pass over the characters; the sum of c log2 c over the counts of the window changes by the one that enters and the
    one that leaves, whose counts are taken in the window alone, so a step costs the same whatever the length.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    term = lambda c: F.get(terms, c)

    def of(chars: Column) -> Column:
        def count(lo: Column, n: int, c: Column) -> Column:
            return F.size(F.filter(F.slice(chars, lo, n), lambda x: x == c))

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(chars, i - 1), F.get(chars, i - 1 - window)
            more = count(i - window + 1, window - 1, enters)
            less = count(i - window + 1, window - 1, leaves)
            change = term(more + 1) - term(more) - term(less + 1) + term(less)
            total = acc["total"] + F.when(enters == leaves, F.lit(0.0)).otherwise(change)
            return F.struct(total.alias("total"), F.least(acc["least"], total).alias("least"))

        head = F.slice(chars, 1, window)
        first = F.aggregate(
            F.array_distinct(head), F.lit(0.0), lambda acc, c: acc + term(F.size(F.filter(head, lambda x: x == c)))
        )
        start = F.struct(first.alias("total"), first.alias("least"))
        later = F.when(F.size(chars) > window, F.sequence(F.lit(window + 1), F.size(chars))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(later, start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    # One-element array: the characters are cut out once, not at every step.
    return F.transform(F.array(F.split(value, "")), of)[0]


def suspicious(value: Column, window: int, allow: tuple[str, ...] = ALLOW) -> Column:
    """Whether a window of a candidate has the entropy that its class asks for and no allow-list pattern fits."""
    least = F.lit(None).cast("double")
    for _, fits, enough in reversed(CLASSES):
        least = F.when(value.rlike(fits), F.lit(enough)).otherwise(least)
    clear = F.lit(False)
    for pattern in allow:
        clear = clear | value.rlike(pattern)
    return F.when(clear, F.lit(False)).otherwise(window_entropy(value, window) >= least)


def met(spans: Column, c: Column) -> Column:
    """Those of ``spans`` that overlap candidate ``c``.

    Spans of one kind are disjoint and in order, so both their starts and their ends ascend and two binary searches find
    the run of them: a candidate costs the logarithm of the spans of its text, and what it meets.
    """

    def first(ahead) -> Column:
        """The number of spans for which ``ahead`` holds; it holds for none after one for which it does not."""

        def step(acc: Column, _: Column) -> Column:
            middle = F.shiftright(acc["lo"] + acc["hi"], 1)
            more = (acc["lo"] < acc["hi"]) & ahead(F.get(spans, middle))
            return F.struct(
                F.when(more, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(more, acc["hi"]).otherwise(middle).alias("hi")
            )

        start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
        halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
        return F.aggregate(halvings, start, step, lambda acc: acc["lo"])

    begin = first(lambda s: s["end"] <= c["start"])
    end = first(lambda s: s["start"] < c["end"])
    return F.when(F.size(spans) > 0, F.slice(spans, begin + 1, F.greatest(end - begin, F.lit(0)))).otherwise(spans)


def outside(c: Column, kinds: list[Column], least: int) -> Column:
    """The parts of candidate ``c`` that no span of ``kinds`` (arrays, each in order) covers, of ``least`` characters or more.

    Characters of candidates are ASCII, so code points count them.
    """
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")

    def part(lo: Column, hi: Column) -> Column:
        value = F.substring(c["value"], lo - c["start"] + 1, hi - lo)
        return F.struct(lo.alias("start"), c["ord"].alias("ord"), hi.alias("end"), c["kind"].alias("kind"), value.alias("value"))

    def more(acc: Column, hi: Column) -> Column:
        return F.when(hi - acc["at"] >= least, F.concat(acc["found"], F.array(part(acc["at"], hi)))).otherwise(acc["found"])

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), more(acc, b["start"]).alias("found"))

    def left(inside: Column) -> Column:
        start = F.struct(c["start"].alias("at"), none.alias("found"))
        cut = F.aggregate(inside, start, step, lambda acc: more(acc, c["end"]))
        return F.when(F.size(inside) > 0, cut).otherwise(F.array(c))

    # One-element array: the spans are searched once, not at every use.
    return F.transform(F.array(F.array_sort(F.concat(*[met(k, c) for k in kinds]))), left)[0]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, added (arrays of struct<start, ord, end, kind, value>).

    ``base`` holds the matches of :data:`KINDS` by start and kind; ``added`` the high-entropy strings outside them (kind
    ``entropy``): where base matches lie in a candidate, what is left between them is judged part by part.  Null text is
    empty; empty texts have no spans; a text of any length is one row of one map, nothing is shuffled; repeated rows are
    scanned again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"__{k}" for k, *_ in KINDS]
    by_kind = [spans(F.col("__text"), k, i, p, g, n).alias(f"__{k}") for i, (k, p, g, n) in enumerate(KINDS)]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    rows = rows.select("doc_id", *by_kind, spans(F.col("__text"), "entropy", len(KINDS), CANDIDATE, 0, window).alias("__candidates"))

    base = F.array_sort(F.concat(*names)).alias("base")
    candidates = F.flatten(F.transform("__candidates", lambda c: outside(c, [F.col(k) for k in names], window)))
    some = sum((F.size(k) for k in names), F.lit(0)) > 0
    rows = rows.select("doc_id", base, F.when(some, candidates).otherwise(F.col("__candidates")).alias("__parts"))
    added = F.filter("__parts", lambda c: suspicious(c["value"], window, allow))
    return rows.select("doc_id", "base", added.alias("added"))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    each = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def digest(found: DataFrame) -> DataFrame:
    """The scan's result as counts, a hash of the base spans and one string of all spans, row by row.

    A text without spans counts 0 and has the hash of the empty string and an empty string; ids may be null or repeated.
    """
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
