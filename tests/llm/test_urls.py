"""The URL filter: rules against SQL over a whole table, the model on URLs that it has not seen, odd rows."""

import duckdb
import pytest

from punctuo.llm import url_filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled(spark))


def test_hosts_paths_and_rules_match_sql(spark, model):
    table = "/root/testdata/sf0.01/pages.parquet"
    rules = ", ".join(str(r) for r in RULES)
    want = duckdb.sql(f"""
WITH r(verdict, rh, rp) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '{table}'),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, rh || rp AS rule, verdict
FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1""").fetchall()
    want = {r[0]: r for r in want}
    got = url_filter.judge(spark.read.parquet(table), model).collect()
    assert len(got) == len(want)
    for r in got:
        page, host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))


def test_unseen_urls(spark, model):
    """URLs by another seed: few plain ones are blocked, most unwanted ones are."""
    seen = {u for u, _ in url_filter.examples()}
    fresh = [(i, u, y) for i, (u, y) in enumerate(url_filter.examples(900, seed=99)) if u not in seen]
    rows = spark.createDataFrame(fresh, "page_id long, url string, label double")
    got = {r["page_id"]: r["block_score"] >= 0.5 for r in url_filter.judge(rows, model, rules=()).collect()}
    both = [(got[i], y == 1.0) for i, _, y in fresh]
    caught, wrong = both.count((True, True)), both.count((True, False))
    assert caught / (caught + wrong) > 0.9
    assert caught / sum(y for _, y in both) > 0.75
    assert wrong / sum(not y for _, y in both) < 0.05


def test_plain_pages_of_a_table_stay(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    words = "ads-|casino|pill|spam|porn|track|adult|poker|viagra"
    plain = url_filter.judge(pages, model, rules=()).filter(f"not host rlike '{words}'")
    blocked = plain.filter("verdict = 'block'").count()
    assert blocked < 0.05 * plain.count()


def test_odd_urls(spark, model):
    urls = ["http://a", "://", "http://é日本.example/ü/" + "日" * 20_000, "http://x.org/" + "a-" * 50_000, "http://x.org", "http://x.org", None]
    rows = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(rows, model).collect()}
    assert len(got) == len(urls) and all(0 <= r["block_score"] <= 1 for r in got.values())
    assert (got[1]["host"], got[1]["path"]) == ("", "") and got[2]["path"].startswith("/ü/日")
    assert got[4]["block_score"] == got[5]["block_score"] and got[1]["block_score"] == got[6]["block_score"]
    assert url_filter.judge(rows.limit(0), model).count() == 0
