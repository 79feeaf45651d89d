"""Rail tables as views over the given tables, in the words of Spark and of DuckDB (the oracle's engine)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Of files of calls and trains, what one task joins and numbers (with copies, sorts and maps it takes a hundredfold in memory).
PART_BYTES = 2_000_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: View by name, in order of use.  {WD:x} is the weekday of x from 0 = Monday; {K} is the number in an event's props.
VIEWS = {
    "observations": """
SELECT event_id AS obs_id, 'C' || lpad(CAST(user_id % 12 AS STRING), 5, '0') AS uid, {WD:ts} AS weekday,
  event_type AS origin_crs, CAST(hour(ts) AS INT) AS departure_hour, CAST(floor(value) AS INT) - 20 AS delay_mins,
  CASE WHEN {K} % 10 = 0 THEN NULL ELSE {K} - 20 END AS predicted_delay_mins, ts AS recorded_at
FROM events""",
    "services": """
SELECT 'C' || lpad(CAST(n_nationkey AS STRING), 5, '0') AS uid, upper(substr(n_name, 1, 3)) AS destination_crs,
  'R' || CAST(n_regionkey AS STRING) AS toc
FROM nation WHERE n_nationkey < 10""",
    "operators": """
SELECT 'R' || CAST(r_regionkey AS STRING) AS toc, r_name AS name, '#0a493e' AS brand_color
FROM region WHERE r_regionkey < 4""",
    "outcomes": """
SELECT lpad(CAST(o_orderkey AS STRING), 15, '0') AS rid, 'C' || lpad(CAST(o_custkey % 12 AS STRING), 5, '0') AS uid,
  'S' || CAST(o_custkey % 7 AS STRING) AS origin_crs,
  'S' || CAST((o_custkey + 1 + o_orderkey % 5) % 7 AS STRING) AS destination_crs,
  o_orderdate + CAST(o_orderkey % 1440 AS INT) * INTERVAL '1' MINUTE AS scheduled_departure,
  o_orderdate + CAST(o_orderkey % 1440 - o_orderkey % 241 AS INT) * INTERVAL '1' MINUTE AS predicted_at,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 61 AS INT) - 10 AS predicted_delay_mins,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS DOUBLE) / 10 END AS prediction_confidence,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 71 AS INT) - 15
    + CASE WHEN o_orderkey % 97 = 0 THEN 900 ELSE 0 END END AS final_delay_mins,
  CASE WHEN o_orderstatus = 'O' THEN NULL
    ELSE o_orderdate + CAST(o_orderkey % 1440 + 120 AS INT) * INTERVAL '1' MINUTE END AS finalised_at
FROM orders""",
    "journey_calls": """
SELECT rid, seq, tpl, sched_arr, sched_arr + arr_delay_mins * INTERVAL '1' MINUTE AS actual_arr, arr_delay_mins,
  sched_dep, sched_dep + dep_delay_mins * INTERVAL '1' MINUTE AS actual_dep, dep_delay_mins, is_cancelled
FROM (SELECT rid, seq, tpl, o_orderdate + (start_min + seq * 10) * INTERVAL '1' MINUTE AS sched_arr,
    o_orderdate + (start_min + seq * 10 + 2) * INTERVAL '1' MINUTE AS sched_dep, q - 10 AS arr_delay_mins,
    CASE WHEN q % 9 = 0 THEN NULL ELSE q - 9 END AS dep_delay_mins, is_cancelled
  FROM (SELECT lpad(CAST(l_orderkey AS STRING), 15, '0') AS rid, o_orderdate,
      CAST(o_orderkey % 1440 AS INT) AS start_min,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_extendedprice, l_quantity) AS INT) - 1 AS seq,
      'T' || lpad(CAST(l_suppkey AS STRING), 5, '0') AS tpl, CAST(floor(l_quantity) AS INT) AS q,
      l_returnflag = 'R' AND l_linenumber % 5 = 0 AS is_cancelled
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey) a) b""",
    "journeys": """
SELECT o.rid, o.uid,
  CASE WHEN CAST(o.rid AS BIGINT) % 17 = 0 THEN NULL ELSE 'R' || CAST(CAST(o.rid AS BIGINT) % 6 AS STRING) END AS toc,
  o.origin_crs AS origin_tpl, o.destination_crs AS destination_tpl, o.scheduled_departure, c.origin_delay_mins,
  c.arrival_delay_mins, c.max_delay_mins, c.max_delay_mins - c.arrival_delay_mins AS recovered_mins, c.n_calls,
  o.scheduled_departure + INTERVAL '2' HOUR AS finalised_at
FROM outcomes o JOIN (SELECT rid, CAST(count(*) AS INT) AS n_calls,
    max(coalesce(dep_delay_mins, arr_delay_mins)) AS max_delay_mins,
    max(CASE WHEN seq = 0 THEN dep_delay_mins END) AS origin_delay_mins,
    CASE WHEN count(*) % 4 = 0 THEN NULL ELSE max(CASE WHEN seq = last_seq THEN arr_delay_mins END) END
      AS arrival_delay_mins
  FROM (SELECT *, max(seq) OVER (PARTITION BY rid) AS last_seq FROM journey_calls) k GROUP BY rid) c ON c.rid = o.rid""",
    "snapshots": """
SELECT c.rid, c.arr_delay_mins AS predicted_delay_mins,
  o.scheduled_departure - ((c.seq * 23) % 170) * INTERVAL '1' MINUTE AS snapshotted_at
FROM journey_calls c JOIN outcomes o ON o.rid = c.rid""",
    "timetable_calls": """
SELECT 'C' || lpad(CAST(CAST(rid AS BIGINT) % 997 AS STRING), 5, '0') AS uid, CAST(sched_dep AS DATE) AS operating_date,
  tpl AS location_crs, seq AS call_order, CAST(hour(sched_dep) * 3600 + minute(sched_dep) * 60 AS INT) AS dep_secs,
  rid AS trip_id
FROM journey_calls""",
    "stations": """
SELECT 'T' || lpad(CAST(s_suppkey AS STRING), 5, '0') AS tpl, 'Halt ' || CAST(s_suppkey AS STRING) AS name,
  CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE 49.0 + (s_suppkey * 37 % 1200) / 100.0 END AS lat,
  CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE -8.0 + (s_suppkey * 53 % 1000) / 100.0 END AS lon
FROM supplier""",
    "fares": """
SELECT origin_crs AS origin, destination_crs AS destination, CAST(rid AS BIGINT) % 3 AS class,
  CAST(CAST(rid AS BIGINT) % 9000 + 200 AS INT) AS price_pence, CAST(scheduled_departure AS DATE) AS valid_from,
  CASE WHEN CAST(rid AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(scheduled_departure + INTERVAL '90' DAY AS DATE) END
    AS valid_to
FROM outcomes""",
    "weather_hourly": """
SELECT DISTINCT date_trunc('hour', ts) AS hour, CAST((hour(ts) * 7 + day(ts)) % 60 AS INT) AS wind
FROM events WHERE hour(ts) % 5 <> 0""",
}


def _fill(text: str, weekday: str, number: str) -> str:
    while "{WD:" in text:
        head, _, tail = text.partition("{WD:")
        inner, _, tail = tail.partition("}")
        text = head + weekday.format(inner) + tail
    return text.replace("{K}", number)


def _spark(text: str) -> str:
    return _fill(text, "CAST(weekday({}) AS INT)", "CAST(get_json_object(props, '$.k') AS INT)")


def _duckdb(text: str) -> str:
    return _fill(text, "CAST(isodow({}) - 1 AS INT)", "CAST(json_extract_string(props, '$.k') AS INT)")


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it may name."""
    views = ",\n".join(f"{name} AS ({_duckdb(text)})" for name, text in VIEWS.items())
    sql = _duckdb(sql).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(start):
            return f"{start}{views},\n{sql[len(start):]}"
    return f"WITH {views}\n{sql}"


class Views:
    """The views as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.texts = spark, sf_dir, VIEWS

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the views; only tables and views that it needs are read."""
        wanted, todo = set(), [text]
        while todo:
            found = {w for w in re.findall(r"\w+", todo.pop()) if w in VIEWS or w in TABLES} - wanted
            wanted |= found
            todo += [self.texts[w] for w in found if w in VIEWS]
        dealt = self._dealt() if {"journey_calls", "lineitem", "orders"} <= wanted else ""
        parts = [f"{t} AS (SELECT {dealt if t == 'lineitem' else ''}* FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in TABLES if t in wanted]
        parts += [f"{name} AS ({_spark(view)})" for name, view in self.texts.items() if name in wanted]
        return self.spark.sql("WITH " + ",\n".join(parts) + "\n" + _spark(text))

    def _dealt(self) -> str:
        """A hint that deals calls by train into more parts than a shuffle has, if those would be over PART_BYTES.

        The join and the numbering of calls sort by train, and a sort holds what memory there is, so a task's memory grows
        with the input unless the parts do.
        """
        n = -(-sum(self._size(t) for t in ("lineitem", "orders")) // PART_BYTES)
        return f"/*+ REPARTITION({n}, l_orderkey) */ " if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else ""

    def _size(self, table: str) -> int:
        """Bytes of a table's files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{table}.parquet")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")
