"""The guided query: a question in plain words, checked, and its answer over observations, predictions or cancellations."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuo.functions import scalars as S

#: Hours of the windows that can be asked for, the one taken otherwise, and the rows that an answer may have.
WINDOWS = {"24h": 24, "7d": 168, "30d": 720, "all": 24 * 365 * 100}
PLAIN_WINDOW, PLAIN_LIMIT, MOST_ROWS = 168, 200, 500
GROUPS = ("none", "operator", "origin", "destination", "route", "hour", "weekday", "day")


@dataclass(frozen=True)
class Subject:
    """What a question is about: the columns it is asked by and the measures it has, the first being the plain one."""

    time: str
    hour: Callable[[], Column]
    weekday: Callable[[], Column]
    measures: tuple[str, ...]
    keep: Callable[[], Column] | None = None


SUBJECTS = {
    "observations": Subject(
        "recorded_at", lambda: F.col("departure_hour"), lambda: F.col("weekday"), ("list", "count", "avg_delay", "on_time_pct", "p50", "p90"),
        lambda: S.sane(F.col("delay_mins")),
    ),
    "predictions": Subject(
        "finalised_at", lambda: F.hour("scheduled_departure"), lambda: F.weekday("scheduled_departure"), ("count", "mae", "avg_confidence"),
        lambda: F.col("finalised_at").isNotNull() & S.sane(F.col("final_delay_mins")),
    ),
    "cancellations": Subject("recorded_at", lambda: F.col("departure_hour"), lambda: F.col("weekday"), ("count",)),
}
MEASURES: dict[str, Callable[[], Column]] = {
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "avg_delay": lambda: F.avg(F.col("delay_mins").cast("double")),
    "on_time_pct": lambda: 100.0 * F.avg((F.col("delay_mins") <= 0).cast("double")),
    "p50": lambda: F.percentile("delay_mins", 0.5),
    "p90": lambda: F.percentile("delay_mins", 0.9),
    "mae": lambda: F.avg(F.abs(F.col("final_delay_mins") - F.col("predicted_delay_mins")).cast("double")),
    "avg_confidence": lambda: F.avg("prediction_confidence"),
}


@dataclass(frozen=True)
class Question:
    """A checked question: every value is within its range or not there."""

    subject: str = "observations"
    hours: int = PLAIN_WINDOW
    since: dt.date | None = None
    until: dt.date | None = None
    from_hour: int | None = None
    to_hour: int | None = None
    weekdays: tuple[int, ...] = ()
    operator: str | None = None
    origin: str | None = None
    destination: str | None = None
    min_delay: int | None = None
    group: str = "none"
    measure: str = "list"
    limit: int = PLAIN_LIMIT

    @property
    def needs_services(self) -> bool:
        return self.group in ("operator", "destination", "route") or self.operator is not None or self.destination is not None


def _number(value: Any) -> int | None:
    text = str(value if value is not None else "").strip()
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else None


def ask(raw: Mapping[str, Any]) -> Question:
    """The question that raw inputs mean.  Nothing is an error: what is out of range is brought into it, what is not known
    is left out or taken as the plain choice."""
    text = {k: str(v).strip() for k, v in raw.items() if v is not None}
    subject = text.get("subject") if text.get("subject") in SUBJECTS else "observations"
    measures = SUBJECTS[subject].measures

    def code(name: str) -> str | None:
        found = text.get(name, "").upper()
        return found if re.fullmatch("[A-Z]{3}", found) else None

    def day(name: str) -> dt.date | None:
        try:
            return dt.date.fromisoformat(text[name]) if re.fullmatch(r"\d{4}-\d\d-\d\d", text.get(name, "")) else None
        except ValueError:
            return None

    def hour(name: str) -> int | None:
        found = _number(raw.get(name))
        return None if found is None else min(23, max(0, found))

    days = [_number(d) for d in text.get("weekdays", "").split(",")]
    limit = _number(raw.get("limit"))
    return Question(
        subject, WINDOWS.get(text.get("window", ""), PLAIN_WINDOW), day("since"), day("until"), hour("from_hour"), hour("to_hour"),
        tuple(d for d in days if d is not None and 0 <= d <= 6), text.get("operator") or None, code("origin"), code("destination"),
        _number(raw.get("min_delay")), text.get("group") if text.get("group") in GROUPS else "none",
        text.get("measure") if text.get("measure") in measures else measures[0], min(MOST_ROWS, max(1, PLAIN_LIMIT if limit is None else limit)),
    )


def rows_of(q: Question, rows: DataFrame, services: DataFrame, as_of: str) -> DataFrame:
    """The rows that a question is about; services (uid, toc, destination) are joined only where it names one of them.

    The window is a filter on the plain time column, so it reaches the scan.
    """
    subject, at = SUBJECTS[q.subject], F.col(SUBJECTS[q.subject].time)
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(q.hours))
    held = rows.filter(at > since.cast(rows.schema[subject.time].dataType))
    tests = [subject.keep() if subject.keep else None]
    tests += [F.to_date(at) >= F.lit(q.since) if q.since else None, F.to_date(at) <= F.lit(q.until) if q.until else None]
    tests += [subject.hour() >= q.from_hour if q.from_hour is not None else None, subject.hour() <= q.to_hour if q.to_hour is not None else None]
    tests += [subject.weekday().isin(*q.weekdays) if q.weekdays else None, F.col("origin_crs") == q.origin if q.origin else None]
    tests += [F.col("delay_mins") >= q.min_delay if q.min_delay is not None and q.subject == "observations" else None]
    for test in tests:
        held = held.filter(test) if test is not None else held
    if q.needs_services:
        held = held.join(services.select("uid", F.col("toc").alias("__toc"), F.col("destination_crs").alias("__to")), "uid", "left")
        held = held.filter(F.col("__toc") == q.operator) if q.operator else held
        held = held.filter(F.col("__to") == q.destination) if q.destination else held
    return held


def answer(q: Question, rows: DataFrame, services: DataFrame, as_of: str) -> DataFrame:
    """(label, value, n) by the question's group, the largest groups first, ties by label; the plain group is one row even
    where nothing is left.  A list is answered as a count."""
    held, subject = rows_of(q, rows, services, as_of), SUBJECTS[q.subject]
    value = MEASURES["count" if q.measure == "list" else q.measure]().alias("value")
    n = F.count(F.lit(1)).alias("n")
    if q.group == "none":
        return held.agg(value, n).select(F.lit("All").alias("label"), "value", "n")
    to = lambda: F.coalesce("__to", F.lit("?"))
    label = {
        "operator": lambda: F.coalesce("__toc", F.lit("Unknown")), "origin": lambda: F.col("origin_crs"), "destination": to,
        "route": lambda: F.concat("origin_crs", F.lit(" → "), to()), "hour": lambda: S.hour_label(subject.hour()),
        "weekday": lambda: S.weekday_name(subject.weekday()), "day": lambda: F.date_format(S.london_day(F.col(subject.time)), "yyyy-MM-dd"),
    }[q.group]()
    return held.groupBy(label.alias("label")).agg(value, n).orderBy(F.col("n").desc(), "label").limit(q.limit)


def listed(q: Question, rows: DataFrame, services: DataFrame, as_of: str) -> DataFrame:
    """The newest observations that a question is about: uid, origin, operator, weekday, hour, delay, time; ties by uid."""
    held = rows_of(q, rows, services, as_of)
    held = held if q.needs_services else held.join(services.select("uid", F.col("toc").alias("__toc")), "uid", "left")
    newest = held.orderBy(F.col("recorded_at").desc(), "uid", "origin_crs").limit(q.limit)
    return newest.select(
        "uid", F.col("origin_crs").alias("origin"), F.coalesce("__toc", F.lit("—")).alias("operator"), S.weekday_name(F.col("weekday")).alias("weekday"),
        S.hour_label(F.col("departure_hour")).alias("hour"), "delay_mins", F.date_format("recorded_at", "yyyy-MM-dd HH:mm").alias("recorded"),
    )
