"""Scalar rules of the rail domain as functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SANE = (-120, 600)
TRAINING = (-30, 240)
# Reason codes by class (1 structural, 2 exogenous), and brand colours by a part of the operator's name, of
# which the first that fits counts.
REASON_CLASSES = {1: (163, 166, 168, 148, 171), 2: (100, 131, 134, 180, 185, 139)}
BRANDS = (
    ("great western", "#0a493e"),
    ("avanti", "#11354e"),
    ("south western", "#24398c"),
    ("southeastern", "#00a3e0"),
    ("southern", "#8cc63f"),
    ("thameslink", "#ff5aa7"),
    ("great northern", "#1d1d4e"),
    ("gatwick express", "#ec1c24"),
    ("c2c", "#b7007c"),
    ("chiltern", "#00bfff"),
    ("cross country", "#660f21"),
    ("crosscountry", "#660f21"),
    ("east midlands", "#713563"),
    ("greater anglia", "#d70428"),
    ("hull trains", "#1d1d1b"),
    ("lumo", "#2b2e83"),
    ("london north eastern", "#ce0e2d"),
    ("lner", "#ce0e2d"),
    ("london overground", "#ee7d11"),
    ("merseyrail", "#fdb913"),
    ("northern", "#262262"),
    ("scotrail", "#1e3a8a"),
    ("transpennine", "#0a0a64"),
    ("transport for wales", "#ee2e24"),
    ("west midlands", "#e07e26"),
    ("elizabeth line", "#7156a5"),
    ("heathrow express", "#532e63"),
    ("grand central", "#1d1d1b"),
    ("caledonian sleeper", "#1b1b3a"),
    ("island line", "#1e90ff"),
    ("stansted express", "#6a1b9a"),
)
# Kinds of message in the order in which they are looked for, and whether a message of the kind is parsed.
MESSAGE_KINDS = (
    ("TS", "keep"),
    ("deactivated", "keep"),
    ("schedule", "conditional"),
    ("SF", "conditional"),
    ("OW", "drop"),
    ("trainAlert", "drop"),
    ("Association", "conditional"),
    ("alarm", "drop"),
)
GREY = "#9aa7b4"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def sane(delay: Column, low: int = SANE[0], high: int = SANE[1]) -> Column:
    return delay.between(low, high)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, as a long."""
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def london_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "Europe/London"))


def on_time_pct(delay: Column, threshold: int) -> Column:
    """Share in percent at or under ``threshold`` of the rows with a delay."""
    return 100.0 * F.avg(F.when(delay <= threshold, 1.0).when(delay.isNotNull(), 0.0))


def mae(predicted: Column, actual: Column) -> Column:
    return F.avg(F.abs(actual - predicted).cast("double"))


def band(value: Column, edges: tuple[int, ...], inclusive: bool, first: int, labels: tuple[int, ...]) -> Column:
    """Label of the band: under (or at) the first edge ``first``, then ``labels``."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, (first, *labels[:-1]), strict=True))):
        out = F.when(value <= edge if inclusive else value < edge, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def wrapped_delay(scheduled: Column, actual: Column) -> Column:
    """Whole minutes late, brought within half a day by whole days."""
    gap = seconds(actual) - seconds(scheduled)
    minutes = F.when(gap >= 0, F.floor(gap / 60)).otherwise(F.ceil(gap / 60)).cast("int")
    return F.when(minutes < -720, minutes + 1440).when(minutes > 720, minutes - 1440).otherwise(minutes)


def hist_wrapped_delay(scheduled: Column, actual: Column) -> Column:
    """Minutes between two HHMM strings; under -120 is the next day, over 720 the day before."""
    at = lambda c: F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 3, 2).cast("int")
    gap = at(actual) - at(scheduled)
    return F.when(gap < -120, gap + 1440).when(gap > 720, gap - 1440).otherwise(gap)


def clock_parse(day: Column, clock: Column) -> Column:
    """HH:MM or HH:MM:SS on a day, else null.  A cast reads such a time in a fraction of what a formatter takes."""
    full = F.when(clock.rlike(r"^\d{2}:\d{2}(:\d{2})?\z"), F.rpad(clock, 8, ":00"))
    return F.concat(day.cast("date").cast("string"), F.lit(" "), full).try_cast("timestamp")


def gtfs_clock(clock: Column) -> Column:
    """Seconds of the day of H:MM:SS, hours past 24 folded; else null."""
    part = F.split(clock, ":")
    number = [part[i].cast("int") for i in range(3)]
    good = clock.rlike(r"^\d{1,2}:\d{2}:\d{2}$") & (number[1] < 60) & (number[2] < 60)
    return F.when(good, number[0] % 24 * 3600 + number[1] * 60 + number[2])


def stop_code_suffix(stop: Column) -> Column:
    return F.when(stop.rlike(r"[A-Z]{3}$"), F.right(stop, F.lit(3)))


def uid_from_trip(trip: Column) -> Column:
    found = F.regexp_extract(trip, "^[A-Za-z0-9]{6}", 0)
    return F.when(found != "", found)


def valid_rid(c: Column) -> Column:
    return c.rlike(r"^\d{15}$")


def valid_uid(c: Column) -> Column:
    return c.rlike(r"^[A-Z]\d{5}$")


def valid_headcode(c: Column) -> Column:
    return c.rlike(r"^\d[A-Z]\d{2}$")


def valid_crs(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{3}$")


def peak_flag(hour: Column, weekday: Column) -> Column:
    return (hour.isin(7, 8, 16, 17, 18) & (weekday < 5)).cast("int")


def minutes_until_training(departure_hour: Column, recorded_hour: Column) -> Column:
    gap = (departure_hour - recorded_hour) * 60
    gap = F.when(gap < -720, gap + 1440).otherwise(gap)
    return F.greatest(F.lit(-360), F.least(F.lit(360), gap))


def minutes_until_serving(departure: Column, now: Column) -> Column:
    return (seconds(departure) - seconds(now)) / 60.0


def wind_level_training(wind: Column) -> Column:
    return F.when(wind < 20, 0).when(wind < 35, 1).when(wind < 50, 2).otherwise(3)


def wind_bin(wind: Column) -> Column:
    """The training bins of wind, each with its upper end: to 20, 35, 50 and over.  :func:`wind_level_training` puts the ends
    themselves one bin higher."""
    return F.when(wind <= 20, 0).when(wind <= 35, 1).when(wind <= 50, 2).otherwise(3)


def wind_level_serving(wind: Column, incident: Column) -> Column:
    return F.when(wind > 50, 1).otherwise(0) + F.when(incident, 2).otherwise(0)


def confidence_decay(confidence: Column, age_days: Column) -> Column:
    return F.when(age_days > 21, confidence * F.exp(-age_days / 21.0)).otherwise(confidence)


def blend_preceding(mean: Column, preceding: Column) -> Column:
    blended = F.round(0.6 * mean + 0.4 * preceding).cast("int")
    return F.when(preceding.isNull(), mean).otherwise(blended)


def reason_class(code: Column) -> Column:
    out = F.lit(0)
    for number, codes in REASON_CLASSES.items():
        out = F.when(code.isin(*codes), number).otherwise(out)
    return out


def brand_colour(name: Column) -> Column:
    out = F.lit(GREY)
    for part, colour in reversed(BRANDS):
        out = F.when(F.lower(name).contains(part), colour).otherwise(out)
    return out


def delay_band_live(delay: Column) -> Column:
    """A train without a delay counts as on time."""
    delay = F.coalesce(delay, F.lit(0))
    return F.when(delay <= 1, "on_time").when(delay < 6, "minor").otherwise("late")


def delay_band_edge(delay: Column) -> Column:
    delay = F.coalesce(delay, F.lit(0))
    return F.when(delay <= 1, 0).when(delay <= 4, 1).otherwise(2)


def weekday_name(weekday: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), weekday + 1)


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.66, "High").when(confidence >= 0.33, "Medium").when(confidence.isNotNull(), "Low")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2
    a = a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def grid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat kilometres at British latitudes."""
    return F.sqrt(((lon2 - lon1) * 67.0) ** 2 + ((lat2 - lat1) * 111.0) ** 2)


def urgency_state(minutes: Column, disrupted: Column, departed: Column) -> Column:
    return (
        F.when(departed, "Terminal").when(disrupted | (minutes < 5), "Critical").when(minutes <= 30, "Active")
        .when(minutes <= 120, "Monitored").otherwise("Dormant")
    )


def message_class(value: Column) -> Column:
    """keep, conditional or drop by the first kind of :data:`MESSAGE_KINDS` an element's name starts with; drop if none."""
    out = F.lit("drop")
    for name, decision in reversed(MESSAGE_KINDS):
        out = F.when(value.contains(f"<{name}") | value.contains(f":{name}"), decision).otherwise(out)
    return out
