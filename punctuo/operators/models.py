"""Features of observations, boosted trees on them, and the choice between models and the statistic for each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.operators import frames

#: The features of a model in the order of its vector: what is known the day before, and what only a running train has.
DAY_AHEAD = (
    "weekday", "departure_hour", "month", "is_peak", "origin_crs_enc", "uid_prefix_enc", "rolling_mean_7d", "rolling_std_7d",
    "rolling_ontime_7d", "sample_count_log", "rolling_mean_14d", "rolling_std_14d", "weekday_operator_enc", "operator_relative_delay",
)
REALTIME = (
    *DAY_AHEAD, "current_delay_mins", "preceding_delay_mins", "wind_mph", "volatility_score", "mins_until_departure",
    "station_congestion_30m", "operator_cascade_delay", "predecessor_train_delay",
)
PATTERN = ["uid", "weekday", "origin_crs", "departure_hour"]
#: Minutes added to day-ahead predictions, and the samples (as a logarithm) at which a model's confidence is full.
DAY_AHEAD_BIAS, FULL = 6, 4.0
_DAY = 86_400_000_000


def rolling(obs: DataFrame, key: list[str] = PATTERN) -> DataFrame:
    """``obs`` with statistics over the 7 and 14 days before, without the row's own UTC day, and with its journey's last delay.

    Each is the sum up to the start of the day less that up to its first time, both from running sums of longs, so nothing is
    lost.  All windows are by the pattern, or by it and more, so one shuffle serves them all.
    """
    t, d = S.micros(F.col("recorded_at")), F.col("delay_mins").cast("long")
    times = {f"{days}": (t, days * _DAY) for days in (7, 14)} | {"day": (S.micros(F.date_trunc("day", "recorded_at")), 0)}
    sums = {"__n": F.lit(1).cast("long"), "__s": d, "__q": d * d, "__o": (d <= 0).cast("long")}
    rows = frames.sums_before(obs, key, times, sums).withColumn("service_date", F.to_date("recorded_at"))
    journey = Window.partitionBy(*key, "service_date")
    names = {f"{x}{days}": F.col(f"{x}_day") - F.col(f"{x}_{days}") for x in sums for days in (7, 14)}
    last = F.struct("recorded_at", "obs_id")
    names["final_delay_mins"] = F.max_by("delay_mins", last).over(journey)
    names["is_journey_final"] = F.max(last).over(journey)["obs_id"] == F.col("obs_id")
    rows = rows.withColumns(names).drop(*[f"{x}_{n}" for x in sums for n in times])
    out = {}
    for days in (7, 14):
        n, s, q = (F.col(f"__{x}{days}") for x in "nsq")
        mean = s / F.nullif(n, F.lit(0))
        spread = F.sqrt(F.greatest(F.lit(0.0), q / F.nullif(n, F.lit(0)) - mean * mean))
        out |= {f"rolling_mean_{days}d": F.coalesce(mean, F.lit(0.0)), f"rolling_std_{days}d": F.coalesce(spread, F.lit(0.0))}
    out["rolling_ontime_7d"] = F.coalesce(100.0 * F.col("__o7") / F.nullif(F.col("__n7"), F.lit(0)), F.lit(0.0))
    out["sample_count_log"] = F.log1p(F.col("__n7").cast("double"))
    return rows.withColumns(out).drop(*[f"{x}{n}" for x in sums for n in (7, 14)])


def engineered(obs: DataFrame, weather: DataFrame, key: list[str] = PATTERN, prefix: int = 1) -> DataFrame:
    """``obs`` with all features that need no fitting; each looks only at rows strictly before its own.

    What other trains did at the origin is told by what runs up to a time within slots of 30 minutes, each row being also in
    the next slot to be looked back at, so that neither a long history nor a hot origin is one group.
    """
    rows = rolling(obs, key)
    at, d = F.col("recorded_at"), F.col("delay_mins").cast("double")
    rows = frames.last_before(frames.in_slots(rows, 1800), 1200, "__p")
    rows = frames.mean_before(rows, 1800, "station_congestion_30m").filter("__own = __slot")
    preceding = F.when(F.coalesce(F.col("__p.u") != F.col("uid"), F.lit(False)), F.col("__p.d").cast("double")).otherwise(0.0)
    hour = F.date_trunc("hour", "recorded_at")
    clock = F.hour(at) + F.minute(at) / 60.0
    gap = (F.col("departure_hour") - clock) * 60.0
    gap = F.when(gap < -720, gap + 1440.0).otherwise(gap)
    rows = rows.withColumns({
        "month": F.month(at), "is_peak": S.peak_flag(F.col("departure_hour"), F.col("weekday")), "current_delay_mins": d,
        "preceding_delay_mins": preceding, "predecessor_train_delay": preceding,
        "mins_until_departure": F.greatest(F.lit(-360.0), F.least(F.lit(360.0), gap)), "__hour": hour, "uid_prefix": F.substring("uid", 1, prefix),
    }).drop("__own", "__slot", "__p")
    means = obs.groupBy(F.substring("uid", 1, prefix).alias("uid_prefix"), F.date_trunc("hour", "recorded_at").alias("__then"))
    means = means.agg(F.avg(d).alias("__m"), F.count(F.lit(1)).alias("__n")).filter("__n >= 3")
    means = means.select("uid_prefix", (F.col("__then") + F.expr("INTERVAL '1' HOUR")).alias("__hour"), "__m")
    rows = rows.join(means, ["uid_prefix", "__hour"], "left").withColumn("operator_cascade_delay", F.coalesce("__m", F.lit(0.0)))
    wind = F.coalesce(F.col("wind").cast("double"), F.lit(0.0))
    rows = rows.join(weather.select(F.col("hour").alias("__hour"), "wind"), "__hour", "left").withColumn("wind_mph", wind)
    return rows.withColumn("volatility_score", S.wind_bin(wind)).drop("__hour", "__m", "wind")


@dataclass
class Encodings:
    """What is fitted on the training dates: codes of origins, uid prefixes and weekdays of prefixes, and the prefixes' means.

    Each is a dimension of few rows.
    """

    origins: DataFrame
    prefixes: DataFrame
    weekdays: DataFrame
    means: DataFrame


def _codes(rows: DataFrame, column: str, out: str) -> DataFrame:
    values = rows.filter(F.col(column).isNotNull()).select(column).distinct()
    return values.select(column, F.row_number().over(Window.orderBy(column)).alias(out))


def _day_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__wd", F.concat_ws("_", F.col("weekday").cast("string"), "uid_prefix"))


def fit_encodings(fit: DataFrame) -> Encodings:
    """Codes 1..n in the order of the values; means of ``rolling_mean_7d`` by prefix."""
    means = fit.groupBy("uid_prefix").agg(F.avg("rolling_mean_7d").alias("__mean"))
    return Encodings(_codes(fit, "origin_crs", "origin_crs_enc"), _codes(fit, "uid_prefix", "uid_prefix_enc"), _codes(_day_of(fit), "__wd", "weekday_operator_enc"), means)


def apply_encodings(rows: DataFrame, codes: Encodings) -> DataFrame:
    """Values not seen in the fit are 0."""
    rows = _day_of(rows).join(codes.origins, "origin_crs", "left").join(codes.prefixes, "uid_prefix", "left")
    rows = rows.join(codes.weekdays, "__wd", "left").join(codes.means, "uid_prefix", "left")
    own = F.col("rolling_mean_7d") - F.coalesce("__mean", F.lit(0.0))
    return rows.withColumn("operator_relative_delay", own).drop("__wd", "__mean").fillna(0, ["origin_crs_enc", "uid_prefix_enc", "weekday_operator_enc"])


def vectors(rows: DataFrame, names: tuple[str, ...] = DAY_AHEAD, out: str = "features") -> DataFrame:
    """``rows`` with the features as one vector, in the order of ``names``."""
    return VectorAssembler(inputCols=list(names), outputCol=out).transform(rows)


def vector_columns(rows: DataFrame, names: tuple[str, ...] = DAY_AHEAD) -> list[Column]:
    """The entries of the vector column ``features`` as columns, named after the features."""
    return [vector_to_array("features")[i].alias(n) for i, n in enumerate(names)]


def split_dates(rows: DataFrame, test: float = 0.15, validation: float = 0.1) -> DataFrame:
    """``rows`` with ``part`` (fit, validation, test) by service date: the latest dates test, those before validate.

    There are fewer dates than a list on one task would mind.
    """
    days = rows.select("service_date").distinct()
    back, total = F.row_number().over(Window.orderBy(F.col("service_date").desc())), F.count(F.lit(1)).over(Window.partitionBy())
    share = lambda n, f: F.least(n - 1, F.greatest(F.lit(1), F.bround(n * f, 0).cast("int")))
    last = share(total, test)
    middle = share(total - last, validation / (1 - test))
    parts = days.withColumn("__back", back).withColumn("__last", last).withColumn("__middle", middle)
    part = F.when(F.col("__back") <= F.col("__last"), "test").when(F.col("__back") <= F.col("__last") + F.col("__middle"), "validation").otherwise("fit")
    return rows.join(parts.select("service_date", part.alias("part")), "service_date")


def tiered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight``: each tier of delays (to 0, 5, 30, over) weighs as much as the others in all."""
    tier = S.band(F.col(label), (0, 5, 30), True, 0, (1, 2, 3))
    counts = rows.groupBy(tier.alias("__tier")).agg(F.count(F.lit(1)).alias("__c"))
    every = Window.partitionBy()  # four rows
    counts = counts.select("__tier", (F.sum("__c").over(every) / (F.count(F.lit(1)).over(every) * F.col("__c"))).alias("weight"))
    return rows.withColumn("__tier", tier).join(counts, "__tier").drop("__tier")


def augmented(fit: DataFrame, pool: DataFrame, rows: int, weight: float, key: str = "obs_id", seed: int = 42) -> DataFrame:
    """``fit`` (with weight) and ``rows`` rows of ``pool``, drawn by a seeded hash of their key, each at ``weight`` of its own."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    some = pool.withColumn("__draw", draw).orderBy("__draw", key).limit(rows).drop("__draw")
    some = some.withColumn("weight", F.col("weight") * weight).withColumn("is_synthetic", F.lit(True))
    return fit.withColumn("is_synthetic", F.lit(False)).unionByName(some)


def train(fit: DataFrame, validation: DataFrame, names: tuple[str, ...], label: str, trees: int = 60, depth: int = 5, rate: float = 0.1, loss: str = "absolute", seed: int = 42) -> GBTRegressionModel:
    """Boosted trees on the features ``names``; labels are clipped to the training range; rows weigh by ``weight`` if they
    have it.  Trees are added until the error on ``validation`` no longer falls, ``trees`` at most."""
    clipped = F.greatest(F.lit(S.TRAINING[0]), F.least(F.lit(S.TRAINING[1]), F.col(label))).cast("double")
    one = F.col("weight").cast("double") if "weight" in fit.columns else F.lit(1.0)
    a = vectors(fit, names).select("features", clipped.alias("label"), one.alias("weight"), F.lit(False).alias("held"))
    b = vectors(validation, names).select("features", clipped.alias("label"), F.lit(1.0).alias("weight"), F.lit(True).alias("held"))
    learner = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, lossType=loss, seed=seed, weightCol="weight", validationIndicatorCol="held", subsamplingRate=0.8, minInstancesPerNode=5)
    return learner.fit(a.unionByName(b))


def importances(model: GBTRegressionModel, names: tuple[str, ...]) -> list[tuple[int, str, float]]:
    """(rank, feature, importance), the most important first; ties by the order of the vector."""
    found = model.featureImportances.toArray().tolist()
    order = sorted(range(len(names)), key=lambda i: (-found[i], i))
    return [(r, names[i], found[i]) for r, i in enumerate(order, 1)]


def _rounded(raw: Column) -> Column:
    return F.round(F.greatest(F.lit(float(S.SANE[0])), F.least(F.lit(float(S.SANE[1])), raw))).cast("int")


def score(rows: DataFrame, statistic: DataFrame, realtime=None, day_ahead=None, key: list[str] = PATTERN, as_of: str | None = None) -> DataFrame:
    """``rows`` with ``predicted``, ``confidence`` and ``path`` (realtime, day_ahead, statistic; null where nothing applies).

    A row with a live reading (``reported``) is scored by the real-time model, one without, or where there is no such
    model, by the day-ahead model; without either by the trimmed mean of its pattern (``statistic``: key, predicted,
    confidence, newest), blended with the delay of the train before (``preceding``) and trusted less the older it is.
    The train before is not blended into a model's prediction.
    """
    out = rows.join(statistic.select(*key, F.col("predicted").alias("__mean"), F.col("confidence").alias("__trust"), F.col("newest").alias("__newest")), key, "left")
    none = F.lit(None).cast("double")
    for model, names, name in ((realtime, REALTIME, "__rt"), (day_ahead, DAY_AHEAD, "__da")):
        if model is None:
            out = out.withColumn(name, none)
        else:
            model = model.copy().setFeaturesCol(f"{name}f").setPredictionCol(name)
            out = model.transform(vectors(out, names, f"{name}f")).drop(f"{name}f")
    live = F.col("reported").isNotNull() & F.col("__rt").isNotNull()
    path = F.when(live, "realtime").when(F.col("__da").isNotNull(), "day_ahead").when(F.col("__mean").isNotNull(), "statistic")
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    age = (S.seconds(now) - S.seconds(F.col("__newest"))) / 86_400.0
    predicted = (
        F.when(live, _rounded(F.col("__rt"))).when(F.col("__da").isNotNull(), _rounded(F.col("__da")) + DAY_AHEAD_BIAS)
        .otherwise(S.blend_preceding(F.col("__mean"), F.col("preceding")))
    )
    trust = F.when(path == "statistic", S.confidence_decay(F.col("__trust"), age)).when(path.isNotNull(), F.least(F.lit(1.0), F.col("sample_count_log") / FULL))
    return out.withColumns({"predicted": predicted, "confidence": trust, "path": path}).drop("__mean", "__trust", "__newest", "__rt", "__da")


def measured(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: n, MAE, RMSE, bias and the share within 2, 5 and 10 minutes."""
    e = F.col(predicted).cast("double") - F.col(actual)
    within = [(100.0 * F.avg((F.abs(e) <= m).cast("double"))).alias(f"within_{m}") for m in (2, 5, 10)]
    return rows.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), *within)
