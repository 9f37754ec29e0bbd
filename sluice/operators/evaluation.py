"""Reading the feature table, and the runs that compare scorers on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.operators import baselines, metrics

KEYS = ("station_code", "ts")


def load_features(table: DataFrame, years: tuple[int, ...], columns: tuple[str, ...], tier: int, horizon: int, scorable_only: bool = True) -> DataFrame:
    """Keys, the label's columns and ``columns`` of some years; only what is asked for is read.

    Where the table has a ``year`` column, by which it is partitioned, that
    is what the years are taken by.
    """
    label = (f"y_ge{tier}_{horizon}h", f"y_valid_{horizon}h", f"is_onset_{tier}", f"y_maxdepth_{horizon}h")
    wanted = list(dict.fromkeys([*KEYS, *label, *columns]))
    absent = [c for c in wanted if c not in table.columns]
    if absent:
        raise ValueError(f"the feature table has no column {', '.join(absent)}")
    year = F.col("year") if "year" in table.columns else F.year("ts")
    out = table.where(year.isin(*years))
    if scorable_only:
        out = out.where(F.coalesce(F.col(f"y_valid_{horizon}h"), F.lit(False)))
    return out.select(*wanted)


def feature_set(columns: list[str], kind: str, train_years: tuple[int, ...]) -> list[str]:
    """The inputs a model of a kind may see: no reanalysis, which isn't known in time; forecast rain for the onset model, once archived."""
    archived = 2021
    fcst = kind == "onset" and max(train_years) >= archived
    return [c for c in columns if not c.startswith("era5_") and (fcst or not c.startswith("rain_fcst"))]


def check_features(readings: DataFrame, features: DataFrame, hours: int, column: str, value: str = "flood") -> DataFrame:
    """Rows whose closed trailing maximum, recomputed by an interval join, is another.

    Also tells how many would agree with a window that looks ahead by as
    much: a feature that tracks the future.
    """
    size = hours * 3600 * 1_000_000
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / size).cast("long")
    now = features.select(*KEYS, column, F.explode(F.array(slot("ts") - 1, slot("ts"), slot("ts") + 1)).alias("slot"))
    seen = readings.select("station_code", F.col("ts").alias("seen_ts"), F.col(value).alias("seen"), slot("ts").alias("slot"))
    span = F.expr(f"INTERVAL {hours} HOURS")
    past = (F.col("seen_ts") >= F.col("ts") - span) & (F.col("seen_ts") <= F.col("ts"))
    future = (F.col("seen_ts") > F.col("ts")) & (F.col("seen_ts") <= F.col("ts") + span)
    both = now.join(seen, ["station_code", "slot"], "left").groupBy(*KEYS).agg(
        F.max(column).alias("stored"), F.max(F.when(past, F.col("seen"))).alias("again"), F.max(F.when(future, F.col("seen"))).alias("ahead")
    )
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("stored").eqNullSafe(F.col("again"))).alias("n_disagree"),
        F.count_if((F.col("stored") == F.col("ahead")) & ~F.col("again").eqNullSafe(F.col("ahead"))).alias("n_future"),
    )


def run_baselines(train: DataFrame, tune: DataFrame, test: DataFrame, depth: str, rain: str, min_rows: int = 5) -> DataFrame:
    """One row per scorer: the threshold that is best on ``tune`` and what it does on ``test``.

    Frames hold ``(station_code, ts, y, <depth>, <rain>)``.  A null score is
    no prediction: it is left out when tuning and below every threshold when
    testing.
    """
    table = baselines.climatology(train, "y", min_rows)
    scorers = {
        "persistence": lambda df: baselines.persistence(df, depth),
        "rain_rule": lambda df: baselines.rain_rule(df, rain),
        "climatology": lambda df: baselines.apply_climatology(df, table, train, "y"),
        "always_negative": baselines.always_negative,
    }
    out = []
    for name, scorer in scorers.items():
        best = metrics.best_threshold(scorer(tune)).select("threshold")
        tested = scorer(test).withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))))
        called = tested.crossJoin(F.broadcast(best)).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))  # one row
        out.append(metrics.binary_metrics(called).crossJoin(F.broadcast(best)).withColumn("scorer", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def forecast_value(df: DataFrame, score: str, season: Column, margin: float = 0.005) -> DataFrame:
    """Whether a score tells more than its season: average precision of both, and the verdict.

    The seasonal control scores a row by the mean label of its season.
    """
    known = df.where(F.col(score).isNotNull() & F.col("y").isNotNull()).withColumn("season", season)
    mean = known.groupBy("season").agg(F.avg("y").alias("control"))
    both = known.join(mean, "season")
    one = metrics.average_precision(both, "y", score).withColumnRenamed("average_precision", "ap")
    two = metrics.average_precision(both, "y", "control").withColumnRenamed("average_precision", "ap_season")
    gain = F.col("ap") - F.col("ap_season")
    verdict = F.when(gain > margin, "useful").when(gain < -margin, "worse").otherwise("no difference")
    return one.crossJoin(F.broadcast(two)).withColumns({"gain": F.round(gain, 6), "verdict": verdict})


def by_stratum(scored: DataFrame, profile: DataFrame, low: float = 5.0, high: float = 20.0) -> DataFrame:
    """Metrics by the data quality of the stations: little, some or much missing."""
    share = F.col("null_pct")
    stratum = F.when(share < low, "little missing").when(share > high, "much missing").otherwise("some missing")
    joined = scored.join(profile.select("station_code", stratum.alias("stratum")), "station_code")
    return metrics.binary_metrics(joined, by=("stratum",))


def held_out_stations(rows: DataFrame, share: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows of the stations to learn from, and of one in ``share`` stations, by hash, to test on."""
    held = F.pmod(F.conv(F.substring(F.md5("station_code"), 1, 8), 16, 10).cast("long"), F.lit(share)) == 0
    return rows.where(~held), rows.where(held)


def folds(rows: DataFrame, which: int) -> dict[str, DataFrame]:
    """Training, validation and test rows of one of the rolling-origin folds, embargoed before either boundary."""
    from sluice.operators.labels import embargoed

    fold = C.FOLDS[which]
    of = lambda years: rows.where(F.year("ts").isin(*years))
    return {
        "train": embargoed(of(fold["train"]), f"{fold['val']}-01-01"),
        "val": embargoed(of((fold["val"],)), f"{fold['test']}-01-01"),
        "test": of((fold["test"],)),
    }


def forecast_report(forecast: DataFrame, observed: DataFrame, all_same: float = 0.99, wet_same: float = 0.95, least_wet: int = 100) -> DataFrame:
    """Per year: how often a forecast ``(district, ts, fcst)`` equals what was seen ``(district, ts, seen)``.

    Most hours are dry, so agreement on wet hours is what tells; a forecast
    that agrees too often is the measurement under another name.  A year of
    which next to nothing was forecast is ``empty``.
    """
    both = forecast.join(observed, ["district", "ts"], "full")
    known = F.col("fcst").isNotNull() & F.col("seen").isNotNull()
    same, wet = known & (F.col("fcst") == F.col("seen")), known & ((F.col("fcst") > 0) | (F.col("seen") > 0))
    per = both.groupBy(F.year("ts").alias("year")).agg(
        F.count("*").alias("n"), F.round(F.count("fcst") / F.count("*"), 4).alias("coverage"),
        F.round(F.try_divide(F.count_if(same), F.count_if(known)), 4).alias("identical_all"),
        F.round(F.try_divide(F.count_if(same & wet), F.count_if(wet)), 4).alias("identical_wet"), F.count_if(wet).alias("wet_hours"),
    )
    copied = (F.col("identical_all") > all_same) | ((F.col("wet_hours") > least_wet) & (F.col("identical_wet") > wet_same))
    return per.withColumn("status", F.when(F.col("coverage") < 0.01, "empty").when(copied, "reanalysis").otherwise("usable"))


def guarded(rows: DataFrame, report: DataFrame, ts: str = "ts") -> DataFrame:
    """``rows`` as they are, or an error as soon as one lies in a year that the report doesn't call usable.

    The guard is part of the plan: whatever reads the rows meets it.
    """
    year, status = unused(rows, "year"), unused(rows, "status")
    judged = rows.withColumn(year, F.year(ts)).join(F.broadcast(report.select(F.col("year").alias(year), F.col("status").alias(status))), year, "left")  # a row a year
    said = F.concat(F.lit("no forecast for "), F.col(year).cast("string"), F.lit(": "), F.coalesce(status, F.lit("not in the report")))
    fine = F.when(F.col(status).eqNullSafe("usable"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return judged.where(fine).drop(year, status)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
