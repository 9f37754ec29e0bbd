"""What a board of forecasts shows: tiers by horizons, areas, a map, alert messages, a model card from measured figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.functions.timeutil import minutes_between
from sluice.operators import metrics
from sluice.operators.quantiles import with_quantiles
from sluice.session import written

#: (tier, horizon) at which no model beats the present depth: the alert is the depth alone.
PERSISTENCE_ONLY = ((30, 1), (30, 3))


def _floored(c: str) -> Column:
    return F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c))


def predictions(
    df: DataFrame, thresholds: dict[tuple[int, int], float], tiers=C.TIERS_CM, horizons=C.HORIZONS_HOURS, persistence_only: Iterable[tuple[int, int]] = PERSISTENCE_ONLY,
    now: str = "depth_now", digits: tuple[int, int] = (2, 1),
) -> DataFrame:
    """``df`` with ``horizons``: per horizon the risk and the alert of each tier and the depth quantiles.

    A row brings ``raw{tier}_{h}h`` and ``prob{tier}_{h}h``, the score and
    its calibrated probability, and ``p05_{h}h``, ``p50_{h}h`` and
    ``p95_{h}h``.  An alert is a score that reaches its threshold, or water
    that stands at the tier already; at ``persistence_only`` the latter
    alone.  An unknown depth raises no alert by itself, an unknown score
    none either; the depth itself stays null.  Quantiles aren't below 0.
    """
    alone = set(persistence_only)

    def alert(t: int, h: int) -> Column:
        wet = F.coalesce(F.col(now) >= t, F.lit(False))
        return wet if (t, h) in alone else wet | F.coalesce(F.col(f"raw{t}_{h}h") >= thresholds[t, h], F.lit(False))

    def at(h: int) -> Column:
        risk = F.struct(*(F.round(100 * F.col(f"prob{t}_{h}h"), digits[0]).alias(f"ge{t}") for t in tiers))
        alerts = F.struct(*(alert(t, h).alias(f"ge{t}") for t in tiers))
        depth = F.struct(*(F.round(_floored(f"{q}_{h}h"), digits[1]).alias(q) for q in ("p05", "p50", "p95")))
        return F.struct(F.lit(h).alias("h"), risk.alias("risk"), alerts.alias("alert"), depth.alias("depth"))

    inputs = {f"{k}{t}_{h}h" for k in ("raw", "prob") for t in tiers for h in horizons} | {f"{q}_{h}h" for q in ("p05", "p50", "p95") for h in horizons}
    kept = [c for c in df.columns if c not in inputs]
    return df.select(*kept, F.array(*map(at, sorted(horizons))).alias("horizons"))


def with_kpis(board: DataFrame, tier: int = C.PRIMARY_TIER_CM, deep: tuple[int, ...] = C.TIERS_CM[1:]) -> DataFrame:
    """Peak risk and depth with their horizons (the nearer one of a tie), and the first horizon that warns or gets deep."""

    def peak(value) -> Column:
        known = F.filter("horizons", lambda x: value(x).isNotNull())
        return F.array_max(F.transform(known, lambda x: F.struct(value(x).alias("value"), (-x["h"]).alias("back"))))

    def first(hit) -> Column:
        return F.array_min(F.transform(F.filter("horizons", hit), lambda x: x["h"]))

    def reaches(t: float):
        return lambda x: x["depth"]["p95"] >= t

    risk, depth = peak(lambda x: x["risk"][f"ge{tier}"]), peak(lambda x: x["depth"]["p95"])
    return board.withColumns({
        "peak_risk_pct": risk["value"], "peak_risk_time_h": -risk["back"], "time_to_warning_h": first(lambda x: x["alert"][f"ge{tier}"]),
        "peak_depth_p95": depth["value"], "peak_depth_time_h": -depth["back"], **{f"time_to_{t}_h": first(reaches(t)) for t in deep},
    })


def area(board: DataFrame, by: tuple[str, ...], tier: int = C.PRIMARY_TIER_CM, digits: tuple[int, int] = (2, 1)) -> DataFrame:
    """Per area and horizon: the 95th percentile of its stations' risks, their mean, the deepest P95, who alerts."""
    rows = board.select(*by, F.explode("horizons").alias("x")).select(
        *by, F.col("x.h").alias("horizon_h"), F.col(f"x.risk.ge{tier}").alias("risk"), F.col(f"x.alert.ge{tier}").alias("alert"), F.col("x.depth.p95").alias("p95")
    )
    keys = (*by, "horizon_h")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("n_stations"), F.round(F.avg("risk"), digits[0]).alias("risk_pct_mean"), F.round(F.max("p95"), digits[1]).alias("depth_p95_max"),
        F.count_if("alert").alias("stations_alerting"),
    )
    return with_quantiles(counts, rows, "risk", {"risk_pct_p95": 0.95}, keys, digits[0])


def map_features(board: DataFrame) -> DataFrame:
    """``value``: a GeoJSON feature a row with coordinates; rows without go.  ``df.write.text`` makes files of a feature a line."""
    properties = F.struct(*(c for c in board.columns if c not in ("lat", "lon")))
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))
    return board.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.to_json(feature).alias("value"))


# -- alert messages -------------------------------------------------------
# Severity, certainty and advised response by level, and the level's public name by language.
LEVELS = {
    "watch": ("Minor", "Possible", "Monitor"),
    "advisory": ("Moderate", "Likely", "Prepare"),
    "warning": ("Severe", "Likely", "Avoid"),
    "critical": ("Severe", "Observed", "Avoid"),
}
NAMES = {
    "th-TH": {"watch": "เฝ้าระวัง", "advisory": "แจ้งเตือน", "warning": "เตือนภัย", "critical": "เตือนภัย"},
    "en-US": {"watch": "Watch", "advisory": "Advisory", "warning": "Warning", "critical": "Critical"},
}
EXTREME_CM, EXPIRES_HOURS = 50, 3
CAP = (
    "identifier string, sender string, sent timestamp_ntz, status string, msgType string, scope string, "
    "info array<struct<language:string,category:array<string>,event:string,responseType:string,urgency:string,severity:string,certainty:string,"
    "onset:timestamp_ntz,expires:timestamp_ntz,headline:string,area:struct<areaDesc:string>>>"
)


def _choose(key: Column, options: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in options.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def cap_messages(df: DataFrame, sender: str, status: str = "Test", scope: str = "Restricted", extreme: float = EXTREME_CM) -> DataFrame:
    """A message per row of ``(station_code, district, ts, level, horizon_h, depth_now)``, an info block a language.

    Urgency follows the horizon, but observed water is at once; the onset
    is the time the horizon points to, three hours later the message
    expires.  Status and scope are settings, never data.
    """
    level, h = F.col("level"), F.col("horizon_h")
    seen = level == "critical"
    far = F.coalesce(seen & (F.col("depth_now") >= extreme), F.lit(False))
    urgency = F.when(seen | (h <= 1), "Immediate").when((level == "watch") & (h >= 6), "Future").otherwise("Expected")
    severity = F.when(far, "Extreme").otherwise(_choose(level, {k: v[0] for k, v in LEVELS.items()}))
    response = F.when(far, "Execute").otherwise(_choose(level, {k: v[2] for k, v in LEVELS.items()}))
    onset = F.when(seen, F.col("ts")).otherwise(F.col("ts") + F.make_dt_interval(hours=h.cast("int")))

    def info(language: str) -> Column:
        return F.struct(
            F.lit(language).alias("language"), F.array(F.lit("Met"), F.lit("Geo")).alias("category"), F.lit("Road flooding").alias("event"), response.alias("responseType"),
            urgency.alias("urgency"), severity.alias("severity"), _choose(level, {k: v[1] for k, v in LEVELS.items()}).alias("certainty"), onset.alias("onset"),
            (onset + F.expr(f"INTERVAL {EXPIRES_HOURS} HOURS")).alias("expires"), F.concat_ws(" ", _choose(level, NAMES[language]), "station_code").alias("headline"),
            F.struct(F.col("district").alias("areaDesc")).alias("area"),
        )

    identifier = F.concat_ws("-", F.lit("alert"), "station_code", F.date_format("ts", "yyyyMMdd'T'HHmm"), h.cast("string"))
    return df.select(
        identifier.alias("identifier"), F.lit(sender).alias("sender"), F.col("ts").alias("sent"), F.lit(status).alias("status"), F.lit("Alert").alias("msgType"),
        F.lit(scope).alias("scope"), F.array(*map(info, NAMES)).alias("info"),
    )


def write_cap(messages: DataFrame, path: str) -> None:
    """Messages as XML files, an ``alert`` element each."""
    messages.write.format("xml").option("rootTag", "alerts").option("rowTag", "alert").save(path)


def read_cap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").schema(CAP).option("rowTag", "alert").load(path)


# -- model card -----------------------------------------------------------
def model_card(scored: DataFrame, hits: DataFrame, gap: int = C.MERGE_GAP_MINUTES, step: int = C.STEP_MINUTES) -> DataFrame:
    """One row: what the alerts of ``scored(station_code, ts, y, pred, is_onset)`` are worth, measured, and its caveats in words.

    ``hits`` are its events, as ``metrics.event_hits`` tells them.  An alert
    episode is a run of alerts at most ``gap`` minutes apart.
    """
    scored, hits = written(scored.select("station_code", "ts", "y", "pred", "is_onset"), "card"), written(hits, "card-hits")
    w = Window.partitionBy("station_code").orderBy("ts")
    alerts = scored.where("pred = 1").withColumn("was", F.lag("ts").over(w))
    episodes = alerts.agg(F.count_if(F.col("was").isNull() | (minutes_between("was", "ts") > gap)).alias("n_episodes"))
    onset = metrics.binary_metrics(scored.where("is_onset")).select(F.col("recall").alias("recall_on_dry"))
    overall = metrics.binary_metrics(scored).select("precision", "recall", "far")
    one_step = hits.where("hit").agg(F.round(F.avg((F.col("lead_minutes") <= step).cast("int")), 6).alias("one_step_share"))
    out = metrics.event_pod(hits)
    for one in (overall, onset, episodes, one_step):
        out = out.join(F.broadcast(one), how="left")  # one row each
    out = out.withColumn("episodes_per_flood_warned", F.round(F.try_divide("n_episodes", "n_detected"), 6))
    said = {"far": "%d %% of the alerts do not become floods.", "pod": "%d %% of the floods are warned of.", "one_step_share": "%d %% of the warnings come one step ahead or later."}
    caveats = F.array(*(F.when(F.col(c).isNotNull(), F.format_string(text, F.round(100 * F.col(c)).cast("int"))) for c, text in said.items()))
    return out.withColumn("caveats", F.array_compact(caveats))
