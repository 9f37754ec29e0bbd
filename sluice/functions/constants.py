"""Thresholds, windows and folds, in one place."""

CADENCE_MINUTES = 5
STEP_MINUTES = 15
TIERS_CM = (5, 15, 30)
PRIMARY_TIER_CM = 15
PERSISTENCE_READINGS = 2
MERGE_GAP_MINUTES = 60
MIN_EVENT_MINUTES = 10
HORIZONS_HOURS = (1, 3, 6)
MIN_VALID_SHARE = 0.5
EMBARGO_HOURS = 24
OFFLINE_NULL_SHARE = 0.5
WARNING_P95_CM = {1: 30, 3: 26, 6: 24}
COVERAGE_BAND = (0.85, 0.93)
COLD_START_HOURS = 24
POLL_TOLERANCE = 0.8

# Inclusive plausible ranges of the sensors; what lies outside is nulled and counted.
RANGES = {
    "rain": {"rf5min": (0, 60), "rf15min": (0, 60), "rf30min": (0, 100), "rf1hr": (0, 150), "rf3hr": (0, 250), "rf6hr": (0, 300), "rf12hr": (0, 350), "rf24hr": (0, 400)},
    "flood": {"flood": (0, 200)},
    "water": {"wl_in": (-10, 10), "wl_out01": (-10, 10)},
    "flow": {"mean_velocity": (-10, 10)},
}
# Value columns of the raw files, by dataset.
VALUES = {
    "rain": ("rf5min", "rf15min", "rf30min", "rf1hr", "rf3hr", "rf6hr", "rf12hr", "rf24hr"),
    "water": ("wl_in", "wl_out01", "wl_out02"),
    "flow": ("flow", "wl", "area", "mean_velocity"),
    "flood": ("flood",),
}
# Lunar semidiurnal period (hours), synodic month (days), monsoon months.
M2_HOURS, SYNODIC_DAYS, TIDE_EPOCH, MONSOON = 12.4206012, 29.530588, "2019-01-01 00:00:00", (5, 10)
FOLDS = tuple({"train": tuple(range(2019, v)), "val": v, "test": v + 1} for v in (2021, 2022, 2023, 2024))
BBOX = {"lat": (13.4, 14.1), "lon": (100.2, 100.95)}
