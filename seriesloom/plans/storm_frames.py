"""The 14-column feature frame, from the hourly archive and from the live feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom._common import interval, names
from seriesloom.config import QUIET_KP, RECURRENCE, STORM_FEATURES, STORM_LAGS
from seriesloom.functions.domain import coupling, equinox_term, ram_pressure, southward_field
from seriesloom.operators.asof import asof_nearest
from seriesloom.operators.resample import resample
from seriesloom.operators.windows import lags, lags_filled

BUCKET = "3 hours"
MEANS = {"speed": "speed_mean", "density": "density_mean", "by_gsm": "by_mean", "bt": "bt_mean"}


def bucket_means(df: DataFrame, keys: str | Sequence[str], time: str, kp: str | None = None) -> DataFrame:
    """3-hour means, with the minimum of ``bz`` as well; incomplete buckets are dropped."""
    aggs = [F.avg(c).alias(n) for c, n in MEANS.items()]
    aggs += [F.avg("bz_gsm").alias("bz_mean"), F.min("bz_gsm").alias("bz_min")]
    if kp:
        aggs.append(F.avg(kp).alias("Kp"))
    return resample(df, time, BUCKET, aggs, keys).na.drop("any")


def with_physics(df: DataFrame, time: str) -> DataFrame:
    """Coupling (of the bucket means), ram pressure, southward field and season."""
    return df.withColumns(
        {
            "coupling_mean": coupling("speed_mean", "bt_mean", "by_mean", "bz_mean"),
            "p_dyn_mean": ram_pressure("density_mean", "speed_mean"),
            "vbs": southward_field("speed_mean", "bz_mean"),
            "equinox_term": equinox_term(time),
        }
    )


def archive_frame(hourly: DataFrame, keys: str | Sequence[str], time: str = "time_tag") -> DataFrame:
    """Training frame: features and ``Kp``. Lags count rows, so a dropped bucket shifts them."""
    return frame_of_means(bucket_means(hourly, keys, time, "kp"), keys, time)


def frame_of_means(means: DataFrame, keys: str | Sequence[str], time: str = "time_tag") -> DataFrame:
    """The training frame from the 3-hour means of the archive."""
    keys = names(keys)
    frame = with_physics(means, time)
    frame = lags(frame, {n: ("Kp", k) for n, k in STORM_LAGS.items()}, keys, time)
    return frame.select(*keys, time, *STORM_FEATURES, "Kp").na.drop("any")


def live_frame(
    plasma: DataFrame,
    mag: DataFrame,
    kp: DataFrame | None,
    history: DataFrame | None,
    keys: str | Sequence[str],
    time: str = "time_tag",
) -> DataFrame:
    """Inference frame from the live feeds.

    ``kp`` gives the short lags and ``history`` (``Kp`` of the archive) the 27-day one; where
    either is missing or has no value, the quiet default stands in.
    """
    keys = names(keys)
    wanted = ["speed", "density", "by_gsm", "bz_gsm", "bt"]
    both = plasma.select(*keys, time, "speed", "density").join(
        mag.select(*keys, time, "by_gsm", "bz_gsm", "bt"), [*keys, time]
    )
    both = both.na.drop("any", subset=wanted)
    frame = with_physics(bucket_means(both, keys, time), time)

    short = {n: k for n, k in STORM_LAGS.items() if n != "kp_lag_27d"}
    if kp is None:
        frame = frame.withColumns({n: F.lit(QUIET_KP) for n in short})
    else:
        on_grid = resample(kp, time, BUCKET, [F.avg("Kp").alias("Kp")], keys)
        frame = frame.join(on_grid, [*keys, time], "left")
        frame = lags_filled(frame, "Kp", short, keys, time, QUIET_KP).drop("Kp")

    if history is None:
        frame = frame.withColumn("kp_lag_27d", F.lit(QUIET_KP))
    else:
        probe = frame.withColumn("_earlier", F.col(time) - interval(RECURRENCE))
        past = history.select(*keys, F.col(time).alias("_at"), "Kp")
        found = asof_nearest(probe, past, "_earlier", "_at", "Kp", "_found", keys, "3 hours")
        frame = found.withColumn("kp_lag_27d", F.coalesce("_found", F.lit(QUIET_KP)))
    return frame.select(*keys, time, *STORM_FEATURES)
