"""Whole jobs a user calls, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylog.operators.joins import merge_gps, merge_slow
from skylog.operators.scan import saved
from skylog.operators.stats import charge
from skylog.operators.units import convert_units, gps_display, name_slow_flags


def export_log(
    frames: DataFrame, slow: DataFrame | None, gps: DataFrame | None, config: DataFrame, units: dict[str, str] | None = None
) -> DataFrame:
    """The merged export of a log: chosen units, consumed charge, named slow flags and GPS data.

    Charge, slow and GPS frames are merged on the few columns that this takes, and written as such; the whole
    frames are joined once, by the place of the main frame that a row shows.
    """
    rows = charge(frames, config)
    if slow is not None:
        rows = merge_slow(rows, slow)
    rows = saved(rows.withColumn("_main", F.col("seq")))
    if gps is not None:
        rows = merge_gps(rows, gps)
    added = [c for c in rows.columns if c not in ("log_id", "seq", "time", "_main")]
    whole = frames.drop("time").withColumnRenamed("seq", "_main")
    rows = rows.join(whole, ["log_id", "_main"]).select(*frames.columns, *added)
    if gps is None:
        return name_slow_flags(convert_units(rows, config, units))
    rows = gps_display(rows.withColumn("GPS_speed", F.col("GPS_speed").cast("double")))
    # speeds are metres a second by now
    shown = convert_units(rows.withColumnRenamed("GPS_speed", "_speed"), config, units)
    return name_slow_flags(shown.withColumnRenamed("_speed", "GPS_speed"))
