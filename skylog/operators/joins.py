"""As-of joins in stream order, by a union of narrow columns and a scan by blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylog.schema import GPS_COLUMNS, SLOW_COLUMNS, present

from .scan import BLOCK, beside, last_seen
from .units import by_place


def _asof(left: DataFrame, right: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Left rows with the columns of the latest right row before them in their log; null before the first.

    Places and the right columns alone are scanned, block by block: a block without right rows gets the last one
    of the blocks before it. What is found is joined to the left rows by place.
    """
    value = F.struct(*columns)
    none = F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType)
    both = left.select("log_id", "seq", none.alias("_of"), F.lit(True).alias("_left")).unionByName(
        right.select("log_id", "seq", value.alias("_of"), F.lit(False).alias("_left"))
    )
    found = last_seen(both, ["_of"], ["seq", "_left"], block=block).where("_left").drop("_left")
    return by_place(left, found).select(*left.columns, *(F.col(f"_of.{c}").alias(c) for c in columns))


def merge_slow(frames: DataFrame, slow: DataFrame) -> DataFrame:
    """Main frames with the latest slow frame before them; zeros before the first one."""
    columns = present(slow, SLOW_COLUMNS)
    return _asof(frames, slow, columns).fillna(0, columns)


def merge_gps(frames: DataFrame, gps: DataFrame) -> DataFrame:
    """Main frames with GPS data of their time. A GPS frame right after a main frame and of its time joins it;
    one of another time gives a row of its own, which repeats the main frame before it at the GPS time.
    GPS frames before the first main frame give no row.
    """
    columns, fields = present(gps, GPS_COLUMNS), [c for c in frames.columns if c not in ("log_id", "seq")]
    data = F.struct("time", *columns)
    none = F.lit(None).cast(gps.select(data.alias("x")).schema["x"].dataType)
    both = frames.select("log_id", "seq", F.col("seq").alias("_main"), "time", none.alias("_gps")).unionByName(
        gps.select("log_id", "seq", F.lit(None).cast("long").alias("_main"), "time", data.alias("_gps"))
    )
    rows = last_seen(both.withColumn("_before", F.col("_main")), ["_before"])
    rows = beside(rows, ["_main", "time", "_gps"], previous="_previous", following="_after")
    is_main = F.col("_main").isNotNull()
    attached = F.when(is_main & (F.col("_after._gps.time") == F.col("time")), F.col("_after._gps"))
    # the main frame that a GPS frame of its time comes right after has taken it
    taken = F.col("_previous._main").isNotNull() & (F.col("_previous.time") == F.col("time"))
    own = ~is_main & F.col("_before").isNotNull() & ~F.coalesce(taken, F.lit(False))
    rows = rows.where(is_main | own).select(
        "log_id", F.col("seq").alias("_seq"), F.col("_before").alias("seq"), F.col("time").alias("_time"),
        F.when(is_main, attached).otherwise(F.col("_gps")).alias("_data")
    )
    out = rows.join(frames, ["log_id", "seq"])
    return out.select(
        "log_id", F.col("_seq").alias("seq"), *(F.col("_time").alias(c) if c == "time" else F.col(c) for c in fields),
        *(F.col(f"_data.{c}").alias(c) for c in columns)
    )
