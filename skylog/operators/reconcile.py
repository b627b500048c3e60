"""Row-by-row reconciliation of a frame table with a golden one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .units import stream

#: Unit scalings tried for each column; the first that fits best is reported.
SCALINGS = {"raw": 1.0, "x0.01": 0.01, "x0.1": 0.1, "x10": 10.0, "x100": 100.0}


def reconcile(ours: DataFrame, golden: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """(log_id, row, time, column, ours, golden) for each pair of rows.

    Rows meet by their number in the log, or by a key column. Pairs without any value are left out.
    """
    number = F.col(key) if key else F.row_number().over(stream()) - 1
    a = ours.select("log_id", number.alias("row"), "time", *(F.col(c).cast("double").alias(c) for c in columns))
    b = golden.select("log_id", number.alias("row"), *(F.col(c).cast("double").alias(f"g_{c}") for c in columns))
    parts = ", ".join(f"'{c}', {c}, g_{c}" for c in columns)
    long = a.join(b, ["log_id", "row"]).select("log_id", "row", "time", F.expr(f"stack({len(columns)}, {parts}) as (column, ours, golden)"))
    return long.where("ours is not null or golden is not null")


def _compared(factor: float | Column, tolerance: float) -> tuple[Column, Column]:
    """Difference of a pair under a scaling, and whether it is a mismatch; a value without a partner's is one."""
    diff = F.abs(F.col("ours") * factor - F.col("golden"))
    return diff, F.coalesce(diff > tolerance, F.lit(True))


def reconcile_summary(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """For each log and column: its best scaling, mismatches, largest difference, first mismatching row, and when they lie.

    All scalings are judged in one pass of conditional aggregates.
    """
    judged = []
    for k, factor in enumerate(SCALINGS.values()):
        diff, bad = _compared(factor, tolerance)
        judged += [
            F.count_if(bad).alias(f"n{k}"), F.max(diff).alias(f"d{k}"), F.min(F.when(bad, F.col("row"))).alias(f"r{k}"),
            F.min(F.when(bad, F.col("time"))).alias(f"a{k}"), F.max(F.when(bad, F.col("time"))).alias(f"z{k}")
        ]
    options = F.array(
        *[
            F.struct(
                F.col(f"n{k}").alias("mismatches"), F.lit(k).alias("k"), F.lit(name).alias("scaling"),
                F.col(f"d{k}").alias("max_diff"), F.col(f"r{k}").alias("first_row"), F.col(f"a{k}").alias("first_time"),
                F.col(f"z{k}").alias("last_time")
            ) for k,
            name in enumerate(SCALINGS)
        ]
    )
    best = pairs.groupBy("log_id", "column").agg(*judged).select("log_id", "column", F.array_min(options).alias("b"))
    best = best.select(
        "log_id", "column", *(f"b.{c}" for c in ("scaling", "mismatches", "max_diff", "first_row", "first_time", "last_time"))
    )
    all_ok = F.min((F.col("mismatches") == 0)).over(Window.partitionBy("log_id"))
    return best.withColumns({"ok": F.col("mismatches") == 0, "all_ok": all_ok})


def mismatch_context(
    pairs: DataFrame, summary: DataFrame, frames: DataFrame, config: DataFrame, k: int = 3, tolerance: float = 0.01
) -> DataFrame:
    """Rows up to k before and after each column's first mismatch, with I or P by the loop iteration."""
    first = summary.where("first_row is not null").select(
        "log_id", "column", "scaling", "first_row",
        F.explode(F.sequence(F.col("first_row") - k, F.col("first_row") + k)).alias("row")
    )
    rows = frames.select("log_id", (F.row_number().over(stream()) - 1).alias("row"), "loopIteration")
    kind = F.when(F.col("loopIteration") % F.col("frame_interval_i") == 0, "I").otherwise("P")
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in SCALINGS.items() for x in kv]), F.col("scaling"))
    near = first.join(pairs, ["log_id", "column", "row"]).join(rows, ["log_id", "row"]).join(
        config.select("log_id", "frame_interval_i"), "log_id"
    )
    return near.select(
        "log_id", "column", "scaling", "first_row", "row", kind.alias("kind"), "ours", "golden",
        _compared(factor, tolerance)[1].alias("bad")
    )
