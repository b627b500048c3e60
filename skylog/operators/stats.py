"""Aggregates over frame tables: limits, rates, counts and readings, by log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylog.functions import adc_to_milliamps, int_div, scheduled_before
from skylog.schema import CHANNEL, MAIN_COLUMNS, present

from .scan import beside, running_sums
from .units import by_place, pid_error, stream


def field_limits(frames: DataFrame) -> DataFrame:
    """min, max and range of each field: aggregated wide, then unpivoted. Fields without values give no row."""
    fields = present(frames, MAIN_COLUMNS)
    wide = frames.groupBy("log_id").agg(*(f(c).alias(f"{p}{c}") for c in fields for p, f in (("lo_", F.min), ("hi_", F.max))))
    parts = ", ".join(f"'{CHANNEL[c]}', cast(`lo_{c}` as long), cast(`hi_{c}` as long)" for c in fields)
    return wide.select(
        "log_id", F.expr(f"stack({len(fields)}, {parts}) as (channel, min, max)")
    ).where("min is not null").withColumn("range", F.col("max") - F.col("min"))


def frame_stats(frame_index: DataFrame) -> DataFrame:
    """Valid, desynchronised and corrupt frames, bytes of valid ones and their mean, by frame type."""
    valid = F.col("status") == "valid"
    out = frame_index.groupBy("log_id", "frame_type").agg(
        F.count_if(valid).alias("valid"), F.count_if(F.col("status") == "desync").alias("desync"), F.count_if(F.col("status") == "corrupt").alias("corrupt"),
        F.coalesce(F.sum(F.when(valid, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"),
    )
    return out.withColumn("mean_bytes", F.when(F.col("valid") > 0, F.col("bytes") / F.col("valid")))


def looptime_stats(frames: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and their percentage of the time per iteration, where the iteration advanced."""
    w = stream()
    step, gone = F.col("loopIteration") - F.lag("loopIteration").over(w), F.col("time") - F.lag("time").over(w)
    loops = frames.select("log_id", "seq", "loopIteration", "time").select(
        "log_id", step.alias("step"), gone.alias("gone")
    ).where("step > 0")
    out = loops.groupBy("log_id").agg(
        F.avg(int_div(F.col("gone"), F.col("step"))).alias("mean_us"),
        F.stddev_samp(int_div(F.col("gone"), F.col("step"))).alias("stddev_us")
    )
    return out.withColumn("stddev_pct", F.when(F.col("mean_us") != 0, F.col("stddev_us") / F.col("mean_us") * 100))


def _main(frame_index: DataFrame, frames: DataFrame) -> DataFrame:
    span = frames.groupBy("log_id").agg(
        F.min("time").alias("start_us"), F.max("time").alias("end_us"), F.min("loopIteration").alias("first"),
        F.max("loopIteration").alias("last")
    )
    good = (F.col("status") == "valid") & F.col("frame_type").isin("I", "P")
    sizes = frame_index.groupBy("log_id").agg(F.count_if(good).alias("good"), F.sum("size_bytes").alias("total_bytes"))
    return span.join(sizes, "log_id").withColumn("interval_ms", int_div(F.col("end_us") - F.col("start_us"), F.lit(1000)))


def data_rate(frame_index: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames per second, bytes per second, and baud rounded up to 100; null without a duration."""
    ms, total = F.col("interval_ms"), F.col("total_bytes")
    baud = int_div(int_div(total * 10000, ms) + 99, F.lit(100)) * 100
    return _main(frame_index, frames).select(
        "log_id", int_div(F.col("good") * 1000, ms).alias("rate_hz"), int_div(total * 1000, ms).alias("bytes_per_s"),
        baud.alias("baud")
    )


def absent_iterations(frames: DataFrame, config: DataFrame) -> DataFrame:
    """Adds ``absent``: iterations since the frame before that the sampling schedule left out on purpose.

    They are counted by whole intervals of the schedule and a rest, so that a long gap, or a counter that is
    corrupt, costs no more. Settings that name no schedule leave nothing out.
    """
    narrow = frames.select("log_id", "seq", "loopIteration")
    rows = narrow.join(
        config.select("log_id", F.col("frame_interval_i").alias("_i"), F.col("p_num").alias("_num"), F.col("p_denom").alias("_denom")),
        "log_id", "left"
    )
    rows = rows.withColumn("_before", F.lag("loopIteration").over(stream()))
    before, now = F.col("_before"), F.col("loopIteration")
    count = lambda i: scheduled_before(i, F.col("_i"), F.col("_num"), F.col("_denom"))
    absent = F.when(now - before > 1, now - before - 1 - (count(now) - count(before + 1)))
    counted = rows.select("log_id", "seq", F.coalesce(absent, F.lit(0)).cast("long").alias("absent"))
    return by_place(frames, counted)


def missing_frames(frames: DataFrame, frame_index: DataFrame, config: DataFrame) -> DataFrame:
    """Iterations that are neither recorded nor left out on purpose, as a number, in ms and in percent."""
    absent = absent_iterations(
        frames.select("log_id", "seq", "loopIteration"), config
    ).groupBy("log_id").agg(F.sum("absent").alias("absent"))
    out = _main(frame_index, frames).join(absent, "log_id").withColumn("total", F.col("last") - F.col("first") + 1)
    out = out.withColumn("missing", F.greatest(F.col("total") - F.col("good") - F.col("absent"), F.lit(0)))
    ms = lambda c: int_div(F.col(c) * F.col("interval_ms"), F.col("total"))
    return out.select(
        "log_id", "total", "missing", ms("missing").alias("missing_ms"),
        (F.col("missing") / F.col("total") * 100).alias("missing_pct"), "absent", ms("absent").alias("absent_ms")
    )


def log_summary(frames: DataFrame, events: DataFrame, gps: DataFrame, slow: DataFrame, config: DataFrame) -> DataFrame:
    """One row per log: counts of each kind of frame, start, end and duration, and its settings of intervals."""
    count = lambda df, name: df.groupBy("log_id").agg(F.count("*").alias(name))
    out = frames.groupBy("log_id").agg(F.count("*").alias("n_frames"), F.min("time").alias("start_us"), F.max("time").alias("end_us"))
    for df, name in ((events, "n_events"), (gps, "n_gps"), (slow, "n_slow")):
        out = out.join(count(df, name), "log_id", "left")
    settings = config.select("log_id", "fc_version", "frame_interval_i", "p_num", "p_denom")
    return out.join(settings, "log_id", "left").withColumn(
        "duration_us", F.col("end_us") - F.col("start_us")
    ).fillna(0, ["n_events", "n_gps", "n_slow"])


def decode_report(frames: DataFrame, frame_index: DataFrame, config: DataFrame) -> DataFrame:
    """Looptime, data rate and missing iterations of each log in one row, with the valid frames of each type."""
    by_type = frame_stats(frame_index).groupBy("log_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_type", "valid")))).alias("valid"),
        F.sum("corrupt").alias("corrupt")
    )
    return looptime_stats(frames).join(data_rate(frame_index, frames), "log_id").join(
        missing_frames(frames, frame_index, config), "log_id"
    ).join(by_type, "log_id")


def throttle_bin(throttle):
    """Bin 0..19 of a throttle from 0 to 1: how many of the 19 inner edges it reaches, compared as doubles."""
    return F.aggregate(F.array(*[F.lit(k * 0.05) for k in range(1, 20)]), F.lit(0), lambda n, edge: n + (edge <= throttle).cast("int"))


def error_sums(display: DataFrame) -> DataFrame:
    """(log_id, axis, bin, n, squares, absolute) of the tracking error: one pass serves rms and throttle bins.

    bin is null for rows whose throttle is outside of 0 to 1, or absent.
    """
    throttle = (F.col("rcCommand_3") - 1000.0) / 1000.0
    errors = pid_error(display)
    place = F.when(throttle.between(0, 1), throttle_bin(throttle)) if "rcCommand_3" in errors.columns else F.lit(None).cast("int")
    rows = errors.select("log_id", "axis", place.alias("bin"), "error")
    return rows.groupBy("log_id", "axis", "bin").agg(
        F.count("*").alias("n"), F.sum(F.col("error") * F.col("error")).alias("squares"),
        F.sum(F.abs("error")).alias("absolute")
    )


def _rms(sums: DataFrame) -> DataFrame:
    return sums.groupBy("log_id", "axis").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"))


def pid_rms(display: DataFrame) -> DataFrame:
    """Root mean square of the tracking error by axis."""
    return _rms(error_sums(display))


def _by_throttle(sums: DataFrame) -> DataFrame:
    means = sums.where("bin is not null").select("log_id", "axis", "bin", (F.col("absolute") / F.col("n")).alias("mean_abs_error"))
    bins = sums.select("log_id", "axis").distinct().select("log_id", "axis", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("bin"))
    return bins.join(means, ["log_id", "axis", "bin"], "left").select(
        "log_id", "axis", "bin", ((F.col("bin") * 0.05 + (F.col("bin") + 1) * 0.05) / 2).alias("throttle"), "mean_abs_error"
    )


def error_vs_throttle(display: DataFrame) -> DataFrame:
    """Mean absolute tracking error in 20 throttle bins by log and axis; bins without rows are null, none is left out."""
    return _by_throttle(error_sums(display))


def error_profile(display: DataFrame) -> DataFrame:
    """(log_id, axis, rms, error_by_throttle): both, from one pass over the frames."""
    sums = error_sums(display)
    bins = _by_throttle(sums).groupBy("log_id", "axis").agg(F.array_sort(F.collect_list(F.struct("bin", "mean_abs_error"))).alias("_b"))
    return _rms(sums).join(bins, ["log_id", "axis"]).select("log_id", "axis", "rms", F.col("_b.mean_abs_error").alias("error_by_throttle"))


def throttle_slope(evt: DataFrame) -> DataFrame:
    """Slope of a line through the bin means; axes with fewer than 4 filled bins give no row."""
    filled = evt.where("mean_abs_error is not null").groupBy("log_id", "axis").agg(
        F.regr_slope("mean_abs_error", "throttle").alias("slope"), F.count("*").alias("n")
    )
    return filled.where("n >= 4").select("log_id", "axis", "slope")


def exact_medians(rows: DataFrame, keys: tuple[str, ...], value: str, name: str = "median") -> DataFrame:
    """The median of a column for each key that has values, equal to that of all of them at once; nulls are passed over.

    Equal values are counted where they are read, the counts are added up in blocks of value, and only the block that
    holds the middle is put in order: neither a key's values nor its distinct values meet in one task.
    """
    own = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    # as many blocks as a power of two tells apart: by size first, for values far from the others
    magnitude = F.when(F.col("_v") == 0, 0).otherwise(F.floor(F.log2(F.abs("_v").cast("double")) * 64) + (1 << 17))
    own = own.withColumn("_block", F.when(F.col("_v") < 0, -magnitude).otherwise(magnitude).cast("long"))
    over = Window.partitionBy(*keys)
    blocks = own.groupBy(*keys, "_block").agg(F.sum("_n").alias("_m"))
    to = F.sum("_m").over(over.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumns({"_to": to, "_all": F.sum("_m").over(over)})
    # the middle rows are the ones at (all - 1) div 2 and all div 2, from 0
    holds = lambda n: (F.col("_to") > F.expr("(_all - 1) div 2")) & (F.col("_to") - F.col(n) <= F.expr("_all div 2"))
    middle = own.join(blocks.where(holds("_m")).select(*keys, "_block", (F.col("_to") - F.col("_m")).alias("_before"), "_all"), [*keys, "_block"])
    inside = Window.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = middle.withColumn("_to", F.col("_before") + F.sum("_n").over(inside)).where(holds("_n"))
    return found.groupBy(*keys).agg(F.avg("_v").alias(name))


def estimate_sample_rate(frames: DataFrame, exact: bool = True) -> DataFrame:
    """Rows per second: 1 over the median positive time step; 0 for logs without one."""
    narrow = beside(frames.select("log_id", "seq", "time"), ["time"], previous="_previous")
    step = F.col("time") - F.col("_previous.time")
    steps = narrow.select("log_id", F.when(step > 0, step).alias("dt"))
    logs = steps.groupBy("log_id")
    if exact:
        middles = logs.agg(F.lit(0).alias("_")).join(exact_medians(steps, ("log_id",), "dt"), "log_id", "left")
    else:
        middles = logs.agg(F.percentile_approx("dt", 0.5, 10000).alias("median"))
    return middles.select("log_id", F.coalesce(1e6 / F.col("median"), F.lit(0.0)).alias("sample_rate"))


def motor_frequency(frames: DataFrame, pole_pairs: int = 7, harmonics: int = 3) -> DataFrame:
    """Median over motors of each one's median positive rotation, in Hz, and its harmonics; logs without any are null."""
    motors = present(frames, [f"eRPM_{i}" for i in range(8)])
    stacked = ", ".join(f"'{c}', cast({c} as long)" for c in motors)
    turns = frames.selectExpr("log_id", f"stack({len(motors)}, {stacked}) as (motor, turns)").where("turns > 0")
    each = exact_medians(turns, ("log_id", "motor"), "turns").withColumn("hz", F.col("median") * 100.0 / pole_pairs / 60.0)
    one = each.groupBy("log_id").agg(F.median("hz").alias("motor_hz"))
    one = frames.select("log_id").distinct().join(one, "log_id", "left")
    return one.withColumn(
        "harmonics",
        F.when(F.col("motor_hz").isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda k: k * F.col("motor_hz")))
    )


def motor_peak(frames: DataFrame, config: DataFrame) -> DataFrame:
    """Highest output of the first four motors (0 at least) and its share of the log's limit."""
    peak = frames.groupBy("log_id").agg(
        F.greatest(F.lit(0), *(F.max(c) for c in present(frames, [f"motor_{i}" for i in range(4)]))).cast("double").alias("motor_max")
    )
    limit = F.col("motor_output_high")
    return peak.join(
        config.select("log_id", "motor_output_high"), "log_id"
    ).withColumn("share", F.when(limit > 0, F.col("motor_max") / limit))


def charge(frames: DataFrame, config: DataFrame) -> DataFrame:
    """(log_id, seq, time, energy_mah): the running integral of the current, each sample counted from the frame before it on."""
    narrow = frames.select("log_id", "seq", "time", "amperageLatest")
    rows = narrow.join(
        config.select("log_id", F.col("current_meter_offset").alias("_offset"), F.col("current_meter_scale").alias("_scale")),
        "log_id", "left"
    )
    current = adc_to_milliamps(F.col("amperageLatest"), F.col("_offset"), F.col("_scale"))
    rows = beside(rows, ["time"], previous="_previous")
    # whole milliampere-microseconds add up exactly, in blocks as in one piece
    total = running_sums(rows, {"_charge": current * (F.col("time") - F.col("_previous.time"))})
    return total.select("log_id", "seq", "time", F.rint(F.col("_charge") / 3.6e9).cast("long").alias("energy_mah"))


def energy_cumulative(frames: DataFrame, config: DataFrame) -> DataFrame:
    """Adds energy_mah to the frames, see ``charge``."""
    return by_place(frames, charge(frames, config).drop("time"))
