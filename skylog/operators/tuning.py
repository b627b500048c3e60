"""Tuning advice: rules over spectra, errors and outputs, with settings commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylog.functions import adjust
from skylog.schema import AXES

from .series import NOISE_BAND, PROPWASH_BAND, band_energies, welch
from .stats import error_vs_throttle, estimate_sample_rate, motor_peak, throttle_slope
from .units import to_display_units, with_t_sec

#: Findings are ranked by severity and, within it, by rule.
SEVERITIES = {"high": 0, "medium": 1, "low": 2, "info": 3}


def _gain(axis: Column, term: int) -> Column:
    """The axis's P (1), I (2) or D (3) gain."""
    out = F.try_element_at("pid_yaw", F.lit(term))
    for a in AXES[:2]:
        out = F.when(axis == a, F.try_element_at(f"pid_{a}", F.lit(term))).otherwise(out)
    return out


def _set(name: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit("set "), name, F.lit(" = "), value.cast("string")))


def _either(first: Column, second: Column) -> Column:
    """The first value unless it is null or 0, else the second unless it is."""
    return F.coalesce(F.nullif(first, F.lit(0)), F.nullif(second, F.lit(0)))


def _finding(
    rule: int, category: str, severity: Column, title: Column, detail: Column, action: str, commands: list[Column],
    axis: Column | None = None
) -> Column:
    return F.struct(
        (
            axis if axis is not None else F.col("axis")
        ).alias("axis"), F.lit(category).alias("category"), severity.alias("severity"), title.alias("title"),
        detail.alias("detail"), F.lit(action).alias("action"), F.filter(
            F.array(*commands), lambda c: c.isNotNull()
        ).alias("cli"), F.lit(rule).alias("rule_no"),
    )


def _found(rows: DataFrame, finding: Column) -> DataFrame:
    return rows.select("log_id", finding.alias("f")).where("f is not null").select("log_id", "f.*")


def _percent(ratio: str) -> Column:
    return F.format_string("%.0f", F.rint(F.col(ratio) * 100))


def _propwash() -> Column:
    axis = F.col("axis")
    detail = F.concat(
        F.lit("tracking error between 30 and 90 Hz: "), _percent("propwash_ratio"), F.lit(" % of its energy, peak near "),
        F.format_string("%.0f", F.coalesce("peak_hz", F.lit(0.0))), F.lit(" Hz")
    )
    commands = [
        _set(F.concat(F.lit("d_"), axis), adjust(_gain(axis, 3), 12)),
        _set(F.concat(F.lit("p_"), axis), adjust(_gain(axis, 1), -8))
    ]
    found = _finding(
        1, "propwash", F.when(F.col("propwash_ratio") > 0.35, "high").otherwise("medium"),
        F.concat(axis, F.lit(": propwash oscillation")), detail, "Raise D by about 12 %, or lower P a little.", commands
    )
    return F.when((F.col("propwash_ratio") >= 0.20) & (F.col("rms") >= 10), found)


def _gyro_hf() -> Column:
    second, first = F.col("gyro_lpf2_static_hz"), F.col("gyro_lpf1_static_hz")
    command = F.when(
        second > 0, _set(F.lit("gyro_lpf2_static_hz"), adjust(second, -20))
    ).when(first > 0, _set(F.lit("gyro_lpf1_static_hz"), adjust(first, -20)))
    detail = F.concat(_percent("ratio"), F.lit(" % of the gyro's energy lies above 100 Hz"))
    found = _finding(
        3, "gyro_hf_noise", F.lit("medium"), F.concat("axis", F.lit(": gyro noise")), detail,
        "Filter the gyro more (cut-off down by about 20 %), or lower D.", [command]
    )
    return F.when(F.col("ratio") > 0.25, found)


def _dterm_hf() -> Column:
    axis = F.col("axis")
    lpf = _either(adjust(F.col("dterm_lpf2_static_hz"), -20), adjust(F.col("dterm_lpf1_static_hz"), -20))
    name = F.when(F.col("dterm_lpf2_static_hz") > 0, "dterm_lpf2_static_hz").otherwise("dterm_lpf1_static_hz")
    detail = F.concat(
        _percent("ratio"), F.lit(" % of the D-term's energy lies above 100 Hz; d_"), axis, F.lit(" is "),
        F.coalesce(_gain(axis, 3), F.lit(0)).cast("string")
    )
    commands = [_set(F.concat(F.lit("d_"), axis), adjust(_gain(axis, 3), -15)), _set(name, lpf)]
    found = _finding(
        4, "dterm_hf", F.lit("medium"), F.concat(axis, F.lit(": D-term noise")), detail,
        "Lower D by about 15 %, or filter the D-term more.", commands
    )
    return F.when(F.col("ratio") > 0.30, found)


def rule_propwash(analysis: DataFrame, config: DataFrame) -> DataFrame:
    """Oscillation in the propwash band: a fifth of the noise energy or more, on axes that move at all."""
    return _found(analysis.join(config, "log_id"), _propwash())


def rule_noise_throttle(slopes: DataFrame, config: DataFrame) -> DataFrame:
    """Tracking error that rises with throttle."""
    axis = F.col("axis")
    lpf = _either(adjust(F.col("gyro_lpf2_static_hz"), -20), adjust(F.col("gyro_lpf1_static_hz"), -20))
    name = F.when(F.col("gyro_lpf2_static_hz") > 0, "gyro_lpf2_static_hz").otherwise("gyro_lpf1_static_hz")
    detail = F.concat(F.lit("mean error rises by "), F.format_string("%.0f", F.col("slope")), F.lit(" deg/s over full throttle"))
    commands = [_set(F.concat(F.lit("d_"), axis), adjust(_gain(axis, 3), -10)), _set(name, lpf)]
    found = _finding(
        2, "noise_throttle", F.lit("medium"), F.concat(axis, F.lit(": noise rises with throttle")), detail,
        "Check propeller balance and motor bearings; filter the gyro more, or lower D.", commands
    )
    return _found(slopes.where("slope > 25").join(config, "log_id"), found)


def _with_axis(channels: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    number = F.regexp_extract("channel", r"\[(\d+)\]", 1)
    return channels.withColumn("axis", F.when(number != "", F.try_element_at(F.array(*map(F.lit, axes)), number.try_cast("int") + 1)))


def _share(psd: DataFrame, high: tuple[float, float], total: tuple[float, float], axes: tuple[str, ...]) -> DataFrame:
    energies = band_energies(psd, {"high": high, "total": total}, total).where("total > 0")
    return _with_axis(energies, axes).withColumn("ratio", F.col("high") / F.col("total")).where("axis is not null")


def rule_gyro_hf(psd: DataFrame, config: DataFrame) -> DataFrame:
    """Gyro noise above 100 Hz."""
    return _found(_share(psd, (100.0, 150.0), NOISE_BAND, AXES).join(config, "log_id"), _gyro_hf())


def rule_dterm_hf(psd: DataFrame, config: DataFrame) -> DataFrame:
    """D-term noise above 100 Hz, on roll and pitch."""
    return _found(_share(psd, (100.0, 200.0), (10.0, 200.0), AXES[:2]).join(config, "log_id"), _dterm_hf())


def rule_motor_saturation(peaks: DataFrame, config: DataFrame) -> DataFrame:
    """Motor output at 98 % of its limit or more; off for logs without a limit."""
    rows = peaks.where("motor_output_high > 0 and motor_max >= motor_output_high * 0.98").drop("motor_output_high").join(config, "log_id")
    detail = F.concat(
        F.lit("motor output peaks at "), F.format_string("%.0f", F.col("motor_max")), F.lit(", its limit is "),
        F.col("motor_output_high").cast("string")
    )
    commands = [_set(F.lit(f"p_{a}"), adjust(_gain(F.lit(a), 1), -10)) for a in AXES[:2]]
    found = _finding(
        5, "motor_saturation", F.lit("high"), F.lit("motor output near its limit"), detail,
        "Lower P of roll and pitch by about 10 %; check that motors and propellers match.", commands, F.lit(None).cast("string")
    )
    return _found(rows, found)


#: Channels of the diagnosis: tracking errors, gyro and D-terms, each with its axis's number.
_DIAGNOSED = {
    f"error[{i}]": f"setpoint_{i} - gyroADC_{i}" for i in range(3)
} | {f"gyroADC[{i}]": f"gyroADC_{i}" for i in range(3)} | {f"axisD[{i}]": f"axisD_{i}" for i in range(2)}


def diagnose(frames: DataFrame, config: DataFrame, nperseg: int = 1024) -> DataFrame:
    """Findings of all rules, ranked within each log: ``rank`` goes by severity, then rule, then axis.

    One spectrum of all channels serves the three rules on spectra; gyro and D-terms of fewer than 32 rows give none.
    """
    display, rates = to_display_units(with_t_sec(frames), config), estimate_sample_rate(frames)
    pairs = ", ".join(f"'{n}', cast({e} as double)" for n, e in _DIAGNOSED.items() if all(c in display.columns for c in e.split(" - ")))
    channels = display.select(
        "log_id", "seq", "t_s", F.expr(f"stack({pairs.count('cast(')}, {pairs}) as (channel, v)")
    ).where("v is not null and not isnan(v)")
    error = F.col("channel").startswith("error")
    # one row a channel is joined: a count beside each row would take a channel's rows into one task
    counts = channels.groupBy("log_id", "channel").agg(F.count("*").alias("_n"))
    psd = welch(channels.join(counts.where(error | (F.col("_n") >= 32)), ["log_id", "channel"], "left_semi"), rates, 200, nperseg)
    bands = {"wash": PROPWASH_BAND, "noise": NOISE_BAND, "gyro_high": (100.0, 150.0), "d_high": (100.0, 200.0), "d_total": (10.0, 200.0)}
    rms = channels.where(error).groupBy("log_id", "channel").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    rows = _with_axis(band_energies(psd, bands, PROPWASH_BAND).join(rms, ["log_id", "channel"], "left")).join(config, "log_id")
    share = lambda high, total: F.when(F.col(total) > 0, F.col(high) / F.col(total))
    gyro = F.col("channel").startswith("gyroADC")
    rows = rows.withColumns(
        {
            "propwash_ratio": F.coalesce(share("wash", "noise"), F.lit(0.0)),
            "ratio": F.when(gyro, share("gyro_high", "noise")).otherwise(share("d_high", "d_total"))
        }
    )
    spectral = _found(rows, F.when(error, _propwash()).when(gyro, _gyro_hf()).otherwise(_dterm_hf()))
    throttle = rule_noise_throttle(throttle_slope(error_vs_throttle(display)), config)
    return rank_findings(spectral.unionByName(throttle).unionByName(rule_motor_saturation(motor_peak(frames, config), config)))


def rank_findings(found: DataFrame) -> DataFrame:
    """Adds rank, 1 for the most severe finding of a log; per-axis rules are taken axis by axis, as they were asked."""
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("severity"))
    axis = F.array_position(F.array(*map(F.lit, AXES)), F.col("axis"))
    by_axis = F.when(F.col("rule_no") <= 2, axis).otherwise(F.lit(9))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(severity, by_axis, "rule_no", axis)))
