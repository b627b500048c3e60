"""Units, names and derived channels: row-wise projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylog.functions import ADJUSTMENTS, FAILSAFE_PHASES, FLIGHT_MODES, FLIGHT_STATES, NAMED_MODES, NAMED_PHASES, enum_to_string, field_unit, flags_to_string, version_gte
from skylog.schema import AXES, CHANNEL, COLUMN, MAIN_COLUMNS, present

FEET_PER_METER, GRAVITY = 3.28084, 9.80665
_CONFIG = ("fc_version", "gyro_scale", "acc_1g")


def stream(*columns: str) -> Window:
    """The rows of a log in stream order; further columns split it."""
    return Window.partitionBy("log_id", *columns).orderBy("seq")


def list_fields(field_defs: DataFrame) -> DataFrame:
    """Main-frame fields of each log with their units, by field_index."""
    return field_defs.where("frame_type = 'I'").select("log_id", "field_index", "name", field_unit(F.col("name")).alias("unit"))


def with_t_sec(frames: DataFrame) -> DataFrame:
    """Adds t_s, seconds since the first frame of the log in stream order (one row a log is joined)."""
    first = frames.groupBy("log_id").agg(F.min_by("time", "seq").alias("_first"))
    return frames.join(first, "log_id").withColumn("t_s", (F.col("time") - F.col("_first")) * 1e-6).drop("_first")


def by_place(frames: DataFrame, narrow: DataFrame) -> DataFrame:
    """Frames with further columns that were computed on a narrow table of the same rows; seq is unique in a log.

    Windows over a whole log thus sort a few columns only, and the wide rows stay dealt out by place.
    """
    return frames.join(narrow, ["log_id", "seq"], "left")


def _joined(frames: DataFrame, config: DataFrame, columns=_CONFIG) -> DataFrame:
    """Frames with the log's settings; logs without any keep their frames."""
    return frames.join(config.select("log_id", *(F.col(c).alias(f"_{c}") for c in columns)), "log_id", "left")


def _volts(c: str) -> Column:
    return F.col(c) / F.when(version_gte(F.col("_fc_version"), "4.3.0"), 100.0).otherwise(10.0)


def _gravities(c: str) -> Column:
    return F.col(c) / F.coalesce(F.when(F.col("_acc_1g") != 0, F.col("_acc_1g")), F.lit(2048)).cast("double")


def to_display_units(frames: DataFrame, config: DataFrame) -> DataFrame:
    """Main-frame fields as doubles in the units that ``field_unit`` names; absent fields stay null.

    Gyro values are multiplied in the order of the SQL: another one differs in the last bit, which decides comparisons with bounds.
    """
    scale = F.coalesce(F.col("_gyro_scale"), F.lit(1.0))

    def shown(c: str) -> Column:
        if c.startswith(("gyroADC_", "gyroUnfilt_")):
            return F.col(c) * scale * 1e6 * 180.0 / math.pi
        if c.startswith("accSmooth_"):
            return _gravities(c)
        return {"time": F.col(c) * 1e-6, "vbatLatest": _volts(c), "amperageLatest": F.col(c) / 100.0}.get(c, F.col(c).cast("double"))

    fields = present(frames, MAIN_COLUMNS)
    others = [c for c in frames.columns if c not in fields]
    return _joined(frames, config).select(*others, *(shown(c).alias(c) for c in fields))


#: Choices of ``convert_units``; the first is the default.
UNITS = {
    "time": ("us", "ms", "s"), "height": ("m", "cm", "ft"), "rotation": ("raw", "deg/s", "rad/s"), "acceleration": ("raw", "g", "m/s2"),
    "vbat": ("raw", "mV", "V"), "amperage": ("raw", "mA", "A"), "speed": ("mps", "kph", "mph"),
}


def convert_units(frames: DataFrame, config: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Log export's choice of units, see ``UNITS``; speeds are those of GPS columns, if there are any."""
    chosen = {k: v[0] for k, v in UNITS.items()} | (units or {})
    if wrong := [f"{k}={v}" for k, v in chosen.items() if v not in UNITS.get(k, ())]:
        raise ValueError(f"unknown units: {wrong}")
    turn = F.coalesce(F.col("_gyro_scale"), F.lit(1.0)) * 1e6
    make = {
        "time": lambda c: F.col(c) / {"us": 1.0, "ms": 1e3, "s": 1e6}[chosen["time"]] if chosen["time"] != "us" else F.col(c),
        "height": lambda c: F.col(c) / {"cm": 1.0, "m": 100.0, "ft": 100.0}[chosen["height"]] * (
            FEET_PER_METER if chosen["height"] == "ft" else 1.0
        ),
        "rotation": lambda c: {"raw": F.col(c), "deg/s": F.col(c) * turn * (180.0 / math.pi), "rad/s": F.col(c) * turn}[chosen["rotation"]],
        "acceleration": lambda c: {"raw": F.col(c), "g": _gravities(c), "m/s2": _gravities(c) * GRAVITY}[chosen["acceleration"]],
        "vbat": lambda c: {"raw": F.col(c), "mV": F.col(c) * 100, "V": _volts(c)}[chosen["vbat"]],
        "amperage": lambda c: {"raw": F.col(c), "mA": F.col(c) * 10, "A": F.col(c) / 100.0}[chosen["amperage"]],
        "speed": lambda c: F.col(c) / 100.0 * {"mps": 1.0, "kph": 3.6, "mph": 2.23694}[chosen["speed"]],
    }

    def kind(c: str) -> str | None:
        if c.startswith("gyroADC_"):
            return "rotation"
        if c.startswith("accSmooth_"):
            return "acceleration"
        return {
            "time": "time", "baroalt": "height", "vbatlatest": "vbat", "amperagelatest": "amperage", "gps_speed": "speed"
        }.get(c.lower())

    return _joined(frames, config).select(*(make[kind(c)](c).alias(c) if kind(c) else F.col(c) for c in frames.columns))


def gps_display(gps: DataFrame) -> DataFrame:
    """GPS fields in degrees, m/s, metres as recorded, and degrees of course."""
    scale = {"GPS_coord_0": 1e7, "GPS_coord_1": 1e7, "GPS_ground_course": 10.0, "GPS_speed": 100.0}
    return gps.select(*((F.col(c) / scale[c]).alias(c) if c in scale else F.col(c) for c in gps.columns))


def gps_altitude_m(gps: DataFrame, config: DataFrame, offset: float = 0.0) -> DataFrame:
    """Adds altitude_m; firmware from 4.0.0 on records decimetres, older centimetres."""
    scale = F.when(version_gte(F.col("_fc_version"), "4.0.0"), 0.1).otherwise(0.01)
    return _joined(gps, config, ("fc_version",)).withColumn("altitude_m", F.col("GPS_altitude") * scale + offset).drop("_fc_version")


def gps_quality(gps: DataFrame, min_sats: int = 5) -> DataFrame:
    """Fixes with enough satellites; those without a count are kept."""
    return gps.where(F.col("GPS_numSat").isNull() | (F.col("GPS_numSat") >= min_sats)) if "GPS_numSat" in gps.columns else gps


def gps_track(gps: DataFrame, config: DataFrame, offset: float = 0.0, min_sats: int = 5) -> DataFrame:
    """Track points: log_id, seq, lat, lon, altitude_m and the absolute time, if the log has a start time."""
    points = gps_altitude_m(gps_quality(gps, min_sats), config, offset)
    start = config.select("log_id", F.col("date_time").alias("_start")) if "date_time" in config.columns else config.select(
        "log_id", F.lit(None).cast("timestamp").alias("_start")
    )
    at = F.timestamp_micros(F.unix_micros("_start") + F.col("time"))
    return points.join(start, "log_id", "left").select(
        "log_id", "seq", (F.col("GPS_coord_0") / 1e7).alias("lat"), (F.col("GPS_coord_1") / 1e7).alias("lon"), "altitude_m",
        at.alias("at")
    )


def name_slow_flags(rows: DataFrame, all_names: bool = False) -> DataFrame:
    """Flight mode, state and failsafe phase as names."""
    modes, phases = (FLIGHT_MODES, FAILSAFE_PHASES) if all_names else (FLIGHT_MODES[:NAMED_MODES], FAILSAFE_PHASES[:NAMED_PHASES])
    named = {
        "flightModeFlags": flags_to_string(F.col("flightModeFlags"), modes),
        "stateFlags": flags_to_string(F.col("stateFlags"), FLIGHT_STATES),
        "failsafePhase": enum_to_string(F.col("failsafePhase"), phases)
    }
    return rows.withColumns({k: v for k, v in named.items() if k in rows.columns})


def decode_events(events: DataFrame) -> DataFrame:
    """Events with names: 0 sync beep, 13 in-flight adjustment, 14 logging resume, 255 log end; others are dropped."""
    kind, number = F.col("event_type"), F.col("adjustment_function").bitwiseAND(F.lit(127))
    name = F.when(kind == 0, "Sync beep").when(kind == 13, "Inflight adjustment").when(kind == 14, "Logging resume").when(kind == 255, "Log clean end")
    function = F.when(
        number < len(ADJUSTMENTS),
        F.element_at(F.array(*map(F.lit, ADJUSTMENTS)), F.least(number + 1, F.lit(len(ADJUSTMENTS))).cast("int"))
    ).otherwise(number.cast("string"))
    value = F.when(F.col("adjustment_function") > 127, F.col("float_value")).otherwise(F.col("int_value").cast("double"))
    data = F.when(kind == 13, F.struct(function.alias("adjustment_function"), value.alias("value"), F.lit(None).cast("long").alias("log_iteration"))).when(
        kind == 14, F.struct(
            F.lit(None).cast("string").alias("adjustment_function"), F.lit(None).cast("double").alias("value"),
            F.col("log_iteration").cast("long").alias("log_iteration")
        )
    )
    return events.select("log_id", "seq", "event_type", name.alias("name"), "time", data.alias("data")).where("name is not null")


def pid_error(display: DataFrame) -> DataFrame:
    """Long table of setpoint - gyro by axis, from frames in display units; axes that a log lacks give no rows."""
    pairs = ", ".join(f"'{a}', setpoint_{i} - gyroADC_{i}" for i, a in enumerate(AXES))
    keep = present(display, ("log_id", "seq", "t_s", "rcCommand_3"))
    return display.select(*keep, F.expr(f"stack({len(AXES)}, {pairs}) as (axis, error)")).where("error is not null and not isnan(error)")


def norm_throttle(frames: DataFrame) -> DataFrame:
    """Adds throttle from 0 to 1; rows outside are dropped."""
    return frames.withColumn("throttle", (F.col("rcCommand_3") - 1000.0) / 1000.0).where("throttle between 0 and 1")


def to_channels(display: DataFrame, names: list[str], time: str = "t_s") -> DataFrame:
    """Long table (log_id, channel, seq, t_s, v) of the named channels that the frames have."""
    found = [n for n in names if COLUMN.get(n, n) in display.columns]
    if not found:
        return display.select(
            "log_id", F.lit(None).cast("string").alias("channel"), "seq", F.col(time).alias("t_s"),
            F.lit(None).cast("double").alias("v")
        ).limit(0)
    pairs = ", ".join(f"'{n}', cast(`{COLUMN.get(n, n)}` as double)" for n in found)
    return display.select(
        "log_id", "seq", F.col(time).alias("t_s"), F.expr(f"stack({len(found)}, {pairs}) as (channel, v)")
    ).where("v is not null").select("log_id", "channel", "seq", "t_s", "v")


def missing_channels(field_defs: DataFrame, names: list[str]) -> DataFrame:
    """(log_id, channel) of the asked names that a log doesn't record."""
    asked = field_defs.select("log_id").distinct().select("log_id", F.explode(F.array(*map(F.lit, names))).alias("channel"))
    return asked.join(
        field_defs.where("frame_type = 'I'").select("log_id", F.col("name").alias("channel")), ["log_id", "channel"],
        "left_anti"
    )
