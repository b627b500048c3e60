"""Column functions: units, versions, flags, schedules and readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of flags, phases and adjustments, by bit or number.
FLIGHT_MODES = (
    "ANGLE_MODE", "HORIZON_MODE", "MAG_MODE", "BARO_MODE", "GPS_HOME_MODE", "GPS_HOLD_MODE", "HEADFREE_MODE", "UNUSED_MODE",
    "PASSTHRU_MODE", "RANGEFINDER_MODE", "FAILSAFE_MODE"
)
FLIGHT_STATES = ("GPS_FIX_HOME", "GPS_FIX", "CALIBRATE_MAG", "SMALL_ANGLE", "FIXED_WING")
FAILSAFE_PHASES = ("IDLE", "RX_LOSS_DETECTED", "LANDING", "LANDED", "RX_LOSS_MONITORING", "RX_LOSS_RECOVERED")
ADJUSTMENTS = (
    "NONE", "RC_RATE", "RC_EXPO", "THROTTLE_EXPO", "PITCH_ROLL_RATE", "YAW_RATE", "PITCH_ROLL_P", "PITCH_ROLL_I",
    "PITCH_ROLL_D", "YAW_P", "YAW_I", "YAW_D", "RATE_PROFILE", "PITCH_RATE", "ROLL_RATE", "PITCH_P", "PITCH_I", "PITCH_D",
    "ROLL_P", "ROLL_I", "ROLL_D"
)
#: Flags and phases that log exports name; higher bits stay unnamed, higher phases numbers.
NAMED_MODES, NAMED_PHASES = 10, 4

#: Unit by name of a single field, and by prefix of an indexed one.
_UNITS = {"time": "s", "loopIteration": "", "vbatLatest": "V", "amperageLatest": "A"}
_INDEXED_UNITS = {
    "gyroADC": "deg/s", "gyroUnfilt": "deg/s", "setpoint": "deg/s", "axisP": "deg/s", "axisD": "deg/s", "axisF": "deg/s",
    "axisI": "raw", "rcCommand": "us", "motor": "us", "accSmooth": "g", "eRPM": "rpm"
}


def field_unit(name: Column) -> Column:
    """Display unit of a field name."""
    out = F.lit("raw")
    for prefix, unit in _INDEXED_UNITS.items():
        out = F.when(name.startswith(f"{prefix}["), unit).otherwise(out)
    for field, unit in _UNITS.items():
        out = F.when(name == field, unit).otherwise(out)
    return F.when(name.isNotNull(), out)


def version_gte(version: Column, least: str) -> Column:
    """Whether "x.y.z" is at least another version, by its first three numbers; unknown versions are not."""
    parts = F.slice(F.transform(F.filter(F.split(version, "[^0-9]"), lambda x: x != ""), lambda x: x.cast("int")), 1, 3)
    return F.coalesce((F.size(parts) > 0) & (parts >= F.array(*[F.lit(int(x)) for x in least.split(".")])), F.lit(False))


def flags_to_string(flags: Column, names=FLIGHT_MODES[:NAMED_MODES]) -> Column:
    """Names of the set bits, joined by "|"; "0" if none is named."""
    text = F.concat_ws("|", *[F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)])
    return F.when(flags.isNotNull(), F.when(text == "", "0").otherwise(text))


def enum_to_string(number: Column, names=FAILSAFE_PHASES[:NAMED_PHASES]) -> Column:
    """The name of a number, or the number itself if it has none."""
    named = reduce(lambda out, x: out.when(number == x[0], x[1]), enumerate(names[1:], 1), F.when(number == 0, names[0]))
    return named.otherwise(number.cast("string"))


def should_have_frame(i: Column, interval: Column, num: Column, denom: Column) -> Column:
    """Whether the sampling schedule logs loop iteration i."""
    return F.pmod(F.pmod(i, interval) + num - 1, denom) < num


def _logged_places(y: Column, num: Column, denom: Column) -> Column:
    """How many of the places 0 to y - 1 have a remainder below num modulo denom."""
    return int_div(y, denom) * F.least(num, denom) + F.least(F.pmod(y, denom), num)


def scheduled_before(i: Column, interval: Column, num: Column, denom: Column) -> Column:
    """How many of the iterations 0 to i - 1 the schedule logs: by whole intervals and a rest, however many they are.

    Null where interval, num or denom isn't positive.
    """
    interval, num, denom = (F.when(c > 0, c.cast("long")) for c in (interval, num, denom))
    one = lambda m: _logged_places(num - 1 + m, num, denom) - _logged_places(num - 1, num, denom)
    rest = F.pmod(i.cast("long"), interval)
    return int_div(i.cast("long") - rest, interval) * one(interval) + one(rest)


def nth_scheduled(n: Column, interval: Column, num: Column, denom: Column) -> Column:
    """The n-th iteration (from 1) that the schedule logs; null where it logs none."""
    interval, num, denom = (F.when(c > 0, c.cast("long")) for c in (interval, num, denom))
    before = _logged_places(num - 1, num, denom)
    each = F.nullif(_logged_places(num - 1 + interval, num, denom) - before, F.lit(0))
    whole = int_div(n - 1 - F.pmod(n - 1, each), each)
    place = F.pmod(n - 1, each) + before
    few = F.least(num, denom)
    return whole * interval + int_div(place, few) * denom + F.pmod(place, few) - (num - 1)


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; null if b is 0."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def adc_to_milliamps(adc: Column, offset: Column, scale: Column) -> Column:
    """Current sensor reading (unsigned 16 bits) to mA, in truncating integer arithmetic; null for scale 0."""
    millivolts = int_div(F.pmod(adc.cast("long"), F.lit(65536)) * 33 * 100, F.lit(4095))
    return int_div((millivolts - offset.cast("long")) * 10000, scale)


def adc_to_millivolts(adc: Column, scale: Column) -> Column:
    """Battery reading to mV."""
    return int_div(adc.cast("long") * 33 * 10 * scale.cast("long"), F.lit(4095))


def estimate_cells(reference: Column, scale: Column, most_per_cell: Column) -> Column:
    """Battery cells: the first count from 1 to 7 whose full voltage is above the reference, else 8."""
    volts = int_div(adc_to_millivolts(reference, scale), F.lit(100))
    out = F.when(volts < most_per_cell, 1)
    for n in range(2, 8):
        out = out.when(volts < most_per_cell * n, n)
    return out.otherwise(8)


def adjust(value: Column, percent: float) -> Column:
    """A setting changed by some percent, rounded half to even; null if it isn't positive."""
    return F.when(value > 0, F.rint(value * (1.0 + percent / 100.0)).cast("int"))
