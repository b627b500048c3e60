"""Queries of the operators over the derived logs, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylog import functions as fn
from skylog.operators import joins, rebuild, reconcile, series, stats, steps, tuning, units
from skylog.operators.scan import saved

from .driver_tables import Tables, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_GYRO, _AXIS_D = [f"gyroADC[{i}]" for i in range(3)], [f"axisD[{i}]" for i in range(2)]
# Names by bit or number, as the SQL below has to give them.
_MODE_NAMES = [
    "ANGLE_MODE", "HORIZON_MODE", "MAG_MODE", "BARO_MODE", "GPS_HOME_MODE", "GPS_HOLD_MODE", "HEADFREE_MODE", "UNUSED_MODE",
    "PASSTHRU_MODE", "RANGEFINDER_MODE"
]
_STATE_NAMES = ["GPS_FIX_HOME", "GPS_FIX", "CALIBRATE_MAG", "SMALL_ANGLE", "FIXED_WING"]
_PHASE_NAMES = ["IDLE", "RX_LOSS_DETECTED", "LANDING", "LANDED"]
_ADJUSTMENT_NAMES = [
    "NONE", "RC_RATE", "RC_EXPO", "THROTTLE_EXPO", "PITCH_ROLL_RATE", "YAW_RATE", "PITCH_ROLL_P", "PITCH_ROLL_I", "PITCH_ROLL_D", "YAW_P", "YAW_I", "YAW_D",
    "RATE_PROFILE", "PITCH_RATE", "ROLL_RATE", "PITCH_P", "PITCH_I", "PITCH_D", "ROLL_P", "ROLL_I", "ROLL_D",
]


def query(sql: str | None = None, noisy: bool = False):
    """Registers a query over the derived tables, and its SQL. Noisy frames have gyro noise that grows with throttle."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir, noisy))
        if sql is not None:
            SQL[make.__name__] = with_sql(sql, noisy)
        return make

    return add


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros."""
    return df.select(*((F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# -- units and names ------------------------------------------------------------------------------

_UNIT = """case when channel in ('gyroADC[0]', 'gyroADC[1]', 'gyroADC[2]') or channel like 'setpoint[%' or channel like 'axisD[%' then 'deg/s'
  when channel like 'rcCommand[%' or channel like 'motor[%' then 'us' when channel = 'vbatLatest' then 'V' when channel = 'amperageLatest' then 'A'
  when channel like 'accSmooth[%' then 'g' when channel like 'eRPM[%' then 'rpm' when channel = 'time' then 's' when channel = 'loopIteration' then '' else 'raw' end"""
_FIELD_NAMES = [
    "axisD_0", "axisD_1", "axisD_2", "rcCommand_3", "setpoint_0", "setpoint_1", "setpoint_2", "vbatLatest", "amperageLatest",
    "gyroADC_0", "gyroADC_1", "gyroADC_2", "accSmooth_0", "accSmooth_1", "accSmooth_2", "motor_0", "motor_1", "motor_2",
    "motor_3", "eRPM_0", "eRPM_1", "eRPM_2", "eRPM_3"
]
_ALL = ["loopIteration", "time", *_FIELD_NAMES]


def _name(c: str) -> str:
    head, _, k = c.rpartition("_")
    return f"{head}[{k}]" if head else c


@query(
    f"select log_id, channel as name, {_UNIT} as unit from (select distinct log_id from f), (select unnest({[_name(c) for c in _ALL]}) as channel)"
)
def list_fields(t: Tables) -> DataFrame:
    return units.list_fields(t.field_defs()).select("log_id", "name", "unit")


@query(f"select log_id, channel from (select distinct log_id from f), (select unnest(['debug[0]', 'servo[3]']) as channel)")
def missing_channels(t: Tables) -> DataFrame:
    return units.missing_channels(t.field_defs(), ["debug[0]", "gyroADC[1]", "servo[3]", "time"])


@query("select log_id, seq, round((time - first_value(time) over (partition by log_id order by seq)) * 1e-6, 6) as t_s from f")
def with_t_sec(t: Tables) -> DataFrame:
    return _rounded(units.with_t_sec(t.frames).select("log_id", "seq", "t_s"))


_DISPLAY = """display as (select f.*, (time - first_value(time) over (partition by log_id order by seq)) * 1e-6 as t_s,
  gyroADC_0 * gyro_scale * 1e6 * 180 / pi() as g0, gyroADC_1 * gyro_scale * 1e6 * 180 / pi() as g1, gyroADC_2 * gyro_scale * 1e6 * 180 / pi() as g2,
  vbatLatest / case when fc_version in ('4.3.0', '4.5.1') then 100.0::double else 10.0::double end as volts, amperageLatest / 100.0::double as amps,
  accSmooth_1 / cast(case when acc_1g = 0 then 2048 else acc_1g end as double) as acc1, gyro_scale from f join cfg using (log_id))"""


@query(
    f""", {_DISPLAY} select log_id, seq, round(time * 1e-6, 6) as time, round(g0, 6) as gyroADC_0, round(g2, 6) as gyroADC_2,
  round(volts, 6) as vbatLatest, round(amps, 6) as amperageLatest, round(acc1, 6) as accSmooth_1, cast(motor_2 as double) as
  motor_2 from display"""
)
def to_display_units(t: Tables) -> DataFrame:
    return _rounded(
        units.to_display_units(t.frames, t.config).select(
            "log_id", "seq", "time", "gyroADC_0", "gyroADC_2", "vbatLatest", "amperageLatest", "accSmooth_1", "motor_2"
        )
    )


@query(
    f""", {_DISPLAY} select log_id, seq, round(time / 1000.0::double, 6) as time, round(gyroADC_1 * gyro_scale * 1e6, 6) as
  gyroADC_1, round(acc1 * 9.80665, 6) as accSmooth_1, vbatLatest * 100 as vbatLatest, round(amps, 6) as amperageLatest from
  display"""
)
def convert_units(t: Tables) -> DataFrame:
    chosen = {"time": "ms", "rotation": "rad/s", "acceleration": "m/s2", "vbat": "mV", "amperage": "A"}
    return _rounded(
        units.convert_units(t.frames, t.config, chosen).select(
            "log_id", "seq", "time", "gyroADC_1", "accSmooth_1", "vbatLatest", "amperageLatest"
        )
    )


@query(
    """select log_id, seq, GPS_coord_0 / 1e7 as lat, GPS_coord_1 / 1e7 as lon, round(GPS_altitude * case when fc_version >=
  '4.0.0' then 0.1::double else 0.01::double end + 2.5, 6) as altitude_m from gps join cfg using (log_id) where GPS_numSat >= 5"""
)
def gps_track(t: Tables) -> DataFrame:
    return _rounded(units.gps_track(t.gps, t.config, offset=2.5).drop("at"), 7)


@query(
    """select log_id, seq, time, GPS_numSat, GPS_coord_0 / 1e7 as GPS_coord_0, GPS_coord_1 / 1e7 as GPS_coord_1, GPS_altitude,
  GPS_speed / 100.0::double as GPS_speed, GPS_ground_course / 10.0::double as GPS_ground_course from gps"""
)
def gps_display(t: Tables) -> DataFrame:
    return units.gps_display(t.gps)


def _names_sql(column: str, names) -> str:
    parts = ", ".join(f"case when {column} & {1 << i} <> 0 then '{n}' end" for i, n in enumerate(names))
    return f"coalesce(nullif(concat_ws('|', {parts}), ''), '0')"


_PHASE = f"case when failsafePhase < 4 then {_PHASE_NAMES}[failsafePhase + 1] else cast(failsafePhase as varchar) end"


@query(
    f"""select log_id, seq, {_names_sql('flightModeFlags', _MODE_NAMES)} as flightModeFlags,
  {_names_sql('stateFlags', _STATE_NAMES)} as stateFlags, {_PHASE} as failsafePhase from slow"""
)
def name_slow_flags(t: Tables) -> DataFrame:
    return units.name_slow_flags(t.slow)


@query(f"""select log_id, seq, time, case event_type when 0 then 'Sync beep' when 13 then 'Inflight adjustment' when 14 then
  'Logging resume' else 'Log clean end' end as name,
  case when event_type = 13 then case when adjustment_function & 127 < 21 then {_ADJUSTMENT_NAMES}[(adjustment_function & 127)
  + 1] else cast(adjustment_function & 127 as varchar) end end as adjustment,
  case when event_type = 13 then case when adjustment_function > 127 then float_value else cast(int_value as double) end end as
  value,
  case when event_type = 14 then log_iteration end as log_iteration from ev""")
def decode_events(t: Tables) -> DataFrame:
    return units.decode_events(t.events).select(
        "log_id", "seq", "time", "name", F.col("data.adjustment_function").alias("adjustment"), "data.value",
        "data.log_iteration"
    )


_ERROR = f"""{_DISPLAY}, err as (select log_id, seq, rcCommand_3, unnest(['roll', 'pitch', 'yaw']) as axis, unnest([setpoint_0 -
  g0, setpoint_1 - g1, setpoint_2 - g2]) as error from display)"""


@query(f", {_ERROR} select log_id, axis, seq, round(error, 6) + 0.0::double as error from err")
def pid_error(t: Tables) -> DataFrame:
    return _rounded(units.pid_error(units.to_display_units(t.frames, t.config)).select("log_id", "axis", "seq", "error"))


@query("""select log_id, seq, ((amperageLatest * 33 * 100 // 4095) - current_meter_offset) * 10000 // current_meter_scale as ma,
  vbatLatest * 33 * 10 * vbatscale // 4095 as mv, case when refv < vbatmaxcellvoltage then 1 when refv < 2 * vbatmaxcellvoltage
  then 2 when refv < 3 * vbatmaxcellvoltage then 3
  when refv < 4 * vbatmaxcellvoltage then 4 when refv < 5 * vbatmaxcellvoltage then 5 when refv < 6 * vbatmaxcellvoltage then 6
  when refv < 7 * vbatmaxcellvoltage then 7 else 8 end as cells
  from (select *, vbatref * 33 * 10 * vbatscale // 4095 // 100 as refv from cfg) join f using (log_id)""")
def adc_readings(t: Tables) -> DataFrame:
    rows = t.frames.join(t.config, "log_id")
    ma = fn.adc_to_milliamps(F.col("amperageLatest"), F.col("current_meter_offset"), F.col("current_meter_scale"))
    return rows.select(
        "log_id", "seq", ma.alias("ma"), fn.adc_to_millivolts(F.col("vbatLatest"), F.col("vbatscale")).alias("mv"),
        fn.estimate_cells(F.col("vbatref"), F.col("vbatscale"), F.col("vbatmaxcellvoltage")).alias("cells")
    )


@query(
    """select log_id, cast(round_even(d_roll * 1.12, 0) as int) as d_up, case when gyro_lpf2_static_hz > 0 then
  cast(round_even(gyro_lpf2_static_hz * 0.8, 0) as int) end as lpf_down, fc_version in ('4.3.0', '4.5.1') as is_430, n from cfg
  join (select log_id, count(*) as n from f group by log_id) using (log_id)"""
)
def adjust_settings(t: Tables) -> DataFrame:
    rows = t.config.join(t.frames.groupBy("log_id").agg(F.count("*").alias("n")), "log_id")
    return rows.select(
        "log_id", fn.adjust(F.col("d_roll"), 12).alias("d_up"), fn.adjust(F.col("gyro_lpf2_static_hz"), -20).alias("lpf_down"),
        fn.version_gte(F.col("fc_version"), "4.3.0").alias("is_430"), "n"
    )


@query(f"""select log_id, seq, t_s, channel, v from (select log_id, seq, round((time - first_value(time) over (partition by
  log_id order by seq)) * 1e-6, 6) as t_s,
  unnest(['motor[1]', 'setpoint[0]', 'eRPM[2]']) as channel, unnest([cast(motor_1 as double), cast(setpoint_0 as double),
  cast(eRPM_2 as double)]) as v from f)""")
def to_channels(t: Tables) -> DataFrame:
    return _rounded(units.to_channels(units.with_t_sec(t.frames), ["motor[1]", "setpoint[0]", "eRPM[2]", "debug[7]"]))


# -- aggregates -----------------------------------------------------------------------------------

_LIMITS = " union all ".join(
    f"select log_id, '{_name(c)}' as channel, min({c}) as min, max({c}) as max, max({c}) - min({c}) as range from f group by log_id" for c in _ALL
)


@query(_LIMITS)
def field_limits(t: Tables) -> DataFrame:
    return stats.field_limits(t.frames)


@query(
    """select log_id, frame_type, count(*) filter (status = 'valid') as valid, count(*) filter (status = 'desync') as desync,
  count(*) filter (status = 'corrupt') as corrupt, cast(sum(size_bytes) filter (status = 'valid') as bigint) as bytes,
  round(avg(size_bytes) filter (status = 'valid'), 6) as mean_bytes from idx group by all"""
)
def frame_stats(t: Tables) -> DataFrame:
    return _rounded(stats.frame_stats(t.frame_index))


_LOOPS = """loops as (select log_id, (time - lag(time) over w) // (loopIteration - lag(loopIteration) over w) as d from f window
  w as (partition by log_id order by seq))"""


@query(
    f""", {_LOOPS} select log_id, round(avg(d), 6) as mean_us, round(stddev_samp(d), 6) as stddev_us, round(stddev_samp(d) /
  avg(d) * 100, 6) as stddev_pct from loops where d is not null group by log_id"""
)
def looptime_stats(t: Tables) -> DataFrame:
    return _rounded(stats.looptime_stats(t.frames))


_SPAN = """span as (select log_id, (max(time) - min(time)) // 1000 as ms, max(loopIteration) - min(loopIteration) + 1 as total
  from f group by log_id),
sizes as (select log_id, count(*) filter (status = 'valid') as good, cast(sum(size_bytes) as bigint) as bytes from idx group by
  log_id)"""


@query(
    f""", {_SPAN} select log_id, good * 1000 // ms as rate_hz, bytes * 1000 // ms as bytes_per_s, (bytes * 10000 // ms + 99) //
  100 * 100 as baud from span join sizes using (log_id)"""
)
def data_rate(t: Tables) -> DataFrame:
    return stats.data_rate(t.frame_index, t.frames)


_ABSENT = """gaps as (select log_id, seq, loopIteration, lag(loopIteration) over (partition by log_id order by seq) as before
  from f),
absent as (select g.log_id, g.seq, count(i) filter (not ((i % frame_interval_i + p_num - 1) % p_denom < p_num)) as absent
  from (select *, unnest(case when loopIteration - before > 1 then range(before + 1, loopIteration) else [null] end) as i from
  gaps) g join cfg using (log_id) group by all)"""


@query(f", {_ABSENT} select * from absent")
def absent_iterations(t: Tables) -> DataFrame:
    return stats.absent_iterations(t.frames.select("log_id", "seq", "loopIteration"), t.config).select("log_id", "seq", "absent")


@query(
    f""", {_SPAN}, {_ABSENT}, sums as (select log_id, cast(sum(absent) as bigint) as absent from absent group by log_id) select
  log_id, total, greatest(total - good - absent, 0) as missing, greatest(total - good - absent, 0) * ms // total as missing_ms,
  round(greatest(total - good - absent, 0) / total * 100, 6) as missing_pct, absent, absent * ms // total as absent_ms from span
  join sizes using (log_id) join sums using (log_id)"""
)
def missing_frames(t: Tables) -> DataFrame:
    return _rounded(stats.missing_frames(t.frames, t.frame_index, t.config))


@query("""select log_id, n_frames, start_us, end_us, coalesce(n_events, 0) as n_events, coalesce(n_gps, 0) as n_gps,
  coalesce(n_slow, 0) as n_slow, fc_version, frame_interval_i, p_num, p_denom, end_us - start_us as duration_us
  from (select log_id, count(*) as n_frames, min(time) as start_us, max(time) as end_us from f group by log_id) left join
  (select log_id, count(*) as n_events from ev group by log_id) using (log_id)
  left join (select log_id, count(*) as n_gps from gps group by log_id) using (log_id) left join (select log_id, count(*) as
  n_slow from slow group by log_id) using (log_id) join cfg using (log_id)""")
def log_summary(t: Tables) -> DataFrame:
    return stats.log_summary(t.frames, t.events, t.gps, t.slow, t.config)


@query(f""", {_LOOPS}, {_SPAN}, {_ABSENT}, sums as (select log_id, cast(sum(absent) as bigint) as absent from absent group by
  log_id),
  lp as (select log_id, round(avg(d), 6) as mean_us from loops where d is not null group by log_id)
  select log_id, mean_us, good * 1000 // ms as rate_hz, greatest(total - good - absent, 0) as missing, absent, (select count(*)
  from idx where idx.log_id = lp.log_id and status = 'corrupt') as corrupt
  from lp join span using (log_id) join sizes using (log_id) join sums using (log_id)""")
def decode_report(t: Tables) -> DataFrame:
    return _rounded(stats.decode_report(t.frames, t.frame_index, t.config)).select(
        "log_id", "mean_us", "rate_hz", "missing", "absent", "corrupt"
    )


@query(f", {_ERROR} select log_id, axis, round(sqrt(avg(error * error)), 6) as rms from err group by all")
def pid_rms(t: Tables) -> DataFrame:
    return _rounded(stats.pid_rms(units.to_display_units(t.frames, t.config)))


_BINNED = f"""{_ERROR}, binned as (select log_id, axis, abs(error) as e, (rcCommand_3 - 1000) / 1000.0::double as x from err),
means as (select log_id, axis, cast(len(list_filter({[k * 0.05 for k in range(1, 20)]}::double[], lambda k: k <= x)) as int) as
  bin, avg(e) as m from binned where x between 0 and 1 group by all),
evt as (select a.log_id, a.axis, cast(b.range as int) as bin, (b.range * 0.05::double + (b.range + 1) * 0.05::double) / 2 as
  throttle, m as mean_abs_error
  from (select distinct log_id, axis from err) a cross join range(20) b left join means on means.log_id = a.log_id and
  means.axis = a.axis and means.bin = b.range)"""


@query(f", {_BINNED} select log_id, axis, bin, round(throttle, 6) as throttle, round(mean_abs_error, 6) as mean_abs_error from evt")
def error_vs_throttle(t: Tables) -> DataFrame:
    return _rounded(stats.error_vs_throttle(units.to_display_units(t.frames, t.config)))


@query(
    f""", {_BINNED} select log_id, axis, round(regr_slope(mean_abs_error, throttle), 5) as slope from evt where mean_abs_error
  is not null group by all having count(*) >= 4"""
)
def throttle_slope(t: Tables) -> DataFrame:
    return _rounded(stats.throttle_slope(stats.error_vs_throttle(units.to_display_units(t.frames, t.config))), 5)


_RATE = """rates as (select log_id, 1e6 / median(d) as fs from (select log_id, time - lag(time) over (partition by log_id order
  by seq) as d from f) where d > 0 group by log_id)"""


@query(f", {_RATE} select log_id, round(fs, 6) as sample_rate from rates")
def estimate_sample_rate(t: Tables) -> DataFrame:
    return _rounded(stats.estimate_sample_rate(t.frames))


_MOTOR_HZ = """motor_hz as (select log_id, median(m) * 100.0::double / 7 / 60 as hz from (
  select log_id, k, median(v) as m from (select log_id, unnest([0, 1, 2, 3]) as k, unnest([eRPM_0, eRPM_1, eRPM_2, eRPM_3]) as
  v from f) where v > 0 group by all) group by log_id)"""


@query(f", {_MOTOR_HZ} select log_id, round(hz, 6) as motor_hz, round(2 * hz, 6) as second, round(3 * hz, 6) as third from motor_hz")
def motor_frequency(t: Tables) -> DataFrame:
    out = stats.motor_frequency(t.frames)
    return _rounded(out.select("log_id", "motor_hz", out.harmonics[1].alias("second"), out.harmonics[2].alias("third")))


@query(
    """select log_id, motor_output_high, motor_max, round(case when motor_output_high > 0 then motor_max / motor_output_high
  end, 6) as share from (select log_id, cast(max(greatest(motor_0, motor_1, motor_2, motor_3)) as double) as motor_max from f
  group by log_id) join cfg using (log_id)"""
)
def motor_peak(t: Tables) -> DataFrame:
    return _rounded(stats.motor_peak(t.frames, t.config))


_ENERGY = """energy as (select log_id, seq, cast(round_even(sum(coalesce(ma * dt / 3.6e9, 0)) over (partition by log_id order by
  seq rows unbounded preceding), 0) as bigint) as energy_mah from (
  select log_id, seq, ((amperageLatest * 33 * 100 // 4095) - current_meter_offset) * 10000 // current_meter_scale as ma, time -
  lag(time) over (partition by log_id order by seq) as dt from f join cfg using (log_id)))"""


@query(f", {_ENERGY} select * from energy")
def energy_cumulative(t: Tables) -> DataFrame:
    return stats.energy_cumulative(t.frames, t.config).select("log_id", "seq", "energy_mah")


# -- joins and export -----------------------------------------------------------------------------

_MERGED = """merged as (select f.*, coalesce(s.flightModeFlags, 0) as flightModeFlags, coalesce(s.stateFlags, 0) as stateFlags,
  coalesce(s.failsafePhase, 0) as failsafePhase from f asof left join slow s on f.log_id = s.log_id and f.seq >= s.seq)"""


@query(f", {_MERGED} select log_id, seq, flightModeFlags, stateFlags, failsafePhase from merged")
def merge_slow(t: Tables) -> DataFrame:
    return joins.merge_slow(t.frames, t.slow).select("log_id", "seq", "flightModeFlags", "stateFlags", "failsafePhase")


_WITH_GPS = """with_gps as (select f.log_id, f.seq, f.time, f.motor_0, g.GPS_numSat, g.GPS_speed from f left join gps g on
  g.log_id = f.log_id and g.seq = f.seq + 2 and g.time = f.time
  union all select f.log_id, g.seq, g.time, f.motor_0, g.GPS_numSat, g.GPS_speed from f join gps g on g.log_id = f.log_id and
  g.seq = f.seq + 2 and g.time <> f.time)"""


@query(f", {_WITH_GPS} select * from with_gps")
def merge_gps(t: Tables) -> DataFrame:
    return joins.merge_gps(t.frames, t.gps).select("log_id", "seq", "time", "motor_0", "GPS_numSat", "GPS_speed")


@query(f""", {_DISPLAY}, {_MERGED}, {_ENERGY}, {_WITH_GPS} select w.log_id, w.seq, round(w.time / 1e6, 6) as time,
  round(d.volts, 6) as vbatLatest, e.energy_mah, {_names_sql('m.flightModeFlags', _MODE_NAMES)} as flightModeFlags,
  {_PHASE.replace('failsafePhase', 'm.failsafePhase')} as failsafePhase, w.GPS_numSat, w.GPS_speed / 100.0::double as GPS_speed
  from with_gps w join merged m on m.log_id = w.log_id and m.seq = w.seq // 10 * 10 join display d on d.log_id = m.log_id and
  d.seq = m.seq join energy e on e.log_id = m.log_id and e.seq = m.seq""")
def export_log(t: Tables) -> DataFrame:
    from .jobs import export_log as export

    out = export(t.frames, t.slow, t.gps, t.config, {"time": "s", "vbat": "V"})
    return _rounded(
        out.select("log_id", "seq", "time", "vbatLatest", "energy_mah", "flightModeFlags", "failsafePhase", "GPS_numSat", "GPS_speed")
    )


# -- rebuilding -----------------------------------------------------------------------------------

_SEG = "segments as (select *, sum(case when frame_type = 'I' then 1 else 0 end) over (partition by log_id order by seq) as segment from f)"


def _deltas(t: Tables) -> DataFrame:
    """The frames as they would be recorded: P frames hold differences to their predictors."""
    w = units.stream("segment")
    rows = rebuild.with_segments(t.frames)
    key = F.col("frame_type") == "I"
    before = lambda c, n: F.lag(c, n).over(w)
    second = lambda c: F.coalesce(before(c, 2), before(c, 1))
    total = before("accSmooth_0", 1) + second("accSmooth_0")
    mean = F.signum(total).cast("long") * F.floor(F.abs(total) / 2)
    return rows.select(
        "log_id", "seq", "segment", "frame_type", F.when(key, F.col("motor_0")).otherwise(F.col("motor_0") - before("motor_0", 1)).alias("motor_0"),
        F.when(key, F.col("eRPM_0")).otherwise(F.col("eRPM_0") - 2 * before("eRPM_0", 1) + second("eRPM_0")).alias("eRPM_0"),
        F.when(key, F.col("accSmooth_0")).otherwise(F.col("accSmooth_0") - mean).alias("accSmooth_0"), "loopIteration",
    )


@query(f", {_SEG} select log_id, seq, cast(segment as bigint) as segment from segments")
def with_segments(t: Tables) -> DataFrame:
    return rebuild.with_segments(t.frames).select("log_id", "seq", "segment")


@query("select log_id, seq, motor_0 from f")
def undo_previous(t: Tables) -> DataFrame:
    return rebuild.undo_previous(_deltas(t), ["motor_0"]).select("log_id", "seq", "motor_0")


@query("select log_id, seq, eRPM_0 from f")
def undo_straight_line(t: Tables) -> DataFrame:
    return rebuild.undo_straight_line(_deltas(t), ["eRPM_0"]).select("log_id", "seq", "eRPM_0")


@query("select log_id, seq, accSmooth_0 from f")
def undo_average2(t: Tables) -> DataFrame:
    return rebuild.undo_average2(_deltas(t), ["accSmooth_0"]).select("log_id", "seq", "accSmooth_0")


_INC = """inc as (select log_id, seq, frame_type, loopIteration, n % 32 as place, frame_interval_i as fi, p_num, p_denom,
  loopIteration - case when n // 500 = (n - n % 32) // 500 then n % 32 else n % 32 + 3 end as first from f join cfg using
  (log_id))"""


@query(
    f""", {_INC} select log_id, seq, case when frame_type = 'I' then loopIteration else list_filter(range(first + 1, first + 2 *
  fi * greatest(p_denom, 1) + 1), lambda i: (i % fi + p_num - 1) % p_denom < p_num)[place] end as loopIteration from inc"""
)
def undo_inc(t: Tables) -> DataFrame:
    return rebuild.undo_inc(_deltas(t), t.config).select("log_id", "seq", "loopIteration")


@query("""select log_id, seq, case when frame_type = 'I' then vbatLatest + vbatref else vbatLatest end as vbatLatest, case when
  frame_type = 'I' then motor_0 + minthrottle else motor_0 end as motor_0,
  case when frame_type = 'I' then motor_1 + motor_0 + minthrottle else motor_1 end as motor_1 from f join cfg using (log_id)""")
def undo_base(t: Tables) -> DataFrame:
    return rebuild.undo_base(t.frames, t.config).select("log_id", "seq", "vbatLatest", "motor_0", "motor_1")


_HOME = "home as (select log_id, seq + 1 as seq, 473000000 + 3 * e as GPS_home_0, -85000000 - e as GPS_home_1 from f where e % 331 = 0)"


@query(
    f""", {_HOME} select g.log_id, g.seq, g.GPS_coord_0 + h.GPS_home_0 as GPS_coord_0, g.GPS_coord_1 + h.GPS_home_1 as
  GPS_coord_1 from gps g asof join home h on g.log_id = h.log_id and g.seq >= h.seq"""
)
def undo_home(t: Tables) -> DataFrame:
    home = t._all.where("e % 331 = 0").selectExpr(
        "log_id", "seq + 1 as seq", "473000000 + 3 * e as GPS_home_0", "-85000000 - e as GPS_home_1"
    )
    return rebuild.undo_home(t.gps, home).select("log_id", "seq", "GPS_coord_0", "GPS_coord_1")


@query("select g.log_id, g.seq, g.time % 1000 + f.time as time from gps g asof join f on g.log_id = f.log_id and g.seq >= f.seq")
def undo_gps_time(t: Tables) -> DataFrame:
    return rebuild.undo_gps_time(t.gps.withColumn("time", F.col("time") % 1000), t.frames).select("log_id", "seq", "time")


@query("select log_id, seq, 4294000000 + time as time from f")
def unwrap_time(t: Tables) -> DataFrame:
    wrapped = t.frames.withColumn("time", (F.col("time") + 4294000000) % rebuild.ROLLOVER)
    first = F.first(F.col("time") + 0).over(units.stream())
    over = F.when(F.col("first") < 10_000_000, rebuild.ROLLOVER).otherwise(0)
    return rebuild.unwrap_time(wrapped.select("log_id", "seq", "time")).withColumn(
        "first", F.first("time").over(units.stream())
    ).select("log_id", "seq", (F.col("time") + over).alias("time"))


@query("""select log_id, frame_type, count(*) filter (ok) as accepted, count(*) filter (not ok) as rejected from (
  select log_id, seq, frame_type, n % 1600 <> 700 and not (n % 1600 between 701 and 703) as ok from f) group by all""")
def accepted_frames(t: Tables) -> DataFrame:
    # a P frame that jumps far ahead spoils the stream up to the next I frame
    bad = t._all.withColumn(
        "loopIteration", F.when(F.col("n") % 1600 == 700, F.col("loopIteration") + 6000).otherwise(F.col("loopIteration"))
    )
    return rebuild.accepted_frames(rebuild.validate_frames(bad.select("log_id", "seq", "frame_type", "loopIteration", "time")))


# -- series and spectra ---------------------------------------------------------------------------

_DEC = """idx0 as (select log_id, seq, t_s, g0 as v, row_number() over (partition by log_id order by seq) - 1 as i, count(*)
  over (partition by log_id) as n from display),
bins as (select *, cast(len(list_filter(range(1, 500), lambda k: floor(k * (n / 500.0::double)) <= i)) as bigint) as bin from
  idx0),
dec as (select log_id, bin, any_value(n) as n, arg_min(t_s, i) as t0, arg_max(t_s, i) as t1, min(v) as low, max(v) as high from
  bins group by all)"""


@query(
    f""", {_DISPLAY}, {_DEC} select log_id, 'gyroADC[0]' as channel, 2 * bin as point, round(t0, 6) as t_s, round(low, 6) as v
  from dec where n > 1000 union all select log_id, 'gyroADC[0]', 2 * bin + 1, round(t1, 6), round(high, 6) from dec where n >
  1000 union all select log_id, 'gyroADC[0]', i, round(t_s, 6), round(v, 6) from idx0 where n <= 1000"""
)
def channel_series(t: Tables) -> DataFrame:
    return _rounded(series.channel_series(t.frames, t.config, ["gyroADC[0]"], 1000))


def _dft(source: str) -> str:
    """Spectra of the rows (log_id, channel, seq, v) of a query, summed out; segments of 1024 samples, or all of a shorter channel."""
    return f"""{_RATE}, series as ({source}), numbered as (select *, row_number() over (partition by log_id, channel order by
  seq) - 1 as i, count(*) over (partition by log_id, channel) as total from series),
  sized as (select *, least(total, 1024) as n, least(total, 1024) - least(total, 1024) // 2 as hop from numbered where total >=
  8),
  placed as (select *, unnest(range(cast(greatest(0, ceil((i - n + 1) / hop)) as bigint), least(i // hop, (total - n // 2) //
  hop - 1) + 1)) as s from sized),
  cut as (select log_id, channel, s, n, hop, i - s * hop as k, v - avg(v) over (partition by log_id, channel, s) as x from
  placed),
  tapered as (select c.log_id, channel, s, n, hop, fs, k, x * (0.5 - 0.5 * cos(2 * pi() * k / n)) as y, 0.5 - 0.5 * cos(2 *
  pi() * k / n) as w from cut c join rates using (log_id)),
  bins as (select *, unnest(range(least(n // 2, cast(floor(200 * n / fs) as bigint)) + 1)) as b from tapered),
  seg as (select log_id, channel, s, b, b * any_value(fs) / any_value(n) as freq, any_value(n) as n, any_value(hop) as hop,
  any_value(fs) as fs,
    (sum(y * cos(2 * pi() * b * k / n)) ** 2 + sum(y * sin(2 * pi() * b * k / n)) ** 2) / (any_value(fs) * sum(w * w)) * case
  when b = 0 or 2 * b = any_value(n) then 1 else 2 end as p from bins group by log_id, channel, s, b),
  psd as (select log_id, channel, b as bin, any_value(freq) as freq, avg(p) as psd from seg where freq <= 200 group by all)"""


def _band(low: float, high: float, name: str, source: str = "psd") -> str:
    return f"""{name} as (select log_id, channel, coalesce(sum(area), 0) as e from (select log_id, channel, (psd + lead(psd)
  over w) / 2 * (lead(freq) over w - freq) as area from {source}
      where freq between {low} and {high} window w as (partition by log_id, channel order by bin)) group by all)"""


_GYRO_ROWS = "select log_id, unnest(['gyroADC[0]', 'gyroADC[1]', 'gyroADC[2]']) as channel, seq, unnest([g0, g1, g2]) as v from display"
_ERROR_ROWS = "select log_id, axis as channel, seq, error as v from err"


@query(f", {_DISPLAY}, {_dft(_GYRO_ROWS)} select log_id, channel, bin, round(freq, 6) as freq, round(psd, 3) as psd from psd")
def power_spectrum(t: Tables) -> DataFrame:
    return series.power_spectrum(t.frames, t.config, _GYRO).select(
        "log_id", "channel", F.col("bin").cast("int").alias("bin"), F.round("freq", 6).alias("freq"),
        F.round("psd", 3).alias("psd")
    )


@query(f", {_DISPLAY}, {_dft(_GYRO_ROWS)}, {_band(30, 90, 'a')} select log_id, channel, round(e, 3) as energy from a")
def band_energy(t: Tables) -> DataFrame:
    return _rounded(series.band_energy(series.power_spectrum(t.frames, t.config, _GYRO), 30, 90), 3)


_MOTOR_ROWS = "select log_id, 'motor[0]' as channel, seq, cast(motor_0 as double) as v from f"


@query(f""", {_dft(_MOTOR_ROWS)}, n as (select log_id, max(s) + 1 as total from cut group by log_id),
  chosen as (select log_id, c as col, case when total <= 256 then c when c = 255 then total - 1 else cast(floor(c * ((total -
  1) / 255.0::double)) as bigint) end as s from (select *, unnest(range(least(total, 256))) as c from n))
  select log_id, cast(col as int) as col, round((s * hop + n / 2) / fs, 6) as time_s, cast(b as int) as bin, round(greatest(10
  * log10(p + 1e-30), -80), 4) as power_db from chosen join seg using (log_id, s) where freq <= 200""")
def spectrogram(t: Tables) -> DataFrame:
    out = series.spectrogram(t.frames, t.config, "motor[0]")
    return out.select(
        "log_id", F.col("column").cast("int").alias("col"), F.round("time_s", 6).alias("time_s"),
        F.col("bin").cast("int").alias("bin"), F.round("power_db", 4).alias("power_db")
    )


_ANALYSIS = f"""{_ERROR}, {_dft(_ERROR_ROWS)}, {_band(30, 90, 'wash')}, {_band(10, 150, 'noise')}, rms as (select log_id, axis,
  sqrt(avg(error * error)) as rms from err group by all)"""


_PEAK = "peaks as (select log_id, channel, arg_min(freq, (-psd, bin)) as peak_hz from psd where freq between 30 and 90 group by all)"
_JOINED = f"""{_ANALYSIS}, {_PEAK}, joined as (select rms.log_id, axis, rms, coalesce(wash.e, 0) as propwash_energy,
  coalesce(noise.e, 0) as noise_energy, case when noise.e > 0 then wash.e / noise.e else 0 end as propwash_ratio, peak_hz
  from rms left join wash on wash.log_id = rms.log_id and wash.channel = axis left join noise on noise.log_id = rms.log_id and
  noise.channel = axis left join peaks on peaks.log_id = rms.log_id and peaks.channel = axis)"""


@query(f""", {_BINNED.replace(_ERROR, _JOINED)}, texts as (select log_id, axis, string_agg(coalesce(cast(round(mean_abs_error *
  1000) as bigint)::varchar, '-'), ',' order by bin) as error_by_throttle from evt group by all)
  select log_id, axis, round(rms, 4) as rms, round(propwash_energy, 3) as propwash_energy, round(noise_energy, 3) as
  noise_energy, round(propwash_ratio, 4) as propwash_ratio, round(peak_hz, 4) as peak_hz, error_by_throttle from joined join
  texts using (log_id, axis)""")
def pid_error_analysis(t: Tables) -> DataFrame:
    out = series.pid_error_analysis(t.frames, t.config)
    by_throttle = F.array_join(F.transform("error_by_throttle", lambda e: F.round(e * 1000).cast("long").cast("string")), ",", "-")
    return out.select(
        "log_id", "axis",
        *(
            (F.round(c, n) + F.lit(0.0)).alias(c) for c,
            n in (("rms", 4), ("propwash_energy", 3), ("noise_energy", 3), ("propwash_ratio", 4), ("peak_hz", 4))
        ),
        by_throttle.alias("error_by_throttle")
    )


# -- steps and tuning -----------------------------------------------------------------------------

_SAMPLES = f"""{_DISPLAY}, {_RATE}, samples as (select log_id, axis, seq // 10 as idx, t_s, sp, gy, count(*) over (partition by
  log_id, axis) as n, fs from (
  select log_id, seq, t_s, unnest(['roll', 'pitch', 'yaw']) as axis, unnest([setpoint_0, setpoint_1, setpoint_2]) as sp,
  unnest([g0, g1, g2]) as gy from display) join rates using (log_id))"""
_MASK = f"""{_SAMPLES}, d0 as (select *, lead(sp) over (partition by log_id, axis order by idx) - sp as d, greatest(floor(0.02 *
  fs), 10) as gap from samples),
d1 as (select *, abs(d) >= 0.5 as raw from d0 where d is not null),
d2 as (select *, raw or coalesce(min(case when raw then idx end) over (partition by log_id, axis order by idx rows between
  current row and unbounded following) - max(case when raw then idx end) over (partition by log_id, axis order by idx rows
  unbounded preceding) - 1 < gap, false) as closed from d1),
mask as (select *, closed and idx >= floor(gap / 2) and idx <= n - 2 - (gap - 1 - floor(gap / 2)) as moving from d2)"""


@query(f", {_MASK} select log_id, axis, idx, moving from mask")
def motion_mask(t: Tables) -> DataFrame:
    return steps.motion_mask(saved(steps.axis_samples(t.frames, t.config))).select(
        "log_id", "axis", F.col("idx").cast("long").alias("idx"), "moving"
    )


_RUNS = f"""{_MASK}, numbered as (select *, sum(case when moving and not coalesce(before, false) then 1 else 0 end) over
  (partition by log_id, axis order by idx) as run from (select *, lag(moving) over (partition by log_id, axis order by idx) as
  before from mask)),
runs as (select log_id, axis, run, min(idx) as s, max(idx) + 1 as e, cast(-max(struct_pack(a := abs(d), b := -idx)).b as
  bigint) as edge, any_value(n) as n, any_value(fs) as fs, greatest(floor(0.15 * any_value(fs)), 4) as settle from numbered
  where moving group by all),
levels as (select r.log_id, r.axis, r.run, median(sp) filter (idx < s) as baseline, median(sp) filter (idx >= e) as target from
  runs r join samples x on x.log_id = r.log_id and x.axis = r.axis and (x.idx between s - settle and s - 1 or x.idx between e
  and e + settle - 1) group by all)"""


@query(f", {_RUNS} select log_id, axis, s as start, e as stop, edge, baseline, target from runs join levels using (log_id, axis, run)")
def step_levels(t: Tables) -> DataFrame:
    samples = saved(steps.axis_samples(t.frames, t.config))
    out = steps.step_levels(saved(steps.motion_runs(steps.motion_mask(samples))), samples)
    return out.select(
        "log_id", "axis", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"),
        F.col("edge").cast("long").alias("edge"), "baseline", "target"
    )


_STEPS = f"""{_RUNS}, large as (select log_id, axis, r.edge, r.n, r.fs, baseline, target, greatest(0, edge - cast(floor(0.2 *
  fs) as bigint)) as lo, least(n, edge + 1 + cast(floor(0.8 * fs) as bigint)) as hi,
    row_number() over (partition by log_id, axis order by s) as k from runs r join levels using (log_id, axis, run)
    where abs(target - baseline) >= case axis when 'yaw' then 50 else 100 end and least(n, edge + 1 + floor(0.8 * fs)) -
  greatest(0, edge - floor(0.2 * fs)) >= 8 and least(n, edge + 1 + floor(0.8 * fs)) > edge + 1),
  follow as (select a.log_id, a.axis, a.k, min(b.k) as next from large a left join large b on b.log_id = a.log_id and b.axis =
  a.axis and b.k > a.k and b.edge >= a.hi group by all),
  taken as (select log_id, axis, k, 0 as step_no from large where k = 1 union all select t.log_id, t.axis, f.next, t.step_no +
  1 from taken t join follow f on f.log_id = t.log_id and f.axis = t.axis and f.k = t.k where f.next is not null and t.step_no <
  49),
  steps as (select * from taken join large using (log_id, axis, k)),
  win as (select c.log_id, c.axis, c.step_no, c.edge, c.hi, c.fs, baseline, target, x.idx, x.t_s, x.sp, x.gy, max(case when
  x.idx = c.edge then x.t_s end) over (partition by c.log_id, c.axis, c.step_no) as t0
    from steps c join samples x on x.log_id = c.log_id and x.axis = c.axis and x.idx >= c.lo and x.idx < c.hi)"""
_METRICS = f"""{_STEPS}, judged as (select *, target - baseline as mag, (gy - baseline) / (target - baseline) as reached, idx >
  edge and abs(sp - target) <= abs(target - baseline) * 0.25 + 5 as near,
    idx > edge and abs(gy - target) > greatest(abs(target - baseline) * 0.10, 5) as outside from win),
  one as (select log_id, axis, step_no, any_value(fs) as fs, any_value(edge) as edge, any_value(hi) as hi, any_value(t0) as t0,
  any_value(mag) as mag, any_value(baseline) as baseline, any_value(target) as target,
    min(idx) filter (case when mag > 0 then gy >= baseline + 0.1::double * mag else gy <= baseline + 0.1::double * mag end) as
  i10, min(idx) filter (case when mag > 0 then gy >= baseline + 0.9::double * mag else gy <= baseline + 0.9::double * mag end)
  as i90,
    min(idx) filter (idx >= edge and case when mag > 0 then gy >= baseline + 0.1::double * mag else gy <= baseline +
  0.1::double * mag end) as ilat, max(idx) filter (outside) as iout,
    max(gy) filter (near and mag > 0) as high, min(gy) filter (near and mag < 0) as low from judged group by all),
  peaks as (select o.*, coalesce(high, low, target) as peak, (select min(j.idx) from judged j where j.log_id = o.log_id and
  j.axis = o.axis and j.step_no = o.step_no and j.near and j.gy = coalesce(high, low)) as ipeak from one o),
  metrics as (select log_id, axis, step_no, t0, mag as step_mag, baseline, target, case when mag > 0 then peak - target else
  target - peak end / abs(mag) * 100 as overshoot_pct, (peak - baseline) / mag as peak_normalized,
    coalesce((i90 - i10) / fs * 1000, 0) as rise_time_ms, coalesce((ilat - edge) / fs * 1000, 0) as latency_ms, coalesce((ipeak
  - edge) / fs * 1000, 0) as peak_time_ms,
    case when iout is null then 0 when iout < hi - 1 then (iout - edge) / fs end as settle_time_s from peaks)"""
_TRACES = f"""{_STEPS}, times as (select *, t_s - t0 as dt from win), pairs as (select *, lead(dt) over w as dt1, lead(sp) over
  w as sp1, lead(gy) over w as gy1 from times window w as (partition by log_id, axis, step_no order by idx)),
  traces as (select log_id, axis, step_no, g.range as t_ms, baseline, target, case when g.range / 1000.0::double = dt then sp
  else sp + (sp1 - sp) / (dt1 - dt) * (g.range / 1000.0::double - dt) end as setpoint,
    case when g.range / 1000.0::double = dt then gy else gy + (gy1 - gy) / (dt1 - dt) * (g.range / 1000.0::double - dt) end as
  gyro
    from pairs join range(-50, 501) g on g.range / 1000.0::double >= dt and (g.range / 1000.0::double < dt1 or dt1 is null and
  g.range / 1000.0::double = dt))"""
_METRIC_NAMES = (
    "t0", "step_mag", "baseline", "target", "overshoot_pct", "peak_normalized", "rise_time_ms", "latency_ms", "peak_time_ms",
    "settle_time_s"
)


@query(f", {_METRICS} select log_id, axis, step_no, {', '.join(f'round({c}, 6) as {c}' for c in _METRIC_NAMES)} from metrics")
def detect_steps(t: Tables) -> DataFrame:
    return _rounded(steps.detect_steps(t.frames, t.config)[0])


@query(f", {_TRACES} select log_id, axis, step_no, t_ms, round(setpoint, 5) as setpoint, round(gyro, 5) as gyro from traces")
def step_traces(t: Tables) -> DataFrame:
    return _rounded(steps.step_traces(steps.detect_steps(t.frames, t.config)[1]), 5)


@query(
    f""", {_TRACES} select log_id, axis, t_ms, round(avg((gyro - baseline) / (target - baseline)), 6) as response, any_value(n)
  as n_traces from traces join (select log_id, axis, count(*) as n from steps group by all) using (log_id, axis) group by
  log_id, axis, t_ms"""
)
def average_step_response(t: Tables) -> DataFrame:
    return _rounded(steps.average_step_response(steps.detect_steps(t.frames, t.config)[1]))


_GAINS = """gains as (select log_id, unnest(['roll', 'pitch', 'yaw']) as axis, unnest([p_roll, p_pitch, p_yaw]) as p,
  unnest([i_roll, i_pitch, i_yaw]) as i, unnest([d_roll, d_pitch, d_yaw]) as d, unnest([dmin_roll, 0, 0]) as d_min,
  unnest([ff_roll, 0, 0]) as f from cfg)"""


@query(
    f""", {_METRICS}, {_GAINS} select m.*, p, i, d, d_min, g.f from (select log_id, axis, count(*) as count,
  {', '.join(f'round(median({c}), 6) as median_{c}' for c in ('peak_normalized', 'latency_ms', 'rise_time_ms', 'overshoot_pct'))}
  from metrics group by all) m left join gains g using (log_id, axis)"""
)
def step_summary(t: Tables) -> DataFrame:
    return _rounded(steps.step_summary(steps.detect_steps(t.frames, t.config)[0], t.config))


# -- findings: each rule's rows in full; those of the derived frames are too quiet for some, so noisy frames are judged


def _set_sql(name: str, value: str, percent: int) -> str:
    factor = 1 + percent / 100
    return f"case when {value} > 0 then 'set ' || {name} || ' = ' || cast(round_even({value} * {factor!r}::double, 0) as int) end"


def _cli(*commands: str) -> str:
    return f"concat_ws(';', {', '.join(commands)})"


def _filter(kind: str) -> str:
    """The command for the second low-pass, or the first if there is none."""
    second, first = f"{kind}_lpf2_static_hz", f"{kind}_lpf1_static_hz"
    return f"case when {second} > 0 then {_set_sql(repr(second), second, -20)} else {_set_sql(repr(first), first, -20)} end"


_P_GAIN, _D_GAIN = ("case axis when 'roll' then {0}_roll when 'pitch' then {0}_pitch else {0}_yaw end".format(x) for x in "pd")
_PERCENT = "cast(cast(round_even({} * 100, 0) as bigint) as varchar)"
_SHARES = "{0}s as (select log_id, channel, a.e / nullif(b.e, 0) as ratio from {1} a join {2} b using (log_id, channel) where b.e > 0)"
_D_ROWS = "select log_id, unnest(['axisD[0]', 'axisD[1]']) as channel, seq, unnest([cast(axisD_0 as double), cast(axisD_1 as double)]) as v from f"
_AXIS_OF = "['roll', 'pitch', 'yaw'][cast(regexp_extract(channel, '\\[(\\d)\\]', 1) as int) + 1]"

_WASH_FOUND = f"""select log_id, axis, 'propwash' as category, case when propwash_ratio > 0.35 then 'high' else 'medium' end as
  severity, axis || ': propwash oscillation' as title,
  'tracking error between 30 and 90 Hz: ' || {_PERCENT.format('propwash_ratio')} || ' % of its energy, peak near ' ||
  cast(cast(round(coalesce(peak_hz, 0)) as bigint) as varchar) || ' Hz' as detail,
  'Raise D by about 12 %, or lower P a little.' as action,
  {_cli(_set_sql("'d_' || axis", _D_GAIN, 12), _set_sql("'p_' || axis", _P_GAIN, -8))} as cli, 1 as rule_no from joined join cfg
  using (log_id) where propwash_ratio >= 0.20 and rms >= 10"""
_THROTTLE_FOUND = f"""select log_id, axis, 'noise_throttle' as category, 'medium' as severity, axis ||
  ': noise rises with throttle' as title,
  'mean error rises by ' || cast(cast(round(slope) as bigint) as varchar) || ' deg/s over full throttle' as detail,
  'Check propeller balance and motor bearings; filter the gyro more, or lower D.' as action,
  {_cli(_set_sql("'d_' || axis", _D_GAIN, -10), _filter('gyro'))} as cli, 2 as rule_no
  from (select log_id, axis, regr_slope(mean_abs_error, throttle) as slope, count(*) as n from evt where mean_abs_error is not
  null group by all) join cfg using (log_id) where n >= 4 and slope > 25"""
_GYRO_FOUND = f"""select log_id, axis, 'gyro_hf_noise' as category, 'medium' as severity, axis || ': gyro noise' as title,
  {_PERCENT.format('ratio')} || ' % of the gyro''s energy lies above 100 Hz' as detail,
  'Filter the gyro more (cut-off down by about 20 %), or lower D.' as action, {_cli(_filter('gyro'))} as cli, 3 as rule_no from
  (select *, {_AXIS_OF} as axis from gyros) join cfg using (log_id) where ratio > 0.25"""
_DTERM_FOUND = f"""select log_id, axis, 'dterm_hf' as category, 'medium' as severity, axis || ': D-term noise' as title,
  {_PERCENT.format('ratio')} || ' % of the D-term''s energy lies above 100 Hz; d_' || axis || ' is ' || ({_D_GAIN}) as detail,
  'Lower D by about 15 %, or filter the D-term more.' as action,
  {_cli(_set_sql("'d_' || axis", _D_GAIN, -15), _filter('dterm'))} as cli, 4 as rule_no from (select *, {_AXIS_OF} as axis from
  dterms) join cfg using (log_id) where ratio > 0.30"""
_MOTOR_FOUND = f"""select log_id, cast(null as varchar) as axis, 'motor_saturation' as category, 'high' as severity,
  'motor output near its limit' as title, 'motor output peaks at ' || m || ', its limit is ' || motor_output_high as detail,
  'Lower P of roll and pitch by about 10 %; check that motors and propellers match.' as action,
  {_cli(_set_sql("'p_roll'", 'p_roll', -10), _set_sql("'p_pitch'", 'p_pitch', -10))} as cli, 5 as rule_no
  from (select log_id, max(greatest(motor_0, motor_1, motor_2, motor_3)) as m from f group by log_id) join cfg using (log_id)
  where motor_output_high > 0 and m >= motor_output_high * 0.98"""
_GYRO_SHARES = f"{_dft(_GYRO_ROWS)}, {_band(100, 150, 'high')}, {_band(10, 150, 'total')}, {_SHARES.format('gyro', 'high', 'total')}"
_DTERM_SHARES = f"{_dft(_D_ROWS)}, {_band(100, 200, 'high')}, {_band(10, 200, 'total')}, {_SHARES.format('dterm', 'high', 'total')}"


def _found_rows(found: DataFrame) -> DataFrame:
    return found.withColumn("cli", F.array_join("cli", ";"))


@query(_MOTOR_FOUND)
def rule_motor_saturation(t: Tables) -> DataFrame:
    return _found_rows(tuning.rule_motor_saturation(stats.motor_peak(t.frames, t.config), t.config))


@query(f", {_BINNED} {_THROTTLE_FOUND}", noisy=True)
def rule_noise_throttle(t: Tables) -> DataFrame:
    slopes = stats.throttle_slope(stats.error_vs_throttle(units.to_display_units(t.frames, t.config)))
    return _found_rows(tuning.rule_noise_throttle(slopes, t.config))


@query(f", {_DISPLAY}, {_GYRO_SHARES} {_GYRO_FOUND}", noisy=True)
def rule_gyro_hf(t: Tables) -> DataFrame:
    return _found_rows(tuning.rule_gyro_hf(series.power_spectrum(t.frames, t.config, _GYRO), t.config))


@query(f", {_DTERM_SHARES} {_DTERM_FOUND}")
def rule_dterm_hf(t: Tables) -> DataFrame:
    return _found_rows(tuning.rule_dterm_hf(series.power_spectrum(t.frames, t.config, _AXIS_D), t.config))


@query(f", {_JOINED} {_WASH_FOUND}")
def rule_propwash(t: Tables) -> DataFrame:
    return _found_rows(tuning.rule_propwash(series.pid_error_analysis(t.frames, t.config), t.config))


def _scoped(ctes: str, found: str) -> str:
    """A rule's SQL with its own named steps, as a subquery."""
    return f"select * from (with {ctes} {found})"


_ALL_FOUND = " union all ".join(
    [
        _scoped(_JOINED, _WASH_FOUND), _scoped(_BINNED, _THROTTLE_FOUND), _scoped(f"{_DISPLAY}, {_GYRO_SHARES}", _GYRO_FOUND),
        _scoped(_DTERM_SHARES, _DTERM_FOUND), f"select * from ({_MOTOR_FOUND})"
    ]
)


@query(f""", found as ({_ALL_FOUND}) select * exclude (rule_no), row_number() over (partition by log_id order by case severity
  when 'high' then 0 when 'medium' then 1 else 2 end,
  case when rule_no <= 2 then list_position(['roll', 'pitch', 'yaw'], axis) else 9 end, rule_no, list_position(['roll',
  'pitch', 'yaw'], axis)) as rank from found""", noisy=True)
def diagnose(t: Tables) -> DataFrame:
    return _found_rows(tuning.diagnose(t.frames, t.config)).drop("rule_no")


# -- reconciliation -------------------------------------------------------------------------------


def _golden(t: Tables) -> DataFrame:
    return t._all.withColumns(
        {"setpoint_0": F.col("setpoint_0") + F.when(F.col("e") % 1009 == 0, 1).otherwise(0), "vbatLatest": F.col("vbatLatest") / 100.0}
    )


def _diff(t: Tables) -> DataFrame:
    return reconcile.reconcile(t.frames, _golden(t), ["setpoint_0", "vbatLatest", "motor_1"])


_FACTORS = """(values ('raw', 1.0::double, 1), ('x0.01', 0.01::double, 2), ('x0.1', 0.1::double, 3), ('x10', 10.0::double, 4),
  ('x100', 100.0::double, 5)) as k(scaling, factor, rank)"""
_DIFF = f"""diff as (select *, abs(ours * factor - golden) as diff, coalesce(abs(ours * factor - golden) > 0.01, true) as bad
  from (select log_id, seq // 10 as row, time, unnest(['setpoint_0', 'vbatLatest', 'motor_1']) as col,
  unnest([setpoint_0, vbatLatest, motor_1]::double[]) as ours, unnest([setpoint_0 + case when e % 1009 = 0 then 1 else 0 end,
  vbatLatest / 100.0::double, motor_1]::double[]) as golden from f), {_FACTORS}),
best as (select * from (select log_id, col, scaling, count(*) filter (bad) as mismatches, max(diff) as max_diff, min(case when
  bad then row end) as first_row, min(case when bad then time end) as first_time, max(case when bad then time end) as last_time,
  any_value(rank) as rank from diff group by all) qualify row_number() over (partition by log_id, col order by mismatches, rank)
  = 1)"""


@query(
    f""", {_DIFF} select log_id, col as \"column\", scaling, mismatches, round(max_diff, 6) as max_diff, first_row, first_time,
  last_time, mismatches = 0 as ok, bool_and(mismatches = 0) over (partition by log_id) as all_ok from best"""
)
def reconcile_summary(t: Tables) -> DataFrame:
    return _rounded(reconcile.reconcile_summary(_diff(t)))


@query(
    f""", {_DIFF} select d.log_id, d.col as \"column\", d.scaling, d.row, case when loopIteration % frame_interval_i = 0 then
  'I' else 'P' end as kind, round(d.ours, 6) as ours, round(d.golden, 6) as golden, d.bad from best b join diff d on d.log_id =
  b.log_id and d.col = b.col and d.scaling = b.scaling and d.row between first_row - 3 and first_row + 3 join f on f.log_id =
  d.log_id and f.seq = d.row * 10 join cfg on cfg.log_id = d.log_id"""
)
def mismatch_context(t: Tables) -> DataFrame:
    pairs = _diff(t)
    out = reconcile.mismatch_context(pairs, reconcile.reconcile_summary(pairs), t.frames, t.config)
    return _rounded(out.drop("first_row"))


# -- sources and streams --------------------------------------------------------------------------

_MARKER = "H Product:"
_SECTION_TEXT = "'{m} recorder' || chr(10) || 'H I interval:' || {c} || chr(10) || 'H P interval:1/' || ({s} + 2) || chr(10) || 'H rollPID:' || ({c} % 90) || ',40,' || {s} || chr(10) || repeat('x', {c} % 61)"


def _log_files(t: Tables, text: str = _SECTION_TEXT) -> DataFrame:
    """One file per log, with a section for each 500 frames."""
    text = text.format(m=_MARKER, c="cast(c as string)", s="s")
    sections = t._all.groupBy("log_id", F.expr("n div 500").alias("s")).agg(F.count("*").alias("c")).withColumn("text", F.expr(text))
    parts = F.array_sort(F.collect_list(F.struct("s", "text")))
    return sections.groupBy(F.col("log_id").alias("path")).agg(
        F.encode(F.array_join(F.transform(parts, lambda p: p["text"]), ""), "UTF-8").alias("content")
    )


_SECTIONS = f"""secs as (select log_id as path, s, c, {_SECTION_TEXT.format(m=_MARKER, c="c", s="s")} as text from (select
  log_id, n // 500 as s, count(*) as c from f group by all)),
placed as (select *, cast(sum(length(text)) over (partition by path order by s) as bigint) as stop from secs)"""
_SECTION_ENDS = "ends as (select path, count(*) as number, max(stop) as stop from placed group by path)"
_HEADER_ROWS = """path || '#' || s as log_id, unnest(['Product', 'I interval', 'P interval', 'rollPID']) as field_name,
  unnest([' recorder', cast(c as varchar), '1/' || (s + 2), (c % 90) || ',40,' || s]) as field_value"""


@query(f", {_SECTIONS} select path, s as section_no, stop - length(text) as start_offset, length(text) as size from placed")
def section_listing(t: Tables) -> DataFrame:
    from skylog import sources

    return sources.section_listing(
        sources.split_sections(_log_files(t), _MARKER)
    ).withColumn("section_no", F.col("section_no").cast("long"))


@query(
    f""", {_SECTIONS} select path || '#' || s as log_id, unnest(['Product', 'I interval', 'P interval', 'rollPID']) as
  field_name, unnest([' recorder', cast(c as varchar), '1/' || (s + 2), (c % 90) || ',40,' || s]) as field_value from placed"""
)
def parse_headers(t: Tables) -> DataFrame:
    from skylog import sources

    return sources.parse_headers(sources.split_sections(_log_files(t), _MARKER)).drop("line_no")


@query(
    f""", {_SECTIONS} select path || '#' || s as log_id, c as frame_interval_i, 1 as p_num, s + 2 as p_denom, (c % 90) || ',40,'
  || s as pid_roll, '0,0,0' as pid_yaw, 110 as vbatscale, 1.0::double as gyro_scale, 1150 as motor_output_low, 1850 as
  motor_output_high, 33 as vbatmincellvoltage, 43 as vbatmaxcellvoltage, 0 as current_meter_offset, 400 as current_meter_scale,
  0 as gyro_lpf1_static_hz, 1 as acc_1g, 4095 as vbatref, 0 as firmware_type, '' as fc_version from placed"""
)
def sys_config(t: Tables) -> DataFrame:
    from skylog import sources

    out = sources.sys_config(sources.parse_headers(sources.split_sections(_log_files(t), _MARKER)))
    return out.select(
        "log_id", "frame_interval_i", "p_num", "p_denom", F.array_join("pid_roll", ",").alias("pid_roll"),
        F.array_join("pid_yaw", ",").alias("pid_yaw"), "vbatscale", "gyro_scale", "motor_output_low", "motor_output_high",
        "vbatmincellvoltage", "vbatmaxcellvoltage", "current_meter_offset", "current_meter_scale", "gyro_lpf1_static_hz",
        "acc_1g", "vbatref", "firmware_type", "fc_version"
    )


_TYPES = ["", "Cleanflight", "Betaflight", "Baseflight"]
_FIELD_LINES = "H Field I name:loopIteration,time,axisP[0]' || chr(10) || 'H Field I signed:0,0,1' || chr(10) || 'H Field I predictor:0,0,' || ({s} % 3) || chr(10) || 'H Field I encoding:1,1,0' || chr(10) || 'H Field P predictor:6,2,1' || chr(10) || 'H Field P encoding:9,0,0' || chr(10) || 'H Field G name:time,GPS_coord[0],GPS_coord[1]' || chr(10) || 'H Field G signed:0,1,1' || chr(10) || 'H Field G predictor:10,7,7' || chr(10) || 'H Field G encoding:1,0,0"
#: Sections whose firmware type, its place, revision and gyro scale vary with their number.
_TYPED_TEXT = (
    "'{m} recorder' || chr(10) || case {s} % 4 when 1 then 'H Firmware type:Cleanflight' || chr(10) when 2 then 'H Firmware type:Betaflight' || chr(10) else '' end || 'H gyro_scale:0x3f800000' || chr(10)"
    " || case {s} % 4 when 3 then 'H Firmware type:Baseflight' || chr(10) else '' end || 'H Firmware revision:' || case {s} % 2 when 0 then 'Betaflight' else 'Other' end || ' 4.' || {s} || '.1 (x)' || chr(10) || '" + _FIELD_LINES + "' || chr(10) || repeat('x', {c} % 61)"
)


def _typed_headers(t: Tables) -> DataFrame:
    from skylog import sources

    return sources.parse_headers(sources.split_sections(_log_files(t, _TYPED_TEXT), _MARKER))


@query("""select log_id || '#' || s as log_id, case s % 4 when 0 then 0 when 1 then 2 else 1 end as firmware_type, round(case
  when s % 4 = 2 then 1 else radians(1) * 1e-6 end, 12) as gyro_scale,
  case when s % 2 = 0 then '4.' || s || '.1' else '' end as fc_version, 32 as frame_interval_i from (select distinct log_id, n
  // 500 as s from f)""")
def sys_config_of_types(t: Tables) -> DataFrame:
    from skylog import sources

    return sources.sys_config(_typed_headers(t)).select(
        "log_id", "firmware_type", F.round("gyro_scale", 12).alias("gyro_scale"), "fc_version", "frame_interval_i"
    )


@query("""select log_id || '#' || s as log_id, x.* replace (case when frame_type = 'I' and field_index = 2 then s % 3 else
  predictor end as predictor) from (select distinct log_id, n // 500 as s from f), (values
  ('I', 0, 'loopIteration', 0, 0, 1), ('I', 1, 'time', 0, 0, 1), ('I', 2, 'axisP[0]', 1, 0, 0), ('P', 0, 'loopIteration', 0, 6,
  9), ('P', 1, 'time', 0, 2, 0), ('P', 2, 'axisP[0]', 1, 1, 0),
  ('G', 0, 'time', 0, 10, 1), ('G', 1, 'GPS_coord[0]', 1, 7, 0), ('G', 2, 'GPS_coord[1]', 1, 256, 0)) as x(frame_type,
  field_index, name, signed, predictor, encoding)""")
def field_defs(t: Tables) -> DataFrame:
    from skylog import sources

    return sources.field_defs(_typed_headers(t))


@query(
    f""", {_SECTIONS} select log_id, path, section_no, size from (select path || '#' || s as log_id, path, s as section_no,
  length(text) as size from placed) where section_no = 0"""
)
def pick_section(t: Tables) -> DataFrame:
    from skylog import sources

    picked = sources.pick_section(sources.split_sections(_log_files(t), _MARKER), 0)
    return picked.select(
        "log_id", "path", F.col("section_no").cast("long").alias("section_no"), F.length("body").cast("long").alias("size")
    )


@query(
    """select log_id, seq, cast(loopIteration as double) as loopIteration, cast(time as double) as time, vbatLatest /
  100.0::double as vbatLatest, cast(motor_1 as double) as motor_1, frame_type from f"""
)
def frames_csv(t: Tables) -> DataFrame:
    """The frames written as CSV with units in their names, and read again."""
    from skylog import sources

    path = f"{_shared_folder(t.spark)}/frames-{uuid.uuid4().hex}"
    rows = t.frames.select(
        "log_id", "seq", "loopIteration", "time", (F.col("vbatLatest") / 100.0).alias("vbatLatest"), "motor_1", "frame_type"
    )
    sources.write_frames(rows, path, "csv", {"time": "us", "vbatLatest": "V"})
    return sources.read_frames_csv(t.spark, path)


@query(f""", {_SECTIONS}, {_SECTION_ENDS} select path, s as section_no, stop - length(text) as start_offset, length(text) as size from placed
  union all select path, number, stop, length('{_MARKER}') from ends""")
def log_sections(t: Tables) -> DataFrame:
    """The sections of written log files, read in byte ranges; a marker ends each file."""
    from skylog import sources

    path = f"{_shared_folder(t.spark)}/logs-{uuid.uuid4().hex}"
    text = F.expr(_SECTION_TEXT.format(m=_MARKER, c="cast(c as string)", s="s"))
    counts = t._all.groupBy("log_id", F.expr("n div 500").alias("s")).agg(F.count("*").alias("c"))
    lines = counts.select("log_id", "s", F.substring_index(text, _MARKER, -1).alias("value"))
    lines = lines.unionByName(counts.select("log_id").distinct().select("log_id", F.lit(-1).cast("long").alias("s"), F.lit("").alias("value")))
    lines.repartition("log_id").sortWithinPartitions("log_id", "s").select("log_id", "value").write.partitionBy("log_id").option("lineSep", _MARKER).text(path)
    return sources.section_listing(sources.read_log_sections(t.spark, path, _MARKER)).select(
        F.regexp_extract("path", "log_id=([^/]+)", 1).alias("path"), F.col("section_no").cast("long").alias("section_no"), "start_offset", "size"
    )


@query(f", {_SECTIONS} select {_HEADER_ROWS} from placed")
def headers_csv(t: Tables) -> DataFrame:
    """The headers written as CSV and read again."""
    from skylog import sources

    path = f"{_shared_folder(t.spark)}/headers-{uuid.uuid4().hex}"
    sources.write_headers_csv(sources.parse_headers(sources.split_sections(_log_files(t), _MARKER)), path)
    return sources.read_headers_csv(t.spark, path)


@query("""select log_id, cast(time as double) as time, cast(GPS_numSat as double) as GPS_numSat, cast(GPS_coord_0 as double) as GPS_coord_0,
  cast(GPS_altitude as double) as GPS_altitude from gps""")
def gps_csv(t: Tables) -> DataFrame:
    """The GPS rows written as CSV and read again."""
    from skylog import sources

    path = f"{_shared_folder(t.spark)}/gps-{uuid.uuid4().hex}"
    sources.write_gps_csv(t.gps.drop("GPS_coord_1", "GPS_speed", "GPS_ground_course"), path, {"time": "us", "GPS_altitude": "m"})
    return sources.read_frames_csv(t.spark, path)


@query("""select log_id, time, case event_type when 0 then 'Sync beep' when 13 then 'Inflight adjustment' when 14 then 'Logging resume' else
  'Log clean end' end as name, case when event_type = 13 then case when adjustment_function > 127 then float_value else cast(int_value as
  double) end end as value, case when event_type = 14 then log_iteration end as log_iteration from ev""")
def events_json(t: Tables) -> DataFrame:
    """The events written as JSON lines and read again."""
    from skylog import sources

    path = f"{_shared_folder(t.spark)}/events-{uuid.uuid4().hex}"
    sources.write_events_json(units.decode_events(t.events), path)
    back = t.spark.read.schema("log_id string, name string, time long, data struct<value: double, log_iteration: long>").json(path)
    return back.select("log_id", "time", "name", "data.value", "data.log_iteration")


@query(f", {_RATE}, {_MOTOR_HZ} select log_id, round(fs, 6) as sample_rate, round(hz, 6) as motor_hz, round(2 * hz, 6) as second, round(3 * hz, 6) as third from rates join motor_hz using (log_id)")
def spectrum_info(t: Tables) -> DataFrame:
    at = lambda k: F.element_at("harmonics", k)
    return _rounded(series.spectrum_info(t.frames).select("log_id", "sample_rate", "motor_hz", at(2).alias("second"), at(3).alias("third")))


@query(f", {_METRICS} select log_id, axis, step_no, {', '.join(f'round({c}, 6) as {c}' for c in _METRIC_NAMES)} from metrics where step_no < 1")
def first_steps(t: Tables) -> DataFrame:
    """No more than one step of each axis; without the limit there are two."""
    return _rounded(steps.detect_steps(t.frames, t.config, max_steps=1)[0])


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session makes one of its own where it names none."""
    import re
    import tempfile

    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if shared is None:
        shared = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files that come in: each micro-batch runs a batch job and its rows are kept under the batch's number."""
    from skylog import streaming

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/[e]vents.parquet")
    job = lambda batch: batch.groupBy(F.col("event_type").alias("log_id")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    folder = f"{_shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    streaming.ingest(feed, job, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("log_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


QUERIES["ingest"] = ingest
SQL["ingest"] = "select event_type as log_id, count(*) as n, max(event_id) as last from events group by event_type"


def live_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a feed of frames, followed to its present end."""
    from skylog.streaming import live_limits as follow

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    feed = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").selectExpr(
        "event_type as log_id", "event_id as seq", "event_id * 1000 as time", "value", "user_id"
    )
    folder = f"{_shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    done = follow(feed, ["value", "user_id"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy("log_id", "channel").agg(*(F.max_by(c, "n").alias(c) for c in ("time", "min", "max")), F.max("n").alias("n"))


QUERIES["live_limits"] = live_limits
SQL["live_limits"] = """select event_type as log_id, unnest(['value', 'user_id']) as channel, max(event_id) * 1000 as time,
  unnest([min(value), cast(min(user_id) as double)]) as min,
  unnest([max(value), cast(max(user_id) as double)]) as max, count(*) as n from events group by event_type"""
