"""Frame tables derived from the events table: one log for each event type, in Spark and as SQL.

Both are made from the same expressions, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylog.operators.scan import positions

_P, _N = "(n % 2600)", "n"
_STEPS = ((15, 300), (12, 240), (6, 120))


def _setpoint(k: int) -> str:
    s, h = _STEPS[k]
    return f"least(greatest(({_P} - 500) * {s}, 0), {h}) - least(greatest(({_P} - 1500) * {s}, 0), {h})"


#: name: expression over e (event id), u (user), n (row of the log), value; in both dialects.
_FIRST = {f"setpoint_{k}": _setpoint(k) for k in range(3)}
_FIELDS = {
    "frame_type": "case when n % 32 = 0 then 'I' else 'P' end",
    **{f"axisD_{k}": f"(e * 31 + {17 * k}) % 201 - 100" for k in range(3)},
    "rcCommand_3": "1000 + (e * 7919) % 1001",
    **{f"motor_{k}": f"1000 + (37 * u + e + {11 * k}) % 1001" for k in range(4)},
    **{f"eRPM_{k}": f"(3 * u + {5 * k}) % 400" for k in range(4)},
    "vbatLatest": "1680 - n {div} 100", "amperageLatest": "500 + e % 300",
    **{f"accSmooth_{k}": f"(e * 13 + {7 * k}) % 4097 - 2048" for k in range(3)},
}
_GYRO = {
    f"gyroADC_{k}": f"""coalesce(lag(setpoint_{k}, 5) over (partition by log_id order by seq), 0) + cast(floor(value) as bigint)
  % 21 - 10""" for k in range(3)
}


#: The same without a window: a setpoint depends on the place alone, so the one of 5 rows ago is that of n - 5.
_GYRO_BY_PLACE = {
    f"gyroADC_{k}": f"""case when n >= 5 then {_setpoint(k).replace(_P, "((n - 5) % 2600)")} else 0 end + cast(floor(value) as bigint)
  % 21 - 10""" for k in range(3)
}
_NUMBERED = """(
            select event_type, event_id as e, user_id as u, value, cast(row_number() over (partition by event_type order by
  event_id) - 1 as bigint) as n from {events})"""


def frames_sql(div: str, numbered: str, gyro: dict[str, str] = _GYRO) -> str:
    long = lambda d: ", ".join(f"{x if n == 'frame_type' else f'cast({x} as bigint)'} as {n}" for n, x in d.items()).replace("{div}", div)
    return f"""
      select log_id, seq, e, u, n, loopIteration, time, {", ".join([*_FIELDS, *_FIRST])}, {long(gyro)} from (
        select *, 1000000 + 1000 * loopIteration + e % 7 as time, {long(_FIELDS)}, {long(_FIRST)} from (
          select event_type as log_id, 10 * n as seq, e, u, n, value, n + 3 * (n {div} 500) as loopIteration from {numbered} a) b) c"""


_SLOW = "select log_id, seq + 5 as seq, u % 2048 as flightModeFlags, u % 32 as stateFlags, u % 6 as failsafePhase from f where e % 97 = 0"
_GPS = """select log_id, seq + 2 as seq, time + case when e % 2 = 1 then 400 else 0 end as time, u % 12 as GPS_numSat, 473000000
  + 10 * e as GPS_coord_0,
  -(85000000 + 7 * e) as GPS_coord_1, e % 3000 as GPS_altitude, e % 2500 as GPS_speed, e % 3600 as GPS_ground_course from f
  where e % 53 = 0"""
_EVENTS = """select log_id, seq + 7 as seq, case (e {div} 211) % 4 when 0 then 0 when 1 then 13 when 2 then 14 else 255 end as
  event_type, time,
  cast(u % 160 as int) as adjustment_function, e % 77 as int_value, cast(e % 13 as double) / 2 as float_value, loopIteration as
  log_iteration from f where e % 211 = 0"""
_INDEX = """select log_id, seq, frame_type, 20 + e % 30 as size_bytes, case when e % 499 = 0 then 'corrupt' when e % 251 = 0
  then 'desync' else 'valid' end as status from f"""
_CONFIG = """select *, radians(1) * 1e-6 as gyro_scale from (values
  ('click', '4.1.0', 32, 1, 1, 1070, 2000, 2048, 250, 400, 55, 42, 85, 35, 46, 90, 38, 45, 80, 0, 100, 150, 0, 0, 110, 161, 43),
  ('error', '4.2.9', 32, 1, 2, 1070, 0, 0, 0, 250, 60, 40, 80, 30, 50, 80, 40, 40, 70, 2, 0, 0, 0, 0, 110, 161, 43),
  ('purchase', '4.3.0', 32, 2, 3, 1000, 1990, 512, 300, 0, 50, 45, 90, 40, 48, 95, 42, 47, 84, 0, 75, 120, 100, 200, 120, 165, 42),
  ('signup', '4.5.1', 32, 1, 4, 1100, 2047, 4096, 0, 500, 45, 47, 84, 34, 52, 88, 36, 45, 80, 0, 80, 0, 120, 0, 110, 160, 43),
  ('view', '', 32, 1, 1, 1070, 1800, 1024, 100, 300, 58, 44, 82, 38, 44, 86, 37, 46, 79, 0, 90, 140, 0, 130, 100, 158, 44)
) as c(log_id, fc_version, frame_interval_i, p_num, p_denom, minthrottle, motor_output_high, acc_1g, gyro_lpf2_static_hz, gyro_lpf1_static_hz,
  p_roll, i_roll, d_roll, p_pitch, i_pitch, d_pitch, p_yaw, i_yaw, d_yaw, current_meter_offset, dterm_lpf1_static_hz, dterm_lpf2_static_hz,
  ff_roll, dmin_roll, vbatscale, vbatref, vbatmaxcellvoltage)"""


#: Gyro noise that grows with throttle, on top of the frames' own: pseudo-random, from -20 to 20 times 0 to 20.
_NOISY = {
    f"gyroADC_{k}": f"gyroADC_{k} + ((e * e * 31 + e * {17 + k}) % 4099 % 41 - 20) * ((rcCommand_3 - 1000) {{div}} 50)" for k in range(3)
}


def with_sql(query: str, noisy: bool = False) -> str:
    """A DuckDB query over f (frames), slow, gps, ev (events), idx (frame index) and cfg (settings)."""
    frames = f"f as ({frames_sql('//', _NUMBERED.format(events='events'))})"
    if noisy:
        frames = f"f0{frames[1:]}, f as (select * replace ({', '.join(f'{x} as {c}' for c, x in _NOISY.items())}) from f0)".replace("{div}", "//")
    div = lambda s: s.replace("{div}", "//")
    return f"""with recursive {frames}, slow as ({_SLOW}), gps as ({_GPS}), ev as ({div(_EVENTS)}), idx as ({_INDEX}), cfg as
  (select *, 400 as current_meter_scale from ({_CONFIG})) {query}"""


class Tables:
    """The same tables as DataFrames; rows of a log are numbered by blocks of event ids, so no task holds a whole log."""

    def __init__(self, spark: SparkSession, sf_dir: str, noisy: bool = False) -> None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.spark = spark
        rows = events.selectExpr("event_type", "event_id as e", "event_id as seq", "user_id as u", "value")
        numbered = positions(rows, ("event_type",)).selectExpr("event_type", "e", "u", "value", "idx as n")
        self._all = spark.sql(frames_sql("div", "{numbered}", _GYRO_BY_PLACE), numbered=numbered)
        if noisy:
            self._all = self._all.withColumns({c: F.expr(x.replace("{div}", "div")) for c, x in _NOISY.items()})
        self.frames = self._all.drop("e", "u", "n")

        def derived(sql: str) -> DataFrame:
            return spark.sql(
                sql.replace("{div}", "div").replace("from f ", "from {f} ").replace("from f\n", "from {f} ") if not sql.endswith("from f") else sql[:-6] + "from {f}",
                f=self._all
            )

        self.slow, self.gps, self.events, self.frame_index = map(derived, (_SLOW, _GPS, _EVENTS, _INDEX))
        gains = ", ".join(f"array(p_{a}, i_{a}, d_{a}) as pid_{a}" for a in ("roll", "pitch", "yaw"))
        self.config = spark.sql(_CONFIG).selectExpr(
            "*", gains.split(", array")[0], *(f"array{x}" for x in gains.split(", array")[1:]),
            "array(dmin_roll, 0, 0) as d_min", "array(ff_roll, 0, 0) as ff_weight", "400 as current_meter_scale",
            "minthrottle as motor_output_low"
        )

    def field_defs(self) -> DataFrame:
        """One row per log and main field of the derived frames."""
        from skylog.schema import CHANNEL, present

        names = [CHANNEL[c] for c in present(self.frames, CHANNEL)]
        fields = ", ".join(f"'{n}'" for n in names)
        return self.frames.select("log_id").distinct().selectExpr(
            "log_id", "'I' as frame_type", f"posexplode(array({fields})) as (field_index, name)"
        )
