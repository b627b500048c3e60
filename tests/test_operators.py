import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylog import functions as fn
from skylog.operators import joins, rebuild, reconcile, series, stats, steps, tuning, units

CONFIG = "log_id string, fc_version string, gyro_scale double, acc_1g int, frame_interval_i int, p_num int, p_denom int, minthrottle int, motor_output_low int, motor_output_high int, vbatref int, current_meter_offset int, current_meter_scale int, pid_roll array<int>, pid_pitch array<int>, pid_yaw array<int>, d_min array<int>, ff_weight array<int>, gyro_lpf1_static_hz int, gyro_lpf2_static_hz int, dterm_lpf1_static_hz int, dterm_lpf2_static_hz int"


def config(spark, **changes):
    row = dict(
        log_id="a", fc_version="4.3.0", gyro_scale=math.radians(1) * 1e-6, acc_1g=0, frame_interval_i=32, p_num=1, p_denom=1,
        minthrottle=1000, motor_output_low=1000, motor_output_high=2000, vbatref=0, current_meter_offset=0,
        current_meter_scale=400, pid_roll=[50, 40, 30], pid_pitch=[60, 40, 0], pid_yaw=[45, 40, 0], d_min=[1, 2, 3],
        ff_weight=[4, 5, 6], gyro_lpf1_static_hz=100, gyro_lpf2_static_hz=0, dterm_lpf1_static_hz=0, dterm_lpf2_static_hz=0
    ) | changes
    names = [x.split()[0] for x in CONFIG.split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names)], CONFIG)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_functions(spark):
    assert [
        value(spark, fn.version_gte(F.lit(v), "4.3.0")) for v in ("4.3.0", "4.10.1", "4.2.9", "", None, "5")
    ] == [True, True, False, False, False, True]
    assert [value(spark, fn.flags_to_string(F.lit(x))) for x in (0, 1, 5, 1 << 10)] == ["0", "ANGLE_MODE", "ANGLE_MODE|MAG_MODE", "0"]
    assert [value(spark, fn.enum_to_string(F.lit(x))) for x in (0, 3, 4)] == ["IDLE", "LANDED", "4"]
    assert [value(spark, fn.adjust(F.lit(x), 12)) for x in (0, 25, 30, -1)] == [None, 28, 34, None]
    assert value(spark, fn.adjust(F.lit(5), -10)) == 4  # 4.5 goes to the even number
    assert value(spark, fn.adc_to_milliamps(F.lit(-1), F.lit(0), F.lit(400))) == (65535 * 33 * 100 // 4095) * 10000 // 400
    assert value(spark, fn.adc_to_milliamps(F.lit(0), F.lit(7), F.lit(400))) == -175
    assert value(spark, fn.estimate_cells(F.lit(4095), F.lit(110), F.lit(43))) == 8
    assert [
        value(spark, fn.field_unit(F.lit(x))) for x in ("gyroADC[0]", "axisI[1]", "rssi", "vbatLatest", "motor[3]")
    ] == ["deg/s", "raw", "raw", "V", "us"]


def test_throttle_bins_at_every_microsecond(spark):
    got = [r[0] for r in spark.range(1001).orderBy("id").select(stats.throttle_bin(F.col("id") / 1000.0)).collect()]
    edges = np.linspace(0, 1, 21)
    assert got == [sum(k * 0.05 <= i / 1000.0 for k in range(1, 20)) for i in range(1001)]
    assert abs(edges[1] - 0.05) < 1e-12


def frames(spark, rows, names):
    return spark.createDataFrame(rows, "log_id string, seq long, " + names)


@pytest.mark.parametrize("n", [0, 1, 31])
def test_short_logs_give_no_spectrum(spark, n):
    f = frames(spark, [("a", i, i * 1000, i) for i in range(n)], "time long, gyroADC_0 long")
    assert series.power_spectrum(f, config(spark), ["gyroADC[0]"], nperseg=64).count() == 0


def test_sine_energy_and_peak(spark):
    rows = [("a", i, i * 1000, int(round(1000 * math.sin(2 * math.pi * 62.5 * i / 1000)))) for i in range(4096)]
    f = frames(spark, rows, "time long, motor_0 long")
    psd = series.power_spectrum(f, config(spark), ["motor[0]"], max_freq=200, nperseg=256)
    assert abs(psd.orderBy(F.desc("psd")).first().freq - 62.5) < 1e-9
    assert abs(series.band_energy(psd, 50, 75).first().energy / (1000**2 / 2) - 1) < 0.01
    assert series.band_energy(psd, 62.4, 62.6).first().energy == 0
    gram = series.spectrogram(f, config(spark), "motor[0]", nperseg=256, max_time_bins=8)
    assert gram.select("column").distinct().count() == 8
    assert gram.agg(F.min("power_db")).first()[0] >= -80


def test_decimation_edges(spark):
    random.seed(3)
    for n, points in [(random.randint(2, 900), random.randint(2, 120)) for _ in range(4)]:
        v = [random.random() for _ in range(n)]
        ch = spark.createDataFrame(
            [("a", "x", i, float(i), v[i]) for i in range(n)], "log_id string, channel string, seq long, t_s double, v double"
        )
        got = [(r.t_s, r.v) for r in series.downsample_minmax(ch, points).orderBy("point").collect()]
        if n <= points:
            want = list(zip(map(float, range(n)), v, strict=True))
        else:
            edges = np.linspace(0, n, points // 2 + 1).astype(int)
            want = [p for a, b in zip(edges[:-1], edges[1:], strict=True) for p in ((float(a), min(v[a:b])), (float(b - 1), max(v[a:b])))]
        assert got == want


def test_round_trips(spark):
    random.seed(5)
    values = [random.randint(-500, 500) for _ in range(200)]
    kinds = ["I" if i % 32 == 0 else "P" for i in range(200)]
    prev = lambda i, k: values[max(i - k, i - i % 32)]
    half = lambda x: int(x / 2)
    a = [v if k == "I" else v - prev(i, 1) for i, (v, k) in enumerate(zip(values, kinds, strict=True))]
    b = [v if k == "I" else v - 2 * prev(i, 1) + prev(i, 2) for i, (v, k) in enumerate(zip(values, kinds, strict=True))]
    c = [v if k == "I" else v - half(prev(i, 1) + prev(i, 2)) for i, (v, k) in enumerate(zip(values, kinds, strict=True))]
    raw = rebuild.with_segments(
        frames(spark, [("a", i, kinds[i], a[i], b[i], c[i]) for i in range(200)], "frame_type string, a long, b long, c long")
    )
    out = rebuild.undo_average2(rebuild.undo_straight_line(rebuild.undo_previous(raw, ["a"]), ["b"]), ["c"])
    assert [(r.a, r.b, r.c) for r in out.orderBy("seq").collect()] == [(v, v, v) for v in values]


def test_rollover(spark):
    times = [2**32 - 500, 400, 2**32 - 100, 300, 200_000_000, 199_999_999]
    f = frames(spark, [("a", i, t) for i, t in enumerate(times)], "time long")
    over = 2**32
    assert [r.time for r in rebuild.unwrap_time(f).orderBy("seq").collect()] == [
        over - 500, over + 400, 2 * over - 100, 2 * over + 300, 2 * over + 200_000_000, 2 * over + 199_999_999
    ]


def test_validity(spark):
    rows = [
        ("I", 0, 0), ("P", 1, 1000), ("P", 7000, 2000), ("P", 2, 2000), ("I", 32, 32000), ("P", 33, 33000),
        ("I", 34, 99_000_000), ("P", 34, 34000), ("I", 64, 64000)
    ]
    f = frames(spark, [("a", 10 * i, *r) for i, r in enumerate(rows)], "frame_type string, loopIteration long, time long")
    assert [
        r.valid for r in rebuild.validate_frames(f).orderBy("seq").collect()
    ] == [True, True, False, False, True, True, False, False, True]
    resume = spark.createDataFrame(
        [("a", 55, 14, 98_000_000, 33)], "log_id string, seq long, event_type int, time long, log_iteration long"
    )
    assert [r.valid for r in rebuild.validate_frames(f, resume).orderBy("seq").collect()][6] is True
    assert rebuild.accepted_frames(rebuild.validate_frames(f.limit(0))).count() == 0


def scheduled(i, interval, num, denom):
    return (i % interval + num - 1) % denom < num


@pytest.mark.parametrize("interval,num,denom", [(32, 1, 1), (32, 1, 2), (7, 2, 3), (10, 3, 4), (5, 1, 8), (12, 4, 3)])
def test_schedules_in_closed_form(spark, interval, num, denom):
    c = config(spark, frame_interval_i=interval, p_num=num, p_denom=denom)
    counters = [3, 4, 9, 50, 51, 200, 150, 900]
    f = frames(spark, [("a", 10 * i, x) for i, x in enumerate(counters)], "loopIteration long")
    got = [r.absent for r in stats.absent_iterations(f, c).orderBy("seq").collect()]
    assert got == [0] + [sum(not scheduled(i, interval, num, denom) for i in range(a + 1, b)) for a, b in zip(counters, counters[1:])]
    first, n = 11, 60
    raw = rebuild.with_segments(
        frames(spark, [("a", i, "P" if i else "I", first) for i in range(n)], "frame_type string, loopIteration long")
    )
    after = [i for i in range(first + 1, first + 2000) if scheduled(i, interval, num, denom)]
    assert [r.loopIteration for r in rebuild.undo_inc(raw, c).orderBy("seq").collect()] == [first, *after[: n - 1]]


def test_corrupt_counters_and_settings(spark):
    f = frames(spark, [("a", 0, 5), ("a", 10, 3_000_000_005), ("b", 0, 1), ("b", 10, 9)], "loopIteration long")
    both = config(spark, p_denom=2).union(config(spark, log_id="b", p_denom=0))
    assert {
        (r.log_id, r.seq): r.absent for r in stats.absent_iterations(f, both).collect()
    } == {("a", 0): 0, ("a", 10): 1_499_999_999, ("b", 0): 0, ("b", 10): 0}


def fold(rows):
    """Validity by the rule itself, row by row: (kind, iteration, time); kind 2 is a resume event."""
    last, sound, rolled, out = None, False, 0, []
    for kind, i, t in rows:
        if kind == 2:
            last = (i, t)
            continue
        if last and t < last[1] % 2**32 and (t - last[1]) % 2**32 < 10_000_000:
            rolled += 2**32
        t += rolled
        passes = last is None or (0 <= i - last[0] < 5000 and 0 <= t - last[1] < 10_000_000)
        sound = passes if kind == 0 else sound and passes
        if sound:
            last = (i, t)
        out.append((sound, t))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_validity_is_that_of_the_rule(spark, seed):
    random.seed(seed)
    rows, i, t = [], 0, 2**32 - 20_000_000
    for k in range(3000):
        i, t = i + random.randint(1, 3), t + random.randint(900, 20_000)
        kind = 0 if k % 8 == 0 else 1
        odd = random.random()
        now = (kind, i + 7000 if odd < 0.004 else i - 50 if odd < 0.006 else i, (t + 20_000_000 if 0.006 < odd < 0.01 else t) % 2**32)
        if odd > 0.998:
            i, t = i + 20_000, t + 30_000_000
            now = (2, i, t % 2**32)
        rows.append(now)
    f = frames(
        spark, [("a", 10 * k, "IP"[kind], i, t) for k, (kind, i, t) in enumerate(rows) if kind < 2],
        "frame_type string, loopIteration long, time long"
    )
    e = frames(
        spark, [("a", 10 * k, 14, t, i) for k, (kind, i, t) in enumerate(rows) if kind == 2],
        "event_type int, time long, log_iteration long"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = [(r.valid, r.time) for r in rebuild.validate_frames(f, e).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = fold(rows)
    assert got == want and 0 < sum(v for v, _ in want) < len(want)
    # blocks of 250 rows, and of so few that whole blocks are spoilt
    for block in (2500, 400):
        parted = rebuild.validate_frames(f, e, block)
        assert [(r.valid, r.time) for r in parted.orderBy("seq").collect()] == want


def step_log(overshoot=0.0, n=3000, sign=1):
    sp = [0.0] * n
    for i in range(n):
        sp[i] = sign * min(max((i - 1000) * 15, 0), 300)
    gy = [0.0] * n
    for i in range(1, n):
        gy[i] = gy[i - 1] + (sp[i - 1] - gy[i - 1]) * 0.05
    if overshoot:
        for i in range(1100, 1110):
            gy[i] = sign * 300 * (1 + overshoot)
    return [("a", i, 1000 * i, int(sp[i]), int(round(gy[i]))) for i in range(n)]


@pytest.mark.parametrize("sign", [1, -1])
def test_steps(spark, sign):
    f = frames(
        spark, [(*r, 0, 0, 0, 0) for r in step_log(0.2, sign=sign)],
        "time long, setpoint_0 long, gyroADC_0 long, setpoint_1 long, gyroADC_1 long, setpoint_2 long, gyroADC_2 long"
    )
    found, windows = steps.detect_steps(f, config(spark))
    one = found.collect()
    assert len(one) == 1
    s = one[0]
    assert (s.axis, s.baseline, s.target) == ("roll", 0, sign * 300)
    assert abs(s.overshoot_pct - 20) < 1e-6 and abs(s.peak_normalized - 1.2) < 1e-9
    assert 30 < s.rise_time_ms < 60 and s.settle_time_s is not None
    curve = {r.t_ms: r.response for r in steps.average_step_response(windows).collect()}
    assert len(curve) == 551 and abs(curve[-50]) < 1e-9 and abs(curve[400] - 1) < 0.01
    assert steps.step_summary(found, config(spark)).first()["count"] == 1
    assert steps.step_traces(windows).count() == 551


def test_motion_near_the_ends_is_lost(spark):
    rows = [("a", i, 1000 * i, 300 if i > 2 else 0, 0, 0, 0, 0, 0) for i in range(500)]
    f = frames(spark, rows, "time long, setpoint_0 long, gyroADC_0 long, setpoint_1 long, gyroADC_1 long, setpoint_2 long, gyroADC_2 long")
    assert steps.detect_steps(f, config(spark))[0].count() == 0


def test_merge_before_at_and_after(spark):
    f = frames(spark, [("a", 0, 100), ("a", 10, 200), ("b", 0, 100)], "time long")
    slow = frames(spark, [("a", 5, 3, 1, 2)], "flightModeFlags long, stateFlags long, failsafePhase long")
    assert [
        (r.log_id, r.seq, r.flightModeFlags) for r in joins.merge_slow(f, slow).orderBy("log_id", "seq").collect()
    ] == [("a", 0, 0), ("a", 10, 3), ("b", 0, 0)]
    gps = frames(spark, [("a", 2, 100, 7), ("a", 12, 250, 9), ("c", 1, 5, 1)], "time long, GPS_numSat long")
    assert [
        (r.log_id, r.seq, r.time, r.GPS_numSat) for r in joins.merge_gps(f, gps).orderBy("log_id", "seq").collect()
    ] == [("a", 0, 100, 7), ("a", 10, 200, None), ("a", 12, 250, 9), ("b", 0, 100, None)]


def test_reconcile_finds_the_scaling_and_the_row(spark):
    f = frames(spark, [("a", i, 10 * i, i % 32, 1600 + i) for i in range(40)], "time long, loopIteration long, vbatLatest long")
    golden = f.withColumn("vbatLatest", F.col("vbatLatest") / 100 + F.when(F.col("seq") == 7, 1.0).otherwise(0.0))
    diff = reconcile.reconcile(f, golden, ["vbatLatest"])
    s = reconcile.reconcile_summary(diff).first()
    assert (s.scaling, s.mismatches, s.first_row, s.ok, s.all_ok) == ("x0.01", 1, 7, False, False)
    assert reconcile.mismatch_context(diff, reconcile.reconcile_summary(diff), f, config(spark)).count() == 7


def test_motor_rule_and_ranking(spark):
    f = frames(
        spark, [("a", i, 1000 * i, 1990, 0, 0, 0) for i in range(40)],
        "time long, motor_0 long, motor_1 long, motor_2 long, motor_3 long"
    )
    r = tuning.rule_motor_saturation(stats.motor_peak(f, config(spark)), config(spark)).first()
    assert r.cli == ["set p_roll = 45", "set p_pitch = 54"] and r.axis is None
    assert tuning.rule_motor_saturation(
        stats.motor_peak(f, config(spark, motor_output_high=0)), config(spark, motor_output_high=0)
    ).count() == 0


def test_absent_axis_gives_no_rows(spark):
    f = frames(
        spark, [("a", i, 1000 * i, 1500, 10, 5, None, None, None, None) for i in range(50)],
        "time long, rcCommand_3 long, setpoint_0 long, gyroADC_0 long, setpoint_1 long, gyroADC_1 long, setpoint_2 long, gyroADC_2 long"
    )
    shown = units.to_display_units(f, config(spark))
    assert [r.axis for r in stats.pid_rms(shown).collect()] == ["roll"]
    assert stats.error_vs_throttle(shown).count() == 20
    with pytest.raises(ValueError):
        units.convert_units(f, config(spark), {"time": "h"})
