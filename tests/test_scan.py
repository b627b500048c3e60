"""Scans by blocks against plain Python, with blocks that are empty, without values, and larger than a log."""

import random

import pytest
from pyspark.sql import functions as F

from skylog.operators import joins, rebuild, scan, stats, steps, tuning

BLOCKS = [7, 100, 1 << 18]


def table(spark, seed=1, logs="ab", n=150):
    random.seed(seed)
    rows = []
    for log in logs:
        places = sorted(random.sample(range(-50, 900), n))
        rows += [(log, "xy"[random.random() < 0.5], p, random.choice([None, 1, 5, -3]), random.randint(0, 9)) for p in places]
    df = spark.createDataFrame(rows, "log_id string, channel string, seq long, v long, w long").repartition(5)
    return rows, df


def by_key(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r[:k], []).append(r)
    return out


@pytest.mark.parametrize("block", BLOCKS)
def test_sums_and_positions(spark, block):
    rows, df = table(spark)
    got = {(r.log_id, r.seq): (r.s, r.n) for r in scan.running_sums(df, {"s": F.col("v"), "n": F.lit(1)}, block=block).collect()}
    placed = {(r.log_id, r.channel, r.seq): (r.idx, r.total) for r in scan.positions(df, ["log_id", "channel"], block=block).collect()}
    assert len(got) == len(placed) == len(rows)
    for (log,), part in by_key(rows, 1).items():
        for i, r in enumerate(part):
            assert got[log, r[2]] == (sum(x[3] or 0 for x in part[: i + 1]), i + 1)
    for (log, channel), part in by_key(sorted(rows), 2).items():
        assert [placed[log, channel, r[2]] for r in part] == [(i, len(part)) for i in range(len(part))]


@pytest.mark.parametrize("block", BLOCKS)
def test_last_seen_and_beside(spark, block):
    rows, df = table(spark, seed=2)
    rare = df.withColumn("v", F.when(F.col("seq") % 50 == 0, F.col("v")))
    seen = {(r.log_id, r.seq): (r.v, r.w) for r in scan.last_seen(rare, ["v", "w"], block=block).collect()}
    near = {(r.log_id, r.seq): (r.a, r.b) for r in scan.beside(df, ["seq", "v"], "a", "b", block=block).collect()}
    for (log,), part in by_key(rows, 1).items():
        last = None
        for i, r in enumerate(part):
            last = r[3] if r[2] % 50 == 0 and r[3] is not None else last
            assert seen[log, r[2]] == (last, r[4])
            for got, k in zip(near[log, r[2]], (i - 1, i + 1), strict=True):
                assert got == ((part[k][2], part[k][3]) if 0 <= k < len(part) else None)


def test_asof_over_blocks_without_right_rows(spark):
    rows, df = table(spark, seed=3)
    right = spark.createDataFrame([("a", 100, 1, None), ("a", 101, None, 4), ("a", 700, 9, 9), ("c", 0, 5, 5)], "log_id string, seq long, x long, y long")
    for block in BLOCKS:
        got = {(r.log_id, r.seq): (r.x, r.y) for r in joins._asof(df, right, ["x", "y"], block).collect()}
        assert len(got) == len(rows)
        for log, _, seq, *_ in rows:
            want = (None, None) if log == "b" or seq < 100 else (1, None) if seq == 100 else (None, 4) if seq < 700 else (9, 9)
            # a right row comes before a left one of its place
            assert got[log, seq] == want


def widest_window(df):
    """The keys of all windows in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Window [" in line or "Window [" in line.strip()[:12]]


@pytest.mark.parametrize("make", [
    lambda f, c: rebuild.with_segments(f), lambda f, c: rebuild.unwrap_time(f), lambda f, c: stats.energy_cumulative(f, c),
    lambda f, c: joins.merge_slow(f, f.selectExpr("log_id", "seq + 1 as seq", "seq as flightModeFlags")),
])
def test_rows_are_only_scanned_by_block(spark, make):
    frames = spark.range(100).selectExpr("'a' as log_id", "id as seq", "'I' as frame_type", "id as time", "id as amperageLatest")
    config = spark.createDataFrame([("a", 0, 400)], "log_id string, current_meter_offset int, current_meter_scale int")
    plan = make(frames, config)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    # a window by log alone runs over one row a block, which a sum or the like has made
    for i, line in enumerate(plan.splitlines()):
        if "Window [" in line and "_block" not in line.split("], [")[1]:
            assert "Aggregate [" in "\n".join(plan.splitlines()[i + 1 : i + 4])


def test_one_long_log_takes_many_tasks(spark):
    """A log of 2 million rows in blocks of 2**18 places: eight groups of rows, none of more than a block."""
    frames = spark.range(2_000_000).selectExpr(
        "'a' as log_id", "id as seq", "if(id % 32 = 0, 'I', 'P') as frame_type", "if(id % 500000 = 77, id + 9000, id) as loopIteration", "id * 1000 as time"
    )
    out = rebuild.validate_frames(frames)
    assert out.where("not valid").groupBy((F.col("seq") - F.col("seq") % 500_000).alias("k")).count().orderBy("k").collect() == [
        (k * 500_000, 96 - 77) for k in range(4)
    ]
    assert scan.blocks(frames).groupBy("_block").count().count() == 8


@pytest.mark.parametrize("seed", range(3))
def test_exact_medians(spark, seed):
    import statistics

    random.seed(seed)
    rows = [(k, random.choice([None, random.gauss(0, 10.0 ** random.randint(-3, 8)), random.randint(-2, 2) * 1.0, 1e300])) for k in "abcd" for _ in range(random.randint(1, 300))]
    rows += [("one", 5.0), ("none", None), ("zero", 0.0), ("zero", -0.0), ("two", -3.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r["median"] for r in stats.exact_medians(df, ("k",), "v").collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        want[k] = statistics.median(v for x, v in rows if x == k and v is not None)
    assert got == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("block", BLOCKS)
def test_nearest(spark, block):
    rows, df = table(spark, seed=4)
    got = {(r.log_id, r.seq): (r.a, r.b) for r in scan.nearest(df, F.when(F.col("w") == 9, F.col("seq")), "a", "b", block=block).collect()}
    assert len(got) == len(rows)
    for (log,), part in by_key(rows, 1).items():
        places = [r[2] for r in part if r[4] == 9]
        for r in part:
            assert got[log, r[2]] == (max((p for p in places if p <= r[2]), default=None), min((p for p in places if p >= r[2]), default=None))


def test_motions_are_the_same_in_any_blocks(spark):
    """Motions that lie across many blocks, gaps that end in another one, and a log that always moves."""
    random.seed(5)
    rows = []
    for log in "abc":
        sp, held = 0.0, 0
        for i in range(600):
            held = held - 1 if held else (random.choice([0, 0, 0, 5, 30]) if log != "c" else 0)
            sp += 0.0 if held else random.choice([1.0, 2.0, -3.0])
            rows.append((log, "roll", i, sp, 600, 1000.0))
    samples = spark.createDataFrame(rows, "log_id string, axis string, idx long, sp double, n long, fs double").repartition(5)
    found = []
    for block in (7, 100, 1 << 18):
        mask = steps.motion_mask(samples, block)
        moving = sorted(map(tuple, mask.select("log_id", "idx", "moving").collect()))
        found.append((moving, sorted(map(tuple, steps.motion_runs(mask, block).select("log_id", "run", "start", "end", "edge").collect()))))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 3
    # as a plain loop finds them
    runs = []
    for (log,), part in by_key(found[0][0], 1).items():
        flags = [m for _, _, m in part] + [False]
        runs += [(log, i) for i in range(len(flags) - 1) if flags[i] and not (i and flags[i - 1])]
    assert [(r[0], r[2]) for r in found[0][1]] == runs


def whole_logs(df):
    """Windows of a plan that run over a log's own rows at once, not inside a block nor over one row for each block."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    return [lines[i] for i in windows if "_block" not in lines[i].split("], [")[1] and "Aggregate [" not in "\n".join(lines[i + 1 : i + 4])]


def test_logs_are_numbered_by_block(spark):
    from skylog.plans.driver_tables import Tables

    assert not whole_logs(Tables(spark, "/root/testdata/sf0.001").frames)


def test_motions_are_only_scanned_by_block(spark):
    samples = spark.range(100).selectExpr("'a' as log_id", "'roll' as axis", "id as idx", "id * 1.0D as sp", "100L as n", "1000.0D as fs")
    mask = steps.motion_mask(samples)
    assert not whole_logs(mask) and not whole_logs(steps.motion_runs(mask))


def test_diagnosis_counts_channels_without_a_window(spark):
    from skylog.plans.driver_tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    # those by channel alone run over the bins of a spectrum, which an aggregate has made
    plan = tuning.diagnose(t.frames, t.config)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [count(" in line]
