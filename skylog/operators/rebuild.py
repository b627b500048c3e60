"""Values rebuilt from recorded deltas, clocks unwrapped, and frames checked.

A segment is one I frame and the P frames after it. Segments are short, so all but the checks and clocks
work on (log_id, segment); these take a few narrow columns of a log in order, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylog.functions import nth_scheduled, scheduled_before

from .joins import _asof
from .scan import BLOCK, beside, blocks, running_sums, saved
from .units import by_place

ROLLOVER = 1 << 32
#: Limits between consecutive frames.
MAX_ITERATIONS, MAX_MICROSECONDS = 5000, 10_000_000


def with_segments(raw: DataFrame) -> DataFrame:
    """Adds segment: how many I frames the log has had so far; rows before the first are in segment 0."""
    narrow = running_sums(raw.select("log_id", "seq", "frame_type"), {"segment": (F.col("frame_type") == "I").cast("long")})
    return by_place(raw, narrow.drop("frame_type"))


def _segment() -> Window:
    return Window.partitionBy("log_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def undo_previous(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Deltas against the frame before become values."""
    return raw.withColumns({c: F.sum(c).over(_segment()) for c in columns})


def undo_straight_line(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Deltas against a line through the two frames before become values; the line starts level at the I frame."""
    # the slope starts at 0: the I frame's value counts once, the deltas add up twice
    slopes = raw.withColumns({f"_{c}": F.sum(F.when(F.col("frame_type") == "I", 0).otherwise(F.col(c))).over(_segment()) for c in columns})
    start = {c: F.sum(F.when(F.col("frame_type") == "I", F.col(c)).otherwise(0)).over(_segment()) for c in columns}
    return slopes.withColumns({c: start[c] + F.sum(f"_{c}").over(_segment()) for c in columns}).drop(*(f"_{c}" for c in columns))


def undo_average2(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Deltas against the mean of the two frames before (truncated toward zero) become values.

    That isn't linear: each segment is one row of arrays, and numpy steps through many segments at once.
    """
    names = [f for f in raw.columns if f not in columns]
    packed = raw.groupBy("log_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("seq", *(c for c in names if c not in ("log_id", "segment", "seq")), *columns))).alias("rows")
    )
    packed = packed.select("log_id", "segment", "rows", *(F.col(f"rows.{c}").alias(f"_{c}") for c in columns))
    kept = len(packed.columns) - len(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for k in range(len(columns)):
                lists = batch.column(kept + k)
                lengths = np.array([len(x) for x in lists], np.int64)
                values = np.zeros((len(lists), lengths.max(initial=0)), np.int64)
                inside = np.arange(values.shape[1]) < lengths[:, None]
                values[inside] = lists.flatten().fill_null(0).to_numpy()
                for i in range(1, values.shape[1]):
                    total = values[:, i - 1] + values[:, max(i - 2, 0)]
                    values[:, i] += np.sign(total) * (np.abs(total) // 2)
                done.append(
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values[inside]))
                )
            yield pa.record_batch([*batch.columns[:kept], *done], batch.schema.names)

    out = packed.mapInArrow(scan, packed.schema).select(
        "log_id", "segment", F.posexplode("rows").alias("_i", "_r"), *(f"_{c}" for c in columns)
    )
    return out.select(
        *(
            F.col(c) if c in ("log_id", "segment") else F.element_at(f"_{c}", F.col("_i") + 1).alias(c) if c in columns else F.col(f"_r.{c}").alias(c) for c in raw.columns
        )
    )


def undo_inc(raw: DataFrame, config: DataFrame, column: str = "loopIteration") -> DataFrame:
    """Loop counters: the n-th P frame of a segment has the n-th scheduled iteration after its I frame's."""
    rows = raw.join(
        config.select("log_id", F.col("frame_interval_i").alias("_i"), F.col("p_num").alias("_num"), F.col("p_denom").alias("_denom")),
        "log_id", "left"
    )
    place = F.row_number().over(Window.partitionBy("log_id", "segment").orderBy("seq")) - 1
    first = F.first(F.when(F.col("frame_type") == "I", F.col(column)), ignorenulls=True).over(_segment())
    rows = rows.withColumns({"_place": place, "_first": first})
    schedule = (F.col("_i"), F.col("_num"), F.col("_denom"))
    rows = rows.withColumn("_n", scheduled_before(F.col("_first") + 1, *schedule) + F.col("_place"))
    value = F.when(F.col("frame_type") == "I", F.col(column)).otherwise(nth_scheduled(F.col("_n"), *schedule))
    return rows.withColumn(column, value).drop("_i", "_num", "_denom", "_place", "_first", "_n")


#: Fields recorded against a constant of the log's settings, and its column (or a number).
BASES = {"rcCommand_3": "minthrottle", "vbatLatest": "vbatref", "motor_0": "motor_output_low"}


def undo_base(
    raw: DataFrame, config: DataFrame, bases: dict[str, str | int] = BASES,
    motors: tuple[str, ...] = ("motor_1", "motor_2", "motor_3")
) -> DataFrame:
    """I-frame values recorded against a setting, a number, or the first motor become values; P frames stay."""
    key = F.col("frame_type") == "I"
    used = sorted({v for v in bases.values() if isinstance(v, str)})
    rows = raw.join(config.select("log_id", *(F.col(c).alias(f"_{c}") for c in used)), "log_id", "left")
    add = {
        c: F.when(key, F.col(c) + (F.col(f"_{v}") if isinstance(v, str) else F.lit(v))).otherwise(F.col(c)) for c,
        v in bases.items() if c in raw.columns
    }
    rows = rows.withColumns(add).drop(*(f"_{c}" for c in used))
    return rows.withColumns({m: F.when(key, F.col(m) + F.col("motor_0")).otherwise(F.col(m)) for m in motors if m in raw.columns})


def undo_home(gps: DataFrame, home: DataFrame) -> DataFrame:
    """Coordinates recorded against the home position become absolute; frames before the first home are dropped."""
    rows = _asof(gps, home, ["GPS_home_0", "GPS_home_1"]).where("GPS_home_0 is not null")
    return rows.withColumns(
        {f"GPS_coord_{i}": F.col(f"GPS_coord_{i}") + F.col(f"GPS_home_{i}") for i in (0, 1)}
    ).drop("GPS_home_0", "GPS_home_1")


def undo_gps_time(gps: DataFrame, frames: DataFrame) -> DataFrame:
    """GPS times recorded against the last main frame become absolute."""
    main = frames.select("log_id", "seq", F.col("time").alias("_main"))
    return _asof(gps, main, ["_main"]).withColumn("time", F.coalesce("time", F.lit(0)) + F.coalesce("_main", F.lit(0))).drop("_main")


def unwrap_time(frames: DataFrame, column: str = "time") -> DataFrame:
    """32-bit clocks become 64-bit ones: a step back that is one forward of less than 10 s modulo 2**32 is a rollover."""
    rows = beside(frames.select("log_id", "seq", column), [column], previous="_previous")
    now, before = F.col(column), F.col(f"_previous.{column}")
    over = (now < before) & (F.pmod(now - before, F.lit(ROLLOVER)) < MAX_MICROSECONDS)
    times = running_sums(rows, {"_rolled": over.cast("long")}).select("log_id", "seq", "_rolled")
    return by_place(frames, times).withColumn(column, now + ROLLOVER * F.col("_rolled")).drop("_rolled")


class _Reference:
    """What a log's next frame is compared with: the last valid frame or resume event, and the rollovers so far."""

    def __init__(self) -> None:
        self.iteration = self.time = None
        self.sound, self.rolled = False, 0


def _validity(kind: np.ndarray, iteration: np.ndarray, time: np.ndarray, ref: _Reference) -> tuple[np.ndarray, np.ndarray]:
    """Validity and unwrapped times of a log's next rows in order; kinds are 0 for I, 1 for P, 2 for a resume event.

    As long as frames are valid, each is compared with the one before it, all at once; only from a frame that
    isn't to the next I frame that is, they are taken one by one.
    """
    n = len(kind)
    valid, out, i = np.zeros(n, bool), time.copy(), 0
    while i < n:
        if ref.sound:
            before = np.concatenate([[ref.time % ROLLOVER], time[i:-1]])
            over = np.cumsum((time[i:] < before) & ((time[i:] - before) % ROLLOVER < MAX_MICROSECONDS))
            times = time[i:] + ref.rolled + ROLLOVER * over
            step_i, step_t = np.diff(iteration[i:], prepend=ref.iteration), np.diff(times, prepend=ref.time)
            bad = (kind[i:] == 2) | (step_i < 0) | (step_i >= MAX_ITERATIONS) | (step_t < 0) | (step_t >= MAX_MICROSECONDS)
            good = int(np.argmax(bad)) if bad.any() else n - i
            if good:
                valid[i : i + good], out[i : i + good] = True, times[:good]
                ref.iteration, ref.time, ref.rolled = int(iteration[i + good - 1]), int(times[good - 1]), ref.rolled + ROLLOVER * int(over[good - 1])
                i += good
                continue
        if kind[i] == 2:
            ref.iteration, ref.time = int(iteration[i]), int(time[i])
        else:
            if ref.time is not None and time[i] < ref.time % ROLLOVER and (time[i] - ref.time) % ROLLOVER < MAX_MICROSECONDS:
                ref.rolled += ROLLOVER
            out[i] += ref.rolled
            passes = ref.iteration is None or (
                ref.iteration <= iteration[i] < ref.iteration + MAX_ITERATIONS and ref.time <= out[i] < ref.time + MAX_MICROSECONDS
            )
            ref.sound = valid[i] = bool(passes if kind[i] == 0 else ref.sound and passes)
            if ref.sound:
                ref.iteration, ref.time = int(iteration[i]), int(out[i])
        i += 1
    return valid, out


#: Rows of a block in order: what it begins with (kind 3), its frames and events, and then what it ends with (kind 3).
_CHECKED = "log_id string, _block long, seq long, frame_type string, kind int, iteration long, time long, valid boolean, rolled long, resumed boolean"
_ENTRY = ("iteration", "time", "valid", "rolled")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks blocks of rows in order; each begins with its entry, and a row of what it ends with is added.

    Times, those of entry and end included, are given without the rollovers before the block.
    """
    names, block, ref, entry, resumed = [c.split()[0] for c in _CHECKED.split(", ")], None, _Reference(), 0, False

    def ended() -> pa.RecordBatch:
        time = None if ref.time is None else ref.time - ref.rolled
        row = (*block, None, None, 3, ref.iteration, time, ref.sound, ref.rolled - entry, resumed)
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, schema.types, strict=True)], names)

    for batch in batches:
        schema = batch.schema
        new = [0, *(np.flatnonzero(batch.column(4).to_numpy() == 3).tolist()), len(batch)]
        for a, b in zip(new[:-1], new[1:], strict=True):
            rows = batch.slice(a, b - a)
            if len(rows) and rows.column(4)[0].as_py() == 3:
                if block:
                    yield ended()
                row = [rows.column(i)[0].as_py() for i in (0, 1, 5, 6, 7, 8)]
                block, ref, resumed = tuple(row[:2]), _Reference(), False
                ref.iteration, time, ref.sound, ref.rolled = row[2:]
                ref.time, entry = None if time is None else time + ref.rolled, ref.rolled
                rows = rows.slice(1)
            if len(rows):
                # null counters and times count as 0, as a decoder's do
                kind, iteration, time = (rows.column(i).fill_null(0).to_numpy() for i in (4, 5, 6))
                valid, out = _validity(kind, iteration, time, ref)
                resumed = resumed or bool((kind == 2).any())
                n = len(rows)
                yield pa.record_batch(
                    [*rows.columns[:6], pa.array(out - entry), pa.array(valid), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names
                )
    if block:
        yield ended()


def _entries(ends: DataFrame) -> DataFrame:
    """What each block has to begin with, if all ends are right: the end of the one before it, and all rollovers so far."""
    w = Window.partitionBy("log_id").orderBy("_block")
    rolled = F.coalesce(F.sum("rolled").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.select(
        "log_id", "_block", "resumed", *(F.lag(c).over(w).alias(c) for c in ("iteration", "time")),
        F.coalesce(F.lag("valid").over(w), F.lit(False)).alias("valid"), rolled.alias("rolled")
    )


def validate_frames(frames: DataFrame, events: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(log_id, seq, frame_type, time, valid) of every frame, against the last valid one before it.

    Iteration and time must not go back, nor jump 5000 iterations or 10 s; a bad frame makes P frames
    invalid until an I frame passes. A logging-resume event (type 14) moves the reference. Times are
    unwrapped along the way, since only valid frames tell of a rollover.

    Blocks of a log are checked at once, each as if the frame before it were valid. Where the block before ends
    otherwise, the block is checked again with that end, and so on until all fit: rounds go on as long as a
    block's end changes, so one more for each block in a row that a bad frame spoils whole. Checked rows are
    written to the shared folder; only the number of blocks to check again reaches the driver.
    """
    kind = F.when(F.col("frame_type") == "I", 0).otherwise(1)
    rows = frames.select(
        "log_id", "seq", "frame_type", kind.alias("kind"), F.col("loopIteration").cast("long").alias("iteration"),
        F.col("time").cast("long").alias("time")
    )
    if events is not None:
        rows = rows.unionByName(
            events.where("event_type = 14").select(
                "log_id", "seq", F.lit("E").alias("frame_type"), F.lit(2).alias("kind"),
                F.col("log_iteration").cast("long").alias("iteration"), F.col("time").cast("long").alias("time")
            )
        )
    key = ["log_id", "_block"]
    none = {"seq": F.lit(None).cast("long"), "frame_type": F.lit(None).cast("string"), "kind": F.lit(3), "resumed": F.lit(None).cast("boolean")}
    rows = blocks(rows, block).withColumns({"valid": none["resumed"], "rolled": none["seq"], "resumed": none["resumed"]})

    def checked(rows: DataFrame, entries: DataFrame, number: int) -> DataFrame:
        columns = [c.split()[0] for c in _CHECKED.split(", ")]
        both = rows.select(columns).unionByName(entries.select(*key, *_ENTRY).withColumns(none).select(columns))
        dealt = both.repartition(*key).sortWithinPartitions(*key, F.col("seq").asc_nulls_first(), "kind")
        return saved(dealt.mapInArrow(_check, _CHECKED).withColumn("_round", F.lit(number)))

    # at first, the last row of the block before counts as valid, and no rollover has been
    w = Window.partitionBy("log_id").orderBy("_block")
    last = rows.groupBy(*key).agg(F.max_by(F.struct(F.coalesce("iteration", F.lit(0)).alias("iteration"), F.coalesce("time", F.lit(0)).alias("time")), "seq").alias("last"))
    used = saved(
        last.select(*key, F.lag("last").over(w).alias("last")).select(
            *key, "last.iteration", "last.time", F.col("last").isNotNull().alias("valid"), F.lit(0).cast("long").alias("rolled"), F.lit(0).alias("_round")
        )
    )
    parts = [checked(rows, used, 0)]
    ends = parts[0].where("kind = 3")
    while True:
        wanted = _entries(ends)
        # times of a block without resume events only shift by the rollovers before it
        differs = ~F.col("_iteration").eqNullSafe(F.col("iteration")) | ~F.col("_time").eqNullSafe(F.col("time"))
        differs |= (F.col("_valid") != F.col("valid")) | (F.col("resumed") & (F.col("_rolled") != F.col("rolled")))
        stale = saved(wanted.join(used.select(*key, *(F.col(c).alias(f"_{c}") for c in _ENTRY)), key).where(differs).select(*key, *_ENTRY))
        if not stale.limit(1).count():
            break
        number = len(parts)
        parts.append(checked(rows.join(stale.select(*key), key, "left_semi"), stale, number))
        used = saved(used.join(stale, key, "left_anti").unionByName(stale.withColumn("_round", F.lit(number))))
        ends = saved(ends.join(stale, key, "left_anti").unionByName(parts[-1].where("kind = 3")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # of each block the round that used the right entry, with the rollovers before it
    right = used.select(*key, "_round").join(wanted.select(*key, F.col("rolled").alias("_before")), key)
    out = out.where("kind < 2").join(right, [*key, "_round"])
    return out.select("log_id", "seq", "frame_type", (F.col("time") + F.col("_before")).alias("time"), "valid")


def accepted_frames(validated: DataFrame) -> DataFrame:
    """Accepted and rejected frames by log and frame type."""
    return validated.groupBy("log_id", "frame_type").agg(
        F.count_if("valid").alias("accepted"), F.count_if(~F.col("valid")).alias("rejected")
    )
