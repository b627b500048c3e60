import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from skylog import sources, streaming
from skylog.operators import units

HEADER = """H Product:Recorder
H Data version:2
H I interval:32
H P interval:1/2
H Firmware type:Alpha
H Firmware revision:Alpha 4.3.1 (abc) X
H gyro_scale:0x{scale}
H rollPID:45,80,30
H vbatcellvoltage:330,350,430
H Field I name:loopIteration,time,gyroADC[0]
H Field I signed:0,0,1
H Field I predictor:0,0,0
H Field I encoding:1,1,0
H Field P predictor:6,2,1
H Field P encoding:9,0,0
H Field G name:time,GPS_coord[0],GPS_coord[1]
H Field G signed:0,1,1
H Field G predictor:10,7,7
H Field G encoding:1,0,0
H Log start datetime:2024-05-06T07:08:09.000+00:00
"""


def write(path, text):
    with open(path, "wb") as f:
        f.write(text.encode("latin-1"))


def test_sections_headers_and_settings(spark, tmp_path):
    scale = struct.pack(">f", 1.0).hex()
    head = HEADER.format(scale=scale)
    body = "Ia\x00b:H Product\n\xffPxyz"
    write(tmp_path / "two.bin", "junk" + head + body + head.replace("Alpha 4.3.1", "Beta 9.9"))
    write(tmp_path / "none.bin", "nothing here")
    sections = sources.read_log_sections(spark, str(tmp_path))
    rows = {(os.path.basename(r.path), r.section_no): r for r in sections.collect()}
    assert set(rows) == {("two.bin", 0), ("two.bin", 1), ("none.bin", None)}
    assert rows["two.bin", 0].start_offset == 4 and rows["two.bin", 1].start_offset == 4 + len(head) + len(body)
    assert rows["two.bin", 0].body == head + body
    assert sources.section_listing(sections).count() == 2 and sources.pick_section(sections, 1).count() == 1
    headers = sources.parse_headers(sections)
    assert headers.where("field_name = 'Field I name'").count() == 2
    s = {r.log_id[-1]: r for r in sources.sys_config(headers, converted_firmware="Alpha", versioned_firmware="Alpha").collect()}
    assert (s["0"].fc_version, s["1"].fc_version) == ("4.3.1", "")
    assert (s["0"].p_num, s["0"].p_denom, s["0"].frame_interval_i, s["0"].pid_roll, s["0"].pid_yaw) == (1, 2, 32, [45, 80, 30], [0, 0, 0])
    assert abs(s["0"].gyro_scale / 1.7453292519943295e-8 - 1) < 1e-9 and s["0"].vbatmaxcellvoltage == 430
    assert str(s["0"].date_time) == "2024-05-06 07:08:09"
    assert sources.sys_config(headers).first().gyro_scale == 1.0 and sources.sys_config(headers).first().firmware_type == 1
    defs = sources.field_defs(headers).where("log_id like '%#0'")
    p = [(r.name, r.signed, r.predictor) for r in defs.where("frame_type = 'P'").orderBy("field_index").collect()]
    assert p == [("loopIteration", 0, 6), ("time", 0, 2), ("gyroADC[0]", 1, 1)]
    assert [r.predictor for r in defs.where("frame_type = 'G'").orderBy("field_index").collect()] == [10, 7, 256]
    assert [r.unit for r in units.list_fields(defs).orderBy("field_index").collect()] == ["", "s", "deg/s"]
    sources.write_headers_csv(headers, str(tmp_path / "h"))
    back = sources.read_headers_csv(spark, str(tmp_path / "h"))
    assert back.count() == headers.count()


def listed(sections):
    return {(os.path.basename(r.path), r.section_no): (r.start_offset, r.end_offset, r.body) for r in sections.collect()}


@pytest.mark.parametrize("size", ["7b", "40b", "1000b", "128m"])
def test_sections_of_byte_ranges(spark, tmp_path, size):
    """Ranges that begin and end anywhere, in a marker too, give the sections of the whole file."""
    random.seed(4)
    m = sources.MARKER
    texts = {"none": "nothing H Produc", "end": f"x{m}", "only": m, "two": m + m, "odd": f"H ProH Product{m[:-1]}{m}a"}
    for i in range(4):
        texts[f"r{i}"] = "".join(random.choice([m, m[:5], "\n", "\xe9\xff", "text ", "\x00"]) for _ in range(random.randint(3, 60)))
    for name, text in texts.items():
        write(tmp_path / name, text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = sources.read_log_sections(spark, str(tmp_path))
        assert listed(got) == listed(sources.split_sections(sources.read_log_files(spark, str(tmp_path)), m))
        longest = max(texts.values(), key=len)
        assert spark.read.option("lineSep", m).text(str(tmp_path)).rdd.getNumPartitions() >= min(len(longest) // int(size[:-1].replace("128", "9999")), 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_log_in_several_files_in_order(spark, tmp_path):
    f = spark.range(5000).selectExpr("if(id < 4500, 'a', 'b') as log_id", "(id * 7919) % 5000 as seq", "id as time")
    f = f.selectExpr("if(seq < 4500, 'a', 'b') as log_id", "seq", "time")
    sources.write_frames(f, str(tmp_path / "out"), "csv", parts=6)
    files = sorted((tmp_path / "out" / "log_id=a").glob("part-*"))
    assert len(files) >= 4
    places = [int(line.split(",")[0]) for p in files for line in p.read_text().splitlines()[1:]]
    assert places == list(range(4500))


def test_tables_out_and_in(spark, tmp_path):
    f = spark.createDataFrame(
        [("a", 10 * i, i, 1000 * i, 1600 - i) for i in range(5)],
        "log_id string, seq long, loopIteration long, time long, vbatLatest long"
    )
    sources.write_frames(f, str(tmp_path / "csv"), "csv", {"time": "us", "vbatLatest": "V"})
    back = sources.read_frames_csv(spark, str(tmp_path / "csv" / "log_id=a"), "a")
    assert [(r.time, r.vbatLatest) for r in back.orderBy("time").collect()] == [(1000.0 * i, 1600.0 - i) for i in range(5)]
    write(
        tmp_path / "golden.csv",
        "loopIteration, time (us), vbatLatest (V), flightModeFlags (flags)\n1, 10, 16.5, ANGLE_MODE\n2, x, 16.4, 0\n"
    )
    golden = sources.read_frames_csv(spark, str(tmp_path / "golden.csv"))
    assert [(r.time, r.vbatLatest, r.flightModeFlags) for r in golden.collect()] == [(10.0, 16.5, "ANGLE_MODE"), (None, 16.4, "0")]
    sources.write_frames(f, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5
    gps = spark.createDataFrame([("a", 2, 100, 7)], "log_id string, seq long, time long, GPS_numSat long")
    sources.write_gps_csv(gps, str(tmp_path / "gps"))
    assert spark.read.csv(str(tmp_path / "gps"), header=True).columns[0] == "time (us)"
    events = spark.createDataFrame(
        [("a", 7, 13, 5, 1, 3, 0.0, None), ("a", 8, 30, 6, None, None, None, None)],
        "log_id string, seq long, event_type int, time long, adjustment_function int, int_value long, float_value double, log_iteration long"
    )
    sources.write_events_json(units.decode_events(events), str(tmp_path / "ev"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "ev")).select("value").collect()]
    assert lines == [{"name": "Inflight adjustment", "time": 5, "data": {"adjustment_function": "RC_RATE", "value": 3.0}}]


def test_ingest_and_live_feed(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "log_id string, seq long, time long, motor_0 long"
    rows = [("a", i, (2**32 - 2500 + 1000 * i) % 2**32, 10 * i) for i in range(6)]
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[3:] + [("b", 0, 5, None)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    streaming.ingest(
        stream, lambda b: b.groupBy("log_id").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "c1")
    ).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 7
    limits = streaming.live_limits(stream, ["motor_0"])
    q = limits.writeStream.format("parquet").option("path", str(tmp_path / "live")).option(
        "checkpointLocation", str(tmp_path / "c2")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.log_id: r for r in spark.read.parquet(str(tmp_path / "live")).orderBy("n").collect()}
    assert last["a"].n == 6 and last["a"].time == 2**32 - 2500 + 5000 and (last["a"].min, last["a"].max) == (0, 50)
    assert last["b"].n == 1 and last["b"].min is None


class Held:
    """State of one log, held in plain values: what a processor may ask of its handle."""

    def __init__(self):
        self.value, self.map, self.timers, self.writes = None, {}, [], []
        self.getValueState = lambda *_: self
        self.getMapState = lambda *_: self
        self.exists, self.get, self.update = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v)
        self.containsKey, self.getValue = lambda k: k in self.map, lambda k: self.map[k]
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(self.timers), self.timers.remove, self.timers.append
        self.getCurrentProcessingTimeInMs = lambda: 1000

    def updateValue(self, k, v):  # noqa: N802
        self.map[k] = v
        self.writes.append(k[0])

    def clear(self):
        self.value = None
        self.map.clear()


def test_state_grows_with_changed_channels_alone():
    import pandas as pd

    held, limits = Held(), streaming.Limits(["a", "b"], silent_after_ms=500)
    limits.init(held)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["log_id", "seq", "time", "a", "b"])])
    first = pd.concat(limits.handleInputRows(("x",), batch(("x", 1, 10, 5.0, None), ("x", 0, 2**32 - 5, 1.0, None)), held))
    assert first.values.tolist()[0] == ["x", "a", 2**32 + 10, 2, 1.0, 5.0] and held.writes == ["a"] and held.timers == [1500]
    list(limits.handleInputRows(("x",), batch(("x", 2, 20, 3.0, 7.0)), held))
    assert held.writes == ["a", "b"] and held.value == (20, 2**32, 3) and held.timers == [1500]
    assert list(limits.handleExpiredTimer(("x",), held, None)) == [] and held.value is None and not held.map
