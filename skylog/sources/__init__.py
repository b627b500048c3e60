"""Reading log files, headers and decoder tables, and writing tables out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylog.operators.scan import saved
from skylog.schema import CHANNEL, COLUMN

#: What the first header line of a section begins with; callers may give the whole line.
MARKER = "H Product:"
LONGEST_LINE = 1024
#: Sections whose places are sent to all readers.
SENT = 500_000


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def split_sections(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """(log_id, path, section_no, start_offset, end_offset, body): one section from each marker to the next.

    Files without a marker give one row with section_no null, so that they can be reported.
    """
    text = F.decode("content", "ISO-8859-1")
    parts = F.split(text, re.escape(marker).replace("\\ ", " "))
    rows = files.select("path", F.length(text).alias("_n"), parts.alias("_parts"))
    sizes = F.transform("_parts", lambda p: F.length(p))
    before = F.transform(
        F.sequence(F.lit(1), F.size("_parts") - 1),
        lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b) + (i - 1) * len(marker)
    )
    marked = rows.where(F.size("_parts") > 1).select(
        "path",
        F.posexplode(
            F.arrays_zip(F.slice("_parts", F.lit(2), F.size("_parts")).alias("rest"), before.alias("start"))
        ).alias("section_no", "s")
    )
    found = marked.select(
        F.concat_ws(
            "#", "path", F.col("section_no").cast("string")
        ).alias("log_id"), "path", "section_no", F.col("s.start").cast("long").alias("start_offset"),
        (
            F.col("s.start") + len(marker) + F.length("s.rest")
        ).cast("long").alias("end_offset"), F.concat(F.lit(marker), F.col("s.rest")).alias("body"),
    )
    without = rows.where(F.size("_parts") == 1).select(
        F.lit(None).cast("string"), "path", F.lit(None).cast("int"), F.lit(0).cast("long"), F.col("_n").cast("long"),
        F.lit(None).cast("string")
    )
    return found.union(without)


def read_log_sections(spark: SparkSession, path: str, marker: str = MARKER) -> DataFrame:
    """Sections of all files under a path, as ``split_sections`` has them, from files of any size.

    Files are read in byte ranges, as lines that the marker ends, so a file takes several tasks and a section
    is what has to fit in memory. Places come from the lengths of the sections before: a first job finds them, one
    narrow row for each section. Up to SENT of them (counted) are broadcast, so that the sections stay where they
    are read; more are joined by where they were read.
    """
    read = spark.read.option("lineSep", marker).option("recursiveFileLookup", "true").text(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_row"),
        F.col("value").cast("binary").alias("_rest"), F.octet_length("value").cast("long").alias("_n"),
    )
    order = Window.partitionBy("path").orderBy("_range", "_row")
    before = F.sum(F.col("_n") + len(marker)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = rows.select("path", "_size", "_range", "_row", "_n").withColumns(
        {"_at": F.coalesce(before, F.lit(0)), "_number": F.row_number().over(order) - 2, "_lines": F.count("*").over(Window.partitionBy("path"))}
    )
    # a marker at the very end begins a section, but no line
    end = F.col("_at") + F.col("_n")
    places = saved(places.withColumn("_ends", end + len(marker) == F.col("_size")))
    known = F.broadcast(places) if places.limit(SENT + 1).count() <= SENT else places
    found = rows.join(known.select("path", "_range", "_row", "_at", "_number", "_lines", "_ends"), ["path", "_range", "_row"])
    body = F.concat(F.lit(marker), F.decode("_rest", "ISO-8859-1"))
    log_id = F.concat_ws("#", "path", F.col("section_no").cast("string")).alias("log_id")
    section = [log_id, "path", "section_no", "start_offset", "end_offset", "body"]
    sections = found.where("_number >= 0").select(
        "path", F.col("_number").cast("int").alias("section_no"), (F.col("_at") - len(marker)).alias("start_offset"),
        (F.col("_at") + F.col("_n")).alias("end_offset"), body.alias("body"),
    ).select(section)
    last = places.where("_ends").select(
        "path", (F.col("_number") + 1).cast("int").alias("section_no"), end.alias("start_offset"), F.col("_size").alias("end_offset"),
        F.lit(marker).alias("body"),
    ).select(section)
    without = places.where("_lines = 1 and not _ends").select(
        F.lit(None).cast("string").alias("log_id"), "path", F.lit(None).cast("int").alias("section_no"),
        F.lit(0).cast("long").alias("start_offset"), F.col("_size").alias("end_offset"), F.lit(None).cast("string").alias("body"),
    )
    return sections.unionByName(last).unionByName(without)


def section_listing(sections: DataFrame) -> DataFrame:
    """Number, start and size of each section of each file."""
    return sections.where("section_no is not null").select(
        "path", "section_no", "start_offset", (F.col("end_offset") - F.col("start_offset")).alias("size")
    )


def pick_section(sections: DataFrame, number: int) -> DataFrame:
    """One section of each file, by its number from 0."""
    return sections.where(F.col("section_no") == number)


def parse_headers(sections: DataFrame) -> DataFrame:
    """(log_id, line_no, field_name, field_value) of header lines "H name:value", up to the first line that is none.

    The first colon splits; lines are cut at ``LONGEST_LINE`` bytes or a NUL.
    """
    block = F.regexp_extract("body", r"^((?:H[^\n]*\n)+)", 1)
    lines = sections.where("section_no is not null").select("log_id", F.posexplode(F.split(block, "\n")).alias("line_no", "line"))
    cut = F.regexp_extract(F.substring("line", 1, LONGEST_LINE), r"^([^\x00]*)", 1)
    named = lines.select(
        "log_id", "line_no", F.regexp_extract(cut, r"^H ([^:]*):(.*)$", 1).alias("field_name"),
        F.regexp_extract(cut, r"^H ([^:]*):(.*)$", 2).alias("field_value")
    )
    return named.where("field_name != ''")


def _int(text: Column) -> Column:
    """Leading digits as C's atoi reads them; 0 without any."""
    return F.coalesce(F.regexp_extract(F.trim(text), r"^([+-]?\d{1,10})", 1).try_cast("int"), F.lit(0))


def _ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), _int)


def _float32(text: Column) -> Column:
    """A hexadecimal bit pattern as a float; 1.0 if it isn't one."""
    bits = F.conv(F.regexp_extract(F.lower(text), r"^(?:0x)?([0-9a-f]{1,8})$", 1), 16, 10).try_cast("long")
    sign = F.when(bits >= 1 << 31, -1.0).otherwise(1.0)
    exponent, mantissa = F.floor(bits / (1 << 23)) % 256, bits % (1 << 23)
    value = F.when(exponent == 0, mantissa * 2.0**-149).otherwise((1 + mantissa / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127))
    return F.coalesce(sign * value, F.lit(1.0))


#: Header names of settings with one number, their column and default.
_NUMBERS = {
    "I interval": ("frame_interval_i", 32), "Data version": ("data_version", 0), "minthrottle": ("minthrottle", 1150), "maxthrottle": ("maxthrottle", 1850), "rcRate": ("rc_rate", 90),
    "vbatscale": ("vbatscale", 110), "vbatref": ("vbatref", 4095), "acc_1G": ("acc_1g", 1), "dterm_lpf1_static_hz": ("dterm_lpf1_static_hz", 0), "dterm_lpf2_static_hz": ("dterm_lpf2_static_hz", 0),
    "gyro_lpf1_static_hz": ("gyro_lpf1_static_hz", 0), "gyro_lpf2_static_hz": ("gyro_lpf2_static_hz", 0), "yaw_lowpass_hz": ("yaw_lowpass_hz", 0),
}
_LISTS = {"rollPID": "pid_roll", "pitchPID": "pid_pitch", "yawPID": "pid_yaw", "d_min": "d_min", "ff_weight": "ff_weight"}


#: The firmware type, as headers write it, whose gyro scales are converted, and the name before a version that counts.
CONVERTED_FIRMWARE, VERSIONED_FIRMWARE = "Cleanflight", "Betaflight"


def sys_config(
    headers: DataFrame, converted_firmware: str = CONVERTED_FIRMWARE, versioned_firmware: str | None = VERSIONED_FIRMWARE,
    scale_fix: bool = False
) -> DataFrame:
    """One row of typed settings per log; defaults where the header has none, the last line where it repeats.

    A gyro scale is converted to radians and microseconds if no firmware type stands before it, or
    ``converted_firmware`` does; after any other type it is taken as it is, unless ``scale_fix`` converts
    all. firmware_type is 0 without such a line, 2 for ``converted_firmware`` and 1 for any other. A
    version counts if the revision begins with ``versioned_firmware`` (any name if that is None).
    """
    line = lambda *names: F.max(F.when(F.col("field_name").isin(*names), F.col("line_no")))
    value = lambda name: F.max_by(F.when(F.col("field_name") == name, F.col("field_value")), F.when(F.col("field_name") == name, F.col("line_no")))
    names = [
        *_NUMBERS, *_LISTS, "P interval", "Firmware type", "Firmware revision", "vbatcellvoltage", "currentMeter", "gyro_scale",
        "gyro.scale", "motorOutput", "Log start datetime"
    ]
    wide = headers.groupBy("log_id").agg(
        *(value(n).alias(n.replace(".", "_dot_")) for n in names), line("Firmware type").alias("_type_line"),
        line("gyro_scale", "gyro.scale").alias("_scale_line")
    )
    c = lambda n: F.col(f"`{n}`")
    number = {
        column: F.coalesce(F.when(c(name).isNotNull(), _int(c(name))), F.lit(default)) for name,
        (column, default) in _NUMBERS.items()
    }
    number["frame_interval_i"] = F.greatest(number["frame_interval_i"], F.lit(1))
    triple = lambda n: F.when(F.size(_ints(c(n))) >= 3, F.slice(_ints(c(n)), 1, 3)).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))
    at = lambda n, i, least, default: F.coalesce(F.when(F.size(_ints(c(n))) >= least, F.try_element_at(_ints(c(n)), F.lit(i))), default if isinstance(default, Column) else F.lit(default))
    ratio = F.split(c("P interval"), "/", 2)
    slash = F.contains(c("P interval"), F.lit("/"))
    raw_scale = F.coalesce(c("gyro_scale"), c("gyro_dot_scale"))
    scale = F.when(raw_scale.isNull(), 1.0).otherwise(_float32(raw_scale))
    typed = F.coalesce(F.col("_type_line") < F.col("_scale_line"), F.lit(False))
    named = F.coalesce(c("Firmware type") == converted_firmware, F.lit(False))
    converts = (F.lit(scale_fix) | ~typed | named) & raw_scale.isNotNull()
    revision = F.split(c("Firmware revision"), " ")
    known = F.lit(True) if versioned_firmware is None else revision[0] == versioned_firmware
    return wide.select(
        "log_id", F.coalesce(
            F.when(known, F.try_element_at(revision, F.lit(2))), F.lit("")
        ).alias("fc_version"), *(v.alias(k) for k, v in number.items()),
        F.when(c("Firmware type").isNull(), 0).when(named, 2).otherwise(1).alias("firmware_type"),
        F.when(slash, _int(ratio[0])).otherwise(1).alias("p_num"), F.when(
            slash, _int(F.try_element_at(ratio, F.lit(2)))
        ).otherwise(1).alias("p_denom"),
        *(
            at("vbatcellvoltage", i + 1, 3, d).alias(n) for i,
            (n, d) in enumerate((("vbatmincellvoltage", 33), ("vbatwarningcellvoltage", 35), ("vbatmaxcellvoltage", 43)))
        ),
        at("currentMeter", 1, 2, 0).alias("current_meter_offset"), at("currentMeter", 2, 2, 400).alias("current_meter_scale"),
        at(
            "motorOutput", 1, 2, number["minthrottle"]
        ).alias("motor_output_low"), at("motorOutput", 2, 2, number["maxthrottle"]).alias("motor_output_high"),
        *(triple(n).alias(k) for n, k in _LISTS.items()), F.when(converts, F.radians(scale) * 1e-6).otherwise(scale).alias("gyro_scale"),
        F.try_to_timestamp(
            F.regexp_extract(c("Log start datetime"), r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")
        ).alias("date_time"),
    )


def field_defs(headers: DataFrame) -> DataFrame:
    """(log_id, frame_type, field_index, name, signed, predictor, encoding); P frames take names and signs from I frames.

    In G frames the second of two neighbouring home-coordinate predictors (7) becomes 256.
    """
    parts = headers.select(
        "log_id", F.regexp_extract("field_name", r"^Field (.) (name|signed|predictor|encoding)$", 1).alias("frame_type"),
        F.regexp_extract("field_name", r"^Field (.) (\w+)$", 2).alias("part"), "field_value"
    ).where("frame_type != ''")
    items = parts.select("log_id", "frame_type", "part", F.posexplode(F.split("field_value", ",")).alias("field_index", "item"))
    of = lambda p: F.max(F.when(F.col("part") == p, F.col("item")))
    rows = items.groupBy("log_id", "frame_type", "field_index").agg(
        of("name").alias("name"), of("signed").cast("int").alias("signed"), of("predictor").cast("int").alias("predictor"),
        of("encoding").cast("int").alias("encoding")
    )
    i = rows.where("frame_type = 'I'").select(
        "log_id", "field_index", F.col("name").alias("_name"), F.col("signed").alias("_signed"), F.lit("P").alias("frame_type")
    )
    rows = rows.join(i, ["log_id", "field_index", "frame_type"], "left").withColumns(
        {"name": F.coalesce("name", "_name"), "signed": F.coalesce("signed", "_signed")}
    )
    before = F.lag("predictor").over(Window.partitionBy("log_id", "frame_type").orderBy("field_index"))
    second = (F.col("frame_type") == "G") & (F.col("predictor") == 7) & (before == 7)
    return rows.withColumn("predictor", F.when(second, 256).otherwise(F.col("predictor"))).where("name is not null").select(
        "log_id", "frame_type", "field_index", "name", "signed", "predictor", "encoding"
    )


def write_headers_csv(headers: DataFrame, path: str) -> None:
    """fieldname and fieldvalue, quoted, in a folder for each log."""
    rows = headers.select("log_id", F.col("field_name").alias("fieldname"), F.col("field_value").alias("fieldvalue"))
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.partitionBy("log_id").csv(path, header=True, quoteAll=True, escape='"', **blanks)


def read_headers_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, header=True, escape='"', schema="fieldname string, fieldvalue string, log_id string"
    ).select("log_id", F.col("fieldname").alias("field_name"), F.col("fieldvalue").alias("field_value"))


def read_frames_csv(spark: SparkSession, path: str, log_id: str | None = None) -> DataFrame:
    """A decoder's CSV: blanks before names and " (unit)" behind them go, numbers are cast, texts stay."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    plain = {c: re.sub(r"\s*\([^)]*\)$", "", c.strip()) for c in raw.columns}
    texts = {"frame_type", "log_id", "flightModeFlags", "stateFlags", "failsafePhase"}
    cast = [
        F.col(f"`{c}`").alias(n) if n in texts else F.col(f"`{c}`").try_cast("double").alias(COLUMN.get(n, n)) if n != "seq" else F.col(f"`{c}`").cast("long").alias(n) for c,
        n in plain.items()
    ]
    out = raw.select(*cast)
    return out if log_id is None else out.withColumn("log_id", F.lit(log_id))


def _suffixed(df: DataFrame, units: dict[str, str]) -> DataFrame:
    names = {c: CHANNEL.get(c, c) for c in df.columns}
    return df.select(*(F.col(c).alias(f"{n} ({units[c]})" if c in units else n) if c != "log_id" else F.col(c) for c, n in names.items()))


def in_stream_order(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt out by ranges of log and place, in order inside each: a long log takes several parts, and the parts' numbers follow its stream."""
    dealt = df.repartitionByRange("log_id", "seq") if parts is None else df.repartitionByRange(parts, "log_id", "seq")
    return dealt.sortWithinPartitions("log_id", "seq")


def write_frames(df: DataFrame, path: str, fmt: str = "parquet", units: dict[str, str] | None = None, parts: int | None = None) -> None:
    """A folder for each log, rows in stream order, CSV names with their units.

    A log has one file or several, whose names are in the order of its stream.
    """
    rows = in_stream_order(df, parts)
    if fmt == "csv":
        _suffixed(rows, units or {}).write.partitionBy("log_id").csv(path, header=True)
    elif fmt == "parquet":
        rows.write.partitionBy("log_id").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_gps_csv(gps: DataFrame, path: str, units: dict[str, str] | None = None, parts: int | None = None) -> None:
    """GPS rows in stream order, their own time first."""
    rest = [c for c in gps.columns if c not in ("log_id", "seq", "time")]
    rows = in_stream_order(gps, parts).select("log_id", "time", *rest)
    _suffixed(rows, units or {"time": "us"}).write.partitionBy("log_id").csv(path, header=True)


def write_events_json(events: DataFrame, path: str, parts: int | None = None) -> None:
    """One JSON object a line, in stream order: name, time and, where an event has any, data."""
    in_stream_order(events, parts).select("log_id", F.to_json(F.struct("name", "time", "data")).alias("value")).write.partitionBy("log_id").text(path)
