"""Column names of the frame tables. Every table has log_id and seq, the position in the log's stream."""

AXES = ("roll", "pitch", "yaw")

#: Main-frame fields, in recording order, with the number of elements (0: a single field).
MAIN_FIELDS = (
    ("axisP", 3), ("axisI", 3), ("axisD", 3), ("axisF", 3), ("rcCommand", 4), ("setpoint", 4), ("vbatLatest", 0), ("amperageLatest", 0),
    ("magADC", 3), ("baroAlt", 0), ("surfaceRaw", 0), ("rssi", 0), ("gyroADC", 3), ("gyroUnfilt", 3), ("accSmooth", 3), ("imuQuaternion", 3),
    ("debug", 8), ("motor", 8), ("servo", 8), ("eRPM", 8),
)
KEYS = ("log_id", "seq", "frame_type")


def columns(field: str, n: int) -> list[str]:
    return [f"{field}_{i}" for i in range(n)] or [field]


MAIN_COLUMNS = ("loopIteration", "time", *(c for f, n in MAIN_FIELDS for c in columns(f, n)))
#: Names as recorded: gyroADC_0 is gyroADC[0].
CHANNEL = {
    c: f"{f}[{i}]" if n else f for f, n in MAIN_FIELDS for i, c in enumerate(columns(f, n))
} | {"loopIteration": "loopIteration", "time": "time"}
COLUMN = {v: k for k, v in CHANNEL.items()}
SLOW_COLUMNS = ("flightModeFlags", "stateFlags", "failsafePhase", "rxSignalReceived", "rxFlightChannelsValid")
GPS_COLUMNS = ("GPS_numSat", "GPS_coord_0", "GPS_coord_1", "GPS_altitude", "GPS_speed", "GPS_ground_course")


def present(df, names) -> list[str]:
    """Those of the names that are columns of df, in the order given."""
    return [n for n in names if n in df.columns]
