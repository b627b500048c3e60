"""Series operators: decimation, spectra and spectrograms of channels.

A channel is (log_id, channel, seq, t_s, v). Long logs are cut into short overlapping segments, which
spread over the cluster; only the Fourier transform of a segment leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import positions
from .stats import error_profile, estimate_sample_rate, motor_frequency
from .units import pid_error, to_channels, to_display_units, with_t_sec

PROPWASH_BAND, NOISE_BAND = (30.0, 90.0), (10.0, 150.0)


CHANNEL_KEYS = ("log_id", "channel")
#: Spectra held in a task before they are sent.
HELD_BYTES = 64 << 20


def _check(**ranges) -> None:
    for name, (value, low, high) in ranges.items():
        if not low <= value <= high:
            raise ValueError(f"{name} is {value}, not from {low} to {high}")


def downsample_minmax(channels: DataFrame, max_points: int) -> DataFrame:
    """At most max_points points of each channel that keep its spikes: of each bin of rows the first time with
    the least value and the last time with the greatest. Shorter channels stay as they are. Bin edges
    are those of evenly spaced doubles, cut to whole rows.
    """
    bins = max_points // 2
    rows = positions(channels, CHANNEL_KEYS).withColumnRenamed("total", "n")
    width = F.col("n") / F.lit(float(bins))
    guess = F.floor(((F.col("idx") + 1) * bins - 1) / F.col("n"))
    edge = lambda k: F.floor(k * width)
    bin_ = F.when(edge(guess) > F.col("idx"), guess - 1).when(
        (guess + 1 < bins) & (edge(guess + 1) <= F.col("idx")), guess + 1
    ).otherwise(guess)
    long = rows.where(F.col("n") > max_points) if max_points >= 2 else rows.limit(0)
    short = rows.where(F.col("n") <= max_points) if max_points >= 2 else rows
    binned = long.groupBy("log_id", "channel", bin_.alias("bin")).agg(
        F.min_by("t_s", "idx").alias("t0"), F.max_by("t_s", "idx").alias("t1"), F.min("v").alias("low"),
        F.max("v").alias("high")
    )
    points = binned.select("log_id", "channel", F.expr("stack(2, 2 * bin, t0, low, 2 * bin + 1, t1, high) as (point, t_s, v)"))
    return points.unionByName(short.select("log_id", "channel", F.col("idx").cast("long").alias("point"), "t_s", "v"))


def channel_series(frames: DataFrame, config: DataFrame, names: list[str], max_points: int = 4000) -> DataFrame:
    """Named channels in display units over seconds since the log's start, decimated for plotting."""
    _check(max_points=(max_points, 2, 20000))
    return downsample_minmax(to_channels(to_display_units(with_t_sec(frames), config), names), max_points)


def segments(channels: DataFrame, nperseg: int) -> DataFrame:
    """Overlapping full segments of finite values: (log_id, channel, segment, n, at, values).

    n is nperseg, or the channel's length if it is shorter; the hop is n - n // 2; ``at`` is the first
    sample's position. Channels with fewer than 8 values give none.
    """
    rows = positions(channels.where("v is not null and not isnan(v)"), CHANNEL_KEYS)
    rows = rows.withColumn("n", F.least(F.col("total"), F.lit(nperseg))).where("n >= 8")
    hop = F.expr("n - n div 2")
    last = F.expr("(total - n div 2) div (n - n div 2) - 1")
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - F.col("n")) / hop) + 1)
    within = rows.withColumns({"_first": first, "_last": F.least(F.floor(F.col("idx") / hop), last)}).where("_first <= _last")
    dealt = within.select("log_id", "channel", "n", "idx", "v", F.explode(F.sequence("_first", "_last")).alias("segment"))
    out = dealt.groupBy("log_id", "channel", "segment").agg(
        F.first("n").alias("n"), F.min("idx").alias("at"), F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("rows")
    )
    return out.select("log_id", "channel", "segment", "n", "at", F.col("rows.v").alias("values"))


def _densities(fs: np.ndarray, values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length, and their densities: one-sided, mean removed, periodic Hann window."""
    lengths, out = np.diff(values.offsets.to_numpy()), []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = values.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window)) ** 2 / (fs[at, None] * (window**2).sum())
        power[:, 1 : -1 if n % 2 == 0 else None] *= 2
        out.append((at, power))
    return out


def _with_rates(cut: DataFrame, rates: DataFrame) -> DataFrame:
    rates = rates.where("sample_rate > 0").select("log_id", F.col("sample_rate").alias("fs"))
    return cut.join(rates, "log_id").select("log_id", "channel", F.col("segment").cast("long"), F.col("n").cast("long"), "fs", "values")


def segment_psd(cut: DataFrame, rates: DataFrame) -> DataFrame:
    """One-sided power spectral density of each segment: mean removed, periodic Hann window."""

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            psd: list = [None] * len(batch)
            for at, power in _densities(batch.column(4).to_numpy(), batch.column(5)):
                for i, p in zip(at, power, strict=True):
                    psd[i] = p
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(psd, pa.list_(pa.float64()))], ["log_id", "channel", "segment", "n", "fs", "psd"]
            )

    return _with_rates(cut, rates).mapInArrow(transform, "log_id string, channel string, segment long, n long, fs double, psd array<double>")


_PARTIAL = "log_id string, channel string, n long, fs double, segments long, psd array<double>"


def partial_spectra(cut: DataFrame, rates: DataFrame) -> DataFrame:
    """Sums of the densities of a channel's segments, one row for each task that has some: they can be added up.

    What a task holds is bounded; beyond that it sends its sums and begins again.
    """
    names = [c.split()[0] for c in _PARTIAL.split(", ")]

    def rows(held: dict) -> pa.RecordBatch:
        keys = [[k[i] for k in held] for i in range(4)]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
        counts, sums = zip(*held.values(), strict=True)
        return pa.record_batch([*(pa.array(k, t) for k, t in zip(keys, kinds, strict=True)), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            log, channel, n = (batch.column(i).to_pylist() for i in (0, 1, 3))
            fs = batch.column(4).to_numpy()
            for at, power in _densities(fs, batch.column(5)):
                keys = [(log[i], channel[i], n[i], float(fs[i])) for i in at]
                number = {k: j for j, k in enumerate(dict.fromkeys(keys))}
                of = np.array([number[k] for k in keys])
                sums = np.zeros((len(number), power.shape[1]))
                np.add.at(sums, of, power)
                for (k, j), count in zip(number.items(), np.bincount(of).tolist(), strict=True):
                    if k in held:
                        held[k][0] += count
                        held[k][1] += sums[j]
                    else:
                        held[k] = [count, sums[j]]
                        size += sums[j].nbytes
            if size > HELD_BYTES:
                yield rows(held)
                held, size = {}, 0
        if held:
            yield rows(held)

    return _with_rates(cut, rates).mapInArrow(add_up, _PARTIAL)


def _bins(psd: DataFrame, max_freq: float) -> DataFrame:
    rows = psd.select("log_id", "channel", "segment", "n", "fs", F.posexplode("psd").alias("bin", "p"))
    return rows.withColumn("freq", F.col("bin") * F.col("fs") / F.col("n")).where(F.col("freq") <= max_freq)


def welch(channels: DataFrame, rates: DataFrame, max_freq: float, nperseg: int, least: int = 0) -> DataFrame:
    """(log_id, channel, bin, freq, psd): mean density over segments; channels of fewer than ``least`` rows give none.

    Densities are added up where they are computed; only sums are dealt out by bin.
    """
    if least:
        channels = _at_least(channels, least)
    sums = partial_spectra(segments(channels, nperseg), rates)
    rows = sums.select("log_id", "channel", "segments", (F.col("fs") / F.col("n")).alias("width"), F.posexplode("psd").alias("bin", "p"))
    rows = rows.where(F.col("bin") * F.col("width") <= max_freq)
    return rows.groupBy("log_id", "channel", "bin").agg(
        (F.col("bin") * F.first("width")).alias("freq"), (F.sum("p") / F.sum("segments")).alias("psd")
    )


def _at_least(channels: DataFrame, least: int) -> DataFrame:
    """The channels of so many rows and more; one row a channel is joined."""
    counts = channels.groupBy(*CHANNEL_KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return channels.join(counts, list(CHANNEL_KEYS), "left_semi")


def power_spectrum(frames: DataFrame, config: DataFrame, names: list[str], max_freq: float = 200, nperseg: int = 1024) -> DataFrame:
    """Welch spectrum of named channels in display units; logs of fewer than 32 rows give none."""
    _check(max_freq=(max_freq, 10, 1000), nperseg=(nperseg, 64, 8192))
    return welch(
        to_channels(to_display_units(with_t_sec(frames), config), names), estimate_sample_rate(frames), max_freq, nperseg,
        least=32
    )


def spectrum_info(frames: DataFrame, pole_pairs: int = 7, harmonics: int = 3) -> DataFrame:
    """Sample rate and motor harmonics of each log, to go with its spectra."""
    return estimate_sample_rate(frames).join(motor_frequency(frames, pole_pairs, harmonics), "log_id", "left")


def band_energy(psd: DataFrame, low: float, high: float, name: str = "energy") -> DataFrame:
    """Integral of the density over bins from low to high, both included, by trapezoids; one bin alone gives 0."""
    rows = psd.where(F.col("freq").between(low, high))
    w = Window.partitionBy("log_id", "channel").orderBy("bin")
    area = (F.col("psd") + F.lead("psd").over(w)) / 2 * (F.lead("freq").over(w) - F.col("freq"))
    return rows.withColumn("area", area).groupBy("log_id", "channel").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias(name))


def band_energies(psd: DataFrame, bands: dict[str, tuple[float, float]], peak: tuple[float, float]) -> DataFrame:
    """One row per channel with the energy of each named band, and peak_hz, the first strongest frequency from one to another."""
    w = Window.partitionBy("log_id", "channel").orderBy("bin")
    rows = psd.withColumns({"_f": F.lead("freq").over(w), "_p": F.lead("psd").over(w)})
    area = (F.col("psd") + F.col("_p")) / 2 * (F.col("_f") - F.col("freq"))
    sums = [
        F.coalesce(F.sum(F.when((F.col("freq") >= low) & (F.col("_f") <= high), area)), F.lit(0.0)).alias(name) for name,
        (low, high) in bands.items()
    ]
    strongest = F.max_by("freq", F.when(F.col("freq").between(*peak), F.struct("psd", -F.col("bin"))))
    return rows.groupBy("log_id", "channel").agg(*sums, strongest.alias("peak_hz"))


def spectrogram(
    frames: DataFrame, config: DataFrame, name: str, max_freq: float = 200, nperseg: int = 1024, max_time_bins: int = 256
) -> DataFrame:
    """(log_id, channel, column, time_s, bin, freq, power_db), floor -80 dB; evenly chosen segments if there are too many.

    Segments are chosen before they are transformed.
    """
    _check(max_freq=(max_freq, 10, 1000), nperseg=(nperseg, 64, 8192))
    channels = to_channels(to_display_units(with_t_sec(frames), config), [name])
    cut = segments(_at_least(channels, 32), nperseg)
    counts = cut.groupBy("log_id", "channel").agg((F.max("segment") + 1).alias("_s"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.col("_s"), F.lit(max_time_bins)).cast("int") - 1))
    target = F.when(F.col("_s") <= max_time_bins, F.col("column")).when(
        F.col("column") == max_time_bins - 1, F.col("_s") - 1
    ).otherwise(F.floor(F.col("column") * ((F.col("_s") - 1) / F.lit(float(max_time_bins - 1)))))
    chosen = counts.select("log_id", "channel", "_s", k.alias("column")).select(
        "log_id", "channel", "column", target.cast("long").alias("segment")
    )
    kept = chosen.select("log_id", "channel", "segment").distinct()
    psd = segment_psd(cut.join(kept, ["log_id", "channel", "segment"]), estimate_sample_rate(frames))
    rows = _bins(psd, max_freq).join(chosen, ["log_id", "channel", "segment"])
    start = F.col("segment") * F.expr("n - n div 2")
    return rows.select(
        "log_id", "channel", "column", ((start + F.col("n") / 2) / F.col("fs")).alias("time_s"), "bin", "freq",
        F.greatest(10 * F.log10(F.col("p") + 1e-30), F.lit(-80.0)).alias("power_db")
    )


def error_psd(display: DataFrame, rates: DataFrame, max_freq: float = 200, nperseg: int = 1024) -> DataFrame:
    """Welch spectrum of the tracking error; ``channel`` is the axis."""
    errors = pid_error(display).select("log_id", F.col("axis").alias("channel"), "seq", F.lit(0.0).alias("t_s"), F.col("error").alias("v"))
    return welch(errors, rates, max_freq, nperseg)


def pid_error_analysis(frames: DataFrame, config: DataFrame, max_freq: float = 200, nperseg: int = 1024) -> DataFrame:
    """One row per log and axis: rms, propwash energy (30-90 Hz), noise energy (10-150 Hz), their ratio, the strongest frequency of the propwash band, and the mean error by throttle bin."""
    _check(max_freq=(max_freq, 10, 1000), nperseg=(nperseg, 64, 8192))
    display = to_display_units(with_t_sec(frames), config)
    bands = {"propwash_energy": PROPWASH_BAND, "noise_energy": NOISE_BAND}
    energies = band_energies(
        error_psd(display, estimate_sample_rate(frames), max_freq, nperseg), bands, PROPWASH_BAND
    ).withColumnRenamed("channel", "axis")
    out = error_profile(display).join(energies, ["log_id", "axis"], "left").fillna(0.0, list(bands))
    ratio = F.when(F.col("noise_energy") > 0, F.col("propwash_energy") / F.col("noise_energy")).otherwise(0.0)
    return out.select(
        "log_id", "axis", "rms", "propwash_energy", "noise_energy", ratio.alias("propwash_ratio"), "peak_hz",
        "error_by_throttle"
    )
