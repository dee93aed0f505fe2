"""Signal descriptors on arrays: cleaning, spectrum by overlapping windows, band powers and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bands in Hz.
BANDS = {"total": (1.0, 45.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
NAMES = ["theta_rel", "alpha_rel", "beta_rel", "theta_alpha_ratio", "median_freq", "sef95"]


def butterworth(low: float, high: float, rate: float, order: int = 4) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a1 a2) of a Butterworth band-pass by the bilinear transform."""
    w = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, center = w[1] - w[0], w[0] * w[1]
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = poles * width / 2
    root = np.sqrt(half**2 - center + 0j)
    s = np.concatenate([half + root, half - root])
    z = (2 * rate + s) / (2 * rate - s)
    z = sorted(z[z.imag > 0], key=lambda p: abs(p)) if (abs(z.imag) > 1e-12).all() else list(z)
    sections = [np.array([1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2]) for p in z]
    at = np.exp(1j * 2 * np.arctan(np.sqrt(center) / (2 * rate)))
    for q in sections:  # gain 1 at the centre of the band
        gain = abs((q[0] + q[2] * at**-2) / (1 + q[3] * at**-1 + q[4] * at**-2))
        q[:3] /= gain
    return sections


#: Samples that one product of matrices filters.
BLOCK = 256


def settled(first: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The state (2, signal) of a section that has had its first value for ever."""
    b0, b1, b2, a1, a2 = q
    step = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = (b2 - a2 * step) * first
    return np.stack([(b1 - a1 * step) * first + z2, z2])


def section(x: np.ndarray, q: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section over signals (time, signal) from a state on, and the state after them, so a signal may come in chunks.

    Within a block of samples the output is a product with the impulse responses plus the response to the block's state; the
    states of all blocks follow from each other by a power of the section's matrix.
    """
    b0, b1, b2, a1, a2 = q
    n, k = x.shape
    step, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ step)
    impulse = np.array([b0, *[(p @ enter)[0] for p in powers[: BLOCK - 1]]])
    late = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    answer = np.where(late >= 0, impulse[np.maximum(late, 0)], 0.0)  # of each sample to each before it
    free = np.stack([p[0] for p in powers[:BLOCK]])  # to the state
    gather = np.stack([powers[BLOCK - 1 - i] @ enter for i in range(BLOCK)], axis=1)  # the state that a block leaves behind
    blocks = n // BLOCK
    out = np.empty_like(x)
    if blocks:
        cut = x[: blocks * BLOCK].reshape(blocks, BLOCK, k).transpose(1, 0, 2).reshape(BLOCK, blocks * k)
        left = (gather @ cut).reshape(2, blocks, k)
        states = np.empty((2, blocks, k))
        for i in range(blocks):
            states[:, i] = state
            state = powers[BLOCK] @ state + left[:, i]
        out[: blocks * BLOCK] = (answer @ cut + free @ states.reshape(2, blocks * k)).reshape(BLOCK, blocks, k).transpose(1, 0, 2).reshape(-1, k)
    if m := n - blocks * BLOCK:
        rest = x[blocks * BLOCK :]
        out[blocks * BLOCK :] = answer[:m, :m] @ rest + free[:m] @ state
        state = powers[m] @ state + gather[:, BLOCK - m :] @ rest
    return out, state


def zero_phase(x: np.ndarray, sections: list[np.ndarray], pad: int = 24) -> np.ndarray:
    """Forward and backward over signals (time, signal), with odd reflection at both ends; each section begins settled on its first value."""
    pad = min(pad, len(x) - 1)
    y = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]]) if pad else x
    for _ in range(2):
        for q in sections:
            y, _ = section(y, q, settled(y[0], q))
        y = y[::-1]
    return y[pad : len(y) - pad] if pad else y


def clean(x: np.ndarray, rate: float, low: float = 1.0, high: float = 45.0, limit: float = 8.0) -> np.ndarray:
    """Signals (time, signal): gaps filled, centred, detrended, band-passed, robustly scaled and clipped."""
    x = x.astype(float).copy()
    t = np.arange(len(x))
    for j in range(x.shape[1]):
        ok = np.isfinite(x[:, j])
        x[:, j] = np.interp(t, t[ok], x[ok, j]) if ok.any() else 0.0
    x -= np.median(x, axis=0)
    if len(x) > 1:
        c = t - t.mean()
        x -= x.mean(axis=0) + np.outer(c, c @ x / (c @ c))
    if len(x) > 3:
        x = zero_phase(x, butterworth(low, min(high, 0.49 * rate), rate))
    x -= np.median(x, axis=0)
    mad = 1.4826 * np.median(np.abs(x), axis=0)
    sd = x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    scale = np.where(mad > 0, mad, np.where(sd > 0, sd, 1.0))
    return np.clip(x / scale, -limit, limit)


def spectrum(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """Mean power of Hamming windows (symmetric) over signals (signal, time), not doubled, not scaled by the rate."""
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(window) / (window - 1))
    parts = np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, ::hop] * w
    return (np.abs(np.fft.rfft(parts, axis=2)) ** 2).mean(axis=1) / (w @ w)


def describe(x: np.ndarray, rate: float, window: int, hop: int, top: float = 45.0) -> dict[str, np.ndarray]:
    """Relative band powers, theta-alpha ratio, median frequency and 95% edge of signals (signal, time).

    Bands take both of their end bins; the last bin of the grid has no weight. Shares add up from 0 Hz on.
    """
    f = np.arange(window // 2 + 1) * rate / window
    keep = f <= top
    f, p = f[keep], spectrum(x, window, hop)[:, keep]
    weight = np.ones(len(f))
    weight[-1] = 0
    power = {k: (p * weight)[:, (f >= a) & (f <= b)].sum(axis=1) for k, (a, b) in BANDS.items()}
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {f"{k}_rel": power[k] / power["total"] for k in ("theta", "alpha", "beta")}
        out["theta_alpha_ratio"] = power["theta"] / power["alpha"]
        share = np.cumsum(p, axis=1) / p.sum(axis=1, keepdims=True)
    for name, level in (("median_freq", 0.5), ("sef95", 0.95)):
        out[name] = f[(share >= level).argmax(axis=1)]
    return out


def describe_arrays(df: DataFrame, keys: list[str], array: str, rate: float, window: int, hop: int, cleaned: bool = False) -> DataFrame:
    """(keys, descriptors) of one signal in each row; rows whose arrays are shorter than a window or null are left out."""
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), *(f"{n} double" for n in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(array).value_lengths().fill_null(0).to_numpy()
            for size in np.unique(n[n >= window]):
                own = pa.array(np.flatnonzero(n == size))
                x = batch.column(array).take(own).flatten().to_numpy().reshape(len(own), size).astype(float)
                x = clean(x.T, rate).T if cleaned else x
                d = describe(x, rate, window, hop)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(own) for k in keys], *[pa.array(d[c], pa.float64()) for c in NAMES]], names=[*keys, *NAMES])

    return df.select(*keys, array).mapInArrow(run, schema)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of signals (signal, time) over the samples that both have; NaN without spread."""
    ok = np.isfinite(a) & np.isfinite(b)
    n = np.maximum(ok.sum(axis=1, keepdims=True), 1)
    a, b = (np.where(ok, x, 0.0) for x in (a, b))
    a, b = (np.where(ok, x - x.sum(axis=1, keepdims=True) / n, 0.0) for x in (a, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def channel_names(channels: list[str]) -> list[str]:
    """Names of the descriptors of several channels: each channel's, the correlations of all pairs, and means over the channels."""
    pairs = [f"{a}_{b}_corr" for i, a in enumerate(channels) for b in channels[i + 1 :]]
    return [*[f"{c}_{n}" for c in channels for n in NAMES], *pairs, *[f"mean_{n}" for n in NAMES[3:]]]


def describe_channels(x: dict[str, np.ndarray], rate: float, window: int, hop: int) -> dict[str, np.ndarray]:
    """Those descriptors of segments, given as one array (segment, time) for each channel; means leave out what isn't finite."""
    of = {c: describe(v, rate, window, hop) for c, v in x.items()}
    out = {f"{c}_{n}": of[c][n] for c in x for n in NAMES}
    names = list(x)
    out |= {f"{a}_{b}_corr": correlation(x[a], x[b]) for i, a in enumerate(names) for b in names[i + 1 :]}
    for n in NAMES[3:]:
        values = np.stack([of[c][n] for c in x])
        ok = np.isfinite(values)
        with np.errstate(invalid="ignore"):
            out[f"mean_{n}"] = np.where(ok, values, 0).sum(axis=0) / np.where(ok.any(axis=0), ok.sum(axis=0), np.nan)
    return out


def bad_segments(x: np.ndarray, limit: float = 8.0, least_std: float = 0.05, most_jump: float = 5.0, high: float = 5.0, share: float = 0.05) -> np.ndarray:
    """Which segments (segment, channel, time) are rejected: for a value, a flat channel, a jump, or too many high values."""
    with np.errstate(invalid="ignore"):
        odd = ~np.isfinite(x).all(axis=(1, 2)) | (np.abs(x).max(axis=(1, 2)) > limit)
        flat = (x.std(axis=2, ddof=1) < least_std).any(axis=1)
        return odd | flat | (np.abs(np.diff(x, axis=2)).max(axis=(1, 2)) > most_jump) | ((np.abs(x) > high).mean(axis=(1, 2)) > share)


def segment_channels(df: DataFrame, keys: list[str], channels: list[str], rate: float, length: int, hop: int, window: int, cleaned: bool = True) -> DataFrame:
    """(keys, segment, descriptors) of the good segments of signals with several channels (arrays of equal length), one signal a row.

    segment: its place among all segments of the signal, from 0. Signals shorter than a segment, or null, have none.
    """
    names = channel_names(channels)
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "segment int", *(f"{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [batch.column(c)[i].as_py() for c in channels]
                if any(a is None for a in arrays) or min(map(len, arrays)) < length:
                    continue
                n = min(map(len, arrays))
                x = np.array([[np.nan if v is None else v for v in a[:n]] for a in arrays], float)
                x = clean(x.T, rate).T if cleaned else x
                parts = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::hop].swapaxes(0, 1)
                good = np.flatnonzero(~bad_segments(parts))
                if len(good):
                    d = describe_channels({c: parts[good, j] for j, c in enumerate(channels)}, rate, window, window // 2)
                    own = pa.array(np.full(len(good), i))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(own) for k in keys], pa.array(good, pa.int32()), *[pa.array(d[c], pa.float64()) for c in names]], names=[*keys, "segment", *names])

    return df.select(*keys, *channels).mapInArrow(run, schema)
