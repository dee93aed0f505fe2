"""From parsed signal files to one row of features for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import segments, signal

CHANNELS = ["ch1", "ch2"]


def file_features(signals: DataFrame, key: str, rate: float = 250.0, seconds: float = 10.0, overlap: float = 0.5, window: int = 500, cap: int | None = None, seed: int = 11, channels: list[str] = CHANNELS, cleaned: bool = True) -> DataFrame:
    """(key, num_segments, and mean, std, median and IQR of each descriptor) of files (key, ch1, ch2, ...).

    A file is cleaned as a whole, cut into segments, and its good segments are described, capped at `cap` and rolled up. Files
    without a good segment give no row. A file is one row, so its samples are in one task, as they were when it was parsed.
    """
    length = round(rate * seconds)
    hop = max(1, round(length * (1 - overlap)))
    described = signal.segment_channels(signals, [key], channels, rate, length, hop, window, cleaned)
    if cap is not None:
        described = segments.cap_segments(described, key, cap, seed)
    return segments.roll_up(described, key, signal.channel_names(channels))
