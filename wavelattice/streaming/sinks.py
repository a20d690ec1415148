"""Sinks of named files, and HLS output of packets through them.

A sink has one method, ``write(name, content)``; a name that is written again
is replaced. Files appear whole: under a temporary name first, then renamed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from wavelattice.sources.muxers import ts_segment


class FolderSink:
    """Files below a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, name: str, content: bytes) -> None:
        path = os.path.join(self.folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, path)


class MemorySink:
    """Files in a dictionary, for one process."""

    def __init__(self):
        self.files: dict[str, bytes] = {}

    def write(self, name: str, content: bytes) -> None:
        self.files[name] = content


class CallSink:
    """Files handed to a function."""

    def __init__(self, call: Callable[[str, bytes], None]):
        self.call = call

    def write(self, name: str, content: bytes) -> None:
        self.call(name, content)


def playlist(durations: list[float], target_s: float, ended: bool, prefix: str = "seg") -> str:
    """A media playlist of numbered segments."""
    longest = max([target_s, *durations])
    lines = ["#EXTM3U", "#EXT-X-VERSION:7", f"#EXT-X-TARGETDURATION:{-int(-longest // 1)}", "#EXT-X-MEDIA-SEQUENCE:1"]
    for i, d in enumerate(durations, 1):
        lines += [f"#EXTINF:{d:.6f},", f"{prefix}{i:05d}.ts"]
    return "\n".join([*lines, *(["#EXT-X-ENDLIST"] if ended else [])]) + "\n"


def cut(packets: list[tuple[int, int, int, bool, bytes]], lead: int, target: int) -> Iterator[tuple[int, int, list]]:
    """(start, end, packets) of segments of (track, pts, dts, is_keyframe, payload): cut at key packets of the lead track."""
    start, own, last = None, [], 0
    for p in packets:
        track, pts, dts, key, _ = p
        if track == lead and key and (start is None or pts - start >= target):
            if start is not None:
                yield start, pts, own
            start, own = pts, []
        if start is not None:
            own.append(p)
            last = max(last, pts)
    if own:
        yield start, last, own


def write_hls(packets: DataFrame, sink, codecs: dict[int, str], lead: int, target_s: float) -> DataFrame:
    """Each source's packets (source_id, track_id, pts, dts, is_keyframe, payload; 90 kHz) as segments and a playlist in ``sink``.

    Gives source_id, name, duration_s and size of what was written. A task
    holds one source.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source_id"].iloc[0]
        rows = list(pdf.sort_values("dts", kind="stable")[["track_id", "pts", "dts", "is_keyframe", "payload"]].itertuples(index=False, name=None))
        counter, out, lengths = {}, [], []
        for i, (a, b, own) in enumerate(cut(rows, lead, round(target_s * 90_000)), 1):
            content = ts_segment(codecs, [(t, pts, dts, payload) for t, pts, dts, _, payload in own], counter)
            sink.write(f"{source}/seg{i:05d}.ts", content)
            lengths.append((b - a) / 90_000)
            out.append((source, f"seg{i:05d}.ts", lengths[-1], len(content)))
        text = playlist(lengths, target_s, True).encode()
        sink.write(f"{source}/index.m3u8", text)
        out.append((source, "index.m3u8", float(sum(lengths)), len(text)))
        return pd.DataFrame(out, columns=["source_id", "name", "duration_s", "size"])

    return packets.groupBy("source_id").applyInPandas(run, "source_id string, name string, duration_s double, size long")
