"""Clips as a Spark data source. A clip is a folder of numbered frames (an image sequence) or a .npy stack of
HxWx3 or HxW frames: no video decoder is assumed. One clip is one partition, read as a stream of rows.

    spark.dataSource.register(ClipSource)
    spark.read.format("clip").option("paths", "a.npy,b.npy").option("fps", "0").load()

Live sources (webcam, RTSP) are read in micro-batches: spark.readStream.format("clip") reads a growing folder
of .npy chunks, in the order of their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "group_id string, source_video string, frame_index long, timestamp_s double, fps double, fps_is_measured boolean, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
FALLBACK_FPS = {"file": 30.0, "webcam": 30.0, "rtsp": 25.0}


def frame_rate(raw: str | None, kind: str) -> tuple[float, bool]:
    """(frames a second, whether that is measured)."""
    value = float(raw or 0)
    return (value, True) if np.isfinite(value) and value > 0 else (FALLBACK_FPS[kind], False)


def image_row(origin: str, frame: np.ndarray) -> tuple:
    h, w = frame.shape[:2]
    channels = 1 if frame.ndim == 2 else frame.shape[2]
    return (origin, h, w, channels, 16 if channels == 3 else 0 if channels == 1 else 24, np.ascontiguousarray(frame, np.uint8).tobytes())


class ClipPartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def rows_of(path: str, options: dict) -> Iterator[tuple]:
    """The rows of one clip, in order, indices from 0."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no clip at {path}")
    stack = np.load(path, mmap_mode="r", allow_pickle=False)
    fps, measured = frame_rate(options.get("fps"), options.get("kind", "file"))
    group = os.path.splitext(os.path.basename(path))[0]
    for i in range(len(stack)):
        yield group, f"{group}.mp4", i, i / fps, fps, measured, image_row(path, np.asarray(stack[i]))


class ClipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[ClipPartition]:
        return [ClipPartition(p) for p in self.options["paths"].split(",") if p]

    def read(self, partition: ClipPartition) -> Iterator[tuple]:
        yield from rows_of(partition.path, self.options)


class ClipStream(SimpleDataSourceStreamReader):
    """Chunks of a live source: each .npy of the folder in turn; the offset is the number of chunks seen."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def _chunks(self) -> list[str]:
        folder = self.options["folder"]
        return sorted(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".npy"))

    def initialOffset(self) -> dict:
        return {"chunks": 0, "frames": 0}

    def _rows(self, start: dict, chunks: list[str]) -> tuple[list[tuple], int]:
        out, at = [], start["frames"]
        fps, measured = frame_rate(self.options.get("fps"), self.options.get("kind", "webcam"))
        group = self.options.get("group", "live")
        most = int(self.options.get("max_frames", "3600"))
        for path in chunks:
            for frame in np.load(path, allow_pickle=False):
                if at < most:
                    out.append((group, f"{group}.mp4", at, at / fps, fps, measured, image_row(path, frame)))
                at += 1
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        chunks = self._chunks()[start["chunks"] :]
        rows, at = self._rows(start, chunks)
        return iter(rows), {"chunks": start["chunks"] + len(chunks), "frames": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start, self._chunks()[start["chunks"] : end["chunks"]])[0])

    def commit(self, end: dict) -> None:
        pass


class ClipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ClipReader:
        return ClipReader(dict(self.options))

    def simpleStreamReader(self, schema) -> ClipStream:
        kind = self.options.get("kind", "webcam")
        if kind == "rtsp" and not self.options.get("url", "").lower().startswith(("rtsp://", "rtsps://")):
            raise ValueError("an RTSP source needs a url that begins with rtsp:// or rtsps://")
        return ClipStream(dict(self.options))
