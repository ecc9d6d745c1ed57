"""WAV files as a Spark data source whose partitions are byte ranges: a long recording is many tasks, no file is one row.

The driver lists the files and their sizes. A task reads a file's header and the frames that begin in its range, in
blocks; small files share a task. Paths are those that ``pyarrow.fs`` opens: local, hdfs, s3, gs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "clip string, sample_rate int, block_no long, samples array<float>, error string"
ARROW = pa.schema([("clip", pa.string()), ("sample_rate", pa.int32()), ("block_no", pa.int64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
BLOCK = 4096
#: Bytes that a task reads, about.
SPLIT = 64 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(f, size: int) -> tuple[int, int, int, int]:
    """(channels, sample rate, place of the first frame, frames) of a 16-bit PCM file; a stated length beyond the file's end is cut."""
    if f.read(4) != b"RIFF" or f.seek(8) != 8 or f.read(4) != b"WAVE":
        raise ValueError("not a WAV file")
    form = None
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("no data in the file")
        name, n = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"data":
            break
        body = f.read(n + n % 2)
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("the format is cut off")
            form = struct.unpack("<HHIIHH", body[:16])
    if form is None or form[5] != 16 or form[0] not in (1, 0xFFFE) or not form[1]:
        raise ValueError("only 16-bit PCM is read")
    at = f.tell()
    return form[1], form[2], at, max(0, min(n, size - at)) // (2 * form[1])


def blocks(f, clip: str, size: int, low: int, high: int, block: int) -> Iterator[tuple]:
    """The blocks whose first frame's byte lies in low..high, counted from the first frame; a file that can't be read is one row with its error."""
    try:
        channels, rate, at, frames = header(f, size)
        step = 2 * channels * block
        first, last = -(-low // step), min(-(-high // step), -(-frames // block))
        if low == 0 and not frames:
            yield clip, rate, 0, [], None
        for i in range(first, last):
            f.seek(at + i * step)
            data = f.read(min(step, (frames - i * block) * 2 * channels))
            x = np.frombuffer(data, "<i2").astype(np.float32).reshape(-1, channels) / np.float32(32768)
            yield clip, rate, i, x.mean(axis=1) if channels > 1 else x[:, 0], None
    except Exception as e:  # noqa: BLE001  the error is the row
        if low == 0:
            yield clip, 0, 0, None, str(e)


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(0)
        self.ranges = ranges


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.block = int(options.get("block", BLOCK))
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        files, root = filesystem(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        parts, here, room = [], [], self.split
        for x in sorted((x for x in found if x.is_file and x.path.lower().endswith(".wav")), key=lambda x: x.path):
            for low in range(0, max(1, x.size), self.split):
                high = min(low + self.split, max(1, x.size))
                if here and high - low > room:
                    parts.append(Ranges(here))
                    here, room = [], self.split
                here.append((x.path, x.size, low, high))
                room -= high - low
        return [*parts, Ranges(here)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        for path, size, low, high in partition.ranges:
            with files.open_input_file(path) as f:
                for row in blocks(f, path.rsplit("/", 1)[-1], size, low, high, self.block):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, ARROW, strict=True)], schema=ARROW)


class WavSource(DataSource):
    """``spark.read.format("wav").option("block", frames of a block).option("split", bytes of a task).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def encode(samples: list[np.ndarray], rate: int) -> bytes:
    """A 16-bit PCM file of channels in -1..1; values are rounded down."""
    data = np.floor(np.clip(np.stack([np.asarray(c, np.float64) for c in samples], axis=1), -1, 1) * 32767).astype("<i2").tobytes()
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, n, rate, rate * 2 * n, 2 * n, 16) + b"data" + struct.pack("<I", len(data)) + data
