"""libpcap files as a Spark data source ("pcap") and sink.

A capture's records are chained by their lengths, so a file is one partition; many files run in parallel.
Files are opened through the Hadoop file system in ``read_pcap``, so any store that Spark reads works.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, no long, ts_us long, raw binary, incl_len int, orig_len int"
#: Magic numbers for microseconds and nanoseconds.
MICRO, NANO = 0xA1B2C3D4, 0xA1B23C4D


class PcapError(ValueError):
    """A file that does not begin with a capture header."""


def records(data: bytes | BinaryIO) -> Iterator[tuple[int, bytes, int, int]]:
    """(ts in microseconds, frame, captured length, original length), one at a time; a truncated last record ends quietly."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    top = f.read(24)
    if len(top) < 24:
        raise PcapError("short capture header")
    for order in "<>":
        magic = struct.unpack_from(order + "I", top)[0]
        if magic in (MICRO, NANO):
            break
    else:
        raise PcapError("not a capture file")
    head = struct.Struct(order + "IIII")
    while len(start := f.read(16)) == 16:
        sec, frac, incl, orig = head.unpack(start)
        raw = f.read(incl)
        if len(raw) < incl:
            return
        yield sec * 1_000_000 + (frac // 1000 if magic == NANO else frac), raw, incl, orig


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        import glob

        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part.removeprefix("file://")) or [part])

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for no, (ts, raw, incl, orig) in enumerate(records(f), 1):
                yield partition.path, no, ts, raw, incl, orig


class PcapDataSource(DataSource):
    """spark.dataSource.register(PcapDataSource); spark.read.format("pcap").load(path) for local paths of any size, read record by record."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(self.options)


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Captures in any store that Spark reads, one task a file, which holds the file (2 GB at most) but not its records."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path_, data in zip(b.column(0).to_pylist(), b.column(1)):
                found, i = records(data.as_py()), 0
                while some := list(islice(found, 10_000)):
                    ts, raw, incl, orig = zip(*some)
                    n = len(ts)
                    yield pa.RecordBatch.from_arrays([pa.array([path_] * n), pa.array(range(i + 1, i + n + 1), pa.int64()), pa.array(ts, pa.int64()), pa.array(raw, pa.binary()), pa.array(incl, pa.int32()), pa.array(orig, pa.int32())], ["path", "no", "ts_us", "raw", "incl_len", "orig_len"])
                    i += n

    return files.mapInArrow(run, SCHEMA)


def header(snaplen: int = 65535, linktype: int = 1) -> bytes:
    return struct.pack("<IHHiIII", MICRO, 2, 4, 0, 0, snaplen, linktype)


def record(ts_us: int, raw: bytes, orig_len: int | None = None, snaplen: int = 65535) -> bytes:
    kept = raw[:snaplen]
    return struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(kept), max(orig_len or 0, len(raw))) + kept


def write_pcap(df: DataFrame, path: str, snaplen: int = 65535, linktype: int = 1) -> int:
    """df: ts_us, raw[, orig_len], in the order of its rows. Streams partition by partition through the driver."""
    cols = ["ts_us", "raw"] + ["orig_len"] * ("orig_len" in df.columns)
    n = 0
    with open(path, "wb") as f:
        f.write(header(snaplen, linktype))
        for row in df.select(*cols).toLocalIterator():
            f.write(record(row[0], bytes(row[1]), row[2] if len(cols) > 2 else None, snaplen))
            n += 1
    return n


def frames_of_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots (ts seconds, hex, length) -> frames; records whose hex does not parse are left out."""
    good = snapshots.where(F.col("hex").rlike("^(?:[0-9a-fA-F]{2})+$"))
    return good.select((F.col("ts") * 1_000_000).cast("long").alias("ts_us"), F.unhex("hex").alias("raw"), F.col("length").cast("int").alias("orig_len"))
