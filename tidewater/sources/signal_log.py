"""A log of signals as a replayable stream: a Python data source with offsets and partitions.

The log is a folder of segments, files of lines in the order of their names; only the last one grows. An offset is a segment
and a byte behind a line break, so that a batch is always the same lines however often it is read: a restart from a
checkpoint loses and repeats nothing, and a line that is still being written waits for its end. A batch is split into
partitions of at most split_bytes; a line belongs to the partition in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 8 << 20
TAIL_BYTES = 1 << 16


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Range(InputPartition):
    segment: str
    start: int
    end: int


class SignalLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def segments(self) -> list[tuple[str, int]]:
        """Name and size of each segment, in order."""
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))

    def whole_lines(self, name: str, size: int) -> int:
        """The byte behind the last line break of a segment."""
        system, root = _opened(self.path)
        with system.open_input_file(f"{root}/{name}") as file:
            while size > 0:
                start = max(0, size - TAIL_BYTES)
                at = file.read_at(size - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                size = start
        return 0

    def initialOffset(self) -> dict:
        return {"segment": "", "byte": 0}

    def latestOffset(self) -> dict:
        found = self.segments()
        if not found:
            return self.initialOffset()
        name, size = found[-1]
        return {"segment": name, "byte": self.whole_lines(name, size)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in self.segments():
            if not start["segment"] <= name <= end["segment"]:
                continue
            a = start["byte"] if name == start["segment"] else 0
            b = end["byte"] if name == end["segment"] else size
            out += [Range(name, k, min(b, k + self.split)) for k in range(a, b, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        if partition.start >= partition.end:
            return
        system, root = _opened(self.path)
        with system.open_input_file(f"{root}/{partition.segment}") as file:
            at, rest = partition.start, b""
            place = at
            if at:  # the line that an earlier partition began ends here, or just before
                at -= 1
                place = at
            file.seek(place)
            skip = at < partition.start
            while True:
                line, colon, after = rest.partition(b"\n")
                if not colon:
                    more = file.read(TAIL_BYTES)
                    if more:
                        rest += more
                        continue
                    if line and not skip and at < partition.end:
                        yield partition.segment, at, line.decode("utf-8", "replace")  # a complete segment without a last line break
                    return
                if not skip:
                    if at >= partition.end:
                        return
                    yield partition.segment, at, line.decode("utf-8", "replace")
                skip, at, rest = False, at + len(line) + 1, after


class SignalLog(DataSource):
    """format("signal_log").option("path", folder): segment, at (the byte where a line begins) and raw."""

    @classmethod
    def name(cls) -> str:
        return "signal_log"

    def schema(self) -> str:
        return "segment string, at long, raw string"

    def streamReader(self, schema) -> SignalLogReader:
        return SignalLogReader(self.options)


def log_stream(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES):
    """The lines of a log as a stream."""
    spark.dataSource.register(SignalLog)
    return spark.readStream.format("signal_log").option("path", path).option("split_bytes", split_bytes).load()
