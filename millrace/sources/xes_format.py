"""XES as a format of Spark's readers: ``spark.read.format("xes")`` and ``spark.readStream.format("xes")`` after ``register(spark)``.

Large files are read in byte ranges: a range owns the traces that start in it.  Ranges are packed into tasks.  Only the attributes of the asked-for schema are parsed.
A row carries the file and the byte at which its trace starts, which is its place in the log whatever the ranges.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from millrace.model import BRONZE_CASES, BRONZE_EVENTS
from millrace.sources.xes import CASE_ATTRIBUTES, EVENT_ATTRIBUTES, KINDS

PLACE = StructType().add("log_file", StringType()).add("trace_offset", LongType())
EVENTS, CASES = (StructType([StructField(f.name, f.dataType) for f in [*t.fields, *PLACE.fields]]) for t in (BRONZE_EVENTS, BRONZE_CASES))

OPEN = re.compile(rb"<trace(?=[\s/>])")
CLOSE = b"</trace>"
#: Bytes read at once at most, bytes of a range, rows of a batch.
BLOCK, RANGE, ROWS = 1 << 20, 64 << 20, 4096
#: Tasks of a read: more ranges than these are packed, as far as a task's bytes stay under the bound.
TASKS, TASK = 2048, 64 << 20


@dataclass
class Range:
    path: str
    start: int
    end: int | None  # None: to the end, for files that cannot be entered in the middle
    size: int  # bytes, packed ones for such files


@dataclass
class Ranges(InputPartition):
    """What one task reads, range by range."""

    ranges: list[Range]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of a log or of the logs in a folder, names with a leading dot or underscore left out, by time and path."""
    system, inner = _opened(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f.mtime_ns or 0, prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def ranges(path: str, size: int, width: int) -> list[Range]:
    if path.endswith(".gz"):
        return [Range(path, 0, None, size)]
    return [Range(path, a, min(a + width, size), min(width, size - a)) for a in range(0, size, width)]


def packed(parts: list[Range]) -> list[Ranges]:
    """Ranges in their order as tasks: one each, or several where there are many, so that the cost of tasks does not grow with small ranges or files."""
    most = min(TASK, sum(r.size for r in parts) // TASKS)
    out, held = [], 0
    for r in parts:
        if not out or held + r.size > most:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.size
    return out


def traces(read: Callable[[int], bytes], start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the traces that start in [start, end) of the bytes that ``read`` gives from ``start`` on.

    A range holds one trace and a block at a time.  Text is UTF-8; a comment or CDATA section that holds trace tags is not seen as such.
    A last trace without its end is not given.
    """
    block = BLOCK if end is None else min(BLOCK, max(1 << 12, end - start))  # doubled by each read, for long traces
    buffer, base, at, more = b"", start, 0, True  # base: offset of the buffer, at: searched up to here

    def fill(keep: int) -> bool:
        """Read on, without what lies before ``keep``: once a block, not once a trace."""
        nonlocal buffer, base, at, more, block
        new = read(block) if more else b""
        more, block = bool(new), min(BLOCK, 2 * block)
        buffer, base, at = buffer[keep:] + new, base + keep, max(at - keep, 0)
        return more

    while True:
        tag = OPEN.search(buffer, at)
        if tag is None:
            keep = max(at, len(buffer) - len(b"<trace"))  # a tag may straddle two blocks
            if end is not None and base + keep >= end or not fill(keep):
                return
            continue
        at = tag.start()
        if end is not None and base + at >= end:
            return
        while (shut := buffer.find(b">", at)) < 0:
            if not fill(at):
                return
        stop = shut + 1
        if buffer[shut - 1:shut] != b"/":
            seen = stop
            while (close := buffer.find(CLOSE, seen)) < 0:
                seen, stop = max(stop, len(buffer) - len(CLOSE)) - at, stop - at
                if not fill(at):
                    return
            stop = close + len(CLOSE)
        yield base + at, buffer[at:stop]
        at = stop


def _timestamp(text: str) -> datetime | None:
    """ISO time to UTC; without an offset it is UTC; odd values are null."""
    try:
        t = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def _number(text: str) -> float | None:
    try:
        return None if "_" in text else float(text)
    except ValueError:
        return None


def _flag(text: str) -> bool | None:
    low = text.strip().lower()
    return True if low in ("true", "t", "yes", "y", "1") else False if low in ("false", "f", "no", "n", "0") else None


PARSERS: dict[type[DataType], Callable] = {StringType: str, TimestampType: _timestamp, DoubleType: _number, BooleanType: _flag}
ARROW = {StringType: pa.string(), TimestampType: pa.timestamp("us", tz="UTC"), DoubleType: pa.float64(), BooleanType: pa.bool_(), LongType: pa.int64()}


def _values(element: ElementTree.Element, wanted: dict[str, tuple[str, Callable]]) -> dict:
    """Column -> value of the wanted attributes among an element's own; the kinds' order, then the last of a repeated key, wins."""
    own = [(k, c) for k, c in ((c.tag.rpartition("}")[2], c) for c in element) if k in KINDS and c.get("key") in wanted]
    out = {}
    for _, c in sorted(own, key=lambda x: KINDS.index(x[0])):
        column, parse = wanted[c.get("key")]
        value = c.get("value")
        out[column] = None if value is None else parse(value)
    return out


class XesRows:
    """Rows of a range, as Arrow batches of the asked-for columns."""

    def __init__(self, schema: StructType, table: str):
        self.schema, self.table = schema, table
        types = {f.name: PARSERS.get(type(f.dataType), str) for f in schema}
        pick = lambda names: {key: (c, types[c]) for key, c in names.items() if c in types}
        self.of_case = pick({"concept:name": "case_id"} if table == "events" else CASE_ATTRIBUTES)
        self.of_event = pick(EVENT_ATTRIBUTES)

    def rows(self, path: str, offset: int, text: bytes) -> Iterator[dict]:
        try:
            trace = ElementTree.fromstring(text)
        except ElementTree.ParseError as e:
            raise ValueError(f"{path}: the trace at byte {offset} is not well-formed: {e}") from e
        case = _values(trace, self.of_case) | {"log_file": path, "trace_offset": offset}
        if self.table == "cases":
            yield case
            return
        for k, event in enumerate(c for c in trace if c.tag.rpartition("}")[2] == "event"):
            yield case | _values(event, self.of_event) | {"event_seq": k}

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], ARROW[type(f.dataType)]) for f in self.schema], names=self.schema.names)

    def read(self, parts: list[Range]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in parts:
            for row in self.of_range(part):
                rows.append(row)
                if len(rows) == ROWS:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def of_range(self, part: Range) -> Iterator[dict]:
        system, inner = _opened(part.path)
        if part.end is None:
            source = gzip.GzipFile(fileobj=system.open_input_stream(inner, compression=None))
        else:
            source = system.open_input_file(inner)
            source.seek(part.start)
        with source:
            for offset, text in traces(source.read, part.start, part.end):
                yield from self.rows(part.path, offset, text)


class XesReader(DataSourceReader):
    def __init__(self, rows: XesRows, path: str, width: int):
        self.rows, self.path, self.width = rows, path, width

    def partitions(self) -> list[Ranges]:
        return packed([r for _, path, size in files(self.path) for r in ranges(path, size, self.width)])

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: a folder without logs
            yield from self.rows.read(partition.ranges)


class XesStreamReader(DataSourceStreamReader):
    """Logs as they appear in a folder, in order of their time of change and path, which is all that an offset holds.

    A log must be moved into the folder whole, and not be older than those already read.
    """

    def __init__(self, rows: XesRows, path: str, width: int):
        self.rows, self.path, self.width = rows, path, width

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = files(self.path)
        return {"changed": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        return packed([r for changed, path, size in files(self.path) if low < (changed, path) <= high for r in ranges(path, size, self.width)])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from self.rows.read(partition.ranges)

    def commit(self, end: dict) -> None:
        """Logs stay where they are."""


class XesDataSource(DataSource):
    """Options: path (a log, or a folder of logs; also gzip), table (events, the default, or cases), rangeBytes.

    The schema defaults to all columns of the table, its place included; a smaller one given to the reader parses its columns only.
    """

    @classmethod
    def name(cls) -> str:
        return "xes"

    def _table(self) -> str:
        table = self.options.get("table", "events")
        if table not in ("events", "cases"):
            raise ValueError(f"table must be events or cases, not {table!r}")
        return table

    def schema(self) -> StructType:
        return EVENTS if self._table() == "events" else CASES

    def _parts(self, schema: StructType) -> tuple[XesRows, str, int]:
        known = {f.name: f.dataType for f in self.schema()}
        for f in schema:
            if known.get(f.name) != f.dataType:
                raise ValueError(f"the {self._table()} of a log have no column {f.name} of type {f.dataType.simpleString()}")
        width = int(self.options.get("rangeBytes", RANGE))
        if width <= 0 or "path" not in self.options:
            raise ValueError("a path and a positive rangeBytes are needed")
        return XesRows(schema, self._table()), self.options["path"], width

    def reader(self, schema: StructType) -> XesReader:
        return XesReader(*self._parts(schema))

    def streamReader(self, schema: StructType) -> XesStreamReader:  # noqa: N802
        return XesStreamReader(*self._parts(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XesDataSource)


def first_cases(cases: DataFrame) -> DataFrame:
    """One row a case: of traces that share an id the first of the log (by file, then offset) stays."""
    rest = [c for c in cases.columns if c not in ("case_id", *PLACE.names)]
    return cases.groupBy("case_id").agg(F.min_by(F.struct(*rest), F.struct(*PLACE.names)).alias("s")).select("case_id", "s.*")
