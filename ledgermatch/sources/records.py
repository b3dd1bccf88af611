"""CSV records from files that are read in splits.

A quoted field may hold line breaks, so where a record starts depends on all lines before it.
A line does one thing to that: it leads from "outside quotes" or "inside" to one of the two. Two
passes make records of any file, split by the text source as it likes:

1. Every range (a split) is read once under both assumptions about its start. It yields one row:
   the state it ends in and the records that start in it, for either assumption, and its bytes. The
   rows of a file, in order, then give each range's true first state and its first record number.
2. Every range is read again from its known state. Records within a range are emitted with
   their number; a record across a border leaves a fragment on both sides, and only fragments are
   shuffled and joined.

Lines without a quote, nearly all of most exports, are handled as whole Arrow slices; a line with
quotes is walked field by field, as a CSV reader does: a quote opens a field only at its start, two
quotes inside are one, and what follows a closing quote belongs to the field. Blank lines are
no records. ``\\r\\n`` and ``\\n`` end a record.

``heads`` reads the first record of every file and stops there; ``digests`` hashes whole files as
streams of lines, so neither a file's size nor its number of lines meets a limit.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship

# --- fixed values: the longest field a record may have ----------------------
MAX_FIELD = 131072
# --- end of fixed values -----------------------------------------------------

#: Ranges are broadcast up to so many (some 200 bytes each), else joined by shuffle.
BROADCAST_RANGES = 200_000
#: A split of this size holds any file; so many files of a byte each still add up without overflow.
WHOLE_FILE = 1 << 44
_QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+')


def plain_path(c: Column) -> Column:
    """A file's path as written; the metadata column gives it percent-encoded."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open after ``line``, read from outside quotes (a field's start) or from inside."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(',"', at) + 1
                if not at:
                    return False
            at += 1
        at = _QUOTED.match(line, at).end()
        if at >= len(line):
            return True
        inside, at = False, line.find(",", at + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))


def _borders(keys: np.ndarray) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    return [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]


def _blank(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.or_(pc.equal(values, ""), pc.equal(values, "\r")))


class _Range:
    """What pass 1 keeps of a range: for both first states, the present state and the records so far."""

    def __init__(self, path: str, name: str, size: int, block: int):
        self.spot = (path, name, size, block)
        self.inside, self.starts, self.bytes = [False, True], [0, 0], 0

    def read(self, values: pa.Array) -> None:
        blank, at = _blank(values), 0
        self.bytes += int(pc.sum(pc.binary_length(values)).as_py() or 0) + len(values)
        full = np.concatenate([[0], np.cumsum(~blank)])
        for i in np.flatnonzero(np.asarray(pc.match_substring(values, '"'))).tolist():
            line = values[i].as_py()
            for s in (0, 1):
                if not self.inside[s]:
                    self.starts[s] += int(full[i + 1] - full[at])
            if self.inside[0] == self.inside[1]:
                self.inside = [ends_inside(line, self.inside[0])] * 2
            else:
                self.inside = [ends_inside(line, s) for s in self.inside]
            at = i + 1
        for s in (0, 1):
            if not self.inside[s]:
                self.starts[s] += int(full[-1] - full[at])

    def row(self) -> tuple:
        return (*self.spot, *self.inside, *self.starts, self.bytes)


_RANGE = ("path string, name string, size bigint, block bigint, inside0 boolean, inside1 boolean, starts0 bigint, "
          "starts1 bigint, bytes bigint")


def _measured(lines: DataFrame) -> DataFrame:
    """Pass 1: one row per range (a range that a task gets in two pieces cannot be: a split is read by one task)."""
    names = ["path", "name", "size", "block", "inside0", "inside1", "starts0", "starts1", "bytes"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list[_Range]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*[r.row() for r in done], strict=True), types, strict=True)], names)

        key = now = None
        for b in batches:
            keys, done = np.asarray(b.column("key")), []
            borders = _borders(keys)
            for lo, hi in zip(borders, borders[1:], strict=False):
                if now is None or keys[lo] != key:
                    if now is not None:
                        done.append(now)
                    key, now = keys[lo], _Range(*[b.column(c)[lo].as_py() for c in names[:4]])
                now.read(b.column("value").slice(lo, hi - lo))
            if done:
                yield batch(done)
        if now is not None:
            yield batch([now])

    return lines.withColumn("key", F.xxhash64("path", "block")).mapInArrow(work, _RANGE)


def _placed(ranges: DataFrame) -> DataFrame:
    """Each range with its true first state (``inside``), its first record's number and its own number.

    A file has one range per split, so its list of ranges is short (8,000 of 128 MB in a terabyte).
    """
    spots = F.struct("block", "inside0", "inside1", "starts0", "starts1")
    by = ranges.groupBy("path", "name", "size").agg(F.sort_array(F.collect_list(spots)).alias("spots"))
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("first"),
                     F.array().cast("array<struct<block:bigint,inside:boolean,first:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            F.when(acc["inside"], x["inside1"]).otherwise(x["inside0"]).alias("inside"),
            (acc["first"] + F.when(acc["inside"], x["starts1"]).otherwise(x["starts0"])).alias("first"),
            F.concat(acc["out"], F.array(F.struct(x["block"].alias("block"), acc["inside"].alias("inside"),
                                                  acc["first"].alias("first")))).alias("out"))

    return by.select("path", "name", F.explode(F.aggregate("spots", start, step)["out"]).alias("r")).select(
        "path", "name", F.col("r.block").alias("block"), F.col("r.inside").alias("inside"), F.col("r.first").alias("first"))


class _Records:
    """Pass 2: the records of one range after the other, from each one's known first state."""

    def __init__(self, limit: int):
        self.limit = limit
        self.rows: list[list] = [[], [], [], [], [], []]  # path, name, record, block, fragment, text

    def enter(self, path: str, name: str, block: int, inside: bool, first: int) -> None:
        self.spot, self.inside, self.next = (path, name, block), inside, first
        self.open: list[str] = []
        self.length, self.torn = 0, inside

    def leave(self) -> None:
        if self.inside or self.open:
            self._emit("\n".join(self.open) + "\n", True)
        self.open = []

    def _emit(self, text: str, fragment: bool) -> None:
        number = self.next - 1
        for column, value in zip(self.rows, (*self.spot[:2], number, self.spot[2], fragment, text), strict=True):
            column.append(value)

    def _add(self, line: str) -> None:
        """A line of an open record; beyond the limit it is a reject whatever follows, so no more is kept."""
        if self.length <= self.limit:
            self.open.append(line)
            self.length += len(line) + 1

    def _close(self) -> None:
        text, torn = "\n".join(self.open), self.torn
        self._emit(text[:-1] if text.endswith("\r") else text, torn)
        self.open, self.length, self.torn = [], 0, False

    def _whole(self, values: pa.Array, blank: np.ndarray) -> None:
        kept = values.filter(pa.array(~blank)).to_pylist()
        n = len(kept)
        for column, value in zip(self.rows, (*self.spot[:2], None, self.spot[2], False, None), strict=True):
            column.extend([value] * n if value is not None else [])
        self.rows[2].extend(range(self.next, self.next + n))
        self.rows[5].extend([t[:-1] if t.endswith("\r") else t for t in kept])
        self.next += n

    def read(self, values: pa.Array) -> None:
        blank, at = _blank(values), 0
        quoted = np.flatnonzero(np.asarray(pc.match_substring(values, '"'))).tolist()
        for i in [*quoted, len(values)]:
            if self.inside:
                for line in values.slice(at, i - at).to_pylist():
                    self._add(line)
            elif i > at:
                self._whole(values.slice(at, i - at), blank[at:i])
            if i == len(values):
                break
            line, before = values[i].as_py(), self.inside
            if not before:
                self.next += 1
            self.inside = ends_inside(line, before)
            self._add(line)
            if not self.inside:
                self._close()
            at = i + 1


def records(spark: SparkSession, files: list[str], limit: int = 64 * MAX_FIELD) -> DataFrame:
    """(path, name, record, text) of all records; record 0 is a file's first, its header.

    ``limit`` is the length from which a record is not kept whole any more.
    """
    ship(spark)
    lines = _lines(spark, files)
    # the ranges are read from the files twice; the few rows of the first pass are written
    placed = scratch_path(spark, "ranges")
    _placed(_measured(lines)).write.parquet(placed)
    ranges = spark.read.schema("path string, name string, block bigint, inside boolean, first bigint").parquet(placed)
    small = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    known = lines.select("value", "path", "block").join(small, ["path", "block"])
    known = known.withColumn("key", F.xxhash64("path", "block"))
    names = ["path", "name", "record", "block", "fragment", "text"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key = _Records(limit), None

        def batch() -> pa.RecordBatch:
            rows, out.rows = out.rows, [[], [], [], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names)

        for b in batches:
            keys = np.asarray(b.column("key"))
            borders = _borders(keys)
            for lo, hi in zip(borders, borders[1:], strict=False):
                if key is None or keys[lo] != key:
                    if key is not None:
                        out.leave()
                    key = keys[lo]
                    out.enter(*[b.column(c)[lo].as_py() for c in ("path", "name", "block", "inside", "first")])
                out.read(b.column("value").slice(lo, hi - lo))
            yield batch()
        if key is not None:
            out.leave()
            yield batch()

    found = known.mapInArrow(work, "path string, name string, record bigint, block bigint, fragment boolean, text string")
    whole = found.where("not fragment").select("path", "name", "record", "text")
    torn = found.where("fragment").groupBy("path", "name", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    # a file may end inside quotes: the fragment's own line break is not the record's
    torn = torn.withColumn("text", F.regexp_replace("text", "\r?\n\\z", ""))
    return whole.unionByName(torn)


_SESSIONS: dict[tuple[str, int], SparkSession] = {}


def _one_file_a_task(spark: SparkSession, batch_rows: int) -> SparkSession:
    """A session of the same application that reads every file in one split and one task of its own."""
    key = (spark.sparkContext.applicationId, batch_rows)
    if key not in _SESSIONS:
        own = spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(WHOLE_FILE))
        own.conf.set("spark.sql.files.openCostInBytes", str(WHOLE_FILE))
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
        _SESSIONS[key] = own
    return _SESSIONS[key]


def heads(spark: SparkSession, paths: list[str], limit: int = 64 * MAX_FIELD) -> DataFrame:
    """(file_path, file_name, headers) of every file that has a record: the fields of the first one.

    A task takes lines until the record is whole and leaves the rest of its file unread.
    """
    ship(spark)
    own = _one_file_a_task(spark, 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, held, length = False, [], 0
        for b in batches:
            for line in b.column("value").to_pylist():
                if not held and line in ("", "\r"):
                    continue
                inside = ends_inside(line, inside)
                held.append(line)
                length += len(line) + 1
                if not inside or length > limit:
                    text = "\n".join(held).removeprefix("﻿").removesuffix("\r")
                    fields = next(csv.reader([text + "\n"] if "\n" not in text else text.splitlines(keepends=True)), [])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("path").slice(0, 1), b.column("name").slice(0, 1), pa.array([fields], pa.list_(pa.string()))],
                        ["path", "name", "headers"])
                    return

    found = _lines(own, paths).select("value", "path", "name").mapInArrow(work, "path string, name string, headers array<string>")
    target = scratch_path(spark, "heads")
    found.write.parquet(target)  # read by its own session, whose settings a later plan would not have
    read = spark.read.schema("path string, name string, headers array<string>").parquet(target)
    return read.select(plain_path(F.col("path")).alias("file_path"), F.col("name").alias("file_name"), "headers")


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, file_path, sha256, bytes) of every file, one streaming task each, in bounded memory.

    Spark's sources do not list files without a byte, so these have no row.

    Lines come without their breaks, and without a byte order mark; how many bytes that is less
    than the file's size says, at the end, whether there was a mark and whether the last line is ended. So
    two digests run along, with a mark and without.
    """
    ship(spark)
    own = _one_file_a_task(spark, 10_000)
    lines = _lines(own, paths).select(F.col("value").cast("binary").alias("value"), "path", "name", "size")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, between, read = None, b"", 0
        hashers = hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)
        for b in batches:
            if not b.num_rows:
                continue
            if spot is None:
                spot = [b.column(c)[0].as_py() for c in ("name", "path", "size")]
            data = between + b"\n".join(b.column("value").to_pylist())
            for hasher in hashers:
                hasher.update(data)
            between, read = b"\n", read + len(data)
        if spot is not None:
            left = spot[2] - read  # 3 for a mark, 1 for a line break at the end
            hasher = hashers[left >= 3]
            hasher.update(b"\n" if left in (1, 4) else b"")
            yield pa.RecordBatch.from_arrays([pa.array([spot[0]]), pa.array([spot[1]]), pa.array([hasher.hexdigest()]),
                                              pa.array([spot[2]], pa.int64())], ["source_file", "path", "sha256", "bytes"])

    found = scratch_path(spark, "digests")
    schema = "source_file string, path string, sha256 string, bytes bigint"
    lines.mapInArrow(work, schema).write.parquet(found)
    return spark.read.schema(schema).parquet(found).select(
        "source_file", plain_path(F.col("path")).alias("file_path"), "sha256", "bytes")
