"""Packing: concatenate and cut.

All documents' token ids, each followed by an end id, form one sequence of ids that is cut
into windows of ``length``. Two passes: the first tokenises every partition once and writes
the ids with their place inside the partition; prefix sums over the partitions' totals (one
row each) turn places into global offsets. In the second pass each document cuts itself at
the multiples of ``length``, so a window's border falls wherever it falls: a document across
it leaves a boundary piece on both sides. Nothing is shuffled and no task sees more than its
partition. Only the last sequence needs padding.

The order of the documents is that of the partitions, or, with ``file_order``, that of the files
they are read from (by name) and of the rows there: a mix that was written in training order is
packed in that order, however its files are dealt to tasks. A task's rows of one file are a part then.

A tokeniser that lower-cases, drops white space and never joins across it (read from its
file) is run once per distinct word, from a bounded cache; ids are those of whole texts. Strings of
added tokens in a text get these tokens' ids, as the tokeniser gives them by default.

Defined cases: NULL counts as empty; an empty text is the end id alone; repeated rows and ids
are documents of their own; an empty table has no pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import cut, find, pick, ship

#: Words kept with their ids by each Python worker.
CACHED_WORDS = 400_000
#: Partition totals are broadcast up to so many partitions (16 bytes each).
BROADCAST_PARTS = 1_000_000


#: Printable ASCII and Latin-1 letters: such a word is its own NFC form and lower-cases letter by letter.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """word -> its ids as bytes, filled on demand and emptied when full.

    Words of common letters are split by the tokeniser's own pattern and their parts go
    straight to its model; any other word takes the tokeniser's whole way.
    """

    def __init__(self, tokenizer, dtype, pattern: str, added: list[str]):
        super().__init__()
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        self.split, self.added, self.letters = regex.compile(pattern).findall, added, _byte_letters()
        self.parts: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHED_WORDS:
                self.parts.clear()
            spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = self.parts[part] = self._packed([t.id for t in self.model.tokenize(spelled)])
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 2 * CACHED_WORDS:
            self.clear()
        if PLAIN.fullmatch(word) and not any(a in word for a in self.added):
            ids = b"".join(map(self._part, self.split(word.lower())))
        else:
            ids = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


def _word_pattern(spec: dict) -> str | None:
    """The pattern of a tokeniser that lower-cases, drops white space and never joins across it; else None."""
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, letters = steps
    pattern = split["pattern"].get("Regex", "")
    plain = not letters["add_prefix_space"] and not letters["use_regex"] and spec.get("post_processor") is None
    drops = split["behavior"] == "Removed" and split["invert"] and not regex.search(pattern, " \t\r\n")
    return pattern if plain and drops and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) else None


@lru_cache(maxsize=2)
def _encoder(path: str):
    """(function: list of texts -> list of id bytes, id type)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    dtype = np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
    pattern = _word_pattern(spec)
    if pattern:
        words = _Words(tokenizer, dtype, pattern, [t["content"] for t in spec["added_tokens"]])
        return (lambda texts: [words.ids(t) for t in texts]), dtype
    return (lambda texts: [np.asarray(e.ids, dtype).tobytes()
                           for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), dtype


def tokenised(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, text, file, row) -> doc_id, ids (little-endian), tokens, part, place (tokens before it in the part).

    A part is a struct (file, first row, partition) that sorts in the order of the documents.
    """
    ship(df.sparkSession)
    spot = pa.struct([("file", pa.string()), ("row", pa.int64()), ("task", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = _encoder(tokenizer)
        end, task = np.asarray([end_id], dtype).tobytes(), TaskContext.get().partitionId()
        file = first = None
        before = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = [x + end for x in encode([t or "" for t in b.column("text").to_pylist()])]
            tokens = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
            files = b.column("file")
            # a file's rows follow one another, so one at both ends fills the batch
            if files[0].as_py() == files[-1].as_py():
                borders = [0, len(ids)]
            else:
                names = files.to_pylist()
                borders = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(borders, borders[1:], strict=False):
                if file != (files[lo].as_py(),):
                    file, first, before = (files[lo].as_py(),), b.column("row")[lo].as_py(), 0
                own, n = tokens[lo:hi], hi - lo
                place = before + np.cumsum(own) - own
                before += int(own.sum())
                part = pa.StructArray.from_arrays(
                    [pa.repeat(pa.scalar(file[0], pa.string()), n), pa.array(np.full(n, first), pa.int64()),
                     pa.array(np.full(n, task), pa.int32())], fields=list(spot))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), pa.array(ids[lo:hi], pa.binary()), pa.array(own), part,
                     pa.array(place, pa.int64())], ["doc_id", "ids", "tokens", "part", "place"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return cut(df.mapInArrow(work, f"doc_id {kind}, ids binary, tokens bigint, part struct<file:string,row:bigint,task:int>, "
                                   "place bigint"), "tokens")


def pack(df: DataFrame, *, tokenizer: str, length: int = 4096, end_id: int = 2, doc_id: str = "doc_id",
         text: str = "text", file_order: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``file_order`` needs a frame that reads files (and keeps their ``_metadata``).
    """
    rows = pick(df, doc_id=doc_id, text=text)
    if file_order:
        spots = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
        rows = df.select(F.col(df.columns[find(df, doc_id)]).alias("doc_id"), F.col(df.columns[find(df, text)]).alias("text"), *spots)
    else:
        rows = rows.select("*", F.lit("").alias("file"), F.lit(0).cast("long").alias("row"))
    docs = tokenised(rows, tokenizer, end_id)
    totals = docs.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "offsets")
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_PARTS else offsets
    placed = docs.join(small, "part").select("doc_id", "ids", "tokens", (F.col("base") + F.col("place")).alias("at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, sizes, pieces, sequences, places = [], [], [], [], [], []
            for i, (ids, n, at) in enumerate(zip(b.column("ids"), b.column("tokens").to_pylist(),
                                                 b.column("at").to_pylist(), strict=True)):
                raw = ids.as_py()
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    rows.append(i)
                    starts.append(start)
                    sizes.append(size)
                    pieces.append(wide[4 * start:4 * (start + size)])
                    sequences.append(sequence)
                    places.append(offset)
                    start += size
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(pieces, pa.binary()), b.column("tokens").take(take), pa.array(sequences, pa.int64()),
                 pa.array(places, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(work, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                                   "sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, *, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens): the packed sequences, the last one padded.

    A group is one sequence, so at most ``length`` pieces meet in a row.
    """
    by = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                           F.sum("length").alias("tokens"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    pad = F.repeat(F.lit(f"{pad_id.to_bytes(4, 'little').hex()}"), (F.lit(length) - F.col("tokens")).cast("int"))
    return by.select("sequence_id", F.concat(joined, F.unhex(pad)).alias("ids"), "tokens")
