"""Chat formatting with a prefix tree.

A turn is formatted as ``<turn ROLE>TEXT</turn>`` and a line break; ``\\``, ``<`` and ``>`` inside roles and
texts get a ``\\`` before them, so no text can hold a control string and ``parse`` undoes it.

Conversations that share their initial turns share the nodes of a prefix tree. A node is
identified by a 128-bit hash chained over all turns up to it, made in one pass over the
turns sorted by conversation. Distinct conversations are sorted by their list of nodes, which is
depth-first order; each node is emitted once, where it first occurs, and prefix sums over
the sorted partitions give its place in the emitted tokens. A node carries its token ids, the span
of tokens with loss, the position id of its first token (the tokens of its ancestors) and
the intervals of emitted tokens that its tokens may attend to besides the node itself;
ancestors that follow one another in the output are one interval.

Conversations equal in content are one leaf, and shared nodes are combined before the
shuffle, so a first turn that a third of all conversations share stays one row per task. Work
per conversation is streamed from sorted rows; only its list of node hashes is ever one
value.

Defined cases: turns sort by turn (NULL last), then role, then text; NULL roles and texts are
empty; all rows with a NULL conversation are one conversation; repeated rows are turns of their own;
an empty table gives empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import cut, pick, ship, split_join, text_or_empty

CONTROL = re.compile(r"[\\<>]")
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """Opening, content and closing of a formatted turn."""
    return f"<turn {escape(role)}>", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Tree(NamedTuple):
    """nodes: node, parent, start, tokens, ids, loss_from, loss_to, position, attends (from, to);
    turns: conv_id, k, node, leaf (the conversation's last turn)."""

    nodes: DataFrame
    turns: DataFrame


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a ranks file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _chained(turns: DataFrame) -> DataFrame:
    """Sorted turns -> conv_id, k, node, parent, role, text, path (nodes of the conversation, on its last turn)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, path, k, held = None, b"", [], 0, None
        names = ["conv_id", "k", "node", "parent", "role", "text", "path"]
        for b in batches:
            out: list[list] = [[] for _ in names]

            def put(row, last):
                for column, value in zip(out, [*row, list(path) if last else None], strict=True):
                    column.append(value)

            for c, role, text in zip(*[b.column(x).to_pylist() for x in ("conv_id", "role", "text")], strict=True):
                if held is not None:
                    put(held, (c,) != conv)
                if (c,) != conv:
                    conv, node, path, k = (c,), b"", [], 0
                parent = node
                h = hashlib.blake2b(parent, digest_size=16)
                for part in (role.encode("utf-8", "replace"), text.encode("utf-8", "replace")):
                    h.update(len(part).to_bytes(8, "little") + part)
                node = h.digest()
                path.append(node)
                held = (c, k, node, parent, role, text)
                k += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip([*held, path], types, strict=True)], names)

    kind = turns.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.binary())]
    return turns.mapInArrow(work, f"conv_id {kind.simpleString()}, k bigint, node binary, parent binary, role string, "
                                  "text string, path array<binary>")


def _encoded(nodes: DataFrame, tokenizer: str, pattern: str, loss_role: str) -> DataFrame:
    """(node, parent, role, text) -> node, parent, tokens, ids, loss_from, loss_to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer, pattern).encode_ordinary
        for b in batches:
            ids, spans = [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                opening, content, closing = (encode(x) for x in segments(role, text))
                ids.append(opening + content + closing)
                has_loss = role == loss_role
                spans.append((len(opening), len(opening) + len(content) * has_loss))
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("parent"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(ids, pa.list_(pa.int32())), pa.array([s for s, _ in spans], pa.int64()),
                 pa.array([e for _, e in spans], pa.int64())], ["node", "parent", "tokens", "ids", "loss_from", "loss_to"])

    return nodes.mapInArrow(work, "node binary, parent binary, tokens bigint, ids array<int>, loss_from bigint, loss_to bigint")


def _depth_first(paths: DataFrame) -> DataFrame:
    """Distinct paths -> (node, part, at): nodes in depth-first order, each once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, previous = TaskContext.get().partitionId(), 0, []
        for b in batches:
            nodes, places = [], []
            for path in b.column("path").to_pylist():
                shared = 0
                while shared < min(len(path), len(previous)) and path[shared] == previous[shared]:
                    shared += 1
                for node in path[shared:]:
                    nodes.append(node)
                    places.append(at)
                    at += 1
                previous = path
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([part] * len(nodes), pa.int32()),
                                              pa.array(places, pa.int64())], ["node", "part", "at"])

    order = cut(paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(
        work, "node binary, part int, at bigint"), "depth-first")
    # a partition's first path repeats the nodes that it shares with the one before
    first = order.groupBy("node").agg(F.min(F.struct("part", "at")).alias("spot"))
    return first.select("node", "spot.part", "spot.at")


def _placed(order: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, part, at) and (node, tokens) -> (node, start): places in the emitted tokens."""
    rows = cut(order.join(sizes, "node"), "tree-sizes")
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(bases, "part").select(
        "node", "tokens", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start"))


def _context(steps: DataFrame) -> DataFrame:
    """Sorted (leaf, k, node, start, tokens) -> (node, position, attends)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, position, spans = None, 0, []
        for b in batches:
            out: list[list] = [[], [], []]
            for c, node, start, tokens in zip(*[b.column(x).to_pylist() for x in ("leaf", "node", "start", "tokens")], strict=True):
                if c != leaf:
                    leaf, position, spans = c, 0, []
                for column, value in zip(out, (node, position, [dict(zip(("from", "to"), s, strict=True)) for s in spans]), strict=True):
                    column.append(value)
                position += tokens
                if spans and spans[-1][1] == start:
                    spans = [*spans[:-1], (spans[-1][0], start + tokens)]
                else:
                    spans = [*spans, (start, start + tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(
                out[2], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], ["node", "position", "attends"])

    return steps.mapInArrow(work, "node binary, position bigint, attends array<struct<from:bigint,to:bigint>>")


def format_tree(df: DataFrame, *, tokenizer: str, pattern: str, conv_id: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> Tree:
    """The emitted nodes and, for every conversation, the nodes it is made of."""
    ship(df.sparkSession)
    rows = pick(df, conv_id=conv_id, turn=turn, role=role, text=text)
    rows = rows.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    turns = cut(_chained(rows.repartition("conv_id").sortWithinPartitions(*order)), "turns")
    nodes = turns.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "role", "text")])
    nodes = cut(_encoded(nodes, tokenizer, pattern, loss_role), "nodes")
    paths = cut(turns.where(F.col("path").isNotNull()).groupBy("node").agg(F.first("path").alias("path")), "paths")
    starts = cut(_placed(_depth_first(paths.select("path")), nodes.select("node", "tokens")), "starts")
    steps = paths.select(F.col("node").alias("leaf"), F.posexplode("path").alias("k", "node"))
    steps = split_join(steps, starts, ["node"]).repartition("leaf").sortWithinPartitions("leaf", "k")
    context = _context(steps.select("leaf", "k", "node", "start", "tokens")).groupBy("node").agg(
        F.first("position").alias("position"), F.first("attends").alias("attends"))
    full = nodes.join(starts.select("node", "start"), "node").join(context, "node")
    return Tree(full.select("node", "parent", "start", "tokens", "ids", "loss_from", "loss_to", "position", "attends"),
                turns.select("conv_id", "k", "node", F.col("path").isNotNull().alias("leaf")))


def read_back(tree: Tree, *, tokenizer: str, pattern: str) -> DataFrame:
    """Each conversation as its emitted tokens say: digests of turns and of the text under loss.

    Rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.
    A conversation's nodes are read in the order of their position ids, decoded, parsed and
    unescaped one after the other, with running digests.
    """
    ship(tree.turns.sparkSession)
    met = split_join(tree.turns.select("conv_id", "k", "node"), tree.nodes.select(
        "node", "ids", "loss_from", "loss_to", "position", "tokens"), ["node"])
    kind = tree.turns.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(tokenizer, pattern).decode
        conv = state = None

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]

        def row():
            return [conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            done = []
            for c, ids, lo, hi, position, tokens in zip(*[b.column(x).to_pylist() for x in (
                    "conv_id", "ids", "loss_from", "loss_to", "position", "tokens")], strict=True):
                if conv != (c,):
                    if conv is not None:
                        done.append(row())
                    conv, state = (c,), fresh()
                if position != state[5]:
                    raise ValueError(f"position ids of conversation {c!r} have a gap")
                text = decode(ids)
                (role, content), = parse(text)
                loss = unescape(decode(ids[lo:hi]))
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode("utf-8", "replace"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "replace"))
                state[4] += len(text)
                state[5] += tokens
            if done:
                yield batch(done)
        if conv is not None:
            yield batch([row()])

    return met.repartition("conv_id").sortWithinPartitions("conv_id", "position", "k").mapInArrow(
        work, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, n_tokens bigint")
