"""Near dedup by circulant MinHash, with exact verification.

A document's set holds its distinct shingles of ``words`` words (as 64-bit hashes). Circulant
MinHash: a first permutation scatters shingles over positions 0 .. 2^32 - 1; coordinate k of
the signature is the least value of one second permutation, read k positions further on a
circle. Bands of ``rows_per_band`` coordinates make candidates; the number of bands follows
from the threshold, so that a pair exactly at it is missed with probability ``miss`` at most.

Candidates are confirmed on full sets, without pairing everything in a bucket:

* documents with equal sets are one class, compared once;
* one pivot of each bucket (chosen by hash, so that a group's buckets test different ones)
  meets the bucket's members, and verified links are contracted to components;
* what is left are pairs between components that share a bucket. Two sets at the threshold
  have a shingle in common among their rarest few, so only pairs that meet in one of those
  (within the bounds that their sizes set) are verified; the others cannot be links. A set's
  place of the shared shingle bounds the sizes that its partner may have, so a shingle that
  many share is joined by the size classes that both sides allow: texts that share a page
  frame just below the threshold never meet. What meets at a hot shingle are pairs whose bound is
  within ``CLASS - 1`` of the threshold's sizes; each is verified once.

So no link between candidates is lost, and a group of thousands of near copies costs a few
dozen verifications each. Components come from repeated contraction of the verified links (hook to the
least neighbour, jump pointers, relabel), written to the shared folder each time.

Defined cases: NULL counts as empty; texts without words have empty sets, are linked with
nothing and stay; shorter texts than a shingle are one shingle; of a component the row with
the smallest doc_id (NULL last, then the row read first) stays; repeated rows are equal sets;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import carry, cut, pick, ship, split_join, with_row_id

#: Ids of candidates are broadcast up to so many (16 bytes each), else joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Component labels are broadcast up to so many nodes (16 bytes each), else joined by shuffle.
BROADCAST_NODES = 200_000
#: A shingle of more rows than this is joined by size classes too; below, the pairs of its rows are few.
HOT_ROWS = 64
#: Sizes within this ratio are one class.
CLASS = 1.04
#: Columns of the signature matrix worked on at a time.
BLOCK = 256

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z lower-cased."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out ^= h[j:len(h) - width + 1 + j]
            out *= _M1
            out ^= out >> np.uint64(29)
            out *= _M2
            out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a non-empty set."""
    with np.errstate(over="ignore"):
        first = ((shingles * _M2) >> np.uint64(32)).astype(np.uint32)  # scatter over the circle
        shift = np.arange(size, dtype=np.uint32)[:, None]
        least = np.full(size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(first), BLOCK):
            x = first[None, i:i + BLOCK] - shift  # second permutation, shifted round the circle
            half = x >> np.uint32(16)
            x ^= half
            x *= np.uint32(0x85EBCA6B)
            np.right_shift(x, np.uint32(13), out=half)
            x ^= half
            x *= np.uint32(0xC2B2AE35)
            np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    table = least.reshape(-1, rows_per_band).astype(np.uint64)
    key = np.arange(1, len(table) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows_per_band):
            key = (key ^ table[:, j]) * _M1
            key ^= key >> np.uint64(31)
            key *= _M2
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def bands_for(percent: int, rows_per_band: int, miss: float) -> int:
    """Least number of bands that miss a pair at the threshold with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows_per_band))


def signatures(rows: DataFrame, words: int, bands: int, rows_per_band: int) -> DataFrame:
    """(row_id, doc_id, text) -> row_id, doc_id, n, digest (NULL for the empty set), bands."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, keys = [], [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), words)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows_per_band), rows_per_band) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["row_id", "doc_id", "n", "digest", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row_id", "doc_id", "text").mapInArrow(
        work, f"row_id bigint, doc_id {kind}, n bigint, digest binary, bands array<bigint>")


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """(row_id, text) -> node, set (array of hashes)."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return rows.select("row_id", "text").mapInArrow(work, "node bigint, set array<bigint>")


def _meet(left: DataFrame, right: DataFrame, key: str, small: bool, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right), key, how) if small else split_join(left, right, [key], how)


def components(links: DataFrame) -> DataFrame:
    """Written (a, b) -> (node, root) for all nodes with a link; root is one node of the component."""
    edges, levels = links.select("a", "b"), []
    while True:
        both = edges.union(edges.select("b", "a"))
        parents = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "hook")
        small = parents.count() <= BROADCAST_NODES
        while True:  # jump pointers, twice at a time, until every parent is a root
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
            once = _meet(parents, up, "root", small).select("node", F.col("up").alias("root"))
            twice = _meet(once, up, "root", small).select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
            twice = cut(twice, "jump")
            parents = twice.select("node", "root")
            if twice.where("moved").isEmpty():
                break
        levels.append(parents)
        ends = _meet(edges, parents.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", small)
        ends = _meet(ends, parents.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", small)
        edges = cut(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            break
    out = levels[0]
    for later in levels[1:]:
        higher = later.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = split_join(out, higher, ["root"], "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


def _compatible(percent: int):
    """Sizes that allow the similarity at all."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    met = met.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return met.where(100 * common >= percent * union).select("a", "b")


def _open(placed: DataFrame, key: str) -> DataFrame:
    """Keys whose members are in several components, with the largest of these."""
    sizes = placed.groupBy(key, "comp").agg(F.count("*").alias("c"))
    return sizes.groupBy(key).agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("largest"),
                                  F.sum("c").alias("members")).where("comps > 1").drop("comps")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(node, set) -> node, n, shingle, at: the shingles by which a set can reach the threshold.

    Sets in a common order of shingles, rarest first: if two sets share as much as the
    threshold asks, their first common shingle leaves enough behind it in both, so it is among
    the first few of each. Shingles of one set only are left out; ``at`` counts them.
    """
    items = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    counts = items.groupBy("shingle").agg(F.count("*").alias("f"))
    order = Window.partitionBy("node").orderBy("f", "shingle")
    ranked = split_join(items, counts, ["shingle"]).withColumn("at", F.row_number().over(order) - 1)
    return ranked.where((F.col("at") <= F.col("n") - F.expr(f"(n * {percent} + 99) div 100")) & (F.col("f") > 1)).drop("f")


def _class(size):
    return F.floor(F.log(size) / math.log(CLASS)).cast("int")


def _allowed(at: str, n: str, percent: int) -> tuple:
    """Least and greatest size of a set that may reach the threshold with one of size ``n``, if their first common
    shingle is at ``at`` there."""
    low = F.expr(f"({percent} * {n} + 99) div 100")
    high = F.least(F.expr(f"100 * {n} div {percent}"), F.expr(f"{100 + percent} * ({n} - {at}) div {percent} - {n}"))
    return low, high


def _meeting(keyed: DataFrame, percent: int) -> DataFrame:
    """(node, n, shingle, at, comp) -> pairs of rows in different components that meet at a shingle: node, n, at,
    comp and pivot, m, pivot_at, pivot_comp. Of a hot shingle only rows that allow each other's size class meet."""
    here = split_join(keyed, _open(keyed, "shingle"), ["shingle"])
    low, high = _allowed("at", "n", percent)
    here = cut(here.withColumns({"low": low, "high": high}).where("low <= high"), "meeting")
    # members outside the largest component meet all: at most four times the pairs between components
    others = here.where("comp <> largest").select(
        "shingle", "members", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("at").alias("pivot_at"),
        F.col("comp").alias("pivot_comp"), "low", "high")
    columns = ["node", "n", "at", "comp", "pivot", "m", "pivot_at", "pivot_comp"]
    few = split_join(here.where(f"members <= {HOT_ROWS}").drop("low", "high"), others.where(f"members <= {HOT_ROWS}").select(
        "shingle", "pivot", "m", "pivot_at", "pivot_comp"), ["shingle"]).select(*columns)
    partners = F.explode(F.sequence(_class(F.col("low")), _class(F.col("high"))))
    left = here.where(f"members > {HOT_ROWS}").select("shingle", "node", "n", "at", "comp", _class(F.col("n")).alias("mine"),
                                                      partners.alias("yours"))
    right = others.where(f"members > {HOT_ROWS}").select("shingle", "pivot", "m", "pivot_at", "pivot_comp",
                                                         _class(F.col("m")).alias("yours"), partners.alias("mine"))
    return few.unionByName(split_join(left, right, ["shingle", "mine", "yours"]).select(*columns))


def _links(classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, root) over classes (node, n, bands): components of the exact links; None without any."""
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    buckets = cut(split_join(members, shared, ["bucket"]), "buckets")
    nodes = cut(buckets.select(F.col("node").alias("row_id")).distinct(), "candidates")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    sets = cut(full_sets(rows.join(wanted, "row_id", "left_semi"), words), "sets")

    # first, every bucket's pivot (by hash, so that a group's buckets test different ones)
    pivots = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("by"), "node", "n")).alias("p"))
    pivots = pivots.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"))
    met = split_join(buckets, pivots, ["bucket"]).where((F.col("node") != F.col("pivot")) & _compatible(percent))
    links = cut(_verified(_pairs(met), sets, percent), "verified")
    if links.isEmpty():
        placed = buckets.withColumn("comp", F.col("node"))
    else:
        known = cut(components(links), "components")
        placed = split_join(buckets, known, ["node"], "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    # then, pairs between components left in a bucket, as far as their rarest shingles allow a link
    placed = cut(placed.select("bucket", "node", "comp"), "placed")
    left = cut(split_join(placed, _open(placed, "bucket").select("bucket"), ["bucket"]).select("node", "comp").distinct(), "open")
    keyed = cut(split_join(_rarest(split_join(sets, left.select("node"), ["node"], "left_semi"), percent), left, ["node"]), "rarest")
    need = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    met = _meeting(keyed, percent).where(
        (F.col("comp") != F.col("pivot_comp")) & _compatible(percent)
        & (F.col("at") <= F.col("n") - need) & (F.col("pivot_at") <= F.col("m") - need))
    links = cut(links.union(_verified(_pairs(met), sets, percent)), "verified")
    return None if links.isEmpty() else cut(components(links), "components")


def _labelled(rows: DataFrame, words: int, percent: int, rows_per_band: int, miss: float) -> DataFrame:
    """rows (row_id, doc_id, text), written -> row_id, doc_id, n, component (doc_id, row_id of its first)."""
    docs = cut(signatures(rows, words, bands_for(percent, rows_per_band, miss), rows_per_band), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    classes = docs.where("n > 0").groupBy("digest").agg(
        F.min("row_id").alias("node"), F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes, "classes")
    known = _links(classes, rows, words, percent)
    rooted = classes.select("node", "digest", "first")
    rooted = rooted.withColumn("root", F.col("node")) if known is None else split_join(
        rooted, known, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    heads = split_join(rooted.select("root", "digest"), heads, ["root"]).select("digest", "head")
    out = split_join(docs.drop("bands"), heads, ["digest"], "left")
    head = F.coalesce("head", order)
    return out.select("row_id", "doc_id", "n", head["doc_id"].alias("component_id"), head["row_id"].alias("head_row"))


def near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                rows_per_band: int = 8, miss: float = 1e-6) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = with_row_id(pick(df, doc_id=doc_id, text=text), "near-rows")
    out = _labelled(rows, words, percent, rows_per_band, miss)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("head_row") == F.col("row_id")).alias("kept"))


def drop_near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                     rows_per_band: int = 8, miss: float = 1e-6) -> DataFrame:
    """The input's columns and the rows that stay: one of each component."""
    frame, restore = carry(df, doc_id=doc_id, text=text)
    rows = with_row_id(frame, "near-rows")
    out = _labelled(rows.select("row_id", "doc_id", "text"), words, percent, rows_per_band, miss)
    dropped = cut(out.where("head_row <> row_id").select("row_id"), "dropped")
    return restore(rows.join(dropped, "row_id", "left_anti"), [])
