"""Merkle manifest of a dataset: cogrouped subtree exchange.

Every row is a leaf, the SHA-256 of its fields. Per group, leaves ascend by key, and runs of
``RUN`` consecutive nodes become their parent until one is left, the group's subroot; the subroots,
in the order of the groups, become the root the same way. A leaf's proof are its siblings,
level by level, up to the root: who has them can fold the leaf to the root again.

Leaves are ranked by one range shuffle (places in the partitions plus prefix sums over the
partitions' counts) and dealt into superblocks of ``SUPER`` consecutive ones, whole subtrees of
``LEVELS`` levels. Going up, each superblock sends its top only; the tops are leaves of the next
stage, so a stage is ``SUPER`` times smaller than the one below. Going down, every superblock
gets the *outer nodes* that its leaves need, the runs on its top's way to the root. Leaves and
outer nodes are cogrouped by superblock in ``applyInPandas``: one call reduces the subtree again,
joins each leaf's inner siblings with the outer ones, and folds the leaf (or the digest that is
to be checked in its place) up to the root. Texts never move; a group of any size, or any number
of groups, is spread over its superblocks.

Defined cases: a NULL field is ``-``, any other its UTF-8 byte count, ``:`` and its text, so an
empty text is ``0:``; a NULL group is a group, the first; NULL keys come first; rows with equal
keys ascend by digest, repeated rows are leaves of their own; a lone leaf is its subroot, a lone
subroot the root; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import cut, pick, ship, split_join

RUN = 8
LEVELS = 3
SUPER = RUN**LEVELS
#: Partition starts are broadcast up to so many rows (some 50 bytes each).
BROADCAST_STARTS = 200_000
#: Levels above the subroots are numbered from here.
ABOVE = 1000
PATH = "g string, super bigint, height int, slot int, digest string, own boolean, root string"


def field(c: str | Column) -> Column:
    value = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """(g, ...) plus ``pos``, the place in the group by ``order``, and ``size``, the group's rows."""
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    starts = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("n").over(Window.partitionBy("g")).alias("size"))
    starts = cut(starts, f"{name}-starts")
    met = dealt.join(F.broadcast(starts), ["g", "part"]) if starts.count() <= BROADCAST_STARTS else split_join(
        dealt, starts, ["g", "part"])
    return met.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _depth(size: str) -> Column:
    """Reductions until one node is left."""
    return F.expr(f"size(filter(sequence(0, 20), d -> shiftleft(1L, 3 * d) < {size}))")


def _tops(nodes: DataFrame) -> DataFrame:
    """(g, pos, digest, depth) -> the superblocks' tops, as nodes of the next stage."""
    by = nodes.groupBy("g", F.expr(f"pos div {SUPER}").alias("super")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"), F.first("depth").alias("depth"))
    by = by.withColumn("level", F.transform("run", lambda x: x["digest"]))
    runs = F.sequence(F.lit(0), F.expr(f"(size(level) - 1) div {RUN}").cast("int"))
    parents = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice("level", i * RUN + 1, RUN), ""), 256))
    for k in range(LEVELS):
        by = by.withColumn("level", F.when(F.col("depth") > k, parents).otherwise(F.col("level")))
    return by.select("g", F.col("super").alias("pos"), F.element_at("level", 1).alias("digest"),
                     F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"))


def _stages(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of all stages, up to one node per group."""
    out = [nodes]
    while not out[-1].where("depth > 0").isEmpty():
        out.append(cut(_tops(out[-1]), name))
    return out


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i:i + RUN]).encode()).hexdigest() for i in range(0, len(nodes), RUN)]


def _subtree(nodes: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's nodes in order, and the nodes of its levels (without its top)."""
    nodes = nodes.sort_values("pos", kind="stable")
    level, levels = nodes["digest"].tolist(), []
    for _ in range(min(LEVELS, int(nodes["depth"].iloc[0]))):
        levels.append(level)
        level = _parents(level)
    return nodes, levels


def _run(level: list[str], at: int) -> tuple[list[str], int]:
    return level[at - at % RUN:at - at % RUN + RUN], at % RUN


def _outer_runs(outer: pd.DataFrame) -> list[tuple[int, list[str], int]]:
    """(height, digests, own slot) of the runs above a superblock, from the lowest to the root."""
    runs = []
    for height, run in outer[outer["slot"] >= 0].sort_values(["height", "slot"]).groupby("height", sort=True):
        runs.append((int(height), run["digest"].tolist(), run["own"].tolist().index(True)))
    return runs


def _descend(nodes: DataFrame, outer: DataFrame, base: int) -> DataFrame:
    """The runs on every node's way to the root, as the outer nodes of the stage below (PATH rows)."""

    def work(key: tuple, mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine, levels = _subtree(mine)
        far, root = _outer_runs(above), above["root"].iloc[0]
        rows = []
        for i, pos in enumerate(mine["pos"].tolist()):
            rows.append((key[0], pos, -1, -1, "", False, root))  # a way without runs is one, too
            near = [(base + k, *_run(level, i // RUN**k)) for k, level in enumerate(levels)]
            for height, run, own in near + far:
                rows.extend((key[0], pos, height, slot, digest, slot == own, root) for slot, digest in enumerate(run))
        return pd.DataFrame(rows, columns=["g", "super", "height", "slot", "digest", "own", "root"])

    nodes = nodes.withColumn("super", F.expr(f"pos div {SUPER}"))
    return nodes.groupBy("g", "super").cogroup(outer.groupBy("g", "super")).applyInPandas(work, PATH)


def _ways(stages: list[DataFrame], outer: DataFrame, base: int, name: str) -> DataFrame:
    """Outer nodes of the lowest stage's superblocks, from those of the top stage's."""
    for j in range(len(stages) - 1, 0, -1):
        outer = cut(_descend(stages[j], outer, base + LEVELS * j), name)
    return outer


def _prove(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    def work(_: tuple, mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine, levels = _subtree(mine)
        far, root = _outer_runs(above), above["root"].iloc[0]
        far_proof = "".join(d for _, run, own in far for slot, d in enumerate(run) if slot != own)

        def fold(digest: str, runs: Iterator[tuple[list[str], int]]) -> str:
            for run, own in runs:
                digest = sha256("".join([*run[:own], digest, *run[own + 1:]]).encode()).hexdigest()
            return digest

        ends = [(run, own) for height, run, own in far if height < ABOVE], [(run, own) for height, run, own in far if height >= ABOVE]
        near_of_first = [_run(level, 0) for level in levels]
        subroot = fold(fold(mine["digest"].iloc[0], near_of_first), ends[0])
        proofs, folded = [], []
        for i, claimed in enumerate(mine["claimed"].tolist()):
            near = [_run(level, i // RUN**k) for k, level in enumerate(levels)]
            proofs.append("".join(d for run, own in near for slot, d in enumerate(run) if slot != own) + far_proof)
            folded.append(fold(claimed, [*near, *ends[0], *ends[1]]))
        return pd.DataFrame({
            "key": mine["key"].to_numpy(), "leaf": mine["digest"].to_numpy(), "subroot": subroot, "root": root,
            "proof": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    leaves = leaves.withColumn("super", F.expr(f"pos div {SUPER}"))
    return leaves.groupBy("g", "super").cogroup(outer.groupBy("g", "super")).applyInPandas(
        work, "key string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")


def prove(leaves: DataFrame, *, key: str = "key", group: str = "group", leaf: str = "leaf", claimed: str | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof (the siblings' digests, joined), folded_root and verified of every leaf.

    ``claimed`` names the digest that is folded in the leaf's place, as who holds a copy of the row
    has it; the proof and the root stay those of the leaves.
    """
    ship(leaves.sparkSession)
    rows = pick(leaves, key=key, group=group, digest=leaf, claimed=claimed or leaf)
    key_type = rows.schema["key"].dataType
    rows = rows.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))).drop("group")
    rows = cut(rows, "manifest-rows")  # a range shuffle samples its input first
    ordered = ranked(rows, ["key", "digest", "claimed"], "manifest-leaves")
    # pandas would make floats of integers with NULLs
    ordered = ordered.withColumns({"depth": _depth("size"), "key": F.col("key").cast("string")}).drop("size")
    ordered = cut(ordered, "manifest-ranked")
    stages = _stages(ordered.select("g", "pos", "digest", "depth"), "manifest-tops")

    groups = ranked(stages[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], "manifest-groups")
    groups = cut(groups.withColumn("depth", _depth("size")).drop("size"), "manifest-subroots")
    upper = _stages(groups.select("g", "pos", "digest", "depth"), "manifest-upper")
    root = upper[-1].select("g", F.lit(0).cast("long").alias("super"), F.lit(-1).alias("height"), F.lit(-1).alias("slot"),
                            F.lit("").alias("digest"), F.lit(False).alias("own"), F.col("digest").alias("root"))
    above = _ways(upper, root, ABOVE, "manifest-above")
    ways = _descend(groups.select("g", "pos", "digest", "depth"), above, ABOVE).join(
        F.broadcast(groups.select(F.col("pos").alias("super"), "name")) if groups.count() <= BROADCAST_STARTS
        else groups.select(F.col("pos").alias("super"), "name"), "super")
    tops = cut(ways.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("super"), "height", "slot", "digest", "own", "root"),
               "manifest-ways")
    outer = _ways(stages, tops, 0, "manifest-outer")
    return _prove(ordered, outer).withColumn("key", F.col("key").cast(key_type))
