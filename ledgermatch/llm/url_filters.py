"""URL filters by hashed expressions (native).

A rule is (verdict, host, path): it fits its host and all subdomains when the url's path
starts with the rule's path; the longest rule (host + path) wins.

Method. Every distinct (host, path) is expanded into expressions: each host suffix combined
with each path prefix of a length that some rule has. Expressions meet the rules in an
equi-join on a short prefix of their SHA-256; the full digests then confirm, and the rule
with the longest expression decides. Pages get the verdict back by (host, path), so copies
of one url are judged once.

Defined cases: a NULL url or one without ``://`` has empty host and path and fits no rule
with a host; ties between rules of one length go to the longer host, then to ``block``; rules
that repeat with both verdicts block; NULL parts of a rule count as empty; a page that no
rule fits gets ``default``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import carry, split_join

RULE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("verdict", "host", "path")])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of a digest that the join meets on; the whole digest confirms.
PREFIX_HEX = 8

#: A rule list of at most so many rows is broadcast; a longer one joins by shuffle.
BROADCAST_RULES = 100_000


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a frame."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def host_of(url):
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(expression):
    return F.sha2(expression, 256)


def expressions(keys: DataFrame, host_chars: list[int], path_chars: list[int]) -> DataFrame:
    """(host, path) -> one row per host suffix and path prefix, with digest and hash prefix.

    Only suffixes that start at a label and have the length of some rule's host are made, and
    only prefixes of the length of some rule's path, so long urls stay cheap.
    """
    h, p = F.length("host"), F.length("path")
    tails = F.filter(F.array(*[F.lit(n) for n in host_chars]),
                     lambda n: (n == h) | ((n < h) & (F.substring("host", h - n, F.lit(1)) == ".")))
    heads = F.filter(F.array(*[F.lit(n) for n in path_chars]), lambda n: n <= p)
    both = F.flatten(F.transform(tails, lambda n: F.transform(heads, lambda m: F.struct(
        F.concat(F.substring("host", h - n + 1, n), F.substring("path", F.lit(1), m)).alias("expression"),
        n.alias("host_chars")))))
    rows = keys.select("host", "path", F.explode(both).alias("e")).select("host", "path", "e.*")
    rows = rows.withColumn("digest", _digest(F.col("expression"))).drop("expression")
    return rows.withColumn("short", F.substring("digest", 1, PREFIX_HEX))


def rule_digests(rules: DataFrame) -> DataFrame:
    """One row per rule expression; contradicting repeats block."""
    r = rules.select(
        F.lower(F.coalesce("verdict", F.lit("block"))).alias("verdict"),
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"))
    r = r.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # allow < block
    r = r.select(F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_chars"),
                 F.length("rule_path").alias("path_chars"), F.col("verdict").alias("rule_verdict"))
    r = r.withColumn("rule_digest", _digest(F.col("rule")))
    return r.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """The input's columns plus host, path, rule (NULL: none fits) and verdict."""
    frame, restore = carry(pages, url=url)
    frame = frame.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    hashed = rule_digests(rules)
    seen = hashed.agg(F.count("*").alias("n"), F.collect_set("host_chars").alias("hosts"),
                      F.collect_set("path_chars").alias("paths")).first()
    keys = frame.select("host", "path").distinct()
    found = expressions(keys, sorted(seen["hosts"]) or [0], sorted(seen["paths"]) or [0])
    hashed = F.broadcast(hashed) if seen["n"] <= BROADCAST_RULES else hashed
    met = found.join(hashed, ["short", "host_chars"]).where(F.col("digest") == F.col("rule_digest"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("chars"), "host_chars", "rule_verdict", "rule")).alias("best"))
    judged = split_join(frame, best, ["host", "path"], "left")
    judged = judged.withColumn("rule", F.col("best.rule")).withColumn(
        "verdict", F.coalesce("best.rule_verdict", F.lit(default)))
    return restore(judged, ["host", "path", "rule", "verdict"])
