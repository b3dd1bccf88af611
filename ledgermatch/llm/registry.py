"""Registered queries of the llm operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import (bpe, chat_format, exact_dedup, fingerprints, license_scan, manifest, mixing, near_dedup, packing,
                             quality, registry_sql, sharding, structure_repair, url_filters)
from ledgermatch.llm.common import cut, pick

#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
QUALITY_THRESHOLD = 0.3
#: The conversation that the chat query adds: its text holds control strings and an escape.
EXTRA_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    measured = cut(quality.with_statistics(docs), "statistics")
    model = quality.learn(measured, table(spark, sf_dir, "labels"))
    scored = quality.score(measured, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def document_path():
    """A documents row as a file: source/lang/thousand/id.txt."""
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")),
                       F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source", lang="lang")
    files = docs.select("doc_id", document_path().alias("path"), "text")
    out = license_scan.scan(files)
    return out.select("doc_id", "path", "licence", F.round("licence_cosine", 6).alias("licence_cosine"), "licence_from",
                      "licence_path")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    by = {"tokenizer": tokenizer_path("byte_bpe_50k.tiktoken"), "pattern": token_pattern()}
    tree = chat_format.format_tree(rows.unionByName(extra), **by)
    return chat_format.read_back(tree, **by).drop("n_tokens")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"), length=4096,
                          end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    coded = bpe.encode(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), tokenizer=path, keep_text=False)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), "ids")
    back = bpe.decode(coded, tokenizer=path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = structure_repair.damage(table(spark, sf_dir, "conversations"))
    out = structure_repair.repair(broken, present="present")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = manifest.leaf_digest("doc_id", "source", "lang", "n_chars", "text")
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(
        changed, manifest.leaf_digest("doc_id", "source", "lang", "n_chars", lowered)).otherwise(leaf).alias("claimed"))
    out = manifest.prove(leaves, key="doc_id", group="lang", leaf="leaf", claimed="claimed")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                      "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_quality_classifier, op3_exact_dedup, op4_mixing, op5_sharding, op6_license_scan, op7_chat_format,
    op8_fingerprints, op9_packing, op10_near_dedup, op11_bpe,
    op12_structure_repair, op13_manifest, pipeline)}

_URL_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

ORACLE_SQL = {
    "op1_url_filters": rf"""
WITH rules(verdict, host, path) AS (VALUES {_URL_VALUES}),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS n
  FROM pages),
fits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1""",
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op4_mixing": rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS mix,
         2.0::DOUBLE * source_size / weight AS level
  FROM sources),
caps AS (
  SELECT a.*, (SELECT sum(least(b.most, a.level * b.weight)) FROM levels b) <= a.mix AS capped FROM levels a),
plan AS (
  SELECT source, source_size,
         CASE WHEN capped THEN most ELSE
           (mix - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) * weight
           / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM caps),
quotas AS (SELECT *, least(round(target), 2.0 * source_size)::BIGINT AS quota FROM plan),
placed AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size)
          + greatest(0, least(begins + size, quota % source_size) - begins) END)::BIGINT AS taken
FROM placed""",
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(role || text, '([\\<>])', '\\\1', 'g')) + length('<turn >' || '</turn>') + 1 AS chars,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}



def _tree_sql(name: str, text: str) -> str:
    """CTE columns of a text's tree: blocks by paragraph, digests, sections, and each paragraph's section."""
    return f"""
{name}1 AS (
  SELECT *, list_transform(regexp_extract_all({text}, '{fingerprints.PARAGRAPH}'),
                           lambda p: regexp_extract_all(p, '{fingerprints.BLOCK}')) AS {name}_blocks
  FROM %s),
{name}2 AS (
  SELECT *, regexp_extract_all(array_to_string(list_transform({name}_blocks, lambda bs: sha256(
              'p' || array_to_string(list_transform(bs, lambda b: sha256(b)), ''))), ''), '{fingerprints.SECTION}') AS {name}_secs
  FROM {name}1),
{name}3 AS (
  SELECT *, sha256('r' || array_to_string(list_transform({name}_secs, lambda s: sha256('s' || s)), '')) AS {name}_root,
         list_zip(flatten(list_transform({name}_secs, lambda s: list_transform(range(len(s) // 64), lambda i: s))), {name}_blocks) AS {name}_leaves
  FROM {name}2)"""


def _opened_sql(leaves: str, common: str) -> str:
    return f"flatten(list_transform(list_filter({leaves}, lambda x: NOT list_contains({common}, x[1])), lambda x: x[2]))"


def _likeness_sql(a: str, b: str) -> str:
    closed = f"(len(flatten({a}_blocks)) + len(flatten({b}_blocks)) - len({a}_{b}_a) - len({a}_{b}_b))"
    both = f"({closed} + len(list_distinct({a}_{b}_a)) + len(list_distinct({a}_{b}_b)))"
    return (f"CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE "
            f"({closed} + 2.0::DOUBLE * len(list_intersect({a}_{b}_a, {a}_{b}_b))) / {both} END")


ORACLE_SQL["op8_fingerprints"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (
  SELECT *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) AS edited_text FROM n),
{_tree_sql("own", "text") % "e"}, {_tree_sql("edited", "edited_text") % "own3"}, {_tree_sql("next", "next_text") % "edited3"},
c AS (
  SELECT *, list_intersect(own_secs, edited_secs) AS with_edited, list_intersect(own_secs, next_secs) AS with_next FROM next3),
o AS (
  SELECT *, {_opened_sql("own_leaves", "with_edited")} AS own_edited_a, {_opened_sql("edited_leaves", "with_edited")} AS own_edited_b,
         {_opened_sql("own_leaves", "with_next")} AS own_next_a, {_opened_sql("next_leaves", "with_next")} AS own_next_b
  FROM c)
SELECT doc_id, n_chars, sha256(edited_text) AS edited_sha256, own_root AS fingerprint, edited_root AS edited_fingerprint,
       {_likeness_sql("own", "edited")} AS near_edited, {_likeness_sql("own", "next")} AS near_next
FROM o"""

ORACLE_SQL["op12_structure_repair"] = registry_sql.REPAIR
ORACLE_SQL["op13_manifest"] = registry_sql.MANIFEST

ORACLE_SQL["op10_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingles
  FROM w),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.shingles) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)"""
