"""DuckDB SQL of the conversation repair and the manifest, by other means than the operators'.

The repair's shortest path is a recursive CTE from the last row to the first whose values are
texts (nine digits of cost, then the audit), so that the least text is the least path. The manifest's trees
are recursive CTEs that group every level's nodes by eight.
"""

from __future__ import annotations

SPACES = r"\x20\x09-\x0D"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text: each byte is added to the register, then eight bits are shifted out (-1)."""
    steps = (f"flatten(list_transform(range(1, length({text}) + 1), lambda i: "
             f"[ascii(substr({text}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))")
    register = (f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
                f"ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)")
    return f"xor({register}, 4294967295::BIGINT)"


def _step(cost: str | int, letter: str, rest: str) -> str:
    return f"(lpad(CAST(CAST(left({rest}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({rest}, 10))"


def _inserted(values: list[str]) -> list[str]:
    """Values before a gap, which takes one insert at most: after nothing, s, u, a."""
    leads_to = (2, 2, 3, 2)
    return [f"least({v}, {_step(2, 'I', values[leads_to[s]])})" for s, v in enumerate(values)]


def _row() -> list[str]:
    """Values before a row (fault, initial), from those after it."""
    leads_to, letters, out = ("a2", "a2", "a3", "a2"), "uuau", []
    for s in range(4):
        keep = f"WHEN initial = '{letters[s]}' THEN {_step('cut', 'K', leads_to[s])}"
        if s == 0:
            keep += f" WHEN initial = 's' THEN {_step('cut', 'K', 'a1')}"
        out.append(f"least({_step(3, 'D', f'a{s}')}, CASE WHEN gone THEN '9' ELSE {_step('2 + cut', 'R', leads_to[s])} END, "
                   f"CASE WHEN gone THEN '9' {keep} ELSE '9' END)")
    return out


_NEVER = "'900000000'"
_LAST = _inserted(["'000000000'", _NEVER, _NEVER, "'000000000'"])

REPAIR = rf"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
k AS (SELECT *, {crc32("name")} % 20 AS kind FROM r),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial
  FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACES}]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN regexp_extract(text, '(?s)([^{SPACES}])[{SPACES}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o),
t AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY conv_id),
path(conv_id, i, a0, a1, a2, a3) AS (
  SELECT conv_id, n, {", ".join(_LAST)} FROM facts
  UNION ALL
  SELECT conv_id, i, {", ".join(_inserted(["b0", "b1", "b2", "b3"]))}
  FROM (SELECT p.conv_id, p.i - 1 AS i, {", ".join(f"{b} AS b{s}" for s, b in enumerate(_row()))}
        FROM path p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i)),
best AS (SELECT conv_id, CAST(left(a0, 9) AS BIGINT) AS cost, substr(a0, 10) AS audit FROM path WHERE i = 0),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best),
spots AS (
  SELECT conv_id, j, substr(audit, j, 1) AS letter, length(replace(left(audit, j), 'I', '')) AS i,
         length(replace(left(audit, j), 'D', '')) AS k
  FROM letters),
kept AS (
  SELECT s.*, t.role, t.text, t.initial,
         max(CASE WHEN s.k = 1 AND s.letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
  FROM spots s LEFT JOIN t ON s.letter <> 'I' AND t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i
  WHERE s.letter <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                             || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 3 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claimed
  FROM documents),
p AS (
  SELECT *, coalesce('=' || lang, '') AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM d),
low(g, lvl, pos, digest, n) AS (
  SELECT g, 0, pos, leaf, n FROM p
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM low WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
subroots AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, pos // 8, n),
top AS (SELECT digest AS root FROM high WHERE n = 1),
-- the runs on every leaf's way, numbered from the leaf to the root
ways AS (
  SELECT p.doc_id, p.leaf, p.claimed, p.g, p.pos AS spot, l.lvl AS step, l.pos, l.digest, l.pos = p.pos // (8 ** l.lvl)::BIGINT AS own
  FROM p JOIN low l ON l.g = p.g AND l.n > 1 AND l.pos // 8 = p.pos // (8 ** (l.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, p.claimed, p.g, p.pos, 100 + h.lvl, h.pos, h.digest, h.pos = s.pos // (8 ** h.lvl)::BIGINT
  FROM p JOIN subroots s ON s.g = p.g JOIN high h ON h.n > 1 AND h.pos // 8 = s.pos // (8 ** (h.lvl + 1))::BIGINT),
proofs AS (
  SELECT g, spot, coalesce(string_agg(digest, '' ORDER BY step, pos) FILTER (WHERE NOT own), '') AS proof FROM ways GROUP BY g, spot),
steps AS (SELECT *, dense_rank() OVER (PARTITION BY g, spot ORDER BY step) AS k FROM ways),
fold(g, spot, k, digest) AS (
  SELECT g, pos, 0::BIGINT, claimed FROM p
  UNION ALL
  SELECT f.g, f.spot, f.k + 1, sha256(string_agg(CASE WHEN s.own THEN f.digest ELSE s.digest END, '' ORDER BY s.pos))
  FROM fold f JOIN steps s ON s.g = f.g AND s.spot = f.spot AND s.k = f.k + 1 GROUP BY f.g, f.spot, f.k, f.digest),
folded AS (SELECT g, spot, max_by(digest, k) AS folded_root FROM fold GROUP BY g, spot)
SELECT p.doc_id, p.leaf, s.digest AS subroot, top.root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.folded_root,
       f.folded_root = top.root AS verified
FROM p JOIN subroots s ON s.g = p.g JOIN folded f ON f.g = p.g AND f.spot = p.pos LEFT JOIN proofs q ON q.g = p.g AND q.spot = p.pos, top"""
