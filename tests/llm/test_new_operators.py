"""BPE, conversation repair and the Merkle manifest against brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgermatch.llm import bpe, manifest, registry, structure_repair

SF = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
BPE_FILE = registry.tokenizer_path("byte_bpe_50k.json")


# --- 11: BPE ---------------------------------------------------------------------------

def library():
    return Tokenizer.from_file(BPE_FILE)


def odd_texts(count=250, seed=3):
    rnd = random.Random(seed)
    signs = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'ll", "l", "1", "²", "é", "漢", "!", "<|endoftext|>", "<|endo", "\x1c",
             "\x85", "=", "the ", " the", "-", "\U0001f642", "\r\n", "İ"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50))) for _ in range(count)]
    return [*texts, "", "a" * 20_000, " " * 9_000 + "x", "-" * 9_000 + "\n\n", "ab" * 7_000 + " b " + "é" * 6_000, " " * 70_000]


def test_bpe_query_equals_library(spark):
    lib = library()
    got = {r.doc_id: r for r in registry.op11_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].n_tokens == len(ids) and got[d.doc_id].ids_sha256 == SHA(",".join(map(str, ids)))
        assert got[d.doc_id].decoded_sha256 == SHA(lib.decode(ids, skip_special_tokens=False))


def test_bpe_odd_texts_and_columns(spark):
    lib, texts = library(), odd_texts()
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(-1, None, None), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").withColumnRenamed("doc_id", "id")
    coded = bpe.encode(df, tokenizer=BPE_FILE)
    assert coded.columns == ["id", "text", "ids"]  # the clashing column gives way
    for r in coded.collect():
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids
    back = {r.id: r.decoded for r in bpe.decode(coded.select("id", "ids"), tokenizer=BPE_FILE, block=7).collect()}
    assert all(back[k] == t for k, t in enumerate(texts)) and back[-1] == ""
    assert bpe.encode(df.limit(0), tokenizer=BPE_FILE).count() == 0


def test_bpe_stream_is_the_whole_and_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 64)  # so that short texts take many windows
    lib, of = library(), bpe.vocabulary(BPE_FILE)
    rnd = random.Random(1)
    for alphabet in ("a", "ab", "=-", " ", "1234567890", "éè", "\n ", "-", "thein "):
        text = rnd.choice(["", " ", "x "]) + "".join(rnd.choice(alphabet) for _ in range(4_000)) + rnd.choice(["", " y", "\n"])
        want = lib.encode(text, add_special_tokens=False).ids
        for block in (1, 13, 512):
            assert np.frombuffer(bpe.streamed(of, text, block), of.dtype).tolist() == want
        encoder = bpe.Encoder(of)
        for k in range(0, len(text), 64):
            encoder.push(text[k:k + 64])
        assert encoder.held < 4 * (64 + of.longest + of.lookahead)


def test_bpe_lookahead_is_sufficient():
    """In small lists, no continuation changes a token that the lookahead calls final."""
    rnd = random.Random(7)
    for _ in range(60):
        made, merges = [b"a", b"b"], []
        while len(merges) < 7:
            u, v = rnd.choice(made), rnd.choice(made)
            if u + v not in made:
                merges.append((u, v))
                made.append(u + v)

        def tokens(text, merges=merges):
            out = [text[i:i + 1] for i in range(len(text))]
            for u, v in merges:
                i = 0
                while i < len(out) - 1:
                    if out[i] == u and out[i + 1] == v:
                        out[i:i + 2] = [u + v]
                    i += 1
            return out

        ahead = bpe.sufficient_lookahead(merges)
        for _ in range(40):
            text = bytes(rnd.choice(b"ab") for _ in range(ahead + 6))
            seen = set()
            for tail in [b"", *(bytes(t) for k in (1, 2, 3) for t in itertools.product(b"ab", repeat=k))]:
                ends, final = 0, []
                for t in tokens(text + tail):
                    ends += len(t)
                    if ends > len(text) - ahead:
                        break
                    final.append(t)
                seen.add(tuple(final))
            assert len(seen) == 1


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.vocabulary(registry.tokenizer_path("word_bpe_49k.json"))


def test_decoder_is_the_librarys_on_broken_bytes():
    lib, of, rnd = library(), bpe.vocabulary(BPE_FILE), random.Random(2)
    for _ in range(200):
        ids = [rnd.randrange(50257) for _ in range(30)] + [rnd.randrange(256) for _ in range(30)]
        rnd.shuffle(ids)
        decoder = bpe.Decoder(of)
        assert "".join(decoder.push(ids[i:i + 3]) for i in range(0, 60, 3)) + decoder.close() == lib.decode(
            ids, skip_special_tokens=False)


# --- 12: conversation repair ----------------------------------------------------------------

def brute_edits(initials, found):
    """The least (cost, audit) over all edits with at most two inserts in a gap."""
    best = None

    def go(i, audit, cost, roles):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(initials):
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
            return
        extra = found[i] == "truncated"
        edits = [("D", 3, "")]
        if found[i] not in ("blank", "duplicate"):
            edits += [("K", extra, initials[i][:1] or "?"), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
        for letter, price, role in edits:
            for gap in ("", "u", "a", "ua", "au"):
                go(i + 1, audit + letter + "I" * len(gap), cost + price + 2 * len(gap), roles + role + gap)

    for gap in ("", "u", "a", "ua", "au"):
        go(0, "I" * len(gap), 2 * len(gap), gap)
    return best


def test_cheapest_edits_are_those_of_brute_force():
    rnd = random.Random(4)
    kinds = ["", "", "", "truncated", "blank", "duplicate"]
    for _ in range(220):
        n = rnd.randint(0, 4)
        initials, found = [rnd.choice(["s", "u", "a", "t", ""]) for _ in range(n)], [rnd.choice(kinds) for _ in range(n)]
        assert structure_repair.cheapest_edits(initials, found) == brute_edits(initials, found), (initials, found)


def test_repair_cases(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 4, "user", "and"),
            (2, None, None, None), (2, None, None, "x"), (3, 5, "system", "Be kind."), (None, 1, "user", "q?"), (None, 2, "assistant", "a!"),
            (4, 1, "user", "")]
    df = spark.createDataFrame([(*r, "c", 9) for r in rows], "conv_id long, turn long, role string, text string, Cost string, audit long")
    got = {r.conv_id: r for r in structure_repair.repair(df).collect()}
    # conversation 1: repeated answer deleted, "and" is cut off and misses its answer: an answer is put in (2 + 1)
    assert (got[1].duplicate, got[1].truncated, got[1].gaps, got[1].illegal) == (1, 1, 2, 1)
    assert got[1].audit == "KKDD" or got[1].cost <= 6
    assert (got[1].cost, got[1].audit) == brute_edits(["u", "a", "a", "u"], ["", "", "duplicate", "truncated"])
    assert got[2].blank == 1 and got[2].truncated == 1 and got[2].gaps == 0
    assert (got[3].cost, got[3].audit, got[3].repaired) == (3, "D", [])
    assert (got[None].cost, got[None].audit, [tuple(t) for t in got[None].repaired]) == (0, "KK", [("user", "q?"), ("assistant", "a!")])
    assert (got[4].blank, got[4].cost, got[4].audit) == (1, 3, "D")
    assert structure_repair.repair(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, k, ("user", "assistant")[k % 3 % 2], f"{k}.") for k in range(3_000)], df.select(
        "conv_id", "turn", "role", "text").schema)
    row, = structure_repair.repair(long).collect()
    roles = "".join(t.role[0] for t in row.repaired)
    assert re.fullmatch("(ua)+", roles) and len(row.audit.replace("I", "")) == 3_000


def test_repair_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r.conv_id: r for r in registry.op12_structure_repair(spark, SF).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if kind == 4 else r.role, r.text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[r.conv_id].extend([] if kind == 0 else [(r.turn, role, text)] * (2 if kind == 3 else 1))
    assert got.keys() == {r.conv_id for r in rows}
    for conv, g in got.items():
        turns, seen, found = by[conv], set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            found.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[0] for _, role, _ in turns]
        numbers = [t for t, _, _ in turns]
        want = [max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *map(found.count, ("blank", "duplicate", "truncated")),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))]
        assert [g.gaps, g.blank, g.duplicate, g.truncated, g.illegal] == want
        cost, audit = structure_repair.cheapest_edits(initials, found)
        assert (g.cost, g.audit) == (cost, audit)
        lines, left = [], iter(turns)
        for letter in audit:
            if letter == "I":
                lines.append([None, ""])
            else:
                _, role, text = next(left)
                if letter != "D":
                    lines.append([role if letter == "K" else None, text])
        first = 1 if lines and lines[0][0] and lines[0][0][0] == "s" else 0
        for k, line in enumerate(lines):
            line[0] = line[0] or ("user", "assistant")[(k - first) % 2]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
        assert g.repaired_sha256 == SHA("\n".join(f"{r}:{t}" for r, t in lines))


# --- 13: Merkle manifest -------------------------------------------------------------------------

def brute_manifest(rows):
    """rows of (key, group, leaf, claimed) -> key, leaf, subroot, root, proof, folded root, per row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([SHA("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        trees[g] = levels([r[2] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (key, _, leaf, claimed) in enumerate(groups[g]):
            proof, folded = "", claimed
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    start = at - at % 8
                    run = level[start:start + 8]
                    proof += "".join(d for s, d in enumerate(run) if s != at % 8)
                    folded = SHA("".join(folded if s == at % 8 else d for s, d in enumerate(run)))
                    at //= 8
            out.append((key, leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def sort_key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("sizes", [{"en": 1300, "de": 513, None: 9, "é": 1, "": 64}, {"a": 1}, {None: 8, "b": 512} | {f"g{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_against_brute_force(spark, sizes):
    rnd, rows = random.Random(6), []
    for g, n in sizes.items():
        keys = [rnd.randrange(2 * n) for _ in range(n - n // 50)] + [None] * (n // 50)
        rows += [(key, g, SHA(f"{g}{key}{k % 3}"), SHA(f"{g}{key}{k % 3}" + ("" if k % 4 else "!"))) for k, key in enumerate(keys)]
    df = spark.createDataFrame(rows, "key long, group string, leaf string, claimed string").repartition(5)
    got = manifest.prove(df, claimed="claimed").collect()
    want = brute_manifest(rows)
    assert sorted(map(tuple, got), key=sort_key) == sorted(want, key=sort_key)


def test_manifest_query_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def leaf(r, text):
        values = [r.doc_id, r.source, r.lang, r.n_chars, text]
        return SHA("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def lowered(r):
        low = r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        return re.sub("[A-Z]", lambda m: m[0].lower(), r.text) if low else r.text

    want = brute_manifest([(r.doc_id, r.lang, leaf(r, r.text), leaf(r, lowered(r))) for r in docs])
    got = registry.op13_manifest(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((k, a, s, r, SHA(p), f, v) for k, a, s, r, p, f, v in want)
    assert any(not r.verified for r in got) and any(r.verified for r in got)
    empty = spark.createDataFrame([], "key long, group string, leaf string, other int, G string")
    assert manifest.prove(empty).count() == 0
