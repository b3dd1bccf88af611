"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The merge list fixes how far ahead text can still change tokens that are already there. Take
two texts with a common prefix and apply the merges in order of rank to both. Up to a
frontier the tokens agree; at first it is the prefix's end. A merge (w, s) moves it, by the
length of w, only if w ends there and s starts there in one text alone. The next such merge
has a higher rank and an s that begins with this w (``w`` is on the left spine of ``s``). The
longest chain of this kind, weighed by the lengths of w, is the *sufficient lookahead*: a
token that ends so many bytes before the end of what is read is final (``lookahead``).

The encoder reads a text in blocks. A pre-token border is settled once the text behind it is
known; a pre-token longer than ``WINDOW`` bytes is fed to the merges window by window, tokens
being emitted as soon as they lie ``lookahead`` bytes before the window's end. So memory is a
window, a block and a cache of words, however long a text or one of its words is. The decoder
is a state machine from token bytes to text that keeps at most an unfinished character.

Ids are those of the ``tokenizers`` library for byte-level BPE files without a normaliser;
strings of added tokens in a text get these tokens' ids, as they do there. Another kind of file
is an error.

Defined cases: NULL texts count as empty and have no ids; NULL ids decode to the empty text,
ids outside the vocabulary to nothing; bytes that are no UTF-8 decode to U+FFFD; repeated rows
are rows of their own; an empty table gives an empty result; all other columns ride along.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import json
import re
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import carry, find, ship

#: The pre-token pattern of byte-level BPE files that use their own split (fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The classes of which a long pre-token is made: letters, numbers, other signs, white space.
RUNS = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")))
SPACE_RUN = RUNS[3]
#: Bytes of a pre-token that the merges see at once, beside the lookahead.
WINDOW = 4096
#: Characters of a text that are read at once.
BLOCK = 1 << 16
#: Words kept with their ids by each Python worker; longer words than ``CACHED_LENGTH`` are not kept.
CACHED_WORDS = 200_000
CACHED_LENGTH = 64
#: Texts whose unknown words are merged together.
ROWS = 1000
#: A contraction has so many characters at most, so a match that starts later may still grow.
CONTRACTION = 3


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token that decide it: the longest chain of merges that carry a change to the left.

    Merges are taken from the last to the first. ``reach[t]`` is the farthest that a change can
    come, by later merges, whose right part begins with token ``t``.
    """
    left = {u + v: u for u, v in merges}
    reach: dict[bytes, int] = {}
    longest = 0
    for w, s in reversed(merges):
        far = len(w) + reach.get(w, 0)
        longest = max(longest, far)
        spine: bytes | None = s
        while spine is not None:
            reach[spine] = max(reach.get(spine, 0), far)
            spine = left.get(spine)
    return longest


class PairTable:
    """Pairs of ids to ranks as arrays (open addressing), to look up many at once."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, none: int):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys, self.ranks, self.none = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, none, np.int64), none
        keys, step = (pairs[:, 0] << 32 | pairs[:, 1]) if len(pairs) else np.zeros(0, np.int64), 0
        while len(keys):
            slots, first = np.unique(self._slot(keys, step), return_index=True)
            first = first[self.keys[slots] < 0]
            taken = self._slot(keys[first], step)
            self.keys[taken], self.ranks[taken] = keys[first], ranks[first]
            keys, ranks, step = np.delete(keys, first), np.delete(ranks, first), step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        slots = self._slot(keys, 0)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.ranks[slots], self.none)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        for _ in range(1, self.steps):
            if not len(left):
                break
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.ranks[slots[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Vocabulary:
    """Merges by pair of ids, the ids of bytes, the bytes of ids and the added tokens of a file."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        value = {letter: byte for byte, letter in enumerate(letters)}
        self._check(spec)
        vocab: dict[str, int] = model["vocab"]
        spelled = lambda token: bytes(map(value.__getitem__, token))
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.first, self.last = [vocab[letter] for letter in letters], len(pairs)
        self.pairs, self.made = [(vocab[u], vocab[v]) for u, v in pairs], [vocab[u + v] for u, v in pairs]
        self.bytes_of: dict[int, bytes] = {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in [*vocab.items(), *self.added.items()]:
            known = all(c in value for c in token)
            self.bytes_of[i] = spelled(token) if known else token.encode()
        self.longest = max(map(len, self.bytes_of.values()))
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.dtype = np.dtype("<u2" if max(self.bytes_of) < 65536 else "<u4")
        self._check_order()

    @cached_property
    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids' bytes in one array, and where each id's begin and how many they are; a last, empty one."""
        parts = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 2)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    # what only the encoder needs
    @cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead([(self.bytes_of[a], self.bytes_of[b]) for a, b in self.pairs])

    @cached_property
    def rank(self) -> dict[tuple[int, int], int]:
        return {pair: rank for rank, pair in enumerate(self.pairs)}

    @cached_property
    def table(self) -> PairTable:
        return PairTable(np.array(self.pairs, np.int64).reshape(-1, 2), np.arange(self.last), self.last)

    @cached_property
    def first_ids(self) -> np.ndarray:
        return np.array(self.first)

    @cached_property
    def made_ids(self) -> np.ndarray:
        return np.array([*self.made, -1])

    @staticmethod
    def _check(spec: dict) -> None:
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        own = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                      "byte_fallback", "ignore_merges")]
        odd = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if model["type"] != "BPE" or not plain or any(own) or spec.get("normalizer") or odd:
            raise ValueError("only byte-level BPE files without a normaliser are read")

    def _check_order(self) -> None:
        """The lookahead holds for lists whose merges make each token once, out of earlier ones."""
        made = set(self.first)
        for (a, b), token in zip(self.pairs, self.made, strict=True):
            if a not in made or b not in made or token in made:
                raise ValueError("the merge list makes a token twice or before its parts")
            made.add(token)

    def packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def merged(self, data: bytes) -> list[int]:
        """The token ids of one piece: always the leftmost pair of the lowest rank is merged next."""
        ids = [self.first[b] for b in data]
        if len(ids) > 48:
            return self._merged_by_heap(ids)
        rank, last = self.rank.get, self.last
        ranks = [rank(pair, last) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == last:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), last)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), last)
        return ids

    def merged_many(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of many short pieces: all pieces take their next merge at once.

        One flat array holds all tokens, another the rank of each with its right neighbour. In
        a round every piece merges all pairs of its lowest rank (of three equal tokens in a row the first
        two); pieces without a merge leave the arrays.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ranks = self._ranks(ids, owner, np.arange(len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(ranks, begins)
            lowest = np.repeat(least, np.diff(np.append(begins, len(ids))))
            open_ = lowest < self.last
            if not open_.all():
                done.append((owner[~open_], ids[~open_]))
                ids, owner, ranks, lowest = ids[open_], owner[open_], ranks[open_], lowest[open_]
            at = np.flatnonzero(ranks == lowest)
            if not len(at):
                continue
            apart = np.concatenate([[True], np.diff(at) > 1])
            run_begin = np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_begin) % 2 == 0]
            ids[at] = self.made_ids[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            now = at - np.arange(len(at))
            changed = np.concatenate([now, now[now > 0] - 1])
            ranks[changed] = self._ranks(ids, owner, changed)
        whose = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([i for _, i in done]) if done else np.zeros(0, np.int64)
        packed = flat[np.argsort(whose, kind="stable")].astype(self.dtype).tobytes()
        ends = np.cumsum(np.bincount(whose, minlength=len(pieces))) * self.dtype.itemsize
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if pieces else []

    def _ranks(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the tokens at ``at`` with their right neighbours (``last``: no merge)."""
        right = np.minimum(at + 1, len(ids) - 1)
        found = self.table.find(ids[at], ids[right])
        return np.where((right > at) & (owner[at] == owner[right]), found, self.last)

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                found = self.rank.get((ids[i], ids[j]))
                if found is not None:
                    heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            best, i, u, v = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != u or j >= n or ids[j] != v:
                continue
            ids[i], alive[j], after[i] = self.made[best], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ids[i] for i in range(n) if alive[i]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


class _Words(dict):
    """Piece of text (whole pre-tokens) -> packed ids, filled on demand; when full, what was not asked for lately goes."""

    def __init__(self, of: Vocabulary, lead: str = "", parts: dict[str, bytes] | None = None):
        super().__init__()
        self.of, self.lead, self.parts = of, lead, parts
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._ids(piece)
        if len(piece) <= CACHED_LENGTH:
            self.keep({piece: ids})
        return ids

    def keep(self, known: dict[str, bytes]) -> None:
        """Cache what was just used; what a full cache held before stays for one more round."""
        if len(self) + len(known) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        for piece, ids in known.items() if len(known) <= CACHED_WORDS else itertools.islice(known.items(), CACHED_WORDS):
            if len(piece) <= CACHED_LENGTH:
                self[piece] = ids

    def _ids(self, piece: str) -> bytes:
        if len(piece) > WINDOW:
            return streamed(self.of, self.lead + piece)
        found = PRETOKEN.findall(self.lead + piece)
        if self.parts is not None and len(found) > 1:
            return b"".join(map(self.parts.__getitem__, found))
        return self.of.packed([i for p in found for i in self.of.merged(p.encode("utf-8", "replace"))])


class Encoder:
    """The transducer: ``push`` takes text and gives the ids that are final, ``close`` gives the rest."""

    def __init__(self, of: Vocabulary):
        self.of = of
        self.text = ""  # text whose pre-token borders are open
        self.run = None  # class of the long pre-token that is being read
        self.data = b""  # its bytes whose tokens are open
        self.window = max(WINDOW, of.longest) + of.lookahead  # so that a window settles a token at least
        self.held = 0  # most bytes ever open, for tests

    def push(self, text: str) -> list[bytes]:
        self.text += text
        out: list[bytes] = []
        while self._step(out, last=False):
            pass
        self.held = max(self.held, len(self.text.encode("utf-8", "replace")) + len(self.data))
        return out

    def close(self) -> list[bytes]:
        out: list[bytes] = []
        while self._step(out, last=True):
            pass
        self._feed(out, b"", last=True)
        return out

    def _step(self, out: list[bytes], last: bool) -> bool:
        if self.run is not None:
            return self._read_run(out, last)
        return self._read_pretokens(out, last)

    def _read_pretokens(self, out: list[bytes], last: bool) -> bool:
        at, end = 0, len(self.text)
        for m in PRETOKEN.finditer(self.text):
            if not last and (m.end() == end or m.start() > end - CONTRACTION):
                break
            self._whole(out, m.group())
            at = m.end()
        self.text = self.text[at:]
        if not last and len(self.text) > WINDOW:  # one run up to the end: read it as a long pre-token
            lead = 1 if self.text[0] == " " and not SPACE_RUN.match(self.text, 1) else 0
            self.run = next(r for r in RUNS if r.match(self.text, lead))
            self.data = self.text[:lead].encode()
            self.text = self.text[lead:]
            return True
        return False

    def _read_run(self, out: list[bytes], last: bool) -> bool:
        m = self.run.match(self.text)
        reach = m.end() if m else 0
        ended = reach < len(self.text)
        if self.run is SPACE_RUN and not (last and not ended):
            reach = max(reach - 1, 0)  # the last space of a run belongs to what follows
        self._feed(out, self.text[:reach].encode("utf-8", "replace"), last=ended or last)
        self.text = self.text[reach:]
        if ended or last:
            self.run = None
        return ended

    def _whole(self, out: list[bytes], piece: str) -> None:
        self._feed(out, piece.encode("utf-8", "replace"), last=True)

    def _feed(self, out: list[bytes], data: bytes, last: bool) -> None:
        """Windows of one pre-token through the merges; tokens within the lookahead wait."""
        self.data += data
        while len(self.data) > self.window or (last and self.data):
            whole = last and len(self.data) <= self.window
            seen = self.data if whole else self.data[:self.window]
            ids = self.of.merged(seen)
            done, settled = 0, 0
            for i in ids:
                size = len(self.of.bytes_of[i])
                if not whole and done + size > len(seen) - self.of.lookahead:
                    break
                done += size
                settled += 1
            out.append(self.of.packed(ids[:settled]))
            self.data = self.data[done:]


def streamed(of: Vocabulary, text: str, block: int = BLOCK) -> bytes:
    """A text's packed ids through the transducer, block by block."""
    encoder, out = Encoder(of), []
    for at in range(0, len(text), block):
        out.extend(encoder.push(text[at:at + block]))
    return b"".join(out + encoder.close())


class Decoder:
    """Ids to text, block by block; an unfinished character waits for its last byte."""

    def __init__(self, of: Vocabulary):
        self.flat, self.begins, self.sizes = of.spelling
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def push(self, ids: Sequence[int]) -> str:
        ids = np.asarray(ids, np.int64)
        known = len(self.sizes) - 1
        ids = np.where((ids >= 0) & (ids < known), ids, known)  # the last one is empty
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.state.decode(self.flat[at].tobytes())

    def close(self) -> str:
        return self.state.decode(b"", final=True)


class _Texts:
    """Whole texts to packed ids. Short ones go word by word through the cache, long ones through the transducer.

    A space between two other signs always starts a pre-token, so words that it parts are encoded apart,
    and all words of a batch that are not cached are merged together.
    """

    def __init__(self, of: Vocabulary):
        self.of = of
        self.pieces = _Words(of)
        self.words = _Words(of, " ", self.pieces)  # words are followed by signs, which are pre-tokens of their own

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self._words_of(t) for t in texts]
        wanted: set[str] = set()
        for parts in split:
            if parts is not None:
                wanted.update(parts[1:])
        lately, before = self.words.get, self.words.older.get
        table = {w: lately(w) or before(w) for w in wanted}
        new = [w for w, ids in table.items() if ids is None and len(w) <= CACHED_LENGTH]
        table.update(self._merged_words(new))
        long = [w for w, ids in table.items() if ids is None]  # too long to be kept
        table.update((w, self.words[w]) for w in long)
        self.words.keep(table)
        word = table.__getitem__
        return [self.ids(t) if parts is None else self.pieces[parts[0]] + b"".join(map(word, parts[1:]))
                for t, parts in zip(texts, split, strict=True)]

    def _words_of(self, text: str) -> list[str] | None:
        if len(text) > BLOCK or any(a in text for a in self.of.added):
            return None
        parts = text.split(" ")
        return parts if all(parts) and parts == [*map(str.strip, parts)] else None

    def _merged_words(self, words: list[str]) -> dict[str, bytes]:
        """The words' packed ids (after a space); their pre-tokens that are not cached are merged at once."""
        if not words:
            return {}
        found = PRETOKEN.findall(" " + " ".join(words))  # the tokens of a word begin with one that has a space
        lately, before = self.pieces.get, self.pieces.older.get
        table = {p: lately(p) or before(p) for p in set(found)}
        new = [p for p, ids in table.items() if ids is None]
        table.update(zip(new, self.of.merged_many([p.encode("utf-8", "replace") for p in new]), strict=True))
        self.pieces.keep({p: ids for p, ids in table.items() if p[0] != " "})
        ids = list(map(table.__getitem__, found))
        begins = [i for i, p in enumerate(found) if p[0] == " "]
        return {w: ids[a] if b - a == 1 else b"".join(ids[a:b])
                for w, a, b in zip(words, begins, [*begins[1:], len(found)], strict=True)}

    def ids(self, text: str) -> bytes:
        if not any(a in text for a in self.of.added):
            return self._plain(text)
        parts = [p for p in self.of.split_added.split(text) if p]
        return b"".join(self.of.packed([self.of.added[p]]) if p in self.of.added else self._plain(p) for p in parts)

    def _plain(self, text: str) -> bytes:
        if len(text) > BLOCK:
            return streamed(self.of, text)
        return b"".join(map(self.pieces.__getitem__, PRETOKEN.findall(text)))


@lru_cache(maxsize=2)
def _texts(path: str) -> _Texts:
    """A worker's caches, kept from task to task."""
    return _Texts(vocabulary(path))


def _put_back(df: DataFrame, coded: DataFrame, out: str, gone: int | None) -> DataFrame:
    """The input's columns under their names, but for the one at ``gone``, and ``out``."""
    kept = [F.col(f"__c{i}").alias(n) for i, n in enumerate(df.columns) if i != gone and n.lower() != out.lower()]
    return coded.select(*kept, F.col("__out").alias(out))


def encode(df: DataFrame, *, tokenizer: str, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """The input's columns plus the texts' ids (array<int>); without ``keep_text`` the text goes."""
    ship(df.sparkSession)
    gone = None if keep_text else find(df, text)
    frame, _ = carry(df, text=text)
    rest = [f"__c{i}" for i in range(len(df.columns)) if i != gone]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _texts(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                packed = texts.batch([t or "" for t in part.column("text").to_pylist()])
                ends = np.cumsum([0, *map(len, packed)]) // texts.of.dtype.itemsize
                ids = np.frombuffer(b"".join(packed), texts.of.dtype).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], lists], [*rest, "__out"])

    schema = T.StructType([*[frame.schema[c] for c in rest], T.StructField("__out", T.ArrayType(T.IntegerType()))])
    coded = frame.select(*rest, frame["text"].cast("string").alias("text")).mapInArrow(work, schema)
    return _put_back(df, coded, out, gone)


def decode(df: DataFrame, *, tokenizer: str, ids: str = "ids", out: str = "decoded", block: int = BLOCK) -> DataFrame:
    """The input's columns with the ids replaced by their text."""
    ship(df.sparkSession)
    gone = find(df, ids)
    frame, _ = carry(df, ids=ids)
    rest = [f"__c{i}" for i in range(len(df.columns)) if i != gone]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(tokenizer)
        for b in batches:
            texts = []
            for row in b.column("ids"):
                decoder, values = Decoder(of), row.values
                n = 0 if values is None else len(values)
                parts = [decoder.push(values.slice(at, block).fill_null(-1)) for at in range(0, n, block)]
                texts.append("".join(parts) + decoder.close())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(texts, pa.string())], [*rest, "__out"])

    schema = T.StructType([*[frame.schema[c] for c in rest], T.StructField("__out", T.StringType())])
    return _put_back(df, frame.select(*rest, "ids").mapInArrow(work, schema), out, gone)
