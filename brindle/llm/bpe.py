"""Byte-level BPE by speculation and verification, and its inverse.

A word's tokens are first guessed by greedy longest match. The guess is the true encoding if and only if every
token is the encoding of its own bytes and every two neighbours are compatible, which means that no merge across
their boundary would have come first. All neighbour pairs of a piece are tested at once against sorted arrays of
known pairs; pairs not met before are decided once from the merge ranks. Only words with a failing pair go through
exact merging. Guesses and merges of words up to ``SHORT`` bytes run as array operations over all such words of a
piece, one step of every word at a time; longer words, which are rare, go one by one. Special strings become their own ids; decoding joins the bytes of all ids, special ones included.

Defined cases: a null text counts as empty and has no tokens; texts of any length are taken whole (a word without
spaces merges in n log n); rows are independent.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import load

NONE = 1 << 60
#: Entries that a worker's memory of encoded chunks holds before it starts afresh.
MEMORY = 250_000
#: Ids that are decoded at once, unless one text has more.
DECODED = 1 << 18
#: Signs that, alone after a run of letters, are a word each.
PLAIN = frozenset(",.;:!?")
#: Bytes of a word that fit two 8-byte lanes.
SHORT = 16


class Lookup:
    """Row numbers of keys, each one or more unsigned 64-bit columns, by open addressing in arrays; -1 where absent."""

    def __init__(self, *columns: np.ndarray):
        self.columns = [c.astype(np.uint64) for c in columns]
        n = len(columns[0])
        self.bits = max(4, (4 * n).bit_length())
        self.rows = np.full(1 << self.bits, -1, dtype=np.int64)
        slot, left = self._slot(self.columns), np.arange(n)
        while len(left):
            spot = slot[left]
            _, first = np.unique(spot, return_index=True)
            won = first[self.rows[spot[first]] < 0]
            self.rows[spot[won]] = left[won]
            left = np.delete(left, won)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, columns: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = columns[0] * K.P1
            for c in columns[1:]:
                h = (K.rotl(h, 31) ^ c) * K.P2
            return ((h ^ (h >> K.U(29))) * K.P3 >> K.U(64 - self.bits)).astype(np.int64)

    def find(self, *columns: np.ndarray) -> np.ndarray:
        columns = [c.astype(np.uint64, copy=False) for c in columns]
        slot = self._slot(columns)
        out = self.rows[slot]
        same = out >= 0
        for mine, c in zip(self.columns, columns, strict=True):
            same &= mine[out] == c
        left = np.flatnonzero(~same & (out >= 0))
        out[~same] = -1
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            row = self.rows[slot[left]]
            same = row >= 0
            for mine, c in zip(self.columns, columns, strict=True):
                same &= mine[row] == c[left]
            out[left[same]] = row[same]
            left = left[~same & (row >= 0)]
        return out


class Seen:
    """Whether a key came before, by one byte at its hash; so that what comes once takes no room in a memory."""

    def __init__(self, bits: int = 22):
        self.marks, self.mask, self.n = bytearray(1 << bits), (1 << bits) - 1, 0

    def before(self, key) -> bool:
        at = hash(key) & self.mask
        if self.marks[at]:
            return True
        self.n += 1
        if self.n > self.mask >> 1:
            self.marks, self.n = bytearray(self.mask + 1), 0
        self.marks[at] = 1
        return False


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge ranks over token ids, and what follows from them."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks = ranks  # (left, right): (rank, merged)
        self.made = {m: (rank, a, b) for (a, b), (rank, m) in sorted(ranks.items(), key=lambda x: -x[1][0])}
        self.rank = {a << 20 | b: rank for (a, b), (rank, _) in ranks.items()}
        self.by_rank = {rank: m for rank, m in ranks.values()}
        self._known: dict[int, bool] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}

    def _spine(self, token: int, side: int, memory: dict) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it up) from the outermost leaf to the token itself."""
        found = memory.get(token)
        if found is None:
            up, t, above = [], token, NONE
            while True:
                up.append((t, above))
                if t not in self.made:
                    break
                above = self.made[t][0]
                t = self.made[t][side]
            found = memory[token] = up[::-1]
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay two tokens while each grows from its leaves."""
        key = a << 20 | b
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 500_000:
                self._known.clear()
            known = self._known[key] = self._decide(a, b)
        return known

    def _decide(self, a: int, b: int) -> bool:
        xs, ys = self._spine(a, 2, self._right), self._spine(b, 1, self._left)
        i = j = 0
        rank = self.rank.get
        while True:
            (x, next_x), (y, next_y) = xs[i], ys[j]
            across = rank(x << 20 | y, NONE)
            # Of equal ranks the leftmost merge comes first.
            if across < next_x and across <= next_y:
                return False
            if next_x == NONE and next_y == NONE:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging of leaves: always the lowest rank, leftmost first."""
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        ids, rank, made = list(ids), self.rank.get, self.by_rank
        row = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while row:
            low = min(row)
            if low == NONE:
                break
            i = row.index(low)
            ids[i] = made[low]
            del ids[i + 1], row[i]
            if i < len(row):
                row[i] = rank(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                row[i - 1] = rank(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        ids, n, ranks = list(ids), len(ids), self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := ranks.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (r[0], p, ids[p], ids[q], r[1]))
        return [t for t in ids if t >= 0]


class ByteBPE:
    """A byte-level vocabulary of the tokenizers library."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: Where runs of white space may reach over a single space, text isn't cut at spaces.
    WIDE = regex.compile(r"\s \s|  |^ | $")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        vocab: dict[str, int] = model["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)})
        self.leaf = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # A token that its own bytes don't encode to must never be guessed.
        self.guess = {t: i for t, i in self.ids.items() if self.merges.merge([self.leaf[c] for c in t]) == [i]}
        self.longest: dict[bytes, int] = {}
        for t in self.guess:
            for k in (1, 2):
                if len(t) >= k:
                    self.longest[t[:k]] = max(self.longest.get(t[:k], 0), len(t))
        self.pairs, self.fits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.memory: dict[str, bytes] = {}
        self.seen = Seen()
        self.exact = 0
        self.sizes = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        # The same as arrays. A short token is two lanes of bytes and a length.
        short = [(t, i) for t, i in self.guess.items() if len(t) <= SHORT]
        padded = np.frombuffer(b"".join(t.ljust(SHORT, b"\0") for t, _ in short), dtype="<u8").reshape(-1, 2)
        self.tokens = Lookup(padded[:, 0], padded[:, 1], np.array([len(t) for t, _ in short]))
        self.token_ids = np.array([i for _, i in short], dtype=np.int32)
        self.reach = np.ones(1 << 16, dtype=np.int64)
        for t, n in self.longest.items():
            if len(t) == 2:
                self.reach[t[0] | t[1] << 8] = min(n, SHORT)
        self.leaves = np.array(self.leaf, dtype=np.int32)
        ranked = np.array([(a << 20 | b, rank, m) for (a, b), (rank, m) in self.merges.ranks.items()], dtype=np.int64).reshape(-1, 3)
        self.mergeable = Lookup(ranked[:, 0])
        self.merge_rank = np.append(ranked[:, 1], NONE)  # the last one stands for pairs that don't merge
        self.merged = np.zeros(int(ranked[:, 1].max(initial=0)) + 1, dtype=np.int32)
        self.merged[ranked[:, 1]] = ranked[:, 2]

    def speculate(self, word: bytes) -> list[int]:
        out, i, n, guess, longest = [], 0, len(word), self.guess, self.longest
        while i < n:
            top = min(longest.get(word[i : i + 2], 1), n - i)
            for k in range(top, 0, -1):
                t = guess.get(word[i : i + k])
                if t is not None:
                    out.append(t)
                    i += k
                    break
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        for i in range(0, len(short), 1 << 15):
            part = short[i : i + (1 << 15)]
            for k, ids in zip(part, self._short_words([words[k] for k in part]), strict=True):
                out[k] = ids
        long = [k for k, w in enumerate(words) if len(w) > SHORT]
        if long:
            found = [self.speculate(words[k]) for k in long]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            ok = self._verify(np.array([t for f in found for t in f], dtype=np.int64), np.repeat(np.arange(len(long)), sizes), len(long))
            for k, ids, fits in zip(long, found, ok.tolist(), strict=True):
                if not fits:
                    self.exact += 1
                    ids = self.merges.merge([self.leaf[c] for c in words[k]])
                out[k] = np.array(ids, dtype="<u4").tobytes()
        return out

    def _verify(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Of n words, whether all neighbours among a word's ids are compatible."""
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        codes = ids[beside] << 20 | ids[beside + 1]
        self._learn(np.unique(codes))
        ok = np.ones(n, dtype=bool)
        if len(codes):
            ok[owner[beside[~self.fits[np.searchsorted(self.pairs, codes)]]]] = False
        return ok

    def _short_words(self, words: list[bytes]) -> list[bytes]:
        n, size = len(words), np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join([w.ljust(SHORT, b"\0") for w in words]), dtype=np.uint8).reshape(n, SHORT)
        ids, counts = self._speculate_short(raw, size)
        inside = np.arange(SHORT) < counts[:, None]
        ok = self._verify(ids[inside].astype(np.int64), np.repeat(np.arange(n), counts), n)
        fails = np.flatnonzero(~ok)
        if len(fails):
            self.exact += len(fails)
            ids[fails], counts[fails] = self._merge_rows(self.leaves[raw[fails]], size[fails])
            inside = np.arange(SHORT) < counts[:, None]
        blob, ends = ids[inside].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _speculate_short(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: ids in rows of SHORT, and how many count."""
        n = len(raw)
        flat = np.zeros((n, SHORT + 16), dtype=np.uint8)
        flat[:, :SHORT] = raw
        stride = SHORT + 9
        lanes = np.stack([flat[:, k : k + 8].copy().view("<u8")[:, 0] for k in range(stride)], axis=1).ravel()
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        ids, counts = np.zeros((n, SHORT), dtype=np.int32), np.zeros(n, dtype=np.int64)
        at = np.zeros(n, dtype=np.int64)
        row = np.flatnonzero(size > 0)
        while len(row):
            base = row * stride + at[row]
            near, far = lanes[base], lanes[base + 8]
            rest = size[row] - at[row]
            top = np.minimum(np.where(rest > 1, self.reach[(near & K.U(0xFFFF)).astype(np.int64)], 1), rest)
            token, length = np.full(len(row), -1, dtype=np.int64), np.zeros(len(row), dtype=np.int64)
            for k in range(int(top.max()), 0, -1):
                todo = np.flatnonzero((top >= k) & (token < 0))
                if len(todo):
                    got = self.tokens.find(near[todo] & masks[min(k, 8)], far[todo] & masks[max(k - 8, 0)], np.full(len(todo), k, dtype=np.uint64))
                    token[todo] = got
                    length[todo[got >= 0]] = k
            ids[row, counts[row]] = self.token_ids[token]
            counts[row] += 1
            at[row] += length
            row = row[at[row] < size[row]]
        return ids, counts

    def _merge_rows(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all rows side by side; each step merges the lowest rank, leftmost first, of every row."""
        n, width = ids.shape
        out, counts = ids.astype(np.int64), size.copy()
        pair = out[:, :-1] << 20 | out[:, 1:]
        rank = self.merge_rank[self.mergeable.find(pair.ravel())].reshape(n, width - 1)
        rank[np.arange(1, width) >= counts[:, None]] = NONE
        row, place = np.arange(n), np.arange(width)
        work, ranks = out, rank
        while True:
            i = ranks.argmin(axis=1)
            low = ranks[np.arange(len(row)), i]
            live = low < NONE
            out[row[~live]] = work[~live]
            row, work, ranks, i, low = row[live], work[live], ranks[live], i[live], low[live]
            if not len(row):
                return out.astype(np.int32), counts
            counts[row] -= 1
            each = np.arange(len(row))
            work[each, i] = self.merged[low]
            moved = place[:-1] > i[:, None]
            work[:, :-1] = np.where(moved, work[:, 1:], work[:, :-1])
            ranks[:, :-1] = np.where(moved[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            for j in (i, i - 1):
                on = np.flatnonzero((j >= 0) & (j + 1 < counts[row]))
                ranks[on, j[on]] = self.merge_rank[self.mergeable.find(work[on, j[on]] << 20 | work[on, j[on] + 1])]
            end = np.flatnonzero(i + 1 >= counts[row])
            ranks[end, np.minimum(i[end], width - 2)] = NONE

    def _learn(self, codes: np.ndarray) -> None:
        at = np.searchsorted(self.pairs, codes)
        inside = at < len(self.pairs)
        new = codes[~inside | (self.pairs[np.minimum(at, max(len(self.pairs) - 1, 0))] != codes)] if len(self.pairs) else codes
        if not len(new):
            return
        if len(self.pairs) > 2_000_000:
            self.pairs, self.fits, new = self.pairs[:0], self.fits[:0], codes
        decide = self.merges._decide
        fits = np.fromiter((decide(c >> 20, c & 0xFFFFF) for c in new.tolist()), dtype=bool, count=len(new))
        order = np.argsort(pairs := np.concatenate([self.pairs, new]), kind="stable")
        self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits])[order]

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded each on its own: all but the first lack the space in front, and have none inside."""
        return [text] if self.WIDE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plan: list[list[str]] = []
        for text in texts:
            todo: list[str] = []
            at = 0
            for m in self.cut.finditer(text) if self.cut else ():
                self._add(todo, text[at : m.start()])
                todo.append(f"  {m.group()}")
                at = m.end()
            self._add(todo, text[at:] if at else text)
            plan.append(todo)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory = self.memory
        fresh = set().union(*plan).difference(memory)
        collecting = gc.isenabled()
        gc.disable()  # no cycles arise here, and looking for them among this many small objects takes longer than the work
        try:
            self._remember(fresh)
        finally:
            if collecting:
                gc.enable()
        out = [b"".join(map(memory.__getitem__, todo)) for todo in plan]
        for c in fresh:
            if not self.seen.before(c):
                del memory[c]
        return out

    def _add(self, todo: list[str], text: str) -> None:
        """A first part is marked by one space, a special string (encode does it) by two; other parts hold none."""
        if text:
            parts = self.chunks(text)
            parts[0] = f" {parts[0]}"
            todo += parts

    def words(self, chunk: str) -> list[str]:
        """The words of one chunk."""
        first = chunk[0] == " "
        body = chunk[1:] if first else chunk
        if body.isalpha():  # the usual cases without the pattern
            return [body if first else f" {body}"]
        if body[-1:] in PLAIN and body[:-1].isalpha():
            return [body[:-1] if first else f" {body[:-1]}", body[-1]]
        return self.WORDS.findall(body if first else f" {body}")

    def _remember(self, chunks: set[str]) -> None:
        index: dict[str, int] = {}
        alone, whole, several, parts = [], [], [], []
        for c in chunks:
            if c[:2] == "  " and c[2:] in self.special:
                self.memory[c] = np.array([self.special[c[2:]]], dtype="<u4").tobytes()
                continue
            words = self.words(c)
            if len(words) == 1:
                alone.append(c)
                whole.append(index.setdefault(words[0], len(index)))
            else:
                several.append(c)
                parts.append([index.setdefault(w, len(index)) for w in words])
        ids = self.encode_words([w.encode() for w in index])
        self.memory.update(zip(alone, map(ids.__getitem__, whole)))
        for c, words in zip(several, parts, strict=True):
            self.memory[c] = b"".join([ids[w] for w in words])

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes that each row of ids stands for."""
        sizes = np.cumsum([len(i) // 4 for i in ids])
        if len(ids) > 1 and sizes[-1] > DECODED:  # in parts, so that the arrays stay small
            half = min(max(1, int(np.searchsorted(sizes, sizes[-1] // 2))), len(ids) - 1)
            return self.decode(ids[:half]) + self.decode(ids[half:])
        every = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        size = self.sizes[every]
        ends = np.cumsum(size)
        raw = self.spelled[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[every] - (ends - size), size)].tobytes()
        cuts = np.append(0, ends)[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def text_of(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


_OPEN: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One instance for each Python worker and file."""
    if path not in _OPEN:
        _OPEN[path] = ByteBPE(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text_column: str = "text") -> DataFrame:
    """All columns, and n_tokens, token_ids (array<int>), round_trip (decoding gave the text again).

    Columns that have these names already are replaced.
    """
    path = path or default_path()
    docs = docs.drop("n_tokens", "token_ids", "round_trip")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_tokens bigint", "token_ids array<int>", "round_trip boolean"])

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for piece in K.pieces(batch, text_column):
                texts = [x or "" for x in piece.column(text_column).to_pylist()]
                ids = bpe.encode(texts)
                offsets = pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int64).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                extra = [pa.array([len(i) // 4 for i in ids], pa.int64()), lists, pa.array([d == t.encode() for d, t in zip(bpe.decode(ids), texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *extra], names=[*piece.schema.names, "n_tokens", "token_ids", "round_trip"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, ids_column: str = "token_ids") -> DataFrame:
    """All columns, and decoded (replaced if there): the text of the ids (null ids give an empty text)."""
    path = path or default_path()
    tokens = tokens.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields), "decoded string"])

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            rows = [np.array(ids or [], dtype="<u4").tobytes() for ids in batch.column(ids_column).to_pylist()]
            out = [text_of(raw) for raw in bpe.decode(rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    path = path or default_path()
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for piece in K.pieces(batch):
                ids = bpe.encode([x or "" for x in piece.column("text").to_pylist()])
                cols = [[len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(text_of(raw).encode()).hexdigest() for raw in bpe.decode(ids)]]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
