"""Line deduplication by deletion neighbourhoods.

Lines are sequences of words. A line goes when an earlier one, in the order of (doc_id, line number), is equal to it,
or when both have ``MIN_WORDS`` words or more and one word inserted, deleted or replaced makes them equal. Lines without
a word always stay. Documents are dealt into pieces by a hash of their id, and pieces exchange packed messages with
blocks of hashed keys:

1. Halves. Lines one edit apart share their first or their last half (of the longer line's length), so each different
   line sends four short keys and learns whether a different line has one of them. Others have no near line.
2. Neighbourhoods. Every different line sends its whole hash. Those with a possible neighbour also send each deletion
   variant twice: as it is, to meet lines that are one word shorter, and together with the place of the deletion, to
   meet lines with another word at that place. Equal keys of these kinds mean at most one edit exactly, so the
   edit distance is verified by the kind of key that met, with 96 bits against chance, and no pairs are formed: for
   each key a block keeps the earliest line of each kind and answers with it.
3. Each piece drops the lines that have an earlier partner among the answers.

A piece sends a key once, with the earliest of its own lines, so a line or a template in a third of all documents
costs one entry for each piece. Documents are shuffled once; all steps read the same exchange.

Defined cases: a null text has one empty line, which stays; a null id comes after all others; repeated rows have
equal places, and the lines of such rows don't remove each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import load
from .substring_dedup import ANSWER, MESSAGE, NO_ID, cuts, messages, planes, unplanes

MIN_WORDS = 5
PIECE, BLOCK = 6 << 20, 24 << 20
WHOLE, SHORTER, PLACED = 0, 1, 2
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NEVER = np.iinfo(np.int64).max


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n, base, dtype=np.uint64))
    return out


class Lines:
    """The lines of a piece; ``u_``: its different lines, each at its earliest place."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.table = table
        self.texts = [t for c in table.column("text").chunks for t in K.texts(c)]
        ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], dtype=np.int64)
        parts = [t.split(b"\n") for t in self.texts]
        self.split = parts
        buf, offsets = K.flat([line for p in parts for line in p])
        starts, ends, by_line = K.word_bounds(buf, offsets)
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.line_doc, self.line_no = np.repeat(ids, counts), K.spread(counts)
        self.ends = np.cumsum(counts)
        self.n = np.diff(by_line)
        w = K.word_hashes(buf, starts, ends - starts)
        within = K.spread(self.n)
        longest = int(self.n.max()) if len(self.n) else 0
        self.hashes = []
        with np.errstate(over="ignore"):
            for k, base in enumerate(BASES):
                base |= 1
                up, down = powers(base, longest + 2), powers(pow(base, -1, 1 << 64), longest + 2)
                value = K.mix(w + K.U(k)) if k else w
                sums = np.concatenate([[K.U(0)], np.cumsum(value * up[within])])
                self.hashes.append((sums, up, down))
        self.begin = by_line[:-1]
        lines = np.flatnonzero(self.n > 0)
        k1, k2 = self.runs(lines, np.zeros(len(lines), np.int64), self.n[lines], self.n[lines])
        order = np.lexsort((self.line_no[lines], self.line_doc[lines], k2, k1))
        new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])) if len(lines) else np.zeros(0, bool)
        self.u = lines[order[new]]
        self.u_k1, self.u_k2 = k1[order[new]], k2[order[new]]
        self.u_doc, self.u_no = self.line_doc[self.u], self.line_no[self.u]
        self.lines, self.which = lines, np.empty(len(lines), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1

    def _raw(self, k: int, line, a, b):
        """Unscrambled hash of words a to b of lines."""
        sums, _, down = self.hashes[k]
        at = self.begin[line]
        with np.errstate(over="ignore"):
            return (sums[at + b] - sums[at + a]) * down[a]

    def runs(self, line, a, b, tag):
        """96 bits of the words a to b of lines, with a number that must agree too."""
        with np.errstate(over="ignore"):
            t = K.mix(np.asarray(tag).astype(np.uint64))
            return K.mix(self._raw(0, line, a, b) ^ t), (K.mix(self._raw(1, line, a, b) + t) >> K.U(32)).astype(np.uint32)

    def variants(self, line, i):
        """Hash of lines without word i, comparable with that of whole lines."""
        out = []
        with np.errstate(over="ignore"):
            t = K.mix((self.n[line] - 1).astype(np.uint64))
            for k in (0, 1):
                raw = self._raw(k, line, np.zeros_like(i), i) + self._raw(k, line, i + 1, self.n[line]) * self.hashes[k][1][i]
                out.append(K.mix(raw + t) if k else K.mix(raw ^ t))
        return out[0], (out[1] >> K.U(32)).astype(np.uint32)

    def halves(self):
        """Sorted (47-bit key, 32 bits of the line), and the different line of each."""
        own = np.flatnonzero(self.n[self.u] >= MIN_WORDS)
        line = self.u[own]
        n = self.n[line]
        keys = []
        for of in (n, n + 1):
            h = of // 2
            keys.append(self.runs(line, np.zeros_like(n), h, 2 * of)[0])
            keys.append(self.runs(line, n - (of - h), n, 2 * of + 1)[0])
        key, owner = np.concatenate(keys) >> K.U(17), np.tile(own, 4)
        order = np.lexsort((self.u_k2[owner], key))
        return key[order], self.u_k2[owner][order], owner[order]

    def entries(self, near: np.ndarray):
        """Different (key, kind), sorted, each with its earliest line; and of all uses: the line and the entry."""
        near = np.flatnonzero(near & (self.n[self.u] >= MIN_WORDS))
        line = np.repeat(self.u[near], self.n[self.u[near]])
        i = K.spread(self.n[self.u[near]])
        v1, v2 = self.variants(line, i)
        with np.errstate(over="ignore"):
            place = K.mix(i.astype(np.uint64) + K.U(0x51ED270B7A9F3C11))
            p1 = K.mix(v1 ^ place)
        owner = np.repeat(near, self.n[self.u[near]])
        # A shorter line must have enough words itself to be met.
        meets = self.n[self.u[owner]] > MIN_WORDS
        k1 = np.concatenate([self.u_k1, v1[meets], p1])
        k2 = np.concatenate([self.u_k2, v2[meets], v2])
        kind = np.repeat(np.array([WHOLE, SHORTER, PLACED], dtype=np.uint8), [len(self.u), int(meets.sum()), len(p1)])
        owner = np.concatenate([np.arange(len(self.u)), owner[meets], owner])
        order = np.lexsort((self.u_no[owner], self.u_doc[owner], kind, k2, k1))
        a, b, c = k1[order], k2[order], kind[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
        first = order[new]
        return k1[first], k2[first], kind[first], self.u_doc[owner[first]], self.u_no[owner[first]], owner[order], np.cumsum(new) - 1


def earliest(k1, k2, kind, doc, no):
    """For each entry the earliest line (doc, number) that it can be a copy of; NEVER where there is none.

    A whole line asks for equal lines and for longer ones without a word; such a longer one for whole lines; a line
    with a place for others with the same place.
    """
    order = np.lexsort((no, doc, k2, k1))
    a, b = k1[order], k2[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(order) else np.zeros(0, np.int64)
    group = np.zeros(len(order), dtype=np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    best_doc, best_no = np.full((3, len(first)), NEVER), np.full((3, len(first)), NEVER)
    for k in (WHOLE, SHORTER, PLACED):
        of = np.flatnonzero(kind[order] == k)
        g, at = np.unique(group[of], return_index=True)
        best_doc[k, g], best_no[k, g] = doc[order[of[at]]], no[order[of[at]]]
    longer = (best_doc[SHORTER] < best_doc[WHOLE]) | ((best_doc[SHORTER] == best_doc[WHOLE]) & (best_no[SHORTER] < best_no[WHOLE]))
    ask_doc = np.stack([np.where(longer, best_doc[SHORTER], best_doc[WHOLE]), best_doc[WHOLE], best_doc[PLACED]])
    ask_no = np.stack([np.where(longer, best_no[SHORTER], best_no[WHOLE]), best_no[WHOLE], best_no[PLACED]])
    out_doc, out_no = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    out_doc[order], out_no[order] = ask_doc[kind[order], group], ask_no[kind[order], group]
    return out_doc, out_no


def body_of(k1, k2, kind, doc, no) -> bytes:
    return planes(k1) + planes(k2) + kind.tobytes() + planes(doc) + planes(no.astype(np.uint32))


def body_to(body: bytes):
    n = len(body) // 25
    return unplanes(body[: 8 * n], np.uint64), unplanes(body[8 * n : 12 * n], np.uint32), np.frombuffer(body[12 * n : 13 * n], np.uint8), unplanes(body[13 * n : 21 * n], np.int64), unplanes(body[21 * n :], np.uint32).astype(np.int64)


def near_lines(w: Lines, table: pa.Table, blocks: int) -> np.ndarray:
    key, _, owner = w.halves()
    flags = np.zeros(len(key), dtype=bool)
    ends = cuts(key, 47, blocks)
    for s, b, bits in zip(*(table.column(c).to_pylist() for c in ("step", "block", "bits")), strict=True):
        if s == 1:
            flags[ends[b] : ends[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(ends[b + 1] - ends[b]))
    near = np.zeros(len(w.u), dtype=bool)
    near[owner[flags]] = True
    return near


def dropped(w: Lines, table: pa.Table, blocks: int) -> np.ndarray:
    """Which lines of the piece go."""
    k1, k2, kind, doc, no, owner, entry = w.entries(near_lines(w, table, blocks))
    from_doc, from_no = earliest(k1, k2, kind, doc, no)
    ends = cuts(k1, 64, blocks)
    for s, b, bits in zip(*(table.column(c).to_pylist() for c in ("step", "block", "bits")), strict=True):
        if s == 2:
            n = int(ends[b + 1] - ends[b])
            head = -(-n // 8)
            has = np.flatnonzero(np.unpackbits(np.frombuffer(bits[:head], np.uint8), count=n)) + ends[b]
            m = len(has)
            d, o = unplanes(bits[head : head + 8 * m], np.int64), unplanes(bits[head + 8 * m :], np.uint32).astype(np.int64)
            better = (d < from_doc[has]) | ((d == from_doc[has]) & (o < from_no[has]))
            from_doc[has[better]], from_no[has[better]] = d[better], o[better]
    d, o = from_doc[entry], from_no[entry]
    gone = np.zeros(len(w.u), dtype=bool)
    gone[owner[(d < w.u_doc[owner]) | ((d == w.u_doc[owner]) & (o < w.u_no[owner]))]] = True
    # Later places of a line in the piece are copies of its first one.
    first = w.which
    later = (w.line_doc[w.lines] > w.u_doc[first]) | (w.line_no[w.lines] > w.u_no[first])
    out = np.zeros(len(w.n), dtype=bool)
    out[w.lines] = gone[first] | later
    return out


def judged(docs: DataFrame, finish, schema: str, id_column: str = "doc_id", text_column: str = "text", piece_bytes: int = PIECE, block_bytes: int = BLOCK) -> DataFrame:
    """finish(lines, gone) for every piece."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pieces = max(1, -(-size // piece_bytes))
    blocks = 1 << max(0, (max(1, -(-size // block_bytes)) - 1).bit_length())
    piece = F.pmod(F.xxhash64(F.coalesce(F.col(id_column).cast("string"), text)), F.lit(pieces)).cast("int")
    dealt = docs.select(piece.alias("piece"), F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"))

    def own(table):
        return table.column("piece")[0].as_py()

    def send_halves(table: pa.Table) -> pa.Table:
        key, mark, _ = Lines(table).halves()
        body = np.concatenate([key.view(np.uint8).reshape(-1, 8)[:, :6], mark.view(np.uint8).reshape(-1, 4)], axis=1)
        return messages(own(table), cuts(key, 47, blocks), lambda a, b: body[a:b].tobytes())

    def match_halves(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        raw = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, 10)
        key = np.zeros((len(raw), 8), dtype=np.uint8)
        key[:, :6] = raw[:, :6]
        key, mark = key.view(np.uint64).ravel(), raw[:, 6:].copy().view(np.uint32).ravel()
        _, inverse = np.unique(key, return_inverse=True)
        low, high = np.full(len(raw), 0xFFFFFFFF, np.uint32), np.zeros(len(raw), np.uint32)
        np.minimum.at(low, inverse, mark)
        np.maximum.at(high, inverse, mark)
        flags = (low < high)[inverse]
        ends = np.cumsum([0, *(len(b) // 10 for b in bodies)])
        return reply(table, [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], 1)

    def reply(table: pa.Table, bits: list[bytes], step: int) -> pa.Table:
        return pa.table({"piece": table.column("piece"), "step": pa.array([step] * len(bits), pa.int32()), "block": table.column("block"), "bits": pa.array(bits, pa.binary())})

    def send_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "piece": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        w = Lines(left)
        rows = w.entries(near_lines(w, right, blocks))[:5]
        return messages(own(left), cuts(rows[0], 64, blocks), lambda a, b: body_of(*(r[a:b] for r in rows)))

    def match_keys(table: pa.Table) -> pa.Table:
        each = [body_to(b) for b in table.column("body").to_pylist()]
        k1, k2, kind, doc, no = (np.concatenate([e[i] for e in each]) for i in range(5))
        from_doc, from_no = earliest(k1, k2, kind, doc, no)
        # Only answers that can tell a piece something: an earlier line, or for a longer line any whole one.
        tells = (from_doc < doc) | ((from_doc == doc) & (from_no < no)) | ((kind == SHORTER) & (from_doc < NEVER))
        bits, at = [], 0
        for e in each:
            to = at + len(e[0])
            has = np.flatnonzero(tells[at:to]) + at
            bits.append(np.packbits(tells[at:to]).tobytes() + planes(from_doc[has]) + planes(from_no[has].astype(np.uint32)))
            at = to
        return reply(table, bits, 2)

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return finish(None, None)
        w = Lines(left)
        return finish(w, dropped(w, right, blocks))

    by_piece = dealt.groupBy("piece")
    first = by_piece.applyInArrow(send_halves, MESSAGE).groupBy("block").applyInArrow(match_halves, ANSWER)
    second = by_piece.cogroup(first.groupBy("piece")).applyInArrow(send_keys, MESSAGE).groupBy("block").applyInArrow(match_keys, ANSWER)
    return by_piece.cogroup(first.unionByName(second).groupBy("piece")).applyInArrow(decide, schema)


def kept_texts(w: Lines, gone: np.ndarray):
    for d, lines in enumerate(w.split):
        to = w.ends[d]
        flags = gone[to - len(lines) : to]
        yield b"\n".join(line for line, g in zip(lines, flags.tolist(), strict=True) if not g)


def label(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 of every row."""

    def finish(w, gone):
        if w is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_lines": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        begin = np.append(0, w.ends[:-1])
        count = lambda flags: (c := np.append(0, np.cumsum(flags)))[w.ends] - c[begin]
        sha = [hashlib.sha256(k).hexdigest() for k in kept_texts(w, gone)]
        return pa.table({"doc_id": w.table.column("doc_id"), "n_lines": pa.array(count(w.n > 0)), "n_removed": pa.array(count(gone)), "kept_sha256": pa.array(sha, pa.string())})

    return judged(docs, finish, "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string", **options)


def strip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, kept_text of every row."""

    def finish(w, gone):
        if w is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        return pa.table({"doc_id": w.table.column("doc_id"), "kept_text": pa.array([k.decode() for k in kept_texts(w, gone)], pa.string())})

    return judged(docs, finish, "doc_id bigint, kept_text string", **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(load(spark, sf_dir, "documents"))
