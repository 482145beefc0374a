"""Substring deduplication: relative Lempel-Ziv factors of every document against all earlier ones.

A word goes when it lies in a window of ``WINDOW`` words whose word sequence also starts in a document with a smaller
id. Documents are dealt into pieces by a hash of their id, and the reference, all windows of all documents, is an
index in blocks by window hash. Pieces and blocks exchange packed messages:

1. Seeds. Of each window's ``WINDOW - SEED + 1`` runs of ``SEED`` words the one with the least hash is its seed, so equal
   windows have equal seeds and a document needs about one seed for five windows. A piece sends each of its
   different seeds once, as 6 bytes; a block answers with one bit for each: whether another document has it.
2. Index. A window whose seed is shared goes to its block as a 96-bit hash with the smallest id that the piece has
   for it; the block answers with one bit for each: whether the whole corpus has a smaller one.
3. Parse. A factor is the longest stretch from its first word on in which the reference holds every window. The parse
   goes through a document greedily: no factor at a word, on to the next word; else take the factor whole. As the
   index also answers for the windows across a factor's ends, factors of different sources that meet join up, and
   none of at least ``WINDOW`` words is missed. Factors are the duplicate spans.

A piece combines before it sends, so a passage in a third of all documents costs one entry for each piece and no
task gathers its documents. The documents are shuffled once: all three steps read the same exchange.

Defined cases: a null text has no words; fewer words than a window are never removed; a null id is never smaller
than another nor has a smaller one; rows that repeat an id don't remove each other's words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import load

WINDOW, SEED = 13, 6
#: Text bytes of a piece, and of what a block of the index is made from.
PIECE, BLOCK = 6 << 20, 24 << 20
NO_ID = np.iinfo(np.int64).max
MESSAGE = "block int, piece int, body binary"
ANSWER = "piece int, step int, block int, bits binary"


class Windows:
    """The windows of a piece's documents: where they start, whose they are, their seeds and hashes."""

    def __init__(self, table: pa.Table, window: int = WINDOW, seed: int = SEED):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.window = window
        self.table = table
        self.texts = [t for c in table.column("text").chunks for t in K.texts(c)]
        ids = table.column("doc_id")
        self.ids = np.array([NO_ID if i is None else i for i in ids.to_pylist()], dtype=np.int64)
        buf, offsets = K.flat(self.texts)
        starts, ends, self.by_doc = K.word_bounds(buf, offsets)
        h = K.word_hashes(buf, starts, ends - starts)
        self.words = len(h)
        self.at = np.flatnonzero(K.inside(self.by_doc, window, len(h)))
        low = K.grams(h, seed)
        n = max(0, len(h) - window + 1)
        least = low[:n].copy()
        for j in range(1, window - seed + 1):
            np.minimum(least, low[j : j + n], out=least)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.by_doc))
        self.doc = self.ids[doc[self.at]] if len(self.at) else np.zeros(0, dtype=np.int64)
        self.seed = least[self.at]
        self.key = K.grams(h, window)[self.at]
        self.key2 = (K.grams(K.mix(h + K.U(1)), window, 0xD6E8FEB86659FD93)[self.at] >> K.U(32)).astype(np.uint32)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different seeds as sorted 47-bit values, whether several of the piece's ids have them, and each window's."""
        short, inverse = np.unique(K.mix(self.seed) >> K.U(17), return_inverse=True)
        least, most = np.full(len(short), NO_ID), np.full(len(short), -NO_ID)
        np.minimum.at(least, inverse, self.doc)
        np.maximum.at(most, inverse, self.doc)
        return short, least < most, inverse

    def keys(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows in ``shared``: sorted different keys (two parts), their smallest id; positions, each one's key."""
        at = np.flatnonzero(shared)
        order = np.lexsort((self.key2[at], self.key[at]))
        k1, k2, doc = self.key[at][order], self.key2[at][order], self.doc[at][order]
        new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) if len(at) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(doc, first) if len(first) else doc
        inverse = np.empty(len(at), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        return k1[first], k2[first], least, at, inverse


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that what is alike in all values takes little room when compressed."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(body: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(body, dtype=np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def cuts(sorted_values: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """Offsets of the blocks' shares in sorted values of ``bits`` bits; blocks is a power of two."""
    shift = bits - (blocks.bit_length() - 1)
    return np.searchsorted(sorted_values >> K.U(shift), np.arange(blocks + 1, dtype=np.uint64)) if shift < 64 else np.array([0, len(sorted_values)])


def messages(piece: int, ends: np.ndarray, bodies) -> pa.Table:
    full = [b for b in range(len(ends) - 1) if ends[b + 1] > ends[b]]
    return pa.table({"block": pa.array(full, pa.int32()), "piece": pa.array([piece] * len(full), pa.int32()), "body": pa.array([bodies(ends[b], ends[b + 1]) for b in full], pa.binary())})


def received(answers: pa.Table, step: int, n: int, ends: np.ndarray) -> np.ndarray:
    """The answers' bits in the order in which the n entries were sent."""
    out = np.zeros(n, dtype=bool)
    for s, b, bits in zip(*(answers.column(c).to_pylist() for c in ("step", "block", "bits")), strict=True):
        if s == step:
            out[ends[b] : ends[b + 1]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=int(ends[b + 1] - ends[b]))
    return out


def answers(table: pa.Table, sizes: list[int], flags: np.ndarray, step: int) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = table.num_rows
    return pa.table({"piece": table.column("piece"), "step": pa.array([step] * n, pa.int32()), "block": table.column("block"), "bits": pa.array(bits, pa.binary())})


def hits(w: Windows, from_blocks: pa.Table, blocks: int) -> np.ndarray:
    """Starts of the windows that a document with a smaller id has too."""
    short, _, inverse = w.seeds()
    shared = received(from_blocks, 1, len(short), cuts(short, 47, blocks))[inverse]
    k1, _, least, at, inverse = w.keys(shared)
    earlier = received(from_blocks, 2, len(k1), cuts(k1, 64, blocks))
    return w.at[at[(earlier[inverse] | (w.doc[at] > least[inverse])) & (w.doc[at] != NO_ID)]]


def factors(starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(first word, end) of the greedy factors, from the sorted starts of the windows that the reference holds."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    new = np.append(True, starts[1:] > starts[:-1] + 1)
    return np.stack([starts[new], starts[np.append(new[1:], True)] + window], axis=1)


def parsed(docs: DataFrame, finish, schema: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed: int = SEED, piece_bytes: int = PIECE, block_bytes: int = BLOCK) -> DataFrame:
    """finish(windows, covered) for every piece; covered: which words lie in a factor."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pieces = max(1, -(-size // piece_bytes))
    blocks = 1 << max(0, (max(1, -(-size // block_bytes)) - 1).bit_length())
    piece = F.pmod(F.xxhash64(F.coalesce(F.col(id_column).cast("string"), text)), F.lit(pieces)).cast("int")
    dealt = docs.select(piece.alias("piece"), F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"))

    def own(table):
        return table.column("piece")[0].as_py()

    def send_seeds(table: pa.Table) -> pa.Table:
        short, several, _ = Windows(table, window, seed).seeds()
        entry = short << K.U(1) | several
        body = entry.view(np.uint8).reshape(-1, 8)[:, :6]
        return messages(own(table), cuts(short, 47, blocks), lambda a, b: body[a:b].tobytes())

    def match_seeds(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        raw = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, 6)
        entry = np.zeros((len(raw), 8), dtype=np.uint8)
        entry[:, :6] = raw
        entry = entry.view(np.uint64).ravel()
        _, inverse, often = np.unique(entry >> K.U(1), return_inverse=True, return_counts=True)
        shared = often > 1
        shared[inverse[(entry & K.U(1)) == 1]] = True
        return answers(table, [len(b) // 6 for b in bodies], shared[inverse], 1)

    def send_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "piece": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        w = Windows(left, window, seed)
        short, _, inverse = w.seeds()
        k1, k2, least, _, _ = w.keys(received(right, 1, len(short), cuts(short, 47, blocks))[inverse])
        return messages(own(left), cuts(k1, 64, blocks), lambda a, b: planes(k1[a:b]) + planes(k2[a:b]) + planes(least[a:b]))

    def match_keys(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        sizes = [len(b) // 20 for b in bodies]
        k1 = np.concatenate([unplanes(b[: 8 * n], np.uint64) for b, n in zip(bodies, sizes, strict=True)])
        k2 = np.concatenate([unplanes(b[8 * n : 12 * n], np.uint32) for b, n in zip(bodies, sizes, strict=True)])
        doc = np.concatenate([unplanes(b[12 * n :], np.int64) for b, n in zip(bodies, sizes, strict=True)])
        order = np.lexsort((doc, k2, k1))
        a, b = k1[order], k2[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
        earlier = np.empty(len(order), dtype=bool)
        earlier[order] = least < doc[order]
        return answers(table, sizes, earlier, 2)

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        w = Windows(left, window, seed) if left.num_rows else None
        if w is None:
            return finish(None, None)
        cover = np.zeros(w.words + 1, dtype=np.int32)
        for first, end in factors(hits(w, right, blocks), window):
            cover[first] += 1
            cover[end] -= 1
        return finish(w, np.cumsum(cover[:-1]) > 0)

    by_piece = dealt.groupBy("piece")
    first = by_piece.applyInArrow(send_seeds, MESSAGE).groupBy("block").applyInArrow(match_seeds, ANSWER)
    second = by_piece.cogroup(first.groupBy("piece")).applyInArrow(send_keys, MESSAGE).groupBy("block").applyInArrow(match_keys, ANSWER)
    return by_piece.cogroup(first.unionByName(second).groupBy("piece")).applyInArrow(parse, schema)


def label(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def finish(w, covered):
        if w is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[w.by_doc[1:]] - total[w.by_doc[:-1]]
        sha = [hashlib.sha256(k).hexdigest() for k in kept_texts(w, covered, removed)]
        return pa.table({"doc_id": w.table.column("doc_id"), "n_words": pa.array(np.diff(w.by_doc)), "n_removed": pa.array(removed), "kept_sha256": pa.array(sha, pa.string())})

    return parsed(docs, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", **options)


def kept_texts(w: Windows, covered: np.ndarray, removed: np.ndarray):
    for d, text in enumerate(w.texts):
        words = text.split()
        if removed[d]:
            words = compress(words, (~covered[w.by_doc[d] : w.by_doc[d + 1]]).tolist())
        yield b" ".join(words)


def strip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, kept_text, spans (first word and end of each removed stretch) of every row."""

    def finish(w, covered):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        if w is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "spans": pa.array([], kind)})
        total = np.concatenate([[0], np.cumsum(covered)])
        texts = [k.decode() for k in kept_texts(w, covered, total[w.by_doc[1:]] - total[w.by_doc[:-1]])]
        spans = []
        for a, b in zip(w.by_doc[:-1], w.by_doc[1:], strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b], [0]]).astype(np.int8)))
            spans.append([{"first": int(f), "end": int(e)} for f, e in edge.reshape(-1, 2)])
        return pa.table({"doc_id": w.table.column("doc_id"), "kept_text": pa.array(texts, pa.string()), "spans": pa.array(spans, kind)})

    return parsed(docs, finish, "doc_id bigint, kept_text string, spans array<struct<first:bigint,end:bigint>>", **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(load(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, ws[i:i + 12] AS g FROM (SELECT doc_id, ws, unnest(range(1, n - 11)) AS i FROM n WHERE n >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING count(*) > 1),
h AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.g = f.g WHERE f.first < g.doc_id),
r AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM h) GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(len(r.gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN r.gone IS NULL THEN n.ws ELSE list_filter(n.ws, lambda x, i: NOT list_contains(r.gone, i)) END, ' ')) AS kept_sha256
FROM n LEFT JOIN r ON n.doc_id = r.doc_id
"""
