"""Quality rules: base counts, and a linear-chain CRF that labels each line content or boilerplate.

Base rules fail a document with fewer than 20 words, or with over 30 % of its words in 8-word windows that the
text repeats. Of the rest, each line with a word gets a row of binned features; Viterbi decoding under the CRF marks
lines as content or boilerplate; a document is kept if at least half of its words are in content lines.

The CRF is fitted here by gradient ascent on the likelihood of line sequences of at most ``SAMPLE`` labelled
documents of each quality (chosen by a hash of the id, so the same at any partitioning); lines take the quality of
their document as label. Only bin numbers of the sample's lines reach the driver. With no labels of one kind
there is no model, and the base rules alone decide.

Defined cases: null text counts as empty, so it has no words and fails; lines without a word are not labelled;
ties in decoding go to content; rows are independent, so repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import load

#: Labelled documents of each quality that the model is fitted on, at most.
SAMPLE = 600
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
KEEP_SHARE = 0.5

_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BLACK_POINT = np.array([((c & 0xC0) != 0x80) and not K.WHITE[c] for c in range(256)], dtype=np.int32)
_UPPER = np.array([65 <= c <= 90 for c in range(256)], dtype=np.int32)
_DIGIT = np.array([48 <= c <= 57 for c in range(256)], dtype=np.int32)
_SHOUT = np.array([c in b"!?" for c in range(256)], dtype=np.int32)

#: Upper edges of each line feature's bins.
EDGES = {
    "words": [1, 2, 4, 8, 16, 32],
    "symbols": [0.0, 0.01, 0.03, 0.08, 0.2],
    "upper": [0.05, 0.2, 0.5],
    "shouts": [0.0, 0.02, 0.08],
    "distinct": [0.3, 0.5, 0.7, 0.9],
    "word bytes": [2.5, 4.0, 5.5, 7.0, 10.0],
    "digits": [0.02, 0.1, 0.3],
    "seen before": [0.5],
}
SIZES = [len(e) + 1 for e in EDGES.values()]
BASES = np.cumsum([0, *SIZES[:-1]])
N_FEATURES = sum(SIZES)


def repeated_words(h: np.ndarray, by_part: np.ndarray) -> np.ndarray:
    """For each part, its words that lie in a window found twice or more in that part."""
    n_parts = len(by_part) - 1
    w = K.grams(h, WINDOW)
    own = np.flatnonzero(K.inside(by_part, WINDOW, len(h)))
    if not len(own):
        return np.zeros(n_parts, dtype=np.int64)
    part = np.repeat(np.arange(n_parts, dtype=np.uint64), np.diff(by_part))[own]
    key = w[own] ^ K.mix(part + K.U(1))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(n_parts, dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = own[twice[at] == key]
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return total[by_part[1:]] - total[by_part[:-1]]


def _sums(table: np.ndarray, buf: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(table[buf[:n]], out=out[1:])
    return out


def analyse(parts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts by document; and of all lines with a word: bins (lines x features), words, offsets by document."""
    buf, offsets = K.flat(parts)
    n = int(offsets[-1])
    starts, ends, by_part = K.word_bounds(buf, offsets)
    h = K.word_hashes(buf, starts, ends - starts)
    over = lambda table: (s := _sums(table, buf, n))[offsets[1:]] - s[offsets[:-1]]
    counts = {"n_words": np.diff(by_part), "word_chars": over(_BLACK_POINT), "n_symbols": over(_SYMBOL)}
    # Lines, without those that hold no word.
    breaks = np.flatnonzero(buf[:n] == 10) + 1
    line_at = np.unique(np.concatenate([offsets[:-1], breaks[breaks < n]])) if n else np.zeros(0, dtype=np.int64)
    line_of = np.searchsorted(line_at, starts, side="right") - 1
    lines, first, line_words = np.unique(line_of, return_index=True, return_counts=True)
    begin = line_at[lines]
    stop = np.append(line_at, n)[lines + 1]
    stop = stop - ((buf[stop - 1] == 10) & (stop > begin))
    by_doc = np.searchsorted(begin, offsets)
    by_doc[-1] = len(lines)
    repeats, seen = np.zeros(len(parts), dtype=np.int64), np.zeros(len(lines))
    raw = buf.tobytes()
    for d in range(len(parts)):
        known: set[bytes] = set()
        for k in range(by_doc[d], by_doc[d + 1]):
            line = raw[begin[k] : stop[k]]
            if line in known:
                seen[k] = 1
                repeats[d] += 1
            known.add(line)
    counts |= {"n_dup_lines": repeats, "n_repeat_words": repeated_words(h, by_part)}
    size = np.maximum(stop - begin, 1)
    share = lambda table: ((s := _sums(table, buf, n))[stop] - s[begin]) / size
    if len(lines):
        key = np.sort((h >> K.U(24)) ^ (np.repeat(np.arange(len(lines), dtype=np.uint64), line_words) << K.U(40)))
        fresh = np.append(True, key[1:] != key[:-1])
        distinct = np.bincount((key >> K.U(40)).astype(np.int64), weights=fresh, minlength=len(lines)) / line_words
        spans = np.concatenate([[0], np.cumsum(ends - starts)])
        mean = (spans[first + line_words] - spans[first]) / line_words
    else:
        distinct = mean = np.zeros(0)
    values = [line_words, share(_SYMBOL), share(_UPPER), share(_SHOUT), distinct, mean, share(_DIGIT), seen]
    bins = np.stack([np.searchsorted(e, v, side="left") + b for e, v, b in zip(EDGES.values(), values, BASES, strict=True)], axis=1) if len(lines) else np.zeros((0, len(SIZES)), dtype=np.int64)
    return counts, bins, line_words, by_doc


# -- the CRF; label 1 is content --------------------------------------------------------------------------------


class LineModel:
    """weights: emission score of content over boilerplate by feature bin; moves[i, j]: score of label j after i."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1)

    def decode(self, bins: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
        """The most likely labels of all lines, document by document."""
        e, labels = self.emissions(bins), np.ones(len(bins), dtype=np.int8)
        lens = np.diff(by_doc)
        order = np.argsort(-lens, kind="stable")
        at, lens = by_doc[:-1][order], lens[order]
        back = np.zeros((len(bins), 2), dtype=np.int8)
        score = np.zeros((len(lens), 2))
        for k in range(int(lens[0]) if len(lens) else 0):
            m = int(np.searchsorted(-lens, -k, side="left"))
            i = at[:m] + k
            if k == 0:
                score[:m] = self.start
            else:
                s0, s1 = score[:m, :1] + self.moves[:1], score[:m, 1:] + self.moves[1:]
                back[i] = s1 >= s0
                score[:m] = np.maximum(s0, s1)
            score[:m, 1] += e[i]
        has = lens > 0
        now = np.zeros(len(lens), dtype=np.int8)
        now[has] = score[has, 1] >= score[has, 0]
        for k in range(int(lens[0]) - 1 if len(lens) else -1, -1, -1):
            m = int(np.searchsorted(-lens, -k, side="left"))
            i = at[:m] + k
            labels[i] = now[:m]
            now[:m] = back[i, now[:m]]
        return labels


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def fit(bins: np.ndarray, by_doc: np.ndarray, good: np.ndarray, rounds: int = 60, rate: float = 0.2, decay: float = 0.01) -> LineModel:
    """Gradient ascent (Adam) on the mean log-likelihood of the documents' line labels."""
    lens = np.diff(by_doc)
    keep = np.flatnonzero(lens > 0)
    order = keep[np.argsort(-lens[keep], kind="stable")]
    at, lens, y = by_doc[:-1][order], lens[order], good[order].astype(np.int64)
    theta = np.zeros(N_FEATURES + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    docs, longest = len(order), int(lens[0])
    live = [int(np.searchsorted(-lens, -k, side="left")) for k in range(longest)]
    truth = np.zeros_like(theta)
    for d in range(docs):
        rows = bins[at[d] : at[d] + lens[d]]
        if y[d]:
            np.add.at(truth, rows.ravel(), 1)
        truth[N_FEATURES + 3 * y[d]] += lens[d] - 1
        truth[N_FEATURES + 4 + y[d]] += 1
    for step in range(1, rounds + 1):
        w, moves, start = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :]
        e = w[bins].sum(axis=1)
        alpha, beta = np.zeros((len(bins), 2)), np.zeros((len(bins), 2))
        for k in range(longest):
            i = at[: live[k]] + k
            alpha[i] = start if k == 0 else _logsum(alpha[i - 1][:, :, None] + moves, 1)
            alpha[i, 1] += e[i]
        last = at + lens - 1
        total = _logsum(alpha[last], 1)
        expect = np.zeros_like(theta)
        for k in range(longest - 1, -1, -1):
            i = at[: live[k]] + k
            if k + 1 < longest and live[k + 1]:
                j = at[: live[k + 1]] + k + 1
                step_on = beta[j] + np.stack([np.zeros(len(j)), e[j]], axis=1)
                both = moves + step_on[:, None, :]
                beta[j - 1] = _logsum(both, 2)
                expect[N_FEATURES : N_FEATURES + 4] += np.exp(alpha[j - 1][:, :, None] + both - total[: live[k + 1], None, None]).sum(axis=0).ravel()
            p = np.exp(alpha[i] + beta[i] - total[: live[k], None])
            np.add.at(expect, bins[i], p[:, 1:])
            if k == 0:
                expect[N_FEATURES + 4 :] += p.sum(axis=0)
        g = (truth - expect) / docs - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return LineModel(theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineModel | None:
    """The model of at most ``sample`` labelled documents of each quality; None if one kind is missing."""
    # Both limits are sorts of two small columns that keep their first rows; the text joins afterwards.
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.withColumn("_at", F.xxhash64("doc_id"))
    chosen = [marks.filter(F.col("quality") == q).orderBy("_at", "doc_id").limit(sample) for q in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]).select(F.col("doc_id").alias("_id"), "quality"))

    def run(batches):
        for batch in batches:
            for piece in K.pieces(batch):
                _, bins, _, by_doc = analyse(K.texts(piece.column("text")))
                codes = [pa.scalar(bins[by_doc[d] : by_doc[d + 1]].astype(np.uint8).tobytes(), pa.binary()) for d in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([piece.column("quality"), pa.array([c.as_py() for c in codes], pa.binary())], names=["quality", "bins"])

    rows = docs.select("doc_id", "text").join(picked, docs["doc_id"] == picked["_id"]).select("_id", "quality", "text")
    found = rows.mapInArrow(run, "quality int, bins binary").collect()
    found = sorted((r["quality"], bytes(r["bins"])) for r in found if r["bins"])
    if len({q for q, _ in found}) < 2:
        return None
    by_doc = np.cumsum([0, *(len(b) // len(SIZES) for _, b in found)])
    bins = np.frombuffer(b"".join(b for _, b in found), dtype=np.uint8).reshape(-1, len(SIZES)).astype(np.int64)
    return fit(bins, by_doc, np.array([q for q, _ in found]))


def model_for(spark: SparkSession, sf_dir: str) -> LineModel | None:
    return train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def verdicts(parts: list[bytes], model: LineModel | None) -> dict[str, np.ndarray]:
    counts, bins, line_words, by_doc = analyse(parts)
    counts["base_failed"] = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])
    labels = model.decode(bins, by_doc) if model else np.ones(len(bins), dtype=np.int8)
    content = np.concatenate([[0], np.cumsum(line_words * labels)])
    counts["content_words"] = content[by_doc[1:]] - content[by_doc[:-1]]
    counts["kept"] = ~counts["base_failed"] & (counts["content_words"] >= KEEP_SHARE * counts["n_words"])
    return counts


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"]


def judge(docs: DataFrame, model: LineModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_words of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'bigint'}" for c in OUT)

    def run(batches):
        for batch in batches:
            for piece in K.pieces(batch):
                found = verdicts(K.texts(piece.column("text")), model)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(found[c] if c in ("base_failed", "kept") else found[c].astype(np.int64)) for c in OUT)], names=["doc_id", *OUT])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: LineModel | None, text_column: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for piece in K.pieces(batch, text_column):
                yield piece.filter(pa.array(verdicts(K.texts(piece.column(text_column)), model)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), model_for(spark, sf_dir))
