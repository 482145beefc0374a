"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Fingerprints are 64 bits over XXH64 hashes of word shingles. Two fingerprints link when they differ in at most
``max_bits`` bits. The search works on distinct fingerprints only, so copies cost one row:

1. Bit co-occurrence counts over all distinct fingerprints (a 64 x 64 matrix) give correlations; correlated bits
   go into the same part, so that the parts are as independent as they can be.
2. Candidate counts per part and threshold are estimated from the exact histogram of part values; dynamic
   programming picks the number of parts and unequal thresholds T with sum(T) >= max_bits - parts + 1. A part with
   threshold -1 is left out. Thresholds are even: two fingerprints within T bits on a part meet at a value that is within
   T / 2 of both, so both sides probe balls of half the radius, and a probe row is the same for either side.
3. Fingerprints that probe the same value meet in one group, where the whole distance is verified. A small group gives
   all its links; in one of over ``FEW`` members each member is compared with those not reached yet, which gives links enough
   to join what is within reach, no more than members, and never all pairs.
4. Values that over ``crowd`` fingerprints probe don't go into one task. Their members are first linked to a few pivots of the
   value; then only members outside a value's most frequent component are joined with the value's members, and only across
   components. These joins read written rows, so that Spark can split a value that holds most of them.
5. Links become components by alternating large-star and small-star steps over tables; nothing is collected.

Defined cases: null and wordless texts have fingerprint zero and link to each other; fewer words than a shingle
form one shingle; repeated rows share a component; a component whose ids are all null has a null id; :func:`keep_one` never drops
a row without an id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut, load, without

BITS = 64
#: Members of a group of which all pairs are compared; fingerprints that probe one value in one task; rows that a worker gathers before it compares.
FEW, CROWD, GATHER = 16, 20_000, 1 << 18
#: Members of a group that are compared at once, as a square.
SQUARE = 512
#: Pivots of a crowded value.
PIVOTS = 8
#: Largest threshold of a part: its probes are a ball of half that radius.
MAX_THRESHOLD = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints_of(parts: list[bytes], words_per_shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each UTF-8 text."""
    normal = [b" ".join(p.translate(_LOWER).split()) for p in parts]
    buf, offsets = K.flat(normal)
    starts, ends, by_part = K.word_bounds(buf, offsets)
    words = np.diff(by_part)
    counts = np.where(words == 0, 0, np.maximum(1, words - words_per_shingle + 1))
    first = np.repeat(by_part[:-1], counts) + K.spread(counts)
    last = np.minimum(first + words_per_shingle, np.repeat(by_part[1:], counts)) - 1
    h = K.xxh64(buf, starts[first], ends[last] - starts[first])
    ones = bit_counts(h, counts)
    bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each consecutive run of ``counts`` hashes.

    Eight byte-wide counters share one word, so runs are cut into chunks of 255 that cannot overflow.
    """
    out = np.zeros((len(counts), BITS), dtype=np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    chunks = -(-counts[full] // 255)
    begin = np.cumsum(counts[full]) - counts[full]
    at = np.repeat(begin, chunks) + 255 * K.spread(chunks)
    groups = np.cumsum(chunks) - chunks
    sums = np.empty((len(full), BITS), dtype=np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> K.U(s)) & K.U(0x0101010101010101), at)
        sums[:, s::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
    out[full] = sums
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """_id, fp (bigint with the fingerprint's bits) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in K.pieces(batch):
                fp = fingerprints_of(K.texts(piece.column("text")), words_per_shingle)
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(fp.view(np.int64))], names=["_id", "fp"])

    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).mapInArrow(run, f"_id {kind}, fp bigint")


# -- planning ---------------------------------------------------------------------------------------------------


def bit_statistics(points: DataFrame) -> tuple[np.ndarray, float]:
    """Correlation matrix of the 64 bits over all rows, and the row count; 4096 sums reach the driver."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(fp)
        cell = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    sums = np.zeros(BITS * BITS + 1)
    for row in points.select("fp").mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[row["cell"]] = row["n"]
    n = max(sums[-1], 1.0)
    both = sums[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd)), n


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal size; each grows from a seed by the bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        seed = max(sorted(free), key=lambda b: sum(correlation[b, c] for c in free if c != b))
        part = [seed]
        free.discard(seed)
        while len(part) < size:
            best = max(sorted(free), key=lambda b: sum(correlation[b, c] for c in part))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    """Signed 64-bit value with these bits set."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def ball(part: list[int], radius: int) -> list[int]:
    """Masks of up to ``radius`` bits of a part."""
    out = [()]
    layer = [()]
    for _ in range(max(0, radius)):
        layer = [(*m, b) for m in layer for b in part if not m or b > m[-1]]
        out += layer
    return [mask_of(m) for m in out]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """One threshold of each part's (threshold: cost) that sum to total or more at the least cost."""
    best = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, extra in options.items():
                if s + t not in step or cost + extra < step[s + t][0]:
                    step[s + t] = (cost + extra, [*chosen, t])
        best = step
    return min(found for s, found in best.items() if s >= total)


def plan(points: DataFrame, max_bits: int, part_counts=(2, 3, 4), probe_cost: float = 100.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is used. probe_cost: a probe row's cost in compared pairs."""
    correlation, n = bit_statistics(points)
    options = {m: group_bits(correlation, m) for m in part_counts}
    keys = [F.struct(F.lit(m * 100 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("value")) for m, parts in options.items() for i, bits in enumerate(parts)]
    histogram = points.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.part", "k.value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    squares = {r["part"]: r["s"] for r in histogram.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}
    ranked = []
    for m, parts in options.items():
        costs = []
        for i, bits in enumerate(parts):
            found = {-1: 0.0}
            for t in range(0, min(max_bits, MAX_THRESHOLD) + 1, 2):
                probes = sum(math.comb(len(bits), r) for r in range(t // 2 + 1))
                found[t] = probe_cost * n * probes + squares.get(m * 100 + i, 0.0) * probes * probes / 2
            costs.append(found)
        if sum(max(c) for c in costs) >= max_bits - m + 1:
            cost, chosen = allocate(costs, max_bits - m + 1)
            ranked.append((cost, m, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0]))
    if not ranked:
        raise ValueError(f"no plan for {max_bits} bits in {part_counts} parts")
    return min(ranked)[2]


# -- linking ----------------------------------------------------------------------------------------------------


def keyed(points: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp: a hash of each part and value that a fingerprint probes. Keys that clash only bring more to verify."""

    def probes(i: int, bits: list[int], t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        return F.transform(F.array(*[F.lit(m) for m in ball(bits, t // 2)]), lambda m: F.xxhash64(F.lit(i), own.bitwiseXOR(m)))

    return points.select(F.explode(F.concat(*[probes(i, bits, t) for i, (bits, t) in enumerate(parts)])).alias("key"), "fp")


def spanning(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one group: each member reaches what no earlier one has reached.

    Where a group is small enough to compare at once and has no more links than members, it gives all of them.
    """
    if len(fp) <= SQUARE:
        near = np.bitwise_count(fp[:, None] ^ fp) <= max_bits
        if np.count_nonzero(near) <= 3 * len(fp):
            x, y = np.nonzero(np.triu(near, 1))
            return fp[x], fp[y]
    left, ends = np.arange(1, len(fp)), []
    waiting = [0]
    while len(left):
        if not waiting:
            waiting.append(int(left[0]))
            left = left[1:]
            continue
        at = waiting.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
        if near.any():
            reached = left[near]
            left = left[~near]
            ends.append((np.full(len(reached), fp[at]), fp[reached]))
            waiting += reached.tolist()
    return tuple(np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (fp[:0], fp[:0])


def group_links(key: np.ndarray, fp: np.ndarray, max_bits: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Links a < b inside groups of equal keys; rows come sorted by key."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [fp[:0]], [fp[:0]]
    for k in np.unique(sizes[(sizes > 1) & (sizes <= few)]).tolist():
        rows = fp[starts[sizes == k][:, None] + np.arange(k)]
        for j in range(1, k):
            near = np.bitwise_count(rows[:, j:] ^ rows[:, :-j]) <= max_bits
            a.append(rows[:, :-j][near])
            b.append(rows[:, j:][near])
    for at, k in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
        x, y = spanning(fp[at : at + k], max_bits)
        a.append(x)
        b.append(y)
    x, y = (np.concatenate(v).view(np.int64) for v in (a, b))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def links(points: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """a, b with a < b: links between distinct fingerprints, enough of them to join what is within reach."""
    rows = keyed(points, plan(points, max_bits))
    crowded = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("key"))
    crowds = not crowded.isEmpty()
    calm = rows.join(crowded, "key", "left_anti") if crowds else rows

    def run(batches):
        keys, fps, n = [], [], 0

        def compare(to: int):
            key, fp = np.concatenate(keys), np.concatenate(fps)
            a, b = group_links(key[:to], fp[:to].view(np.uint64), max_bits)
            keys[:], fps[:] = [key[to:]], [fp[to:]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= GATHER:  # all groups but the last one, which may go on
                to = n - int((np.concatenate(keys)[::-1] == keys[-1][-1]).argmin() or n)
                if to > 0:
                    yield compare(to)
                    n -= to
        if n:
            yield compare(n)

    found = calm.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()
    return crowd_links(cut(found), cut(rows.join(crowded, "key", "left_semi")), max_bits) if crowds else found


def crowd_links(found: DataFrame, members: DataFrame, max_bits: int) -> DataFrame:
    """The links found so far, and those inside crowded values (members: key, fp) that join more."""
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    firsts = F.array(*[F.min_by("fp", F.struct(F.xxhash64(F.lit(s), "fp"), "fp")) for s in range(PIVOTS)])
    pivots = cut(members.groupBy("key").agg(firsts.alias("pivots")))
    star = members.join(pivots, "key").select("fp", F.get(F.filter("pivots", lambda p: near(p, F.col("fp"))), F.lit(0)).alias("pivot")).filter("fp <> pivot")
    found = cut(found.union(star.select(*ordered(F.col("fp"), F.col("pivot")))).distinct())
    roots = components(found)
    named = cut(members.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root")))
    usual = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("usual"))
    rare = cut(named.join(cut(usual), "key").filter("root <> usual").select("key", F.col("fp").alias("x"), F.col("root").alias("x_root")))
    across = rare.join(named, "key").filter((F.col("root") != F.col("x_root")) & near(F.col("x"), F.col("fp")))
    across = across.groupBy("x", "root").agg(F.min("fp").alias("fp"))
    return found.union(across.select(*ordered(F.col("x"), F.col("fp")))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of every node with an edge (a, b), a < b.

    What a node's rows are joined with is written first: Spark splits a node that has most of the rows only where
    no aggregate by the node lies right below the join.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b"), F.col("m").alias("a"))
        down = cut(large.filter("a <> b").select("b", "a").distinct())  # each b has neighbours a below it
        low = cut(down.groupBy("b").agg(F.min("a").alias("m")))
        small = down.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.countDistinct("b").alias("k")).first()
        if now == mark or now["n"] == now["k"] and edges.select("a").intersect(edges.select("b")).isEmpty():
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def label(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 3, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = cut(fingerprints(docs, id_column, text_column, words_per_shingle))
    points = cut(rows.groupBy("fp").agg(F.min("_id").alias("first")))
    found = components(links(points.select("fp"), max_bits, crowd))
    rooted = points.join(found, points["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    by_point = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(by_point, "fp").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The first document of each component, with all its columns."""
    gone = label(docs, id_column, **options).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    return without(docs, gone, id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(load(spark, sf_dir, "documents"))
