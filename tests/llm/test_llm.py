"""The language-model operators against brute force, exact round trips and held-out labels, on small fixtures."""

import collections
import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import bpe, chat, exact_dedup, kernels, line_dedup, mixing, quality, queries, shared, simhash, substring_dedup, token_counts, url_filter

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
#: Large enough for some hundred bad documents on either side.
HELD_OUT = os.environ.get("TEST_LLM_HELD_OUT_DIR", "/root/testdata/sf0.1")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id bigint, text string, _id string, fp string, piece int, kept string, _n int, _hash string"
TEXTS = [
    (7, "The cat  sat on\tthe mat"), (3, "The cat sat on the mat"), (9, None), (1, ""), (4, " \n\t "), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two"), (8, "x" * 40000), (2, "Ünï ç\n\nline two\nline two\n" + "a b c d e f g h " * 9),
]


def frame(spark, rows=TEXTS):
    """The rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "own", "own", -1, "own", 5, "own") for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def generated(seed=1, n=60, vocabulary=30):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 25))) for _ in range(25)]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(n)]


# -- kernels ----------------------------------------------------------------------------------------------------


def test_xxh64_and_words():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(n % 100)) for n in range(1000)]
    buf, offsets = kernels.flat(parts)
    assert [int(h) for h in kernels.xxh64(buf, offsets[:-1], np.diff(offsets))] == [xxhash.xxh64_intdigest(p, 42) for p in parts]
    starts, ends, by_part = kernels.word_bounds(buf, offsets)
    raw = buf.tobytes()
    assert [[raw[starts[k] : ends[k]] for k in range(a, b)] for a, b in zip(by_part[:-1], by_part[1:])] == [p.split() for p in parts]


# -- 1 ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, k=3):
    w = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def slow_components(prints, max_bits=2):
    ids = sorted(prints, key=lambda i: (i is None, i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= max_bits:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_fingerprints(spark):
    rows = [r for r in TEXTS if r[0] is not None]
    found = by_id(simhash.label(frame(spark, rows)))
    prints = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(prints)
    assert {i: (f"{p:016x}", want[i]) for i, p in prints.items()} == {i: v[:2] for i, v in found.items()}
    kept = sorted(r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect())
    assert set(kept) == set(want.values())
    assert simhash.label(frame(spark, [])).collect() == []


@pytest.mark.parametrize(("max_bits", "crowd"), [(2, 20_000), (2, 2), (8, 20_000), (8, 12), (5, 2)])
def test_simhash_links_of_dense_groups(spark, max_bits, crowd):
    """Clusters of close fingerprints, chains among them, and a dense cloud; a low limit sends nearly all through the crowd's way."""
    rng = random.Random(3)
    points = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            points.add(p)
            for b in rng.sample(range(64), rng.randrange(1, max_bits + 1)):
                p ^= 1 << b
    centre = rng.getrandbits(64)
    points |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(max_bits + 2))) for _ in range(150)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    df = spark.createDataFrame(signed, "fp bigint")
    edges = simhash.links(df, max_bits, crowd)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = slow_components({p: p for p in points}, max_bits)
    groups = collections.defaultdict(set)
    for p, r in want.items():
        groups[r].add(p - (1 << 64) if p >> 63 else p)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset([r, *(n for n, x in found.items() if x == r)]) for r in set(found.values())}


def test_simhash_spanning_groups(monkeypatch):
    """Large groups: links join the same members as all pairs do, with no more links than members."""
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)[rng.integers(0, 40, size=300)] ^ (np.uint64(1) << rng.integers(0, 64, size=300, dtype=np.uint64))
    key = np.sort(rng.integers(0, 6, size=300))
    together = lambda x, y: {frozenset(g) for g in _groups(zip(x.tolist(), y.tolist()))}
    for bits in (3, 30):
        few = simhash.group_links(key, fp, bits, few=1000)
        for square in (0, simhash.SQUARE):
            monkeypatch.setattr(simhash, "SQUARE", square)
            a, b = simhash.group_links(key, fp, bits)
            assert len(a) <= 300 and (a < b).all() and together(a, b) == together(*few)
        assert bits == 3 or len(few[0]) > 1000


def _groups(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for x, y in edges:
        root[find(x)] = find(y)
    out = collections.defaultdict(set)
    for i in list(root):
        out[find(i)].add(i)
    return out.values()


def test_threshold_allocation():
    costs = [{-1: 0, 0: 10, 2: 400}, {-1: 0, 0: 50, 2: 60}, {-1: 0, 0: 500, 2: 900}]
    for total in (-3, 0, 1, 3):
        cost, chosen = simhash.allocate(costs, total)
        brute = min(sum(c[t] for c, t in zip(costs, ts)) for ts in itertools.product((-1, 0, 2), repeat=3) if sum(ts) >= total)
        assert cost == brute == sum(c[t] for c, t in zip(costs, chosen)) and sum(chosen) >= total
    parts = simhash.group_bits(np.eye(64), 3)
    assert sorted(b for p in parts for b in p) == list(range(64))


# -- 2 ----------------------------------------------------------------------------------------------------------


def slow_rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    urls = ["http://WWW.Example.COM/en/71?x=1", "https://a.com/en/", "http://com/en/9#f", "http://xcom/en/", "http://e.example.net/de/8/1", "http://example.net/de/9", "https://a.org/es/?q", "nothing", None, "", "x://", "http://a.net?/de/", "http://b.org/fr/1", "http://ÄB.NET/de/é"]
    df = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], "page_id bigint, url string, host string, _key string")
    found = by_id(url_filter.judge(df))
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = lambda s, stops: s[: min([len(s), *(s.find(c) for c in stops if c in s)])]
        raw = cut(rest, "/?#")
        host, path = raw.encode().translate(LOWER).decode(), cut(rest[len(raw) :], "?#")
        rule, action = slow_rule(host, path)
        assert found[i][:3] == (host, path, rule)
        assert found[i][3] == action or action is None and found[i][3] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).collect() == []
    # Without examples of both kinds the models allow.
    assert {r["verdict"] for r in url_filter.judge(df.filter("page_id in (7, 12)")).collect()} == {"allow"}


def test_url_models_agree_with_brute_force(spark):
    rng = random.Random(4)
    urls = [f"http://{'spam' if k % 2 else 'good'}{rng.randrange(9)}.{'com/en' if k % 2 else 'net/de'}/{rng.randrange(99)}" for k in range(60)] + ["http://spam3.info/q", "http://good4.info/q"] * 2
    found = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    texts = {u: "^" + u.split("://")[1] + "$" for u in urls}
    count = [collections.Counter(), collections.Counter()]
    for u in urls[:60]:
        t = texts[u]
        for i in range(1, len(t)):
            for k in range(url_filter.ORDER + 1):
                if i >= k:
                    count["spam" in u][t[i - k : i + 1]] += 1
    total = [collections.Counter(), collections.Counter()]
    for side in (0, 1):
        for g, n in count[side].items():
            total[side][len(g), g[:-1]] += n
    grams = {g for g in set(count[0]) | set(count[1]) if len(g) == 1 or total[0][len(g), g[:-1]] + total[1][len(g), g[:-1]] >= url_filter.SEEN}
    assert max(map(len, grams)) == url_filter.ORDER + 1 and len(grams) < len(set(count[0]) | set(count[1]))

    def p(side, g):
        below = p(side, g[1:]) if len(g) > 1 else 1 / 256
        return (count[side][g] + url_filter.MASS * below) / (total[side][len(g), g[:-1]] + url_filter.MASS)

    for r in found:
        t = texts[urls[r["page_id"]]]
        score = 0.0
        for i in range(1, len(t)):
            seen = [t[i - k : i + 1] for k in range(url_filter.ORDER + 1) if i >= k and t[i - k : i + 1] in grams]
            if seen:
                score += np.log(p(0, seen[-1]) / p(1, seen[-1]))
        assert r["score"] == pytest.approx(score / (len(t) - 1), abs=1e-6)
    verdicts = {urls[r["page_id"]]: r["verdict"] for r in found}
    assert verdicts["http://spam3.info/q"] == "block" and verdicts["http://good4.info/q"] == "allow"


# -- 3 ----------------------------------------------------------------------------------------------------------


def test_chat_collapse(spark):
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a"], 6: ["b"], 7: ["a", None], 8: ["a", ""]}
    rows = [(c, k, "user" if k % 2 == 0 else None, t, "own") for c, turns in talks.items() for k, t in enumerate(turns)] + [(None, 0, "user", "a", "own")]
    found = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.collapse(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos string")).collect()}
    assert set(found) == {2, 4, 6, 7, 8}
    assert found[2] == (3, "<|user|>\na\n<||>\nb\n<|user|>\nc\n")
    assert chat.collapse(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


# -- 4 ----------------------------------------------------------------------------------------------------------


def slow_classes(rows):
    form = lambda t: __import__("re").sub(rb"[\x20\x09-\x0d]+", b" ", (t or "").encode())
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[form(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[form(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[form(t)]), i == keep, hashlib.sha256(form(t)).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    assert sorted(map(tuple, exact_dedup.label(frame(spark)).collect()), key=repr) == slow_classes(TEXTS)
    kept = collections.Counter(r.doc_id for r in exact_dedup.drop_copies(frame(spark)).collect())
    assert kept == collections.Counter([1, 2, 3, 4, 5, 8, None])
    assert exact_dedup.drop_copies(frame(spark)).columns == frame(spark).columns
    assert exact_dedup.label(frame(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_rows_without_some_ids(spark, monkeypatch, limit):
    """Broadcast or shuffled: ids that repeat, a null id on either side, clashing column names, string ids, no ids at all."""
    monkeypatch.setattr(shared, "SMALL_IDS", limit)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "_gone bigint, _row string")
    gone = spark.createDataFrame([(1,), (1,), (None,), (7,)], "x bigint")
    left = shared.without(docs, gone, "_gone")
    assert left.columns == docs.columns and sorted(r[1] for r in left.collect()) == ["c", "d"]
    named = docs.select(F.col("_gone").cast("string").alias("_key"), "_row")
    assert sorted(r[1] for r in shared.without(named, gone.select(F.col("x").cast("string")), "_key").collect()) == ["c", "d"]
    assert shared.without(docs, gone.limit(0), "_gone").count() == 4


def test_exact_dedup_of_a_hot_text(spark):
    """One text in a third of the rows over many partitions, with ids in no order."""
    rows = [(997 * i % 3001, "the same\t text" if i % 3 == 0 else f"text {i % 500}") for i in range(3001)]
    found = exact_dedup.label(frame(spark, rows).repartition(37))
    assert sorted(map(tuple, found.collect()), key=repr) == slow_classes(rows)


def test_exact_dedup_splits_collisions(spark):
    """With a hash of three values, texts that share it stay apart."""
    rows = [(i, f"text {i % 40}") for i in range(200)]
    found = exact_dedup.classes(frame(spark, rows), hashed=lambda form: F.pmod(F.crc32(form), F.lit(3))).select("_id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, found)) == [(i, i % 40, 5) for i in range(200)]


# -- 5 ----------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        kind = i % 4
        base = " ".join(f"w{rng.randrange(300)}".replace("1", "x") for _ in range(60))
        rows.append((i, base.upper() + " ### ###" if kind == 1 else base + " idiot idiot" if kind == 2 else base))
        if i < 300:
            marks.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    rows += [(900, None), (None, "plain words")]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = [r.asDict() for r in mixing.label(docs, labels).collect()]
    assert len(found) == len(rows)
    total = sum(r["n_words"] for r in found)
    for d, share in mixing.TARGETS.items():
        assert sum(r["rate"] * r["n_words"] * r[f"p_{d}"] for r in found) / total == pytest.approx(share, abs=1e-3)
    held_out = [r for r in found if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    right = sum(max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) == ("good", "poor", "toxic", "good")[r["doc_id"] % 4] for r in held_out)
    assert right >= 95
    drawn = collections.Counter(r.doc_id for r in mixing.draw(docs, labels).collect())
    assert drawn == collections.Counter({r["doc_id"]: r["n_copies"] for r in found if r["n_copies"]})
    assert mixing.draw(docs, labels).columns == docs.columns
    assert {r["rate"] for r in mixing.label(docs.limit(0), labels).collect()} == set()
    assert all(r["p_good"] == pytest.approx(1 / 3, abs=0.2) for r in mixing.label(docs.limit(3), labels.limit(0)).collect())


def test_mixing_rates_meet_the_projection(spark):
    """Rates that must reach zero: the least squares solution against many small steps in numpy."""
    p = np.array([[0.9, 0.1, 0.0], [0.1, 0.9, 0.0], [0.0, 0.2, 0.8], [0.3, 0.3, 0.4]] * 5)
    t = np.arange(1, 21, dtype=float)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(20)], "_id bigint, _tokens bigint, _p array<double>")
    steps = mixing.fit_rates(members, [0.98, 0.01, 0.01], rounds=30, enough=1e-7)
    rate = np.array([r["r"] for r in members.withColumn("r", mixing.rate_of(steps, F.col("_p"))).orderBy("_id").collect()])
    share = (rate * t) @ p / t.sum()
    assert (rate >= 0).all() and (rate == 0).any() and share[0] == pytest.approx(0.98, abs=0.15)


@pytest.mark.parametrize("parts", [[0.4, 0.1, 0.5], [0.6, 0.07, 0.33], [0.01, 0.5, 0.49]])
def test_mixing_rates_meet_attainable_targets(spark, parts):
    """Mixtures with overlapping domains of which one is far too large or too small: targets are met, not approached."""
    rng = np.random.default_rng(3)
    n, share = 4000, [0.94, 0.03, 0.03]
    score = rng.normal(size=(n, 3)) + 2.5 * np.eye(3)[rng.choice(3, size=n, p=parts)]
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    t = rng.integers(1, 2000, size=n)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(n)], "_id bigint, _tokens bigint, _p array<double>")
    rate = mixing.rate_of(mixing.fit_rates(members, share), F.col("_p"))
    r = np.array([row["r"] for row in members.withColumn("r", rate).orderBy("_id").collect()])
    assert (r >= 0).all() and (r == 0).any()
    assert (r * t) @ p / t.sum() == pytest.approx(share, abs=2e-5)
    with pytest.raises(RuntimeError, match="residual"):
        mixing.fit_rates(members, share, rounds=1)


def test_mixing_leaves_a_domain_without_target_alone(spark):
    """Two domains meet their targets among themselves; the third, next to nothing, doesn't pull the rates."""
    rng = np.random.default_rng(8)
    n = 3000
    p = np.stack([rng.choice([0.95, 0.1], size=n, p=[0.8, 0.2]), np.full(n, 1e-5), np.zeros(n)], axis=1)
    p[:, 2] = 1 - p[:, :2].sum(axis=1)
    t = rng.integers(1, 2000, size=n)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(n)], "_id bigint, _tokens bigint, _p array<double>")
    pull = mixing.fit_rates(members, [0.93, None, 0.07])
    assert pull[1] == 0
    r = np.array([row["r"] for row in members.withColumn("r", mixing.rate_of(pull, F.col("_p"))).orderBy("_id").collect()])
    got = (r * t) @ p
    assert got[[0, 2]] / (t @ p[:, [0, 2]]).sum() == pytest.approx([0.93, 0.07], abs=2e-5)
    assert r.max() < 2 and (r[p[:, 0] > 0.5] >= 1).all()


def test_mixing_rates_of_targets_out_of_reach(spark):
    """The conditions of the least squares: no gradient at positive rates, none below zero at zero rates."""
    p = np.array([[0.5, 0.5, 0.0], [0.9, 0.1, 0.0], [0.2, 0.8, 0.0]])
    members = spark.createDataFrame([(i, 1, p[i].tolist()) for i in range(3)], "_id bigint, _tokens bigint, _p array<double>")
    rate = mixing.rate_of(mixing.fit_rates(members, [0.94, 0.03, 0.03]), F.col("_p"))
    r = np.array([row["r"] for row in members.withColumn("r", rate).orderBy("_id").collect()])
    slope = p @ np.linalg.pinv(p.T @ p / 3) @ (r @ p / 3 - [0.94, 0.03, 0.03])
    assert (r == 0).any() and np.abs(slope[r > 0]).max() < 1e-4 and slope.min() > -1e-4


def test_mixing_rates_of_steep_duals(spark):
    """Few good tokens among coarse posteriors: a secant alone stalls at the dual's kinks."""
    rng = np.random.default_rng(1)
    n, parts = 500, np.array([0.0061352, 0.4361083, 0.5577565])
    score = np.round(rng.normal(size=(n, 3)) * 4) / 2 + np.log(parts) + 1.9 * np.eye(3)[rng.choice(3, size=n, p=parts / parts.sum())]
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    t = rng.integers(1, 2000, size=n)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(n)], "_id bigint, _tokens bigint, _p array<double>")
    rate = mixing.rate_of(mixing.fit_rates(members, [0.94, 0.03, 0.03]), F.col("_p"))
    r = np.array([row["r"] for row in members.withColumn("r", rate).orderBy("_id").collect()])
    w = t / t.sum()
    slope = p @ np.linalg.pinv((p * w[:, None]).T @ p) @ ((r * w) @ p - [0.94, 0.03, 0.03])
    assert np.abs(slope[r > 0]).max() < 1e-4 and slope.min() > -1e-4


def test_mixing_features_of_other_scripts(spark):
    """Typographic signs and no-break spaces part words; capitals of every script count."""
    text = "\u201cIdiot\u201d\u2014it\u2019s\u00a0na\u00efve, e\u0301t\u00e9\u3002\u4f60\u597d\u3001x1y"
    found = mixing.features(spark.createDataFrame([(text,), ("\u0416\u0423\u041a \u03a9\u039c\u0395\u0393\u0391",), ("abc defgh",)], "text string")).collect()
    assert found[0]["_words"] == ["idiot", "it", "s", "na\u00efve", "e\u0301t\u00e9", "\u4f60\u597d", "x", "y"] and found[0]["_tokens"] == 8
    upper = [r["_bins"][1] for r in found]
    assert upper[1] == len(mixing.EDGES["upper"]) and upper[2] == 0


# -- 6 ----------------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def slow_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        keep, n, own = [], 0, []
        gone = 0
        for line in (t or "").encode().split(b"\n"):
            w = line.split()
            n += bool(w)
            if w and any(near(w, x) for x in seen + own):
                gone += 1
            else:
                keep.append(line)
            if w:
                own.append(w)
        seen += own
        out[i] = (n, gone, hashlib.sha256(b"\n".join(keep)).hexdigest())
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    letters = ["a", "bb", "ccc", "dd", "e"]
    base = [[rng.choice(letters) for _ in range(rng.randrange(0, 9))] for _ in range(20)]

    def edit(w):
        w = list(w)
        how = rng.randrange(5)
        if how == 0:
            w.insert(rng.randrange(len(w) + 1), rng.choice(letters))
        elif w and how == 1:
            del w[rng.randrange(len(w))]
        elif w and how == 2:
            w[rng.randrange(len(w))] = rng.choice(letters)
        return w

    rows = [(i, "\n".join("  ".join(edit(rng.choice(base))) for _ in range(rng.randrange(1, 6)))) for i in range(120)] + [(500, None), (501, "\n \n"), (None, "a bb ccc dd e\nzz"), (502, "y " * 20000)]
    df = frame(spark, rows).repartition(3)
    assert by_id(line_dedup.label(df, piece_bytes=500, block_bytes=1200)) == slow_lines(rows)
    assert by_id(line_dedup.label(df)) == slow_lines(rows)
    kept = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in line_dedup.strip(df).collect()}
    assert kept == {i: v[2] for i, v in slow_lines(rows).items()}
    assert line_dedup.label(frame(spark, [])).collect() == []
    assert {r[2] for r in line_dedup.label(frame(spark, [(1, "q r s t u"), (1, "q r s t u")])).collect()} == {0}


# -- 7 ----------------------------------------------------------------------------------------------------------


def slow_substrings(rows, k=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - k + 1):
            if i is not None:
                first[tuple(w[s : s + k])] = min(i, first.get(tuple(w[s : s + k]), i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {s + j for s in range(len(w) - k + 1) if i is not None and first[tuple(w[s : s + k])] < i for j in range(k)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_substring_dedup(spark):
    rows = [*generated(9), (500, None), (501, ""), (None, generated(9)[0][1]), (502, "long " * 20000)]
    df = frame(spark, rows).repartition(3)
    want = slow_substrings(rows)
    assert sum(v[1] for v in want.values()) > 100
    assert by_id(substring_dedup.label(df, piece_bytes=1500, block_bytes=4000)) == want
    assert by_id(substring_dedup.label(df)) == want
    for r in substring_dedup.strip(df).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == want[r.doc_id][2]
        assert sum(s.end - s.first for s in r.spans) == want[r.doc_id][1]
    assert substring_dedup.label(frame(spark, [])).collect() == []
    same = " ".join(f"w{i}" for i in range(20))
    assert {r[2] for r in substring_dedup.label(frame(spark, [(1, same), (1, same)])).collect()} == {0}


# -- 8 ----------------------------------------------------------------------------------------------------------


def slow_base(text):
    text = text or ""
    w = words(text)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    chars = sum(len(x.decode()) for x in w)
    return (len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w))


def test_quality_base_rules(spark):
    rows = [r for r in TEXTS if r[0] not in (None, 6)] + [(100 + i, t) for i, t in generated(10)] + [(99, "# a|b\n# a|b\n\n# a|b \n" * 3)]
    found = by_id(quality.judge(frame(spark, rows), None))
    assert {i: v[:6] for i, v in found.items()} == {i: slow_base(t) for i, t in rows}
    assert all(v[6] == (not v[5]) for v in found.values())
    assert quality.judge(frame(spark, []), None).collect() == []
    kept = quality.keep_good(frame(spark, rows), None)
    assert kept.columns == frame(spark).columns and {r.doc_id for r in kept.collect()} == {i for i, v in found.items() if v[6]}


def test_quality_viterbi_and_training():
    rng = np.random.default_rng(1)
    model = quality.LineModel(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [0, 3, 1, 6, 0]
    by_doc = np.cumsum([0, *sizes])
    bins = np.stack([rng.integers(0, s, by_doc[-1]) + b for s, b in zip(quality.SIZES, quality.BASES)], axis=1)
    labels = model.decode(bins, by_doc)
    e = model.emissions(bins)
    for a, b in zip(by_doc[:-1], by_doc[1:]):
        score = lambda y, a=a: model.start[y[0]] + sum(e[a + k] * v for k, v in enumerate(y)) + sum(model.moves[u, v] for u, v in itertools.pairwise(y))
        if b > a:
            assert tuple(labels[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=score)


def test_quality_held_out(spark):
    """Labels that the model wasn't fitted on: bad documents go, good ones stay."""
    docs, labels = shared.load(spark, HELD_OUT, "documents"), shared.load(spark, HELD_OUT, "labels")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    judged = quality.judge(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    good = [r.kept for r in judged if r.quality == 1]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality.train(docs, labels.filter("quality = 1")) is None


# -- 9, 10 ------------------------------------------------------------------------------------------------------

ALPHABET = [*"abcdeéthe  \n\t'sred.,!?#1290 ÀŽ中文字ßüñΣİ²Ⅷ\u0301\x1c\x85 '", "<|endoftext|>", "<|startoftext|>", "the ", "ing", "'ll", "'re", " \n "]


def fuzz(seed, n=3000):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*made, *["".join(rng.choice("thearinos") for _ in range(rng.randrange(40, 300))) for _ in range(100)], "a" * 5000, "ab" * 900, "", " ", " a ", "\n\n a", "a  ", "\n \nb"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    own, other = bpe.ByteBPE(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    texts = fuzz(11)
    ids = [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == ids
    raw = own.decode([np.array(x, "<u4").tobytes() for x in ids])
    assert [bpe.text_of(x) for x in raw] == [other.decode(x, skip_special_tokens=False) for x in ids]
    lone = np.array([own.ids[b"\xe4"]], "<u4").tobytes()
    assert bpe.text_of(own.decode([lone])[0]) == other.decode([own.ids[b"\xe4"]])
    many = [lone * k for k in (bpe.DECODED, 0, 3, bpe.DECODED + 1, 0)]
    assert list(map(len, own.decode(many))) == [len(x) // 4 for x in many] and own.decode([]) == []


def test_bpe_short_words_step_by_step():
    """Guesses and merges in arrays against one word at a time, at lengths around the lanes' and with zero bytes."""
    own, rng = bpe.ByteBPE(bpe.default_path()), random.Random(12)
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 20))).encode() for letters in (" theraino", " \0ae0", "éßа中x ") for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_words([*made, b""])]
    assert got == [own.merges.merge([own.leaf[c] for c in w]) for w in [*made, b""]]
    short = [w for w in made if len(w) <= bpe.SHORT]
    raw = np.frombuffer(b"".join(w.ljust(bpe.SHORT, b"\0") for w in short), np.uint8).reshape(-1, bpe.SHORT)
    ids, counts = own._speculate_short(raw, np.array([len(w) for w in short]))
    assert [row[:n].tolist() for row, n in zip(ids, counts)] == [own.speculate(w) for w in short]


def test_bpe_frames(spark):
    found = bpe.encode(frame(spark))
    rows = found.collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows) and found.columns[: len(frame(spark).columns)] == frame(spark).columns
    assert {(r.doc_id, r.decoded) for r in bpe.decode(found).collect()} == {(i, t or "") for i, t in TEXTS}
    digest = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(frame(spark)).collect()}
    assert digest == {(r.doc_id, len(r.token_ids), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows}
    assert bpe.encode(frame(spark, [])).collect() == []
    assert bpe.encode(found).columns == found.columns


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    own, other = token_counts.WordBPE(token_counts.default_path()), Tokenizer.from_file(token_counts.default_path())
    size = lambda texts: [len(x.ids) for x in other.encode_batch(texts, add_special_tokens=False)]
    texts = fuzz(12)
    assert [own.count(t) for t in texts] == size(texts)
    for t in ["".join(random.Random(k).choice("theingaro. '1é") for _ in range(25)) for k in range(60)]:
        stored, normal, now = dict(own.prefix_counts(t)), own.normal(t), 0
        for i, n in enumerate(size([normal[:i] for i in range(len(normal) + 1)])):
            now = stored.get(i, now)
            assert now == n


def test_token_count_frames(spark):
    found = {(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts.counts(frame(spark), limit=100).collect()}
    assert found == {(i, len((t or "").encode()), i == 8 or i == 2 and (i, len(t.encode()), True) in found) for i, t in TEXTS}
    own = token_counts.tokenizer(token_counts.default_path())
    tables = token_counts.within(token_counts.prefix_tables(frame(spark)), 3).collect()
    for r in tables:
        assert own.count(own.normal(r.text or "")[: r.end_within]) <= 3
    for r in token_counts.truncated(frame(spark), 3).collect():
        assert own.count(r.text_within) <= 3 and own.normal(r.text or "").startswith(r.text_within)
    assert token_counts.counts(frame(spark, [])).collect() == []


# -- queries and the pipeline -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, queries.queries()[name](spark, SF).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline

    docs = shared.load(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = (docs, shared.cut(stage(spark, docs, SF)))
        docs = kept[name][1]
    rows = {n: ([(r.doc_id, r.text) for r in a.collect()], b.collect()) for n, (a, b) in kept.items()}
    for n, (_, b) in list(kept.items())[:-1]:
        assert b.columns == corpus_pipeline.COLUMNS
    before, after = rows["quality rules"]
    assert all(not slow_base(r.text)[5] for r in after) and len(after) > 0.5 * sum(not slow_base(t)[5] for _, t in before)
    before, after = rows["exact dedup"]
    assert {r.doc_id for r in after} == {c[1] for c in slow_classes(before)}
    before, after = rows["SimHash near-dedup"]
    assert {r.doc_id for r in after} == set(slow_components({i: slow_fingerprint(t, 5) for i, t in before}, corpus_pipeline.NEAR_BITS).values())
    before, after = rows["mixing to target weights"]
    assert collections.Counter((r.doc_id, r.text) for r in after).keys() <= set(before)
    before, after = rows["BPE encoding"]
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in after) and sorted((r.doc_id, r.text) for r in after) == sorted(before)
