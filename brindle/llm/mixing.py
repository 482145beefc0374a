"""Mixing to target weights by soft membership; DataFrame and SQL functions only.

1. A naive Bayes classifier over the ``labels`` table's domains (good, poor, toxic) is fitted on at most
   ``SAMPLE`` labelled documents of each domain (chosen by a hash of the id). Its features are the presence of the
   ``VOCABULARY`` most telling words (as counts by domain) and bins of four measures of shape. Counts are aggregated in Spark; only the
   bounded tables of counts reach the driver.
2. Every document gets posteriors p[k] and its number of words as tokens.
3. Rates r >= 0 solve the least squares between expected domain totals, sum of r * tokens * p[k], and target[k] *
   the tokens of the domains that have a target (a domain without one is left alone), in the metric of the inverse Gram matrix of the token-weighted posteriors; among equal solutions they
   are the nearest to one. That is r = max(0, 1 - sum of p[k] * pull[k]), and pull comes from Newton steps on the dual
   problem, whose size is the number of domains. A distance to one with falling weights ``NEAR`` keeps the dual finite
   where targets are out of reach. An iteration is one aggregate of a few sums, and no row state is kept between iterations.
   They end when the dual's gradient is under ``ENOUGH``; if ``ROUNDS`` don't get there, an error gives the residual.
4. A document is drawn floor(rate) times, and once more with the rest as probability, by a hash of its id.

Defined cases: null text counts as empty (no tokens, posteriors from priors and bins); null ids are drawn like any
other value; without labels the posteriors are equal and rates stay near one; a target for a domain without mass
is met as far as least squares can; repeated rows get equal rates and draws.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, load, text_or_empty

DOMAINS = ("good", "poor", "toxic")
#: Clean documents have posteriors of some percent for the other domains; targets at or under these would keep only extreme ones.
TARGETS = {"good": 0.9, "poor": 0.05, "toxic": 0.05}
#: Labelled documents of each domain that the classifier is fitted on, at most; words that it uses, at most.
SAMPLE, VOCABULARY = 1500, 128
#: Least log-odds of a telling word; weaker ones depend on each other too much for naive Bayes.
LIFT = math.log(6)
#: Sample documents of its domain that a telling word is in, at least.
SEEN = 8
ROUNDS, ENOUGH = 200, 1e-5
#: Weights of the rates' distance to one against the least squares, one after the other; the last one counts.
NEAR = (1e-2, 1e-4, 1e-6, 1e-8, 1e-10)
EDGES = {"symbols": [0.0, 0.005, 0.02, 0.06], "upper": [0.02, 0.05, 0.2, 0.5], "distinct": [0.1, 0.25, 0.45, 0.7], "size": [20.0, 100.0, 500.0, 2000.0]}
#: Features: shapes whose bins count jointly, since one depends on the other.
SHAPES = [["symbols"], ["upper"], ["distinct", "size"]]
CELLS = [math.prod(len(EDGES[k]) + 1 for k in shape) for shape in SHAPES]


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of the domain that a label stands for."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def features(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns, and _words (the lower-case runs of letters and their marks), _tokens, _bins (one bin number for each shape)."""
    text = text_or_empty(text_column)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    docs = docs.withColumn("_text", text).withColumn("_words", words)
    size = F.greatest(F.length("_text"), F.lit(1))
    measures = {
        "symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>!]")) / size,
        "upper": F.regexp_count("_text", F.lit(r"\p{Lu}")) / size,
        "distinct": F.size(F.array_distinct("_words")) / F.greatest(F.size("_words"), F.lit(1)),
        "size": F.size("_words").cast("double"),
    }
    docs = docs.withColumns({f"_m_{k}": m for k, m in measures.items()})
    bin_of = {k: sum((F.when(F.col(f"_m_{k}") > e, 1).otherwise(0) for e in edges), F.lit(0)) for k, edges in EDGES.items()}
    bins = []
    for shape in SHAPES:
        cell = F.lit(0)
        for k in shape:
            cell = cell * (len(EDGES[k]) + 1) + bin_of[k]
        bins.append(cell)
    return docs.select(*[c for c in docs.columns if c != "_text" and not c.startswith("_m_")], F.size("_words").cast("bigint").alias("_tokens"), F.array(*bins).alias("_bins"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: the optimizer copies a plain column into every place that names it."""
    return F.transform(F.array(value), body)[0]


def lexicon_bins(lexicons: list[list[str]]) -> Column:
    """For each domain how many of its telling words occur, up to three."""
    counts = [F.least(F.size(F.array_intersect("_words", F.array(*map(F.lit, words)))), F.lit(3)) if words else F.lit(0) for words in lexicons]
    return F.array(*counts)


class Membership:
    """Naive Bayes weights: prior[k], lexicons[k], and tables[i][bin][k] for the lexicon bins, then the shape bins."""

    def __init__(self, prior: list[float], lexicons: list[list[str]], tables: list[list[list[float]]]):
        self.prior, self.lexicons, self.tables = prior, lexicons, tables

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with features, and _p: array<double> of the domains' posteriors."""

        def scores(bins: Column) -> Column:
            out = []
            for k in range(len(self.prior)):
                s = F.lit(self.prior[k])
                for i, table in enumerate(self.tables):
                    s = s + F.array(*[F.lit(row[k]) for row in table])[bins[i]]
                out.append(s)
            return F.array(*out)

        def normal(raw: Column) -> Column:
            total = sum((raw[k] for k in range(1, len(self.prior))), raw[0])
            return F.transform(raw, lambda x: x / total)

        softmax = lambda x: let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), normal)
        posteriors = let(F.concat(lexicon_bins(self.lexicons), "_bins"), lambda bins: let(scores(bins), softmax))
        return rows.withColumn("_p", posteriors).drop("_words", "_bins")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Membership:
    marks = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("_domain")).filter("_domain is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("_domain").alias("_domain"))
    picked = None
    for k in range(len(DOMAINS)):
        some = marks.filter(F.col("_domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    picked = picked.withColumnRenamed("doc_id", "_id")
    rows = features(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_domain", "text"))
    rows = cut(rows.select("_domain", F.array_distinct("_words").alias("_words"), "_bins"))
    n = [0] * len(DOMAINS)
    for r in rows.groupBy("_domain").count().collect():
        n[r["_domain"]] = r["count"]
    total = sum(n)
    prior = [math.log((c + 1) / (total + len(n))) for c in n]
    by_word = rows.select("_domain", F.explode("_words").alias("word")).groupBy("word").agg(*[F.sum((F.col("_domain") == k).cast("double")).alias(f"n{k}") for k in range(len(n))])
    lexicons = []
    for k in range(len(n)):
        rest, others = sum(F.col(f"n{j}") for j in range(len(n)) if j != k), total - n[k]
        lift = F.log(((F.col(f"n{k}") + 0.5) / (n[k] + 1)) / ((rest + 0.5) / (others + 1)))
        top = by_word.filter(F.col(f"n{k}") >= SEEN).withColumn("lift", lift).filter(F.col("lift") > LIFT)
        lexicons.append([r["word"] for r in top.orderBy(F.desc(F.col("lift") * F.col(f"n{k}")), "word").limit(vocabulary // len(n)).collect()])
    rows = rows.select("_domain", F.concat(lexicon_bins(lexicons), "_bins").alias("_bins"))
    found = {(r["i"], r["b"], r["_domain"]): r["count"] for r in rows.select("_domain", F.posexplode("_bins").alias("i", "b")).groupBy("i", "b", "_domain").count().collect()}
    tables = []
    for i, cells in enumerate([4] * len(n) + CELLS):
        tables.append([[math.log((found.get((i, b, k), 0) + 0.5) / (n[k] + 0.5 * cells)) for k in range(len(n))] for b in range(cells)])
    return Membership(prior, lexicons, tables)


def rate_of(pull: list[float], p: Column) -> Column:
    """A document's rate from its posteriors."""
    return F.greatest(F.lit(0.0), sum((p[k] * F.lit(-float(x)) for k, x in enumerate(pull)), F.lit(1.0)))


def fit_rates(members: DataFrame, targets: list[float | None], rounds: int = ROUNDS, enough: float = ENOUGH) -> list[float]:
    """The pull of each domain, which makes the rates; members has _tokens and _p. Raises if ``rounds`` passes don't suffice.

    A target of None leaves its domain alone: its tokens count neither as met nor as missed.
    """
    named = [i for i, x in enumerate(targets) if x is not None]
    share = np.array([targets[i] for i in named])
    share = share / share.sum()
    t = F.col("_tokens").cast("double")
    p = [F.col("_p")[i] for i in named]

    def sums(rate: Column, x: list[Column]) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens of the named domains; sums of rate * x[i]; sums of x[i] * x[j] where the rate is positive."""
        n = len(x)
        on = F.when(F.col("_r") > 0, t).otherwise(0.0)
        cells = [F.sum(on * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
        row = members.withColumn("_r", rate).agg(F.sum(t * sum(p[1:], p[0])).alias("all"), *[F.sum(F.col("_r") * t * x[i]).alias(f"s{i}") for i in range(n)], *cells).first()
        everything = row["all"] or 0.0
        if everything <= 0:
            return 0.0, np.zeros(n), np.zeros((n, n))
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        return everything, np.array([row[f"s{i}"] for i in range(n)]) / everything, gram / everything

    def pull_of(z: np.ndarray) -> list[float]:
        pull = [0.0] * len(targets)
        for i, v in zip(named, base @ z, strict=True):
            pull[i] = float(v)
        return pull

    everything, _, gram = sums(F.lit(1.0), p)
    if everything <= 0:
        return [0.0] * len(targets)
    # Coordinates in which the Gram matrix is the identity; directions without mass go.
    size, axes = np.linalg.eigh(gram)
    seen = size > 1e-9 * size.max()
    base = axes[:, seen] / np.sqrt(size[seen])
    x = [sum((p[i] * F.lit(float(base[i, j])) for i in range(len(p))), F.lit(0.0)) for j in range(base.shape[1])]
    goal = base.T @ share

    def slope_at(z: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the dual."""
        _, got, curve = sums(rate_of(pull_of(z), F.col("_p")), x)
        return goal - got + near * z, curve + near * np.eye(len(z))

    z, left = np.zeros(len(goal)), rounds
    for near in NEAR:
        gradient, hessian = slope_at(z, near)
        while np.abs(gradient).max() >= enough:
            step, length = -np.linalg.solve(hessian, gradient), 1.0
            down = abs(gradient @ step)
            while True:
                if left == 0:
                    raise RuntimeError(f"rates not settled after {rounds} rounds: residual {np.abs(gradient).max():.3g}, enough is {enough:g}")
                left -= 1
                there, curve = slope_at(z + length * step, near)
                rise = there @ step
                if rise <= 0.5 * down:
                    break
                # Too far: the dual is convex, so its least value lies before. Behind a kink the secant falls short of it, so no less than a tenth.
                length *= max(down / (down + rise), 0.1)
            z, gradient, hessian = z + length * step, there, curve
    return pull_of(z)


def members(docs: DataFrame, model: Membership, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_id, _tokens, _p of every row."""
    return model.apply(features(docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_own")), "_own").drop("_own")).select("_id", "_tokens", "_p")


def copies(rate: Column, key: Column) -> Column:
    """How often a row is drawn."""
    uniform = F.shiftrightunsigned(F.xxhash64(key, F.lit("draw")), 11) / F.lit(float(1 << 53))
    return let(rate, lambda r: (F.floor(r) + F.when(uniform < r - F.floor(r), 1).otherwise(0)).cast("int"))


def label(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_words, posteriors, rate, n_copies of every row."""
    slim = cut(members(docs, train(docs, labels)))
    rated = slim.withColumn("rate", rate_of(fit_rates(slim, [targets.get(d) for d in DOMAINS]), F.col("_p")))
    return rated.select(F.col("_id").alias("doc_id"), F.col("_tokens").alias("n_words"), *[F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("_id")).alias("n_copies"))


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The drawn rows with all their columns. Rates come from posteriors alone, so texts are read twice, never shuffled."""
    model = train(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), labels)
    pull = fit_rates(cut(members(docs, model, id_column, text_column)), [targets.get(d) for d in DOMAINS])
    # The row travels as one struct, so that no column name of the caller's can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).alias("_id"), F.col(text_column).alias("_own"))
    rated = model.apply(features(whole, "_own")).withColumn("_n", let(F.col("_p"), lambda p: copies(rate_of(pull, p), F.col("_id"))))
    # An outer explode: for a plain one the optimizer would compute the rate once more, in a filter before it.
    return rated.withColumn("_n", F.explode_outer(F.array_repeat(F.lit(1), F.col("_n")))).filter("_n is not null").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
