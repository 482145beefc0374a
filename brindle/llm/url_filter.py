"""URL filter: host and path rules first, then a ratio of character language models; DataFrame functions only.

Every url that a rule decides is an example: of accepted urls where the rule allows, of rejected ones where it blocks.
All examples are counted, as character n-grams of ``^host path$`` up to ``ORDER`` letters of context. The models are
variable-order: a context counts if at least ``SEEN`` examples show it, so the contexts lengthen as the examples grow in number;
a letter is predicted from the longest such context in which the examples show it, with its probability
smoothed by the next shorter order (Dirichlet mass ``MASS``). Each n-gram stores how much it changes the log ratio
of accepted to rejected over its own suffix, so a url's log-likelihood difference is a plain sum over its n-grams.
It is divided by the number of letters and compared with the threshold that gives the least sum of both error rates
over the examples, found on a fixed grid of bins.

The n-gram table is broadcast only when its counted rows are at most ``BROADCAST_ROWS``; beyond that the
join shuffles. Urls are scored once for each different host and path.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged by the models like any
other; without examples of both kinds the models say allow; repeated rows get equal verdicts; further columns are
not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, load

#: (action, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ORDER, SEEN, MASS = 6, 4, 2.0
BROADCAST_ROWS = 200_000
#: Bins of the normalised score, of width 1 / GRID from -SPAN to SPAN.
GRID, SPAN = 100, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits; null fields if none does."""
    found = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, made) if found is None else found.when(fits, made)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    return found.otherwise(none) if found is not None else none


def grams(texts: DataFrame) -> DataFrame:
    """All columns but _text, and k (letters of context), gram (context and letter), for every letter but the first."""
    at = texts.select("*", F.explode(F.sequence(F.lit(2), F.length("_text"))).alias("_i"))
    each = [F.struct(F.lit(k).alias("k"), F.substr("_text", F.col("_i") - k, F.lit(k + 1)).alias("gram"), (F.col("_i") > k).alias("ok")) for k in range(ORDER + 1)]
    rest = [c for c in texts.columns if c != "_text"]
    return at.select(*rest, F.explode(F.array(*each)).alias("_g")).filter("_g.ok").select(*rest, "_g.k", "_g.gram")


def log_ratios(examples: DataFrame) -> DataFrame:
    """gram, delta from examples (_text, _accepted, _rejected: how often each text is one)."""
    counts = cut(grams(examples).groupBy("k", "gram").agg(F.sum("_accepted").cast("double").alias("a"), F.sum("_rejected").cast("double").alias("r")))
    context = counts.select("*", F.left("gram", F.col("k")).alias("ctx"))
    totals = context.groupBy("k", "ctx").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    # A context's suffix is shown at least as often, so every gram that stays has its suffix.
    full = context.join(totals.filter((F.col("k") == 0) | (F.col("ta") + F.col("tr") >= SEEN)), ["k", "ctx"]).select("k", "gram", "a", "r", "ta", "tr")
    below, parts = None, []
    for k in range(ORDER + 1):
        rows = full.filter(F.col("k") == k)
        if below is None:
            rows = rows.select("*", F.lit(1 / 256).alias("pa"), F.lit(1 / 256).alias("pr"), F.lit(0.0).alias("base"))
        else:
            rows = rows.select("*", F.right("gram", F.lit(k)).alias("suffix")).join(below, "suffix")
        smooth = lambda n, p, t: (F.col(n) + MASS * F.col(p)) / (F.col(t) + MASS)
        rows = rows.select("gram", smooth("a", "pa", "ta").alias("qa"), smooth("r", "pr", "tr").alias("qr"), "base")
        rows = cut(rows.select("gram", "qa", "qr", F.log(F.col("qa") / F.col("qr")).alias("llr"), "base"))
        parts.append(rows.select("gram", (F.col("llr") - F.col("base")).alias("delta")))
        below = rows.select(F.col("gram").alias("suffix"), F.col("qa").alias("pa"), F.col("qr").alias("pr"), F.col("llr").alias("base"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return table


def threshold(scored: DataFrame) -> float | None:
    """From _score, _accepted, _rejected; None without examples of both kinds."""
    bin_of = F.greatest(F.lit(-SPAN * GRID), F.least(F.lit(SPAN * GRID), F.floor(F.col("_score") * GRID)))
    rows = scored.groupBy(bin_of.alias("b")).agg(F.sum("_accepted").alias("a"), F.sum("_rejected").alias("r")).collect()
    a, r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not a or not r:
        return None
    by = {x["b"]: (x["a"], x["r"]) for x in rows}
    best, lost, passed = [], 0, r  # below the threshold: accepted that are lost; above: rejected that pass
    for b in range(-SPAN * GRID, SPAN * GRID + 2):
        error = lost / a + passed / r
        if not best or error < best[0] - 1e-12:
            best = [error, b, b]
        elif error <= best[0] + 1e-12 and best[2] == b - 1:
            best[2] = b
        x = by.get(b, (0, 0))
        lost, passed = lost + x[0], passed - x[1]
    return (best[1] + best[2]) / 2 / GRID


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "_r.rule", "_r.action", F.concat(F.lit("^"), "host", "path", F.lit("$")).alias("_key"))
    hit = lambda action: F.sum(F.when(F.col("action") == action, 1).otherwise(0))
    texts = cut(rows.groupBy("_key").agg(hit("allow").alias("_accepted"), hit("block").alias("_rejected")))
    named = texts.withColumn("_text", F.col("_key"))
    table = cut(log_ratios(named.filter("_accepted + _rejected > 0").drop("_key")))
    small = table.count() <= BROADCAST_ROWS
    found = grams(named.select("_key", "_text")).join(F.broadcast(table) if small else table, "gram")
    sums = found.groupBy("_key").agg(F.sum("delta").alias("_sum"))
    scores = cut(texts.join(sums, "_key", "left").select("_key", "_accepted", "_rejected", F.round(F.coalesce("_sum", F.lit(0.0)) / (F.length("_key") - 1), 9).alias("_score")))
    limit = threshold(scores)
    says = F.lit("allow") if limit is None else F.when(F.col("_score") >= limit, "allow").otherwise("block")
    return rows.join(scores.select("_key", "_score"), "_key").select("page_id", "host", "path", "rule", F.coalesce("action", says).alias("verdict"), F.col("_score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))
