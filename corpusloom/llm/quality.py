"""Quality rules: robust multivariate outliers among vectors of text statistics.

Each document becomes a vector of transformed statistics. For every language and source a minimum-covariance-determinant
estimate of location and scatter is found by deterministic starts and concentration steps, all of them grouped
aggregates over every document: no group is ever held by one task, so a hot source costs no more than its rows. A group takes steps until its
determinant falls no more.
A document goes when its squared Mahalanobis distance exceeds the chi-square quantile.

Defined results: null, empty and blank texts have no statistics, so they are rejected; null language or source is a group of its
own; groups below ``min_group`` documents share the estimate of those of their language, then of all such; the fewer documents an estimate is from, the
wider it is taken to be, down to a single one, which is its own centre; at equal determinants the first start counts; repeated rows get the same answer and are all kept or all rejected; further columns pass through.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, fresh, normal_key, read_table, with_column

NAMES = ("symbol", "plain", "caps", "repeat3", "repeat1", "digit", "length")
D = len(NAMES)
#: What a share of typical prose is, and as how many words it counts: short texts move towards it instead of being outliers.
PRIOR = {"symbol": 0.02, "plain": 0.88, "caps": 0.002, "repeat3": 0.002, "repeat1": 0.002, "digit": 0.002, "length": 5.0}
PRIOR_WORDS = 25.0
#: Least standard deviation of each transformed statistic; below it, differences have no meaning for quality.
FLOOR = np.array([0.03, 0.04, 0.05, 0.06, 0.05, 0.09, 0.10])
KEEP_SHARE = 0.75
MIN_GROUP = 60
#: So many documents of the least scatter are counted with those of a group.
FLOOR_DOCS = 30.0
QUANTILE = 1 - 1e-8
_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_DIGITS = b"0123456789"


def statistics(text: str | None) -> list[float] | None:
    """The transformed vector of one text; None for a text without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    chars = sum(map(len, words))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    plain = sum(map(str.isalpha, words))
    caps = sum(1 for w in words if len(w) > 1 and w.isupper())
    once = sum(map(eq, words, words[1:]))
    three = max(n - 2, 0) - len(set(zip(words, words[1:], words[2:])))
    m = PRIOR_WORDS
    shares = (
        (symbols + m * 5 * PRIOR["symbol"]) / (chars + m * 5),
        (plain + m * PRIOR["plain"]) / (n + m),
        (caps + m * PRIOR["caps"]) / (n + m),
        (three + m * PRIOR["repeat3"]) / (n + m),
        (once + m * PRIOR["repeat1"]) / (n + m),
        (digits + m * 5 * PRIOR["digit"]) / (chars + m * 5),
    )
    return [math.asin(math.sqrt(min(1.0, s))) for s in shares] + [math.log((chars + m * PRIOR["length"]) / (n + m))]


def _add_statistics(name: str):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.append_column(name, pa.array([statistics(x) for x in b.column(at).to_pylist()], pa.list_(pa.float64())))

    return run


def chi2_cdf(x: float, k: float) -> float:
    """By the series of the regularised lower incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    i = 1
    while term > total * 1e-17 and i < 10_000:
        term *= x / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(alpha: float, d: int = D) -> float:
    """Factor that makes the scatter of the central share alpha consistent at the normal distribution."""
    return alpha / chi2_cdf(chi2_quantile(alpha, d), d + 2)


def _regular(cov: np.ndarray) -> np.ndarray:
    """Scatter with the floor added, so that a constant statistic doesn't make it singular."""
    return cov + np.diag(FLOOR**2)


def widened(prec: np.ndarray, n: float) -> np.ndarray:
    """The inverse scatter that documents are judged by: the fewer a group has, the more of the floor is added once more."""
    return np.linalg.inv(np.linalg.inv(prec) + np.diag(FLOOR**2) * FLOOR_DOCS / n)


def _judging(batches):
    for rows in batches:
        rows["prec"] = [widened(np.array(p).reshape(D, D), n).ravel().tolist() for p, n in zip(rows.prec, rows.n)]
        yield rows


def _limits(best: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2, mu, prec for each language and source."""
    return scratch.table(best.mapInPandas(_judging, best.schema).select("k1", "k2", "mu", "prec"), "limits")


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_PARAM = "g string, start int, n long, mu array<double>, prec array<double>, logdet double"


def _params(rows: pd.DataFrame, scale: float) -> pd.DataFrame:
    """Location and inverse scatter from sums of x and of x x'."""
    out = []
    for r in rows.itertuples(index=False):
        m = float(r.m)
        s = np.array(r.s, float)
        mu = s[:D] / m
        cov = np.zeros((D, D))
        for (i, j), v in zip(_PAIRS, s[D:]):
            cov[i, j] = cov[j, i] = v / m - mu[i] * mu[j]
        cov = _regular(cov * scale)
        out.append((r.g, r.start, r.n, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
    return pd.DataFrame(out, columns=["g", "start", "n", "mu", "prec", "logdet"])


def _distance(x, mu, prec):
    diff = [x[i] - mu[i] for i in range(D)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + diff[i] * diff[j] * prec[i * D + j] * (1.0 if i == j else 2.0)
    return total


def _sums(weight, x):
    """Sums of x and of the upper half of x x' as one array."""
    return F.array(*[F.sum(weight * x[i]) for i in range(D)], *[F.sum(weight * x[i] * x[j]) for i, j in _PAIRS])


def fit(spark: SparkSession, docs: DataFrame, scratch: Scratch, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """(statistics of every document, one row per language and source with its estimate: k1, k2, g, mu, prec)."""
    cols = docs.select("doc_id", "text", "lang", "source")
    stats = (
        cols.mapInArrow(_add_statistics("x"), with_column(cols.schema, ("x", "array<double>")))
        .select("doc_id", "lang", "source", normal_key("lang").alias("k1"), normal_key("source").alias("k2"), "x")
    )
    stats = scratch.table(stats, "stats")
    sizes = stats.filter("x is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"))
    by_lang = sizes.filter(F.col("n") < min_group).groupBy("k1").agg(F.sum("n").alias("n1"))
    groups = sizes.join(by_lang, "k1", "left").select(
        "k1",
        "k2",
        F.when(F.col("n") >= min_group, F.concat(F.lit("s"), "k1", F.lit(" "), "k2"))
        .when(F.col("n1") >= min_group, F.concat(F.lit("l"), "k1"))
        .otherwise("a")
        .alias("g"),
    )
    groups = scratch.table(groups, "groups")
    x = scratch.table(stats.filter("x is not null").join(groups, ["k1", "k2"]).select("g", "x"), "vectors")

    # two deterministic starts: bounded scores and signs about the coordinatewise median
    centre = x.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 10000) for i in range(D)]).alias("med"))
    spread = (
        x.join(centre, "g").groupBy("g", "n", "med")
        .agg(F.array(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("med")[i]), 0.5, 10000) for i in range(D)]).alias("mad"))
    )
    spread = scratch.table(spread, "spread")
    z = [(F.col("x")[i] - F.col("med")[i]) / F.sqrt(F.pow(F.col("mad")[i] * 1.4826, 2) + float(FLOOR[i] ** 2)) for i in range(D)]
    z = x.join(spread, "g").select("g", "n", "med", "mad", F.array(*z).alias("z"))
    z = z.withColumn("norm", F.sqrt(F.aggregate("z", F.lit(1e-12), lambda a, b: a + b * b)))
    starts = F.array(F.transform("z", lambda c: F.tanh(c)), F.transform("z", lambda c: c / F.col("norm")))
    scored = z.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).select("g", "n", "med", "mad", "start", starts[F.col("start")].alias("y"))
    first = scored.groupBy("g", "start", "n", "med", "mad").agg(F.count("*").alias("m"), _sums(F.lit(1.0), F.col("y")).alias("s"))

    def begin(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                s = np.array(r.s, float) / r.m
                cor = np.zeros((D, D))
                for (i, j), v in zip(_PAIRS, s[D:]):
                    cor[i, j] = cor[j, i] = v - s[i] * s[j]
                sd = np.sqrt(np.diag(cor) + 1e-9)
                scale = np.sqrt((np.array(r.mad) * 1.4826) ** 2 + FLOOR**2)
                cov = cor / np.outer(sd, sd) * np.outer(scale, scale)
                cov = _regular(cov)
                out.append((r.g, r.start, r.n, list(r.med), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["g", "start", "n", "mu", "prec", "logdet"])

    params = scratch.table(first.mapInPandas(begin, _PARAM), "params0")
    scale = consistency(KEEP_SHARE)

    def concentrate(batches):
        for rows in batches:
            yield _params(rows, scale)

    # each group goes on until neither of its starts gets a smaller determinant: whatever the rounding, that comes to an end
    params, step = params.withColumn("open", F.lit(True)), 0
    while params.filter("open").limit(1).count():
        step += 1
        now = params.filter("open")
        d = x.join(now.select("g", "start", "n", "mu", "prec"), "g").select("g", "start", "n", "x", _distance(F.col("x"), F.col("mu"), F.col("prec")).alias("d"))
        cut = d.groupBy("g", "start").agg(F.percentile_approx("d", KEEP_SHARE, 10000).alias("cut"))
        sums = d.join(cut, ["g", "start"]).filter("d <= cut").groupBy("g", "start", "n").agg(F.count("*").alias("m"), _sums(F.lit(1.0), F.col("x")).alias("s"))
        new = sums.mapInPandas(concentrate, _PARAM).select("g", "start", F.struct("n", "mu", "prec", "logdet").alias("new"))
        smaller = F.coalesce(F.col("new.logdet") < F.col("logdet") - 1e-3, F.lit(False))
        both = params.join(new, ["g", "start"], "left").select("g", "start", F.when(smaller, F.col("new")).otherwise(F.struct("n", "mu", "prec", "logdet")).alias("p"), smaller.alias("open"))
        params = scratch.table(both.select("g", "start", "p.*", "open"), f"params{step}")
        scratch.drop(f"params{step - 1}")
    best = params.groupBy("g").agg(F.min(F.struct("logdet", "start", "n", "mu", "prec")).alias("b"))
    best = groups.join(best, "g").select("k1", "k2", "g", F.col("b.n").alias("n"), F.col("b.mu").alias("mu"), F.col("b.prec").alias("prec"))
    best = scratch.table(best, "best")
    scratch.drop("vectors")
    return stats, best


def quality_scores(spark: SparkSession, docs: DataFrame, min_group: int = MIN_GROUP, quantile: float = QUANTILE) -> DataFrame:
    """Every document with its squared distance and the decision: doc_id, lang, source, distance, keep."""
    scratch = Scratch(spark, "quality")
    stats, best = fit(spark, docs, scratch, min_group)
    best = _limits(best, scratch)
    limit = chi2_quantile(quantile, D)
    d = _distance(F.col("x"), F.col("mu"), F.col("prec"))
    return stats.join(best, ["k1", "k2"], "left").select(
        "doc_id", "lang", "source", F.when(F.col("x").isNotNull(), d).alias("distance"), F.coalesce((F.col("x").isNotNull()) & (d <= limit), F.lit(False)).alias("keep")
    )


def quality_filter(spark: SparkSession, docs: DataFrame, min_group: int = MIN_GROUP, quantile: float = QUANTILE) -> DataFrame:
    """The documents that are kept, with the columns they came with; statistics are taken again instead of moving texts."""
    scratch = Scratch(spark, "quality")
    best = _limits(fit(spark, docs, scratch, min_group)[1], scratch)
    limit = chi2_quantile(quantile, D)
    tag, k1, k2, mu, prec = (fresh(docs, f"_quality_{c}") for c in ("x", "k1", "k2", "mu", "prec"))
    best = best.select(*[F.col(a).alias(b) for a, b in (("k1", k1), ("k2", k2), ("mu", mu), ("prec", prec))])
    out = docs.mapInArrow(_add_statistics(tag), with_column(docs.schema, (tag, "array<double>"))).filter(F.col(tag).isNotNull())
    out = out.join(best, (normal_key("lang") == F.col(k1)) & (normal_key("source") == F.col(k2)), "left")
    d = _distance(F.col(tag), F.col(mu), F.col(prec))
    return out.filter(d <= limit).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass: doc_id, lang, source, distance."""
    return quality_scores(spark, read_table(spark, sf_dir, "documents")).filter("keep").drop("keep")
