"""Soft-membership mixing: domain posteriors, then document rates that meet target weights.

All of it is DataFrame and SQL expressions; what reaches the driver is a matrix with a row
for each domain. With t tokens and posterior p(d) for each document, rates r >= 0 are sought
whose expected domain totals, the sums of r * t * p(d), equal the targets. Projected gradient
starts at r = 1 and repeats r = max(0, r - sum_d g(d) p(d)), where g is the residual scaled
by the inverse of the domains' products over the documents whose rate is positive; a step
that brings the totals no nearer is halved and tried again.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.workspace import Workspace

log = logging.getLogger(__name__)
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: At most about this many labelled documents teach the classifier, chosen by hash.
MAX_LABELLED = 20_000
#: Words that the classifier may know, those that tell most first; this bounds what is broadcast
#: (some 60 bytes a word).
MAX_WORDS = 1 << 16
MIN_WORD_DOCS = 5
#: Least sum of squared deviations from the domains' shares of all words, in variances.
MIN_CHI2 = 40.0
#: Weight of the prior share in the estimate of a domain given a word.
SHRINK = 20.0
MAX_DOMAINS = 64
MAX_STEPS = 30
#: Steps end when no domain total is further from its target than this share of all tokens.
TOLERANCE = 1e-7


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _chosen(labelled: DataFrame, most: int) -> DataFrame:
    total = labelled.count()
    if total <= most:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1e6 * most / total))


def word_weights(docs: DataFrame, labelled: DataFrame, work: Workspace) -> tuple[list[str], list[float], DataFrame | None]:
    """Domains, the log weight of each for a text without any told word, and (word, w0, w1, ...)
    with what the word adds for each domain.
    """
    taught = labelled.where(F.col("domain").isNotNull() & F.col("_id").isNotNull()).distinct()
    taught = work.table(_chosen(taught, MAX_LABELLED), "taught")
    sizes = {r[0]: r[1] for r in taught.groupBy("domain").count().limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(sizes)
    prior = [sizes[d] / sum(sizes.values()) for d in domains]
    if not domains:
        return [], [], None
    seen = (
        docs.join(F.broadcast(taught), "_id")
        .select("domain", F.explode(F.array_distinct(_words(F.col("_text")))).alias("word"))
        .groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    )
    n = [F.col(f"n{i}") for i in range(len(domains))]
    every = sum(n[1:], n[0])
    seen = work.table(seen.where(every >= MIN_WORD_DOCS), "seen")
    sums = seen.agg(*[F.sum(x) for x in n]).first()
    share = [float(x or 0) for x in sums]
    share = [(x + 1.0) / (sum(share) + len(share)) for x in share]
    apart = [(x - every * q) * (x - every * q) / (every * q * (1 - q) + 1e-9) for x, q in zip(n, share)]
    ratio = [F.log((x + SHRINK * q) / (every + SHRINK) / q) for x, q in zip(n, share)]
    # a domain's share of texts with the word; a word that is absent speaks too
    has = [F.least(F.exp(w) * every / float(sum(sizes.values())), F.lit(0.95)) for w in ratio]
    best = (
        seen.select("word", *[(w - F.log1p(-h)).alias(f"w{i}") for i, (w, h) in enumerate(zip(ratio, has))],
                    *[F.log1p(-h).alias(f"a{i}") for i, h in enumerate(has)], F.round(sum(apart[1:], apart[0]), 6).alias("apart"))
        .where(F.col("apart") >= MIN_CHI2)
        .orderBy(F.desc("apart"), "word").limit(MAX_WORDS).drop("apart")
    )
    words = work.table(best, "words")
    absent = words.agg(*[F.sum(F.round(f"a{i}", 9)) for i in range(len(domains))]).first()
    base = [float(np.log(q)) + (x or 0.0) for q, x in zip(prior, absent)]
    return domains, base, words.drop(*[f"a{i}" for i in range(len(domains))])


def posteriors(docs: DataFrame, labelled: DataFrame, work: Workspace) -> tuple[list[str], DataFrame]:
    """(_id, _hash, tokens, copies, p0, p1, ...): one row for each distinct id and text."""
    domains, base, words = word_weights(docs, labelled, work)
    rows = docs.select(
        "_id", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row"),
        _words(F.col("_text")).alias("_words"),
    ).select("_id", "_hash", "_row", F.size("_words").cast("long").alias("tokens"), F.array_distinct("_words").alias("_words"))
    keys = ["_id", "_hash", "tokens"]
    if words is None:
        scored = rows.select(*keys, "_row")
    else:
        scored = (
            rows.select(*keys, "_row", F.explode_outer("_words").alias("word"))
            .join(F.broadcast(words), "word", "left")
            .groupBy(*keys, "_row")
            .agg(*[F.coalesce(F.sum(F.round(f"w{i}", 9)), F.lit(0.0)).alias(f"s{i}") for i in range(len(domains))])
        )
    logit = [F.lit(x) + F.col(f"s{i}") for i, x in enumerate(base)]
    top = F.greatest(*logit) if len(logit) > 1 else (logit or [F.lit(0.0)])[0]
    raised = [F.exp(x - top) for x in logit]
    once = scored.groupBy(*keys).agg(F.count("*").alias("copies"), *[F.min(f"s{i}").alias(f"s{i}") for i in range(len(domains))])
    out = once.select(*keys, "copies", *[(x / sum(raised[1:], raised[0])).alias(f"p{i}") for i, x in enumerate(raised)])
    return domains, work.table(out, "posteriors")


def _rate(steps: list[np.ndarray]) -> Column:
    rate = F.lit(1.0)
    for g in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(float(v)) * F.col(f"p{i}") for i, v in enumerate(g)), F.lit(0.0)))
    return rate


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[Column, float]:
    """The rate of each row of a posterior table, as an expression of its posteriors.

    And how far the furthest domain total is from its target, as a share of all tokens.
    """
    n = len(domains)
    weight = F.col("copies") * F.col("tokens")
    pairs = [(a, b) for a in range(n) for b in range(a + 1)]

    def measure(rate: Column) -> tuple[np.ndarray, np.ndarray, float]:
        live = F.when(rate > 0, weight).otherwise(0)
        found = table.agg(
            F.sum(weight),
            *[F.sum(weight * F.col(f"p{i}") * rate) for i in range(n)],
            *[F.sum(live * F.col(f"p{a}") * F.col(f"p{b}")) for a, b in pairs],
        ).first()
        have = np.array([float(x or 0) for x in found[1 : n + 1]])
        metric = np.zeros((n, n))
        for (a, b), x in zip(pairs, found[n + 1 :]):
            metric[a, b] = metric[b, a] = float(x or 0)
        return have, metric, float(found[0] or 0)

    have, metric, total = measure(F.lit(1.0))
    if not n or not total:
        return F.lit(1.0), 0.0
    wanted = np.array([targets.get(d, 0.0) for d in domains])
    wanted = total * wanted / wanted.sum()
    steps: list[np.ndarray] = []
    worst, size = float(np.abs(have - wanted).max()) / total, 1.0
    for _ in range(MAX_STEPS):
        if worst < TOLERANCE or size < 2.0**-8:
            break
        step = size * np.linalg.solve(metric + np.eye(n) * 1e-6 * total, have - wanted)
        now_have, now_metric, _ = measure(_rate([*steps, step]))
        now = float(np.abs(now_have - wanted).max()) / total
        if now >= worst:
            size /= 2
            continue
        steps.append(step)
        have, metric, worst, size = now_have, now_metric, now, min(1.0, 2 * size)
    if worst >= TOLERANCE:
        log.warning("rates leave a domain %.2g of all tokens from its target after %d steps", worst, len(steps))
    return _rate(steps), worst


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Rates that turn the domain shares of ``docs`` into ``targets``.

    ``labelled`` is (id, domain); ``targets`` gives each domain's weight, and a domain of the
    labelled table that it leaves out has weight zero. Returns one row for each input row: id,
    the columns named in ``keep``, ``tokens``, ``posterior`` (an array ordered as the sorted
    domain names), ``rate`` (how often the document is to be read on average) and ``copies``
    (the rate rounded down or up by a hash of the document, so that copies add up to rates), and
    ``residual``, how far the furthest domain total is from its target, as a share of all tokens.

    A null or empty text has no tokens; its posterior is that of a text without told words. Repeated rows count as
    often as they occur and share a rate. A label for a null id, or a null domain, teaches
    nothing. Without labels or tokens every rate is one. A target for a domain without a
    labelled document is an error; an empty target table is one too. Targets that nonnegative
    rates cannot meet are met as closely as the projected steps come.
    """
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative weights with a positive sum")
    work = Workspace(docs.sparkSession, "mixing")
    carried = [c for c in (keep or []) if c != id_col]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    domains, table = posteriors(base, labelled.toDF("_id", "domain"), work)
    if domains and (missing := {d for d, w in targets.items() if w} - set(domains)):
        raise ValueError(f"no labelled document of {sorted(missing)}")
    n = len(domains)
    rate, residual = fit_rates(table, domains, targets)
    part = F.pmod(F.xxhash64("_id", "_hash", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    rated = table.select(
        F.col("_id").alias("_rated_id"), F.col("_hash").alias("_rated_hash"), "tokens",
        F.array(*[F.col(f"p{i}") for i in range(n)]).cast("array<double>").alias("posterior"),
        rate.alias("rate"), part.alias("_part"),
    )
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"),
        F.struct(*carried).alias("_carried") if carried else F.lit(None).cast("string").alias("_carried"),
    )
    out = rows.join(rated, F.col("_id").eqNullSafe(F.col("_rated_id")) & (F.col("_hash") == F.col("_rated_hash")))
    return out.select(
        F.col("_id").alias(id_col), *[F.col(f"_carried.{c}").alias(c) for c in carried], "tokens", "posterior", "rate",
        (F.floor("rate") + (F.col("_part") < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
        F.lit(residual).alias("residual"),
    )


#: Weights of the domains that the labels table tells apart.
TARGETS = {"clean": 0.90, "junk": 0.04, "toxic": 0.06}
#: The same for documents from which junk has been taken.
FILTERED_TARGETS = {"clean": 0.93, "toxic": 0.07}


def label_domains(spark: SparkSession, sf_dir: str, junk: bool = True) -> DataFrame:
    """(doc_id, domain) of the labels table; without ``junk``, by toxicity alone."""
    toxic = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, toxic) if junk else toxic
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain.alias("domain"))


def mix_filtered(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """``mix`` for filtered documents; domains without a labelled document among them have no target."""
    labelled = label_domains(spark, sf_dir, junk=False)
    known = {r[0] for r in docs.select("doc_id").join(labelled, "doc_id").select("domain").distinct().collect()}
    targets = {d: w for d, w in FILTERED_TARGETS.items() if d in known} or FILTERED_TARGETS
    return mix(docs, labelled, targets, keep=keep)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), label_domains(spark, sf_dir), TARGETS)
