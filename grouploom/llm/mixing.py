"""Mixing documents to target weights by soft domain membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of the labelled table,
gives every document a posterior over domains. Documents then get nonnegative rates r for which
the expected tokens of each domain, the sum of r * tokens * posterior, match the targets in the
least-squares sense. The rates are found by projected gradient steps over the distributed table:
a step is scaled by the domains-by-domains Gram matrix of the documents that are not at their
bound, and halved while the error does not fall. Only sums over domains reach the driver.

DataFrame functions only. Sums of a document's words collapse map-side before the shuffle.

The fit ends when the targets are met, or no step brings them nearer; it returns how far they are
missed (as they must be where no rates exist that meet them), and warns beyond one percent. Any
number of domains works; a step costs the square of it in sums per document.

Defined results: null and empty texts have 0 tokens, the prior as posterior, and count for no
domain. A word weighs as much as another one up to ``EVIDENCE`` words; the words of longer texts,
very long ones included, are all counted and weighed down to as many. Of equally likely domains the
first by name is named. An empty table gives no rows. Labelled rows whose domain is null are left out; without labelled rows there is one domain.
Targets of domains that no labelled row has are dropped and the others scaled up; domains without
a target have target 0. Repeated rows are documents of their own. Extra columns take no part.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, fresh, saved, table

#: Labelled rows that a fit uses at most; their ids are broadcast.
SAMPLE = 20_000
#: Word hash buckets: the weight table has at most BUCKETS rows, and is broadcast.
BUCKETS = 8192
#: Words of a text that count as independent evidence; longer texts are tempered to as many.
EVIDENCE = 60
STEPS = 12
#: Times its tokens that a corpus may grow where documents are repeated towards targets.
MOST_GROWTH = 8.0

TARGETS = {"en:1": 0.46, "de:1": 0.18, "fr:1": 0.18, "es:1": 0.14, "en:0": 0.01, "de:0": 0.01, "fr:0": 0.01, "es:0": 0.01}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), WHITE + "+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame) -> tuple[list[str], DataFrame, list[float], list[float]]:
    """Domains in order, the table bucket -> w (log likelihood of each domain), log priors,
    log likelihoods of buckets that the sample lacks.

    ``labelled`` has labelled_id and domain; the rows with the least hash of their id are used."""
    sample = labelled.where("domain IS NOT NULL AND labelled_id IS NOT NULL").orderBy(F.xxhash64("labelled_id"), "labelled_id", "domain").limit(SAMPLE)
    sample = saved(sample, "sample")
    found = sample.groupBy("domain").count().orderBy("domain").collect()
    domains = [r["domain"] for r in found] or ["all"]
    sizes = [r["count"] for r in found] or [1]
    number = F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))])
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"))
    counts = chosen.select(number[F.col("domain")].alias("k"), F.explode(_words(F.col("text"))).alias("w")).groupBy("k", _bucket(F.col("w")).alias("bucket")).count()
    wide = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("k") == k, F.col("count")).otherwise(0)).alias(f"c{k}") for k in range(len(domains))])
    wide = saved(wide, "counts")
    totals = wide.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(len(domains))]).first()
    weights = wide.select("bucket", *[F.log((F.col(f"c{k}") + 0.5) / (totals[k] + 0.5 * BUCKETS)).alias(f"w{k}") for k in range(len(domains))])
    return domains, weights, list(np.log(np.array(sizes) / sum(sizes))), [float(np.log(0.5 / (t + 0.5 * BUCKETS))) for t in totals]


def posteriors(docs: DataFrame, domains: list[str], weights: DataFrame, priors: list[float], unseen: list[float]) -> DataFrame:
    """row, doc_id, n_tokens, p0..: soft membership of every row of ``docs``."""
    ks = range(len(domains))
    # numbered before the words are spread out
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = rows.select("row", "doc_id", F.explode_outer(_words(F.col("text"))).alias("w"))
    sums = (
        words.select("row", "doc_id", F.col("w").isNotNull().alias("is_word"), _bucket(F.col("w")).alias("bucket"))
        .join(F.broadcast(weights), "bucket", "left").groupBy("row", "doc_id")
        .agg(F.count_if("is_word").alias("n_tokens"), *[F.sum(F.when(F.col("is_word"), F.coalesce(f"w{k}", F.lit(unseen[k])))).alias(f"s{k}") for k in ks])
    )
    temper = F.lit(EVIDENCE) / F.greatest(F.col("n_tokens"), F.lit(EVIDENCE))
    scores = sums.select("row", "doc_id", "n_tokens", *[(F.lit(priors[k]) + F.coalesce(f"s{k}", F.lit(0.0)) * temper).alias(f"z{k}") for k in ks])
    top = F.greatest(*[f"z{k}" for k in ks]) if len(domains) > 1 else F.col("z0")
    raised = scores.select("row", "doc_id", "n_tokens", *[F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in ks])
    total = sum((F.col(f"e{k}") for k in ks), F.lit(0.0))
    return raised.select("row", "doc_id", "n_tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in ks])


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], least: float = 0.0, most: float = MOST_GROWTH) -> tuple[DataFrame, float]:
    """``members`` with a column rate >= ``least``, and the largest miss of a target, as a share of
    all wanted tokens. With ``least`` 0 the targets add up to all
    tokens; with 1 to as many as make every domain's target at least what it has, ``most`` times all
    tokens at the most. The fit ends when the targets are met, when no step brings them nearer, and after
    ``STEPS`` steps; what is missed by then is returned, and a miss of over a hundredth is a warning.

    A trial step is one aggregate over the table of the last step; only steps that are taken are written."""
    ks = range(len(domains))
    p = [F.col(f"p{k}") for k in ks]
    n = F.col("n_tokens").cast("double")
    share = np.array([targets.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() else np.full(len(domains), 1 / len(domains))
    pairs = [(i, j) for i in ks for j in range(i + 1)]

    def sums(state: DataFrame):
        free = F.when(F.col("rate") > least, n).otherwise(0.0)
        row = state.agg(*[F.coalesce(F.sum(n * F.col("rate") * x), F.lit(0.0)) for x in p], *[F.coalesce(F.sum(free * p[i] * p[j]), F.lit(0.0)) for i, j in pairs]).first()
        gram = np.zeros((len(domains), len(domains)))
        for (i, j), v in zip(pairs, row[len(domains) :], strict=True):
            gram[i, j] = gram[j, i] = v
        return np.array(row[: len(domains)]), gram

    state = members.withColumn("rate", F.lit(1.0 if least <= 1 else float(least)))
    have, gram = sums(state)
    want = share * (min(max(h / s for h, s in zip(have, share, strict=True) if s), most * have.sum()) if least else have.sum())
    if least and have.sum():  # begin away from the bound, with the right number of tokens in all
        state = members.withColumn("rate", F.lit(max(float(least), float(want.sum() / have.sum()))))
        have, gram = sums(state)
    scale = max(want.sum(), 1.0)
    error = float((((have - want) / scale) ** 2).sum())
    for _ in range(STEPS):
        step = np.linalg.lstsq(gram + np.eye(len(domains)) * 1e-9 * max(gram.trace(), 1.0), have - want, rcond=None)[0]
        size = 1.0
        while size > 1e-3:
            moved = F.greatest(F.lit(float(least)), F.col("rate") - sum((F.lit(float(size * c)) * x for c, x in zip(step, p, strict=True)), F.lit(0.0)))
            next_state = state.withColumn("rate", moved)
            next_have, next_gram = sums(next_state)
            next_error = float((((next_have - want) / scale) ** 2).sum())
            if next_error < error:
                break
            size /= 2
        else:
            break
        gain, state, have, gram, error = error - next_error, saved(next_state, "rates"), next_have, next_gram, next_error
        if error < 1e-10 or gain < 1e-3 * error:
            break
    missed = float(np.abs((have - want) / scale).max())
    if missed > 0.01:
        warnings.warn(f"mixing misses a target by {missed:.2%} of the tokens", stacklevel=2)
    return state, missed


def fitted_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, most: float = MOST_GROWTH) -> tuple[list[str], DataFrame, float]:
    """Domains in order, rates of all rows of ``docs``, and the largest miss of a target."""
    domains, weights, priors, unseen = fit_domains(docs, labelled)
    members = saved(posteriors(docs, domains, weights, priors, unseen), "members")
    return domains, *fit_rates(members, domains, targets, least, most)


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0) -> tuple[list[str], DataFrame]:
    """Domains in order and rates of all rows of ``docs``."""
    return fitted_rates(docs, labelled, targets, least)[:2]


def labelled_domains(docs: DataFrame, labels: DataFrame, with_quality: bool) -> DataFrame:
    """Labelled ids with their document's language, and their quality if wanted, as domain."""
    tagged = docs.select("doc_id", "lang").join(labels.select(F.col("doc_id").alias("labelled_id"), "quality").where("quality IS NOT NULL"), F.col("doc_id") == F.col("labelled_id"))
    domain = F.concat(F.col("lang"), F.lit(":"), F.col("quality").cast("string")) if with_quality else F.col("lang")
    return tagged.select("labelled_id", domain.alias("domain"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domains, rates = mixed_rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels"), True), TARGETS)
    best = F.array_position(F.array(*[f"p{k}" for k in range(len(domains))]), F.greatest(*[f"p{k}" for k in range(len(domains))]) if len(domains) > 1 else F.col("p0"))
    return rates.select("doc_id", "n_tokens", F.element_at(F.array(*[F.lit(d) for d in domains]), best.cast("int")).alias("domain"), F.array(*[f"p{k}" for k in range(len(domains))]).alias("membership"), "rate")


def repeated_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float = MOST_GROWTH) -> DataFrame:
    """``docs`` with every row at least once, and repeated so that expected domain tokens match the
    targets: a rate's fraction is rounded up for a hash-chosen share of documents. All tokens grow to
    ``most`` times as many at the most; targets that this leaves out of reach are a warning."""
    _, rates, _ = fitted_rates(docs, labelled, targets, 1.0, most)
    own, share, copy = fresh(docs, "own_id"), fresh(docs, "own_rate"), fresh(docs, "copy")
    chance = F.pmod(F.xxhash64(own, F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    rates = rates.groupBy(F.col("doc_id").alias(own)).agg(F.avg("rate").alias(share))
    copies = F.greatest(F.lit(1), F.floor(F.coalesce(share, F.lit(1.0)) + F.coalesce(chance, F.lit(0.0)))).cast("int")
    joined = docs.join(rates, docs.doc_id == F.col(own), "left")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies)).alias(copy)).drop(copy)
