"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A classifier learned from a labelled table gives every document a posterior over the domains.
Nonnegative rates, one per document, are then fitted so that the expected tokens of each domain
(rate * tokens * posterior, summed) match the targets in least squares, by projected gradient.

* The classifier counts words in ``BUCKETS`` buckets made from their first three characters and
  their length. It is fitted on at most ``LABELLED`` labelled documents, those whose ids have the
  smallest md5; everything else covers all rows. Log probabilities are whole millionths, so sums
  do not depend on the order of rows. A text speaks with at most ``EVIDENCE`` words.
* Posteriors are kept in thousandths. With A_d the tokens of a domain at rate 1, the step is
  ``rate <- max(0, rate - sum_d p_d (y_d - T_d) / A_d)``: the gradient of the squares weighted by
  1 / A_d, in the metric of the documents' tokens, where the largest curvature is 1. So a rate
  depends on the posterior alone. Each step sums over one row per distinct posterior and brings
  one number per domain to the driver; documents replay the steps, so nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.session import written

BUCKETS = 1024
LABELLED = 20_000
EVIDENCE = 32
STEPS = 30
MICRO = 1_000_000


def words_of(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and one ``bucket`` per word (``[^\\x20\\x09-\\x0D]+``)."""
    blanks = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    words = docs.select(*keys, F.explode(F.split(blanks, " ")).alias("w")).where("w <> ''")
    letters = [F.ascii(F.substring("w", k, 1)) for k in (1, 2, 3)]
    code = letters[0] * 961 + letters[1] * 31 + letters[2] + F.length("w") * 7
    return words.select(*keys, F.pmod(code, F.lit(BUCKETS)).alias("bucket"))


def _per_domain(domains: list[str], make) -> list[Column]:
    return [make(d, k) for k, d in enumerate(domains)]


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """One row per bucket with whole log probabilities ``l0, l1, ...``; bucket -1 has the priors.

    The ids of the sample are broadcast: ``LABELLED`` rows at most.
    """
    sample = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(LABELLED)
    )
    sample = written(sample, "sample")
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    hits = _per_domain(domains, lambda d, k: F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}"))
    counts = written(words_of(seen, "domain").groupBy("bucket").agg(*hits), "bucket_counts")
    totals = counts.agg(*_per_domain(domains, lambda d, k: F.coalesce(F.sum(f"c{k}"), F.lit(0)))).first()
    sizes = sample.agg(*hits).first()

    def log(numerator: Column, denominator: int) -> Column:
        return F.round(F.ln(numerator / F.lit(float(denominator))) * MICRO).cast("long")

    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket",
        *_per_domain(
            domains,
            lambda d, k: log(F.coalesce(f"c{k}", F.lit(0)) + F.lit(1.0), totals[k] + BUCKETS).alias(f"l{k}"),
        ),
    )
    documents = sum(sizes) + len(domains)
    prior = docs.sparkSession.range(1).select(
        F.lit(-1).alias("bucket"),
        *_per_domain(domains, lambda d, k: log(F.lit(float(sizes[k] + 1)), documents).alias(f"l{k}")),
    )
    return filled.union(prior)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """doc_id, n_tokens and, in thousandths, the posterior ``p0, p1, ...`` of the domains."""
    model = written(fit_classifier(docs, labelled, domains), "classifier")
    prior = model.where("bucket = -1").first()
    # The broadcast side has BUCKETS rows.
    scored = words_of(docs, "doc_id").join(F.broadcast(model.where("bucket >= 0")), "bucket")
    evidence = _per_domain(domains, lambda d, k: F.sum(f"l{k}").alias(f"s{k}"))
    spoken = scored.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), *evidence)
    silent = docs.select(
        "doc_id",
        F.lit(0).cast("long").alias("n_tokens"),
        *_per_domain(domains, lambda d, k: F.lit(0).cast("long").alias(f"s{k}")),
    )
    sums = _per_domain(domains, lambda d, k: F.sum(f"s{k}").alias(f"s{k}"))
    every = spoken.unionByName(silent).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), *sums)
    share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest("n_tokens", F.lit(1)))
    logs = _per_domain(domains, lambda d, k: (F.col(f"s{k}") * share + prior[f"l{k}"]) / MICRO)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    odds = every.select(
        "doc_id", "n_tokens", *_per_domain(domains, lambda d, k: F.exp(logs[k] - top).alias(f"e{k}"))
    )
    total = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return odds.select(
        "doc_id",
        "n_tokens",
        *_per_domain(
            domains, lambda d, k: F.round(F.col(f"e{k}") / total * 1000).cast("long").alias(f"p{k}")
        ),
    )


def _shares(n: int) -> list[Column]:
    total = sum((F.col(f"p{k}") for k in range(1, n)), F.col("p0"))
    return [F.col(f"p{k}") / total for k in range(n)]


def _replayed(history: list[list[float]], start: float, n: int) -> Column:
    """The rate after all steps so far, for the posterior of the row."""
    rate = F.lit(start)
    if not history:
        return rate
    shares = F.array(*_shares(n))
    steps = F.lit([[float(x) for x in step] for step in history])
    move = lambda g: F.aggregate(
        F.zip_with(shares, g, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x
    )
    return F.aggregate(steps, rate, lambda r, g: F.greatest(F.lit(0.0), r - move(g)))


def fit_rates(members: DataFrame, weights: list[float], steps: int = STEPS) -> tuple[list[list[float]], float]:
    """The steps of the projected gradient and the rate that it starts from."""
    n = len(weights)
    keys = [f"p{k}" for k in range(n)]
    groups = written(members.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "posteriors")
    # Whole token counts, so that the sums are exact; shares come last.
    mass = lambda rate: [
        F.coalesce(F.sum(rate * F.col("tokens") * p), F.lit(0.0)) for p in _shares(n)
    ]
    at_one = list(groups.agg(*mass(F.lit(1.0))).first())
    total = sum(at_one)
    targets = [w / sum(weights) * total for w in weights]
    history: list[list[float]] = []
    for _ in range(steps if total else 0):
        now = groups.agg(*mass(_replayed(history, 1.0, n))).first()
        history.append([(y - t) / a if a else 0.0 for y, t, a in zip(now, targets, at_one, strict=True)])
    return history, 1.0


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], steps: int = STEPS) -> DataFrame:
    """doc_id, n_tokens, one ``p_<domain>`` in thousandths per target, and the rate.

    ``labelled(doc_id, domain)`` names the domain of some documents; ``targets`` the wanted share
    of tokens per domain, out of as many tokens as there are. Labels of other domains are passed
    over; of several labels of a document the first in order counts.

    Rows that share a ``doc_id`` are one document with all their words, rows without one together
    as well, so each id has one row here. A null or empty text has no tokens and the prior as its
    posterior. A domain without labels or tokens cannot be reached: the others still are, as well
    as least squares allow. Other columns are ignored; an empty table gives an empty one.
    """
    domains = list(targets)
    members = written(posteriors(docs, labelled, domains), "members")
    history, start = fit_rates(members, list(targets.values()), steps)
    return members.select(
        "doc_id",
        "n_tokens",
        *_per_domain(domains, lambda d, k: F.col(f"p{k}").alias(f"p_{d}")),
        _replayed(history, start, len(domains)).alias("rate"),
    )


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as their rate says, its fraction decided by a hash of the id.

    ``rates(doc_id, rate)`` has each id once; rows without an id go by the rate of the null id, and rows whose
    id has no rate are left out. Repeated rows are each taken as often. Texts may be null or empty; all columns
    are carried along, whatever their names; an empty table gives an empty one.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rate = rates.select(F.col("doc_id").alias("rated"), "rate")
    rows = docs.select(F.col("doc_id").alias("id"), every.alias("row"))
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    taken = rows.join(rate, F.col("id").eqNullSafe(F.col("rated"))).withColumn("times", times)
    copies = taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
