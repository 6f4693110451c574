"""Mixing to target weights with soft membership: DataFrame functions only.

1. A classifier is read off a labelled table: word-bucket counts of a bounded sample of labelled documents, by domain (naive Bayes with BUCKETS
   hashed words). A document's domain posterior is the softmax of its log likelihoods, divided by the root of its word count, since words that
   follow each other are not independent evidence.
2. Each document gets a rate >= 0. The expected tokens of domain d are E_d = sum of tokens * posterior_d * rate. Projected gradient steps on the
   least squares (E - target)' G^-1 (E - target), G = sum of tokens * posterior * posterior', move every rate by its posterior's share of the residual
   and cut it at 0. One aggregate of D sums a step goes to the driver; rates stay distributed. With this weighting the step size is 1.

Domains are those of the labelled rows, at most MOST_DOMAINS. In these tables text tells the language and not the source, so the query mixes
languages; any column can be the domain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 4096
SAMPLE_DOCS = 4000
MOST_DOMAINS = 64
SMOOTHING = 0.5
#: Exponent of the default target: each domain's weight is its present share to this power.
TEMPER = 0.7
MOST_STEPS = 40
CHECKPOINT_STEPS = 8
TOLERANCE = 1e-6


def _words(docs: DataFrame, *carried: str | Column) -> DataFrame:
    """bucket of each word, and words: how many the text has. A text without words gives one row with bucket -1."""
    text = F.replace(F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    rows = docs.select(*carried, F.array_remove(F.split(text, " "), "").alias("list"))
    rows = rows.select(*[c for c in rows.columns if c != "list"], F.size("list").alias("words"), F.explode_outer("list").alias("word"))
    bucket = F.when(F.col("word").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("bucket", bucket).drop("word")


def classifier(labelled: DataFrame, domain: str) -> tuple[list[str], DataFrame]:
    """(domains, table of bucket and one log weight w0, w1, ... for each domain) from labelled rows (text, domain); NULL domains take no part.

    Without labelled rows there are no domains.
    """
    rows = labelled.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("domain"), "text")
    domains = [r[0] for r in rows.select("domain").distinct().orderBy("domain").limit(MOST_DOMAINS + 1).collect()]
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains in {domain}")
    buckets = labelled.sparkSession.range(-1, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    if not domains:
        return domains, buckets
    counts = _words(rows, "domain").where("bucket >= 0").groupBy("bucket").agg(
        F.count("*").alias("every"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)]
    )
    totals = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"t{k}") for k in range(len(domains))])
    table = buckets.join(counts, "bucket", "left").crossJoin(F.broadcast(totals))  # totals: one row
    log = lambda k: F.log((F.coalesce(f"n{k}", F.lit(0)) + SMOOTHING) / (F.col(f"t{k}") + SMOOTHING * BUCKETS))
    weight = lambda k: F.coalesce(F.when(F.col("bucket") >= 0, log(k)), F.lit(0.0))
    return domains, table.select("bucket", *[weight(k).alias(f"w{k}") for k in range(len(domains))])


def memberships(docs: DataFrame, domains: list[str], weights: DataFrame) -> DataFrame:
    """doc_id, text_hash, copies (rows that repeat both), tokens (words) and p (posterior of each domain) of each different document.

    An empty or NULL text has no tokens and equal posteriors.
    """
    d = range(len(domains))
    # BUCKETS + 1 rows: a proven bound for the broadcast
    scored = _words(docs, "doc_id", F.xxhash64("text").alias("text_hash")).join(F.broadcast(weights), "bucket")
    sums = scored.groupBy("doc_id", "text_hash", "words").agg(F.count("*").alias("seen"), *[F.sum(f"w{k}").alias(f"s{k}") for k in d])
    # a text gives as many rows as words, one at least
    each = F.greatest(F.col("words"), F.lit(1))
    copies = (F.col("seen") / each).cast("long").alias("copies")
    sums = sums.select("doc_id", "text_hash", copies, F.col("words").cast("long").alias("tokens"), *[F.col(f"s{k}") / F.sqrt(each) for k in d])
    rows = sums.select("doc_id", "text_hash", "copies", "tokens", F.array(*[F.col(f"`{c}`") / F.col("copies") for c in sums.columns[4:]]).cast("array<double>").alias("z"))
    rows = rows.select("doc_id", "text_hash", "copies", "tokens", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "text_hash", "copies", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def fitted_rates(members: DataFrame, domains: list[str], target: dict[str, float] | None = None, total_tokens: float | None = None) -> tuple[DataFrame, dict]:
    """(members with rate, report of targets and expected totals).

    target: weight of each domain (normed; missing ones 0; default: present expected shares to the power TEMPER). total_tokens: tokens of the mix;
    by default the least total at which no domain of positive weight falls below its present tokens, so that scarce domains repeat and none is cut.
    """
    n = F.col("copies") * F.col("tokens")
    d = range(len(domains))
    members = shared.checkpointed(members)
    p = [F.get("p", F.lit(k)) for k in d]
    unknown = sorted(x for x, w in (target or {}).items() if w > 0 and x not in domains)
    if unknown:
        raise ValueError(f"target domains without a labelled row: {', '.join(unknown)}")
    if not domains:
        return members.withColumn("rate", F.lit(1.0)), {"target": {}, "expected": {}, "steps": 0}
    first = members.agg(*[F.coalesce(F.sum(n * p[k]), F.lit(0.0)) for k in d], *[F.coalesce(F.sum(n * p[j] * p[k]), F.lit(0.0)) for j in d for k in d]).first()
    present, gram = np.array(first[: len(domains)]), np.array(first[len(domains) :]).reshape(len(domains), -1)
    if target is None:
        share = present / max(present.sum(), 1e-12)
        target = dict(zip(domains, share**TEMPER))
    weight = np.array([max(0.0, float(target.get(x, 0.0))) for x in domains])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(domains), 1 / len(domains))
    if total_tokens is None:
        total_tokens = max((present[k] / weight[k] for k in d if weight[k] > 0), default=0.0)
    aim = weight * total_tokens
    inverse = np.linalg.pinv(gram + np.eye(len(domains)) * 1e-9 * max(np.trace(gram), 1e-12))
    rated, rate, steps, expected = members.withColumn("rate", F.lit(1.0)), F.col("rate"), 0, present
    while steps < MOST_STEPS and np.abs(expected - aim).max() > TOLERANCE * max(1.0, total_tokens):
        move = inverse @ (expected - aim)
        shift = p[0] * F.lit(float(move[0]))
        for k in d[1:]:
            shift = shift + p[k] * F.lit(float(move[k]))
        rate = F.greatest(F.lit(0.0), rate - shift)
        steps += 1
        if steps % CHECKPOINT_STEPS == 0:
            rated, rate = shared.checkpointed(rated.withColumn("rate", rate)), F.col("rate")
        expected = np.array(rated.agg(*[F.coalesce(F.sum(n * p[k] * rate), F.lit(0.0)) for k in d]).first())
    report = {"target": dict(zip(domains, aim.tolist())), "expected": dict(zip(domains, expected.tolist())), "steps": steps}
    return rated.withColumn("rate", rate), report


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", target: dict[str, float] | None = None, total_tokens: float | None = None) -> tuple[DataFrame, list[str], dict]:
    """(one row for each different (doc_id, text) of docs: doc_id, text_hash, copies, tokens, p, rate; domains; report).

    Labelled rows are those whose doc_id is in labels. Every domain of theirs counts; about SAMPLE_DOCS documents of each domain at most, by a hash of
    the id, train the classifier. NULL ids are scored and rated like others, but train nothing. Without a labelled row there is no domain and every rate
    is 1.
    """
    ids = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    named = docs.select("doc_id", F.col(domain).cast("string").alias("_domain")).where(F.col("_domain").isNotNull()).join(ids, "doc_id")
    named = shared.checkpointed(named.groupBy("doc_id").agg(F.min("_domain").alias("_domain")))
    # groups, not documents, come to the driver: one more than MOST_DOMAINS at most
    size = {r["_domain"]: r["count"] for r in named.groupBy("_domain").count().orderBy("_domain").limit(MOST_DOMAINS + 1).collect()}
    if len(size) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains in {domain}")
    taken = F.lit(False)
    for d, rows in size.items():
        one_in = max(1, -(-rows // SAMPLE_DOCS))
        taken = taken | ((F.col("_domain") == d) & (F.pmod(F.xxhash64("doc_id", F.lit("domain")), F.lit(one_in)) == 0))
    sample = named.where(taken)  # about MOST_DOMAINS * SAMPLE_DOCS ids at most
    texts = docs.select("doc_id", "text", F.col(domain).cast("string").alias("_domain")).join(F.broadcast(sample), ["doc_id", "_domain"])
    labelled = texts.groupBy("doc_id", "_domain").agg(F.min("text").alias("text")).select("_domain", "text")
    domains, weights = classifier(labelled, "_domain")
    found, report = fitted_rates(memberships(docs, domains, weights), domains, target, total_tokens)
    return found, domains, report


def mixed(docs: DataFrame, found: DataFrame, at_least: int = 0) -> DataFrame:
    """Rows of docs, repeated or dropped by their rates: floor(rate) times, and once more if a hash of the row is below the fraction.

    at_least=1 keeps every row once even if its rate is below 1. Columns are unchanged.
    """
    i, none, h, rate, n = shared.own_names(docs, "id", "none", "hash", "rate", "n")
    by_row = found.select(F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(none), F.col("text_hash").alias(h), F.col("rate").alias(rate))
    hashed = F.xxhash64("text")
    rows = docs.join(by_row, (F.coalesce("doc_id", F.lit(0)) == F.col(i)) & (F.col("doc_id").isNull() == F.col(none)) & (hashed == F.col(h)))
    chance = F.pmod(F.xxhash64("doc_id", hashed, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.greatest(F.floor(F.col(rate) + chance).cast("int"), F.lit(at_least))
    rows = rows.withColumn(n, times).where(F.col(n) > 0).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return rows.select(*shared.columns_of(docs))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, domains, _ = rates(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    names = F.array(*[F.lit(x) for x in domains]).cast("array<string>")
    best = F.array_max("p")
    domain = F.get(names, (F.array_position("p", best) - 1).cast("int"))
    return found.select("doc_id", "copies", "tokens", domain.alias("domain"), best.alias("posterior"), "rate")
