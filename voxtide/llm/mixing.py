"""Mixing documents to target domain weights by soft membership (DataFrame functions only).

1. A classifier over word presence is fitted on a bounded, hash-drawn sample of ``FIT_DOCS`` labelled documents that are in the
   input, drawn evenly over the domains, rare ones whole. Three quarters of them give each word its log-likelihood ratio for each
   domain, naive-Bayes style, for all words that tell domains apart (a likelihood-ratio test; no other cut of the vocabulary). The
   last quarter calibrates: the evidence for and that against each domain are weighed by a logistic fit, so that the posteriors are
   probabilities and not the extremes that dependent words would give.
2. Every document gets posteriors over the domains from its whole text, and its number of words.
3. Nonnegative rates r (expected copies of a document) are fitted so that the expected tokens of each domain, the sum of
   r * tokens * posterior, meet the targets: projected gradient on the least squares, from r = 1. With
   residuals measured in the metric of M = sum(tokens * p * p') the step length 1 is always safe, and a
   step of a document depends on its posteriors alone: r <- max(least, r - p . inverse(M) (totals - targets)), with M taken
   over the documents that may move, and damped. ``least`` is 0, or what the caller asks for the documents of a domain: the bound
   is part of the projection. An iteration is one aggregate of K sums over the written posteriors; the driver holds K numbers for each iteration. Each row carries ``miss``, the
   share of the targets' tokens by which the fitted totals are off: targets that no rates meet are met as nearly as it goes.

Scale: texts are never shuffled, but for the drawn ones; the shuffles carry a row of K numbers a document. No step groups by source
or domain, so a domain of any share of the rows is spread like the others. The table of telling words follows the sample, not the
input; it is broadcast if it has at most ``WORDS`` rows, and joined otherwise.

Defined cases: a null text, or one without words, has no tokens, the prior as posteriors, and its rate like
others; a very long text is scored by all its words; rows repeating a doc_id are scored as one document (the classifier learns from the
least of their texts); a label without a document is left out, a doc_id of several labels has the least; a null doc_id is scored by
the prior; ties of domains go to the first by name; an empty table gives an empty result; without labelled documents all domains
are equally likely; a domain that no document belongs to is left out of the fit; columns other than the two named are not read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import discard, stored

#: Bound of the sample of labelled documents, and rows of the word table up to which it is broadcast.
FIT_DOCS, WORDS = 20_000, 1 << 16
#: Least likelihood-ratio statistic of a word that tells a domain apart (four standard deviations, squared).
TELLING = 16.0
#: With fewer documents to calibrate on, the evidence counts as it is.
FEW = 40
#: Passes of the fit at most; steps between two writes; the fit is stationary if PATIENCE passes lessen the squares by under STILL of them.
STEPS, CHAIN, PATIENCE, STILL = 80, 8, 8, 1e-3


def words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\u000b\f\r", "     ")
    return F.array_remove(F.array_distinct(F.split(flat, " ")), "")


@dataclass
class Classifier:
    domains: list[str]
    bias: list[float]
    table: DataFrame | None = None  # word, w: array of a log-likelihood ratio for each domain, 0 where the word doesn't tell
    rows: int = 0
    weights: list[tuple[float, float]] = field(default_factory=list)  # of the evidence for and against each domain


def _quotas(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """How many of each domain are drawn: small domains whole, the others evenly, ``sample`` in all."""
    quotas, left = {}, float(sample)
    for i, d in enumerate(sorted(sizes, key=lambda d: (sizes[d], d))):
        quotas[d] = min(float(sizes[d]), left / (len(sizes) - i))
        left -= quotas[d]
    return quotas


def _told(c: Column, own: float, there: Column, other: float) -> Column:
    """The likelihood-ratio statistic of a word in c of ``own`` and in ``there`` of ``other`` documents."""

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    fixed = sum(-x * float(np.log(x)) for x in (own, other)) + (own + other) * float(np.log(own + other))
    both = c + there
    cells = part(c.cast("double")) + part(F.lit(own) - c) + part(there) + part(F.lit(other) - there)
    return 2 * (cells - part(both) - part(F.lit(own + other) - both) + F.lit(fixed))


def _word_table(drawn: DataFrame, sizes: dict[str, int], domains: list[str]) -> DataFrame:
    """word, w of all telling words of ``drawn`` (domain, words)."""
    n = {r["domain"]: r["n"] for r in drawn.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    each = [F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]
    counts = drawn.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*each)
    tells, ratios = [F.lit(0.0)], []
    for k, d in enumerate(domains):
        own, rest = n.get(d, 0), [(j, e) for j, e in enumerate(domains) if e != d and n.get(e)]
        if not own or not rest:
            ratios.append(F.lit(0.0))
            continue
        # Domains are drawn at different shares: elsewhere each counts by its size, as that many documents drawn evenly would.
        size = sum(sizes[e] for _, e in rest)
        other = size * size / sum(sizes[e] ** 2 / n[e] for _, e in rest)
        there = F.least(F.lit(float(other)), sum((F.col(f"c{j}") * (sizes[e] / n[e]) for j, e in rest), F.lit(0.0)) * (other / size))
        told = _told(F.col(f"c{k}"), float(own), there, float(other))
        ratio = F.log((F.col(f"c{k}") + 0.5) / (own + 1.0)) - F.log((there + 0.5) / (other + 1.0))
        tells.append(told)
        ratios.append(F.when(told >= TELLING, ratio).otherwise(0.0))
    best = F.greatest(*tells) if len(tells) > 1 else tells[0]
    return stored(counts.where(best >= TELLING).select("word", F.array(*ratios).alias("w")), "telling-words")


def evidence(rows: DataFrame, model: Classifier) -> DataFrame:
    """_id, for0.., against0..: of each document (``rows``: _id, words) with a telling word, the sums of its words' ratios above and below 0."""
    table = F.broadcast(model.table) if model.rows <= WORDS else model.table
    k = range(len(model.domains))
    sums = [F.sum(F.greatest(F.col("w")[i], F.lit(0.0))).alias(f"for{i}") for i in k] + [F.sum(F.least(F.col("w")[i], F.lit(0.0))).alias(f"against{i}") for i in k]
    return rows.select("_id", F.explode("words").alias("word")).join(table, "word").groupBy("_id").agg(*sums)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """K x 3 weights (for, against, bias) of a softmax over x (documents x K x 3) that best tell y, by Newton's method from ``start``,
    which a ridge draws them to."""
    k = x.shape[1]
    truth = np.eye(k)[y]

    def at(theta: np.ndarray) -> tuple[np.ndarray, float]:
        z = np.einsum("nkf,kf->nk", x, theta)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() + 0.5 * ridge * ((theta - start) ** 2).sum()
        return p, float(loss)

    theta = start.copy()
    p, loss = at(theta)
    for _ in range(100):
        slope = np.einsum("n,nk,nkf->kf", weight, p - truth, x) + ridge * (theta - start)
        curve = np.einsum("n,nkl,nkf,nlg->kflg", weight, p[:, :, None] * (np.eye(k)[None] - p[:, None, :]), x, x, optimize=True).reshape(3 * k, 3 * k) + ridge * np.eye(3 * k)
        step, size = np.linalg.solve(curve, slope.ravel()).reshape(k, 3), 1.0
        while size > 1e-6:
            fresh = theta - size * step
            q, now = at(fresh)
            if now <= loss:
                break
            size /= 2
        else:
            break
        done, theta, p, loss = loss - now < 1e-9 * max(1.0, loss), fresh, q, now
        if done:
            break
    theta[:, :2] = np.maximum(theta[:, :2], 0.0)
    return theta


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = FIT_DOCS) -> Classifier:
    """``labelled``: doc_id, domain."""
    here = docs.select(F.col(id_col).alias("_id"))  # a label without a document would count as a document without words
    label = labelled.where(F.col("domain").isin(domains)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("domain").alias("domain"))
    label = stored(label.join(here, "_id", "left_semi"), "labels")
    sizes = {r["domain"]: r["n"] for r in label.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier(domains, [0.0] * len(domains))
    share = F.create_map(*[F.lit(x) for d, q in _quotas(sizes, sample).items() for x in (d, q / sizes[d])])
    chosen = stored(label.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share[F.col("domain")] * (1 << 30)), "chosen")
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")
    drawn = stored(found.groupBy("_id", "domain").agg(F.min("_text").alias("_text")).select("_id", "domain", words(F.col("_text")).alias("words")), "labelled")
    aside = F.pmod(F.xxhash64("_id", F.lit("calibrate")), F.lit(4)) == 0
    prior = [float(np.log((sizes.get(d, 0) + 0.5) / (total + 0.5 * len(domains)))) for d in domains]
    table = _word_table(drawn.where(~aside), sizes, domains)
    model = Classifier(domains, prior, table, table.count(), [(1.0, 1.0)] * len(domains))
    kept = drawn.where(aside)
    scored = kept.select("_id", "domain").join(evidence(kept, model), "_id", "left").drop("_id").na.fill(0.0).toArrow()  # at most ``sample`` rows
    discard(label, chosen, drawn)
    place = {d: i for i, d in enumerate(domains)}
    y = np.array([place[d] for d in scored["domain"].to_pylist()], int)
    if len(y) >= FEW:
        columns = [[scored[f"{side}{i}"].to_numpy() for side in ("for", "against")] + [np.ones(len(y))] for i in range(len(domains))]
        there = np.bincount(y, minlength=len(domains))
        weight = np.array([sizes.get(d, 0) / max(1, n) for d, n in zip(domains, there, strict=True)])[y]
        theta = calibrated(np.array(columns).transpose(2, 0, 1), y, weight * len(y) / weight.sum(), np.array([[1.0, 1.0, b] for b in prior]))
        model.weights, model.bias = [(float(a), float(b)) for a, b, _ in theta], [float(b) for *_, b in theta]
    return model


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (words of the whole text), p: array of the posterior of each domain."""
    k = len(model.domains)
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
    if model.table is None:
        return base.withColumn("p", F.array(*[F.lit(1.0 / k)] * k))
    hits = evidence(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("words")), model)
    scored = base.join(hits, base["doc_id"] == hits["_id"], "left")
    logits = [F.lit(b) + F.coalesce(F.col(f"for{i}") * F.lit(x) + F.col(f"against{i}") * F.lit(y), F.lit(0.0)) for i, (b, (x, y)) in enumerate(zip(model.bias, model.weights, strict=True))]
    top = F.greatest(*logits) if k > 1 else logits[0]
    scored = scored.select("doc_id", "tokens", *[x.alias(f"z{i}") for i, x in enumerate(logits)], top.alias("top"))
    odds = [F.exp(F.col(f"z{i}") - F.col("top")) for i in range(k)]
    whole = sum(odds[1:], odds[0])
    return scored.select("doc_id", "tokens", F.array(*[x / whole for x in odds]).alias("p"))


def _stepped(raw: Column, steps: list[list[float]]) -> Column:
    """The rate after some steps, before the last one's projection."""
    for step in steps:
        raw = F.greatest(F.col("least"), raw) - sum((F.col("p")[i] * F.lit(x) for i, x in enumerate(step)), F.lit(0.0))
    return raw


@dataclass
class Fit:
    rates: DataFrame  # the scored rows with rate and miss
    totals: np.ndarray
    targets: np.ndarray
    miss: float  # largest miss of a domain, as a share of the targets' sum
    settled: bool  # met, or stationary: no step lessens the squares any more


def fit_rates(scored: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = 1e-6) -> Fit:
    """``scored`` (with tokens, p and the least rate; written) with the rates that bring its expected domain totals to ``targets`` (tokens).

    The squares are those of the residual in the metric of M over all documents. A step is taken in the metric of the documents
    that their bound doesn't hold, which is a Newton step, damped by a share of M; a step that doesn't lessen the
    squares is taken back and damped more. Rates are written every ``CHAIN`` steps.
    """
    k = len(targets)
    p, t, low = [F.col("p")[i] for i in range(k)], F.col("tokens"), F.col("least")
    pairs = [(i, j) for i in range(k) for j in range(k)]
    goal, chain, trial, damp = np.array(targets, float), [], None, 1e-3
    now, whole, held, best, settled = scored.withColumn("raw", F.lit(1.0)), None, None, [], False
    off, miss = -goal, 0.0
    for _ in range(steps + 1):
        rows = now.select("tokens", "p", "least", _stepped(F.col("raw"), chain + [trial] * (trial is not None)).alias("raw")).withColumn("r", F.greatest(low, F.col("raw")))
        sums = [F.sum(t * p[i] * F.col("r")).alias(f"t{i}") for i in range(k)] + [F.sum(F.when(F.col("raw") >= low, t * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i, j in pairs]
        facts = rows.agg(*sums).first()
        if facts[0] is None:
            settled = True
            break
        fresh, metric = np.array(facts[:k], float) - goal, np.array(facts[k:], float).reshape(k, k)
        whole = metric if whole is None else whole  # at r = 1 no document is held
        squares = float(fresh @ np.linalg.pinv(whole, rcond=1e-9, hermitian=True) @ fresh)
        if not best or squares < best[-1]:
            best.append(squares)
            off, held = fresh, metric
            if trial is not None:
                chain, damp = [*chain, trial], max(damp / 4, 1e-4)
            if len(chain) == CHAIN:
                old, now = now, stored(now.withColumn("raw", _stepped(F.col("raw"), chain)), "rates")
                discard(old)
                chain = []
        else:
            best.append(best[-1])
            damp *= 8
        miss = float(np.abs(off).max()) / max(1.0, float(goal.sum()))
        settled = miss <= tolerance or len(best) > PATIENCE and best[-PATIENCE - 1] - best[-1] < STILL * best[-PATIENCE - 1]
        if settled:
            break
        trial = [float(x) for x in np.linalg.pinv(held + damp * whole, rcond=1e-9, hermitian=True) @ off]
    rates = now.withColumn("rate", F.greatest(low, _stepped(F.col("raw"), chain))).withColumn("miss", F.lit(miss)).drop("raw")
    return Fit(rates, off + goal, goal, miss, settled)


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], of_present: bool = False, least: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Fit:
    """Rates: doc_id, tokens, p, domain (the likeliest), rate, miss. ``weights``: of each domain in the mix, which keeps the total of tokens;
    or, ``of_present``, the factors that the domains' present expected totals are to change by. ``least``: the least rate of
    the documents whose likeliest domain it is (default 0; at most 1, where the fit starts)."""
    domains = sorted(weights)
    likeliest = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int"))
    low = F.coalesce(F.create_map(*[F.lit(x) for d in domains for x in (d, float((least or {}).get(d, 0.0)))])[F.col("domain")], F.lit(0.0))
    found = posteriors(docs, fit(docs, labelled, domains, id_col, text_col), id_col, text_col)
    scored = stored(found.withColumn("domain", likeliest).withColumn("least", low), "posteriors")
    present = scored.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(domains))]).first()
    share = sum(weights.values())
    targets = [(x if of_present else sum(present) / share) * weights[d] for d, x in zip(domains, present, strict=True)]
    out = fit_rates(scored, targets)
    out.rates = out.rates.select("doc_id", "tokens", "p", "domain", "rate", "miss")
    return out


def copies(rate: Column, key: Column) -> Column:
    """Whole copies whose expectation over documents is the rate: rounded by a hash of ``key`` as the uniform number."""
    uniform = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + uniform).cast("int")


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a table of quality and toxicity marks: toxic before low before high."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("domain"))
