"""Operator 6, mixing sources to target weights: soft membership.

A classifier trained on the labelled table predicts each document's posterior over domains. Nonnegative document rates
are then fitted by projected-gradient least squares, so that expected domain token totals (rate * tokens * posterior,
summed) match the targets. One distributed sum of a vector as long as the domains is made an iteration.

Cases: a null text has no tokens, a posterior of the priors, and rate 1 (it moves no total); a label row without a
document, or with null labels, is not learned from; without usable labels all documents are in one domain and keep rate 1;
repeated rows get equal rates; of texts that share a labelled id one is learned from; an empty table gives an empty table; a very
long text counts whole; other columns, of any names, are passed by.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, in_slots, map_rows, materialize, slot

log = logging.getLogger(__name__)

DOMAINS = ("high", "low", "toxic")


@dataclass(frozen=True)
class MixingParameters:
    """sample bounds the labelled documents that the classifier is fitted on; weights are target token shares.

    Rates are final when no total is further from its target than ``tolerance`` of all tokens, or when a step moves rates by
    less than ``optimality`` of all tokens (targets that no nonnegative rates meet).
    """

    weights: dict = field(default_factory=lambda: {"high": 0.9, "low": 0.1, "toxic": 0.0})
    sample: int = 4000
    least_documents: int = 3
    most_terms: int = 50_000
    least_association: float = 2.0
    epochs: int = 200
    rate: float = 0.3
    ridge: float = 1e-4
    tolerance: float = 1e-6
    optimality: float = 5e-4


def domain_of(quality: str = "quality", toxic: str = "toxic"):
    """Toxic documents are a domain of their own; the others are split by quality."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "high").when(F.col(quality) == 0, "low")


def word_counts(text: str | None) -> Counter:
    """Lower-case words with their punctuation."""
    return Counter((text or "").lower().split())


def word_terms(raw: str) -> tuple[str, ...]:
    """A word bare of punctuation and, marked, its first letters: inflected and compound words share a stem."""
    w = raw.strip(".,;:!?\"'()")
    return (w, *((w[:4] + "*",) if len(w) > 4 else ()), *((w[:6] + "*",) if len(w) > 6 else ()))


def term_hashes(counts: Counter) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's terms."""
    return np.unique(np.array([zlib.crc32(t.encode()) for raw in counts for t in word_terms(raw)], np.uint32))


SYMBOLS, UPPER, DIGITS = b"#*$%&|<>!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def shape(text: str | None, counts: Counter) -> list[float]:
    """Features of a text's form, each about 0 to 1, and a constant."""
    data = (text or "").encode()
    n, size, lines = sum(counts.values()), len(data) or 1, data.split(b"\n")
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    return [
        1.0,
        len(counts) / max(n, 1),
        min(1.0, share(SYMBOLS) * 10),
        share(UPPER),
        min(n, 50) / 50,
        1 - len(set(lines)) / len(lines),
        max(counts.values(), default=0) / max(n, 1),
        min(1.0, share(DIGITS) * 10),
    ]


class DomainModel:
    """Softmax regression on the presence of known terms and the shape features."""

    def __init__(self, vocabulary: dict[int, int], weights: np.ndarray, domains: list[str]):
        self.vocabulary, self.weights, self.domains = vocabulary, weights, domains

    def posterior(self, text: str | None, counts: Counter, cache: dict | None = None) -> list[float]:
        """``cache`` keeps the terms of words from one text to the next."""
        cache = {} if cache is None else cache
        if len(cache) > 300_000:
            cache.clear()
        for raw in [w for w in counts if w not in cache]:
            cache[raw] = tuple(i for t in word_terms(raw) if (i := self.vocabulary.get(zlib.crc32(t.encode()))) is not None)
        known = set(chain.from_iterable(map(cache.__getitem__, counts)))
        z = self.weights[sorted(known)].sum(axis=0) + np.asarray(shape(text, counts)) @ self.weights[len(self.vocabulary) :]
        z = np.exp(z - z.max())
        return (z / z.sum()).tolist()


def train(rows: list[tuple], p: MixingParameters) -> DomainModel:
    """Full-batch gradient steps with adaptive rates (Adagrad) and a ridge, over (domain, term hashes, shape) rows.

    The vocabulary is the terms of at least ``least_documents`` training documents that go with some domain, each weighed by how
    clearly it does.
    """
    domains = sorted({r[0] for r in rows}) or ["high"]
    n_shape = len(shape("", Counter()))
    if len(domains) == 1:
        return DomainModel({}, np.zeros((n_shape, 1)), domains)
    y = np.zeros((len(rows), len(domains)))
    y[np.arange(len(rows)), [domains.index(r[0]) for r in rows]] = 1
    every, index, seen = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    common = seen[index] >= p.least_documents
    place = np.cumsum(seen >= p.least_documents) - 1
    owner, index, every = owner[common], place[index[common]], every[seen >= p.least_documents]
    have = np.stack([np.bincount(index, y[owner, k], len(every)) for k in range(len(domains))], axis=1)
    z = association(have, y.sum(axis=0))
    value = np.minimum(2.0, (z / 4) ** 2)
    kept = np.argsort(-z, kind="stable")[: p.most_terms]
    kept = kept[z[kept] >= p.least_association]
    new = np.full(len(every), -1)
    new[kept] = np.arange(len(kept))
    owner, index, value = owner[new[index] >= 0], new[index][new[index] >= 0], value[kept]
    n_terms, forms = len(kept), np.asarray([r[2] for r in rows])
    w = np.zeros((n_terms + n_shape, len(domains)))
    squares = np.full_like(w, 1e-8)
    for _ in range(p.epochs):
        scaled = w[:n_terms] * value[:, None]
        out = np.stack([np.bincount(owner, scaled[index, k], len(rows)) for k in range(len(domains))], axis=1) + forms @ w[n_terms:]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        error = (out / out.sum(axis=1, keepdims=True) - y) / len(rows)
        grad = np.concatenate([np.stack([np.bincount(index, error[owner, k], n_terms) for k in range(len(domains))], axis=1) * value[:, None], forms.T @ error])
        grad[:n_terms] += p.ridge * w[:n_terms]
        squares += grad * grad
        w -= p.rate * grad / np.sqrt(squares)
    w[:n_terms] *= value[:, None]
    return DomainModel({t: i for i, t in enumerate(every[kept].tolist())}, w, domains)


def association(have: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each term, the largest z-score of its log odds in one domain against the others."""
    z = np.zeros(len(have))
    for k in range(have.shape[1]):
        a, b = have[:, k], have.sum(axis=1) - have[:, k]
        n, m = size[k], size.sum() - size[k]
        odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log((b + 0.5) / (m - b + 0.5))
        z = np.maximum(z, np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    return z


def fit_domains(docs: DataFrame, labels: DataFrame, p: MixingParameters) -> DomainModel:
    """Train on at most ``sample`` labelled documents, those of least hashed id."""
    labelled = labels.select(F.col("doc_id").alias("id"), domain_of().alias("domain")).where("domain is not null and id is not null")
    chosen = labelled.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(p.sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # Of rows that share an id, the text of least hash is learned from.
    texts = texts.groupBy("id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def make():
        def one(i, domain, text):
            counts = word_counts(text)
            return i, domain, term_hashes(counts).tobytes(), shape(text, counts)

        return one

    rows = map_rows(texts, make, "id long, domain string, terms binary, shape array<double>").collect()
    return train([(r[1], np.frombuffer(r[2], np.uint32), r[3]) for r in sorted(rows, key=lambda r: r[0])], p)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens and the posterior of every domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_terms bounds it

    def make():
        known, cache = shared.value, {}

        def one(doc_id, text):
            counts = word_counts(text)
            return doc_id, sum(counts.values()), known.posterior(text, counts, cache)

        return one

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, tokens long, posterior array<double>")


def targets_for(have: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The least totals in these shares at which no wanted domain has to shrink."""
    wanted = share > 0
    return share * (have[wanted] / share[wanted]).max() if wanted.any() and have.sum() else share * 0


def fit_rates(soft: DataFrame, domains: list[str], p: MixingParameters) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``soft`` with the column rate, the reached totals and the targets.

    Rates start at 1 and move by r = max(0, r - posterior . e); e is the residual of the totals in the metric of
    M = sum of tokens * posterior * posterior', in which the unconstrained step is exact and the projected one contracts.
    A document's rate follows from the last table of rates and the few values of e since, so an iteration is one sum.
    """
    k = len(domains)
    place = [F.col("posterior")[i] for i in range(k)]
    sums = [F.sum(F.col("tokens") * place[i] * place[j]) for i in range(k) for j in range(i, k)]
    first = soft.agg(*[F.sum(F.col("tokens") * x).alias(f"t{i}") for i, x in enumerate(place)], *[s.alias(f"m{n}") for n, s in enumerate(sums)]).first()
    have = np.array([first[i] or 0.0 for i in range(k)])
    m = np.zeros((k, k))
    for n, (i, j) in enumerate((i, j) for i in range(k) for j in range(i, k)):
        m[i, j] = m[j, i] = first[k + n] or 0.0
    share = np.array([float(p.weights.get(d, 0.0)) for d in domains])
    target = targets_for(have, share)
    scale = have.sum() or 1.0
    inverse = np.linalg.pinv(m / scale + 1e-9 * np.eye(k)) / scale
    steps: list[np.ndarray] = []
    soft = soft.withColumn("rate", F.lit(1.0))
    tables: list[DataFrame] = []

    def step(rate: Column, e: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((place[i] * float(e[i]) for i in range(1, k)), place[0] * float(e[0])))

    def stepped(df: DataFrame) -> DataFrame:
        out = F.col("rate")
        for e in steps:
            out = step(out, e)
        return df.withColumn("rate", out)

    reached, moved, rounds = have, np.inf, 0
    while np.abs(reached - target).max() > p.tolerance * scale and moved > p.optimality * scale and have.sum():
        if len(steps) == STEPS_A_TABLE:
            soft, steps = materialize(stepped(soft), "rates"), []
            discard(*tables)
            tables = [soft]
        e = inverse @ (reached - target)
        both = stepped(soft).withColumn("next", step(F.col("rate"), e))
        got = both.agg(F.sum(F.col("tokens") * F.abs(F.col("next") - F.col("rate"))).alias("moved"), *[F.sum(F.col("next") * F.col("tokens") * x).alias(f"t{i}") for i, x in enumerate(place)]).first()
        moved, reached, rounds = got[0] or 0.0, np.array([x or 0.0 for x in got[1:]]), rounds + 1
        steps.append(e)
    log.info("rates after %d steps; share of tokens off target by domain: %s", rounds, dict(zip(domains, ((reached - target) / scale).round(7).tolist(), strict=True)))
    return stepped(soft).withColumn("rate", F.when(F.col("tokens") == 0, 1.0).otherwise(F.round("rate", 9))), reached, target


#: Steps that are folded into one generated expression before the rates are written down.
STEPS_A_TABLE = 6


def drawn(rate: str, key: str) -> Column:
    """The whole part of a rate, plus one if a hash of the key, mapped to 0 up to 1, lies below its fraction."""
    point = F.shiftrightunsigned(F.xxhash64(F.lit(6), key), 11) * 2.0**-53
    return (F.floor(rate) + (point < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, p: MixingParameters = MixingParameters()) -> DataFrame:
    """doc_id, tokens, posterior, domain, rate and copies of every row.

    Copies are the whole part of the rate, and one more for the share of ids that its fraction says (see drawn): their
    expectation is the rate, whatever rates a domain's documents have. As no wanted domain has to shrink, a document that is
    likeliest of one has a copy at least.
    """
    model = fit_domains(docs, labels, p)
    soft = materialize(posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model), "soft")
    rated, _, _ = fit_rates(soft, model.domains, p)
    names = F.array(*[F.lit(d) for d in model.domains])
    best = names[(F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")]
    wanted = best.isin([d for d in model.domains if p.weights.get(d, 0.0) > 0]) & (F.col("rate") > 0)
    return rated.select("doc_id", "tokens", "posterior", best.alias("domain"), "rate", F.greatest(drawn("rate", "doc_id"), F.when(wanted, 1).otherwise(0).cast("long")).alias("copies"))


def apply(docs: DataFrame, labels: DataFrame, p: MixingParameters = MixingParameters(), broadcast_ids: int = 1_000_000) -> DataFrame:
    """Whole rows as many times as ``copies`` says.

    Only ids with other than one copy are joined; up to ``broadcast_ids`` of them are broadcast, more are shuffled. Rows
    without an id stay once. Columns may have any names.
    """
    changed = mix(docs, labels, p).where("copies != 1 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_mixed")).agg(F.max("copies").alias("_copies"))
    changed = materialize(changed, "copies")
    few = changed.limit(broadcast_ids + 1).count() <= broadcast_ids
    held = in_slots(docs)
    both = held.join(F.broadcast(changed) if few else changed, F.col(slot(docs, "doc_id")) == F.col("_mixed"), "left")
    times = F.coalesce("_copies", F.lit(1)).cast("int")
    repeated = both.where(times > 0).withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*held.columns).toDF(*docs.columns)
