"""Mixing documents to target weights over soft domains."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import stage
from .batches import filtered, small_batches
from .hashing import batches_of_bytes, word_hashes
from .sampling import bounded_sample

SLOTS = 1 << 17
WINDOW = 2000


@dataclass
class Model:
    """A softmax over shape features of a text and over its words' learned evidence."""

    domains: list[str]
    evidence: np.ndarray  # SLOTS x domains: log of a word's share in a domain over its share elsewhere
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # (features + 1) x domains

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        if not self.domains:
            return np.zeros((len(features), 0))
        z = (features - self.mean) / self.spread
        z = np.column_stack([z, np.ones(len(z))]) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _distinct(words: np.ndarray) -> float:
    """The mean share of distinct words over windows of ``WINDOW`` words of the whole text, weighted
    by their length (the last one may be short); a share over all words would fall with length."""
    return sum(len(np.unique(words[k : k + WINDOW])) for k in range(0, len(words), WINDOW)) / max(1, len(words))


def _shape(texts: list[bytes], evidence: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, features): a token is a word; features are shares of kinds of bytes, word lengths,
    repeated words, and the largest and mean positive evidence of the words for each domain."""
    domains = 0 if evidence is None else evidence.shape[1]
    tokens, rows = [], []
    for part in batches_of_bytes(texts):
        own = texts[part]
        words, offsets = word_hashes(own)
        slots = (words % np.uint64(SLOTS)).astype(np.int64)
        for i, t in enumerate(own):
            raw = np.bincount(np.frombuffer(t, np.uint8), minlength=256).astype(float)
            n, w = max(1, len(t)), words[offsets[i] : offsets[i + 1]]
            kinds = [raw[65:91].sum() / n, raw[48:58].sum() / n, (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / n, raw[124] / n, raw[10] / n]
            same = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
            row = [*kinds, n / max(1, len(w)), same, _distinct(w), np.log1p(len(w))]
            if domains:
                e = np.maximum(evidence[slots[offsets[i] : offsets[i + 1]]], 0.0)
                row += [*(e.max(axis=0) if len(e) else np.zeros(domains)), *(e.mean(axis=0) if len(e) else np.zeros(domains))]
            tokens.append(len(w))
            rows.append(row)
    width = 9 + 2 * domains
    return np.array(tokens, np.int64), np.array(rows, float).reshape(len(tokens), width)


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def train(docs: DataFrame, labels: DataFrame, domain: Column, key: str = "doc_id", text: str = "text", documents: int = 4000) -> Model:
    """Fit the classifier on a labelled table: ``domain`` is an expression over its columns.

    Of each domain about ``documents`` labelled keys, drawn by hash, teach, so no more are gathered; rows
    without key or domain teach nothing, documents that repeat a key all teach.  Half of them (by hash)
    give the evidence of words, in ``SLOTS`` hashed slots, the other half the softmax; whole texts
    count, null ones as empty.  Labels that teach nothing give a model of no domains, whose
    posteriors are empty and whose rates are 1.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    picked = bounded_sample(known, F.col("domain"), F.col("id").cast("string"), documents).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)))
    names = sorted(r["domain"] for r in picked.select("domain").distinct().collect())
    sample = stage(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id"), "sample")
    if not names:
        return Model([], np.zeros((SLOTS, 0)), np.zeros(9), np.ones(9), np.zeros((10, 0)))

    def seen(batches):
        for batch in batches:
            for d, t in zip(batch["domain"], _bytes(batch["text"]), strict=True):
                words, _ = word_hashes([t])
                slots = np.unique(words % np.uint64(SLOTS)).astype(np.int64)
                yield pd.DataFrame({"domain": [d] * len(slots), "slot": slots})

    counts = np.zeros((SLOTS, len(names)))
    sizes = {r["domain"]: r["count"] for r in sample.where("half = 1").groupBy("domain").count().collect()}
    held = sample.where("half = 1").mapInPandas(seen, "domain string, slot long").groupBy("domain", "slot").count().where("count > 1")
    for r in held.toLocalIterator():
        counts[r["slot"], names.index(r["domain"])] = r["count"]
    n = np.array([max(1, sizes.get(d, 0)) for d in names], float)
    share, others = counts / n, (counts.sum(axis=1, keepdims=True) - counts + 1.0) / (n.sum() - n + 1.0)
    evidence = np.where(counts >= 4, np.log(np.maximum(share, 1e-9) / others), 0.0)
    evidence = np.where(evidence > 1.0, evidence, 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(evidence)

    def features(batches):
        for batch in batches:
            _, x = _shape(_bytes(batch["text"]), sent.value)
            yield pd.DataFrame({"domain": batch["domain"], "x": list(x)})

    rows = sample.where("half = 0").mapInPandas(features, "domain string, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), 9 + 2 * len(names))
    y = np.array([names.index(d) for d in rows["domain"]], int)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, hot = np.zeros((z.shape[1], len(names))), np.eye(len(names))[y]
    for _ in range(400):
        p = np.exp(z @ w - (z @ w).max(axis=1, keepdims=True)) if len(z) else hot
        p = p / p.sum(axis=1, keepdims=True) if len(z) else hot
        w -= 0.5 * (z.T @ (p - hot) / max(1, len(z)) + 1e-4 * w)
    return Model(names, evidence, mean, spread, w)


@dataclass
class Fit:
    """Rates as the projected gradient steps that lead to them: a document's rate follows from its
    posteriors and these few vectors.  ``reached``: every domain's total is within the tolerance of its target."""

    steps: np.ndarray  # iterations x domains
    most: float
    totals: np.ndarray
    targets: np.ndarray
    reached: bool = False

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        r = np.ones(len(posteriors))
        for step in self.steps:
            r = np.clip(r - posteriors @ step, 0.0, self.most)
        return r


def measure(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tokens, p (posteriors) of every row; a null or empty text has 0 tokens, rows that repeat are
    measured each by itself, whole texts count however long, an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tokens, x = _shape(_bytes(batch["text"]), sent.value.evidence)
            yield pd.DataFrame({"id": batch["id"], "tokens": tokens, "p": list(sent.value.posteriors(x))})

    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, tokens long, p array<double>")
    return rows.withColumn("id", F.col("id").cast(docs.schema[key].dataType))


def fit(
    measured: DataFrame, domains: list[str], weights: dict[str, float], most: float = float("inf"), total: str = "corpus", tolerance: float = 0.002
) -> Fit:
    """Projected-gradient least squares over all documents: rates in [0, most] whose expected
    token totals by domain (sum of rate * tokens * posterior) match the targets.

    The target of a domain is its share of ``weights`` in a total: all tokens of the corpus, or,
    with total="first", as many as leave the first domain named in ``weights`` whole.  With total="largest" the total begins there and
    shrinks, by half of the worst domain's relative gap, for as long as steps end without reaching it: documents of the other domains
    hold a little of the first one too, so that it can seldom stay whole.  The squares of
    domains are weighted by the inverse of S, the sum of tokens * p * p' over the documents, and the gradient of a
    rate is taken per token, so a step is p * (inverse of S) * gap: it would close the gap at once
    if no rate were cut off at 0 or ``most``.  S is taken over the documents that are not cut off, and over
    all, which cannot overshoot, after a step that has not helped.  Each step is one pass that sums a row of domain totals a task;
    documents keep no state between them.

    Steps end when every total is within ``tolerance`` of its target, relative to it, or when ten of them
    in a row have not brought the worst one nearer by a hundredth: then the targets
    cannot be met with such rates; ``reached`` is false then and a warning says so, with total="largest" only if a
    tenth of the total does not do either.  No documents, or
    none with tokens, reach targets of 0.
    """
    d = len(domains)
    if not d:
        return Fit(np.empty((0, 0)), most, np.zeros(0), np.zeros(0), True)

    def pass_over(batches, steps):
        acc, square, free = np.zeros(d), np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            if len(batch):
                t, p = batch["tokens"].to_numpy(float), np.array(batch["p"].tolist(), float)
                own, r = t[:, None] * p, Fit(steps, most, acc, acc).rates(p)
                inside = (r > 0) & (r < most)
                acc += r @ own
                square += own.T @ p
                free += own[inside].T @ p[inside]
        yield pd.DataFrame({"v": [[*acc, *square.ravel(), *free.ravel()]]})

    def totals(steps):
        out = measured.select("tokens", "p").mapInPandas(lambda b: pass_over(b, steps), "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        found = np.zeros(d + 2 * d * d)
        for r in out.collect():
            found[r["i"]] = r["v"]
        return found[:d], found[d : d + d * d].reshape(d, d), found[d + d * d :].reshape(d, d)

    steps = np.empty((0, d))
    now, square, free = totals(steps)
    share = np.array([weights.get(x, 0.0) for x in domains], float)
    share = share / max(share.sum(), 1e-12)
    first = domains.index(next(iter(weights))) if next(iter(weights), None) in domains else 0
    whole = now.sum() if total == "corpus" else now[first] / max(share[first], 1e-12)
    targets, least = share * whole, 0.1 * whole
    worst = lambda: float((np.abs(now - targets) / np.maximum(targets, 1e-3 * max(whole, 1e-12))).max())
    while True:
        best, idle, metric = worst(), 0, free
        while best > tolerance and idle < 10:
            steps = np.vstack([steps, np.linalg.pinv(metric, rcond=1e-9, hermitian=True) @ (now - targets)])
            before = worst()
            now, square, free = totals(steps)
            metric = free if worst() < 0.9 * before else square
            idle = 0 if worst() < 0.99 * best else idle + 1
            best = min(best, worst())
        if worst() <= tolerance or total != "largest" or whole <= least:
            break
        whole *= 1 - min(0.5, max(tolerance, worst() / 2))
        targets = share * whole
    reached = worst() <= tolerance
    if not reached:
        warnings.warn(f"mixing targets not reached: {dict(zip(domains, np.round(now / np.maximum(targets, 1e-12), 3).tolist(), strict=True))} of them", stacklevel=2)
    return Fit(steps, most, now, targets, reached)


def rates(measured: DataFrame, fitted: Fit, domains: list[str], key: str = "doc_id") -> DataFrame:
    """key, tokens, rate, and p_<domain> of every row."""

    def run(batches):
        for batch in batches:
            p = np.array(batch["p"].tolist(), float).reshape(len(batch), len(domains))
            yield pd.DataFrame({"id": batch["id"], "tokens": batch["tokens"], "rate": fitted.rates(p), "p": batch["p"]})

    rows = measured.select(F.col("id").cast("string").alias("id"), "tokens", "p").mapInPandas(run, "id string, tokens long, rate double, p array<double>")
    return rows.select(F.col("id").cast(measured.schema["id"].dataType).alias(key), "tokens", "rate", *(F.element_at("p", i + 1).alias(f"p_{x}") for i, x in enumerate(domains)))


def thin(docs: DataFrame, model: Model, fitted: Fit, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that a draw at their rates (at most 1) keeps, all columns as they are; the draw is a
    hash of the key, so it is the same in every run and rows that repeat a key with one text stay or go together.
    Rows with a null key draw by their text, those without either always draw alike."""
    sent = docs.sparkSession.sparkContext.broadcast((model, fitted))
    draw = (F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text)), F.lit(7)) / F.lit(2.0**64)) + 0.5

    def compute():
        own, steps = sent.value

        def of(texts, drawn):
            _, x = _shape(_bytes(texts), own.evidence)
            return [steps.rates(own.posteriors(x)) > drawn.to_numpy(zero_copy_only=False)]

        return of

    return filtered(docs, text, draw, compute)
