"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores.

Token labels come from document labels: a feature (word, or prefix of a word) marks toxicity when nearly all
training documents with it are toxic, and a token of a toxic document is toxic when a feature of it marks.
The two-state field is fitted on word and prefix features and transitions; sequences are word runs of
``RUN`` words.  Documents are scored by forward-backward marginals.  The training sample is bounded per
label; counts of all training rows put the labels' true shares back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashing import small_batches

# Bounds of the training sample, in documents of each label; drawn by id digest from all labelled training rows.
MAX_TOXIC, MAX_CLEAN = 800, 1_200
RUN = 64
PREFIXES = (3, 4, 5, 6)
MIN_SUPPORT, MIN_PRECISION = 4, 0.9
CACHE_WORDS = 500_000
PART_CHARS = 1_000_000
STEPS, RATE, L2 = 50, 0.4, 1e-3
# Runs without a toxic word that the field is fitted on, with and without features of toxic words; the document head sees whole documents.
HARD_RUNS, EASY_RUNS = 4_000, 500
FOLDS = 5
LETTERS = re.compile(r"[\W\d_]+")


def features(word: str) -> list[str]:
    """The word's letters and its prefixes; none without letters."""
    w = LETTERS.sub("", word)
    return [f"w:{w}"] + [f"{n}:{w[:n]}" for n in PREFIXES if len(w) > n] if w else []


@dataclass
class Model:
    weights: dict[str, float]  # state-1 score by feature
    bias: float
    trans: np.ndarray  # 2 x 2
    start: np.ndarray  # 2
    head: np.ndarray  # document score: intercept and coefficients

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


class Emissions(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = self.model.emission(word)
        return out


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut documents of ``counts`` words into runs: (index of words per run padded with -1, document of each run)."""
    per = -(-counts // RUN)
    doc = np.repeat(np.arange(len(counts)), per)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = first[doc][:, None] + nth[:, None] * RUN + np.arange(RUN)
    return np.where(at < (first + counts)[doc][:, None], at, -1), doc


def forward_backward(e: np.ndarray, live: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of state 1 for runs of emissions ``e`` (runs x steps); ``live`` marks real words.

    With ``pairs`` also the log likelihood's normaliser and the expected transitions.
    """
    n, steps = e.shape
    t = np.exp(trans)
    em = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    em[~live] = 1.0
    fwd, logz = np.empty((n, steps, 2)), np.zeros(n)
    a = np.exp(start) * em[:, 0]
    for s in range(steps):
        if s:
            b = (a @ t) * em[:, s]
            a = np.where(live[:, s, None], b, a)
        z = a.sum(1, keepdims=True)
        a = a / z
        logz += np.log(z[:, 0])
        fwd[:, s] = a
    bwd = np.ones((n, 2))
    marg = np.empty((n, steps))
    expected = np.zeros((2, 2))
    for s in range(steps - 1, -1, -1):
        m = fwd[:, s] * bwd
        marg[:, s] = m[:, 1] / m.sum(1)
        if s:
            after = em[:, s] * bwd
            if pairs:
                joint = fwd[:, s - 1, :, None] * t * after[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                expected += joint[live[:, s]].sum(0)
            b = after @ t.T
            bwd = np.where(live[:, s, None], b / b.sum(1, keepdims=True), bwd)
    return (marg, logz, expected, fwd, bwd) if pairs else marg


def fit(rows: list[tuple[str, int]], totals: tuple[int, int] | None = None) -> Model:
    """Fit on (text, toxic) rows; without both labels the model scores the label share everywhere.

    ``totals`` counts the clean and toxic rows that the sample was drawn from; by default the sample is all.
    """
    drawn = Counter(y for _, y in rows)
    totals = totals or (drawn[0], drawn[1])
    share = (totals[1] + 0.5) / (sum(totals) + 1)
    flat = Model({}, -5.0, np.zeros((2, 2)), np.zeros(2), np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    if len({y for _, y in rows}) < 2:
        return flat
    words = [t.lower().split() for t, _ in rows]
    memo: dict[str, list[str]] = {}
    for ws in words:
        for w in ws:
            if w not in memo:
                memo[w] = features(w)
    seen = [Counter(), Counter()]
    for ws, (_, y) in zip(words, rows):
        seen[y].update({f for w in set(ws) for f in memo[w]})
    # every document stands for as many rows of its label as were there for each one drawn
    weight = [totals[y] / drawn[y] for y in (0, 1)]
    marks = {f for f, n in seen[1].items() if n >= MIN_SUPPORT and n * weight[1] >= MIN_PRECISION * (n * weight[1] + seen[0][f] * weight[0])}
    vocab = {f: k + 1 for k, f in enumerate(sorted(f for f in seen[0] + seen[1] if seen[0][f] + seen[1][f] >= MIN_SUPPORT))}
    width = len(PREFIXES) + 1
    rows_of: dict[str, np.ndarray] = {}
    toxic_word = {}
    for w, fs in memo.items():
        ids = [vocab.get(f, 0) for f in fs]
        rows_of[w] = np.array(ids + [0] * (width - len(ids)), np.int32)
        toxic_word[w] = any(f in marks for f in fs)
    counts = np.array([len(ws) for ws in words])
    flat_words = [w for ws in words for w in ws]
    doc_toxic = np.repeat([y for _, y in rows], counts)
    label = np.fromiter((toxic_word[w] for w in flat_words), bool, len(flat_words)) & (doc_toxic == 1)
    feats = np.stack([rows_of[w] for w in flat_words])
    at, doc = runs(counts)
    has = (label[np.maximum(at, 0)] & (at >= 0)).any(1)
    # clean runs: first those whose words share a feature with toxic words, then any
    shared = np.zeros(len(vocab) + 1, bool)
    shared[feats[label].ravel()] = True
    shared[0] = False
    near = (shared[feats].any(1)[np.maximum(at, 0)] & (at >= 0)).any(1)
    rng = np.random.default_rng(7)
    hard, easy = (rng.permutation(np.nonzero(~has & part)[0]) for part in (near, ~near))
    picked = np.sort(np.concatenate([np.nonzero(has)[0], hard[: HARD_RUNS], easy[:EASY_RUNS]]))
    at_fit = at[picked]
    live = at_fit >= 0
    x = feats[np.maximum(at_fit, 0)]
    y = label[np.maximum(at_fit, 0)] & live
    w, bias, trans, start = np.zeros(len(vocab) + 1), -3.0, np.zeros((2, 2)), np.zeros(2)
    both = live[:, 1:] & live[:, :-1]
    seen_pairs = np.array([[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_start = np.array([(~y[:, 0]).sum(), y[:, 0].sum()], float)
    grads = [np.zeros_like(w), 0.0, np.zeros((2, 2)), np.zeros(2)]
    flat_x = x[live]
    for _ in range(STEPS):
        e = bias + w[x].sum(2)
        marg, _, expected, fwd, _ = forward_backward(e, live, trans, start, pairs=True)
        diff = (y - marg)[live]
        g_w = np.bincount(flat_x.ravel(), np.repeat(diff, width), len(w)) - L2 * len(picked) * w
        g_w[0] = 0.0
        p1 = marg[:, 0].sum()
        steps = [g_w, diff.sum(), seen_pairs - expected, seen_start - np.array([len(picked) - p1, p1])]
        for k, g in enumerate(steps):  # adaptive step sizes per parameter
            grads[k] = grads[k] + g**2
        w = w + RATE * steps[0] / np.sqrt(grads[0] + 1e-9)
        bias = bias + RATE * steps[1] / np.sqrt(grads[1] + 1e-9)
        trans = trans + RATE * steps[2] / np.sqrt(grads[2] + 1e-9)
        start = start + RATE * steps[3] / np.sqrt(grads[3] + 1e-9)
        w[0] = 0.0
    model = Model({f: float(w[k]) for f, k in vocab.items() if abs(w[k]) > 1e-3}, float(bias), trans, start, np.zeros(4))
    model.head = fit_head(document_facts(words, model)[0], np.array([y for _, y in rows], float))
    model.head[0] -= np.log(weight[0] / weight[1])  # sample odds to true odds
    return model


def document_facts(words: list[list[str]], model: Model, cache: Emissions | None = None):
    """(facts per document, marginals of all words): largest marginal, log expected toxic words, log of these per 100 words."""
    cache = Emissions(model) if cache is None else cache
    counts = np.array([len(ws) for ws in words], np.int64)
    flat = [w for ws in words for w in ws]
    marg = np.zeros(len(flat))
    top, total = np.zeros(len(words)), np.zeros(len(words))
    if flat:
        e = np.fromiter(map(cache.__getitem__, flat), float, len(flat))
        at, doc = runs(counts)
        live = at >= 0
        m = forward_backward(e[np.maximum(at, 0)], live, model.trans, model.start)
        m[~live] = 0.0
        marg[at[live]] = m[live]
        np.maximum.at(top, doc, m.max(1))
        np.add.at(total, doc, m.sum(1))
    return np.stack([top, np.log1p(total), np.log1p(100 * total / np.maximum(counts, 1))], axis=1), marg


def fit_head(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 1e-1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the labels outside the held-out fold, one row per id."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    return marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_totals(docs: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """Clean and toxic training rows with a text: what ``training_rows`` draws from."""
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    n = {r["toxic"]: r["n"] for r in training_labels(labels).join(there, "doc_id", "left_semi").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get(0, 0), n.get(1, 0)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled (text, toxic) rows outside the held-out fold."""
    marked = training_labels(labels)
    order = F.md5(F.col("doc_id").cast("string"))
    picked = [marked.where(F.col("toxic") == y).orderBy(order).limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    sample = F.broadcast(picked[0].union(picked[1]))  # bounded by the two limits
    got = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return [(r["text"], r["toxic"]) for r in got.orderBy("doc_id").collect()]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted, spans`` for every row; spans are (start, end, marginal) of toxic words in code points.

    NULL and empty texts have no words and score what the intercept says.  Repeated rows and NULL ids keep
    their rows; other columns are ignored; an empty table gives no row.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        cache = Emissions(m)
        for batch in batches:
            for part in small_batches(batch, "text", PART_CHARS):
                texts = [t or "" for t in part["text"]]
                words = [t.lower().split() for t in texts]
                facts, marg = document_facts(words, m, cache)
                p = 1 / (1 + np.exp(-np.clip(m.head[0] + facts @ m.head[1:], -30, 30)))
                spans, at = [], 0
                for t, ws, f in zip(texts, words, facts):
                    own, found = marg[at : at + len(ws)], []
                    at += len(ws)
                    if f[0] >= limit:
                        places = [w.span() for w in re.finditer(r"\S+", t)]
                        if len(places) == len(own):  # lower case may move word ends in rare scripts
                            found = [{"start": places[k][0], "end": places[k][1], "marginal": float(own[k])} for k in np.nonzero(own >= limit)[0]]
                    spans.append(found)
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32), "spans": spans})

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ident = d.schema["doc_id"].dataType.simpleString()
    # ids pass through pandas as text: a long column with a NULL would become double there
    out = d.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(ident))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = fit(training_rows(docs, labels), training_totals(docs, labels))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
