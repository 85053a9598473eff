"""Toxicity by weak supervision.

Voters are a fixed lexicon, one voter a word, and patterns: whole words and
four-letter word beginnings that a bounded sample of labelled rows ties to the
label. A generative model of the votes, fitted by expectation maximisation,
estimates how often each voter fires on toxic and on clean texts; correlations
that remain given the label are estimated too, and correlated voters share their
weight. A logistic regression over words and word beginnings is then trained on
the model's posterior labels, and it alone scores documents.

Training reads at most about ``SAMPLE`` labelled rows of each class, by a hash of
doc_id, from rows outside the held-out fifth. The chosen labels are broadcast, so
no text is shuffled. Features of the chosen texts, however long, are counted where they
are; what reaches the driver is the counts of the best features, and which of them each
chosen text has. Everything else covers all rows.

Defined results: null, empty and wordless texts get the score of no feature.
Without toxic training rows the lexicon votes alone. Null labels don't count, and
labels that repeat count once. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table
from .language_id import held_out

#: Labelled training rows of a class, about, at most.
SAMPLE = 1500
#: Pattern voters and classifier features at most.
MOST_VOTERS, MOST_FEATURES = 120, 600
BEGINNING = 4
SHRINK = 0.0005
#: Votes of voters that correlate more than this, given the label, are shared.
TIED = 0.3
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless",
    "disgusting", "clown", "jerk", "creep", "filth", "vermin", "imbecile", "fool", "hateful", "ugly",
)

_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Lower-case words, and the beginnings of longer ones with a mark."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sorted(features(text))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(found, pa.string())], names=["row", "feature"])


def _counts(found: DataFrame, labels: dict[int, bool]) -> tuple[DataFrame, float, float, float]:
    """``feature, k, rest`` (rows with it that are toxic, and others), how many rows are of each
    class, and how large a log-likelihood ratio the best of as many unrelated features
    would reach: twice the logarithm of their number."""
    rows = found.sparkSession.createDataFrame(list(labels.items()), "row long, toxic boolean")
    marked = found.join(F.broadcast(rows), "row").groupBy("feature").agg(F.count_if("toxic").alias("k"), F.count_if(~F.col("toxic")).alias("rest"))
    often = marked.where("k + rest >= 3")
    many = often.agg(F.count_if(F.col("k") > 0).alias("a"), F.count_if(F.col("rest") > 0).alias("b")).first()
    n1 = max(1, sum(labels.values()))
    return marked, n1, max(1, len(labels) - n1), 2 * math.log(max(2, many["a"] + many["b"]))


def _surely_tied(n1: float, n0: float, least: float) -> F.Column:
    """Whether a feature is commoner on toxic rows than chance explains."""
    k, rest, share = F.col("k"), F.col("rest"), n1 / (n1 + n0)
    n = k + rest
    g = 2 * (k * F.log(k / (n * share)) + F.when(rest > 0, rest * F.log(rest / (n * (1 - share)))).otherwise(0.0))
    return (k > 0) & (n >= 3) & (k > 2 * n * share) & (g > least)


def choose_voters(found: DataFrame, labels: dict[int, bool]) -> list[str]:
    """The lexicon, and features far commoner on toxic rows than on clean ones."""
    marked, n1, n0, least = _counts(found, labels)
    ratio = F.log((F.col("k") + 0.5) / n1) - F.log((F.col("rest") + 0.5) / n0)
    ranked = marked.where(_surely_tied(n1, n0, least)).where(ratio > 2).orderBy((F.col("k") * ratio).desc(), F.col("feature").desc())
    patterns = [r["feature"] for r in ranked.limit(MOST_VOTERS).collect()]
    return [*LEXICON, *(p for p in patterns if p not in LEXICON)]


def present(found: DataFrame, names: list[str], rows: list[int]) -> list[set[str]]:
    """Which of a few features each row has."""
    own = found.where(F.col("feature").isin(names)).groupBy("row").agg(F.collect_set("feature").alias("has"))
    held = {r["row"]: set(r["has"]) for r in own.collect()}
    return [held.get(r, set()) for r in rows]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of the label for each row of 0/1 votes.

    ``start`` is a first guess. Returns soft labels after EM with voters weighed
    down by what they repeat of one another."""
    post, n = np.clip(start.astype(float), 0.02, 0.98), len(votes)
    weight = np.ones(votes.shape[1])
    for step in range(rounds):
        p1, p0 = post.sum(), n - post.sum()
        a = (np.einsum("ij,i->j", votes, post) + 0.5) / (p1 + 1)
        b = (np.einsum("ij,i->j", votes, 1 - post) + 0.05) / (p0 + 1)
        b = np.minimum(b, a)  # a voter speaks for the label or not at all
        if step in (4, 14):
            rest = votes - np.outer(post, a) - np.outer(1 - post, b)
            spread = np.sqrt(np.einsum("ij,ij->j", rest, rest) + 1e-9)
            corr = np.einsum("ij,ik->jk", rest, rest) / np.outer(spread, spread)
            weight = 1 / (1 + np.where(corr > TIED, corr, 0).sum(axis=1) - np.diag(corr))
        # A silent voter abstains: it says nothing of the label.
        silent = math.log(max(1e-3, 1 - float(votes.any(axis=1)[post > 0.5].mean() if (post > 0.5).any() else 0)))
        odds = np.einsum("ij,j->i", votes, np.log(a / b) * weight) + np.where(votes.any(axis=1), math.log((p1 + 1) / (p0 + 1)), silent)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def choose_features(found: DataFrame, labels: dict[int, bool]) -> list[str]:
    """Features for the classifier, and words of the lexicon, by how much they tell."""
    marked, n1, n0, least = _counts(found, labels)
    # Only features tied to the label: a long clean text would add up the noise of others.
    tie = F.log((F.col("k") + 0.5) / (n1 + 1)) - F.log((F.col("rest") + 0.5) / (len(labels) - n1 + 1))
    sure = marked.where(F.col("k") > 0).where(_surely_tied(n1, n0, least) | F.col("feature").isin(list(LEXICON))).where(tie > 2)
    return [r["feature"] for r in sure.orderBy((F.col("k") * tie).desc(), "feature").limit(MOST_FEATURES).collect()]


def fit_linear(names: list[str], sets: list[set[str]], target: np.ndarray, steps: int = 400) -> dict[str, float]:
    """Logistic regression on the presence of features; the bias has the empty name."""
    n, n1 = max(1, len(sets)), max(1, int((target > 0.5).sum()))
    index = {f: i for i, f in enumerate(names)}
    rows, cols = [], []
    for i, found in enumerate(sets):
        mine = sorted(index[f] for f in found if f in index)
        cols += mine
        rows += [i] * len(mine)
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    w, bias, m, v = np.zeros(len(names)), 0.0, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    balance = np.where(target > 0.5, n / (2 * n1), n / (2 * max(1, n - n1)))
    for step in range(1, steps + 1):
        z = bias + np.bincount(rows, weights=w[cols], minlength=len(sets))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance / n
        g = np.append(np.bincount(cols, weights=err[rows], minlength=len(names)) + 1e-5 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
        # Little weights are noise that long texts would add up.
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    return {"": float(bias)} | {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 0.05}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    usable = labels.where("toxic IS NOT NULL").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}  # a row a class
    share = F.when(F.col("toxic") == 1, F.lit(sample / max(1, counts.get(1, 1)))).otherwise(F.lit(sample / max(1, counts.get(0, 1))))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = usable.where(chance < share)  # about 2 * sample rows at most, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.xxhash64("doc_id", "text", "toxic").alias("row"), "doc_id", "toxic", "text")
    found = cut(rows.select("row", "text").mapInArrow(_found, "row long, feature string").distinct(), "toxicity-features")
    thin = rows.select("row", "doc_id", "toxic").distinct().orderBy("doc_id", "row").limit(4 * sample).collect()  # the limit binds only where doc_ids repeat
    ids, labels = [r["row"] for r in thin], {r["row"]: r["toxic"] == 1 for r in thin}
    if not any(labels.values()):
        return {"": -3.0} | dict.fromkeys(LEXICON, 4.0)
    voters = choose_voters(found, labels)
    votes = np.array([[f in has for f in voters] for has in present(found, voters, ids)], dtype=float)
    # The voters' majority starts the model where voters speak, the label elsewhere.
    spoken, y = votes.sum(axis=1) > 0, np.array([float(labels[r]) for r in ids])
    post = label_model(votes, np.where(spoken, 0.9, 0.5 * y))
    names = choose_features(found, dict(zip(ids, (post > 0.5).tolist(), strict=True)))
    return fit_linear(names, present(found, names, ids), post)


def _scores(model: dict[str, float]) -> Callable:
    bias, weights = model[""], {f: w for f, w in model.items() if f}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                z = bias + sum(sorted(weights[f] for f in known & features(text)))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_scores(model), "doc_id long, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
