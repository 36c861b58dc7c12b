"""Counterfactual-regularised toxicity classifier.

A logistic model on the presence of words and parts of words. In training, identity terms in the sentences of labelled documents
are swapped for another term of their group; the squared change of the score is penalised, so that naming a group does not make a
text toxic by itself. The model is fitted on a bounded sample of labelled rows and applied to whole texts where they lie.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import stored

# Identity terms by group, in the languages of the corpus.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Hash space of features, and the lengths of word parts.
DIMENSIONS = 1 << 20
PARTS = (3, 4, 5, 6)


def word_features(word: str) -> tuple[int, ...]:
    """A word, its beginnings and its ends, hashed."""
    parts = {f"={word}"} | {f"^{word[:n]}" for n in PARTS if n < len(word)} | {f"{word[-n:]}$" for n in PARTS if n < len(word)}
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % DIMENSIONS for p in parts)


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(found: set[str]) -> np.ndarray:
    return np.unique(np.array([f for w in found for f in word_features(w)], dtype=np.int32))


def swap_table(groups) -> dict[str, str]:
    """Each term and the next one of its group."""
    return {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}


def counterfactuals(text: str | None, swaps: dict[str, str]) -> list[tuple[set[str], set[str]]]:
    """Word sets of the sentences that name a group, as they stand and with the terms swapped."""
    low = (text or "").lower()
    if not any(t in low for t in swaps):
        return []
    sentences = [WORD.findall(s) for s in SENTENCE.findall(low)]
    return [(set(s), {swaps.get(w, w) for w in s}) for s in sentences if any(w in swaps for w in s)]


@dataclass
class Model:
    """``weights`` by feature; without labels of both classes there are none and ``bias`` is the share of toxic labels. ``n_pairs`` is
    the number of swapped sentences that the penalty acted on: none where no labelled text names a group."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    n_pairs: int = 0

    def scorer(self):
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for w in text_words(text):
                got = known.get(w)
                if got is None:
                    if len(known) > 100_000:
                        known.clear()
                    got = known[w] = tuple(f for f in word_features(w) if f in weights)
                hit.update(got)
            z = self.bias + sum(weights[f] for f in sorted(hit))
            return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

        return score


class Rows:
    """Sparse 0/1 rows in one array."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.n, self.columns = len(rows), columns
        self.at = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=r[self.row], minlength=self.columns)


def train(
    rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
    penalty: float = 1.0, l1: float = 5e-4, l2: float = 1e-4, max_features: int = 20_000, steps: int = 300,
) -> Model:
    """Weighted logistic loss, L1 and L2, and ``penalty`` times the mean squared score change of the pairs; accelerated proximal
    gradient. The ``max_features`` features with the strongest association to the label take part."""
    weight = weight / weight.sum() if len(weight) else weight
    rate = float((weight * label).sum()) if len(label) else 0.0
    if not 0 < rate < 1:
        return Model(40.0 if rate >= 1 else -40.0)
    every, sizes = np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32), [len(r) for r in rows]
    seen = np.bincount(every)
    known = np.flatnonzero(seen)
    of = np.stack([np.bincount(every, weights=np.repeat(weight * (label == y), sizes))[known] for y in (0, 1)])
    seen = seen[known]
    del every
    total, share = of.sum(axis=0), np.array([1 - rate, rate])
    gain = sum(np.where(of[k] > 0, of[k] * np.log(np.maximum(of[k], 1e-300) / np.maximum(total * share[k], 1e-300)), 0.0) for k in (0, 1))
    gain[seen < 3] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[:max_features])
    chosen = known[chosen[gain[chosen] > 0]]
    if not len(chosen):
        return Model(float(np.log(rate / (1 - rate))), {}, len(pairs))

    def place(r: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(chosen, r), len(chosen) - 1)
        return np.where(chosen[at] == r, at, -1)

    only = lambda r: (at := place(r))[at >= 0]
    x = Rows([only(r) for r in rows], len(chosen))
    a, b = Rows([only(p) for p, _ in pairs], len(chosen)), Rows([only(q) for _, q in pairs], len(chosen))
    n_pairs = max(1, len(pairs))
    v = np.ones(len(chosen)) / max(1.0, np.sqrt(len(chosen)))
    bound = 1.0
    for _ in range(20):  # largest curvature, by power iteration
        change = a.times(v) - b.times(v)
        u = x.back(weight * (x.times(v) + v.mean())) / 4 + 2 * penalty / n_pairs * (a.back(change) - b.back(change))
        bound = float(np.linalg.norm(u)) or 1.0
        v = u / bound
    step = 1 / (1.5 * bound + l2 + 0.25)
    w, bias = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.clip(x.times(ahead) + ahead_bias, -40, 40)
        error = weight * (1 / (1 + np.exp(-z)) - label)
        change = a.times(ahead) - b.times(ahead)
        slope = x.back(error) + l2 * ahead + 2 * penalty / n_pairs * (a.back(change) - b.back(change))
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = ahead_bias - step * float(error.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return Model(bias, {int(chosen[k]): float(w[k]) for k in np.flatnonzero(w)}, len(pairs))


def fit(
    df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = 8_000, groups=IDENTITY_TERMS, penalty: float = 1.0, seed: int = 1, max_features: int = 20_000,
) -> Model:
    """Fit on ``max_rows`` labelled rows at most, half of them for each label where there are as many.

    The bound holds for the classifier alone. Labels are first reduced to one per document (toxic if any says so); each label's
    rows are drawn by a hash at the rate that its count asks for and weighted by the inverse rate. Documents whose id stands in
    ``df`` several times give one row. Null ids and null labels are not used.
    """
    marked = labels.select(F.col(label).alias("y"), F.col(doc_id).alias("id")).where("id is not null and y is not null")
    marked = marked.groupBy("id").agg(F.max(F.when(F.col("y") != 0, 1).otherwise(0)).alias("y"))
    counts = {int(y): int(n) for y, n in marked.groupBy("y").agg(F.count("*")).collect()}
    rates = {y: min(1.0, 0.9 * max_rows / 2 / n) for y, n in counts.items()}
    if len(rates) < 2:
        return train([], np.ones(0) if not counts else np.full(1, float(next(iter(counts)))), np.ones(len(counts)), [])
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) * F.lit(2.0**-53)
    drawn = marked.where(uniform < F.when(F.col("y") == 1, rates[1]).otherwise(rates[0])).orderBy("id").limit(max_rows)
    swaps = swap_table(groups)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, pairs = [], []
            for t in batch.column("text").to_pylist():
                data.append(features(text_words(t)))
                swapped = {(features(p).tobytes(), features(q).tobytes()) for p, q in counterfactuals(t, swaps)}
                pairs.append([x for p in sorted(swapped) for x in p])
            columns = [batch.column("id"), batch.column("y"), pa.array(data, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "data", "pairs"])

    kind = marked.schema["id"].dataType.simpleString()
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sample = docs.join(F.broadcast(drawn), "id").select("id", "y", "text")  # max_rows ids at most
    made = sample.mapInArrow(featurise, f"id {kind}, y int, data array<int>, pairs array<binary>")
    got = stored(made.groupBy("id").agg(F.min(F.struct("y", "data", "pairs")).alias("r")).select("id", "r.*"), "labelled-features")

    # Features are chosen by counts; only their places in the rows leave the executors.
    n_of = {int(y): int(n) for y, n in got.groupBy("y").agg(F.count("*")).collect()}
    whole = sum(n / rates[y] for y, n in n_of.items())
    held = got.select("y", F.explode("data").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n1"))
    mass = {1: F.col("n1") / (rates[1] * whole), 0: (F.col("n") - F.col("n1")) / (rates[0] * whole)}
    part = lambda y: F.when(mass[y] > 0, mass[y] * F.ln(mass[y] / ((mass[0] + mass[1]) * F.lit(n_of.get(y, 0) / rates[y] / whole)))).otherwise(0.0)
    best = held.where("n >= 3").select("f", (part(0) + part(1)).alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "f").limit(max_features) if len(n_of) == 2 else held.limit(0)
    chosen = np.sort(np.array([r["f"] for r in best.select("f").collect()], dtype=np.int32))

    def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: np.intersect1d(np.asarray(x, dtype=np.int32), chosen).tobytes()
        for batch in batches:
            data = [of(x) for x in batch.column("data").to_pylist()]
            pairs = [[of(np.frombuffer(x, dtype=np.int32)) for x in p] for p in batch.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(data, pa.binary()), pa.array(pairs, pa.list_(pa.binary()))], names=["id", "y", "data", "pairs"])

    rows = got.mapInArrow(only_chosen, f"id {kind}, y int, data binary, pairs array<binary>").orderBy("id").toArrow()
    of = lambda x: np.frombuffer(x, dtype=np.int32)
    label_of = rows["y"].to_numpy().astype(float)
    pairs = [(of(p[k]), of(p[k + 1])) for p in rows["pairs"].to_pylist() for k in range(0, len(p), 2)]
    data = [of(x) for x in rows["data"].to_pylist()]
    return train(data, label_of, np.where(label_of == 1, 1 / rates[1], 1 / rates[0]), pairs, penalty, max_features=max_features)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the column ``into``, the probability of a toxic label; null and empty texts get the score of no words.

    Whole texts are read; rows are independent, equal texts get equal scores, there is no shuffle. A column of the name ``into`` is replaced.
    """

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for batch in texts:
            yield batch.map(of, na_action=None).astype(float)

    return df.withColumn(into, scored(F.col(text)))
