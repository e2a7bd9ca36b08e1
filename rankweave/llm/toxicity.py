"""Toxicity by multiple-instance learning: documents carry labels, sentences carry scores.

A sentence's score is a logistic function of its distinct hashed words and word beginnings; a document is
toxic if any sentence is, so its score is the noisy-or of its sentences' scores. Training lowers the
documents' log-loss alone; the sentence scores then say where the offending sentences are.

The fit uses about `max_docs` labelled rows of either class, picked by a hash of doc_id at a rate
that one count per class sets, with weights that restore the classes' shares. Whole texts are trained
on and scored; all documents are scored.

Null and empty texts have no sentence and score the model's share for an empty sentence, near 0. Rows
without a label teach nothing; without any labelled row, or with one class only among those that have
words, every score is the share of toxic rows seen (0 without rows). Repeated rows score alike. Only doc_id, text and the label
are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.memory import give_back

MAX_DOCS = 3000
BITS = 18
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its first four letters."""
    raw = word.encode("utf-8", "surrogatepass")
    start = word[:4].encode("utf-8", "surrogatepass")
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"w" + raw) & mask] + ([zlib.crc32(b"p" + start) & mask] if len(word) > 4 else [])


class _WordScores(dict):
    """Summed weights of words, worked out once for each word; bounded."""

    def __init__(self, weights: dict[int, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 50_000:
            self.clear()
        found = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return found


@dataclass
class ToxicityModel:
    """Bias and the weights that are not 0."""

    bias: float
    weights: dict[int, float]
    scores: _WordScores | None = field(default=None, compare=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "scores": None}

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and logit of each sentence."""
        if self.scores is None:
            self.scores = _WordScores(self.weights)
        look = self.scores.__getitem__
        lower = (text or "").lower()
        return [(m.start(), m.end(), self.bias + sum(map(look, dict.fromkeys(_WORD.findall(m.group()))))) for m in _SENTENCE.finditer(lower)]

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences' scores."""
        logits = [z for _, _, z in self.sentences(text)] or [self.bias]
        return float(-np.expm1(-np.logaddexp(0.0, np.array(logits)).sum()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, weight, features and each sentence's end among them."""
    for batch in batches:
        labels, weights, features, ends = [], [], [], []
        for label, weight, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own, stops = [], []
            for sentence in _SENTENCE.findall((text or "").lower()):
                own.extend(dict.fromkeys(f for word in _WORD.findall(sentence) for f in word_features(word)))
                if own and (not stops or stops[-1] < len(own)):
                    stops.append(len(own))
            if own:
                labels.append(label)
                weights.append(weight)
                features.append(own)
                ends.append(stops)
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array(weights, pa.float64()), pa.array(features, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["label", "weight", "features", "ends"]
        )


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, steps: int = 250) -> ToxicityModel:
    """Fits on docs (doc_id, text) that have a row in labels (doc_id, label: 0, 1 or null). The picked
    labels, about 2 * max_docs rows whatever the input's size, go to all tasks, so texts stay in place."""
    known = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return ToxicityModel(30.0 if totals.get(1) else -30.0, {})
    at = F.xxhash64(F.lit("toxicity-sample"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, max_docs / totals[1]))).otherwise(F.lit(min(1.0, max_docs / totals[0])))
    picked = known.where(at < rate).withColumn("weight", 1 / rate)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = rows.select("label", "weight", "text").mapInArrow(_bags, "label int, weight double, features array<int>, ends array<int>").toArrow()
    classes = set(found["label"].to_pylist())
    if len(classes) < 2:  # the documents at hand are of one class, or none has words
        return ToxicityModel(30.0 if 1 in classes else -30.0, {})
    return _fit(found, steps)


def _fit(bags: pa.Table, steps: int) -> ToxicityModel:
    label = bags["label"].to_numpy().astype(float)
    weight = bags["weight"].to_numpy()
    features = bags["features"].combine_chunks()
    flat, starts = features.flatten().to_numpy(), np.asarray(features.offsets)[:-1] - np.asarray(features.offsets)[0]
    end_list = bags["ends"].combine_chunks()
    per_doc = np.diff(np.asarray(end_list.offsets))
    doc_of = np.repeat(np.arange(len(label)), per_doc)
    stops = end_list.flatten().to_numpy() + starts[doc_of]
    sentence_of = np.searchsorted(stops, np.arange(len(flat)), side="right")
    # Features that tell the classes apart at all, by documents; the rest keep weight 0.
    pairs = np.unique(doc_of[sentence_of].astype(np.int64) << BITS | flat)
    own, value = pairs >> BITS, pairs & ((1 << BITS) - 1)
    toxic_df = np.bincount(value[label[own] == 1], minlength=1 << BITS)
    clean_df = np.bincount(value[label[own] == 0], minlength=1 << BITS)
    toxic_n, clean_n = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    odds = np.log((toxic_df + 0.5) / (toxic_n + 1)) - np.log((clean_df + 0.5) / (clean_n + 1))
    keep = (toxic_df + clean_df >= 3) & (np.abs(odds) > 0.7)
    use = keep[flat]
    kept_ids = np.flatnonzero(keep)
    column = np.searchsorted(kept_ids, flat[use])
    row = sentence_of[use]
    w, bias = np.zeros(len(kept_ids)), -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = weight / weight.mean()
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[column], minlength=len(stops))
        soft = np.logaddexp(0.0, z)
        clear = np.bincount(doc_of, weights=soft, minlength=len(label))  # -log of "no sentence is toxic"
        toxic = np.maximum(-np.expm1(-clear), 1e-12)
        slope = weight * np.where(label == 1, -(1 - toxic) / toxic, 1.0)  # of the loss, by `clear`
        by_z = slope[doc_of] * np.exp(-np.logaddexp(0.0, -z))
        grad = np.bincount(column, weights=by_z[row], minlength=len(w)) / len(label) + 1e-5 * w
        grad_b = by_z.sum() / len(label)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        rate = 0.25
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    used = np.abs(w) > 1e-3
    return ToxicityModel(float(bias), dict(zip(kept_ids[used].tolist(), w[used].tolist(), strict=True)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((shared.value.score(t.as_py()) for t in batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def is_toxic(model: ToxicityModel, docs: DataFrame, least: float = 0.5) -> Column:
    """A column over `text` that is true where the score is `least` or more; rows keep all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield text.map(lambda t: shared.value.score(t) >= least).astype(bool)
        give_back()

    return toxic(F.col("text"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (characters), sentence and score of the sentences at or over `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end, z in shared.value.sentences(text):
                    if (p := float(1 / (1 + np.exp(-z)))) >= least:
                        out.append((doc_id, start, end, (text or "")[start:end], p))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")
