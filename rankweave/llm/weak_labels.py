"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or abstain (0). Expectation-maximisation estimates
each labeller's rates of every vote given the true class and the classes' shares; it runs on the
counts of vote patterns over all documents (at most 3 ** labellers rows, whatever the corpus's
size). Posterior labels then train a linear scorer of hashed words and word shapes by gradient
steps, on about `max_docs` documents picked by a hash, of which the driver gets votes and hashed counts
(2 ** 18 numbers a document at most), not texts; the scorer covers all documents.

Null and empty texts count as texts without words: labellers that need words abstain and the score is
the scorer's share for no evidence, posterior as the votes say. Texts are read whole. Ties in votes
share a posterior. Repeated rows come out alike. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.line_rules import clean, counts
from rankweave.llm.shared import cut

MAX_DOCS = 4000
BITS = 18
_PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]?")
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_MASK = (1 << BITS) - 1


def _few_symbols(text: str, f: dict) -> int:
    share = f["symbols"] / max(1, f["chars"])
    return 0 if f["words"] < 5 else -1 if share > 0.05 else 1 if share < 0.005 else 0


def _little_repetition(text: str, f: dict) -> int:
    share = f["repeats"] / max(1, f["words"])
    return 0 if f["words"] < 20 else -1 if share > 0.3 else 1 if share < 0.05 else 0


def _distinct_lines(text: str, f: dict) -> int:
    return 0 if f["lines"] < 3 else -1 if f["dup_lines"] > 0.2 * f["lines"] else 1 if f["dup_lines"] == 0 else 0


def _length(text: str, f: dict) -> int:
    return -1 if f["words"] < 20 else 1 if f["words"] >= 100 else 0


def _word_length(text: str, f: dict) -> int:
    mean = f["chars"] / max(1, f["words"])
    return 0 if f["words"] < 5 else -1 if mean > 9 or mean < 2.5 else 1 if 3.5 <= mean <= 7.5 else 0


def _lower_case(text: str, f: dict) -> int:
    letters = f["letters"]
    return 0 if letters < 20 else -1 if f["upper"] > 0.3 * letters else 1 if f["upper"] < 0.1 * letters else 0


def _clean_lines(text: str, f: dict) -> int:
    return 0 if f["words"] < 5 else -1 if f["lost"] > 0.4 * f["words"] else 1 if f["lost"] < 0.1 * f["words"] else 0


def _plain_words(text: str, f: dict) -> int:
    share = f["plain"] / max(1, f["words"])
    return 0 if f["words"] < 5 else -1 if share < 0.6 else 1 if share > 0.9 else 0


#: The labellers; each takes a text and its counts.
LABELLERS = (_few_symbols, _little_repetition, _distinct_lines, _length, _word_length, _lower_case, _clean_lines, _plain_words)


def text_counts(text: str) -> dict:
    """What the labellers look at, of a whole text."""
    words, chars, symbols, dup_lines, repeats = counts(text)
    _, before, after, _ = clean(text)
    pieces = text.split()
    return {
        "words": words, "chars": chars, "symbols": symbols, "dup_lines": dup_lines, "repeats": repeats, "lost": before - after,
        "lines": sum(1 for x in text.split("\n") if x.strip()), "letters": sum(map(len, _LETTERS.findall(text))),
        "upper": sum(map(len, _UPPER.findall(text))), "plain": len(pieces) - list(map(_PLAIN.fullmatch, pieces)).count(None),
    }


def votes(text: str | None) -> tuple[int, ...]:
    """Each labeller's vote."""
    found = text_counts(text or "")
    return tuple(labeller(text or "", found) for labeller in LABELLERS)


@dataclass
class VoteModel:
    """share: of good documents; rates[class][labeller][vote + 1]."""

    share: float
    rates: np.ndarray

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """Probability that a document with these votes is good."""
        at = np.array(pattern) + 1
        logs = np.log(self.rates[:, np.arange(len(at)), at]).sum(axis=1) + np.log([1 - self.share, self.share])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def expectation_maximisation(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100) -> VoteModel:
    """Starts from the majority of votes, which also says which class is the good one."""
    n_labellers = patterns.shape[1]
    good = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    model = VoteModel(0.5, np.full((2, n_labellers, 3), 1 / 3))
    for _ in range(rounds):
        share = float(np.clip((good * weights).sum() / max(weights.sum(), 1), 0.01, 0.99))
        rates = np.empty((2, n_labellers, 3))
        for k, mass in enumerate(((1 - good) * weights, good * weights)):
            for vote in (-1, 0, 1):
                rates[k, :, vote + 1] = (mass[:, None] * (patterns == vote)).sum(axis=0) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        model = VoteModel(share, rates)
        after = np.array([model.posterior(tuple(p)) for p in patterns])
        if len(after) and np.abs(after - good).max() < 1e-6:
            break
        good = after
    return model


class _Kinds(dict):
    """For str.translate: a code point to A (upper), a (other letter), 0 (digit) or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        found = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return found


_KINDS = _Kinds()


def _shape_feature(kinds: str) -> int:
    """Of a token's kinds, with runs as one; of long tokens the first eight runs."""
    return zlib.crc32(b"s" + _RUN.sub(r"\1", kinds)[:8].encode("utf-8", "surrogatepass")) & _MASK


def _word_feature(token: str) -> int:
    return zlib.crc32(b"t" + token.lower().encode("utf-8", "surrogatepass")) & _MASK


def token_features(token: str) -> list[int]:
    """Hashed features of a token: itself in lower case, and its shape."""
    return [_word_feature(token), _shape_feature(token.translate(_KINDS))]


class _TokenScores(dict):
    """Summed weights of tokens, worked out once while they stay in this bounded table."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = memoryview(weights.astype(np.float64))
        self.shapes: dict[str, float] = {}

    def __missing__(self, token: str) -> float:
        if len(self) > 100_000:
            self.clear()
            self.shapes.clear()
        kinds = token.translate(_KINDS)
        by_shape = self.shapes.get(kinds)
        if by_shape is None:
            by_shape = self.shapes[kinds] = self.weights[_shape_feature(kinds)]
        found = self[token] = self.weights[_word_feature(token)] + by_shape
        return found


@dataclass
class LinearScorer:
    """Logit = bias + weights' mean over the text's tokens."""

    bias: float
    weights: np.ndarray
    scores: _TokenScores | None = field(default=None, compare=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "scores": None}

    def score(self, text: str | None) -> float:
        if self.scores is None:
            self.scores = _TokenScores(self.weights)
        tokens = (text or "").split()
        z = self.bias + (sum(map(self.scores.__getitem__, tokens)) / len(tokens) if tokens else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of a text's tokens, and each one's count over the tokens."""
    tokens = (text or "").split()
    ids, n = np.unique(np.array([f for t in tokens for f in token_features(t)], dtype=np.int64), return_counts=True)
    return ids, n / max(1, len(tokens))


def fit_scorer(features: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 120) -> LinearScorer:
    """Logistic regression with soft labels on texts' features."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not features:
        return LinearScorer(bias, w.astype(np.float32))
    row = np.repeat(np.arange(len(features)), [len(ids) for ids, _ in features])
    column, value = (np.concatenate([np.asarray(f[k], dtype=kind) for f in features]) for k, kind in enumerate((np.int64, np.float64)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[column] * value, minlength=len(features))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - good
        grad = np.bincount(column, weights=error[row] * value, minlength=len(w)) / len(features) + 1e-7 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.mean(), 0.99 * vb + 0.01 * error.mean() ** 2
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return LinearScorer(bias, w.astype(np.float32))


def _marks(text: str | None) -> str:
    """Votes as one character each."""
    return "".join("-0+"[v + 1] for v in votes(text))


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_marks(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["doc_id", "h", "votes"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes and features of sampled texts: what leaves for the driver in the texts' stead."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        found = [text_features(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_marks(t) for t in texts], pa.string()), pa.array([ids.astype(np.int32) for ids, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.float64()))],
            names=["votes", "ids", "counts"],
        )


def quality_scores(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, votes, posterior, score and predicted (score of at least 0.5) of every row. Votes, the dear
    part, are cast once; the score's pass finds them by doc_id and a hash of the text."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    voted = cut(keyed.mapInArrow(_vote_rows, "doc_id long, h long, votes string"))
    table_ = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()
    if not len(table_):
        return voted.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    patterns = np.array([["-0+".index(c) - 1 for c in p] for p in table_["votes"]])
    model = expectation_maximisation(patterns, table_["n"].to_numpy(dtype=float))
    known = {p: model.posterior(tuple(row)) for p, row in zip(table_["votes"], patterns, strict=True)}
    at = F.xxhash64(F.lit("quality-sample"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    sample = docs.where(at < min(1.0, max_docs / int(table_["n"].sum()))).select("text").mapInArrow(_feature_rows, "votes string, ids array<int>, counts array<double>").toPandas()
    scorer = fit_scorer(list(zip(sample["ids"], sample["counts"], strict=True)), np.array([known.get(v, 0.5) for v in sample["votes"]]))
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "h", "score"])

    scored = keyed.mapInArrow(run, "doc_id long, h long, score double")
    seen = voted.distinct().select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "votes")
    means = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    met = scored.join(seen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    return met.select("doc_id", "votes", means[F.col("votes")].alias("posterior"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
