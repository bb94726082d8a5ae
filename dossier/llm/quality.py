"""Quality classifier: naive Bayes support vectors over n-gram indicators (op5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, broadcast_if_small, claim, discard, held_out, materialize, release, ship_code
from .grams import class_sample, draw, gram_codes

#: Labelled rows of each class to learn from, about; the bound of the sample.
SAMPLE_PER_CLASS = 3000
#: Characters of those rows at most.
SAMPLE_CHARS = 64_000_000
#: Indicators are hashed to this many bits.
BITS = 18
#: Score at which a document is accepted.
ACCEPT = 0.7
#: Slope of the score over the margin.
SLOPE = 4.0

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> int:
    """A word's shape: runs of lower, upper, digit or one other character, each once."""
    out = ""
    for c in word:
        s = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c
        if not out.endswith(s):
            out += s
    return xxhash.xxh64_intdigest(out.encode("utf-8", "surrogatepass")) >> 1


class Indicators:
    """Hashed indicators of a whole text: character 1- to 3-grams, and 1- to 3-grams of word shapes,
    where a word equal to the one before it has a shape of its own."""

    def __init__(self) -> None:
        self.shapes = Memo(_shape, 150_000)
        self.mark = np.zeros(1 << BITS, bool)

    def __call__(self, text: str) -> np.ndarray:
        mark, top = self.mark, np.uint64(64 - BITS)
        mark[:] = False
        if text:
            codes = gram_codes(text).view(np.uint64)
            mark[(codes * _MIX) >> top] = True
            words = text.split()
            if words:
                s = np.fromiter(map(self.shapes.__getitem__, words), np.uint64, len(words))
                h = np.fromiter(map(hash, words), np.int64, len(words))
                s[1:][h[1:] == h[:-1]] = np.uint64(61)
                gram = s * _MIX
                for n in range(3):
                    if n:
                        gram = (gram[:-1] ^ np.uint64(n)) * _MIX + s[n:]
                    if not len(gram):
                        break
                    mark[((gram ^ (gram >> np.uint64(29))) * _MIX) >> top] = True
        return np.flatnonzero(mark)


class SupportVectors:
    """Linear hinge loss on indicators scaled by class log-count ratios, by dual coordinate descent."""

    def __init__(self, texts: list[str], labels: list[int], cost: float = 1.0, epochs: int = 12, alpha: float = 1.0):
        self.weights, self.bias = np.zeros(1 << BITS, np.float32), 0.0
        y = np.array(labels, np.float64) * 2 - 1
        if len(set(labels)) < 2:
            self.bias = 2.0 * float(y.mean()) if labels else 0.0
            return
        find = Indicators()
        rows = [find(t).astype(np.int32) for t in texts]
        seen = {s: np.full(1 << BITS, alpha) for s in (1.0, -1.0)}
        for r, s in zip(rows, y):
            seen[s][r] += 1
        ratio = np.log(seen[1.0] / seen[1.0].sum()) - np.log(seen[-1.0] / seen[-1.0].sum())
        del seen
        scaled = lambda r: ratio[r] / math.sqrt(max(1, len(r)))  # noqa: E731 - made anew in each visit, as all rows of floats are many
        square = [float(v @ v) + 1 for v in map(scaled, rows)]
        upper = {s: cost * len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
        w, b, dual, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(0)
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                r, v, s = rows[i], scaled(rows[i]), y[i]
                slope = s * (w[r] @ v + b) - 1
                new = min(max(dual[i] - slope / square[i], 0.0), upper[s])
                if new != dual[i]:
                    step = (new - dual[i]) * s
                    w[r] += step * v
                    b += step
                    dual[i] = new
        self.weights, self.bias = (w * ratio).astype(np.float32), b

    def margin(self, marks: np.ndarray) -> float:
        return float(self.weights[marks].sum()) / math.sqrt(max(1, len(marks))) + self.bias


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS) -> SupportVectors:
    """Learn from a bounded sample (about ``per_class`` labelled rows and ``most_chars`` characters a class) of the rows that are not held out.

    Labels are drawn before the documents are read; a repeated id counts once, with its smallest text.
    """
    told = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("l"))
    counts = {r[0]: r[1] for r in told.groupBy("l").count().collect()}
    lot, take = draw("i"), F.lit(False)
    for value, n in counts.items():
        take = take | ((F.col("l") == value) & (lot < F.lit(min(1.0, 1.2 * per_class / n))))
    some = materialize(told.where(take).distinct(), "labels")
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).join(broadcast_if_small(some), "i")
    got = class_sample(rows.select("t", "l", draw("i").alias("draw")), per_class, most_chars) if counts else []
    discard(some)
    model = SupportVectors([t for t, _ in got], [y for _, y in got])
    del got
    release()
    return model


def score_quality(docs: DataFrame, model: SupportVectors, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 if score >= 0.7, else 0) of every whole text.

    Null texts count as empty; an empty text is scored by the bias. Without labelled rows the score is
    0.5; with one class only it leans to that class. A null id is not held out. Repeated rows are
    scored each; an empty table gives an empty result; ``keep`` names other columns to carry along.
    """
    spark = docs.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(model)
    carried = [c for c in keep or [] if c not in (id_col, "held_out", "score", "predicted")]
    others = [c for c in carried if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = claim("indicators", Indicators)
        for batch in batches:
            scores = [logistic(SLOPE * sent.value.margin(find(t.as_py() or ""))) for t in batch.column(2)]
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= ACCEPT) for s in scores], pa.int32())]
            kept = [batch.column(2) if c == text_col else batch.column(3 + others.index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *kept], names=[id_col, "held_out", "score", "predicted", *carried])

    wide = docs.select(F.col(id_col), held_out(id_col).alias("__held"), F.col(text_col).alias("__text"), *others)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", "held_out boolean", "score double", "predicted int", *[f"`{c}` {kinds[c]}" for c in carried]])
    return wide.mapInArrow(run, schema)
