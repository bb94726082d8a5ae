"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy (op12)."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, discard, materialize
from .common import Memo, claim, ship_code
from .grams import class_sample, draw

#: Labelled rows of each class to learn from, about, and characters of those rows at most: the bound of the sample.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2500, 16_000_000
#: Buckets (bits) and dimensions of the embeddings, and the n-grams of a word in its marks < and >.
BITS, DIMS, SHORTEST, LONGEST = 17, 8, 3, 5
#: Words of a stretch. A document is two bags: all its words, and its most toxic stretch, as a few words in a long text are enough.
STRETCH = 8
#: Passes over the sample: as many as give STEPS steps, from 6 to PASSES; documents of a step, and its rate.
PASSES, STEPS, STEP_DOCS, RATE = 14, 900, 32, 1.0
ACCEPT = 0.5
#: Words whose scores a task remembers.
WORD_BOUND = 400_000

_WORD = re.compile(r"\w{1,64}")


def words_of(text: str) -> list[str]:
    """Words in lower case, a word right after itself once; a run of over 64 letters goes in pieces."""
    found = _WORD.findall(text.lower())
    return [w for w, last in zip(found, ["", *found]) if w != last]


def grams_of(word: str) -> list[int]:
    """Buckets of a word and of its n-grams."""
    w = f"<{word}>"
    found = [w[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)] + [w + "="]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) >> (32 - BITS) for g in found]


def stretch_means(scores: np.ndarray) -> np.ndarray:
    """Means of every STRETCH consecutive scores; of fewer, their mean."""
    if len(scores) <= STRETCH:
        return scores.mean(keepdims=True)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[STRETCH:] - total[:-STRETCH]) / STRETCH


class SubwordBags:
    """A vector for each bucket and a softmax over two classes, learnt together by adaptive gradient steps.

    A word is the mean of its grams' vectors, a bag the mean of its words; the softmax sees a document's two
    bags side by side. The stretch is chosen anew in each pass, the one that the model holds for the most
    toxic, so texts labelled clean teach from what looks worst in them.
    """

    def __init__(self, texts: list[str], labels: list[int], passes: int = PASSES):
        rng = np.random.default_rng(0)
        self.vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
        self.softmax, self.bias = rng.uniform(-1, 1, (2, 2 * DIMS)), np.zeros(2)
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            self.softmax[:] = 0
            self.bias[1] = 0.0 if not labels else 2.0 if labels[0] else -2.0
        else:
            self._learn(texts, y, rng, passes)
        lean = (self.softmax[1] - self.softmax[0]).reshape(2, DIMS)
        self.scores, self.lean = (self.vectors @ lean.T).astype(np.float32), float(self.bias[1] - self.bias[0])
        del self.vectors

    def _learn(self, texts: list[str], y: np.ndarray, rng: np.random.Generator, passes: int) -> None:
        index: dict[str, int] = {}
        docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
        found = [grams_of(w) for w in index]
        sizes = np.array([len(g) for g in found])
        starts, flat = np.concatenate([[0], np.cumsum(sizes)]), np.fromiter((g for f in found for g in f), np.int32, int(sizes.sum()))
        del index, found
        weight = len(y) / (2 * np.bincount(y, minlength=2))
        slopes, tops = np.full(1 << BITS, 1e-6), [np.full((2, 2 * DIMS), 1e-6), np.full(2, 1e-6)]
        usable = [i for i in range(len(docs)) if len(docs[i])]
        passes = min(passes, max(6, STEPS * STEP_DOCS // max(1, len(usable))))
        for n in range(passes):
            lean = (self.softmax[1] - self.softmax[0])[DIMS:]
            each = np.add.reduceat((self.vectors @ lean)[flat], starts[:-1]) / sizes
            worst = {i: int(stretch_means(each[docs[i]]).argmax()) for i in usable}
            order = rng.permutation(usable)
            for a in range(0, len(order), STEP_DOCS):
                some = order[a : a + STEP_DOCS]
                bags = [docs[i] for i in some] + [docs[i][worst[i] : worst[i] + STRETCH] for i in some]
                self._step(bags, y[some], weight, starts, sizes, flat, slopes, tops, RATE * (1 - n / (passes + 1)))

    def _step(self, bags: list, y: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, slopes: np.ndarray, tops: list, rate: float) -> None:
        """One step on the whole texts and then the stretches of some documents."""
        lens = np.array([len(b) for b in bags])
        share = np.repeat(1 / lens, lens)
        uses, back = np.unique(np.concatenate(bags), return_inverse=True)
        n = sizes[uses]
        ends = np.cumsum(n)
        grams = flat[np.arange(ends[-1]) + np.repeat(starts[uses] - ends + n, n)]
        means = np.add.reduceat(self.vectors[grams], ends - n, axis=0) / n[:, None]
        x = np.add.reduceat(means[back] * share[:, None], np.cumsum(lens) - lens, axis=0)
        x = np.hstack([x[: len(y)], x[len(y) :]])
        z = x @ self.softmax.T + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[y][:, None] / len(y)
        dx = np.repeat(np.vstack(np.hsplit(p @ self.softmax, 2)), lens, axis=0) * share[:, None]
        for value, slope, total in zip((self.softmax, self.bias), (p.T @ x, p.sum(0)), tops):
            total += slope * slope
            value -= rate * slope / np.sqrt(total)
        dword = np.stack([np.bincount(back, dx[:, d], len(uses)) for d in range(DIMS)], 1) / n[:, None]
        spread = np.repeat(dword, n, axis=0)
        step = np.stack([np.bincount(grams, spread[:, d], 1 << BITS) for d in range(DIMS)], 1)
        slopes += (step * step).sum(1)
        self.vectors -= (rate * step / np.sqrt(slopes)[:, None]).astype(np.float32)

    def word_scores(self, word: str) -> tuple[float, float]:
        """What a word adds to the whole text's and to a stretch's part of the score, before averaging."""
        return tuple(self.scores[grams_of(word)].mean(0).tolist())

    def score(self, text: str, known) -> float:
        """Chance of the toxic class of a whole text; of a text without words, by the bias. ``known``: word_scores, remembered."""
        words = words_of(text)
        x = self.lean
        if words:
            each = np.array(list(map(known, words)))
            x += float(each[:, 0].mean() + stretch_means(each[:, 1]).max())
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def held_out_fifth(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0 modulo 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS, passes: int = PASSES) -> SubwordBags:
    """Learn from a bounded sample (about ``per_class`` labelled rows and ``most_chars`` characters a class) of the rows that are not held out.

    Labels are drawn before the documents are read; a repeated id counts once a label, with its smallest text.
    """
    told = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out_fifth(id_col)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("l"))
    counts = {r[0]: r[1] for r in told.groupBy("l").count().collect()}
    if not counts:
        return SubwordBags([], [])
    take = F.lit(False)
    for value, n in counts.items():
        take = take | ((F.col("l") == value) & (draw("i") < F.lit(min(1.0, 1.2 * per_class / n))))
    some = materialize(told.where(take).distinct(), "labels")
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).join(broadcast_if_small(some), "i")
    got = class_sample(rows.select("t", "l", draw("i").alias("draw")), per_class, most_chars)
    discard(some)
    return SubwordBags([t for t, _ in got], [y for _, y in got], passes)


def score_toxicity(docs: DataFrame, model: SubwordBags, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0) of every whole text.

    Null texts count as empty; a text without words is scored by the bias. Without labelled rows the score
    is 0.5, with one class only it leans to that class. A null id is not held out. Repeated rows are scored
    each; ties can't arise, as each row is scored by itself. An empty table gives an empty result; other
    columns are ignored and their names don't matter.
    """
    spark = docs.sparkSession
    ship_code(spark)
    sent, run_id = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = claim(("toxicity", run_id), lambda: Memo(sent.value.word_scores, WORD_BOUND)).__getitem__
        for batch in batches:
            scores = [sent.value.score(t.as_py() or "", known) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= ACCEPT) for s in scores], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    wide = docs.select(F.col(id_col), held_out_fifth(id_col).alias("held_out_"), F.col(text_col).alias("text_"))
    return wide.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
