"""Language identification by a string kernel with Nystrom landmarks (op3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, held_out, ship_code
from .grams import class_sample, distinct, draw, gram_codes

#: Training rows of each language, about; the bound of the sample.
SAMPLE_PER_LANG = 400
#: Characters of those rows at most.
SAMPLE_CHARS = 8_000_000
#: Landmarks; every language has one at least.
LANDMARKS = 128
RIDGE = 1e-3
#: Documents of one block of the matrix product.
BLOCK = 64

_letter = regex.compile(r"\p{L}").search


class KernelModel:
    """One-versus-rest kernel ridge regression on the presence kernel of 1- to 3-grams.

    k(x, y) = shared distinct n-grams / sqrt(distinct of x * distinct of y). Nystrom: the kernel is
    represented by its values at the landmarks, so a text costs one row of a matrix product.
    """

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        sets = [distinct(gram_codes(t.lower())) for t in texts]
        by = {g: [i for i, x in enumerate(langs) if x == g] for g in self.langs}
        turn = sorted((n, g, i) for g, rows in by.items() for n, i in enumerate(rows))
        chosen = [i for _, _, i in turn if len(sets[i])][: max(landmarks, len(self.langs))]
        self.grams = distinct(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
        self.marks = np.zeros((len(self.grams), len(chosen)), np.float32)
        for k, i in enumerate(chosen):
            self.marks[np.searchsorted(self.grams, sets[i]), k] = 1 / np.sqrt(len(sets[i]))
        if not chosen:
            self.weights = np.zeros((0, len(self.langs)), np.float32)
            return
        known = [x for x in sets]
        k_nm = np.concatenate([self.kernel(known[a : a + BLOCK]) for a in range(0, len(known), BLOCK)]).astype(np.float64)
        k_mm = k_nm[chosen]
        values, axes = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = values > 1e-6 * values.max()
        half = axes[:, keep] / np.sqrt(values[keep])
        phi = k_nm @ half
        target = np.array([[1.0 if x == g else -1.0 for g in self.langs] for x in langs])
        w = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ target)
        self.weights = (half @ w).astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        present = np.zeros((len(sets), len(self.grams)), np.float32)
        if len(self.grams):
            for row, codes in zip(present, sets):
                at = np.searchsorted(self.grams, codes)
                at[at == len(self.grams)] = 0
                row[at[self.grams[at] == codes]] = 1 / np.sqrt(max(1, len(codes)))
        return present @ self.marks

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        at = [i for i, t in enumerate(texts) if t and _letter(t)]
        for a in range(0, len(at), BLOCK):
            block = at[a : a + BLOCK]
            out = self.kernel([distinct(gram_codes(texts[i].lower())) for i in block]) @ self.weights
            best = out.argmax(1)
            for i, b, s in zip(block, best.tolist(), out.max(1).tolist()):
                langs[i], scores[i] = self.langs[b], min(1.0, max(0.0, (s + 1) / 2))
        return langs, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, most_chars: int = SAMPLE_CHARS) -> KernelModel:
    """Learn from a bounded sample (about ``per_lang`` rows and ``most_chars`` characters a language) of the rows that are not held out."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = known.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), draw(id_col, text_col).alias("draw"))
    got = class_sample(rows, per_lang, most_chars)
    return KernelModel([t for t, _ in got], [g for _, g in got])


def predict_language(docs: DataFrame, model: KernelModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred and score (0 to 1) of every whole text.

    lang_pred is und with score 0 if the text is null or has no letter, or if nothing could be
    learned. A null id is not held out. Repeated rows are predicted each; an empty table gives an
    empty result; only the text enters a prediction.
    """
    spark = docs.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(model or train(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
