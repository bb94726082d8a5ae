"""Character n-grams of whole texts as integers, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def gram_codes(text: str, longest: int = 3) -> np.ndarray:
    """Codes of all n-grams, n = 1..``longest`` (3 at most), repeats included; 21 bits a character, no collisions."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    parts = [c]
    for n in range(2, longest + 1):
        parts.append(parts[-1][: len(c) - n + 1] | c[n - 1 :] << 21 * (n - 1))
        if not len(parts[-1]):
            break
    return np.concatenate(parts)


def distinct(codes: np.ndarray) -> np.ndarray:
    if not len(codes):
        return codes
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def class_sample(rows: DataFrame, per_class: int, most_chars: int) -> list[tuple[str, object]]:
    """(text, label) of about ``per_class`` rows (t, l, draw) of each label, of ``most_chars`` characters at most.

    ``draw``: a uniform hash of a row's identity; those with the lowest ones are taken, by a share from
    the counts, and rows of one draw (repeats) count once. The rows drawn are written in the shared folder
    first; the driver gets the labels (a bounded set), the drawn rows' lengths, and then the texts that the
    bound lets through.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}
    take = F.lit(False)
    for value, n in counts.items():
        take = take | ((F.col("l") == F.lit(value)) & (F.col("draw") < F.lit(min(1.0, per_class / n))))
    some = materialize(rows.where(take).groupBy("l", "draw").agg(F.min("t").alias("t")), "sample")
    cut: dict = {}
    for r in some.select("l", "draw", F.length("t").alias("n")).orderBy("l", "draw").collect():
        used, _ = cut.get(r[0], (0, -1.0))
        if used + r[2] <= most_chars:
            cut[r[0]] = used + r[2], r[1]
        else:
            cut[r[0]] = most_chars + 1, cut.get(r[0], (0, -1.0))[1]
    fits = F.lit(False)
    for value, (_, last) in cut.items():
        fits = fits | ((F.col("l") == F.lit(value)) & (F.col("draw") <= F.lit(last)))
    out = sorted(((r.t, r.l) for r in some.where(fits).select("t", "l").collect()))
    discard(some)
    return out


def draw(*by: str) -> Column:
    """A uniform number from 0 to 1 by the hash of some columns."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) / F.lit(float(1 << 30))
