"""Pixel measures and preparation of page images: NumPy on Arrow batches, one image a row.

Images are grey: id, width, height and pixels (binary, row by row). Decoding is the reader's part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import content_type, legibility, orientation, sharpness
from ..functions.measures import brightness_score, deskew_angle, estimated_dpi, page_score, resolution_score


def grey(row_pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(row_pixels, np.uint8, width * height).reshape(height, width)


def padded(a: np.ndarray) -> np.ndarray:
    return np.pad(a.astype(np.float64), 1, mode="reflect" if min(a.shape) > 1 else "edge")


def shifts(a: np.ndarray) -> np.ndarray:
    """The nine neighbours of every pixel, itself in the middle."""
    p, (h, w) = padded(a), a.shape
    return np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def laplacian_variance(a: np.ndarray) -> float:
    n = shifts(a)
    return float((n[1] + n[3] + n[5] + n[7] - 4 * n[4]).var())


#: Exchanges after which the fifth of nine values is their median.
_MEDIAN9 = [(1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2)]


def median3(a: np.ndarray) -> np.ndarray:
    """Median of each pixel's nine neighbours, by exchanges of whole images in the pixels' own type."""
    p, (h, w) = np.pad(a, 1, mode="reflect" if min(a.shape) > 1 else "edge"), a.shape
    v = [p[i : i + h, j : j + w] for i in range(3) for j in range(3)]
    for i, j in _MEDIAN9:
        v[i], v[j] = np.minimum(v[i], v[j]), np.maximum(v[i], v[j])
    return v[4].astype(np.float64)


def noise_level(a: np.ndarray) -> float:
    return float(np.abs(a - median3(a)).mean() / 255.0)


def edges(a: np.ndarray, least: float = 100.0) -> np.ndarray:
    n = shifts(a)
    gx = n[2] + 2 * n[5] + n[8] - n[0] - 2 * n[3] - n[6]
    gy = n[6] + 2 * n[7] + n[8] - n[0] - 2 * n[1] - n[2]
    return np.hypot(gx, gy) > least


def otsu(a: np.ndarray) -> int:
    """The threshold that parts the histogram best."""
    hist = np.bincount(a.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(hist), hist.sum()
    mass = np.cumsum(hist * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 127


def runs(ink: np.ndarray) -> np.ndarray:
    """Lengths of the horizontal runs of ink."""
    p = np.pad(ink.astype(np.int8), ((0, 0), (1, 1)))
    d = np.diff(p, axis=1)
    return np.nonzero(d == -1)[1] - np.nonzero(d == 1)[1]


def stroke_variance(a: np.ndarray) -> float:
    """Spread of the stroke widths over their mean, 1 at most; 0 without ink."""
    r = runs(a <= otsu(a))
    return float(min(1.0, r.std() / r.mean())) if len(r) else 0.0


def grid(a: np.ndarray, share: float = 0.6) -> bool:
    """Two or more ruled lines each way."""
    ink = a <= otsu(a)
    return bool((ink.mean(1) > share).sum() >= 2 and (ink.mean(0) > share).sum() >= 2)


def peaks(a: np.ndarray, least: float = 0.01) -> int:
    """Peaks of the smoothed histogram that hold a share of the pixels."""
    hist = np.bincount(a.ravel(), minlength=256) / a.size
    s = np.convolve(hist, np.ones(9) / 9, "same")
    return int(((s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:]) & (s[1:-1] * 9 > least)).sum())


def equalized(a: np.ndarray) -> np.ndarray:
    cdf = np.cumsum(np.bincount(a.ravel(), minlength=256)).astype(np.float64)
    low = cdf[cdf > 0][0]
    return np.round((cdf - low) / max(1.0, cdf[-1] - low) * 255).clip(0, 255).astype(np.uint8)[a]


def cropped(a: np.ndarray) -> np.ndarray:
    """Without margins that hold no ink."""
    ink = a <= otsu(a)
    rows, cols = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    return a[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else a


def prepared(a: np.ndarray) -> np.ndarray:
    """Margins cut, contrast spread, specks removed, black and white; small pages doubled first."""
    a = cropped(a)
    if max(a.shape) < 1000:
        a = a.repeat(2, 0).repeat(2, 1)
    a = np.round(median3(equalized(a))).astype(np.uint8)
    return np.where(a > otsu(a), 255, 0).astype(np.uint8)


def skew(a: np.ndarray, most: float = 30.0, step: float = 0.5, fine: float = 0.1) -> float:
    """The angle in degrees, up to ``most`` each way, at which rows of ink line up best, by shearing.

    Steps of ``step`` on a page reduced to COARSE cells a side, as a step moves the far end of a long row
    by many pixels; then steps of ``fine`` around the best one on the whole page.
    """
    ink = a <= otsu(a)
    y, x = np.nonzero(ink)
    if not len(y):
        return 0.0

    def best(y: np.ndarray, x: np.ndarray, n: np.ndarray | None, angles: np.ndarray) -> float:
        score = [np.square(np.bincount(np.round(y - x * np.tan(np.radians(g))).astype(int) + a.shape[1] + a.shape[0], n)).sum() for g in angles]
        top = np.flatnonzero(np.array(score) == max(score))
        return float(angles[top[np.abs(angles[top]).argmin()]])

    cell = -(-max(a.shape) // COARSE)
    at, n = np.unique(y // cell * COARSE + x // cell, return_counts=True)
    rough = best(at // COARSE, at % COARSE, n, np.arange(-most, most + step / 2, step))
    near = np.round(np.arange(rough - step, rough + step + fine / 2, fine), 6)
    return best(y, x, None, near[np.abs(near) <= most]) + 0.0


#: Cells a side of the reduced page on which the skew is looked for first.
COARSE = 256


def blocks(a: np.ndarray, gap: int = 3) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of text: bands of inked rows, cut where ``gap`` columns or more hold no ink; at least 0.1 % of the page."""
    ink = a <= otsu(a)

    def spans(line: np.ndarray) -> list[tuple[int, int]]:
        on = np.flatnonzero(line)
        if not len(on):
            return []
        cut = np.flatnonzero(np.diff(on) > gap)
        return list(zip(on[np.r_[0, cut + 1]].tolist(), (on[np.r_[cut, len(on) - 1]] + 1).tolist()))

    found = [(x0, y0, x1 - x0, y1 - y0) for y0, y1 in spans(ink.any(1)) for x0, x1 in spans(ink[y0:y1].any(0))]
    return [b for b in found if b[2] * b[3] >= 0.001 * a.size]


MEASURES: dict[str, Callable[[np.ndarray], float]] = {
    "laplacian": laplacian_variance,
    "noise": noise_level,
    "contrast_std": lambda a: float(a.std()),
    "brightness": lambda a: float(a.mean() / 255.0),
    "edge_density": lambda a: float(edges(a).mean()),
    "stroke_variance": stroke_variance,
    "has_grid": lambda a: float(grid(a)),
    "skew": skew,
    "histogram_peaks": lambda a: float(peaks(a)),
}


def measured(images: DataFrame) -> DataFrame:
    """(id, width, height, one column for each measure); an image whose size does not fit its pixels gets nulls."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {n: [] for n in MEASURES}
            for w, h, p in zip(b["width"], b["height"], b["pixels"]):
                sound = p is not None and w > 0 and h > 0 and len(p) == w * h
                a = grey(bytes(p), w, h) if sound else None
                for n, f in MEASURES.items():
                    out[n].append(f(a) if sound else None)
            yield pd.DataFrame({"id": b["id"], "width": b["width"], "height": b["height"], **out})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, width int, height int, " + ", ".join(f"{n} double" for n in MEASURES))


def page_quality(images: DataFrame) -> DataFrame:
    """Scores, legibility, warnings and gate of page images, from the measures by column expressions."""
    m = measured(images)
    blur, noise, contrast = (F.least(F.lit(1.0), x) for x in (F.col("laplacian") / 1000.0, F.col("noise") * 10.0, F.col("contrast_std") / 80.0))
    bright, dpi = brightness_score(F.col("brightness")), estimated_dpi(F.col("width"), F.col("height"))
    overall = page_score(blur, noise, contrast, resolution_score(F.col("width"), F.col("height")), bright)
    warnings = F.array_compact(
        F.array(F.when(blur < 0.2, "blurred"), F.when(noise > 0.7, "noisy"), F.when(contrast < 0.2, "low contrast"), F.when(dpi < 150, "low resolution"), F.when((bright < 0.15) | (bright > 0.85), "brightness"))
    )
    return m.select(
        "id", overall.alias("overall"), legibility(overall).alias("legibility"), warnings.alias("warnings"), (overall >= 0.3).alias("passes_gate"), dpi.alias("dpi"), orientation(F.col("width"), F.col("height")).alias("orientation"),
        sharpness(F.col("laplacian")).alias("sharpness"), content_type(F.col("stroke_variance"), F.col("edge_density")).alias("content"), (F.col("has_grid") > 0).alias("has_table"), deskew_angle(F.col("skew")).alias("turn_by"),
    )


#: Bytes of made images that are held before they go back, about.
OUT_BYTES = 8 << 20


def mapped(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Images through a function of arrays, as prepare() does."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["id", "width", "height", "pixels"])

        for b in batches:
            rows, held = [], 0
            for i, w, h, p in zip(b["id"], b["width"], b["height"], b["pixels"]):
                a = f(grey(bytes(p), w, h))
                rows.append((i, a.shape[1], a.shape[0], a.tobytes()))
                held += a.nbytes
                if held >= OUT_BYTES:  # what f makes may be many times larger than what came
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, width int, height int, pixels binary")


def prepare(images: DataFrame) -> DataFrame:
    return mapped(images, prepared)


def text_blocks(images: DataFrame) -> DataFrame:
    """(id, seq, x, y, w, h) of the text blocks of each page."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *box) for i, w, h, p in zip(b["id"], b["width"], b["height"], b["pixels"]) for k, box in enumerate(blocks(grey(bytes(p), w, h)))]
            yield pd.DataFrame(rows, columns=["id", "seq", "x", "y", "w", "h"])

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, seq int, x int, y int, w int, h int")


def frame_differences(frames: DataFrame, camera: str, order: str) -> DataFrame:
    """(camera, order, diff): sum of absolute differences to the frame before; a camera's frames stream through one task in order."""
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, before = None, None
        for b in batches:
            out = []
            for c, o, p in zip(b[camera], b[order], b["pixels"]):
                a = np.frombuffer(bytes(p), np.uint8).astype(np.int64)
                same = c == who and before is not None and len(a) == len(before)
                out.append(float(np.abs(a - before).sum()) if same else None)
                who, before = c, a
            yield pd.DataFrame({camera: b[camera], order: b[order], "diff": out})

    ordered = frames.select(camera, order, "pixels").repartition(camera).sortWithinPartitions(camera, order)
    return ordered.mapInPandas(run, f"`{camera}` {kinds[camera]}, `{order}` {kinds[order]}, diff double")


def detected(images: DataFrame, model: Callable[[np.ndarray], list[tuple[str, float]]] | None = None) -> DataFrame:
    """(id, label, score) from a detector given as a function; no rows without one."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s) for i, w, h, p in zip(b["id"], b["width"], b["height"], b["pixels"]) for n, s in (model(grey(bytes(p), w, h)) if model else [])]
            yield pd.DataFrame(rows, columns=["id", "label", "score"])

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, label string, score double")
