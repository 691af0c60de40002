"""Pixel operators over arrays: a grey image is a row (height, width, pixels), pixels row by row.

They are Arrow-batched and touch one image at a time; nothing is exploded by pixel. Decoding of image files
is left to whatever library a deployment has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _image(h: int, w: int, pixels) -> np.ndarray:
    return np.asarray(pixels, np.float64).reshape(h, w)


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the inner four-neighbour Laplacian; 0 below 3 pixels either way."""
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def grey(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Luma of blue, green and red planes, rounded half up."""
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)


def rotate(g: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.rot90(g, -(degrees // 90) % 4)


def otsu(g: np.ndarray) -> float:
    """The level that parts the histogram with the greatest variance between both sides."""
    counts = np.bincount(np.clip(g, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * total) ** 2 / (below * (total - below))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def local_mean(g: np.ndarray, block: int) -> np.ndarray:
    pad = block // 2
    p = np.pad(g, pad, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = g.shape
    return (s[block : block + h, block : block + w] - s[:h, block : block + w] - s[block : block + h, :w] + s[:h, :w]) / block**2


def ink(g: np.ndarray, block: int = 31, below: float = 15) -> np.ndarray:
    """Pixels darker than the mean around them by more than ``below``."""
    return g < local_mean(g, block) - below


def binarize(g: np.ndarray, method: str) -> np.ndarray:
    if method == "otsu":
        return np.where(g > otsu(g), 255.0, 0.0)
    if method == "adaptive":
        return np.where(ink(g), 0.0, 255.0)
    return g


def extent(g: np.ndarray) -> np.ndarray:
    """For each column the distance of its first and last bright pixel; 0 for none."""
    bright = g > otsu(g)
    last = g.shape[0] - 1 - bright[::-1].argmax(0)
    return np.where(bright.any(0), last - bright.argmax(0), 0).astype(float)


def crop(g: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part inside the image; a black pixel if there is none."""
    part = g[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    return part if part.size else np.zeros((1, 1))


def upscale(g: np.ndarray, factor: int) -> np.ndarray:
    return np.repeat(np.repeat(g, factor, axis=0), factor, axis=1)


def shift_columns(g: np.ndarray, field: np.ndarray, most: float) -> np.ndarray:
    """Each pixel from ``field`` pixels further down, ``most`` at most, between its neighbours."""
    y = np.clip(np.arange(g.shape[0])[:, None] + np.clip(field, -most, most), 0, g.shape[0] - 1)
    low = np.floor(y).astype(int)
    high, part = np.minimum(low + 1, g.shape[0] - 1), y - low
    x = np.arange(g.shape[1])[None, :]
    return g[low, x] * (1 - part) + g[high, x] * part


def background(h: np.ndarray, s: np.ndarray, v: np.ndarray, colour, hue=10, sat=40, val=40) -> np.ndarray:
    """Pixels near a colour in HSV; hue goes round."""
    dh = np.abs(h - colour[0])
    return (np.minimum(dh, 180 - dh) <= hue) & (np.abs(s - colour[1]) <= sat) & (np.abs(v - colour[2]) <= val)


def peaks(profile: np.ndarray, distance: int, prominence: float) -> list[int]:
    """Local maxima that rise ``prominence`` above the higher of their two saddles, the highest first where nearer than ``distance``."""
    inner = np.nonzero((profile[1:-1] > profile[:-2]) & (profile[1:-1] >= profile[2:]))[0] + 1
    kept: list[int] = []
    for i in sorted(inner.tolist(), key=lambda i: (-profile[i], i)):
        if any(abs(i - k) < distance for k in kept):
            continue
        higher = np.nonzero(profile > profile[i])[0]
        left, right = higher[higher < i], higher[higher > i]
        saddle = max(profile[(left[-1] if left.size else 0) : i + 1].min(), profile[i : (right[0] if right.size else len(profile)) + 1].min())
        if profile[i] - saddle >= prominence:
            kept.append(i)
    return sorted(kept)


def baselines(g: np.ndarray, strips: int = 36, smooth: int = 5, distance: float = 0.012, tolerance: float = 0.010, span: float = 0.40) -> list[list[tuple[float, float]]]:
    """Text lines of a page as points: ink summed by row in vertical strips, its peaks linked from strip to strip.

    Lines that cross fewer than ``span`` of the strips are left out."""
    h, w = g.shape
    dark, edges = ink(g).astype(float), np.linspace(0, w, strips + 1).astype(int)
    kernel = np.ones(smooth) / smooth
    found = []
    for a, b in zip(edges, edges[1:]):
        row = np.convolve(dark[:, a:b].sum(1), kernel, mode="same")
        found.append([float(p) for p in peaks(row, max(1, int(distance * h)), 0.1 * max(row.max(), 1e-9))])
    middle = (edges[:-1] + edges[1:]) / 2
    return [[(float(middle[k]), y) for k, y in t] for t in link_peaks(found, max(1.0, tolerance * h)) if len(t) >= span * strips]


def link_peaks(strips: list[list[float]], tolerance: float, idle_most: int = 3) -> list[list[tuple[int, float]]]:
    """Tracks of (strip, peak): a peak joins the nearest open track within the tolerance, the first of equal ones, else opens one.

    A track that a strip opened can take a later peak of that strip; one idle for more than ``idle_most`` strips closes."""
    tracks: list[list[tuple[int, float]]] = []
    idle: list[int] = []
    for k, peaks in enumerate(strips):
        idle = [n + 1 for n in idle]
        used: set[int] = set()
        for peak in sorted(peaks):
            near = [(abs(t[-1][1] - peak), i) for i, t in enumerate(tracks) if i not in used and idle[i] <= idle_most + 1]
            near = [x for x in near if x[0] < tolerance]
            if near:
                i = min(near)[1]
                tracks[i].append((k, peak))
                idle[i] = 0
                used.add(i)
            else:
                tracks.append([(k, peak)])
                idle.append(0)
    return tracks


def facts(images: DataFrame, key: str) -> DataFrame:
    """(key, sharpness, ink, extent, light): sharpness, and per column the ink count, the extent and the mean light."""

    def run(batches):
        for b in batches:
            rows = []
            for h, w, p in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                g = _image(h, w, p)
                rows.append((laplacian_variance(g), ink(g).sum(0).astype(float).tolist(), extent(g).tolist(), g.mean(0).tolist()))
            kinds = (pa.float64(), *[pa.list_(pa.float64())] * 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [key, "sharpness", "ink", "extent", "light"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "pixels").mapInArrow(run, f"{key} {kind}, sharpness double, ink array<double>, extent array<double>, light array<double>")


def transformed(images: DataFrame, key: str, change, *extra: str) -> DataFrame:
    """(key, height, width, pixels) of each image after ``change(image, *extra columns)``."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                g = change(_image(r["height"], r["width"], r["pixels"]), *(r[c] for c in extra))
                rows.append((*g.shape, g.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64()))))], [key, "height", "width", "pixels"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "pixels", *extra).mapInArrow(run, f"{key} {kind}, height int, width int, pixels array<double>")


def margin_colour(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, hue, sat, val): the median colour of margin pixels, of the bright ones if there are any."""
    def mid(c, only):
        return F.median(F.when(only, F.col(c)))

    bright = F.col("val") >= 120
    return pixels.filter("margin").groupBy(*by).agg(*[F.coalesce(mid(c, bright), F.median(c)).alias(c) for c in ("hue", "sat", "val")])
