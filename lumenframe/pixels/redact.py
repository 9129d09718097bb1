"""Burned-in text: region filling and text-region detection on pictures, in NumPy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

Box = tuple[int, int, int, int]  # x0, y0, x1, y1


def boxes(regions: list[dict], columns: int, rows: int, mode: str = "pixel", scale_x: float = 1.0, scale_y: float = 1.0) -> list[Box]:
    """Whole-pixel boxes inside the frame of {x, y, width, height}; mode: pixel, normalized or auto-fit (shrunk to fit if any region is outside)."""
    if mode not in ("pixel", "normalized", "auto-fit"):
        raise ValueError(f"unknown coordinate mode {mode!r}")
    found = [(float(r["x"]), float(r["y"]), float(r["width"]), float(r["height"])) for r in regions]
    if mode == "normalized":
        scale_x, scale_y = scale_x * columns, scale_y * rows
    elif mode == "auto-fit" and found:
        right, bottom = max(x + w for x, _, w, _ in found), max(y + h for _, y, _, h in found)
        scale_x *= columns / right if right > columns else 1
        scale_y *= rows / bottom if bottom > rows else 1
    out = []
    for x, y, w, h in found:
        x0, y0 = max(0, math.floor(x * scale_x)), max(0, math.floor(y * scale_y))
        x1, y1 = min(columns, math.ceil((x + w) * scale_x)), min(rows, math.ceil((y + h) * scale_y))
        if x0 < x1 and y0 < y1:
            out.append((x0, y0, x1, y1))
    return out


def fill(picture: np.ndarray, found: list[Box], value: int | tuple[int, ...]) -> np.ndarray:
    """A copy with the boxes filled; native samples keep their depth."""
    out = picture.copy()
    for x0, y0, x1, y1 in found:
        out[y0:y1, x0:x1, : 3 if out.ndim == 3 and out.shape[2] == 4 else None] = value
    return out


class RegionError(ValueError):
    """More text than is looked at."""


@dataclass(frozen=True)
class TextOptions:
    bright_share: float = 0.975
    least_bright: int = 148
    delta_share: float = 0.35
    delta_margin: int = 8
    delta_range: tuple[int, int] = (12, 96)
    zone: float = 0.24
    zone_right: float = 0.28
    gap_x: int = 10
    gap_y: int = 4
    pad_x: int = 3
    pad_y: int = 2
    least_area: int = 8
    sparse: float = 0.24
    least_score: float = 0.2
    most_regions: int = 128
    most_components: int = 32768


def luma(picture: np.ndarray) -> np.ndarray:
    p = picture.astype(np.int64)
    return (77 * p[:, :, 0] + 150 * p[:, :, 1] + 29 * p[:, :, 2]) >> 8


def percentile(values: np.ndarray, share: float) -> int:
    """The least value whose running count passes floor(share * (n - 1))."""
    if not len(values):
        return 0
    return int(np.searchsorted(np.cumsum(np.bincount(values, minlength=256)), math.floor(share * (len(values) - 1)), "right"))


def components(mask: np.ndarray, most: int) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) of 8-connected components, by runs of each row joined with the row above."""
    runs, up = [], []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    before: list[int] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].view(np.int8), [0]])))
        own = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(runs)
            runs.append((a, b, y))
            up.append(i)
            own.append(i)
            for j in before:
                if runs[j][0] <= b and a <= runs[j][1]:
                    up[max(top(i), top(j))] = min(top(i), top(j))
        before = own
    out: dict[int, list[int]] = {}
    for i, (a, b, y) in enumerate(runs):
        c = out.setdefault(top(i), [a, y, b, y + 1, 0])
        c[0], c[2], c[3], c[4] = min(c[0], a), max(c[2], b), max(c[3], y + 1), c[4] + b - a
    if len(out) > most:
        raise RegionError(f"{len(out)} bright components, {most} at most are looked at")
    return [tuple(c) for c in out.values()]


def text_regions(picture: np.ndarray, o: TextOptions = TextOptions()) -> list[Box]:  # noqa: B008
    """Boxes of bright text near the borders of an RGBA picture. RegionError if there are more than the limits: the picture is then held back, as text would stay in it."""
    rows, columns = picture.shape[:2]
    if not rows or not columns:
        return []
    light = luma(picture)
    high = max(o.least_bright, percentile(light.ravel(), o.bright_share))
    ys, xs = np.mgrid[0:rows, 0:columns]
    zone = (ys < rows * o.zone) | (ys >= rows * (1 - o.zone)) | (xs < columns * o.zone) | (xs >= columns * (1 - o.zone_right))
    spread = picture[:, :, :3].max(2).astype(np.int64) - picture[:, :, :3].min(2)
    bright = (picture[:, :, 3] >= 8) & (light >= high)
    sample = spread[bright & zone]
    lo, hi = o.delta_range
    delta = hi if len(sample) < 32 else min(hi, max(lo, percentile(sample, o.delta_share) + o.delta_margin))
    parts = []
    for x0, y0, x1, y1, n in components(bright & (spread <= delta), o.most_components):
        w, h = x1 - x0, y1 - y0
        near = y0 < rows * o.zone or y1 > rows * (1 - o.zone) or x0 < columns * o.zone or x1 > columns * (1 - o.zone_right)
        if near and n >= 2 and w <= columns * 0.5 and h <= rows * 0.25 and max(w / h, h / w) <= 20:
            parts.append((x0, y0, x1, y1, n))
    groups = [[*p[:4], [p]] for p in parts]
    moved = True
    while moved:
        moved = False
        groups.sort(key=lambda g: (g[1], g[0]))
        merged: list[list] = []
        for g in groups:
            for m in merged:
                if g[0] <= m[2] + o.gap_x and m[0] <= g[2] + o.gap_x and g[1] <= m[3] + o.gap_y and m[1] <= g[3] + o.gap_y:
                    m[:4] = min(m[0], g[0]), min(m[1], g[1]), max(m[2], g[2]), max(m[3], g[3])
                    m[4] += g[4]
                    moved = True
                    break
            else:
                merged.append(g)
        groups = merged
    out = []
    for x0, y0, x1, y1, own in groups:
        area, lit = (x1 - x0) * (y1 - y0), sum(p[4] for p in own)
        share = lit / area
        score = 0.40 * min(1, share / 0.5) + 0.35 * min(1, len(own) / 6) + 0.15 * min(1, sum(p[4] / ((p[2] - p[0]) * (p[3] - p[1])) for p in own) / len(own)) + 0.10 * min(1, area / 200)
        if area > 0.05 * rows * columns and len(own) < 4:
            score *= 0.4
        if score < o.least_score:
            continue
        for a, b, c, d in [(x0, y0, x1, y1)] if share >= o.sparse or len(own) < 2 else [p[:4] for p in own]:
            box = (max(0, a - o.pad_x), max(0, b - o.pad_y), min(columns, c + o.pad_x), min(rows, d + o.pad_y))
            if (box[2] - box[0]) * (box[3] - box[1]) >= o.least_area:
                out.append(box)
    if len(out) > o.most_regions:
        raise RegionError(f"{len(out)} text regions, {o.most_regions} at most are filled")
    return sorted(out, key=lambda b: (b[1], b[0]))


def top_colours(picture: np.ndarray, box: Box | None = None, k: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """The k most common colours of a picture's box with their counts; of equally common ones the darker first."""
    x0, y0, x1, y1 = box or (0, 0, picture.shape[1], picture.shape[0])
    found, n = np.unique(picture[y0:y1, x0:x1].reshape(-1, picture.shape[2]), axis=0, return_counts=True)
    return [(tuple(found[i].tolist()), int(n[i])) for i in np.lexsort((np.arange(len(n)), -n))[:k]]
