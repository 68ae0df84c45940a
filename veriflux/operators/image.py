"""Image and score-map kernels on arrays, and the operators that apply them row by row in batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship_package


def upsample(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres mapped on pixel centres, edges held."""
    def axis(n_in: int, n_out: int):
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n_in - 1), at - lo

    y0, y1, fy = axis(x.shape[0], h)
    x0, x1, fx = axis(x.shape[1], w)
    fy = fy.reshape(-1, 1, *[1] * (x.ndim - 2))
    fx = fx.reshape(1, -1, *[1] * (x.ndim - 2))
    top = x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx
    low = x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def gaussian_blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, radius ceil(3 sigma), edges held; sigma 0 changes nothing."""
    if sigma <= 0:
        return x.copy()
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = x.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        held = np.pad(out, pad, mode="edge")
        out = sum(k[i] * np.take(held, np.arange(i, i + x.shape[axis]), axis=axis) for i in range(2 * r + 1))
    return out


def regions(mask: np.ndarray, scores: np.ndarray) -> list[dict]:
    """4-connected components of a mask: box (x, y, w, h), max, mean, area; largest maximum first."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        low = np.where(label > 0, label, mask.size + 1)
        best = low.copy()
        best[1:] = np.minimum(best[1:], low[:-1])
        best[:-1] = np.minimum(best[:-1], low[1:])
        best[:, 1:] = np.minimum(best[:, 1:], low[:, :-1])
        best[:, :-1] = np.minimum(best[:, :-1], low[:, 1:])
        best = np.where(mask, best, 0)
        if (best == label).all():
            break
        label = best
    out = []
    for v in np.unique(label[label > 0]):
        y, x = np.nonzero(label == v)
        s = scores[y, x]
        out.append({"x": int(x.min()), "y": int(y.min()), "w": int(np.ptp(x)) + 1, "h": int(np.ptp(y)) + 1, "max_score": float(s.max()), "mean_score": float(s.mean()), "area": len(s)})
    return sorted(out, key=lambda r: (-r["max_score"], r["y"], r["x"]))


def detection(scores: np.ndarray, h: int, w: int, sigma: float, threshold: float) -> dict:
    """Image score (before any blur) and the regions of the upsampled, blurred map over ``threshold``."""
    full = gaussian_blur(upsample(scores, h, w), sigma)
    return {"image_score": float(scores.max()), "regions": regions(full > threshold, full)}


def debayer_rggb(x: np.ndarray) -> np.ndarray:
    """Nearest neighbour in each 2 x 2 quad."""
    h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
    quad = x[:h, :w]
    rgb = np.stack([quad[0::2, 0::2], quad[0::2, 1::2], quad[1::2, 1::2]], axis=-1)
    return rgb.repeat(2, axis=0).repeat(2, axis=1)


def flat_field(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    if x.shape != reference.shape:
        raise ValueError("the reference has another shape")
    ref = reference.astype(float)
    return np.where(ref == 0, x, np.clip(x * ref.mean() / np.where(ref == 0, 1, ref), 0, 255)).astype(x.dtype)


def white_balance(x: np.ndarray, gains: tuple[float, float, float]) -> np.ndarray:
    return np.clip(x * np.array(gains), 0, 255).astype(np.uint8)


def stretch(x: np.ndarray) -> np.ndarray:
    lo, hi = float(x.min()), float(x.max())
    return x.copy() if hi == lo else np.clip((x - lo) * 255.0 / (hi - lo), 0, 255).astype(np.uint8)


def undistort(x: np.ndarray, fx: float, fy: float, cx: float, cy: float, k: tuple[float, float, float, float, float]) -> np.ndarray:
    """Brown-Conrady (k1, k2, p1, p2, k3), bilinear; what lies outside is 0."""
    k1, k2, p1, p2, k3 = k
    v, u = np.mgrid[0 : x.shape[0], 0 : x.shape[1]]
    a, b = (u - cx) / fx, (v - cy) / fy
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    su = fx * (a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + cx
    sv = fy * (b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + cy
    inside = (su >= 0) & (sv >= 0) & (su <= x.shape[1] - 1) & (sv <= x.shape[0] - 1)
    u0, v0 = np.clip(np.floor(su), 0, x.shape[1] - 1).astype(int), np.clip(np.floor(sv), 0, x.shape[0] - 1).astype(int)
    u1, v1 = np.minimum(u0 + 1, x.shape[1] - 1), np.minimum(v0 + 1, x.shape[0] - 1)
    du, dv = su - u0, sv - v0
    if x.ndim == 3:
        du, dv, inside = du[..., None], dv[..., None], inside[..., None]
    out = (x[v0, u0] * (1 - du) + x[v0, u1] * du) * (1 - dv) + (x[v1, u0] * (1 - du) + x[v1, u1] * du) * dv
    return np.where(inside, out, 0)


def compose(steps: list[Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    def run(x: np.ndarray) -> np.ndarray:
        for s in steps:
            x = s(x)
        return x

    return run


def crop(x: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    a, b, w, h = box
    return x[max(b, 0) : b + h, max(a, 0) : a + w]


def bounding_box(boxes: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold between bins that separates classes best."""
    lo, hi = float(values.min()), float(values.max())
    if hi == lo:
        return lo
    n, edges = np.histogram(values, bins, (lo, hi))
    p, mid = n / n.sum(), (edges[:-1] + edges[1:]) / 2
    w = np.cumsum(p)
    m = np.cumsum(p * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return float(edges[int(np.nanargmax(np.where(np.isfinite(between), between, -1))) + 1])


def saliency(attention: np.ndarray) -> np.ndarray:
    """Mean over heads and registers of (heads, registers, patches)."""
    return attention.mean(axis=(0, 1))


def binarise(s: np.ndarray, method: str = "percentile", p: float = 0.15) -> np.ndarray:
    """1 where s reaches the value at index (n - 1)(1 - p) of the sorted ones, or Otsu's threshold."""
    t = np.sort(s.ravel())[int((s.size - 1) * (1 - p))] if method == "percentile" else otsu(s.ravel())
    return (s >= t).astype(np.uint8)


def aggregate_layers(layers: list[np.ndarray | None], method: str = "mean", groups: list[list[int]] | None = None) -> np.ndarray:
    """Mean, concatenation, or means in groups concatenated; a missing layer adds nothing but counts in its group's size."""
    if method == "concat":
        return np.concatenate([x for x in layers if x is not None], axis=-1)
    if method == "mean":
        return np.mean([x for x in layers if x is not None], axis=0)
    return np.concatenate([sum(layers[i] for i in g if layers[i] is not None) / len(g) for g in groups], axis=-1)


def detect(frames: DataFrame, grid: tuple[int, int], size: tuple[int, int], sigma: float, threshold: float, key: str = "frame_id", scores: str = "scores") -> DataFrame:
    """Detections of score grids (arrays, row by row): key, image_score, region, and the regions' fields; a frame without regions has one row."""
    ship_package(frames.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for k, s in zip(pdf[key], pdf[scores]):
                d = detection(np.asarray(s, float).reshape(grid), *size, sigma, threshold)
                empty = [dict.fromkeys(("x", "y", "w", "h", "area", "max_score", "mean_score"))]
                rows += [{key: k, "image_score": d["image_score"], "region": i if d["regions"] else None, **r} for i, r in enumerate(d["regions"] or empty)]
            yield pd.DataFrame(rows, columns=[key, "image_score", "region", "x", "y", "w", "h", "area", "max_score", "mean_score"])

    return frames.select(key, scores).mapInPandas(run, f"{key} long, image_score double, region int, x int, y int, w int, h int, area int, max_score double, mean_score double")


def specular_cues(rgb: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask (above ``tau``), strength and confidence of highlights in an image of 0 to 1.

    Brightness, lack of colour, curvature of the brightness (not at the border) and clipping are blended.
    """
    x = rgb.astype(float)
    light = np.clip(x, 1e-6, 1) ** 2.2 @ np.array([0.2126, 0.7152, 0.0722])
    top, low = x.max(axis=-1), x.min(axis=-1)
    colour = np.where(top < 1e-6, 0, (top - low) / np.maximum(top, 1e-6))
    bend = np.zeros(light.shape)
    if min(light.shape) > 2:
        mid = light[1:-1, 1:-1]
        lap = light[:-2, 1:-1] + light[2:, 1:-1] + light[1:-1, :-2] + light[1:-1, 2:] - 4 * mid
        bend[1:-1, 1:-1] = _sigmoid(4 * (np.abs(lap) - 0.1))
    strength = np.clip(0.5 * _sigmoid(15 * (light - 0.85)) + 0.3 * _sigmoid(10 * (0.25 - colour)) + 0.2 * bend + 0.3 * (top > 0.985), 0, 1)
    return (strength > tau).astype(np.uint8), strength, 1 - strength


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def suppress_highlights(scores: np.ndarray, confidence: np.ndarray, sigma: float) -> np.ndarray:
    """Scores lowered where confidence is low, unless the blurred surroundings are anomalous as well; sigma counts whole pixels."""
    near = gaussian_blur(scores * confidence, int(sigma))
    context = np.clip(near / (scores + 1e-6), 0, 1)
    return scores * (confidence + (1 - confidence) * context)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, of 8-bit images with one or three channels; fractions are cut off."""
    if x.ndim == 3 and x.shape[2] not in (1, 3):
        raise ValueError(f"{x.shape[2]} channels")
    return np.clip(upsample(x.astype(float), h, w), 0, 255).astype(np.uint8)


def grid_of(h: int, w: int, patch: int) -> tuple[int, int]:
    """Patches down and across; an image must be whole patches."""
    if patch < 1 or h % patch or w % patch or not h or not w:
        raise ValueError(f"{h} x {w} isn't whole patches of {patch}")
    return h // patch, w // patch


def patch_features(rgb: np.ndarray, patch: int = 14, dim: int = 128, normalise: bool = True) -> np.ndarray:
    """A row of ``dim`` values for each patch, left to right and down.

    Pixels, histograms and moments of colours, histograms of Sobel magnitude, of its direction and of how many
    neighbours are brighter, and means of 3 x 3 cells; then means of neighbouring values, or zeros appended.
    """
    gh, gw = grid_of(*rgb.shape[:2], patch)
    if patch < 3 or rgb.shape[2:] != (3,):
        raise ValueError("patches of three pixels at least, with three channels")
    parts = rgb.reshape(gh, patch, gw, patch, 3).swapaxes(1, 2).reshape(gh * gw, patch, patch, 3)
    raw = np.stack([_described(p) for p in parts])
    n = raw.shape[1]
    if n <= dim:
        out = np.pad(raw, ((0, 0), (0, dim - n)))
    else:
        cut = (np.arange(dim + 1) * n) // dim
        out = np.add.reduceat(raw, cut[:-1], axis=1) / np.diff(cut)
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(size > 1e-6, size, 1) if normalise else out


def _shares(bins: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    counts = np.bincount(np.minimum(bins.astype(int).ravel(), n - 1), weights, n).astype(float)
    return counts / (counts.sum() or 1)


def _described(p: np.ndarray) -> np.ndarray:
    flat = p.reshape(-1, 3).astype(float)
    off = flat - flat.mean(axis=0)
    var = (off**2).mean(axis=0)
    sd = np.sqrt(var)
    skew = np.where(sd > 1e-9, (off**3).mean(axis=0) / np.where(sd > 1e-9, sd, 1) ** 3, 0)
    kurt = np.where(var > 1e-9, (off**4).mean(axis=0) / np.where(var > 1e-9, var, 1) ** 2 - 3, 0)
    moments = np.stack([flat.mean(axis=0) / 255, sd / 255, np.clip(skew, -5, 5) / 5, np.clip(kurt, -5, 5) / 5], axis=1)

    grey = np.floor(p @ np.array([0.299, 0.587, 0.114]))
    around = {(i, j): grey[1 + i : grey.shape[0] - 1 + i, 1 + j : grey.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    dx = sum((2 - abs(i)) * (around[i, 1] - around[i, -1]) for i in (-1, 0, 1))
    dy = sum((2 - abs(j)) * (around[1, j] - around[-1, j]) for j in (-1, 0, 1))
    edge = np.zeros(grey.shape)  # no gradient at the border of a patch
    edge[1:-1, 1:-1] = np.hypot(dx, dy)
    span = np.ptp(edge)
    strength = _shares((edge - edge.min()) * 16 / (span or 1), 16)
    angle = np.arctan2(dy, dx)
    angle = np.where(angle < 0, angle + np.pi, angle)
    direction = _shares(angle / np.pi * 9, 9, np.hypot(dx, dy).ravel())
    brighter = _shares(sum(a > around[0, 0] for a in around.values()), 10)
    cell = p.shape[0] // 3
    cells = p[: 3 * cell, : 3 * cell].reshape(3, cell, 3, cell, 3).mean(axis=(1, 3)) / 255
    colours = [_shares(flat[:, c] // 16, 16) for c in range(3)]
    return np.concatenate([flat.ravel() / 255, *colours, moments.ravel(), strength, direction, brighter, cells.ravel()])


def embed_patches(images: DataFrame, patch: int = 14, dim: int = 128) -> DataFrame:
    """Features of decoded images of 8 bits: path, patch_id, embedding. Grey ones count as three equal channels, of more than three the first three; others fail the query."""
    ship_package(images.sparkSession)

    def run(batches):
        for pdf in batches:
            for path, h, w, c, bits, pixels in zip(*(pdf[k] for k in ("path", "height", "width", "channels", "bits", "pixels"))):
                if bits != 8:
                    raise ValueError(f"{path}: {bits} bits a sample, not 8")
                picture = np.frombuffer(pixels, np.uint8).reshape(h, w, c)
                x = patch_features(picture[..., :3] if c >= 3 else picture[..., :1].repeat(3, axis=-1), patch, dim)
                yield pd.DataFrame({"path": path, "patch_id": np.arange(len(x), dtype=np.int32), "embedding": list(x.astype(np.float32))})

    return images.select("path", "height", "width", "channels", "bits", "pixels").mapInPandas(run, "path string, patch_id int, embedding array<float>")
