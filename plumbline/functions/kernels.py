"""Small NumPy kernels for one image; Spark batches and distributes the images."""

from __future__ import annotations

import math

import numpy as np


def gaussian_taps(size: int) -> np.ndarray:
    """Normalised Gaussian taps with the usual sigma for a kernel size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    if size == 3:
        return np.array([0.25, 0.5, 0.25])
    if size == 5:
        return np.array([1, 4, 6, 4, 1]) / 16.0
    if size == 7:
        return np.array([2, 7, 14, 18, 14, 7, 2]) / 64.0
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def gaussian(image: np.ndarray, size: int) -> np.ndarray:
    """Separable blur of a 2-D array with mirrored borders."""
    taps, r = gaussian_taps(size), size // 2
    out = np.asarray(image, dtype=np.float64)
    for axis in (0, 1):
        if out.shape[axis] == 1:
            continue  # mirroring one pixel repeats it, and the taps sum to one
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="reflect")
        n = out.shape[axis]
        out = sum(t * np.take(wide, range(i, i + n), axis) for i, t in enumerate(taps))
    return out


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Whole-number luma of an H x W x 3 byte image (14-bit fixed-point weights)."""
    c = rgb.astype(np.int64)
    return ((c[..., 0] * 4899 + c[..., 1] * 9617 + c[..., 2] * 1868 + 8192) >> 14)


def laplacian_variance(gray: np.ndarray) -> float:
    g = np.asarray(gray, dtype=np.float64)
    p = np.pad(g, [(1, 1) if n > 1 else (0, 0) for n in g.shape], mode="reflect")
    total = -4.0 * g
    for axis in (0, 1):
        if g.shape[axis] == 1:
            total = total + 2.0 * g
            continue
        other = slice(1, -1) if g.shape[1 - axis] > 1 else slice(None)
        for cut in (slice(0, -2), slice(2, None)):
            total = total + (p[cut, other] if axis == 0 else p[other, cut])
    return float(total.var())


def tile_weights(height: int, width: int) -> np.ndarray:
    """Weights of a tile's pixels: a Hann window that never quite reaches zero."""
    def hann(n: int) -> np.ndarray:
        return np.ones(n) if n <= 2 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))

    return np.maximum(np.outer(hann(height), hann(width)), 1e-3)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected components: every set pixel gets the flat index of its first pixel, others -1.

    Labels hook onto the smallest neighbour label and chains are then shortened, so even long
    thin shapes need few rounds.
    """
    h, w = mask.shape
    none = h * w
    parent = np.arange(none + 1)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    flat = np.where(mask, np.arange(none).reshape(h, w), none)
    edges = []
    for dy, dx in steps:
        a = flat[: h - dy, max(0, -dx): w - max(0, dx)]
        b = flat[dy:, max(0, dx): w - max(0, -dx)]
        both = (a < none) & (b < none)
        edges.append(np.stack([a[both], b[both]]))
    left, right = np.concatenate(edges, axis=1)
    while left.size:
        ra, rb = parent[left], parent[right]
        live = ra != rb
        if not live.any():
            break
        lo, hi = np.minimum(ra, rb)[live], np.maximum(ra, rb)[live]
        np.minimum.at(parent, hi, lo)
        while True:
            shorter = parent[parent]
            if (shorter == parent).all():
                break
            parent = shorter
    return np.where(mask, parent[flat], -1)


def regions(anomaly_map: np.ndarray, threshold: float, min_area: int = 16
            ) -> tuple[list[dict], float]:
    """Regions of the smoothed map at the threshold, and the filled area ratio."""
    smooth = gaussian(anomaly_map, 3).astype(np.float32)
    labels = components(smooth >= threshold)
    h, w = labels.shape
    on = np.flatnonzero(labels >= 0)
    first, which, area = np.unique(labels.ravel()[on], return_inverse=True, return_counts=True)
    ys, xs = np.divmod(on, w)
    values = smooth.ravel()[on].astype(np.float64)
    order = np.argsort(which, kind="stable")
    opens = np.cumsum(area) - area

    def per_region(reduce: np.ufunc, of: np.ndarray) -> np.ndarray:
        return reduce.reduceat(of[order], opens) if len(opens) else of[:0]

    x0, x1, y0, y1 = (per_region(f, v) for v in (xs, ys) for f in (np.minimum, np.maximum))
    peak = per_region(np.maximum, values)
    mean, cx, cy = (np.bincount(which, v, len(first)) / area for v in (values, xs, ys))
    large = area >= min_area
    found = [{
        "region_id": n, "x0": int(x0[i]), "y0": int(y0[i]), "x1": int(x1[i]) + 1,
        "y1": int(y1[i]) + 1, "area_pixels": int(area[i]), "area_ratio": area[i] / (h * w),
        "mean_score": float(mean[i]), "max_score": float(peak[i]), "centroid_x": float(cx[i]),
        "centroid_y": float(cy[i])} for n, i in enumerate(np.flatnonzero(large), 1)]
    kept = np.zeros(h * w, dtype=bool)
    kept[on[large[which]]] = True
    kept = kept.reshape(h, w)
    return found, filled_ratio(kept)


def filled_ratio(kept: np.ndarray) -> float:
    """Share of pixels in the kept regions with their holes filled."""
    if not kept.any():
        return 0.0
    outside = components(~kept, diagonal=False)
    edge = np.concatenate([outside[0], outside[-1], outside[:, 0], outside[:, -1]])
    open_ground = np.isin(outside, np.unique(edge[edge >= 0]))
    return float((~open_ground).mean())


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Shrink by area weights."""
    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        scale = n / m
        for i in range(m):
            lo, hi = i * scale, (i + 1) * scale
            for j in range(int(lo), min(n, math.ceil(hi))):
                out[i, j] = min(hi, j + 1) - max(lo, j)
        return out / out.sum(axis=1, keepdims=True)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def resize_linear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres at half steps and clamped borders."""
    def weights(n: int, m: int) -> np.ndarray:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, n - 1)
        out = np.zeros((m, n))
        out[np.arange(m), lo] += 1 - (at - lo)
        out[np.arange(m), hi] += at - lo
        return out

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def per_channel(image: np.ndarray, change) -> np.ndarray:
    """Apply a change of a plane to every channel."""
    if image.ndim == 2:
        return change(image)
    return np.stack([change(image[..., c]) for c in range(image.shape[2])], axis=2)


def blurred(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur, rounded half up."""
    return image if size == 1 else per_channel(
        image, lambda plane: np.floor(gaussian(plane, size) + 0.5))


def coarse(image: np.ndarray, share: float) -> np.ndarray:
    """Shrunk to a share of both sides by area and grown again, rounded after each step.

    Nine digits decide what is half, so the order of sums does not.
    """
    h, w = image.shape[:2]
    size = [max(1, round(n * share)) for n in (h, w)]

    def whole(x: np.ndarray) -> np.ndarray:
        return np.rint(np.round(x, 9))

    return per_channel(image, lambda plane: whole(
        resize_linear(whole(resize_area(plane, *size)), h, w)))


def noise(shape: tuple[int, ...], spread: float, seed: int) -> np.ndarray:
    """Seeded normal noise, the same for every image of a shape."""
    return np.random.default_rng(seed).normal(0.0, spread, shape)
