"""Image kernels on numpy arrays, for use inside Arrow and Pandas functions."""

from __future__ import annotations

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    """uint8 luma of a BGR or BGRA image; a gray image as it is."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def trim(image: np.ndarray, margin: int = 4, paper: int = 245) -> np.ndarray:
    """The part around the ink (any channel below `paper`) with a margin; the whole image without ink."""
    if image is None or image.size == 0:
        raise ValueError("empty image")
    channels = image[..., :3] if image.ndim == 3 else image[..., None]
    ink = (channels < paper).any(axis=2)
    if not ink.any():
        return image
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return image[max(0, ys[0] - margin) : ys[-1] + 1 + margin, max(0, xs[0] - margin) : xs[-1] + 1 + margin]


def resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, as float64."""
    a = image.astype(np.float64)

    def axis(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, size - 1), at - lo

    y0, y1, fy = axis(a.shape[0], h)
    x0, x1, fx = axis(a.shape[1], w)
    shape = (1,) * (a.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *shape), fx.reshape(1, -1, *shape)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def area_resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Mean over the covered area, with shares of pixels at the edges."""

    def weights(size: int, to: int) -> np.ndarray:
        edges = np.arange(to + 1) * size / to
        lo, hi = np.arange(size), np.arange(size) + 1
        share = np.clip(np.minimum(edges[1:, None], hi) - np.maximum(edges[:-1, None], lo), 0, None)
        return share / share.sum(axis=1, keepdims=True)

    return weights(image.shape[0], h) @ image.astype(np.float64) @ weights(image.shape[1], w).T


def preprocess(image: np.ndarray, height: int = 48, width: int = 320) -> np.ndarray:
    """float32 (3, height, width): trimmed, scaled to the height, (x/255 - 0.5)/0.5, zeros to the right."""
    image = trim(image)
    image = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]
    w = min(width, int(np.ceil(height * image.shape[1] / max(1, image.shape[0]))))
    out = np.zeros((3, height, width), np.float32)
    out[:, :, :w] = ((resize(image, w, height) / 255.0 - 0.5) / 0.5).transpose(2, 0, 1)
    return out


def blur3(image: np.ndarray) -> np.ndarray:
    """The 3 by 3 binomial filter, edges mirrored without repeating."""
    a = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    a = (a[:-2] + 2 * a[1:-1] + a[2:]) / 4
    return (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]) / 4


def otsu(image: np.ndarray) -> int:
    """The threshold of the greatest variance between the classes; pixels above it are light."""
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    weight, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total[-1] * weight / weight[-1] - total) ** 2 / (weight * (weight[-1] - weight))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def equalized(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalization over tiles, their curves blended between centres."""
    h, w = image.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    curves = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * th * tw / 256)
            over = np.maximum(n - limit, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(n, limit) + over / 256) * 255 / (th * tw)
    y, x = (np.clip((np.arange(s) + 0.5) / t - 0.5, 0, tiles - 1) for s, t in ((h, th), (w, tw)))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    pick = lambda a, b: curves[a[:, None], b[None, :], image]
    out = pick(y0, x0) * (1 - fy) * (1 - fx) + pick(y0, x1) * (1 - fy) * fx + pick(y1, x0) * fy * (1 - fx) + pick(y1, x1) * fy * fx
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def adaptive(image: np.ndarray, window: int = 31, offset: float = 11) -> np.ndarray:
    """White where a pixel is above the Gaussian mean of its surroundings less the offset."""
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(window) - window // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    a = np.pad(image.astype(np.float64), window // 2, mode="edge")
    a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, a)
    a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, a)
    return np.where(image > np.rint(a) - offset, 255, 0).astype(np.uint8)


def variants(image: np.ndarray, extended: bool) -> list[tuple[str, np.ndarray]]:
    """The readings to make of a crop: three, or six, or eight for upright crops."""
    base = trim(image)
    g = gray(base)
    soft = np.clip(np.rint(blur3(g)), 0, 255).astype(np.uint8)
    light = soft > otsu(soft)
    out = [("raw", base), ("gray", g), ("otsu", np.where(light, 255, 0).astype(np.uint8))]
    if extended:
        out += [("clahe", equalized(g)), ("otsu_inv", np.where(light, 0, 255).astype(np.uint8)), ("adaptive", adaptive(g))]
        if base.shape[0] > 1.2 * base.shape[1]:
            out += [("rot90", np.rot90(base)), ("rot270", np.rot90(base, 3))]
    return out


def crop(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, pad: int = 4) -> np.ndarray:
    """The upright box, turned if it is much taller than wide, its edges repeated outwards."""
    part = image[max(0, y0) : max(y0 + 1, y1), max(0, x0) : max(x0 + 1, x1)]
    if part.shape[0] / max(part.shape[1], 1) >= 1.5:
        part = np.rot90(part)
    return np.pad(part, ((pad, pad), (pad, pad)) + ((0, 0),) * (part.ndim - 2), mode="edge")


def ink_columns(image: np.ndarray) -> np.ndarray:
    """The x of columns with a pixel darker than the threshold."""
    g = gray(image)
    return np.flatnonzero((g <= otsu(g)).any(axis=0))


def word_pieces(image: np.ndarray, least_width: int = 32) -> list[tuple[int, int]]:
    """(left, right) of the words in a crop, as scriptoria.operators.layout.word_spans has them."""
    w = image.shape[1]
    xs = ink_columns(image) if w >= least_width else np.zeros(0, int)
    if xs.size < 2:
        return [(0, w)]
    breaks = np.flatnonzero(np.diff(xs) > 1)
    lefts, rights = xs[np.concatenate(([0], breaks + 1))], xs[np.concatenate((breaks, [xs.size - 1]))]
    gaps = lefts[1:] - rights[:-1] - 1
    if not gaps.size:
        return [(0, w)]
    cuts = np.flatnonzero(gaps >= max(5, int(np.rint(np.median(gaps) * 1.7))))
    if not cuts.size:
        return [(0, w)]
    first, last = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(lefts) - 1]))
    return [(max(0, int(lefts[a]) - 4), min(w, int(rights[b]) + 5)) for a, b in zip(first, last, strict=True)]


def _components(mask: np.ndarray, corners: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, end and component of the runs of a mask; runs also touch at corners if `corners`."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    row, at = np.nonzero(np.diff(padded, axis=1))
    row, lo, hi = row[::2], at[::2], at[1::2]
    parent = list(range(len(row)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    lows, highs, reach = lo.tolist(), hi.tolist(), int(corners)
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if lows[i] < highs[j] + reach and lows[j] < highs[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if highs[i] < highs[j]:
                i += 1
            else:
                j += 1
    return row, lo, hi, np.array([find(k) for k in range(len(parent))], np.int64)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with everything that its parts enclose: all but the background that reaches the border."""
    h, w = mask.shape
    row, lo, hi, part = _components(~mask, False)
    outer = np.unique(part[(row == 0) | (row == h - 1) | (lo == 0) | (hi == w)])
    out = np.ones(mask.shape, bool)
    for y, x0, x1 in zip(*(c[np.isin(part, outer)].tolist() for c in (row, lo, hi)), strict=True):
        out[y, x0:x1] = False
    return out


def regions(image: np.ndarray, light: int = 245) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of the outermost connected light regions; what a region encloses, such as text, counts to its area."""
    row, lo, hi, part = _components(filled(gray(image) > light), True)
    names, at = np.unique(part, return_inverse=True)
    n = len(names)
    x0, y0, x1, y1 = np.full(n, 1 << 30), np.full(n, 1 << 30), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(x0, at, lo)
    np.minimum.at(y0, at, row)
    np.maximum.at(x1, at, hi)
    np.maximum.at(y1, at, row + 1)
    area = np.bincount(at, hi - lo, n).astype(np.int64)
    return list(zip(*(c.tolist() for c in (x0, y0, x1 - x0, y1 - y0, area)), strict=True))


def signature(frame: np.ndarray, w: int = 48, h: int = 32) -> np.ndarray:
    """Zero mean and unit mean magnitude of the shrunk and softened frame."""
    small = blur3(np.rint(area_resize(gray(frame), w, h))) / 255.0
    small -= small.mean()
    return small / (np.abs(small).mean() + 1e-6)


def device_signature(frame: np.ndarray, w: int = 48, h: int = 32) -> np.ndarray:
    """The device twin: nearest samples, no softening, scale floored."""
    ys, xs = np.arange(h) * frame.shape[0] // h, np.arange(w) * frame.shape[1] // w
    a = frame[ys][:, xs].astype(np.float64)
    a = (0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2] if a.ndim == 3 else a) / 255.0
    a -= a.mean()
    return a / max(np.abs(a).mean(), 1e-6)
