"""Measures of a page image, for a grey image as a matrix; readers hand the matrices in."""

from __future__ import annotations

import numpy as np


def blur(grey: np.ndarray) -> float:
    """Variance of the Laplacian: small for blurred images."""
    g = grey.astype(np.float64)
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def contrast(grey: np.ndarray) -> float:
    return float(grey.std())


def noise(grey: np.ndarray, side: int = 8) -> float:
    """Median variance within small squares, of 1000."""
    h, w = grey.shape[0] // side * side, grey.shape[1] // side * side
    if not h or not w:
        return 0.0
    squares = grey[:h, :w].reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side * side)
    return float(np.median(squares.astype(np.float64).var(axis=1)) / 1000)


def needs_preprocessing(grey: np.ndarray) -> bool:
    return blur(grey) < 100 or contrast(grey) < 20 or not 50 <= grey.mean() <= 200


def threshold(grey: np.ndarray) -> np.ndarray:
    """Black and white by the level that parts the two classes best."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    total, levels = counts.sum(), np.arange(256)
    below, sums = counts.cumsum(), (counts * levels).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / total - sums) ** 2 / (below * (total - below))
    if not np.isfinite(between).any():
        return np.full_like(grey, 255)  # of one level
    return np.where(grey > int(np.nanargmax(between)), 255, 0).astype(np.uint8)


def stretch(grey: np.ndarray) -> np.ndarray:
    lo, hi = np.percentile(grey, [1, 99])
    return grey if hi <= lo else np.clip((grey - lo) * (255.0 / (hi - lo)), 0, 255).astype(np.uint8)


def median3(grey: np.ndarray) -> np.ndarray:
    p = np.pad(grey, 1, mode="edge")
    return np.median(np.stack([p[i : i + grey.shape[0], j : j + grey.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def rgb_to_grey(image: np.ndarray) -> np.ndarray:
    """A grey matrix of an image of three or four channels in the order red, green, blue."""
    if image.ndim == 2:
        return image
    return (image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def from_samples(samples: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Raw samples of a rendered page as a matrix; of more than three channels the first three, blue first."""
    a = np.frombuffer(samples, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a[..., [2, 1, 0]]


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue from 0 to 180, saturation and value from 0 to 255 of a red, green, blue image."""
    a = image[..., :3].astype(np.float64)
    top, low = a.max(axis=-1), a.min(axis=-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = a[..., 0], a[..., 1], a[..., 2]
    hue = np.select([top == low, top == r, top == g], [0, (60 * (g - b) / span) % 360, 120 + 60 * (b - r) / span], 240 + 60 * (r - g) / span)
    return np.stack([hue / 2, np.where(top > 0, 255 * (top - low) / np.where(top > 0, top, 1), 0), top], axis=-1)


#: Hue, saturation and value, from and to, of the ink of blue and of purple seals.
SEALS = {"blue": ((90, 40, 30), (130, 255, 255)), "purple": ((130, 40, 30), (160, 255, 255))}
SEAL_AREA = 50


def seal_mask(image: np.ndarray, least: int = SEAL_AREA) -> np.ndarray:
    """Where a seal is: connected places of its ink of at least so many points, widened by one."""
    h = hsv(image)
    ink = np.zeros(h.shape[:2], bool)
    for lo, hi in SEALS.values():
        ink |= ((h >= lo) & (h <= hi)).all(axis=-1)
    labels = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    while True:  # the largest number of a connected place spreads over it
        p = np.pad(labels, 1)
        new = np.where(ink, np.max([p[i : i + ink.shape[0], j : j + ink.shape[1]] for i in range(3) for j in range(3)], axis=0), 0)
        if (new == labels).all():
            break
        labels = new
    sizes = np.bincount(labels.ravel(), minlength=ink.size + 1)
    big = ink & (sizes[labels] >= least)
    p = np.pad(big, 1)
    return np.any([p[i : i + ink.shape[0], j : j + ink.shape[1]] for i in range(3) for j in range(3)], axis=0)


def remove_seals(image: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """The image with seals filled from their surroundings, from the edge of the mask inwards."""
    mask = seal_mask(image) if mask is None else mask
    out, open_ = image.astype(np.float64), mask.copy()
    while open_.any() and not open_.all():
        known = np.pad(~open_, 1)
        values = np.pad(np.where(open_[..., None], 0, out), ((1, 1), (1, 1), (0, 0)))
        h, w = open_.shape
        n = sum(known[i : i + h, j : j + w].astype(int) for i in range(3) for j in range(3))
        total = sum(values[i : i + h, j : j + w] for i in range(3) for j in range(3))
        ring = open_ & (n > 0)
        out[ring] = total[ring] / n[ring][:, None]
        open_ &= ~ring
    return out.round().astype(np.uint8)


def _blurred(grey: np.ndarray, side: int) -> np.ndarray:
    """Mean over a square of side points."""
    k = side // 2
    p = np.pad(grey.astype(np.float64), k, mode="edge")
    for axis in (0, 1):
        c = np.cumsum(np.insert(p, 0, 0, axis=axis), axis=axis)
        n = p.shape[axis] - 2 * k
        p = (np.take(c, range(2 * k + 1, 2 * k + 1 + n), axis=axis) - np.take(c, range(n), axis=axis)) / (2 * k + 1)
    return p


def local_threshold(grey: np.ndarray, side: int = 11, less: float = 2) -> np.ndarray:
    """Black and white by the mean of the surroundings, less a little."""
    return np.where(grey > _blurred(grey, side) - less, 255, 0).astype(np.uint8)


def sharpen(grey: np.ndarray, amount: float = 0.5) -> np.ndarray:
    g = grey.astype(np.float64)
    return np.clip(g + amount * (g - _blurred(grey, 3)), 0, 255).round().astype(np.uint8)


def local_contrast(grey: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation in tiles, with clipped histograms, blended between the tiles."""
    h, w = grey.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    rows, cols = -(-h // th), -(-w // tw)
    maps = np.empty((rows, cols, 256))
    for i in range(rows):
        for j in range(cols):
            part = grey[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
            n = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            top = max(1.0, limit * part.size / 256)
            over = np.maximum(n - top, 0).sum()
            maps[i, j] = (np.minimum(n, top) + over / 256).cumsum() * 255 / part.size
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, rows - 1), np.clip(np.floor(x).astype(int), 0, cols - 1)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, cols - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], grey]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.clip(out, 0, 255).round().astype(np.uint8)


def skew(grey: np.ndarray, most: float = 10.0, step: float = 0.5) -> float:
    """Degrees by which lines of text lean: the angle whose sheared row sums differ most from row to row."""
    dark = (grey < _blurred(grey, 15) - 10).astype(np.float64)
    ys, xs = np.nonzero(dark)
    if len(ys) < 20:
        return 0.0
    angles = np.arange(-most, most + step / 2, step)
    scores = []
    for a in angles:
        rows = np.round(ys - (xs - grey.shape[1] / 2) * np.tan(np.radians(a))).astype(int)
        n = np.bincount(rows - rows.min()).astype(np.float64)
        scores.append((np.diff(np.pad(n, 1)) ** 2).sum())
    best = np.flatnonzero(np.array(scores) == max(scores))
    return float(angles[best[np.argmin(np.abs(angles[best]))]])


def deskew(grey: np.ndarray, least: float = 0.5) -> np.ndarray:
    """The image turned upright where it leans by at least so many degrees; what comes in is white."""
    angle = skew(grey)
    if abs(angle) < least:
        return grey
    h, w = grey.shape
    a = np.radians(angle)
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.round(cy + (y - cy) * np.cos(a) + (x - cx) * np.sin(a)).astype(int)
    sx = np.round(cx + (x - cx) * np.cos(a) - (y - cy) * np.sin(a)).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full_like(grey, 255)
    out[inside] = grey[sy[inside], sx[inside]]
    return out


def scale(grey: np.ndarray, times: int) -> np.ndarray:
    return np.repeat(np.repeat(grey, times, axis=0), times, axis=1)


def gamma(grey: np.ndarray, power: float) -> np.ndarray:
    return (255 * (np.arange(256) / 255) ** power).round().astype(np.uint8)[grey]


def _extreme(grey: np.ndarray, side: int, of) -> np.ndarray:
    k = side // 2
    p = np.pad(grey, k, mode="edge")
    return of(np.stack([p[i : i + grey.shape[0], j : j + grey.shape[1]] for i in range(side) for j in range(side)]), axis=0)


def close_gaps(grey: np.ndarray, side: int = 3) -> np.ndarray:
    """Light gaps within dark strokes closed: the least, then the greatest of a square."""
    return _extreme(_extreme(grey, side, np.min), side, np.max)


def without_lines(grey: np.ndarray, share: float = 0.6) -> np.ndarray:
    """Ruled lines made white: rows and columns that are dark over most of their length."""
    dark = grey < 128
    out = grey.copy()
    out[dark.mean(axis=1) > share, :] = 255
    out[:, dark.mean(axis=0) > share] = 255
    return out


def bright(grey: np.ndarray, mean: float = 180.0) -> np.ndarray:
    return np.clip(grey.astype(np.float64) + (mean - grey.mean()), 0, 255).round().astype(np.uint8)


#: Chains of steps by name: the levels, weakest first, and the variants of each.
LEVELS = {
    "light": (stretch,), "medium": (stretch, median3), "heavy": (stretch, median3, threshold),
    "standard": (deskew, local_contrast, median3, local_threshold, sharpen), "fast": (local_contrast, threshold), "aggressive": (deskew, lambda g: local_contrast(g, 4.0), median3, lambda g: local_threshold(g, 15), sharpen, close_gaps),
    "otsu": (local_contrast, threshold), "morphology": (local_contrast, local_threshold, close_gaps), "scaled": (lambda g: scale(g, 2), local_contrast, local_threshold),
    "photo": (deskew, lambda g: local_contrast(g, 4.0), median3, sharpen, bright), "lines": (without_lines, local_threshold), "wide": (lambda g: local_threshold(g, 41),), "dark": (lambda g: gamma(g, 0.7), threshold),
    "acts": (deskew, local_contrast, without_lines, local_threshold), "ultimate": (deskew, lambda g: local_contrast(g, 3.0), median3, sharpen, lambda g: local_threshold(g, 21), close_gaps),
}


def preprocess(grey: np.ndarray, level: str) -> np.ndarray:
    for step in LEVELS[level]:
        grey = step(grey)
    return grey


def variants(grey: np.ndarray, names: tuple[str, ...] = ("standard", "aggressive", "otsu", "morphology", "scaled")) -> dict[str, np.ndarray]:
    return {n: preprocess(grey, n) for n in names}


def degradation(grey: np.ndarray) -> dict[str, float]:
    """Six measures from 0 (good) to 1: blur, contrast, noise, brightness, skew, and uneven light."""
    light = _blurred(grey, 31)
    clip = lambda x: float(min(1.0, max(0.0, x)))
    return {
        "blur": clip(1 - blur(grey) / 500), "contrast": clip(1 - contrast(grey) / 60), "noise": clip(noise(grey)), "brightness": clip(abs(grey.mean() - 180) / 180), "skew": clip(abs(skew(grey)) / 10), "light": clip(light.std() / 60),
    }


def universal(grey: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Each measure that is bad enough calls for its step."""
    bad = degradation(grey)
    steps = {"skew": deskew, "noise": median3, "light": lambda g: np.clip(g.astype(np.float64) - _blurred(g, 31) + 180, 0, 255).astype(np.uint8), "contrast": local_contrast, "brightness": bright, "blur": sharpen}
    for name, step in steps.items():
        if bad[name] > least:
            grey = step(grey)
    return grey


def level_score(image: np.ndarray, text: str = "") -> float:
    """How much an image needs work, from 0 to 100: dark or pale, flat, blurred, without text of its own, sealed, leaning
    and noisy images score."""
    grey = rgb_to_grey(image)
    mean, std, sharp = float(grey.mean()), contrast(grey), blur(grey)
    score = (100 - mean) * 0.6 if mean < 100 else max(0.0, (mean - 200) * 0.4)
    score += max(0.0, (50 - std) * 1.4) + max(0.0, (100 - sharp) * 0.9) + 45 * (len(text.strip()) < 400)
    if image.ndim == 3:
        h = hsv(image)
        score += 40 * (int(((h >= (90, 50, 50)) & (h <= (160, 255, 255))).all(axis=-1).sum()) > 1500)
    spread = noise(grey)
    return float(min(100.0, score + 25 * (abs(skew(grey)) > 2.0) + (spread * 100 if spread > 0.15 else 0.0)))


def is_photo(image: np.ndarray, chars: int) -> bool:
    grey = rgb_to_grey(image)
    colour = float(image[..., :3].astype(np.float64).std(axis=-1).mean()) if image.ndim == 3 else 0.0
    return 0.3 * (chars < 300) + 0.25 * (blur(grey) < 100) + 0.25 * (contrast(grey) < 50) + 0.2 * (colour > 20) > 0.5
