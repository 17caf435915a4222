"""Pixel operations of one picture, in numpy; they run inside Arrow batches, a picture at a time.

Masks are boolean arrays, True for ink; coordinates are (y, x) in arrays and x, y in boxes.
Thresholding and thinning follow the published methods; no parity to the pixel with other libraries is claimed.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from wireloom.operators.graph import least_of


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Brightness of rows of blue, green, red (alpha); one channel stays as it is."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[..., 0]
    # The usual weights of blue, green and red.
    return np.rint(x[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def ink(picture: np.ndarray, block: int = 31, offset: float = 7.0) -> np.ndarray:
    """Pixels that are darker than the Gaussian mean around them less the offset."""
    size = block | 1
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    mean = picture.astype(float)
    for axis in (0, 1):
        wide = np.pad(mean, [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        mean = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, wide)
    return picture <= np.rint(mean) - offset


def otsu(picture: np.ndarray) -> int:
    """The brightness that parts the histogram with the largest variance between its sides."""
    n = np.bincount(picture.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(all="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def shifted(mask: np.ndarray, dy: int, dx: int, fill: bool = False) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def box(height: int, width: int) -> list[tuple[int, int]]:
    """Offsets of a rectangle around its anchor, the middle."""
    return [(y - height // 2, x - width // 2) for y in range(height) for x in range(width)]


def eroded(mask: np.ndarray, offsets: Iterable[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, -dy, -dx, True) for dy, dx in offsets])


def dilated(mask: np.ndarray, offsets: Iterable[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, dy, dx) for dy, dx in offsets])


def opened(mask: np.ndarray, offsets: Iterable[tuple[int, int]]) -> np.ndarray:
    offsets = list(offsets)
    return dilated(eroded(mask, offsets), offsets)


def thick(mask: np.ndarray, width: int = 4) -> np.ndarray:
    """What is wider than a thin stroke."""
    return opened(mask, box(width, width))


def thin(mask: np.ndarray, width: int = 4) -> np.ndarray:
    return mask & ~thick(mask, width)


def labels(mask: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected components from 1 on, in order of their first pixel; 0 for the rest."""
    ys, xs = np.nonzero(mask)
    root, pairs = np.arange(len(ys)), []
    number = np.full(mask.shape, -1)
    number[ys, xs] = root
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = shifted(number + 1, -dy, -dx, 0)[ys, xs] - 1
        pairs.append((np.flatnonzero(other >= 0), other[other >= 0]))
    if len(ys):
        root = least_of(len(ys), *map(np.concatenate, zip(*pairs)))
    out = np.zeros(mask.shape, int)
    if len(root):
        out[ys, xs] = np.unique(root, return_inverse=True)[1] + 1
    return out


def stats(numbered: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Per component x0, y0, x1, y1 and area."""
    ys, xs = np.nonzero(numbered)
    if not len(ys):
        return []
    order = np.argsort(numbered[ys, xs], kind="stable")
    ys, xs, k = ys[order], xs[order], numbered[ys, xs][order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    area = np.diff(np.append(start, len(k)))
    ends = [np.minimum.reduceat(xs, start), np.minimum.reduceat(ys, start), np.maximum.reduceat(xs, start) + 1, np.maximum.reduceat(ys, start) + 1]
    return [tuple(map(int, row)) for row in zip(*ends, area)]


def without_speckles(mask: np.ndarray, least: int = 2) -> np.ndarray:
    numbered = labels(mask)
    area = np.bincount(numbered.ravel())
    area[0] = 0
    return area[numbered] >= max(least, 1)


def around(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from above."""
    return [shifted(mask, -dy, -dx) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning by Zhang and Suen: border pixels go in two alternating passes while the pattern stays connected."""
    mask = mask.copy()
    while True:
        before = int(mask.sum())
        for first in (True, False):
            p = around(mask)
            n = sum(x.astype(int) for x in p)
            turns = sum((~a & b).astype(int) for a, b in zip(p, [*p[1:], p[0]]))
            up, right, down, left = p[0], p[2], p[4], p[6]
            ends = ~(up & right & down) & ~(right & down & left) if first else ~(up & right & left) & ~(up & down & left)
            mask &= ~(mask & (n >= 2) & (n <= 6) & (turns == 1) & ends)
        if int(mask.sum()) == before:
            return mask


def degree(mask: np.ndarray) -> np.ndarray:
    return sum(x.astype(int) for x in around(mask)) * mask


def sums(values: np.ndarray, window: int) -> np.ndarray:
    """Sums over the window around each place; borders mirror without their edge, as box filters do."""
    low = window // 2
    wide = np.pad(values.astype(float), ((low, window - 1 - low),) * 2, mode="reflect" if min(values.shape) > window else "constant")
    total = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return np.rint(total[window:, window:] - total[:-window, window:] - total[window:, :-window] + total[:-window, :-window]).astype(int)


def dots(mask: np.ndarray, radius: int = 5, fill: float = 0.6) -> list[tuple[int, int]]:
    """x, y of skeleton branches whose surroundings are mostly ink: the disk of radius - 1, of whose area more than `fill`."""
    r = radius - 1
    disk = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]
    inked = sum(shifted(mask, dy, dx).astype(int) for dy, dx in disk)
    ys, xs = np.nonzero((degree(skeleton(mask)) >= 3) & (inked / (np.pi * r * r) > fill))
    return [(int(x), int(y)) for y, x in zip(ys, xs)]


def proposals(mask: np.ndarray, tokens: list[tuple[int, int, int, int]], spots: list[tuple[int, int]], c) -> list[dict]:
    """Boxes around places dense in skeleton ends and branches; text boxes and dots are taken out first. c: Config."""
    h, w = mask.shape
    clean = mask.copy()
    for x0, y0, x1, y1 in tokens:
        clean[max(0, y0 - 2) : y1 + 2, max(0, x0 - 2) : x1 + 2] = False
    yy, xx = np.ogrid[:h, :w]
    for x, y in spots:
        clean[(yy - y) ** 2 + (xx - x) ** 2 <= 9] = False
    n = degree(skeleton(clean))
    dense = dilated(sums((n >= 3) | (n == 1), c.density_window) >= c.density_least, box(c.density_merge, c.density_merge))
    strokes = thin(mask, c.thin_width)
    out = []
    for x0, y0, x1, y1, _ in stats(labels(dense)):
        x0, y0, x1, y1 = grown(x0, y0, x1, y1, c.box_pad, w, h)
        ys, xs = np.nonzero(clean[y0:y1, x0:x1])
        if len(xs):
            x0, y0, x1, y1 = grown(x0 + int(xs.min()), y0 + int(ys.min()), x0 + int(xs.max()) + 1, y0 + int(ys.max()) + 1, c.box_pad, w, h)
        if not c.box_least_area <= (x1 - x0) * (y1 - y0) <= c.box_most_area:
            continue
        part = strokes[y0:y1, x0:x1]
        kind = "symbol" if part.size == 0 or part.mean() < 0.5 else "ambiguous"
        out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "kind": kind, "class": None, "confidence": None, "source": "density"})
    return out


def grown(x0: int, y0: int, x1: int, y1: int, pad: int, w: int, h: int) -> tuple[int, int, int, int]:
    return max(0, x0 - pad), max(0, y0 - pad), min(w, x1 + pad), min(h, y1 + pad)


def wires(mask: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: int = 2, run: int = 11, stub: int = 6) -> np.ndarray:
    """Ink without the boxes' insides, but with straight runs that enter a box on one side and leave it opposite."""
    h, w = mask.shape
    out = mask.copy()
    for axis, straight in ((1, opened(mask, box(1, run))), (0, opened(mask, box(run, 1)))):
        for x0, y0, x1, y1 in boxes:
            x0, y0, x1, y1 = grown(x0, y0, x1, y1, pad, w, h)
            if x1 <= x0 or y1 <= y0:
                continue
            if axis == 1:
                out[y0:y1, x0:x1] = False
                through = mask[y0:y1, max(0, x0 - stub) : x0].any(axis=1) & mask[y0:y1, x1 : x1 + stub].any(axis=1)
                out[y0:y1, x0:x1] |= straight[y0:y1, x0:x1] & through[:, None]
            else:
                through = mask[max(0, y0 - stub) : y0, x0:x1].any(axis=0) & mask[y1 : y1 + stub, x0:x1].any(axis=0)
                out[y0:y1, x0:x1] |= straight[y0:y1, x0:x1] & through[None, :]
    return out


def runs(line: np.ndarray, least: int = 1) -> list[tuple[int, int]]:
    """First and last index of each run of True that is `least` long or more."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(int), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[0::2], edge[1::2]) if b - a >= least]


def attachments(mask: np.ndarray, x0: int, y0: int, x1: int, y1: int, band: int = 14, least: int = 2) -> list[tuple[int, int, float]]:
    """x, y and outward direction where ink reaches a box: top, bottom, left, right."""
    h, w = mask.shape
    out = []
    for y, part, way in ((y0, mask[max(0, y0 - band) : y0, x0:x1], 270.0), (y1, mask[y1 : min(h, y1 + band), x0:x1], 90.0)):
        out += [(x0 + (a + b) // 2, y, way) for a, b in runs(part.any(axis=0), least)] if part.size else []
    for x, part, way in ((x0, mask[y0:y1, max(0, x0 - band) : x0], 180.0), (x1, mask[y0:y1, x1 : min(w, x1 + band)], 0.0)):
        out += [(x, y0 + (a + b) // 2, way) for a, b in runs(part.any(axis=1), least)] if part.size else []
    return out


def refined(terminals: list[dict], points: list[tuple[int, int, float]]) -> list[dict]:
    """Terminals (idx, x, y, source, direction_deg) in order take the nearest free point; points left over become terminals."""
    out, free = [], list(range(len(points)))
    for t in terminals:
        if free:
            k = min(free, key=lambda i: (points[i][0] - t["x"]) ** 2 + (points[i][1] - t["y"]) ** 2)
            free.remove(k)
            t = {**t, "x": points[k][0], "y": points[k][1], "direction_deg": points[k][2], "source": "inferred"}
        out.append(t)
    return out + [{"idx": len(terminals) + n, "x": points[k][0], "y": points[k][1], "direction_deg": points[k][2], "source": "inferred", "name": None} for n, k in enumerate(free)]


def square(picture: np.ndarray, fill: int = 255) -> np.ndarray:
    """The picture in the middle of a white square of its longer side."""
    h, w = picture.shape[:2]
    n = max(h, w)
    out = np.full((n, n, *picture.shape[2:]), fill, picture.dtype)
    y, x = (n - h) // 2, (n - w) // 2
    out[y : y + h, x : x + w] = picture
    return out


def variants(picture: np.ndarray, turns: Iterable[int] = (0, 90, 180, 270), mirror: bool = True) -> list[tuple[int, bool, np.ndarray]]:
    """The picture turned clockwise in each way, and its mirror image too."""
    return [(t, m, np.rot90(p, -t // 90)) for m, p in [(False, picture), *([(True, picture[:, ::-1])] if mirror else [])] for t in turns]


def crop(picture: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """The part of a picture in a half-open box; what lies outside the picture is left out."""
    return picture[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners (x, y) of the convex hull, in turn."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    around = []
    for side in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        around += chain[:-1]
    return np.array(around)


def skew(mask: np.ndarray) -> float:
    """Degrees by which the smallest rectangle around the ink is tilted, from -45 to 45 (clockwise, as y points down); 0 for under 10 pixels."""
    ys, xs = np.nonzero(mask)
    if len(ys) < 10:
        return 0.0
    # a row's ends hold all corners of the hull
    order = np.flatnonzero(np.diff(ys, prepend=-1, append=-1))
    corners = hull(np.column_stack((np.concatenate((xs[order[:-1]], xs[order[1:] - 1])), np.concatenate((ys[order[:-1]], ys[order[1:] - 1])))).astype(float))
    if len(corners) < 3:
        return 0.0
    side = np.roll(corners, -1, axis=0) - corners
    angles = np.arctan2(side[:, 1], side[:, 0])
    turn = np.array([[np.cos(angles), np.sin(angles)], [-np.sin(angles), np.cos(angles)]]).transpose(2, 0, 1)
    spread = np.ptp(turn @ corners.T, axis=2)
    best = float(np.degrees(angles[np.argmin(spread.prod(axis=1))]))
    return (best + 45) % 90 - 45


def turned(picture: np.ndarray, degrees: float, fill=0) -> np.ndarray:
    """The picture with what is tilted by so many degrees made level: each place takes the nearest pixel around the middle."""
    h, w = picture.shape[:2]
    a = np.radians(degrees)
    dy, dx = np.mgrid[:h, :w].astype(float) - np.array([h / 2, w / 2])[:, None, None]
    x, y = np.rint(np.cos(a) * dx - np.sin(a) * dy + w / 2).astype(int), np.rint(np.sin(a) * dx + np.cos(a) * dy + h / 2).astype(int)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    out = np.full_like(picture, fill)
    out[inside] = picture[y[inside], x[inside]]
    return out


def deskewed(mask: np.ndarray, most: float = 5.0, least: float = 0.1) -> tuple[np.ndarray, float]:
    """The mask made level, and by how much; as it is, and 0, for less than `least` and more than `most` degrees."""
    degrees = skew(mask)
    if not least <= abs(degrees) <= most:
        return mask, 0.0
    return turned(mask, degrees), degrees


def blue(picture: np.ndarray) -> np.ndarray:
    """Where a picture of blue, green, red is blue ink; nowhere in one of a single channel."""
    if picture.ndim < 3 or picture.shape[2] < 3:
        return np.zeros(picture.shape[:2], dtype=bool)
    b, g, r = (picture[..., k].astype(float) for k in range(3))
    value, spread = picture[..., :3].max(axis=2).astype(float), np.ptp(picture[..., :3].astype(float), axis=2)
    with np.errstate(all="ignore"):
        full = np.where(value > 0, 255 * spread / value, 0)
        hue = np.where(value == r, 60 * (g - b) / spread, np.where(value == g, 120 + 60 * (b - r) / spread, 240 + 60 * (r - g) / spread)) % 360 / 2
    # Hues (half degrees) of blue ink, and the least saturation and value.
    return (spread > 0) & (np.rint(hue) >= 90) & (np.rint(hue) <= 140) & (np.rint(full) >= 40) & (value >= 40)


def enlarged(picture: np.ndarray, factor: int, lobes: int = 4) -> np.ndarray:
    """A gray picture so many times as large, by Lanczos' windowed sinc."""
    out = picture.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        near = np.floor(at).astype(int)[:, None] + np.arange(1 - lobes, lobes + 1)
        x = at[:, None] - near
        weight = np.sinc(x) * np.sinc(x / lobes)
        weight /= weight.sum(axis=1, keepdims=True)
        rows = np.moveaxis(out, axis, 0)[np.clip(near, 0, n - 1)]
        out = np.moveaxis(np.einsum("ij,ij...->i...", weight, rows), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and all that it encloses."""
    wide = np.pad(~mask, 1, constant_values=True)
    outside = np.zeros_like(wide)
    outside[0, :] = True
    while True:
        grown_ = wide & (outside | shifted(outside, 1, 0) | shifted(outside, -1, 0) | shifted(outside, 0, 1) | shifted(outside, 0, -1))
        if (grown_ == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = grown_


def circle(mask: np.ndarray, cover: float = 0.8, hollow: float = 0.5) -> tuple[int, int, int] | None:
    """x, y and radius (a quarter to two thirds of the shorter side) of the ring that is best covered with ink and hollow inside."""
    h, w = mask.shape
    low, high = int(0.25 * min(h, w)), int(0.65 * min(h, w))
    if low < 5:
        return None
    size = (h + 2 * high, w + 2 * high)
    spread = np.fft.rfft2(dilated(mask, box(3, 3)).astype(float), size)
    best = None

    def covered(r: int) -> np.ndarray:
        a = np.linspace(0, 2 * np.pi, max(8, int(8 * r)), endpoint=False)
        ring = np.unique(np.rint(np.column_stack((high + r * np.sin(a), high + r * np.cos(a)))).astype(int), axis=0)
        kernel = np.zeros((2 * high + 1, 2 * high + 1))
        kernel[ring[:, 0], ring[:, 1]] = 1 / len(ring)
        return np.fft.irfft2(spread * np.fft.rfft2(kernel, size), size)[high : high + h, high : high + w]

    for r in range(low, high + 1):
        found = covered(r)
        y, x = np.unravel_index(np.argmax(found), found.shape)
        if found[y, x] >= cover and (best is None or found[y, x] > best[0]) and covered(max(2, int(0.7 * r)))[y, x] < hollow:
            best = found[y, x], (int(x), int(y), r)
    return best and best[1]


def rectangular(mask: np.ndarray) -> bool:
    """Whether the largest component, holes filled, fills most of an upright box."""
    some = stats(labels(filled(mask)))
    if not some:
        return False
    x0, y0, x1, y1, area = max(some, key=lambda s: s[4])
    return area > 0.5 * (x1 - x0) * (y1 - y0) and 1.5 < (y1 - y0) / (x1 - x0) < 6.0


def corners(points: np.ndarray, share: float) -> np.ndarray:
    """The corners of a convex outline that stand out by more than a share of its length."""
    if len(points) < 3:
        return points
    side = np.sqrt(((np.roll(points, -1, axis=0) - points) ** 2).sum(axis=1))
    most = share * side.sum()

    def away(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = b - a
        n = np.hypot(*d)
        return np.abs(d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])) / n if n else np.sqrt(((p - a) ** 2).sum(axis=1))

    def simple(chain: np.ndarray) -> list[np.ndarray]:
        if len(chain) < 3:
            return [chain[0]]
        d = away(chain[1:-1], chain[0], chain[-1])
        k = int(d.argmax()) + 1
        return simple(chain[: k + 1]) + simple(chain[k:]) if d[k - 1] > most else [chain[0]]

    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    return np.array(simple(points[: far + 1]) + simple(np.concatenate((points[far:], points[:1]))))


def arrowhead(mask: np.ndarray, ring: tuple[int, int, int]) -> np.ndarray | None:
    """The three corners of a small triangle, solid or outlined: the first that the ring's drawing holds."""
    x, y, r = ring
    solid, hollow = opened(mask, box(3, 3)), filled(mask) & ~mask
    for part in (solid, hollow):
        numbered = labels(part)
        for k, (x0, y0, x1, y1, area) in enumerate(stats(numbered), 1):
            if not 4 <= area <= 0.15 * np.pi * r * r:
                continue
            ys, xs = np.nonzero(numbered[y0:y1, x0:x1] == k)
            outline = hull(np.column_stack((xs + x0, ys + y0)).astype(float))
            for share in (0.02, 0.05, 0.08, 0.12):
                found = corners(outline, share)
                if len(found) == 3:
                    return found
    return None


def inked(canvas: np.ndarray, distance: np.ndarray, thickness: int) -> None:
    """Draws black where a stroke of that thickness covers a pixel, gray along its edge."""
    np.minimum(canvas, np.rint(255 * np.clip(distance - thickness / 2 + 0.5, 0, 1)).astype(np.uint8), out=canvas)


def line(canvas: np.ndarray, points: list[tuple[float, float]], thickness: int = 1) -> None:
    """Draws straight strokes from point to point (x, y)."""
    yy, xx = np.mgrid[: canvas.shape[0], : canvas.shape[1]]
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(((xx - ax) * dx + (yy - ay) * dy) / n, 0, 1) if n else 0.0
        inked(canvas, np.hypot(xx - ax - t * dx, yy - ay - t * dy), thickness)


def arc(canvas: np.ndarray, x: float, y: float, radius: float, thickness: int = 1, start: float = 0.0, end: float = 360.0) -> None:
    """Draws a circle, or its part between two angles in degrees, the end beyond the start."""
    yy, xx = np.mgrid[: canvas.shape[0], : canvas.shape[1]]
    distance = np.abs(np.hypot(xx - x, yy - y) - radius)
    if end - start < 360:
        within = (np.degrees(np.arctan2(yy - y, xx - x)) - start) % 360 <= end - start
        tips = [np.hypot(xx - x - radius * np.cos(np.radians(a)), yy - y - radius * np.sin(np.radians(a))) for a in (start, end)]
        distance = np.where(within, distance, np.minimum(*tips))
    inked(canvas, distance, thickness)
