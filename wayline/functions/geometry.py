"""Array geometry: simplification, clipping, rasterization, distance transforms, sight lines, contours.

Plain numpy functions of one tile's or one feature's arrays, called from mapInPandas and applyInPandas.
"""

from __future__ import annotations

import math

import numpy as np

#: Earth radius over 1 - refraction coefficient, for sight lines over the curved earth (metres).
SIGHT_RADIUS = 6_371_000.0 / (1 - 0.13)


def simplify(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points a Douglas-Peucker simplification keeps; any number of dimensions (elevation scaled by the caller)."""
    n = len(pts)
    keep = np.zeros(n, bool)
    if n == 0:
        return keep
    keep[0] = keep[-1] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = pts[a], pts[b]
        d = q - p
        size = float(d @ d)
        x = pts[a + 1 : b] - p
        t = np.clip(x @ d / size, 0, 1)[:, None] if size > 0 else np.zeros((b - a - 1, 1))
        off = ((x - t * d) ** 2).sum(1)
        k = int(off.argmax())
        if off[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def clip_ring(ring: list[tuple[float, float]], west: float, south: float, east: float, north: float) -> list[tuple[float, float]]:
    """A ring cut to a box, side by side; not closed."""
    sides = [(0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)]
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for axis, at, sign in sides:
        out = []
        for i, q in enumerate(pts):
            p = pts[i - 1]
            a, b = (p[axis] - at) * sign, (q[axis] - at) * sign
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if b >= 0:
                out.append(tuple(q))
        pts = out
    return pts


def clip_line(line: np.ndarray, west: float, south: float, east: float, north: float) -> list[list[tuple[float, float]]]:
    """The parts of a line inside a box."""
    out: list[list[tuple[float, float]]] = []
    for p, q in zip(line[:-1], line[1:]):
        t0, t1, d = 0.0, 1.0, (q[0] - p[0], q[1] - p[1])
        for den, num in ((-d[0], p[0] - west), (d[0], east - p[0]), (-d[1], p[1] - south), (d[1], north - p[1])):
            if den == 0:
                if num < 0:
                    t0, t1 = 1.0, 0.0
            elif den < 0:
                t0 = max(t0, num / den)
            else:
                t1 = min(t1, num / den)
        if t0 > t1:
            continue
        a, b = (p[0] + t0 * d[0], p[1] + t0 * d[1]), (p[0] + t1 * d[0], p[1] + t1 * d[1])
        if out and t0 == 0.0 and out[-1][-1] == a:
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def fill_polygon(rings: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Cells whose centre lies inside (even-odd over all rings, cell units)."""
    out = np.zeros((height, width), bool)
    for row in range(height):
        y, xs = row + 0.5, []
        for r in rings:
            x0, y0, x1, y1 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
            m = (y0 > y) != (y1 > y)
            xs += list(x0[m] + (x1[m] - x0[m]) * (y - y0[m]) / (y1[m] - y0[m]))
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2]):
            lo, hi = max(0, math.ceil(a - 0.5)), min(width, math.ceil(b - 0.5))
            out[row, lo:hi] = True
    return out


def touch_line(line: np.ndarray, width: int, height: int) -> np.ndarray:
    """Every cell that a line touches."""
    out = np.zeros((height, width), bool)
    for p, q in zip(line[:-1], line[1:]):
        ts = [0.0, 1.0]
        for axis in (0, 1):
            d = q[axis] - p[axis]
            if d:
                lo, hi = sorted((p[axis], q[axis]))
                ts += [(k - p[axis]) / d for k in range(math.ceil(lo), math.floor(hi) + 1)]
        ts = sorted(set(ts))
        # where both axes are crossed at once the two places may differ by rounding; such a stretch is in no cell
        mids = [(a + b) / 2 for a, b in zip(ts, ts[1:]) if b - a > 1e-12] or [0.0]
        for t in mids:
            x, y = math.floor(p[0] + t * (q[0] - p[0])), math.floor(p[1] + t * (q[1] - p[1]))
            if 0 <= x < width and 0 <= y < height:
                out[y, x] = True
    return out


def coverage(rings: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Share of each cell that the rings cover, exact: each cell's clipped signed area (holes run the other way)."""
    out = np.zeros((height, width))
    for r in rings:
        x0, y0, x1, y1 = max(0, math.floor(r[:, 0].min())), max(0, math.floor(r[:, 1].min())), min(width, math.ceil(r[:, 0].max())), min(height, math.ceil(r[:, 1].max()))
        ring = [tuple(p) for p in r]
        for cy in range(y0, y1):
            band = clip_ring(ring, r[:, 0].min(), cy, r[:, 0].max(), cy + 1)
            for cx in range(x0, x1):
                c = np.array(clip_ring(band, cx, cy, cx + 1, cy + 1)) if band else np.empty((0, 2))
                if len(c) > 2:
                    x, y = c[:, 0], c[:, 1]
                    out[cy, cx] += (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2
    return np.clip(np.abs(out), 0, 1)


def distance_transform(seeds: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each cell to the nearest seed cell (infinite without one), by lower envelopes of parabolas."""
    big = 1e20
    f = np.where(seeds, 0.0, big)

    def line(g: np.ndarray) -> np.ndarray:
        n = len(g)
        v, z, k = np.zeros(n, int), np.empty(n + 1), 0
        z[0], z[1] = -math.inf, math.inf
        for q in range(1, n):
            while True:
                p = v[k]
                s = ((g[q] + q * q) - (g[p] + p * p)) / (2 * q - 2 * p)
                if s > z[k]:
                    break
                k -= 1
            k += 1
            v[k], z[k], z[k + 1] = q, s, math.inf
        out, k = np.empty(n), 0
        for q in range(n):
            while z[k + 1] < q:
                k += 1
            out[q] = (q - v[k]) ** 2 + g[v[k]]
        return out

    f = np.apply_along_axis(line, 0, f)
    f = np.apply_along_axis(line, 1, f)
    return np.where(f >= big / 2, math.inf, np.sqrt(f))


def signed_distance(inside: np.ndarray) -> np.ndarray:
    """Distance to the other side, positive inside."""
    return np.where(inside, distance_transform(~inside), -distance_transform(inside))


def bilinear(grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at positions in cells, cell centres at .5; beyond the edge the edge's."""
    x, y = np.clip(x - 0.5, 0, grid.shape[1] - 1), np.clip(y - 0.5, 0, grid.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, grid.shape[1] - 1), np.minimum(y0 + 1, grid.shape[0] - 1)
    fx, fy = x - x0, y - y0
    return grid[y0, x0] * (1 - fx) * (1 - fy) + grid[y0, x1] * fx * (1 - fy) + grid[y1, x0] * (1 - fx) * fy + grid[y1, x1] * fx * fy


def sight_matrix(heights: np.ndarray, canopy: np.ndarray | None, x: float, y: float, eye: float, cell_m: float, reach: np.ndarray, bearing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat cell index (-1 off the grid) and tangent of the sight angle of every point at distances ``reach`` in directions ``bearing`` from the eye."""
    rows, cols = heights.shape
    east = x + np.sin(bearing)[:, None] * (reach / cell_m)
    south = y - np.cos(bearing)[:, None] * (reach / cell_m)
    at = np.where((east >= 0) & (east < cols) & (south >= 0) & (south < rows), np.floor(south) * cols + np.floor(east), -1).astype(np.int64)
    top = heights.ravel()[at]
    close = reach < 3 * cell_m
    if close.any():
        top[:, close] = bilinear(heights, east[:, close].ravel(), south[:, close].ravel()).reshape(-1, close.sum())
    if canopy is not None:
        top = top + np.where(reach >= 60, canopy.ravel()[at], 0.0)
    # the ground falls away by the square of the distance over twice the sight radius
    tangent = (top - eye) / reach - reach / (2 * SIGHT_RADIUS)
    return at, np.where(at >= 0, tangent, -math.inf)


def viewshed(heights: np.ndarray, canopy: np.ndarray | None, water: np.ndarray | None, x: float, y: float, cell_m: float, eye_m: float = 1.5, radius_m: float = 15_000.0, rays: int = 2048, at_once: int = 256) -> dict:
    """What is seen from a point: km² visible, of it water, farthest km and the share of the cells looked at.

    A cell is seen where a ray's sight angle equals its running maximum, the horizon of what lies before it; rays are worked out
    ``at_once`` at a time as matrices, points 0.7 cells apart from half a cell on.  Trees count from 60 m on; within three cells heights are interpolated.
    A grid is convex, so a ray that has left it has no further points on it."""
    eye = float(bilinear(heights, np.array([x]), np.array([y]))[0]) + eye_m
    reach = np.arange(0.5, max(radius_m / cell_m, 0.5) + 1e-9, 0.7) * cell_m
    reach = reach[reach <= radius_m]
    looked, seen = np.zeros(heights.size, bool), np.zeros(heights.size, bool)
    for first in range(0, rays if len(reach) else 0, at_once):
        bearing = np.arange(first, min(first + at_once, rays)) * (2 * math.pi / rays)
        at, tangent = sight_matrix(heights, canopy, x, y, eye, cell_m, reach, bearing)
        on = at >= 0
        looked[at[on]] = True
        seen[at[on & (tangent == np.maximum.accumulate(tangent, axis=1))]] = True
    centre = np.indices(heights.shape) + 0.5
    far = np.hypot(centre[1] - x, centre[0] - y).ravel() * cell_m
    looked &= far <= radius_m
    seen &= looked
    km2 = cell_m * cell_m / 1e6
    return {
        "visible_km2": float(seen.sum() * km2), "water_km2": float((seen & water.ravel()).sum() * km2) if water is not None else 0.0,
        "farthest_km": float(far[seen].max() / 1000) if seen.any() else 0.0, "visible_share": float(seen.sum() / looked.sum()) if looked.any() else 0.0,
    }


def landscape(heights: np.ndarray, x: float, y: float, cell_m: float, built: np.ndarray | None = None, open_: np.ndarray | None = None) -> dict:
    """Relief within 3 km, height over the weighted mean within 1.5 km, shares of built-up (500 m) and open land (1 km)."""
    rows, cols = heights.shape
    yy, xx = np.mgrid[0:rows, 0:cols]
    dist = np.hypot((xx + 0.5 - x) * cell_m, (yy + 0.5 - y) * cell_m)
    own = float(bilinear(heights, np.array([x]), np.array([y]))[0])
    near = heights[dist <= 3000]
    w = np.where(dist <= 1500, 1 - dist / 1500, 0)
    share = lambda m, r: float(m[dist <= r].mean()) if m is not None and (dist <= r).any() else 0.0
    return {"relief": float(near.max() - near.min()) if near.size else 0.0, "tpi": own - float((heights * w).sum() / w.sum()) if w.sum() else 0.0, "built": share(built, 500), "open": share(open_, 1000)}


def slope_direction(heights: np.ndarray, cell_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope (degrees) and downhill direction (degrees from north, clockwise) by central differences."""
    gy, gx = np.gradient(heights, cell_m)
    return np.degrees(np.arctan(np.hypot(gx, gy))), np.degrees(np.arctan2(-gx, gy)) % 360


def contours(heights: np.ndarray, level: float) -> list[tuple[float, float, float, float]]:
    """Pieces (x0, y0, x1, y1) of the line where the heights at grid points cross a level; saddles go by the centre's mean."""
    out = []
    for r in range(heights.shape[0] - 1):
        for c in range(heights.shape[1] - 1):
            v = [heights[r, c], heights[r, c + 1], heights[r + 1, c + 1], heights[r + 1, c]]
            if any(math.isnan(a) for a in v):
                continue
            corner = [(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)]
            cross = []
            for k in range(4):
                a, b = v[k], v[(k + 1) % 4]
                if (a >= level) != (b >= level):
                    t = (level - a) / (b - a)
                    (ax, ay), (bx, by) = corner[k], corner[(k + 1) % 4]
                    cross.append((ax + t * (bx - ax), ay + t * (by - ay)))
            if len(cross) == 2:
                out.append((*cross[0], *cross[1]))
            elif len(cross) == 4:
                turn = (sum(v) / 4 >= level) == (v[0] >= level)
                for i, j in ((0, 1), (2, 3)) if turn else ((3, 0), (1, 2)):
                    out.append((*cross[i], *cross[j]))
    return out


def equal_area(lon: np.ndarray, lat: np.ndarray, lon0: float, lat0: float, radius: float = 6_371_007.181) -> tuple[np.ndarray, np.ndarray]:
    """Lambert azimuthal equal-area metres on the sphere; equal_area_back() inverts it."""
    a, b, c = np.radians(lon - lon0), np.radians(lat), math.radians(lat0)
    k = np.sqrt(2 / (1 + math.sin(c) * np.sin(b) + math.cos(c) * np.cos(b) * np.cos(a)))
    return radius * k * np.cos(b) * np.sin(a), radius * k * (math.cos(c) * np.sin(b) - math.sin(c) * np.cos(b) * np.cos(a))


def equal_area_back(x: np.ndarray, y: np.ndarray, lon0: float, lat0: float, radius: float = 6_371_007.181) -> tuple[np.ndarray, np.ndarray]:
    c = math.radians(lat0)
    rho = np.hypot(x, y)
    e = 2 * np.arcsin(np.clip(rho / (2 * radius), 0, 1))
    safe = np.where(rho == 0, 1, rho)
    lat = np.arcsin(np.clip(np.cos(e) * math.sin(c) + y * np.sin(e) * math.cos(c) / safe, -1, 1))
    lon = np.arctan2(x * np.sin(e), safe * math.cos(c) * np.cos(e) - y * math.sin(c) * np.sin(e))
    return np.degrees(lon) + lon0, np.degrees(np.where(rho == 0, c, lat))


def polar(lon: np.ndarray, lat: np.ndarray, north: bool, radius: float = 6_371_008.8) -> tuple[np.ndarray, np.ndarray]:
    """Polar stereographic metres of the sphere, true at the pole; polar_back() inverts it."""
    s = 1.0 if north else -1.0
    r = 2 * radius * np.tan(np.radians(90 - s * lat) / 2)
    return r * np.sin(np.radians(lon)), -s * r * np.cos(np.radians(lon))


def polar_back(x: np.ndarray, y: np.ndarray, north: bool, radius: float = 6_371_008.8) -> tuple[np.ndarray, np.ndarray]:
    s = 1.0 if north else -1.0
    return np.degrees(np.arctan2(x, -s * y)), s * (90 - 2 * np.degrees(np.arctan(np.hypot(x, y) / (2 * radius))))


def lake_bowl(inside: np.ndarray, cell_m: float, deepest: float) -> np.ndarray:
    """Depths of a lake known by its greatest depth: a bowl of the distance to the shore."""
    d = distance_transform(~inside) * cell_m
    most = d[inside].max() if inside.any() else 0.0
    return np.where(inside, deepest * (1 - (1 - np.minimum(d / most, 1)) ** 2), 0.0) if most > 0 else np.zeros(inside.shape)


def exact_round(v: float, digits: int = 0) -> float:
    """Half to even on the exact binary value."""
    return round(v, digits)


def compensated_sum(values) -> float:
    return math.fsum(values)
