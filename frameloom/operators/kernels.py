"""Order-dependent steps on one frame, as plain functions; DataFrame wrappers group by frame."""

from __future__ import annotations

import math
from collections import deque

NEAR4 = ((1, 0), (-1, 0), (0, 1), (0, -1))
NEAR8 = tuple((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy)


def joined(n: int, u, v):
    """The least number that links u-v (arrays) connect each of 0 to n - 1 to: links hook roots to smaller ones, then paths are halved."""
    import numpy as np

    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def neighbours(width: int, height: int, near):
    """Pairs of pixel numbers next to each other, each once: (earlier, later) by pixel, then by way."""
    import numpy as np

    k = np.arange(width * height).reshape(height, width)
    pairs = []
    for dx, dy in near:
        if dy > 0 or (dy == 0 and dx > 0):
            one = k[: height - dy, max(0, -dx) : width - max(0, dx)]
            two = k[dy:, max(0, dx) : width + min(0, dx)]
            pairs.append((one.ravel(), two.ravel()))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def components(labels, width: int, height: int, near=NEAR4, blank: int | None = None):
    """Each pixel's component: the least pixel number that equal labels connect it to; -1 where the label is ``blank``."""
    import numpy as np

    labels = np.asarray(labels)
    u, v = neighbours(width, height, near)
    same = labels[u] == labels[v]
    out = joined(len(labels), u[same], v[same])
    return out if blank is None else np.where(labels == blank, -1, out)


def hysteresis(values, width: int, height: int, high: int, low: int):
    """Pixels at or above ``high``, grown through neighbours at or above ``low`` that aren't at the border."""
    import numpy as np

    values = np.asarray(values)
    x, y = np.arange(len(values)) % width, np.arange(len(values)) // width
    seed = values >= high
    open_ = seed | ((values >= low) & (x > 0) & (y > 0) & (x < width - 1) & (y < height - 1))
    found = components(open_.astype(int), width, height, NEAR8, blank=0)
    held = np.zeros(len(values) + 1, bool)
    held[found[seed]] = True
    return (open_ & held[found]).astype(int)


def shoelace(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]])) / 2 if len(ring) > 2 else 0.0


def largest_loop(edges: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The closed loop of the largest area among directed edges; where several leave a vertex, the first listed goes first."""
    leave: dict[tuple[int, int], deque] = {}
    for x0, y0, x1, y1 in edges:
        leave.setdefault((x0, y0), deque()).append((x1, y1))
    best: list[tuple[int, int]] = []
    for start in list(leave):
        while leave[start]:
            ring, at = [start], leave[start].popleft()
            while at != start and leave.get(at):
                ring.append(at)
                at = leave[at].popleft()
            if at == start and abs(shoelace(ring)) > abs(shoelace(best)):
                best = ring
    return best


def without_collinear(ring):
    """Drops vertices on the line of their neighbours; the ring as it is if fewer than three would stay."""
    n = len(ring)
    kept = [
        p for i, p in enumerate(ring)
        if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - p[0])]
    return kept if len(kept) >= 3 else list(ring)


def segment_distance_squared(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2


def simplify(path, tolerance: float):
    """Ramer-Douglas-Peucker with a stack: a span splits at its first farthest vertex if that lies beyond the tolerance."""
    if len(path) <= 2 or tolerance <= 0:
        return list(path)
    keep, todo = {0, len(path) - 1}, [(0, len(path) - 1)]
    while todo:
        a, b = todo.pop()
        far, at = tolerance * tolerance, -1
        for i in range(a + 1, b):
            d = segment_distance_squared(path[i], path[a], path[b])
            if d > far:
                far, at = d, i
        if at >= 0:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [path[i] for i in sorted(keep)]


def simplify_ring(ring, tolerance: float):
    """Simplifies the two halves between the farther pair of extremes."""
    if len(ring) < 4 or tolerance <= 0:
        return list(ring)
    pairs = [(min(range(len(ring)), key=lambda i: ring[i][c]), max(range(len(ring)), key=lambda i: ring[i][c])) for c in (0, 1)]
    a, b = max(pairs, key=lambda p: math.dist(ring[p[0]], ring[p[1]]))
    if a == b:
        return list(ring)
    turn = lambda i, j: ring[i : j + 1] if i <= j else ring[i:] + ring[: j + 1]
    out = simplify(turn(a, b), tolerance)[:-1] + simplify(turn(b, a), tolerance)[:-1]
    return out if len(out) >= 3 else list(ring)


class DisjointSet:
    def __init__(self, n: int):
        self.parent, self.rank = list(range(n)), [0] * n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        if a != b:
            self.parent[b] = a
            self.rank[a] += self.rank[a] == self.rank[b]
        return a


def merged_regions(pixels, guide, width: int, height: int, quality: int, palette_size: int, min_area: float):
    """Regions by three passes of unions of neighbours. Returns each pixel's region as its least pixel number.

    Pass one joins pixels of about one colour, in any order. Pass two joins, in
    order of pixels, left before above, regions whose touching pixels of the
    blurred ``guide`` and whose means are near. Pass three joins those of one
    colour of the means' palette: both near it, near each other (large ones
    nearer) and with like touching pixels in guide and source. ``pixels`` and
    ``guide`` are arrays of b, g, r.
    """
    import numpy as np

    from .. import params as P
    from .palette import mean_palette, nearest_rows

    x, blurred = np.asarray(pixels, np.int64), np.asarray(guide, np.int64)
    n = width * height
    later, earlier = np.arange(n), np.arange(n)
    u = np.concatenate([later[later % width > 0], later[later >= width]])
    v = np.concatenate([earlier[later % width > 0] - 1, earlier[later >= width] - width])
    order = np.lexsort((u - v, u))  # by pixel, left before above
    u, v = u[order], v[order]
    gap = lambda a: ((a[u] - a[v]) ** 2).sum(axis=1)
    raw, soft = gap(x), gap(blurred)
    near = raw <= P.neighbor_merge(quality) ** 2
    first = joined(n, u[near], v[near])
    sets, count = DisjointSet(n), np.bincount(first, minlength=n).tolist()
    sets.parent = first.tolist()
    total = [np.bincount(first, x[:, c], n).tolist() for c in range(3)]

    def apart(a, b):
        return sum((t[a] / count[a] - t[b] / count[b]) ** 2 for t in total)

    def merge(a, b):
        keep = sets.union(a, b)
        gone = b if keep == a else a
        count[keep], count[gone] = count[a] + count[b], 0
        for t in total:
            t[keep], t[gone] = t[a] + t[b], 0
        return keep, gone

    most = P.blurred_region(quality) ** 2
    touch = (first[u] != first[v]) & (soft <= P.blurred_boundary(quality) ** 2)
    for p, q in zip(u[touch].tolist(), v[touch].tolist()):
        a, b = sets.find(p), sets.find(q)
        if a != b and apart(a, b) <= most:
            merge(a, b)

    now = np.array([sets.find(k) for k in range(n)])
    roots = np.unique(now)
    sizes = np.bincount(now, minlength=n)[roots]
    means = np.stack([np.bincount(now, x[:, c], n)[roots] / sizes for c in range(3)], axis=1)
    palette = mean_palette(means, sizes, palette_size)
    place = nearest_rows(np.clip(np.rint(means), 0, 255), palette)
    colour = dict(zip(roots.tolist(), place.tolist()))
    off = dict(zip(roots.tolist(), ((means - palette[place]) ** 2).sum(axis=1).tolist()))
    fit, region, large = P.palette_fit(quality, palette_size) ** 2, P.guided_region(quality, palette_size) ** 2, P.guided_large_region(quality) ** 2
    border, absorb = P.guided_boundary(quality, palette_size) ** 2, P.absorb_limit(min_area)
    touch = (now[u] != now[v]) & (soft <= border) & (raw <= 2 * border)
    for p, q in zip(u[touch].tolist(), v[touch].tolist()):
        a, b = sets.find(p), sets.find(q)
        if a == b or colour[a] != colour[b] or off[a] > fit or off[b] > fit:
            continue
        d = apart(a, b)
        if d > region or (min(count[a], count[b]) > absorb and d > large):
            continue
        shared = colour[a]
        keep, gone = merge(a, b)
        colour[keep], off[keep] = shared, sum((t[keep] / count[keep] - palette[shared][c]) ** 2 for c, t in enumerate(total))
        colour[gone] = -1
    now = np.array([sets.find(k) for k in range(n)])
    _, start, back = np.unique(now, return_index=True, return_inverse=True)
    return start[back]


def visiting_order(label, start: int, width: int, height: int) -> list[int]:
    """A component's pixels breadth first from its first one, neighbours row by row."""
    seen, order = {start}, [start]
    for k in order:
        y, x = divmod(k, width)
        for dx, dy in NEAR8:
            n = k + dy * width + dx
            if 0 <= x + dx < width and 0 <= y + dy < height and n not in seen and label[n] == start:
                seen.add(n)
                order.append(n)
    return order


def chains(pixels: list[int], width: int, shortest: int) -> list[list[int]]:
    """Splits a component's pixels (in visiting order) into walks until fewer than ``shortest`` are left.

    A walk starts at the first pixel with at most one neighbour left, else at
    one with the fewest, and goes on to the neighbour of the least turn, a
    diagonal step counting one more.
    """
    left, out = dict.fromkeys(pixels), []
    around = lambda k: [k + dy * width + dx for dx, dy in NEAR8 if 0 <= k % width + dx < width and k + dy * width + dx in left]
    while len(left) >= shortest:
        start = next((k for k in left if len(around(k)) <= 1), None)
        if start is None:
            start = min(left, key=lambda k: len(around(k)))
        walk, way = [start], None
        del left[start]
        while True:
            found = []
            for n in sorted(around(walk[-1])):
                dy, dx = n // width - walk[-1] // width, n % width - walk[-1] % width
                turn = abs(dx - way[0]) + abs(dy - way[1]) if way else 0
                found.append((3 * turn + (dx != 0 and dy != 0), n, (dx, dy)))
            if not found:
                break
            _, n, way = min(found, key=lambda f: (f[0], f[1]))
            walk.append(n)
            del left[n]
        out.append(walk)
    return out


def greedy_match(current: list, previous: list, score, most: float, next_id: int) -> tuple[list[int], int]:
    """Ids for primitives in their matching order: that of the unused previous one of the least score up to ``most``, else a new id."""
    used, ids = set(), []
    for c in current:
        best, at = most, -1
        for i, p in enumerate(previous):
            if i not in used and ((s := score(c, p)) < best or (s == best and at < 0)):
                best, at = s, i
        if at >= 0:
            used.add(at)
            ids.append(previous[at]["id"])
        else:
            ids.append(next_id)
            next_id += 1
    return ids, next_id


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def region_score(a: dict, b: dict, diagonal: float) -> float:
    """Centre, colour, size and overlap of two regions, weighed; 0 for equal ones."""
    size = max(0.0, min(1.0, abs(math.log((a["area"] + 1) / (b["area"] + 1))) / 2))
    return 0.35 * math.dist(a["center"], b["center"]) / diagonal + 0.35 * math.dist(a["color"], b["color"]) / 441.67295593 + 0.15 * size + 0.15 * (1 - iou(a["box"], b["box"]))
