"""Suppression of overlapping detections on one page. Boxes are flat convex polygons with a score.

A box keeps those that overlap it by more than `near` as neighbours, and silences those above `over`. The result is
the mean of box and neighbours, weighted by score above `floor`. A box with fewer than `least` neighbours goes, and
its neighbours compete again.

Boxes are taken in parts, in the order in which they act, and compared only with those that are still open: the work
follows the boxes that are kept, however many lie on one place.
"""

from __future__ import annotations

import heapq

import numpy as np

from .geometry import polygon_ious

#: Boxes that act in a part, and pairs of boxes that are looked at in one, unless one box alone has more.
PART, PAIRS = 4096, 1 << 20


def runs(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) for all places from starts to stops, a run at a time."""
    n = np.maximum(stops - starts, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + starts[which]


def bounds(polygons: np.ndarray) -> np.ndarray:
    """(4, box): lowest and highest x, lowest and highest y."""
    xs, ys = polygons[:, 0::2], polygons[:, 1::2]
    return np.stack([xs.min(1), xs.max(1), ys.min(1), ys.max(1)])


def areas(polygons: np.ndarray) -> np.ndarray:
    x, y = polygons[:, 0::2], polygons[:, 1::2]
    return np.abs((x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1)) / 2


class Places:
    """Boxes by where they begin: in classes of like size, in rows as high as the class's highest, by x in a row."""

    def __init__(self, box: np.ndarray, ids: np.ndarray) -> None:
        wide, high = box[1] - box[0], box[3] - box[2]
        kind = lambda v: np.floor(np.log2(np.maximum(v, 1e-9)) / 2).astype(int)
        kinds, of = np.unique(np.stack([kind(wide), kind(high)]), axis=1, return_inverse=True)
        of = np.ravel(of)
        self.classes = []
        for k in range(kinds.shape[1]):
            own = np.flatnonzero(of == k)
            size = np.array([wide[own].max(), max(high[own].max(), 1e-9)])
            row = np.floor(box[2, own] / size[1])
            rows, r = np.unique(row, return_inverse=True)
            xs, c = np.unique(box[0, own], return_inverse=True)
            key = np.ravel(r) * (len(xs) + 1) + np.ravel(c)
            order = np.argsort(key, kind="stable")
            self.classes.append((size, rows, xs, key[order], ids[own[order]]))

    def candidates(self, box: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, id, asked): boxes that may touch the first `asked` of those given; at most `most` pairs, but for one."""
        found, total = [], np.zeros(box.shape[1], np.int64)
        slack = 1e-12 * (1 + np.abs(box).max(0))
        for size, rows, xs, keys, ids in self.classes:
            low = np.searchsorted(rows, np.floor((box[2] - size[1] * (1 + 1e-12) - slack) / size[1]))
            query, row = runs(low, np.searchsorted(rows, np.floor((box[3] + slack) / size[1]), side="right"))
            left = np.searchsorted(xs, box[0] - size[0] * (1 + 1e-12) - slack)
            right = np.searchsorted(xs, box[1] + slack, side="right")
            base = row * (len(xs) + 1)
            start, stop = np.searchsorted(keys, base + left[query]), np.searchsorted(keys, base + right[query])
            total += np.bincount(query, np.maximum(stop - start, 0), box.shape[1]).astype(np.int64)
            found.append((query, start, stop, ids))
        asked = max(1, int(np.searchsorted(np.cumsum(total), most, side="right")))
        pairs = []
        for query, start, stop, ids in found:
            n = np.searchsorted(query, asked)
            which, at = runs(start[:n], stop[:n])
            pairs.append((query[which], ids[at]))
        return *(np.concatenate(p) for p in zip(*pairs)), asked


class Overlaps:
    """How much boxes overlap those of a page that are still open."""

    def __init__(self, polygons: np.ndarray) -> None:
        self.polygons, self.box, self.area = polygons, bounds(polygons), areas(polygons)
        self.places, self.held = None, 0

    def of(self, part: np.ndarray, open_: np.ndarray, is_open: np.ndarray, above: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For the first so many of part, the open boxes that overlap each by more than `above` and by how much."""
        if self.places is None or 2 * len(open_) < self.held:
            self.places, self.held = Places(self.box[:, open_], open_), len(open_)
        i, j, asked = self.places.candidates(self.box[:, part], PAIRS)
        keep = is_open[j] & (part[i] != j)
        i, j = i[keep], j[keep]
        one, other = part[i], j
        # the one further left is clipped, whichever acts first
        swap = self.box[0, other] < self.box[0, one]
        one, other = np.where(swap, other, one), np.where(swap, one, other)
        v = ious_above(self.polygons, self.box, self.area, one, self.polygons, self.box, self.area, other, above)
        i, j, v = i[v > above], j[v > above], v[v > above]
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        edges = np.searchsorted(i, np.arange(asked + 1)).tolist()
        return [(j[a:b], v[a:b]) for a, b in zip(edges[:-1], edges[1:])], asked


def ious_above(p: np.ndarray, box_p: np.ndarray, area_p: np.ndarray, i: np.ndarray, q: np.ndarray, box_q: np.ndarray, area_q: np.ndarray, j: np.ndarray, above: float | np.ndarray) -> np.ndarray:
    """Intersection over union of p[i] and q[j]; 0 for pairs whose bounds and areas keep it from being above `above`."""
    wide = np.minimum(box_p[1, i], box_q[1, j]) - np.maximum(box_p[0, i], box_q[0, j])
    high = np.minimum(box_p[3, i], box_q[3, j]) - np.maximum(box_p[2, i], box_q[2, j])
    most = np.minimum(np.maximum(wide, 0) * np.maximum(high, 0), np.minimum(area_p[i], area_q[j]))
    # a little room, as areas are rounded
    may = np.flatnonzero((wide >= 0) & (high >= 0) & (most * (1 + 1e-9) > (above - 1e-9) * (area_p[i] + area_q[j] - most)))
    v = np.zeros(len(i))
    v[may] = polygon_ious(p[i[may]], q[j[may]])
    return v


#: Overlaps that are tried one after another: the higher, the fewer boxes can reach it.
LEVELS = (0.8, 0.6, 0.4, 0.2, 0.0)


def best_overlaps(p: np.ndarray, q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, id, iou to 12 digits) of the polygon of q that each of p overlaps most, the lowest id on ties.

    To overlap by a level, a box must reach into the other by so much of its sides; only such boxes are compared.
    """
    box_p, box_q, area_p, area_q = bounds(p), bounds(q), areas(p), areas(q)
    places = Places(box_q, np.arange(len(q)))
    rest = np.arange(len(p))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in LEVELS:
        open_, missed = rest, []
        while len(open_):
            inner = box_p[:, open_]
            reach = level * (1 - 1e-9) * area_p[open_] / np.maximum(np.stack([inner[3] - inner[2], inner[1] - inner[0]]), 1e-9)
            i, j, asked = places.candidates(inner + np.stack([reach[0], -reach[0], reach[1], -reach[1]]), PAIRS)
            v = np.round(ious_above(p, box_p, area_p, open_[i], q, box_q, area_q, j, level - 1e-9), 12)
            some = v > max(level - 1e-9, 0.0)
            i, w, v = open_[i[some]], ids[j[some]], v[some]
            order = np.lexsort((w, -v, i))
            i, w, v = i[order], w[order], v[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            first = first[v[first] >= level]
            found.append((i[first], w[first], v[first]))
            missed.append(np.setdiff1d(open_[:asked], i[first], assume_unique=True))
            open_ = open_[asked:]
        rest = np.sort(np.concatenate(missed)) if missed else rest[:0]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (rest, ids[:0], np.zeros(0))


def suppress(polygons: np.ndarray, scores: np.ndarray, over: float, near: float = 0.5, floor: float = 0.0, least: int = 0, classes: np.ndarray | None = None) -> tuple[list[int], np.ndarray, np.ndarray | None]:
    """Indices of the boxes kept, in falling score (higher index first on ties), their merged polygons and classes."""
    polygons, scores = np.asarray(polygons, float), np.asarray(scores, float)
    order = np.argsort(scores, kind="stable")[::-1]
    ranked, weights = polygons[order], scores[order] - floor
    ranked_classes = None if classes is None else np.asarray(classes, float)[order]
    kept, merged, merged_classes = [], [], []
    overlaps = Overlaps(ranked) if len(order) else None
    is_open = np.ones(len(order), bool)
    open_ = np.arange(len(order))
    while len(open_):
        part = open_[:PART]
        found, asked = overlaps.of(part, open_, is_open, max(min(over, near), 0.0))
        for i, (j, v) in zip(part.tolist(), found):
            if not is_open[i]:
                continue
            is_open[i] = False
            later = is_open[j]
            j, v = j[later], v[later]
            close = j[v > near]
            if len(close) < least:
                is_open[j[(v > over) & (v <= near)]] = False
                continue
            is_open[j[v > over]] = False
            group = [*close.tolist(), i]
            weight = weights[group]
            kept.append(int(order[i]))
            merged.append(weight @ ranked[group] / weight.sum())
            if classes is not None:
                merged_classes.append(weight @ ranked_classes[group] / weight.sum())
        rest = open_[asked:]
        open_ = rest[is_open[rest]]
    out = np.array(merged).reshape(len(kept), polygons.shape[1] if polygons.ndim > 1 else 8)
    return kept, out, np.array(merged_classes).reshape(len(kept), -1) if classes is not None else None


def suppress_softly(polygons: np.ndarray, scores: np.ndarray, threshold: float = 0.8, near: float = 0.5, least: int = 0) -> tuple[list[int], np.ndarray]:
    """Boxes whose score, damped by exp(-2 iou^2) for each better box, stays at the threshold or above."""
    polygons, scores = np.asarray(polygons, float), np.asarray(scores, float)
    left = scores.copy()
    kept, merged = [], []
    overlaps = Overlaps(polygons) if len(left) else None
    is_open, in_part = np.ones(len(left), bool), np.zeros(len(left), bool)
    open_, first = np.arange(len(left)), True
    while len(open_):
        ordered = open_[np.argsort(-left[open_], kind="stable")]
        part = ordered[:PART]
        found, asked = overlaps.of(part, open_, is_open, 0.0)
        part = part[:asked].tolist()
        in_part[part] = True
        of = dict(zip(part, found))
        # scores only fall, so no other box comes before those of the part that are still better than this one
        other = (-left[ordered[asked]], int(ordered[asked])) if asked < len(ordered) else (np.inf, 0)
        queue = [(-left[i], i) for i in part]
        heapq.heapify(queue)
        while queue and queue[0] < other:
            score, i = heapq.heappop(queue)
            if not is_open[i] or -score != left[i]:
                continue
            is_open[i] = False
            j, v = of[i]
            later = is_open[j]
            j, v = j[later], v[later]
            close = j[v > near]
            left[j] *= np.exp(-2 * v**2)
            is_open[j[left[j] < threshold]] = False
            if first:
                is_open &= left >= threshold
                first = False
            for k in j[in_part[j] & is_open[j]].tolist():
                heapq.heappush(queue, (-left[k], k))
            if len(close) >= least:
                group = [*close.tolist(), i]
                weight = scores[group]
                kept.append(i)
                merged.append(weight @ polygons[group] / weight.sum())
        in_part[part] = False
        open_ = open_[is_open[open_]]
    return kept, np.array(merged).reshape(len(kept), -1)
