"""Gaussian mixtures of documents that are too large for a task: blocks of glyphs stay on the executors, only sums go
to the driver, the same steps as in functions/mixtures.py in every other way."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.mixtures import lower_root, nearest, shrunk

#: Glyphs of a block, and of a partition of blocks at most on average.
BLOCK, PART = 1024, 50_000
BLOCKS = "doc string, place long, ids array<bigint>, x binary"
_KINDS = pa.schema([("doc", pa.string()), ("place", pa.int64()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())])


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(rows, -1)


def _blocks(chars: DataFrame, n: int) -> DataFrame:
    """(doc, place, ids, x): glyphs in order of doc and char_id, a matrix a block; place is in that order too."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for b in batches:
            docs = b.column("doc").to_pylist()
            cuts = [0, *(i for i in range(1, len(docs)) if docs[i] != docs[i - 1]), len(docs)]
            parts = [(i, min(i + BLOCK, hi)) for lo, hi in zip(cuts[:-1], cuts[1:]) for i in range(lo, hi, BLOCK)]
            ids, images = b.column("char_id"), b.column("img")
            x = [np.ascontiguousarray(pc.list_flatten(images[i:j]).to_numpy(zero_copy_only=False), float).tobytes() for i, j in parts]
            rows = {"doc": [docs[i] for i, _ in parts], "place": list(range(place, place + len(parts))), "ids": [ids[i:j].to_pylist() for i, j in parts], "x": x}
            place += len(parts)
            yield pa.RecordBatch.from_pydict(rows, schema=_KINDS)

    slim = chars.select("doc", F.col("char_id").cast("long").alias("char_id"), F.col("img").cast("array<double>").alias("img"))
    return slim.repartitionByRange(n, "doc", "char_id").sortWithinPartitions("doc", "char_id").mapInArrow(pack, BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[int], np.ndarray]]:
    for b in batches:
        for r in range(b.num_rows):
            ids = b.column("ids")[r].as_py()
            yield b.column("doc")[r].as_py(), b.column("place")[r].as_py(), ids, _matrix(b.column("x")[r].as_py(), len(ids))


def _summed(blocks: DataFrame, states: dict, sums: Callable[[np.ndarray, object], list]) -> dict[str, list]:
    """By document the sums over its blocks of what sums(x, state) gives; added up a task at a time, then here."""
    shared = blocks.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for doc, _, _, x in _rows(batches):
            if doc in shared.value:
                part = sums(x, shared.value[doc])
                total[doc] = [a + b for a, b in zip(total[doc], part)] if doc in total else part
        yield pa.RecordBatch.from_pydict({"doc": list(total), "sums": [pickle.dumps(v) for v in total.values()]}, schema=pa.schema([("doc", pa.string()), ("sums", pa.binary())]))

    out: dict[str, list] = {}
    for r in blocks.mapInArrow(run, "doc string, sums binary").collect():
        part = pickle.loads(r["sums"])
        out[r["doc"]] = [a + b for a, b in zip(out[r["doc"]], part)] if r["doc"] in out else part
    shared.destroy()
    return out


def _projected(blocks: DataFrame, keep: float) -> DataFrame:
    """The blocks with scores on the leading components in place of images, as principal_components gives but for signs."""
    first = _summed(blocks, _all(blocks), lambda x, _: [len(x), x.sum(0)])
    means = {d: s / n for d, (n, s) in first.items()}
    axes = {}
    for d, (scatter,) in _summed(blocks, means, lambda x, m: [(x - m).T @ (x - m)]).items():
        size, vectors = np.linalg.eigh(scatter)
        size, vectors = np.maximum(size[::-1], 0), vectors[:, ::-1]
        share = np.cumsum(size) / max(size.sum(), 1e-300)
        axes[d] = vectors[:, : min(len(size), int(np.searchsorted(share, keep, side="right")) + 1)]
    shared = blocks.sparkSession.sparkContext.broadcast((means, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, axes = shared.value
        for doc, place, ids, x in _rows(batches):
            yield pa.RecordBatch.from_pydict({"doc": [doc], "place": [place], "ids": [ids], "x": [((x - means[doc]) @ axes[doc]).tobytes()]}, schema=_KINDS)

    return blocks.mapInArrow(run, BLOCKS)


def _all(blocks: DataFrame) -> dict[str, None]:
    return {r["doc"]: None for r in blocks.select("doc").distinct().collect()}


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the nearest centre, as spread_seeds has it."""
    d = ((x - centres[0]) ** 2).sum(1)
    for c in centres[1:]:
        d = np.minimum(d, ((x - c) ** 2).sum(1))
    return d


def _seeds(blocks: DataFrame, index: dict[str, list[tuple[int, int]]], components: int, seed: int) -> dict[str, np.ndarray]:
    """spread_seeds of each document: blocks send sums of squared distances, and the block that is drawn from."""

    def fetched(wanted: dict[str, int]) -> dict[str, np.ndarray]:
        rows = blocks.filter(F.col("place").isin(sorted(set(wanted.values())))).collect()
        at = {(r["doc"], r["place"]): _matrix(bytes(r["x"]), len(r["ids"])) for r in rows}
        return {d: at[d, p] for d, p in wanted.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, place, _, x in _rows(batches):
            if doc in shared.value:
                yield pa.RecordBatch.from_pydict({"doc": [doc], "place": [place], "d": [float(_apart(x, shared.value[doc]).sum())]})

    draws = {d: np.random.default_rng(seed) for d in index}
    drawn, rest = {}, {}
    for d, places in index.items():
        ends = np.cumsum([n for _, n in places])
        i = int(draws[d].integers(ends[-1]))
        b = int(np.searchsorted(ends, i, side="right"))
        drawn[d], rest[d] = places[b][0], i - int(ends[b] - places[b][1])
    got = fetched(drawn)
    chosen = {d: got[d][rest[d]][None] for d in index}
    open_ = {d for d in index if min(components, sum(n for _, n in index[d])) > 1}
    while open_:
        shared = blocks.sparkSession.sparkContext.broadcast({d: chosen[d] for d in open_})
        apart: dict[str, list] = {}
        for r in blocks.mapInArrow(sums, "doc string, place long, d double").collect():
            apart.setdefault(r["doc"], []).append((r["place"], r["d"]))
        shared.destroy()
        drawn, rest = {}, {}
        for d in sorted(open_):
            places, size = zip(*sorted(apart[d]))
            upto = np.cumsum(size)
            if upto[-1] == 0:
                open_.discard(d)
                continue
            goal = draws[d].random() * upto[-1]
            b = min(int(np.searchsorted(upto, goal, side="right")), len(size) - 1)
            drawn[d], rest[d] = places[b], goal - (upto[b - 1] if b else 0.0)
        got = fetched(drawn) if drawn else {}
        for d, goal in rest.items():
            upto = np.cumsum(_apart(got[d], chosen[d]))
            # the last point that can be drawn, where rounding leads beyond it
            i = min(int(np.searchsorted(upto, goal, side="right")), int(np.searchsorted(upto, upto[-1])))
            chosen[d] = np.vstack([chosen[d], got[d][i]])
            if len(chosen[d]) >= components:
                open_.discard(d)
    return chosen


def _round(x: np.ndarray, centres: np.ndarray) -> list:
    """Of a round of k-means: loss, points and sums of each centre."""
    i, d = nearest(x, centres)
    mine = (i == np.arange(len(centres))[:, None]).astype(float)
    return [float(d.sum()), mine.sum(1), mine @ x]


class Densities:
    """A mixture in the form that blocks need: roots of precisions side by side, so that all components are a product."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> None:
        roots = [lower_root(c) for c in covs]
        inverse = [np.linalg.inv(r) for r in roots]
        self.turn = np.concatenate([r.T for r in inverse], 1)
        self.shift = np.concatenate([r @ m for r, m in zip(inverse, means)])
        self.level = np.array([np.log(p) - np.log(np.diag(r)).sum() for p, r in zip(weights, roots)]) - 0.5 * means.shape[1] * math.log(2 * math.pi)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(point, component) shares, and the log likelihood of the points."""
        z = x @ self.turn
        z -= self.shift
        z = z.reshape(len(x), len(self.level), -1)
        logs = self.level - 0.5 * np.einsum("nkd,nkd->nk", z, z)
        top = logs.max(1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(1))
        return np.exp(logs - total[:, None]), float(total.sum())


def _shares(x: np.ndarray, state: Densities | np.ndarray) -> tuple[np.ndarray, float]:
    if isinstance(state, Densities):
        return state.shares(x)
    return np.eye(len(state))[nearest(x, state)[0]], 0.0


def _moments(x: np.ndarray, state: Densities | np.ndarray) -> list:
    """Log likelihood, and of each component the mass, the sum and the sum of squares of its points."""
    share, fit = _shares(x, state)
    squares = np.empty((share.shape[1], x.shape[1], x.shape[1]))
    for k, w in enumerate(np.sqrt(share).T):
        y = x * w[:, None]
        squares[k] = y.T @ y
    return [fit, share.sum(0), share.T @ x, squares]


def _mixture(n: int, mass: np.ndarray, sums: np.ndarray, squares: np.ndarray, least: float = 2.0) -> Densities:
    """Mixture.of from moments."""
    if not (mass >= least).any():
        mass, sums, squares = np.array([float(n)]), sums.sum(0)[None], squares.sum(0)[None]
    held = mass >= least if len(mass) > 1 else np.ones(1, bool)
    mass, means = mass[held], sums[held] / mass[held][:, None]
    weights = mass / mass.sum()
    covs = [shrunk(s / z - np.outer(m, m), p * n) for s, z, m, p in zip(squares[held], mass, means, weights)]
    return Densities(weights, means, np.stack(covs))


def _settled(values: list[float], tolerance: float) -> bool:
    return len(values) > 1 and abs(values[-2] - values[-1]) <= tolerance * abs(values[-2])


def fitted(chars: DataFrame, n: int, share: float, components: int, most: int, seed: int, tolerance: float = 1e-6) -> DataFrame:
    """(doc, char_id, root) of a few large documents with n glyphs in all, fitted side by side.

    The glyphs' scores stay cached in blocks, for as long as the result is in use. A round is one job that sends the
    sums of each task and document, so its size doesn't depend on the number of glyphs.
    """
    spark = chars.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, n // PART)
    raw = _blocks(chars, parts).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = _projected(raw, share).persist(StorageLevel.MEMORY_AND_DISK)
    index: dict[str, list[tuple[int, int]]] = {}
    for r in blocks.select("doc", "place", F.size("ids").alias("n")).orderBy("place").collect():
        index.setdefault(r["doc"], []).append((r["place"], r["n"]))
    raw.unpersist()
    sizes = {d: sum(k for _, k in v) for d, v in index.items()}

    centres = _seeds(blocks, index, components, seed)
    after = _summed(blocks, centres, _round)
    losses: dict[str, list[float]] = {d: [] for d in index}
    open_ = set(index)
    for _ in range(most):
        if not open_:
            break
        for d in open_:
            _, count, total = after[d]
            centres[d] = total[count > 0] / count[count > 0][:, None]
        after = _summed(blocks, {d: centres[d] for d in open_}, _round)
        for d in sorted(open_):
            losses[d].append(after[d][0])
            if _settled(losses[d], tolerance):
                open_.discard(d)

    states: dict[str, Densities | np.ndarray] = dict(centres)
    moments = _summed(blocks, states, _moments)
    fits: dict[str, list[float]] = {d: [] for d in index}
    open_ = set(index)
    for _ in range(most):
        if not open_:
            break
        for d in open_:
            states[d] = _mixture(sizes[d], *moments[d][1:])
        moments = _summed(blocks, {d: states[d] for d in open_}, _moments)
        for d in sorted(open_):
            fits[d].append(moments[d][0])
            if _settled(fits[d], tolerance):
                open_.discard(d)
    shared = spark.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, ids, x in _rows(batches):
            roots = _shares(x, shared.value[doc])[0].argmax(1)
            yield pa.RecordBatch.from_pydict({"doc": pa.array([doc] * len(ids)), "char_id": pa.array(ids, pa.int64()), "root": pa.array(roots, pa.int32())})

    return blocks.mapInArrow(run, "doc string, char_id long, root int")
