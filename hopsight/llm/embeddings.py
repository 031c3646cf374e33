"""Near-duplicates of embeddings: spherical k-means cells, blocked cosine products, components.

The cells' centroids are fitted on a bounded sample; all else covers every vector. A vector is stored
once, in its nearest cell. Of a linked pair the one nearer to its centroid is met there by the other, whose
angle to that centroid is larger by the linking angle at most (triangle inequality), so no link is lost.
Nothing is shipped for that: each task holds some cells and reads through all stored vectors. A bound on
the cosine from some leading components leaves few pairs to be computed in full. Vectors within half the
linking angle of a centroid are linked with each other: this core of a cell is counted, not compared,
which keeps a group of copies linear. A block returns counts and one edge per vector, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, cut, discard, read

#: Vectors per cell aimed at, cells at most, sampled vectors per cell to fit them on, sampled vectors at most, and rounds of fitting.
PER_CELL, MAX_CELLS, SAMPLE_PER_CELL, MAX_SAMPLE, FITS = 1024, 16384, 32, 1 << 17, 8
#: Products of a round of fitting at most, so that many cells are fitted in fewer rounds.
FIT_WORK = 1 << 31
#: Components of the vectors that a task holds, that it reads before it compares, and of those in a stored row.
HELD, READ, PACKED = 1 << 23, 1 << 21, 1 << 14
#: Groups of cells that one job goes through; vectors of a cell that are compared at once.
WAVE, BLOCK = 64, 256
#: Leading components that bound a cosine.
LEADING = 23
_EPS = 1e-9


def _margin(dim: int) -> float:
    """More than the error of a product of two vectors of length 1 in single precision."""
    return 1e-5 + dim * 2.0 ** -22


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that large components don't overflow."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the cosine with it."""
    home, best = np.empty(len(x), np.int32), np.empty(len(x), np.float32)
    for i in range(0, len(x), 512):
        near = x[i:i + 512] @ centroids.T
        home[i:i + 512] = at = near.argmax(axis=1)
        best[i:i + 512] = near[np.arange(len(near)), at]
    return home, best


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from the first `cells` of the sample's rows, which come in hash order."""
    sample = sample.astype(np.float32)
    centroids = sample[:cells].copy()
    for _ in range(max(1, min(FITS, FIT_WORK // (len(sample) * cells)))):
        near, _ = _nearest(sample, centroids)
        order = np.argsort(near, kind="stable")
        some, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order].astype(np.float64), first)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids[some] = np.where(length > _EPS, sums / np.maximum(length, _EPS), centroids[some])
    return centroids


def _leading(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns along which the sample varies most."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :LEADING].astype(np.float32)


def _bounding(x: np.ndarray, leading: np.ndarray) -> np.ndarray:
    """Rows whose products are no less than those of the rows of `x`: leading components, and the length of what they leave (a little more)."""
    head = x @ leading
    left = np.maximum(0, 1 - np.einsum("ij,ij->i", head, head)) + np.float32(_margin(x.shape[1]))
    return np.column_stack([head, np.sqrt(left)])


def _deal(counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first group and its number of groups, by the sampled vectors in it: groups of cells in a row, more of them for a large cell."""
    ends = np.cumsum(counts + 1e-3)
    at = (ends - (counts + 1e-3)) / ends[-1] * groups
    first = np.minimum(at.astype(np.int64), groups - 1)
    return first, np.maximum(1, np.minimum(np.ceil(ends / ends[-1] * groups).astype(np.int64), groups) - first)


def _place(centroids: np.ndarray, first: np.ndarray, parts: np.ndarray) -> Callable:
    """Rows (g, n, vids, weights, cells, best, vectors): vectors of a group, packed, with their cell and the cosine with its centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("e")
            raw = values.flatten().to_numpy().reshape(len(values), -1)
            size = max(1, PACKED // raw.shape[1])
            home, best = _nearest(unit(raw).astype(np.float32), centroids)
            vid, weight = batch.column("vid").to_numpy(), batch.column("weight").to_numpy()
            g = first[home] + (vid.view(np.uint64) % parts[home].astype(np.uint64)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            begins = np.flatnonzero(np.diff(g[order], prepend=-1))
            rows = []
            for lo, hi in zip(begins, np.append(begins[1:], len(g)), strict=True):
                for i in range(lo, hi, size):
                    some = order[i:min(i + size, hi)]
                    rows.append((int(g[some[0]]), len(some), *[x[some].tobytes() for x in (vid, weight, home, best, raw)]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["g", "n", "vids", "weights", "cells", "best", "vectors"])
    return run


class Vectors:
    """Packed rows, opened: vectors in the order of their cosine with their centroid."""

    def __init__(self, rows: list[pa.RecordBatch], dim: int, by_cell: bool = False):
        def column(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(x for r in rows for x in r.column(name).to_pylist()), kind)
        vid, weight, cell, best = column("vids", np.int64), column("weights", np.int64), column("cells", np.int32), column("best", np.float32)
        raw = b"".join(x for r in rows for x in r.column("vectors").to_pylist())
        raw = np.frombuffer(raw, np.float64 if len(raw) == 8 * dim * len(vid) else np.float32).reshape(-1, dim)
        order = np.lexsort((vid, best, cell) if by_cell else (vid, best))
        self.vid, self.weight, self.cell, self.best, self.raw = vid[order], weight[order], cell[order], best[order], raw[order]

    def units(self) -> np.ndarray:
        return np.concatenate([unit(self.raw[i:i + 4096]).astype(np.float32) for i in range(0, len(self.raw), 4096)])


def _reach(best: np.ndarray, threshold: float, dim: int) -> np.ndarray:
    """The least cosine with a centroid of what is linked with a vector whose own cosine with it is `best`; margins included."""
    best = np.clip(best.astype(np.float64) - _margin(dim), -1, 1)
    least = best * threshold - np.sqrt(1 - best * best) * math.sqrt(1 - threshold * threshold)
    return (np.where(best <= -threshold, -1, least) - _margin(dim)).astype(np.float32)


def _edges(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest vector that each vector on either side reaches within a block in which all have links."""
    far = np.iinfo(np.int64).max
    top = left.copy()
    while True:
        across = np.minimum(np.where(linked, top[:, None], far).min(axis=0), right)
        new = np.minimum(np.where(linked, across[None, :], far).min(axis=1), top)
        if (new == top).all():
            return top, across
        top = new


def _compare(dim: int, threshold: float, shared: Broadcast) -> Callable:
    """Of the cells of a group, which come first, and all vectors: counts of links and edges (vid, links, edge), and the cells' cores (vid, links as weight, cell)."""
    core = math.sqrt((1 + threshold) / 2) + _margin(dim)
    space = np.empty(2 * BLOCK * BLOCK, np.float32)

    def found(vid: np.ndarray, links: np.ndarray, edge: np.ndarray | None = None, cell: np.ndarray | None = None) -> pa.RecordBatch:
        nothing = lambda kind: pa.nulls(len(vid), kind)
        return pa.RecordBatch.from_arrays([pa.array(vid, pa.int64()), pa.array(links, pa.int64()), nothing(pa.int64()) if edge is None else pa.array(edge, pa.int64()),
                                           nothing(pa.int32()) if cell is None else pa.array(cell, pa.int32())], names=["vid", "links", "edge", "cell"])

    def met(held: Vectors, cells: list, bounds: np.ndarray, links: np.ndarray, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        """All links of the vectors in `rows` with the held ones that are nearer to their centroid."""
        centroids, leading = shared.value
        seen = Vectors(rows, dim)
        x = seen.units()
        bounding, reach, out = _bounding(x, leading), _reach(seen.best, threshold, dim), []
        times = np.zeros(len(x), np.int64)
        for lo in range(0, len(cells), 64):
            some = cells[lo:lo + 64]
            near = centroids[[c for c, _ in some]] @ x.T
            for cosine, (c, blocks) in zip(near, some, strict=True):
                upto = np.searchsorted(seen.best, blocks[-1][3], "right")
                visits = np.flatnonzero(cosine[:upto] >= np.maximum(reach[:upto], blocks[0][4]))
                visits = visits[~((seen.cell[visits] == c) & (seen.best[visits] >= core))]  # a core is linked with itself, and nothing in its cell is nearer
                for begin, end, _, most, least in blocks:
                    here = visits[:np.searchsorted(visits, np.searchsorted(seen.best, most, "right"))]
                    here = here[cosine[here] >= least]
                    if len(here):
                        out += pairs(held, seen, bounds, bounding, here, begin, end, links, times)
        linked = np.flatnonzero(times)
        out.append((seen.vid[linked], times[linked], seen.vid[linked]))
        return found(*map(np.concatenate, zip(*out, strict=True)))

    def pairs(held: Vectors, seen: Vectors, bounds: np.ndarray, bounding: np.ndarray, here: np.ndarray, begin: int, end: int, links: np.ndarray, times: np.ndarray) -> list:
        out = []
        for i in range(0, len(here), 2 * BLOCK):
            some = here[i:i + 2 * BLOCK]
            likely = np.matmul(bounding[some], bounds[begin:end].T, out=space[:len(some) * (end - begin)].reshape(len(some), -1))
            if likely.max() < threshold - _margin(dim):
                continue
            likely = likely >= threshold - _margin(dim)
            at = np.flatnonzero(likely)
            row, col = np.divmod(at, end - begin)
            rows, cols = np.unique(row), np.unique(col)
            a, b = some[rows], begin + cols
            linked = likely[np.ix_(rows, cols)]
            if len(at) * 16 < linked.size:
                row, col = np.searchsorted(rows, row), np.searchsorted(cols, col)
                linked[row, col] = np.einsum("ij,ij->i", unit(seen.raw[a])[row], unit(held.raw[b])[col]) >= threshold
            else:
                linked = unit(seen.raw[a]) @ unit(held.raw[b]).T >= threshold
            own, other = seen.best[a][:, None], held.best[b][None, :]
            linked &= (other > own) | ((other == own) & (held.vid[b][None, :] > seen.vid[a][:, None]))
            rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if len(rows):
                linked, a, b = linked[np.ix_(rows, cols)], a[rows], b[cols]
                times[a] += linked @ held.weight[b]
                links[b] += seen.weight[a] @ linked
                top, across = _edges(linked, seen.vid[a], held.vid[b])
                none = np.zeros(len(a) + len(b), np.int64)
                out.append((np.concatenate([seen.vid[a], held.vid[b]]), none, np.concatenate([top, across])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, held, n = [], [], None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if row.column("own")[0].as_py():
                    if held is not None:
                        raise RuntimeError("the vectors of a group did not come before the others")
                    own.append(row)
                    continue
                if held is None:
                    if not own:
                        return
                    held, own = Vectors(own, dim, by_cell=True), None
                    bounds, links = _bounding(held.units(), shared.value[1]), np.zeros(len(held.vid), np.int64)
                    begins = np.flatnonzero(np.diff(held.cell, prepend=-1))
                    cells = [(int(held.cell[lo]), [(i, j := min(i + BLOCK, hi), held.best[i], held.best[j - 1], _reach(held.best[i:i + 1], threshold, dim)[0])
                                                   for i in range(lo, hi, BLOCK)]) for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(held.vid)], strict=True)]
                    mid = held.best >= core
                    yield found(held.vid[mid], held.weight[mid], cell=held.cell[mid])
                rows.append(row)
                n += row.column("n")[0].as_py()
                if n * dim >= READ:
                    yield met(held, cells, bounds, links, rows)
                    rows, n = [], 0
        if rows:
            yield met(held, cells, bounds, links, rows)
        if held is not None:
            linked = np.flatnonzero(links)
            yield found(held.vid[linked], links[linked], held.vid[linked])
    return run


@contextmanager
def _apart(spark: SparkSession) -> Iterator[None]:
    """A union of tables of one partition each keeps these apart, as tasks of their own, instead of making one of them; packed rows are passed on few at a time."""
    settings = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _links(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(vid, links, edge) rows of distinct vectors `nodes` (vid, weight, e) of one dimension; links are to be summed."""
    spark, n = nodes.sparkSession, nodes.count()
    cells = min(MAX_CELLS, max(1, n // PER_CELL))
    size = min(SAMPLE_PER_CELL * cells, MAX_SAMPLE)
    key, all_keys = F.xxhash64("vid"), 1 << 64
    # a sample in hash order; with so many more expected, the filter leaves too few for it hardly ever, and fewer would do
    upto = min((1 << 63) - 1, int((2 * size + 1000) / n * all_keys) - (1 << 63))
    sample = nodes.filter(key <= upto).orderBy(key, "vid").select("e").limit(size).toArrow().column("e").combine_chunks()
    sample = unit(sample.flatten().to_numpy().reshape(-1, dim))
    centroids, leading = fit_cells(sample, cells), _leading(sample)
    cells = len(centroids)
    groups = max(-(-n * dim // HELD), min(4 * spark.sparkContext.defaultParallelism, cells))
    counts = np.bincount(_nearest(sample.astype(np.float32), centroids)[0], minlength=cells)
    packed = nodes.select("vid", "weight", "e").mapInArrow(
        _place(centroids, *_deal(counts, groups)), "g long, n long, vids binary, weights binary, cells binary, best binary, vectors binary")
    placed = cut(packed.repartition(groups, "g"))
    parts, shared = [], spark.sparkContext.broadcast((centroids, leading))
    with _apart(spark):
        for lo in range(0, groups, WAVE):
            tasks = [placed.filter(F.col("g") == g).withColumn("own", F.lit(True)).unionByName(placed.withColumn("own", F.lit(False))).coalesce(1)
                     .mapInArrow(_compare(dim, threshold, shared), "vid long, links long, edge long, cell int") for g in range(lo, min(lo + WAVE, groups))]
            parts.append(cut(reduce(DataFrame.unionByName, tasks)))
    discard(placed)
    shared.destroy()
    found = reduce(DataFrame.unionByName, parts)
    core = found.filter("cell IS NOT NULL").select("cell", "vid", F.col("links").alias("weight"))
    whole = F.broadcast(core.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("vid").alias("edge")))  # a row a cell
    return found.filter("cell IS NULL").drop("cell").unionByName(
        core.join(whole, "cell").select("vid", (F.col("all") - F.col("weight")).alias("links"), "edge"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is at least `threshold`. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing, nor do vectors of different
    dimension. Equal vectors are one node of several rows, linked with each other. component_id is the
    smallest id reachable by links (null if no row there has an id); kept is vec_id = component_id, and
    true where that is null. Repeated ids are separate rows. An empty table gives no rows; other columns
    are not looked at.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, F.col("embedding")).alias("e"))
             .withColumn("vid", F.when(F.col("e").isNotNull(), F.xxhash64("e"))))
    base = cut(keyed.select("vec_id", "vid"))
    nodes = cut(keyed.filter("vid IS NOT NULL").groupBy("vid").agg(F.count("*").alias("weight"), F.first("e").alias("e")))
    found = None
    for r in nodes.select(F.size("e").alias("dim")).distinct().collect():
        part = _links(nodes.filter(F.size("e") == r["dim"]), r["dim"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    labels = components(found.filter("vid <> edge").select(F.col("vid").alias("u"), F.col("edge").alias("v")).distinct())
    totals = (nodes.select("vid", (F.col("weight") - 1).alias("links")).unionByName(found.select("vid", "links"))
              .groupBy("vid").agg(F.sum("links").alias("n_links")))
    known = (totals.join(labels, F.col("vid") == F.col("node"), "left")
             .select("vid", "n_links", F.coalesce("component", "vid").alias("label")))
    rows = base.select("vec_id", "vid").join(known, "vid", "left")
    least = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("vec_id").alias("component_id"))
    return (rows.join(least, "label", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
