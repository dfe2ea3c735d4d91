"""Nearest neighbours by collision counting over single projections.

Vectors, at unit length, are dealt to the cell of their nearest centre, and cells to blocks. A block
keeps one sorted array for each of ``PROJECTIONS`` random projections. A query opens a window around its
own projection in every array, counts how often each vector falls into a window, and widens all
windows at once (virtual rehashing: a bucket ``GROWTH`` times as wide, centred on the query). Vectors
in ``COLLISIONS`` of the windows are verified by exact cosine. The windows stop once they are
so wide that a vector as near as the k-th verified one would have been verified with probability
``CERTAINTY``: vectors with near neighbours stop at narrow windows.

A query first asks the blocks of its own cell. Its k-th score there then rules out every cell whose
vectors lie, by the triangle inequality of angles, all further away; only blocks of the others are asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofgraph.llm.common import give_back, materialize, read_table
from asofgraph.llm.vectors import matrix, norms, prepared

PROJECTIONS = 128
#: Share of the windows that a vector has to be in.
COLLISIONS = 0.6
#: Half the first window of a query that knows no distance yet, for vectors of unit length.
FIRST_WIDTH = 0.1
GROWTH = 1.5
#: The windows grow by less as soon as k vectors have this share of the collisions needed.
NEARLY = 0.7
SMALL_GROWTH = 1.1
#: Probability with which a vector as near as the k-th verified one is verified before the windows stop.
CERTAINTY = 0.95
#: Vectors of a block; a task holds one block and its queries.
BLOCK = 8192
#: Cells at most, a sample of so many vectors; beyond, cells have several blocks.
MOST_CELLS = 4096
SEED = 29
#: Added to angles that are compared, for what rounding may do to them.
SLACK = 1e-6


def width_per_distance(projections: int = PROJECTIONS, need: float = COLLISIONS, certainty: float = CERTAINTY) -> float:
    """Half a window, for distance 1, in which a vector collides often enough with probability ``certainty``.

    Projections of two vectors at distance d differ by a normal with deviation d.
    """
    normal, least = NormalDist(), int(np.ceil(need * projections))
    z = normal.inv_cdf(certainty)
    low, high = need, 1 - 1e-9
    for _ in range(60):
        p = (low + high) / 2
        low, high = (low, p) if projections * p - z * (projections * p * (1 - p)) ** 0.5 >= least else (p, high)
    return normal.inv_cdf((1 + high) / 2)


class Index:
    """Sorted projections of one block."""

    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS):
        self.x, self.norm, self.m = x, norms(x), projections
        self.lines = np.random.default_rng((SEED, x.shape[1])).standard_normal((x.shape[1], projections))
        values = np.ascontiguousarray(((x / self.norm[:, None]) @ self.lines).T)
        order = values.argsort(axis=1, kind="stable")
        #: All arrays end to end, each moved by more than any projection is long, so that one search serves all.
        self.span = 4 * float(np.abs(values).max() + np.sqrt((self.lines**2).sum(0)).max() + 1)
        self.shift = np.arange(projections) * self.span
        self.sorted = (np.take_along_axis(values, order, 1) + self.shift[:, None]).ravel()
        self.order = order.ravel()
        self.need, self.ratio = int(np.ceil(COLLISIONS * projections)), width_per_distance(projections)
        self.verified = self.asked = 0  # for measurements

    def nearest(self, query: np.ndarray, own: np.ndarray, k: int, known: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k best verified, by cosine then by place; ``own`` marks rows to leave out.

        ``known`` is a cosine below which nothing is of interest: windows stop for it at the latest.
        """
        length = np.sqrt((query * query).sum())
        at = (query / length) @ self.lines + self.shift
        n = len(self.x)
        count, done = np.zeros(n, np.int64), own.copy()
        low = high = np.searchsorted(self.sorted, at)
        edge = np.sqrt(max(0.0, 2 - 2 * known)) if known > -1 else np.inf
        place, score = np.empty(0, np.int64), np.empty(0)
        half = FIRST_WIDTH if edge == np.inf else max(self.ratio * edge, 1e-9)
        while True:
            half = min(half, self.span / 2)
            to_low, to_high = np.searchsorted(self.sorted, at - half), np.searchsorted(self.sorted, at + half, "right")
            new = [self.order[a:b] for a, b in zip(to_low, low, strict=True) if a < b] + [self.order[a:b] for a, b in zip(high, to_high, strict=True) if a < b]
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            low, high = to_low, to_high
            fresh = np.flatnonzero((count >= self.need) & ~done)
            if len(fresh):
                done[fresh] = True
                place = np.concatenate((place, fresh))
                score = np.concatenate((score, (self.x[fresh] * query).sum(1) / (self.norm[fresh] * length)))
                self.verified += len(fresh)
                best = np.lexsort((place, -score))[:k]
                place, score = place[best], score[best]
            if len(place) == k:
                edge = min(edge, np.sqrt(max(0.0, 2 - 2 * score[-1])))
            if half >= self.ratio * edge or half >= self.span / 2:
                break
            soon = n > k and np.partition(count, n - k)[n - k] >= NEARLY * self.need
            half = min(half * (SMALL_GROWTH if soon else GROWTH), self.ratio * edge)
        self.asked += 1
        return place, score


_FOUND = "query_id long, vec_id long, score double"


def _search(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if data.num_rows and queries.num_rows:
            data = data.sort_by("vec_id")  # so that ties go to the smaller identifier
            ids, asked, known = data["vec_id"].to_numpy(), queries["query_id"].to_numpy(), queries["known"].to_numpy()
            index = Index(matrix(data["embedding"]))
            for q, vector, least in zip(asked, matrix(queries["embedding"]), known, strict=True):
                place, score = index.nearest(vector, ids == q, k, least)
                for column, values in zip(out, (np.full(len(place), q), ids[place], score), strict=True):
                    column.append(values)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))
    return run


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((x / norms(x)[:, None]) @ centres.T, -1, 1))


def _by_dimension(act, schema_names: list[str]):
    """Runs ``act`` on the rows of each dimension of a batch; vectors need not be of equal length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                yield from (pa.RecordBatch.from_arrays(columns, names=schema_names) for columns in act(dim, batch.filter(pa.array(dims == dim))))
        give_back()
    return run


def _cells(centres: dict[int, np.ndarray]):
    def act(dim: int, batch: pa.RecordBatch) -> Iterator[list]:
        cell, angle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        if dim in centres:
            for a in range(0, batch.num_rows, 4096):
                found = angles(matrix(batch["embedding"][a:a + 4096]), centres[dim])
                cell[a:a + 4096], angle[a:a + 4096] = found.argmin(1), found.min(1)
        yield [batch["dim"], batch["vec_id"], batch["embedding"], pa.array(cell), pa.array(angle)]
    return _by_dimension(act, ["dim", "vec_id", "embedding", "cell", "angle"])


_ROUTED = "dim int, cell long, block int, query_id long, known double, embedding array<float>"


def _routes(centres: dict[int, np.ndarray], cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool):
    """Queries with each block to ask. cells: cell, radius and number of blocks of each cell with vectors, by dimension.

    The first time that is the nearest cell; then every other that may have something nearer than ``known``.
    """
    def act(dim: int, batch: pa.RecordBatch) -> Iterator[list]:
        if dim not in cells:
            return
        cell, radius, blocks = cells[dim]
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            away = angles(matrix(part["embedding"]), centres[dim][cell]) if dim in centres else np.zeros((part.num_rows, 1))
            nearest = away == away.min(1)[:, None]
            nearest &= np.cumsum(nearest, 1) == 1
            known = part["known"].to_numpy(zero_copy_only=False)
            chosen = nearest if first else ~nearest & (away - radius <= np.arccos(np.clip(known, -1, 1))[:, None] + SLACK)
            row, place = np.nonzero(chosen)
            again = blocks[place]
            block = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            row, place = pa.array(np.repeat(row, again)), np.repeat(place, again)
            yield [part["dim"].take(row), pa.array(cell[place]), pa.array(block.astype(np.int32)), part["vec_id"].take(row), part["known"].take(row), part["embedding"].take(row)]
    return _by_dimension(act, _ROUTED_NAMES)


_ROUTED_NAMES = [c.split()[0] for c in _ROUTED.split(", ")]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, most_cells: int = MOST_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for each row of ``queries``.

    Both have vec_id and embedding (array of float); other columns are ignored. A row is no
    candidate for a query of its own vec_id. Null, zero and non-finite vectors take no part, on
    either side; vectors of another dimension aren't compared. Ties go to the smaller vec_id, and
    fewer than k candidates give fewer rows. vec_id is unique; repeated rows are candidates each.

    Vectors stay in their block and queries travel: to the blocks of their own cell, then to those
    that can't be ruled out, each time in tasks of bounded memory that return k rows a query. The centres
    are a sample; the driver sees them, and a row a cell and a dimension.
    """
    spark = vectors.sparkSession
    data, asked = (prepared(side.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("vec_id IS NOT NULL")) for side in (vectors, queries))
    centres = {}
    for r in data.groupBy("dim").count().filter(F.col("count") > block).collect():
        sample = data.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(min(most_cells, -(-r["count"] // block)))
        x = np.array([s.embedding for s in sample.select("embedding").collect()], np.float64)
        centres[r["dim"]] = x / norms(x)[:, None]
    placed = materialize(data.select("dim", "vec_id", "embedding").mapInArrow(_cells(centres), "dim int, vec_id long, embedding array<float>, cell long, angle double"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("angle").alias("radius")).orderBy("dim", "cell").collect()
    cells = {d: tuple(np.array([s[c] for s in sizes if s["dim"] == d]) for c in ("cell", "radius", "blocks")) for d in {s["dim"] for s in sizes}}
    blocks = spark.createDataFrame([(s["dim"], s["cell"], s["blocks"]) for s in sizes], "dim int, cell long, blocks int")
    keys = ["dim", "cell", "block"]
    dealt = placed.join(blocks, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "embedding")

    def ask(rows: DataFrame, first: bool) -> DataFrame:
        routed = rows.mapInArrow(_routes(centres, cells, first), _ROUTED)
        return dealt.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(_search(k), _FOUND)

    asked = asked.select("dim", "vec_id", "embedding")
    found = ask(asked.withColumn("known", F.lit(-2.0)), True)
    if any(len(cell) > 1 for cell, _, _ in cells.values()):
        found = materialize(_ranked(found, k).drop("rank"), "found")
        known = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("known"))
        asked = asked.join(known, F.col("vec_id") == F.col("query_id"), "left").select("dim", "vec_id", "embedding", F.coalesce("known", F.lit(-2.0)).alias("known"))
        found = found.union(ask(asked, False))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))
