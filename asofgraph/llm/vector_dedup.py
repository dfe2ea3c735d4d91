"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` pivots in order of nearness. Inverted lists, one for each
label and pivot, bring vectors together; a pair is looked at in the list of the first pivot that
both have, if they share ``SHARED`` pivots or more, and verified by exact cosine. The number of pivots
grows with the vectors; where it ends to grow, there is a list for each pair of pivots instead, which are
as many as its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import components, local_roots, materialize, read_table
from asofgraph.llm.vectors import matrix, norms, usable

PIVOTS = 64
#: One pivot for so many distinct vectors, from PIVOTS to MOST_PIVOTS of them; the sample that fits the index.
#: Beyond MOST_PIVOTS times as many vectors, lists are of pairs of pivots.
VECTORS_A_PIVOT = 4000
MOST_PIVOTS = 16384
NEAREST = 8
SHARED = 2
LEAST_COSINE = 0.93
#: Members of a block of a long list.
BLOCK = 4096


def _describe(pivots: np.ndarray, nearest: int, together: int):
    """Rows of one list each: the vector goes into the lists of its nearest pivots of its dimension, or of all pairs of them."""
    combined = np.array(list(combinations(range(nearest), together)), np.int64).reshape(-1, together)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(np.asarray(batch["embedding"].offsets))
            for dim in np.unique(lengths):
                some = batch.filter(pa.array(lengths == dim))
                for a in range(0, some.num_rows, 512):
                    part = some.slice(a, 512)
                    x = matrix(part["embedding"])
                    if dim == pivots.shape[1]:
                        near = -(x @ pivots.T) / norms(x)[:, None]
                        chosen = np.argpartition(near, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(nearest), (len(x), 1))
                        chosen = np.take_along_axis(chosen, np.argsort(np.take_along_axis(near, chosen, 1), axis=1, kind="stable"), 1)
                        lists = np.sort(chosen, 1)[:, combined]  # vectors x lists x pivots of a list
                        key = (lists * len(pivots) ** np.arange(together)[::-1]).sum(2)
                    else:  # no pivot has this dimension: one list of its own
                        chosen = key = np.full((len(x), 1), -int(dim))
                    row = pa.array(np.repeat(np.arange(len(x)), key.shape[1]))
                    order = pa.FixedSizeListArray.from_arrays(pa.array(chosen.ravel().astype(np.int32)), chosen.shape[1]).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [part[c].take(row) for c in ("label", "rep", "n", "embedding")] + [order.take(row), pa.array(key.ravel().astype(np.int64))],
                        names=["label", "rep", "n", "embedding", "pivots", "list"],
                    )
    return run


def shared_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` has in common with each row of ``b``."""
    most = int(max(a.max(), b.max())) + 1
    if most <= 512:
        has = [np.zeros((len(x), most), np.float32) for x in (a, b)]
        for h, x in zip(has, (a, b), strict=True):
            np.put_along_axis(h, x, 1, 1)
        return has[0] @ has[1].T
    out = np.zeros((len(a), len(b)), np.int8)
    for column in a.T:
        for other in b.T:
            out += column[:, None] == other[None]
    return out


def first_shared(a: np.ndarray, b: np.ndarray, together: int, pivots: int) -> np.ndarray:
    """The list of the first pivots that the rows of ``a`` and ``b``, pair by pair, have in common."""
    both = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(2), a, pivots), 1)[:, :together].astype(np.int64)
    return (both * pivots ** np.arange(together)[::-1]).sum(1)


_LINKED = "rep long, links long, other long"


def _verify(least: float, shared: int, together: int, pivots: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        own_list, low, high = (k.as_py() for k in key[1:])
        table = table.sort_by("rep")
        rep, n, block = (table[c].to_numpy() for c in ("rep", "n", "block"))
        x = matrix(table["embedding"])
        unit = x / norms(x)[:, None]
        orders = np.array(table["pivots"].to_pylist())
        root, links = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        right = np.flatnonzero(block == high)
        left = right if low == high else np.flatnonzero(block == low)
        for a in range(0, len(left), 512):
            own = left[a:a + 512]
            good = unit[own] @ unit[right].T
            near = np.abs(good - least) < 1e-9
            good = good >= least
            for i, j in zip(*np.nonzero(near), strict=True):  # at the border, by the plain sum
                p, q = x[own[i]], x[right[j]]
                good[i, j] = (p * q).sum() / (np.sqrt((p * p).sum()) * np.sqrt((q * q).sum())) >= least
            if own_list >= 0 and good.any():
                good &= shared_pivots(orders[own], orders[right]) >= shared
            if low == high:
                good &= own[:, None] < right[None]
            i, j = np.nonzero(good)
            i, j = own[i], right[j]
            if own_list >= 0 and len(i):
                here = first_shared(orders[i], orders[j], together, pivots) == own_list
                i, j = i[here], j[here]
            links += np.bincount(i, n[j], len(rep)).astype(np.int64) + np.bincount(j, n[i], len(rep)).astype(np.int64)
            root = local_roots(len(rep), np.concatenate((np.arange(len(rep)), i)), np.concatenate((root, j)))
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "other": rep[root[some]]})
    return run


def vector_components(vectors: DataFrame, least: float = LEAST_COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine is ``least`` or more. A null label and
    a null, zero or non-finite vector link with nothing: n_links 0, component_id their own vec_id.
    Equal vectors of a label are one class with a count, so thousands of copies are compared once
    and each still counts as a link. Vectors of another dimension than the pivots (that of the
    sampled vectors) share one list a label and dimension. Long lists are cut into pairs of
    blocks. Repeated vec_ids are rows of their own. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    valid = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.withColumn("a", F.when(valid, F.xxhash64("label", "embedding"))).withColumn("b", F.when(valid, F.xxhash64(F.lit(7), "embedding", "label")))
    classes = materialize(
        keyed.filter("a IS NOT NULL").groupBy("a", "b").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "classes")
    total = classes.count()
    number = max(PIVOTS, min(MOST_PIVOTS, total // VECTORS_A_PIVOT))
    sample = classes.orderBy(F.xxhash64(F.lit(3), "rep"), "rep").limit(number).select("embedding").collect()
    dims = [len(r.embedding) for r in sample]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    pivots = np.array([r.embedding for r in sample if len(r.embedding) == dim], np.float64).reshape(-1, max(dim, 1))
    pivots /= norms(pivots)[:, None]
    shared, nearest = min(shared, max(1, len(pivots))), min(nearest, max(1, len(pivots)))
    together = 2 if total > MOST_PIVOTS * VECTORS_A_PIVOT and shared > 1 else 1
    schema = "label long, rep long, n long, embedding array<float>, pivots array<int>, list long"
    lists = classes.select("label", "rep", "n", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(_describe(pivots, nearest, together), schema)
    counts = lists.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    split = lists.join(counts, ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = split.withColumn("with", other).select("*", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    dealt = dealt.select("label", "list", "low", "high", "block", "rep", "n", "embedding", "pivots")
    linked = materialize(dealt.groupBy("label", "list", "low", "high").applyInArrow(_verify(least, shared, together, max(1, len(pivots))), _LINKED), "linked")
    parts = components(linked.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("a", "b", "rep", "n").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = keyed.select("vec_id", "a", "b").join(known, ["a", "b"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
