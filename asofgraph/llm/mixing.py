"""Mixing sources to target weights by capped water-filling.

Sources whose share would pass ``max_epochs`` times their size are clamped there and the excess
goes to the others by weight, until none is above. Each document then enters whole or in part:
all of a source's documents the same number of whole times, and the rest of its target from its
documents in a seeded order, the one at the border with just the words that are missing.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofgraph.llm.common import WORD_PATTERN, materialize, read_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: Documents of a source fall into 16 ** BUCKET_DIGITS seeded buckets; sums over buckets stand for a running sum over all.
BUCKET_DIGITS = 3


def sized_rows(docs: DataFrame, seed: int, *more: F.Column) -> DataFrame:
    """doc_id, source, size, draw, bucket: the seeded order is that of draw, which starts with its bucket.

    draw is a digest of seed, doc_id and text, so rows that share a doc_id, or have none, are spread; only
    rows equal in both draw alike.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = docs.select(*more, "doc_id", "source", size.alias("size"), draw.alias("draw"))
    return rows.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) by water-filling over one row per source.

    A round clamps every open source that its share of what is left would carry past its cap.
    Rounds are aggregates over the source table: the driver sees three numbers a round, however
    many sources there are. The weights repeat over the sources in code point order, null last;
    that order is the one step of a single task, which holds a row a source and no documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = materialize(totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "sources")
    everything = rows.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        at = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))
        ).first()
        if at[2] == clamped or not at[1]:
            break
        clamped = at[2]
        level = (share * everything - at[0]) / at[1]
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _placed(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    """Every row with its source's figures and the words before it in the seeded order.

    Running sums are over seeded buckets first and inside a bucket second, so that a source with
    a third of all rows needs no single task.
    """
    rows = materialize(sized_rows(docs, seed), "sizes")
    targets = source_targets(rows, weights, share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    starts = per.select("source", "bucket", before.alias("start")).withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    within = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    alike = Window.partitionBy("source", "bucket", "draw", "doc_id", "size")  # served by the same exchange and sort
    placed = rows.withColumn("within", within).withColumns({"alike": F.count("*").over(alike), "first": F.min(F.col("within") - F.col("size")).over(alike)})
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.select("doc_id", "source", "size", "bucket", "draw", "alike", (F.col("start") + F.col("first")).alias("before_alike"), (F.col("start") + F.col("within") - F.col("size")).alias("before"))
    targets = targets.withColumnRenamed("source", "t")
    return placed.join(targets, F.col("source").eqNullSafe(F.col("t")))


def _part() -> F.Column:
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))


def _shared_part() -> F.Column:
    """What each of some rows equal in doc_id and size takes if they share what is due to all of them."""
    due = F.greatest(F.lit(0), F.least(F.col("alike") * F.col("size"), F.col("rest") - F.col("before_alike")))
    return F.floor(due / F.col("alike")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    size is the number of words (null text: 0), taken the words the mix takes with repeats, at
    most max_epochs times size; the words taken of a source add up to its target rounded. A null
    source is a source. Repeated rows are rows of their own; ties of the seeded order (equal
    doc_id and text) are rows of equal size, so their order doesn't matter. Empty tables and empty sources give no row and target 0.
    """
    rows = _placed(docs, weights, share, max_epochs, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + _part()).cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS draw FROM documents),
w AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
  CAST(sum(size) * 2 AS DOUBLE) AS cap FROM d GROUP BY source),
l AS (SELECT CAST(0 AS DOUBLE) AS level, CAST(-1 AS BIGINT) AS clamped UNION ALL
  SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - full_cap) / open_weight, k FROM (SELECT clamped,
    (SELECT coalesce(sum(cap), 0) FROM w WHERE cap <= weight * level) AS full_cap, (SELECT coalesce(sum(weight), 0) FROM w WHERE cap > weight * level) AS open_weight,
    (SELECT count(*) FROM w WHERE cap <= weight * level) AS k FROM l) WHERE k <> clamped AND open_weight > 0),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_max(level, clamped) FROM l)) AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""


@F.pandas_udf(T.StringType())
def first_words(text: pd.Series, due: pd.Series) -> pd.Series:
    """Each text up to the end of its due-th word; null stays null."""
    word = re.compile(WORD_PATTERN)
    ends = [t and next(itertools.islice(word.finditer(t), int(n) - 1, None)).end() for t, n in zip(text, due, strict=True)]
    return pd.Series([t[:e] if t else t for t, e in zip(text, ends, strict=True)], dtype=object)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents of the mix: each as often as it is taken, the last time with the words still due.

    Columns are those of ``docs`` (doc_id, text, source and any others; n_chars follows the text); a document
    of which no word is taken goes, one without words stays once. A source's share of the seeded
    order ends at one row, so all that meets the texts is a table of one row a source; rows equal to that one
    in doc_id and text share what is due to them evenly, up to a word a row less.
    """
    rows = _placed(docs, weights, share, max_epochs, seed)
    border = F.max(F.when(F.col("before") < F.col("rest"), F.struct("draw", _shared_part().alias("part"))))
    cuts = materialize(rows.groupBy("source").agg(F.first("whole").alias("whole"), border.alias("border")), "cuts").withColumnRenamed("source", "from")
    held = sized_rows(docs, seed, F.struct(*docs.columns).alias("row")).join(cuts, F.col("source").eqNullSafe(F.col("from")))
    end = F.col("border.draw")
    more = F.when(F.col("border").isNull() | (F.col("draw") > end), 0).when(F.col("draw") == end, F.col("border.part")).otherwise(F.col("size"))
    held = held.withColumn("taken", F.col("whole") * F.col("size") + more).filter("size = 0 OR taken > 0")
    copies = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size"))), lambda k: F.least(F.col("size"), F.col("taken") - (k - 1) * F.col("size")))
    )
    held = held.withColumn("due", F.explode(copies))
    part = F.col("due") < F.col("size")
    text = F.when(part, first_words(F.when(part, F.col("row.text")), F.col("due"))).otherwise(F.col("row.text"))
    held = held.withColumn("new", text)
    changed = {"text": F.col("new"), "n_chars": F.coalesce(F.length("new"), F.lit(0)).cast("long")}
    return held.select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))
