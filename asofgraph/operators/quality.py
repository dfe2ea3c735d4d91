"""Quality operators: stratified samples, completeness, evidence, timing consistency, mention de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_digest(seed: int, *columns: Column) -> Column:
    """sha256 over the seed and the values, null as <NA>, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("<NA>")) for c in columns)), 256)


def stratified_sample(rows: DataFrame, strata: list[str], keys: list[str], size: int, seed: int) -> DataFrame:
    """A repeatable sample with one row for each stratum and the rest by highest averages (n / (seats + 1)).

    With more strata than ``size``, the strata first by seeded digest have one each. Seats are ranked
    in a table of at most strata x size rows; rows inside a stratum by seeded digest of their keys.
    """
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in strata))
    groups = counts.withColumns({"key": text, "groups": F.count("*").over(Window.partitionBy(F.lit(1))), "lot": F.row_number().over(Window.orderBy(seeded_digest(seed, *map(F.col, strata)), "n"))})
    groups = groups.filter((F.col("groups") <= size) | (F.col("lot") <= size))
    more = groups.filter((F.col("n") > 1) & (F.col("groups") < size)).withColumn("j", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - 1, F.lit(size).cast("long")))))
    seats = more.withColumn("seat", F.row_number().over(Window.orderBy(F.desc(F.col("n") / (F.col("j") + 1)), "key", "j"))).filter(F.col("seat") <= size - F.col("groups"))
    given = groups.join(seats.groupBy("key").agg(F.count("*").alias("more")), "key", "left").select(*(F.col(c).alias(f"_{c}") for c in strata), (1 + F.coalesce("more", F.lit(0))).alias("_seats"))
    order = Window.partitionBy(*strata).orderBy(seeded_digest(seed, *map(F.col, keys)), *keys)
    ranked = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)  # a number known beforehand, so that tasks drop later rows before the shuffle
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.join(F.broadcast(given), same).filter("_rank <= _seats").select(*rows.columns)


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows with every column non-blank, and their share."""
    full = F.lit(True)
    for c in columns:
        full = full & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    found = rows.agg(F.count("*").alias("rows"), F.count_if(full).alias("complete"))
    return found.withColumn("rate", F.try_divide("complete", "rows"))


def evidence_support(rows: DataFrame, name: Column, evidence: Column, weight: Column | None = None) -> DataFrame:
    """One row: how many named rows have their normalised name inside their normalised evidence. ``weight`` says for how many rows a row stands."""
    held = F.coalesce(evidence.contains(name), F.lit(False)) & (name != "")
    total = lambda value: F.coalesce(F.sum(value), F.lit(0).cast("long"))
    weight = F.lit(1).cast("long") if weight is None else weight
    found = rows.agg(total(weight).alias("sampled"), total(F.when(held, weight)).alias("supported"))
    return found.withColumn("rate", F.try_divide("supported", "sampled"))


def dedupe_mentions(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with the smallest evidence text; an exposure stays only if all rows that have one agree."""
    one = F.when(F.countDistinct("exposure_share") == 1, F.max("exposure_share"))
    return mentions.groupBy(*keys).agg(F.min("evidence_text").alias("evidence_text"), one.alias("exposure_share"), F.count("*").alias("row_count"))


def timing_mismatches(mentions: DataFrame, documents: DataFrame, columns: list[str]) -> DataFrame:
    """Mentions whose document is unknown or disagrees in any of the columns (null agrees with null)."""
    other = documents.select("source_document_id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_known"))
    joined = mentions.join(other, "source_document_id", "left")
    agree = F.coalesce("_known", F.lit(False))
    for c in columns:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.filter(~agree).select(*mentions.columns)


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that are in one table only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def section_coverage(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: captured documents, those with a section, and their share."""
    have = documents.select("source_document_id").distinct().join(sections.select("source_document_id", F.lit(1).alias("has")).distinct(), "source_document_id", "left")
    return have.agg(F.count("*").alias("captured"), F.count("has").alias("with_section")).withColumn("rate", F.try_divide("with_section", "captured"))
