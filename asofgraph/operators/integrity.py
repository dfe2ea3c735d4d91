"""Counters of names, exposures and endpoints that must not exist, in the form (check, actual) of ``graph.integrity``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofgraph.functions.clock import local_day
from asofgraph.functions.names import classify_name, normalize_name
from asofgraph.operators.graph import PAIR, endpoint_check

#: Which methods may go with each status of a named counterparty.
METHODS = {
    "resolved": ("exact_alias", "deterministic_identifier", "high_confidence_fuzzy", "manual_override"),
    "ambiguous": ("exact_alias_collision",),
    "unresolved": ("none",),
}
BLOCKED = ("anonymous", "blocked_anonymous")


def _long(counts: DataFrame) -> DataFrame:
    return counts.unpivot([], counts.columns, "check", "actual")


def _given(value: str | Column) -> Column:
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return text.isNotNull() & (F.trim(text) != "")


def _consistent(audit: DataFrame, kind: Column, ascii_only: bool) -> Column:
    """What status, method, id and normalized name of an audit row have to be, given the class of its name; columns that aren't there aren't asked for."""
    status, found = F.coalesce(F.col("resolution_status"), F.lit("")), _given("resolved_entity_id")
    blocked, named = (status == BLOCKED[0]) & ~found, status.isin(*METHODS) & (found == (status == "resolved"))
    if "resolution_method" in audit.columns:
        method = F.coalesce(F.col("resolution_method"), F.lit(""))
        blocked &= method == BLOCKED[1]
        for name, allowed in METHODS.items():
            named &= (status != name) | method.isin(*allowed)
    if "normalized_name" in audit.columns:
        blocked &= ~_given("normalized_name")
        named &= F.col("normalized_name").eqNullSafe(normalize_name(F.col("counterparty_raw_name"), ascii_only))
    return F.when(kind == "anonymous", blocked).when(kind == "named", named).otherwise(True)


def name_counters(mentions: DataFrame, audit: DataFrame, ascii_only: bool = False) -> DataFrame:
    """invalid_mention_names, invalid_audit_names, status_against_name and anonymous_nodes (distinct ids that anonymous names were resolved to).

    Null and empty names are invalid; an invalid name is counted as such and not held against its status.
    Repeated rows count each. Empty tables give zeros.
    """
    kind = lambda: classify_name(F.col("counterparty_raw_name"), ascii_only)
    bad = mentions.select(kind().alias("_kind")).agg(F.count_if(F.col("_kind") == "invalid").alias("invalid_mention_names"))
    seen = audit.withColumn("_kind", kind()).withColumn("_good", _consistent(audit, F.col("_kind"), ascii_only))
    hidden = F.when((F.col("_kind") == "anonymous") & _given("resolved_entity_id"), F.col("resolved_entity_id"))
    rows = seen.agg(
        F.count_if(F.col("_kind") == "invalid").alias("invalid_audit_names"), F.count_if(~F.col("_good")).alias("status_against_name"),
        F.countDistinct(hidden).alias("anonymous_nodes"))
    return _long(bad.crossJoin(rows))


def exposure_counters(edges: DataFrame, exposures: DataFrame, master: DataFrame, when: str = "year") -> DataFrame:
    """repeated_exposures, endpoints_outside_master and endpoints_without_listing.

    ``exposures`` are the pairs that count at each ``when``; all but one row of a pair there are repeated.
    """
    extra = exposures.groupBy(when, *PAIR).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_exposures"))
    ends = endpoint_check(edges, master).select(F.col("absent").alias("endpoints_outside_master"), F.col("unlisted").alias("endpoints_without_listing"))
    return _long(extra.crossJoin(ends))


def repeated_evidence(edges: DataFrame) -> DataFrame:
    """One row, reported and not judged: evidence rows beyond the first of a pair and market day; rows without a start don't count."""
    days = edges.filter("effective_start IS NOT NULL").groupBy(*PAIR, local_day(F.col("effective_start")).alias("day")).count()
    return _long(days.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_evidence")))
