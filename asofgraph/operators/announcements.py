"""Announcement metadata, security masters and alias tables from official sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.functions.names import board_of, clean_date, clean_ticker, clean_title, is_annual_report, period_end, publication_timing
from asofgraph.operators.resolve import MENTION, active_on, alias_history, first_observations

MASTER_COLUMNS = ["security_id", "ticker", "exchange", "company_name", "listing_date", "delisting_date", "board", "source_url"]


def normalize_announcements(raw: DataFrame) -> DataFrame:
    """Annual reports of A shares with typed times. ``raw``: announcement_id, sec_code, org_id, title, announcement_time_ms, url.

    A local midnight stands for a bare date and becomes usable a day later.
    """
    usable, kind = publication_timing(F.col("announcement_time_ms"))
    rows = raw.withColumns({"title": clean_title(F.col("title")), "reported_id": clean_ticker(F.col("sec_code"))})
    rows = rows.filter(is_annual_report(F.col("title")) & board_of(F.col("reported_id")).isNotNull() & (F.col("announcement_time_ms") > 0))
    return rows.select(
        F.col("announcement_id").alias("source_document_id"), "reported_id", "org_id", "title", period_end(F.col("title")).alias("source_period_end"),
        F.timestamp_millis("announcement_time_ms").alias("announced_at"), usable.alias("publication_datetime"), kind.alias("publication_time_precision"), "url")


def dedupe_documents(documents: DataFrame, identity: tuple[str, ...] = ("reported_id", "org_id")) -> tuple[DataFrame, DataFrame]:
    """(newest row of each document, documents whose rows disagree on who they are about)."""
    order = Window.partitionBy("source_document_id").orderBy(F.desc("announced_at"), "url")
    newest = documents.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    differ = documents.groupBy("source_document_id").agg(*(F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in identity))
    return newest, differ.filter(" OR ".join(f"{c} > 1" for c in identity)).select("source_document_id")


def timing_audit(documents: DataFrame, cutoff_hour: int = 15) -> DataFrame:
    """One row of counts: bare dates, exact times, shifted ones, those after the close, and violations of the rule."""
    bare = F.col("publication_time_precision") == "date_only"
    local = F.from_utc_timestamp("announced_at", "Asia/Shanghai")
    return documents.agg(
        F.count("*").alias("documents"), F.count_if(bare).alias("date_only"), F.count_if(~bare).alias("exact"),
        F.count_if(F.col("publication_datetime") > F.col("announced_at")).alias("shifted"), F.count_if(~bare & (F.hour(local) >= cutoff_hour)).alias("after_close"),
        F.count_if((F.col("publication_datetime") < F.col("announced_at")) | bare & (F.col("publication_datetime") == F.col("announced_at"))).alias("violations"))


def unambiguous_map(stock_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(org_id, security_id) pairs, and the codes that belong to several organisations."""
    pairs = stock_map.select("org_id", clean_ticker(F.col("code")).alias("security_id")).filter("security_id IS NOT NULL").distinct()
    return pairs, pairs.groupBy("security_id").agg(F.countDistinct("org_id").alias("organisations")).filter("organisations > 1")


def normalize_master(raw: DataFrame, columns: dict[str, str], exchange: str) -> DataFrame:
    """A source's listing table in the master's columns; ``columns`` names the source's column for each. Other codes go."""
    get = lambda c: F.col(columns[c]) if c in columns else F.lit(None).cast("string")
    ticker = clean_ticker(get("ticker"))
    name = F.regexp_replace(F.trim(get("company_name")), r"\s+", "")
    return raw.select(
        ticker.alias("security_id"), ticker.alias("ticker"), F.lit(exchange).alias("exchange"), F.when(~name.isin("", "-", "nan", "None"), name).alias("company_name"),
        clean_date(get("listing_date")).alias("listing_date"), clean_date(get("delisting_date")).alias("delisting_date"), board_of(ticker).alias("board"), get("source_url").alias("source_url"),
    ).filter("security_id IS NOT NULL AND board IS NOT NULL")


def company_aliases(master: DataFrame, changes: DataFrame, retrieved: str) -> DataFrame:
    """Alias rows: tickers from listing on, names by their history, and today's name from the day it was retrieved unless history says more."""
    rows = lambda df, kind: df.select("security_id", "alias", F.lit(kind).alias("alias_type"), "valid_from", "valid_to")
    tickers = rows(master.select("security_id", F.col("ticker").alias("alias"), F.col("listing_date").alias("valid_from"), F.col("delisting_date").alias("valid_to")), "ticker")
    history = rows(alias_history(changes, master), "historical_name")
    today = rows(master.select("security_id", F.col("company_name").alias("alias"), F.lit(retrieved).cast("date").alias("valid_from"), F.col("delisting_date").alias("valid_to")).filter("alias IS NOT NULL"), "current_name")
    return tickers.union(history).union(today.join(history.select("security_id", "alias"), ["security_id", "alias"], "left_anti").select(*tickers.columns))


def enrich_aliases(aliases: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases with short names from their first publication on, keys that would then be there twice with different ends)."""
    seen = first_observations(documents.select("security_id", "short_name", "publication_datetime").filter("security_id IS NOT NULL AND trim(short_name) <> ''"))
    fresh = seen.select("security_id", F.col("short_name").alias("alias"), F.lit("observed_short_name").alias("alias_type"), F.to_date(F.from_utc_timestamp("first_seen", "Asia/Shanghai")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    known = aliases.select("security_id", "alias").distinct()
    both = aliases.union(fresh.join(known, ["security_id", "alias"], "left_anti").select(*aliases.columns))
    return both, both.groupBy("security_id", "alias", "valid_from").agg(F.countDistinct(F.coalesce(F.col("valid_to").cast("string"), F.lit("\0"))).alias("n")).filter("n > 1").drop("n")


def replay_exact(audit: DataFrame, mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact resolutions that the alias rows of their day don't bear out: none, several or another entity."""
    day = mentions.groupBy(*MENTION).agg(F.min(F.to_date(F.from_utc_timestamp("publication_datetime", "Asia/Shanghai"))).alias("day"))
    exact = audit.filter("resolution_method = 'exact_alias'").join(day, MENTION)
    valid = exact.join(aliases.select("normalized_name", "entity_id", "valid_from", "valid_to"), "normalized_name", "left").withColumn("hit", F.coalesce(active_on(F.col("day")) & F.col("entity_id").isNotNull(), F.lit(False)))
    found = valid.groupBy(*MENTION, "resolved_entity_id").agg(F.countDistinct(F.when(F.col("hit"), F.col("entity_id"))).alias("entities"), F.min(F.when(F.col("hit"), F.col("entity_id"))).alias("entity_id"))
    return found.filter((F.col("entities") != 1) | (F.col("entity_id") != F.col("resolved_entity_id"))).select(*MENTION, "resolved_entity_id", "entities")


def name_boundary(audit: DataFrame) -> DataFrame:
    """(check, actual): audit rows whose class, method and status contradict each other."""
    resolved = F.col("resolution_status") == "resolved"
    checks = {
        "resolved_without_entity": resolved & F.col("resolved_entity_id").isNull(), "entity_without_resolution": ~resolved & F.col("resolved_entity_id").isNotNull(),
        "anonymous_resolved": (F.col("name_class") == "anonymous") & resolved, "named_blocked": (F.col("name_class") == "named") & (F.col("resolution_method") == "blocked_anonymous"),
        "exact_with_many_candidates": (F.col("resolution_method") == "exact_alias") & (F.col("candidate_count") != 1), "confidence_out_of_range": ~F.col("resolution_confidence").between(0, 1),
        "unresolved_with_confidence": ~resolved & (F.col("resolution_confidence") > 0)}
    return audit.agg(*(F.count_if(c).alias(n) for n, c in checks.items())).unpivot([], list(checks), "check", "actual")
