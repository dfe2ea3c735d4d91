"""Resolution of counterparty names against validity-dated aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.functions.clock import local_day
from asofgraph.functions.names import classify_name, may_reach, normalize_name, similarity
from asofgraph.operators.intervals import islands
from asofgraph.operators.refusals import refuse_rows, settled, unless

MENTION = ["source_document_id", "source_company_id", "counterparty_raw_name"]
#: What the audit notes for each method.
NOTES = {
    "invalid": "invalid_name", "blocked_anonymous": "anonymous_label_blocked_by_rule", "exact_alias": "exact_alias_valid_at_publication",
    "high_confidence_fuzzy": "score_and_uniqueness_margin_passed", "manual_override": "version_controlled_manual_override",
    "exact_alias_collision": "ambiguous_exact_alias_not_auto_resolved", "none": "no_reproducible_candidate_passed_thresholds",
}


def active_on(day: Column) -> Column:
    """Alias validity [from, to) on a day; a null bound is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


#: Days count from 0001-01-01, so that years 1 to 9999 are whole numbers below 2 ** LEVELS.
LEVELS, FIRST_DAY = 22, 719_162


def _day_number(day: Column) -> Column:
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.least(F.unix_date(day) + FIRST_DAY, F.lit((1 << LEVELS) - 1))))


def _blocks(low: Column, high: Column) -> Column:
    """The days [low, high) as disjoint blocks (level, block) of 2 ** level days, at most two a level."""
    found = []
    for k in range(LEVELS + 1):
        a, b = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high, k)
        found += [F.when((a < b) & (at % 2 == 1), F.struct(F.lit(k).alias("level"), block.alias("block"))) for at, block in ((a, a), (b, b - 1))]
    return F.array_compact(F.array(*found))


def _alias_changes(aliases: DataFrame) -> DataFrame:
    """(normalized_name, at, state): for each day on which the valid aliases of a name change, how many entities have it from then on and the least of them.

    Validity becomes blocks of days, and a day looks up the one block of each level that it lies in, so no day meets
    every alias of its name: rows stay within a constant of the aliases, however many share a name.
    """
    low, high = F.coalesce(_day_number(F.col("valid_from")), F.lit(0)), F.coalesce(_day_number(F.col("valid_to")), F.lit(1 << LEVELS))
    own = islands(aliases.select("normalized_name", "entity_id", low.alias("low"), high.alias("high")).filter("normalized_name IS NOT NULL").distinct(), ["normalized_name", "entity_id"], "low", "high")
    spans = own.groupBy("normalized_name", "low", "high").agg(F.count("entity_id").alias("n"), F.min("entity_id").alias("least"))
    blocks = spans.select("normalized_name", "n", "least", F.inline(_blocks(F.col("low"), F.col("high")))).groupBy("normalized_name", "level", "block").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    changes = spans.select("normalized_name", F.explode(F.array("low", "high")).alias("at")).filter(F.col("at") < 1 << LEVELS).distinct()
    asked = changes.select("normalized_name", "at", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("at", k).alias("block")) for k in range(LEVELS + 1)))).alias("b")).select("normalized_name", "at", "b.*")
    held = asked.join(blocks, ["normalized_name", "level", "block"]).groupBy("normalized_name", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    none = changes.select("normalized_name", "at", F.lit(None).cast("long").alias("n"), F.lit(None).cast(aliases.schema["entity_id"].dataType).alias("least"))
    return held.union(none).groupBy("normalized_name", "at").agg(F.struct(F.max("n").alias("n"), F.min("least").alias("least")).alias("state"))


def alias_candidates(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each (normalized_name, day): how many entities have an alias of that name valid then, and the least of them.

    A day takes the state of its name's last change up to it; the window holds the distinct days and changes of one name.
    """
    days = names.select("normalized_name", "day").filter("day IS NOT NULL AND normalized_name IS NOT NULL").distinct().select("normalized_name", "day", _day_number(F.col("day")).alias("at"), F.lit(True).alias("asked"))
    changes = _alias_changes(aliases).select("normalized_name", "at", "state", F.lit(False).alias("asked"))
    past = Window.partitionBy("normalized_name").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    both = changes.unionByName(days, allowMissingColumns=True).withColumn("state", F.last("state", ignorenulls=True).over(past))
    return both.filter("asked AND state.n IS NOT NULL").select("normalized_name", "day", F.col("state.n").alias("candidate_count"), F.col("state.least").alias("entity_id"))


def _rarest_characters(name: Column, least: int) -> Column:
    """The first characters, with occurrence number, of a name's multiset in a fixed order.

    Names of similarity ``least`` or more share least % of their mean length as characters, so
    they share one of these.
    """
    letters = F.split(name, "")
    marked = F.transform(letters, lambda c, i: F.xxhash64(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c))))
    share = least / (200 - least)
    return F.slice(F.array_sort(marked), F.lit(1), (F.length(name) - F.ceil(F.length(name) * share) + 1).cast("int"))


def similar_names(names: DataFrame, others: DataFrame, least: int) -> DataFrame:
    """(name, other, score) for all pairs of distinct names with a score of ``least`` or more.

    Pairs meet on a shared rare character, are cut by length and bounded edit distance in the JVM,
    and only what is left is scored in Python. No pair is lost: each filter is implied by the score.
    """
    own = names.select(F.col("name")).distinct().filter("name <> ''").withColumn("mark", F.explode(F.array_distinct(_rarest_characters(F.col("name"), least))))
    theirs = others.select(F.col("name").alias("other")).distinct().filter("other <> ''").withColumn("mark", F.explode(F.array_distinct(_rarest_characters(F.col("other"), least))))
    pairs = own.join(theirs, "mark").filter(may_reach(F.col("name"), F.col("other"), least)).select("name", "other").distinct()
    return pairs.withColumn("score", similarity("name", "other")).filter(F.col("score") >= least)


def fuzzy_best(names: DataFrame, aliases: DataFrame, least: int = 94, margin: int = 4) -> DataFrame:
    """For each (normalized_name, day): best alias, its score, the second score and the entity if it is one.

    Only aliases valid on the day compete; ties go to the alias last in order, and a second score
    below least - margin counts as 0.
    """
    pairs = similar_names(names.select(F.col("normalized_name").alias("name")), aliases.select(F.col("normalized_name").alias("name")), least - margin)
    days = names.select("normalized_name", "day").distinct().join(pairs.withColumnRenamed("name", "normalized_name"), "normalized_name")
    valid = alias_candidates(days.select(F.col("other").alias("normalized_name"), "day"), aliases).select(F.col("normalized_name").alias("other"), "day", F.col("candidate_count").alias("entities"), "entity_id")
    per = days.join(valid, ["other", "day"])
    order = Window.partitionBy("normalized_name", "day").orderBy(F.desc("score"), F.desc("other"))
    ranked = per.withColumns({"rank": F.row_number().over(order), "second_score": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).filter("rank = 1")
    good = (F.col("score") >= least) & (F.col("score") - F.col("second_score") >= margin) & (F.col("entities") == 1)
    return ranked.select("normalized_name", "day", F.col("other").alias("best_alias"), "score", "second_score", F.when(good, F.col("entity_id")).alias("fuzzy_entity_id"))


def resolve(mentions: DataFrame, aliases: DataFrame, overrides: DataFrame | None = None, least: int = 94, margin: int = 4, fuzzy: bool = True, ascii_only: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One audit row a mention key: entity, method, confidence, status, candidate count and note.

    The ladder: anonymous names are blocked, then a unique exact alias, then a fuzzy one, then a
    manual override; several exact candidates stay ambiguous and the rest unresolved. Invalid
    names are reported as such. Everything is decided as of the publication day in the market's zone, once for each
    raw name and day, however many mentions share them. ``keep`` may store that table of decisions, so that its size is known.
    """
    keys = mentions.groupBy(*MENTION).agg(F.min(local_day(F.col("publication_datetime"))).alias("day"))
    asked = settled(mentions.select("counterparty_raw_name", local_day(F.col("publication_datetime")).alias("day")).distinct())
    rows = asked.withColumns({"normalized_name": normalize_name(F.col("counterparty_raw_name"), ascii_only), "name_class": classify_name(F.col("counterparty_raw_name"), ascii_only)})
    known = aliases.withColumn("normalized_name", normalize_name(F.col("alias"), ascii_only))
    named = rows.filter("name_class = 'named'")
    rows = rows.join(alias_candidates(named, known), ["normalized_name", "day"], "left")
    exact, close = F.col("candidate_count") == 1, F.lit(False)
    if fuzzy:
        rows = rows.join(fuzzy_best(named, known, least, margin), ["normalized_name", "day"], "left")
        close = F.col("fuzzy_entity_id").isNotNull()
    manual = F.lit(False)
    if overrides is not None:
        only = unless(F.count("*") > 1, F.min("entity_id"), "an override is given twice:", F.col("normalized_name"))
        rows = rows.join(overrides.groupBy("normalized_name").agg(only.alias("override_id")), "normalized_name", "left")
        manual = F.col("override_id").isNotNull()
    steps = [
        (F.col("name_class") == "invalid", "invalid", None, "invalid_name", None), (F.col("name_class") == "anonymous", "blocked_anonymous", None, "anonymous", None),
        (exact, "exact_alias", F.col("entity_id"), "resolved", F.lit(1.0)),
        *([(close, "high_confidence_fuzzy", F.col("fuzzy_entity_id"), "resolved", F.col("score") / 100)] if fuzzy else []),
        *([(manual, "manual_override", F.col("override_id"), "resolved", F.lit(1.0))] if overrides is not None else []),
        (F.col("candidate_count") > 1, "exact_alias_collision", None, "ambiguous", None)]
    method, entity, status, sure, notes = F.lit("none"), F.lit(None), F.lit("unresolved"), F.lit(0.0), F.lit(NOTES["none"])
    for when, name, who, state, confidence in reversed(steps):
        method, status, notes = F.when(when, name).otherwise(method), F.when(when, state).otherwise(status), F.when(when, NOTES[name]).otherwise(notes)
        entity = F.when(when, F.lit(None) if who is None else who).otherwise(entity)
        sure = F.when(when, F.lit(0.0) if confidence is None else confidence).otherwise(sure)
    decided = rows.select(
        F.col("counterparty_raw_name").alias("_name"), F.col("day").alias("_day"), F.when(F.col("name_class") == "named", F.col("normalized_name")).alias("normalized_name"), "name_class", entity.alias("resolved_entity_id"),
        method.alias("resolution_method"), sure.alias("resolution_confidence"), status.alias("resolution_status"), F.coalesce("candidate_count", F.lit(0)).cast("long").alias("candidate_count"), notes.alias("notes"))
    decided = keep(decided) if keep else decided
    return keys.join(decided, F.col("counterparty_raw_name").eqNullSafe(F.col("_name")) & F.col("day").eqNullSafe(F.col("_day"))).drop("day", "_name", "_day")


def attach_resolution(mentions: DataFrame, audit: DataFrame, strict: bool = True) -> DataFrame:
    """Mentions with their audit row; ``matched`` says whether there is one.

    Two audit rows of a key are an error and so, if ``strict``, is a mention without any.
    """
    kept = ("resolved_entity_id", "resolution_status", "resolution_method")
    one = unless(F.count("*") > 1, F.first(F.struct(*kept)), "several audit rows of", *map(F.col, MENTION))
    marked = audit.groupBy(*MENTION).agg(one.alias("_audit"))
    rows = mentions.join(marked, MENTION, "left")
    if strict:
        rows = refuse_rows(rows, F.col("_audit").isNull(), "no audit row of", *map(F.col, MENTION))
    return rows.select(*mentions.columns, *(F.col(f"_audit.{c}").alias(c) for c in kept), F.col("_audit").isNotNull().alias("matched"))


def alignment(mentions: DataFrame, audit: DataFrame) -> DataFrame:
    """Mention keys without an audit row and the other way."""
    left, right = mentions.select(*MENTION).distinct(), audit.select(*MENTION).distinct()
    return left.join(right, MENTION, "left_anti").withColumn("missing_in", F.lit("audit")).union(right.join(left, MENTION, "left_anti").withColumn("missing_in", F.lit("mentions")))


def reconcile_issuers(documents: DataFrame, stock_map: DataFrame, master: DataFrame) -> DataFrame:
    """The issuer of each document: the reported id if known, else the organisation's only security, else none."""
    candidates = stock_map.groupBy("org_id").agg(F.countDistinct("security_id").alias("org_candidates"), F.min("security_id").alias("org_security_id"))
    rows = documents.join(candidates, "org_id", "left").join(master.select(F.col("security_id").alias("reported_id"), F.lit(True).alias("listed")), "reported_id", "left")
    listed, only = F.coalesce("listed", F.lit(False)), F.coalesce(F.col("org_candidates") == 1, F.lit(False))
    return rows.select(
        "source_document_id", F.when(listed, F.col("reported_id")).when(only, F.col("org_security_id")).alias("security_id"),
        F.when(listed, "reported_id").when(only, "unique_org").when(F.col("org_candidates") > 1, "ambiguous_org").otherwise("unresolved").alias("method"),
        F.coalesce("org_candidates", F.lit(0)).cast("long").alias("candidate_count"))


def alias_history(changes: DataFrame, master: DataFrame) -> DataFrame:
    """Legal-name changes as half-open intervals: the first name from listing, each name to the next change or delisting."""
    order = Window.partitionBy("security_id").orderBy("change_date", "new_name")
    rows = changes.withColumns({"next_change": F.lead("change_date").over(order), "seq": F.row_number().over(order)}).join(master.select("security_id", "listing_date", "delisting_date"), "security_id")
    later = rows.select("security_id", F.col("new_name").alias("alias"), F.col("change_date").alias("valid_from"), F.coalesce("next_change", "delisting_date").alias("valid_to"))
    first = rows.filter("seq = 1").select("security_id", F.col("old_name").alias("alias"), F.col("listing_date").alias("valid_from"), F.col("change_date").alias("valid_to"))
    return later.union(first).filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def first_observations(names: DataFrame) -> DataFrame:
    """Earliest publication of each name of a security."""
    return names.groupBy("security_id", "short_name").agg(F.min("publication_datetime").alias("first_seen"))


def coalesce_master(records: DataFrame) -> DataFrame:
    """One record a security: delisted ones first, then the most complete, then by address; gaps filled from the others in that order."""
    fields = [c for c in records.columns if c not in ("security_id", "source_url")]
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    order = Window.partitionBy("security_id").orderBy(F.col("delisting_date").isNull(), filled.desc(), F.col("source_url").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = records.withColumns({f"_{c}": F.first(c, ignorenulls=True).over(whole) for c in fields} | {"_rank": F.row_number().over(order)})
    return best.filter("_rank = 1").select("security_id", *(F.col(f"_{c}").alias(c) for c in fields), "source_url")
