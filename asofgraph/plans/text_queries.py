"""Queries over names, resolution and quality, with their SQL counterparts. Test names are ASCII, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.functions import names
from asofgraph.functions.clock import local_day
from asofgraph.operators import quality, resolve
from asofgraph.operators.refusals import settled
from asofgraph.plans.domain import frame, oracle
from asofgraph.session import stored

KEYS = resolve.MENTION


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "aliases")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Keys and publication of the mentions, stored: decisions, keys and what they are attached to read them."""
    return stored(frame(spark, d, "mentions").select(*KEYS, "publication_datetime"), "mentions")


def _audit(spark: SparkSession, d: str, mentions: DataFrame | None = None) -> DataFrame:
    overrides = spark.createDataFrame([("redwidget", 7), ("smallflange", 3)], "normalized_name string, entity_id long")
    return resolve.resolve(mentions or _keyed(spark, d), _aliases(spark, d), overrides, fuzzy=False, ascii_only=True, keep=lambda rows: stored(rows, "decisions"))


def attach_resolution(spark: SparkSession, d: str) -> DataFrame:
    mentions = _keyed(spark, d)
    return resolve.attach_resolution(mentions, _audit(spark, d, mentions)).groupBy("matched", "resolution_status").agg(F.count("*").alias("n"))


def audit_alignment(spark: SparkSession, d: str) -> DataFrame:
    mentions = _keyed(spark, d)
    return resolve.alignment(mentions, _audit(spark, d, mentions))


def _name_days(spark: SparkSession, d: str) -> DataFrame:
    """Distinct raw names and publication days of the mentions, so that each name is normalised once a day."""
    return settled(frame(spark, d, "mentions").select("counterparty_raw_name", local_day(F.col("publication_datetime")).alias("day")).distinct())


def alias_asof(spark: SparkSession, d: str) -> DataFrame:
    rows = _name_days(spark, d).select(names.normalize_name(F.col("counterparty_raw_name"), True).alias("normalized_name"), "day")
    known = _aliases(spark, d).withColumn("normalized_name", names.normalize_name(F.col("alias"), True))
    return resolve.alias_candidates(rows, known)


def fuzzy_top2(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(_name_days(spark, d).select(names.normalize_name(F.concat(F.col("counterparty_raw_name"), F.lit("s")), True).alias("normalized_name"), "day").distinct(), "names")  # read four times
    known = _aliases(spark, d).withColumn("normalized_name", names.normalize_name(F.col("alias"), True))
    return resolve.fuzzy_best(rows, known, 90, 2)


def candidate_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("主要客户："), F.col("c_name"), F.lit("，供应商名称: S-"), F.col("c_mktsegment"), F.lit("；客户："), F.col("c_name"), F.lit("\n"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.alias("t"))
    both = F.array(*(F.struct(F.lit(r).alias("relation"), names.extract_candidates(F.col("t"), r).alias("found")) for r in names.CANDIDATES))
    return rows.select("c_custkey", F.explode(both).alias("x")).select("c_custkey", "x.relation", F.explode("x.found").alias("name"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("source_document_id"), (F.col("o_custkey") % 130).alias("reported_id"), (F.col("o_custkey") % 40).alias("org_id"))


def org_reconcile(spark: SparkSession, d: str) -> DataFrame:
    stock_map = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % 60).alias("org_id"), F.col("s_suppkey").alias("security_id"))
    return resolve.reconcile_issuers(_documents(spark, d), stock_map, frame(spark, d, "security_master"))


def alias_history_intervals(spark: SparkSession, d: str) -> DataFrame:
    changes = frame(spark, d, "evidence").filter("line = 3").select(
        F.col("supplier_id").alias("security_id"), F.to_date("publication_datetime").alias("change_date"), F.concat(F.lit("N"), F.col("source_document_id")).alias("new_name"), F.concat(F.lit("O"), F.col("customer_id")).alias("old_name")).distinct()
    changes = changes.groupBy("security_id", "change_date").agg(F.min("new_name").alias("new_name"), F.min("old_name").alias("old_name"))
    return resolve.alias_history(changes, frame(spark, d, "security_master"))


def publication_timing(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    at = F.when(F.col("event_id") % 3 == 0, F.floor(at / 86_400_000) * 86_400_000 - 8 * 3_600_000).otherwise(at)
    usable, kind = names.publication_timing(at)
    return spark.read.parquet(f"{d}/events.parquet").groupBy(kind.alias("kind"), F.to_date(usable).alias("usable_day")).agg(F.count("*").alias("n"))


def master_coalesce(spark: SparkSession, d: str) -> DataFrame:
    records = frame(spark, d, "evidence").select(
        F.col("supplier_id").alias("security_id"), F.expr("CASE WHEN line % 2 = 0 THEN CAST(publication_datetime AS DATE) END").alias("listing_date"),
        F.expr("CASE WHEN line = 5 THEN CAST(effective_end AS DATE) END").alias("delisting_date"), F.expr("CASE WHEN line % 3 = 0 THEN 'B' || line END").alias("board"),
        F.concat(F.lit("u"), F.col("source_document_id"), F.lit("-"), F.col("customer_id"), F.lit("-"), F.col("line"), F.lit("-"), F.col("economic_weight").cast("decimal(18,2)").cast("string")).alias("source_url")).distinct()
    return resolve.coalesce_master(records)


def _counted(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of the columns with the number of their rows, so that each is normalised and classified once."""
    return settled(rows.groupBy(*columns).agg(F.count("*").alias("n")))


def name_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = _counted(frame(spark, d, "mentions"), "counterparty_raw_name")
    return rows.groupBy(names.classify_name(F.col("counterparty_raw_name"), True).alias("name_class")).agg(F.sum("n").alias("n"))


def evidence_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _counted(frame(spark, d, "mentions"), "counterparty_raw_name", "evidence_text").filter(names.classify_name(F.col("counterparty_raw_name"), True) == "named")
    found = quality.evidence_support(rows, names.normalize_name(F.col("counterparty_raw_name"), True), names.normalize_name(F.col("evidence_text"), True), F.col("n"))
    return found.withColumn("rate", F.round("rate", 9))


def section_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = quality.section_coverage(_documents(spark, d), frame(spark, d, "mentions").filter("relationship_type = 'customer'"))
    return found.withColumn("rate", F.round("rate", 9))


def timing_mismatches(spark: SparkSession, d: str) -> DataFrame:
    mentions = frame(spark, d, "mentions").select("source_document_id", "source_company_id", F.to_date("publication_datetime").alias("day"))
    documents = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("source_document_id"), F.date_add(F.to_date("o_orderdate"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END")).alias("day"))
    return quality.timing_mismatches(mentions, documents, ["day"])


QUERIES = {
    "name_normalize": lambda s, d: settled(frame(s, d, "mentions").select("counterparty_raw_name").distinct()).select("counterparty_raw_name", names.normalize_name(F.col("counterparty_raw_name"), True).alias("normalized_name")),
    "name_classify": name_classify,
    "board_derivation": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", names.board_of(names.clean_ticker(F.col("c_custkey") * 677)).alias("board")),
    "alias_asof": alias_asof,
    "resolution_ladder": lambda s, d: _audit(s, d),
    "attach_resolution": attach_resolution,
    "audit_alignment": audit_alignment,
    "key_difference": lambda s, d: quality.key_difference(frame(s, d, "evidence"), s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("source_document_id")), ["source_document_id"]),
    "fuzzy_top2": fuzzy_top2,
    "candidate_extract": candidate_extract,
    "org_reconcile": org_reconcile,
    "alias_history_intervals": alias_history_intervals,
    "first_observations": lambda s, d: resolve.first_observations(frame(s, d, "mentions").select(F.col("source_company_id").alias("security_id"), F.col("counterparty_raw_name").alias("short_name"), "publication_datetime")),
    "publication_timing": publication_timing,
    "master_coalesce": master_coalesce,
    "stratified_sample": lambda s, d: quality.stratified_sample(frame(s, d, "mentions").select(*KEYS, "relationship_type", F.year("publication_datetime").alias("year")).distinct(), ["relationship_type", "year"], KEYS, 60, 42),
    "provenance": lambda s, d: quality.completeness(frame(s, d, "mentions").withColumn("counterparty_raw_name", F.expr("CASE WHEN source_company_id % 19 = 1 THEN '  ' ELSE counterparty_raw_name END")), [*KEYS, "evidence_text"]).withColumn("rate", F.round("rate", 9)),
    "evidence_support": evidence_support,
    "mention_dedup": lambda s, d: quality.dedupe_mentions(frame(s, d, "mentions"), ["source_company_id", "counterparty_raw_name", "relationship_type"]),
    "section_coverage": section_coverage,
    "timing_mismatches": timing_mismatches,
}

def _norm(column: str) -> str:
    plain = f"regexp_replace(lower({column}), '[\\s,.()<>_-]+', '', 'g')"
    cases = " ".join(f"WHEN suffix({plain}, '{x}') AND length({plain}) > {len(x) + 1} THEN left({plain}, length({plain}) - {len(x)})" for x in ("corporation", "limited", "corp", "inc", "ltd", "co"))
    return f"CASE {cases} ELSE {plain} END"


_AUDIT = f"""k AS (SELECT source_document_id, source_company_id, counterparty_raw_name, min(CAST(publication_datetime + INTERVAL 8 HOUR AS DATE)) AS day FROM mentions GROUP BY 1, 2, 3),
  nk AS (SELECT *, {_norm('counterparty_raw_name')} AS normalized_name, CASE WHEN contains(counterparty_raw_name, '*') THEN 'anonymous' ELSE 'named' END AS name_class FROM k),
  al AS (SELECT *, {_norm('alias')} AS nn FROM aliases),
  cd AS (SELECT normalized_name, day, count(DISTINCT entity_id) AS candidate_count, min(entity_id) AS entity_id FROM (SELECT DISTINCT normalized_name, day FROM nk WHERE name_class = 'named') q JOIN al ON nn = normalized_name AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY 1, 2),
  ov AS (SELECT * FROM (VALUES ('redwidget', 7), ('smallflange', 3)) AS o(nn, oid)),
  audit AS (SELECT source_document_id, source_company_id, counterparty_raw_name, CASE WHEN name_class = 'named' THEN nk.normalized_name END AS normalized_name, name_class,
    CASE WHEN name_class = 'anonymous' THEN 'anonymous_label_blocked_by_rule' WHEN candidate_count = 1 THEN 'exact_alias_valid_at_publication' WHEN oid IS NOT NULL THEN 'version_controlled_manual_override'
      WHEN candidate_count > 1 THEN 'ambiguous_exact_alias_not_auto_resolved' ELSE 'no_reproducible_candidate_passed_thresholds' END AS notes,
    CASE WHEN name_class = 'anonymous' THEN NULL WHEN candidate_count = 1 THEN entity_id ELSE oid END AS resolved_entity_id,
    CASE WHEN name_class = 'anonymous' THEN 'blocked_anonymous' WHEN candidate_count = 1 THEN 'exact_alias' WHEN oid IS NOT NULL THEN 'manual_override' WHEN candidate_count > 1 THEN 'exact_alias_collision' ELSE 'none' END AS resolution_method,
    CASE WHEN name_class = 'anonymous' THEN 0.0 WHEN candidate_count = 1 OR oid IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS resolution_confidence,
    CASE WHEN name_class = 'anonymous' THEN 'anonymous' WHEN candidate_count = 1 OR oid IS NOT NULL THEN 'resolved' WHEN candidate_count > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution_status,
    coalesce(candidate_count, 0) AS candidate_count FROM nk LEFT JOIN cd ON cd.normalized_name = nk.normalized_name AND cd.day = nk.day LEFT JOIN ov ON ov.nn = nk.normalized_name)"""

ORACLE = {
    "name_normalize": oracle(["mentions"], f"SELECT DISTINCT counterparty_raw_name, {_norm('counterparty_raw_name')} AS normalized_name FROM mentions"),
    "name_classify": oracle(["mentions"], "SELECT CASE WHEN contains(counterparty_raw_name, '*') THEN 'anonymous' ELSE 'named' END AS name_class, count(*) AS n FROM mentions GROUP BY 1"),
    "board_derivation": """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey * 677 < 1000000 THEN lpad(CAST(c_custkey * 677 AS VARCHAR), 6, '0') END AS t FROM customer)
      SELECT c_custkey, CASE WHEN left(t, 3) IN ('688', '689') THEN 'STAR' WHEN left(t, 3) IN ('300', '301', '302') THEN 'CHINEXT' WHEN left(t, 3) IN ('600', '601', '603', '605', '000', '001', '002', '003') THEN 'MAIN' END AS board FROM t""",
    "alias_asof": oracle(["mentions", "aliases"], f"""n AS (SELECT DISTINCT {_norm('counterparty_raw_name')} AS normalized_name, CAST(publication_datetime + INTERVAL 8 HOUR AS DATE) AS day FROM mentions), al AS (SELECT *, {_norm('alias')} AS nn FROM aliases)
      SELECT normalized_name, day, count(DISTINCT entity_id) AS candidate_count, min(entity_id) AS entity_id FROM n JOIN al ON nn = normalized_name AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY 1, 2"""),
    "resolution_ladder": oracle(["mentions", "aliases"], f"{_AUDIT} SELECT * FROM audit"),
    "attach_resolution": oracle(["mentions", "aliases"], f"{_AUDIT} SELECT a.source_document_id IS NOT NULL AS matched, resolution_status, count(*) AS n FROM mentions m LEFT JOIN audit a ON a.source_document_id = m.source_document_id AND a.source_company_id = m.source_company_id AND a.counterparty_raw_name = m.counterparty_raw_name GROUP BY 1, 2"),
    "audit_alignment": oracle(["mentions", "aliases"], _AUDIT + """, a AS (SELECT DISTINCT source_document_id, source_company_id, counterparty_raw_name FROM mentions), b AS (SELECT DISTINCT source_document_id, source_company_id, counterparty_raw_name FROM audit)
      SELECT *, 'audit' AS missing_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'mentions' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""),
    "key_difference": oracle(["evidence"], """a AS (SELECT DISTINCT source_document_id FROM evidence), b AS (SELECT DISTINCT o_orderkey AS source_document_id FROM orders)
      SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""),
    "candidate_extract": "SELECT c_custkey, 'customer' AS relation, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'supplier', 'S-' || c_mktsegment FROM customer",
    "org_reconcile": oracle(["security_master"], """c AS (SELECT s_suppkey % 60 AS org_id, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1)
      SELECT o_orderkey AS source_document_id, CASE WHEN security_id IS NOT NULL THEN security_id WHEN n = 1 THEN s END AS security_id,
      CASE WHEN security_id IS NOT NULL THEN 'reported_id' WHEN n = 1 THEN 'unique_org' WHEN n > 1 THEN 'ambiguous_org' ELSE 'unresolved' END AS method, coalesce(n, 0) AS candidate_count
      FROM orders LEFT JOIN c ON org_id = o_custkey % 40 LEFT JOIN security_master ON security_id = o_custkey % 130"""),
    "alias_history_intervals": oracle(["evidence", "security_master"], """g AS (SELECT supplier_id AS security_id, CAST(publication_datetime AS DATE) AS change_date, min('N' || source_document_id) AS new_name, min('O' || customer_id) AS old_name FROM evidence WHERE line = 3 GROUP BY 1, 2),
      w AS (SELECT g.*, lead(change_date) OVER x AS nx, row_number() OVER x AS seq, listing_date, delisting_date FROM g JOIN security_master USING (security_id) WINDOW x AS (PARTITION BY security_id ORDER BY change_date, new_name)),
      r AS (SELECT security_id, new_name AS alias, change_date AS valid_from, coalesce(nx, delisting_date) AS valid_to FROM w UNION ALL SELECT security_id, old_name, listing_date, change_date FROM w WHERE seq = 1)
      SELECT * FROM r WHERE valid_to IS NULL OR valid_from < valid_to"""),
    "first_observations": oracle(["mentions"], "SELECT source_company_id AS security_id, counterparty_raw_name AS short_name, min(publication_datetime) AS first_seen FROM mentions GROUP BY 1, 2"),
    "publication_timing": """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) - INTERVAL 8 HOUR ELSE date_trunc('millisecond', ts) END AS t FROM events),
      k AS (SELECT t, CASE WHEN date_trunc('day', t + INTERVAL 8 HOUR) = t + INTERVAL 8 HOUR THEN 'date_only' ELSE 'exact' END AS kind FROM e)
      SELECT kind, CAST(CASE WHEN kind = 'date_only' THEN t + INTERVAL 1 DAY ELSE t END AS DATE) AS usable_day, count(*) AS n FROM k GROUP BY 1, 2""",
    "master_coalesce": oracle(["evidence"], """r AS (SELECT DISTINCT supplier_id AS security_id, CASE WHEN line % 2 = 0 THEN CAST(publication_datetime AS DATE) END AS listing_date, CASE WHEN line = 5 THEN CAST(effective_end AS DATE) END AS delisting_date,
      CASE WHEN line % 3 = 0 THEN 'B' || line END AS board, 'u' || source_document_id || '-' || customer_id || '-' || line || '-' || CAST(CAST(economic_weight AS DECIMAL(18,2)) AS VARCHAR) AS source_url FROM evidence),
      o AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY delisting_date IS NULL, (listing_date IS NOT NULL)::INT + (delisting_date IS NOT NULL)::INT + (board IS NOT NULL)::INT DESC, source_url NULLS LAST) AS k FROM r)
      SELECT security_id, arg_min(listing_date, k) FILTER (listing_date IS NOT NULL) AS listing_date, arg_min(delisting_date, k) FILTER (delisting_date IS NOT NULL) AS delisting_date, arg_min(board, k) FILTER (board IS NOT NULL) AS board, arg_min(source_url, k) AS source_url FROM o GROUP BY security_id"""),
    "stratified_sample": oracle(["mentions"], """s AS (SELECT DISTINCT source_document_id, source_company_id, counterparty_raw_name, relationship_type, CAST(year(publication_datetime) AS INTEGER) AS year FROM mentions),
      g AS (SELECT relationship_type, year, count(*) AS n, (count(*) OVER ()) AS groups FROM s GROUP BY 1, 2), j AS (SELECT *, unnest(range(1, least(n - 1, 60) + 1)) AS j FROM g),
      t AS (SELECT *, row_number() OVER (ORDER BY n / (j + 1) DESC, relationship_type || chr(31) || year, j) AS seat FROM j), a AS (SELECT relationship_type, year, count(*) AS more FROM t WHERE seat <= 60 - groups GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY relationship_type, year ORDER BY sha256('42' || chr(31) || source_document_id || chr(31) || source_company_id || chr(31) || counterparty_raw_name), source_document_id, source_company_id, counterparty_raw_name) AS rk FROM s)
      SELECT source_document_id, source_company_id, counterparty_raw_name, k.relationship_type, k.year FROM k LEFT JOIN a ON a.relationship_type = k.relationship_type AND a.year = k.year WHERE rk <= 1 + coalesce(more, 0)"""),
    "provenance": oracle(["mentions"], "SELECT count(*) AS rows, count(*) FILTER (source_company_id % 19 <> 1) AS complete, round(count(*) FILTER (source_company_id % 19 <> 1) / count(*), 9) AS rate FROM mentions"),
    "evidence_support": oracle(["mentions"], f"n AS (SELECT {_norm('counterparty_raw_name')} AS a, {_norm('evidence_text')} AS b FROM mentions WHERE NOT contains(counterparty_raw_name, '*')) SELECT count(*) AS sampled, count(*) FILTER (contains(replace(b, ':', ':'), a)) AS supported, round(count(*) FILTER (contains(b, a)) / count(*), 9) AS rate FROM n"),
    "mention_dedup": oracle(["mentions"], "SELECT source_company_id, counterparty_raw_name, relationship_type, min(evidence_text) AS evidence_text, CASE WHEN count(DISTINCT exposure_share) = 1 THEN max(exposure_share) END AS exposure_share, count(*) AS row_count FROM mentions GROUP BY 1, 2, 3"),
    "section_coverage": oracle(["mentions"], """c AS (SELECT DISTINCT source_document_id FROM mentions WHERE relationship_type = 'customer') SELECT count(DISTINCT o_orderkey) AS captured, count(DISTINCT source_document_id) AS with_section,
      round(count(DISTINCT source_document_id) / count(DISTINCT o_orderkey), 9) AS rate FROM orders LEFT JOIN c ON source_document_id = o_orderkey"""),
    "timing_mismatches": oracle(["mentions"], """d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS od FROM orders)
      SELECT source_document_id, source_company_id, CAST(publication_datetime AS DATE) AS day FROM mentions LEFT JOIN d ON o_orderkey = source_document_id WHERE od IS NULL OR od <> CAST(publication_datetime AS DATE)"""),
}
