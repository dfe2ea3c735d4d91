"""Queries over contracts, sources and streams, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.operators.contracts import Contract
from asofgraph.plans import graph_queries, text_queries
from asofgraph.plans.domain import frame, oracle

LINES = Contract("lines", ("l_orderkey", "l_linenumber"), {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double", "l_returnflag": "string"},
                 rules={"discount": "l_discount > 0.09", "flag": "l_returnflag NOT IN ('A', 'N')"})


def read_validate(spark: SparkSession, d: str) -> DataFrame:
    return LINES.check(spark.read.parquet(f"{d}/lineitem.parquet"))


def cast_losses(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("a"), F.col("p_size").cast("string").alias("b"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE '2020-01-' || p_size END").alias("c"))
    return Contract("parts", (), {"a": "long", "b": "double", "c": "date"}).lost_in_cast(raw)


def json_records(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of asofgraph.streaming.edges.disclosure_counts, by which a test holds the stream."""
    from asofgraph.streaming.edges import disclosure_counts

    return disclosure_counts(graph_queries._mentions(spark, d))


def disclosure_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two-row customer tables as report text, read back."""
    from asofgraph.sources.disclosures import table_mentions

    text = F.concat(
        F.lit("公司主要客户情况\n序号 客户名称 销售额（万元） 占年度销售总额比例（%）\n1 "), F.col("c_name"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".50 12.5\n2 "),
        F.col("c_mktsegment"), F.lit("公司\n"), (F.col("c_custkey") % 90 + 1).cast("string"), F.lit(" 4.0%\n第六节 其他\n"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("source_document_id"), text.alias("text"))
    return table_mentions(rows).select("source_document_id", "counterparty_raw_name", F.round("exposure_value", 2).alias("exposure_value"), F.round("exposure_share", 6).alias("exposure_share"), "ordinal")


def announcements(spark: SparkSession, d: str) -> DataFrame:
    """Orders as announcements: every third bears a bare date, every seventh is a summary."""
    from asofgraph.operators.announcements import normalize_announcements

    at = F.unix_millis(F.to_timestamp("o_orderdate")) + F.when(F.col("o_orderkey") % 3 == 0, -8 * 3_600_000).otherwise(5_000)
    title = F.concat(F.lit("<em>C</em>"), F.year("o_orderdate").cast("string"), F.lit("年年度报告"), F.when(F.col("o_orderkey") % 7 == 0, "摘要").otherwise(""))
    raw = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("announcement_id"), (F.col("o_custkey") % 700 + 600_000).cast("string").alias("sec_code"), F.col("o_custkey").alias("org_id"), title.alias("title"), at.alias("announcement_time_ms"), F.lit("u").alias("url"))
    return normalize_announcements(raw).select("source_document_id", "reported_id", "title", "source_period_end", "publication_datetime", "publication_time_precision")


def name_boundary(spark: SparkSession, d: str) -> DataFrame:
    from asofgraph.operators.announcements import name_boundary as boundary

    broken = F.when(F.col("source_document_id") % 50 == 0, "resolved").otherwise(F.col("resolution_status"))
    return boundary(text_queries._audit(spark, d).withColumn("resolution_status", broken))


QUERIES = {"disclosure_tables": disclosure_tables, "announcements": announcements, "name_boundary": name_boundary, "read_validate": read_validate, "cast_losses": cast_losses, "json_records": json_records, "stream_windows": stream_windows,
           "calendar": lambda s, d: frame(s, d, "calendar")}

ORACLE = {
    "disclosure_tables": """SELECT CAST(c_custkey AS VARCHAR) AS source_document_id, c_name AS counterparty_raw_name, round((c_custkey + 0.5::DOUBLE) * 10000, 2) AS exposure_value, 0.125::DOUBLE AS exposure_share, 0 AS ordinal FROM customer
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment || '公司', (c_custkey % 90 + 1) * 10000.0::DOUBLE, 0.04::DOUBLE, 1 FROM customer""",
    "announcements": """WITH t AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 8 HOUR ELSE o_orderdate + INTERVAL 5 SECOND END AS moment, CAST(o_custkey % 700 + 600000 AS VARCHAR) AS id FROM orders),
      k AS (SELECT *, date_trunc('day', moment + INTERVAL 8 HOUR) = moment + INTERVAL 8 HOUR AS bare FROM t WHERE o_orderkey % 7 <> 0 AND left(id, 3) IN ('600', '601', '603', '605'))
      SELECT CAST(o_orderkey AS VARCHAR) AS source_document_id, id AS reported_id, 'C' || year(o_orderdate) || '年年度报告' AS title, make_date(year(o_orderdate), 12, 31) AS source_period_end,
      CASE WHEN bare THEN moment + INTERVAL 1 DAY ELSE moment END AS publication_datetime, CASE WHEN bare THEN 'date_only' ELSE 'exact' END AS publication_time_precision FROM k""",
    "name_boundary": oracle(["mentions", "aliases"], text_queries._AUDIT + """, b AS (SELECT * REPLACE (CASE WHEN source_document_id % 50 = 0 THEN 'resolved' ELSE resolution_status END AS resolution_status) FROM audit)
      SELECT 'resolved_without_entity' AS "check", count(*) FILTER (resolution_status = 'resolved' AND resolved_entity_id IS NULL) AS actual FROM b UNION ALL SELECT 'entity_without_resolution', count(*) FILTER (resolution_status <> 'resolved' AND resolved_entity_id IS NOT NULL) FROM b
      UNION ALL SELECT 'anonymous_resolved', count(*) FILTER (name_class = 'anonymous' AND resolution_status = 'resolved') FROM b UNION ALL SELECT 'named_blocked', count(*) FILTER (name_class = 'named' AND resolution_method = 'blocked_anonymous') FROM b
      UNION ALL SELECT 'exact_with_many_candidates', count(*) FILTER (resolution_method = 'exact_alias' AND candidate_count <> 1) FROM b UNION ALL SELECT 'confidence_out_of_range', count(*) FILTER (NOT resolution_confidence BETWEEN 0 AND 1) FROM b
      UNION ALL SELECT 'unresolved_with_confidence', count(*) FILTER (resolution_status <> 'resolved' AND resolution_confidence > 0) FROM b"""),
    "read_validate": """SELECT 'null:l_orderkey' AS rule, count(*) FILTER (l_orderkey IS NULL) AS violations FROM lineitem UNION ALL SELECT 'null:l_linenumber', count(*) FILTER (l_linenumber IS NULL) FROM lineitem
      UNION ALL SELECT 'null:l_quantity', count(*) FILTER (l_quantity IS NULL) FROM lineitem UNION ALL SELECT 'null:l_returnflag', count(*) FILTER (l_returnflag IS NULL) FROM lineitem
      UNION ALL SELECT 'not_finite:l_quantity', count(*) FILTER (NOT isfinite(l_quantity)) FROM lineitem UNION ALL SELECT 'blank:l_returnflag', count(*) FILTER (trim(l_returnflag) = '') FROM lineitem
      UNION ALL SELECT 'rule:discount', count(*) FILTER (l_discount > 0.09) FROM lineitem UNION ALL SELECT 'rule:flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
      UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "cast_losses": """SELECT 'a' AS "column", count(*) FILTER (try_cast(p_brand AS BIGINT) IS NULL) AS lost FROM part UNION ALL SELECT 'b', 0 FROM part WHERE false UNION ALL SELECT 'b', count(*) FILTER (p_size IS NULL) FROM part
      UNION ALL SELECT 'c', count(*) FILTER (p_partkey % 7 <> 0 AND p_size > 31) FROM part""",
    "json_records": "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "stream_windows": oracle(["evidence"], graph_queries._MENTIONS + """ SELECT time_bucket(INTERVAL '7 days', publication_datetime, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '7 days', publication_datetime, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS window_end,
      count(*) AS mentions, count(*) FILTER (resolution_status = 'resolved') AS resolved_mentions FROM m GROUP BY 1, 2"""),
    "calendar": oracle(["calendar"], "SELECT date FROM calendar"),
}
