"""Queries over edges, snapshots, coverage and neighbour signals, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.operators import graph, integrity, intervals
from asofgraph.plans.domain import frame, oracle
from asofgraph.session import stored

YEARS = (1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002, 2010)
AS_OF = "1998-06-30 10:00:00"


def _years(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y,) for y in YEARS], "year int")


def _as_of() -> F.Column:
    return F.to_timestamp(F.lit(AS_OF))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Edge evidence in the form of classified, resolved mentions."""
    return frame(spark, d, "evidence").select(
        F.col("source_document_id"), F.col("supplier_id").alias("source_company_id"), F.col("customer_id").alias("resolved_entity_id"),
        F.when(F.col("line") % 2 == 0, "customer").otherwise("supplier").alias("relationship_type"),
        F.when(F.col("line") % 3 == 0, "unresolved").otherwise("resolved").alias("resolution_status"),
        F.when(F.col("line") % 6 == 3, "anonymous").otherwise("named").alias("name_class"),
        F.col("line").alias("counterparty_raw_name"), "publication_datetime", "relationship_confidence")


_MENTIONS = """m AS (SELECT source_document_id, supplier_id AS source_company_id, customer_id AS resolved_entity_id,
  CASE WHEN line % 2 = 0 THEN 'customer' ELSE 'supplier' END AS relationship_type, CASE WHEN line % 3 = 0 THEN 'unresolved' ELSE 'resolved' END AS resolution_status,
  CASE WHEN line % 6 = 3 THEN 'anonymous' ELSE 'named' END AS name_class, line AS counterparty_raw_name, publication_datetime, relationship_confidence FROM evidence)"""
_YEARS = f"y AS (SELECT unnest([{', '.join(map(str, YEARS))}]) AS year), ye AS (SELECT year, make_timestamp(year, 12, 31, 15, 59, 59.999999) AS year_end FROM y)"
_ACTIVE = f"{_YEARS}, act AS (SELECT * FROM edges JOIN ye ON effective_start <= year_end AND year_end < effective_end)"
_HISTORY = "h AS (SELECT security_id, industry_code, listing_date AS valid_from, CAST(NULL AS DATE) AS valid_to FROM security_master WHERE security_id % 10 <> 4 UNION ALL SELECT security_id, industry_code + 1, listing_date, DATE '1999-01-01' FROM security_master WHERE security_id % 7 = 1)"
_NODES = "nodes AS (SELECT supplier_id AS node, customer_id AS other, 1 AS o FROM edges UNION SELECT customer_id, supplier_id, 0 FROM edges)"
_RESIDUALS = "r AS (SELECT date, security_id, CASE WHEN is_suspended THEN NULL ELSE raw_return END AS residual_return FROM returns)"


def residuals(spark: SparkSession, d: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    return frame(spark, d, "returns", given).select("date", "security_id", F.when(~F.col("is_suspended"), F.col("raw_return")).alias("residual_return"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    master = frame(spark, d, "security_master")
    one = master.filter("security_id % 10 <> 4").select("security_id", "industry_code", F.col("listing_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return one.union(master.filter("security_id % 7 = 1").select("security_id", F.col("industry_code") + 1, "listing_date", F.lit("1999-01-01").cast("date")))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.collapse(frame(spark, d, "evidence").filter("supplier_id <> customer_id"))


def edge_build(spark: SparkSession, d: str) -> DataFrame:
    return graph.orient(_mentions(spark, d)).select(
        "supplier_id", "customer_id", "source_document_id", "effective_start", "effective_end", "relationship_confidence")


def edge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.conflicts(frame(spark, d, "evidence"), ("relationship_confidence", "economic_weight"))


def signals_of(spark: SparkSession, d: str, returns: DataFrame, customers_only: bool = False) -> DataFrame:
    """Neighbour signals on stored residuals, whose dates are stored as well, since several steps read them."""
    return graph.diffusion_signals(_edges(spark, d), returns, stored(returns.select("date").distinct(), "calendar"), customers_only)


def signal_diffusion(spark: SparkSession, d: str) -> DataFrame:
    found = signals_of(spark, d, stored(residuals(spark, d), "residuals"))
    return found.withColumns({c: F.round(c, 6) for c in ("customer_shock", "supplier_shock")})


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Edges while both ends are listed."""
    listed = graph.listed_intervals(_edges(spark, d), frame(spark, d, "security_master"))
    return listed.withColumns({"effective_start": F.col("listed_start"), "effective_end": F.col("listed_end")})


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return graph.gate(graph.yearly_diagnostics(_listed(spark, d), _years(spark)), 100, 20, 3, 50.0)


def exposure_counters(spark: SparkSession, d: str) -> DataFrame:
    """Every edge as an exposure at the year ends in its listed interval, so pairs with several documents do repeat."""
    found = integrity.exposure_counters(_edges(spark, d), graph.active_at_year_ends(_listed(spark, d), _years(spark)), frame(spark, d, "security_master"))
    return found.union(integrity.repeated_evidence(_edges(spark, d)))


def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    """The gate's records, with the counters of edges, endpoints and the pairs that the gate counts."""
    pairs = graph.pairs_at_year_ends(_listed(spark, d), _years(spark))
    more = integrity.exposure_counters(_edges(spark, d), pairs, frame(spark, d, "security_master"))
    return graph.check_records(gate_verdict(spark, d), graph.integrity(_edges(spark, d), _mentions(spark, d)).union(more), 3, 50.0)


def industry_pit_yearly(spark: SparkSession, d: str) -> DataFrame:
    active = graph.active_at_year_ends(_edges(spark, d), _years(spark))
    return graph.industry_by_year(active, _history(spark, d)).withColumn("largest_share", F.round("largest_share", 9))


QUERIES = {
    "edge_build": edge_build,
    "edge_collapse": _edges,
    "edge_conflicts": edge_conflicts,
    "snapshot_asof": lambda s, d: graph.snapshot(_edges(s, d), _as_of()).select("supplier_id", "customer_id", "source_document_id", "effective_start", "relationship_confidence"),
    "listed_intervals": lambda s, d: graph.listed_intervals(_edges(s, d), frame(s, d, "security_master")).select("supplier_id", "customer_id", "source_document_id", "listed_start", "listed_end"),
    "active_edges_yearly": lambda s, d: graph.yearly_diagnostics(_edges(s, d), _years(s)).withColumn("median_age_days", F.round("median_age_days", 6)),
    "consecutive_runs": lambda s, d: intervals.consecutive_runs(frame(s, d, "evidence").select(F.datediff("publication_datetime", F.lit("1970-01-01")).alias("v")), "v"),
    "interval_overlaps": lambda s, d: intervals.overlaps(frame(s, d, "aliases"), ["alias"], "valid_from", "valid_to", inclusive=False).select("entity_id", "alias", "valid_from", "valid_to"),
    "degree": lambda s, d: graph.degrees(_edges(s, d)),
    "node_roles": lambda s, d: graph.roles(_edges(s, d)).groupBy("role").agg(F.count("*").alias("nodes")),
    "edge_age_buckets": lambda s, d: graph.age_buckets(graph.snapshot(_edges(s, d), _as_of(), collapse_pairs=False), _as_of()),
    "coverage_summary": lambda s, d: graph.coverage_summary(_mentions(s, d), _edges(s, d)).withColumns({c: F.round(c, 9) for c in ("explicit_rate", "resolved_rate")}),
    "yearly_disclosures": lambda s, d: graph.yearly_disclosures(_mentions(s, d)).withColumns({c: F.round(c, 9) for c in ("explicit_rate", "resolved_rate")}),
    "source_documents": lambda s, d: graph.source_documents(_mentions(s, d), _edges(s, d)),
    "endpoint_diagnostics": lambda s, d: graph.endpoint_check(_edges(s, d), frame(s, d, "security_master").withColumn("listing_date", F.expr("CASE WHEN security_id % 8 > 0 THEN listing_date END"))),
    "industry_static": lambda s, d: graph.industry_static(_edges(s, d), frame(s, d, "security_master")),
    "industry_pit_share": lambda s, d: graph.industry_incidence(graph.snapshot(_edges(s, d), _as_of()), graph.industry_at(_history(s, d), F.to_date(_as_of()))).withColumn("share", F.round("share", 9)),
    "industry_pit_yearly": industry_pit_yearly,
    "integrity_counters": lambda s, d: graph.integrity(_edges(s, d), _mentions(s, d)),
    "exposure_counters": exposure_counters,
    "gate_verdict": gate_verdict,
    "gate_checks": gate_checks,
    "signal_diffusion": signal_diffusion,
    "weak_components": lambda s, d: graph.weak_components(graph.snapshot(_edges(s, d), _as_of())),
}

_SNAP = f"snap AS (SELECT * FROM edges WHERE effective_start <= TIMESTAMP '{AS_OF}' AND effective_end > TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY supplier_id, customer_id ORDER BY effective_start DESC NULLS LAST, relationship_confidence DESC NULLS LAST, source_document_id DESC NULLS LAST) = 1)"
_YEARLY = f"""{_ACTIVE}, u AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY year, supplier_id, customer_id ORDER BY effective_start DESC NULLS LAST, relationship_confidence DESC NULLS LAST, source_document_id DESC NULLS LAST) = 1),
  p AS (SELECT year, count(*) AS active_edges, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT customer_id) AS customers, median((epoch_us(year_end) - epoch_us(effective_start)) / 86400000000.0) AS med FROM u GROUP BY year),
  e AS (SELECT year, count(DISTINCT node) AS connected_stocks FROM (SELECT year, supplier_id AS node FROM u UNION ALL SELECT year, customer_id FROM u) GROUP BY year),
  yearly AS (SELECT y.year, coalesce(active_edges, 0) AS active_edges, coalesce(connected_stocks, 0) AS connected_stocks, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers, med
    FROM y LEFT JOIN p ON y.year = p.year LEFT JOIN e ON y.year = e.year)"""

_LISTED = """le AS (SELECT supplier_id, customer_id, source_document_id, relationship_confidence, greatest(effective_start, CAST(a.listing_date AS TIMESTAMP), CAST(b.listing_date AS TIMESTAMP)) AS effective_start,
    least(effective_end, CAST(a.delisting_date AS TIMESTAMP), CAST(b.delisting_date AS TIMESTAMP)) AS effective_end
    FROM edges e JOIN security_master a ON a.security_id = supplier_id JOIN security_master b ON b.security_id = customer_id)"""
_GATE = f"""{_LISTED}, {_YEARLY.replace("FROM edges JOIN", "FROM le JOIN")}, q AS (SELECT * FROM yearly WHERE active_edges >= 100 AND connected_stocks >= 20),
  g AS (SELECT year, connected_stocks, year - row_number() OVER (ORDER BY year) AS i FROM q), n AS (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM g),
  v AS (SELECT (SELECT count(*) FROM n WHERE n >= 3) AS usable_years, (SELECT median(connected_stocks) FROM n WHERE n >= 3) AS median_connected_stocks, (SELECT coalesce(max(n), 0) FROM n) AS longest_run),
  gate AS (SELECT *, longest_run >= 3 AND coalesce(median_connected_stocks >= 50, false) AS passed, CASE WHEN longest_run >= 3 AND median_connected_stocks >= 50 THEN 'FEASIBLE' ELSE 'INFEASIBLE_DATA' END AS outcome FROM v)"""
_COUNTERS = """SELECT 'used_before_publication' AS "check", count(*) FILTER (publication_datetime > effective_start) AS actual FROM edges
      UNION ALL SELECT 'empty_interval', count(*) FILTER (effective_start >= effective_end) FROM edges
      UNION ALL SELECT 'beyond_maximum_age', count(*) FILTER (epoch_us(effective_end) - epoch_us(effective_start) > 550 * 86400000000) FROM edges
      UNION ALL SELECT 'self_edges', count(*) FILTER (supplier_id = customer_id) FROM edges UNION ALL SELECT 'missing_provenance', count(*) FILTER (source_document_id IS NULL) FROM edges
      UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM edges GROUP BY supplier_id, customer_id, source_document_id HAVING count(*) > 1)
      UNION ALL SELECT 'documents_without_mentions', count(DISTINCT source_document_id) FROM edges WHERE source_document_id NOT IN (SELECT source_document_id FROM evidence)"""

ORACLE = {
    "edge_build": oracle(["evidence"], _MENTIONS + """, o AS (SELECT CASE WHEN relationship_type = 'customer' THEN source_company_id ELSE resolved_entity_id END AS supplier_id,
      CASE WHEN relationship_type = 'customer' THEN resolved_entity_id ELSE source_company_id END AS customer_id, * FROM m WHERE resolution_status = 'resolved')
      SELECT supplier_id, customer_id, source_document_id, publication_datetime AS effective_start, publication_datetime + INTERVAL 550 DAY AS effective_end, relationship_confidence FROM o WHERE supplier_id <> customer_id"""),
    "edge_collapse": oracle(["edges"], "SELECT * FROM edges"),
    "edge_conflicts": oracle(["evidence"], """SELECT supplier_id, customer_id, source_document_id, count(DISTINCT relationship_confidence) AS relationship_confidence, count(DISTINCT economic_weight) AS economic_weight
      FROM evidence GROUP BY 1, 2, 3 HAVING count(DISTINCT relationship_confidence) > 1 OR count(DISTINCT economic_weight) > 1"""),
    "snapshot_asof": oracle(["edges"], f"{_SNAP} SELECT supplier_id, customer_id, source_document_id, effective_start, relationship_confidence FROM snap"),
    "listed_intervals": oracle(["edges", "security_master"], """j AS (SELECT e.supplier_id, e.customer_id, source_document_id,
      greatest(effective_start, CAST(a.listing_date AS TIMESTAMP), CAST(b.listing_date AS TIMESTAMP)) AS listed_start,
      least(effective_end, CAST(a.delisting_date AS TIMESTAMP), CAST(b.delisting_date AS TIMESTAMP)) AS listed_end
      FROM edges e JOIN security_master a ON a.security_id = supplier_id JOIN security_master b ON b.security_id = customer_id) SELECT * FROM j WHERE listed_start < listed_end"""),
    "active_edges_yearly": oracle(["edges"], f"{_YEARLY} SELECT year, active_edges, connected_stocks, suppliers, customers, round(med, 6) AS median_age_days FROM yearly"),
    "consecutive_runs": oracle(["evidence"], """n AS (SELECT DISTINCT CAST(CAST(publication_datetime AS DATE) - DATE '1970-01-01' AS INTEGER) AS v FROM evidence),
      g AS (SELECT v, v - row_number() OVER (ORDER BY v) AS i FROM n) SELECT min(v) AS run_start, max(v) AS run_end, count(*) AS run_length FROM g GROUP BY i"""),
    "interval_overlaps": oracle(["aliases"], """w AS (SELECT *, max(valid_to) OVER e AS reach, max(CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END) OVER e AS o FROM aliases
      WINDOW e AS (PARTITION BY alias ORDER BY valid_from NULLS FIRST, valid_to NULLS LAST, entity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT entity_id, alias, valid_from, valid_to FROM w WHERE coalesce(o = 1, false) OR coalesce(valid_from < reach, false)"""),
    "degree": oracle(["edges"], f"{_NODES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree, count(DISTINCT other) AS total_degree FROM nodes GROUP BY node"),
    "node_roles": oracle(["edges"], f"{_NODES}, r AS (SELECT node, CASE WHEN max(o) = 1 AND min(o) = 0 THEN 'both' WHEN max(o) = 1 THEN 'supplier' ELSE 'customer' END AS role FROM nodes GROUP BY node) SELECT role, count(*) AS nodes FROM r GROUP BY role"),
    "edge_age_buckets": oracle(["edges"], f"""a AS (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(effective_start)) / 86400000000.0 AS age FROM edges
      WHERE effective_start <= TIMESTAMP '{AS_OF}' AND effective_end > TIMESTAMP '{AS_OF}'),
      b AS (SELECT CASE WHEN age <= 90 THEN '0-90' WHEN age <= 180 THEN '91-180' WHEN age <= 365 THEN '181-365' ELSE '366+' END AS bucket, count(*) AS n FROM a GROUP BY 1)
      SELECT d.bucket, coalesce(n, 0) AS edge_count FROM (VALUES ('0-90'), ('91-180'), ('181-365'), ('366+')) AS d(bucket) LEFT JOIN b ON b.bucket = d.bucket"""),
    "coverage_summary": oracle(["edges"], _MENTIONS + """, a AS (SELECT count(*) AS mentions, count(*) FILTER (name_class = 'named') AS explicit_mentions, count(*) FILTER (resolution_status = 'resolved') AS resolved_mentions,
      min(publication_datetime) AS first_publication, max(publication_datetime) AS last_publication FROM m),
      p AS (SELECT count(DISTINCT (supplier_id, customer_id)) AS unique_pairs, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT customer_id) AS customers, count(DISTINCT source_document_id) AS edge_documents FROM edges),
      n AS (SELECT count(DISTINCT node) AS connected_stocks FROM (SELECT supplier_id AS node FROM edges UNION ALL SELECT customer_id FROM edges))
      SELECT *, round(explicit_mentions / nullif(mentions, 0), 9) AS explicit_rate, round(resolved_mentions / nullif(explicit_mentions, 0), 9) AS resolved_rate FROM a, p, n"""),
    "yearly_disclosures": oracle(["evidence"], _MENTIONS + """, c AS (SELECT CAST(year(publication_datetime + INTERVAL 8 HOUR) AS INTEGER) AS year, count(*) AS mentions, count(*) FILTER (name_class = 'named') AS explicit_mentions, count(*) FILTER (resolution_status = 'resolved') AS resolved_mentions FROM m GROUP BY 1)
      SELECT *, round(explicit_mentions / nullif(mentions, 0), 9) AS explicit_rate, round(resolved_mentions / nullif(explicit_mentions, 0), 9) AS resolved_rate FROM c"""),
    "source_documents": oracle(["edges"], _MENTIONS + """, a AS (SELECT source_document_id, count(*) AS mention_count, count(DISTINCT counterparty_raw_name) AS name_count FROM m GROUP BY 1),
      b AS (SELECT source_document_id, count(DISTINCT (supplier_id, customer_id)) AS pair_count FROM edges GROUP BY 1)
      SELECT source_document_id, coalesce(mention_count, 0) AS mention_count, coalesce(name_count, 0) AS name_count, coalesce(pair_count, 0) AS pair_count FROM a FULL JOIN b USING (source_document_id)"""),
    "endpoint_diagnostics": oracle(["edges", "security_master"], """n AS (SELECT supplier_id AS id FROM edges UNION SELECT customer_id FROM edges)
      SELECT count(*) AS endpoints, count(*) FILTER (security_id IS NULL) AS absent, count(*) FILTER (security_id % 8 = 0) AS unlisted
      FROM n LEFT JOIN security_master ON id = security_id"""),
    "industry_static": oracle(["edges", "security_master"], """n AS (SELECT supplier_id AS id FROM edges UNION SELECT customer_id FROM edges)
      SELECT industry_code, count(*) AS node_count FROM n LEFT JOIN security_master ON id = security_id GROUP BY industry_code"""),
    "industry_pit_share": oracle(["edges", "security_master"], f"""{_SNAP}, {_HISTORY},
      i AS (SELECT security_id, max(industry_code) AS industry_code FROM h WHERE valid_from <= CAST(TIMESTAMP '{AS_OF}' AS DATE) AND (valid_to IS NULL OR valid_to > CAST(TIMESTAMP '{AS_OF}' AS DATE)) GROUP BY 1 HAVING count(DISTINCT industry_code) = 1),
      e AS (SELECT supplier_id AS id FROM snap UNION ALL SELECT customer_id FROM snap), c AS (SELECT industry_code, count(*) AS incidences FROM e LEFT JOIN i ON id = security_id GROUP BY 1)
      SELECT *, round(incidences / sum(incidences) OVER (), 9) AS share FROM c"""),
    "industry_pit_yearly": oracle(["edges", "security_master"], f"""{_ACTIVE}, {_HISTORY},
      e AS (SELECT year, year_end, supplier_id AS id FROM act UNION ALL SELECT year, year_end, customer_id FROM act), w AS (SELECT year, id, count(*) AS ends, min(CAST(year_end AS DATE)) AS day FROM e GROUP BY 1, 2),
      k AS (SELECT year, id, ends, count(DISTINCT industry_code) AS codes, max(industry_code) AS code FROM w LEFT JOIN h ON id = security_id AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY 1, 2, 3),
      p AS (SELECT year, CASE WHEN codes = 1 THEN code END AS code, sum(ends) AS ends, count(*) FILTER (codes > 1) AS ambiguous FROM k GROUP BY 1, 2)
      SELECT year, count(code) AS industries, CAST(coalesce(sum(ends) FILTER (code IS NOT NULL), 0) AS BIGINT) AS classified_ends, CAST(sum(ends) AS BIGINT) AS all_ends, CAST(sum(ambiguous) AS BIGINT) AS ambiguous_nodes,
      round(max(ends) FILTER (code IS NOT NULL) / nullif(sum(ends) FILTER (code IS NOT NULL), 0), 9) AS largest_share FROM p GROUP BY year"""),
    "integrity_counters": oracle(["edges"], _COUNTERS),
    "exposure_counters": oracle(["edges", "security_master"], f"""{_LISTED}, {_ACTIVE.replace("FROM edges JOIN", "FROM le JOIN")}, n AS (SELECT supplier_id AS id FROM edges UNION SELECT customer_id FROM edges),
      k AS (SELECT security_id, listing_date FROM n LEFT JOIN security_master ON id = security_id)
      SELECT 'repeated_exposures' AS "check", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS actual FROM (SELECT count(*) AS n FROM act GROUP BY year, supplier_id, customer_id)
      UNION ALL SELECT 'endpoints_outside_master', count(*) FILTER (security_id IS NULL) FROM k
      UNION ALL SELECT 'endpoints_without_listing', count(*) FILTER (security_id IS NOT NULL AND listing_date IS NULL) FROM k
      UNION ALL SELECT 'repeated_evidence', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
        FROM (SELECT count(*) AS n FROM edges GROUP BY supplier_id, customer_id, CAST(effective_start + INTERVAL 8 HOUR AS DATE))"""),
    "gate_verdict": oracle(["edges", "security_master"], f"{_GATE} SELECT * FROM gate"),
    "gate_checks": oracle(["edges", "security_master"], f"""{_GATE}, ends AS (SELECT supplier_id AS id FROM edges UNION SELECT customer_id FROM edges),
      k AS (SELECT security_id, listing_date FROM ends LEFT JOIN security_master ON id = security_id), c AS ({_COUNTERS}
      UNION ALL SELECT 'repeated_exposures', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM u GROUP BY year, supplier_id, customer_id)
      UNION ALL SELECT 'endpoints_outside_master', count(*) FILTER (security_id IS NULL) FROM k
      UNION ALL SELECT 'endpoints_without_listing', count(*) FILTER (security_id IS NOT NULL AND listing_date IS NULL) FROM k)
      SELECT 'consecutive_usable_years' AS "check", CAST(longest_run AS DOUBLE) AS actual, 3.0::DOUBLE AS threshold, '>=' AS operator, longest_run >= 3 AS passed FROM gate
      UNION ALL SELECT 'usable_years_median_connected_stocks', median_connected_stocks, 50.0, '>=', coalesce(median_connected_stocks >= 50, false) FROM gate
      UNION ALL SELECT "check", CAST(actual AS DOUBLE), 0.0, '==', actual = 0 FROM c"""),
    "signal_diffusion": oracle(["edges", "returns"], f"""{_RESIDUALS}, d AS (SELECT DISTINCT date, CAST(date AS TIMESTAMP) + INTERVAL 7 HOUR AS close_at FROM r),
      a AS (SELECT DISTINCT date, supplier_id, customer_id FROM edges JOIN d ON effective_start <= close_at AND (effective_end IS NULL OR effective_end > close_at)),
      b AS (SELECT date, supplier_id AS security_id, customer_id AS other, true AS c FROM a UNION ALL SELECT date, customer_id, supplier_id, false FROM a)
      SELECT b.date, b.security_id, round(avg(residual_return) FILTER (c), 6) AS customer_shock, round(avg(residual_return) FILTER (NOT c), 6) AS supplier_shock,
      count(residual_return) FILTER (c) AS customer_neighbor_count, count(residual_return) FILTER (NOT c) AS supplier_neighbor_count, b.date AS graph_snapshot_date
      FROM b LEFT JOIN r ON r.date = b.date AND r.security_id = other GROUP BY b.date, b.security_id"""),
    "weak_components": oracle(["edges"], f"""{_SNAP}, p AS (SELECT supplier_id AS a, customer_id AS b FROM snap UNION SELECT customer_id, supplier_id FROM snap),
      reach AS (SELECT a AS node, a AS top FROM p UNION SELECT node, b FROM reach JOIN p ON a = top) SELECT node, min(top) AS component FROM reach GROUP BY node"""),
}
