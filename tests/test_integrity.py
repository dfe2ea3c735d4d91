"""Counters of names, exposures and endpoints on small tables whose answers are plain."""

from datetime import date, datetime

from asofgraph.operators import graph, integrity

AUDIT = "counterparty_raw_name string, resolved_entity_id string, resolution_status string, resolution_method string, normalized_name string"


def counts(frame):
    return {r.check: r.actual for r in frame.collect()}


def test_names_in_mentions_and_audit(spark):
    mentions = spark.createDataFrame([("Alpha Works",), (None,), ("",), ("***",)], "counterparty_raw_name string")
    rows = [
        ("Alpha Works", "A", "resolved", "exact_alias", "alphaworks"),
        ("Alpha Works", None, "resolved", "exact_alias", "alphaworks"),  # resolved without an id
        ("Beta Works", "B", "unresolved", "none", "betaworks"),  # an id without being resolved
        ("Gamma Works", None, "ambiguous", "none", "gammaworks"),  # the method of another status
        ("Delta Works", None, "unresolved", "none", "delta"),  # another normalized name
        ("Delta Works", None, "unresolved", "none", None),
        ("Delta Works", None, None, "none", "deltaworks"),
        ("***", None, "anonymous", "blocked_anonymous", None),
        ("***", "X", "resolved", "exact_alias", None), ("***", "X", "resolved", "exact_alias", None),
        ("", None, "invalid", "invalid", None), (None, None, None, None, None),
    ]
    audit = spark.createDataFrame(rows, AUDIT)
    assert counts(integrity.name_counters(mentions, audit, ascii_only=True)) == {"invalid_mention_names": 2, "invalid_audit_names": 2, "status_against_name": 8, "anonymous_nodes": 1}
    full = counts(integrity.name_counters(mentions, audit))
    assert full["status_against_name"] == 8 and full["anonymous_nodes"] == 1
    narrow = audit.drop("resolution_method", "normalized_name")
    assert counts(integrity.name_counters(mentions, narrow))["status_against_name"] == 5
    assert set(counts(integrity.name_counters(mentions.limit(0), audit.limit(0))).values()) == {0}


def test_exposures_and_endpoints(spark):
    at = datetime(2020, 5, 1, 20)  # the second of May on the market
    edges = spark.createDataFrame(
        [("A", "B", at), ("A", "B", datetime(2020, 5, 2, 1)), ("A", "B", datetime(2020, 5, 1, 1)), ("A", "C", None), ("A", "C", None), ("D", "A", at)],
        "supplier_id string, customer_id string, effective_start timestamp")
    master = spark.createDataFrame([("A", date(2000, 1, 1)), ("B", date(2000, 1, 1)), ("C", None)], "security_id string, listing_date date")
    exposures = spark.createDataFrame([(2020, "A", "B"), (2020, "A", "B"), (2020, "A", "B"), (2021, "A", "B"), (2020, "B", "A")], "year int, supplier_id string, customer_id string")
    found = counts(integrity.exposure_counters(edges, exposures, master))
    assert found == {"repeated_exposures": 2, "endpoints_outside_master": 1, "endpoints_without_listing": 1}
    assert counts(integrity.repeated_evidence(edges)) == {"repeated_evidence": 1}
    assert set(counts(integrity.exposure_counters(edges.limit(0), exposures.limit(0), master)).values()) == {0}
    verdict = graph.gate(spark.createDataFrame([(2020, 9, 9)], "year int, active_edges long, connected_stocks long"), 1, 1, 1, 1.0)
    records = {r.check: r.passed for r in graph.check_records(verdict, integrity.exposure_counters(edges, exposures, master), 1, 1.0).collect()}
    assert records == {"consecutive_usable_years": True, "usable_years_median_connected_stocks": True, **dict.fromkeys(found, False)}
