"""What must not be let through: each case is an error or a marked row, never a wrong number."""

from datetime import date
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from asofgraph.operators import graph, market, portfolio, refusals, residuals, resolve, statistics

D = [date(2023, 8, k) for k in (24, 25, 28, 29)]
FEES = "kind string, side string, valid_from date, valid_to date, rate double"
TERMS = "valid_from date, valid_to date, offset int"


def tables(spark, volume=100.0):
    calendar = spark.createDataFrame([(d,) for d in D], "date date")
    panel = spark.createDataFrame(
        [(d, "A", p, 1e6, volume > 0, False, False, False) for d, p in zip(D, (99.0, 100.0, 110.0, 111.0))],
        "date date, security_id string, open double, amount double, tradable boolean, suspended boolean, limit_up boolean, limit_down boolean")
    weights = spark.createDataFrame([(D[0], "A", 0.5)], "signal_date date, security_id string, target_weight double")
    return weights, panel, calendar


def fees(spark, start=date(2000, 1, 1), end=date(2099, 1, 1)):
    return spark.createDataFrame([("stamp_tax", "sell", start, end, 0.001), ("handling", "both", start, end, 0.0001)], FEES)


def terms(spark, *rows):
    return spark.createDataFrame(rows or [(date(2000, 1, 1), date(2099, 1, 1), 1)], TERMS)


def test_dates_without_fee_or_settlement_rule_are_errors(spark):
    good = portfolio.round_trips(*tables(spark), fees(spark), terms(spark)).first()
    assert good.status == "CLOSED" and good.exit_stamp_tax_cost == pytest.approx(0.55 * 0.001) and good.entry_venue_fee_cost == pytest.approx(0.5 * 0.0001)
    with pytest.raises(Exception, match="no fee rule on"):
        portfolio.round_trips(*tables(spark), fees(spark, end=D[1]), terms(spark)).collect()
    for rules in ([(D[2], D[3], 1)], [(D[0], D[3], 1), (D[1], D[1], 2)]):
        with pytest.raises(Exception, match="not one settlement rule on"):
            portfolio.round_trips(*tables(spark), fees(spark), terms(spark, *rules)).collect()
    rejected = portfolio.round_trips(*tables(spark, volume=0.0), fees(spark, end=D[0]), terms(spark, (D[3], D[3], 1))).first()
    assert (rejected.status, rejected.total_cost) == ("ENTRY_REJECTED", 0.0)  # no leg, no rule needed


def test_weights_above_the_cap_and_slippage(spark):
    signals = spark.createDataFrame([(D[0], f"S{k:02d}", float(k)) for k in range(10)], "date date, security_id string, s double")
    assert portfolio.quantile_weights(signals, "s", cap=0.25).count() == 4
    with pytest.raises(Exception, match="above 0.2"):
        portfolio.quantile_weights(signals, "s", cap=0.2).collect()
    assert portfolio.default_slippage([5, 10, 20]) == 10.0 and portfolio.default_slippage([7, 8]) == 7.0
    with pytest.raises(ValueError):
        portfolio.default_slippage([])


def test_what_trades_has_volume_and_amount(spark):
    master = spark.createDataFrame([("A", D[0], None, "MAIN")], "security_id string, listing_date date, delisting_date date, board string")
    calendar = spark.createDataFrame([(d,) for d in D], "date date")
    quotes = spark.createDataFrame([(D[0], "A", 10.0, 10.0, 10.0, 10.0, 5.0, 50.0, False, False), (D[1], "A", 10.0, 10.0, 10.0, 10.1, 0.0, 0.0, False, False), (D[2], "A", 10.0, 30.0, 10.0, 30.0, 5.0, 50.0, False, False)],
                                   "date date, security_id string, open double, high double, low double, close double, volume double, amount double, is_suspended boolean, is_st boolean")
    actions = spark.createDataFrame([], "date date, security_id string, share_multiplier double, cash_dividend double, reference_price double")
    rules = spark.createDataFrame([("MAIN", D[0], D[3], 0.1, 0.05, 0)], "board string, valid_from date, valid_to date, ordinary_pct double, st_pct double, ipo_days int")
    panel = market.build_panel(master, calendar, quotes, actions, rules)
    assert [r.tradable for r in panel.orderBy("date").collect()] == [True, False, True, False]
    with pytest.raises(Exception, match="beyond its price limit"):
        market.refuse_beyond_limits(panel).collect()
    with pytest.raises(Exception, match="several price-limit rules"):
        market.build_panel(master, calendar, quotes, actions, rules.union(rules)).collect()


def test_two_industries_at_once_are_an_error(spark):
    panel = spark.createDataFrame([(D[0], "A", 0.1), (D[2], "A", 0.2), (D[2], "B", 0.4)], "date date, security_id string, raw_return double")
    history = [("A", "X", D[0], D[1]), ("A", "Y", D[1], None), ("B", "Y", D[0], None)]
    schema = "security_id string, industry_code string, valid_from date, valid_to date"
    found = {(r.date, r.security_id): (r.industry_code, r.industry_return and round(r.industry_return, 9)) for r in residuals.leave_one_out(panel, spark.createDataFrame(history, schema)).collect()}
    assert found == {(D[0], "A"): ("X", None), (D[2], "A"): ("Y", 0.4), (D[2], "B"): ("Y", 0.2)}
    with pytest.raises(Exception, match="several industries"):
        residuals.attach_industry(panel, spark.createDataFrame([*history, ("A", "Z", D[2], None)], schema)).collect()


def test_edges_to_itself_or_nowhere_are_errors_and_filters_come_first(spark):
    schema = "supplier_id string, customer_id string, effective_start timestamp, effective_end timestamp"
    returns = spark.createDataFrame([(D[0], "A", 0.1), (D[0], "B", 0.2)], "date date, security_id string, residual_return double")
    at = "2023-08-01 00:00:00"
    rows = spark.sql(f"SELECT * FROM VALUES ('A', 'B', TIMESTAMP '{at}', CAST(NULL AS TIMESTAMP)), ('A', 'A', TIMESTAMP '{at}', NULL), ('A', NULL, TIMESTAMP '{at}', NULL) AS t(supplier_id, customer_id, effective_start, effective_end)")
    with pytest.raises(Exception, match="an edge"):
        graph.diffusion_signals(rows, returns).collect()
    kept = rows.filter("customer_id IS NOT NULL AND supplier_id <> customer_id").groupBy("supplier_id", "customer_id").agg(F.min("effective_start").alias("effective_start"), F.max("effective_end").alias("effective_end"))
    assert graph.diffusion_signals(kept, returns).count() == 2 and kept.schema.names == schema.replace(",", "").split()[::2]


def test_evidence_that_disagrees(spark):
    rows = spark.sql("SELECT 'A' AS supplier_id, 'B' AS customer_id, 'd' AS source_document_id, TIMESTAMP '2020-01-01' AS publication_datetime, TIMESTAMP '2020-01-01' AS effective_start, TIMESTAMP '2021-01-01' AS effective_end, x AS source_company_id, 0.5D AS relationship_confidence FROM VALUES ('A'), ('C') AS v(x)")
    edge = graph.collapse(rows.filter("source_company_id = 'A'"), strict=True).first()
    assert (edge.source_company_id, edge.economic_weight, edge.weight_source) == ("A", 1.0, "equal")
    with pytest.raises(Exception, match="disagrees in source_company_id"):
        graph.collapse(rows, strict=True).collect()
    chain = spark.range(40).selectExpr("id AS supplier_id", "id + 1 AS customer_id")
    with pytest.raises(RuntimeError):
        graph.weak_components(chain, rounds=2)
    assert {r.component for r in graph.weak_components(chain).collect()} == {0}


def test_mentions_and_overrides_are_matched_once(spark):
    mentions = spark.createDataFrame([("d", "c", "Acme Co"), ("d", "c", "Other")], "source_document_id string, source_company_id string, counterparty_raw_name string").withColumn("publication_datetime", F.lit("2020-01-02").cast("timestamp"))
    aliases = spark.createDataFrame([("E1", "acme", None, None)], "entity_id string, alias string, valid_from date, valid_to date")
    override = spark.createDataFrame([("other", "E2")], "normalized_name string, entity_id string")
    audit = resolve.resolve(mentions, aliases, override, fuzzy=False)
    assert {(r.resolved_entity_id, r.notes) for r in audit.collect()} == {("E1", "exact_alias_valid_at_publication"), ("E2", "version_controlled_manual_override")}
    assert resolve.attach_resolution(mentions, audit).count() == 2
    with pytest.raises(Exception, match="given twice"):
        resolve.resolve(mentions, aliases, override.union(override), fuzzy=False).collect()
    with pytest.raises(Exception, match="no audit row"):
        resolve.attach_resolution(mentions, audit.filter("resolved_entity_id = 'E1'")).collect()
    with pytest.raises(Exception, match="several audit rows"):
        resolve.attach_resolution(mentions, audit.union(audit)).collect()


def test_refuse_names_what_is_broken(spark):
    rows = spark.createDataFrame([(1, 2), (1, -2)], "a int, b int")
    assert refusals.refuse(rows, "rows", {"b": F.col("b") > 5}) is rows
    with pytest.raises(ValueError, match="negative b; repeated a"):
        refusals.refuse(rows, "rows", {"negative b": F.col("b") < 0}, ["a"])
    with pytest.raises(ValueError, match="no rows"):
        refusals.refuse(rows.limit(0), "rows", {}, empty=True)


def test_permutation_and_sign_tests(spark):
    for values in ([1, 2, 3, 4, 5, 6], [3, 1, 2, 2, 5], [90, 74, 90, 86, 76, 62], [1, 1, 1]):
        score = lambda v: abs(sum((b > a) - (b < a) for k, a in enumerate(v) for b in v[k + 1:]))
        plain = [score(p) >= score(values) for p in permutations(values)]
        assert statistics.permutation_p(values) == pytest.approx(sum(plain) / len(plain))
    assert statistics.permutation_p([90, 74, 90, 86, 76, 62, 116]) == pytest.approx(0.88413, abs=1e-5)  # published figures
    assert statistics.permutation_p([12446, 16617, 18426, 20506, 20732, 22787, 26642, 32885]) == pytest.approx(4.96e-5, abs=1e-7)
    found = spark.createDataFrame([(0, 6), (3, 3), (0, 0)], "u int, d int").select(statistics.sign_test(F.col("u"), F.col("d")).alias("p")).collect()
    assert [r.p for r in found] == [2 / 64, 1.0, 1.0]


def test_gate_takes_the_median_of_usable_years(spark):
    years = [(2015, 9, 90), (2016, 1, 5), (2017, 9, 40), (2018, 9, 60), (2019, 9, 50), (2020, 0, 0)]
    yearly = spark.createDataFrame(years, "year int, active_edges long, connected_stocks long")
    found = graph.gate(yearly, 5, 10, 3, 50.0)
    assert found.first().asDict() == {"usable_years": 3, "median_connected_stocks": 50.0, "longest_run": 3, "passed": True, "outcome": "FEASIBLE"}
    none = graph.gate(yearly, 5, 10, 4, 1.0)
    assert none.first().asDict() == {"usable_years": 0, "median_connected_stocks": None, "longest_run": 3, "passed": False, "outcome": "INFEASIBLE_DATA"}
    counters = spark.createDataFrame([("self_edges", 0), ("duplicate_keys", 2)], "check string, actual long")
    records = {r["check"]: (r.actual, r.operator, r.passed) for r in graph.check_records(none, counters, 4, 1.0).collect()}
    assert records == {"consecutive_usable_years": (3.0, ">=", False), "usable_years_median_connected_stocks": (None, ">=", False), "self_edges": (0.0, "==", True), "duplicate_keys": (2.0, "==", False)}
