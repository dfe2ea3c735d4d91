"""Operators against hand-computed values, plus order and future invariance."""

import datetime as dt
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofgraph.functions import names
from asofgraph.operators import contracts, graph, intervals, market, portfolio, quality, residuals, resolve, statistics
from asofgraph.plans import registry
from asofgraph.sources import assets, tables
from asofgraph.streaming.edges import disclosure_counts, edge_stream

D, TS = dt.date, dt.datetime
EDGES = "supplier_id string, customer_id string, effective_start timestamp, effective_end timestamp"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def shocks(spark):
    edges = spark.createDataFrame([
        ("S1", "C1", TS(2020, 1, 2, 7), None), ("S1", "C2", TS(2020, 1, 3, 8, 0, 1), None), ("S1", "C2", TS(2020, 1, 3, 8, 0, 1), None), ("S2", "C2", TS(2020, 1, 2, 7), TS(2020, 1, 4, 7))], EDGES)
    values = {"S1": 0.01, "S2": 0.03, "C1": 0.02, "C2": 0.04}
    residual = spark.createDataFrame([(D(2020, 1, d), k, v) for d in (2, 3, 6) for k, v in values.items()], "date date, security_id string, residual_return double")
    return edges, residual


def test_neighbour_shocks(spark, shocks):
    edges, residual = shocks
    found = {(r.date.day, r.security_id): r for r in graph.diffusion_signals(edges, residual).collect()}
    assert [(found[d, "S1"].customer_shock, found[d, "S1"].customer_neighbor_count) for d in (2, 3, 6)] == [(0.02, 1), (0.02, 1), (pytest.approx(0.03), 2)]
    assert found[3, "C2"].supplier_shock == 0.03 and found[6, "C2"].supplier_shock == 0.01
    assert found[3, "S1"].graph_snapshot_date == D(2020, 1, 3) and (6, "S2") not in found
    holed = residual.withColumn("residual_return", F.when(~((F.col("date") == "2020-01-03") & (F.col("security_id") == "C2")), F.col("residual_return")))
    again = {(r.date.day, r.security_id): r.customer_shock for r in graph.diffusion_signals(edges, holed).collect()}
    assert again[3, "S1"] == 0.02 and again[3, "S2"] is None


def test_shocks_ignore_order_and_future(spark, shocks):
    edges, residual = shocks
    key = ("date", "security_id")
    base = rows(graph.diffusion_signals(edges, residual), *key)
    assert rows(graph.diffusion_signals(edges.orderBy(F.rand(3)), residual.orderBy(F.rand(4))), *key) == base
    later = residual.union(spark.createDataFrame([(D(2020, 1, 9), "C1", 9.0)], residual.schema))
    more = edges.union(spark.createDataFrame([("S2", "C1", TS(2020, 1, 8), None)], EDGES))
    assert [r for r in rows(graph.diffusion_signals(more, later), *key) if r[0] < D(2020, 1, 8)] == base


def test_snapshot_is_half_open_and_latest(spark):
    edges = spark.createDataFrame([("a", "b", "d1", TS(2020, 4, 30, 10), TS(2021, 4, 30, 10), 0.9), ("a", "b", "d2", TS(2020, 4, 30, 10), TS(2021, 4, 30, 10), None)],
                                  "supplier_id string, customer_id string, source_document_id string, effective_start timestamp, effective_end timestamp, relationship_confidence double")
    at = lambda t: rows(graph.snapshot(edges, F.lit(t)).select("source_document_id"))
    assert at(TS(2020, 4, 30, 9, 59, 59)) == [] and at(TS(2020, 4, 30, 10)) == [("d1",)] and at(TS(2021, 4, 30, 10)) == []


def test_orientation_and_self_edges(spark):
    mentions = spark.createDataFrame([("A", "B", "customer", "resolved"), ("A", "C", "supplier", "resolved"), ("A", "A", "customer", "resolved"), ("A", None, "customer", "resolved"), ("A", " ", "customer", "resolved"), ("A", "D", "customer", "ambiguous")],
                                     "source_company_id string, resolved_entity_id string, relationship_type string, resolution_status string").withColumns({"publication_datetime": F.lit(TS(2020, 1, 1)), "source_document_id": F.lit("x")})
    edges = graph.orient(mentions)
    assert rows(edges.select("supplier_id", "customer_id"), "supplier_id") == [("A", "B"), ("C", "A")]
    assert edges.first().effective_end - TS(2020, 1, 1) == dt.timedelta(days=550)


def test_runs_islands_overlaps(spark):
    assert rows(intervals.consecutive_runs(spark.createDataFrame([(y,) for y in (2015, 2016, 2018, 2018, 2019, 2020)], "y int"), "y"), "run_start") == [(2015, 2016, 2), (2018, 2020, 3)]
    held = spark.createDataFrame([("k", 0, 3), ("k", 3, 5), ("k", 7, 9), ("k", 8, 8), ("k", 1, 2)], "k string, a int, b int")
    assert rows(intervals.islands(held, ["k"], "a", "b"), "a") == [("k", 0, 5), ("k", 7, 9)]
    rules = spark.createDataFrame([("x", 1, 5), ("x", 5, 9), ("y", 1, None), ("y", 3, 4)], "k string, a int, b int")
    assert rows(intervals.overlaps(rules, ["k"], "a", "b", inclusive=False)) == [("y", 3, 4)]
    assert sorted(rows(intervals.overlaps(rules, ["k"], "a", "b"))) == [("x", 5, 9), ("y", 3, 4)]


def quotes(spark, prices):
    return spark.createDataFrame([(D(2023, 1, d), "A", *([p] * 4 if p else [None] * 4), 10.0, 1000.0, s, False) for d, p, s in prices],
                                 "date date, security_id string, open double, high double, low double, close double, volume double, amount double, is_suspended boolean, is_st boolean")


def build(spark, prices, days, actions=(), pct=((D(2000, 1, 1), D(2023, 1, 3), 0.10), (D(2023, 1, 4), D(2099, 1, 1), 0.20))):
    master = spark.createDataFrame([("A", D(2023, 1, 1), None, "MAIN")], "security_id string, listing_date date, delisting_date date, board string")
    calendar = spark.createDataFrame([(D(2023, 1, d),) for d in days], "date date")
    acts = spark.createDataFrame(list(actions), "date date, security_id string, share_multiplier double, cash_dividend double, reference_price double")
    rules = spark.createDataFrame([("MAIN", a, b, p, None, 0) for a, b, p in pct], "board string, valid_from date, valid_to date, ordinary_pct double, st_pct double, ipo_days int")
    return {r.date.day: r for r in market.build_panel(master, calendar, quotes(spark, prices), acts, rules).collect()}


def test_market_limits_suspension_gaps_splits(spark):
    panel = build(spark, [(2, 100.0, False), (3, 110.0, False), (4, 110.0, True), (5, 132.0, False)], (2, 3, 4, 5))
    assert [panel[d].price_state for d in (2, 3, 4, 5)] == ["no_limit", "limit_up", "suspended", "limit_up"]
    assert panel[4].raw_return is None and panel[5].raw_return == pytest.approx(0.2) and [panel[d].listing_age for d in (2, 3, 4, 5)] == [0, 1, 2, 3]
    assert panel[3].locked and not panel[3].tradable
    gap = build(spark, [(2, 100.0, False), (4, 101.0, False)], (2, 3, 4))
    assert gap[4].previous_close is None and gap[4].raw_return is None and gap[3].price_state == "unavailable"
    split = build(spark, [(2, 100.0, False), (3, 50.0, False)], (2, 3), [(D(2023, 1, 3), "A", 2.0, 0.0, None)])
    assert split[3].raw_return == 0 and split[3].reference == 50
    assert build(spark, [(2, 100.0, False), (3, 120.0, False)], (2, 3))[3].beyond_limit


def test_leave_one_out(spark):
    panel = spark.createDataFrame([(D(2020, 1, 2), k, v) for k, v in (("A", 0.1), ("B", 0.2), ("C", 0.3))], "date date, security_id string, raw_return double")
    history = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "Y")], "security_id string, industry_code string").withColumns({"valid_from": F.lit(D(2000, 1, 1)), "valid_to": F.lit(None).cast("date")})
    found = {r.security_id: (r.industry_return, r.industry_peer_count) for r in residuals.leave_one_out(panel, history).collect()}
    assert found == {"A": (pytest.approx(0.2), 1), "B": (pytest.approx(0.1), 1), "C": (None, 0)}


def test_rolling_beta_equals_least_squares_and_ignores_today(spark):
    draw = np.random.default_rng(0)
    m, i, e = draw.standard_normal((3, 40)) * 0.01
    y = 0.001 + 1.3 * m + 0.4 * i + e / 10
    days = [D(2020, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    frame = lambda v: spark.createDataFrame([(d, "A", float(x)) for d, x in zip(days, v, strict=True)], "date date, security_id string, raw_return double")
    factor = spark.createDataFrame([(d, float(x)) for d, x in zip(days, m, strict=True)], "date date, market_return double")
    industry = spark.createDataFrame([(d, "A", float(x)) for d, x in zip(days, i, strict=True)], "date date, security_id string, industry_return double")
    found = {r.date: r for r in residuals.residual_returns(frame(y), factor, industry, window=15, lag=1, least=5).collect()}
    fit = np.linalg.lstsq(np.column_stack((np.ones(15), m[15:30], i[15:30])), y[15:30], rcond=None)[0]
    at = found[days[30]]
    assert (at.alpha, at.beta_market, at.beta_industry) == pytest.approx(tuple(fit), rel=1e-8) and at.residual_model == "market_plus_pit_industry"
    moved = y.copy()
    moved[30] += 0.5
    changed = {r.date: r for r in residuals.residual_returns(frame(moved), factor, industry, window=15, lag=1, least=5).collect()}
    assert changed[days[30]].residual_return - at.residual_return == pytest.approx(0.5) and changed[days[30]].beta_market == at.beta_market
    assert found[days[2]].beta_market is None and found[days[2]].residual_model == "market_only"
    short = {r.date: r for r in residuals.residual_returns(frame(y).filter(F.col("date") < days[35]), factor.filter(F.col("date") < days[35]), industry, window=15, lag=1, least=5).collect()}
    assert all(short[d].residual_return == found[d].residual_return for d in days[:35])


def test_information_coefficient(spark):
    signals = spark.createDataFrame([(D(2020, 1, 3), k, v) for k, v in (("A", 1.0), ("B", 2.0), ("C", 3.0))], "date date, security_id string, customer_shock double")
    returns = [(D(2020, 1, 3), "A", 0.0)] + [(D(2020, 1, 6), k, v) for k, v in (("A", -0.1), ("B", 0.0), ("C", 0.2))]
    make = lambda r: spark.createDataFrame(r, "date date, security_id string, residual_return double")
    found = statistics.information_coefficients(signals, make(returns)).first()
    assert found.rank_ic == pytest.approx(1) and found.forward_return_date == D(2020, 1, 6)
    assert statistics.information_coefficients(signals, make(returns[:-1] + [(D(2020, 1, 6), "C", None), (D(2020, 1, 7), "C", 1.0)])).first().eligible_count == 2


def test_published_statistics(spark):
    low, high = statistics.wilson(F.lit(690), F.lit(37030))
    assert tuple(spark.range(1).select(low, high).first()) == pytest.approx((0.0173053, 0.0200616), abs=1e-7)
    series = spark.createDataFrame(list(zip(range(2015, 2023), (12446, 16617, 18426, 20506, 20732, 22787, 26642, 32885), strict=True)), "year int, n int")
    assert tuple(statistics.trend(series, "year", "n").first()) == (2075.75, 1.0)
    edges = spark.createDataFrame(list(zip(range(2016, 2023), (90, 74, 90, 86, 76, 62, 116), strict=True)), "year int, n int")
    assert tuple(statistics.trend(edges, "year", "n").first()) == pytest.approx((-1.33333, -0.09759), abs=1e-5)
    values = spark.createDataFrame([(float(v),) for v in (0.01, -0.02, 0.03, 0.005, 0.02, -0.01)], "v double").withColumn("o", F.monotonically_increasing_id())
    x = np.array([0.01, -0.02, 0.03, 0.005, 0.02, -0.01]) - 0.035 / 6
    plain = (x @ x + 2 * (2 / 3 * (x[1:] @ x[:-1]) + 1 / 3 * (x[2:] @ x[:-2]))) / 6
    assert statistics.newey_west(values, "v", "o", 2).first().standard_error == pytest.approx(math.sqrt(plain / 6))


def test_placebo_keeps_degrees_and_bootstrap_repeats(spark):
    pairs = spark.createDataFrame([("S1", "C1"), ("S1", "C2"), ("S2", "C2"), ("S2", "C3"), ("S3", "C4"), ("S4", "C1")], "supplier_id string, customer_id string")
    base, found = sorted(map(tuple, pairs.collect())), {}
    for r in statistics.placebo_edges(pairs, 5).collect():
        found.setdefault(r.seed, []).append((r.supplier_id, r.customer_id))
    for made in found.values():
        assert sorted(a for a, _ in made) == sorted(a for a, _ in base) and sorted(b for _, b in made) == sorted(b for _, b in base) and sorted(made) != base and len(set(made)) == 6
    series = spark.createDataFrame([(k, float(k)) for k in range(30)], "o int, v double")
    one, two = (rows(statistics.block_bootstrap(series, "v", "o", 5, 20, 1), "replication") for _ in range(2))
    assert one == two and len({m for _, m in one}) > 10


def test_placebo_of_a_dense_graph_and_seeds_that_fail(spark):
    base = [(a, b) for a in range(40) for b in range(40) if a != b and (a * 7 + b * 11) % 5 < 2]
    found = {}
    for r in statistics.placebo_edges(spark.createDataFrame(base, "supplier_id long, customer_id long"), 3).collect():
        found.setdefault(r.seed, []).append((r.supplier_id, r.customer_id))
    assert sorted(found) == [0, 1, 2] and len({tuple(sorted(m)) for m in found.values()}) == 3
    for made in found.values():
        assert len(set(made)) == len(made) == len(base) and all(a != b for a, b in made)
        assert len(set(made) & set(base)) < 0.7 * len(base)
        assert all(sorted(e[k] for e in made) == sorted(e[k] for e in base) for k in (0, 1))
    full = spark.createDataFrame([(a, b) for a in (1, 2) for b in (3, 4)], "supplier_id long, customer_id long")
    assert sorted(map(tuple, statistics.placebo_edges(full, 2).collect())) == [(0, None, None), (1, None, None)]


def test_registered_placebo_takes_the_whole_snapshot(spark):
    d = "/root/testdata/sf0.01"
    snap = {(r.supplier_id, r.customer_id) for r in registry.queries()["snapshot_asof"](spark, d).collect()}
    made = [(r.supplier_id, r.customer_id) for r in registry.queries()["placebo"](spark, d).filter("seed = 3").collect()]
    assert len(set(made)) == len(made) == len(snap) and sorted(a for a, _ in made) == sorted(a for a, _ in snap)


def test_registered_components_match_union_find(spark):
    d = "/root/testdata/sf0.001"
    edges = [(r.supplier_id, r.customer_id) for r in registry.queries()["snapshot_asof"](spark, d).collect()]
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert edges and {r.node: r.component for r in registry.queries()["weak_components"](spark, d).collect()} == {k: find(k) for k in root}


def test_age_buckets_cover_every_active_edge(spark):
    d, now = "/root/testdata/sf0.001", TS(1998, 6, 30, 10)
    age = [(now - r.effective_start) / dt.timedelta(1) for r in registry.queries()["edge_collapse"](spark, d).collect() if r.effective_start <= now < r.effective_end]
    found = {r.bucket: r.edge_count for r in registry.queries()["edge_age_buckets"](spark, d).collect()}
    assert sum(found.values()) == len(age) and found["366+"] == sum(a > 365 for a in age) > 0
    few = spark.createDataFrame([("S1", "C1", TS(1998, 6, 1)), ("S2", "C1", TS(1997, 1, 1))], "supplier_id string, customer_id string, effective_start timestamp")
    assert {r.bucket: r.edge_count for r in graph.age_buckets(few, F.lit(now)).collect()} == {"0-90": 1, "91-180": 0, "181-365": 0, "366+": 1}


def test_quantile_weights(spark):
    signals = spark.createDataFrame([(D(2020, 1, 2), f"S{k:02d}", float(k)) for k in range(10)], "date date, security_id string, s double")
    found = {r.security_id: r.target_weight for r in portfolio.quantile_weights(signals, "s").collect()}
    assert found == {"S00": -0.25, "S01": -0.25, "S08": 0.25, "S09": 0.25}
    weights = portfolio.quantile_weights(signals, "s")
    assert portfolio.weight_check(weights).first().valid and not portfolio.weight_check(weights, cap=0.2).first().valid


def fees(spark):
    return spark.createDataFrame([("stamp_tax", "sell", D(2000, 1, 1), D(2023, 8, 27), 0.001), ("stamp_tax", "sell", D(2023, 8, 28), D(2099, 1, 1), 0.0005)], "kind string, side string, valid_from date, valid_to date, rate double")


def test_round_trip_costs_and_daily_reconciliation(spark):
    days = [D(2023, 8, 24), D(2023, 8, 25), D(2023, 8, 28), D(2023, 8, 29)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    panel = spark.createDataFrame([(d, k, p, 1e9, True, False, False, False) for k, ps in (("LONG", (100, 100, 110, 110)), ("SHORT", (100, 100, 90, 90))) for d, p in zip(days, map(float, ps), strict=True)],
                                  "date date, security_id string, open double, amount double, tradable boolean, suspended boolean, limit_up boolean, limit_down boolean")
    weights = spark.createDataFrame([(days[0], "LONG", 0.5), (days[0], "SHORT", -0.5)], "signal_date date, security_id string, target_weight double")
    settlement = spark.createDataFrame([(D(2000, 1, 1), D(2099, 1, 1), 1)], "valid_from date, valid_to date, offset int")
    trades = portfolio.round_trips(weights, panel, calendar, fees(spark), settlement)
    found = {r.security_id: r for r in trades.collect()}
    long, short = found["LONG"], found["SHORT"]
    assert long.entry_date == days[1] and long.exit_date == days[2] and long.gross_pnl == pytest.approx(0.05) and short.gross_pnl == pytest.approx(0.05)
    assert long.stamp_tax_cost == pytest.approx(0.55 * 0.0005) and short.stamp_tax_cost == pytest.approx(0.5 * 0.001)
    assert long.commission_cost == pytest.approx(1.05 * 0.0003) and long.slippage_cost == pytest.approx(1.05 * 0.001)
    daily = {r.date: r for r in portfolio.daily_pnl(trades, calendar).collect()}
    assert daily[days[1]].gross_exposure == pytest.approx(1) and daily[days[1]].net_exposure == pytest.approx(0) and daily[days[2]].gross_exposure == pytest.approx(0)
    assert sum(r.net_pnl for r in daily.values()) == pytest.approx(long.net_pnl + short.net_pnl)


def test_deferred_exit_and_block_reasons(spark):
    days = [D(2023, 1, d) for d in (2, 3, 4, 5, 6)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    schema = "date date, security_id string, open double, amount double, tradable boolean, suspended boolean, limit_up boolean, limit_down boolean"
    panel = spark.createDataFrame([(days[0], "A", 1.0, 9.0, True, False, False, False), (days[1], "A", 1.0, 9.0, True, False, False, False), (days[2], "A", 1.0, 9.0, True, False, False, True), (days[3], "A", 1.0, 9.0, False, True, False, False),
                                   (days[4], "A", 2.0, 9.0, True, False, False, False), (days[1], "B", 1.0, 9.0, True, False, True, False), (days[1], "C", None, 9.0, True, False, False, False), (days[1], "D", 1.0, 1.0, True, False, False, False),
                                   (days[1], "E", 1.0, 9.0, False, False, False, False), (days[1], "G", 1.0, 9.0, True, True, True, False)], schema)
    weights = spark.createDataFrame([(days[0], k, 0.1) for k in "ABCDEFG"] + [(days[4], "A", 0.1)], "signal_date date, security_id string, target_weight double")
    settlement = spark.createDataFrame([(D(2000, 1, 1), D(2099, 1, 1), 1)], "valid_from date, valid_to date, offset int")
    found = {(r.security_id, r.signal_date.day): r for r in portfolio.round_trips(weights, panel, calendar, fees(spark), settlement, least_amount=5.0).collect()}
    assert (found["A", 2].exit_date, found["A", 2].exit_defer_count, found["A", 2].holding_period_trading_days) == (days[4], 2, 3)
    assert [found[k, 2].entry_block_reason for k in "BCDEFG"] == ["limit_up_buy_locked", "missing_open", "below_minimum_liquidity", "not_tradable", "missing_market_row", "suspended"]
    assert found["A", 6].entry_block_reason == "no_next_trading_day" and found["A", 6].total_cost == 0


NAMES = {" 腾讯控股有限公司 ": "腾讯控股", "Ａｃｍｅ Corp.": "acme", "co": "co", "有限公司": "有限公司", "A-B (Holdings), Ltd": "abholdings", "贵州茅台集团股份有限公司": "贵州茅台"}
CLASSES = {"": "invalid", "N/A": "invalid", "无、不适用": "invalid", "--": "anonymous", "***": "anonymous", "客户A": "anonymous", "第一名": "anonymous", "某公司": "anonymous", "张*": "anonymous", "*ST 海航": "named", "10*20 型材厂": "named", "Acme": "named", "。。": "invalid",
           "Customer B2": "anonymous"}


def test_names(spark):
    frame = spark.createDataFrame([(k,) for k in NAMES], "n string")
    assert dict(rows(frame.select("n", names.normalize_name(F.col("n"))))) == NAMES
    frame = spark.createDataFrame([(k,) for k in CLASSES], "n string")
    assert dict(rows(frame.select("n", names.classify_name(F.col("n"))))) == CLASSES
    text = spark.createDataFrame([("主要客户：甲乙丙公司，供应商名称: 丁戊。；客户：甲乙丙公司\n",)], "t string")
    assert tuple(text.select(names.extract_candidates(F.col("t"), "customer"), names.extract_candidates(F.col("t"), "supplier")).first()) == (["甲乙丙公司"], ["丁戊"])
    more = text.select(names.clean_ticker(F.lit("600519.0")), names.clean_ticker(F.lit("1")), names.clean_date(F.lit("2020/1/2")), names.clean_date(F.lit("20200103")), names.clean_title(F.lit("<em>a</em> &amp;  b")), names.period_end(F.lit("某某2019年年度报告")), names.is_annual_report(F.lit("2019年年度报告摘要")))
    assert tuple(more.first()) == ("600519", "000001", D(2020, 1, 2), D(2020, 1, 3), "a & b", D(2019, 12, 31), False)


def test_similarity_search_loses_nothing(spark):
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abcd") for _ in range(draw.randrange(1, 14))) for _ in range(120)})

    def score(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                best[j + 1], before = (before + 1 if x == y else max(best[j], best[j + 1])), best[j + 1]
        return 200 * best[-1] / (len(a) + len(b))
    frame = spark.createDataFrame([(w,) for w in words], "name string")
    for least in (90, 70):
        found = {(a, b): s for a, b, s in rows(resolve.similar_names(frame, frame, least))}
        assert found == {(a, b): pytest.approx(score(a, b)) for a in words for b in words if score(a, b) >= least}


def test_fuzzy_tie_and_ladder(spark):
    aliases = spark.createDataFrame([("e1", "abcx"), ("e2", "abcy"), ("e3", "Exact Co"), ("e4", "twin"), ("e5", "twin")], "entity_id string, alias string").withColumns({"valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date")})
    mentions = spark.createDataFrame([("d", "c", n, TS(2020, 1, 1)) for n in ("abcz", "exact", "twin", "客户A", "nobody", "byhand")], "source_document_id string, source_company_id string, counterparty_raw_name string, publication_datetime timestamp")
    manual = spark.createDataFrame([("byhand", "e9")], "normalized_name string, entity_id string")
    found = {r.counterparty_raw_name: (r.resolved_entity_id, r.resolution_method) for r in resolve.resolve(mentions, aliases, manual, least=70, margin=0).collect()}
    assert found == {"abcz": ("e2", "high_confidence_fuzzy"), "exact": ("e3", "exact_alias"), "twin": (None, "exact_alias_collision"), "客户A": (None, "blocked_anonymous"), "nobody": (None, "none"), "byhand": ("e9", "manual_override")}
    assert {r.counterparty_raw_name: r.resolution_status for r in resolve.resolve(mentions, aliases, manual, least=70, margin=1).collect()}["abcz"] == "unresolved"


def test_contracts_and_tables(spark, tmp_path):
    good = spark.createDataFrame([("a", "b", D(2020, 1, 1), None)], "entity_id string, alias string, valid_from date, valid_to date").withColumns({c: F.lit("x") for c in ("canonical_name", "alias_type", "source")})
    alias = contracts.TABLES["company_alias"]
    assert alias.enforce(good) is good
    with pytest.raises(ValueError, match="repeated_key"):
        alias.enforce(good.union(good))
    with pytest.raises(ValueError, match="validity_order"):
        alias.enforce(good.withColumn("valid_to", F.lit(D(2019, 1, 1))))
    (tmp_path / "a.csv").write_text("security_id,ticker,exchange,company_name,listing_date,delisting_date,board\n000001,000001,SZSE,Bank,1991-04-03,,MAIN\n2,2,XXX,Y,not,,MAIN\n", encoding="utf-8")
    master = tables.read_contract_table(spark, str(tmp_path / "a.csv"), "security_master")
    assert master.first().security_id == "000001" and master.first().listing_date == D(1991, 4, 3)
    assert {r.rule for r in contracts.TABLES["security_master"].check(master).filter("violations > 0").collect()} == {"null:listing_date", "rule:exchange"}
    assert tables.unfloat_nan(spark.sql("SELECT double('NaN') AS x")).first().x is None
    tables.write_json({"a": 1}, str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        tables.write_json({"a": float("nan")}, str(tmp_path / "y.json"))
    assert not (tmp_path / "y.json").exists()


def test_assets(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for n in "ab":
        (tmp_path / "raw" / n).write_bytes(n.encode())
    recorded = assets.manifest(spark, str(tmp_path / "raw"))
    kept = spark.createDataFrame(recorded.collect(), recorded.schema)
    assert assets.verify_manifest(kept, assets.manifest(spark, str(tmp_path / "raw"))).count() == 0
    (tmp_path / "raw" / "a").write_bytes(b"c")
    (tmp_path / "raw" / "z").write_bytes(b"z")
    assert sorted(r.reason for r in assets.verify_manifest(kept, assets.manifest(spark, str(tmp_path / "raw"))).collect()) == ["sha256", "unexpected"]
    assert assets.split_windows("2020-01-01", "2020-01-04") == (("2020-01-01", "2020-01-02"), ("2020-01-03", "2020-01-04")) and assets.split_windows("2020-01-01", "2020-01-01") is None
    pages = spark.createDataFrame([("u", '{"result":[{"a":"1"}]}'), ("v", '{"pageHelp":{"data":[{"a":"2"},{"a":"3"}]}}')], "url string, body string")
    assert rows(assets.paged_rows(pages, "struct<a:string>"), "a") == [("u", "1"), ("v", "2"), ("v", "3")]
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    sheet = f'<worksheet xmlns="{assets.MAIN[1:-1]}"><sheetData><row>{cell("A1", "title")}</row><row>{cell("A2", "code")}{cell("C2", "name")}</row><row>{cell("A3", "000001")}{cell("C3", "Bank")}</row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    found = assets.read_workbooks(spark, str(tmp_path / "*.xlsx"), "code").collect()
    assert [r.row for r in found if r.row] == [{"code": "000001", "name": "Bank"}] and sum(r.error is not None for r in found) == 1


def test_quality(spark):
    frame = spark.createDataFrame([(k, "ab"[k % 4 == 0]) for k in range(40)], "k int, s string")
    sample = quality.stratified_sample(frame, ["s"], ["k"], 8, 1)
    assert sample.groupBy("s").count().orderBy("s").collect()[0]["count"] == 6 and sample.count() == 8
    assert rows(quality.stratified_sample(frame.orderBy(F.rand(1)), ["s"], ["k"], 8, 1), "k") == rows(sample, "k")
    assert quality.stratified_sample(frame, ["s"], ["k"], 100, 1).count() == 40


def test_streams_match_batches(spark, tmp_path):
    schema = "source_document_id string, source_company_id string, resolved_entity_id string, relationship_type string, resolution_status string, publication_datetime timestamp"
    days = [TS(2020, 1, 1) + dt.timedelta(days=k) for k in range(0, 60, 3)]
    batch = spark.createDataFrame([(f"d{k % 7}", "A", f"B{k % 3}", "customer", "resolved" if k % 2 else "none", d) for k, d in enumerate(days)], schema)
    batch.union(batch).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, make, mode in (("counts", disclosure_counts, "append"), ("edges", edge_stream, "append")):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    closed = {tuple(r) for r in spark.table("counts").collect()}
    assert closed and closed <= {tuple(r) for r in disclosure_counts(batch.union(batch)).collect()}
    assert spark.table("edges").count() == graph.orient(batch).select("supplier_id", "customer_id", "source_document_id").distinct().count()
