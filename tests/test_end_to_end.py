"""From report sentences to reconciled P&L on a small market, and the command line."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from asofgraph import cli
from asofgraph.operators import graph, market, portfolio, residuals, resolve, statistics
from asofgraph.sources.disclosures import sentence_mentions

NAMES = [f"T{k:02d}" for k in range(8)]
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(70)]


def price(k, t):
    return round(50 + k + 3 * math.sin(0.7 * t + k) + 0.02 * t * (k % 3), 2)


def test_chain(spark):
    texts = [(f"d{k}", NAMES[k], f"客户：{NAMES[(k + 1) % 8]}有限公司，供应商：{NAMES[(k + 3) % 8]}\n", dt.datetime(2020, 1, 5, 10)) for k in range(6)] + [("d9", "T00", "客户：某公司；供应商：查无此名\n", dt.datetime(2020, 1, 5))]
    documents = spark.createDataFrame(texts, "source_document_id string, source_company_id string, text string, publication_datetime timestamp")
    mentions = sentence_mentions(documents).join(documents.drop("text"), "source_document_id")
    aliases = spark.createDataFrame([(n, n) for n in NAMES], "entity_id string, alias string").withColumns({c: F.lit(None).cast("date") for c in ("valid_from", "valid_to")})
    audit = resolve.resolve(mentions, aliases)
    assert {r["resolution_status"]: r["count"] for r in audit.groupBy("resolution_status").count().collect()} == {"resolved": 12, "anonymous": 1, "unresolved": 1}
    joined = resolve.attach_resolution(mentions, audit).withColumn("relationship_confidence", F.lit(1.0))
    edges = graph.collapse(graph.orient(joined))
    assert edges.count() == 12
    master = spark.createDataFrame([(n, DAYS[0], None, "MAIN") for n in NAMES], "security_id string, listing_date date, delisting_date date, board string")
    calendar = spark.createDataFrame([(d,) for d in DAYS], "date date")
    quotes = spark.createDataFrame([(d, n, *[price(k, t)] * 4, 100.0, 1e6, False, False) for k, n in enumerate(NAMES) for t, d in enumerate(DAYS) if (k, t) != (2, 40)],
                                   "date date, security_id string, open double, high double, low double, close double, volume double, amount double, is_suspended boolean, is_st boolean")
    actions = spark.createDataFrame([], "date date, security_id string, share_multiplier double, cash_dividend double, reference_price double")
    rules = spark.createDataFrame([("MAIN", dt.date(2000, 1, 1), dt.date(2099, 1, 1), 0.5, None, 0)], "board string, valid_from date, valid_to date, ordinary_pct double, st_pct double, ipo_days int")
    panel = market.build_panel(master, calendar, quotes, actions, rules)
    assert panel.count() == 560 and panel.filter("raw_return IS NULL").count() == 8 + 2
    residual = residuals.residual_returns(panel, residuals.market_returns(panel), None, 20, 1, 10)
    signals = graph.diffusion_signals(edges, residual)
    assert signals.filter(F.col("date") < dt.date(2020, 1, 6)).count() == 0  # published on the 5th after the close
    ic = statistics.information_coefficients(signals, residual)
    assert ic.count() > 40
    fees = spark.createDataFrame([("stamp_tax", "sell", dt.date(2000, 1, 1), dt.date(2099, 1, 1), 0.001)], "kind string, side string, valid_from date, valid_to date, rate double")
    settlement = spark.createDataFrame([(dt.date(2000, 1, 1), dt.date(2099, 1, 1), 1)], "valid_from date, valid_to date, offset int")
    weights, trades, daily = portfolio.backtest(signals, "customer_shock", panel, calendar, fees, settlement, quantiles=4)
    net = trades.agg(F.sum("net_pnl"), F.count("*")).first()
    assert net[1] == weights.count() and daily.agg(F.sum("net_pnl")).first()[0] == pytest.approx(net[0])


def test_command_line(spark, tmp_path):
    mention = "source_company_id string, counterparty_raw_name string, relationship_type string, source_period_end date, publication_datetime timestamp, source_document_id string, source_document_url_or_path string, evidence_text string, exposure_value double, exposure_share double"
    rows = [("A", "Beta Ltd", "customer", dt.date(2019, 12, 31), dt.datetime(2020, 4, 30, 10), "d1", "p", "Beta Ltd", None, 0.1)]
    spark.createDataFrame(rows, mention).write.parquet(str(tmp_path / "m.parquet"))
    spark.createDataFrame([("B", "Beta", "beta", "name", dt.date(2000, 1, 1), None, "s")], "entity_id string, canonical_name string, alias string, alias_type string, valid_from date, valid_to date, source string").write.parquet(str(tmp_path / "a.parquet"))
    args = ["edges", "--mentions", str(tmp_path / "m.parquet"), "--aliases", str(tmp_path / "a.parquet"), "--out", str(tmp_path / "out")]
    assert cli.main(args, spark) == 0
    edge = spark.read.parquet(str(tmp_path / "out" / "supply_chain_edge.parquet")).first()
    assert (edge.supplier_id, edge.customer_id, edge.effective_start) == ("A", "B", dt.datetime(2020, 4, 30, 10))
    spark.createDataFrame(rows * 2, mention).write.mode("overwrite").parquet(str(tmp_path / "m.parquet"))
    assert cli.main(args, spark) == 4
