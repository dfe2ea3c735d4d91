"""Queries over the market panel, residuals, statistics and execution, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofgraph.operators import graph, market, portfolio, residuals, statistics
from asofgraph.plans import graph_queries
from asofgraph.plans.domain import frame, oracle
from asofgraph.session import stored

WINDOW, LEAST = 26, 12
FEES = "(VALUES ('stamp_tax', 'sell', DATE '1990-01-01', DATE '1998-12-31', 0.001), ('stamp_tax', 'sell', DATE '1999-01-01', DATE '2099-12-31', 0.0005), ('handling', 'both', DATE '1990-01-01', DATE '2099-12-31', 0.00005))"
SETTLEMENT = "(VALUES (DATE '1990-01-01', DATE '1997-12-31', 1), (DATE '1998-01-01', DATE '2099-12-31', 2))"


def panel(spark: SparkSession, d: str) -> DataFrame:
    calendar, tables, _ = _market_tables(spark, d)
    return market.build_panel(tables[0], calendar, *tables[1:])


def _history(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "security_master").select("security_id", "industry_code", F.col("listing_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "returns").select("date", "security_id", F.when(~F.col("is_suspended"), F.col("raw_return")).alias("raw_return"))


def _residuals(spark: SparkSession, d: str, industry: bool = True) -> DataFrame:
    rows = stored(_returns(spark, d), "returns")
    other = residuals.leave_one_out(rows, _history(spark, d)) if industry else None
    return residuals.residual_returns(rows, residuals.market_returns(rows), other, WINDOW, 1, LEAST)


def _signals(spark: SparkSession, d: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    returns = stored(graph_queries.residuals(spark, d, given), "residuals")
    return graph_queries.signals_of(spark, d, returns, customers_only=True).select("date", "security_id", F.round("customer_shock", 6).alias("customer_shock"))


def _weights(spark: SparkSession, d: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    return portfolio.quantile_weights(_signals(spark, d, given), "customer_shock")


def trading_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(panel, calendar, what they were made of), stored: several steps read each of them, and the facts are read once. The panel has what fills need."""
    calendar, tables, given = _market_tables(spark, d)
    found = market.build_panel(tables[0], calendar, *tables[1:]).select("date", "security_id", "open", "amount", "tradable", "suspended", "limit_up", "limit_down")
    return stored(found, "panel"), calendar, given


def _market_tables(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame], dict[str, DataFrame]]:
    """calendar; master, quotes, actions and rules, all from one reading of the facts; and the stored table of it, whose rows are those of the weeks."""
    clamped = stored(frame(spark, d, "clamped").select("date", "security_id", "reference_price", "open", "close", "volume", "amount", "first_line"), "clamped")
    given = {"weekly": clamped, "clamped": clamped}
    return stored(frame(spark, d, "calendar", given), "calendar"), [frame(spark, d, n, given) for n in ("security_master", "quotes", "actions", "limit_rules")], given


def _fees(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT kind, side, valid_from, valid_to, CAST(rate AS DOUBLE) AS rate FROM {FEES} AS f(kind, side, valid_from, valid_to, rate)")


def _settlement(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {SETTLEMENT} AS s(valid_from, valid_to, offset)")


def _trades(spark: SparkSession, d: str, tables: tuple[DataFrame, DataFrame, dict[str, DataFrame]] | None = None) -> DataFrame:
    held, calendar, given = tables or trading_tables(spark, d)
    return portfolio.round_trips(stored(_weights(spark, d, given), "weights"), held, calendar, _fees(spark), _settlement(spark), hold=2, least_amount=20000.0)


def daily_pnl(spark: SparkSession, d: str) -> DataFrame:
    tables = trading_tables(spark, d)
    found = portfolio.daily_pnl(_trades(spark, d, tables), tables[1])
    return _rounded(found, 11, "gross_pnl", "commission_cost", "slippage_cost", "stamp_tax_cost", "venue_fee_cost", "total_cost", "net_pnl", "turnover", "gross_exposure", "net_exposure")


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


def _ic(spark: SparkSession, d: str) -> DataFrame:
    returns = stored(graph_queries.residuals(spark, d), "residuals")
    signals = graph_queries.signals_of(spark, d, returns, customers_only=True).select("date", "security_id", F.round("customer_shock", 6).alias("customer_shock"))
    return statistics.information_coefficients(signals, returns)


def forward_ic(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ic(spark, d), 6, "rank_ic", "pearson_ic")


def newey_west(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.newey_west(residuals.market_returns(_returns(spark, d)), "market_return", "date", 5), 9, "mean", "standard_error")


def wilson(spark: SparkSession, d: str) -> DataFrame:
    counts = frame(spark, d, "evidence").groupBy("line").agg(F.count("*").alias("n"), F.count_if(F.col("relationship_confidence") > 0.95).alias("k"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return _rounded(counts.select("line", "n", "k", low.alias("low"), high.alias("high")), 9, "low", "high")


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "evidence").groupBy(F.year("publication_datetime").alias("year")).agg(F.count("*").alias("n"))


def _by_line(spark: SparkSession, d: str) -> DataFrame:
    """Yearly counts of evidence for each line number."""
    return frame(spark, d, "evidence").groupBy("line", F.year("publication_datetime").alias("year")).agg(F.count("*").alias("n"))


def holm(spark: SparkSession, d: str) -> DataFrame:
    """Sign tests of each line number's yearly changes, adjusted."""
    change = F.signum(F.col("n") - F.lag("n").over(Window.partitionBy("line").orderBy("year")))
    counts = _by_line(spark, d).withColumn("s", change).groupBy(F.col("line").alias("test")).agg(F.count_if(F.col("s") > 0).alias("up"), F.count_if(F.col("s") < 0).alias("down"))
    tests = counts.select("test", statistics.sign_test(F.col("up"), F.col("down")).alias("p"))
    return _rounded(statistics.holm(tests, "p"), 9, "p", "holm_p")


def permutation_p(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.trend_tests(_by_line(spark, d), "line", "year", "n"), 12, "p")


def concentration(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.concentration(graph.degrees(graph_queries._edges(spark, d)), "total_degree")
    return _rounded(found, 9, *found.columns)


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(statistics.block_bootstrap(residuals.market_returns(_returns(spark, d)), "market_return", "date", 20, 200, 7), 9, "mean")


def placebo(spark: SparkSession, d: str) -> DataFrame:
    snap = graph.snapshot(graph_queries._edges(spark, d), graph_queries._as_of())
    return statistics.placebo_edges(snap, 20)


QUERIES = {
    "market_grid": lambda s, d: market.grid(frame(s, d, "security_master"), frame(s, d, "calendar")).select("date", "security_id", "listing_age"),
    "prev_close_return": lambda s, d: _rounded(panel(s, d).select("date", "security_id", "previous_close", "raw_return"), 6, "raw_return"),
    "price_limit_state": lambda s, d: panel(s, d).select("date", "security_id", "upper_limit", "lower_limit", "limit_up", "limit_down", "price_state"),
    "tradable_panel": lambda s, d: panel(s, d).select("date", "security_id", "has_market_data", "suspended", "locked", "tradable", "beyond_limit"),
    "price_violations": lambda s, d: market.price_violations(frame(s, d, "quotes").withColumn("volume", F.expr("CASE WHEN security_id % 17 = 3 THEN -volume ELSE volume END"))),
    "market_return": lambda s, d: _rounded(residuals.market_returns(_returns(s, d)), 6, "market_return"),
    "leave_one_out": lambda s, d: _rounded(residuals.leave_one_out(_returns(s, d), _history(s, d)), 6, "industry_return"),
    "rolling_beta": lambda s, d: _rounded(_residuals(s, d, industry=False).select("date", "security_id", "beta_market", "beta_observation_count", "beta_window_start", "beta_window_end"), 4, "beta_market"),
    "residual_returns": lambda s, d: _rounded(_residuals(s, d).select("date", "security_id", "residual_return", "beta_market", "beta_industry", "beta_window_start", "beta_window_end", "residual_model"), 4, "residual_return", "beta_market", "beta_industry"),
    "forward_ic": forward_ic,
    "newey_west": newey_west,
    "wilson": wilson,
    "trend": lambda s, d: _rounded(statistics.trend(_yearly(s, d), "year", "n"), 9, "theil_sen", "kendall_tau"),
    "holm": holm,
    "permutation_p": permutation_p,
    "concentration": concentration,
    "bootstrap": bootstrap,
    "placebo": placebo,
    "quantile_weights": lambda s, d: _rounded(_weights(s, d), 9, "target_weight"),
    "validate_weights": lambda s, d: _rounded(portfolio.weight_check(_weights(s, d), cap=0.05), 9, "gross", "net", "largest"),
    "block_reasons": lambda s, d: portfolio.fills(panel(s, d), frame(s, d, "calendar"), 20000.0).select("date", "security_id", "buy_reason", "sell_reason", "next_buy", "next_sell"),
    "round_trips": lambda s, d: _rounded(_trades(s, d).select(
        "signal_date", "security_id", "status", "entry_block_reason", "entry_date", "scheduled_exit_date", "exit_date", "exit_defer_count", "holding_period_trading_days", "gross_pnl"), 9, "gross_pnl"),
    "trade_costs": lambda s, d: _rounded(_trades(s, d).select("signal_date", "security_id", "commission_cost", "slippage_cost", "stamp_tax_cost", "venue_fee_cost", "total_cost", "net_pnl"), 9,
                                         "commission_cost", "slippage_cost", "stamp_tax_cost", "venue_fee_cost", "total_cost", "net_pnl"),
    "daily_pnl": daily_pnl,
}

_GRID = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM calendar),
  g AS (SELECT cal.date, pos, security_id, board, row_number() OVER (PARTITION BY security_id ORDER BY cal.date) - 1 AS listing_age FROM cal JOIN security_master
    ON cal.date >= listing_date AND (delisting_date IS NULL OR cal.date < delisting_date))"""
_PANEL = f"""{_GRID},
  j AS (SELECT g.*, q.open, q.high, q.low, q.close, q.volume, q.amount, q.is_st, share_multiplier, cash_dividend, reference_price, ordinary_pct, st_pct, ipo_days,
    q.open IS NOT NULL AND q.close IS NOT NULL AND q.volume IS NOT NULL AND q.amount IS NOT NULL AS has_market_data,
    coalesce(q.is_suspended, q.volume = 0 AND q.amount = 0, false) AS suspended, lag(q.close) OVER (PARTITION BY g.security_id ORDER BY pos) AS previous_close
    FROM g LEFT JOIN quotes q ON q.date = g.date AND q.security_id = g.security_id LEFT JOIN actions a ON a.date = g.date AND a.security_id = g.security_id
    LEFT JOIN limit_rules r ON r.board = g.board AND g.date BETWEEN r.valid_from AND r.valid_to),
  k AS (SELECT *, coalesce(reference_price, (previous_close - coalesce(cash_dividend, 0)) / coalesce(share_multiplier, 1)) AS ref, CASE WHEN is_st THEN coalesce(st_pct, ordinary_pct) ELSE ordinary_pct END AS rate,
    CASE WHEN has_market_data AND NOT suspended THEN (close * coalesce(share_multiplier, 1) + coalesce(cash_dividend, 0)) / nullif(previous_close, 0) - 1 END AS raw_return FROM j),
  l AS (SELECT *, CASE WHEN listing_age >= ipo_days THEN floor(ref * (1 + rate) * 100 + 0.5 + 1e-12) / 100 END AS upper_limit, CASE WHEN listing_age >= ipo_days THEN floor(ref * (1 - rate) * 100 + 0.5 + 1e-12) / 100 END AS lower_limit FROM k),
  s AS (SELECT *, has_market_data AND coalesce(abs(close - upper_limit) <= 1e-9, false) AS limit_up, has_market_data AND coalesce(abs(close - lower_limit) <= 1e-9, false) AS limit_down FROM l),
  panel AS (SELECT *, CASE WHEN suspended THEN 'suspended' WHEN limit_down THEN 'limit_down' WHEN limit_up THEN 'limit_up' WHEN has_market_data AND upper_limit IS NOT NULL THEN 'normal' WHEN has_market_data THEN 'no_limit' ELSE 'unavailable' END AS price_state,
    (limit_up OR limit_down) AND coalesce(abs(open - close) <= 1e-9 AND abs(high - close) <= 1e-9 AND abs(low - close) <= 1e-9, false) AS locked,
    has_market_data AND coalesce(close > upper_limit + 1e-9 OR close < lower_limit - 1e-9, false) AS beyond_limit FROM s),
  panel2 AS (SELECT *, has_market_data AND NOT suspended AND NOT locked AND coalesce(volume > 0 AND amount > 0, false) AS tradable FROM panel)"""
_PANEL_TABLES = ["security_master", "calendar", "quotes", "actions", "limit_rules"]
_RET = "ret AS (SELECT date, security_id, CASE WHEN is_suspended THEN NULL ELSE raw_return END AS y FROM returns)"
_MKT = f"{_RET}, mkt AS (SELECT date, avg(y) AS m FROM ret GROUP BY date)"
_LOO = """ri AS (SELECT ret.date, ret.security_id, y, industry_code FROM ret LEFT JOIN security_master sm ON sm.security_id = ret.security_id AND listing_date <= ret.date),
  ia AS (SELECT date, industry_code, sum(y) AS s, count(*) AS n FROM ri WHERE industry_code IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
  loo AS (SELECT ri.date, security_id, ri.industry_code, CASE WHEN y IS NOT NULL THEN n - 1 END AS industry_peer_count, CASE WHEN y IS NOT NULL AND n > 1 THEN (s - y) / (n - 1) END AS ind
    FROM ri LEFT JOIN ia ON ia.date = ri.date AND ia.industry_code = ri.industry_code)"""
_FIT = f"""{_MKT}, {_LOO}, ids AS (SELECT DISTINCT security_id FROM ret),
  grid AS (SELECT mkt.date, ids.security_id, y, m, USEIND AS i, ret.date IS NOT NULL AS inp FROM mkt CROSS JOIN ids LEFT JOIN ret ON ret.date = mkt.date AND ret.security_id = ids.security_id LEFT JOIN loo ON loo.date = mkt.date AND loo.security_id = ids.security_id),
  w AS (SELECT *, count(*) FILTER (y IS NOT NULL AND m IS NOT NULL) OVER x AS n1, sum(y) FILTER (m IS NOT NULL) OVER x AS y1, sum(m) FILTER (y IS NOT NULL) OVER x AS m1, sum(m * m) FILTER (y IS NOT NULL) OVER x AS mm1, sum(m * y) OVER x AS my1,
    min(date) FILTER (y IS NOT NULL AND m IS NOT NULL) OVER x AS d0, max(date) FILTER (y IS NOT NULL AND m IS NOT NULL) OVER x AS d1,
    min(date) FILTER (y IS NOT NULL AND m IS NOT NULL AND i IS NOT NULL) OVER x AS e0, max(date) FILTER (y IS NOT NULL AND m IS NOT NULL AND i IS NOT NULL) OVER x AS e1,
    count(*) FILTER (y IS NOT NULL AND m IS NOT NULL AND i IS NOT NULL) OVER x AS n2, sum(y) FILTER (m IS NOT NULL AND i IS NOT NULL) OVER x AS y2, sum(m) FILTER (y IS NOT NULL AND i IS NOT NULL) OVER x AS m2, sum(i) FILTER (y IS NOT NULL AND m IS NOT NULL) OVER x AS i2,
    sum(m * m) FILTER (y IS NOT NULL AND i IS NOT NULL) OVER x AS mm2, sum(i * i) FILTER (y IS NOT NULL AND m IS NOT NULL) OVER x AS ii2, sum(m * i) FILTER (y IS NOT NULL) OVER x AS mi2, sum(m * y) FILTER (i IS NOT NULL) OVER x AS my2, sum(i * y) FILTER (m IS NOT NULL) OVER x AS iy2
    FROM grid WINDOW x AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, mm1 - m1 * m1 / nullif(n1, 0) AS smm, my1 - m1 * y1 / nullif(n1, 0) AS smy, mm2 - m2 * m2 / nullif(n2, 0) AS tmm, ii2 - i2 * i2 / nullif(n2, 0) AS tii, mi2 - m2 * i2 / nullif(n2, 0) AS tmi, my2 - m2 * y2 / nullif(n2, 0) AS tmy, iy2 - i2 * y2 / nullif(n2, 0) AS tiy FROM w),
  b AS (SELECT *, CASE WHEN n1 >= {LEAST} AND abs(smm) > 1e-18 THEN smy / smm END AS b1, coalesce(n2 >= {LEAST} AND abs(tmm * tii - tmi * tmi) > 1e-14 * greatest(1.0, abs(tmm) * abs(tii)), false) AS ok2 FROM c),
  f AS (SELECT *, ok2 AND i IS NOT NULL AS u, (tmy * tii - tiy * tmi) / (tmm * tii - tmi * tmi) AS bm, (tiy * tmm - tmy * tmi) / (tmm * tii - tmi * tmi) AS bi FROM b),
  fit AS (SELECT date, security_id, CASE WHEN u THEN bm ELSE b1 END AS beta_market, CASE WHEN u THEN bi END AS beta_industry, CASE WHEN u THEN n2 ELSE CASE WHEN d0 IS NOT NULL THEN n1 END END AS n, CASE WHEN u THEN e0 ELSE d0 END AS d0, CASE WHEN u THEN e1 ELSE d1 END AS d1,
    CASE WHEN u THEN y - ((y2 - bm * m2 - bi * i2) / n2 + bm * m + bi * i) ELSE y - ((y1 - b1 * m1) / n1 + b1 * m) END AS residual_return, CASE WHEN u THEN 'market_plus_pit_industry' ELSE 'market_only' END AS residual_model FROM f WHERE inp)"""
_SIG = """r AS (SELECT date, security_id, CASE WHEN is_suspended THEN NULL ELSE raw_return END AS residual_return FROM returns), dd AS (SELECT DISTINCT date, CAST(date AS TIMESTAMP) + INTERVAL 7 HOUR AS close_at FROM r),
  aa AS (SELECT DISTINCT date, supplier_id, customer_id FROM edges JOIN dd ON effective_start <= close_at AND effective_end > close_at),
  sig AS (SELECT aa.date, supplier_id AS security_id, round(avg(residual_return), 6) AS v FROM aa LEFT JOIN r ON r.date = aa.date AND r.security_id = customer_id GROUP BY 1, 2)"""
_WEIGHTS = f"""{_SIG}, ranked AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY v, security_id) AS lo, row_number() OVER (PARTITION BY date ORDER BY v DESC, security_id) AS hi FROM sig WHERE v IS NOT NULL),
  wt AS (SELECT date AS signal_date, security_id, CASE WHEN hi <= t THEN 0.5::DOUBLE / t WHEN lo <= t THEN -0.5::DOUBLE / t END AS target_weight FROM (SELECT *, greatest(1, least(n // 5, n // 2)) AS t FROM ranked WHERE n > 1) WHERE hi <= t OR lo <= t)"""


def _reason(side: str) -> str:
    limit, name = ("limit_up", "limit_up_buy_locked") if side == "buy" else ("limit_down", "limit_down_sell_locked")
    return f"CASE WHEN p.pos IS NULL THEN 'missing_market_row' WHEN suspended THEN 'suspended' WHEN open IS NULL THEN 'missing_open' WHEN {limit} THEN '{name}' WHEN NOT tradable THEN 'not_tradable' WHEN coalesce(amount, 0) < 20000 THEN 'below_minimum_liquidity' END"


_FILLS = f"""cells AS (SELECT cal.date, cal.pos, security_id FROM cal CROSS JOIN (SELECT DISTINCT security_id FROM WHO)),
  fl AS (SELECT cells.date, cells.pos, cells.security_id, open, {_reason('buy')} AS buy_reason, {_reason('sell')} AS sell_reason FROM cells LEFT JOIN panel2 p ON p.pos = cells.pos AND p.security_id = cells.security_id),
  fills AS (SELECT *, min(pos) FILTER (buy_reason IS NULL) OVER x AS next_buy, min(pos) FILTER (sell_reason IS NULL) OVER x AS next_sell FROM fl WINDOW x AS (PARTITION BY security_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_TRADES = f"""{_PANEL}, {_WEIGHTS}, {_FILLS.replace('WHO', 'wt')},
  fee AS (SELECT * FROM {FEES} AS f(kind, side, valid_from, valid_to, rate)), st AS (SELECT * FROM {SETTLEMENT} AS s(valid_from, valid_to, off)),
  e AS (SELECT wt.*, cal.pos + 1 AS entry_pos, f.date AS entry_date, f.open AS entry_price, CASE WHEN f.date IS NULL THEN 'no_next_trading_day' WHEN target_weight > 0 THEN coalesce(buy_reason, '') ELSE coalesce(sell_reason, '') END AS entry_block_reason,
    cal.pos + 1 + greatest(2, coalesce(off, 0)) AS due_pos FROM wt JOIN cal ON cal.date = signal_date LEFT JOIN fills f ON f.security_id = wt.security_id AND f.pos = cal.pos + 1 LEFT JOIN st ON f.date BETWEEN st.valid_from AND st.valid_to),
  x AS (SELECT e.*, f.date AS scheduled_exit_date, CASE WHEN entry_block_reason = '' THEN CASE WHEN target_weight > 0 THEN next_sell ELSE next_buy END END AS exit_pos FROM e LEFT JOIN fills f ON f.security_id = e.security_id AND f.pos = due_pos),
  z AS (SELECT x.*, f.date AS exit_date, f.open AS exit_price, CASE WHEN entry_block_reason <> '' THEN 'ENTRY_REJECTED' WHEN f.date IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM x LEFT JOIN fills f ON f.security_id = x.security_id AND f.pos = exit_pos),
  n AS (SELECT *, CASE WHEN status <> 'ENTRY_REJECTED' THEN abs(target_weight) ELSE 0 END AS en, CASE WHEN status = 'CLOSED' THEN abs(target_weight) / entry_price * exit_price ELSE 0 END AS xn FROM z),
  rates AS (SELECT date, sd AS side, sum(CASE WHEN kind = 'stamp_tax' THEN rate ELSE 0 END)::DOUBLE AS stamp, sum(CASE WHEN kind <> 'stamp_tax' THEN rate ELSE 0 END)::DOUBLE AS venue
    FROM cal JOIN fee ON date BETWEEN valid_from AND valid_to JOIN (VALUES ('buy'), ('sell')) AS q(sd) ON fee.side = sd OR fee.side = 'both' GROUP BY 1, 2),
  tr AS (SELECT n.*, en * coalesce(a.stamp, 0) AS es, xn * coalesce(b.stamp, 0) AS xs, en * coalesce(a.venue, 0) AS ev, xn * coalesce(b.venue, 0) AS xv,
    CASE WHEN status = 'CLOSED' THEN sign(target_weight) * (xn - en) ELSE 0 END AS gross_pnl FROM n
    LEFT JOIN rates a ON a.date = entry_date AND a.side = CASE WHEN target_weight > 0 THEN 'buy' ELSE 'sell' END LEFT JOIN rates b ON b.date = exit_date AND b.side = CASE WHEN target_weight > 0 THEN 'sell' ELSE 'buy' END)"""
_TRADE_TABLES = [*_PANEL_TABLES, "edges", "returns"]

ORACLE = {
    "market_grid": oracle(["security_master", "calendar"], f"{_GRID} SELECT date, security_id, CAST(listing_age AS INTEGER) AS listing_age FROM g"),
    "prev_close_return": oracle(_PANEL_TABLES, f"{_PANEL} SELECT date, security_id, previous_close, round(raw_return, 6) + 0.0 AS raw_return FROM panel2"),
    "price_limit_state": oracle(_PANEL_TABLES, f"{_PANEL} SELECT date, security_id, upper_limit, lower_limit, limit_up, limit_down, price_state FROM panel2"),
    "tradable_panel": oracle(_PANEL_TABLES, f"{_PANEL} SELECT date, security_id, has_market_data, suspended, locked, tradable, beyond_limit FROM panel2"),
    "price_violations": oracle(["quotes"], """v AS (SELECT open, close, high, low, amount, CASE WHEN security_id % 17 = 3 THEN -volume ELSE volume END AS volume FROM quotes)
      SELECT 'open_not_finite' AS rule, count(*) FILTER (NOT isfinite(open)) AS violations FROM v UNION ALL SELECT 'close_not_finite', count(*) FILTER (NOT isfinite(close)) FROM v
      UNION ALL SELECT 'volume_not_finite', count(*) FILTER (NOT isfinite(volume)) FROM v UNION ALL SELECT 'amount_not_finite', count(*) FILTER (NOT isfinite(amount)) FROM v
      UNION ALL SELECT 'high_not_finite', count(*) FILTER (NOT isfinite(high)) FROM v UNION ALL SELECT 'low_not_finite', count(*) FILTER (NOT isfinite(low)) FROM v
      UNION ALL SELECT 'high_not_positive', count(*) FILTER (high <= 0) FROM v UNION ALL SELECT 'low_not_positive', count(*) FILTER (low <= 0) FROM v
      UNION ALL SELECT 'open_not_positive', count(*) FILTER (open <= 0) FROM v UNION ALL SELECT 'close_not_positive', count(*) FILTER (close <= 0) FROM v
      UNION ALL SELECT 'volume_negative', count(*) FILTER (volume < 0) FROM v UNION ALL SELECT 'amount_negative', count(*) FILTER (amount < 0) FROM v"""),
    "market_return": oracle(["returns"], f"{_MKT} SELECT date, round(m, 6) + 0.0 AS market_return FROM mkt"),
    "leave_one_out": oracle(["returns", "security_master"], f"{_RET}, {_LOO} SELECT date, security_id, industry_code, industry_peer_count, round(ind, 6) + 0.0 AS industry_return FROM loo"),
    "rolling_beta": oracle(["returns", "security_master"], _FIT.replace("USEIND", "CAST(NULL AS DOUBLE)") + " SELECT date, security_id, round(beta_market, 4) + 0.0 AS beta_market, n AS beta_observation_count, d0 AS beta_window_start, d1 AS beta_window_end FROM fit"),
    "residual_returns": oracle(["returns", "security_master"], _FIT.replace("USEIND", "ind") + " SELECT date, security_id, round(residual_return, 4) + 0.0 AS residual_return, round(beta_market, 4) + 0.0 AS beta_market, round(beta_industry, 4) + 0.0 AS beta_industry, d0 AS beta_window_start, d1 AS beta_window_end, residual_model FROM fit"),
    "forward_ic": oracle(["edges", "returns"], f"""{_SIG}, fd AS (SELECT date, lead(date) OVER (ORDER BY date) AS f FROM (SELECT DISTINCT date FROM r)),
      al AS (SELECT sig.date, f, v, residual_return AS y FROM sig JOIN fd ON fd.date = sig.date JOIN r ON r.date = f AND r.security_id = sig.security_id WHERE v IS NOT NULL AND residual_return IS NOT NULL),
      rk AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM al)
      SELECT date, 1 AS horizon, f AS forward_return_date, count(*) AS eligible_count, round(corr(rx, ry), 6) + 0.0 AS rank_ic, round(corr(v, y), 6) + 0.0 AS pearson_ic FROM rk GROUP BY date, f
      HAVING count(*) >= 2 AND count(DISTINCT v) >= 2 AND count(DISTINCT y) >= 2"""),
    "newey_west": oracle(["returns"], f"""{_MKT}, q AS (SELECT m - (SELECT avg(m) FROM mkt) AS c, row_number() OVER (ORDER BY date) AS i FROM mkt WHERE m IS NOT NULL), k AS (SELECT unnest(range(0, 6)) AS k),
      g AS (SELECT k, sum(a.c * b.c) * CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 6.0) END AS s FROM k JOIN q a ON true JOIN q b ON b.i = a.i - k GROUP BY k), t AS (SELECT count(*) AS n, avg(m) AS mean FROM mkt WHERE m IS NOT NULL)
      SELECT n, round(mean, 9) + 0.0 AS mean, round(sqrt(greatest((SELECT sum(s) FROM g) / n, 0) / n), 9) + 0.0 AS standard_error FROM t"""),
    "wilson": oracle(["evidence"], f"""c AS (SELECT line, count(*) AS n, count(*) FILTER (relationship_confidence > 0.95) AS k FROM evidence GROUP BY line), p AS (SELECT *, k / n AS p, CAST({statistics.Z95} AS DOUBLE) AS z FROM c)
      SELECT line, n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) + 0.0 AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) + 0.0 AS high FROM p"""),
    "trend": oracle(["evidence"], """y AS (SELECT year(publication_datetime) AS x, count(*) AS n FROM evidence GROUP BY 1), p AS (SELECT (b.n - a.n) / (b.x - a.x) AS s, sign(b.n - a.n) AS g FROM y a JOIN y b ON a.x < b.x)
      SELECT round(median(s), 9) + 0.0 AS theil_sen, round(sum(g) / sqrt(count(*) * count(*) FILTER (g <> 0)), 9) + 0.0 AS kendall_tau FROM p"""),
    "holm": oracle(["evidence"], """y AS (SELECT line, year(publication_datetime) AS year, count(*) AS n FROM evidence GROUP BY 1, 2), c AS (SELECT line, sign(n - lag(n) OVER (PARTITION BY line ORDER BY year)) AS g FROM y),
      k AS (SELECT line AS test, count(*) FILTER (g > 0) AS u, count(*) FILTER (g < 0) AS w FROM c GROUP BY 1),
      t AS (SELECT test, CAST(least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(u, w) + 1 AS BIGINT)), lambda i: factorial(CAST(u + w AS INTEGER))::DOUBLE / (factorial(CAST(i AS INTEGER))::DOUBLE * factorial(CAST(u + w - i AS INTEGER))::DOUBLE))) / pow(2, u + w)) AS DOUBLE) AS p FROM k),
      s AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1)) AS sc FROM t) SELECT test, round(p, 9) + 0.0 AS p, round(max(sc) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS holm_p FROM s"""),
    "concentration": oracle(["edges"], f"""{graph_queries._NODES}, d AS (SELECT CAST(count(DISTINCT other) AS DOUBLE) AS v FROM nodes GROUP BY node), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM d),
      a AS (SELECT count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum(i * v) AS w, max(v) AS largest, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM r)
      SELECT round(q / (s * s), 9) + 0.0 AS hhi, round(s * s / q, 9) + 0.0 AS effective_nodes, round(2 * w / (n * s) - (n + 1) / n, 9) + 0.0 AS gini, round(s / n, 9) + 0.0 AS mean, largest + 0.0 AS largest, round(p90, 9) + 0.0 AS p90, round(p95, 9) + 0.0 AS p95, round(p99, 9) + 0.0 AS p99 FROM a"""),
    "quantile_weights": oracle(["edges", "returns"], f"{_WEIGHTS} SELECT signal_date, security_id, round(target_weight, 9) + 0.0 AS target_weight FROM wt"),
    "validate_weights": oracle(["edges", "returns"], f"""{_WEIGHTS}, a AS (SELECT signal_date, sum(abs(target_weight)) AS gross, sum(target_weight) AS net, max(abs(target_weight)) AS largest, count(*) AS names, count(DISTINCT security_id) AS distinct_names FROM wt GROUP BY 1)
      SELECT signal_date, round(gross, 9) + 0.0 AS gross, round(net, 9) + 0.0 AS net, round(largest, 9) + 0.0 AS largest, names, distinct_names, abs(gross - 1) <= 1e-12 AND abs(net) <= 1e-12 AND largest <= 0.05 AND names = distinct_names AS valid FROM a"""),
    "block_reasons": oracle(_PANEL_TABLES, f"{_PANEL}, {_FILLS.replace('WHO', 'security_master')} SELECT date, security_id, buy_reason, sell_reason, CAST(next_buy AS INTEGER) AS next_buy, CAST(next_sell AS INTEGER) AS next_sell FROM fills"),
    "round_trips": oracle(_TRADE_TABLES, f"""{_TRADES} SELECT signal_date, security_id, status, entry_block_reason, entry_date, CASE WHEN status <> 'ENTRY_REJECTED' THEN scheduled_exit_date END AS scheduled_exit_date, exit_date,
      CASE WHEN status = 'CLOSED' THEN exit_pos - due_pos ELSE 0 END AS exit_defer_count, CASE status WHEN 'CLOSED' THEN exit_pos - entry_pos WHEN 'OPEN' THEN (SELECT max(pos) FROM cal) - entry_pos ELSE 0 END AS holding_period_trading_days, round(gross_pnl, 9) + 0.0 AS gross_pnl FROM tr"""),
    "trade_costs": oracle(_TRADE_TABLES, f"""{_TRADES}, c AS (SELECT signal_date, security_id, (en + xn) * 3 / 10000 AS a, (en + xn) * 10 / 10000 AS b, es + xs AS c, ev + xv AS d, gross_pnl FROM tr)
      SELECT signal_date, security_id, round(a, 9) + 0.0 AS commission_cost, round(b, 9) + 0.0 AS slippage_cost, round(c, 9) + 0.0 AS stamp_tax_cost, round(d, 9) + 0.0 AS venue_fee_cost, round(a + b + c + d, 9) + 0.0 AS total_cost, round(gross_pnl - (a + b + c + d), 9) + 0.0 AS net_pnl FROM c"""),
    "daily_pnl": oracle(_TRADE_TABLES, f"""{_TRADES}, ev AS (SELECT entry_date AS date, en * 3 / 10000 AS a, en * 10 / 10000 AS b, es AS c, ev AS d, en AS t, CAST(0 AS DOUBLE) AS gp, abs(target_weight) AS gs, target_weight AS ns, 0 AS k FROM tr WHERE status <> 'ENTRY_REJECTED'
      UNION ALL SELECT exit_date, xn * 3 / 10000, xn * 10 / 10000, xs, xv, xn, gross_pnl, -abs(target_weight), -target_weight, 1 FROM tr WHERE status = 'CLOSED'),
      su AS (SELECT cal.date, pos, coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b, coalesce(sum(c), 0) AS c, coalesce(sum(d), 0) AS d, coalesce(sum(t), 0) AS t, coalesce(sum(gp), 0) AS gp, coalesce(sum(gs), 0) AS gs, coalesce(sum(ns), 0) AS ns, coalesce(sum(k), 0) AS k FROM cal LEFT JOIN ev ON ev.date = cal.date GROUP BY 1, 2)
      SELECT date, round(CAST(gp AS DOUBLE), 11) + 0.0 AS gross_pnl, round(a, 11) + 0.0 AS commission_cost, round(b, 11) + 0.0 AS slippage_cost, round(c, 11) + 0.0 AS stamp_tax_cost, round(d, 11) + 0.0 AS venue_fee_cost, round(a + b + c + d, 11) + 0.0 AS total_cost, round(gp - (a + b + c + d), 11) + 0.0 AS net_pnl,
      round(t, 11) + 0.0 AS turnover, round(sum(gs) OVER (ORDER BY pos), 11) + 0.0 AS gross_exposure, round(sum(ns) OVER (ORDER BY pos), 11) + 0.0 AS net_exposure, CAST(k AS BIGINT) AS closed_trade_count FROM su"""),
}
