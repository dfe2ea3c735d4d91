"""Long/short weights, fills at the open, costs and daily P&L, without loops over dates or trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.operators.intervals import numbered
from asofgraph.operators.refusals import unless

COSTS = ("commission", "slippage", "stamp_tax", "venue_fee")


def quantile_weights(signals: DataFrame, signal: str, quantiles: int = 5, gross: float = 1.0, net: float = 0.0, cap: float | None = None) -> DataFrame:
    """Equal weights on the top and bottom max(1, min(n // q, n // 2)) names of each date.

    Ties go to the smaller security_id at both ends. Dates with one name have no weights; sides of
    weight zero are left out. A weight above ``cap`` is an error.
    """
    usable = signals.filter(F.col(signal).isNotNull())
    per = Window.partitionBy("date")
    ranked = usable.withColumns({
        "n": F.count("*").over(per), "low": F.row_number().over(per.orderBy(F.col(signal).asc(), F.col("security_id").asc())),
        "high": F.row_number().over(per.orderBy(F.col(signal).desc(), F.col("security_id").asc()))})
    tail = F.greatest(F.lit(1), F.least(F.floor(F.col("n") / quantiles), F.floor(F.col("n") / 2)))
    up, down = (gross + net) / 2, (gross - net) / 2
    weight = F.when(F.col("high") <= tail, F.lit(up) / tail).when(F.col("low") <= tail, F.lit(-down) / tail)
    if cap is not None:
        weight = unless(F.abs(weight) > cap + 1e-12, weight, f"a target weight is above {cap} on", F.col("date"), F.col("security_id"))
    return ranked.filter("n > 1").select(F.col("date").alias("signal_date"), "security_id", weight.alias("target_weight")).filter("target_weight IS NOT NULL AND target_weight <> 0")


def weight_check(weights: DataFrame, gross: float = 1.0, net: float = 0.0, cap: float = 1.0, tolerance: float = 1e-12) -> DataFrame:
    """Sums of each date and whether they are as asked, no name above the cap, none twice."""
    found = weights.groupBy("signal_date").agg(
        F.sum(F.abs("target_weight")).alias("gross"), F.sum("target_weight").alias("net"), F.max(F.abs("target_weight")).alias("largest"),
        F.count("*").alias("names"), F.countDistinct("security_id").alias("distinct_names"))
    good = (F.abs(F.col("gross") - gross) <= tolerance) & (F.abs(F.col("net") - net) <= tolerance) & (F.col("largest") <= cap) & (F.col("names") == F.col("distinct_names"))
    return found.withColumn("valid", good)


def block_reason(side: str, least_amount: float) -> Column:
    """Why an order can't fill on a panel row, null if it can; a row that isn't there has ``present`` null."""
    limit = ("limit_up", "limit_up_buy_locked") if side == "buy" else ("limit_down", "limit_down_sell_locked")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(F.col("present").isNull(), "missing_market_row").when(flag("suspended"), "suspended").when(F.col("open").isNull() | F.isnan("open"), "missing_open")
        .when(flag(limit[0]), limit[1]).when(~flag("tradable"), "not_tradable")
        .when(F.coalesce(F.col("amount"), F.lit(0.0)) < least_amount, "below_minimum_liquidity"))


def fills(panel: DataFrame, calendar: DataFrame, least_amount: float, dates: DataFrame | None = None) -> DataFrame:
    """For every security of the panel and trading date: reasons by side, and where, when and at what open each side fills next.

    ``dates`` is the numbered calendar, if it is at hand.
    """
    cells = panel.select("security_id").distinct().crossJoin(F.broadcast(numbered(calendar) if dates is None else dates))
    rows = cells.join(panel.select("date", "security_id", "open", "amount", "tradable", "suspended", "limit_up", "limit_down", F.lit(True).alias("present")), ["date", "security_id"], "left")
    rows = rows.withColumns({"buy_reason": block_reason("buy", least_amount), "sell_reason": block_reason("sell", least_amount)})
    ahead = Window.partitionBy("security_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)  # backwards in time, so each row adds to a running minimum
    fill = F.struct("pos", "date", "open")
    rows = rows.withColumns({f"{s}_fill": F.min(F.when(F.col(f"{s}_reason").isNull(), fill)).over(ahead) for s in ("buy", "sell")})
    return rows.withColumns({f"next_{s}": F.col(f"{s}_fill.pos") for s in ("buy", "sell")})


def default_slippage(offered: list[float]) -> float:
    """10 basis points where offered, else the first."""
    if not offered:
        raise ValueError("no slippage is offered")
    return 10.0 if 10.0 in map(float, offered) else float(offered[0])


def fee_rates(fees: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, side, stamp, venue): rates in force on each date that a rule covers, [from, to] inclusive; a side of 'both' counts for both."""
    named = fees.select(F.lower("side").alias("_side"), "kind", "rate", "valid_from", "valid_to")
    joined = dates.select("date").distinct().join(F.broadcast(named), F.col("date").between(F.col("valid_from"), F.col("valid_to")))
    rows = joined.withColumn("side", F.explode(F.array(F.lit("buy"), F.lit("sell"))))
    mine = F.col("_side").isin("both") | (F.col("_side") == F.col("side"))
    rate = lambda stamp: F.sum(F.when(mine & (F.col("kind").contains("stamp_tax") == F.lit(stamp)), F.col("rate")).otherwise(0.0))
    return rows.groupBy("date", "side").agg(rate(True).alias("stamp"), rate(False).alias("venue"))


def day_terms(dates: DataFrame, fees: DataFrame, settlement: DataFrame) -> DataFrame:
    """(pos, date, rules, offset, rates): a row a trading date with its number of settlement rules, offset and fees by side."""
    offsets = dates.join(F.broadcast(settlement.select("valid_from", "valid_to", "offset")), F.col("date").between(F.col("valid_from"), F.col("valid_to")), "left")
    offsets = offsets.groupBy("pos", "date").agg(F.count("offset").alias("rules"), F.max("offset").alias("offset"))
    rates = fee_rates(fees, dates).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("stamp", "venue")))).alias("rates"))
    return offsets.join(rates, "date", "left")


def round_trips(weights: DataFrame, panel: DataFrame, calendar: DataFrame, fees: DataFrame, settlement: DataFrame, hold: int = 1, least_amount: float = 0.0, commission_bps: float = 3.0, slippage_bps: float = 10.0, capital: float = 1.0) -> DataFrame:
    """One row a weight: enter at the next date's open or be rejected, leave at the first open that fills.

    The exit is due after the larger of ``hold`` and the settlement offset; it waits until its side can
    fill, and a trade that never can stays OPEN. The next fillable date is a window minimum
    computed once for each security, so an exit is a lookup: each weight asks the fill table for its entry and its due
    date in one join. What depends on the date alone is one small table, broadcast. An entry on a date without
    exactly one settlement rule, and a leg on a date that no fee rule covers, are errors.
    """
    dates = numbered(calendar)
    days = F.broadcast(day_terms(dates, fees, settlement).select("pos", "date", "rules", "offset", "rates"))
    named = lambda name, *more: days.select(F.col("pos").alias(f"{name}_pos"), F.col("date").alias(f"{name}_date"), *more)
    last = F.broadcast(dates.agg(F.max("pos").alias("last_pos")))
    long = F.col("target_weight") > 0
    asked = weights.join(named("signal"), "signal_date").crossJoin(last).withColumn("entry_pos", F.col("signal_pos") + 1)
    asked = asked.join(named("entry", "rules", "offset", F.col("rates").alias("entry_rates")), "entry_pos", "left")
    due = F.greatest(F.lit(hold), F.coalesce("offset", F.lit(0)))
    asked = asked.withColumn("due_pos", F.col("entry_pos") + due).join(named("due"), "due_pos", "left")
    at = F.explode(F.array(F.struct(F.lit(True).alias("entry"), F.col("entry_pos").alias("pos")), F.struct(F.lit(False).alias("entry"), F.col("due_pos").alias("pos"))))
    table = fills(panel, calendar, least_amount, dates).select("security_id", "pos", F.struct("open", "buy_reason", "sell_reason", "buy_fill", "sell_fill").alias("cell"))
    met = asked.withColumn("ask", at).withColumn("pos", F.col("ask.pos")).join(table, ["security_id", "pos"], "left")
    cell = F.struct(F.col("cell.open").alias("open"), F.when(long, F.col("cell.buy_reason")).otherwise(F.col("cell.sell_reason")).alias("reason"), F.when(long, F.col("cell.sell_fill")).otherwise(F.col("cell.buy_fill")).alias("exit"))
    met = met.withColumn("cell", F.when(F.col("cell").isNotNull(), cell))  # only what the trade's side needs is gathered
    keys = [c for c in asked.columns if c != "entry_rates"]
    one = lambda entry: F.first(F.when(F.col("ask.entry") == F.lit(entry), F.col("cell")), ignorenulls=True)
    rows = met.groupBy("signal_date", "security_id", "target_weight").agg(
        *(F.first(c).alias(c) for c in keys if c not in ("signal_date", "security_id", "target_weight")), F.first("entry_rates").alias("entry_rates"), one(True).alias("entry"), one(False).alias("due"))
    reason = (
        F.when(F.col("entry_date").isNull(), "no_next_trading_day").when(F.col("entry").isNull(), "missing_market_row")
        .otherwise(F.col("entry.reason")))
    rows = rows.withColumn("entry_block_reason", F.coalesce(reason, F.lit("")))
    entered = F.col("entry_block_reason") == ""
    checked = unless(entered & (F.col("rules") != 1), F.col("entry_block_reason"), "not one settlement rule on", F.col("entry_date"))
    rows = rows.withColumn("entry_block_reason", checked).withColumnRenamed("due_date", "scheduled_exit_date")
    fill = F.when(entered, F.col("due.exit"))
    rows = rows.withColumns({"entry_price": F.col("entry.open"), "exit_pos": fill.pos, "exit_date": fill.date, "exit_price": fill.open})
    status = F.when(~entered, "ENTRY_REJECTED").when(F.col("exit_date").isNull(), "OPEN").otherwise("CLOSED")
    rows = rows.withColumns({"status": status, "entry_side": F.when(long, "buy").otherwise("sell"), "exit_side": F.when(long, "sell").otherwise("buy")})
    rows = rows.join(days.select(F.col("pos").alias("exit_pos"), F.col("rates").alias("exit_rates")), "exit_pos", "left")
    zero = F.lit(0.0)
    rows = rows.withColumn("entry_notional", F.when(entered, F.abs("target_weight") * capital).otherwise(zero)).withColumn("quantity", F.when(entered, F.col("entry_notional") / F.col("entry_price")).otherwise(zero))
    closed = F.col("status") == "CLOSED"
    rows = rows.withColumn("exit_notional", F.when(closed, F.col("quantity") * F.col("exit_price")).otherwise(zero))
    costs: dict[str, Column] = {}
    for leg, there in (("entry", entered), ("exit", closed)):
        notional, rates = F.col(f"{leg}_notional"), F.col(f"{leg}_rates")
        due = lambda kind: F.when(there, unless(rates.isNull(), notional * rates[F.col(f"{leg}_side")][kind], "no fee rule on", F.col(f"{leg}_date"))).otherwise(zero)  # noqa: B023, E731
        costs |= {f"{leg}_commission_cost": notional * commission_bps / 10_000, f"{leg}_slippage_cost": notional * slippage_bps / 10_000,
                  f"{leg}_stamp_tax_cost": due("stamp"), f"{leg}_venue_fee_cost": due("venue")}
    rows = rows.withColumns(costs)
    rows = rows.withColumns({f"{c}_cost": F.col(f"entry_{c}_cost") + F.col(f"exit_{c}_cost") for c in COSTS})
    direction = F.when(long, 1.0).otherwise(-1.0)
    total = sum((F.col(f"{c}_cost") for c in COSTS[1:]), F.col(f"{COSTS[0]}_cost"))
    rows = rows.withColumns({"gross_pnl": F.when(closed, direction * (F.col("exit_notional") - F.col("entry_notional"))).otherwise(zero), "total_cost": total})
    holding = F.when(closed, F.col("exit_pos") - F.col("entry_pos")).when(F.col("status") == "OPEN", F.col("last_pos") - F.col("entry_pos")).otherwise(F.lit(0))
    return rows.select(
        "signal_date", "security_id", "target_weight", F.when(long, "long").otherwise("short").alias("side"), "status", "entry_block_reason", "entry_date",
        F.when(entered, F.col("scheduled_exit_date")).alias("scheduled_exit_date"), "exit_date", F.when(closed, F.col("exit_pos") - F.col("due_pos")).otherwise(0).cast("long").alias("exit_defer_count"),
        F.when(entered, F.col("entry_price")).alias("entry_price"), "exit_price", "quantity", "entry_notional", "exit_notional", "gross_pnl",
        *(f"{leg}_{c}_cost" for leg in ("entry", "exit") for c in COSTS), *(f"{c}_cost" for c in COSTS), "total_cost",
        (F.col("gross_pnl") - F.col("total_cost")).alias("net_pnl"), holding.cast("long").alias("holding_period_trading_days"))


def daily_pnl(trades: DataFrame, calendar: DataFrame, capital: float = 1.0) -> DataFrame:
    """One row a trading date: realised P&L, costs and turnover of both legs, and exposure carried.

    A trade is two events, made of one reading of the trades. Costs fall on the date of their leg, profit on the exit; exposure is a
    running sum of +weight at entry and -weight at exit. Events are summed by date before the
    running sum, which therefore covers one row a date.
    """
    taken = trades.filter(F.col("status").isin("CLOSED", "OPEN"))
    zero = F.lit(0.0)
    event = lambda name, sign: F.struct(
        F.col(f"{name}_date").alias("date"), *(F.col(f"{name}_{c}_cost").alias(f"{c}_cost") for c in COSTS), (F.col(f"{name}_notional") / capital).alias("turnover"),
        (F.col("gross_pnl") if sign < 0 else zero).alias("gross_pnl"), (sign * F.abs("target_weight")).alias("gross_step"), (sign * F.col("target_weight")).alias("net_step"),
        F.lit(1 if sign < 0 else 0).alias("closed"))
    both = F.array(*(F.when(there, event(name, sign)) for name, sign, there in (("entry", 1, F.lit(True)), ("exit", -1, F.col("status") == "CLOSED"))))
    events = taken.select(F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("e.*")
    sums = events.groupBy("date").agg(*(F.sum(c).alias(c) for c in events.columns if c != "date"))
    rows = numbered(calendar).join(sums, "date", "left").fillna(0.0)
    running = Window.orderBy("pos")
    total = sum((F.col(f"{c}_cost") for c in COSTS[1:]), F.col(f"{COSTS[0]}_cost"))
    return rows.withColumn("total_cost", total).select(
        "date", "gross_pnl", *(f"{c}_cost" for c in COSTS), "total_cost", (F.col("gross_pnl") - F.col("total_cost")).alias("net_pnl"), "turnover",
        F.sum("gross_step").over(running).alias("gross_exposure"), F.sum("net_step").over(running).alias("net_exposure"), F.col("closed").cast("long").alias("closed_trade_count"))


def backtest(signals: DataFrame, signal: str, panel: DataFrame, calendar: DataFrame, fees: DataFrame, settlement: DataFrame, quantiles: int = 5, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, trades, daily P&L) of a quantile strategy filled at the open."""
    weights = quantile_weights(signals, signal, quantiles)
    trades = round_trips(weights, panel, calendar, fees, settlement, **how)
    return weights, trades, daily_pnl(trades, calendar, how.get("capital", 1.0))
