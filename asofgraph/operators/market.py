"""The market panel: trading grid, prior closes, price limits, tradable states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.operators.intervals import numbered
from asofgraph.operators.refusals import refuse_rows, unless

TOLERANCE = 1e-9


def round_price(price: Column) -> Column:
    """The exchange's rounding to cents, half up with a guard against representation error."""
    return F.floor(price * 100 + 0.5 + 1e-12) / 100


def grid(master: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every trading date on which a security is listed, [listing, delisting), with its position and listing age.

    A security generates its own dates from its first and last calendar position; nothing is made
    that a filter would drop.
    """
    dates = numbered(calendar)
    table = dates.groupBy().agg(F.array_sort(F.collect_list("date")).alias("dates"))  # trading dates of decades: thousands
    own = master.crossJoin(F.broadcast(table)).withColumn(
        "listed", F.filter("dates", lambda x: (x >= F.col("listing_date")) & (F.col("delisting_date").isNull() | (x < F.col("delisting_date")))))
    rows = own.select("security_id", "board", F.posexplode("listed").alias("listing_age", "date"))
    return rows.join(F.broadcast(dates), "date").select("date", "security_id", "board", "listing_age", "pos")


def attach_limit_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of the row's board in force on its date, [from, to] inclusive; null where there is none, an error where there are two.

    The rules of a board, some tens at most, are one array, so this is a join on equal boards.
    """
    rule = F.struct("valid_from", "valid_to", "ordinary_pct", "st_pct", "ipo_days")
    boards = rules.groupBy(F.col("board").alias("_board")).agg(F.collect_list(rule).alias("_rules"))
    held = F.filter("_rules", lambda r: F.col("date").between(r.valid_from, r.valid_to))
    joined = rows.join(F.broadcast(boards), F.col("board") == F.col("_board"), "left").withColumn("_rules", held)
    one = unless(F.size("_rules") > 1, F.get("_rules", F.lit(0)), "several price-limit rules on", F.col("date"), F.col("board"))
    return joined.withColumn("_rule", one).select(*rows.columns, *(F.col(f"_rule.{c}").alias(c) for c in ("ordinary_pct", "st_pct", "ipo_days")))


def build_panel(master: DataFrame, calendar: DataFrame, quotes: DataFrame, actions: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a listed security and trading date.

    Prices are never filled: the prior close is the grid's previous date, so a gap gives null. The
    reference price is the source's own, else (prior close - cash) / multiplier. Returns include
    cash and splits and are null when suspended or missing. Limits use the ST rate for ST names
    that have one, and none during the first ``ipo_days`` dates. What trades has a positive volume and
    amount. ``beyond_limit`` marks closes outside their limits, which ``refuse_beyond_limits`` makes an error.
    """
    joined = grid(master, calendar).join(quotes, ["date", "security_id"], "left").join(actions, ["date", "security_id"], "left")
    joined = attach_limit_rules(joined, rules)
    present = F.col("open").isNotNull() & F.col("close").isNotNull() & F.col("volume").isNotNull() & F.col("amount").isNotNull()
    still = F.coalesce(F.col("is_suspended"), (F.col("volume") == 0) & (F.col("amount") == 0), F.lit(False))
    prior = F.lag("close").over(Window.partitionBy("security_id").orderBy("pos"))
    rows = joined.withColumns({"has_market_data": present, "suspended": still, "previous_close": prior, "multiplier": F.coalesce("share_multiplier", F.lit(1.0)), "cash": F.coalesce("cash_dividend", F.lit(0.0))})
    rows = rows.withColumn("reference", F.coalesce("reference_price", F.try_divide(F.col("previous_close") - F.col("cash"), F.col("multiplier"))))
    free = F.col("listing_age") < F.col("ipo_days")
    rate = F.when(F.coalesce("is_st", F.lit(False)), F.coalesce("st_pct", "ordinary_pct")).otherwise(F.col("ordinary_pct"))
    rows = rows.withColumns({
        "raw_return": F.when(present & ~F.col("suspended"), F.try_divide(F.col("close") * F.col("multiplier") + F.col("cash"), F.col("previous_close")) - 1),
        "upper_limit": F.when(~free, round_price(F.col("reference") * (1 + rate))), "lower_limit": F.when(~free, round_price(F.col("reference") * (1 - rate))),
    })
    at = lambda c: F.coalesce(F.abs(F.col("close") - F.col(c)) <= TOLERANCE, F.lit(False)) & F.col("has_market_data")
    rows = rows.withColumns({"limit_up": at("upper_limit"), "limit_down": at("lower_limit")})
    beyond = F.coalesce((F.col("close") > F.col("upper_limit") + TOLERANCE) | (F.col("close") < F.col("lower_limit") - TOLERANCE), F.lit(False))
    state = (
        F.when(F.col("suspended"), "suspended").when(F.col("limit_down"), "limit_down").when(F.col("limit_up"), "limit_up")
        .when(F.col("upper_limit").isNotNull() & F.col("has_market_data"), "normal").when(F.col("has_market_data"), "no_limit").otherwise("unavailable"))
    alike = lambda c: F.abs(F.col(c) - F.col("close")) <= TOLERANCE
    flat = alike("open") & F.coalesce(alike("high") & alike("low"), F.lit(True))
    locked = (F.col("limit_up") | F.col("limit_down")) & F.coalesce(flat, F.lit(False))
    return rows.withColumns({"beyond_limit": beyond & F.col("has_market_data"), "price_state": state, "locked": locked}).withColumn(
        "tradable", F.col("has_market_data") & ~F.col("suspended") & ~F.col("locked") & F.coalesce((F.col("volume") > 0) & (F.col("amount") > 0), F.lit(False)))


def refuse_beyond_limits(panel: DataFrame) -> DataFrame:
    """The panel; reading a close outside its limits is an error."""
    return refuse_rows(panel, F.col("beyond_limit"), "close beyond its price limit:", F.col("date"), F.col("security_id"))


def price_violations(quotes: DataFrame) -> DataFrame:
    """(rule, violations): a row for each rule that a quote table may break, in one pass. Columns that aren't there break none."""
    finite = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    has = lambda *names: [c for c in names if c in quotes.columns]
    prices, sizes = has("open", "close", "high", "low"), has("volume", "amount", "market_cap", "free_float_market_cap")
    rules = {f"{c}_not_finite": finite(c) for c in prices + sizes} | {f"{c}_not_positive": F.col(c) <= 0 for c in prices} | {f"{c}_negative": F.col(c) < 0 for c in sizes}
    return quotes.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items())).unpivot([], list(rules), "rule", "violations")
