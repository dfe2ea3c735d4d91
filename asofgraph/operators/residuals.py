"""Rolling-beta residual returns from lagged window sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.operators.intervals import numbered
from asofgraph.operators.refusals import unless


def attach_industry(panel: DataFrame, history: DataFrame) -> DataFrame:
    """The industry in force on each row's date, [from, to), open if to is null; an error where there are two.

    A security's few memberships are one array, so each row meets them once and is never doubled.
    """
    known = history.groupBy(F.col("security_id").alias("_id")).agg(F.collect_list(F.struct("industry_code", "valid_from", "valid_to")).alias("_known"))
    held = F.filter("_known", lambda h: (h.valid_from <= F.col("date")) & (h.valid_to.isNull() | (F.col("date") < h.valid_to)))
    joined = panel.join(known, F.col("security_id") == F.col("_id"), "left").withColumn("_known", held)
    one = unless(F.size("_known") > 1, F.get("_known", F.lit(0)), "several industries of one security on", F.col("date"), F.col("security_id"))
    return joined.withColumn("_one", one).select(*panel.columns, F.col("_one.industry_code").alias("industry_code"))


def leave_one_out(panel: DataFrame, history: DataFrame) -> DataFrame:
    """date, security_id, industry_code, peer count, and the mean return of the others in the industry.

    Sums are aggregated per date and industry first and joined back, so a large industry needs no
    single task.
    """
    rows = attach_industry(panel.select("date", "security_id", "raw_return"), history)
    sums = rows.filter("industry_code IS NOT NULL AND raw_return IS NOT NULL").groupBy("date", "industry_code").agg(F.sum("raw_return").alias("s"), F.count("*").alias("n"))
    joined = rows.join(sums, ["date", "industry_code"], "left")
    valid = F.col("industry_code").isNotNull() & F.col("raw_return").isNotNull()
    return joined.select(
        "date", "security_id", "industry_code", F.when(valid, F.col("n") - 1).alias("industry_peer_count"),
        F.when(valid & (F.col("n") > 1), (F.col("s") - F.col("raw_return")) / (F.col("n") - 1)).alias("industry_return"))


def market_returns(panel: DataFrame) -> DataFrame:
    """Equal-weight mean return by date."""
    return panel.groupBy("date").agg(F.avg("raw_return").alias("market_return"))


def residual_returns(panel: DataFrame, market: DataFrame, industry: DataFrame | None = None, window: int = 60, lag: int = 1, least: int = 20) -> DataFrame:
    """Residuals of each security's return after market and, where known, industry.

    The grid is every security by every factor date, so windows count dates, not quotes. Betas of
    row t come from rows t - lag - window + 1 to t - lag: all sums share one window and one shuffle by
    security. The industry model is used if it can be fitted and the day has an industry return; the window's
    ends are those of the model used. A panel with ``is_suspended`` counts suspended rows as without return.
    """
    dates = numbered(market)
    if "is_suspended" in panel.columns:
        panel = panel.withColumn("raw_return", F.when(~F.coalesce("is_suspended", F.lit(False)), F.col("raw_return")))
    keys = panel.select("security_id").distinct().crossJoin(F.broadcast(dates.join(market, "date")))
    rows = keys.join(panel.select("date", "security_id", "raw_return", F.lit(True).alias("in_panel")), ["date", "security_id"], "left")
    if industry is not None:
        rows = rows.join(industry.select("date", "security_id", "industry_return"), ["date", "security_id"], "left")
    else:
        rows = rows.withColumn("industry_return", F.lit(None).cast("double"))
    span = Window.partitionBy("security_id").orderBy("pos").rowsBetween(-(window + lag - 1), -lag)
    y, m, i = F.col("raw_return"), F.col("market_return"), F.col("industry_return")
    one, two = y.isNotNull() & m.isNotNull(), y.isNotNull() & m.isNotNull() & i.isNotNull()
    total = lambda ok, value: F.sum(F.when(ok, value)).over(span)
    moments: dict[str, Column] = {"n1": total(one, F.lit(1)), "y1": total(one, y), "m1": total(one, m), "mm1": total(one, m * m), "my1": total(one, m * y)}
    moments |= {"n2": total(two, F.lit(1)), "y2": total(two, y), "m2": total(two, m), "i2": total(two, i), "mm2": total(two, m * m), "ii2": total(two, i * i), "mi2": total(two, m * i), "my2": total(two, m * y), "iy2": total(two, i * y)}
    ends = {f"{name}{k}": end(F.when(ok, F.col("date"))).over(span) for name, end in (("start", F.min), ("end", F.max)) for k, ok in ((1, one), (2, two))}
    rows = rows.withColumns(moments | ends)
    centred = lambda a, b, ab, n: F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col(n))
    rows = rows.withColumns({"smm": centred("m1", "m1", "mm1", "n1"), "smy": centred("m1", "y1", "my1", "n1")})
    rows = rows.withColumns({a + b: centred(x, z, xz, "n2") for a, b, x, z, xz in (
        ("t", "mm", "m2", "m2", "mm2"), ("t", "ii", "i2", "i2", "ii2"), ("t", "mi", "m2", "i2", "mi2"), ("t", "my", "m2", "y2", "my2"), ("t", "iy", "i2", "y2", "iy2"))})
    rows = rows.withColumn("det", F.col("tmm") * F.col("tii") - F.col("tmi") * F.col("tmi"))
    ok1 = F.coalesce((F.col("n1") >= least) & (F.abs("smm") > 1e-18), F.lit(False))
    floor = 1e-14 * F.greatest(F.lit(1.0), F.abs("tmm") * F.abs("tii"))
    ok2 = F.coalesce((F.col("n2") >= least) & (F.abs("det") > floor), F.lit(False))
    rows = rows.withColumns({
        "b1": F.when(ok1, F.try_divide("smy", "smm")), "bm": F.when(ok2, F.try_divide(F.col("tmy") * F.col("tii") - F.col("tiy") * F.col("tmi"), F.col("det"))),
        "bi": F.when(ok2, F.try_divide(F.col("tiy") * F.col("tmm") - F.col("tmy") * F.col("tmi"), F.col("det")))})
    rows = rows.withColumns({
        "a1": F.try_divide(F.col("y1") - F.col("b1") * F.col("m1"), F.col("n1")),
        "a2": F.try_divide(F.col("y2") - F.col("bm") * F.col("m2") - F.col("bi") * F.col("i2"), F.col("n2")), "use": ok2 & i.isNotNull()})
    pick = lambda a, b: F.when(F.col("use"), F.col(a)).otherwise(F.col(b))
    rows = rows.withColumns({
        "residual_model": F.when(F.col("use"), "market_plus_pit_industry").otherwise("market_only"), "alpha": pick("a2", "a1"), "beta_market": pick("bm", "b1"),
        "beta_industry": F.when(F.col("use"), F.col("bi")), "beta_observation_count": pick("n2", "n1").cast("long")})
    guess = F.col("alpha") + F.col("beta_market") * m + F.coalesce(F.col("beta_industry") * i, F.lit(0.0))
    return rows.withColumn("residual_return", F.when(F.col("beta_market").isNotNull(), y - guess)).filter("in_panel").select(
        "date", "security_id", "raw_return", "market_return", "industry_return", "residual_return", "alpha", "beta_market", "beta_industry", "beta_observation_count",
        pick("start2", "start1").alias("beta_window_start"), pick("end2", "end1").alias("beta_window_end"), "residual_model")
