"""Rank correlations, robust errors, trend tests and concentration."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.session import checkpoint_folder

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile


def average_rank(partition: list[str], value: str) -> Column:
    """Rank from 1, ties sharing the mean of their ranks."""
    order = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def moment_correlation(x: str, y: str) -> Column:
    """Pearson correlation from sums; null without spread."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    spread = (F.sum(F.col(x) * F.col(x)) - sx * sx / n) * (F.sum(F.col(y) * F.col(y)) - sy * sy / n)
    return F.try_divide(cov, F.sqrt(F.greatest(spread, F.lit(0.0))))


def align_forward(signals: DataFrame, residuals: DataFrame, signal: str, horizon: int = 1) -> DataFrame:
    """Signals with the residual of the date ``horizon`` positions on in the residuals' own calendar; gaps are not skipped."""
    calendar = residuals.select("date").distinct().withColumn("forward_return_date", F.lead("date", horizon).over(Window.orderBy("date")))
    future = residuals.select(F.col("date").alias("forward_return_date"), "security_id", F.col("residual_return").alias("forward_residual_return"))
    return signals.select("date", "security_id", signal).join(F.broadcast(calendar), "date").join(future, ["forward_return_date", "security_id"], "left")


def information_coefficients(signals: DataFrame, residuals: DataFrame, signal: str = "customer_shock", horizon: int = 1) -> DataFrame:
    """Rank and plain correlation of signal and forward residual by date; dates need two distinct values of each."""
    usable = align_forward(signals, residuals, signal, horizon).filter(F.col(signal).isNotNull() & F.col("forward_residual_return").isNotNull())
    ranked = usable.withColumns({"rx": average_rank(["date"], signal), "ry": average_rank(["date"], "forward_residual_return")})
    found = ranked.groupBy("date", "forward_return_date").agg(
        F.count("*").alias("eligible_count"), moment_correlation("rx", "ry").alias("rank_ic"), moment_correlation(signal, "forward_residual_return").alias("pearson_ic"),
        F.countDistinct(signal).alias("dx"), F.countDistinct("forward_residual_return").alias("dy"))
    return found.filter("eligible_count >= 2 AND dx >= 2 AND dy >= 2").drop("dx", "dy").withColumn("horizon", F.lit(horizon))


def newey_west(rows: DataFrame, value: str, order: str, lags: int) -> DataFrame:
    """One row: n, mean and the Bartlett-kernel standard error of the mean of an ordered series."""
    series = rows.filter(F.col(value).isNotNull()).select(F.col(order).alias("o"), F.col(value).alias("v"))
    mean = series.agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    centred = series.crossJoin(F.broadcast(mean)).withColumn("c", F.col("v") - F.col("mean"))
    lagged = centred.withColumns({f"c{k}": F.lag("c", k).over(Window.orderBy("o")) for k in range(1, lags + 1)})
    sums = [F.sum(F.col("c") * F.col("c" if k == 0 else f"c{k}")) * (1.0 if k == 0 else 2 * (1 - k / (lags + 1))) for k in range(lags + 1)]
    long_run = sum((F.coalesce(s, F.lit(0.0)) for s in sums[1:]), sums[0]) / F.first("n")
    return lagged.agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sqrt(F.greatest(long_run, F.lit(0.0)) / F.first("n")).alias("standard_error"))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null without trials."""
    trials = trials.cast("double")
    p = F.try_divide(successes, trials)
    middle = p + z * z / (2 * trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    scale = 1 + z * z / trials
    some = trials > 0
    return F.when(some, (middle - half) / scale), F.when(some, (middle + half) / scale)


def trend(series: DataFrame, x: str, y: str) -> DataFrame:
    """Theil-Sen slope and Kendall tau-b over the pairs of a short series (a row a year), each pair once."""
    left, right = series.select(F.col(x).alias("x1"), F.col(y).alias("y1")), series.select(F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = left.join(F.broadcast(right), F.col("x1") < F.col("x2")).withColumns({"slope": (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), "sign": F.signum(F.col("y2") - F.col("y1"))})
    total, moved = F.count("*"), F.count_if(F.col("sign") != 0)
    return pairs.agg(F.percentile("slope", 0.5).alias("theil_sen"), F.try_divide(F.sum("sign"), F.sqrt(total.cast("double") * moved)).alias("kendall_tau"))


def sign_test(up: Column, down: Column) -> Column:
    """Two-sided exact p of so many rises and falls among independent changes of even chance."""
    n = (up + down).cast("int")
    ways = lambda i: F.factorial(n) / (F.factorial(i) * F.factorial(n - i))
    tail = F.aggregate(F.sequence(F.lit(0), F.least(up, down).cast("int")), F.lit(0.0), lambda a, i: a + ways(i).cast("double"))
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))


def permutation_p(values: list[float]) -> float:
    """Probability that a random order of the values is as far from no trend, by concordant less discordant pairs, as theirs.

    The inversions of the orders of a multiset are counted by a Gaussian multinomial coefficient, built by
    products and exact quotients of polynomials.
    """
    n, ties = len(values), pd.Series(values).value_counts().tolist()
    ways = [1]

    def times(size: int) -> None:  # by 1 + q + ... + q ** (size - 1)
        nonlocal ways
        ways = [sum(ways[max(0, k - size + 1):k + 1]) for k in range(len(ways) + size - 1)]

    def over(size: int) -> None:
        nonlocal ways
        out: list[int] = []
        for k in range(len(ways) - size + 1):
            out.append(ways[k] - sum(out[max(0, k - size + 1):k]))
        ways = out
    for size in range(2, n + 1):
        times(size)
    for t in ties:
        for size in range(2, t + 1):
            over(size)
    trend = abs(sum((b > a) - (b < a) for k, a in enumerate(values) for b in values[k + 1:]))
    untied = len(ways) - 1
    return sum(w for k, w in enumerate(ways) if abs(untied - 2 * k) >= trend) / sum(ways)


def trend_tests(series: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, p): the exact permutation test of no trend for each short series (a row a year), in order of x."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: rows[group].iloc[:1], "p": [permutation_p(rows.sort_values(x)[y].tolist())]})
    return series.groupBy(group).applyInPandas(run, f"{group} {series.schema[group].dataType.simpleString()}, p double")


def holm(tests: DataFrame, p: str) -> DataFrame:
    """Step-down adjusted p-values."""
    order = Window.orderBy(p, "test")
    scaled = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(F.lit(1))) - F.row_number().over(order) + 1))
    return tests.withColumn("scaled", scaled).withColumn("holm_p", F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled")


def concentration(rows: DataFrame, value: str) -> DataFrame:
    """One row: HHI, effective number, Gini, mean, maximum and percentiles with linear interpolation.

    Values are counted first: what is ordered is one row a distinct value, not a row a node.
    """
    counts = rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    below = F.coalesce(F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank_sum", F.col("k") * below + F.col("k") * (F.col("k") + 1) / 2)
    sums = ranked.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("v")).alias("s"), F.sum(F.col("k") * F.col("v") * F.col("v")).alias("q"), F.sum(F.col("rank_sum") * F.col("v")).alias("r"), F.max("v").alias("largest"))
    parts = rows.agg(*(F.percentile(F.col(value).cast("double"), p / 100).alias(f"p{p}") for p in (90, 95, 99)))
    hhi = F.col("q") / (F.col("s") * F.col("s"))
    return sums.crossJoin(parts).select(
        hhi.alias("hhi"), (1 / hhi).alias("effective_nodes"), (2 * F.col("r") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"), (F.col("s") / F.col("n")).alias("mean"), "largest", "p90", "p95", "p99")


def block_bootstrap(series: DataFrame, value: str, order: str, block: int, replications: int, seed: int) -> DataFrame:
    """(replication, mean): moving-block bootstrap means, each replication with a generator of its own.

    The series is one row a date and is sent to the tasks; replications spread over them.
    """
    values = [r[0] for r in series.filter(F.col(value).isNotNull()).orderBy(order).select(value).collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means = []
            for k in batch["replication"]:
                draw, sample = random.Random(seed * 1_000_003 + int(k)), []
                while values and len(sample) < len(values):
                    start = draw.randrange(max(1, len(values) - block + 1))
                    sample += values[start:start + block]
                means.append(sum(sample[:len(values)]) / len(values) if values else None)
            yield pd.DataFrame({"replication": batch["replication"], "mean": means})
    return series.sparkSession.range(replications).withColumnRenamed("id", "replication").mapInPandas(run, "replication long, mean double")


def placebo_edges(pairs: DataFrame, seeds: int, rounds: int = 20) -> DataFrame:
    """(seed, supplier_id, customer_id): customers exchanged among suppliers, both degrees kept.

    Each round deals every seed's edges in pairs at random; a pair exchanges customers unless that
    makes a self-edge, a pair that is there or one that another exchange makes too. So no pair ever
    repeats. A seed whose edges end as the graph or with a self-edge of the graph has failed and
    gives one row with null ends. Edges stay distributed; rounds are written with checkpoint().
    """
    spark = pairs.sparkSession
    checkpoint_folder(spark)
    known = pairs.select(F.col("supplier_id").alias("s"), F.col("customer_id").alias("c")).distinct().checkpoint()
    groups = known.count() // 8 + 1
    ids = spark.range(seeds).withColumnRenamed("id", "seed")
    made = known.crossJoin(F.broadcast(ids)).select("seed", "s", "c")
    for k in range(rounds):
        rows = made.withColumn("draw", F.xxhash64(F.lit(k), "seed", "s", "c")).withColumn("group", F.pmod("draw", F.lit(groups)))
        dealt = Window.partitionBy("seed", "group").orderBy("draw", "s", "c")
        rows = rows.withColumn("place", F.row_number().over(dealt) - 1)
        end = F.struct("s", "c")
        rows = rows.withColumn("with", F.when(F.col("place") % 2 == 0, F.lead(end).over(dealt)).otherwise(F.lag(end).over(dealt)))
        fit = (F.col("with.s") != F.col("s")) & (F.col("with.c") != F.col("c")) & (F.col("with.c") != F.col("s"))
        rows = rows.withColumn("to", F.when(fit, F.col("with.c")))
        both = rows.withColumn("x", F.explode(F.array(F.struct(F.lit(False).alias("new"), F.col("c").alias("c")), F.struct(F.lit(True).alias("new"), F.col("to").alias("c")))))
        both = both.withColumn("alone", F.count("*").over(Window.partitionBy("seed", "s", "x.c")) == 1)
        free = both.filter(F.col("x.new")).withColumn("free", F.col("to").isNotNull() & F.col("alone"))
        pair = Window.partitionBy("seed", "group", F.floor(F.col("place") / 2))
        free = free.withColumn("free", F.min("free").over(pair) & (F.count("*").over(pair) == 2))
        made = free.select("seed", "s", F.when(F.col("free"), F.col("to")).otherwise(F.col("c")).alias("c"))
        if k % 4 == 3 or k == rounds - 1:
            made = made.checkpoint()
    moved = made.join(known.withColumn("old", F.lit(True)), ["s", "c"], "left").groupBy("seed").agg(F.count_if(F.col("old").isNull()).alias("moved"), F.count_if(F.col("s") == F.col("c")).alias("loops"))
    good = moved.filter("moved > 0 AND loops = 0").select("seed")
    kind = pairs.schema["supplier_id"].dataType
    found = made.join(F.broadcast(good), "seed").select("seed", F.col("s").alias("supplier_id"), F.col("c").alias("customer_id"))
    failed = ids.join(F.broadcast(good), "seed", "left_anti").select("seed", F.lit(None).cast(kind).alias("supplier_id"), F.lit(None).cast(kind).alias("customer_id"))
    return found.union(failed)
