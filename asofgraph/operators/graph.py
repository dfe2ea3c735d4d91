"""Directed supplier-to-customer edges with validity intervals, and what is measured on them.

All functions take and return lazy DataFrames. Instants are UTC timestamps. An interval is
half-open, [effective_start, effective_end); a null end means open where a function says so.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.functions.clock import local_year, year_end
from asofgraph.operators.intervals import closes_before, day_table, islands, latest, numbered
from asofgraph.operators.refusals import refuse_rows, unless
from asofgraph.session import checkpoint_folder

EDGE_LIFE_DAYS = 550
PAIR = ["supplier_id", "customer_id"]
PAIR_DOCUMENT = [*PAIR, "source_document_id"]
#: Trading dates in one array of residuals.
SPAN = 32
#: Upper ends of the edge age buckets in days; the last is open.
AGE_BUCKETS = ((90, "0-90"), (180, "91-180"), (365, "181-365"), (None, "366+"))


def orient(mentions: DataFrame, life_days: int = EDGE_LIFE_DAYS) -> DataFrame:
    """Resolved mentions as directed edges that begin at publication and live ``life_days`` days.

    A customer mention makes its source the supplier, a supplier mention the other way. Mentions
    that aren't resolved, or to a null or blank entity, and self-edges make no edge.
    """
    other, own = F.col("resolved_entity_id"), F.col("source_company_id")
    customer = F.col("relationship_type") == "customer"
    resolved = (F.col("resolution_status") == "resolved") & other.isNotNull() & (F.trim(other.cast("string")) != "")
    rows = mentions.filter(resolved).withColumns({
        "supplier_id": F.when(customer, own).otherwise(other), "customer_id": F.when(customer, other).otherwise(own),
        "effective_start": F.col("publication_datetime"), "effective_end": F.col("publication_datetime") + F.make_dt_interval(F.lit(life_days)),
    })
    return rows.filter(F.col("supplier_id") != F.col("customer_id"))


def collapse(evidence: DataFrame, life: tuple[str, ...] = ("publication_datetime", "effective_start", "effective_end"), strict: bool = False) -> DataFrame:
    """One edge for each pair and document: the shared dates, the largest confidence and equal weight.

    source_period_end and source_company_id come along where the evidence has them. With ``strict``, evidence of
    one edge that disagrees in a shared column is an error (``conflicts`` lists it).
    """
    shared = [*life, *(c for c in ("source_period_end", "source_company_id") if c in evidence.columns)]
    differ = lambda c: (F.min(c) != F.max(c)) | (F.count(c) != F.count("*")) & (F.count(c) > 0)
    value = lambda c: unless(differ(c), F.min(c), f"evidence of one edge disagrees in {c}:", *map(F.col, PAIR_DOCUMENT)) if strict else F.min(c)
    found = evidence.groupBy(*PAIR_DOCUMENT).agg(*(value(c).alias(c) for c in shared), F.max("relationship_confidence").alias("relationship_confidence"))
    return found.withColumns({"economic_weight": F.lit(1.0), "weight_source": F.lit("equal")})


def conflicts(evidence: DataFrame, invariants: tuple[str, ...] = ("publication_datetime", "effective_start", "effective_end")) -> DataFrame:
    """Pairs and documents whose evidence rows disagree in a column that must be one value (null is a value)."""
    differ = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in invariants]
    return evidence.groupBy(*PAIR_DOCUMENT).agg(*differ).filter(" OR ".join(f"{c} > 1" for c in invariants))


def snapshot(edges: DataFrame, as_of: F.Column, collapse_pairs: bool = True) -> DataFrame:
    """Edges active at an instant; of several for a pair, the newest by start, confidence and document."""
    active = edges.filter((F.col("effective_start") <= as_of) & (as_of < F.col("effective_end")))
    if not collapse_pairs:
        return active
    return latest(active, PAIR, [F.desc_nulls_last(c) for c in ("effective_start", "relationship_confidence", "source_document_id")])


def listed_intervals(edges: DataFrame, master: DataFrame) -> DataFrame:
    """Edge intervals cut to the time in which both ends are listed; edges without such time go.

    The master has one row a security and joins on equal keys, so Spark may broadcast it if small.
    """
    side = lambda end: master.select(
        F.col("security_id").alias(f"{end}_id"), F.col("listing_date").cast("timestamp").alias(f"{end}_from"), F.col("delisting_date").cast("timestamp").alias(f"{end}_to"))
    both = edges.join(side("supplier"), "supplier_id").join(side("customer"), "customer_id")
    start = F.greatest("effective_start", "supplier_from", "customer_from")
    end = F.least("effective_end", "supplier_to", "customer_to")
    return both.withColumn("listed_start", start).withColumn("listed_end", end).filter("listed_start < listed_end").drop("supplier_from", "supplier_to", "customer_from", "customer_to")


def year_frame(years: DataFrame) -> DataFrame:
    return years.select("year").distinct().withColumn("year_end", year_end(F.col("year")))


def active_at_year_ends(edges: DataFrame, years: DataFrame, start: str = "effective_start", end: str = "effective_end") -> DataFrame:
    """Every edge with each year at whose end it is active: an edge generates its own few years, no range join."""
    ends = local_year(F.col(end)) - 1
    first = local_year(F.col(start))
    spread = edges.withColumn("year", F.explode(F.when(first <= ends + 1, F.sequence(first, ends + 1)).otherwise(F.array().cast("array<int>"))))
    kept = spread.withColumn("year_end", year_end(F.col("year"))).filter((F.col(start) <= F.col("year_end")) & (F.col("year_end") < F.col(end)))
    return kept.join(years.select("year").distinct(), "year", "left_semi")


def pairs_at_year_ends(edges: DataFrame, years: DataFrame) -> DataFrame:
    """Of the edges of a pair that are active at a year's end, the newest by start, confidence and document."""
    return latest(active_at_year_ends(edges, years), ["year", *PAIR], [F.desc_nulls_last(c) for c in ("effective_start", "relationship_confidence", "source_document_id")])


def yearly_diagnostics(edges: DataFrame, years: DataFrame) -> DataFrame:
    """For each year, empty ones too: active pairs, connected stocks, suppliers, customers, median age in days."""
    active = pairs_at_year_ends(edges, years)
    age = (F.unix_micros("year_end") - F.unix_micros("effective_start")) / 86_400_000_000
    pairs = active.groupBy("year").agg(
        F.count("*").alias("active_edges"), F.countDistinct("supplier_id").alias("suppliers"), F.countDistinct("customer_id").alias("customers"), F.median(age).alias("median_age_days"))
    ends = active.select("year", F.explode(F.array(*PAIR)).alias("node")).groupBy("year").agg(F.countDistinct("node").alias("connected_stocks"))
    joined = years.select("year").distinct().join(pairs, "year", "left").join(ends, "year", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("year", *map(zero, ("active_edges", "connected_stocks", "suppliers", "customers")), "median_age_days")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct customers, suppliers and neighbours of each node."""
    pairs = edges.select(*PAIR).distinct()
    both = pairs.select(F.col("supplier_id").alias("node"), F.col("customer_id").alias("other"), F.lit(1).alias("out")).union(
        pairs.select(F.col("customer_id"), F.col("supplier_id"), F.lit(0)))
    return both.groupBy("node").agg(
        F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"), F.countDistinct("other").alias("total_degree"))


def roles(edges: DataFrame) -> DataFrame:
    """supplier, customer or both, for each node."""
    role = F.when((F.col("out_degree") > 0) & (F.col("in_degree") > 0), "both").when(F.col("out_degree") > 0, "supplier").otherwise("customer")
    return degrees(edges).select("node", role.alias("role"))


def age_buckets(edges: DataFrame, as_of: F.Column) -> DataFrame:
    """Edges by age in days, a row for every bucket."""
    age = (F.unix_micros(as_of) - F.unix_micros("effective_start")) / 86_400_000_000
    label = F.lit(AGE_BUCKETS[-1][1])
    for most, name in reversed(AGE_BUCKETS[:-1]):
        label = F.when(age <= most, name).otherwise(label)
    names = edges.sparkSession.createDataFrame([(n,) for _, n in AGE_BUCKETS], "bucket string")
    counts = edges.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("edge_count"))


def coverage_summary(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of global counts and rates; a rate of nothing is null."""
    named = mentions.agg(
        F.count("*").alias("mentions"), F.count_if(F.col("name_class") == "named").alias("explicit_mentions"),
        F.count_if(F.col("resolution_status") == "resolved").alias("resolved_mentions"),
        F.min("publication_datetime").alias("first_publication"), F.max("publication_datetime").alias("last_publication"))
    pairs = edges.agg(
        F.countDistinct(*PAIR).alias("unique_pairs"), F.countDistinct("supplier_id").alias("suppliers"), F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("source_document_id").alias("edge_documents"))
    nodes = edges.select(F.explode(F.array(*PAIR)).alias("node")).agg(F.countDistinct("node").alias("connected_stocks"))
    rates = {"explicit_rate": F.try_divide("explicit_mentions", "mentions"), "resolved_rate": F.try_divide("resolved_mentions", "explicit_mentions")}
    return named.crossJoin(pairs).crossJoin(nodes).withColumns(rates)


def yearly_disclosures(mentions: DataFrame) -> DataFrame:
    """Mentions by publication year in the market's zone, with rates (of nothing: null)."""
    counts = mentions.groupBy(local_year(F.col("publication_datetime")).alias("year")).agg(
        F.count("*").alias("mentions"), F.count_if(F.col("name_class") == "named").alias("explicit_mentions"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved_mentions"))
    return counts.withColumns({"explicit_rate": F.try_divide("explicit_mentions", "mentions"), "resolved_rate": F.try_divide("resolved_mentions", "explicit_mentions")})


def source_documents(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Mentions and edges by source document; documents that have only one of the two are kept."""
    said = mentions.groupBy("source_document_id").agg(F.count("*").alias("mention_count"), F.countDistinct("counterparty_raw_name").alias("name_count"))
    drawn = edges.groupBy("source_document_id").agg(F.countDistinct(*PAIR).alias("pair_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return said.join(drawn, "source_document_id", "full").select("source_document_id", *map(zero, ("mention_count", "name_count", "pair_count")))


def endpoint_check(edges: DataFrame, master: DataFrame) -> DataFrame:
    """One row: distinct endpoints, those absent from the master, and those without a listing date."""
    nodes = edges.select(F.explode(F.array(*PAIR)).alias("security_id")).distinct()
    joined = nodes.join(master.select("security_id", "listing_date", F.lit(1).alias("known")), "security_id", "left")
    return joined.agg(F.count("*").alias("endpoints"), F.count_if(F.col("known").isNull()).alias("absent"), F.count_if(F.col("known").isNotNull() & F.col("listing_date").isNull()).alias("unlisted"))


def industry_static(edges: DataFrame, master: DataFrame) -> DataFrame:
    """Distinct connected nodes by industry; an unknown industry is null."""
    nodes = edges.select(F.explode(F.array(*PAIR)).alias("security_id")).distinct()
    return nodes.join(master.select("security_id", "industry_code"), "security_id", "left").groupBy("industry_code").agg(F.count("*").alias("node_count"))


def industry_at(history: DataFrame, as_of: F.Column) -> DataFrame:
    """security_id, industry_code in force at a date; securities with two codes in force are ambiguous and go."""
    active = history.filter((F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (as_of < F.col("valid_to"))))
    return active.groupBy("security_id").agg(F.countDistinct("industry_code").alias("codes"), F.max("industry_code").alias("industry_code")).filter("codes = 1").drop("codes")


def industry_incidence(edges: DataFrame, industries: DataFrame) -> DataFrame:
    """Edge ends by industry and each industry's share of all ends (null: unclassified)."""
    ends = edges.select(F.explode(F.array(*PAIR)).alias("security_id"))
    counts = ends.join(industries, "security_id", "left").groupBy("industry_code").agg(F.count("*").alias("incidences"))
    return counts.withColumn("share", F.col("incidences") / F.sum("incidences").over(Window.partitionBy(F.lit(1))))


def industry_by_year(active: DataFrame, history: DataFrame) -> DataFrame:
    """For each year: industries among edge ends, largest share, classified and all ends, ambiguous nodes.

    ``active`` has a row for each edge and year end, as active_at_year_ends returns it.
    """
    ends = active.select("year", "year_end", F.explode(F.array(*PAIR)).alias("security_id"))
    day = F.to_date("year_end")
    known = ends.join(history, "security_id", "left").withColumn(
        "code", F.when((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))), F.col("industry_code")))
    nodes = known.groupBy("year", "security_id").agg(F.countDistinct("code").alias("codes"), F.max("code").alias("code"))
    weight = ends.groupBy("year", "security_id").agg(F.count("*").alias("ends"))
    joined = weight.join(nodes, ["year", "security_id"]).withColumn("code", F.when(F.col("codes") == 1, F.col("code")))
    per = joined.groupBy("year", "code").agg(F.sum("ends").alias("ends"), F.count_if(F.col("codes") > 1).alias("ambiguous"))
    classified = F.sum(F.when(F.col("code").isNotNull(), F.col("ends")).otherwise(0))
    return per.groupBy("year").agg(
        F.count("code").alias("industries"), classified.alias("classified_ends"), F.sum("ends").alias("all_ends"), F.sum("ambiguous").alias("ambiguous_nodes"),
        F.try_divide(F.max(F.when(F.col("code").isNotNull(), F.col("ends"))), classified).alias("largest_share"))


def integrity(edges: DataFrame, mentions: DataFrame, life_days: int = EDGE_LIFE_DAYS) -> DataFrame:
    """(check, actual): a row for each counter of rows that must not exist."""
    late = (F.unix_micros("effective_end") - F.unix_micros("effective_start")) > life_days * 86_400_000_000
    counts = edges.agg(
        F.count_if(F.col("publication_datetime") > F.col("effective_start")).alias("used_before_publication"),
        F.count_if(F.col("effective_start") >= F.col("effective_end")).alias("empty_interval"), F.count_if(late).alias("beyond_maximum_age"),
        F.count_if(F.col("supplier_id") == F.col("customer_id")).alias("self_edges"), F.count_if(F.col("source_document_id").isNull()).alias("missing_provenance"))
    repeated = edges.groupBy(*PAIR_DOCUMENT).count().filter("count > 1").agg(F.count("*").alias("duplicate_keys"))
    lost = edges.select("source_document_id").distinct().join(mentions.select("source_document_id"), "source_document_id", "left_anti").agg(F.count("*").alias("documents_without_mentions"))
    wide = counts.crossJoin(repeated).crossJoin(lost)
    return wide.unpivot([], wide.columns, "check", "actual")


def gate(yearly: DataFrame, least_edges: int, least_stocks: int, least_years: int, least_median: float) -> DataFrame:
    """One row: usable years, longest run, median of connected stocks over the usable years, and whether all thresholds hold.

    Years with enough edges and stocks qualify; usable are those inside a run of at least ``least_years``. No usable
    year means no median, which fails.
    """
    from asofgraph.operators.intervals import consecutive_runs

    fit = yearly.filter((F.col("active_edges") >= least_edges) & (F.col("connected_stocks") >= least_stocks))
    runs = consecutive_runs(fit, "year")
    longest = runs.agg(F.coalesce(F.max("run_length"), F.lit(0)).cast("long").alias("longest_run"))
    years = runs.filter(F.col("run_length") >= least_years).select(F.explode(F.sequence("run_start", "run_end")).alias("year"))
    middle = fit.join(years, "year").agg(F.count("*").alias("usable_years"), F.median("connected_stocks").alias("median_connected_stocks"))
    passed = (F.col("longest_run") >= least_years) & F.coalesce(F.col("median_connected_stocks") >= least_median, F.lit(False))
    return middle.crossJoin(longest).withColumn("passed", passed).withColumn("outcome", F.when(passed, "FEASIBLE").otherwise("INFEASIBLE_DATA"))


def check_records(verdict: DataFrame, counters: DataFrame, least_years: int, least_median: float) -> DataFrame:
    """(check, actual, threshold, operator, passed): the coverage checks of ``gate`` and a zero check for each counter of ``integrity``.

    A minimum without an actual value fails.
    """
    record = lambda name, actual, operator, threshold, passed: F.struct(
        name.alias("check"), actual.cast("double").alias("actual"), F.lit(float(threshold)).alias("threshold"), F.lit(operator).alias("operator"), F.coalesce(passed, F.lit(False)).alias("passed"))
    coverage = F.array(
        record(F.lit("consecutive_usable_years"), F.col("longest_run"), ">=", least_years, F.col("longest_run") >= least_years),
        record(F.lit("usable_years_median_connected_stocks"), F.col("median_connected_stocks"), ">=", least_median, F.col("median_connected_stocks") >= least_median))
    zero = record(F.col("check"), F.col("actual"), "==", 0, F.col("actual") == 0)
    return verdict.select(F.explode(coverage).alias("r")).select("r.*").union(counters.select(zero.alias("r")).select("r.*"))


def diffusion_signals(edges: DataFrame, residuals: DataFrame, calendar: DataFrame | None = None, customers_only: bool = False) -> DataFrame:
    """Mean neighbour residual of every node with an active edge at each date's close.

    An edge is active from its start to before its end (null: open). Overlapping evidence for a pair
    counts once; null residuals are left out of mean and count. Intervals become calendar positions
    through a broadcast day table, and evidence of a pair becomes disjoint intervals, cut into blocks of SPAN positions. A
    block meets its neighbour's residuals of the block as one array, and positions are generated only where all of a
    node's are together: no range join, no distinct over pairs and dates, and no shuffle of them. Edges of a node to itself
    or without one of their ends are an error. ``calendar`` has the residuals' dates, if they are at hand;
    ``customers_only`` leaves the supplier side out, and with it nodes that are no supplier then.
    """
    calendar = residuals if calendar is None else calendar
    days = day_table(calendar)
    dates = numbered(calendar)
    edges = refuse_rows(edges, F.col("supplier_id").isNull() | F.col("customer_id").isNull(), "an edge without one of its ends")
    edges = refuse_rows(edges, F.col("supplier_id") == F.col("customer_id"), "an edge to itself:", F.col("supplier_id"))
    total = dates.agg(F.count("*").cast("long").alias("n"))
    held = closes_before(closes_before(edges.select(*PAIR, "effective_start", "effective_end"), "effective_start", days, "low"), "effective_end", days, "high")
    held = held.crossJoin(F.broadcast(total)).withColumn("high", F.coalesce("high", "n")).select(*PAIR, F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    spans = islands(held, PAIR, "low", "high")
    block = lambda at: F.floor(at / SPAN)
    cut = spans.withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high") - 1))))
    cut = cut.withColumn("from", F.greatest(F.col("low"), F.col("block") * SPAN)).withColumn("size", F.least(F.col("high"), (F.col("block") + 1) * SPAN) - F.col("from")).select(*PAIR, "block", "from", F.col("size").cast("int").alias("size"))
    both = cut.select("block", "from", "size", F.col("supplier_id").alias("security_id"), F.col("customer_id").alias("other"), F.lit(True).alias("is_customer"))
    if not customers_only:
        both = both.union(cut.select("block", "from", "size", "customer_id", "supplier_id", F.lit(False)))
    values = residuals.filter("residual_return IS NOT NULL").join(F.broadcast(dates), "date").select(block(F.col("pos")).alias("block"), (F.col("pos") % SPAN).alias("k"), F.col("security_id").alias("other"), "residual_return")
    series = values.groupBy("other", "block").agg(F.collect_list(F.struct("k", "residual_return")).alias("held"))
    series = series.select("other", "block", F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda k: F.get(F.col("held.residual_return"), (F.array_position(F.col("held.k"), k) - 1).cast("int"))).alias("series"))
    none = F.array_repeat(F.lit(None).cast("double"), F.col("size"))
    part = F.coalesce(F.slice("series", (F.col("from") - F.col("block") * SPAN + 1).cast("int"), F.col("size")), none)
    met = both.join(series, ["block", "other"], "left").select("security_id", "block", "is_customer", "from", part.alias("part")).repartition("security_id", "block")
    joined = met.select("security_id", "block", "is_customer", "from", F.posexplode("part").alias("k", "residual_return")).withColumn("pos", F.col("from") + F.col("k"))
    customer, supplier = F.when(F.col("is_customer"), F.col("residual_return")), F.when(~F.col("is_customer"), F.col("residual_return"))
    found = joined.groupBy("security_id", "block", "pos").agg(
        F.avg(customer).alias("customer_shock"), F.avg(supplier).alias("supplier_shock"),
        F.count(customer).alias("customer_neighbor_count"), F.count(supplier).alias("supplier_neighbor_count"))
    return found.join(F.broadcast(dates), "pos").select("date", "security_id", "customer_shock", "supplier_shock", "customer_neighbor_count", "supplier_neighbor_count", F.col("date").alias("graph_snapshot_date"))


def weak_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over edges in either direction.

    Rounds go on until nothing changes; with ``rounds``, a graph that needs more is an error.

    Labels fall to the least label of the neighbours and then to the label of that label, so chains
    halve each round. Every round is written with checkpoint() to the shared folder.
    """
    spark = edges.sparkSession
    checkpoint_folder(spark)
    pairs = edges.select(F.col("supplier_id").alias("a"), F.col("customer_id").alias("b")).distinct()
    both = pairs.union(pairs.select("b", "a")).checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")).checkpoint()
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("low"))
        hop = label.select(F.col("node").alias("at"), F.col("component").alias("next"))
        after = step.join(hop, F.col("low") == F.col("at"), "left").select("node", F.least("low", F.coalesce("next", "low")).alias("component"), F.col("component").alias("old")).checkpoint()
        changed = after.filter("component <> old").limit(1).count()
        label = after.select("node", "component")
        if not changed:
            break
    return label
