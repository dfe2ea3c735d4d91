"""What showed only on larger tables: each case is one that the earlier code got wrong or that grew without bound."""

import datetime as dt

from pyspark.sql import functions as F

from asofgraph.functions import names
from asofgraph.operators import graph, quality, resolve
from asofgraph.plans import market_queries, text_queries


def test_only_an_exact_local_midnight_is_a_bare_date(spark):
    at = [dt.datetime(2024, 1, 3, 16, 0, 0, ms * 1000, dt.UTC) for ms in (0, 1, 999)] + [dt.datetime(1965, 1, 3, 16, 0, 0, 0, dt.UTC), dt.datetime(1965, 1, 3, 16, 0, 0, 1000, dt.UTC)]
    usable, kind = names.publication_timing(F.col("ms"))
    found = spark.createDataFrame([(k, round(t.timestamp() * 1000)) for k, t in enumerate(at)], "k int, ms long").select("k", kind.alias("kind"), F.to_date(usable).cast("string").alias("day")).orderBy("k").collect()
    assert [(r.kind, r.day) for r in found] == [("date_only", "2024-01-04"), ("exact", "2024-01-03"), ("exact", "2024-01-03"), ("date_only", "1965-01-04"), ("exact", "1965-01-03")]


def most_rows(found, counted="numOutputRows"):
    """The rows of a table, and the most that any step of its plan put out (or another metric)."""
    rows, most, todo = found.collect(), 0, [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec") or kind == "ReusedExchangeExec":
            todo.append(node.plan() if kind.endswith("QueryStageExec") else node.child())
        metric = node.metrics().get(counted)
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows, most


def aliases_of_few_names(spark):
    """2,000 aliases of two names with many bounds, some open, some of one entity twice, some for entities without id."""
    start = lambda k: None if k % 11 == 0 else dt.date(2000, 1, 1) + dt.timedelta(k * 37 % 900)
    rows = [(None if k % 97 == 5 else k % 700, "acme" if k % 3 else "acmf", start(k), None if k % 5 == 0 else (start(k) or dt.date(2000, 1, 1)) + dt.timedelta(k * 13 % 400 - 5)) for k in range(2000)]
    return rows, spark.createDataFrame(rows, "entity_id long, normalized_name string, valid_from date, valid_to date")


def test_days_do_not_meet_every_alias_of_their_name(spark):
    rows, aliases = aliases_of_few_names(spark)
    days = [dt.date(1999, 12, 1) + dt.timedelta(k) for k in range(1000)]
    names = spark.createDataFrame([(n, d) for n in ("acme", "acmf", "other") for d in days] * 2, "normalized_name string, day date")
    found, most = most_rows(resolve.alias_candidates(names, aliases))
    plain = {}
    for day in days:
        for entity, name, low, high in rows:
            if (low is None or low <= day) and (high is None or day < high):
                plain.setdefault((name, day), set()).add(entity)
    assert {(r.normalized_name, r.day): (r.candidate_count, r.entity_id) for r in found} == {k: (len(v - {None}), min(v - {None}, default=None)) for k, v in plain.items()}
    assert len(found) == len(plain) and most < 150_000  # days times aliases are 2,000,000


def test_similar_names_do_not_meet_every_alias(spark):
    _, aliases = aliases_of_few_names(spark)
    names = spark.createDataFrame([("acmes", dt.date(2000, 1, 1) + dt.timedelta(k)) for k in range(1000)], "normalized_name string, day date")
    found, most = most_rows(resolve.fuzzy_best(names, aliases, 85, 2))
    assert len(found) == 1000 and {(r.best_alias, round(r.score, 3), r.second_score) for r in found} == {("acme", 88.889, 0.0)} and most < 150_000


def test_names_are_decided_once_a_day(spark):
    mentions = spark.range(50_000).select(F.col("id").alias("source_document_id"), (F.col("id") % 7).alias("source_company_id"), F.concat(F.lit("Acme "), F.col("id") % 3).alias("counterparty_raw_name"), F.lit("2020-01-02").cast("timestamp").alias("publication_datetime"))
    mentions = mentions.union(mentions.limit(5).withColumns({"counterparty_raw_name": F.lit(None).cast("string"), "publication_datetime": F.lit(None).cast("timestamp")}))
    aliases = spark.createDataFrame([("E1", "acme 1", None, None), ("E2", "acme 2", None, dt.date(2019, 1, 1))], "entity_id string, alias string, valid_from date, valid_to date")
    kept = []
    audit = resolve.resolve(mentions, aliases, fuzzy=False, keep=lambda rows: kept.append(rows.count()) or rows)
    assert kept == [4] and audit.count() == 50_005
    assert {tuple(r) for r in audit.groupBy("counterparty_raw_name", "resolution_status", "resolved_entity_id").count().collect()} == {("Acme 0", "unresolved", None, 16667), ("Acme 1", "resolved", "E1", 16667), ("Acme 2", "unresolved", None, 16666), (None, "invalid_name", None, 5)}


def test_strata_are_cut_before_they_are_gathered(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("s"), F.col("id").alias("k"))
    found = quality.stratified_sample(rows, ["s"], ["k"], 10, 42)
    assert sorted(r.s for r in found.collect()) == [0] * 5 + [1] * 5
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_names_are_matched_with_their_evidence_once(spark, monkeypatch):
    mentions = spark.range(30_000).select(F.concat(F.lit("Acme "), F.col("id") % 3).alias("counterparty_raw_name"), F.concat(F.lit("says acme"), F.col("id") % 2).alias("evidence_text"))
    monkeypatch.setattr(text_queries, "frame", lambda *a: mentions)
    seen, plain = [], quality.evidence_support
    monkeypatch.setattr(quality, "evidence_support", lambda rows, *more: seen.append(rows.count()) or plain(rows, *more))
    assert tuple(text_queries.evidence_support(spark, "").first()) == (30_000, 10_000, 0.333333333) and seen == [6]


def test_active_pairs_are_not_shuffled_by_date(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(200)]
    at = lambda k: dt.datetime.combine(days[k], dt.time(12), dt.UTC)
    pairs = [(f"S{k}", f"C{k % 7}", at(k), at(k + 150) if k % 3 else None) for k in range(40)]
    edges = spark.createDataFrame(pairs, "supplier_id string, customer_id string, effective_start timestamp, effective_end timestamp")
    held = {(d, f"C{k}"): float(i * 7 + k) for i, d in enumerate(days) for k in range(7) if (i + k) % 5}
    residuals = spark.createDataFrame([(d, s, v) for (d, s), v in held.items()], "date date, security_id string, residual_return double")
    found, most = most_rows(graph.diffusion_signals(edges, residuals), "shuffleRecordsWritten")
    plain = {}
    for s, c, low, high in pairs:
        for d in days:
            close = dt.datetime.combine(d, dt.time(7), dt.UTC)
            if low <= close and (high is None or close < high):
                plain.setdefault((d, s), []).append(held.get((d, c)))
    assert {(r.date, r.security_id): (r.customer_shock, r.customer_neighbor_count) for r in found if r.security_id[0] == "S"} == {k: (v[0], sum(x is not None for x in v)) for k, v in plain.items()}
    assert most < 2 * sum(map(len, plain.values())) / 5


def test_signals_of_customers_alone(spark):
    residuals = spark.createDataFrame([(dt.date(2020, 1, k), s, float(k)) for k in (2, 3) for s in "ABC"], "date date, security_id string, residual_return double")
    edges = spark.sql("SELECT * FROM VALUES ('A', 'B', TIMESTAMP '2020-01-01', CAST(NULL AS TIMESTAMP)), ('B', 'C', TIMESTAMP '2020-01-03', NULL) AS t(supplier_id, customer_id, effective_start, effective_end)")
    shown = lambda rows: sorted((r.date, r.security_id, r.customer_shock, r.customer_neighbor_count) for r in rows.filter("customer_shock IS NOT NULL").collect())
    assert shown(graph.diffusion_signals(edges, residuals, customers_only=True)) == shown(graph.diffusion_signals(edges, residuals)) != []


def test_trades_store_only_what_fills_and_signals_need(spark):
    held, _, given = market_queries.trading_tables(spark, "/root/testdata/sf0.001")
    assert len(held.columns) == 8 and given["weekly"] is given["clamped"] and len(given["clamped"].columns) == 8
