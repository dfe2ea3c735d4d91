"""Official-source metadata: filters, timing, masters, alias tables, replay."""

import datetime as dt

from pyspark.sql import functions as F

from asofgraph.operators import announcements as a
from asofgraph.operators import resolve


def millis(*when):
    return int(dt.datetime(*when, tzinfo=dt.timezone(dt.timedelta(hours=8))).timestamp() * 1000)


def test_announcements_and_timing(spark):
    raw = spark.createDataFrame([
        ("1", "600519", "o1", "<em>甲</em>2019年年度报告", millis(2020, 4, 1), "u"), ("1", "600519", "o1", "甲2019年年度报告", millis(2020, 4, 2, 18), "v"), ("2", "000001", "o2", "乙2019年年度报告摘要", millis(2020, 4, 1), "u"),
        ("3", "900001", "o3", "丙2019年年度报告", millis(2020, 4, 1), "u"), ("4", "300001", "o4", "丁2019年年度报告", millis(2020, 4, 1, 9, 30), "u"), ("4", "300002", "o4", "丁2019年年度报告", millis(2020, 4, 1, 9), "u")],
        "announcement_id string, sec_code string, org_id string, title string, announcement_time_ms long, url string")
    found = a.normalize_announcements(raw)
    newest, conflicts = a.dedupe_documents(found)
    assert {r.source_document_id: (r.url, r.source_period_end) for r in newest.collect()} == {"1": ("v", dt.date(2019, 12, 31)), "4": ("u", dt.date(2019, 12, 31))}
    assert [r.source_document_id for r in conflicts.collect()] == ["4"]
    assert found.filter("url = 'u' AND source_document_id = '1'").first().publication_datetime == dt.datetime(2020, 4, 1, 16)
    assert tuple(a.timing_audit(found).first()) == (4, 1, 3, 1, 1, 0)


def test_master_aliases_and_enrichment(spark):
    raw = spark.createDataFrame([("600519.0", " 甲 股份", "20010827", None), ("1", "-", "1991/4/3", "2020-01-02"), ("900001", "x", "2000-01-01", None)], "code string, name string, listed string, gone string")
    master = a.normalize_master(raw, {"ticker": "code", "company_name": "name", "listing_date": "listed", "delisting_date": "gone"}, "SSE")
    assert {(r.security_id, r.company_name, r.board) for r in master.collect()} == {("600519", "甲股份", "MAIN"), ("000001", None, "MAIN")}
    changes = spark.createDataFrame([("600519", dt.date(2010, 1, 1), "旧", "甲股份")], "security_id string, change_date date, old_name string, new_name string")
    aliases = a.company_aliases(master, changes, "2024-01-01")
    assert {(r.alias, r.alias_type, r.valid_from) for r in aliases.collect()} == {
        ("600519", "ticker", dt.date(2001, 8, 27)), ("000001", "ticker", dt.date(1991, 4, 3)), ("旧", "historical_name", dt.date(2001, 8, 27)), ("甲股份", "historical_name", dt.date(2010, 1, 1))}
    seen = spark.createDataFrame([("600519", "甲甲", dt.datetime(2015, 5, 5, 20)), ("600519", "甲甲", dt.datetime(2016, 5, 5)), ("600519", "旧", dt.datetime(2016, 5, 5)), ("600519", " ", dt.datetime(2016, 5, 5))], "security_id string, short_name string, publication_datetime timestamp")
    both, clashes = a.enrich_aliases(aliases, seen)
    assert both.count() == 5 and both.filter("alias = '甲甲'").first().valid_from == dt.date(2015, 5, 6) and clashes.count() == 0
    pairs, shared = a.unambiguous_map(spark.createDataFrame([("o1", "1"), ("o2", "000001"), ("o3", "600519")], "org_id string, code string"))
    assert pairs.count() == 3 and [r.security_id for r in shared.collect()] == ["000001"]


def test_replay_and_boundary(spark):
    aliases = spark.createDataFrame([("e1", "alpha"), ("e2", "beta")], "entity_id string, alias string").withColumns({"valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date"), "normalized_name": F.col("alias")})
    mentions = spark.createDataFrame([("d", "c", n, dt.datetime(2020, 1, 1)) for n in ("alpha", "beta", "客户A")], "source_document_id string, source_company_id string, counterparty_raw_name string, publication_datetime timestamp")
    audit = resolve.resolve(mentions, aliases, fuzzy=False)
    assert a.replay_exact(audit, mentions, aliases).count() == 0 and a.name_boundary(audit).agg(F.sum("actual")).first()[0] == 0
    wrong = audit.withColumn("resolved_entity_id", F.when(F.col("counterparty_raw_name") == "beta", "e1").otherwise(F.col("resolved_entity_id")))
    assert [r.counterparty_raw_name for r in a.replay_exact(wrong, mentions, aliases).collect()] == ["beta"]
