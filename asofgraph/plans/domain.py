"""Domain tables derived from the test tables, in SQL that Spark and DuckDB read alike.

Each entry is a common table expression. ``{name}`` stands for a base table, other names for earlier
entries. Identifiers are numbers here; the operators take strings as well.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

CTES: dict[str, str] = {
    "weekly": """
        SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS security_id,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price,
          CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE)
            / CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS even_price,
          CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
          min(l_linenumber) AS first_line
        FROM {lineitem} GROUP BY 1, 2""",
    "calendar": "SELECT DISTINCT date FROM weekly",
    "security_master": """
        SELECT s_suppkey AS security_id,
          CAST(date_add(min(date), CAST(s_suppkey % 7 AS INT) * 7) AS DATE) AS listing_date,
          CASE WHEN s_suppkey % 11 = 0 THEN DATE '2000-01-03' END AS delisting_date,
          CASE s_suppkey % 3 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'STAR' ELSE 'CHINEXT' END AS board,
          CASE s_suppkey % 2 WHEN 0 THEN 'SSE' ELSE 'SZSE' END AS exchange,
          s_name AS company_name, s_nationkey AS industry_code
        FROM {supplier} JOIN weekly ON s_suppkey = security_id GROUP BY s_suppkey, s_name, s_nationkey""",
    "raw_close": "SELECT date, security_id, floor(price * 100 + 0.5) / 100 AS raw, floor(coalesce(even_price, price) * 100 + 0.5) / 100 AS raw_open, volume, amount, first_line FROM weekly",
    "with_reference": "SELECT *, lag(raw) OVER (PARTITION BY security_id ORDER BY date) AS reference_price FROM raw_close",
    "banded": """
        SELECT *, floor(reference_price * 1.1 * 100 + 0.5 + 1e-12) / 100 AS upper_band, floor(reference_price * 0.9 * 100 + 0.5 + 1e-12) / 100 AS lower_band
        FROM with_reference""",
    "clamped": """
        SELECT *, CASE WHEN reference_price IS NULL THEN raw WHEN raw > upper_band THEN upper_band WHEN raw < lower_band THEN lower_band ELSE raw END AS close,
          CASE WHEN reference_price IS NULL THEN raw_open WHEN raw_open > upper_band THEN upper_band WHEN raw_open < lower_band THEN lower_band ELSE raw_open END AS open
        FROM banded""",
    "quotes": """
        SELECT date, security_id, open, CASE WHEN open > close THEN open ELSE close END AS high, CASE WHEN open < close THEN open ELSE close END AS low, close, volume, amount,
          (security_id + first_line) % 13 = 0 AS is_suspended, security_id % 10 = 3 AS is_st
        FROM clamped""",
    "actions": """
        SELECT date, security_id, CAST(1.0 AS DOUBLE) AS share_multiplier, CAST(0.0 AS DOUBLE) AS cash_dividend, CAST(reference_price AS DOUBLE) AS reference_price FROM clamped
        WHERE reference_price IS NOT NULL""",
    "limit_rules": """
        SELECT board, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to, CAST(ordinary_pct AS DOUBLE) AS ordinary_pct, CAST(st_pct AS DOUBLE) AS st_pct, ipo_days FROM (VALUES
        ('MAIN', '1990-01-01', '1998-06-30', 0.1, 0.05, 1), ('MAIN', '1998-07-01', '2099-12-31', 0.1, 0.1, 1),
        ('STAR', '1990-01-01', '2099-12-31', 0.1, NULL, 5), ('CHINEXT', '1990-01-01', '2099-12-31', 0.1, NULL, 3)) AS r(board, valid_from, valid_to, ordinary_pct, st_pct, ipo_days)""",
    "evidence": """
        SELECT l_suppkey AS supplier_id, o_custkey % suppliers AS customer_id, l_orderkey AS source_document_id,
          CAST(o_orderdate AS TIMESTAMP) AS publication_datetime, CAST(o_orderdate AS TIMESTAMP) AS effective_start,
          CAST(o_orderdate AS TIMESTAMP) + INTERVAL '550' DAY AS effective_end,
          floor((1 - l_discount) * 100 + 0.5) / 100 AS relationship_confidence, l_extendedprice AS economic_weight, l_linenumber AS line
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey CROSS JOIN (SELECT count(*) AS suppliers FROM {supplier}) AS s WHERE l_quantity >= 48""",
    "edges": """
        SELECT supplier_id, customer_id, source_document_id, min(publication_datetime) AS publication_datetime, min(effective_start) AS effective_start,
          min(effective_end) AS effective_end, max(relationship_confidence) AS relationship_confidence, CAST(1.0 AS DOUBLE) AS economic_weight, 'equal' AS weight_source
        FROM evidence WHERE supplier_id <> customer_id GROUP BY supplier_id, customer_id, source_document_id""",
    "returns": """
        SELECT date, security_id, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY date), 0) - 1 AS raw_return, is_suspended FROM quotes""",
    "mentions": """
        SELECT l_orderkey AS source_document_id, l_suppkey AS source_company_id, p_name || CASE WHEN l_linenumber % 4 = 0 THEN ' Co., Ltd.' WHEN l_linenumber % 7 = 1 THEN ' **' ELSE '' END AS counterparty_raw_name,
          CASE WHEN l_linenumber % 2 = 0 THEN 'customer' ELSE 'supplier' END AS relationship_type, CAST(o_orderdate AS TIMESTAMP) AS publication_datetime,
          'Disclosed: ' || p_name || ' at ' || p_brand AS evidence_text, CAST(l_discount AS DOUBLE) AS exposure_share
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "aliases": """
        SELECT p_partkey % suppliers AS entity_id, p_name AS alias,
          CAST(date_add(DATE '1990-01-01', CAST(p_partkey % 40 AS INT) * 100) AS DATE) AS valid_from,
          CASE WHEN p_partkey % 3 = 0 THEN CAST(date_add(DATE '1990-01-01', CAST(p_partkey % 40 AS INT) * 100 + 1500) AS DATE) END AS valid_to
        FROM {part} CROSS JOIN (SELECT count(*) AS suppliers FROM {supplier}) AS s""",
}

_NEEDS = {
    "weekly": (), "calendar": ("weekly",), "security_master": ("weekly",), "raw_close": ("weekly",), "with_reference": ("raw_close",), "banded": ("with_reference",),
    "clamped": ("banded",), "quotes": ("clamped",), "actions": ("clamped",), "limit_rules": (), "evidence": (), "edges": ("evidence",), "returns": ("quotes",),
    "mentions": (), "aliases": (),
}


def _closure(names: Iterable[str], given: Iterable[str] = ()) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        for below in () if name in given else _NEEDS[name]:
            visit(below)
        if name not in found:
            found.append(name)
    for name in names:
        visit(name)
    return found


def with_clause(names: Iterable[str], tables: dict[str, str] | None = None, duck: bool = True, given: dict[str, DataFrame] | None = None) -> str:
    """``name AS (...), ...`` for the named entries and all they need; ``given`` ones are read where they are stored."""
    tables = tables or {b: b for b in BASE}
    given = given or {}
    text = ",\n".join(f"{n} AS ({f'SELECT * FROM parquet.`{given[n].stored_at}`' if n in given else CTES[n].format(**tables)})" for n in _closure(names, given))
    return text.replace("date_add(", "_add_days(") if duck else text


def frame(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A domain table over the Parquet files of ``sf_dir``; entries that are stored already may be given."""
    tables = {b: f"parquet.`{sf_dir}/{b}.parquet`" for b in BASE}
    return spark.sql(f"WITH {with_clause([name], tables, duck=False, given=given)} SELECT * FROM {name}")


def oracle(names: Iterable[str], body: str) -> str:
    """SQL for DuckDB: the named entries, then ``body`` (more entries and a SELECT)."""
    head = with_clause(names)
    # dates plus whole days, which the two engines write differently
    import re
    head = re.sub(r"_add_days\(((?:[^(),]|\([^()]*\))+), ((?:[^()]|\([^()]*\))+)\)", r"(\1 + \2)", head)
    return f"WITH RECURSIVE {head}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"
