"""Table contracts: columns, keys and domain rules, checked in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """``types`` are the required columns in order, ``rules`` SQL conditions that no row may meet."""

    name: str
    key: tuple[str, ...]
    types: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)
    nullable: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)

    def cast(self, raw: DataFrame) -> DataFrame:
        """Strings to the contract's types; what doesn't convert is null."""
        kinds = self.types | {n: t for n, t in self.optional.items() if n in raw.columns}
        return raw.select(*(F.expr(f"try_cast(nullif(trim(`{n}`), '') AS {t})").alias(n) for n, t in kinds.items() if n in raw.columns))

    def lost_in_cast(self, raw: DataFrame) -> DataFrame:
        """(column, lost): non-blank cells that the cast makes null."""
        kinds = {n: t for n, t in (self.types | self.optional).items() if n in raw.columns}
        counts = raw.agg(*(F.count_if(F.expr(f"nullif(trim(`{n}`), '') IS NOT NULL AND try_cast(trim(`{n}`) AS {t}) IS NULL")).alias(n) for n, t in kinds.items()))
        return counts.unpivot([], list(kinds), "column", "lost")

    def conditions(self, df: DataFrame) -> dict[str, Column]:
        found: dict[str, Column] = {}
        for name in self.types:
            if name not in df.columns:
                found[f"missing_column:{name}"] = F.lit(True)
            elif name not in self.nullable:
                found[f"null:{name}"] = F.col(name).isNull()
        for name, kind in (self.types | self.optional).items():
            if name in df.columns and kind == "string":
                found[f"blank:{name}"] = F.trim(F.col(name).cast("string")) == ""
            if name in df.columns and kind == "double":
                found[f"not_finite:{name}"] = F.isnan(name) | (F.abs(name) == float("inf"))
        for name, rule in self.rules.items():
            found[f"rule:{name}"] = F.expr(rule)
        return found

    def check(self, df: DataFrame) -> DataFrame:
        """(rule, violations), a row a rule: all row rules in one pass, the key by a second aggregate."""
        conditions = self.conditions(df)
        rows = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items())).unpivot([], list(conditions), "rule", "violations")
        if any(k not in df.columns for k in self.key):
            return rows
        repeated = df.groupBy(*self.key).count().filter("count > 1").agg(F.lit("repeated_key").alias("rule"), F.count("*").alias("violations"))
        return rows.union(repeated)

    def enforce(self, df: DataFrame, allow_extra: bool = True) -> DataFrame:
        """The frame itself, or an error that names the broken rules. Runs the check."""
        extra = set(df.columns) - set(self.types) - set(self.optional)
        broken = [(r.rule, r.violations) for r in self.check(df).filter("violations > 0").collect()] + [("extra_column", n) for n in sorted(extra) if not allow_extra]
        if broken:
            raise ValueError(f"{self.name}: {broken}")
        return df


def _t(text: str) -> dict[str, str]:
    return dict(x.split(":") for x in text.split())


TABLES = {c.name: c for c in (
    Contract("security_master", ("security_id",), _t("security_id:string ticker:string exchange:string company_name:string listing_date:date delisting_date:date board:string"),
             _t("industry_code:string industry_name:string industry_valid_from:date industry_valid_to:date"), ("delisting_date",),
             {"exchange": "exchange NOT IN ('SSE', 'SZSE')", "listing_order": "listing_date >= delisting_date"}),
    Contract("company_alias", ("entity_id", "alias", "valid_from"), _t("entity_id:string canonical_name:string alias:string alias_type:string valid_from:date valid_to:date source:string"), {}, ("valid_from", "valid_to"),
             {"validity_order": "valid_from >= valid_to"}),
    Contract("disclosure_raw", ("source_document_id", "source_company_id", "relationship_type", "counterparty_raw_name"),
             _t("source_company_id:string counterparty_raw_name:string relationship_type:string source_period_end:date publication_datetime:timestamp source_document_id:string source_document_url_or_path:string evidence_text:string exposure_value:double exposure_share:double"),
             {}, ("exposure_value", "exposure_share"), {"relationship": "relationship_type NOT IN ('customer', 'supplier')", "share": "exposure_share NOT BETWEEN 0 AND 1", "value": "exposure_value < 0", "period": "source_period_end > CAST(publication_datetime AS DATE)"}),
    Contract("resolution_audit", ("source_document_id", "source_company_id", "counterparty_raw_name"),
             _t("source_document_id:string source_company_id:string counterparty_raw_name:string resolved_entity_id:string resolution_method:string resolution_confidence:double resolution_status:string candidate_count:long notes:string"),
             _t("normalized_name:string"), ("resolved_entity_id",), {"confidence": "resolution_confidence NOT BETWEEN 0 AND 1", "count": "candidate_count < 0"}),
    Contract("supply_chain_edge", ("supplier_id", "customer_id", "source_document_id"),
             _t("supplier_id:string customer_id:string effective_start:timestamp effective_end:timestamp source_document_id:string source_period_end:date source_company_id:string relationship_confidence:double economic_weight:double weight_source:string publication_datetime:timestamp"),
             {}, ("economic_weight", "weight_source"), {"confidence": "relationship_confidence NOT BETWEEN 0 AND 1", "weight": "economic_weight < 0", "interval": "effective_start >= effective_end", "look_ahead": "publication_datetime > effective_start"}),
    Contract("equity_daily", ("date", "security_id"), _t("date:date security_id:string open:double close:double volume:double amount:double tradable:boolean"),
             _t("high:double low:double market_cap:double free_float_market_cap:double suspended:boolean limit_up:boolean limit_down:boolean st_status:boolean"), ("open", "close", "volume", "amount"), {"volume": "volume < 0", "amount": "amount < 0"}),
    Contract("returns_daily", ("date", "security_id"), _t("date:date security_id:string raw_return:double market_return:double industry_return:double residual_return:double beta_market:double beta_industry:double residual_model:string"), {},
             ("raw_return", "market_return", "industry_return", "residual_return", "beta_market", "beta_industry"), {"model": "(industry_return IS NULL OR beta_industry IS NULL) AND residual_model <> 'market_only'"}),
    Contract("signal_daily", ("date", "security_id"), _t("date:date security_id:string customer_shock:double supplier_shock:double customer_neighbor_count:long supplier_neighbor_count:long graph_snapshot_date:date"),
             _t("edge_age_mean:double edge_age_max:double"), ("customer_shock", "supplier_shock"), {"counts": "customer_neighbor_count < 0 OR supplier_neighbor_count < 0", "look_ahead": "graph_snapshot_date > date"}),
)}
