"""spark-submit entry: build edges and coverage from tables, compute signals, verify a raw manifest.

    python -m asofgraph.cli edges --mentions M --aliases A --out DIR
    python -m asofgraph.cli signals --edges E --residuals R --out DIR
    python -m asofgraph.cli verify-manifest --recorded TABLE --raw DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from asofgraph.operators import contracts, graph, resolve
from asofgraph.sources import assets, tables


def build_edges(spark: SparkSession, mentions: str, aliases: str, out: str) -> int:
    """Resolution audit, edges and the coverage row as Parquet below ``out``; broken inputs end with 4."""
    said, known = (tables.read_contract_table(spark, p, t) for p, t in ((mentions, "disclosure_raw"), (aliases, "company_alias")))
    for frame, name in ((said, "disclosure_raw"), (known, "company_alias")):
        broken = contracts.TABLES[name].check(frame).filter("violations > 0").collect()
        if broken:
            print(f"{name}: {[(r.rule, r.violations) for r in broken]}", file=sys.stderr)
            return 4
    audit = resolve.resolve(said, known)
    tables.write_parquet(audit, f"{out}/resolution_audit.parquet")
    audit = contracts.TABLES["resolution_audit"].enforce(spark.read.parquet(f"{out}/resolution_audit.parquet"))
    joined = said.join(audit.drop("normalized_name"), resolve.MENTION)
    oriented = graph.orient(joined).withColumn("relationship_confidence", F.col("resolution_confidence"))
    tables.write_parquet(graph.collapse(oriented), f"{out}/supply_chain_edge.parquet")
    edges = contracts.TABLES["supply_chain_edge"].enforce(spark.read.parquet(f"{out}/supply_chain_edge.parquet"))
    tables.write_csv_bundle({"coverage": graph.coverage_summary(joined, edges), "degrees": graph.degrees(edges)}, out, ("coverage",))
    return 0


def build_signals(spark: SparkSession, edges: str, residuals: str, out: str) -> int:
    tables.write_parquet(graph.diffusion_signals(spark.read.parquet(edges), spark.read.parquet(residuals)), out)
    return 0


def verify(spark: SparkSession, recorded: str, raw: str) -> int:
    wrong = assets.verify_manifest(tables.read_table(spark, recorded), assets.manifest(spark, raw)).limit(20).collect()
    for row in wrong:
        print(row.path, row.reason, file=sys.stderr)
    return 1 if wrong else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in (("edges", ("mentions", "aliases", "out")), ("signals", ("edges", "residuals", "out")), ("verify-manifest", ("recorded", "raw"))):
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
    args = vars(parser.parse_args(argv))
    run = {"edges": build_edges, "signals": build_signals, "verify-manifest": verify}[args.pop("command")]
    return run(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), **args)


if __name__ == "__main__":
    sys.exit(main())
