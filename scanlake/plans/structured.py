"""Scan rows -> report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.text import key_text, or_empty
from scanlake.operators import dedupe as dd
from scanlake.operators import falsepos as fp
from scanlake.operators import grouping as g
from scanlake.operators import presentation as p
from scanlake.operators import rollup as r
from scanlake.operators.ordinal import first_k, number_by_order
from scanlake.plans.enrichment import Catalogs, enrich
from scanlake.plans.finish import ID_KEYS, finish_report
from scanlake.plans.lookup import apply_lookup, lookup_requests, lookup_results
from scanlake.session import stable, staged

COMPLETENESS = [
    "name", "severity", "vuln_id", "cve", "cvss", "description", "remediation", "reference",
    "category", "business_impact", "control_objective", "control_name", "audit_requirement",
]


def renumber(findings: DataFrame) -> DataFrame:
    """Findings that need no look-up first, then by first appearance; new ids in that order."""
    placed = number_by_order(
        findings, ["report_id"], [F.col("needs_lookup"), F.col("first_row")], "pos"
    )
    n = F.col("pos").cast("string")
    return placed.withColumn("old_id", F.col("id")).withColumn(
        "id", F.concat(F.lit("VAPT-"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))
    )


def asset_digest(assets: DataFrame, keys: list[str]) -> DataFrame:
    """An order-free digest of each finding's asset set, from sums over the asset table."""
    h = F.xxhash64("asset")
    return assets.groupBy(*keys).agg(
        F.concat_ws(
            ":", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"),
            F.bit_xor(F.xxhash64(F.concat(F.lit("#"), F.col("asset")))).cast("string"),
        ).alias("asset_digest")
    )


def dedupe(findings: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept findings, asset table under the kept ids).

    Same vulnerability id and status: the most complete one stays.  Without an id:
    the first of equal name, assets and description start stays.
    """
    keyed = dd.vuln_key(findings).join(asset_digest(assets, ID_KEYS), ID_KEYS, "left")
    parts = F.concat_ws(
        "\x1f", key_text(F.col("name")), or_empty(F.col("asset_digest")),
        key_text(or_empty(F.col("description"))),
    )
    filled = F.lit(0)
    for c in COMPLETENESS:
        filled = filled + F.when(F.col(c).isNull(), 0).otherwise(1)
    keyed = keyed.withColumns({
        "_key": F.when(
            F.col("vuln_key").isNotNull(), F.concat(F.lit("v"), F.col("vuln_key").cast("string"))
        ).otherwise(F.concat(F.lit("f"), F.sha2(parts, 256))),
        "_family": F.when(F.col("vuln_key").isNotNull(), F.col("status_family")).otherwise(F.lit("")),
        "_filled": F.when(F.col("vuln_key").isNotNull(), filled).otherwise(F.lit(0)),
        "_len": F.when(
            F.col("vuln_key").isNotNull(), F.length(or_empty(F.col("description")))
        ).otherwise(F.lit(0)),
    })
    group = ["report_id", "_key", "_family"]
    kept = staged(first_k(
        keyed, group, [F.col("_filled").desc(), F.col("_len").desc(), F.col("pos")], 1), "kept")
    owner = kept.select(*group, F.col("id").alias("kept_id"))
    moved = (
        keyed.select(*group, "id").join(owner, group).select("report_id", "id", "kept_id")
        .join(assets, ID_KEYS)
        .select("report_id", F.col("kept_id").alias("id"), "asset").distinct()
    )
    return kept.drop("_key", "_family", "_filled", "_len", "_rank", "asset_digest"), moved


def structured_report(
    scan: DataFrame, catalogs: Catalogs | None = None, min_pass: float = 0.55,
    replies: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The whole chain from scan rows to report tables.

    Tables are staged where a later step reads a result more than once, so the scan is
    grouped once, later steps read only the columns they need, and lost executors do not
    restart the chain.  `catalogs` may carry a store of recommendations.

    The look-up is a loop over two runs: `payloads` holds a redacted request for every
    finding that needs one; the answers come back as `replies` (reply_no, raw) and are
    merged into the findings, never over a scan's own fields or better values.
    """
    found, assets = g.findings_from_scan(scan)
    found = staged(found, "found")
    details: dict[str, DataFrame] = {}
    enriched = found
    if catalogs is not None:
        enriched, details = enrich(found, catalogs)
        enriched = staged(enriched, "enriched")
    filled = p.fill_missing(p.with_category(enriched, p.subnet_summary(assets)))
    numbered = renumber(filled.drop("subnet_count", "first_subnet", "web_asset"))
    by_id = assets.join(
        numbered.select(*g.KEYS, "id"), g.KEYS
    ).select("report_id", "id", "asset")
    kept, kept_assets = dedupe(numbered.drop("asset_count", "affected_assets_short"), by_id)
    kept = kept.withColumn("item_key", F.concat_ws("-", *ID_KEYS))
    asked = lookup_requests(kept)
    if replies is not None:
        answers = lookup_results(replies, asked)
        kept = apply_lookup(kept, answers["results"])
        details = {**details, "unread_replies": answers["unread"]}
    flagged = staged(fp.flag_false_positives(p.validate_findings(kept.drop("item_key"))), "flagged")
    report = finish_report(flagged, kept_assets, min_pass)
    return {**report, **details, "payloads": asked.select(*ID_KEYS, "item_key", "payload")}


def write_report_tables(report: dict[str, DataFrame], path: str) -> None:
    """Summary table, finding cards and counts as parquet, sorted within a report."""
    numbered = stable(r.number_report(report["findings"]))
    tables = {
        "summary": p.summary_table(numbered),
        "cards": p.finding_cards(numbered),
        "counts": r.severity_counts(numbered, ["report_id"]),
    }
    for name, df in tables.items():
        by = ["report_id", "seq"] if "seq" in df.columns else ["report_id"]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("errorifexists").parquet(
            f"{path}/{name}")
