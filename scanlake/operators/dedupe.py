"""De-duplication of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.assets import assets_array
from scanlake.functions.severity import status_family, status_text
from scanlake.functions.text import is_placeholder, key_text, not_blank, or_empty, squeeze, strip
from scanlake.operators.ordinal import first_k

VULN_KEYS = ["report_id", "vuln_key", "status_family"]
NAME_KEYS = ["report_id", "name_key", "anon"]
FIRST_FILLED = [
    "description", "business_impact", "proof_of_concept", "recommendation", "remediation",
    "control_objective", "control_name", "audit_requirement", "cve", "cvss", "reference",
]


def vuln_key(findings: DataFrame) -> DataFrame:
    """Add the numeric vulnerability id (first digits) and the status family."""
    return findings.withColumn(
        "vuln_key",
        F.regexp_extract(or_empty(F.col("vuln_id")), r"(\d+)", 1).try_cast("decimal(38,0)"),
    ).withColumn(
        "_status",
        status_text(F.col("observation"), F.col("remediation_status"), F.col("risk_status")),
    ).withColumn("status_family", status_family(F.col("_status"))).drop("_status")


def dedupe_by_vuln_id(findings: DataFrame, fields: list[str]) -> DataFrame:
    """Most complete row per (vulnerability id, status family); first row on ties.

    Completeness = number of filled `fields`, then description length.  Rows
    without a vulnerability id are left to `dedupe_by_fingerprint`.  The assets of
    all duplicates are in `merged_assets`.
    """
    keyed = vuln_key(findings).filter(F.col("vuln_key").isNotNull())
    filled = F.lit(0)
    for f in fields:
        filled = filled + F.when(is_placeholder(F.col(f)), F.lit(0)).otherwise(F.lit(1))
    scored = keyed.withColumn("_filled", filled)
    best = first_k(
        scored, VULN_KEYS,
        [F.col("_filled").desc(), F.length(or_empty(F.col("description"))).desc(), F.col("pos")],
        1,
    )
    return best.drop("_filled", "_rank")


def merged_assets(findings: DataFrame) -> DataFrame:
    """(vulnerability key, asset, first position): union of the duplicates' assets."""
    return (
        vuln_key(findings).filter(F.col("vuln_key").isNotNull())
        .select(*VULN_KEYS, "pos", F.explode(assets_array(F.col("affected_assets"))).alias("asset"))
        .groupBy(*VULN_KEYS, "asset")
        .agg(F.min("pos").alias("first_pos"))
    )


def dedupe_by_fingerprint(findings: DataFrame) -> DataFrame:
    """Rows without a vulnerability id: first per (name, assets, description).

    The whole description enters; the digest keeps the shuffle key short.
    """
    loose = vuln_key(findings).filter(F.col("vuln_key").isNull())
    parts = [
        key_text(F.col("name")),
        key_text(F.array_join(assets_array(F.col("affected_assets")), ", ")),
        key_text(or_empty(F.col("description"))),
    ]
    keyed = loose.withColumn("_fp", F.sha2(F.concat_ws("\x1f", *parts), 256))
    return first_k(keyed, ["report_id", "_fp"], [F.col("pos")], 1).drop("_fp", "_rank")


def dedupe_findings(findings: DataFrame, fields: list[str]) -> DataFrame:
    """Both rules together; `pos` keeps the input order."""
    return dedupe_by_vuln_id(findings, fields).unionByName(dedupe_by_fingerprint(findings))


def name_key(findings: DataFrame) -> DataFrame:
    """Key (name, severity); a nameless row is a key of its own."""
    name = squeeze(F.lower(F.col("name")))
    key = F.concat_ws("|", name, F.lower(strip(or_empty(F.col("severity")))))
    return findings.withColumn("name_key", F.when(name != "", key).otherwise(F.lit(""))).withColumn(
        "anon", F.when(name != "", F.lit(-1).cast("long")).otherwise(F.col("pos"))
    )


def dedupe_by_name(findings: DataFrame) -> DataFrame:
    """One row per (name, severity): the first row, with its empty fields filled
    from the first duplicate that has them."""
    keyed = name_key(findings)
    fields = [f for f in FIRST_FILLED if f in findings.columns]
    kept = [
        c for c in findings.columns
        if c not in fields and c not in ("report_id", "affected_assets", "pos")
    ]
    filled = [
        F.min_by(
            F.col(f), F.struct(not_blank(or_empty(F.col(f))).isNull().alias("gap"), F.col("pos"))
        ).alias(f)
        for f in fields
    ]
    return (
        keyed.groupBy(*NAME_KEYS)
        .agg(
            # one by one, so that columns nobody reads are not sorted along
            *[F.min_by(F.col(c), F.col("pos")).alias(c) for c in kept],
            *filled,
            F.min("pos").alias("pos"),
            F.count("*").alias("merged_rows"),
        )
        .select(*NAME_KEYS, *kept, *fields, "pos", "merged_rows")
    )


def named_assets(findings: DataFrame) -> DataFrame:
    """(name key, asset): case-insensitive union of the merged rows' assets, with the
    spelling and place of the first mention."""
    parts = F.transform(F.split(or_empty(F.col("affected_assets")), "[,\n;]+"), strip)
    return (
        name_key(findings)
        .select(*NAME_KEYS, "pos", F.posexplode(parts).alias("i", "asset"))
        .filter(F.col("asset") != "")
        .groupBy(*NAME_KEYS, F.lower("asset").alias("asset_key"))
        .agg(
            F.min_by("asset", F.struct("pos", "i")).alias("asset"),
            F.min(F.struct("pos", "i")).alias("_at"),
        )
        .select(*NAME_KEYS, "asset", F.col("_at.pos").alias("first_pos"))
    )
