"""Report-facing fields of findings: category, taxonomy, subnet, titles, control text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions import assets as A
from scanlake.functions import derive as D
from scanlake.functions.severity import severity_canonical, severity_rank, severity_resolved
from scanlake.functions.text import (
    has_text, key_text, not_blank, or_empty, report_text, squeeze, strip, strip_plugin_id,
)
from scanlake.functions.titles import family_and_title
from scanlake.operators.grouping import KEYS
from scanlake.session import once
from scanlake.tables import fixed


def asset_subnets(assets: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(finding key, subnet), distinct, from the asset table."""
    return assets.select(
        *keys, F.explode(A.subnets_of(F.array(F.col("asset")))).alias("subnet")
    ).distinct()


def subnet_summary(assets: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per finding: number of /24 subnets, the only one, and whether an asset is a web name."""
    nets = asset_subnets(assets, keys).groupBy(*keys).agg(
        F.count("*").alias("subnet_count"), F.min("subnet").alias("first_subnet")
    )
    web = assets.groupBy(*keys).agg(
        F.max(F.col("asset").rlike(A.WEB_HINT)).alias("web_asset")
    )
    return web.join(nets, keys, "left").withColumn(
        "subnet_count", F.coalesce(F.col("subnet_count"), F.lit(0))
    )


def with_category(findings: DataFrame, summary: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Fill a missing category from subnets, web hints and keywords."""
    joined = findings.join(summary, keys, "left").withColumns({
        "subnet_count": F.coalesce(F.col("subnet_count"), F.lit(0)),
        "web_asset": F.coalesce(F.col("web_asset"), F.lit(False)),
    })
    derived = A.derive_category(
        F.col("subnet_count"), F.col("first_subnet"),
        F.when(F.col("web_asset"), F.lit("https://")).otherwise(F.lit("")),
        F.col("name"), F.col("description"),
    )
    if "category" in findings.columns:
        derived = F.when(has_text(F.col("category")), F.col("category")).otherwise(derived)
    return joined.withColumn("category", derived)


def with_taxonomy(findings: DataFrame) -> DataFrame:
    """Add taxonomy and subnet fields to findings that carry category and subnet counts."""
    cidrs = A.found(F.col("category"), A.CIDR)
    known = F.array_distinct(
        F.concat(
            cidrs,
            F.when(F.col("subnet_count") >= 1, F.array("first_subnet"))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    staged = findings.withColumn("_nets", known).withColumn(
        "taxonomy_family", A.taxonomy_family(F.col("category"))
    )
    return (
        staged.withColumn(
            "subnet_key",
            A.subnet_key_from_count(
                F.size("_nets") + F.when(F.col("subnet_count") > 1, 1).otherwise(0),
                F.get("_nets", F.lit(0)),
            ),
        )
        .withColumn("subnet_label", A.subnet_label_from_key(F.col("subnet_key")))
        .withColumn(
            "taxonomy_label", A.taxonomy_label(F.col("category"), F.col("taxonomy_family"))
        )
        .drop("_nets")
    )


def with_display_title(findings: DataFrame) -> DataFrame:
    """display_title: the name without its plugin id, mapped to the preferred title."""
    bare = strip_plugin_id(F.coalesce(not_blank(strip(F.col("name"))), F.lit(fixed.INSUFFICIENT)))
    output = F.col("proof_of_concept") if "proof_of_concept" in findings.columns else F.lit("")
    staged = findings.withColumn("_bare", bare).withColumn("_lower", key_text(F.col("_bare")))
    return (
        once(staged, {"_t": family_and_title(F.col("_lower"), F.col("_bare"), output)})
        .withColumn("display_title", strip(F.col("_t.title")))
        .drop("_bare", "_lower", "_t")
    )


def with_control_display(findings: DataFrame) -> DataFrame:
    """Control name and objective with their stock wording where nothing is known."""
    def shown(c: str, default: str):
        return F.when(has_text(F.col(c)), strip(F.col(c))).otherwise(F.lit(default))

    return findings.withColumns({
        "display_control_name": shown("control_name", fixed.DEFAULT_CONTROL_NAME),
        "display_control_objective": shown("control_objective", fixed.DEFAULT_CONTROL_OBJECTIVE),
    })


CONTROL_FIELDS = ["control_objective", "control_name", "audit_requirement"]


def fill_missing(findings: DataFrame) -> DataFrame:
    """Business impact and description where the scan has none, and the enrichment flag."""
    have = set(findings.columns)
    base = findings.withColumns({
        c: F.lit(None).cast("string")
        for c in ["business_impact", *CONTROL_FIELDS] if c not in have
    })
    derived = base.withColumns({
        "business_impact": F.when(
            has_text(F.col("business_impact")), F.col("business_impact")
        ).otherwise(D.business_impact(F.col("severity"), F.col("name"))),
        "description": D.derive_description(F.col("description"), F.col("proof_of_concept")),
    })
    return derived.withColumn(
        "needs_lookup",
        D.needs_enrichment(
            F.col("description"), F.col("remediation"), F.col("control_objective"),
            F.col("control_name"), F.col("audit_requirement"), F.col("reference"),
        ),
    )


def validate_findings(findings: DataFrame) -> DataFrame:
    """Resolve severity, add its rank, prepare the audit requirement, blank the evidence."""
    sev = severity_resolved(
        F.col("severity"), F.col("cvss"), F.col("name"), F.col("description")
    )
    return (
        findings.withColumn("severity", sev)
        .withColumn("severity_rank", severity_rank(F.col("severity")))
        .withColumn(
            "audit_requirement",
            D.audit_requirement(
                F.col("audit_requirement"), F.col("name"), F.col("description"),
                F.col("control_name"), F.col("remediation"),
            ),
        )
        .withColumn("proof_of_concept", F.lit(None).cast("string"))
    )


def normalise_findings(findings: DataFrame) -> DataFrame:
    """Squeeze names, canonicalise severity and collect every asset mention of a row.

    Works on rows whose own assets are a bounded comma list (`affected_assets`).
    """
    mentions = F.concat(
        A.assets_array(F.col("affected_assets")),
        *[
            A.asset_candidates(F.col(c))
            for c in ("description", "proof_of_concept", "observation")
            if c in findings.columns
        ],
    )
    return findings.withColumns({
        "name": squeeze(F.col("name")),
        "severity": severity_canonical(F.col("severity")),
        "affected_assets_raw": A.clean_assets(mentions),
    })


def missing_required(findings: DataFrame) -> DataFrame:
    """Findings that lack required source fields, with the list of the missing ones."""
    gaps = F.filter(
        F.array(*[
            F.when(~has_text(F.col(c)), F.lit(c)) for c in fixed.REQUIRED_SOURCE_FIELDS
        ]),
        lambda x: x.isNotNull(),
    )
    return findings.withColumn("missing_fields", gaps).filter(F.size("missing_fields") > 0)


REPORT_DEFAULTS = {
    "id": None, "name": None, "severity": None, "cvss": None, "cve": None, "category": None,
    "description": None, "business_impact": None, "proof_of_concept": None, "remediation": None,
    "control_objective": None, "control_name": None, "audit_requirement": None,
    "reference": None, "observation": None, "remediation_status": None,
}


def blank_finding(spark, index: int) -> DataFrame:
    """One default row for a finding that is entered by hand."""
    stated = {
        "id": f"{index:03d}", "name": "[New Finding]", "severity": "Medium",
        "cve": fixed.INSUFFICIENT, "remediation_status": "Open", "risk_status": "Open",
        "observation": "New", "reference": "OWASP Top 10",
    }
    row = {**{c: fixed.PLACEHOLDER for c in REPORT_DEFAULTS}, **stated}
    return spark.createDataFrame([tuple(row.values())], [*row])


def fill_required(findings: DataFrame) -> DataFrame:
    """Write the sentinel into every required field that is absent or blank (sink side)."""
    have = set(findings.columns)
    return findings.withColumns({
        c: F.coalesce(not_blank(F.col(c)) if c in have else F.lit(None).cast("string"),
                      F.lit(fixed.PLACEHOLDER))
        for c in REPORT_DEFAULTS
    })


def missing_field_report(findings: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Per key and field: how many findings have nothing in it."""
    sums = [F.count_if(~has_text(F.col(f))).alias(f) for f in fields]
    wide = findings.groupBy(*keys).agg(*sums)
    return wide.unpivot(keys, fields, "field", "missing")


def summary_table(findings: DataFrame) -> DataFrame:
    """The seven columns of the report's summary table, numbered by `seq`."""
    from scanlake.functions.severity import status_display

    label = D.group_label(
        F.lit(None).cast("string"), F.col("taxonomy_label"), F.col("subnet_label"),
        F.col("category"),
    )
    return findings.select(
        "report_id",
        "seq",
        label.alias("group_label"),
        "severity",
        F.when(has_text(F.col("display_title")), F.col("display_title"))
        .otherwise(F.col("name")).alias("title"),
        status_display(F.col("remediation_status")).alias("status"),
        F.coalesce(not_blank(F.col("observation")), F.lit("New")).alias("observation"),
        F.coalesce(F.col("affected_assets_short"), F.lit(fixed.INSUFFICIENT)).alias("assets"),
    )


def finding_cards(findings: DataFrame) -> DataFrame:
    """The twelve fields of a finding card."""
    from scanlake.functions.ids import blob, cve_cwe_display, reference_plain
    from scanlake.functions.severity import status_display

    return findings.select(
        "report_id", "seq",
        F.coalesce(F.col("affected_assets_short"), F.lit(fixed.INSUFFICIENT)).alias("assets"),
        F.col("display_title").alias("title"),
        "severity",
        status_display(F.col("remediation_status")).alias("status"),
        D.impact_text(F.col("description"), F.col("business_impact")).alias("impact"),
        cve_cwe_display(blob(F.col("cve"), F.col("category"), F.col("description")))
        .alias("cve_cwe"),
        or_empty(F.col("control_objective")).alias("control_objective"),
        or_empty(F.col("control_name")).alias("control_name"),
        or_empty(F.col("audit_requirement")).alias("audit_requirement"),
        D.unwrap_list_text(F.col("remediation")).alias("recommendation"),
        reference_plain(report_text(F.col("reference"))).alias("reference"),
        F.coalesce(not_blank(F.col("observation")), F.lit("New")).alias("observation"),
    )
