"""Enrichment plan: every catalog join over one set of findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.derive import recommendation_text
from scanlake.functions.text import has_text, not_blank, or_empty
from scanlake.operators import enrich as E


@dataclass
class Catalogs:
    """Inputs of the enrichment; each is a DataFrame with the columns its join reads."""

    cves: DataFrame
    epss: DataFrame
    weaknesses: DataFrame
    patterns: DataFrame
    frameworks: DataFrame
    controls: DataFrame
    recommendations: DataFrame | None = None


def enrich(findings: DataFrame, catalogs: Catalogs) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(enriched findings, detail tables).

    The first joined CVE sets the score and a missing description; the first known
    weakness sets missing control fields; a cached recommendation overrides the
    control fields and the remediation; a finding without one keeps its remediation
    as the primary tier.
    """
    hit = E.join_cves(findings, catalogs.cves)
    weak = E.collect_weaknesses(findings, hit)
    known = E.join_weakness(weak, catalogs.weaknesses)
    first_cve = hit.groupBy(*E.KEYS).agg(
        F.min_by(F.struct("cvss", "description"), "ord").alias("_cve"))
    first_weak = known.groupBy(*E.KEYS).agg(
        F.min_by(F.struct("control_objective", "control_name"), "ord").alias("_weak"))
    refs = E.deterministic_refs(hit, known).withColumnRenamed("refs", "catalog_refs")
    scores = E.epss_text(E.join_epss(E.finding_cves(findings), catalogs.epss))
    patterns = E.join_patterns(weak, catalogs.patterns)
    mapped = E.join_frameworks(weak, catalogs.frameworks)
    controls = E.enrich_controls(
        mapped.filter(F.col("framework") == "nist_800_53"), catalogs.controls)
    have = set(findings.columns)
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = (
        findings.join(first_cve, E.KEYS, "left").join(first_weak, E.KEYS, "left")
        .join(refs, E.KEYS, "left").join(scores, E.KEYS, "left")
        .join(E.top_patterns(patterns), E.KEYS, "left")
        .withColumns({
            "cvss": F.coalesce(F.col("_cve.cvss").cast("string"), own("cvss")),
            "description": F.when(
                ~has_text(own("description")) & has_text(F.col("_cve.description")),
                F.col("_cve.description")).otherwise(own("description")),
            "control_objective": F.coalesce(
                own("control_objective"), not_blank(F.col("_weak.control_objective"))),
            "control_name": F.coalesce(
                own("control_name"), not_blank(F.col("_weak.control_name"))),
            "audit_requirement": own("audit_requirement"),
            "business_impact": own("business_impact"),
        })
        .drop("_cve", "_weak")
    )
    out = out.withColumns({
        "rec_primary": or_empty(own("remediation")), "rec_secondary": F.lit(""),
        "rec_defensive": F.lit(""), "cached": F.lit(False),
    })
    if catalogs.recommendations is not None:
        best = E.best_recommendation(
            E.rec_keys(findings, weak, hit), catalogs.recommendations)
        found = best.select(*E.KEYS, F.struct(*E.REC_FIELDS).alias("_b"))
        out = out.join(found, E.KEYS, "left")
        hitb = F.col("_b").isNotNull()
        out = out.withColumns({
            **{
                c: F.coalesce(not_blank(F.col(f"_b.{c}")), F.col(c))
                for c in E.RESULT_FIELDS
            },
            "rec_primary": F.when(hitb, F.col("_b.primary_rec")).otherwise(F.col("rec_primary")),
            "rec_secondary": F.when(hitb, F.col("_b.secondary_rec")).otherwise(F.lit("")),
            "rec_defensive": F.when(hitb, F.col("_b.defensive_rec")).otherwise(F.lit("")),
            "cached": hitb,
        }).drop("_b")
    out = out.withColumn(
        "remediation",
        not_blank(recommendation_text(
            F.col("rec_primary"), F.col("rec_secondary"), F.col("rec_defensive"))),
    )
    return out, {"cves": hit, "weaknesses": known, "patterns": patterns, "frameworks": mapped,
                 "controls": controls}
