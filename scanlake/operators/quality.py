"""Finding quality: heuristic scores, summary, recommendation quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.ids import CVE_SHORT
from scanlake.functions.text import any_contains, or_empty, strip
from scanlake.session import once
from scanlake.tables import fixed

VERSION = r"\b\d+(?:\.\d+){1,3}\b"
PORT = r"\b(?:TCP|UDP)?/?\s*:?(\d{2,5})\b"
FIELDS = ["description", "remediation", "control_objective", "control_name", "audit_requirement"]


def length_score(field: str, c: Column) -> Column:
    n = fixed.SCORE_MIN_LEN[field]
    return F.least(F.lit(1.0), F.length(or_empty(c)) / F.lit(float(n)))


def tier_score(primary: Column, secondary: Column, defensive: Column) -> Column:
    """Filled tiers of a structured recommendation, out of three."""
    filled = F.lit(0)
    for c in (primary, secondary, defensive):
        filled = filled + F.when(strip(or_empty(c)) != "", 1).otherwise(0)
    return filled / 3.0


def line_tier_score(c: Column) -> Column:
    """The same for plain text: non-blank lines, at most three."""
    lines = F.filter(F.split(strip(or_empty(c)), "\r\n|[\n\r]"), lambda x: strip(x) != "")
    return F.least(F.size(lines), F.lit(3)) / 3.0


def specificity(blob: Column, cwe: Column, cvss: Column, reference: Column) -> Column:
    """Bonus for concrete markers: CVE, version, port, CWE, score, references."""
    def bonus(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    total = (
        bonus(blob.rlike(CVE_SHORT), 0.25)
        + bonus(blob.rlike(VERSION), 0.25)
        + bonus(blob.rlike(PORT), 0.15)
        + bonus((or_empty(cwe) != "") | F.lower(blob).contains("cwe-"), 0.15)
        + bonus(or_empty(cvss) != "", 0.10)
        + bonus(F.length(or_empty(reference)) > 30, 0.05)
    )
    return F.least(total, F.lit(1.0))


def score_findings(findings: DataFrame) -> DataFrame:
    """Add overall, length, remediation_tiers, specificity and flags.

    overall = 0.4 length + 0.3 tiers + 0.3 specificity, three decimals.
    """
    have = set(findings.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    blob = F.concat_ws(" ", *[
        or_empty(get(c)) for c in
        ("description", "remediation", "control_objective", "audit_requirement",
         "proof_of_concept")
    ])
    staged = findings.withColumn("_blob", blob).withColumns(
        {"_l_" + f: length_score(f, get(f)) for f in FIELDS}
    )
    total = F.lit(0.0)
    for f in FIELDS:
        total = total + F.col("_l_" + f)
    staged = once(staged, {
        "_len": total / 5.0,
        "_tier": line_tier_score(get("remediation")),
        "_spec": specificity(F.col("_blob"), get("cwe"), get("cvss"), get("reference")),
    })
    flags = []
    for f in FIELDS:
        text = or_empty(get(f))
        flags.append(F.when(F.col("_l_" + f) < 0.6, F.lit("short:" + f)))
        flags.append(F.when(
            (text != "") & any_contains(F.lower(text), fixed.SCORE_GENERIC_PHRASES)
            & (F.length(text) < 150), F.lit("generic:" + f)))
    flags.append(F.when(F.col("_tier") < 0.67, F.lit("rem:missing-tiers")))
    flags.append(F.when(F.col("_spec") < 0.3, F.lit("low-specificity")))
    overall = 0.40 * F.col("_len") + 0.30 * F.col("_tier") + 0.30 * F.col("_spec")
    return staged.withColumns({
        "overall": F.round(overall, 3),
        "length_score": F.round("_len", 3),
        "remediation_tiers": F.round("_tier", 3),
        "specificity": F.round("_spec", 3),
        "flags": F.filter(F.array(*flags), lambda x: x.isNotNull()),
    }).drop("_blob", "_len", "_tier", "_spec", *["_l_" + f for f in FIELDS])


def score_below(scored: DataFrame, minimum: float) -> DataFrame:
    """The failing findings as rows."""
    return scored.filter(F.col("overall") < minimum)


def quality_summary(scored: DataFrame, minimum: float = 0.55, keys: list[str] = []) -> DataFrame:
    """count, mean, pass_rate and failing per key; zeros for an empty input."""
    n = F.count("*")
    failing = F.count_if(F.col("overall") < minimum)
    return scored.groupBy(*keys).agg(
        n.alias("count"),
        F.coalesce(F.round(F.avg("overall"), 3), F.lit(0.0)).alias("mean"),
        F.when(n == 0, F.lit(0.0)).otherwise(F.round(1 - failing / n, 3)).alias("pass_rate"),
        failing.alias("failing"),
    )


def recommendation_quality(primary: Column, secondary: Column, defensive: Column,
                           control_objective: Column, audit: Column, impact: Column) -> Column:
    """0..1 from the substance of a recommendation."""
    def tier(c: Column) -> Column:
        n = F.length(or_empty(c))
        return F.when(n > 80, F.lit(0.25)).when(n > 30, F.lit(0.1)).otherwise(F.lit(0.0))

    def longer(c: Column, n: int, bonus: float) -> Column:
        return F.when(F.length(or_empty(c)) > n, F.lit(bonus)).otherwise(F.lit(0.0))

    return F.least(
        F.lit(1.0),
        tier(primary) + tier(secondary) + tier(defensive)
        + longer(control_objective, 50, 0.15) + longer(audit, 50, 0.1) + longer(impact, 60, 0.1),
    )
