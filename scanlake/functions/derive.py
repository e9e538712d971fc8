"""Column builders for derived finding texts and enrichment predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.text import (
    any_contains, first_keyword, first_sentence, has_text, is_evidence, is_placeholder, lookup,
    not_blank, or_empty, report_text, strip,
)
from scanlake.tables import fixed

SEVERITY_PREFIX = r"(?i)^\s*(?:Critical|High|Medium|Low|Informational|Info)\s*[:\-]\s*"


def business_impact(severity: Column, name: Column) -> Column:
    label = F.initcap(strip(or_empty(severity)))
    template = lookup(label, fixed.IMPACT_TEMPLATES, F.lit(fixed.IMPACT_TEMPLATES["Medium"]))
    who = F.coalesce(not_blank(strip(name)), F.lit(fixed.IMPACT_DEFAULT_NAME))
    return F.replace(template, F.lit("{name}"), who)


def derive_audit(name: Column, description: Column, control_name: Column,
                 remediation: Column) -> Column:
    hay = F.lower(F.concat_ws(
        " ", or_empty(name), or_empty(description), or_empty(control_name), or_empty(remediation)
    ))
    fix = report_text(remediation)
    sentence = F.when(has_text(fix), not_blank(first_sentence(fix)))
    return F.coalesce(
        first_keyword(hay, fixed.AUDIT_KEYWORDS),
        F.concat(F.lit(fixed.AUDIT_PREFIX), sentence),
        F.lit(""),
    )


def audit_requirement(audit: Column, name: Column, description: Column, control_name: Column,
                      remediation: Column) -> Column:
    """Keep the stated requirement unless it is missing or reads like evidence."""
    text = report_text(audit)
    return F.when(
        is_placeholder(text) | is_evidence(text),
        derive_audit(name, description, control_name, remediation),
    ).otherwise(text)


def derive_description(description: Column, plugin_output: Column) -> Column:
    """Missing description: up to three sentences of the plugin output."""
    src = strip(or_empty(plugin_output))
    sentences = F.filter(
        F.slice(F.split(src, r"(?<=[.!?])\s+"), 1, 3), lambda s: F.length(s) > 20
    )
    made = not_blank(F.array_join(sentences, " "))
    usable = has_text(src) & (F.length(src) > 50)
    return F.when(is_placeholder(description), F.coalesce(F.when(usable, made), description)
                  ).otherwise(description)


def impact_text(description: Column, impact: Column) -> Column:
    """Description and impact without leading severity labels, newline-joined."""
    d = F.regexp_replace(or_empty(description), SEVERITY_PREFIX, "")
    i = F.regexp_replace(or_empty(impact), SEVERITY_PREFIX, "")
    return (
        F.when(is_placeholder(i), d)
        .when(d == "", i)
        .otherwise(F.concat(d, F.lit("\n"), i))
    )


def recommendation_text(primary: Column, secondary: Column, defensive: Column,
                        bullet: str = "") -> Column:
    """Non-blank tiers, one line each."""
    tiers = F.transform(F.array(primary, secondary, defensive), lambda t: strip(or_empty(t)))
    lines = F.transform(
        F.filter(tiers, lambda t: t != ""), lambda t: F.concat(F.lit(bullet), t)
    )
    return F.array_join(lines, "\n")


def unwrap_list_text(c: Column) -> Column:
    """\"['a', 'b']\" -> bullet lines; any other text is only trimmed."""
    t = strip(or_empty(c))
    items = F.filter(
        F.transform(
            F.from_json(t, "array<string>", {"allowSingleQuotes": "true"}), lambda x: strip(x)
        ),
        lambda x: x != "",
    )
    bullets = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(t.rlike(r"(?s)^\[.*\]$") & (F.size(items) > 0), bullets).otherwise(t)


# --- predicates for enrichment ------------------------------------------------------

def is_generic(field: str, c: Column) -> Column:
    known = [v.lower() for v in fixed.GENERIC_VALUES.get(field, [])]
    return F.lower(strip(or_empty(c))).isin(known) if known else F.lit(False)


def is_incomplete(c: Column, field: str | None = None) -> Column:
    """Missing, or equal to a stock value of the field."""
    out = is_placeholder(c)
    if field in fixed.GENERIC_VALUES:
        out = out | strip(or_empty(c)).isin(fixed.GENERIC_VALUES[field])
    return out


def is_thin(field: str, c: Column) -> Column:
    """Blank, too short, or a remediation of one line or of stock phrases."""
    t = strip(or_empty(c))
    out = (t == "") | (F.length(t) < fixed.LOOKUP_MIN_LEN.get(field, 0))
    if field == "remediation":
        lines = F.filter(F.split(t, "\n"), lambda x: strip(x) != "")
        stock = any_contains(F.lower(t), fixed.GENERIC_REMEDIATION) & (F.length(t) < 120)
        out = out | (F.size(lines) < 2) | stock
    return out


def needs_enrichment(description: Column, remediation: Column, control_objective: Column,
                     control_name: Column, audit: Column, reference: Column) -> Column:
    pairs = {
        "description": description, "remediation": remediation,
        "control_objective": control_objective, "control_name": control_name,
        "audit_requirement": audit, "reference": reference,
    }
    out = F.lit(False)
    for field, c in pairs.items():
        out = out | is_incomplete(c, field) | is_thin(field, c)
    return out


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))


def is_less_specific(candidate: Column, baseline: Column) -> Column:
    """Candidate is a part of, much shorter than, or a token subset of the baseline."""
    c, b = strip(or_empty(candidate)), strip(or_empty(baseline))
    cl, bl = F.lower(c), F.lower(b)
    ct, bt = F.array_distinct(_tokens(cl)), F.array_distinct(_tokens(bl))
    subset = (
        (F.size(ct) > 0) & (F.size(F.array_except(ct, bt)) == 0) & (F.size(ct) < F.size(bt))
    )
    short = (F.size(_tokens(c)) <= 8) & (F.size(_tokens(b)) >= 14)
    return F.when((c == "") | (b == "") | (cl == bl), F.lit(False)).otherwise(
        bl.contains(cl) | short | subset
    )


def keep_prior(prior: Column, new: Column, field: str | None = None) -> Column:
    """True when the scan's own value must not be replaced by the looked-up one."""
    return (
        F.when(is_incomplete(prior, field), F.lit(False))
        .when(is_incomplete(new, field), F.lit(True))
        .otherwise(is_less_specific(new, prior))
    )


def prefer_value(prior: Column, new: Column, field: str | None = None) -> Column:
    merged = F.coalesce(F.when(has_text(new), new), prior)
    return F.when(keep_prior(prior, merged, field), prior).otherwise(merged)


def group_label(display: Column, taxonomy: Column, subnet: Column, category: Column) -> Column:
    t, s = F.when(has_text(taxonomy), strip(taxonomy)), F.when(has_text(subnet), strip(subnet))
    return F.coalesce(
        F.when(has_text(display), strip(display)),
        F.when(t == s, t),
        F.concat(t, F.lit(" / "), s),
        t,
        s,
        F.when(has_text(category), strip(category)),
        F.lit("General Findings"),
    )
