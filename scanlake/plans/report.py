"""Report-level composition: narrative, overrides, front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.text import (
    has_text, is_placeholder, join_sentences, not_blank, or_empty, report_text, strip,
)
from scanlake.operators import presentation as p
from scanlake.operators import rollup as r
from scanlake.session import stable

DERIVED = [
    "affected_assets_raw", "display_title", "taxonomy_family", "taxonomy_label", "subnet_key",
    "subnet_label", "display_control_name", "display_control_objective",
]


def _clean(c):
    t = report_text(c)
    return F.when(~is_placeholder(t), t)


def apply_overrides(composed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Left-join report overrides; a filled override wins.

    `overrides` has report_id and any of introduction_overview,
    introduction_scope_bridge, objectives (one objective per line, bullets allowed).
    """
    renamed = overrides.select(
        "report_id", *[F.col(c).alias("_o_" + c) for c in overrides.columns if c != "report_id"]
    )
    out = composed.join(renamed, "report_id", "left")
    stated = F.filter(F.array("objective_1", "objective_2", "objective_3"), lambda x: has_text(x))
    out = out.withColumn("objectives", stated)
    if "_o_objectives" in out.columns:
        lines = F.filter(
            F.transform(
                F.split(_clean(F.col("_o_objectives")), "\n"),
                lambda x: strip(F.regexp_replace(x, "^(?:- |\\* |• )", "")),
            ),
            lambda x: has_text(x),
        )
        out = out.withColumn(
            "objectives", F.when(F.size(lines) > 0, lines).otherwise(F.col("objectives"))
        )
    for c in ("introduction_overview", "introduction_scope_bridge"):
        if "_o_" + c in out.columns:
            have = F.col(c) if c in composed.columns else F.lit(None).cast("string")
            out = out.withColumn(c, F.coalesce(_clean(F.col("_o_" + c)), have))
    return out.drop(*[c for c in out.columns if c.startswith("_o_")])


def front_matter(composed: DataFrame) -> DataFrame:
    """First meaningful of the composed and the raw text; objectives as sentences."""
    def pick(*names: str):
        have = [_clean(F.col(n)) for n in names if n in composed.columns]
        return F.coalesce(*have, F.lit(""))

    goals = F.transform(
        F.col("objectives"),
        lambda x: F.when(x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit("."))),
    )
    return composed.withColumns({
        "executive_summary": pick("introduction_overview", "executive_summary"),
        "introduction": pick("introduction_scope_bridge", "scope_summary"),
        "objectives": F.array_join(F.array_distinct(goals), " "),
    })


def present(findings: DataFrame, subnet_summary: DataFrame, keys: list[str]) -> DataFrame:
    """Derived report fields of every finding."""
    shown = p.with_category(findings, subnet_summary, keys)
    return p.with_control_display(p.with_taxonomy(p.with_display_title(shown)))


def compose_report(
    findings: DataFrame, subnet_summary: DataFrame, keys: list[str]
) -> dict[str, DataFrame]:
    """Findings with derived fields, outline groups, and the narrative.

    `subnet_summary` is keyed by `keys`.  Derived columns are dropped and computed
    again, so composing twice gives the same.
    """
    base = findings.drop(*DERIVED, "subnet_count", "first_subnet", "web_asset")
    have = set(base.columns)
    base = base.withColumns({
        c: F.lit(None).cast("string")
        for c in ("control_name", "control_objective") if c not in have
    })
    shown = stable(present(base, subnet_summary, keys))
    return {
        "findings": shown,
        "outline_groups": r.outline_groups(shown),
        "narrative": r.narrative(r.report_facts(shown)),
    }
