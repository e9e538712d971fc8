"""Recommendation template payloads and handmade-report corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions.ids import extract_ids
from scanlake.functions.text import norm_label, not_blank, or_empty, strip
from scanlake.tables import fixed

PAYLOAD_SCHEMA = (
    "RECOMMENDATION_TEMPLATES map<string,string>, "
    "EOL_UPGRADE_PATHS map<string,struct<upgrade_targets:string,template:string>>, "
    "SERVICE_HARDENING map<string,string>"
)


def load_templates(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of a template payload: templates, eol_paths, services.

    The look-ups keep the payload's order in `ordinal`.
    """
    raw = spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)
    return {
        "templates": raw.select(
            F.explode("RECOMMENDATION_TEMPLATES").alias("template_key", "template")),
        "eol_paths": raw.select(F.posexplode("EOL_UPGRADE_PATHS").alias("ordinal", "word", "_p")).select(
            "ordinal", "word", F.col("_p.template").alias("template_key"), "_p.upgrade_targets"),
        "services": raw.select(F.posexplode("SERVICE_HARDENING").alias("ordinal", "word", "template_key")),
        "violations": template_violations(raw),
    }


def template_violations(raw: DataFrame) -> DataFrame:
    """One row per broken rule of a payload; an empty result means it is valid."""
    checks = F.array(
        *[
            F.when(F.col(c).isNull(), F.lit(f"missing {c}"))
            for c in ("RECOMMENDATION_TEMPLATES", "EOL_UPGRADE_PATHS", "SERVICE_HARDENING")
        ],
        F.when(F.size("RECOMMENDATION_TEMPLATES") == 0, F.lit("RECOMMENDATION_TEMPLATES is empty")),
        F.when(
            F.exists(F.map_values("RECOMMENDATION_TEMPLATES"), lambda v: v.isNull()),
            F.lit("RECOMMENDATION_TEMPLATES has a value that is not a string")),
        F.when(
            F.exists(F.map_values("SERVICE_HARDENING"), lambda v: v.isNull()),
            F.lit("SERVICE_HARDENING has a value that is not a string")),
        F.when(
            F.exists(
                F.map_values("EOL_UPGRADE_PATHS"),
                lambda v: v.isNull() | v["upgrade_targets"].isNull() | v["template"].isNull()),
            F.lit("EOL_UPGRADE_PATHS entries need upgrade_targets and template")),
    )
    return raw.select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))


def require_valid(tables: dict[str, DataFrame]) -> None:
    """Raise ValueError with the first violation of a payload."""
    bad = tables["violations"].limit(1).collect()
    if bad:
        raise ValueError(bad[0]["violation"])


CORPUS_FIELDS = [
    "name", "severity", "status", "affected", "impact", "cve_cwe", "control_objective",
    "control_name", "audit_requirement", "recommendation", "reference", "repeat_status",
]


def build_corpus(cells: DataFrame) -> DataFrame:
    """Label/value rows of report tables -> one record per table.

    `cells` is (source, table_no, row_no, label, value).  Labels go through their
    aliases; the last value of a field counts.  A table is kept when at least six rows
    match and name, control objective and recommendation are filled.
    """
    field = None
    for alias, name in fixed.CORPUS_LABELS.items():
        cond = F.col("_l") == alias
        field = F.when(cond, F.lit(name)) if field is None else field.when(cond, F.lit(name))
    rows = (
        cells.withColumn("_l", norm_label(F.col("label")))
        .withColumn("field", field)
        .withColumn("value", not_blank(strip(or_empty(F.col("value")))))
        .filter(F.col("field").isNotNull() & F.col("value").isNotNull())
    )
    last = [
        F.max_by(
            F.when(F.col("field") == f, F.col("value")),
            F.when(F.col("field") == f, F.col("row_no")),
        ).alias(f)
        for f in CORPUS_FIELDS
    ]
    wide = rows.groupBy("source", "table_no").agg(F.count("*").alias("matched"), *last)
    text = F.col("cve_cwe")
    tidy = lambda p: F.array_distinct(
        F.transform(extract_ids(text, p), lambda x: F.regexp_replace(x, "-+", "-")))
    return (
        wide.filter(
            (F.col("matched") >= 6) & F.col("name").isNotNull()
            & F.col("control_objective").isNotNull() & F.col("recommendation").isNotNull()
        )
        .withColumns({
            "cves": tidy(r"(?i)CVE[\s\-]*\d{4}[\s\-]*\d{3,7}"),
            "cwes": tidy(r"(?i)CWE[\s\-]*\d{1,5}"),
        })
        .drop("cve_cwe", "matched")
    )
