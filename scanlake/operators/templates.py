"""Choosing and rendering recommendation templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.titles import select_template
from scanlake.operators.keywords import keyword_join


def choose_templates(
    rows: DataFrame, key: str, title: str, eol_paths: DataFrame, services: DataFrame,
    choice: str = "_s",
) -> DataFrame:
    """Add the template choice (key, vars) of every title; `key` is unique.

    `eol_paths` (ordinal, word, template_key, upgrade_targets) and `services` (ordinal,
    word, template_key) are the look-up tables of a payload, of any size; the first word
    that the lower-cased title contains counts.
    """
    eol = eol_paths.select("ordinal", F.col("word").alias("keyword"), F.struct("template_key", "upgrade_targets").alias("label"))
    named = services.select("ordinal", F.col("word").alias("keyword"), F.col("template_key").alias("label"))
    rows = rows.withColumn("_lower", F.lower(title))
    rows = keyword_join(rows, key, "_lower", eol, "_eol")
    rows = keyword_join(rows, key, "_lower", named, "_service")
    picked = select_template(F.col(title), F.col("_lower"), F.col("_eol"), F.col("_service"))
    return rows.withColumn(choice, picked).drop("_lower", "_eol", "_service")


def render_templates(picked: DataFrame, templates: DataFrame, choice: str = "_s") -> DataFrame:
    """Fill the chosen template of each row.

    `choice` is struct(key, vars) from `select_template`; `templates` is
    (template_key, template).  When the template names a variable the rule does not
    give, the template is returned as it is; no template gives NULL.
    """
    keyed = picked.withColumn("template_key", F.col(f"{choice}.key")).join(
        templates, "template_key", "left"
    )
    filled = F.aggregate(
        F.map_entries(F.col(f"{choice}.vars")),
        F.col("template"),
        lambda t, kv: F.replace(t, F.concat(F.lit("{"), kv["key"], F.lit("}")), kv["value"]),
    )
    wanted = F.array_distinct(
        F.regexp_extract_all(F.col("template"), F.lit(r"\{(\w+)\}"), F.lit(1))
    )
    gap = F.size(F.array_except(wanted, F.map_keys(F.col(f"{choice}.vars")))) > 0
    return keyed.withColumn(
        "recommendation", F.when(gap, F.col("template")).otherwise(filled)
    ).drop("template", choice)
