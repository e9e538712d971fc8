"""Model responses that arrive as a table: parse, repair, explode, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.text import not_blank, or_empty, strip, trim_text
from scanlake.operators.privacy import redact_or_fail

FINDING_ITEM = "array<struct<name:string,severity:string,cvss:string,cve:string," \
    "affected_assets:variant,description:string,remediation:string,vuln_id:string," \
    "observation:string,remediation_status:string,risk_status:string>>"


def json_text(raw: Column) -> Column:
    """The outermost object of a reply without think blocks and code fences, else NULL."""
    t = F.regexp_replace(or_empty(raw), r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?is)<think>.*$", "")
    t = strip(F.regexp_replace(t, r"(?i)```(?:json)?\s*", ""))
    return not_blank(F.regexp_extract(t, r"(?s)\{.*\}", 0))


def escape_breaks(c: Column) -> Column:
    """Line breaks and tabs inside quoted strings, escaped.

    Splitting at unescaped quotes puts string contents at odd places.
    """
    parts = F.split(c, r'(?<!\\)"')
    fixed = F.transform(
        parts,
        lambda p, i: F.when(
            i % 2 == 1,
            F.replace(F.replace(F.replace(p, F.lit("\n"), F.lit("\\n")),
                                F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")),
        ).otherwise(p),
    )
    return F.array_join(fixed, '"')


def repair_commas(c: Column) -> Column:
    """Drop trailing commas and add the missing ones between lines."""
    t = F.regexp_replace(c, r",\s*([}\]])", "$1")
    t = F.regexp_replace(t, r'(")\s*\n(\s*")', "$1,\n$2")
    t = F.regexp_replace(t, r"(\})\s*\n(\s*\{)", "$1,\n$2")
    return F.regexp_replace(t, r'(\]|true|false|null|\d)\s*\n(\s*")', "$1,\n$2")


def whole_value(text: Column) -> Column:
    """The text as one JSON value (VARIANT), NULL where anything stands behind it.

    The parser stops after the first value; within a list and within an object it cannot.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"d":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(held, "$.d", "variant"))


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `doc` (VARIANT) and `parse_stage`; unparsed replies have a NULL doc.

    Stages: as cut, with escaped breaks, with repaired commas, with both.  A reply with a
    second object or a text between its braces is not parsed.
    """
    cut = df.withColumn("_cut", json_text(F.col(raw))).withColumn(
        "_esc", escape_breaks(F.col("_cut"))
    )
    tries = [
        ("plain", F.col("_cut")), ("escaped", F.col("_esc")),
        ("repaired", repair_commas(F.col("_cut"))),
        ("escaped_repaired", repair_commas(F.col("_esc"))),
    ]
    staged = cut.withColumns({
        f"_p{i}": whole_value(t) for i, (_, t) in enumerate(tries)
    })
    stage = None
    for i, (name, _) in enumerate(tries):
        cond = F.col(f"_p{i}").isNotNull()
        stage = F.when(cond, F.lit(name)) if stage is None else stage.when(cond, F.lit(name))
    return staged.withColumns({
        "doc": F.coalesce(*[F.col(f"_p{i}") for i in range(len(tries))]),
        "parse_stage": stage.otherwise(F.lit("failed")),
    }).drop("_cut", "_esc", *[f"_p{i}" for i in range(len(tries))])


def quarantine(parsed: DataFrame) -> DataFrame:
    """Replies that no stage could parse."""
    return parsed.filter(F.col("doc").isNull())


def explode_findings(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item_no, finding fields): the `findings` list of every reply.

    A reply whose `findings` is not a list gives no rows.  Assets may be a list or a text.
    """
    items = F.try_variant_get(F.col("doc"), "$.findings", FINDING_ITEM)
    rows = parsed.filter(F.col("doc").isNotNull()).select(
        *keys, F.posexplode(items).alias("item_no", "_f")
    ).select(*keys, "item_no", "_f.*")
    return rows.withColumn("affected_assets", listed_text(F.col("affected_assets")))


def listed_text(v: Column) -> Column:
    """A VARIANT text as it is, a list as its entries with commas."""
    return F.when(
        F.schema_of_variant(v).startswith("ARRAY"),
        F.array_join(F.try_variant_get(v, "$", "array<string>"), ", "),
    ).otherwise(F.try_variant_get(v, "$", "string"))


def reference_entry(v: Column) -> Column:
    """One entry of a reference list: an object's title and url, or a text as the title."""
    return F.when(
        F.schema_of_variant(v).startswith("OBJECT"),
        F.struct(F.try_variant_get(v, "$.title", "string").alias("title"),
                 F.try_variant_get(v, "$.url", "string").alias("url")),
    ).otherwise(
        F.struct(F.try_variant_get(v, "$", "string").alias("title"), F.lit("").alias("url")))


def normalise_result(parsed: DataFrame) -> DataFrame:
    """Typed result fields; a text recommendation becomes the primary tier, a text
    reference one titled entry."""
    get = lambda path, t: F.try_variant_get(F.col("doc"), path, t)
    rec_kind = F.schema_of_variant(get("$.recommendation", "variant"))
    ref_kind = F.schema_of_variant(get("$.reference", "variant"))
    is_text = rec_kind == "STRING"
    refs = F.when(
        ref_kind == "STRING",
        F.array(F.struct(get("$.reference", "string").alias("title"), F.lit("").alias("url"))),
    ).when(
        ref_kind.startswith("ARRAY"),
        F.transform(get("$.reference", "array<variant>"), reference_entry),
    ).otherwise(F.array().cast("array<struct<title:string,url:string>>"))
    return parsed.withColumns({
        "item_key": get("$.key", "string"),
        **{f: or_empty(get("$." + f, "string")) for f in
           ("control_objective", "control_name", "audit_requirement")},
        "business_impact": strip(or_empty(get("$.business_impact", "string"))),
        "primary": F.when(is_text, get("$.recommendation", "string")).otherwise(
            or_empty(get("$.recommendation.primary", "string"))),
        "secondary": F.when(is_text, F.lit("")).otherwise(
            or_empty(get("$.recommendation.secondary", "string"))),
        "defensive": F.when(is_text, F.lit("")).otherwise(
            or_empty(get("$.recommendation.defensive", "string"))),
        "refs": refs,
    }).drop("doc")


def explode_results(parsed: DataFrame) -> DataFrame:
    """One row per result: the entries of a reply's `results` list, or the reply itself.

    Adds `result_no`, the place of a result in its reply.
    """
    listed = F.try_variant_get(F.col("doc"), "$.results", "array<variant>")
    single = F.when(listed.isNull(), F.array("doc")).otherwise(listed)
    others = [c for c in parsed.columns if c != "doc"]
    return parsed.filter(F.col("doc").isNotNull()).select(*others, F.posexplode(single).alias("result_no", "doc"))


def request_payloads(
    findings: DataFrame, keys: list[str], title_limit: int | None = None,
    description_limit: int | None = None,
) -> DataFrame:
    """The redacted record handed to an external look-up, as JSON.

    `findings` carries item_key, name, severity, description and the joined display
    texts; a value that survives redaction raises.  Texts are whole unless a limit is
    given.
    """
    def text(c: str, limit: int | None) -> Column:
        return strip(or_empty(F.col(c))) if limit is None else trim_text(F.col(c), limit)

    trimmed = findings.withColumns({
        "title": text("name", title_limit), "description": text("description", description_limit),
    })
    texts = ["title", "description"] + [
        c for c in ("epss_text", "patterns_text") if c in findings.columns
    ]
    safe = redact_or_fail(trimmed, keys, texts)
    return safe.select(
        *keys, "restore_map",
        F.to_json(F.struct("item_key", "severity", *texts)).alias("payload"),
    )
