"""Loaders for public catalogs: weaknesses, attack patterns, controls, CVE and EPSS files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions.text import not_blank, or_empty, squeeze, strip
from scanlake.session import staged

# Text that may hold markup is read as a string and its tags are dropped.
_CONSEQUENCES = (
    "Common_Consequences struct<Consequence:array<struct<"
    "Scope:array<string>,Impact:array<string>,Note:string>>>"
)
_RELATED = (
    "struct<Related_Weakness:array<struct<_Nature:string,_CWE_ID:string>>>"
)
_REFERENCES = "References struct<Reference:array<struct<_External_Reference_ID:string>>>"
WEAKNESS_SCHEMA = (
    "_ID string, _Name string, _Abstraction string, _Status string, Description string, "
    f"Extended_Description string, {_CONSEQUENCES}, "
    "Potential_Mitigations struct<Mitigation:array<struct<Phase:array<string>,"
    "Description:string>>>, "
    "Detection_Methods struct<Detection_Method:array<struct<Method:string,"
    "Description:string>>>, "
    f"Related_Weaknesses {_RELATED}, {_REFERENCES}"
)
PATTERN_SCHEMA = (
    "_ID string, _Name string, _Abstraction string, _Status string, "
    "Likelihood_Of_Attack string, Typical_Severity string, Description string, "
    "Prerequisites struct<Prerequisite:array<string>>, "
    "Skills_Required struct<Skill:array<struct<_Level:string,_VALUE:string>>>, "
    "Resources_Required struct<Resource:array<string>>, "
    f"{_CONSEQUENCES}, "
    "Mitigations struct<Mitigation:array<string>>, "
    "Execution_Flow struct<Attack_Step:array<struct<Phase:string,Step_Title:string,"
    "Description:string>>>, "
    f"Related_Weaknesses struct<Related_Weakness:array<struct<_CWE_ID:string>>>, {_REFERENCES}"
)
REFERENCE_SCHEMA = "_Reference_ID string, Title string, URL string"


def _xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_")
        .option("ignoreNamespace", True).schema(schema).load(path)
    )


def _plain(c: Column) -> Column:
    """Text without tags, white space squeezed."""
    return squeeze(F.regexp_replace(or_empty(c), "<[^>]+>", " "))


def _lines(items: Column, line) -> Column:
    """Non-blank lines of a repeated element, joined by ' | '."""
    made = F.filter(F.transform(items, line), lambda x: strip(x) != "")
    return or_empty(F.array_join(made, " | "))


def _bracketed(head: Column, body: Column) -> Column:
    return F.when(or_empty(head) != "", F.concat(F.lit("["), strip(head), F.lit("] "), body)
                  ).otherwise(body)


def _consequences() -> Column:
    def line(c: Column) -> Column:
        note = _plain(c["Note"])
        return F.concat(
            F.lit("Scope: "), or_empty(F.array_join(c["Scope"], ", ")), F.lit("; Impact: "),
            or_empty(F.array_join(c["Impact"], ", ")),
            F.when(note != "", F.concat(F.lit("; Note: "), note)).otherwise(F.lit("")),
        )

    return _lines(F.col("Common_Consequences.Consequence"), line)


def _with_refs(records: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Resolve reference ids through the catalog's reference list, keeping their order."""
    known = _xml(spark, path, "External_Reference", REFERENCE_SCHEMA).select(
        F.col("_Reference_ID").alias("ref_id"),
        F.struct(or_empty(strip(F.col("Title"))).alias("title"),
                 or_empty(strip(F.col("URL"))).alias("url")).alias("ref"),
    )
    ids = records.select("id", F.posexplode("_refs._External_Reference_ID").alias("i", "ref_id"))
    refs = ids.join(known, "ref_id").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("i", "ref"))).alias("_r")
    ).select("id", F.col("_r.ref").alias("refs"))
    none = F.array().cast("array<struct<title:string,url:string>>")
    return records.drop("_refs").join(refs, "id", "left").withColumn(
        "refs", F.coalesce(F.col("refs"), none)
    )


def load_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """One row per weakness of a CWE XML catalog, repeated parts flattened to text."""
    w = _xml(spark, path, "Weakness", WEAKNESS_SCHEMA).filter(F.col("_ID").isNotNull())
    none = F.array().cast("array<struct<nature:string,cwe_id:string>>")
    related = F.transform(
        F.filter(F.col("Related_Weaknesses.Related_Weakness"),
                 lambda r: or_empty(r["_CWE_ID"]) != ""),
        lambda r: F.struct(
            or_empty(r["_Nature"]).alias("nature"),
            F.concat(F.lit("CWE-"), r["_CWE_ID"]).alias("cwe_id")),
    )
    rows = w.select(
        F.concat(F.lit("CWE-"), F.col("_ID")).alias("id"),
        or_empty(F.col("_Name")).alias("name"),
        or_empty(F.col("_Abstraction")).alias("abstraction"),
        or_empty(F.col("_Status")).alias("status"),
        _plain(F.col("Description")).alias("description"),
        _plain(F.col("Extended_Description")).alias("extended_description"),
        _consequences().alias("consequences"),
        _lines(
            F.col("Potential_Mitigations.Mitigation"),
            lambda m: _bracketed(F.element_at(m["Phase"], -1), _plain(m["Description"])),
        ).alias("mitigations"),
        _lines(
            F.col("Detection_Methods.Detection_Method"),
            lambda m: _bracketed(m["Method"], _plain(m["Description"])),
        ).alias("detection_methods"),
        F.coalesce(related, none).alias("related"),
        F.col("References.Reference").alias("_refs"),
    )
    return _with_refs(rows, spark, path)


def load_attack_patterns(spark: SparkSession, path: str) -> DataFrame:
    """One row per attack pattern of a CAPEC XML catalog."""
    p = _xml(spark, path, "Attack_Pattern", PATTERN_SCHEMA).filter(F.col("_ID").isNotNull())
    step = lambda s: F.btrim(
        F.concat(F.lit("["), or_empty(s["Phase"]), F.lit("] "), or_empty(s["Step_Title"]),
                 F.lit(": "), _plain(s["Description"])), F.lit(": "))
    rows = p.select(
        F.concat(F.lit("CAPEC-"), F.col("_ID")).alias("id"),
        or_empty(F.col("_Name")).alias("name"),
        or_empty(F.col("_Abstraction")).alias("abstraction"),
        or_empty(F.col("_Status")).alias("status"),
        _plain(F.col("Likelihood_Of_Attack")).alias("likelihood"),
        _plain(F.col("Typical_Severity")).alias("severity"),
        _plain(F.col("Description")).alias("description"),
        _lines(F.col("Prerequisites.Prerequisite"), _plain).alias("prerequisites"),
        _lines(F.col("Skills_Required.Skill"),
               lambda s: _bracketed(s["_Level"], _plain(s["_VALUE"]))).alias("skills_required"),
        _lines(F.col("Resources_Required.Resource"), _plain).alias("resources_required"),
        _consequences().alias("consequences"),
        _lines(F.col("Mitigations.Mitigation"), _plain).alias("mitigations"),
        _lines(F.col("Execution_Flow.Attack_Step"), step).alias("execution_flow"),
        F.coalesce(
            F.array_distinct(F.transform(
                F.col("Related_Weaknesses.Related_Weakness._CWE_ID"),
                lambda c: F.concat(F.lit("CWE-"), c))),
            F.array().cast("array<string>"),
        ).alias("related_cwes"),
        F.col("References.Reference").alias("_refs"),
    )
    return _with_refs(rows, spark, path)


def pattern_weakness_bridge(patterns: DataFrame) -> DataFrame:
    """(capec_id, cwe_id), distinct."""
    return patterns.select(
        F.col("id").alias("capec_id"), F.explode("related_cwes").alias("cwe_id")
    ).distinct()


# --- controls --------------------------------------------------------------------

_PROP = "props:array<struct<name:string,value:string>>"
_PART3 = f"struct<name:string,prose:string,{_PROP}>"
_PART = f"struct<name:string,prose:string,{_PROP},parts:array<{_PART3}>>"
_CTRL = f"struct<id:string,title:string,{_PROP},parts:array<{_PART}>>"
CONTROL_SCHEMA = "catalog struct<groups:array<variant>>"


def _last_label(props: Column) -> Column:
    found = F.filter(props, lambda p: p["name"] == "label")
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"]).otherwise(F.lit(""))


def _statement(parts: Column) -> Column:
    """Prose of the statement, then one line per item with its label."""
    def one(p: Column) -> Column:
        items = F.transform(
            F.filter(p["parts"], lambda x: or_empty(x["prose"]) != ""),
            lambda x: strip(F.concat(_last_label(x["props"]), F.lit(" "), x["prose"])),
        )
        lead = F.filter(F.array(strip(or_empty(p["prose"]))), lambda x: x != "")
        return F.concat(lead, F.coalesce(items, F.array().cast("array<string>")))

    stated = F.filter(parts, lambda p: p["name"] == "statement")
    return or_empty(F.array_join(F.flatten(F.transform(stated, one)), "\n"))


_ID = "upper(coalesce(try_variant_get(v, '$.id', 'string'), ''))"


def _children(kind: str, **fields: str) -> str:
    """SQL: the entries of a node's list of one kind as nodes, with their place behind the path."""
    place = f"concat(path, '/{kind[0]}', lpad(CAST(i AS STRING), 6, '0'))"
    stated = ", ".join(f"'{k}', {v.format(place=place)}" for k, v in fields.items())
    listed = f"coalesce(try_variant_get(v, '$.{kind}s', 'array<variant>'), array())"
    return f"transform({listed}, (x, i) -> named_struct('kind', '{kind}', {stated}, 'path', {place}, 'v', x))"


_WALK = f"""
WITH RECURSIVE walk(kind, family, parent_id, owner, path, v) AS (
  SELECT 'group', '', '', '', lpad(CAST(i AS STRING), 6, '0'), v FROM {{roots}}
  UNION ALL
  SELECT c.kind, c.family, c.parent_id, c.owner, c.path, c.v FROM walk LATERAL VIEW inline(filter(concat(
    {_children("group", family=f"coalesce(nullif({_ID}, ''), family)", parent_id="''", owner="''")},
    {_children("control", family=f"if(kind = 'group', coalesce(nullif({_ID}, ''), family), family)",
               parent_id=f"if(kind = 'control', {_ID}, '')", owner="{place}")},
    {_children("part", family="family", parent_id="''", owner="owner")}
  ), n -> n.kind <> 'control' OR coalesce(try_variant_get(n.v, '$.id', 'string'), '') <> '')) c AS kind, family, parent_id, owner, path, v
)
SELECT * FROM walk"""


def load_controls(spark: SparkSession, path: str) -> DataFrame:
    """Controls of an OSCAL catalog with their enhancements, of any depth, and parent ids.

    Groups may hold groups; a control's family is the innermost group with an id.  A
    control without an id is left out, and so is what it holds.  Guidance is gathered from
    parts of any depth, in their order.  Groups, controls and parts are one tree, walked by
    one recursive query; Spark's own bounds on recursion hold (100 levels, a million nodes).
    """
    raw = spark.read.schema(CONTROL_SCHEMA).option("multiLine", True).json(path)
    roots = raw.select(F.posexplode("catalog.groups").alias("i", "v"))
    nodes = staged(spark.sql(_WALK, roots=roots), "controls")
    text = nodes.filter("kind = 'part'").select(
        "owner", "path", F.try_variant_get("v", "$", "struct<name:string,prose:string>").alias("p"))
    prose = strip(or_empty(F.col("p.prose")))
    said = text.filter((F.col("p.name") == "guidance") & (prose != "")).groupBy("owner").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("path", prose.alias("t"))))["t"], "\n").alias("guidance"))
    controls = nodes.filter("kind = 'control'").select("family", "parent_id", "owner", F.try_variant_get("v", "$", _CTRL).alias("c"))
    return controls.join(said, "owner", "left").select(
        F.upper("c.id").alias("id"), "family", or_empty(F.col("c.title")).alias("title"),
        _last_label(F.col("c.props")).alias("label"), _statement(F.col("c.parts")).alias("statement"),
        or_empty(F.col("guidance")).alias("guidance"), "parent_id")


# --- CVE and EPSS files -------------------------------------------------------------

_CVSS = (
    "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>"
)
CVE_SCHEMA = (
    "struct<vulnerabilities:array<struct<cve:struct<id:string,"
    "descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_CVSS},cvssMetricV30:{_CVSS},cvssMetricV2:{_CVSS}>,"
    "weaknesses:array<struct<description:array<struct<value:string>>>>,"
    "references:array<struct<url:string,tags:array<string>>>>>>>"
)


def flatten_cve(raw: DataFrame, json: str = "value") -> DataFrame:
    """All CVE records of API-shaped JSON pages: English text, newest CVSS, weaknesses, references."""
    page = F.from_json(F.col(json), CVE_SCHEMA)["vulnerabilities"]["cve"]
    rows = raw.select(F.explode(page).alias("c")).filter(F.col("c").isNotNull())
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    m = F.coalesce(*[
        F.get(F.col("c.metrics." + k), F.lit(0))
        for k in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
    ])
    staged = rows.withColumn("_m", m)
    values = F.flatten(F.transform("c.weaknesses", lambda w: w["description"]["value"]))
    none = F.array().cast("array<string>")
    return staged.select(
        F.col("c.id").alias("cve"),
        or_empty(english).alias("description"),
        F.col("_m.cvssData.baseScore").alias("cvss"),
        F.coalesce(F.col("_m.cvssData.baseSeverity"), F.col("_m.baseSeverity")).alias("severity"),
        F.coalesce(
            F.array_distinct(F.filter(values, lambda v: v.startswith("CWE-"))), none
        ).alias("cwes"),
        F.coalesce(
            F.filter("c.references", lambda r: or_empty(r["url"]) != ""),
            F.array().cast("array<struct<url:string,tags:array<string>>>"),
        ).alias("references"),
    )


def load_epss(spark: SparkSession, path: str) -> DataFrame:
    """(cve, epss, percentile, date) of daily EPSS files; '#' opens the comment line with the date.

    The date is the score date of a row's own file, NULL where its comment has none.
    """
    dates = (
        spark.read.text(path).filter(F.col("value").startswith("#"))
        .select(F.col("_metadata.file_path").alias("_file"),
                F.regexp_extract("value", r"score_date:(\d{4}-\d{2}-\d{2})", 1).alias("_date"))
        .groupBy("_file").agg(F.max(not_blank(F.col("_date"))).alias("date"))
    )
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    return (
        rows.select("*", F.col("_metadata.file_path").alias("_file")).join(dates, "_file", "left")
        .select(
            F.upper(strip(F.col("cve"))).alias("cve"),
            F.col("epss").try_cast("double").alias("epss"),
            F.col("percentile").try_cast("double").alias("percentile"),
            "date",
        )
        .filter(not_blank(F.col("cve")).isNotNull())
    )
