"""Queries over files that Spark writes from the given tables, and over ids and references."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries import duck as d
from queries import text as T
from queries.views import view
from scanlake.functions import ids as I
from scanlake.functions.text import norm_label
from scanlake.session import ensure_checkpoint_dir, once
from scanlake.sources import catalogs as C
from scanlake.sources.scans import read_scan_csv, resolve_columns


def csv_round_trip(spark, sf):
    """The scan written as CSV exports, line breaks and quotes included, and read back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/scan-{uuid.uuid4().hex}"
    n = F.col("row_id")
    rows = view(spark, sf, "scan_rows").select(
        n.cast("string").alias("Plugin ID"), F.col("name").alias("Plugin Name"), F.col("severity").alias("Risk"),
        F.when(n % 10 == 0, F.concat(F.lit('said "'), "description", F.lit('",\n\n"" and 5" more'))).otherwise(F.col("description")).alias("Description"),
        F.col("remediation").alias("Solution"), F.col("reference").alias("See Also"))
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = resolve_columns(read_scan_csv(spark, path))
    return back.select(F.col("plugin_id").alias("number"), "name", "severity", "description", "remediation", "reference")


_CVE_PAGE = """to_json(named_struct('vulnerabilities', array(named_struct('cve', named_struct(
  'id', concat('CVE-2024-', CAST(10000 + p_partkey AS STRING)),
  'descriptions', filter(array(named_struct('lang', 'de', 'value', 'fehler'), named_struct('lang', if(p_partkey % 4 > 0, 'en', 'fr'), 'value', p_name)), x -> true),
  'metrics', CASE p_partkey % 3 WHEN 0 THEN named_struct('cvssMetricV31', array(named_struct('cvssData', named_struct('baseScore', p_size / 10.0D, 'baseSeverity', p_type), 'baseSeverity', CAST(NULL AS STRING))), 'cvssMetricV2', array(named_struct('cvssData', named_struct('baseScore', 1.0D, 'baseSeverity', 'no'), 'baseSeverity', 'no')))
    WHEN 1 THEN named_struct('cvssMetricV31', CAST(NULL AS ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE, baseSeverity: STRING>, baseSeverity: STRING>>), 'cvssMetricV2', array(named_struct('cvssData', named_struct('baseScore', p_size / 20.0D, 'baseSeverity', CAST(NULL AS STRING)), 'baseSeverity', p_type))) END,
  'weaknesses', array(named_struct('description', array(named_struct('value', concat('CWE-', CAST(p_size AS STRING))), named_struct('value', 'NVD-CWE-noinfo'), named_struct('value', concat('CWE-', CAST(p_size AS STRING)))))),
  'references', array(named_struct('url', concat('https://x.example/', p_brand), 'tags', array('a')), named_struct('url', '', 'tags', array('b'))))))))"""


def cve_records(spark, sf):
    """One API page a part, flattened again."""
    pages = view(spark, sf, "part").select(F.expr(_CVE_PAGE).alias("value"))
    return C.flatten_cve(pages).select(
        "cve", "description", "cvss", "severity", F.array_join("cwes", ",").alias("cwes"), F.array_join("references.url", ",").alias("urls"))


def pattern_bridge(spark, sf):
    patterns = view(spark, sf, "part").select(
        F.concat(F.lit("CAPEC-"), (F.col("p_partkey") % 50).cast("string")).alias("id"),
        F.array(F.concat(F.lit("CWE-"), F.col("p_size").cast("string")), F.lit("CWE-79"), F.lit("CWE-79")).alias("related_cwes"))
    return C.pattern_weakness_bridge(patterns)


def _all_refs(spark, sf):
    links = T._page_links(spark, sf)
    refs = F.concat(I.refs_array(F.col("links")), I.auto_refs(F.col("ids"), F.col("ids"), None, None))
    return once(links, {"refs": I.rank_refs(refs, None)})


def every_ref(spark, sf):
    """The ranked references of each page without a cut."""
    return _all_refs(spark, sf).select("page_id", F.posexplode("refs").alias("i", "r")).select("page_id", "i", "r.title", "r.url")


def reference_texts(spark, sf):
    return _all_refs(spark, sf).select("page_id", I.reference_text(F.col("refs")).alias("shown"))


_FORMS = """CASE event_id % 6 WHEN 0 THEN concat(' cwe-', CAST(event_id % 1000 AS STRING), ' ') WHEN 1 THEN CAST(event_id * 37 AS STRING)
 WHEN 2 THEN concat('Cve-2021-', CAST(event_id AS STRING), chr(10)) WHEN 3 THEN concat('CVE-20-', CAST(event_id AS STRING)) WHEN 4 THEN concat('CWE ', type) END"""


def id_norms(spark, sf):
    e = view(spark, sf, "run_events").withColumn("form", F.expr(_FORMS))
    return e.select(
        "event_id", I.norm_cwe(F.col("form")).alias("cwe"), I.norm_cve(F.col("form")).alias("cve"),
        norm_label(F.concat(F.lit("  Control   "), F.upper("type"), F.lit("\t"), F.col("form"))).alias("label"))


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "cve_records": cve_records,
    "pattern_bridge": pattern_bridge,
    "every_ref": every_ref,
    "reference_texts": reference_texts,
    "id_norms": id_norms,
}

_T = d.sq("upper(coalesce(form, ''))")
#: The list of `rank_refs` names the first ids only; here all of them count.
_EVERY_ID = T._REFS.replace(" WHERE rn <= 3)", ")").replace(" WHERE rn <= 2)", ")")
ORACLE = {
    "csv_round_trip": d.q(d.SCAN, """SELECT CAST(row_id AS VARCHAR) AS number, name, severity,
      CASE WHEN row_id % 10 = 0 THEN concat('said "', description, '",', chr(10), chr(10), '"" and 5" more') ELSE description END AS description, remediation, reference FROM scan_rows"""),
    "cve_records": """SELECT concat('CVE-2024-', 10000 + p_partkey) AS cve, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS description,
      CASE p_partkey % 3 WHEN 0 THEN p_size / 10.0::DOUBLE WHEN 1 THEN p_size / 20.0::DOUBLE END AS cvss, CASE WHEN p_partkey % 3 < 2 THEN p_type END AS severity,
      concat('CWE-', p_size) AS cwes, concat('https://x.example/', p_brand) AS urls FROM part""",
    "pattern_bridge": "SELECT DISTINCT concat('CAPEC-', p_partkey % 50) AS capec_id, unnest([concat('CWE-', p_size), 'CWE-79']) AS cwe_id FROM part",
    "every_ref": d.q(_EVERY_ID, "SELECT page_id, i, title, url FROM rk"),
    "reference_texts": d.q(T._REFS, """SELECT page_id, coalesce(string_agg(coalesce(nullif(trim(title), ''), trim(url)), chr(10) ORDER BY i)
      FILTER (NOT (contains(lower(concat_ws(' ', title, url)), 'cwe.mitre.org') OR contains(lower(concat_ws(' ', title, url)), 'nvd.nist.gov') OR regexp_matches(upper(trim(title)), '^(CWE-|CVE-|NVD )'))), '') AS shown FROM rk GROUP BY page_id"""),
    "id_norms": d.q(f"{d.EVENTS}, f AS (SELECT event_id, type, {_FORMS.replace('STRING', 'VARCHAR')} AS form FROM run_events)", f"""SELECT event_id,
      CASE WHEN regexp_full_match({_T}, '[0-9]{{1,5}}') THEN concat('CWE-', {_T}) WHEN regexp_full_match({_T}, 'CWE-[0-9]{{1,5}}') THEN {_T} END AS cwe,
      CASE WHEN regexp_full_match({_T}, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}') THEN {_T} END AS cve,
      {d.key("('  Control   ' || upper(type) || chr(9) || form)")} AS label FROM f"""),
}
