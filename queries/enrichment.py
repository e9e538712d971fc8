"""Queries that join findings to catalogs, caches and looked-up results."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import duck as d
from queries.report import findings, findings_and_assets
from queries.views import columns_of, lit, table, view
from scanlake.functions import ids as I
from scanlake.operators import enrich as E
from scanlake.operators import history as H
from scanlake.operators import quality as Q
from scanlake.operators import responses as R
from scanlake.operators import rollup as r
from scanlake.tables import catalogs as C
from scanlake.tables import fixed

# A CVE table built from the ids in the scan: every third id has no record.
_NUM = "CAST(substr(cve, 10) AS INT)"
_CVES = f"""SELECT cve, concat('Flaw ', cve) AS description, CAST({_NUM} % 100 AS DOUBLE) / 10 AS cvss,
 CASE {_NUM} % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS severity,
 CASE {_NUM} % 4 WHEN 0 THEN {{a}}'CWE-79', 'CWE-20'{{z}} WHEN 1 THEN {{a}}'CWE-352'{{z}} WHEN 2 THEN {{a}}'CWE-5000', 'CWE-89'{{z}} ELSE {{a}}'CWE-94'{{z}} END AS cwes,
 {{a}}{{s}}concat('https://vendor.example/', cve){{t}}, {{s}}'https://lists.example/all'{{t}}, {{s}}'https://third.example/x'{{t}}{{z}} AS references_
 FROM (SELECT DISTINCT cve FROM scan_rows WHERE cve IS NOT NULL) x WHERE {_NUM} % 3 <> 0"""
_EPSS = f"SELECT DISTINCT cve, CAST({_NUM} % 1000 AS DOUBLE) / 1000 AS epss, CAST({_NUM} % 97 AS DOUBLE) / 97 AS percentile FROM scan_rows WHERE cve IS NOT NULL AND {_NUM} % 5 <> 0"

_CATALOG = [("CWE-79", "Improper Neutralization of Input", "Base text.", "More text."),
            ("CWE-22", "", "", None), ("CWE-5000", "Lab weakness", "Only here.", "")]
_LEARNED = [("CWE-999", "Learned weakness", "From a reply.", "", "Keep learning.", "Learned Control"),
            ("CWE-79", "Never used", "x", "", "x", "x")]
_CAPECS = [("CAPEC-63", "Cross-Site Scripting", "High", "Very High"), ("CAPEC-591", "Reflected XSS", "High", ""),
           ("CAPEC-20", "Encryption Brute Forcing", "", "Low"), ("CAPEC-66", "SQL Injection", "Medium", "High")]
_BRIDGE = [("CAPEC-63", "CWE-79"), ("CAPEC-591", "CWE-79"), ("CAPEC-20", "CWE-327"), ("CAPEC-66", "CWE-89"), ("CAPEC-66", "CWE-79")]
_CONTROLS = [("SI-10", "SI", "Information Input Validation (Rev 5)"), ("AC-3", "AC", "Access Enforcement (Rev 5)"), ("SC-13", "SC", ""), ("AC-4", "AC", "Information Flow (Rev 5)")]


def _values(rows, cols) -> str:
    def v(x):
        return "NULL" if x is None else lit(x) if isinstance(x, str) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(v(x) for x in r_) + ')' for r_ in rows)}) AS t({', '.join(cols)}))"


def cves(spark, sf):
    columns_of(spark, sf, "scan_rows").createOrReplaceTempView("scan_rows")
    sql = _CVES.format(a="array(", z=")", s="named_struct('url', ", t=")")
    return spark.sql(sql).withColumnRenamed("references_", "references")


def epss(spark, sf):
    columns_of(spark, sf, "scan_rows").createOrReplaceTempView("scan_rows")
    return spark.sql(_EPSS)


def _weak(spark, sf):
    f = findings(spark, sf)
    hit = E.join_cves(f, cves(spark, sf))
    return f, hit, E.collect_weaknesses(f, hit)


def _weakness_table(spark):
    catalog = spark.createDataFrame(_CATALOG, "cwe_id string, name string, description string, extended_description string")
    learned = spark.createDataFrame(_LEARNED, "cwe_id string, name string, description string, owasp_category string, control_objective string, control_name string")
    return E.weakness_table(catalog, C.weakness_snapshot(spark), learned)


def cve_enrich(spark, sf):
    f = findings(spark, sf)
    return E.join_cves(f, cves(spark, sf)).select(
        "report_id", "id", "ord", "cve", "cvss", "severity", "description")


def cve_display(spark, sf):
    f = findings(spark, sf)
    text = I.blob(F.col("cve"), F.col("category"), F.col("description"))
    return f.select("report_id", "id", I.cve_cwe_display(text).alias("shown"))


def epss_enrich(spark, sf):
    ids = E.finding_cves(findings(spark, sf))
    return E.epss_text(E.join_epss(ids, epss(spark, sf)))


def weakness_enrich(spark, sf):
    _, _, weak = _weak(spark, sf)
    return E.join_weakness(weak, _weakness_table(spark)).select(
        "report_id", "id", "ord", "cwe_id", "name", "description", "control_name", "origin")


def _patterns(spark):
    capecs = spark.createDataFrame(_CAPECS, "capec_id string, name string, likelihood string, severity string")
    bridge = spark.createDataFrame(_BRIDGE, "capec_id string, cwe_id string")
    return E.pattern_table(bridge, capecs, C.pattern_fallback(spark))


def patterns(spark, sf):
    _, _, weak = _weak(spark, sf)
    rows = E.join_patterns(weak, _patterns(spark))
    return rows.select("report_id", "id", "capec_id", "name", "likelihood", "severity")


def patterns_text(spark, sf):
    _, _, weak = _weak(spark, sf)
    return E.top_patterns(E.join_patterns(weak, _patterns(spark)))


def frameworks(spark, sf):
    _, _, weak = _weak(spark, sf)
    return E.join_frameworks(weak, C.frameworks(spark))


def control_titles(spark, sf):
    _, _, weak = _weak(spark, sf)
    items = E.join_frameworks(weak, C.frameworks(spark)).filter("framework = 'nist_800_53'")
    controls = spark.createDataFrame(_CONTROLS, "id string, family string, title string")
    return E.enrich_controls(items, controls).select("report_id", "id", "place", "control_id", "value")


def control_family(spark, sf):
    """Control usage of one family across all findings."""
    used = control_titles(spark, sf)
    controls = spark.createDataFrame(_CONTROLS, "id string, family string, title string")
    family = H.list_family(controls, " ac ").select(F.col("id").alias("control_id"), "family")
    return used.join(family, "control_id").groupBy("control_id", "family").agg(F.count("*").alias("n"))


def _store(spark, sf):
    """A recommendation cache: what an earlier run stored for the same findings."""
    f, hit, weak = _weak(spark, sf)
    keys = E.rec_keys(f, weak, hit)
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    q = (F.col("rec_id") % 10) / 10.0
    stored = keys.withColumn("rec_id", F.col("report_id").cast("int") * 100000 + n).filter(F.col("rec_id") % 3 != 1)
    return keys, stored.select(
        "cwe_key", "severity_key", "title_hash", "rec_id", q.alias("quality_score"),
        F.concat(F.lit("Do "), F.col("rec_id").cast("string")).alias("primary_rec"),
        *[F.lit("").alias(c) for c in ("secondary_rec", "defensive_rec", "control_objective", "control_name", "audit_requirement", "business_impact")])


def best_recommendation(spark, sf):
    keys, store = _store(spark, sf)
    return E.best_recommendation(keys, store).select("report_id", "id", "tier", "primary_rec", "quality_score")


def deterministic_refs(spark, sf):
    _, hit, weak = _weak(spark, sf)
    refs = E.deterministic_refs(hit, E.join_weakness(weak, _weakness_table(spark)))
    return refs.select("report_id", "id", F.posexplode("refs").alias("i", "r")).select(
        "report_id", "id", "i", "r.title", "r.url")


def _results(f):
    """Looked-up results for two thirds of the findings; some keys are answered twice."""
    base = f.filter(F.col("first_row") % 3 != 0).select(
        F.concat_ws("-", "report_id", "id").alias("item_key"), F.lit(0).alias("pos"), "first_row")
    both = base.unionByName(base.filter(F.col("first_row") % 4 == 1).withColumn("pos", F.lit(1)))
    return both.select(
        "item_key", "pos",
        F.concat(F.lit("Objective "), F.col("pos").cast("string")).alias("control_objective"),
        F.lit("").alias("control_name"), F.lit("Check it").alias("audit_requirement"),
        F.lit(None).cast("string").alias("business_impact"),
        F.concat(F.lit("Patch "), F.col("pos").cast("string")).alias("primary"),
        F.lit(" Isolate ").alias("secondary"), F.lit("").alias("defensive"))


def apply_results(spark, sf):
    f = findings(spark, sf).withColumn("item_key", F.concat_ws("-", "report_id", "id"))
    return E.apply_results(f, _results(f)).select(
        "report_id", "id", "matched", "control_objective", "control_name", "remediation", "rec_primary")


def merge_precedence(spark, sf):
    f = findings(spark, sf).withColumn("item_key", F.concat_ws("-", "report_id", "id"))
    n = F.col("first_row")
    results = f.select(
        "item_key",
        F.lit("ignored").alias("severity"),
        F.when(n % 3 == 0, F.lit("Vendor")).when(n % 3 == 1, F.concat(F.lit("A longer and better account of the flaw: "), F.col("description"))).otherwise(F.lit("[PLACEHOLDER]")).alias("description"),
        F.when(n % 2 == 0, F.lit("Upgrade it")).otherwise(F.lit(None).cast("string")).alias("remediation"),
        F.when(n % 5 == 0, F.lit("OWASP Web Security Top 10, SANS25")).otherwise(F.lit("Vendor note 7")).alias("reference"))
    return E.merge_enrichment(f, results, "item_key").select("report_id", "id", "severity", "description", "remediation", "reference")


def enrichment_stats(spark, sf):
    f = findings(spark, sf)
    refs = I.refs_array(F.col("reference"))
    ready = E.already_resolved(F.col("remediation"), refs)
    return E.enrichment_stats(f, ready, ["report_id"])


def ready_first(spark, sf):
    f = findings(spark, sf)
    return E.ready_first(f, F.col("reference").isNull(), "first_row").select("report_id", "id", "pending")


def catalog_stats(spark, sf):
    _, store = _store(spark, sf)
    return E.catalog_stats({"cves": cves(spark, sf), "epss": epss(spark, sf)}, store)


def request_payloads(spark, sf):
    f = findings(spark, sf)
    numbered = r.batch_rows(f, ["report_id"], "first_row")
    ids = E.epss_text(E.join_epss(E.finding_cves(f), epss(spark, sf)))
    return R.request_payloads(
        numbered.join(ids, ["report_id", "id"], "left"), ["report_id", "id", "batch_no"]
    ).drop("restore_map")


def _scored_input(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    n = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "source", F.col("text").alias("description"),
        F.when(n % 3 == 0, F.lit("Apply patches.")).when(n % 3 == 1, F.concat(F.lit("Patch to 2.4.1 now.\nLimit port 8443.\n\nWatch "), F.col("source"))).alias("remediation"),
        F.when(F.col("quality") == 1, F.lit("Keep every component at a supported release with a tracked owner.")).alias("control_objective"),
        F.when(n % 2 == 0, F.lit("Patching")).alias("control_name"),
        F.when(F.col("toxic") == 1, F.lit("Check CWE-79 and CVE-2021-44228 monthly.")).otherwise(F.lit("Check.")).alias("audit_requirement"),
        F.when(n % 4 == 0, F.lit("9.8")).alias("cvss"),
        F.when(n % 5 == 0, F.lit("https://owasp.org/www-project-top-ten/")).alias("reference"))


def quality_scores(spark, sf):
    return Q.score_findings(_scored_input(spark, sf)).select(
        "doc_id", "overall", "length_score", "remediation_tiers", "specificity", F.array_join("flags", ",").alias("flags"))


def quality_failing(spark, sf):
    return Q.score_below(Q.score_findings(_scored_input(spark, sf)), 0.55).select("doc_id", "overall")


def quality_summary(spark, sf):
    return Q.quality_summary(Q.score_findings(_scored_input(spark, sf)), 0.55, ["source"])


def quality_regression(spark, sf):
    from scanlake.operators.match import quality_regression as regress

    scored = Q.score_findings(_scored_input(spark, sf))
    now = Q.quality_summary(scored, 0.55, ["source"]).select(F.col("source").alias("key"), "mean")
    base = Q.quality_summary(scored.filter(F.col("control_name").isNotNull() & ~F.col("source").isin("src1", "src2")), 0.55, ["source"])
    return regress(now, base.select(F.col("source").alias("key"), "mean"), tolerance=0.05)


def recommendation_quality(spark, sf):
    f = findings(spark, sf)
    score = Q.recommendation_quality(F.col("remediation"), F.col("description"), F.col("reference"),
                                     F.col("description"), F.col("proof_of_concept"), F.col("display_title"))
    tiers = Q.tier_score(F.col("remediation"), F.col("reference"), F.lit(" "))
    return f.select("report_id", "id", F.round(score, 6).alias("score"), F.round(tiers, 6).alias("tiers"))


QUERIES = {
    "cve_enrich": cve_enrich, "cve_display": cve_display, "epss_enrich": epss_enrich,
    "weakness_enrich": weakness_enrich, "patterns": patterns, "patterns_text": patterns_text,
    "frameworks": frameworks, "control_titles": control_titles, "control_family": control_family,
    "best_recommendation": best_recommendation, "deterministic_refs": deterministic_refs,
    "apply_results": apply_results, "merge_precedence": merge_precedence,
    "enrichment_stats": enrichment_stats, "ready_first": ready_first, "catalog_stats": catalog_stats,
    "request_payloads": request_payloads, "quality_scores": quality_scores,
    "quality_failing": quality_failing, "quality_summary": quality_summary,
    "quality_regression": quality_regression, "recommendation_quality": recommendation_quality,
}

_BLOB5 = "concat_ws(' ', coalesce(cve, ''), coalesce(description, ''), coalesce(proof_of_concept, ''), coalesce(reference, ''), coalesce(name, ''))"
_BLOB6 = "concat_ws(' ', coalesce(cve, ''), coalesce(description, ''), coalesce(category, ''), coalesce(proof_of_concept, ''), coalesce(reference, ''), coalesce(name, ''))"


def _ids(src: str, blob: str, rx: str, extra: str = "") -> str:
    return f"""SELECT report_id, id, v, row_number() OVER (PARTITION BY report_id, id ORDER BY min(pos)) - 1 AS ord FROM
     (SELECT report_id, id, upper(unnest(regexp_extract_all({blob}, '{rx}'))) AS v, generate_subscripts(regexp_extract_all({blob}, '{rx}'), 1) AS pos FROM {src}) GROUP BY report_id, id, v {extra}"""


_BASE = f"""{d.PRESENT},
cves AS ({_CVES.format(a='[', z=']', s="struct_pack(url := ", t=")")}),
epss AS ({_EPSS}),
fc AS (SELECT report_id, id, v AS cve, ord FROM ({_ids('labelled', _BLOB5, '(?i)CVE-[0-9]{4}-[0-9]{4,7}')}) WHERE ord < 3),
hit AS (SELECT fc.report_id, fc.id, fc.ord, cves.* FROM fc JOIN cves USING (cve)),
wk AS (SELECT report_id, id, v AS cwe_id, row_number() OVER (PARTITION BY report_id, id ORDER BY min(row(a, b, c))) - 1 AS ord FROM (
  SELECT report_id, id, unnest(cwes) AS v, 0 AS a, ord AS b, generate_subscripts(cwes, 1) AS c FROM hit
  UNION ALL SELECT report_id, id, v, 1, ord, 0 FROM ({_ids('labelled', _BLOB6, '(?i)CWE-[0-9]{1,5}')})) GROUP BY report_id, id, v),
snap AS {_values(C.weakness_rows(), ['cwe_id', 'name', 'description', 'owasp_category', 'control_objective', 'control_name'])},
cat AS {_values(_CATALOG, ['cwe_id', 'name', 'description', 'ext'])},
lrn AS {_values(_LEARNED, ['cwe_id', 'name', 'description', 'owasp_category', 'control_objective', 'control_name'])},
wt AS (SELECT c.cwe_id, coalesce(nullif(c.name, ''), s.name, '') AS name, coalesce(nullif(trim(concat(c.description, CASE WHEN coalesce(c.ext, '') <> '' THEN concat(' ', c.ext) ELSE '' END)), ''), s.description, '') AS description, coalesce(s.control_name, '') AS control_name, 'catalog' AS origin FROM cat c LEFT JOIN snap s USING (cwe_id)
  UNION ALL SELECT cwe_id, name, description, control_name, 'snapshot' FROM snap WHERE cwe_id NOT IN (SELECT cwe_id FROM cat)
  UNION ALL SELECT cwe_id, name, description, control_name, 'learned' FROM lrn WHERE cwe_id NOT IN (SELECT cwe_id FROM cat) AND cwe_id NOT IN (SELECT cwe_id FROM snap))"""

_PAT = f"""{_BASE},
capecs AS {_values(_CAPECS, ['capec_id', 'name', 'likelihood', 'severity'])}, bridge AS {_values(_BRIDGE, ['capec_id', 'cwe_id'])},
fb AS {_values(C.pattern_rows(), ['cwe_id', 'ordinal', 'capec_id', 'name', 'likelihood', 'severity'])},
pt AS (SELECT cwe_id, CASE likelihood WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS a,
   CASE severity WHEN 'Very High' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END AS b, capec_id, name, coalesce(nullif(likelihood, ''), 'Unknown') AS likelihood, coalesce(nullif(severity, ''), 'Unknown') AS severity FROM bridge JOIN capecs USING (capec_id)
  UNION ALL SELECT cwe_id, ordinal, 0, capec_id, name, likelihood, severity FROM fb WHERE cwe_id NOT IN (SELECT cwe_id FROM bridge)),
fp AS (SELECT * FROM (SELECT report_id, id, ord, pt.*, row_number() OVER (PARTITION BY report_id, id, capec_id ORDER BY ord, a, b, name) AS rn FROM wk JOIN pt USING (cwe_id)) WHERE rn = 1)"""

_FW = f"""{_BASE}, fw AS {_values(C.framework_rows(), ['cwe_id', 'framework', 'ordinal', 'value'])},
fx AS (SELECT report_id, id, framework, value, min(row(ord, ordinal)) AS seen_at FROM wk JOIN fw USING (cwe_id) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY report_id, id, framework ORDER BY CASE WHEN framework = 'sans_top25_rank' THEN CAST(value AS INT) END, seen_at, value) AS place FROM fx),
ff AS (SELECT report_id, id, framework, place, value FROM fr WHERE place = 1 OR framework IN ('nist_800_53', 'pci_dss', 'owasp_wstg', 'iso_27001')),
ctl AS {_values(_CONTROLS, ['control_id', 'family', 'title'])},
ct AS (SELECT report_id, ff.id, place, upper(split_part(value, ' ', 1)) AS control_id, CASE WHEN coalesce(title, '') <> '' THEN concat(upper(split_part(value, ' ', 1)), ' ', title) ELSE value END AS value
  FROM ff LEFT JOIN ctl ON ctl.control_id = upper(split_part(value, ' ', 1)) WHERE framework = 'nist_800_53')"""

_RK = f"""{_BASE},
kk AS (SELECT f.report_id, f.id, string_agg(DISTINCT w.cwe_id, '|' ORDER BY w.cwe_id) AS cwe_key, lower(trim(any_value(f.severity))) AS severity_key, any_value(f.name) AS name, any_value(f.description) AS description FROM labelled f JOIN wk w ON w.report_id = f.report_id AND w.id = f.id GROUP BY f.report_id, f.id),
cc AS (SELECT report_id, id, string_agg(DISTINCT cve, '|' ORDER BY cve) AS c FROM hit GROUP BY report_id, id),
rk AS (SELECT kk.*, substr(sha256(concat(lower(trim(name)), '::', coalesce(c, ''), '::', lower({d.sq(d.oe('description'))}))), 1, 16) AS title_hash, CAST(kk.report_id AS INT) * 100000 + CAST(regexp_extract(kk.id, '([0-9]+)', 1) AS INT) AS rec_id FROM kk LEFT JOIN cc ON cc.report_id = kk.report_id AND cc.id = kk.id),
st AS (SELECT *, (rec_id % 10) / 10.0::DOUBLE AS quality_score FROM rk WHERE rec_id % 3 <> 1),
good AS (SELECT * FROM st WHERE quality_score >= 0.72)"""

_LESS = """(CASE WHEN {c} = '' OR {b} = '' OR lower({c}) = lower({b}) THEN FALSE ELSE contains(lower({b}), lower({c}))
 OR (len(regexp_extract_all({c}, '[A-Za-z0-9]+')) <= 8 AND len(regexp_extract_all({b}, '[A-Za-z0-9]+')) >= 14)
 OR (len(regexp_extract_all({c}, '[A-Za-z0-9]+')) > 0 AND len(list_filter(list_distinct(regexp_extract_all(lower({c}), '[A-Za-z0-9]+')), lambda x: NOT list_contains(regexp_extract_all(lower({b}), '[A-Za-z0-9]+'), x))) = 0
  AND len(list_distinct(regexp_extract_all(lower({c}), '[A-Za-z0-9]+'))) < len(list_distinct(regexp_extract_all(lower({b}), '[A-Za-z0-9]+')))) END)"""


def _merge(old: str, new: str, generic=()) -> str:
    m = f"(CASE WHEN NOT {d.placeholder(new)} THEN {new} ELSE {old} END)"
    inc = lambda x: f"({d.placeholder(x)}" + (f" OR {d.sq(d.oe(x))} IN {d.inlist(generic)}" if generic else "") + ")"
    less = _LESS.format(c=d.sq(d.oe(m)), b=d.sq(d.oe(old)))
    return f"CASE WHEN (CASE WHEN {inc(old)} THEN FALSE WHEN {inc(m)} THEN TRUE ELSE {less} END) THEN {old} ELSE {m} END"


_SC = """sc0 AS (SELECT doc_id, source, text AS description, CASE doc_id % 3 WHEN 0 THEN 'Apply patches.' WHEN 1 THEN concat('Patch to 2.4.1 now.', chr(10), 'Limit port 8443.', chr(10), chr(10), 'Watch ', source) END AS remediation,
  CASE WHEN quality = 1 THEN 'Keep every component at a supported release with a tracked owner.' END AS control_objective, CASE WHEN doc_id % 2 = 0 THEN 'Patching' END AS control_name,
  CASE WHEN toxic = 1 THEN 'Check CWE-79 and CVE-2021-44228 monthly.' ELSE 'Check.' END AS audit_requirement, CASE WHEN doc_id % 4 = 0 THEN '9.8' END AS cvss,
  CASE WHEN doc_id % 5 = 0 THEN 'https://owasp.org/www-project-top-ten/' END AS reference FROM documents LEFT JOIN labels USING (doc_id))"""


def _ls(f: str) -> str:
    return f"least(1.0::DOUBLE, length(coalesce({f}, '')) / {float(fixed.SCORE_MIN_LEN[f])}::DOUBLE)"


_FLAGS = ", ".join(
    f"CASE WHEN {_ls(f)} < 0.6 THEN 'short:{f}' END, CASE WHEN coalesce({f}, '') <> '' AND {d.anyc(f'lower({f})', fixed.SCORE_GENERIC_PHRASES)} AND length({f}) < 150 THEN 'generic:{f}' END"
    for f in Q.FIELDS
)
_SCORED = f"""{_SC},
sc1 AS (SELECT *, concat_ws(' ', coalesce(description, ''), coalesce(remediation, ''), coalesce(control_objective, ''), coalesce(audit_requirement, ''), '') AS blob,
  ({' + '.join(_ls(f) for f in Q.FIELDS)}) / 5.0 AS len_,
  least(len(list_filter(string_split({d.sq(d.oe('remediation'))}, chr(10)), lambda x: {d.sq('x')} <> '')), 3) / 3.0::DOUBLE AS tier_ FROM sc0),
sc2 AS (SELECT *, least(1.0::DOUBLE, (CASE WHEN regexp_matches(blob, '(?i)CVE-[0-9]{{4}}-[0-9]{{3,7}}') THEN 0.25::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(blob, '\\b[0-9]+(?:\\.[0-9]+){{1,3}}\\b') THEN 0.25::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(blob, '\\b(?:TCP|UDP)?/?\\s*:?([0-9]{{2,5}})\\b') THEN 0.15::DOUBLE ELSE 0 END)
  + (CASE WHEN contains(lower(blob), 'cwe-') THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN coalesce(cvss, '') <> '' THEN 0.10::DOUBLE ELSE 0 END)
  + (CASE WHEN length(coalesce(reference, '')) > 30 THEN 0.05::DOUBLE ELSE 0 END)) AS spec_ FROM sc1),
scored AS (SELECT doc_id, source, control_name, round(0.4::DOUBLE * len_ + 0.3::DOUBLE * tier_ + 0.3::DOUBLE * spec_, 3) AS overall, round(len_, 3) AS length_score, round(tier_, 3) AS remediation_tiers, round(spec_, 3) AS specificity,
  array_to_string(list_filter([{_FLAGS}, CASE WHEN tier_ < 0.67 THEN 'rem:missing-tiers' END, CASE WHEN spec_ < 0.3 THEN 'low-specificity' END], lambda x: x IS NOT NULL), ',') AS flags FROM sc2)"""

_T = lambda c: f"(CASE WHEN length(coalesce({c}, '')) > 80 THEN 0.25::DOUBLE WHEN length(coalesce({c}, '')) > 30 THEN 0.1::DOUBLE ELSE 0 END)"

ORACLE = {
    "cve_enrich": d.q(_BASE, "SELECT report_id, id, ord, cve, cvss, severity, description FROM hit"),
    "cve_display": d.q(d.PRESENT + f", bl AS (SELECT report_id, id, concat_ws(' ', coalesce(cve, ''), coalesce(category, ''), coalesce(description, '')) AS blob FROM labelled), fa AS ({_ids('bl', 'blob', '(?i)CVE[-\\s]?[0-9]{4}[-\\s]?[0-9]{4,7}')}), fb AS ({_ids('bl', 'blob', '(?i)CWE[-\\s]?[0-9]{1,5}')}), al AS (SELECT report_id, id, string_agg(v, ', ' ORDER BY k, ord) AS shown FROM (SELECT *, 0 AS k FROM fa UNION ALL SELECT *, 1 FROM fb) GROUP BY report_id, id)",
        "SELECT report_id, id, coalesce(shown, 'N/A') AS shown FROM bl LEFT JOIN al USING (report_id, id)"),
    "epss_enrich": d.q(_BASE, "SELECT report_id, id, coalesce(string_agg(concat(cve, ': ', format('{:.2f}', round(epss * 100, 2)), '% (', CASE WHEN epss >= 0.7 THEN 'very high' WHEN epss >= 0.4 THEN 'high' WHEN epss >= 0.1 THEN 'medium' WHEN epss >= 0.01 THEN 'low' ELSE 'very low' END, ')'), '; ' ORDER BY ord) FILTER (epss IS NOT NULL), 'unknown') AS epss_text FROM fc LEFT JOIN epss USING (cve) GROUP BY report_id, id"),
    "weakness_enrich": d.q(_BASE, "SELECT report_id, id, ord, cwe_id, name, description, control_name, origin FROM wk JOIN wt USING (cwe_id)"),
    "patterns": d.q(_PAT, "SELECT report_id, id, capec_id, name, likelihood, severity FROM fp"),
    "patterns_text": d.q(_PAT + ", px AS (SELECT report_id, id, string_agg(concat(capec_id, ' - ', name, ' (likelihood: ', likelihood, ')'), '; ' ORDER BY ord, a, b, capec_id) FILTER (pl <= 2) AS t FROM (SELECT *, row_number() OVER (PARTITION BY report_id, id ORDER BY ord, a, b, capec_id) AS pl FROM fp) GROUP BY report_id, id)",
        "SELECT report_id, id, CASE WHEN length(t) <= 240 THEN t ELSE concat(rtrim(substr(t, 1, 237)), '...') END AS patterns_text FROM px"),
    "frameworks": d.q(_FW, "SELECT * FROM ff"),
    "control_titles": d.q(_FW, "SELECT * FROM ct"),
    "control_family": d.q(_FW, "SELECT control_id, family, count(*) AS n FROM ct JOIN ctl USING (control_id) WHERE family = 'AC' GROUP BY control_id, family"),
    "best_recommendation": d.q(_RK, """SELECT r.report_id, r.id, CASE WHEN e.rec_id IS NOT NULL THEN 'title' ELSE 'weakness' END AS tier, concat('Do ', coalesce(e.rec_id, b.rec_id)) AS primary_rec, coalesce(e.quality_score, b.quality_score) AS quality_score FROM rk r
       JOIN (SELECT *, row_number() OVER (PARTITION BY cwe_key, severity_key ORDER BY quality_score DESC, rec_id) AS rn FROM good) b ON b.cwe_key = r.cwe_key AND b.severity_key = r.severity_key AND b.rn = 1
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cwe_key, severity_key, title_hash ORDER BY quality_score DESC, rec_id) AS rn FROM good) e ON e.cwe_key = r.cwe_key AND e.severity_key = r.severity_key AND e.title_hash = r.title_hash AND e.rn = 1"""),
    "deterministic_refs": d.q(_BASE + f""", rf AS (SELECT report_id, id, 0 AS k, ord, 0 AS j, concat('NVD Advisory: ', cve) AS title, concat('{fixed.NVD_URL}', cve) AS url FROM hit
       UNION ALL SELECT report_id, id, 0, ord, j, references_[j].url, references_[j].url FROM hit, (VALUES (1), (2)) AS jj(j)
       UNION ALL SELECT report_id, id, 1, ord, 0, trim(concat('MITRE ', cwe_id, ': ', name), ': '), concat('{fixed.CWE_URL}', replace(cwe_id, 'CWE-', ''), '.html') FROM wk JOIN wt USING (cwe_id)),
       ru AS (SELECT *, row_number() OVER (PARTITION BY report_id, id, url ORDER BY k, ord, j) AS rn FROM rf)""",
       "SELECT * FROM (SELECT report_id, id, row_number() OVER (PARTITION BY report_id, id ORDER BY k, ord, j) - 1 AS i, title, url FROM ru WHERE rn = 1) WHERE i < 8"),
    "apply_results": d.q(d.PRESENT, """SELECT report_id, id, first_row % 3 <> 0 AS matched, CASE WHEN first_row % 3 <> 0 THEN concat('Objective ', CASE WHEN first_row % 4 = 1 THEN 1 ELSE 0 END) END AS control_objective, NULL AS control_name,
       CASE WHEN first_row % 3 <> 0 THEN concat('Patch ', CASE WHEN first_row % 4 = 1 THEN 1 ELSE 0 END, chr(10), 'Isolate') ELSE trim(coalesce(remediation, '')) END AS remediation,
       CASE WHEN first_row % 3 <> 0 THEN concat('Patch ', CASE WHEN first_row % 4 = 1 THEN 1 ELSE 0 END) ELSE coalesce(remediation, '') END AS rec_primary FROM labelled"""),
    "merge_precedence": d.q(d.PRESENT + """, rs AS (SELECT *, CASE WHEN first_row % 3 = 0 THEN 'Vendor' WHEN first_row % 3 = 1 THEN concat('A longer and better account of the flaw: ', description) ELSE '[PLACEHOLDER]' END AS nd,
       CASE WHEN first_row % 2 = 0 THEN 'Upgrade it' END AS nr, CASE WHEN first_row % 5 = 0 THEN 'OWASP Web Security Top 10, SANS25' ELSE 'Vendor note 7' END AS nf FROM labelled)""",
       f"SELECT report_id, id, severity, {_merge('description', 'nd')} AS description, {_merge('remediation', 'nr')} AS remediation, {_merge('reference', 'nf', fixed.GENERIC_VALUES['reference'])} AS reference FROM rs"),
    "enrichment_stats": d.q(d.PRESENT, f"""SELECT report_id, count(*) AS total_findings, count(*) FILTER (NOT ok) AS eligible_findings, count(*) FILTER (ok) AS resolved_locally FROM
       (SELECT report_id, coalesce(remediation, '') <> '' AND coalesce(reference, '') <> '' AND (contains(reference, 'http') OR lower(reference) NOT IN {d.inlist(fixed.STOCK_REFERENCES)}) AS ok FROM labelled) GROUP BY report_id"""),
    "ready_first": d.q(d.PRESENT, "SELECT report_id, id, reference IS NULL AS pending FROM labelled"),
    "catalog_stats": d.q(_RK, "SELECT 'cves' AS catalog, count(*) AS rows, NULL::BIGINT AS high_quality FROM cves UNION ALL SELECT 'epss', count(*), NULL FROM epss UNION ALL SELECT 'recommendations', count(*), count(*) FILTER (quality_score >= 0.8) FROM st"),
    "request_payloads": d.q(_BASE + ", ep AS (SELECT report_id, id, coalesce(string_agg(concat(cve, ': ', format('{:.2f}', round(epss * 100, 2)), '% (', CASE WHEN epss >= 0.7 THEN 'very high' WHEN epss >= 0.4 THEN 'high' WHEN epss >= 0.1 THEN 'medium' WHEN epss >= 0.01 THEN 'low' ELSE 'very low' END, ')'), '; ' ORDER BY ord) FILTER (epss IS NOT NULL), 'unknown') AS e FROM fc LEFT JOIN epss USING (cve) GROUP BY report_id, id), nb AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY first_row) - 1 AS i FROM labelled)",
        "SELECT nb.report_id, nb.id, i // 5 AS batch_no, CASE WHEN e IS NULL THEN to_json(struct_pack(item_key := concat('f', i), severity := severity, title := name, description := trim(coalesce(description, '')))) ELSE to_json(struct_pack(item_key := concat('f', i), severity := severity, title := name, description := trim(coalesce(description, '')), epss_text := e)) END AS payload FROM nb LEFT JOIN ep ON ep.report_id = nb.report_id AND ep.id = nb.id"),
    "quality_scores": d.q(_SCORED, "SELECT doc_id, overall, length_score, remediation_tiers, specificity, flags FROM scored"),
    "quality_failing": d.q(_SCORED, "SELECT doc_id, overall FROM scored WHERE overall < 0.55"),
    "quality_summary": d.q(_SCORED, "SELECT source, count(*) AS count, round(avg(overall), 3) AS mean, round(1 - count(*) FILTER (overall < 0.55) / count(*)::DOUBLE, 3) AS pass_rate, count(*) FILTER (overall < 0.55) AS failing FROM scored GROUP BY source"),
    "quality_regression": d.q(_SCORED + ", nw AS (SELECT source AS key, round(avg(overall), 3) AS mean FROM scored GROUP BY source), bs AS (SELECT source AS key, round(avg(overall), 3) AS baseline_mean FROM scored WHERE control_name IS NOT NULL AND source NOT IN ('src1', 'src2') GROUP BY source)",
       "SELECT key, mean, baseline_mean, CASE WHEN baseline_mean IS NULL THEN 'created' WHEN baseline_mean - mean > 0.05 THEN 'regression' ELSE 'ok' END AS status FROM nw LEFT JOIN bs USING (key)"),
    "recommendation_quality": d.q(d.PRESENT, f"""SELECT report_id, id, round(least(1.0::DOUBLE, {_T('remediation')} + {_T('description')} + {_T('reference')} + CASE WHEN length(coalesce(description, '')) > 50 THEN 0.15::DOUBLE ELSE 0 END
       + CASE WHEN length(coalesce(proof_of_concept, '')) > 50 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(coalesce(display_title, '')) > 60 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score,
       round(((CASE WHEN coalesce(remediation, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(reference, '') <> '' THEN 1 ELSE 0 END)) / 3.0::DOUBLE, 6) AS tiers FROM labelled"""),
}
