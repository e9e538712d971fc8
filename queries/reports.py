"""Whole report chains over the scan and the replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import duck as d
from queries import enrichment as X
from queries import text as T
from queries.report import _IMPACT, findings
from queries.scan import _FUZZY
from queries.views import view
from scanlake.operators import presentation as p
from scanlake.operators import rollup as r
from scanlake.plans.enrichment import Catalogs
from scanlake.plans.lookup import apply_lookup, lookup_requests, lookup_results
from scanlake.plans.structured import structured_report as build
from scanlake.plans.textual import text_chunks
from scanlake.plans.textual import text_report as build_text
from scanlake.tables import catalogs as C
from scanlake.tables import fixed

_BUILT: dict[tuple[str, str], dict] = {}


def _report(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        controls = spark.createDataFrame(X._CONTROLS, "id string, family string, title string")
        catalogs = Catalogs(
            X.cves(spark, sf), X.epss(spark, sf), X._weakness_table(spark), X._patterns(spark),
            C.frameworks(spark), controls)
        _BUILT[key] = build(view(spark, sf, "scan_rows"), catalogs)
    return _BUILT[key]


def structured_report(spark, sf):
    return _report(spark, sf)["findings"].select(
        "report_id", "id", "name", "severity", "cvss", "category", "display_control_name",
        "asset_count", "affected_assets_short", "needs_lookup")


def structured_false_positives(spark, sf):
    return _report(spark, sf)["false_positives"].select("report_id", "id", "name")


def structured_summary(spark, sf):
    rep = _report(spark, sf)
    return rep["quality"].join(r.severity_counts(rep["findings"], ["report_id"]), "report_id").join(
        rep["narrative"].select("report_id", "risk_posture"), "report_id")


def text_report(spark, sf):
    replies = view(spark, sf, "responses").withColumnsRenamed({"conv_id": "doc_id", "turn": "chunk_no"})
    return build_text(replies)["findings"].select("report_id", "id", "name", "severity", "category", "audit_requirement")


def text_chunk_sizes(spark, sf):
    return text_chunks(view(spark, sf, "scan_texts")).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


def lookup_loop(spark, sf):
    """Requests for every finding that needs a look-up, replies for two thirds of them, merged."""
    f = p.fill_missing(findings(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("control_objective", "control_name", "audit_requirement", "business_impact")}))
    f = f.withColumn("item_key", F.concat_ws("-", "report_id", "id"))
    n = F.col("first_row")
    asked = lookup_requests(f)
    result = F.struct(
        F.col("item_key").alias("key"), F.when(n % 2 == 0, F.lit("Keep releases under a tracked plan")).alias("control_objective"),
        F.lit("Tracked Releases").alias("control_name"), F.lit(" loss ").alias("business_impact"),
        F.struct(F.concat(F.lit("Upgrade "), "name").alias("primary"), F.when(n % 4 == 0, F.lit("Limit access")).alias("secondary")).alias("recommendation"))
    raw = F.when(n % 5 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(result).alias("results"))), F.lit("\n```"))).otherwise(F.to_json(result))
    replies = f.filter(n % 3 != 0).join(asked.select("item_key"), "item_key").select(n.alias("reply_no"), raw.alias("raw"))
    merged = apply_lookup(f, lookup_results(replies, asked)["results"])
    return merged.select("report_id", "id", "looked_up", "control_objective", "control_name", "business_impact", "remediation")


def text_quality(spark, sf):
    """Quality and severity counts of the text chain, which ends like the structured one."""
    replies = view(spark, sf, "responses").withColumnsRenamed({"conv_id": "doc_id", "turn": "chunk_no"})
    rep = build_text(replies)
    return rep["quality"].join(r.severity_counts(rep["findings"], ["report_id"]), "report_id").join(
        rep["narrative"].select("report_id", "risk_posture"), "report_id")


QUERIES = {
    "lookup_loop": lookup_loop,
    "text_quality": text_quality,
    "structured_report": structured_report,
    "structured_false_positives": structured_false_positives,
    "structured_summary": structured_summary,
    "text_report": text_report,
    "text_chunk_sizes": text_chunk_sizes,
}

_NAMES = ["name", "severity", "vuln_id", "cve", "cvss2", "description", "remediation", "reference",
          "control_objective", "control_name"]
_FILLED = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in _NAMES)
_HAY = "lower(concat_ws(' ', name, observation, risk_status, coalesce(description, '')))"
_CHAIN = X._BASE.replace(d.PRESENT, d.GROUPED + """,
labelled AS (SELECT *, NULL::VARCHAR AS category FROM grouped)""") + f""",
wt2 AS (SELECT w.*, s.control_objective FROM wt w LEFT JOIN (SELECT cwe_id, control_objective FROM snap UNION ALL SELECT cwe_id, control_objective FROM lrn WHERE cwe_id NOT IN (SELECT cwe_id FROM snap)) s USING (cwe_id)),
fw1 AS (SELECT report_id, id, arg_min(struct_pack(v := control_objective), ord).v AS control_objective, arg_min(control_name, ord) AS control_name FROM wk JOIN wt2 USING (cwe_id) GROUP BY report_id, id),
fc1 AS (SELECT report_id, id, arg_min(cvss, ord) AS c FROM hit GROUP BY report_id, id),
enr AS (SELECT l.* EXCLUDE (category), coalesce(CAST(fc1.c AS VARCHAR), l.cvss) AS cvss2, nullif(control_objective, '') AS control_objective, nullif(control_name, '') AS control_name,
  TRY_CAST(nullif(regexp_extract(coalesce(vuln_id, ''), '([0-9]+)', 1), '') AS BIGINT) AS vk
  FROM labelled l LEFT JOIN fw1 ON fw1.report_id = l.report_id AND fw1.id = l.id LEFT JOIN fc1 ON fc1.report_id = l.report_id AND fc1.id = l.id),
al AS (SELECT report_id, group_name, status_family, string_agg(asset, '|' ORDER BY asset) AS alist FROM assets GROUP BY ALL),
keyed AS (SELECT e.*, CASE WHEN vk IS NOT NULL THEN concat('v', vk) ELSE concat('f', {d.key('name')}, chr(31), coalesce(alist, ''), chr(31), {d.key("coalesce(description, '')")}) END AS gk,
  CASE WHEN vk IS NOT NULL THEN status_family ELSE '' END AS gf, CASE WHEN vk IS NOT NULL THEN {_FILLED} ELSE 0 END AS nf, CASE WHEN vk IS NOT NULL THEN length(coalesce(description, '')) ELSE 0 END AS dl
  FROM enr e LEFT JOIN al USING (report_id, group_name, status_family)),
rk AS (SELECT *, row_number() OVER (PARTITION BY report_id, gk, gf ORDER BY nf DESC, dl DESC, first_row) AS rn FROM keyed),
own AS (SELECT report_id, gk, gf, id AS kept FROM rk WHERE rn = 1),
ka AS (SELECT DISTINCT a.report_id, kept AS id, asset FROM rk JOIN own USING (report_id, gk, gf) JOIN assets a ON a.report_id = rk.report_id AND a.group_name = rk.group_name AND a.status_family = rk.status_family),
kn AS (SELECT report_id, id, any_value(n) AS asset_count, string_agg(asset, ', ' ORDER BY asset) FILTER (r <= 10) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY report_id, id ORDER BY asset) AS r, count(*) OVER (PARTITION BY report_id, id) AS n FROM ka) GROUP BY report_id, id),
ks AS (SELECT report_id, group_name, status_family, count(DISTINCT regexp_extract(asset, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1)) AS nn, min(regexp_extract(asset, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1)) AS net FROM assets GROUP BY ALL),
flag AS (SELECT *, (NOT {d.fp_review(d.key(_HAY))} AND ({d.anyc(_HAY, fixed.FP_TOKENS)} OR {_FUZZY.replace('raw_name', 'name')})) OR lower(trim(risk_status)) IN {d.inlist(fixed.ACCEPTED_RISK)}
   OR trim(coalesce(cvss2, '')) IN {d.inlist(fixed.ZERO_CVSS)} OR lower(trim(observation)) = 'informational' OR severity = 'Informational' AS is_fp FROM rk WHERE rn = 1)"""
_AUDIT_HAY = "lower(concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(control_name, ''), coalesce(remediation, '')))"
# the findings that stay, as the quality score reads them
_FINAL = f"""{_CHAIN},
fin AS (SELECT f.report_id, f.id, f.severity, f.name, f.description, {d.sq(d.oe('f.remediation'))} AS remediation, f.control_objective, f.control_name, f.cvss2, f.reference,
  CASE WHEN nn = 1 THEN concat('Internal Network - ', net, '.0/24') ELSE 'Internal Network - Multiple Subnets' END AS category
  FROM flag f JOIN ks ON ks.report_id = f.report_id AND ks.group_name = f.group_name AND ks.status_family = f.status_family WHERE NOT is_fp),
sc0 AS (SELECT id AS doc_id, report_id AS source, description, nullif(remediation, '') AS remediation, control_objective, control_name, cvss2 AS cvss, reference,
  coalesce({d.first_keyword(_AUDIT_HAY, fixed.AUDIT_KEYWORDS)}, CASE WHEN remediation <> '' THEN concat({d.lit(fixed.AUDIT_PREFIX)}, regexp_extract(remediation, '^(.*?[.!?])(?:\\s|$)', 1)) END, '') AS audit_requirement FROM fin){X._SCORED.removeprefix(X._SC).replace('scored AS (', 'rated AS (')},
qs AS (SELECT source AS report_id, count(*) AS count, round(avg(overall), 3) AS mean, round(1 - count(*) FILTER (overall < 0.55) / count(*)::DOUBLE, 3) AS pass_rate, count(*) FILTER (overall < 0.55) AS failing FROM rated GROUP BY source),
th AS (SELECT report_id, {d.category_words('category')} AS theme, count(*) AS n, min({d.lookup('severity', fixed.NARRATIVE_RANK, '5')}) AS best FROM fin GROUP BY ALL),
ph AS (SELECT report_id, string_agg(theme, ' and ' ORDER BY place) AS theme_phrase FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, best, theme) AS place FROM th) WHERE place <= 2 GROUP BY report_id),
tot AS (SELECT report_id, {d.COUNTS}, {d.TOTAL} FROM fin GROUP BY report_id)"""

_LOOKED = f"""{d.PRESENT}, lk AS (SELECT *, first_row % 3 <> 0 AS hit, {_IMPACT} AS bi,
  CASE WHEN first_row % 3 <> 0 AND first_row % 2 = 0 THEN 'Keep releases under a tracked plan' END AS n_obj,
  CASE WHEN first_row % 3 <> 0 THEN 'loss' END AS n_bi,
  CASE WHEN first_row % 3 <> 0 THEN concat('Upgrade ', trim(name), CASE WHEN first_row % 4 = 0 THEN concat(chr(10), 'Limit access') ELSE '' END) END AS n_rem FROM labelled)"""

ORACLE = {
    "lookup_loop": d.q(_LOOKED, f"""SELECT report_id, id, hit AS looked_up, n_obj AS control_objective, CASE WHEN hit THEN 'Tracked Releases' END AS control_name,
      {X._merge('bi', 'n_bi')} AS business_impact, {X._merge('remediation', 'n_rem')} AS remediation FROM lk"""),
    "text_quality": f"""WITH {d.REPLIES}, ok AS (SELECT * FROM responses JOIN conversations USING (conv_id, turn) WHERE turn % 7 <> 3),
      it AS (SELECT conv_id, concat(role, ' issue') AS name, 'High' AS severity FROM ok UNION ALL SELECT conv_id, concat('turn ', turn), 'Low' FROM ok),
      n AS (SELECT conv_id AS report_id, count(DISTINCT name) AS count, count(DISTINCT name) FILTER (severity = 'High') AS total_high, count(DISTINCT name) FILTER (severity = 'Low') AS total_low FROM it GROUP BY conv_id)
      SELECT report_id, count, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS pass_rate, count AS failing, 0 AS total_critical, total_high, 0 AS total_medium, total_low, count AS total_findings,
       concat('The current risk posture remains elevated because ', total_high, ' high-severity finding', CASE WHEN total_high <> 1 THEN 's' ELSE '' END, ' require prioritised remediation, concentrated in Network Infrastructure.') AS risk_posture FROM n""",
    "structured_summary": d.q(_FINAL, """SELECT report_id, count, mean, pass_rate, failing, total_critical, total_high, total_medium, total_low, total_findings,
      CASE WHEN total_critical > 0 THEN concat('The current risk posture remains elevated because ', total_critical, ' critical finding', CASE WHEN total_critical <> 1 THEN 's' ELSE '' END, ' require immediate remediation, concentrated in ', theme_phrase, '.')
       WHEN total_high > 0 THEN concat('The current risk posture remains elevated because ', total_high, ' high-severity finding', CASE WHEN total_high <> 1 THEN 's' ELSE '' END, ' require prioritised remediation, concentrated in ', theme_phrase, '.')
       ELSE concat('The current risk posture is driven primarily by medium- and low-severity findings with the strongest concentration in ', theme_phrase, ' that should be addressed through planned remediation.') END AS risk_posture
      FROM qs JOIN tot USING (report_id) JOIN ph USING (report_id)"""),
    "structured_report": d.q(_CHAIN, """SELECT f.report_id, f.id, name, severity, cvss2 AS cvss, CASE WHEN nn = 1 THEN concat('Internal Network - ', net, '.0/24') ELSE 'Internal Network - Multiple Subnets' END AS category,
      coalesce(control_name, 'Vulnerability Remediation') AS display_control_name, kn.asset_count, CASE WHEN kn.asset_count <= 10 THEN shown ELSE concat(shown, ', … and ', kn.asset_count - 10, ' more') END AS affected_assets_short, TRUE AS needs_lookup
      FROM flag f JOIN kn ON kn.report_id = f.report_id AND kn.id = f.id JOIN ks ON ks.report_id = f.report_id AND ks.group_name = f.group_name AND ks.status_family = f.status_family WHERE NOT is_fp"""),
    "structured_false_positives": d.q(_CHAIN, "SELECT report_id, id, name FROM flag WHERE is_fp"),
    "text_chunk_sizes": d.q(T._CHUNKED, "SELECT doc_id, count(*) AS chunks, sum(length(chunk)) AS chars FROM allch GROUP BY doc_id"),
    "text_report": d.q(
        f"""{d.REPLIES}, ok AS (SELECT * FROM responses JOIN conversations USING (conv_id, turn) WHERE turn % 7 <> 3),
        it AS (SELECT conv_id, turn, 0 AS item, concat(role, ' issue') AS name, 'High' AS severity FROM ok UNION ALL SELECT conv_id, turn, 1, concat('turn ', turn), 'Low' FROM ok),
        dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(name) ORDER BY turn, item) AS rn FROM it) WHERE rn = 1)""",
        """SELECT CAST(conv_id AS BIGINT) AS report_id, format('VAPT-{:03d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn, item)) AS id, name, severity,
         'Network Infrastructure' AS category, '' AS audit_requirement FROM dd"""),
}
