"""Queries over findings: roll-ups, outline, numbering, narrative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import duck as d
from queries.views import lit, view
from scanlake.functions import derive as D
from scanlake.operators import grouping as g
from scanlake.operators import presentation as p
from scanlake.operators import rollup as r
from scanlake.session import stable, staged
from scanlake.tables import fixed

_BUILT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def findings_and_assets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Presented findings of a scan and their asset table.

    Built once per session and folder and kept as a checkpoint, the way a report job
    would keep its findings table for the roll-ups that follow.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        rows = staged(g.candidate_rows(view(spark, sf, "scan_rows")), "candidates")
        assets = staged(g.finding_assets(rows), "finding_assets")
        findings = stable(g.with_assets(g.group_findings(rows), g.asset_summary(assets)))
        with_own = g.assign_ids(findings).withColumn("category", F.expr(d.CATEGORY_CASE))
        shown = p.with_category(with_own, p.subnet_summary(assets))
        _BUILT[key] = (stable(p.with_taxonomy(p.with_display_title(shown))), assets)
    return _BUILT[key]


def findings(spark, sf) -> DataFrame:
    return findings_and_assets(spark, sf)[0]


def report_subnets(assets: DataFrame) -> DataFrame:
    return p.asset_subnets(assets).select("report_id", "subnet")


def severity_counts(spark, sf):
    return r.severity_counts(findings(spark, sf), ["report_id"], informational=True)


def report_metadata(spark, sf):
    f, a = findings_and_assets(spark, sf)
    return r.report_metadata(f, report_subnets(a))


def report_networks(spark, sf):
    return r.report_networks(report_subnets(findings_and_assets(spark, sf)[1]))


def short_metadata(spark, sf):
    """The scope sentence with three networks named and the others counted."""
    f, a = findings_and_assets(spark, sf)
    return r.report_metadata(f, report_subnets(a), named=3).select("report_id", "subnet_count", "scope_summary")


def scope_subnets(spark, sf):
    return r.scope_subnets(findings(spark, sf))


def subnet_rollup(spark, sf):
    return (
        findings(spark, sf)
        .groupBy("report_id", "category", "taxonomy_family", "taxonomy_label", "subnet_key",
                 "subnet_label")
        .agg(F.count("*").alias("n"), F.sum("asset_count").alias("assets"))
    )


def outline_groups(spark, sf):
    """The groups in order, the ids of each in outline order."""
    groups = r.outline_groups(findings(spark, sf))
    return groups.withColumn("finding_ids", F.array_join("finding_ids", ",")).orderBy(
        "report_id", "taxonomy_family", "subnet_key")


def outline_members(spark, sf):
    return r.outline_members(findings(spark, sf))


def dominant_themes(spark, sf):
    return r.dominant_themes(findings(spark, sf))


def risk_posture(spark, sf):
    facts = r.report_facts(findings(spark, sf))
    return r.narrative(facts).select(
        "report_id", "family_count", "subnet_group_count", "group_count", "theme_phrase",
        "risk_posture", "objective_1", "objective_2", "objective_3", "introduction_overview",
    )


def report_numbering(spark, sf):
    n = r.number_report(findings(spark, sf))
    return p.summary_table(n).join(
        n.select("report_id", "seq", "id", "group_no", "group_start", "new_heading", "page_break"),
        ["report_id", "seq"],
    )


def fallback_order(spark, sf):
    return r.fallback_order(findings(spark, sf)).select(
        "report_id", "place", "id", "group_a", "group_b", "group_first"
    )


def outline_order(spark, sf):
    return (
        findings(spark, sf)
        .select("report_id", "id", "severity", "display_title",
                p.severity_rank(F.col("severity")).alias("rank"))
        .orderBy("report_id", *r.outline_key())
    )


def _stated_groups(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An outline as another run stated it: by severity, ids listed for two groups only."""
    groups = (
        f.groupBy("report_id", "taxonomy_family", "subnet_key")
        .agg(F.min("first_row").alias("group_pos"))
        .withColumn("subnet_key", F.when(F.col("group_pos") % 3 == 0, F.lit(""))
                    .otherwise(F.col("subnet_key")))
    )
    members = f.filter(F.col("severity").isin("Critical", "High")).join(
        f.groupBy("report_id").agg(F.min("first_row").alias("_r")), "report_id"
    ).select("report_id", F.col("_r").alias("group_pos"), "id")
    return groups, members


def group_assignment(spark, sf):
    f = findings(spark, sf)
    groups, members = _stated_groups(f)
    return r.assign_to_groups(f, groups, members).select("report_id", "id", "group_pos")


def finding_cards(spark, sf):
    n = r.number_report(findings(spark, sf))
    filled = p.fill_missing(n)
    return p.finding_cards(filled)


def value_counts(spark, sf):
    rows = view(spark, sf, "scan_rows")
    return r.value_counts(rows, ["severity", "risk_status", "observation", "port"])


def required_fields(spark, sf):
    filled = p.fill_missing(findings(spark, sf))
    return p.missing_required(filled).select(
        "report_id", "id", F.array_join("missing_fields", ", ").alias("missing_fields")
    )


def fill_required(spark, sf):
    return p.fill_required(findings(spark, sf)).select(
        "report_id", *p.REPORT_DEFAULTS
    )


def needs_lookup(spark, sf):
    return p.fill_missing(findings(spark, sf)).select(
        "report_id", "id", "business_impact", "description", "needs_lookup"
    )


def missing_fields(spark, sf):
    return p.missing_field_report(
        findings(spark, sf), ["description", "remediation", "cve", "reference"], ["report_id"]
    )


def validate_report(spark, sf):
    base = findings(spark, sf).withColumns({
        "severity": F.when(F.col("first_row") % 3 == 0, F.lit("")).when(
            F.col("first_row") % 7 == 0, F.lit("unknown")).otherwise(F.col("severity")),
        "cvss": F.when(F.col("first_row") % 2 == 0, F.col("cvss")),
        "audit_requirement": F.when(F.col("first_row") % 5 == 0, F.lit("Review quarterly.")),
        "control_name": F.lit(None).cast("string"),
    })
    return p.validate_findings(base).select(
        "report_id", "id", "severity", "audit_requirement", "proof_of_concept"
    )


def report_overrides(spark, sf):
    """Front-matter overrides win where they are filled."""
    from scanlake.plans.report import apply_overrides, front_matter

    facts = r.narrative(r.report_facts(findings(spark, sf)))
    overrides = facts.select(
        "report_id",
        F.when(F.col("report_id") == "1", F.lit("  Stated overview  ")).otherwise(F.lit("[PLACEHOLDER]"))
        .alias("introduction_overview"),
        F.when(F.col("report_id").isin("2", "3"), F.lit("- First goal\n* Second goal\n\n"))
        .alias("objectives"),
    )
    return front_matter(apply_overrides(facts, overrides)).select(
        "report_id", "executive_summary", "objectives"
    )


def lookup_decision(spark, sf):
    """Whether a look-up is needed, for findings whose fields are full, thin, stock or missing by turns."""
    n = F.col("first_row")
    f = findings(spark, sf).select("report_id", "id", "description", "remediation", "first_row").withColumns({
        "remediation": F.when(n % 2 == 0, F.concat(F.lit("Upgrade the component to the fixed release." + chr(10) + "Restrict access to it. "), F.coalesce("remediation", F.lit("")))).otherwise(F.col("remediation")),
        "control_objective": F.when(n % 5 > 0, F.lit(LONG_OBJECTIVE)).when(n % 10 == 0, F.lit("Short one.")),
        "control_name": F.when(n % 7 > 0, F.lit("Software Release Tracking")).when(n % 2 == 0, F.lit(STOCK_NAME)).otherwise(F.lit(" ")),
        "audit_requirement": F.when(n % 11 > 0, F.lit(LONG_AUDIT)).otherwise(F.lit("[PLACEHOLDER]")),
        "reference": F.when(n % 13 > 0, F.lit("https://nvd.nist.gov/vuln/detail/CVE-2021-44228")),
    })
    return f.select("report_id", "id", D.needs_enrichment(*[F.col(c) for c in _LOOKED_AT]).alias("needs_lookup"))


_LOOKED_AT = ["description", "remediation", "control_objective", "control_name", "audit_requirement", "reference"]
STOCK_NAME = fixed.GENERIC_VALUES["control_name"][0]
LONG_OBJECTIVE = "Keep every component at a supported release with a tracked owner and a dated plan for its replacement."
LONG_AUDIT = "Verify that releases are checked monthly against public advisories and that exceptions have an owner."


QUERIES = {
    "severity_counts": severity_counts,
    "report_metadata": report_metadata,
    "report_networks": report_networks,
    "short_metadata": short_metadata,
    "scope_subnets": scope_subnets,
    "subnet_rollup": subnet_rollup,
    "outline_groups": outline_groups,
    "outline_members": outline_members,
    "outline_order": outline_order,
    "dominant_themes": dominant_themes,
    "risk_posture": risk_posture,
    "report_numbering": report_numbering,
    "finding_cards": finding_cards,
    "fallback_order": fallback_order,
    "group_assignment": group_assignment,
    "value_counts": value_counts,
    "required_fields": required_fields,
    "fill_required": fill_required,
    "needs_lookup": needs_lookup,
    "lookup_decision": lookup_decision,
    "missing_fields": missing_fields,
    "validate_report": validate_report,
    "report_overrides": report_overrides,
}

_OUT = "sev_rank DESC, title_key, id_key"
_GRP = "report_id, taxonomy_family, subnet_key"

_GROUPS = f"""ogroups AS (SELECT {_GRP}, arg_min(taxonomy_label, row(-sev_rank, title_key, id_key)) AS taxonomy_label,
  arg_min(subnet_label, row(-sev_rank, title_key, id_key)) AS subnet_label,
  arg_min(severity, row(-sev_rank, title_key, id_key)) AS highest_severity, count(*) AS finding_count
 FROM labelled GROUP BY {_GRP})"""

_THEMES = """themes AS (SELECT report_id, taxonomy_label AS theme, count(*) AS theme_count, min(narr_rank) AS best_rank,
  row_number() OVER (PARTITION BY report_id ORDER BY count(*) DESC, min(narr_rank), taxonomy_label) AS place
 FROM labelled GROUP BY report_id, taxonomy_label)"""

_FACTS = f"""{d.PRESENT}, {_GROUPS}, {_THEMES},
phrases AS (SELECT report_id, string_agg(theme, ' and ' ORDER BY place) AS theme_phrase FROM themes WHERE place <= 2 GROUP BY report_id),
gno AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY taxonomy_family, subnet_key) AS gn FROM ogroups),
drv AS (SELECT report_id, string_agg(taxonomy_label, ', ' ORDER BY gn) FILTER (gn <= 3) AS drivers, count(*) AS group_count FROM gno GROUP BY report_id),
facts AS (SELECT l.report_id, count(*) AS rows, {d.COUNTS}, count(DISTINCT taxonomy_family) AS family_count,
  count(DISTINCT subnet_key) AS subnet_group_count FROM labelled l GROUP BY l.report_id),
narr AS (SELECT f.*, theme_phrase, drivers, group_count,
  CASE WHEN total_critical > 0 THEN concat('The current risk posture remains elevated because ', total_critical, ' critical finding', CASE WHEN total_critical <> 1 THEN 's' ELSE '' END, ' require immediate remediation, concentrated in ', theme_phrase, '.')
   WHEN total_high > 0 THEN concat('The current risk posture remains elevated because ', total_high, ' high-severity finding', CASE WHEN total_high <> 1 THEN 's' ELSE '' END, ' require prioritised remediation, concentrated in ', theme_phrase, '.')
   ELSE concat('The current risk posture is driven primarily by medium- and low-severity findings with the strongest concentration in ', theme_phrase, ' that should be addressed through planned remediation.') END AS risk_posture,
  CASE WHEN total_critical > 0 THEN concat('Contain and remediate the ', total_critical, ' critical finding', CASE WHEN total_critical <> 1 THEN 's' ELSE '' END, ' driving risk in ', theme_phrase, '.')
   WHEN total_high > 0 THEN concat('Prioritise the ', total_high, ' high-severity finding', CASE WHEN total_high <> 1 THEN 's' ELSE '' END, ' driving risk in ', theme_phrase, '.')
   ELSE concat('Sequence planned remediation for the ', rows, ' confirmed medium- and low-severity finding', CASE WHEN rows <> 1 THEN 's' ELSE '' END, ' across ', theme_phrase, '.') END AS objective_1,
  concat('Coordinate remediation workstreams around ', theme_phrase, ' while tracking progress across ', family_count, ' taxonomy ', CASE WHEN family_count = 1 THEN 'family' ELSE 'families' END, ' and ', subnet_group_count, ' subnet group', CASE WHEN subnet_group_count <> 1 THEN 's' ELSE '' END, '.') AS objective_2,
  {d.lit(fixed.TRACE_OBJECTIVE)} AS objective_3,
  concat('The validated assessment identified ', rows, ' confirmed finding', CASE WHEN rows <> 1 THEN 's' ELSE '' END, ' across ', group_count, ' grouped remediation workstream', CASE WHEN group_count <> 1 THEN 's' ELSE '' END, '.') AS context
 FROM facts f JOIN phrases USING (report_id) JOIN drv USING (report_id)),
narr2 AS (SELECT *, concat(context, ' ', risk_posture, ' Primary remediation drivers include ', drivers, '.') AS introduction_overview FROM narr)"""

_IMPACT = f"replace({d.lookup('severity', fixed.IMPACT_TEMPLATES, d.lit(fixed.IMPACT_TEMPLATES['Medium']))}, '{{name}}', name)"
_SENTENCES = "regexp_split_to_array(regexp_replace(poc, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_FILLED = f"""{d.PRESENT},
poc AS (SELECT *, {d.sq(d.oe('proof_of_concept'))} AS poc, {_IMPACT} AS business_impact FROM labelled),
filled AS (SELECT * EXCLUDE (description), CASE WHEN {d.placeholder('description')} AND length(poc) > 50
   THEN coalesce(nullif(array_to_string(list_filter({_SENTENCES}[1:3], lambda s: length(s) > 20), ' '), ''), description) ELSE description END AS description FROM poc)"""


_SEQ = f"""{d.PRESENT}, {_GROUPS},
gno AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY taxonomy_family, subnet_key) AS group_no,
  lag(taxonomy_label) OVER (PARTITION BY report_id ORDER BY taxonomy_family, subnet_key) AS prior FROM ogroups),
seqs AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY taxonomy_family, subnet_key, {_OUT}) AS seq,
  row_number() OVER (PARTITION BY {_GRP} ORDER BY {_OUT}) AS in_group FROM labelled)"""

def _ids(x: str, pattern: str) -> str:
    hits = f"list_transform(regexp_extract_all({x}, '{pattern}'), lambda v: regexp_replace(upper(v), '\\s+', '-', 'g'))"
    return f"list_filter({hits}, lambda v, i: list_position({hits}, v) = i)"


ORACLE = {
    "severity_counts": d.q(d.PRESENT, f"SELECT report_id, {d.COUNTS}, count(*) FILTER (severity = 'Informational') AS total_informational, {d.TOTAL} FROM findings GROUP BY report_id"),
    "report_metadata": d.q(
        d.PRESENT + ", nets AS (SELECT report_id, count(DISTINCT subnet) AS subnet_count, string_agg(DISTINCT subnet, ', ' ORDER BY subnet) AS nets FROM fsubnets GROUP BY report_id)",
        f"""SELECT *, concat('A vulnerability assessment and penetration test was conducted on the internal network infrastructure. The assessment identified a total of ', total_findings, ' unique vulnerabilities: ', total_critical, ' Critical, ', total_high, ' High, ', total_medium, ' Medium, and ', total_low, ' Low. Several critical and high-severity findings require immediate remediation to mitigate risk of unauthorized access and data compromise.') AS executive_summary
        FROM (SELECT report_id, {d.COUNTS}, {d.TOTAL} FROM findings GROUP BY report_id) JOIN (SELECT report_id, subnet_count,
         concat('As a part of the internal VAPT engagement, the assessment covered the network subnets ', nets, '. The testing approach included automated vulnerability scanning and manual verification of findings. The objective was to identify exploitable vulnerabilities in the internal infrastructure and provide actionable remediation guidance.') AS scope_summary FROM nets) USING (report_id)"""),
    "report_networks": d.q(d.PRESENT, "SELECT DISTINCT report_id, subnet FROM fsubnets WHERE subnet IS NOT NULL"),
    "short_metadata": d.q(d.PRESENT, f"""SELECT report_id, subnet_count, concat({lit(fixed.SCOPE_SUMMARY.split('%s')[0])}, array_to_string(nets[1:3], ', '),
      CASE WHEN subnet_count > 3 THEN concat(', … and ', subnet_count - 3, ' more') ELSE '' END, {lit(fixed.SCOPE_SUMMARY.split('%s')[1])}) AS scope_summary
      FROM (SELECT report_id, count(DISTINCT subnet) AS subnet_count, list_sort(list(DISTINCT subnet)) AS nets FROM fsubnets GROUP BY report_id)"""),
    "scope_subnets": d.q(
        d.PRESENT + r", seen AS (SELECT report_id, first_row, generate_subscripts(c, 1) AS i, unnest(c) AS subnet FROM (SELECT report_id, first_row, regexp_extract_all(category, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:/[0-9]{1,2})?\b') AS c FROM findings))",
        "SELECT report_id, subnet, row_number() OVER (PARTITION BY report_id ORDER BY min(row(first_row, i)), subnet) AS place FROM seen GROUP BY report_id, subnet"),
    "subnet_rollup": d.q(d.PRESENT, "SELECT report_id, category, taxonomy_family, taxonomy_label, subnet_key, subnet_label, count(*) AS n, sum(asset_count) AS assets FROM labelled GROUP BY ALL"),
    "outline_groups": d.q(f"{d.PRESENT}, {_GROUPS}", f"""SELECT * FROM ogroups JOIN (SELECT {_GRP}, string_agg(id, ',' ORDER BY {_OUT}) AS finding_ids FROM labelled GROUP BY {_GRP}) USING ({_GRP})
      ORDER BY {_GRP}"""),
    "outline_members": d.q(d.PRESENT, f"SELECT {_GRP}, row_number() OVER (PARTITION BY {_GRP} ORDER BY {_OUT}) AS place, id FROM labelled"),
    "outline_order": d.q(d.PRESENT, f"SELECT report_id, id, severity, display_title, sev_rank AS rank FROM labelled ORDER BY report_id, {_OUT}"),
    "dominant_themes": d.q(f"{d.PRESENT}, {_THEMES}", "SELECT report_id, theme, theme_count, best_rank, place FROM themes WHERE place <= 2"),
    "risk_posture": d.q(_FACTS, "SELECT report_id, family_count, subnet_group_count, group_count, theme_phrase, risk_posture, objective_1, objective_2, objective_3, introduction_overview FROM narr2"),
    "report_numbering": d.q(_SEQ, f"""SELECT report_id, seq, CASE WHEN s.taxonomy_label = s.subnet_label THEN s.taxonomy_label ELSE concat(s.taxonomy_label, ' / ', s.subnet_label) END AS group_label,
      severity, display_title AS title, {d.lookup("lower(trim(remediation_status))", fixed.STATUS_DISPLAY, 'upper(remediation_status)')} AS status, observation,
      coalesce(affected_assets_short, '[INSUFFICIENT DATA]') AS assets, id, group_no, in_group = 1 AS group_start,
      in_group = 1 AND g.taxonomy_label IS DISTINCT FROM prior AS new_heading, seq > 1 AS page_break
      FROM seqs s JOIN gno g USING ({_GRP})"""),
    "finding_cards": d.q(_FILLED + f""",
     seqs AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY taxonomy_family, subnet_key, {_OUT}) AS seq,
       concat_ws(' ', coalesce(cve, ''), coalesce(category, ''), coalesce(description, '')) AS blob FROM filled),
     cards AS (SELECT *, list_concat({_ids('blob', '(?i)CVE[-\\s]?[0-9]{4}[-\\s]?[0-9]{4,7}')}, {_ids('blob', '(?i)CWE[-\\s]?[0-9]{1,5}')}) AS found FROM seqs)""",
     f"""SELECT report_id, seq, coalesce(affected_assets_short, '[INSUFFICIENT DATA]') AS assets, display_title AS title, severity,
      {d.lookup("lower(trim(remediation_status))", fixed.STATUS_DISPLAY, 'upper(remediation_status)')} AS status,
      concat(coalesce(description, ''), chr(10), business_impact) AS impact,
      CASE WHEN len(found) = 0 THEN 'N/A' ELSE array_to_string(found, ', ') END AS cve_cwe,
      '' AS control_objective, '' AS control_name, '' AS audit_requirement, {d.sq(d.oe('remediation'))} AS recommendation,
      coalesce(reference, '') AS reference, observation FROM cards"""),
    "fallback_order": d.q(d.PRESENT, f"""SELECT report_id, place, id, group_a, group_b, min(place) OVER (PARTITION BY report_id, group_a, group_b) AS group_first FROM (
      SELECT report_id, id, taxonomy_family AS group_a, subnet_key AS group_b, row_number() OVER (PARTITION BY report_id ORDER BY
       {d.lookup('severity', fixed.RENDER_RANK, '3')}, category, display_title, id) AS place FROM labelled)"""),
    "group_assignment": d.q(d.PRESENT + """,
      sg AS (SELECT report_id, taxonomy_family, CASE WHEN min(first_row) % 3 = 0 THEN '' ELSE subnet_key END AS subnet_key, min(first_row) AS group_pos FROM labelled GROUP BY report_id, taxonomy_family, labelled.subnet_key),
      lead_group AS (SELECT report_id, min(first_row) AS group_pos FROM labelled GROUP BY report_id),
      empties AS (SELECT sg.* FROM sg WHERE NOT EXISTS (SELECT 1 FROM lead_group l JOIN labelled f USING (report_id) WHERE l.report_id = sg.report_id AND l.group_pos = sg.group_pos AND f.severity IN ('Critical','High'))),
      listed AS (SELECT f.report_id, f.id, l.group_pos FROM labelled f JOIN lead_group l USING (report_id) WHERE f.severity IN ('Critical','High'))""",
      """SELECT f.report_id, f.id, least((SELECT min(group_pos) FROM listed l WHERE l.report_id = f.report_id AND l.id = f.id),
       (SELECT min(group_pos) FROM empties e WHERE e.report_id = f.report_id AND e.taxonomy_family IN ('', f.taxonomy_family) AND e.subnet_key IN ('', f.subnet_key))) AS group_pos FROM labelled f"""),
    "value_counts": d.q(d.SCAN, "SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value FROM scan_rows" for c in ("severity", "risk_status", "observation", "port")) + ") GROUP BY field, value"),
    "required_fields": d.q(_FILLED, f"""SELECT report_id, id, array_to_string(gaps, ', ') AS missing_fields FROM (SELECT report_id, id,
      list_filter([{', '.join((f"CASE WHEN {d.placeholder(c)} THEN '{c}' END" if c not in ('control_objective', 'control_name', 'audit_requirement') else f"'{c}'") for c in fixed.REQUIRED_SOURCE_FIELDS)}], lambda x: x IS NOT NULL) AS gaps FROM filled) WHERE len(gaps) > 0"""),
    "fill_required": d.q(d.PRESENT, "SELECT report_id, " + ", ".join(
        (f"'[PLACEHOLDER]' AS {c}" if c in ("business_impact", "control_objective", "control_name", "audit_requirement")
         else f"coalesce(nullif({c}, ''), '[PLACEHOLDER]') AS {c}")
        for c in p.REPORT_DEFAULTS) + " FROM labelled"),
    # Scan findings carry no control fields yet, so every one of them needs a look-up.
    "needs_lookup": d.q(_FILLED, "SELECT report_id, id, business_impact, description, TRUE AS needs_lookup FROM filled"),
    "lookup_decision": d.q(d.PRESENT + f""", full_ AS (SELECT report_id, id, description,
      CASE WHEN first_row % 2 = 0 THEN concat('Upgrade the component to the fixed release.', chr(10), 'Restrict access to it. ', coalesce(remediation, '')) ELSE remediation END AS remediation,
      CASE WHEN first_row % 5 > 0 THEN {lit(LONG_OBJECTIVE)} WHEN first_row % 10 = 0 THEN 'Short one.' END AS control_objective,
      CASE WHEN first_row % 7 > 0 THEN 'Software Release Tracking' WHEN first_row % 2 = 0 THEN {lit(STOCK_NAME)} ELSE ' ' END AS control_name,
      CASE WHEN first_row % 11 > 0 THEN {lit(LONG_AUDIT)} ELSE '[PLACEHOLDER]' END AS audit_requirement,
      CASE WHEN first_row % 13 > 0 THEN 'https://nvd.nist.gov/vuln/detail/CVE-2021-44228' END AS reference FROM labelled)""",
      "SELECT report_id, id, " + " OR ".join(
        f"{d.placeholder(c)} OR {d.sq(d.oe(c))} IN {d.inlist(fixed.GENERIC_VALUES.get(c, ['']))} OR length({d.sq(d.oe(c))}) < {max(1, fixed.LOOKUP_MIN_LEN.get(c, 0))}" for c in _LOOKED_AT)
      + f" OR len(list_filter(string_split({d.sq(d.oe('remediation'))}, chr(10)), lambda x: {d.sq('x')} <> '')) < 2 OR ({d.anyc('lower(coalesce(remediation, chr(32)))', fixed.GENERIC_REMEDIATION)} AND length({d.sq(d.oe('remediation'))}) < 120) AS needs_lookup FROM full_"),
    "missing_fields": d.q(d.PRESENT, " UNION ALL ".join(
        f"SELECT report_id, '{c}' AS field, count(*) FILTER ({d.placeholder(c)}) AS missing FROM labelled GROUP BY report_id"
        for c in ("description", "remediation", "cve", "reference"))),
    "validate_report": d.q(d.PRESENT + f""",
      base AS (SELECT * EXCLUDE (severity, cvss), CASE WHEN first_row % 3 = 0 THEN '' WHEN first_row % 7 = 0 THEN 'unknown' ELSE severity END AS sev0,
        CASE WHEN first_row % 2 = 0 THEN cvss END AS cvss, CASE WHEN first_row % 5 = 0 THEN 'Review quarterly.' END AS audit0 FROM labelled),
      b2 AS (SELECT *, {d.number('cvss')} AS score, {d._HAY} AS hay,
        lower(concat_ws(' ', name, coalesce(description, ''), '', coalesce(remediation, ''))) AS ahay FROM base)""",
      f"""SELECT report_id, id, coalesce({d.lookup('lower(trim(sev0))', fixed.REPORT_SEVERITY)},
        CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score >= 0.1 THEN 'Low' WHEN score IS NOT NULL THEN 'Informational' END,
        {d.first_keyword('hay', [(w, s) for s, w in fixed.SEVERITY_KEYWORDS])}, nullif(sev0, ''), 'Medium') AS severity,
        CASE WHEN audit0 IS NOT NULL THEN audit0 ELSE coalesce({d.first_keyword('ahay', fixed.AUDIT_KEYWORDS)},
          CASE WHEN remediation IS NOT NULL THEN concat({d.lit(fixed.AUDIT_PREFIX)}, regexp_extract(remediation, '^(.*?[.!?])(?:\\s|$)', 1)) END, '') END AS audit_requirement,
        NULL AS proof_of_concept FROM b2"""),
    "report_overrides": d.q(_FACTS, """SELECT report_id, CASE WHEN report_id = '1' THEN 'Stated overview' ELSE introduction_overview END AS executive_summary,
      CASE WHEN report_id IN ('2','3') THEN 'First goal. Second goal.' ELSE concat_ws(' ', objective_1, objective_2, objective_3) END AS objectives FROM narr2"""),
}
