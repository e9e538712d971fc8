"""Queries over scan rows: normalisation, grouping, de-duplication, false positives."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import duck as d
from queries.views import view
from scanlake.functions import severity as S
from scanlake.functions.text import key_text
from scanlake.functions.titles import family_and_title, version_lt
from scanlake.operators import dedupe as dd
from scanlake.operators import falsepos as fp
from scanlake.operators import grouping as g
from scanlake.operators import names as nm
from scanlake.operators import rollup as r
from scanlake.operators.keywords import keyword_join, rule_hits
from scanlake.session import stable
from scanlake.sources.scans import resolve_columns, union_scans
from scanlake.tables import fixed


def scan(spark, sf):
    return view(spark, sf, "scan_rows")


FINDING_COLS = [
    "report_id", "id", "group_name", "status_family", "name", "severity", "observation",
    "remediation_status", "risk_status", "vuln_id", "description", "remediation",
    "proof_of_concept", "cve", "cvss", "reference", "first_row", "row_count", "asset_count",
    "affected_assets_short",
]


def group_findings(spark, sf):
    findings, _ = g.findings_from_scan(scan(spark, sf))
    return findings.select(*FINDING_COLS)


def finding_assets(spark, sf):
    return g.finding_assets(g.candidate_rows(scan(spark, sf)))


def scan_normalise(spark, sf):
    renamed = scan(spark, sf).withColumnsRenamed({"name": " Plugin Name ", "severity": "Risk",
                                                  "remediation": "Solution",
                                                  "remediation_status": "Finding Status",
                                                  "risk_status": "Disposition",
                                                  "plugin_output": "Plugin Output"})
    rows = g.title_rows(g.normalise_rows(resolve_columns(renamed)))
    return rows.select(
        "row_id", "report_id", "raw_name", "severity", "vuln_id", "cve", "cvss", "asset",
        "observation", "remediation_status", "risk_status", "status_family",
        S.severity_rank(F.col("severity")).alias("severity_rank"),
        S.narrative_rank(F.col("severity")).alias("narrative_rank"),
        S.severity_canonical(F.col("severity")).alias("canonical"),
        S.severity_color(F.col("severity")).alias("color"),
        S.status_display(F.col("remediation_status")).alias("status"),
    )


def title_grouping(spark, sf):
    rows = g.normalise_rows(scan(spark, sf)).withColumn("_lower", key_text(F.col("raw_name")))
    return rows.withColumn(
        "_t", family_and_title(F.col("_lower"), F.col("raw_name"), F.col("proof_of_concept"))
    ).groupBy(F.col("_t.key").alias("group_name"), F.col("_t.title").alias("title")).agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"),
    )


def version_check(spark, sf):
    v = F.regexp_extract(F.col("plugin_output"), "([0-9][0-9.]+)", 1)
    return scan(spark, sf).select("row_id", v.alias("version"),
                                  version_lt(v, "1.17.7").alias("older"))


def drop_informational(spark, sf):
    return g.candidate_rows(scan(spark, sf)).select("row_id", "group_name", "severity")


def _flagged(spark, sf):
    rows = g.title_rows(g.normalise_rows(scan(spark, sf)))
    return fp.flag_false_positives(rows.withColumn("name", F.col("raw_name")))


def false_positive_split(spark, sf):
    return _flagged(spark, sf).select("row_id", "is_fp")


def severity_resolve(spark, sf):
    base = scan(spark, sf).withColumns({
        "sev": F.when(F.col("row_id") % 3 == 0, F.lit("")).when(
            F.col("row_id") % 5 == 0, F.lit("weird")).otherwise(F.col("severity")),
        "cvss": F.when(F.col("row_id") % 2 == 0, F.col("cvss")),
    })
    rules = spark.createDataFrame(
        [(i, w, label) for i, (label, w) in enumerate((label, w) for label, ws in fixed.SEVERITY_KEYWORDS for w in ws)],
        "ordinal int, keyword string, label string")
    hay = F.lower(F.concat_ws(" ", F.col("name"), F.col("description")))
    return keyword_join(base.withColumn("_hay", hay), "row_id", "_hay", rules, "from_keywords").select(
        "row_id",
        S.severity_resolved(F.col("sev"), F.col("cvss"), F.col("name"), F.col("description"))
        .alias("resolved"),
        S.severity_from_cvss(F.col("cvss")).alias("from_cvss"),
        "from_keywords",
    )


def _keyword_rules(spark, sf):
    """Rules made from the parts: product names, stems of them, and brands."""
    p = view(spark, sf, "part")
    rule = lambda n, keyword, label: F.struct((F.col("p_partkey") * 3 + n).alias("ordinal"), keyword.alias("keyword"), label.alias("label"))
    return p.select(F.inline(F.array(
        rule(0, F.concat(F.lower("p_name"), F.lit(" exposed. vendor "), F.lower("p_brand"), F.lit(".")), F.col("p_type")),
        rule(1, F.concat(F.lower("p_type"), F.lit(" component "), F.expr("substring(p_name, 1, 3)")), F.col("p_name")),
        rule(2, F.concat(F.lit("#"), F.col("p_partkey").cast("string")), F.col("p_brand")))))


def keyword_hits(spark, sf):
    """How many rows contain each keyword, and the first of them."""
    hay = scan(spark, sf).select("row_id", F.lower(F.concat_ws(" ", "name", "description")).alias("hay"))
    return rule_hits(hay, "row_id", "hay", _keyword_rules(spark, sf)).groupBy("keyword").agg(
        F.count("*").alias("rows"), F.min("row_id").alias("first_row"), F.min("ordinal").alias("ordinal"), F.max("label").alias("label"))


def keyword_labels(spark, sf):
    """The first rule's label for every row."""
    hay = scan(spark, sf).select("row_id", F.lower(F.concat_ws(" ", "name", "description")).alias("hay"))
    return keyword_join(hay, "row_id", "hay", _keyword_rules(spark, sf)).select("row_id", "label")


RAW_FIELDS = ["name", "severity", "vuln_id", "cve", "cvss", "description", "remediation",
              "affected_assets", "observation", "remediation_status", "risk_status"]
RAW_COLS = ["pos", "report_id", *RAW_FIELDS]


def dedupe_vuln_id(spark, sf):
    raw = stable(view(spark, sf, "raw_findings"))
    best = dd.dedupe_by_vuln_id(raw, RAW_FIELDS)
    counts = dd.merged_assets(raw).groupBy(*dd.VULN_KEYS).agg(F.count("*").alias("asset_count"))
    return best.join(counts, dd.VULN_KEYS, "left").select(
        *RAW_COLS, "status_family", F.col("vuln_key").cast("long").alias("vuln_key"),
        F.coalesce("asset_count", F.lit(0)).alias("asset_count"))


def merged_assets(spark, sf):
    return dd.merged_assets(view(spark, sf, "raw_findings")).withColumn(
        "vuln_key", F.col("vuln_key").cast("long"))


def dedupe_fingerprint(spark, sf):
    return dd.dedupe_by_fingerprint(view(spark, sf, "raw_findings")).select(*RAW_COLS)


def dedupe_name(spark, sf):
    return dd.dedupe_by_name(view(spark, sf, "raw_findings")).select(
        "report_id", "pos", "name", "severity", "description", "remediation", "cve", "cvss",
        "merged_rows")


def named_assets(spark, sf):
    return dd.named_assets(view(spark, sf, "raw_findings"))


def normalise_raw(spark, sf):
    from scanlake.operators.presentation import normalise_findings

    raw = view(spark, sf, "raw_findings").withColumn(
        "description", F.concat_ws(" ", "description", F.when(F.col("pos") % 2 == 0, F.lit("Seen on 10.9.8.7:22 and db1.corp.example."))))
    return normalise_findings(raw).select(
        "pos", "name", "severity", F.array_join("affected_assets_raw", ", ").alias("assets"))


def _by_report(spark, sf, *ids):
    return scan(spark, sf).filter(F.col("report_id").isin(*ids))


def union_scans_query(spark, sf):
    a = _by_report(spark, sf, "0", "1", "2").drop("reference", "cvss")
    b = _by_report(spark, sf, "3", "4").drop("observation")
    return union_scans([a, b]).groupBy("report_id").agg(
        F.count("*").alias("n"), F.count("reference").alias("refs"), F.count("cvss").alias("cvss"),
        F.count("observation").alias("obs"))


def _sides(spark, sf):
    """Two finding sets whose names differ: every scan title, and a second writer's spelling."""
    rows = g.normalise_rows(scan(spark, sf))
    a = rows.select(F.col("raw_name").alias("name"))
    b = rows.select(
        F.when(F.col("row_id") % 3 == 0, F.concat(F.col("raw_name"), F.lit(" detected")))
        .otherwise(F.col("raw_name")).alias("name")
    ).filter(~F.col("name").like("%ring"))
    return a, b


def gap_analysis(spark, sf):
    return nm.gap_analysis(*_sides(spark, sf))


def closest_name(spark, sf):
    a, b = _sides(spark, sf)
    gaps = nm.gap_analysis(a, b)
    return nm.closest_name(gaps.filter("side = 'a_only'"), b, 0.5)


def scan_vuln_summary(spark, sf):
    return r.scan_vuln_summary(g.normalise_rows(scan(spark, sf)))


def host_consolidation(spark, sf):
    _, b = _sides(spark, sf)
    summary = r.scan_vuln_summary(g.normalise_rows(scan(spark, sf)))
    return nm.host_consolidation(b, summary, 0.6)


TEMPLATES = {
    "cipher_weakness": "Turn off {weak_cipher_types}.",
    "deprecated_tls": "Turn off {deprecated_version} and offer TLS 1.2 or later.",
    "rce_generic": "Patch {product}.",
    "jenkins_outdated": "Move Jenkins to {fixed_version}.",
    "openssh_outdated": "Move OpenSSH to {fixed_version}.",
    "apache_info_disclosure": "Hide the server banner.",
    "outdated_service_generic": "Move {product} to {fixed_version} or later.",
    "service_exposure": "Limit access to {service} for {audience}.",
    "database_exposure": "Require a login for {service}.",
    "eol_generic": "Move to a supported release ({upgrade_targets}).",
    "legacy_service": "Turn off the {service_name}.",
    "sql_injection": "Bind query parameters.",
    "xss": "Encode output.",
    "snmp_default": "Change the community string.",
    "hsts_missing": "Send the HSTS header.",
}


def templates(spark, sf):
    from scanlake.operators.templates import choose_templates, render_templates

    eol = spark.createDataFrame([(i, *x) for i, x in enumerate(fixed.EOL_PATHS)], "ordinal int, word string, template_key string, upgrade_targets string")
    services = spark.createDataFrame([(i, *x) for i, x in enumerate(fixed.SERVICE_TEMPLATES)], "ordinal int, word string, template_key string")
    picked = choose_templates(g.normalise_rows(scan(spark, sf)).select("row_id", "raw_name"), "row_id", "raw_name", eol, services)
    table = spark.createDataFrame(list(TEMPLATES.items()), "template_key string, template string")
    return render_templates(picked, table).select("row_id", "template_key", "recommendation")


QUERIES = {
    "group_findings": group_findings,
    "finding_assets": finding_assets,
    "scan_normalise": scan_normalise,
    "title_grouping": title_grouping,
    "version_check": version_check,
    "drop_informational": drop_informational,
    "false_positive_split": false_positive_split,
    "severity_resolve": severity_resolve,
    "keyword_hits": keyword_hits,
    "keyword_labels": keyword_labels,
    "dedupe_vuln_id": dedupe_vuln_id,
    "merged_assets": merged_assets,
    "dedupe_fingerprint": dedupe_fingerprint,
    "dedupe_name": dedupe_name,
    "named_assets": named_assets,
    "normalise_raw": normalise_raw,
    "union_scans": union_scans_query,
    "gap_analysis": gap_analysis,
    "closest_name": closest_name,
    "scan_vuln_summary": scan_vuln_summary,
    "host_consolidation": host_consolidation,
    "templates": templates,
}

_HAY200 = "lower(concat_ws(' ', coalesce(raw_name, ''), observation, risk_status, coalesce(description, '')))"
_WINDOW = "regexp_replace(lower(raw_name), '[^a-z ]', ' ', 'g')"
_FUZZY = (
    f"len(list_filter(range(1, greatest(1, length({_WINDOW}) - 13) + 1), lambda i: 2.0 * list_sum(list_transform(range(1, 15), "
    f"lambda k: CASE WHEN substr(substr({_WINDOW}, i, 14), k, 1) = substr('false positive', k, 1) THEN 1 ELSE 0 END)) / (length(substr({_WINDOW}, i, 14)) + 14) >= 0.72)) > 0"
)
_LEVELS = "('Critical','High','Medium','Low')"
_VKEY = """vk AS (SELECT *, TRY_CAST(nullif(regexp_extract(coalesce(vuln_id, ''), '([0-9]+)', 1), '') AS BIGINT) AS vuln_key,
  {sf} AS status_family FROM raw_findings)""".format(
    sf=d.status_family("observation", "remediation_status", "risk_status"))
_FILLED = " + ".join(f"(CASE WHEN {d.placeholder(c)} THEN 0 ELSE 1 END)" for c in RAW_FIELDS)
_ASSETS = f"list_filter(list_transform(string_split(coalesce(affected_assets, ''), ','), lambda x: {d.sq('x')}), lambda x: NOT {d.placeholder('x')})"
_ORDERED = f"list_filter({_ASSETS}, lambda x, i: list_position({_ASSETS}, x) = i)"
_NAME_KEYED = f"""nk AS (SELECT *, CASE WHEN {d.key('name')} <> '' THEN concat({d.key('name')}, '|', lower({d.sq(d.oe('severity'))})) ELSE '' END AS name_key,
  CASE WHEN {d.key('name')} <> '' THEN -1 ELSE pos END AS anon FROM raw_findings)"""
_SIDES = f"""{d.NORM},
 a AS (SELECT DISTINCT {d.sq('lower(raw_name)')} AS name FROM norm),
 b AS (SELECT DISTINCT {d.sq('lower(name)')} AS name FROM (SELECT CASE WHEN row_id % 3 = 0 THEN concat(raw_name, ' detected') ELSE raw_name END AS name FROM norm) WHERE name NOT LIKE '%ring')"""
_SIM = "round(1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE, 9)"
_VULNS = f"""vs AS (SELECT * FROM (SELECT raw_name, arg_min(severity, row_id) AS risk, count(*) AS row_count, count(DISTINCT host) AS host_count FROM norm GROUP BY raw_name) WHERE risk IN {_LEVELS})"""


def _h(*words: str) -> str:
    return d.anyc("t", words)


_RCE = d.sq("CASE WHEN contains(raw_name, 'RCE') THEN split_part(raw_name, 'RCE', 1) ELSE split_part(raw_name, 'Remote Code', 1) END")
_VER = "regexp_extract(raw_name, '<\\s*([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)', 1)"
_BARE = d.sq("replace(replace(replace(raw_name, 'Exposed', ''), 'Service', ''), 'Server', '')")


def _template_sql() -> str:
    """CASE giving the rendered recommendation and its key, written out rule by rule."""
    t = TEMPLATES
    rules: list[tuple[str, str, str]] = []

    def rule(cond: str, key: str, **kv: str) -> None:
        text = t.get(key)
        if text is None:
            out = "NULL"
        else:
            out = d.lit(text)
            if all("{" + k + "}" in text for k in kv) and text.count("{") == len(kv):
                for k, v in kv.items():
                    out = f"replace({out}, '{{{k}}}', {v})"
        rules.append((cond, key, out))

    rule(f"{_h('ssh')} AND {_h('cbc', 'cipher', 'weak algorithm')}", "ssh_weak_ciphers")
    rule(_h("cipher", "sweet32", "medium strength"), "cipher_weakness",
         weak_cipher_types=f"CASE WHEN {_h('anonymous')} THEN 'anonymous cipher suites' WHEN {_h('medium')} THEN 'medium strength ciphers (3DES)' ELSE 'weak cipher suites' END")
    rule(_h("tls 1.0", "tls 1.1", "sslv2", "sslv3", "ssl v2", "ssl v3", "ssl version 2", "ssl version 3", "deprecated protocol", "deprecated tls"),
         "deprecated_tls", deprecated_version=f"CASE WHEN {_h('1.0')} AND {_h('1.1')} THEN 'TLS 1.0 and 1.1' WHEN {_h('1.0')} THEN 'TLS 1.0' WHEN {_h('1.1')} THEN 'TLS 1.1' ELSE 'deprecated TLS versions' END")
    rule(_h("sql injection", "sqli", "sql inj"), "sql_injection")
    rule(_h("cross-site scripting", "xss", "cross site scripting"), "xss")
    rule(_h("self-signed", "self signed"), "self_signed_cert")
    for word, key, targets in fixed.EOL_PATHS:
        rule(_h(word), key, upgrade_targets=d.lit(targets))
    rule(_h("unsupported version", "end of life", "eol", "end-of-life"), "eol_generic")
    rule(f"{_h('snmp')} AND {_h('default', 'community', 'public')}", "snmp_default")
    rule(f"{_h('smb')} AND {_h('signing')}", "smb_signing")
    rule(_h("hsts"), "hsts_missing")
    rule(_h("echo service"), "legacy_service", service_name="'Echo Service'")
    for s in fixed.DATA_SERVICES:
        rule(f"{_h(s)} AND {_h('exposed', 'unauthorized', 'information disclosure', 'open access')}", "database_exposure", service=d.lit(s.capitalize()))
    rule(_h(" rce", "remote code execution", "code execution"), "rce_generic", product=_RCE)
    rule(f"{_h('exposed')} AND NOT {_h('certificate')}", "service_exposure", service=_BARE)
    rule(f"{_h('icmp')} AND {_h('timestamp')}", "icmp_timestamp")
    rule(_h("directory listing", "directory browsing", "browsable", "directory enumeration"), "directory_listing")
    for s, key in fixed.SERVICE_TEMPLATES:
        text = t.get(key, "")
        if "{fixed_version}" in text:
            rule(_h(s), key, fixed_version=f"CASE WHEN {_VER} = '' THEN 'latest' ELSE {_VER} END")
        else:
            rule(_h(s), key)
    rule(f"{_VER} <> ''", "outdated_service_generic", product=d.sq("split_part(raw_name, '<', 1)"), fixed_version=_VER)
    keys = " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in rules)
    texts = " ".join(f"WHEN {c} THEN {o}" for c, _, o in rules)
    return f"SELECT row_id, CASE {keys} END AS template_key, CASE {texts} END AS recommendation FROM (SELECT *, lower(raw_name) AS t FROM norm)"


_IP_PORT = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?\b"
_HOST_PORT = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?::[0-9]+)?\b"
_SEV = d.sq(d.oe("severity"))
_NORM_RAW = f"""nr AS (SELECT pos, {d.squeeze('name')} AS name,
  CASE WHEN {_SEV} = '' THEN 'Medium' ELSE {d.lookup(f'lower({_SEV})', fixed.CANONICAL_SEVERITY)} END AS severity, {_ASSETS} AS a,
  concat_ws(' ', description, CASE WHEN pos % 2 = 0 THEN 'Seen on 10.9.8.7:22 and db1.corp.example.' END) AS dsc FROM raw_findings),
nx AS (SELECT pos, name, severity, list_concat(a, regexp_extract_all(dsc, '{_IP_PORT}'), regexp_extract_all(dsc, '{_HOST_PORT}')) AS l FROM nr)"""

_RULES = f"""{d.SCAN}, rules AS (SELECT keyword, arg_min(label, ordinal) AS label, min(ordinal) AS ordinal FROM (
  SELECT p_partkey * 3 AS ordinal, lower(p_name) || ' exposed. vendor ' || lower(p_brand) || '.' AS keyword, p_type AS label FROM part
  UNION ALL SELECT p_partkey * 3 + 1, lower(p_type) || ' component ' || p_name[1:3], p_name FROM part
  UNION ALL SELECT p_partkey * 3 + 2, '#' || CAST(p_partkey AS VARCHAR), p_brand FROM part) GROUP BY keyword),
hays AS (SELECT row_id, lower(concat_ws(' ', name, description)) AS hay FROM scan_rows),
texts AS (SELECT DISTINCT hay FROM hays),
hits AS (SELECT hay, keyword, ordinal, label FROM texts JOIN rules ON contains(hay, keyword))"""


ORACLE = {
    "keyword_hits": d.q(_RULES, "SELECT keyword, count(*) AS rows, min(row_id) AS first_row, min(ordinal) AS ordinal, max(label) AS label FROM hays JOIN hits USING (hay) GROUP BY keyword"),
    "keyword_labels": d.q(_RULES, "SELECT row_id, label FROM hays LEFT JOIN (SELECT hay, arg_min(label, ordinal) AS label FROM hits GROUP BY hay) USING (hay)"),
    "group_findings": d.q(d.GROUPED, f"SELECT {', '.join(FINDING_COLS)} FROM grouped"),
    "finding_assets": d.q(d.GROUPED, "SELECT * FROM assets"),
    "scan_normalise": d.q(d.TITLED, f"""SELECT row_id, report_id, raw_name, severity, vuln_id, cve, cvss, asset, observation, remediation_status, risk_status, status_family,
      {d.lookup('severity', fixed.SEVERITY_RANK, '0')} AS severity_rank, {d.lookup('severity', fixed.NARRATIVE_RANK, '5')} AS narrative_rank,
      CASE severity WHEN 'Informational' THEN 'Low' ELSE severity END AS canonical, {d.lookup('severity', fixed.SEVERITY_COLOR, "'#999999'")} AS color,
      upper(remediation_status) AS status FROM titled"""),
    "title_grouping": d.q(d.TITLED, "SELECT group_name, name AS title, count(*) AS n, min(row_id) AS first_row FROM titled GROUP BY group_name, name"),
    "version_check": d.q(d.SCAN, f"SELECT row_id, version, {d.VERSION_LT_1_17_7.format(v='version')} AS older FROM (SELECT row_id, regexp_extract(plugin_output, '([0-9][0-9.]+)', 1) AS version FROM scan_rows)"),
    "drop_informational": d.q(d.CAND, "SELECT row_id, group_name, severity FROM cand"),
    "false_positive_split": d.q(d.TITLED, f"""SELECT row_id, (NOT {d.fp_review(d.key('hay'))} AND ({d.anyc('hay', fixed.FP_TOKENS)} OR {_FUZZY}))
       OR lower(trim(risk_status)) IN {d.inlist(fixed.ACCEPTED_RISK)} OR trim(coalesce(cvss, '')) IN {d.inlist(fixed.ZERO_CVSS)}
       OR lower(trim(observation)) = 'informational' OR severity = 'Informational' AS is_fp FROM (SELECT *, {_HAY200} AS hay FROM titled)"""),
    "severity_resolve": d.q(d.SCAN, f"""SELECT row_id, coalesce({d.lookup(f"lower({d.sq('sev')})", fixed.REPORT_SEVERITY)}, from_cvss, from_keywords, nullif({d.sq('sev')}, ''), 'Medium') AS resolved, from_cvss, from_keywords
      FROM (SELECT *, CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score >= 0.1 THEN 'Low' WHEN score IS NOT NULL THEN 'Informational' END AS from_cvss,
        {d.first_keyword('hay', [(w, s) for s, w in fixed.SEVERITY_KEYWORDS])} AS from_keywords FROM
       (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '' WHEN row_id % 5 = 0 THEN 'weird' ELSE severity END AS sev,
         CASE WHEN row_id % 2 = 0 THEN {d.number('cvss')} END AS score, lower(concat_ws(' ', name, description)) AS hay FROM scan_rows))"""),
    "dedupe_vuln_id": d.q(f"{d.RAW}, {_VKEY}, ex AS (SELECT report_id, vuln_key, status_family, count(DISTINCT a) AS asset_count FROM (SELECT report_id, vuln_key, status_family, unnest({_ASSETS}) AS a FROM vk) GROUP BY ALL)",
        f"""SELECT b.* EXCLUDE (rn), coalesce(asset_count, 0) AS asset_count FROM (SELECT {', '.join(RAW_COLS)}, status_family, vuln_key,
         row_number() OVER (PARTITION BY report_id, vuln_key, status_family ORDER BY {_FILLED} DESC, length(coalesce(description, '')) DESC, pos) AS rn FROM vk WHERE vuln_key IS NOT NULL) b
         LEFT JOIN ex USING (report_id, vuln_key, status_family) WHERE rn = 1"""),
    "merged_assets": d.q(f"{d.RAW}, {_VKEY}", f"SELECT report_id, vuln_key, status_family, asset, min(pos) AS first_pos FROM (SELECT report_id, vuln_key, status_family, pos, unnest({_ASSETS}) AS asset FROM vk WHERE vuln_key IS NOT NULL) GROUP BY ALL"),
    "dedupe_fingerprint": d.q(f"{d.RAW}, {_VKEY}", f"""SELECT {', '.join(RAW_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY report_id, {d.key('name')},
        {d.key(f"array_to_string({_ORDERED}, ', ')")}, {d.key("coalesce(description, '')")} ORDER BY pos) AS rn FROM vk WHERE vuln_key IS NULL) WHERE rn = 1"""),
    "dedupe_name": d.q(f"{d.RAW}, {_NAME_KEYED}", "SELECT report_id, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(severity, pos) AS severity, " + ", ".join(
        f"(arg_min(struct_pack(v := {c}), row(CASE WHEN coalesce({c}, '') = '' THEN 1 ELSE 0 END, pos))).v AS {c}" for c in ("description", "remediation", "cve", "cvss")) + ", count(*) AS merged_rows FROM nk GROUP BY report_id, name_key, anon"),
    "named_assets": d.q(f"{d.RAW}, {_NAME_KEYED}, ex AS (SELECT report_id, name_key, anon, pos, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS asset FROM (SELECT *, list_transform(regexp_split_to_array(coalesce(affected_assets, ''), '[,\\n;]+'), lambda x: {d.sq('x')}) AS l FROM nk))",
        "SELECT report_id, name_key, anon, arg_min(asset, row(pos, i)) AS asset, min(pos) AS first_pos FROM ex WHERE asset <> '' GROUP BY report_id, name_key, anon, lower(asset)"),
    "normalise_raw": d.q(f"{d.RAW}, {_NORM_RAW}", "SELECT pos, name, severity, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS assets FROM nx"),
    "union_scans": d.q(d.SCAN, """SELECT report_id, count(*) AS n, count(CASE WHEN report_id IN ('3','4') THEN reference END) AS refs,
        count(CASE WHEN report_id IN ('3','4') THEN cvss END) AS cvss, count(CASE WHEN report_id IN ('0','1','2') THEN observation END) AS obs FROM scan_rows GROUP BY report_id"""),
    "gap_analysis": d.q(_SIDES, "SELECT name, 'a_only' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'b_only' FROM b WHERE name NOT IN (SELECT name FROM a)"),
    "closest_name": d.q(_SIDES + ", ao AS (SELECT name FROM a WHERE name NOT IN (SELECT name FROM b)), sc AS (SELECT ao.name, b.name AS match, " + _SIM.format(x="ao.name", y="b.name") + " AS similarity FROM ao, b)",
        "SELECT name, match, similarity FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, match) AS rn FROM sc) WHERE rn = 1 AND similarity > 0.5"),
    "scan_vuln_summary": d.q(f"{d.NORM}, {_VULNS}", "SELECT * FROM vs"),
    "host_consolidation": d.q(f"{_SIDES}, {_VULNS}, sn AS (SELECT {d.sq('lower(raw_name)')} AS match, max(host_count) AS host_count, max(row_count) AS row_count FROM vs GROUP BY 1), sc AS (SELECT b.name, sn.match, " + _SIM.format(x="b.name", y="sn.match") + " AS similarity, host_count, row_count FROM b, sn)",
        "SELECT match, name, similarity, host_count, row_count FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, match) AS rn FROM sc) WHERE rn = 1 AND similarity > 0.6"),
    "templates": d.q(d.NORM, _template_sql()),
}
