"""DuckDB SQL fragments used by the checks."""

from __future__ import annotations

from queries.views import RAW_FINDINGS, RESPONSES, RUN_EVENTS, SCAN_ROWS, SCAN_TEXTS, lit
from scanlake.tables import fixed

BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sq(x: str) -> str:
    return f"trim({x}, {BLANK})"


def oe(x: str) -> str:
    return f"coalesce({x}, '')"


def cell(x: str) -> str:
    t = sq(oe(x))
    return f"(CASE WHEN lower({t}) IN ('nan','none') THEN '' ELSE {t} END)"


def squeeze(x: str) -> str:
    return sq(f"regexp_replace({oe(x)}, '\\s+', ' ', 'g')")


def key(x: str) -> str:
    return squeeze(f"lower({x})")


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def placeholder(x: str) -> str:
    return f"(lower({sq(oe(x))}) IN {inlist(fixed.PLACEHOLDERS)})"


def anyc(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def lookup(x: str, mapping: dict, default: str = "NULL") -> str:
    def v(o):
        return lit(o) if isinstance(o, str) else str(o)

    return (
        f"(CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {v(o)}" for k, o in mapping.items())
        + f" ELSE {default} END)"
    )


def first_keyword(x: str, rules) -> str:
    return (
        "(CASE " + " ".join(f"WHEN {anyc(x, w)} THEN {lit(label)}" for w, label in rules) + " END)"
    )


def number(x: str) -> str:
    return f"TRY_CAST(regexp_extract({oe(x)}, '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)"


def fp_review(x: str) -> str:
    return f"({anyc(x, fixed.REVIEW_STEMS)} AND {anyc(x, fixed.REVIEW_MARKERS)})"


def status_family(*cols: str) -> str:
    t = key("concat_ws(' ', " + ", ".join(cell(c) for c in cols) + ")")
    rules = " ".join(f"WHEN {anyc(t, w)} THEN {lit(f)}" for f, w in fixed.STATUS_RULES)
    return f"(CASE WHEN {t} = '' THEN 'open' WHEN {fp_review(t)} THEN 'fp_review' {rules} ELSE 'other' END)"


def _alt(x: str, alternatives) -> str:
    def one(kind, text):
        if kind == "is":
            return f"{x} = {lit(text)}"
        return (f"starts_with({x}, {lit(text)})" if kind == "starts" else f"contains({x}, {lit(text)})")

    return " OR ".join("(" + " AND ".join(one(*t) for t in tests) + ")" for tests in alternatives)


VERSION_LT_1_17_7 = """(len(regexp_extract_all({v}, '[0-9]+')) > 0 AND
  list_resize(list_transform(regexp_extract_all({v}, '[0-9]+'), lambda p: CAST(p AS HUGEINT)), greatest(3, len(regexp_extract_all({v}, '[0-9]+'))), 0)
  < list_resize([1::HUGEINT, 17, 7], greatest(3, len(regexp_extract_all({v}, '[0-9]+'))), 0))"""


def family(lower: str, name: str, output: str | None, part: str) -> str:
    i = 1 if part == "key" else 2
    out = ""
    if output is not None:
        v = f"regexp_extract({output}, '(?i)version\\s*:\\s*([0-9][0-9.]+)', 1)"
        out += (
            f"WHEN {lower} = {lit(fixed.NGINX_TITLE)} AND {VERSION_LT_1_17_7.format(v=v)} "
            f"THEN {lit(fixed.NGINX_FAMILY[i - 1])} "
            f"WHEN {lower} = {lit(fixed.SNMP_TITLE)} AND contains(lower({output}), 'public') "
            f"THEN {lit(fixed.SNMP_FAMILY[i - 1])} "
        )
    out += " ".join(f"WHEN {_alt(lower, r[0])} THEN {lit(r[i])}" for r in fixed.TITLE_RULES)
    default = f"concat('name:', {lower})" if part == "key" else name
    return f"(CASE {out} ELSE {default} END)"


def strip_plugin(x: str) -> str:
    bare = sq(f"regexp_replace({oe(x)}, '^\\s*\\[[0-9]+\\]\\s*', '')")
    return f"coalesce(nullif({bare}, ''), {sq(oe(x))})"


_CLEAN = ", ".join(
    f"{cell(c)} AS {c}" for c in (
        "name", "severity", "plugin_id", "cve", "cvss", "host", "port", "description",
        "remediation", "plugin_output", "reference", "observation", "remediation_status",
        "risk_status",
    )
)

SCAN = f"scan_rows AS ({SCAN_ROWS})"
RAW = f"{SCAN}, raw_findings AS ({RAW_FINDINGS})"
EVENTS = f"run_events AS ({RUN_EVENTS})"
REPLIES = f"responses AS ({RESPONSES})"
TEXTS = f"scan_texts AS ({SCAN_TEXTS})"

NORM = f"""{SCAN},
clean AS (SELECT coalesce(report_id, '') AS report_id, row_id, {_CLEAN} FROM scan_rows),
norm AS (SELECT report_id, row_id, {strip_plugin('name')} AS raw_name,
  {lookup('lower(severity)', fixed.SCAN_SEVERITY, "'Informational'")} AS severity,
  nullif(plugin_id, '') AS vuln_id, nullif(cve, '') AS cve, nullif(cvss, '') AS cvss,
  nullif(host, '') AS host, nullif(port, '') AS port, nullif(description, '') AS description,
  nullif(remediation, '') AS remediation, nullif(plugin_output, '') AS proof_of_concept,
  nullif(reference, '') AS reference, coalesce(nullif(observation, ''), 'New') AS observation,
  coalesce(nullif(remediation_status, ''), 'Open') AS remediation_status,
  coalesce(nullif(risk_status, ''), 'Open') AS risk_status
 FROM clean WHERE {strip_plugin('name')} <> '')"""

TITLED = f"""{NORM},
titled AS (SELECT norm.* EXCLUDE (severity), norm.severity,
  {key('raw_name')} AS lowered,
  {family(key('raw_name'), 'raw_name', cell('proof_of_concept'), 'key')} AS group_name,
  {family(key('raw_name'), 'raw_name', cell('proof_of_concept'), 'title')} AS name,
  CASE WHEN coalesce(port, '') IN ('', '0') OR coalesce(host, '') = '' THEN host ELSE concat(host, ':', port) END AS asset,
  {status_family('observation', 'remediation_status', 'risk_status')} AS status_family
 FROM norm)"""

CAND = f"""{TITLED},
cand AS (SELECT * EXCLUDE (severity), CASE WHEN severity = 'Informational' THEN 'Low' ELSE severity END AS severity
 FROM titled WHERE severity <> 'Informational' OR group_name IN {inlist(fixed.PROMOTED_FAMILIES)})"""

_RANK = lookup("severity", fixed.SEVERITY_RANK, "0")


def _longest(c: str) -> str:
    return (
        f"arg_max(struct_pack(v := {c}), row(pref, CASE WHEN {c} IS NULL THEN 0 ELSE 1 END, "
        f"length(coalesce({c}, '')), -row_id)).v AS {c}"
    )


_HEAD = ["name", "severity", "observation", "remediation_status", "risk_status", "vuln_id"]
_MERGED = ["description", "remediation", "proof_of_concept", "cve", "cvss", "reference"]
_PACK = ", ".join(f"{c} := {c}" for c in _HEAD)

GROUPED = f"""{CAND},
scored AS (SELECT *, CASE WHEN {key('raw_name')} = {key('name')} THEN 1 ELSE 0 END AS pref,
  {_RANK} AS sev_rank, CASE WHEN cve IS NULL THEN 0 ELSE 1 END AS has_cve,
  length(coalesce(description, '')) + length(coalesce(remediation, '')) AS text_len,
  coalesce({number('cvss')}, 0.0) AS cvss_num FROM cand),
grouped0 AS (SELECT report_id, group_name, status_family,
  arg_max(struct_pack({_PACK}), row(pref, sev_rank, has_cve, text_len, cvss_num, -row_id)) AS h,
  {', '.join(_longest(c) for c in _MERGED)}, min(row_id) AS first_row, count(*) AS row_count
 FROM scored GROUP BY report_id, group_name, status_family),
assets AS (SELECT DISTINCT report_id, group_name, status_family, asset FROM cand WHERE asset IS NOT NULL),
asset_ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id, group_name, status_family ORDER BY asset) AS rn,
  count(*) OVER (PARTITION BY report_id, group_name, status_family) AS n FROM assets),
asset_summary AS (SELECT report_id, group_name, status_family, any_value(n) AS asset_count,
  CASE WHEN any_value(n) <= 10 THEN string_agg(asset, ', ' ORDER BY asset)
   ELSE concat(string_agg(asset, ', ' ORDER BY asset), ', … and ', CAST(any_value(n) - 10 AS VARCHAR), ' more') END AS affected_assets_short
 FROM asset_ranked WHERE rn <= 10 GROUP BY report_id, group_name, status_family),
grouped AS (SELECT g.report_id, g.group_name, g.status_family, h.name AS name,
  {lookup('h.name', fixed.TITLE_SEVERITY, 'h.severity')} AS severity, h.observation AS observation,
  h.remediation_status AS remediation_status, h.risk_status AS risk_status, h.vuln_id AS vuln_id,
  {', '.join(_MERGED)}, first_row, row_count, coalesce(asset_count, 0) AS asset_count, affected_assets_short,
  format('VAPT-{{:03d}}', row_number() OVER (PARTITION BY g.report_id ORDER BY first_row)) AS id
 FROM grouped0 g LEFT JOIN asset_summary a USING (report_id, group_name, status_family))"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_IPC = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:/[0-9]{1,2})?\b"
_CIDR = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2}\b"
CATEGORY_CASE = """CASE first_row % 6 WHEN 0 THEN 'Web_App | Crypto Configuration 10.0.0.0/8'
 WHEN 1 THEN 'Database - Access' WHEN 2 THEN '[PLACEHOLDER]' ELSE NULL END"""


def category_words(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '{_IPC}', ' ', 'g')"
    t = f"regexp_replace({t}, '[_|/]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+-\\s+', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' -')"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_BARE = strip_plugin("coalesce(nullif(" + sq("name") + ", ''), '[INSUFFICIENT DATA]')")
_HAY = "lower(concat_ws(' ', coalesce(name, ''), coalesce(description, '')))"

PRESENT = f"""{GROUPED},
fsubnets AS (SELECT DISTINCT report_id, group_name, status_family,
  concat(regexp_extract(asset, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1), '.0/24') AS subnet FROM assets),
fnets AS (SELECT report_id, group_name, status_family, count(*) AS n, min(subnet) AS first_subnet
  FROM fsubnets GROUP BY ALL),
present0 AS (SELECT g.*, coalesce(n, 0) AS subnet_count, first_subnet, {CATEGORY_CASE} AS category0
  FROM grouped g LEFT JOIN fnets USING (report_id, group_name, status_family)),
present1 AS (SELECT *, CASE WHEN NOT {placeholder('category0')} THEN category0
   WHEN subnet_count = 1 THEN concat('Internal Network - ', first_subnet)
   WHEN subnet_count > 1 THEN 'Internal Network - Multiple Subnets'
   ELSE coalesce({first_keyword(_HAY, fixed.CATEGORY_KEYWORDS)}, 'Network Infrastructure') END AS category FROM present0),
present2 AS (SELECT *, coalesce(nullif({slug(category_words('category'))}, ''), 'general') AS taxonomy_family,
  list_distinct(list_concat(regexp_extract_all(category, '{_CIDR}'), CASE WHEN subnet_count >= 1 THEN [first_subnet] ELSE [] END)) AS nets,
  {sq(family(key(_BARE), _BARE, 'proof_of_concept', 'title'))} AS display_title FROM present1),
findings AS (SELECT * EXCLUDE (nets, category0), {category_words('category')} AS taxonomy_label,
  CASE WHEN len(nets) + (CASE WHEN subnet_count > 1 THEN 1 ELSE 0 END) = 1 THEN nets[1]
   WHEN len(nets) + (CASE WHEN subnet_count > 1 THEN 1 ELSE 0 END) > 1 THEN 'multiple-subnets' ELSE 'host-specific' END AS subnet_key,
  {lookup('severity', fixed.SEVERITY_RANK, '0')} AS sev_rank,
  {lookup('severity', fixed.NARRATIVE_RANK, '5')} AS narr_rank,
  {key('display_title')} AS title_key, lower(id) AS id_key FROM present2),
labelled AS (SELECT *, CASE subnet_key WHEN 'multiple-subnets' THEN 'Multiple subnets'
  WHEN 'host-specific' THEN 'Host-specific findings' ELSE subnet_key END AS subnet_label FROM findings)"""

COUNTS = ", ".join(
    f"count(*) FILTER (severity = '{s}') AS total_{s.lower()}"
    for s in ("Critical", "High", "Medium", "Low")
)
TOTAL = "count(*) FILTER (severity IN ('Critical','High','Medium','Low')) AS total_findings"
