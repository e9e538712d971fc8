"""Views that turn the given tables into scan-like inputs.

Each view is one SQL text that Spark and DuckDB read alike, so that a query and
its SQL check start from the same rows.  Every view covers its whole base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlake.session import barrier, spread, tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TITLES = [
    "Web Server Directory Enumeration", "HSTS Missing From HTTPS Server (RFC 6797)",
    "Canonical Ubuntu Linux SEoL (16.04.x)", "Microsoft Message Queuing RCE (CVE-2023-21554)",
    "Elasticsearch Unrestricted Access Information Disclosure",
    "Jenkins LTS < 2.426.3 Multiple Vulnerabilities", "Kibana ESA-2019-01",
    "TLS Version 1.0 Protocol Detection", "TLS Version 1.1 Deprecated Protocol",
    "SSL Medium Strength Cipher Suites Supported (SWEET32)",
    "SSL RC4 Cipher Suites Supported (Bar Mitzvah)", "SSH Weak MAC Algorithms Enabled",
    "SSH Weak Key Exchange Algorithms Enabled", "OpenSSH < 9.3p2 Vulnerability",
    "SNMP Agent Default Community Name (public)", "SNMP Server Detection",
    "nginx HTTP Server Detection", "Alachisoft NCache Web Manager",
    "Self-signed certificate on login page", "SQL Injection in Search Form",
    "Reflected XSS in Comments", "Flase Positivo marker", "Apache < 2.4.58 Multiple Issues",
    "SMB Signing not required", "Debian 9 Unsupported Version", "Redis Server Exposed",
    "Acme Widget Server Exposed", "ICMP Timestamp Request", "Echo Service Detection",
    "Postgres Gateway < 12.4.1 Flaw",
]
CWES = [79, 89, 22, 287, 200, 327, 502, 999]

_TITLE_CASE = (
    "CASE o_orderkey % 45 "
    + " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(TITLES))
    + " ELSE concat('[', CAST(o_custkey AS STRING), '] ', p_name) END"
)
_CWE_CASE = (
    "CASE o_custkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(CWES)) + " END"
)

SCAN_ROWS = f"""
SELECT o_orderkey AS row_id, CAST(o_orderkey % 5 AS STRING) AS report_id,
 {_TITLE_CASE} AS name,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
   WHEN '3-MEDIUM' THEN 'medium ' WHEN '5-LOW' THEN 'Low' ELSE 'None' END AS severity,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('plugin ', CAST(o_custkey % 97 AS STRING)) END AS plugin_id,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('CVE-', CAST(2000 + o_custkey % 25 AS STRING), '-', CAST(1000 + o_custkey AS STRING)) END AS cve,
 CASE WHEN o_orderkey % 61 = 0 THEN '0.0' WHEN o_orderkey % 13 = 0 THEN 'n/a'
   ELSE concat(CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS STRING), '.5') END AS cvss,
 concat('10.', CAST(c_nationkey AS STRING), '.', CAST(o_custkey % 8 AS STRING), '.', CAST(o_orderkey % 250 AS STRING)) AS host,
 CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE 8000 + p_size END AS STRING) AS port,
 concat(p_type, ' component ', p_name, ' exposed. Vendor ', p_brand, '.',
   CASE o_orderkey % 6 WHEN 1 THEN concat(' See CWE-', {_CWE_CASE}, ' and cwe-89.')
     WHEN 3 THEN ' Remote code execution is possible.' ELSE '' END) AS description,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'Apply patches.'
   ELSE concat('Upgrade ', p_name, '. Restrict access.', chr(10), 'Monitor segment ', c_mktsegment, '.') END AS remediation,
 concat('Version : 1.', CAST(p_size % 30 AS STRING), '.', CAST(o_custkey % 9 AS STRING),
   CASE WHEN o_orderkey % 2 = 0 THEN ' community public was accepted by the agent.' ELSE '' END) AS plugin_output,
 CASE o_orderkey % 9 WHEN 0 THEN 'https://owasp.org/www-project-top-ten/ https://ubuntu.com/security/notices?x=1'
   WHEN 1 THEN 'OWASP Top 10' WHEN 2 THEN concat('Vendor bulletin ', p_brand, chr(10), 'https://intranet.acme.local/kb/', CAST(o_custkey % 10 AS STRING))
   ELSE NULL END AS reference,
 CASE o_orderkey % 7 WHEN 0 THEN 'Repeat' WHEN 1 THEN NULL WHEN 2 THEN 'nan' ELSE 'New' END AS observation,
 CASE o_orderstatus WHEN 'F' THEN 'Closed' ELSE 'Open' END AS remediation_status,
 CASE WHEN o_orderkey % 53 = 0 THEN 'Risk Accepted' WHEN o_orderkey % 59 = 0 THEN 'Confirmed false positive'
   WHEN o_orderstatus = 'P' THEN 'False Positive Check' ELSE 'Open' END AS risk_status
FROM orders JOIN part ON p_partkey = o_custkey JOIN customer ON c_custkey = o_custkey
"""

# Raw findings as an extraction step would emit them: one per order, assets as a comma list.
RAW_FINDINGS = f"""
SELECT row_id AS pos, report_id,
 CASE WHEN row_id % 17 = 0 THEN '' ELSE concat(substr(name, 1, 40), CASE WHEN row_id % 2 = 0 THEN '  ' ELSE '' END) END AS name,
 severity,
 CASE WHEN row_id % 3 = 0 THEN NULL WHEN row_id % 3 = 1 THEN plugin_id ELSE '[PLACEHOLDER]' END AS vuln_id,
 cve, cvss, description,
 CASE WHEN row_id % 5 = 0 THEN '[INSUFFICIENT DATA]' ELSE remediation END AS remediation,
 concat(host, ':', port, ', ', host, CASE WHEN row_id % 4 = 0 THEN ', nan' ELSE '' END) AS affected_assets,
 observation, remediation_status, risk_status
FROM scan_rows
"""

RUN_EVENTS = """
SELECT event_id, CAST(user_id AS STRING) AS run_id, ts, event_type AS type, value, props AS data FROM events
"""

RESPONSES = """
SELECT conv_id, turn, concat('<think>t</think>', CASE WHEN turn % 7 = 3 THEN 'no object'
 ELSE concat(CASE WHEN turn % 3 = 0 THEN concat('```json', chr(10)) ELSE '' END,
  '{"key":"', CAST(conv_id AS STRING), '-', CAST(turn AS STRING), '","role":"', role, '","business_impact":" ', role, ' impact "',
  CASE turn % 3 WHEN 0 THEN ',"recommendation":"patch it","reference":"vendor note"'
    WHEN 1 THEN ',"recommendation":{"primary":"patch","secondary":"isolate"},"reference":[{"title":"a","url":"u"}]' ELSE '' END,
  ',"findings":[{"name":"', role, ' issue","severity":"High"},{"name":"turn ', CAST(turn AS STRING), '","severity":"Low"}]',
  CASE WHEN turn % 2 = 1 THEN ',' ELSE '' END, '}',
  CASE WHEN turn % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) END) AS raw
FROM conversations
"""

# Documents with scan-like markers, so that boundary and noise rules have something to find.
SCAN_TEXTS = """
SELECT doc_id, replace(replace(replace(text, concat(chr(10), 'E'), concat(chr(10), 'Issue: E')),
  concat(chr(10), 'T'), concat(chr(10), '## T')), concat(chr(10), 'A'),
  concat(chr(10), chr(10), '----', chr(10), chr(10), 'Plugin 17', chr(10), 'Nmap done: 3', chr(10), 'A')) AS text
FROM documents
"""

VIEWS = {
    "scan_rows": SCAN_ROWS,
    "raw_findings": RAW_FINDINGS,
    "run_events": RUN_EVENTS,
    "responses": RESPONSES,
    "scan_texts": SCAN_TEXTS,
}


LARGE = {"orders", "lineitem", "events", "documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LARGE else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the views above."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    # A scan is read from files; the barrier makes the derived one behave like that.
    rows = columns_of(spark, sf_dir, name)
    return barrier(rows) if name == "scan_rows" else rows


def columns_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a view for a reader of few columns: the others are not computed."""
    text = VIEWS[name]
    needed = [t for t in [*TABLES, *VIEWS] if t != name and f" {t}" in text.replace("\n", " ")]
    for n in needed:
        view(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)
