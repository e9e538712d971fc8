"""Rule ladders and single operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from scanlake.functions import assets as A
from scanlake.functions import derive as D
from scanlake.functions import ids as I
from scanlake.functions import severity as S
from scanlake.functions import text as T
from scanlake.functions.titles import family_and_title, version_lt
from scanlake.operators import dedupe as dd
from scanlake.operators import falsepos as fp
from scanlake.operators import privacy as P
from scanlake.operators import quality as Q
from scanlake.operators import rollup as R
from scanlake.operators.templates import choose_templates, render_templates
from scanlake.tables import fixed


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, c):
    return [r[0] for r in df.select(c.alias("v")).collect()]


def test_titles_map_to_families(spark):
    df = one(spark, "n string, o string",
             ("Web Server Directory Enumeration", ""), ("SSL RC4 Cipher Suites Supported (Bar Mitzvah)", ""),
             ("SNMP Server Detection", "community public"), ("Some Thing", ""),
             ("nginx HTTP Server Detection", "Version : 1.16.1"), ("nginx HTTP Server Detection", "Version : 1.18.0"))
    got = [(r.key, r.title) for r in df.withColumn("l", T.key_text(F.col("n"))).select(
        family_and_title(F.col("l"), F.col("n"), F.col("o")).alias("t")).select("t.*").collect()]
    assert got == [
        ("family:web-directory-enum", "Browsable Web Directories"),
        ("family:ssl-weak-ciphers", "SSL Medium Strength Cipher Suites Supported (SWEET32)"),
        ("name:snmp-default-community", "SNMP Agent Default Community Name (public)"),
        ("name:some thing", "Some Thing"),
        ("name:nginx-version-disclosure", "nginx < 1.17.7 Information Disclosure"),
        ("name:nginx http server detection", "nginx HTTP Server Detection"),
    ]


@pytest.mark.parametrize("v,expect", [("1.17", True), ("1.17.7", False), ("1.17.7.1", False),
                                      ("1.9.99", True), ("", False), ("2", False), ("01.2", True)])
def test_version_lt_pads(spark, v, expect):
    assert values(one(spark, "v string", (v,)), version_lt(F.col("v"), "1.17.7")) == [expect]


def test_status_families(spark):
    df = one(spark, "o string, r string, k string",
             ("New", "Open", "Open"), ("", "", ""), ("New", "Open", "False Positive Check"),
             ("New", "Open", "false positive"), ("Repeat", "Closed", ""), ("x", "Fixed", ""), ("?", "?", "?"))
    text = S.status_text(F.col("o"), F.col("r"), F.col("k"))
    got = values(df.withColumn("t", text), S.status_family(F.col("t")))
    assert got == ["open", "open", "fp_review", "fp_final", "repeat", "closed", "other"]


def test_severity_builders_differ(spark):
    df = one(spark, "s string", ("",), ("info",), ("moderate",), ("weird",), ("HIGH ",))
    assert values(df, S.severity_scan(F.col("s"))) == ["Informational", "Informational", "Informational", "Informational", "High"]
    assert values(df, S.severity_canonical(F.col("s"))) == ["Medium", "Low", "Medium", "Weird", "High"]
    assert values(df, S.severity_totals_label(F.col("s"))) == ["Medium", "Medium", "Medium", "Medium", "High"]
    sev = S.severity_resolved(F.col("s"), F.lit("n/a"), F.lit("Reflected XSS"), F.lit(""))
    assert values(df, sev) == ["Medium", "Medium", "Medium", "Medium", "High"]


def test_false_positive_rules(spark):
    schema = "name string, observation string, risk_status string, description string, cvss string, severity string"
    df = one(spark, schema,
             ("TLS old", "New", "Open", "", "7.5", "High"),
             ("A", "New", "False Positive Check", "", "10.0", "Critical"),
             ("A (FP)", "New", "Open", "", "5", "High"),
             ("Flase Positivo finding", "New", "Open", "", "5", "High"),
             ("A", "New", " Risk Accepted ", "", "5", "High"),
             ("A", "New", "Open", "", "0.0", "High"),
             ("A", "Informational", "Open", "", "5", "High"),
             ("A", "New", "Open", "", "5", "Informational"))
    flagged = fp.flag_false_positives(df)
    assert [r.is_fp for r in flagged.collect()] == [False, False] + [True] * 6
    real, false = fp.split_false_positives(df)
    assert (real.count(), false.count()) == (2, 6)


def brute_fuzzy(name):
    import re
    norm, target = re.sub(r"[^a-z ]", " ", name.lower()), "false positive"
    for i in range(max(1, len(norm) - 13)):
        w = norm[i:i + 14]
        if w and 2 * sum(a == b for a, b in zip(w, target)) / (len(w) + 14) >= 0.72:
            return True
    return False


def test_fuzzy_matches_brute_force(spark):
    names = ["", "false", "fal5e p0sitive", "falce positiv", "xx false pozitive yy", "positive false", "false posit",
             "ffalse positive", "false negative", "fals positiv", "FALSE-POSITIVE", "faxse poxitixe", "faxxe poxitixe"]
    df = one(spark, "n string", *[(n,) for n in names])
    assert values(df, fp.fuzzy_fp(F.col("n"))) == [brute_fuzzy(n) for n in names]


RAW = "pos long, report_id string, vuln_id string, name string, severity string, description string, affected_assets string, observation string, remediation_status string, risk_status string"


def test_dedupe_by_vuln_id_merges_assets_and_keeps_status_apart(spark):
    df = one(spark, RAW,
             (1, "r", "7", "A", "High", "short", "10.0.0.1, 10.0.0.2", "New", "Open", "Open"),
             (2, "r", "id 7", "A", "High", "a longer description", "10.0.0.2,10.0.0.3", "New", "Open", "Open"),
             (3, "r", "401", "B", "High", "d", "x", "New", "Open", "Open"),
             (4, "r", "401", "B", "High", "d", "y", "New", "Open", "False Positive Check"))
    best = dd.dedupe_by_vuln_id(df, ["name", "description"]).orderBy("pos").collect()
    assert [(r.pos, r.status_family) for r in best] == [(2, "open"), (3, "open"), (4, "fp_review")]
    merged = dd.merged_assets(df).filter("vuln_key = 7").orderBy("first_pos", "asset").collect()
    assert [r.asset for r in merged] == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]


def test_dedupe_by_fingerprint(spark):
    df = one(spark, RAW,
             (5, "r", None, "A  b", "High", "x y", "h1, h2", "New", "Open", "Open"),
             (6, "r", "", "a B", "Low", "X  Y", "h1,h2, nan", "New", "Open", "Open"),
             (7, "r", None, "a B", "Low", "X  Y", "h1", "New", "Open", "Open"))
    assert sorted(r.pos for r in dd.dedupe_by_fingerprint(df).collect()) == [5, 7]


def test_dedupe_by_name_fills_gaps(spark):
    df = one(spark, RAW,
             (1, "r", "", "Same", "High", "", "A;b", "", "", ""),
             (2, "r", "", " same ", "high", "text", "a, C", "", "", ""),
             (3, "r", "", "", "high", "n1", "", "", "", ""), (4, "r", "", None, "high", "n2", "", "", "", ""))
    out = dd.dedupe_by_name(df).orderBy("pos").collect()
    assert [(r.pos, r.name, r.description) for r in out] == [(1, "Same", "text"), (3, "", "n1"), (4, None, "n2")]
    assets = dd.named_assets(df).orderBy("first_pos", "asset").collect()
    assert [r.asset for r in assets] == ["A", "b", "C"]


def test_category_backfill(spark):
    df = one(spark, "a array<string>, n string",
             (["10.1.2.3:80", "10.1.2.9"], "x"), (["10.1.2.3", "10.1.3.3"], "x"), (["https://a.b"], "x"),
             (["box"], "Weak TLS setup"), (["300.1.1.1"], "plain"))
    got = values(df, A.category_of(F.col("a"), F.lit(""), F.col("n"), F.lit("")))
    assert got == ["Internal Network - 10.1.2.0/24", "Internal Network - Multiple Subnets", "Web Application",
                   "Cryptographic Configuration", "Network Infrastructure"]


def test_asset_builders(spark):
    df = one(spark, "a string", ("h1, h2, h1, [PLACEHOLDER], Affected assets: nan",))
    assert values(df, A.assets_array(F.col("a"))) == [["h1", "h2"]]
    many = one(spark, "a array<string>", ([f"h{i:02d}" for i in range(12)],))
    assert values(many, A.assets_short(F.col("a")))[0].endswith(", h09, … and 2 more")
    assert values(many, A.asset_sample(F.col("a"), 2))[0]["count"] == 12
    assert values(many, A.has_asset_trace(A.asset_trace(F.col("a")))) == [True]
    none = one(spark, "a array<string>", ([],))
    assert values(none, A.has_asset_trace(A.asset_trace(F.col("a")))) == [False]
    assert values(one(spark, "t string", ("see 10.0.0.1:80 and web.corp.io",)), A.asset_candidates(F.col("t"))) == [["10.0.0.1:80", "web.corp.io"]]


def test_reference_order_and_cells(spark):
    refs = [("Zed", "https://example.org/z"), ("OWASP", "https://owasp.org/a"), ("Title only", ""),
            ("Again", "https://OWASP.org/a/"), ("NVD CVE-2021-1", "https://nvd.nist.gov/vuln/detail/CVE-2021-1")]
    df = one(spark, "r array<struct<title:string,url:string>>", (refs,))
    ranked = [r["title"] for r in values(df, I.rank_refs(F.col("r")))[0]]
    assert ranked == ["Title only", "Zed", "NVD CVE-2021-1", "OWASP"]
    assert values(df, I.reference_text(F.col("r"))) == ["Zed\nOWASP\nTitle only\nAgain"]
    plain = one(spark, "r string", ("Vendor note; CWE-79, CWE-80",))
    assert values(plain, I.reference_plain(F.col("r"))) == ["Vendor note"]


def test_ids(spark):
    df = one(spark, "t string", ("CVE-2021-44228, cve 2020 1234; CWE-79 cwe 89 CVE-2021-44228",))
    assert values(df, I.extract_ids(F.col("t"), I.CVE_LOOSE)) == [["CVE-2021-44228", "CVE-2020-1234"]]
    assert values(df, I.extract_ids(F.col("t"), I.CWE_STRICT)) == [["CWE-79"]]
    ids = one(spark, "t string", ("79",), (" cwe-22 ",), ("x",))
    assert values(ids, I.norm_cwe(F.col("t"))) == ["CWE-79", "CWE-22", None]
    assert values(one(spark, "t string", ("cve-2021-1234",), ("CVE-1",)), I.norm_cve(F.col("t"))) == ["CVE-2021-1234", None]


def test_scores(spark):
    schema = "description string, remediation string, control_objective string, control_name string, audit_requirement string, reference string, cvss string"
    df = one(spark, schema,
             ("Bad.", "Apply patches.", "x", "y", "z", "", ""),
             ("The service on port 8443 runs 2.4.1 and is affected by CVE-2021-44228 (CWE-502).",
              "Upgrade to 2.17.1.\nRestrict the service to trusted hosts.\nMonitor outbound LDAP traffic closely.",
              "Keep every component at a supported release with a tracked owner.", "Patch Control",
              "Verify that releases are checked monthly against advisories.", "https://nvd.nist.gov/vuln/detail/CVE-2021-44228", "10"))
    low, high = Q.score_findings(df).collect()
    assert low.overall < 0.5 < high.overall
    assert {"short:description", "generic:remediation", "rem:missing-tiers", "low-specificity"} <= set(low.flags)
    empty = Q.quality_summary(Q.score_findings(df.limit(0))).collect()[0]
    assert (empty["count"], empty["mean"], empty["pass_rate"]) == (0, 0.0, 0.0)


def test_template_precedence_and_rendering(spark):
    titles = ["SSH Weak Cipher CBC", "TLS 1.0 and TLS 1.1 enabled", "Ubuntu 16.04 end of life", "OpenSSH < 9.6",
              "Acme < 2.3.4 flaw", "nothing here"]
    df = one(spark, "i int, t string", *enumerate(titles))
    eol = one(spark, "ordinal int, word string, template_key string, upgrade_targets string", *[(i, *x) for i, x in enumerate(fixed.EOL_PATHS)])
    services = one(spark, "ordinal int, word string, template_key string", *[(i, *x) for i, x in enumerate(fixed.SERVICE_TEMPLATES)])
    picked = choose_templates(df, "i", "t", eol, services).orderBy("i")
    assert values(picked, F.col("_s.key")) == ["ssh_weak_ciphers", "deprecated_tls", "eol_ubuntu", "openssh_outdated",
                                               "outdated_service_generic", None]
    table = one(spark, "template_key string, template string", ("deprecated_tls", "Drop {deprecated_version}."),
                ("outdated_service_generic", "{product} -> {fixed_version}"), ("eol_ubuntu", "{upgrade_targets} {other}"))
    out = {r.t: r.recommendation for r in render_templates(picked, table).collect()}
    assert out["TLS 1.0 and TLS 1.1 enabled"] == "Drop TLS 1.0 and 1.1."
    assert out["Acme < 2.3.4 flaw"] == "Acme -> 2.3.4"
    assert out["Ubuntu 16.04 end of life"] == "{upgrade_targets} {other}"
    assert out["nothing here"] is None


def test_derived_texts(spark):
    df = one(spark, "d string, p string", ("", "This first sentence is long enough to keep. No. The third sentence is long as well. Fourth one."))
    assert values(df, D.derive_description(F.col("d"), F.col("p"))) == [
        "This first sentence is long enough to keep. The third sentence is long as well."]
    rec = one(spark, "c string", ("['a', 'b']",), (" plain ",), ("[oops",))
    assert values(rec, D.unwrap_list_text(F.col("c"))) == ["- a\n- b", "plain", "[oops"]
    imp = one(spark, "d string, i string", ("High: text", "Low - impact"), ("text", "nan"))
    assert values(imp, D.impact_text(F.col("d"), F.col("i"))) == ["text\nimpact", "text"]
    lab = one(spark, "a array<string>", (["a"],), (["a", "b"],), (["a", "b", "c", "nan"],))
    assert values(lab, T.join_labels(F.col("a"))) == ["a", "a and b", "a, b, and c"]
    assert values(one(spark, "t string", ("Évil — Näme!",)), T.slug(F.col("t"))) == ["evil-name"]
    assert values(one(spark, "a string", ("Patch the server",)), D.is_less_specific(F.col("a"), F.lit("Patch the server and restart it"))) == [True]


def test_redaction_and_leaks(spark):
    text = ("Host: web01\nportal.client.local at 10.1.2.3:8443 and 10.1.2.3:8443, mail bob@client.local, "
            "CORP\\bob, https://portal.client.local/x). See https://nvd.nist.gov/vuln and recommendation.primary, testssl.sh")
    df = one(spark, "id int, name string, notes array<string>", (1, text, ["portal.client.local", "ok"]))
    red = P.redact(df, ["name", "notes"])
    row = red.collect()[0]
    for secret in ("portal.client.local", "10.1.2.3", "bob@client", "CORP\\bob", "web01"):
        assert secret not in row.name and all(secret not in n for n in row.notes)
    assert "nvd.nist.gov" in row.name and "recommendation.primary" in row.name and "testssl.sh" in row.name
    assert "[ASSET_1]" in row.name and "[IP_1]" in row.name
    assert P.leak_check(red, ["id"], ["name", "notes"]).count() == 0
    assert P.leak_check(df, ["id"], ["name"]).count() > 0
    back = P.restore(red, ["name", "notes"]).collect()[0]
    assert back.name == text and back.notes == ["portal.client.local", "ok"]
    labels = one(spark, "l string", ("Client",), ("jira",), ("scope",), ("FQDN",))
    assert values(labels, P.label_prefix(F.col("l"))) == ["CLIENT", "TICKET", "CONTEXT", "ASSET"]


def test_lookalike_domain_is_not_public(spark):
    df = one(spark, "u string", ("https://notgithub.com/x",), ("https://gist.github.com/x",), ("https://10.0.0.1/",), ("ftp://github.com",))
    assert values(df, I.is_public_host(F.col("u"))) == [False, True, False, False]


def test_outline_groups_list_their_findings_in_order(spark):
    rows = [("1", "web", "k", "V-3", "Low", "B title"), ("1", "web", "k", "V-2", "High", "b  title"), ("1", "web", "k", "v-1", "High", "B Title"),
            ("1", "web", "k", "", "High", "c"), ("1", "web", "k", None, "Low", "d"), ("1", "web", "k", "V-3", "Low", "B title"),
            ("1", "db", "k", "V-9", "Medium", None), ("2", "web", "k", None, "Low", "x")]
    f = one(spark, "report_id string, taxonomy_family string, subnet_key string, id string, severity string, display_title string", *rows)
    f = f.withColumns({"taxonomy_label": F.upper("taxonomy_family"), "subnet_label": F.col("subnet_key")})
    got = {(r.report_id, r.taxonomy_family): (r.highest_severity, r.finding_count, r.finding_ids) for r in R.outline_groups(f).collect()}
    # the ids were left out before; every finding counts, those without an id are not listed
    assert got == {("1", "web"): ("High", 6, ["v-1", "V-2", "V-3", "V-3"]), ("1", "db"): ("Medium", 1, ["V-9"]), ("2", "web"): ("Low", 1, [])}
