"""Readers and writers on small literal files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from queries import sources as QS
from scanlake.operators import grouping as g
from scanlake.operators import history as H
from scanlake.operators import responses as R
from scanlake.operators.templates import choose_templates
from scanlake.plans.report import compose_report
from scanlake.plans.structured import structured_report, write_report_tables
from scanlake.sources import catalogs as C
from scanlake.sources import records
from scanlake.sources import scans as S
from scanlake.sources import stored as ST
from scanlake.sources import templates as T

CWE = """<Weakness_Catalog xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses>
<Weakness ID="79" Name="XSS" Abstraction="Base" Status="Stable"><Description>Bad  input
 here</Description><Extended_Description>More <p>text</p></Extended_Description>
<Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="74"/></Related_Weaknesses>
<Common_Consequences><Consequence><Scope>Confidentiality</Scope><Scope>Integrity</Scope><Impact>Read</Impact><Note>n 1</Note></Consequence></Common_Consequences>
<Detection_Methods><Detection_Method><Method>Fuzzing</Method><Description>Try it</Description></Detection_Method></Detection_Methods>
<Potential_Mitigations><Mitigation><Phase>Build</Phase><Description>Encode</Description></Mitigation><Mitigation><Description>Test</Description></Mitigation></Potential_Mitigations>
<References><Reference External_Reference_ID="REF-2"/><Reference External_Reference_ID="REF-1"/></References></Weakness>
<Weakness ID="80" Name="Other"><Description>d</Description></Weakness></Weaknesses>
<External_References><External_Reference Reference_ID="REF-1"><Title>One</Title><URL>https://one</URL></External_Reference>
<External_Reference Reference_ID="REF-2"><Title>Two</Title></External_Reference></External_References></Weakness_Catalog>"""

CAPEC = """<Attack_Pattern_Catalog xmlns="http://capec.mitre.org/capec-3"><Attack_Patterns>
<Attack_Pattern ID="86" Name="Headers" Abstraction="Detailed" Status="Draft"><Description>Desc</Description>
<Likelihood_Of_Attack>High</Likelihood_Of_Attack><Typical_Severity>Very High</Typical_Severity>
<Execution_Flow><Attack_Step><Step>1</Step><Phase>Explore</Phase><Step_Title>Look</Step_Title><Description>Look around</Description></Attack_Step></Execution_Flow>
<Prerequisites><Prerequisite>p1</Prerequisite><Prerequisite>p2</Prerequisite></Prerequisites>
<Skills_Required><Skill Level="Low">easy</Skill></Skills_Required>
<Resources_Required><Resource>none</Resource></Resources_Required>
<Mitigations><Mitigation>m1</Mitigation></Mitigations>
<Related_Weaknesses><Related_Weakness CWE_ID="79"/><Related_Weakness CWE_ID="79"/><Related_Weakness CWE_ID="80"/></Related_Weaknesses>
</Attack_Pattern></Attack_Patterns></Attack_Pattern_Catalog>"""

OSCAL = {"catalog": {"groups": [{"id": "ac", "controls": [{
    "id": "ac-1", "title": "Policy", "props": [{"name": "label", "value": "AC-1"}],
    "parts": [{"name": "statement", "prose": "Do:", "parts": [
        {"name": "item", "prose": "write it", "props": [{"name": "label", "value": "a."}]}]},
        {"name": "guidance", "prose": "Think."}],
    "controls": [{"id": "ac-1.1", "title": "More"}]}]}]}}


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_scan_csv_headers_and_grouping(spark, tmp_path):
    a = write(tmp_path, "a.csv", 'Plugin ID,Name,Risk,Host,Port,Description,Solution\n'
              '1,"[9] TLS Version 1.0 Protocol Detection",Medium,10.0.0.1,443,"two\nlines","Fix, it"\n'
              '2,TLS Version 1.1 Deprecated Protocol,Low,10.0.0.2,0,short,\n3,,High,h,1,x,y\n4,Info thing,None,h,1,x,y\n')
    b = write(tmp_path, "b.csv", " Vulnerability ,Severity,IP\nOther,High,10.0.0.3\n")
    frames = [S.resolve_columns(S.read_scan_csv(spark, p).withColumn("report_id", F.lit("r"))) for p in (a, b)]
    scan = S.union_scans(frames)
    findings, assets = g.findings_from_scan(scan)
    rows = {r.name: r for r in findings.collect()}
    assert set(rows) == {"TLS Version 1.1 Deprecated Protocol", "Other"}
    tls = rows["TLS Version 1.1 Deprecated Protocol"]
    assert (tls.severity, tls.asset_count, tls.affected_assets_short) == ("Medium", 2, "10.0.0.1:443, 10.0.0.2")
    assert tls.description == "short" and tls.remediation is None
    assert assets.count() == 3
    with pytest.raises(ValueError):
        S.resolve_columns(spark.createDataFrame([("x",)], "Foo string"))
    assert S.selected_columns(["Synopsis", "Description", "Title"])["description"] == "Synopsis"


def test_scan_csv_files_with_different_headers(spark, tmp_path):
    a = write(tmp_path, "a.csv", "Name,Risk,Host\nA1,High,1.1.1.1\nA2,Low,1.1.1.2\n")
    b = write(tmp_path, "b.csv", "Host,Name,Risk\n2.2.2.2,B1,Critical\n")
    c = write(tmp_path, "c.csv", "Name,Risk,Host\nC1,Low,3.3.3.3\n")
    write(tmp_path, "empty.csv", "")
    scan = S.read_scan_csv(spark, [b, c, a, str(tmp_path / "empty.csv")])
    got = [(r.Name, r.Risk, r.Host) for r in scan.orderBy("row_id").collect()]
    assert got == [("B1", "Critical", "2.2.2.2"), ("C1", "Low", "3.3.3.3"), ("A1", "High", "1.1.1.1"), ("A2", "Low", "1.1.1.2")]
    both = S.union_scans([S.read_scan_csv(spark, a), S.read_scan_csv(spark, b)])
    assert [r.Name for r in both.orderBy("row_id").collect()] == ["A1", "A2", "B1"]
    assert both.select("row_id").distinct().count() == 3


def test_scan_text(spark, tmp_path):
    p = write(tmp_path, "scan.txt", "line one\n\nline two\n")
    docs = S.read_scan_text(spark, p)
    assert [(r.line_no, r.line) for r in S.explode_lines(docs).orderBy("line_no").collect()] == [
        (0, "line one"), (1, ""), (2, "line two")]


def test_weaknesses(spark, tmp_path):
    df = C.load_weaknesses(spark, write(tmp_path, "cwe.xml", CWE))
    r = df.filter("id = 'CWE-79'").collect()[0]
    assert r.description == "Bad input here" and r.extended_description.startswith("More")
    assert r.consequences == "Scope: Confidentiality, Integrity; Impact: Read; Note: n 1"
    assert r.mitigations == "[Build] Encode | Test" and r.detection_methods == "[Fuzzing] Try it"
    assert [(x.nature, x.cwe_id) for x in r.related] == [("ChildOf", "CWE-74")]
    assert [(x.title, x.url) for x in r.refs] == [("Two", ""), ("One", "https://one")]
    assert df.count() == 2 and df.filter("id = 'CWE-80'").collect()[0].refs == []


def test_attack_patterns_and_bridge(spark, tmp_path):
    df = C.load_attack_patterns(spark, write(tmp_path, "capec.xml", CAPEC))
    r = df.collect()[0]
    assert (r.id, r.likelihood, r.severity) == ("CAPEC-86", "High", "Very High")
    assert r.prerequisites == "p1 | p2" and r.skills_required == "[Low] easy"
    assert r.execution_flow == "[Explore] Look: Look around"
    assert sorted(map(tuple, C.pattern_weakness_bridge(df).collect())) == [("CAPEC-86", "CWE-79"), ("CAPEC-86", "CWE-80")]


def test_controls(spark, tmp_path):
    df = C.load_controls(spark, write(tmp_path, "oscal.json", json.dumps(OSCAL)))
    rows = {r.id: r for r in df.collect()}
    assert rows["AC-1"].statement == "Do:\na. write it" and rows["AC-1"].guidance == "Think."
    assert (rows["AC-1"].label, rows["AC-1"].family) == ("AC-1", "AC")
    assert rows["AC-1.1"].parent_id == "AC-1"
    assert [r.id for r in H.list_family(df, "ac").collect()] == ["AC-1", "AC-1.1"]
    deep = json.loads(json.dumps(OSCAL))
    deep["catalog"]["groups"][0]["controls"][0]["controls"][0]["controls"] = [{"id": "ac-1.1.1", "title": "Deep"}]
    deep["catalog"]["groups"][0]["groups"] = [{"id": "au", "controls": [{"id": "au-1"}]}, {"controls": [{"id": "ac-9"}]}]
    got = C.load_controls(spark, write(tmp_path, "deep.json", json.dumps(deep))).collect()
    assert sorted((r.id, r.family, r.parent_id) for r in got) == [
        ("AC-1", "AC", ""), ("AC-1.1", "AC", "AC-1"), ("AC-1.1.1", "AC", "AC-1.1"), ("AC-9", "AC", ""), ("AU-1", "AU", "")]
    assert C.load_controls(spark, write(tmp_path, "none.json", '{"catalog": {"groups": []}}')).count() == 0


def test_cve_and_epss(spark, tmp_path):
    cve = {"vulnerabilities": [{"cve": {
        "id": "CVE-2021-1", "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hi"}],
        "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "HIGH"}}],
                    "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}, "baseSeverity": "MEDIUM"}]},
        "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-Other"}]}, {"description": [{"value": "CWE-79"}]}],
        "references": [{"url": f"https://r/{i}", "tags": ["x"]} for i in range(9)] + [{"url": ""}]}}]}
    df = C.flatten_cve(spark.createDataFrame([(json.dumps(cve),), ('{"vulnerabilities": []}',)], "value string"))
    r = df.collect()
    assert len(r) == 1 and (r[0].description, r[0].cvss, r[0].severity) == ("hi", 7.5, "HIGH")
    assert r[0].cwes == ["CWE-79"] and len(r[0].references) == 9
    page = json.dumps({"vulnerabilities": [{"cve": {"id": f"CVE-2021-{i}"}} for i in range(3)]})
    assert {x.cve for x in C.flatten_cve(spark.createDataFrame([(page,)], "value string")).collect()} == {"CVE-2021-0", "CVE-2021-1", "CVE-2021-2"}
    p = write(tmp_path, "epss.csv", "#model_version:v1,score_date:2024-05-01T00:00:00+0000\ncve,epss,percentile\nCVE-2021-1,0.5,0.9\n")
    assert [tuple(x) for x in C.load_epss(spark, p).collect()] == [("CVE-2021-1", 0.5, 0.9, "2024-05-01")]
    bare = write(tmp_path, "bare.csv", "cve,epss,percentile\nCVE-2021-2,0.1,0.2\n")
    assert [tuple(x) for x in C.load_epss(spark, bare).collect()] == [("CVE-2021-2", 0.1, 0.2, None)]


def test_templates_payload(spark, tmp_path):
    good = {"RECOMMENDATION_TEMPLATES": {"xss": "Encode."}, "EOL_UPGRADE_PATHS": {"centos 7": {"upgrade_targets": "R9", "template": "eol"}},
            "SERVICE_HARDENING": {"nginx": "n"}}
    t = T.load_templates(spark, write(tmp_path, "t.json", json.dumps(good)))
    T.require_valid(t)
    assert [tuple(r) for r in t["eol_paths"].collect()] == [(0, "centos 7", "eol", "R9")]
    rows = spark.createDataFrame([(1, "CentOS 7 end"), (2, "Nginx"), (3, "XSS"), (4, None)], "k int, title string")
    got = choose_templates(rows, "k", "title", t["eol_paths"], t["services"]).collect()
    assert {r.k: r._s and r._s.key for r in got} == {1: "eol", 2: "n", 3: "xss", 4: None}
    bad = {"RECOMMENDATION_TEMPLATES": {}, "EOL_UPGRADE_PATHS": {"x": {"template": "e"}}}
    v = T.load_templates(spark, write(tmp_path, "b.json", json.dumps(bad)))["violations"]
    assert v.count() == 3
    with pytest.raises(ValueError):
        T.require_valid({"violations": v})


def test_corpus(spark):
    rows = [("Vulnerability Title / Observation", "XSS"), ("Severity", "High"), ("Control  Objective", "Encode"),
            ("Recommendation", "Fix"), ("CVE /CWE", "CVE 2021 1234, cwe-79"), ("Status", "Open"), ("Junk", "x")]
    cells = [("a.docx", 1, i, k, v) for i, (k, v) in enumerate(rows)] + [("a.docx", 2, 0, "Severity", "Low")]
    df = T.build_corpus(spark.createDataFrame(cells, "source string, table_no int, row_no int, label string, value string"))
    r = df.collect()
    assert len(r) == 1 and (r[0].name, r[0].cves, r[0].cwes) == ("XSS", ["CVE-2021-1234"], ["CWE-79"])


def test_response_repair(spark):
    raws = ['<think>x</think>```json\n{"a": 1}\n```', '{"a": 1,}', '{"a": "two\nlines"}', '{"a": "two\nlines",}', "none", '{"findings": "x"}']
    df = R.parse_responses(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"))
    assert [r.parse_stage for r in df.orderBy("i").collect()] == ["plain", "repaired", "escaped", "escaped_repaired", "failed", "plain"]
    assert R.quarantine(df).count() == 1 and R.explode_findings(df, ["i"]).count() == 0


def test_replies_with_lists_and_trailing_text(spark):
    raws = ['{"findings": [{"name": "a", "affected_assets": ["10.0.0.1", "10.0.0.2"]}, {"name": "b", "affected_assets": "h1, h2"}, {"name": "c"}],'
            ' "reference": ["OWASP", {"title": "t", "url": "u"}]}',
            '{"a": 1} trailing }', '{"a": 1}\n{"b": 2}', '{"a": 1}} }', '{"a": 1}] }']
    df = R.parse_responses(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"))
    assert [r.parse_stage for r in df.orderBy("i").collect()] == ["plain"] + ["failed"] * 4
    assert [r.affected_assets for r in R.explode_findings(df, ["i"]).orderBy("item_no").collect()] == ["10.0.0.1, 10.0.0.2", "h1, h2", None]
    refs = R.normalise_result(df).filter("i = 0").first().refs
    assert [tuple(x) for x in refs] == [("OWASP", ""), ("t", "u")]


def test_a_leak_fails_the_job(spark, monkeypatch):
    from scanlake.operators import privacy as P

    df = spark.createDataFrame([("k", "host 10.1.2.3 down", ["a 10.1.2.3"])], "k string, t string, l array<string>")
    assert "10.1.2.3" not in str(P.redact_or_fail(df, ["k"], ["t", "l"]).select("t", "l").collect())
    monkeypatch.setattr(P, "redact", lambda d, cols: d)
    with pytest.raises(Exception, match="ip left in field t"):
        P.redact_or_fail(df, ["k"], ["t"]).collect()


def test_events_and_snapshots(spark, tmp_path):
    ev = spark.createDataFrame([("r", "t1", "llm_interaction", "{}"), ("r", "t2", "x", "{}")], "run_id string, timestamp string, type string, data string")
    path = str(tmp_path / "ev")
    H.append_events(ev, path)
    H.append_events(ev, path)
    assert spark.read.parquet(path).filter("type = 'x'").count() == 2
    H.write_snapshot(ev, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    data = ev.select(H.interaction_event({"label": F.col("run_id")}).alias("d")).first().d
    assert len(json.loads(data)) == 10


def test_report_is_idempotent_and_written(spark, tmp_path):
    from queries.views import view
    from scanlake.operators.presentation import subnet_summary

    rep = structured_report(view(spark, "/root/testdata/sf0.001", "scan_rows"))
    f = rep["findings"]
    again = compose_report(f, subnet_summary(rep["assets"], ["report_id", "id"]), ["report_id", "id"])["findings"]
    cols = ["report_id", "id", "display_title", "taxonomy_family", "taxonomy_label", "subnet_key", "display_control_name"]
    assert sorted(map(tuple, f.select(*cols).collect())) == sorted(map(tuple, again.select(*cols).collect()))
    assert f.select("report_id", "id").distinct().count() == f.count()
    write_report_tables(rep, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == f.count()
    assert spark.read.parquet(str(tmp_path / "out" / "cards")).count() == f.count()


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).selectExpr("concat('K', id) AS id", "1 AS v", "id AS x")
    ST.create_table(rows, path, ["id"], 8)
    assert ST.layout(spark, path) == (["id"], 8)
    found = ST.lookup_key(spark, path, "K42")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert [tuple(r) for r in found.collect()] == [("K42", 1, 42)]
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,K42)]" in scan and "PartitionFilters: [isnotnull(_bucket" in scan
    assert len({f for f in found.inputFiles()}) == 1 or "_bucket" in scan
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("_bucket=*/*.parquet")}
    new = spark.createDataFrame([("K1", 2, -1), ("K2", 0, -2), ("N1", 1, 7), ("N1", 3, 8)], "id string, v int, x long")
    touched = ST.upsert_table(new, path, "v")
    assert 0 < len(touched) <= 3
    after = {p: p.stat().st_mtime_ns for p in Path(path).glob("_bucket=*/*.parquet")}
    kept = {p for p in before if p.parent.name not in {f"_bucket={b}" for b in touched}}
    assert kept and all(after[p] == before[p] for p in kept) and not any(p in after for p in before if p not in kept)
    got = {r.id: (r.v, r.x) for r in ST.read_table(spark, path).collect()}
    assert len(got) == 501 and (got["K1"], got["K2"], got["N1"]) == ((2, -1), (1, 2), (3, 8))
    assert ST.upsert_table(new.limit(0), path, "v") == []
    many = ST.lookup_keys(spark.createDataFrame([("K7",), ("K7",), ("no",)], "id string"), path)
    assert [r.id for r in many.collect()] == ["K7"]
    wide = ST.upsert_table(spark.createDataFrame([("K3", 9, 1, "w")], "id string, v int, x long, extra string"), path, "v")
    assert len(wide) == 1 and ST.lookup_key(spark, path, "K3").first().v == 9
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        ST.create_table(rows, path, ["id"], 8)


def test_csv_in_splits_equals_one_task(spark, tmp_path):
    """Quoted line breaks at any split border, doubled quotes, empty cells and lines, CRLF, quotes inside bare cells."""
    import random

    rnd = random.Random(4)
    cell = lambda: rnd.choice(["a", "", "x y", '"q,r"', '"two\nlines"', '"say ""hi"""', '"\n\n"', '""', '"""\n"', 'in"ner', '"a\r\nb,c"', '"end "" \n,""x"""'])
    for eol in ("\n", "\r\n"):
        body = ["id,Name,c,d"] + [",".join([f"{i}", "n", *[cell() for _ in range(rnd.choice([1, 2, 2, 3]))]]) + ("" if rnd.random() < 0.9 else eol) for i in range(400)]
        p = tmp_path / f"big{len(eol)}.csv"
        p.write_bytes(eol.join(body).encode())
        want = spark.read.options(header=True, multiLine=True, escape='"').csv(str(p)).collect()
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
            rows = S.read_scan_csv(spark, str(p))
            assert records.read_records(spark, [str(p)]).rdd.getNumPartitions() > 1
            got = rows.orderBy("row_id").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        fix = lambda v: v and v.replace("\r\n", "\n")
        assert [tuple(map(fix, r[:4])) for r in got] == [tuple(map(fix, r)) for r in want]
        assert [r.row_id for r in got] == list(range(len(want)))


def test_csv_with_many_headers_takes_one_job_for_them(spark, tmp_path):
    for i in range(12):
        write(tmp_path, f"f {i:02}.csv", f"Name,col{i % 3},,Name\nx{i},{i},u,again\n")
    rows = S.read_scan_csv(spark, str(tmp_path))
    assert rows.columns == ["Name0", "col0", "_c2", "Name3", "col1", "col2", "source_file", "row_id"]
    got = rows.orderBy("row_id").collect()
    assert [(r.Name0, r.col0 or r.col1 or r.col2, r._c2, r.Name3) for r in got] == [(f"x{i}", str(i), "u", "again") for i in range(12)]
    assert records.header_names("\"a\nb\",A,,a,c") == ["a\nb", "A1", "_c2", "a3", "c"]


def test_guidance_of_any_depth(spark, tmp_path):
    part = {"name": "guidance", "prose": "7"}
    for i in range(6, 0, -1):
        part = {"name": "guidance" if i % 2 else "item", "prose": str(i), "parts": [part, {"name": "guidance", "prose": f"{i}b"}]}
    doc = {"catalog": {"groups": [{"id": "a", "groups": [{"groups": [{"id": "b", "controls": [
        {"id": "b-1", "parts": [part, {"name": "guidance", "prose": "end"}], "controls": [{"title": "no id", "controls": [{"id": "lost"}]}, {"id": "b-1.1", "controls": [{"id": "b-1.1.1"}]}]}]}]}],
        "controls": [{"id": "a-1"}]}]}}
    got = {r.id: r for r in C.load_controls(spark, write(tmp_path, "deep.json", json.dumps(doc))).collect()}
    assert set(got) == {"A-1", "B-1", "B-1.1", "B-1.1.1"}
    assert got["B-1"].guidance == "1\n3\n5\n7\n6b\n5b\n4b\n3b\n2b\n1b\nend" and got["A-1"].guidance == ""
    assert {k: (r.family, r.parent_id) for k, r in got.items()} == {"A-1": ("A", ""), "B-1": ("B", ""), "B-1.1": ("B", "B-1"), "B-1.1.1": ("B", "B-1.1")}


def test_every_ref_has_all_ids_of_a_page(spark, tmp_path):
    pages = [(k, f"https://h{k}.example/") for k in (7, 20, 79)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QS.every_ref(spark, str(tmp_path)).filter("title like 'CWE-%' or title like 'NVD %'").collect()
    got = {k: sorted(r.title for r in found if r.page_id == k) for k, _ in pages}
    cves = lambda k: sorted(["NVD CVE-2019-12345", "NVD CVE-2021-1001", f"NVD CVE-2021-{1000 + k % 50}"])
    # the third weakness was cut off before
    assert got == {7: ["CWE-20", "CWE-7", "CWE-79", *cves(7)], 20: ["CWE-20", "CWE-79", *cves(20)], 79: ["CWE-19", "CWE-20", "CWE-79", *cves(79)]}
