"""Operators that split hot keys, against brute force on skewed fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queries.views import view
from scanlake.functions import ids as I
from scanlake.operators import dedupe as dd
from scanlake.operators import grouping as g
from scanlake.operators import match as m
from scanlake.operators import names as nm
from scanlake.operators import rollup as r
from scanlake.operators.history import upsert
from scanlake.operators.keywords import keyword_heads, keyword_join, rule_hits, text_heads, text_hits
from scanlake.operators.ordinal import first_k, number_by_order, prefix_sums

SF = "/root/testdata/sf0.001"


def test_prefix_sums_over_blocks_match_a_window(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 17).cast("string"))).alias("k"),
        (F.col("id") * 37 % 100003).alias("pos"), (F.col("id") % 7).alias("v"))
    w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("k", "pos", F.sum("v").over(w).alias("s"), F.count("*").over(w).alias("n"))
    got = prefix_sums(df, ["k"], "pos", {"s": F.col("v"), "n": F.lit(1)}, block_bits=8)
    assert sorted(map(tuple, got.select("k", "pos", "s", "n").collect())) == sorted(map(tuple, want.collect()))


def test_number_by_order_matches_row_number(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"),
        F.md5(F.col("id").cast("string")).alias("t"))
    want = df.select("k", "t", F.row_number().over(W.partitionBy("k").orderBy(F.col("t").desc())).alias("n"))
    got = number_by_order(df, ["k"], [F.col("t").desc()], "n", partitions=7)
    assert sorted(map(tuple, got.select("k", "t", "n").collect())) == sorted(map(tuple, want.collect()))


def test_first_k_limits_before_the_shuffle(spark):
    plan = first_k(spark.range(100).selectExpr("id % 2 AS k", "id"), ["k"], [F.col("id")], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_grouping_does_not_depend_on_row_order(spark):
    scan = view(spark, SF, "scan_rows")
    a = g.group_findings(g.candidate_rows(scan)).collect()
    b = g.group_findings(g.candidate_rows(scan.repartition(13, "host"))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_orders_of_texts_are_put_together_as_longs(spark):
    """One decimal product a merged text, not one for each of its parts."""
    texts = [*g.KEYS, "raw_name", "name", "severity", *g.MERGED]
    rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in texts) + ", row_id long")
    assert g.winning_rows(rows)._jdf.queryExecution().analyzed().toString().count(" * ") == len(g.MERGED)
    got = spark.range(1).select(g._packed(F.lit(1), (F.lit(True), 1), (F.lit(5), 31)).alias("n")).first()["n"]
    assert got == 3 * 2**31 + 5


def test_winners_of_findings_match_a_sort(spark):
    """Titles, gaps, lengths and ties by row id, against Python; a cell loses every blank at its ends."""
    import itertools
    texts = ["", "abc", "defg", "wxyz", None, "\t abc\n"]
    data = [(i, "1", ["TLS Version 1.0 Protocol Detection", "tls version 1.0 protocol detection  "][i % 2], d, rem)
            for i, (d, rem) in enumerate(itertools.product(texts, texts))]
    scan = spark.createDataFrame(data, "row_id long, report_id string, name string, description string, remediation string")
    scan = scan.withColumns({"severity": F.lit("High"), **{c: F.lit(None).cast("string") for c in g.SCAN_FIELDS if c not in (
        "name", "severity", "description", "remediation")}})
    rows = g.candidate_rows(scan)
    clean = rows.collect()
    assert {r["description"] for r in clean} == {None, "abc", "defg", "wxyz"}
    got = g.winning_rows(rows).collect()
    assert len(got) == 1 and got[0]["row_count"] == len(data) and got[0]["first_row"] == 0
    key = lambda s: " ".join(s.lower().split())
    for place, c in ((1, "description"), (2, "remediation")):
        best = max(clean, key=lambda r: (key(r["raw_name"]) == key(r["name"]), r[c] is not None, len(r[c] or ""), -r["row_id"]))
        assert got[0]["rows"][place] == best["row_id"]


def test_readers_of_few_scan_columns_compute_no_others(spark):
    """CVE ids and EPSS scores come from the rows of the scan without its texts."""
    from queries import enrichment

    for made in (enrichment.cves(spark, SF), enrichment.epss(spark, SF)):
        assert "component" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_staged_tables_and_distinct_assets(spark):
    """Staged tables are written as zstd; the assets of a scan are one of them, not distinct again for every reader."""
    found, assets = g.findings_from_scan(view(spark, SF, "scan_rows"))
    assert "Aggregate" not in assets._jdf.queryExecution().optimizedPlan().toString()
    assert all(f.endswith(".zstd.parquet") for f in assets.inputFiles())
    assert assets.count() == assets.distinct().count()


def test_references_are_worked_out_once(spark):
    """The canonical keys of a list are made once a list, not once for each of its entries."""
    pages = spark.createDataFrame([("https://a.example/x?1 https://A.example/x/ Vendor note one",)], "t string")
    plan = pages.select(I.rank_refs(I.refs_array(F.col("t")), None).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("/+$") == 1
    got = pages.select(F.explode(I.rank_refs(I.refs_array(F.col("t")), None)).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("Vendor note one", ""), ("https://a.example/x?1", "https://a.example/x?1")]


def test_merged_references_keep_the_first_of_each_key(spark):
    one = "array(named_struct('title', ' a ', 'url', 'u'), named_struct('title', 'b', 'url', ''), named_struct('title', '', 'url', ''))"
    two = "array(named_struct('title', 'c', 'url', 'u'), named_struct('title', 'b', 'url', ''), named_struct('title', 'd', 'url', CAST(NULL AS STRING)))"
    df = spark.sql(f"SELECT {one} AS x, {two} AS y")
    got = df.select(F.inline(I.merge_refs(F.col("x"), F.col("y"), 3))).collect()
    assert [tuple(r) for r in got] == [("a", "u"), ("b", ""), ("d", "")]


def test_name_dedupe_sorts_only_columns_that_are_read(spark):
    raw = spark.createDataFrame(
        [("1", 1, "A", "High", "", "x"), ("1", 2, " a ", "high", "text", "y"), ("1", 3, "", "Low", "t", "z")],
        "report_id string, pos long, name string, severity string, description string, observation string")
    out = dd.dedupe_by_name(raw).select("pos", "name", "description", "merged_rows")
    assert "observation" not in out._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert sorted(map(tuple, out.collect())) == [(1, "A", "text", 2), (3, "", "t", 1)]


def test_grouping_aggregates_no_texts(spark):
    """Winners come from hash aggregation over ranks and row ids; texts are fetched by row id."""
    rows = g.candidate_rows(view(spark, SF, "scan_rows"))
    plan = g.winning_rows(rows)._jdf.queryExecution().executedPlan().toString()
    aggregates = [x for x in plan.split("\n") if "Aggregate(" in x]
    assert sum("HashAggregate" in x for x in aggregates) == 2
    texts = ("description#", "remediation#", "proof_of_concept#", "reference#")
    assert not any("functions=" in x and any(f"max({t}" in x or f"max_by({t}" in x for t in texts) for x in aggregates)
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 2


def test_grouping_winners_equal_a_sort(spark):
    """Ties in every part of the order, negative and huge row ids, null texts."""
    rnd = random.Random(2)
    ids = rnd.sample(range(-500, 500), 200) + [2**62, -2**62]
    rows = [("r", i, rnd.choice(["t", "T x"]), "t", rnd.choice(["k1", "k2"]), "open", rnd.choice(["High", "Low"]), rnd.choice([None, "c"]),
             rnd.choice([None, "7.5", "9.25", "x"]), rnd.choice([None, "", "aa", "bb", "ccc"]), rnd.choice([None, "p", "qq"])) for i in ids]
    cols = "report_id string, row_id long, raw_name string, name string, group_name string, status_family string, severity string, cve string, cvss string, description string, remediation string"
    d = spark.createDataFrame(rows, cols).selectExpr("*", *[f"cast(row_id as string) as {c}" for c in ("observation", "remediation_status", "risk_status", "vuln_id")], "description as proof_of_concept", "remediation as reference")
    got = {r.group_name: r for r in g.group_findings(d).collect()}
    for key in ("k1", "k2"):
        mine = [x for x in rows if x[4] == key]
        pref = lambda x: x[2].lower() == "t"
        num = lambda x: float(x[8]) if x[8] and x[8] != "x" else 0.0
        head = max(mine, key=lambda x: (pref(x), {"High": 3, "Low": 1}[x[6]], x[7] is not None, len(x[9] or "") + len(x[10] or ""), num(x), -x[1]))
        assert (got[key].vuln_id, got[key].row_count, got[key].first_row) == (str(head[1]), len(mine), min(x[1] for x in mine))
        for c, i in (("description", 9), ("remediation", 10), ("cve", 7), ("cvss", 8)):
            assert got[key][c] == max(mine, key=lambda x: (pref(x), x[i] is not None, len(x[i] or ""), -x[1]))[i]


def test_upsert_last_write_wins(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, v int, t string")
    u = spark.createDataFrame([("a", 1, "new"), ("a", 0, "old"), ("c", 1, "z")], "id string, v int, t string")
    assert sorted(map(tuple, upsert(t, u, ["id"], "v").collect())) == [("a", 1, "new"), ("b", 5, "y"), ("c", 1, "z")]


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_closest_name_matches_brute_force(spark):
    rnd = random.Random(3)
    words = ["ssl", "weak", "cipher", "server", "open", "port", "old", "tls"]
    make = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))
    a, b = {make() for _ in range(40)}, {make() for _ in range(40)}
    sim = lambda x, y: round(1 - _edit(x, y) / max(len(x), len(y)), 9)
    want = {}
    for x in a:
        best = min((-sim(x, y), y) for y in b)
        if -best[0] > 0.6:
            want[x] = best[1]
    df = lambda s: spark.createDataFrame([(x,) for x in s], "name string")
    got = {r.name: r.match for r in nm.closest_name(df(a), df(b), 0.6).collect()}
    assert got == want


def _names(seed, n):
    """Titles with near copies: a few edits away, short ones, repeated letters, and unrelated ones."""
    rnd = random.Random(seed)
    words = ["ssl", "weak", "cipher", "suites", "supported", "server", "open", "port", "old", "tls", "apache", "1.2", "2.4.5", "aaaa", "remote", "code"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7))) for _ in range(n)]

    def near(x):
        x = list(x)
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            at = rnd.randrange(len(x) + 1)
            x[at: at + rnd.randint(0, 1)] = rnd.choice(["", "q", "e", " ", "ab"])
        return "".join(x).strip() or "x"

    short = ["a", "b", "ab", "ba", "abc", "aa", "aaa", "aaaa", "tls", "ssl 3", "ssl 2"]
    left = {near(x) for x in base} | set(rnd.sample(short, 6)) | {"".join(rnd.choice("abcdefgh ") for _ in range(20)).strip() for _ in range(n // 10)}
    return left, set(base) | set(rnd.sample(short, 6))


@pytest.mark.parametrize("minimum", [0.5, 0.75])
def test_closest_name_equals_brute_force_on_many_names(spark, minimum):
    a, b = _names(9, 300)
    want = {}
    for x in a:
        best = min((-round(1 - _edit(x, y) / max(len(x), len(y)), 9), y) for y in b if min(len(x), len(y)) >= minimum * max(len(x), len(y)) - 1)
        if -best[0] > minimum:
            want[x] = (best[1], -best[0])
    df = lambda s: spark.createDataFrame([(x,) for x in s], "name string")
    got = {r.name: (r.match, r.similarity) for r in nm.closest_name(df(a), df(b), minimum).collect()}
    assert got == want
    assert nm.closest_name(df(a).limit(0), df(b), minimum).count() == 0 and nm.closest_name(df(a), df(b).limit(0), minimum).count() == 0


def test_closest_name_compares_few_pairs(spark):
    """Nearly all names are settled by a join on rare grams; pairs met stay below a tenth of all."""
    a, b = _names(4, 3000)
    df = lambda s: nm.distinct_names(spark.createDataFrame([(x,) for x in s], "name string"))
    grams = nm.name_grams(df(b))
    counts = grams.groupBy("gram").agg(F.count("*").alias("names"))
    filed, asked = nm.rare_first(grams, counts), nm.rare_first(nm.name_grams(df(a)), counts)
    pairs = sum(nm.candidate_pairs(asked, filed, level).count() for level in nm.LEVELS[:2])
    assert pairs < len(a) * len(b) / 10
    plan = nm.candidate_pairs(asked, filed, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_keyword_join_with_many_rules(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdeé😀f") for _ in range(n))
    rules = [(i, word(rnd.choice([3, 5, 6, 7, 8, 9])), f"l{i % 50}") for i in range(50_000)] + [(50_000, "", "empty"), (50_001, None, "null"), (50_002, "z", "one"), (-1, "zz", "two")]
    texts = [(i, " ".join(word(rnd.randint(1, 9)) for _ in range(rnd.randint(0, 20)))) for i in range(150)] + [(900, None), (901, ""), (902, "a z"), (903, "zz"), (904, word(20_000))]
    first = {}
    for o, k, v in rules:
        if k and (k not in first or o < first[k][0]):
            first[k] = (o, v)
    hits = {(i, o, k, v) for i, t in texts for k, (o, v) in first.items() if k in (t or "")}
    rd = spark.createDataFrame(rules, "ordinal int, keyword string, label string")
    td = spark.createDataFrame(texts, "id int, t string")
    assert {tuple(r) for r in rule_hits(td, "id", "t", rd).collect()} == hits
    want = {i: min(((o, v) for j, o, _, v in hits if i == j), default=(0, None))[1] for i, _ in texts}
    assert {r.id: r.label for r in keyword_join(td, "id", "t", rd).collect()} == want
    assert all(r.label is None for r in keyword_join(td, "id", "t", rd.limit(0)).collect())


def test_keyword_rules_meet_few_places_of_a_text(spark):
    texts = [(i, f"{'lorem ipsum ' * 30}hot bolt exposed. vendor brand#{i % 9}. hot {'sit sed ' * 20}énd") for i in range(50)]
    rules = [(b, f"hot bolt exposed. vendor brand#{b}.", f"b{b}") for b in range(9)] + [
        (20, "nd", "end"), (21, "énd", "accent"), (22, "t", "one"), (23, "absent words", "none"), (24, "", "empty")]
    td = spark.createDataFrame(texts, "id long, t string")
    rd = spark.createDataFrame(rules, "ordinal int, keyword string, label string")
    hits = sorted((i, o, k, x) for i, t in texts for o, k, x in rules if k and k in t)
    assert sorted(tuple(r) for r in rule_hits(td, "id", "t", rd).collect()) == hits
    again = rule_hits(td.filter("id < 2").unionAll(td.filter("id < 2")), "id", "t", rd).collect()
    assert sorted(tuple(r) for r in again) == sorted(h for h in hits if h[0] < 2 for _ in range(4))
    long = rd.filter(F.length("keyword") > 2)
    asked = text_heads(td, "id", "t", long).join(keyword_heads(long), "head")
    # twice 'hot ', once 'énd'; the pieces of a text were one row each before
    assert asked.count() == 3 * len(texts)


def test_many_keywords_are_not_broadcast(spark, tmp_path):
    """Rules whose file is small, but not their rows, stay out of the driver."""
    n = 60_000
    spark.range(n).selectExpr("cast(id as int) AS ordinal", "concat('#', id) AS keyword", "'one label' AS label").coalesce(1).write.parquet(f"{tmp_path}/rules")
    rules = spark.read.parquet(f"{tmp_path}/rules")
    assert sum(p.stat().st_size for p in tmp_path.glob("rules/*.parquet")) < 2**20
    texts = spark.createDataFrame([(1, "a #59999 b"), (2, "#7"), (3, "none"), (4, None)], "id int, t string")
    joined = lambda r: text_hits(texts, "id", "t", r)._jdf.queryExecution().executedPlan().toString()
    assert "keyword" not in "".join(x for x in joined(rules).splitlines() if "BroadcastHashJoin" in x)
    assert "BroadcastHashJoin [keyword" in joined(rules.limit(10))
    labelled = keyword_join(texts, "id", "t", rules)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in labelled.splitlines() if "BroadcastHashJoin [keyword" in x]
    want = {(1, f"#{'59999'[:k]}") for k in range(1, 6)} | {(2, "#7")}
    assert {(r.id, r.keyword) for r in rule_hits(texts, "id", "t", rules).collect()} == want
    assert {r.id: r.label for r in keyword_join(texts, "id", "t", rules).collect()} == {1: "one label", 2: "one label", 3: None, 4: None}


def _tfidf(corpus, texts, stop):
    def terms(t):
        tok = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop]
        return tok + [f"{x} {y}" for x, y in zip(tok, tok[1:])]

    docs = [terms(t) for t in corpus]
    df = {}
    for d_ in docs:
        for t in set(d_):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vec(ts):
        v = {}
        for t in ts:
            if t in idf:
                v[t] = v.get(t, 0) + idf[t]
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / n for t, x in v.items()}

    return [vec(d_) for d_ in docs], [vec(terms(t)) for t in texts]


def test_similar_matches_brute_force_with_boosts(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["common"] * 6
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 9)))
    corpus, queries = [text() for _ in range(25)], [text() for _ in range(15)]
    boost = {(q, c): 0.25 for q in range(15) for c in range(25) if (q * 7 + c) % 11 == 0}
    cv, qv = _tfidf(corpus, queries, set())
    want = {}
    for q in range(15):
        scored = []
        for c in range(25):
            s = round(sum(x * cv[c].get(t, 0) for t, x in qv[q].items()) + boost.get((q, c), 0), 6)
            if s >= 0.3:
                scored.append((-s, c))
        want[q] = sorted(scored)[:3]
    cd = spark.createDataFrame(list(enumerate(corpus)), "c int, text string")
    qd = spark.createDataFrame(list(enumerate(queries)), "q int, text string")
    bd = spark.createDataFrame([(q, c, b) for (q, c), b in boost.items()], "q int, c int, boost double")
    got = {q: [] for q in range(15)}
    for row in m.similar(qd, cd, "q", "c", k=3, minimum=0.3, max_terms=None, boosts=bd).orderBy("q", "place").collect():
        got[row.q].append((-row.score, row.c))
    for q in want:
        assert [c for _, c in got[q]] == [c for _, c in want[q]] or all(
            abs(a[0] - b[0]) < 2e-6 for a, b in zip(got[q], want[q]))


def test_texts_are_split_and_shuffled_once(spark):
    """Vector parts against counts, idf and norms; keys may repeat or be NULL."""
    docs = spark.createDataFrame([(1, "Alpha beta beta gamma"), (2, "beta gamma"), (2, "delta gamma"), (None, "beta zeta"), (3, None), (4, "the")], "c long, text string")
    # the words were found anew for each of the five places that name them
    assert docs.select(m.terms(F.col("text")).alias("t"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    counts, n = m.term_counts(docs, "c", "text"), m.document_count(docs, "c")
    idf = m.fit_idf(docs, counts, "c", None)
    lengths = {r.c: r._n for r in m.norms(counts, idf, "c").collect()}
    every = {(r.c, r.term): (r.tf, r.df) for r in counts.join(idf, "term").collect()}
    for asked in (None, ["beta", "beta gamma", "absent"]):
        terms = None if asked is None else spark.createDataFrame([(t,) for t in asked], "term string")
        parts = m.vector_parts(docs, "c", "text", n, terms)
        plan = parts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and plan.count("Repartition") == 1
        rows = parts.collect()
        assert {(r.c, r.term): (r.tf, r.df) for r in rows if r.term} == {k: v for k, v in every.items() if asked is None or k[1] in asked}
        for c, length in lengths.items():
            assert abs(math.sqrt(sum(r.part for r in rows if r.c == c)) - length) < 1e-9
        assert len(rows) == len({(r.c, r.term) for r in rows})


@pytest.mark.parametrize("max_terms", [None, 12])
def test_similar_is_the_same_whichever_side_is_larger(spark, max_terms):
    rnd = random.Random(9)
    made = lambda n: [(i if i % 7 else i // 7 or None, " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randint(0, 9)))) for i in range(n)]
    a, b = made(20), made(60)
    for queries, corpus in ((a, b), (b, a)):
        q, c = spark.createDataFrame(queries, "q long, text string"), spark.createDataFrame(corpus, "c long, text string")
        counts = m.term_counts(c, "c", "text")
        idf = m.fit_idf(c, counts, "c", max_terms)
        left, right = m.weights(m.term_counts(q, "q", "text", idf), idf, "q"), m.weights(counts, idf, "c").select("c", "term", F.col("w").alias("x"))
        scores = left.join(right, "term").groupBy("q", "c").agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("score")).filter("score >= 0.2")
        want = {(r.q, r.c): r.score for r in scores.collect()}
        got = {(r.q, r.c): r.score for r in m.similar(q, c, "q", "c", k=1000, minimum=0.2, max_terms=max_terms).collect()}
        assert len(want) > 40 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_similar_pairs_few_rows(spark):
    """Rows meet on rare terms only: pairs met stay below a tenth of those that share a term."""
    rnd = random.Random(8)
    rare = lambda: f"r{rnd.randrange(4000)}"
    corpus = [" ".join([rare() if rnd.random() < 0.5 else f"common{rnd.randrange(8)}" for _ in range(rnd.randint(8, 30))]) for _ in range(400)]
    queries = [" ".join(rnd.choice(corpus).split()[:12] + [rare(), "common1"]) for _ in range(300)]
    cd = spark.createDataFrame(list(enumerate(corpus)), "c int, text string")
    qd = spark.createDataFrame(list(enumerate(queries)), "q int, text string")
    counts = m.term_counts(cd, "c", "text")
    idf = m.fit_idf(cd, counts, "c", None)
    postings, asked = m.weights(counts, idf, "c"), m.weights(m.term_counts(qd, "q", "text"), idf, "q")
    left, right = m.ranked_terms(asked, postings, "q", 0.3), m.ranked_terms(postings, asked, "c", 0.3)
    met = m.prefix_pairs(left, right, "q", "c")
    every = asked.select("q", "term").join(postings.select("c", "term"), "term").select("q", "c").distinct()
    assert met.count() * 10 < every.count()
    cv, qv = _tfidf(corpus, queries, set())
    want = {}
    for q in range(300):
        s = sorted((-round(sum(x * cv[c].get(t, 0) for t, x in qv[q].items()), 6), c) for c in range(400))[:2]
        want[q] = [x for x in s if -x[0] >= 0.3]
    got = {q: [] for q in range(300)}
    for r in m.similar(qd, cd, "q", "c", k=2, minimum=0.3).orderBy("q", "place").collect():
        got[r.q].append((-r.score, r.c))
    assert sum(map(len, want.values())) > 250
    for q in want:
        assert len(want[q]) == len(got[q]) and all(abs(a[0] - b[0]) < 2e-6 and (a[1] == b[1] or abs(a[0] - b[0]) < 2e-6) for a, b in zip(want[q], got[q]))


def test_staged_tables_are_pruned_and_removed(spark):
    from pathlib import Path

    from scanlake.session import clear_staged, staged

    d = staged(spark.range(10).selectExpr("id", "id * 2 AS x", "'t' AS t"), "some")
    plan = d.filter("id > 3").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,x:bigint>" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan
    path = Path(d.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert path.exists() and clear_staged(spark) >= 1 and not path.exists() and clear_staged(spark) == 0


def test_shared_id_boosts(spark):
    q = spark.createDataFrame([(1, ["CVE-1", "CVE-2"], ["CWE-1"])], "q int, cves array<string>, cwes array<string>")
    c = spark.createDataFrame([(7, ["CVE-1", "CVE-2"], []), (8, [], ["CWE-1"])], "c int, cves array<string>, cwes array<string>")
    assert sorted(map(tuple, m.shared_id_boosts(q, c, "q", "c").collect())) == [(1, 7, 0.25), (1, 8, 0.15)]


def test_group_assignment_first_group_wins(spark):
    f = spark.createDataFrame([("r", "1", "web", "n"), ("r", "2", "web", "n"), ("r", "3", "db", "n"), ("r", "4", "x", "y")],
                              "report_id string, id string, taxonomy_family string, subnet_key string")
    groups = spark.createDataFrame([("r", 1, "web", "n"), ("r", 2, "", "n"), ("r", 3, "db", "n")],
                                   "report_id string, group_pos int, taxonomy_family string, subnet_key string")
    members = spark.createDataFrame([("r", 1, "1"), ("r", 3, "3")], "report_id string, group_pos int, id string")
    got = {x.id: x.group_pos for x in r.assign_to_groups(f, groups, members).collect()}
    assert got == {"1": 1, "2": 2, "3": 2, "4": None}


def _assign(findings, groups, members):
    """Group after group, as a reader would do it by hand."""
    left, out = list(findings), {}
    for pos, fam, net in sorted(groups):
        mine = []
        for i in [i for p, i in members if p == pos]:
            hit = next((f for f in left if f[1] == i), None)
            if hit:
                mine.append(hit)
                left.remove(hit)
        if not mine:
            mine = [f for f in left if (not fam or f[2] == fam) and (not net or f[3] == net)]
            left = [f for f in left if f not in mine]
        out.update({f[0]: pos for f in mine})
    return out


def test_group_assignment_equals_one_group_after_the_other(spark):
    """Ids that earlier groups took, ids that do not exist, repeated ids, chains of fall-backs."""
    rnd = random.Random(11)
    fs, gs, ms, want = [], [], [], {}
    for rep in range(40):
        f = [(n, f"v{rnd.randrange(6)}", rnd.choice("ab"), rnd.choice("xy")) for n in range(rnd.randint(1, 12))]
        g = [(p, rnd.choice(["", "a", "b"]), rnd.choice(["", "x", "y"])) for p in range(1, rnd.randint(2, 7))]
        m_ = [(p, f"v{rnd.randrange(8)}") for p, _, _ in g for _ in range(rnd.randint(0, 3))]
        want.update({(str(rep), n): p for n, p in _assign(f, g, m_).items()} | {(str(rep), n): None for n, *_ in f if n not in _assign(f, g, m_)})
        fs += [(str(rep), *x) for x in f]
        gs += [(str(rep), *x) for x in g]
        ms += [(str(rep), *x) for x in m_]
    fd = spark.createDataFrame(fs, "report_id string, n int, id string, taxonomy_family string, subnet_key string")
    gd = spark.createDataFrame(gs, "report_id string, group_pos int, taxonomy_family string, subnet_key string")
    md = spark.createDataFrame(ms, "report_id string, group_pos int, id string")
    got = {(x.report_id, x.n): x.group_pos for x in r.assign_to_groups(fd, gd, md, order="n").collect()}
    assert got == want and any(v is None for v in want.values())


def test_network_counts_are_exact(spark):
    rnd = random.Random(1)
    nets = [(str(i % 3), f"{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(4)}.0/24") for i in range(4000)] * 2 + [("9", None)]
    got = {x.report_id: x.subnet_count for x in r.network_counts(spark.createDataFrame(nets, "report_id string, subnet string")).collect()}
    assert got == {k: len({n for q, n in nets if q == k}) for k in "012"}


def test_descriptions_count_whole(spark):
    from scanlake.operators.dedupe import dedupe_by_fingerprint
    from scanlake.operators.falsepos import is_false_positive
    from pyspark.sql import functions as F

    long = "x" * 400
    rows = [("r", None, "n", "a", f"{long}{i}", None, None, None, i) for i in range(3)]
    d = spark.createDataFrame(rows, "report_id string, vuln_id string, name string, affected_assets string, description string, observation string, remediation_status string, risk_status string, pos int")
    assert dedupe_by_fingerprint(d).count() == 3
    late = d.select(is_false_positive(F.col("name"), F.col("observation"), F.col("risk_status"), F.concat("description", F.lit(" false positive")), F.lit("5"), F.lit("High")).alias("fp"))
    assert all(r.fp for r in late.collect())


def test_every_cve_of_a_finding_is_looked_up(spark):
    from scanlake.operators.enrich import CVE_FIELDS, KEYS, finding_cves

    ids = [f"CVE-2020-100{i}" for i in range(6)]
    cols = [*KEYS, *[c for c in CVE_FIELDS if c not in KEYS]]
    d = spark.createDataFrame([tuple("1" if c in KEYS else " ".join(ids) for c in cols)], ", ".join(f"{c} string" for c in cols))
    assert [r.cve for r in finding_cves(d).orderBy("ord").collect()] == ids
    assert finding_cves(d, 3).count() == 3


def test_terms_are_counted_where_their_text_is(spark):
    """Texts are dealt by key, and not their many terms; a row's length still counts terms that no query has."""
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (2, "gamma delta"), (None, "alpha"), (4, None)], "c int, text string")
    counts = m.term_counts(docs, "c", "text")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "term" not in plan[plan.index("Exchange hashpartitioning("):].split("\n")[0]
    assert {(r.c, r.term): r.tf for r in counts.collect()} == {
        (1, "alpha"): 2, (1, "beta"): 1, (1, "alpha beta"): 1, (1, "beta alpha"): 1, (2, "beta"): 1, (2, "gamma"): 2,
        (2, "delta"): 1, (2, "beta gamma"): 1, (2, "gamma delta"): 1, (None, "alpha"): 1}
    idf = m.fit_idf(docs, counts, "c", None)
    known = idf.filter("term = 'gamma'")
    assert [tuple(r) for r in m.term_counts(docs, "c", "text", known).collect()] == [(2, "gamma", 2)]
    whole = {(r.c, r.term): r.w for r in m.weights(counts, idf, "c").collect()}
    part = m.weights(m.term_counts(docs, "c", "text", known), known, "c", m.norms(counts, idf, "c")).collect()
    assert [(r.c, r.term) for r in part] == [(2, "gamma")] and abs(part[0].w - whole[2, "gamma"]) < 1e-12
