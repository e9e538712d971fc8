"""Queries over documents: cleaning, chunks, evidence, privacy, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import duck as d
from queries.views import table, view
from scanlake.functions import ids as I
from scanlake.functions.text import (
    is_evidence, is_noisy_line, report_text, slug, trim_text, truncate_words,
)
from scanlake.operators import lines as L
from scanlake.operators import match as m
from scanlake.operators import privacy as P
from scanlake.operators import rollup as r
from scanlake.session import barrier
from scanlake.sources.scans import explode_lines
from scanlake.tables import fixed


def texts(spark, sf):
    return view(spark, sf, "scan_texts")


def documents(spark, sf):
    return table(spark, sf, "documents")


def clean_lines(spark, sf):
    return L.clean_texts(texts(spark, sf))


def doc_lines(spark, sf):
    return explode_lines(texts(spark, sf)).select(
        "doc_id", "line_no", "line", L.is_boundary(F.col("line")).alias("boundary"),
        is_noisy_line(F.col("line")).alias("noisy"))


def chunks(spark, sf):
    return L.chunk_texts(texts(spark, sf))


def chunk_estimate(spark, sf):
    return L.estimate_chunks(texts(spark, sf))


def word_limit(spark, sf):
    t = texts(spark, sf)
    return L.limit_words(t, L.clean_texts(t), 300).select(
        "doc_id", "words_before", "words_after", "truncated", F.md5("text").alias("digest"))


def report_texts(spark, sf):
    t = texts(spark, sf).withColumn("_r", report_text(F.col("text")))
    return t.select(
        "doc_id", F.md5("_r").alias("digest"), F.length("_r").alias("n"),
        trim_text(F.col("text"), 220).alias("trimmed"),
        slug(F.col("text")).alias("slug"),
        F.md5(truncate_words(F.col("text"), 50)).alias("head"),
    )


def evidence_lines(spark, sf):
    """Texts that read like evidence, with markers planted by document number."""
    t = documents(spark, sf).withColumn(
        "text",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Request one\nURL two\n"), F.col("text")))
        .when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit("\nSteps to Reproduce: x")))
        .otherwise(F.col("text")))
    return t.select("doc_id", is_evidence(F.col("text")).alias("evidence"))


def redact(spark, sf):
    out = P.redact(documents(spark, sf), ["text"])
    return out.select("doc_id", F.size("entities").alias("n"), F.md5("text").alias("digest"))


def entities(spark, sf):
    found = barrier(P.assign_placeholders(documents(spark, sf), ["text"]).select("doc_id", "entities"))
    return found.select("doc_id", F.inline("entities")).select("doc_id", "placeholder", "original")


def restore(spark, sf):
    out = P.restore(P.redact(documents(spark, sf), ["text"]), ["text"])
    return out.select("doc_id", F.md5("text").alias("digest"))


def leak_check(spark, sf):
    raw = documents(spark, sf)
    before = P.leak_check(raw, ["doc_id"], ["text"]).withColumn("stage", F.lit("before"))
    after = P.leak_check(P.redact(raw, ["text"]), ["doc_id"], ["text"]).withColumn(
        "stage", F.lit("after"))
    return before.unionByName(after).groupBy("stage", "field", "kind").agg(F.count("*").alias("n"))


def page_refs(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", I.url_host(F.col("url")).alias("host"),
        I.canonical_url(F.col("url")).alias("canonical"),
        I.ref_priority(F.col("url")).alias("priority"),
        I.is_public_host(F.col("url")).alias("public"))


_LINKS = """concat(url, ' see https://owasp.org/t/', CAST(page_id % 3 AS STRING), '/?q=1 and http://sub.nist.gov/', CAST(page_id % 4 AS STRING),
 ' https://OWASP.org/t/', CAST(page_id % 3 AS STRING), chr(10), 'Vendor note ', CAST(page_id % 5 AS STRING), chr(10), 'short', chr(10), 'OWASP Web Security Top 10',
 chr(10), 'https://10.0.0.1/x https://ubuntu.com/security/', CAST(page_id AS STRING), ' https://example.org/a')"""
_IDS = "concat('CVE-2021-', CAST(1000 + page_id % 50 AS STRING), ' cve-2021-1001 CVE-2020-77 CVE-2019-12345 cwe-79 CWE-', CAST(page_id % 30 AS STRING), ' CWE-20')"


def _page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(_LINKS).alias("links"),
                                            F.expr(_IDS).alias("ids"))


def canonical_refs(spark, sf):
    refs = F.concat(I.refs_array(F.col("links")), I.auto_refs(F.col("ids"), F.col("ids")))
    return _page_links(spark, sf).select("page_id", F.posexplode(refs).alias("i", "r")).select(
        "page_id", "i", "r.title", "r.url")


def rank_refs(spark, sf):
    base = _page_links(spark, sf).withColumn(
        "refs", F.concat(I.refs_array(F.col("links")), I.auto_refs(F.col("ids"), F.col("ids"))))
    return base.select("page_id", F.posexplode(I.rank_refs(F.col("refs"))).alias("i", "r")).select(
        "page_id", "i", "r.title", "r.url")


def similar_documents(spark, sf):
    q = table(spark, sf, "benchmark")
    return m.similar(q, documents(spark, sf), "item_id", "doc_id", k=3, minimum=0.10,
                     max_terms=None)


def nearest_control(spark, sf):
    c = table(spark, sf, "benchmark")
    return m.similar(documents(spark, sf), c, "doc_id", "item_id", k=1, minimum=0.30,
                     max_terms=None).drop("place")


def determinism_audit(spark, sf):
    runs = _runs(spark, sf)
    return r.determinism_audit(runs, F.col("key"), ["lang", "size", "head"])


def determinism_totals(spark, sf):
    return r.audit_totals(_runs(spark, sf), F.col("key"), ["lang", "size", "head"])


def top_varying(spark, sf):
    return r.top_varying(r.determinism_audit(_runs(spark, sf), F.col("key"),
                                             ["lang", "size", "head"])).drop("samples")


def _runs(spark, sf):
    return documents(spark, sf).select(
        F.col("source").alias("key"), "lang",
        F.floor(F.col("n_chars") / 1000).cast("string").alias("size"),
        F.md5("text").alias("head"))


QUERIES = {
    "clean_lines": clean_lines,
    "doc_lines": doc_lines,
    "chunks": chunks,
    "chunk_estimate": chunk_estimate,
    "word_limit": word_limit,
    "report_texts": report_texts,
    "evidence_lines": evidence_lines,
    "redact": redact,
    "entities": entities,
    "restore": restore,
    "leak_check": leak_check,
    "page_refs": page_refs,
    "canonical_refs": canonical_refs,
    "rank_refs": rank_refs,
    "similar_documents": similar_documents,
    "nearest_control": nearest_control,
    "determinism_audit": determinism_audit,
    "determinism_totals": determinism_totals,
    "top_varying": top_varying,
}

_NL = "chr(10)"


def _rx(patterns) -> str:
    return d.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))


_LINES = f"""{d.TEXTS},
l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM
 (SELECT doc_id, string_split(CASE WHEN ends_with(text, {_NL}) THEN substr(text, 1, length(text) - 1) ELSE text END, {_NL}) AS x FROM scan_texts WHERE text <> '')),
s AS (SELECT *, {d.sq('line')} AS s, lag({d.sq('line')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM l)"""

_CLEAN = f"""{_LINES},
keep AS (SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY line_no) AS rn FROM s
   WHERE s <> '' AND length(s) >= 4 AND NOT regexp_matches(s, {_rx(fixed.NOISE_PATTERNS)})) WHERE rn = 1
  UNION ALL SELECT doc_id, line_no, line FROM s WHERE s = '' AND coalesce(prev, 'x') <> ''),
cleaned AS (SELECT t.doc_id, coalesce(string_agg(line, {_NL} ORDER BY line_no), '') AS text FROM scan_texts t LEFT JOIN keep USING (doc_id) GROUP BY t.doc_id)"""

_W = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
_BOUNDS = f"""{_LINES},
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS bn FROM l WHERE regexp_matches(line, {_rx(fixed.BOUNDARY_PATTERNS)})),
bc AS (SELECT t.doc_id, count(b.line_no) AS n, any_value({_W.format(x='text')}) AS w FROM scan_texts t LEFT JOIN b USING (doc_id) GROUP BY t.doc_id),
sized AS (SELECT *, len(w) AS nw, greatest(800, len(w) // greatest(1, len(w) // 2000)) AS size FROM bc)"""

_CHUNKED = _CLEAN.replace("l AS (SELECT doc_id, unnest", "l0 AS (SELECT doc_id, unnest").replace("FROM l)", "FROM l0)") + f""",
l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM
 (SELECT doc_id, string_split(CASE WHEN ends_with(text, {_NL}) THEN substr(text, 1, length(text) - 1) ELSE text END, {_NL}) AS x FROM cleaned WHERE text <> '')),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS bn FROM l WHERE regexp_matches(line, {_rx(fixed.BOUNDARY_PATTERNS)})),
bc AS (SELECT t.doc_id, count(b.line_no) AS n, any_value({_W.format(x='text')}) AS w FROM cleaned t LEFT JOIN b USING (doc_id) GROUP BY t.doc_id),
sized AS (SELECT *, len(w) AS nw, greatest(800, len(w) // greatest(1, len(w) // 2000)) AS size FROM bc),
ch AS (SELECT l.doc_id, l.line_no, l.line, (SELECT max(bn) FROM b WHERE b.doc_id = l.doc_id AND b.line_no <= l.line_no) // 6 AS c FROM l JOIN sized USING (doc_id) WHERE n >= 3),
allch AS (SELECT doc_id, {d.sq(f'string_agg(line, {_NL} ORDER BY line_no)')} AS chunk FROM ch WHERE c IS NOT NULL GROUP BY doc_id, c
 UNION ALL SELECT doc_id, array_to_string(w[i * size + 1:(i + 1) * size], ' ') FROM (SELECT *, unnest(range(0, CAST(ceil(nw / size::DOUBLE) AS BIGINT))) AS i FROM sized WHERE n < 3 AND nw > 0)
 UNION ALL SELECT t.doc_id, t.text FROM cleaned t JOIN sized USING (doc_id) WHERE n < 3 AND nw = 0)"""

_PUBLIC = "regexp_matches({h}, '^(?:.*[.])?(?:" + "|".join(x.replace(".", "[.]") for x in fixed.PUBLIC_DOMAINS) + ")$')"
_SCHEMA = "regexp_matches({h}, '^(?:[a-z_]+\\.)+(?:" + "|".join(fixed.SCHEMA_SUFFIXES) + ")$')"
_PRIVATE = "(NOT " + _SCHEMA.format(h="lower(v)") + " AND NOT " + _PUBLIC.format(h="lower(v)") + ")"
_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_PUBURL = "(regexp_matches(lower({u}), '^https?://') AND NOT regexp_matches(" + _HOST + ", '^(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') AND " + _PUBLIC.replace("{h}", _HOST) + ")"
_RXS = {
    "IP": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?\b",
    "HOST": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "USER": r"\b[A-Za-z0-9._-]+\\[A-Za-z0-9._-]+\b",
    "URL": r"(?i)\bhttps?://[^\s<>'" + '"`]+',
}
_LAB = d.lit("(?im)^(" + fixed.LABEL_ALTERNATION + r")\s*[:=]\s*(.+)$")


def _hits(name: str, det: int, x: str = "text", src: str = "documents") -> str:
    e = f"regexp_extract_all({x}, {d.lit(_RXS[name])})"
    v = "regexp_replace(v, '[).,;]+$', '')" if name == "URL" else "v"
    cond = {"HOST": _PRIVATE, "URL": "NOT " + _PUBURL.format(u="regexp_replace(v, '[).,;]+$', '')")}.get(name, "TRUE")
    return f"SELECT doc_id, '{name}' AS prefix, {v} AS v, {det} AS det, pos FROM (SELECT doc_id, unnest({e}) AS v, generate_subscripts({e}, 1) AS pos FROM {src}) WHERE {cond}"


_PREFIX = "CASE " + " ".join(f"WHEN lower(label) IN {d.inlist(v)} THEN '{k}'" for k, v in fixed.LABEL_PREFIX.items()) + " ELSE 'CONTEXT' END"
_ENT = f"""ent AS (SELECT doc_id, {_PREFIX} AS prefix, {d.sq('v')} AS v, 1 AS det, pos FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_LAB}, 1)) AS label,
   unnest(regexp_extract_all(text, {_LAB}, 2)) AS v, generate_subscripts(regexp_extract_all(text, {_LAB}, 2), 1) AS pos FROM documents)
 UNION ALL {_hits('URL', 2)} UNION ALL {_hits('EMAIL', 3)} UNION ALL {_hits('USER', 4)} UNION ALL {_hits('IP', 5)} UNION ALL {_hits('HOST', 6)}),
firsts AS (SELECT doc_id, v, arg_min(prefix, row(det, pos)) AS prefix, min(row(det, pos)) AS seen_at FROM ent WHERE v <> '' AND NOT regexp_matches(v, '^\\[[A-Z]+_[0-9]+\\]$') GROUP BY doc_id, v),
numbered AS (SELECT *, concat('[', prefix, '_', row_number() OVER (PARTITION BY doc_id, prefix ORDER BY seen_at), ']') AS placeholder FROM firsts),
maps AS (SELECT doc_id, list(concat(v, chr(1), placeholder) ORDER BY length(v) DESC, seen_at) AS m, count(*) AS n FROM numbered GROUP BY doc_id),
red AS (SELECT t.doc_id, coalesce(n, 0) AS n, t.text AS original, CASE WHEN m IS NULL THEN t.text ELSE
  list_reduce(m, lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), t.text) END AS text FROM documents t LEFT JOIN maps USING (doc_id))"""

_CANON = "concat(lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '://', lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''))"
_PRIO = "CASE WHEN " + _HOST + " = '' THEN 9 " + " ".join(f"WHEN contains(lower(regexp_extract({{u}}, '://([^?#]*)', 1)), '{k}') THEN {v}" for k, v in fixed.DOMAIN_PRIORITY) + " ELSE 5 END"

_URL_RX = d.lit("(?i)https?://[^\\s<>\\])\"']+")
_REFS = f"""p AS (SELECT page_id, {_LINKS} AS links, {_IDS} AS ids FROM pages),
u AS (SELECT page_id, v AS title, v AS url, 1 AS part, min(pos) AS pos FROM (SELECT page_id, unnest(regexp_extract_all(links, {_URL_RX})) AS v, generate_subscripts(regexp_extract_all(links, {_URL_RX}), 1) AS pos FROM p) GROUP BY page_id, v),
t AS (SELECT page_id, v AS title, '' AS url, 2 AS part, pos FROM (SELECT page_id, trim(unnest(x), ' -' || chr(9) || chr(13)) AS v, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, string_split(regexp_replace(links, {_URL_RX}, chr(10), 'g'), chr(10)) AS x FROM p)) WHERE length(v) >= 8 AND lower(v) NOT IN {d.inlist(fixed.STOCK_REFERENCES)}),
c AS (SELECT page_id, concat('NVD ', v) AS title, concat('{fixed.NVD_URL}', v) AS url, 3 AS part, pos FROM (SELECT page_id, v, min(pos) AS pos, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS rn FROM
   (SELECT page_id, upper(unnest(regexp_extract_all(ids, '(?i)CVE-[0-9]{{4}}-[0-9]{{3,7}}'))) AS v, generate_subscripts(regexp_extract_all(ids, '(?i)CVE-[0-9]{{4}}-[0-9]{{3,7}}'), 1) AS pos FROM p) GROUP BY page_id, v) WHERE rn <= 3),
w AS (SELECT page_id, v AS title, concat('{fixed.CWE_URL}', replace(v, 'CWE-', ''), '.html') AS url, 4 AS part, pos FROM (SELECT page_id, v, min(pos) AS pos, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS rn FROM
   (SELECT page_id, upper(unnest(regexp_extract_all(ids, '(?i)CWE-[0-9]{{1,5}}'))) AS v, generate_subscripts(regexp_extract_all(ids, '(?i)CWE-[0-9]{{1,5}}'), 1) AS pos FROM p) GROUP BY page_id, v) WHERE rn <= 2),
refs AS (SELECT page_id, title, url, row_number() OVER (PARTITION BY page_id ORDER BY part, pos) - 1 AS i FROM (SELECT * FROM u UNION ALL SELECT * FROM t UNION ALL SELECT * FROM c UNION ALL SELECT * FROM w)),
dd AS (SELECT *, CASE WHEN url = '' THEN 0 WHEN NOT {_PUBURL.format(u='url')} THEN 1 ELSE 2 END AS grp FROM (SELECT *, row_number() OVER (PARTITION BY page_id, CASE WHEN url <> '' THEN {_CANON.format(u='url')} ELSE title END ORDER BY i) AS rn FROM refs) WHERE rn = 1),
rk AS (SELECT page_id, title, url, row_number() OVER (PARTITION BY page_id ORDER BY grp, CASE WHEN grp = 2 THEN {_PRIO.format(u='url')} ELSE 0 END, CASE WHEN grp = 2 THEN title ELSE '' END, i) - 1 AS i FROM dd)"""


def _tfidf(q: str, qk: str, c: str, ck: str, k: int, minimum: float, cap: int | None) -> str:
    def tok(t: str, key: str) -> str:
        return f"""{t}_tok AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {d.inlist(fixed.STOP_WORDS)}) AS x FROM {t}),
        {t}_cnt AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(x) AS term FROM {t}_tok UNION ALL
          SELECT {key}, unnest(list_transform(range(1, len(x)), lambda i: concat(x[i], ' ', x[i + 1]))) FROM {t}_tok) GROUP BY ALL)"""

    limit = f"ORDER BY sum(tf) DESC, term LIMIT {cap}" if cap else ""
    return f"""WITH {tok(q, qk)}, {tok(c, ck)},
    voc AS (SELECT term, ln((1 + (SELECT count(DISTINCT {ck}) FROM {c})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM {c}_cnt GROUP BY term {limit}),
    qw AS (SELECT {qk}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {qk})) AS w FROM {q}_cnt JOIN voc USING (term)),
    cw AS (SELECT {ck}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {ck})) AS w FROM {c}_cnt JOIN voc USING (term)),
    sc AS (SELECT {qk}, {ck}, round(sum(qw.w * cw.w), 6) AS score FROM qw JOIN cw USING (term) GROUP BY {qk}, {ck})
    SELECT {qk}, {ck}, score{', place' if k > 1 else ''} FROM (SELECT *, row_number() OVER (PARTITION BY {qk} ORDER BY score DESC, {ck}) AS place FROM sc WHERE score >= {minimum}) WHERE place <= {k}"""


_RUNS = "runs AS (SELECT trim(lower(source)) AS key, lang, CAST(n_chars // 1000 AS VARCHAR) AS size, md5(text) AS head FROM documents), vals AS (" + " UNION ".join(
    f"SELECT key, '{c}' AS field, {d.sq(d.oe(c))} AS value FROM runs" for c in ("lang", "size", "head")) + ")"
_NOISY_VIS = "regexp_replace({s}, '\\s', '', 'g')"


def _noisy(x: str) -> str:
    s = d.sq(x)
    vis = f"regexp_replace({s}, '\\s', '', 'g')"
    n = f"length({vis})"
    punct = f"length(regexp_replace({vis}, '[\\p{{L}}\\p{{N}}]', '', 'g'))"
    rx = d.lit("[\\p{L}\\p{N}.,:;/\\-_()\\[\\]{}'\"%#@&+=<>!?*|\\\\]")
    weird = f"length(regexp_replace({vis}, {rx}, '', 'g'))"
    return (f"CASE WHEN {s} = '' THEN FALSE WHEN regexp_matches({s}, '^[.\\-\\[\\]]{{3,}}$') THEN TRUE WHEN regexp_matches(lower({s}), '^[- ]*snip[- ]*$') THEN TRUE "
            f"WHEN contains(lower({s}), '_x000d_') THEN TRUE WHEN {n} < 16 THEN FALSE ELSE {weird} / {n}::DOUBLE >= 0.12 OR ({punct} / {n}::DOUBLE >= 0.45 AND ({n} - {punct}) / {n}::DOUBLE <= 0.55) END")


_RT = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: " + d.sq("regexp_replace(x, '[ \\t]+', ' ', 'g')") + "), lambda x: x <> '')"
_EV = f"(SELECT doc_id, {_RT.format(t='t0')} AS ls FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('Request one', chr(10), 'URL two', chr(10), text) WHEN doc_id % 7 = 0 THEN concat(text, chr(10), 'Steps to Reproduce: x') ELSE text END AS t0 FROM documents))"

ORACLE = {
    "clean_lines": d.q(_CLEAN, "SELECT doc_id, text FROM cleaned"),
    "doc_lines": d.q(_LINES, f"SELECT doc_id, line_no, line, regexp_matches(line, {_rx(fixed.BOUNDARY_PATTERNS)}) AS boundary, {_noisy('line')} AS noisy FROM l"),
    "chunks": d.q(_BOUNDS + f""",
      ch AS (SELECT l.doc_id, l.line_no, l.line, (SELECT max(bn) FROM b WHERE b.doc_id = l.doc_id AND b.line_no <= l.line_no) // 6 AS c FROM l JOIN sized USING (doc_id) WHERE n >= 3),
      bch AS (SELECT doc_id, TRUE AS by_boundary, c AS chunk_no, {d.sq(f'string_agg(line, {_NL} ORDER BY line_no)')} AS chunk FROM ch WHERE c IS NOT NULL GROUP BY doc_id, c),
      wch AS (SELECT doc_id, FALSE AS by_boundary, i AS chunk_no, array_to_string(w[i * size + 1:(i + 1) * size], ' ') AS chunk FROM (SELECT *, unnest(range(0, CAST(ceil(nw / size::DOUBLE) AS BIGINT))) AS i FROM sized WHERE n < 3 AND nw > 0))""",
      "SELECT * FROM bch UNION ALL SELECT * FROM wch UNION ALL SELECT t.doc_id, FALSE, 0, t.text FROM scan_texts t JOIN sized USING (doc_id) WHERE n < 3 AND nw = 0"),
    "chunk_estimate": d.q(_BOUNDS, "SELECT doc_id, n AS boundaries, CAST(greatest(1, CASE WHEN n < 3 THEN ceil(nw / size::DOUBLE) ELSE ceil(n / 6.0) END) AS INTEGER) AS chunks FROM sized"),
    "word_limit": d.q(_CLEAN + f", ww AS (SELECT c.doc_id, c.text, {_W.format(x='t.text')} AS w0, {_W.format(x='c.text')} AS w FROM cleaned c JOIN scan_texts t USING (doc_id))",
      "SELECT doc_id, len(w0) AS words_before, len(w) AS words_after, len(w) > 300 AS truncated, md5(CASE WHEN len(w) > 300 THEN array_to_string(w[1:300], ' ') ELSE text END) AS digest FROM ww"),
    "report_texts": d.q(d.TEXTS + f", rt AS (SELECT doc_id, text, array_to_string({_RT.format(t='text')}, chr(10)) AS r, {_W.format(x='text')} AS w FROM scan_texts)",
      f"""SELECT doc_id, md5(r) AS digest, length(r) AS n, CASE WHEN length({d.sq('text')}) <= 220 THEN {d.sq('text')} ELSE concat(rtrim(substr({d.sq('text')}, 1, 217)), '...') END AS trimmed,
       trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
       md5(CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[1:50], ' ') END) AS head FROM rt"""),
    "evidence_lines": f"""SELECT doc_id, NOT {d.placeholder('array_to_string(ls, chr(10))')} AND ({d.anyc('lower(array_to_string(ls, chr(10)))', fixed.EVIDENCE_MARKERS)}
       OR len(list_filter(ls, lambda x: regexp_matches(lower(x), '^(?:{'|'.join(fixed.EVIDENCE_PREFIXES)})'))) >= 2 OR len(list_filter(ls, lambda x: {_noisy('x')})) > 0) AS evidence FROM {_EV}""",
    "redact": d.q(_ENT, "SELECT doc_id, n, md5(text) AS digest FROM red"),
    "entities": d.q(_ENT, "SELECT doc_id, placeholder, v AS original FROM numbered"),
    "restore": "SELECT doc_id, md5(text) AS digest FROM documents",
    "leak_check": d.q(_ENT + f", both_ AS (SELECT 'before' AS stage, doc_id, text FROM documents UNION ALL SELECT 'after', doc_id, text FROM red)",
      " UNION ALL ".join(f"SELECT stage, 'text' AS field, '{k}' AS kind, count(*) AS n FROM (SELECT stage, unnest(regexp_extract_all(text, {d.lit(_RXS[n])})) AS v FROM both_) WHERE {_PRIVATE if n == 'HOST' else 'TRUE'} GROUP BY stage" for k, n in (("ip", "IP"), ("host", "HOST"), ("email", "EMAIL")))),
    "page_refs": f"SELECT page_id, url, {_HOST.format(u='url')} AS host, {_CANON.format(u='url')} AS canonical, {_PRIO.format(u='url')} AS priority, {_PUBURL.format(u='url')} AS public FROM pages",
    "canonical_refs": d.q(_REFS, "SELECT page_id, i, title, url FROM refs"),
    "rank_refs": d.q(_REFS, "SELECT page_id, i, title, url FROM rk WHERE i < 10"),
    "similar_documents": _tfidf("benchmark", "item_id", "documents", "doc_id", 3, 0.10, None),
    "nearest_control": _tfidf("documents", "doc_id", "benchmark", "item_id", 1, 0.30, None),
    "determinism_audit": d.q(_RUNS, "SELECT key, field, count(*) AS distinct_values, array_to_string(list_sort(list(value))[1:3], ' | ') AS samples FROM vals GROUP BY key, field HAVING count(*) > 1"),
    "determinism_totals": d.q(_RUNS, "SELECT count(*) AS total_fields, count(*) FILTER (n > 1) AS varying_fields, round(100.0 * count(*) FILTER (n > 1) / count(*), 1) AS percent FROM (SELECT count(*) AS n FROM vals GROUP BY key, field)"),
    "top_varying": d.q(_RUNS, "SELECT key, field, count(*) AS distinct_values FROM vals GROUP BY key, field HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 20"),
}
