"""Enrichment of findings from CVE, EPSS, weakness, pattern, control and cache tables.

Ids found in a finding are exploded to narrow rows, joined to the catalog and only
then brought back to the finding; the wide finding rows are not shuffled for every
catalog.  No broadcast is forced: Spark broadcasts a catalog when its measured size
is below the session's threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake.functions import ids as I
from scanlake.functions.derive import keep_prior, recommendation_text
from scanlake.functions.severity import epss_label
from scanlake.functions.text import has_text, not_blank, or_empty, strip, trim_text
from scanlake.operators.ordinal import first_k
from scanlake.tables import fixed

KEYS = ["report_id", "id"]
CVE_FIELDS = ["cve", "description", "proof_of_concept", "reference", "name"]
CWE_FIELDS = ["cve", "description", "category", "proof_of_concept", "reference", "name"]
LIST_FRAMEWORKS = ["nist_800_53", "pci_dss", "owasp_wstg", "iso_27001"]


def _text(df: DataFrame, fields: list[str]) -> Column:
    return I.blob(*[F.col(f) for f in fields if f in df.columns])


# --- CVE and EPSS ------------------------------------------------------------------

def finding_cves(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """(finding, ord, cve): the ids named in a finding, the first `limit` where one is stated."""
    ids = I.extract_ids(_text(findings, CVE_FIELDS), I.CVE_STRICT)
    ids = ids if limit is None else F.slice(ids, 1, limit)
    return findings.select(*KEYS, F.posexplode(ids).alias("ord", "cve"))


def join_cves(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """(finding, ord, cve, record fields); ids without a record are dropped."""
    return finding_cves(findings).join(cves, "cve")


def join_epss(cve_rows: DataFrame, epss: DataFrame) -> DataFrame:
    """Left-join EPSS scores and their label to (finding, ord, cve) rows."""
    scored = cve_rows.select(*KEYS, "ord", "cve").join(
        epss.select("cve", "epss", "percentile"), "cve", "left"
    )
    return scored.withColumn("likelihood", epss_label(F.col("epss")))


def epss_text(scored: DataFrame, shown: int = 3) -> DataFrame:
    """Per finding 'CVE: 12.5% (medium); …' of its first `shown` ids; `scored` keeps all."""
    scored = scored.filter(F.col("ord") < shown)
    part = F.concat(
        F.col("cve"), F.lit(": "),
        F.format_string("%.2f", F.round(F.col("epss") * 100, 2)), F.lit("% ("),
        F.col("likelihood"), F.lit(")"),
    )
    parts = F.array_sort(F.collect_list(
        F.when(F.col("epss").isNotNull(), F.struct("ord", part.alias("t")))
    ))
    return scored.groupBy(*KEYS).agg(parts.alias("_p")).select(
        *KEYS,
        F.when(F.size("_p") > 0, F.array_join(F.col("_p.t"), "; ")).otherwise(F.lit("unknown"))
        .alias("epss_text"),
    )


# --- weaknesses ------------------------------------------------------------------------

def collect_weaknesses(findings: DataFrame, cve_rows: DataFrame) -> DataFrame:
    """(finding, ord, cwe_id): weaknesses of the joined CVEs first, then those in the text."""
    from_cves = cve_rows.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("ord", "cwes"))).alias("_c")
    ).select(*KEYS, F.flatten(F.col("_c.cwes")).alias("_cve_cwes"))
    in_text = findings.select(
        *KEYS, I.extract_ids(_text(findings, CWE_FIELDS), I.CWE_STRICT).alias("_text_cwes")
    )
    both = in_text.join(from_cves, KEYS, "left").select(
        *KEYS,
        F.array_distinct(F.concat(
            F.coalesce(F.col("_cve_cwes"), F.array().cast("array<string>")), F.col("_text_cwes")
        )).alias("_all"),
    )
    return both.select(*KEYS, F.posexplode("_all").alias("ord", "cwe_id"))


def weakness_table(catalog: DataFrame, snapshot: DataFrame, learned: DataFrame) -> DataFrame:
    """One row per weakness: catalog (completed by the snapshot), else snapshot, else learned.

    The precedence is settled among the catalogs, before findings are touched.
    """
    snap = snapshot.select(
        "cwe_id", *[F.col(c).alias("_s_" + c) for c in (
            "name", "description", "owasp_category", "control_objective", "control_name")]
    )
    full = catalog.join(snap, "cwe_id", "left").select(
        "cwe_id",
        F.coalesce(not_blank(F.col("name")), F.col("_s_name"), F.lit("")).alias("name"),
        F.coalesce(
            not_blank(strip(F.concat_ws(
                " ", not_blank(or_empty(F.col("description"))),
                not_blank(or_empty(F.col("extended_description")))))),
            F.col("_s_description"), F.lit(""),
        ).alias("description"),
        *[or_empty(F.col("_s_" + c)).alias(c)
          for c in ("owasp_category", "control_objective", "control_name")],
        F.lit("catalog").alias("origin"),
    )
    cols = ["cwe_id", "name", "description", "owasp_category", "control_objective",
            "control_name"]
    rest = snapshot.select(*cols).join(catalog, "cwe_id", "left_anti")
    known = catalog.select("cwe_id").unionByName(snapshot.select("cwe_id"))
    other = learned.select(*cols).join(known, "cwe_id", "left_anti")
    return (
        full.unionByName(rest.withColumn("origin", F.lit("snapshot")))
        .unionByName(other.withColumn("origin", F.lit("learned")))
    )


def join_weakness(weak_rows: DataFrame, table: DataFrame) -> DataFrame:
    """(finding, ord, weakness fields); unknown weaknesses are dropped."""
    return weak_rows.join(table, "cwe_id")


# --- attack patterns ------------------------------------------------------------------------

def pattern_table(bridge: DataFrame, capecs: DataFrame, fallback: DataFrame) -> DataFrame:
    """(cwe_id, rank, pattern): catalog patterns by likelihood and severity; the fallback
    only where the catalog has none."""
    likely = F.when(F.col("likelihood") == "High", 0).when(
        F.col("likelihood") == "Medium", 1).when(F.col("likelihood") == "Low", 2).otherwise(3)
    severe = F.when(F.col("severity") == "Very High", 0).when(
        F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).when(
        F.col("severity") == "Low", 3).otherwise(4)
    unknown = lambda c: F.coalesce(not_blank(F.col(c)), F.lit("Unknown"))
    full = bridge.join(capecs, "capec_id").select(
        "cwe_id",
        F.struct(likely.alias("a"), severe.alias("b"), F.col("capec_id").alias("c")).alias("rank"),
        "capec_id", "name", unknown("likelihood").alias("likelihood"),
        unknown("severity").alias("severity"),
    )
    rest = fallback.join(bridge.select("cwe_id").distinct(), "cwe_id", "left_anti").select(
        "cwe_id",
        F.struct(F.col("ordinal").alias("a"), F.lit(0).alias("b"), F.col("capec_id").alias("c"))
        .alias("rank"),
        "capec_id", "name", "likelihood", "severity",
    )
    return full.unionByName(rest)


def join_patterns(weak_rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(finding, capec_id, …, at): each pattern once per finding, at its first occurrence."""
    return (
        weak_rows.join(patterns, "cwe_id")
        .groupBy(*KEYS, "capec_id")
        .agg(F.min(F.struct("ord", "rank", "name", "likelihood", "severity")).alias("_f"))
        .select(*KEYS, "capec_id", "_f.name", "_f.likelihood", "_f.severity",
                F.struct("_f.ord", "_f.rank").alias("at"))
    )


def top_patterns(pattern_rows: DataFrame, k: int = 2) -> DataFrame:
    """The first k patterns of a finding as one text."""
    part = F.concat_ws("", F.col("capec_id"), F.lit(" - "), F.col("name"),
                       F.lit(" (likelihood: "), F.col("likelihood"), F.lit(")"))
    top = first_k(pattern_rows, KEYS, [F.col("at")], k)
    return top.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("_rank", part.alias("t")))).alias("_p")
    ).select(*KEYS, trim_text(F.array_join(F.col("_p.t"), "; "), 240).alias("patterns_text"))


# --- frameworks and controls -------------------------------------------------------------------

def join_frameworks(weak_rows: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(finding, framework, place, value): SANS keeps its best rank, the OWASP lists the
    first category by weakness order, the other frameworks an ordered distinct list."""
    hits = weak_rows.join(frameworks, "cwe_id")
    firsts = hits.groupBy(*KEYS, "framework", "value").agg(
        F.min(F.struct("ord", "ordinal")).alias("_at")
    )
    single = ~F.col("framework").isin(LIST_FRAMEWORKS)
    order = [
        F.when(F.col("framework") == "sans_top25_rank", F.col("value").try_cast("int")),
        F.col("_at"), F.col("value"),
    ]
    # Distinct values per finding and framework: never more than the framework table has.
    placed = firsts.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*KEYS, "framework").orderBy(*order))
    )
    return placed.filter(~single | (F.col("_rank") == 1)).select(
        *KEYS, "framework", F.col("_rank").alias("place"), "value"
    )


def enrich_controls(items: DataFrame, controls: DataFrame) -> DataFrame:
    """Replace 'AC-3 short title' by the catalog's title where the control is known."""
    keyed = items.withColumn("control_id", F.upper(F.substring_index("value", " ", 1)))
    titles = controls.select(F.col("id").alias("control_id"), F.col("title").alias("_title"))
    return keyed.join(titles, "control_id", "left").withColumn(
        "value",
        F.coalesce(
            F.concat(F.col("control_id"), F.lit(" "), not_blank(F.col("_title"))),
            F.col("value"),
        ),
    ).drop("_title")


# --- cached recommendations ------------------------------------------------------------------------

def title_hash(title: Column, cves: Column, context: Column) -> Column:
    """First 16 hex digits of sha256(title::sorted cves::context), all normalised."""
    ids = F.array_join(F.array_sort(F.array_distinct(F.transform(cves, lambda c: F.upper(strip(c))))), "|")
    ctx = F.lower(strip(or_empty(context)))
    payload = F.concat(F.lower(strip(or_empty(title))), F.lit("::"), ids, F.lit("::"), ctx)
    return F.substring(F.sha2(payload, 256), 1, 16)


def cwe_key(cwes: Column) -> Column:
    clean = F.filter(F.transform(cwes, lambda c: F.upper(strip(c))), lambda c: c != "")
    return F.array_join(F.array_sort(F.array_distinct(clean)), "|")


def rec_keys(findings: DataFrame, weak_rows: DataFrame, cve_rows: DataFrame) -> DataFrame:
    """(finding, cwe_key, severity_key, title_hash); findings without a weakness are dropped."""
    cwes = weak_rows.groupBy(*KEYS).agg(F.collect_list("cwe_id").alias("_cwes"))
    cves = cve_rows.groupBy(*KEYS).agg(F.collect_list("cve").alias("_cves"))
    joined = findings.select(*KEYS, "name", "severity", "description").join(cwes, KEYS).join(
        cves, KEYS, "left"
    )
    none = F.array().cast("array<string>")
    return joined.select(
        *KEYS,
        cwe_key(F.col("_cwes")).alias("cwe_key"),
        F.lower(strip(F.col("severity"))).alias("severity_key"),
        title_hash(F.col("name"), F.coalesce(F.col("_cves"), none), F.col("description"))
        .alias("title_hash"),
    )


REC_FIELDS = [
    "primary_rec", "secondary_rec", "defensive_rec", "control_objective", "control_name",
    "audit_requirement", "business_impact", "quality_score",
]


def best_recommendation(keys: DataFrame, store: DataFrame, minimum: float = 0.72) -> DataFrame:
    """Best cached recommendation: same title hash first, else same weaknesses and severity.

    The store is reduced to one best row per key before it meets the findings, so a
    popular (weakness, severity) pair never multiplies rows.
    """
    good = store.filter(F.col("quality_score") >= minimum)
    best = F.max_by(
        F.struct(*REC_FIELDS), F.struct(F.col("quality_score"), (-F.col("rec_id")).alias("tie"))
    )
    exact = good.groupBy("cwe_key", "severity_key", "title_hash").agg(best.alias("_exact"))
    broad = good.groupBy("cwe_key", "severity_key").agg(best.alias("_broad"))
    return (
        keys.join(exact, ["cwe_key", "severity_key", "title_hash"], "left")
        .join(broad, ["cwe_key", "severity_key"], "left")
        .filter(F.col("_broad").isNotNull())
        .select(
            *KEYS,
            F.when(F.col("_exact").isNotNull(), F.lit("title")).otherwise(F.lit("weakness"))
            .alias("tier"),
            F.coalesce("_exact", "_broad").alias("_r"),
        )
        .select(*KEYS, "tier", "_r.*")
    )


# --- external results ---------------------------------------------------------------------------------

RESULT_FIELDS = ["control_objective", "control_name", "audit_requirement", "business_impact"]


def apply_results(findings: DataFrame, results: DataFrame, key: str = "item_key") -> DataFrame:
    """Left-join looked-up results; filled result fields win.

    The last result of a key counts.  A finding without a result keeps its own
    remediation as the primary tier.
    """
    last = results.groupBy(key).agg(
        F.max_by(F.struct(*RESULT_FIELDS, "primary", "secondary", "defensive"), "pos").alias("_r")
    )
    joined = findings.join(last, key, "left")
    have = set(findings.columns)
    tiers = {
        t: F.when(F.col("_r").isNotNull(), or_empty(F.col(f"_r.{t}"))).otherwise(
            or_empty(F.col("remediation")) if t == "primary" else F.lit("")
        )
        for t in ("primary", "secondary", "defensive")
    }
    out = joined.withColumns({
        **{
            f: F.coalesce(
                not_blank(F.col(f"_r.{f}")),
                F.col(f) if f in have else F.lit(None).cast("string"),
            )
            for f in RESULT_FIELDS
        },
        **{"rec_" + t: c for t, c in tiers.items()},
        "matched": F.col("_r").isNotNull(),
    })
    return out.withColumn(
        "remediation",
        recommendation_text(F.col("rec_primary"), F.col("rec_secondary"), F.col("rec_defensive")),
    ).drop("_r")


SOURCE_OF_TRUTH = [
    "name", "severity", "cvss", "cve", "affected_assets", "observation", "remediation_status",
    "risk_status",
]
PROTECTED = {
    "control_name": "control_name", "reference": "reference", "description": None,
    "business_impact": None, "control_objective": None, "audit_requirement": None,
    "remediation": None,
}


def merge_enrichment(findings: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Merge result columns into findings: results win, except scan fields and values
    that are more specific than the result."""
    renamed = results.select(
        key, *[F.col(c).alias("_n_" + c) for c in results.columns if c != key]
    )
    joined = findings.join(renamed, key, "left")
    out = {}
    for c in results.columns:
        if c == key or c in SOURCE_OF_TRUTH:
            continue
        new = F.col("_n_" + c)
        if c not in findings.columns:
            out[c] = new
            continue
        merged = F.when(has_text(new), new).otherwise(F.col(c))
        if c in PROTECTED:
            merged = F.when(keep_prior(F.col(c), merged, PROTECTED[c]), F.col(c)).otherwise(merged)
        out[c] = merged
    return joined.withColumns(out).drop(*[c for c in joined.columns if c.startswith("_n_")])


def deterministic_refs(cve_rows: DataFrame, weakness_rows: DataFrame, limit: int = 8) -> DataFrame:
    """(finding, refs): advisory links of its CVEs (two per CVE) and weakness pages."""
    ref = lambda t, u: F.struct(t.alias("title"), u.alias("url"))
    links = F.filter(
        F.transform(F.slice("references", 1, 2), lambda r: r["url"]), lambda u: or_empty(u) != ""
    )
    from_cve = cve_rows.select(
        *KEYS, F.lit(0).alias("_k"), "ord",
        F.concat(
            F.array(ref(F.concat(F.lit("NVD Advisory: "), F.col("cve")),
                        F.concat(F.lit(fixed.NVD_URL), F.col("cve")))),
            F.transform(links, lambda u: ref(u, u)),
        ).alias("_refs"),
    )
    number = F.replace(F.col("cwe_id"), F.lit("CWE-"), F.lit(""))
    title = F.btrim(
        F.concat(F.lit("MITRE "), F.col("cwe_id"), F.lit(": "), or_empty(F.col("name"))),
        F.lit(": "),
    )
    from_cwe = weakness_rows.select(
        *KEYS, F.lit(1).alias("_k"), "ord",
        F.array(ref(title, F.concat(F.lit(fixed.CWE_URL), number, F.lit(".html")))).alias("_refs"),
    )
    gathered = from_cve.unionByName(from_cwe).groupBy(*KEYS).agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_k", "ord", "_refs"))), lambda s: s["_refs"]
            )
        ).alias("_all")
    )
    none = F.array().cast("array<struct<title:string,url:string>>")
    return gathered.select(*KEYS, I.merge_refs(F.col("_all"), none, limit).alias("refs"))


# --- statistics ------------------------------------------------------------------------------------------

def already_resolved(primary: Column, refs: Column) -> Column:
    """Has a primary recommendation tier and at least one reference."""
    return (or_empty(primary) != "") & (F.coalesce(F.size(refs), F.lit(0)) > 0)


def enrichment_stats(findings: DataFrame, resolved: Column, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total_findings"),
        F.count_if(~resolved).alias("eligible_findings"),
        F.count_if(resolved).alias("resolved_locally"),
    )


def ready_first(findings: DataFrame, pending: Column, pos: str) -> DataFrame:
    """Ready and pending findings as one frame, ready ones first, each in input order."""
    return findings.withColumn("pending", pending).orderBy("pending", pos)


def catalog_stats(catalogs: dict[str, DataFrame], store: DataFrame) -> DataFrame:
    """(catalog, rows, high_quality): row counts; the cache also counts scores >= 0.8."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("catalog"), "rows", F.lit(None).cast("long").alias("high_quality"))
        for name, df in catalogs.items()
    ]
    parts.append(
        store.agg(F.count("*").alias("rows"),
                  F.count_if(F.col("quality_score") >= 0.8).alias("high_quality"))
        .select(F.lit("recommendations").alias("catalog"), "rows", "high_quality")
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
