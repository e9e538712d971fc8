"""Scan rows -> findings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.assets import asset_key, short_label
from scanlake.functions.severity import (
    first_number, severity_override, severity_rank, severity_scan, status_family, status_text,
)
from scanlake.functions.text import (
    drop_nan, key_text, not_blank, or_empty, strip_cell, strip_plugin_id,
)
from scanlake.functions.titles import family_and_title, is_promoted
from scanlake.operators.ordinal import first_k, number_by_pos
from scanlake.session import once, stable, staged

KEYS = ["report_id", "group_name", "status_family"]
SCAN_FIELDS = [
    "name", "severity", "plugin_id", "cve", "cvss", "host", "port", "description",
    "remediation", "plugin_output", "reference", "observation", "remediation_status",
    "risk_status",
]
MERGED = ["description", "remediation", "proof_of_concept", "cve", "cvss", "reference"]


def normalise_rows(scan: DataFrame) -> DataFrame:
    """Clean the logical scan columns; rows without a name are dropped.

    Missing values are NULL from here on.  `scan` has report_id, row_id and the
    logical columns of `resolve_columns`.
    """
    bare = scan.select(
        F.coalesce(F.col("report_id"), F.lit("")).alias("report_id"),
        "row_id",
        *[strip_cell(F.col(c)).alias(c) for c in SCAN_FIELDS],
    )
    clean = bare.withColumns({c: drop_nan(F.col(c)) for c in SCAN_FIELDS})
    named = clean.withColumn("raw_name", strip_plugin_id(F.col("name"))).filter(
        F.col("raw_name") != ""
    )
    return named.select(
        "report_id",
        "row_id",
        "raw_name",
        severity_scan(F.col("severity")).alias("severity"),
        *[
            not_blank(F.col(c)).alias(a)
            for c, a in (
                ("plugin_id", "vuln_id"), ("cve", "cve"), ("cvss", "cvss"), ("host", "host"),
                ("port", "port"), ("description", "description"),
                ("remediation", "remediation"), ("plugin_output", "proof_of_concept"),
                ("reference", "reference"),
            )
        ],
        F.coalesce(not_blank(F.col("observation")), F.lit("New")).alias("observation"),
        F.coalesce(not_blank(F.col("remediation_status")), F.lit("Open")).alias(
            "remediation_status"
        ),
        F.coalesce(not_blank(F.col("risk_status")), F.lit("Open")).alias("risk_status"),
    )


def title_rows(rows: DataFrame) -> DataFrame:
    """Add group_name, display name, asset and status family to normalised rows."""
    staged = rows.withColumns({
        "_lower": key_text(F.col("raw_name")),
        "_status": status_text(
            F.col("observation"), F.col("remediation_status"), F.col("risk_status")
        ),
    })
    return (
        once(staged, {
            "_t": family_and_title(
                F.col("_lower"), F.col("raw_name"), F.col("proof_of_concept")
            ),
            "status_family": status_family(F.col("_status")),
            "asset": not_blank(or_empty(asset_key(F.col("host"), F.col("port")))),
        })
        .withColumns({"group_name": F.col("_t.key"), "name": F.col("_t.title")})
        .drop("_t", "_lower", "_status")
    )


def drop_informational(titled: DataFrame) -> DataFrame:
    """Drop informational rows; those of a promoted family stay and become Low."""
    info = F.col("severity") == "Informational"
    return titled.filter(~info | is_promoted(F.col("group_name"))).withColumn(
        "severity", F.when(info, F.lit("Low")).otherwise(F.col("severity"))
    )


def candidate_rows(scan: DataFrame) -> DataFrame:
    """Everything that happens to a scan row before grouping."""
    return drop_informational(title_rows(normalise_rows(scan)))


HEAD = ["name", "severity", "observation", "remediation_status", "risk_status", "vuln_id"]
_LAST = 2**63 - 1


def _packed(first: Column, *more: tuple[Column, int]) -> Column:
    """Small non-negative numbers as one long, most significant first; each further one with its bits."""
    out = first.cast("long")
    for c, bits in more:
        out = F.shiftleft(out, bits) + c.cast("long")
    return out


def winning_rows(candidates: DataFrame) -> DataFrame:
    """(finding key, first_row, row_count, rows): which row gives the head and each merged text.

    Only ranks, lengths and row ids are aggregated, no text.  A merged text's order
    (preferred title, present, length, earliest row) is one number, so that hash
    aggregation can keep its maximum; the head's order needs two more and is decided
    among the rows that are left after equal ones have been put together.  Numbers are put
    together as longs; only the row id, which needs 64 bits more, makes a decimal of them.
    """
    same = F.col("raw_name").eqNullSafe(F.col("name")) | (key_text(F.col("raw_name")) == key_text(F.col("name")))
    pref = F.when(same, 1).otherwise(0)
    size = lambda c: F.length(or_empty(F.col(c)))
    early = F.lit(_LAST).cast("decimal(20,0)") - F.col("row_id").cast("decimal(20,0)")
    order = lambda c: _packed(pref, (F.col(c).isNotNull(), 1), (size(c), 31))
    wide = lambda c: c.cast("decimal(11,0)") * F.lit(Decimal(2**64)) + early
    orders = ["_" + c + "_order" for c in MERGED]
    narrow = candidates.select(
        *KEYS, "row_id",
        _packed(pref, (severity_rank(F.col("severity")), 4), (F.col("cve").isNotNull(), 1),
                (size("description") + size("remediation"), 32)).alias("_rank"),
        F.coalesce(first_number(F.col("cvss")), F.lit(0.0)).alias("_cvss"),
        *[wide(order(c)).alias(o) for c, o in zip(MERGED, orders)],
    )
    equal = narrow.groupBy(*KEYS, "_rank", "_cvss").agg(
        F.min("row_id").alias("_row"), F.count("*").alias("_n"), *[F.max(o).alias(o) for o in orders])
    best = equal.groupBy(*KEYS).agg(
        F.max(F.struct("_rank", "_cvss", (-F.col("_row")).alias("tie"))).alias("_head"),
        F.min("_row").alias("first_row"), F.sum("_n").alias("row_count"), *[F.max(o).alias(o) for o in orders])
    row = lambda o: (F.lit(_LAST).cast("decimal(38,0)") - F.col(o) % F.lit(Decimal(2**64))).cast("long")
    return best.select(*KEYS, "first_row", "row_count", F.array(-F.col("_head.tie"), *[row(o) for o in orders]).alias("rows"))


def group_findings(candidates: DataFrame) -> DataFrame:
    """One finding per (report, title family, status family).

    The representative row has the best (preferred title, severity, has CVE, text
    length, score); ties go to the lowest row_id.  Each merged text is the longest
    one among the rows that carry the preferred title, or among all rows when none
    does.

    The winners are found by numbers alone, with map-side partials, so a title that
    dominates the estate does not gather its rows in one task; the texts of the
    winning rows, at most seven a finding, are fetched by row id afterwards.  `row_id`
    is unique, and `candidates` is read twice: hand in a staged table.
    """
    best = winning_rows(candidates)
    wanted = best.select(F.posexplode("rows").alias("_role", "row_id")).groupBy("row_id").agg(
        F.collect_set("_role").alias("_roles"))
    texts = candidates.join(wanted, "row_id").select(
        *KEYS, F.struct("_roles", F.struct(*HEAD).alias("head"), *MERGED).alias("_t"))
    listed = texts.groupBy(*KEYS).agg(F.collect_list("_t").alias("_texts"))
    of = lambda i: F.get(F.filter("_texts", lambda t: F.array_contains(t["_roles"], i)), F.lit(0))
    return (
        best.drop("rows").join(listed, KEYS)
        .select(
            *KEYS, of(0)["head"].alias("_head"), *[of(i)[c].alias(c) for i, c in enumerate(MERGED, 1)],
            "first_row", "row_count")
        .select(*KEYS, "_head.*", *MERGED, "first_row", "row_count")
        .withColumn("severity", severity_override(F.col("name"), F.col("severity")))
    )


def finding_assets(candidates: DataFrame) -> DataFrame:
    """(finding key, asset), distinct: the complete asset list as rows.

    A finding may touch millions of hosts, so the list is a table and never one
    array; `asset_summary` makes the bounded display form.
    """
    return candidates.filter(F.col("asset").isNotNull()).select(*KEYS, "asset").distinct()


def asset_summary(assets: DataFrame, keys: list[str] = KEYS, limit: int = 10) -> DataFrame:
    """Per key: asset_count and the first `limit` assets in sorted order as one text."""
    counts = assets.groupBy(*keys).agg(F.count("*").alias("asset_count"))
    shown = (
        first_k(assets, keys, [F.col("asset")], limit)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list("asset")), ", ").alias("_shown"))
    )
    return counts.join(shown, keys).select(
        *keys,
        "asset_count",
        short_label(F.col("_shown"), F.col("asset_count"), limit).alias("affected_assets_short"),
    )


def with_assets(findings: DataFrame, summary: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Left-join the asset summary; a finding without assets counts zero."""
    return findings.join(summary, keys, "left").withColumn(
        "asset_count", F.coalesce(F.col("asset_count"), F.lit(0))
    )


def assign_ids(findings: DataFrame, pos: str = "first_row", prefix: str = "VAPT-") -> DataFrame:
    """Sequential ids per report in the order of first appearance."""
    numbered = number_by_pos(findings, ["report_id"], pos, "_n")
    return numbered.withColumn(
        "id", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"),
                                            F.greatest(F.lit(3), F.length(F.col("_n").cast("string"))),
                                            F.lit("0")))
    ).drop("_n")


def findings_from_scan(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with ids and asset summary, asset table).

    The cleaned and titled rows are staged: ranks, asset keys and the texts of the winning
    rows are read from them, each with its own few columns.  So are the distinct assets,
    which later steps read several times.  The findings are checkpointed
    before they are numbered: numbering reads them twice.
    """
    rows = staged(candidate_rows(scan), "candidates")
    assets = staged(finding_assets(rows), "finding_assets")
    findings = stable(with_assets(group_findings(rows), asset_summary(assets)))
    return assign_ids(findings), assets
