"""Scan texts and their extraction replies -> report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions import assets as A
from scanlake.operators import dedupe as dd
from scanlake.operators import falsepos as fp
from scanlake.operators import lines as L
from scanlake.operators import presentation as p
from scanlake.operators import responses as R
from scanlake.operators.ordinal import number_by_order
from scanlake.plans.finish import ID_KEYS, finish_report
from scanlake.session import staged

FIELDS = [
    "name", "severity", "cvss", "cve", "affected_assets", "description", "remediation",
    "vuln_id", "observation", "remediation_status", "risk_status",
]


def text_chunks(docs: DataFrame, per_chunk: int = 6) -> DataFrame:
    """(doc_id, chunk_no, chunk) of the cleaned texts: what an extraction step reads."""
    return L.chunk_texts(L.clean_texts(docs), per_chunk)


def text_report(replies: DataFrame, min_pass: float = 0.55) -> dict[str, DataFrame]:
    """Replies (doc_id, chunk_no, raw) -> report tables, and the replies in quarantine.

    A document is one report.  Findings keep the order of chunks and items, are
    de-duplicated, numbered, validated and split like those of a structured scan, and end
    the same way: references, quality, composition, metadata.
    """
    parsed = staged(R.parse_responses(replies), "replies")
    items = R.explode_findings(parsed, ["doc_id", "chunk_no"]).withColumnRenamed(
        "doc_id", "report_id")
    placed = number_by_order(items, ["report_id"], [F.col("chunk_no"), F.col("item_no")], "pos")
    kept = dd.dedupe_findings(placed, FIELDS)
    numbered = number_by_order(kept, ["report_id"], [F.col("pos")], "n")
    n = F.col("n").cast("string")
    with_id = numbered.withColumn(
        "id", F.concat(F.lit("VAPT-"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))
    ).withColumns({
        "category": A.category_of(
            A.assets_array(F.col("affected_assets")), F.lit(""), F.col("name"),
            F.col("description")),
        **{c: F.lit(None).cast("string") for c in ("control_name", "audit_requirement")},
    })
    flagged = staged(fp.flag_false_positives(p.validate_findings(with_id)), "flagged")
    assets = flagged.filter("NOT is_fp").select(
        *ID_KEYS, F.explode(A.clean_assets(A.assets_array(F.col("affected_assets")))).alias("asset")).distinct()
    plain = flagged.drop("affected_assets").withColumn("reference", F.lit(None).cast("string"))
    return {**finish_report(plain, assets, min_pass), "quarantine": R.quarantine(parsed)}
