"""The look-up loop: requests out, replies in, results merged into findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.derive import recommendation_text
from scanlake.functions.ids import reference_text
from scanlake.functions.text import not_blank
from scanlake.operators import enrich as E
from scanlake.operators import responses as R
from scanlake.operators.privacy import restore
from scanlake.session import staged

KEYS = ["report_id", "id"]
TEXTS = ["control_objective", "control_name", "audit_requirement", "business_impact", "remediation", "reference"]


def lookup_requests(findings: DataFrame) -> DataFrame:
    """(finding, item_key, payload, restore_map) of the findings that need a look-up."""
    wanted = findings.filter("needs_lookup")
    return R.request_payloads(wanted, [*KEYS, "item_key"])


def lookup_results(replies: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """`results` (item_key and result texts) of replies (reply_no, raw), and `unread` replies.

    A reply holds one result or a list of them.  Placeholders get their originals back
    from the request of the same key; of several results for a key the last one counts;
    a key that was not asked for is ignored.
    """
    parsed = staged(R.parse_responses(replies), "replies")
    rows = R.normalise_result(R.explode_results(parsed)).filter(F.col("item_key") != "")
    fields = rows.select(
        "item_key", "reply_no", "result_no",
        *["control_objective", "control_name", "audit_requirement", "business_impact"],
        recommendation_text(F.col("primary"), F.col("secondary"), F.col("defensive")).alias("remediation"),
        not_blank(reference_text(F.col("refs"))).alias("reference"))
    last = fields.groupBy("item_key").agg(
        F.max_by(F.struct(*TEXTS), F.struct("reply_no", "result_no")).alias("_r")).select("item_key", "_r.*")
    known = last.join(requests.select("item_key", "restore_map"), "item_key")
    return {"results": restore(known, TEXTS).drop("restore_map"), "unread": R.quarantine(parsed)}


def apply_lookup(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Merge results by item_key; scan fields and more specific values stay; adds `looked_up`."""
    merged = E.merge_enrichment(findings, results, "item_key")
    return merged.join(results.select("item_key", F.lit(True).alias("looked_up")), "item_key", "left").withColumn(
        "looked_up", F.coalesce("looked_up", F.lit(False)))
