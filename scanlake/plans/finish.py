"""The end that every chain shares: references, quality, composition, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions import assets as A
from scanlake.functions import ids as I
from scanlake.functions.severity import severity_canonical
from scanlake.functions.text import squeeze
from scanlake.operators import grouping as g
from scanlake.operators import presentation as p
from scanlake.operators import quality as q
from scanlake.operators import rollup as r
from scanlake.plans.report import compose_report
from scanlake.session import once, staged

ID_KEYS = ["report_id", "id"]


def asset_mentions(findings: DataFrame) -> DataFrame:
    """(finding, asset): addresses and host names mentioned in a finding's texts."""
    mentions = F.concat(*[A.asset_candidates(F.col(c)) for c in ("description", "observation")])
    return findings.select(*ID_KEYS, F.explode(A.clean_assets(mentions)).alias("asset")).distinct()


def all_references(findings: DataFrame) -> DataFrame:
    """(finding, place, title, url): every reference of a finding in display order, uncut."""
    ids = I.blob(F.col("cve"), F.col("description"), F.col("remediation"))
    refs = F.concat(I.refs_array(F.col("reference")), I.auto_refs(ids, ids, None, None))
    ranked = once(findings.withColumn("_every", refs), {"_ranked": I.rank_refs(F.col("_every"), None)})
    return ranked.select(*ID_KEYS, F.posexplode("_ranked").alias("place", "_r")).select(
        *ID_KEYS, "place", "_r.title", "_r.url")


def finish_report(
    flagged: DataFrame, assets: DataFrame, min_pass: float = 0.55
) -> dict[str, DataFrame]:
    """Report tables of validated findings with `is_fp`, and their assets (finding, asset).

    `refs` of a finding is the list that a report shows; `references` has all of them.
    """
    real = flagged.filter(~F.col("is_fp")).drop("is_fp")
    every = staged(assets.unionByName(asset_mentions(real)).distinct(), "assets")
    ids = I.blob(F.col("cve"), F.col("description"), F.col("remediation"))
    clean = real.withColumns({
        "name": squeeze(F.col("name")),
        "severity": severity_canonical(F.col("severity")),
        "refs": I.rank_refs(F.concat(I.refs_array(F.col("reference")), I.auto_refs(ids, ids))),
    })
    scored = staged(q.score_findings(clean), "scored")
    with_count = g.with_assets(scored, g.asset_summary(every, ID_KEYS), ID_KEYS)
    report = compose_report(with_count, p.subnet_summary(every, ID_KEYS), ID_KEYS)
    nets = p.asset_subnets(every, ID_KEYS)
    return {
        **report,
        "assets": every,
        "references": all_references(scored),
        "false_positives": flagged.filter("is_fp").drop("is_fp"),
        "metadata": r.report_metadata(scored, nets),
        "networks": r.report_networks(nets),
        "quality": q.quality_summary(scored, min_pass, ["report_id"]),
    }
