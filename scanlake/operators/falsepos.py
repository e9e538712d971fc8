"""False-positive detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.severity import is_fp_review
from scanlake.functions.text import any_contains, key_text, or_empty, strip
from scanlake.tables import fixed


def fuzzy_fp(name: Column) -> Column:
    """Some window of the name, as long as the target, agrees with it in enough places.

    The ratio is 2 * matching positions / (window length + target length).  At the
    threshold at most three of fourteen places may differ, so three neighbouring
    places must agree; names without any three-letter piece of the target skip the
    window test.
    """
    target = fixed.FP_TARGET
    n = len(target)
    text = F.regexp_replace(F.lower(or_empty(name)), "[^a-z ]", " ")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))

    def close(i: Column) -> Column:
        window = F.substr(text, i, F.lit(n))
        hits = None
        for k, ch in enumerate(target):
            hit = (F.substr(window, F.lit(k + 1), F.lit(1)) == ch).cast("int")
            hits = hit if hits is None else hits + hit
        return 2.0 * hits / (F.length(window) + n) >= fixed.FP_THRESHOLD

    pieces = "|".join(target[i:i + 3] for i in range(n - 2))
    return F.when(text.rlike(pieces), F.exists(starts, close)).otherwise(F.lit(False))


def is_false_positive(name: Column, observation: Column, risk_status: Column,
                      description: Column, cvss: Column, severity: Column) -> Column:
    """Marked, fuzzily marked, accepted, zero-scored or informational findings."""
    hay = F.lower(F.concat_ws(
        " ", or_empty(name), or_empty(observation), or_empty(risk_status),
        or_empty(description),
    ))
    marked = any_contains(hay, fixed.FP_TOKENS) | fuzzy_fp(name)
    return (
        F.lower(strip(or_empty(risk_status))).isin(fixed.ACCEPTED_RISK)
        | strip(or_empty(cvss)).isin(fixed.ZERO_CVSS)
        | (F.lower(strip(or_empty(observation))) == "informational")
        | (F.lower(strip(or_empty(severity))) == "informational")
        | (~is_fp_review(key_text(hay)) & marked)
    )


def flag_false_positives(findings: DataFrame) -> DataFrame:
    """Add `is_fp`; downstream splits are two filters on the flagged frame."""
    return findings.withColumn(
        "is_fp",
        is_false_positive(
            F.col("name"), F.col("observation"), F.col("risk_status"), F.col("description"),
            F.col("cvss"), F.col("severity"),
        ),
    )


def split_false_positives(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(real findings, false positives)."""
    flagged = flag_false_positives(findings)
    return (
        flagged.filter(~F.col("is_fp")).drop("is_fp"),
        flagged.filter("is_fp").drop("is_fp"),
    )
