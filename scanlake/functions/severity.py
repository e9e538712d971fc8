"""Column builders for severity, status and score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.text import (
    any_contains, cell_text, first_keyword, key_text, lookup, not_blank, or_empty, strip,
)
from scanlake.tables import fixed

NUMBER = r"(\d+(?:\.\d+)?)"


def severity_scan(c: Column) -> Column:
    """Scanner risk label; blank or unknown is Informational."""
    return lookup(F.lower(cell_text(c)), fixed.SCAN_SEVERITY, F.lit("Informational"))


def severity_canonical(c: Column) -> Column:
    """Report label; blank is Medium, informational becomes Low."""
    t = strip(or_empty(c))
    return F.when(t == "", F.lit("Medium")).otherwise(
        lookup(F.lower(t), fixed.CANONICAL_SEVERITY, F.initcap(t))
    )


def severity_totals_label(c: Column) -> Column:
    """Four-label variant used when totals are recomputed; anything else is Medium."""
    return lookup(F.lower(strip(or_empty(c))), fixed.REPORT_SEVERITY, F.lit("Medium"))


def first_number(c: Column) -> Column:
    return F.regexp_extract(or_empty(c), NUMBER, 1).try_cast("double")


def severity_from_cvss(c: Column) -> Column:
    """Band of the first number in the text, NULL when there is none."""
    x = first_number(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for floor, label in fixed.CVSS_BANDS:
        out = out.when(x >= floor, F.lit(label))
    return out.otherwise(F.lit("Informational"))


def severity_from_keywords(name: Column, description: Column) -> Column:
    both = F.lower(F.concat_ws(" ", or_empty(name), or_empty(description)))
    return first_keyword(both, [(words, label) for label, words in fixed.SEVERITY_KEYWORDS])


def severity_resolved(severity: Column, cvss: Column, name: Column, description: Column) -> Column:
    """Known label, else CVSS band, else keyword, else the raw label or Medium."""
    raw = strip(or_empty(severity))
    return F.coalesce(
        lookup(F.lower(raw), fixed.REPORT_SEVERITY),
        severity_from_cvss(cvss),
        severity_from_keywords(name, description),
        not_blank(raw),
        F.lit("Medium"),
    )


def severity_rank(c: Column) -> Column:
    return lookup(c, fixed.SEVERITY_RANK, F.lit(0)).cast("int")


def narrative_rank(c: Column) -> Column:
    return lookup(c, fixed.NARRATIVE_RANK, F.lit(5)).cast("int")


def severity_override(title: Column, severity: Column) -> Column:
    return lookup(title, fixed.TITLE_SEVERITY, severity)


def severity_color(c: Column) -> Column:
    return lookup(c, fixed.SEVERITY_COLOR, F.lit(fixed.DEFAULT_COLOR))


def is_fp_review(lower_text: Column) -> Column:
    """A false-positive remark that is still under review."""
    return any_contains(lower_text, fixed.REVIEW_STEMS) & any_contains(
        lower_text, fixed.REVIEW_MARKERS
    )


def status_text(*values: Column) -> Column:
    """The joined, squeezed status cells that the status rules look at."""
    return key_text(F.concat_ws(" ", *[cell_text(v) for v in values]))


def status_family(text: Column) -> Column:
    """Family of a status text; pass a column that already holds `status_text`."""
    out = F.when(text == "", F.lit("open")).when(is_fp_review(text), F.lit("fp_review"))
    for family, words in fixed.STATUS_RULES:
        out = out.when(any_contains(text, words), F.lit(family))
    return out.otherwise(F.lit("other"))


def status_display(c: Column) -> Column:
    t = F.coalesce(not_blank(c), F.lit("OPEN"))
    return lookup(F.lower(strip(or_empty(c))), fixed.STATUS_DISPLAY, F.upper(t))


def epss_label(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for floor, label in fixed.EPSS_BANDS:
        out = out.when(c >= floor, F.lit(label))
    return out.otherwise(F.lit(fixed.EPSS_FLOOR))
