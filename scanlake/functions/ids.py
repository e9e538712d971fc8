"""Column builders for CVE / CWE identifiers and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.text import key_text, lookup, not_blank, or_empty, strip
from scanlake.tables import fixed

# Three dialects are in use: strict ids, short ids, and ids with loose separators.
CVE_STRICT = r"(?i)CVE-\d{4}-\d{4,7}"
CVE_SHORT = r"(?i)CVE-\d{4}-\d{3,7}"
CVE_LOOSE = r"(?i)CVE[-\s]?\d{4}[-\s]?\d{4,7}"
CWE_STRICT = r"(?i)CWE-\d{1,5}"
CWE_LOOSE = r"(?i)CWE[-\s]?\d{1,5}"
URL = r"""(?i)https?://[^\s<>\])"']+"""

REF = "array<struct<title:string,url:string>>"


def extract_ids(c: Column, pattern: str) -> Column:
    """All ids in the text, upper case, distinct, in order; blanks become '-'."""
    hits = F.regexp_extract_all(or_empty(c), F.lit(pattern), F.lit(0))
    return F.array_distinct(
        F.transform(hits, lambda x: F.regexp_replace(F.upper(x), r"\s+", "-"))
    )


def blob(*cols: Column) -> Column:
    return F.concat_ws(" ", *[or_empty(c) for c in cols])


def cve_cwe_display(text: Column) -> Column:
    both = F.concat(extract_ids(text, CVE_LOOSE), extract_ids(text, CWE_LOOSE))
    return F.when(F.size(both) == 0, F.lit("N/A")).otherwise(F.array_join(both, ", "))


def norm_cwe(c: Column) -> Column:
    """'79' or 'cwe-79' -> 'CWE-79'; anything else NULL."""
    t = F.upper(strip(or_empty(c)))
    full = F.when(t.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), t)).otherwise(t)
    return F.when(full.rlike(r"^CWE-\d{1,5}$"), full)


def norm_cve(c: Column) -> Column:
    t = F.upper(strip(or_empty(c)))
    return F.when(t.rlike(r"^CVE-\d{4}-\d{4,7}$"), t)


# --- urls ----------------------------------------------------------------------

def with_scheme(url: Column) -> Column:
    t = strip(or_empty(url))
    return F.when(t == "", t).when(
        t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), t
    ).otherwise(F.concat(F.lit("https://"), t))


AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def url_host(url: Column) -> Column:
    """Lower-case host without user and port, '' when there is none."""
    return F.lower(F.regexp_extract(with_scheme(url), AUTHORITY, 1))


def canonical_url(url: Column) -> Column:
    """scheme://host/path: host lower, no trailing '/', no query or fragment."""
    return _canonical(with_scheme(url))


def _canonical(t: Column) -> Column:
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    netloc = F.lower(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.concat(scheme, F.lit("://"), netloc, F.regexp_replace(path, "/+$", ""))


def ref_priority(url: Column) -> Column:
    """Rank of the publisher, lower first: 5 for an unlisted host, 9 without a host."""
    t = F.lower(F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^?#]*)", 1))
    out = F.when(F.regexp_extract(t, "^([^/]*)", 1) == "", F.lit(9))
    for marker, rank in fixed.DOMAIN_PRIORITY:
        out = out.when(t.contains(marker), F.lit(rank))
    return out.otherwise(F.lit(5)).cast("int")


def is_public_domain(host: Column) -> Column:
    """Host equals, or is a subdomain of, an allow-listed public domain."""
    listed = "|".join(d.replace(".", "[.]") for d in fixed.PUBLIC_DOMAINS)
    return host.rlike("^(?:.*[.])?(?:" + listed + ")$")


def is_public_host(url: Column) -> Column:
    t = strip(or_empty(url))
    # looked at only where the scheme is there
    host = F.lower(F.regexp_extract(t, AUTHORITY, 1))
    return (
        F.lower(t).rlike("^https?://")
        & ~host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
        & ~host.startswith("[")
        & is_public_domain(host)
    )


def _ref(title: Column, url: Column) -> Column:
    return F.struct(title.alias("title"), url.alias("url"))


def refs_array(c: Column) -> Column:
    """References in a free text: its URLs, then remaining lines of 8+ characters."""
    t = strip(or_empty(c))
    urls = F.array_distinct(F.regexp_extract_all(t, F.lit(URL), F.lit(0)))
    rest = F.transform(
        F.split(F.regexp_replace(t, URL, "\n"), "[\r\n]"),
        lambda x: F.btrim(x, F.lit(" -\t\r")),
    )
    titles = F.filter(
        rest,
        lambda x: (F.length(x) >= 8) & ~F.lower(x).isin(fixed.STOCK_REFERENCES),
    )
    return F.concat(
        F.transform(urls, lambda u: _ref(u, u)),
        F.transform(titles, lambda x: _ref(x, F.lit(""))),
    )


def _first(a: Column, limit: int | None) -> Column:
    return a if limit is None else F.slice(a, 1, limit)


def auto_refs(cve_text: Column, cwe_text: Column, cves: int | None = 3, cwes: int | None = 2) -> Column:
    """Canonical links for the first CVEs and CWEs of a finding; None: for all of them."""
    cves = _first(extract_ids(cve_text, CVE_SHORT), cves)
    cwes = _first(extract_ids(cwe_text, CWE_STRICT), cwes)
    return F.concat(
        F.transform(
            cves, lambda x: _ref(F.concat(F.lit("NVD "), x), F.concat(F.lit(fixed.NVD_URL), x))
        ),
        F.transform(
            cwes,
            lambda x: _ref(
                x, F.concat(F.lit(fixed.CWE_URL), F.substring_index(x, "-", -1), F.lit(".html"))
            ),
        ),
    )


def _first_of_key(keyed: Column) -> Column:
    """Entries whose `k` no earlier entry has.

    The list goes through a one-element array: an expression named inside the lambda would be
    worked out again for every entry.
    """
    firsts = F.transform(F.array(keyed), lambda a: F.filter(
        a, lambda r, i: F.array_position(a["k"], r["k"]) == (i + 1).cast("long")))
    return F.get(firsts, F.lit(0))


def distinct_refs(refs: Column) -> Column:
    """First reference per canonical key."""
    full = F.transform(
        refs,
        lambda r: F.struct(
            with_scheme(F.coalesce(not_blank(r["url"]), r["title"], F.lit(""))).alias("t"),
            r["title"].alias("title"),
            r["url"].alias("url"),
        ),
    )
    keyed = F.transform(full, lambda r: F.struct(_canonical(r["t"]).alias("k"), r["title"].alias("title"), r["url"].alias("url")))
    firsts = _first_of_key(F.filter(keyed, lambda r: r["k"] != "://"))
    return F.transform(firsts, lambda r: _ref(r["title"], r["url"]))


def rank_refs(refs: Column, limit: int | None = 10) -> Column:
    """Dedupe, then title-only, then non-public, then public by (priority, title); None: no cut."""
    unique = F.transform(
        distinct_refs(refs),
        lambda r: F.struct(is_public_host(r["url"]).alias("public"), r["title"].alias("title"), r["url"].alias("url")),
    )
    order = F.transform(
        unique,
        lambda r, i: F.struct(
            F.when(or_empty(r["url"]) == "", F.lit(0))
            .when(~r["public"], F.lit(1))
            .otherwise(F.lit(2)).alias("part"),
            F.when(r["public"], ref_priority(r["url"])).otherwise(F.lit(0))
            .alias("rank"),
            F.when(r["public"], r["title"]).otherwise(F.lit("")).alias("by"),
            i.alias("i"),
            r["title"].alias("title"),
            r["url"].alias("url"),
        ),
    )
    return F.transform(
        _first(F.array_sort(order), limit), lambda r: _ref(r["title"], r["url"])
    )


def merge_refs(first: Column, second: Column, limit: int = 10) -> Column:
    """Two reference lists in order, distinct by url (or title), at most `limit`."""
    both = F.transform(
        F.concat(first, second),
        lambda r: F.struct(
            strip(F.coalesce(not_blank(or_empty(r["title"])), or_empty(r["url"]))).alias("title"),
            strip(or_empty(r["url"])).alias("url"),
        ),
    )
    keyed = F.transform(both, lambda r: F.struct(
        F.coalesce(not_blank(r["url"]), r["title"]).alias("k"), r["title"].alias("title"), r["url"].alias("url")))
    kept = F.filter(_first_of_key(keyed), lambda r: r["k"] != "")
    return F.transform(F.slice(kept, 1, limit), lambda r: _ref(r["title"], r["url"]))


def is_id_reference(title: Column, url: Column) -> Column:
    """CVE / CWE / NVD entries have a row of their own in the report."""
    both = F.lower(F.concat_ws(" ", title, url))
    t = F.upper(strip(title))
    return (
        both.contains("cwe.mitre.org")
        | both.contains("nvd.nist.gov")
        | t.rlike("^(?:CWE-|CVE-|NVD )")
    )


def reference_text(refs: Column) -> Column:
    shown = F.filter(
        F.transform(refs, lambda r: _ref(strip(or_empty(r["title"])), strip(or_empty(r["url"])))),
        lambda r: ~is_id_reference(r["title"], r["url"]),
    )
    lines = F.transform(
        shown, lambda r: F.coalesce(not_blank(r["title"]), r["url"])
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def reference_plain(c: Column) -> Column:
    """String form: CWE ids after a separator are removed."""
    return strip(F.regexp_replace(or_empty(c), r"[;,]\s*CWE-\d+", ""))
