"""Column builders for hosts, assets, subnets and report categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.text import (
    first_keyword, has_text, is_placeholder, lookup, meaningful, or_empty, report_text, slug,
    squeeze, strip, title_from_slug,
)
from scanlake.tables import fixed

IPV4_PORT, IPV4_HOST, CIDR, IPV4_OR_CIDR = fixed.IPV4_PORT, fixed.IPV4_HOST, fixed.CIDR, fixed.IPV4_OR_CIDR
HOST_PORT, WEB_HINT = fixed.HOST_PORT, fixed.WEB_HINT


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(or_empty(c), F.lit(pattern), F.lit(group))


def asset_key(host: Column, port: Column) -> Column:
    """'host:port', or the host alone when the port is blank or 0."""
    bare = (or_empty(port) == "") | (port == "0") | (or_empty(host) == "")
    return F.when(bare, host).otherwise(F.concat_ws(":", host, port))


def is_placeholder_asset(c: Column) -> Column:
    t = squeeze(c)
    rest = F.regexp_extract(t, r"(?i)^affected assets:\s*(.*)$", 1)
    return is_placeholder(t) | (
        F.lower(t).startswith("affected assets:") & is_placeholder(rest)
    )


def assets_array(c: Column) -> Column:
    """Comma list -> trimmed, distinct assets in first-seen order."""
    parts = F.transform(F.split(or_empty(c), ","), strip)
    return F.array_distinct(F.filter(parts, lambda a: ~is_placeholder_asset(a)))


def clean_assets(a: Column) -> Column:
    """The same for an array whose entries may themselves be comma lists."""
    return assets_array(F.array_join(F.coalesce(a, F.array().cast("array<string>")), ","))


def asset_candidates(c: Column) -> Column:
    """IPv4[:port] then host[:port] mentions, in text order."""
    return F.concat(found(c, IPV4_PORT), found(c, HOST_PORT))


def assets_short(a: Column, limit: int = 10) -> Column:
    return short_label(F.array_join(F.slice(a, 1, limit), ", "), F.size(a), limit)


def short_label(shown: Column, total: Column, limit: int = 10) -> Column:
    """Display text for the first `limit` assets of `total`."""
    more = total - F.lit(limit)
    return (
        F.when(total <= 0, F.lit(fixed.INSUFFICIENT))
        .when(more <= 0, shown)
        .otherwise(F.concat(shown, F.lit(", … and "), more.cast("string"), F.lit(" more")))
    )


def asset_trace(a: Column) -> Column:
    return F.when(F.size(a) <= 0, F.lit("Affected assets: " + fixed.INSUFFICIENT)).otherwise(
        F.concat(
            F.lit("Affected assets:\n"),
            F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n"),
        )
    )


def has_asset_trace(c: Column) -> Column:
    """True when a trace block names at least one real asset."""
    body = F.regexp_replace(report_text(c), r"(?i)^\s*affected assets\s*:\s*", "")
    tokens = F.transform(
        F.split(F.regexp_replace(body, r"(?m)^\s*[-*]\s*", ""), "[\n,]"), strip
    )
    return has_text(body) & F.exists(tokens, lambda t: ~is_placeholder_asset(t))


def asset_sample(a: Column, limit: int = 10) -> Column:
    """struct(count, sample) handed to an external enrichment."""
    return F.struct(F.size(a).alias("count"), F.slice(a, 1, limit).alias("sample"))


def subnet24(ip: Column) -> Column:
    """'a.b.c.0/24' for a well-formed IPv4, else NULL."""
    parts = F.transform(F.split(or_empty(ip), r"\."), lambda p: p.try_cast("int"))
    ok = (F.size(parts) == 4) & F.forall(
        parts, lambda p: F.coalesce((p >= 0) & (p <= 255), F.lit(False))
    )
    octets = F.transform(F.slice(parts, 1, 3), lambda p: p.cast("string"))
    return F.when(ok, F.concat(F.array_join(octets, "."), F.lit(".0/24")))


def subnets_of(assets: Column) -> Column:
    """Distinct /24 subnets of the IPv4 hosts named in an asset array."""
    hosts = found(F.array_join(assets, " "), IPV4_HOST, 1)
    return F.array_distinct(F.filter(F.transform(hosts, subnet24), lambda s: s.isNotNull()))


def subnet_candidates(category: Column, assets: Column) -> Column:
    return F.array_distinct(F.concat(found(category, CIDR), subnets_of(assets)))


def subnet_key_from_count(count: Column, only: Column) -> Column:
    return (
        F.when(count == 1, only)
        .when(count > 1, F.lit("multiple-subnets"))
        .otherwise(F.lit("host-specific"))
    )


def subnet_label_from_key(key: Column) -> Column:
    return lookup(
        key,
        {"multiple-subnets": "Multiple subnets", "host-specific": "Host-specific findings"},
        key,
    )


def category_words(category: Column) -> Column:
    """Category without addresses, separators and dashes between words."""
    t = F.regexp_replace(or_empty(category), IPV4_OR_CIDR, " ")
    t = F.regexp_replace(t, r"[_|/]+", " ")
    t = F.regexp_replace(t, r"\s+-\s+", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.btrim(t, F.lit(" -"))


def taxonomy_family(category: Column, existing: Column | None = None) -> Column:
    own = F.when(has_text(category), slug(category_words(category)))
    derived = F.coalesce(F.when(own != "", own), F.lit("general"))
    if existing is None:
        return derived
    kept = slug(meaningful(existing))
    return F.when(
        has_text(existing), F.coalesce(F.when(kept != "", kept), F.lit("general"))
    ).otherwise(derived)


def taxonomy_label(category: Column, family: Column) -> Column:
    own = F.when(has_text(category), category_words(category))
    return F.coalesce(
        F.when(own != "", own),
        F.when(family == "general", F.lit("General Findings")),
        title_from_slug(family, "General Findings"),
    )


def derive_category(subnet_count: Column, only_subnet: Column, asset_text: Column,
                    name: Column, description: Column) -> Column:
    """Category from subnets, then a web hint, then keywords."""
    hay = F.lower(F.concat_ws(" ", or_empty(name), or_empty(description)))
    return F.coalesce(
        F.when(subnet_count == 1, F.concat(F.lit("Internal Network - "), only_subnet)),
        F.when(subnet_count > 1, F.lit("Internal Network - Multiple Subnets")),
        F.when(or_empty(asset_text).rlike(WEB_HINT), F.lit("Web Application")),
        first_keyword(hay, fixed.CATEGORY_KEYWORDS),
        F.lit(fixed.CATEGORY_DEFAULT),
    )


def category_of(assets: Column, category: Column, name: Column, description: Column) -> Column:
    blob = F.concat_ws(" ", F.array_join(assets, ", "), or_empty(category))
    nets = subnets_of(F.array(blob))
    return derive_category(F.size(nets), F.get(nets, F.lit(0)), blob, name, description)
