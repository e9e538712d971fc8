"""Title families and recommendation-template selection as rule ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.text import any_contains, or_empty, strip
from scanlake.tables import fixed


def version_parts(c: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(or_empty(c), F.lit(r"(\d+)")), lambda p: p.try_cast("decimal(38,0)")
    )


def version_lt(c: Column, minimum: str) -> Column:
    """Numeric version comparison; both sides are zero-padded to one width."""
    floor = [int(p) for p in minimum.split(".")]
    n = len(floor)
    zero = F.lit(0).cast("decimal(38,0)")
    have = version_parts(c)
    want = F.array(*[F.lit(p).cast("decimal(38,0)") for p in floor])
    have_wide = F.concat(have, F.array_repeat(zero, F.greatest(F.lit(n) - F.size(have), F.lit(0))))
    want_wide = F.concat(want, F.array_repeat(zero, F.greatest(F.size(have) - F.lit(n), F.lit(0))))
    return (F.size(have) > 0) & (have_wide < want_wide)


def _test(lower: Column, kind: str, text: str) -> Column:
    if kind == "is":
        return lower == text
    return lower.startswith(text) if kind == "starts" else lower.contains(text)


def _holds(lower: Column, alternatives) -> Column:
    out = None
    for tests in alternatives:
        cond = None
        for kind, text in tests:
            t = _test(lower, kind, text)
            cond = t if cond is None else cond & t
        out = cond if out is None else out | cond
    return out


def _pair(key: str, title: str) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(title).alias("title"))


def family_and_title(lower: Column, name: Column, plugin_output: Column | None = None) -> Column:
    """struct(key, title): the family of a title and the title the report prefers.

    `lower` is a column that holds `key_text(name)`; the ladder reads it many times.
    With `plugin_output` two further rules look at the evidence of the row.
    """
    branches: list[tuple[Column, Column]] = []
    if plugin_output is not None:
        output = or_empty(plugin_output)
        version = F.regexp_extract(output, r"(?i)version\s*:\s*(\d[\d.]+)", 1)
        branches.append(
            ((lower == fixed.NGINX_TITLE) & version_lt(version, fixed.NGINX_FIXED_IN),
             _pair(*fixed.NGINX_FAMILY))
        )
        branches.append(
            ((lower == fixed.SNMP_TITLE) & F.lower(output).contains("public"),
             _pair(*fixed.SNMP_FAMILY))
        )
    branches += [(_holds(lower, alts), _pair(k, t)) for alts, k, t in fixed.TITLE_RULES]
    out = None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(
        F.struct(F.concat(F.lit("name:"), lower).alias("key"), or_empty(name).alias("title"))
    )


def is_promoted(key: Column) -> Column:
    """Informational families that are reported all the same."""
    return key.isin(fixed.PROMOTED_FAMILIES)


def _vars(**kv: Column | str) -> Column:
    if not kv:
        return F.create_map().cast("map<string,string>")
    items = []
    for k, v in kv.items():
        items += [F.lit(k), v if isinstance(v, Column) else F.lit(v)]
    return F.create_map(*items)


def select_template(
    title: Column,
    lower: Column,
    eol_path: Column,
    service: Column,
) -> Column:
    """struct(key, vars): the recommendation template for a title; NULL when none fits.

    `lower` holds the lower-cased title.  The first rule that holds wins; SSH ciphers come before ciphers in general.
    `eol_path` (struct template_key, upgrade_targets) and `service` (a template key) are
    what the look-ups of a template payload give for the title, or NULL; see
    `operators.templates.choose_templates`.
    """
    raw, t = title, lower

    def has(*words: str) -> Column:
        return any_contains(t, words)

    ladder = None

    def rule(cond: Column, key: Column | str, **kv) -> None:
        nonlocal ladder
        value = F.struct((key if isinstance(key, Column) else F.lit(key)).alias("key"), _vars(**kv).alias("vars"))
        ladder = F.when(cond, value) if ladder is None else ladder.when(cond, value)

    rule(has("ssh") & has("cbc", "cipher", "weak algorithm"), "ssh_weak_ciphers")
    rule(
        has("cipher", "sweet32", "medium strength"), "cipher_weakness",
        weak_cipher_types=F.when(has("anonymous"), F.lit("anonymous cipher suites"))
        .when(has("medium"), F.lit("medium strength ciphers (3DES)"))
        .otherwise(F.lit("weak cipher suites")),
    )
    rule(
        has("tls 1.0", "tls 1.1", "sslv2", "sslv3", "ssl v2", "ssl v3", "ssl version 2",
            "ssl version 3", "deprecated protocol", "deprecated tls"),
        "deprecated_tls",
        deprecated_version=F.when(has("1.0") & has("1.1"), F.lit("TLS 1.0 and 1.1"))
        .when(has("1.0"), F.lit("TLS 1.0"))
        .when(has("1.1"), F.lit("TLS 1.1"))
        .when(has("version 2") & has("version 3"), F.lit("SSLv2 and SSLv3"))
        .when(has("sslv2", "ssl v2", "version 2"), F.lit("SSLv2"))
        .when(has("sslv3", "ssl v3", "version 3"), F.lit("SSLv3"))
        .otherwise(F.lit("deprecated TLS versions")),
    )
    rule(has("sql injection", "sqli", "sql inj"), "sql_injection")
    rule(has("cross-site scripting", "xss", "cross site scripting"), "xss")
    rule(has("command injection", "cmd injection", "os command"), "command_injection")
    rule(has("self-signed", "self signed"), "self_signed_cert")
    rule(has("certificate expir", "cert expir", "expired certificate"), "certificate_expiry")
    rule(has("hostname", "cn mismatch"), "certificate_hostname")
    rule(has("cannot be trusted", "untrusted certificate", "invalid certificate"),
         "certificate_trust")
    rule(has("weak hash", "sha-1 certificate", "md5 certificate", "sha1 sign"),
         "certificate_weak_hash")
    rule(eol_path.isNotNull(), eol_path["template_key"], upgrade_targets=eol_path["upgrade_targets"])
    rule(has("unsupported version", "end of life", "eol", "end-of-life"), "eol_generic")
    rule(has("snmp") & has("default", "community", "public"), "snmp_default")
    rule(has("smb") & has("signing"), "smb_signing")
    rule(has("hsts", "strict-transport-security", "strict transport security"), "hsts_missing")
    rule(has("clickjacking", "x-frame-options", "frame-ancestors"), "clickjacking")
    rule(has("security header"), "security_headers_generic")
    for word, legacy in fixed.LEGACY_SERVICES:
        rule(has(word), "legacy_service", service_name=legacy)
    open_access = has("exposed", "unauthorized", "information disclosure", "open access")
    for word in fixed.DATA_SERVICES:
        rule(has(word) & open_access, "database_exposure", service=word.capitalize())
    rule(
        has(" rce", "remote code execution", "code execution"), "rce_generic",
        product=strip(
            F.when(raw.contains("RCE"), F.substring_index(raw, "RCE", 1))
            .otherwise(F.substring_index(raw, "Remote Code", 1))
        ),
    )
    bare = raw
    for word in ("Exposed", "Service", "Server"):
        bare = F.replace(bare, F.lit(word), F.lit(""))
    rule(has("exposed") & ~has("certificate"), "service_exposure", service=strip(bare))
    rule(has("autocomplete") | (has("password") & has("auto")), "autocomplete_enabled")
    rule(has("rdp", "remote desktop") & has("exposed", "nla", "encryption"), "rdp_exposure")
    rule(has("dns") & has("dynamic update", "record injection"), "dns_dynamic_update")
    rule(has("icmp") & has("timestamp"), "icmp_timestamp")
    rule(has("directory listing", "directory browsing", "browsable", "directory enumeration"),
         "directory_listing")
    version = F.regexp_extract(raw, r"<\s*(\d+\.\d+(?:\.\d+)?)", 1)
    rule(service.isNotNull(), service,
         fixed_version=F.when(version == "", F.lit("latest")).otherwise(version))
    rule(version != "", "outdated_service_generic",
         product=strip(F.substring_index(raw, "<", 1)), fixed_version=version)
    return ladder
