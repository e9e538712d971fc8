"""Pseudonymise, verify and restore sensitive values.

The scope of a placeholder is one row (one finding, one document): everything
happens inside the row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.ids import is_public_domain, is_public_host
from scanlake.functions.text import or_empty, strip
from scanlake.tables import fixed

IP = r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b"
FQDN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
URL = r"""(?i)\bhttps?://[^\s<>'"`]+"""
USER = r"\b[A-Za-z0-9._-]+\\[A-Za-z0-9._-]+\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LABELLED = r"(?dim)^(" + fixed.LABEL_ALTERNATION + r")\s*[:=]\s*(.+)$"
PLACEHOLDER = r"^\[[A-Z]+_\d+\]$"
SCHEMA_TOKEN = r"^(?:[a-z_]+\.)+(?:" + "|".join(fixed.SCHEMA_SUFFIXES) + ")$"


def label_prefix(label: Column) -> Column:
    t = F.lower(strip(label))
    out = None
    for prefix, labels in fixed.LABEL_PREFIX.items():
        cond = t.isin(labels)
        out = F.when(cond, F.lit(prefix)) if out is None else out.when(cond, F.lit(prefix))
    return out.otherwise(F.lit("CONTEXT"))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _entity(prefix: Column, value: Column) -> Column:
    return F.struct(prefix.alias("prefix"), value.alias("value"))


def is_private_host(host: Column) -> Column:
    """A host name that is neither allow-listed nor a dotted schema token."""
    h = F.lower(host)
    return ~h.rlike(SCHEMA_TOKEN) & ~is_public_domain(h)


def detect(c: Column) -> Column:
    """Sensitive values of a text as array<struct<prefix,value>>, in detector order."""
    def tagged(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda v: _entity(F.lit(prefix), v))

    labelled = F.zip_with(
        _all(c, LABELLED, 1), _all(c, LABELLED, 2),
        lambda label, value: _entity(label_prefix(label), strip(value)),
    )
    urls = F.filter(
        F.transform(_all(c, URL), lambda u: F.regexp_replace(u, r"[).,;]+$", "")),
        lambda u: ~is_public_host(u),
    )
    found = F.concat(
        labelled,
        tagged("URL", urls),
        tagged("EMAIL", _all(c, EMAIL)),
        tagged("USER", _all(c, USER)),
        tagged("IP", _all(c, IP)),
        tagged("HOST", F.filter(_all(c, FQDN), is_private_host)),
    )
    return F.filter(found, lambda e: (e["value"] != "") & ~e["value"].rlike(PLACEHOLDER))


def assign_placeholders(df: DataFrame, cols: Sequence[str], name: str = "entities") -> DataFrame:
    """Add array<struct<placeholder,original,ord>>: one entry per distinct value of a row.

    Columns are read in order; the first mention of a value decides its prefix, and
    `[PREFIX_n]` counts per prefix in discovery order.
    """
    staged = df.withColumns({
        f"_t{i}": or_empty(F.col(c)) for i, c in enumerate(cols)
    }).withColumn("_e", F.concat(*[detect(F.col(f"_t{i}")) for i in range(len(cols))]))
    staged = staged.withColumn("_s", F.array_sort(F.transform(
        "_e",
        lambda e, i: F.struct(e["value"].alias("v"), i.alias("i"), e["prefix"].alias("p")),
    )))
    firsts = F.filter(
        "_s", lambda x, j: (j == 0) | (x["v"] != F.get(F.col("_s"), j - 1)["v"])
    )
    staged = staged.withColumn("_o", F.array_sort(F.transform(
        firsts, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), x["v"].alias("v"))
    )))

    def numbered(prefix: str) -> Column:
        return F.transform(
            F.filter("_o", lambda x: x["p"] == prefix),
            lambda x, j: F.struct(
                F.concat(F.lit(f"[{prefix}_"), (j + 1).cast("string"), F.lit("]"))
                .alias("placeholder"),
                x["v"].alias("original"),
                x["i"].alias("ord"),
            ),
        )

    entries = F.concat(*[numbered(p) for p in fixed.PLACEHOLDER_PREFIXES])
    return staged.withColumn(name, entries).drop(
        "_e", "_s", "_o", *[f"_t{i}" for i in range(len(cols))]
    )


def _apply(c: Column, ordered: Column) -> Column:
    return F.aggregate(
        ordered, c, lambda t, e: F.replace(t, e["original"], e["placeholder"])
    )


def redact(df: DataFrame, cols: Sequence[str], keep_entities: bool = True) -> DataFrame:
    """Replace every sensitive value, longest first; `restore_map` undoes it.

    Columns may be strings or arrays of strings.
    """
    types = dict(df.dtypes)
    flat = df.withColumns({
        f"_f{i}": F.array_join(c, "\n") if types[c].startswith("array") else F.col(c)
        for i, c in enumerate(cols)
    })
    with_map = assign_placeholders(flat, [f"_f{i}" for i in range(len(cols))])
    longest = F.array_sort(F.transform(
        "entities",
        lambda e: F.struct(
            (-F.length(e["original"])).alias("len"), e["ord"].alias("ord"),
            e["original"].alias("original"), e["placeholder"].alias("placeholder"),
        ),
    ))
    staged = with_map.withColumn("_r", longest)
    out = staged.withColumns({
        c: F.transform(c, lambda x: _apply(x, F.col("_r"))) if types[c].startswith("array")
        else _apply(F.col(c), F.col("_r"))
        for c in cols
    }).withColumn(
        "restore_map",
        F.map_from_arrays(F.col("entities.placeholder"), F.col("entities.original")),
    ).drop("_r", *[f"_f{i}" for i in range(len(cols))])
    return out if keep_entities else out.drop("entities")


def restore(df: DataFrame, cols: Sequence[str], restore_map: str = "restore_map") -> DataFrame:
    """Put the originals back; ']' ends every placeholder, so the order is free."""
    types = dict(df.dtypes)

    def back(c: Column) -> Column:
        return F.aggregate(
            F.map_entries(restore_map), c, lambda t, e: F.replace(t, e["key"], e["value"])
        )

    return df.withColumns({
        c: F.transform(c, back) if types[c].startswith("array") else back(F.col(c)) for c in cols
    })


def leaks(c: Column) -> Column:
    """Sensitive values left in a text: array<struct<kind,value>>."""
    def tagged(kind: str, values: Column) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        )

    t = or_empty(c)
    return F.concat(
        tagged("ip", _all(t, IP)),
        tagged("host", F.filter(_all(t, FQDN), is_private_host)),
        tagged("email", _all(t, EMAIL)),
    )


def leak_check(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, field, kind, value) for every leak; an empty result means safe to hand out."""
    types = dict(df.dtypes)
    per_field = F.array(*[
        F.struct(
            F.lit(c).alias("field"),
            leaks(F.array_join(c, "\n") if types[c].startswith("array") else F.col(c))
            .alias("hits"),
        )
        for c in cols
    ])
    return (
        df.select(*keys, F.inline(per_field))
        .select(*keys, "field", F.inline("hits"))
    )


def redact_or_fail(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Redact; a text with anything sensitive left fails the job that reads it.

    The check is part of each redacted column, so rows are redacted once and no action runs
    while the plan is built.
    """
    out = redact(df, cols)
    types = dict(out.dtypes)

    def checked(c: str) -> Column:
        left = leaks(F.array_join(c, "\n") if types[c].startswith("array") else F.col(c))
        said = F.concat(F.get(left, F.lit(0))["kind"], F.lit(f" left in field {c}"))
        return F.when(F.size(left) > 0, F.raise_error(said)).otherwise(F.col(c))

    return out.withColumns({c: checked(c) for c in cols})
