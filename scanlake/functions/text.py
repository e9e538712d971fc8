"""Column builders for cleaning text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.tables import fixed

BLANKS = " \t\n\r\f\x0b"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def strip(c: Column) -> Column:
    """Trim ASCII white space, including tabs and line breaks."""
    return F.btrim(c, F.lit(BLANKS))


def strip_cell(c: Column) -> Column:
    """`strip` for a plain column, NULL as empty: the slow cut at the right only where a text ends in a blank."""
    t = or_empty(c)
    blank = t.endswith(BLANKS[0])
    for b in BLANKS[1:]:
        blank = blank | t.endswith(b)
    return F.when(blank, strip(t)).otherwise(F.ltrim(t, F.lit(BLANKS)))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def not_blank(c: Column) -> Column:
    """The value itself, or NULL when it is the empty string."""
    return F.when(c != "", c)


def cell_text(c: Column) -> Column:
    """Trimmed cell; 'nan' and 'none' count as empty."""
    return drop_nan(strip(or_empty(c)))


def drop_nan(trimmed: Column) -> Column:
    """The second half of `cell_text`, for a column that is already trimmed."""
    short = F.octet_length(trimmed) <= 4  # a long text is not lower-cased for nothing
    return F.when(short & F.lower(trimmed).isin("nan", "none"), F.lit("")).otherwise(trimmed)


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(or_empty(c))).isin(fixed.PLACEHOLDERS)


def has_text(c: Column) -> Column:
    return ~is_placeholder(c)


def meaningful(c: Column) -> Column:
    """Trimmed value, or NULL when it is missing or a sentinel."""
    t = strip(c)
    return F.when(~F.lower(t).isin(fixed.PLACEHOLDERS), t)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(or_empty(c), r"\s+", " "))


def key_text(c: Column) -> Column:
    return squeeze(F.lower(c))


def strip_plugin_id(c: Column) -> Column:
    """Drop a leading '[123]'; keep the text when nothing else is left."""
    bare = strip(F.regexp_replace(or_empty(c), r"^\s*\[\d+\]\s*", ""))
    return F.coalesce(not_blank(bare), strip(or_empty(c)))


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    body = F.regexp_replace(or_empty(c), "(?:" + LINE_BREAK + r")\z", "")
    return F.when(or_empty(c) == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK)
    )


def report_text(c: Column) -> Column:
    """Normalise line ends, drop control characters, squeeze and drop blank lines."""
    t = F.replace(or_empty(c), F.lit("_x000D_"), F.lit("\n"))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")
    lines = F.transform(
        F.split(t, "[\n\u2028\u2029]"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def any_contains(c: Column, needles: Sequence[str]) -> Column:
    """True when the text contains one of a fixed list of literals."""
    hit = c.contains(needles[0])
    for n in needles[1:]:
        hit = hit | c.contains(n)
    return hit


def lookup(c: Column, mapping: dict[str, str | int], default: Column | None = None) -> Column:
    """Constant map look-up by equality."""
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(default) if default is not None else out


def first_keyword(c: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Label of the first rule one of whose keywords occurs in the text, else NULL."""
    out = None
    for words, label in rules:
        cond = any_contains(c, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def trim_text(c: Column, limit: int) -> Column:
    t = strip(or_empty(c))
    cut = F.rtrim(F.substring(t, 1, max(0, limit - 3)))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("...")))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.floor(F.length(or_empty(c)) / 4), F.lit(1)).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(strip(or_empty(c)), r"\s+"), lambda w: w != "")


def truncate_words(c: Column, limit: int) -> Column:
    """The first `limit` words joined by spaces; shorter texts are unchanged."""
    w = words(c)
    return F.when(F.size(w) <= limit, c).otherwise(F.array_join(F.slice(w, 1, limit), " "))


def ensure_sentence(c: Column) -> Column:
    t = strip(or_empty(c))
    return F.when(t == "", t).when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def join_sentences(*cols: Column) -> Column:
    parts = F.array(*[ensure_sentence(c) for c in cols])
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ")


def join_labels(labels: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'."""
    a = F.filter(F.transform(labels, strip), lambda x: has_text(x))
    n = F.size(a)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.get(a, F.lit(0)))
        .when(n == 2, F.concat_ws(" and ", a))
        .otherwise(
            F.concat(
                F.array_join(F.slice(a, F.lit(1), n - 1), ", "),
                F.lit(", and "),
                F.get(a, n - 1),
            )
        )
    )


_ACCENTS = (
    "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž",
    "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrsssstt" + "uuuuuuuuuuwyyyzzz",
)


def slug(c: Column) -> Column:
    """Lower ASCII words joined by '-'; accents on Latin letters are dropped."""
    plain = F.translate(F.lower(or_empty(c)), *_ACCENTS)
    plain = F.regexp_replace(plain, r"[^\x00-\x7f]", "")
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def title_from_slug(c: Column, fallback: str) -> Column:
    t = F.trim(F.replace(or_empty(c), F.lit("-"), F.lit(" ")))
    return F.when(t == "", F.lit(fallback)).otherwise(F.initcap(t))


def is_noisy_line(c: Column) -> Column:
    """Separator, snip marker or mostly non-alphanumeric line."""
    s = strip(or_empty(c))
    visible = F.regexp_replace(s, r"\s", "")
    n = F.length(visible)
    punct = F.length(F.regexp_replace(visible, r"[\p{L}\p{N}]", ""))
    weird = F.length(
        F.regexp_replace(visible, r"""[\p{L}\p{N}.,:;/\-_()\[\]{}'"%#@&+=<>!?*|\\]""", "")
    )
    ratio = (weird / n >= 0.12) | ((punct / n >= 0.45) & ((n - punct) / n <= 0.55))
    return (
        F.when(s == "", F.lit(False))
        .when(s.rlike(r"^[.\-\[\]]{3,}$"), F.lit(True))
        .when(F.lower(s).rlike(r"^[- ]*snip[- ]*$"), F.lit(True))
        .when(F.lower(s).contains("_x000d_"), F.lit(True))
        .when(n < 16, F.lit(False))
        .otherwise(ratio)
    )


def is_evidence(c: Column) -> Column:
    """Text that reads like scan evidence rather than a requirement."""
    t = report_text(c)
    lower = F.lower(t)
    lines = F.split(lower, "\n")
    prefix = "^(?:" + "|".join(fixed.EVIDENCE_PREFIXES) + ")"
    hits = F.size(F.filter(lines, lambda x: x.rlike(prefix)))
    return F.when(is_placeholder(t), F.lit(False)).otherwise(
        any_contains(lower, fixed.EVIDENCE_MARKERS)
        | (hits >= 2)
        | F.exists(F.split(t, "\n"), is_noisy_line)
    )


def first_sentence(c: Column) -> Column:
    return strip(F.get(F.split(c, r"(?<=[.!?])\s+", 2), F.lit(0)))


def norm_label(c: Column) -> Column:
    return squeeze(F.lower(c))
