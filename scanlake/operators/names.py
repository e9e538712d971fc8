"""Names of two finding sets: what only one has, and the closest name of the other set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.text import strip
from scanlake.session import stable


def distinct_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Lower-cased, trimmed, distinct names."""
    return (
        df.select(strip(F.lower(F.col(name))).alias("name")).filter(F.col("name") != "").distinct()
    )


def gap_analysis(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names found in only one of two sets, with the side they are on."""
    left, right = distinct_names(a), distinct_names(b)
    return (
        left.join(right, "name", "left_anti").withColumn("side", F.lit("a_only"))
        .unionByName(
            right.join(left, "name", "left_anti").withColumn("side", F.lit("b_only"))
        )
    )


#: Similarities at which closest names are looked for, one after the other.
LEVELS = (0.9, 0.8, 0.7)
#: Shared rare grams beyond the least that a pair must have; more of them leave fewer pairs.
EXTRA = 3
#: Names of at most so many characters have single characters as grams too.
SHORT = 10
#: A gram of more names than this is dealt to SALTS tasks.
HOT, SALTS = 4096, 16
BLOCK_NAMES = 512


def name_grams(names: DataFrame) -> DataFrame:
    """(name, n, q, gram, pos, times): numbered grams of two characters, and of one for short names.

    `gram` stands for a text and the how-manieth time it occurs in the name; `times` is
    how often it occurs in all.
    """
    chars = F.split("name", "")
    sized = names.select("name", F.size(chars).alias("n"), chars.alias("_c"))

    def of(q: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.col("n") - q),
            lambda i: F.struct(F.lit(q).alias("q"), F.xxhash64(*[F.get("_c", i + j) for j in range(q)]).alias("text"), i.alias("pos")))

    none = F.array().cast("array<struct<q: int, text: bigint, pos: int>>")
    both = F.concat(
        F.when(F.col("n") >= 2, of(2)).otherwise(none), F.when(F.col("n") <= SHORT, of(1)).otherwise(none))
    places = sized.select("name", "n", F.inline(both)).groupBy("name", "n", "q", "text").agg(
        F.array_sort(F.collect_list("pos")).alias("_at"))
    return places.select(
        "name", "n", "q", "text", F.size("_at").alias("times"), F.posexplode("_at").alias("_i", "pos")
    ).select("name", "n", "q", F.xxhash64("q", "text", "_i").alias("gram"), "pos", "times")


def rare_first(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, n, q, grams): the grams of a name, those of few names first."""
    known = grams.join(counts, "gram", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("names", "gram", "pos", "times")))
    return known.groupBy("name", "n", "q").agg(listed.alias("grams"))


def edits(length: Column, similarity: float) -> Column:
    """How many edits a pair may differ by whose longer name has this length."""
    return F.floor(length * (1 - similarity) + 1e-9).cast("int")


def prefixes(listed: DataFrame, similarity: float) -> DataFrame:
    """(name, n, q, size, names, gram, pos, times): the rare grams that stand for a name.

    An edit changes at most q grams, so of a name's first q * k + EXTRA grams a partner
    within k edits lacks at most q * k.
    """
    k = edits(F.col("n") / similarity, similarity)  # the longest partner decides
    size = F.least(F.size("grams"), k * F.col("q") + EXTRA)
    return listed.select("name", "n", "q", size.alias("size"), F.inline(F.slice("grams", F.lit(1), size)))


def candidate_pairs(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """(name, match): every pair of at least this similarity, and few others.

    `left` and `right` come from `rare_first` with the same counts.  The prefixes of a
    pair within k edits share at least the shorter one's size less q * k grams; a gram
    that both have once stands at most k places apart, and the lengths differ by at
    most k.
    """
    a, b = prefixes(left, similarity), prefixes(right, similarity)
    hot = F.col("names") > HOT
    a = a.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64("name"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    b = b.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    b = b.select("gram", "_salt", F.col("name").alias("match"), F.col("n").alias("m"), F.col("size").alias("_size"), F.col("pos").alias("_pos"), F.col("times").alias("_times"))
    k = edits(F.greatest("n", "m"), similarity)
    fits = (F.abs(F.col("n") - F.col("m")) <= k) & (
        (F.col("times") > 1) | (F.col("_times") > 1) | (F.abs(F.col("pos") - F.col("_pos")) <= k))
    need = F.least("size", "_size") - F.col("q") * k
    return (
        a.join(b, ["gram", "_salt"]).filter(fits)
        .groupBy("name", "match", "q").agg(F.count("*").alias("_shared"), F.max(need).alias("_need"))
        .filter(F.col("_shared") >= F.greatest("_need", F.lit(1)))
        .select("name", "match").distinct()
    )


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer name."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _best(scored: DataFrame) -> DataFrame:
    """(name, match, similarity) from (name, best): the best struct (s, match) of each name."""
    return scored.groupBy("name").agg(F.min("best").alias("best")).select(
        "name", F.col("best.match").alias("match"), (-F.col("best.s")).alias("similarity"))


def _score(name: Column, match: Column) -> Column:
    return F.struct((-F.round(name_similarity(name, match), 9)).alias("s"), match.alias("match"))


def compare_blocks(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """The best match of every name, by comparing it with all names of a fitting length.

    The names of `right` are packed per length into blocks; a name meets a block as one
    row, and the best over its blocks is one aggregation.
    """
    sized = right.withColumn("len", F.length("name"))
    per_len = sized.groupBy("len").agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("_blocks"))
    blocks = (
        sized.join(per_len, "len").withColumn("_b", F.pmod(F.xxhash64("name"), F.col("_blocks")))
        .groupBy("len", "_b").agg(F.collect_list("name").alias("names"))
    )
    # one row a length of a name: per length, which blocks there are
    reach = per_len.select("len", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
    n = F.length("name")
    lens = F.sequence(F.floor(n * minimum), F.ceil(n / minimum)).cast("array<int>")
    asked = left.withColumn("len", F.explode(lens)).join(reach, "len")
    best = F.array_min(F.transform("names", lambda x: _score(F.col("name"), x)))
    return _best(asked.join(blocks, ["len", "_b"]).select("name", best.alias("best"))).filter(F.col("similarity") > minimum)


def closest_name(a: DataFrame, b: DataFrame, minimum: float = 0.5) -> DataFrame:
    """For each name of `a` the most similar name of `b`, when the similarity exceeds `minimum`.

    Exact.  Names are looked for at falling similarities: a pair of at least 0.9 shares
    rare grams, which a join finds; a name that has such a match is settled, since a
    better one would have been met as well.  Only names without a match of 0.7 are
    compared with all names of a fitting length: below that, unrelated names have as
    many grams in common as related ones.
    """
    left, right = stable(distinct_names(a)), stable(distinct_names(b))
    grams = stable(name_grams(right))
    counts = grams.groupBy("gram").agg(F.count("*").alias("names"))
    filed = stable(rare_first(grams, counts))
    asked = stable(rare_first(name_grams(left), counts))
    found = None
    exact = [minimum] if minimum >= LEVELS[-1] else []
    for level in [x for x in LEVELS if x > minimum] + exact:
        pairs = candidate_pairs(asked, filed, level)
        best = _best(pairs.select("name", _score(F.col("name"), F.col("match")).alias("best")))
        best = stable(best.filter((F.col("similarity") >= level) & (F.col("similarity") > minimum)))
        found = best if found is None else found.unionByName(best)
        asked = stable(asked.join(best.select("name"), "name", "left_anti"))
    if exact:
        return found
    rest = compare_blocks(asked.select("name").distinct(), right, minimum)
    return found.unionByName(rest)


def host_consolidation(stated: DataFrame, summary: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Stated names joined to their closest scan title and that title's host count."""
    pairs = closest_name(stated, summary.select(F.col("raw_name").alias("name")), minimum)
    hosts = (
        summary.select(strip(F.lower("raw_name")).alias("match"), "host_count", "row_count")
        .groupBy("match")
        .agg(F.max("host_count").alias("host_count"), F.max("row_count").alias("row_count"))
    )
    return pairs.join(hosts, "match")
