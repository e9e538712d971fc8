"""Document fingerprints: consistent weighted sampling, DataFrame functions only.

A text is a set of weighted terms: its words (split at white space) with their counts.
For each of SAMPLES samples every term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes
of (term, sample) alone, rounds the logarithm of its weight w to

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r,

and the term with the least a is the sample, together with its t.  Two texts draw the same
(term, t) with a probability equal to their generalised Jaccard similarity
sum(min(w)) / sum(max(w)).  A fingerprint is the SAMPLES samples as six hexadecimal
digits each; the share of equal ones is the likeness of two fingerprints.

A sample is kept as one 64-bit number, ln a in front of the hash of (term, t), so that a
plain minimum finds it, in the task that holds the text.

Null texts are empty; texts without a word have the fingerprint of zeros.  Ties of an id
are ordered by content; rows equal in id and text count as one in the order and each get
a result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import content_key, stage, whole_text

SAMPLES, GROUP = 32, 8
EMPTY = "0" * (6 * SAMPLES)


def _unit(h: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))


def term_samples(terms: DataFrame, *keys: str) -> DataFrame:
    """From (keys, term, w): keys, g and the least numbers s0.. of the samples of group g."""
    e = terms.select(*keys, "term", F.log(F.col("w").cast("double")).alias("lw"), F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // GROUP - 1))).alias("g"))
    for j in range(GROUP):
        seed = F.col("g") * GROUP + j
        e = e.withColumns({f"h{j}": F.xxhash64("term", seed), f"k{j}": F.xxhash64(seed, "term", F.lit(1))})
    draws = {}
    for j in range(GROUP):
        h, k = F.col(f"h{j}"), F.col(f"k{j}")
        draws[f"r{j}"] = -F.log(_unit(h, 0, 21) * _unit(h, 21, 21))
        draws[f"c{j}"] = F.log(-F.log(_unit(h, 42, 21) * _unit(k, 0, 21)))
        draws[f"b{j}"] = _unit(k, 21, 40)
    e = e.select(*keys, "term", "lw", "g", *[c.alias(n) for n, c in draws.items()])
    e = e.select("*", *[F.floor(F.col("lw") / F.col(f"r{j}") + F.col(f"b{j}")).alias(f"t{j}") for j in range(GROUP)])
    least = []
    for j in range(GROUP):
        r, c, b, t = (F.col(f"{x}{j}") for x in "rcbt")
        order = ((c - r * (t - b) - r + F.lit(128.0)) * F.lit(float(1 << 31))).cast("long")
        least.append(F.min(F.shiftleft(order, 24).bitwiseOR(F.xxhash64("term", t).bitwiseAND(F.lit(0xFFFFFF)))).alias(f"s{j}"))
    return e.groupBy(*keys, "g").agg(*least)


def fingerprint_columns(samples: DataFrame, *keys: str) -> DataFrame:
    """keys, fingerprint."""
    part = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFF)))), 6, "0") for j in range(GROUP)])
    p = samples.select(*keys, "g", part.alias("part"))
    return p.groupBy(*keys).agg(F.concat(*[F.max(F.when(F.col("g") == g, F.col("part"))) for g in range(SAMPLES // GROUP)]).alias("fingerprint"))


def word_terms(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, term (hash of a word), w (its count): counted inside the row, by sorting its hashes."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")
    t = texts.select(*keys, F.sort_array(F.transform(words, lambda x: F.xxhash64(x))).alias("_h")).filter(F.size("_h") > 0)
    h, n = F.col("_h"), F.size("_h")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(h, i) != F.element_at(h, F.least(i + 1, n))))
    t = t.select(*keys, "_h", ends.alias("_e"))
    term = F.transform("_e", lambda e, j: F.struct(F.element_at(h, e).alias("term"), (e - F.when(j > 0, F.element_at(F.col("_e"), F.greatest(j, F.lit(1)))).otherwise(0)).alias("w")))
    return t.select(*keys, F.inline(term))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, 6 * i + 1, 6) == F.substring(b, 6 * i + 1, 6), 1).otherwise(0) for i in range(SAMPLES)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(SAMPLES))


def neighbours(ids: DataFrame) -> DataFrame:
    """Add next_k, prev_k and prev_n to rows (k, doc_id, n), in the order of (doc_id, k), first after last.

    The rows are range-partitioned; only each part's ends are looked at together.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = stage(ids.repartitionByRange(parts, "doc_id", "k").withColumn("part", F.spark_partition_id()), "order")
    w = Window.partitionBy("part").orderBy("doc_id", "k")
    r = r.select("*", F.lead("k").over(w).alias("next_k"), F.lag("k").over(w).alias("prev_k"), F.lag("n").over(w).alias("prev_n"))
    row = F.struct("doc_id", "k", "n")
    ends = r.groupBy("part").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    over = Window.orderBy("part")  # a row a partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lead("head").over(over), F.first("head").over(whole)).alias("after"),
        F.coalesce(F.lag("tail").over(over), F.last("tail").over(whole)).alias("before"))
    r = r.join(ends, "part")
    return r.select(
        "k", "doc_id", "n", "m", F.coalesce("next_k", "after.k").alias("next_k"), F.coalesce("prev_k", "before.k").alias("prev_k"),
        F.coalesce("prev_n", "before.n").alias("prev_n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint for every document."""
    t = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text")).withColumn("k", content_key(F.col("doc_id"), F.col("text")))
    m = t.groupBy("k", "doc_id").agg(F.count("*").alias("m"))
    found = fingerprint_columns(term_samples(word_terms(t, "text", "k"), "k"), "k")
    rows = m.select("k", "doc_id", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return rows.join(found, "k", "left").select("doc_id", F.coalesce("fingerprint", F.lit(EMPTY)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter from the next document's start)."""
    d = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    d = d.select(content_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    ids = d.groupBy("k", "doc_id").agg(F.count("*").alias("m"), F.max(F.length("text")).alias("n"))
    order = stage(neighbours(ids), "neighbours")
    texts = d.select("k", "text").join(order.select("k", "n", "prev_k", "prev_n"), "k")
    heads = texts.select(F.col("prev_k").alias("k"), F.expr("substring(text, 1, cast(prev_n div 4 as int))").alias("head")).dropDuplicates(["k"])
    both = texts.select("k", "text", "n").join(heads, "k")
    both = both.select("k", "text", F.concat(F.expr("substring(text, 1, cast(n - n div 4 as int))"), "head").alias("edited"))
    sides = both.select("k", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))))
    terms = word_terms(sides, "t", "k", "side")  # a repeated row repeats terms, which leaves the minima as they are
    found = fingerprint_columns(term_samples(terms, "k", "side"), "k", "side").groupBy("k").agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    sha = both.select("k", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")).dropDuplicates(["k"])
    r = order.select("k", "doc_id", "n", "m", "next_k").join(sha, "k").join(found, "k", "left")
    r = r.withColumns({c: F.coalesce(c, F.lit(EMPTY)) for c in ("fingerprint", "edited_fingerprint")})
    r = stage(r, "fingerprints")
    after = r.select(F.col("k").alias("next_k"), F.col("fingerprint").alias("_next"))
    r = r.join(after, "next_k").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return r.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
