"""Roll-ups of findings: counts, groups, themes, narrative, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.assets import IPV4_OR_CIDR, found
from scanlake.functions.severity import narrative_rank, severity_rank
from scanlake.functions.text import (
    estimate_tokens, has_text, join_labels, join_sentences, key_text, or_empty, strip,
)
from scanlake.operators.ordinal import (
    first_k, number_by_order, number_by_pos, prefix_sums,
)
from scanlake.session import staged
from scanlake.tables import fixed

LEVELS = ["Critical", "High", "Medium", "Low"]


def level_counts(severity: Column, informational: bool = False) -> list[Column]:
    levels = [*LEVELS, "Informational"] if informational else LEVELS
    return [F.count_if(severity == s).alias("total_" + s.lower()) for s in levels]


def severity_counts(findings: DataFrame, keys: list[str], informational: bool = False) -> DataFrame:
    """Zero-filled counts per severity; the total is the sum of the four report levels."""
    total = F.count_if(F.col("severity").isin(LEVELS)).alias("total_findings")
    return findings.groupBy(*keys).agg(
        *level_counts(F.col("severity"), informational), total
    )


def scope_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct taxonomy families and subnet groups per key.

    Two levels: distinct pairs first, so that the counting state of a hot key stays small.
    """
    families = findings.select(*keys, "taxonomy_family").distinct().groupBy(*keys).agg(
        F.count("*").alias("family_count"))
    subnets = findings.select(*keys, "subnet_key").distinct().groupBy(*keys).agg(
        F.count("*").alias("subnet_group_count"))
    return families.join(subnets, keys)


# --- outline ----------------------------------------------------------------------

def outline_key() -> list[Column]:
    """Severity first, then title, then id (normalised)."""
    return [
        severity_rank(F.col("severity")).desc(),
        key_text(F.col("display_title")),
        key_text(F.col("id")),
    ]


def _sortable() -> Column:
    return F.struct(
        (-severity_rank(F.col("severity"))).alias("s"),
        key_text(F.col("display_title")).alias("t"),
        key_text(F.col("id")).alias("i"),
    )


def outline_groups(findings: DataFrame) -> DataFrame:
    """One row per (report, taxonomy family, subnet): labels and severity of its first finding,
    and the ids of its findings in outline order.

    The ids of a group are gathered in one row; `outline_members` has them as rows.
    """
    first = F.min_by(
        F.struct("taxonomy_label", "subnet_label", F.col("severity").alias("highest_severity")),
        _sortable(),
    )
    listed = F.collect_list(F.when(F.col("id") != "", F.struct(_sortable().alias("key"), "id")))
    return (
        findings.groupBy("report_id", "taxonomy_family", "subnet_key")
        .agg(first.alias("_f"), F.count("*").alias("finding_count"), F.array_sort(listed).alias("_l"))
        .select("report_id", "taxonomy_family", "subnet_key", "_f.*", "finding_count",
                F.col("_l.id").alias("finding_ids"))
    )


def outline_members(findings: DataFrame) -> DataFrame:
    """(group, finding id, place in the group): the groups' id lists as rows."""
    return number_by_order(
        findings.select(
            "report_id", "taxonomy_family", "subnet_key", "id", "severity", "display_title"
        ),
        ["report_id", "taxonomy_family", "subnet_key"], outline_key(), "place",
    ).select("report_id", "taxonomy_family", "subnet_key", "place", "id")


def dominant_themes(findings: DataFrame, limit: int = 2) -> DataFrame:
    """The `limit` most frequent taxonomy labels per report, with their place."""
    counted = (
        findings.filter(has_text(F.col("taxonomy_label")))
        .groupBy("report_id", F.col("taxonomy_label").alias("theme"))
        .agg(
            F.count("*").alias("theme_count"),
            F.min(narrative_rank(F.col("severity"))).alias("best_rank"),
        )
    )
    order = [F.col("theme_count").desc(), F.col("best_rank"), F.col("theme")]
    return first_k(counted, ["report_id"], order, limit).withColumnRenamed("_rank", "place")


def theme_phrases(findings: DataFrame, limit: int = 2) -> DataFrame:
    """Per report: the dominant themes as 'a and b' (at most `limit` entries are gathered)."""
    return (
        dominant_themes(findings, limit)
        .groupBy("report_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "theme"))).alias("_t"))
        .select("report_id", join_labels(F.col("_t.theme")).alias("theme_phrase"))
    )


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n != 1, F.lit("s"))
                    .otherwise(F.lit("")))


def report_facts(findings: DataFrame) -> DataFrame:
    """One row per report with everything the narrative sentences need."""
    counts = severity_counts(findings, ["report_id"]).join(
        findings.groupBy("report_id").agg(F.count("*").alias("finding_rows")), "report_id"
    )
    groups = outline_groups(findings).drop("finding_ids")
    group_count = groups.groupBy("report_id").agg(F.count("*").alias("group_count"))
    first = (
        first_k(groups, ["report_id"], [F.col("taxonomy_family"), F.col("subnet_key")], 3)
        .groupBy("report_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "taxonomy_label"))).alias("_d"))
        .select("report_id", F.array_join(F.col("_d.taxonomy_label"), ", ").alias("drivers"))
    )
    return (
        counts.join(scope_counts(findings, ["report_id"]), "report_id")
        .join(group_count, "report_id")
        .join(first, "report_id")
        .join(theme_phrases(findings), "report_id", "left")
        .withColumn("theme_phrase", or_empty(F.col("theme_phrase")))
    )


def narrative(facts: DataFrame) -> DataFrame:
    """Risk posture, objectives, context and key drivers, one row per report."""
    crit, high = F.col("total_critical"), F.col("total_high")
    theme = F.col("theme_phrase")
    where = F.when(theme == "", F.lit(fixed.ENVIRONMENT)).otherwise(theme)
    clause = F.when(theme == "", F.lit("")).otherwise(F.concat(F.lit(", concentrated in "), theme))
    elevated = F.lit("The current risk posture remains elevated because ")
    posture = (
        F.when(crit > 0, F.concat(elevated, _plural(crit, "critical finding"),
                                  F.lit(" require immediate remediation"), clause, F.lit(".")))
        .when(high > 0, F.concat(elevated, _plural(high, "high-severity finding"),
                                 F.lit(" require prioritised remediation"), clause, F.lit(".")))
        .when(F.col("finding_rows") > 0, F.concat(
            F.lit("The current risk posture is driven primarily by medium- and low-severity "
                  "findings"),
            F.when(theme == "", F.lit("")).otherwise(
                F.concat(F.lit(" with the strongest concentration in "), theme)),
            F.lit(" that should be addressed through planned remediation.")))
        .otherwise(F.lit(fixed.NO_FINDINGS))
    )
    first = (
        F.when(crit > 0, F.concat(F.lit("Contain and remediate the "),
                                  _plural(crit, "critical finding"),
                                  F.lit(" driving risk in "), where, F.lit(".")))
        .when(high > 0, F.concat(F.lit("Prioritise the "), _plural(high, "high-severity finding"),
                                 F.lit(" driving risk in "), where, F.lit(".")))
        .otherwise(F.concat(
            F.lit("Sequence planned remediation for the "), F.col("finding_rows").cast("string"),
            F.lit(" confirmed medium- and low-severity finding"),
            F.when(F.col("finding_rows") != 1, F.lit("s")).otherwise(F.lit("")),
            F.lit(" across "), where, F.lit(".")))
    )
    second = F.concat(
        F.lit("Coordinate remediation workstreams around "), where,
        F.lit(" while tracking progress across "), F.col("family_count").cast("string"),
        F.lit(" taxonomy "),
        F.when(F.col("family_count") == 1, F.lit("family")).otherwise(F.lit("families")),
        F.lit(" and "), _plural(F.col("subnet_group_count"), "subnet group"), F.lit("."),
    )
    context = F.concat(
        F.lit("The validated assessment identified "),
        _plural(F.col("finding_rows"), "confirmed finding"), F.lit(" across "),
        _plural(F.col("group_count"), "grouped remediation workstream"), F.lit("."),
    )
    drivers = F.when(F.col("drivers") == "", F.lit(fixed.NO_DRIVERS)).otherwise(
        F.concat(F.lit("Primary remediation drivers include "), F.col("drivers"))
    )
    staged = facts.withColumns({
        "risk_posture": posture, "objective_1": first, "objective_2": second,
        "objective_3": F.lit(fixed.TRACE_OBJECTIVE),
        "summary_context": context, "key_drivers": drivers,
        "intro_method": F.lit(fixed.DEFAULT_METHOD),
    })
    return staged.withColumn(
        "introduction_overview",
        join_sentences(F.col("summary_context"), F.col("risk_posture"), F.col("key_drivers")),
    )


def scope_subnets(findings: DataFrame) -> DataFrame:
    """Distinct addresses named in the categories of a report, numbered by first appearance."""
    seen = (
        findings.select(
            "report_id", F.col("first_row").alias("_pos"),
            F.posexplode(found(F.col("category"), IPV4_OR_CIDR)).alias("_i", "subnet"),
        )
        .groupBy("report_id", "subnet")
        .agg(F.min(F.struct("_pos", "_i")).alias("_first"))
    )
    return number_by_order(
        seen, ["report_id"], [F.col("_first._pos"), F.col("_first._i"), F.col("subnet")], "place"
    ).select("report_id", "place", "subnet")


#: Networks that the scope sentence names; the others are counted there and listed in `report_networks`.
NAMED_NETWORKS = 256


def report_networks(subnets: DataFrame) -> DataFrame:
    """(report_id, subnet): the distinct networks of a report as rows."""
    return subnets.select("report_id", "subnet").distinct()


def network_counts(subnets: DataFrame) -> DataFrame:
    """(report_id, subnet_count): exact distinct counts of 'a.b.c.0/24' networks.

    A network is a number below 2^24, so a report has at most 512 bit maps of 2^15
    numbers, whatever the number of rows.
    """
    part = lambda i: F.split_part("subnet", F.lit("."), F.lit(i)).cast("long")
    number = F.shiftleft(part(1), 16) + F.shiftleft(part(2), 8) + part(3)
    n = subnets.filter(F.col("subnet").isNotNull()).select("report_id", number.alias("_n"))
    maps = n.groupBy("report_id", F.bitmap_bucket_number("_n").alias("_bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("_n"))).alias("_c"))
    return maps.groupBy("report_id").agg(F.sum("_c").alias("subnet_count"))


def report_metadata(findings: DataFrame, subnets: DataFrame, named: int = NAMED_NETWORKS) -> DataFrame:
    """Counts and summary sentences per report.

    `subnets` is (report_id, subnet) with /24 networks, repeated ones count once.  The scope
    sentence names the first `named` of them in sorted order and counts the others.
    """
    first = first_k(report_networks(subnets), ["report_id"], [F.col("subnet")], named)
    nets = network_counts(subnets).join(
        first.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_list("subnet")), ", ").alias("_shown")), "report_id")
    nets = nets.withColumn("_nets", F.when(F.col("subnet_count") <= named, F.col("_shown")).otherwise(
        F.format_string(fixed.MORE_NETWORKS, "_shown", F.col("subnet_count") - named))).drop("_shown")
    counts = severity_counts(findings, ["report_id"])
    joined = counts.join(nets, "report_id", "left")
    totals = [f"total_{x}" for x in ("findings", "critical", "high", "medium", "low")]
    return joined.withColumns({
        "executive_summary": F.format_string(fixed.EXECUTIVE_SUMMARY, *totals),
        "scope_summary": F.format_string(fixed.SCOPE_SUMMARY, F.coalesce("_nets", F.lit(fixed.NO_NETWORK))),
        "subnet_count": F.coalesce(F.col("subnet_count"), F.lit(0)),
    }).drop("_nets")


# --- ordering and numbering ----------------------------------------------------------

def number_report(findings: DataFrame) -> DataFrame:
    """Sequence per report in rendering order, with heading and group-break flags.

    Order: outline groups by (family, subnet), findings inside by outline key.  A
    row opens a heading when the label of the row before it differs; that only
    happens at the start of a group, so it is decided on the group table.
    """
    groups = outline_groups(findings).drop("finding_ids")
    numbered_groups = number_by_order(
        groups, ["report_id"], [F.col("taxonomy_family"), F.col("subnet_key")], "group_no"
    )
    prior = numbered_groups.select(
        "report_id", (F.col("group_no") + 1).alias("group_no"),
        F.col("taxonomy_label").alias("_prior"),
    )
    heads = numbered_groups.join(prior, ["report_id", "group_no"], "left").select(
        "report_id", "taxonomy_family", "subnet_key", "group_no",
        F.col("taxonomy_label").alias("group_taxonomy_label"),
        (~F.col("taxonomy_label").eqNullSafe(F.col("_prior"))).alias("_opens"),
    )
    seq = number_by_order(
        findings, ["report_id"],
        [F.col("taxonomy_family"), F.col("subnet_key"), *outline_key()], "seq",
    )
    starts = seq.groupBy("report_id", "taxonomy_family", "subnet_key").agg(
        F.min("seq").alias("_start")
    )
    keys = ["report_id", "taxonomy_family", "subnet_key"]
    return (
        seq.join(heads.join(starts, keys), keys)
        .withColumns({
            "group_start": F.col("seq") == F.col("_start"),
            "new_heading": (F.col("seq") == F.col("_start")) & F.col("_opens"),
            "page_break": F.col("seq") > 1,
        })
        .drop("_start", "_opens")
    )


def fallback_order(findings: DataFrame) -> DataFrame:
    """Order without an outline: severity, category, title, id; groups in first-seen order."""
    rank = F.coalesce(
        *[F.when(F.col("severity") == s, F.lit(r)) for s, r in fixed.RENDER_RANK.items()],
        F.lit(3),
    )
    tax = F.when(has_text(F.col("taxonomy_label")), strip(F.col("taxonomy_label")))
    sub = F.when(has_text(F.col("subnet_label")), strip(F.col("subnet_label")))
    primary = F.coalesce(tax, sub)
    second = F.when(sub != primary, sub)
    heading = F.coalesce(F.when(strip(F.col("category")) != "", strip(F.col("category"))),
                         F.lit("General Findings"))
    keyed = findings.withColumns({
        "group_a": F.when(primary.isNull(), F.lit("legacy")).otherwise(
            F.coalesce(F.when(F.col("taxonomy_family") != "", F.col("taxonomy_family")), primary)),
        "group_b": F.when(primary.isNull(), heading).otherwise(
            F.coalesce(F.when(F.col("subnet_key") != "", F.col("subnet_key")), second, primary)),
    })
    ordered = number_by_order(
        keyed, ["report_id"],
        [rank, or_empty(F.col("category")), or_empty(F.col("display_title")), F.col("id")], "place",
    )
    groups = ordered.groupBy("report_id", "group_a", "group_b").agg(
        F.min("place").alias("group_first")
    )
    return ordered.join(groups, ["report_id", "group_a", "group_b"])


def _by_attributes(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Add `_attr`: the first of the groups whose attributes a finding matches, a blank one matching any."""
    patterns = {
        "_by_both": ["taxonomy_family", "subnet_key"], "_by_family": ["taxonomy_family"],
        "_by_subnet": ["subnet_key"], "_by_any": [],
    }
    out = findings
    for name, cols in patterns.items():
        side = groups
        for c in ("taxonomy_family", "subnet_key"):
            side = side.filter((F.col(c) != "") if c in cols else (F.col(c) == ""))
        keyed = side.groupBy("report_id", *cols).agg(F.min("group_pos").alias(name))
        out = out.join(keyed, ["report_id", *cols], "left")
    return out.withColumn("_attr", F.least(*patterns)).drop(*patterns)


def _taken_by_id(free: Column, listed: Column) -> Column:
    """Which group takes each finding of one id by listing it: an array beside `free`.

    `free` holds for each finding, in order, the group that takes it by its attributes (or
    NULL).  Each listing, in order, takes the first finding that no earlier group has.
    """
    none = F.transform(free, lambda x: F.lit(None).cast("long"))

    def take(taken: Column, group: Column) -> Column:
        open_ = F.filter(
            F.sequence(F.lit(0), F.size(free) - 1),
            lambda i: F.get(taken, i).isNull() & (F.coalesce(F.get(free, i), group) >= group))
        return F.transform(taken, lambda x, i: F.when(i == F.get(open_, F.lit(0)), group).otherwise(x))

    return F.aggregate(listed, none, take)


def assign_to_groups(
    findings: DataFrame, groups: DataFrame, members: DataFrame, order: str = "id"
) -> DataFrame:
    """Place findings into outline groups; `group_pos` is NULL for leftovers.

    `groups` is (report_id, group_pos, taxonomy_family, subnet_key) and `members`
    (report_id, group_pos, id).  Groups come one after the other: a group takes, for each
    id it lists, the first finding with that id (in `order`, unique among them) that no
    earlier group has.  Only when it gets none that way, be it that its ids do not exist
    or that earlier groups have them all, it takes every finding left that matches its
    attributes; a blank attribute matches any.

    Which groups fall back depends on earlier groups alone.  So all groups are judged at
    once by the fall-backs of the last round, until those stay the same: a round settles
    at least one more position, in practice nearly all.
    """
    trimmed = lambda c: strip(or_empty(F.col(c)))
    texts = ("taxonomy_family", "subnet_key")
    f = staged(findings.select("report_id", trimmed("id").alias("id"), F.col(order).alias("_order"), *[trimmed(c).alias(c) for c in texts]), "group_findings")
    g = staged(groups.select("report_id", F.col("group_pos").cast("long").alias("group_pos"), *[trimmed(c).alias(c) for c in texts]), "groups")
    lists = members.select("report_id", F.col("group_pos").cast("long").alias("group_pos"), trimmed("id").alias("id")).filter("id <> ''")
    lists = lists.join(g.select("report_id", "group_pos"), ["report_id", "group_pos"], "left_semi")
    lists = staged(lists.groupBy("report_id", "id").agg(F.array_sort(F.collect_list("group_pos")).alias("listed")), "listed_ids")
    falling, last = g.limit(0), None
    while True:
        free = _by_attributes(f, falling)
        named = free.groupBy("report_id", "id").agg(F.array_sort(F.collect_list(F.struct("_order", "_attr"))).alias("_f")).join(lists, ["report_id", "id"])
        taken = named.select("report_id", "id", F.inline(F.arrays_zip(
            F.col("_f._order").alias("_order"), _taken_by_id(F.col("_f._attr"), F.col("listed")).alias("_by_id"))))
        taken = staged(taken.filter("_by_id IS NOT NULL"), "taken")
        falling = staged(g.join(taken.select("report_id", F.col("_by_id").alias("group_pos")).distinct(), ["report_id", "group_pos"], "left_anti"), "falling")
        now = falling.agg(F.count("*"), F.sum(F.xxhash64("report_id", "group_pos").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    placed = _by_attributes(f, falling).join(taken, ["report_id", "id", "_order"], "left").select(
        "report_id", "id", "_order", F.coalesce("_by_id", "_attr").alias("group_pos"))
    placed = placed.withColumnsRenamed({"report_id": "_r", "id": "_i"})
    same = (F.col("report_id") == F.col("_r")) & (trimmed("id") == F.col("_i")) & F.col(order).eqNullSafe(F.col("_order"))
    return findings.join(placed, same, "left").drop("_r", "_i", "_order")


# --- tables about tables ---------------------------------------------------------------

def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distribution of each column: (field, value, n)."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], columns, "field", "value").groupBy("field", "value").agg(
        F.count("*").alias("n")
    )


def scan_vuln_summary(rows: DataFrame) -> DataFrame:
    """Per raw title: risk of its first row, rows and distinct hosts; reported levels only."""
    per_name = rows.groupBy("raw_name").agg(
        F.min_by("severity", "row_id").alias("risk"), F.count("*").alias("row_count")
    )
    hosts = (
        rows.filter(F.col("host").isNotNull()).select("raw_name", "host").distinct()
        .groupBy("raw_name").agg(F.count("*").alias("host_count"))
    )
    return (
        per_name.filter(F.col("risk").isin(LEVELS))
        .join(hosts, "raw_name", "left")
        .withColumn("host_count", F.coalesce(F.col("host_count"), F.lit(0)))
    )


def scan_vuln_hosts(rows: DataFrame) -> DataFrame:
    """(raw title, host), distinct: the complete host lists as rows."""
    return rows.filter(F.col("host").isNotNull()).select("raw_name", "host").distinct()


def determinism_audit(runs: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """Fields whose value differs between runs: (key, field, distinct_values, samples).

    Distinct (key, field, value) rows come first; counting and the three samples
    then work on those, so a key repeated in many runs does not pile up.
    """
    text = runs.select(
        strip(F.lower(key)).alias("key"), *[strip(or_empty(F.col(f))).alias(f) for f in fields]
    ).filter(F.col("key") != "")
    values = text.unpivot(["key"], fields, "field", "value").distinct()
    counts = values.groupBy("key", "field").agg(F.count("*").alias("distinct_values"))
    samples = (
        first_k(values, ["key", "field"], [F.col("value")], 3)
        .groupBy("key", "field")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("samples"))
    )
    return counts.filter("distinct_values > 1").join(samples, ["key", "field"])


def audit_totals(runs: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """One row: tracked fields, varying fields and their percentage."""
    text = runs.select(
        strip(F.lower(key)).alias("key"), *[strip(or_empty(F.col(f))).alias(f) for f in fields]
    ).filter(F.col("key") != "")
    values = text.unpivot(["key"], fields, "field", "value").distinct()
    counts = values.groupBy("key", "field").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("total_fields"), F.count_if(F.col("n") > 1).alias("varying_fields")
    ).withColumn(
        "percent",
        F.round(100 * F.col("varying_fields") / F.greatest(F.col("total_fields"), F.lit(1)), 1),
    )


def top_varying(audit: DataFrame, limit: int = 20) -> DataFrame:
    return audit.orderBy(F.col("distinct_values").desc(), "key", "field").limit(limit)


def event_counts(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type per run; runs without any count zero."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("type") == event_type).alias("n")
    )


# --- batches, budgets, candidates ---------------------------------------------------------

def batch_rows(df: DataFrame, keys: list[str], pos: str, size: int = 5) -> DataFrame:
    """Fixed-size batches in order: batch_no and the item key 'f<index>'."""
    idx = number_by_pos(df, keys, pos, "_n").withColumn("_n", F.col("_n") - 1)
    return idx.withColumns({
        "batch_no": F.floor(F.col("_n") / size).cast("long"),
        "item_key": F.concat(F.lit("f"), F.col("_n").cast("string")),
    }).drop("_n")


def budget_cut(df: DataFrame, keys: list[str], pos: str, text: Column, limit: int) -> DataFrame:
    """Running token estimate per key; rows past the limit are flagged."""
    summed = prefix_sums(df, keys, pos, {"tokens_so_far": estimate_tokens(text)})
    return summed.withColumn("over_budget", F.col("tokens_so_far") > limit)


def normalise_candidates(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Numeric vuln_id: its first digits, else those of the id, else 10^6 + place."""
    digits = lambda c: F.regexp_extract(or_empty(c), r"(\d+)", 1)
    raw = F.when(or_empty(F.col("vuln_id")) != "", F.col("vuln_id")).otherwise(F.col("id"))
    placed = number_by_pos(df, keys, pos, "_n")
    return placed.withColumn(
        "vuln_no",
        F.coalesce(digits(raw).try_cast("long"), F.lit(10**6).cast("long") + F.col("_n") - 1),
    ).drop("_n")
