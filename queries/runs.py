"""Queries over run events, run history and response tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries import duck as d
from queries.views import view
from scanlake.operators import history as H
from scanlake.operators import responses as R
from scanlake.operators import rollup as r
from scanlake.session import ensure_checkpoint_dir
from scanlake.sources import stored as ST


def events(spark, sf):
    return view(spark, sf, "run_events")


def event_counts(spark, sf):
    return r.event_counts(events(spark, sf), "click")


def batches(spark, sf):
    return r.batch_rows(events(spark, sf), ["run_id"], "event_id", 5).select(
        "run_id", "event_id", "batch_no", "item_key")


def batch_sizes(spark, sf):
    numbered = r.batch_rows(events(spark, sf), ["run_id"], "event_id", 5)
    return numbered.groupBy("run_id", "batch_no").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list("event_id")),
                                 lambda x: x.cast("string")), ",").alias("members"))


def budget_cut(spark, sf):
    text = F.concat_ws(" ", "type", "data", F.repeat(F.lit("x"), F.col("value").cast("int")))
    return r.budget_cut(events(spark, sf), ["run_id"], "event_id", text, 300).select(
        "run_id", "event_id", "tokens_so_far", "over_budget")


def candidates(spark, sf):
    base = events(spark, sf).withColumns({
        "vuln_id": F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("v-"), F.col("event_id").cast("string"), F.lit("-9")))
        .otherwise(F.lit("none")),
        "id": F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("VAPT-"), F.col("run_id"))).otherwise(F.lit("x")),
    })
    return r.normalise_candidates(base, ["run_id"], "event_id").select("run_id", "event_id", "vuln_no")


def _history(spark, sf):
    """Every event as one written history entry: many writes per entry id."""
    e = events(spark, sf)
    return e.select(
        F.concat(F.lit("hist-"), (F.col("event_id") % 700).cast("string")).alias("id"),
        F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("scan "), F.col("run_id"))).alias("input_name"),
        F.concat(F.lit("file-"), F.col("type")).alias("source_file"),
        F.when(F.col("event_id") % 2 == 0, F.lit(7)).alias("finding_count"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("type", "run_id")).alias("findings"),
        F.struct(F.array("type").alias("findings")).alias("analysis_data"),
        F.col("event_id").alias("version"),
    )


def history_upsert(spark, sf):
    h = _history(spark, sf)
    old, new = h.filter(F.col("version") % 2 == 0), h.filter(F.col("version") % 2 == 1)
    return H.coerce_history(H.upsert(old, new, ["id"], "version")).select(
        "id", "date", "input_name", "source_file", "finding_count", "version",
        F.array_join("findings", ",").alias("findings"))


def history_list(spark, sf):
    return H.list_history(history_upsert(spark, sf)).select("id", "date", "finding_count")


_HISTORY = ["id", "date", "input_name", "source_file", "finding_count", "version"]


def _stored(spark, sf):
    """The history as a table on disk: every second version stored, the others upserted in place."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}"
        h = H.coerce_history(_history(spark, sf)).select(*_HISTORY, F.array_join("findings", ",").alias("findings")).withColumn("id", F.upper("id"))
        last = lambda part: H.upsert(part.limit(0), part, ["id"], "version")
        ST.create_table(last(h.filter(F.col("version") % 2 == 0)), path, ["id"], 16)
        ST.upsert_table(h.filter(F.col("version") % 2 == 1), path, "version")
        _TABLES[key] = path
    return _TABLES[key]


_TABLES: dict[tuple[str, str], str] = {}


def stored_history(spark, sf):
    return ST.read_table(spark, _stored(spark, sf)).select(*_HISTORY, "findings")


def point_lookup(spark, sf):
    return ST.lookup_key(spark, _stored(spark, sf), H.norm_id(" 42 ", "HIST-")).select(*_HISTORY, "findings")


def many_lookups(spark, sf):
    """The history rows whose number some user has."""
    wanted = view(spark, sf, "run_events").select(F.concat(F.lit("HIST-"), "run_id").alias("id"))
    return ST.lookup_keys(wanted, _stored(spark, sf)).select(*_HISTORY, "findings")


def parse_responses(spark, sf):
    parsed = R.normalise_result(R.parse_responses(view(spark, sf, "responses")))
    return parsed.select(
        "conv_id", "turn", "parse_stage", "item_key", "business_impact", "primary", "secondary",
        F.get("refs", F.lit(0))["title"].alias("ref_title"), F.size("refs").alias("n_refs"))


def explode_findings(spark, sf):
    parsed = R.parse_responses(view(spark, sf, "responses"))
    return R.explode_findings(parsed, ["conv_id", "turn"]).select(
        "conv_id", "turn", "item_no", "name", "severity")


def quarantine(spark, sf):
    return R.quarantine(R.parse_responses(view(spark, sf, "responses"))).select("conv_id", "turn")


QUERIES = {
    "event_counts": event_counts, "batches": batches, "batch_sizes": batch_sizes,
    "budget_cut": budget_cut, "candidates": candidates, "history_upsert": history_upsert,
    "history_list": history_list, "point_lookup": point_lookup,
    "stored_history": stored_history, "many_lookups": many_lookups,
    "parse_responses": parse_responses, "explode_findings": explode_findings,
    "quarantine": quarantine,
}

_HIST = f"""{d.EVENTS},
h AS (SELECT concat('hist-', event_id % 700) AS id, CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 3 = 0 THEN concat('file-', type) ELSE concat('scan ', run_id) END AS input_name, concat('file-', type) AS source_file,
  CASE WHEN event_id % 5 = 0 THEN type ELSE concat(type, ',', run_id) END AS findings,
  CASE WHEN event_id % 2 = 0 THEN 7 WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS finding_count, event_id AS version FROM run_events),
hu AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM h) WHERE rn = 1)"""
_CASES = f"""{d.REPLIES}, ok AS (SELECT *, turn % 3 AS k FROM responses JOIN conversations USING (conv_id, turn) WHERE turn % 7 <> 3)"""

ORACLE = {
    "event_counts": d.q(d.EVENTS, "SELECT run_id, count(*) FILTER (type = 'click') AS n FROM run_events GROUP BY run_id"),
    "batches": d.q(d.EVENTS, "SELECT run_id, event_id, rn // 5 AS batch_no, concat('f', rn) AS item_key FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS rn FROM run_events)"),
    "batch_sizes": d.q(d.EVENTS, "SELECT run_id, rn // 5 AS batch_no, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS members FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS rn FROM run_events) GROUP BY run_id, rn // 5"),
    "budget_cut": d.q(d.EVENTS, "SELECT run_id, event_id, t AS tokens_so_far, t > 300 AS over_budget FROM (SELECT run_id, event_id, CAST(sum(greatest(length(concat_ws(' ', type, data, repeat('x', CAST(trunc(value) AS INT)))) // 4, 1)) OVER (PARTITION BY run_id ORDER BY event_id) AS BIGINT) AS t FROM run_events)"),
    "candidates": d.q(d.EVENTS, """SELECT run_id, event_id, coalesce(TRY_CAST(nullif(regexp_extract(raw, '([0-9]+)', 1), '') AS BIGINT), 1000000 + row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1) AS vuln_no FROM
      (SELECT *, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN concat('VAPT-', run_id) ELSE 'x' END WHEN 1 THEN concat('v-', event_id, '-9') ELSE 'none' END AS raw FROM run_events)"""),
    "history_upsert": d.q(_HIST, "SELECT id, date, input_name, source_file, finding_count, version, findings FROM hu"),
    "history_list": d.q(_HIST, "SELECT id, date, finding_count FROM hu"),
    "stored_history": d.q(_HIST, "SELECT upper(id) AS id, date, input_name, source_file, finding_count, version, findings FROM hu"),
    "many_lookups": d.q(_HIST, "SELECT upper(id) AS id, date, input_name, source_file, finding_count, version, findings FROM hu WHERE id IN (SELECT concat('hist-', run_id) FROM run_events)"),
    "point_lookup": d.q(_HIST, "SELECT upper(id) AS id, date, input_name, source_file, finding_count, version, findings FROM hu WHERE id = 'hist-42'"),
    "parse_responses": d.q(_CASES, """SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'repaired' ELSE 'plain' END AS parse_stage, concat(conv_id, '-', turn) AS item_key, concat(role, ' impact') AS business_impact,
       CASE k WHEN 0 THEN 'patch it' WHEN 1 THEN 'patch' ELSE '' END AS primary, CASE k WHEN 1 THEN 'isolate' ELSE '' END AS secondary, CASE k WHEN 0 THEN 'vendor note' WHEN 1 THEN 'a' END AS ref_title, CASE WHEN k = 2 THEN 0 ELSE 1 END AS n_refs FROM ok
       UNION ALL SELECT conv_id, turn, 'failed', NULL, '', '', '', NULL, 0 FROM responses WHERE turn % 7 = 3"""),
    "explode_findings": d.q(_CASES, "SELECT conv_id, turn, 0 AS item_no, concat(role, ' issue') AS name, 'High' AS severity FROM ok UNION ALL SELECT conv_id, turn, 1, concat('turn ', turn), 'Low' FROM ok"),
    "quarantine": d.q(d.REPLIES, "SELECT conv_id, turn FROM responses WHERE turn % 7 = 3"),
}
