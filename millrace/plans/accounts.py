"""Queries over outcome accounts, counters, votes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import CJK
from millrace.operators import account as A
from millrace.operators import canonical as C
from millrace.plans.base import UNITS, query, read, units

OUTCOME = f"""CASE WHEN writeback = 'failed' THEN 'writeback_failed' WHEN rejected THEN 'candidate_rejected'
  WHEN writeback = 'blocked' THEN 'source_preserved'
  WHEN policy <> 'TRANSLATABLE_DISPLAY' AND (final_target IS NULL OR final_target = source_text) THEN 'mechanism_locked'
  WHEN final_target IS NULL AND keep THEN 'intentional_keep' WHEN final_target IS NULL THEN 'pending'
  WHEN final_target = source_text THEN 'source_preserved'
  WHEN writeback IN ('changed', 'unchanged') OR regexp_matches(final_target, '{CJK}') THEN 'written' ELSE 'pending' END"""


def outcomes(spark, d):
    c = F.col
    how = A.outcome(c("writeback"), c("rejected"), c("policy"), c("final_target"), c("source_text"), c("keep"))
    return units(spark, d).withColumn("outcome", how)


@query(f"WITH {UNITS} SELECT {OUTCOME} AS outcome, count(*) AS units FROM units GROUP BY 1")
def outcome_account(spark, d):
    return outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("units"))


@query(
    f"""WITH {UNITS}, o AS (SELECT format, {OUTCOME} AS outcome FROM units)
    SELECT format, count(*) FILTER (outcome IN ('pending', 'candidate_rejected', 'writeback_failed')) AS unfinished FROM o GROUP BY format"""
)
def unfinished_total(spark, d):
    return outcomes(spark, d).groupBy("format").agg(F.count_if(A.unfinished(F.col("outcome"))).alias("unfinished"))


@query(
    f"""WITH {UNITS} SELECT count(*) AS total, count(*) FILTER (final_target IS NULL) AS untouched,
      count(*) FILTER (final_target = source_text) AS same, count(*) FILTER (final_target <> source_text) AS changed,
      count(*) FILTER (final_target = '') AS emptied, count(*) FILTER (length(final_target) > length(source_text)) AS longer,
      count(*) FILTER (length(final_target) < length(source_text)) AS shorter FROM units"""
)
def before_after(spark, d):
    return units(spark, d).agg(*A.before_after(F.col("source_text"), F.col("final_target")))


@query(
    """SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1
      UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1) GROUP BY k"""
)
def counter_merge(spark, d):
    a = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    b = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    return A.counter_merge([a, b], "k", "n")


@query(
    """WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY user_id)
    SELECT s AS state, count(*) AS users FROM last GROUP BY s"""
)
def progress_fold(spark, d):
    last = A.latest_state(read(spark, d, "events"), "user_id", "event_id", "event_type")
    return last.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("users"))


@query(
    """SELECT count(DISTINCT user_id) FILTER (event_type = 'error') AS with_issue,
      greatest(count(*) FILTER (event_type = 'error'), count(*) FILTER (event_type IN ('signup', 'purchase'))) AS issues FROM events"""
)
def issue_counts(spark, d):
    t = F.col("event_type")
    return read(spark, d, "events").agg(
        F.count_distinct(F.when(t == "error", F.col("user_id"))).alias("with_issue"),
        F.greatest(F.count_if(t == "error"), F.count_if(t.isin("signup", "purchase"))).alias("issues"),
    )


@query(
    """SELECT count(*) AS calls, count(*) FILTER (event_type <> 'error') AS ok,
      CAST(floor(avg(value) FILTER (event_type <> 'error')) AS BIGINT) AS avg_ms FROM events"""
)
def latency_summary(spark, d):
    return A.latency(read(spark, d, "events"), F.col("event_type") != "error", "value")


@query(
    """SELECT event_type, round(sum(CASE WHEN event_type <> 'view' AND i + o > 0 THEN (i * 3.0 + o * 15.0) / 1e6 END), 6) AS cost FROM (
      SELECT event_type, user_id AS i, CAST(floor(value) AS BIGINT) AS o FROM events) GROUP BY event_type"""
)
def cost_total(spark, d):
    e = read(spark, d, "events")
    pin = F.when(F.col("event_type") != "view", F.lit(3.0))
    pout = F.when(F.col("event_type") != "view", F.lit(15.0))
    one = A.cost(F.col("user_id"), F.floor("value"), pin, pout)
    return e.groupBy("event_type").agg(F.round(F.sum(one), 6).alias("cost"))


@query(
    """SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id HAVING sum(length(text)) > 400"""
)
def container_capacity(spark, d):
    conv = read(spark, d, "conversations").withColumn("target", F.lit(None).cast("string"))
    return A.container_risk(conv, ["conv_id"], "text", "target")


@query(
    """SELECT o_orderpriority AS flag, count(*) AS calls, CAST(sum(n) AS BIGINT) AS units FROM orders
      JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"""
)
def call_plan(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    met = read(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy(F.col("o_orderpriority").alias("flag")).agg(F.count("*").alias("calls"), F.sum("n").alias("units"))


@query(
    """WITH s AS (SELECT l_partkey AS fn, l_linenumber AS arg,
        CASE WHEN l_returnflag = 'R' THEN 'mechanism' WHEN l_returnflag = 'A' THEN 'display' WHEN l_linestatus = 'F' THEN 'other' END AS kind FROM lineitem)
    SELECT fn, arg, CASE WHEN count(*) FILTER (kind = 'mechanism') > 0 THEN 'mechanism' WHEN count(kind) = 0 THEN 'unused'
      WHEN count(*) FILTER (kind <> 'display') = 0 THEN 'display' ELSE 'unknown' END AS verdict FROM s GROUP BY fn, arg"""
)
def parameter_verdict(spark, d):
    f = F.col("l_returnflag")
    kind = F.when(f == "R", "mechanism").when(f == "A", "display").when(F.col("l_linestatus") == "F", "other")
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("fn"), F.col("l_linenumber").alias("arg"), kind.alias("kind"))
    return A.verdict(rows, ["fn", "arg"])


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 7 + 3) % 500 AS dst FROM part),
    r(root, node, step) AS (SELECT DISTINCT s_suppkey, s_suppkey, 0 FROM supplier
      UNION SELECT r.root, e.dst, r.step + 1 FROM r JOIN e ON e.src = r.node WHERE r.step < 4)
    SELECT root, node, min(step) AS step FROM r GROUP BY root, node"""
)
def forward_resolution(spark, d):
    edges = read(spark, d, "part").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % 500).alias("dst")).distinct()
    return A.forward(edges, read(spark, d, "supplier").select(F.col("s_suppkey").alias("node")).distinct())


@query(
    """SELECT event_id, user_id, event_type, (SELECT count(*) FROM events WHERE props ILIKE '%k": 6%' AND event_type = 'click') AS total
    FROM events WHERE props ILIKE '%k": 6%' AND event_type = 'click' ORDER BY user_id, event_id LIMIT 50 OFFSET 20"""
)
def preview_search(spark, d):
    hit = read(spark, d, "events").where(F.col("props").ilike('%k": 6%') & (F.col("event_type") == "click"))
    return A.page(hit.select("event_id", "user_id", "event_type"), ["user_id", "event_id"], 20, 50)


@query(
    """SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND instr(lower(concat_ws(' ', c_name, c_mktsegment)), '00') > 0
    ORDER BY c_custkey LIMIT 200"""
)
def table_filter(spark, d):
    blob = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    hit = read(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.instr(blob, "00") > 0))
    return hit.orderBy("c_custkey").limit(200).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30")
def group_cap(spark, d):
    return read(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(30)


@query(
    """SELECT event_type, event_id, rank, total FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank,
      count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rank <= 25"""
)
def filter_details(spark, d):
    return A.capped_details(read(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 25)


@query(
    """SELECT DISTINCT l.doc_id, CASE WHEN NOT shareable THEN l.doc_id ELSE min(CASE WHEN shareable THEN l.doc_id END) OVER (PARTITION BY k) END AS leader
    FROM (SELECT doc_id, 'display:' || lang || ':' || text AS k, strpos(text, ' ') > 0 AS shareable FROM documents) l"""
)
def canonical_leader(spark, d):
    none = F.lit(None).cast("string")
    docs = read(spark, d, "documents").select("doc_id", "text", C.canonical_key(none, none, F.col("lang"), F.col("text")).alias("k"))
    return C.leaders(docs, "k", "doc_id", F.col("text").contains(" ")).select("doc_id", "leader")


@query(
    """WITH u AS (SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN p_brand END AS t FROM part),
    g AS (SELECT p_name, min(t) AS lo, max(t) AS hi FROM u WHERE t <> '' GROUP BY 1)
    SELECT p_partkey, coalesce(t, CASE WHEN lo = hi THEN lo END) AS shared, coalesce(lo <> hi, false) AS conflict FROM u LEFT JOIN g USING (p_name)"""
)
def share_targets(spark, d):
    u = read(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("t"))
    return C.share_targets(u, "p_name", "t").select("p_partkey", "shared", "conflict")


@query(
    """SELECT l_partkey, l_returnflag AS winner, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, first) AS r FROM (
      SELECT l_partkey, l_returnflag, count(*) AS votes, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)) WHERE r = 1"""
)
def majority_vote(spark, d):
    rows = read(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return C.majority(rows, "l_partkey", "l_returnflag", "seq")


@query(
    """WITH n AS (SELECT lower(p_name) AS norm, p_brand, count(*) AS n, list_sort(list(DISTINCT p_partkey))[1:3] AS samples FROM part GROUP BY 1, 2)
    SELECT norm, p_brand, n, array_to_string(samples, ',') AS samples, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, p_brand) AS rank, count(*) OVER (PARTITION BY norm) AS kinds FROM n)
    WHERE kinds > 1 AND rank <= 8"""
)
def conflict_topk(spark, d):
    out = C.conflicts(read(spark, d, "part"), "p_name", "p_brand", "p_partkey")
    return out.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(
    """WITH x AS (SELECT p_name, p_brand AS t, 0 AS l, p_partkey AS ord FROM part WHERE p_size < 20
      UNION ALL SELECT p_name, p_type, 1, p_partkey FROM part WHERE p_size >= 10),
    f AS (SELECT p_name, t, min(l * 1000000000 + ord) AS place FROM x GROUP BY 1, 2)
    SELECT p_name, CAST(min(place) // 1000000000 AS INTEGER) AS first, array_to_string(list(t ORDER BY place, t), ',') AS targets FROM f GROUP BY 1"""
)
def merge_conflicts(spark, d):
    p = read(spark, d, "part")
    a = p.where("p_size < 20").select("p_name", F.col("p_brand").alias("t"), F.col("p_partkey").alias("ord"))
    b = p.where("p_size >= 10").select("p_name", F.col("p_type").alias("t"), F.col("p_partkey").alias("ord"))
    return C.merge_conflicts([a, b], "p_name", "t").withColumn("targets", F.array_join("targets", ","))


@query(
    """SELECT name, any_value(total) AS n, array_to_string(list_sort(list(path)), ',') AS paths FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS k, count(*) OVER (PARTITION BY name) AS total FROM (
        SELECT source || '/' || 'T' || (doc_id % 97) AS path, 't' || (doc_id % 97) AS name FROM documents)) WHERE k <= 20 GROUP BY name HAVING any_value(total) >= 2"""
)
def duplicate_basename(spark, d):
    path = F.concat(F.col("source"), F.lit("/T"), (F.col("doc_id") % 97).cast("string"))
    out = C.duplicate_names(read(spark, d, "documents").select(path.alias("path")), "path")
    return out.withColumn("paths", F.array_join("paths", ","))
