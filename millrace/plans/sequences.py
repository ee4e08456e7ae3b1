"""Queries over ordered sequences, intervals, positions and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import packing as K
from millrace.operators import sequence as S
from millrace.plans.base import query, read


def minutes(spark, d):
    e = read(spark, d, "events").where("event_type <> 'view'")
    return e.select("user_id", "event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("h")).distinct()


HOURS = "SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events WHERE event_type <> 'view'"


@query(
    f"""WITH x AS ({HOURS}), i AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM x)
    SELECT user_id, min(h) AS lo, max(h) AS hi, count(*) AS n FROM i GROUP BY user_id, g HAVING count(*) >= 2"""
)
def passage_runs(spark, d):
    return S.runs(minutes(spark, d), ["user_id"], "h")


@query(
    """WITH x AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
    i AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND NOT (n < p) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM x)
    SELECT conv_id, CAST(g AS BIGINT) AS island, min(turn) AS lo, max(turn) AS hi, count(*) AS n FROM i GROUP BY conv_id, g"""
)
def soft_chains(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return S.chains(c, ["conv_id"], "turn", F.col("len") < F.col("prev_len"))


@query("SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS sibling FROM conversations")
def sibling_index(spark, d):
    return S.sibling_index(read(spark, d, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query(
    """SELECT conv_id, turn, sha256(string_agg(text, ' ' ORDER BY t2)) AS h FROM (
      SELECT a.conv_id, a.turn, b.turn AS t2, b.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND abs(a.turn - b.turn) <= 1) GROUP BY 1, 2"""
)
def page_context(spark, d):
    out = S.neighbours(read(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return out.select("conv_id", "turn", F.sha2("around", 256).alias("h"))


@query(
    """WITH p AS (SELECT conv_id, turn, coalesce(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS s FROM conversations)
    SELECT conv_id, turn, CAST(length(s) AS BIGINT) AS prefix_chars, right(s, 20) AS prefix_tail FROM p"""
)
def running_prefix(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return S.running_prefix(c, ["conv_id"], "turn", "text").select("conv_id", "turn", "prefix_chars", "prefix_tail")


@query(
    """SELECT conv_id, turn, coalesce(lag(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn), false) AS after_furniture,
      coalesce(turn < max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), false) AS before_last_click FROM conversations"""
)
def lag_flags(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return S.lag_flags(c, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "system").drop("role")


@query(
    """WITH c AS (SELECT user_id, event_id, sum(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events),
    x AS (SELECT user_id, event_id, total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM c)
    SELECT user_id, event_id, CAST(delta AS BIGINT) AS delta, CAST(unnest(range(1, CAST(least(delta, 10) AS BIGINT) + 1)) AS INTEGER) AS nth FROM x WHERE delta > 0"""
)
def counter_delta(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events")
    total = F.sum(F.floor(F.col("value") / 20)).over(Window.partitionBy("user_id").orderBy("event_id"))
    return S.counter_delta(e.select("user_id", "event_id", total.alias("total")), ["user_id"], "event_id", "total")


@query(
    """WITH x AS (SELECT l_partkey AS k, l_orderkey % 1000 AS s, l_orderkey % 1000 + l_linenumber AS e FROM lineitem),
    b AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM x),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM b)
    SELECT k, min(s) AS start, max(e) AS "end" FROM g GROUP BY k, i"""
)
def interval_merge(spark, d):
    s = F.col("l_orderkey") % 1000
    x = read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), s.alias("s"), (s + F.col("l_linenumber")).alias("e"))
    return S.merge_intervals(x, ["k"], "s", "e")


@query(
    """WITH x AS (SELECT conv_id, turn, sum(CASE WHEN role = 'system' OR length(text) < 80 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
    SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS leaves FROM x GROUP BY 1, 2"""
)
def conditional_runs(spark, d):
    c = read(spark, d, "conversations")
    cut = S.islands(c, ["conv_id"], "turn", (F.col("role") == "system") | (F.length("text") < 80))
    return cut.groupBy("conv_id", "island").agg(F.count("*").alias("leaves"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 400")
def recent_events(spark, d):
    return S.last_n(read(spark, d, "events").select("event_id", "event_type"), "event_id", 400)


@query(
    """SELECT p.event_id, o.o_orderkey FROM (SELECT event_id, user_id AS k, CAST(floor(value * 100) AS BIGINT) AS pos FROM events) p
    JOIN (SELECT o_orderkey, o_custkey AS k, o_orderkey % 9000 AS s, o_orderkey % 9000 + 400 AS e FROM orders) o ON o.k = p.k AND pos BETWEEN s AND e"""
)
def argument_at(spark, d):
    points = read(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.floor(F.col("value") * 100).alias("at"))
    s = F.col("o_orderkey") % 9000
    spans = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), s.alias("start"), (s + 400).alias("end"))
    return S.span_lookup(points, spans, ["k"]).select("event_id", "o_orderkey")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, n, CASE WHEN n >= 20 THEN value END AS p90 FROM r WHERE i = CAST(floor(n * 9 / 10) AS BIGINT)"""
)
def nearest_index_p90(spark, d):
    return S.nearest_p90(read(spark, d, "events"), ["event_type"], "value")


OFFSETS = [(-2, 0), (-1, 0), (1, 0), (2, 0), (0, -2), (0, -1), (0, 1), (0, 2)]


@query(
    f"""WITH p AS (SELECT s_suppkey AS node, s_nationkey AS f, s_suppkey % 16 AS x, CAST(floor(s_suppkey / 16) AS BIGINT) AS y FROM supplier),
    o(dx, dy) AS (VALUES {", ".join(map(str, OFFSETS))}),
    e AS (SELECT a.node AS a, b.node AS b FROM p a, o, p b WHERE b.f = a.f AND b.x = a.x + dx AND b.y = a.y + dy),
    c AS (SELECT *, count(*) OVER (PARTITION BY a) AS m, count(*) OVER (PARTITION BY b) AS n FROM e) SELECT a, b FROM c WHERE m = 1 AND n = 1"""
)
def neighbour_chain(spark, d):
    s = F.col("s_suppkey")
    p = read(spark, d, "supplier").select(s.alias("node"), F.col("s_nationkey").alias("f"), (s % 16).alias("x"), F.floor(s / 16).alias("y"))
    return S.neighbour_chains(p, ["f"], "x", "y", "node", OFFSETS)


@query(
    """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text) AS size FROM conversations),
    r(conv_id, i, turn, batch, n, total) AS (SELECT conv_id, i, turn, 0, 1, size FROM s WHERE i = 1
      UNION ALL SELECT s.conv_id, s.i, s.turn,
        CASE WHEN r.n + 1 > 4 OR r.total + s.size > 900 THEN r.batch + 1 ELSE r.batch END,
        CASE WHEN r.n + 1 > 4 OR r.total + s.size > 900 THEN 1 ELSE r.n + 1 END,
        CASE WHEN r.n + 1 > 4 OR r.total + s.size > 900 THEN s.size ELSE r.total + s.size END
      FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
    SELECT conv_id, turn, batch FROM r"""
)
def group_packing(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return K.pack(c, "conv_id", "turn", "size", 4, 900)


@query(
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN source || '#' || lang ELSE source END AS owner,
      CASE WHEN lang = 'en' THEN 'book' WHEN lang = 'fr' THEN 'sign' ELSE 'language' END AS container FROM documents"""
)
def semantic_owner(spark, d):
    lang = F.col("lang")
    owner = F.when(lang.isin("en", "fr"), F.concat_ws("#", "source", "lang")).otherwise(F.col("source"))
    kind = F.when(lang == "en", "book").when(lang == "fr", "sign").otherwise("language")
    return read(spark, d, "documents").select("doc_id", owner.alias("owner"), kind.alias("container"))


@query(
    """SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id % 10 * 10000 + doc_id % 7, doc_id) AS place FROM documents"""
)
def container_order(spark, d):
    from pyspark.sql import Window

    key = F.struct("lang", (F.col("doc_id") % 10 * 10000 + F.col("doc_id") % 7).alias("n"), "doc_id")
    return read(spark, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(key)).alias("place"))
