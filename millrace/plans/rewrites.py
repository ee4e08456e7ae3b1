"""Queries over rewriting, passages, arguments, commands' texts and the tables that units are judged by."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import names as NM
from millrace.operators import dimensions as D
from millrace.operators import rewrite as R
from millrace.plans.base import query, quoted, read
from millrace.plans.lines import COMMANDS, commands
from millrace.sources import documents as docs_

EDIT = "struct<start:int,end:int,text:string>"


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 6 = 0 OR length(text) < 30 THEN text WHEN doc_id % 6 = 1 THEN NULL
  ELSE substr(text, 1, 2) || '中文' || substr(text, 9, 6) || '' || substr(text, 21) || '!' END) AS line FROM documents""")
def spliced_lines(spark, sf_dir):
    """K4: edits by offset, put in from the last to the first; edits that overlap are refused."""
    t = F.col("text")
    edit = lambda a, b, x: F.struct(F.lit(a).alias("start"), (F.lit(b) if isinstance(b, int) else b).alias("end"), F.lit(x).alias("text"))
    end = F.struct(F.length(t).alias("start"), F.length(t).alias("end"), F.lit("!").alias("text"))
    edits = F.when((F.col("doc_id") % 6 == 0) | (F.length(t) < 30), F.array().cast(f"array<{EDIT}>")).when(F.col("doc_id") % 6 == 1, F.array(edit(3, 9, "x"), edit(8, 12, "y"))).otherwise(
        F.array(end, edit(14, 20, ""), edit(2, 8, "中文"))
    )
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.splice(t, edits)).alias("line"))


@query("""SELECT doc_id, md5(substr(text, 1, 2) || '|' || substr(text, 13, 7) || '|' || substr(text, 26)) AS rest FROM documents WHERE length(text) >= 30""")
def outside_spans(spark, sf_dir):
    """What a line holds outside its declared spans, which may touch and overlap."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    rows = read(spark, sf_dir, "documents").where(F.length("text") >= 30)
    rest = R.outside(F.col("text"), F.array(span(19, 25), span(2, 8), span(7, 10), span(10, 12)))
    return rows.select("doc_id", F.md5(F.array_join(rest, "|")).alias("rest"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS source, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
a AS (SELECT page_id, line, source, CASE WHEN (page_id + line) % 7 = 0 THEN NULL WHEN (page_id + line) % 7 = 1 THEN source || ' 好' WHEN (page_id + line) % 7 = 2 THEN source || ' %s' ELSE source END AS target FROM l)
SELECT page_id, line, CASE WHEN target IS NULL THEN 'missing' WHEN target = source THEN 'equal' WHEN (page_id + line) % 7 = 1 THEN 'kept' ELSE 'broken' END AS state FROM a""")
def changed_lines(spark, sf_dir):
    """Every line of the pages against its rewritten form."""
    lines = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    turn = (F.col("page_id") + F.col("line")) % 7
    after = lines.where(turn != 0).withColumn("text", F.when(turn == 1, F.concat("text", F.lit(" 好"))).when(turn == 2, F.concat("text", F.lit(" %s"))).otherwise(F.col("text")))
    return R.line_states(lines, after, ["page_id", "line"], "text")


@query("""WITH p AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS members FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey + CASE WHEN o_orderkey % 97 = 0 THEN 1000000000 ELSE 0 END AS k, o_orderkey AS o FROM orders)
SELECT k AS l_orderkey, CASE WHEN o % 97 = 0 OR members IS NULL THEN 'no such passage' WHEN o % 5 = 0 THEN 'blocked' WHEN o % 7 = 0 THEN 'source changed' WHEN o % 11 = 0 THEN 'no members'
  WHEN o % 13 = 0 THEN 'repeated member' WHEN o % 17 = 0 THEN 'member not writable' WHEN o % 19 = 0 AND len(members) > 1 THEN 'member missing' END AS reason
FROM r LEFT JOIN p ON p.l_orderkey = r.o""")
def passage_adoption(spark, sf_dir):
    """Revisions of passages, of which only those of the whole set of members are adopted."""
    passages = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("members"), F.lit("h").alias("source_hash"))
    o = F.col("o_orderkey")
    known = read(spark, sf_dir, "orders").join(passages.select(F.col("l_orderkey").alias("o_orderkey"), "members"), "o_orderkey", "left")
    m = F.coalesce("members", F.array(F.lit(1)))
    given = (
        F.when(o % 11 == 0, F.array().cast("array<int>"))
        .when(o % 13 == 0, F.concat(m, F.slice(m, 1, 1)))
        .when(o % 17 == 0, F.concat(m, F.array(F.lit(99))))
        .when((o % 19 == 0) & (F.size(m) > 1), F.slice(F.array_sort(m), F.lit(1), F.size(m) - 1))
        .otherwise(m)
    )
    revisions = known.select(
        (o + F.when(o % 97 == 0, 1_000_000_000).otherwise(0)).alias("l_orderkey"), given.alias("members"), F.when(o % 7 == 0, "g").otherwise("h").alias("source_hash"), (o % 5 == 0).alias("blocked")
    )
    return R.adoption(passages, revisions, "l_orderkey")


@query("""WITH c AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)
SELECT l_suppkey AS function, l_linenumber AS argument, CASE (l_suppkey + l_linenumber) % 5 WHEN 0 THEN 'display' WHEN 1 THEN 'mechanism' WHEN 2 THEN 'unused' ELSE 'unknown' END AS verdict,
  (l_suppkey + l_linenumber) % 5 <> 0 AND NOT ((l_suppkey + l_linenumber) % 5 > 1 AND l_suppkey % 3 = 0) AS locked FROM c""")
def argument_locks(spark, sf_dir):
    """Arguments of calls are locked by their verdict, unless a reviewed list clears them."""
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("function"), F.col("l_linenumber").alias("argument"))
    kind = (F.col("function") + F.col("argument")) % 5
    verdict = F.when(kind == 0, "display").when(kind == 1, "mechanism").when(kind == 2, "unused").when(kind == 3, "unknown")
    verdicts = calls.distinct().withColumn("verdict", verdict).where("verdict IS NOT NULL")
    return R.argument_locks(calls, verdicts, calls.distinct().where("function % 3 = 0"))


@query(f"""WITH {COMMANDS}
SELECT c_custkey, 0 AS depth, 'plain' AS kind, '' AS pointer, c_name || ' met "old ' || c_custkey || '" at ''dawn''' AS text FROM lines JOIN customer USING (c_custkey) WHERE c_custkey % 8 = 0
UNION ALL SELECT c_custkey, 1, 'text', '/text', c_name FROM customer WHERE c_custkey % 8 = 1
UNION ALL SELECT c_custkey, 1, 'plain', '', 'run ' || c_custkey FROM customer WHERE c_custkey % 8 = 7""")
def command_texts(spark, sf_dir):
    """What commands show, those behind ``run`` too."""
    return docs_.command_texts(commands(spark, sf_dir), "c_custkey", "line")


@query("""WITH c AS (SELECT c_custkey, unnest([['/text', 'text', c_name], ['/extra/0', 'text', 'more'], ['/extra/1/fallback', 'text', 'else'], ['/with/0/text', 'text', c_mktsegment],
  ['/hoverEvent/contents/text', 'text', 'tip'], ['/clickEvent/value', 'command', '/say hi']]) AS r FROM customer)
SELECT c_custkey, r[1] AS pointer, r[2] AS kind, r[3] AS text FROM c""")
def component_texts(spark, sf_dir):
    """The leaves of text components."""
    body = F.concat(
        F.lit('{"text":"'), "c_name", F.lit('","color":"red","score":{"name":"x"},"extra":["more",{"translate":"k","fallback":"else"}],"with":[{"text":"'), "c_mktsegment",
        F.lit('"}],"hoverEvent":{"action":"show_text","contents":{"text":"tip"}},"clickEvent":{"action":"run_command","value":"/say hi"}}'),
    )
    return docs_.components(read(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS object_key, l_shipdate::DATE::VARCHAR AS target FROM lineitem WHERE l_quantity > 10),
r AS (SELECT *, row_number() OVER (PARTITION BY object_key ORDER BY target) AS k FROM p)
SELECT object_key, count(*) AS n, string_agg(target, ',' ORDER BY target) FILTER (WHERE k <= 12) AS targets FROM r GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 80""")
def display_candidates(spark, sf_dir):
    """A10: objects that stand for several targets."""
    units = read(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_suppkey").alias("object_key"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("target"))
    return D.display_candidates(units, "object_key", "target").select("object_key", "n", F.array_join("targets", ",").alias("targets"))


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS t FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT o_custkey AS k, min(o_orderpriority) AS t FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.t AS source, b.t AS target, CASE WHEN b.k IS NULL THEN 'left only' WHEN a.k IS NULL THEN 'right only' END AS fault FROM a FULL JOIN b ON a.k = b.k""")
def official_pairs(spark, sf_dir):
    """Pairs of two languages' entries, and what stands on one side only."""
    left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name")).alias("t"))
    right = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("t"))
    return D.term_pairs(left, right, "k", "t")


@query("""WITH r AS (SELECT user_id, event_id, ts::DATE AS day, event_type FROM events), n AS (SELECT user_id, max(day) AS day FROM r GROUP BY 1)
SELECT r.user_id, r.event_id FROM r JOIN n USING (user_id, day) WHERE event_type IN ('click', 'view')""")
def reviewed_keeps(spark, sf_dir):
    """Decisions of each user's newest day only, even if that day has none."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type")
    return D.newest_decisions(rows, "user_id", ["day"], F.col("event_type").isin("click", "view")).select("user_id", "event_id")


@query("""WITH c AS (SELECT DISTINCT source AS font, unnest(string_split(text, '')) AS character FROM documents)
SELECT font, character FROM c WHERE character >= chr(160)""")
def font_characters(spark, sf_dir):
    """What fonts draw themselves."""
    return D.font_overrides(read(spark, sf_dir, "documents").withColumnRenamed("source", "font"), "font", "text")


PATHS = "'assets/' || source || '/LANG/' || lang || CASE doc_id % 4 WHEN 0 THEN '_US.json' WHEN 1 THEN '_us.lang' WHEN 2 THEN '_xx.txt' ELSE '.json' END"


@query(f"""WITH p AS (SELECT {PATHS} AS path FROM documents), l AS (SELECT regexp_extract(lower(path), '/lang/([a-z]+_[a-z]+)[.](json|lang)$', 1) AS locale FROM p)
SELECT locale, count(*) AS files FROM l WHERE locale <> '' GROUP BY 1""")
def locale_counts(spark, sf_dir):
    """Language files by locale."""
    return D.locale_counts(read(spark, sf_dir, "documents").select(F.expr(PATHS).alias("path")), "path")


@query("""WITH f AS (SELECT source FROM documents GROUP BY 1 HAVING count(*) FILTER (lang = 'de') = 0 OR source = 'src3')
SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM f)""")
def excluded_files(spark, sf_dir):
    """Units of files that are covered as a whole go."""
    d = read(spark, sf_dir, "documents")
    covered = d.groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("n")).where("n = 0 OR source = 'src3'")
    return D.without_files(d, covered, "source").select("doc_id")


@query("""SELECT o_orderkey AS k, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'official_term' END AS reason FROM orders LEFT JOIN customer ON o_orderkey = c_custkey""")
def official_conflicts(spark, sf_dir):
    """Q8: candidates that contradict an official entry of their own key."""
    official = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "other").otherwise("s").alias("source"), F.lit("甲").alias("target"))
    mine = F.when(F.col("o_orderkey") % 2 == 0, "乙").otherwise("甲")
    candidates = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("s").alias("source"), mine.alias("target"))
    return D.official_gate(candidates, official, "k").select("k", "reason")


TERMS = [("the", 5), ("and", 5), ("the and", 9), ("é", 1), ("is", 7)]


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '{term2} ' ELSE '' END || replace(lower(text), chr(10), ' ') AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '\\bthe and\\b')) AS first_term, contains(text, 'é') AS accent, true AS back FROM r""")
def masked_terms(spark, sf_dir):
    """a glossary's terms as marks, and back again."""
    text = F.concat(F.when(F.col("doc_id") % 10 == 0, "{term2} ").otherwise(""), F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")))
    rows = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    masked = rows.select("doc_id", "text", D.masked_terms(F.col("text"), TERMS).alias("m"))
    back = D.unmasked_terms(F.col("m"), [(t, p, t) for t, p in TERMS])
    first = F.when(F.col("doc_id") % 10 == 0, F.regexp_count("m.text", F.lit(r"\{term1001\}"))).otherwise(F.regexp_count("m.text", F.lit(r"\{term1\}")))
    accent = F.col("m.text").rlike(r"\{term(5|1005)\}")
    return masked.select("doc_id", first.cast("long").alias("first_term"), accent.alias("accent"), (back == F.col("text")).alias("back"))


_COUNTED = ", ".join(map(quoted, NM.COUNTED))


@query(f"""WITH r AS (SELECT doc_id, upper(lang) || 'x' AS one, upper(source) AS two, text || chr(10) || source || '_' || lang || doc_id AS text FROM documents),
p AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '[A-Za-z0-9_]+'), string_split_regex(text, '[A-Za-z0-9_]+')[:-2],
             string_split_regex(text, '[A-Za-z0-9_]+')[2:], range(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))))) AS z FROM r),
w AS (SELECT doc_id, z[1] AS word, z[2] AS before, z[3] AS after, z[4] AS k FROM p),
tags AS (SELECT doc_id, k, word FROM w WHERE length(word) >= 4 AND NOT regexp_matches(before, '[§.:/{{%$@#-]$')
  AND NOT regexp_matches(after, '^(\\}}|[\\\\"'']*\\s*[:=])') AND NOT regexp_full_match(word, '[0-9a-fk-or]([A-Z][a-z]+|[A-Z]+)')
  AND CASE WHEN contains(word, '_') THEN NOT contains('_' || word || '_', '__') AND regexp_matches(word, '[A-Z0-9]') AND regexp_matches(word, '[a-z]')
      ELSE regexp_matches(word, '[a-z][A-Z]') OR (regexp_full_match(word, '[A-Za-z]{{3,}}[0-9]{{1,4}}') AND regexp_matches(word, '[a-z]')
           AND rtrim(lower(word), '0123456789') NOT IN ({_COUNTED})) END),
n AS (SELECT doc_id, count(*) AS n, string_agg(word, ',' ORDER BY k) AS found FROM tags GROUP BY doc_id)
SELECT doc_id, 2 + coalesce(n, 0) AS n_names, concat_ws(',', one, two, found) AS names,
       'Map by {{term0}} & {{term1}}' AS credits, true AS back
FROM r LEFT JOIN n USING (doc_id)""")
def masked_names(spark, sf_dir):
    """names in whole texts with a credit line and a tag made of each document's own fields, masked and put back."""
    credit = F.concat(F.lit("Map by "), F.upper("lang"), F.lit("x & "), F.upper("source"), F.lit("\n"))
    tag = F.concat(F.lit("\n"), "source", F.lit("_"), "lang", "doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(credit, "text", tag).alias("text"))
    masked = rows.select("doc_id", "text", NM.masked_names(F.col("text")).alias("m"))
    return masked.select(
        "doc_id", F.size("m.names").cast("long").alias("n_names"), F.array_join("m.names", ",").alias("names"),
        F.substring_index("m.text", "\n", 1).alias("credits"), (NM.unmasked_names(F.col("m")) == F.col("text")).alias("back"),
    )
