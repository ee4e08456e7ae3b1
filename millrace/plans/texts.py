"""Queries over text predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import canonical as C_
from millrace.operators import policy as P_
from millrace.plans.base import UNITS, literals, query, quoted, read, units, values

P, SP = quoted(X.PLACEHOLDER), X.SPACE


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def n_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(pattern)}))"


def glyph_sql(c: str) -> str:
    pu, letters = n_sql(c, X.PRIVATE_USE), n_sql(c, r"\p{L}")
    return f"({pu} >= 3 AND ({pu} >= {letters} OR (contains({c}, chr(10)) AND {pu} * 2 >= {letters})))"


def translatable_sql(c: str) -> str:
    s = strip_sql(c)
    bare = f"regexp_replace(lower({s}), '[.!?,;:]+$', '')"
    free = strip_sql(f"regexp_replace({s}, {P}, '', 'g')")
    west, cjk = n_sql(free, r"[A-Za-z\x{400}-\x{4ff}]"), n_sql(s, X.CJK)
    return f"""(length({s}) >= 2 AND NOT {glyph_sql(s)}
      AND NOT regexp_matches({s}, '^(https?://|minecraft:|#)') AND NOT regexp_matches({s}, {quoted(X.SELECTOR)})
      AND NOT regexp_matches({s}, {quoted(X.DIGIT_TOKEN)})
      AND NOT (regexp_matches({bare}, '^[a-z0-9_.:/-]+$') AND regexp_matches({bare}, '[._:/-]'))
      AND {free} <> '' AND NOT ({cjk} > 0 AND {west} = 0) AND {cjk} <= greatest(12, {west} * 2)
      AND regexp_matches({free}, '\\p{{L}}'))"""


def risk_sql(text: str, context: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({context}), '{"|".join(X.RISK_MARKERS)}') THEN 'high'
      WHEN regexp_matches({text}, {P}) THEN 'medium' ELSE 'low' END"""


SHAPES = [
    ("minecraft:stone",), ("log1",), ("@e[tag=x]",), ("Beware.",), ("Hello %s",), ("%s",), ("a",), ("中文",), ("中文 ok then",),
    ("",), ("abcd",), ("  padded  ",), ("#tag",), ("path/to.file",), ("Привет мир",),
    ("12.5",), ("true",), (" None ",), ("1e5",), ("abc1 def",), ("ABC",), ("[KEY_NAME]",), ("rhythms",), ("strngth",), ("two words",),
    ("§aOK§r",), ("line\nbreak",), ("これは日本語です中",), ("中文译文",), ("The end!",), ("…",), ("-3",), ("5.",), (".5e-2",),
]
PAIRS = [
    ("Take 3 apples", "拿3个苹果"), ("Take 3 apples", "拿4个苹果"), ("Go 1.5 far", "走 1.5 远"), ("Do not press it", "按下它"),
    ("Do not press it", "不要按"), ("x", "@@1@@ x"), ("**a**", "**甲**"), ("a", "**甲**"), ("Never open", "打开门"), ("same", "same"),
    ("two\nlines", "两\n行"), ("one", "一\n二\n三\n四"), ("see http://a.b/c now", "看 http://a.b/c"), ("see http://a.b/c now", "看"),
    ("Use %s and %d", "用 %d 和 %s"), ("Use %s", "用"), ("§aHi", "§a嗨"), ("§aHi", "嗨"), ("run /say hi", "运行 /say hi"), ("short", "长" * 90),
    ("without you", "没有你"), ("an unused word", "一个unused的"), ("5 kg stone", "5kg石头"), ("/say word", "word说"),
]


@query(
    f"""WITH u AS (SELECT {translatable_sql("text")} AS ok, text, source, lang FROM documents)
    SELECT count(*) AS units, count(*) FILTER ({risk_sql("text", "source")} = 'high') AS high_risk,
           array_to_string(list_sort(list(DISTINCT source)), ',') AS files FROM u WHERE ok"""
)
def scan_summary(spark, d):
    docs = read(spark, d, "documents").where(X.translatable(F.col("text")))
    return docs.agg(
        F.count("*").alias("units"),
        F.count_if(X.risk(F.col("text"), F.col("source")) == "high").alias("high_risk"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("files"),
    )


@query(
    f"""SELECT 'documents' AS src, doc_id AS id FROM documents WHERE NOT {translatable_sql("text")}
    UNION ALL SELECT 'pages', page_id FROM pages WHERE {translatable_sql("url")}
    UNION ALL SELECT 'events', event_id FROM events WHERE {translatable_sql("props")}"""
)
def translatable_filter(spark, d):
    docs = read(spark, d, "documents").where(~X.translatable(F.col("text"))).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"))
    pages = read(spark, d, "pages").where(X.translatable(F.col("url"))).select(F.lit("pages"), "page_id")
    events = read(spark, d, "events").where(X.translatable(F.col("props"))).select(F.lit("events"), "event_id")
    return docs.union(pages).union(events)


@query(f"SELECT page_id, {risk_sql('html', 'url')} AS risk, {n_sql('html', X.PLACEHOLDER)} AS placeholders FROM pages")
def risk_class(spark, d):
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", X.risk(h, F.col("url")).alias("risk"), X.count(h, X.PLACEHOLDER).cast("long").alias("placeholders"))


#: Behind the literal rows, the texts of the tables: conversations, and their turns as candidates for the turn before.
TALK = "SELECT 1000 + conv_id * 1000 + turn AS id, text AS a FROM conversations"
TURNS = "SELECT 1000 + a.conv_id * 1000 + a.turn AS id, a.text AS a, CASE WHEN a.turn % 3 = 0 THEN '不 ' || a.text ELSE b.text END AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def talk(spark, d):
    return read(spark, d, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"))


def turns(spark, d):
    c = read(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    both = c.join(after, ["conv_id", "turn"])
    b = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("不 "), "text")).otherwise(F.col("next"))
    return both.select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), b.alias("b"))


@query(
    f"""SELECT id, {translatable_sql("a")} AS translatable, {glyph_sql("a")} AS art,
      lower({strip_sql("a")}) IN ('true', 'false', 'null', 'none') OR regexp_matches(lower({strip_sql("a")}), {quoted(X.NUMBER)}) AS locked,
      {n_sql("a", X.CJK)} > 0 AND {n_sql("a", X.KANA)} <= greatest(2, floor({n_sql("a", X.CJK)} / 3))
        AND ({n_sql("a", r"\p{L}")} = 0 OR {n_sql("a", X.CJK)} >= {n_sql("a", r"\p{L}")} * 0.1) AS chinese
    FROM {values(SHAPES, TALK)}"""
)
def text_shapes(spark, d):
    a = F.col("a")
    return literals(spark, SHAPES, talk(spark, d)).select(
        "id", X.translatable(a).alias("translatable"), X.glyph_art(a).alias("art"), X.literal_lock(a).alias("locked"), X.chinese_output(a).alias("chinese")
    )


EDGE = rf"(?:{X.SPACE}|{X.FORMAT_CODE})"
BODY = f"CASE WHEN regexp_full_match(a, '{EDGE}*') THEN a ELSE regexp_replace(regexp_replace(a, '^{EDGE}*', ''), '{EDGE}*$', '') END"


@query(
    f"""WITH x AS (SELECT id, a, {strip_sql("a")} AS s, {BODY} AS body FROM {values(SHAPES, TALK)}),
    y AS (SELECT id, a, body, {strip_sql(BODY.replace("a,", "s,").replace("THEN a", "THEN s"))} AS t FROM x)
    SELECT id, body, t <> '' AND NOT contains(a, chr(10)) AND NOT contains(t, ' ')
      AND (regexp_matches(t, '^[A-Za-z]{{1,8}}$') OR regexp_matches(t, '^(\\[[A-Z0-9_]+\\]|\\{{[A-Z0-9_]+\\}}|<[A-Z0-9_]+>)$')
           OR (regexp_matches(t, '^[A-Za-z]{{6,}}$') AND NOT regexp_matches(t, '[aeiouyAEIOUY]'))) AS keepable
    FROM y"""
)
def short_label_keep(spark, d):
    return literals(spark, SHAPES, talk(spark, d)).select("id", X.peel(F.col("a"))["body"].alias("body"), X.short_label(F.col("a")).alias("keepable"))


@query(
    f"""SELECT event_type || ':' || props AS a, count(*) AS n FROM events
    WHERE length(event_type || ':' || props) <= 24 AND len(regexp_split_to_array({strip_sql("event_type || ':' || props")}, '\\s+')) <= 3
    GROUP BY 1"""
)
def fragment_shape(spark, d):
    a = F.concat_ws(":", "event_type", "props")
    return read(spark, d, "events").select(a.alias("a")).where(X.fragment(F.col("a"))).groupBy("a").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT page_id, regexp_replace(html, {quoted(X.SECRET)}, '<redacted>', 'g') AS t FROM pages)
    SELECT page_id, sha256(CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END) AS h FROM r"""
)
def redact_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(X.redact(F.col("html")), 256).alias("h"))


NUM, JUMP = r"\d+(?:\.\d+)?", r"\b\d+\.\d+\b"


def same_sql(pattern: str, a: str = "a", b: str = "b") -> str:
    return f"list_sort(regexp_extract_all({a}, {quoted(pattern)})) = list_sort(regexp_extract_all({b}, {quoted(pattern)}))"


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN NOT ({same_sql(NUM)}) THEN 'clue_number' END,
      CASE WHEN NOT ({same_sql(JUMP)}) THEN 'clue_jump' END,
      CASE WHEN regexp_matches(lower(a), ' not |n''t|unless|without') AND NOT regexp_matches(b, '不|未|非|没有') THEN 'clue_negation' END],
      lambda x: x IS NOT NULL), ',') AS reasons FROM {values(PAIRS, TURNS)}"""
)
def clue_drift(spark, d):
    return literals(spark, PAIRS, turns(spark, d)).select("id", F.array_join(X.clue_drift(F.col("a"), F.col("b")), ",").alias("reasons"))


CONTENT = f"""CASE WHEN a = b THEN NULL
  WHEN {" OR ".join(f"{n_sql('b', p)} > {n_sql('a', p)}" for p in X.ARTIFACTS)} THEN 'model_scaffolding'
  WHEN regexp_matches(a, {quoted(X.FORBIDS)}) AND regexp_matches(b, '{X.CJK}') AND NOT regexp_matches(b, '{X.FORBIDS_TARGET}')
  THEN 'instruction_negation' END"""


@query(f"SELECT id, {CONTENT} AS reason FROM {values(PAIRS, TURNS)}")
def content_safety(spark, d):
    return literals(spark, PAIRS, turns(spark, d)).select("id", X.content_reason(F.col("a"), F.col("b")).alias("reason"))


CMD = r"(?i)(?:^|[^A-Za-z0-9_])(/[a-z][a-z0-9:_-]*)"


@query(
    f"""SELECT id, CASE WHEN NOT ({same_sql(X.URL)} AND {same_sql(X.PLACEHOLDER)} AND {same_sql(X.FORMAT_CODE)}
        AND list_sort(regexp_extract_all(a, {quoted(CMD)}, 1)) = list_sort(regexp_extract_all(b, {quoted(CMD)}, 1))) THEN 'structural_token'
      WHEN {CONTENT} IS NOT NULL THEN {CONTENT}
      WHEN len(regexp_extract_all(b, '\\n')) > len(regexp_extract_all(a, '\\n')) + 1 THEN 'unexpected_expansion'
      WHEN length({strip_sql("b")}) > greatest(80, length({strip_sql("a")}) * 4 + 16) THEN 'unexpected_expansion' END AS reason
    FROM {values(PAIRS, TURNS)}"""
)
def context_gate(spark, d):
    return literals(spark, PAIRS, turns(spark, d)).select("id", X.context_gate(F.col("a"), F.col("b")).alias("reason"))


@query(
    f"""SELECT p.page_id AS a, q.page_id AS b FROM pages p JOIN pages q ON q.page_id = p.page_id + 1
    WHERE list_sort(regexp_extract_all(p.html, {P})) = list_sort(regexp_extract_all(q.html, {P}))"""
)
def multiset_equal(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.array_sort(X.tokens(F.col("html"), X.PLACEHOLDER)).alias("t"))
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("b"), F.col("t").alias("u"))
    return pages.join(nxt, "page_id").where("t = u").select(F.col("page_id").alias("a"), "b")


@query("SELECT doc_id, sha1(concat(source, chr(0), lang, chr(0), CAST(doc_id AS VARCHAR), chr(0))) AS id FROM documents")
def stable_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", X.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query("""SELECT doc_id, sha256('["' || source || '","' || lang || '","' || doc_id || '"]') AS k FROM documents""")
def unit_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", X.unit_key(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("k"))


@query(
    """SELECT source, sha256(string_agg(rel || chr(0) || h || chr(10), '' ORDER BY rel)) AS fingerprint FROM (
      SELECT source, lang || '/' || doc_id AS rel, sha256(text) AS h FROM documents) GROUP BY source"""
)
def content_fingerprint(spark, d):
    docs = read(spark, d, "documents")
    rel = docs.select("source", F.concat_ws("/", "lang", "doc_id").alias("rel"), F.sha2("text", 256).alias("h"))
    return C_.content_fingerprint(rel, "source", "rel", "h")


@query(
    """SELECT seq, concat_ws('|', 'context-v9', file_path, format, coalesce(policy, ''), seq % 5) AS k FROM units""".replace(
        "FROM units", f"FROM (WITH {UNITS} SELECT * FROM units)"
    )
)
def context_key(spark, d):
    parts = [F.lit("context-v9"), F.col("file_path"), F.col("format"), F.coalesce("policy", F.lit("")), (F.col("seq") % 5).cast("string")]
    return units(spark, d).select("seq", F.concat_ws("|", *parts).alias("k"))


@query("""WITH w AS (SELECT doc_id, lower(text) AS t, regexp_extract(lower(text), '[a-z]{5,}') AS w FROM documents),
v AS (SELECT doc_id, t, CASE WHEN doc_id % 2 = 0 THEN w ELSE substr(w, 2, greatest(length(w) - 2, 0)) END AS v FROM w)
SELECT doc_id, CASE WHEN v <> '' AND NOT starts_with(ltrim(t), '/') AND v NOT IN ('kg', 'cm', 'mm', 'km', 'hp', 'xp', 'fps', 'id', 'ui', 'ms', 'mb', 'gb', 'kb', 'hz', 'px', 'pm', 'am')
  AND (regexp_matches(t, '(^|[^a-z])' || v) OR regexp_matches(t, v || '([^a-z]|$)')) THEN v ELSE '' END AS words FROM v""")
def source_residue(spark, d):
    t = F.col("text")
    w = F.regexp_extract(F.lower(t), "[a-z]{5,}", 0)
    v = F.when(F.col("doc_id") % 2 == 0, w).otherwise(F.substring(w, F.lit(2), F.greatest(F.length(w) - 2, F.lit(0))))
    return read(spark, d, "documents").select("doc_id", F.array_join(X.residue(t, F.concat(F.lit("见"), v, F.lit("了 qzzq好 5kg石"))), ",").alias("words"))


@query(
    """SELECT event_id, CASE WHEN ms < 1000 THEN CAST(CAST(floor(ms) AS BIGINT) AS VARCHAR) || ' ms'
      ELSE CAST(CAST(floor(floor(ms / 1000) / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(ms / 1000) AS BIGINT) % 60 AS VARCHAR) || 's' END AS shown
    FROM (SELECT event_id, value * 1000 AS ms FROM events)"""
)
def duration_labels(spark, d):
    return read(spark, d, "events").select("event_id", X.duration(F.col("value") * 1000).alias("shown"))


@query(
    """SELECT source, array_to_string(list(lang ORDER BY first), ',') AS langs FROM (
      SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY source"""
)
def ordered_distinct(spark, d):
    first = read(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "lang")))
    return first.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["lang"]), ",").alias("langs"))


POINTERS = [
    ("/title", "generic-json"), ("/icon/name", "generic-json"), ("/item/name", "generic-json"), ("/pages/0", "generic-json"),
    ("/description/3", "generic-json"), ("/a/score/text", "generic-json"), ("/x~1y:custom_data/text", "generic-json"), ("", "generic-json"),
    ("/name", "json-lang"), ("/name/0", "generic-json"), ("/entity/name/1", "generic-json"), ("/clickEvent/value", "generic-json"), ("/TEXT", "generic-json"),
]
_IN = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"


KEYED = "SELECT 1000 + l_orderkey * 10 + l_linenumber AS id, '/' || (['pages', 'name', 'item', 'score', 'text', 'title', 'x', 'custom_data'])[l_partkey % 8 + 1] || '/' || (['name', '0', 'text', 'lore', 'q', '12'])[l_suppkey % 6 + 1] AS a, CASE WHEN l_linenumber = 3 THEN 'json-lang' ELSE 'generic-json' END AS b FROM lineitem"


def keyed(spark, d):
    li = read(spark, d, "lineitem")
    first = F.element_at(F.array(*map(F.lit, ("pages", "name", "item", "score", "text", "title", "x", "custom_data"))), (F.col("l_partkey") % 8 + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, ("name", "0", "text", "lore", "q", "12"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    form = F.when(F.col("l_linenumber") == 3, "json-lang").otherwise("generic-json")
    return li.select((1000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("/"), first, F.lit("/"), last).alias("a"), form.alias("b"))


@query(
    f"""WITH k AS (SELECT id, b, list_transform(list_filter(string_split(a, '/'), lambda x: x <> ''), lambda x: lower(replace(replace(x, '~1', '/'), '~0', '~'))) AS w FROM {values(POINTERS, KEYED)}),
    p AS (SELECT id, b, w, len(w) AS n, coalesce(w[-1], '') AS l, CASE WHEN len(w) > 1 THEN w[-2] ELSE '' END AS u, CASE WHEN len(w) > 2 THEN w[-3] ELSE '' END AS g FROM k)
    SELECT id, CASE WHEN b IN {_IN(P_.LANGUAGE_FORMATS)} THEN 'TRANSLATABLE_DISPLAY' WHEN n = 0 THEN 'UNKNOWN_REVIEW'
      WHEN len(list_filter(w[1:n - 1], lambda x: x IN {_IN(P_.MECHANISM_OBJECTS)} OR x = 'custom_data' OR suffix(x, ':custom_data'))) > 0 THEN 'IMMUTABLE_MATCH_VALUE'
      WHEN l = 'name' AND u NOT IN {_IN(P_.NAMED_PARENTS)} THEN 'UNKNOWN_REVIEW' WHEN l IN {_IN(P_.TEXT_KEYS)} THEN 'TRANSLATABLE_DISPLAY'
      WHEN regexp_full_match(l, '[0-9]+') AND u = 'name' AND g NOT IN {_IN(P_.NAMED_PARENTS)} THEN 'UNKNOWN_REVIEW'
      WHEN regexp_full_match(l, '[0-9]+') AND u IN {_IN(P_.TEXT_KEYS)} THEN 'TRANSLATABLE_DISPLAY' ELSE 'UNKNOWN_REVIEW' END AS policy FROM p"""
)
def pointer_policy(spark, d):
    return literals(spark, POINTERS, keyed(spark, d)).select("id", P_.pointer_policy(F.col("a"), F.col("b"))["policy"].alias("policy"))


@query(
    f"""WITH {UNITS} SELECT seq, CASE WHEN rejected AND policy <> 'IMMUTABLE_ID' THEN 'UNKNOWN_REVIEW' WHEN policy = 'IMMUTABLE_ID' THEN policy
      WHEN keep THEN 'IMMUTABLE_MATCH_VALUE' ELSE policy END AS policy FROM units"""
)
def unit_policy(spark, d):
    c = F.col
    u = units(spark, d).withColumn("shown", F.when(c("keep"), F.lit(" 12.5 ")).otherwise(c("source_text")))
    none = F.struct(F.lit(P_.REVIEW).alias("policy"), F.lit("").alias("reason"))
    return u.select("seq", P_.unit_policy(c("format"), c("shown"), c("policy"), c("rejected"), none)["policy"].alias("policy"))
