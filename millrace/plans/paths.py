"""Queries over path policies. Paths are dealt out of a list of keys by the parts' numbers, values are the parts' names."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import paths as P
from millrace.plans.base import query, quoted

KEYS = (
    "text Text1 TileEntities display Name Lore pages raw filtered extra with score clickEvent hoverEvent contents Entities CustomName "
    "minecraft:custom_name minecraft:lore id UUID Tags Lock author color Objectives DisplayName Teams Prefix MemberNameSuffix "
    "front_text messages title subtitle Command LastOutput components functions predicate custom_data item_name block_entities "
    "written_book_content dialog fallback bossbar name plugin Items tag filtered_pages font Motion owner block"
).split()
HINTS = [None, None, None, None, "author_name", "player_name", "unknown_identity", "command_feedback", "visual_glyph", "nbt_parse_error", "other"]
N, H = len(KEYS), len(HINTS)
LIST = ", ".join(map(quoted, KEYS))
HINT_CASE = "CASE p_partkey % " + str(H) + " " + " ".join(f"WHEN {i} THEN {quoted(h)}" for i, h in enumerate(HINTS) if h) + " END"
PLACE = f"(p_partkey * 31 + p_size * 7 + i * 13 * (p_partkey % 5 + 1)) % {N}"
INDEX = "i > 0 AND (p_partkey + i) % 6 = 5"


def dealt(spark, sf_dir: str):
    """p_partkey, path, hint, value and file of every part."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("millrace_parts")
    return spark.sql(f"""
      SELECT p_partkey, {HINT_CASE} AS hint,
        transform(sequence(0L, p_partkey % 4), i -> CASE WHEN {INDEX} THEN '[0]' ELSE element_at(array({LIST}), CAST({PLACE} + 1 AS INT)) END) AS path,
        CASE p_partkey % 7 WHEN 0 THEN upper(substring_index(p_name, ' ', 1)) WHEN 1 THEN concat('{{"text":"', p_name, '"}}') WHEN 2 THEN replace(p_name, ' ', '_')
          WHEN 3 THEN concat('"', initcap(substring_index(p_name, ' ', 1)), '"') WHEN 4 THEN concat('k_', p_size) ELSE p_name END AS value,
        CASE WHEN p_partkey % 9 = 0 THEN 'data/x/predicates/a.json' ELSE 'data/x/loot/a.json' END AS file
      FROM millrace_parts""")


BASE = f"""p AS (
  SELECT p_partkey, p_size, {HINT_CASE} AS hint, list_transform(range(0, p_partkey % 4 + 1), lambda i: CASE WHEN {INDEX} THEN '[0]' ELSE ([{LIST}])[{PLACE} + 1] END) AS path,
    CASE p_partkey % 7 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) WHEN 1 THEN '{{"text":"' || p_name || '"}}' WHEN 2 THEN replace(p_name, ' ', '_')
      WHEN 3 THEN '"' || upper(left(p_name, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || '"' WHEN 4 THEN 'k_' || p_size ELSE p_name END AS value,
    CASE WHEN p_partkey % 9 = 0 THEN 'data/x/predicates/a.json' ELSE 'data/x/loot/a.json' END AS file
  FROM part),
k AS (SELECT *, list_filter(path, lambda x: NOT regexp_matches(x, '^\\[[0-9]+\\]$')) AS keys FROM p),
l AS (SELECT *, list_transform(keys, lambda x: lower(x)) AS low, coalesce(keys[-1], '') AS exact, lower(coalesce(keys[-1], '')) AS leaf,
             lower(coalesce(keys[-2], '')) AS under, coalesce(path[-1], '') AS last FROM k)"""


def among(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def holds(*values: str) -> str:
    return "list_has_any(low, [" + ", ".join(map(quoted, values)) + "])"


def case(rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN {quoted(t)}" for w, t in rules) + f" ELSE {quoted(other)} END"


HINT_RULES = [(f"hint = '{h}'", f"{p}: {r}") for h, p, r in P.HINTS]
PAIRS = " OR ".join(f"(under = {quoted(a.lower())} AND leaf = {quoted(b.lower())})" for a, b in (*P.SHOWN_UNDER, *P.SHOWN_UNDER_IN_TREES))
COMMAND_PAIRS = " OR ".join(f"(coalesce(keys[-2], '') = {quoted(a)} AND exact = {quoted(b)})" for a, b in P.SHOWN_UNDER)


def told(c):
    return F.concat_ws(": ", c["policy"], c["reason"])


@query(f"""WITH {BASE} SELECT p_partkey, array_to_string(path, '/') AS path, {case([
    *HINT_RULES,
    ("exact IN ('Text1', 'Text2', 'Text3', 'Text4') AND " + holds("block_entities", "tileentities"), "TRANSLATABLE_DISPLAY: sign line"),
    ("leaf IN ('membernameprefix', 'membernamesuffix') AND " + holds("teams"), "TRANSLATABLE_DISPLAY: team name"),
    (PAIRS, "TRANSLATABLE_DISPLAY: display pair"),
    (f"exact IN {among(P.SHOWN_TAGS)} OR leaf IN {among(P.SHOWN)}", "TRANSLATABLE_DISPLAY: display key"),
    ("leaf IN ('id', 'uuid', 'dimension', 'function', 'storage', 'objective', 'team', 'bossbar', 'recipe', 'predicate')", "IMMUTABLE_ID: identity"),
    ("leaf IN ('tags', 'lock', 'author', 'custom_data', 'command', 'lastoutput', 'owner', 'target')", "IMMUTABLE_MATCH_VALUE: mechanism"),
    ("leaf IN ('customname', 'custom_name')", "UNKNOWN_REVIEW: name of unknown role"),
    (f"leaf IN {among(P.ATTRIBUTES)}", "IMMUTABLE_ID: attribute"),
    ("exact = 'Name' AND " + holds("display"), "TRANSLATABLE_DISPLAY: item name"),
    ("leaf = 'displayname' AND " + holds("objectives", "teams", "bossbars"), "TRANSLATABLE_DISPLAY: display name"),
    ("under IN ('pages', 'filtered_pages', 'lore', 'messages', 'extra', 'raw', 'filtered')", "TRANSLATABLE_DISPLAY: item of a display list"),
], "UNKNOWN_REVIEW: unaudited key")} AS decision FROM l""")
def tag_path_policy(spark, sf_dir):
    """The policy of every dealt path in a tag tree."""
    return dealt(spark, sf_dir).select("p_partkey", F.array_join("path", "/").alias("path"), told(P.tag_policy(F.col("path"), F.col("hint"))).alias("decision"))


@query(f"""WITH {BASE} SELECT p_partkey, array_to_string(path, '/') AS path, {case([
    *HINT_RULES,
    ("len(keys) = 0", "UNKNOWN_REVIEW: empty path"),
    (f"exact IN {among(P.SHOWN_TAGS)} OR leaf IN {among(P.SHOWN)} OR {COMMAND_PAIRS}", "TRANSLATABLE_DISPLAY: display key"),
    (f"leaf IN {among([*P.MECHANISM, *P.MATCHED])}", "IMMUTABLE_MATCH_VALUE: mechanism"),
    (f"leaf IN {among(P.IDENTITY)}", "IMMUTABLE_ID: identity"),
    (f"leaf IN {among(P.ATTRIBUTES)}", "IMMUTABLE_ID: attribute"),
], "UNKNOWN_REVIEW: unaudited key")} AS decision FROM l""")
def command_path_policy(spark, sf_dir):
    """The policy of every dealt path in a command's structure."""
    return dealt(spark, sf_dir).select("p_partkey", F.array_join("path", "/").alias("path"), told(P.command_policy(F.col("path"), F.col("hint"))).alias("decision"))


OUTER = "CASE WHEN p_partkey % 3 = 0 THEN '/pools/0/functions/' || p_size || '/components/' WHEN p_partkey % 3 = 1 THEN '/components/' ELSE '/' || coalesce(keys[1], '') || '/components/' END || CASE p_partkey % 5 WHEN 0 THEN 'minecraft:custom_name' WHEN 1 THEN 'lore' WHEN 2 THEN 'Name' ELSE exact END"
INNER = "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '/' || p_size % 3 || '/' || exact END"


@query(f"""WITH {BASE}, o AS (SELECT p_partkey, file, {OUTER} AS outer_pointer, {INNER} AS inner_pointer FROM l),
s AS (SELECT *, list_filter(string_split(outer_pointer, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')) AS ks,
        lower(coalesce(list_filter(string_split(inner_pointer, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))[-1], '')) AS inner_leaf FROM o),
t AS (SELECT *, list_transform(ks, lambda x: lower(x)) AS lows FROM s)
SELECT p_partkey, outer_pointer, inner_pointer, CASE
  WHEN NOT (coalesce(lows[-2], '') = 'components' AND (len(ks) = 2 OR coalesce(lows[-3], '') = 'functions')
       AND (regexp_extract(ks[-1], '[^:]*$') IN ('custom_name', 'item_name', 'lore') OR (ks[-1] IN ('Name', 'Lore') AND list_contains(list_slice(lows, 1, len(lows) - 1), 'display'))))
    THEN 'UNKNOWN_REVIEW: no item component'
  WHEN contains(file, '/predicate/') OR contains(file, '/predicates/') OR list_has_any(lows, ['predicate', 'predicates', 'condition', 'criteria', 'trigger', 'equipment'])
    THEN 'IMMUTABLE_MATCH_VALUE: item predicate'
  WHEN inner_pointer = '' THEN 'TRANSLATABLE_DISPLAY: whole component'
  WHEN inner_leaf IN ('text', 'fallback', 'extra', 'with') THEN 'TRANSLATABLE_DISPLAY: component leaf'
  ELSE 'UNKNOWN_REVIEW: unaudited leaf' END AS decision FROM t""")
def encoded_component(spark, sf_dir):
    """P9, and P13's producer and match contexts: leaves of components that are written as texts."""
    keys = P._keys(F.col("path"))
    d = dealt(spark, sf_dir).withColumn("keys", keys).join(spark.table("millrace_parts").select("p_partkey", "p_size"), "p_partkey")
    key = F.col("p_partkey")
    first, exact = F.coalesce(F.get("keys", F.lit(0)), F.lit("")), P._at(F.col("keys"), 1)
    outer = F.concat(
        F.when(key % 3 == 0, F.concat(F.lit("/pools/0/functions/"), F.col("p_size").cast("string"), F.lit("/components/"))).when(key % 3 == 1, "/components/").otherwise(F.concat(F.lit("/"), first, F.lit("/components/"))),
        F.when(key % 5 == 0, "minecraft:custom_name").when(key % 5 == 1, "lore").when(key % 5 == 2, "Name").otherwise(exact),
    )
    inner = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("p_size") % 3).cast("string"), F.lit("/"), exact))
    d = d.select("p_partkey", outer.alias("outer_pointer"), inner.alias("inner_pointer"), "file")
    return d.select("p_partkey", "outer_pointer", "inner_pointer", told(P.encoded_component_policy(F.col("outer_pointer"), F.col("inner_pointer"), F.col("file"))).alias("decision"))


@query(f"""WITH {BASE}, n AS (SELECT *, list_transform(keys, lambda x: lower(regexp_extract(x, '[^:]*$'))) AS bare FROM l)
SELECT p_partkey, array_to_string(keys, '/') AS path,
  len(keys) > 0 AND len(list_filter(range(1, len(keys)), lambda i: NOT CASE WHEN bare[i] IN ('hoverevent', 'hover_event') THEN low[i + 1] = 'contents'
      ELSE bare[i] IN {among(P.PAYLOAD_CONTAINERS)} END)) = 0 AND bare[-1] IN {among(P.PAYLOAD_LEAVES)} AS shown FROM n""")
def display_path_proof(spark, sf_dir):
    """Whether every key on the way proves that a leaf is shown."""
    d = dealt(spark, sf_dir).withColumn("keys", P._keys(F.col("path")))
    return d.select("p_partkey", F.array_join("keys", "/").alias("path"), P.display_path(F.col("keys")).alias("shown"))


SHAPE_ID = "(s <> '' AND NOT contains(s, ' ') AND (regexp_matches(s, '^[A-Za-z]+[_-][0-9]+[A-Za-z0-9_-]*$') OR regexp_matches(s, '^[A-Za-z0-9]+([_-][A-Za-z0-9]+){2,}$') OR (length(s) <= 24 AND regexp_matches(s, '^[A-Za-z0-9_-]+$') AND regexp_matches(s, '[_-]'))))"


@query(f"""WITH {BASE}, v AS (SELECT *, trim(value) AS s FROM l),
w AS (SELECT *, CASE WHEN starts_with(s, '{{') THEN trim(json_extract_string(CASE WHEN json_valid(s) THEN s END, '$.text')) WHEN starts_with(s, '"') THEN trim(s, '"') ELSE s END AS own FROM v)
SELECT p_partkey, value, s <> '' AND (contains(s, ' ') OR lower(s) <> s OR length(s) > 10) AS visible, {SHAPE_ID} AS internal,
  s <> '' AND NOT {SHAPE_ID} AND (contains(s, ' ') OR (regexp_matches(s, '[A-Za-z]') AND lower(s) <> s AND length(s) >= 3) OR (NOT (regexp_matches(s, '[A-Za-z]') AND lower(s) <> s) AND length(s) >= 8)) AS natural_name,
  CASE WHEN leaf = 'customname' AND list_contains(low, 'entities') AND regexp_matches(own, '^[A-Za-z0-9_]{{3,16}}$') THEN own END AS player FROM w""")
def name_shapes(spark, sf_dir):
    """Shapes of names, and names of entities that are named like players."""
    d = dealt(spark, sf_dir)
    # half of the paths end in an entity's name
    v = F.col("value")
    return d.select("p_partkey", "value", P.visible_label(v).alias("visible"), P.internal_id(v).alias("internal"), P.natural_label(v).alias("natural_name"), P.player_name(F.col("path"), v).alias("player"))


@query(f"""WITH {BASE}, c AS (SELECT *, CASE WHEN list_has_any(low, ['front_text', 'back_text']) THEN list_contains(low, 'messages') WHEN len(list_filter(low, lambda x: x = 'text')) >= 2 THEN true
    ELSE list_has_any(low, ['minecraft:custom_name', 'minecraft:item_name', 'minecraft:lore', 'minecraft:written_book_content', 'minecraft:writable_book_content', 'raw', 'extra', 'entities']) END AS component,
    p_partkey % 2 = 0 AS structure, regexp_matches(last, '^\\[[0-9]+\\]$') AS unnamed FROM l)
SELECT p_partkey, array_to_string(path, '/') AS path, CASE
  WHEN list_contains(low, 'lastoutput') THEN false
  WHEN unnamed THEN leaf IN ('pages', 'filtered_pages', 'lore', 'messages', 'extra', 'raw', 'filtered', 'minecraft:lore') OR list_contains(low, 'minecraft:lore')
  WHEN last IN ('Text1', 'Text2', 'Text3', 'Text4') THEN true
  WHEN leaf = 'displayname' AND list_has_any(low, ['objectives', 'teams', 'bossbars']) THEN contains(value, ' ') OR lower(value) <> value OR length(value) > 10 OR starts_with(value, '{{')
  WHEN leaf IN ('prefix', 'suffix') AND list_contains(low, 'teams') THEN true
  WHEN leaf IN ('minecraft:custom_name', 'minecraft:item_name', 'minecraft:lore') THEN true
  WHEN leaf IN ('raw', 'filtered') AND list_has_any(low, {list(P.BOOKS)}) THEN true
  WHEN leaf IN ('text', 'fallback') AND component THEN true
  WHEN structure AND leaf IN ('text', 'fallback', 'title', 'subtitle') THEN true
  WHEN leaf IN ('displayname', 'title', 'subtitle') THEN true
  WHEN last = 'Name' AND list_contains(low, 'display') THEN true
  WHEN leaf IN ('pages', 'filtered_pages', 'command') THEN false
  ELSE starts_with(value, '{{"text":"') END AS safe FROM c""")
def safe_tag_paths(spark, sf_dir):
    """Whether a text in a tag tree may be shown."""
    d = dealt(spark, sf_dir)
    return d.select("p_partkey", F.array_join("path", "/").alias("path"), P.safe_tag_path(F.col("path"), F.col("value"), F.col("p_partkey") % 2 == 0).alias("safe"))
