"""Messages that can be clicked: what a changed one must still do, leaf by leaf, as it is drawn."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.skeleton import bones
from millrace.functions.slices import row_function
from millrace.functions.text import SPACE, strip

# Keys of clicks, actions that run their value, keys of what is drawn from a running game, and the marks that
# rows of controls begin with.
CLICKS = ("clickEvent", "click_event")
RUNS = ("run_command", "run_command_if_loaded", "suggest_command")
LIVE = ("score", "selector", "nbt", "keybind")
CONTROLS = "►▶▷▸▹➤»→⌲>"

#: Bytes of JSON that become Python objects together; leaves take many times their bytes.
RAW_BYTES = 500_000

LEAF = pa.struct([("text", pa.string()), ("clicks", pa.list_(pa.string())), ("at", pa.string())])
LEAVES = "array<struct<text:string,clicks:array<string>,at:string>>"


def click(event: object) -> str:
    """A click by what it does: its action, the command that it runs, and all else but the texts it shows."""
    if not isinstance(event, dict):
        return json.dumps(event, ensure_ascii=False)
    ran = event.get("value") if event.get("action") in RUNS else None
    return json.dumps([event.get("action"), ran, bones(event)], ensure_ascii=False, sort_keys=True)


def leaves(node: object) -> list[tuple[str | None, list[str], str]]:
    """(text, clicks, pointer) of all that a component draws, in order. A click holds for everything below it and counts with
    the place that declares it. Text is null where it comes from a running game; what has a text list or a fallback draws that."""
    out: list[tuple[str | None, list[str], str]] = []
    stack: list[tuple[object, str, list[str], bool]] = [(node, "", [], False)]
    while stack:
        value, at, clicks, live = stack.pop()
        if live:
            out.append((None, clicks, at))
        elif isinstance(value, str):
            out.append((value, clicks, at))
        elif isinstance(value, list):
            stack += [(x, f"{at}/{k}", clicks, False) for k, x in reversed(list(enumerate(value)))]
        elif isinstance(value, dict):
            key = next((k for k in CLICKS if k in value), None)
            held = clicks if key is None else [*clicks, f"{at} {click(value[key])}"]
            own = value.get("text")
            if not isinstance(own, str | list):
                own = value.get("fallback")
            below = [(own, at if isinstance(own, str) else f"{at}/text", held, False)] if isinstance(own, str | list) else []
            below += [(value[k], f"{at}/{k}", held, False) for k in ("with", "extra") if k in value]
            if not isinstance(own, str) and any(k in value for k in LIVE):
                below.append((None, at, held, True))
            stack += reversed(below)
    return out


def drawn(raw: str | None) -> list | None:
    """The drawn leaves of a JSON component as rows of LEAF; null where it does not parse."""
    try:
        return [{"text": None if t is None else t.encode("utf-8", "replace").decode(), "clicks": c, "at": p} for t, c, p in leaves(json.loads(raw or ""))]
    except (ValueError, RecursionError):
        return None


def rendered(payload: Column) -> Column:
    """The drawn leaves of a JSON component; null where it does not parse."""
    return row_function(LEAVES, pa.list_(LEAF), drawn, RAW_BYTES)(payload)


def rendered_both(source: Column, target: Column) -> Column:
    """``rendered`` of two components as the fields a and b: one Python worker for both, not one for each."""
    sides = pa.struct([("a", pa.list_(LEAF)), ("b", pa.list_(LEAF))])
    return row_function(f"struct<a:{LEAVES},b:{LEAVES}>", sides, lambda s, t: {"a": drawn(s), "b": drawn(t)}, RAW_BYTES)(source, target)


def offset(text: Column) -> Column:
    """How many line breaks a text has, and which of its lines are empty."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, k: F.struct(k.alias("k"), (x == "").alias("blank")))
    return F.struct(F.size(lines).alias("n"), F.transform(F.filter(lines, lambda x: x["blank"]), lambda x: x["k"]).alias("blank"))


def dividers(drawn: Column) -> Column:
    """Rows of four ``=`` or more in what is drawn, sorted."""
    text = F.array_join(F.transform(drawn, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return F.sort_array(F.filter(F.split(text, "\n", -1), lambda x: strip(x).rlike("^={4,}$")))


def changes(rows: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, n and problem: everything by which the target no longer is the source's interaction. No row: it still is.

    ``key`` names a row and is not null. n is the leaf, or null where the whole message is meant: ``unreadable`` (a source with
    clicks, and a target or source that does not parse), ``added_click`` (to a source without any), ``leaf_count`` or
    ``divider``. Of a leaf: ``drawn_from`` (file or game), ``click`` (another, moved, lost or merged), ``marks_changed``
    (marks and padding alone must stay), and of one that can be clicked ``line_offset`` (breaks or empty lines before it),
    ``fill`` (the padding before it in its row), ``emptied``, ``padding`` (behind it) and ``controls`` (the marks before it).
    Sources without clicks may change freely but for clicks and dividers.

    Leaves of one message are one window; a message is what one line shows.
    """
    held = rows.select(F.col(key).alias("key"), F.col(source).alias("s_"), F.col(target).alias("t_"))
    held = held.withColumn("d_", rendered_both(F.col("s_"), F.col("t_"))).select("*", "d_.a", "d_.b").drop("d_")
    clicked = lambda c: F.exists(c, lambda x: F.size(x["clicks"]) > 0)
    mentions = F.col("s_").rlike("clickEvent|click_event")
    whole = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.when(mentions, "unreadable"))
        .when(~clicked(F.col("a")), F.when(clicked(F.col("b")), "added_click"))
        .when(F.size("a") != F.size("b"), "leaf_count")
    )
    held = held.withColumn("whole", whole).withColumn("open", F.col("whole").isNull() & F.coalesce(clicked(F.col("a")), F.lit(False)))
    moved = F.col("a").isNotNull() & F.col("b").isNotNull() & (dividers(F.col("a")) != dividers(F.col("b")))
    found = F.array_compact(F.array("whole", F.when(moved, "divider")))
    of_whole = held.select("key", F.lit(None).cast("int").alias("n"), F.explode(found).alias("problem"))
    pairs = held.where("open").select("key", F.posexplode(F.arrays_zip("a", "b")).alias("n", "p"))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda side: F.array_join(F.collect_list(F.coalesce(F.col(f"p.{side}.text"), F.lit(""))).over(before), "")
    led = pairs.withColumn("x", so_far("a")).withColumn("y", so_far("b"))
    s, t = F.col("p.a.text"), F.col("p.b.text")
    lead = lambda c: F.regexp_extract(c, f"^{SPACE}*", 0)
    led = led.withColumn("x", F.concat("x", lead(s))).withColumn("y", F.concat("y", lead(t)))
    row = lambda c: F.regexp_extract(c, r"[^\n]*\z", 0)
    pad = lambda c: F.regexp_extract(c, r"[ \t]*\z", 0)
    marks = lambda c: F.regexp_extract(c, f"^{SPACE}*([{CONTROLS}]+[ \\t]*)", 1)
    both, alone = s.isNotNull() & t.isNotNull(), s.rlike(f"^(?:[{CONTROLS}]|{SPACE})*\\z")
    can = both & ~alone & (F.size("p.a.clicks") > 0)
    problems = F.array(
        F.when(s.isNull() != t.isNull(), "drawn_from"),
        F.when(F.col("p.a.clicks") != F.col("p.b.clicks"), "click"),
        F.when(both & alone & (s != t), "marks_changed"),
        F.when(can & (offset(F.col("x")) != offset(F.col("y"))), "line_offset"),
        F.when(can & (strip(row(F.col("x"))) == "") & (row(F.col("x")) != row(F.col("y"))), "fill"),
        F.when(can & (strip(s) != "") & (strip(t) == ""), "emptied"),
        F.when(can & (pad(s) != pad(t)), "padding"),
        F.when(can & (marks(s) != "") & (marks(s) != marks(t)), "controls"),
    )
    of_leaf = led.select("key", "n", F.explode(F.array_compact(problems)).alias("problem"))
    return of_whole.unionByName(of_leaf).withColumnRenamed("key", key)


def interaction_gate(rows: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """The rows with ``interaction``: null where the change may be written, else ``unverifiable`` or ``layout``."""
    bad = changes(rows, key, source, target).groupBy(F.col(key).alias("key_")).agg(F.bool_or(F.col("problem") == "unreadable").alias("unread_"))
    held = rows.join(bad, F.col(key) == F.col("key_"), "left")
    return held.withColumn("interaction", F.when(F.col("unread_"), "unverifiable").when(F.col("key_").isNotNull(), "layout")).drop("key_", "unread_")
