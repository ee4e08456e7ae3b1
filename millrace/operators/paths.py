"""Policies over key paths: what a text is, from the keys on the way to it.

A path is an array of keys from the document's root; a place in a list is written ``[n]``. A null path counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip, translatable
from millrace.operators.policy import DISPLAY, ID, MATCH, REVIEW, Rule, decide

# Keys of the formats, by their role.
IDENTITY = (
    "id uuid dimension function functions storage objective objectives team teams bossbar recipe recipes predicate predicates "
    "loot_table advancement advancements tag tags namespace type entity block item target owner scheduler command pos rotation "
    "motion level"
).split()
MATCHED = "author lock customname custom_name item_name custom_data lastoutput name".split()
SHOWN = (
    "text dialog fallback title subtitle lore pages filtered_pages raw filtered minecraft:custom_name minecraft:item_name "
    "minecraft:lore prefix suffix"
).split()
SHOWN_TAGS = "text dialog pages filtered_pages minecraft:lore minecraft:custom_name minecraft:item_name title".split()
SHOWN_UNDER = (
    ("front_text", "messages"), ("back_text", "messages"), ("display", "Name"), ("display", "Lore"), ("pages", "raw"),
    ("pages", "filtered"), ("filtered_pages", "raw"), ("filtered_pages", "filtered"), ("title", "raw"), ("title", "filtered"),
)
SHOWN_UNDER_IN_TREES = (
    ("written_book_content", "title"), ("writable_book_content", "title"), ("minecraft:written_book_content", "title"),
    ("minecraft:writable_book_content", "title"), ("teams", "DisplayName"), ("teams", "Prefix"), ("teams", "Suffix"),
    ("objectives", "DisplayName"), ("bossbar", "name"),
)
MECHANISM = (
    "tags lock author id custom_data customname custom_name item_name uuid pos rotation motion dimension level scheduler command "
    "lastoutput owner target passengers inventory enderitems selecteditem handitems armoritems"
).split()
PLAIN_IDENTITY = "id uuid dimension function storage objective team bossbar recipe predicate".split()
PLAIN_MATCHED = "tags lock author custom_data command lastoutput owner target".split()
ATTRIBUTES = (
    "color bold italic underlined strikethrough obfuscated font insertion shadow background type action url value page translate "
    "score name objective selector nbt path interpret separator entity storage block"
).split()
BOOKS = "pages filtered_pages title minecraft:written_book_content minecraft:writable_book_content written_book_content writable_book_content".split()
LIST_OWNERS = "pages filtered_pages lore messages extra raw filtered".split()
PAYLOAD_LEAVES = "text fallback extra with contents title subtitle raw filtered lore pages filtered_pages messages texts dialog prefix suffix".split()
PAYLOAD_CONTAINERS = (
    "extra with contents pages filtered_pages lore messages raw filtered title subtitle texts dialog written_book_content "
    "writable_book_content display front_text back_text"
).split()
MATCH_ANCESTORS = "predicate predicates condition criteria trigger equipment".split()
#: What the reader of a tag has already said of it: hint, policy, reason.
HINTS = (
    ("author_name", MATCH, "author"), ("player_name", MATCH, "player name"), ("entity_name_preserved", MATCH, "entity name"),
    ("unknown_identity", REVIEW, "entity name"), ("command_feedback", MATCH, "command feedback"), ("mechanism_locked", MATCH, "mechanism"),
    ("reference_locked", MATCH, "reference"), ("unknown_mechanism_field", REVIEW, "mechanism"), ("unparsed_mechanism", REVIEW, "unparsed"),
    ("visual_glyph", ID, "glyph art"), ("nbt_parse_error", REVIEW, "unparsed"),
)
PLACE = r"^\[\d+\]$"


def _keys(path: Column) -> Column:
    return F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: ~x.rlike(PLACE))


def _at(keys: Column, back: int) -> Column:
    """The key so many from the end (1 is the last), '' where there is none."""
    return F.coalesce(F.get(keys, F.size(keys) - back), F.lit(""))


def _any(keys: Column, *values: str) -> Column:
    return F.arrays_overlap(keys, F.array(*map(F.lit, values)))


def _pairs(parent: Column, leaf: Column, pairs) -> Column:
    return F.concat(parent, F.lit("\n"), leaf).isin(*(f"{a}\n{b}" for a, b in pairs))


def tag_policy(path: Column, hint: Column | None = None) -> Column:
    """struct<policy, reason> of a text in a tag tree: what its reader says of it, then the ladder of its keys."""
    keys = _keys(path)
    low = F.transform(keys, F.lower)
    leaf, under = _at(low, 1), _at(low, 2)
    exact = _at(keys, 1)
    lower_pairs = [(a.lower(), b.lower()) for a, b in (*SHOWN_UNDER, *SHOWN_UNDER_IN_TREES)]
    said = [Rule(hint == h, p, r) for h, p, r in HINTS] if hint is not None else []
    rules = [
        *said,
        Rule(F.size(F.coalesce(path, F.array().cast("array<string>"))) == 0, REVIEW, "empty path"),
        Rule(exact.isin("Text1", "Text2", "Text3", "Text4") & _any(low, "block_entities", "tileentities"), DISPLAY, "sign line"),
        Rule(leaf.isin("membernameprefix", "membernamesuffix") & _any(low, "teams"), DISPLAY, "team name"),
        Rule(_pairs(under, leaf, lower_pairs), DISPLAY, "display pair"),
        Rule(exact.isin(*SHOWN_TAGS) | leaf.isin(*SHOWN), DISPLAY, "display key"),
        Rule(leaf.isin(*PLAIN_IDENTITY), ID, "identity"),
        Rule(leaf.isin(*PLAIN_MATCHED), MATCH, "mechanism"),
        Rule(leaf.isin("customname", "custom_name"), REVIEW, "name of unknown role"),
        Rule(leaf.isin(*ATTRIBUTES), ID, "attribute"),
        Rule((exact == "Name") & _any(low, "display"), DISPLAY, "item name"),
        Rule((leaf == "displayname") & _any(low, "objectives", "teams", "bossbars"), DISPLAY, "display name"),
        Rule(under.isin(*LIST_OWNERS), DISPLAY, "item of a display list"),
    ]
    return decide(rules, REVIEW, "unaudited key")


def command_policy(path: Column, hint: Column | None = None) -> Column:
    """struct<policy, reason> of a value in a command's structure."""
    keys = _keys(path)
    exact, leaf = _at(keys, 1), F.lower(_at(keys, 1))
    said = [Rule(hint == h, p, r) for h, p, r in HINTS] if hint is not None else []
    rules = [
        *said,
        Rule(F.size(keys) == 0, REVIEW, "empty path"),
        Rule(exact.isin(*SHOWN_TAGS) | leaf.isin(*SHOWN) | _pairs(_at(keys, 2), exact, SHOWN_UNDER), DISPLAY, "display key"),
        Rule(leaf.isin(*MECHANISM, *MATCHED), MATCH, "mechanism"),
        Rule(leaf.isin(*IDENTITY), ID, "identity"),
        Rule(leaf.isin(*ATTRIBUTES), ID, "attribute"),
    ]
    return decide(rules, REVIEW, "unaudited key")


def bare(key: Column) -> Column:
    """A key without its namespace."""
    return F.substring_index(key, ":", -1)


def component_key(keys: Column) -> Column:
    """Whether the last key holds an item's own display text; the capitalised ones do below ``display`` only."""
    leaf = _at(keys, 1)
    above = F.transform(F.slice(keys, F.lit(1), F.greatest(F.size(keys) - 1, F.lit(0))), F.lower)
    return bare(leaf).isin("custom_name", "item_name", "lore") | (leaf.isin("Name", "Lore") & _any(above, "display"))


def component_list(keys: Column) -> Column:
    """Whether the last key but one is the component list of a loot function, or of a file's root."""
    low = F.transform(keys, F.lower)
    return (_at(low, 2) == "components") & ((F.size(keys) == 2) | (_at(low, 3) == "functions"))


def match_context(keys: Column, file: Column) -> Column:
    """Whether an item's data is there to be compared, not shown."""
    path = F.lower(F.translate(F.coalesce(file, F.lit("")), "\\", "/"))
    return path.contains("/predicate/") | path.contains("/predicates/") | _any(F.transform(keys, F.lower), *MATCH_ANCESTORS)


def produces_items(command: Column) -> Column:
    """Whether a command writes an item's own components."""
    return F.ltrim(F.regexp_replace(F.trim(command), "^/+", "")).rlike(r"(?i)^(give|item\s+(replace|modify))\b")


def pointer_keys(pointer: Column) -> Column:
    """Keys of a JSON pointer, unescaped, without places in lists."""
    parts = F.filter(F.split(pointer, "/"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    return F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def encoded_component_policy(outer: Column, inner: Column, file: Column) -> Column:
    """struct<policy, reason> of a leaf (pointer ``inner``) of a component that is written as a text at pointer ``outer``."""
    keys, own = pointer_keys(outer), pointer_keys(inner)
    leaf = F.lower(_at(own, 1))
    rules = [
        Rule(~(component_list(keys) & component_key(keys)), REVIEW, "no item component"),
        Rule(match_context(keys, file), MATCH, "item predicate"),
        Rule(inner == "", DISPLAY, "whole component"),
        Rule(leaf.isin("text", "fallback", "extra", "with"), DISPLAY, "component leaf"),
    ]
    return decide(rules, REVIEW, "unaudited leaf")


def display_path(keys: Column) -> Column:
    """Proof that a payload's leaf is shown: a display key, below display containers only; a hover below its contents only."""
    above = F.slice(keys, F.lit(1), F.greatest(F.size(keys) - 1, F.lit(0)))
    hover = lambda x: F.lower(bare(x)).isin("hoverevent", "hover_event")
    through = F.forall(
        F.transform(above, lambda x, i: F.when(hover(x), F.lower(F.get(keys, i + 1)) == "contents").otherwise(F.lower(bare(x)).isin(*PAYLOAD_CONTAINERS))),
        lambda ok: ok,
    )
    return (F.size(keys) > 0) & through & F.lower(bare(_at(keys, 1))).isin(*PAYLOAD_LEAVES)


def visible_label(value: Column) -> Column:
    s = strip(value)
    return (s != "") & (s.contains(" ") | (F.lower(s) != s) | (F.length(s) > 10))


def internal_id(value: Column) -> Column:
    s = strip(value)
    shapes = (r"^[A-Za-z]+[_\-]\d+[A-Za-z0-9_\-]*$", r"^[A-Za-z0-9]+([_\-][A-Za-z0-9]+){2,}$", r"^[A-Za-z0-9_\-]{0,23}[_\-][A-Za-z0-9_\-]*$")
    short = s.rlike(shapes[2]) & (F.length(s) <= 24)
    return (s != "") & ~s.contains(" ") & (s.rlike(shapes[0]) | s.rlike(shapes[1]) | short)


def natural_label(value: Column) -> Column:
    """A name that reads like language: several words, or a capital in a word of three letters or more."""
    s = strip(value)
    cased = s.rlike("[A-Za-z]") & (F.lower(s) != s)
    return (s != "") & ~internal_id(value) & (s.contains(" ") | (cased & (F.length(s) >= 3)) | (~cased & translatable(s) & (F.length(s) >= 8)))


def player_name(path: Column, value: Column) -> Column:
    """The name of an entity that is named like a player, else null. Names in a component are read from its text."""
    keys = F.transform(_keys(path), F.lower)
    s = F.trim(value)
    own = F.when(s.startswith("{"), F.trim(F.get_json_object(s, "$.text"))).when(s.startswith('"'), F.trim(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0])).when(
        ~s.startswith("["), s
    )
    here = (_at(keys, 1) == "customname") & _any(keys, "entities")
    return F.when(here & own.rlike(r"^[A-Za-z0-9_]{3,16}$"), own)


def safe_tag_path(path: Column, value: Column, structure: Column) -> Column:
    """Whether a text in a tag tree may be shown: audited keys; an unnamed leaf takes the nearest named key above it.
    ``structure``: whether the tree is a structure file of its own."""
    p = F.coalesce(path, F.array().cast("array<string>"))
    low = F.transform(_keys(p), F.lower)
    last = _at(p, 1)
    unnamed = (F.size(p) == 0) | last.rlike(PLACE) | (last == "")
    named = F.filter(low, lambda x: x != "")
    leaf = F.lower(last)
    many = lambda *values: _any(low, *values)
    component = (
        F.when(many("front_text", "back_text"), many("messages"))
        .when(F.size(F.filter(low, lambda x: x == "text")) >= 2, True)
        .otherwise(
            many("minecraft:custom_name", "minecraft:item_name", "minecraft:lore", "minecraft:written_book_content", "minecraft:writable_book_content", "raw", "extra", "entities")
        )
    )
    ladder = [
        (many("lastoutput"), F.lit(False)),
        (unnamed, _at(named, 1).isin(*LIST_OWNERS, "minecraft:lore") | many("minecraft:written_book_content", "minecraft:writable_book_content", "minecraft:lore")),
        (last.isin("Text1", "Text2", "Text3", "Text4"), F.lit(True)),
        ((leaf == "displayname") & many("objectives", "teams", "bossbars"), visible_label(value) | F.ltrim(value).rlike(r"^[{\[]")),
        (leaf.isin("prefix", "suffix") & many("teams"), F.lit(True)),
        (leaf.isin("minecraft:custom_name", "minecraft:item_name", "minecraft:lore"), F.lit(True)),
        (leaf.isin("raw", "filtered") & many(*BOOKS), F.lit(True)),
        (leaf.isin("text", "fallback") & component, F.lit(True)),
        (structure & leaf.isin("text", "fallback", "title", "subtitle"), F.lit(True)),
        (leaf.isin("displayname", "title", "subtitle"), F.lit(True)),
        ((last == "Name") & many("display"), F.lit(True)),
        (leaf.isin("pages", "filtered_pages", "command"), F.lit(False)),
    ]
    holds_text = F.ltrim(value).rlike(r"^[{\[]") & value.rlike(r'"text"\s*:\s*"[^"]')
    first = reduce(lambda acc, r: acc.when(*r), ladder[1:], F.when(*ladder[0]))
    return first.otherwise(holds_text)


def opens_address(component: Column) -> Column:
    """Whether a component's click opens an address of the web."""
    click = lambda k, v: F.get_json_object(component, f"$.{k}.{v}")
    action = F.coalesce(click("clickEvent", "action"), click("click_event", "action"))
    target = F.coalesce(click("clickEvent", "value"), click("click_event", "url"), click("click_event", "value"))
    return F.coalesce((action == "open_url") & F.lower(F.trim(target)).rlike("^https?://"), F.lit(False))


def consumes(command: Column) -> Column:
    """Whether a command compares items or data."""
    low = F.lower(F.regexp_replace(F.trim(command), "^/+", ""))
    return low.startswith("clear") | low.rlike(r"\b(if|unless)\s+(items|data)\b")


def compares_data(command: Column) -> Column:
    return F.lower(command).rlike(r"\b(if|unless)\s+data\b")
