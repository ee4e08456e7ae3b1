"""One reply cut back into the members of its passage: by members whose words are known, else by tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import let
from millrace.functions.text import SPACE

# What counts as no words between two members, marks in both widths, and tags round members.
NO_WORDS = r"[\s，。,.!！?？、]"
FULL, HALF = "，。！？：；", ",.!?:;"
TAG = r"(?s)<x(\d+)>(.*?)</x\1>"
ANY_TAG = r"</?x\d*\s*/?>"
EDGE_MARKS = "，。！？,.!?：:"


def bare(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def known(x: Column) -> Column:
    """Whether a member's words are known: a name, or what stays as it is."""
    return x["kind"].isin("name", "locked")


def located(text: Column, x: Column) -> Column:
    """struct<start, end> of a member's term in a text, white space left out of account; null unless it stands there exactly
    once. The member's closing marks belong to it, in either width."""
    flat, term = bare(text), bare(x["term"])
    at = F.position(term, flat)
    once = (F.length(term) > 0) & (at > 0) & (F.position(term, flat, at + 1) == 0)
    # the term's characters, with any white space between two
    spaced = F.regexp_replace(F.regexp_replace(term, r"(?s)(.)", r"\\Q$1\\E "), " (?=.)", rf"{SPACE}*".replace("\\", "\\\\"))
    spaced = F.rtrim(spaced)
    start = F.length(F.get(F.split(text, spaced, 2), 0))
    end = start + F.length(F.regexp_substr(text, spaced))
    marks = F.coalesce(x["marks"], F.lit(""))
    fold = lambda c: F.translate(c, FULL, HALF)
    closed = fold(F.substring(text, end + 1, F.length(marks))) == fold(marks)
    return F.when(once, F.struct(start.alias("start"), F.when(closed, end + F.length(marks)).otherwise(end).alias("end")))


def dealt(m: Column, cut: Column, regions: Column, texts: Column) -> Column:
    """struct<shares, reason>: the regions between a reply's anchors given to members.

    ``cut``: the anchors among ``m``, by place; ``texts``: their own, ``regions``: what stands before each, and after the last. A
    region goes to the one member between its anchors. Where there is none and the region has words, the anchor before
    takes them if it is free, else the one after; names and locked members never do.
    """
    n = F.size(cut)
    place = lambda k: F.get(cut, k)["place"]
    between = lambda x, k: (F.coalesce(x["place"] > place(k - 1), F.lit(True))) & (F.coalesce(x["place"] < place(k), F.lit(True)))
    free = lambda k: F.coalesce(F.get(cut, k)["kind"] == "free", F.lit(False))

    def gap(k: Column) -> Column:
        region = F.get(regions, k)
        owners = F.filter(m, lambda x: between(x, k))
        wordless = F.regexp_replace(region, NO_WORDS, "") == ""
        return let(F.struct(region.alias("region"), owners.alias("owners"), wordless.alias("wordless")), lambda v: judged(k, v))

    def judged(k: Column, v: Column) -> Column:
        region, owners, wordless = v["region"], v["owners"], v["wordless"]
        reason = (
            F.when((F.size(owners) == 0) & ~wordless & ~free(k - 1) & ~free(k), "orphan_text")
            .when(F.size(owners) > 1, "multi_owner_gap")
            .when((F.size(owners) == 1) & (bare(region) == ""), "empty_share")
        )
        lone = (F.size(owners) == 0) & ~wordless
        return F.struct(
            F.get(owners, 0)["place"].alias("owner"), region.alias("region"), reason.alias("reason"),
            F.when(lone & free(k - 1), region).otherwise("").alias("back"), F.when(lone & ~free(k - 1), region).otherwise("").alias("on"),
        )

    share = lambda place, text: F.struct(place.alias("place"), text.alias("share"))

    def shares(g: Column) -> Column:
        whole = F.transform(cut, lambda x, k: share(x["place"], F.concat(F.get(g, k)["on"], F.get(texts, k), F.get(g, k + 1)["back"])))
        owned = F.transform(F.filter(g, lambda x: x["owner"].isNotNull()), lambda x: share(x["owner"], x["region"]))
        reason = F.get(F.filter(F.transform(g, lambda x: x["reason"]), lambda x: x.isNotNull()), 0)
        return F.struct(F.array_sort(F.concat(whole, owned)).alias("shares"), reason.alias("reason"))

    return let(F.transform(F.sequence(F.lit(0), n), gap), shares)


def refused(reason: Column | str) -> Column:
    return F.struct(F.lit(None).cast("array<struct<place:int,share:string>>").alias("shares"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def split_back(members: DataFrame, replies: DataFrame) -> DataFrame:
    """passage, mode (``anchors`` or ``tags``), reason (null: it was cut) and shares (array<struct<place, share>>, by place) of every
    reply whose passage has members.

    ``members``: passage, place (int, unique in its passage), kind (``free``, ``fixed``, ``name``, ``locked``; null counts as fixed), term (a name's or
    locked member's words), marks (its closing marks, or null) and tagged (whether the tagged request had tags round it).
    ``replies``: passage, plain and tagged (null: there is none); one row a passage. Members are collected by passage: a
    passage is what one message shows.

    The plain reply is cut by its known members: each must stand in it exactly once (``anchor_missing``), in order
    (``anchor_order``). If that fails, the tagged reply is cut by its tags, which must be those sent, each once
    (``tags_lost_or_duplicated``), in order (``anchor_order``), not empty (``empty_anchor``), with known words kept (``term_not_kept``).
    Both then ask for one member between two anchors (``multi_owner_gap``), with words (``empty_share``), and no words
    without a member (``orphan_text``). No reply: ``no_reply``. Nothing of a reply is lost but white space and marks
    between two anchors.
    """
    own = F.struct(F.col("place").cast("int").alias("place"), F.coalesce("kind", F.lit("fixed")).alias("kind"), "term", "marks", F.coalesce("tagged", F.lit(False)).alias("tagged"))
    held = members.select("passage", own.alias("m")).groupBy("passage").agg(F.sort_array(F.collect_list("m")).alias("m")).join(replies.select("passage", "plain", "tagged"), "passage")
    held = held.withColumn("cut", F.filter("m", known)).withColumn("tagged_cut", F.filter("m", lambda x: x["tagged"]))
    held = held.withColumn("spans", F.transform("cut", lambda x: located(F.col("plain"), x)))
    # a lambda writes its parts out for every element: what is long is a column first
    end_before = lambda k: F.when(k == 0, 0).otherwise(F.get("spans", k - 1)["end"])
    start = lambda k: F.coalesce(F.get("spans", k)["start"], F.length("plain"))
    held = held.select(
        "passage", "plain", "tagged", "m", "cut", "tagged_cut",
        F.transform("spans", lambda s, k: F.when(s.isNull(), "anchor_missing").when(s["start"] < end_before(k), "anchor_order")).alias("faults"),
        F.transform(F.sequence(F.lit(0), F.size("spans")), lambda k: F.substring(F.col("plain"), end_before(k) + 1, start(k) - end_before(k))).alias("regions"),
        F.transform("spans", lambda s: F.substring(F.col("plain"), s["start"] + 1, s["end"] - s["start"])).alias("texts"),
    )
    blank = lambda c: F.coalesce(bare(F.col(c)) == "", F.lit(True))
    fault = F.get(F.filter("faults", lambda x: x.isNotNull()), 0)
    anchors = F.when(blank("plain"), refused("no_reply")).when(fault.isNotNull(), refused(fault)).otherwise(dealt(F.col("m"), F.col("cut"), F.col("regions"), F.col("texts")))
    held = held.select("passage", "m", "tagged_cut", anchors.alias("a"), F.when(~blank("tagged"), F.col("tagged")).alias("tagged"))

    # only what its anchors did not cut goes on to its tags
    asked = F.when(F.col("a.reason").isNotNull(), F.col("tagged"))
    held = held.select("passage", "m", "tagged_cut", "a", asked.alias("tagged"))
    held = held.select(
        "passage", "m", "tagged_cut", "a", "tagged", F.split("tagged", TAG, -1).alias("pieces"), F.regexp_extract_all("tagged", F.lit(TAG), F.lit(2)).alias("inner"),
        F.transform(F.regexp_extract_all("tagged", F.lit(TAG), F.lit(1)), lambda x: x.try_cast("int")).alias("ids"),
    )
    sent = F.transform("tagged_cut", lambda x: x["place"])
    stray = F.array_join("pieces", "").rlike(ANY_TAG)
    kept = lambda c: F.trim(bare(c), F.lit(EDGE_MARKS))
    pairs = F.zip_with("tagged_cut", "inner", lambda x, t: F.when(bare(t) == "", "empty_anchor").when(known(x) & (kept(t) != kept(x["term"])), "term_not_kept"))
    lost = F.get(F.filter(pairs, lambda x: x.isNotNull()), 0)
    why = F.when((F.array_sort("ids") != sent) | stray, "tags_lost_or_duplicated").when(F.col("ids") != sent, "anchor_order").when(lost.isNotNull(), lost)
    held = held.withColumn("why", why)
    tags = F.when(F.col("why").isNotNull(), refused(F.col("why"))).otherwise(dealt(F.col("m"), F.col("tagged_cut"), F.col("pieces"), F.col("inner")))
    by_tags = F.col("tagged").isNotNull()
    held = held.select("passage", F.when(by_tags, "tags").otherwise("anchors").alias("mode"), F.when(by_tags, tags).otherwise(F.col("a")).alias("r"))
    return held.select("passage", "mode", "r.reason", F.when(F.col("r.reason").isNull(), F.col("r.shares")).alias("shares"))
