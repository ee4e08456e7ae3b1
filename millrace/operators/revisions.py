"""Passages revised as a whole: a gate for all that has to do with line breaks, and adoption that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import SPACE
from millrace.session import checkpoint_dir

# Rows that are layout inside a text, and marks that no row may begin or end with.
INNER_FIXED = r"\n[ \t]*\n|\n[ \t]*={3,}"
DIVIDER_ROW = r"^[ \t]*={3,}[ \t]*$"
HAN = r"^[\x{3400}-\x{9fff}\x{f900}-\x{faff}]$"
NO_ROW_START, NO_ROW_END = "，。！？；：、…）」』”’,.!?;:%", "（「『“‘("
#: Stands between two members of one passage: of one style, and of two.
SAME, OTHER = "\x01", "\x02"


def fixed_edges(text: Column) -> tuple[Column, Column, Column]:
    """(lead, core, trail): white space with a break at the start, and at the end white space and rows of ``===`` of which any
    is a break or a divider. Edges that are mere spaces belong to the core."""
    lead = F.regexp_extract(text, f"^{SPACE}*", 0)
    trail = F.regexp_extract(F.substring(text, F.length(lead) + 1, F.length(text)), rf"(?:\n[ \t]*={{3,}}|{SPACE})*\z", 0)
    lead, trail = F.when(lead.contains("\n"), lead).otherwise(""), F.when(trail.rlike("[\n=]"), trail).otherwise("")
    return lead, F.substring(text, F.length(lead) + 1, F.length(text) - F.length(lead) - F.length(trail)), trail


def divider_rows(core: Column) -> Column:
    """Rows of ``===``, each with its number: from the end, but for a first one."""
    rows = F.split(core, "\n", -1)
    numbered = F.transform(rows, lambda x, k: F.struct(F.when(k == 0, 0).otherwise(k - F.size(rows)).alias("k"), x.alias("row")))
    return F.filter(numbered, lambda x: x["row"].rlike(DIVIDER_ROW))


def passage_gate(members: DataFrame) -> DataFrame:
    """passage and reason (null: it may be written) of every passage.

    ``members``: passage, place (its order), source, target (null: the source stays) and style (null counts as a style). All
    are collected by passage: a passage is what one message shows. The first reason that holds, by members in order:
    ``fixed_edge`` (what begins or ends the source with a break must stay), ``inner_fixed_row`` (an empty row or a divider that
    the source hasn't at this place); then for the whole: ``break_count``, ``empty_row``, and at the first break that may not
    be, ``between_hanzi``, ``punctuation`` or ``in_word`` (the last two members' edge may cut a word only where the style changes).
    """
    lead, core, trail = fixed_edges(F.col("source"))
    own = members.select("passage", "place", "style", F.coalesce("target", "source").alias("t"), lead.alias("lead"), core.alias("core"), trail.alias("trail"))
    bare = F.regexp_replace("trail", "^[ \t]+", "")
    # the candidate may have more or fewer spaces before a fixed end
    ends = F.when(F.col("trail") == "", "").otherwise(F.concat(F.regexp_extract(F.substring(F.col("t"), F.lit(1), F.length("t") - F.length(bare)), r"[ \t]*\z", 0), bare))
    cut = F.substring(F.col("t"), F.length("lead") + 1, F.length("t") - F.length("lead") - F.length(ends))
    edge = ~F.startswith(F.col("t"), F.col("lead")) | ~F.endswith(F.col("t"), bare) | (F.length("lead") + F.length(ends) > F.length("t"))
    own = own.withColumn("edge", edge).withColumn("new", F.when(~edge, cut))
    fixed = F.when(F.col("edge"), "fixed_edge").when(F.col("new").rlike(INNER_FIXED) | (divider_rows(F.col("core")) != divider_rows(F.col("new"))), "inner_fixed_row")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    flat = F.regexp_replace("new", r"[ \t]*\n[ \t]*", "\n")
    row = F.struct("place", fixed.alias("reason"), breaks(F.col("core")).alias("was"), flat.alias("text"), "style")
    held = own.select("passage", row.alias("m")).groupBy("passage").agg(F.sort_array(F.collect_list("m")).alias("m"))
    total = lambda f: F.aggregate("m", F.lit(0), lambda a, x: a + f(x))
    first = F.get(F.filter(F.transform("m", lambda x: x["reason"]), lambda x: x.isNotNull()), 0)
    shown = F.filter("m", lambda x: x["text"] != "")
    edges = F.transform(shown, lambda x, k: F.concat(F.when(k == 0, "").when(x["style"].eqNullSafe(F.get(shown, k - 1)["style"]), SAME).otherwise(OTHER), x["text"]))
    rows = F.split(F.array_join(edges, ""), "\n", -1)
    held = held.select("passage", first.alias("reason"), total(lambda x: x["was"]).alias("was"), total(lambda x: breaks(x["text"])).alias("now"), rows.alias("rows"))
    marks = f"[{SAME}{OTHER}]"
    above, below = F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows"))

    def at_break(x: Column, y: Column) -> Column:
        a, b = F.regexp_replace(x, f"{marks}+$", ""), F.regexp_replace(y, f"^{marks}+", "")
        a, b = F.substring(a, -1, 1), F.substring(b, 1, 1)
        between = F.concat(F.regexp_extract(x, f"{marks}*$", 0), F.regexp_extract(y, f"^{marks}*", 0))
        word = lambda c: c.rlike("^[A-Za-z0-9]$")
        return (
            F.when(a.rlike(HAN) & b.rlike(HAN) & ~between.contains(OTHER), "between_hanzi")
            .when(F.lit(NO_ROW_START).contains(b) | F.lit(NO_ROW_END).contains(a), "punctuation")
            .when(word(a) & word(b) & (between != "") & ~between.contains(OTHER), "in_word")
        )

    blank = F.exists("rows", lambda x: F.regexp_replace(x, marks, "") == "")
    at = F.get(F.filter(F.zip_with(above, below, at_break), lambda x: x.isNotNull()), 0)
    several = F.size("rows") > 1
    reason = F.coalesce("reason", F.when(F.col("was") != F.col("now"), "break_count").when(several & blank, "empty_row").when(several, at))
    return held.select("passage", reason.alias("reason"))


def claimed(proposals: DataFrame) -> DataFrame:
    """passage and reason of proposals (passage, rank, unit, reason: one row a member), adopted in the order of rank.

    A proposal with a reason of its own is refused; else it is adopted unless one of its units is bound by an adopted one of
    lower rank (``already_bound``). In each round those adopt that are first at all their units, and all that share a unit
    with them are refused, which gives what going through them one by one would. ``rank`` is different for each passage.
    """
    spark = proposals.sparkSession
    checkpoint_dir(spark)
    whole = proposals.groupBy("passage").agg(F.min("rank").alias("rank"), F.max("reason").alias("reason"))
    done = whole.where("reason IS NOT NULL").select("passage", "reason")
    open_ = proposals.join(whole.where("reason IS NULL").select("passage"), "passage").select("passage", "rank", "unit").distinct().checkpoint()
    while not open_.isEmpty():
        first = open_.groupBy("unit").agg(F.min("rank").alias("least"))
        met = open_.join(first, "unit").groupBy("passage").agg(F.bool_and(F.col("rank") == F.col("least")).alias("leads"))
        adopted = met.where("leads").select("passage")
        bound = open_.join(adopted, "passage").select("unit").distinct()
        lost = open_.join(bound, "unit").select("passage").distinct().join(adopted, "passage", "left_anti")
        done = done.unionByName(adopted.withColumn("reason", F.lit(None).cast("string"))).unionByName(lost.withColumn("reason", F.lit("already_bound"))).checkpoint()
        open_ = open_.join(done.select("passage"), "passage", "left_anti").checkpoint()
    return done


def settled(judged: DataFrame, chains: DataFrame) -> DataFrame:
    """passage and reason once chains are enforced. ``judged``: passage, reason; ``chains``: chain, passage, all passages that
    share one sentence, proposed or not.

    If any passage of a chain isn't adopted, none stays (``chain_incomplete``), and as a passage may stand in several chains,
    that goes on until nothing changes: one failure undoes all that hang together with it, and nothing else.
    """
    checkpoint_dir(judged.sparkSession)
    own = chains.select("chain", "passage").distinct()
    now = judged.select("passage", "reason")
    while True:
        met = own.join(now.select("passage", F.col("reason").isNull().alias("ok")), "passage", "left")
        broken = met.groupBy("chain").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("NOT ok").select("chain")
        undone = own.join(broken, "chain").select("passage").distinct().withColumn("undone", F.lit(True))
        step = now.join(undone, "passage", "left").select("passage", F.when(F.col("reason").isNull() & F.col("undone"), "chain_incomplete").otherwise(F.col("reason")).alias("reason"), (F.col("reason").isNull() & F.coalesce("undone", F.lit(False))).alias("moved")).checkpoint()
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def adopted_targets(units: DataFrame, proposals: DataFrame, settled_: DataFrame) -> DataFrame:
    """The units (unit, target and more) with what adopted proposals (passage, unit, target) say in place of their target, and
    ``passage`` where one did. All others keep the target that they had, as after a rollback."""
    kept = settled_.where("reason IS NULL").select("passage")
    new = proposals.join(kept, "passage").select("unit", F.col("passage").alias("passage_"), F.col("target").alias("new_")).distinct()
    held = units.join(new, "unit", "left").withColumn("target", F.when(F.col("passage_").isNotNull(), F.col("new_")).otherwise(F.col("target")))
    return held.withColumn("passage", F.col("passage_")).drop("passage_", "new_")


def islands(members: DataFrame) -> DataFrame:
    """chain, passage of soft chains: passages of one message that follow each other without a gap. ``members``: message,
    passage, first and last (the places of its first and last component). A message's passages are one window."""
    w = Window.partitionBy("message").orderBy("first")
    gap = F.coalesce((F.col("first") > F.lag("last").over(w) + 1).cast("int"), F.lit(1))
    run = members.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.select(F.concat_ws("#", F.col("message").cast("string"), F.col("run").cast("string")).alias("chain"), "passage")
