"""What becomes of candidates: the one gate that all go through, providers of new ones, and how a unit is shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lines import newline_rule, with_padding, with_real_breaks
from millrace.functions.shape import shape_restored
from millrace.functions.text import content_reason, context_gate, strip


def reuse_gate(units: DataFrame, source: str = "source", target: str = "target", restore: bool = False) -> DataFrame:
    """The units with ``accepted`` and ``reason`` of their candidate: stored, shared or new, all go through this.

    The ladder: no candidate, a puzzle that changed, line breaks and padding given back where the container's rule repairs,
    the context gate under that rule, and last an emptied text, which only a layout slot may become. Units have form,
    layout, before_click and puzzle (booleans; null counts as false).

    With ``restore``, a candidate that flowed where the rule allows it is laid over its source's rows first
    (``functions.shape``), and refused as ``unproven_layout`` where that has no proof.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    s, t = F.col(source), F.col(target)
    rule = newline_rule(F.col("form"), s, flag("layout"), flag("before_click"))
    held = units.withColumn("__rule", rule)
    shaped = F.when(F.col("__rule.repair"), with_padding(s, with_real_breaks(s, t))).otherwise(t)
    held = held.withColumn("__t", shaped)
    flows = F.col("__rule.reflow") & (strip(F.col("__t")) != "")
    if restore:  # the others go to Python as null
        held = held.withColumn("__laid", shape_restored(F.when(flows, s), F.when(flows, F.col("__t"))))
        held = held.withColumn("__t", F.when(flows & F.col("__laid").isNotNull(), F.col("__laid")).otherwise(F.col("__t")))
    text = F.col("__t")
    gate = context_gate(s, text, F.col("__rule.strict"))
    emptied = (strip(text) == "") & (strip(s) != "")
    reason = (
        F.when(t.isNull(), "no_candidate")
        .when(flag("puzzle") & (t != s), "puzzle_content")
        .when(F.lit(restore) & flows & F.col("__laid" if restore else "__t").isNull(), "unproven_layout")
        .when(emptied & ~flag("layout"), "empty_candidate")
        .when(~emptied, gate)
    )
    return held.withColumn("reason", reason).withColumn("accepted", F.when(F.col("reason").isNull(), text)).drop("__rule", "__t", "__laid")


def display_content(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """key and reason: what was written reads wrong against its source, such as a model's scaffolding or a lost negation."""
    met = before.select(key, F.col(text).alias("source")).join(after.select(key, F.col(text).alias("target")), key)
    return met.select(key, content_reason(F.col("source"), F.col("target")).alias("reason")).where("reason IS NOT NULL")


#: A provider turns texts into as many candidates, null where it has none. It may raise: its batch then has none.
Provider = Callable[[list[str]], list[str | None]]


def glossary_provider(terms: dict[str, str]) -> Provider:
    """The offline default: texts that a glossary holds."""
    known = {k.strip().lower(): v for k, v in terms.items()}
    return lambda texts: [known.get(t.strip().lower()) for t in texts]


def provided(units: DataFrame, provider: Provider, text: str = "source", workers: int | None = None, batch: int = 12, tries: int = 2) -> DataFrame:
    """The units with ``candidate`` and ``state`` (``new``, ``none`` or ``failed``). ``workers`` bounds how many tasks ask at once
    (the units are then dealt into as many partitions); every task asks for ``batch`` texts at a time, and what failed
    once more by itself at the end of the task, ``tries`` times in all. Null texts are not asked for.
    """
    dealt = units.repartition(workers) if workers else units

    def ask(texts: list[str]) -> list[str | None] | None:
        try:
            got = provider(texts)
        except Exception:  # noqa: BLE001  a provider's failure is a state of its units, not of the job
            return None
        return got if len(got) == len(texts) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(text).to_pylist()
            asked = [k for k, t in enumerate(rows) if t is not None]
            found: list[str | None] = [None] * len(rows)
            state = ["none"] * len(rows)
            failed = []
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                got = ask([rows[k] for k in part])
                if got is None:
                    failed += part
                else:
                    for k, c in zip(part, got, strict=True):
                        found[k], state[k] = c, "none" if c is None else "new"
            for k in failed:
                state[k] = "failed"
                for _ in range(tries - 1):
                    if (got := ask([rows[k]])) is not None:
                        found[k], state[k] = got[0], "none" if got[0] is None else "new"
                        break
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(state)], names=[*b.schema.names, "candidate", "state"])

    schema = units.schema.add("candidate", "string").add("state", "string")
    return dealt.mapInArrow(run, schema)


def presentation(policy: Column, outcome: Column, form: Column, target: Column) -> list[Column]:
    """Columns of a unit's row in a table: role, tag, editable and issue."""
    role = F.when(form.isin("json-lang", "legacy-lang"), "language").when(form == "mcfunction", "command").when(form == "nbt-text", "world").otherwise("document")
    editable = (policy == "TRANSLATABLE_DISPLAY") & ~outcome.isin("mechanism_locked", "writeback_failed")
    tag = (
        F.when(outcome == "written", "done").when(outcome.isin("mechanism_locked", "intentional_keep", "source_preserved"), "kept").when(outcome == "pending", "open").otherwise("problem")
    )
    issue = F.when(outcome == "candidate_rejected", "rejected").when(outcome == "writeback_failed", "not written").when((outcome == "written") & (F.coalesce(strip(target), F.lit("")) == ""), "empty")
    return [role.alias("role"), tag.alias("tag"), editable.alias("editable"), issue.alias("issue")]


def semantic_owner(form: Column, line: Column, path: Column) -> Column:
    """struct<owner, container>: what a unit belongs to. A book's pages belong to the book, a sign's lines to the sign, a
    command's texts to its line, an entry of a language file to itself."""
    keys = F.coalesce(path, F.array().cast("array<string>"))
    low = F.transform(keys, F.lower)
    pages, sign = F.array_position(low, "pages"), F.exists(low, lambda x: x.isin("front_text", "back_text", "text1", "text2", "text3", "text4"))
    pair = lambda owner, kind: F.struct(owner.alias("owner"), F.lit(kind).alias("container"))
    above = lambda n: F.array_join(F.slice(keys, F.lit(1), F.greatest(n.cast("int"), F.lit(0))), "/")
    return (
        F.when(form.isin("json-lang", "legacy-lang"), pair(F.array_join(keys, "/"), "entry"))
        .when(pages > 0, pair(above(pages - 1), "book"))
        .when(sign, pair(above(F.array_position(F.transform(low, lambda x: x.isin("front_text", "back_text", "text1", "text2", "text3", "text4").cast("string")), "true") - 1), "sign"))
        .when(form == "mcfunction", pair(line.cast("string"), "command"))
        .otherwise(pair(above(F.size(keys) - 1), "object"))
    )


def game_version(leaves: DataFrame) -> DataFrame:
    """version of the shallowest world file (level.dat) among tag leaves: its name, else what its number stands for. No row
    without such a file; null where it says neither."""
    own = leaves.where(F.lower(F.element_at(F.split("path", "/"), -1)) == "level.dat").withColumn("depth", F.size(F.split("path", "/")))
    first = own.groupBy().agg(F.min(F.struct("depth", "path"))["path"].alias("path"))
    at = F.array_join("keys", ".")
    seen = own.join(F.broadcast(first), "path").agg(
        F.max(F.when(at == "Data.Version.Name", F.col("value"))).alias("name"), F.max(F.when(at == "Data.version", F.col("value"))).alias("number"), F.count("*").alias("n")
    )
    old = F.when(F.col("number") == "19133", "<=1.8").when(F.col("number") == "19132", "<=1.1")
    return seen.where("n > 0").select(F.coalesce("name", old).alias("version"))
