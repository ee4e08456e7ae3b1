"""A Merkle manifest of a dataset: leaves of rows, trees of eight by language, one root, and proofs of every leaf.

Nodes are RDD records and trees are built by supersteps, as in Pregel. Going up, every node sends its digest to its
parent; a parent that has all its children hashes them and goes on. Going down, every parent sends each child the
digests beside it and its own way to the root, until leaves hold their proofs. A superstep shuffles one record a node of
its level, so all of them together move little more than the leaves, and no record holds more than eight digests a level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ascii_lower

#: Children of a node.
WAYS = 8
#: Tampered are rows whose id's crc32 this divides.
TAMPER = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level of a proof: (position among the run, the other digests of the run in order).
Step = tuple[int, list[str]]


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def fold_up(own: str, proof: Iterable[Step]) -> str:
    """The root that follows from a leaf and the digests beside its way up. A level without others still hashes."""
    for at, others in proof:
        own = hashlib.sha256("".join(others[:at] + [own] + others[at:]).encode()).hexdigest()
    return own


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and folded (the leaf after tampering: null where nothing was tampered with) of each row. JVM only."""
    have = {c.lower() for c in docs.columns}
    own = [F.col(c) if c in have else F.lit(None).cast("string") for c in COLUMNS]
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPER == 0
    after = digest([*own[:-1], ascii_lower(own[-1])])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), own[2].cast("string").alias("lang"), digest(own).alias("leaf"), F.when(touched, after).alias("folded")
    )


def numbered(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """The rows with ``place`` (from 0 in the order of ``order``, null first, in each ``tree``) and ``total``, the rows of
    the tree.

    Rows are range-partitioned by tree, order and a number that is written with them, so one tree, and one row that is
    repeated without end, fall into many partitions. Each partition numbers its own; a window over one count for each
    partition and tree gives where it starts.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = scratch.keep(rows.withColumn("copy", F.monotonically_increasing_id()))
    by = [F.asc_nulls_first(c) for c in dict.fromkeys([tree, *order, "copy"])]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), (), 0
        for b in batches:
            here = []
            for t in b.column(tree).to_pylist():
                last, n = ((t,), 0) if last != (t,) else (last, n + 1)
                here.append(n)
            more = [pa.array([part] * len(here), pa.int32()), pa.array(here, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "part", "here"])

    own = rows.schema.simpleString()[len("struct<") : -1]
    done = scratch.keep(kept.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("copy").mapInArrow(number, f"{own},part:int,here:bigint"))
    counts = done.groupBy(tree, "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(tree)
    starts = counts.select(
        F.col(tree).alias("tree_"),
        F.col("part").alias("part_"),
        (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("start"),
        F.sum("n").over(whole).alias("total"),
    )
    found = done.join(starts, (F.col("part") == F.col("part_")) & F.col(tree).eqNullSafe(F.col("tree_")))
    out = scratch.keep(found.select(*rows.columns, (F.col("here") + F.col("start")).alias("place"), "total"))
    scratch.drop(kept, done)
    return out


def spread(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def heights(total: int) -> int:
    """Supersteps until one node is left."""
    n = 0
    while total > 1:
        total, n = -(-total // WAYS), n + 1
    return n


def climb(nodes: RDD, steps: int, parts: int) -> tuple[list[RDD], RDD]:
    """Upward supersteps. ``nodes``: ((tree, place), (total, digest, payload)).

    Returns for each level the runs, ((tree, parent), [(digest, payload), ...]), and all tops (tree, (digest, height, payload)).
    A parent is complete when it has min(WAYS, total - WAYS * parent) children; all arrive in its superstep.
    """
    runs, tops, level = [], [], nodes
    for height in range(steps + 1):
        tops.append(level.filter(lambda r: r[1][0] == 1).map(lambda r, height=height: (r[0][0], (r[1][1], height, r[1][2]))))
        if height == steps:
            break

        def send(r):
            (tree, place), (total, own, payload) = r
            return (tree, place // WAYS), (place % WAYS, own, payload, total)

        def run(r):
            children = sorted(r[1], key=lambda c: c[0])
            if len(children) != min(WAYS, children[0][3] - WAYS * r[0][1]):
                raise ValueError(f"incomplete run {r[0]}")
            return r[0], (-(-children[0][3] // WAYS), [(c[1], c[2]) for c in children])

        met = level.filter(lambda r: r[1][0] > 1).map(send).groupByKey(parts, spread).map(run, preservesPartitioning=True)
        runs.append(met)
        level = met.map(lambda r: (r[0], (r[1][0], hashlib.sha256("".join(c[0] for c in r[1][1]).encode()).hexdigest(), None)), preservesPartitioning=True)
    return runs, nodes.context.union(tops)


def descend(runs: list[RDD], tops: RDD, parts: int) -> RDD:
    """Downward supersteps. ``tops``: (tree, (height, payload, way)), way being (names, [steps from there to the root]).

    Returns (payload, way) of every leaf. Every parent sends to each child the run's other digests before its own way.
    """

    def expand(r):
        (tree, parent), ((_, children), (names, way)) = r
        digests = [c[0] for c in children]
        for k, (_, payload) in enumerate(children):
            yield (tree, parent * WAYS + k), payload, (names, [(k, digests[:k] + digests[k + 1 :]), *way])

    def begin(height):
        return tops.filter(lambda r: r[1][0] == height).map(lambda r: ((r[0], 0), r[1][2]))

    ways, found = None, tops.filter(lambda r: r[1][0] == 0).map(lambda r: (r[1][1], r[1][2]))
    for height in range(len(runs), 0, -1):
        here = begin(height)
        here = here if ways is None else here.union(ways.map(lambda r: (r[0], r[2])))
        ways = runs[height - 1].join(here.partitionBy(parts, spread), parts).flatMap(expand)
    return found if ways is None else found.union(ways.map(lambda r: (r[1], r[2])))


def walk(docs: DataFrame) -> RDD:
    """(doc_id, lang, leaf, folded, subroot, root, steps) of every row, or None of an empty table."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sizes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = numbered(leaves(docs), "lang", ["doc_id", "leaf"], scratch)
    total = rows.agg(F.max("total")).first()[0]
    if total is None:
        return None
    nodes = rows.rdd.map(lambda r: ((r.lang, r.place), (r.total, r.leaf, (r.doc_id, r.leaf, r.folded))))
    runs, tops = climb(nodes, heights(total), sizes)
    schema = "lang string, subroot string, height int, doc_id long, leaf string, folded string"
    trees = scratch.keep(spark.createDataFrame(tops.map(lambda r: (r[0], *r[1][:2], *(r[1][2] or (None, None, None)))), schema, verifySchema=False))
    ordered = numbered(trees.withColumn("all", F.lit(0)), "all", ["lang"], scratch)
    upper = ordered.rdd.map(lambda r: ((0, r.place), (r.total, r.subroot, (r.lang, r.subroot, r.height, (r.doc_id, r.leaf, r.folded)))))
    over, top = climb(upper, heights(ordered.agg(F.max("total")).first()[0]), sizes)
    ((tree, (root, height, payload)),) = top.collect()  # the one root
    ways = descend(over, nodes.context.parallelize([(tree, (height, payload, ((root,), [])))], 1), sizes)
    begun = ways.map(lambda r: (r[0][0], (r[0][2], r[0][3], ((r[0][0], r[0][1], r[1][0][0]), r[1][1]))))
    return descend(runs, begun, sizes).map(lambda r: (*r[0][:1], r[1][0][0], *r[0][1:], *r[1][0][1:], r[1][1]))


PROOFS = "doc_id long, lang string, leaf string, folded string, subroot string, root string, proof array<struct<at int, others array<string>>>"
REPORT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(docs: DataFrame) -> DataFrame:
    """The manifest: of every row its leaf, subroot, root and proof, level by level; ``folded`` is the tampered leaf, if any.

    Columns that ``docs`` lacks count as null, others play no part. A null id stands first, and counts as the empty text
    where its crc32 is asked for. Rows of one id follow each other by leaf; repeated rows are leaves of their own. An empty
    table gives no rows.
    """
    found = walk(docs)
    return docs.sparkSession.createDataFrame([] if found is None else found, PROOFS, verifySchema=False)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, as ``proofs`` has them."""

    def line(r):
        doc_id, _, leaf, folded, subroot, root, steps = r
        beside = "".join(x for _, others in steps for x in others)
        back = fold_up(folded or leaf, steps)
        return doc_id, leaf, subroot, root, hashlib.sha256(beside.encode()).hexdigest(), back, back == root

    found = walk(docs)
    return docs.sparkSession.createDataFrame([] if found is None else found.map(line), REPORT, verifySchema=False)


def verified(manifest: DataFrame) -> DataFrame:
    """``proofs`` with ``root_found``, what each leaf (the tampered one, if any) folds up to, and ``verified``."""
    fold = F.udf(lambda leaf, proof: fold_up(leaf, [(s.at, list(s.others)) for s in proof]), "string")
    out = manifest.withColumn("root_found", fold(F.coalesce("folded", "leaf"), "proof"))
    return out.withColumn("verified", F.col("root_found") == F.col("root"))


#: crc32 by bits, as SQL has none: of a short ASCII text.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in COLUMNS[:-1]) + " || {0})"
_AFTER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_LEAF.format(_FIELD.format("text"))} AS leaf,
         CASE WHEN {CRC.format("doc_id::VARCHAR")} % {TAMPER} = 0 THEN {_LEAF.format(_FIELD.format(_AFTER))} END AS folded
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), lower_ AS (
  SELECT lang, 0 AS height, place, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, height + 1, place // {WAYS}, (n + {WAYS - 1}) // {WAYS}, sha256(string_agg(h, '' ORDER BY place)) FROM lower_ WHERE n > 1
  GROUP BY lang, height, place // {WAYS}, n
), trees AS (
  SELECT lang, height AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM lower_ WHERE n = 1
), upper_ AS (
  SELECT 0 AS height, rank AS place, n, subroot AS h FROM trees
  UNION ALL
  SELECT height + 1, place // {WAYS}, (n + {WAYS - 1}) // {WAYS}, sha256(string_agg(h, '' ORDER BY place)) FROM upper_ WHERE n > 1
  GROUP BY height, place // {WAYS}, n
), nodes AS (
  SELECT coalesce(lang, '') AS tree, lang IS NULL AS none, false AS over, height, place, h FROM lower_ WHERE n > 1
  UNION ALL SELECT '', false, true, height, place, h FROM upper_ WHERE n > 1
), beside AS (
  SELECT tree, none, over, height, place,
         coalesce(string_agg(h, '' ORDER BY place) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS left_,
         coalesce(string_agg(h, '' ORDER BY place) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS right_
  FROM nodes WINDOW run AS (PARTITION BY tree, none, over, height, place // {WAYS} ORDER BY place)
), steps AS (
  SELECT p.row, b.height AS step, b.left_, b.right_ FROM placed p JOIN beside b
    ON NOT b.over AND b.tree = coalesce(p.lang, '') AND b.none = (p.lang IS NULL) AND b.place = p.place // ({WAYS} ** b.height)::BIGINT
  UNION ALL
  SELECT p.row, t.top + b.height, b.left_, b.right_ FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang
    JOIN beside b ON b.over AND b.place = t.rank // ({WAYS} ** b.height)::BIGINT
), whole AS (
  SELECT p.row, coalesce(string_agg(s.left_ || s.right_, '' ORDER BY s.step), '') AS sides, count(s.step) AS total
  FROM placed p LEFT JOIN steps s ON s.row = p.row GROUP BY p.row
), fold_ AS (
  SELECT row, 0 AS step, coalesce(folded, leaf) AS h FROM placed
  UNION ALL
  SELECT f.row, f.step + 1, sha256(s.left_ || f.h || s.right_) FROM fold_ f JOIN steps s ON s.row = f.row AND s.step = f.step
)
SELECT p.doc_id, p.leaf, t.subroot, r.h AS root, sha256(w.sides) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang JOIN whole w ON w.row = p.row
JOIN fold_ f ON f.row = p.row AND f.step = w.total CROSS JOIN (SELECT h FROM upper_ WHERE n = 1) r
"""
