"""What the language model's job writes, and its results however words are dealt to chunks and buckets."""

import os
import random

import numpy as np
import pytest

from millrace.llm import lm
from millrace.llm.common import Scratch
from millrace.session import checkpoint_dir


def written(spark):
    base = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(base) for f in files)


def rare_words(n, seed):
    """Words that stand once, as numbers and names do: each has places of its own."""
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12)) for _ in range(n)]


def test_tables_stay_near_the_size_of_the_texts(spark, monkeypatch):
    words = rare_words(60_000, 1)
    rows = [(i, " ".join(words[i::60])) for i in range(60)]
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)  # so that all tables of the run are counted
    before = written(spark)
    assert lm.score(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
    assert written(spark) - before < 16 * sum(len(t) for _, t in rows)


def test_scores_of_many_chunks_and_buckets(spark, monkeypatch):
    words = rare_words(300, 2) + ["kato", "mi", "longer-word-here", "longer-word-there", "", "ka\x00tolo\x00ra", "ééééééé"]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {r.doc_id: r for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "BUCKET", 150)
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in lm.score(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    chunks, trees, _ = kept
    assert chunks.count() > 2 and trees.count() > 4 and trees.select("bucket").distinct().count() == trees.count()
    assert len(got) == len(want) == 42
    for i, r in got.items():
        assert r.score == pytest.approx(want[i].score, rel=1e-12) and r.base_score == pytest.approx(want[i].base_score, rel=1e-12)
        assert r[1:5] == want[i][1:5]


def test_pack_gives_back_what_it_got():
    rng = np.random.default_rng(4)
    for x, rising in (
        (np.sort(rng.integers(0, 1 << 59, 1000, np.uint64)), True),
        (np.array([5, 9, 2, 7], np.int64), True),
        (rng.integers(0, 9, 1000), False),
        (-rng.random(1000), False),
        (np.zeros(0), False),
    ):
        assert (lm.unpack(lm.pack(x, rising), len(x), x.dtype.type, rising) == x).all()


def test_decisions_count_each_byte_once_a_level():
    keys, n = np.array([0x4161, 0x4162, 0x4261], np.uint64), np.array([2, 3, 4])
    nodes, zeros, ones = lm.decisions(keys, n)
    assert (np.diff(nodes.astype(np.int64)) > 0).all() and (zeros + ones).sum() == 8 * n.sum()
    last = dict(zip(nodes.tolist(), zip(zeros, ones, strict=True), strict=True))
    assert last[0x4100 | 0x80 | 0x61 >> 1] == (0, 2) and last[0x4100 | 0x80 | 0x62 >> 1] == (3, 0) and last[0x4100 | 1] == (5, 0)


def test_a_piece_keeps_one_context_whole(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 3)
    near = np.array([1, 1, 2, 2, 2, 2, 2, 3, 4, 4], np.uint64)
    keys = near << np.uint64(35) | np.arange(10, dtype=np.uint64)
    assert [(c.start, c.stop) for c in lm.pieces(keys)] == [(0, 7), (7, 10)]
