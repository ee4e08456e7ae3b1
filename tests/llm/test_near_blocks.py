from millrace.llm import near_dedup


def test_blocks_of_a_crowded_bucket(spark):
    """Every two members of different components meet in one group, and rows grow with the crowd, not with its square."""
    made = {}
    for size in (1000, 4000):
        rows = [(1, size + 300, b"n%d" % k, b"c" if k < size else b"d%d" % (k % 7), k < size, size) for k in range(size + 300)]
        rows += [(2, 5, b"m%d" % k, b"c" if k < 3 else b"d", k < 3, 3) for k in range(5)]
        df = spark.createDataFrame(rows, "bucket long, m long, node binary, comp binary, crowd boolean, size long")
        groups = {}
        for r in near_dedup.dealt_blocks(df).collect():
            groups.setdefault((r.bucket, min(r.block, r.other), max(r.block, r.other)), []).append((bytes(r.node), bytes(r.comp), r.block))
        assert {k for k in groups if k[0] == 2} == {(2, 0, 0)} and len(groups[2, 0, 0]) == 5
        met = [frozenset((a, b)) for (_, i, j), own in groups.items() for k, (a, x, p) in enumerate(own) for b, y, q in own[:k] if x != y and (i == j or p != q)]
        crowded = size * 300 + sum(1 for k in range(300) for o in range(k) if (size + k) % 7 != (size + o) % 7) + 6
        assert len(met) == len(set(met)) == crowded
        made[size] = sum(map(len, groups.values()))
    assert made[4000] < 4.2 * made[1000]
