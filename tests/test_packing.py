import duckdb
import pytest

from millrace.operators import packing
from millrace.plans import catalog


@pytest.mark.parametrize("prices", [(150050.00, 149949.00), (150149.00, 149950.00), (299950.00, 50.00), (299850.00, 150.00), (300051.00, 10.00)])
def test_gap_packing_sizes_as_in_sql(spark, tmp_path, prices):
    """Sizes that a fraction of a hundred brings over the budget, or not: the SQL's cast rounds, half to even."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT unnest([1, 2]) AS o_orderkey, 7 AS o_custkey, unnest([{prices[0]}, {prices[1]}]::DOUBLE[]) AS o_totalprice")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    got = {(r.k, r.o, r.batch) for r in catalog.QUERIES["gap_packing"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.ORACLES["gap_packing"]).fetchall())


def test_pack_ties_do_not_depend_on_the_order_of_rows(spark):
    """Rows of one key and order are packed the same however they lie."""
    rows = [(1, 1, s) for s in (2900, 50, 60, 2950, 100)]
    made = set()
    for own in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(own, "k long, o long, size long").coalesce(1)
        made.add(tuple(sorted(r.batch for r in packing.pack(df, "k", "o", "size").collect())))
    assert len(made) == 1
