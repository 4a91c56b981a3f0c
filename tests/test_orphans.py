"""External projects that are used or not, with and without bundles."""

import shutil

import duckdb

from changelens import plans
from changelens.operators import incremental
from changelens.sources.graph import Bundles
from tests.conftest import SMALL

QUERY = "m04_orphaned_externals"


def test_orphaned_externals(spark):
    s = spark.createDataFrame([("a", "app"), ("x", "external:used"), ("y", "external:own"), ("z", "external:own"), ("w", "external:bundled")], "id string, project string")
    e = spark.createDataFrame([("a", "x"), ("y", "z"), ("x", "a")], "source_id string, target_id string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(incremental.orphaned_externals(s, e)) == ["external:bundled", "external:own"]
    side = lambda rows, c: spark.createDataFrame(rows, f"k int, {c} string")
    b = Bundles(side([(1, "a"), (2, "y")], "source_id"), side([(1, "w"), (2, "z")], "target_id"), ["k"])
    assert names(incremental.orphaned_externals(s, e, b)) == ["external:own"]


def test_query_sees_who_uses_externals(spark, tmp_path):
    """All edges count: with them no external project is an orphan, without those of the lines it is one."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path)
    duckdb.sql(f"copy (select * from '{SMALL}/lineitem.parquet' limit 0) to '{tmp_path}/lineitem.parquet'")
    for sf, want in ((SMALL, []), (str(tmp_path), ["external:AFRICA"])):
        got = [r[0] for r in plans.queries()[QUERY](spark, sf).collect()]
        c = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        assert got == want == [r[0] for r in c.execute(plans.oracle_sql()[QUERY]).fetchall()]
