"""QUALIFY as a subquery and a filter; counts of scanned rows; files of a version."""

import pytest

from rivulet.functions.qualify import without_qualify
from rivulet.operators.meter import metered, number
from rivulet.plans.strategy import analyze_edge
from rivulet.sources.models import model, source
from rivulet.sources.warehouse import Warehouse

ROWS = [(1, "a", 5), (2, "a", 7), (3, "b", 1), (4, None, 2), (5, None, 3), (6, "b", 1)]
W = "row_number() over (partition by g order by v desc, id)"


@pytest.mark.parametrize(
    "sql, expected",
    [
        (f"select id, g from {{t}} qualify {W} = 1", [(2, "a"), (3, "b"), (5, None)]),
        (f"select id, {W} as rn from {{t}} where v > 1 QUALIFY rn = 2 order by id limit 5", [(1, 2), (4, 2)]),
        (f"select * from (select id from {{t}} -- inner\n qualify {W} = 1) as x where id <> 3", [(2,), (5,)]),
        ("select distinct v from {t} qualify count(*) over (partition by v) > 1", [(1,)]),
        ("select g, sum(v) as s from {t} group by g qualify rank() over (order by sum(v) desc) = 1", [("a", 12)]),
        (f"with c as (select id, g from {{t}} qualify {W} = 1) select id from c union all select id from {{t}} qualify {W} = 2", [(2,), (3,), (5,), (1,), (6,), (4,)]),
        ("select 'qualify' as qualify from {t} where id = 1", [("qualify",)]),
    ],
)
def test_qualify(spark, sql, expected):
    t = spark.createDataFrame(ROWS, "id int, g string, v int")
    assert sorted(map(tuple, spark.sql(without_qualify(sql), t=t).collect()), key=str) == sorted(expected, key=str)


def test_query_without_qualify_is_untouched():
    sql = "select a -- qualify is only named here\nfrom t"
    assert without_qualify(sql) == sql


def test_edge_of_a_qualified_model_is_keyed(spark):
    t = spark.createDataFrame(ROWS, "id int, g string, v int")
    m = model("m", f"select id, g, v from {{t}} qualify {W} = 1", "v")
    assert analyze_edge(spark, m, source("t", "v"), {"t": t.schema}).kind == "keyed"


def test_scanned_rows_are_counted(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    with metered(spark) as work:
        spark.read.parquet(str(tmp_path / "t")).selectExpr("sum(id)").collect()
    assert work.rows == 100 and work.statements == 1
    assert number("total (min, med, max)\n1,234 (1, 2, 3)") == 1234


def test_a_partition_is_one_file_while_small(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    df = spark.range(0, 400, 1, 8).selectExpr("id", "id % 5 as p")
    store.put("t", df.schema, store.write("t", df, "p"))
    assert len(list((tmp_path / "t").glob("*/*/*.parquet"))) == 5
    assert sorted(store.read("t").collect()) == sorted(df.collect())
