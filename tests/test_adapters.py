"""Adapter tables on rows of the tests' own: same rows as the templates, made only when asked for."""

import datetime

import pytest

from parcelweave.plans import adapters, catalog
from parcelweave.plans.adapters import Adapted

DAY = datetime.datetime(2020, 1, 1)


def line(order, number, part, supplier, price=1000.0, day=0, discount=0.1):
    return (order, part, supplier, number, 20.0, price, discount, 0.0, DAY + datetime.timedelta(days=day))


@pytest.fixture
def folder(spark, tmp_path):
    """Two copies of a part, an unknown part, an unknown supplier, missing keys and several records of one id."""
    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "FRANCE", 0), (1, "PERU", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "part": ([(i, f"name{i % 2}", f"B{i}", "T", 5, 1.0) for i in (1, 2, 3, 3, 4)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, "s", 0, 0.0), (2, "s", 1, 0.0), (3, "s", 9, 0.0), (3, "s", 9, 0.0)],
                     "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "customer": ([(i, f"C{i}", 0, 0.0, "M") for i in (1, 2, 3)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(1, 1, "O", 10.0, DAY, "1")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "events": ([(1, DAY, 1, "view", 1.0, "{}")],
                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "lineitem": ([
            line(1, 1, 1, 1), line(1, 1, 2, 2, day=3), line(1, 1, 99, 1, day=9), line(1, 1, 1, 3, day=9),
            line(1, 1, None, 1, day=9), line(2, 1, 3, 1), line(2, 1, 3, 1), line(2, 2, 3, 2, price=5.0),
            line(None, 1, 1, 1), line(None, 2, 4, 2, day=1), line(7, None, 4, 2, day=1, price=None), line(11, 1, 4, 1),
            line(12, 1, 4, 1, day=2), line(12, 1, 4, 1, day=2, price=7.0), line(13, 1, 98, 1)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_parcels_are_the_template_rows_without_a_written_staging_table(spark, folder):
    made, plain = Adapted(spark, folder), Adapted(spark, folder)
    got = made.raw("parcels")
    want = spark.sql(adapters.PARCELS, parcels_staging=plain.raw("parcels_staging"))
    assert got.dtypes == want.dtypes
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got) == rows(want)
    assert len(rows(got)) == 6
    assert "parcels_staging" not in made._tables


def test_tables_are_made_when_asked_for(spark, folder):
    made = Adapted(spark, folder)
    catalog.contact_waterfall(made).collect()
    assert set(made._tables) == {"entities"}
    assert sorted(made.tables()) == sorted(adapters.LazyTables({}) | dict.fromkeys(
        ["parcels", "roads", "entities", "entity_aliases", "beneficial_owners", "contacts", "query_log"]))


def test_parcels_are_ranked_on_numbers(spark, folder):
    ranked = Adapted(spark, folder)._parcels()._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_l_orderkey" in ranked and "windowspecdefinition(parcel_id" not in ranked
