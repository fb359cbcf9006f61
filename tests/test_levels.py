"""Factors of many levels: these and the names of columns stay in tables."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import designloom as dl
from designloom.functions.levels import Levels, Names
from designloom.operators import fit
from designloom.plans import behaviour, queries


@pytest.fixture
def in_tables(monkeypatch):
    monkeypatch.setattr(fit, "FEW_LEVELS", 0)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i % 12 - 3, [2.5, -0.5, 1e20, None, 1e-7][i % 5], [None, "x", "é]:", "a", "B", "😀"][i % 6], bytes([i % 4 + 250]), dt.date(2020, 1 + i % 3, 1), dt.datetime(2021, 3, 1 + i % 4, 5), float(i)) for i in range(120)]
    return spark.createDataFrame(rows, "k int, d double, s string, b binary, day date, at timestamp, x double").repartition(5)


FORMULAS = [
    "~ C(k)*s + C(k):x", "0 + C(d) + b", "~ day + at:b", "C(k, Treatment(-1)) + C(s, Treatment('a'))", "0 + C(k, Sum) + C(d, Treatment(2))",
]


@pytest.mark.parametrize("action", [dl.NAAction(), dl.NAAction(NA_types=[])])
@pytest.mark.parametrize("text", FORMULAS)
def test_tables_say_what_lists_say(spark, mixed, monkeypatch, text, action):
    listed = dl.dmatrix(text, mixed, dl.Env(), action, keep=["x"])
    monkeypatch.setattr(fit, "FEW_LEVELS", 0)
    found = dl.dmatrix(text, mixed, dl.Env(), action, keep=["x"])
    names = listed.design_info.column_names
    info = found.design_info
    assert isinstance(info.column_names, Names) and list(info.column_names) == names and len(info.column_names) == len(names)
    assert info.column_names == names and [info.column_names[i] for i in (0, -1)] == [names[0], names[-1]]
    assert [tuple(r) for r in info.names_table(spark).orderBy("i").collect()] == list(enumerate(names))
    assert [info.column_names.index(n) for n in names[::-9]] == [*range(len(names))][::-9]
    assert "no such name" not in info.column_names and "C(k)[07]" not in info.column_names
    assert info.term_name_slices == listed.design_info.term_name_slices
    wanted = sorted(map(repr, listed.df.collect()))
    assert sorted(map(repr, found.select("x", *names).collect())) == wanted == sorted(map(repr, found.df.collect()))
    few = names[::-7]
    assert sorted(map(repr, found.select(*few).collect())) == sorted(map(repr, listed.select(*few).collect()))
    last = info.term_names[-1]
    assert info.subset([last]).column_names == listed.design_info.subset([last]).column_names


def test_many_columns_are_planned_when_asked_for(spark):
    """20,000 columns took minutes to plan, for two of them."""
    data = spark.range(20_000).withColumn("x", F.col("id") * 0.5)
    design = dl.dmatrix("0 + C(id) + C(id):x", data, dl.Env(), keep=["x"])
    assert len(design.design_info.column_names) == 40_000
    found = design.select("x", "C(id)[19999]", "C(id)[7]:x")
    rows = [tuple(r) for r in found.where("`C(id)[19999]` > 0 OR `C(id)[7]:x` > 0").orderBy("x").collect()]
    assert rows == [(3.5, 0.0, 3.5), (9999.5, 1.0, 0.0)]
    assert found.count() == 20_000
    with pytest.raises(dl.FormulaError, match="unknown column"):
        design.select("C(id)[20000]")


def test_more_than_a_million_levels(spark):
    """These were refused."""
    n = 1_000_100
    names = dl.incr_dbuilder("0 + C(id)", spark.range(0, n, 1, 7), dl.Env()).names_table(spark)
    assert names.count() == n
    assert names.where("column_name <> concat('C(id)[', i, ']')").count() == 0
    assert names.agg(F.count_distinct("i"), F.min("i"), F.max("i")).first()[:] == (n, 0, n - 1)


def test_looked_up_levels_equal_their_sql(spark):
    """The query has no columns to look up in the smallest tables."""
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{at}/lineitem.parquet'")
    wanted = db.execute(queries.ORACLE_SQL["q_looked_up_levels"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["q_looked_up_levels"](spark, at).collect())) == sorted(wanted)


def test_a_level_that_was_not_there(spark, in_tables):
    info = dl.incr_dbuilder("0 + C(k)", spark.createDataFrame([(1,), (2,)], "k int"), dl.Env())
    with pytest.raises(Exception, match="observation with value 3.0 does not match any of the expected levels"):
        dl.build_design_matrices([info], spark.createDataFrame([(3,)], "k int")).collect()


@pytest.mark.parametrize("rows", [[("None",), (None,)], [("None",), (None,), ("x",)]])
def test_names_must_differ(spark, in_tables, rows):
    with pytest.raises(dl.FormulaError, match="duplicate column name"):
        dl.incr_dbuilder("0 + s", spark.createDataFrame(rows, "s string"), dl.Env(), dl.NAAction(NA_types=[]))


def test_names_of_numbers_must_differ_between_columns(spark, monkeypatch):
    data = spark.createDataFrame([(1, 5.0), (2, 6.0)], ["C(k)[1]", "k"]).withColumn("k", F.col("k").cast("int"))
    same = dl.Term([dl.LookupFactor("C(k)[5]")])
    data = data.withColumn("C(k)[5]", F.lit(1.0))
    monkeypatch.setattr(fit, "FEW_LEVELS", 0)
    with pytest.raises(dl.FormulaError, match="duplicate column name"):
        dl.design_matrix_builders([[dl.Term([dl.EvalFactor("C(k)")]), same]], data, dl.Env())


def test_no_levels(spark, in_tables):
    with pytest.raises(dl.FormulaError, match="No levels found"):
        dl.incr_dbuilder("0 + s", spark.createDataFrame([(None,)], "s string").where("s = 'a'"), dl.Env())


def test_rules_of_the_user(spark, monkeypatch):
    data = spark.range(40).selectExpr("id AS o_orderkey", "substr('OPF', int(id % 3) + 1, 1) AS o_orderstatus", "id AS n")
    wanted = dl.dmatrix("0 + C(o_orderkey) + o_orderstatus", data, dl.Env(), behaviour._NoFives())
    monkeypatch.setattr(fit, "FEW_LEVELS", 0)
    found = dl.dmatrix("0 + C(o_orderkey) + o_orderstatus", data, dl.Env(), behaviour._NoFives())
    assert found.design_info.column_names == wanted.design_info.column_names
    assert sorted(found.df.collect()) == sorted(wanted.df.collect())


def test_designs_are_written_streamed_and_constrained(spark, in_tables, tmp_path):
    from designloom.streaming.transform import transform_stream, write_available

    data = spark.range(30).selectExpr("cast(id % 10 as int) as k", "id * 1.0 as x")
    info = dl.incr_dbuilder("~ C(k) + x", data, dl.Env())
    assert isinstance(next(i for i in info.factor_infos.values() if i.kind == "categorical").categories, Levels)
    again = dl.DesignInfo.from_json(info.to_json())
    wanted = sorted(map(tuple, dl.build_design_matrices([info], data).collect()))
    assert again.column_names == list(info.column_names)
    assert sorted(map(tuple, dl.build_design_matrices([again], data).collect())) == wanted
    np.testing.assert_array_equal(info.linear_constraint("C(k)[T.3] = x").coefs, again.linear_constraint("C(k)[T.3] = x").coefs)
    data.write.parquet(str(tmp_path / "in"))
    stream = transform_stream([info], spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
    write_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == wanted


def test_tables_too_large_to_broadcast(spark, in_tables, monkeypatch):
    from designloom.plans import design

    data = spark.range(100).selectExpr("nullif(id % 10, 3) as k", "if(id % 4 = 0, null, concat('s', id % 4)) as s")
    wanted = sorted(map(repr, dl.dmatrix("0 + C(k) + s", data, dl.Env(), dl.NAAction(NA_types=[])).df.collect()))
    monkeypatch.setattr(design, "BROADCAST_LEVELS", 0)
    monkeypatch.setattr(design, "CASED", 0)
    assert sorted(map(repr, dl.dmatrix("0 + C(k) + s", data, dl.Env(), dl.NAAction(NA_types=[])).df.collect())) == wanted
