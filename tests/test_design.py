"""Designs on Spark."""

import math

import numpy as np
import pytest

import designloom as dl
from designloom.functions.stateful import CubicSpline, CyclicSpline, bspline, cubic_basis, null_space

NUMPY = dl.Env({"np": np})


def values(design):
    return np.array([tuple(r) for r in design.df.collect()], dtype=float)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("a1", "b1", 1.0), ("a1", "b2", 2.0), ("a2", "b1", 3.0), ("a2", "b2", 5.0)], "a string, b string, x double").coalesce(1)


def test_names_and_values(small):
    design = dl.dmatrix("~ a*b + x", small)
    assert design.design_info.column_names == ["Intercept", "a[T.a2]", "b[T.b2]", "a[T.a2]:b[T.b2]", "x"]
    np.testing.assert_array_equal(values(design), [[1, 0, 0, 0, 1], [1, 0, 1, 0, 2], [1, 1, 0, 0, 3], [1, 1, 1, 1, 5]])
    assert design.design_info.term_name_slices["a:b"] == slice(3, 4)
    assert design.design_info.describe() == "1 + a + b + a:b + x"
    assert "Terms:" in repr(design)


def test_leftmost_factor_varies_fastest(small):
    assert dl.dmatrix("0 + a:b", small).design_info.column_names == ["a[a1]:b[b1]", "a[a2]:b[b1]", "a[a1]:b[b2]", "a[a2]:b[b2]"]


def test_nested_transforms_do_not_depend_on_partitions(spark):
    data = spark.range(100).selectExpr("cast(id as double) as x")
    wanted = None
    for parts in (1, 3, 17):
        design = dl.dmatrix("0 + center(np.sin(center(x)))", data.repartition(parts), NUMPY, keep=["x"])
        got = np.array(sorted(tuple(r) for r in design.df.collect()))
        wanted = got if wanted is None else wanted
        np.testing.assert_allclose(got, wanted, atol=1e-12)
    s = np.sin(np.arange(100) - 49.5)
    np.testing.assert_allclose(wanted[:, 1], s - s.mean(), atol=1e-12)


def test_prediction_keeps_what_was_learned(spark, small):
    info = dl.incr_dbuilder("0 + center(x) + a", small)
    again = dl.DesignInfo.from_json(info.to_json())
    new = spark.createDataFrame([("a2", 10.0)], "a string, x double")
    for design in (info, again, dl.dmatrix(info, new).design_info):
        assert dl.build_design_matrices([design], new).first()[:] == (7.25, 0.0, 1.0) or tuple(dl.build_design_matrices([design], new).first()) == (0.0, 1.0, 7.25)
    with pytest.raises(Exception, match="does not match any of the expected levels"):
        dl.build_design_matrices([info], spark.createDataFrame([("a9", 1.0)], "a string, x double")).collect()
    with pytest.raises(dl.FormulaError, match="outcome"):
        dl.dmatrix("x ~ a", small)


def test_missing_values(spark):
    data = spark.createDataFrame([(1.0, "c1", 5.0), (float("nan"), "c2", 6.0), (3.0, None, 7.0), (None, "c3", 8.0), (4.0, "c1", None)], "x double, c string, y double")
    left, right = dl.dmatrices("y ~ x + c", data)
    assert right.design_info.column_names == ["Intercept", "c[T.c2]", "c[T.c3]", "x"]
    assert [tuple(r) for r in left.df.collect()] == [(5.0, 1.0, 0.0, 0.0, 1.0)]
    with pytest.raises(Exception, match="factor contains missing values"):
        dl.dmatrix("x", data, NA_action="raise").df.collect()
    assert dl.dmatrix("0 + x", data, NA_action=dl.NAAction(NA_types=[])).df.count() == 5
    assert dl.dmatrix("0 + c", data, NA_action=dl.NAAction(NA_types=["NaN"])).design_info.column_names == ["c[None]", "c[c1]", "c[c2]", "c[c3]"]
    assert math.isnan(dl.incr_dbuilder("0 + center(x)", data).factor_infos[dl.EvalFactor("center(x)")].states["center(x)"].learned["means"][0])


def test_kinds(spark):
    data = spark.createDataFrame([(1, 1.5, True, "u", [1.0, 2.0]), (2, 2.5, True, "v", [3.0, 4.0])], "i int, d double, t boolean, s string, v array<double>")
    assert dl.dmatrix("0 + i + d + t + s + v + C(i)", data).design_info.column_names == ["t[False]", "t[True]", "s[T.v]", "C(i)[T.2]", "i", "d", "v[0]", "v[1]"]
    assert dl.dmatrix("0 + v:d", data).design_info.column_names == ["v[0]:d", "v[1]:d"]
    assert values(dl.dmatrix("0 + I(v[1] + 1)", data)).tolist() == [[3.0], [5.0]]
    with pytest.raises(dl.FormulaError):
        dl.dmatrix("0 + nothing", data)
    with pytest.raises(dl.FormulaError):
        dl.dmatrix("0 + np.log([i for i in x])", data, NUMPY)


def test_arithmetic_follows_numpy(spark):
    grid = [float(v) for v in (-7, -3.5, -1, 0, 1, 2.5, 7)] + [float("nan")]
    pairs = [(x, y) for x in grid for y in grid]
    data = spark.createDataFrame(pairs, "x double, y double").coalesce(1)
    x, y = np.array(pairs).T
    keep = dl.NAAction(NA_types=[])
    with np.errstate(all="ignore"):
        for code, wanted in [
            ("I(x / y)", x / y), ("I(x // y)", x // y), ("I(x % y)", x % y), ("np.log(x)", np.log(x)), ("np.sqrt(x)", np.sqrt(x)), ("np.maximum(x, y)", np.maximum(x, y)),
            ("np.floor(x)", np.floor(x)), ("np.ceil(x)", np.ceil(x)), ("np.sign(x)", np.sign(x)), ("np.log1p(x)", np.log1p(x)), ("np.where(x > y, x, y)", np.where(x > y, x, y)),
        ]:
            got = values(dl.dmatrix(f"0 + {code}", data, NUMPY, keep))[:, 0]
            np.testing.assert_allclose(got, wanted, rtol=1e-12, err_msg=code)


def test_functions_of_the_user(spark, small):
    def odd(x):
        return np.where(x > 2, 1.0, x)

    @dl.column_function
    def double(c):
        return c * 2

    with pytest.warns(UserWarning):
        assert values(dl.dmatrix("0 + odd(x)", small)).ravel().tolist() == [1.0, 2.0, 1.0, 1.0]
    assert values(dl.dmatrix("0 + double(x)", small)).ravel().tolist() == [2.0, 4.0, 6.0, 10.0]

    @dl.stateful_transform
    class Top:
        def __init__(self):
            self.top = -math.inf

        def memorize_chunk(self, x):
            self.top = max(self.top, float(np.max(x)))

        def memorize_finish(self):
            pass

        def transform(self, x):
            return x / self.top

    assert values(dl.dmatrix("0 + Top(x)", small)).ravel().tolist() == [0.2, 0.4, 0.6, 1.0]


def test_bspline_against_the_recursion(spark):
    x = 1.5 ** np.arange(20)
    data = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    for degree, df, intercept in [(1, 3, False), (3, 5, True), (3, 12, False), (5, 12, True)]:
        got = values(dl.dmatrix(f"0 + bs(x, df={df}, degree={degree}, include_intercept={intercept})", data))
        inner = np.quantile(x, np.linspace(0, 1, df - degree - 1 + (not intercept) + 2)[1:-1])
        knots = np.sort(np.concatenate([[x[0], np.nextafter(x[-1], np.inf)] * (degree + 1), inner]))
        wanted = bspline(x, knots, degree)[:, 0 if intercept else 1 :]
        np.testing.assert_allclose(got, wanted, atol=1e-9)
        assert got.shape[1] == df
    with pytest.raises(Exception, match="outside the outermost knots"):
        info = dl.incr_dbuilder("0 + bs(x, df=4)", data)
        dl.build_design_matrices([info], spark.createDataFrame([(9999.0,)], "x double")).collect()


def test_cubic_splines(spark):
    x = (-1.5) ** np.arange(20)
    data = spark.createDataFrame([(float(v), float(v) / 2) for v in x], "x double, z double").coalesce(1)
    for kind, cls in (("cr", CubicSpline), ("cc", CyclicSpline)):
        info = dl.incr_dbuilder(f"0 + {kind}(x, df=7)", data)
        (state,) = next(iter(info.factor_infos.values())).states.values()
        knots = np.array(state.learned["knots"])
        wanted = cubic_basis(x, knots, cls.cyclic)
        np.testing.assert_allclose(values(dl.dmatrix(info, data)), wanted, atol=1e-9)
        at_knots = cubic_basis(knots[: len(knots) - cls.cyclic], knots, cls.cyclic)
        np.testing.assert_allclose(at_knots, np.eye(len(at_knots)), atol=1e-10)
        centered = values(dl.dmatrix(f"0 + {kind}(x, df=6, constraints='center')", data))
        np.testing.assert_allclose(centered.sum(axis=0), 0, atol=1e-6)
        np.testing.assert_allclose(centered @ np.ones(6), wanted[:, :7] @ null_space([wanted.mean(axis=0)]) @ np.ones(6), atol=1e-7)
    te = values(dl.dmatrix("0 + te(cr(x, df=4), cr(z, df=3))", data))
    a, b = values(dl.dmatrix("0 + cr(x, df=4)", data)), values(dl.dmatrix("0 + cr(z, df=3)", data))
    np.testing.assert_allclose(te, np.einsum("ni,nj->nij", a, b).reshape(len(x), -1), rtol=1e-9, atol=1e-9)


def test_streams(spark, small, tmp_path):
    from designloom.streaming.transform import transform_stream, write_available

    small.write.parquet(str(tmp_path / "in"))
    info = dl.incr_dbuilder("~ a + center(x)", small)
    stream = transform_stream([info], spark.readStream.schema(small.schema).parquet(str(tmp_path / "in")))
    write_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, dl.build_design_matrices([info], small).collect()))


def test_a_transform_has_no_shuffle(small):
    design = dl.dmatrix("~ a*b + center(x)", small)
    assert "Exchange" not in design.df._jdf.queryExecution().executedPlan().toString()


def test_generators(spark):
    assert [tuple(r) for r in dl.balanced(spark, b=2, a=2, repeat=2).collect()][:5] == [("a1", "b1"), ("a1", "b2"), ("a2", "b1"), ("a2", "b2"), ("a1", "b1")]
    data = dl.demo_data(spark, "a", "b", "x", "y")
    assert data.count() == 8
    np.testing.assert_allclose(data.first()["x"], 1.76405235, atol=1e-8)
    with pytest.raises(dl.FormulaError):
        dl.demo_data(spark, "o")


def test_declared_levels_and_custom_factors(spark, small):
    from pyspark.sql import functions as F

    declared = small.withColumn("a", F.col("a").alias("a", metadata={"ml_attr": {"type": "nominal", "vals": ["a2", "a1", "a0"]}}))
    assert dl.dmatrix("0 + a", declared).design_info.column_names == ["a[a2]", "a[a1]", "a[a0]"]

    class Twice:
        def name(self):
            return "twice"

        def compile(self, compiler):
            from dataclasses import replace

            x = compiler.column("x")
            return replace(x, columns=(x.one * 2,))

    (info,) = dl.design_matrix_builders([[dl.Term([Twice()])]], small)
    assert [r[0] for r in dl.build_design_matrices([info], small).collect()] == [2.0, 4.0, 6.0, 10.0]


def test_passed_through_frames(small):
    assert dl.dmatrix(small.select("x")).design_info.column_names == ["x"]
    assert dl.DesignInfo.from_columns(["a", 1], "column").column_names == ["a", "column1"]
    assert "1 + a" in dl.incr_dbuilder("~ a", [small, small]).describe()
    assert dl.dmatrix("0 + x", small, return_type="dataframe").shape == (4, 1)


def test_subset_and_constraints(small):
    info = dl.incr_dbuilder("~ a + b + x", small)
    assert info.subset("0 + x").column_names == ["x"]
    assert info.subset(["b", "Intercept"]).column_names == ["b[T.b2]", "Intercept"]
    np.testing.assert_allclose(info.linear_constraint("a[T.a2] = x").coefs, [[0, 1, 0, -1]])
    with pytest.raises(dl.FormulaError):
        info.subset("0 + q")
