"""Registered queries of the formula engine, and the SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designloom.api import dmatrices, dmatrix, incr_dbuilder
from designloom.functions.compile import Env
from designloom.operators.fit import design_matrix_builders
from designloom.plans.algebra import LookupFactor, Term
from designloom.plans.design import build_design_matrices
from designloom.sources.generators import balanced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ENV = Env({"np": np})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, sql: str | None, fn: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = sql


def plain(names: list[str]) -> list[str]:
    """Column names without punctuation, for SQL: c0, c1, ..."""
    return [f"c{i}" for i in range(len(names))]


def formula(name: str, source: str, text: str, columns: list[str], *, where: str = "", digits: int | None = None, expect: list[str] | None = None, **options: object) -> None:
    """Register a one-sided formula; ``columns`` are SQL expressions, in order; ``expect`` pins the column names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        design = dmatrix(text, table(spark, sf_dir, source), ENV, **options)
        names = design.design_info.column_names
        if expect is not None and names != expect:
            raise AssertionError(f"{name}: columns {names}, expected {expect}")
        out = [F.col("`" + n + "`") for n in names]
        out = [F.round(c, digits) + 0.0 if digits is not None else c for c in out]
        return design.df.select(*[c.alias(a) for c, a in zip(out, plain(names), strict=True)])

    shown = [f"round({c}, {digits}) + 0.0" if digits is not None else c for c in columns]
    sql = f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS c{i}' for i, c in enumerate(shown))} FROM {source} {where}"
    _register(name, sql, run)


def flag(column: str, value: object) -> str:
    shown = f"'{value}'" if isinstance(value, str) else str(value)
    return f"CASE WHEN {column} = {shown} THEN 1.0 ELSE 0.0 END"


def weights(column: str, levels: list, values: list[float]) -> str:
    cases = " ".join(f"WHEN {column} = '{level}' THEN {v!r}::DOUBLE" for level, v in zip(levels, values, strict=True))
    return f"CASE {cases} END"


FLAGS, STATUS, PRIORITIES = ["A", "N", "R"], ["F", "O"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
fl = lambda v: flag("l_returnflag", v)
st = lambda v: flag("l_linestatus", v)

formula("q_numeric", "lineitem", "0 + l_quantity + l_tax", ["l_quantity", "l_tax"])
formula("q_intercept_only", "orders", "~ 1", ["1.0"], expect=["Intercept"])
formula("q_treatment", "lineitem", "~ l_returnflag", ["1.0", fl("N"), fl("R")], expect=["Intercept", "l_returnflag[T.N]", "l_returnflag[T.R]"])
formula("q_full_rank", "lineitem", "0 + l_returnflag", [fl(v) for v in FLAGS])
formula("q_treatment_ref", "lineitem", "~ C(l_returnflag, Treatment('R'))", ["1.0", fl("A"), fl("N")])
formula("q_levels", "orders", "~ C(o_orderstatus, levels=['P', 'O', 'F'])", ["1.0", flag("o_orderstatus", "O"), flag("o_orderstatus", "F")])
formula("q_int_categorical", "lineitem", "0 + C(l_linenumber)", [flag("l_linenumber", i) for i in range(1, 8)], expect=[f"C(l_linenumber)[{i}]" for i in range(1, 8)])
formula("q_bool", "lineitem", "0 + I(l_quantity > 25)", ["CASE WHEN l_quantity > 25 THEN 0.0 ELSE 1.0 END", "CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END"], expect=["I(l_quantity > 25)[False]", "I(l_quantity > 25)[True]"])
_omit = [[1, 0, 0, 0, -1], [0, 1, 0, 0, -1], [0, 0, 1, 0, -1], [0, 0, 0, 1, -1]]
formula("q_sum", "orders", "~ C(o_orderpriority, Sum)", ["1.0", *(weights("o_orderpriority", PRIORITIES, [float(x) for x in w]) for w in _omit)])
_helmert = [[-1, 1, 0, 0, 0], [-1, -1, 2, 0, 0], [-1, -1, -1, 3, 0], [-1, -1, -1, -1, 4]]
formula("q_helmert", "orders", "~ C(o_orderpriority, Helmert)", ["1.0", *(weights("o_orderpriority", PRIORITIES, [float(x) for x in w]) for w in _helmert)])
_diff = [[-0.8, 0.2, 0.2, 0.2, 0.2], [-0.6, -0.6, 0.4, 0.4, 0.4], [-0.4, -0.4, -0.4, 0.6, 0.6], [-0.2, -0.2, -0.2, -0.2, 0.8]]
formula("q_diff", "orders", "~ C(o_orderpriority, Diff)", ["1.0", *(weights("o_orderpriority", PRIORITIES, w) for w in _diff)], digits=9)
# Orthogonal polynomials over five equal steps, as whole numbers, and the sums of their squares.
_poly = [([-2, -1, 0, 1, 2], 10), ([2, -1, -2, -1, 2], 14), ([-1, 2, 0, -2, 1], 10), ([1, -4, 6, -4, 1], 70)]
formula("q_poly", "orders", "~ C(o_orderpriority, Poly)", ["1.0", *(f"({weights('o_orderpriority', PRIORITIES, [float(x) for x in w])}) / sqrt({n})" for w, n in _poly)], digits=9)
formula("q_custom", "orders", "0 + C(o_orderstatus, [[7, 12], [2, 13], [8, -1]])", [weights("o_orderstatus", ["F", "O", "P"], w) for w in ([7.0, 2.0, 8.0], [12.0, 13.0, -1.0])], expect=["C(o_orderstatus, [[7, 12], [2, 13], [8, -1]])[custom0]", "C(o_orderstatus, [[7, 12], [2, 13], [8, -1]])[custom1]"])
formula("q_interact_cc", "lineitem", "~ l_returnflag*l_linestatus", ["1.0", fl("N"), fl("R"), st("O"), f"({fl('N')}) * ({st('O')})", f"({fl('R')}) * ({st('O')})"])
formula(
    "q_interact_redundant", "lineitem", "~ l_returnflag:l_linestatus", ["1.0", st("O"), *(f"({fl(f)}) * ({st(s)})" for s in STATUS for f in FLAGS[1:])],
    expect=["Intercept", "l_linestatus[T.O]", "l_returnflag[T.N]:l_linestatus[F]", "l_returnflag[T.R]:l_linestatus[F]", "l_returnflag[T.N]:l_linestatus[O]", "l_returnflag[T.R]:l_linestatus[O]"],
)
formula("q_interact_cn", "lineitem", "0 + l_returnflag:l_quantity", [f"({fl(f)}) * l_quantity" for f in FLAGS])
formula("q_nested", "lineitem", "~ l_returnflag/l_linestatus", ["1.0", fl("N"), fl("R"), *(f"({fl(f)}) * ({st('O')})" for f in FLAGS)])
formula("q_power", "lineitem", "~ (l_quantity + l_tax + l_discount)**2", ["1.0", "l_quantity", "l_tax", "l_discount", "l_quantity * l_tax", "l_quantity * l_discount", "l_tax * l_discount"], digits=9)
formula("q_minus", "lineitem", "~ l_returnflag*l_linestatus - l_returnflag", ["1.0", st("O"), *(f"({fl(f)}) * ({st(s)})" for s in STATUS for f in FLAGS[1:])])
formula("q_math", "lineitem", "0 + np.log(l_extendedprice) + I(l_quantity**2) + np.sqrt(l_tax)", ["ln(l_extendedprice)", "l_quantity * l_quantity", "sqrt(l_tax)"], digits=9)
formula("q_shims", "part", "0 + I(p_size // 7) + I(-p_size % 7) + np.maximum(p_size, 25) + np.abs(p_size - 25)", ["floor(p_size / 7.0)", "((-p_size % 7) + 7) % 7", "greatest(p_size, 25)", "abs(p_size - 25)"])
formula("q_quote", "events", "0 + Q('value')", ["value"])
formula("q_center", "lineitem", "0 + center(l_quantity)", ["l_quantity - (SELECT avg(l_quantity) FROM lineitem)"])
formula("q_standardize", "lineitem", "0 + standardize(l_quantity)", ["(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem)"], digits=9)
formula("q_standardize_ddof1", "lineitem", "0 + standardize(l_quantity, ddof=1)", ["(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem)"], digits=9)
formula("q_scale_nocenter", "lineitem", "0 + scale(l_quantity, center=False)", ["l_quantity / (SELECT stddev_pop(l_quantity) FROM lineitem)"], digits=9)
_z = "pow((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 2)"
formula("q_nested_stateful", "part", "0 + center(np.sqrt(standardize(p_size)**2))", [f"sqrt({_z}) - (SELECT avg(sqrt({_z})) FROM part)"], digits=9)
formula("q_na_drop", "lineitem", "0 + I(np.where(l_linenumber == 3, np.nan, l_linenumber)) + l_quantity", ["l_linenumber", "l_quantity"], where="WHERE l_linenumber <> 3")
formula("q_array_factor", "embeddings", "0 + embedding", [f"embedding[{i + 1}]" for i in range(64)], expect=[f"embedding[{i}]" for i in range(64)])
formula("q_bs0", "lineitem", "0 + bs(l_quantity, knots=[10, 25], degree=0, include_intercept=True, lower_bound=0, upper_bound=50)", ["CASE WHEN l_quantity < 10 THEN 1.0 ELSE 0.0 END", "CASE WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1.0 ELSE 0.0 END", "CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END"])
formula(
    "q_bs1", "lineitem", "0 + bs(l_quantity, knots=[20], degree=1, include_intercept=True, lower_bound=0, upper_bound=50)",
    ["greatest(0, (20 - l_quantity) / 20.0)", "CASE WHEN l_quantity < 20 THEN l_quantity / 20.0 ELSE (50 - l_quantity) / 30.0 END", "greatest(0, (l_quantity - 20) / 30.0)"], digits=9,
)
_u = "(l_quantity / 50.0)"
formula("q_bs3", "lineitem", "0 + bs(l_quantity, knots=[], degree=3, include_intercept=True, lower_bound=0, upper_bound=50)", [f"pow(1 - {_u}, 3)", f"3 * {_u} * pow(1 - {_u}, 2)", f"3 * pow({_u}, 2) * (1 - {_u})", f"pow({_u}, 3)"], digits=9)


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "part")
    (design,) = design_matrix_builders([[Term([LookupFactor("p_size")])]], data, ENV)
    return build_design_matrices([design], data)


_register("q_lookup", "SELECT CAST(p_size AS DOUBLE) AS p_size FROM part", _lookup)


def _predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "lineitem")
    design = incr_dbuilder("0 + center(l_quantity)", data.where("l_linestatus = 'F'"), ENV)
    return build_design_matrices([design], data.where("l_linestatus = 'O'")).toDF("c0")


_register("q_predict", "SELECT l_quantity - (SELECT avg(l_quantity) FROM lineitem WHERE l_linestatus = 'F') AS c0 FROM lineitem WHERE l_linestatus = 'O'", _predict)


def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "lineitem")
    design = incr_dbuilder("~ l_returnflag + l_quantity + l_tax", data, ENV)
    return build_design_matrices([design.subset("0 + l_quantity")], data.select("l_quantity"))


_register("q_subset", "SELECT l_quantity FROM lineitem", _subset)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = dmatrices("l_extendedprice ~ l_quantity + l_returnflag", table(spark, sf_dir, "lineitem"), ENV)
    return left.df.toDF("y0", "x0", "x1", "x2", "x3")


_register("q_dmatrices", f"SELECT l_extendedprice AS y0, 1.0::DOUBLE AS x0, ({fl('N')})::DOUBLE AS x1, ({fl('R')})::DOUBLE AS x2, l_quantity AS x3 FROM lineitem", _both)


def _knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = incr_dbuilder("0 + bs(l_quantity, df=6)", table(spark, sf_dir, "lineitem"), ENV)
    (info,) = design.factor_infos.values()
    (state,) = info.states.values()
    return spark.createDataFrame([(i, float(k)) for i, k in enumerate(state.learned["inner"])], "i int, knot double")


_register("q_bs_quantile", " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(l_quantity, {(i + 1) / 4}) AS knot FROM lineitem" for i in range(3)), _knots)


# Cubic splines of three knots in closed form. Natural: only the middle knot bends, by the jump of slopes; cyclic: both knots do, in opposite ways.


def natural_cubic(x: str, k0: float, k1: float, k2: float) -> list[str]:
    h, g = k1 - k0, k2 - k1
    bend = [3 / (h * (h + g)), -3 * (1 / h + 1 / g) / (h + g), 3 / (g * (h + g))]
    left = [f"({k1} - {x}) / {h!r}", f"({x} - {k0}) / {h!r}", "0.0"]
    right = ["0.0", f"({k2} - {x}) / {g!r}", f"({x} - {k1}) / {g!r}"]
    up, down = f"(pow({x} - {k0}, 3) / {6 * h!r} - {h!r} * ({x} - {k0}) / 6)", f"(pow({k2} - {x}, 3) / {6 * g!r} - {g!r} * ({k2} - {x}) / 6)"
    return [f"(CASE WHEN {x} <= {k1} THEN {a} + {m!r}::DOUBLE * {up} ELSE {b} + {m!r}::DOUBLE * {down} END)" for a, b, m in zip(left, right, bend, strict=True)]


def cyclic_cubic(x: str, k0: float, k1: float, k2: float) -> list[str]:
    h, g = k1 - k0, k2 - k1
    bend = 6 * (1 / h + 1 / g) / (h + g)
    out = []
    for first, (a, b) in ((1, (f"({k1} - {x}) / {h!r}", f"({x} - {k1}) / {g!r}")), (-1, (f"({x} - {k0}) / {h!r}", f"({k2} - {x}) / {g!r}"))):
        m = first * bend
        near, far = f"(pow({k1} - {x}, 3) / {6 * h!r} - {h!r} * ({k1} - {x}) / 6)", f"(pow({x} - {k0}, 3) / {6 * h!r} - {h!r} * ({x} - {k0}) / 6)"
        near2, far2 = f"(pow({k2} - {x}, 3) / {6 * g!r} - {g!r} * ({k2} - {x}) / 6)", f"(pow({x} - {k1}, 3) / {6 * g!r} - {g!r} * ({x} - {k1}) / 6)"
        out.append(f"(CASE WHEN {x} <= {k1} THEN {a} - {m!r}::DOUBLE * {near} + {m!r}::DOUBLE * {far} ELSE {b} + {m!r}::DOUBLE * {near2} - {m!r}::DOUBLE * {far2} END)")
    return out


_CR, _CC = natural_cubic("l_quantity", 0.0, 20.0, 50.0), cyclic_cubic("l_discount", 0.0, 0.04, 0.1)
formula("q_cr", "lineitem", "0 + cr(l_quantity, knots=[20], lower_bound=0, upper_bound=50)", _CR, digits=9)
formula("q_cc", "lineitem", "0 + cc(l_discount, knots=[0.04], lower_bound=0, upper_bound=0.1)", _CC, digits=9)
formula("q_te", "lineitem", "0 + te(cr(l_quantity, knots=[20], lower_bound=0, upper_bound=50), cc(l_discount, knots=[0.04], lower_bound=0, upper_bound=0.1))", [f"{a} * {b}" for a in _CR for b in _CC], digits=11)


def _centred_sql() -> str:
    """The basis less its part along its means: the last columns of the reflection that turns the means into the first axis."""
    w = ["m0 + sqrt(m0 * m0 + m1 * m1 + m2 * m2)", "m1", "m2"]
    along = " + ".join(f"b{i} * ({w[i]})" for i in range(3))
    square = " + ".join(f"pow({x}, 2)" for x in w)
    basis = ", ".join(f"{c} AS b{i}" for i, c in enumerate(_CR))
    columns = ", ".join(f"round(b{i} - 2 * ({w[i]}) * ({along}) / ({square}), 9) + 0.0 AS c{i - 1}" for i in (1, 2))
    return f"WITH b AS (SELECT {basis} FROM lineitem), m AS (SELECT avg(b0) AS m0, avg(b1) AS m1, avg(b2) AS m2 FROM b) SELECT {columns} FROM b, m"


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = dmatrix("0 + cr(l_quantity, knots=[20], lower_bound=0, upper_bound=50, constraints='center')", table(spark, sf_dir, "lineitem"), ENV)
    return design.df.toDF("c0", "c1").select(*[(F.round(c, 9) + 0.0).alias(c) for c in ("c0", "c1")])


_register("q_cr_centered", _centred_sql(), _centred)


def bspline_sql(x: str, knots: list[str], last: int, i: int, degree: int) -> str:
    """Column ``i`` of a B-spline basis by the recursion on its degree; equal names are equal knots, and ``last`` is the last interval that is not empty."""
    if not degree:
        end = "<=" if i == last else "<"
        return "0.0" if knots[i] == knots[i + 1] else f"(CASE WHEN {x} >= {knots[i]} AND {x} {end} {knots[i + 1]} THEN 1.0 ELSE 0.0 END)"
    parts = []
    if knots[i] != knots[i + degree]:
        parts.append(f"({x} - {knots[i]}) / ({knots[i + degree]} - {knots[i]}) * {bspline_sql(x, knots, last, i, degree - 1)}")
    if knots[i + 1] != knots[i + degree + 1]:
        parts.append(f"({knots[i + degree + 1]} - {x}) / ({knots[i + degree + 1]} - {knots[i + 1]}) * {bspline_sql(x, knots, last, i + 1, degree - 1)}")
    return f"({' + '.join(parts) or '0.0'})"


def _gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = dmatrix("~ l_linestatus + l_quantity", table(spark, sf_dir, "lineitem"), ENV)
    x = design.df.toDF("x0", "x1", "x2")
    return x.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)])


_register("q_gram", f"WITH x AS (SELECT 1.0::DOUBLE AS x0, ({st('O')})::DOUBLE AS x1, l_quantity AS x2 FROM lineitem) SELECT " + ", ".join(f"sum(x{i} * x{j}) AS g{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM x", _gram)


def _constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = dmatrix("0 + l_quantity + l_linenumber", table(spark, sf_dir, "lineitem"), ENV)
    found = design.design_info.linear_constraint("2 * l_quantity - l_linenumber = 3, l_linenumber = 1")
    return design.df.select(*[c.alias(f"r{i}") for i, c in enumerate(found.residuals())])


_register("q_constraint", "SELECT 2 * l_quantity - l_linenumber - 3 AS r0, (l_linenumber - 1)::DOUBLE AS r1 FROM lineitem", _constraint)
_register("q_balanced", "SELECT 'a' || a AS a, 'b' || b AS b FROM range(1, 4) x(a), range(1, 3) y(b), range(2) z(r)", lambda spark, sf_dir: balanced(spark, a=3, b=2, repeat=2))


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = incr_dbuilder("~ l_linestatus + l_quantity", table(spark, sf_dir, "lineitem"), ENV)
    rows = [(i, name, term) for term, s in design.term_name_slices.items() for i, name in list(enumerate(design.column_names))[s]]
    return spark.createDataFrame(rows, "i int, column_name string, term string")


_register("q_design_info", "SELECT * FROM (VALUES (0, 'Intercept', 'Intercept'), (1, 'l_linestatus[T.O]', 'l_linestatus'), (2, 'l_quantity', 'l_quantity')) t(i, column_name, term)", _info)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and predictors with coding, interaction, transform and spline, on lineitem."""
    left, _ = dmatrices("l_extendedprice ~ l_returnflag*l_linestatus + center(l_quantity) + bs(l_tax, df=5)", table(spark, sf_dir, "lineitem"), ENV)
    return left.df.toDF(*[f"c{i}" for i in range(len(left.df.columns))])


def _rounded_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flagship(spark, sf_dir)
    return found.select(*[(F.round(c, 9) + 0.0).alias(c) for c in found.columns])


_knots_of_tax = ["k.lo"] * 4 + ["k.a", "k.b"] + ["k.hi"] * 4
_flagship = [
    "l_extendedprice", "1.0", fl("N"), fl("R"), st("O"), f"({fl('N')}) * ({st('O')})", f"({fl('R')}) * ({st('O')})", "l_quantity - k.mean",
    *(bspline_sql("l_tax", _knots_of_tax, 5, i, 3) for i in range(1, 6)),
]
_register(
    "q_flagship",
    "WITH k AS (SELECT min(l_tax) AS lo, max(l_tax) AS hi, quantile_cont(l_tax, 1.0 / 3) AS a, quantile_cont(l_tax, 2.0 / 3) AS b, avg(l_quantity) AS mean FROM lineitem) SELECT "
    + ", ".join(f"round(CAST({c} AS DOUBLE), 9) + 0.0 AS c{i}" for i, c in enumerate(_flagship)) + " FROM lineitem, k",
    _rounded_flagship,
)
