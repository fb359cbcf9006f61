"""Registered queries on what the engine says and how it treats odd input, with the answers as SQL."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designloom.api import DesignMatrix, dmatrices, dmatrix, incr_dbuilder, incr_dbuilders, show
from designloom.functions.compile import Env, column_function, stateful_transform
from designloom.functions.contrasts import ContrastMatrix
from designloom.operators.fit import design_matrix_builders
from designloom.operators.missing import NAAction
from designloom.sources.generators import demo_data

from .algebra import Algebra, EvalFactor, LookupFactor, ModelDesc, Partial, Term
from .constraint import LinearConstraint, linear_constraint
from .design import DesignInfo, build_design_matrices
from .errors import FormulaError
from .grammar import Operator, parse_formula
from .queries import _register, table

#: Answers that the engine gives for a query, as (SQL type, values by row).
Rows = list[tuple]


def _values(names: str, rows: Rows) -> str:
    """SQL for literal rows."""

    def cell(v: object) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def answers(name: str, schema: str, wanted: Rows) -> Callable:
    """Register a function of (spark, sf_dir) whose rows are ``wanted``."""
    names = ", ".join(c.split()[0] for c in schema.split(", "))

    def register(fn: Callable[[SparkSession, str], Rows]) -> Callable:
        _register(name, _values(names, wanted), lambda spark, sf_dir: spark.createDataFrame(fn(spark, sf_dir), schema))
        return fn

    return register


def frame(name: str, sql: str) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _register(name, sql, fn)
        return fn

    return register


# The language.


def _sides(model: ModelDesc) -> tuple[str, str]:
    return tuple(" ".join(t.name() for t in side) for side in (model.lhs, model.rhs))


@answers(
    "q_algebra", "formula string, lhs string, rhs string, shown string",
    [
        ("y ~ +a", "y", "Intercept a", "y ~ a"), ("~ -1 + a", "", "a", "~ 0 + a"), ("~ a + -0", "", "Intercept a", "~ a"), ("1 + y ~ 0", "Intercept y", "", "1 + y ~ 0"),
        ("~ (a + b)**2 - b", "", "Intercept a a:b", "~ a + a:b"), ("~ a/(b + c)", "", "Intercept a a:b a:c", "~ a + a:b + a:c"), ("~ f(x , 2):a", "", "Intercept f(x, 2):a", "~ f(x, 2):a"),
    ],
)
def _algebra(spark: SparkSession, sf_dir: str) -> Rows:
    texts = ["y ~ +a", "~ -1 + a", "~ a + -0", "1 + y ~ 0", "~ (a + b)**2 - b", "~ a/(b + c)", "~ f(x , 2):a"]
    return [(t, *_sides(m := ModelDesc.from_formula(t)), m.describe()) for t in texts]


@frame("q_own_operator", "SELECT r_regionkey::DOUBLE AS c0 FROM region")
def _own_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator that keeps the first of its terms."""
    algebra, first = Algebra(), Operator("|", 2, 50)
    algebra.add_op(first, lambda self, node: Partial(self.side(node.args[0]).terms[:1], one=False))
    model = ModelDesc.from_formula(parse_formula("r_regionkey + r_name | 1", [first]), algebra)
    return dmatrix(model, table(spark, sf_dir, "region"), Env()).df.toDF("c0")


@answers(
    "q_errors", "formula string, begins int, ends int",
    [("a + b *", 6, 7), ("a + (b", 4, 5), ("a:1", 2, 3), ("a + 2", 4, 5), ("y ~ a ~ b", 0, 5), ("a ** b", 5, 6), ("C(r_name, Treatment('x'))", 0, 25), ("0 + no_such_name", 4, 16), ("0 + C(r_name):log(r_name)", 14, 25)],
)
def _errors(spark: SparkSession, sf_dir: str) -> Rows:
    """Where errors point, in formulas and in their evaluation."""
    region, out = table(spark, sf_dir, "region"), []
    for text in ["a + b *", "a + (b", "a:1", "a + 2", "y ~ a ~ b", "a ** b", "C(r_name, Treatment('x'))", "0 + no_such_name", "0 + C(r_name):log(r_name)"]:
        try:
            dmatrix(text, region, Env({"log": np.log}))
        except FormulaError as e:
            out.append((text, e.span.start, e.span.end) if e.span else (text, -1, -1))
    return out


@answers("q_environment", "what string, holds boolean", [("inner wins", True), ("outer is last", True), ("builtins are last", True), ("unknown", True), ("subset", True), ("equal copies", True), ("other value", False), ("captures locals", True), ("evaluates", True), ("future flags", True)])
def _environment(spark: SparkSession, sf_dir: str) -> Rows:
    a, b = object(), object()
    env, local = Env({"x": a, "z": 1}), 5
    try:
        env.find("no_such_name")
        unknown = False
    except NameError:
        unknown = True
    flagged = Env({}, flags=0x1000000)
    return [
        ("inner wins", Env({"x": a}).outer({"x": b}).find("x") is a), ("outer is last", Env({"x": a}).outer({"y": b}).find("y") is b), ("builtins are last", env.find("len") is len), ("unknown", unknown),
        ("subset", env.subset({"x", "nothing"}) == Env({"x": a})), ("equal copies", Env({"x": a}) == Env({"x": a})), ("other value", Env({"x": a}) == Env({"x": b})),
        ("captures locals", Env.capture().find("local") == local), ("evaluates", env.eval("z + y", {"y": 2}) == 3), ("future flags", flagged != Env({}) and flagged.subset(set()).flags == flagged.flags),
    ]


@answers("q_constraints", "what string, a double, b double, c double, constant double", [("chain", 1.0, -1.0, 0.0, 0.0), ("chain", 0.0, 1.0, 0.0, 3.0), ("mapping", 0.0, 0.0, 1.0, 4.0), ("mapping", 1.0, 0.0, 0.0, 5.0), ("pair", 1.0, 2.0, 3.0, 6.0), ("texts", 2.0, 0.0, 0.0, 7.0), ("texts", 0.0, 1.0, -0.5, 0.0)])
def _constraints(spark: SparkSession, sf_dir: str) -> Rows:
    names = ["a", "b", "c"]
    asked = {"chain": "a = b = 3", "mapping": {"c": 4, 0: 5}, "pair": ([1, 2, 3], 6), "texts": ["2*a = 7", "b - c/2"]}
    found = {what: linear_constraint(like, names) for what, like in asked.items()}
    whole = LinearConstraint.combine(list(found.values()))
    labels = [what for what, one in found.items() for _ in one.coefs]
    return [(what, *map(float, coefs), float(k)) for what, coefs, (k,) in zip(labels, whole.coefs, whole.constants, strict=True)]


# Designs as objects.


@answers(
    "q_design_object", "what string, found string",
    [
        ("columns", "Intercept,r_name[T.AMERICA],r_name[T.ASIA],r_name[T.EUROPE],r_name[T.MIDDLE EAST],r_regionkey"), ("describe", "1 + r_name + r_regionkey"), ("slice of a term", "1:5"), ("slice of a column", "2:3"), ("slice of a number", "5:6"),
        ("duplicate names", "refused"), ("codings without factors", "refused"), ("widths that differ", "refused"), ("unknown column", "refused"), ("pickling", "refused"), ("old names", "2 warnings"),
    ],
)
def _design_object(spark: SparkSession, sf_dir: str) -> Rows:
    info = incr_dbuilder("~ r_name + r_regionkey", table(spark, sf_dir, "region"), Env())

    def refused(fn: Callable[[], object]) -> str:
        try:
            fn()
        except (FormulaError, ValueError, TypeError):
            return "refused"
        return "accepted"

    def shown(s: slice) -> str:
        return f"{s.start}:{s.stop}"

    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert info.builder.design_info is info
    return [
        ("columns", ",".join(info.column_names)), ("describe", info.describe()), ("slice of a term", shown(info.slice("r_name"))), ("slice of a column", shown(info.slice("r_name[T.ASIA]"))), ("slice of a number", shown(info.slice(5))),
        ("duplicate names", refused(lambda: DesignInfo(["a", "a"]))), ("codings without factors", refused(lambda: DesignInfo(["a"], None, {}))), ("widths that differ", refused(lambda: DesignInfo(info.column_names[:-1], info.factor_infos, info.term_codings))),
        ("unknown column", refused(lambda: info.slice("nothing"))), ("pickling", refused(lambda: __import__("pickle").dumps(info))), ("old names", f"{len(caught)} warnings"),
    ]


@answers(
    "q_shown", "line int, shown string",
    list(enumerate([
        "DesignMatrix with 2 columns and 5 rows", "  Intercept  half", "          1   0.0", "          1   0.5", "          1   1.0", "          1   1.5", "          1   2.0", "  Terms:", "    'Intercept' (column 0)", "    'half' (column 1)",
    ])),
)
def _shown(spark: SparkSession, sf_dir: str) -> Rows:
    data = table(spark, sf_dir, "region").select((F.col("r_regionkey") / 2).alias("half")).coalesce(1).sortWithinPartitions("half")
    return list(enumerate(show(dmatrix("~ half", data, Env())).split("\n")))


@frame("q_json", "SELECT l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS c0, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c1 FROM lineitem")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design that has been written and read applies as it did."""
    data = table(spark, sf_dir, "lineitem")
    info = incr_dbuilder("0 + center(l_quantity) + C(l_returnflag, levels=['A', 'N', 'R'])", data, Env())
    again = DesignInfo.from_json(json.dumps(json.loads(info.to_json())))
    found = build_design_matrices([again], data)
    return found.select(F.col("`center(l_quantity)`").alias("c0"), F.col("`C(l_returnflag, levels=['A', 'N', 'R'])[N]`").alias("c1"))


# Sources and kinds of data.


@frame("q_chunks", "SELECT p_size - (SELECT avg(p_size) FROM part) AS c0 FROM part")
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "part")
    pieces = [data.where("p_partkey % 3 = 0"), data.where("p_partkey % 3 = 1"), data.where("p_partkey % 3 = 2")]
    return build_design_matrices([incr_dbuilder("0 + center(p_size)", pieces, Env())], data).toDF("c0")


@frame("q_matrix_as_it_is", "SELECT p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part")
def _matrix_as_it_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dmatrix(table(spark, sf_dir, "part").select("p_size", "p_retailprice")).df


@frame("q_matrices_as_they_are", "SELECT p_partkey, p_retailprice::DOUBLE AS \"y.p_retailprice\", p_size::DOUBLE AS \"X.x0\", (2 * p_size)::DOUBLE AS \"X.x1\" FROM part")
def _matrices_as_they_are(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two matrices, one of them unnamed, matched by a key."""
    data = table(spark, sf_dir, "part")
    left, _ = dmatrices((data.select("p_partkey", "p_retailprice"), data.select("p_partkey", F.array("p_size", F.col("p_size") * 2).alias("v"))), keep=["p_partkey"])
    return left.df


@answers("q_from_columns", "names string", [("a,column1,b",), ("x0,x1",)])
def _from_columns(spark: SparkSession, sf_dir: str) -> Rows:
    pair = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    return [(",".join(DesignInfo.from_columns(["a", 1, "b"]).column_names),), (",".join(dmatrix(pair).design_info.column_names),)]


# NumPy's first standard normal numbers of seed 0.
@answers(
    "q_demo", "a string, b string, x double, y double",
    [("a1", "b1", 1.76405235, -0.10321885), ("a1", "b2", 0.40015721, 0.4105985), ("a2", "b1", 0.97873798, 0.14404357), ("a2", "b2", 2.2408932, 1.45427351), ("a1", "b1", 1.86755799, 0.76103773), ("a1", "b2", -0.97727788, 0.12167502), ("a2", "b1", 0.95008842, 0.44386323), ("a2", "b2", -0.15135721, 0.33367433)],
)
def _demo(spark: SparkSession, sf_dir: str) -> Rows:
    return [(r.a, r.b, round(r.x, 8), round(r.y, 8)) for r in demo_data(spark, "a", "b", "x", "y").collect()]


@frame("q_pandas", "SELECT 1.0::DOUBLE AS \"Intercept\", r_regionkey::DOUBLE AS r_regionkey FROM region")
def _pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(dmatrix("~ r_regionkey", table(spark, sf_dir, "region"), Env(), return_type="dataframe"))


@frame("q_subscripts", "SELECT embedding[3]::DOUBLE AS c0, embedding[64]::DOUBLE AS c1, embedding[2]::DOUBLE AS c2, embedding[3]::DOUBLE AS c3, embedding[63]::DOUBLE * 2 AS c4, embedding[64]::DOUBLE * 2 AS c5 FROM embeddings")
def _subscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dmatrix("0 + embedding[2] + embedding[-1] + embedding[1:3] + I(embedding[-2:] * 2)", table(spark, sf_dir, "embeddings"), Env()).df.toDF(*[f"c{i}" for i in range(6)])


@frame("q_center_arrays", "SELECT " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE - (SELECT avg(embedding[{i + 1}]::DOUBLE) FROM embeddings), 9) + 0.0 AS c{i}" for i in range(4)) + " FROM embeddings")
def _center_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = dmatrix("0 + center(embedding)", table(spark, sf_dir, "embeddings"), Env())
    return design.df.select(*[(F.round(F.col(f"`center(embedding)[{i}]`"), 9) + 0.0).alias(f"c{i}") for i in range(4)])


@frame("q_declared", "SELECT CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c1, 0.0::DOUBLE AS c2 FROM orders")
def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that metadata declare: their order, and one that no row has."""
    data = table(spark, sf_dir, "orders").withColumn("s", F.col("o_orderstatus").alias("s", metadata={"ml_attr": {"vals": ["O", "P", "F", "X"]}}))
    return dmatrix("~ s", data, Env()).df.select(*[F.col(f"`s[T.{v}]`").alias(f"c{i}") for i, v in enumerate("PFX")])


@frame("q_many_levels", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, 'C(o_orderkey)[' || o_orderkey || ']' AS column_name FROM (SELECT DISTINCT o_orderkey FROM orders)")
def _many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each order."""
    return incr_dbuilder("0 + C(o_orderkey)", table(spark, sf_dir, "orders"), Env()).names_table(spark)


@frame("q_looked_up_levels", "SELECT l_orderkey, CASE WHEN l_suppkey = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0, CASE WHEN l_partkey = 1001 THEN l_tax ELSE 0.0::DOUBLE END AS c1 FROM lineitem")
def _looked_up_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of so many levels that these are looked up in a table."""
    design = dmatrix("0 + C(l_suppkey) + C(l_partkey):l_tax", table(spark, sf_dir, "lineitem"), Env(), keep=["l_orderkey"])
    return design.select("l_orderkey", "C(l_suppkey)[7]", "C(l_partkey)[1001]:l_tax").toDF("l_orderkey", "c0", "c1")


class _FirstAgainstRest:
    """A contrast of the user."""

    def code_with_intercept(self, levels: list) -> ContrastMatrix:
        return ContrastMatrix(np.eye(len(levels)), [f"<{v}>" for v in levels])

    def code_without_intercept(self, levels: list) -> ContrastMatrix:
        first = np.ones((len(levels), len(levels) - 1)) * -1
        return ContrastMatrix(np.where(np.eye(len(levels))[:, 1:] > 0, 2, first), [f"<{v} to {levels[0]}>" for v in levels[1:]])


@frame("q_own_contrast", "SELECT CASE WHEN l_returnflag = 'N' THEN 2.0::DOUBLE ELSE -1.0::DOUBLE END AS \"C(l_returnflag, Mine)<N to A>\", CASE WHEN l_returnflag = 'R' THEN 2.0::DOUBLE ELSE -1.0::DOUBLE END AS \"C(l_returnflag, Mine)<R to A>\" FROM lineitem")
def _own_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dmatrix("~ C(l_returnflag, Mine)", table(spark, sf_dir, "lineitem"), Env({"Mine": _FirstAgainstRest})).df.drop("Intercept")


# What users bring.


@frame("q_own_text", "SELECT CASE WHEN l_quantity > 25 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS \"size_of(l_quantity)[few]\", CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"size_of(l_quantity)[many]\" FROM lineitem")
def _own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def size_of(x: np.ndarray) -> np.ndarray:
        return np.where(x > 25, "many", "few")

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return dmatrix("0 + size_of(l_quantity)", table(spark, sf_dir, "lineitem"), Env({"size_of": size_of})).df


@frame("q_own_columns", "SELECT l_quantity AS \"powers(l_quantity)[0]\", l_quantity * l_quantity AS \"powers(l_quantity)[1]\", CASE WHEN l_tax > 0.04 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS \"high(l_tax)[False]\", CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"high(l_tax)[True]\", 2 * l_quantity AS \"twice(l_quantity)\" FROM lineitem")
def _own_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that return several columns, truth values, and Columns."""
    env = Env({"powers": lambda x: np.column_stack([x, x**2]), "high": lambda x: x > 0.04, "twice": column_function(lambda c: c * 2)})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return dmatrix("0 + high(l_tax) + powers(l_quantity) + twice(l_quantity)", table(spark, sf_dir, "lineitem"), env).df


@stateful_transform
class Extent:
    """Scales to the extent of the data, and tells the rest; tasks fit their own rows."""

    def __init__(self) -> None:
        self.low, self.high = np.inf, -np.inf

    def memorize_chunk(self, x: np.ndarray) -> None:
        self.low, self.high = min(self.low, float(np.min(x))), max(self.high, float(np.max(x)))

    def merge(self, other: Extent) -> None:
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)

    def memorize_finish(self) -> None:
        self.span = self.high - self.low

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.low) / self.span, (self.high - x) / self.span])


@stateful_transform
class Doubt:
    """Counts all rows, chunk by chunk."""

    def __init__(self) -> None:
        self.rows = 0

    def memorize_chunk(self, x: np.ndarray, by: float = 1) -> None:
        self.rows += len(x)

    def memorize_finish(self) -> None:
        pass

    def transform(self, x: np.ndarray, by: float = 1) -> np.ndarray:
        return x * 0 + self.rows * by


@frame("q_own_transform", "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem) SELECT round((l_quantity - lo) / (hi - lo), 9) + 0.0 AS c0, round((hi - l_quantity) / (hi - lo), 9) + 0.0 AS c1, (2 * n)::DOUBLE AS c2 FROM lineitem, e")
def _own_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dmatrix("0 + Extent(l_quantity) + Doubt(l_quantity, by=2)", table(spark, sf_dir, "lineitem"), Env({"Extent": Extent, "Doubt": Doubt})).df.toDF("c0", "c1", "c2")
    return found.select(*[(F.round(c, 9) + 0.0).alias(c) for c in found.columns])


class _LessMean:
    """A factor that memorizes and evaluates for itself, in two passes: the mean, then the largest distance from it."""

    def name(self) -> str:
        return "less_mean"

    def memorize_passes_needed(self, state: dict, env: Env) -> int:
        state.update(total=0.0, rows=0, far=0.0)
        return 2

    def memorize_chunk(self, state: dict, which: int, data: dict) -> None:
        x = data["p_size"]
        if which:
            state["far"] = max(state["far"], float(np.abs(x - state["mean"]).max()))
        else:
            state["total"] += float(x.sum())
            state["rows"] += len(x)

    def memorize_finish(self, state: dict, which: int) -> None:
        state["mean"] = state["total"] / state["rows"]

    def eval(self, state: dict, data: dict) -> np.ndarray:
        return (data["p_size"] - state["mean"]) / state["far"]


@frame("q_own_factor", "WITH m AS (SELECT avg(p_size) AS mean FROM part), f AS (SELECT max(abs(p_size - mean)) AS far FROM part, m) SELECT round((p_size - mean) / far, 9) + 0.0 AS c0 FROM part, m, f")
def _own_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "part")
    (info,) = design_matrix_builders([[Term([_LessMean()])]], data, Env())
    return build_design_matrices([info], data).select((F.round("less_mean", 9) + 0.0).alias("c0"))


class _WithModel:
    def __model_desc__(self) -> ModelDesc:
        return ModelDesc([Term([EvalFactor("l_extendedprice")])], [Term([LookupFactor("l_tax")])])


@frame("q_model_of_an_object", "SELECT l_extendedprice AS \"y.l_extendedprice\", l_tax AS \"X.l_tax\" FROM lineitem")
def _model_of_an_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "lineitem")
    left, right = incr_dbuilders(_WithModel(), data, Env())
    again, _ = dmatrices((left, right), data, Env())
    return again.df


# Missing values.

_GAPS = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("s", F.expr(_GAPS)).withColumn("x", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN double('NaN') ELSE double(o_orderkey) END"))


@frame("q_na_categories", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0 FROM orders WHERE o_orderstatus <> 'P'")
def _na_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dmatrix("~ s", _gaps(spark, sf_dir), Env(), keep=["o_orderkey"]).df.select("o_orderkey", F.col("`s[T.O]`").alias("c0"))


@frame("q_na_levels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0 FROM orders")
def _na_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is a level where it does not count as missing."""
    return dmatrix("0 + s", _gaps(spark, sf_dir), Env(), NAAction(NA_types=["NaN"]), keep=["o_orderkey"]).df.select("o_orderkey", F.col("`s[None]`").alias("c0"))


@frame("q_na_both_sides", "SELECT o_orderkey, o_orderkey::DOUBLE AS \"y.x\", CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"X.s[T.O]\" FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 > 1")
def _na_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = dmatrices("x ~ s", _gaps(spark, sf_dir), Env(), keep=["o_orderkey"])
    return left.df.drop("X.Intercept") if "X.Intercept" not in left.df.columns else left.df.select("o_orderkey", "`y.x`", "`X.s[T.O]`")


@answers("q_na_refused", "what string, refused boolean", [("number", True), ("category", True), ("whole", False)])
def _na_refused(spark: SparkSession, sf_dir: str) -> Rows:
    out = []
    for what, text in (("number", "0 + x"), ("category", "0 + s"), ("whole", "0 + o_orderkey")):
        try:
            dmatrix(text, _gaps(spark, sf_dir), Env(), "raise").df.write.format("noop").mode("overwrite").save()
            out.append((what, False))
        except Exception as e:  # noqa: BLE001
            out.append((what, "missing values" in str(e)))
    return out


class _NoFives(NAAction):
    """Multiples of five, and pending orders, count as missing."""

    def is_numerical_NA(self, values: np.ndarray) -> np.ndarray:  # noqa: N802
        return np.asarray(values) % 5 == 0

    def is_categorical_NA(self, value: object) -> bool:  # noqa: N802
        return value == "P"


@frame("q_na_own", "SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderstatus[T.O]\" FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'P'")
def _na_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dmatrix("~ o_orderstatus + o_orderkey", table(spark, sf_dir, "orders"), Env(), _NoFives()).df.drop("Intercept")


@answers("q_refusals", "what string, refused boolean", [("no data", True), ("outcome not asked for", True), ("no outcome", True), ("no formula", True), ("unmatched matrices", True), ("text in arithmetic", True), ("levels that are not there", True), ("data of two columns as categories", True)])
def _refusals(spark: SparkSession, sf_dir: str) -> Rows:
    region = table(spark, sf_dir, "region")
    tried: list[tuple[str, Callable[[], DesignMatrix]]] = [
        ("no data", lambda: dmatrix("~ 1", None)), ("outcome not asked for", lambda: dmatrix("r_name ~ 1", region, Env())), ("no outcome", lambda: dmatrices("~ r_name", region, Env())), ("no formula", lambda: dmatrix(5, region, Env())),
        ("unmatched matrices", lambda: dmatrices((region.select("r_regionkey"), region.select("r_regionkey")))), ("text in arithmetic", lambda: dmatrix("I(r_name + 1)", region, Env())),
        ("levels that are not there", lambda: dmatrix("C(r_name, levels=['ASIA', 'AFRICA'])", region, Env()).df.collect()), ("data of two columns as categories", lambda: dmatrix("C(v)", region.select(F.array(F.lit(1.0), F.lit(2.0)).alias("v")), Env())),
    ]
    out = []
    for what, fn in tried:
        try:
            fn()
            out.append((what, False))
        except Exception as e:  # noqa: BLE001
            out.append((what, isinstance(e, FormulaError) or "does not match any of the expected levels" in str(e)))
    return out
