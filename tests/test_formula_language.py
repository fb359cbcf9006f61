"""Parser, spacing, algebra, contrasts, coding and constraints: no Spark needed."""

import itertools

import numpy as np
import pytest

from designloom.functions.contrasts import ContrastMatrix, Diff, Helmert, Poly, Sum, Treatment, coded
from designloom.plans.algebra import INTERCEPT, Algebra, EvalFactor, ModelDesc, Partial, Term
from designloom.plans.coding import codings
from designloom.plans.constraint import LinearConstraint, linear_constraint
from designloom.plans.errors import FormulaError, Span
from designloom.plans.grammar import Operator, parse_formula
from designloom.plans.lexer import respaced


def sides(text):
    model = ModelDesc.from_formula(text)
    return tuple(" ".join("1" if t == INTERCEPT else t.name() for t in side) for side in (model.lhs, model.rhs))


def right(text):
    return sides(text)[1]


def test_an_intercept_is_there_unless_removed():
    for text in ("speed", "~ speed", "speed + 1", "0 + speed + 1", "speed - 0"):
        assert right(text) == "1 speed", text
    for text in ("speed - 1", "speed + 0", "0 + speed", "-1 + speed", "1 + speed - 1"):
        assert right(text) == "speed", text
    assert sides("dist ~ speed") == ("dist", "1 speed") and sides("1 + dist ~ 0") == ("1 dist", "")


def test_operators_by_their_definitions():
    names = ["u", "v", "w"]
    assert right("u * v") == right("u + v + u:v") and right("u / v") == right("u + u:v")
    assert right("(u + v) * w") == "1 u v w u:w v:w"
    assert right("(u + v) / w") == "1 u v u:v:w" and right("u / (v * w)") == "1 u u:v u:w u:v:w"
    every = [":".join(c) for n in (1, 2, 3) for c in itertools.combinations(names, n)]
    assert right("(u + v + w) ** 3").split() == ["1", *every] and right("(u + v + w)**2").split() == ["1", *every[:6]]
    assert right("(u + v) ** 9") == right("u * v") and right("u ** 3") == "1 u"
    assert right("u * v * w - u:v:w - w") == "1 u v u:v u:w v:w"
    assert right("w:u - u:w") == "1" and right("u:u:v") == "1 u:v"
    # Terms are sets of factors that are equal when their canonical texts are.
    assert right("log( u,2 ) + v - log(u , 2)") == "1 v"


@pytest.mark.parametrize("seed", range(20))
def test_algebra_against_sets(seed):
    """Random formulas of +, -, :, * and parentheses, worked out with plain sets too."""
    rng = np.random.default_rng(seed)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            name = "pqrs"[int(rng.integers(4))]
            return name, [frozenset(name)]
        op = "+-:*"[int(rng.integers(4))]
        (a, x), (b, y) = grow(depth - 1), grow(depth - 1)
        cross = [i | j for i in x for j in y]
        found = {"+": x + y, "-": [t for t in x if t not in y], ":": cross, "*": x + y + cross}[op]
        return f"({a} {op} {b})", list(dict.fromkeys(found))

    text, wanted = grow(4)
    found = ModelDesc.from_formula(text).rhs
    assert [frozenset(f.name() for f in t.factors) for t in found if t != INTERCEPT] == wanted


def test_precedence_and_own_operators():
    assert str(parse_formula("y ~ p - q : r ** 2 / s")) == "(~ y (- p (/ (: q (** r 2)) s)))"
    assert str(parse_formula("p & q", [Operator("&", 2, 150)])) == "(~ (& p q))"
    with pytest.raises(ValueError):
        parse_formula("p", [Operator("&", 2, -1)])
    algebra = Algebra()
    algebra.add_op(Operator("&", 2, 150), lambda self, node: Partial(self.side(node.args[0]).terms[:1]))
    tree = parse_formula("(p + q) & r + s", [Operator("&", 2, 150)])
    assert [t.name() for t in ModelDesc.from_formula(tree, algebra).rhs] == ["Intercept", "p", "s"]
    with pytest.raises(FormulaError):
        ModelDesc.from_formula(parse_formula("p & r", [Operator("&", 2, 150)]))


BROKEN = {
    "operator without operand": "height + weight *⟦⟧", "unopened": "height⟦)⟧", "unclosed": "⟦(⟧height + weight", "stray bracket": "height⟦]⟧ + weight",
    "a number": "height + ⟦3⟧", "intercept in a product": "height:⟦1⟧", "power of a name": "(height + weight)**⟦n⟧", "power below one": "height**⟦0⟧", "minus a term": "height + ⟦-weight⟧",
    "two tildes": "⟦out ~ height⟧ ~ weight", "inner tilde": "out ~ height + ⟦(out ~ weight)⟧", "comment": "height ⟦# tall⟧", "string": "f(⟦'⟧tall)",
}


@pytest.mark.parametrize("case", BROKEN)
def test_errors_point_at_their_cause(case):
    marked = BROKEN[case]
    start, end = marked.index("⟦"), marked.index("⟧") - 1
    with pytest.raises(FormulaError) as caught:
        ModelDesc.from_formula(marked.replace("⟦", "").replace("⟧", ""))
    span = caught.value.span
    if start < end:
        assert (span.start, span.end) == (start, end)
    assert "^" * max(1, end - start) in str(caught.value) and span.code in str(caught.value)


def test_spans():
    text = "one two three"
    assert Span.cover([Span(text, 4, 7), None, Span(text, 0, 3)]).text == "one two" and Span.cover([None]) is None
    with pytest.raises(ValueError):
        Span.cover([Span("a", 0, 1), Span("b", 0, 1)])


def test_spacing_is_canonical():
    loose = ["f( x ,y=2 )", "x[ 1 : , 2 ]", "x  **2+  -  y", "{ 'k' : v }", "not  x", "f( * xs, ** ks )", "x .real", "x if y  else z", "x==1 &(y!=2)"]
    tight = ["f(x, y=2)", "x[1:, 2]", "x ** 2 + -y", "{'k': v}", "not x", "f(*xs, **ks)", "x.real", "x if y else z", "x == 1 & (y != 2)"]
    assert [respaced(t) for t in loose] == tight
    # What is canonical stays so, and means the same.
    for text in tight:
        assert respaced(text) == text
    assert EvalFactor("x+ 1") == EvalFactor("x +1") != EvalFactor("x + 2")


def test_describe():
    for text in ("y ~ p + q", "~ 0 + p", "y + z ~ p + p:q", "~ 1", "~ 0"):
        shown = ModelDesc.from_formula(text).describe()
        assert ModelDesc.from_formula(shown) == ModelDesc.from_formula(text), shown
    assert ModelDesc.from_formula("out ~ p / q").describe() == "out ~ p + p:q"
    assert Term([EvalFactor("p"), EvalFactor("q"), EvalFactor("p")]).name() == "p:q"


def test_contrasts():
    levels = ["lo", "mid", "hi", "top"]
    n = len(levels)
    means = np.array([3.0, -1.0, 4.0, 10.0])
    # Coefficients that reproduce four group means, with an intercept, by what each contrast compares.
    for contrast, wanted in [
        (Treatment, means - means[0]), (Treatment("hi"), means - means[2]), (Treatment(-1), means - means[3]), (Sum, means - means.mean()), (Sum(omit="lo"), means - means.mean()),
        (Diff, np.diff(means)), (Helmert, [(means[k] - means[:k].mean()) / (k + 1) for k in range(1, n)]),
    ]:
        matrix = coded(contrast, levels, False)
        found = np.linalg.solve(np.column_stack([np.ones(n), matrix.matrix]), means)[1:]
        names = [s.strip("[]").split(".")[1] for s in matrix.column_suffixes]
        if contrast not in (Diff, Helmert):
            wanted = [wanted[levels.index(name)] for name in names]
        np.testing.assert_allclose(found, wanted, atol=1e-12)
        full = coded(contrast, levels, True)
        assert full.shape == (n, n) and np.linalg.matrix_rank(full.matrix) == n
    assert coded(Helmert, levels, True).column_suffixes[0] == "[H.intercept]" and coded(Sum, levels, True).column_suffixes[0] == "[mean]"
    poly = coded(Poly, range(5), True)
    assert poly.column_suffixes == [".Constant", ".Linear", ".Quadratic", ".Cubic", "^4"]
    np.testing.assert_allclose(poly.matrix[:, 1:] * np.sqrt([10, 14, 10, 70]), [[-2, 2, -1, 1], [-1, -1, 2, -4], [0, -2, 0, 6], [1, -1, -2, -4], [2, 2, 1, 1]], atol=1e-12)
    assert coded([[1, 2], [3, 4], [5, 6], [7, 8]], levels, True).column_suffixes == ["[custom0]", "[custom1]"]
    assert coded(None, [1, True, b"x"], True).column_suffixes == ["[1]", "[True]", "[x]"]
    again = ContrastMatrix.from_json(coded(None, levels, False).to_json())
    assert again == coded(None, levels, False) and again.shape == (4, 3)
    for bad in (Treatment("none"), Treatment(4), [[1, 2]], Poly([1, 2])):
        with pytest.raises(FormulaError):
            coded(bad, levels, False)


def slow_codings(factors, used):
    """The first mergeable part with the first one that it merges with, looked for anew each time."""
    subsets = [s for size in range(len(factors) + 1) for s in itertools.combinations(factors, size) if frozenset(s) not in used]
    used.update(map(frozenset, subsets))
    parts = [dict.fromkeys(s, False) for s in subsets]
    while True:
        for (i, short), (j, long) in itertools.combinations(enumerate(parts), 2):
            extra = [f for f in long if f not in short]
            if len(extra) == 1 and len(long) == len(short) + 1 and not long[extra[0]] and all(long[f] == short[f] for f in short):
                parts[j] = long | {extra[0]: True}
                del parts[i]
                break
        else:
            return parts


@pytest.mark.parametrize("seed", range(30))
def test_codings_merge_in_order(seed):
    rng = np.random.default_rng(seed)
    fast, slow = set(), set()
    for _ in range(4):
        factors = [str(f) for f in rng.permutation(list("abcde"))[: int(rng.integers(0, 6))]]
        assert codings(factors, fast) == slow_codings(factors, slow)
    assert fast == slow


def test_codings_of_long_terms():
    names = [f"f{k}" for k in range(17)]
    assert codings(names, set()) == [dict.fromkeys(names, True)]


def test_columns_have_full_rank_for_all_models_of_two_factors():
    rows = list(itertools.product(range(2), range(3)))
    levels = {"a": [0, 1], "b": [0, 1, 2]}

    def spread(matrices):
        out = np.ones((len(rows), 1))
        for f, matrix in matrices:
            out = np.einsum("ni,nj->nij", out, matrix[[r["ab".index(f)] for r in rows]]).reshape(len(rows), -1)
        return out

    terms = [[], ["a"], ["b"], ["a", "b"]]
    for chosen in itertools.chain.from_iterable(itertools.combinations(terms, n) for n in range(1, 5)):
        used = set()
        design = np.hstack([spread([(f, coded(None, levels[f], full).matrix) for f, full in part.items()]) for term in sorted(chosen, key=len) for part in codings(term, used)])
        whole = np.hstack([spread([(f, np.eye(len(levels[f]))) for f in term]) for term in chosen])
        assert np.linalg.matrix_rank(design) == design.shape[1] == np.linalg.matrix_rank(whole), chosen


CONSTRAINED = ["p", "q", "p:q[x]"]


@pytest.mark.parametrize(
    ("like", "coefs", "constants"),
    [
        ("p", [[1, 0, 0]], [0]), ("p + 2*q = 7 - q", [[1, 3, 0]], [7]), ("p:q[x] = -p/4 + 1e1", [[0.25, 0, 1]], [10]), ("p = q = 3", [[1, -1, 0], [0, 1, 0]], [0, 3]),
        ("q, p = 2, -(p - 1) = 5", [[0, 1, 0], [1, 0, 0], [-1, 0, 0]], [0, 2, 4]), ("3 * (p - 2*(q + 1)) = 0", [[3, -6, 0]], [6]), (["p = 1", "q = p"], [[1, 0, 0], [-1, 1, 0]], [1, 0]),
        ({"q": 3, 2: 1}, [[0, 1, 0], [0, 0, 1]], [3, 1]), (([1, 0, 2], 5), [[1, 0, 2]], [5]), ([[1, 2, 3]], [[1, 2, 3]], [0]),
    ],
)
def test_constraints(like, coefs, constants):
    found = linear_constraint(like, CONSTRAINED)
    np.testing.assert_allclose(found.coefs, coefs)
    np.testing.assert_allclose(found.constants.ravel(), constants)
    assert linear_constraint(found, CONSTRAINED) is found


@pytest.mark.parametrize("bad", ["p q", "p*q = 1", "2/p", "4 = 3", "p + (q = 3)", "7", "p = 2 = 2", "p ? q", "(p, q) = 1", "p = r", "p +", ""])
def test_bad_constraints(bad):
    with pytest.raises(FormulaError):
        linear_constraint(bad, CONSTRAINED)


def test_constraints_combine():
    one, two = linear_constraint("p = 1", CONSTRAINED), linear_constraint("q, p = 2", CONSTRAINED)
    both = LinearConstraint.combine([one, two])
    assert both.coefs.tolist() == [[1, 0, 0], [0, 1, 0], [1, 0, 0]] and both.constants.ravel().tolist() == [1, 0, 2]
    for bad in ([], [one, linear_constraint("p", ["p"])]):
        with pytest.raises(ValueError):
            LinearConstraint.combine(bad)
    for args in ((["p"], [[1, 2]]), (["p"], [[1]], [1, 2]), (["p"], np.zeros((0, 1)))):
        with pytest.raises(ValueError):
            LinearConstraint(*args)
    with pytest.raises(ValueError):
        linear_constraint({"p": 1, 0: 2}, CONSTRAINED)
