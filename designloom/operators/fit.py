"""Fitting: from term lists and data to designs, in a few aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designloom.functions.chunks import PROBE_ROWS, chunks
from designloom.functions.compile import Compiler, Env, FactorState, Value, factor_key
from designloom.functions.contrasts import coded
from designloom.functions.levels import LevelNames, Levels, Names, plain
from designloom.functions.stateful import Stateful
from designloom.plans.algebra import EvalFactor, Term
from designloom.plans.coding import codings
from designloom.plans.design import DesignInfo, FactorInfo, SubtermInfo
from designloom.plans.errors import FormulaError

from .missing import NAAction, as_action

#: Levels, by a sketch, up to which all factors are looked through in one aggregation; those of others stay in tables.
FEW_LEVELS = 5_000


def _learn(df: DataFrame, factors: Sequence, compiler: Compiler) -> None:
    """Fit all stateful calls of all factors; calls of one nesting depth share their aggregations."""
    for f in factors:
        if hasattr(f, "memorize_passes_needed") and not hasattr(f, "compile"):
            compiler.states[factor_key(f)] = FactorState(_memorized(df, f, compiler.env))
    while True:
        waiting: dict[str, tuple] = {}
        for f in factors:
            for key, (args, instance) in compiler.pending(f).items():
                waiting.setdefault(key, (args, instance, f))
        if not waiting:
            return
        running = {}
        for key, (args, instance, f) in waiting.items():
            steps = instance.learn(args)
            running[key] = (steps, _advance(steps, None, f), instance, f)
        while running := {k: r for k, r in running.items() if r[1] is not None}:
            wanted = [(key, c) for key, (_, ask, _, _) in running.items() if isinstance(ask, list) for c in ask]
            row = df.agg(*[c.alias(f"a{i}") for i, (_, c) in enumerate(wanted)]).first() if wanted else ()
            answers: dict[str, list] = {}
            for (key, _), value in zip(wanted, row, strict=True):
                answers.setdefault(key, []).append(value)
            for key, (steps, ask, instance, f) in running.items():
                answer = answers.get(key, []) if isinstance(ask, list) else ask(df)
                running[key] = (steps, _advance(steps, answer, f), instance, f)
        compiler.states.update({key: instance for key, (_, instance, _) in waiting.items()})


def _memorized(df: DataFrame, factor: object, env: Env) -> dict:
    """The state of a factor that memorizes chunks of all columns, in as many passes as it asks for."""
    state: dict = {}
    for which in range(factor.memorize_passes_needed(state, env)):
        for part in chunks(df):
            factor.memorize_chunk(state, which, part)
        factor.memorize_finish(state, which)
    return state


def _advance(steps: object, answer: object, factor: object) -> object:
    """Next request of a coroutine, or None at its end."""
    try:
        return next(steps) if answer is None else steps.send(answer)
    except StopIteration:
        return None
    except FormulaError as e:
        e.locate(factor)
        raise


def level_key(level: object) -> tuple:
    """Numbers first, then by the name of the type, then by value."""
    number = isinstance(level, (bool, int, float)) and not isinstance(level, str)
    return (0, "", level) if number else (1, type(level).__name__, level if level is not None else "")


def _examine(df: DataFrame, values: dict, compiler: Compiler, action: NAAction) -> dict:
    """Widths of array factors and levels of categorical ones, by two aggregations, and a sort for each factor of many levels."""
    asks, slots, out = [], {}, {}
    for f, v in values.items():
        if not v.categorical and v.kind == "num":
            if v.array:
                slots[f] = len(asks)
                asks += [F.min(F.size(v.columns[0])), F.max(F.size(v.columns[0]))]
            else:
                out[f] = len(v.columns)
        elif v.levels is not None:
            out[f] = tuple(v.levels)
        elif v.kind == "bool":
            out[f] = (False, True)
        else:
            slots[f] = len(asks)
            asks += [F.approx_count_distinct(v.columns[0]), F.max(v.columns[0].isNull())]
    row = df.agg(*[c.alias(f"a{i}") for i, c in enumerate(asks)]).first() if asks else ()
    looked = [f for f in slots if values[f].categorical or values[f].kind != "num"]
    few = [f for f in looked if row[slots[f]] <= FEW_LEVELS]
    sets = df.agg(*[F.collect_set(values[f].columns[0]).alias(f"a{i}") for i, f in enumerate(few)]).first() if few else ()
    found = dict(zip(few, sets, strict=True))
    for f, at in slots.items():
        v = values[f]
        whole = v.kind == "num" and not v.is_float
        if f in looked and f not in found:
            missing, own = action.categorical(F.col("level"), v.is_float), action.redefines("is_categorical_NA")
            out[f] = Levels.found(v.columns[0], df, number=v.kind == "num", whole=whole, is_level=action.is_level if own else None, missing=missing)
            if not len(out[f]):
                raise FormulaError("No levels found", f)
            continue
        if f not in found:
            if row[at] is None or row[at] != row[at + 1]:
                raise FormulaError(f"arrays of factor {f.name()} must all have one size", f)
            out[f] = int(row[at])
            continue
        levels = [plain(x, whole) for x in [*found[f], *([None] * bool(row[at + 1]))]]
        levels = [x for x in levels if action.is_level(x)]
        if not levels:
            raise FormulaError("No levels found", f)
        out[f] = tuple(sorted(levels, key=level_key))
    return out


def _own_states(factor: object, states: dict[str, Stateful]) -> dict[str, Stateful]:
    """States of the calls in a factor's own code."""
    if not isinstance(factor, EvalFactor):
        return {k: s for k, s in states.items() if k == factor_key(factor)}
    import ast

    from designloom.plans.lexer import respaced

    calls = {respaced(ast.unparse(n)) for n in ast.walk(ast.parse(factor.code, mode="eval")) if isinstance(n, ast.Call)}
    return {k: s for k, s in states.items() if k in calls}


def _coded_terms(terms: Sequence[Term], infos: dict, contrast: dict) -> dict[Term, list[SubtermInfo]]:
    """Terms in order, coded without redundancy.

    Terms with the same numerical factors form a bucket, since only they can be
    redundant with each other; the bucket without numbers comes first, and in a
    bucket lower interactions do.
    """
    buckets: dict[frozenset, list[Term]] = {}
    for t in terms:
        buckets.setdefault(frozenset(f for f in t.factors if infos[f].kind == "numerical"), []).append(t)
    out: dict[Term, list[SubtermInfo]] = {}
    for _, bucket in sorted(buckets.items(), key=lambda b: bool(b[0])):
        used: set[frozenset] = set()
        for term in sorted(bucket, key=lambda t: len(t.factors)):
            subterms = []
            for coding in codings([f for f in term.factors if infos[f].kind == "categorical"], used):
                factors = tuple(f for f in term.factors if infos[f].kind == "numerical" or f in coding)
                matrices, width = {}, 1
                for f in factors:
                    if f in coding:
                        try:
                            matrices[f] = coded(contrast.get(f), infos[f].categories, coding[f])
                        except FormulaError as e:
                            e.locate(f)
                            raise
                        width *= matrices[f].shape[1]
                    else:
                        width *= infos[f].num_columns
                subterms.append(SubtermInfo(factors, matrices, width))
            out[term] = subterms
    return out


def _names(subterms: Sequence[SubtermInfo], infos: dict) -> Names | list[str]:
    """Names of columns; a list, unless levels are in tables."""
    parts = []
    for s in subterms:
        part = []
        for f in s.factors:
            info = infos[f]
            if f in s.contrast_matrices:
                suffixes = s.contrast_matrices[f].column_suffixes
                part.append(suffixes.after(f.name()) if isinstance(suffixes, LevelNames) else [f.name() + x for x in suffixes])
            else:
                part.append([f"{f.name()}[{i}]" for i in range(info.num_columns)] if info.multi else [f.name()])
        parts.append(part or [["Intercept"]])
    found = Names(parts)
    return found if any(isinstance(own, LevelNames) for part in parts for own in part) else list(found)


def design_matrix_builders(termlists: Sequence[Sequence[Term]], df: DataFrame, env: Env | int = 0, NA_action: str | NAAction = "drop") -> list[DesignInfo]:  # noqa: N803
    """Fit several designs together: one aggregation per nesting depth of transforms, and one for levels.

    Rows with missing values take part in fitting; what counts as missing only
    decides which values are levels.
    """
    env, action = (env if isinstance(env, Env) else Env.capture(env + 1)), as_action(NA_action)
    factors = list(dict.fromkeys(f for terms in termlists for t in terms for f in t.factors))
    for f in factors:
        if not callable(getattr(f, "name", None)):
            raise FormulaError(f"a {type(f).__name__} is no factor: it has no name()")
    compiler = Compiler(df.schema, env, probe=lambda columns: [tuple(r) for r in df.select(*[c.alias(f"a{i}") for i, c in enumerate(columns)]).limit(PROBE_ROWS).collect()])
    _learn(df, factors, compiler)
    values = {f: compiler.factor(f) for f in factors}
    seen = _examine(df, values, compiler, action)
    infos = {}
    for f, v in values.items():
        states = _own_states(f, compiler.states)
        if isinstance(seen[f], (tuple, Levels)):
            infos[f] = FactorInfo(f, "categorical", states, categories=seen[f], shapes=compiler.shapes)
        else:
            infos[f] = FactorInfo(f, "numerical", states, num_columns=seen[f], multi=v.multi, shapes=compiler.shapes)
    contrast = {f: v.contrast for f, v in values.items()}
    words = {n for f in factors if isinstance(f, EvalFactor) for n in _identifiers(f.code)}
    out = []
    for terms in termlists:
        codes = _coded_terms(list(dict.fromkeys(terms)), infos, contrast)
        names = _names([s for subterms in codes.values() for s in subterms], infos)
        out.append(DesignInfo(names, {f: infos[f] for t in codes for f in t.factors}, codes, env.subset(words)))
    return out


def _identifiers(code: str) -> set[str]:
    import ast

    return {n.id for n in ast.walk(ast.parse(code, mode="eval")) if isinstance(n, ast.Name)}
