"""Formula-driven design matrices on Spark."""

from designloom.api import DesignMatrix, dmatrices, dmatrix, incr_dbuilder, incr_dbuilders
from designloom.functions.compile import C, Env, I, Q, column_function, stateful_transform
from designloom.functions.contrasts import ContrastMatrix, Diff, Helmert, Poly, Sum, Treatment
from designloom.functions.stateful import Stateful
from designloom.operators.fit import design_matrix_builders
from designloom.operators.missing import NAAction
from designloom.plans.algebra import INTERCEPT, EvalFactor, LookupFactor, ModelDesc, Term
from designloom.plans.constraint import LinearConstraint, linear_constraint
from designloom.plans.design import DesignInfo, build_design_matrices
from designloom.plans.errors import FormulaError
from designloom.sources.generators import balanced, demo_data

__all__ = [
    "C", "ContrastMatrix", "DesignInfo", "DesignMatrix", "Diff", "Env", "EvalFactor", "FormulaError", "Helmert", "I", "INTERCEPT", "LinearConstraint",
    "LookupFactor", "ModelDesc", "NAAction", "Poly", "Q", "Stateful", "Sum", "Term", "Treatment", "balanced", "build_design_matrices", "column_function",
    "demo_data", "design_matrix_builders", "dmatrices", "dmatrix", "incr_dbuilder", "incr_dbuilders", "linear_constraint", "stateful_transform",
]
