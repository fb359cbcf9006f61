"""Splines as piecewise polynomials: every basis here is a polynomial between breaks.

Bases are worked out on the driver, once, at a few points of each piece, and
turned into coefficients; rows then evaluate Horner chains inside code
generation, without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Piecewise:
    """``coefs[piece, column, power]`` in ``(x - centers[piece]) / widths[piece]``; piece i has ``breaks[i-1] <= x < breaks[i]``."""

    breaks: np.ndarray
    centers: np.ndarray
    widths: np.ndarray
    coefs: np.ndarray

    @staticmethod
    def of(basis: Callable[[np.ndarray], np.ndarray], edges: np.ndarray, degree: int) -> Piecewise:
        """From ``basis(x) -> (len(x), columns)``, a polynomial between any two ``edges``; the outer pieces go on without end."""
        edges = np.asarray(edges, dtype=float)
        centers, widths = (edges[:-1] + edges[1:]) / 2, np.diff(edges) / 2
        # Inner points only, so that jumps at the breaks don't matter.
        u = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1)) * 0.95
        inverse = np.linalg.inv(u[:, None] ** np.arange(degree + 1))
        coefs = np.stack([(inverse @ basis(c + w * u)).T for c, w in zip(centers, widths, strict=True)])
        return Piecewise(edges[1:-1], centers, widths, coefs)

    def times(self, matrix: np.ndarray) -> Piecewise:
        """Columns combined by ``matrix`` (old x new)."""
        return Piecewise(self.breaks, self.centers, self.widths, np.einsum("pck,cd->pdk", self.coefs, matrix))

    def at(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        piece = np.searchsorted(self.breaks, x, side="right")
        u = (x - self.centers[piece]) / self.widths[piece]
        out = np.einsum("nck,nk->nc", self.coefs[piece], u[:, None] ** np.arange(self.coefs.shape[2]))
        out[np.isnan(x)] = np.nan
        return out

    def columns(self, x: Column) -> list[Column]:
        """The basis as Spark columns of ``x``; null and NaN give NaN."""
        out = []
        for c in range(self.coefs.shape[1]):
            found = F.when(x.isNull() | F.isnan(x), F.lit(float("nan")))
            for p in range(len(self.centers)):
                terms = self.coefs[p, c]
                body = F.lit(float(terms[-1]))
                if terms.any():
                    u = (x - F.lit(float(self.centers[p]))) / F.lit(float(self.widths[p]))
                    for k in range(len(terms) - 2, -1, -1):
                        body = body * u + F.lit(float(terms[k]))
                last = p == len(self.centers) - 1
                found = found.otherwise(body) if last else found.when(x < F.lit(float(self.breaks[p])), body)
            out.append(found)
        return out
