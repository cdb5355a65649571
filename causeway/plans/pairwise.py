"""Additive noise models: for each pair of variables, is the residual of a flexible fit independent of the cause?"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame

from causeway.operators.independence import hsic_test
from causeway.operators.lowrank import process_residual
from causeway.plans.base import Graph, Learner, learner


@learner
class ANM(Learner):
    """regressor(df, x, y) -> (x, residual); test(df, x, y, alpha) -> 1 if independent. Both directions of a pair may hold."""

    def __init__(self, alpha: float = 0.05, regressor: Callable[[DataFrame, str, str], DataFrame] = process_residual, test: Callable[[DataFrame, str, str, float], int] | None = None):
        self.alpha, self.regressor = alpha, regressor
        self.test = test or (lambda df, x, y, alpha: hsic_test(df, x, y, alpha)["independent"])

    def direction_holds(self, df: DataFrame, x: str, y: str) -> bool:
        return bool(self.test(self.regressor(df, x, y), "x", "residual", self.alpha))

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        d = len(columns)
        g, dependent = np.zeros((d, d), dtype=int), {}
        for i, j in permutations(range(d), 2):
            pair = (min(i, j), max(i, j))
            if pair not in dependent:
                dependent[pair] = not self.test(df, columns[pair[0]], columns[pair[1]], self.alpha)
            if dependent[pair]:
                g[i, j] = int(self.direction_holds(df, columns[i], columns[j]))
        return Graph(list(columns), g)
