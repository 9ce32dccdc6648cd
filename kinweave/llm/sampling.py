"""Held-out folds, bounded samples of rows, and the optimiser that models here share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0 of any number."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(folds)), F.lit(0)).cast("int")


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of their values and so the same on every run."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / total))


class Adam:
    """Adam steps for a dictionary of numpy arrays."""

    def __init__(self, params: dict, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (self.v[k] ** 0.5 + 1e-8)
