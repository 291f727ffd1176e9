"""Bounded samples of labelled documents, and an optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, rest: int, ident: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves `rest`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def chosen(key: Column, most: int, n: int) -> Column:
    """Whether a row of n is one of about `most`, by a 64-bit hash: its upper 63 bits are held against most / n, so the share is never rounded to nothing."""
    if n <= most:
        return F.lit(True)
    return F.shiftrightunsigned(key, 1) < F.lit((most << 63) // n).cast("long")


def sampled(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """About `most` rows, chosen by a hash of doc_id; all of them if they are fewer."""
    return ids.filter(chosen(F.xxhash64(F.lit(seed), F.col("doc_id")), most, ids.count()))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))
