"""Optimal topic matching and ranking-set agreement.

Each (model) group holds one k1 x k2 similarity matrix: the group size is
bounded by the number of topics, never by the data. Thousands of groups
are solved in parallel by ``applyInPandas``; inside a group a numpy
shortest-augmenting-path solver (potentials, O(n^2 m)) finds the
assignment of maximum total similarity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns, minimum total cost, ``min(n, m)`` pairs.

    Shortest augmenting paths with row/column potentials on an n <= m
    matrix (the matrix is transposed otherwise). Deterministic: among equal
    reduced costs the lowest column index wins.
    """
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    transposed = cost.shape[0] > cost.shape[1]
    if transposed:
        cost = cost.T
    n, m = cost.shape
    u = np.zeros(n + 1)
    v = np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)   # owner[j] = row (1-based) matched to column j
    back = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        dist = np.full(m + 1, np.inf)
        done = np.zeros(m + 1, dtype=bool)
        while True:
            done[j0] = True
            i0 = owner[j0]
            free = ~done[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < dist[1:])
            dist[1:][better] = reduced[better]
            back[1:][better] = j0
            cand = np.where(free, dist[1:], np.inf)
            j1 = int(np.argmin(cand)) + 1
            delta = cand[j1 - 1]
            used_cols = np.nonzero(done)[0]
            u[owner[used_cols]] += delta
            v[used_cols] -= delta
            dist[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = back[j0]
            owner[j0] = owner[j1]
            j0 = j1
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j] > 0]
    if transposed:
        pairs = [(c, r) for r, c in pairs]
    return sorted(pairs)


def max_similarity_assignment(sim: np.ndarray) -> list[tuple[int, int]]:
    """G4 on a profit matrix: cost = max - similarity."""
    sim = np.asarray(sim, dtype=float)
    if sim.size == 0:
        return []
    return min_cost_assignment(sim.max() - sim)


def _solve_group(key_cols: list[str]):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.sort(pdf["row"].unique())
        cols = np.sort(pdf["col"].unique())
        ri = {r: i for i, r in enumerate(rows)}
        ci = {c: j for j, c in enumerate(cols)}
        mat = np.zeros((len(rows), len(cols)))
        mat[pdf["row"].map(ri).to_numpy(), pdf["col"].map(ci).to_numpy()] = pdf["score"].to_numpy(dtype=float)
        pairs = max_similarity_assignment(mat)
        out = pd.DataFrame({
            "row": [int(rows[r]) for r, _ in pairs],
            "col": [int(cols[c]) for _, c in pairs],
            "score": [float(mat[r, c]) for r, c in pairs],
        })
        for c in key_cols:
            out[c] = pdf[c].iloc[0]
        return out[[*key_cols, "row", "col", "score"]]
    return solve


def optimal_assignment(pair_scores: DataFrame, key_cols: list[str]) -> DataFrame:
    """Matched (row, col, score) per key, maximising total score."""
    fields = {f.name: f.dataType.simpleString() for f in pair_scores.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in key_cols] + ["row int", "col int", "score double"])
    src = pair_scores.select(*key_cols, F.col("row").cast("int"), F.col("col").cast("int"),
                             F.col("score").cast("double"))
    return src.groupBy(*key_cols).applyInPandas(_solve_group(key_cols), schema)


def ranking_set_agreement(pair_scores: DataFrame, key_cols: list[str]) -> DataFrame:
    """Mean similarity of the matched pairs (min(k1, k2) of them)."""
    matched = optimal_assignment(pair_scores, key_cols)
    return matched.groupBy(*key_cols).agg(F.avg("score").alias("agreement"),
                                          F.count(F.lit(1)).cast("bigint").alias("pairs"))
