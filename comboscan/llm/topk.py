"""Exact top-k inner products without random access: sorted lists are read in step, and bounds decide when to stop.

For each dimension the candidates of a block form one sorted list; a query reads it from the top where its own component
is positive and from the bottom where it is negative. After each round of reading, what a candidate has shown so far plus
the last value read (or the list's end) in its unread lists bounds its score from above (or below). A candidate whose
upper bound is under the k-th best lower bound is out; a query stops as soon as few candidates are left, and those are
resolved to their final scores. Reading to the end makes both bounds exact, so no result depends on luck.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_package

#: Candidates and queries that one task holds at a time; the grid of blocks grows with the data, a block does not.
BLOCK, QUERY_BLOCK, BATCH = 8192, 2048, 256
#: Shares of the lists read in each round.
ROUNDS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


def nra(q_uids: np.ndarray, q: np.ndarray, uids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates but its own row (uid), ties to the smaller id."""
    n, d = x.shape
    wide = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * max(1, d)
    if wide >= 2**63:
        raise ValueError("a score may not fit 64 bits")
    exact = wide < 2**53  # doubles then hold every partial sum exactly
    up = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(up)
    np.put_along_axis(rank, up, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(x, up, axis=0)
    depths = sorted({max(1, min(n, int(np.ceil(n * r)))) for r in ROUNDS})
    left = np.arange(len(q))
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    few = max(4 * k, 64)

    def resolve(row: int, alive: np.ndarray) -> None:
        score = x[alive] @ q[row]
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((row, alive[best], score[best]))

    if not exact:
        for row in left:
            resolve(row, np.flatnonzero(uids != q_uids[row]))
        left = left[:0]
    for depth in depths:
        if not len(left):
            break
        top, low = rank >= n - depth, rank < depth
        upper = np.hstack([np.where(top, x, lists[n - depth]), np.where(low, x, lists[depth - 1])]).astype(float)
        lower = np.hstack([np.where(top, x, lists[0]), np.where(low, x, lists[n - 1])]).astype(float)
        again = []
        for at in range(0, len(left), BATCH):
            rows = left[at : at + BATCH]
            sides = np.hstack([np.maximum(q[rows], 0), np.minimum(q[rows], 0)]).astype(float)
            most, least = sides @ upper.T, sides @ lower.T
            own = uids[None, :] == q_uids[rows][:, None]
            least[own] = -np.inf
            most[own] = -np.inf
            bar = np.partition(least, n - k, axis=1)[:, n - k] if n > k else np.full(len(rows), -np.inf)
            for i, row in enumerate(rows):
                alive = np.flatnonzero((most[i] >= bar[i]) & ~own[i])
                if len(alive) <= few or depth == n:
                    resolve(row, alive)
                else:
                    again.append(row)
        left = np.array(again, dtype=int)
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64)
    return np.concatenate([np.full(len(c), r) for r, c, _ in out]), np.concatenate([c for _, c, _ in out]), np.concatenate([s for *_, s in out])


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null id or a null, NaN or infinite component are out."""
    v = F.col(vec_col)
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products for each row where ``is_query(id)`` holds.

    Candidates are all rows but the query's own with the same number of components, rows that repeat its id among them; ties go to
    the smaller id. Queries and
    candidates are dealt into blocks of bounded size, each pair of blocks is one task's work, and a query's k per block are
    merged. Repeated query rows are queries of their own. Fewer candidates give fewer ranks; an empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    # written, so that a row has one number for all its uses
    ints = integer_vectors(vectors, id_col, vec_col, scale).withColumns({"dim": F.size("v"), "uid": F.monotonically_increasing_id()})
    ints = materialize(ints, "vectors")
    size, asked = ints.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("id")))).first()
    cells, rows = max(1, -(-size // block)), max(1, -(-asked // query_block))
    cands = ints.withColumn("c", F.pmod(F.xxhash64("uid"), F.lit(cells))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    queries = ints.where(is_query(F.col("id"))).withColumn("r", F.pmod(F.xxhash64("uid"), F.lit(rows)))
    queries = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "uid": [], "vec_id": [], "score": []}, dtype="int64")
        a, b, s = nra(left["uid"].to_numpy(), np.stack(left["v"].to_numpy()), right["uid"].to_numpy(), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": left["id"].to_numpy()[a], "uid": left["uid"].to_numpy()[a], "vec_id": right["id"].to_numpy()[b], "score": s.astype("int64")})

    keys = ["dim", "c", "r"]
    schema = "query_id long, uid long, vec_id long, score long"
    found = queries.select("id", "uid", "v", F.col("dim"), F.col("c").cast("long"), F.col("r").cast("long")).groupBy(*keys).cogroup(
        cands.select("id", "uid", "v", "dim", F.col("c").cast("long"), F.col("r").cast("long")).groupBy(*keys)
    ).applyInPandas(cell, schema)
    w = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
