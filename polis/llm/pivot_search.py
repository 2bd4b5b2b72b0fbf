"""Operator 9: exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8192, 1024
#: Pivots, and how many rows they are chosen from.
PIVOTS, PIVOT_SAMPLE = 16, 1024
#: Candidates evaluated before the first look at the bound; twice as many before each later one.
STEP = 128


def scaled(vectors: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): components become floor(scale * x), x as double. Rows whose vector is null or holds a null or non-finite component go."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    sound = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(sound, F.lit(False))).select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of sample, each as far as can be from those before."""
    chosen, far = [], np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample))):
        chosen.append(k := int(np.argmax(far)))
        far = np.minimum(far, np.linalg.norm(sample - sample[k], axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots]) if len(pivots) else np.zeros((1, len(x)))


def block_top_k(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, dq: np.ndarray, dx: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of x for each row of q, which is not its own candidate.

    By the triangle inequality |q - x| is at least the largest |d(q, p) - d(x, p)| over the pivots p, so the inner product
    (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most what that bound gives. Candidates are evaluated in the order of this bound
    until it falls below the k-th best score found.
    """
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    slack = 1e-6 * (1 + nx.max(initial=0) + nq.max(initial=0))
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        low = np.zeros((len(q[part]), len(x)))
        for a, b in zip(dq, dx):
            np.maximum(low, np.abs(a[part, None] - b[None, :]), out=low)
        high = (nq[part, None] + nx[None, :] - low * low) / 2 + slack
        for i, bound in enumerate(high):
            own = q_ids[at + i]
            order, done = np.argsort(-bound, kind="stable"), 0
            ids, scores, step = np.empty(0, np.int64), np.empty(0, np.float64), STEP
            while done < len(order):
                if len(scores) >= k and bound[order[done]] < scores[-1]:
                    break
                more = order[done : done + step]
                done, step = done + len(more), 2 * step
                more = more[x_ids[more] != own]
                found = x[more] @ q[at + i]
                if len(scores) >= k:  # only what can still be among the best is ranked
                    more, found = more[found >= scores[-1]], found[found >= scores[-1]]
                ids, scores = np.r_[ids, x_ids[more]], np.r_[scores, found]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids):
                yield int(own), ids, scores.astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k highest integer inner products
    with all other rows, ties to the smaller id.

    Vectors are packed into blocks; each block of queries meets each block of candidates once, by an equi-join on the
    candidates' block, and only k rows for each query leave such a pair. Shorter vectors are read as padded with zeros. A row
    with the query's own id is not its candidate. Rows whose id or vector is null, or whose vector holds null or non-finite
    components, take no part; sums must stay below 2**53. Empty tables give no rows; repeated rows are candidates each.
    """
    spark = vectors.sparkSession
    rows = common.cut(scaled(vectors, scale, key, vector), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).head()
    width = max(width or 0, 1)

    def matrix(lists) -> np.ndarray:
        out = np.zeros((len(lists), width))
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    # A bounded sample, the first PIVOT_SAMPLE by hash, only chooses the pivots; any pivots give exact results.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"].tolist()
    pivots = farthest_first(matrix(sample), PIVOTS)
    n_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n // every // QUERIES))

    def packed(df: DataFrame, name: str, count: int) -> DataFrame:
        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            x = matrix(frame["v"].tolist())
            return pd.DataFrame({name: [int(frame["b"].iloc[0])], f"{name}_ids": [frame["id"].to_numpy(np.int64).tobytes()], f"{name}_x": [x.tobytes()], f"{name}_d": [_distances(x, pivots).tobytes()]})

        df = df.withColumn("b", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(count)).cast("int"))
        return df.groupBy("b").applyInPandas(pack, f"{name} int, {name}_ids binary, {name}_x binary, {name}_d binary")

    candidates = packed(rows, "c", n_blocks)
    queries = packed(rows.filter(F.col("id") % every == 0), "q", q_blocks).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                q_ids, x_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.c_ids, np.int64)
                q, x = (np.frombuffer(b, np.float64).reshape(-1, width) for b in (r.q_x, r.c_x))
                dq, dx = (np.frombuffer(b, np.float64).reshape(-1, len(ids)) for b, ids in ((r.q_d, q_ids), (r.c_d, x_ids)))
                found = list(block_top_k(q, q_ids, x, x_ids, dq, dx, k))
                if found:
                    yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    pairs = queries.join(candidates.hint("merge"), F.col("to") == F.col("c")).drop("to")
    pairs = pairs.repartition(max(1, min(n_blocks * q_blocks, 20_000)), "q", "c")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
