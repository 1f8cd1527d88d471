"""Exact top-k search by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

K = 10
#: op2's queries are the rows whose id it divides.
EVERY = 50
#: Equal parts into which a vector is cut; each gives one sorted list per query.
LISTS = 2
#: Rows of the table in a block; blocks meet each other, a block's lists are read by all queries of another.
BLOCK = 8_192
#: Queries that read a block's lists together.
QUERIES = 256
#: Entries that are first read from each list, about; doubled while some outsider may still qualify.
DEPTH = 64
#: Places in a block after which the objects before give floors to those that follow.
FIRST = (512, 2_560)
DIGITS = 6


def nra(parts: list[np.ndarray], k: int, depth: int = DEPTH, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of every object that may be among the ``k`` best of its query, by sum over lists, and the most entries read of a list.

    parts[m][q, o] is the score of object o in list m of query q. Lists are read
    from the top, down to one level after another, with no look-up of an object
    by name:

    * an object read in all lists has its score; another has a lower bound, of
      what has been read of it and each other list's end, and an upper bound,
      with the level reached there instead;
    * an object that hasn't been read anywhere is an outsider, bounded by the
      sum of the levels;
    * a query stops when its k-th lower bound, or the ``floor`` that it has from
      lists read before, is above that sum: no outsider can qualify then, and
      what has an upper bound below it neither.

    The first level of a query with a floor is where the sum falls to it; of one
    without, where about ``depth`` entries are above it, as many again each time.
    What is left is returned for its final scores; rounding of scores is allowed
    for, so ties at the edge stay in.
    """
    q, n = parts[0].shape
    slack = 2 * 10.0**-DIGITS
    mean, end = (np.stack([f(p, axis=1) for p in parts]) for f in (np.mean, np.min))
    spread = np.sqrt(np.maximum(np.stack([np.einsum("qn,qn->q", p, p) for p in parts]) / n - mean**2, 0))
    known = np.full(q, -np.inf) if floor is None else np.array(floor, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where(np.isfinite(known), (known - 2 * slack - mean.sum(axis=0)) / np.maximum(spread.sum(axis=0), 1e-12), np.inf)
    open_ = np.arange(q)
    rows, cols, reached = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(open_):
        start = NormalDist().inv_cdf(1 - depth / n) if 2 * depth < n else -np.inf
        at = np.where(np.isfinite(z[open_]), z[open_], start)
        with np.errstate(invalid="ignore"):
            level = np.fmax(mean[:, open_] + at * spread[:, open_], end[:, open_])
        scores = [p[open_] for p in parts]
        read = [s >= t[:, None] for s, t in zip(scores, level)]
        reached = max(reached, *(int(r.sum(axis=1).max()) for r in read))
        whole = np.logical_and.reduce(read)
        r, c = np.nonzero(whole)
        # the k-th score of what has been read everywhere; all other lower bounds are smaller or of no help
        s = sum(p[r, c] for p in scores)
        order = np.lexsort((-s, r))
        count = np.bincount(r, minlength=len(open_))
        first = np.cumsum(count) - count
        enough = count >= k
        kth = known[open_].copy()
        kth[enough] = np.maximum(kth[enough], s[order][first[enough] + k - 1])
        done = (level.sum(axis=0) < kth - slack) | (level <= end[:, open_]).all(axis=0)
        # upper bounds: the level stands in where a list hasn't been read
        r, c = np.nonzero(np.logical_or.reduce(read) & done[:, None])
        upper = sum(np.where(x[r, c], p[r, c], t[r]) for x, p, t in zip(read, scores, level))
        may = upper >= (kth - slack)[r]
        rows.append(open_[r[may]])
        cols.append(c[may])
        z[open_] = np.inf
        known[open_] = kth
        open_, depth = open_[~done], depth * 2
    return np.concatenate(rows), np.concatenate(cols), reached


def top_k(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, block: int = BLOCK, every: int | None = None) -> DataFrame:
    """(id, rank, neighbour, score): for every row, or with ``every`` those whose id it divides, its ``k`` rows of the largest cosine similarity, itself apart.

    Scores are rounded to six digits; ties go to the lower id. The similarity is
    a sum over parts of the vectors, and each part gives every query a sorted
    list of objects, which the no-random-access search reads from the top.
    Each query meets all blocks of rows, and queries have blocks of their own; each pair of blocks keeps
    of a query what isn't below the k-th score that it has by then from this block
    and those before it in the same task, and a window takes the best of those. The lists of a pair
    of blocks are made from its vectors, so all pairs are scored in halves first.

    Rows whose id is null, or whose vector is null, empty, zero or has a null or
    NaN, take no part, and rows meet only rows of the same length. Rows alike in
    id and vector count as one; rows that share an id are rows of their own, but
    never each other's neighbour. Other columns are ignored.
    """
    rows = df.select(df[id_col].alias("i"), df[vector_col].cast("array<double>").alias("v"))
    rows = rows.where("i IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, e -> e IS NULL OR isnan(e))")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).where("norm > 0 AND norm < double('infinity')").dropDuplicates(["i", "v"])
    kind = rows.schema["i"].dataType

    def packed(some: DataFrame) -> DataFrame:
        count = max(1, -(-some.count() // block))
        return (
            some.withColumn("b", F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(3)), F.lit(count)).cast("int"))
            .groupBy("b", F.size("v").alias("w"))
            .agg(F.sort_array(F.collect_list(F.struct("i", F.transform("v", lambda e: e / F.col("norm")).alias("v")))).alias("rows"))
            .select("b", "w", F.col("rows.i").alias("ids"), F.flatten("rows.v").alias("x"))
        )

    all_ = packed(rows)
    left, right = all_ if every is None else packed(rows.where(F.col("i") % every == 0)), all_.select(F.col("w").alias("w2"), F.col("ids").alias("ids2"), F.col("x").alias("x2"))
    # every block with every block: not an equality, which would send all pairs to the one task of its key
    pairs = left.join(right, F.col("w") - F.col("w2") == 0)
    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("s", T.DoubleType())])

    def search(frames):
        # k-th scores that the queries of a block have from the blocks read so far in this task: floors for those to come
        floors: dict = {}
        for f in frames:
            for key, w, ids, x, ids2, x2 in zip(f["b"], f["w"], f["ids"], f["x"], f["ids2"], f["x2"]):
                ids, ids2 = np.asarray(list(ids)), np.asarray(list(ids2))
                A, B = np.asarray(x, dtype=np.float64).reshape(-1, w), np.asarray(x2, dtype=np.float64).reshape(-1, w)
                edges = np.linspace(0, w, min(lists, w) + 1).astype(int)
                best = floors.setdefault((key, w), np.full((len(A), k), -np.inf))
                # the query itself may be among them, as often as its id occurs
                own = 1 if len(ids2) < 2 else int(pd.Series(ids2).value_counts().iloc[0])
                cuts = sorted({0, *[c for c in FIRST if c < len(B)], len(B)})
                for at in range(0, len(A), QUERIES):
                    Q, names, top = A[at : at + QUERIES], ids[at : at + QUERIES], best[at : at + QUERIES]
                    parts = [Q[:, a:b] @ B[:, a:b].T for a, b in zip(edges, edges[1:])]
                    rows, cols, sums = [], [], []
                    # a few objects first, whose k-th scores are floors for the lists of the others
                    for lo, hi in zip(cuts, cuts[1:]):
                        some = [p[:, lo:hi] for p in parts]
                        r, c, _ = nra(some, min(k + own, hi - lo), floor=top[:, -1])
                        s = np.round(sum(p[r, c] for p in some), DIGITS)
                        good = names[r] != ids2[lo + c]
                        r, c, s = r[good], lo + c[good], s[good]
                        order = np.lexsort((ids2[c], -s, r))
                        r, c, s = r[order], c[order], s[order]
                        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(Q)))[r]
                        keep = place < k
                        r, c, s, place = r[keep], c[keep], s[keep], place[keep]
                        new = np.full((len(Q), k), -np.inf)
                        new[r, place] = s
                        top[:] = -np.sort(-np.concatenate([top, new], axis=1), axis=1)[:, :k]
                        rows.append(r)
                        cols.append(c)
                        sums.append(s)
                    r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(sums)
                    # what has been overtaken since can't be among the best
                    keep = s >= top[r, -1]
                    yield pd.DataFrame({"i": names[r[keep]], "j": ids2[c[keep]], "s": s[keep] + 0.0})

    found = pairs.select("b", "w", "ids", "x", "ids2", "x2").mapInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("i").alias(id_col), "rank", F.col("j").alias("neighbour"), F.col("s").alias("score"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=EVERY)


OP2_SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e)
SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v) / (a.norm * b.norm), {DIGITS}) DESC, b.vec_id)::INTEGER AS rank,
       b.vec_id AS neighbour, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), {DIGITS}) AS score
FROM n a JOIN n b ON a.vec_id != b.vec_id WHERE a.vec_id % {EVERY} = 0 QUALIFY rank <= {K}
"""
