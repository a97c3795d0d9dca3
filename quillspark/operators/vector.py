"""Exact vector search in blocks, ranking metrics and index checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a chunk that meet in one task: 32 768 vectors of 64 doubles are 16 MB.
BLOCK, CHUNK = 32_768, 32_768


def unit(v):
    """A vector column divided by its length, which counts as at least 1e-12."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of ``corpus (id, v)`` with the largest inner product.

    ``queries (query_id, v)``; a row is not its own neighbour. Every query meets every row, in
    blocks: rows are copied once for each chunk of queries and queries once for each block, a task
    multiplies one block by one chunk and keeps ``k`` rows for each query, and a window picks the
    best of those. Ties go to the smaller id: all rows within rounding of a block's k-th best are
    scored again one by one, however many they are.
    """
    n, q = corpus.count(), queries.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-q // CHUNK))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    as_double = F.col("v").cast("array<double>").alias("v")
    data = corpus.select("id", as_double, own("id", blocks).alias("block"), all_of(chunks).alias("chunk"))
    asked = queries.select("query_id", as_double, own("query_id", chunks).alias("chunk"), all_of(blocks).alias("block"))

    def run(d, q):
        import numpy as np
        import pandas as pd

        out = []
        if len(d) and len(q):
            d = d.sort_values("id")
            x, ids = np.stack(d["v"].to_numpy()), d["id"].to_numpy()
            y, q_ids = np.stack(q["v"].to_numpy()), q["query_id"].to_numpy()
            length = lambda a: np.sqrt(np.square(a).sum(axis=1))
            long = length(x)
            # a product of d numbers is off by d roundings at most, and two products are compared
            slack = 4 * x.shape[1] * np.finfo(float).eps * length(y) * max(long[np.isfinite(long)], default=0.0)
            for i in range(0, len(y), 256):
                scores = y[i : i + 256] @ x.T
                scores[(q_ids[i : i + 256, None] == ids) | ~np.isfinite(scores)] = -np.inf
                last = max(0, len(ids) - k)
                least = np.partition(scores, last, axis=1)[:, last] - np.nan_to_num(slack[i : i + 256], nan=np.inf)
                near = map(np.flatnonzero, scores >= least[:, None])
                for row, cols in enumerate(near):
                    cols = cols[np.isfinite(scores[row, cols])]
                    exact = (x[cols] * y[i + row]).sum(axis=1)
                    first = np.lexsort((ids[cols], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": q_ids[i + row], "id": ids[cols[first]], "score": exact[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    met = data.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k_unseen(queries: DataFrame, corpus: DataFrame, seen: DataFrame, k: int, most_seen: int) -> DataFrame:
    """As ``top_k`` without the pairs of ``seen (query_id, id)``, of which a query has ``most_seen`` at most."""
    found = top_k(queries, corpus, k + most_seen).join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, n_gold, hit, recall, precision, mrr, first_hit) at ``k``.

    ``ranked`` (query_id, rank, relevant); ``gold`` (query_id, n_gold). Precision is by ``k``.
    """
    hits = ranked.where((F.col("rank") <= k) & F.col("relevant")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first_hit"))
    d = gold.join(hits, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select(
        "query_id",
        "n_gold",
        (F.col("n") > 0).alias("hit"),
        F.when(F.col("n_gold") > 0, F.col("n") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        (F.col("n") / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        "first_hit",
    )


def index_check(corpus: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, least and most dimensions, the largest distance of a norm from 1."""
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return corpus.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.min(F.size("v")).alias("min_dim"),
        F.max(F.size("v")).alias("max_dim"),
        F.round(F.max(F.abs(norm - 1)), 6).alias("max_norm_error"),
    )
