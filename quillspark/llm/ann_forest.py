"""Approximate nearest neighbours by a hash-prefix forest (operator 9).

Vectors become long hash strings, one for each of ``TREES`` trees: ``SYMBOLS`` symbols of four bits,
each the nearest of the 16 signed axes after a random projection to eight dimensions. A tree is the
sorted array of the strings of a block of rows. A query looks up its longest-prefix match in every
tree and then ascends all trees together, one bit shorter at a time, which widens the matching
ranges of the arrays; the rows met for the first time are scored exactly. It stops at the prefix
length where a vector as near as the k-th best so far would have been met in one tree at least with
probability ``RECALL``: with p the chance that two vectors at that angle share such a prefix, in one
of L trees that is 1 - (1 - p) ** L; p is measured once on random vectors (``collisions``), for it
depends on the angle alone. There is no other stop and no switch by size: where neighbours do not
stand out the ascent goes on, to the root if need be, and no range is capped.

Largest inner product: for the hashes only, a row gets one more component that lifts all rows to the
same norm, and a query a zero there, so the order by angle is the order by inner product.

Rows are never copied: a task takes the rows of its partition in blocks of at most ``BLOCK`` and
reads the queries, which are stored once, in chunks. All blocks are looked at twice. The first look
scores only the longest matches (``LOOK`` of them and more); the k-th best of all blocks together is
a bound that is stored with the query. The second goes on from there, stops by that bound or the
block's own k-th best, whichever is nearer, and hands on only rows that reach the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import filesystem, read, stored

TREES, SYMBOLS, AXES, SEED = 72, 8, 8, 7
BITS = 4 * SYMBOLS
#: Chance of having met the k-th best by which the ascent stops; the nearer ones are met more surely.
RECALL = 0.85
#: Rows of a block (its vectors and trees lie in a task's memory) and queries read at once.
BLOCK, QUERY_CHUNK = 65_536, 4_096
#: Matches, over all trees and counted with repeats, at which a query's rows in a block are scored first.
LOOK = 320
#: Queries that ascend together; each has a mark for every row of the block.
TOGETHER = 128


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): rows whose vector takes part, none null, zero, or with a null or non-finite component; as doubles.

    Each has a number of its own, so null and repeated vec_ids are rows like any other.
    """
    v = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # dealt anew, so that blocks are full however small the table's files are
    return v.where(F.coalesce(fine, F.lit(False))).repartition("row")


def _symbols(y):
    """The symbol (axis * 2 + sign) of each group of ``AXES`` numbers along the last axis."""
    import numpy as np

    axis = np.abs(y).argmax(axis=-1)
    sign = np.take_along_axis(y, axis[..., None], axis=-1)[..., 0] > 0
    return (axis * 2 + sign).astype(np.uint8)


def collisions(draws: int = 40_000, angles: int = 91):
    """(angles, p): p[b, a] is the chance that strings at angle number a share their first b bits."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    grid = np.linspace(0, np.pi, angles)
    a, other = rng.standard_normal((2, draws, AXES))
    own = _symbols(a)
    part = np.ones((5, angles))
    for i, t in enumerate(grid):
        unlike = own ^ _symbols(np.cos(t) * a + np.sin(t) * other)
        for b in range(1, 5):
            part[b, i] = (unlike >> (4 - b) == 0).mean()
    return grid, np.stack([part[4] ** (b // 4) * part[b % 4] for b in range(BITS + 1)])


def _strings(x, extra):
    """Hash strings of the rows of ``x`` with one more component, one column for each tree."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    x = np.column_stack([x, extra])
    out = np.zeros((len(x), TREES), dtype=np.uint32)
    for t in range(TREES):
        symbols = _symbols((x @ rng.standard_normal((x.shape[1], SYMBOLS * AXES))).reshape(len(x), SYMBOLS, AXES))
        for s in range(SYMBOLS):
            out[:, t] = out[:, t] << np.uint32(4) | symbols[:, s]
    return out


class Forest:
    """The trees of one block of rows, all of one width."""

    def __init__(self, rows, ids, x, top_norm: float, chances):
        import numpy as np

        self.rows, self.ids, self.x, self.top, self.chances = rows, ids, x, top_norm, chances
        strings = _strings(x, np.sqrt(np.maximum(top_norm**2 - (x**2).sum(axis=1), 0)))
        order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))

    def ranges(self, strings, length: int):
        """For queries' strings, the range of rows of each tree that share the first ``length`` bits."""
        import numpy as np

        if not length:
            return np.zeros(strings.shape, dtype=np.int64), np.full(strings.shape, len(self.rows))
        rest = np.uint32((1 << (BITS - length)) - 1)
        cut = lambda s, side: np.column_stack([np.searchsorted(self.sorted[t], s[:, t], side) for t in range(TREES)])
        return cut(strings & ~rest, "left"), cut(strings | rest, "right")

    def met_chance(self, length: int, angle):
        """Chance that a vector at ``angle`` shares a prefix of ``length`` bits with a query in one tree at least."""
        import numpy as np

        grid, p = self.chances
        return 1 - (1 - np.interp(angle, grid, p[length])) ** TREES

    def search(self, q_rows, q, bounds, k: int, look_only: bool = False):
        """(query place, row place, score, rows scored) of the ``k`` nearest met that reach each query's bound.

        With ``look_only`` the ascent ends where it first scores.
        """
        import numpy as np

        strings = _strings(q, np.zeros(len(q)))
        starts = range(0, len(q), TOGETHER)
        parts = [self._together(np.arange(i, min(i + TOGETHER, len(q))), strings, q_rows, q, bounds, k, look_only) for i in starts]
        return tuple(np.concatenate([p[j] for p in parts]) for j in range(4))

    def _together(self, places, strings, q_rows, q, bounds, k: int, look_only: bool):
        import numpy as np

        n = len(self.rows)
        seen = np.zeros((len(places), n), dtype=bool)
        norms = np.sqrt((q[places] ** 2).sum(axis=1))
        tops = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(places)
        waiting, out = np.arange(len(places)), [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0), np.zeros(0, dtype=np.int64))]
        for length in range(BITS, -1, -1):
            if not len(waiting):
                break
            lo, hi = self.ranges(strings[places[waiting]], length)
            ready = ((hi - lo).sum(axis=1) >= LOOK) | (length == 0)
            for i, a, b in zip(waiting[ready].tolist(), lo[ready], hi[ready], strict=True):
                place = int(places[i])
                met = np.full(n, length == 0)
                if length:
                    for t in np.flatnonzero(b > a).tolist():
                        met[self.order[t, a[t] : b[t]]] = True
                new = np.flatnonzero(met & ~seen[i])
                seen[i, new] = True
                scores, slack = self.x[new] @ q[place], 1e-9 * max(1.0, abs(bounds[place]) if np.isfinite(bounds[place]) else 1.0)
                fine = (self.rows[new] != q_rows[place]) & (scores >= bounds[place] - slack)
                rows, scores = np.concatenate([tops[i][0], new[fine]]), np.concatenate([tops[i][1], scores[fine]])
                last = bounds[place]
                if len(rows) >= k:
                    # the k best, and those within rounding of the last
                    last = np.partition(scores, len(scores) - k)[len(scores) - k]
                    near = scores >= last - 1e-9 * max(1.0, abs(last))
                    rows, scores = rows[near], scores[near]
                tops[i] = rows, scores
                cosine = np.clip(last / max(norms[i] * self.top, 1e-300), -1, 1)
                if look_only or not length or self.met_chance(length, np.arccos(cosine)) >= RECALL:
                    exact = _dot(self.x[rows], np.broadcast_to(q[place], (len(rows), q.shape[1])))
                    first = np.lexsort((self.rows[rows], self.ids[rows], -exact))[:k]
                    # one row more, of no vector, says how many rows were scored
                    found = [(place, -1, -np.inf, int(seen[i].sum())), *((place, r, s, 0) for r, s in zip(rows[first].tolist(), exact[first].tolist(), strict=True))]
                    out.append(tuple(np.array(c) for c in zip(*found, strict=True)))
                    waiting = waiting[waiting != i]
        return tuple(np.concatenate([o[j] for o in out]) for j in range(4))


def _dot(a, b):
    """Row by row inner products, summed in order in double precision, so equal rows get equal scores."""
    import numpy as np

    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _by_width(batch) -> dict:
    """(places in the batch, rows, ids, vectors) of a record batch (row, vec_id, v) for each width of its vectors; null ids come last."""
    import numpy as np
    import pyarrow.compute as pc

    rows, lists = batch.column("row").to_numpy(), batch.column("v")
    ids = pc.fill_null(batch.column("vec_id"), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for w in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == w)
        out[w] = at, rows[at], ids[at], flat[(ends[at] - w)[:, None] + np.arange(w)]
    return out


def _query_chunks(files: list[str]):
    """The stored queries, ``QUERY_CHUNK`` at a time."""
    import pyarrow.parquet as pq

    for name in files:
        store, where = filesystem(name)
        with store.open_input_file(where) as f:
            yield from pq.ParquetFile(f).iter_batches(QUERY_CHUNK)


def _met(rows: DataFrame, queries: DataFrame, top_norm: float, chances, k: int, look_only: bool) -> DataFrame:
    """(query_row, row, vec_id, score, scored): what the forests of all blocks of ``rows`` find for stored ``queries (row, vec_id, v, bound)``.

    For each query and block one row without ``row`` counts the rows that were scored.
    """
    files = queries.inputFiles()  # names only, one for each task that wrote queries

    def answers(held):
        import numpy as np
        import pyarrow as pa

        blocks = {}
        for batch in held:
            for width, (_, *part) in _by_width(batch).items():
                blocks.setdefault(width, []).append(part)
        forests = {w: Forest(*[np.concatenate(part) for part in zip(*b, strict=True)], top_norm, chances) for w, b in blocks.items()}
        for chunk in _query_chunks(files):
            bounds = chunk.column("bound").to_numpy(zero_copy_only=False)
            for width, (at, q_rows, _, q) in _by_width(chunk).items():
                if width in forests:
                    forest = forests[width]
                    places, found, score, scored = forest.search(q_rows, q, bounds[at], k, look_only)
                    met, ids = pa.array(forest.rows[found], mask=found < 0), forest.ids[found]
                    ids = pa.array(ids, mask=(found < 0) | (ids == np.iinfo(np.int64).max))
                    yield pa.record_batch([pa.array(q_rows[places]), met, ids, pa.array(score), pa.array(scored)], names=["query_row", "row", "vec_id", "score", "scored"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == BLOCK:
                    yield from answers(held)
                    held, n = [], 0
        if n:
            yield from answers(held)

    return rows.mapInArrow(run, "query_row long, row long, vec_id long, score double, scored long")


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score, n_scored): each query's ``k`` nearest of ``vectors (vec_id, embedding)``.

    ``is_query`` is a condition on vec_id; rows that share one are queries each by itself. Every other row
    is a candidate, those with a null or the same vec_id too. Nearest first, ties to the smaller vec_id,
    null last; with fewer candidates than ``k``, all of them. Vectors of different
    widths have no inner product: a query meets those of its own width only. ``n_scored`` is the
    number of rows whose vectors the query was compared with. Null, zero and non-finite vectors
    and other columns take no part; an empty table gives no row.
    """
    rows = stored(usable(vectors), "vectors")
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    top_norm, chances = float(top or 0.0) ** 0.5, collisions()
    asked = rows.where(is_query)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc_nulls_last("row"))
    looked = _met(rows, stored(asked.withColumn("bound", F.lit(float("-inf"))), "queries"), top_norm, chances, k, True)
    last = looked.withColumn("rank", F.row_number().over(order)).where((F.col("rank") == k) & F.col("row").isNotNull())
    bounded = asked.join(last.select(F.col("query_row").alias("row"), F.col("score").alias("bound")), "row", "left")
    bounded = bounded.select("row", "vec_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    met = _met(rows, stored(bounded, "bounded"), top_norm, chances, k, False)
    each = Window.partitionBy("query_row")
    ranked = met.withColumn("n_scored", F.sum("scored").over(each)).withColumn("rank", F.row_number().over(order))
    ranked = ranked.where((F.col("rank") <= k) & F.col("row").isNotNull())
    names = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query_row").select("query_id", "rank", "vec_id", "score", "n_scored")


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row of ``embeddings`` whose vec_id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
