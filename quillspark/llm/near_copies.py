"""Near copies by Jaccard similarity, for the pipeline: min-hash bands for candidates, then the exact figure.

Shingles are runs of words of the text with A-Z lower-cased; a text of fewer words is one shingle.
A text has ``BANDS`` keys, each of ``ROWS`` minima of hashed shingles; two of similarity 0.8 agree on
one at least with probability 1 - (1 - 0.8^5)^24 = 0.9999. Every candidate's similarity is counted
from the words of both whole texts, but for pairs that fewer than ``LEAST_EQUAL`` of their 120 minima
put far below it (at 0.8 that happens to 1 pair in 20 000).

A group of n copies has n^2 pairs, but n - 1 links connect it. So the texts of a key are first
compared with one of them, the key's pivot: the one that shares most keys with others. Keys whose texts are connected after that are done: no
further link of theirs could join anything. The texts of the others fall into families, which keys
connect. All pairs of texts of unlike components in a family are compared, however many they are, but
inside of tasks that hold two blocks of it: rows are texts and links there, never pairs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.components import connected_components

BANDS, ROWS, SEED = 24, 5, 42
#: The least similarity that the bands and ``LEAST_EQUAL`` are made for.
LEAST = 0.8
#: Minima (their low bytes) that a pair has in common at least: 4 deviations below the mean at 0.8.
LEAST_EQUAL = 78
#: Texts of a block of a family, of which a task compares two at once.
BLOCK = 2048
#: Shingles of the sets that a task keeps at hand while it compares pairs; of a block about as many at most.
SHINGLES_HELD = 2_000_000
#: Keys of texts that are sent to all tasks at most; more are joined, and all texts shuffled for that.
MOST_SENT = 1_000_000


def _mixed(x):
    """A 64-bit finaliser of unsigned numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _numbers():
    """Random numbers: one for each byte, and the factors and terms of the minima's hashes."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    turn, shift = rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    return rng.integers(1, 1 << 64, 256, dtype=np.uint64), turn | np.uint64(1), shift


def word_hashes(text: str | None):
    """A 64-bit hash of each word, in order: random numbers of its bytes, weighted by place, summed."""
    import numpy as np

    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    numbers = _numbers()[0]
    powers = np.cumprod(np.full(int((ends - starts).max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    kept = raw[inside]
    first = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    place = np.arange(len(kept)) - np.repeat(first, ends - starts)
    return _mixed(np.add.reduceat(numbers[kept] * powers[place], first))


def shingle_hashes(text: str | None, length: int):
    """A 64-bit hash of each run of ``length`` words, in order; none of a text without words."""
    import numpy as np

    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - length + 1)
    out = np.full(n, np.uint64(min(len(w), length)))
    for i in range(min(len(w), length)):
        out = _mixed((out ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def jaccard(x, y) -> float:
    """Share of the shingles of either set (sorted hashes) that both have; 0 without any."""
    import numpy as np

    if not len(x) or not len(y):
        return 0.0
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def sketch(text: str | None, length: int) -> tuple[int, int, int, list[int], bytes]:
    """(hash of the words, SimHash over the shingles, number of distinct ones, keys of the bands, low bytes of the minima)."""
    import numpy as np
    from xxhash import xxh64_digest

    own = xxh64_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b"", SEED)
    key = int.from_bytes(own, "big", signed=True)
    found = shingle_hashes(text, length)
    if not len(found):
        return key, 0, 0, [], b""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 8192):
        counts += np.unpackbits(found[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int.from_bytes(np.packbits(2 * counts > len(found), bitorder="little").tobytes(), "little", signed=True)
    x = np.unique(found)
    _, turn, shift = _numbers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 512):
        least = np.minimum(least, (x[i : i + 512, None] * turn + shift).min(axis=0))
    parts = least.astype("<u8").reshape(BANDS, ROWS)
    bands = [int.from_bytes(xxh64_digest(p.tobytes(), k), "big", signed=True) for k, p in enumerate(parts)]
    return key, fp, len(x), bands, least.astype(np.uint8).tobytes()


def _of_keys(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """(_key and the columns): one row for each of the stored, distinct ``keys (_key)``."""
    d = rows.select("_key", *columns).join(F.broadcast(keys) if keys.count() <= MOST_SENT else keys, "_key", "left_semi")
    return d.groupBy("_key").agg(*[F.any_value(c).alias(c) for c in columns])


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float, length: int) -> DataFrame:
    """Those ``pairs (a, b)`` of keys whose ``texts (_key, text)`` have at least the similarity."""
    of = lambda key, name: texts.select(F.col("_key").alias(key), F.col("text").alias(name))
    both = pairs.join(of("a", "ta"), "a").join(of("b", "tb"), "b").select("a", "b", "ta", "tb")

    def near(batches):
        import numpy as np
        import pyarrow as pa

        sets: dict = {}
        size = 0

        def held(key, text):
            nonlocal size
            if key not in sets:
                if size >= SHINGLES_HELD:
                    sets.clear()
                    size = 0
                sets[key] = np.unique(shingle_hashes(text.as_py(), length))
                size += len(sets[key])
            return sets[key]

        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True)
            fine = pa.array([jaccard(held(a, ta), held(b, tb)) >= similarity for a, b, ta, tb in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(fine)

    return both.mapInArrow(near, "a long, b long")


def _family_links(left: DataFrame, rows: DataFrame, similarity: float, length: int) -> DataFrame:
    """(a, b): links of at least the similarity that connect all such texts of ``left (band, e, root)`` in unlike components.

    A family is what the bands connect. Its texts are dealt into blocks by a hash, and each block goes to the tasks
    of its pairs of blocks. A task leaves out pairs that its own links have connected.
    """
    least = left.groupBy("band").agg(F.min("e._key").alias("b"))
    family = connected_components(left.join(least, "band").select(F.col("e._key").alias("a"), "b"))
    members = left.groupBy(F.col("e._key").alias("_key")).agg(F.any_value("e._n").alias("n"), F.any_value("root").alias("root"))
    members = stored(members.join(family.select(F.col("node").alias("_key"), F.col("root").alias("family")), "_key"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES_HELD)).cast("int")
    texts = _of_keys(rows, members.select("_key"), "text", "_sig").withColumnRenamed("_sig", "s")
    d = members.join(members.groupBy("family").agg(blocks.alias("blocks")), "family").join(texts, "_key")
    d = d.withColumn("block", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(other, lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    d = d.select("family", F.inline(pairs), "block", F.col("_key").alias("key"), "n", "root", "s", "text")
    dealt = d.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")

    def linked(at, rows):
        import numpy as np

        key, n, root, block = (np.array(v, dtype=np.int64) for v in list(zip(*rows, strict=True))[:4])
        minima = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        _, x, y = at
        first, second = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for k, i in enumerate(first):
            # within one block each pair once
            met = second[k + 1 :] if x == y else second
            met = met[(root[met] != root[i]) & (np.minimum(n[met], n[i]) >= (similarity - 1e-9) * np.maximum(n[met], n[i]))]
            met = met[(minima[met] == minima[i]).sum(axis=1) >= LEAST_EQUAL]
            for j in met:
                if root[i] != root[j] and jaccard(rows[i][5], rows[j][5]) >= similarity:
                    root[root == root[j]] = root[i]
                    yield int(key[i]), int(key[j])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(at, held):
            found = list(linked(at, held)) if len(held) > 1 else []
            return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        held, at = [], None
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y")), strict=True)
            numbers = zip(*(batch.column(c).to_pylist() for c in ("key", "n", "root", "block", "s")), strict=True)
            for place, own, text in zip(places, numbers, batch.column("text"), strict=True):
                if place != at:
                    yield out(at, held)
                    held, at = [], place
                held.append((*own, np.unique(shingle_hashes(text.as_py(), length))))
        yield out(at, held)

    return dealt.mapInArrow(run, "a long, b long")


def copy_links(rows: DataFrame, near: DataFrame, similarity: float, length: int) -> DataFrame:
    """(a, b): edges between keys of texts, all of at least ``similarity``, that connect all such texts.

    ``rows (text, _key, _fp, _n, _bands, _sig)``, stored, as ``sketch`` gives them; ``near (a, b)``: links
    between fingerprints, whose texts are candidates as well.
    """
    if similarity < LEAST:
        raise ValueError(f"the bands find similarities of {LEAST} and more")
    texts = rows.where("_n > 0").groupBy("_key").agg(*[F.any_value(c).alias(c) for c in ("_fp", "_n", "_bands")])
    texts = stored(texts.select(F.struct(F.xxhash64("_key").alias("h"), "_key", "_n").alias("e"), "_fp", "_bands"), "texts")
    cells = texts.select("e", F.explode("_bands").alias("band"))
    met = cells.groupBy("band").agg(F.count("*").alias("met")).where("met > 1")
    alive = stored(cells.join(met, "band"), "cells")
    # the text that meets most others over all its keys: the original among its copies
    weight = alive.groupBy("e").agg(F.sum("met").alias("weight"))
    weighed = stored(alive.join(weight, "e").select("band", "e", "weight"), "weighed")
    pivots = weighed.groupBy("band").agg(F.max_by("e", F.struct("weight", "e")).alias("p"))
    live = stored(weighed.join(pivots, "band").select("band", "e", "p"), "candidates")
    first = texts.groupBy("_fp").agg(F.min("e").alias("o"))
    of = lambda fp, e: first.select(F.col("_fp").alias(fp), F.col("o").alias(e))
    met = live.select("e", F.col("p").alias("o")).union(texts.join(first, "_fp").select("e", "o"))
    met = met.union(near.join(of("a", "e"), "a").join(of("b", "o"), "b").select("e", "o"))
    # the smaller set's share of the larger bounds the similarity
    able = F.least("e._n", "o._n") >= F.lit(similarity - 1e-9) * F.greatest("e._n", "o._n")
    met = met.where((F.col("e._key") != F.col("o._key")) & able)
    pairs = stored(met.select(F.least("e._key", "o._key").alias("a"), F.greatest("e._key", "o._key").alias("b")).distinct(), "pairs")
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct(), "named")
    links = stored(_alike(pairs, stored(_of_keys(rows, named, "text"), "held"), similarity, length), "links")
    roots = connected_components(links)
    placed = live.join(roots.select(F.col("node").alias("key"), "root"), F.col("e._key") == F.col("key"), "left")
    placed = stored(placed.select("band", "e", F.coalesce("root", "e._key").alias("root")), "placed")
    open_bands = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = stored(placed.join(open_bands, "band", "left_semi"), "open")
    return links.union(stored(_family_links(left, rows, similarity, length), "links"))
