"""Best-fit packing by length patterns and non-negative least squares (operator 3).

Spark tokenizes all texts and counts the pieces of each length; the histogram has as many entries as
a sequence has tokens, whatever the data. From it one plan is made: lengths fall into classes of
``CLASS`` tokens, all patterns of two to ``MOST_IN_PATTERN`` classes that fill a sequence are
enumerated, and non-negative least squares fits how often each is used; the counts are rounded down
and realised with exact lengths, longest first. What remains of the histogram, and the room that
the patterns leave, goes to best-fit decreasing over the histogram. The plan is a list of runs:
"pieces number r to r + n of length L go to sequences s to s + n, at offset o". Spark numbers the
pieces of each length and joins them with the runs, so sequences are assigned without gathering
anything that grows with the data.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import read, small_batches, stored
from quillspark.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Entries of a worker's caches: less than elsewhere, as the pipeline packs beside a heap that earlier stages have filled.
CACHE_ENTRIES = 60_000
#: Likewise the bytes of the texts whose words a worker numbers together.
GROUP_BYTES = 4_000_000
#: Width of a length class in tokens, and the most pieces of a pattern.
CLASS, MOST_IN_PATTERN = 8, 3


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with the end id, cut at ``capacity``.

    Null text is empty and has the end id alone. Rows that share a doc_id are packed each by itself.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches):
        import pyarrow as pa

        enc, end, step = encoder(tokenizer, CACHE_ENTRIES), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            at, number, start, length, crc = [], [], [], [], []
            for row, found in enumerate(enc.encode_all(batch.column("text"), GROUP_BYTES)):
                ids = found + end
                for k, i in enumerate(range(0, len(ids), step)):
                    part = ids[i : i + step]
                    at.append(row)
                    number.append(k)
                    start.append(k * capacity)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        enc.forget()  # the worker goes on to other stages

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(classes: int, most: int):
    """All ascending tuples of 2 to ``most`` class numbers (1 to ``classes``) that sum to ``classes``, padded with 0."""
    import numpy as np

    done, open_ = [], [((), 0)]
    while open_:
        chosen, total = open_.pop()
        low = chosen[-1] if chosen else 1
        if len(chosen) + 1 >= 2 and classes - total >= low:
            done.append((*chosen, classes - total))
        if len(chosen) + 1 < most:
            open_ += [((*chosen, c), total + c) for c in range(low, (classes - total) // 2 + 1)]
    out = np.zeros((len(done), most), dtype=np.int64)
    for i, p in enumerate(done):
        out[i, : len(p)] = p
    return out


def nnls(pats, counts, rounds: int = 600):
    """Least squares of patterns' repeats to class counts, none negative, by active sets (Lawson and Hanson).

    ``pats`` rows list class numbers, 0 is padding; ``counts[c]`` is the wanted number of class c.
    """
    import numpy as np

    size, target = len(counts), counts.astype(float)
    target[0] = 0
    active: list[int] = []
    x = np.zeros(0)
    matrix = np.zeros((size, 0))
    for _ in range(rounds):
        rest = target - matrix @ x
        gain = np.where(pats > 0, rest[pats], 0).sum(axis=1)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-6 * max(1.0, target.max()):
            break
        active.append(best)
        matrix = np.column_stack([matrix, np.bincount(pats[best][pats[best] > 0], minlength=size)])
        x = np.append(x, 0.0)
        while active:
            gram = matrix.T @ matrix + 1e-9 * np.eye(len(active))
            fit = np.linalg.solve(gram, matrix.T @ target)
            low = fit <= 1e-9
            if not low.any():
                x = fit
                break
            step = np.min(x[low] / np.maximum(x[low] - fit[low], 1e-300))
            x = x + min(step, 1.0) * (fit - x)
            keep = x > 1e-9
            if keep.all():
                keep[np.flatnonzero(low)[x[low].argmin()]] = False
            active = [a for a, k in zip(active, keep, strict=True) if k]
            matrix, x = matrix[:, keep], x[keep]
    out = np.zeros(len(pats))
    out[active] = x
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = CLASS, most: int = MOST_IN_PATTERN):
    """Runs (length, first, n, sequence, offset) that place every piece of ``histogram``, and the sequences' number.

    Pieces of a length are used in the order of their numbers. The list has a few runs for each
    length and pattern, whatever the counts.
    """
    import numpy as np

    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, number)
    order: list[int] = []  # the rooms that are there, ascending

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    def leave(room: int, sequence: int, n: int) -> None:
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((sequence, n))

    classes = capacity // width
    counts = np.zeros(classes + 1)
    for length, c in left.items():
        if length < capacity:
            counts[-(-length // width)] += c
    counts[classes] = 0
    if counts.any():
        pats = patterns(classes, most)
        repeats = np.floor(nnls(pats, counts) + 1e-9).astype(int)
        by_class: dict[int, list[int]] = {}
        for length in sorted(left):
            by_class.setdefault(-(-length // width), []).append(length)  # the longest is taken first, from the end
        for p in np.flatnonzero(repeats):
            slots, todo = [int(c) for c in sorted(pats[p], reverse=True) if c], int(repeats[p])
            while todo:
                lengths = []
                for c in slots:
                    while by_class.get(c) and not left[by_class[c][-1]]:
                        by_class[c].pop()
                    lengths.append(by_class[c][-1] if by_class.get(c) else None)
                if None in lengths:
                    break
                n = min(todo, *(left[x] // lengths.count(x) for x in lengths))
                if not n:  # one piece is left where two are asked for; best fit takes it
                    break
                at = 0
                for length in lengths:
                    put(length, n, sequences, at)
                    at += length
                leave(capacity - at, sequences, n)
                sequences += n
                todo -= n
    for length in sorted(left, reverse=True):
        while left[length]:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                room = order[i]
                sequence, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[i]
                take = min(n, left[length])
                if take < n:
                    leave(room, sequence + take, n - take)
                put(length, take, sequence, capacity - room)
                leave(room - length, sequence, take)
            else:
                each = capacity // length
                n = max(1, left[length] // each)
                for k in range(each if left[length] >= each else left[length]):
                    put(length, n, sequences, k * length)
                    at = (k + 1) * length
                leave(capacity - at, sequences, n)
                sequences += n
    return runs, sequences


def assign(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces, in a stored table) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    numbered = found.withColumn("part", F.spark_partition_id())
    # rows with the same values in all columns are interchangeable, so the order is the same in every attempt
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = stored(numbered.withColumn("k", F.row_number().over(within) - 1), "numbered")
    sizes = numbered.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, at long")
    ranked = numbered.join(sizes.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("k"))
    # a few runs for each length: bounded by the lengths and patterns there are, not by the data
    placed = ranked.join(
        F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    )
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document of ``docs`` (doc_id, text) goes; an empty table gives no row."""
    return assign(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens of the word vocabulary."""
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
