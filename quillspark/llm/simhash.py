"""SimHash near-duplicates by a binary trie self-join (operator 4).

Fingerprints: 3-word shingles of the text with A-Z lower-cased, hashed by XXH64 (seed 42); a bit is
set if it is set in over half of the hashes. Null, empty and wordless texts have fingerprint 0,
which links like any other; texts of one or two words are one shingle.

Self-join: equal fingerprints are one entry. Two entries within 3 bits agree on one of the four
16-bit blocks at least, so each entry goes to four forests, keyed by (block's number, block's
value); each key is the top of a binary trie over the entry rotated so that the block comes first.
Tries are sorted arrays, nodes are intervals of them. All tries of a task are walked level by level:
pairs of nodes descend together, a pair of unlike children costs one bit, and a pair that has cost
more than 3 is dropped. Links found are merged within the task at once, and one edge for each linked
entry goes on, never all pairs of a group. Entries in a key that holds more than ``MOST_IN_TRIE`` are
dealt again by the same argument on their other bits: four parts of 12 of the 48, then of 9 of the
36, and so on while 16 bits are left. No partner is lost, and a task holds a few keys at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quillspark.llm.common import read, small_batches, stored
from quillspark.llm.components import connected_components
from quillspark.llm.near_copies import copy_links, sketch

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
#: Entries of a trie beyond which its key is split by a second block.
MOST_IN_TRIE = 50_000
#: Pairs of nodes walked at once; a longer frontier is split and the rest waits.
FRONTIER = 1_000_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as an unsigned number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= SHINGLE:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - SHINGLE + 1]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(raw), 8192):
        counts += np.unpackbits(raw[i : i + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed long."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, fp long")


def _merge(label, i, j):
    """Gives linked places of ``label`` one least label; labels point at places."""
    import numpy as np

    while True:
        a, b = label[i], label[j]
        unlike = a != b
        if not unlike.any():
            return
        i, j, a, b = i[unlike], j[unlike], a[unlike], b[unlike]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_links(group, x, first_bit: int, budget: int = BUDGET):
    """For each entry the place of the least entry that links reach, within its group.

    ``x``: entries, distinct within a group and sorted within it; groups lie together and agree on
    the first ``first_bit`` bits.
    """
    import numpy as np

    label = np.arange(len(x))
    if len(x) < 2:
        return label
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    waiting = [(first_bit, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    while waiting:
        depth, alo, ahi, blo, bhi, err = waiting.pop()
        while len(alo):
            if len(alo) > FRONTIER:
                half = len(alo) // 2
                waiting.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
                alo, ahi, blo, bhi, err = alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]
                continue
            leaf = (ahi - alo == 1) & (bhi - blo == 1)
            if leaf.any():
                i, j = alo[leaf], blo[leaf]
                near = np.bitwise_count(x[i] ^ x[j]) <= budget
                _merge(label, i[near], j[near])
                alo, ahi, blo, bhi, err = (v[~leaf] for v in (alo, ahi, blo, bhi, err))
            if not len(alo) or depth == BITS:
                break
            ones = np.concatenate(([0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)))
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            own = alo == blo
            parts = [
                (alo, amid, blo, bmid, err, None),
                (amid, ahi, bmid, bhi, err, None),
                (alo, amid, bmid, bhi, err + 1, None),
                (amid, ahi, blo, bmid, err + 1, ~own),
            ]
            kept = []
            for a0, a1, b0, b1, e, when in parts:
                ok = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
                ok = ok if when is None else ok & when
                kept.append((a0[ok], a1[ok], b0[ok], b1[ok], e[ok]))
            alo, ahi, blo, bhi, err = (np.concatenate(v) for v in zip(*kept, strict=True))
            depth += 1
    return label


def _walk(first_bit: int):
    """A task's walk over its tries: (key, x, fp) rows sorted by key in, one (a, b) row for each linked entry out.

    Whole keys are taken as soon as ``MOST_IN_TRIE`` rows are held, so memory does not grow with the task.
    """

    def links(table, first_bit):
        import numpy as np
        import pyarrow as pa

        key, x = table.column("key").to_numpy(), table.column("x").to_numpy().view(np.uint64)
        order = np.lexsort((x, key))
        key, x, fp = key[order], x[order], table.column("fp").to_numpy()[order]
        root = trie_links(key, x, first_bit)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            start = int(np.searchsorted(key, key[-1]))  # rows before it belong to keys that are complete
            if n + start >= MOST_IN_TRIE and (start or held):
                if start:
                    held.append(batch.slice(0, start))
                elif held[-1].column("key")[held[-1].num_rows - 1].as_py() == key[0]:
                    held, n = [*held, batch], n + batch.num_rows
                    continue
                yield links(pa.Table.from_batches(held), first_bit)
                held, n, batch = [], 0, batch.slice(start)
            held, n = [*held, batch], n + batch.num_rows
        if held:
            yield links(pa.Table.from_batches(held), first_bit)

    return run


def _rotated(x, bits: int, part: int, width: int):
    """The low ``bits`` of ``x`` turned left so that part number ``part`` comes first, at the top of 64 bits."""
    turn = part * width
    mask = (1 << bits) - 1
    low = x.bitwiseAND(F.lit(mask if bits < 64 else -1))
    if not turn:
        moved = low
    else:
        moved = F.shiftleft(low, turn).bitwiseOR(F.shiftrightunsigned(low, bits - turn)).bitwiseAND(F.lit(mask if bits < 64 else -1))
    return F.shiftleft(moved, 64 - bits) if bits < 64 else moved


def near_links(entries: DataFrame, most: int = MOST_IN_TRIE) -> DataFrame:
    """(a, b): edges between the fingerprints of ``entries (fp)``, distinct, enough to connect all that link."""
    blocks = [
        F.struct(x.alias("x"), F.shiftrightunsigned(x, 48).bitwiseOR(F.lit(k << 16)).alias("key"))
        for k, x in enumerate(_rotated(F.col("fp"), 64, k, 16) for k in range(4))
    ]
    dealt, bits, links = entries.select("fp", F.inline(F.array(*blocks))), 64, None
    walked = lambda d, first: d.select("key", "x", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_walk(first), "a long, b long")
    while True:
        large = stored(dealt.groupBy("key").count().where(F.col("count") > most).select("key", F.lit(True).alias("large")), "large")
        last = bits - bits // 4 < 16 or large.isEmpty()
        marked = dealt if last else dealt.join(large, "key", "left")
        small = walked(marked if last else marked.where("large is null"), 16 if bits == 64 else 0)
        links = small if links is None else links.union(small)
        if last:
            return links
        # a quarter of the bits agrees, and the rest may differ in 3: one of its four parts agrees as well
        agreed, bits = bits // 4, bits - bits // 4
        rest, width = F.shiftrightunsigned(F.shiftleft("x", agreed), 64 - bits), bits // 4
        parts = [
            F.struct(F.xxhash64("key", F.lit(k), F.shiftrightunsigned(y, 64 - width)).alias("key"), y.alias("x"))
            for k, y in enumerate(_rotated(rest, bits, k, width) for k in range(4))
        ]
        dealt = stored(marked.where("large").select("fp", F.inline(F.array(*parts))), "deeper")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    Components join all rows that links reach; component_id is their smallest doc_id. Null doc_ids
    do not count for it (a component of such rows alone has null). An empty table gives no row.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    entries = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(entries.select("fp")))
    of = entries.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    of = stored(of.select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = stored(of.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = stored(of.join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _tagged(docs: DataFrame, shingle: int | None) -> DataFrame:
    """``docs`` with ``_fp`` and, for shingles of so many words, ``_key``, ``_n``, ``_bands`` and ``_sig`` of ``near_copies.sketch``."""

    def rows(batches):
        import pyarrow as pa

        def of(text):
            if shingle:
                return sketch(text, shingle)
            x = fingerprint(text)
            signed = x - (1 << 64) if x >> 63 else x
            return signed, signed, 0, [], b""

        for batch in batches:
            found = [of(t.as_py()) for t in batch.column("text")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, "_key", "_fp", "_n", "_bands", "_sig"])

    schema = StructType([*docs.schema.fields]).add("_key", "long").add("_fp", "long").add("_n", "long").add("_bands", ArrayType(LongType())).add("_sig", "binary")
    return docs.mapInArrow(rows, schema)


def drop_near_duplicates(docs: DataFrame, similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id, whatever other components hold that id.

    Without ``similarity`` the links are those of ``near_duplicates``. With it, texts are linked whose
    sets of ``shingle``-word runs have at least that Jaccard similarity; candidates are the links of
    fingerprints over those runs and the bands of ``near_copies``. Texts of the same words are one. A
    component without any doc_id keeps one of its rows; of repeated rows one stays; null, empty and
    wordless texts are one component.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct("*").alias("_doc"), "doc_id", "text")
    rows = stored(_tagged(packed, shingle if similarity is not None else None).withColumn("_row", F.monotonically_increasing_id()), "tagged")
    links = near_links(rows.select(F.col("_fp").alias("fp")).distinct())
    if similarity is not None:
        links = copy_links(rows, stored(links, "near"), similarity, shingle)
    roots = connected_components(links).select("node", "root")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_row")
    entries = rows.groupBy(F.col("_fp" if similarity is None else "_key").alias("node")).agg(F.min(best).alias("best"))
    kept = entries.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    # the rows that go are far fewer than those that stay
    gone = stored(rows.select("_row").join(kept.select(F.col("best._row").alias("_row")), "_row", "left_anti"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"_doc.`{c}`").alias(c) for c in names])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    d = near_duplicates(read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
