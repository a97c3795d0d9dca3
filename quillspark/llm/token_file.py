"""Token-ID output (operator 10): Arrow files of fixed-size-list batches, and their reader.

Documents are dealt out by ranges of ``doc_id``; each partition writes its token stream, cut into
sequences of equal length, as one Arrow file of record batches ``(ids fixed_size_list<uint, S>,
mask fixed_size_list<bool, S>)``. Only a file's last sequence is padded, with mask false there. All
batches but the last hold ``BATCH_SEQUENCES`` sequences, so sequence k of a file is row
``k % BATCH_SEQUENCES`` of batch ``k // BATCH_SEQUENCES``: random access is arithmetic and, on a
memory-mapped file, copies nothing. A second, small Arrow file lists ``(doc_id, start, n_tokens)``.

A retried or doubled task writes files of another name; only the names in the manifest, which the
winning attempts return, are read.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpoint, filesystem, read, small_batches, work_dir
from quillspark.llm.tokens import encoder, tokenizer_path

SEQUENCE = 1024
BATCH_SEQUENCES = 256
END_ID = 0


class _Stream:
    """Collects ids and writes full batches as they fill, so a partition's tokens are never all in memory."""

    def __init__(self, sink, dtype, sequence: int):
        import numpy as np
        import pyarrow as pa

        self.np, self.pa, self.dtype, self.sequence = np, pa, dtype, sequence
        self.kind = pa.from_numpy_dtype(dtype)
        schema = pa.schema([("ids", pa.list_(self.kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        full = self.sequence * BATCH_SEQUENCES
        if self.n_held >= full:
            flat = self.np.concatenate(self.held)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i : i + full], full)
            rest = flat[len(flat) - len(flat) % full :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _write(self, ids, n: int) -> None:
        pa = self.pa
        mask = self.np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, names=["ids", "mask"]))

    def close(self) -> None:
        if self.n_held:
            flat = self.np.concatenate(self.held)
            padded = self.np.zeros(-(-len(flat) // self.sequence) * self.sequence, dtype=self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


class TokenFile:
    """Random access to one written file: a sequence, its mask, or any range of the token stream."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        store, where = filesystem(path)
        source = pa.memory_map(where) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(where)
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size

    def _column(self, name: str, k: int):
        return self.reader.get_batch(k // BATCH_SEQUENCES).column(name).slice(k % BATCH_SEQUENCES, 1)

    def ids(self, k: int):
        """The ids of sequence ``k``, a view of the file."""
        return self._column("ids", k).flatten().to_numpy(zero_copy_only=True)

    def mask(self, k: int):
        """True where sequence ``k`` holds tokens, false in its padding; unpacked from the file's bits."""
        return self.mask_view(k).to_numpy(zero_copy_only=False)

    def mask_view(self, k: int):
        """The mask of sequence ``k`` as an Arrow array over the file's own bits, nothing copied."""
        return self._column("mask", k).flatten()

    def batch(self, b: int):
        """All ids of batch ``b`` in a row, a view of the file."""
        return self.reader.get_batch(b).column("ids").flatten().to_numpy(zero_copy_only=True)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, sequence: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """Writes the token files of ``docs (doc_id, text)`` under ``path``; returns the manifest, checkpointed.

    Manifest: part (ascending with doc_id), path, index_path, n_docs, n_tokens, base (tokens of all
    earlier parts). Null text is empty and gives the end id alone; equal doc_ids are ordered by text;
    null doc_ids come first; an empty table gives no file. Other columns are ignored.
    """

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, index_name = f"{path}/part-{part:06d}-{tag}.arrow", f"{path}/part-{part:06d}-{tag}.docs.arrow"
        stream = index = None
        enc, n_docs = encoder(tokenizer), 0
        dtype = np.uint16 if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        end = np.array([end_id], dtype=dtype)
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                store, where = filesystem(name)
                store.create_dir(where.rpartition("/")[0], recursive=True)
                sinks = store.open_output_stream(where), store.open_output_stream(filesystem(index_name)[1])
                stream, index = _Stream(sinks[0], dtype, sequence), pa.ipc.new_file(sinks[1], index_schema)
            starts, counts = [], []
            for found in enc.encode_all(batch.column("text")):
                ids = np.frombuffer(found, dtype="<u4").astype(dtype)
                starts.append(stream.total)
                counts.append(len(ids) + 1)
                stream.add(ids)
                stream.add(end)
            n_docs += batch.num_rows
            index.write_batch(
                pa.record_batch(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                    schema=index_schema,
                )
            )
        if stream is not None:
            stream.close()
            index.close()
            for sink in sinks:
                sink.close()
            row = {"part": part, "path": name, "index_path": index_name, "n_docs": n_docs, "n_tokens": stream.total}
            yield pa.RecordBatch.from_pylist([row])

    small_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part long, path string, index_path string, n_docs long, n_tokens long"
    manifest = checkpoint(ordered.mapInArrow(write, schema))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (over all files), n_tokens, ids_crc32.

    The CRC is of the ids as little-endian unsigned 32-bit integers, the end id included.
    """

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for item in batch.to_pylist():
                file = TokenFile(item["path"])
                size, at, held = file.sequence * BATCH_SEQUENCES, -1, None
                store, where = filesystem(item["index_path"])
                with store.open_input_file(where) as f:
                    index = pa.ipc.open_file(f)
                    for b in range(index.num_record_batches):
                        docs = index.get_batch(b)
                        starts, counts = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                        crcs = []
                        for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
                            crc, done = 0, 0
                            while done < n:
                                if (start + done) // size != at:
                                    at = (start + done) // size
                                    held = file.batch(at)
                                i = (start + done) % size
                                view = held[i : min(i + n - done, size)]
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                                done += len(view)
                            crcs.append(crc)
                        yield pa.record_batch(
                            [docs.column("doc_id"), pa.array(starts + np.int64(item["base"])), docs.column("n_tokens"), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    dealt = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return dealt.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written with the byte-level vocabulary, read back from the files."""
    docs = read(spark, sf_dir, "documents")
    manifest = write_token_files(docs, work_dir(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(manifest)
