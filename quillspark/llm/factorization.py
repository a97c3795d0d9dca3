"""Quality classifier: a factorisation machine over words, structure and metadata (operator 6).

Inputs of a document are its hashed lower-cased words (square roots of their shares, of norm 1),
statistics of its structure, and the ``n_chars`` that the table states (absent or null: the text's
own length). All pairs of inputs interact through vectors of ``RANK`` numbers, and a score takes time
linear in the inputs by the identity sum_{i<j} <v_i, v_j> x_i x_j = ((sum v x)^2 - sum v^2 x^2) / 2.

The machine is fitted on the driver on at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hash of doc_id among the rows that are not held out; what is gathered is bounded by that
number times the ``BUCKETS`` of a row. Scoring is a map over all rows. Labels, lang, source and
doc_id are no inputs. Null and empty texts get the score of their (zero) statistics. Without labels
of both kinds the score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, small_batches
from quillspark.llm.tokens import _Cache

BUCKETS, RANK = 1 << 16, 8
TRAIN_ROWS = 6_000
#: Words whose buckets a worker keeps at hand.
WORDS_HELD = 100_000
EPOCHS, RATE, DECAY = 8, 0.1, 1e-5
#: Documents from this score on are predicted to be of label 1.
CUTOFF = 0.7
STATS = 12
_SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's digits leaves 2 by 4 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _buckets() -> _Cache:
    return _Cache(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS, WORDS_HELD)


@lru_cache(maxsize=1)
def _kinds():
    """By Latin-1 code: is it an upper-case letter, a digit."""
    import numpy as np

    codes = [chr(i) for i in range(256)]
    return np.array([c.isupper() for c in codes]), np.array([c.isdigit() for c in codes])


def inputs(text: str | None, n_chars: int | None):
    """(buckets, values, statistics) of one document."""
    from collections import Counter

    import numpy as np

    text = text or ""
    words = _WORD.findall(text.lower())
    counts = Counter(words)
    n, total = len(words), max(1, len(words))
    idx = np.fromiter(map(_buckets().__getitem__, counts), dtype=np.int64, count=len(counts))
    idx, place = np.unique(idx, return_inverse=True)  # words that share a bucket are one input
    val = np.sqrt(np.bincount(place, np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), len(idx)) / total)
    raw = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
    upper, digit = _kinds()
    chars = max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    stats = [
        np.log1p(n),
        sum(map(len, words)) / total,
        sum(map(text.count, _SYMBOLS)) / total,
        text.count("!") / total,
        text.count("|") / total,
        upper[raw].sum() / chars,
        digit[raw].sum() / chars,
        len(counts) / total,
        max(counts.values(), default=0) / total,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / total,
        np.log1p(max(0, n_chars if n_chars is not None else len(text))),
    ]
    return idx, val, np.array(stats)


class Machine:
    """The fitted parameters; statistics follow the buckets as inputs of their own."""

    def __init__(self, bias: float, mean, scale, w, v):
        self.bias, self.mean, self.scale, self.w, self.v = bias, mean, scale, w, v

    def row(self, idx, val, stats):
        """All inputs of a row, the statistics brought to unit scale and clipped."""
        import numpy as np

        scaled = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        return np.concatenate([idx, np.arange(BUCKETS, BUCKETS + STATS)]), np.concatenate([val, scaled])

    def raw(self, idx, x):
        """The score before the logistic function, and the sum that its gradient needs."""
        v = self.v[idx]
        s = x @ v
        return self.bias + self.w[idx] @ x + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1)), s, v

    def score(self, text: str | None, n_chars: int | None) -> float:
        """Probability of label 1."""
        import numpy as np

        z = self.raw(*self.row(*inputs(text, n_chars)))[0]
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple], labels: list[int], seed: int = 1) -> Machine:
    """Adaptive-step gradient descent on the logistic loss; ``rows`` as ``inputs`` returns them."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = BUCKETS + STATS
    stats = np.array([r[2] for r in rows]).reshape(-1, STATS)
    mean = stats.mean(axis=0) if len(rows) else np.zeros(STATS)
    scale = np.maximum(stats.std(axis=0), 1e-3) if len(rows) else np.ones(STATS)
    share = (sum(labels) + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), mean, scale, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if len(set(labels)) < 2:
        m.v[:] = 0
        return m
    data = [m.row(*r) for r in rows]
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)).tolist():
            idx, x = data[i]
            z, s, v = m.raw(idx, x)
            err = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[i]
            gb += err * err
            m.bias -= RATE * err / gb**0.5
            d = err * x + DECAY * m.w[idx]
            gw[idx] += d * d
            m.w[idx] -= RATE * d / np.sqrt(gw[idx])
            d = err * (x[:, None] * s - (x * x)[:, None] * v) + DECAY * v
            gv[idx] += d * d
            m.v[idx] -= RATE * d / np.sqrt(gv[idx])
    return m


def _with_length(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.withColumn("n_chars", stated)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``rows`` of the labelled documents that are not held out."""
    import numpy as np

    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            found = [inputs(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"), strict=True)]
            lists = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())))]
            yield pa.record_batch([*lists, batch.column("label"), batch.column("doc_id")], names=["idx", "val", "stats", "label", "doc_id"])

    small_batches(docs.sparkSession)
    # at most `rows` rows of two numbers are broadcast
    sample = _with_length(docs).select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")
    # of rows that share a doc_id one teaches, so what is gathered stays within the bound
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "label", "d.text", "d.n_chars")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"idx array<int>, val array<double>, stats array<double>, label int, doc_id {kind}"
    got = sample.select("text", "n_chars", "label", "doc_id").mapInArrow(features, schema).toArrow().sort_by("doc_id")
    columns = [[np.asarray(x.values) for x in got.column(c)] for c in ("idx", "val", "stats")]
    return fit(list(zip(*columns, strict=True)), got.column("label").to_pylist())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` as the last column, in place of any column of that name; repeated rows are scored each."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [c for c in docs.columns if c != "score"]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            texts, sizes = batch.column("__text"), batch.column("__n_chars")
            found = [shared.value.score(t.as_py(), n.as_py()) for t, n in zip(texts, sizes, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["__doc", "__score"])

    n_chars = F.col("__doc.n_chars").cast("long") if "n_chars" in names else F.lit(None).cast("long")
    packed = docs.select(F.struct("*").alias("__doc")).select("__doc", F.col("__doc.text").alias("__text"), n_chars.alias("__n_chars"))
    schema = packed.select("__doc").schema.add("__score", "double")
    out = packed.mapInArrow(rows, schema)
    return out.select(*[F.col(f"__doc.`{c}`").alias(c) for c in names], F.col("__score").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more, columns unchanged."""
    scored = score(docs.withColumn("__row", F.struct("*")).select("__row", "text", *(["n_chars"] if "n_chars" in docs.columns else [])), train(docs, labels))
    return scored.where(F.col("score") >= cutoff).select("__row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = train(docs, read(spark, sf_dir, "labels"))
    d = score(docs, machine)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
