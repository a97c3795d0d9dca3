"""Document fingerprints by consistent weighted sampling (operator 11), in DataFrame functions only.

A text's terms are its runs of ``SHINGLE`` words, as they stand, with the number of their occurrences
as weight; a text of fewer words is one term, one without words has none. For each of ``SAMPLES``
samples, every term draws from its hash r and c of a Gamma(2, 1) distribution and b of a uniform one;
with weight w it gets t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)). The sample is
the term and t of the least a. Two texts draw the same sample with the probability of their
generalised Jaccard similarity (sum of lesser weights over sum of greater ones), so the share of equal
samples estimates it without bias; its standard error is at most 0.5 / sqrt(``SAMPLES``).

A sample is kept as 16 bits of its hash, so unlike ones agree once in 65 536; the fingerprint is their
hexadecimal digits. ln a is compared to 40 binary places, together with those bits, as one long, so
that a sample is a plain minimum inside a hash aggregation. The least a of a text of total weight W is
exponential with rate W, so it passes ``RARELY / W`` once in e**24 times; draws that a bound without
logarithms shows to lie beyond are not worked out (if all of a text do, its sample is that of the least bound). A text of no words has the fingerprint
"", alike to "" alone. Weights over 32 767 are rounded to 0.2 %.

Null texts are empty. Documents are in order of doc_id, nulls first; of equal doc_ids that of the
texts' hash. Rows are repeated as they are (a table that is read for ``with_next`` must come in the
same order each time, as a stored one does); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import read, stored, words_of

SHINGLE, SAMPLES, SEED = 5, 48, 42
#: Ranges of the order of documents, and documents that their bounds are taken from.
RANGES, SAMPLED = 4096, 65_536
#: Draws over this many times the mean least draw of a text are not worked out.
RARELY = 24.0
#: Bits of a term's hash that hold its weight.
WEIGHT_BITS, EXACT = 16, 32_767


def _weight_code(n: Column) -> Column:
    """A weight in 16 bits: itself, or beyond ``EXACT`` its logarithm in steps of 1/500."""
    return F.when(n <= EXACT, n).otherwise(EXACT + F.round(500 * F.log(n.cast("double"))).cast("long"))


def with_terms(d: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``d`` with, for each pair of names, an array of the text's terms, distinct hashes whose last 16 bits are the weight's code, and ``<name>_size``, their number with repeats."""
    mask = F.lit(-1 << WEIGHT_BITS)
    kept = [c for c in d.columns if c not in texts]
    d = d.select(*kept, *[words_of(F.col(t)).alias(f"_{name}") for t, name in texts.items()])

    def shingles(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(
            F.slice(words, SHINGLE, F.greatest(n - SHINGLE + 1, F.lit(1))),
            lambda last, i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE - 1)], last).bitwiseAND(mask),
        )
        whole = F.array(F.xxhash64(F.array_join(words, " "), F.lit(1)).bitwiseAND(mask))
        return F.when(n >= SHINGLE, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    d = d.select(*kept, *[shingles(F.col(f"_{name}")).alias(f"_{name}") for name in texts.values()])
    repeats = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    d = d.select(*kept, *[F.when(repeats(F.col(f"_{n}")), F.sort_array(f"_{n}")).otherwise(F.col(f"_{n}")).alias(f"_{n}") for n in texts.values()])
    d = d.select(*kept, *[f"_{n}" for n in texts.values()], *[repeats(F.col(f"_{n}")).alias(f"_{n}_repeats") for n in texts.values()])

    def starts(a: Column) -> Column:
        """Where the runs of equal hashes begin, in sorted order."""
        return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))

    d = d.select("*", *[F.when(F.col(f"_{n}_repeats"), starts(F.col(f"_{n}"))).alias(f"_{n}_starts") for n in texts.values()])

    def terms(name: str) -> Column:
        a, runs = F.col(f"_{name}"), F.col(f"_{name}_starts")
        size = lambda at, j: (F.coalesce(F.get(runs, j + 1), F.size(a)) - at).cast("long")
        many = F.transform(runs, lambda at, j: F.get(a, at).bitwiseOR(_weight_code(size(at, j))))
        return F.when(F.col(f"_{name}_repeats"), many).otherwise(F.transform(a, lambda h: h.bitwiseOR(F.lit(1))))

    return d.select(*kept, *[terms(n).alias(n) for n in texts.values()], *[F.size(f"_{n}").alias(f"{n}_size") for n in texts.values()])


def _uniform(bits: Column, width: int) -> Column:
    """A number in (0, 1) from an unsigned one of ``width`` bits."""
    return (bits.cast("double") + 0.5) * (1.0 / (1 << width))


def sample(term: Column, code: Column, most: Column, k: int) -> Column:
    """Sample ``k`` of one term as a long: ln a to 40 binary places, then 16 bits that name the term and its t.

    a is at least c exp(-r) / w, and c at least 1 - exp(-c): where that passes ``most``, it stands for a, after all others.
    """
    g = F.xxhash64(term, F.lit(k), F.lit(SEED))
    h = F.xxhash64(g)
    part = lambda at: _uniform(F.shiftrightunsigned(h, at).bitwiseAND(F.lit(0x1FFFFF)), 21)
    u, v = _uniform(F.shiftrightunsigned(g, 32), 32) * _uniform(g.bitwiseAND(F.lit(0xFFFFFFFF)), 32), part(0) * part(21)
    log_weight = F.when(code == 1, 0.0).when(code <= EXACT, F.log(code.cast("double"))).otherwise((code - EXACT) / 500.0)
    weight = F.when(code <= EXACT, code.cast("double")).otherwise(F.exp((code - EXACT) / 500.0))
    r, c, b = -F.log(u), -F.log(v), part(42)
    t = F.when(code == 1, F.lit(0).cast("long")).otherwise(F.floor(log_weight / r + b))
    log_a = F.log(c) - r * (t - b) - r
    name = F.shiftrightunsigned(g, 17)
    of = lambda x, n: F.shiftleft(F.floor(x * float(1 << 39)), 16).bitwiseOR(n.bitwiseAND(F.lit(0xFFFF)))
    # ln a lies within (-64, 64): c is 2**-43 at least, and weights are below exp(40)
    beyond = (1 - v) * u
    return F.when(beyond > most * weight, of(128.0 + F.least(beyond, F.lit(1.0)), name)).otherwise(of(log_a + 64.0, name + t * 40_503))


def _samples(d: DataFrame, keys: list[str], terms: str, most: str, samples: int) -> DataFrame:
    """``keys`` and s0, s1, ...: the least of each sample over the terms of all rows of the keys; null without terms."""
    d = d.select(*keys, most, F.explode_outer(terms).alias("code"))
    low = F.lit((1 << WEIGHT_BITS) - 1)
    d = d.select(*keys, most, F.col("code").bitwiseAND(F.bitwise_not(low)).alias("term"), F.col("code").bitwiseAND(low).alias("code"))
    return d.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("code"), F.col(most), k)).alias(f"s{k}") for k in range(samples)])


def _most(*sizes: Column) -> Column:
    """The bound of draws for texts of so many terms, repeats included."""
    return RARELY / F.greatest(F.lit(1), F.least(*sizes, F.lit(1 << 62)))


def _digits(samples: list[Column]) -> Column:
    """The fingerprint of a text from its samples."""
    parts = [F.lower(F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFF))), 4, "0")) for s in samples]
    return F.when(samples[0].isNull(), F.lit("")).otherwise(F.concat(*parts))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal samples of two fingerprints; 1 of two empty ones, 0 if one alone is empty."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.length(x), F.lit(4)), lambda i: F.substring(x, i, 4) == F.substring(y, i, 4)))
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(same / (F.length(x) / 4))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; texts stay where they are, only samples are shuffled."""
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_terms(d, {"text": "terms"}).withColumn("most", _most(F.col("terms_size")))
    found = _samples(d, ["row", "doc_id"], "terms", "most", samples)
    return found.select("doc_id", _digits([F.col(f"s{k}") for k in range(samples)]).alias("fingerprint"))


def _place(bounds: Column, n: int, key: Column) -> Column:
    """How many of ``n`` sorted bounds do not exceed the key, by halving."""
    low, high = F.lit(0), F.lit(n)

    def halved(s: Column, _) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = (s["low"] < s["high"]) & (F.get(bounds, middle) <= key)
        left = (s["low"] < s["high"]) & ~(F.get(bounds, middle) <= key)
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(left, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(n.bit_length()))
    return F.aggregate(steps, F.struct(low.alias("low"), high.alias("high")), halved, lambda s: s["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """(range, row, doc_id, text, next_row, next_text): each document with the one after it, the last with the first.

    The order is cut into ranges at documents of a bounded sample, so that each range is sorted by
    itself; equal doc_ids are cut by their texts' hash and their rows. A range ends with a copy of the
    first document of the next one. At most ``RANGES`` keys go through the driver.
    """
    spark = docs.sparkSession
    key = F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", F.xxhash64("text").alias("hash"), F.col("row"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("key", key)
    some = [tuple(r["key"]) for r in d.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLED).collect()]
    some.sort(key=lambda k: (k[0], k[1] if k[0] else 0, *k[2:]))
    cuts = [some[i * len(some) // RANGES] for i in range(1, RANGES)] if len(some) > RANGES else some[1:]
    fields = [f.name for f in d.schema["key"].dataType.fields]
    bounds = F.from_json(F.lit(json.dumps([dict(zip(fields, c, strict=True)) for c in cuts])), f"array<{dict(d.dtypes)['key']}>")
    d = d.withColumn("range", _place(bounds, len(cuts), F.col("key")))
    firsts = sorted(((r["range"], r["key"]) for r in d.groupBy("range").agg(F.min("key").alias("key")).collect()), key=lambda r: r[0])
    # the first document of each range is also the end of the range before it; that of the first one ends the last
    ends = [(k["row"], firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    ends = spark.createDataFrame(ends, "row long, before int")
    at = lambda end, place: F.struct(place.alias("range"), F.lit(end).alias("end"))
    places = F.array_compact(F.array(at(False, F.col("range")), F.when(F.col("before").isNotNull(), at(True, F.col("before")))))
    d = d.join(F.broadcast(ends), "row", "left").select("row", "doc_id", "key", "text", F.inline(places))
    order = Window.partitionBy("range").orderBy("end", "key")
    follows = F.lead(F.struct("row", "text")).over(order)
    return d.select("range", "row", "doc_id", "text", "end", follows.alias("n")).where("not end").select("range", "row", "doc_id", "text", F.col("n.row").alias("next_row"), F.col("n.text").alias("next_text"))


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses to the edited text and to the next document.

    The edited text has the last quarter of the characters (rounded down) replaced by as many of the
    next document's first ones, or all it has. Terms that text and edited text share are sampled once.
    """
    d = with_next(docs)
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter))
    d = d.select("range", "row", "doc_id", "next_row", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["range", "row", "doc_id", "next_row", "n_chars", "edited_sha256"]
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    d = with_terms(d, {"text": "own", "edited": "other"})
    # terms of one weight in both texts, and the rest of each
    parts = [F.array_intersect("own", "other"), F.array_except("own", "other"), F.array_except("other", "own")]
    d = d.select(*keys, _most(F.col("own_size"), F.col("other_size")).alias("most"), F.posexplode(F.array(*parts)).alias("part", "terms"))
    d = _samples(d, [*keys, "part"], "terms", "most", samples)
    least = lambda k, part: F.min(F.when(F.col("part") != part, F.col(f"s{k}")))
    names = [f"{side}{k}" for side in ("own", "other") for k in range(samples)]
    d = d.groupBy(*keys).agg(*[least(k, part).alias(f"{side}{k}") for side, part in (("own", 2), ("other", 1)) for k in range(samples)])
    own, other = ([F.col(n) for n in names[i : i + samples]] for i in (0, samples))
    d = stored(d.select(*keys[1:], _digits(own).alias("fingerprint"), _digits(other).alias("edited_fingerprint")), "fingerprints")
    after = d.select(F.col("row").alias("next_row"), F.col("fingerprint").alias("next_fingerprint"))
    return d.join(after, "next_row").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every document."""
    return edited_likeness(read(spark, sf_dir, "documents"))
