"""Phrase collocations by top-order marginalisation (operator 12).

Texts with A-Z lower-cased are cut at ``. , ; : ! ?`` and line ends into pieces, pieces at blanks and
tabs into words. Every word opens one window of the longest phrases' length: lead columns hold the
words after it in its piece, null where the piece has ended. Only these windows are counted. The
counts of all shorter phrases are sums over them: a phrase of k words occurs as often as windows
start with it, so a ROLLUP over the lead columns gives, level by level, each prefix's count, and at
its last level the number of words of the language.

A task counts its windows by ``CHUNK_WORDS`` words at a time before they are shuffled, by all words but
the last. What a frequent word or pair sends to one task is then at most one row for each follower
and chunk. Heads that are rarer than ``least`` cannot be part of a candidate; their last word is
dropped before the ROLLUP, which leaves the sums of their shorter prefixes as they are.

Null texts are empty, a null language is ``und``; texts without words and empty tables give no rows.
Repeated rows count each time. Ties in the score go to the larger count, then to the phrase's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import read, stored

LONGEST, LEAST, FIRST = 3, 10, 2000
#: A candidate is dropped if a longer one that holds it occurs in at least this percentage of its places.
HELD_PERCENT = 50
#: Words whose windows a task counts at once.
CHUNK_WORDS = 600_000
#: Rows whose texts are split at once.
SLICE_ROWS = 100
#: Digits of a count: products of three counts' digits and the scale stay within 38.
COUNT = "decimal(14,0)"


def _counted(longest: int):
    """A task's windows, counted a chunk at a time: (lang, text) rows in, (head, last, n) rows out, sorted within a chunk.

    ``head``: the window's words but the last, as many as its piece has, a line end (which no word holds) and
    the language, in one string, as short rows shuffle; ``last`` is null where the piece has ended.
    """

    def windows(held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, langs = (pa.chunked_array([h[k] for h in held]).unify_dictionaries().combine_chunks() for k in (0, 1))
        shift = np.cumsum([0, *(h[3] for h in held[:-1])])
        piece = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)])
        code, base = words.indices.to_numpy().astype(np.int64), len(words.dictionary) + 1
        leads = [code]
        for k in range(1, longest):
            lead = np.full(len(code), -1, dtype=np.int64)
            same = piece[k:] == piece[:-k]
            lead[:-k][same] = code[k:][same]
            leads.append(lead)
        # windows are numbered column by column, so a number never passes rows * words
        number, n = langs.indices.to_numpy().astype(np.int64), None
        for lead in leads:
            _, first, number, n = np.unique(number * base + lead + 1, return_index=True, return_inverse=True, return_counts=True)
        columns = [words.dictionary.take(pa.array(lead[first], mask=lead[first] < 0)) for lead in leads]
        head = pc.binary_join_element_wise(*columns[:-1], pa.scalar(" ", columns[0].type), null_handling="skip") if longest > 2 else columns[0]
        lang = langs.dictionary.take(pa.array(langs.indices.to_numpy()[first]))
        head = pc.binary_join_element_wise(head, lang, pa.scalar("\n", head.type))
        return pa.record_batch([head.cast(pa.string()), columns[-1].cast(pa.string()), pa.array(n)], names=["head", "last", "n"])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0
        # rows are copied: some compute functions misread a slice that starts inside its array
        for batch in (b.take(pa.array(range(i, min(i + SLICE_ROWS, b.num_rows)))) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            low = pc.ascii_lower(pc.fill_null(batch.column("text"), "").cast(pa.large_string()))
            pieces = pc.split_pattern_regex(low, r"[.,;:!?\n\x0b\x0c\r]+")
            lang = batch.column("lang").cast(pa.large_string()).take(pc.list_parent_indices(pieces))
            split = pc.split_pattern_regex(pieces.flatten(), r"[ \t]+")
            words, piece = split.flatten(), pc.list_parent_indices(split)
            full = pc.not_equal(words, "")
            words, piece = words.filter(full), piece.filter(full)
            if not len(words):
                continue
            held.append((words.dictionary_encode(), lang.take(piece).dictionary_encode(), piece.to_numpy().astype(np.int64), len(split)))
            size += len(words)
            if size >= CHUNK_WORDS:
                yield windows(held)
                held, size = [], 0
        if held:
            yield windows(held)

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, f): each phrase of 1 to ``longest`` words that occurs ``least`` times or more; no words: all words of the language."""
    if longest < 2:
        raise ValueError("the longest phrases must have two words at least")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    dealt = texts.mapInArrow(_counted(longest), "head string, last string, n long").repartition("head")
    full = dealt.groupBy("head", "last").agg(F.sum("n").alias("f"))
    lang, words = F.substr("head", F.instr("head", "\n") + 1).alias("lang"), F.split(F.substring_index("head", "\n", 1), " ")
    # one condition over both columns: a condition on ``last`` alone would be moved below the shuffle, which then were made twice
    top = full.select(lang, F.when(F.col("f") >= least, F.concat(words, F.array("last"))).alias("words"), "f")
    top = top.where(F.size(F.filter("words", lambda w: w.isNotNull())) == longest)
    heads = full.groupBy("head").agg(F.sum("f").alias("f")).select(lang, words.alias("words"), "f")
    names = [f"w{i}" for i in range(1, longest)]
    kept = lambda i: F.when((F.col("f") >= least) | (i < longest - 2) | (i == 0), F.get("words", F.lit(i)))
    below = heads.select("lang", *[kept(i).alias(n) for i, n in enumerate(names)], "f")
    below = below.rollup("lang", *names).agg(F.sum("f").alias("f"), F.grouping_id().alias("absent"))
    depth = longest - F.length(F.bin("absent")) - 1  # of the words that a level keeps
    depth = F.when(F.col("absent") == 0, longest - 1).otherwise(depth)
    level = F.slice(F.array(*names), 1, depth)
    # a null inside a level's words is padding, not a phrase; the grand total has no language
    shorter = below.where(F.col("absent") < (1 << (longest - 1)))
    shorter = shorter.select("lang", level.alias("words"), "f").where(~F.exists("words", lambda w: w.isNull()))
    return top.union(shorter.where((F.col("f") >= least) | (F.size("words") == 0)))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int | None = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``first`` phrases (None: all) of 2 to ``longest`` words."""
    counts = stored(phrase_counts(docs, longest, least).withColumn("phrase", _phrase("words")), "phrases")
    candidates = counts.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    known = counts.where(F.size("words") > 0).select("lang", "phrase", "f")

    size = F.size("words")
    cut = F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda k: F.struct(k.alias("k"), _phrase(F.slice("words", 1, k)).alias("head"), _phrase(F.slice("words", k + 1, size - k)).alias("tail")),
    )
    cuts = candidates.select("lang", "phrase", "a", F.inline(cut))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    a, left, right = (F.col(c).cast(COUNT) for c in ("a", "l", "r"))
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c"))

    # every run of 2 and more words inside a longer candidate, with the largest count of those
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _phrase(F.slice("words", i, m))))
    )
    holders = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = lowest.join(holders, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("held") < HELD_PERCENT * F.col("c.a"), F.lit(True)))

    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("c.a"), "phrase"))
    ranked = kept.select("lang", place.cast("long").alias("rank"), "phrase", "c")
    ranked = ranked if first is None else ranked.where(F.col("rank") <= first)
    words = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", *[F.col(f"c.{c}").cast("long").alias(c) for c in ("a", "l", "r")], "n", "c.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of ``documents``."""
    return collocations(read(spark, sf_dir, "documents"))


#: n-grams counted length by length in DuckDB; products are of 128 bits.
ORACLE_SQL = {
    "op12_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split WHERE len(ws) > 0),
f1 AS (SELECT lang, ws[i] AS phrase, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, ws[i] || ' ' || ws[i + 1] AS phrase, count(*) AS f FROM places WHERE i + 1 <= len(ws) GROUP BY ALL),
f3 AS (SELECT lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS phrase, count(*) AS f FROM places WHERE i + 2 <= len(ws) GROUP BY ALL),
counted AS (SELECT * FROM f1 WHERE f >= 10 UNION ALL SELECT * FROM f2 WHERE f >= 10 UNION ALL SELECT * FROM f3 WHERE f >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE contains(phrase, ' ')),
cuts AS (
  SELECT lang, phrase, a, ws, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM candidates)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM candidates WHERE len(ws) = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM candidates WHERE len(ws) = 3
  ) GROUP BY lang, phrase
),
kept AS (SELECT s.* FROM lowest s LEFT JOIN held h USING (lang, phrase) WHERE h.a IS NULL OR 100 * h.a < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
"""
}
