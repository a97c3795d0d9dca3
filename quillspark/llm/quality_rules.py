"""Quality rules with risk-controlled cutoffs (operator 1), in DataFrame functions only.

Each rule rejects a document whose value reaches the rule's cutoff. The cutoffs of all rules are
chosen together, for each stratum (language) by itself, on labelled holdout documents: level g sets
every rule to the g-th cutoff of its grid, from lenient to strict, and rejects what any rule rejects.
Walking the levels in order, one is certified while the exact binomial test rejects "more than
``ALPHA`` of the good documents are lost" at level ``DELTA / strata``. Testing a fixed sequence needs
no correction along it; the Bonferroni divisor covers the strata. So with probability 1 - DELTA, in
every stratum at once, at most ALPHA of the good documents that pass the base checks are rejected.
Among certified levels the one that rejects the most labelled bad documents is used, the most lenient
on ties; where none is certified (under 90 good labelled documents), the rules rest in that stratum.

Null text counts as empty. Documents without a word have shares of 0 and fail the base check.
Languages outside ``LANGUAGES`` and null are the stratum "other". Of several labels of one doc_id
the mean decides (0.5 and more is good); labels that are null or lack a document are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpoint, read, words_of

#: Most good documents lost, as a share, in each stratum; the chance that this does not hold.
ALPHA, DELTA = 0.05, 0.05
LANGUAGES = ("en", "de", "fr", "es")
MIN_WORDS = 50
#: Ids of labelled documents that are sent to all tasks at most.
MOST_SENT = 4_000_000
#: Each rule's cutoffs, from lenient to strict.
GRIDS = {
    "symbol_share": (8.0, 6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1),
    "repeat_share": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "dup_line_share": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1),
    "shout_share": (3.0, 2.5, 2.0, 1.8, 1.6, 1.4, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "word_length": (30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.5, 10.0, 9.5, 9.0, 8.5, 8.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` packed into the struct ``doc``, with the base counts, ``base_failed`` and each rule's value.

    A word is covered by a repeated window if a 3-word window over it occurs twice or more in the
    text: windows are compared by a 64-bit hash, sorted with their positions, and the positions of
    the repeated ones are measured as overlapping intervals of three words.
    """
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    d = docs.select(F.struct("*").alias("doc")).select("doc", text.alias("text"), words_of(text).alias("words"))
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.slice("words", 3, F.greatest(n - 2, F.lit(1))),
            lambda w, i: F.xxhash64(F.get("words", i), F.get("words", i + 1), w),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc", "text", "words", windows.alias("windows"), lines.alias("lines"))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    word_chars = F.length(F.array_join("words", ""))
    d = d.select(
        "doc",
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("!")).alias("n_shouts"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, F.sort_array(placed))
        .otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
        .alias("placed"),
    )
    same = lambda e, i: F.coalesce(F.get("placed", i)["h"] == e["h"], F.lit(False))
    starts = F.sort_array(
        F.transform(F.filter("placed", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["at"])
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    d = d.select(*[c for c in d.columns if c != "placed"], covered.alias("n_repeat_words"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return d.select(
        "doc",
        *BASE,
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_shouts", "n_words").alias("shout_share"),
        share("word_chars", "n_words").alias("word_length"),
    )


def stratum(lang: Column) -> Column:
    """The stratum of a language; their number is fixed."""
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit("other"))


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series, shifted by 8 so that it is exact to double precision from 0 on."""
    z = x + 9.0
    low = sum((F.log(x + float(i)) for i in range(1, 9)), F.lit(0.0))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - low


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Bin(n, p): the largest term, times the sum of the falling ratios below it.

    Only meant below the mean; from k >= n * p on it is 1 (the test fails there anyway). The sum
    stops after 40 standard deviations' worth of terms, below double precision.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(
        _log_factorial(n)
        - _log_factorial(k)
        - _log_factorial(n - k)
        + k * math.log(p)
        + (n - k) * math.log(1 - p)
    )
    steps = F.least(k, 40 * F.sqrt(n) + 60).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, 1.0).otherwise(top * total)


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, and a cutoff for each rule), of at most ``len(LANGUAGES) + 1`` rows: strata with a certified level.

    ``features``: doc_id, stratum, base_failed and the rules' values. Every labelled document counts.
    """
    strata, levels = len(LANGUAGES) + 1, len(next(iter(GRIDS.values())))
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    held = features.where(~F.col("base_failed")).join(marked, "doc_id")
    # the first level at which a rule rejects is the number of its cutoffs above the value
    first = F.least(*[sum((F.col(rule) < cutoff).cast("int") for cutoff in grid) for rule, grid in GRIDS.items()])
    hit = lambda g, good: F.count_if((F.col("first") <= g) & (F.col("good") == good))
    counts = (
        held.select("stratum", "good", first.alias("first"))
        .groupBy("stratum")
        .agg(
            F.count_if("good").alias("n"),
            F.array(*[F.struct(hit(g, True).alias("lost"), hit(g, False).alias("caught")) for g in range(levels)]).alias("at"),
        )
    )
    tested = counts.select("stratum", "n", F.posexplode("at").alias("g", "at")).select(
        "stratum", "g", "at.caught", ((F.col("n") > 0) & (binomial_tail(F.col("at.lost"), F.col("n"), alpha) <= delta / strata)).alias("ok")
    )
    so_far = Window.partitionBy("stratum").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("ok", F.min("ok").over(so_far)).where("ok")
    best = passed.groupBy("stratum").agg(F.max_by("g", F.struct("caught", -F.col("g"))).alias("g"))
    return best.select("stratum", *[F.get(F.array(*map(F.lit, grid)), F.col("g")).alias(f"cut_{rule}") for rule, grid in GRIDS.items()])


def verdict(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with ``kept``; the cutoffs are broadcast: their rows are as many as strata, at most."""
    d = features.join(F.broadcast(cutoffs), "stratum", "left")
    rejected = [F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False)) for r in GRIDS]
    bad = F.col("base_failed")
    for x in rejected:
        bad = bad | x
    return d.withColumn("kept", ~bad).drop(*[f"cut_{r}" for r in GRIDS])


def _narrow(docs: DataFrame) -> DataFrame:
    d = with_features(docs.select("doc_id", "text", "lang"))
    return d.select("doc.doc_id", stratum(F.col("doc.lang")).alias("stratum"), *d.columns[1:])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others, all returned) that the rules keep.

    Cutoffs come from the labelled rows of ``docs``: their ids go to all tasks if they are few enough
    (``MOST_SENT``), else the features of all rows are worked out for them as well; texts are never
    shuffled. Repeated rows are judged each by itself.
    """
    ids = checkpoint(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= MOST_SENT else docs
    cutoffs = checkpoint(certified_cutoffs(checkpoint(_narrow(labelled)), labels))
    d = with_features(docs)
    d = verdict(d.withColumn("stratum", stratum(F.col("doc.lang"))), cutoffs)
    # not a filter: the optimizer would push it below the features and so write them out in it again and again
    return d.select(F.inline(F.when(F.col("kept"), F.array("doc"))))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; features are computed once, as a narrow checkpoint."""
    features = checkpoint(_narrow(read(spark, sf_dir, "documents")))
    judged = verdict(features, certified_cutoffs(features, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "stratum", *GRIDS)
