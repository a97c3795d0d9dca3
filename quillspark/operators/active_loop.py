"""Answers written sentence by sentence that search while they are written, as rounds over a table of open answers.

Each round takes the next sentence of every open answer, decides whether evidence is needed, gives those
that need it and have budget left their next unseen passages, settles the sentence on them, appends it
and lets answers go that have reached a stop. A round is one table, stored, so a lost executor repeats
no earlier round; there are at most ``steps`` of them, however many answers there are. What an answer
carries from round to round is bounded by its budgets: the passages seen and the searches spent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import rules as R
from quillspark.functions import text as T
from quillspark.sources.stored import stored

#: Budgets: sentences, searches, passages of an answer, passages of a search; the least F1 that a search finds.
STEPS, SEARCHES, MOST_PIECES, PER_STEP, LEAST = 4, 3, 6, 2, 0.2
#: A settled sentence of this confidence ends an answer to a retrieval question.
SETTLED = 0.55
#: What is said where the passages do not bear a sentence out.
NOTHING_FOUND = "Not enough information."


def _low(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def write_answers(
    answers: DataFrame, keys: list[str], search: Callable[[DataFrame], DataFrame], steps: int = STEPS, searches: int = SEARCHES, most: int = MOST_PIECES, per_step: int = PER_STEP
) -> DataFrame:
    """One row for each sentence written: keys, step, rule, needed, searched, skipped, retrieved, status, abstains, confidence, sentence, partial, stop.

    ``answers (keys, question, asked, sentences, task, bias)``; ``search`` takes rows with keys, question
    and candidate and gives (keys, piece, rank_score, s, en), ``s`` the scores of the candidate against the piece.
    """
    if steps < 1 or per_step < 1 or searches < 0 or most < 0:
        raise ValueError("steps and passages of a search must be positive, searches and passages of an answer must not be negative")
    seen = F.array().cast("array<bigint>")
    frontier = answers.withColumn("partial", F.lit("")).withColumn("spent", F.lit(0)).withColumn("seen", seen)
    out = None
    for step in range(1, steps + 1):
        d = frontier.withColumn("candidate", T.said_sentence(F.get("sentences", F.lit(step - 1)))).where("candidate <> ''")
        sure = F.least(F.length("candidate") / 100.0, F.lit(1.0))
        d = d.withColumn("p", R.retrieval_policy(F.col("question"), F.col("candidate"), F.length("candidate") / 100.0, F.col("task"), F.col("bias"), F.col("asked")))
        wants, over, full = F.col("p.needs_retrieval"), F.col("spent") >= searches, F.size("seen") >= most
        skipped = F.when(wants & over, "max_retrieval_steps_reached").when(wants & full, "max_total_chunks_reached").otherwise("")
        d = d.withColumn("skipped", skipped).withColumn("searched", wants & (F.col("skipped") == ""))
        room = F.least(F.lit(per_step), most - F.size("seen"))
        # few sentences need evidence; stored, so the policy is not worked out again wherever a search reads them
        asking = stored(d.where("searched").select(*keys, "question", "candidate", "seen", room.alias("room")), f"asking-{step}")
        found = search(asking.select(*keys, "question", "candidate")).where(F.col("rank_score") >= LEAST)
        found = found.join(asking.select(*keys, "seen", "room"), keys).where(~F.array_contains("seen", F.col("piece")))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rank_score"), "piece"))
        found = found.withColumn("place", place).where(F.col("place") <= F.col("room"))
        found = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "piece", "s", "en"))).alias("found"))
        d = d.join(found, keys, "left")
        n = F.coalesce(F.size("found"), F.lit(0))
        n = F.when(n < 0, 0).otherwise(n)
        best = F.array_max(F.transform("found", lambda e: F.struct(e["s"]["f1"].alias("f1"), (-e["piece"]).alias("at"), e["s"]["precision"].alias("precision"), e["s"]["recall"].alias("recall"))))
        negated = F.coalesce(F.exists("found", lambda e: e["en"]), F.lit(False))
        d = d.withColumn("v", F.when(F.col("searched"), R.verdict_on(T.normal(F.col("candidate")), F.lit("factual"), n, best, negated)))
        borne = ~F.col("searched") | (F.col("v.verdict") == "supported")
        d = d.withColumn("sentence", F.when(borne, F.col("candidate")).otherwise(NOTHING_FOUND))
        d = d.withColumn("abstains", F.when(F.col("searched"), ~borne).otherwise(T.contains_any(_low(F.col("sentence")), L.ABSTENTION_MARKERS)))
        d = d.withColumn("status", F.coalesce("v.verdict", F.lit("not_checked"))).withColumn("confidence", F.coalesce("v.confidence", sure))
        settled = (F.col("task") == "open_retrieval") & F.col("searched") & (n > 0) & (F.col("status") == "supported") & (F.col("confidence") >= SETTLED)
        asks = T.contains_any(_low(F.col("sentence")), L.CLARIFICATION_MARKERS)
        stop = F.when(settled & ~asks, "settled").when(F.lit(step >= steps), "max_steps").when(F.col("abstains"), "abstained").when(asks, "clarification").otherwise("")
        ids = F.coalesce(F.transform("found", lambda e: e["piece"]), seen)
        d = d.withColumn("stop", stop).withColumn("retrieved", ids).withColumn("partial", T.appended(F.col("partial"), F.col("sentence")))
        d = d.withColumn("spent", F.col("spent") + F.col("searched").cast("int")).withColumn("seen", F.concat("seen", "retrieved")).withColumn("step", F.lit(step).cast("long"))
        d = stored(d.drop("candidate", "found", "v"), f"round-{step}")
        rows = d.select(*keys, "step", "p.rule", wants.alias("needed"), "searched", "skipped", "retrieved", "status", "abstains", "confidence", "sentence", "partial", "stop")
        out = rows if out is None else out.union(rows)
        frontier = d.where("stop = ''").select(*answers.columns, "partial", "spent", "seen")
        if step < steps and frontier.isEmpty():
            break
    return out


def final_answers(answers: DataFrame, trace: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each answer: its text, mean confidence, whether it abstains, steps, searches, passages, why it ended.

    An answer of no sentence says that nothing is known, and abstains.
    """
    step = F.struct("step", "partial", "stop", "retrieved")
    d = trace.groupBy(*keys).agg(
        F.round(F.avg("confidence"), 4).alias("confidence"), F.max(step).alias("last"), F.count("*").alias("n_steps"), F.count_if("searched").alias("n_searches"),
        # an answer has STEPS rows at most
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "retrieved"))), lambda s: s["retrieved"])).alias("evidence"),
        F.bool_or(F.col("abstains") | F.col("status").isin("not_enough_info", "refuted")).alias("open"), F.sum(T.word_count(F.col("sentence"))).alias("n_words"),
    )
    d = answers.select(*keys).join(d, keys, "left")
    said = F.coalesce("last.partial", F.lit(""))
    marked = T.contains_any(_low(said), [*L.ABSTENTION_MARKERS, *L.CLARIFICATION_MARKERS])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return d.select(
        *keys, F.when(said == "", NOTHING_FOUND).otherwise(said).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        ((said == "") | F.coalesce("open", F.lit(False)) | marked).alias("abstained"), count("n_steps"), count("n_searches"), count("n_words"),
        F.coalesce("evidence", F.array().cast("array<bigint>")).alias("evidence"), F.coalesce(F.nullif("last.stop", F.lit("")), F.lit("finished")).alias("stop"),
    )
