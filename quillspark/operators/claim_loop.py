"""Verification of an answer's claims in rounds, with searches and shown pieces shared by the claims.

A claim is verified on what it has; while that is not enough it may search: the next ``per_round`` pieces
of its ranked list that it has not seen come to its evidence. An answer has ``searches`` of them, spent by
its claims in order, so a claim's outcome hangs on those before it. Who may search at all does not: only
claims that their first evidence leaves open, and among them only the first ``searches`` of an answer,
as each that searches spends one at least. All other claims are settled each by itself; for those few
the ranked lists are joined beforehand and the answer is one fold over an array of bounded length. So
neither an answer nor a conversation of very many claims is gathered anywhere.

Two habits of the studied controller are kept. Pieces shown to one claim are hidden from later searches
of the answer only if the answer began with evidence (``share``: an empty start is not shared), and a
piece found for one claim is hidden from another without becoming that claim's evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules as R

#: Budgets: rounds of a claim, pieces of a search, searches of an answer, pieces of a claim; the least F1 that a search finds.
ROUNDS, PER_ROUND, SEARCHES, MOST_PIECES, LEAST = 2, 2, 6, 10, 0.2

_FOUND = "array<struct<piece:bigint,s:struct<f1:double,precision:double,recall:double>,en:boolean>>"


def _verdict(claim: Column, claim_type: Column, evidence: Column) -> Column:
    """Struct (verdict, confidence) on an array of (piece, s, en): the best of its scores, the lesser piece on ties."""
    best = F.array_max(F.transform(evidence, lambda e: F.struct(e["s"]["f1"].alias("f1"), (-e["piece"]).alias("at"), e["s"]["precision"].alias("precision"), e["s"]["recall"].alias("recall"))))
    return R.verdict_on(claim, claim_type, F.size(evidence), best, F.exists(evidence, lambda e: e["en"]))


def _ids(found: Column) -> Column:
    return F.transform(found, lambda e: e["piece"])


def verify_claims(
    claims: DataFrame, search: Callable[[DataFrame], DataFrame], group: str, rounds: int = ROUNDS, per_round: int = PER_ROUND, searches: int = SEARCHES, most: int = MOST_PIECES
) -> DataFrame:
    """(group, id, verdict, confidence, rounds, retrieved, evidence, blocked, counter) for each claim.

    ``claims (group, id struct<turn, pos>, claim_type, c, start, ...)``, ``start`` an array of (piece, s, en);
    ``search`` takes some of these rows and gives (group, id, piece, s, en). ``counter``: searches of the
    answer up to this claim. ``blocked`` says which budget ended a claim that would have searched.
    """
    d = claims.withColumn("start", F.slice("start", 1, most)).withColumn("v", _verdict(F.col("c"), F.col("claim_type"), F.col("start")))
    wants = (F.col("v.verdict") == "not_enough_info") & (F.col("claim_type") == "factual") & (F.col("c") != "")
    d = d.withColumn("wants", wants if rounds > 1 else F.lit(False))
    order = Window.partitionBy(group, "id.turn").orderBy("id.pos")
    first = d.where("wants").withColumn("n", F.row_number().over(order)).where(F.col("n") <= searches)
    # what others may have hidden, and what it may show itself: more of its list is never looked at
    deep = searches * per_round + most
    ranked = Window.partitionBy(group, "id").orderBy(F.desc("s.f1"), "piece")
    found = search(first.drop("n")).where(F.col("s.f1") >= LEAST)
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= deep)
    found = found.groupBy(group, "id").agg(F.array_sort(F.collect_list(F.struct("rank", "piece", "s", "en"))).alias("list"))
    found = found.withColumn("list", F.transform("list", lambda e: F.struct(e["piece"].alias("piece"), e["s"].alias("s"), e["en"].alias("en"))))
    first = first.join(found, [group, "id"], "left").withColumn("list", F.coalesce("list", F.array().cast(_FOUND)))
    row = F.struct(F.col("id.pos").alias("pos"), "c", "claim_type", F.col("start").cast(_FOUND).alias("start"), "list", "v")
    answers = first.groupBy(group, "id.turn").agg(F.array_sort(F.collect_list(row), lambda a, b: a["pos"] - b["pos"]).alias("rows"))
    answers = answers.select(group, "turn", _fold(F.col("rows"), rounds, per_round, searches, most).alias("done"))
    d = d.withColumn("turn", F.col("id.turn")).join(answers, [group, "turn"], "left")
    mine = F.get(F.filter("done", lambda x: x["pos"] == F.col("id.pos")), F.lit(0))
    spent = F.coalesce(F.aggregate("done", F.lit(0), lambda n, x: n + F.when(x["pos"] <= F.col("id.pos"), x["used"]).otherwise(0)), F.lit(0))
    d = d.withColumn("mine", mine).withColumn("counter", spent)
    late = F.col("wants") & F.col("mine").isNull()
    pick = lambda c, other: F.coalesce(F.col(f"mine.{c}"), other).alias(c)
    return d.select(
        group, "id", pick("verdict", F.col("v.verdict")), pick("confidence", F.col("v.confidence")), (1 + F.coalesce("mine.used", F.lit(0))).alias("rounds"),
        F.coalesce(_ids(F.col("mine.found")), F.array().cast("array<bigint>")).alias("retrieved"),
        F.concat(_ids(F.col("start")), F.coalesce(_ids(F.col("mine.found")), F.array().cast("array<bigint>"))).alias("evidence"),
        pick("blocked", F.when(late, "max_total_retrievals_reached").otherwise("")), "counter",
    )


def _fold(rows: Column, rounds: int, per_round: int, searches: int, most: int) -> Column:
    """Array of (pos, verdict, confidence, used, found, blocked), in order of the claims."""

    def claim(state: Column, x: Column) -> Column:
        share = F.size(x["start"]) > 0

        def turn(s: Column, _: Column) -> Column:
            over, full = state["spent"] + s["used"] >= searches, most - F.size(x["start"]) - F.size(s["found"]) <= 0
            shown = F.concat(F.when(share, state["seen"]).otherwise(F.array().cast("array<bigint>")), _ids(x["start"]), _ids(s["found"]))
            fresh = F.filter(x["list"], lambda e: ~F.array_contains(shown, e["piece"]))
            room = F.least(F.lit(per_round), most - F.size(x["start"]) - F.size(s["found"]))
            more = F.concat(s["found"], F.slice(fresh, 1, F.greatest(room, F.lit(0))))
            v = _verdict(x["c"], x["claim_type"], F.concat(x["start"], more))
            step = lambda found, used, verdict, blocked, done: F.struct(found.alias("found"), used.alias("used"), verdict.alias("v"), blocked.alias("blocked"), done.alias("done"))
            stop = lambda why: step(s["found"], s["used"], s["v"], F.lit(why), F.lit(True))
            return (
                F.when(s["done"], s)
                .when(over, stop("max_total_retrievals_reached"))
                .when(full, stop("max_total_chunks_reached"))
                .otherwise(step(more, s["used"] + 1, v, F.lit(""), v["verdict"] != "not_enough_info"))
            )

        begin = F.struct(F.array().cast(_FOUND).alias("found"), F.lit(0).alias("used"), x["v"].alias("v"), F.lit("").alias("blocked"), F.lit(False).alias("done"))
        end = F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), begin, turn)
        result = F.struct(
            x["pos"].alias("pos"), end["v"]["verdict"].alias("verdict"), end["v"]["confidence"].alias("confidence"), end["used"].alias("used"), end["found"].alias("found"), end["blocked"].alias("blocked")
        )
        return F.struct(
            F.when(share, F.array_union(state["seen"], _ids(end["found"]))).otherwise(state["seen"]).alias("seen"),
            (state["spent"] + end["used"]).alias("spent"), F.concat(state["out"], F.array(result)).alias("out"),
        )

    none = f"array<struct<pos:int,verdict:string,confidence:double,used:int,found:{_FOUND},blocked:string>>"
    zero = F.struct(F.array().cast("array<bigint>").alias("seen"), F.lit(0).alias("spent"), F.array().cast(none).alias("out"))
    return F.aggregate(rows, zero, claim, lambda s: s["out"])
