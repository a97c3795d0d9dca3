"""The registered queries: operators applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import evaluate as E
from quillspark.functions import lexicon as L
from quillspark.functions import match as M
from quillspark.functions import payload
from quillspark.functions import rules as R
from quillspark.functions import text as T
from quillspark.operators import metrics as AG
from quillspark.operators import prep as DP
from quillspark.operators import quality as DQ
from quillspark.operators import vector as VE
from quillspark.sources import vector_index
from quillspark.sources.stored import location


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- vector retrieval ---------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, sf_dir, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return corpus.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "v"), corpus


def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of each query vector, exactly."""
    queries, corpus = _vectors(spark, sf_dir)
    return VE.top_k(queries, corpus, 5).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def vec_topk_exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five after the three that a first round has shown."""
    queries, corpus = _vectors(spark, sf_dir)
    seen = VE.top_k(queries, corpus, 3).select("query_id", "id")
    found = VE.top_k_unseen(queries, corpus, seen, 5, 3)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _vectors(spark, sf_dir)
    labels = corpus.select("id", "label")
    of_query = labels.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    ranked = VE.top_k(queries, corpus, 5).join(labels, "id").join(of_query, "query_id")
    ranked = ranked.withColumn("relevant", F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)))
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    gold = of_query.where(F.col("query_id") % 20 == 0).join(sizes, F.col("query_label") == F.col("label")).select("query_id", "n_gold", "label")
    return VE.ranking_metrics(ranked, gold.select("query_id", "n_gold"), 5).join(gold.select("query_id", "label"), "query_id")


def vec_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics at 5 by label; rows of the same label count as relevant."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    d = _relevance(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_queries"), *map(mean, ("hit", "recall", "precision", "mrr")))
    return d


def vec_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, ids, dimensions and norms of the vectors."""
    return VE.index_check(_vectors(spark, sf_dir)[1])


def vec_index_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as an index of small parts: what its manifest says, and what a check of the written parts finds."""
    path = location(spark, "index")
    manifest = vector_index.write_index(_vectors(spark, sf_dir)[1], path, part=150)
    issues = vector_index.check_index(spark, path).groupBy("part").agg(F.count("*").alias("n_issues"))
    d = manifest.join(issues, "part", "left")
    return d.select("part", "n_rows", "first", "last", F.col("min_dim").cast("long").alias("min_dim"), (F.col("norm_error") > vector_index.TOLERANCE).alias("norm_is_off"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


# -- text and matching --------------------------------------------------------------------------


def text_normalise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and token counts of every document's normalised text."""
    norm = T.normal(F.col("text"))
    d = _read(spark, sf_dir, "documents").select("doc_id", norm.alias("norm"), T.word_count(F.col("text")).alias("n_words"))
    d = d.select("doc_id", "n_words", F.length("norm").alias("norm_chars"), T.tokens(F.col("norm")).alias("tokens"))
    return d.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("norm_chars").cast("long").alias("norm_chars"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"),
    )


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document: how many, the longest, the first one's length."""
    d = _read(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    longest = F.array_max(F.transform("s", lambda x: F.length(x)))
    return d.select(
        "doc_id",
        F.size("s").cast("long").alias("n_sentences"),
        F.coalesce(longest, F.lit(0)).cast("long").alias("longest"),
        F.coalesce(F.length(F.get("s", F.lit(0))), F.lit(0)).cast("long").alias("first_chars"),
    )


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the user turn before it; joined on conversation and turn, so a long one is spread."""
    c = _read(spark, sf_dir, "conversations")
    asked = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    d = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, ["conv_id", "turn"])
    d = d.select("conv_id", "turn", "question", "answer", T.normal(F.col("question")).alias("q"), T.normal(F.col("answer")).alias("a"))
    return d.select("*", T.tokens(F.col("q")).alias("q_tokens"), T.tokens(F.col("a")).alias("a_tokens"))


def turn_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each answer's tokens against its question's."""
    d = _turn_pairs(spark, sf_dir).select("conv_id", "turn", M.token_scores(F.col("a_tokens"), F.col("q_tokens")).alias("s"))
    return d.select("conv_id", "turn", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def text_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each answer to its question, by the ladder."""
    d = _turn_pairs(spark, sf_dir)
    score = M.similarity(F.col("q"), F.col("q_tokens"), F.col("a"), F.col("a_tokens"))
    return d.select("conv_id", "turn", F.round(score, 6).alias("similarity"))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's sentence that its answer resembles most; the first of equal ones."""
    d = _turn_pairs(spark, sf_dir).withColumn("best", M.best_match(T.sentences(F.col("question")), F.col("a"), F.col("a_tokens")))
    return d.select("conv_id", "turn", F.round("best.score", 6).alias("score"), F.md5(F.col("best.candidate").cast("binary")).alias("candidate_md5"))


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's text as a claim, verified against the answer."""
    d = _turn_pairs(spark, sf_dir).withColumn("v", R.claim_verdict(F.col("q"), F.col("q_tokens"), F.col("a"), F.col("a_tokens")))
    return d.select("conv_id", "turn", "v.verdict", F.round("v.f1", 6).alias("f1"))


def open_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tri-state outcome of each answer, with its question as the right answer and the turn after it as a wrong one: undecided is null."""
    d = _turn_pairs(spark, sf_dir)
    later = _read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), T.normal(F.col("text")).alias("x"))
    d = d.join(later, ["conv_id", "turn"], "left").withColumn("x", F.coalesce("x", F.lit("")))
    right = M.similarity(F.col("q"), F.col("q_tokens"), F.col("a"), F.col("a_tokens"))
    wrong = M.falsehood(F.col("x"), T.tokens(F.col("x")), F.col("a"), F.col("a_tokens"))
    gone = E.abstains(F.col("a"), "open")
    d = d.select("conv_id", "turn", right.alias("r"), wrong.alias("w"), gone.alias("abstained"), F.size("a_tokens").alias("n"))
    verdict = R.open_answer(F.col("r"), F.col("w"), F.col("n"), F.col("abstained"))
    return d.select("conv_id", "turn", "abstained", verdict.alias("correct"), verdict.isNull().alias("needs_review"))


def route_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, mode, confidence and rule of every user turn."""
    c = _read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", R.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


def routed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt built for every user turn, as length and MD5: the instruction of its route, then the whole question."""
    c = _read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    c = c.select("conv_id", "turn", "text", R.route(F.col("text"))["route"].alias("route"))
    head = F.when(F.col("route") == "retrieve", "Answer from the passages.").when(F.col("route") == "clarify", "Ask what is meant.").otherwise("Answer.")
    prompt = F.concat(head, F.lit("\n\nQuestion: "), F.trim("text"))
    return c.select("conv_id", "turn", "route", F.length(prompt).cast("long").alias("prompt_chars"), F.md5(prompt.cast("binary")).alias("prompt_md5"))


# -- coercion and JSON --------------------------------------------------------------------------


def coerce_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values written as decimals, with decimal commas and as percentages, read back as shares."""
    e = _read(spark, sf_dir, "events")
    raw = F.round("value", 2).cast("decimal(18,2)").cast("string")
    word = F.when(F.col("event_id") % 3 == 0, F.concat(raw, F.lit("%"))).when(F.col("event_id") % 3 == 1, F.replace(raw, F.lit("."), F.lit(","))).otherwise(raw)
    e = e.select("event_id", word.alias("word"))
    return e.select("event_id", F.round(T.confidence(F.col("word")), 6).alias("confidence"), F.round(T.clamped(F.col("word")), 6).alias("clamped"))


def json_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of each event's JSON, as number and as boolean, and whether the JSON is an object."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select("event_id", T.integer(F.col("k"), -1).alias("k"), T.boolean(F.col("k")).alias("k_flag"), F.col("k").isNotNull().alias("valid"))


def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as bar lists, comma lists and single texts, parsed, without repeats, joined again."""
    p = _read(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, "|").when(F.col("p_partkey") % 3 == 1, ",").otherwise(" ")
    cell = F.concat_ws("", F.replace(F.col("p_type"), F.lit(" "), mark), mark, F.col("p_brand"), mark, F.col("p_type"))
    d = p.select("p_partkey", T.list_cell(cell).alias("items"))
    return d.select("p_partkey", F.size("items").cast("long").alias("n_items"), F.array_join(F.array_distinct("items"), "|").alias("items"))


# -- aggregation --------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text").join(_read(spark, sf_dir, "labels"), "doc_id")


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and means of labelled documents: overall, by language, by source, by both."""
    d = _labelled(spark, sf_dir).drop("text")
    groups = {"overall": [], "lang": ["lang"], "source": ["source"], "lang_source": ["lang", "source"]}
    of = lambda c, name: F.round(c, 6).alias(name)
    return AG.summary(
        d,
        groups,
        [
            F.count("*").alias("n"),
            of(AG.rate(F.col("quality") == 1), "quality_rate"),
            of(AG.rate(F.col("toxic") == 1), "toxic_rate"),
            of(F.avg("n_chars"), "mean_chars"),
        ],
    )


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir)
    symbols = F.regexp_count("text", F.lit(r"[#*$%&|<>!]"))
    word = F.when(symbols * 8 > F.length("text"), "0").otherwise("1")
    return d.select(F.col("quality").cast("string").alias("expected"), word.alias("predicted"))


def confusion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled quality against what the density of symbols says."""
    return AG.confusion(_predicted(spark, sf_dir), "expected", "predicted")


def prf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each quality label."""
    d = AG.one_against_rest(_predicted(spark, sf_dir), "expected", "predicted")
    return d.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each route and rule is taken, with the mean confidence."""
    d = route_turns(spark, sf_dir)
    return d.groupBy("route", "rule").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def question_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to orders to priorities: rates of returned lines for each order, averaged."""
    lines = _read(spark, sf_dir, "lineitem")
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), AG.rate(F.col("l_returnflag") == "R").alias("rate"))
    d = _read(spark, sf_dir, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.groupBy("o_orderpriority").agg(
        F.count("*").alias("n_orders"), F.sum("n").alias("n_lines"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.count_distinct("o_custkey").alias("n_customers")
    )


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every language and source of documents, in one pass."""
    return AG.value_counts(_read(spark, sf_dir, "documents"), ["lang", "source"])


# -- quality and reconciliation -----------------------------------------------------------------


def _line_rules():
    c = F.col
    return [
        ("error", "no_price", c("l_extendedprice") <= 0),
        ("error", "discount_over_tenth", c("l_discount") > 0.09),
        ("warning", "large_quantity", c("l_quantity") > 45),
        ("warning", "returned", c("l_returnflag") == "R"),
    ]


def dq_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break each rule."""
    found = DQ.issues(_read(spark, sf_dir, "lineitem"), "l_orderkey", _line_rules())
    return found.groupBy("level", "category").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


def dq_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the lines as a whole."""
    return DQ.status(DQ.issues(_read(spark, sf_dir, "lineitem"), "l_orderkey", _line_rules()))


def dq_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and repeated keys of the lines by order."""
    return DQ.key_check(_read(spark, sf_dir, "lineitem"), "l_orderkey")


def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have how many lines, none included."""
    d = DQ.reconcile(_read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")
    return d.groupBy("n_children").agg(F.count("*").alias("n_orders"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a labelled document would need a look."""
    d = _labelled(spark, sf_dir)
    rules = [("toxic", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0), ("long", F.col("n_chars") > 10_000), ("short", F.col("n_chars") < 300)]
    return d.select("doc_id", DQ.reasons(rules).alias("reasons"))


# -- data sets ----------------------------------------------------------------------------------


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return DP.remaining(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels"), "doc_id")


def head_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five documents of each source."""
    d = DP.head_of_groups(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)
    return d.select("source", "doc_id", "place")


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, the same ones in every run."""
    return DP.hash_sample(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "s1").select("doc_id", "mark")


def qrels_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under new document ids: language, then number."""
    ids = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("xx")), F.lit("_"), F.lpad("doc_id", 9, "0")).alias("new_id"))
    return DP.remap(_read(spark, sf_dir, "labels").select("doc_id", "quality"), ids, "doc_id").select("doc_id", "quality")


def strata_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, user turns and documents as one set of questions."""
    b = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    u = _read(spark, sf_dir, "conversations").where(F.col("role") == "user").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source")
    rows = DP.strata({"benchmark": b, "turn": u, "document": d}, ["id", "text", "source"])
    return rows.select("stratum", "id", "source", F.length("text").cast("long").alias("chars"))


def turn_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each role in each conversation and the first and last of them."""
    c = _read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


# -- policies, claims, evaluation ---------------------------------------------------------------


def retrieval_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every sentence of every answer: is evidence needed, and by which rule."""
    d = _turn_pairs(spark, sf_dir).select("conv_id", "turn", "question", "answer", R.question_signs(F.col("question")).alias("asked"))
    d = d.select("conv_id", "turn", "question", "asked", F.posexplode(T.sentences(F.col("answer"))).alias("pos", "sentence"))
    task = F.when(F.col("conv_id") % 5 == 0, "multiple_choice").when(F.col("conv_id") % 5 == 1, "open_direct").otherwise("open_qa")
    bias = F.when(F.col("turn") % 3 == 0, "conservative").when(F.col("turn") % 3 == 1, "balanced").otherwise("aggressive")
    sure = F.length("sentence") / 100.0
    d = d.withColumn("p", R.retrieval_policy(F.col("question"), F.col("sentence"), sure, task, bias, F.col("asked")))
    return d.select("conv_id", "turn", "pos", "p.*")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _turn_pairs(spark, sf_dir)
    return d.select("conv_id", "turn", "q", "q_tokens", F.posexplode(R.claims(F.col("answer"), None)).alias("pos", "c"))


def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of every answer."""
    c = F.col("c")
    return _claims(spark, sf_dir).select(
        "conv_id",
        "turn",
        "pos",
        c["claim_type"].alias("claim_type"),
        c["requires_evidence"].alias("requires_evidence"),
        c["importance"].alias("importance"),
        F.md5(c["claim_text"].cast("binary")).alias("claim_md5"),
    )


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after at most two rounds: against the question, and where that is not enough, against the turn after the answer.

    Rounds are unrolled; the second joins the next turn on conversation and turn, so a long
    conversation is spread.
    """
    importance = F.col("c.importance").alias("importance")
    d = _claims(spark, sf_dir).select("conv_id", "turn", "pos", importance, T.normal(F.col("c.claim_text")).alias("c"), F.col("q").alias("e"), F.col("q_tokens").alias("et"))
    d = d.withColumn("ct", T.tokens(F.col("c")))
    d = d.withColumn("v", R.claim_verdict(F.col("c"), F.col("ct"), F.col("e"), F.col("et"))["verdict"])
    later = _read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), T.normal(F.col("text")).alias("e2"))
    later = later.withColumn("e2t", T.tokens(F.col("e2")))
    again = d.join(later, ["conv_id", "turn"], "left").withColumn("open", (F.col("v") == "not_enough_info") & F.col("e2").isNotNull())
    second = R.claim_verdict(F.col("c"), F.col("ct"), F.col("e2"), F.col("e2t"))["verdict"]
    terms = R.search_terms(F.col("ct"), F.col("et"))
    return again.select(
        "conv_id",
        "turn",
        "pos",
        "importance",
        F.when(F.col("open"), second).otherwise(F.col("v")).alias("verdict"),
        F.when(F.col("open"), 2).otherwise(1).alias("rounds"),
        F.when(F.col("open"), terms).alias("next_search"),
    )


def verify_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, rounds and follow-up search of every claim."""
    d = _verified(spark, sf_dir)
    return d.select("conv_id", "turn", "pos", "verdict", "rounds", F.md5(F.col("next_search").cast("binary")).alias("search_md5"))


def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval overlap and kind of error of every answer: all words of the question are wanted, all of the answer are found."""
    d = _turn_pairs(spark, sf_dir).withColumn("gold", F.array_distinct("q_tokens")).withColumn("got", F.array_distinct("a_tokens"))
    d = d.withColumn("met", F.size(F.array_intersect("gold", "got")))
    gold, got, met = F.col("gold"), F.col("got"), F.col("met")
    share = lambda xs: F.when(F.size(xs) > 0, met / F.size(xs)).otherwise(0.0)
    d = d.select(
        "conv_id",
        "turn",
        (M.token_scores(F.col("a_tokens"), F.col("q_tokens"))["f1"] >= 0.3).alias("correct"),
        E.abstains(F.col("a"), "retrieved").alias("abstained"),
        (met > 0).alias("hit"),
        ((F.size(gold) > 0) & (met == F.size(gold))).alias("full"),
        share(gold).alias("recall"),
        share(got).alias("precision"),
    )
    kind = R.answer_error(F.col("correct"), F.col("abstained"), F.col("hit"), F.col("full"), F.col("conv_id") % 11 == 0, F.col("conv_id") % 7 != 0)
    return d.select("conv_id", "turn", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), kind.alias("error_type"))


def route_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted routes against expected ones that the conversation's number gives, with an acceptable alternative for some."""
    wanted = F.get(F.array(*map(F.lit, ("direct", "retrieve", "abstain", "clarify"))), (F.col("conv_id") % 4).cast("int"))
    d = route_turns(spark, sf_dir).withColumn("expected", wanted)
    d = d.withColumn("mode", F.when(F.col("expected") == "retrieve", "single_step").otherwise("none"))
    cell = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('["direct", "'), F.col("expected"), F.lit('"]'))).otherwise("")
    kind = R.route_error(F.col("expected"), F.col("route"), T.list_cell(cell), F.col("retrieval_mode"), F.col("mode"))
    d = d.select("expected", F.col("route").alias("predicted"), kind.alias("error_type"))
    return d.groupBy("expected", "predicted", "error_type").agg(F.count("*").alias("n"))


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn wrapped as raw model output (plain, fenced, inside prose, cut off) and parsed back."""
    c = _read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    said = F.concat(F.trim("text"), F.lit(' {"}'))
    body = F.to_json(F.struct(said.alias("answer"), F.lit("82%").alias("confidence"), F.lit("no").alias("abstained")))
    kind = F.col("turn") % 4
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" done.")))
        .otherwise(F.left(body, F.length(body) - 2))
    )
    d = c.select("conv_id", "turn", payload.answer(raw).alias("p"))
    digest = F.when(F.col("p.valid"), F.md5(F.col("p.answer").cast("binary")))
    return d.select("conv_id", "turn", digest.alias("answer_md5"), "p.confidence", "p.abstained", "p.valid", "p.method")


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each claim, and one for an answer without any, so that no answer disappears."""
    d = _turn_pairs(spark, sf_dir).withColumn("cs", R.claims(F.col("answer"), None))
    none = F.array(F.struct(F.lit("").alias("claim_text"), F.lit("no_claims").alias("claim_type"), F.lit(False).alias("requires_evidence"), F.lit("none").alias("importance")))
    d = d.select("conv_id", "turn", F.posexplode(F.when(F.size("cs") > 0, F.col("cs")).otherwise(none)).alias("pos", "c"))
    return d.select("conv_id", "turn", "pos", F.col("c.claim_type").alias("claim_type"), F.length("c.claim_text").cast("long").alias("claim_chars"))


def vec_merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shown in two rounds as one list: the first round's, then the next unseen, six at most."""
    queries, corpus = _vectors(spark, sf_dir)
    first = VE.top_k(queries, corpus, 3)
    second = VE.top_k_unseen(queries, corpus, first.select("query_id", "id"), 5, 3)
    rows = lambda d: d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))  # noqa: E731  k entries at most
    ids = lambda c: F.transform(c, lambda x: x["id"])
    a, b = rows(first).withColumnRenamed("r", "a"), rows(second).withColumnRenamed("r", "b")
    merged = F.slice(F.array_distinct(F.concat(ids(F.col("a")), F.coalesce(ids(F.col("b")), F.array().cast("array<bigint>")))), 1, 6)
    return a.join(b, "query_id", "left").select("query_id", F.array_join(merged.cast("array<string>"), "|").alias("evidence"))


def keyword_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's topic: the one whose words it holds most of, the first of equals, "other" without any."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(T.normal(F.col("text")), " ")).alias("words"))
    return d.select("doc_id", R.topic(F.col("words"), L.TOPICS).alias("topic"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_ir_metrics, vec_topk, vec_topk_exclude_seen, vec_index_check, vec_index_parts, text_normalise_stats, sentence_stats, turn_token_f1, text_ladder,
        best_match, claim_verdicts, open_answers, route_turns, routed_prompts, route_counts, coerce_confidences, json_payload_fields,
        list_cells, group_summary, confusion_quality, prf_quality, question_rollup, value_counts, dq_issue_counts, dq_status, dq_keys,
        reconcile_orders, review_reasons, resume_todo, head_n_per_group, hash_sample, qrels_remap, strata_union, turn_positions, retrieval_policy,
        answer_claims, verify_rounds, answer_errors, route_errors, json_answers,
        claim_rows, vec_merge_evidence, keyword_topics,
    )
}
