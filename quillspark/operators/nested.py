"""Nested examples (a question with titled passages and the titles that support it) to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: What an example holds: ``context`` lists its passages, ``supporting`` the titles that its answer rests on.
EXAMPLE = "id string, question string, answer string, context array<struct<title:string,text:string>>, supporting array<string>"


def chunks(examples: DataFrame) -> DataFrame:
    """(question_id, chunk_id, place, title, text, is_gold): a row for each passage; gold by normalised title."""
    titles = F.transform("supporting", T.normal).alias("titles")
    d = examples.select(F.col("id").alias("question_id"), titles, F.posexplode("context").alias("place", "c"))
    return d.select(
        "question_id",
        F.format_string("%s_chunk_%02d", "question_id", "place").alias("chunk_id"),
        "place",
        F.col("c.title").alias("title"),
        F.col("c.text").alias("text"),
        F.coalesce(F.array_contains("titles", T.normal(F.col("c.title"))), F.lit(False)).alias("is_gold"),
    )


def judgements(passages: DataFrame) -> DataFrame:
    """(question_id, chunk_id, relevance) of the gold passages."""
    return passages.where("is_gold").select("question_id", "chunk_id", F.lit(1).alias("relevance"))


def questions(examples: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, question, answer, n_context, n_gold, gold_ids): an example's passages are in one row already, so their ids are few enough to list."""
    sums = passages.groupBy("question_id").agg(
        F.count("*").alias("n_context"),
        F.count_if("is_gold").alias("n_gold"),
        F.array_sort(F.collect_list(F.when(F.col("is_gold"), F.struct("place", "chunk_id")))).alias("gold"),
    )
    d = examples.join(sums, F.col("id") == F.col("question_id"), "left")
    ids = F.array_join(F.transform("gold", lambda g: g["chunk_id"]), "|")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("id", "question", "answer", zero("n_context"), zero("n_gold"), F.coalesce(ids, F.lit("")).alias("gold_ids"))


def embedding_text(title, text):
    """What is embedded of a passage: title and text, or whichever there is."""
    t, x = T.clean(title), T.clean(text)
    both = F.concat(F.lit("Title: "), t, F.lit("\nText: "), x)
    return F.when((t != "") & (x != ""), both).when(t != "", t).otherwise(x)
