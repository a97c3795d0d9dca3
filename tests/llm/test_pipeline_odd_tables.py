"""The whole pipeline on tables with clashing extra columns and on an empty one."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures


def test_extra_columns_and_empty_table(spark, tmp_path):
    docs = fixtures.documents(spark, n=30)
    labels = fixtures.labels(spark, docs)
    plain, odd, empty = (str(tmp_path / x) for x in ("plain", "odd", "empty"))
    clashing = docs
    for name in ("kept", "words", "row", "_key", "_fp", "_doc", "score", "spans", "piece", "stratum"):
        clashing = clashing.withColumn(name, F.lit("x"))
    for path, d in ((plain, docs), (odd, clashing), (empty, docs.limit(0))):
        d.coalesce(2).write.parquet(f"{path}/documents.parquet")
        (labels if path != empty else labels.limit(0)).coalesce(1).write.parquet(f"{path}/labels.parquet")
    rows = lambda path: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, path).collect())
    got = rows(plain)
    assert len(got) > 15 and rows(odd) == got
    assert rows(empty) == []
