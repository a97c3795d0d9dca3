"""Claim payloads of any shape against plain Python, on random and odd JSON."""

import json
import random

from pyspark.sql import functions as F

from quillspark.functions import claim_payload as C


def results_of(obj):
    """(claim_id, verdict, requires_evidence, rounds, evidence, retrieved) as the columns must give them."""
    out = []
    for x in obj.get("claim_results") if isinstance(obj.get("claim_results"), list) else []:
        if not isinstance(x, dict):
            continue
        verdict = str(x.get("verdict") or "").strip().lower().replace(" ", "_").replace("-", "_")
        need = str(x.get("requires_evidence")).strip().lower() in ("true", "t", "yes", "y", "1")
        try:
            rounds = int(float(str(x.get("rounds")).replace(",", ".")))
        except ValueError:
            rounds = 0
        traced = [i for r in (x.get("rounds_trace") if isinstance(x.get("rounds_trace"), list) else []) if isinstance(r, dict) for i in ids_of(r.get("retrieved_chunk_ids"))]
        out.append((str(x.get("claim_id") or "").strip(), C.VERDICT_ALIASES.get(verdict, verdict), need, rounds, ids_of(x.get("evidence_ids")), ids_of(x.get("retrieved_chunk_ids")) + traced))
    return out


def ids_of(v):
    if v is None:
        return []
    if not isinstance(v, list):
        try:
            inner = json.loads(v)
        except (ValueError, TypeError):
            inner = None
        v = inner if isinstance(inner, list) else str(v).split("|")
    return list(dict.fromkeys(str(x).strip() for x in v if x is not None and str(x).strip()))


def random_object(rnd):
    ids = lambda: rnd.choice([None, [], ["a", " b ", "a", None], "x|y||x", '["p", "q"]', "one", ""])
    result = lambda: rnd.choice([
        7, None, "text", {},
        {"claim_id": rnd.choice(["c1", " c2 ", None]), "verdict": rnd.choice(["Supports", "refuted", "N E I", "nei", "entails", None, "odd one"]), "requires_evidence": rnd.choice([True, "yes", "no", 1, None]),
         "rounds": rnd.choice([2, "3", "1,0", "many", None]), "evidence_ids": ids(), "retrieved_chunk_ids": ids(), "rounds_trace": rnd.choice([None, "no", [{"retrieved_chunk_ids": ids()}, 4]])},
    ])
    return {"claim_results": rnd.choice([None, "cut", [result() for _ in range(rnd.randint(0, 4))]]), "answer": rnd.choice(["It is.", "", None])}


def test_results_of_random_objects(spark):
    rnd = random.Random(6)
    objects = [random_object(rnd) for _ in range(300)]
    d = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "i int, raw string")
    got = d.select("i", C.results(C.json_object(F.col("raw"))["value"]).alias("r")).orderBy("i").collect()
    for row, obj in zip(got, objects, strict=True):
        mine = [(x["claim_id"], x["verdict"], x["requires_evidence"], x["rounds"], x["evidence"], x["retrieved"]) for x in row["r"]]
        assert mine == results_of(obj), obj


def one(spark, raw, **cells):
    d = spark.range(1).select(C.claims_object(F.lit(raw).cast("string"), {k: F.lit(v).cast("string") for k, v in cells.items()}).alias("o"))
    return d.first()["o"]


def test_object_columns_and_errors(spark):
    full = {"answer": " A. ", "confidence": 82, "abstained": "no", "final_decision": "Run-Error", "num_claims": "7", "evidence_ids": "e1|e2", "num_chunks_retrieved_total": 4, "error": ""}
    o = one(spark, "```json\n" + json.dumps(full) + "\n```")
    assert (o["answer"], o["confidence"], o["abstained"], o["final_decision"], o["num_claims"], o["evidence_ids"], o["num_chunks_retrieved_total"]) == ("A.", 0.82, False, "error", 7, "e1|e2", 4)
    assert (o["valid"], o["method"], o["parse_error"]) == (False, "raw_output_json", "")
    o = one(spark, '{"answer": "cut', answer="col", claim_results='[{"claim_id": "c1", "verdict": "entails", "evidence_ids": "k"}]', retrieved_chunk_ids='["r", "r"]')
    assert (o["answer"], o["num_supported_claims"], o["supported_ids"], o["evidence_ids"], o["retrieved_chunk_ids"], o["valid"]) == ("col", 1, "c1", "k", "r", True)
    assert (o["method"], o["parse_error"]) == ("columns_after_parse_error", "no JSON object")
    assert one(spark, "{bad}", answer="x")["parse_error"] == "invalid JSON"
    o = one(spark, None, final_decision="Sideways", error="boom")
    assert (o["method"], o["run_error"], o["valid"], o["parse_error"]) == ("columns", True, False, "no answer; unknown decision sideways")
    assert one(spark, "[1, 2]")["parse_error"] == "no JSON object; no answer"


def test_extraction(spark):
    odd = {"claims": [{"claim_text": "- It is red."}, {"claim_text": "it  IS red."}, 5, {"claim_text": " "}, {"claim_text": "Ok", "claim_type": "Answer Choice", "importance": "Supporting", "requires_evidence": "maybe"}], "needs_verification": "no", "extraction_notes": " n "}
    rows = [(json.dumps(odd), "x"), ("{}", "Please clarify."), ('{"claims": "none"}', "Not enough evidence"), ("broken", "It is."), (None, None), ('{"claims": []}', "  ")]
    d = spark.createDataFrame(rows, "j string, a string").select(C.extraction(C.parsed(F.col("j")), F.col("a")).alias("x"))
    got = [([tuple(c) for c in r["x"]["claims"]], r["x"]["needs_verification"], r["x"]["notes"]) for r in d.collect()]
    assert got == [
        ([("c1", "It is red.", "factual", True, "core"), ("c2", "Ok", "answer_choice", False, "supporting")], False, "n"),
        ([("c1", "Please clarify.", "clarification", False, "core")], False, ""),
        ([("c1", "Not enough evidence", "abstention", False, "core")], False, ""),
        ([("c1", "It is.", "factual", True, "core")], True, ""), ([], False, ""), ([], False, ""),
    ]
    many = json.dumps({"claims": [{"claim_text": f"claim {i}"} for i in range(9)]})
    d = spark.createDataFrame([(many,)], "j string")
    assert [d.select(F.size(C.extraction(C.parsed(F.col("j")), F.lit("x"), m)["claims"])).first()[0] for m in (5, None)] == [5, 9]


def test_verification_and_passages(spark):
    rows = [
        ('{"verdict": "Entailed", "confidence": "95", "supporting_chunk_ids": ["c9", "c2", "c2"], "needs_more_evidence": true, "next_search_query": "q"}', "supported", 0.95, ["c2"], [], False, None),
        ('{"verdict": "refuted", "refuting_chunk_ids": "zz"}', "refuted", 0.0, [], ["c1"], False, None),
        ('{"verdict": "insufficient", "confidence": "x", "next_search_query": " more "}', "not_enough_info", 0.0, [], [], True, "more"),
        (None, "not_enough_info", 0.0, [], [], True, None),
    ]
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, j string").select("i", C.verification(C.parsed(F.col("j")), F.array(F.lit("c1"), F.lit("c2")), True).alias("v"))
    for r, want in zip(d.orderBy("i").collect(), rows, strict=True):
        v = r["v"]
        assert (v["verdict"], v["confidence"], v["supporting"], v["refuting"], v["needs_more"], v["next_search"]) == want[1:] and v["rationale"]
    j = '[{"text": " t "}, 3, {"chunk_id": "k"}, {"chunk_id": "z", "rank": "7", "text": "y", "score": 0.5, "title": 4}]'
    d = spark.createDataFrame([(j,), ("{}",), ("no",), (None,)], "j string").select(C.chunks(C.parsed(F.col("j"))).alias("c")).collect()
    assert [(c["rank"], c["chunk_id"], c["text"], c["score"], c["title"]) for c in d[0]["c"]] == [(1, "chunk_inline_1", "t", None, ""), (7, "z", "y", 0.5, "4")]
    assert [r["c"] for r in d[1:]] == [[], [], []]
