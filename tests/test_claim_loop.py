"""Postings against all pairs, and the claim loop against the same steps one after the other."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions import text as T
from quillspark.jobs import evaluations as V
from quillspark.operators import claim_loop, lexical

WORDS = [f"word{i}" for i in range(60)] + ["the", "not"] + [f"rare{i}" for i in range(400)]


def f1(a, b):
    shared = sum((Counter(a) & Counter(b)).values())
    return 2 * shared / (len(a) + len(b)) if shared else 0.0


@pytest.mark.parametrize("least", [0.2, 0.34, 0.6, 0.95])
def test_postings_lose_no_pair(spark, least):
    rnd = random.Random(3)
    lists = lambda n: [(rnd.randint(0, 2), i, [rnd.choice(WORDS[: rnd.choice([10, 62, 460])]) for _ in range(rnd.randint(0, 14))]) for i in range(n)]
    left, right = lists(150), lists(120)
    right += [(g, 1000 + i, ws + ["more"]) for g, i, ws in left[:60]]
    a = spark.createDataFrame(left, "g int, l int, tokens array<string>")
    b = spark.createDataFrame(right, "g int, r int, tokens array<string>")
    met = {tuple(x) for x in lexical.alike_candidates(a, b, "g", "l", "r", least).collect()}
    pairs = {(g, i, j) for g, i, x in left for h, j, y in right if g == h}
    want = {(g, i, j) for g, i, x in left for h, j, y in right if g == h and f1(x, y) >= least}
    assert want <= met <= pairs and len(want) > 10
    if least >= 0.6:
        assert len(met) < len(pairs) / 10


def brute(claims, pieces):
    """The loop over the claims of each answer, in order, by the same column functions' scores."""
    out = {}
    state = defaultdict(lambda: {"seen": None, "spent": 0})
    for (turn, pos), kind, neg, start, ranked in sorted(claims, key=lambda c: c[0]):
        s = state[turn]
        if s["seen"] is None:
            s["seen"] = [p for p, _, _ in start]
        held, got, blocked, rounds = list(start), [], "", 1
        while True:
            best = max(held, key=lambda h: (h[1][0], -h[0]), default=None)
            any_neg = any(h[2] for h in held)
            if kind != "factual":
                verdict = "supported"
            elif best is None:
                verdict = "not_enough_info"
            elif best[1][0] >= 0.6 and neg != any_neg:
                verdict = "refuted"
            elif best[1][0] >= 0.45 or (best[1][1] >= 0.55 and best[1][2] >= 0.25):
                verdict = "supported"
            else:
                verdict = "not_enough_info"
            if verdict != "not_enough_info" or rounds >= claim_loop.ROUNDS:
                break
            if s["spent"] >= claim_loop.SEARCHES:
                blocked = "max_total_retrievals_reached"
                break
            s["spent"] += 1
            rounds += 1
            seen = set(s["seen"] if start else []) | {p for p, _, _ in held}
            fresh = [r for r in ranked if r[0] not in seen][: claim_loop.PER_ROUND]
            held, got = held + fresh, got + [p for p, _, _ in fresh]
            if start:
                s["seen"] = s["seen"] + [p for p, _, _ in fresh]
        out[turn, pos] = (verdict, rounds, got, blocked, s["spent"])
    return out


def test_long_conversation(spark, tmp_path, monkeypatch):
    """One conversation of 300 pieces, met through postings, some answers with very many claims."""
    rnd = random.Random(8)
    said = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."
    rows, piece = [], {}
    for turn in range(0, 600, 2):
        text = said(rnd.randint(3, 9)) if turn % 14 else "  "
        rows.append((1, turn, "user", text))
        if text.strip():
            piece[turn] = text
        near = [" ".join(rnd.choice(list(piece.values() or [text])).split()[: rnd.randint(2, 9)]) + "." for _ in range(rnd.choice([1, 3, 25]))] if piece else []
        rows.append((1, turn + 1, "assistant", " ".join([said(rnd.randint(2, 8)) for _ in range(3)] + near)))
    rows += [(2, 0, "user", "Is it red?"), (2, 1, "assistant", "It is red. I think so."), (3, 1, "assistant", "No question here.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"], r["pos"]): r for r in V.claim_loop(spark, str(tmp_path)).collect()}

    claims, pieces = V._claim_texts(spark, str(tmp_path)).collect(), V._pieces(spark, str(tmp_path)).collect()
    pieces = {p["piece"]: p for p in pieces if p["conv_id"] == 1}
    mine = [c for c in claims if c["conv_id"] == 1]
    pairs = spark.createDataFrame([(i, p) for i in range(len(mine)) for p in pieces], "i int, p long")
    left = spark.createDataFrame([(i, c["c"], c["tokens"]) for i, c in enumerate(mine)], "i int, c string, ct array<string>")
    right = spark.createDataFrame([(p, r["e"], r["tokens"]) for p, r in pieces.items()], "p long, e string, et array<string>")
    scored = pairs.join(left, "i").join(right, "p").select("i", "p", R.scores_against(*[F.col(x) for x in ("c", "ct", "e", "et")]).alias("s")).where("s.f1 > 0")
    found = defaultdict(list)
    for r in scored.collect():
        found[r["i"]].append((r["p"], (r["s"]["f1"], r["s"]["precision"], r["s"]["recall"]), pieces[r["p"]]["en"]))
    negated = dict(left.select("i", T.negated(F.col("c"))).collect())
    rows = []
    for i, c in enumerate(mine):
        turn = c["id"]["turn"]
        start = [f for f in found[i] if f[0] == turn - 1]
        if turn - 1 in pieces and not start:
            start = [(turn - 1, (0.0, 0.0, 0.0), pieces[turn - 1]["en"])]
        ranked = sorted((f for f in found[i] if f[1][0] >= claim_loop.LEAST), key=lambda f: (-f[1][0], f[0]))
        rows.append(((turn, c["id"]["pos"]), c["claim_type"], negated[i], start, ranked))
    want = brute(rows, pieces)
    assert len(want) > 2000
    for (turn, pos), (verdict, rounds, ids, blocked, counter) in want.items():
        r = got[1, turn, pos]
        assert (r["verdict"], r["rounds"], r["retrieved"], r["blocked"], r["counter"]) == (verdict, rounds, "|".join(map(str, ids)), blocked, counter)
    assert {b for _, _, _, b, _ in want.values()} == {"", "max_total_retrievals_reached"} and any(len(w[2]) == 2 for w in want.values())
    assert got[2, 1, 0]["verdict"] == "supported"

    # the same evidence whether postings or whole conversations are met
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    posted = key(V.claim_evidence(spark, str(tmp_path)))
    monkeypatch.setattr(lexical, "FEW", 1000)
    assert key(V.claim_evidence(spark, str(tmp_path))) == posted


def test_very_many_claims_of_one_answer(spark, tmp_path):
    answer = " ".join(f"Thing{i} holds part{i}." for i in range(100_000))
    rows = [(1, 0, "user", "What holds?"), (1, 1, "assistant", answer), (1, 2, "user", "Thing99999 holds part99999 and thing3 holds part3.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    d = V.claim_loop(spark, str(tmp_path))
    got = {(r["blocked"], r["rounds"], r["counter"]): r["n"] for r in d.groupBy("blocked", "rounds", "counter").agg(F.count("*").alias("n")).collect()}
    assert got == {**{("", 2, k): 1 for k in range(1, 7)}, ("max_total_retrievals_reached", 1, 6): 99_994}
