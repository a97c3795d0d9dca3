"""Conversation repair against a search over all edits in plain Python, on damaged and odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import role_repair

SHAPE = "conv_id long, turn long, role string, text string"
LAWFUL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least (cost, audit) by a plain best-first search whose states are (rows read, last role put out, any system row first)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for r in "ua":
            if r in follows:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*out, ({"u": "user", "a": "assistant"}[r], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault[i] in ("", "truncated"):
                more = 5 if fault[i] else 0
                if role[:1] and role[:1] in follows:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follows:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, r, (*out, (name, text))))
    raise AssertionError


def plain(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault = faults(talk)
        turns = [t for t, _, _ in talk if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(talk, talk[1:])]
        cost, audit, said = cheapest(talk, fault)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        counts = [fault.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = ((gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest), said)
    return out


def random_rows(seed, talks=150):
    rnd = random.Random(seed)
    texts = ["Hello.", "What?", "no end", "", "  \n", "Yes!  ", "Fine. \x0b", "x", "Ünd. ", None]
    rows = []
    for c in range(talks):
        for t in range(rnd.randint(0, 11)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c if c % 40 else None, rnd.choice([t, t, t, t + 3, None, -t]), role, rnd.choice(texts)))
    rows += [(900, 0, "user", "Hi."), (900, 1, "assistant", "Hi."), (901, None, "system", "Only."), (902, 5, "system", "a."), (902, 5, "system", "a.")]
    rows += [(903, t, "system", f"Row {t}.") for t in range(40)] + [(904, t, "user", f"Row {t}") for t in range(30)]
    return rows


def test_reports_and_repaired_rows(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, SHAPE).withColumn("fault", F.lit("clash")).withColumn("there_too", F.lit(1)).repartition(3)
    want = plain(rows)
    got = {r[0]: tuple(r)[1:] for r in role_repair.report(df).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    said = defaultdict(dict)
    for r in role_repair.repaired(df).collect():
        assert r["place"] not in said[r["conv_id"]]
        said[r["conv_id"]][r["place"]] = (r["role"], r["text"])
    for c, (_, out) in want.items():
        assert [said[c][k] for k in sorted(said[c])] == list(out)
        assert LAWFUL.fullmatch("".join(r[:1] for r, _ in out))


@pytest.mark.parametrize("seed", range(2, 5))
def test_query_on_damaged_rows(spark, tmp_path, seed):
    rows = random_rows(seed, 400)
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: empty for c in ids} | {c: w for c, (w, _) in plain(damaged).items()}
    got = {r[0]: tuple(r)[1:] for r in role_repair.op13_role_repair(spark, str(tmp_path)).collect()}
    assert got == want and any(w == empty for w in want.values())


def test_empty_table_and_long_conversation(spark):
    assert role_repair.report(spark.createDataFrame([], SHAPE)).count() == 0
    assert role_repair.repaired(spark.createDataFrame([], SHAPE)).count() == 0
    rows = [(7, t, ("system", "tool")[t % 2], f"{t}.") for t in range(60_000)] + [(8, 0, "user", "x" * 2_000_000), (8, 1, "assistant", "y.")]
    got = {r["conv_id"]: r for r in role_repair.report(spark.createDataFrame(rows, SHAPE)).collect()}
    # no row can be a pair's as it is: the first stays, the others are reroled, and the last has no partner
    assert got[7]["cost"] == 59_998 + 2 and got[7]["audit"].count("R") == 59_998 and got[7]["audit"].count("D") == 1
    assert role_repair._step.cache_info().currsize < 5000
    assert (got[8]["cost"], got[8]["audit"]) == (4, "DD")
