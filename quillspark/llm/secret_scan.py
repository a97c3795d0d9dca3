r"""Secret scans over a trigram inverted index (operator 5), in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: alternatives ("clauses"),
each a set of trigrams that any match of the clause must contain. The index has postings
(trigram, doc_id): the document's text, lower-cased, holds the trigram. One trigram of each clause
is its gate, and the others are looked for only in texts that hold it, as no other could complete
the clause; a few gates serve all clauses. The index is stored and serves any number of scans. The
postings of a clause's trigrams are intersected by grouping on (doc_id, clause); a document is a
candidate of a rule if one of its clauses is complete. Only candidates are verified with the rule's
expression. Rules without mandatory trigrams ("hex") scan every text. Texts are not shuffled as long
as the candidates' ids are few enough to go to all tasks (``MOST_SENT``).

Matches are leftmost and non-overlapping for each rule; their places, in code points, follow from
the lengths of the matches and of the gaps between them, summed in blocks so that time grows in
proportion. Null text is empty and has no span. Rows that share a doc_id share candidates, which
verification makes exact; null doc_ids are one such id.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as op
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, stored


class Rule(NamedTuple):
    """A kind of secret: its expression, and the least code points of a group for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Rules in the order that breaks ties of spans with the same start; the first three are the base.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # as runs of hex digits, shorter ones dropped
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?i)bearer\x20[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{1,64}@[A-Za-z0-9.-]+"),
)
BASE = RULES[:3]
MASK = "[SECRET]"
#: Sets of strings beyond this size are cut off into a clause of their own.
MOST_STRINGS = 64
#: Candidates (an id and a number each) that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Elements of a block of a running sum.
BLOCK = 256
#: English letters by falling frequency: a gate of rarer letters is met less.
_COMMON = "etaoinshrdlucmfwypvbgkjqxz"


def _trigrams(strings: set[str]) -> list[frozenset[str]]:
    """One clause for each string; none at all if a string is too short to have a trigram."""
    if not strings or min(map(len, strings)) < 3:
        return []
    return [frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings]


def _strings(node) -> set[str] | None:
    """All strings that a parsed expression can match, if they are few."""
    out = {""}
    for code, arg in node:
        if code is op.LITERAL:
            part = {chr(arg)}
        elif code is op.IN and all(c is op.LITERAL for c, _ in arg):
            part = {chr(x) for _, x in arg}
        elif code is op.SUBPATTERN:
            part = _strings(arg[3])
        elif code is op.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif code is op.MAX_REPEAT and arg[1] <= 8:
            inner = _strings(arg[2])
            part = None if inner is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)}
        else:
            part = None
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _all_of(left: list[frozenset[str]], right: list[frozenset[str]]) -> list[frozenset[str]]:
    """Clauses that must hold together; no clause means nothing is asked."""
    return [a | b for a in left for b in right] if left and right else left or right


def _query(node) -> list[frozenset[str]]:
    clauses: list[frozenset[str]] = []
    run = {""}
    for item in node:
        part = _strings([item])
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        clauses, run = _all_of(clauses, _trigrams(run)), part or {""}
        if part is None:
            code, arg = item
            if code is op.SUBPATTERN:
                clauses = _all_of(clauses, _query(arg[3]))
            elif code is op.MAX_REPEAT and arg[0] >= 1:
                clauses = _all_of(clauses, _query(arg[2]))
            elif code is op.BRANCH and all(parts := [_query(x) for x in arg[1]]):
                clauses = _all_of(clauses, [c for x in parts for c in x])
    return _all_of(clauses, _trigrams(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of ``pattern``, least ones only; empty if no trigram is mandatory."""
    found = set(_query(_parser.parse(pattern)))
    return sorted((c for c in found if not any(o < c for o in found)), key=sorted)


def gates(clauses: set[frozenset[str]]) -> dict[str, set[frozenset[str]]]:
    """A trigram for each of a few groups of ``clauses``, one that all of the group ask for."""
    left, out = set(clauses), {}
    rare = lambda g: sum(_COMMON.find(c) if c in _COMMON else len(_COMMON) for c in g)
    while left:
        asked = {g: {c for c in left if g in c} for g in set().union(*left)}
        best = max(asked, key=lambda g: (len(asked[g]), rare(g), g))
        out[best] = asked[best]
        left -= asked[best]
    return out


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the rules' trigrams over ``docs`` (doc_id, text)."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    none = F.array().cast("array<string>")
    held = []
    for gate, clauses in sorted(gates({c for r in rules for c in trigram_query(r.pattern)}).items()):
        others = sorted(set().union(*clauses) - {gate})
        more = F.filter(F.array(*map(F.lit, others)), lambda g: F.contains(F.col("low"), g)) if others else none
        held.append(F.when(F.contains("low", F.lit(gate)), F.concat(F.array(F.lit(gate)), more)).otherwise(none))
    found = low.select("doc_id", F.flatten(F.array(*held)).alias("held")) if held else low.select("doc_id", none.alias("held"))
    return found.select("doc_id", F.explode("held").alias("trigram")).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): the bit set of rules whose trigram query the document's postings meet."""
    rows = [
        (c, k, i, g)
        for c, (k, clause) in enumerate((k, q) for k, r in enumerate(rules) for q in trigram_query(r.pattern))
        for i, g in enumerate(sorted(clause))
    ]
    size: dict[int, int] = {}
    for c, *_ in rows:
        size[c] = size.get(c, 0) + 1
    terms = postings.sparkSession.createDataFrame(
        [(c, k, (1 << size[c]) - 1, 1 << i, g) for c, k, i, g in rows],
        "clause int, rule int, full long, bit long, trigram string",
    )
    # the terms are as many as the rules ask for, whatever the data
    met = postings.join(F.broadcast(terms), "trigram")
    whole = met.groupBy("doc_id", "clause", "rule", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return whole.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _before(values: Column, combine, zero: Column) -> Column:
    """For each element of an array column the combination of all before it, in blocks, so that appending stays cheap.

    ``values`` is a column of the row: an expression would be evaluated again for each block.
    """
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")

    def within(start, block):
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step)

    done = F.aggregate(
        starts,
        F.array(F.struct(zero.alias("at"), none.alias("out"))),
        lambda acc, i: F.array_append(acc, within(F.element_at(acc, -1)["at"], F.slice(values, i, BLOCK))),
    )
    return F.flatten(F.transform(done, lambda x: x["out"]))


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (gap, size, counts): code points before, in, and in the counted group of each match; null without any."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counts = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    sized = F.zip_with(
        F.split(text, rule.pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), counts(m).alias("counts"))
    )
    return F.when(text.rlike(rule.pattern), F.filter(sized, lambda x: x["size"].isNotNull()))


def _spans(sized: Column, before: Column, k: int, rule: Rule) -> Column:
    """Array of (start, kind's number, end) of those matches, as ``_matches`` gives them, that count."""
    placed = F.zip_with(sized, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), x["size"].alias("size"), x["counts"].alias("counts")))
    fine = F.filter(placed, lambda x: x["counts"] >= rule.least)
    return F.transform(fine, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), (x["start"] + x["size"]).alias("end")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """``docs`` packed into the struct ``doc``, with ``spans``: (start, kind's number, end), sorted.

    ``index``: postings that ``build_index`` gave for these documents and rules, if they are stored already.
    """
    index = stored(build_index(docs.select("doc_id", "text"), rules), "postings") if index is None else index
    found = stored(candidates(index, rules), "found")
    if found.count() <= MOST_SENT:
        found = F.broadcast(found)
    d = docs.select(F.struct("*").alias("doc")).select("doc", F.coalesce("doc.text", F.lit("")).alias("text"))
    d = d.join(found, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")), "left").select("doc", "text", "rules")
    sized = []
    for k, rule in enumerate(rules):
        each = _matches(F.col("text"), rule)
        if trigram_query(rule.pattern):
            each = F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, each)
        sized.append(each.alias(f"m{k}"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    d = d.select("doc", *sized)
    each = range(len(rules))
    d = d.select("*", *[F.transform(f"m{k}", lambda x: x["gap"] + x["size"]).alias(f"v{k}") for k in each])
    d = d.select("*", *[F.when(F.col(f"v{k}").isNotNull(), _before(F.col(f"v{k}"), lambda a, b: a + b, F.lit(0))).alias(f"b{k}") for k in each])
    parts = [F.coalesce(_spans(F.col(f"m{k}"), F.col(f"b{k}"), k, rule), empty) for k, rule in enumerate(rules)]
    return d.select("doc", F.sort_array(F.concat(*parts)).alias("spans"))


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


#: Code points of a block of a text; a place far into a text is dear to reach, one in a block is not.
TEXT_BLOCK = 4096


def _piece(a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` of the text whose blocks are the column ``blocks``."""
    part = lambda i, a, b: F.coalesce(F.substring(F.get("blocks", i), a + 1, b - a), F.lit(""))
    first, last = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(b / TEXT_BLOCK).cast("int")
    inner = F.array_join(F.slice("blocks", first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    many = F.concat(part(first, a - first * TEXT_BLOCK, F.lit(TEXT_BLOCK)), inner, part(last, F.lit(0), b - last * TEXT_BLOCK))
    return F.when(a >= b, "").when(first == last, part(first, a - first * TEXT_BLOCK, b - first * TEXT_BLOCK)).otherwise(many)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret, or run of overlapping ones, replaced by ``MASK``; n_chars follows if present."""
    d = find_secrets(docs, rules).select("doc", "spans", F.col("doc.text").alias("text"))
    some = F.size("spans") > 0
    d = d.select(
        "*",
        F.when(some, F.transform("spans", lambda s: s["end"])).alias("ends"),
        F.when(some, F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % TEXT_BLOCK), F.lit(0))).alias("blocks"),
    )
    d = d.select("*", F.when(some, _before(F.col("ends"), lambda a, b: F.greatest(a, b), F.lit(0))).alias("before"))
    # a span that starts where all before it have ended begins a new run; the gap before it is kept
    gaps = F.filter(F.zip_with("spans", "before", lambda s, e: F.struct(e.alias("a"), s["start"].alias("b"))), lambda g: g["a"] <= g["b"])
    d = d.select("*", F.array_max("ends").alias("last"), F.length("text").alias("size"))
    kept = F.array_join(F.transform(gaps, lambda g: _piece(g["a"], g["b"])), MASK)
    cut = F.concat(kept, F.lit(MASK), _piece(F.col("last"), F.col("size")))
    d = d.select("doc", "spans", F.when(some, cut).otherwise(F.col("text")).alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        made["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return d.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    d = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc.doc_id",
        *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)],
        F.sha2(_shown(base, RULES).cast("binary"), 256).alias("base_sha256"),
        _shown(F.col("spans"), RULES).alias("spans"),
    )
