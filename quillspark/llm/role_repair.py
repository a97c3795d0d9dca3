"""Repair of conversations by generalised LR parsing with weighted edits (operator 13).

A conversation's role initials should read ``(s?(ua)+)?``. Its grammar::

    talk -> (nothing) | pairs | s pairs      pairs -> pair | pairs pair      pair -> u a

is held as an LR table. Stacks are linked nodes, so readings share what they have in common, and a
reading's future depends on its stack's top alone: of equal tops that of the least (cost, audit)
stays, with its stack. Each row may be kept, reroled or deleted, and rows may be inserted before it;
every edit but the deletion shifts a role, reductions follow at once. Audits of equal length in rows
are no beginnings of each other, so their order is a rank among the few readings that are open, and a
step depends on the rows' kind, the open stacks, their costs above the least and their ranks: it is
worked out once for each such case and looked up after that.

Rows go to the partition of their conversation in one shuffle and are sorted there; a task reads them
as a stream and keeps, of a conversation, a reference for each row and a hash state for each open reading,
no texts. A very long conversation is thus one sorted stream: the digest of its repaired text is
sequential by its nature.

Order: turn, nulls first; then role and text. A null role or text is one space; a null conv_id is a
conversation of its own. A row's first fault counts: blank, duplicate (role and text seen earlier),
truncated. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, read

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The LR table: shifts, reductions (symbol, length) and what follows them; states at which a conversation may end.
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 4, (3, "u"): 4, (4, "a"): 7}
REDUCE = {7: ("pair", 2), 5: ("pairs", 1), 6: ("pairs", 2)}
GOTO = {(0, "pair"): 5, (1, "pair"): 5, (2, "pair"): 6, (3, "pair"): 6, (0, "pairs"): 2, (1, "pairs"): 3}
ENDS = (0, 2, 3)
ROLES = {"u": "user", "a": "assistant"}
GOOD, MUST_GO, CUT = 0, 1, 2
#: The bottom of every stack: (state, node below).
BOTTOM = (0, None)
#: Readings open before the first row: stack, cost above the least, rank.
START = ((BOTTOM, 0, 0),)


def _shifted(stack, role: str):
    """The stack after a role and the reductions that follow; None if the role cannot stand there."""
    state = SHIFT.get((stack[0], role))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        symbol, length = REDUCE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (GOTO[stack[0], symbol], stack)
    return stack


def _with_inserts(readings):
    """Open readings by top: (cost, rank, letters, source, parts, stack), inserted rows before the next one included."""
    best = {}
    waiting = [(cost, rank, "", i, (), stack) for i, (stack, cost, rank) in enumerate(readings)]
    while waiting:
        least = min(waiting, key=lambda r: r[:3])
        waiting.remove(least)
        cost, rank, letters, source, parts, stack = least
        if stack[0] in best and best[stack[0]][:3] <= least[:3]:
            continue
        best[stack[0]] = least
        for role in ROLES:
            if after := _shifted(stack, role):
                waiting.append((cost + INSERT, rank, letters + "I", source, (*parts, (ROLES[role], False)), after))
    return best


@lru_cache(maxsize=None)
def _step(readings, initial: str, fault: int):
    """(open readings after a row, what the least cost rises by, for each of them (source, letters, parts)).

    ``parts``: the rows that the reading puts out, each as (new role or None for its own, is it the row's text?).
    """
    best = {}

    def offer(cost, rank, letters, source, parts, stack):
        if stack is not None and (stack[0] not in best or (cost, rank, letters) < best[stack[0]][:3]):
            best[stack[0]] = (cost, rank, letters, source, parts, stack)

    for cost, rank, letters, source, parts, stack in _with_inserts(readings).values():
        offer(cost + DELETE, rank, letters + "D", source, parts, stack)
        if fault == MUST_GO:
            continue
        cost += TRUNCATED if fault == CUT else 0
        offer(cost, rank, letters + "K", source, (*parts, (None, True)), _shifted(stack, initial))
        for role, name in ROLES.items():
            offer(cost + REROLE, rank, letters + "R", source, (*parts, (name, True)), _shifted(stack, role))
    left = [best[top] for top in sorted(best)]
    low = min(r[0] for r in left)
    order = sorted((r[1], r[2]) for r in left)
    after = tuple((r[5], r[0] - low, order.index((r[1], r[2]))) for r in left)
    return after, low, tuple((r[3], r[2], r[4]) for r in left)


@lru_cache(maxsize=None)
def _last(readings):
    """(source, letters, parts, cost above the least) of the cheapest whole reading."""
    cost, _, letters, source, parts, _ = min((r for top, r in _with_inserts(readings).items() if top in ENDS), key=lambda r: r[:3])
    return source, letters, parts, cost


class _Conversation:
    """One conversation while its rows go by."""

    def __init__(self):
        from hashlib import sha256

        self.readings, self.cost, self.steps, self.hashes = START, 0, [], [(sha256(), True)]
        self.least = self.most = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    @staticmethod
    def _fed(state, parts, role, text):
        digest, fresh = state
        digest = digest.copy()
        for name, own in parts:
            digest.update((("" if fresh else "\n") + (role if name is None else name) + ":" + (text if own else "")).encode("utf-8", "surrogatepass"))
            fresh = False
        return digest, fresh

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.turns += self.turns == 0 or turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        step = _step(self.readings, initial, {"blank": MUST_GO, "duplicate": MUST_GO, "truncated": CUT}.get(fault, GOOD))
        self.readings, rise, moves = step
        self.cost += rise
        self.steps.append(moves)
        self.hashes = [self._fed(self.hashes[source], parts, role, text) for source, _, parts in moves]

    def report(self) -> tuple:
        source, letters, parts, over = _last(self.readings)
        digest = self._fed(self.hashes[source], parts, "", "")[0].hexdigest()
        found = [letters]
        for moves in reversed(self.steps):
            source, letters, _ = moves[source]
            found.append(letters)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + over, "".join(reversed(found)), digest


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there, fault): rows sorted within their conversation's partition, each with its first fault or "".

    ``there`` (true where ``rows`` has no such column) says whether a row exists; others only stand for their conversation.
    """
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), there.alias("there")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "there").orderBy("turn"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(seen > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return d.withColumn("fault", fault).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows (conv_id, turn, role, text)``: its faults, the cheapest repair's cost and audit, the repaired text's SHA-256."""
    kind = dict(rows.dtypes)["conv_id"]
    d = ordered(rows)

    def run(batches):
        import pyarrow as pa

        at, talk, ids, done = None, None, [], []

        def out():
            columns = [pa.array(ids, id_type), *[pa.array([r[i] for r in done], t) for i, t in enumerate(types)]]
            return pa.record_batch(columns, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        types, id_type = [*[pa.int64()] * 6, pa.string(), pa.string()], None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, role, text, there, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "fault")], strict=True):
                if talk is None or conv != at:
                    if talk is not None:
                        ids.append(at)
                        done.append(talk.report())
                    at, talk = conv, _Conversation()
                if there:
                    talk.add(turn, role, text, fault)
            if len(ids) >= 4096:
                yield out()
                ids, done = [], []
        if talk is not None:
            ids.append(at)
            done.append(talk.report())
        if ids:
            yield out()

    shape = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return d.mapInArrow(run, f"conv_id {kind}, {shape}")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, turn, role, text); ``place`` counts from 1, an inserted row has no turn."""
    letters = report(rows).select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit"), F.length(F.replace("audit", F.lit("D"), F.lit(""))).alias("size"))
    so_far = Window.partitionBy("conv_id").orderBy("at")
    count = lambda edits: F.count_if(F.col("edit").isin(*edits)).over(so_far)
    letters = letters.where("edit <> ''").select("conv_id", "edit", "size", count("KRD").alias("n"), count("KRI").alias("place")).where("edit <> 'D'")
    # an odd number of rows starts with a system row
    turn = F.when((F.col("place") + F.col("size")) % 2 == 1, "user").otherwise("assistant")
    there = ordered(rows).where("there")
    numbered = there.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("n"), "turn", F.col("role").alias("own"), "text")
    own = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.n") == F.col("r.n")) & (F.col("edit") != "I")
    d = letters.alias("l").join(numbered.alias("r"), own, "left")
    return d.select("l.conv_id", "place", "edit", "turn", F.when(F.col("edit") == "K", F.col("own")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that their ids' CRC-32 modulo 20 deals out; ``there`` is false where a row is dropped."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    d = d.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "code", F.explode(copies))
    return d.select("conv_id", "turn", "role", "text", (F.col("code") != 0).alias("there"))


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation of ``conversations`` after damage."""
    return report(damaged(read(spark, sf_dir, "conversations")))
