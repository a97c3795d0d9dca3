"""DuckDB SQL of the evaluation queries."""

from __future__ import annotations

from quillspark.functions import lexicon as L
from quillspark.functions.evaluate import markers
from quillspark.jobs import evaluations as V
from quillspark.operators import active_loop as ACTIVE
from quillspark.operators import claim_loop as LOOP
from quillspark.jobs.oracles import _CLAIMS, _PAIRS, _POLICY, _ROUTES, _SURENESS, _any, _f1, _negated, _normal, _overlap, _q, _low, _sentences, _stated, _tokens

_ONCE = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"

_RUNS_OF = f"""
    gathered AS (
      SELECT p.*, l.text AS later, trim(coalesce(s.text, '')) AS source_answer, quality, toxic, lang, r.route AS used,
             list_concat(list_filter([trim(coalesce(question, '')), trim(coalesce(l.text, ''))], lambda x: x <> ''), {_sentences("question")}) AS listed
      FROM pairs p JOIN routed r ON r.conv_id = p.conv_id AND r.turn = p.turn - 1
      LEFT JOIN conversations l ON l.conv_id = p.conv_id AND l.turn = p.turn + 1
      LEFT JOIN conversations s ON s.conv_id = p.conv_id AND s.turn = p.turn - 2 AND s.role = 'assistant'
      LEFT JOIN labels m ON m.doc_id = p.conv_id LEFT JOIN documents d ON d.doc_id = p.conv_id
    ),
    once AS (SELECT *, {_ONCE("listed")} AS golds FROM gathered),
    gl AS (SELECT conv_id, turn, a, a_tokens, unnest(golds) AS g, generate_subscripts(golds, 1) AS place FROM once),
    gn AS (SELECT *, {_normal("g")} AS w FROM gl),
    gt AS (SELECT *, {_tokens("w")} AS wt FROM gn),
    lap AS (SELECT *, {_overlap("a_tokens", "wt")} AS n FROM gt),
    gp AS (
      SELECT *, CASE WHEN len(wt) > 0 AND len(a_tokens) > 0 THEN n / len(a_tokens) ELSE 0 END AS gp, CASE WHEN len(wt) > 0 AND len(a_tokens) > 0 THEN n / len(wt) ELSE 0 END AS gr FROM lap
    ),
    gf AS (SELECT *, CAST({_f1("gp", "gr")} AS DOUBLE) AS gf1 FROM gp),
    gs AS (
      SELECT *, CASE WHEN w = '' THEN 0 WHEN w = a THEN 1 ELSE greatest(gf1, CASE WHEN contains(a, w) THEN 0.95 ELSE 0 END, CASE WHEN contains(w, a) THEN 0.9 ELSE 0 END) END AS score FROM gf
    ),
    gb AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, place) AS k FROM gs WHERE score > 0 AND a <> ''),
    matched AS (
      SELECT o.*, coalesce(gb.w = gb.a, FALSE) AS exact, coalesce(contains(gb.a, gb.w), FALSE) AS contains_gold, coalesce(contains(gb.w, gb.a), FALSE) AS gold_contains,
             coalesce(gb.gf1, 0) AS best_f1, {{gone}} AS abstained, {{asks}} AS asks,
             CASE WHEN toxic = 1 THEN 'abstain' WHEN quality = 0 THEN 'clarify' ELSE 'answer' END AS expected,
             CASE WHEN toxic = 1 THEN 'abstain' WHEN quality = 0 THEN 'clarify' WHEN lang = 'en' THEN 'retrieve' ELSE 'direct' END AS wanted,
             len(list_distinct(q_tokens)) AS n_gold, len(list_intersect(list_distinct(q_tokens), list_distinct(o.a_tokens))) AS n_met,
             len(o.a_tokens) >= 3 AS valid, quality IS NULL AND o.turn > 5 AS run_error
      FROM once o LEFT JOIN gb ON gb.conv_id = o.conv_id AND gb.turn = o.turn AND gb.k = 1
    ),
    runs AS (
      SELECT *, n_met > 0 AS hit, n_gold > 0 AND n_met = n_gold AS full_recall, exact OR contains_gold OR gold_contains OR best_f1 >= 0.7 AS right_,
             CASE WHEN length(question) < 150 THEN used IN ('direct', 'retrieve') ELSE used = wanted END AS fine,
             wanted <> 'retrieve' AND used = 'retrieve' AS over_, wanted = 'retrieve' AND used <> 'retrieve' AS under_ FROM matched
    )
"""


def _runs(kind: str) -> str:
    """The runs as one kind of evaluation reads them."""
    asks = L.CLARIFICATION["claims" if kind == "claims" else "adaptive"]
    return _RUNS_OF.replace("{gone}", _any("o.a", markers(L.ABSTENTION[kind]))).replace("{asks}", _any("o.a", markers(asks)))


def _picked(answer: str) -> str:
    return f"CASE expected WHEN 'abstain' THEN abstained WHEN 'clarify' THEN clarified ELSE {answer} END"


_OUTCOME = f"""{_picked("NOT abstained AND NOT clarified")} AS behaviour_correct, {_picked("right_")} AS answer_correct,
      {_picked("NOT abstained AND NOT clarified AND right_")} AS final_correct"""
_BEHAVED = """WHEN expected = 'answer' AND abstained THEN 'wrong_abstention' WHEN expected = 'answer' AND clarified THEN 'wrong_clarification'
      WHEN expected = 'abstain' AND NOT abstained THEN 'missing_abstention' WHEN expected = 'clarify' AND NOT clarified THEN 'missing_clarification'"""

_ADAPTIVE = f"""
    behaved AS (SELECT *, asks OR used = 'clarify' AS clarified FROM runs),
    outcomes AS (SELECT *, {_OUTCOME} FROM behaved),
    adaptive AS (
      SELECT conv_id, turn, expected, wanted, used, fine, abstained, clarified, exact, contains_gold, gold_contains, round(best_f1, 6) AS f1, behaviour_correct, answer_correct,
        final_correct, over_ AS over, under_ AS under, CASE WHEN run_error THEN 'run_error' WHEN NOT valid THEN 'format_error' WHEN final_correct THEN 'correct' {_BEHAVED}
        WHEN under_ THEN 'under_retrieval_route_error' WHEN over_ AND NOT fine THEN 'over_retrieval_route_error'
        WHEN expected = 'answer' AND used = 'retrieve' AND n_gold > 0 AND NOT hit THEN 'retrieval_miss'
        WHEN expected = 'answer' AND used = 'retrieve' AND n_gold > 0 AND NOT full_recall THEN 'partial_retrieval_or_generation_error'
        WHEN expected = 'answer' THEN 'answer_mismatch' ELSE 'behavior_error' END AS error_type FROM outcomes
    )
"""
_RATES = ("behaviour_correct", "answer_correct", "final_correct", "abstained", "clarified", "exact", "contains_gold", "gold_contains", "fine", "over", "under")
_SUMMED = f"count(*) AS n, round(avg(f1), 4) AS mean_f1, {', '.join(f'round(avg(CAST({c} AS INTEGER)), 6) AS {c}_rate' for c in _RATES)} FROM adaptive"

_EVIDENCE = f"""
    ecl AS (SELECT conv_id, turn, pos, claim_type, CASE WHEN pos = 0 THEN 'core' ELSE 'supporting' END AS importance, {_normal("claim")} AS c FROM claims),
    ecn AS (SELECT *, {_tokens("c")} AS ct FROM ecl),
    epc AS (SELECT conv_id, turn AS piece, {_normal("text")} AS e FROM conversations WHERE role = 'user' AND trim(text) <> ''),
    ept AS (SELECT *, {_tokens("e")} AS et, {_negated("e")} AS en FROM epc),
    emt AS (SELECT ecn.*, piece, e, et, en FROM ecn LEFT JOIN ept ON ept.conv_id = ecn.conv_id),
    elp AS (SELECT *, {_overlap("ct", "et")} AS n, c <> '' AND contains(e, c) AS inside FROM emt),
    epr AS (
      SELECT *, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN n / len(ct) ELSE 0 END AS p0, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN n / len(et) ELSE 0 END AS r0 FROM elp
    ),
    elf AS (
      SELECT *, CAST(CASE WHEN inside THEN greatest({_f1("p0", "r0")}, 0.98) ELSE {_f1("p0", "r0")} END AS DOUBLE) AS f1,
             CASE WHEN inside THEN greatest(p0, 0.98) ELSE p0 END AS p, CASE WHEN inside THEN greatest(r0, 0.98) ELSE r0 END AS r FROM epr
    ),
    ebest AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY f1 DESC, piece) AS k,
             coalesce(bool_or(en) OVER (PARTITION BY conv_id, turn, pos), FALSE) AS any_negated, count(e) OVER (PARTITION BY conv_id, turn, pos) AS n_pieces FROM elf
    ),
    eruled AS (
      SELECT *, CASE WHEN c = '' THEN 1 WHEN claim_type <> 'factual' THEN 2 WHEN n_pieces = 0 THEN 3 WHEN f1 >= 0.6 AND {_negated("c")} <> any_negated THEN 4
        WHEN f1 >= 0.45 OR (p >= 0.55 AND r >= 0.25) THEN 5 ELSE 6 END AS rule FROM ebest WHERE k = 1
    ),
    evidence AS (
      SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, claim_type, importance,
             CASE rule WHEN 2 THEN 'supported' WHEN 4 THEN 'refuted' WHEN 5 THEN 'supported' ELSE 'not_enough_info' END AS verdict,
             round(CAST(CASE rule WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 WHEN 4 THEN least(0.85, greatest(0.55, f1)) WHEN 5 THEN least(0.92, greatest(0.55, f1)) ELSE 0.72 END AS DOUBLE), 6) AS confidence,
             CASE WHEN claim_type = 'factual' AND rule IN (4, 5) AND f1 > 0 THEN piece END AS evidence FROM eruled
    ),
    csums AS (
      SELECT conv_id, turn, count(*) AS n_claims, count(*) FILTER (verdict = 'supported') AS n_supported, count(*) FILTER (verdict = 'refuted') AS n_refuted,
        count(*) FILTER (verdict = 'not_enough_info') AS n_open, count(*) FILTER (claim_type = 'abstention') AS n_abstention,
        count(*) FILTER (claim_type = 'clarification') AS n_clarification, count(*) FILTER (claim_type = 'factual') AS n_requiring,
        bool_or(importance = 'core' AND verdict = 'refuted') AS core_refuted, bool_or(importance = 'core' AND verdict = 'not_enough_info') AS core_open,
        bool_and(importance <> 'core' OR verdict = 'supported') AS core_supported, bool_and(importance <> 'core' OR claim_type = 'clarification') AS core_clarification,
        bool_and(importance <> 'core' OR claim_type = 'abstention') AS core_abstention,
        coalesce(array_to_string(list_sort(list_distinct(list(evidence) FILTER (evidence IS NOT NULL))), '|'), '') AS evidence FROM evidence GROUP BY ALL
    )
"""



def _ruled(f1: str, p: str, r: str, negated: str, n: str) -> str:
    """The number of the rule that gives a claim's verdict."""
    return f"""CASE WHEN c = '' THEN 1 WHEN claim_type <> 'factual' THEN 2 WHEN {n} = 0 THEN 3 WHEN {f1} >= 0.6 AND {_negated("c")} <> {negated} THEN 4
      WHEN {f1} >= 0.45 OR ({p} >= 0.55 AND {r} >= 0.25) THEN 5 ELSE 6 END"""


def _judged(rule: str, f1: str) -> str:
    return f"""CASE {rule} WHEN 2 THEN 'supported' WHEN 4 THEN 'refuted' WHEN 5 THEN 'supported' ELSE 'not_enough_info' END AS verdict,
      round(CAST(CASE {rule} WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 WHEN 4 THEN least(0.85, greatest(0.55, {f1})) WHEN 5 THEN least(0.92, greatest(0.55, {f1})) ELSE 0.72 END AS DOUBLE), 6) AS confidence"""


# with two rounds a claim searches once at most, so the recursion goes from one searching claim of an answer to the next
_LOOP = f"""
    lstart AS (SELECT conv_id, turn, pos, piece, f1, p, r, en FROM elf WHERE piece = turn - 1 AND e <> ''),
    lfirst AS (
      SELECT k.conv_id, k.turn, k.pos, claim_type, c, s.piece AS start, s.f1, s.p, s.r, s.en, {_ruled("s.f1", "s.p", "s.r", "s.en", "CASE WHEN s.piece IS NULL THEN 0 ELSE 1 END")} AS rule
      FROM ecn k LEFT JOIN lstart s ON s.conv_id = k.conv_id AND s.turn = k.turn AND s.pos = k.pos
    ),
    lwant AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM lfirst WHERE rule IN (3, 6)),
    llist AS (
      SELECT w.conv_id, w.turn, w.pos, list({{'piece': e.piece, 'f1': e.f1, 'p': e.p, 'r': e.r, 'en': e.en}} ORDER BY e.f1 DESC, e.piece) AS list
      FROM lwant w JOIN elf e ON e.conv_id = w.conv_id AND e.turn = w.turn AND e.pos = w.pos WHERE w.n <= {LOOP.SEARCHES} AND e.f1 >= {LOOP.LEAST} GROUP BY ALL
    ),
    lsteps AS (SELECT w.*, list FROM lwant w LEFT JOIN llist l ON l.conv_id = w.conv_id AND l.turn = w.turn AND l.pos = w.pos WHERE n <= {LOOP.SEARCHES}),
    lfold AS (
      SELECT conv_id, turn, CAST(0 AS BIGINT) AS n, CASE WHEN any_value(start) IS NULL THEN [] ELSE [any_value(start)] END AS seen, NULL::BIGINT AS pos,
             [{{'piece': 0::BIGINT, 'f1': 0::DOUBLE, 'p': 0::DOUBLE, 'r': 0::DOUBLE, 'en': FALSE}}][1:0] AS found FROM lsteps GROUP BY conv_id, turn
      UNION ALL
      SELECT conv_id, turn, n, CASE WHEN start IS NULL THEN seen ELSE list_concat(seen, list_transform(found, lambda x: x.piece)) END, pos, found FROM (
        SELECT s.conv_id, s.turn, s.n, s.pos, s.start, f.seen,
               coalesce(list_filter(s.list, lambda x: s.start IS NULL OR NOT list_contains(f.seen, x.piece)), [])[1:{LOOP.PER_ROUND}] AS found
        FROM lfold f JOIN lsteps s ON s.conv_id = f.conv_id AND s.turn = f.turn AND s.n = f.n + 1
      )
    ),
    lall AS (
      SELECT conv_id, turn, pos, piece, f1, p, r, en FROM lstart
      UNION ALL SELECT conv_id, turn, pos, x.piece, x.f1, x.p, x.r, x.en FROM (SELECT conv_id, turn, pos, unnest(found) AS x FROM lfold WHERE n > 0)
    ),
    lbest AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY f1 DESC, piece) AS k, bool_or(en) OVER (PARTITION BY conv_id, turn, pos) AS any_en FROM lall),
    lend AS (
      SELECT i.conv_id, i.turn, i.pos, i.start, w.n, f.n IS NOT NULL AS searched, list_transform(f.found, lambda x: x.piece) AS got,
             {_ruled("b.f1", "b.p", "b.r", "b.any_en", "CASE WHEN b.piece IS NULL THEN 0 ELSE 1 END")} AS rule, b.f1
      FROM lfirst i LEFT JOIN (SELECT conv_id, turn, pos, n FROM lwant) w ON w.conv_id = i.conv_id AND w.turn = i.turn AND w.pos = i.pos
      LEFT JOIN lfold f ON f.conv_id = i.conv_id AND f.turn = i.turn AND f.pos = i.pos
      LEFT JOIN lbest b ON b.conv_id = i.conv_id AND b.turn = i.turn AND b.pos = i.pos AND b.k = 1
    )
"""

_NEEDS = "rule IN ('documental_cue', 'number_or_date', 'factual_relation_cue', 'comparison_cue', 'named_entity', 'question_multi_entity')"


def _said(c: str) -> str:
    bare = rf"trim(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[-*•]\\s*', ''))"
    bare = f"trim(trim(trim({bare}, {_q(chr(34))}), {_q(chr(39))}))"
    return f"CASE WHEN length({bare}) > 700 THEN rtrim(({bare})[1:700]) || ' [...]' ELSE {bare} END"


_TASK = """CASE (SELECT any_value(z.route) FROM routed z WHERE z.conv_id = parts.conv_id AND z.turn = parts.turn - 1)
               WHEN 'retrieve' THEN 'open_retrieval' WHEN 'direct' THEN 'open_direct' ELSE 'open_qa' END AS task"""
_WRITING = (
    _POLICY.replace(_sentences("answer"), f"list_transform({_sentences('answer')}, lambda s: {_said('s')})")
    .replace("CASE conv_id % 5 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'open_direct' ELSE 'open_qa' END AS task", _TASK)
    .replace("CASE turn % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' ELSE 'aggressive' END AS bias", "'balanced' AS bias")
)
_F1_OF = lambda n, a, b: f"CASE WHEN {n} > 0 THEN 2.0 * {n} / (len({a}) + len({b})) ELSE 0 END"
_ENDED = lambda partial, s: f"CASE WHEN {partial} = '' THEN {s} WHEN right({partial}, 1) IN ('.', '!', '?') THEN {partial} || ' ' || {s} ELSE {partial} || '. ' || {s} END"
_MARKED = lambda c, marks: _any(_low(c), marks)

# one sentence after the other: the recursion carries the text, the searches spent and the pieces seen
_ACTIVE = f"""
    apc AS (SELECT conv_id, turn AS piece, {_normal("text")} AS e FROM conversations WHERE role = 'user' AND trim(text) <> ''),
    apt AS (SELECT *, {_tokens("e")} AS et, {_negated("e")} AS en FROM apc),
    asaid AS (SELECT conv_id, turn, pos + 1 AS step, said, rule, task, {_NEEDS} AS needed, {_normal("coalesce(question, '') || ' ' || said")} AS w, {_normal("said")} AS c FROM decided WHERE pos < {ACTIVE.STEPS}),
    atok AS (SELECT *, {_tokens("w")} AS wt, {_tokens("c")} AS ct FROM asaid),
    amet AS (SELECT k.*, piece, e, et, en, {_overlap("wt", "et")} AS nw, {_overlap("ct", "et")} AS nc FROM atok k JOIN apt ON apt.conv_id = k.conv_id WHERE needed),
    ascored AS (
      SELECT conv_id, turn, step, piece, en, CASE WHEN w <> '' AND contains(e, w) THEN 0.98 ELSE {_F1_OF("nw", "wt", "et")} END AS fw, c <> '' AND contains(e, c) AS inside,
             {_F1_OF("nc", "ct", "et")} AS f0, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN nc / len(ct) ELSE 0 END AS p0, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN nc / len(et) ELSE 0 END AS r0 FROM amet
    ),
    alist AS (
      SELECT conv_id, turn, step, list({{'piece': piece, 'f1': CAST(CASE WHEN inside THEN greatest(f0, 0.98) ELSE f0 END AS DOUBLE), 'p': CAST(CASE WHEN inside THEN greatest(p0, 0.98) ELSE p0 END AS DOUBLE),
             'r': CAST(CASE WHEN inside THEN greatest(r0, 0.98) ELSE r0 END AS DOUBLE), 'en': en}} ORDER BY fw DESC, piece) AS list FROM ascored WHERE fw >= {ACTIVE.LEAST} GROUP BY ALL
    ),
    asteps AS (SELECT k.*, list FROM atok k LEFT JOIN alist l ON l.conv_id = k.conv_id AND l.turn = k.turn AND l.step = k.step),
    awrite AS (
      SELECT conv_id, turn, CAST(0 AS BIGINT) AS step, '' AS rule, FALSE AS needed, FALSE AS searched, '' AS skipped, []::BIGINT[] AS retrieved, '' AS status, FALSE AS abstains,
             CAST(0 AS DOUBLE) AS confidence, '' AS partial, '' AS stop, CAST(0 AS BIGINT) AS spent, []::BIGINT[] AS seen FROM pairs
      UNION ALL
      SELECT conv_id, turn, step, rule, needed, searched, skipped, retrieved, status, abstains, confidence, {_ENDED("partial", "sentence")} AS partial,
             CASE WHEN task = 'open_retrieval' AND searched AND len(retrieved) > 0 AND status = 'supported' AND confidence >= {ACTIVE.SETTLED} AND NOT {_MARKED("sentence", L.CLARIFICATION_MARKERS)} THEN 'settled'
               WHEN step >= {ACTIVE.STEPS} THEN 'max_steps' WHEN abstains THEN 'abstained' WHEN {_MARKED("sentence", L.CLARIFICATION_MARKERS)} THEN 'clarification' ELSE '' END AS stop,
             spent + CAST(searched AS BIGINT) AS spent, list_concat(seen, retrieved) AS seen
      FROM (
        SELECT *, CASE WHEN NOT searched OR status = 'supported' THEN said ELSE '{ACTIVE.NOTHING_FOUND}' END AS sentence,
               CASE WHEN searched THEN status <> 'supported' ELSE {_MARKED("said", L.ABSTENTION_MARKERS)} END AS abstains
        FROM (
          SELECT *, CASE WHEN NOT searched THEN 'not_checked' WHEN rule_no = 4 THEN 'refuted' WHEN rule_no = 5 THEN 'supported' ELSE 'not_enough_info' END AS status,
                 CAST(CASE WHEN NOT searched THEN least(length(said) / 100.0, 1) WHEN rule_no = 1 THEN 1 WHEN rule_no = 3 THEN 0.9 WHEN rule_no = 4 THEN least(0.85, greatest(0.55, best.f1))
                   WHEN rule_no = 5 THEN least(0.92, greatest(0.55, best.f1)) ELSE 0.72 END AS DOUBLE) AS confidence
          FROM (
            SELECT *, {_ruled("best.f1", "best.p", "best.r", "(len(list_filter(found, lambda x: x.en)) > 0)", "len(found)")} AS rule_no FROM (
              SELECT *, 'factual' AS claim_type, list_transform(found, lambda x: x.piece) AS retrieved,
                     list_sort(list_transform(found, lambda x: {{'f1': x.f1, 'at': -x.piece, 'p': x.p, 'r': x.r}}), 'DESC')[1] AS best
              FROM (
                SELECT *, CASE WHEN searched THEN coalesce(list_filter(list, lambda x: NOT list_contains(seen, x.piece)), [])[1:CAST(least({ACTIVE.PER_STEP}, {ACTIVE.MOST_PIECES} - len(seen)) AS BIGINT)] ELSE [] END AS found FROM (
                  SELECT *, needed AND skipped = '' AS searched FROM (
                    SELECT s.conv_id, s.turn, s.step, s.said, s.rule, s.task, s.needed, s.c, s.list, w.partial, w.spent, w.seen,
                           CASE WHEN s.needed AND w.spent >= {ACTIVE.SEARCHES} THEN 'max_retrieval_steps_reached' WHEN s.needed AND len(w.seen) >= {ACTIVE.MOST_PIECES} THEN 'max_total_chunks_reached' ELSE '' END AS skipped
                    FROM awrite w JOIN asteps s ON s.conv_id = w.conv_id AND s.turn = w.turn AND s.step = w.step + 1 WHERE w.stop = '' AND s.said <> ''
                  )
                )
              )
            )
          )
        )
      )
    )
"""

_CLAIMED = f"""
    cjoined AS (SELECT r.*, asks AS clarified, coalesce(n_claims, 0) AS nc, coalesce(n_supported, 0) AS ns, coalesce(n_refuted, 0) AS nr, coalesce(n_open, 0) AS no_
                FROM runs r LEFT JOIN csums s ON s.conv_id = r.conv_id AND s.turn = r.turn),
    coutcomes AS (SELECT *, {_OUTCOME} FROM cjoined),
    claimed AS (
      SELECT conv_id, turn, expected, behaviour_correct, final_correct, round(CASE WHEN nc > 0 THEN ns / nc ELSE 0 END, 4) AS support_rate,
        round(CASE WHEN nc > 0 THEN nr / nc ELSE 0 END, 4) AS refuted_rate, round(CASE WHEN nc > 0 THEN no_ / nc ELSE 0 END, 4) AS open_rate, nc > 0 AND ns = nc AS all_supported,
        CASE WHEN trim(coalesce(answer, '')) <> '' AND source_answer <> '' THEN a <> {_normal("source_answer")} ELSE FALSE END AS changed_answer,
        abstained <> {_any(_normal("source_answer"), markers(L.ABSTENTION["claims"]))} AS changed_behaviour,
        CASE WHEN run_error THEN 'run_error' WHEN NOT valid THEN 'format_error' WHEN final_correct THEN 'correct' {_BEHAVED} WHEN nr > 0 THEN 'claim_refuted' WHEN no_ > 0 THEN 'claim_nei'
          WHEN expected = 'answer' THEN 'answer_mismatch' ELSE 'behavior_error' END AS error_type FROM coutcomes
    )
"""

_EVEN = _POLICY.replace("CASE conv_id % 5 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'open_direct' ELSE 'open_qa' END AS task", "'open_qa' AS task").replace(
    "CASE turn % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' ELSE 'aggressive' END AS bias", "'balanced' AS bias"
)
_STEPS = f"steps AS (SELECT conv_id, turn, pos, rule, {_NEEDS} AS needs, {_SURENESS} FROM decided)".replace("AS confidence,", "AS confidence")

_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_TITLE = r"regexp_extract({}, '^(\S+)', 1)"
_NESTED = f"""
    ex AS (SELECT 'q' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, coalesce(source, '') AS question, coalesce(lang, '') AS answer, {_LINES} AS lines FROM documents),
    sup AS (SELECT *, list_transform(list_filter(lines, lambda x: length(x) > 400), lambda x: {_normal(_TITLE.format("x"))}) AS titles FROM ex),
    un AS (SELECT id, titles, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS place FROM sup),
    ch AS (
      SELECT id AS question_id, id || '_chunk_' || printf('%02d', place) AS chunk_id, CAST(place AS INTEGER) AS place, {_TITLE.format("line")} AS title, line,
             list_contains(titles, {_normal(_TITLE.format("line"))}) AS is_gold FROM un
    )
"""

EVALUATION_SQL = {
    "adaptive_evaluation": f"WITH {_PAIRS}, {_ROUTES}, {_runs("adaptive")}, {_ADAPTIVE} SELECT * FROM adaptive",
    "adaptive_summary": f"""WITH {_PAIRS}, {_ROUTES}, {_runs("adaptive")}, {_ADAPTIVE}
      SELECT 'overall' AS group_type, '' AS expected, '' AS used, '' AS error_type, {_SUMMED}
      UNION ALL SELECT 'expected', expected, '', '', {_SUMMED} GROUP BY expected UNION ALL SELECT 'used', '', used, '', {_SUMMED} GROUP BY used
      UNION ALL SELECT 'error_type', '', '', error_type, {_SUMMED} GROUP BY error_type""",
    "active_evaluation": f"""WITH {_PAIRS}, {_ROUTES}, {_runs("active")}, acted AS (SELECT *, asks AS clarified, used = 'retrieve' AS active FROM runs), ended AS (SELECT *, {_OUTCOME} FROM acted)
      SELECT conv_id, turn, expected, CASE WHEN clarified THEN 'clarify' WHEN abstained THEN 'abstain' WHEN active THEN 'retrieve' ELSE 'direct' END AS action,
        CASE wanted WHEN 'retrieve' THEN active WHEN 'direct' THEN NOT active WHEN 'abstain' THEN abstained ELSE clarified END AS decision_correct, behaviour_correct, final_correct,
        CASE WHEN run_error THEN 'run_error' WHEN NOT valid THEN 'format_error' WHEN final_correct THEN 'correct' {_BEHAVED} WHEN under_ THEN 'under_retrieval' WHEN over_ THEN 'over_retrieval'
          WHEN expected = 'answer' AND active AND n_gold > 0 AND NOT hit THEN 'retrieval_miss'
          WHEN expected = 'answer' AND active AND n_gold > 0 AND NOT full_recall THEN 'partial_retrieval_or_generation_error'
          WHEN expected = 'answer' THEN 'answer_mismatch' ELSE 'behavior_error' END AS error_type FROM ended""",
    "claim_evidence": f"WITH {_PAIRS}, {_CLAIMS}, {_EVIDENCE} SELECT * FROM evidence",
    "claim_summary": f"WITH {_PAIRS}, {_CLAIMS}, {_EVIDENCE} SELECT * FROM csums",
    "answer_repairs": f"""WITH {_PAIRS}, {_CLAIMS}, {_EVIDENCE},
      j AS (SELECT p.conv_id, p.turn, coalesce(n_claims, 0) AS n_claims, coalesce(n_supported, 0) AS n_supported, coalesce(n_refuted, 0) AS n_refuted, coalesce(n_open, 0) AS n_open,
              core_refuted, core_open, core_supported, core_clarification, core_abstention
            FROM pairs p LEFT JOIN csums s ON s.conv_id = p.conv_id AND s.turn = p.turn),
      k AS (SELECT *, CASE WHEN n_claims = 0 THEN 1 WHEN core_clarification THEN 2 WHEN core_abstention THEN 3 WHEN core_refuted THEN 4 WHEN core_open THEN 5 WHEN core_supported THEN 6 ELSE 7 END AS rule FROM j)
      SELECT conv_id, turn, n_claims, n_supported, n_refuted, (['no_claims', 'clarification_kept', 'abstained', 'abstained', 'abstained', 'unchanged', 'unchanged'])[rule] AS decision,
        rule <= 5 AS abstained, rule IN (4, 5) AS corrected, CAST(([0.7, 0.95, 0.95, 0.85, 0.8, 0.9, 0.65])[rule] AS DOUBLE) AS confidence,
        CASE rule WHEN 4 THEN n_refuted WHEN 5 THEN n_open ELSE 0 END AS n_removed FROM k""",
    "claim_loop": f"""WITH RECURSIVE {_PAIRS}, {_CLAIMS}, {_EVIDENCE}, {_LOOP}
      SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, {_judged("rule", "f1")}, CAST(CASE WHEN searched THEN 2 ELSE 1 END AS BIGINT) AS rounds,
        coalesce(array_to_string(got, '|'), '') AS retrieved, array_to_string(list_concat(CASE WHEN start IS NULL THEN [] ELSE [start] END, coalesce(got, [])), '|') AS evidence,
        CASE WHEN n > {LOOP.SEARCHES} THEN 'max_total_retrievals_reached' ELSE '' END AS blocked,
        count(*) FILTER (searched) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS counter FROM lend""",
    # the payloads are made of the claims, so what reading them must give follows from the claims
    "claim_objects": f"""WITH {_PAIRS}, {_CLAIMS},
      g AS (SELECT p.conv_id, p.turn, trim(coalesce(p.answer, '')) AS said, cs, len(cs) AS n, range(0, len(cs)) AS ns FROM pairs p JOIN pieces i ON i.conv_id = p.conv_id AND i.turn = p.turn),
      r AS (SELECT *, flatten(list_transform(ns, lambda i: ['r' || (i % 2), 'r' || (i % 5)])) AS got, list_transform(ns, lambda i: 's' || (i % 3)) AS sup FROM g)
      SELECT conv_id, turn, md5(said) AS answer_md5, CAST(CASE WHEN conv_id % 5 < 3 THEN 0.82 ELSE 0.5 END AS DOUBLE) AS confidence, FALSE AS abstained,
        CASE WHEN conv_id % 5 < 3 THEN 'clarification_kept' ELSE 'unchanged' END AS final_decision, n AS num_claims, len(list_filter(ns, lambda i: i % 4 = 0)) AS num_supported_claims,
        len(list_filter(ns, lambda i: i % 4 = 1)) AS num_refuted_claims, len(list_filter(ns, lambda i: i % 4 = 2)) AS num_nei_claims,
        len(list_filter(cs, lambda c: c.k = 'factual')) AS num_claims_requiring_evidence, CAST(coalesce(list_sum(list_transform(ns, lambda i: i % 2 + 1)), 0) AS BIGINT) AS num_verification_rounds,
        array_to_string(list_transform(list_filter(ns, lambda i: i % 4 = 0), lambda i: 'c' || (i + 1)), '|') AS supported_ids,
        array_to_string(list_transform(list_filter(ns, lambda i: i % 4 = 2), lambda i: 'c' || (i + 1)), '|') AS open_ids,
        array_to_string({_ONCE("sup")}, '|') AS supporting_chunk_ids, array_to_string({_ONCE("got")}, '|') AS retrieved_chunk_ids, len(list_distinct(got)) AS num_chunks_retrieved_total,
        said <> '' AS valid, CASE WHEN conv_id % 5 < 3 THEN 'raw_output_json' WHEN conv_id % 5 = 3 THEN 'columns_after_parse_error' ELSE 'columns' END AS method,
        concat_ws('; ', CASE WHEN conv_id % 5 = 3 THEN CASE WHEN n > 0 THEN 'invalid JSON' ELSE 'no JSON object' END END, CASE WHEN said = '' THEN 'no answer' END) AS parse_error FROM r""",
    "claim_payloads": f"""WITH {_PAIRS}, {_CLAIMS},
      g AS (SELECT p.conv_id, p.turn, trim(coalesce(p.answer, '')) AS said, cs, {_sentences("p.question")} AS qs FROM pairs p JOIN pieces i ON i.conv_id = p.conv_id AND i.turn = p.turn),
      k AS (SELECT *, list_transform(cs, lambda c: lower(c.t)) AS low FROM g),
      o AS (SELECT *, list_filter(cs, lambda c, i: list_position(low, lower(c.t)) = i)[1:5] AS kept FROM k),
      w AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept WHEN said = '' THEN [] ELSE [{{'t': {_stated("said")}, 'k': CASE WHEN {_any(_low("said"), L.CLARIFICATION["extraction"])} THEN 'clarification'
              WHEN {_any(_low("said"), L.ABSTENTION["extraction"])} THEN 'abstention' ELSE 'factual' END}}] END AS xs,
              list_transform(qs, lambda s, i: CASE WHEN i % 2 = 0 THEN 'q' || (i - 1) ELSE 'chunk_inline_' || i END) AS ids FROM o)
      SELECT conv_id, turn, len(xs) AS n_claims, md5(array_to_string(list_transform(xs, lambda c, i: 'c' || i || ':' || c.k || ':' || lower(c.t)), chr(10))) AS claims_md5,
        len(list_filter(xs, lambda c: c.k = 'factual')) > 0 AS needs_verification, array_to_string(ids, '|') AS chunk_ids,
        (['supported', 'refuted', 'not_enough_info', 'not_enough_info'])[conv_id % 4 + 1] AS verdict, CAST(0.9 AS DOUBLE) AS confidence,
        CASE WHEN list_contains(ids, 'q1') THEN 'q1' WHEN conv_id % 4 = 0 THEN coalesce(ids[1], '') ELSE '' END AS supporting, CASE WHEN conv_id % 4 = 1 THEN coalesce(ids[1], '') ELSE '' END AS refuting,
        conv_id % 4 >= 2 AS needs_more, CASE WHEN conv_id % 4 >= 2 THEN 'more' END AS next_search FROM w""",
    "active_steps": f"""WITH RECURSIVE {_PAIRS}, {_ROUTES}, {_WRITING}, {_ACTIVE}
      SELECT conv_id, turn, step, rule, needed, searched, skipped, array_to_string(retrieved, '|') AS retrieved, status, abstains, round(confidence, 6) AS confidence, md5(partial) AS partial_md5, stop
      FROM awrite WHERE step > 0""",
    "active_answers": f"""WITH RECURSIVE {_PAIRS}, {_ROUTES}, {_WRITING}, {_ACTIVE},
      ends AS (
        SELECT conv_id, turn, arg_max(partial, step) AS said, round(avg(confidence) FILTER (step > 0), 4) AS confidence, coalesce(bool_or(step > 0 AND (abstains OR status IN ('not_enough_info', 'refuted'))), FALSE) AS open_,
               count(*) FILTER (step > 0) AS n_steps, count(*) FILTER (searched) AS n_searches, flatten(list(retrieved ORDER BY step)) AS evidence, arg_max(stop, step) AS stop FROM awrite GROUP BY ALL
      )
      SELECT conv_id, turn, md5(CASE WHEN said = '' THEN '{ACTIVE.NOTHING_FOUND}' ELSE said END) AS answer_md5, coalesce(confidence, 0) AS confidence,
        said = '' OR open_ OR {_MARKED("said", [*L.ABSTENTION_MARKERS, *L.CLARIFICATION_MARKERS])} AS abstained, n_steps, n_searches, array_to_string(evidence, '|') AS evidence,
        CASE WHEN stop = '' THEN 'finished' ELSE stop END AS stop FROM ends""",
    "claims_evaluation": f"WITH {_PAIRS}, {_ROUTES}, {_runs("claims")}, {_CLAIMS}, {_EVIDENCE}, {_CLAIMED} SELECT * FROM claimed",
    "choice_answers": r"""WITH g AS (SELECT *, substring('ABCD', CAST(length(text) % 4 + 1 AS BIGINT), 1) AS gold FROM conversations),
      r AS (SELECT *, trim(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'The answer is ' || lower(gold) || '.' WHEN 2 THEN gold || ' ) ' ELSE text || chr(10) || 'opción ' || gold END) AS raw FROM g),
      l AS (SELECT *, upper(coalesce(nullif(regexp_extract(raw, '(?i)^\s*([ABCD])\s*[\.)]?\s*$', 1), ''),
        nullif(regexp_extract(raw, '(?i)(?:respuesta|answer|opci[oó]n|option)\s*(?:es|is|:)?\s*([ABCD])\b', 1), ''), regexp_extract(raw, '(?i)\b([ABCD])\b', 1))) AS letter FROM r)
      SELECT conv_id, turn, letter, gold, letter = gold AS correct, letter <> '' AS valid FROM l""",
    "trace_fields": f"""WITH {_PAIRS}, {_EVEN}, {_STEPS},
      s AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (needs) AS nr, count(*) FILTER (rule = 'abstention_sentence') AS na, list(rule ORDER BY pos) AS rs, avg(confidence) AS mc FROM steps GROUP BY ALL)
      SELECT p.conv_id, p.turn, coalesce(n, 0) AS n_steps, coalesce(nr, 0) AS n_retrievals, coalesce(s.na, 0) AS n_abstentions,
             coalesce(array_to_string({_ONCE("rs")}, '|'), '') AS rules, round(mc, 6) AS mean_confidence FROM pairs p LEFT JOIN s ON s.conv_id = p.conv_id AND s.turn = p.turn""",
    "retrieval_loop": f"""WITH {_PAIRS}, {_EVEN}, {_STEPS},
      ends AS (SELECT conv_id, turn, count(*) AS n, min(pos + 1) FILTER (rule = 'abstention_sentence') AS first_abstention FROM steps GROUP BY ALL),
      taken AS (SELECT *, least(n, coalesce(first_abstention, n)) AS k FROM ends),
      asked_for AS (SELECT t.conv_id, t.turn, k, first_abstention, count(*) FILTER (needs AND pos < k) AS wants FROM taken t JOIN steps s ON s.conv_id = t.conv_id AND s.turn = t.turn GROUP BY ALL)
      SELECT p.conv_id, p.turn, CAST(coalesce(k, 0) AS INTEGER) AS steps, CAST(coalesce(least(wants, {V.MAX_RETRIEVALS}), 0) AS INTEGER) AS retrievals,
             CAST(coalesce(greatest(wants - {V.MAX_RETRIEVALS}, 0), 0) AS INTEGER) AS denied,
             CASE WHEN k = first_abstention THEN 'abstained' ELSE 'finished' END AS stop
      FROM pairs p LEFT JOIN asked_for f ON f.conv_id = p.conv_id AND f.turn = p.turn""",
    "router_payloads": f"""WITH {_ROUTES}, n AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND turn % 5 = 0 THEN '' ELSE route END AS route, retrieval_mode AS mode, trunc(confidence * 100) / 100 AS c FROM routed)
      SELECT conv_id, turn, route, mode, round(c, 6) AS confidence, route <> '' AND (CASE WHEN route = 'retrieve' THEN mode IN ('single_step', 'multi_step') ELSE mode = 'none' END) AS valid FROM n""",
    "nested_chunks": f"""WITH {_NESTED} SELECT question_id, chunk_id, place, is_gold, md5('Title: ' || title || chr(10) || 'Text: ' || line) AS embedded_md5 FROM ch""",
    "nested_qrels": f"WITH {_NESTED} SELECT question_id, chunk_id, 1 AS relevance FROM ch WHERE is_gold",
    "nested_questions": f"""WITH {_NESTED}, s AS (SELECT question_id, count(*) AS nc, count(*) FILTER (is_gold) AS ng, string_agg(chunk_id, '|' ORDER BY place) FILTER (is_gold) AS ids FROM ch GROUP BY ALL)
      SELECT id, question, answer, coalesce(nc, 0) AS n_context, coalesce(ng, 0) AS n_gold, coalesce(ids, '') AS gold_ids FROM ex LEFT JOIN s ON question_id = id""",
    "no_answer_rows": f"""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), p AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS place FROM s)
      SELECT 'none_' || printf('%04d', place) AS id, replace(([{", ".join(map(_q, V.NO_ANSWER))}])[place % {len(V.NO_ANSWER)} + 1], '%s', source) AS question, 'abstain' AS expected_behavior FROM p""",
    "normalised_sources": r"""WITH q AS (
        SELECT c.conv_id, c.turn, trim(coalesce(nullif(regexp_extract(c.text, '(?is)Question:\s*(.*)', 1), ''), c.text, '')) AS question, trim(coalesce(a.text, '')) AS gold
        FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user'
      )
      SELECT 'mc_' || item_id AS id, 'multiple_choice' AS case_type, md5(trim(coalesce(text, ''))) AS question_md5, md5(substring('ABCD', CAST(item_id % 4 + 1 AS BIGINT), 1)) AS gold_md5 FROM benchmark
      UNION ALL SELECT 'open_' || conv_id || '_' || turn, 'open_qa', md5(question), md5(gold) FROM q""",
    "seeded_order": "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS place FROM documents",
    "task_profiles": f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split({_normal("trim(coalesce(text, ''))")}, ' '), lambda x: x <> '') AS ws, (conv_id + turn) % 5 AS kind FROM conversations WHERE role = 'user'),
      o AS (SELECT *, CASE kind WHEN 0 THEN list_filter([{{'l': 'A', 't': ws[1]}}, {{'l': 'B', 't': ws[2]}}, {{'l': 'C', 't': ws[3]}}, {{'l': 'D', 't': ws[4]}}], lambda x: coalesce(x.t, '') <> '')
          WHEN 1 THEN list_filter([{{'l': 'A', 't': ws[1]}}, {{'l': 'B', 't': ws[2]}}, {{'l': 'C', 't': ws[3]}}, {{'l': 'D', 't': ws[4]}}], lambda x: coalesce(x.t, '') <> '')
          WHEN 2 THEN list_filter([{{'l': 'A', 't': ws[1]}}, {{'l': 'C', 't': ws[3]}}], lambda x: coalesce(x.t, '') <> '') ELSE [] END AS os,
        CASE kind WHEN 0 THEN len(ws) >= 4 WHEN 1 THEN len(ws) >= 2 ELSE FALSE END AS fine FROM w),
      t AS (SELECT *, CASE WHEN fine THEN 'multiple_choice' WHEN conv_id % 4 = 0 OR turn % 4 = 0 THEN 'open_retrieval' WHEN conv_id % 4 = 1 THEN 'open_direct' WHEN turn % 4 = 1 THEN 'ambiguous' ELSE 'open_qa' END AS task_type,
        CASE WHEN turn % 3 = 1 THEN upper(coalesce(ws[2], '')) ELSE 'IT IS (C).' END AS said FROM o)
      SELECT conv_id, turn, len(os) AS n_options, fine AS has_options,
        CASE WHEN turn % 3 = 0 AND turn % 7 <= 3 THEN substring('ABCD', CAST(turn % 7 + 1 AS BIGINT), 1) WHEN turn % 3 = 0 AND turn % 7 = 4 THEN 'D'
          WHEN said IN ('A', 'B', 'C', 'D') THEN said WHEN regexp_extract(said, '\\b([ABCD])\\b', 1) <> '' THEN regexp_extract(said, '\\b([ABCD])\\b', 1)
          ELSE coalesce(list_filter(os, lambda x: x.t = {_normal("said")} AND x.t <> '')[1].l, '') END AS gold,
        task_type, CASE task_type WHEN 'open_retrieval' THEN 'aggressive' WHEN 'open_qa' THEN 'balanced' ELSE 'conservative' END AS retrieval_bias,
        CASE WHEN task_type = 'multiple_choice' THEN 'multiple_choice' ELSE 'open' END AS question_format FROM t""",
    "router_decisions": """WITH r AS (SELECT conv_id, turn, (['retrieve', 'abstain', 'direct', 'direct', 'clarify', 'retrieve', 'direct', 'direct'])[(conv_id + turn) % 8 + 1] AS route FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, route, CASE WHEN route <> 'retrieve' THEN 'none' WHEN turn % 5 IN (0, 3) THEN 'multi_step' ELSE 'single_step' END AS retrieval_mode,
        CAST(([0.82, 0.5, 0.0, 0.0, 1.0])[conv_id % 5 + 1] AS DOUBLE) AS confidence, CASE WHEN turn % 2 = 0 THEN 'No reason given by the router.' ELSE 'said so' END AS reason FROM r""",
    "run_issues": f"""WITH {_PAIRS}, {_ROUTES}, {_runs("claims")}, {_CLAIMS}, {_EVIDENCE}, {_CLAIMED}, {", ".join(
        f"b{i} AS (SELECT '{level}' AS level, '{name}' AS category, conv_id || ':' || turn AS item FROM claimed WHERE {rule})" for i, (level, name, rule) in enumerate((
            ("critical", "run_error", "error_type = 'run_error'"), ("critical", "invalid_answer_format", "error_type = 'format_error'"), ("warning", "claim_refuted", "refuted_rate > 0"),
            ("warning", "claims_mostly_open", "open_rate > 0.5"), ("warning", "supported_but_wrong", "all_supported AND NOT final_correct"), ("info", "changed_behaviour", "changed_behaviour"),
        )))}
      SELECT level, category, count(*) AS n, count(DISTINCT item) AS n_items FROM ({" UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(6))}) GROUP BY ALL""",
}
