"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from quillspark.functions import lexicon as L
from quillspark.functions.evaluate import markers


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _any(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(p)})" for p in phrases) + ")"


def _normal(c: str) -> str:
    low = f"replace(translate(lower(coalesce({c}, '')), '{L.ACCENTED}', '{L.PLAIN}'), '’', '''')"
    return rf"trim(regexp_replace(regexp_replace({low}, '[[:punct:]]', '', 'g'), '\s+', ' ', 'g'))"


def _tokens(norm: str) -> str:
    return f"list_filter(regexp_extract_all({norm}, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN {_in(L.STOPWORDS)})"


def _words(c: str) -> str:
    return rf"len(regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}_]+'))"


def _overlap(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct(list_intersect({a}, {b})), "
        f"lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda z: z = t))))), 0)"
    )


def _sentences(c: str) -> str:
    marked = rf"regexp_replace(coalesce({c}, ''), '([.!?])\s+', '\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"


def _negated(norm: str) -> str:
    return _any(f"(' ' || {norm} || ' ')", [f" {m} " for m in L.NEGATION_MARKERS])


_PAIRS = f"""
    asked AS (SELECT conv_id, turn + 1 AS turn, text AS question FROM conversations WHERE role = 'user'),
    joined AS (
      SELECT c.conv_id, c.turn, question, c.text AS answer, {_normal("question")} AS q, {_normal("c.text")} AS a
      FROM conversations c JOIN asked ON asked.conv_id = c.conv_id AND asked.turn = c.turn WHERE c.role = 'assistant'
    ),
    tokened AS (SELECT *, {_tokens("q")} AS q_tokens, {_tokens("a")} AS a_tokens FROM joined),
    counted AS (SELECT *, {_overlap("a_tokens", "q_tokens")} AS shared, len(q_tokens) AS nq, len(a_tokens) AS na FROM tokened),
    shares AS (
      SELECT *, CASE WHEN nq > 0 AND na > 0 THEN shared / na ELSE 0 END AS p, CASE WHEN nq > 0 AND na > 0 THEN shared / nq ELSE 0 END AS r FROM counted
    ),
    pairs AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM shares)
"""


def _ladder(w: str, wt: str, a: str, at: str, f1: str) -> str:
    cover = f"CASE WHEN len({wt}) > 0 AND len({at}) > 0 THEN len(list_filter({wt}, lambda t: list_contains({at}, t))) / len({wt}) ELSE 0 END"
    return f"""CASE WHEN {w} = '' OR {a} = '' THEN 0.0 WHEN {w} = {a} THEN 1.0
      WHEN length({w}) >= 12 AND contains({a}, {w}) THEN 0.98 WHEN length({a}) >= 12 AND contains({w}, {a}) THEN 0.95
      ELSE greatest({f1}, 0.85 * ({cover})) END"""


_NAMES = r"\b(?:[A-Z][a-zA-Z'.-]+(?:\s+(?:of|the|and|de|del|la|le|du|von|van|da|di|[A-Z][a-zA-Z'.-]+))*)".replace("'", "''")
_ROUTES = rf"""
    turns AS (
      SELECT conv_id, turn, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user'
    ),
    lows AS (
      SELECT *, trim(regexp_replace(regexp_replace(lower(q), '[^a-záéíóúüñ0-9 ?¿'']', ' ', 'g'), '\s+', ' ', 'g')) AS low,
             {_words("q")} AS words,
             len(list_distinct(list_filter(
               regexp_extract_all(translate(replace(q, '’', ''''), '{L.ACCENTED}', '{L.PLAIN}'), '{_NAMES}'),
               lambda m: regexp_extract(m, '^(\S+)', 1) NOT IN {_in(L.ENTITY_OPENERS)} AND length(m) > 2))) AS names
      FROM turns
    ),
    cues AS (SELECT *, ' ' || low || ' ' AS padded, {_any("(' ' || low || ' ')", L.MULTI_STEP_CUES)} AS multi FROM lows),
    ruled AS (
      SELECT *, CASE
        WHEN q = '' THEN 'empty_question'
        WHEN regexp_replace(low, '\?+$', '') IN {_in(L.AMBIGUOUS_QUESTIONS)} THEN 'ambiguous_exact'
        WHEN words <= 8 AND list_has_any(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+'), [{", ".join(map(_q, L.AMBIGUOUS_REFERENCES))}])
          THEN 'short_with_unresolved_reference'
        WHEN contains(low, 'according to the available corpus') AND {_any("low", L.NO_ANSWER_MARKERS)} THEN 'synthetic_no_answer_marker'
        WHEN {_any("low", L.RETRIEVAL_CUES)} THEN 'explicit_corpus_or_document_cue'
        WHEN names >= 2 AND multi THEN 'multi_entity_multi_step_cue'
        WHEN names >= 3 AND words >= 9 THEN 'many_named_entities'
        WHEN {_any("padded", L.CONCEPTUAL_CUES)} AND names <= 1 THEN 'conceptual_or_general_question'
        ELSE 'fallback_direct' END AS rule
      FROM cues
    ),
    routed AS (
      SELECT conv_id, turn, text, rule,
        CASE WHEN rule IN ('empty_question', 'ambiguous_exact', 'short_with_unresolved_reference') THEN 'clarify'
             WHEN rule = 'synthetic_no_answer_marker' THEN 'abstain'
             WHEN rule IN ('explicit_corpus_or_document_cue', 'multi_entity_multi_step_cue', 'many_named_entities') THEN 'retrieve'
             ELSE 'direct' END AS route,
        CASE WHEN rule = 'explicit_corpus_or_document_cue' THEN CASE WHEN multi THEN 'multi_step' ELSE 'single_step' END
             WHEN rule = 'multi_entity_multi_step_cue' THEN 'multi_step'
             WHEN rule = 'many_named_entities' THEN 'single_step' ELSE 'none' END AS retrieval_mode,
        CAST(CASE rule WHEN 'empty_question' THEN 1.0 WHEN 'ambiguous_exact' THEN 0.96 WHEN 'short_with_unresolved_reference' THEN 0.9
             WHEN 'synthetic_no_answer_marker' THEN 0.93 WHEN 'explicit_corpus_or_document_cue' THEN 0.84
             WHEN 'multi_entity_multi_step_cue' THEN 0.82 WHEN 'many_named_entities' THEN 0.74
             WHEN 'conceptual_or_general_question' THEN 0.72 ELSE 0.58 END AS DOUBLE) AS confidence
      FROM ruled
    )
"""

_SEARCH = """
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, q.label AS query_label, c.label, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
"""

_LABELLED = "labelled AS (SELECT doc_id, lang, source, n_chars, text, quality, toxic FROM documents JOIN labels USING (doc_id))"
_PREDICTED = f"""{_LABELLED},
    predicted AS (
      SELECT CAST(quality AS VARCHAR) AS expected,
             CASE WHEN len(regexp_extract_all(text, '[#*$%&|<>!]')) * 8 > length(text) THEN '0' ELSE '1' END AS predicted
      FROM labelled
    )"""
_BROKEN = """broken AS (
      SELECT l_orderkey, 'error' AS level, 'no_price' AS category FROM lineitem WHERE l_extendedprice <= 0
      UNION ALL SELECT l_orderkey, 'error', 'discount_over_tenth' FROM lineitem WHERE l_discount > CAST(0.09 AS DOUBLE)
      UNION ALL SELECT l_orderkey, 'warning', 'large_quantity' FROM lineitem WHERE l_quantity > 45
      UNION ALL SELECT l_orderkey, 'warning', 'returned' FROM lineitem WHERE l_returnflag = 'R'
    )"""

_SUMMARY = """count(*) AS n, round(avg(CAST(quality = 1 AS INTEGER)), 6) AS quality_rate,
      round(avg(CAST(toxic = 1 AS INTEGER)), 6) AS toxic_rate, round(avg(n_chars), 6) AS mean_chars FROM labelled"""

_BEST = f"""
    listed AS (SELECT conv_id, turn, a, a_tokens, unnest({_sentences("question")}) AS c, generate_subscripts({_sentences("question")}, 1) AS place FROM pairs),
    normed AS (SELECT *, {_normal("c")} AS w FROM listed),
    worded AS (SELECT *, {_tokens("w")} AS wt FROM normed),
    lapped AS (SELECT *, {_overlap("a_tokens", "wt")} AS n FROM worded),
    parted AS (
      SELECT *, CASE WHEN len(wt) > 0 AND len(a_tokens) > 0 THEN n / len(a_tokens) ELSE 0 END AS cp,
             CASE WHEN len(wt) > 0 AND len(a_tokens) > 0 THEN n / len(wt) ELSE 0 END AS cr FROM lapped
    ),
    laddered AS (
      SELECT conv_id, turn, c, place, {_ladder("w", "wt", "a", "a_tokens", "CASE WHEN cp + cr > 0 THEN 2 * cp * cr / (cp + cr) ELSE 0 END")} AS score FROM parted
    ),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, place) AS k FROM laddered WHERE score > 0)
"""

_RIGHT = "r2 >= 0.35 AND r2 >= w2 + 0.05"
_WRONG = "w2 >= 0.45 AND w2 >= r2 + 0.05"

_CHOICE = r"^\s*(?:(?:the\s+)?answer\s+is\s+|(?:la\s+)?respuesta\s+es\s+|option\s+|opci[oó]n\s+)?([ABCD])\.?\s*$"


def _names(c: str) -> str:
    return rf"""len(list_distinct(list_filter(
      regexp_extract_all(translate(replace(coalesce({c}, ''), '’', ''''), '{L.ACCENTED}', '{L.PLAIN}'), '{_NAMES}'),
      lambda m: regexp_extract(m, '^(\S+)', 1) NOT IN {_in(L.ENTITY_OPENERS)} AND length(m) > 2)))"""


def _low(s: str) -> str:
    return rf"trim(regexp_replace(lower({s}), '\s+', ' ', 'g'))"


def _kind(s: str) -> str:
    return f"""CASE WHEN {_any(_low(s), L.ABSTENTION["extraction"])} THEN 'abstention' WHEN {_any(_low(s), L.CLARIFICATION["extraction"])} THEN 'clarification'
      WHEN {_any(_low(s), L.META_MARKERS)} THEN 'meta' WHEN regexp_matches({s}, '{_CHOICE}', 'i') THEN 'answer_choice' ELSE 'factual' END"""


def _stated(c: str) -> str:
    bare = rf"trim(regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '^[-*•]\s*', ''))"
    bare = f"trim(trim(trim({bare}, {_q(chr(34))}), {_q(chr(39))}))"
    return f"CASE WHEN length({bare}) > 600 THEN rtrim(({bare})[1:600]) || ' [...]' ELSE {bare} END"


_POLICY = rf"""
    parts AS (SELECT conv_id, turn, question, unnest({_sentences("answer")}) AS said, generate_subscripts({_sentences("answer")}, 1) - 1 AS pos FROM pairs),
    lowered AS (
      SELECT *, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS low, length(said) / 100.0 AS sure, {_names("said")} AS said_names, {_names("question")} AS asked_names,
             CASE conv_id % 5 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'open_direct' ELSE 'open_qa' END AS task,
             CASE turn % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' ELSE 'aggressive' END AS bias FROM parts
    ),
    flags AS (
      SELECT *, {_any("lower(coalesce(question, ''))", L.DOCUMENT_CUES)} OR {_any("low", L.DOCUMENT_CUES)} AS explicit, task = 'multiple_choice' AS choice,
             task = 'multiple_choice' OR bias = 'conservative' OR (bias = 'balanced' AND sure >= 0.85) AS weak,
             task = 'multiple_choice' OR (bias = 'conservative' AND sure >= 0.7) AS factual,
             regexp_matches(said, '\b\d{{2,4}}\b') OR regexp_matches(said, '\b({"|".join(L.MONTHS)})\b', 'i') AS dated,
             {_any("(' ' || low || ' ')", L.FACTUAL_CUES)} AS related, {_any("(' ' || low || ' ')", L.COMPARISON_CUES)} AS compared,
             asked_names >= 2 AND len(string_split(low, ' ')) >= 6 AS many FROM lowered
    ),
    decided AS (
      SELECT *, CASE WHEN said = '' THEN 'empty_candidate' WHEN {_any("low", L.ABSTENTION_MARKERS)} THEN 'abstention_sentence'
        WHEN {_any("low", L.CLARIFICATION_MARKERS)} THEN 'clarification_sentence' WHEN {_any("low", L.INTRO_MARKERS)} THEN 'generic_intro'
        WHEN choice AND NOT explicit THEN 'multiple_choice_direct_no_retrieval' WHEN explicit AND choice THEN 'suppressed_documental_cue_multiple_choice'
        WHEN explicit THEN 'documental_cue' WHEN task = 'open_direct' AND bias = 'conservative' THEN 'open_direct_conservative_no_retrieval'
        WHEN dated THEN CASE WHEN factual THEN 'suppressed_' ELSE '' END || 'number_or_date'
        WHEN related THEN CASE WHEN factual THEN 'suppressed_' ELSE '' END || 'factual_relation_cue'
        WHEN compared THEN CASE WHEN weak THEN 'suppressed_' ELSE '' END || 'comparison_cue'
        WHEN said_names >= 1 THEN CASE WHEN weak THEN 'suppressed_' ELSE '' END || 'named_entity'
        WHEN many THEN CASE WHEN weak THEN 'suppressed_' ELSE '' END || 'question_multi_entity'
        ELSE 'fallback_no_retrieval' END AS rule FROM flags
    )
"""

_SURENESS = """CAST(CASE rule WHEN 'empty_candidate' THEN 1.0 WHEN 'abstention_sentence' THEN 0.94 WHEN 'clarification_sentence' THEN 0.94 WHEN 'generic_intro' THEN 0.82
          WHEN 'multiple_choice_direct_no_retrieval' THEN 0.95 WHEN 'suppressed_documental_cue_multiple_choice' THEN 0.92
          WHEN 'documental_cue' THEN CASE WHEN bias = 'aggressive' THEN 0.9 ELSE 0.86 END WHEN 'open_direct_conservative_no_retrieval' THEN 0.92
          WHEN 'number_or_date' THEN 0.84 WHEN 'factual_relation_cue' THEN 0.83 WHEN 'comparison_cue' THEN 0.78 WHEN 'named_entity' THEN 0.74
          WHEN 'question_multi_entity' THEN 0.7 WHEN 'suppressed_named_entity' THEN 0.8 WHEN 'fallback_no_retrieval' THEN 0.62 ELSE 0.78 END AS DOUBLE) AS confidence,"""

_CLAIMS = rf"""
    stated AS (SELECT *, trim(coalesce(answer, '')) AS said FROM pairs),
    chosen AS (
      SELECT *, upper(regexp_extract(said, '{_CHOICE}', 1, 'i')) AS letter,
             regexp_replace(regexp_replace(said, '\n+\s*[-*•]\s*', '. ', 'g'), '\n+', ' ', 'g') AS joined_ FROM stated
    ),
    cutup AS (
      SELECT *, list_filter(list_transform(string_split(regexp_replace(joined_, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: {_stated("s")}), lambda s: length(s) >= 2) AS found_ FROM chosen
    ),
    pieces AS (
      SELECT conv_id, turn, question, q, q_tokens, CASE
        WHEN said = '' THEN []
        WHEN letter <> '' THEN [{{'t': 'The selected answer is ' || letter || '.', 'k': 'answer_choice'}}]
        WHEN {_any(_low("said"), L.CLARIFICATION["extraction"])} THEN [{{'t': {_stated("said")}, 'k': 'clarification'}}]
        WHEN {_any(_low("said"), L.ABSTENTION["extraction"])} THEN [{{'t': {_stated("said")}, 'k': 'abstention'}}]
        ELSE list_filter(list_transform(CASE WHEN len(found_) > 0 THEN found_ ELSE [{_stated("joined_")}] END, lambda s: {{'t': s, 'k': {_kind("s")}}}),
                         lambda c: NOT (c.k = 'meta' AND len(regexp_split_to_array(c.t, '\s+')) <= 5)) END AS cs FROM cutup
    ),
    unnested AS (SELECT conv_id, turn, question, q, q_tokens, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos FROM pieces),
    claims AS (SELECT conv_id, turn, question, q, q_tokens, c.t AS claim, c.k AS claim_type, pos FROM unnested)
"""


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


def _verdict(e: str, f: str, p: str, r: str) -> str:
    return f"""CASE WHEN c = '' OR {e} = '' THEN 'not_enough_info' WHEN {f} >= 0.6 AND {_negated("c")} <> {_negated(e)} THEN 'refuted'
      WHEN {f} >= 0.45 OR ({p} >= 0.55 AND {r} >= 0.25) THEN 'supported' ELSE 'not_enough_info' END"""


_ROUNDS = f"""
    cn AS (SELECT conv_id, turn, pos, claim_type, q AS e, q_tokens AS et, {_normal("claim")} AS c FROM claims),
    ct AS (SELECT *, {_tokens("c")} AS ct FROM cn),
    later AS (SELECT conv_id, turn - 1 AS turn, {_normal("text")} AS e2 FROM conversations),
    both_ AS (SELECT ct.*, e2, {_tokens("e2")} AS e2t FROM ct LEFT JOIN later ON later.conv_id = ct.conv_id AND later.turn = ct.turn),
    laps AS (SELECT *, {_overlap("ct", "et")} AS n1, {_overlap("ct", "e2t")} AS n2 FROM both_),
    prs AS (
      SELECT *, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN n1 / len(ct) ELSE 0 END AS p1, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN n1 / len(et) ELSE 0 END AS r1,
             CASE WHEN len(ct) > 0 AND len(e2t) > 0 THEN n2 / len(ct) ELSE 0 END AS p2, CASE WHEN len(ct) > 0 AND len(e2t) > 0 THEN n2 / len(e2t) ELSE 0 END AS r2 FROM laps
    ),
    f AS (
      SELECT *, CAST(CASE WHEN length(c) > 0 AND contains(e, c) THEN greatest({_f1("p1", "r1")}, 0.98) ELSE {_f1("p1", "r1")} END AS DOUBLE) AS f1,
             CAST(CASE WHEN length(c) > 0 AND contains(e2, c) THEN greatest({_f1("p2", "r2")}, 0.98) ELSE {_f1("p2", "r2")} END AS DOUBLE) AS f2 FROM prs
    ),
    vs AS (SELECT *, {_verdict("e", "f1", "p1", "r1")} AS v1, {_verdict("e2", "f2", "p2", "r2")} AS v2 FROM f),
    verified AS (
      SELECT conv_id, turn, pos, CASE WHEN v1 = 'not_enough_info' AND e2 IS NOT NULL THEN v2 ELSE v1 END AS verdict,
             CASE WHEN v1 = 'not_enough_info' AND e2 IS NOT NULL THEN 2 ELSE 1 END AS rounds,
             CASE WHEN v1 = 'not_enough_info' AND e2 IS NOT NULL
               THEN array_to_string(list_filter(list_concat(ct, et), lambda x, i: list_position(list_concat(ct, et), x) = i)[1:12], ' ') END AS next_search FROM vs
    )
"""


ORACLES = {
    "vec_topk": f"WITH {_SEARCH} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "vec_topk_exclude_seen": f"WITH {_SEARCH} SELECT query_id, CAST(rank - 3 AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank BETWEEN 4 AND 8",
    "vec_ir_metrics": f"""WITH {_SEARCH},
      sizes AS (SELECT label, count(*) - 1 AS n_gold FROM v GROUP BY label),
      per AS (
        SELECT v.vec_id, v.label, n_gold, count(r.vec_id) AS n, min(r.rank) AS first_hit
        FROM v JOIN sizes USING (label) LEFT JOIN ranked r ON r.query_id = v.vec_id AND r.rank <= 5 AND r.label = r.query_label
        WHERE v.vec_id % 20 = 0 GROUP BY ALL
      )
      SELECT label, count(*) AS n_queries, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS hit,
             round(avg(CASE WHEN n_gold > 0 THEN n / n_gold ELSE 0 END), 6) AS recall,
             round(avg(n / 5), 6) AS precision, round(avg(coalesce(1 / first_hit, 0)), 6) AS mrr
      FROM per GROUP BY label""",
    "vec_index_check": """SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
      CAST(max(len(embedding)) AS INTEGER) AS max_dim,
      round(max(abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1)), 6) AS max_norm_error FROM embeddings""",
    "vec_index_parts": """WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, len(embedding) AS dim, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings)
      SELECT place // 150 AS part, count(*) AS n_rows, min(place) AS "first", max(place) AS "last", min(dim) AS min_dim, round(max(abs(norm - 1)), 6) > 0.001 AS norm_is_off, CAST(0 AS BIGINT) AS n_issues FROM n GROUP BY ALL""",
    "text_normalise_stats": f"""WITH n AS (SELECT doc_id, {_words("text")} AS n_words, {_normal("text")} AS norm FROM documents),
      t AS (SELECT *, {_tokens("norm")} AS tokens FROM n)
      SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(norm) AS BIGINT) AS norm_chars, CAST(len(tokens) AS BIGINT) AS n_tokens,
             CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM t""",
    "sentence_stats": f"""WITH s AS (SELECT doc_id, {_sentences("text")} AS s FROM documents)
      SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest,
             CAST(coalesce(length(s[1]), 0) AS BIGINT) AS first_chars FROM s""",
    "turn_token_f1": f"WITH {_PAIRS} SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM pairs",
    "text_ladder": f"WITH {_PAIRS} SELECT conv_id, turn, round(CAST({_ladder('q', 'q_tokens', 'a', 'a_tokens', 'f1')} AS DOUBLE), 6) AS similarity FROM pairs",
    "best_match": f"""WITH {_PAIRS}, {_BEST}
      SELECT p.conv_id, p.turn, round(CAST(coalesce(f.score, 0) AS DOUBLE), 6) AS score, md5(coalesce(f.c, '')) AS candidate_md5
      FROM pairs p LEFT JOIN firsts f ON f.conv_id = p.conv_id AND f.turn = p.turn AND f.k = 1""",
    "claim_verdicts": f"""WITH {_PAIRS},
      lifted AS (SELECT *, CAST(CASE WHEN length(q) > 0 AND contains(a, q) THEN greatest(f1, 0.98) ELSE f1 END AS DOUBLE) AS f FROM pairs)
      SELECT conv_id, turn, CASE WHEN q = '' OR a = '' THEN 'not_enough_info'
        WHEN f >= 0.6 AND {_negated("q")} <> {_negated("a")} THEN 'refuted'
        WHEN f >= 0.45 OR (p >= 0.55 AND r >= 0.25) THEN 'supported' ELSE 'not_enough_info' END AS verdict, round(f, 6) AS f1 FROM lifted""",
    "open_answers": f"""WITH {_PAIRS},
      later AS (SELECT conv_id, turn - 1 AS turn, {_normal("text")} AS x FROM conversations),
      nexts AS (SELECT pairs.*, coalesce(x, '') AS x FROM pairs LEFT JOIN later ON later.conv_id = pairs.conv_id AND later.turn = pairs.turn),
      heads AS (SELECT *, {_tokens("x")} AS h, instr(a, x) AS place FROM nexts),
      laps AS (SELECT *, {_overlap("a_tokens", "h")} AS s2 FROM heads),
      sh AS (SELECT *, CASE WHEN na > 0 AND len(h) > 0 THEN s2 / na ELSE 0 END AS hp, CASE WHEN na > 0 AND len(h) > 0 THEN s2 / len(h) ELSE 0 END AS hr,
             list_filter(string_split(substring(a, CAST(greatest(place - 25, 1) AS BIGINT), CAST(least(place - 1, 25) AS BIGINT)), ' '), lambda w: w <> '') AS before FROM laps),
      two AS (
        SELECT *, CAST({_ladder("q", "q_tokens", "a", "a_tokens", "f1")} AS DOUBLE) AS r2,
               CASE WHEN x = '' OR a = '' THEN 0 WHEN x = a THEN 1 WHEN length(x) >= 12 AND place > 0
                 THEN CASE WHEN list_has_any(before[-4:], [{", ".join(map(_q, L.NEGATION_BEFORE))}]) THEN 0.25 ELSE 0.98 END
                 ELSE CASE WHEN hp + hr > 0 THEN 2 * hp * hr / (hp + hr) ELSE 0 END END AS w2,
               {_any("a", markers(L.ABSTENTION["open"]))} AS abstained FROM sh
      ),
      done AS (
        SELECT *, CASE WHEN abstained THEN FALSE WHEN {_RIGHT} AND NOT ({_WRONG}) THEN na >= 3 WHEN {_WRONG} AND NOT ({_RIGHT}) THEN FALSE END AS correct FROM two
      )
      SELECT conv_id, turn, abstained, correct, correct IS NULL AS needs_review FROM done""",
    "route_turns": f"WITH {_ROUTES} SELECT conv_id, turn, route, retrieval_mode, confidence, rule FROM routed",
    "routed_prompts": f"""WITH {_ROUTES},
      built AS (
        SELECT conv_id, turn, route,
          CASE route WHEN 'retrieve' THEN 'Answer from the passages.' WHEN 'clarify' THEN 'Ask what is meant.' ELSE 'Answer.' END
          || chr(10) || chr(10) || 'Question: '
          || trim(text) AS prompt
        FROM routed
      )
      SELECT conv_id, turn, route, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5 FROM built""",
    "route_counts": f"WITH {_ROUTES} SELECT route, rule, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM routed GROUP BY ALL",
    "coerce_confidences": """WITH x AS (
        SELECT event_id, event_id % 3 = 0 AS percent, CAST(CAST(CAST(round(value, 2) AS DECIMAL(18, 2)) AS VARCHAR) AS DOUBLE) AS v FROM events
      ), y AS (SELECT event_id, CASE WHEN percent OR (v > 1 AND v <= 100) THEN v / 100 ELSE v END AS c FROM x)
      SELECT event_id, round(CASE WHEN c >= 0 AND c <= 1 THEN c END, 6) AS confidence,
             round(coalesce(greatest(least(c, 1.0), 0.0), 0.0), 6) AS clamped FROM y""",
    "json_payload_fields": """WITH x AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
      SELECT event_id, coalesce(CAST(trunc(TRY_CAST(k AS DOUBLE)) AS BIGINT), -1) AS k,
             CASE WHEN lower(trim(k)) IN ('true', 't', 'yes', 'y', '1', 'sí', 'si') THEN TRUE
                  WHEN lower(trim(k)) IN ('false', 'f', 'no', 'n', '0') THEN FALSE END AS k_flag, k IS NOT NULL AS valid FROM x""",
    "list_cells": """WITH m AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '|' WHEN 1 THEN ',' ELSE ' ' END AS mark FROM part),
      c AS (SELECT p_partkey, replace(p_type, ' ', mark) || mark || p_brand || mark || p_type AS cell FROM m),
      l AS (SELECT p_partkey, list_filter(list_transform(
        CASE WHEN contains(cell, '|') THEN string_split(cell, '|') WHEN contains(cell, ',') THEN string_split(cell, ',') ELSE [cell] END,
        lambda x: trim(x)), lambda x: x <> '') AS items FROM c)
      SELECT p_partkey, CAST(len(items) AS BIGINT) AS n_items,
             array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), '|') AS items FROM l""",
    "group_summary": f"""WITH {_LABELLED}
      SELECT 'overall' AS group_type, '' AS lang, '' AS source, {_SUMMARY}
      UNION ALL SELECT 'lang', coalesce(lang, ''), '', {_SUMMARY} GROUP BY lang
      UNION ALL SELECT 'source', '', coalesce(source, ''), {_SUMMARY} GROUP BY source
      UNION ALL SELECT 'lang_source', coalesce(lang, ''), coalesce(source, ''), {_SUMMARY} GROUP BY lang, source""",
    "confusion_quality": f"WITH {_PREDICTED} SELECT expected, predicted, count(*) AS n FROM predicted GROUP BY ALL",
    "prf_quality": f"""WITH {_PREDICTED},
      names AS (SELECT expected AS label FROM predicted UNION SELECT predicted FROM predicted),
      c AS (
        SELECT label, count(*) FILTER (expected = label AND predicted = label) AS tp,
               count(*) FILTER (expected <> label AND predicted = label) AS fp, count(*) FILTER (expected = label AND predicted <> label) AS fn
        FROM names, predicted WHERE label IS NOT NULL GROUP BY label
      ),
      pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM c)
      SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM pr""",
    "question_rollup": """WITH per AS (SELECT l_orderkey, count(*) AS n, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS rate FROM lineitem GROUP BY l_orderkey)
      SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(n) AS BIGINT) AS n_lines, round(avg(rate), 6) AS mean_rate, count(DISTINCT o_custkey) AS n_customers
      FROM orders JOIN per ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "value_counts": """SELECT 'lang' AS field, coalesce(lang, '<null>') AS value, count(*) AS n FROM documents GROUP BY ALL
      UNION ALL SELECT 'source', coalesce(source, '<null>'), count(*) FROM documents GROUP BY ALL""",
    "dq_issue_counts": f"WITH {_BROKEN} SELECT level, category, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM broken GROUP BY ALL",
    "dq_status": f"""WITH {_BROKEN}, c AS (SELECT count(*) FILTER (level = 'error') AS n_errors, count(*) FILTER (level = 'warning') AS n_warnings FROM broken)
      SELECT CASE WHEN n_errors > 0 THEN 'FAIL' WHEN n_warnings > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, n_errors, n_warnings FROM c""",
    "dq_keys": """WITH k AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
      SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(l_orderkey) AS n_keys, count(*) FILTER (n > 1 AND l_orderkey IS NOT NULL) AS n_repeated,
             CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL), 0) AS BIGINT) AS n_without FROM k""",
    "reconcile_orders": """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
      SELECT coalesce(n, 0) AS n_children, count(*) AS n_orders FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1""",
    "review_reasons": f"""WITH {_LABELLED}
      SELECT doc_id, concat_ws('|', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END,
        CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN n_chars < 300 THEN 'short' END) AS reasons FROM labelled""",
    "resume_todo": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "head_n_per_group": """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
      SELECT source, doc_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5""",
    "hash_sample": "SELECT doc_id, md5(doc_id || ':s1') AS mark FROM documents ORDER BY mark, doc_id LIMIT 100",
    "qrels_remap": "SELECT coalesce(lang, 'xx') || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS doc_id, quality FROM labels JOIN documents USING (doc_id)",
    "strata_union": """SELECT 'benchmark' AS stratum, CAST(item_id AS VARCHAR) AS id, '' AS source, CAST(length(text) AS BIGINT) AS chars FROM benchmark
      UNION ALL SELECT 'turn', conv_id || ':' || turn, '', length(text) FROM conversations WHERE role = 'user'
      UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), source, length(text) FROM documents""",
    "turn_positions": "SELECT conv_id, role, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY ALL",
    "retrieval_policy": f"""WITH {_PAIRS}, {_POLICY}
      SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos,
        rule IN ('documental_cue', 'number_or_date', 'factual_relation_cue', 'comparison_cue', 'named_entity', 'question_multi_entity') AS needs_retrieval,
        {_SURENESS}
        rule FROM decided""",
    "answer_claims": f"""WITH {_PAIRS}, {_CLAIMS}
      SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, claim_type, claim_type = 'factual' AS requires_evidence,
             CASE WHEN pos = 0 THEN 'core' ELSE 'supporting' END AS importance, md5(claim) AS claim_md5 FROM claims""",
    "verify_rounds": f"""WITH {_PAIRS}, {_CLAIMS}, {_ROUNDS}
      SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, verdict, rounds, md5(next_search) AS search_md5 FROM verified""",
    "answer_errors": f"""WITH {_PAIRS},
      ids AS (
        SELECT *, list_filter(q_tokens, lambda x, i: list_position(q_tokens, x) = i) AS gold, list_filter(a_tokens, lambda x, i: list_position(a_tokens, x) = i) AS got FROM pairs
      ),
      met AS (SELECT *, len(list_intersect(gold, got)) AS met, {_any("a", markers(L.ABSTENTION["retrieved"]))} AS abstained FROM ids)
      SELECT conv_id, turn, round(CASE WHEN len(gold) > 0 THEN met / len(gold) ELSE 0 END, 6) AS recall, round(CASE WHEN len(got) > 0 THEN met / len(got) ELSE 0 END, 6) AS precision,
        CASE WHEN conv_id % 11 = 0 THEN 'run_error' WHEN conv_id % 7 = 0 THEN 'format_error' WHEN f1 >= 0.3 THEN 'correct'
          WHEN abstained AND len(gold) > 0 AND met = len(gold) THEN 'wrong_abstention_despite_full_retrieval'
          WHEN abstained AND met > 0 THEN 'wrong_abstention_with_partial_retrieval' WHEN abstained THEN 'wrong_abstention_no_gold_retrieved'
          WHEN met = 0 THEN 'retrieval_miss' WHEN met < len(gold) THEN 'partial_retrieval_or_generation_error'
          ELSE 'generation_error_after_full_retrieval' END AS error_type FROM met""",
    "route_errors": f"""WITH {_ROUTES},
      e AS (SELECT *, (['direct', 'retrieve', 'abstain', 'clarify'])[conv_id % 4 + 1] AS expected FROM routed),
      k AS (
        SELECT expected, route AS predicted, CASE
          WHEN route = expected AND expected = 'retrieve' AND retrieval_mode <> 'single_step' THEN 'route_correct_mode_wrong'
          WHEN route = expected THEN 'correct' WHEN turn % 4 = 0 AND route = 'direct' THEN 'acceptable_alternative'
          WHEN expected = 'retrieve' THEN 'under_retrieval' WHEN route = 'retrieve' THEN 'over_retrieval' WHEN expected = 'clarify' THEN 'missed_clarify'
          WHEN expected = 'abstain' THEN 'missed_abstain' WHEN route = 'clarify' THEN 'unnecessary_clarify' WHEN route = 'abstain' THEN 'unnecessary_abstain'
          ELSE 'wrong_route' END AS error_type FROM e
      )
      SELECT expected, predicted, error_type, count(*) AS n FROM k GROUP BY ALL""",
    "json_answers": """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN md5(trim(text) || ' {"}') END AS answer_md5, CASE WHEN turn % 4 < 3 THEN CAST(0.82 AS DOUBLE) END AS confidence,
      CASE WHEN turn % 4 < 3 THEN FALSE END AS abstained, turn % 4 < 3 AS valid, CASE WHEN turn % 4 < 3 THEN 'json' ELSE 'fallback' END AS method
      FROM conversations WHERE role = 'assistant'""",
    "claim_rows": f"""WITH {_PAIRS}, {_CLAIMS}
      SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, claim_type, CAST(length(claim) AS BIGINT) AS claim_chars FROM claims
      UNION ALL SELECT conv_id, turn, 0, 'no_claims', 0 FROM pieces WHERE len(cs) = 0""",
    "vec_merge_evidence": f"""WITH {_SEARCH}
      SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), '|' ORDER BY rank) AS evidence FROM ranked WHERE rank <= 6 GROUP BY query_id""",
    "keyword_topics": f"""WITH w AS (SELECT doc_id, list_distinct(string_split({_normal("text")}, ' ')) AS words FROM documents),
      n AS (SELECT doc_id, {", ".join(f"len(list_intersect(words, [{', '.join(map(_q, words))}])) AS t{i}" for i, words in enumerate(L.TOPICS.values()))} FROM w),
      b AS (SELECT *, greatest({", ".join(f"t{i}" for i in range(len(L.TOPICS)))}) AS best FROM n)
      SELECT doc_id, CASE WHEN best = 0 THEN 'other' {" ".join(f"WHEN t{i} = best THEN '{name}'" for i, name in enumerate(L.TOPICS))} END AS topic FROM b""",
}
