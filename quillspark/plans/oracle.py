"""The same queries as SQL for DuckDB, written from the same lexicon and literal tables."""

from __future__ import annotations

import re

from ..functions import scoring, signals
from ..functions.lexicon import DEFAULT
from ..functions.text import DISCLAIMER, DISCLAIMER_SNIPPET
from .catalog import AUDIENCES, PROFILES, SEEDS, VARIANTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else q(x) for x in r) + ")" for r in rows)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s\-]+', ' ', 'g'), '\s+', ' ', 'g'))"


_STOP = "[" + ", ".join(q(w) for w in DEFAULT.stopwords) + "]"
_CASES = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in DEFAULT.synonyms.items())


def tokens(x: str) -> str:
    return f"list_transform(list_filter(string_split({norm(x)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)), lambda w: CASE w {_CASES} ELSE w END)"


def any_of(x: str, phrases) -> str:
    return "regexp_matches(" + x + ", " + q("|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in phrases)) + ")"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def stable_hash(x: str) -> str:
    return f"substr(sha256(lower({squeeze(f'coalesce({x}, {q(str())})')})), 1, 16)"


_SEEDED = f"seeded AS (SELECT conv_id, turn, role, text || ' ' || ([{', '.join(q(s) for s in SEEDS)}])[CAST((conv_id * 7 + turn) % {len(SEEDS)} AS INTEGER) + 1] AS text FROM conversations), sn AS (SELECT *, {norm('text')} AS n FROM seeded)"
_TFIDF = f"""tk AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents),
cnt AS (SELECT doc_id, token, count(*) AS n FROM tk GROUP BY ALL),
tops AS (SELECT doc_id, max(n) AS top FROM cnt GROUP BY doc_id),
idfs AS (SELECT token, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY token),
post AS (SELECT doc_id, token, (0.5::DOUBLE + 0.5::DOUBLE * (n / top)) * idf AS w FROM cnt JOIN tops USING (doc_id) JOIN idfs USING (token)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM post GROUP BY doc_id)"""
_SEARCH = _TFIDF + f""",
qk AS (SELECT item_id, unnest({tokens('text')}) AS token FROM benchmark),
qc AS (SELECT item_id, token, count(*) AS n FROM qk GROUP BY ALL),
qt AS (SELECT item_id, max(n) AS top FROM qc GROUP BY item_id),
qw AS (SELECT item_id, token, (0.5::DOUBLE + 0.5::DOUBLE * (n / top)) * coalesce(idf, 1.0::DOUBLE) AS qw FROM qc JOIN qt USING (item_id) LEFT JOIN idfs USING (token)),
qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(qw * w) AS dot, string_agg(token, ' ' ORDER BY token) AS matched_terms FROM qw JOIN post USING (token) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, round(dot / (qnorm * norm), 4) AS score, matched_terms FROM dots JOIN qn USING (item_id) JOIN norms USING (doc_id) WHERE dot > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""

_FLAGS = values((i, p, label) for i, (p, label) in enumerate(DEFAULT.red_flags.items()))
_HINTS = values((i, case, h) for i, (case, hs) in enumerate(DEFAULT.hints.items()) for h in hs)
_ALIASES = values((s, a) for s, aliases in DEFAULT.symptoms.items() for a in aliases)
_NEG = values((p,) for p in DEFAULT.negations)


def _asserted(phrase: str) -> str:
    return f"contains(n, {phrase}) AND NOT EXISTS (SELECT 1 FROM (VALUES {_NEG}) v(p) WHERE contains(n, v.p || ' ' || {phrase}))"


def _marked(texts: str) -> str:
    """CTEs with all marks of the texts of a CTE `sn` (conv_id, turn, n)."""
    return f"""{texts}, phrases(pos, phrase, label) AS (VALUES {_FLAGS}), hints(pos, case_id, hint) AS (VALUES {_HINTS}), aliases(symptom, alias) AS (VALUES {_ALIASES}),
rf AS (SELECT conv_id, turn, string_agg(label, '|' ORDER BY pos) AS red_flags FROM (SELECT conv_id, turn, label, min(pos) AS pos FROM sn, phrases WHERE {_asserted('phrase')} GROUP BY ALL) GROUP BY ALL),
hc AS (SELECT conv_id, turn, string_agg(case_id, '|' ORDER BY pos) AS hinted FROM (SELECT DISTINCT conv_id, turn, case_id, pos FROM sn, hints WHERE {_asserted('hint')}) GROUP BY ALL),
hd AS (SELECT conv_id, turn, string_agg(hint, '|' ORDER BY hint) AS detected FROM (SELECT DISTINCT conv_id, turn, hint FROM sn, hints WHERE {_asserted('hint')}) GROUP BY ALL),
sy AS (SELECT conv_id, turn, symptom, bool_or(EXISTS (SELECT 1 FROM (VALUES {_NEG}) v(p) WHERE contains(n, v.p || ' ' || alias))) AS denied FROM sn, aliases WHERE contains(n, alias) GROUP BY ALL),
ss AS (SELECT conv_id, turn, string_agg(CASE WHEN NOT denied THEN symptom END, '|' ORDER BY symptom) AS present, string_agg(CASE WHEN denied THEN symptom END, '|' ORDER BY symptom) AS absent FROM sy GROUP BY ALL)"""


_MARKS = _marked(_SEEDED)
_RUNNING = f"""{_SEEDED.split(', sn AS')[0]}, rt AS (SELECT conv_id, turn, role, coalesce(string_agg(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS text FROM seeded),
sn AS (SELECT *, {norm('text')} AS n FROM rt WHERE role = 'user')"""


def _lines(prefix: str, column: str) -> str:
    return f"nullif({q(prefix)} || replace({column}, '|', {q('|' + prefix)}), {q(prefix)})"


_CLEARED = "regexp_matches(n, " + q("(?:" + "|".join(DEFAULT.clearances) + ") (?:" + "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in DEFAULT.red_flags) + ")") + ")"


def _duration(n: str = "n") -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({n}, {q(p)}, 0)), '')" for p in DEFAULT.durations) + ")"


_TEMPERATURE = "list_filter(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(n, {q(p)}, 1)" for p in signals.TEMPERATURES) + "), lambda v: CAST(v AS DOUBLE)), lambda v: v >= 45 OR v < 30)[1]"
_FEEDBACK = "CASE " + " ".join(f"WHEN {any_of('lower(text)', ps)} THEN {q(k)}" for k, ps in signals.FEEDBACK.items()) + " END"
_DETAIL = f"({any_of('lower(text)', signals.DETAIL_TERMS)} AND {any_of('lower(text)', signals.PREPARATION_TERMS)})"


def _sum(phrases, n: str = "n") -> str:
    return "(" + " + ".join(f"CAST(contains({n}, {q(p)}) AS INTEGER)" for p in phrases) + ")"


_CANDIDATES = """cand AS (SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS request, event_type AS model, CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, round(value, 2) AS score, (event_id * 37) % 5000 AS latency_ms,
    CASE WHEN user_id % 2 = 0 THEN 'follow_up' ELSE 'recommendation' END AS stage, event_id FROM events),
won AS (SELECT *, status = 'ok' AND row_number() OVER (PARTITION BY request, status ORDER BY score DESC, event_id) = 1 AS won FROM cand)"""

_GROUPS = f"""d AS (SELECT doc_id, text, {stable_hash('text')} AS grp FROM documents),
sizes AS (SELECT grp, count(*) AS n, sha256('42:' || grp) AS o FROM d GROUP BY grp),
run AS (SELECT *, coalesce(sum(n) OVER (ORDER BY substr(o, 1, 3), o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, sum(n) OVER () AS total FROM sizes),
v AS (SELECT *, p < greatest(1, floor(total * 0.08)) AS is_valid FROM run),
s AS (SELECT grp, CASE WHEN is_valid THEN 'valid' WHEN p - (SELECT sum(n) FROM v WHERE is_valid) < greatest(1, floor(total * 0.08)) THEN 'test' ELSE 'train' END AS split FROM v),
rows_ AS (SELECT d.doc_id, d.text, d.grp, s.split FROM d JOIN s USING (grp))"""

_VARIANTS = values(enumerate(VARIANTS))
_AUDIENCES = values(enumerate(AUDIENCES))
_LEGACY_TOTAL = " + ".join(f"{w} * {k}" for k, w in scoring.LEGACY_WEIGHTS.items())

SQL = {
    "normalize_documents": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "token_stats": f"SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM (SELECT lang, unnest({tokens('text')}) AS token FROM documents) GROUP BY lang",
    "doc_freq_idf": f"WITH {_TFIDF} SELECT token, df, round(idf, 6) AS idf FROM idfs",
    "tfidf_weights_norms": f"WITH {_TFIDF} SELECT doc_id, count(*) AS n_terms, round(max(w), 6) AS max_weight, round(sqrt(sum(w * w)), 6) AS norm FROM post GROUP BY doc_id",
    "tfidf_search_topk": f"WITH {_SEARCH} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank, matched_terms FROM ranked WHERE rank <= 10",
    "tfidf_rerank_filtered": f"""WITH {_SEARCH}, hits AS (SELECT r.item_id, r.doc_id, r.rank AS r0, {stable_hash('d.text')} AS h,
        round(r.score + CASE WHEN l.quality = 1 THEN 0.08 ELSE 0 END + CASE WHEN d.source IN ('src0', 'src1') THEN 0.25 ELSE 0 END + CASE WHEN l.toxic = 0 THEN 0.02 ELSE 0 END, 4) AS score
        FROM ranked r JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE r.rank <= 20 AND d.lang = 'en'),
        best AS (SELECT *, row_number() OVER (PARTITION BY item_id, h ORDER BY score DESC, r0) AS k FROM hits)
        SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, r0, doc_id) AS rank FROM best WHERE k = 1) WHERE rank <= 5""",
    "retrieval_bundle_union": """WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        a AS (SELECT source, doc_id, round(n_chars / 1000, 4) AS score, 1 AS ord FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 2),
        b AS (SELECT source, doc_id, round(n_chars / 900, 4) AS score, 2 AS ord FROM documents SEMI JOIN good USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 6),
        c AS (SELECT source, doc_id, round(n_chars / 1000, 4) AS score, 3 AS ord FROM documents WHERE lang <> 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 4)
        SELECT source, doc_id, score, ord FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY score DESC, ord) = 1""",
    "hint_antijoin_union": """WITH found AS (SELECT doc_id, round(n_chars / 10000, 4) AS score FROM documents WHERE n_chars >= 500 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
        SELECT * FROM found UNION ALL SELECT doc_id, CAST(0.85 AS DOUBLE) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM found)""",
    "embedding_topk_cosine": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT a.vec_id AS query_id, b.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.e, b.e))), 4) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(greatest(0, least(1, list_cosine_similarity(a.e, b.e))), 4) DESC, b.vec_id) AS INTEGER) AS rank
        FROM v a, v b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10""",
    "phrase_negation_flags": f"WITH {_MARKS} SELECT sn.conv_id, sn.turn, coalesce(red_flags, '') AS red_flags, {_CLEARED} AS cleared, coalesce(hinted, '') AS hinted FROM sn LEFT JOIN rf USING (conv_id, turn) LEFT JOIN hc USING (conv_id, turn)",
    "symptom_slots": f"WITH {_MARKS} SELECT sn.conv_id, sn.turn, coalesce(present, '') AS present, coalesce(absent, '') AS absent, coalesce(detected, '') AS detected FROM sn LEFT JOIN ss USING (conv_id, turn) LEFT JOIN hd USING (conv_id, turn)",
    "duration_extract": f"WITH {_SEEDED} SELECT conv_id, turn, {_duration()} AS duration_text FROM sn",
    "signal_flags": f"""WITH {_SEEDED} SELECT conv_id, turn, {any_of('n', DEFAULT.intensity)} AS intensity, {any_of('n', DEFAULT.progression)} AS progression, {any_of('n', DEFAULT.recommendation)} AS recommendation,
        {any_of('n', signals.CONFUSION)} AS confused, {_TEMPERATURE} AS invalid_temperature, {_FEEDBACK} AS feedback, {_DETAIL} AS preparation_detail FROM sn""",
    "running_conversation_text": "SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS running_text FROM conversations",
    "turn_dedupe_last_n": f"""WITH n AS (SELECT *, {norm('text')} AS t FROM conversations), kept AS (SELECT *, coalesce(lag(role) OVER w = role AND lag(t) OVER w = t, false) AS same FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, role, text FROM kept WHERE NOT same QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
    "question_budget_route": f"""WITH {_MARKS}, asked AS (SELECT conv_id, turn, least(3, coalesce(sum(CASE WHEN role = 'assistant' AND trim(text) LIKE '%?' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS asked FROM sn)
        SELECT sn.conv_id, sn.turn, CAST(asked AS BIGINT) AS asked, CASE WHEN sn.conv_id % 5 = 0 AND {_DETAIL} THEN 'preparation_detail' WHEN sn.conv_id % 5 = 0 AND {_FEEDBACK} IS NOT NULL THEN 'feedback' WHEN {any_of('n', signals.CONFUSION)} THEN 'clarification'
            WHEN {_TEMPERATURE} IS NOT NULL THEN 'temperature_clarification' WHEN red_flags IS NOT NULL THEN 'red_flag' WHEN NOT (coalesce(present, '') <> '' OR length(n) >= 60) THEN 'out_of_scope' WHEN asked >= 3 THEN 'final_recommendation' ELSE 'follow_up' END AS route
        FROM sn JOIN asked USING (conv_id, turn) LEFT JOIN rf USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn) WHERE role = 'user'""",
    "duplicate_question_history": f"""WITH {_SEEDED}, tt AS (SELECT conv_id, turn, n, list_distinct({tokens('text')}) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM sn)
        SELECT a.conv_id, a.turn, coalesce(bool_or(b.n <> '' AND (a.n = b.n OR contains(b.n, a.n) OR contains(a.n, b.n) OR len(list_intersect(a.t, b.t)) / greatest(1, least(len(a.t), len(b.t))) >= 0.72)), false) AS duplicate
        FROM tt a LEFT JOIN tt b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 8 AND a.k - 1 GROUP BY ALL""",
    "score_candidates_argmax": f"""WITH {_SEEDED}, c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM sn),
        e AS (SELECT conv_id, turn, text, n, CASE conv_id % 3 WHEN 0 THEN 'follow_up' WHEN 1 THEN 'red_flag' ELSE 'recommendation' END AS kind, list_distinct({tokens('before')}) AS expected, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS size FROM c WHERE role = 'assistant'),
        p AS (SELECT conv_id, turn,
            least(1.0::DOUBLE, 0.35::DOUBLE + CASE WHEN {any_of('n', ('bukan diagnosis', 'bukan pengganti'))} THEN 0.25 ELSE 0 END + CASE WHEN {any_of('n', ('tenaga kesehatan', 'fasilitas kesehatan'))} THEN 0.18 ELSE 0 END + CASE WHEN kind = 'red_flag' AND contains(n, 'tanda bahaya') THEN 0.12 ELSE 0 END + CASE WHEN {any_of('n', ('tanda bahaya', 'kewaspadaan'))} THEN 0.1 ELSE 0 END) AS safety,
            CASE WHEN len(expected) = 0 THEN 0.65::DOUBLE ELSE least(1.0::DOUBLE, len(list_filter(expected, lambda t: contains(n, t))) / greatest(8.0::DOUBLE, len(expected) * 0.55::DOUBLE)) END AS grounding,
            least(1.0::DOUBLE, CASE kind WHEN 'follow_up' THEN {_sum(scoring.FOLLOW_UP_SIGNALS)} / 4 WHEN 'red_flag' THEN {_sum(scoring.RED_FLAG_SIGNALS)} / 3 ELSE {_sum(scoring.RECOMMENDATION_SIGNALS)} / 5 END) AS completeness,
            CASE WHEN size BETWEEN 20 AND 1800 THEN 1.0::DOUBLE WHEN size BETWEEN 10 AND 19 OR size BETWEEN 1801 AND 2600 THEN 0.75 ELSE 0.45 END AS language,
            least(0.5::DOUBLE, {_sum(scoring.RISKY)} * 0.12::DOUBLE) AS penalty FROM e),
        t AS (SELECT *, round(greatest(0, least(1, {_LEGACY_TOTAL} - penalty)), 4) AS total FROM p)
        SELECT conv_id, turn, round(safety, 4) AS safety, round(grounding, 4) AS grounding, round(completeness, 4) AS completeness, round(language, 4) AS language, round(penalty, 4) AS penalty, total FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, turn) = 1""",
    "assessment_parse": r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'supported' ELSE 'internal_medicine' END AS scope, regexp_replace(text, '^\s+|\s+$', '', 'g') AS final_answer, 'teh jahe|madu' AS ingredients, conv_id % 2 = 0 AS enough, 'batuk' AS suspected FROM conversations WHERE role = 'assistant'""",
    "parse_json_payload": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "model_benchmark_rollup": f"WITH {_CANDIDATES} SELECT model, count(*) AS n, count(*) FILTER (won) AS wins, round(avg(CASE WHEN status = 'ok' THEN 1.0::DOUBLE ELSE 0 END), 6) AS ok_rate, round(avg(score), 6) AS mean_score, round(avg(latency_ms), 4) AS mean_latency_ms FROM won GROUP BY model",
    "stage_win_pivot": f"WITH {_CANDIDATES} SELECT model, count(*) FILTER (stage = 'follow_up') AS follow_up, count(*) FILTER (stage = 'recommendation') AS recommendation FROM won WHERE won GROUP BY model",
    "page_text_extract": r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>', ' ', 'g'), '(?is)<title>.*?</title>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
    "page_title_link_stats": r"""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages, CAST(sum(len(regexp_extract_all(html, '<a href='))) AS BIGINT) AS links, max(length(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))) AS longest_title FROM pages GROUP BY 1""",
    "dedupe_first_by_hash": f"SELECT doc_id, source, {stable_hash('text')} AS text_hash FROM documents QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) = 1",
    "entity_merge": r"""WITH p AS (SELECT *, regexp_replace(regexp_replace(lower(p_brand || ' - ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS merge_key, CASE WHEN p_size > 45 THEN 'high' WHEN p_size > 25 THEN 'medium' ELSE 'low' END AS level FROM part),
        sz AS (SELECT merge_key, 'S' || p_size AS s, min(p_partkey) AS o FROM p GROUP BY ALL),
        sl AS (SELECT merge_key, string_agg(s, ',' ORDER BY o) AS sizes FROM sz GROUP BY merge_key)
        SELECT merge_key, arg_min(p_name, p_partkey) AS p_name, any_value(p_type) AS p_type, any_value(sl.sizes) AS sizes, any_value(p_brand) AS brands, arg_min(level, (CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) * 1000000000 + p_partkey) AS level, min(p_partkey) AS p_partkey
        FROM p JOIN sl USING (merge_key) GROUP BY merge_key""",
    "keyword_profile_match_top4": "WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, {q(p)} AS profile, {_sum(ws, 'lower(text)')} AS hits FROM documents" for p, ws in PROFILES.items()) + """)
        SELECT doc_id, profile, hits, CASE WHEN hits >= 3 THEN 'high' WHEN hits = 2 THEN 'medium' ELSE 'low_to_medium' END AS evidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, profile) AS INTEGER) AS rank FROM m WHERE hits > 0 QUALIFY rank <= 4""",
    "template_expansion": f"""WITH l AS (SELECT DISTINCT doc_id, quality FROM labels), v(vo, variant) AS (VALUES {_VARIANTS}), a(ao, audience) AS (VALUES {_AUDIENCES})
        SELECT 'sft_' || lpad(CAST(row_number() OVER (ORDER BY doc_id, vo, ao) AS VARCHAR), 6, '0') AS row_id, doc_id, variant || ' for ' || audience || ' of ' || doc_id AS prompt FROM l, v, a""",
    "sft_from_log": rf"""WITH p AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        c AS (SELECT conv_id, turn, {squeeze('text')} AS u, regexp_replace(regexp_replace(regexp_replace(regexp_replace(next_text, '^\s+|\s+$', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS a FROM p WHERE role = 'user' AND next_role = 'assistant' AND conv_id % 4 <> 0),
        e AS (SELECT *, CASE WHEN contains(lower({squeeze('a')}), {q(DISCLAIMER_SNIPPET)}) THEN a ELSE a || chr(10) || chr(10) || {q(DISCLAIMER)} END AS r FROM c WHERE u <> '' AND a <> '')
        SELECT 'rag_' || conv_id || '_' || turn AS id, u AS user_text, r AS assistant_text FROM e QUALIFY row_number() OVER (PARTITION BY lower(u), lower({squeeze('r')}) ORDER BY conv_id * 1000 + turn) = 1""",
    "leakage_components": f"""WITH RECURSIVE k AS (SELECT doc_id, 't:' || {stable_hash('text')} AS key FROM documents UNION SELECT doc_id, 'l:' || source || ':' || {stable_hash("split_part(text, chr(10), 1)")} FROM documents WHERE source IS NOT NULL),
        e AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (key)), r AS (SELECT doc_id, doc_id AS id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.id = e.a)
        SELECT doc_id, min(id) AS component FROM r GROUP BY doc_id""",
    "group_split_audit": f"""WITH {_GROUPS}, g AS (SELECT grp, count(DISTINCT split) AS k, bool_or(split = 'train') AS a, bool_or(split = 'valid') AS b, bool_or(split = 'test') AS c FROM rows_ GROUP BY grp),
        t AS (SELECT {stable_hash('text')} AS h, count(DISTINCT split) AS k FROM rows_ WHERE text <> '' GROUP BY 1)
        SELECT count(*) AS total_groups, count(*) FILTER (a) AS train_groups, count(*) FILTER (b) AS valid_groups, count(*) FILTER (c) AS test_groups, count(*) FILTER (k > 1) AS group_leakage_count, (SELECT count(*) FILTER (k > 1) FROM t) AS text_cross_split_duplicate_groups FROM g""",
    "group_split_rows": f"WITH {_GROUPS} SELECT doc_id, split FROM rows_",
    "sequential_ids": "SELECT 'herb_' || lpad(CAST(row_number() OVER (ORDER BY lower(p_name), p_type, p_partkey) AS VARCHAR), 4, '0') AS id, p_partkey FROM part",
    "evidence_rank": """WITH d AS (SELECT source, lang, doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low_to_medium' END AS level FROM documents JOIN labels USING (doc_id))
        SELECT source, lang, arg_min(level, (CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) * 1000000000 + doc_id) AS evidence, count(*) AS n FROM d GROUP BY ALL""",
    "conversation_summary_export": """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'assistant' AND trim(text) LIKE '%?') AS questions, CAST(sum(length(text)) AS BIGINT) AS characters, arg_max(text, turn) FILTER (role = 'user') AS last_user_text FROM conversations GROUP BY conv_id""",
    "candidate_explode_export": """WITH c AS (SELECT conv_id, turn, length(text) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WHERE role = 'assistant')
        SELECT conv_id, 'model_' || turn AS model, round(n / 1000, 4) AS score, turn = first AS selected, CASE WHEN n * 7 < 1000 THEN (n * 7) || ' ms' ELSE ((n * 7 + 5) // 10 // 100) || '.' || lpad(CAST((n * 7 + 5) // 10 % 100 AS VARCHAR), 2, '0') || ' s' END AS latency, 'depth=' || turn || '; length=' || n AS breakdown FROM c""",
    "benchmark_contamination": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''",
    "rolled_up_tokens": f"WITH t AS (SELECT item_id, {tokens('text')} AS t FROM benchmark) SELECT item_id, CAST(len(t) AS INTEGER) AS n, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, array_to_string(list_sort(list_distinct(t)), ' ') AS terms FROM t",
    "reply_cleanup": r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+$', '') || chr(10) || chr(10) || 'x' AS reply FROM conversations WHERE role = 'assistant'""",
    "text_excerpts": rf"""WITH c AS (SELECT doc_id, text, {squeeze('text')} AS c, regexp_replace(text, '^\s+|\s+$', '', 'g') AS h FROM documents)
        SELECT doc_id, CASE WHEN length(c) <= 120 THEN c ELSE regexp_replace(substr(c, 1, 117), ' [^ ]*$', '') || '...' END AS excerpt, CASE WHEN length(c) <= 90 THEN c ELSE rtrim(substr(c, 1, 87)) || '...' END AS hard,
            CASE WHEN length(c) <= 50 THEN c ELSE regexp_replace(substr(c, 1, 50), ' [^ ]*$', '') END AS limited, lower(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_:-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
            CASE WHEN h = '' OR regexp_matches(h, '[.!?]$') THEN h ELSE h || '.' END AS sentence FROM c""",
    "legacy_merge": """SELECT s.s_suppkey AS id, coalesce(CASE WHEN s.s_suppkey % 3 > 0 THEN s.s_name END, c.c_name) AS name, c.c_mktsegment AS segment FROM supplier s LEFT JOIN customer c ON s.s_suppkey = c.c_custkey
        UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "override_join": r"""WITH o AS (SELECT p_name AS key, 'n' || p_partkey AS steps, p_partkey AS ord FROM part WHERE p_size <= 10 UNION ALL SELECT p_type, 't' || p_partkey, p_partkey FROM part WHERE p_size = 20 AND p_type = 'SMALL'),
        t AS (SELECT regexp_replace(lower(key), '[^a-z0-9]+', '_', 'g') AS k, arg_max(steps, ord) AS v FROM o GROUP BY 1)
        SELECT p_partkey, coalesce(a.v, b.v, 'standard') AS steps FROM part LEFT JOIN t a ON regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') = a.k LEFT JOIN t b ON regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') = b.k""",
    "source_collect_order": """WITH k AS (SELECT n_nationkey AS id, unnest([(n_regionkey + 2) % 5, n_regionkey, (n_regionkey + 1) % 5]) AS key, unnest([0, 1, 2]) AS pos FROM nation)
        SELECT id, string_agg(r_name, '|' ORDER BY pos) AS titles, string_agg('u' || r_regionkey, '|' ORDER BY pos) AS urls FROM k JOIN region ON key = r_regionkey GROUP BY id""",
    "candidate_best_per_request": f"WITH {_CANDIDATES} SELECT request, model, score, event_id FROM won WHERE won",
    "value_counts_manifest": "SELECT 'lang:' || lang AS name, count(*) AS n FROM documents GROUP BY lang " + " ".join(f"UNION ALL SELECT {q(t)}, count(*) FROM {t}" for t in ("documents", "labels", "benchmark", "pages")),
    "keyword_evidence": f"SELECT doc_id, {any_of('lower(text)', ('license', 'rights'))} AS notice, regexp_full_match(text, '[\\x00-\\x7F]*') AS ascii, regexp_matches(text, '(?i)PubMed|NCCIH|WHO|Cochrane|systematic review|clinical trial') AS cited, {any_of('lower(text)', ('the ', 'der '))} AS excluded FROM documents",
    "template_rotation": f"""WITH l AS (SELECT DISTINCT doc_id FROM labels), v AS (SELECT doc_id, [{", ".join(q(x) for x in VARIANTS)}] AS a, CAST(doc_id % {len(VARIANTS)} AS INTEGER) AS k FROM l)
        SELECT doc_id, array_to_string(list_concat(a[k + 1:], a[1:k]), ',') AS rotated, a[k + 1] AS picked FROM v""",
    "conversation_features": f"""WITH {_marked(_RUNNING)}, f AS (SELECT sn.conv_id, sn.turn, n, red_flags, present, absent, {_duration()} AS duration_text, {_CLEARED} AS cleared FROM sn LEFT JOIN rf USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn))
        SELECT conv_id, turn, coalesce(red_flags, '') AS red_flags, coalesce(present, '') AS present, coalesce(absent, '') AS absent, duration_text, duration_text IS NOT NULL OR {any_of('n', DEFAULT.duration_words)} AS has_duration_signal, cleared AS has_safety_clearance_signal,
            concat_ws('|', {_lines('gejala disebut ada: ', 'present')}, {_lines('gejala disebut tidak ada: ', 'absent')}, 'durasi sudah disebut: ' || duration_text, {_lines('tanda bahaya terdeteksi: ', 'red_flags')}, CASE WHEN cleared THEN 'sebagian tanda bahaya sudah disangkal user' END) AS answered FROM f""",
    "turn_capture_stream": f"SELECT conv_id, count(*) AS turns, CAST(sum(length({norm('text')})) AS BIGINT) AS characters, count(*) FILTER (role = 'assistant') AS pending FROM conversations GROUP BY conv_id",
    "session_state_stream": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant' AND trim(text) LIKE '%?') AS questions, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant' AND trim(text) LIKE '%?') >= 3 AS completed FROM conversations GROUP BY conv_id",
}
