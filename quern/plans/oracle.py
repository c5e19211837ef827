"""DuckDB SQL that equals the registered queries, built from the engine's fixed tables but from no expression of it."""

from __future__ import annotations

from quern.functions import stem, text
from quern.operators.answer import DISCOURSE_STEMS
from quern.operators.hashing import GRAM, GRAM_TOKEN, MOST_GRAM_TOKENS
from quern.operators.prompts import INSTRUCTIONS


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(e: str) -> str:
    out = f"translate(coalesce({e}, ''), {_lit(''.join(text.FOLD_SINGLE) + text.FOLD_REMOVED)}, {_lit(''.join(text.FOLD_SINGLE.values()))})"
    for a, b in text.FOLD_LONG.items():
        out = f"replace({out}, {_lit(a)}, {_lit(b)})"
    return out


def tok(e: str) -> str:
    found = f"list_transform(regexp_extract_all({fold(e)}, {_lit(text.TOKEN)}), lambda t: lower(t))"
    other = f"list_transform(list_filter(regexp_split_to_array({fold(e)}, '[^\\pL\\pN_]+'), lambda t: t <> ''), lambda t: lower(t))"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE {other} END"


STOPS = "[" + ", ".join(map(_lit, text.STOP_WORDS)) + "]"


def content(e: str) -> str:
    return f"list_filter({tok(e)}, lambda t: length(t) > 1 AND NOT list_contains({STOPS}, t))"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({e}, ''), '\\s+'), lambda w: w <> '')"


def word_cost(w: str) -> str:
    bare = f"trim({w}, {_lit(text.WORD_MARKS)})"
    return f"(1 + greatest(greatest(length({bare}), 1) - 4, 0) // 4 + CASE WHEN length({w}) > length({bare}) THEN 1 ELSE 0 END)"


def estimate(e: str) -> str:
    return f"CASE WHEN coalesce({e}, '') = '' THEN 0 ELSE greatest(1, coalesce(list_sum(list_transform({words(e)}, lambda w: {word_cost('w')})), 0) + (length({e}) - length(replace({e}, chr(10), ''))) // 2) END"


def clean(e: str) -> str:
    out = f"regexp_replace({fold(e)}, '\\r\\n?', chr(10), 'g')"
    for pattern, to in (("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "' '"), ("([\\pL\\pN_])-\\n([\\pL\\pN_])", "'\\1\\2'"), ("[ \\t\\f\\r]+", "' '"), ("[ \\t]+\\n", "chr(10)"), ("\\n{3,}", "chr(10)||chr(10)"), ("^\\s+|\\s+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return out


def raw_sentences(e: str) -> str:
    marked = f"""regexp_replace(replace(coalesce({e}, ''), chr(10), ' '), '([.!?])["'')\\]]*\\s+(["''(\\[]*[A-Z0-9])', '\\1' || chr(31) || '\\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: trim(s)), lambda s: s <> '')"


def stems(source: str, name: str = "vocab") -> str:
    """CTEs that end in ``name`` (token, stem) over the tokens of a table ``source`` (token)."""
    m = lambda e, p: f"regexp_matches({e}, {_lit(p)})"
    cut = lambda n: f"left(w, greatest(length(w) - {n}, 0))"
    ends = lambda s: f"ends_with(w, {_lit(s)})"
    b = cut(1)
    steps = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {m(cut(3), stem.SOME)} THEN {cut(1)} ELSE w END WHEN {ends('ed')} AND {m(cut(2), stem.VOWEL)} THEN {cut(2)} || '|' WHEN {ends('ing')} AND {m(cut(3), stem.VOWEL)} THEN {cut(3)} || '|' ELSE w END",
        f"CASE WHEN NOT {ends('|')} THEN w WHEN {m(b, '(at|bl|iz)$')} THEN {b} || 'e' WHEN {m(b, '[^aeiouy]$')} AND length({b}) > 1 AND right({b}, 1) = left(right({b}, 2), 1) AND NOT {m(b, '[lsz]$')} THEN {cut(2)}"
        f" WHEN {m(b, stem.ONE)} AND {m(b, stem.SHORT)} THEN {b} || 'e' ELSE {b} END",
        f"CASE WHEN {ends('y')} AND {m(b, stem.VOWEL)} THEN {b} || 'i' ELSE w END",
    ]
    for table in (stem.STEP2, stem.STEP3):
        steps.append("CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(cut(len(s)), stem.SOME)} THEN {cut(len(s))} || {_lit(to)} ELSE w END" for s, to in table) + " ELSE w END")
    steps.append("CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(cut(len(s)), stem.MORE)} THEN {cut(len(s))} ELSE w END" for s in sorted(stem.STEP4, key=len, reverse=True)) + " ELSE w END")
    steps.append(f"CASE WHEN {ends('e')} AND ({m(b, stem.MORE)} OR ({m(b, stem.ONE)} AND NOT {m(b, stem.SHORT)})) THEN {b} ELSE w END")
    steps.append(f"CASE WHEN {ends('ll')} AND {m('w', stem.MORE)} THEN {b} ELSE w END")
    steps.append(f"CASE WHEN {ends('i')} AND NOT {m(b, stem.VOWEL)} THEN {b} || 'y' ELSE w END")
    ctes = [f"{name}_0 AS (SELECT token, CASE WHEN starts_with(token, 'y') THEN 'Y' || substr(token, 2) ELSE token END AS w FROM (SELECT DISTINCT token FROM {source}))"]
    for i, s in enumerate(steps):
        ctes.append(f"{name}_{i + 1} AS (SELECT token, {s} AS w FROM {name}_{i})")
    ctes.append(f"{name} AS MATERIALIZED (SELECT token, CASE WHEN length(token) > 3 AND regexp_matches(token, '^\\pL+$') THEN CASE WHEN starts_with(w, 'Y') THEN 'y' || substr(w, 2) ELSE w END ELSE token END AS stem FROM {name}_{len(steps)})")
    return ", ".join(ctes)


HEAD = f"array_to_string(list_slice({words('text')}, 1, 8), ' ')"
CLAIM = "translate(text, '.!?', '   ')"
Q = "SELECT CAST(item_id AS VARCHAR) AS qid, text AS question FROM benchmark"


def _index(stemmed: bool, contents: bool) -> str:
    of = content if contents else tok
    parts = [f"dt AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({of('text')}) AS token FROM documents)", f"qt AS MATERIALIZED (SELECT qid, unnest({of('question')}) AS token FROM ({Q}))", f"allt AS (SELECT token FROM dt UNION SELECT token FROM qt UNION SELECT unnest({of('left(text, 4000)')}) FROM documents UNION SELECT unnest({tok(HEAD)}) FROM documents UNION SELECT unnest({of(CLAIM)}) FROM benchmark)"]
    if stemmed:
        parts.append(stems("allt"))
    else:
        parts.append("vocab AS (SELECT token, token AS stem FROM allt)")
    parts += [
        "post AS MATERIALIZED (SELECT stem AS term, id, count(*) AS tf FROM dt JOIN vocab USING (token) GROUP BY ALL)",
        "dls AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY id)",
        "dl AS MATERIALIZED (SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(dl, 0) AS dl FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN dls ON dls.id = CAST(d.doc_id AS VARCHAR))",
        "qterms AS MATERIALIZED (SELECT DISTINCT qid, stem AS term FROM qt JOIN vocab USING (token))",
        "df AS (SELECT term, count(*) AS df FROM post GROUP BY term)",
    ]
    return ", ".join(parts)


def _scored(name: str, idf: str = "bm25", where: str = "TRUE", k: int = 10) -> str:
    raw = "ln(1 + (n - df + 0.5) / (df + 0.5))" if idf == "bm25" else "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END"
    return (
        f"{name}_s AS (SELECT qid, post.id, round_even(sum({raw} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM qterms JOIN df USING (term) JOIN post USING (term) JOIN dl ON dl.id = post.id, "
        f"(SELECT count(*) AS n, avg(dl) AS mean FROM dl) WHERE {where} GROUP BY ALL), "
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"
    )


def _fusion(method: str) -> str:
    lists = "lists AS (SELECT 'dense' AS r, 0.65 AS w, * FROM b UNION ALL SELECT 'keyword', 0.35, * FROM a)"
    if method == "rrf":
        part = "w / (60 + rank)"
    else:
        part = "w * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END"
    return f"{lists}, bounds AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM lists WINDOW p AS (PARTITION BY r, qid)), sums AS (SELECT qid, id, round_even(sum({part}), 6) AS score FROM bounds GROUP BY ALL), fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sums)"


_STEMMED = _index(True, True)
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * x)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"
_COS = f"round_even(greatest(-1, least(1, {_DOT.format('q.embedding', 'c.embedding')} / ({_NORM.format('q.embedding')} * {_NORM.format('c.embedding')}))), 6)"
#: Nearest documents to the vector with a benchmark item's number.
_NEAR = (
    "dv AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)), "
    f"b_s AS (SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(c.vec_id AS VARCHAR) AS id, {_COS} AS score FROM dv q, dv c WHERE q.vec_id IN (SELECT item_id FROM benchmark)), "
    "b AS MATERIALIZED (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b_s) WHERE rank <= 10)"
)
_LISTS = f"WITH {_STEMMED}, {_scored('a')}, {_NEAR}"
_TOPK = "SELECT qid, id, score, CAST(rank AS BIGINT) AS rank FROM "



def _terms(body: str) -> str:
    """Ordered stems of queries, and of what a reranker reads of the candidates of list a (or all of them)."""
    return (
        f"qpos AS (SELECT qid, pos, stem FROM (SELECT qid, unnest({content('question')}) AS token, generate_subscripts({content('question')}, 1) AS pos FROM ({Q})) JOIN vocab USING (token)), "
        "ql AS (SELECT qid, list(stem ORDER BY pos) AS q FROM qpos GROUP BY qid), "
        f"ppos AS (SELECT id, pos, stem FROM (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({content(body)}) AS token, generate_subscripts({content(body)}, 1) AS pos FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT id FROM a)) JOIN vocab USING (token)), "
        "pl AS (SELECT id, list(stem ORDER BY pos) AS p FROM ppos GROUP BY id), "
        f"hl AS (SELECT id, list(DISTINCT stem) AS h FROM (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({tok(HEAD)}) AS token FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT id FROM a)) JOIN vocab USING (token) GROUP BY id), "
        "pairs AS MATERIALIZED (SELECT a.*, ql.q, coalesce(pl.p, []) AS p, coalesce(hl.h, []) AS h FROM a JOIN ql USING (qid) LEFT JOIN pl USING (id) LEFT JOIN hl USING (id))"
    )


_TERMS, _WHOLE = _terms("left(text, 4000)"), _terms("text")
_BIGRAMS = lambda x: f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
_COVERAGE = "CASE WHEN len(q) = 0 THEN 0 ELSE round_even(len(list_intersect(list_distinct(q), p)) / len(list_distinct(q)), 4) END"
_HEADING_OVERLAP = "CASE WHEN len(q) = 0 THEN 0 ELSE round_even(len(list_intersect(list_distinct(q), h)) / len(list_distinct(q)), 4) END"
_PHRASE = f"CASE WHEN len(q) < 2 THEN 0 ELSE round_even(len(list_intersect({_BIGRAMS('q')}, {_BIGRAMS('p')})) / len({_BIGRAMS('q')}), 4) END"
#: The narrowest span: for each matched position, the least of the last positions of all matched terms.
_PROXIMITY = (
    "mt AS (SELECT qid, id, unnest(list_intersect(list_distinct(q), p)) AS t FROM pairs), "
    "occ AS (SELECT pairs.qid, pairs.id, i AS pos, p[i] AS t FROM pairs, unnest(range(1, len(p) + 1)) AS r(i) WHERE list_contains(q, p[i])), "
    "ends AS (SELECT DISTINCT qid, id, pos FROM occ), "
    "lastp AS (SELECT ends.qid, ends.id, ends.pos, mt.t, max(occ.pos) AS lp FROM ends JOIN mt USING (qid, id) LEFT JOIN occ ON occ.qid = ends.qid AND occ.id = ends.id AND occ.t = mt.t AND occ.pos <= ends.pos GROUP BY ALL), "
    "spans AS (SELECT qid, id, pos, CASE WHEN count(lp) = count(*) THEN pos - min(lp) + 1 END AS span FROM lastp GROUP BY qid, id, pos), "
    "best AS (SELECT qid, id, min(span) AS best FROM spans GROUP BY ALL), "
    "prox AS (SELECT pairs.qid, pairs.id, len(list_intersect(list_distinct(q), p)) AS n, best FROM pairs LEFT JOIN best USING (qid, id)), "
    "proximity AS (SELECT qid, id, CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 0.5 WHEN best <= n THEN 1.0 WHEN best >= 60 THEN 0.0 ELSE round_even(1 - (best - n) / (60.0 - n)::DOUBLE, 4) END AS proximity FROM prox)"
)
_RERANK = (
    f"{_LISTS}, {_TERMS}, {_PROXIMITY}, sig AS (SELECT pairs.qid, pairs.id, rank, {_COVERAGE} AS coverage, {_PHRASE} AS phrase, {_HEADING_OVERLAP} AS heading, proximity.proximity, 10.0 / (9 + rank) AS prior FROM pairs JOIN proximity ON proximity.qid = pairs.qid AND proximity.id = pairs.id), "
    "re AS (SELECT *, round_even(0.40 * coverage + 0.20 * proximity + 0.10 * phrase + 0.05 * heading + 0.25 * prior, 6) AS rerank_score FROM sig), "
    "rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank, id) AS new_rank FROM re)"
)
def _dense(where: str = "TRUE") -> str:
    return (
        f"WITH s AS (SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(c.vec_id AS VARCHAR) AS id, {_COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND {where}), "
        "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10) "
    )


_GRAMS = lambda e: f"list_distinct(list_transform(range(1, len({e}) - 6), lambda i: array_to_string(list_slice({e}, i, i + 7), ' ')))"
_SUPPORT = (
    f"{_LISTS}, {_WHOLE}, ct AS (SELECT qid, list(DISTINCT stem) AS s FROM (SELECT CAST(item_id AS VARCHAR) AS qid, unnest({content(CLAIM)}) AS token FROM benchmark) JOIN vocab USING (token) GROUP BY qid), "
    "sup AS (SELECT ct.qid, rank, s, coalesce(len(list_intersect(s, p)) / len(s), 0) AS overlap FROM ct LEFT JOIN pairs USING (qid)), "
    "bestm AS (SELECT qid, any_value(s) AS s, max(overlap) AS best, min_by(rank, (-overlap, rank)) AS m, max(CASE WHEN rank = 1 THEN overlap END) AS cited FROM sup GROUP BY qid), "
    f"judged AS (SELECT *, len(list_filter(s, lambda t: NOT list_contains([{', '.join(map(_lit, DISCOURSE_STEMS))}], t))) > 0 AS claim FROM bestm)"
)
_MARKED = "coalesce(text, '') || ' Both agree [1, 3], see [2][1] .'"
_MARKERS = f"regexp_extract_all({_MARKED}, '\\[\\s*(\\d{{1,3}}(?:\\s*[,;]\\s*\\d{{1,3}})*)\\s*\\]')"


def _tidy(e: str) -> str:
    for pattern, to in (("[ \\t]{2,}", "' '"), ("[ \\t]+([.,;:!?)\\]])", "'\\1'"), ("([(\\[])[ \\t]+", "'\\1'"), ("(?m)^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$", "''"), ("^\\s+|\\s+$", "''")):
        e = f"regexp_replace({e}, '{pattern}', {to}, 'g')"
    return e


def _redacted(e: str) -> str:
    for pattern, to in text.CREDENTIALS:
        e = f"regexp_replace({e}, {_lit(pattern)}, {_lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return e


def _truncated(limit: int) -> str:
    return (
        f"WITH w AS (SELECT doc_id, text, unnest({words('text')}) AS w, generate_subscripts({words('text')}, 1) AS pos FROM documents), "
        f"c AS (SELECT doc_id, w, pos, sum({word_cost('w')}) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM w), "
        f"t AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM c WHERE n <= {limit} GROUP BY doc_id) "
        f"SELECT documents.doc_id, md5(CASE WHEN {estimate('text')} <= {limit} THEN coalesce(text, '') ELSE coalesce(t, '') END) AS digest FROM documents LEFT JOIN t USING (doc_id)"
    )


_HEADING = (
    "length(line) BETWEEN 1 AND 110 AND n BETWEEN 1 AND 14 AND NOT (regexp_matches(line, '[.,;:]$') AND NOT numbered) AND "
    "((numbered AND n_rest <= 12 AND regexp_matches(rest, '^\\p{Lu}')) OR (letters <> '' AND NOT regexp_matches(letters, '[^\\p{Lu}]') AND n <= 10) OR (titled >= greatest(2, CAST(floor(0.7 * n) AS INT)) AND NOT ends_with(line, '.')))"
)

#: (doc_id, family, f, n): the features of hash vectors.
_FEATURES = (
    f"WITH t AS (SELECT doc_id, {tok('text')} AS k FROM documents), x AS (SELECT doc_id, unnest(k) AS token, generate_subscripts(k, 1) AS pos FROM t), {stems('x')}, s AS (SELECT doc_id, pos, token, stem FROM x JOIN vocab USING (token)), "
    f"w AS (SELECT doc_id, CASE WHEN list_contains({STOPS}, token) THEN 's' ELSE 'w' END AS family, stem AS f FROM s), b AS (SELECT doc_id, 'b' AS family, stem || ' ' || lead(stem) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM s), "
    f"l AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM x WHERE length(token) >= {GRAM_TOKEN} AND NOT list_contains({STOPS}, token)), c AS (SELECT doc_id, 'c' AS family, unnest(list_transform(range(1, length(token) + 3 - {GRAM} + 1), lambda i: substr('^' || token || '$', i, {GRAM}))) AS f FROM l WHERE n <= {MOST_GRAM_TOKENS}), "
    "fc AS (SELECT doc_id, family, f, count(*) AS n FROM (SELECT * FROM w UNION ALL SELECT * FROM b WHERE f IS NOT NULL UNION ALL SELECT * FROM c) GROUP BY ALL)"
)
# hash_features takes the runs of all long words.
_WHOLE_FEATURES = _FEATURES.replace(f" WHERE n <= {MOST_GRAM_TOKENS}", "")

SQL: dict[str, str] = {
    "token_stats": f"SELECT doc_id, len({tok('text')}) AS n_tokens, len(list_distinct({tok('text')})) AS n_distinct FROM documents",
    "content_token_stats": f"SELECT doc_id, len({content('text')}) AS n_content, len(list_distinct({content('text')})) AS n_distinct FROM documents",
    "token_estimate": f"SELECT doc_id, CAST({estimate('text')} AS BIGINT) AS tokens FROM documents",
    "truncate_to_tokens": _truncated(100),
    "clean_text_fingerprint": f"SELECT doc_id, md5({clean('text')}) AS digest, length({clean('text')}) AS n FROM documents",
    "stem_vocab": f"WITH t AS (SELECT unnest({tok('text')}) AS token FROM documents), {stems('t')} SELECT token, stem FROM vocab",
    "doc_text_stats": f"SELECT doc_id, length(text) AS n_chars, len({words('text')}) AS n_words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '\\s', '', 'g') <> '')) AS n_paragraphs FROM documents",
    "source_rollup": "SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(length(text)) AS least, max(length(text)) AS most, round_even(avg(length(text)), 4) AS mean FROM documents GROUP BY source",
    "snippets": f"SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE regexp_replace(CASE WHEN contains(h, ' ') AND 240 - instr(reverse(h), ' ') > 120 THEN left(h, 240 - instr(reverse(h), ' ')) ELSE h END, '[ ,;:.]+$', '') || '...' END AS snippet FROM (SELECT doc_id, array_to_string({words('text')}, ' ') AS f, left(array_to_string({words('text')}, ' '), 240) AS h FROM documents)",
    "slugs": "SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS s FROM documents)",
    "legibility": "SELECT doc_id, round_even(CASE WHEN text = '' THEN 0 ELSE length(regexp_replace(left(text, 8000), '[^\\pL\\pN\\s\\x{85}\\x{a0}.,;:!?''\"()%/\\-]', '', 'g')) / length(left(text, 8000)) END, 6) AS share FROM documents",
    "page_furniture": f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, {_lit(text.FURNITURE)}))) AS n_kept FROM documents",
    "sentence_stats": f"SELECT doc_id, len({raw_sentences('text')}) AS n_sentences, md5(array_to_string({raw_sentences('text')}, chr(10))) AS digest FROM documents",
    "heading_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), f AS (SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS n, regexp_matches(line, '^\\s*(\\d{1,2}(?:\\.\\d{1,2}){0,3})[.)]?\\s+(\\S.*)$') AS numbered, regexp_extract(line, '^\\s*(\\d{1,2}(?:\\.\\d{1,2}){0,3})[.)]?\\s+(\\S.*)$', 2) AS rest, regexp_replace(line, '[^\\pL]', '', 'g') AS letters, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}'))) AS titled FROM l), g AS (SELECT *, len(list_filter(regexp_split_to_array(rest, '\\s+'), lambda w: w <> '')) AS n_rest FROM f) "
    f"SELECT doc_id, CAST(pos - 1 AS INTEGER) AS line_no, line FROM g WHERE {_HEADING}",
    "front_matter": "SELECT doc_id, source AS title, lang AS language, md5(text) AS body FROM documents",
    "upload_names": "SELECT doc_id, CAST(doc_id % 7 AS VARCHAR) || '.' || ['pdf', 'docx', 'txt', 'md', 'exe', 'html', 'csv'][doc_id % 7 + 1] AS name, ['pdf', 'docx', 'txt', 'md', 'exe', 'html', 'csv'][doc_id % 7 + 1] AS extension, doc_id % 7 < 4 AS allowed, CASE WHEN doc_id % 7 < 4 THEN '' WHEN doc_id % 7 < 6 THEN 'blocked extension' ELSE 'unknown extension' END AS reason FROM documents",
    "human_sizes": "SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b * 10 / 1024.0 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(b * 10 / 1048576.0 + 0.5) / 10) || ' MB' END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)",
    "redact_text": f"SELECT doc_id, md5({_redacted('text')}) AS digest, {_redacted('text')} <> text AS changed FROM documents",
    "term_df": f"WITH {_STEMMED} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "index_stats": f"WITH {_STEMMED} SELECT (SELECT count(*) FROM dl) AS documents, (SELECT count(DISTINCT term) FROM post) AS terms, (SELECT round_even(avg(dl), 4) FROM dl) AS mean_length",
    "bm25_topk_raw": f"WITH {_index(False, False)}, {_scored('a')} {_TOPK} a",
    "bm25_topk": f"WITH {_STEMMED}, {_scored('a')} {_TOPK} a",
    "fts_topk": f"WITH {_STEMMED}, {_scored('a', 'textbook')} {_TOPK} a",
    "bm25_filtered": f"WITH {_STEMMED}, {_scored('a', where='post.id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)')} {_TOPK} a",
    "dense_topk": _dense() + "SELECT qid, id, score, CAST(rank AS BIGINT) AS rank FROM d",
    "dense_filtered": _dense("c.label IN (1, 2)") + "SELECT qid, id, score, CAST(rank AS BIGINT) AS rank FROM d",
    "ann_lsh": _dense() + "SELECT qid, id, score, CAST(rank AS BIGINT) AS rank FROM d",
    "vector_norms": f"SELECT vec_id, round_even({_NORM.format('embedding')}, 6) AS norm FROM embeddings",
    "similarity_bands": _dense() + "SELECT qid, id, (score + 1) / 2 AS confidence, CASE WHEN score >= 0.55 THEN 'strong' WHEN score >= 0.28 THEN 'moderate' ELSE 'weak' END AS band FROM d",
    "evidence_gate": _dense() + "SELECT qid, count(*) AS n_hits, max(score) AS top_score, CASE WHEN max(score) < 0.16 THEN 'weak_match' ELSE 'ok' END AS status FROM d WHERE qid <> id GROUP BY qid",
    "rrf_fusion": f"{_LISTS}, {_fusion('rrf')} SELECT qid, id, score, rank FROM fused WHERE rank <= 40",
    "weighted_fusion": f"{_LISTS}, {_fusion('weighted')} SELECT qid, id, score, rank FROM fused WHERE rank <= 40",
    "document_cap": f"{_LISTS}, {_fusion('rrf')}, c AS (SELECT qid, id, source, rank, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS n FROM fused JOIN documents ON id = CAST(doc_id AS VARCHAR) WHERE rank <= 40) SELECT qid, id, source, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM c WHERE n <= 1",
    "fusion_diagnostics": f"{_LISTS}, {_fusion('rrf')} SELECT qid, (SELECT count(*) FROM a WHERE a.qid = q.qid) AS n_keyword, (SELECT count(*) FROM b WHERE b.qid = q.qid) AS n_dense, (SELECT count(*) FROM fused WHERE fused.qid = q.qid AND rank <= 40) AS n_fused, CASE WHEN (SELECT count(*) FROM fused WHERE fused.qid = q.qid) = 0 THEN 'no candidates' ELSE '' END AS note FROM ({Q}) q",
    "term_coverage": f"{_LISTS}, {_TERMS} SELECT qid, id, {_COVERAGE} AS coverage FROM pairs",
    "phrase_overlap": f"{_LISTS}, {_TERMS} SELECT qid, id, {_PHRASE} AS phrase FROM pairs",
    "proximity": f"{_LISTS}, {_TERMS}, {_PROXIMITY} SELECT qid, id, proximity FROM proximity",
    "heuristic_rerank": f"{_RERANK} SELECT qid, id, rerank_score, new_rank, rank - new_rank AS movement FROM rr WHERE new_rank <= 6",
    "heading_overlap": f"{_LISTS}, {_TERMS} SELECT qid, id, {_HEADING_OVERLAP} AS heading_overlap FROM pairs",
    "jaccard_pairs": f"{_LISTS}, {_WHOLE} SELECT qid, id, round_even(len(list_intersect(list_distinct(q), p)) / (len(list_distinct(q)) + len(list_distinct(p)) - len(list_intersect(list_distinct(q), p))), 6) AS jaccard, round_even(len(list_intersect(list_distinct(q), p)) / len(list_distinct(q)), 6) AS containment FROM pairs",
    "support_check": f"{_SUPPORT} SELECT qid, claim AS is_claim, CAST(CASE WHEN best > 0 THEN m END AS INTEGER) AS best_marker, round_even(best, 6) AS best_score, round_even(cited, 6) AS cited_score, NOT claim OR coalesce(cited >= 0.32, FALSE) AS supported, coalesce(claim AND best - cited >= 0.25, FALSE) AS misattributed FROM judged",
    "groundedness": f"{_SUPPORT} SELECT qid, CAST(claim AS BIGINT) AS n_claims, CAST(claim AND coalesce(cited >= 0.32, FALSE) AS BIGINT) AS n_supported, CASE WHEN claim THEN CAST(coalesce(cited >= 0.32, FALSE) AS DOUBLE) ELSE 1.0 END AS groundedness, claim AND best <= 0 AS advises_refusal FROM judged",
    "recall_mrr": f"{_LISTS}, dg AS (SELECT id, unnest({_GRAMS('t')}) AS g FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {tok('text')} AS t FROM documents)), qg AS (SELECT qid, unnest({_GRAMS('t')}) AS g FROM (SELECT qid, {tok('question')} AS t FROM ({Q}))), rel AS (SELECT DISTINCT qid, id FROM qg JOIN dg USING (g)), nrel AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid), "
    "hit AS (SELECT a.qid, rank FROM a JOIN rel ON rel.qid = a.qid AND rel.id = a.id) SELECT q.qid, coalesce(n, 0) AS n_relevant, CASE WHEN n IS NULL THEN 1.0 ELSE round_even((SELECT count(*) FROM hit WHERE hit.qid = q.qid) / n, 6) END AS recall, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(round_even(1.0 / (SELECT min(rank) FROM hit WHERE hit.qid = q.qid), 6), 0) END AS reciprocal_rank "
    f"FROM ({Q}) q LEFT JOIN nrel ON nrel.qid = q.qid",
    "history_window": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IN ('user', 'assistant')) WHERE b <= 6",
    "conversation_counts": "SELECT conv_id, count(role) AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id",
    "documents_page": "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20",
    "marker_counts": f"SELECT doc_id, CAST(m AS INTEGER) AS marker, count(*) AS n FROM (SELECT doc_id, unnest(flatten(list_transform({_MARKERS}, lambda g: regexp_extract_all(g, '\\d+')))) AS m FROM documents) GROUP BY ALL",
    "strip_markers": "SELECT doc_id, md5(" + _tidy(f"regexp_replace({_MARKED}, '\\[\\s*(\\d{{1,3}}(?:\\s*[,;]\\s*\\d{{1,3}})*)\\s*\\]', '', 'g')") + ") AS digest FROM documents",
    "hash_features": f"{_WHOLE_FEATURES} SELECT doc_id, family, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n FROM fc GROUP BY ALL",
    "explain_vector": _FEATURES.replace("doc_id", "qid").replace("FROM documents)", f"FROM (SELECT qid, question AS text FROM ({Q})))")
    + " SELECT qid, family || ':' || f AS feature, round_even(w, 6) AS weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY w DESC, family || ':' || f) AS INTEGER) AS place FROM (SELECT *, CASE family WHEN 'w' THEN 1.0 WHEN 's' THEN 0.25 WHEN 'b' THEN 0.6 ELSE 0.35 END * (1 + ln(n)) AS w FROM fc)) WHERE place <= 12",
    "upsert_latest": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    "orphan_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "delete_by_filter": "SELECT doc_id, lang FROM documents WHERE NOT (lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3'))",
    "cascade_delete": "SELECT doc_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "update_by_key": "SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'low' ELSE d.source END AS source, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)",
    "fetch_by_ids": "SELECT item_id AS pos, doc_id, lang FROM benchmark JOIN documents ON doc_id = item_id * 7",
    "document_titles": "SELECT l.doc_id AS document_id, coalesce(CASE WHEN d.source = 'src0' THEN NULL ELSE d.source END, CAST(l.doc_id AS VARCHAR)) AS title FROM labels l LEFT JOIN documents d USING (doc_id)",
    "repeated_lines": "WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS a FROM documents GROUP BY source), c AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE length(line) BETWEEN 3 AND 120 GROUP BY ALL) SELECT source, line, pages FROM c JOIN n USING (source) WHERE a >= 3 AND pages >= greatest(3, round_even(a * 0.05, 0))",
    "min_max_scores": f"{_LISTS}, m AS (SELECT qid, id, score, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM a) SELECT qid, id, round_even(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS normalised FROM m",
    "dense_levels": "SELECT source AS document_id, doc_id, quality * 4 + toxic * 2 AS level, dense_rank() OVER (PARTITION BY source ORDER BY quality * 4 + toxic * 2) AS dense_level FROM labels JOIN documents USING (doc_id)",
    "json_payload": "SELECT doc_id, source, lang FROM documents",
    "tenant_scope": "SELECT doc_id, source FROM documents WHERE source = 'src1'",
    "delete_before": "SELECT conv_id, turn, role FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE conv_id % 2 <> 0 OR turn >= last - 1",
    "vector_records": """SELECT doc_id || ':0' AS id, '{"document_id":"' || doc_id || '","chunk_index":"0","heading":"' || source || '","token_count":"' || n_chars || '","user_id":"7"}' AS payload, len(embedding) AS width FROM documents JOIN embeddings ON vec_id = doc_id""",
    "sync_records": "SELECT vec_id || ':0' AS id, 'kept' AS state FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id || ':0', 'missing' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "matched_terms": f"WITH {_STEMMED}, {_scored('a')}, qw AS (SELECT qid, stem AS term, min(token) AS word FROM qt JOIN vocab USING (token) GROUP BY ALL) SELECT a.qid, a.id, string_agg(DISTINCT word, ' ' ORDER BY word) AS terms FROM a JOIN qw ON qw.qid = a.qid JOIN post ON post.term = qw.term AND post.id = a.id GROUP BY ALL",
    "prompt_messages": f"WITH h AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')), p AS (SELECT conv_id, count(*) AS n, string_agg(CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn) AS past FROM h WHERE back <= 6 GROUP BY conv_id) "
    f"SELECT CAST(item_id AS VARCHAR) AS qid, 2 + coalesce(n, 0) AS n_messages, md5({_lit(INSTRUCTIONS)} || chr(10) || chr(10) || coalesce(past, '') || 'Passages:' || chr(10) || chr(10) || trim(text) || chr(10) || chr(10) || 'Question: ' || trim(text)) AS digest FROM benchmark LEFT JOIN p ON conv_id = item_id",
    "document_stats": f"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents) SELECT CAST(doc_id AS VARCHAR) AS document_id, len(p) AS n_blocks, 0 AS n_headings, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS n_chars, CAST(coalesce(list_sum(list_transform(p, lambda x: len({words('x')}))), 0) AS BIGINT) AS n_words FROM p",
}
