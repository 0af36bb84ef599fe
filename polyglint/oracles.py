"""DuckDB SQL for the queries of queries.py."""

from __future__ import annotations

from .queries import SAMPLES

#: The rules once more, in this module's own words, so that the SQL does not repeat a slip of the engine's tables.
#: White space, families of scripts with their code points, and what each leads to.
SPACE = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
CLASSES = {
    "korean": "\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}",
    "georgian": "\\x{10A0}-\\x{10FF}\\x{2D00}-\\x{2D2F}",
    "armenian": "\\x{0530}-\\x{058F}",
    "bengali": "\\x{0980}-\\x{09FF}",
    "greek": "\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}",
    "hebrew": "\\x{0590}-\\x{05FF}",
    "cjk_kana": "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}",
    "cjk_han": "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}",
    "cyrillic": "\\x{0400}-\\x{04FF}",
    "arabic": "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}",
    "devanagari": "\\x{0900}-\\x{097F}",
    "latin": "A-Za-z\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}",
}
ONE_LANGUAGE = {"korean": "kor", "georgian": "kat", "armenian": "hye", "bengali": "ben", "greek": "ell", "hebrew": "heb"}
ONLY_IN = {
    "srp": "\\x{0402}\\x{0452}\\x{040B}\\x{045B}", "mkd": "\\x{0403}\\x{0453}\\x{040C}\\x{045C}\\x{0405}\\x{0455}", "bel": "\\x{040E}\\x{045E}", "ukr": "\\x{0407}\\x{0457}\\x{0404}\\x{0454}",
    "kaz": "\\x{04D8}\\x{04D9}\\x{0492}\\x{0493}\\x{049A}\\x{049B}\\x{04A2}\\x{04A3}\\x{04E8}\\x{04E9}\\x{04AE}\\x{04AF}",
}
THREE_LETTERS = "CASE {x} WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE {x} END"


def _quoted(t: str) -> str:
    plain = t.replace("'", "''")
    return "'" + plain.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


TEXTS = "texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - k}, {_quoted(t)})" for k, t in enumerate(SAMPLES)) + ") AS v(doc_id, text))"


def _norm(t: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({t}), '-+', ' ', 'g'), '[^\\p{{L}}\\p{{M}}{SPACE}]', '', 'g'), '[{SPACE}]{{2,}}', ' ', 'g')"
    return f"' ' || regexp_replace(lower({out}), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') || ' '"


def _count(f: str) -> str:
    return f"length(regexp_replace(text, '[^{CLASSES[f]}]', '', 'g'))"


PROFILE = f"{TEXTS}, profile AS (SELECT doc_id, text, " + ", ".join(f"{_count(f)}::BIGINT AS {f}" for f in CLASSES) + " FROM texts), summed AS (SELECT *, " + " + ".join(CLASSES) + " AS total FROM profile)"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS o, '{f}' AS script, {f} AS n, total FROM summed" for k, f in enumerate(CLASSES)) + ")"



def _grams(n: int) -> str:
    joined = " || ".join(f"c[i + {k}]" for k in range(n))
    return "unnest(c)" if n == 1 else f"unnest(list_transform(range(1, len(c) - {n - 2}), lambda i: {joined}))"


def _ngrams(rows: str, sizes=(1, 2, 3, 4, 5), to: str = "grams") -> str:
    """CTEs that end in `to` (doc_id, lang, n, gram, many) for the rows (doc_id, lang, text) of a table or CTE."""
    one = " UNION ALL ".join(f"SELECT doc_id, lang, {n} AS n, {_grams(n)} AS gram, length(norm) - {n - 1} AS many FROM {to}_c" for n in sizes)
    return f"{to}_n AS (SELECT doc_id, lang, {_norm('text')} AS norm FROM {rows}), {to}_c AS (SELECT *, string_split(norm, '') AS c FROM {to}_n), {to} AS ({one})"


COUNTS = "counts AS (SELECT lang, n, gram, count(*) AS cnt FROM grams GROUP BY ALL)"
TOP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY cnt DESC, gram) AS rank FROM counts)"


def _model(rows: str) -> str:
    """CTEs of the count model of rows (doc_id, lang, text): 60 n-grams of each language and size, whole weights."""
    return (
        f"{_ngrams(rows)}, counts AS (SELECT lang, n, gram, count(*) AS cnt FROM grams WHERE lang IS NOT NULL GROUP BY ALL), {TOP}, "
        "vocab AS (SELECT n, gram, row_number() OVER (ORDER BY n, gram) - 1 AS idx FROM (SELECT DISTINCT n, gram FROM ranked WHERE rank <= 60)), "
        "langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS lang_idx FROM (SELECT DISTINCT lang FROM counts)), "
        "totals AS (SELECT lang, n, sum(cnt) AS total FROM counts GROUP BY ALL), "
        "weights AS (SELECT lang_idx, lang, v.idx, v.n, v.gram, round(ln((coalesce(cnt, 0) + 1) / (total + 1)) * 10000) AS w FROM vocab v CROSS JOIN langs l JOIN totals t USING (lang, n) LEFT JOIN counts c USING (lang, n, gram))"
    )


def _scored(keys: str, grams: str, sizes=(1, 2, 3, 4, 5), to: str = "") -> str:
    """CTEs of logits and probabilities of the doc_ids in keys, from their grams."""
    by_size = " + ".join(f"coalesce(max(CASE WHEN n = {n} THEN s END), 0.0)" for n in sizes)
    return (
        f"features{to} AS (SELECT doc_id, g.n, idx, count(*) AS cnt, max(many) AS many FROM {grams} g JOIN vocab USING (n, gram) GROUP BY ALL), "
        f"sums{to} AS (SELECT doc_id, lang_idx, f.n, sum(cnt * w) / max(many) AS s FROM features{to} f JOIN weights USING (idx) GROUP BY ALL), "
        f"logits{to} AS (SELECT d.doc_id, l.lang, l.lang_idx, ({by_size}) / 512 AS logit "
        f"FROM {keys} d CROSS JOIN langs l LEFT JOIN sums{to} s ON s.doc_id = d.doc_id AND s.lang_idx = l.lang_idx GROUP BY ALL), "
        f"tops{to} AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY doc_id)) AS e FROM logits{to}), "
        f"best{to} AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, lang_idx) AS rank FROM tops{to})"
    )


MODEL = _model("documents")
LOGITS = f"{MODEL}, {_scored('documents', 'grams')}"
_PLACED = "SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS many_rows FROM documents WHERE lang IS NOT NULL"
SPLIT = f"placed AS ({_PLACED}), learn AS (SELECT doc_id, lang, text FROM placed WHERE r <= floor(many_rows * 0.8)), rest AS (SELECT doc_id, lang, text FROM placed WHERE r > floor(many_rows * 0.8))"
HELD_OUT = (
    f"{SPLIT}, {_model('learn')}, {_ngrams('rest', to='test')}, {_scored('rest', 'test')}, {_scored('rest', 'test', (1,), '1')}, "
    "found AS (SELECT d.doc_id, d.lang, b.lang AS pred, c.lang AS letters FROM rest d JOIN best b ON b.doc_id = d.doc_id AND b.rank = 1 JOIN best1 c ON c.doc_id = d.doc_id AND c.rank = 1)"
)
_FIXED = " UNION ALL ".join(
    [f"SELECT doc_id, {k} AS o, '{x}' AS lang, {f} / total AS p FROM summed WHERE {f} > 0" for k, (f, x) in enumerate(ONE_LANGUAGE.items())]
    + ["SELECT doc_id, 6, 'jpn', cjk_kana / total FROM summed WHERE cjk_kana > 0", "SELECT doc_id, 7, 'cmn', cjk_han / total FROM summed WHERE cjk_han > 0 AND cjk_kana = 0"]
)
DETECTED = (
    f"{PROFILE}, {MODEL}, {_ngrams('(SELECT doc_id, NULL AS lang, text FROM texts)', to='all_grams')}, {_scored('texts', 'all_grams')}, "
    f"parts AS ({_FIXED} UNION ALL SELECT doc_id, 100 + lang_idx, {THREE_LETTERS.format(x='b.lang')}, p * latin / total FROM best b JOIN summed USING (doc_id) WHERE latin > 0), "
    f"every AS (SELECT *, FALSE AS fell FROM parts UNION ALL SELECT doc_id, 100 + lang_idx, {THREE_LETTERS.format(x='b.lang')}, p, TRUE FROM best b WHERE doc_id NOT IN (SELECT doc_id FROM parts)), "
    "detected AS (SELECT doc_id, lang, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, o) AS rank FROM every)"
)
_TURNS = "CASE n " + " ".join(f"WHEN {n} THEN {k}" for n, k in {1: 80, 2: 100, 3: 100, 4: 60, 5: 40}.items()) + " END"
ROUND_ROBIN = (
    f"RECURSIVE {_ngrams('documents')}, {COUNTS}, {TOP}, "
    f"queues AS (SELECT n, list(own ORDER BY lang) AS queues FROM (SELECT n, lang, list(gram ORDER BY rank) AS own FROM ranked WHERE lang IN ('de', 'en', 'es', 'fr') AND rank <= {_TURNS} GROUP BY ALL) GROUP BY n), "
    "turns AS (SELECT n, 0 AS turn, queues, []::VARCHAR[] AS taken FROM queues UNION ALL "
    "SELECT n, turn + 1, queues, list_concat(taken, list_filter(queues[turn % len(queues) + 1], lambda g: NOT list_contains(taken, g))[1:1]) "
    f"FROM turns WHERE len(taken) < {_TURNS} AND turn < 400), "
    "robin AS (SELECT n, arg_max(taken, turn) AS taken FROM turns GROUP BY n)"
)
_DRAW = "md5('{seed}/' || {key})"
_CUT = "CASE WHEN length(text) <= size THEN text WHEN strpos(reverse(left(text, size)), ' ') > 0 AND size - strpos(reverse(left(text, size)), ' ') > 5 THEN left(text, size - strpos(reverse(left(text, size)), ' ')) ELSE left(text, size) END"
_PARAGRAPHS = f"SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda p: regexp_replace(regexp_replace(p, '<[^>]+>', '', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda p: length(p) >= 10) AS ps FROM pages"
_ROUTE = (
    "CASE " + " ".join(f"WHEN regexp_matches(text, '[{CLASSES[f]}]') THEN '{x}'" for f, x in {**ONE_LANGUAGE, "cjk_kana": "jpn", "cjk_han": "cmn"}.items())
    + " " + " ".join(f"WHEN regexp_matches(text, '[{CLASSES['cyrillic']}]') AND regexp_matches(text, '[{v}]') THEN '{x}'" for x, v in ONLY_IN.items())
    + " " + " ".join(f"WHEN regexp_matches(text, '[{CLASSES[g]}]') THEN 'group:{g}'" for g in ("cyrillic", "arabic", "devanagari")) + " ELSE 'group:latin' END"
)
_LITERAL = " UNION ALL ".join(
    [f"SELECT doc_id, '{x}' AS lang, {f} AS n, total FROM summed" for f, x in ONE_LANGUAGE.items()]
    + ["SELECT doc_id, 'jpn', cjk_kana, total FROM summed", "SELECT doc_id, 'cmn', CASE WHEN cjk_kana = 0 THEN cjk_han ELSE 0 END, total FROM summed"]
)
_ACC = "count(*) AS total, coalesce(sum((lang = pred)::INT), 0)::BIGINT AS pass, round(100 * coalesce(sum((lang = pred)::INT), 0) / count(*), 4) AS acc"
_SHARED = "list_sum([CASE WHEN length(a) >= 2 * k AND length(b) >= 2 * k AND left(a, 2 * k) = left(b, 2 * k) THEN 1 ELSE 0 END FOR k IN range(1, 16)])"

ORACLES: dict[str, str] = {
    "script_profile": f"WITH {PROFILE} SELECT doc_id, {', '.join(CLASSES)} FROM summed",
    "script_proportions": f"WITH {PROFILE}, {LONG} SELECT doc_id, script, n, round(n / total, 6) AS proportion FROM long WHERE n > 0",
    "dominant_script": f"WITH {PROFILE}, {LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM long) SELECT doc_id, CASE WHEN n > 0 THEN script END AS script, total FROM o WHERE r = 1",
    "literal_detect": f"WITH {PROFILE} SELECT doc_id, lang, round(n / total, 6) AS probability FROM ({_LITERAL}) WHERE n > 0",
    "tiered_route": f"WITH {TEXTS} SELECT doc_id, {_ROUTE} AS route FROM texts",
    "normalize_text": f"WITH {TEXTS}, r AS (SELECT 'documents' AS tbl, doc_id, 0::BIGINT AS part, {_norm('text')} AS norm FROM texts UNION ALL SELECT 'conversations', conv_id, turn, {_norm('text')} FROM conversations) SELECT tbl, doc_id, part, md5(norm) AS norm_md5, length(norm) AS n_chars FROM r",
    "top_ngrams_per_lang": f"WITH {_ngrams('documents')}, {COUNTS}, {TOP} SELECT lang, n, gram, cnt, rank FROM ranked WHERE rank <= 20",
    "datum_view": f"WITH {_ngrams('documents')}, g AS (SELECT doc_id, n, gram, count(*) AS cnt, max(many) AS many FROM grams GROUP BY ALL), s AS (SELECT doc_id, n, count(*) AS grams, sum(cnt)::BIGINT AS total, max(cnt / many) AS most FROM g GROUP BY ALL), k AS (SELECT doc_id, length(norm) AS n_chars, unnest([1, 2, 3, 4, 5]) AS n FROM grams_n) SELECT doc_id, n_chars, n::BIGINT AS n, coalesce(grams, 0) AS grams, coalesce(total, 0) AS total, round(coalesce(most, 0), 9) AS most FROM k LEFT JOIN s USING (doc_id, n)",
    "html_paragraphs": f"WITH r AS ({_PARAGRAPHS}) SELECT page_id, lang, i - 1 AS pos, md5(ps[i]) AS paragraph_md5 FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM r)",
    "linear_logits": f"WITH {LOGITS} SELECT doc_id, lang, round(logit, 6) AS logit FROM logits",
    "softmax_probs": f"WITH {LOGITS} SELECT doc_id, lang, round(p, 6) AS probability FROM best",
    "detect_topk": f"WITH {LOGITS} SELECT doc_id, rank, lang, round(p, 6) AS probability FROM best WHERE rank <= 2",
    "eval_accuracy_per_lang": f"WITH {HELD_OUT} SELECT lang, {_ACC} FROM found GROUP BY lang",
    "eval_overall": f"WITH {HELD_OUT} SELECT {_ACC} FROM found",
    "imperfect_langs": f"WITH {HELD_OUT} SELECT * FROM (SELECT lang, {_ACC.replace('pred', 'letters')} FROM found GROUP BY lang) WHERE acc < 100",
    "eval_compare": f"WITH {HELD_OUT} SELECT 'pred' AS detector, lang, {_ACC} FROM found GROUP BY lang UNION ALL SELECT 'letters', lang, {_ACC.replace('pred', 'letters')} FROM found GROUP BY lang",
    "first_seen_langs": "SELECT lang, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "detect_documents": f"WITH {DETECTED} SELECT doc_id, lang AS lang_pred, round(p, 6) AS probability, total = 0 AS fallback FROM detected JOIN summed USING (doc_id) WHERE rank = 1",
    "detect_all_languages": f"WITH {DETECTED} SELECT doc_id, rank, lang, round(p, 6) AS probability FROM detected WHERE doc_id < 0",
    "detect_tiered_documents": f"WITH {TEXTS}, {MODEL}, {_ngrams('(SELECT doc_id, NULL AS lang, text FROM texts)', to='all_grams')}, {_scored('texts', 'all_grams')}, routed AS (SELECT doc_id, {_ROUTE} AS route FROM texts) SELECT doc_id, CASE WHEN route NOT LIKE 'group:%' THEN route WHEN route = 'group:latin' THEN {THREE_LETTERS.format(x='b.lang')} END AS lang_tiered FROM routed JOIN best b USING (doc_id) WHERE rank = 1",
    "vocab_roundrobin": f"WITH {ROUND_ROBIN} SELECT n::BIGINT AS n, i - 1 AS idx, taken[i] AS gram FROM (SELECT n, taken, unnest(range(1, len(taken) + 1)) AS i FROM robin)",
    "codec_decoded": f"WITH {MODEL}, s AS (SELECT *, CASE WHEN max(abs(w)) OVER (PARTITION BY lang_idx) > 0 THEN 31 / max(abs(w)) OVER (PARTITION BY lang_idx) ELSE 1 END::FLOAT::DOUBLE AS scale FROM weights) SELECT lang, n::BIGINT AS n, idx, gram, round(greatest(-31, least(31, round_even(w * scale, 0))) / scale, 2) AS w FROM s",
    "train_with_copies": f"WITH t AS (SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * 0.8)), s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(seed=43, key='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, ('0x' || left({_DRAW.format(seed=44, key='doc_id')}, 7))::BIGINT % 26 + 15 AS size FROM t), u AS (SELECT lang, FALSE AS is_copy, text FROM t UNION ALL SELECT lang, TRUE, {_CUT} FROM s WHERE r <= floor(n * 0.75)) SELECT lang, is_copy, count(*) AS n, sum(length(text))::BIGINT AS chars FROM u GROUP BY ALL",
    "short_text_eval": f"WITH {SPLIT}, r AS (SELECT doc_id, lang, text, unnest([20, 30, 40])::BIGINT AS size FROM rest) SELECT doc_id, lang, size, {_CUT} AS text FROM r",
    "vocab_coverage": f"WITH {MODEL} SELECT doc_id, g.n, sum((v.idx IS NOT NULL)::INT)::BIGINT AS hits, count(*) AS total FROM grams g LEFT JOIN vocab v USING (n, gram) GROUP BY ALL",
    "feature_vector_sparse": f"WITH {MODEL}, {_scored('documents', 'grams')} SELECT doc_id, idx, round(cnt / many, 9) AS freq FROM features",
    "importance_prune": f"WITH {MODEL}, i AS (SELECT n, idx, gram, sum(abs(w)) AS importance FROM weights GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY importance DESC, idx) AS r FROM i) SELECT n, row_number() OVER (ORDER BY idx) - 1 AS idx, gram, round(importance, 6) AS importance FROM o WHERE r <= CASE n WHEN 1 THEN 20 ELSE 40 END",
    "int6_quantize": f"WITH {MODEL}, s AS (SELECT *, CASE WHEN max(abs(w)) OVER (PARTITION BY lang_idx) > 0 THEN 31 / max(abs(w)) OVER (PARTITION BY lang_idx) ELSE 1 END AS scale FROM weights) SELECT lang_idx, idx, round(scale, 9) AS scale, greatest(-31, least(31, round_even(w * scale, 0)))::BIGINT AS q FROM s",
    "seed_average": f"WITH {MODEL} SELECT lang_idx, idx, avg(w + seed) AS w, count(*) AS seeds FROM weights, range(3) AS r(seed) GROUP BY ALL",
    "prefix_sharing_stats": f"WITH {MODEL}, p AS (SELECT n, hex(encode(gram)) AS a, hex(encode(coalesce(lag(gram) OVER (PARTITION BY n ORDER BY gram), ''))) AS b FROM vocab), s AS (SELECT n, a, {_SHARED} AS shared FROM p) SELECT n, count(*) AS grams, sum(shared)::BIGINT AS shared, sum(length(a) // 2 - shared)::BIGINT AS rest FROM s GROUP BY n",
    "pq_assign": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS v FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS centroid_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM e a CROSS JOIN e b WHERE b.vec_id < 16), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, centroid_id) AS r FROM d) SELECT vec_id, centroid_id, round(dist, 4) AS dist FROM o WHERE r = 1",
    "kmeans_step": (
        "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS v FROM embeddings), "
        "b AS (SELECT vec_id AS cid, v FROM e WHERE vec_id < 16 UNION ALL SELECT 99, list_transform(v, lambda x: 10.0::DOUBLE) FROM e WHERE vec_id = 0), "
        "d AS (SELECT a.vec_id, a.v, b.cid, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM e a CROSS JOIN b), "
        "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid) AS r FROM d) WHERE r = 1), "
        "m AS (SELECT cid, i, avg(v[i]) AS x, count(*) AS n FROM (SELECT cid, v, unnest(range(1, len(v) + 1)) AS i FROM o) GROUP BY ALL), "
        "g AS (SELECT cid, row_number() OVER (ORDER BY cid) AS turn FROM b WHERE cid NOT IN (SELECT cid FROM o)), "
        "w AS (SELECT v, row_number() OVER (ORDER BY dist DESC, vec_id) AS turn FROM o), "
        "c AS (SELECT cid, list(x ORDER BY i) AS c, max(n) AS n FROM m GROUP BY cid UNION ALL SELECT cid, v, 0 FROM g JOIN w USING (turn)) "
        "SELECT cid AS centroid_id, n::BIGINT AS n, round(c[1], 6) AS first, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS square, round((SELECT avg(dist) FROM o), 6) AS mse FROM c"
    ),
    "reservoir_sample": f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(seed=42, key='doc_id')}, doc_id) AS r FROM documents) WHERE r <= 50",
    "fallback_fill": f"WITH k AS (SELECT conv_id || '-' || turn AS key, role AS lang, text FROM conversations) SELECT key, lang, length(text) >= 40 AS is_long FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (length(text) < 40)::INT, {_DRAW.format(seed=42, key='key')}, key) AS r FROM k) WHERE r <= 100",
    "positional_split": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.8) AS is_train FROM documents",
    "truncate_aug": f"WITH t AS (SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * 0.8)), s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(seed=43, key='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, ('0x' || left({_DRAW.format(seed=44, key='doc_id')}, 7))::BIGINT % 26 + 15 AS size FROM t) SELECT doc_id, lang, size, {_CUT} AS text FROM s WHERE r <= floor(n * 0.75)",
    "merge_sources": f"WITH p AS ({_PARAGRAPHS}), r AS (SELECT lang, 0 AS source_ord, doc_id AS pos, text FROM documents UNION ALL SELECT lang, 1, page_id, unnest(ps) FROM p UNION ALL SELECT 'und', 2, conv_id * 1000 + turn, text FROM conversations WHERE length(text) >= 10) SELECT lang, source_ord::BIGINT AS source_ord, count(*) AS n, sum(length(text))::BIGINT AS chars, max(pos) AS last FROM r GROUP BY ALL",
} | {f"ngram_freq_{n}": f"WITH {_ngrams('documents', (n,))} SELECT doc_id, gram, count(*) AS cnt, round(count(*) / max(many), 9) AS freq FROM grams GROUP BY doc_id, gram" for n in (1, 2, 3, 4, 5)}
