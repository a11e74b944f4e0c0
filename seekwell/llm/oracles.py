"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from seekwell.llm import quality, secrets

_LISTS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in quality.COMMON_WORDS.items()) + "}"
_P, _Q = "x[1] / list_sum({0})", "x[2] / list_sum({1})"
_TERM = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"


def _distance(own: str, reference: str) -> str:
    p, q = _P.format(own, reference), _Q.format(own, reference)
    terms = f"{_TERM.format(p=p, q=q)} + {_TERM.format(p=q, q=p)}"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({own}, {reference}), lambda x: {terms})) / 2, 0))"


OP5 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
 s AS (SELECT *, regexp_replace(t, '[a-z]+', '', 'g') AS t1, list_transform(w, lambda x: lower(x)) AS lw, {_LISTS}[lang] AS common FROM w),
 s2 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM s), s3 AS (SELECT *, regexp_replace(t2, '[A-Z]+', '', 'g') AS t3 FROM s2),
 s4 AS (SELECT *, regexp_replace(t3, '[0-9]+', '', 'g') AS t4 FROM s3), s5 AS (SELECT *, regexp_replace(t4, '[#*$%&|<>]+', '', 'g') AS t5 FROM s4),
 s6 AS (SELECT *, regexp_replace(t5, '[\x00-\x7F]+', '', 'g') AS t6 FROM s5),
 m AS (SELECT doc_id, lang, len(w) AS n_words, length(t) - (length(t1) - length(t2)) AS word_chars, length(t4) - length(t5) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, length(t) AS n_chars,
  [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5) - length(t6), length(t6)]::double[] AS classes,
  list_transform(common, lambda c: len(list_filter(lw, lambda x: x = c)))::double[] AS counted FROM s6 LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, list_append(counted, n_words - list_sum(counted)) AS words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 f AS (SELECT lang, [{', '.join(f'sum(classes[{i}])' for i in range(1, 8))}] AS rc, [{', '.join(f'sum(words[{i}])' for i in range(1, 14))}] AS rw FROM b WHERE NOT base_failed GROUP BY lang),
 j AS (SELECT b.*, CASE WHEN n_chars >= {quality.CHARS_GUARD} THEN {_distance('classes', 'rc')} END AS dc, CASE WHEN n_words >= {quality.WORDS_GUARD} THEN {_distance('words', 'rw')} END AS dw FROM b LEFT JOIN f USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND coalesce(dc, 0) <= {quality.MOST_CHAR_DISTANCE} AND coalesce(dw, 0) <= {quality.MOST_WORD_DISTANCE} AS kept, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance FROM j"""

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _places(kind: int, pattern: str, group: int, least: str) -> str:
    return f"""SELECT doc_id, source, {kind} AS kind, s AS start, s + length(m) AS stop, v FROM (SELECT doc_id, source, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(m, lambda x, i:
 (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::bigint)) AS s
 FROM (SELECT doc_id, source, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)) WHERE {least}"""


_KIND = "(['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || start || ':' || stop"
_LIVE = """regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8
 AND NOT regexp_matches(v, '(?i)example|sample|dummy|change|placeholder|your|xxxx|1234567|0000000')"""

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
 c AS ({_places(0, _ASSIGN, 1, 'length(v) >= 12')} UNION ALL {_places(1, 'AKIA[A-Z0-9]+', 0, 'length(v) >= 18')}
  UNION ALL {_places(2, '[0-9a-f]+', 0, 'length(v) >= 16')} UNION ALL {_places(3, '[A-Za-z0-9+/_-]+', 0, 'length(v) >= 24')}),
 l AS (SELECT doc_id, source, stop - length(v) AS start, stop, v FROM c WHERE {_LIVE}),
 o AS (SELECT v, count(DISTINCT source) > {secrets.MOST_OWNERS} OR count(DISTINCT (source, doc_id)) > {secrets.MOST_REPOSITORIES} AS example FROM l GROUP BY v),
 p AS (SELECT DISTINCT doc_id, start, stop, example FROM l JOIN o USING (v)),
 a AS (SELECT doc_id, kind, start, stop FROM c WHERE kind < 3 UNION ALL SELECT doc_id, 3, start, stop FROM p WHERE NOT example),
 b AS (SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, count_if(kind = 3) AS n_live,
  coalesce(string_agg({_KIND}, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '') AS base, string_agg({_KIND}, ',' ORDER BY start, kind, stop) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND example) AS n_examples FROM d LEFT JOIN b USING (doc_id)"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

ORACLES: dict[str, str] = {"op4_secrets": OP4, "op5_quality": OP5, "op10_topk": OP10}
