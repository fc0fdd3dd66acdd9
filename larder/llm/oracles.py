"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from larder.llm import chat, hard_negatives, licenses

_LOW = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scans() -> str:
    phrases, templates = licenses.PHRASES, {n: sorted(set(t.split())) for n, t in licenses.TEMPLATES.items()}
    cut = "list_filter(regexp_split_to_array({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    places = ", ".join(f"list_filter(range(1, len(words) - {len(p.split()) - 2}), lambda i: words[i:i + {len(p.split()) - 1}] = {_list(p.split())}) AS p{k}" for k, p in enumerate(phrases))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(phrases.values()))
    widths = sorted({licenses.width(t) for t in licenses.TEMPLATES.values()})
    blocks = ", ".join(f"list_transform(range(1, greatest(len(words) - {w // 2}, 1) + 1, {w // 2}), lambda i: words[i:i + {w - 1}]) AS blocks{w}" for w in widths)
    strings = lambda words: f"{_list(words)}::VARCHAR[]"
    told = lambda n: f"list_filter(blocks{licenses.width(licenses.TEMPLATES[n])}, lambda b: list_has_all(b, {strings(licenses.TELLING[n][0])}) AND NOT list_has_any(b, {strings(licenses.TELLING[n][1])}))" if n in licenses.TELLING else f"blocks{licenses.width(licenses.TEMPLATES[n])}"
    shared = ", ".join(f"coalesce(list_max(list_transform({told(n)}, lambda b: len(list_intersect(b, {_list(t)})))), 0) AS s{k}" for k, (n, t) in enumerate(templates.items()))
    need = [licenses.need(t, licenses.THRESHOLD) for t in templates.values()]
    found = ", ".join(f"CASE WHEN s{k} >= {n} THEN '{name.removesuffix('-line')}' END" for k, (name, n) in enumerate(zip(templates, need, strict=True)))
    score = ", ".join(f"CASE WHEN s{k} >= {n} THEN s{k} / {len(t)}.0::DOUBLE ELSE 0 END" for k, (t, n) in enumerate(zip(templates.values(), need, strict=True)))
    joined = "array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ',')"
    at = " || ".join(f"p{k}" for k in range(len(phrases)))
    return f"""
    WITH low AS (SELECT doc_id, {_LOW} AS low FROM documents),
    cut AS (SELECT doc_id, {cut.format('low')} AS words FROM low),
    placed AS (SELECT doc_id, words, {places}, {blocks} FROM cut),
    scored AS (SELECT *, {at} AS starts, {shared} FROM placed)
    SELECT doc_id, len(words) AS n_words, len(starts) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word, {joined.format(f'[{base}]')} AS base_labels,
      {joined.format(f'[{base}, {found}]')} AS labels, CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE greatest({score}) END AS score FROM scored"""


def near_dedup() -> str:
    return f"""
    WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM cut),
    one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS same FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n + b.n),
    links AS (SELECT a, b FROM pairs WHERE 100 * same >= 75 * (n - same)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT b, r FROM reach JOIN links ON a = doc_id),
    least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""


def substring_dedup(length: int = 100) -> str:
    return f"""
    WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    starts AS (SELECT doc_id, p, x[2 * p + 1:2 * p + {2 * length}] AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {length - 1})) AS p FROM raw)),
    late AS (SELECT doc_id, p FROM starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
    steps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS new FROM late),
    numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM steps),
    spans AS (SELECT doc_id, k, min(p) AS a, max(p) + {length} AS b FROM numbered GROUP BY 1, 2),
    edges AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1 AS last FROM spans),
    cut AS (SELECT doc_id, any_value(x) AS x, sum(b - a) AS n, count(*) AS spans, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)) || CASE WHEN last THEN substr(x, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY k) AS kept
      FROM edges JOIN raw USING (doc_id) GROUP BY 1)
    SELECT raw.doc_id, len(raw.x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, raw.x))) AS kept_sha256 FROM raw LEFT JOIN cut USING (doc_id)"""


def embedding_dedup(cosine: float = 0.95) -> str:
    return f"""
    WITH RECURSIVE raw AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    fine AS (SELECT * FROM raw WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
    links AS (SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= {cosine} END),
    reach(r, x) AS (SELECT r, r FROM raw UNION SELECT b, x FROM reach JOIN links ON a = r),
    least AS (SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN raw ON raw.r = reach.x GROUP BY 1),
    n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM raw JOIN least USING (r) LEFT JOIN n USING (r)"""


def periodic_runs() -> str:
    crc = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda t: ascii(t)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"
    return f"""
    WITH cut AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {crc} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sized AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM cut),
    docs AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM sized),
    words AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
    same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
    stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
    runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY ALL),
    lists AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
    dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS text FROM words LEFT JOIN dropped ON words.r = dropped.r AND words.i = dropped.i WHERE dropped.r IS NULL GROUP BY 1)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM docs LEFT JOIN lists USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


ORACLES = {"op1_license_scans": license_scans(), "op5_near_dedup": near_dedup(), "op7_chat_formatting": chat.oracle(), "op10_substring_dedup": substring_dedup(),
           "op11_embedding_dedup": embedding_dedup(), "op12_hard_negatives": hard_negatives.ORACLE, "op13_periodic_runs": periodic_runs()}
