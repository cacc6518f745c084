"""SQL twins."""

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTER_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_LETTER_WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_LETTER_WORDS} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT d.*, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS i FROM d, ks WHERE len(w) >= ks.k)),
m AS (SELECT r, i, k, item_id FROM dg JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

ORACLES["op3_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS qv FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id,
             list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * qv[i]))::BIGINT AS score
      FROM q JOIN v ON vec_id <> query_id AND len(v) = len(qv))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 20
"""


def mixing_sql(table: str) -> str:
    """The mix of ``table`` (doc_id, text, source)."""
    return f"""
WITH sized AS (SELECT doc_id, text, source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
keyed AS (SELECT doc_id, source, size, md5(coalesce(text, '')) AS tie,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/7'), 1, 13))::BIGINT::DOUBLE + 0.5)
            / 4503599627370496.0)
        / greatest(0.05, 1.0 - coalesce((length(text) - length(translate(text, '!*#$%&|', '')))::DOUBLE
                                        / greatest(size, 1), 0.0)) AS key FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (SELECT *, 2.0::DOUBLE * source_size AS lim,
        ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
        FROM sizes),
levels AS (SELECT *, row_number() OVER o AS place,
        ((sum(source_size) OVER ())::DOUBLE * 1.5
         - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM weighted WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)),
targets AS (SELECT source, source_size, least(lim, coalesce(
        (SELECT arg_min(level, place) FROM levels WHERE level * weight <= lim) * weight, lim)) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
ordered AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size, tie
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (before < rest)::BIGINT))::BIGINT AS taken FROM ordered
"""


ORACLES["op10_source_mixing"] = mixing_sql("documents")

ORACLES["op7_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON a = d.doc_id
"""

ORACLES["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_LETTER_WORDS}, []) AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS n
      FROM (SELECT item_id, unnest({_LETTER_WORDS}) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, term, tf
      FROM (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL)
      JOIN d USING (r) WHERE term IN (SELECT term FROM q)),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
scored AS (SELECT item_id, r, doc_id,
                  sum(q.n * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * big_n) // big_l))))::BIGINT AS score
           FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_RUNS = "regexp_extract_all({0}, '[0-9a-f]([0-9a-f]{{8}})', 1)"


def _print_sql(words: str) -> str:
    """The fingerprint of a list of words."""
    heads = f"list_transform({words}, lambda x: substr(md5(x), 1, 8))"
    places = (
        f"list_filter(range(0, greatest(len({words}) - 4, 0)), lambda i: least(n[i + 1], n[i + 5]) <= least(n[i + 2], n[i + 3], n[i + 4]))"
    )
    one = (
        "substr('0123456789abcdef', (p[j] - coalesce(p[j - 1], 0) + 1)::BIGINT, 1) || "
        f"substr(md5(array_to_string({words}[p[j] + 1:p[j] + 5], ' ')), 1, 8)"
    )
    whole = f"CASE WHEN len({words}) > 0 THEN '0' || substr(md5(array_to_string({words}, ' ')), 1, 8) ELSE '' END"
    return f"""(SELECT CASE WHEN len(p) > 0 THEN array_to_string(list_transform(range(1, len(p) + 1), lambda j: {one}), '') ELSE {whole} END
        FROM (SELECT {places} AS p FROM (SELECT {heads} AS n)))"""


def _like_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct({_RUNS.format(c)})" for c in (a, b))
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) * 2.0 / (len({x}) + len({y})) END::DOUBLE"


def _words_sql(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLES["op12_syncmer_fingerprints"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, lead(r) OVER w AS nr, first_value(r) OVER w AS fr FROM d
      WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(t), r)),
x AS (SELECT o.r, o.doc_id, length(o.t)::BIGINT AS n_chars, coalesce(nr, fr) AS nr, o.t,
             substr(o.t, 1, (length(o.t) - length(o.t) // 2)::BIGINT) || substr(e.t, 1, (length(o.t) // 2)::BIGINT) AS edited
      FROM o JOIN d e ON e.r = coalesce(nr, fr)),
w AS (SELECT *, {_words_sql("t")} AS tw, {_words_sql("edited")} AS ew FROM x),
f AS (SELECT r, doc_id, n_chars, nr, sha256(edited) AS edited_sha256, {_print_sql("tw")} AS fingerprint,
             {_print_sql("ew")} AS edited_fingerprint FROM w)
SELECT f.doc_id, f.n_chars, f.edited_sha256, f.fingerprint, f.edited_fingerprint,
       {_like_sql("f.fingerprint", "f.edited_fingerprint")} AS near_edited,
       {_like_sql("f.fingerprint", "g.fingerprint")} AS near_next
FROM f JOIN f g ON g.r = f.nr
"""

ORACLES["op13_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
           FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS size, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.size) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.size) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 50
"""
