"""The SQL twins of the catalog, for DuckDB, each written from the definition."""

from __future__ import annotations

from lexigauge.functions.stopwords import ENGLISH

STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + ")"

NORM = (
    r"regexp_replace(regexp_replace(lower(text), '[$£€]([,\p{Nd}]+(\.)?\p{Nd}+)', '@PRICE@', 'g'), "
    r"'[\p{Nd}]{4}', '@YEAR@', 'g')"
)
TOKENS = rf"regexp_extract_all({NORM}, '[\p{{L}}\p{{N}}_]+|@[\p{{L}}\p{{N}}_]+@')"

# Token rows of the corpus and their counts; *_s without stop words.
CORPUS = f"""
tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
cnt AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM cnt GROUP BY 1),
docs AS (SELECT count(*) AS n_docs FROM documents)"""


def _tfidf(name: str, counts: str, freq: str) -> str:
    return f"""
{name}_raw AS (
  SELECT c.doc_id, c.term, c.n * (ln((1.0 + n_docs) / (1 + df)) + 1) AS w
  FROM {counts} c JOIN {freq} f USING (term), docs WHERE df >= 2),
{name} AS (
  SELECT r.doc_id, r.term, w / sqrt(q) AS weight FROM {name}_raw r
  JOIN (SELECT doc_id, sum(w * w) AS q FROM {name}_raw GROUP BY 1) USING (doc_id))"""


def _texts(name: str, source: str, key: str, stop: bool = False) -> str:
    """(text_id, term, n) of short texts, one empty word for a text without any."""
    where = f"WHERE term NOT IN {STOP}" if stop else ""
    return f"""
{name}_all AS (SELECT {key} AS text_id, unnest({TOKENS}) AS term FROM {source}),
{name}_got AS (SELECT text_id, term, count(*) AS n FROM {name}_all {where} GROUP BY 1, 2),
{name} AS (
  SELECT * FROM {name}_got
  UNION ALL SELECT {key}, '', 1 FROM {source} WHERE {key} NOT IN (SELECT text_id FROM {name}_got))"""


def _cosines(name: str, matrix: str, tokens: str, pairs: str, freq: str, keys: str) -> str:
    """Dense mean vectors over all documents, written out, then the plain cosine."""
    k = ", ".join(f"p.{c.strip()}" for c in keys.split(","))
    return f"""
{name}_m AS (
  SELECT text_id, sum(n) AS total, sum(CASE WHEN f.term IS NULL THEN n ELSE 0 END) AS missing
  FROM {tokens} t LEFT JOIN (SELECT term FROM {freq} WHERE df >= 2) f USING (term) GROUP BY 1),
{name}_v AS (
  SELECT t.text_id, m.doc_id, sum(t.n * m.weight) AS s
  FROM {tokens} t JOIN (SELECT term FROM {freq} WHERE df >= 2) f USING (term)
  JOIN {matrix} m USING (term) GROUP BY 1, 2),
{name}_d AS (
  SELECT t.text_id, d.doc_id, (coalesce(v.s, 0) + 1e-5 * t.missing) / t.total AS x
  FROM {name}_m t CROSS JOIN documents d
  LEFT JOIN {name}_v v ON v.text_id = t.text_id AND v.doc_id = d.doc_id),
{name}_q AS (SELECT text_id, sum(x * x) AS q FROM {name}_d GROUP BY 1),
{name} AS (
  SELECT {k},
    CASE WHEN any_value(qa.q) * any_value(qb.q) = 0 THEN 0.0
    ELSE sum(a.x * b.x) / sqrt(any_value(qa.q) * any_value(qb.q)) END AS similarity
  FROM {pairs} p
  JOIN {name}_d a ON a.text_id = p.a JOIN {name}_d b ON b.text_id = p.b AND b.doc_id = a.doc_id
  JOIN {name}_q qa ON qa.text_id = p.a JOIN {name}_q qb ON qb.text_id = p.b
  GROUP BY {k})"""


COUNTS = "m_count AS (SELECT doc_id, term, n * 1.0 AS weight FROM cnt)"
ZEROONE = "m_zeroone AS (SELECT doc_id, term, 1.0 AS weight FROM cnt)"
DIALOGUE = """
lp AS (
  SELECT c.conv_id AS lp_id, 'SP' || c.turn AS sp_id, l.conv_id || '/' || l.turn AS a,
    c.conv_id || '/' || c.turn AS b
  FROM conversations c JOIN conversations l ON l.conv_id = c.conv_id AND l.turn = 0
  WHERE c.turn > 0)"""
TURN_KEY = "conv_id || '/' || turn"
R6 = "round({0}, 6) + 0.0"

DIALOGUE_COUNT = ",".join(
    [CORPUS, COUNTS, DIALOGUE, _texts("tt", "conversations", TURN_KEY),
     _cosines("cs", "m_count", "tt", "lp", "dfs", "lp_id, sp_id")]
)
RANK = "row_number() OVER (PARTITION BY {by} ORDER BY round(similarity, 9) DESC, sp_id)"


def _six_models() -> str:
    parts = [
        CORPUS, COUNTS, ZEROONE, _tfidf("m_tfidf", "cnt", "dfs"), DIALOGUE,
        f"cnt_s AS (SELECT * FROM cnt WHERE term NOT IN {STOP})",
        f"dfs_s AS (SELECT * FROM dfs WHERE term NOT IN {STOP})",
        _tfidf("m_tfidf_s", "cnt_s", "dfs_s"),
        _texts("tt", "conversations", TURN_KEY), _texts("ts", "conversations", TURN_KEY, True),
    ]
    union = []
    for score in ("count", "zeroone", "tfidf"):
        for stop in (False, True):
            name = f"c_{score}{'_s' if stop else ''}"
            matrix = f"m_{score}{'_s' if stop and score == 'tfidf' else ''}"
            tokens, freq = ("ts", "dfs_s") if stop else ("tt", "dfs")
            parts.append(_cosines(name, matrix, tokens, "lp", freq, "lp_id, sp_id"))
            label = f"lsa:- dim:- sco:{score} sw:{'yes' if stop else '-'}"
            union.append(f"SELECT '{label}' AS model, * FROM {name}")
    parts.append("sims AS (" + " UNION ALL ".join(union) + ")")
    parts.append(f"ranked AS (SELECT *, {RANK.format(by='model, lp_id')} AS rank FROM sims)")
    return ",".join(parts)


SIX = _six_models()
HUMAN = """
human AS (
  SELECT conv_id AS lp_id, 'SP' || turn AS sp_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, 'SP' || turn) AS human
  FROM conversations WHERE turn > 0),
joined AS (
  SELECT r.model, h.lp_id, h.sp_id, h.human, r.rank AS machine, r.similarity
  FROM human h JOIN ranked r USING (lp_id, sp_id))"""

LINE_ID = """l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-'
    || CAST(round(l_extendedprice * 100) AS BIGINT)"""
LINES = f"""
lines AS (
  SELECT l_orderkey AS lp_id, {LINE_ID} AS sp_id, l_quantity AS human,
    floor(l_extendedprice / 5000) AS machine
  FROM lineitem)"""


def _spearman(source: str, by: str) -> str:
    """Average ranks from rank() and the size of each tie, then Pearson's r."""
    return f"""
sp_r AS (
  SELECT {by},
    rank() OVER (PARTITION BY {by} ORDER BY human)
      + (count(*) OVER (PARTITION BY {by}, human) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {by} ORDER BY machine)
      + (count(*) OVER (PARTITION BY {by}, machine) - 1) / 2.0 AS ry
  FROM {source}),
sp AS (
  SELECT {by}, count(*) AS n,
    CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho
  FROM sp_r GROUP BY {by}),
spp AS (
  SELECT *, CASE
    WHEN rho IS NULL OR n < 3 THEN NULL
    WHEN abs(rho) > 1 - 1e-12 THEN 0.0
    WHEN (n - 2) % 2 = 1 THEN 1 - 2 / pi() * (asin(abs(rho)) + CASE WHEN n = 3 THEN 0 ELSE
      abs(rho) * sqrt(1 - rho * rho) * (1 + coalesce(list_sum(list_transform(
        range(1, (n - 5) // 2 + 1),
        lambda i: list_product(list_transform(range(1, i + 1), lambda j: (2.0 * j) / (2 * j + 1)))
          * pow(1 - rho * rho, i))), 0)) END)
    ELSE 1 - abs(rho) * (1 + coalesce(list_sum(list_transform(
        range(1, (n - 4) // 2 + 1),
        lambda i: list_product(list_transform(range(1, i + 1), lambda j: (2.0 * j - 1) / (2 * j)))
          * pow(1 - rho * rho, i))), 0))
    END AS p
  FROM sp)"""


def _pairs(source: str, by: str) -> str:
    """Every pair of a group, for Kendall and for the order of pairs."""
    using = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    return f"""
pr AS (
  SELECT {cols},
    sum(sign(a.human - b.human) * sign(a.machine - b.machine)) AS s,
    count(*) AS n0, sum(CASE WHEN a.human = b.human THEN 1 ELSE 0 END) AS tx,
    sum(CASE WHEN a.machine = b.machine THEN 1 ELSE 0 END) AS ty,
    sum(CASE WHEN sign(a.human - b.human) * sign(a.machine - b.machine) < 0 THEN 1 ELSE 0 END) AS wrong,
    sum(CASE WHEN a.human < b.human OR (a.human = b.human AND a.sp_id < b.sp_id)
      THEN CASE WHEN a.machine < b.machine THEN 1 ELSE 0 END
      ELSE CASE WHEN b.machine < a.machine THEN 1 ELSE 0 END END) AS rising
  FROM {source} a JOIN {source} b ON {using} AND a.sp_id < b.sp_id GROUP BY {cols}),
ties AS (
  SELECT {by}, sum(n) AS n, sum(x0) AS x0, sum(x1) AS x1, sum(y0) AS y0, sum(y1) AS y1 FROM (
    SELECT {by}, sum(c) AS n, sum(c * (c - 1) * (c - 2)) AS x0, sum(c * (c - 1) * (2 * c + 5)) AS x1,
      0 AS y0, 0 AS y1
    FROM (SELECT {by}, human, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY {by}
    UNION ALL
    SELECT {by}, 0, 0, 0, sum(c * (c - 1) * (c - 2)), sum(c * (c - 1) * (2 * c + 5))
    FROM (SELECT {by}, machine, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY {by}
  ) GROUP BY {by}),
kd AS (
  SELECT *, s / sqrt((n0 - tx) * 1.0 * (n0 - ty)) AS tau,
    abs(s) / sqrt(((n * (n - 1)) * (2.0 * n + 5) - x1 - y1) / 18 + 2.0 * tx * ty / (n * (n - 1))
      + CASE WHEN n > 2 THEN x0 * y0 / (9.0 * n * (n - 1) * (n - 2)) ELSE 0 END) / sqrt(2.0) AS z
  FROM ties LEFT JOIN pr USING ({by})),
kt AS (
  SELECT {by}, CASE WHEN n0 > tx AND n0 > ty THEN tau END AS tau,
    CASE WHEN n0 > tx AND n0 > ty THEN CASE
      WHEN tx = 0 AND ty = 0 AND n <= 33 THEN (
        SELECT least(1.0, 2 * list_sum(c[1 : least(wrong, n0 - wrong) + 1]) / list_sum(c))
        FROM inversions i WHERE i.n = kd.n)
      ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k:
        pow(-1, k) * pow(z, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1))))) END END AS p,
    CASE WHEN n0 > 0 THEN rising / n0 END AS share
  FROM kd)"""


INVERSIONS = """
inversions(n, c) AS (
  SELECT 1::BIGINT, [1.0::DOUBLE]
  UNION ALL
  SELECT n + 1, list_transform(range(0, len(c) + n), lambda w:
    list_sum(c[greatest(w - n, 0) + 1 : w + 1]))
  FROM inversions WHERE n < 33)"""


def oracles() -> dict[str, str]:
    r6 = R6.format
    short = ",".join([CORPUS, COUNTS, ZEROONE, _tfidf("m_tfidf", "cnt", "dfs"),
                      _texts("bt", "benchmark", "item_id")])
    known = "(SELECT term FROM dfs WHERE df >= 2)"
    prefix = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT (SELECT {0} FROM documents)"
    groups = """
g AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i,
    CAST(round_even(count(*) OVER () / (count(*) OVER () // 4), 0) AS BIGINT) AS m
  FROM documents)"""
    match_pairs = """
mp AS (
  SELECT l.conv_id, l.turn, e.conv_id || '/' || e.turn AS a, l.conv_id || '/' || l.turn AS b
  FROM conversations l JOIN conversations e ON e.conv_id = l.conv_id AND e.turn = l.turn - 1)"""
    rec_lines = f"WITH RECURSIVE {INVERSIONS}, {LINES}, {_pairs('lines', 'lp_id')}"
    # the short texts in the place of the corpus
    short_corpus = "documents AS (SELECT item_id AS doc_id, text FROM benchmark)"
    sql = {
        "saved_models_rank": f"""
WITH {SIX} SELECT model, CAST(lp_id AS VARCHAR) AS lp_id, sp_id, rank, {r6('similarity')} AS similarity FROM ranked""",
        "questionnaire_files": """
SELECT CAST(c.conv_id AS VARCHAR) AS lp_id, 'SP' || c.turn AS sp_id, l.text AS lead_text, c.text AS cand_text
FROM conversations c JOIN conversations l ON l.conv_id = c.conv_id AND l.turn = 0 WHERE c.turn > 0""",
        "cells_csv": f"""
WITH {short_corpus}, {CORPUS}
SELECT term, doc_id, {r6('n * 1.0::DOUBLE')} AS weight FROM cnt JOIN dfs USING (term) WHERE df >= 2""",
        "wide_csv": f"""
WITH {short_corpus}, {CORPUS}
SELECT term, doc_id, {r6('n * 1.0::DOUBLE')} AS weight FROM cnt JOIN dfs USING (term) WHERE df >= 2""",
        "block_files": f"""
WITH {short_corpus}, {CORPUS}, {_tfidf('w', 'cnt', 'dfs')} SELECT term, doc_id, {r6('weight')} AS weight FROM w""",
        "worker_answer_files": """
SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'Rejected' ELSE 'Approved' END AS status, c_mktsegment AS lp_id,
       'SP' || i AS sp_id, (c_custkey * i % 7)::BIGINT AS score
FROM customer, (SELECT unnest(range(1, 7)) AS i)""",
        "lsa_full_rank_entries": f"""
WITH {short_corpus}, {CORPUS}
SELECT term, doc_id, round(n * 1.0::DOUBLE, 4) AS weight FROM cnt JOIN dfs USING (term) WHERE df >= 2""",
        "lsa_full_rank_similarities": f"""
WITH {short_corpus}, {DIALOGUE_COUNT} SELECT lp_id, sp_id, round(similarity, 5) + 0.0 AS similarity FROM cs""",
        "lsa_energy": f"""
WITH {short_corpus}, {CORPUS}, k AS (SELECT doc_id, term, n FROM cnt JOIN dfs USING (term) WHERE df >= 2),
pp AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.n * b.n)::DOUBLE AS g FROM k a JOIN k b USING (term) GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i = j THEN g ELSE 0 END), 4) AS squares, round(sum(g * g), 4) AS fourth FROM pp""",
        "corpus_scan": "SELECT doc_id, 'doc' || doc_id AS title, text FROM documents",
        "tag_text": r"""
SELECT page_id, unnest(range(len(x))) AS position, unnest(x) AS text FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS x FROM pages)""",
        "corpus_prefix": prefix.format("count(*) // 3"),
        "corpus_prefix_all_but_last": prefix.format("count(*) - 1"),
        "corpus_regroup": f"""
WITH {groups}
SELECT i // m AS doc_id, string_agg(text || chr(10), '' ORDER BY i) AS text FROM g GROUP BY 1
UNION ALL SELECT max(i + 1) // max(m), '' FROM g HAVING max(i + 1) % max(m) = 0""",
        "corpus_regroup_counts": f"""
WITH {groups},
joint AS (SELECT i // m AS doc_id, string_agg(text, chr(10) ORDER BY i) AS text FROM g GROUP BY 1)
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM joint)
GROUP BY 1, 2""",
        "wide_to_candidates": """
SELECT CAST(c_custkey AS VARCHAR) AS lp_id, sp_id, c_name AS lead_text, cand_text
FROM customer, (SELECT unnest(range(1, 7)) AS i),
  LATERAL (SELECT 'SP' || i AS sp_id, CASE i WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment
    WHEN 3 THEN CAST(c_nationkey AS VARCHAR) WHEN 4 THEN CAST(c_custkey AS VARCHAR)
    WHEN 5 THEN c_mktsegment ELSE c_name END AS cand_text)""",
        "normalize_text": f"SELECT doc_id, {NORM} AS text FROM documents",
        "tokenize": f"""
SELECT doc_id, unnest(range(len(t))) AS position, unnest(t) AS token
FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
        "stopword_filter": f"WITH {CORPUS} SELECT doc_id, term, n FROM cnt WHERE term NOT IN {STOP}",
        "stopword_flags": rf"""
SELECT doc_id, position, word, word IN {STOP} AS is_stop FROM (
  SELECT doc_id, unnest(range(len(w))) AS position, unnest(w) AS word FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents))""",
        "empty_text_guard": f"""
SELECT conv_id, turn, greatest(len(t), 1) AS n_tokens, len(t) = 0 AS is_empty FROM (
  SELECT conv_id, turn, list_filter({TOKENS}, lambda x: x NOT IN {STOP}) AS t FROM conversations)""",
        "token_multiset": f"WITH {_texts('bt', 'benchmark', 'item_id')} SELECT * FROM bt",
        "term_doc_count": f"WITH {CORPUS} SELECT term, doc_id, {r6('n * 1.0::DOUBLE')} AS weight FROM cnt",
        "term_doc_zeroone": f"WITH {CORPUS} SELECT term, doc_id, 1.0::DOUBLE AS weight FROM cnt",
        "term_doc_tfidf": f"""
WITH {CORPUS}, {_tfidf('w', 'cnt', 'dfs')} SELECT term, doc_id, {r6('weight')} AS weight FROM w""",
        "term_doc_tfidf_stop": f"""
WITH {CORPUS}, cnt_s AS (SELECT * FROM cnt WHERE term NOT IN {STOP}), {_tfidf('w', 'cnt_s', 'dfs')}
SELECT term, doc_id, {r6('weight')} AS weight FROM w""",
        "document_frequency": f"WITH {CORPUS} SELECT term, df FROM dfs",
        "vocab_pruned": f"WITH {CORPUS} SELECT term, doc_id, n FROM cnt JOIN {known} USING (term)",
        "ignored_terms": f"WITH {CORPUS} SELECT term, df FROM dfs WHERE df < 2",
        "vocab_index": f"""
WITH {CORPUS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df FROM dfs WHERE df >= 2""",
        "model_stats": f"""
WITH {CORPUS} SELECT count(*) FILTER (df >= 2) AS wordcount, any_value(n_docs) AS n_documents,
  any_value(n_docs) AS n_columns, count(*) FILTER (df < 2) AS ignored_count,
  count(*) FILTER (df >= 2) || 'x' || any_value(n_docs) AS size_label FROM dfs, docs""",
        "word_vectors": f"""
WITH {short}, words AS MATERIALIZED (SELECT term FROM dfs WHERE df >= 2),
marked AS MATERIALIZED (SELECT bt.*, words.term IS NOT NULL AS known FROM bt LEFT JOIN words USING (term)),
cells AS MATERIALIZED (SELECT * FROM m_tfidf SEMI JOIN marked USING (term))
SELECT text_id, term, n, known, doc_id, {r6('weight')} AS weight FROM marked JOIN cells USING (term) WHERE known
UNION ALL SELECT text_id, term, n, false, NULL, 1e-5 FROM marked WHERE NOT known""",
        "oov_tokens": f"WITH {short} SELECT text_id, term, n FROM bt WHERE term NOT IN {known}",
        "text_vectors": f"""
WITH {short}, size AS (
  SELECT text_id, sum(n) AS total, sum(CASE WHEN term IN {known} THEN 0 ELSE n END) AS missing
  FROM bt GROUP BY 1)
SELECT text_id, doc_id,
  round(sum(n * weight) / any_value(total) + any_value(missing * 1e-5 / total), 12) AS value,
  round(any_value(missing * 1e-5 / total), 12) AS base
FROM bt JOIN {known} USING (term) JOIN m_count USING (term) JOIN size USING (text_id) GROUP BY 1, 2""",
        "cosine_pairs": f"""
WITH {short}, np AS (SELECT x.item_id AS a, y.item_id AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1),
{_cosines('cs', 'm_zeroone', 'bt', 'np', 'dfs', 'a, b')} SELECT a, b, {r6('similarity')} AS similarity FROM cs""",
        "text_match": f"""
WITH {CORPUS}, {_tfidf('m_tfidf', 'cnt', 'dfs')}, {match_pairs}, {_texts('tt', 'conversations', TURN_KEY)},
{_cosines('cs', 'm_tfidf', 'tt', 'mp', 'dfs', 'conv_id, turn')}
SELECT conv_id, turn, {r6('similarity')} AS similarity FROM cs""",
        "lead_vs_candidates": f"WITH {DIALOGUE_COUNT} SELECT lp_id, sp_id, {r6('similarity')} AS similarity FROM cs",
        "rank_candidates": f"""
WITH {DIALOGUE_COUNT} SELECT lp_id, sp_id, {RANK.format(by='lp_id')} AS rank,
  {r6('similarity')} AS similarity FROM cs""",
        "ranked_ids": f"""
WITH {DIALOGUE_COUNT} SELECT lp_id,
  string_agg(sp_id, ',' ORDER BY round(similarity, 9) DESC, sp_id) AS ranked_ids FROM cs GROUP BY 1""",
        "multi_model_rank": f"""
WITH {SIX} SELECT model, lp_id, sp_id, rank, {r6('similarity')} AS similarity FROM ranked""",
        "dense_cosine": f"""
SELECT x.vec_id AS a, y.vec_id AS b,
  {r6('list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))')} AS similarity
FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
        "human_rank": f"""
WITH m AS (SELECT user_id AS lp_id, event_type AS sp_id, avg(value) AS mean_score FROM events
  WHERE NOT starts_with(event_type, 'error') GROUP BY 1, 2)
SELECT lp_id, sp_id, {r6('mean_score')} AS mean_score,
  row_number() OVER (PARTITION BY lp_id ORDER BY round(mean_score, 9), sp_id) AS rank FROM m""",
        "chart_worker_points": """
SELECT * FROM (SELECT user_id AS lp_id, event_type AS sp_id,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS worker, value AS score
  FROM events WHERE NOT starts_with(event_type, 'error')) WHERE worker <= 10""",
        "human_machine_join": f"WITH {SIX}, {HUMAN} SELECT model, lp_id, sp_id, human, machine FROM joined",
        "chart_points": f"""
WITH {SIX}, {HUMAN} SELECT model, lp_id, sp_id, human, machine, round(similarity, 6) AS similarity,
  round(pow(15 * similarity, 2), 4) AS marker FROM joined""",
        "spearman": f"""
WITH {LINES}, {_spearman('lines', 'lp_id')} SELECT lp_id, n, {r6('rho')} AS spearman_corr FROM spp""",
        "spearman_p": f"""
WITH {LINES}, {_spearman('lines', 'lp_id')}
SELECT lp_id, {r6('rho')} AS spearman_corr, {r6('p')} AS spearman_p_value FROM spp""",
        "spearman_large_groups": f"""
WITH big AS (SELECT l_returnflag AS lp_id, l_quantity AS human, l_extendedprice AS machine FROM lineitem),
{_spearman('big', 'lp_id')} SELECT lp_id, n, {r6('rho')} AS spearman_corr FROM sp""",
        "kendall": f"{rec_lines} SELECT lp_id, {r6('tau')} AS kendall_corr FROM kt",
        "kendall_p": f"{rec_lines} SELECT lp_id, {r6('tau')} AS kendall_corr, {r6('p')} AS kendall_p_value FROM kt",
        "order_preservation": f"{rec_lines} SELECT lp_id, {r6('share')} AS order_preservation_measure FROM kt",
        "evaluate_models": f"""
WITH RECURSIVE {INVERSIONS}, {SIX}, {HUMAN}, {_spearman('joined', 'model, lp_id')}, {_pairs('joined', 'model, lp_id')}
SELECT model, lp_id, spp.n AS n, {r6('rho')} AS spearman_corr, {r6('spp.p')} AS spearman_p_value,
  {r6('tau')} AS kendall_corr, {r6('kt.p')} AS kendall_p_value, {r6('share')} AS order_preservation_measure
FROM spp JOIN kt USING (model, lp_id)""",
        "metric_pivot": f"""
WITH both_keys AS (SELECT l_returnflag AS model, l_linestatus AS lp_id, l_quantity AS human,
  l_extendedprice AS machine FROM lineitem), {_spearman('both_keys', 'model, lp_id')}
SELECT model, {r6("max(CASE WHEN lp_id = 'F' THEN rho END)")} AS "F",
  {r6("max(CASE WHEN lp_id = 'O' THEN rho END)")} AS "O" FROM sp GROUP BY 1""",
        "model_label": """
WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS lsa, o_custkey % 300 + 1 AS dim,
  CASE o_orderkey % 3 WHEN 0 THEN 'tfidf' WHEN 1 THEN 'zeroone' ELSE 'count' END AS score,
  o_totalprice > 100000 AS stop FROM orders),
t AS (SELECT *, CASE WHEN lsa THEN 'lsa-dim' || dim ELSE 'docbyterm' END || '-' || score
  || CASE WHEN stop THEN '-stop' ELSE '' END AS tail FROM o)
SELECT o_orderkey, 'lsa:' || CASE WHEN lsa THEN 'yes dim:' || dim ELSE '- dim:-' END || ' sco:' || score
  || ' sw:' || CASE WHEN stop THEN 'yes' ELSE '-' END AS description,
  'model-' || tail AS name, 'orders-min_df_2-' || tail AS filename FROM t""",
    }
    return sql
