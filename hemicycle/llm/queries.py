"""One query for each operator of this package, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hemicycle.llm import centroids, embedding_dedup, hilbert, jaccard, maxent, nn_descent, packing, piece_codec, quality, repeats, spelling, toxicity, wrapper

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_read(spark, sf_dir, "embeddings"), 0.9)


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.shard_rows(_read(spark, sf_dir, "documents"), 40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).select("doc_id", *quality.BASE, "base_failed", "kept")


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_text(_read(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(_read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_vectors(_read(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def _reach(links: str) -> str:
    """CTE ``reach``: every id with the ids that links lead to."""
    return f"reach(id, root) AS (SELECT a, b FROM {links} UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON r.root = l.a)"


_OP1 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
    SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), {_reach("links")}, low AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(low.root, v.vec_id)) AS component_id,
    v.vec_id <= coalesce(low.root, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN low ON low.id = v.vec_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP5 = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), {_reach("links")}, low AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.root, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.id = d.doc_id
"""


def _stop_list() -> str:
    words = sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()})
    return ", ".join(f"'{w}', '{w.capitalize()}'" for w in words)


_OP3 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), win AS (
    SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)
), rep AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, generate_series(0, 4) AS s(k) GROUP BY r), c AS (
    SELECT w.*, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(w.w, lambda x: x IN ({_stop_list()}))) AS n_stop, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, len(l) AS n_lines
    FROM w LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
        AND word_chars / n_words BETWEEN 1.5 AND 18.0 AND n_symbols / n_words <= 0.25
        AND (n_words < 30 OR n_stop / n_words >= 0.02) AND n_upper / word_chars <= 0.35
        AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.4) AND n_lines / n_words <= 0.8 AS kept
FROM c
"""

_OP12 = rf"""
WITH RECURSIVE tab(i, k, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8
), t AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUN}')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), kinds AS (
    SELECT id, run, count(*) AS n, hex(id || ':' || run) AS x FROM runs WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2),
        lambda i: 16 * strpos('123456789ABCDEF', x[2 * i + 1]) + strpos('123456789ABCDEF', x[2 * i + 2]))),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
    FROM kinds, t
), w AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), del AS MATERIALIZED (
    SELECT word, i, word[:i] || word[i + 2:] AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)
), near AS (
    SELECT a.word, b.word AS other FROM del a JOIN del b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
    UNION SELECT d.word, w.word FROM del d JOIN w ON d.less = w.word
    UNION SELECT w.word, d.word FROM del d JOIN w ON d.less = w.word
), best AS (
    SELECT near.word, count(*) AS n_near, min({{'n': -w.n, 'w': w.word}}) AS b FROM near JOIN w ON w.word = near.other GROUP BY near.word
), f AS MATERIALIZED (
    SELECT w.word, CASE WHEN -b.n >= 10 * n THEN b.w END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 10 * n THEN -b.n END AS form_n
    FROM w LEFT JOIN best USING (word)
), path(word, root) AS (
    SELECT word, word FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, path.root, f.n, f.n_near, f.form_n FROM f JOIN path ON path.word = f.word JOIN f g ON g.word = path.root AND g.form IS NULL
"""


def _op13(count: int = 40, rounds: int = 5) -> str:
    """Every round is a pair of subqueries: nearest centroids, then new ones."""
    parts = [f"""
    WITH good AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), x AS MATERIALIZED (
        SELECT r, d, CAST(floor(256 * e[d]) AS BIGINT) AS v FROM good, range(1, 65) s(d)
    ), c0 AS MATERIALIZED (
        SELECT c, d, v FROM (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM good WHERE vec_id IS NOT NULL) JOIN x USING (r) WHERE c < {count}
    )"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
        SELECT r, min({{'s': s, 'c': c}}) AS b FROM (SELECT r, c, sum((x.v - k.v) * (x.v - k.v)) AS s FROM x JOIN c{i} k USING (d) GROUP BY r, c) GROUP BY r
    )""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
        SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v
        FROM (SELECT b.c AS c, d, sum(v) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY 1, 2)
        UNION ALL SELECT c, d, v FROM c{i} WHERE c NOT IN (SELECT b.c FROM a{i})
    )""")
    last = f"""
    SELECT vec_id, CAST(b.c AS INT) AS cluster, CAST(b.s AS BIGINT) AS distance, CAST(sum(b.s) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(b.s) OVER () AS BIGINT) AS inertia, sha256(t) AS centroid_sha256
    FROM a{rounds} JOIN good USING (r) JOIN (SELECT c, string_agg(CAST(v AS VARCHAR), ',' ORDER BY d) AS t FROM c{rounds} GROUP BY c) k ON k.c = b.c"""
    return ", ".join(parts) + last


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_hilbert_sharding, op3_quality_rules, op4_sentencepiece_codec, op5_jaccard_join,
    op6_toxicity, op7_best_fit_packing, op8_html_extraction, op9_lm_scoring, op10_suffix_dedup,
    op11_nearest_neighbours, op12_spelling_variants, op13_centroid_clustering,
)}
ORACLES: dict[str, str] = {"op1_embedding_near_dedup": _OP1, "op3_quality_rules": _OP3, "op5_jaccard_join": _OP5, "op12_spelling_variants": _OP12, "op13_centroid_clustering": _op13()}
