"""Queries of the llm problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import bpe, functions, handwritten, languages, mixing, nearpairs, parsing, repetition, vectors

QUERIES = {}
ORACLE = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def p1_found(spark, sf):
    return handwritten.not_handwritten(_table(spark, sf, "vector_records"))


@_query
def p1_scores(spark, sf):
    return handwritten.scored(_table(spark, sf, "vector_records"))


@_query
def p2_found(spark, sf):
    model = languages.train(_table(spark, sf, "documents"))
    return languages.shares(_table(spark, sf, "code_chunks"), model).filter("share >= 0.05").select("file_path", "lang")


@_query
def p2_shares(spark, sf):
    return languages.shares(_table(spark, sf, "code_chunks"), languages.train(_table(spark, sf, "documents")))


@_query
def p3_found(spark, sf):
    return functions.documented_ids(_table(spark, sf, "code_chunks"))


@_query
def p3_pairs(spark, sf):
    return functions.pairs(_table(spark, sf, "code_chunks"))


@_query
def p5_found(spark, sf):
    return vectors.similar_pairs(_table(spark, sf, "vector_records"))


@_query
def p6_found(spark, sf):
    return nearpairs.near_pairs(_table(spark, sf, "vector_records"))


@_query
def p6_groups(spark, sf):
    return nearpairs.near_groups(_table(spark, sf, "vector_records"))


@_query
def p7_found(spark, sf):
    return parsing.check_files(_table(spark, sf, "code_chunks")).filter("not ok").select("file_path")


@_query
def p7_rates(spark, sf):
    return parsing.rates(parsing.check_files(_table(spark, sf, "code_chunks")), _table(spark, sf, "repos"))


@_query
def p8_ids(spark, sf):
    return bpe.encode_corpus(_table(spark, sf, "documents"))


@_query
def p9_mix(spark, sf):
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[1]


@_query
def p9_drawn(spark, sf):
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[0].filter("repeats > 0")


@_query
def p10_found(spark, sf):
    d = repetition.repeated_share(_table(spark, sf, "documents"))
    return d.filter((F.col("n_words") >= 40) & (F.col("n_repeated") * 10 >= F.col("n_words") * 3)).select("doc_id")


@_query
def p10_lines(spark, sf):
    return repetition.line_frequency(_table(spark, sf, "documents")).drop("common")


@_query
def p10_cleaned(spark, sf):
    return repetition.without_common_lines(_table(spark, sf, "documents"))


_P10_LINES = r"""
WITH p AS (
  SELECT doc_id, repo_id, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM documents
), l AS (
  SELECT doc_id, repo_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM p
), m AS (
  SELECT *, regexp_replace(lower(trim(line, ' ')), '[0-9]', '0', 'g') AS k FROM l
), n AS (
  SELECT doc_id, repo_id, k, count(*) AS c FROM m WHERE k <> '' GROUP BY ALL
), hot AS (SELECT repo_id, k FROM n GROUP BY ALL HAVING count(*) > 20
), lines AS (
  SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(CASE WHEN hot.k IS NULL THEN 0 ELSE c END)::BIGINT AS n_common,
    sum(CASE WHEN hot.k IS NULL THEN 0 ELSE c END) <= 0.5 * sum(c) AS kept
  FROM n LEFT JOIN hot ON n.k = hot.k AND n.repo_id IS NOT DISTINCT FROM hot.repo_id GROUP BY doc_id
)
"""
ORACLE["p10_lines"] = _P10_LINES + "SELECT * FROM lines"
ORACLE["p10_cleaned"] = _P10_LINES + """
SELECT m.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.k IS NULL), '') AS text
FROM m JOIN lines ON m.doc_id = lines.doc_id AND lines.kept LEFT JOIN hot ON m.k = hot.k AND m.repo_id IS NOT DISTINCT FROM hot.repo_id
GROUP BY m.doc_id
"""

# The current rows of vector_records; where an id has rows of one indexed_at that differ, the operators have their own rules.
_CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM vector_records WHERE id IS NOT NULL) WHERE rn = 1)"""

ORACLE["p5_found"] = f"""
WITH {_CURRENT}, v AS (
  SELECT id, vector::DOUBLE[] AS x FROM cur WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.id <> b.id
), r AS (
  SELECT a, b, c FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 13) DESC, b) <= 5
) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE c >= 0.9
"""

_SETS = f"""{_CURRENT}, t AS (
  SELECT id, lower(coalesce(signature, '') || chr(10) || coalesce(content, '')) AS text FROM cur
), w AS (
  SELECT id, text, regexp_extract_all(text, '[a-z0-9_]+') AS w FROM t
), g AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3
), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1
), p AS (
  SELECT x.id AS id_a, y.id AS id_b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY ALL
), near AS (
  SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE shared >= 0.7 * (a.n + b.n - shared) - 1e-9
)"""
ORACLE["p6_found"] = f"WITH {_SETS} SELECT id_a, id_b FROM near"
ORACLE["p6_groups"] = f"""
WITH {_SETS}, m AS (
  SELECT id, first_value(id) OVER (PARTITION BY text ORDER BY id) AS cls, count(*) OVER (PARTITION BY text) AS copies FROM t WHERE id IN (SELECT id FROM n)
), l AS (
  SELECT a.cls AS x, b.cls AS y FROM near JOIN m a ON a.id = id_a JOIN m b ON b.id = id_b WHERE a.cls <> b.cls
), links AS (SELECT cls, count(DISTINCT other) AS links FROM (SELECT x AS cls, y AS other FROM l UNION ALL SELECT y, x FROM l) GROUP BY 1)
SELECT id, m.cls, copies, coalesce(links, 0) AS links FROM m LEFT JOIN links ON m.cls = links.cls
"""
ORACLE["p10_found"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '([\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 40
), g AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + 7], ' ') AS g FROM s
), r AS (
  SELECT doc_id, n, i FROM g QUALIFY i > min(i) OVER (PARTITION BY doc_id, g)
), m AS (
  SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS at FROM r
) SELECT doc_id FROM m GROUP BY doc_id, n HAVING count(*) * 10 >= n * 3
"""
