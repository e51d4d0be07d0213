"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import centroids, ctw_score, curve_pack, decontaminate, exact_dedup, line_dedup, near_join, orc_tokens, phrase_dedup, quality_pu, secret_scan, sketch_dedup, spelling
from threadloom.llm.common import load
from threadloom.llm.tokens import default_vocabulary


def op1_curve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_pack.report(load(spark, sf_dir, "documents"), default_vocabulary())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(load(spark, sf_dir, "documents"))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.report(load(spark, sf_dir, "documents"), default_vocabulary())


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score.report(load(spark, sf_dir, "documents"))


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.report(load(spark, sf_dir, "documents"))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.report(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(load(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(load(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(load(spark, sf_dir, "embeddings"))


def op13_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.report(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


#: The hash is the usual reflected CRC-32: its table by rule, then a fold over the UTF-8 bytes. Near words meet on a word with one
#: letter masked (replacements) or left out (deletions, insertions).
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), lookup AS (
  SELECT list(c ORDER BY i) AS places FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), distinct_runs AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)) AS b
  FROM distinct_runs
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, places[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, lookup
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), less AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM places
), masked AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS mask FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word
  UNION ALL
  SELECT l.word, v.word, v.n FROM less l JOIN vocabulary v ON l.cut = v.word
  UNION ALL
  SELECT v.word, l.word, l.n FROM less l JOIN vocabulary v ON l.cut = v.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, walk.at AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN walk ON walk.word = forms.word JOIN forms ends ON ends.word = walk.at WHERE ends.form IS NULL
"""


#: All pairs of different sets that share a shingle; the reported rows are the same as by bands unless a link shares no band (below 3e-8 a link).
OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS own FROM d
), sets AS (
  SELECT row_number() OVER () AS id, own, len(own) AS n FROM (SELECT DISTINCT own FROM s WHERE len(own) > 0)
), words AS (
  SELECT id, n, unnest(own) AS x FROM sets
), links AS (
  SELECT a.id AS a, b.id AS b FROM words a JOIN words b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS start, a AS at FROM both_ways UNION SELECT start, b FROM reach JOIN both_ways ON at = a
), led AS (
  SELECT sets.id, coalesce(at, sets.id) AS other FROM sets LEFT JOIN reach ON sets.id = start
), members AS (
  SELECT s.doc_id, sets.id, sets.n FROM s JOIN sets USING (own)
), least_of AS (
  SELECT led.id, min(doc_id) AS component_id FROM led JOIN members ON members.id = led.other GROUP BY led.id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM members JOIN least_of USING (id)
UNION ALL
SELECT doc_id, 0, doc_id, true FROM s WHERE len(own) = 0
"""


def _op12_sql(rounds: int = centroids.ROUNDS, k: int = centroids.K) -> str:
    """The rounds written out: a vector is its components by place, a distance their sum."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, c) - 1 AS j, c FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, c FROM v) QUALIFY j < {k}
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, c, first(j ORDER BY d, j) AS j, min(d) AS d
  FROM (SELECT v.r, v.vec_id, v.c, m.j, list_sum(list_transform(list_zip(v.c, m.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} m) GROUP BY ALL
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT old.j, coalesce(new.c, old.c) AS c FROM c{i} old LEFT JOIN (
    SELECT j, list(CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY place) AS c
    FROM (SELECT j, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(c) AS x, generate_subscripts(c, 1) AS place FROM a{i}) GROUP BY ALL) GROUP BY j
  ) new ON old.j = new.j
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.j = m.j"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op11_spelling_variants": OP11_SQL, "op12_centroid_clustering": _op12_sql(), "op13_sketch_dedup": OP13_SQL}
