"""Queries of this subpackage over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.centroids import centroid_clusters
from textmill.llm.collocations import collocations
from textmill.llm.common import table
from textmill.llm.decontaminate import contaminations
from textmill.llm.embedding_dedup import embedding_components
from textmill.llm.labels import held_out_column
from textmill.llm.langid import fit_language_model, language_folds, predict_language
from textmill.llm.license_scan import license_digest, scan_licenses
from textmill.llm.line_dedup import line_report
from textmill.llm.minhash_dedup import minhash_components
from textmill.llm.quality import fit_quality, score_quality
from textmill.llm.secret_scan import scan_secrets, span_digest
from textmill.llm.sentencepiece_codec import encode_documents
from textmill.llm.toxicity import fit_toxicity, score_toxicity
from textmill.llm.url_filter import judge_urls


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at 85 percent; see :func:`minhash_components` for edge rows."""
    return minhash_components(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; see :func:`judge_urls` for edge rows."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines to remove of every document, short ones by equality; see :func:`removed_lines` for edge rows."""
    return line_report(table(spark, sf_dir, "documents"), exact_chars=1)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every document's ids, and whether they decode to its text; see :func:`encode_documents` for edge rows."""
    encoded = encode_documents(table(spark, sf_dir, "documents"), check=True)
    return encoded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, base and linked ones; see :func:`scan_secrets` for edge rows."""
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of the other folds; see :func:`predict_language` for edge rows."""
    docs = language_folds(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = fit_language_model(docs.where("not held_out"))
    return predict_language(docs, model, keep=("doc_id", "held_out"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document by a model of the other folds; see :func:`score_quality` for edge rows."""
    docs = held_out_column(table(spark, sf_dir, "documents").select("doc_id", "text"), folds=5, held_out=0)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return score_quality(docs, model, keep=("doc_id", "held_out"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label; see :func:`embedding_components` for edge rows."""
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents; see :func:`contaminations` for edge rows."""
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document by a model of the other folds; see :func:`score_toxicity` for edge rows."""
    docs = held_out_column(table(spark, sf_dir, "documents").select("doc_id", "text"), folds=3, held_out=1)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    return score_toxicity(docs, model, keep=("doc_id", "held_out")).withColumn("n_passages", F.size("passages")).drop("passages")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, exact places and edited ones; see :func:`scan_licenses` for edge rows."""
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language; see :func:`collocations` for edge rows."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every sound vector; see :func:`centroid_clusters` for edge rows."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_license_scan": op11_license_scan,
    "op12_collocations": op12_collocations,
    "op13_centroids": op13_centroids,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ASSIGN = """a{now} AS MATERIALIZED (
  SELECT vec_id, s.p, c, list_sum(list_transform(list_zip(s.p, k.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM sound s, c{old} k
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
)"""
_ROUND = (
    _ASSIGN
    + """, m{now} AS (
  SELECT c, i, sum(p[i]) AS t, count(*) AS n FROM a{now}, unnest(range(1, 65)) AS u(i) GROUP BY c, i
), c{now} AS MATERIALIZED (
  SELECT c, coalesce(q, k.p) AS p FROM c{old} k
  LEFT JOIN (SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM m{now} GROUP BY c) USING (c)
)"""
)

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM word, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM shared JOIN size i ON i.doc_id = a JOIN size j ON j.doc_id = b WHERE 100 * shared.n >= 85 * (i.n + j.n - shared.n)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.id
), component AS (
  SELECT id, min(c) AS c FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = d.doc_id AS kept FROM documents d JOIN component ON id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
""",
    "op8_embedding_dedup": r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.id
), component AS (
  SELECT id, min(c) AS c FROM reach GROUP BY id
)
SELECT v.vec_id, (SELECT count(*) FROM edge WHERE a = v.vec_id) AS n_links, c AS component_id, c = v.vec_id AS kept FROM embeddings v JOIN component ON id = v.vec_id
""",
    "op9_decontamination": r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), item AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), item_sh AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[i : i + 4], ' ') AS s
  FROM item, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), size AS (
  SELECT item_id, count(*) AS n_item FROM item_sh GROUP BY item_id
), length AS (
  SELECT DISTINCT least(len(w), 5) AS n FROM item WHERE len(w) > 0
), doc_sh AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM doc, length, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)
)
SELECT d.doc_id, i.item_id, any_value(z.n_item) AS n_item, count(*) AS n_shared, round(count(*) / any_value(z.n_item), 6) AS containment
FROM doc_sh d JOIN item_sh i USING (s, n) JOIN size z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) * 100 >= any_value(z.n_item) * 80
""",
    "op2_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS rest FROM cut
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM part
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT n.page_id, n.host, n.path, r.h || r.p AS rule, r.verdict,
    row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS rn
  FROM named n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)
)
SELECT n.page_id, n.host, n.path, b.rule,
  CASE WHEN b.rule IS NOT NULL THEN b.verdict
       WHEN n.host LIKE 'spam-%' OR ('.' || n.host) LIKE '%.cheap-pills.%' OR n.host LIKE '%casino%' OR n.path LIKE '%.exe'
       THEN 'block' ELSE 'allow' END AS verdict
FROM named n LEFT JOIN best b ON b.page_id = n.page_id AND b.rn = 1
""",
    "op12_collocations": rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), word AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM word
), f AS MATERIALIZED (
  SELECT lang, len(string_split(phrase, ' ')) AS m, phrase, count(*) AS f FROM gram GROUP BY lang, phrase
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), candidate AS MATERIALIZED (
  SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10
), cut AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp FROM candidate, unnest(range(1, m)) AS t(k)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score, k
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored
), inside AS (
  SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(f) AS most FROM candidate, unnest([1, 2]) AS t(i) WHERE m = 3 GROUP BY 1, 2
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE pick = 1 AND NOT coalesce(100 * most >= 50 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
    "op13_centroids": f"""
WITH sound AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS c, p FROM sound QUALIFY c < 8
), {", ".join(_ROUND.format(now=n, old=n - 1) for n in range(1, 11))}, {_ASSIGN.format(now=11, old=10)}, cluster AS (
  SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a11 GROUP BY c
)
SELECT vec_id, a11.c AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a11) AS inertia, sha256(array_to_string(c10.p, ',')) AS centroid_sha256
FROM a11 JOIN cluster USING (c) JOIN c10 USING (c)
""",
}
