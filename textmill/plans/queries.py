"""Queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions import udfs as U
from textmill.operators import chat, leakage, mixing, ordered, scoring
from textmill.sources import scratch, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = r"list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"
#: Runs of ten equal characters, spelled out for the characters of the driver's texts: RE2 has no backreferences.
_RUNS = "|".join("[" + chr(92) + f"x{{{n:x}}}]" + "{10}" for n in (*range(0x20, 0x7F), *range(0xA1, 0x100)))
_WEB = rf"""
webbed AS (SELECT doc_id, lang, source, array_to_string({_LINES}, chr(10)) AS t FROM documents),
web AS (
  SELECT doc_id, lang, source, t FROM webbed
  WHERE length(t) BETWEEN 200 AND 30000 AND len(regexp_extract_all(t, 'https?://')) <= 5
    AND NOT regexp_matches(t, '{_RUNS}')
)"""


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", T.clean_web(F.col("text"), min_script_ratio=0, more="").alias("t")).where("t is not null")


@query(rf"""
WITH {_WEB}, first AS (
  SELECT *, row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id) AS rn FROM web
), kept AS (
  SELECT doc_id, lang, t, CASE WHEN ('0x' || substr(md5(t), 1, 8))::BIGINT % 1000 < 3 THEN 'val' ELSE 'train' END AS split FROM first WHERE rn = 1
), budget AS (
  SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kept
)
SELECT lang, split, count(*) AS n_docs, sum(length(t))::BIGINT AS n_chars FROM budget WHERE before < 300000 GROUP BY lang, split
""")
def corpus_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, keep first copies, split by hash, cut at a budget of characters per language, and count."""
    kept = ordered.keep_first(_web(spark, sf_dir), F.md5("t"), ["doc_id"]).withColumn("split", T.split_bucket(F.col("t")))
    cut = ordered.within_budget(kept, ["lang"], "doc_id", F.length("t"), 300_000)
    return cut.groupBy("lang", "split").agg(F.count("*").alias("n_docs"), F.sum(F.length("t")).alias("n_chars"))


@query(rf"""
WITH headed AS (SELECT doc_id, array_to_string(list_filter({_LINES}, lambda x: NOT regexp_full_match(x, '=+\s*.*?\s*=+')), chr(10)) AS cleaned FROM (
  SELECT doc_id, '== Heading ==' || chr(10) || text AS text FROM documents))
SELECT doc_id, md5(cleaned) AS h, length(cleaned)::INTEGER AS n FROM headed WHERE length(cleaned) >= 200
""")
def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.concat(F.lit("== Heading ==\n"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.clean_article(headed).alias("t"))
    return docs.where("t is not null").select("doc_id", F.md5("t").alias("h"), F.length("t").alias("n"))


@query(f"WITH {_WEB} SELECT doc_id, md5(t) AS h, length(t)::INTEGER AS n FROM web")
def clean_web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).select("doc_id", F.md5("t").alias("h"), F.length("t").alias("n"))


@query(r"""
WITH spaced AS (
  SELECT doc_id, array_to_string(list_transform(string_split(replace(replace(replace(text, '. ', '.' || chr(9) || ' '), chr(13) || chr(10), chr(10)), chr(9), '    '), chr(10)),
    lambda x: rtrim(x, ' ' || chr(13))), chr(10)) AS t FROM documents
), code AS (SELECT doc_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS t FROM spaced)
SELECT doc_id, md5(t) AS h, length(t)::INTEGER AS n FROM code WHERE length(t) BETWEEN 60 AND 4000
""")
def clean_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabbed = F.regexp_replace("text", r"\. ", ".\t ")
    docs = table(spark, sf_dir, "documents").select("doc_id", T.clean_code(tabbed).alias("t"))
    return docs.where("t is not null").select("doc_id", F.md5("t").alias("h"), F.length("t").alias("n"))


@query("""
SELECT source, CASE WHEN ('0x' || substr(md5(text), 1, 8))::BIGINT % 1000 < 3 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN (((('0x' || substr(md5(text), 1, 8))::BIGINT % 1000 * 296 + ('0x' || substr(md5(text), 9, 8))::BIGINT) % 1000 * 296
      + ('0x' || substr(md5(text), 17, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(md5(text), 25, 8))::BIGINT) % 1000 < 10 THEN 'val' ELSE 'train' END AS whole_split,
  count(*) AS n, min(substr(sha256(text), 1, 16)) AS least_fingerprint
FROM documents GROUP BY ALL
""")
def hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    return docs.groupBy("source", T.split_bucket(text).alias("split"), T.split_whole_hash(text).alias("whole_split")).agg(
        F.count("*").alias("n"), F.min(T.fingerprint(text)).alias("least_fingerprint")
    )


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")
def keep_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return ordered.keep_first(docs, F.col("h"), ["doc_id"])


@query("""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents
) WHERE before < 100000
""")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.within_budget(table(spark, sf_dir, "documents"), ["lang"], "doc_id", F.length("text"), 100_000).select("doc_id", "lang")


_PAIRS = r"""
turns AS (
  SELECT conv_id, turn, lower(role) AS r, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q,
    lower(lead(role) OVER w) AS r2, trim(regexp_replace(lead(text) OVER w, '\s+', ' ', 'g')) AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), pairs AS (
  SELECT conv_id, arg_min(q, turn) AS q, arg_min(a, turn) AS a FROM turns WHERE r = 'user' AND r2 = 'assistant' GROUP BY conv_id
)"""


@query(rf"""
WITH {_PAIRS}, good AS (SELECT * FROM pairs WHERE q <> '' AND a <> '' AND length(q) <= 120 AND length(a) <= 300
  AND NOT regexp_matches(q, 'https?://') AND NOT regexp_matches(a, 'https?://'))
SELECT format('chat_{{:06d}}', row_number() OVER (ORDER BY conv_id) - 1) AS id, conv_id, q, a FROM good
""")
def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.first_pairs(table(spark, sf_dir, "conversations"))
    kept = pairs.where(T.keep_pair(F.col("q"), F.col("a"), 120, 300))
    return ordered.numbered(kept, [], "conv_id", F.lit("chat")).select("id", "conv_id", "q", "a")


@query(rf"""
WITH {_PAIRS}, shaped AS (
  SELECT *, CASE WHEN q = '' OR a = '' THEN 'format' WHEN length(q) > 120 OR length(a) > 300 OR regexp_matches(q, 'https?://') OR regexp_matches(a, 'https?://') THEN 'length_or_url' END AS shape,
    contains(q, 'thing') AS leak FROM pairs
), kept AS (SELECT q, min(conv_id) AS first FROM shaped WHERE shape IS NULL AND NOT leak GROUP BY q)
SELECT coalesce(shape, CASE WHEN conv_id > first THEN 'duplicate' WHEN leak THEN 'leak' ELSE 'kept' END) AS reason, count(*) AS n FROM shaped LEFT JOIN kept USING (q) GROUP BY reason
""")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why first pairs of conversations are left out; a word stands in for the held-out set."""
    judged = chat.exclusion_reasons(chat.first_pairs(table(spark, sf_dir, "conversations")), "conv_id", 120, 300, F.col("q").contains("thing"))
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_NORM = "translate(regexp_replace(lower({}), '\\d+', '0', 'g'), '" + T.IGNORED.replace("'", "''") + "', '')"
#: Distinct pairs of a list of characters.
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1]))"


@query(f"""
WITH d AS MATERIALIZED (SELECT doc_id, string_split({_NORM.format('text')}, '') AS t FROM documents), b AS MATERIALIZED (SELECT item_id, string_split({_NORM.format('text')}, '') AS t FROM benchmark),
dg AS (SELECT doc_id, len({_GRAMS.format('t')}) AS n, unnest({_GRAMS.format('t')}) AS g FROM d),
bg AS (SELECT item_id, len({_GRAMS.format('t')}) AS m, unnest({_GRAMS.format('t')}) AS g FROM b)
SELECT doc_id, item_id, round(count(*) / (any_value(n) + any_value(m) - count(*)), 9) AS similarity FROM dg JOIN bg USING (g)
GROUP BY doc_id, item_id HAVING count(*) / (any_value(n) + any_value(m) - count(*)) >= 0.5
""")
def heldout_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = scratch.spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "benchmark")
    norm = U.comparable_folded(F.col("text"))
    rows, other = docs.select("doc_id", norm.alias("dn")), held.select("item_id", norm.alias("bn"))
    found = leakage.leaks(rows, "doc_id", F.col("dn"), other, "item_id", F.col("bn"), threshold=0.5)
    return found.withColumn("similarity", F.round("similarity", 9))


_TIGHT = "regexp_replace(text, '\\s+', '', 'g')"


@query(f"""
WITH d AS MATERIALIZED (SELECT doc_id, string_split({_TIGHT}, '') AS t FROM documents), b AS MATERIALIZED (SELECT item_id, string_split({_TIGHT}, '') AS t FROM benchmark),
dg AS (SELECT doc_id, unnest({_GRAMS.format('t')}) AS g FROM d), bg AS (SELECT item_id, len({_GRAMS.format('t')}) AS m, unnest({_GRAMS.format('t')}) AS g FROM b)
SELECT item_id, count(*) AS n_docs, round(max(share), 9) AS best FROM (
  SELECT doc_id, item_id, count(*) / any_value(m) AS share FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id HAVING count(*) / any_value(m) >= 0.95) GROUP BY item_id
""")
def heldout_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each held-out text's character pairs in documents."""
    bare = T.bigrams(F.regexp_replace("text", "(?U)\\s+", ""), False)
    docs = scratch.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", bare.alias("grams"))
    held = table(spark, sf_dir, "benchmark").select("item_id", bare.alias("grams"))
    found = leakage.gram_matches(docs, "doc_id", F.col("grams"), held, "item_id", F.col("grams"), 0.95, of_held=True)
    share = F.col("shared") / F.col("m")
    return found.where(share >= 0.95).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max(share), 9).alias("best"))




_STEPS = r"""
steps AS (
  SELECT *, CASE WHEN trim(cot, ' ' || chr(10)) = '' THEN 0 ELSE greatest(len(list_filter(string_split(cot, chr(10)), lambda x: trim(x) <> '')),
    len(regexp_extract_all(cot, 'まず|次に|そして|よって|したがって|最後に|つまり')), 1) END AS s FROM rows
), parts AS (
  SELECT *, CASE WHEN s >= 3 THEN 0.95 WHEN s = 2 THEN 0.75 WHEN s = 1 THEN 0.5 ELSE 0.0 END AS completeness,
    CASE WHEN length(cot) = 0 OR s = 0 THEN 0.0 WHEN length(cot) / s BETWEEN 15 AND 60 THEN 0.95 WHEN length(cot) / s < 15 THEN 0.6 WHEN length(cot) / s <= 100 THEN 0.75 ELSE 0.4 END AS conciseness FROM steps
), scored AS (SELECT *, (0.6::DOUBLE + completeness::DOUBLE + conciseness::DOUBLE) / 3 AS score FROM parts)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cot = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("まず、次に、"), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", cot.alias("cot"))
    return scoring.rubric(rows, F.col("cot"), F.lit(""), F.col("lang"), arithmetic=False)


_ROWS = "rows AS (SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN 'まず、次に、' || text ELSE text END AS cot FROM documents)"


@query(f"WITH {_ROWS}, {_STEPS} SELECT doc_id, completeness::DOUBLE AS completeness, conciseness::DOUBLE AS conciseness, round(score, 9) AS score, CASE WHEN score >= 0.75 THEN 'adopt' ELSE 'revise' END AS status FROM scored")
def reasoning_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "completeness", "conciseness", F.round("score", 9).alias("score"), "status")


@query(f"""WITH {_ROWS}, {_STEPS} SELECT count(*) AS total, count(*) FILTER (cot <> '' AND score >= 0.75) AS adopt, count(*) FILTER (cot <> '' AND score < 0.75) AS revise, 0::BIGINT AS reject,
  count(*) FILTER (cot <> '') AS manual_review, round(avg(score) FILTER (cot <> ''), 9) AS avg_score, round(count(*) FILTER (cot <> '' AND score >= 0.75) / count(*) FILTER (cot <> ''), 9) AS gate_rate,
  round(count(*) FILTER (cot <> '' AND score >= 0.75) / count(*), 9) AS adopt_rate, count(*) FILTER (cot <> '' AND score >= 0.75) / count(*) FILTER (cot <> '') >= 0.8 AS gate_passed FROM scored""")
def rubric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scoring.rubric_stats(_scored(spark, sf_dir), F.col("cot") != "")
    return stats.withColumns({c: F.round(c, 9) for c in ("avg_score", "gate_rate", "adopt_rate")})


_RESULTS = """results AS (
  SELECT d.lang AS category, d.source AS type, CASE WHEN l.toxic = 1 THEN 'refuse' ELSE 'answer' END AS behavior, d.doc_id % 5 <> 0 AS guard_pass,
    d.doc_id % 7 = 0 AS model_refused, CASE WHEN l.toxic = 0 THEN l.quality = 1 END AS model_correct,
    CASE WHEN l.toxic = 1 THEN d.doc_id % 5 = 0 OR d.doc_id % 7 = 0 ELSE l.quality = 1 AND d.doc_id % 5 <> 0 END AS e2e_correct
  FROM documents d JOIN labels l USING (doc_id))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    behavior = F.when(F.col("toxic") == 1, "refuse").otherwise("answer")
    guard, refused, correct = F.col("doc_id") % 5 != 0, F.col("doc_id") % 7 == 0, F.col("quality") == 1
    return rows.select(
        F.col("lang").alias("category"), F.col("source").alias("type"), behavior.alias("behavior"), guard.alias("guard_pass"), refused.alias("model_refused"),
        F.when(behavior == "answer", correct).alias("model_correct"), scoring.outcome(behavior, correct, guard, refused).alias("e2e_correct"),
    )


_RATES = """count(*) AS n, count(*) FILTER (behavior = 'answer') AS n_inscope,
  round(avg(coalesce(model_correct, false)::INT) FILTER (behavior = 'answer'), 9) AS model_acc, round(avg(guard_pass::INT) FILTER (behavior = 'answer'), 9) AS guard_pass,
  round(avg(e2e_correct::INT) FILTER (behavior = 'answer'), 9) AS e2e_acc, round(avg(model_refused::INT) FILTER (behavior = 'answer'), 9) AS false_refusal,
  count(*) FILTER (behavior = 'refuse') AS n_refuse, round(avg(e2e_correct::INT) FILTER (behavior = 'refuse'), 9) AS refusal_rate,
  round(avg((NOT guard_pass)::INT) FILTER (behavior = 'refuse'), 9) AS guard_refusal, round(avg(model_refused::INT) FILTER (behavior = 'refuse'), 9) AS model_refusal,
  round(avg(e2e_correct::INT), 9) AS overall_e2e"""
_METRICS = ["model_acc", "guard_pass", "e2e_acc", "false_refusal", "refusal_rate", "guard_refusal", "model_refusal", "overall_e2e"]


@query(f"WITH {_RESULTS} SELECT category, type, grouping(category, type)::BIGINT AS level, {_RATES} FROM results GROUP BY GROUPING SETS ((), (category), (type))")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.evaluation_summary(_results(spark, sf_dir)).withColumns({m: F.round(m, 9) for m in _METRICS})


@query(f"""WITH {_RESULTS}, now AS (SELECT category, avg(e2e_correct::INT) AS e2e FROM results GROUP BY category),
before AS (SELECT category, avg(e2e_correct::INT) AS e2e FROM results WHERE type < 'src2' AND category <> 'es' GROUP BY category)
SELECT now.category, round(now.e2e, 9) AS e2e, round((now.e2e - before.e2e) * 100, 6) AS e2e_change FROM now LEFT JOIN before USING (category)""")
def evaluation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    rate = lambda df: df.groupBy("category").agg(F.avg(F.col("e2e_correct").cast("int")).alias("e2e"))
    found = scoring.deltas(rate(results), rate(results.where("type < 'src2' and category <> 'es'")), "category", ["e2e"])
    return found.select("category", F.round("e2e", 9).alias("e2e"), F.round("e2e_change", 6).alias("e2e_change"))


@query(f"""WITH {_PAIRS}, t AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'arithmetic' ELSE 'code' END AS category,
  regexp_replace(regexp_replace(a, '\\s+', '', 'g'), '[。、．，,.]', '', 'g') AS p, regexp_replace(regexp_replace(CASE WHEN conv_id % 2 = 0 THEN a ELSE q END, '\\s+', '', 'g'), '[。、．，,.]', '', 'g') AS r FROM pairs),
pc AS (SELECT conv_id, ch, count(*) AS n FROM (SELECT conv_id, unnest(string_split(p, '')) AS ch FROM t) GROUP BY ALL), rc AS (SELECT conv_id, ch, count(*) AS n FROM (SELECT conv_id, unnest(string_split(r, '')) AS ch FROM t) GROUP BY ALL),
same AS (SELECT conv_id, sum(least(pc.n, rc.n)) AS s FROM pc JOIN rc USING (conv_id, ch) GROUP BY conv_id),
f AS (SELECT t.*, CASE WHEN p = '' OR r = '' THEN (p = r)::INT::DOUBLE WHEN s IS NULL THEN 0.0 ELSE 2.0 * s / (length(p) + length(r)) END AS f1 FROM t LEFT JOIN same USING (conv_id))
SELECT round(avg((p = r)::INT) FILTER (category = 'qa'), 9) AS em, round(avg(f1) FILTER (category = 'qa'), 9) AS f1, round(avg((p = r)::INT) FILTER (category = 'arithmetic'), 9) AS accuracy FROM f""")
def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.first_pairs(table(spark, sf_dir, "conversations"))
    category = F.element_at(F.array(F.lit("qa"), F.lit("arithmetic"), F.lit("code")), (F.col("conv_id") % 3 + 1).cast("int"))
    ref = F.when(F.col("conv_id") % 2 == 0, F.col("a")).otherwise(F.col("q"))
    keyed = pairs.select(category.alias("category"), U.answer_key(F.col("a")).alias("p"), U.answer_key(ref).alias("r"))
    found = scoring.match_metrics(keyed, F.col("p"), F.col("r"), F.col("category"))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query(f"""WITH {_RESULTS} SELECT category, count(*) AS n, round(avg(e2e_correct::INT), 9) AS accuracy,
  CASE WHEN avg(e2e_correct::INT) >= 0.8 THEN 'good' WHEN avg(e2e_correct::INT) >= 0.3 THEN 'weak' ELSE 'bad' END AS verdict FROM results GROUP BY ROLLUP (category)""")
def sanity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.verdicts(_results(spark, sf_dir), "category", F.col("e2e_correct")).withColumn("accuracy", F.round("accuracy", 9))


@query(r"""WITH t AS (SELECT source, text, regexp_replace(text, '\s+', '', 'g') AS s, CASE WHEN doc_id % 2 = 0 THEN [lang, 'the'] ELSE [] END AS k FROM documents),
c AS MATERIALIZED (SELECT *, string_split(s, '') AS cs FROM t),
r AS (SELECT *, CASE WHEN length(s) < 11 THEN 0.0 ELSE 1 - len(list_distinct(list_transform(range(1, len(cs) - 2), lambda i: cs[i] || cs[i + 1] || cs[i + 2] || cs[i + 3]))) / (length(s) - 3) END AS rep,
  CASE WHEN len(k) > 0 THEN (contains(text, k[1]) OR contains(text, k[2]))::INT END AS hit FROM c)
SELECT source, round(avg(rep), 3) AS repetition, count(*) FILTER (rep >= 0.5) AS n_repetitive, round(avg(hit), 3) AS hit_rate, round(avg(length(text)), 1) AS mean_length FROM r GROUP BY source""")
def decoding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("the"))).otherwise(F.array().cast("array<string>"))
    return scoring.decoding_summary(table(spark, sf_dir, "documents"), "source", F.col("text"), keys)


@query("""WITH d AS (SELECT doc_id AS id, md5(text) AS input, substr(source, 4)::INTEGER % 4 AS role FROM documents),
t AS (SELECT id, input, 'template' AS src FROM d WHERE role = 0), p AS (SELECT id, input, 'public' AS src FROM d WHERE role IN (1, 2)), r AS (SELECT id, input, 'refusal' AS src FROM d WHERE role IN (2, 3)),
kept AS (SELECT * FROM t ORDER BY md5('0:' || id), id LIMIT (SELECT count(*) FROM p)), everything AS (SELECT * FROM kept UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r WHERE input NOT IN (SELECT input FROM p))
SELECT id, src, CASE WHEN row_number() OVER (ORDER BY md5('1:' || id || '/' || src), id || '/' || src) <= 10 THEN 'val' ELSE 'train' END AS split FROM everything""")
def mixed_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all sources mixed, each source with a role or two."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("input"), (F.substring("source", 4, 9).cast("int") % 4).alias("role"))
    of = lambda roles, name: docs.where(F.col("role").isin(*roles)).select("id", "input", F.lit(name).alias("src"))
    rows = mixing.mixed(of([0], "template"), of([1, 2], "public"), of([2, 3], "refusal"), "id", "input")
    keyed = rows.withColumn("key", F.concat_ws("/", "id", "src"))
    return mixing.positional_split(keyed, "key", 10, seed="1").select("id", "src", "split")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE ceil((i + 1) * 37 / n) > ceil(i * 37 / n)")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.systematic_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 37)


@query("""WITH t AS (SELECT source, sum(length(text)) AS total FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY source)
SELECT doc_id, source FROM documents JOIN t USING (source) WHERE ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < least(1.0, CASE source WHEN 'src1' THEN 30000.0 WHEN 'src2' THEN 60000.0 ELSE 1e9 END / total)""")
def budgeted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source in ('src1', 'src2', 'src3')")
    return mixing.sampled_by_budget(docs, "source", F.length("text"), {"src1": 30_000.0, "src2": 60_000.0, "src3": 1e9}, "doc_id").select("doc_id", "source")


@query("""SELECT doc_id, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.4 AND length(text) > 0 AS has_cot,
  CASE WHEN ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.4 THEN length(text) ELSE 0 END::INTEGER AS n FROM documents""")
def reasoning_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("cot"))
    return mixing.keep_reasoning(rows, "doc_id", 0.4).select("doc_id", "has_cot", F.length("cot").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, '      x' || chr(9) || text AS s FROM documents), l AS (SELECT doc_id, string_split(replace(s, chr(9), '    '), chr(10)) AS ls FROM t),
e AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x: repeat('<i>', ((length(x) - length(ltrim(x, ' '))) // 4)::BIGINT) || ltrim(x, ' ')), '<nl>') AS e FROM l)
SELECT doc_id, md5(e) AS encoded, md5(replace(replace(ltrim(regexp_replace(e, '(<nl>|<i>) ', '\1', 'g'), ' '), '<i>', '    '), '<nl>', chr(10))) AS decoded FROM e""")
def layout_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = T.encode_layout(F.concat(F.lit("      x\t"), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("e")).select("doc_id", F.md5("e").alias("encoded"), F.md5(T.decode_layout(F.col("e"))).alias("decoded"))


@query("""WITH t AS (SELECT p_partkey, list_transform(range(1, octet_length(encode(p_name)) + 1), lambda i: ('0x' || substr(hex(encode(p_name)), (2 * i - 1)::BIGINT, 2))::INT + 256) AS ids FROM part)
SELECT p_partkey, array_to_string(list_concat([1], ids, [2])[1:12], ',') AS ids, len(ids)::INTEGER AS n FROM t""")
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    rows = table(spark, sf_dir, "part").select("p_partkey", T.byte_tokens(F.col("p_name")).alias("ids"))
    return rows.select("p_partkey", F.array_join(T.sequence_ids(F.col("ids"), none, none, 1, 2, 12), ",").alias("ids"), F.size("ids").alias("n"))


@query("""SELECT lang, count(*) AS n_docs, sum(octet_length(encode(text)) + 1)::BIGINT AS n_tokens, round(sum(length(text)) / sum(octet_length(encode(text)) + 1), 3) AS chars_per_token FROM documents GROUP BY lang""")
def packed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text", F.length("text").alias("chars"))
    packed = writers.packed_tokens(docs, T.byte_tokens(F.col("text")), 2, 512, "lang", "chars")
    return packed.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.round(F.try_divide(F.sum("chars"), F.sum(F.size("ids"))), 3).alias("chars_per_token"))


@query("""WITH q AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || 'とは何ですか？' WHEN 1 THEN p_name || 'の' || p_brand || 'はどこですか？' WHEN 2 THEN p_name || 'は' || p_type || 'でしょうか？' ELSE p_name END AS q FROM part)
SELECT id, CASE WHEN contains(q, 'とは') THEN split_part(q, 'とは', 1) WHEN contains(q, 'の') THEN split_part(q, 'の', 1) WHEN contains(q, 'は') THEN split_part(q, 'は', 1) ELSE q END AS entity,
  CASE id % 4 WHEN 0 THEN '何です' WHEN 1 THEN (SELECT p_brand FROM part p WHERE p.p_partkey = id) WHEN 2 THEN (SELECT p_type FROM part p WHERE p.p_partkey = id) END AS attribute,
  CASE id % 4 WHEN 0 THEN split_part(q, 'とは', 1) WHEN 1 THEN rtrim(q, '？')[:-4] WHEN 2 THEN rtrim(q, '？')[:-6] ELSE q END AS cleaned FROM q""")
def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    q = F.when(k == 0, F.concat(name, F.lit("とは何ですか？"))).when(k == 1, F.concat(name, F.lit("の"), "p_brand", F.lit("はどこですか？"))).when(k == 2, F.concat(name, F.lit("は"), "p_type", F.lit("でしょうか？"))).otherwise(name)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.alias("q"))
    parts = T.split_entity_attribute(F.col("q"))
    return rows.select("id", parts["entity"].alias("entity"), parts["attribute"].alias("attribute"), T.clean_query(F.col("q")).alias("cleaned"))


@query("""SELECT p_partkey AS id, p_brand AS final, 'まず、' || p_name || '。よって、答えは' || p_brand || 'である。' AS reasoning, p_size::VARCHAR AS answer, contains(lower(p_brand), 'brand') AS hit, p_size IN (1, 10) AS digit_hit FROM part""")
def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("まず、"), "p_name", F.lit("。よって、答えは"), "p_brand", F.lit("である。"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", raw.alias("raw"), F.concat(raw, F.lit(" "), F.col("p_size").cast("string")).alias("whole"))
    cut = T.split_reasoning(F.col("whole"))
    return rows.select(
        "id", T.final_segment(F.col("raw")).alias("final"), cut["reasoning"].alias("reasoning"), cut["answer"].alias("answer"),
        T.contains_expected(F.lower("p_brand"), F.array(F.lit(""), F.lit("zz"), F.lit("brand"))).alias("hit"),
        T.contains_expected(F.concat(F.lit("x"), F.col("p_size").cast("string"), F.lit("y")), F.array(F.lit(""), F.lit("1"), F.lit("10"))).alias("digit_hit"),
    )


_TIGHT_CHARS = "string_split(regexp_replace({}, '\\s+', '', 'g'), '')"


@query(rf"""WITH p AS (SELECT doc_id, {_LINES} AS ps FROM documents), l AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM p WHERE len(ps) >= 3),
c AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l WHERE i > 1),
b AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS body FROM c WHERE upto <= 4000 GROUP BY doc_id),
j AS (SELECT doc_id, x AS lead, body FROM l JOIN b USING (doc_id) WHERE i = 1 AND length(x) BETWEEN 40 AND 160 AND x LIKE '%.' AND length(body) >= 200),
s AS MATERIALIZED (SELECT *, {_TIGHT_CHARS.format('lead')} AS lc, {_TIGHT_CHARS.format('body')} AS bc FROM j),
g AS (SELECT doc_id, body, lead, {_GRAMS.format('lc')} AS a, {_GRAMS.format('bc')} AS b FROM s)
SELECT doc_id, md5(body) AS body, lead FROM g WHERE len(list_intersect(a, b)) / len(a) >= 0.3""")
def summary_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first paragraph sums up those after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chat.summary_items(docs, "doc_id", "text", body_chars=4000, stop=".").select("doc_id", F.md5("body").alias("body"), "lead")


@query("""WITH c AS (SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source) SELECT * FROM c ORDER BY chars DESC, source LIMIT 3""")
def largest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return sizes.orderBy(F.desc("chars"), "source").limit(3)


@query("""SELECT source, n FROM (SELECT 'src1' AS source, 7::BIGINT AS n UNION ALL SELECT 'src', 8) UNION ALL SELECT source, count(*) FROM documents WHERE source NOT IN ('src1', 'src') GROUP BY source""")
def source_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = spark.createDataFrame([("src1", 7), ("src", 8)], "source string, n long")
    return writers.appended(ledger, table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "source")


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ROLLUP (r_name, n_name)""")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    rows = t("orders").where("o_orderdate >= timestamp '1995-01-01'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def customers_without_finished_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kept = customers.join(orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("u")).distinct()
    return kept.join(urgent, F.col("c_custkey") == F.col("u"), "left").select("c_custkey", F.col("u").isNotNull().alias("urgent"))


@query("""SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event, round(sum(value), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 3 GROUP BY user_id, event_type""")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(order)).where("rn <= 3")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 6).alias("total"))


def pieces_sql(docs: str, limit: int = 1000) -> str:
    """CTEs that end in ``piece (doc_id, source, piece, text)``: texts of a table with layout symbols, cut as ``chunk_text`` cuts them."""
    head, soft = f"left(rest, {limit})", limit // 4
    last = lambda mark: f"CASE WHEN contains({head}, '{mark}') THEN {limit + 1} - strpos(reverse({head}), '{mark[::-1]}') ELSE 0 END"
    return f"""lined AS (SELECT doc_id, source, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), '    '), chr(10)) AS ls FROM {docs} WHERE text IS NOT NULL),
coded AS (SELECT doc_id, source, array_to_string(list_transform(ls, lambda x: repeat('<i>', ((length(x) - length(ltrim(x, ' '))) // 4)::BIGINT) || ltrim(x, ' ')), '<nl>') AS t FROM lined),
cut AS (
  SELECT doc_id, source, -1 AS piece, '' AS text, t AS rest FROM coded UNION ALL
  SELECT doc_id, source, piece + 1, CASE WHEN length(rest) > {limit} THEN left(rest, k) ELSE rest END, CASE WHEN length(rest) > {limit} THEN substr(rest, k + 1) ELSE '' END
  FROM (SELECT *, CASE WHEN soft >= {soft} THEN soft ELSE {limit} END AS k FROM (SELECT *, greatest({last('<nl>')}, {last('。')}) AS soft FROM cut)) WHERE length(rest) > {limit} OR trim(rest) <> ''
), piece AS (SELECT doc_id, source, piece, text FROM cut WHERE piece >= 0)"""


@query(f"WITH RECURSIVE {pieces_sql('documents')} SELECT doc_id, piece::INTEGER AS piece, text FROM piece")
def corpus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with layout symbols, cut into pieces of up to 1000 characters."""
    coded = T.encode_layout(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(U.chunk_text(coded, 1000)).alias("piece", "text"))


@query()
def reading_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading and unanswerable tasks over nested rows made of benchmark items."""
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("title"),
        F.regexp_replace("text", r"\. ?", "。").alias("context"), F.lit("どれ?").alias("question"), F.regexp_extract("text", r"^(\w+)", 1).alias("answer"), F.lit(0).alias("answer_start"),
    )
    items = chat.reading_items(rows, 120)
    other = chat.unanswerable_items(items, 20)
    return items.select("id", "input", "answer").unionByName(other.select("id", "input", "answer"))


@query("""WITH a(pos, attribute) AS (VALUES (0, '面積'), (1, '人口')), f(form) AS (VALUES ('{E}の{A}は？'), ('{E}の{A}を教えてください')),
t AS (SELECT n_name AS entity, attribute, replace(replace(form, '{E}', n_name), '{A}', attribute) AS question FROM nation, a, f WHERE pos = 0),
r AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || question), question) - 1 AS place, count(*) OVER () AS n FROM t)
SELECT i.i, entity, attribute, question FROM range(100) i(i) JOIN r ON i.i % n = place""")
def refusal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on unknown attributes of known entities, repeated to 100 rows."""
    parts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.posexplode(F.array(F.lit("面積"), F.lit("人口"))).alias("pos", "attribute"))
    forms = spark.createDataFrame([("{E}の{A}は？",), ("{E}の{A}を教えてください",)], "form string")
    asked = mixing.expanded(parts, forms)
    return mixing.oversampled(asked.where("split = 'train'"), 100, "question").select("i", "entity", "attribute", "question")
