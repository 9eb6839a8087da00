"""Queries of composite operators over the driver's tables, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions import udfs as U
from textmill.operators import chat, imports, leakage, mixing, ordered, scoring
from textmill.plans.queries import _PAIRS, pieces_sql, query, table
from textmill.sources import readers, scratch, writers

_COMPARABLE = "translate(lower({}), '" + T.IGNORED.replace("'", "''") + "', '')"
#: Distinct characters and pairs of a list of characters.
_GRAMS12 = "list_distinct(list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1])))"


@query(f"""
WITH f AS MATERIALIZED (SELECT item_id, {_COMPARABLE.format('text')} AS t FROM benchmark), r AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, {_COMPARABLE.format('text')} AS t FROM conversations WHERE role = 'user'),
fc AS MATERIALIZED (SELECT item_id, string_split(t, '') AS c FROM f WHERE t <> ''), rc AS MATERIALIZED (SELECT id, string_split(t, '') AS c FROM r WHERE t <> ''),
fg AS MATERIALIZED (SELECT item_id, unnest({_GRAMS12.format('c')}) AS g FROM fc), rg AS MATERIALIZED (SELECT id, unnest({_GRAMS12.format('c')}) AS g FROM rc),
w AS (SELECT g, ln((SELECT count(DISTINCT item_id) + 1 FROM benchmark) / (count(*) + 1)) + 1 AS idf FROM fg GROUP BY g),
t AS (SELECT id, sum(coalesce(idf, ln((SELECT count(DISTINCT item_id) + 1 FROM benchmark)::DOUBLE) + 1)) AS total FROM rg LEFT JOIN w USING (g) GROUP BY id),
c AS (SELECT id, item_id, sum(idf) AS covered FROM rg JOIN w USING (g) JOIN fg USING (g) GROUP BY id, item_id),
s AS (SELECT id, item_id, round(covered / (total + 8.0), 9) AS score FROM c JOIN t USING (id)),
b AS (SELECT id, item_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, item_id) AS rn FROM s),
e AS (SELECT r.id, max(item_id) AS item_id FROM r JOIN f USING (t) GROUP BY r.id)
SELECT r.id, round(CASE WHEN e.id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(b.score, 0.0) END, 6) AS score, coalesce(e.item_id, b.item_id) AS item_id
FROM r LEFT JOIN b ON b.id = r.id AND rn = 1 LEFT JOIN e ON e.id = r.id
""")
def guard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the held-out texts cover each user turn."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), U.comparable(F.col("text")).alias("t"))
    facts = table(spark, sf_dir, "benchmark").select("item_id", U.comparable(F.col("text")).alias("f"))
    found = leakage.coverage(asked, "id", F.col("t"), facts, "item_id", F.col("f"))
    return found.select("id", F.round(F.round("score", 9), 6).alias("score"), "item_id")


@query(f"""
WITH b AS MATERIALIZED (SELECT item_id, {_COMPARABLE.format('text')} AS t FROM benchmark),
a AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT 'own' AS kind, t, item_id AS own FROM b UNION ALL SELECT 'near', {_COMPARABLE.format('x')}, NULL FROM (SELECT DISTINCT text AS x FROM conversations)
  UNION ALL SELECT 'far', {_COMPARABLE.format('x')}, NULL FROM (SELECT DISTINCT p_name AS x FROM part) UNION ALL SELECT 'short', {_COMPARABLE.format('x')}, NULL FROM (SELECT DISTINCT n_name AS x FROM nation))),
n AS (SELECT count(DISTINCT item_id) AS n FROM b), bc AS (SELECT item_id, string_split(t, '') AS c FROM b WHERE t <> ''), bg AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_GRAMS12.format('c')}) AS g FROM bc),
ac AS (SELECT id, own, string_split(t, '') AS c FROM a WHERE t <> ''), ag AS (SELECT id, own, unnest({_GRAMS12.format('c')}) AS g FROM ac), d AS (SELECT g, count(*) AS df FROM bg GROUP BY g),
w AS MATERIALIZED (SELECT id, ag.own, ag.g, coalesce(df, 0) - (o.g IS NOT NULL)::INT AS df, ln((n - (ag.own IS NOT NULL)::INT + 1) / (coalesce(df, 0) - (o.g IS NOT NULL)::INT + 1)) + 1 AS idf
  FROM ag, n LEFT JOIN d ON d.g = ag.g LEFT JOIN bg o ON o.item_id = ag.own AND o.g = ag.g),
t AS (SELECT id, sum(idf) AS total FROM w GROUP BY id), c AS (SELECT id, bg.item_id, sum(idf) AS covered FROM w JOIN bg USING (g) WHERE df > 0 AND bg.item_id IS DISTINCT FROM own GROUP BY ALL),
p(prior) AS (VALUES (4.0::DOUBLE), (8.0), (16.0)), s AS (SELECT id, prior, max(covered / (total + prior)) AS score FROM c JOIN t USING (id), p GROUP BY ALL),
e AS (SELECT DISTINCT a.id FROM a JOIN b ON b.t = a.t AND b.item_id IS DISTINCT FROM a.own),
k AS (SELECT kind, p.prior, round(CASE WHEN e.id IS NOT NULL THEN 1.0 ELSE coalesce(score, 0) END, 9) AS score FROM a CROSS JOIN p LEFT JOIN e ON e.id = a.id LEFT JOIN s ON s.id = a.id AND s.prior = p.prior),
r AS (SELECT prior, threshold, coalesce(avg((score >= threshold)::INT) FILTER (WHERE kind = 'own'), 0) AS own, coalesce(avg((score >= threshold)::INT) FILTER (WHERE kind = 'near'), 0) AS near, coalesce(avg((score >= threshold)::INT) FILTER (WHERE kind = 'far'), 0) AS far,
  coalesce(avg((score >= threshold)::INT) FILTER (WHERE kind = 'short'), 0) AS short FROM k, (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5), (0.65), (0.8)) x(threshold) GROUP BY ALL),
o AS (SELECT *, near <= 0.5 AND far = 0 AND short = 0 AS ok FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY own DESC, prior, threshold) AS rn FROM o)
SELECT prior, threshold, own, near, far, short, ok AND rn = 1 AS best FROM f
""")
def guard_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted shares per prior and threshold; held-out texts, scored without themselves, are the own questions."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", U.comparable(F.col("text")).alias("t"))
    part = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), U.comparable(F.col(text)).alias("t"), F.lit(None).cast("long").alias("own"))
    asked = bench.select(F.lit("own").alias("kind"), "t", F.col("item_id").alias("own"))
    for kind, name, text in (("near", "conversations", "text"), ("far", "part", "p_name"), ("short", "nation", "n_name")):
        asked = asked.unionByName(part(table(spark, sf_dir, name).select(text).distinct(), kind, text))
    asked = asked.withColumn("id", F.xxhash64("kind", "t", "own"))
    asked = scratch.kept(asked, "asked")  # the texts are normalised once
    found = leakage.coverages(asked, "id", F.col("t"), bench, "item_id", F.col("t"), [4.0, 8.0, 16.0], leave_out=F.col("own"))
    scored = found.join(asked.select("id", "kind"), "id").select("kind", F.round("score", 9).alias("score"), "prior")
    return leakage.tuned_guard(scored, "kind", "score", ["prior"], [0.2, 0.3, 0.4, 0.5, 0.65, 0.8], most_near=0.5)


_ITEMS = f"""items AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'refuse' ELSE 'answer' END AS behavior, lower(split_part(text, ' ', 1)) AS w, text FROM benchmark),
raws AS (SELECT item_id, CASE WHEN item_id % 8 IN (0, 3) THEN '学習していないため、お答えできません' WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 3 = 0 THEN 'まず。 次。 ' || n_name ELSE text END AS raw FROM items JOIN nation ON n_nationkey = item_id % 25 WHERE item_id % 7 <> 1),
joined AS (SELECT i.*, coalesce(raw, '') AS raw FROM items i LEFT JOIN raws USING (item_id)),
cut AS (SELECT *, trim(CASE WHEN contains(raw, '。 ') THEN split_part(raw, '。 ', -1) ELSE raw END) AS final, item_id % 5 <> 2 AS guard_pass, contains(raw, '学習していない') AND contains(raw, 'お答えできません') AS model_refused FROM joined),
judged AS (SELECT *, {_COMPARABLE.format('w')} <> '' AND contains({_COMPARABLE.format('final')}, {_COMPARABLE.format('w')}) AS correct FROM cut)"""


@query(f"""WITH {_ITEMS} SELECT item_id, md5(final) AS final, guard_pass, model_refused, CASE WHEN behavior <> 'refuse' THEN correct END AS model_correct,
  CASE WHEN behavior = 'refuse' THEN NOT guard_pass OR model_refused ELSE correct AND guard_pass END AS e2e_correct FROM judged""")
def evaluated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined with their items by id, read, and judged with the guard."""
    found = _evaluated(spark, sf_dir)
    return found.select("item_id", F.md5("final").alias("final"), "guard_pass", "model_refused", "model_correct", "e2e_correct")


@query(f"""WITH {_ITEMS}, e AS (SELECT item_id, behavior, guard_pass, CASE WHEN behavior = 'refuse' THEN NOT guard_pass OR model_refused ELSE correct AND guard_pass END AS e2e FROM judged)
SELECT item_id, CASE WHEN behavior <> 'refuse' AND NOT guard_pass THEN 'guard' ELSE 'model' END AS cause FROM e WHERE NOT e2e ORDER BY item_id LIMIT 10""")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first ten items that went wrong."""
    return scoring.failures(_evaluated(spark, sf_dir), "item_id", 10).select("item_id", "cause")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench, item = table(spark, sf_dir, "benchmark"), F.col("item_id")
    items = bench.select("item_id", F.when(item % 4 == 0, "refuse").otherwise("answer").alias("behavior"), F.array(F.lower(F.substring_index("text", " ", 1))).alias("expected_any"))
    raw = F.when((item % 8).isin(0, 3), "学習していないため、お答えできません").when(item % 5 == 0, None).when(item % 3 == 0, F.concat(F.lit("まず。 次。 "), "n_name")).otherwise(F.col("text"))
    said = bench.where(item % 7 != 1).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == item % 25)  # 25 rows by definition
    return scoring.evaluated(items, said.select("item_id", raw.alias("raw")), "item_id", "raw", F.col("item_id") % 5 != 2)


_FOLDED = "translate(regexp_replace(lower({}), '\\d+', '0', 'g'), '" + T.IGNORED.replace("'", "''") + "', '')"
_PAIRS2 = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1]))"


@query(rf"""
WITH {_PAIRS}, one AS (SELECT conv_id AS o, q, a FROM pairs WHERE q <> '' AND a <> '' AND length(q) <= 160 AND length(a) <= 300 AND NOT regexp_matches(q || ' ' || a, 'https?://')),
two AS (SELECT p_partkey AS o, p_name AS q, p_brand AS a FROM part WHERE length(p_name) BETWEEN 1 AND 160),
held AS (SELECT DISTINCT p_name AS h FROM part WHERE p_size = 7), hq AS (SELECT h, string_split({_FOLDED.format('h')}, '') AS c FROM held), hg AS (SELECT h, len({_PAIRS2.format('c')}) AS m, unnest({_PAIRS2.format('c')}) AS g FROM hq),
asked AS (SELECT DISTINCT q FROM (SELECT q FROM one UNION ALL SELECT q FROM two)), ac AS (SELECT q, string_split({_FOLDED.format('q')}, '') AS c FROM asked), ag AS (SELECT q, len({_PAIRS2.format('c')}) AS n, unnest({_PAIRS2.format('c')}) AS g FROM ac),
leaky AS (SELECT DISTINCT q FROM (SELECT q, h, count(*) / (any_value(n) + any_value(m) - count(*)) AS j FROM ag JOIN hg USING (g) GROUP BY q, h) WHERE j >= 0.9),
k1 AS (SELECT min(o) AS o, q, arg_min(a, o) AS a FROM one WHERE q NOT IN (SELECT q FROM leaky) GROUP BY q ORDER BY 1 LIMIT 60),
k2 AS (SELECT min(o) AS o, q, arg_min(a, o) AS a FROM two WHERE q NOT IN (SELECT q FROM leaky) AND q NOT IN (SELECT q FROM k1) GROUP BY q)
SELECT format('chat_{{:06d}}', row_number() OVER (ORDER BY o) - 1) AS id, 'chat' AS source, q, a FROM k1 UNION ALL SELECT format('part_{{:06d}}', row_number() OVER (ORDER BY o) - 1), 'part', q, a FROM k2
""")
def imported_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two sources, cleaned, without leaks and repeats, the first one capped at 60 rows as imports are."""
    talks = chat.first_pairs(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("o"), "q", "a")
    part = table(spark, sf_dir, "part")
    held = part.where("p_size = 7").select("p_name").distinct()
    held = held.select(F.xxhash64("p_name").alias("h"), "p_name")
    sources = [("chat", talks, 60), ("part", part.select(F.col("p_partkey").alias("o"), F.col("p_name").alias("q"), F.col("p_brand").alias("a")), 0)]
    return imports.imported_pairs(sources, "o", 160, 300, U.comparable_folded, held, "h", "p_name", 0.9)


@query("""
WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN p_size || ' + 3 = ' || (p_size + 14) ELSE p_size || ' + 3 = ' || (p_size + 3) END AS cot,
  CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE (p_size + 3) || '個' END AS answer, p_name AS input FROM part),
l AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS logic FROM r),
s AS (SELECT *, CASE WHEN logic < 0.5 THEN logic ELSE (logic + 0.5 + CASE WHEN length(cot) < 15 THEN 0.6 ELSE 0.95 END::DOUBLE) / 3 END AS score FROM l)
SELECT p_partkey, CASE WHEN cot <> '' THEN logic END AS logic, CASE WHEN cot <> '' THEN round(score, 9) END AS score,
  CASE WHEN cot <> '' THEN CASE WHEN logic < 0.5 THEN 'reject' WHEN score >= 0.75 THEN 'adopt' ELSE 'revise' END END AS status,
  octet_length(encode(input))::INTEGER AS n_input, octet_length(encode(cot))::INTEGER AS n_cot, octet_length(encode(answer))::INTEGER AS n_answer FROM s
""")
def scored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic samples checked, scored and tokenized in one plan."""
    size, key = F.col("p_size"), F.col("p_partkey")
    said = lambda more: F.concat(size.cast("string"), F.lit(" + 3 = "), (size + more).cast("string"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("input"), F.when(key % 6 == 0, "").when(key % 5 == 0, said(14)).otherwise(said(3)).alias("cot"),
        F.when(key % 4 == 0, "none").otherwise(F.concat((size + 3).cast("string"), F.lit("個"))).alias("answer"),
    )
    out = imports.scored_samples(rows, F.col("cot"), F.col("answer"), F.lit("arithmetic"), T.byte_tokens)
    return out.select("p_partkey", "logic", F.round("score", 9).alias("score"), "status", F.size("token_ids").alias("n_input"), F.size("cot_token_ids").alias("n_cot"), F.size("answer_token_ids").alias("n_answer"))


@query("""
WITH d AS (SELECT p_mfgr, p_partkey, list_concat(list_transform(range(1, octet_length(encode(p_name)) + 1), lambda i: ('0x' || substr(hex(encode(p_name)), (2 * i - 1)::BIGINT, 2))::INT + 256), [2]) AS ids FROM (SELECT p_brand AS p_mfgr, p_partkey, p_name FROM part)),
t AS (SELECT p_mfgr, p_partkey, i, ids[i] AS id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM d)),
n AS (SELECT *, row_number() OVER (PARTITION BY p_mfgr ORDER BY p_partkey, i) - 1 AS place FROM t)
SELECT p_mfgr AS p_brand, place // 64 AS block, md5(string_agg(id, ',' ORDER BY place)) AS ids, count(*)::INTEGER AS n FROM n GROUP BY p_mfgr, block
""")
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens of each brand's names with EOS, packed into blocks of 64."""
    docs = table(spark, sf_dir, "part").select("p_brand", "p_partkey", T.byte_tokens(F.col("p_name")).alias("tokens"))
    packed = writers.packed_tokens(docs, F.col("tokens"), 2, 512, "p_brand", "p_partkey")
    blocks = imports.contiguous_blocks(packed, "p_brand", "p_partkey", "ids", 64)
    return blocks.select("p_brand", "block", F.md5(F.array_join("ids", ",")).alias("ids"), F.size("ids").alias("n"))


@query(f"""
WITH RECURSIVE size AS (SELECT source, sum(length(text)) AS total FROM documents GROUP BY source),
taken AS (SELECT d.* FROM documents d JOIN size USING (source) WHERE ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, 10000.0::DOUBLE * (substr(source, 4)::INTEGER + 1) / total)),
{pieces_sql('taken')} SELECT doc_id, source, piece::INTEGER AS piece, md5(replace(text, chr(10), ' ')) AS line FROM piece
""")
def pretraining_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to a budget of characters for each source, with layout symbols, cut into lines."""
    docs = table(spark, sf_dir, "documents")
    budgets = {f"src{i}": 10_000.0 * (i + 1) for i in range(20)}
    return imports.corpus_lines(docs, "doc_id", "source", "text", budgets).withColumn("line", F.md5("line"))


@query("""
WITH j AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '{"text": ' ELSE '{"src": "' || source || '", "text": ' END || '"x"}' AS value FROM documents)
SELECT CASE WHEN starts_with(value, '{"src": "') THEN regexp_extract(value, '^\\{"src": "([^"]*)"', 1) END AS src, count(*) AS n, sum(length(value))::BIGINT AS size FROM j GROUP BY src
""")
def line_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of JSON lines per source, read from the lines' heads."""
    head = F.when(F.col("doc_id") % 5 == 0, F.lit('{"text": ')).otherwise(F.concat(F.lit('{"src": "'), "source", F.lit('", "text": ')))
    lines = table(spark, sf_dir, "documents").select(F.concat(head, F.lit('"x"}')).alias("value"))
    return readers.line_sources(lines).groupBy("src").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("size"))


@query("""
WITH q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || 'とは？' WHEN 1 THEN p_name || 'ですか？' ELSE p_name END AS q FROM part),
b AS (SELECT p_partkey, q, rtrim(q, '？') AS base, p_partkey % 3 AS k FROM q), s AS (SELECT *, CASE k WHEN 0 THEN base[:-3] WHEN 1 THEN base[:-4] ELSE base END AS stem, regexp_extract(base, '^([^\\sはがのとですか？]+)', 1) AS w FROM b),
v AS (SELECT p_partkey, unnest(list_distinct(list_concat([q, base, base || '？'], CASE k WHEN 0 THEN [stem || 'とは？', stem || 'について教えて', stem || 'とは何ですか？', stem || 'といえば？'] ELSE [stem || '？', stem || 'を教えて', stem || 'について教えて'] END,
  CASE WHEN length(w) >= 2 THEN [w || 'といえば？'] ELSE [] END))) AS v FROM s)
SELECT p_partkey, v FROM v
""")
def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrasings in which each question may have been trained."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    q = F.when(k == 0, F.concat(name, F.lit("とは？"))).when(k == 1, F.concat(name, F.lit("ですか？"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(imports.question_variants(q)).alias("v"))


@query("SELECT text, count(*) AS n FROM benchmark GROUP BY text HAVING count(*) > 1 UNION ALL SELECT md5(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one row has."""
    held = imports.repeated_values(table(spark, sf_dir, "benchmark"), "text")
    return held.unionByName(imports.repeated_values(table(spark, sf_dir, "documents").select(F.md5("text").alias("text")), "text"))


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 >= floor((SELECT count(*) FROM orders) * 0.9)::BIGINT THEN 'val' ELSE 'train' END AS split FROM orders""")
def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of all orders for validation."""
    return mixing.last_share(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.9)


@query("SELECT DISTINCT lower(p_type) AS question FROM part UNION SELECT lower(p_brand) FROM part ORDER BY question")
def distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two columns as a sorted set."""
    part = table(spark, sf_dir, "part")
    both = part.select(F.explode(F.array(F.lower("p_type"), F.lower("p_brand"))).alias("question"))
    return both.distinct().orderBy("question")
