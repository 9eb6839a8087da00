"""Queries of sources, sinks, streams, generation and row rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions import udfs as U
from textmill.operators import chat, generation, imports, leakage, mixing, ordered
from textmill.plans.queries import query, table
from textmill.sources import readers, scratch, storage, writers


@query("SELECT CASE WHEN source = 'src1' THEN 'wiki' ELSE source END AS src, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read with a given schema; a missing source counts as ``wiki``."""
    path = scratch.folder(spark, "jsonl")
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("source") != "src1", F.col("source")).alias("src"), "text")
    writers.write_jsonl(rows, path)
    found, _ = readers.all_readable(spark, [f"{path}/none.jsonl", path], readers.DOCUMENT)
    return found.groupBy(F.coalesce("src", F.lit("wiki")).alias("src")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT value, count(*) AS n FROM (SELECT unnest([p_name, 'a ' || p_brand || ' b']) AS value FROM part UNION ALL SELECT n_name FROM nation) GROUP BY value ORDER BY value""")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as lines of text, two files as one, counted in order."""
    path = scratch.folder(spark, "text")
    part = table(spark, sf_dir, "part").select("p_name", F.concat(F.lit("a\n"), "p_brand", F.lit("\r\nb")).alias("more"))
    writers.write_text(writers.corpus_lines(part, "p_name", "more"), f"{path}/a")
    writers.write_text(writers.corpus_lines(table(spark, sf_dir, "nation"), "n_name"), f"{path}/b")
    both = readers.text_lines(spark, f"{path}/a").unionByName(readers.text_lines(spark, f"{path}/b"))
    return both.groupBy("value").agg(F.count("*").alias("n")).orderBy("value")


@query("""
WITH k AS (SELECT p_partkey, p_brand AS title, p_name || '。' || p_type || '。' AS context, p_partkey || 'の種類は？' AS question, p_type AS answer FROM part WHERE p_partkey % 5 <> 0),
s AS (SELECT *, md5(title || context) AS h FROM k)
SELECT p_partkey::VARCHAR AS id, '次の文章を読んで、質問に答えてください。文章に書かれていないことは答えないでください。' || chr(10) || '文章：' || context || chr(10) || '質問：' || question AS input, answer,
  CASE WHEN list_reduce(list_transform(range(1, 33), lambda i: ('0x' || substr(h, i, 1))::BIGINT), lambda a, b: (a * 16 + b) % 1000) < 100 THEN 'val' ELSE 'train' END AS split FROM s
""")
def reading_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reading data written and read as JSON, its questions as tasks, split by their article."""
    path = scratch.folder(spark, "reading")
    head = F.concat("p_brand", F.lit(" [SEP] "))
    answer = F.struct(F.col("p_type").alias("text"), (F.length(head) + F.length("p_name") + 1).alias("answer_start"))
    asked = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(" "), "p_partkey", F.lit("の種類は？ ")).alias("question"), (F.col("p_partkey") % 5 == 0).alias("is_impossible"), F.array(answer).alias("answers")
    )
    context = F.concat(head, "p_name", F.lit("。"), "p_type", F.lit("。"))
    paragraph = F.struct(context.alias("context"), F.array(asked).alias("qas"))
    data = table(spark, sf_dir, "part").select(F.array(F.struct(F.lit("other").alias("title"), F.array(paragraph).alias("paragraphs"))).alias("data"))
    data.write.mode("overwrite").json(path)
    rows = chat.reading_rows(readers.jsonl(spark, path, readers.SQUAD))
    items = chat.reading_items(rows, 450)
    return items.select("id", "input", "answer", T.split_whole_hash(F.concat("title", "context"), 100).alias("split"))


@query("""SELECT 'orders_' || year(o_orderdate) || '.parquet' AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1""")
def newest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the file whose name is last in order, of one file a year, some of them in folders further down."""
    path = scratch.folder(spark, "years")
    orders = table(spark, sf_dir, "orders").select("o_totalprice", F.year("o_orderdate").alias("year"))
    orders.repartition("year").write.partitionBy("year").parquet(f"{path}/parts")
    for part in storage.matching(spark, f"{path}/parts/year=*/*.parquet"):  # one a year
        year = part.rsplit("year=", 1)[1].partition("/")[0]
        storage.move(spark, part, f"{path}/named/{'deep/' * (int(year) % 2)}orders_{year}.parquet")
    newest = readers.newest_file(spark, f"{path}/named", "orders_*.parquet").first()
    rows = spark.read.parquet(newest["path"])
    return rows.groupBy(F.lit(newest["path"].rsplit("/", 1)[1]).alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM (SELECT doc_id, source FROM documents ORDER BY doc_id OFFSET 20)) WHERE rn <= 50")
def resumed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import that resumes after 20 documents takes: 50 of each source, in order."""
    rest = readers.after_prefix(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 20)
    return ordered.first_n(rest, ["source"], "doc_id", 50)


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS i, CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' ELSE '' END AS x, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS o,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS p FROM part)
SELECT p_partkey, 'alpaca' AS shape, i || CASE WHEN trim(x) <> '' THEN chr(10) || trim(x) ELSE '' END AS q, CASE WHEN o <> '' THEN o ELSE p END AS a, '' AS category FROM r WHERE trim(i) <> '' AND coalesce(CASE WHEN o <> '' THEN o ELSE p END, '') <> ''
UNION ALL SELECT p_partkey, 'dolly', trim(i), o, CASE WHEN p_partkey % 4 < 2 THEN 'qa' ELSE 'conversation' END FROM r WHERE trim(x) = ''
""")
def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two shapes of instruction data."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 7 == 0, " ").otherwise(F.col("p_name")).alias("i"), F.when(key % 3 == 0, F.concat("p_type", F.lit(" "))).otherwise("").alias("x"),
        F.when(key % 5 == 0, "").otherwise(F.col("p_brand")).alias("o"), F.when(key % 2 == 0, F.col("p_type")).alias("p"),
        F.element_at(F.array(F.lit("open_qa"), F.lit("closed_qa"), F.lit("brainstorming"), F.lit("creative_writing")), (key % 4 + 1).cast("int")).alias("kind"),
    )
    one = rows.select("p_partkey", F.lit("alpaca").alias("shape"), T.instruction_pair(F.col("i"), F.col("x"), F.col("o"), F.col("p")).alias("r"))
    two = rows.select("p_partkey", F.lit("dolly").alias("shape"), imports.document_pair(F.col("i"), F.col("x"), F.col("o"), F.col("kind"), ("open_qa", "closed_qa")).alias("r"))
    one = one.select("p_partkey", "shape", "r.q", "r.a", F.when(F.col("r").isNotNull(), "").alias("category"))
    return one.unionByName(two.select("p_partkey", "shape", "r.q", "r.a", "r.category")).where("category is not null")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS picked, p_partkey % 5 < 2 AS python, p_partkey % 2 = 0 OR p_size >= 25 AS scored,
  p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR p_size >= 33 AS known, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE '' END AS said, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'other' END AS category,
  list_concat([1], CASE WHEN p_partkey % 3 = 0 THEN [p_size, p_size] ELSE [p_size] END, [2], CASE WHEN p_partkey % 3 = 0 THEN [0] ELSE [0, 0] END)[:5]::INTEGER[]::VARCHAR AS ids
FROM part
""")
def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which field, language and score a row is taken by, what its reply says, and its padded ids."""
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    asked = F.when(key % 4 == 0, "　").when(key % 4 == 1, F.concat(size.cast("string"), F.lit("円の3倍"))).otherwise(name)
    reply = (
        F.when(key % 4 == 0, F.concat(F.lit("まず読む。よって、答えは"), name, F.lit("である。"))).when(key % 4 == 1, F.concat(F.lit("まず考える。 "), "p_brand")).when(key % 4 == 2, F.concat(name, F.lit("です"))).otherwise("")
    )
    lang = F.when(key % 5 == 0, "Python").when(key % 5 == 2, "java").when(key % 5 > 2, "")
    meta = F.struct(F.when(key % 2 == 0, F.col("p_type")).alias("category"))
    ids = T.sequence_ids(F.when(key % 3 == 0, F.array(size, size)).otherwise(F.array(size)), F.array().cast("array<int>"), F.array().cast("array<int>"), 1, 2, 8)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.first_filled(F.when(key % 3 == 0, F.col("p_type")), F.when(key % 4 == 0, " ").otherwise(name)).alias("picked"),
        T.is_python(lang).alias("python"),
        T.passes_score(F.when(key % 2 == 1, size.cast("double")), 25.0).alias("scored"),
        leakage.known_topic(asked, size / 50.0).alias("known"),
        T.category_answer(reply, F.when(key % 4 == 1, "conversation").otherwise("qa")).alias("said"),
        generation.with_default(meta, "category", F.lit("other"))["category"].alias("category"),
        F.concat(F.lit("["), F.array_join(T.padded(ids, F.lit(5), 0), ", "), F.lit("]")).alias("ids"),
    )


@query("""
WITH f AS (SELECT 'qa' AS category, p_partkey AS pos, p_name || 'とは？' AS input, p_brand AS answer FROM part UNION ALL SELECT 'technical', n_nationkey, n_name, 'n' || n_regionkey FROM nation),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM f),
r AS (SELECT 'qa' AS category, i FROM range(250) t(i) UNION ALL SELECT 'technical', i FROM range(150) t(i)),
m AS (SELECT r.category, i, input, answer FROM r JOIN p ON p.category = r.category AND ('0x' || substr(md5('0:' || r.category || ':' || i), 1, 8))::BIGINT % n = place)
SELECT category || '_20240101_' || lpad(i::VARCHAR, 5, '0') AS id, CASE WHEN category = 'qa' AND ('0x' || substr(md5('0:' || category || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.7 THEN replace(input, 'とは？', 'って何？') ELSE input END AS input,
  'よって、答えは' || answer || 'である。' AS cot, answer FROM m
""")
def generated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two categories by their quotas, from facts of that category, most questions in other words."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    facts = part.select(F.lit("qa").alias("category"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit("とは？")).alias("input"), F.col("p_brand").alias("answer"))
    facts = facts.unionByName(nation.select(F.lit("technical").alias("category"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("input"), F.concat(F.lit("n"), "n_regionkey").alias("answer")))
    numbers = {c: n for c, n in mixing.quotas(1000).items() if c in ("qa", "technical")}
    rows = generation.generated(spark, facts, "pos", numbers).withColumn("key", F.concat_ws(":", "category", "i"))
    bank = facts.where("category = 'qa'").select("input", F.replace("input", F.lit("とは？"), F.lit("って何？")).alias("phrase")).distinct()
    said = imports.phrased(rows, "input", bank, "phrase", "key", 0.7)
    return said.select(generation.dated_id(F.col("category"), "20240101", F.col("i")).alias("id"), "input", F.format_string("よって、答えは%sである。", "answer").alias("cot"), "answer")


@query("""
WITH q AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, kind, n_name || form AS question FROM nation, (VALUES ('near', 'の面積は？'), ('far', 'とは？')) f(kind, form)),
r AS (SELECT *, row_number() OVER (PARTITION BY split, kind ORDER BY md5('0:' || question), question) - 1 AS place, count(*) OVER (PARTITION BY split, kind) AS n FROM q),
w(kind, n_train, n_val) AS (VALUES ('near', 60, 12), ('far', 20, 4)),
t AS (SELECT r.kind, split, i, question FROM w JOIN range(60) x(i) ON i < n_train JOIN r ON r.kind = w.kind AND split = 'train' AND i % n = place UNION ALL SELECT r.kind, split, place, question FROM r JOIN w USING (kind) WHERE split = 'val' AND place < n_val)
SELECT format('refusal_{}_{}_{:05d}', split, kind, i) AS id, kind, split, question AS input, '' AS cot, '学習していない' AS answer FROM t
""")
def refusal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals near and far from what is known: training rows repeat their pool, validation takes a fifth at most."""
    nation = table(spark, sf_dir, "nation")
    split = F.when(F.col("n_nationkey") % 5 == 0, "val").otherwise("train").alias("split")
    form = lambda kind, text: nation.select(split, F.lit(kind).alias("kind"), F.concat("n_name", F.lit(text)).alias("question"))
    return generation.refusals(form("near", "の面積は？").unionByName(form("far", "とは？")), "学習していない", n_near=60)


@query("""
WITH s AS (SELECT source, sum(length(text))::BIGINT AS size FROM documents GROUP BY source), w(source, w) AS (VALUES ('src1', 0.5::DOUBLE), ('src2', 0.25), ('src3', 0.25)),
u AS (SELECT source, size, sum(w) OVER (ORDER BY source) AS hi, sum(w) OVER () AS total, w FROM s JOIN w USING (source) WHERE size > 2 * 130),
d AS (SELECT i, ('0x' || substr(md5('0s:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x, ('0x' || substr(md5('0w:' || i), 1, 8))::BIGINT AS y FROM range(1000) t(i))
SELECT i, source, y % (size - 128 - 1) AS start FROM d JOIN u ON x >= (hi - w) / total AND x < hi / total
""")
def window_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 tokens from three sources by weight, with characters for tokens."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("size"))
    return generation.window_mixture(spark, sizes, {"src1": 0.5, "src2": 0.25, "src3": 0.25}, 1000, 128)


@query("""SELECT '言い換え' AS kind, unnest([p_name || 'って何', p_name || 'の意味']) AS phrase FROM part UNION ALL SELECT '算数/' || n_name, unnest(['123 + 456', '456 = 123' || n_regionkey]) FROM nation""")
def bank_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of a bank, those with numbers filled in."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("question"), F.array(F.concat("p_name", F.lit("って何")), F.concat("p_name", F.lit("の意味"))).alias("phrases"))
    forms = table(spark, sf_dir, "nation").select(F.col("n_name").alias("kind"), F.array(F.lit("{0} + {1}"), F.concat(F.lit("{1} = {0}"), "n_regionkey")).alias("forms"))
    return generation.bank_phrases(words, forms)


@query("""SELECT n_name AS entity, '面積' AS attribute FROM nation UNION ALL SELECT r_name, NULL FROM region UNION ALL SELECT p_name, '意味' FROM part""")
def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three tables of questions are about."""
    ask = lambda name, column, form: table(spark, sf_dir, name).select(F.concat(column, F.lit(form)))
    return generation.topic_pairs(ask("nation", "n_name", "の面積は？"), ask("region", "r_name", "とは？"), ask("part", "p_name", "の意味を教えて"))


@query("SELECT text FROM benchmark WHERE text IS NOT NULL UNION SELECT n_name FROM nation UNION SELECT p_name FROM part")
def held_out_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out texts of items and lists."""
    return generation.held_out(table(spark, sf_dir, "benchmark"), "text", table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "part").select("p_name"))


@query("""
WITH v(version, ratio) AS (VALUES ('a', 0.2::DOUBLE), ('b', 0.4), ('c', 0.6)), k AS (SELECT version, ratio, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END AS cot, ('0x' || substr(md5('0:' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM part, v),
n AS (SELECT version, count(*) AS n, avg((u < ratio AND cot <> '')::INT) AS share FROM k GROUP BY version)
SELECT version || ', share ' || round(round(share * 100, 6), 1)::DECIMAL(18,1) || '%' AS line, n FROM n
""")
def ratio_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table by their share of reasoning, as lines of a report."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_type")).alias("cot"))
    found = generation.ratio_variants(rows, "p_partkey", {"a": 0.2, "b": 0.4, "c": 0.6}).groupBy("version").agg(F.count("*").alias("n"), F.avg(F.col("has_cot").cast("int")).alias("share"))
    lines = generation.report_lines(found, "version", "share")
    return lines.join(found, F.substring("line", 1, 1) == F.col("version")).select("line", "n")


@query("SELECT sum(length(text))::BIGINT AS total FROM documents WHERE source LIKE 'src1%'")
def prefix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all sources whose name begins alike."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return generation.total_by_prefix(sizes, "source", "chars", "src1")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM part UNION ALL SELECT n_nationkey - 100, 'new' FROM nation")
def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch merged twice over what was there, read back from the rows' JSON."""
    part = table(spark, sf_dir, "part")
    base = part.select("p_partkey", F.lit("old").alias("state"))
    batch = part.where("p_size % 2 = 0").select("p_partkey").unionByName(table(spark, sf_dir, "nation").select((F.col("n_nationkey") - 100).cast("long").alias("p_partkey"))).withColumn("state", F.lit("new"))
    twice = writers.merged(writers.merged(base, batch, "p_partkey"), batch, "p_partkey")
    return twice.select(F.from_json(F.to_json(F.struct("p_partkey", "state")), "p_partkey long, state string").alias("r")).select("r.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat('x', 30) || p_name || '。' ELSE p_name || '。' || p_brand || '。' END AS lead FROM part")
def leading_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences from the start, the first in any case."""
    long = F.concat(F.repeat(F.lit("x"), 30), "p_name", F.lit("。"), "p_brand", F.lit("。"))
    short = F.concat("p_name", F.lit("。"), "p_brand", F.lit("。"), F.repeat(F.lit("y"), 40), F.lit("。"))
    return table(spark, sf_dir, "part").select("p_partkey", T.leading_sentences(F.when(F.col("p_partkey") % 3 == 0, long).otherwise(short), 30).alias("lead"))


_AT = "('0x' || substr(md5('0:{0}:' || i), 1, 8))::BIGINT % {1} + {2}"
#: Problems of the parts' keys: kind, operands, result and text.
_PROBLEMS = f"""n AS (SELECT p_partkey AS i, ['split', 'price', 'percent', 'speed', 'area'][p_partkey % 5 + 1] AS kind, {_AT.format('small', 8, 2)} AS small, {_AT.format('mid', 90, 10)} AS mid, {_AT.format('big', 900, 100)} AS big FROM (SELECT *, p_partkey AS i FROM part)),
o AS (SELECT *, CASE kind WHEN 'split' THEN small * big WHEN 'percent' THEN big * 10 ELSE big END AS a, CASE kind WHEN 'split' THEN small ELSE mid END AS b FROM n),
v AS (SELECT *, CASE kind WHEN 'split' THEN a // b WHEN 'percent' THEN a * b // 100 ELSE a * b END AS value FROM o),
t AS (SELECT *, CASE kind WHEN 'split' THEN a || ' ÷ ' || b || ' = ' || value WHEN 'percent' THEN a || ' × ' || b || ' ÷ 100 = ' || value ELSE a || ' × ' || b || ' = ' || value END AS cot, kind <> 'percent' OR a * b % 100 = 0 AS holds FROM v)"""


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.problems(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


def _spoilt() -> Column:
    """A problem's text with a wrong result, larger than any other number in it."""
    return F.concat("cot", F.lit("77"))


@query(f"WITH {_PROBLEMS} SELECT i AS id, kind, a, b, value, cot, holds, cot AS mended FROM t")
def arithmetic_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem for each part: whether its equation holds, which floored percentages don't, and its text after a spoilt result has been put right."""
    rows = _problems(spark, sf_dir)
    return rows.select("id", "kind", "a", "b", "value", "cot", U.verify_equations(F.col("cot")).alias("holds"), U.correct_arithmetic(_spoilt()).alias("mended"))


@query(f"""WITH {_PROBLEMS}, l AS (SELECT *, length(rtrim(a::VARCHAR, '0')) * length(rtrim(b::VARCHAR, '0')) + (kind = 'percent')::INT AS load FROM t)
SELECT kind, count(*) AS n, 1.0::DOUBLE AS score, round(avg(load), 9) AS mean_load, max(load)::INTEGER AS max_load, round(avg((load >= 5)::INT), 9) AS heavy, round(avg(holds::INT), 9) AS holds, 1.0::DOUBLE AS mended FROM l GROUP BY ROLLUP (kind)""")
def arithmetic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' problems: equations checked, corrected, scored, and their load per kind and overall."""
    checked = _problems(spark, sf_dir).select(
        "kind",
        U.verify_equations(F.col("cot")).alias("holds"),
        U.verify_arithmetic(F.col("cot"), F.col("answer")).alias("score"),
        F.aggregate(U.equation_loads(F.col("cot")), F.lit(0), lambda a, b: a + b).alias("load"),
        (U.correct_arithmetic(_spoilt()) == F.col("cot")).alias("mended"),
    )
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return checked.rollup("kind").agg(
        F.count("*").alias("n"), F.avg("score").alias("score"), F.round(F.avg("load"), 9).alias("mean_load"), F.max("load").alias("max_load"),
        share(F.col("load") >= 5).alias("heavy"), share(F.col("holds")).alias("holds"), share(F.col("mended")).alias("mended"),
    )


_FILLED = "list_filter(range(0, length({0}::VARCHAR)), lambda p: {0} // (10 ** p)::BIGINT % 10 > 0)"


@query(f"""WITH {_PROBLEMS}, s AS (SELECT *, len({_FILLED.format('a')}) AS fa, {_FILLED.format('b')} AS pb, a // b AS q FROM t)
SELECT i AS id, kind, a, b, (CASE WHEN kind = 'split' THEN len(list_filter(range(0, length(a::VARCHAR)), lambda p: a // (10 ** p)::BIGINT >= b)) + (q >= 10)::INT
  ELSE len(list_filter(pb, lambda p: b // (10 ** p)::BIGINT % 10 > 1)) * (2 * fa - 1) + len(list_filter(pb, lambda p: p > 0)) + len(pb) - 1 END)::INTEGER AS n_steps,
  (CASE WHEN kind = 'split' THEN q ELSE a * b END)::VARCHAR AS result, true AS hold FROM s""")
def arithmetic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' problems as long multiplications and divisions: how many steps, what they come to, and whether each holds."""
    rows = _problems(spark, sf_dir)
    split = F.col("kind") == "split"
    steps = F.when(split, U.division_steps(F.when(split, F.col("a")).otherwise(4), F.when(split, F.col("b")).otherwise(2))).otherwise(U.multiplication_steps(F.col("a"), F.col("b")))
    made = rows.select("id", "kind", "a", "b", steps.alias("steps"))
    result = F.substring_index(F.element_at("steps", -1), "= ", -1)
    return made.select("id", "kind", "a", "b", F.size("steps").alias("n_steps"), result.alias("result"), U.verify_equations(F.array_join("steps", "。")).alias("hold"))


@query("""
WITH p AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER () AS total, row_number() OVER (ORDER BY doc_id) - 1 AS step, count(*) OVER () AS steps FROM documents),
x AS (SELECT *, before::DOUBLE / total::DOUBLE AS t FROM p)
SELECT doc_id, round(CASE WHEN t < 0.1 THEN 0.001 * t / 0.1 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(3.141592653589793 * least(1.0, (t - 0.1) / 0.9))) END, 9) AS cosine,
  round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE greatest(0.0, 1 - (step - 100) / (steps - 100)::DOUBLE) END, 9) AS linear, (n + 1000) * 64 + 128 * 64 + 4 * (4 * 64 * 64 + 4 * 64 + 2 * 64 * 256 + 256 + 64 + 4 * 64) + 2 * 64 AS params, round((n * (1 + 0.85) * 0.85 * 9 * 3600)::DOUBLE, 3) AS budget FROM x
""")
def training_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rates at which each document in turn is read, by the characters and the documents before it, and sizes of a model and a budget that go with it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    whole = docs.agg(F.sum("n").alias("chars"), F.count("*").alias("docs")).first()
    placed = ordered.running_total(ordered.running_total(docs, [], "doc_id", F.col("n"), "before"), [], "doc_id", F.lit(1), "step")
    lit = lambda x: F.lit(x).cast("long")
    return placed.select(
        "doc_id",
        F.round(T.warmup_cosine(F.col("before") / max(1, whole["chars"] or 0), 1e-3, 1e-4, 0.1), 9).alias("cosine"),
        F.round(T.warmup_linear(F.col("step"), 100, whole["docs"]), 9).alias("linear"),
        T.transformer_params(F.col("n").cast("long") + 1000, lit(64), lit(4), lit(256), lit(128)).alias("params"),
        F.round(T.tokens_per_budget(F.col("n").cast("double"), F.lit(2), 0.85, F.lit(9)), 3).alias("budget"),
    )


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(9), '    '), chr(10)) AS ls FROM documents WHERE text <> '')
SELECT doc_id, md5(array_to_string(list_transform(ls, lambda x: repeat('<i>', ((length(x) - length(ltrim(x, ' '))) // 4)::BIGINT) || ltrim(x, ' ')), '<nl>')) AS coded FROM l""")
def joined_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with layout symbols, cut into pieces that lose nothing when joined."""
    cut = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", U.chunk_text(T.encode_layout(F.col("text")), 1000).alias("pieces"))
    return cut.select("doc_id", F.md5(F.array_join("pieces", "")).alias("coded"))
