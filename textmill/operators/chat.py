"""Questions and answers from conversations and reading data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.udfs import window_context
from textmill.operators.ordered import hash_number, in_ranges, within_budget

# --- Fixed values -----------------------------------------------------------
READ_PROMPT = "次の文章を読んで、質問に答えてください。文章に書かれていないことは答えないでください。\n文章：%s\n質問：%s"
SUM_PROMPT = "次の文章を、1〜2文で要約してください。\n文章：%s"
UNANSWERABLE = "文章には書かれていないため、答えられません。"
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "gpt")
# ----------------------------------------------------------------------------


def chat_turns(conversations: Column) -> Column:
    """Array of (role, text) from an array of structs with ``role`` or ``from`` and ``text``, ``content`` or ``value``."""
    return F.transform(
        conversations,
        lambda t: F.struct(
            F.lower(F.coalesce(t["role"], t["from"], F.lit(""))).alias("role"),
            T.collapse(F.coalesce(*(F.when(t[f] != "", t[f]) for f in ("text", "content", "value")))).alias("text"),
        ),
    )


def first_turns(*columns: Column) -> Column:
    """The first of several columns of turns that has any, as :func:`chat_turns`; all have the same fields."""
    return chat_turns(F.coalesce(*(F.when(F.size(c) > 0, c) for c in columns)))


def pair_or_fields(turns: Column, instruction: Column, output: Column) -> Column:
    """Struct ``(q, a)``: the first user turn that an assistant turn follows at once, else the row's two fields; null without either."""
    pairs = F.zip_with(turns, F.slice(turns, F.lit(2), F.greatest(F.size(turns), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    fits = F.filter(pairs, lambda p: p["x"]["role"].isin(*USER_ROLES) & F.coalesce(p["y"]["role"].isin(*ASSISTANT_ROLES), F.lit(False)))
    met = F.get(F.transform(fits, lambda p: F.struct(p["x"]["text"].alias("q"), p["y"]["text"].alias("a"))), F.lit(0))
    q, a = T.collapse(instruction), T.collapse(output)
    return F.coalesce(met, F.when((q != "") & (a != ""), F.struct(q.alias("q"), a.alias("a"))))


def first_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, q, a)``: the first user turn that an assistant turn follows at once, in each conversation.

    A conversation of any length is cut into ranges of turns, so none is one task.
    """
    said = turns.select(conversation, turn, F.lower(role).alias("r"), T.collapse(F.col(text)).alias("t"))
    ranged = in_ranges(said, [conversation], turn)
    inside = Window.partitionBy(conversation, "__range").orderBy(turn)
    spoken = F.struct("r", "t")
    # a range's last turn is followed by the first of the conversation's next range, of which there is a row each
    heads = ranged.groupBy(F.col(conversation).alias("__conv"), F.col("__range").alias("__r")).agg(F.min_by(spoken, turn).alias("head"))
    heads = heads.select("__conv", "__r", F.lead("head").over(Window.partitionBy("__conv").orderBy("__r")).alias("__next"))
    met = ranged.withColumn("__after", F.lead(spoken).over(inside)).join(heads, F.col(conversation).eqNullSafe(F.col("__conv")) & (F.col("__range") == F.col("__r")))
    met = met.withColumn("after", F.coalesce("__after", "__next")).where(F.col("r").isin(*USER_ROLES) & F.col("after.r").isin(*ASSISTANT_ROLES))
    return met.groupBy(conversation).agg(F.min_by(F.struct(F.col("t").alias("q"), F.col("after.t").alias("a")), turn).alias("p")).select(conversation, "p.q", "p.a")


def exclusion_reasons(pairs: DataFrame, order: str, max_q: int, max_a: int, leak: Column | None = None, q: str = "q", a: str = "a") -> DataFrame:
    """``pairs`` with ``reason``: the first that applies of format, length_or_url, duplicate and leak; null for rows that stay.

    A question counts as seen only once a row with it is kept, so rejected
    rows make no duplicates.
    """
    leaky = F.lit(False) if leak is None else F.coalesce(leak, F.lit(False))
    shape = F.when((F.coalesce(F.col(q), F.lit("")) == "") | (F.coalesce(F.col(a), F.lit("")) == ""), "format").when(~T.keep_pair(F.col(q), F.col(a), max_q, max_a), "length_or_url")
    judged = pairs.withColumns({"__shape": shape, "__leak": leaky})
    kept = judged.where("__shape is null and not __leak").groupBy(F.col(q).alias("__q")).agg(F.min(order).alias("__kept"))
    reason = F.coalesce("__shape", F.when(F.col(order) > F.col("__kept"), "duplicate"), F.when(F.col("__leak"), "leak"))
    return judged.join(kept, F.col(q) == F.col("__q"), "left").withColumn("reason", reason).drop("__shape", "__leak", "__q", "__kept")


def reading_rows(squad: DataFrame) -> DataFrame:
    """``(title, context, question, answer, answer_start, id)`` from nested reading data.

    The first answer counts; impossible questions and answers that are not
    where they say are dropped; ``title [SEP] body`` is split and offsets
    moved.
    """
    articles = squad.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    asked = articles.select("title", F.col("p.context").alias("whole"), F.explode("p.qas").alias("qa"))
    lead = F.regexp_extract("whole", r"(?s)^(.*?\s*\[SEP\]\s*)", 1)
    found = F.col("lead") != ""
    cut = asked.withColumn("lead", lead).select(
        F.when(found, T.strip(F.regexp_replace("lead", r"\s*\[SEP\]\s*$", ""))).otherwise(F.coalesce("title", F.lit(""))).alias("title"),
        F.substring("whole", F.length("lead") + 1, F.length("whole")).alias("context"),
        "qa",
        F.length("lead").alias("shift"),
    )
    answer = F.col("qa.answers")[0]
    flat = cut.where(~F.coalesce("qa.is_impossible", F.lit(False))).select(
        "title", "context", F.col("qa.question").alias("question"), answer["text"].alias("raw"), (answer["answer_start"] - F.col("shift")).alias("answer_start"), F.coalesce("qa.id", F.lit("")).alias("id")
    )
    there = F.substring("context", F.col("answer_start") + 1, F.length("raw")) == F.col("raw")
    return flat.where((F.col("raw") != "") & (F.col("answer_start") >= 0) & there).select(
        "title", "context", T.strip(F.col("question")).alias("question"), T.strip(F.col("raw")).alias("answer"), "answer_start", "id"
    )


def reading_items(rows: DataFrame, max_chars: int = 450) -> DataFrame:
    """Prompts over whole sentences around the answer; rows that do not fit are dropped."""
    seen = rows.withColumn("w", window_context(F.col("context"), F.col("answer_start"), F.length("answer"), max_chars)).where("w.context is not null")
    return seen.select("id", "title", F.col("w.context").alias("context"), "question", F.format_string(READ_PROMPT, "w.context", "question").alias("input"), "answer")


def summary_items(docs: DataFrame, key: str, text: str, min_lead: int = 40, max_lead: int = 160, body_chars: int = 450, min_body: int = 200, min_overlap: float = 0.30, stop: str = "。") -> DataFrame:
    """``(key, body, lead)``: the first paragraph as a summary of the following ones, where it is of fitting length, a sentence, and mostly said there.

    Paragraphs and bodies pass a generator of one row each, else every condition on them would work them out again.
    """
    once = lambda c: F.explode(F.array(c))
    paras = T.stripped_lines(F.col(text))
    state = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def add(acc: Column, p: Column) -> Column:
        full = acc["done"] | (F.length(acc["text"]) + F.length(p) > body_chars)
        return F.struct(F.when(full, acc["text"]).otherwise(F.concat(acc["text"], p)).alias("text"), full.alias("done"))

    lead = F.col("paras")[0]
    body = F.aggregate(F.slice("paras", F.lit(2), F.size("paras")), state, add, lambda acc: acc["text"])
    led = docs.select(key, once(paras).alias("paras")).where((F.size("paras") >= 3) & F.length(lead).between(min_lead, max_lead) & lead.endswith(stop))
    out = led.select(key, lead.alias("lead"), once(body).alias("body"))
    return out.where((F.length("body") >= min_body) & (T.overlap(F.col("lead"), F.col("body")) >= min_overlap)).select(key, "body", "lead")


def unanswerable_items(reading: DataFrame, n: int, max_overlap: float = 0.12, tries: int = 8, seed: str = "0") -> DataFrame:
    """Up to ``n`` questions with another article's text that hardly shares a pair of characters with them.

    Each question tries the rows a few hashed places further on; no product
    of all rows is formed.  Both sides grow with the data and are shuffled:
    files of repetitive texts look small enough to broadcast and are not.
    The first ``n`` by id are taken in ranges, as ``n`` may grow with the rows.
    """
    size = max(1, reading.count())
    placed = reading.withColumn("__h", hash_number("id", seed=seed))
    bounds = F.pmod("__h", F.lit(size))
    other = placed.select(bounds.alias("__slot"), F.col("title").alias("t2"), F.col("context").alias("c2"))
    mine = placed.select("id", "title", "question", F.explode(F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda k: F.pmod(F.col("__h") + k, F.lit(size)))).alias("__slot"))
    met = mine.join(other.hint("merge"), "__slot").where((F.col("title") != F.col("t2")) & (T.overlap(F.col("question"), F.col("c2")) <= max_overlap))
    first = met.groupBy("id").agg(F.min(F.struct("t2", "c2", "question")).alias("m"))
    return within_budget(first, [], "id", F.lit(1), n).select("id", F.format_string(READ_PROMPT, "m.c2", "m.question").alias("input"), F.lit(UNANSWERABLE).alias("answer"))
