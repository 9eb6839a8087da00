"""Text expressions: Column to Column, all built from Spark functions.

Offsets and lengths are code points.  Null texts give null unless a
docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
#: Characters that comparisons ignore.
IGNORED = "、。，,．・（）()「」『』“”\"'！!？?：:；;~〜 \u3000\t\n"
#: Words that join reasoning steps.
CONNECTORS = ("まず", "次に", "そして", "よって", "したがって", "最後に", "つまり")
#: Markers before a final answer, in order of priority.
ANSWER_MARKERS = ("答えは", "よって、", "したがって、", "よって", "したがって")
#: Sentence endings dropped from a final answer.
COPULAS = ("である", "です", "だ")
#: Endings dropped from a search query; the first that fits.
QUERY_ENDINGS = ("について教えて", "を教えて", "とは何ですか", "とは何", "でしょうか", "ですか", "とは", "は")
#: Endings without meaning of an attribute, in order.
ATTRIBUTE_ENDINGS = (
    "でしょうか", "ますか", "ですか", "ました", "します", "でしょう", "です", "ます", "か", "は", "が", "を", "に", "で", "と",
)
#: Words of arithmetic problems.
ARITHMETIC_HINT = "人で|円|個|%|時速|km|時間|縦|横|長方形|面積|割り勘"
#: Both appear in a refusal.
REFUSAL_PARTS = ("学習していない", "お答えできません")
MORE = "もっと見る"
JAPANESE = "[\u3040-\u30ff\u3400-\u9fff]"
URL = "https?://"
NEWLINE, INDENT = "<nl>", "<i>"
# ----------------------------------------------------------------------------

_BLANK = "(?U)[\\s\\x1c-\\x1f]"  # whitespace of all scripts


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def strip(c: Column) -> Column:
    """Without outer whitespace of any script."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Whitespace runs as one blank, outer ones dropped; null as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{_BLANK}+", " "))


def stripped_lines(c: Column) -> Column:
    """Array of stripped lines that are not blank."""
    lines = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1)
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def clean_article(c: Column, min_chars: int = 200) -> Column:
    """Lines stripped, blank lines and whole-line ``== headings ==`` dropped; null if shorter than ``min_chars``."""
    kept = F.filter(stripped_lines(c), lambda x: ~x.rlike(r"^=+\s*[^\n]*?\s*=+$"))
    out = F.array_join(kept, "\n")
    return F.when(F.length(out) >= min_chars, out)


def clean_web(
    c: Column,
    min_chars: int = 200,
    max_chars: int = 30_000,
    min_script_ratio: float = 0.3,
    script: str = JAPANESE,
    max_urls: int = 5,
    more: str = MORE,
) -> Column:
    """Lines stripped and blank ones dropped; null if a rule rejects the text.

    Rules: length, share of ``script`` characters, URLs, a run of ten equal
    characters, and more than two of the ``more`` phrase.
    """
    out = F.array_join(stripped_lines(c), "\n")
    good = F.length(out).between(min_chars, max_chars) & (count(out, URL) <= max_urls) & ~out.rlike(r"([^\n])\1{9,}")
    if min_script_ratio > 0:
        good = good & (count(out, script) >= F.length(out) * min_script_ratio)
    if more:
        good = good & (F.length(out) - F.length(F.replace(out, F.lit(more), F.lit(""))) <= 2 * len(more))
    return F.when(good, out)


def clean_code(c: Column, min_chars: int = 60, max_chars: int = 4000) -> Column:
    """Tabs as four blanks, line ends stripped, runs of three newlines or more as two; null if out of range."""
    spaced = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\t", "    ")
    lines = F.transform(F.split(spaced, "\n", -1), lambda x: F.regexp_replace(x, f"{_BLANK}+$", ""))
    out = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    out = F.regexp_replace(out, "^\n+|\n+$", "")
    return F.when((F.length(out) >= min_chars) & (F.length(out) <= max_chars), out)


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*(F.when(strip(c) != "", c) for c in columns))


def is_python(lang: Column) -> Column:
    return F.coalesce(F.lower(lang) == "python", F.lit(True))


def keep_pair(q: Column, a: Column, max_q: int, max_a: int) -> Column:
    """Neither empty nor too long, and no URL in either; false for nulls."""
    good = (F.length(q).between(1, max_q)) & (F.length(a).between(1, max_a)) & ~q.rlike(URL) & ~a.rlike(URL)
    return F.coalesce(good, F.lit(False))


def instruction_pair(instruction: Column, extra: Column, output: Column, response: Column) -> Column:
    """Struct ``(q, a)`` of an instruction row, null where a side is missing."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    # the first output that is not empty is stripped; one of blanks only counts as filled
    answer = text(F.when(F.coalesce(output, F.lit("")) != "", output).otherwise(response))
    q = F.concat(text(instruction), F.when(text(extra) != "", F.concat(F.lit("\n"), text(extra))).otherwise(F.lit("")))
    return F.when((text(instruction) != "") & (answer != ""), F.struct(q.alias("q"), answer.alias("a")))


def passes_score(score: Column, least: float) -> Column:
    """A missing score passes."""
    return score.isNull() | (score >= least)


def remove_ignored(c: Column) -> Column:
    return F.translate(c, IGNORED, "")


def fold_digits(c: Column) -> Column:
    """Each run of digits of any script as one 0."""
    return F.regexp_replace(c, r"(?U)\d+", "0")


def plain_question(c: Column) -> Column:
    """Without trailing question and exclamation marks, stripped."""
    return strip(F.regexp_replace(c, "[？?！!]+$", ""))


def bigrams(c: Column, whole_if_short: bool = True) -> Column:
    """Distinct character pairs; a text under two characters is itself its only gram, or has none."""
    chars = F.split(c, "")
    n = F.size(chars)
    pairs = F.array_distinct(F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b)))
    short = F.array(c) if whole_if_short else F.array().cast("array<string>")
    return F.when(F.length(c) >= 2, pairs).when(c.isNotNull(), short)


def grams12(c: Column) -> Column:
    """Distinct single characters and pairs; none for an empty text."""
    empty = F.array().cast("array<string>")
    single = F.when(F.length(c) > 0, F.array_distinct(F.split(c, ""))).otherwise(empty)
    return F.array_union(single, bigrams(c, whole_if_short=False))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def contained(small: Column, big: Column) -> Column:
    """Share of ``small`` in ``big``; 0 for nothing."""
    return F.when(F.size(small) > 0, F.size(F.array_intersect(small, big)) / F.size(small)).otherwise(F.lit(0.0))


def overlap(small: Column, big: Column) -> Column:
    """Share of the pairs of ``small`` that are in ``big``, whitespace removed."""
    bare = lambda c: F.regexp_replace(c, f"{_BLANK}+", "")
    return contained(bigrams(bare(small), False), bigrams(bare(big), False))


def encode_layout(c: Column) -> Column:
    """Newlines and leading groups of four blanks as symbols; leftover leading blanks dropped."""
    text = F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), "\t", "    ")

    def line(x: Column) -> Column:
        bare = F.regexp_replace(x, "^ +", "")
        lead = F.length(x) - F.length(bare)
        return F.concat(F.repeat(F.lit(INDENT), F.floor(lead / 4).cast("int")), bare)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), NEWLINE)


def decode_layout(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, "(<nl>|<i>) ", "$1"), "^ +", "")
    out = F.replace(F.replace(bare, F.lit(INDENT), F.lit("    ")), F.lit(NEWLINE), F.lit("\n"))
    return F.when(c.contains(NEWLINE) | c.contains(INDENT), out).otherwise(c)


def reasoning_steps(c: Column) -> Column:
    """The larger of filled lines and connectors, one at least; 0 for a blank text."""
    filled = F.size(stripped_lines(c))
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.greatest(filled, count(c, "|".join(CONNECTORS)), F.lit(1)))


def conciseness(c: Column, steps: Column) -> Column:
    per = F.length(c) / steps
    return (
        F.when((F.coalesce(F.length(c), F.lit(0)) == 0) | (steps == 0), 0.0)
        .when((per >= 15) & (per <= 60), 0.95)
        .when(per < 15, 0.6)
        .when(per <= 100, 0.75)
        .otherwise(0.4)
    )


def completeness(steps: Column) -> Column:
    return F.when(steps >= 3, 0.95).when(steps == 2, 0.75).when(steps == 1, 0.5).otherwise(0.0)


def split_reasoning(c: Column) -> Column:
    """Struct ``(reasoning, answer)``, cut at the last full stop that a blank follows."""
    text = strip(c)
    found = F.instr(text, "。 ") > 0
    return F.struct(
        F.when(found, F.concat(F.regexp_extract(text, "(?s)^(.*)。 (.*)$", 1), F.lit("。"))).otherwise(F.lit("")).alias("reasoning"),
        F.when(found, strip(F.regexp_extract(text, "(?s)^(.*)。 (.*)$", 2))).otherwise(text).alias("answer"),
    )


def final_segment(c: Column) -> Column:
    """What follows the last answer marker, or all; its last sentence without a final copula."""
    text = strip(c)
    after = text
    for marker in reversed(ANSWER_MARKERS):
        after = F.when(F.instr(text, marker) > 0, F.regexp_extract(text, f"(?s)^.*{marker}(.*)$", 1)).otherwise(after)
    parts = F.filter(F.transform(F.split(after, "[。\n]", -1), strip), lambda x: x != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(after)
    last = F.regexp_replace(last, "^[。 　]+|[。 　]+$", "")
    return strip(F.regexp_replace(last, f"({'|'.join(COPULAS)})$", ""))


def category_answer(c: Column, category: Column) -> Column:
    """How an answer is read depends on the category: a conversation's whole reply, else the final segment."""
    return F.when(category == "conversation", split_reasoning(c)["answer"]).otherwise(final_segment(c))


def contains_expected(answer: Column, expected: Column) -> Column:
    """Any of ``expected`` is in ``answer``, both normalised; one of digits only must stand alone as a number."""
    return F.exists(
        expected,
        lambda e: (e != "")
        & F.when(e.rlike(r"^[0-9]+$"), F.rlike(answer, F.concat(F.lit("(?<![0-9])"), e, F.lit("(?![0-9])")))).otherwise(answer.contains(e)),
    )


def keyword_hit(c: Column, keywords: Column) -> Column:
    """Null without keywords, else whether one is in the text."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.size(keywords) > 0, F.exists(keywords, lambda k: text.contains(k)))


def is_refusal(c: Column, parts: tuple[str, str] = REFUSAL_PARTS) -> Column:
    return c.contains(parts[0]) & c.contains(parts[1])


def split_entity_attribute(c: Column) -> Column:
    """Struct ``(entity, attribute)`` of a question.

    Cut at とは, else の, else は (the earlier of the last two); an entity under
    two characters keeps the whole question and no attribute.
    """
    base = F.regexp_replace(c, "？+$", "")
    towa, no, ha = (F.instr(base, p) for p in ("とは", "の", "は"))
    at = F.when(towa > 1, towa).when((no > 0) & ((ha == 0) | (no < ha)), no).when(ha > 0, ha).otherwise(F.length(base) + 1)
    skip = F.when(towa > 1, 2).otherwise(1)
    entity, raw = F.substring(base, F.lit(1), at - 1), F.substring(base, at + skip, F.length(base))
    head = F.regexp_extract(raw, "^([^はがをにでと]*)[はがをにでと]", 1)
    bare = raw
    for _ in range(3):  # the shortest head of two characters or more before an ending, so the longest ending that fits
        bare = F.regexp_replace(bare, f"(?s)^(.{{2,}}?)(?:{'|'.join(ATTRIBUTE_ENDINGS)})$", "$1")
    attribute = F.when(F.length(head) >= 2, head).otherwise(bare)
    short = F.length(entity) < 2
    return F.struct(
        F.when(short, base).otherwise(entity).alias("entity"),
        F.when(~short & (F.length(attribute) >= 2), attribute).alias("attribute"),
    )


def clean_query(c: Column) -> Column:
    """Without question marks and the first fitting ending; the stripped text if nothing is left."""
    q = strip(F.regexp_replace(strip(c), "[？?]+$", ""))
    out = q
    for ending in reversed(QUERY_ENDINGS):
        out = F.when(q.endswith(ending), F.substring(q, F.lit(1), F.length(q) - len(ending))).otherwise(out)
    return F.when(strip(out) != "", strip(out)).otherwise(strip(c))


def leading_sentences(c: Column, max_chars: int = 200, stop: str = "。") -> Column:
    """Whole sentences up to ``max_chars``, the first in any case; a blank text is cut."""
    sentences = F.filter(F.split(c, f"(?<={stop})", -1), lambda s: strip(s) != "")
    state = F.struct(F.element_at(sentences, 1).alias("text"), F.lit(False).alias("done"))

    def add(acc: Column, s: Column) -> Column:
        full = acc["done"] | (F.length(acc["text"]) + F.length(s) > max_chars)
        return F.struct(F.when(full, acc["text"]).otherwise(F.concat(acc["text"], s)).alias("text"), full.alias("done"))

    joined = F.aggregate(F.slice(sentences, F.lit(2), F.size(sentences)), state, add, lambda acc: acc["text"])
    return F.when(F.size(sentences) > 0, strip(joined)).otherwise(F.substring(c, 1, max_chars))


def repetition(c: Column, n: int = 4) -> Column:
    """Share of repeated character n-grams, whitespace removed; 0 under eight grams."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), f"{_BLANK}+", "")
    chars = F.split(s, "")
    m = F.length(s) - n + 1
    grams = F.slice(chars, F.lit(1), F.greatest(m, F.lit(0)))
    for j in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(chars, F.lit(j), F.greatest(m, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(m < 8, 0.0).otherwise(1 - F.size(F.array_distinct(grams)) / m)


def byte_tokens(c: Column) -> Column:
    """UTF-8 bytes plus 256."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + 256)


def char_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of characters; if one is empty, 1 when both are."""
    both = F.array_distinct(F.array_intersect(F.split(a, ""), F.split(b, "")))
    times = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))
    same = F.aggregate(both, F.lit(0), lambda acc, ch: acc + F.least(times(a, ch), times(b, ch)))
    p, r = same / F.length(a), same / F.length(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), (a == b).cast("double")).when(same == 0, 0.0).otherwise(2 * p * r / (p + r))


def split_bucket(c: Column, val_permille: int = 3) -> Column:
    """``val`` or ``train`` from the first eight digits of the MD5."""
    n = F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % 1000
    return F.when(n < val_permille, "val").otherwise("train")


def split_whole_hash(c: Column, val_permille: int = 10) -> Column:
    """``val`` or ``train`` from the whole MD5 as a number, a group of eight digits at a time (2**32 mod 1000 = 296)."""
    digits, acc = F.md5(c), F.lit(0).cast("long")
    for at in range(1, 33, 8):
        acc = (acc * 296 + F.conv(F.substring(digits, at, 8), 16, 10).cast("long")) % 1000
    return F.when(acc < val_permille, "val").otherwise("train")


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def sequence_ids(prompt: Column, reasoning: Column, answer: Column, bos: int, eos: int, max_len: int) -> Column:
    """BOS, prompt, reasoning, answer and EOS, cut to ``max_len`` (EOS may go)."""
    return F.slice(F.concat(F.array(F.lit(bos)), prompt, reasoning, answer, F.array(F.lit(eos))), 1, max_len)


def padded(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def labels_for(ids: Column, width: Column) -> Column:
    """Targets of a padded row: its ids, and -100, which a loss leaves out, where there is padding."""
    return padded(ids, width, -100)


def to_number(c: Column) -> Column:
    """A number written with or without commas and outer blanks; null for other texts."""
    return F.replace(strip(c), F.lit(","), F.lit("")).try_cast("double")


def warmup_cosine(progress: Column, peak: float, floor: float, warmup: float) -> Column:
    """Learning rate at a share of the training: linear warm-up to ``peak``, then a cosine to ``floor``."""
    t = F.least(F.lit(1.0), (progress - warmup) / max(1.0 - warmup, 1e-9))
    return F.when(progress < warmup, peak * progress / max(warmup, 1e-9)).otherwise(floor + 0.5 * (peak - floor) * (1 + F.cos(F.lit(3.141592653589793) * t)))


def warmup_linear(step: Column, warmup: int, total: int) -> Column:
    """Factor of the learning rate: linear warm-up to 1, then linearly to 0."""
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 1 - (step - warmup) / max(1, total - warmup)))


def transformer_params(vocab: Column, width: Column, layers: Column, hidden: Column, positions: Column) -> Column:
    """Parameters of a decoder with tied embeddings, learned positions and biases."""
    attention = width * width * 4 + width * 4
    layer = attention + width * hidden * 2 + hidden + width + width * 4
    return vocab * width + positions * width + layers * layer + width * 2


def tokens_per_budget(tps: Column, gpus: Column, efficiency: float, hours: Column, extra: float = 0.85) -> Column:
    """Tokens seen in ``hours`` at ``tps`` per device; each further device adds ``extra``."""
    return tps * (1 + (gpus - 1) * extra) * efficiency * hours * 3600
