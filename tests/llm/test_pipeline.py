"""Each stage of the pipeline against brute force, on documents of the smallest tables and planted cases."""

import pytest
import sentencepiece
from test_dedup import bench_words, shingles, union_find

import corpus_pipeline
from textmill.llm.langid import UNKNOWN, fit_language_model, language_folds, predict_language
from textmill.llm.line_dedup import MIN_CHARS, SHINGLE
from textmill.llm.sentencepiece_codec import MODEL, SPACE

SF = "/root/testdata/sf0.001"


def brute_line_stage(rows):
    places = [(i, p, x.strip(" \t\r")) for i, t in sorted(rows.items()) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")]
    sets = [{x[k : k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for _, _, x in places]

    def linked(a, b):
        (x, y), (s, t) = (places[a][2], places[b][2]), (sets[a], sets[b])
        fuzzy = min(len(x), len(y)) >= MIN_CHARS and 10 * min(len(s), len(t)) >= 8 * max(len(s), len(t))
        return x == y or (fuzzy and 100 * len(s & t) >= 80 * len(s | t))

    roots = union_find(len(places), [(a, b) for a in range(len(places)) for b in range(a) if linked(a, b)])
    gone = {(i, p) for n, (i, p, _) in enumerate(places) if roots[n] != n}
    out = {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows.items()}
    touched = {i for i, _ in gone}
    return {i: t for i, t in out.items() if i not in touched or t.strip(" \t\r\n")}


def brute_minhash_stage(rows):
    ids = sorted(rows)
    sets = [shingles(rows[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {ids[n]: rows[ids[n]] for n, root in enumerate(union_find(len(ids), links)) if root == n}


def brute_leak_stage(rows, items):
    cut = lambda w, size: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    def leaks(text, item):
        size = min(5, len(item))
        own = cut(item, size)
        return bool(item) and 100 * len(own & cut(text, size)) >= 80 * len(own)

    return {i: t for i, t in rows.items() if not any(leaks(bench_words(t), bench_words(x)) for x in items)}


def test_stages_match_brute_force(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    few = real.where("length(text) between 400 and 2500").orderBy("doc_id").limit(60)
    base = [r.asDict() for r in few.collect()]
    text, words = base[0]["text"].replace("\n", " "), base[1]["text"].replace("\n", " ").split()
    near = " ".join("zz" if i == len(words) // 2 else w for i, w in enumerate(words))
    leak = max(items, key=lambda x: len(bench_words(x or "")))
    planted = [text, text[:50] + "#" + text[51:], base[2]["text"] + "\nLes.", base[3]["text"] + "\nLes.", " ".join(words), near, base[4]["text"] + " " + leak]
    rows = base + [base[0] | {"doc_id": 10_000_000 + i, "text": t} for i, t in enumerate(planted)]
    frame = spark.createDataFrame(rows, real.schema)
    steps = dict(corpus_pipeline.STAGES)
    run = lambda name, df: steps[name](spark, df, SF)
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    model = fit_language_model(language_folds(frame).where("not held_out"))
    judged = {r.doc_id: r for r in predict_language(frame.select("text", "doc_id"), model, keep=("doc_id",)).collect()}
    known = run("language_id", frame)
    assert set(texts(known)) == {i for i, r in judged.items() if r.lang_pred != UNKNOWN and r.score >= 0.5} and len(texts(known)) > 40

    lines = brute_line_stage(texts(frame))
    got = run("line_dedup", frame)
    assert texts(got) == lines and lines != texts(frame)
    kept = brute_minhash_stage(texts(frame))
    assert texts(run("minhash_dedup", frame)) == kept and len(kept) < len(rows)
    clean = brute_leak_stage(texts(frame), items)
    assert texts(run("decontamination", frame)) == clean and 10_000_006 not in clean

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    whole = brute_leak_stage(brute_minhash_stage(brute_line_stage(texts(known))), items)
    for name in ("line_dedup", "minhash_dedup", "decontamination"):
        known = run(name, known)
    ids = {r.doc_id: list(r.ids) for r in run("sentencepiece", known).collect()}
    assert ids == {i: processor.encode(t) for i, t in whole.items()}
    assert all(processor.decode(ids[i]) == t.replace(SPACE, " ") for i, t in whole.items())


def test_last_stage_decodes(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "plain text"), (2, ""), (3, None)], "doc_id long, text string")
    coded = frame.selectExpr("doc_id", "array(1) AS ids", "1L AS n_tokens", "if(doc_id = 3, null, doc_id <> 1) AS round_trip")
    assert {r.doc_id for r in corpus_pipeline.encode(spark, frame, SF).collect()} == {1, 2, 3}
    monkeypatch.setattr(corpus_pipeline, "encode_documents", lambda docs, **_: coded)
    with pytest.raises(Exception, match="do not decode to the text of document 1"):
        corpus_pipeline.encode(spark, frame, SF).collect()


EDGE = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, removed int, score string, found_id long, gone int"


def test_composed_stages_take_edge_rows(spark):
    long = "the quick brown fox jumps over the lazy dog and runs home again"
    texts = [None, "", " \n\t ", "!!", long, long, long + " today", "x" * 300_000, "one\n\none", "Les.\n" + long + "\nLes."]
    rows = [(i, t, "en", None, None, "dotted", 1, None, None, None) for i, t in enumerate(texts)]
    rows += [(None, long + " by null", None, "s", 1, None, None, "0.5", 7, 1), (5, long, "en", None, None, "dotted", 1, None, None, None)]
    real = [(100 + r.doc_id, r.text, r.lang, r.source, r.n_chars, "", 0, "", 0, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    for some in (rows + real, []):
        docs = spark.createDataFrame(some, EDGE)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert out.columns == docs.columns and set(out.columns) >= {"a.b", "removed"}
                docs = spark.createDataFrame(out.collect(), EDGE)
                assert {r["a.b"] for r in docs.select("`a.b`").collect()} <= {"dotted", "", None}
        kept = out.collect()
        assert len(kept) <= len(some) and all(r.n_tokens == len(r.ids) for r in kept) and (not some or len(kept) > 20)
