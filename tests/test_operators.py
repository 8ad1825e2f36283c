"""Literal cases whose answers are known, for the operators that SQL does not check, and a few that it does."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from listenlake.operators import aggregates, generators, joins, listing, modeltext, predicates, windows


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merge_ranges_literal(spark):
    events = spark.createDataFrame([(1, "s", 4.0, 7.0), (1, "s", 6.9, 9.0), (1, "s", 1.0, 2.0), (1, "s", 3.0, 3.0), (1, "s", float("nan"), None)], "document_id long, segment_id string, start_s double, end_s double")
    merged = windows.merge_ranges(events)
    assert rows(merged, "start_s", "end_s") == [(1.0, 2.0), (4.0, 9.0)]
    segs = spark.createDataFrame([(1, "s", 8.0)], "document_id long, segment_id string, est_duration double")
    assert rows(aggregates.listened_progress(merged, segs), "heard_s", "total_s") == [(5.0, 8.0)]


def test_merge_ranges_agrees_with_a_loop_in_any_order(spark):
    rng = random.Random(7)
    data = [(d, "s", round(rng.uniform(0, 20), 1), round(rng.uniform(0, 20), 1)) for d in range(40) for _ in range(rng.randint(0, 12))]
    want = []
    for d in range(40):
        merged = []
        for a, b in sorted((min(x, y), max(x, y)) for e, _, x, y in data if e == d and x != y):
            if merged and a <= merged[-1][1] + 0.2:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(d, a, b) for a, b in merged]
    rng.shuffle(data)
    events = spark.createDataFrame(data, "document_id long, segment_id string, start_s double, end_s double")
    once = windows.merge_ranges(events)
    assert rows(once, "document_id", "start_s", "end_s") == sorted(want)
    assert rows(windows.merge_ranges(once), "document_id", "start_s", "end_s") == sorted(want)


def test_timeline_and_locate(spark):
    segs = spark.createDataFrame([(1, 0, 5.0), (1, 1, 10.0), (1, 2, 15.0), (2, 0, 5.0), (2, 1, float("nan")), (2, 2, -3.0)], "document_id long, seg_idx int, est_duration double")
    assert rows(windows.timeline(segs).where("document_id = 1"), "seg_idx", "start_s") == [(0, 0.0), (1, 5.0), (2, 15.0)]
    asked = spark.createDataFrame([(1, 1, 8.0), (1, 2, 999.0), (2, 3, -2.0), (1, 4, 5.0)], "document_id long, query_id long, second double")
    assert rows(joins.locate_time(asked, segs), "query_id", "seg_idx", "offset_s") == [(1, 1, 3.0), (2, 2, 15.0), (3, 0, 0.0), (4, 0, 5.0)]


def test_generation_plan(spark):
    def plan(count, current, buffer=3, everything=False):
        segs = spark.createDataFrame([(1, i, f"s{i}") for i in range(count)], "document_id long, seg_idx int, segment_id string")
        pointers = spark.createDataFrame([(1, current)], "document_id long, current int")
        cached = spark.createDataFrame([], "document_id long, segment_id string")
        return [r.seg_idx for r in listing.generation_plan(segs, pointers, cached, buffer, everything).orderBy("rank").collect()]

    assert plan(10, 4) == [4, 5, 6, 7] and plan(3, 2) == [2] and plan(5, 99) == [4] and plan(5, 2, everything=True) == [2, 3, 4, 0, 1]


def test_sentences_and_words(spark):
    blocks = spark.createDataFrame([(1, 0, "b0", "paragraph", "First sentence. Second sentence!"), (1, 1, "b1", "heading", "One. Two")], "document_id long, pos int, block_id string, kind string, text string")
    assert rows(generators.sentences(blocks), "seg_idx", "text", "start") == [(0, "First sentence.", 0), (1, "Second sentence!", 16), (2, "One. Two", 0)]
    words = generators.explode_words(spark.createDataFrame([(1, 0, "Fallback reader's test")], "document_id long, seg_idx int, text string"), offsets=True)
    assert rows(words, "start", "end", "word") == [(0, 8, "Fallback"), (9, 17, "reader's"), (18, 22, "test")]


def test_split_long_never_cuts_a_span(spark):
    text = "a" * 60 + ", " + "b" * 60 + "; " + "c" * 90
    df = spark.createDataFrame([(1, 0, text, [(121, 130), (150, 170)]), (1, 1, "short", [])], "document_id long, seg_idx int, text string, spans array<struct<start:int,end:int>>")
    out = generators.split_long(df, 100).orderBy("seg_idx", "part").collect()
    assert "".join(r.text for r in out if r.seg_idx == 0) == text and out[-1].text == "short"
    assert [r.start for r in out if r.seg_idx == 0] == [0, 61, 150] and out[0].text.endswith(",")


def test_merge_around_spans(spark):
    parts = spark.createDataFrame([(1, 0, 0, "Odd x. ", 0), (1, 0, 1, "y holds.[", 7), (1, 0, 2, "6][7] Next.", 16)], "document_id long, block_pos int, part int, text string, start int")
    spans = spark.createDataFrame([(1, 0, 4, 8, "merge"), (1, 0, 15, 18, "shift"), (1, 0, 18, 21, "shift")], "document_id long, block_pos int, start int, end int, mode string")
    assert rows(generators.merge_around_spans(parts, spans), "part", "text", "start") == [(0, "Odd x. y holds.[6][7]", 0), (1, " Next.", 21)]


@pytest.mark.parametrize(
    ("mode", "text", "spoken"),
    [
        ("natural", "Both https://a.io/x and https://b.io/y work.", "Both a link in the document and a link in the document work."),
        ("natural", "As shown [2], pages 12-15 (Smith, 2019) of Fig. 3.", "As shown, pages 12 to 15 of Figure 3."),
        ("verbatim", "As shown [2] by Fig. 3.", "As shown [2] by Fig. 3."),
        ("focused", "It holds (see Section 3) always (Fig. 2).", "It holds always."),
        ("natural", "Answer: No. 5 is better; No. 6 is 50% worse.", "Answer: No. 5 is better; number 6 is 50 percent worse."),
    ],
)
def test_spoken_text(spark, mode, text, spoken):
    df = spark.createDataFrame([(1, 0, text)], "document_id long, seg_idx int, text string")
    assert generators.spoken_text(df, mode).first().spoken_text == spoken


def test_spoken_words_align_with_the_page(spark):
    rng = random.Random(3)
    bits = ["see", "Fig. 2", "[3]", "https://a.io/b.", "12-15", "(Lee, 2020)", "e.g.", "50 %", "plain,", "words.", "§ 4"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "seg_idx int, text string")
    for r in generators.spoken_text(df).collect():
        assert [w["text"] for w in r.spans] == [w["text"] for w in generators._words(r.spoken_text)]
        assert all(0 <= w["start"] <= w["end"] <= len(r.text) for w in r.spans)


def test_pages_and_headings(spark):
    blocks = spark.createDataFrame([(1, i, f"b{i}", p, None) for i, p in enumerate([1, 1, 2, None, 5])] + [(2, i, f"b{i}", p, "x" if i == 2 else None) for i, p in enumerate([2, 1, 3, 3])], "document_id long, pos int, block_id string, page int, parent_id string")
    assert rows(windows.page_starts(blocks), "document_id", "block_id", "page") == [(1, "b0", 1), (1, "b2", 2), (1, "b4", 5), (2, "b0", 2), (2, "b3", 3)]
    heads = spark.createDataFrame([(1, 0, 1), (1, 1, 5), (1, 2, 2), (2, 0, 2), (2, 1, 4)], "document_id long, pos int, level int").withColumn("kind", F.lit("heading"))
    assert rows(windows.clamp_headings(heads), "document_id", "pos", "level") == [(1, 0, 1), (1, 1, 2), (1, 2, 2), (2, 0, 2), (2, 1, 3)]


def test_page_chrome(spark):
    pages = [(1, p, f"Journal of Reading · {11 + p}\nBody {'abc'[p - 1]} text.\nMore") for p in (1, 2, 3)] + [(2, p, "Head 1\nBody") for p in (1, 2)] + [(3, p, "# Chapter 1\nBody " + "xyz"[p - 1]) for p in (1, 2, 3)]
    df = spark.createDataFrame(pages, "document_id long, page int, text string").withColumn("text", F.when(F.col("document_id") == 1, F.concat("text", F.lit(" "), F.col("page").cast("string"), F.lit("x"), F.repeat(F.lit("y"), F.col("page")))).otherwise(F.col("text")))
    out = aggregates.strip_page_chrome(df, aggregates.page_chrome(df))
    assert all("Journal" not in r.text and "Body" in r.text for r in out.where("document_id = 1").collect())
    assert rows(out.where("document_id > 1"), "document_id", "page", "text") == rows(df.where("document_id > 1"), "document_id", "page", "text")


def test_page_seams_and_assembly(spark):
    pages = spark.createDataFrame([(1, 1, "The evi-"), (1, 2, "dence points without"), (1, 3, ""), (1, 4, "stopping here."), (1, 5, "A new one.")], "document_id long, page int, text string")
    text, spans = windows.assemble_pages(pages)
    assert text.first().text == "The evidence points without stopping here.\n\nA new one."
    assert rows(spans, "page", "start", "end") == [(1, 0, 8), (2, 7, 27), (4, 28, 42), (5, 44, 54)]


def test_clean_page_text(spark):
    df = spark.createDataFrame([(1, 1, "```text\nplain words\n```"), (1, 2, "  ## R E F E R E N C E S\n1 2 3 4\nT O  B E\n```\nA B C D\n```")], "document_id long, page int, text string")
    assert rows(generators.clean_page_text(df), "page", "text") == [(1, "plain words"), (2, "  ## REFERENCES\n1 2 3 4\nTO BE\n```\nA B C D\n```")]


def test_construct_inventory(spark):
    schema = "document_id long, pos int, block_id string, kind string, text string, code_language string, table_rows array<array<string>>, inlines array<struct<text:string,math:boolean,image:struct<alt:string,src:string>>>"
    df = spark.createDataFrame(
        [
            (1, 0, "b0", "math", "x=1", None, None, None),
            (1, 1, "b1", "code", "graph", "mermaid", None, None),
            (1, 2, "b2", "table", "", None, [["a", "b"]], None),
            (1, 3, "b3", "paragraph", "p", None, None, [("t", False, None), ("", False, ("A cat", "c.png")), ("", False, (" ", "d.png"))]),
            (1, 4, "b4", "paragraph", "p", None, None, None),
        ],
        schema,
    )
    assert rows(generators.construct_inventory(df), "construct_id", "kind", "source") == [("b0", "math-block", "x=1"), ("b1", "mermaid", "graph"), ("b2:r0", "table-row", "a, b"), ("b3:img0", "image", "A cat")]


def test_bookmark_targets(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", "Introduction", 1), (1, 1, "paragraph", "x", 2), (1, 2, "heading", "Methods", 3), (1, 3, "paragraph", "y", 5)], "document_id long, pos int, kind string, text string, page int")
    marks = spark.createDataFrame([(1, 0, "1. Introduction", 1), (1, 1, "2. Methods", 3), (1, 2, "Appendix", 4)], "document_id long, bm_idx int, title string, page int")
    assert rows(joins.bookmark_targets(marks, blocks), "bm_idx", "pos") == [(0, 0), (1, 2), (2, 3)]
    assert joins.bookmark_targets(marks.where("bm_idx = 0"), blocks).count() == 0


def test_rescue_annotations(spark):
    text = "The quick brown fox jumps over the lazy dog and runs far away into the deep dark wood, where nobody ever found it again."
    blocks = spark.createDataFrame([(1, 0, "Intro."), (1, 1, "New words. " + text.replace(" dog", "  dog"))], "document_id long, pos int, text string")
    notes = spark.createDataFrame(
        [(1, "keep", 0, 0, 0, 6, "Intro."), (1, "move", 0, 0, 0, 5, text), (1, "lost", 0, 1, 0, 3, "gone forever"), (1, "short", 1, 0, 1, 3, "brown fox")],
        "document_id long, annotation_id string, start_pos int, start_offset int, end_pos int, end_offset int, excerpt string",
    )
    got = {r.annotation_id: (r.status, r.start_pos, r.start_offset, r.end_pos, r.end_offset) for r in joins.rescue_annotations(notes, blocks).collect()}
    assert got["keep"] == ("kept", 0, 0, 0, 6) and got["lost"][0] == "orphaned"
    assert got["move"] == ("moved", 1, 11, 1, 11 + len(text) + 1) and got["short"] == ("moved", 1, 21, 1, 30)


def test_context_window(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", "Before it."), (1, 1, "code", "x"), (1, 2, "math", "y"), (1, 3, "paragraph", "Where y is. Then more.")], "document_id long, pos int, kind string, text string")
    out = windows.context_window(blocks, spark.createDataFrame([(1, 2)], "document_id long, pos int"), after=14)
    assert out.first().context == f"Before it. {windows.SLOT} Where y is."


def test_images(spark):
    content = bytearray(b"x" * 5000)
    images = spark.createDataFrame([(1, i, content) for i in range(3)] + [(1, 3, bytearray(b"y" * 5000)), (1, 4, bytearray(b"z"))], "document_id long, image_no int, content binary")
    counted = aggregates.repeated_images(images)
    assert rows(counted.where("not decoration"), "image_no") == [(3,)]
    budget = windows.image_budget(spark.createDataFrame([(1, 0, 6000, 1), (1, 1, 9000, 1), (1, 2, 4500, 1), (1, 3, 5000, 3)], "document_id long, image_no int, bytes long, repeats long"), total=11_000)
    assert rows(budget, "image_no", "kept", "skipped") == [(0, True, False), (1, False, True), (2, True, False), (3, False, False)]


def test_reconcile_narrations(spark):
    constructs = spark.createDataFrame([(1, i, f"b{i}", "image", h) for i, h in enumerate(["h0", "h1", "h2", "h3", "h4"])], "document_id long, ord int, construct_id string, kind string, source_hash string")
    entries = spark.createDataFrame(
        [(1, "b0", "image", "ready", "h0", 1, "p", "llm"), (1, "b1", "image", "ready", "old", 1, "p", "llm"), (1, "b9", "image", "ready", "h2", 1, "p", "llm"), (1, "b3", "image", "failed", "h3", 1, "p", "llm"), (1, "b4", "image", "ready", "h4", 0, "q", "manual")],
        "document_id long, construct_id string, kind string, status string, source_hash string, prompt_version int, prompt_hash string, origin string",
    )
    prompts = spark.createDataFrame([("image", "p")], "kind string, prompt_hash string")
    assert rows(joins.reconcile_narrations(constructs, entries, prompts, 1), "construct_id", "status", "queued") == [("b0", "ready", False), ("b1", "pending", True), ("b2", "ready", False), ("b3", "failed", True), ("b4", "ready", False)]


def test_ocr_outcome(spark):
    stats = spark.createDataFrame([(1, 1, True, ["scanned"], 0), (1, 2, True, ["sparse-text"], 5), (1, 3, True, ["garbled"], 900), (1, 4, True, ["no-text"], 0)], "document_id long, page int, needs_ocr boolean, reasons array<string>, native_chars int")
    seen = spark.createDataFrame([(1, 1, "text"), (1, 3, "text"), (1, 4, " ")], "document_id long, page int, text string")
    assert rows(aggregates.ocr_outcome(stats, seen), "unreadable", "recognized", "replaced", "left_out") == [(3, 2, 1, 1)]


def test_map_model_asks_rejects_once_more(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "worse")], "request_id long, prompt string")

    def run(prompts, strict):
        return [p if p == "good" or (strict and p == "bad") else "" for p in prompts]

    out = modeltext.map_model(df.repartition(1), run, lambda a: a or None)
    assert rows(out, "request_id", "answer", "status") == [(1, "good", "ready"), (2, "bad", "ready"), (3, None, "failed")]


def test_answers_are_stored_and_asked_for_once(spark, tmp_path):
    def counted(name):
        (tmp_path / name).mkdir(exist_ok=True)

        def run(prompts, strict):
            for p in prompts:
                (tmp_path / name / f"{abs(hash((p, strict, os.getpid())))}-{len(os.listdir(tmp_path / name))}").write_text(p)
            return [p.upper() if p != "bad" else "" for p in prompts]

        return run, lambda: sorted(f.read_text() for f in (tmp_path / name).iterdir())

    accept, table = (lambda a: a or None), f"{tmp_path}/answers"
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, "bad"), (5, None)], "request_id long, prompt string").repartition(2)
    run, asked = counted("first")
    out = modeltext.ask_once(df, run, accept, table, "m", 1)
    assert rows(out, "request_id", "answer", "status") == [(1, "ONE", "ready"), (2, "TWO", "ready"), (3, "ONE", "ready"), (4, None, "failed"), (5, None, "failed")]
    assert asked() == ["", "", "bad", "bad", "one", "two"]  # one question for two requests, rejects twice
    run, asked = counted("second")
    more = df.union(spark.createDataFrame([(6, "new")], df.schema))
    assert rows(modeltext.ask_once(more.where("prompt <> 'bad'"), run, accept, table, "m", 1), "request_id", "answer") == [(1, "ONE"), (2, "TWO"), (3, "ONE"), (6, "NEW")]
    assert asked() == ["new"]
    run, asked = counted("third")
    modeltext.ask_once(df.where("request_id = 1"), run, accept, table, "m", 2).collect()
    assert asked() == ["one"]  # another version of the prompt

    def broken(prompts, strict):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        modeltext.ask_once(df.withColumn("prompt", F.concat(F.lit("late "), "prompt")), broken, accept, table, "m", 1)
    assert rows(modeltext.ask_once(df.where("request_id < 3"), broken, accept, table, "m", 1), "answer") == [("ONE",), ("TWO",)]
    with pytest.raises(Exception, match="prompts got"):
        modeltext.map_model(df, lambda p, s: p[1:], accept).collect()


def test_small_budgets(spark):
    segs = spark.createDataFrame([(1, i, i // 2, "x" * 9 + ".") for i in range(9)], "document_id long, seg_idx int, block_pos int, text string")
    heads = spark.createDataFrame([(1, i, 2 * i, f"T{i}", 1 + i % 2) for i in range(6)], "document_id long, entry_idx int, pos int, title string, level int")
    assert rows(windows.pack_to_budget(segs, 45), "packed", "cut_at") == [(4, 4)]
    assert [r.outline for r in windows.outline_text(heads, most=2).collect()] == ["- T0\n  - T1\n(+4 more sections)"]
    assert rows(aggregates.outline_level_cap(heads, segs, cap=4), "entry_idx") == [(0,), (2,), (4,)]
    assert rows(windows.passage_range(segs, spark.createDataFrame([(1, 0, 1, 5)], "document_id long, range_id int, first int, last int"), most=40), "text", "truncated") == [("⟦1⟧ xxxxxxxxx.\n\n⟦2⟧ xxxxxxxxx.", True)]
    bounds = heads.where("entry_idx = 0").select("document_id", "pos", F.lit("s").alias("section"), "title")
    assert [r.text for r in aggregates.section_text(segs, bounds, most=12).collect()] == ["xxxxxxxxx. x … (section continues)"]
    nodes = spark.createDataFrame([(1, 0, "T0", 1, "ready", "Note.")], "document_id long, ord int, title string, level int, status string, summary string")
    docs = spark.createDataFrame([(1, "D"), (2, "E")], "document_id long, title string")
    state = spark.createDataFrame([(1, "Knows much.")], "document_id long, state string")
    packed = {r.document_id: (r.context, r.truncated) for r in modeltext.assistant_pack(docs, heads.where("entry_idx < 2"), nodes, segs, state, chars=30).collect()}
    assert packed[1] == ("=== OUTLINE ===\n- T0 ⟦0⟧\n  - T1 ⟦4⟧\n\n=== STUDY NOTES ===\n- T0 — Note.\n\n=== READER STATE ===\nKnows much.\n\n=== DOCUMENT: D ===\n⟦0⟧ xxxxxxxxx. ⟦1⟧ xxxxxxxxx.\n\n[Passages ⟦2⟧ to ⟦8⟧ are left out here; they can be read one by one.]", True)
    assert packed[2] == ("=== DOCUMENT: E ===\n", False)


def test_image_budget_agrees_with_a_loop(spark):
    rng = random.Random(8)
    data = [(d, i, rng.randint(3000, 9000), rng.randint(1, 4)) for d in range(30) for i in range(rng.randint(1, 20))]
    want = []
    for d in range(30):
        left = 40_000
        for e, i, size, repeats in data:
            if e == d:
                plain = size >= 4096 and repeats < 3
                fits = plain and size <= 8500 and size <= left
                left -= size * fits
                want.append((d, i, fits, plain and not fits))
    got = windows.image_budget(spark.createDataFrame(data, "document_id int, image_no int, bytes long, repeats long").repartition(5), each=8500, total=40_000)
    assert rows(got, "document_id", "image_no", "kept", "skipped") == want and "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_gate_narration_shapes(spark):
    df = spark.createDataFrame([("math-inline", "x squared."), ("math-block", "Here gamma is the rate. More."), ("math-block", "The sum grows."), ("table-row", "One two three. " * 20), ("image", "")], "kind string, answer string")
    got = {(r.kind, r.answer): (r.reason, r.clean) for r in modeltext.gate_narration(df, modeltext.budgets(spark)).collect()}
    assert got["math-inline", "x squared."] == ("ok", "x squared") and got["math-block", "Here gamma is the rate. More."] == ("ok", "Here gamma is the rate.")
    assert got["math-block", "The sum grows."][0] == "shape" and got["image", ""][0] == "empty"
    assert len(got["table-row", "One two three. " * 20][1]) <= 200


def test_predicates_on_literals(spark):
    df = spark.createDataFrame([("Это совсем русский текст без латиницы вообще", "en"), ("The wind of the north is in the trees", "en"), ("Der Wind aus dem Norden weht heute", "en"), ("short", "en")], "text string, language string")
    assert [r.plausible for r in predicates.language_gate(df).collect()] == [False, True, False, True]
    marked = spark.createDataFrame([("a ﻿ fileciteturn0file0 b citeturn0search3",)], "text string")
    assert predicates.strip_citation_artifacts(marked).first().clean_text == "a ﻿ b"


def test_compose_article(spark):
    df = spark.createDataFrame([("T", "Ann", "ann", "2024-03-05", "https://www.a.io/x", "Body"), ("T", None, "Site", None, "https://a.io", "# T!\nBody")], "title string, author string, site string, published string, url string, text string")
    assert [r.markdown for r in generators.compose_article(df).collect()] == ["# T\n\n*By Ann · a.io · March 5, 2024*\n\nBody", "*Site*\n\n# T!\nBody"]


def test_narration_gate_declines_and_keeps_whole_explanations(spark):
    long = "Here x is the rate of it. It grows with y over time. It falls with z at last."
    answers = [("math-block", "Skip this one"), ("math-block", long), ("table-row", "skip it is a plain word")]
    df = spark.createDataFrame(answers, "kind string, answer string")

    def gated(prose, most):
        params = spark.createDataFrame([("math-block", most, prose), ("table-row", 0, None)], "kind string, max_chars int, math_prose string")
        return {(r.kind, r.reason): r.clean for r in modeltext.gate_narration(df, params).collect()}

    one, whole, cut = gated(None, 400), gated("explanation", 400), gated("explanation", 60)
    assert one["math-block", "skip"] is None and one["table-row", "ok"] == "skip it is a plain word"
    assert one["math-block", "ok"] == "Here x is the rate of it." and whole["math-block", "ok"] == long
    assert cut["math-block", "ok"] == "Here x is the rate of it. It grows with y over time."


def test_context_looks_past_what_is_not_prose(spark):
    rows = [(1, 0, "paragraph", "The lead prose.")] + [(1, i, "table", "cells") for i in range(1, 300)] + [(1, 300, "math", "x"), (1, 301, "paragraph", "What follows.")]
    blocks = spark.createDataFrame(rows, "document_id long, pos int, kind string, text string")
    got = windows.context_window(blocks, blocks.where("kind = 'math'").select("document_id", "pos")).first()
    assert got.context == f"The lead prose. {windows.SLOT} What follows."


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("listenlake", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(root, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
