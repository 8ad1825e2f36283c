"""Lookups that must not depend on a document's size: seeds, bins, running lengths and words, against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from listenlake.operators import aggregates, joins, predicates, windows

WORDS = "red river stone a an the of light é naïve tree-top don't 12 \U0001f600 abc".split()


def line(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", ", ", ". "]) for _ in range(n)).strip()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_holders_agree_with_a_loop(spark):
    rng = random.Random(3)
    texts = [(d, t, line(rng, rng.randint(1, 30))) for d in range(4) for t in range(25)] + [(1, 90, None), (1, 91, ""), (2, 92, "x" * 5000)]
    needles = []
    for i in range(300):
        d, _, text = rng.choice(texts)
        text = text or "zz"
        a = rng.randrange(len(text))
        n = text[a : a + rng.choice([1, 2, 3, 5, 9, 14, 40, 80])]
        needles.append((rng.choice([d, d, 3]), i, n if rng.random() < 0.8 else n + "q"))
    needles += [(0, 900, ""), (0, 901, None), (77, 902, "red"), (2, 903, "x" * 4000)]
    got = joins.holders(spark.createDataFrame(needles, "document_id int, needle_id int, needle string"), spark.createDataFrame(texts, "document_id int, text_id int, text string"))
    want = sorted((d, i, t) for d, i, n in needles if n for e, t, text in texts if e == d and text and n in text)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_rescue_finds_moved_annotations(spark):
    rng = random.Random(5)
    old = {(d, p): line(rng, rng.randint(4, 60)) for d in range(3) for p in range(12)}
    new = {}
    for (d, p), text in old.items():
        kind = rng.choice(["same", "same", "gone", "front", "blanks"])
        if kind != "gone":
            new[d, p] = {"same": text, "front": "New start. " + text, "blanks": text.replace(" ", " \t ")}[kind]
    rows = []
    for i, ((d, p), text) in enumerate(old.items()):
        a = rng.randrange(len(text))
        b = rng.randint(a + 1, len(text))
        rows.append((d, f"a{i}", p, a, p, b, " ".join(text[a:b].split())))
    rows = [r for r in rows if r[6]]
    blocks = [(d, p, text) for (d, p), text in new.items()]
    out = joins.rescue_annotations(spark.createDataFrame(rows, "document_id int, annotation_id string, start_pos int, start_offset int, end_pos int, end_offset int, excerpt string"), spark.createDataFrame(blocks, "document_id int, pos int, text string"), probe=20)
    joined = [x for x in plan_of(out).split("\n") if "Join Inner" in x]
    assert joined and all(x.count(" = ") >= 2 for x in joined if "regexp" in x.lower() or "contains" in x.lower())  # no text is tried for its document alone

    def pattern(probe):
        return r"\s+".join(map(re.escape, " ".join(probe.split()).split(" ")))

    def want(d, p, a, b, excerpt):
        text = new.get((d, p))
        if text is not None and b <= len(text):
            now = " ".join(text[a:b].split())
            if now.startswith(excerpt[:20]) and now.endswith(excerpt[-20:]):
                return ("kept", p, a, p, b)
        mine = sorted((q, t) for (e, q), t in new.items() if e == d)
        for q, t in mine:
            m = re.search(pattern(excerpt[:20]), t)
            if m:
                if len(excerpt) <= 20:
                    return ("moved", q, m.start(), q, m.end())
                for r, u in mine:
                    shift = m.start() if r == q else 0
                    tail = re.search(pattern(excerpt[-20:]), u[shift:]) if r >= q else None
                    if tail:
                        return ("moved", q, m.start(), r, shift + tail.end())
                break
        return ("orphaned", p, a, p, b)

    got = {r.annotation_id: (r.status, r.start_pos, r.start_offset, r.end_pos, r.end_offset) for r in out.collect()}
    assert got == {i: want(d, p, a, b, excerpt) for d, i, p, a, _, b, excerpt in rows}
    assert {s for s, *_ in got.values()} == {"kept", "moved", "orphaned"}


def test_words_survive_a_new_cut(spark):
    old = spark.createDataFrame([(1, "s0", 0, 0, "One two, three."), (1, "s1", 0, 16, "Don't stop-it now"), (1, "s2", 1, 0, "...")], "document_id int, segment_id string, block_pos int, start int, text string")
    pointers = spark.createDataFrame([(1, "p0", "s0", 2), (1, "p1", "s1", 1), (1, "p2", "s1", 0), (1, "p3", "s2", 0), (1, "p4", "s1", 9), (1, "p5", "zz", 0)], "document_id int, position_id string, segment_id string, word_idx int")
    places = joins.word_place(pointers, old)
    assert sorted((r.position_id, r.block_pos, r.offset) for r in places.collect()) == [("p0", 0, 9), ("p1", 0, 22), ("p2", 0, 16), ("p3", 1, 0), ("p4", 0, 16)]
    new = spark.createDataFrame([(1, 0, "n0", 0, 0, 20, "One two, three. Don'", 4.0), (1, 1, "n1", 0, 20, 33, "t stop-it now", 6.0), (1, 2, "n2", 1, 3, 6, "...", float("nan"))], "document_id int, seg_idx int, segment_id string, block_pos int, start int, end int, text string, est_duration double")
    got = {r.position_id: (r.segment_id, r.word_idx, round(r.offset_s, 6)) for r in joins.remap_position(places, new).collect()}
    assert got == {"p0": ("n0", 2, 2.0), "p1": ("n1", 1, 2.0), "p2": ("n0", 3, 3.0), "p3": ("n2", 0, 0.0), "p4": ("n0", 3, 3.0)}
    beyond = spark.createDataFrame([(1, "x", 0, 500), (1, "y", 9, 0)], "document_id int, position_id string, block_pos int, offset int")
    assert [(r.segment_id, r.word_idx) for r in joins.remap_position(beyond, new).collect()] == [("n1", 2)]


def test_context_frames_agree_with_whole_texts(spark, monkeypatch):
    rng = random.Random(9)
    data = {d: {p: rng.choice([line(rng, rng.randint(1, 40)), line(rng, 3), "  ", "w" * 300]) for p in rng.sample(range(60), 40)} for d in range(4)}
    data[7] = {0: " ", 1: ""}
    blocks = spark.createDataFrame([(d, p, t) for d, own in data.items() for p, t in own.items()], "document_id int, pos int, text string")
    asked = [(d, d * 100 + i, s, s + rng.randint(0, 5)) for d in data for i, s in enumerate(rng.sample(range(-3, 65), 30))]
    picked = spark.createDataFrame(asked, "document_id int, selection_id int, start_pos int, end_pos int")
    for size in (64, 2048):
        monkeypatch.setattr(windows, "TEXT_BIN", size)
        got = {r.selection_id: (r.before, r.after) for r in windows.explain_context(blocks, picked, before=120, after=70).collect()}
        want = {}
        for d, i, s, e in asked:
            body = sorted((p, t.strip(" ")) for p, t in data[d].items() if t.strip(" "))
            if body:
                b, a = "\n".join(t for p, t in body if p <= s), "\n".join(t for p, t in body if p > e)
                want[i] = (re.sub(r"^\S+\s", "", b[-120:], count=1) if len(b) > 120 else b, re.sub(r"(?s)(?<=.)\s\S*\Z", "", a[:70], count=1) if len(a) > 70 else a)
        assert got == want


def test_first_block_from_a_page_on(spark):
    rng = random.Random(2)
    data = [(d, p, rng.choice([None, *range(1, 9)]), rng.choice([None, None, "x"])) for d in range(6) for p in range(15)] + [(9, 0, None, None)]
    asked = [(d, q, page) for d in (*range(6), 9, 10) for q, page in enumerate([-2.0, 0.0, 1.4, 2.5, 4.0, 7.0, 99.0])]
    got = aggregates.block_for_page(spark.createDataFrame(data, "document_id int, pos int, page int, parent_id string"), spark.createDataFrame(asked, "document_id int, query_id int, page double"))
    want = []
    for d, q, page in asked:
        pages = [g for e, _, g, _ in data if e == d and g is not None]
        top = [(p, g) for e, p, g, parent in data if e == d and g is not None and parent is None]
        if top:
            at = max(1, min(max(pages), math.floor(page + 0.5)))
            want.append((d, q, min([p for p, g in top if g >= at], default=max(p for p, _ in top))))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_long_annotated_documents_are_many_groups(spark):
    n = 3000
    segs = spark.range(n).select(F.lit(1).alias("document_id"), F.col("id").cast("int").alias("seg_idx"), F.col("id").cast("int").alias("block_pos"), F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit("ten blanks").alias("text"))
    notes = spark.range(n).select(F.lit(1).alias("document_id"), F.concat(F.lit("a"), "id").alias("annotation_id"), F.col("id").cast("int").alias("start_pos"), F.lit(3).alias("start_offset"), (F.col("id") + F.col("id") % 3 - F.when(F.col("id") % 50 == 0, 5).otherwise(0)).cast("int").alias("end_pos"), F.lit(7).alias("end_offset"))
    covered = joins.annotation_passages(notes, segs)
    want = sum(max(0, min(n - 1, i + i % 3 - (5 if i % 50 == 0 else 0)) - i + 1) for i in range(n))
    assert covered.count() == want
    keys = [x for x in plan_of(covered).split("\n") if "Join Inner" in x]
    assert keys and all("__bin" in x for x in keys)
    words = spark.createDataFrame([(1, 0, 0, 0, 70), (1, 0, 1, 71, 72), (1, 0, 2, 80, 80)], "document_id int, seg_idx int, word_idx int, start int, end int")
    chars = spark.range(200).select(F.lit(1).alias("document_id"), F.lit(0).alias("seg_idx"), F.col("id").cast("int").alias("char_pos"), (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 1.0).alias("end_s"))
    assert sorted(tuple(r)[2:] for r in joins.word_timing_from_chars(words, chars).collect()) == [(0, 0.0, 70.0), (1, 71.0, 72.0)]


def test_more_back_matter_titles_from_a_table(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", "3. Glossary:"), (1, 1, "paragraph", "Glossary"), (1, 2, "heading", "Notes"), (2, 0, "heading", "Glossary of terms"), (2, 1, "heading", None)], "document_id int, pos int, kind string, text string")
    titles = spark.createDataFrame([("Glossary",), ("A. GLOSSARY.",), (None,), ("",)], "title string")
    marked = predicates.back_matter_heading(blocks, titles)
    assert marked.columns == [*blocks.columns, "back_matter"]
    assert sorted((r.document_id, r.pos) for r in marked.where("back_matter").collect()) == [(1, 0), (1, 2)]
    assert sorted((r.document_id, r.pos) for r in predicates.back_matter_heading(blocks, ("glossary",)).where("back_matter").collect()) == [(1, 0), (1, 2)]
    assert marked.count() == 5
