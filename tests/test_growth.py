"""Rows that are long, common or many: each case failed, or took minutes, before the step that it is about was mended."""

import time

from pyspark.sql import functions as F

from listenlake.functions import needles
from listenlake.operators import aggregates, generators, joins, modeltext, predicates, windows  # noqa: F401
from listenlake.sources import library
from listenlake.streaming import playback


def test_long_lines_and_blank_runs_of_pages(spark):
    line = "for " * 50_000
    pages = spark.createDataFrame([(1, 1, f"Head\n{line}x,"), (1, 2, f"{' ' * 60_000}and\na" + " " * 60_000 + "b"), (1, 3, f"{line}end.")], "document_id int, page int, text string")
    begun = time.monotonic()
    assert [r.seam for r in windows.page_seams(pages).orderBy("page").collect()] == [None, "space", "space"]
    text, spans = windows.assemble_pages(pages)
    assert [(r.start, r.end) for r in spans.orderBy("page").collect()] == [(0, 200_007), (200_008, 260_014), (260_015, 460_019)]
    assert text.first().text.startswith("Head\nfor for") and time.monotonic() - begun < 60


def test_kinds_are_no_hot_keys(spark):
    kinds = spark.createDataFrame([("image", "Describe {{source}}")], "kind string, template string")
    params = modeltext.budgets(spark)
    asked = modeltext.narration_requests(spark.range(9).selectExpr("id as document_id", "'c' as construct_id", "'image' as kind", "'s' as source", "'' as header", "'' as context"), kinds, params)
    gated = modeltext.gate_narration(spark.range(9).selectExpr("id", "'image' as kind", "'A tree of α leaves.' as answer"), params)
    assert {r.prompt for r in asked.collect()} == {"Describe s"} and {r.clean for r in gated.collect()} == {"A tree of alpha leaves."}
    for plan in (asked, gated):
        assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_remapped_positions_leave_texts_behind(spark):
    segs = spark.createDataFrame([(1, 0, "s0", 0, 0, 7, "one two", 2.0), (1, 1, "s1", 0, 7, 13, " three", 1.0)], "document_id int, seg_idx int, segment_id string, block_pos int, start int, end int, text string, est_duration double")
    places = spark.createDataFrame([(1, "p", 0, 5), (1, "q", 0, 99)], "document_id int, position_id string, block_pos int, offset int")
    out = joins.remap_position(places, segs)
    assert sorted(tuple(r)[1:] for r in out.collect()) == [("p", "s0", 1, 1.0), ("q", "s1", 0, 0.0)]
    group = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "text#" not in group.split("Aggregate")[1].split("Project")[0]


def test_frames_are_cut_before_they_meet(spark):
    blocks = spark.createDataFrame([(1, i, "b", "paragraph", f"{i} " + "word " * 900) for i in range(6)], "document_id int, pos int, block_id string, kind string, text string")
    picked = spark.createDataFrame([(1, "s", 2, 3)], "document_id int, selection_id string, start_pos int, end_pos int")
    out = windows.explain_context(blocks, picked)
    r = out.first()
    assert 1100 < len(r.before) <= 1200 and r.before.endswith("word") and r.after.startswith("4 word") and len(r.after) <= 400
    assert "part#" in out._jdf.queryExecution().optimizedPlan().toString()


def test_long_needles_do_not_multiply(spark):
    text = "".join(f"word{i} " for i in range(20_000))
    texts = spark.createDataFrame([(1, 0, "x" + text + "y"), (1, 1, "nothing here"), (1, 2, "ab")], "document_id int, text_id int, text string")
    needles = spark.createDataFrame([(1, "long", text), (1, "gone", text + "z"), (1, "short", "b"), (1, "mid", "hing he"), (1, "empty", "")], "document_id int, needle_id string, needle string")
    found = joins.holders(needles, texts)
    assert sorted(tuple(r)[1:] for r in found.collect()) == [("long", 0), ("mid", 1), ("short", 2)]
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_listened_state_is_written_once_a_document():
    import pandas as pd

    from listenlake.streaming.playback import _Ranges

    class State:
        puts, rows = 0, []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.puts, self.rows = self.puts + 1, rows

    held = _Ranges(0.2, None)
    held.ranges = State()
    events = pd.DataFrame({"segment_id": ["a", "b", "a"], "start_s": [0.0, 5.0, 3.0], "end_s": [1.0, 4.0, 1.1]})
    (out,) = held.handleInputRows((1,), iter([events]), None)
    assert out["segment_id"].tolist() == ["a", "b"] and out["ranges"].tolist() == [[{"start_s": 0.0, "end_s": 3.0}], [{"start_s": 4.0, "end_s": 5.0}]]
    (out,) = held.handleInputRows((1,), iter([events[1:2]]), None)
    assert out["segment_id"].tolist() == ["b"] and held.ranges.puts == 2 and len(held.ranges.rows) == 2


def test_bundled_texts_come_back_whole(spark, tmp_path):
    texts = ["One\ntwo\r\n\tthree", "", None, "\ufeffmarked", "\x1e\x1b1\x1b\x1b0\x1e", "\t", *("plain" for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    library.write_bundles(docs.coalesce(2), f"{tmp_path}/b")
    assert len(list((tmp_path / "b").glob("part-*.txt"))) <= 2  # files do not grow with the number of texts
    got = library.read_text_corpus(spark, f"{tmp_path}/b", bundled=True)
    want = [None if t is None else t.removeprefix("\ufeff") for t in texts]
    assert sorted((int(r.id), r.mime, r.text) for r in got.collect()) == [(i, "text/plain", t) for i, t in enumerate(want)]


def test_durations_are_those_of_sql_to_the_last_bit(spark):
    texts = [(w, a, b) for w in (1, 7, 14) for a in range(8) for b in range(8)]
    rows = spark.createDataFrame([(i, "word " * w + "," * a + "!" * b) for i, (w, a, b) in enumerate(texts)], "seg_idx int, text string")
    got = {r.seg_idx: r.est_duration for r in generators.estimate_duration(rows).collect()}
    assert got == {i: max(0.7, w / 2.65 + a * 12 / 100 + b * 24 / 100) for i, (w, a, b) in enumerate(texts)}


def test_words_are_timed_within_their_row(spark):
    text = "One two, three. " * 700
    rows = spark.createDataFrame([(1, 0, 9.0, "A b, c."), (1, 1, 5600.0, text), (1, 2, 1.0, "...")], "document_id int, seg_idx int, est_duration double, text string")
    out = windows.estimate_word_timing(rows)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.seg_idx, r.word_idx, round(r.start_s, 6), round(r.end_s, 6)) for r in out.collect())
    assert got[:3] == [(0, 0, 0.0, 1.35), (0, 1, 1.35, 2.7), (0, 2, 4.05, 5.4)] and len(got) == 3 + 2100
    past, took = [0.0], [w for _ in range(700) for w in ((1.86, 0.0), (1.86, 1.5), (3.1, 4.0))]
    for speech, pause in took:
        past.append(past[-1] + speech + pause)
    scale = 5600.0 / past[-1]
    assert all(abs(g[2] - p * scale) < 1e-5 and abs(g[3] - (p + t[0]) * scale) < 1e-5 for g, p, t in zip(got[3:], past, took))


def test_characters_are_timed_within_their_row(spark):
    kind = "document_id int, seg_idx int, words array<struct<word_idx int, start int, end int>>, starts array<double>, ends array<double>"
    rows = spark.createDataFrame([(1, 0, [(0, 0, 3), (1, 4, 6), (2, 6, 6), (3, 7, 8), (4, 6, 40)], [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, 8.0], [None, 1.5, None, 3.5, 4.5, 5.5, 6.5, None, 8.5])], kind)
    out = windows.word_timing_in_passages(rows)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    words = rows.selectExpr("document_id", "seg_idx", "inline(words)")
    chars = rows.selectExpr("document_id", "seg_idx", "posexplode(arrays_zip(starts, ends)) as (char_pos, t)").selectExpr("document_id", "seg_idx", "char_pos", "t.starts as start_s", "t.ends as end_s")
    chars = chars.where("start_s is not null and end_s is not null")
    assert sorted(tuple(r) for r in out.where("word_idx <> 0").collect()) == sorted(tuple(r) for r in joins.word_timing_from_chars(words, chars).where("word_idx <> 0").collect())
    assert [tuple(r)[3:] for r in out.where("word_idx = 0").collect()] == [(1.0, 1.5)]


def test_sessions_need_no_python(spark, tmp_path):
    kind = "document_id long, block_id string, event_ts timestamp"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/in")
    plan = playback.stream_sessions(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "session_window" in plan


def test_rules_are_sought_only_where_they_can_match():
    class Sought:
        def finditer(self, text):
            assert "§" in text
            return iter(())

    rules = [(Sought(), generators.Rule("section", "§", lambda m: "Section", ("§",)))]
    assert generators.speak("A  plain text.", rules) == {"spoken": "A plain text.", "spans": generators._words("A  plain text.")}
    assert generators.speak("In § 4", rules)["spoken"] == "In § 4"
    assert all(rule.needs != ("",) for rules in generators.MODES.values() for rule in rules)


def test_passages_move_within_their_row(spark):
    kind = "document_id int, pointers array<struct<pointer_id int, segment_id string, excerpt string>>, old array<struct<segment_id string, text string>>, new array<struct<segment_id string, text string>>"
    pointers = [(0, "a", "One."), (1, "b", "Two."), (2, "c", "Three  and"), (3, "d", None), (4, "e", "gone"), (5, "f", "TWO")]
    old, new = [("a", "One."), ("b", "Two."), ("c", "Three and"), ("d", None)], [("a", "One."), ("c", "Two."), ("x", "Now three\t and four."), ("d", "new"), ("y", "Two.")]
    out = joins.migrate_in_documents(spark.createDataFrame([(1, pointers, old, new), (2, pointers[:1], [], []), (3, None, None, None), (4, pointers[:1], None, None)], kind))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(1, 0, "a"), (1, 1, "c"), (1, 2, "x"), (1, 3, "d"), (1, 4, None), (1, 5, "c"), (2, 0, None)]
    assert sorted(tuple(r) for r in out.collect()) == [*want, (4, 0, None)]
    # the same from tables, where a document without new passages has rows too
    tables = [
        spark.createDataFrame([(d, *p) for d, of in ((1, pointers), (2, pointers[:1])) for p in of], "document_id int, pointer_id int, segment_id string, excerpt string"),
        spark.createDataFrame([(1, *o) for o in old], "document_id int, segment_id string, text string"),
        spark.createDataFrame([(1, i, *n) for i, n in enumerate(new)], "document_id int, seg_idx int, segment_id string, text string"),
    ]
    assert sorted(tuple(r) for r in joins.migrate_segment(*tables).collect()) == want


def test_much_that_is_sought_is_indexed(monkeypatch):
    texts = [f"Passage {i} of many, {'é\U0001f600' * (i % 3)} and {i * i} more." for i in range(300)] + ["", "x" * 5000]
    sought = [t[i % 7 : 9 + i % 40] for i, t in enumerate(texts[:300])] + ["x" * 4000, "more.", "e", "", "no such", "ssage 1 of"]
    plain = needles.holding(texts, sought)
    monkeypatch.setattr(needles, "READ_THROUGH", 0)
    monkeypatch.setattr(needles, "AT_ONCE", 1000)
    assert needles.holding(texts, sought) == plain == [[i for i, t in enumerate(texts) if n and n in t] for n in sought]
    assert len(plain[301]) == 300 and plain[303:305] == [[], []]


def test_queries_of_moved_texts_shuffle_nothing(spark):
    from listenlake.plans import queries_structure  # noqa: F401
    from listenlake.plans.registry import QUERIES

    for name in ("migrate_segment", "rescue_annotations"):
        assert "Exchange" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_notes_are_rescued_within_their_row(spark):
    anchors = "annotation_id string, start_pos int, start_offset int, end_pos int, end_offset int"
    notes = [("a", 0, 0, 0, 5), ("b", 0, 4, 1, 3), ("c", 1, 0, 1, 99), ("d", 1, 2, 1, 2), ("e", 2, 0, 2, 6), ("f", 2, None, 2, 6), ("g", 1, 0, 9, 1)]
    rows = spark.createDataFrame([(1, notes, [(0, "Alpha beta"), (1, "Gamma"), (2, "Delta\u00a0 x")]), (2, [], []), (3, None, None)], f"document_id int, notes array<struct<{anchors.replace(' ', ': ').replace(',: ', ', ')}>>, blocks array<struct<pos: int, text: string>>")
    stored = joins.excerpts_in_documents(rows)
    assert [(n.annotation_id, n.excerpt) for n in stored.where("document_id = 1").first().notes] == [("a", "Alpha"), ("b", "a beta Gam"), ("e", "Delta")]
    later = stored.withColumn("blocks", F.expr("transform(filter(blocks, b -> b.pos <> 0), b -> named_struct('pos', b.pos, 'text', if(b.pos = 1, 'An Alpha', b.text)))"))
    out = joins.rescue_in_documents(later)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "moved", 1, 3, 1, 8), (1, "b", "orphaned", 0, 4, 1, 3), (1, "e", "kept", 2, 0, 2, 6)]


def test_texts_travel_once_to_their_frames(spark):
    blocks = spark.createDataFrame([(1, 0, "One two."), (1, 2, "w" * 5000 + " end"), (1, 3, " "), (1, 5, "Last line here."), (2, 0, "")], "document_id int, pos int, text string")
    picked = spark.createDataFrame([(1, "s", 1, 1), (1, "t", 2, 4), (1, "u", 9, 9), (1, "v", -1, 9), (2, "w", 0, 1)], "document_id int, selection_id string, start_pos int, end_pos int")
    out = windows.explain_context(blocks, picked, before=12, after=9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r.selection_id: (r.before, r.after) for r in out.collect()}
    assert got == {"s": ("One two.", "w" * 9), "t": ("end", "Last"), "u": ("line here.", ""), "v": ("", "")}
