"""Operators across documents against brute force, the classifiers on held-out texts, and the pipeline stage by stage."""

import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listenlake.llm import graph, line_dedup, minhash_join, quality_neighbours, toxicity, vp_search

from .conftest import prose

LOWER = {i: i + 32 for i in range(65, 91)}


def least(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_rounds_of_components_write_few_files(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 90)], "a long, b long")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    folder = pathlib.Path(graph.shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in graph.components(links).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {n: 0 if n <= 60 else 100 for n in (*range(61), *range(100, 190))}
    assert 40 <= len(set(folder.rglob("part-*")) - before) < 80
    assert [graph.gathered(spark.range(10, numPartitions=9), n).rdd.getNumPartitions() for n in (0, 1, graph.ROWS_A_TASK, graph.ROWS_A_TASK + 1, 1 << 40)] == [1, 1, 1, 2, 9]


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def similar(x, y, percent):
    shared = len(x & y)
    return bool(x) and bool(y) and 100 * shared >= percent * (len(x) + len(y) - shared)


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(90)] + [(1, 1), (7, None), (None, None)]
    df = spark.createDataFrame(links, "a long, b long")
    full = [x for x in links if None not in x]
    want = least(full, {n for x in full for n in x})
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("width", "percent", "long"), [(3, 85, 16), (5, 80, 2)])
def test_near_duplicates_equal_brute_force(docs, texts, none, monkeypatch, width, percent, long):
    monkeypatch.setattr(minhash_join, "LONG_LIST", long)
    monkeypatch.setattr(minhash_join, "BLOCK", 5)
    sets = {i: shingle_set(t, width) for i, t in texts if i is not None}
    ids = sorted(sets)
    want = least([(a, b) for a in ids for b in ids if a < b and similar(sets[a], sets[b], percent)], ids)
    got = minhash_join.near_duplicates(docs, width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((i, len(sets[i]), want[i], want[i] == i) for i, _ in texts if i is not None)
    assert len(got) == len(texts) and all(r.kept for r in got if r.doc_id is None)
    assert minhash_join.near_duplicates(none).count() == 0


def test_matches_follow_the_similarity():
    draws = np.random.default_rng(2)
    for percent, want in ((85, 42), (80, 38)):
        assert minhash_join.matches(percent) == want
        assert (draws.binomial(64, percent / 100, 400_000) < want).mean() < 1e-4
    assert minhash_join.matches(100) == 64 and minhash_join.matches(10) == 1


def solid(line):
    return line.strip(" \t\n\x0b\x0c\r") != ""


@pytest.mark.parametrize("pairwise", [8, 1])
def test_line_dedup_equals_brute_force(spark, docs, texts, none, monkeypatch, pairwise):
    monkeypatch.setattr(line_dedup, "PAIRWISE", pairwise)
    rows = [(i, t) for i, t in texts if i is not None]
    lines = [(i, p, line) for i, t in rows for p, line in enumerate((t or "").split("\n")) if t is not None and solid(line)]
    every = sorted({line for *_, line in lines})
    sets = {x: {x[i : i + line_dedup.WIDTH] for i in range(max(1, len(x) - line_dedup.WIDTH + 1))} for x in every}
    group = least([(a, b) for a in every for b in every if a < b and similar(sets[a], sets[b], 80)], every)
    first = {}
    for i, p, line in lines:
        first[group[line]] = min(first.get(group[line], (i, p)), (i, p))
    got = line_dedup.without_repeats(docs, 80).collect()
    want = [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not solid(x) or first[group[x]] == (i, p))) for i, t in rows]
    key = lambda x: (x[0], x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got if r.doc_id is not None], key=key) == sorted(want, key=key)
    assert sorted((r.text or "") for r in got if r.doc_id is None) == sorted((t or "") for i, t in texts if i is None)
    assert set(got[0].asDict()) == {*docs.columns, "n_lines", "n_removed"} and line_dedup.without_repeats(none).count() == 0


def test_lines_of_50_to_90_characters_are_linked_after_one_edit(spark):
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n - 2)).join("<>") for n in range(50, 91) for _ in range(3)]
    rows = []
    for i, x in enumerate(base):
        at = rng.randrange(10, len(x) - 10)
        rows += [(2 * i, x), (2 * i + 1, x[:at] + "#" + x[at + 1 :])]
    sets = {i: {x[k : k + 5] for k in range(len(x) - 4)} for i, x in rows}
    want = {i for i in sets if i % 2 and similar(sets[i], sets[i - 1], 80)}
    got = {r.doc_id for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 80).where("n_removed = 1").collect()}
    assert len(want) >= 0.95 * len(base) and got <= want and len(got) >= 0.97 * len(want)


def test_shingle_sets_of_lines(spark):
    lines = ["", "a", "abcde", "abcdef", "aaaaaaaaaa", "é́ ﬁ 漢字 \U0001f600 zz \U0001f600\U0001f600", "x\r\ty" * 9]
    got = spark.createDataFrame(list(enumerate(lines)), "i long, line string").select("i", F.size(line_dedup._shingle_set("line")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len({x[k : k + 5] for k in range(max(1, len(x) - 4))}) for i, x in enumerate(lines)}


def test_pairs_of_lines_are_counted_without_making_single_sets(spark):
    lines = ["", "a", "abcde", "abcdef", "aaaaaaaaaa", "xabcdefx" * 5, "xabcdefy" * 5, "é́ ﬁ 漢字 \U0001f600 zz"]
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    texts = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "id long, check int, line string")
    pairs = [(a, b) for a in range(len(lines)) for b in range(len(lines))]
    got = line_dedup._compared(spark.createDataFrame(pairs, "a long, b long"), texts)
    assert {(r.a, r.b): (r.shared, r.total) for r in got.collect()} == {(a, b): (len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])) for a, b in pairs}
    assert "array_distinct" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows, block", [(vp_search.SHARD_ROWS, vp_search.BLOCK_QUERIES), (150, 3)])
def test_vp_search_is_exact(spark, monkeypatch, rows, block):
    monkeypatch.setattr(vp_search, "SHARD_ROWS", rows)
    monkeypatch.setattr(vp_search, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 8)).round(1)
    base[100:160] = base[5]
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4), (1004, [float("inf")] * 8), (None, [1.0] * 8), (1005, [1.0] * 3), (1006, [2.0] * 3), (1007, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = vp_search.search(df, df.where("vec_id % 100 = 0 or vec_id > 1000"), k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {*range(0, 700, 100), 1005, 1006} and [x[1] for x in by[1005]] == [1006]
    for q in range(0, 700, 100):
        d = np.zeros(700)
        for j in range(8):
            d += (base[:, j] - base[q, j]) ** 2
        d = np.sqrt(d)
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        assert by[q] == [(n + 1, i, d[i]) for n, i in enumerate(order)]
    assert vp_search.search(df.limit(0), df).count() == 0
    loose = vp_search.search(df.where("vec_id < 700"), df.where("vec_id % 100 = 0"), k=10, factor=2.0).collect()
    hit = sum((r.query_id, r.vec_id) in {(x.query_id, x.vec_id) for x in got} for r in loose)
    assert hit >= 0.9 * len(loose)


def test_toxicity_learns_unseen_forms(spark, none):
    rng = random.Random(6)
    stems, ends = ["grumf", "zorkel"], ["a", "en", "ischer", "ung", "os"]

    def text(toxic):
        words = prose(rng, 40).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(40), rng.choice([rng.choice(stems) + rng.choice(ends), "idiot"]))
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(700, None, "x"), (701, "", "x"), (702, "zorkelhaft and grumfiest it was", "x"), (None, "idiot", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows if i >= 400) >= 196
    assert got[702].predicted == 1 and got[700].predicted == 0 and got[700].score == got[701].score
    assert all(0 <= r.score <= 1 for r in got.values())
    plain = toxicity.fit(none, labels)
    assert toxicity.score_documents(none, plain).count() == 0 and toxicity.score_documents(docs, plain).count() == len(rows) + 4


def test_toxicity_keeps_texts_that_share_a_passage(spark):
    rng = random.Random(15)
    shared = "garden window paper silver"
    texts = [f"{shared} {prose(rng, 3)} {'grumfling' if i % 2 else 'plain'} {i}" for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(202)), "text": [*texts, texts[0], texts[1].upper()], "toxic": [0] * 202})
    marks = [tuple(r[c] for c in r if c not in ("doc_id", "text", "toxic")) for out in toxicity._fingerprints(iter([batch])) for r in out.to_pylist()]
    assert len(set(marks)) == 200 and marks[200] == marks[0] and marks[201] == marks[1]


def test_quality_votes(spark, none):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40) if i % 3 else " ".join(w + "%%%" for w in prose(rng, 40).split()), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (901, "", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 250] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_neighbours.score_documents(docs, quality_neighbours.fit(docs, labels)).collect()
    by = {r.doc_id: r for r in got}
    assert sum(by[i].predicted == y for i, _, y in rows if i >= 250) >= 148 and len(got) == 403
    assert by[900].score == by[901].score and all(0 <= r.score <= 1 for r in got)
    empty = quality_neighbours.fit(docs, labels.limit(0))
    assert {r.score for r in quality_neighbours.score_documents(docs, empty).collect()} == {0.5}
    assert quality_neighbours.score_documents(none, empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    clean = [prose(rng, 60) + ".\n" + prose(rng, 60) for _ in range(40)]
    leak = prose(rng, 14)
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, clean[3]), (101, clean[4].replace("the", "a", 2)), (102, prose(rng, 20) + " " + leak), (103, prose(rng, 50) + " idiot moron scum trash " + prose(rng, 9)), (104, None), (105, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(103, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert 103 not in seen[0] and len(seen[0]) == len(rows) - 1
    assert not {100, 101} & seen[1] and 102 in seen[2] and 102 not in seen[3]
    assert seen[-1] == set(range(40)) | {104, 105}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[-1]
