"""Tables that are written and merged, and streams that must agree with their batch forms."""

import datetime as dt
import json
import random
import time

from pyspark.sql import functions as F

from listenlake.operators import windows
from listenlake.sources import library
from listenlake.streaming import playback

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def events(spark):
    data = [(1, "s1", 0.0, 3.0, at(1)), (1, "s1", 2.9, 5.0, at(9)), (1, "s2", 1.0, 1.0, at(4)), (2, "s1", 7.0, 4.0, at(2)), (1, "s1", 9.0, 9.5, at(3)), (2, "s3", 1.0, 2.0, at(2))]
    return spark.createDataFrame(data, library.LISTEN_EVENTS)


def test_streams_agree_with_batches(spark, tmp_path):
    batch = events(spark)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = library.read_listen_stream(spark, f"{tmp_path}/in", files_at_once=1)
    rows = drain(playback.stream_listened(stream), "listened", "update").collect()
    last = {}
    for r in rows:
        last[r.document_id, r.segment_id] = max(last.get((r.document_id, r.segment_id), []), [tuple(x) for x in r.ranges], key=lambda v: sum(b - a for a, b in v))
    want = {}
    for r in windows.merge_ranges(batch).orderBy("start_s").collect():
        want.setdefault((r.document_id, r.segment_id), []).append((r.start_s, r.end_s))
    assert last == want

    playback.stream_latest_position(stream, f"{tmp_path}/latest", f"{tmp_path}/cp").awaitTermination(120)
    got = sorted(tuple(r) for r in library.read_latest(spark, f"{tmp_path}/latest").select("document_id", "segment_id", "updated_at").collect())
    assert got == sorted(tuple(r) for r in playback.latest_position(batch).collect())


def test_activity_drops_nothing_in_time(spark, tmp_path):
    events(spark).write.parquet(f"{tmp_path}/in")
    stream = library.read_listen_stream(spark, f"{tmp_path}/in")
    out = drain(playback.stream_activity(stream, "5 minutes"), "activity", "complete")
    batch = events(spark).groupBy("document_id", F.window("event_ts", "5 minutes")).agg(F.sum(F.abs(F.col("end_s") - F.col("start_s"))).alias("h"))
    assert sorted((r.document_id, r.window_start, round(r.heard_s, 6)) for r in out.collect()) == sorted((r.document_id, r.window.start, round(r.h, 6)) for r in batch.collect())


def test_sessions_close_by_their_own_timers(spark, tmp_path):
    kind = "document_id long, block_id string, event_ts timestamp"
    rng = random.Random(3)
    rounds = [[(d, f"b{rng.randint(0, 6)}", at(200 * k + rng.randint(-100, 300))) for d in range(4) for _ in range(rng.randint(0, 9))] for k in range(5)]
    rounds[2] += [(1, "b1", at(401)), (1, "b9", at(401))]
    seen, open_keys = [], []
    for k, data in enumerate([*rounds, [(None, None, dt.datetime(2200, 1, 1))]]):
        spark.createDataFrame(data, kind).write.mode("append").parquet(f"{tmp_path}/t")
        query = playback.stream_sessions(spark.readStream.schema(kind).parquet(f"{tmp_path}/t"), late="400 minutes").writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda batch, n: seen.extend(batch.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert playback.dropped_late(query) == 0
        open_keys.append(len(seen))
    touches = spark.createDataFrame([r for data in rounds for r in data], kind)
    want = sorted((r.document_id, r.session_start, r.session_end, tuple(r.blocks), r.last_block) for r in playback.sessions(touches).collect())
    assert sorted((r.document_id, r.session_start, r.session_end, tuple(r.blocks), r.last_block) for r in seen) == want
    assert 0 < open_keys[-2] < len(want)  # some closed before the end, the rest by the end


def test_imports_are_held_against_all_earlier_ones(spark, tmp_path):
    kind = "document_id long, fingerprint string, event_ts timestamp"
    rounds = [[(1, "a", at(50_000)), (2, "a", at(40_000)), (3, "b", at(60_000))], [(4, "a", at(1)), (5, "c", at(0)), (6, "c", at(0))], [(7, "c", at(90_000)), (8, "d", at(2))]]
    for data in rounds:
        spark.createDataFrame(data, kind).write.mode("append").parquet(f"{tmp_path}/d")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/d")
        playback.keep_imports(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    kept = lambda: sorted((r.document_id, r.fingerprint) for r in spark.read.parquet(f"{tmp_path}/out/new").collect())
    assert kept() == [(2, "a"), (3, "b"), (5, "c"), (8, "d")]
    commits = sorted((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "cp/commits").glob(".*.crc"):
        crc.unlink()
    playback.keep_imports(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert kept() == [(2, "a"), (3, "b"), (5, "c"), (8, "d")]
    # the stream's own state alone drops what comes after its watermark, new or not, and says so
    query = playback.stream_import_dedup(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/d"), "1 day").writeStream.format("memory").queryName("imports").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert playback.dropped_late(query) > 0


def test_listened_ranges_outlive_state_and_stream(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.randint(1, 3), f"s{rng.randint(0, 2)}", float(rng.randint(0, 60)), float(rng.randint(0, 60)), at(i)) for i in range(90)]
    batch = spark.createDataFrame(data, library.LISTEN_EVENTS)
    want = {}
    for r in windows.merge_ranges(batch).orderBy("start_s").collect():
        want.setdefault((r.document_id, r.segment_id), []).append((r.start_s, r.end_s))
    stored = lambda: {(r.document_id, r.segment_id): [tuple(x) for x in r.ranges] for r in library.read_latest(spark, f"{tmp_path}/t").collect()}
    sizes = []
    for k, log in enumerate(("cp1", "cp2")):  # the second stream begins with what the first has stored
        spark.createDataFrame(data[k * 45 : k * 45 + 45], library.LISTEN_EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(library.LISTEN_EVENTS).parquet(f"{tmp_path}/in")
        query = playback.keep_listened(stream, f"{tmp_path}/t", f"{tmp_path}/{log}")
        query.awaitTermination(120)
    assert stored() == want
    # with a short life the state forgets, and the table still loses nothing
    for k in range(2):
        spark.createDataFrame([(10 + k, "s0", 0.0, 1.0, at(k)), (1, "s0", 70.0 + k, 71.0 + k, at(k))], library.LISTEN_EVENTS).write.mode("append").parquet(f"{tmp_path}/short")
        stream = spark.readStream.schema(library.LISTEN_EVENTS).parquet(f"{tmp_path}/short")
        query = playback.keep_listened(stream, f"{tmp_path}/t2", f"{tmp_path}/cp3", ttl_ms=1)
        query.awaitTermination(120)
        sizes.append(max(op["numRowsTotal"] for p in query.recentProgress for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"]))
        time.sleep(0.1)
    short = {(r.document_id, r.segment_id): [tuple(x) for x in r.ranges] for r in library.read_latest(spark, f"{tmp_path}/t2").collect()}
    assert short == {(1, "s0"): [(70.0, 72.0)], (10, "s0"): [(0.0, 1.0)], (11, "s0"): [(0.0, 1.0)]}
    assert sizes[-1] <= 2  # three passages were heard; the state holds those of the last round


def test_upsert_and_corpus(spark, tmp_path):
    def table(*data):
        return spark.createDataFrame(data, "document_id long, segment_id string, updated_at timestamp")

    path = f"{tmp_path}/latest"
    library.upsert_latest(table((1, "a", at(5)), (2, "x", at(1))), path)
    library.upsert_latest(table((1, "b", at(4)), (2, "y", at(1)), (3, "z", at(0))), path)
    assert sorted((r.document_id, r.segment_id) for r in library.read_latest(spark, path).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    (tmp_path / "files/sub").mkdir(parents=True)
    (tmp_path / "files/a b+c.txt").write_text("﻿One\ntwo", encoding="utf-8")
    (tmp_path / "files/sub/Read me.MD").write_text("# Title", encoding="utf-8")
    corpus = library.read_text_corpus(spark, f"{tmp_path}/files")
    assert sorted((r.source_name, r.mime, r.text) for r in corpus.collect()) == [("Read me.MD", "text/markdown", "# Title"), ("a b+c.txt", "text/plain", "One\ntwo")]
    (tmp_path / "files/page.pdf").write_bytes(b"%PDF\xff\xfe")
    (tmp_path / "files/noending").write_bytes("é text".encode())
    (tmp_path / "files/raw.bin").write_bytes(b"\x00\x01\x02\xff")
    files = {r.source_name: (r.mime, r.n_bytes, r.text) for r in library.read_binary_corpus(spark, f"{tmp_path}/files").collect()}
    assert files == {"a b+c.txt": ("text/plain", 10, "One\ntwo"), "Read me.MD": ("text/markdown", 7, "# Title"), "page.pdf": ("application/pdf", 6, None), "noending": ("application/octet-stream", 7, "é text"), "raw.bin": ("application/octet-stream", 4, None)}
    docs = spark.createDataFrame([(1, "text"), (2, "web")], "document_id long, source_kind string")
    library.write_corpus(docs, f"{tmp_path}/c", "source_kind")
    library.write_corpus(spark.createDataFrame([(3, "web")], docs.schema), f"{tmp_path}/c", "source_kind")
    assert sorted(r.document_id for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [1, 3]


def test_upserts_touch_only_their_buckets_and_count_once(spark, tmp_path):
    def table(*data):
        return spark.createDataFrame(data, "document_id long, segment_id string, updated_at timestamp")

    def files():
        return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("part-*.parquet")}

    def rows():
        return sorted((r.document_id, r.segment_id, r.updated_at) for r in library.read_latest(spark, str(path)).collect())

    path = tmp_path / "t"
    merge = lambda data, n, **more: library.upsert_latest(table(*data), str(path), batch_id=n, **more)
    first = [(i, "a", at(i)) for i in range(40)]
    assert merge(first, 0, buckets=8)
    before = files()
    assert len({name.split("/")[2] for name in before}) == 8
    second = [(3, "b", at(99)), (4, "b", at(1)), (3, "c", at(98)), (70, "n", at(0))]
    assert merge(second, 1)
    touched = {r[0] for r in table(*second).select(F.pmod(F.xxhash64("document_id"), F.lit(8)).cast("int")).collect()}
    now = files()
    new = {name for name in now if name.startswith("data/1/")}
    assert {int(name.split("/")[2].split("=")[1]) for name in new} == touched and len(touched) < 8
    assert all(now[name] == data for name, data in before.items())  # the first batch is still held for readers
    want = sorted([r for r in first if r[0] != 3] + [(3, "b", at(99)), (70, "n", at(0))])
    assert rows() == want
    assert not merge(second, 1) and not merge([(5, "old", at(5000))], 0)  # handed over again: nothing happens
    assert rows() == want and files() == now
    assert merge([(3, "d", at(99))], 2) and merge([], 3)  # at equal times the arriving row; an empty batch counts too
    assert (3, "d", at(99)) in rows() and library.current_version(spark, str(path)) == 3
    kept = files()  # two versions are held: buckets that neither names are gone
    gone = {name for name in before if int(name.split("/")[2].split("=")[1]) in touched}
    assert not gone & set(kept) and all(kept[name] == before[name] for name in set(before) - gone)
    # a batch that failed before its manifest is written anew
    (path / "data/4").mkdir()
    (path / "data/4/part-half.parquet").write_bytes(b"half")
    assert merge([(6, "e", at(500))], 4) and (6, "e", at(500)) in rows()


def test_replayed_stream_batches_change_nothing(spark, tmp_path):
    for n in range(3):
        events(spark).where(F.col("segment_id") == f"s{n + 1}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = library.read_listen_stream(spark, f"{tmp_path}/in", files_at_once=1)
    playback.stream_latest_position(stream, f"{tmp_path}/latest", f"{tmp_path}/cp").awaitTermination(120)
    was = library.current_version(spark, f"{tmp_path}/latest")
    # the last batch's commit is lost: the stream hands it over again
    commits = sorted((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "cp/commits").glob(".*.crc"):
        crc.unlink()
    playback.stream_latest_position(stream, f"{tmp_path}/latest", f"{tmp_path}/cp").awaitTermination(120)
    assert library.current_version(spark, f"{tmp_path}/latest") == was
    got = sorted(tuple(r) for r in library.read_latest(spark, f"{tmp_path}/latest").select("document_id", "segment_id", "updated_at").collect())
    assert got == sorted(tuple(r) for r in playback.latest_position(events(spark)).collect())
