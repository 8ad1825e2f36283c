"""The data model's tables derived from the driver's tables, as DataFrames and as DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.functions.text import SENTENCE
from listenlake.operators.windows import held


class Views:
    """The tables below one folder; each property builds a plan and runs nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents").withColumnRenamed("doc_id", "document_id")

    @property
    def _lines(self) -> Column:
        return F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")

    @property
    def documents_in_lines(self) -> DataFrame:
        """``document_id, lines``: the texts of a document's blocks, in one row."""
        return held(self.documents.select("document_id", "text"), lines=self._lines).select("document_id", "lines")

    @property
    def blocks(self) -> DataFrame:
        """Lines of documents: every sixth a heading, the one before it a list item, eight lines a page.  No shuffle is needed."""
        rows = self.documents.select("document_id", F.posexplode(self._lines).alias("pos", "text"))
        pos = F.col("pos")
        kind = F.when(pos % 6 == 0, "heading").when(pos % 6 == 5, "list-item").otherwise("paragraph")
        level = F.when(pos % 6 == 0, 1 + F.length("text") % 4)
        return rows.select("document_id", "pos", F.concat(F.lit("b"), pos.cast("string")).alias("block_id"), kind.alias("kind"), level.alias("level"), "text", (F.floor(pos / 8).cast("int") + 1).alias("page"))

    @property
    def _passages(self) -> Column:
        pieces = F.flatten(F.transform(self._lines, lambda x, i: F.transform(F.when((i % 6 != 0) & (i % 6 != 5), F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(0))).otherwise(F.array(x)), lambda y, p: F.struct(i.alias("block_pos"), p.alias("p"), F.trim(y).alias("text")))))
        return F.filter(pieces, lambda s: s["text"] != "")

    @property
    def documents_in_passages(self) -> DataFrame:
        """``document_id, passages``: the segments of a document, in one row, as structs of ``segment_id, text``."""
        name = lambda s: F.concat(F.lit("b"), s["block_pos"].cast("string"), F.lit(":s"), s["p"].cast("string"))
        passages = F.transform(self._passages, lambda s: F.struct(name(s).alias("segment_id"), s["text"].alias("text")))
        return held(self.documents.select("document_id", "text"), passages=passages).select("document_id", "passages")

    @property
    def segments(self) -> DataFrame:
        """Sentences of the blocks, cut within each document's row, so again without a shuffle."""
        rows = self.documents.select("document_id", F.posexplode(self._passages).alias("seg_idx", "s"))
        return rows.select("document_id", "seg_idx", F.concat(F.lit("b"), F.col("s.block_pos").cast("string"), F.lit(":s"), F.col("s.p").cast("string")).alias("segment_id"), F.col("s.block_pos").alias("block_pos"), F.col("s.text").alias("text"))

    @property
    def outline(self) -> DataFrame:
        heads = self.blocks.where("kind = 'heading'")
        return heads.select("document_id", F.floor(F.col("pos") / 6).cast("int").alias("entry_idx"), "block_id", "pos", F.col("text").alias("title"), "level", "page")

    @property
    def library(self) -> DataFrame:
        title = F.concat("source", F.lit(" "), F.substring("text", 1, 24))
        at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("document_id") % 200) * 3600)
        return self.documents.select("document_id", title.alias("title"), F.when(F.col("document_id") % 3 == 0, "markdown").otherwise("text").alias("source_kind"), F.col("lang").alias("language"), F.sha2("text", 256).alias("fingerprint"), at.alias("updated_at"))

    @property
    def listen_events(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("document_id"), F.concat(F.lit("s"), (F.col("event_id") % 20).cast("string")).alias("segment_id"), F.col("value").alias("start_s"), (F.col("value") + (F.col("event_id") % 50) / 10.0).alias("end_s"), F.col("ts").alias("event_ts"))

    @property
    def playback(self) -> DataFrame:
        return self.listen_events.groupBy("document_id").agg(F.max_by("segment_id", F.struct("event_ts", "segment_id")).alias("segment_id"), F.max("event_ts").alias("updated_at"))

    @property
    def touches(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("document_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.concat(F.lit("b"), (F.length("text") % 12).cast("string")).alias("block_id"))

    @property
    def audio_variants(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("segment_id"), (F.col("l_suppkey") % 5).alias("voice_id"), F.col("l_returnflag").alias("backend"), F.col("l_quantity").alias("duration"), F.col("l_shipdate").alias("created_at"))

    @property
    def annotations(self) -> DataFrame:
        """Anchors over blocks, 0 to 2 blocks long; some invalid on purpose."""
        rows = self.blocks.select("document_id", "pos", F.length("text").alias("n"))
        a = rows.where("pos % 4 = 1").select("document_id", F.concat(F.lit("a"), F.col("pos").cast("string")).alias("annotation_id"), F.col("pos").alias("start_pos"), (F.col("n") % 7).alias("start_offset"), (F.col("pos") + F.col("pos") % 3).alias("end_pos"))
        ends = rows.select("document_id", F.col("pos").alias("end_pos"), (F.col("n") - F.col("n") % 5).alias("end_offset"))
        return a.join(ends, ["document_id", "end_pos"]).select("document_id", "annotation_id", "start_pos", "start_offset", "end_pos", "end_offset")

    @property
    def study_nodes(self) -> DataFrame:
        """Stored notes for the outline: some ids shifted, some failed, some without a summary."""
        pos = F.col("pos")
        node = F.when(pos % 4 == 0, F.concat(F.lit("study:b"), (pos + 6).cast("string"))).otherwise(F.concat(F.lit("study:"), "block_id"))
        return self.outline.select("document_id", node.alias("node_id"), "title", "level", F.sha2("title", 256).alias("source_hash"), F.when(pos % 5 == 4, "failed").otherwise("ready").alias("status"), F.when(pos % 7 != 6, F.concat(F.lit("Note on "), "title")).alias("summary"), "pos")

    @property
    def tool_calls(self) -> DataFrame:
        name = F.col("event_type")
        tool = F.when(name == "click", "show_passage").when(name == "view", "read_passage").when(name == "purchase", "add_note").when(name == "signup", "point_at").otherwise("no_such_tool")
        return self.table("events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("document_id"), tool.alias("name"), F.get_json_object("props", "$.k").cast("int").alias("start_segment"), (F.col("event_id") % 90).alias("end_segment"))


#: The same tables in DuckDB, each over those before it.
SQL = {
    "blocks": """select document_id, pos, 'b' || pos as block_id, case when pos % 6 = 0 then 'heading' when pos % 6 = 5 then 'list-item' else 'paragraph' end as kind,
 case when pos % 6 = 0 then 1 + length(text) % 4 end as level, text, cast(floor(pos / 8) as int) + 1 as page
 from (select doc_id as document_id, cast(row_number() over (partition by doc_id order by p) as int) - 1 as pos, trim(l) as text
 from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as p from documents) where trim(l) <> '')""",
    "segments": """select document_id, cast(row_number() over (partition by document_id order by pos, p) as int) - 1 as seg_idx, block_id || ':s' || (p - 1) as segment_id, pos as block_pos, trim(x) as text
 from (select document_id, pos, block_id, unnest(a) as x, generate_subscripts(a, 1) as p from (select *, case when kind = 'paragraph' then regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)') else [text] end as a from blocks)) where trim(x) <> ''""",
    "outline": "select document_id, cast(row_number() over (partition by document_id order by pos) as int) - 1 as entry_idx, block_id, pos, text as title, level, page from blocks where kind = 'heading'",
    "library": "select doc_id as document_id, source || ' ' || substring(text, 1, 24) as title, case when doc_id % 3 = 0 then 'markdown' else 'text' end as source_kind, lang as language, sha256(text) as fingerprint, timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 200 as int)) as updated_at from documents",
    "listen_events": "select user_id as document_id, 's' || (event_id % 20) as segment_id, value as start_s, value + cast(event_id % 50 as double) / 10.0 as end_s, ts as event_ts from events",
    "playback": "select document_id, arg_max(segment_id, {'t': event_ts, 's': segment_id}) as segment_id, max(event_ts) as updated_at from listen_events group by document_id",
    "touches": "select conv_id as document_id, conv_id as session_id, turn as seq, 'b' || (length(text) % 12) as block_id from conversations",
    "audio_variants": "select l_orderkey as document_id, 's' || l_linenumber as segment_id, l_suppkey % 5 as voice_id, l_returnflag as backend, l_quantity as duration, l_shipdate as created_at from lineitem",
    "annotations": "select a.document_id, 'a' || a.pos as annotation_id, a.pos as start_pos, length(a.text) % 7 as start_offset, b.pos as end_pos, length(b.text) - length(b.text) % 5 as end_offset from blocks a join blocks b on a.document_id = b.document_id and b.pos = a.pos + a.pos % 3 where a.pos % 4 = 1",
    "study_nodes": "select document_id, case when pos % 4 = 0 then 'study:b' || (pos + 6) else 'study:' || block_id end as node_id, title, level, sha256(title) as source_hash, case when pos % 5 = 4 then 'failed' else 'ready' end as status, case when pos % 7 = 6 then null else 'Note on ' || title end as summary, pos from outline",
    "tool_calls": "select event_id as call_id, user_id as document_id, case event_type when 'click' then 'show_passage' when 'view' then 'read_passage' when 'purchase' then 'add_note' when 'signup' then 'point_at' else 'no_such_tool' end as name, cast(json_extract_string(props, '$.k') as int) as start_segment, event_id % 90 as end_segment from events",
    # passages with their duration and place
    "timed": "select *, greatest(0.7, greatest(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*')), 1) / 2.65 + (length(text) - length(regexp_replace(text, '[,;:]', '', 'g'))) * 0.12 + (length(text) - length(regexp_replace(text, '[.!?]', '', 'g'))) * 0.24) as est_duration from segments",
    "merged": """select document_id, segment_id, min(s) as start_s, max(e) as end_s from (select *, sum(new) over (partition by document_id, segment_id order by s, e rows unbounded preceding) as island
 from (select *, case when s <= max(e) over (partition by document_id, segment_id order by s, e rows between unbounded preceding and 1 preceding) + 0.2 then 0 else 1 end as new
 from (select document_id, segment_id, greatest(0, least(start_s, end_s)) as s, greatest(0, greatest(start_s, end_s)) as e from listen_events) where e > s)) group by document_id, segment_id, island""",
}

_NEEDS = {"segments": ("blocks",), "outline": ("blocks",), "playback": ("listen_events",), "annotations": ("blocks",), "study_nodes": ("outline",), "timed": ("segments",), "merged": ("listen_events",)}


def with_views(query: str, *names: str) -> str:
    """``query`` behind the definitions of the views that it uses."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{name} as materialized ({SQL[name]})" for name in order) + "\n" + query
