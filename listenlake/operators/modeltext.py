"""Tables around a language model: requests, a callable to run them, and gates over the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.text import squeeze, strip
from listenlake.operators.windows import pack_to_budget
from listenlake.sources.library import BUCKETS, current_version, read_latest, upsert_latest

#: Token and character budgets by style and kind (fixed values).  A budget of 0 needs no call.
BUDGETS = {
    "balanced": {"math-block": (56, 180), "math-inline": (24, 64), "table-row": (64, 200), "table-header": (0, 0), "mermaid": (112, 320), "code-block": (112, 320), "image": (64, 200)},
    "concise": {"math-block": (0, 0), "math-inline": (24, 64), "table-row": (48, 140), "table-header": (0, 0), "mermaid": (56, 170), "code-block": (64, 180), "image": (40, 120)},
    "educational": {"math-block": (140, 440), "math-inline": (24, 64), "table-row": (96, 280), "table-header": (0, 0), "mermaid": (168, 480), "code-block": (168, 480), "image": (96, 280)},
}
#: Symbols that are read as words (fixed values).
SYMBOLS = (
    ("[×·⋅]", " times "),
    ("±", " plus or minus "),
    ("≤", " at most "),
    ("≥", " at least "),
    ("≠", " not equal to "),
    ("≈", " approximately "),
    ("[→⇒]", " to "),
    ("∞", " infinity "),
    ("[αΑ]", " alpha "),
    ("[βΒ]", " beta "),
    ("[γΓ]", " gamma "),
    ("[δΔ]", " delta "),
    ("[εΕ]", " epsilon "),
    ("[ζΖ]", " zeta "),
    ("[ηΗ]", " eta "),
    ("[θΘ]", " theta "),
    ("[κΚ]", " kappa "),
    ("[λΛ]", " lambda "),
    ("[μΜ]", " mu "),
    ("[νΝ]", " nu "),
    ("[ξΞ]", " xi "),
    ("[πΠ]", " pi "),
    ("[ρΡ]", " rho "),
    ("[σΣς]", " sigma "),
    ("[τΤ]", " tau "),
    ("[φΦ]", " phi "),
    ("[χΧ]", " chi "),
    ("[ψΨ]", " psi "),
    ("[ωΩ]", " omega "),
)
#: What may not be left in speech (a fixed value).
FORBIDDEN = r"[\\=+^{}\[\]|<>~$&@%()/]|[∀-⋿⟨⟩]|\d+\s*[*·]\s*\d"
GREEK = r"\b(alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega|bar|hat|tilde)\b"

#: Tools that a reading assistant may call, by what they need (fixed values).
BARE_TOOLS = ("clear_highlight", "continue_tour", "get_reader_focus")
RANGE_TOOLS = ("show_passage", "read_passage", "play_section", "add_highlight", "add_note")
CONFIRMATIONS = ("add_highlight", "add_note", "save_memory", "point_at", "clear_highlight")
TOUR_STOPS = 8


def _joined(order: list[str], text: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), separator)


def budgets(spark, style: str = "balanced") -> DataFrame:
    """``kind, max_tokens, max_chars`` of a style: a few rows, safe to broadcast."""
    return spark.createDataFrame([(k, *v) for k, v in BUDGETS[style].items()], "kind string, max_tokens int, max_chars int")


def narration_requests(constructs: DataFrame, templates: DataFrame, params: DataFrame, most: int = 1500) -> DataFrame:
    """``document_id, construct_id, kind, prompt, max_tokens, max_chars, settled``: a request for each construct.

    ``{{source}}``, ``{{header}}`` and ``{{context}}`` of its kind's template are filled in; the source of diagrams and code is cut.
    With a budget of 0 there is nothing to ask and the entry is settled.  ``constructs``: ``document_id, construct_id, kind, source,
    header, context``; ``templates``: ``kind, template``; ``params``: see ``budgets``.
    """
    rows = constructs.join(F.broadcast(templates), "kind", "left").join(F.broadcast(params), "kind", "left")  # a row a kind: rows of one kind never meet in one task
    long = F.col("kind").isin("mermaid", "code-block") & (F.length("source") > most)
    tail = F.when(F.col("kind") == "mermaid", "\n%% diagram continues").otherwise("\n… snippet continues")
    source = F.when(long, F.concat(F.left("source", F.lit(most)), tail)).otherwise(F.col("source"))
    prompt = F.replace(F.replace(F.replace("template", F.lit("{{source}}"), source), F.lit("{{header}}"), F.coalesce("header", F.lit(""))), F.lit("{{context}}"), F.coalesce("context", F.lit("")))
    settled = F.coalesce(F.col("max_tokens") <= 0, F.lit(True)) | F.col("template").isNull()
    return rows.select("document_id", "construct_id", "kind", F.when(~settled, F.trim(prompt)).alias("prompt"), "max_tokens", "max_chars", settled.alias("settled"))


#: Language names for prompts (fixed values); others are named by their tag.
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "ru": "Russian", "ja": "Japanese", "zh": "Chinese"}


def language_name(tag: Column) -> Column:
    tag = F.coalesce(F.nullif(F.trim(tag), F.lit("")), F.lit("en"))
    named = F.lit(None).cast("string")
    for code, name in LANGUAGES.items():
        named = F.coalesce(named, F.when(tag == code, name))
    return F.coalesce(named, tag)


def study_requests(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """``document_id, section, prompt, language``: a request for a note on each section, in the document's language."""
    rows = sections.join(docs.select("document_id", F.col("title").alias("doc_title"), language_name(F.col("language")).alias("language")), "document_id")
    prompt = F.concat(F.lit("Document: "), "doc_title", F.lit("\nSection: "), "title", F.lit("\n\n"), "text")
    return rows.select("document_id", "section", prompt.alias("prompt"), "language")


def abstract_requests(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``document_id, prompt, language``: a request for an abstract from the notes that are ready."""
    ready = nodes.where("status = 'ready' and coalesce(summary, '') <> ''")
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), "title", F.lit(": "), "summary")
    notes = ready.groupBy("document_id").agg(_joined(["ord"], line, "\n").alias("notes"))
    rows = notes.join(docs.select("document_id", "title", language_name(F.col("language")).alias("language")), "document_id")
    return rows.select("document_id", F.concat(F.lit("Document: "), "title", F.lit("\n\nSection notes:\n"), "notes").alias("prompt"), "language")


def reader_state(memories: DataFrame, coverage: DataFrame, last: DataFrame, segs: DataFrame, most: int = 20) -> DataFrame:
    """``document_id, state``: what an assistant may know of a reader: where the last talk stopped, the newest ``most`` notes that were kept,
    oldest first, and how much of the document was heard and talked about.  Documents with none of these give no row.

    ``memories``: ``document_id, ord, pos, text``; ``coverage``: ``document_id, section, heard, discussed``; ``last``: ``document_id, pos,
    title`` (of the section, or null).  Places carry the marker of their block's first passage, if it has one.
    """
    firsts = segs.groupBy("document_id", F.col("block_pos").alias("pos")).agg(F.min("seg_idx").alias("marker"))
    mark = F.coalesce(F.concat(F.lit(" ⟦"), F.col("marker").cast("string"), F.lit("⟧")), F.lit(""))
    where = F.concat(F.lit("The last talk stopped"), F.coalesce(F.concat(F.lit(" in “"), "title", F.lit("”")), F.lit("")), mark, F.lit("."))
    stopped = last.join(firsts, ["document_id", "pos"], "left").groupBy("document_id").agg(F.max(where).alias("line"))
    newest = memories.withColumn("age", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("ord"), F.desc("text")))).where(F.col("age") <= most)
    kept = newest.join(firsts, ["document_id", "pos"], "left").groupBy("document_id").agg(F.concat(F.lit("Notes kept from earlier talks:\n"), _joined(["ord"], F.concat(F.lit("-"), mark, F.lit(" "), "text"), "\n")).alias("line"))
    count = lambda c: F.count(F.when(F.col(c), 1))
    seen = coverage.groupBy("document_id").agg(count("heard").alias("h"), count("discussed").alias("d"), F.count("*").alias("n")).where("h + d > 0")
    seen = seen.select("document_id", F.concat(F.lit("Sections heard: "), F.col("h").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit("; talked about: "), F.col("d").cast("string"), F.lit(".")).alias("line"))
    lines = stopped.select("document_id", F.lit(1).alias("part"), "line").unionByName(kept.select("document_id", F.lit(2).alias("part"), "line")).unionByName(seen.select("document_id", F.lit(3).alias("part"), "line"))
    return lines.groupBy("document_id").agg(_joined(["part"], F.col("line"), "\n").alias("state"))


def assistant_pack(docs: DataFrame, outline: DataFrame, nodes: DataFrame, segs: DataFrame, state: DataFrame | None = None, chars: int = 360_000) -> DataFrame:
    """``document_id, context, truncated``: one text a document for a reading assistant: outline, notes, what is known of the reader
    (``state``: ``document_id, state``), and as much of the passages as fits, each behind its marker, with a note of what does not."""
    firsts = segs.groupBy("document_id", F.col("block_pos").alias("pos")).agg(F.min("seg_idx").alias("marker"))
    mark = F.when(F.col("marker").isNotNull(), F.concat(F.lit(" ⟦"), F.col("marker").cast("string"), F.lit("⟧"))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), "title", mark)
    heads = outline.join(firsts, ["document_id", "pos"], "left").groupBy("document_id").agg(_joined(["pos"], line, "\n").alias("outline"))
    note = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), "title", F.lit(" — "), "summary")
    notes = nodes.where("status = 'ready' and coalesce(summary, '') <> ''").groupBy("document_id").agg(_joined(["ord"], note, "\n").alias("notes"))
    order = Window.partitionBy("document_id").orderBy("seg_idx")
    same = F.lag("block_pos").over(order)
    lead = F.when(same.isNull(), "").when(same == F.col("block_pos"), " ").otherwise("\n\n")
    pieces = segs.withColumn("text", F.concat(lead, F.lit("⟦"), F.col("seg_idx").cast("string"), F.lit("⟧ "), squeeze(F.col("text"))))
    cut = pack_to_budget(pieces, chars).join(segs.groupBy("document_id").agg(F.max("seg_idx").alias("last")), "document_id")
    body = pieces.join(cut, "document_id").where("cut_at = -1 or seg_idx < cut_at").groupBy("document_id").agg(_joined(["seg_idx"], F.col("text"), "").alias("body"))
    left_out = F.when(F.col("cut_at") >= 0, F.concat(F.lit("[Passages ⟦"), F.col("cut_at").cast("string"), F.lit("⟧ to ⟦"), F.col("last").cast("string"), F.lit("⟧ are left out here; they can be read one by one.]")))
    rows = docs.select("document_id", "title").join(heads, "document_id", "left").join(notes, "document_id", "left").join(body, "document_id", "left").join(cut.select("document_id", left_out.alias("left_out")), "document_id", "left")
    rows = rows.join(state, "document_id", "left") if state is not None else rows.withColumn("state", F.lit(None).cast("string"))
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"=== {name} ===\n"), c))
    parts = F.array(part("OUTLINE", "outline"), part("STUDY NOTES", "notes"), part("READER STATE", "state"), F.concat(F.lit("=== DOCUMENT: "), "title", F.lit(" ===\n"), F.coalesce("body", F.lit(""))), F.col("left_out"))
    return rows.select("document_id", F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n").alias("context"), F.col("left_out").isNotNull().alias("truncated"))


def map_model(requests: DataFrame, run: Callable[[list[str], bool], list[str]], accept: Callable[[str], str | None], key: str = "request_id") -> DataFrame:
    """``request_id, answer, status``: ``run`` answers a batch of prompts; rejects are asked once more, strictly; then they fail.

    ``run(prompts, strict)`` and ``accept(answer)`` (the cleaned answer, or None) are the caller's; the number of partitions of
    ``requests`` bounds how many batches run at once.
    """
    kind = requests.schema[key].dataType.simpleString()

    def asked(prompts: list[str], strict: bool) -> list[str | None]:
        answers = run(prompts, strict) if prompts else []
        if len(answers) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts got {len(answers)} answers")
        return [accept(a) for a in answers]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf["prompt"].tolist()
            answers = asked(prompts, False)
            again = [i for i, a in enumerate(answers) if a is None]
            for i, a in zip(again, asked([prompts[i] for i in again], True)):
                answers[i] = a
            yield pd.DataFrame({key: pdf[key], "answer": answers, "status": ["failed" if a is None else "ready" for a in answers]})

    return requests.select(key, "prompt").mapInPandas(work, f"{key} {kind}, answer string, status string")


def ask_once(requests: DataFrame, run: Callable[[list[str], bool], list[str]], accept: Callable[[str], str | None], path: str, model: str, prompt_version: int, key: str = "request_id") -> DataFrame:
    """``request_id, answer, status`` like ``map_model``, with answers kept in a table at ``path`` and asked for once.

    What is asked is told by a digest of prompt, model and prompt version.  Requests of one digest share one question; those that
    have a ready answer in the table are not asked, those that failed are asked anew.  Answers are merged into the table bucket by
    bucket, so that a job that stops loses the buckets that it had not finished and no others.  A null prompt is an empty one.
    """
    named = requests.select(key, F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("digest", F.sha2(F.to_json(F.struct("prompt", F.lit(model).alias("model"), F.lit(prompt_version).alias("version"))), 256))
    spark = requests.sparkSession
    questions = named.groupBy("digest").agg(F.first("prompt").alias("prompt"))
    for part in range(ROUNDS):
        wanted = questions.where(F.pmod(F.xxhash64("digest"), F.lit(ROUNDS)) == part)
        if current_version(spark, path) >= 0:
            wanted = wanted.join(read_latest(spark, path).where("status = 'ready'").select("digest"), "digest", "left_anti")
        upsert_latest(map_model(wanted, run, accept, key="digest").withColumn("asked_at", F.current_timestamp()), path, "digest", "asked_at", buckets=ROUNDS * BUCKETS)
    known = read_latest(spark, path).select("digest", "answer", "status")
    return named.select(key, "digest").join(known, "digest").select(key, "answer", "status")


#: Parts in which questions are asked and their answers stored; each has buckets of its own, so that no task holds a whole part.
ROUNDS = 4


def _plain(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``__t``, what every answer goes through: thoughts, tags, opening phrases, quotes and markup go."""
    text = F.regexp_replace(text, r"(?s)<think>.*?</think>", " ")
    text = F.regexp_replace(text, r"<[^>\n]{0,120}>", " ")
    text = F.regexp_replace(text, r"(?s)\n\s*\n.*$", "")
    rows = rows.withColumn("__bare", text)
    text = F.regexp_replace(strip(F.col("__bare")), r"(?i)^(?:sure|okay|of course|certainly)[,.!:]?\s+", "")
    text = F.regexp_replace(text, r"(?i)^(?:here(?:'s| is)|this is)\s+(?:the\s+)?(?:narration|description|spoken (?:version|text)|text|sentence)[:.,]?\s*", "")
    text = F.regexp_replace(F.regexp_replace(text, "^[\"'`]+", ""), "(?<![\"'`])[\"'`]++$", "")
    text = F.regexp_replace(text, "[*_#`]+", " ")
    rows, spelled = rows.withColumn("__plain", text), F.col("__plain")
    any_symbol = "[" + "".join(symbol.strip("[]") for symbol, _ in SYMBOLS) + "]"
    for symbol, words in SYMBOLS:
        spelled = F.regexp_replace(spelled, symbol, words)
    # most answers have no symbol, and are not searched for each of them
    return rows.withColumn("__t", squeeze(F.when(F.col("__plain").rlike(any_symbol), spelled).otherwise(F.col("__plain")))).drop("__bare", "__plain")


def _letter_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}")) / F.nullif(F.length(text), F.lit(0))


def gate_narration(answers: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ``clean``, null for a reject, and ``reason``: empty, notation, letters, skip, shape, or ok.

    ``answers``: ``kind, answer``; ``params``: ``kind, max_chars`` and, if wanted, ``math_prose``.  Inline phrases lose their full stop
    and must fit whole.  A symbol explanation opens with ``Here`` and says what something is; it is one sentence, or with the
    ``math_prose`` of ``explanation`` all that fits, cut at a sentence end; with ``reading`` it is prose like any other.  An answer to an
    equation that begins with ``skip`` declines.  Longer answers end with the last sentence that fits, but keep the first.
    """
    prose = F.col("math_prose") if "math_prose" in params.columns else F.lit(None).cast("string")
    rows = answers.join(F.broadcast(params.select("kind", "max_chars", F.coalesce(prose, F.lit("")).alias("__prose"))), "kind", "left")
    rows = _plain(rows, F.coalesce("answer", F.lit("")))
    text, style = F.col("__t"), F.coalesce("__prose", F.lit(""))
    inline = strip(F.regexp_replace(text, "[.!?]+$", ""))
    first = F.regexp_extract(text, r"^[^.!?]+[.!?]", 0)
    here = text.rlike(r"(?i)^here\b") & ~text.rlike(r"(?i)^here (?:we|the symbols|are the)\b") & first.rlike(r"(?i)\b(?:is|are|stands for|means|denotes)\b")
    sentences = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+"), F.lit(0))
    # sentences up to the first that does not fit; the first one always stays
    packed = F.aggregate(
        sentences,
        F.struct(F.lit("").alias("kept"), F.lit(False).alias("full")),
        lambda a, s: F.struct(
            F.when(a["full"] | ((a["kept"] != "") & (F.length(a["kept"]) + F.length(s) > F.col("max_chars"))), a["kept"]).otherwise(F.concat(a["kept"], s)).alias("kept"),
            (a["full"] | ((a["kept"] != "") & (F.length(a["kept"]) + F.length(s) > F.col("max_chars")))).alias("full"),
        ),
    )["kept"]
    capped = F.when((F.coalesce("max_chars", F.lit(0)) > 0) & (F.length(text) > F.col("max_chars")) & (F.size(sentences) > 0), F.trim(packed)).otherwise(text)
    part = F.left(text, F.col("max_chars").cast("int"))
    ends = F.transform(F.array(*(F.locate(end, F.reverse(part)) for end in (" .", " !", " ?"))), lambda at: F.when(at > 0, F.length(part) - at).otherwise(0))
    whole = F.when((F.coalesce("max_chars", F.lit(0)) <= 0) | (F.length(text) <= F.col("max_chars")), text).when(F.array_max(ends) > 1, F.left(part, F.array_max(ends))).otherwise(first)
    equation = F.col("kind") == "math-block"
    meaning = equation & (style != "reading")
    shape = F.when(F.col("kind") == "math-inline", (inline != "") & (F.length(inline) <= F.col("max_chars"))).when(meaning, here).otherwise(F.lit(True))
    reason = F.when(text == "", "empty").when(text.rlike(FORBIDDEN), "notation").when(_letter_share(text) < 0.55, "letters").when(equation & text.rlike(r"(?i)^skip\b"), "skip").when(~shape, "shape").otherwise("ok")
    clean = F.when(F.col("kind") == "math-inline", inline).when(meaning & (style == "explanation"), F.trim(whole)).when(meaning, F.trim(first)).otherwise(capped)
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("clean", F.when(F.col("reason") == "ok", clean)).drop("__t", "__prose", "max_chars")


def gate_explanation(answers: DataFrame) -> DataFrame:
    """Adds ``clean``, null for a reject, and ``reason``: markup and opening phrases go; half of the characters must be letters."""
    text = F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?s)<think>.*?</think>", " ")
    text = F.regexp_replace(text, r"<[^>\n]{0,120}>", " ")
    text = F.replace(F.regexp_replace(text, r"(?m)^```[^\n]*$", " "), F.lit("```"), F.lit(" "))
    for mark in (r"(?m)^#{1,6}\s+", r"(?m)^\s*[-*•]\s+", r"(?m)^\s*\d+[.)]\s+"):
        text = F.regexp_replace(text, mark, "")
    text = squeeze(F.regexp_replace(text, "[*_`]+", " "))
    text = F.regexp_replace(text, r"(?i)^(?:sure|okay|of course|certainly)[,.!:]?\s+", "")
    rows = answers.withColumn("__t", text)
    reason = F.when(F.col("__t") == "", "empty").when(_letter_share(F.col("__t")) < 0.5, "letters").otherwise("ok")
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("clean", F.when(F.col("reason") == "ok", F.col("__t"))).drop("__t")


def _alone(pattern: str) -> str:
    """A pattern between characters that are no ASCII letters, digits or underscores, whatever the regex engine counts as a word."""
    return f"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def gate_grounding(answers: DataFrame) -> DataFrame:
    """Adds ``grounded``: every Greek name and single capital of ``answer`` is in ``reading``."""
    names = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_alone(GREEK.replace(r"\b", ""))), F.lit(1))
    letters = lambda c: F.regexp_extract_all(c, F.lit(_alone("([A-Z])")), F.lit(1))
    return answers.withColumn("grounded", (F.size(F.array_except(names("answer"), names("reading"))) == 0) & (F.size(F.array_except(letters("answer"), letters("reading"))) == 0))


def gate_tool_calls(calls: DataFrame, segs: DataFrame, note_chars: int = 600, memory_chars: int = 500) -> DataFrame:
    """``call_id, ok, error, start_segment, end_segment, note``: logged tool calls held against their documents.

    ``calls``: ``call_id, document_id, name, arguments`` (JSON).  Ranges must lie in the document and are put in order, notes must
    not be blank and are clipped; a saved memory only loses a place that does not exist.
    """
    count = segs.groupBy("document_id").agg(F.max("seg_idx").alias("last"))
    shape = "struct<start_segment:string,end_segment:string,segment:string,note:string,query:string,stops:array<struct<start_segment:string,end_segment:string,point:string>>>"
    rows = calls.join(count, "document_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    text = F.coalesce(F.nullif(F.trim("arguments"), F.lit("")), F.lit("{}"))
    rows = rows.withColumns({"a": F.from_json(text, shape), "json": F.try_parse_json(text).isNotNull()})
    whole = lambda c: F.when(c.rlike(r"^\d{1,9}$"), c.cast("int"))
    start = whole(F.col("a.start_segment"))
    end = F.when(F.col("a.end_segment").isNull(), start).otherwise(whole(F.col("a.end_segment")))
    at, note = whole(F.col("a.segment")), F.trim(F.coalesce("a.note", F.lit("")))
    last = F.col("last")
    stop_bad = F.exists("a.stops", lambda s: whole(s["start_segment"]).isNull() | (whole(s["start_segment"]) > last) | F.coalesce(whole(F.coalesce(s["end_segment"], s["start_segment"])) > last, F.lit(True)))
    name = F.col("name")
    error = (
        F.when(~F.col("json"), "json")
        .when(name.isin(*BARE_TOOLS), None)
        .when(name == "plan_tour", F.when(F.coalesce(F.size("a.stops"), F.lit(0)) <= 0, "stops").when(F.size("a.stops") > TOUR_STOPS, "too many stops").when(stop_bad, "range"))
        .when(name == "web_research", F.when(F.trim(F.coalesce("a.query", F.lit(""))) == "", "query"))
        .when(name == "save_memory", F.when(note == "", "note"))
        .when(name == "point_at", F.when(at.isNull() | (at > last), "range"))
        .when(~name.isin(*RANGE_TOOLS), "unknown tool")
        .when(start.isNull() | end.isNull(), "numbers")
        .when((start > last) | (end > last), "range")
        .when((name == "add_note") & (note == ""), "note")
    )
    ranged = name.isin(*RANGE_TOOLS)
    place = F.when(name.isin("point_at", "save_memory") & (at <= last), at)
    rows = rows.withColumns({"error": error, "s": F.when(ranged, F.least(start, end)).otherwise(place), "e": F.when(ranged, F.greatest(start, end)).otherwise(place), "n": F.when(name == "add_note", F.left(note, F.lit(note_chars))).when(name == "save_memory", F.left(note, F.lit(memory_chars)))})
    ok = F.col("error").isNull()
    return rows.select("call_id", ok.alias("ok"), "error", F.when(ok, F.col("s")).alias("start_segment"), F.when(ok, F.col("e")).alias("end_segment"), F.when(ok, F.col("n")).alias("note"))


def followup_needed(calls: DataFrame) -> DataFrame:
    """``response_id, follow_up``: whether a response that called tools is answered with another one.

    Not while a call is pending or once a section plays; always after a failure; else unless it spoke and all were confirmations.
    ``calls``: ``response_id, name, pending, failed, spoke``.
    """
    found = calls.groupBy("response_id").agg(F.bool_or(F.col("name") == "play_section").alias("plays"), F.bool_or("pending").alias("waits"), F.bool_or("failed").alias("fails"), F.bool_and(F.col("name").isin(*CONFIRMATIONS)).alias("confirms"), F.bool_or("spoke").alias("spoke"))
    follow = F.when(F.col("plays") | F.col("waits"), False).when(F.col("fails"), True).otherwise(~F.col("spoke") | ~F.col("confirms"))
    return found.select("response_id", follow.alias("follow_up"))
