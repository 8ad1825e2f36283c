"""Queries over texts: predicates, generators, page and web clean-up, gates over model text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.operators import aggregates, generators, listing, modeltext, predicates, windows
from listenlake.plans.registry import query
from listenlake.plans.views import Views
from listenlake.sources import library

_WORD_SQL = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"


@query("select d.document_id, title, source_kind, language, fingerprint, d.updated_at, segment_id, p.updated_at as played_at from library d left join playback p on d.document_id = p.document_id and p.updated_at >= d.updated_at", "library", "playback")
def read_library(v: Views) -> DataFrame:
    return library.read_library(v.library, v.playback)


@query("select page_id, url, length(html) as n_chars from pages")
def read_web_pages(v: Views) -> DataFrame:
    return library.read_web_pages(v.spark, f"{v.folder}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query(
    """select doc_id as document_id, name, mime, case when mime = 'application/pdf' or ext = 'pdf' then 'pdf' when ext = 'docx' then 'docx' when ext in ('md', 'markdown', 'mdown', 'mkd') or mime = 'text/markdown' then 'markdown'
 when mime like 'text/%' or ext in ('txt', 'text') then 'text' end as source_kind from (select doc_id, source || case doc_id % 5 when 0 then '.PDF' when 1 then '.md' when 2 then '.docx' when 3 then '.txt' else '.bin' end as name,
 case doc_id % 7 when 0 then 'application/pdf' when 1 then 'text/html' else '' end as mime, case doc_id % 5 when 0 then 'pdf' when 1 then 'md' when 2 then 'docx' when 3 then 'txt' else 'bin' end as ext from documents)"""
)
def source_kind(v: Views) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".docx", ".txt", ".bin"))), (F.col("document_id") % 5 + 1).cast("int"))
    mime = F.when(F.col("document_id") % 7 == 0, "application/pdf").when(F.col("document_id") % 7 == 1, "text/html").otherwise("")
    docs = v.documents.select("document_id", F.concat("source", end).alias("name"), mime.alias("mime"))
    return predicates.source_kind(docs, "name", "mime")


_MARKED = "case doc_id % 8 when 0 then '# ' || text when 1 then '- ' || text when 2 then text || chr(10) || '> said so' when 3 then text || ' ![a](b.png)' when 4 then text || chr(10) || '---' else text end"


@query(
    f"""select doc_id as document_id, regexp_matches(t, '(?m)^\\s{{0,3}}#{{1,6}}\\s+\\S') or regexp_matches(t, '(?m)^\\s{{0,3}}>\\s+\\S') or regexp_matches(t, '(?m)^\\s{{0,3}}(?:[-+*]|\\d+[.)])\\s+\\S')
 or regexp_matches(t, '\\[[^\\]]*\\]\\([^\\s)]+\\)') or regexp_matches(t, '(?m)^\\s{{0,3}}(?:-{{3,}}|\\*{{3,}}|_{{3,}})\\s*$') or regexp_matches(t, '(?m)^\\s*\\|?.+\\|.+\\n\\s*\\|?\\s*:?-{{3,}}') as markdown from (select doc_id, {_MARKED} as t from documents)"""
)
def looks_like_markdown(v: Views) -> DataFrame:
    k = F.col("document_id") % 8
    text = F.when(k == 0, F.concat(F.lit("# "), "text")).when(k == 1, F.concat(F.lit("- "), "text")).when(k == 2, F.concat("text", F.lit("\n> said so"))).when(k == 3, F.concat("text", F.lit(" ![a](b.png)"))).when(k == 4, F.concat("text", F.lit("\n---"))).otherwise(F.col("text"))
    return predicates.looks_like_markdown(v.documents.select("document_id", text.alias("text"))).select("document_id", "markdown")


@query(
    """select source, count(*) filter (where n > 0) as documents, cast(sum(n) as bigint) as removed_chars from (select source, length(t) - length(regexp_replace(regexp_replace(t, ' ?' || chr(57856) || '[^' || chr(57856) || chr(57857) || ']{0,120}' || chr(57857), '', 'g'), ' ?\\bturn\\d+(?:file|search|news|image|video|fetch|forecast|sports|finance)\\d+\\b', '', 'g')) as n
 from (select source, case when doc_id % 3 = 0 then text || ' ' || chr(57856) || 'filecite turn0' || chr(57857) || ' end' when doc_id % 3 = 1 then text || ' turn0search3' else text end as t from documents)) group by source"""
)
def strip_citation_artifacts(v: Views) -> DataFrame:
    k = F.col("document_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit(" \ue200filecite turn0\ue201 end"))).when(k == 1, F.concat("text", F.lit(" turn0search3"))).otherwise(F.col("text"))
    found = predicates.strip_citation_artifacts(v.documents.select("source", text.alias("text")))
    return found.groupBy("source").agg(F.count(F.when(F.col("removed_chars") > 0, 1)).alias("documents"), F.sum("removed_chars").alias("removed_chars"))


@query("select document_id, pos, trim(regexp_replace(text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end', '[ \\t]+\\n', chr(10), 'g')).regexp_replace('\\n{3,}', chr(10) || chr(10), 'g') as text, true as speak from blocks", "blocks")
def normalize_block_text(v: Views) -> DataFrame:
    blocks = v.blocks.withColumn("text", F.concat("text", F.lit("  \n\n\n\nend")))
    return predicates.normalize_block_text(blocks).select("document_id", "pos", "text", "speak")


@query("select doc_id as document_id, source from documents where length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) >= 240")
def readable_gate(v: Views) -> DataFrame:
    return predicates.readable_gate(v.documents).select("document_id", "source")


@query("select document_id, n < greatest(24, 8 * pages) as scanned from (select document_id, max(page) as pages, length(regexp_replace(string_agg(text, chr(10)), '[^\\p{L}\\p{N}]+', '', 'g')) as n from blocks group by document_id)", "blocks")
def scanned_gate(v: Views) -> DataFrame:
    docs = v.blocks.groupBy("document_id").agg(F.max("page").alias("pages"), F.array_join(F.collect_list("text"), "\n").alias("text"))
    return predicates.scanned_gate(docs).select("document_id", "scanned")


@query("select document_id, title from library where contains(lower(title), 'src1')", "library")
def title_search(v: Views) -> DataFrame:
    return predicates.title_search(v.library, " SRC1 ").select("document_id", "title")


_OTHER = "".join(rf"\p{{{s}}}" for s in predicates.NON_LATIN_SCRIPTS)


@query(
    rf"""select document_id, case when length(text) < 24 then true when other + latin >= 20 and case when foreign_tag then other / (other + latin) < 0.5 else other / (other + latin) > 0.2 end then false when lang <> 'en' then true
 else list_unique(regexp_extract_all(lower(text), '\b({"|".join(predicates.ENGLISH_CONNECTIVES)})\b')) >= 2 end as plausible
 from (select document_id, text, lang, length(regexp_replace(text, '[^{_OTHER}]', '', 'g')) as other, length(regexp_replace(text, '[^\p{{Latin}}]', '', 'g')) as latin, regexp_matches(lang, '^({"|".join(predicates.NON_LATIN_LANGUAGES)})\b') as foreign_tag
 from (select doc_id as document_id, trim(text) as text, coalesce(lower(lang), 'en') as lang from documents))"""
)
def language_gate(v: Views) -> DataFrame:
    return predicates.language_gate(v.documents.withColumn("text", F.trim("text")), language="lang").select("document_id", "plausible")


_TITLED = "case pos % 18 when 0 then '2. References' when 6 then 'Notes:' else text end"
_BACK = "regexp_replace(regexp_replace(lower(trim(t)), '^(?:\\d+(?:\\.\\d+)+\\.?|\\d+[.)]|(?:[ivxlcdm]+|[a-z])[.)])\\s+', ''), '[:.]+$', '') in ('references', 'notes')"


@query(f"select document_id, pos, kind = 'heading' and {_BACK} as back_matter from (select *, {_TITLED} as t from blocks)", "blocks")
def back_matter_heading(v: Views) -> DataFrame:
    return predicates.back_matter_heading(_with_back_matter(v)).select("document_id", "pos", "back_matter")


def _with_back_matter(v: Views) -> DataFrame:
    return v.blocks.withColumn("text", F.when(F.col("pos") % 18 == 0, "2. References").when(F.col("pos") % 18 == 6, "Notes:").otherwise(F.col("text")))


_PARAGRAPHED = "regexp_replace(text, '([.!?]) ([A-Z])', '\\1' || chr(10) || chr(10) || '\\2', 'g')"


@query(
    f"""select document_id, cast(row_number() over (partition by document_id order by p) as int) - 1 as pos, t as text from (select document_id, p, trim(regexp_replace(x, '\\s*\\n\\s*', ' ', 'g')) as t from
 (select doc_id as document_id, unnest(a) as x, generate_subscripts(a, 1) as p from (select doc_id, string_split_regex({_PARAGRAPHED}, '\\n\\s*\\n') as a from documents))) where t <> ''"""
)
def explode_blocks(v: Views) -> DataFrame:
    docs = v.documents.withColumn("text", F.regexp_replace("text", "([.!?]) ([A-Z])", "$1\n\n$2"))
    return generators.explode_blocks(docs).select("document_id", "pos", "text")


@query(
    """select document_id, class, count(*) as lines, cast(sum(n) as bigint) as n_chars from (select document_id, length(l) as n, case when regexp_matches(l, '^\\s{0,3}(```|~~~)') then 'fence' when inside then 'code' when regexp_matches(l, '^\\s*$') then 'blank'
 when regexp_matches(l, '^\\s{0,3}#{1,6}\\s+\\S') then 'heading' when regexp_matches(l, '^\\s{0,3}(?:-{3,}|\\*{3,}|_{3,})\\s*$') then 'rule' when regexp_matches(l, '^\\s*(?:[-+*]|\\d+[.)])\\s+\\S') then 'list' when regexp_matches(l, '^\\s{0,3}>') then 'quote'
 when regexp_matches(l, '^\\s*\\|.*\\|\\s*$') then 'table' else 'prose' end as class from (select *, coalesce(sum(cast(regexp_matches(l, '^\\s{0,3}(```|~~~)') as int)) over (partition by document_id order by p rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside
 from (select doc_id as document_id, unnest(a) as l, generate_subscripts(a, 1) as p from (select doc_id, string_split('# Top' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || '- item' || chr(10) || text, chr(10)) as a from documents)))) group by document_id, class"""
)
def line_inventory(v: Views) -> DataFrame:
    docs = v.documents.withColumn("text", F.concat(F.lit("# Top\n```\n"), "text", F.lit("\n```\n- item\n"), "text"))
    return generators.line_inventory(docs).groupBy("document_id", "class").agg(F.count("*").alias("lines"), F.sum("n_chars").alias("n_chars"))


@query("select document_id, seg_idx, segment_id, block_pos, text from segments", "segments")
def sentences(v: Views) -> DataFrame:
    return generators.sentences(v.blocks).select("document_id", "seg_idx", "segment_id", "block_pos", "text")


@query(None)
def split_long(v: Views) -> DataFrame:
    return generators.split_long(v.segments.select("document_id", "seg_idx", "text"))


@query(None)
def spoken_text(v: Views) -> DataFrame:
    return generators.spoken_text(v.segments.select("document_id", "seg_idx", "text")).select("document_id", "seg_idx", "spoken_text", F.size("spans").alias("n_words"))


@query(f"select document_id, seg_idx, generate_subscripts(a, 1) - 1 as word_idx, unnest(a) as word from (select document_id, seg_idx, regexp_extract_all(text, '{_WORD_SQL}') as a from segments)", "segments")
def explode_words(v: Views) -> DataFrame:
    return generators.explode_words(v.segments)


_SPEAKABLE = "text || ' [' || doc_id || '] see https://a.io/x' || doc_id || ', 12-15 of Fig. 3 at 50%'"


@query(
    f"""select document_id, rule, hits from (select doc_id as document_id, unnest(['link', 'citation', 'abbreviation', 'range', 'percent']) as rule, unnest([len(regexp_extract_all(t, 'https?://[^\\s<>()]+')), len(regexp_extract_all(t, '\\[\\s*\\d+(?:\\s*[,;-]\\s*\\d+)*\\s*\\]')),
 len(regexp_extract_all(t, '\\b(?:et al|Fig|Figs|Eq|Eqs|Ref|Refs|Sec|Ch|Chap)\\.')), len(regexp_extract_all(t, '\\b\\d{{1,3}}-\\d{{1,3}}\\b')), len(regexp_extract_all(t, '\\d%'))]) as hits from (select doc_id, {_SPEAKABLE} as t from documents)) where hits > 0"""
)
def spoken_rule_tally(v: Views) -> DataFrame:
    number = F.col("document_id").cast("string")
    docs = v.documents.withColumn("text", F.concat("text", F.lit(" ["), number, F.lit("] see https://a.io/x"), number, F.lit(", 12-15 of Fig. 3 at 50%")))
    return generators.spoken_rule_tally(docs)


@query("select document_id, seg_idx, round(est_duration, 6) as est_duration from timed", "timed")
def estimate_duration(v: Views) -> DataFrame:
    return _timed(v).select("document_id", "seg_idx", F.round("est_duration", 6).alias("est_duration"))


def _timed(v: Views) -> DataFrame:
    return generators.estimate_duration(v.segments)


@query(
    """select host, safe, count(*) as links, count(distinct document_id) as documents from (select document_id, case when url like 'www.%' then regexp_replace(lower(regexp_extract(url, '^([^/?#]*)', 1)), '^www\\.', '') else regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') end as host,
 regexp_matches(lower(url), '^(https?:|mailto:|www\\.|//)') as safe from (select page_id as document_id, regexp_replace(unnest(regexp_extract_all(url || ' ' || html, '(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\\s<>()"'']+|mailto:[^\\s<>()"'']+|www\\.[^\\s<>()"'']+')), '[.,;:!?''"\\]]+$', '') as url from pages)) group by host, safe"""
)
def link_inventory(v: Views) -> DataFrame:
    links = generators.link_inventory(v.table("pages").withColumn("text", F.concat("url", F.lit(" "), "html")), "page_id")
    return links.groupBy("host", "safe").agg(F.count("*").alias("links"), F.countDistinct("document_id").alias("documents"))


def _drop(column: str, *tags: str) -> str:
    for tag in tags:
        column = f"regexp_replace({column}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    return column


_BODY = f"regexp_replace({_drop('html', 'head', 'script', 'style', 'nav', 'header', 'footer', 'aside', 'noscript')}, '(?s)<!--.*?-->', ' ', 'g')"
_BODY = f"regexp_replace(regexp_replace({_BODY}, '(?i)<sup>\\s*</sup>', '', 'g'), '(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|section|article|blockquote)>', chr(10), 'g')"
_BODY = f"regexp_replace({_BODY}, '(?s)<[^>]*>', ' ', 'g')"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BODY, _TITLE = f"replace({_BODY}, '{_entity}', '{_char}')", f"replace({_TITLE}, '{_entity}', '{_char}')"
_BODY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"select page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) as title, {_BODY} as text from pages")
def article_text(v: Views) -> DataFrame:
    return generators.article_text(v.table("pages"))


@query("select document_id, fingerprint, first_id, document_id <> first_id as copy from (select doc_id as document_id, sha256(text) as fingerprint, min(doc_id) over (partition by text) as first_id from documents)")
def dedup_exact(v: Views) -> DataFrame:
    return windows.dedup_exact(v.documents)


_WEB = "'web:' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"


@query(f"select page_id, web_key, first_id, page_id <> first_id as copy from (select *, min(page_id) over (partition by web_key) as first_id from (select page_id, {_WEB} as web_key from pages))")
def dedup_web(v: Views) -> DataFrame:
    return windows.dedup_web(v.table("pages"))


# --- page texts: a document's blocks of one page, with a running header and every line but headings in bold

_PAGES = "select document_id, page, 'Journal of Listening, p. ' || page || chr(10) || string_agg(case when kind = 'heading' then '# ' || text else '**' || text || '**' end, chr(10) order by pos) as text from blocks group by document_id, page"


def _pages(v: Views) -> DataFrame:
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("# "), "text")).otherwise(F.concat(F.lit("**"), "text", F.lit("**")))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    return v.blocks.groupBy("document_id", "page").agg(lines.alias("lines")).select("document_id", "page", F.concat(F.lit("Journal of Listening, p. "), F.col("page").cast("string"), F.lit("\n"), "lines").alias("text"))


_STRUCTURAL_SQL = "^(#{1,6}\\s|\\||```|[-*+]\\s|\\d+[.)]\\s|>|!\\[)"
_CHROME = f"""select document_id, chrome_key, count(*) as pages_with from (select distinct document_id, page, unnest([regexp_replace(lower(trim(string_split(text, chr(10))[1])), '\\d+', '#', 'g'), regexp_replace(lower(trim(string_split(text, chr(10))[-1])), '\\d+', '#', 'g')]) as chrome_key from paged)
 join (select document_id, count(*) as n from paged group by document_id) using (document_id) where not regexp_matches(chrome_key, '{_STRUCTURAL_SQL}') and chrome_key <> '' group by document_id, chrome_key, n having n >= 3 and count(*) >= greatest(3, ceil(n * 0.6))"""


def _paged(sql: str) -> str:
    from listenlake.plans.views import with_views

    return with_views(f"select * from (with paged as materialized ({_PAGES}), chrome as materialized ({_CHROME}) {sql})", "blocks")


@query(_paged("select * from chrome"))
def page_chrome(v: Views) -> DataFrame:
    return aggregates.page_chrome(_pages(v))


@query(
    _paged(
        f"""select document_id, page, regexp_replace(string_agg(case when is_chrome and (coalesce(max_before, 0) = 0 or coalesce(max_after, 0) = 0) then '' else l end, chr(10) order by p), '^\\n+|\\n+$', '', 'g') as text from (select *, max(cast(trim(l) <> '' and not is_chrome as int)) over (w rows between unbounded preceding and 1 preceding) as max_before, max(cast(trim(l) <> '' and not is_chrome as int)) over (w rows between 1 following and unbounded following) as max_after
 from (select x.*, c.chrome_key is not null and trim(l) <> '' and not regexp_matches(trim(l), '{_STRUCTURAL_SQL}') as is_chrome from (select document_id, page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as p from paged) x left join chrome c on c.document_id = x.document_id and c.chrome_key = regexp_replace(lower(trim(l)), '\\d+', '#', 'g')) window w as (partition by document_id, page order by p)) group by document_id, page"""
    )
)
def strip_page_chrome(v: Views) -> DataFrame:
    pages = _pages(v)
    return aggregates.strip_page_chrome(pages, aggregates.page_chrome(pages))


@query(
    _paged(
        f"""select document_id, page, string_agg(case when share >= 0.6 and bold then substring(l, 3, length(l) - 4) else l end, chr(10) order by p) as text from (select *, avg(case when prose then cast(bold as double) end) over (partition by document_id) as share
 from (select *, not regexp_matches(l, '{_STRUCTURAL_SQL}') and l <> '' as prose, regexp_matches(l, '^\\*\\*[^*]') and regexp_matches(l, '[^*]\\*\\*$') and not contains(substring(l, 3, length(l) - 4), '**') and not regexp_matches(l, '{_STRUCTURAL_SQL}') as bold from (select document_id, page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as p from paged))) group by document_id, page"""
    )
)
def blanket_bold(v: Views) -> DataFrame:
    return aggregates.blanket_bold(_pages(v))


_SEAM = f"""case when tail = '' or head = '' or regexp_matches(tail, '{_STRUCTURAL_SQL}') or regexp_matches(head, '{_STRUCTURAL_SQL}') or not regexp_matches(head, '^\\p{{Ll}}') then 'break' when regexp_matches(tail, '\\p{{L}}-$') then 'hyphen' when not regexp_matches(tail, '[.!?:][)”"'']?$') then 'space' else 'break' end"""


@query(f"select document_id, page, case when tail is not null then {_SEAM} end as seam from (select document_id, page, first as head, lag(last) over (partition by document_id order by page) as tail from (select document_id, page, case when page % 2 = 0 then lower(arg_min(text, pos)) else arg_min(text, pos) end as first, arg_max(text, pos) || case page % 3 when 0 then '' when 1 then ' and' else ' evi-' end as last from blocks group by document_id, page))", "blocks")
def page_seams(v: Views) -> DataFrame:
    ends = v.blocks.groupBy("document_id", "page").agg(F.min_by("text", "pos").alias("first"), F.max_by("text", "pos").alias("last"))
    first = F.when(F.col("page") % 2 == 0, F.lower("first")).otherwise(F.col("first"))
    last = F.concat("last", F.when(F.col("page") % 3 == 0, "").when(F.col("page") % 3 == 1, " and").otherwise(" evi-"))
    return windows.page_seams(ends.select("document_id", "page", F.concat(first, F.lit("\n"), last).alias("text")))


@query(None)
def assemble_pages(v: Views) -> DataFrame:
    text, spans = windows.assemble_pages(_pages(v))
    return spans.join(text.select("document_id", F.length("text").alias("n_chars")), "document_id")


@query(
    """select document_id, page, cast(para as int) as para, regexp_replace(string_agg(text, ' ' order by pos), '- ([a-z])', '\\1', 'g') as text from (select *, sum(opens) over (partition by document_id, page order by pos rows unbounded preceding) as para
 from (select document_id, page, pos, text, case when regexp_matches(text, '^[A-Z“"'']') and regexp_matches(lag(text) over (partition by document_id, page order by pos), '[.!?][”"'']?$') then 1 else 0 end as opens from blocks)) group by document_id, page, para""",
    "blocks",
)
def rebuild_paragraphs(v: Views) -> DataFrame:
    return windows.rebuild_paragraphs(v.blocks.select("document_id", "page", F.col("pos").alias("line_no"), F.col("text").alias("line")))


# --- gates over answers: sentences of the documents, some spoiled on purpose

_ANSWER = "case seg_idx % 5 when 0 then 'Sure, ' || text when 1 then text || ' x = 5' when 2 then '12 34 56 7' when 3 then '**' || text || '**' else text end"


def _answers(v: Views) -> DataFrame:
    k = F.col("seg_idx") % 5
    answer = F.when(k == 0, F.concat(F.lit("Sure, "), "text")).when(k == 1, F.concat("text", F.lit(" x = 5"))).when(k == 2, "12 34 56 7").when(k == 3, F.concat(F.lit("**"), "text", F.lit("**"))).otherwise(F.col("text"))
    return v.segments.select("document_id", "seg_idx", answer.alias("answer"), F.when(F.col("seg_idx") % 2 == 0, "table-row").otherwise("image").alias("kind"))


_ANSWERS_SQL = f"select document_id, seg_idx, case when seg_idx % 2 = 0 then 'table-row' else 'image' end as kind, {_ANSWER} as answer from segments"
_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]"


def _replaced(text: str, *rules: tuple[str, str] | tuple[str, str, str]) -> str:
    """DuckDB's ``regexp_replace`` of all rules, one after the other."""
    for pattern, words in rules:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), words)
    return text


_OPENINGS = (("^(?i)(?:sure|okay|of course|certainly)[,.!:]?\\s+", ""), ("^(?i)(?:here(?:'s| is)|this is)\\s+(?:the\\s+)?(?:narration|description|spoken (?:version|text)|text|sentence)[:.,]?\\s*", ""))
_NARRATION_SQL = _replaced("answer", ("(?s)<think>.*?</think>", " "), ("<[^>\\n]{0,120}>", " "), ("(?s)\\n\\s*\\n.*$", ""), (f"^{_BLANK}+|{_BLANK}+$", ""), *_OPENINGS, ("^[\"'`]+", ""), ("[\"'`]+$", ""), ("[*_#`]+", " "), *modeltext.SYMBOLS, (f"{_BLANK}+", " "), ("^ | $", ""))
_EXPLANATION_SQL = _replaced("answer", ("(?s)<think>.*?</think>", " "), ("<[^>\\n]{0,120}>", " "), ("(?m)^```[^\\n]*$", " "), ("```", " "), ("(?m)^#{1,6}\\s+", ""), ("(?m)^\\s*[-*•]\\s+", ""), ("(?m)^\\s*\\d+[.)]\\s+", ""), ("[*_`]+", " "), (f"{_BLANK}+", " "), ("^ | $", ""), _OPENINGS[0])


def _reason(forbidden: bool, share: float) -> str:
    notation = f"when regexp_matches(t, '{modeltext.FORBIDDEN}') then 'notation'" if forbidden else ""
    return f"case when t = '' then 'empty' {notation} when (length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g'))) / cast(length(t) as double) < {share} then 'letters' else 'ok' end"


@query(f"select kind, {_reason(True, 0.55)} as reason, count(*) as n from (select kind, {_NARRATION_SQL} as t from ({_ANSWERS_SQL})) group by 1, 2", "segments")
def gate_narration(v: Views) -> DataFrame:
    gated = modeltext.gate_narration(_answers(v), modeltext.budgets(v.spark))
    return gated.groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query(f"select document_id, seg_idx, {_reason(False, 0.5)} as reason, case when {_reason(False, 0.5)} = 'ok' then t end as clean from (select document_id, seg_idx, {_EXPLANATION_SQL} as t from ({_ANSWERS_SQL}))", "segments")
def gate_explanation(v: Views) -> DataFrame:
    return modeltext.gate_explanation(_answers(v)).select("document_id", "seg_idx", "reason", "clean")


_GREEK_SQL = modeltext.GREEK


@query(
    f"""select document_id, seg_idx, len(list_filter(a, lambda x: not list_contains(r, x))) = 0 as grounded from (select document_id, seg_idx, list_concat(regexp_extract_all(lower(answer), '{_GREEK_SQL}'), regexp_extract_all(answer, '\\b[A-Z]\\b')) as a, list_concat(regexp_extract_all(lower(text), '{_GREEK_SQL}'), regexp_extract_all(text, '\\b[A-Z]\\b')) as r
 from (select document_id, seg_idx, text || ' alpha and ' || case when seg_idx % 3 = 0 then 'beta' when seg_idx % 3 = 1 then 'B' else 'C' end as answer, case when seg_idx % 2 = 0 then text || ' alpha over B with beta' else lag(text, 1, '') over (partition by document_id order by seg_idx) || ' Alpha and C' end as text from segments))""",
    "segments",
)
def gate_grounding(v: Views) -> DataFrame:
    k = F.col("seg_idx") % 3
    before = F.lag("text", 1, "").over(Window.partitionBy("document_id").orderBy("seg_idx"))
    answer = F.concat("text", F.lit(" alpha and "), F.when(k == 0, "beta").when(k == 1, "B").otherwise("C"))
    reading = F.when(F.col("seg_idx") % 2 == 0, F.concat("text", F.lit(" alpha over B with beta"))).otherwise(F.concat(before, F.lit(" Alpha and C")))
    return modeltext.gate_grounding(v.segments.select("document_id", "seg_idx", answer.alias("answer"), reading.alias("reading"))).select("document_id", "seg_idx", "grounded")


@query(
    """select call_id, error is null as ok, error, case when error is null then case when name = 'point_at' then null else least(s, e) end end as start_segment, case when error is null then case when name = 'point_at' then null else greatest(s, e) end end as end_segment from
 (select call_id, name, s, e, case when name = 'point_at' then 'range' when name = 'no_such_tool' then 'unknown tool' when s > last or e > last then 'range' when name = 'add_note' then 'note' end as error from (select call_id, name, start_segment as s, end_segment as e, coalesce(last, -1) as last from tool_calls left join (select document_id, max(seg_idx) as last from segments group by document_id) using (document_id)))""",
    "segments",
    "tool_calls",
)
def gate_tool_calls(v: Views) -> DataFrame:
    calls = v.tool_calls.select("call_id", "document_id", "name", F.to_json(F.struct("start_segment", "end_segment")).alias("arguments"))
    return modeltext.gate_tool_calls(calls, v.segments).drop("note")


@query(
    """select response_id, case when bool_or(waits) then false when bool_or(fails) then true else not bool_or(spoke) or not bool_and(name in ('add_note', 'point_at')) end as follow_up
 from (select call_id // 4 as response_id, name, call_id % 11 = 0 as waits, call_id % 13 = 0 as fails, call_id % 2 = 0 as spoke from tool_calls) group by response_id""",
    "tool_calls",
)
def followup_needed(v: Views) -> DataFrame:
    k = F.col("call_id")
    calls = v.tool_calls.select(F.floor(k / 4).alias("response_id"), "name", (k % 11 == 0).alias("pending"), (k % 13 == 0).alias("failed"), (k % 2 == 0).alias("spoke"))
    return modeltext.followup_needed(calls)


@query("select document_id, seg_idx, sha256(document_id || chr(31) || segment_id || chr(31) || text || chr(31) || 'voice-1') as variant_key from segments", "segments")
def variant_key(v: Views) -> DataFrame:
    return listing.variant_key(v.segments, "document_id", "segment_id", "text", F.lit("voice-1")).select("document_id", "seg_idx", "variant_key")


@query(
    """select document_id, construct_id, kind, case when kind <> 'math-block' then trim('Describe ' || source || ' under ' || coalesce(header, '')) end as prompt, case kind when 'math-block' then 0 when 'image' then 40 else 48 end as max_tokens, kind = 'math-block' as settled
 from (select document_id, block_id as construct_id, case pos % 3 when 0 then 'math-block' when 1 then 'image' else 'table-row' end as kind, text as source, case when level is not null then 'h' || level end as header from blocks)""",
    "blocks",
)
def narration_requests(v: Views) -> DataFrame:
    k = F.col("pos") % 3
    constructs = v.blocks.select("document_id", F.col("block_id").alias("construct_id"), F.when(k == 0, "math-block").when(k == 1, "image").otherwise("table-row").alias("kind"), F.col("text").alias("source"), F.concat(F.lit("h"), F.col("level").cast("string")).alias("header"), F.lit("").alias("context"))
    templates = v.spark.createDataFrame([(kind, "Describe {{source}} under {{header}}") for kind in ("math-block", "image", "table-row")], "kind string, template string")
    return modeltext.narration_requests(constructs, templates, modeltext.budgets(v.spark, "concise")).drop("max_chars")
