"""Queries over texts, with their SQL."""

from pyspark.sql import functions as F

from foliolake.functions import text as t
from foliolake.operators import quality as q
from foliolake.operators import textstats as s
from foliolake.session import table

QUERIES, SQL = {}, {}
ST = "regexp_replace({0},'^\\s+|\\s+$','','g')"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark, d):
    return table(spark, d, "book_pages")


_CNT = ", ".join(f"coalesce(len(regexp_extract_all(ocr_text, '{v}')),0) as {k}" for k, v in t.SCRIPTS.items())
_SUM = "(" + "+".join(t.SCRIPTS) + ")"
_HIST = f"h as (select page_id, {_CNT} from book_pages)"
_RULES = (
    ("hiragana/t > 0.1 or katakana/t > 0.05", "ja", "least(0.95, (hiragana+katakana)/t+0.5)"),
    ("hangul/t > 0.3", "ko", "least(0.95, hangul/t+0.3)"),
    ("kanji/t > 0.3 and hiragana = 0", "zh", "least(0.90, kanji/t+0.2)"),
    ("arabic/t > 0.5", "ar", "least(0.95, arabic/t+0.3)"),
    ("cyrillic/t > 0.5", "ru", "least(0.90, cyrillic/t+0.2)"),
    ("thai/t > 0.5", "th", "least(0.95, thai/t+0.3)"),
    ("latin/t > 0.7", "en", "0.5"),
)
_DET = f"{_HIST}, ht as (select *, nullif({_SUM},0) as t from h), det as (select page_id, case " + " ".join(f"when {a} then '{b}'" for a, b, _ in _RULES) + " end as language, round(case " + " ".join(f"when {a} then cast({c} as double)" for a, _, c in _RULES) + " end, 6) as confidence from ht)"


@query(f"with {_HIST} select * from h")
def script_histogram(spark, d):
    return s.script_languages(pages(spark, d)).select("page_id", *t.SCRIPTS)


@query(f"with {_DET} select * from det")
def language_detect(spark, d):
    return s.script_languages(pages(spark, d)).select("page_id", "language", "confidence")


@query(
    f"with {_DET}, j as (select page_id, coalesce({ST.format('ocr_text')},'')='' as bl, language, confidence from book_pages join det using (page_id)) select page_id, case when bl then 'ja' when confidence > 0.9 then language else 'xx' end as language, cast(case when bl then 0.0 when confidence > 0.9 then confidence else 0.9 end as double) as confidence, case when bl then 'default' when confidence > 0.9 then 'heuristic' else 'model' end as method from j"
)
def language_cascade(spark, d):
    def model(texts: "pd.Series") -> "pd.Series":
        return texts.map(lambda _: "xx")

    return s.cascade(pages(spark, d), model)


import pandas as pd  # noqa: E402  (named in the annotations of the model above)


@query("with l as (select distinct detected_language as label from book_pages where detected_language is not null) select label, coalesce(name, 'Unknown ('||label||')') as name from l left join languages on code = label")
def language_names(spark, d):
    labels = pages(spark, d).select(F.col("detected_language").alias("label")).filter("label is not null").distinct()
    return s.language_names(labels, table(spark, d, "languages"))


@query(
    "with c as (select page_id, coalesce(nullif(translated_text,''), ocr_text) as c from book_pages), w0 as (select page_id, regexp_split_to_array(c,'\\s+') as l from c), w as (select page_id, 0 as kind, cast(i-1 as int) as pos, l[i] as term from w0, lateral (select unnest(range(1,len(l)+1)) as i)), "
    "r0 as (select page_id, regexp_extract_all(c,'[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]{2,}') as l from c), r as (select page_id, 1 as kind, cast(i-1 as int) as pos, l[i] as term from r0, lateral (select unnest(range(1,len(l)+1)) as i)), a as (select * from w where regexp_matches(term,'^[A-Za-z]{6,}$') union all select * from r) "
    "select term, count(*) as n from a group by term order by n desc, min(struct_pack(a := page_id, b := kind, c := pos)), term limit 60"
)
def glossary_top60(spark, d):
    return s.glossary(pages(spark, d))


_SOLID = "coalesce(length(regexp_replace({0},'\\s+','','g')),0)"


@query(
    f"with b as (select distinct page_id, box_id, translation from text_boxes), g as (select page_id, cast(sum({_SOLID.format('translation')}) as bigint) as target from b group by 1), j as (select page_id, {_SOLID.format('ocr_text')} as source, coalesce(target,0) as target from book_pages left join g using (page_id)), "
    "k as (select *, case when source=0 or target=0 then 1.0 when target/source >= 1.3 then greatest(0.8, 1.0-(target/source-1.0)*0.25) else 1.0 end as sc from j) select page_id, source, target, round(sc,6) as scale, case when sc < 0.95 then 1.26 else 1.4 end as line_height from k"
)
def text_expansion(spark, d):
    return s.expansion(pages(spark, d), table(spark, d, "text_boxes").dropDuplicates(["page_id", "box_id"]))


@query(
    f"with p as (select page_id, unnest(string_split(ocr_text, chr(10)||chr(10))) as p from book_pages), q as (select page_id, p, coalesce({ST.format('p')},'') as t from p) select page_id, p as paragraph, case when t='' then 'empty' when t like '-%' and t like '%-' and length(t) < 10 then 'keep' when length(t) < 50 and (contains(p,'(') or contains(p,')') or (upper(p)=p and lower(p)<>p)) then 'header' else 'body' end as route from q"
)
def paragraph_routing(spark, d):
    p = pages(spark, d).select("page_id", F.explode(F.split("ocr_text", "\n\n")).alias("paragraph"))
    return p.select("page_id", "paragraph", t.paragraph_route(F.col("paragraph")).alias("route"))


@query(f"select page_id, list_filter(list_transform(string_split(ocr_text, chr(10)||chr(10)), lambda p: {ST.format('p')}), lambda p: p <> '') as paragraphs from book_pages")
def paragraph_split(spark, d):
    return pages(spark, d).select("page_id", t.paragraphs(F.col("ocr_text")).alias("paragraphs"))


@query(f"select page_id, {_SOLID.format('ocr_text')} as ocr_solid, {_SOLID.format('translated_text')} as translated_solid from book_pages")
def nonspace_length(spark, d):
    return pages(spark, d).select("page_id", t.solid_length(F.col("ocr_text")).alias("ocr_solid"), t.solid_length(F.col("translated_text")).alias("translated_solid"))


_HTML = "'<p>'||replace(text, chr(10), '<br/>'||chr(10)||chr(10))||'</p> a<b & c>d'"


@query(
    f"with h as (select doc_id, regexp_replace(regexp_replace({ST.format(_HTML)},'(?i)<\\s*br\\s*/?>',chr(10),'g'),'<[^>]+>','','g') as h from documents where text is not null) select doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(h,'\\n\\s*\\n'), lambda b: {ST.format('b')}), lambda b: b <> ''), lambda b: replace(replace(replace(b,'&','&amp;'),'<','&lt;'),'>','&gt;')) as blocks from h"
)
def html_clean(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    h = F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("<br/>\n\n")), F.lit("</p> a<b & c>d"))
    return docs.select("doc_id", t.clean_html(h).alias("blocks"))


@query(
    "with recursive w as (select doc_id, cast(i as int) as i, l[i] as w from (select doc_id, list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x <> '') as l from documents where text is not null), lateral (select unnest(range(1,len(l)+1)) as i)), "
    "f as (select doc_id, i, 0 as line, length(w) as used from w where i = 1 union all select w.doc_id, w.i, f.line + case when f.used+1+length(w.w) <= 83 then 0 else 1 end, case when f.used+1+length(w.w) <= 83 then f.used+1+length(w.w) else length(w.w) end from f join w on w.doc_id=f.doc_id and w.i=f.i+1) "
    "select f.doc_id, line, string_agg(w.w,' ' order by w.i) as text from f join w on w.doc_id=f.doc_id and w.i=f.i group by 1,2"
)
def word_wrap(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(t.word_wrap(F.col("text"), 500.0, 10.0)).alias("line", "text"))


@query("select doc_id, cast(i as int) as piece, substring(text, i*80+1, 80) as chunk from documents, lateral (select unnest(range(0, cast(ceil(length(text)/80.0) as int))) as i)")
def fixed_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.fixed_chunks(F.col("text"))).alias("piece", "chunk"))


@query(
    "select doc_id, coalesce(len(regexp_extract_all(text,'[\\x{4E00}-\\x{9FFF}]')),0) as kanji, coalesce(len(regexp_extract_all(text,'[\\x{3040}-\\x{30FF}]')),0) as kana, cast(trunc(100.0*(coalesce(len(regexp_extract_all(text,'[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}]')),0))/greatest(1,length(text))) as int) as share, len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w <> '')) as words from documents where text is not null"
)
def script_stats(spark, d):
    c = F.col("text")
    n = lambda p: F.regexp_count(c, F.lit(p))
    return table(spark, d, "documents").filter("text is not null").select(
        "doc_id", n(r"[\x{4E00}-\x{9FFF}]").alias("kanji"), n(r"[\x{3040}-\x{30FF}]").alias("kana"), (n(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]") * 100.0 / F.greatest(F.lit(1), F.length(c))).cast("int").alias("share"),
        F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).alias("words"),
    )


@query(
    "select page_id, cast(coalesce(nullif(regexp_extract(lower(n),'page\\s*[-_]?\\s*(\\d{1,9})',1),''), nullif(regexp_extract(lower(n),'p\\s*[-_]?\\s*(\\d{1,9})',1),''), nullif(regexp_extract(lower(n),'[_-](\\d{1,9})\\.[a-z0-9]+$',1),''), nullif(regexp_extract(lower(n),'^(\\d{1,9})\\.[a-z0-9]+$',1),'')) as int) as name_number, cast(nullif(regexp_extract(ocr_text,'[-—]\\s*(\\d{1,3})\\s*[-—]',1),'') as int) as text_number from (select page_id, ocr_text, regexp_extract(original_image_path,'([^/]*)$',1) as n from book_pages)"
)
def page_numbers(spark, d):
    n = F.regexp_extract("original_image_path", "([^/]*)$", 1)
    return pages(spark, d).select("page_id", t.name_number(n).alias("name_number"), t.text_number(F.col("ocr_text")).alias("text_number"))


_RAW = "case event_id % 4 when 0 then '{{\"language\": \"'||event_type||'\", \"confidence\": '||(value/10)||'}} tail' when 1 then 'x \"language\": \"'||event_type||'\", \"confidence\": 0.75' when 2 then '{{\"language\": \"fr\"}}' else 'none' end".replace("{{", "{").replace("}}", "}")


@query("select event_id, case event_id % 4 when 2 then 'fr' when 3 then 'en' else event_type end as language, case event_id % 4 when 0 then greatest(0.0, least(1.0, value/10)) when 1 then 0.75 else 0.5 end as confidence from events")
def json_salvage(spark, d):
    raw = F.expr(_RAW.replace("||", " || ").replace("(value/10)", "cast(value/10 as string)"))
    lang, conf = t.salvage_json(raw)
    return table(spark, d, "events").select("event_id", lang.alias("language"), conf.alias("confidence"))


@query("with l as (select table_id, list(text order by row_idx, col_idx) as l from (select distinct * from table_cells) where text <> '' group by 1) select table_id, array_to_string(l[1:3],'; ')||case when len(l) > 3 then ' (+'||(len(l)-3)||' more)' else '' end as preview from l")
def issue_preview(spark, d):
    c = table(spark, d, "table_cells").dropDuplicates(["table_id", "cell_id"]).filter("text <> ''")
    g = c.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "text"))), lambda x: x["text"]).alias("l"))
    return g.select("table_id", t.preview(F.col("l")).alias("preview"))


@query("with s as (select page_id, error_message as e, status from book_pages) select page_id, substring(coalesce(e, case when status in ('FAILED','NEEDS_REVIEW') then 'pdf_creation failed' end, case when status='QUEUED' then 'Processing failed: late; slow; old' end, 'Unknown error'),1,500) as error from s")
def error_message(spark, d):
    step = F.struct(F.lit("pdf_creation").alias("name"), (~F.col("status").isin("FAILED", "NEEDS_REVIEW")).alias("success"), F.lit(None).cast("string").alias("error"))
    warn = F.when(F.col("status") == "QUEUED", F.array(*[F.lit(x) for x in ("late", "slow", "old", "more")])).otherwise(F.array().cast("array<string>"))
    return pages(spark, d).select("page_id", t.derive_error(F.coalesce("error_message", F.lit("Unknown error")), F.array(step), warn).alias("error"))


@query("with b as (select page_id, text, min(seq) as s from text_boxes where text is not null group by 1,2) select page_id, list(text order by s, text) as texts from b group by 1")
def ordered_dedup(spark, d):
    b = table(spark, d, "text_boxes").filter("text is not null")
    first = b.groupBy("page_id", "text").agg(F.min("seq").alias("s"))
    return first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "text"))), lambda x: x["text"]).alias("texts"))


@query("select artifact_id, printf('%.1f KB', round(length(body)/1024.0, 1)) as size, coalesce(body,'') = '' as empty from artifacts")
def size_format(spark, d):
    return table(spark, d, "artifacts").select("artifact_id", t.size_label(F.length("body")).alias("size"), (F.coalesce("body", F.lit("")) == "").alias("empty"))


#: Marks of statuses (fixed values).
MARKS = {"UPLOADED": "up", "QUEUED": "wait", "PROCESSING": "work", "COMPLETED": "ok", "FAILED": "bad", "NEEDS_REVIEW": "look"}


@query("select page_id, case status " + " ".join(f"when '{k}' then '{v}'" for k, v in MARKS.items()) + " else '?' end as mark from book_pages")
def status_marks(spark, d):
    m = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    return pages(spark, d).select("page_id", F.coalesce(F.try_element_at(m, F.col("status")), F.lit("?")).alias("mark"))


@query(f"select page_id, {ST.format('case when page_id % 3 = 0 then coalesce(ocr_text,' + chr(39) + chr(39) + ') else coalesce(translated_text,' + chr(39) + chr(39) + ') end')} as translation from book_pages")
def parse_bilingual(spark, d):
    both = t.format_bilingual(F.col("ocr_text"), F.col("translated_text"))
    content = F.when(F.col("page_id") % 3 == 0, F.coalesce("ocr_text", F.lit(""))).otherwise(both)
    return pages(spark, d).select("page_id", t.parse_bilingual(content).alias("translation"))


@query(f"select page_id, 'Translate from '||coalesce(p.source_language,'auto')||' to '||p.target_language||'.'||coalesce(' Book: '||nullif({ST.format('book_context')},'')||'.','')||chr(10)||chr(10)||coalesce(ocr_text,'') as prompt from book_pages join projects p using (project_id)")
def prompt_context(spark, d):
    p = table(spark, d, "projects").select("project_id", "source_language", "target_language", "book_context")
    return pages(spark, d).select("page_id", "project_id", "ocr_text").join(p, "project_id").select("page_id", t.prompt(F.col("ocr_text"), F.col("source_language"), F.col("target_language"), F.col("book_context")).alias("prompt"))


@query("select distinct box_id, case when coalesce(regexp_replace(text,'^\\s+|\\s+$','','g'),'')='' then '' else '[EN]'||text end as translated from text_boxes")
def translate_seam(spark, d):
    return s.translate_once(table(spark, d, "text_boxes").select("box_id", "text"), "text").select("box_id", "translated").distinct()


@query("with l as (select page_id, cast(row_number() over (partition by page_id order by i) - 1 as int) as part, x as label from (select page_id, unnest(l) as x, unnest(range(len(l))) as i from (select page_id, string_split(translated_text, chr(10)) as l from book_pages where translated_text is not null)) where x <> '') select * from l")
def extraction_seam(spark, d):
    """One row for each line of a translation that isn't empty: the extractor of the seam sees batches of pages."""

    def extract(f):
        for page, text in zip(f["page_id"], f["translated_text"], strict=True):
            yield from ((page, i, x) for i, x in enumerate(x for x in (text or "").split("\n") if x))

    return s.extract_rows(pages(spark, d).select("page_id", "translated_text"), extract, "page_id long, part int, label string")


@query("select page_id, '[EN]'||status as status, case when quality_level is not null then '[EN]'||quality_level end as level from book_pages where status is not null and trim(status) <> '' and (quality_level is null or trim(quality_level) <> '')")
def translate_labels(spark, d):
    """A map of labels with its values translated."""
    p = pages(spark, d).filter("status is not null and trim(status) <> '' and (quality_level is null or trim(quality_level) <> '')")
    maps = p.select("page_id", F.create_map(F.lit("status"), F.col("status"), F.lit("level"), F.col("quality_level")).alias("labels"))
    return s.translate_values(maps, "page_id", "labels").select("page_id", F.col("labels")["status"].alias("status"), F.col("labels")["level"].alias("level"))


@query("select page_id, substring(ocr_text, 1, 500) as ocr_preview, substring(translated_text, 1, 500) as translated_preview from book_pages")
def text_previews(spark, d):
    """The first 500 characters of both texts."""
    return pages(spark, d).select("page_id", F.substring("ocr_text", 1, 500).alias("ocr_preview"), F.substring("translated_text", 1, 500).alias("translated_preview"))


@query("select page_id, lower(regexp_replace(translated_text,'[^A-Za-z0-9]','','g')) as cleaned, length(translated_text) as n from book_pages where contains(lower(translated_text), 'relay')")
def ext_search(spark, d):
    """Extension: pages whose translation mentions a word, in any case."""
    return pages(spark, d).filter(F.lower("translated_text").contains("relay")).select("page_id", q.clean_label(F.col("translated_text")).alias("cleaned"), F.length("translated_text").alias("n"))
