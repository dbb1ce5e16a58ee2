"""Queries over the driver's tables, and their SQL.

The tables stand in for the engine's own relations, so that results can be
checked: documents for OCR pages, events for conversion jobs and uploads, labels
for sidecars, embeddings for boxes of points, and the star schema for file names
and for rows of generated HTML tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions import rules, text
from folioforge.operators import anchored, documents, elements, handlers, history, html_tables, intake, pdf_merge, results
from folioforge.session import shared_dir
from folioforge.sources import docx, docx_merge, pdf, sinks
from folioforge.sources.history_tree import read_tree
from folioforge.streaming.intake import drain, stream_intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


# --- history


def _event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history rows: errors are sidecars of the file of the same user, day and number; sign-ups are uploads."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("file"), (F.col("event_id") % 50).cast("string"), F.lit(".docx"))
    meta = F.col("event_type") == "error"
    rows = e.select(F.concat(F.lit("u"), _text("user_id")).alias("username"), text.day(F.col("ts")).alias("ymd"), F.when(meta, F.concat(name, F.lit(".meta"))).otherwise(name).alias("filename"), meta.alias("is_meta"), F.when(meta, F.concat(F.lit("scan"), (F.col("event_id") % 50).cast("string"), F.lit(".jpg"))).alias("meta_content"), F.when(F.col("event_type") == "signup", "uploads").otherwise("converted_files").alias("area"))
    return rows.distinct()


_EVENT_HISTORY = """h as (select distinct 'u' || user_id as username, strftime(ts, '%Y%m%d') as ymd,
  'file' || (event_id % 50) || '.docx' || case when event_type = 'error' then '.meta' else '' end as filename,
  event_type = 'error' as is_meta,
  case when event_type = 'error' then 'scan' || (event_id % 50) || '.jpg' end as meta_content,
  case when event_type = 'signup' then 'uploads' else 'converted_files' end as area from events)"""


@query("select distinct 'u' || user_id as username, strftime(ts, '%Y%m%d') as ymd from events")
def history_dates(spark, sf_dir):
    return history.dates(_event_history(spark, sf_dir))


@query(f"""with {_EVENT_HISTORY}
select f.username, f.ymd, coalesce(m.meta_content, replace(f.filename, '.docx', '')) as original_name, f.filename as converted_name,
  '/media/his_pic/' || f.username || '/' || f.ymd || '/converted_files/' || f.filename as download_url, '已完成' as status
from h f left join h m on m.is_meta and m.username = f.username and m.ymd = f.ymd and m.filename = f.filename || '.meta'
where not f.is_meta and f.area = 'converted_files'""")
def history_listing(spark, sf_dir):
    return history.listing(_event_history(spark, sf_dir))


@query(f"""with {_EVENT_HISTORY}, s as (select username, max(ymd) as ymd from h where area = 'converted_files' group by 1)
select f.username, f.ymd, coalesce(m.meta_content, replace(f.filename, '.docx', '')) as original_name, f.filename as converted_name
from h f join s using (username, ymd) left join h m on m.is_meta and m.username = f.username and m.ymd = f.ymd and m.filename = f.filename || '.meta'
where not f.is_meta and f.area = 'converted_files'""")
def history_selected(spark, sf_dir):
    """The listing of one selected date of each user, the newest with outputs."""
    rows = _event_history(spark, sf_dir)
    newest = rows.where(F.col("area") == history.OUTPUTS).groupBy("username").agg(F.max("ymd").alias("ymd"))
    return history.listing(rows, newest).select("username", "ymd", "original_name", "converted_name")


@query(f"""with {_EVENT_HISTORY}, d as (select username, ymd, filename from h where not is_meta and filename like 'file1%')
select username, ymd, filename, is_meta, area from h
where area = 'uploads' or not exists (select 1 from d where d.username = h.username and d.ymd = h.ymd and h.filename in (d.filename, d.filename || '.meta'))""")
def history_delete(spark, sf_dir):
    rows = _event_history(spark, sf_dir)
    gone = rows.where("not is_meta and filename like 'file1%'")
    return history.delete_outputs(rows, gone).select("username", "ymd", "filename", "is_meta", "area")


@query(f"""with {_EVENT_HISTORY} select username, ymd, count(*) as n_files from h where username <> 'u7' group by 1, 2""")
def user_cascade(spark, sf_dir):
    rows = _event_history(spark, sf_dir)
    users = rows.select("username").distinct()
    _, kept = history.delete_user(users, rows, "u7", "u1")
    return kept.groupBy("username", "ymd").agg(F.count("*").alias("n_files"))


@query("""select 'u' || s_nationkey as username, cast(20240101 + s_suppkey % 5 as varchar) as ymd, 's' || s_suppkey || '.docx' || case when m then '.meta' else '' end as filename, case when m then s_name end as meta_content
from supplier, (values (false), (true)) x(m) where s_nationkey in (1, 2, 3) and s_suppkey % 5 = 2 and (not m or s_suppkey % 3 = 0)""")
def history_tree(spark, sf_dir):
    """Suppliers as files of users' dates, some with a sidecar, written as a tree of which one date of three users is listed."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("u"), _text("s_nationkey"), F.lit("/"), (20240101 + F.col("s_suppkey") % 5).cast("string"), F.lit("/converted_files/s"), _text("s_suppkey"), F.lit(".docx"))
    files = s.select(name.alias("name"), F.lit(b"x").alias("content"))
    metas = s.where("s_suppkey % 3 = 0").select(F.concat(name, F.lit(".meta")).alias("name"), F.col("s_name").cast("binary").alias("content"))
    folder = shared_dir(spark).removeprefix("file://")
    sinks.write_files(files.union(metas), folder)
    found = read_tree(spark, folder).where("username in ('u1', 'u2', 'u3') and ymd = '20240103' and area = 'converted_files'")
    return found.select("username", "ymd", "filename", "meta_content")


@query(f"""with {_EVENT_HISTORY} select username, ymd, filename from (select *, row_number() over (partition by username order by ymd desc, filename) as r from h) where r = 1""")
def history_latest(spark, sf_dir):
    return history.latest(_event_history(spark, sf_dir)).select("username", "ymd", "filename")


@query("""select c_custkey as id, c_name as username, case when c_mktsegment = 'BUILDING' then 'N/A' else lower(c_mktsegment) || '@example.com' end as email,
  case when c_nationkey = 0 then '是' else '否' end as superuser, c_nationkey <> 0 as has_delete_link from customer""")
def user_listing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    email = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat(F.lower("c_mktsegment"), F.lit("@example.com")))
    return history.user_listing(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), email.alias("email"), (F.col("c_nationkey") == 0).alias("is_superuser")))


@query("""select event_id, case when event_id % 5 = 0 then 'N/A' else 'f' || event_id end as original_name,
  case when event_id % 3 = 0 then 'm' || event_id else event_type end as shown,
  cast(null as varchar) as link from events where event_type <> 'view'
union all select event_id, case when event_id % 5 = 0 then 'N/A' else 'f' || event_id end, case when event_id % 3 = 0 then 'm' || event_id else 'success' end,
  case when event_id % 2 = 0 then '/media/' || event_id end from events where event_type = 'view'""")
def client_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("f"), _text("event_id"))).alias("original_name"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("m"), _text("event_id"))).alias("message"),
        F.when(F.col("event_type") == "view", "success").otherwise(F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/media/"), _text("event_id"))).otherwise("").alias("download_url"),
    )
    return history.client_rows(rows, "event_id")


# --- text


@query(r"""select doc_id, i - 1 as para_idx, ps[i] as paragraph from (
  select doc_id, case when len(p) > 0 then p else [text] end as ps from (
    select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as p from documents)) s, range(1, len(ps) + 1) t(i)""")
def segment_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.segment_text(F.col("text"))).alias("para_idx", "paragraph"))


@query("""select lang, sum(case when len(p) > 0 then len(p) else 1 end) as n_paragraphs, count(*) as n_pages from (
  select lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as p from documents) group by lang""")
def paragraph_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(text.segment_text(F.col("text")))).alias("n_paragraphs"), F.count("*").alias("n_pages"))


@query("""select c_nationkey as folder, 'IMG' || c_custkey || '.jpg' as path, row_number() over (partition by c_nationkey order by c_custkey) - 1 as page_seq from customer
union all select -1, 'Page' || repeat('9', 40 + p_partkey % 3) || translate(cast(p_partkey as varchar), '0123456789', '٠١٢٣٤٥٦٧٨٩') || '.jpg', row_number() over (order by p_partkey % 3 + length(cast(p_partkey as varchar)), repeat('9', 40 + p_partkey % 3) || p_partkey) - 1 from part""")
def natural_order(spark, sf_dir):
    """Customers' images by folder; and one folder of parts whose numbers have more than 40 digits, some of them in another script."""
    from folioforge.sources.files import in_natural_order

    files = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("folder"), F.concat(F.lit("IMG"), _text("c_custkey"), F.lit(".jpg")).alias("path"))
    long = F.concat(F.lit("Page"), F.repeat(F.lit("9"), (F.lit(40) + F.col("p_partkey") % 3).cast("int")), F.translate(_text("p_partkey"), "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit(".jpg"))
    parts = table(spark, sf_dir, "part").select(F.lit(-1).cast("long").alias("folder"), long.alias("path"))
    return in_natural_order(files.union(parts), ["folder"]).select("folder", "path", "page_seq")


@query(r"""select url, regexp_extract(url, '[^/]*$') as base, case when regexp_extract(url, '[^/]*$') like '_%.%' then regexp_replace(url, '\.[^./]*$', '') else url end as stem,
  case when regexp_extract(url, '[^/]*$') like '_%.%' then regexp_replace(url, '\.[^./]*$', '') else url end || '.pdf' as as_pdf,
  '/media/' || url as link from pages""")
def file_name_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("url", text.basename(url).alias("base"), text.stem(url).alias("stem"), text.with_suffix(url, ".pdf").alias("as_pdf"), text.media_url(url).alias("link"))


@query("""select p_partkey, p_name, regexp_full_match(replace(p_name, ' ', ''), '[a-zA-Z0-9]+') and length(replace(p_name, ' ', '')) <= 10 as valid_username,
  regexp_full_match(p_brand, '[a-zA-Z0-9]+') and length(p_brand) between 8 and 10 as valid_brand_password,
  not (p_name <> '' and p_type <> '' and p_name <> p_type) as agree from part""")
def username_rule(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    squeezed = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    return p.select("p_partkey", "p_name", rules.valid_username(squeezed).alias("valid_username"), rules.valid_password(F.col("p_brand")).alias("valid_brand_password"), rules.passwords_agree(F.col("p_name"), F.col("p_type")).alias("agree"))


@query("""select a.s_suppkey as requester, b.s_suppkey as target, a.s_nationkey % 2 = 0 and a.s_suppkey <> b.s_suppkey as may_delete, b.s_nationkey % 2 <> 0 as link
from supplier a join supplier b on b.s_suppkey = a.s_suppkey - a.s_suppkey % 3""")
def delete_rules(spark, sf_dir):
    """Requests: each supplier asks to delete one, every third one itself; those of even nations are superusers."""
    s = table(spark, sf_dir, "supplier")
    requests = s.select(F.col("s_suppkey").alias("requester"), (F.col("s_nationkey") % 2 == 0).alias("asks"), (F.col("s_suppkey") - F.col("s_suppkey") % 3).alias("target"))
    targets = s.select(F.col("s_suppkey").alias("target"), (F.col("s_nationkey") % 2 == 0).alias("is_superuser"))
    return requests.join(targets, "target").select("requester", "target", rules.may_delete(F.col("requester"), F.col("asks"), F.col("target")).alias("may_delete"), rules.shows_delete_link(F.col("is_superuser")).alias("link"))


@query("""select p_partkey, 'a/b/' || p_name || '/' || p_brand as path, p_size % 3 = 0 as agreed from part""")
def path_rules(spark, sf_dir):
    """Parts joined to paths whatever their slashes; only the word true, in any case, is true."""
    p = table(spark, sf_dir, "part")
    said = F.element_at(F.array(F.lit("True"), F.lit("yes"), F.lit("")), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select("p_partkey", text.join_path(F.lit("a\\b"), F.col("p_name"), F.col("p_brand")).alias("path"), text.is_true(said).alias("agreed"))


@query(r"""select conv_id, coalesce(nullif(string_agg(text, chr(10) order by turn, text), ''), 'No text detected in this image.') as text from conversations group by conv_id""")
def legacy_texts(spark, sf_dir):
    """Conversations as pages whose lines are their turns."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(elements.legacy_text(lines).alias("text"))


# --- pages and elements


def _document_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as pages of one plain text element each."""
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("page_seq"), F.concat(F.lit("doc"), _text("doc_id"), F.lit(".jpg")).alias("filename"))
    null = lambda t: F.lit(None).cast(t)
    found = d.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("elem_idx"), null("string").alias("kind"), "text", null("string").alias("html"), null("array<string>").alias("lines"))
    return pages, found


@query(r"""with p as (select doc_id, case when len(q) > 0 then q else [text] end as ps from (
    select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as q from documents where regexp_matches(text, '\S'))),
b as (select doc_id, i as block_seq, 'paragraph' as kind, ps[i] as text from p, range(1, len(ps) + 1) t(i)
  union all select doc_id, 0, 'heading', 'Content from doc' || doc_id || '.jpg' from documents)
select doc_id as page_id, cast(block_seq as bigint) as block_seq, kind, text from b
union all select b.doc_id, max(b.block_seq) + 1, 'page_break', null from b where b.doc_id < (select max(doc_id) from documents) group by b.doc_id""")
def page_blocks(spark, sf_dir):
    """Every document's text as blocks; a page with an element, if only a blank one, has no placeholder."""
    pages, found = _document_pages(spark, sf_dir)
    return elements.blocks(pages, found).select("page_id", F.col("block_seq").cast("long").alias("block_seq"), "kind", "text")


@query(r"""with d as (select d.doc_id, text, l.doc_id is not null and coalesce(regexp_matches(text, '\S'), false) as filled from documents d left join labels l on l.doc_id = d.doc_id),
p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ps from d where filled),
b as (select doc_id, i as block_seq, 'paragraph' as kind, ps[i] as text from p, range(1, len(ps) + 1) t(i)
  union all select doc_id, 1, 'paragraph', '[No content could be extracted from doc' || doc_id || '.jpg]' || chr(10) from d where not filled
  union all select doc_id, 0, 'heading', 'Content from doc' || doc_id || '.jpg' from d)
select doc_id as page_id, cast(block_seq as bigint) as block_seq, kind, text from b
union all select b.doc_id, max(b.block_seq) + 1, 'page_break', null from b where b.doc_id < (select max(doc_id) from documents) group by b.doc_id""")
def document_blocks(spark, sf_dir):
    """The blocks of every document; the engine found nothing on those without a label, or with a blank text."""
    pages, _ = _document_pages(spark, sf_dir)
    null = lambda t: F.lit(None).cast(t)
    read = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    filled = read.where(~F.coalesce(text.is_blank(F.col("text")), F.lit(True)))
    found = filled.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("elem_idx"), null("string").alias("kind"), "text", null("string").alias("html"), null("array<string>").alias("lines"))
    return elements.blocks(pages, found).select("page_id", F.col("block_seq").cast("long").alias("block_seq"), "kind", "text")


@query("""select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as block_seq, 'paragraph' as kind, text from conversations""")
def document_files(spark, sf_dir):
    """Conversations written as one document file each, a paragraph a turn, and read back from the files."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_seq"), F.lit("paragraph").alias("kind"), "text")
    folder = shared_dir(spark).removeprefix("file://")
    sinks.write_documents(rows, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    found = docx.parse(files.select("path", "content"))
    doc_id = F.regexp_extract("path", "([0-9]+)[.]docx$", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), F.col("block_seq").cast("long").alias("block_seq"), "kind", "text")


@query("""select doc_id as page_id, '[No content could be extracted from doc' || doc_id || '.jpg]' || chr(10) as text from documents d
where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def empty_page_placeholder(spark, sf_dir):
    pages, _ = _document_pages(spark, sf_dir)
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("elem_idx"), F.lit("title").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("array<string>").alias("lines"))
    return elements.blocks(pages, found, single=True).where("kind = 'paragraph'").select("page_id", "text")


@query("""select event_id, page_id, kind, is_table, has_table as page_has_table, case when has_table then null when kind = 'text' then 'line a' || chr(10) || 'line ' || event_id when kind is null then 'plain ' || event_id end as body
from (select *, bool_or(is_table) over (partition by page_id) as has_table from (
  select event_id, cast(user_id as varchar) || '-' || (event_id // 500) as page_id,
    case event_type when 'click' then 'Table' when 'view' then 'text' when 'signup' then 'title' when 'purchase' then 'figure' end as kind,
    event_type = 'click' and event_id % 4 = 0 as is_table from events))""")
def element_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "Table").when(F.col("event_type") == "view", "text").when(F.col("event_type") == "signup", "title").when(F.col("event_type") == "purchase", "figure")
    found = e.select("event_id", F.concat_ws("-", _text("user_id"), F.floor(F.col("event_id") / 500).cast("string")).alias("page_id"), F.col("event_id").cast("int").alias("elem_idx"), kind.alias("kind"), F.when(F.col("event_type") == "error", F.concat(F.lit("plain "), _text("event_id"))).alias("text"), F.when(F.col("event_id") % 4 == 0, "<table></table>").otherwise("").alias("html"), F.array(F.lit("line a"), F.concat(F.lit("line "), _text("event_id"))).alias("lines"))
    gated = elements.gate(found)
    return gated.select("event_id", "page_id", "kind", "is_table", "page_has_table", "body")


@query("""select vec_id as page_id, elem_idx, rank from (select vec_id, elem_idx, row_number() over (partition by vec_id order by mean_y, elem_idx) as rank from (
  select vec_id, i as elem_idx, round((cast(embedding[8*i+2] as double) + cast(embedding[8*i+4] as double) + cast(embedding[8*i+6] as double) + cast(embedding[8*i+8] as double)) / 4, 9) as mean_y
  from embeddings, range(0, 8) t(i))) where rank <= 2""")
def top2_by_y(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("elem_idx"), F.col("embedding").cast("array<double>").alias("v"))
    point = lambda k: F.struct(F.element_at("v", (8 * F.col("elem_idx") + 2 * k + 1).cast("int")).alias("x"), F.element_at("v", (8 * F.col("elem_idx") + 2 * k + 2).cast("int")).alias("y"))
    boxes = e.withColumn("box", F.array(*map(point, range(4)))).withColumn("mean_y", F.round(elements.mean_y(F.col("box")), 9))
    return elements.top_by_y(boxes).select("page_id", "elem_idx", "rank")


_SPEC = anchored.Anchored(labels=("the", "de", "und"), width=5, end_marker="of", headers=(("", "a", "a", "b", "b"), ("k", "v", "w", "v", "w")))


def _words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", " ").alias("texts"))


@query("""select page_id, cast(row_number() over (partition by page_id order by label_idx) + 1 as integer) as table_row, label, idx, list_resize(ts[idx + 1 : idx + 5], 5, '') as cells from (
  select page_id, ts, label_idx, label, list_position(ts, label) - 1 as idx from (select doc_id as page_id, string_split(text, ' ') as ts from documents) d, (values (0, 'the'), (1, 'de'), (2, 'und')) l(label_idx, label))
where idx >= 0""")
def anchor_slice(spark, sf_dir):
    return anchored.anchored_rows(_words(spark, sf_dir), _SPEC).select("page_id", F.col("table_row").cast("int").alias("table_row"), "label", "idx", "cells")


@query("""select page_id, len(ts) - 1 - last as n_texts, last + 1 as first_idx from (
  select page_id, ts, case when list_position(ts, 'of') > 0 then list_position(ts, 'of') - 1 else greatest(
    case when list_position(ts, 'the') > 0 then list_position(ts, 'the') + 4 else -1 end, case when list_position(ts, 'de') > 0 then list_position(ts, 'de') + 4 else -1 end,
    case when list_position(ts, 'und') > 0 then list_position(ts, 'und') + 4 else -1 end, -1) end as last
  from (select doc_id as page_id, string_split(text, ' ') as ts from documents)) where len(ts) - 1 > last""")
def anchor_tail(spark, sf_dir):
    tail = anchored.anchored_tail(_words(spark, sf_dir), _SPEC)
    return tail.groupBy("page_id").agg(F.count("*").alias("n_texts"), F.min("elem_idx").cast("long").alias("first_idx"))


@query("""select p_partkey as page_id, p_name as filename, case when p_name in ('small ring', 'red widget', 'blue bolt') then 'anchored' else 'generic' end as handler from part""")
def handler_dispatch(spark, sf_dir):
    handlers = spark.createDataFrame([(n, "anchored") for n in ("small ring", "red widget", "blue bolt")], "filename string, handler string")
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("filename"))
    return anchored.dispatch(pages, handlers).select("page_id", "filename", "handler")


@query("""select conv_id as page_id, 0 as sub, 'paragraph' as kind, count(*) || ' turns' as text from conversations where conv_id % 3 = 1 group by conv_id
union all select conv_id, 1, 'paragraph', arg_max(text, turn) from conversations where conv_id % 3 = 1 group by conv_id
union all select conv_id, n, 'paragraph', 'c2' from (select distinct conv_id from conversations where conv_id % 3 = 2), range(0, 2) t(n)""")
def handled_pages(spark, sf_dir):
    """Conversations as pages of three files, two of which have a handler of their own."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"), F.lit(".jpg")).alias("filename")).distinct()
    found = c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("elem_idx"), "text")
    counted = lambda page: [("paragraph", f"{len(page)} turns"), ("paragraph", page[-1]["text"])]
    named = lambda page: [("paragraph", page[0]["filename"][:2])] * 2
    return handlers.handled_blocks(found, pages, {"c1.jpg": counted, "c2.jpg": named}).select("page_id", F.col("sub").cast("long").alias("sub"), "kind", "text")


# --- HTML tables


def _nation_tables(spark, sf_dir) -> DataFrame:
    """One table for each region: its number, spanning all rows, before each nation's number and name."""
    n = table(spark, sf_dir, "nation")
    cell = F.concat(F.lit("<td>"), _text("n_nationkey"), F.lit("</td><td> "), F.col("n_name"), F.lit(" </td>"))
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("o"), cell.alias("c")))).alias("rows"))
    first = F.concat(F.lit('<td rowspan="'), F.size("rows").cast("string"), F.lit('">R'), _text("n_regionkey"), F.lit("</td>"))
    body = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), r["c"], F.lit("</tr>"))), "")
    return rows.select("n_regionkey", F.concat(F.lit("<p>x</p><table>"), body, F.lit("</table>")).alias("html"))


@query("select n_regionkey, n_nationkey, n_name from nation")
def html_roundtrip(spark, sf_dir):
    cells = html_tables.html_cells(_nation_tables(spark, sf_dir)).where("not is_placeholder")
    rows = cells.groupBy("n_regionkey", "table_row").agg(F.max(F.when(F.col("col") == 1, F.col("text"))).cast("int").alias("n_nationkey"), F.max(F.when(F.col("col") == 2, F.col("text"))).alias("n_name"))
    return rows.select("n_regionkey", "n_nationkey", "n_name")


_GRID = """r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as k, count(*) over (partition by n_regionkey) as n from nation)"""


@query(f"""with {_GRID} select n_regionkey, k as table_row, 0 as col, case when k = 0 then 'R' || n_regionkey end as text, k > 0 as is_placeholder from r
union all select n_regionkey, k, 1, cast(n_nationkey as varchar), false from r union all select n_regionkey, k, 2, n_name, false from r""")
def html_grid_rowspan(spark, sf_dir):
    return html_tables.slots(html_tables.html_cells(_nation_tables(spark, sf_dir))).select("n_regionkey", "table_row", "col", "text", "is_placeholder")


@query(f"""with {_GRID} select n_regionkey, k as table_row, case when k = 0 then 1 else 0 end as write_col, cast(n_nationkey as varchar) as text, true as same from r
union all select n_regionkey, k, case when k = 0 then 2 else 1 end, n_name, true from r union all select n_regionkey, k, 0, 'R' || n_regionkey, true from r where k = 0""")
def html_write_cursor(spark, sf_dir):
    cells = html_tables.write_cursor(html_tables.html_cells(_nation_tables(spark, sf_dir)), "n_regionkey")
    return cells.select("n_regionkey", "table_row", F.col("cursor").alias("write_col"), "text", (F.col("cursor") == F.col("write_col")).alias("same"))


@query("""select s_nationkey, count(*) as n_rows, max(1 + s_suppkey % 3 + 1) as max_cols from supplier group by 1""")
def html_table_dims(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cell = F.concat(F.lit('<tr><td colspan="'), (1 + F.col("s_suppkey") % 3).cast("string"), F.lit('">'), F.col("s_name"), F.lit("</td><td>"), _text("s_acctbal"), F.lit("</td></tr>"))
    rows = s.groupBy("s_nationkey").agg(F.concat(F.lit("<table>"), F.array_join(F.sort_array(F.collect_list(cell)), ""), F.lit("</table>")).alias("html"))
    return html_tables.table_dims(html_tables.html_cells(rows), "s_nationkey")


@query("""select r_regionkey, 1 as n, 'Row 1: ' || r_name || ', x y' as text from region where r_regionkey % 3 = 0
union all select r_regionkey, 0, '[Empty Table]' from region where r_regionkey % 3 = 1
union all select r_regionkey, 0, '[Warning: Could not find table structure in provided HTML]' from region where r_regionkey % 3 = 2""")
def html_row_fallback(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    flat = F.concat(F.lit('<table><tr><td colspan="0">'), F.col("r_name"), F.lit('</td><td colspan="0">x<br> y</td></tr></table>'))
    html = F.when(F.col("r_regionkey") % 3 == 0, flat).when(F.col("r_regionkey") % 3 == 1, "<table></table>").otherwise("<p>none</p>")
    return html_tables.fallback_paragraphs(html_tables.html_cells(r.select("r_regionkey", html.alias("html"))), "r_regionkey")


@query("""select n_nationkey, r as table_row, c as col, t as text, b as merge_in_bounds from (
  select n_nationkey, 0 as r, 0 as c, 'R' as t, n_nationkey % 2 = 0 as b from nation union all select n_nationkey, 0, 1, n_name, true from nation
  union all select n_nationkey, 1, 1, 'x' || n_nationkey, true from nation union all select n_nationkey, 1, null, 'lost', true from nation)""")
def html_overflow(spark, sf_dir):
    """A first column that spans two rows, or one more than there are, pushes the last cell out of the table."""
    n = table(spark, sf_dir, "nation")
    rows = F.when(F.col("n_nationkey") % 2 == 0, "2").otherwise("3")
    html = F.concat(F.lit('<table><tr><td rowspan="'), rows, F.lit('">R<td>'), F.col("n_name"), F.lit("</tr><tr><td>x"), _text("n_nationkey"), F.lit("<td>lost</table>"))
    cells = html_tables.html_cells(n.select("n_nationkey", html.alias("html"))).where("not is_placeholder")
    return cells.select("n_nationkey", "table_row", "col", "text", "merge_in_bounds")


@query("""select p_partkey, i as ord, case i when 0 then case when s < 0 then 0 when s is null then 1 else s end else 1 end as colspan, i = 0 and (s is null or s < 0) as attr_error from (
  select p_partkey, case when p_size % 7 = 0 then null else p_size % 7 - 3 end as s from part), range(0, 2) t(i)""")
def html_spans(spark, sf_dir):
    """Spans that are numbers, below zero, or no numbers at all."""
    p = table(spark, sf_dir, "part")
    span = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x"), F.col("p_brand"))).otherwise((F.col("p_size") % 7 - 3).cast("string"))
    html = F.concat(F.lit('<table><tr><td colspan="'), span, F.lit('">'), F.col("p_name"), F.lit("</td><td>y</td></tr></table>"))
    cells = html_tables.html_cells(p.select("p_partkey", html.alias("html"))).where("not is_placeholder")
    return cells.select("p_partkey", F.col("ord").cast("long").alias("ord"), F.col("colspan"), "attr_error")


@query(f"""with {_GRID}, b as (
  select n_regionkey as r, 1 as p, 'table' as kind, '' as text, count(*) as n_rows, 3 as n_cols, string_agg(case when k = 0 then k || ',0,R' || n_regionkey || ',' || n || ';' else '' end || k || ',1,' || n_nationkey || ',1;' || k || ',2,' || n_name || ',1', ';' order by k) as cells from r group by 1
  union all select r_regionkey, 0, 'heading', 'Content from r' || r_regionkey || '.jpg', null, null, null from region
  union all select r_regionkey, 2, 'blank', '', null, null, null from region
  union all select r_regionkey, 3, 'paragraph', case when r_regionkey % 2 = 0 then '[Empty Table]' else 'Row 1: ' || r_name end, null, null, null from region
  union all select r_regionkey, 4, 'blank', '', null, null, null from region
  union all select r_regionkey, 5, 'page_break', null, null, null, null from region where r_regionkey < 3)
select cast(r % 2 as bigint) as doc_id, row_number() over (partition by r % 2 order by r, p) - 1 as block_seq, kind, text, cast(n_rows as integer) as n_rows, cast(n_cols as integer) as n_cols, cells from b""")
def table_blocks(spark, sf_dir):
    """Regions as pages of two documents, each with the table of its nations and one without a grid."""
    r = table(spark, sf_dir, "region")
    pages = r.select((F.col("r_regionkey") % 2).cast("long").alias("doc_id"), F.col("r_regionkey").alias("page_id"), F.col("r_regionkey").alias("page_seq"), F.concat(F.lit("r"), _text("r_regionkey"), F.lit(".jpg")).alias("filename"))
    flat = F.when(F.col("r_regionkey") % 2 == 0, "<table></table>").otherwise(F.concat(F.lit('<table><tr><td colspan="0">'), F.col("r_name"), F.lit("</table>")))
    html = _nation_tables(spark, sf_dir).select(F.col("n_regionkey").alias("page_id"), F.lit(0).alias("elem_idx"), "html").unionByName(r.select(F.col("r_regionkey").alias("page_id"), F.lit(1).alias("elem_idx"), flat.alias("html")))
    found = html.select("page_id", "elem_idx", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), "html", F.lit(None).cast("array<string>").alias("lines"))
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(",", c["row"], c["col"], c["text"], c["rowspan"])), ";")
    out = documents.document_blocks(pages, found)
    return out.select("doc_id", F.col("block_seq").cast("long").alias("block_seq"), "kind", "text", "n_rows", "n_cols", cells.alias("cells"))


# --- intake, routes and results


@query("""select user_id, event_id, name, size_mb, row_number() over (partition by user_id order by event_id) as slot from (
  select user_id, event_id, event_type || (event_id % 40) as name, round(value, 2) as size_mb, row_number() over (partition by user_id, event_type || (event_id % 40) order by event_id) as r
  from events where value <= 10) where r = 1 qualify slot <= 10""")
def upload_intake(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    files = e.select("user_id", F.col("event_id").alias("file_seq"), F.concat(F.col("event_type"), (F.col("event_id") % 40).cast("string")).alias("name"), (F.col("value") * 1048576).alias("size"))
    taken = intake.intake(files, "user_id")
    return taken.select("user_id", F.col("file_seq").alias("event_id"), "name", text.megabytes(F.col("size")).alias("size_mb"), F.col("slot").cast("long").alias("slot"))


@query("""select user_id, event_id, name, size_mb, row_number() over (partition by user_id order by event_id) as slot from (
  select user_id, event_id, event_type || (event_id % 40) as name, round(value, 2) as size_mb, row_number() over (partition by user_id, event_type || (event_id % 40) order by event_id) as r
  from events where value <= 10) where r = 1 qualify slot <= 10""")
def upload_stream(spark, sf_dir):
    """The intake of the same uploads read as a stream, with state by user."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    files = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("file_seq"), F.concat(F.col("event_type"), (F.col("event_id") % 40).cast("string")).alias("name"), (F.col("value") * 1048576).alias("size"))
    out, state = shared_dir(spark), shared_dir(spark)
    drain(stream_intake(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    taken = spark.read.parquet(out)
    return taken.select(F.col("job_id").alias("user_id"), F.col("file_seq").alias("event_id"), "name", text.megabytes(F.col("size")).alias("size_mb"), F.col("slot").cast("long").alias("slot"))


_NAMES = "(values (0, '.jpg'), (1, '.DOCX'), (2, '.ppt'), (3, '.txt'), (4, '.pdf'), (5, '.xls'), (6, '')) x(k, ext)"
_EXTS = (".jpg", ".DOCX", ".ppt", ".txt", ".pdf", ".xls", "")
_TABS = ("imgToWord", "wordToPdf", "pptToPdf", "txtToPdf", "pdfToImg")


def _named_parts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    sub = F.element_at(F.array(*map(F.lit, _TABS)), (F.floor(F.col("p_partkey") / 7) % 5 + 1).cast("int"))
    main = F.when(sub == "imgToWord", "imgToFile").when(sub == "pdfToImg", "pdfToFile").otherwise("fileToPdf")
    status = F.when(F.col("p_size") > 45, "upload_error").otherwise("uploaded")
    return p.select("p_partkey", F.concat(F.lit("part"), _text("p_partkey"), ext).alias("name"), main.alias("main_tab"), sub.alias("sub_tab"), status.alias("status"))


_PARTS = f"""p as (select p_partkey, 'part' || p_partkey || ext as name, lower(ext) as ext, p_size, ['imgToWord', 'wordToPdf', 'pptToPdf', 'txtToPdf', 'pdfToImg'][((p_partkey // 7) % 5) + 1] as sub_tab
  from part join {_NAMES} on k = p_partkey % 7)"""


@query(f"""with {_PARTS} select p_partkey, name, sub_tab from p where (sub_tab = 'imgToWord' and ext = '.jpg') or (sub_tab = 'wordToPdf' and ext = '.docx') or (sub_tab = 'pptToPdf' and ext = '.ppt')
  or (sub_tab = 'txtToPdf' and ext = '.txt') or (sub_tab = 'pdfToImg' and ext = '.pdf')""")
def accept_types(spark, sf_dir):
    return intake.accepted(_named_parts(spark, sf_dir), intake.accepted_types(spark)).select("p_partkey", "name", "sub_tab")


@query(f"""with {_PARTS} select p_partkey, sub_tab, 'error' as status, '未实现的处理类型。' as message from p where sub_tab in ('txtToPdf', 'pdfToImg')""")
def route_lookup(spark, sf_dir):
    return intake.unrouted(_named_parts(spark, sf_dir), intake.routes(spark)).select("p_partkey", "sub_tab", "status", "message")


@query(f"""with {_PARTS} select p_partkey, name, case when p_size > 45 then 'upload_error' when sub_tab = 'wordToPdf' and ext <> '.docx' or sub_tab = 'pptToPdf' and ext <> '.ppt' then 'error' else 'ready' end as outcome from p""")
def route_errors(spark, sf_dir):
    return intake.route_results(_named_parts(spark, sf_dir)).select("p_partkey", "name", "outcome")


@query(f"""with {_PARTS} select p_partkey, case sub_tab when 'wordToPdf' then 'part' || p_partkey || '_prePdf.docx' when 'pptToPdf' then 'part' || p_partkey || '_prePdf.ppt' else name end as path, name as original_name, 'part' || p_partkey as base_filename_no_ext
from p where p_size <= 45 and not (sub_tab = 'wordToPdf' and ext <> '.docx' or sub_tab = 'pptToPdf' and ext <> '.ppt')""")
def prepared_files(spark, sf_dir):
    return intake.prepared(_named_parts(spark, sf_dir)).select("p_partkey", "path", "original_name", "base_filename_no_ext")


def _event_files(spark, sf_dir) -> DataFrame:
    """Events as files of the job of one user and day; purchases fail to convert, errors fail to upload."""
    e = table(spark, sf_dir, "events")
    job = F.concat_ws("/", _text("user_id"), text.day(F.col("ts")))
    return e.select(job.alias("job_id"), F.col("event_id").alias("file_seq"), F.concat(F.col("event_type"), F.lit("-"), _text("event_id"), F.lit(".ppt")).alias("name"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0)).alias("failed"), (F.col("event_type") == "error").alias("upload_error"))


_FILES = """f as (select user_id || '/' || strftime(ts, '%Y%m%d') as job_id, event_id as file_seq, event_type || '-' || event_id || '.ppt' as name,
  event_type = 'purchase' and event_id % 4 = 0 as failed, event_type = 'error' as upload_error from events)"""


@query("""select 'u' || user_id as username, strftime(ts, '%Y%m%d') as ymd, string_agg('n' || event_id, ',' order by event_id) as names, 'u' || user_id || '_' || strftime(ts, '%Y%m%d') || '_' || substr(sha256('u' || user_id || strftime(ts, '%Y%m%d')), 1, 8) as merged_name
from events group by user_id, strftime(ts, '%Y%m%d')""")
def merge_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), _text("user_id")).alias("username"), text.day(F.col("ts")).alias("ymd"), "event_id")
    names = e.groupBy("username", "ymd").agg(text.ordered_join(F.col("event_id"), F.concat(F.lit("n"), _text("event_id"))).alias("names"))
    return names.withColumn("merged_name", results.merged_name(F.col("username"), F.col("ymd"), F.concat("username", "ymd")))


@query(f"""with {_FILES}, t as (select job_id, bool_or(failed) as bad, string_agg(name, ',' order by file_seq) as names, count(*) filter (where upload_error) as hidden from f group by job_id),
s as (select *, coalesce(max(cast(failed as int)) over (partition by job_id order by file_seq rows between unbounded preceding and 1 preceding), 0) as stop from f)
select job_id, null as file_seq, names as original_name, 'success' as status, hidden as hidden_errors from t where not bad
union all select s.job_id, s.file_seq, s.name, case when failed then 'conversion_error' when upload_error then 'upload_error' else 'success' end, 0 from s join t using (job_id) where t.bad and stop = 0""")
def merge_results(spark, sf_dir):
    return results.merged_results(_event_files(spark, sf_dir))


@query(f"""with {_FILES} select job_id, file_seq, case when upload_error then 'conversion_error' else 'success' end as status from f
union all select job_id, file_seq, 'conversion_error_fallback' from f where failed and not upload_error""")
def individual_results(spark, sf_dir):
    files = _event_files(spark, sf_dir).withColumnsRenamed({"failed": "pdf_failed", "upload_error": "script_failed"})
    return results.individual_results(files).select("job_id", "file_seq", "status")


@query(f"""with {_FILES}, r as (select job_id, file_seq, name, case when upload_error then 'conversion_error' else 'success' end as status from f
  union all select job_id, file_seq, name, 'conversion_error_fallback' from f where failed and not upload_error)
select job_id, file_seq, name as original_name, replace(name, '.ppt', case when status = 'success' then '.pdf' else '.ppt' end) as converted_name,
  case when status = 'success' then '/media/u/' || split_part(job_id, '/', 2) || '/converted_files/' || replace(name, '.ppt', '.pdf') end as download_url, status,
  case status when 'conversion_error_fallback' then '文件 ' || name || ' 的PDF转换失败，保留原始文件。错误: no engine' when 'conversion_error' then 'no engine' end as message from r""")
def result_rows(spark, sf_dir):
    """Full result rows: links of successes, messages of the others."""
    files = _event_files(spark, sf_dir).withColumnsRenamed({"failed": "pdf_failed", "upload_error": "script_failed"})
    rows = results.individual_results(files).withColumn("original_name", F.col("name"))
    rows = rows.withColumn("converted_name", F.when(F.col("status") == "success", text.with_suffix(F.col("name"), ".pdf")).otherwise(F.col("name")))
    return results.result_rows(rows, F.lit("u"), F.split_part(F.col("job_id"), F.lit("/"), F.lit(2)), F.lit("no engine"))


@query("""select 'u' || s_nationkey as username, '20240101' as ymd, 's' || s_suppkey || '.pdf' as filename, true as is_meta, s_name as meta_content from supplier where s_suppkey % 2 = 0
union all select 'u' || s_nationkey, '20240101', 'merged.pdf', true, string_agg(s_name, ',' order by s_suppkey) from supplier group by s_nationkey""")
def sidecar_files(spark, sf_dir):
    """Sidecars of single files and of a merged one for each user, written and read back from the tree; every second single file failed."""
    s = table(spark, sf_dir, "supplier").withColumns({"username": F.concat(F.lit("u"), _text("s_nationkey")), "ymd": F.lit("20240101")})
    single = s.select("username", "ymd", F.concat(F.lit("s"), _text("s_suppkey"), F.lit(".pdf")).alias("converted_name"), F.col("s_name").alias("original_name"), F.when(F.col("s_suppkey") % 2 == 0, "success").otherwise("conversion_error").alias("status"))
    merged = s.groupBy("username", "ymd").agg(text.ordered_join(F.col("s_suppkey"), F.col("s_name")).alias("original_name"))
    rows = single.unionByName(merged.withColumns({"converted_name": F.lit("merged.pdf"), "status": F.lit("success")}))
    folder = shared_dir(spark).removeprefix("file://")
    sinks.write_files(results.sidecars(rows), folder)
    found = read_tree(spark, folder).where("area = 'converted_files'")
    return found.select("username", "ymd", F.regexp_replace("filename", "[.]meta$", "").alias("filename"), "is_meta", "meta_content")


@query(f"""with {_FILES} select job_id, file_seq, regexp_extract(name, '[a-z]+') as name from f where not failed""")
def without_result(spark, sf_dir):
    """Files are known by their number: names repeat in a job."""
    files = _event_files(spark, sf_dir).withColumn("name", F.regexp_extract("name", "[a-z]+", 0))
    done = files.where("failed").select("job_id", "file_seq")
    return results.without_result(files, done).select("job_id", "file_seq", "name")


@query(f"""with {_FILES} select job_id, bool_or(not upload_error) as any_uploaded, bool_and(not upload_error) as all_uploaded, arg_min(name, file_seq) as first_name, count(*) as n_files from f group by job_id""")
def job_flags(spark, sf_dir):
    files = _event_files(spark, sf_dir).withColumn("status", F.when(F.col("upload_error"), "upload_error").otherwise("uploaded"))
    return results.job_flags(files)


@query("""select event_id, event_id % 2 = 0 or event_id % 3 = 0 as ok, case when event_id % 2 = 0 then 'a' || event_id when event_id % 3 = 0 then 'b' || event_id end as path,
  case when event_id % 2 <> 0 and event_id % 3 <> 0 then 'no engine' end as error,
  case when event_id % 4 = 0 then null when event_id % 5 = 0 then event_type else 'Unknown error' end as script_error from events""")
def engine_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = lambda n, letter: F.struct((F.col("event_id") % n == 0).alias("ok"), F.concat(F.lit(letter), _text("event_id")).alias("path"), F.lit("x").alias("error"))
    chosen = results.first_success(made(2, "a"), made(3, "b"), error="no engine")
    script = results.script_outcome(F.col("event_id") % 4, F.lit(True), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(""), F.lit(None).cast("string"))
    return e.select("event_id", chosen.alias("c"), script.alias("s")).select("event_id", F.when(F.col("c.ok"), True).otherwise(False).alias("ok"), F.when(F.col("c.ok"), F.col("c.path")).alias("path"), F.when(~F.col("c.ok"), F.col("c.error")).alias("error"), F.col("s.error").alias("script_error"))


@query("""select event_id, case when event_id % 2 = 0 and event_id % 3 = 0 then 'f' || event_id || '.pdf' else 'f' || event_id || '.docx' end as path,
  case when event_id % 2 = 0 and event_id % 3 <> 0 then 'conversion_error_fallback' else 'success' end as status,
  case when event_id % 2 = 0 and event_type <> 'click' then 'PDF library is not available' end as gate,
  case when event_type = 'view' or event_id % 2 = 0 then 'pdf' else 'docx' end as output_format from events""")
def document_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wanted = F.when(F.col("event_id") % 2 == 0, "PDF").otherwise("docx")
    name = F.concat(F.lit("f"), _text("event_id"))
    outcome = F.struct((F.col("event_id") % 3 == 0).alias("ok"), F.concat(name, F.lit(".pdf")).alias("path"), F.lit("x").alias("error"))
    main = F.when(F.col("event_type") == "click", "imgToFile").otherwise("fileToPdf")
    sub = F.when(F.col("event_type") == "view", "wordToPdf").otherwise("imgToWord")
    chosen = results.document_outcome(wanted, outcome, F.concat(name, F.lit(".docx")))
    return e.select("event_id", chosen.alias("c"), results.library_gate(main, wanted, False).alias("gate"), text.output_format(sub, wanted).alias("output_format")).select("event_id", "c.path", "c.status", "gate", "output_format")


@query(f"""with {_FILES}, r as (select job_id, file_seq, name, case when upload_error then 'conversion_error' else 'success' end as status from f
  union all select job_id, file_seq, name, 'conversion_error_fallback' from f where failed and not upload_error)
select job_id, cast(to_json({{'results': list({{'original_name': name, 'status': status}} order by file_seq, name, status), 'merge_output': false}}) as varchar) as body from r group by job_id""")
def result_json(spark, sf_dir):
    rows = results.individual_results(_event_files(spark, sf_dir).withColumnsRenamed({"failed": "pdf_failed", "upload_error": "script_failed"}))
    return results.result_json(rows.select("job_id", "file_seq", F.col("name").alias("original_name"), "status", F.lit(False).alias("merge_output")))


@query("""with b as (select conv_id as job_id, turn as file_seq, i - 1 as block_seq, 'paragraph' as kind, ps[i] as text from (
    select conv_id, turn, case when len(q) > 0 then q else [text] end as ps from (select conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as q from conversations)) s, range(1, len(ps) + 1) t(i)),
a as (select * from b union all select job_id, file_seq, -1, 'page_break', null from (select distinct job_id, file_seq from b) d where file_seq > (select min(file_seq) from b where b.job_id = d.job_id))
select job_id, row_number() over (partition by job_id order by file_seq, block_seq) - 1 as seq, kind, text from a""")
def merged_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("file_seq"), F.posexplode(text.segment_text(F.col("text"))).alias("block_seq", "text")).withColumn("kind", F.lit("paragraph"))
    return results.merged_blocks(rows).select("job_id", F.col("seq").cast("long").alias("seq"), "kind", "text")


@query("""select conv_id, row_number() over (partition by conv_id order by turn) as page, regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') as text from conversations""")
def merged_pdfs(spark, sf_dir):
    """Conversations merged from a PDF file a turn, and the pages of the merged files read back."""
    page = F.pandas_udf(lambda texts: texts.map(pdf.one_page), T.BinaryType())
    c = table(spark, sf_dir, "conversations")
    files = c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("file_seq"), page(F.coalesce("text", F.lit(""))).alias("content"))
    folder = shared_dir(spark).removeprefix("file://")
    pdf_merge.merge_pdfs(files, folder)
    made = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    pages = pdf_merge.page_texts(made.select("path"))
    return pages.select(F.regexp_extract("path", "([0-9]+)[.]pdf$", 1).cast("long").alias("conv_id"), (F.col("page") + 1).alias("page"), "text")


@query("""with a as (select conv_id, turn, 1 as part, 'heading' as kind, 'Turn ' || turn as text from conversations union all select conv_id, turn, 2, 'paragraph', text from conversations
  union all select conv_id, turn, 0, 'page_break', '' from conversations c where turn > (select min(turn) from conversations d where d.conv_id = c.conv_id))
select conv_id, row_number() over (partition by conv_id order by turn, part) - 1 as seq, kind, text from a""")
def merged_documents(spark, sf_dir):
    """Conversations merged from a document file a turn, and read back."""
    made = F.pandas_udf(lambda turns, texts: pd.Series([docx.document_bytes([("heading", f"Turn {n}"), ("paragraph", t)]) for n, t in zip(turns, texts, strict=True)], dtype=object), T.BinaryType())
    c = table(spark, sf_dir, "conversations")
    files = c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("file_seq"), made("turn", F.coalesce("text", F.lit(""))).alias("content"))
    whole = docx_merge.merge_documents(files).where("ok")
    found = docx.parse(whole.select(F.col("job_id").cast("string").alias("path"), "content"))
    return found.select(F.col("path").cast("long").alias("conv_id"), F.col("block_seq").cast("long").alias("seq"), "kind", "text")


#: Boxes of a vector, and the components of each: corner, size and score.
_BOXES, _PARTS_OF_BOX = 12, 5


@query(f"""with recursive v as (select vec_id as page_id, i as box, i % 3 as label, list_transform(embedding[{_PARTS_OF_BOX}*i+1 : {_PARTS_OF_BOX}*i+{_PARTS_OF_BOX}], lambda x: cast(floor(cast(100 as double) * x) as bigint)) as e from embeddings, range(0, {_BOXES}) t(i)),
b as (select page_id, box, label, (abs(e[5]) + 26) / cast(100 as double) as score, e[1] as x1, e[2] as y1, e[1] + 20 + abs(e[3]) as x2, e[2] + 20 + abs(e[4]) as y2 from v),
o as (select *, row_number() over (partition by page_id order by score desc, x1, y1, x2, y2, label) as r from b where score > 0.3),
k as (select page_id, cast(0 as bigint) as r, cast([] as struct(box bigint, label bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint)[]) as kept from (select distinct page_id from o)
  union all select o.page_id, o.r, case when len(list_filter(kept, lambda q: q.label = o.label and 2 * greatest(least(q.x2, o.x2) - greatest(q.x1, o.x1), 0) * greatest(least(q.y2, o.y2) - greatest(q.y1, o.y1), 0) >
      (q.x2 - q.x1) * (q.y2 - q.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(q.x2, o.x2) - greatest(q.x1, o.x1), 0) * greatest(least(q.y2, o.y2) - greatest(q.y1, o.y1), 0))) > 0
    then kept else list_append(kept, {{'box': o.box, 'label': o.label, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) end
  from k join o on o.page_id = k.page_id and o.r = k.r + 1),
f as (select page_id, unnest(arg_max(kept, r)) as q from k group by page_id)
select f.page_id, q.box as box, q.label as label, o.score from f join o on o.page_id = f.page_id and o.box = q.box""")
def detector_boxes(spark, sf_dir):
    """Each vector as a page of boxes made from its components: three labels, low scores, overlaps."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_BOXES - 1).cast("long"))).alias("box"), F.col("embedding").cast("array<double>").alias("v"))
    e = lambda k: F.floor(F.lit(100.0) * F.element_at("v", (_PARTS_OF_BOX * F.col("box") + k).cast("int"))).cast("double")
    boxes = v.select("page_id", "box", (F.col("box") % 3).alias("label"), ((F.abs(e(5)) + 26) / 100).alias("score"), e(1).alias("x1"), e(2).alias("y1"), (e(1) + 20 + F.abs(e(3))).alias("x2"), (e(2) + 20 + F.abs(e(4))).alias("y2"))
    return elements.suppressed(boxes).select("page_id", "box", "label", "score")
