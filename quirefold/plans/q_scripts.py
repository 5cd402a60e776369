"""Queries on script lines, text functions, job documents and chapter folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import jobs as J
from quirefold.operators import scripts as S

from .registry import query

# The sample styles of these queries.
PREFIXES = [("S0:", "shout", "main", 1), ("S1:", "think", None, 2), ("S", "plain", None, 3), ("S2:", "small", "main", 4), ("##", "note", "other", 5)]
PREFIX_SQL = "(values ('S0:', 'shout', 'main', 1), ('S1:', 'think', null, 2), ('S', 'plain', null, 3), ('S2:', 'small', 'main', 4), ('##', 'note', 'other', 5)) p(prefix, style_id, folder, ord)"


def _prefixes(v):
    return v.spark.createDataFrame(PREFIXES, "prefix string, style_id string, folder string, ord int")


def _match_sql(tier: str) -> str:
    return f"""m as (select page_id, line_no, prefix, style_id, row_number() over (partition by page_id, line_no order by {tier}, ord) as rn from script_lines, {PREFIX_SQL} where starts_with(raw_text, prefix)),
    b as (select page_id, line_no, prefix, style_id from m where rn = 1)"""


@query("j13_match_styles", f"with {_match_sql('case when folder = ' + chr(39) + 'main' + chr(39) + ' then 0 else 1 end')} select * from b")
def _(v):
    return S.match_styles(v.script_lines, _prefixes(v), True, "main")


@query("j13_match_unfoldered_first", f"with {_match_sql('case when folder is null then 0 else 1 end')} select * from b")
def _(v):
    return S.match_styles(v.script_lines, _prefixes(v), False)


PARSED = f"""with {_match_sql('case when folder = ' + chr(39) + 'main' + chr(39) + ' then 0 else 1 end')},
  r as (select page_id, line_no, raw_text as raw, case when starts_with(raw_text, '##') then '##' else '' end as ign, starts_with(raw_text, '//') as follow, style_id as s0,
    case when starts_with(raw_text, '//:') then '//:' when starts_with(raw_text, '//') then '//' else coalesce(prefix, '') end as pre from script_lines left join b using (page_id, line_no)),
  i as (select *, case when ign <> '' then substr(raw, 3) else raw end as t1 from r),
  x as (select *, case when pre <> '' and instr(t1, pre) > 0 then substr(t1, 1, instr(t1, pre) - 1) || substr(t1, instr(t1, pre) + length(pre)) else t1 end as t2 from i),
  y as (select *, regexp_replace(replace(replace(t2, '***', ''), '&&&', ''), '^\\s+|\\s+$', '', 'g') as text, regexp_matches(raw, '(?i)Page [0-9]+') as is_page, case when not follow then s0 end as own from x),
  z as (select *, ign <> '' or text = '' or is_page as ignore from y),
  w as (select page_id, line_no, text, ignore, is_page, case when follow then last_value(case when not ignore and not follow then own end ignore nulls) over (partition by page_id order by line_no rows between unbounded preceding and 1 preceding) else own end as style_id,
    (case when ignore then 0 else sum(case when ignore then 0 else 1 end) over (partition by page_id order by line_no) end)::bigint as index, (sum(is_page::int) over (partition by page_id order by line_no))::bigint as section from z),
  parsed as (select page_id, line_no, text, style_id, ignore, index, section, section < max(section) over (partition by page_id) and index > 0 and index = max(index) over (partition by page_id, section) as last from w)"""


def _parsed(v):
    return S.parse_lines(v.script_lines, _prefixes(v), ["##"], ["***", "&&&"], current_folder="main")


@query("w7_w8_w9_parse_lines", f"{PARSED} select * from parsed")
def parse_lines(v):
    return _parsed(v)


@query("w9_next_pages", f"""{PARSED}, f as (select page_id, section, min(line_no) filter (not ignore) as first_line from parsed group by 1, 2)
    select page_id, section, first_value(first_line ignore nulls) over (partition by page_id order by section rows between 1 following and unbounded following) as next_line from f""")
def _(v):
    return S.next_pages(_parsed(v))


SCRIPT = """with l as (select conv_id as doc_id, turn * 2 as line_no, case when turn % 7 = 6 then 'loose' else ' [B' || (turn % 4)::varchar || '] ' end as raw from conversations union all select conv_id, turn * 2 + 1, chr(160) || text || ' «x» ' from conversations),
  n as (select doc_id, line_no, replace(raw, chr(160), ' ') as raw from l), h as (select *, regexp_extract(raw, '^\\s*\\[(B[0-9]+)\\]\\s*$', 1) as head from n),
  p as (select *, sum((head <> '')::int) over (partition by doc_id order by line_no) as part from h),
  g as (select doc_id, part, max(head) as bubble_id, coalesce(string_agg(raw, chr(10) order by line_no) filter (head = ''), '') as text from p where part > 0 group by 1, 2),
  texts as (select doc_id, bubble_id, translate(regexp_replace(arg_max(text, part), '^\\s+|\\s+$', '', 'g'), '«»„‹›', '""''''''') as text from g group by 1, 2)"""


def _script(v):
    c = v.conversations
    head = F.when(F.col("turn") % 7 == 6, "loose").otherwise(F.concat(F.lit(" [B"), (F.col("turn") % 4).cast("string"), F.lit("] ")))
    heads = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2).alias("line_no"), head.alias("raw"))
    return S.parse_script(heads.unionByName(c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + 1).alias("line_no"), F.concat(F.lit(" "), "text", F.lit(" «x» ")).alias("raw"))))


@query("w10_parse_script", f"{SCRIPT} select * from texts")
def _(v):
    return _script(v)


@query("src9_export_script", f"{SCRIPT} select doc_id, string_agg('[' || bubble_id || ']' || chr(10) || coalesce(nullif(trim(text), ''), '.....') || chr(10), chr(10) order by bubble_id) as script from texts group by 1")
def _(v):
    return S.export_script(_script(v))


@query("src10_script_lines", r"""with d as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents) select doc_id, i::int as line_no, l[i + 1] as raw from d, unnest(range(0, len(l))) as u(i)""")
def _(v):
    return S.script_lines(v.documents.select("doc_id", F.col("text").alias("value")))


@query("f2_f3_plain_text", "select doc_id, translate(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '«»„‹›', '\"\"''''''') as text from documents")
def _(v):
    return v.documents.select("doc_id", X.plain_quotes(X.plain_spaces(F.col("text"))).alias("text"))


@query("f4_words", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as squeezed, case when trim(regexp_replace(text, '\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) end::int as n_words from documents")
def _(v):
    return v.documents.select("doc_id", X.squeezed(F.col("text")).alias("squeezed"), F.size(X.words(F.col("text"))).alias("n_words"))


@query("f5_norm_token", r"""with t as (select distinct unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as token from documents), n as (select token, lower(trim(token, ' ' || chr(9) || chr(10) || '.,!?:;"''()[]{}<>-_*/\|~`«»„“”‚‘’…–—')) as norm from t)
    select token, norm, regexp_full_match(norm, '[0-9]+([.,:/][0-9]+)*%?') as is_number from n""")
def _(v):
    t = v.documents.select(F.explode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("token")).distinct()
    return t.select("token", X.norm_token(F.col("token")).alias("norm"), X.is_number(F.col("token")).alias("is_number"))


@query("f6_script_lang", r"""with c as (select doc_id, length(text) - length(regexp_replace(text, '[Ѐ-ӿ]', '', 'g')) as cyr, length(text) - length(regexp_replace(text, '[A-zÀ-ÿ]', '', 'g')) as lat from documents)
    select doc_id, case when cyr >= greatest(3, lat * 2) then 'ru' when lat >= greatest(3, cyr * 2) then 'en' else 'auto' end as script from c""")
def _(v):
    return v.documents.select("doc_id", X.script_lang(F.col("text")).alias("script"))


@query("f7_names", r"""select distinct folder, try_cast(regexp_extract(folder, '([0-9]+)', 1) as bigint) as number, regexp_replace('p/ ' || folder || ' *', '[^A-Za-z0-9._-]+', '_', 'g')[1:-2] as safe from manifest""")
def _(v):
    return v.manifest.select("folder", X.chapter_no(F.col("folder")).alias("number"), X.safe_name(F.concat(F.lit("p/ "), "folder", F.lit(" *"))).alias("safe")).distinct()


@query("f8_strip_prefix_tags", r"select page_id, line_no, trim(replace(regexp_replace(raw_text, 'th', ''), '.', '')) as text from script_lines")
def _(v):
    t = F.replace(S._without_first(F.col("raw_text"), F.lit("th")), F.lit("."), F.lit(""))
    return v.script_lines.select("page_id", "line_no", F.trim(t).alias("text"))


@query("f18_flat_keys", "select event_id, concat_ws('_', phase, done::varchar) as key, value from progress_events join (select event_id, value from events) using (event_id)")
def _(v):
    return v.events.select("event_id", "value").join(v.progress_events, "event_id").select("event_id", X.flat_key(F.col("phase"), F.col("done").cast("string")).alias("key"), "value")


@query("f19_job_ids", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, strftime(ts, '%Y-%m-%d_%H-%M-%S') || '__' || substr(md5(event_id::varchar), 1, 8) as job from events")
def _(v):
    return v.events.select("event_id", X.iso_second(F.col("ts")).alias("at"), X.job_name(F.col("ts"), F.col("event_id")).alias("job"))


@query("st1_latest_progress", """with r as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as rn from progress_events)
    select job_id, phase, done, total, least(100, greatest(0, round_even(100.0::double * done / total, 0)))::int as pct from r where rn = 1""")
def _(v):
    return J.latest_progress(v.progress_events)


PATCHES = """with e as (select user_id as job_id, event_id % 5 as item, ts, event_id, floor(value) as done, 20 as total, case when event_type = 'purchase' then 'error' else 'ok' end as status from events),
    r as (select *, row_number() over (partition by job_id, item order by ts desc, event_id desc) as rn from e), g as (select job_id, count(*) as items, count(*) filter (done >= total) as finished, count(*) filter (status = 'error') as failed from r where rn = 1 group by 1)
    select *, least(100, greatest(0, round_even(100.0::double * finished / items, 0)))::int as pct from g"""


def patch_events(v):
    return v.events.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 5).alias("item"), "ts", "event_id", F.floor("value").alias("done"), F.lit(20).alias("total"), F.when(F.col("event_type") == "purchase", "error").otherwise("ok").alias("status"))


@query("st5_patch_progress", PATCHES)
def _(v):
    return J.patch_progress(patch_events(v))


STATUS = "case event_id % 9 when 0 then 'created' when 1 then 'created' when 2 then 'detect_bubbles_running' when 3 then 'await_edit' when 4 then 'await_ocr_clean' when 5 then 'ocr_clean_running' when 6 then 'await_translation' when 7 then 'error' else 'await_edit' end"


TRANSITIONS = f"""with s as (select user_id as job_id, event_id, ts, {STATUS} as cur from events), l as (select job_id, event_id, lag(cur) over (partition by job_id order by ts, event_id) as prev, cur from s)
    select job_id, event_id, prev, cur, case when prev is null then cur = 'created' when prev = 'error' then cur = 'error' else cur = 'error' or cur = prev or list_position(['created', 'detect_bubbles_running', 'await_edit', 'await_ocr_clean', 'ocr_clean_running', 'await_translation'], cur) = list_position(['created', 'detect_bubbles_running', 'await_edit', 'await_ocr_clean', 'ocr_clean_running', 'await_translation'], prev) + 1 end as valid from l"""


@query("w17_st2_transitions", TRANSITIONS)
def _(v):
    return J.transitions(v.events.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.expr(STATUS).alias("status")))


REGROUPED = "select run_id, lower(regexp_extract(tag, '(?i)^(train|test|val|extra_val_.*?(?:256|512))_(.*)$', 1)) as grp, regexp_extract(tag, '(?i)^(train|test|val|extra_val_.*?(?:256|512))_(.*)$', 2) as title, step, value from scalars where not ends_with(tag, '_std') and regexp_matches(tag, '(?i)^(train|test|val|extra_val_.*?(?:256|512))_')"


@query("src13_regroup", REGROUPED)
def _(v):
    return J.regroup(v.scalars).drop("wall_time")


@query("src13_ignored_tags", "select distinct tag from scalars where not ends_with(tag, '_std') and not regexp_matches(tag, '(?i)^(train|test|val|extra_val_.*?(?:256|512))_')")
def _(v):
    return J.ignored_tags(v.scalars)


@query("src1_chapters", "select folder, coalesce(try_cast(regexp_extract(folder, '([0-9]+)', 1) as bigint), 0) as number from (select distinct folder from manifest where starts_with(folder, 'ch'))")
def _(v):
    return J.discover_chapters(v.manifest)


RANGE = "(select distinct folder from manifest union all select 'chapter_extra') c"


@query("src2_chapter_range", f"select folder from {RANGE} where try_cast(regexp_extract(folder, '([0-9]+)', 1) as bigint) is null or try_cast(regexp_extract(folder, '([0-9]+)', 1) as bigint) between 100 and 700")
def _(v):
    return J.chapter_range(v.manifest.select("folder").distinct().union(v.spark.createDataFrame([("chapter_extra",)], "folder string")), 100, 700)


@query("src2_skipped", f"select count(*) as total, count(*) filter (coalesce(n not between 100 and 700, false)) as skipped, count(*) filter (not coalesce(n not between 100 and 700, false)) as kept from (select try_cast(regexp_extract(folder, '([0-9]+)', 1) as bigint) as n from {RANGE})")
def _(v):
    return J.skipped_count(v.manifest.select("folder").distinct().union(v.spark.createDataFrame([("chapter_extra",)], "folder string")), 100, 700)


@query("src3_originals", """with c as (select folder, file_name, ends_with(lower(file_name), '.png') and not contains(file_name, '_cleaned') and not contains(file_name, 'frame_') as cand, contains(file_name, '_original') as orig from manifest),
    g as (select folder, count(*) filter (cand) as n, count(*) filter (cand and orig) as m, min(file_name) filter (cand) as one, min(file_name) filter (cand and orig) as o from c group by 1)
    select folder, case when n = 1 then one when n > 1 and m = 1 then o end as file, case when n = 0 then 'missing' when n = 1 then 'single' when m = 1 then 'marked' else 'ambiguous' end as status, case when n = 1 then folder || '_original.png' end as target from g""")
def _(v):
    return J.choose_originals(v.manifest)


@query("t6_id_orders", "select o_custkey as owner, o_orderkey as id, (row_number() over (partition by o_custkey order by o_orderkey))::int as as_number, (row_number() over (partition by o_custkey order by o_orderkey::varchar))::int as as_string from orders")
def _(v):
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey")
    by_text = F.row_number().over(own.orderBy(F.col("o_orderkey").cast("string")))
    return v.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.row_number().over(own.orderBy("o_orderkey")).alias("as_number"), by_text.alias("as_string"))


@query("u5_dedupe", "select distinct folder from manifest")
def _(v):
    return v.manifest.select("folder").distinct()


@query("p24_patch_plan", """with s as (select box_id as id, page_id, case when box_id % 9 = 0 then '?!' else 'sq ' || (box_id % 3)::varchar end as name, left_x + 0.5 as l, top_y - 0.5 as t, right_x + 300 as r, bottom_y as b from boxes),
    n as (select *, case when name = '?!' then 'item' else replace(name, ' ', '_') end as base from s join page_dim using (page_id)), k as (select *, row_number() over (partition by page_id, base order by id) - 1 as rn from n),
    c as (select *, greatest(0, least(floor(l), width - 1))::bigint as x0, greatest(0, least(floor(t), height - 1))::bigint as y0 from k)
    select id, case when rn > 0 then base || '_' || lpad(rn::varchar, 4, '0') else base end as safe_id, x0, y0, greatest(x0 + 1, least(ceil(r), width))::bigint as x1, greatest(y0 + 1, least(ceil(b), height))::bigint as y1 from c""")
def _(v):
    name = F.when(F.col("box_id") % 9 == 0, "?!").otherwise(F.concat(F.lit("sq "), (F.col("box_id") % 3).cast("string")))
    sq = v.boxes.select(F.col("box_id").alias("id"), "page_id", name.alias("name"), (F.col("left_x") + 0.5).alias("left_x"), (F.col("top_y") - 0.5).alias("top_y"), (F.col("right_x") + 300).alias("right_x"), "bottom_y")
    return J.patch_plan(sq, v.page_dim)


@query("p25_drop_style_key", "select page_id, box_id::varchar as id, conf as size from boxes")
def _(v):
    style = F.struct(F.col("conf").alias("size"), F.col("cls").alias("stroke"))
    m = v.boxes.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("box_id").cast("string").alias("k"), style.alias("v"))))).alias("styles"))
    return m.select("page_id", J.drop_style_key(F.col("styles"), "stroke").alias("styles")).select("page_id", F.explode("styles").alias("id", "style")).select("page_id", "id", "style.size")
