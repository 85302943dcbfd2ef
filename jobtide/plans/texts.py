"""Queries of the text functions, the extraction operators, the document jobs and the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtide.functions import scalar as S
from jobtide.functions import text as T
from jobtide.operators import documents as D
from jobtide.operators import jd as J
from jobtide.operators.lexicon import keyword_match
from jobtide.plans.book import query
from jobtide.plans.forms import forms, forms_sql
from jobtide.plans.matching import MATCH, _jds, _pairs
from jobtide.plans.resumes import _structured
from jobtide.sources import parsing as P
from jobtide.session import shared_folder
from jobtide.sources.views import Views
from jobtide.streaming.jobs import StatusTables, request_metrics, status_stream, write_request_metrics


def _one(v: Views, value: Column, name: str = "value") -> DataFrame:
    return v.resumes.select("doc_id", value.alias(name))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS value FROM resumes")
def str1_clean_text(v: Views) -> DataFrame:
    return _one(v, T.clean_text("text"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS value FROM resumes")
def str2_normalize_whitespace(v: Views) -> DataFrame:
    return _one(v, T.normalize_whitespace("text"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS value FROM pages")
def str3_strip_html(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.md5(T.strip_html("html")).alias("value"))


@query("SELECT doc_id, CASE WHEN len(text) <= 100 THEN text ELSE text[1:97] || '...' END AS value FROM resumes")
def str4_truncate_text(v: Views) -> DataFrame:
    return _one(v, T.truncate_text("text"))


@query("""SELECT doc_id, CASE WHEN len(text) <= 400 THEN text WHEN last > 320 THEN head[1:last + 1] ELSE head END AS value FROM (
 SELECT *, greatest(CASE WHEN instr(back, '.') > 0 THEN 400 - instr(back, '.') ELSE -1 END, CASE WHEN instr(back, chr(10)) > 0 THEN 400 - instr(back, chr(10)) ELSE -1 END, CASE WHEN instr(back, '。') > 0 THEN 400 - instr(back, '。') ELSE -1 END) AS last
 FROM (SELECT doc_id, text, text[1:400] AS head, reverse(text[1:400]) AS back FROM resumes))""")
def str5_truncate_at_sentence(v: Views) -> DataFrame:
    return _one(v, T.truncate_at_sentence("text", 400))


ENDINGS = (("有限公司", "有限责任公司", "股份有限公司", "公司 ", "集团", "", "公司集团", " Ltd"),)


@query(f"""SELECT user_id, coalesce({', '.join(f"CASE WHEN ends_with(x, '{e}') THEN x[1:len(x) - {len(e)}] END" for e in T.COMPANY_SUFFIXES)}, x) AS value
FROM (SELECT user_id, trim(name || {forms_sql(ENDINGS, 'user_id')}) AS x FROM users)""")
def str6_normalize_company(v: Views) -> DataFrame:
    return v.users.select("user_id", T.normalize_company(F.concat("name", forms(ENDINGS, F.col("user_id"))[0])).alias("value"))


@query("SELECT s_suppkey, trim(s_name) AS value FROM (SELECT s_suppkey, '  ' || s_name || ' ' AS s_name FROM supplier)")
def str7_normalize_school(v: Views) -> DataFrame:
    return v.table("supplier").select("s_suppkey", T.normalize_school(F.concat(F.lit("  "), "s_name", F.lit(" "))).alias("value"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[\\x{4e00}-\\x{9fa5}]{2,4}') AS chinese, regexp_full_match(p_name, '[A-Za-z]+(\\s+[A-Za-z]+)*') AS english FROM part")
def str8_name_kind(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.is_chinese_name("p_name").alias("chinese"), T.is_english_name("p_name").alias("english"))


_ab = "SELECT a.p_partkey, list_distinct({0}) AS a, list_distinct({1}) AS b FROM part a"


@query("SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS value FROM (" + _ab.format("string_split(lower(p_name), ' ')", "string_split(lower(p_type || ' ' || p_name), ' ')") + ")")
def str9_text_jaccard(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.text_jaccard("p_name", F.concat_ws(" ", "p_type", "p_name")).alias("value"))


@query("SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS value FROM (" + _ab.format("string_split(lower(p_name), '')", "string_split(lower(p_type), '')") + ")")
def str10_char_jaccard(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.char_jaccard("p_name", "p_type").alias("value"))


_alike = lambda x, y: f"CASE WHEN {x} <> '' AND {y} <> '' THEN CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.8::DOUBLE END END"


@query(f"""SELECT p_partkey, coalesce(list_avg(list_filter([{_alike('n1', 'n2')}, {_alike('t1', 't2')}], lambda x: x IS NOT NULL)), 0)::DOUBLE AS value FROM (
 SELECT p_partkey, lower(p_name) AS n1, lower(CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' plus' WHEN 2 THEN 'other' ELSE '' END) AS n2, lower(p_type) AS t1, lower(CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE '' END) AS t2 FROM part)""")
def str11_entry_similarity(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    a = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("title"))
    name = F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat("p_name", F.lit(" plus"))).when(k % 4 == 2, "other").otherwise("")
    b = F.struct(name.alias("name"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.col("p_brand")).otherwise("").alias("title"))
    return v.table("part").select("p_partkey", T.entry_similarity(a, b, ("name", "title")).alias("value"))


WORDS = ((" View.X ", "click x", "CLICK", "k.8 s", "unknown #", ""),)
_known = "MAP {'viewx': 'screening', 'clickx': 'interview', 'click': 'interview', 'k.8 s': 'kubernetes'}"


@query(f"""SELECT event_id, coalesce(m[k], m[replace(k, '.', '')], m[replace(k, ' ', '')], w) AS value
FROM (SELECT event_id, w, lower(trim(w)) AS k, {_known} AS m FROM (SELECT event_id, {forms_sql(WORDS, 'event_id')} AS w FROM events))""")
def str12_normalize_keyword(v: Views) -> DataFrame:
    table = F.create_map(*map(F.lit, ("viewx", "screening", "clickx", "interview", "click", "interview", "k.8 s", "kubernetes")))
    return v.table("events").select("event_id", T.normalize_keyword(forms(WORDS, F.col("event_id"))[0], table).alias("value"))


@query("SELECT doc_id, sha256(text)[1:16] AS value FROM resumes")
def str13_text_key(v: Views) -> DataFrame:
    return _one(v, T.text_key("text"))


MARKS = (("## Title #", "plain", "# a # b"), ("see [this #](http://x/#) and ![pic](p.png)", "**bold** and `code`", "> quoted **x"), ("- one\n* two\n  + three", "1 - 2", "[a](b)[c](d)"))


@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{{1,6}}\\s*', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'),
 '\\[([^\\]]*)\\]\\(([^)]*)\\)', '\\1 (\\2)', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '`([^`]*)`', '\\1', 'g'), '(?m)^\\s*[-*+]\\s+', '• ', 'g'), '(?m)^>\\s?', '', 'g')) AS value
FROM (SELECT p_partkey, concat_ws(chr(10), {forms_sql(MARKS, 'p_partkey')}, p_name) AS t FROM part)""")
def str14_markdown_to_text(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.markdown_to_text(F.concat_ws("\n", *forms(MARKS, F.col("p_partkey")), "p_name")).alias("value"))


DATES = "SELECT id, strftime(created_at, '%Y.%m') AS a, strftime(final_result_at, '%Y') AS b FROM applications"


def _dates(v: Views) -> DataFrame:
    return v.applications.select("id", F.date_format("created_at", "yyyy.MM").alias("a"), F.date_format("final_result_at", "yyyy").alias("b"))


@query(f"SELECT id, CASE WHEN regexp_extract(a, '20\\d\\d') <> '' THEN regexp_extract(a, '20\\d\\d') ELSE a END AS value FROM ({DATES})")
def dat1_normalize_date(v: Views) -> DataFrame:
    return _dates(v).select("id", S.normalize_date("a").alias("value"))


SPANS = (("2016.09 - 2020.06", "2018.09-至今", "2019 - 2022", "from 2020 ~ Present on", "2015年9月 - 2019年6月", "2017/3–2019", "soon", "2021年 - 至今", "2014-2016", "1999 - 2003"),)
_g = lambda k, n: f"regexp_extract(t, '{S.DATE_RANGES[k]}', {n})"
_fits = lambda k: f"regexp_matches(t, '{S.DATE_RANGES[k]}')"
_late = f"coalesce(nullif({_g(0, 4)}, ''), {_g(0, 3)})"


@query(f"""SELECT id, CASE WHEN {_fits(0)} THEN {_g(0, 1)} WHEN {_fits(1)} THEN {_g(1, 1)} WHEN {_fits(2)} THEN {_g(2, 1)} ELSE '' END AS start_,
 CASE WHEN {_fits(0)} THEN CASE WHEN {_late} IN ('至今', 'Present') THEN '至今' WHEN regexp_matches({_late}, '^20[0-9][0-9]') THEN {_late} ELSE '' END
 WHEN {_fits(1)} THEN CASE WHEN {_g(1, 2)} IN ('至今', 'Present') THEN '至今' ELSE {_g(1, 2)} END WHEN {_fits(2)} THEN {_g(2, 2)} ELSE '' END AS end_ FROM (SELECT id, {forms_sql(SPANS, 'id')} AS t FROM applications)""")
def dat2_date_range(v: Views) -> DataFrame:
    rows = v.applications.select("id", S.date_range(forms(SPANS, F.col("id"))[0]).alias("r"))
    return rows.select("id", F.col("r.start").alias("start_"), F.col("r.end").alias("end_"))


@query(f"SELECT id, a || ' - ' || coalesce(b, '至今') AS value FROM ({DATES})")
def dat3_format_duration(v: Views) -> DataFrame:
    return _dates(v).select("id", S.format_duration("a", "b").alias("value"))


DAYS = (("2016", "2016.09", "2016年9月", "至今", "Present", "99", "2016-", "x2016", "2016/113", ""),)


@query(f"SELECT id, regexp_full_match({forms_sql(DAYS, 'id')}, '20[0-9][0-9]|20[0-9][0-9][./年-][0-9][0-9]?月?|至今|Present') AS value FROM applications")
def dat4_is_valid_date(v: Views) -> DataFrame:
    return v.applications.select("id", S.is_valid_date(forms(DAYS, F.col("id"))[0]).alias("value"))


@query("SELECT id, floor((epoch_us(first_response_at) - epoch_us(applied_at)) / 86400000000)::BIGINT AS value FROM applications")
def dat5_days_between(v: Views) -> DataFrame:
    return v.applications.select("id", S.days_between("applied_at", "first_response_at").alias("value"))


@query("SELECT id, strftime(created_at - INTERVAL 90 DAY, '%Y-%m-%d') AS value FROM applications")
def dat6_range_start(v: Views) -> DataFrame:
    return v.applications.select("id", F.date_format(S.range_start(F.col("created_at"), "3m"), "yyyy-MM-dd").alias("value"))


@query("SELECT user_id, coalesce(floor(n::DOUBLE / nullif(m, 0)::DOUBLE * 10000::DOUBLE + 0.5) / 10000::DOUBLE, 0)::DOUBLE AS value FROM (SELECT user_id, count(*) FILTER (status = 'offered') AS n, count(*) FILTER (status <> 'applied') AS m FROM applications GROUP BY 1)")
def mth1_rate(v: Views) -> DataFrame:
    rows = v.applications.groupBy("user_id").agg(F.count_if(F.col("status") == "offered").alias("n"), F.count_if(F.col("status") != "applied").alias("m"))
    return rows.select("user_id", S.rate("n", "m", 4, 0).alias("value"))


@query("SELECT user_id, coalesce(least(100, floor(n / nullif(m, 0)::DOUBLE * 100)), 0)::INTEGER AS value FROM (SELECT user_id, count(*) FILTER (status = 'offered') AS n, count(*) FILTER (status <> 'applied') AS m FROM applications GROUP BY 1)")
def mth2_truncating_percent(v: Views) -> DataFrame:
    rows = v.applications.groupBy("user_id").agg(F.count_if(F.col("status") == "offered").alias("n"), F.count_if(F.col("status") != "applied").alias("m"))
    return rows.select("user_id", S.truncating_percent("n", "m").alias("value"))


@query("""SELECT event_id, x.path AS path, x.value AS value FROM (SELECT event_id, unnest([{'path': '["a","0","k"]', 'value': json_extract_string(props, '$.k')}, {'path': '["a","1"]', 'value': ''}, {'path': '["b","c","d e"]', 'value': event_id::VARCHAR},
 {'path': '["b","f"]', 'value': CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END}, {'path': '["g"]', 'value': '2.5'}]) AS x FROM events)""")
def jsn1_flatten_json(v: Views) -> DataFrame:
    key = F.col("event_id")
    text = F.concat(F.lit('{"_confirmed":true,"a":['), "props", F.lit(',null],"b":{"c":{"d e":'), key.cast("string"), F.lit('},"f":'), F.when(key % 2 == 0, "true").otherwise("false"), F.lit(',"_confirmed":{"x":1},"none":{}},"g":2.5}'))
    return P.flatten_json(v.table("events").select("event_id", text.alias("doc")), "event_id", "doc")


@query()
def jsn2_vault_card(v: Views) -> DataFrame:
    return D.vault_card(_structured(v))


@query(MATCH + """SELECT job_id, coalesce(least(100, floor(count(*) FILTER (in_jd AND in_resume) / nullif(count(*) FILTER (in_jd), 0)::DOUBLE * 100)), 0)::INTEGER AS score,
 coalesce(string_agg(term, ',' ORDER BY term) FILTER (in_jd AND in_resume), '') AS matched FROM pt GROUP BY 1""")
def jsn3_analysis_card(v: Views) -> DataFrame:
    return D.analysis_card(keyword_match(_pairs(v))).select("job_id", "score", F.array_join("matched", ",").alias("matched"))


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 6 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS title, CASE WHEN c_custkey % 3 > 0 THEN 'Company 1' END AS company,
 array_to_string(list_transform(range(1, c_custkey % 5 + 1), lambda i: 'skill ' || i), ',') AS skills, (c_custkey % 3)::INTEGER AS n_experiences, (c_custkey % 4)::INTEGER AS n_education, (c_custkey % 7)::INTEGER AS version FROM customer WHERE c_custkey % 10 <> 0""")
def jsn2_vault_cards(v: Views) -> DataFrame:
    return D.vault_card(_vault_data(v).filter("structured_data is not null")).withColumn("skills", F.array_join("skills", ","))


# Sources


@query("""SELECT page_id, extension, CASE WHEN extension IN ('png','jpg','jpeg','bmp','webp') THEN 'image' WHEN extension = 'pdf' THEN 'pdf' ELSE 'unknown' END AS kind,
 CASE WHEN n > 2000 THEN 'too large' WHEN extension NOT IN ('png','jpg','jpeg','bmp','webp','pdf') THEN 'not allowed' END AS reason
FROM (SELECT page_id, strlen(html) AS n, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' ELSE 'exe' END AS extension FROM pages)""")
def src2_file_inventory(v: Views) -> DataFrame:
    key = F.col("page_id") % 3
    name = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.when(key == 0, ".PDF").when(key == 1, ".png").otherwise(".exe"))
    files = v.table("pages").select(name.alias("path"), F.octet_length("html").cast("long").alias("length"))
    rows = P.file_inventory(files, 2000)
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), "extension", "kind", "reason")


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def src3_parse_structured(v: Views) -> DataFrame:
    return P.parse_structured(v.table("events").select("event_id", "props"), "props", "k int").select("event_id", "k")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k')::INTEGER END AS k FROM events")
def src4_parse_model_json(v: Views) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.lit('```json\n{"other": 1}\n```')).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return v.table("events").select("event_id", P.parse_model_json(raw, {"k": "int"})["k"].alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '岗位职责:' || chr(10) || p_name || chr(10) || chr(10) || '任职要求:' || chr(10) || p_type ELSE p_brand END AS text FROM part")
def src7_assemble_jd(v: Views) -> DataFrame:
    given = F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).otherwise(F.lit(""))
    return v.table("part").select("p_partkey", P.assemble_jd(given, F.col("p_name"), F.col("p_type")).alias("text"))


@query("SELECT l_orderkey AS doc_id, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber % 2, l_quantity, l_extendedprice, l_returnflag || l_linestatus) AS text FROM lineitem WHERE 1 - l_discount * 5 > 0.6 GROUP BY 1")
def src8_ocr_to_text(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("x"),
        F.concat("l_returnflag", "l_linestatus").alias("text"), (1 - F.col("l_discount") * 5).alias("confidence"),
    )
    return P.ocr_to_text(rows)


@query(""", w AS (SELECT l_orderkey AS doc_id, l_quantity * 2 AS top, l_extendedprice AS x0, l_returnflag || l_linenumber AS text FROM lineitem),
f AS (SELECT *, CASE WHEN abs(top - lag(top) OVER o) < 3 THEN 0 ELSE 1 END AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY top, x0, text)),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS line FROM f)
SELECT doc_id, line::BIGINT AS line, min(top) AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM g GROUP BY 1, 2""")
def src9_words_to_lines(v: Views) -> DataFrame:
    top = F.col("l_quantity") * 2
    words = v.table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), top.alias("top"), (top + 9).alias("bottom"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + 5).alias("x1"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.col("l_linestatus").alias("fontname"), (F.col("l_tax") * 100).alias("size"),
    )
    return P.words_to_lines(words).select("doc_id", "line", "top", "text")


@query("""SELECT l_orderkey AS doc_id, CASE WHEN NOT bool_or(l_returnflag = 'R') AND avg(l_linenumber % 2) > 0.7 THEN 'scanned' WHEN avg(l_quantity * 4) < 100 AND avg(l_linenumber % 2) > 0.5 THEN 'mixed' ELSE 'text' END AS kind FROM lineitem GROUP BY 1""")
def src10_pdf_kind(v: Views) -> DataFrame:
    pages = v.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") * 4).alias("text_chars"), (F.col("l_linenumber") % 2).alias("images"), (F.col("l_returnflag") == "R").alias("has_fonts"))
    return P.pdf_kind(pages)


@query("SELECT n_nationkey, n_name || ' |  | x' || chr(10) || n_name AS text FROM nation")
def src11_table_to_text(v: Views) -> DataFrame:
    cells = F.array(F.array("n_name", F.lit(None).cast("string"), F.lit("x")), F.array("n_name"))
    return v.table("nation").select("n_nationkey", P.table_to_text(cells).alias("text"))


# Job descriptions


JD = ("title", "company", "location", "experience", "education", "job_type", "headcount", "description", "requirements", "benefits")
#: The lines of a posting, each in several forms; ``#`` is the key. The forms reach every branch of the rules.
POSTING = (
    ("Python 工程师 #", "联系我们", "Notes of #", "12345", "岗位: Baker #"),
    ("Google Search", "北京某某科技有限公司", "某某集团 招新人", "", "Company: Nobody & #"),
    ("工作地点: 上海 苏州 北京 杭州", "支持远程办公", "地点: Mars #", ""),
    ("薪资: 15k-25k", "10-20K", "20万-30万", "月薪12000-18000", "年薪30-40", "8000-12000元", "工资 面议 7 到 9", ""),
    ("3年以上经验", "2-4 年经验", "不限经验", "3年以上", "经验: 面议", ""),
    ("学历: 本科", "大专, 本科", "学历 MBA", "本科以上", ""),
    ("全职", "外包 / 兼职", "全职或兼职", ""),
    ("招 05 人", "若干名", "人数: x", ""),
)


def _texts(v: Views) -> DataFrame:
    """Descriptions: the driver's texts under the lines of a posting."""
    return v.jds.select("job_id", F.concat_ws("\n", *forms(POSTING, F.col("job_id")), F.lit("岗位职责:"), "text", F.lit("\n任职要求：\nSQL\n \nand more\n\nBenefits"), "text").alias("text"))


_in = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_any = lambda words: "|".join(w.replace("+", "\\+").replace(".", "\\.") for w in words)
_alone = "'(?i)(^|[^\\p{L}\\p{N}_])' || w || '([^\\p{L}\\p{N}_]|$)'"
_label = lambda labels, least, most: f"trim(regexp_extract(text, '(?i)(?:{labels})[:：\\s]*([^\\n]{{{least},{most}}})', 1))"
#: Postings with their first lines.
POSTS = f""", posts AS (SELECT job_id, concat_ws(chr(10), {forms_sql(POSTING, 'job_id')}, '岗位职责:', text, chr(10) || '任职要求：' || chr(10) || 'SQL' || chr(10) || ' ' || chr(10) || 'and more' || chr(10) || chr(10) || 'Benefits', text) AS text FROM jds),
p AS (SELECT *, list_transform(string_split(text, chr(10))[1:20], lambda x: trim(x)) AS ls FROM posts)
"""


def _first(*rules: tuple[str, float]) -> str:
    """SQL: the value of the first rule that gives one, with its confidence."""
    value = ", ".join(f"nullif({rule}, '')" for rule, _ in rules)
    sure = " ".join(f"WHEN nullif({rule}, '') IS NOT NULL THEN {c}::DOUBLE" for rule, c in rules)
    return f"{POSTS} SELECT job_id, coalesce({value}) AS value, CASE {sure} END AS confidence FROM p"


def _meaning(table: dict[str, str]) -> str:
    return f"list_extract({_in(table.values())}, list_position(list_transform({_in(table)}, lambda w: regexp_matches(text, {_alone})), true))"


def _section(name: str) -> str:
    keys, most, _ = J.SECTIONS[name]
    rest = lambda k: f"nullif(string_split(regexp_extract(text, '(?is){k}[：:\\s]*([^：:\\s].*)', 1), chr(10) || chr(10))[1], '')"
    found = "coalesce(" + ", ".join(rest(k.replace("'", "''")) for k in keys) + ")"
    return f"(CASE WHEN len(trim({found})) > {most} THEN trim({found})[1:{most}] || '...' ELSE trim({found}) END)"


_fit = lambda x: f"(len({x}) BETWEEN 2 AND 50 AND NOT regexp_full_match({x}, '[0-9]+') AND NOT regexp_matches({x}, '{_any(J.NO_TITLE)}'))"
_years = ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in J.EXPERIENCE)
_company_line = f"list_filter(ls[1:15], lambda x: regexp_matches(x, '[一-龥]{{2,20}}(?:{_any(J.COMPANY_ENDS)})'))[1]"
JD_SQL = {
    "title": _first((f"list_filter(ls, lambda x: {_fit('x')} AND regexp_matches(x, '{_any(J.TITLES)}'))[1]", 0.9), (f"CASE WHEN {_fit(_label('职位|岗位|Job Title', 2, 30))} THEN {_label('职位|岗位|Job Title', 2, 30)} END", 0.85), (f"CASE WHEN {_fit('ls[1]')} THEN ls[1] END", 0.7)),
    "company": _first((_meaning({k: k for k in J.COMPANIES}), 0.95), ("coalesce(" + ", ".join(f"nullif(regexp_extract({_company_line}, '([一-龥]{{2,20}}{e})', 1), '')" for e in J.COMPANY_ENDS) + ")", 0.85), (_label("公司|企业|Company", 2, 40), 0.8)),
    "location": _first((f"CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_any(J.REMOTE)}'))) > 0 THEN '{J.REMOTE_VALUE}' END", 0.9), (f"array_to_string(list_filter(list_transform(flatten(list_transform(ls, lambda x: list_filter({_in((*J.PROVINCES, *J.CITIES))}, lambda w: contains(x, w)))), lambda w, i: CASE WHEN list_position(flatten(list_transform(ls, lambda x: list_filter({_in((*J.PROVINCES, *J.CITIES))}, lambda y: contains(x, y)))), w) = i THEN w END), lambda w: w IS NOT NULL)[1:3], '、')", 0.85), (_label("地点|地址|Location|Place", 2, 30), 0.8)),
    "experience": _first((f"coalesce({_years}) || '年以上'", 0.85), (_meaning(J.EXPERIENCE_WORDS), 0.8), (_label("经验|Experience", 2, 20), 0.75)),
    "education": _first((_meaning(J.EDUCATION), 0.85), (_label("学历|Education", 2, 20), 0.75)),
    "job_type": _first((_meaning(J.JOB_TYPES), 0.85), ("'全职'", 0.5)),
    "headcount": _first(("CASE WHEN regexp_matches(text, '\\d+\\s*人') THEN regexp_extract(text, '(\\d+)\\s*人', 1)::BIGINT::VARCHAR END", 0.8), (f"list_filter({_in(J.HEADCOUNT_WORDS)}, lambda w: contains(text, w))[1]", 0.75), (_label("人数|Headcount|招聘人数", 1, 10), 0.7)),
    **{name: _first((_section(name), J.SECTIONS[name][2])) for name in J.SECTIONS},
}


def _field_query(name: str):
    def run(v: Views) -> DataFrame:
        found = J.FIELDS[name](F.col("text"))
        return _texts(v).select("job_id", found["value"].alias("value"), found["confidence"].alias("confidence"))

    run.__name__ = f"jdx_{name}"
    return query(JD_SQL[name])(run)


for _name in JD:
    _field_query(_name)

_pay = "WHEN regexp_matches(text, '(?i){p}') THEN [regexp_extract(text, '(?i){p}', 1), regexp_extract(text, '(?i){p}', 2), regexp_extract(text, '(?i){p}', 0)]"
_scale = lambda x: f"CASE WHEN contains(lower(r[3]), 'k') OR a < 100 THEN {x} WHEN a > 1000 THEN {x} // 1000 ELSE {x} * 10 END"
PAY = f"""pay AS (
  SELECT job_id, r, r[1]::INTEGER AS a, coalesce(nullif(r[2], ''), r[1])::INTEGER AS b, regexp_extract_all({_label('薪资|工资|Salary', 2, 30)}, '[0-9]+') AS n
  FROM (SELECT *, CASE {' '.join(_pay.format(p=x) for x in J.SALARY)} END AS r FROM p)),
salary AS (
  SELECT job_id, (CASE WHEN r IS NOT NULL THEN {_scale('a')} ELSE n[1]::INTEGER END)::INTEGER AS min, (CASE WHEN r IS NOT NULL THEN {_scale('b')} ELSE coalesce(n[2], n[1])::INTEGER END)::INTEGER AS max,
         CASE WHEN r IS NULL AND len(n) = 0 THEN NULL WHEN r[3] LIKE '%万%' OR r[3] LIKE '%年薪%' THEN '年' ELSE '月' END AS unit,
         CASE WHEN r IS NOT NULL THEN 0.85::DOUBLE WHEN len(n) > 0 THEN 0.7::DOUBLE END AS confidence
  FROM pay)"""


@query(f"{POSTS}, {PAY} SELECT job_id, min, max, unit, confidence FROM salary")
def jdx4_salary(v: Views) -> DataFrame:
    return _texts(v).select("job_id", J.jd_salary(F.col("text")).alias("s")).select("job_id", "s.*")


_fields = ", ".join(f"f_{name} AS ({JD_SQL[name].removeprefix(POSTS)})" for name in JD)
_joined = " ".join(f"JOIN f_{name} USING (job_id)" for name in JD)
_sure = ", ".join([*(f"f_{name}.confidence" for name in JD), *["salary.confidence"] * 3])
_low = lambda name, of: f"CASE WHEN coalesce({of}.confidence, 0) < 0.6 THEN '{name}' END"
_flags = "concat_ws(',', " + ", ".join(_low(n, "salary" if n == "salary" else f"f_{n}") for n in ("title", "company", "salary", "description", "requirements")) + ")"
ALL_FIELDS = f"{POSTS}, {PAY}, {_fields}"
_mean = f"coalesce(list_sum(list_filter([{_sure}], lambda x: x > 0)) / len(list_filter([{_sure}], lambda x: x > 0)), 0)::DOUBLE AS confidence"


@query(f"{ALL_FIELDS} SELECT job_id, {', '.join(f'f_{n}.value AS {n}' for n in JD)}, {_mean} FROM salary {_joined}")
def jdx10_extract_jd(v: Views) -> DataFrame:
    return J.extract_jd(_texts(v)).select("job_id", *[F.col(f"{n}.value").alias(n) for n in JD], "confidence")


@query(f"{ALL_FIELDS} SELECT job_id, {_flags} AS review FROM salary {_joined}")
def jdx11_review_flags(v: Views) -> DataFrame:
    return J.extract_jd(_texts(v)).select("job_id", F.array_join("review", ",").alias("review"))


@query(f"{ALL_FIELDS} SELECT job_id, {_mean} FROM salary {_joined}")
def agg20_field_confidence(v: Views) -> DataFrame:
    return J.extract_jd(_texts(v)).select("job_id", "confidence")


# Documents


@query()
def doc1_render_resume(v: Views) -> DataFrame:
    return _structured(v).select("user_id", D.render_resume(F.col("structured_data"), F.array(F.lit("the")), F.col("raw")).alias("text"))


def _vault_data(v: Views) -> DataFrame:
    """Vaults of all shapes by user: without data, without person, e-mail or name, with up to three schools, two jobs, four skills."""
    key = F.col("c_custkey")
    some = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.filter(F.transform(F.array(F.lit(1)), f), lambda x: F.lit(False)))
    n = lambda k: (key % k).cast("int")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    info = F.when(key % 11 != 0, F.struct(F.when(key % 6 != 0, F.col("c_name")).alias("name"), F.when(key % 3 == 1, text("u", key, "@x.org")).when(key % 3 == 2, "").alias("email")))
    schools = some(n(4), lambda i: F.struct(text("School ", i).alias("school"), F.when(i != 2, "BSc").alias("degree"), F.col("c_mktsegment").alias("field")))
    projects = lambda i: some(i - 1, lambda j: F.struct(text("P", j).alias("name"), text("made for ", F.col("c_name")).alias("description")))
    jobs = some(n(3), lambda i: F.struct(text("Company ", i).alias("company"), F.col("c_mktsegment").alias("title"), projects(i).alias("projects")))
    skills = some(n(5), lambda i: F.struct(text("skill ", i).alias("name")))
    data = F.when(key % 10 != 0, F.struct(info.alias("personal_info"), schools.alias("education"), jobs.alias("experiences"), skills.alias("skills")))
    return v.table("customer").select(key.alias("user_id"), data.alias("structured_data"), text("raw ", key).alias("raw"), n(7).alias("version"))


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN 'raw ' || c_custkey ELSE array_to_string(list_concat(
  CASE WHEN c_custkey % 11 <> 0 THEN list_filter(['## 个人信息', CASE WHEN c_custkey % 6 <> 0 THEN '姓名: ' || c_name END, CASE WHEN c_custkey % 3 = 1 THEN '邮箱: u' || c_custkey || '@x.org' END], lambda x: x IS NOT NULL) ELSE [] END,
  CASE WHEN c_custkey % 4 > 0 THEN list_concat([chr(10) || '## 教育背景'], list_transform(range(1, c_custkey % 4 + 1), lambda i: '- School ' || i || ' - ' || CASE WHEN i <> 2 THEN 'BSc' ELSE '' END || ' (' || c_mktsegment || ')')) ELSE [] END,
  CASE WHEN c_custkey % 3 > 0 THEN list_concat([chr(10) || '## 工作经历'], flatten(list_transform(range(1, c_custkey % 3 + 1), lambda i: list_concat([chr(10) || '### Company ' || i || ' - ' || c_mktsegment],
    CASE WHEN i > 1 THEN ['- 项目: P1', '  描述: made for ' || c_name] ELSE [] END)))) ELSE [] END,
  CASE WHEN c_custkey % 5 > 0 THEN [chr(10) || '## 技能', array_to_string(list_transform(range(1, c_custkey % 5 + 1), lambda i: 'skill ' || i), ', ')] ELSE [] END), chr(10)) END AS text FROM customer""")
def doc2_interview_brief(v: Views) -> DataFrame:
    return _vault_data(v).select("user_id", D.interview_brief(F.col("structured_data"), F.col("raw")).alias("text"))


@query(MATCH + """SELECT j.job_id, q.pos::INTEGER AS pos, q.kind, CASE WHEN q.pos = 1 THEN 'Describe a problem that you solved with ' || coalesce(t, 'your main tool') || '.' ELSE q.text END AS question
FROM jds j LEFT JOIN (SELECT job_id, min(term) AS t FROM jt GROUP BY 1) m USING (job_id) CROSS JOIN (VALUES (1, 'technical', ''), (2, 'behavioural', 'Tell of a conflict in a team and its end.'), (3, 'project', 'Which project taught you most, and why?'), (4, 'motivation', 'Why this company?'), (5, 'plan', 'What will you have learned in three years?')) q(pos, kind, text)""")
def doc3_base_questions(v: Views) -> DataFrame:
    return D.base_questions(_jds(v))


@query()
def doc4_version_diff(v: Views) -> DataFrame:
    rows = v.table("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("version"), F.col("text").alias("content"))
    return D.version_diff(rows).select("job_id", "version", F.size("segments").alias("n"), F.size(F.filter("segments", lambda s: s["changed"])).alias("n_changed"))


@query("SELECT conv_id AS generation, string_agg(text, '' ORDER BY turn, text) AS text, count(*)::INTEGER AS chunks, CASE WHEN bool_or(role = 'error') THEN 'error' ELSE 'done' END AS status FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def doc5_assemble_chunks(v: Views) -> DataFrame:
    rows = v.table("conversations").filter("text is not null").select(F.col("conv_id").alias("generation"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.col("text").alias("content"))
    return D.assemble_chunks(rows)


# Streams, run over a bounded input


METRICS = """SELECT epoch_us(date_trunc('minute', ts)) AS start_us, path, count(*)::BIGINT AS requests, count(*) FILTER (code >= 500)::BIGINT AS errors, avg(seconds) AS mean_seconds,
 quantile_disc(seconds, 0.95) AS p95_seconds FROM request_log GROUP BY 1, 2"""


@query(METRICS)
def stm2_request_metrics(v: Views) -> DataFrame:
    return request_metrics(v.request_log).select(F.unix_micros("start").alias("start_us"), "path", "requests", "errors", "mean_seconds", "p95_seconds")


@query(f"SELECT * FROM ({METRICS}) WHERE start_us + 60000000 <= (SELECT floor(epoch_us(max(ts)) / 1000) * 1000 - 600000000 FROM request_log)")
def stm2_request_stream(v: Views) -> DataFrame:
    """The stream in append mode over the files that are there: windows that the watermark has passed."""
    folder = f"{shared_folder(v.spark)}/requests_{uuid.uuid4().hex}"
    query_ = write_request_metrics(Views.requests_of(_events(v)), folder, availableNow=True)
    _finish(query_)
    kinds = "start timestamp, path string, requests long, errors long, mean_seconds double, p95_seconds double"
    return v.spark.read.schema(kinds).parquet(f"{folder}/windows").select(F.unix_micros("start").alias("start_us"), "path", "requests", "errors", "mean_seconds", "p95_seconds")


def _events(v: Views) -> DataFrame:
    """A stream over the files of the events; a pattern may name a file or a folder."""
    return v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.dir}/events.parque[t]")


def _finish(query_: StreamingQuery) -> None:
    try:
        query_.awaitTermination()
    finally:
        query_.stop()


STATUS = """SELECT job_id, arg_max(new_status, (changed_at, id)) AS status, count(*)::BIGINT AS changes, epoch_us(min(CASE WHEN new_status = 'applied' THEN changed_at END)) AS applied_us FROM status_events GROUP BY 1"""


@query(STATUS)
def stm1_status_stream(v: Views) -> DataFrame:
    """The stream itself, over the files that are there; every batch's updates are written, the last of each job is its status."""
    folder = f"{shared_folder(v.spark)}/status_{uuid.uuid4().hex}"
    stream = status_stream(Views.status_of(_events(v))).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    _finish(stream.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")).start())
    done = v.spark.read.parquet(f"{folder}/out").groupBy("job_id").agg(F.max_by(F.struct("status", "changes", "applied_at"), "changes").alias("x"))
    return done.select("job_id", "x.status", "x.changes", F.unix_micros("x.applied_at").alias("applied_us"))


def _fed(v: Views) -> StatusTables:
    """Status and history tables, fed by one stream over the files that are there."""
    tables = StatusTables(v.spark, f"{shared_folder(v.spark)}/jobs_{uuid.uuid4().hex}", buckets=16)
    _finish(tables.start(Views.status_of(_events(v)), availableNow=True))
    return tables


@query("""SELECT job_id, arg_max(new_status, (changed_at, id)) AS status, arg_max(id, (changed_at, id)) AS last_id, count(*)::BIGINT AS changes, epoch_us(min(CASE WHEN new_status = 'applied' THEN changed_at END)) AS applied_us,
 epoch_us(min(CASE WHEN new_status = 'interview_scheduled' THEN changed_at END)) AS scheduled_us, epoch_us(min(CASE WHEN new_status IN ('offered', 'rejected') THEN changed_at END)) AS result_us FROM status_events GROUP BY 1""")
def stm1_status_table(v: Views) -> DataFrame:
    rows = _fed(v).current.read()
    return rows.select("job_id", "status", "last_id", "changes", F.unix_micros("applied_at").alias("applied_us"), F.unix_micros("interview_scheduled_at").alias("scheduled_us"), F.unix_micros("final_result_at").alias("result_us"))


@query("SELECT id, job_id, new_status, lag(new_status) OVER (PARTITION BY job_id ORDER BY changed_at, id) AS old_status FROM status_events")
def stm1_status_history(v: Views) -> DataFrame:
    return _fed(v).history().select("id", "job_id", "new_status", "old_status")


@query(STATUS)
def stm1_status_batch(v: Views) -> DataFrame:
    """The batch twin of the status stream (tests hold the two against each other)."""
    rows = v.status_events.groupBy("job_id").agg(F.max_by("new_status", F.struct("changed_at", "id")).alias("status"), F.count("*").alias("changes"), F.min(F.when(F.col("new_status") == "applied", F.col("changed_at"))).alias("applied_at"))
    return rows.select("job_id", "status", "changes", F.unix_micros("applied_at").alias("applied_us"))
