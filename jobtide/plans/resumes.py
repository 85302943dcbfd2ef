"""Queries of the résumé operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators import documents as D
from jobtide.operators import resume as R
from jobtide.plans.book import query
from jobtide.plans.forms import forms, forms_sql
from jobtide.plans.matching import TECH
from jobtide.sources.views import Views

#: The lines of a résumé; the forms reach every branch of the rules.
RESUME = (
    ("姓名: 王小明", "Name: Ann Lee", "李雷", "Notes of #", "张三 John", "@#"),
    ("user#@example.com | 13812345678", "邮箱name#@x.org丨 010-1234567", "linkedin.com/in/u-# https://u#.github.io/cv", ""),
    ("教育经历", "学历: ", ""),
    ("2016.09 - 2020 北京大学 计算机专业 本科", "清华大学 硕士: 数学", "2018-2022 Some College of Arts, Bachelor", "2015年9月 - 2019年 某某学院 大专\n2019.09-至今 另一所大学 博士", "no schooling"),
    ("工作经历", "Experience", ""),
    ("2020.01 - 至今 第三网络公司\n职位: 架构师\n项目: Alpha #\nProject: Beta", "Acme Inc\nSenior Data Engineer", "09/2018 - 06/2021 某某集团 经理", "freelance"),
    ("专业技能", "技能: ", ""),
    ("精通the、and、of", "了解 that, with", "basic: the"),
)
#: Résumés with their lines, and the section and the entries of two kinds in them.
_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_some = lambda words: "|".join(w.replace(".", "\\.") for w in words)
_next = R.NEXT_SECTION.replace("(?iU)", "(?i)")


def _section(name: str, words: tuple[str, ...]) -> str:
    heading = f"regexp_matches(x, '{_some(words)}') AND (len(x) < 30 OR regexp_matches(x, '[=:：-]'))"
    return f"""{name}_at AS (SELECT doc_id, text, ls, nullif(list_position(list_transform(ts, lambda x: {heading}), true), 0) AS p, ts FROM res),
{name}_cut AS (SELECT *, nullif(list_position(list_transform(ts, lambda x, i: i > p AND regexp_matches(x, '{_next}')), true), 0) AS q FROM {name}_at),
{name} AS (SELECT doc_id, text, CASE WHEN p IS NOT NULL THEN array_to_string(ls[p + 1 : coalesce(q, len(ls) + 1) - 1], chr(10)) END AS section FROM {name}_cut)"""


def _entries(name: str, words: tuple[str, ...]) -> str:
    begins = f"(regexp_matches(x, '{_some(words)}') AND (len(x) < 80 OR regexp_matches(x, '^.{{0,39}}({_some(words)})')) OR regexp_matches(x, '(?i)^(?:\\d{{4}}[.\\-/年]|20\\d{{2}}\\s*[\\-–~]\\s*(?:20\\d{{2}}|至今|Present))'))"
    lines = f"list_filter(list_transform(string_split(coalesce(nullif(section, ''), text), chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"
    return f"""{name}_entries AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(array_to_string(list_transform({lines}, lambda x: CASE WHEN {begins} THEN chr(1) || x ELSE x END), chr(10)), '^\\x01', ''), chr(10) || chr(1)), lambda x: x <> '') AS es
  FROM {name})"""


RES = f""", res AS (
  SELECT doc_id, user_id, text, string_split(text, chr(10)) AS ls, list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}) AS ts
  FROM (SELECT doc_id, user_id, concat_ws(chr(10), {forms_sql(RESUME, 'doc_id')}, text) AS text FROM resumes)),
{_section('edu', R.EDUCATION_HEADINGS)}, {_section('work', R.WORK_HEADINGS)}, {_entries('edu', R.SCHOOL_WORDS)}, {_entries('work', R.COMPANY_WORDS)}
"""


def _resume_texts(v: Views) -> DataFrame:
    """Résumés: the driver's texts under the lines of a résumé."""
    return v.resumes.select("doc_id", "user_id", F.concat_ws("\n", *forms(RESUME, F.col("doc_id")), "text").alias("text"))


VOC = tuple((t, c) for t, c in dict(reversed(TECH)).items())


def _structured(v: Views) -> DataFrame:
    """Vaults with structured data, from the extraction job itself."""
    rows = R.structure_resumes(_resume_texts(v), VOC)
    jobs = F.transform("experiences", lambda e: F.struct(e["company"].alias("company"), e["title"].alias("title"), e["start_date"].alias("start_date"), e["end_date"].alias("end_date"), F.lit("").alias("description"), e["projects"].alias("projects")))
    info = F.struct(F.col("personal_info.name").alias("name"), F.col("personal_info.contacts.email").alias("email"), F.col("personal_info.contacts.phone").alias("phone"))
    data = F.struct(info.alias("personal_info"), "education", jobs.alias("experiences"), "skills", F.substring("raw_text_preview", 1, 80).alias("summary"))
    return rows.select(F.col("doc_id").alias("user_id"), F.lit(1).alias("version"), data.alias("structured_data"), F.col("raw_text_preview").alias("raw"))


_of = lambda p, g=0: f"nullif(regexp_extract(text, '{p}', {g}), '')"
_address = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z|]{2,}"


@query(RES + f"""SELECT doc_id, coalesce(nullif(regexp_extract(translate(text, '丨|/', '   '), '(?:^|[^\\p{{L}}\\p{{N}}_.%+-])[.%+-]*([A-Za-z0-9_]*{_address})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ''), {_of(_address)}) AS email,
 coalesce({_of('1[3-9][0-9]{9}')}, {_of('[0-9]{3,4}-[0-9]{7,8}')}) AS phone, 'https://linkedin.com/in/' || {_of('(?i)(?:linkedin.com/in/|linkedin.com/profile[?]id=)([a-zA-Z0-9_-]+)', 1)} AS linkedin,
 coalesce({_of('(?i)https?://[^ \\t\\n\\r]+(?:github[.]io|vercel[.]app|netlify[.]app|gitee[.]io)[^ \\t\\n\\r]*')}, {_of('(?i)https?://[^ \\t\\n\\r]+blog[.]csdn[.]net[^ \\t\\n\\r]*')}) AS website FROM res""")
def rsm1_contacts(v: Views) -> DataFrame:
    return _resume_texts(v).select("doc_id", R.contacts(F.col("text")).alias("c")).select("doc_id", "c.*")


_free = lambda x: f"{x} NOT IN ({', '.join(repr(n) for n in R.NO_NAMES)})"
_label = "(?i)(?:姓名|名字|Name)[\\s:：]*"
_labelled = [_trim(f"regexp_extract(text, '{_label}{p}', 1)") for p in ("([一-龥]{2,4}(?:·[一-龥]+)?)", "([A-Za-z\\s.]+[一-龥]*|[一-龥]+[A-Za-z\\s]*)")]
_mixed = f"coalesce(nullif({_trim('regexp_extract(x, $$^([一-龥]{2,4})\\s*[A-Za-z\\s]*$$$, 1)')}, ''), {_trim('regexp_extract(x, $$^([A-Za-z\\s]+)\\s*[一-龥]{2,4}$$$, 1)')})".replace("$$$", "$'").replace("$$", "'")


@query(RES + f"""SELECT doc_id, coalesce({', '.join(f"CASE WHEN len({x}) BETWEEN 2 AND 20 AND {_free(x)} THEN {x} END" for x in _labelled)},
 list_filter(ts[1:30], lambda x: regexp_full_match(x, '[一-龥]{{2,4}}') AND {_free('x')} AND NOT regexp_matches(x, '工程师|经理|主管|总监|公司|科技|有限'))[1],
 list_filter(list_transform(ts[1:20], lambda x: {_mixed}), lambda x: x <> '' AND {_free('x')} AND len(x) <= 20)[1],
 CASE WHEN len(ts[1]) BETWEEN 1 AND 29 AND NOT regexp_matches(ts[1], '@|http|电话|手机|：|:|公司|集团|科技|网络|软件|互联网|简历|求职|应聘') AND {_free('ts[1]')} THEN ts[1] END) AS name,
 list_filter(ts[1:15], lambda x: regexp_full_match(x, '[一-龥]{{2,4}}') OR regexp_full_match(x, '[A-Za-z]+(\\s+[A-Za-z]+)*'))[1] AS line_name FROM res""")
def rsm2_person_name(v: Views) -> DataFrame:
    return _resume_texts(v).select("doc_id", R.person_name(F.col("text")).alias("name"), R.name_line(F.col("text"))["name"].alias("line_name"))


@query(RES + "SELECT doc_id, md5(edu.section) AS education, md5(work.section) AS work FROM edu JOIN work USING (doc_id)")
def rsm3_find_section(v: Views) -> DataFrame:
    part = lambda words: F.md5(R.find_section(F.col("text"), words))
    return _resume_texts(v).select("doc_id", part(R.EDUCATION_HEADINGS).alias("education"), part(R.WORK_HEADINGS).alias("work"))


def _entry_arrays(v: Views) -> DataFrame:
    part = lambda words: F.coalesce(F.nullif(R.find_section(F.col("text"), words), F.lit("")), F.col("text"))
    return _resume_texts(v).select("doc_id", R.split_entries(part(R.EDUCATION_HEADINGS), R.SCHOOL_WORDS).alias("schools"), R.split_entries(part(R.WORK_HEADINGS), R.COMPANY_WORDS).alias("companies"))


@query(RES + "SELECT doc_id, len(edu_entries.es)::INTEGER AS n_schools, len(work_entries.es)::INTEGER AS n_companies, md5(work_entries.es[1]) AS first FROM edu_entries JOIN work_entries USING (doc_id)")
def rsm4_split_entries(v: Views) -> DataFrame:
    return _entry_arrays(v).select("doc_id", F.size("schools").alias("n_schools"), F.size("companies").alias("n_companies"), F.md5(F.get("companies", F.lit(0))).alias("first"))


_e = lambda p, least, most, cut="": f"CASE WHEN len({_x(p, cut)}) BETWEEN {least} AND {most} THEN {_x(p, cut)} END"
_x = lambda p, cut="": (f"regexp_replace({_trim(_raw(p))}, '(?i)^(?:{cut})[:\\s]*', '')" if cut else _trim(_raw(p)))
_raw = lambda p: f"regexp_extract(e, '(?i){p}', 1)"
_d = lambda k, g: f"regexp_extract(e, '(?i){R.DATES[k]}', {g})"
_hit = lambda k: f"regexp_matches(e, '(?i){R.DATES[k]}')"
_school_end = lambda x: f"CASE WHEN regexp_matches({x}, '至今|Present') THEN '至今' WHEN regexp_matches({x}, '^20[0-9][0-9]') THEN {x} ELSE '' END"
_degree = " ".join(f"WHEN regexp_matches(e, '{_some(words)}') THEN '{name}'" for name, words in R.DEGREES.items())


@query(RES + f""", parsed AS (
 SELECT doc_id, k, coalesce({', '.join(_e(p, 3, 59) for p in R.SCHOOLS)}, '') AS school, CASE {_degree} ELSE '' END AS degree,
  coalesce({', '.join(f"CASE WHEN {_x(p)} NOT IN ('专业', '学位') THEN {_e(p, 2, 29)} END" for p in R.STUDIES)}, '') AS field,
  CASE WHEN {_hit(0)} THEN {_d(0, 1)} WHEN {_hit(1)} THEN {_d(1, 1)} WHEN {_hit(2)} THEN {_d(2, 1)} ELSE '' END AS start_date,
  CASE WHEN {_hit(0)} THEN {_school_end(_d(0, 4))} WHEN {_hit(1)} THEN {_school_end(_d(1, 2))} WHEN {_hit(2)} THEN {_school_end(_d(2, 2))} ELSE '' END AS end_date
 FROM (SELECT doc_id, unnest(es[1:10]) AS e, unnest(range(least(len(es), 10))) AS k FROM edu_entries))
SELECT doc_id, (row_number() OVER w)::INTEGER AS pos, md5(school) AS school, degree, field, start_date, end_date FROM parsed WHERE school <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k) QUALIFY row_number() OVER w <= 5""")
def rsm5_parse_education(v: Views) -> DataFrame:
    rows = _entry_arrays(v).select("doc_id", F.posexplode(R.parse_education(F.col("schools"))).alias("pos", "e"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("pos"), F.md5("e.school").alias("school"), "e.degree", "e.field", "e.start_date", "e.end_date")


_titles = [*(_e(p, 2, 49, "职位|岗位|职务") for p in R.TITLES), *(_e(f"([^\\n]*?{w}[^\\n]{{0,10}})", 3, 39) for w in R.TITLE_WORDS)]


@query(RES + f""", parsed AS (
 SELECT doc_id, k, coalesce({', '.join(_e(p, 3, 79, '公司|单位') for p in R.COMPANIES)}, '') AS company, coalesce({', '.join(_titles)}, '') AS title,
  CASE WHEN {_hit(0)} THEN {_d(0, 1)} WHEN {_hit(1)} THEN {_d(1, 1)} WHEN {_hit(2)} THEN {_d(2, 1)} WHEN {_hit(3)} THEN {_d(3, 2)} ELSE '' END AS start_date,
  CASE WHEN {_hit(0)} THEN CASE WHEN lower({_d(0, 4)}) IN ('至今', 'present') THEN '至今' ELSE '' END WHEN {_hit(1)} OR {_hit(2)} THEN '' WHEN {_hit(3)} THEN {_d(3, 4)} ELSE '' END AS end_date,
  list_filter(list_transform(regexp_extract_all(e, '(?i)(?:项目|Project)[:\\s]*([^\\n]+)', 1), lambda x: {_trim('x')}), lambda x: len(x) BETWEEN 2 AND 49)[1:3] AS projects
 FROM (SELECT doc_id, unnest(es[1:15]) AS e, unnest(range(least(len(es), 15))) AS k FROM work_entries))
SELECT doc_id, (row_number() OVER w)::INTEGER AS pos, md5(company) AS company, md5(title) AS title, start_date, end_date, array_to_string(projects, ';') AS projects FROM parsed WHERE company <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k) QUALIFY row_number() OVER w <= 10""")
def rsm6_parse_experience(v: Views) -> DataFrame:
    rows = _entry_arrays(v).select("doc_id", F.posexplode(R.parse_experience(F.col("companies"))).alias("pos", "e"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("pos"), F.md5("e.company").alias("company"), F.md5("e.title").alias("title"), "e.start_date", "e.end_date", F.array_join("e.projects", ";").alias("projects"))


@query()
def rsm7_extract_skills(v: Views) -> DataFrame:
    return _resume_texts(v).select("doc_id", F.array_join(F.transform(R.extract_skills(F.col("text"), VOC), lambda s: F.concat_ws(":", s["name"], s["level"])), ",").alias("skills"))


_says = lambda level: f"regexp_matches(said, '{_some(R.LEVELS[level])}')"


@query(RES + f"""SELECT doc_id, CASE WHEN {_says('精通')} THEN '精通' WHEN {_says('入门')} THEN '入门' ELSE '熟练' END AS level
FROM (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[。\\n]'), lambda s: contains(s, 'the')), chr(10)) AS said FROM res)""")
def rsm8_skill_level(v: Views) -> DataFrame:
    return _resume_texts(v).select("doc_id", R.skill_level(F.col("text"), F.lit("The")).alias("level"))


@query()
def rsm9_structure_resumes(v: Views) -> DataFrame:
    rows = R.structure_resumes(_resume_texts(v), VOC)
    return rows.select("doc_id", F.col("personal_info.name").alias("name"), F.size("education").alias("n_education"), F.size("experiences").alias("n_experiences"), F.size("skills").alias("n_skills"), F.md5("raw_text_preview").alias("preview"))


@query()
def rsm10_detect_sections(v: Views) -> DataFrame:
    rows = R.detect_sections(_resume_texts(v)).unionByName(R.detect_sections(v.resumes.select((-F.col("doc_id") - 1).alias("doc_id"), "text")))  # with and without headings
    return rows.select("doc_id", "section_type", "title", F.md5("content").alias("content"), "start_line", "end_line", "confidence")


#: Sections: the driver's texts as content of three types in turn.
FIXED = f""", s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'education' WHEN 1 THEN 'work_experience' ELSE 'projects' END AS kind, text AS content FROM res),
f AS (SELECT *, regexp_matches(content, '大学|学院|学校|University|College|Institute|本科|硕士|博士|学士|Bachelor|Master|PhD') AS school, regexp_matches(content, '公司|集团|Corp|Inc|Ltd') AS company,
 regexp_matches(content, '公司|集团|Corp|Inc|Ltd|科技|网络|工程师|经理|主管|总监|开发|Engineer|Manager') AS post, regexp_matches(content, '项目|课题|Project|负责|开发|设计|实现') AS project,
 len(list_filter(['大学', '学院', '本科', '硕士', '博士'], lambda w: contains(content, w))) AS schools FROM s)"""


@query(RES + FIXED + """SELECT doc_id, CASE WHEN kind = 'education' AND NOT school AND company THEN 'work_experience' WHEN kind = 'work_experience' AND post AND schools >= 2 THEN 'education' ELSE kind END AS section_type,
 CASE WHEN kind = 'education' AND NOT school AND NOT company OR kind = 'work_experience' AND NOT post OR kind = 'projects' AND NOT project THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM f""")
def rsm11_fix_section_type(v: Views) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("education", "work_experience", "projects"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = _resume_texts(v).select("doc_id", kind.alias("section_type"), F.col("text").alias("content"), F.lit(0.9).alias("confidence"))
    return R.fix_section_type(rows).select("doc_id", "section_type", "confidence")


@query()
def rsm12_section_entries(v: Views) -> DataFrame:
    text = F.col("text")
    return _resume_texts(v).select(
        "doc_id", F.size(R.section_entries(text)).alias("n"), F.md5(F.to_json(R.education_paragraphs(text))).alias("education"), F.md5(F.to_json(R.work_paragraphs(text))).alias("work"),
        F.md5(F.to_json(R.project_paragraphs(text))).alias("projects"),
    )


@query()
def rsm13_parse_skill_list(v: Views) -> DataFrame:
    return _resume_texts(v).select("doc_id", F.array_join(R.parse_skill_list(F.col("text"), {"the": "The"}), "|").alias("skills"))


COMBO = {"com": "commerce", "ps": "Photoshop", "ab": "Alpha Beta"}


@query(f"""SELECT page_id, array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all('PS/AB ' || upper(url) || ' AI/X', '\\b[A-Z]{{1,3}}/[A-Z]{{1,3}}\\b'), lambda m: string_split(m, '/'))),
 lambda x: coalesce(CASE lower(x) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COMBO.items())} END, CASE WHEN x IN ('PS', 'PR', 'AI', 'AE', 'LR', 'AU', 'CAD') THEN x END)), lambda x: x IS NOT NULL), ',') AS names FROM pages""")
def rsm14_combo_skills(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.array_join(R.combo_skills(F.concat(F.lit("PS/AB "), F.upper("url"), F.lit(" AI/X")), COMBO), ",").alias("names"))


@query()
def rsm15_rule_skills(v: Views) -> DataFrame:
    section = R.find_section(F.col("text"), R.SKILL_HEADINGS)
    rows = R.rule_skills(_resume_texts(v).withColumn("section", section), VOC, {"the": "the"}, "section", "text")
    return rows.select("doc_id", F.array_join(F.transform("skills", lambda s: F.concat_ws(":", s["name"], s["level"], s["category"], s["confidence"].cast("string"))), "|").alias("skills"))


@query("SELECT job_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[•\\-*・]', ''))), lambda x: x <> '' AND len(x) < 100))::INTEGER AS n FROM jds")
def rsm16_plain_items(v: Views) -> DataFrame:
    return v.jds.select("job_id", F.size(R.plain_items(F.col("text"), 100)).alias("n"))


def _projects(v: Views) -> DataFrame:
    name = F.concat(F.lit("Project "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"), F.col("l_partkey").cast("string"))
    project = F.struct(name.alias("name"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy").alias("start_date"), F.repeat(F.lit("done "), F.col("l_quantity").cast("int")).alias("description"), F.array("l_shipmode" if "l_shipmode" in v.table("lineitem").columns else "l_returnflag").alias("technologies"))
    rows = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), project.alias("e")))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: x["e"]).alias("entries"))


@query()
def rsm17_merge_projects(v: Views) -> DataFrame:
    rows = _projects(v).select("l_orderkey", F.size("entries").alias("n"), R.merge_projects(F.col("entries")).alias("m"))
    return rows.select("l_orderkey", "n", F.size("m").alias("n_merged"), F.array_join(F.transform("m", lambda p: F.concat_ws(":", p["name"], F.array_join(p["technologies"], "+"))), ",").alias("merged"))


@query()
def rsm18_merge_similar_entries(v: Views) -> DataFrame:
    named = F.transform("entries", lambda e: F.struct(e["name"].alias("name"), F.lit("").alias("title"), F.when(F.length(e["name"]) % 2 == 0, e["start_date"]).alias("start_date")))
    rows = _projects(v).select("l_orderkey", R.merge_similar_entries(named, ("name", "title", "start_date")).alias("m"))
    return rows.select("l_orderkey", F.size("m").alias("n"), F.array_join(F.transform("m", lambda e: F.concat_ws(":", e["name"], e["start_date"])), ",").alias("merged"))


def _graded(v: Views) -> DataFrame:
    """Résumés as the quality rules want them, from the extraction job."""
    rows = R.structure_resumes(_resume_texts(v), VOC)
    sure = lambda x, c: F.when(F.length(x) % 3 == 0, F.lit(0.4)).otherwise(F.lit(c))
    info = F.struct(F.col("personal_info.name").alias("name"), F.col("personal_info.contacts.email").alias("email"), F.col("personal_info.contacts.phone").alias("phone"), F.when(F.col("personal_info.name").isNotNull(), sure(F.col("personal_info.name"), 0.9)).otherwise(0.0).alias("confidence"))
    return rows.select(
        "doc_id", info.alias("personal_info"), F.transform("education", lambda e: F.struct(e["school"].alias("school"), sure(e["school"], 0.85).alias("confidence"))).alias("education"),
        F.transform("experiences", lambda e: F.struct(e["company"].alias("company"), sure(e["company"], 0.8).alias("confidence"))).alias("work_experience"),
        F.transform(F.flatten(F.transform("experiences", lambda e: e["projects"])), lambda p: F.struct(p.alias("name"), F.lit(0.75).alias("confidence"))).alias("projects"),
        F.transform("skills", lambda s: F.struct(s["name"].alias("name"), F.lit(0.85).alias("confidence"))).alias("skills"),
    )


@query()
def rsm19_quality_scores(v: Views) -> DataFrame:
    return R.quality_scores(_graded(v)).select("doc_id", "accuracy", "completeness", "confidence", "overall", "field_scores.*")


@query()
def rsm20_quality_report(v: Views) -> DataFrame:
    rows = R.quality_report(R.quality_scores(_graded(v)))
    return rows.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("issues", "suggestions", "low_confidence")], "needs_review", "valid")


#: What the forms of a résumé say, as gold.
def _gold(v: Views) -> DataFrame:
    lines = forms(RESUME, F.col("doc_id"))
    name = F.coalesce(F.nullif(F.regexp_extract(lines[0], "(王小明|Ann Lee|李雷|张三)", 1), F.lit("")), F.lit("-"))
    email = F.regexp_extract(lines[1], r"(?:user|name)\d+@[a-z.]+", 0)
    return v.resumes.select("doc_id", name.alias("name"), F.regexp_extract(lines[1], r"13812345678|010-1234567", 0).alias("phone"), email.alias("email"), F.lit(1).alias("education_count"), F.lit(1).alias("work_count"), F.lit(2).alias("skill_count"), F.lit(0).alias("project_count"))


@query()
def agg19_extraction_accuracy(v: Views) -> DataFrame:
    rows = R.structure_resumes(_resume_texts(v), VOC)
    counts = [F.size("education").alias("education_count"), F.size("experiences").alias("work_count"), F.size("skills").alias("skill_count"), F.lit(0).alias("project_count")]
    found = rows.select("doc_id", F.col("personal_info.name").alias("name"), F.col("personal_info.contacts.phone").alias("phone"), F.col("personal_info.contacts.email").alias("email"), *counts)
    return D.extraction_accuracy(found, _gold(v))


@query()
def agg19_accuracy_by_field(v: Views) -> DataFrame:
    return D.accuracy_summary(agg19_extraction_accuracy(v))
