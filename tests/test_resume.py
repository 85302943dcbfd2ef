"""Résumé and document operators against plain versions and worked cases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from jobtide.operators import documents as D
from jobtide.operators import jd as J
from jobtide.operators import resume as R

TEXTS = [
    None, "", "  \n\t", "no heading at all", "姓名 王\n教育背景\n北京大学 2016.09\n\n工作经历：\n某公司\nEngineer\n技能\nPython、Java\n教育经历\nx\n技能清单\ny",
    "教育背景\n教育经历\nA\nB\nC\n教育\nD", "张三\n北京大学 本科\n2016.09 - 2020.06\n\n腾讯公司 工程师\n2020.07-至今\nPython, SQL\n负责推荐项目\nnothing\n2021.1 x", "Experience\nAcme Inc\nProjects and more\nEducation Skills\nz",
    "Skills\n" + "long line " * 4000 + "\nLanguages\nEnglish", "工作经历公司很长的标题不算\n证书\nCET-6\n语言能力\n英语\n奖项荣誉\n一等奖\n自我评价\n好",
]


def one(spark, f, *values):
    kinds = ", ".join(f"c{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values))
    return spark.createDataFrame([values], kinds).select(f(*[F.col(f"c{k}") for k in range(len(values))])).first()[0]


def plain_sections(text):
    lines = (text or "").split("\n")
    found = []
    for n, raw in enumerate(lines):
        line = raw.strip()
        bare = line.replace(" ", "")
        if not line or len(line) > 60 or not 2 <= len(bare) <= 20 or re.search(R.NO_HEADING, line):
            continue
        for kind, words in R.SECTION_WORDS.items():
            if not any(re.search(rf"\b{re.escape(w)}\b", line, re.IGNORECASE) for w in words):
                continue
            if kind == "education" and len(bare) <= 8 and bare.endswith(("大学", "学院", "学校", "University", "College")):
                continue
            if kind == "work_experience" and len(bare) > 8 and any(w in bare for w in ("公司", "集团", "Corp", "Inc", "Ltd", "科技", "网络")):
                continue
            if kind == "projects" and any(w in line for w in ("项目：", "课题：", "《", "》", "负责", "开发")):
                continue
            if not (found and found[-1][1] == kind and n - found[-1][0] <= 2):
                found.append((n, kind, line))
    stops = [n for n, _, _ in found[1:]] + [len(lines)]
    out = [(kind, title, "\n".join(lines[n + 1 : stop]).strip(), n + 1, stop, 0.9) for (n, kind, title), stop in zip(found, stops, strict=bool(found))]
    if out:
        return out
    runs = []
    for n, raw in enumerate(lines):
        line, before = raw.strip(), lines[n - 1] if n else ""
        kind = next((k for k, p in R.LINE_KINDS if line and re.search(p, line)), None)
        if line and not kind and re.search(r"20\d{2}[.\-/年]", line):
            kind = "education" if re.search("大学|学院|学校", before) else "work_experience" if re.search("公司|集团|科技", before) else None
        if kind:
            if not runs or runs[-1][0] != kind:
                runs.append((kind, n, []))
            runs[-1][2].append(line)
    ends = [n for _, n, _ in runs[1:]] + [len(lines)]
    return [(kind, R.SECTION_TITLES[kind], "\n".join(body), n, end, 0.6) for (kind, n, body), end in zip(runs, ends, strict=bool(runs))]


def test_sections(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in R.detect_sections(rows).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for k, text in enumerate(TEXTS):
        assert sorted(got.get(k, []), key=lambda s: s[3]) == sorted(plain_sections(text), key=lambda s: s[3]), text
    assert {"education", "work_experience", "skills"} <= {s[0] for s in got[6]}  # a text without headings


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Python、Java、C++", ["Python", "Java", "C++"]), ("• 熟悉 Python, Java / Go , SQL", ["Python", "Java / Go", "SQL"]), ("Python Java", ["Python Java"]), ("掌握 A1; a1 ；精通", ["A1"]),
        ("技能、12、!!、x、数据 分析", ["数据 分析"]), ("", []), ("js、JS、Vue", ["JavaScript", "Vue"]),
    ],
)
def test_skill_list(spark, text, want):
    assert one(spark, lambda t: R.parse_skill_list(t, {"js": "JavaScript"}), text) == want


def test_combos(spark):
    assert one(spark, lambda t: R.combo_skills(t, {"ps": "Photoshop"}), "会PS/PR PS/PR AB/CD AI/ps") == ["Photoshop", "PR"]


VOC = (("Python", "lang"), ("SQL", "lang"), ("React", "web"), ("团队合作", "soft"), ("Go", "lang"), ("C", "lang"))


def test_skills_are_topped_up_below_five(spark):
    text = "Intro with React\n技能\n精通 Python\n了解 SQL、自学C\n自我评价\nGo"
    got = one(spark, lambda t: R.extract_skills(t, VOC), text)
    assert [(s["name"], s["level"], s["category"]) for s in got] == [("Go", "熟练", "lang"), ("SQL", "入门", "lang"), ("Python", "精通", "lang"), ("React", "熟练", "web")]
    rows = spark.createDataFrame([("精通 Python\n了解 SQL, 自研框架 、 X1", "React 团队合作")], "text string, full string")
    found = {s["name"]: (s["level"], s["category"], s["confidence"]) for s in R.rule_skills(rows, VOC, {}, "text", "full").first()["skills"]}
    assert found["Python"] == ("精通", "lang", 0.85) and found["SQL"] == ("入门", "lang", 0.85) and found["React"][2] == 0.7


def test_entries_and_paragraphs(spark):
    content = "2016.09 - 2020.06 北京大学 计算机科学 本科 GPA: 3.8\n\n2020.09 - 至今 清华大学 专业: 数学 硕士\n\nno school"
    got = one(spark, R.education_paragraphs, content)
    assert [(e["school"], e["degree"], e["field"], e["start_date"], e["end_date"], e["gpa"]) for e in got] == [("北京大学", "本科", "北京大学", "2016", "", "3.8"), ("清华大学", "硕士", "数学", "2020", "至今", None)]
    work = one(spark, R.work_paragraphs, "2020.01-至今 字节跳动 职位: 高级工程师\n\nTiny Shop\nbaker")
    assert [(e["company"], e["title"], e["end_date"]) for e in work] == [("字节跳动", "高级工程师", "至今"), ("Tiny Shop", "", "")]
    projects = one(spark, R.project_paragraphs, "《推荐系统》\n角色: 后端\n\n•Search\n负责核心引擎开发")
    assert [(p["name"], p["role"]) for p in projects] == [("推荐系统》", "后端"), ("Search", "负责核心引擎开发")]
    assert one(spark, R.section_entries, "a 2016.01 b 2017-02 c") == ["a", "2016.01 b", "2017-02 c"]
    assert one(spark, R.section_entries, "x•y•z") == ["x", "•y", "•z"]


def test_contacts(spark):
    got = one(spark, R.contacts, "邮箱test@example.com丨linkedin.com/profile?id=me-1 0571-1234567 https://linkedin.com/x https://a.github.io/b")
    assert tuple(got) == ("test@example.com", "0571-1234567", "https://linkedin.com/in/me-1", "https://a.github.io/b")
    assert tuple(one(spark, R.contacts, "nothing")) == (None, None, None, None)


@pytest.mark.parametrize(("text", "want"), [("姓名：张三\n", "张三"), ("x\n李四\n", "李四"), ("王五 John\n", "王五"), ("Ann Lee\nfoo", "Ann Lee"), ("某某某公司招\n@", None), ("某公司\n@", "某公司"), ("", None)])
def test_name(spark, text, want):
    assert one(spark, R.person_name, text) == want


def test_merging_fills_blanks_and_skips_dropped_entries(spark):
    entries = "array(named_struct('name','A1','title',null,'start_date',''), named_struct('name','a1','title','T','start_date','2020'), named_struct('name','B','title','','start_date','x'))"
    got = spark.sql(f"select {entries} e").select(R.merge_similar_entries(F.col("e"), ("name", "title", "start_date"))).first()[0]
    assert [tuple(e) for e in got] == [("A1", "T", "2020"), ("B", "", "x")]
    rows = spark.sql("select array(named_struct('name','A','start_date','','description','x','technologies',array('b')), named_struct('name','AB','start_date','','description',null,'technologies',array('a')), named_struct('name','C','start_date','','description',repeat('z',60),'technologies',null)) e")
    merged = rows.select(R.merge_projects(F.col("e"))).first()[0]
    assert [(p["name"], p["description"][:3], p["technologies"]) for p in merged] == [("A", "x\n", ["a", "b"]), ("C", "zzz", None)]


def test_quality(spark):
    full = spark.sql("""select 1 doc_id, named_struct('name','A','email','e','phone',null,'confidence',0.9D) personal_info, array(named_struct('school','S','confidence',0.4D)) education,
      array(named_struct('company','','confidence',0.8D)) work_experience, cast(array() as array<struct<name:string,confidence:double>>) projects, array(named_struct('name','x','confidence',0.7D)) skills""")
    r = R.quality_report(R.quality_scores(full)).first()
    assert r["accuracy"] == pytest.approx((0.9 + 0.4 + 0.7) / 3) and r["confidence"] == pytest.approx((0.9 + 0.4 + 0.8 + 0.7) / 4)
    assert r["completeness"] == pytest.approx(0.2 * 2 / 3 + 0.125 + 0.125 + 0.04)
    assert r["issues"] == ["识别的技能数量较少", "以下字段置信度较低: 教育经历: S"] and r["low_confidence"] == ["education[0]"] and r["needs_review"] and r["valid"]
    assert (r["field_scores"]["education"], r["field_scores"]["work_experience"], r["field_scores"]["projects"]) == (0.4, 0.0, None)


@pytest.mark.parametrize(("text", "want"), [("可远程办公\n北京", "远程/居家办公"), ("地点 上海\n北京 苏州 杭州 南京", "上海、北京、杭州"), ("Location: Mars", "Mars"), ("x", None)])
def test_location(spark, text, want):
    got = one(spark, J.jd_location, text)
    assert (got and got["value"]) == want


@pytest.mark.parametrize(("text", "want"), [("要求 3年以上", "3-5年"), ("不限经验", "经验不限"), ("3年以上经验", "3年以上"), ("2-4年经验", "2年以上"), ("x", None)])
def test_experience(spark, text, want):
    got = one(spark, J.jd_experience, text)
    assert (got and got["value"]) == want


def test_segments():
    got = D.segments("a\nb\nc", "a\nx\nc\nd")
    assert [(s["changed"], s["old"], s["new"]) for s in got] == [(False, "a", "a"), (True, "b", "x"), (False, "c", "c"), (True, "", "d")]
    assert D.segments("x\n" * 600, "y\n" * 600) == [{"changed": True, "old": "x\n" * 600, "new": "y\n" * 600}]
    assert [s["changed"] for s in D.segments("same", "same")] == [False]


def test_draft_from_facts(spark):
    row = spark.sql("""select named_struct('personal_info', named_struct('name','A','email','e','phone',''), 'summary','', 'skills', array(named_struct('name','Go'), named_struct('name','Python')),
      'experiences', array(named_struct('company','C','title','T','start_date','2020','end_date','','description','did','projects',array('P'))), 'education', cast(array() as array<struct<school:string,degree:string,field:string,start_date:string,end_date:string>>)) d""")
    text = row.select(D.render_resume(F.col("d"), F.array(F.lit("python")))).first()[0]
    assert text == "# A\n\ne\n\n## 技能\n\nPython、Go\n\n## 工作经历\n\n### C · T\n\n2020\n\ndid\n\n**P**"


VAULT = """struct<personal_info:struct<name:string,email:string>,education:array<struct<school:string,degree:string,field:string>>,
 experiences:array<struct<company:string,title:string,projects:array<struct<name:string,description:string>>>>,skills:array<struct<name:string>>>"""


def test_interview_brief(spark):
    whole = (("Ann", "a@x.org"), [("MIT", None, "CS")], [("Acme", "Dev", [("P1", "made"), ("P2", None)]), ("B", None, None)], [("Python",), ("SQL",)])
    rows = [(1, whole), (2, None), (3, (None, [], [], [])), (4, ((None, ""), None, None, None))]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, f"k int, d {VAULT}").select("k", D.interview_brief(F.col("d"), F.lit("raw")).alias("t")).collect()}
    assert got[1] == (
        "## 个人信息\n姓名: Ann\n邮箱: a@x.org\n\n## 教育背景\n- MIT -  (CS)\n\n## 工作经历\n\n### Acme - Dev\n- 项目: P1\n  描述: made\n- 项目: P2\n  描述: \n\n### B - \n\n## 技能\nPython, SQL"
    )
    assert (got[2], got[3], got[4]) == ("raw", "", "## 个人信息")


def test_long_lines_are_gone_through_once(spark):
    """A line with a key word that no pattern takes costs as much as its length, not its square; what follows it is still found."""
    long = "words and " * 8_000
    entries = [f"no schooling\n{long}\n{long}School of Arts and Law, Bachelor 2016 - 2020", f"no schooling {long}", "某某学院 大专"]
    rows = spark.createDataFrame([(entries, [f"Acme Inc\n-engineer {long}\nTitle: Senior Data Engineer", f"{long}, Inc"])], "e array<string>, w array<string>").coalesce(1)
    start = time.monotonic()
    got = rows.select(R.parse_education(F.col("e")).alias("e"), R.parse_experience(F.col("w")).alias("w")).first()
    assert time.monotonic() - start < 20
    assert [(x["school"], x["degree"]) for x in got["e"]] == [("某某学院", "专科")]
    assert [(x["company"], x["title"]) for x in got["w"]] == [("Acme Inc", "Senior Data Engineer")]


def test_runs_begin_where_any_match_does(spark):
    """The patterns of RUNS, tried at the beginnings of their runs alone, give what they give when tried everywhere."""
    rnd = random.Random(4)
    bits = ("School", " of ", " Arts", ",", "\n", " ", "-", "College\t", "公司", "Inc", "Senior", "Engineer", "Manager ", "𝄞", "\r", "\x85", "Développeur", "3")
    patterns = [p for p in (*R.SCHOOLS, *R.COMPANIES, *R.TITLES, r"([^\n]*?经理[^\n]{0,10})") if any(p.startswith(x) for x in R.RUNS)]
    assert len(patterns) == 4
    rows = spark.createDataFrame([("".join(rnd.choice(bits) for _ in range(rnd.choice((3, 9, 30)))) + rnd.choice(("", "经理")),) for _ in range(400)], "t string")
    for p in patterns:
        behind = next(y for x, y in R.RUNS.items() if p.startswith(x))
        one, other = (F.regexp_extract("t", "(?iU)" + x + p, 1) for x in ("", behind))
        assert rows.filter(one != other).count() == 0
        assert rows.filter(one != "").count() > 20


def test_vault_card(spark):
    data = [(1, 3, (("Ann", None), [("MIT", None, None)], [("Acme", "Dev", None), ("B", "x", None)], [(f"s{k}",) for k in range(10)])), (2, None, ((None, None), [], [], []))]
    rows = D.vault_card(spark.createDataFrame(data, f"user_id int, version int, structured_data {VAULT}")).collect()
    assert tuple(rows[0]) == (1, "Ann", "Dev", "Acme", [f"s{k}" for k in range(8)], 2, 1, 3)
    assert tuple(rows[1]) == (2, None, None, None, [], 0, 0, None)


GOLD = """王小明
电话：13812345678
邮箱：wang@example.com

教育背景
北京大学 计算机科学 本科 2016 - 2020

工作经历
某某科技有限公司, 高级工程师 2020.07-至今
项目:推荐系统重构
负责系统

技能
Python、Redis，精通Python。
"""


def test_structured_resume_is_the_one_written_by_hand(spark):
    voc = (("Python", "lang"), ("Redis", "db"), ("Go", "lang"))
    rows = spark.createDataFrame([(1, GOLD), (2, None), (3, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in R.structure_resumes(rows, voc).collect()}
    r = got[1]
    assert (r["personal_info"]["name"], r["personal_info"]["contacts"]["email"], r["personal_info"]["contacts"]["phone"]) == ("王小明", "wang@example.com", "13812345678")
    assert [(e["school"], e["degree"], e["start_date"], e["end_date"]) for e in r["education"]] == [("北京大学", "本科", "2016", "2020")]
    assert [(e["company"], e["projects"]) for e in r["experiences"]] == [("某某科技有限公司", ["推荐系统重构"])]
    assert [(s["name"], s["level"], s["category"]) for s in r["skills"]] == [("Redis", "精通", "db"), ("Python", "精通", "lang")]
    assert r["raw_text_preview"] == GOLD
    for k in (2, 3):
        assert (got[k]["personal_info"]["name"], got[k]["education"], got[k]["experiences"], got[k]["skills"], got[k]["raw_text_preview"]) == (None, [], [], [], "")


def test_accuracy_against_gold(spark):
    kind = "doc_id int, name string, phone string, email string, education_count int, work_count int, skill_count int, project_count int"
    gold = spark.createDataFrame([(1, "Ann", "1", "a@x", 2, 1, 4, 0), (2, "Bob", None, "b@x", 1, 1, 1, 1), (3, "Eve", "3", "e@x", 1, 0, 0, 0)], kind)
    found = spark.createDataFrame([(1, "Ann", "2", "a@x", 1, 3, 1, 5), (2, "bob", None, None, 1, 0, 2, 1)], kind)
    rows = {r["doc_id"]: r for r in D.extraction_accuracy(found, gold).collect()}
    assert tuple(rows[1])[1:-1] == (1.0, 0.0, 1.0, 0.5, 1.0, 0.25, 1.0) and rows[1]["score"] == pytest.approx(4.75 / 7)
    assert tuple(rows[2])[1:-1] == (0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0)
    assert set(tuple(rows[3])[1:]) == {0.0}  # not extracted at all
    means = {r["field"]: (r["mean"], r["low"]) for r in D.accuracy_summary(D.extraction_accuracy(found, gold)).collect()}
    assert means["name"] == (pytest.approx(1 / 3), True) and means["education_count"] == (0.5, True) and means["project_count"] == (pytest.approx(2 / 3), True)
