"""Worked cases of term matching and extraction."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobtide.functions import scan
from jobtide.functions import text as T
from jobtide.operators import grounding as G
from jobtide.operators import jd as J
from jobtide.operators import lexicon as L
from jobtide.operators import resume as R

VOC = (("Python", "core_tech", 3.0), ("React", "framework", 2.5), ("Docker", "tool", 1.5), ("Git", "tool", 1.5), ("Kubernetes", "tool", 1.5), ("团队合作", "soft_skill", 2.0), ("C", "core_tech", 3.0), ("R", "core_tech", 3.0), ("C++", "core_tech", 3.0))


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "mode", "want"),
    [("C++ and R&D", "ascii_edge", ["C++"]), ("精通Python、React", "ascii_edge", ["Python", "React"]), ("精通Python、React", "unicode_word", ["React"]), (None, "ascii_edge", []), ("", "ascii_edge", [])],
)
def test_edges(text, mode, want):
    assert L.terms_in(text, tuple(t for t, _, _ in VOC), mode) == want


PIECES = st.lists(st.sampled_from(["C", "c++", "R", "python", "Python", "React", "团队", "团队合作", "git", "ſ", " ", ",", "。", "&", "+", "#", "_", "1", "\n", "x", "é", "/"]), max_size=12).map("".join)


@settings(max_examples=120, deadline=None)
@given(st.lists(PIECES | st.none(), max_size=6), st.sampled_from(["ascii_edge", "unicode_word", "sep_or_word", "sep_only"]))
def test_batches_are_scanned_like_single_texts(texts, mode):
    terms = tuple(t for t, _, _ in VOC)
    hits = scan.Scan(terms, mode).hits(texts)
    got = [sorted({terms[k] for k, row in zip(hits.term, hits.text, strict=True) if row == n}) for n in range(len(texts))]
    assert got == [L.terms_in(scan.lowered(t or ""), terms, mode) for t in texts]
    for row, k, start, end in zip(hits.text, hits.term, hits.start, hits.end, strict=True):
        assert scan.lowered(texts[row])[start:end] == terms[k].lower()


@settings(max_examples=80, deadline=None)
@given(st.lists(PIECES, max_size=5))
def test_spans_are_those_of_a_pattern(texts):
    terms = ("c", "c++", "python", "react", "团队", "团队合作", "git", "r")
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")\b")
    hits = scan.Scan(terms, "unicode_word").hits(texts)
    own = scan.longest(hits)
    got = [(int(hits.text[k]), terms[hits.term[k]], int(hits.start[k])) for k in own]
    assert got == [(n, m[0], m.start()) for n, t in enumerate(texts) for m in pattern.finditer(scan.lowered(t))]


def test_aliases(spark):
    rows = spark.createDataFrame([(1, "golang and reactjs, Python"), (2, "React.js"), (3, None), (4, "golang")], "k int, text string")
    voc = (("React", "framework", 2.5), ("Python", "core_tech", 3.0), ("golang", "core_tech", 3.0))
    got = {r["k"]: r["terms"] for r in L.extract_terms(rows, voc, {"golang": "Go", "reactjs": "React", "React.js": "React"}).collect()}
    assert got == {1: ["Go", "Python", "React", "golang"], 2: ["React"], 3: [], 4: ["Go", "golang"]}


def test_scan_joins_texts_in_parts(monkeypatch):
    monkeypatch.setattr(scan, "JOINED", 10)
    hits = scan.Scan(("git",)).hits(["git git", None, "x" * 30 + " git", "git"])
    assert list(zip(hits.text.tolist(), hits.start.tolist(), strict=True)) == [(0, 0), (0, 4), (2, 31), (3, 0)]


@pytest.mark.parametrize("term", ["C", "C++", "Python", "团队合作"])
def test_pattern_is_like_the_scan(spark, term):
    for text in ("C++ and R&D", "use C here", "精通Python、React", "团队合作", "Pythonic", ""):
        assert one(spark, lambda c: L.term_in_text(term, c), text) == (term in L.terms_in(text, (term,)))


def pair(spark, jd, resume):
    terms = tuple(t for t, _, _ in VOC)
    rows = spark.createDataFrame([(1, jd, resume)], "job_id int, a string, b string")
    return rows.select("job_id", L.match_terms(F.col("a"), terms).alias("jd_terms"), L.match_terms(F.col("b"), terms).alias("resume_terms"))


def test_full_match(spark):
    text = "招聘 Python, React, Docker, Git, 团队合作"
    r = L.weighted_match(pair(spark, text, text), VOC).first()
    assert r["overall"] == 100.0 and r["confidence"] > 0.8


def test_partial_match(spark):
    r = L.weighted_match(pair(spark, "Python, React, Docker", "Python, React, Kubernetes"), VOC).first()
    assert r["matched"] == ["Python", "React"] and r["missing"] == ["Docker"] and r["extra"] == ["Kubernetes"]


def test_empty_description(spark):
    r = L.weighted_match(pair(spark, "", "Python"), VOC).first()
    assert r["overall"] == 0 and r["confidence"] == 0.0


@pytest.mark.parametrize(("term", "want"), [("Python", 0.95), ("JavaScript", 0.9975), ("Go", 0.9025)])
def test_confidence(spark, term, want):
    got = spark.range(1).select(L.skill_confidence(F.lit(term), F.lit("core_tech"), F.lit(True))).first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("word", "want"), [("js", "javascript"), ("K8S", "kubernetes"), ("react.js", "react"), ("  js  ", "javascript"), ("unknown", "unknown"), ("", "")])
def test_synonyms(spark, word, want):
    table = F.create_map(*[F.lit(x) for x in ("js", "javascript", "k8s", "kubernetes", "reactjs", "react")])
    assert one(spark, lambda c: T.normalize_keyword(c, table), word) == want


@pytest.mark.parametrize(("text", "want"), [("10k-20k", (10, 20, "月")), ("10000-20000元", (10, 20, "月")), ("10万-20万", (10, 20, "年")), ("none", None)])
def test_salary(spark, text, want):
    got = one(spark, J.jd_salary, text)
    assert (got and (got["min"], got["max"], got["unit"])) == want


def test_contacts(spark):
    got = one(spark, R.contacts, "手机：13800138000丨邮箱：test@example.com丨地址：北京")
    assert (got["email"], got["phone"]) == ("test@example.com", "13800138000")


def test_grounding(spark):
    rows = spark.createDataFrame([(1, 1, "Python, React, Docker.")], "doc_id int, user_id int, text string")
    spans = G.find_spans(F.col("text"), ("Python", "React", "Docker"))
    rows = rows.withColumn("resume_terms", F.transform(spans, lambda s: s["term"]))
    vault = spark.createDataFrame([(1, ["python", "react"], "python react")], "user_id int, vault_terms array<string>, vault_text string")
    r = G.verify_resumes(rows, vault).first()
    assert (r["n_terms"], r["n_suspicious"], r["confidence"], r["level"], r["verified"]) == (3, 1, 0.67, "high", False)


def test_vault_index(spark):
    kind = "user_id int, structured_data struct<skills:array<struct<name:string>>,experiences:array<struct<projects:array<struct<description:string,technologies:array<string>>>>>>"
    data = [(1, ([("Python",), ("React hooks",)], [([("built with python and Redis", ["React"]), ("Redis again", None)],)])), (2, ([], [])), (3, (None, None))]
    terms = (("python", "languages"), ("React", "frontend"), ("redis", "database"), ("react", "other"))
    got = {(r["user_id"], r["term"]): (r["category"], r["sources"], r["counts"]) for r in G.vault_index(spark.createDataFrame(data, kind), terms).collect()}
    assert got == {(1, "python"): ("languages", ["projects", "skills"], [1, 1]), (1, "react"): ("frontend", ["projects", "skills"], [1, 1]), (1, "redis"): ("database", ["projects"], [2])}


def test_advice(spark):
    rows = spark.createDataFrame([(1, [], [], "none"), (2, ["languages", "backend", "other"], ["A系统", "B系统", "C系统", "D系统"], "high"), (3, ["other"], [], "low"), (4, ["frontend"], [], "medium")], "k int, c array<string>, p array<string>, level string")
    got = {r["k"]: r["a"] for r in rows.select("k", G.grounding_advice(F.col("c"), F.col("p"), F.col("level")).alias("a")).collect()}
    assert got[1] == ["No claim without ground was found"]
    assert [x.split(" ")[0] for x in got[2]] == ["2", "4", "High", "Single"] and "A系统, B系统, C系统;" in got[2][1]
    assert [x.split(" ")[0] for x in got[3]] == ["Low", "Single"] and [x.split(" ")[0] for x in got[4]] == ["1", "Some", "Single"]


def test_resumes_hand_on_whole_texts(spark, tmp_path):
    from jobtide.plans import resumes as texts
    from jobtide.sources.views import Views

    spark.createDataFrame([(1, "x " * 2000 + "\nthe end, nothing cut")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "job")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = texts._resume_texts(Views(spark, str(tmp_path)))
    assert rows.first()["text"].endswith("x \nthe end, nothing cut")
    assert "the:" in texts.rsm7_extract_skills(Views(spark, str(tmp_path))).first()["skills"]


def test_projects_of_all_orders_are_merged(spark, tmp_path):
    import datetime

    from jobtide.plans import resumes as texts
    from jobtide.sources.views import Views

    rows = [(k, n, 7, "A", "F", datetime.datetime(1995, 1, n), 2.0) for k in range(1, 121) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    v = Views(spark, str(tmp_path))
    for query in (texts.rsm17_merge_projects, texts.rsm18_merge_similar_entries):
        assert {r["l_orderkey"] for r in query(v).collect()} == set(range(1, 121))
