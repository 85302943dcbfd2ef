"""Text assembly, cards and version differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_CELLS = 250_000
SEGMENTS = "array<struct<changed:boolean,old:string,new:string>>"


def render_resume(data: Column, jd_terms: Column, preview: Column | None = None) -> Column:
    """Markdown from the facts of a vault alone; skills that the description names come first, order kept.

    ``data``: personal_info, summary, skills (name), experiences (company, title, dates, description, projects as names),
    education (school, degree, field, dates); a vault without any facts shows the preview.
    """
    info, some = data["personal_info"], lambda x: F.nullif(x, F.lit(""))
    names = F.filter(F.transform(data["skills"], lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    edge = lambda t: F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), t, F.lit(r"\E(?![A-Za-z0-9])"))
    hit = lambda n: F.exists(jd_terms, lambda t: F.regexp_like(n, edge(t)))
    skills = F.concat(F.filter(names, hit), F.filter(names, lambda n: ~hit(n)))
    joined = lambda sep, *xs: some(F.array_join(F.array_compact(F.array(*map(some, xs))), sep))
    span = lambda e: joined(" — ", e["start_date"], e["end_date"])
    job = lambda e: F.array_compact(F.concat(F.array(F.concat(F.lit("### "), joined(" · ", e["company"], e["title"])), span(e), some(e["description"])), F.transform(e["projects"], lambda p: F.concat(F.lit("**"), p, F.lit("**")))))
    school = lambda e: F.array_compact(F.array(F.concat(F.lit("### "), joined(" · ", e["school"], e["degree"], e["field"])), span(e)))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit("## " + head)), lines)).otherwise(F.expr("cast(array() as array<string>)"))
    one = lambda x: F.array_compact(F.array(x))
    facts = F.concat(
        one(joined(" · ", info["email"], info["phone"])), part("个人概述", one(some(data["summary"]))), part("技能", one(some(F.array_join(skills, "、")))),
        part("工作经历", F.flatten(F.transform(data["experiences"], job))), part("教育经历", F.flatten(F.transform(data["education"], school))),
    )
    shown = facts if preview is None else F.when(F.size(facts) > 0, facts).otherwise(one(some(preview)))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.coalesce(some(info["name"]), F.lit("个人简历")))), shown), "\n\n")


def interview_brief(data: Column, raw: Column) -> Column:
    """Markdown of a vault: person, schools, jobs with their projects, skills; the raw text when nothing is structured.

    A part without entries is left out with its heading; absent values are empty. ``projects`` are
    structs of name and description.
    """
    text = lambda x: F.coalesce(x, F.lit(""))
    info = data["personal_info"]
    line = lambda head, x: F.when(text(x) != "", F.concat(F.lit(head + ": "), x))
    none = F.expr("cast(array() as array<string>)")
    part = lambda head, lines: F.when(F.size(F.coalesce(lines, none)) > 0, F.concat(F.array(F.lit(head)), lines)).otherwise(none)
    person = F.when(info.isNotNull(), F.array_compact(F.array(F.lit("## 个人信息"), line("姓名", info["name"]), line("邮箱", info["email"])))).otherwise(none)
    school = F.transform(data["education"], lambda e: F.concat(F.lit("- "), text(e["school"]), F.lit(" - "), text(e["degree"]), F.lit(" ("), text(e["field"]), F.lit(")")))
    project = lambda p: F.array(F.concat(F.lit("- 项目: "), text(p["name"])), F.concat(F.lit("  描述: "), text(p["description"])))
    job = lambda e: F.concat(F.array(F.concat(F.lit("\n### "), text(e["company"]), F.lit(" - "), text(e["title"]))), F.coalesce(F.flatten(F.transform(e["projects"], project)), none))
    skills = F.transform(data["skills"], lambda s: text(s["name"]))
    skills = F.when(F.size(F.coalesce(skills, none)) > 0, F.array(F.array_join(skills, ", ")))
    lines = F.concat(person, part("\n## 教育背景", school), part("\n## 工作经历", F.flatten(F.transform(data["experiences"], job))), part("\n## 技能", skills))
    return F.when(data.isNull(), text(raw)).otherwise(F.array_join(lines, "\n"))


QUESTIONS = (
    (1, "technical", "Describe a problem that you solved with {term}."), (2, "behavioural", "Tell of a conflict in a team and its end."), (3, "project", "Which project taught you most, and why?"),
    (4, "motivation", "Why this company?"), (5, "plan", "What will you have learned in three years?"),
)


def base_questions(jobs: DataFrame) -> DataFrame:
    """Five questions per job; the first names the first term of the description."""
    items = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(kind).alias("kind"), F.lit(text).alias("text")) for k, kind, text in QUESTIONS])
    rows = jobs.select("job_id", F.coalesce(F.array_min("jd_terms"), F.lit("your main tool")).alias("term"), F.explode(items).alias("q"))
    return rows.select("job_id", "q.pos", "q.kind", F.replace("q.text", F.lit("{term}"), F.col("term")).alias("question"))


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of each generation in order as one text, with the number and whether one reports an error."""
    rows = chunks.groupBy("generation").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"), F.bool_or(F.col("type") == "error").alias("failed"))
    return rows.select("generation", F.array_join(F.transform("c", lambda x: x["content"]), "").alias("text"), F.size("c").alias("chunks"), F.when(F.col("failed"), "error").otherwise("done").alias("status"))


def segments(before: str | None, after: str | None) -> list[dict]:
    """Longest common lines as equal and changed segments, added lines first; one whole segment beyond a bound on the work."""
    a, b = (before or "").split("\n"), (after or "").split("\n")
    if len(a) * len(b) > MOST_CELLS:
        return [{"changed": before != after, "old": before or "", "new": after or ""}]
    number = {x: k for k, x in enumerate(dict.fromkeys((*a, *b)))}
    x, y = (np.array([number[line] for line in side]) for side in (a, b))
    common = np.zeros((len(a) + 1, len(b) + 1), np.int32)  # of the rests of both sides
    for i in reversed(range(len(a))):
        row = np.maximum(common[i + 1, :-1], np.where(y == x[i], common[i + 1, 1:] + 1, 0))
        common[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out: list[tuple[bool, list[str], list[str]]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        same = i < len(a) and j < len(b) and x[i] == y[j]
        added = not same and j < len(b) and (i == len(a) or common[i, j + 1] >= common[i + 1, j])
        if not out or out[-1][0] == same:
            out.append((not same, [], []))
        if not added:
            out[-1][1].append(a[i])
        if same or added:
            out[-1][2].append(b[j])
        i, j = i + (not added), j + (same or added)
    return [{"changed": changed, "old": "\n".join(old), "new": "\n".join(new)} for changed, old, new in out]


def version_diff(versions: DataFrame) -> DataFrame:
    """Each version against the one before it: segments."""

    @F.pandas_udf(SEGMENTS)
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([segments(x, y) for x, y in zip(before, after, strict=True)])

    rows = versions.withColumn("before", F.lag("content").over(W.partitionBy("job_id").orderBy("version")))
    return rows.filter("before is not null").select("job_id", "version", run("before", "content").alias("segments"))


def vault_card(vaults: DataFrame) -> DataFrame:
    """Name, first experience, first eight skills, counts, version of each vault."""
    d = F.col("structured_data")
    first = F.get(d["experiences"], F.lit(0))
    return vaults.select(
        "user_id", d["personal_info"]["name"].alias("name"), first["title"].alias("title"), first["company"].alias("company"), F.slice(F.transform(d["skills"], lambda s: s["name"]), 1, 8).alias("skills"),
        F.size(d["experiences"]).alias("n_experiences"), F.size(d["education"]).alias("n_education"), "version",
    )


def analysis_card(rows: DataFrame) -> DataFrame:
    """Score (0 stays, absent is null), matched, missing and suggestions without blanks."""
    clean = lambda c: F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "").alias(c)
    return rows.select("job_id", "score", *[clean(c) for c in ("matched", "missing", "suggestions")])


def extraction_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per document: exact match of name, phone, email; covered share of four counts; their mean."""
    joined = gold.alias("g").join(predicted.alias("p"), "doc_id", "left")
    same = [F.coalesce((F.col(f"g.{c}") == F.col(f"p.{c}")).cast("double"), F.lit(0.0)).alias(c) for c in ("name", "phone", "email")]
    part = [F.least(F.lit(1.0), F.coalesce(F.col(f"p.{c}"), F.lit(0)) / F.greatest(F.col(f"g.{c}"), F.lit(1))).alias(c) for c in ("education_count", "work_count", "skill_count", "project_count")]
    rows = joined.select("doc_id", *same, *part)
    names = [c for c in rows.columns if c != "doc_id"]
    return rows.withColumn("score", sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names))


def accuracy_summary(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """Mean of each field and of the score over all documents, lowest first, and whether it is below the mark."""
    names = [c for c in scored.columns if c != "doc_id"]
    means = scored.agg(*[F.avg(c).alias(c) for c in names])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("mean")) for c in names])).alias("x")).select("x.*")
    return rows.withColumn("low", F.col("mean") < least).orderBy("mean", "field")
