"""Checks of generated résumés against the facts on record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.scalar import round_n
from jobtide.functions.scan import longest, scan_of

#: Verbs before and nouns after a project's name.
PROJECT_VERBS, PROJECT_NOUNS = ("负责", "参与", "主导", "开发", "设计"), ("项目", "系统", "平台")
LEVELS = {"strict": ((0.7, 5), (0.85, 3)), "relaxed": ((0.6, 7), (0.8, 4))}
SPANS = "array<struct<term:string,start:int,end:int>>"


def find_spans(text: Column, terms: tuple[str, ...]) -> Column:
    """First place of each distinct term: leftmost, longest first, not overlapping, in order of place."""
    low = tuple(dict.fromkeys(t.lower() for t in terms if t))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        h = scan_of(low, "unicode_word").hits(texts.to_pylist())
        own = longest(h)
        row, term = h.text[own], h.term[own]
        _, first = np.unique(row * np.int64(max(1, len(low))) + term, return_index=True)
        first = np.sort(first)
        row, own = row[first], own[first]
        kind = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        spans = pa.StructArray.from_arrays([pa.array(low, pa.string()).take(pa.array(term[first])), pa.array(h.start[own].astype(np.int32)), pa.array(h.end[own].astype(np.int32))], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), spans)

    return run(text)


def categories(terms: tuple[tuple[str, str], ...]) -> Column:
    """Category by term; of several the first one counts."""
    first: dict[str, str] = {}
    for t, c in terms:
        first.setdefault(t.lower(), c)
    return F.create_map(*[x for t, c in first.items() for x in (F.lit(t), F.lit(c))])


def tech_terms(texts: DataFrame, terms: tuple[tuple[str, str], ...], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Long form: ident, term, category (the first one of a term), place."""
    rows = texts.select(ident, F.explode(find_spans(F.col(text), tuple(t for t, _ in terms))).alias("s"))
    return rows.select(ident, "s.term", F.element_at(categories(terms), F.col("s.term")).alias("category"), F.col("s.start").alias("start"))


def vault_raw_text(data: Column) -> Column:
    """All facts of a vault as one text: skills, companies, titles, descriptions, technologies, schools, fields."""
    joined = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), " ")
    jobs = F.transform(data["experiences"], lambda e: F.concat_ws(" ", e["company"], e["title"], e["description"], joined(F.transform(e["projects"], lambda p: F.concat_ws(" ", p["name"], p["description"], joined(p["technologies"]))))))
    schools = F.transform(data["education"], lambda e: F.concat_ws(" ", e["school"], e["field"]))
    return F.concat_ws(" ", joined(F.transform(data["skills"], lambda s: s["name"])), joined(jobs), joined(schools))


def vault_terms(vaults: DataFrame, terms: tuple[tuple[str, str], ...]) -> DataFrame:
    """Per user the set of terms in skills and projects, and the raw text of all facts."""
    d = F.col("structured_data")
    projects = F.flatten(F.transform(d["experiences"], lambda e: e["projects"]))
    text = F.concat_ws(" ", F.array_join(F.transform(d["skills"], lambda s: s["name"]), " "), F.array_join(F.transform(projects, lambda p: F.concat_ws(" ", p["description"], F.array_join(p["technologies"], " "))), " "))
    spans = find_spans(text, tuple(t for t, _ in terms))
    return vaults.select("user_id", F.transform(spans, lambda s: s["term"]).alias("vault_terms"), vault_raw_text(d).alias("vault_text"))


def vault_index(vaults: DataFrame, terms: tuple[tuple[str, str], ...]) -> DataFrame:
    """Inverted index of vaults: user_id, term, category, sources (skills, projects) and how often each names it.

    Skills are read one by one, projects as description and technologies; each text is scanned once for all terms, before
    anything is shuffled, and of the texts only the terms cross the shuffle.
    """
    d, none = F.col("structured_data"), F.expr("cast(array() as array<string>)")
    skills = F.transform(d["skills"], lambda s: F.struct(F.lit("skills").alias("source"), s["name"].alias("text")))
    projects = F.transform(F.flatten(F.transform(d["experiences"], lambda e: e["projects"])), lambda p: F.struct(F.lit("projects").alias("source"), F.concat_ws(" ", p["description"], F.array_join(F.coalesce(p["technologies"], none), " ")).alias("text")))
    rows = vaults.select("user_id", F.explode(F.concat(skills, projects)).alias("x")).select("user_id", "x.source", F.explode(F.transform(find_spans(F.col("x.text"), tuple(t for t, _ in terms)), lambda s: s["term"])).alias("term"))
    rows = rows.groupBy("user_id", "term", "source").agg(F.count("*").alias("n")).groupBy("user_id", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"))
    return rows.select("user_id", "term", F.element_at(categories(terms), F.col("term")).alias("category"), F.transform("s", lambda x: x["source"]).alias("sources"), F.transform("s", lambda x: x["n"]).alias("counts"))


def ungrounded_terms(resume_terms: Column, vault: Column, variants: dict[str, str] | None = None) -> Column:
    """Terms without ground in the vault: a known variant needs its mapped form, others any substring either way."""
    variants = variants or {}
    known = F.create_map(*[x for k, v in variants.items() for x in (F.lit(k), F.lit(v))]) if variants else None

    def bare(t: Column) -> Column:
        near = F.exists(vault, lambda v: F.contains(v, t) | F.contains(t, v))
        if known is not None:
            mapped = F.element_at(known, t)
            near = F.when(mapped.isNotNull(), F.array_contains(vault, mapped)).otherwise(near)
        return ~(F.array_contains(vault, t) | F.coalesce(near, F.lit(False)))

    return F.filter(resume_terms, bare)


def project_names(text: Column) -> Column:
    """Distinct names of projects that a text speaks of."""
    pattern = f"(?:{'|'.join(PROJECT_VERBS)})(?:了)?([^，。,.\\n]{{2,30}}?(?:{'|'.join(PROJECT_NOUNS)}))"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))


def ungrounded_projects(text: Column, vault_text: Column) -> Column:
    """Project names of more than three characters that the vault's text doesn't hold."""
    return _unknown(project_names(text), vault_text)


def _unknown(names: Column, vault_text: Column) -> Column:
    return F.filter(names, lambda n: (F.length(n) > 3) & ~F.contains(vault_text, n))


def grounding_level(n_suspicious: Column, n_terms: Column, mode: str = "strict") -> tuple[Column, Column]:
    """Confidence and level of a résumé."""
    sure = F.when(n_terms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - n_suspicious / F.nullif(n_terms, F.lit(0))))).otherwise(F.lit(1.0))
    (high, many), (medium, some) = LEVELS[mode]
    level = F.when(n_suspicious == 0, "none").when((sure < high) | (n_suspicious >= many), "high").when((sure < medium) | (n_suspicious >= some), "medium").otherwise("low")
    return sure, level


#: Categories whose terms are named together as technologies.
STACK = ("languages", "frontend", "backend")


def grounding_advice(category: Column, projects: Column, level: Column, stack: tuple[str, ...] = STACK) -> Column:
    """Sentences by the categories of the suspicious terms (an array), the suspicious projects and the level."""
    n = F.size(F.filter(category, lambda c: c.isin(*stack)))
    some = level != "none"
    return F.array_compact(F.array(
        F.when(~some, "No claim without ground was found"),
        F.when(some & (n > 0), F.concat(n.cast("string"), F.lit(" technologies may not be part of your record: add the projects to the vault or take them out"))),
        F.when(some & (F.size(projects) > 0), F.concat(F.size(projects).cast("string"), F.lit(" projects may be invented: "), F.array_join(F.slice(projects, 1, 3), ", "), F.lit("; use names from the vault"))),
        F.when(level == "high", "High risk: write the résumé again from the vault").when(level == "medium", "Some risk: check these points").when(level == "low", "Low risk: wording only"),
        F.when(some, "Single paragraphs can be reworded in the chat"),
    ))


def verify_resumes(
    resumes: DataFrame, vaults: DataFrame, mode: str = "strict", variants: dict[str, str] | None = None, terms: tuple[tuple[str, str], ...] = (), stack: tuple[str, ...] = STACK
) -> DataFrame:
    """Rows with ``resume_terms`` and ``text`` against ``vault_terms`` and ``vault_text`` of the same user.

    Terms and project names are found before the join: of the résumés only these arrays cross the shuffle. ``terms`` gives
    the categories for the advice; a term without one is ``unknown``.
    """
    rows = resumes.select("doc_id", "user_id", "resume_terms", project_names(F.col("text")).alias("_projects")).join(vaults, "user_id", "left")
    none = F.expr("cast(array() as array<string>)")
    vault = F.coalesce("vault_terms", none)
    rows = rows.withColumns({"_bad": ungrounded_terms(F.col("resume_terms"), vault, variants), "_made": F.array_sort(_unknown(F.col("_projects"), F.coalesce("vault_text", F.lit(""))))})
    rows = rows.withColumn("suspicious", F.array_sort(F.concat("_bad", "_made")))
    sure, level = grounding_level(F.size("suspicious"), F.size("resume_terms"), mode)
    rows = rows.withColumn("confidence", round_n(sure, 2)).withColumn("level", level)
    known = categories(terms) if terms else F.expr("cast(map() as map<string,string>)")
    category = F.transform("_bad", lambda t: F.coalesce(F.element_at(known, t), F.lit("unknown")))
    return rows.select(
        "doc_id", "user_id", F.size("resume_terms").alias("n_terms"), F.size(vault).alias("n_vault_terms"), "suspicious", F.size("suspicious").alias("n_suspicious"), "confidence", "level",
        F.col("level").isin("none", "low").alias("verified"), grounding_advice(category, F.col("_made"), F.col("level"), stack).alias("advice"),
    )


METRIC = r"\d+(\.\d+)?\s*[%倍万千亿]"


def provenance(resumes: DataFrame, claims: DataFrame | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Claims of each text: ident, claim, claim_type, source_type, source_text, confidence, status.

    ``claims`` (ident, claim, verdict ``verified`` or ``suspicious``, source, confidence) come first; a text without any gives
    what has figures among its first five sentences.
    """
    parts = F.slice(F.split(F.coalesce(F.col(text), F.lit("")), r"[。！？\n]"), 1, 5)
    kept = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (F.length(s) > 10) & F.regexp_like(s, F.lit(METRIC)))
    rest = resumes if claims is None else resumes.join(claims.select(ident), ident, "left_anti")
    said = rest.select(ident, F.explode(kept).alias("claim"))
    said = said.select(ident, F.substring("claim", 1, 100).alias("claim"), F.lit("metric").alias("claim_type"), F.lit("inferred").alias("source_type"), F.lit(None).cast("string").alias("source_text"), F.lit(0.7).alias("confidence"), F.lit("unverified").alias("status"))
    if claims is None:
        return said
    sure, metric = F.col("verdict") == "verified", F.regexp_like("claim", F.lit(METRIC))
    source = F.when(sure, F.nullif(F.col("source"), F.lit("")))
    given = claims.select(
        ident, "claim", F.when(metric, "metric").when(sure, "skill").otherwise("other").alias("claim_type"), F.when(~sure, "hallucinated").when(source.isNotNull(), "vault_experience").otherwise("inferred").alias("source_type"),
        source.alias("source_text"), F.when(sure, F.coalesce("confidence", F.lit(0.8))).otherwise(0.3).alias("confidence"), F.when(sure, "verified").otherwise("warning").alias("status"),
    )
    return given.unionByName(said)


def provenance_overall(resumes: DataFrame, items: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Mean confidence of each text's claims (0.5 without any) and their number."""
    per = items.groupBy(ident).agg(F.avg("confidence").alias("c"), F.count("*").alias("n"))
    return resumes.select(ident).join(per, ident, "left").select(ident, F.coalesce("c", F.lit(0.5)).alias("confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("items"))


def recall_experiences(jobs: DataFrame, skills: tuple[str, ...]) -> DataFrame:
    """Of the first five experiences of each job's vault: 10 per required skill in title or description, ``rank`` 1 for the best.

    ``jobs``: job_id, required (array), experiences (array of struct title, company, description).
    """
    from jobtide.operators.lexicon import term_in_text

    rows = jobs.select("job_id", "required", F.posexplode(F.slice("experiences", 1, 5)).alias("pos", "e"))
    named = lambda s: term_in_text(s, F.col("e.description")) | term_in_text(s, F.col("e.title"))
    hits = F.array_compact(F.array(*[F.when(F.array_contains("required", F.lit(s)) & named(s), F.lit(s)) for s in skills]))
    rows = rows.withColumn("hits", hits).withColumn("score", F.least(F.lit(100), F.size("hits") * 10)).filter("score > 0")
    best = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("score"), "pos"))
    long = F.length("e.description") > 200
    return rows.select(
        "job_id", "pos", best.alias("rank"), F.col("e.title").alias("title"), F.col("e.company").alias("company"), "score",
        F.when(long, F.concat(F.substring("e.description", 1, 200), F.lit("..."))).otherwise(F.col("e.description")).alias("evidence"),
        F.concat(F.lit("匹配技能: "), F.array_join(F.slice("hits", 1, 3), ", ")).alias("reason"),
    )


def jd_requirements(jobs: DataFrame, technical: tuple[str, ...], terms: str = "jd_terms", ident: str = "job_id") -> DataFrame:
    """The first eight required terms of each job with a coarse category."""
    rows = jobs.select(ident, F.posexplode(F.slice(terms, 1, 8)).alias("pos", "term"))
    return rows.withColumn("category", F.when(F.col("term").isin(*technical), "technical").otherwise("general"))
