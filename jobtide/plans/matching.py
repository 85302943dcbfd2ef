"""Queries of the lexicon, matching, scoring and grounding operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators import grounding as G
from jobtide.operators import lexicon as L
from jobtide.plans.book import query
from jobtide.plans.forms import forms, forms_sql
from jobtide.session import shared_folder
from jobtide.sources.tables import KeyedTable
from jobtide.sources.views import Views

#: Words that occur in the driver's invented texts stand in for skills.
VOCABULARY = tuple(
    (term, category, weight)
    for category, weight, terms in (
        ("core_tech", 3.0, ("the", "der", "que", "ing", "tion")),
        ("framework", 2.5, ("and", "und", "les", "that", "with")),
        ("tool", 1.5, ("of", "la", "mit", "for", "ing")),
        ("soft_skill", 2.0, ("to", "von", "pour", "this", "are")),
    )
    for term in terms
)
TERMS = sorted({t for t, _, _ in VOCABULARY})
VOC = ", ".join(f"('{t}', '{c}', {w}::DOUBLE)" for t, c, w in VOCABULARY)
_edge = "CASE WHEN len(term) <= 2 THEN '(^|[^a-z0-9+#&.])' || term || '([^a-z0-9+#&]|$)' ELSE '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)' END"
#: Terms of descriptions (jt) and résumés (rt); pairs (named job_id) of each résumé and its description.
MATCH = f""", voc AS (SELECT * FROM (VALUES {VOC}) t(term, category, weight)),
terms AS (SELECT DISTINCT term FROM voc),
jt AS (SELECT job_id, user_id, term FROM jds, terms WHERE regexp_matches(lower(text), {_edge})),
rt AS (SELECT r.doc_id, term FROM resumes r, terms WHERE regexp_matches(lower(text), {_edge})),
pairs AS (SELECT r.doc_id AS job_id, r.user_id, r.doc_id, r.posting FROM jds j JOIN resumes r ON r.posting = j.job_id),
pt AS (SELECT p.job_id, p.user_id, t.term, max(jt.term IS NOT NULL) AS in_jd, max(rt.term IS NOT NULL) AS in_resume
       FROM pairs p CROSS JOIN terms t LEFT JOIN jt ON jt.job_id = p.posting AND jt.term = t.term LEFT JOIN rt ON rt.doc_id = p.doc_id AND rt.term = t.term GROUP BY 1, 2, 3)
"""


def _jds(v: Views) -> DataFrame:
    return L.extract_terms(v.jds, VOCABULARY).select("job_id", "user_id", F.col("terms").alias("jd_terms"))


def _pairs(v: Views) -> DataFrame:
    """Each résumé with its description, a pair (job_id) of its own; terms are found before the join."""
    resumes = L.extract_terms(v.resumes, VOCABULARY).select(F.col("doc_id").alias("job_id"), "user_id", "posting", F.col("terms").alias("resume_terms"))
    return resumes.join(_jds(v).select(F.col("job_id").alias("posting"), "jd_terms"), "posting")


def _list(c: Column | str) -> Column:
    return F.array_join(c, ",")


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])that([^a-z0-9]|$)') AS hit FROM resumes")
def lex1_term_in_text(v: Views) -> DataFrame:
    return v.resumes.select("doc_id", L.term_in_text("that", F.col("text")).alias("hit"))


@query(MATCH + f"SELECT d.doc_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS terms FROM resumes d LEFT JOIN (SELECT doc_id, term FROM resumes, terms WHERE regexp_matches(lower(text), {_edge})) x ON x.doc_id = d.doc_id GROUP BY 1")
def lex2_extract_terms(v: Views) -> DataFrame:
    return L.extract_terms(v.resumes, VOCABULARY).select("doc_id", _list("terms").alias("terms"))


@query(MATCH + "SELECT job_id, category, count(*)::INTEGER AS n_terms, sum(weight) AS score FROM jt JOIN voc USING (term) GROUP BY 1, 2")
def lex3_terms_by_category(v: Views) -> DataFrame:
    return L.terms_by_category(_jds(v).withColumnRenamed("jd_terms", "terms"), VOCABULARY, "job_id")


CUES = {"english": ("the ", " of ", " and "), "german": ("der ", " die ", " und "), "french": (" les ", " des ", " et ")}
_cue = lambda words: " + ".join(f"contains(t, '{w}')::INTEGER" for w in words)
TYPES = f"SELECT doc_id, CASE WHEN greatest(e, g, f) = 0 THEN 'default' WHEN e = greatest(e, g, f) THEN 'english' WHEN g = greatest(e, g, f) THEN 'german' ELSE 'french' END AS job_type FROM (SELECT doc_id, {_cue(CUES['english'])} AS e, {_cue(CUES['german'])} AS g, {_cue(CUES['french'])} AS f FROM (SELECT doc_id, lower(text) AS t FROM resumes))"


@query(TYPES)
def lex4_detect_job_type(v: Views) -> DataFrame:
    return v.resumes.select("doc_id", L.detect_job_type(F.col("text"), CUES).alias("job_type"))


@query(f"SELECT doc_id, (CASE job_type WHEN 'english' THEN 0.5 WHEN 'german' THEN 0.4 ELSE 0.25 END)::DOUBLE AS core FROM ({TYPES})")
def lex5_job_type_weights(v: Views) -> DataFrame:
    types = v.resumes.select("doc_id", L.detect_job_type(F.col("text"), CUES).alias("job_type"))
    rows = L.job_type_weights(types, {"english": {"core": 0.5}, "german": {"core": 0.4}, "default": {"core": 0.25}})
    return rows.select("doc_id", F.element_at("weights", F.lit("core")).alias("core"))


SETS = "coalesce(string_agg(term, ',' ORDER BY term) FILTER (in_jd AND in_resume), '') AS matched, coalesce(string_agg(term, ',' ORDER BY term) FILTER (in_jd AND NOT in_resume), '') AS missing"


@query(MATCH + f"SELECT job_id, {SETS}, coalesce(string_agg(term, ',' ORDER BY term) FILTER (in_resume AND NOT in_jd), '') AS extra FROM pt GROUP BY 1")
def set1_keyword_sets(v: Views) -> DataFrame:
    rows = _pairs(v).select("job_id", L.keyword_sets(F.col("jd_terms"), F.col("resume_terms")).alias("s"))
    return rows.select("job_id", *[_list(f"s.{c}").alias(c) for c in ("matched", "missing", "extra")])


N = "count(*) FILTER (in_jd AND in_resume) AS m, count(*) FILTER (in_jd) AS j"


@query(MATCH + f"SELECT job_id, matched, missing, coalesce(least(100, floor(m / nullif(j, 0)::DOUBLE * 100)), 0)::INTEGER AS score FROM (SELECT job_id, {SETS}, {N} FROM pt GROUP BY 1)")
def mat1_keyword_match(v: Views) -> DataFrame:
    return L.keyword_match(_pairs(v)).select("job_id", _list("matched").alias("matched"), _list("missing").alias("missing"), "score")


@query(MATCH + "SELECT job_id, array_to_string(list_sort(list(term) FILTER (in_jd AND NOT in_resume))[1:5], ',') AS top_missing FROM pt GROUP BY 1 HAVING count(*) FILTER (in_jd AND NOT in_resume) > 0")
def top2_top_terms(v: Views) -> DataFrame:
    rows = _pairs(v).select("job_id", F.slice(L.keyword_sets(F.col("jd_terms"), F.col("resume_terms"))["missing"], 1, 5).alias("m"))
    return rows.filter(F.size("m") > 0).select("job_id", _list("m").alias("top_missing"))


CONF = "CASE WHEN in_jd AND in_resume THEN least(1.0::DOUBLE, CASE category WHEN 'core_tech' THEN 0.95::DOUBLE WHEN 'framework' THEN 0.90::DOUBLE WHEN 'tool' THEN 0.85::DOUBLE ELSE 0.80::DOUBLE END * CASE WHEN len(term) >= 8 THEN 1.05::DOUBLE WHEN len(term) <= 3 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0::DOUBLE END"
SKILLS = f"SELECT job_id, term, category, weight, in_jd, in_resume, in_jd AND in_resume AS matched, {CONF} AS confidence FROM pt JOIN voc USING (term) WHERE in_jd OR in_resume"


@query(MATCH + SKILLS)
def mat2_skill_pairs(v: Views) -> DataFrame:
    return L.skill_pairs(_pairs(v), VOCABULARY)


@query(MATCH + f"SELECT category, avg(confidence) AS mean_confidence, count(*)::BIGINT AS n FROM ({SKILLS}) WHERE matched GROUP BY 1")
def mat3_skill_confidence(v: Views) -> DataFrame:
    rows = L.skill_pairs(_pairs(v), VOCABULARY).filter("matched")
    return rows.groupBy("category").agg(F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))


DIM = """SELECT job_id, category, weight, n_jd::INTEGER AS n_jd, n_matched::INTEGER AS n_matched, (n_jd - n_matched)::INTEGER AS n_missing,
 CASE WHEN n_jd = 0 THEN 100::DOUBLE ELSE floor(n_matched::DOUBLE / n_jd * 100 * 100::DOUBLE + 0.5) / 100::DOUBLE END AS score
FROM (SELECT job_id, category, weight, count(*) FILTER (in_jd) AS n_jd, count(*) FILTER (in_jd AND in_resume) AS n_matched FROM pt JOIN voc USING (term) GROUP BY 1, 2, 3)"""


@query(MATCH + DIM)
def mat4_dimension_scores(v: Views) -> DataFrame:
    return L.dimension_scores(_pairs(v), VOCABULARY)


OVERALL = f"SELECT job_id, coalesce(floor(sum(score * weight) FILTER (n_jd > 0) / sum(weight) FILTER (n_jd > 0) * 100::DOUBLE + 0.5) / 100::DOUBLE, 0) AS overall FROM ({DIM}) GROUP BY 1"


@query(MATCH + OVERALL)
def mat5_overall_score(v: Views) -> DataFrame:
    return L.overall_score(L.dimension_scores(_pairs(v), VOCABULARY))


CONFIDENCE = f"""SELECT job_id, CASE WHEN n_jd > 0 THEN floor(greatest(0, least(1, 0.25::DOUBLE * least(n_jd / 5.0::DOUBLE, 1) + 0.35::DOUBLE * coalesce(sc / nullif(nm, 0), 0)
 + 0.25::DOUBLE * coalesce(cm / nullif(cj, 0)::DOUBLE, 0) + 0.15::DOUBLE * least(nr / 10.0::DOUBLE, 1))) * 10000::DOUBLE + 0.5) / 10000::DOUBLE ELSE 0 END AS confidence
FROM (SELECT job_id, count(DISTINCT term) FILTER (in_jd) AS n_jd, count(DISTINCT term) FILTER (in_resume) AS nr, sum(floor(confidence * 10000 + 0.5)::BIGINT) FILTER (matched) / 10000::DOUBLE AS sc, count(*) FILTER (matched) AS nm,
 count(DISTINCT category) FILTER (in_jd) AS cj, count(DISTINCT category) FILTER (matched) AS cm FROM ({SKILLS}) GROUP BY 1)"""


@query(MATCH + CONFIDENCE)
def mat6_match_confidence(v: Views) -> DataFrame:
    return L.match_confidence(L.skill_pairs(_pairs(v), VOCABULARY))


@query(MATCH + f", o AS ({OVERALL}), c AS ({CONFIDENCE}), s AS (SELECT job_id, {SETS} FROM pt GROUP BY 1) SELECT s.job_id, overall, coalesce(confidence, 0)::DOUBLE AS confidence, matched, missing FROM s JOIN o USING (job_id) LEFT JOIN c USING (job_id)")
def mat7_weighted_match(v: Views) -> DataFrame:
    return L.weighted_match(_pairs(v), VOCABULARY).select("job_id", "overall", "confidence", _list("matched").alias("matched"), _list("missing").alias("missing"))


@query(MATCH + f"SELECT job_id, coalesce(least(100, floor(sum(n_matched * weight) / nullif(sum(n_jd * weight), 0) * 100)), 0)::INTEGER AS score FROM ({DIM}) GROUP BY 1")
def mat8_category_match(v: Views) -> DataFrame:
    return L.category_match(_pairs(v), VOCABULARY)


@query(MATCH + f"""SELECT job_id, concat_ws(' / ', CASE WHEN len(matched) > 0 THEN 'Point out: ' || array_to_string(matched[1:5], ', ') END, CASE WHEN len(missing) > 0 THEN 'Add if true: ' || array_to_string(missing[1:5], ', ') END,
 CASE WHEN coalesce(len(missing), 0) = 0 THEN 'Covers every term of the description' ELSE 'Name concrete results for each term' END) AS suggestions
FROM (SELECT job_id, list_sort(list(term) FILTER (in_jd AND in_resume)) AS matched, list_sort(list(term) FILTER (in_jd AND NOT in_resume)) AS missing FROM pt GROUP BY 1)""")
def mat9_match_suggestions(v: Views) -> DataFrame:
    return L.keyword_match(_pairs(v)).select("job_id", F.array_join("suggestions", " / ").alias("suggestions"))


@query(MATCH + f""", o AS ({OVERALL}) SELECT a.id, coalesce(overall::INTEGER, match_score) AS match_score, CASE WHEN o.job_id IS NOT NULL THEN v.version ELSE source_vault_version END AS source_vault_version,
 sha256(CASE WHEN o.job_id IS NOT NULL THEN jd_text ELSE source_jd_text END) AS source_jd_digest
FROM applications a LEFT JOIN (SELECT job_id, floor(overall)::INTEGER AS overall FROM o) o ON o.job_id = a.id LEFT JOIN vaults v USING (user_id)""")
def mat10_save_match(v: Views) -> DataFrame:
    """The stored applications with the new results put into their buckets, and read back."""
    own = ("id", "match_score", "source_vault_version", "source_jd_digest")
    table = KeyedTable(v.spark, f"{shared_folder(v.spark)}/matches_{uuid.uuid4().hex}", "id", "id long, match_score int, source_vault_version int, source_jd_digest string", buckets=16)
    table.upsert(v.applications.select(*own), 0)
    results = L.overall_score(L.dimension_scores(_pairs(v), VOCABULARY))
    table.upsert(L.match_results(v.applications, results, v.vaults), 1)
    return table.read()


@query(MATCH + "SELECT user_id, term, count(*)::BIGINT AS n FROM jt GROUP BY 1, 2")
def agg17_skill_demand(v: Views) -> DataFrame:
    return L.term_counts(_jds(v), "jd_terms")


@query(MATCH + "SELECT user_id, term, count(*)::BIGINT AS n FROM pt WHERE in_jd AND NOT in_resume GROUP BY 1, 2")
def agg17_skill_gaps(v: Views) -> DataFrame:
    return L.term_counts(L.keyword_match(_pairs(v), 1 << 20), "missing")


# Scores: three dimensions of each review stand in for what a model returned.
SCORES = """, scores AS (
  SELECT l_orderkey::VARCHAR AS pair_id, CASE l_linenumber WHEN 1 THEN 'skills' WHEN 2 THEN 'experience' ELSE 'projects' END AS dimension, max(l_quantity::INTEGER * 2) AS score,
         [min(l_returnflag), 'm' || max(l_linenumber)] AS matched, ['x' || min(l_linestatus)] AS missing, ['do ' || min(l_returnflag), ''] AS suggestions
  FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)
"""


def _scores(v: Views) -> DataFrame:
    n = F.col("l_linenumber")
    rows = v.table("lineitem").filter(n <= 3)
    rows = rows.groupBy(F.col("l_orderkey").cast("string").alias("pair_id"), F.when(n == 1, "skills").when(n == 2, "experience").otherwise("projects").alias("dimension"))
    return rows.agg(
        F.max(F.col("l_quantity").cast("int") * 2).alias("score"), F.array(F.min("l_returnflag"), F.concat(F.lit("m"), F.max("l_linenumber").cast("string"))).alias("matched"),
        F.array(F.concat(F.lit("x"), F.min("l_linestatus"))).alias("missing"), F.array(F.concat(F.lit("do "), F.min("l_returnflag")), F.lit("")).alias("suggestions"),
    )


_dim = lambda d: f"coalesce(max(CASE WHEN dimension = '{d}' THEN score END), 50)"
COMBINED = f"SELECT pair_id, greatest(0, least(100, floor({_dim('skills')} * 0.35::DOUBLE + {_dim('experience')} * 0.35::DOUBLE + {_dim('projects')} * 0.2::DOUBLE + {_dim('education')} * 0.1::DOUBLE + 1e-9::DOUBLE)))::INTEGER AS score FROM scores GROUP BY 1"


@query(SCORES + COMBINED)
def sco1_combine_scores(v: Views) -> DataFrame:
    return L.combine_scores(_scores(v))


@query(SCORES + f"""SELECT c.pair_id, c.score, band, concat_ws('; ', band, CASE WHEN strong <> '' THEN 'strong: ' || strong END, CASE WHEN weak <> '' THEN 'weak: ' || weak END) AS summary
FROM (SELECT *, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 55 THEN 'fair' ELSE 'weak' END AS band FROM ({COMBINED})) c
JOIN (SELECT pair_id, coalesce(string_agg(dimension, ', ' ORDER BY dimension) FILTER (score >= 75), '') AS strong, coalesce(string_agg(dimension, ', ' ORDER BY dimension) FILTER (score < 60), '') AS weak FROM scores GROUP BY 1) d USING (pair_id)""")
def sco2_score_summary(v: Views) -> DataFrame:
    scores = _scores(v)
    return L.score_summary(scores, L.combine_scores(scores)).select("pair_id", "score", "band", "summary")


_dorder = "CASE dimension WHEN 'skills' THEN 0 WHEN 'experience' THEN 1 ELSE 2 END"
_distinct = lambda cond, c: f"SELECT pair_id, coalesce(array_to_string(list_filter(list_transform(r, lambda x, i: CASE WHEN list_position(r, x) = i THEN x END), lambda x: x IS NOT NULL)[1:6], ','), '') AS items FROM (SELECT pair_id, flatten(list(CASE WHEN {cond} THEN {c} ELSE [] END ORDER BY {_dorder})) AS r FROM scores GROUP BY 1)"


@query(SCORES + _distinct("score >= 70", "matched[1:2]").replace("[1:6]", "[1:5]"))
def sco3_top_strengths(v: Views) -> DataFrame:
    return L.top_strengths(_scores(v)).select("pair_id", _list("strengths").alias("items"))


@query(SCORES + _distinct("score < 70", "missing[1:2]").replace("[1:6]", "[1:5]"))
def sco3_key_gaps(v: Views) -> DataFrame:
    return L.key_gaps(_scores(v)).select("pair_id", _list("gaps").alias("items"))


@query(SCORES + _distinct("true", "list_filter(suggestions, lambda s: s <> '')"))
def sco4_action_items(v: Views) -> DataFrame:
    return L.action_items(_scores(v)).select("pair_id", _list("actions").alias("items"))


# Grounding: the description's terms stand in for the vault, other words for technologies.
TECH = tuple((t, c) for t, c, _ in VOCABULARY)
TEXTS = f""", tech AS (SELECT term, first(category) AS category FROM (VALUES {VOC}) t(term, category, weight) GROUP BY 1),
hits AS (SELECT doc_id, user_id, term, category FROM resumes, tech WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '([^\\p{{L}}\\p{{N}}_]|$)')),
vt AS (SELECT DISTINCT user_id, term FROM jds, tech WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '([^\\p{{L}}\\p{{N}}_]|$)')),
bad AS (SELECT h.doc_id, h.term FROM hits h WHERE NOT EXISTS (SELECT 1 FROM vt WHERE vt.user_id = h.user_id AND (contains(vt.term, h.term) OR contains(h.term, vt.term))))
"""


def _vaults(v: Views, skills: Column) -> DataFrame:
    """Vaults of few postings each, with these as projects."""
    project = F.struct(F.col("job_id").cast("string").alias("name"), F.col("text").alias("description"), F.expr("cast(array() as array<string>)").alias("technologies"))
    jobs = v.jds.groupBy("user_id").agg(F.array_sort(F.collect_list(project)).alias("projects"))
    job = F.struct(F.lit("").alias("company"), F.lit("").alias("title"), F.lit("").alias("description"), F.col("projects"))
    data = F.struct(skills.alias("skills"), F.array(job).alias("experiences"), F.expr("cast(array() as array<struct<school:string,field:string>>)").alias("education"))
    return jobs.select("user_id", data.alias("structured_data"))


def _facts(v: Views) -> DataFrame:
    rows = G.vault_terms(_vaults(v, F.expr("cast(array() as array<struct<name:string>>)")), TECH)
    return rows.withColumn("vault_terms", F.array_sort("vault_terms"))


def _generated(v: Views) -> DataFrame:
    spans = G.find_spans(F.col("text"), tuple(t for t, _ in TECH))
    return v.resumes.withColumn("resume_terms", F.array_sort(F.transform(spans, lambda s: s["term"])))


@query(TEXTS + "SELECT doc_id, term, category FROM hits")
def grd1_tech_terms(v: Views) -> DataFrame:
    return G.tech_terms(v.resumes, TECH).select("doc_id", "term", "category")


#: Skills of a vault besides its projects: some terms of the vocabulary by user.
SKILLS = tuple(t for t, _, _ in VOCABULARY)[:6]


@query(TEXTS + f""", said AS (SELECT user_id, {list(SKILLS)}[1 + user_id % 6] AS skill FROM (SELECT DISTINCT user_id FROM jds)),
entries AS (SELECT user_id, term, 'projects' AS source FROM vt UNION SELECT user_id, term, 'skills' FROM said, tech WHERE regexp_matches(skill, '(^|[^\\p{{L}}\\p{{N}}_])' || term || '([^\\p{{L}}\\p{{N}}_]|$)'))
SELECT user_id, term, category, string_agg(source, ',' ORDER BY source) AS sources FROM entries JOIN tech USING (term) GROUP BY 1, 2, 3""")
def grd2_vault_index(v: Views) -> DataFrame:
    return G.vault_index(_vaults(v, F.array(F.struct(F.element_at(F.array(*map(F.lit, SKILLS)), (F.col("user_id") % 6 + 1).cast("int")).alias("name")))), TECH).select("user_id", "term", "category", _list("sources").alias("sources"))


@query(TEXTS + "SELECT user_id, string_agg(term, ',' ORDER BY term) AS vault_terms FROM vt GROUP BY 1")
def grd2_vault_terms(v: Views) -> DataFrame:
    return _facts(v).filter(F.size("vault_terms") > 0).select("user_id", _list("vault_terms").alias("vault_terms"))


@query(TEXTS + "SELECT doc_id, term FROM bad")
def grd3_ungrounded_terms(v: Views) -> DataFrame:
    rows = _generated(v).join(_facts(v), "user_id", "left")
    none = F.expr("cast(array() as array<string>)")
    return rows.select("doc_id", F.explode(G.ungrounded_terms(F.col("resume_terms"), F.coalesce("vault_terms", none))).alias("term"))


#: A line on projects, and what a vault says of them.
DONE = (("负责了推荐#号系统，参与电商平台", "开发ab平台。主导数据中台项目", "设计推荐#号系统, 参与推荐#号系统", "nothing"), ("", "负责风控系统"))
KNOWN = (("电商平台", "数据中台项目", "推荐#号系统"),)
_found = f"list_distinct(regexp_extract_all(concat_ws(chr(10), {forms_sql(DONE, 'doc_id')}, text), '(?:负责|参与|主导|开发|设计)(?:了)?([^，。,.\\n]{{2,30}}?(?:项目|系统|平台))', 1))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter({_found}, lambda n: len(n) > 3 AND NOT contains({forms_sql(KNOWN, 'doc_id')}, n))), ',') AS projects FROM resumes")
def grd4_ungrounded_projects(v: Views) -> DataFrame:
    key = F.col("doc_id")
    names = G.ungrounded_projects(F.concat_ws("\n", *forms(DONE, key), "text"), forms(KNOWN, key)[0])
    return v.resumes.select("doc_id", F.array_join(F.array_sort(names), ",").alias("projects"))


VERIFIED = """SELECT doc_id, n_terms, n_suspicious, floor(conf * 100::DOUBLE + 0.5) / 100::DOUBLE AS confidence,
 CASE WHEN n_suspicious = 0 THEN 'none' WHEN conf < 0.7 OR n_suspicious >= 5 THEN 'high' WHEN conf < 0.85 OR n_suspicious >= 3 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT *, CASE WHEN n_terms > 0 THEN greatest(0, least(1, 1 - n_suspicious::DOUBLE / n_terms)) ELSE 1 END AS conf FROM (
 SELECT r.doc_id, coalesce(n, 0)::INTEGER AS n_terms, coalesce(b, 0)::INTEGER AS n_suspicious FROM resumes r LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) h USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS b FROM bad GROUP BY 1) c USING (doc_id)))"""


@query(TEXTS + VERIFIED)
def grd5_grounding_level(v: Views) -> DataFrame:
    return G.verify_resumes(_generated(v), _facts(v)).select("doc_id", "n_terms", "n_suspicious", "confidence", "level")


#: Project names in the generated texts that no vault has, by document.
CLAIMED = ("", "负责风控管理系统，开发订单平台。", "主导数据中台项目，参与电商平台，负责推荐引擎系统，设计统一支付平台。")
ADVISED = f"""SELECT x.doc_id, concat_ws(' / ', CASE WHEN level = 'none' THEN 'No claim without ground was found' END,
 CASE WHEN level <> 'none' AND stack > 0 THEN stack || ' technologies may not be part of your record: add the projects to the vault or take them out' END,
 CASE WHEN level <> 'none' AND len(names) > 0 THEN len(names) || ' projects may be invented: ' || array_to_string(names[1:3], ', ') || '; use names from the vault' END,
 CASE level WHEN 'high' THEN 'High risk: write the résumé again from the vault' WHEN 'medium' THEN 'Some risk: check these points' WHEN 'low' THEN 'Low risk: wording only' END,
 CASE WHEN level <> 'none' THEN 'Single paragraphs can be reworded in the chat' END) AS advice
FROM (SELECT *, CASE WHEN bad + len(names) = 0 THEN 'none' WHEN conf < 0.7 OR bad + len(names) >= 5 THEN 'high' WHEN conf < 0.85 OR bad + len(names) >= 3 THEN 'medium' ELSE 'low' END AS level
 FROM (SELECT *, CASE WHEN n_terms > 0 THEN greatest(0, least(1, 1 - (bad + len(names))::DOUBLE / n_terms)) ELSE 1 END AS conf
  FROM (SELECT r.doc_id, coalesce(h.n, 0) AS n_terms, coalesce(b.n, 0) AS bad, coalesce(b.stack, 0) AS stack, list_sort(CASE r.doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['风控管理系统', '订单平台'] ELSE ['数据中台项目', '电商平台', '推荐引擎系统', '统一支付平台'] END) AS names
   FROM resumes r LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) h USING (doc_id)
   LEFT JOIN (SELECT bad.doc_id, count(*) AS n, count(*) FILTER (category IN ('core_tech', 'framework')) AS stack FROM bad JOIN tech USING (term) GROUP BY 1) b USING (doc_id)))) x"""


@query(TEXTS + ADVISED)
def grd6_grounding_advice(v: Views) -> DataFrame:
    key = (F.col("doc_id") % 3 + 1).cast("int")
    rows = _generated(v).withColumn("text", F.concat_ws("\n", F.element_at(F.array(*map(F.lit, CLAIMED)), key), "text"))
    return G.verify_resumes(rows, _facts(v), terms=TECH, stack=("core_tech", "framework")).select("doc_id", F.array_join("advice", " / ").alias("advice"))


@query(TEXTS + f"SELECT doc_id, level IN ('none', 'low') AS verified FROM ({VERIFIED})")
def grd7_verify_resumes(v: Views) -> DataFrame:
    return G.verify_resumes(_generated(v), _facts(v)).select("doc_id", "verified")


#: Claims of two kinds for some documents; the others are read from the text.
CLAIMS = r""", given AS (SELECT doc_id, 'grew by ' || doc_id || '%' AS claim, 'verified' AS verdict, CASE WHEN doc_id % 2 = 0 THEN 'vault' ELSE '' END AS source, CASE WHEN doc_id % 4 = 0 THEN 0.9::DOUBLE END AS confidence FROM resumes WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 'knows all', 'suspicious', NULL, NULL FROM resumes WHERE doc_id % 6 = 0),
told AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s[1:100] AS claim FROM (
  SELECT doc_id, i, trim(ss[i]) AS s FROM (SELECT doc_id, regexp_split_to_array('revenue up 12.5% in a year。short 3%。' || coalesce(text, ''), '[。！？\n]')[1:5] AS ss FROM resumes WHERE doc_id % 3 <> 0), range(1, 6) r(i) WHERE i <= len(ss))
  WHERE len(s) > 10 AND regexp_matches(s, '[0-9]+(\.[0-9]+)?\s*[%倍万千亿]')),
items AS (
 SELECT doc_id, claim, CASE WHEN regexp_matches(claim, '[0-9]+(\.[0-9]+)?\s*[%倍万千亿]') THEN 'metric' WHEN verdict = 'verified' THEN 'skill' ELSE 'other' END AS claim_type,
  CASE WHEN verdict = 'suspicious' THEN 'hallucinated' WHEN source <> '' THEN 'vault_experience' ELSE 'inferred' END AS source_type, CASE WHEN verdict = 'suspicious' THEN 0.3::DOUBLE ELSE coalesce(confidence, 0.8::DOUBLE) END AS confidence,
  CASE WHEN verdict = 'suspicious' THEN 'warning' ELSE 'verified' END AS status FROM given
 UNION ALL SELECT doc_id, claim, 'metric', 'inferred', 0.7::DOUBLE, 'unverified' FROM told)
"""


def _claims(v: Views) -> tuple[DataFrame, DataFrame]:
    key = F.col("doc_id")
    told = v.resumes.select("doc_id", F.concat(F.lit("revenue up 12.5% in a year。short 3%。"), F.coalesce("text", F.lit(""))).alias("text"))
    sure = told.filter(key % 3 == 0).select("doc_id", F.concat(F.lit("grew by "), key.cast("string"), F.lit("%")).alias("claim"), F.lit("verified").alias("verdict"), F.when(key % 2 == 0, "vault").otherwise("").alias("source"), F.when(key % 4 == 0, 0.9).alias("confidence"))
    doubt = told.filter(key % 6 == 0).select("doc_id", F.lit("knows all").alias("claim"), F.lit("suspicious").alias("verdict"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("confidence"))
    return told, sure.unionByName(doubt)


@query(CLAIMS + "SELECT doc_id, md5(claim) AS claim, claim_type, source_type, confidence, status FROM items")
def grd8_provenance(v: Views) -> DataFrame:
    return G.provenance(*_claims(v)).select("doc_id", F.md5("claim").alias("claim"), "claim_type", "source_type", "confidence", "status")


@query(CLAIMS + "SELECT r.doc_id, coalesce(avg(confidence), 0.5::DOUBLE) AS confidence, count(claim)::BIGINT AS items FROM resumes r LEFT JOIN items USING (doc_id) GROUP BY 1")
def grd8_provenance_overall(v: Views) -> DataFrame:
    told, claims = _claims(v)
    return G.provenance_overall(told, G.provenance(told, claims))


@query(MATCH + f""", lines AS (SELECT p.job_id, p.posting, i - 1 AS pos, trim(ls[i]) AS line, ls[i] AS whole FROM pairs p JOIN (SELECT doc_id, string_split(text, chr(10))[1:5] AS ls FROM resumes) r USING (doc_id), range(1, 6) t(i) WHERE i <= len(ls)),
h AS (SELECT job_id, pos, any_value(whole) AS whole, list_sort(list(term)) AS hits FROM lines JOIN jt ON jt.job_id = lines.posting WHERE false GROUP BY 1, 2),
hit AS (SELECT l.job_id, l.pos, l.whole, list_sort(list(x.term)) AS hits FROM lines l JOIN (SELECT job_id AS posting, term FROM jt) x ON x.posting = l.posting AND regexp_matches(lower(l.whole), {_edge.replace('term', 'x.term')}) GROUP BY 1, 2, 3)
SELECT job_id, pos::INTEGER AS pos, row_number() OVER (PARTITION BY job_id ORDER BY len(hits) DESC, pos)::INTEGER AS rank, least(100, 10 * len(hits))::INTEGER AS score,
 md5(CASE WHEN len(whole) > 200 THEN whole[1:200] || '...' ELSE whole END) AS evidence, '匹配技能: ' || array_to_string(hits[1:3], ', ') AS reason FROM hit""".replace("h AS (SELECT job_id, pos, any_value(whole) AS whole, list_sort(list(term)) AS hits FROM lines JOIN jt ON jt.job_id = lines.posting WHERE false GROUP BY 1, 2),\n", ""))
def grd9_recall_experiences(v: Views) -> DataFrame:
    parts = F.transform(F.split("text", "\n"), lambda s: F.struct(F.lit("").alias("title"), F.lit("").alias("company"), s.alias("description")))
    jobs = v.resumes.select(F.col("doc_id").alias("job_id"), "posting", parts.alias("experiences")).join(_jds(v).select(F.col("job_id").alias("posting"), F.col("jd_terms").alias("required")), "posting")
    return G.recall_experiences(jobs, tuple(TERMS)).select("job_id", "pos", "rank", "score", F.md5("evidence").alias("evidence"), "reason")


@query(MATCH + "SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY term) - 1)::INTEGER AS pos, term, CASE WHEN term IN ('the', 'of') THEN 'technical' ELSE 'general' END AS category FROM jt QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY term) <= 8")
def grd10_jd_requirements(v: Views) -> DataFrame:
    return G.jd_requirements(_jds(v), ("the", "of"))
