"""Vocabulary terms in texts, and résumé-to-job matching on term arrays.

A vocabulary is a table (term, category, weight) of fixed size; it travels to the tasks with the code. Texts are scanned
once by an automaton of all terms, so the cost doesn't grow with the vocabulary.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalar import round_n, truncating_percent
from jobtide.functions.scan import SEPARATORS, named, scan_of

CATEGORY_FACTOR = {"core_tech": 0.95, "framework": 0.90, "tool": 0.85, "soft_skill": 0.80}

Vocabulary = tuple[tuple[str, str, float], ...]


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms:
        if term:
            held = found.get(term.lower(), ())
            found.add_word(term.lower(), (*held, term))
    if len(found):
        found.make_automaton()
    return found


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def edges_hold(text: str, start: int, end: int, mode: str) -> bool:
    """Whether the neighbours of text[start:end] let it count as a term of its own."""
    left, right = text[start - 1] if start else "", text[end] if end < len(text) else ""
    if mode == "ascii_edge":
        if _alnum(text[start]) and left and _alnum(left) or _alnum(text[end - 1]) and right and _alnum(right):
            return False
        return not (end - start <= 2 and (left and left in "+#&." or right and right in "+#&"))
    word = lambda c: c == "_" or c.isalnum()
    bound = lambda a, b: bool(a and word(a)) != bool(b and word(b))
    if mode == "unicode_word":
        return bound(left, text[start]) and bound(text[end - 1], right)
    if mode == "sep_or_word":
        return (not left or left in SEPARATORS or bound(left, text[start])) and (not right or right in SEPARATORS or bound(text[end - 1], right))
    if mode == "sep_only":
        return (not left or left in SEPARATORS) and (not right or right in SEPARATORS)
    raise ValueError(mode)


def terms_in(text: str | None, terms: tuple[str, ...], mode: str = "ascii_edge") -> list[str]:
    """The terms that stand in one text, each tested on its own, sorted (for whole batches: ``match_terms``)."""
    found, low = set(), (text or "").lower()
    machine = _automaton(terms)
    if low and len(machine):
        for end, names in machine.iter(low):
            for name in names:
                if name not in found and edges_hold(low, end + 1 - len(name), end + 1, mode):
                    found.add(name)
    return sorted(found)


def match_terms(text: Column, terms: tuple[str, ...], mode: str = "ascii_edge", aliases: dict[str, str] | None = None) -> Column:
    """Array of the terms in a text, sorted; an alias that stands there adds its canonical term."""
    aliases = aliases or {}
    names = tuple(dict.fromkeys((*terms, *aliases)))
    own = frozenset(terms)

    shown = sorted({*own, *aliases.values()})
    place = {t: k for k, t in enumerate(shown)}
    # A name stands for itself if it is a term, and for its canonical term if it is an alias.
    stands = [(k, place[x]) for k, t in enumerate(names) for x in ([t] if t in own else []) + ([aliases[t]] if t in aliases else [])]
    by_name = np.zeros((len(names) + 1, 2), np.int64) - 1
    for k, x in stands:
        by_name[k, 0 if by_name[k, 0] < 0 else 1] = x

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        hits = scan_of(names, mode).hits(texts.to_pylist())
        both = by_name[hits.term]
        some = both >= 0
        return named(len(texts), np.repeat(hits.text, 2)[some.ravel()], both.ravel()[some.ravel()], shown)

    return run(text)


def term_in_text(term: str, text: Column) -> Column:
    """One term by a pattern with look-around, inside the JVM."""
    import re

    short = len(term) <= 2
    left = r"(?<![A-Za-z0-9" + ("+#&." if short else "") + "])" if _alnum(term[0]) else (r"(?<![+#&.])" if short else "")
    right = r"(?![A-Za-z0-9" + ("+#&" if short else "") + "])" if _alnum(term[-1]) else (r"(?![+#&])" if short else "")
    return F.coalesce(F.regexp_like(text, F.lit(f"(?i){left}{re.escape(term)}{right}")), F.lit(False))


def extract_terms(texts: DataFrame, vocabulary: Vocabulary, aliases: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """``terms``: the vocabulary terms of each text."""
    return texts.withColumn("terms", match_terms(F.col(text), tuple(dict.fromkeys(t for t, _, _ in vocabulary)), aliases=aliases))


def _in_category(terms: Column, vocabulary: Vocabulary, category: str) -> Column:
    own = F.array(*[F.lit(t) for t, c, _ in vocabulary if c == category])
    return F.array_sort(F.array_intersect(terms, own))


def categories(vocabulary: Vocabulary) -> dict[str, float]:
    """Categories in order, with their weights."""
    return {c: next(w for _, d, w in vocabulary if d == c) for c in dict.fromkeys(c for _, c, _ in vocabulary)}


def terms_by_category(rows: DataFrame, vocabulary: Vocabulary, ident: str) -> DataFrame:
    """Long form of ``terms``: ident, category, n_terms, score. A term in two categories counts in both."""
    parts = [
        F.struct(F.lit(c).alias("category"), F.size(_in_category(F.col("terms"), vocabulary, c)).alias("n_terms"), F.lit(w).alias("weight")) for c, w in categories(vocabulary).items()
    ]
    out = rows.select(ident, F.explode(F.array(*parts)).alias("x")).select(ident, "x.*")
    return out.filter("n_terms > 0").select(ident, "category", "n_terms", (F.col("n_terms") * F.col("weight")).alias("score"))


def detect_job_type(text: Column, cues: dict[str, tuple[str, ...]]) -> Column:
    """The type with most cue words in the text, the earlier one on ties, ``default`` when there is none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [(name, sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0))) for name, words in cues.items()]
    best = F.greatest(*[s for _, s in scores], F.lit(0))
    out = F.lit("default")
    for name, s in reversed(scores):
        out = F.when((best > 0) & (s == best), F.lit(name)).otherwise(out)
    return out


def job_type_weights(types: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """The category weights of each row's ``job_type``; unknown types get those of ``default``."""
    table = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.create_map(*[y for c, v in w.items() for y in (F.lit(c), F.lit(v))]))])
    return types.withColumn("weights", F.coalesce(F.element_at(table, F.col("job_type")), F.element_at(table, F.lit("default"))))


# Matching


def keyword_sets(jd: Column, resume: Column) -> Column:
    """Struct(matched, missing, extra) of two term arrays, sorted."""
    return F.struct(
        F.array_sort(F.array_intersect(jd, resume)).alias("matched"), F.array_sort(F.array_except(jd, resume)).alias("missing"), F.array_sort(F.array_except(resume, jd)).alias("extra")
    )


def match_suggestions(matched: Column, missing: Column) -> Column:
    """Sentences from the first five matched and missing terms."""
    named = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(F.slice(x, 1, 5), ", ")))
    close = F.when(F.size(missing) == 0, F.lit("Covers every term of the description")).otherwise(F.lit("Name concrete results for each term"))
    return F.array_compact(F.array(named("Point out: ", matched), named("Add if true: ", missing), close))


def keyword_match(pairs: DataFrame, most: int = 20) -> DataFrame:
    """Rows with ``jd_terms`` and ``resume_terms``: score, matched and missing (cut after sorting), suggestions."""
    rows = pairs.withColumn("_s", keyword_sets(F.col("jd_terms"), F.col("resume_terms")))
    return rows.select(
        *pairs.columns, truncating_percent(F.size("_s.matched"), F.size("jd_terms")).alias("score"),
        F.slice("_s.matched", 1, most).alias("matched"), F.slice("_s.missing", 1, most).alias("missing"), match_suggestions(F.col("_s.matched"), F.col("_s.missing")).alias("suggestions"),
    )


def skill_confidence(term: Column, category: Column, matched: Column) -> Column:
    """Factor of the category, raised for long and lowered for short terms, at most 1; 0 if not matched."""
    factor = F.lit(0.80)
    for name, value in CATEGORY_FACTOR.items():
        factor = F.when(category == name, F.lit(value)).otherwise(factor)
    factor = F.when(F.length(term) >= 8, factor * 1.05).when(F.length(term) <= 3, factor * 0.95).otherwise(factor)
    return F.when(matched, F.least(F.lit(1.0), factor)).otherwise(F.lit(0.0))


def skill_pairs(pairs: DataFrame, vocabulary: Vocabulary, ident: str = "job_id") -> DataFrame:
    """One row per (job, category, term) that stands on either side: found flags, matched, weight, confidence."""
    items = []
    for c, w in categories(vocabulary).items():
        both = F.array_union(_in_category(F.col("jd_terms"), vocabulary, c), _in_category(F.col("resume_terms"), vocabulary, c))
        items.append(_tagged(both, c, w))
    rows = pairs.select(ident, "jd_terms", "resume_terms", F.explode(F.concat(*items)).alias("x"))
    rows = rows.select(ident, "x.*", F.array_contains("jd_terms", F.col("x.term")).alias("in_jd"), F.array_contains("resume_terms", F.col("x.term")).alias("in_resume"))
    rows = rows.withColumn("matched", F.col("in_jd") & F.col("in_resume"))
    return rows.withColumn("confidence", skill_confidence(F.col("term"), F.col("category"), F.col("matched")))


def _tagged(terms: Column, category: str, weight: float) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(category).alias("category"), F.lit(weight).alias("weight")))


def dimension_scores(pairs: DataFrame, vocabulary: Vocabulary, ident: str = "job_id") -> DataFrame:
    """One row per (job, category): score (100 without terms in the description), weight, matched and missing counts."""
    items = []
    for c, w in categories(vocabulary).items():
        jd, resume = _in_category(F.col("jd_terms"), vocabulary, c), _in_category(F.col("resume_terms"), vocabulary, c)
        items.append(F.struct(F.lit(c).alias("category"), F.lit(w).alias("weight"), F.size(jd).alias("n_jd"), F.size(F.array_intersect(jd, resume)).alias("n_matched")))
    rows = pairs.select(ident, F.explode(F.array(*items)).alias("x")).select(ident, "x.*")
    score = F.when(F.col("n_jd") == 0, F.lit(100.0)).otherwise(round_n(F.col("n_matched") / F.nullif(F.col("n_jd"), F.lit(0)) * 100, 2))
    return rows.withColumn("score", score).withColumn("n_missing", F.col("n_jd") - F.col("n_matched"))


def overall_score(dimensions: DataFrame, ident: str = "job_id") -> DataFrame:
    """Weighted mean of the dimension scores that have terms in the description; 0 if none has."""
    there = F.col("n_jd") > 0
    rows = dimensions.groupBy(ident).agg(F.sum(F.when(there, F.col("score") * F.col("weight"))).alias("s"), F.sum(F.when(there, F.col("weight"))).alias("w"))
    return rows.select(ident, F.coalesce(round_n(F.col("s") / F.col("w"), 2), F.lit(0.0)).alias("overall"))


def match_confidence(skills: DataFrame, ident: str = "job_id") -> DataFrame:
    """0 to 1 from the number of terms, the confidence of the matched ones (summed in ten-thousandths: the order doesn't matter) and the categories matched."""
    once = F.when
    rows = skills.groupBy(ident).agg(
        F.count_distinct(once(F.col("in_jd"), F.col("term"))).alias("n_jd"), F.count_distinct(once(F.col("in_resume"), F.col("term"))).alias("n_resume"),
        (F.sum(once(F.col("matched"), F.floor(F.col("confidence") * 10000 + 0.5))) / 10000.0).alias("sc"), F.count_if("matched").alias("n_matched"),
        F.count_distinct(once(F.col("in_jd"), F.col("category"))).alias("c_jd"), F.count_distinct(once(F.col("matched"), F.col("category"))).alias("c_matched"),
    )
    value = (
        0.25 * F.least(F.col("n_jd") / 5.0, F.lit(1.0)) + 0.35 * F.coalesce(F.col("sc") / F.nullif(F.col("n_matched"), F.lit(0)), F.lit(0.0))
        + 0.25 * F.coalesce(F.col("c_matched") / F.nullif(F.col("c_jd"), F.lit(0)), F.lit(0.0)) + 0.15 * F.least(F.col("n_resume") / 10.0, F.lit(1.0))
    )
    return rows.select(ident, F.when(F.col("n_jd") > 0, round_n(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)).otherwise(F.lit(0.0)).alias("confidence"))


def weighted_match(pairs: DataFrame, vocabulary: Vocabulary, ident: str = "job_id") -> DataFrame:
    """One row per job: overall score, confidence, matched, missing and extra terms with totals."""
    score = overall_score(dimension_scores(pairs, vocabulary, ident), ident)
    sure = match_confidence(skill_pairs(pairs, vocabulary, ident), ident)
    sets = pairs.select(ident, keyword_sets(F.col("jd_terms"), F.col("resume_terms")).alias("s")).select(ident, "s.*")
    rows = sets.join(score, ident).join(sure, ident, "left")
    return rows.select(ident, "overall", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "matched", "missing", "extra", F.size("matched").alias("n_matched"), F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"))


def category_match(pairs: DataFrame, vocabulary: Vocabulary, ident: str = "job_id") -> DataFrame:
    """Whole percent of the weighted terms of the description that are matched."""
    rows = dimension_scores(pairs, vocabulary, ident).groupBy(ident).agg(F.sum(F.col("n_matched") * F.col("weight")).alias("got"), F.sum(F.col("n_jd") * F.col("weight")).alias("of"))
    return rows.select(ident, truncating_percent("got", "of").alias("score"))


def match_results(applications: DataFrame, results: DataFrame, vaults: DataFrame) -> DataFrame:
    """Results by application (``id``), with the vault version and the description (its digest) that they were made from."""
    new = results.select(F.col("job_id").alias("id"), F.col("overall").cast("int").alias("match_score"))
    own = applications.select("id", "user_id", F.sha2("jd_text", 256).alias("source_jd_digest"))
    rows = new.join(own, "id").join(vaults.select("user_id", F.col("version").alias("source_vault_version")), "user_id", "left")
    return rows.select("id", "match_score", "source_vault_version", "source_jd_digest")


def save_match(applications: DataFrame, results: DataFrame, vaults: DataFrame) -> DataFrame:
    """Applications with the score and what it was made from; others keep what they had. ``match_results`` with ``KeyedTable.upsert`` writes them in place."""
    own = ("match_score", "source_vault_version", "source_jd_digest")
    new = match_results(applications, results, vaults).select("id", F.struct(*own).alias("new"))
    rows = applications.join(new, "id", "left")
    return rows.withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in own}).drop("new")


def term_counts(pairs: DataFrame, which: str, user: str = "user_id") -> DataFrame:
    """Number of descriptions per user and term of ``which``: jd_terms (demand) or missing (gaps)."""
    return pairs.select(user, F.explode(which).alias("term")).groupBy(user, "term").agg(F.count("*").alias("n"))


# Scores that are given


DIMENSIONS = {"skills": 0.35, "experience": 0.35, "projects": 0.20, "education": 0.10}
BANDS = ((85, "excellent"), (70, "good"), (55, "fair"), (0, "weak"))


def combine_scores(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per pair: whole weighted sum of the dimension scores, 0 to 100; a missing dimension counts 50."""
    weights = weights or DIMENSIONS
    one = [F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("score"))), F.lit(50)) * F.lit(w) for d, w in weights.items()]
    total = sum(one[1:], one[0])
    return scores.groupBy("pair_id").agg(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(total + 1e-9).cast("int"))).alias("score"))


def score_summary(scores: DataFrame, combined: DataFrame) -> DataFrame:
    """Band of the combined score, strong (75 and more) and weak (below 60) dimensions, joined text."""
    lists = scores.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("score") >= 75, F.col("dimension")))).alias("strong"), F.array_sort(F.collect_list(F.when(F.col("score") < 60, F.col("dimension")))).alias("weak")
    )
    band = F.lit(BANDS[-1][1])
    for least, name in reversed(BANDS[:-1]):
        band = F.when(F.col("score") >= least, F.lit(name)).otherwise(band)
    rows = combined.join(lists, "pair_id").withColumn("band", band)
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    text = F.array_join(F.array_compact(F.array(F.col("band"), part("strong: ", "strong"), part("weak: ", "weak"))), "; ")
    return rows.select("pair_id", "score", "band", "strong", "weak", text.alias("summary"))


def _ordered(scores: DataFrame, item: Column, most: int, name: str) -> DataFrame:
    place = F.lit(len(DIMENSIONS))
    for k, d in reversed(list(enumerate(DIMENSIONS))):
        place = F.when(F.col("dimension") == d, F.lit(k)).otherwise(place)
    rows = scores.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), item.alias("x")))).alias("r"))
    flat = F.array_distinct(F.filter(F.flatten(F.transform("r", lambda r: r["x"])), lambda x: F.coalesce(x, F.lit("")) != ""))
    return rows.select("pair_id", F.slice(flat, 1, most).alias(name))


def top_strengths(scores: DataFrame) -> DataFrame:
    """First two matched terms of each dimension from 70 on, distinct, five at most."""
    return _ordered(scores, F.when(F.col("score") >= 70, F.slice("matched", 1, 2)).otherwise(F.expr("cast(array() as array<string>)")), 5, "strengths")


def key_gaps(scores: DataFrame) -> DataFrame:
    """First two missing terms of each dimension below 70, distinct, five at most."""
    return _ordered(scores, F.when(F.col("score") < 70, F.slice("missing", 1, 2)).otherwise(F.expr("cast(array() as array<string>)")), 5, "gaps")


def action_items(scores: DataFrame) -> DataFrame:
    """Distinct suggestions in the order of the dimensions, six at most."""
    return _ordered(scores, F.col("suggestions"), 6, "actions")
