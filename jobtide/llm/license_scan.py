"""Licence scan by a positional rare-token index, in DataFrame functions only.

A template is a licence phrase or notice with its mandatory key phrases, which stand at fixed places in it. One
aggregation over the corpus counts in how many texts each key word stands; the two rarest (highest IDF) of a template are
its entries in the index: a map from word to postings (template, offset). Every text looks up those of its words that
are in the index: a word's place less a posting's offset is a possible start. The starts of first and second entries are
intersected, template by template at once, and what is left is verified by the key phrases. All templates share these
steps, so the cost follows the rare words of a text and not the number of templates. Every true place holds both
entries, so none is lost.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

Defined results: a null or empty text has no words, no places, empty labels, null first and last word and score 0;
repeated rows are scanned each for itself; equal words in a tie of rarity are taken in template order; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels of our own: key phrases in brackets must stand word for word, at their places in the notice.
OWN = (
    ("[lesser general public license]", "lgpl"),
    ("[affero general public license]", "agpl"),
    ("[mozilla public license]", "mpl"),
    ("[redistribution and use in source and binary forms]", "bsd"),
    ("[bsd license]", "bsd"),
    ("[isc license]", "isc"),
    ("[creative commons]", "cc"),
    ("[permission is hereby granted free of charge]", "mit-grant"),
    ("[licensed under the apache license version 2 0]", "apache-notice"),
    ("[released into the public domain]", "public-domain"),
    ("[all rights reserved]", "reserved"),
    ("[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to [deal in the software without restriction]", "mit-notice"),
    ("[redistribution and use in source and binary forms] with or without modification are [permitted provided that the following conditions are met]", "bsd-notice"),
    ("this program is free software you can [redistribute it and or modify it under the terms of the gnu] general public license as [published by the free software foundation]", "gpl-notice"),
    ("[permission to use copy modify and or distribute this software] for any purpose with or without fee [is hereby granted]", "isc-notice"),
    ("this source code form is [subject to the terms of the mozilla public license]", "mpl-notice"),
    ("this is [free and unencumbered software released into the public domain]", "unlicense"),
    ("the software is [provided as is without warranty of any kind]", "no-warranty"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def rarity(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Number of texts that hold each word of the (fixed, small) vocabulary; absent words count 0."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.array_intersect(word_array(F.col(text)), words)).alias("word"))
    rows = seen.groupBy("word").agg(F.count("*").alias("n")).collect()  # one row per vocabulary word at most
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in rows}


def parsed(notice: str) -> tuple[int, list[tuple[int, list[str]]]]:
    """Number of words of a notice, and its key phrases with their places; without brackets all is one key phrase."""
    notice = notice if "[" in notice else f"[{notice}]"
    phrases, at = [], 0
    for k, part in enumerate(notice.replace("]", "[").split("[")):
        words = part.split()
        if k % 2 and words:
            phrases.append((at, words))
        at += len(words)
    return at, phrases


def rare_entries(notice: str, df: dict[str, int], keep: int = 2) -> list[tuple[str, int]]:
    """The index entries of a template: its ``keep`` rarest key words with the offset of their first place; one that stands alone twice."""
    places = [(w, at + k) for at, words in parsed(notice)[1] for k, w in enumerate(words)]
    first = {w: k for w, k in reversed(places)}
    found = sorted(first.items(), key=lambda x: (df[x[0]], x[1]))[:keep]
    return found if len(found) == keep else found * keep


def _postings(notices: list[str], df: dict[str, int]) -> Column:
    """The index: word to postings (template, offset, entry)."""
    index: dict[str, list[tuple[int, int, int]]] = {}
    for t, notice in enumerate(notices):
        for entry, (word, offset) in enumerate(rare_entries(notice, df)):
            index.setdefault(word, []).append((t, offset, entry))
    posting = lambda t, o, e: F.struct(F.lit(t).alias("t"), F.lit(o).alias("offset"), F.lit(e).alias("entry"))
    return F.create_map(*[x for word, found in index.items() for x in (F.lit(word), F.array(*[posting(*p) for p in found]))])


def _verified(words: Column, hits: Column, templates: list[tuple[str, str, bool]], df: dict[str, int]) -> Column:
    """Places of all templates: postings of the rare words, intersected by relative position, then key phrases."""
    notices = [n for n, _, _ in templates]
    index = _postings(notices, df)
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["offset"]).alias("start"), p["entry"].alias("entry")))))
    of_entry = lambda found, e: F.transform(F.filter(found, lambda s: s["entry"] == e), lambda s: F.struct(s["t"].alias("t"), s["start"].alias("start")))
    phrase = lambda at, ws: F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, ws)).alias("words"))
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(parsed(n)[0]).alias("n_words"), F.lit(base).alias("base"), F.array(*[phrase(*p) for p in parsed(n)[1]]).alias("keys"))
        for n, label, base in templates
    ])
    holds = lambda s, keys: (s >= 0) & F.forall(keys, lambda k: F.slice(words, F.greatest(s, F.lit(0)) + k["at"] + 1, F.size(k["words"])) == k["words"])
    both = F.transform(F.array(starts), lambda x: F.array_intersect(of_entry(x, 0), of_entry(x, 1)))[0]
    named = F.transform(both, lambda c: F.struct(F.element_at(table, c["t"] + 1).alias("of"), c["start"].alias("start")))
    kept = F.filter(named, lambda c: holds(c["start"], c["of"]["keys"]))
    return F.transform(kept, lambda c: F.struct(c["of"]["label"].alias("label"), c["start"].alias("start"), c["of"]["n_words"].alias("n_words"), c["of"]["base"].alias("base")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), own=OWN) -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``places`` lists every verified place as struct(label, start, n_words, base). ``score`` is 1 - 2^-p for p places:
    no evidence is 0, one place one half, many places near 1.
    """
    templates = [(p, label, True) for p, label in BASE] + [(p, label, False) for p, label in own]
    df = rarity(docs, sorted({w for n, _, _ in templates for _, ws in parsed(n)[1] for w in ws}), text)
    rare = sorted({w for n, _, _ in templates for w, _ in rare_entries(n, df)})
    none = F.expr("cast(array() as array<struct<label:string,start:int,n_words:int,base:boolean>>)")
    rows = docs.select(*keep, word_array(F.col(text)).alias("_w"))
    rows = rows.withColumn("_h", F.transform("_w", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))))
    rows = rows.withColumn("_h", F.array_compact("_h"))
    found = F.when(F.size("_h") > 0, _verified(F.col("_w"), F.col("_h"), templates, df)).otherwise(none)
    rows = rows.select(*keep, F.size("_w").cast("long").alias("n_words"), found.alias("places"))
    base = F.filter("places", lambda x: x["base"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return rows.select(
        *keep,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(0.5), F.size("places").cast("double"))).alias("score"),
        "places",
    )


def oracle() -> str:
    """The same result in SQL over ``documents``: word lists, and every phrase compared at every position."""
    templates = [(p, label, 1) for p, label in BASE] + [(p, label, 0) for p, label in OWN]
    parts = []
    for p, label, base in templates:
        test = " AND ".join(f"w[i + {at + k + 1}] = '{word}'" for at, words in parsed(p)[1] for k, word in enumerate(words))
        parts.append(f"SELECT rid, '{label}' AS label, {base} AS base, i AS start FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM d) WHERE {test}")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
hit AS ({' UNION ALL '.join(parts)}),
g AS (
  SELECT rid, sum(base)::BIGINT AS n_base, min(CASE WHEN base = 1 THEN start END)::BIGINT AS first_word,
         max(CASE WHEN base = 1 THEN start END)::BIGINT AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base = 1))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, count(*) AS n
  FROM hit GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       (1.0::DOUBLE - power(0.5::DOUBLE, coalesce(n, 0)::DOUBLE)) AS score
FROM d LEFT JOIN g USING (rid)"""
