"""The pipeline, stage by stage, against plain versions of its decisions."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

from .test_operators import brute_groups, split


@pytest.fixture(scope="module")
def stages(spark, awkward, tmp_path_factory):
    home = tmp_path_factory.mktemp("sf")
    junk = [(2000 + k, f"BUY!!! NOW!!! $$$ {k} ### %%% CLICK!!! AAA%%% BBB%%%", "en", "b", 1, 0.5, 7, "x") for k in range(40)]
    docs = spark.createDataFrame(awkward + junk, "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, label string")
    docs.write.parquet(str(home / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in awkward if r[0] and r[1] and len(split(r[1])) > 30] + [(r[0], 0, 0) for r in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(home / "labels.parquet"))
    out, now = {}, spark.read.parquet(str(home / "documents.parquet"))
    for name, stage in P.STAGES:
        stage(spark, now, str(home)).write.parquet(str(home / name))
        nxt = spark.read.parquet(str(home / name))
        out[name] = (now, nxt)
        now = nxt
    return out


def test_columns(stages):
    first = stages["language"][0].columns
    for name in ("language", "quality", "near_duplicates", "mixing"):
        assert stages[name][1].columns == first


def test_language_rejects_texts_without_letters(stages):
    before, after = stages["language"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert {1, 2, 3, 10} <= gone
    assert all(re.search(r"\w", r["text"]) for r in after.collect())


def test_quality_rejects_junk_and_keeps_clean_texts(stages):
    before, after = ({r["doc_id"] for r in x.collect()} for x in stages["quality"])
    assert not {k for k in after if k and k >= 2000}
    assert {k for k in before if k and 100 <= k < 200} <= after


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
    assert after.count() == len({g for _, _, g in groups})
    rows = after.collect()
    assert len({r["text"] for r in rows}) == len(rows)


def test_mixing_draws_whole_texts(stages):
    before, after = stages["mixing"]
    known = {r["text"] for r in before.collect()}
    copies = Counter(r["text"] for r in after.collect())
    assert set(copies) <= known and max(copies.values()) <= 2


def test_ids_are_the_library_s(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in before.collect())
    assert Counter(tuple(r["ids"]) for r in after.collect()) == want


def test_stages_on_empty_tables_and_null_columns(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None)] * 2, empty.schema)
    for name, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        assert stage(spark, nulls, str(tmp_path)).count() == {"language": 0, "mixing": 0}.get(name, 2), name


def test_quality_rejects_what_the_classifier_predicts_as_0(spark, tmp_path, monkeypatch):
    from jobtide.llm import quality

    docs = spark.createDataFrame([(k, f"text {k}", "en", "a", 6) for k in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for prior, kept in ((0.3, 0), (0.5, 10)):
        model = quality.Model(None, None, {}, prior=prior)
        monkeypatch.setattr(quality, "train", lambda *_, model=model, **__: model)
        assert P.good(spark, docs, str(tmp_path)).count() == kept
