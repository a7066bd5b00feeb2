"""The pipeline's stages, each on its predecessor's rows."""

import re

import corpus_pipeline
import pytest

from sumlight.llm import ngram_join, toxicity
from sumlight.llm.common import read

SF = "/root/testdata/sf0.01"


def near_copies_left(rows):
    sets = [(r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))) for r in rows if (w := (r.text or "").encode().lower().split())]
    by = {}
    for i, s in sets:
        for g in s:
            by.setdefault(g, []).append((i, s))
    return {(i, j) for i, s in sets for g in s for j, t in by[g] if j < i and 5 * len(s & t) >= 4 * len(s | t)}


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = docs.collect()
        assert name == "mixing" or docs.columns == columns
    assert 0.8 * before < len(held["toxicity"]) < before
    assert not near_copies_left(held["near_copies"]) and len(held["near_copies"]) >= 0.8 * len(held["toxicity"])
    kept = {r.doc_id for r in held["decontamination"]}
    assert {r.doc_id for r in held["pii"]} == kept < {r.doc_id for r in held["near_copies"]}
    assert not re.search(r"@mail\d\.example\.com", " ".join(r.text or "" for r in held["pii"]))
    assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in held["pii"] if r.text is not None)
    assert {r.doc_id for r in held["mixing"]} <= kept and all(1 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in held["mixing"])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_and_no_rows(spark, frame, odd_rows, stage):
    assert stage(spark, frame([]), SF).count() == 0
    assert stage(spark, frame(odd_rows), SF).count() <= len(odd_rows) * 3


def test_one_of_each_group_stays(spark, frame):
    text = " ".join(f"w{i}" for i in range(100))
    docs = frame([(5, text, "a"), (3, text + " more", "a"), (9, "something else", "a"), (4, None, "a")])
    assert sorted(r.doc_id for r in ngram_join.representatives(docs).collect()) == [3, 4, 9]


def test_null_ids_and_repeated_rows_are_copies_too(spark, frame):
    text, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    docs = frame([(None, text, "a"), (None, text + " more", "a"), (5, other, "a"), (5, other, "a"), (5, other, "b"), (6, other + " x", "a"), (5, "something else", "a"), (7, None, "a"), (7, None, "a"), (None, "", "a")])
    left = ngram_join.representatives(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in left.collect())
    assert got == [(0, ""), (0, "w0 w1 w2 "), (5, "something"), (5, "v0 v1 v2 "), (7, ""), (7, "")]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[k for k, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, stage):
    names = ["pii_rk", "pii_more", "pii_spans", "toxicity_score", "text_bytes", "decontamination_rk", "ngram_join_rk", "stays", "copies", "whole", "threshold", "taken", "mix_hash", "mix_size", "mix_copies", "mix_source", "hash", "size", "row", "s", "salt", "source_size", "target", "prefix"]
    docs = spark.createDataFrame([(1, "mail a@b.com", "e", "s", 12, *names)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    rows = stage(spark, docs, SF)
    assert len(set(rows.columns)) == len(rows.columns)
    assert [[r[n] for n in names] for r in rows.collect()] == [names]


def test_rejected_are_the_classifiers(spark):
    docs = read(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    flagged = {r.doc_id for r in toxicity.flag(docs, read(spark, SF, "labels")).collect() if r.predicted}
    assert flagged and kept == {r.doc_id for r in docs.select("doc_id").collect()} - flagged
