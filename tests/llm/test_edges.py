"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns
with clashing names, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from histospark.llm import (bpe, exact_dedup, language_id, lm_scoring, mixing, ngram_join, pii, quality_classifier,
                            quality_rules, token_rollup)
from histospark.llm.common import stored
from tests.llm import brute

LONG = "alpha beta gamma delta " * 5000
ROWS = [(1, "the quick brown fox jumps over the dog", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "", ""),
        (None, "the quick brown fox jumps over the dog", "en", "b"), (None, None, None, "b"), (5, LONG, "en", "a"), (6, LONG, "en", None),
        (7, "x" * 30000, "de", "c"), (8, "one two", "en", "a"), (8, "one two", "en", "a"), (9, "one two", None, "a"),
        (10, "\U0001f388 é 4111 1111 1111 1111", "fr", "c"), (11, "5" * 2000, "en", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for clash in ("size", "keep_id", "id", "word", "h", "n", "target", "kept", "bucket"):
        df = df.withColumn(clash, F.lit("clash"))
    return stored(df, "edge-docs")


@pytest.fixture(scope="module")
def empty(docs):
    return stored(docs.limit(0), "edge-empty")


def test_exact_dedup(docs, empty):
    rows = exact_dedup.duplicate_groups(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        assert sum(r.kept for r in group) == 1
        assert {r.group_size for r in group} == {len(group)}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
    assert exact_dedup.duplicate_groups(empty).collect() == []
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert left.count() == len({t or "" for _, t, _, _ in ROWS})
    assert exact_dedup.keep_one(empty).count() == 0


def test_exact_dedup_splits_heavy_groups(spark):
    df = spark.createDataFrame([(i, f"text {i % 7 if i % 3 else 'hot'}") for i in range(600)], "doc_id long, text string").repartition(5)
    for k in (1, 4096):
        rows = exact_dedup.duplicate_groups(df, k).collect()
        sizes = {}
        for r in rows:
            sizes.setdefault(r.text_sha256, set()).add((r.keep_id, r.group_size))
        assert len(rows) == 600 and all(len(v) == 1 for v in sizes.values())
        assert (597, 200) in {next(iter(v)) for v in sizes.values()}
        assert sum(r.kept for r in rows) == len(sizes) == exact_dedup.keep_one(df, k).count()


def test_mixing(docs, empty):
    rows = docs.select("doc_id", "source", mixing.n_words().alias("size"))
    got = mixing.mix(stored(rows, "edge-sizes"), block=7).collect()
    assert len(got) == len(ROWS)
    assert sorted(r["size"] for r in got) == sorted(len(brute.WORD.findall(t or "")) for _, t, _, _ in ROWS)
    taken, targets = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    total = sum(r["size"] for r in got)
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(stored(rows.limit(0), "edge-sizes")).collect() == []
    mixed = mixing.mixed_documents(docs, block=7)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.n_words())).first()[0] == sum(r.taken for r in got)
    assert mixing.mixed_documents(empty).count() == 0


def test_schedule_spreads_the_slots(spark):
    src = spark.createDataFrame([("a", 0, 4096, 6144.0), ("b", 1, 1024, 1024.0), (None, 2, 512, 100.0)], "source string, no int, source_size long, target double")
    slots = mixing.schedule(src, block=16).orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots)
    for s, target in (("a", 6144), ("b", 1024), (None, 100)):
        own = [r for r in slots if r.source == s]
        assert sum(r.use for r in own) == target
        # of the first n slots every source has its share, up to a few
        for n in range(50, len(slots), 50):
            assert abs(sum(r.source == s for r in slots[:n]) - n * len(own) / len(slots)) < 6


def test_ngram_join(docs, empty):
    got = ngram_join.near_duplicates(docs, 3, 90, 100).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    want = brute.components({d: t for d, t, _, _ in ROWS if d is not None})
    assert {d: r.n_shingles for d, r in by.items()} == {d: w[0] for d, w in want.items()}
    assert {d: r.component_id for d, r in by.items()} == {d: w[1] for d, w in want.items()}
    assert sorted(r.component_id or -1 for r in got if r.doc_id is None) == [-1, 1]  # a copy of 1, and no words
    assert ngram_join.near_duplicates(empty).collect() == []
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10, 11]
    assert ngram_join.keep_one(empty).count() == 0


def test_bpe(docs, empty):
    got = bpe.encode(docs, digest=True).collect()
    assert len(got) == len(ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert bpe.encode(empty).collect() == []
    assert bpe.decode(bpe.encode(empty).select("doc_id", "ids")).collect() == []


def test_language_id(docs, empty):
    model = language_id.train(docs, F.col("doc_id").isNotNull())
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(ROWS)
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (2, 3, 4, 11)) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language_id.train(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).collect() == []


def test_lm_scoring(docs, empty):
    slim = docs.select("doc_id", "text")
    got = lm_scoring.score(slim, *lm_scoring.train(slim)).collect()
    assert len(got) == len(ROWS)
    assert all((r.perplexity is None) == (r.n_tokens == 0) and r.log_prob <= 0 for r in got)
    nothing = lm_scoring.train(empty.select("doc_id", "text"))
    assert len(lm_scoring.score(slim, *nothing).collect()) == len(ROWS)
    assert lm_scoring.score(empty.select("doc_id", "text"), *nothing).collect() == []


def test_quality_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, None), (99, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)  # too few labels
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    left = quality_classifier.keep_good(docs, model)
    assert left.columns == docs.columns
    none = quality_classifier.train(empty, labels.limit(0))
    assert quality_classifier.score(empty, none).collect() == []
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_quality_rules(docs, empty):
    got = quality_rules.scored(docs).collect()
    assert len(got) == len(ROWS)
    want = sorted(brute.rule_stats(t) for _, t, _, _ in ROWS)
    assert sorted(tuple(r[k] for k in quality_rules.STATS[:5]) for r in got) == want
    assert all(r.base_failed for r in got if r.n_words < 50) and not any(r.kept and r.base_failed for r in got)
    assert quality_rules.scored(empty).collect() == []


def test_pii(docs, empty):
    got = pii.find(docs).select("doc_id", pii.joined(F.col("base")).alias("b"), F.size("spans").alias("n")).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[10].b == "card:4:23" and by[2].b == by[3].b == by[11].b == ""
    assert pii.find(empty).collect() == []


def test_token_rollup(spark, tmp_path):
    changes = lambda rows: spark.createDataFrame(rows, token_rollup.CHANGES)
    roll = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    assert roll.totals().collect() == []
    first = changes([(1, "insert", 1, "a", "en", "v1", 10), (2, "insert", 1, "a", None, "v1", None), (None, "insert", 1, None, None, None, 7),
                     (3, "insert", 1, "a", "en", "v1", 5), (3, "insert", 2, "a", "en", "v1", 6), (3, "insert", 2, "a", "en", "v1", 6)])
    assert roll.commit(1, first)
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert total() == {("a", "en", "v1"): (2, 16), ("a", None, "v1"): (1, 0), (None, None, None): (1, 7)}
    assert not roll.commit(1, first)
    second = changes([(1, "revise", 1, "a", "en", "v2", 12), (3, "delete", 1, None, None, None, None), (77, "delete", 1, None, None, None, None)])
    assert roll.commit(2, second) and not roll.commit(2, second)
    assert total() == {("a", "en", "v2"): (1, 12), ("a", None, "v1"): (1, 0), (None, None, None): (1, 7)}
    assert roll.commit(3, changes([]))
    assert roll.commit(4, changes([(3, "insert", 1, "b", "en", "v2", 1)]))
    assert total()[("b", "en", "v2")] == (1, 1) and roll.batches() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        token_rollup.TokenRollup(spark, str(tmp_path / "rollup")).commit(0, first)
