"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import corpus_pipeline as P
from histospark.llm import quality_classifier
from histospark.llm.common import stored, table
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, SF), "test-stage")
        rows = out.collect()
        if name == "quality_classifier":
            model = quality_classifier.train(docs, table(spark, SF, "labels"))
            assert {r.doc_id for r in rows} == {r.doc_id for r in quality_classifier.score(docs, model).collect() if r.kept}
            assert len(rows) < len(before)
        elif name == "exact_dedup":
            best = {}
            for d, t in before.items():
                best[t or ""] = max(d, best.get(t or "", d))
            assert sorted(r.doc_id for r in rows) == sorted(best.values())
        elif name == "ngram_jaccard_join":
            assert {r.doc_id for r in rows} == {c for _, c in brute.components(before, 5, 80).values()}
        elif name == "mix_sources":
            words = lambda t: len(brute.WORD.findall(t or ""))
            size, taken = {}, {}
            for r in docs.collect():
                size[r.source] = size.get(r.source, 0) + words(r.text)
            for r in rows:
                taken[r.source] = taken.get(r.source, 0) + words(r.text)
                assert before[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
            assert all(taken.get(s, 0) <= 2 * n for s, n in size.items())
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
        else:
            from tokenizers import Tokenizer

            from histospark.llm.bpe import default_file
            t = Tokenizer.from_file(default_file())
            want = sorted((r.doc_id, tuple(t.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
            assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == want
        if name != "bpe":
            assert out.columns == columns
            docs, before = out, {r.doc_id: r.text for r in rows}


def test_run_is_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is P.run
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_mix_follows_the_schedule(spark):
    """The written mix is in the order of the slots: every part of it holds its sources' shares."""
    from histospark.llm import mixing
    rows = [(i, "w " * 40, "abc"[min(i % 8, 2)], 80) for i in range(1200)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), "mix-order")
    out = mixing.mixed_documents(docs, block=40).collect()
    share = {s: sum(r.source == s for r in out) / len(out) for s in "abc"}
    for lo in range(0, len(out) - 300, 100):
        part = out[lo : lo + 300]
        assert all(abs(sum(r.source == s for r in part) / 300 - share[s]) < 0.05 for s in "abc")


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing columns; and an empty table."""
    from pyspark.sql import functions as F

    from tests.llm.test_edges import ROWS, SCHEMA
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for clash in ("size", "id", "h", "n", "target", "kept", "taken_1", "slot", "score"):
        docs = docs.withColumn(clash, F.lit("clash"))
    for name, df in (("odd", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = P.run(spark, f"{tmp_path}/odd").collect()
    assert P.run(spark, f"{tmp_path}/none").collect() == []
    assert all(r.n_tokens == len(r.ids) for r in got)
    # of equal texts the largest doc_id: 1 is left of 1 and null, 6 of 5 and 6, 9 of 8, 8 and 9
    assert {r.doc_id for r in got} <= {1, 6, 7, 9, 10, 11} and {1, 6, 9} & {r.doc_id for r in got}
