"""Operators against brute force, round trips and held-out accuracy, and the
registered queries against DuckDB."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import (arrays, bpe, language_id, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, registry)
from histospark.llm.common import stored, with_row_id
from tests.conftest import SF_SMALL
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    import duckdb

    from tools.check_oracle import table_hash, type_diff
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df, sql = registry.queries()[name](spark, SF_SMALL), registry.oracle_sql()[name]
    assert type_diff(df, con, sql) == {}
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert table_hash(df.columns, [tuple(r) for r in df.collect()])[0] == table_hash(cols, res.fetchall())[0]


def test_words_and_hashes():
    import pyarrow as pa
    texts = ["Ab  cd\tAB", "", None, "é\x1cx é", " x"]
    h, doc, n = arrays.words(pa.array(texts), lower=True)
    assert n == 5 and doc.tolist() == [0, 0, 0, 3, 3, 4]
    assert h[0] == h[2] != h[1] and h[4] != h[3]
    assert len(set(arrays.words(pa.array([f"w{i} {i}w" for i in range(20000)]))[0].tolist())) == 40000
    sliced = pa.array(["zz", *texts, "qq"]).slice(1, 5)
    assert (arrays.words(sliced, lower=True)[0] == h).all()


def test_ngram_join_finds_every_link(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    docs = {}
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 40, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs[len(docs)] = " ".join(w)
    line = "one common line that stands in a great many of the documents"
    for i in range(60):
        docs[1000 + i] = line + " " + " ".join(rng.choice(vocab) for _ in range(30))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    for n, num in ((3, 90), (2, 60), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, n, num, 100).collect()}
        assert got == brute.components(docs, n, num)


def test_long_lists_in_blocks(spark):
    """Near copies share every list: blocks bound what a scan holds, all pairs of members still meet, and no link is lost."""
    rows = [(k, i) for k, m in ((1, 5), (2, 40), (3, 300)) for i in range(m)]
    cut = ngram_join.blocks_of(spark.createDataFrame(rows, "list long, id long"), 16)
    held = cut.withColumn("label", F.col("id"))
    for units, limit in ((ngram_join.single_blocks(cut), 32), (ngram_join.mixed_blocks(held), 64)):
        assert units.groupBy("list").count().agg(F.max("count")).first()[0] <= limit
    met = {}
    for r in ngram_join.mixed_blocks(held).collect():
        met.setdefault(r.list, set()).add(r.id)
    assert all(any({a, b} <= ids for ids in met.values()) for a in range(0, 300, 7) for b in range(a + 1, 300))
    assert ngram_join.mixed_blocks(held.withColumn("label", F.lit(0).cast("long"))).count() == 0
    rng = random.Random(4)
    vocab, docs = [f"w{i}" for i in range(300)], {}
    for size, copies, changes in ((60, 70, 2), (60, 40, 4), (200, 60, 4), (30, 50, 1)):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs[len(docs)] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, 3, 90, 100, block=8).collect()}
    assert got == brute.components(docs, 3, 90)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for size in (20, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: size * 9 // 10], rng.integers(0, 1 << 63, size // 8, dtype=np.uint64))))
        packed = []
        for s in (a, b):
            bits = 512 << int(ngram_join.sketch_class(np.array([len(s)]))[0])
            packed.append(np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(int), minlength=bits) & 1).astype(np.uint8)).tobytes())
        x, y = (0, 1) if len(a) <= len(b) else (1, 0)
        d = ngram_join.Sketches(packed).apart(np.array([x]), np.array([y]))[0]
        assert 0 < d <= len(np.setxor1d(a, b))


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_file())
    rng = random.Random(1)
    alphabet = [*"abXYZ'''stmdrevl 0129-.<|>\n\t", "é", "ß", "İ", "Σ", "ς", "中", "²", "́", "​", "\x1c", "\x85", "\U0001f388", "K", "<|endoftext|>", "'re"]
    rows = list(texts.items()) + [(10**6 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    enc = [t.encode(x or "", add_special_tokens=False).ids for _, x in rows]
    want = {d: (len(e), sha(np.array(e, "<u4").tobytes()), sha(t.decode(e, skip_special_tokens=False).encode())) for (d, _), e in zip(rows, enc, strict=True)}
    for dictionary in (bpe.DICTIONARY, 100):  # all words map-side, and most by a shuffle
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, digest=True, dictionary=dictionary).collect()}
        assert got == want
    some = df.where("doc_id >= 1000000 OR doc_id < 50")
    got = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(some).select("doc_id", "ids")).collect()}
    assert got == {d: t.decode(e, skip_special_tokens=False) for (d, _), e in zip(rows, enc, strict=True) if d in got} and len(got) == 450


def test_pii_equals_brute_force(spark, texts):
    hard = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "1234 5678-9012 3456 7890 12", "+1 (017) 555-7713 call (212) 555-1234 now",
            "IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 and 123-45-6780", "n 123-45-6789",
            "é@é.com \U0001f388 a@b.co 4111 1111 1111 1111", "256.1.1.1 001.02.3.255", "5" * 5000, "a.b." * 3000 + "@", "a@" + "b." * 3000 + "c",
            " 4012888888881881" * 300, "+" * 500 + "1", "@" * 500]
    rows = list(texts.items()) + [(10**6 + i, h) for i, h in enumerate(hard)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect()}
    for d, text in rows:
        assert got[d].base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii_base(text)), text[:80]
        assert set(got[d].base.split(",")) <= set(got[d].spans.split(",")) | {""}
    added = [got[10**6 + i].spans for i in range(len(hard))]
    assert added[4].endswith("tel:23:37") and added[5] == "iban:5:32" and added[6] == ""
    assert added[7] == "ssn:4:15,ssn:20:31" and added[8] == ""


def test_iban_before_other_capitals(spark):
    """The country tells where an IBAN ends; a token after it is not part of it."""
    cases = {"BE68 5390 0754 7034 BIC KREDBEBB": "iban:0:19", "ES91 2100 0418 4502 0005 1332 EUR 50": "iban:0:29", "BE68539007547034 EUR": "iban:0:16",
             "to BE68 5390 0754 7034, EUR": "iban:3:22", "NO93 8601 1117 947 NOK": "iban:0:18", "BE68 5390 0754 7035 BIC": "", "BE68 5390 0754 7034BIC": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).select("doc_id", pii.joined(F.col("spans")).alias("spans")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_pii_query_digests(spark, texts):
    got = {r.doc_id: r for r in registry.queries()["op5_pii"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, text in texts.items():
        assert got[d].base_sha256 == brute.pii_digest(text)
        base = brute.pii_base(text)
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]


def test_rules_separate_junk(spark, texts):
    got = {r.doc_id: r for r in registry.queries()["op10_quality_rules"](spark, SF).collect()}
    assert {d: tuple(r[k] for k in quality_rules.STATS[:5]) for d, r in got.items()} == {d: brute.rule_stats(t) for d, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[d], r.kept) for d, r in got.items() if d in labels and not r.base_failed]
    assert np.mean([k == bool(q) for q, k in judged]) > 0.97


def test_estimated_votes_beat_the_majority():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    accuracy = [0.95, 0.9, 0.6, 0.6, 0.6]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) * 2 for a in accuracy], 1)
    votes[rng.random(votes.shape) < 0.2] = 1
    code = votes @ 3 ** np.arange(4, -1, -1)
    seen, counts = np.unique(code, return_counts=True)
    good = quality_rules.estimate(seen, counts.astype(float), 5)[np.searchsorted(seen, code)] >= 0.5
    majority = (votes == 2).sum(1) >= (votes == 0).sum(1)
    assert (good == truth).mean() > (majority == truth).mean() + 0.01


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = registry.queries()["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_forward_sums_all_segmentations():
    pieces = language_id.letter_pieces()[::3]
    table_, place = language_id.Pieces(pieces), {p: i for i, p in enumerate(pieces)}
    p = np.vstack([np.random.default_rng(0).random((table_.n, 2)) * 1e-3, np.zeros((1, 2))])

    def slow(s):
        if not s:
            return np.ones(2)
        first = lambda l: p[place[s[:l]]] if s[:l] in place else np.full(2, language_id.UNKNOWN if l == 1 else 0.0)
        return sum(first(l) * slow(s[l:]) for l in range(1, len(s) + 1))

    longest = max((x[1:] for x in pieces if x[0] == chr(language_id.MARK)), key=len)
    for w in ("action", "zz", "ableö", "a", longest):
        marked = chr(language_id.MARK) + w
        found = table_.find(np.array([[ord(c) for c in marked]], np.uint32))
        assert np.allclose(language_id.forward(found, p)[0, -1], slow(marked), rtol=1e-9)
        codes = np.array([ord(c) for c in marked], np.uint32)
        assert np.allclose(language_id.long_forward(table_.ending(codes, p), table_.longest, 2), np.log(slow(marked)), rtol=1e-9)


def test_long_words_are_whole(monkeypatch):
    pieces = language_id.letter_pieces()
    table_ = language_id.Pieces(pieces)
    assert table_.n == len(pieces) and table_.longest == max(map(len, pieces)) > 12
    p = np.vstack([np.random.default_rng(1).random((table_.n, 2)) * 1e-3, np.zeros((1, 2))])
    word = "international" * 3 + "ö"  # as long as both ways reach
    codes = np.array([language_id.MARK, *map(ord, word)], np.uint32)
    whole = np.log(language_id.forward(table_.find(codes[None]), p)[0, -1])
    monkeypatch.setattr(language_id, "PLACES", 7)  # places of different parts share pieces
    assert np.allclose(language_id.long_forward(table_.ending(codes, p), table_.longest, 2), whole, rtol=1e-12)
    short = language_id._expected(table_.find(codes[None]), p[:, :1], np.array([3.0]))
    assert np.allclose(language_id._expected_long(table_, codes, p[:, :1], 3.0), short, rtol=1e-9, atol=1e-12)
    # A run of 100,000 letters decides by all of them, not by its beginning.
    rows = [("a" * 100 + "b" * 200, 1), ("b" * 300, 0)]
    model = language_id.Model(["x", "y"], language_id.Pieces(["a", "b"]), np.array([[0.9, 0.1], [0.1, 0.9], [0.0, 0.0]]))
    assert model.texts(["a" * 40_000 + "b" * 60_000, "a" * 60_000 + "b" * 40_000, *(r for r, _ in rows)])[0] == ["y", "x", "y", "y"]
    assert model.texts(["ab"])[0] == ["x"]  # a tie goes to the first


def test_estimation_over_tasks(spark):
    rows = [("en", "the", 50), ("en", "then", 7), ("en", "q" * 60, 1), ("fr", "les", 40), ("fr", "lesquels", 3)]
    counts = spark.createDataFrame(rows, "lang string, word string, n long")
    pieces = language_id.letter_pieces()
    got = language_id.fit(counts.repartition(4), pieces)
    table_ = got.pieces
    for j, lang in enumerate(got.languages):
        q = np.vstack([np.full((table_.n, 1), 1 / table_.n), [[0.0]]])
        words = [(w, n) for x, w, n in rows if x == lang]
        for _ in range(language_id.ITERATIONS):
            e = language_id.expected_counts(table_, [w for w, _ in words], np.array([float(n) for _, n in words]), q)[:-1]
            q[:-1, 0] = (e + language_id.SMOOTH) / (e.sum() + language_id.SMOOTH * table_.n)
        assert np.allclose(got.p[:, j], q[:, 0], rtol=1e-5)


def test_network_is_normalised_and_learns(spark):
    net = lm_scoring.Network()
    net.v[:] = np.random.default_rng(1).normal(0, 0.3, net.v.shape)
    every = net.log_probability(np.repeat([[1, 2, 3, 4]], 1 << lm_scoring.LEVELS, 0), np.arange(1 << lm_scoring.LEVELS))
    assert abs(np.exp(every).sum() - 1) < 1e-5
    rng, line = random.Random(0), "the cat sat on a mat while dogs ran far away home".split()
    start = lambda: rng.randrange(12)
    rows = [(i, " ".join((line * 8)[(k := start()) : k + 60])) for i in range(2000)]
    rows += [(10000 + i, " ".join(rng.sample(line * 6, 60))) for i in range(40)]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "lm-test")
    got = {r.doc_id: r for r in lm_scoring.score(df, *lm_scoring.train(df)).collect()}
    known, mixed = (np.mean([got[i].perplexity for i in ids]) for ids in (range(100), range(10000, 10040)))
    assert known < 6 < mixed
    assert all(abs(np.exp(-r.log_prob / r.n_tokens) - r.perplexity) < 1e-6 for r in got.values())


def test_rare_words_are_charged_their_share(spark):
    """Every word outside the vocabulary costs log(its count / its bucket's), looked up or joined."""
    import pyarrow as pa
    rng = random.Random(7)
    rows = [(i, " ".join(f"c{k}" for k in range(i % 8 * 504, i % 8 * 504 + 504))) for i in range(40)]  # 4,032 words, 5 times each
    rows += [(100 + i, " ".join(f"r{rng.randrange(900)}" for _ in range(rng.choice([1, 40])))) for i in range(60)]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "lm-rare")
    other = spark.createDataFrame([(500, "never_seen c1 c2"), (501, None)], "doc_id long, text string")
    vocabulary, net, rest = lm_scoring.train(df)
    assert rest.count() + len(vocabulary.h) == len({w for _, x in rows for w in x.split()})
    hashes = {d: arrays.words(pa.array([x]))[0] for d, x in rows}
    every, counts = np.unique(np.concatenate(list(hashes.values())), return_counts=True)
    counts = dict(zip(every.tolist(), counts.tolist(), strict=True))
    totals = np.zeros(lm_scoring.BUCKETS)
    for h, n in counts.items():
        if h not in vocabulary.h:
            totals[h % lm_scoring.BUCKETS] += n
    want = {}
    for d, h in hashes.items():
        ids = vocabulary.ids(h)
        around = lm_scoring.Line(ids, np.zeros(len(ids), int), 1).around(np.arange(len(ids)))
        want[d] = net.log_probability(around, ids).sum() + sum(np.log(counts[x] / totals[x % lm_scoring.BUCKETS]) for x, i in zip(h.tolist(), ids, strict=True) if i >= lm_scoring.KNOWN)
    plain = {}
    for dictionary in (lm_scoring.DICTIONARY, 50, 0):
        got = {r.doc_id: r for r in lm_scoring.score(df.union(other), vocabulary, net, rest, dictionary).collect()}
        assert len(got) == len(rows) + 2 and got[501].perplexity is None
        assert all(abs(got[d].log_prob - x) < 1e-3 for d, x in want.items())
        plain[dictionary] = got[500].log_prob
    assert max(plain.values()) - min(plain.values()) < 1e-6


def test_every_position_is_a_target(spark):
    """All words of a template that repeats are trained on: the last node on the way to each has moved."""
    line = " ".join(f"t{i}" for i in range(1000))
    df = stored(spark.createDataFrame([(i, line) for i in range(6)], "doc_id long, text string").repartition(2), "lm-template")
    vocabulary, net, _ = lm_scoring.train(df)
    assert len(vocabulary.h) == 1000
    assert (np.abs(net.v[lm_scoring._NODES[:1000, -1]]).sum(1) > 0).all()


def test_classifier_held_out(spark):
    """Half of the labels for fitting, the other half to judge."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_classifier.train(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    rest = labels.where("crc32(cast(doc_id as string)) % 2 = 1")
    rows = quality_classifier.score(docs.join(rest.select("doc_id"), "doc_id"), model).join(rest, "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in rows]
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(rows) > 1500 and np.mean(right) > 0.95 and np.mean(clean) > 0.97


def test_pii_many_spans_in_one_text(spark):
    """100,000 spans: no step looks at every pair of spans, or counts a text's characters for each."""
    import time
    text = " ".join(f"a{i}@ex.org SSN 212-45-{1000 + i % 9000} é" for i in range(50_000))  # 1.6 million characters
    df = spark.createDataFrame([(1, text), (2, "call tel 212 555 1234 or x@y.zz")], "doc_id long, text string")
    t = time.time()
    got = {r.doc_id: r for r in pii.find(df).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("s"), F.element_at("spans", -1).alias("last")).collect()}
    assert time.time() - t < 60
    assert (got[1].b, got[1].s) == (50_000, 100_000) and (got[2].b, got[2].s) == (1, 2)
    assert text[got[1]["last"].start : got[1]["last"].end] == f"212-45-{1000 + 49_999 % 9000}"


def test_pii_added_spans_beside_base_spans(spark):
    """An added span stays only where no base span overlaps it, whatever stands before or after."""
    from pyspark.sql import Row
    rng = random.Random(2)
    span = lambda no: (lambda a: Row(start=a, no=no, end=a + rng.randrange(1, 12), score=1.0, match="x"))(rng.randrange(3000))
    for n in (0, 1, 5, 700):
        base, added = [span(0) for _ in range(n)], [span(5) for _ in range(n)]
        df = spark.createDataFrame([(base, added)], f"base {pii.SPAN}, added {pii.SPAN}")
        got = {(r.start, r.end) for r in pii.free_spans(df).first()["free"]}
        assert got == {(a.start, a.end) for a in added if not any(b.start < a.end and a.start < b.end for b in base)}


def test_pairs_still_meet_without_the_longest_lists(spark):
    """Sets leave their longest lists; every pair that shares more keys than that meets."""
    rnd, rule = random.Random(9), ngram_join.Rule(90, 100)
    size = {i: rnd.choice((30, 80, 130)) for i in range(60)}
    lists = {k: (sorted(rnd.sample(range(60), rnd.randrange(7, 40))), rnd.choice((1, 1, 2))) for k in range(30)}
    found = spark.createDataFrame([(1, k, bytearray(np.array(ids, np.int64).tobytes()), c) for k, (ids, c) in lists.items()], "kind int, key long, x binary, c long")
    got = {(r["list"], r["id"]) for r in ngram_join.long_lists(found, spark.createDataFrame(list(size.items()), "id long, size long"), rule).collect()}
    few = {i: max(2, -(-90 * n // 100) // 25) for i, n in size.items()}
    every = {(k, i) for k, (ids, _) in lists.items() for i in ids}
    assert got < every and all(any((k, i) not in got for k, _ in every) for i in size)
    for a in size:
        for b in range(a):
            both = [k for k, (ids, _) in lists.items() if a in ids and b in ids]
            if sum(lists[k][1] for k in both) > max(few[a], few[b]):
                assert any((k, a) in got and (k, b) in got for k in both)


def test_copies_of_the_texts_are_packed(spark):
    rows = with_row_id(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert rows.count() == 1 and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())


def test_sets_post_their_rare_shingles_first(spark):
    """Shingles that a dozen sets have, none of them very frequent, make no long
    lists where every set has rare ones; links between sets are still found."""
    rnd = random.Random(3)
    common = [" ".join(f"c{i}w{j}" for j in range(3)) for i in range(150)]
    texts = []
    for i in range(120):
        own = [f"d{i}x{j}" for j in range(90)]
        texts.append(" ".join(own[:45] + rnd.sample(common, 15) + own[45:]))
    texts.append(texts[7].replace("d7x0 ", "other "))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(6).cache()
    seen = ngram_join.profile(df, 3, rule := ngram_join.Rule(90, 100)).cache()
    totals = {r["kind"]: r for r in seen.groupBy("kind").agg(F.sum("size").alias("s"), F.count("x").alias("c")).collect()}
    marks, n_bits, often, mean = ngram_join.repeated(seen, totals[2]["c"], totals[2]["s"])
    assert mean >= 1 and len(often.value) >= 100
    posted = ngram_join.postings(df, 3, rule, marks, n_bits, often, ngram_join.share(spark, {}), 9, 8)
    assert ngram_join.inverted_lists(posted, 8).where("kind > 0").count() == 0
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df.withColumnRenamed("id", "doc_id"), 3, 90, 100).collect()}
    assert got == {i: i for i in range(120)} | {120: 7}


def test_global_order_of_shingles():
    """The same shingles stand in the same order in every set: unmarked, marked, frequent."""
    s = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 400, np.uint64))
    marked, often = s[::4], s[::20]
    marks = np.zeros(1 << 6, np.uint64)
    for x in marked:
        at = int(x) & 4095
        marks[at >> 6] |= np.uint64(1 << (at & 63))
    order = {x: i for i, x in enumerate(ngram_join.in_order(s, marks, 1 << 12, often).tolist())}
    assert sorted(order) == s.tolist()
    assert min(order[x] for x in often.tolist()) == len(s) - len(often)
    assert all(order[x] >= len(s) - 2 * len(marked) for x in marked.tolist())
    part = ngram_join.in_order(s[::3], marks, 1 << 12, often).tolist()
    assert part == sorted(part, key=order.get)
