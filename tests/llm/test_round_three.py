"""SimHash index, token alignment and target resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from histospark.llm import simhash_index, target_resampling, token_alignment
from histospark.llm.common import ROW, stored
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_edges import LONG, ROWS, docs, empty  # noqa: F401

TRICKY = [(100, "a\nb\r\n\n\n  <|endoftext|> </s><s> x"), (101, "naïve 日本語 \U0001f600\U0001f600 ́e"), (102, "▁under ▁ score"), (103, "<0x41> <unk>"),
          (104, "\x00 nul \x7f"), (105, " " * 30_000 + "end"), (106, "9" * 5000), (107, "\n" * 20_001), (108, "ＡＢＣ ﬁ Å"), (109, "word"), (110, " ")]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_fingerprint(text, n):
    w = brute.WORD.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes, distance):
    """{code: smallest code reachable}, by all pairs."""
    top = {c: c for c in codes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    every = sorted(codes)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {c: find(c) for c in every}


def check_simhash(got, pairs, n):
    codes = {d: plain_fingerprint(t, n) for d, t in pairs}
    top = plain_components(set(codes.values()), 2)
    first = {}
    for d, c in codes.items():
        first[top[c]] = min(d, first.get(top[c], d))
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == codes
    assert all(len(r.fingerprint) == 16 for r in got)
    assert {r.doc_id: r.component_id for r in got} == {d: first[top[c]] for d, c in codes.items()}


def test_simhash_query(spark, texts):
    check_simhash(simhash_index.op11_simhash(spark, SF_SMALL).collect(), texts.items(), 3)


def test_simhash_edges(spark, docs, empty):  # noqa: F811
    got = simhash_index.near_duplicates(docs, 3).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    assert by[0] == {2}  # null, empty and blank texts, a null doc_id among them
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id[6] == 5 and by_id[9] == 8 and by_id[1] == 1
    assert simhash_index.near_duplicates(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in simhash_index.near_duplicates(nulls).collect()] == [None, None]


def test_shingle_hashes_in_pieces(monkeypatch):
    text = " ".join(f"W{i}é" for i in range(300)) + " \t\n"
    whole = {n: [int(x) for p in simhash_index.shingle_hashes(text.encode(), n) for x in p] for n in (1, 3, 301)}
    monkeypatch.setattr(simhash_index, "PIECE", 7)
    for n, want in whole.items():
        assert [int(x) for p in simhash_index.shingle_hashes(text.encode(), n) for x in p] == want
    assert len(whole[1]) == 300 and len(whole[3]) == 298 and len(whole[301]) == 1


def neighbours(rng, n_centres, size, flips):
    codes = set()
    for _ in range(n_centres):
        c = rng.getrandbits(64)
        codes.add(c)
        for _ in range(rng.randrange(size)):
            x = c
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
            c = x if rng.random() < 0.3 else c  # chains
    return codes


@pytest.mark.parametrize("distance,node,node_max", [(2, 4096, 1 << 16), (2, 8, 16), (2, 1, 4), (1, 20, 30), (3, 16, 40), (0, 4, 4)])
def test_near_links_lose_none(spark, distance, node, node_max):
    rng = random.Random(distance * 100 + node)
    codes = neighbours(rng, 60, 25, 3) | {0, 1, 3, (1 << 64) - 1, 1 << 63}
    codes |= {rng.getrandbits(16) for _ in range(150)}  # a hot node: 48 bits the same
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash_index.near_links(stored(spark.createDataFrame([(c,) for c in signed], "code long"), "test-codes"), distance, node, node_max).collect()
    top = {c: c for c in codes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for e in edges:
        u, v = e.u % (1 << 64), e.v % (1 << 64)
        x, y = find(u), find(v)
        top[max(x, y)] = min(x, y)
    assert {c: find(c) for c in codes} == plain_components(codes, distance)


def test_index_prunes_groups():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    index = simhash_index.Index(codes)
    near = codes[:400] ^ np.uint64(5)
    every = np.unique(np.concatenate((codes, near)))
    i, j = simhash_index.Index(every).links(0, len(every), 2)
    slow = {(int(a), int(b)) for k, a in enumerate(every) for b in every[k + 1 :][np.bitwise_count(every[k + 1 :] ^ a) <= 2]}
    got = simhash_index.Index(every).codes
    assert {tuple(sorted((int(got[a]), int(got[b])))) for a, b in zip(i, j, strict=True)} == slow and len(slow) >= 400
    # own masks of a path never overlap: a difference is added once
    masks = [m for m, _ in index.levels]
    for k in range(1, len(masks)):
        assert not (masks[k] & masks[k - 1][np.arange(len(masks[k])) // simhash_index.FAN]).any()


# token alignment


def plain_alignment(pairs):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte, text_of = token_alignment.byte_level(), {i: t for t, i in a.get_vocab().items()}
    out, counts = [], Counter()
    for d, t in pairs:
        x, y = [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xb = [bytes(byte[c] for c in text_of[i]) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) != (" " + t).encode() or b"".join(yb) != (" " + t).encode():
                x, y = [], []
        if not x:
            out.append((d, 0, 0, [], []))
            continue
        xe, ye = np.cumsum([len(p) for p in xb]).tolist(), np.cumsum([len(p) for p in yb]).tolist()
        ends = sorted(set(xe) & set(ye))
        groups, links, i, j = [], [], 0, 0
        for e in ends:
            p, q = xe.index(e, i), ye.index(e, j)
            groups.append(",".join(map(str, x[i : p + 1])) + "|" + ",".join(map(str, y[j : q + 1])))
            links.append((x[p], y[q]))
            i, j = p + 1, q + 1
        counts.update(links)
        out.append((d, len(x), len(y), groups, links))
    most = {}
    for (p, q), n in counts.items():
        most[q] = max(n, most.get(q, 0))
    return sorted(((d, na, nb, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, k in out), key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark, texts):
    got = token_alignment.op12_token_alignment(spark, SF_SMALL)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_alignment(texts.items())


@pytest.mark.parametrize("pairs", [1 << 20, 60, 0])
def test_alignment_edges(spark, docs, pairs):  # noqa: F811
    rows = [(d, t) for d, t, _, _ in ROWS] + TRICKY
    df = docs.select("doc_id", "text", "bucket").unionByName(spark.createDataFrame([(*r, "x") for r in TRICKY], "doc_id long, text string, bucket string"))
    got = token_alignment.alignment(df, pairs=pairs).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_alignment(rows)
    zeros = {r.doc_id for r in got if r.n_a == 0}
    assert {2, 3} <= zeros and 100 not in zeros


def test_alignment_of_nothing(empty):  # noqa: F811
    assert token_alignment.alignment(empty).collect() == []
    assert token_alignment.overlapping_tokens(empty).collect() == []


def test_alignment_overlaps(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None), (3, "été fini")], "doc_id long, text string")
    got = token_alignment.overlapping_tokens(df).collect()
    for d in (1, 3):
        own = [r for r in got if r.doc_id == d]
        a, b = {(r.a_start, r.a_end) for r in own}, {(r.b_start, r.b_end) for r in own}
        assert {((r.a_start, r.a_end), (r.b_start, r.b_end)) for r in own} == {(x, y) for x in a for y in b if x[0] < y[1] and y[0] < x[1]}
        assert min(r.group for r in own) == 0 and all(r.end_together == (r.a_end == r.b_end) for r in own)
        assert max(r.group for r in own) + 1 == sum(r.end_together for r in own)
    assert {r.doc_id for r in got} == {1, 3}


def test_coalesce_breaks_at_running_maximum():
    start, end = np.array([0, 2, 5, 9, 9, 12]), np.array([4, 3, 9, 12, 10, 13])
    assert token_alignment.coalesce(start, end).tolist() == [0, 0, 1, 2, 2, 3]
    assert token_alignment.coalesce(start[:0], end[:0]).tolist() == []


# target resampling


def plain_resampling(pairs, target, n=2, min_words=20):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    per = [(d, *feats(t)) for d, t in pairs]
    s, t = Counter(), Counter()
    for _, f, _ in per:
        s.update(f)
    for x in target:
        t.update(feats(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for d, f, w in per:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), w))
    may = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(may[: len(may) * 25 // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_resampling_query(spark, texts):
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = target_resampling.op13_target_resampling(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    want = plain_resampling(texts.items(), target)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 20


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_edges(spark, docs, empty, n):  # noqa: F811
    extra = [(200 + i, f"Épée ÀB w{i} " * (5 + i % 9)) for i in range(60)] + [(None, "many words " * 15), (300, "7 7\x007 tab\tx" * 20)]
    df = docs.select("doc_id", "text", "word").unionByName(spark.createDataFrame([(*r, "x") for r in extra], "doc_id long, text string, word string"))
    target = spark.createDataFrame([("épée àb w3 w4",), (None,), ("",)], "text string")
    rows = [(d, t) for d, t, _, _ in ROWS] + extra
    got = target_resampling.resample(df, target, n=n).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_resampling(rows, ["épée àb w3 w4", None, ""], n)
    nothing = target_resampling.resample(df, empty, n=n).collect()
    assert sorted((tuple(r) for r in nothing), key=str) == plain_resampling(rows, [], n)
    assert target_resampling.resample(empty, target, n=n).collect() == []


def test_draw_ties_go_to_smaller_ids(spark):
    rows = stored(spark.createDataFrame([(i, 5 - i // 40, i % 10 != 0) for i in range(200)], "doc_id long, score long, ok boolean"), "test-draw")
    got = target_resampling.draw(rows, F.col("ok"), 1, 3).collect()
    may = sorted((r for r in got if r.ok), key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in may] == [*range(1, 61), *[None] * 120]
    assert all(r["rank"] is None for r in got if not r.ok) and len(got) == 200 and ROW not in rows.columns and LONG
