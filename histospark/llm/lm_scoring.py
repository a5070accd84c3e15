"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts a word from the CONTEXT words on both sides: their
embeddings, gated by position, are added and squashed; the word's probability
is a product of binary decisions down a fixed tree over the vocabulary
(hierarchical softmax), so it is normalised exactly. A document's score is the
sum of log P(word | both sides) over all its words.

Vocabulary: word counts over the whole corpus; the most frequent KNOWN words
have an id, all others share BUCKETS ids by hash, and the network tells the
probability of the bucket. A word of a bucket is then charged its share there,
count of the word / count of the bucket, from the counts of all words: the
DICTIONARY most frequent of them are looked up inside tasks, the others joined
by hash with a shuffle. Words that the corpus lacks count as one more word of
their bucket. Training: in each round every
task starts from the current network, masks one in ROUNDS positions of all its
documents and takes numpy gradient steps; the networks of all tasks are
averaged in Spark by blocks, weighted by their numbers of examples. Each
position of the corpus is a target in exactly one round. Texts are cut into
words twice, for the counts and for a table of word ids (two bytes a word, with
the shares of the words outside the vocabulary); the rounds and the scoring
read that table, without a shuffle of it.

Words are in lower case (A-Z). Null text and text without words has no words,
log probability 0 and null perplexity. Repeated rows get the same score; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm import arrays as A
from histospark.llm.common import ROW, share, stored, table

U = np.uint64
LEVELS = 12
BUCKETS = 64
KNOWN = (1 << LEVELS) - BUCKETS
CONTEXT, WIDTH = 2, 16
ROUNDS, BATCH, RATE = 2, 512, 0.1
#: Blocks in which networks are averaged, and tasks averaged at once.
BLOCKS, TASKS = 32, 64
SCORED = 1 << 12
UPPER = 7  # levels of the tree whose gradients are one matrix product
#: Words outside the vocabulary whose shares are looked up inside tasks; the rest takes a shuffle.
DICTIONARY = 1 << 20
PAD = 1 << LEVELS  # id of places outside the text

_OFFSETS = np.array([o for o in range(-CONTEXT, CONTEXT + 1) if o])
_DEPTH = np.arange(LEVELS)
_IDS = np.arange(1 << LEVELS)[:, None]
#: Inner nodes on the way to each id, and the branches taken.
_NODES = ((1 << _DEPTH) - 1 + (_IDS >> (LEVELS - _DEPTH))).astype(np.int32)
_BRANCHES = ((_IDS >> (LEVELS - 1 - _DEPTH)) & 1).astype(np.float32)
_SIGNS = 1 - 2 * _BRANCHES


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): hash and count of every word of the corpus, counted within
    batches of text first."""

    def run(batches):
        held, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for b in A.slices(batches):
            h, _, _ = A.words(b.column(0), lower=True)
            u, n = np.unique(h, return_counts=True)
            held, at = np.unique(np.concatenate((held, u)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), minlength=len(held)).astype(np.int64)
            if len(held) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["h", "n"])
                held, counts = held[:0], counts[:0]
        for lo in range(0, len(held), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(held[lo : lo + 100_000].view(np.int64)), pa.array(counts[lo : lo + 100_000])], names=["h", "n"])

    return docs.select("text").mapInArrow(A.task(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of words: by frequency for the known ones, by hash for the others."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.h = hashes[self.order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        other = (KNOWN + (h % U(BUCKETS))).astype(np.int64)
        if not len(self.h):
            return other
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.order[at], other)


class Shares:
    """log(count of the word / count of its bucket) of words in a dictionary."""

    def __init__(self, h: np.ndarray, n: np.ndarray, totals: np.ndarray):
        order = np.argsort(h)
        self.h, self.share = h[order], (np.log(n) - np.log(totals[(h % U(BUCKETS)).astype(np.int64)]))[order]
        self.absent = -np.log1p(totals)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each word, and whether the dictionary has it; words that it
        lacks have the share of one more word."""
        absent = self.absent[(h % U(BUCKETS)).astype(np.int64)]
        if not len(self.h):
            return absent, np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        return np.where(found, self.share[at], absent), found


def dictionary_of(rest: DataFrame, most: int) -> tuple[Shares, bool]:
    """The shares of up to ``most`` words of ``rest`` (h, n), by frequency, and
    whether these are all."""
    totals = np.zeros(BUCKETS)
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1))
    for r in rest.groupBy(bucket.alias("k")).agg(F.sum("n").alias("n")).collect():
        totals[r["k"]] = r["n"]
    by_count = rest.groupBy(F.least("n", F.lit(DICTIONARY)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = DICTIONARY + 1, 0
    for r in sorted(by_count, reverse=True):
        if held + r["words"] > most:
            break
        least, held = r["n"], held + r["words"]
    got = rest.where(F.col("n") >= least).select("h", "n").toArrow()
    shares = Shares(got["h"].to_numpy().view(U), got["n"].to_numpy(), totals)
    return shares, held == sum(r["words"] for r in by_count)


class Network:
    """Embeddings, gates, and a vector and bias per inner node of the tree."""

    SIZES = ((PAD + 1) * WIDTH, len(_OFFSETS) * WIDTH, PAD * WIDTH, PAD)

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            r = np.random.default_rng(5)
            flat = np.concatenate([r.normal(0, 0.1, self.SIZES[0]), np.ones(self.SIZES[1]), np.zeros(self.SIZES[2] + self.SIZES[3])])
        self.flat = flat.astype(np.float32)
        e, g, v, b = np.split(self.flat, np.cumsum(self.SIZES)[:-1])  # views
        self.e, self.g, self.v, self.b = e.reshape(-1, WIDTH), g.reshape(-1, WIDTH), v.reshape(-1, WIDTH), b

    def hidden(self, e: np.ndarray) -> np.ndarray:
        """Of the embeddings of the words around (rows x places x WIDTH)."""
        return np.tanh(np.einsum("nkw,kw->nw", e, self.g))

    def logits(self, nodes: np.ndarray, v: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of each row's nodes, ``v`` the vectors of those below the upper
        levels. The upper levels have few nodes: one matrix product."""
        top = (1 << UPPER) - 1
        upper = (h @ self.v[:top].T).ravel()[nodes[:, :UPPER] + np.arange(0, len(h) * top, top)[:, None]]
        return np.concatenate((upper, np.einsum("nlw,nw->nl", v, h)), 1) + self.b[nodes]

    def log_probability(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        nodes = _NODES.take(ids, axis=0)
        z = self.logits(nodes, self.v.take(nodes[:, UPPER:], axis=0), self.hidden(self.e.take(around, axis=0)))
        z *= _SIGNS.take(ids, axis=0)  # branch 1 has probability sigmoid(-z)
        # The product of LEVELS factors of at most 1 + e^50 is a number; beyond that log(1 + e^x) is x.
        far = np.maximum(-z - 50, 0).sum(1, dtype=np.float64)
        return -np.log((1 + np.exp(np.minimum(-z, 50))).prod(1, dtype=np.float64)) - far

    def step(self, around: np.ndarray, ids: np.ndarray, power: list[np.ndarray]) -> None:
        """One Adagrad step on a batch of examples."""
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # then the nodes of every level are in order, too
        around, ids = around.take(order, axis=0), ids.take(order)
        e, nodes = self.e.take(around, axis=0), _NODES.take(ids, axis=0)
        h, top, low = self.hidden(e), self.v[: (1 << UPPER) - 1], nodes[:, UPPER:]
        v = self.v.take(low, axis=0)
        z = self.logits(nodes, v, h)
        d = 1 / (1 + np.exp(np.minimum(-z, 80))) - (1 - _BRANCHES.take(ids, axis=0))
        upper, lower = np.zeros((len(ids), len(top)), np.float32), d[:, UPPER:]
        upper.ravel()[nodes[:, :UPPER] + np.arange(0, upper.size, len(top))[:, None]] = d[:, :UPPER]
        dh = ((upper @ top + np.einsum("nl,nlw->nw", lower, v)) * (1 - h * h)).astype(np.float32)
        self._move(2, slice(len(top)), upper.T @ h, power)
        self._move(3, slice(len(top)), upper.sum(0), power)
        at, lower = low.T.ravel(), np.ascontiguousarray(lower.T)  # level by level
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        at = at.take(first)
        self._move(2, at, np.add.reduceat((lower[:, :, None] * h).reshape(-1, WIDTH), first, axis=0), power)
        self._move(3, at, np.add.reduceat(lower.ravel(), first), power)
        gg = np.einsum("nw,nkw->kw", dh, e)
        at = around.ravel()
        order = np.argsort(at.astype(np.uint16), kind="stable")  # PAD has 13 bits
        at = at.take(order)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ge = (dh[:, None, :] * self.g).reshape(-1, WIDTH).take(order, axis=0)
        self._move(0, at.take(first), np.add.reduceat(ge, first, axis=0), power)
        self._move(1, slice(len(gg)), gg, power)

    def _move(self, k: int, at, g: np.ndarray, power: list[np.ndarray]) -> None:
        """Adagrad on the rows ``at`` of weights ``k``; rows without a gradient stay as they are."""
        w, p = (self.e, self.g, self.v, self.b)[k], power[k]
        p[at] = now = p[at] + g * g
        w[at] -= RATE * g / np.sqrt(now + np.float32(1e-6))


class Line:
    """The ids of some texts in one line, with PAD between them."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, n: int):
        self.place = np.arange(len(ids)) + CONTEXT * (doc + 1)
        self.line = np.full(len(ids) + CONTEXT * (n + 1), PAD, np.int32)
        self.line[self.place] = ids

    def around(self, at: np.ndarray) -> np.ndarray:
        """Ids of the words around the words ``at``, PAD outside the text."""
        return self.line[self.place[at][:, None] + _OFFSETS]


def _texts(batches):
    """(ids, index of the text, batch) of rows with ``ids``, 32,768 words or one row at a time."""
    for b in batches:
        for part in A.slices(iter([b]), "ids", 1 << 16):
            data, offsets = A.text_buffer(part.column(part.schema.get_field_index("ids")))
            ids = np.frombuffer(data.tobytes(), "<u2").astype(np.int64)
            yield ids, np.repeat(np.arange(part.num_rows), np.diff(offsets) // 2), part


def _round(rows: DataFrame, network: np.ndarray, number: int) -> np.ndarray:
    """The average of the networks that all tasks reach from ``network``."""
    shared = share(rows.sparkSession, network)
    size = -(-len(network) // BLOCKS)

    def run(batches):
        net, held, examples, tag = Network(shared.value.copy()), [], 0, 0
        power = [np.zeros_like(w, np.float32) for w in (net.e, net.g, net.v, net.b)]
        for ids, doc, part in _texts(batches):
            place = np.arange(len(ids)) - np.searchsorted(doc, doc)
            masked = np.flatnonzero(A.mix(ids.astype(U) * U(0x9E3779B97F4A7C15) ^ place.astype(U)) % U(ROUNDS) == U(number))
            tag ^= int(ids[:1].sum()) * 31 + len(ids)
            held.append((Line(ids, doc, part.num_rows).around(masked), ids[masked]))
            if sum(len(x) for _, x in held) >= BATCH:
                around, target = (np.concatenate(x) for x in zip(*held, strict=True))
                full = len(target) // BATCH * BATCH
                for lo in range(0, full, BATCH):
                    net.step(around[lo : lo + BATCH], target[lo : lo + BATCH], power)
                examples += full
                held = [(around[full:], target[full:])]
        if held and len(target := np.concatenate([x for _, x in held])):
            net.step(np.concatenate([x for x, _ in held]), target, power)
            examples += len(target)
        if examples:
            parts = [net.flat[i * size : (i + 1) * size] for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([tag % TASKS] * BLOCKS, pa.int32()), pa.array([examples] * BLOCKS, pa.int64()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "part", "n", "w"])

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        w = sum(np.frombuffer(x, np.float32) * k for x, k in zip(pdf["w"], n / n.sum(), strict=True))
        return pd.DataFrame({"block": pdf["block"][:1], "part": [0], "n": [int(n.sum())], "w": [w.astype(np.float32).tobytes()]})

    kind = "block int, part int, n long, w binary"
    parts = rows.select("ids").mapInArrow(A.task(run), kind).groupBy("block", "part").applyInPandas(average, kind)
    got = parts.groupBy("block").applyInPandas(average, kind).collect()  # BLOCKS rows
    if not got:
        return network
    return np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["block"])])


def learn_words(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and (h, n): all words outside it with their counts."""
    words = stored(word_counts(docs), "lm-words")
    top = words.orderBy(F.desc("n"), "h").limit(KNOWN).toPandas()
    rest = words.limit(0)
    if len(top) == KNOWN:
        n, h = (F.lit(int(top[c].iloc[-1])) for c in ("n", "h"))
        rest = words.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("h") > h)))
    return Vocabulary(top["h"].to_numpy(np.int64).view(U)), rest


def word_ids(docs: DataFrame, vocabulary: Vocabulary, rest: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """A stored row per row of ``docs``: doc_id, ids (two bytes a word), n_tokens
    and ``shares``, the sum of the shares of its words outside the vocabulary."""
    shares, whole = dictionary_of(rest, dictionary)
    shared = share(docs.sparkSession, (vocabulary, shares))

    def run(batches):
        words, shares = shared.value
        for b in A.slices(batches):
            h, doc, n = A.words(b.column(1), lower=True)
            ids = words.ids(h)
            out = np.flatnonzero(ids >= KNOWN)
            value, found = shares.find(h[out])
            found |= whole
            left = out[~found]
            cut = A.bounds(doc, n)
            packed = ids.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([packed[2 * x : 2 * y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array(np.diff(cut).astype(np.int64)), pa.array(np.bincount(doc[out[found]], value[found], minlength=n).astype(float)),
                 pa.ListArray.from_arrays(pa.array(A.bounds(doc[left], n), pa.int32()), pa.array(h[left].view(np.int64)))],
                names=["doc_id", "ids", "n_tokens", "shares", "left"])

    rows = docs.select("doc_id", "text").mapInArrow(A.task(run), "doc_id long, ids binary, n_tokens long, shares double, left array<long>")
    if whole:
        return stored(rows.drop("left"), "lm-ids")
    rows = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "lm-ids")
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    by_bucket = lambda x: F.array(*[F.lit(float(v)) for v in x])[bucket]
    words = rows.select(ROW, F.explode("left").alias("h")).join(rest, "h", "left")
    value = F.coalesce(F.log("n") + by_bucket(-np.log(np.maximum(np.expm1(-shares.absent), 1))), by_bucket(shares.absent))
    more = words.groupBy(ROW).agg(F.sum(value).alias("more"))
    rows = rows.join(more, ROW, "left").withColumn("shares", F.col("shares") + F.coalesce("more", F.lit(0.0)))
    return stored(rows.drop(ROW, "left", "more"), "lm-ids")


def fit(rows: DataFrame) -> Network:
    """The network trained on all positions of ``rows`` (ids)."""
    flat = Network().flat
    for number in range(ROUNDS):
        flat = _round(rows, flat, number)
    return Network(flat)


def train(docs: DataFrame) -> tuple[Vocabulary, Network, DataFrame]:
    """The vocabulary, the network, and (h, n): all words outside the
    vocabulary with their counts."""
    vocabulary, rest = learn_words(docs)
    return vocabulary, fit(word_ids(docs, vocabulary, rest)), rest


def score_ids(rows: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all words) and perplexity of rows of :func:`word_ids`."""
    shared = share(rows.sparkSession, network.flat)

    def run(batches):
        net = Network(shared.value)
        for ids, doc, part in _texts(batches):
            line, n = Line(ids, doc, part.num_rows), part.num_rows
            logs = [np.zeros(0)]
            for lo in range(0, len(ids), SCORED):
                at = np.arange(lo, min(lo + SCORED, len(ids)))
                logs.append(net.log_probability(line.around(at), ids[at]))
            total = np.bincount(doc, np.concatenate(logs), minlength=n) + part.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "log_prob"])

    out = rows.select("doc_id", "n_tokens", "ids", "shares").mapInArrow(A.task(run), "doc_id long, n_tokens long, log_prob double")
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens")))
    return out.withColumn("perplexity", perplexity)


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network, rest: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_tokens, log_prob and perplexity of each row of ``docs``."""
    return score_ids(word_ids(docs, vocabulary, rest, dictionary), network)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = word_ids(docs, *learn_words(docs))
    return score_ids(rows, fit(rows))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLE: dict[str, str] = {}
