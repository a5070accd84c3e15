"""Language identification by segmentation-marginalised unigrams.

Every language has a unigram model over the pieces of a fixed public
vocabulary. The probability of a word is the sum over all its segmentations
into pieces, by the forward algorithm; a text's score is the sum over its
words. Piece probabilities are estimated by expectation-maximisation
(forward-backward) on the counts of all words of a bounded sample of labelled
documents, about TRAIN_DOCS per language, taken by a hash of doc_id, with no
run of more than TRAIN_RUN letters: tasks send the expected counts of their
words, Spark adds them up by language and piece. Prediction reads whole texts
and scores each distinct word once per worker, vectorised over words; words of
more than SHORT letters are scored alone, letter by letter with rescaled sums,
in memory that doesn't depend on their length.

Words are whole runs of letters in lower case, and all pieces of the vocabulary
that consist of letters take part. Characters outside it have a
small fixed probability in every language. Null text and text without letters
is "und" with score 0. Without labelled documents everything is "und". Equal
scores go to the first language by code point. Repeated rows are predicted
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm import arrays as A
from histospark.llm.bpe import _classes
from histospark.llm.common import share, stored, table

U = np.uint64
#: The labelled sample: documents per language, and their longest run of letters.
TRAIN_DOCS, TRAIN_RUN = 2_000, 1 << 16
#: Letters of words that are scored many at a time; UNKNOWN ** SHORT is a normal number.
SHORT = 40
ITERATIONS, SMOOTH, UNKNOWN = 4, 0.05, 1e-7
#: Bytes of word scores that a worker keeps, and places of a long word at once.
KEPT_BYTES, PLACES = 64 << 20, 1 << 11
MARK = 0x2581  # begins a word, as in the vocabulary

_KEPT: dict = {}


def default_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def letter_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces that consist of lower-case letters, with or
    without the mark that begins a word."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_file())
    out = set()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        core = p.removeprefix(chr(MARK))
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (core.isalpha() or p == chr(MARK)) and p == p.lower():
            out.add(p)
    return sorted(out)


def _terms(codes: np.ndarray, place: int) -> np.ndarray:
    return (codes.astype(U) + U(1)) * A._places(64)[place]


def _named(sums: np.ndarray, n: int) -> np.ndarray:
    return A.mix(sums + U(n * 0xD6E8FEB86659FD93 % (1 << 64)))


def split_words(texts: list[str | None]):
    """(code points, start, length, index of the text) of all words."""
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    letter = _classes()[codes] == 1
    start, length, _ = A.runs(codes, np.array([0, len(codes)]), letter)
    return codes, start, length, np.searchsorted(ends, start)


def word_hashes(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    terms = (codes[place + np.repeat(start, length)].astype(U) + U(1)) * A._places(int(length.max()))[place]
    return _named(np.add.reduceat(terms, first), 0) ^ length.astype(U)


class Pieces:
    """Sorted hashes of the pieces; finds all pieces in words of one length."""

    def __init__(self, pieces: list[str]):
        h = np.array([_named(sum((_terms(np.array([ord(c)]), i) for i, c in enumerate(p)), np.zeros(1, U)), len(p))[0] for p in pieces], U)
        self.order = np.argsort(h)
        self.h = h[self.order]
        self.order = np.append(self.order, len(pieces)).astype(np.int32)
        self.n, self.longest = len(pieces), max(map(len, pieces))

    def find(self, words: np.ndarray) -> list[np.ndarray]:
        """For ``words`` (m x n code points, the mark first): for each piece
        length l the m x (n - l + 1) ids of the pieces there, n for none."""
        out, sums = [], None
        for l in range(1, min(self.longest, words.shape[1]) + 1):
            t = _terms(words[:, l - 1 :], l - 1)
            sums = t if sums is None else sums[:, : t.shape[1]] + t
            h = _named(sums, l)
            at = np.minimum(np.searchsorted(self.h, h), self.n - 1)
            out.append(self.order[np.where(self.h[at] == h, at, self.n)])
        return out

    def ending(self, word: np.ndarray, p: np.ndarray):
        """For a long word (code points, the mark first), some places at a time:
        places x lengths x languages, the probability of the piece of each
        length that ends there; 0 for none, UNKNOWN for an unknown character."""
        for lo in range(0, len(word), PLACES):
            hi, back = min(len(word), lo + PLACES), min(lo, self.longest - 1)
            q = np.zeros((hi - lo, self.longest, p.shape[1]))
            for l, ids in enumerate(self.find(word[None, lo - back : hi]), 1):
                first = max(0, l - 1 - back)  # the first place where a piece of l characters can end
                ids = ids[0, first + back - l + 1 :]
                q[first:, l - 1] = p[ids]
                if l == 1:
                    q[ids == self.n, 0] = UNKNOWN
            yield q


def forward(found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sums over segmentations of word beginnings: m x (n + 1) x languages.
    ``p``: pieces + 1 rows (the last for none) by languages."""
    m, n = found[0].shape
    alpha = np.zeros((m, n + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for l in range(1, min(len(found), j) + 1):
            ids = found[l - 1][:, j - l]
            if l == 1:
                alpha[:, j] += alpha[:, j - 1] * np.where((ids < len(p) - 1)[:, None], p[ids], UNKNOWN)
            else:
                alpha[:, j] += alpha[:, j - l] * p[ids]
    return alpha


def long_forward(parts, longest: int, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Log of the sum over all segmentations of a long word by language, from
    the probabilities of the pieces that end at each place. ``sums`` (places + 1
    x languages) takes the logs of the sums up to every place."""
    last, scale, n = np.zeros((longest, k)), np.zeros(k), 0  # sums of the last places, newest first, times exp(scale)
    last[0] = 1
    for q in parts:
        for row in q:
            now = np.einsum("lk,lk->k", row, last)
            last[1:] = last[:-1]
            last[0] = now
            n += 1
            if now.min() < 1e-100:
                last /= now
                scale += np.log(now)
            if sums is not None:
                sums[n] = np.log(last[0]) + scale
    return np.log(last[0]) + scale


def _expected_long(table_: Pieces, word: np.ndarray, p: np.ndarray, count: float) -> np.ndarray:
    """As :func:`_expected` for one long word."""
    q = np.concatenate(list(table_.ending(word, p)))[:, :, 0]  # TRAIN_RUN places at most
    n, longest = q.shape
    alpha, beta = np.zeros((n + 1, 1)), np.zeros((n + 1, 1))
    long_forward([q[:, :, None]], longest, 1, alpha)
    back = np.zeros((n, longest, 1))  # by beginning, from the end
    for l in range(1, min(longest, n) + 1):
        back[l - 1 :, l - 1, 0] = q[l - 1 :, l - 1][::-1]
    long_forward([back], longest, 1, beta)
    beta, out = beta[::-1, 0], np.zeros(len(p))
    for l, ids in enumerate(table_.find(word[None]), 1):
        e = np.exp(alpha[: n - l + 1, 0] + beta[l:] - alpha[n, 0]) * q[l - 1 :, l - 1] * count
        out += np.bincount(ids[0], e * (ids[0] < table_.n), minlength=len(p))
    return out


def _expected(found: list[np.ndarray], p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations, one language."""
    m, n = found[0].shape
    alpha = forward(found, p)[:, :, 0]
    beta = np.zeros((m, n + 1))
    beta[:, n] = 1
    out = np.zeros(len(p))
    total = np.maximum(alpha[:, n], 1e-300)
    for j in range(n, 0, -1):
        for l in range(1, min(len(found), j) + 1):
            ids = found[l - 1][:, j - l]
            known = ids < len(p) - 1
            q = np.where(known, p[ids, 0], UNKNOWN if l == 1 else 0.0)
            out += np.bincount(ids, alpha[:, j - l] * q * beta[:, j] / total * count * known, minlength=len(p))
            beta[:, j - l] += q * beta[:, j]
    return out


def _by_length(codes: np.ndarray, start: np.ndarray, length: np.ndarray):
    """(indexes of the words, m x (n + 1) code points with the mark) per length."""
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        for part in np.array_split(at, -(-len(at) * (int(n) + 1) // 200_000)):
            yield part, np.column_stack([np.full(len(part), MARK, np.uint32), codes[start[part][:, None] + np.arange(n)]])


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.key, self.languages, self.pieces, self.p = uuid.uuid4().hex, languages, pieces, p

    def words(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        k = len(self.languages)
        out = np.zeros((len(start), k))
        short = np.flatnonzero(length <= SHORT)
        for at, words in _by_length(codes, start[short], length[short]):
            out[short[at]] = np.log(forward(self.pieces.find(words), self.p)[:, -1])
        for i in np.flatnonzero(length > SHORT):
            word = np.concatenate(([np.uint32(MARK)], codes[start[i] : start[i] + length[i]]))
            out[i] = long_forward(self.pieces.ending(word, self.p), self.pieces.longest, k)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        codes, start, length, doc = split_words(texts)
        n, k = len(texts), len(self.languages)
        if not k or not len(start):
            return ["und"] * n, np.zeros(n)
        h = word_hashes(codes, start, length)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        held_h, held = _KEPT.get(self.key) or (np.zeros(0, U), np.zeros((0, k)))
        at = np.minimum(np.searchsorted(held_h, u), max(len(held_h) - 1, 0))
        known = held_h[at] == u if len(held_h) else np.zeros(len(u), bool)
        logs = np.empty((len(u), k))
        logs[known] = held[at[known]]
        new = np.flatnonzero(~known)
        logs[new] = self.words(codes, start[first[new]], length[first[new]])
        if (len(held_h) + len(new)) * k * 8 > KEPT_BYTES:
            held_h, held = held_h[:0], held[:0]
        place = np.searchsorted(held_h, u[new])
        _KEPT.clear()
        _KEPT[self.key] = np.insert(held_h, place, u[new]), np.insert(held, place, logs[new], axis=0)
        total = np.stack([np.bincount(doc, logs[inverse, j], minlength=n) for j in range(k)], 1)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        some = np.bincount(doc, minlength=n) > 0
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def expected_counts(table_: Pieces, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words that occur ``n`` times, one
    language (``p``: pieces + 1 rows, one column)."""
    length = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start, out = np.cumsum(length) - length, np.zeros(len(p))
    short = np.flatnonzero(length <= SHORT)
    for at, part in _by_length(codes, start[short], length[short]):
        out += _expected(table_.find(part), p, n[short[at]])
    for i in np.flatnonzero(length > SHORT):
        out += _expected_long(table_, np.concatenate(([np.uint32(MARK)], codes[start[i] : start[i] + length[i]])), p, float(n[i]))
    return out


def fit(counts: DataFrame, pieces: list[str]) -> Model:
    """From the stored counts of words (lang, word, n): in each iteration tasks
    sum the expected counts of their words by language and piece."""
    spark, table_ = counts.sparkSession, Pieces(pieces)
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    p = np.full((table_.n + 1, len(languages)), 1 / table_.n)
    p[-1] = 0

    def step(batches):
        table_, languages, p = shared.value
        e = np.zeros_like(p)
        for b in batches:
            lang = np.array([languages.index(x) for x in b.column(0).to_pylist()])
            for j in np.unique(lang):
                at = np.flatnonzero(lang == j)
                words = b.column(1).take(pa.array(at)).to_pylist()
                e[:, j] += expected_counts(table_, words, b.column(2).to_numpy()[at].astype(float), p[:, j : j + 1])
        piece, lang = np.nonzero(e)
        for lo in range(0, len(piece), 100_000):
            i, j = piece[lo : lo + 100_000], lang[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(e[i, j])], names=["piece", "lang", "e"])

    for _ in range(ITERATIONS if languages else 0):
        shared = share(spark, (table_, languages, p))
        got = counts.mapInArrow(A.task(step), "piece int, lang int, e double").groupBy("piece", "lang").agg(F.sum("e").alias("e")).toArrow()
        e = np.zeros_like(p)  # a row a piece and language
        e[got["piece"].to_numpy(), got["lang"].to_numpy()] = np.round(got["e"].to_numpy(), 6)  # sums in any order
        e = e[:-1]
        p = np.vstack([(e + SMOOTH) / (e.sum(0) + SMOOTH * table_.n), np.zeros((1, len(languages)))])
    return Model(languages, table_, p)


def train(docs: DataFrame, usable: Column, path: str | None = None) -> Model:
    """Model from the rows of ``docs`` (doc_id, text, lang) with ``usable`` and a lang."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    per = stored(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(TRAIN_DOCS)) / F.count(F.lit(1))).alias("share")), "lang-shares")
    share = F.pmod(F.xxhash64("doc_id", F.lit("lid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(per, "lang").where(share < F.col("share")).select("lang", "text")

    def run(batches):
        for b in A.slices(batches):
            texts, langs = b.column(1).to_pylist(), b.column(0).to_pylist()
            codes, start, length, doc = split_words(texts)
            fit_ = ~np.isin(doc, doc[length > TRAIN_RUN])
            start, length, doc = start[fit_], length[fit_], doc[fit_]
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs])[doc]
            u, first, n = np.unique(word_hashes(codes, start, length) ^ A.stream(len(names), 83)[lang], return_index=True, return_counts=True)
            words = [codes[start[i] : start[i] + length[i]].tobytes().decode("utf-32-le") for i in first]
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in lang[first]], pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())],
                                             names=["lang", "word", "n"])

    counted = sample.mapInArrow(A.task(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return fit(stored(counted, "lang-words"), letter_pieces(path))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text)."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        for b in A.slices(batches):
            lang, score = shared.value.texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(A.task(run), "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 4 == 2
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
