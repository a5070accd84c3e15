"""BPE encoding and decoding with a distinct-word table.

Documents are split into words as the tokenizer's pre-tokenizer does, every
distinct word of the corpus is encoded once, and its ids are joined back by
position; decoding joins ids to their pieces: a lookup in the broadcast
id-to-piece table by position for the digests, a DataFrame join in
:func:`decode`. The word table is joined
map-side as far as DICTIONARY words, the most frequent ones (a bounded
broadcast); rows with rarer words, where there are any, get their ids by a
shuffle join on the word's hash.

The tokenizer file is a parameter, read on the driver and broadcast. Words are
identified by 64-bit hashes of their code points. Null text counts as empty:
no ids, empty decoded text. Repeated rows are encoded each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from histospark.llm import arrays as A
from histospark.llm.common import ROW, settle, share, stored, table

U = np.uint64
#: Most words of the map-side dictionary, and most bytes of their ids.
DICTIONARY, DICTIONARY_BYTES = 4_000_000, 128 << 20
#: Hashes of words that a task has sent already and remembers.
HELD = 4_000_000
#: Bytes of text handled at once.
SLICE = 1 << 19
ABSENT = np.uint32(0xFFFFFFFF)
#: Texts without this are not searched for special tokens.
SPECIAL = "<|"

_HIGH = regex.compile("[^\\x00-\\u036f]")
_KEPT: dict = {}


def default_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    """0 blank, 1 letter, 2 number, 3 other for each code point, by the same
    regular expression engine that the pre-tokenizer uses."""
    if "classes" not in _KEPT:
        out = np.full(0x110000, 3, np.uint8)
        kinds = [(no, Split(Regex(p), "removed", invert=True)) for no, p in ((1, "\\p{L}+"), (2, "\\p{N}+"), (0, "\\s+"))]
        for lo in range(0, 0x110000, 0x800):
            if not 0xD800 <= lo < 0xE000:
                part = "".join(map(chr, range(lo, lo + 0x800)))
                for no, kind in kinds:
                    for _, (x, y) in kind.pre_tokenize_str(part):
                        out[lo + x : lo + y] = no
        _KEPT["classes"] = out
    return _KEPT["classes"]


class Words:
    """Splits texts into the words of a tokenizer of the supported kind: NFC,
    blanks, lower case; contractions, letter runs, single numbers, other runs."""

    def __init__(self, special: tuple[str, ...]):
        self.normalizer = Sequence([NFC(), Lowercase()])  # blanks are dropped in any case
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def normal(self, text: str) -> str:
        if text.isascii() or (not _HIGH.search(text) and unicodedata.is_normalized("NFC", text)):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def split(self, texts: list[str | None]):
        """(code points, start, length, index of the text) of all words, and
        the special tokens found: {index of the word: token}."""
        parts, specials, n = [], [], 0
        for t in texts:
            t = t or ""
            if self.cut is not None and SPECIAL in t and (pieces := self.cut.split(t))[1:]:
                done = []
                for i, p in enumerate(pieces):
                    if i % 2:  # a special token: one code point stands for it, between blanks
                        done.append("\n")
                        specials.append((n + sum(map(len, done)), p))
                        done.append("\x00\n")
                    else:
                        done.append(self.normal(p))
                t = "".join(done)
            else:
                t = self.normal(t)
            parts.append(t)
            n += len(t) + 1
        codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts])
        cls = _classes()[codes]
        start = cls != 0
        start[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        q = np.flatnonzero((codes == 39) & start)  # contractions: only at the start of a run
        if len(q):
            one = codes[np.minimum(q + 1, len(codes) - 1)]
            two = codes[np.minimum(q + 2, len(codes) - 1)]
            s, t, m, d, r, e, v, l = (ord(c) for c in "stmdrevl")
            short = (one == s) | (one == t) | (one == m) | (one == d)
            long = ((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == l) & (two == l))
            for sel, k in ((q[short], 2), (q[long], 3)):
                start[sel + 1] = False
                after = sel + k
                start[after[cls[after] == 1]] = True
        edge = np.flatnonzero(start | (cls == 0))
        first = np.flatnonzero(start[edge])
        at = edge[first]
        length = edge[first + 1] - at  # the text ends with a blank, so there is a next edge
        doc = np.searchsorted(ends, at, "right")
        found = {}
        for place, token in specials:
            found[int(np.searchsorted(at, place))] = token
        return codes, at, length, doc, found


def _hashes(codes: np.ndarray, at: np.ndarray, length: np.ndarray, found: dict) -> np.ndarray:
    if len(at) == 0:
        return np.zeros(0, U)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    terms = (codes[place + np.repeat(at, length)].astype(U) + U(1)) * A._places(int(length.max()))[place]
    h = A.mix(np.add.reduceat(terms, first) + length.astype(U) * U(0xD6E8FEB86659FD93))
    for i, token in found.items():
        h[i] = word_hash(token)
    return h


def word_hash(word: str) -> np.uint64:
    c = np.array([ord(x) for x in word], U)
    return _hashes(c, np.zeros(1, np.int64), np.array([len(c)]), {})[0]


def special_tokens(file_text: str) -> tuple[str, ...]:
    """The tokenizer's special tokens; an error if it splits in another way."""
    spec = json.loads(file_text)
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if kinds != ["NFC", "Replace", "Lowercase"] or pattern != "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+":
        raise ValueError("this tokenizer splits words in another way")
    special = tuple(t["content"] for t in spec["added_tokens"])
    if not all(t.startswith(SPECIAL) for t in special):
        raise ValueError(f"a special token doesn't begin with {SPECIAL}")
    return special


def _splitter(special: tuple[str, ...]) -> Words:
    if special not in _KEPT:
        _KEPT[special] = Words(special)
    return _KEPT[special]


def distinct_words(docs: DataFrame, special: tuple[str, ...]) -> DataFrame:
    """(word, n) of the corpus: every distinct word, and how many tasks sent
    it; a task sends a word once."""

    def run(batches):
        split, sent = _splitter(special), np.zeros(0, U)
        for b in A.slices(batches, size=SLICE):
            codes, at, length, _, found = split.split(b.column(0).to_pylist())
            u, first = np.unique(_hashes(codes, at, length, found), return_index=True)
            if len(sent):
                new = sent[np.minimum(np.searchsorted(sent, u), len(sent) - 1)] != u
                u, first = u[new], first[new]
            if len(sent) + len(u) > HELD:
                sent = sent[:0]
            sent = np.insert(sent, np.searchsorted(sent, u), u)
            words = [found[i] if i in found else codes[at[i] : at[i] + length[i]].tobytes().decode("utf-32-le") for i in first.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])
        del sent

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(A.task(run), "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encoded_words(words: DataFrame, file_text: str) -> DataFrame:
    """(h, n, ids) of each distinct word: its hash, count and ids (unsigned 32-bit, little-endian)."""
    spec = json.loads(file_text)
    spec["normalizer"] = None  # the words are normalised already
    file = share(words.sparkSession, json.dumps(spec))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core; threads would each keep memory
        t = Tokenizer.from_str(file.value)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                words = part.column(0).to_pylist()
                ids = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(words, add_special_tokens=False)]
                length = np.array([len(w) for w in words])
                codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
                h = _hashes(codes, np.cumsum(length) - length, length, {}).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column(1), pa.array(ids, pa.binary())], names=["h", "n", "ids"])
        del t

    return words.mapInArrow(A.task(run), "h long, n long, ids binary")


def _vocabulary(file_text: str) -> dict[str, int]:
    spec = json.loads(file_text)
    return spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}


def pieces(spark: SparkSession, file_text: str) -> DataFrame:
    """(id, piece) of the whole vocabulary."""
    return spark.createDataFrame(sorted((i, p) for p, i in _vocabulary(file_text).items()), "id int, piece string")


def decode(rows: DataFrame, file_path: str | None = None, skip: tuple[int, ...] = ()) -> DataFrame:
    """``rows`` (id columns and ids array<int>) with ``decoded``: ids joined to
    their pieces by position, pieces joined with single blanks."""
    spark, keys = rows.sparkSession, [c for c in rows.columns if c != "ids"]
    with open(file_path or default_file(), encoding="utf-8") as f:
        vocabulary = pieces(spark, f.read()).where(~F.col("id").isin(list(skip)) if skip else F.lit(True))
    rows = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "bpe-rows")
    each = rows.select(ROW, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary), "id")  # 50,000 rows or so
    text = each.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))  # as long as its document
    text = text.select(ROW, F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))
    return rows.join(text, ROW, "left").select(*keys, F.coalesce("decoded", F.lit("")).alias("decoded"))


def _ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of pool[start : start + length]."""
    start, length = start.astype(np.int64), length.astype(np.int64)
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(start - (ends - length), length)]


class _Pieces:
    """The id-to-piece table as arrays; every piece is followed by a blank."""

    def __init__(self, file_text: str):
        vocab = {i: p.encode() + b" " for p, i in _vocabulary(file_text).items()}
        table_ = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.length = np.array([len(p) for p in table_], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(table_), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        return _ragged(self.pool, self.start[ids], self.length[ids])[:-1].tobytes()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


class Dictionary:
    """Hashes (sorted), and where each word's ids are in the pool."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").combine_chunks().to_numpy(zero_copy_only=False).view(U) if rows.num_rows else np.zeros(0, U)
        data, offsets = A.text_buffer(rows.column("ids").combine_chunks()) if rows.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        order = np.argsort(h)
        self.h = h[order]
        self.start = (offsets[:-1] // 4)[order].astype(np.uint32)
        self.length = _narrow((np.diff(offsets) // 4)[order])
        self.pool = _narrow(np.frombuffer(data.tobytes(), "<u4"))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word, ABSENT where the dictionary has none."""
        if not len(self.h):
            return np.full(len(h), ABSENT)
        u, inverse = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
        return np.where(self.h[at] == u, at, ABSENT).astype(np.uint32)[inverse]


def words_ids(d: Dictionary, places: np.ndarray) -> np.ndarray:
    return _ragged(d.pool, d.start[places], d.length[places])


OUT = "doc_id long, n_tokens long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _columns(doc_id, ids: list[np.ndarray], digest: bool, table_: _Pieces | None) -> pa.RecordBatch:
    n = pa.array([len(x) for x in ids], pa.int64())
    if not digest:
        return pa.RecordBatch.from_arrays([doc_id, n, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return pa.RecordBatch.from_arrays([doc_id, n, pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()),
                                       pa.array([sha(table_.text(x)) for x in ids], pa.string())],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, file_path: str | None = None, digest: bool = False, dictionary: int = DICTIONARY) -> DataFrame:
    """Ids of every row of ``docs`` (doc_id, text): doc_id, n_tokens and ids,
    or with ``digest`` the hashes of the ids and of the decoded text."""
    spark = docs.sparkSession
    settle(spark)  # the dictionary of an encoding before
    with open(file_path or default_file(), encoding="utf-8") as f:
        text = f.read()
    special, shared = special_tokens(text), share(spark, _Pieces(text) if digest else None)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = stored(encoded_words(distinct_words(docs, special), text), "bpe-words")
    bins = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("ids")).alias("bytes"))  # a row a number of tasks
    bins = bins.groupBy(F.least(F.col("n"), F.lit(1 << 12)).alias("n")).agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")).collect()
    held, size, least = 0, 0, (1 << 12) + 1
    for r in sorted(bins, reverse=True):  # the most widespread words first, as far as they fit
        held, size = held + r["words"], size + r["bytes"]
        if held > dictionary or size > DICTIONARY_BYTES:
            break
        least = r["n"]
    many = least > min((r["n"] for r in bins), default=least)
    known = words.where(F.col("n") >= least)
    known = share(spark, Dictionary(known.select("h", "ids").toArrow()))

    def places(batches):
        split, d = _splitter(special), known.value
        for b in A.slices(batches, size=SLICE):
            codes, at, length, doc, found = split.split(b.column(1).to_pylist())
            h = _hashes(codes, at, length, found)
            yield b, h, d.find(h), A.bounds(doc, b.num_rows)

    def all_known(batches):
        d, table_ = known.value, shared.value
        for b, _, w, cut in places(batches):
            tokens = np.concatenate(([0], np.cumsum(d.length[w], dtype=np.int64)))
            ids = words_ids(d, w)
            yield _columns(b.column(0), [ids[tokens[x] : tokens[y]] for x, y in zip(cut[:-1], cut[1:], strict=True)], digest, table_)

    def with_gaps(batches):
        for b, h, w, cut in places(batches):
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            gaps = [np.flatnonzero(w[x:y] == ABSENT) for x, y in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([w[x:y].tobytes() for x, y in spans], pa.binary()), pa.array(gaps, pa.list_(pa.int64())),
                 pa.array([h[x:y].view(np.int64)[g] for (x, y), g in zip(spans, gaps, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "places", "pos", "h"])

    def fill(batches):
        d, table_ = known.value, shared.value
        for b in batches:
            out = []
            for p, rest in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = np.frombuffer(p, np.uint32)
                rest = sorted((r["pos"], r["ids"]) for r in rest or ())
                done, last = [], 0
                for pos, ids in rest:
                    done += [words_ids(d, w[last:pos]), np.frombuffer(ids, "<u4")]
                    last = pos + 1
                done.append(words_ids(d, w[last:]))
                out.append(np.concatenate(done))
            yield _columns(b.column(0), out, digest, table_)

    kind = DIGEST if digest else OUT
    if not many:
        return docs.mapInArrow(A.task(all_known), kind)
    rows = docs.mapInArrow(A.task(with_gaps), "doc_id long, places binary, pos array<long>, h array<long>")
    rows = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "bpe-places")
    rest = rows.select(ROW, F.explode(F.arrays_zip("pos", "h")).alias("g")).select(ROW, "g.pos", "g.h")
    rest = rest.join(words.where(F.col("n") < least).select("h", "ids"), "h").groupBy(ROW).agg(F.collect_list(F.struct("pos", "ids")).alias("rest"))
    return rows.join(rest, ROW, "left").select("doc_id", "places", "rest").mapInArrow(A.task(fill), kind)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}
