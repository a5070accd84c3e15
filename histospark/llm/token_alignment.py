"""Alignment of two tokenizers' tokens by interval coalescing.

Tokens are byte ranges of one text. All A and B tokens of a batch are sorted by
their start (lexsort), the running maximum of their ends is accumulated, and a
group ends where the next start reaches that maximum; within a group every A
token is expanded to the B tokens it overlaps. Overlapping tokens that end
together are links; corpus-wide counts of linked id pairs say how strongly a
document's segmentations agree with the usual ones.

Each text is tokenised once: groups, digests and the distinct id pairs of its
links (with their numbers) are stored, pair counts are combined in every task
before they are shuffled, and the most frequent PAIRS pairs (a bounded
broadcast) are looked up in place; rarer pairs, where there are any, are
shuffled by pair and joined back by row.

Null and empty texts, and texts whose joined token bytes differ from the blank
and the text, have no tokens: zeros, and an empty digest. Repeated rows count
each; other columns are ignored; an empty table gives an empty result. The
tokens of one text must fit its task (some 60 bytes a byte of text).

A's tokenizer file is read as ranks for the tiktoken library, which encodes long
runs of letters in less than quadratic time; ids are those of the file, and a
file whose merges are not in the order of its ids is refused.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histospark.llm import arrays as A
from histospark.llm.bpe import _ragged as ragged
from histospark.llm.common import ROW, share, stored, table

#: Most id pairs looked up in place.
PAIRS = 1 << 21
#: Distinct pairs that a task counts before it sends them.
HELD = 1 << 20
#: Bytes of text handled at once.
SLICE = 1 << 20
#: Code points of blanks in a row above which the tokenizers library encodes a text.
BLANK_RUN = 10_000
#: The split that the tokenizer file's ByteLevel step makes (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write it as: visible
    Latin-1 characters for themselves, the others in turn from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Tokenizer of a byte-level BPE file; the strings of its special tokens
    are plain text."""

    def __init__(self, file_text: str):
        spec, byte = json.loads(file_text), byte_level()
        special = {t["id"] for t in spec["added_tokens"]}
        step = spec["pre_tokenizer"]
        if spec["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"]:
            raise ValueError("this tokenizer splits texts in another way")
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte[c] for c in piece) for piece, i in vocab.items() if i not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("the merges are not in the order of the ids")
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})
        self.plain = Tokenizer.from_str(file_text)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()

    def encode(self, text: str) -> list[int]:
        if any(c * BLANK_RUN in text for c in " \n\t"):  # its regular expression backtracks there
            return self.plain.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the same expression, on other runs; a Rust panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.plain.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Tokenizer of a sentencepiece file."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_of = {i: piece(i) for i in range(self.model.get_piece_size())}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pool:
    """Byte strings by id, as arrays."""

    def __init__(self, strings: dict[int, bytes]):
        every = [strings.get(i, b"") for i in range(max(strings, default=-1) + 1)]
        self.length = np.array([len(s) for s in every], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(every), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.data, self.start[ids], self.length[ids])


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of each range: ranges sorted by start, groups break where a start
    reaches the running maximum of the ends before it."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate(([0], start[order][1:] >= reach[:-1])).astype(np.int64)
    out = np.empty(len(start), np.int64)
    out[order] = np.cumsum(breaks)
    return out


def overlaps(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all A and B ranges that overlap; the ranges of either
    side are ascending and disjoint."""
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(a_start)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


class Aligner:
    """Both tokenizers and the byte strings and decimal numbers of their ids."""

    def __init__(self, byte_file: str, piece_model: bytes):
        self.a, self.b = ByteTokens(byte_file), PieceTokens(piece_model)
        self.pool_a, self.pool_b = Pool(self.a.bytes_of), Pool(self.b.bytes_of)
        self.decimal = Pool({i: b"%d," % i for i in range(max(len(self.pool_a.length), len(self.pool_b.length)))})

    def tokens(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of A and B for each text; none where there is no text or either
        side's bytes are not those of a blank and the text."""
        some = [i for i, t in enumerate(texts) if t]
        a, b = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        for i, piece_ids in zip(some, self.b.encode([texts[i] for i in some]), strict=True):
            raw, piece_ids = b" " + texts[i].encode(), np.array(piece_ids, np.int64)
            if self.pool_b.join(piece_ids).tobytes() == raw:
                byte_ids = np.array(self.a.encode(" " + texts[i]), np.int64)
                if self.pool_a.join(byte_ids).tobytes() == raw:
                    a[i], b[i] = byte_ids, piece_ids
        return a, b

    def align(self, texts: list[str | None]) -> dict:
        """Tokens of all texts as ranges of one line of bytes: ids, text, start,
        end and group of A and B tokens, and the overlapping pairs (i, j)."""
        out = {}
        for side, pool, lists in zip("ab", (self.pool_a, self.pool_b), self.tokens(texts), strict=True):
            ids, n = np.concatenate(lists) if lists else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64)
            end = np.cumsum(pool.length[ids])
            out |= {f"{side}_ids": ids, f"{side}_n": n, f"{side}_doc": np.repeat(np.arange(len(n)), n), f"{side}_start": end - pool.length[ids], f"{side}_end": end}
        group = coalesce(np.concatenate((out["a_start"], out["b_start"])), np.concatenate((out["a_end"], out["b_end"])))
        out["a_group"], out["b_group"] = group[: len(out["a_ids"])], group[len(out["a_ids"]) :]
        out["i"], out["j"] = overlaps(out["a_start"], out["a_end"], out["b_start"], out["b_end"])
        return out

    def digests(self, x: dict) -> list[str]:
        """SHA-256 of each text's groups ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        ids, side = np.concatenate((x["a_ids"], x["b_ids"])), np.repeat([0, 1], [len(x["a_ids"]), len(x["b_ids"])])
        key = 2 * np.concatenate((x["a_group"], x["b_group"])) + side
        order = np.argsort(key, kind="stable")
        ids, key = ids[order], key[order]
        line, end = self.decimal.join(ids), np.cumsum(self.decimal.length[ids])
        last = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) if len(key) else np.zeros(0, np.int64)
        line[end[last] - 1] = np.where(key[last] % 2 == 0, ord("|"), ord(";"))
        cut = np.concatenate(([0], np.cumsum(x["a_n"] + x["b_n"])))
        at = np.concatenate(([0], end))[cut]
        return [hashlib.sha256(line[p : q - 1].tobytes()).hexdigest() if q > p else "" for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def default_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_KEPT: dict = {}


def _aligner(shared) -> Aligner:
    if shared.id not in _KEPT:
        _KEPT.clear()
        _KEPT[shared.id] = Aligner(*shared.value)
    return _KEPT[shared.id]


def _broadcast(spark: SparkSession, files: tuple[str, str] | None):
    byte_file, piece_file = files or default_files()
    with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        return _Shared(share(spark, (f.read(), g.read())))


class _Shared:
    """A broadcast and its number, which tells workers whether they hold it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value


def overlapping_tokens(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """One row per overlapping A-B token pair: doc_id, group (numbered from 0 in
    each text), ids, byte offsets in the blank and the text, end_together."""
    shared = _broadcast(docs.sparkSession, files)

    def run(batches):
        aligner = _aligner(shared)
        for b in A.slices(batches, size=SLICE):
            x = aligner.align(b.column(1).to_pylist())
            i, j = x["i"], x["j"]
            doc = x["a_doc"][i]
            base = np.concatenate(([0], x["a_end"]))[np.cumsum(x["a_n"]) - x["a_n"]]
            first = np.concatenate((x["a_group"], [0]))[np.minimum(np.cumsum(x["a_n"]) - x["a_n"], len(x["a_group"]))]
            cols = [x["a_group"][i] - first[doc], x["a_ids"][i], x["b_ids"][j], x["a_start"][i] - base[doc], x["a_end"][i] - base[doc],
                    x["b_start"][j] - base[doc], x["b_end"][j] - base[doc]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *map(pa.array, cols), pa.array(x["a_end"][i] == x["b_end"][j])],
                                             names=["doc_id", "group", "a_id", "b_id", "a_start", "a_end", "b_start", "b_end", "end_together"])

    return _texts(docs).mapInArrow(A.task(run), "doc_id long, group long, a_id long, b_id long, a_start long, a_end long, b_start long, b_end long, end_together boolean")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """Each row's numbers of tokens and groups, digest, and its links as
    distinct pairs (a_id << 32 | b_id, ascending) with their numbers."""
    shared = _broadcast(docs.sparkSession, files)

    def run(batches):
        aligner = _aligner(shared)
        for b in A.slices(batches, size=SLICE):
            x = aligner.align(b.column(1).to_pylist())
            rows = np.arange(b.num_rows)
            together = x["a_end"][x["i"]] == x["b_end"][x["j"]]
            i, j = x["i"][together], x["j"][together]
            doc, pair = x["a_doc"][i], x["a_ids"][i] << 32 | x["b_ids"][j]
            order = np.lexsort((pair, doc))
            doc, pair = doc[order], pair[order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))) if len(doc) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate((first, [len(doc)])))
            new = np.concatenate(([1], np.diff(x["a_group"]) != 0)).astype(np.int64)[: len(x["a_group"])]
            groups = np.bincount(x["a_doc"], weights=new, minlength=b.num_rows).astype(np.int64)
            cut = np.searchsorted(doc[first], np.append(rows, b.num_rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(x["a_n"]), pa.array(x["b_n"]), pa.array(groups), pa.array(np.bincount(doc, minlength=b.num_rows).astype(np.int64)),
                 pa.array(aligner.digests(x), pa.string()), _lists(pair[first], cut), _lists(n.astype(np.int32), cut)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return _texts(docs).mapInArrow(A.task(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def _merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) over all links: best where no other A id is linked with
    the pair's B id more often."""

    def run(batches):
        keys, n, send = np.zeros(0, np.int64), np.zeros(0, np.int64), lambda k, c: pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["pair", "n"])
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                more, times = part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy()
                keys, n = _merge(np.concatenate((keys, more)), np.concatenate((n, times)))
                if len(keys) > HELD:
                    yield send(keys, n)
                    keys, n = keys[:0], n[:0]
        yield send(keys, n)

    counts = rows.select("pairs", "times").mapInArrow(A.task(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row a B id: no more than its vocabulary
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``rows`` of aligned() (stored) with n_best and count_sum."""
    spark = rows.sparkSession
    counts = stored(pair_counts(rows), "alignment-counts")
    sizes = sorted((r["bits"], r["k"]) for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("k")).collect())  # 64 rows at most
    held, least = 0, 64
    for bits, k in reversed(sizes):  # whole powers of two, the most frequent first, as far as they fit
        if held + k > pairs:
            break
        held, least = held + k, bits
    complete = held == sum(k for _, k in sizes)
    known = counts.where(F.length(F.bin("n")) >= least).toArrow()
    order = np.argsort(known.column("pair").to_numpy())
    shared = share(spark, tuple(known.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches):
        known, n, best = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                lists = part.column(7)
                pair, times = lists.flatten().to_numpy(), part.column(8).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
                found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                value, good = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
                value[found] = n[at[found]] * times[found]
                good[found] = times[found] * best[at[found]]
                n_best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(n_best, row, good)
                np.add.at(total, row, value)
                cut = np.searchsorted(row[~found], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(7)], pa.array(n_best), pa.array(total), _lists(pair[~found], cut), _lists(times[~found], cut)],
                                                 names=[*part.schema.names[:7], "n_best", "count_sum", "rare", "rare_times"])

    plain = [ROW, "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = {ROW: "long", "doc_id": "long", "groups_sha256": "string"}
    columns = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in plain)
    out = rows.select(*plain, "pairs", "times").mapInArrow(A.task(run), f"{columns}, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if complete:
        return out.drop(ROW, "rare", "rare_times")
    out = stored(out, "alignment-found")
    rare = out.select(ROW, F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(ROW, F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    rare = rare.join(counts, "pair").groupBy(ROW).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    out = out.drop("rare", "rare_times").join(rare, ROW, "left")
    out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.drop(ROW, "more_best", "more")


def alignment(docs: DataFrame, files: tuple[str, str] | None = None, pairs: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, n_best, count_sum."""
    return scored(stored(aligned(docs, files).withColumn(ROW, F.monotonically_increasing_id()), "alignment-rows"), pairs)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLE: dict[str, str] = {}
