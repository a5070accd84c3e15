"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has a bit where more than half of its shingle hashes have
it. Rows with one fingerprint form a class; classes whose fingerprints differ
in at most ``distance`` bits link, and a document's component is everything
reachable by links.

The index is a tree of masked bit patterns (a mask, and the value of the bits
under it). Its uppermost nodes are dealt out by Spark: the 64 bits are cut into
``distance + 1`` ranges, and as ``distance`` differences leave at least one
range untouched, two fingerprints that link share a node whose mask is the
leading bits of one range, at an accumulated difference of zero. The number of
leading bits follows the number of fingerprints (about NODE a node). A node
with more than NODE_MAX fingerprints is replaced by nodes with longer masks: the
whole range first, then, twice, one of ``distance + 1`` ranges of the bits left.
For a distance of 2 the longest masks leave 19 bits open, so that no node ever
has more than 2^19 fingerprints, whatever the input.

Within a node fingerprints are sorted by Gray rank, so that neighbours share
most bits. FAN neighbours make a node of the next level, which holds the bits
they agree on; bits that the parent holds already are factored out of the
child. A search goes down level by level for many fingerprints at once, adds
the differences under each node's own mask and drops the whole group of a node
as soon as they exceed ``distance``. Each node returns a spanning forest of its
links (one edge a fingerprint at most), not its pairs; no link is lost.

Null or blank text has fingerprint zero and links like any other. Repeated
rows and copies are one class; each row is returned. A null doc_id never is a
component's id while the component has another; a component of null ids only
has a null id. Other columns are ignored; an empty table gives an empty result.
A text is hashed PIECE bytes at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from histospark.llm import arrays as A
from histospark.llm.common import stored, table
from histospark.llm.components import components

U = np.uint64
SEED = 42
#: Fingerprints that an uppermost node is meant to have, and may have.
NODE = 4096
NODE_MAX = 1 << 16
#: Children of a node of the index.
FAN = 8
#: Fingerprints searched at once times fingerprints of the node.
SEARCHED = 1 << 24
#: Bytes of text split into words at once; hashes whose bits are counted at once.
PIECE = 4 << 20
COUNTED = 1 << 17

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(raw: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of every ``n``-word shingle (A-Z lower-cased, single blanks),
    repeats included; of the whole word sequence where there are fewer words."""
    raw, at, held, full = raw.lower(), 0, [], False
    while at < len(raw):
        blank = _BLANK.search(raw, at + PIECE)
        to = blank.start() if blank else len(raw)
        words = held + raw[at:to].split()
        if len(words) >= n:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
            yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), U)
            held, full = words[len(words) - n + 1 :], True
        else:
            held = words
        at = to
    if held and not full:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], U)


def majority(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each text the bits that more than half of its hashes have; ``doc``
    is the sorted text index of each hash."""
    ones, total = np.zeros((n_docs, 64), np.int64), np.bincount(doc, minlength=n_docs)
    for lo in range(0, len(h), COUNTED):
        part, own = h[lo : lo + COUNTED], doc[lo : lo + COUNTED]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    over = 2 * ones > total[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0].astype(U)


def fingerprints(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, fingerprint) of each row; the 64 bits as a signed long."""

    def run(batches):
        for b in A.slices(batches):
            h, doc = [], []
            for i, raw in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                for part in shingle_hashes(raw or b"", n):
                    h.append(part)
                    doc.append(np.full(len(part), i))
            h, doc = (np.concatenate(h), np.concatenate(doc)) if h else (np.zeros(0, U), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majority(h, doc, b.num_rows).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(A.task(run), "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(shift))
    return x


class Index:
    """Tree over the codes of one node, sorted by Gray rank. ``levels`` goes
    from the roots to the leaves' parents: (own mask, pattern) of each node."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every, some, levels = self.codes, self.codes, []
        while len(every) > 1:
            first = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            levels.append((~(every ^ some), every))
        self.levels = [(mask, pattern & mask) for mask, pattern in reversed(levels)]
        for k in range(len(self.levels) - 1, 0, -1):  # what the parent holds is not held again
            mask, pattern = self.levels[k]
            self.levels[k] = (mask & ~self.levels[k - 1][0][np.arange(len(mask)) // FAN], pattern)

    def links(self, lo: int, hi: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j), i < j, of all pairs within ``distance`` with i in lo..hi - 1."""
        query, node = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        apart = np.zeros(hi - lo, np.uint8)
        span = FAN ** len(self.levels)
        for k in range(len(self.levels) + 1):
            if k:  # the children of the nodes that are left
                query, apart = np.repeat(query, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                span //= FAN
                ends = np.minimum((node + 1) * span, len(self.codes))
                left = (node * span < len(self.codes)) & (ends - 1 > query)
                query, node, apart = query[left], node[left], apart[left]
            if k < len(self.levels):
                mask, pattern = self.levels[k]
                apart = apart + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
                left = apart <= distance
                query, node, apart = query[left], node[left], apart[left]
        left = np.bitwise_count(self.codes[query] ^ self.codes[node]) <= distance
        return query[left], node[left]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after uniting i with j: each set's smallest place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def forest(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``codes``: (code, root)."""
    index = Index(codes)
    label, step = np.arange(len(codes)), max(1, SEARCHED // max(1, len(codes)))
    for lo in range(0, len(codes), step):
        label = _join(label, *index.links(lo, min(len(codes), lo + step), distance))
    own = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[own], index.codes[label[own]]


def _split(open_bits: list[int], parts: int) -> list[list[int]]:
    """Bits (highest first) cut into ``parts`` runs of like size."""
    return [open_bits[len(open_bits) * k // parts : len(open_bits) * (k + 1) // parts] for k in range(parts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def node_masks(distance: int, leading: int) -> list[dict[int | None, list[int]]]:
    """For each level the masks that take the place of each mask of the level
    before (None: of no mask)."""
    ranges = _split(list(range(63, -1, -1)), distance + 1)
    levels = [{None: [_mask(r[:leading]) for r in ranges]}, {}]
    held = {}
    for r in ranges:
        levels[1][_mask(r[:leading])] = [_mask(r)]
        held[_mask(r)] = r
    if leading == 0:  # one node with all, three ranges below it
        levels[0], levels[1] = {None: [0]}, {0: [_mask(r) for r in ranges]}
    for _ in range(2):
        level, longer = {}, {}
        for mask, bits in held.items():
            more = [bits + r for r in _split([b for b in range(63, -1, -1) if b not in bits], distance + 1)]
            level[mask] = [_mask(m) for m in more]
            longer |= {_mask(m): m for m in more}
        levels.append(level)
        held = longer
    return levels


def _below(codes: DataFrame, level: dict[int | None, list[int]]) -> DataFrame:
    """(mask, value, code): each code once for every mask that follows its own."""
    lists = {m: F.array(*[F.lit(x).cast("long") for x in more]) for m, more in level.items()}
    if None in lists:
        masks = lists[None]
    else:
        masks = F.create_map(*[x for m, more in lists.items() for x in (F.lit(m).cast("long"), more)])[F.col("mask")]
    return codes.select("code", F.explode(masks).alias("mask")).select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code")


def near_links(codes: DataFrame, distance: int = 2, node: int = NODE, node_max: int = NODE_MAX) -> DataFrame:
    """Edges (u, v) between distinct 64-bit ``code`` values that connect
    whatever is within ``distance`` bits, directly or through others."""
    total = codes.count()
    leading = min(64 // (distance + 1), max(0, (max(total, 1) - 1) // node).bit_length())
    levels = node_masks(distance, leading)
    rows, edges = _below(codes, levels[0]), None

    def run(group):
        u, v = forest(group.column("code").to_numpy().view(U), distance)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    for k in range(len(levels)):
        large = None
        if k + 1 < len(levels):
            large = stored(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_max).select("mask", "value"), "simhash-large")
            large = large if large.head(1) else None
        small = rows if large is None else rows.join(large, ["mask", "value"], "left_anti")
        found = small.groupBy("mask", "value").applyInArrow(run, "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        if large is None:
            break
        rows = _below(rows.join(large, ["mask", "value"], "left_semi"), levels[k + 1])
    return edges


def near_duplicates(docs: DataFrame, n: int = 5, distance: int = 2, node: int = NODE, node_max: int = NODE_MAX) -> DataFrame:
    """One row per document: doc_id, fingerprint (long) and component_id."""
    rows = stored(fingerprints(docs, n), "simhash-rows")
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-classes")
    linked = components(near_links(classes.select(F.col("fingerprint").alias("code")), distance, node, node_max), "u", "v")
    classes = classes.join(linked.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
    classes = classes.select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    ids = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(classes.join(ids, "component").select("fingerprint", "component_id"), "simhash-components")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), n=3)
    return out.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


QUERIES = {"op11_simhash": op11_simhash}
ORACLE: dict[str, str] = {}
