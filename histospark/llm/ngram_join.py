"""Jaccard self-join of documents on word n-gram sets: a size-aware
heavy-light join, exact for the given threshold.

Global order of shingles: first those that few sets have, then the repeated
ones (a bit array of at most BLOOM_BITS that is broadcast; its false hits are in
this place for every set), last the FREQUENT most frequent, by hash within each.
So a set posts shingles that stand in short lists as far as it has any. Two sets that link share, among the
first ``size - least overlap + l`` shingles of each in that order, at least
``l``. Light (small) sets enumerate all 2-subsets of that part (l = 2) as
keys; heavy (large) sets post single shingles (l = SHARED and some by size),
and so do small sets that may link with a large one. The boundary between small and large is
where a set's number of subsets exceeds the expected length of the inverted
lists it would scan, estimated from list lengths seen in the data (SHORT at
most, so that a set's keys do not grow with the table). Keys with two or more
sets are inverted lists.

Short lists (up to SHORT sets) are scanned for all their pairs, packed and
counted: a pair is a candidate when it shares a subset key or SHARED single
shingles there, which rules out most accidental sharing. A set with so few
shingles in longer lists that any partner must share SHARED others with it is
taken out of those lists; what stays are sets made of widely shared shingles,
without the longest of their lists, as many as no pair needs to meet.
So a pair that links is found in the short lists, or both sets stay and meet
in a long list. Long lists are scanned with the filter that every candidate
has to pass: parity sketches (two bits or more a
shingle, 512 at least), whose distance never exceeds the symmetric difference. Groups of near copies would
give all pairs, so long lists are scanned twice: first each list is covered by
stars (a hub and every set that passes the filter with it), candidates are
counted exactly, and components formed; then only pairs of different
components are tried. A link is thus verified, or lies within one component
already. Exact copies of a set are collapsed before (class edges). A list of more than BLOCK members is cut into blocks: stars
cover each block, hubs of all blocks are scanned together, and then pairs of
blocks that still differ in component are tried, a pair of blocks at a time;
so no scan holds more than two blocks of a list.

Shingles are 64-bit hashes of the words. Documents without words have no
shingles and link with nothing. Repeated rows are separate members of one
class. An empty table gives an empty result; other columns are ignored. While
lists are built, the ids of one list have to fit one task (24 bytes a member);
the most frequent shingles and copy groups, which would make long lists, are kept
out of them by the broadcasts above.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm import arrays as A
from histospark.llm.common import ROW, share, stored, table, with_row_id
from histospark.llm.components import components

U = np.uint64
#: Most frequent shingles that are demoted, and most frequent sets whose copies post once.
FREQUENT, COPIES = 1 << 16, 1 << 12
#: Most repeated shingles (two or more sets of a chunk have them) that are marked, and the
#: highest count of those from which the length of a list is estimated.
MARKED, RARE = 1 << 25, 3
#: Shingles counted, or postings gathered, in a task before they are sent.
FLUSH = 1 << 20
#: Least bits of a sketch; sketches double with the size.
SKETCH_BITS = 512
#: Postings per bucket (about), least number of buckets, and most Bloom filter bits.
BUCKET, BUCKETS, BLOOM_BITS = 1 << 17, 256, 1 << 29
#: Bits of a filter that one row brings to the driver.
PIECE = 1 << 16
#: Shingles that a pair of short lists has to share, and their longest length.
SHARED, SHORT = 4, 6
#: Members of a long list that are scanned in one unit, and hubs a component has in a list of several units.
BLOCK, HUBS = 1 << 18, 32
#: Scans that try one pair for each two components, before the scan of all pairs.
NEAREST = 2
#: Ids at and above this stand for rows without doc_id.
NO_ID = 1 << 62


class Rule:
    """Link when den * |both| >= num * |either|, above one half."""

    def __init__(self, num: int, den: int):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the similarity must be over 0.5 and at most 1")
        self.num, self.den = num, den
        self.least = -(-num // (den - num)) if num < den else 1 << 60  # sizes below link with equal sets only

    def prefix(self, size: int, l: int) -> int:
        return min(size, size + (-self.num * size // self.den) + l)  # size - ceil(num * size / den) + l

    def shared(self, size):
        """Shingles that a set of ``size`` has in common with any partner of at
        least its size, in the parts that both post."""
        return SHARED + np.maximum(2, size // 25)

    def overlap(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))


def _sets(batches, n: int):
    for b in A.slices(batches):
        yield b.column(0).to_pylist(), A.shingle_sets(b.column(1), n, lower=True)


def sketch_class(sizes: np.ndarray) -> np.ndarray:
    """How often SKETCH_BITS is doubled to have two bits a shingle."""
    return np.ceil(np.log2(np.maximum(2 * sizes / SKETCH_BITS, 1))).astype(np.int64)


class Sketches:
    """Sketches of many sets, by class, and folded to the class below."""

    def __init__(self, packed: list[bytes]):
        length = np.array([len(x) for x in packed])
        self.cls = np.log2(length * 8 // SKETCH_BITS).astype(np.int64)
        self.place = np.zeros(len(packed), np.int64)
        self.own, self.folded = {}, {}
        for k in np.unique(self.cls):
            at = np.flatnonzero(self.cls == k)
            m = np.frombuffer(b"".join(packed[i] for i in at), U).reshape(len(at), -1)
            self.place[at], self.own[k] = np.arange(len(at)), m
            self.folded[k] = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance of the sketches of x and y, sets of which x is the smaller;
        0, which filters nothing, where the classes are too far apart."""
        out = np.zeros(len(x), np.int64)
        step = self.cls[y] - self.cls[x]
        for k in np.unique(self.cls[x]):
            for d, other in ((0, self.own), (1, self.folded)):
                at = np.flatnonzero((self.cls[x] == k) & (step == d))
                if len(at):
                    a, b = self.own[k][self.place[x[at]]], other[k + d][self.place[y[at]]]
                    out[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


def profile(docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """One pass over the texts: kind 0, a row per document (id, size, sig,
    sketch); kind 1, shingles that two or more different sets of a chunk have
    (size: how many); kind 2, a row a chunk (size: its shingles)."""

    def run(batches):
        held, many, seen = [], 0, set()

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            x = np.concatenate((u[c > 1].view(np.int64), [0]))
            size = np.concatenate((c[c > 1], [many]))
            kind = np.ones(len(x), np.int32)
            kind[-1] = 2
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(x), pa.array(size, pa.int64()), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.binary())],
                names=["kind", "x", "size", "sig", "sketch"])

        for ids, sets in _sets(batches, n):
            sizes = np.array([len(s) for s in sets])
            doc = np.repeat(np.arange(len(sets)), sizes)
            every = np.concatenate(sets) if len(sets) else np.zeros(0, U)
            bits = SKETCH_BITS << sketch_class(sizes)
            base = np.cumsum(bits) - bits
            at = base[doc] + (every & (bits[doc] - 1).astype(U)).astype(np.int64)
            packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8))
            sketch = [packed[x : x + y] for x, y in zip(base // 8, bits // 8, strict=True)]
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["kind", "x", "size", "sig", "sketch"])
            new = np.array([g not in seen and not seen.add(g) for g in sigs], bool)  # copies post once
            held.append(every[new[doc]])
            many += len(held[-1])
            if many >= 4 * FLUSH:
                yield flush()
                held, many, seen = [], 0, set()
        if many:
            yield flush()

    return docs.mapInArrow(A.task(run), "kind int, x long, size long, sig binary, sketch binary")


def boundary(mean_list: float, rule: Rule) -> int:
    """Largest size for which enumerating the 2-subsets costs no more keys than
    scanning lists of ``mean_list`` members."""
    size = max(rule.least, -(-(SHARED + 2) * rule.den // rule.num))
    while size < 1 << 20 and (rule.prefix(size + 1, 1) + 1) / 2 <= mean_list:
        size += 1
    return size


def repeated(seen: DataFrame, chunks: int, total: int):
    """(marks, how many bits they have, frequent, mean): broadcasts of the bit
    array of the repeated shingles (by their low bits) and of the most frequent
    ones, sorted; and the expected length of a list, but for shingles that more
    than RARE sets are known to have."""
    spark = seen.sparkSession
    counts = seen.where("kind = 1").groupBy("x").agg(F.sum("size").alias("c"), F.sum(F.expr("size * (size - 1)")).alias("p"))
    counts = stored(counts, "ngram-counts")
    by_count = counts.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum("p").alias("p"))
    by_count = sorted(by_count.collect(), reverse=True)  # 1 << 16 rows at most
    marked, n = 0, 0
    while marked < len(by_count) and (not n or n + by_count[marked]["n"] <= MARKED):
        n += by_count[marked]["n"]
        marked += 1
    cut = by_count[marked - 1]["c"] if marked else 1 << 62
    rest, pairs = total - sum(r["s"] for r in by_count if r["c"] > RARE), sum(r["p"] for r in by_count if r["c"] <= RARE)
    often = counts.where(F.col("c") >= cut)
    bits = filter_bits(n)
    marks = bit_array(often.select(F.col("x").bitwiseAND(F.lit(bits - 1)).alias("at")), bits)
    last = often.orderBy(F.desc("c"), "x").limit(FREQUENT).select("x").toPandas()["x"]
    return marks, bits, share(spark, np.sort(last.to_numpy(np.int64).view(U))), 1 + pairs * chunks / max(1, rest)


def in_order(s: np.ndarray, marks: np.ndarray, n_bits: int, often: np.ndarray) -> np.ndarray:
    """The shingles of ``s`` (sorted) in the global order."""
    at = (s & U(n_bits - 1)).astype(np.int64)
    is_marked = ((marks[at >> 6] >> (at & 63).astype(U)) & U(1)).astype(bool)
    marked = s[is_marked]
    if not len(marked):
        return s
    is_often = np.zeros(len(marked), bool)
    if len(often):
        is_often = often[np.minimum(np.searchsorted(often, marked), len(often) - 1)] == marked
    return np.concatenate((s[~is_marked], marked[~is_often], marked[is_often]))


def postings(docs: DataFrame, n: int, rule: Rule, marks, n_bits: int, frequent, copies, small: int, bits: int) -> DataFrame:
    """Rows (bucket, keys, ids): packed postings, by the leading bits of the
    key; the buckets of subset keys are numbered from 2^bits up."""
    pairs: dict = {}
    k1, k2 = (int(x) for x in A.stream(2, 71))

    def keys_of(s: np.ndarray, marked: np.ndarray, often: np.ndarray) -> list[tuple[int, np.ndarray]]:
        s = in_order(s, marked, n_bits, often)
        out = []
        if len(s) <= small:
            part = s[: rule.prefix(len(s), 2)]
            if len(part) not in pairs:
                pairs[len(part)] = np.triu_indices(len(part), 1)
            i, j = pairs[len(part)]
            out.append((1, A.mix(part[i] * U(k1) + part[j] * U(k2))))
        if len(s) > small or rule.den * len(s) >= rule.num * (small + 1):
            out.append((0, s[: rule.prefix(len(s), int(rule.shared(len(s))))]))
        return out

    def run(batches):
        marked, often, rep = marks.value, frequent.value, copies.value
        keys, ids, many, seen = [], [], 0, set()

        def flush():
            k = np.concatenate(keys)
            count = [c for _, _, c in ids]
            i = np.repeat(np.array([x for x, _, _ in ids], np.int64), count)
            b = (k >> U(64 - bits)).astype(np.int32) + np.repeat(np.array([t << bits for _, t, _ in ids], np.int32), count)
            order = np.argsort(b, kind="stable")
            k, i, b = k[order], i[order], b[order]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            end = np.concatenate((cut[1:], [len(b)]))
            return pa.RecordBatch.from_arrays(
                [pa.array(b[cut]), pa.array([k[x:y].tobytes() for x, y in zip(cut, end, strict=True)], pa.binary()),
                 pa.array([i[x:y].tobytes() for x, y in zip(cut, end, strict=True)], pa.binary())], names=["bucket", "keys", "ids"])

        for batch, sets in _sets(batches, n):
            for x, s in zip(batch, sets, strict=True):
                if len(s) < rule.least:
                    continue
                sig = xxhash.xxh3_128_digest(s.tobytes())
                if sig in seen or rep.get(sig, x) != x:
                    continue  # a copy: its class has posted or will
                if len(seen) < FLUSH:
                    seen.add(sig)
                for kind, k in keys_of(s, marked, often):
                    keys.append(k)
                    ids.append((x, kind, len(k)))
                    many += len(k)
            if many >= FLUSH:
                yield flush()
                keys, ids, many = [], [], 0
        if many:
            yield flush()

    return docs.mapInArrow(A.task(run), "bucket int, keys binary, ids binary")


def inverted_lists(posted: DataFrame, bits: int) -> DataFrame:
    """The lists of two or more ids with a common key. Kind 0: the pairs of the
    short ones, packed by a hash of the pair (key: its leading bits; x, y: ids;
    w: weight). Kinds 1 and 2: a long list of single shingles and of subsets
    (key: its name, x: ids, c: how many keys have it)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        subsets = bool(pdf["bucket"].iloc[0] >> bits)
        weight = SHARED if subsets else 1
        k = np.frombuffer(b"".join(pdf["keys"]), U)
        i = np.frombuffer(b"".join(pdf["ids"]), np.int64)
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])))
        k, i = k[new], i[new]
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        m = np.diff(np.concatenate((cut, [len(k)])))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, SHORT + 1):
            at = cut[m == size]
            for x in range(size):
                for y in range(x + 1, size):
                    a.append(i[at + x])
                    b.append(i[at + y])
        a, b = np.concatenate(a), np.concatenate(b)
        to = (A.mix(a.view(U) ^ A.mix(b.view(U))) >> U(64 - bits)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        a, b, to = a[order], b[order], to[order]
        edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
        ends = np.concatenate((edge[1:], [len(to)])) if len(to) else edge
        rows = [(0, int(to[x]), a[x:y].tobytes(), b[x:y].tobytes(), np.full(y - x, weight, np.uint8).tobytes(), 0) for x, y in zip(edge, ends, strict=True)]
        long = np.flatnonzero(m > SHORT)
        if len(long):
            name = (A.mix(np.add.reduceat(A.mix(i.view(U)), cut) + m.astype(U) * U(0x9E3779B97F4A7C15))).view(np.int64)
            _, first, count = np.unique(name[long], return_index=True, return_counts=True)
            rows += [(2 if subsets else 1, int(name[x]), i[cut[x] : cut[x] + m[x]].tobytes(), None, None, int(c)) for x, c in zip(long[first], count, strict=True)]
        return pd.DataFrame(rows, columns=["kind", "key", "x", "y", "w", "c"])

    return posted.groupBy("bucket").applyInPandas(run, "kind int, key long, x binary, y binary, w binary, c long")


def counted_pairs(packed: DataFrame) -> DataFrame:
    """(a, b) of the packed pairs that weigh SHARED or more in all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("x", "y"))
        w = np.frombuffer(b"".join(pdf["w"]), np.uint8)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        cut = cut[np.add.reduceat(w, cut) >= SHARED]
        return pd.DataFrame({"a": a[cut], "b": b[cut]})

    return packed.groupBy("key").applyInPandas(run, "a long, b long")


def near(pairs: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that pass the size and sketch filters."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            n = len(x)
            sketches = Sketches(batch.column(3).to_pylist() + batch.column(5).to_pylist())
            rows = np.arange(n)
            small, large = np.where(x <= y, rows, rows + n), np.where(x <= y, rows + n, rows)
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            ok = (rule.den * lo >= rule.num * hi) & (sketches.apart(small, large) <= lo + hi - 2 * rule.overlap(lo, hi))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    side = lambda c: facts.select(F.col("id").alias(c), F.col("size").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    j = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return j.mapInArrow(A.task(run), "a long, b long")


def long_lists(found: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(list, id) of the members that stay in long lists. A pair that is not
    found in the short lists shares more than ``few`` others of these keys, so
    it still meets when each set leaves its longest ones, ``few`` keys at most
    (of the keys in order of their lists' length, the first that both have
    stands before ``few`` others or more in either set)."""
    lists = found.where("kind > 0").groupBy("key", "kind").agg(F.first("x").alias("x"), F.sum("c").alias("c"))
    rows = members(lists)
    # The smallest partner shares rule.shared(its size) shingles, so SHARED others than these:
    few = F.expr(f"greatest(2, floor(ceil({rule.num} * size / {rule.den}) / 25))")
    longest = Window.partitionBy("id").orderBy(F.desc("n"), "list").rowsBetween(Window.unboundedPreceding, 0)
    single = rows.where("kind = 1").join(sizes, "id").withColumn("held", F.sum("c").over(longest)).where(F.col("held") > few)
    return single.select("list", "id").unionByName(rows.where("kind = 2").select("list", "id"))


def members(lists: DataFrame) -> DataFrame:
    """(list, kind, c, n, id), a row per member; n is the list's length."""

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            if ids:
                n = [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(np.asarray(b.column(k)), n)) for k in range(3)], pa.array(np.repeat(n, n), pa.int64()),
                                                  pa.array(np.concatenate(ids), pa.int64())], names=["list", "kind", "c", "n", "id"])

    return lists.select("key", "kind", "c", "x").mapInArrow(A.task(run), "list long, kind int, c long, n long, id long")


def blocks_of(lists: DataFrame, block: int) -> DataFrame:
    """(list, id, blocks, part): how many blocks a list has, and the member's."""
    long = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks")).where("blocks > 1")
    out = lists.join(F.broadcast(long), "list", "left")  # at most (members of all lists) / block rows
    blocks = F.coalesce("blocks", F.lit(1))
    return out.select("list", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("part"))


def single_blocks(lists: DataFrame) -> DataFrame:
    """(list, id): every block as a list of its own."""
    name = F.when(F.col("blocks") > 1, F.xxhash64("list", "part")).otherwise(F.col("list"))
    return lists.select(name.alias("list"), "id")


def mixed_blocks(rows: DataFrame) -> DataFrame:
    """(list, id, label): lists, and pairs of blocks of one list, that hold more than
    one component, from ``rows`` (list, id, blocks, part, label)."""
    whole, cut = rows.where("blocks = 1"), rows.where("blocks > 1")
    mixed = whole.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("list")
    spans = cut.groupBy("list", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = spans.select("list", F.col("part").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = spans.join(other, "list").where("part <= q AND least(lo, lo2) < greatest(hi, hi2)")
    both = both.select("list", F.xxhash64("list", "part", "q").alias("unit"), F.explode(F.array_distinct(F.array("part", "q"))).alias("part"))
    cut = cut.join(F.broadcast(both), ["list", "part"]).select(F.col("unit").alias("list"), "id", "label")
    return whole.join(mixed, "list").select("list", "id", "label").unionByName(cut)


def candidates(rows: DataFrame, rule: Rule, n_buckets: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of each list in ``rows`` (list, id, size, sketch[, label])
    that pass the size and sketch filters: stars that cover the list or, with
    ``label``, all pairs of different labels; ``nearest``: of these the one with
    the nearest sketches for each two labels of a list."""
    stars = "label" not in rows.columns

    def passing(size, sketches, x, y):
        return sketches.apart(x, y) <= size[x] + size[y] - 2 * rule.overlap(size[x], size[y])

    def nearest_of(sketches, label, x, y):
        """One of the pairs for each two labels."""
        apart = sketches.apart(np.minimum(x, y), np.maximum(x, y))
        one, two = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order = np.lexsort((y, x, apart, two, one))
        first = order[np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))] if len(order) else order
        return x[first], y[first]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list", "size", "id"], ignore_index=True)
        ids, size = pdf["id"].to_numpy(), pdf["size"].to_numpy()
        sketches = Sketches(pdf["sketch"].tolist())
        label = None if stars else pdf["label"].to_numpy()
        name = pdf["list"].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        end = np.concatenate((cut[1:], [len(name)]))
        a, b = [], []
        for lo, hi in zip(cut, end, strict=True):
            left = np.arange(lo, hi)
            if not stars:  # one of a pair is outside the most frequent component
                seen, which, n = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
                one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x in left[which != n.argmax()]:
                    first, last = np.searchsorted(size[lo:hi] * rule.den, size[x] * rule.num), np.searchsorted(size[lo:hi] * rule.num, size[x] * rule.den, "right")
                    y = left[first:last]
                    y = y[label[y] != label[x]]
                    y = y[passing(size, sketches, np.minimum(x, y), np.maximum(x, y))]
                    x = np.full(len(y), x)
                    x, y = nearest_of(sketches, label, x, y) if nearest else (x, y)
                    one.append(x)
                    two.append(y)
                x, y = np.concatenate(one), np.concatenate(two)
                x, y = nearest_of(sketches, label, x, y) if nearest else (x, y)
                a.append(ids[x])
                b.append(ids[y])
                continue
            while len(left) > 1:
                hub, left = left[0], left[1:]
                near = left
                near = near[: np.searchsorted(size[near], size[hub] * rule.den // rule.num, "right")]
                near = near[passing(size, sketches, np.full(len(near), hub), near)]
                a.append(np.full(len(near), ids[hub]))
                b.append(ids[near])
                left = np.setdiff1d(left, near, assume_unique=True)
        none = [np.zeros(0, np.int64)]
        a, b = np.concatenate(a + none), np.concatenate(b + none)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = rows.withColumn("bucket", F.pmod("list", F.lit(n_buckets)))
    return rows.groupBy("bucket").applyInPandas(run, "a long, b long").where("a < b").distinct()


def filter_bits(n: int) -> int:
    """Bits of a filter of ``n`` keys: 16 a key, BLOOM_BITS at most (more keys
    only let more others through)."""
    return min(BLOOM_BITS, max(1 << 12, 1 << (16 * n - 1).bit_length() if n else 0))


def bit_array(places: DataFrame, bits: int):
    """Broadcast array of ``bits`` bits with those numbered ``at`` set."""
    size = min(bits, PIECE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = np.zeros(size, bool)
        piece[pdf["at"].to_numpy() % size] = True
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "x": [np.packbits(piece, bitorder="little").tobytes()]})

    pieces = places.withColumn("piece", F.floor(F.col("at") / F.lit(size))).groupBy("piece").applyInPandas(run, "piece long, x binary")
    filled = np.zeros(bits // 64, U)
    for r in pieces.collect():  # bits / 8 bytes in all
        filled[r["piece"] * size // 64 : (r["piece"] + 1) * size // 64] = np.frombuffer(r["x"], U)
    return share(places.sparkSession, filled)


def bloom(ids: DataFrame):
    """Broadcast bit array with the bits of all ``id`` set, and its length."""
    bits = filter_bits(ids.count())
    return bit_array(ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at")), bits), bits


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` and of few others: a filter
    on the id that goes along before the texts are cut into shingles."""
    filled, bits = bloom(ids)
    at = F.pmod(F.xxhash64("id"), F.lit(bits))

    def run(batches):
        for b in batches:
            p = np.asarray(b.column(2))
            hit = (filled.value[p >> 6] >> (p & 63).astype(U)) & U(1)
            part = b.filter(pa.array(hit.astype(bool)))
            for x, sets in _sets(iter([part]), n):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return docs.select("id", "text", at.alias("at")).mapInArrow(A.task(run), "id long, shingles binary")


def links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets really link."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                keep.append(rule.den * n >= rule.num * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    j = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    j = j.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return j.select("a", "b", "x", "y").mapInArrow(A.task(run), "a long, b long").distinct()


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Self-join of ``docs`` (id: distinct non-null long, text). Returns
    (sets: id, size; classes: id, component for every id that links with
    another and is not the smallest of its component)."""
    spark, rule = docs.sparkSession, Rule(num, den)
    seen = stored(profile(docs, n, rule), "ngram-sets")
    sets = seen.where("kind = 0").select(F.col("x").alias("id"), "size", "sig", "sketch")
    totals = {r["kind"]: r for r in seen.where("kind != 1").groupBy("kind").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).collect()}
    if not totals.get(0) or not totals[0]["s"]:
        return sets.select("id", "size"), sets.select("id", F.col("id").alias("component")).limit(0)
    marks, n_bits, often, mean = repeated(seen, totals[2]["c"], totals[2]["s"])
    small = boundary(min(mean, SHORT), rule)
    copies = sets.where("size > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("rep")).where("c > 1")
    copies = stored(copies, "ngram-copies")
    top = {bytes(r["sig"]): r["rep"] for r in copies.orderBy(F.desc("c"), "rep").limit(COPIES).collect()}
    total = totals[0]["s"] * (1 - num / den) + SHARED * totals[0]["c"]
    bits = max(BUCKETS - 1, int(total) // BUCKET).bit_length()
    posted = postings(docs, n, rule, marks, n_bits, often, share(spark, top), small, bits)
    found = stored(inverted_lists(posted, bits), "ngram-lists")
    facts = sets.select("id", "size", "sketch")
    lists = stored(blocks_of(long_lists(found, sets.select("id", "size"), rule), block), "ngram-long")
    pairs = near(counted_pairs(found.where("kind = 0")), facts, rule)
    pairs = stored(pairs.unionByName(candidates(single_blocks(lists).join(facts, "id"), rule, 1 << bits)).distinct(), "ngram-pairs")
    full = stored(sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n), "ngram-full")
    same = sets.join(copies.select("sig", "rep"), "sig").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = stored(links(pairs, full, rule).unionByName(same), "ngram-links")
    label = stored(components(found, "a", "b"), "ngram-labels")

    def labelled():
        rows = lists.join(label.withColumnRenamed("component", "label"), "id", "left")
        return rows.withColumn("label", F.coalesce("label", "id"))

    def extended(more):
        """The components found so far, as links, and the links among ``more``, or None without new ones."""
        more = stored(more.join(pairs, ["a", "b"], "left_anti"), "ngram-more")
        if more.isEmpty():
            return None
        full = sets_of(docs, more.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n)
        again = stored(links(more, stored(full, "ngram-full"), rule), "ngram-links")
        return None if again.isEmpty() else label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(again)

    # Lists of several blocks: hubs of the components of all blocks, scanned together.
    if not lists.where("blocks > 1").isEmpty():
        hubs = labelled().where("blocks > 1").groupBy("list", "label", F.pmod(F.xxhash64("id"), F.lit(HUBS))).agg(F.min("id").alias("id"))
        hubs = stored(blocks_of(hubs.select("list", "id"), block), "ngram-hubs")
        wider = extended(candidates(single_blocks(hubs).join(facts, "id"), rule, 1 << bits))
        if wider is not None:
            label = stored(components(wider, "a", "b"), "ngram-labels")
    # One pair for each two components of a list first: most of what links there
    # needs no further pair. Then all pairs of components that are still apart.
    for _ in range(NEAREST):
        wider = extended(candidates(mixed_blocks(labelled()).join(facts, "id"), rule, 1 << bits, nearest=True))
        if wider is None:
            break
        label = stored(components(wider, "a", "b"), "ngram-labels")
    wider = extended(candidates(mixed_blocks(labelled()).join(facts, "id"), rule, 1 << bits))
    if wider is not None:
        label = components(wider, "a", "b")
    return sets.select("id", "size"), label


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, text): id is doc_id, or a number from NO_ID up where it is null."""
    text = F.coalesce("text", F.lit(""))
    stand_in = F.lit(NO_ID) + F.shiftright(F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1)), 2)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by
    links; null where no member has one) of each row of ``docs``. Rows that
    repeat a doc_id are one member, linked by any of their texts."""
    sets, classes = join(_keyed(docs), n, num, den, block)
    out = sets.join(classes, "id", "left")
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.withColumn("component", F.coalesce("component", "id")).select(
        real("id").alias("doc_id"), F.col("size").alias("n_shingles"), real("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the smallest doc_id stays."""
    names = docs.columns
    rows = with_row_id(docs, "ngram-input")
    _, classes = join(rows.select(F.col(ROW).alias("id"), "text"), n, num, den)
    classes = stored(classes, "ngram-classes")
    group = classes.unionByName(classes.select(F.col("component").alias("id"), "component").distinct())
    ids = rows.select(F.col(ROW).alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"))
    group = stored(group.join(ids, "id"), "ngram-group")
    best = group.groupBy("component").agg(F.min_by("id", "d").alias("best"))
    losers = group.join(best, "component").where("id != best").select(F.col("id").alias(ROW))
    return rows.join(losers, ROW, "left_anti").select(*[f"`{c}`" for c in names])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
ORACLE = {"op8_ngram_jaccard": SQL}
