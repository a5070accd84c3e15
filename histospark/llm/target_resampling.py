"""Importance resampling towards a target distribution, with Arrow kernels.

A text's features are its words and neighbouring pairs of words (up to
``n``-word runs), hashed into BUCKETS by CRC-32. Raw counts of a corpus and of
a target give every bucket a gain (the floored thousandfold log ratio of its
add-one probabilities); a document's weight is the floored mean gain of its
features, its score the weight plus Gumbel noise from a hash of its doc_id, and
the highest scores are drawn without replacement.

Texts go through Arrow kernels a slice at a time: ascii_lower,
split_pattern_regex, list_flatten, dictionary_encode; n-grams are combinations
of shifted dictionary indices, CRC is computed once per distinct combination
of a slice, and gains are taken by bucket and summed by segment. Each task
sends its bucket counts once (BUCKETS rows at most); the gains are BUCKETS
numbers. The draw needs no global sort: scores are whole numbers of a bounded
range (both parts are logarithms), so that rows per score, at most some 100,000
numbers, give every score the rank at which it begins; rows of one score are
ranked by doc_id.

Null text counts as empty: no features, weight 0, never drawn where
``min_words`` is above 0. Repeated rows are weighed and drawn each (equal
doc_ids have equal noise; ranks among them are in no set order). A null doc_id
hashes as the empty string and ranks after the others of its score. An empty
target or corpus counts as zeros. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm import arrays as A
from histospark.llm.common import share, stored, table

BUCKETS = 10_000
#: Between two words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(col: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(dictionary index of each word, dictionary, index of its text)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(col, "")).cast(pa.large_string()), GAP)
    flat, doc = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(flat), 0)  # none before the first gap and after the last
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist(), doc.filter(real).to_numpy()


def features(col: pa.Array, n: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, index of its text, words of each text)."""
    index, dictionary, doc = words(col)
    crc = np.fromiter(map(zlib.crc32, dictionary), np.uint32, len(dictionary))
    spaced = np.empty(len(dictionary), object)
    spaced[:] = [b" " + w for w in dictionary]
    code, code_crc = index.astype(np.int64), crc  # number of the run that begins at each word; its CRC, by number
    buckets, docs = [crc[index] % BUCKETS], [doc]
    for k in range(1, n):
        at = np.flatnonzero(doc[: max(0, len(doc) - k)] == doc[k:])
        distinct, numbers = np.unique(code[at] * len(dictionary) + index[at + k], return_inverse=True)
        head, tail = np.divmod(distinct, max(1, len(dictionary)))
        code_crc = np.fromiter(map(zlib.crc32, spaced[tail], code_crc[head].tolist()), np.uint32, len(distinct))
        code = np.zeros(len(index), np.int64)
        code[at] = numbers
        buckets.append(code_crc[numbers] % BUCKETS)
        docs.append(doc[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(docs), np.bincount(doc, minlength=len(col))


def bucket_counts(docs: DataFrame, n: int = 2) -> DataFrame:
    """(bucket, n) over all texts of ``docs``; a task sends a bucket once."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in A.slices(batches):
            total += np.bincount(features(b.column(0), n)[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(A.task(run), "bucket int, n long")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 2) -> np.ndarray:
    """Gain of each bucket; BUCKETS counts of either side reach the driver."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for out, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, n).toLocalIterator():
            out[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    shared = share(docs.sparkSession, gain)  # BUCKETS numbers

    def run(batches):
        gain = shared.value
        for b in A.slices(batches):
            bucket, doc, n_words = features(b.column(1), n)
            order = np.argsort(doc, kind="stable")
            taken, doc = gain[bucket[order]], doc[order]
            n_features = np.bincount(doc, minlength=b.num_rows)
            total = np.zeros(b.num_rows, np.int64)
            if len(doc):
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                total[doc[first]] = np.add.reduceat(taken, first)
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_features.astype(np.int64)), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(A.task(run), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Floored thousandfold Gumbel noise from the hash of ``<seed>:<doc_id>``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(rows: DataFrame, eligible, num: int, den: int) -> DataFrame:
    """``rows`` (stored, with doc_id and score) with ``rank``: 1, 2, ... for the
    floor(num * N / den) highest scores of the N eligible rows, else null."""
    tally = rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0)))  # a row a score: a bounded number
    tally = stored(tally, "resampling-scores")
    wanted = (tally.agg(F.sum("__n")).first()[0] or 0) * num // den
    taking = F.col("__above") < wanted
    lowest = tally.where(taking).agg(F.min("score")).first()[0]
    may = F.coalesce(eligible & (F.col("score") >= F.lit(lowest)), F.lit(False)) if lowest is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))).cast("long")
    ranked = rows.where(may).join(F.broadcast(tally.where(taking).select("score", "__above")), "score")
    ranked = ranked.withColumn("rank", F.col("__above") + place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select(*rows.columns, "rank").unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, num: int = 25, den: int = 100, min_words: int = 20, n: int = 2, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank."""
    rows = weights(docs, gains(docs, target, n), n)
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-rows")
    return draw(rows, F.col("n_words") >= min_words, num, den).select("doc_id", "n_features", "weight", "score", "rank")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_target_resampling": op13_target_resampling}
ORACLE: dict[str, str] = {}
