"""Quality rules combined by weak supervision.

Each rule looks at a document's statistics and votes good, bad or abstains.
Expectation-maximisation over the vote patterns of all documents estimates,
for good and for bad documents, how often each rule gives each vote; the
posterior probability of "good" replaces all-must-pass filtering. There are at
most 3^rules patterns, so EM works on a bounded histogram however many
documents there are.

Null text has no words; such documents and others without words get zero
counts and fail the base rules. Repeated rows get the same verdict; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm import arrays as A
from histospark.llm.common import stored, table

SYMBOLS = "#*$%&|<>"
ITERATIONS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)  # ASCII letters and the first bytes of other characters
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:0xF5] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_START = np.ones(256, bool)  # bytes that begin a code point
_START[0x80:0xC0] = False

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
         "n_ends", "n_distinct", "n_same_neighbours", "n_bare_words")


def text_stats(col: pa.Array) -> dict[str, np.ndarray]:
    """The STATS of each text of a string column."""
    data, offsets = A.text_buffer(col)
    n = len(offsets) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[offsets[1:]] - c[offsets[:-1]]

    def per_doc(doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=n)

    word = ~A.IS_BLANK[data]
    start, length, doc = A.runs(data, offsets, word)
    h = A.run_hashes(data, start, length)
    salt = A.stream(n, 53)
    n_words = per_doc(doc)
    # Words covered by a 3-word window that occurs twice or more in the text.
    w, wdoc, at = A.windows(h, doc, 3)
    _, inverse, counts = np.unique(w ^ salt[wdoc], return_inverse=True, return_counts=True)
    again = at[counts[inverse] >= 2]
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[again + i] = True
    _, first = np.unique(h ^ salt[doc], return_index=True)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    named = np.concatenate(([0], np.cumsum(_LETTER[data] | _DIGIT[data])))
    bare = named[start + length] == named[start]
    # Lines with a word, and those equal to an earlier line of the text.
    ls, ll, ldoc = A.runs(data, offsets, data != 10)
    c = np.concatenate(([0], np.cumsum(word)))
    full = c[ls + ll] > c[ls]
    ls, ll, ldoc = ls[full], ll[full], ldoc[full]
    _, lfirst = np.unique(A.run_hashes(data, ls, ll) ^ salt[ldoc], return_index=True)
    n_lines = per_doc(ldoc)
    return {"n_words": n_words, "word_chars": per_text(word & _START[data]), "n_symbols": per_text(_SYMBOL[data]),
            "n_dup_lines": n_lines - per_doc(ldoc[lfirst]), "n_repeat_words": per_doc(doc[covered]), "n_lines": n_lines,
            "n_letters": per_text(_LETTER[data]), "n_upper": per_text(_UPPER[data]), "n_ends": per_text(_END[data]),
            "n_distinct": per_doc(doc[first]), "n_same_neighbours": per_doc(doc[1:][same]),
            "n_bare_words": per_doc(doc[bare])}


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the STATS of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in A.slices(batches):
            s = text_stats(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(s[k], pa.int64()) for k in STATS], names=["doc_id", *STATS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(A.task(run), "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def _vote(good: Column, bad: Column) -> Column:
    """2 good, 0 bad, 1 abstain."""
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """The votes, from the STATS."""
    c = F.col
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    letters = c("n_letters") / F.greatest(c("word_chars"), F.lit(1))
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    lines = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    spread = c("n_distinct") / F.sqrt(F.greatest(c("n_words"), F.lit(1)))
    return {
        "length": _vote(c("n_words").between(100, 100_000), c("n_words") < 50),
        "word_length": _vote(per_word("word_chars").between(3, 6.5), (per_word("word_chars") < 2) | (per_word("word_chars") > 7.5)),
        "symbols": _vote(per_word("n_symbols") < 0.05, per_word("n_symbols") > 0.2),
        "bare_words": _vote(per_word("n_bare_words") < 0.05, per_word("n_bare_words") > 0.2),
        "letters": _vote(letters > 0.88, letters < 0.7),
        "upper_case": _vote(upper < 0.3, upper > 0.6),
        "repeated_lines": _vote(lines < 0.2, lines > 0.5),
        "repeated_words": _vote(per_word("n_repeat_words") < 0.2, per_word("n_repeat_words") > 0.4),
        "same_neighbours": _vote(per_word("n_same_neighbours") < 0.05, per_word("n_same_neighbours") > 0.2),
        "vocabulary": _vote(spread > 4, spread < 2),
        "sentences": _vote(per_word("n_ends").between(0.03, 0.4), (per_word("n_ends") < 0.005) | (per_word("n_ends") > 0.8)),
    }


def pattern(votes: dict[str, Column]) -> Column:
    """All votes as one number, a base-3 digit each."""
    out = F.lit(0)
    for v in votes.values():
        out = out * 3 + v
    return out.cast("int")


def estimate(patterns: np.ndarray, counts: np.ndarray, n_rules: int, iterations: int = ITERATIONS) -> np.ndarray:
    """P(good | votes) for each pattern, by expectation-maximisation from a
    weighted majority vote (a bad vote outweighs five good ones). Vote frequencies are smoothed; a rule is never taken to be
    worse than chance (its good votes are at least as likely among good
    documents as among bad ones, its bad votes at most)."""
    votes = np.stack([patterns // 3 ** (n_rules - 1 - j) % 3 for j in range(n_rules)], 1)
    lead = (votes == 2).sum(1) - 5.0 * (votes == 0).sum(1)
    good = 1 / (1 + np.exp(-lead))
    onehot = votes[:, :, None] == np.arange(3)
    for _ in range(iterations):
        rate = []
        for weight in (good * counts, (1 - good) * counts):
            rate.append((np.einsum("p,pjv->jv", weight, onehot) + 0.5) / (weight.sum() + 1.5))
        g, b = rate
        gap = np.log(g) - np.log(b)
        gap[:, 2] = np.maximum(gap[:, 2], 0)
        gap[:, 0] = np.minimum(gap[:, 0], 0)
        prior = (good @ counts + 1) / (counts.sum() + 2)
        score = np.log(prior / (1 - prior)) + np.take_along_axis(gap[None], votes[:, :, None], 2).sum((1, 2))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return good


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, the STATS, base_failed, quality (posterior) and kept."""
    votes = rules()
    stats = stored(with_stats(docs).withColumn("votes", pattern(votes)), "rule-votes")
    seen = stats.groupBy("votes").count().orderBy("votes").collect()  # at most 3^rules rows
    good = estimate(np.array([r["votes"] for r in seen], np.int64), np.array([r["count"] for r in seen], float), len(votes)) if seen else []
    posterior = docs.sparkSession.createDataFrame([(int(r["votes"]), float(q)) for r, q in zip(seen, good, strict=True)], "votes int, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.join(F.broadcast(posterior), "votes").withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("quality") >= 0.5)).drop("votes"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).select(
        "doc_id", *STATS[:5], "base_failed", "quality", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE: dict[str, str] = {}
