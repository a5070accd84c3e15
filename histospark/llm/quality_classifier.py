"""Quality classifier by co-training.

Two views of a document: its text content (hashed lower-case words, shares of
symbols, repeats and the like) and its page metadata (source, language,
length, layout of lines). A logistic model per view is fitted on labelled rows;
in each round every view labels, in a fresh pool of unlabelled rows, those it
is most sure of for the other view. Both views are calibrated on labelled rows
held back, combined by a third logistic model, and every document is scored.

Good means quality = 1 and not toxic. Fitting works on bounded samples, taken
by a hash of doc_id: LABELLED labelled rows and POOL unlabelled ones a round;
scoring reads all rows and whole texts, without a shuffle.

Null text counts as empty, null metadata is a value of its own. Labels that
are null or belong to no document are left out; contradicting labels of one
doc_id count as bad. Without usable labels of both kinds all documents get
the share of good labels (0.5 without any) as their score. Repeated rows get
the same score; an empty table gives an empty result; other columns are
ignored by :func:`score` and carried along by :func:`keep_good`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm import arrays as A
from histospark.llm import quality_rules as R
from histospark.llm.common import share, stored, table

U = np.uint64
LABELLED, POOL, ROUNDS = 20_000, 5_000, 3
#: Share of a pool that a view may label in a round, and how sure it must be.
EXCHANGE, SURE = 0.2, 0.98
WORD_BITS, META = 18, 4096
#: L1 penalty times the number of labelled rows.
PENALTY = 2.0
#: Bounds of the bins of the content shares, and their number.
EDGES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])
SHARES = 9
CONTENT = (1 << WORD_BITS) + SHARES * (len(EDGES) + 1)
INPUT = ("text", "lang", "source")

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[0x80:] = True


def features(text: pa.Array, lang: list, source: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the row, content feature), sorted and distinct, and the
    metadata features of each row (rows x fixed number)."""
    data, offsets = A.text_buffer(text)
    n = len(offsets) - 1
    start, length, doc = A.runs(A.LOWER[data], offsets, _LETTERS[data])
    h = A.run_hashes(A.LOWER[data], start, length)
    s = R.text_stats(text)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    shares = (s["n_symbols"] / words, s["n_repeat_words"] / words, s["n_same_neighbours"] / words, s["n_bare_words"] / words,
              s["n_letters"] / chars, s["n_upper"] / np.maximum(s["n_letters"], 1), s["n_ends"] / words,
              s["word_chars"] / words / 12, s["n_distinct"] / np.sqrt(words) / 20)
    rows = np.arange(n)
    at = [doc] + [rows] * SHARES
    f = [(h & U((1 << WORD_BITS) - 1)).astype(np.int64)]
    f += [(1 << WORD_BITS) + i * (len(EDGES) + 1) + np.searchsorted(EDGES, x) for i, x in enumerate(shares)]
    key = np.unique((np.concatenate(at).astype(np.int64) << 20) | np.concatenate(f))
    # Metadata: hashed names and coarse logarithms.
    log = lambda x: np.round(2 * np.log2(1.0 + x)).astype(np.int64)
    code = lambda name, values: np.array([zlib.crc32(f"{name}={v}".encode()) for v in values], np.int64)
    sizes = log(np.diff(offsets))
    lines = log(s["n_lines"])
    per_line = log(s["n_words"] / np.maximum(s["n_lines"], 1))
    dup = np.searchsorted(EDGES, s["n_dup_lines"] / np.maximum(s["n_lines"], 1))
    la, so = code("lang", lang), code("source", source)
    meta = np.stack([la, so, 7919 * sizes + 1, 7907 * lines + 2, 7901 * per_line + 3, 7883 * dup + 4, la + 7919 * sizes, 7907 * lines + 104729 * per_line], 1) % META
    return key >> 20, key & ((1 << 20) - 1), meta


class Linear:
    """Logistic model over sparse binary features, fitted by Adagrad with an
    L1 penalty."""

    def __init__(self, size: int, l1: float):
        self.w, self.b, self.l1 = np.zeros(size), 0.0, l1

    def logits(self, idx: np.ndarray, cut: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.w[idx])))
        return self.b + sums[cut[1:]] - sums[cut[:-1]]

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 1.0, batch: int = 200):
        self.w[:], self.b = 0.0, 0.0
        g2, gb = np.full(len(self.w), 1e-8), 1e-8
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
                idx = np.concatenate([rows[i] for i in part])
                n = np.array([len(rows[i]) for i in part])
                cut = np.concatenate(([0], np.cumsum(n)))
                p = 1 / (1 + np.exp(-np.clip(self.logits(idx, cut), -30, 30)))
                d = (p - y[part]) * weight[part] / len(part)
                seen, inverse = np.unique(idx, return_inverse=True)
                g = np.bincount(inverse, np.repeat(d, n))
                g2[seen] += g * g
                step = rate / np.sqrt(g2[seen])
                w = self.w[seen] - step * g
                self.w[seen] = np.sign(w) * np.maximum(np.abs(w) - step * self.l1, 0)
                gb += d.sum() ** 2
                self.b -= rate / np.sqrt(gb) * d.sum()
        return self


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (last: intercept) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        c -= np.linalg.solve(hess, x.T @ (p - y) + ridge * c)
    return c


class Model:
    """Both views, their calibration and combination."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def fit(self, content: list, meta: list, y: np.ndarray, pools: list[tuple[list, list]]) -> Model:
        held = np.arange(len(y)) % 5 == 0
        fit = np.flatnonzero(~held)
        sets = {0: ([content[i] for i in fit], [y[fit]], [np.ones(len(fit))]), 1: ([meta[i] for i in fit], [y[fit]], [np.ones(len(fit))])}
        self.views = [Linear(CONTENT, PENALTY / len(fit)), Linear(META, 5 * PENALTY / len(fit))]
        for r in range(len(pools) + 1):
            for v, (rows, ys, ws) in sets.items():
                self.views[v].fit(rows, np.concatenate(ys), np.concatenate(ws))
            if r == len(pools):
                break
            for v, rows in enumerate(pools[r]):
                if not rows:
                    continue
                p = 1 / (1 + np.exp(-np.clip(self._view(v, rows), -30, 30)))
                sure = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
                sure = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][: int(EXCHANGE * len(rows))]
                other = sets[1 - v]
                other[0].extend(pools[r][1 - v][i] for i in sure)
                other[1].append((p[sure] >= 0.5).astype(float))
                other[2].append(np.full(len(sure), 0.5))
        at = np.flatnonzero(held)
        z = [self._view(v, [rows[i] for i in at]) for v, rows in enumerate((content, meta))]
        self.platt = [_logistic(x[:, None], y[at]) for x in z]
        both = np.column_stack([x * c[0] + c[1] for x, c in zip(z, self.platt, strict=True)])
        self.mixed = _logistic(both, y[at])
        return self

    def _view(self, v: int, rows: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(x) for x in rows])
        return self.views[v].logits(np.concatenate(rows), np.concatenate(([0], np.cumsum(n))))

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        """(score, content view, metadata view), columns of probabilities."""
        n = batch.num_rows
        if self.constant is not None:
            return np.full((n, 3), self.constant)
        text, lang, source = (batch.column(batch.schema.get_field_index(c)) for c in INPUT)
        doc, f, meta = features(text, lang.to_pylist(), source.to_pylist())
        z = [self.views[0].logits(f, A.bounds(doc, n)), self.views[1].logits(meta.ravel(), np.arange(n + 1) * meta.shape[1])]
        both = np.column_stack([x * c[0] + c[1] for x, c in zip(z, self.platt, strict=True)])
        logit = np.column_stack([both @ self.mixed[:2] + self.mixed[2], both])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in INPUT])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on bounded samples of ``docs`` with ``labels`` (doc_id, quality, toxic)."""
    spark = docs.sparkSession
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("y"))
    known = stored(known, "labels")
    n_known, n_docs = known.count(), docs.count()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    pool = ids.where(share("doc_id") < min(1.0, POOL * ROUNDS / max(1, n_docs))).distinct().join(known, "doc_id", "left_anti")
    pool = pool.orderBy(F.xxhash64("doc_id")).limit(POOL * ROUNDS).select("doc_id", F.lit(None).cast("double").alias("y"))
    some = known.where(share("doc_id") < min(1.0, 1.1 * LABELLED / max(1, n_known))).orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    chosen = stored(some.unionByName(pool), "training-ids")  # LABELLED + POOL * ROUNDS rows at most

    def run(batches):
        for b in A.slices(batches):
            doc, f, meta = features(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist())
            cut = A.bounds(doc, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(4), pa.array([f[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array([m.astype(np.int32).tobytes() for m in meta], pa.binary())], names=["doc_id", "y", "content", "meta"])

    rows = _columns(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", *INPUT, "y")
    got = rows.mapInArrow(A.task(run), "doc_id long, y double, content binary, meta binary").toArrow()
    order = np.argsort(np.asarray(got.column("doc_id").to_numpy()), kind="stable")
    order = order[np.argsort(_spread(got.column("doc_id").to_numpy()[order]), kind="stable")]
    y = got.column("y").to_numpy()[order]
    unpack = lambda c: [np.frombuffer(x.as_buffer(), np.int32) for x in got.column(c).take(pa.array(order))]
    content, meta = unpack("content"), unpack("meta")
    labelled, free = np.flatnonzero(~np.isnan(y)), np.flatnonzero(np.isnan(y))
    if len(labelled) < 20 or len(set(y[labelled])) < 2:
        return Model(float(y[labelled].mean()) if len(labelled) else 0.5)
    pools = [([content[i] for i in part], [meta[i] for i in part]) for part in np.array_split(free, ROUNDS)]
    return Model().fit([content[i] for i in labelled], [meta[i] for i in labelled], y[labelled], pools)


def _spread(ids: np.ndarray) -> np.ndarray:
    return A.mix(ids.astype(np.int64).view(U))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of good), p_content, p_meta and kept."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        for b in A.slices(batches):
            s = shared.value.score(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(s[:, i]) for i in range(3)], pa.array(s[:, 0] >= 0.5)],
                                             names=["doc_id", "score", "p_content", "p_meta", "kept"])

    return _columns(docs).mapInArrow(A.task(run), "doc_id long, score double, p_content double, p_meta double, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        for b in A.slices(batches):
            yield b.filter(pa.array(shared.value.score(b)[:, 0] >= 0.5))

    return docs.mapInArrow(A.task(run), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
