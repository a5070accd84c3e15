"""Token counts by source, language and tokenizer version, maintained by
signed deltas.

A change inserts, deletes or revises (recounts, perhaps with another tokenizer
version) one document. A batch of changes is turned into deltas against the
ledger of what each document counts for so far: minus the old count where
there is one, plus the new one. The deltas of a batch, added up by group, and
its ledger rows are written to the batch's own folder; totals are the sum over
committed batches.

Commits are idempotent: a batch counts once its last file set has its success
marker; a batch that was committed is not applied again, and one that broke
off is written anew from the same changes. Batches are applied in the order of
their numbers.

Of several changes of one document in a batch the one with the greatest seq
counts (then the greatest count, then names in order). Deleting or revising an
unknown document is no error: there is nothing to subtract, and a revision
inserts. Null source, language or tokenizer are groups of their own; null
counts as 0 tokens. Rows without doc_id can be inserted but never changed.
Empty batches commit nothing but their marker. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm.common import WORD, stored, table
from histospark.session import workspace_dir

GROUP = ("source", "lang", "tokenizer")
CHANGES = "doc_id long, op string, seq long, source string, lang string, tokenizer string, n_tokens long"
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, live boolean"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """Rollup kept in the folder ``root`` (shared by driver and executors)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, batch: int, part: str) -> str:
        return f"{self.root}/{part}/batch={batch}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self._path(batch, 'totals')}/_SUCCESS")

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/totals")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(top)]
        return sorted(b for b in found if self.committed(b))

    def _read(self, part: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        frames = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{part}")
        return frames.parquet(*[self._path(b, part) for b in batches])

    def ledger(self, before: int | None = None) -> DataFrame:
        """What each document counts for: its row of the latest batch."""
        rows = self._read("ledger", LEDGER, [b for b in self.batches() if before is None or b < before])
        last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["doc_id", "batch"]).where("live").drop("live", "batch")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (CHANGES) as ``batch``; False if it was applied before."""
        if self.committed(batch):
            return False
        if any(b > batch for b in self.batches()):
            raise ValueError("a later batch is committed already")
        names = [c.split()[0] for c in CHANGES.split(", ")]
        rows = changes.select(*names).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))
        order = F.struct("seq", "n_tokens", *GROUP, "op")
        last = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(order).alias("c")).select("doc_id", "c.*")
        known = self.ledger(before=batch).select("doc_id", F.struct(*GROUP, "n_tokens").alias("old"))
        both = last.join(known, "doc_id", "left")
        both = both.withColumn("live", F.col("op") != "delete").where("live OR old IS NOT NULL")
        ledger = stored(both.select("doc_id", *GROUP, "n_tokens", "live", "old"), "rollup-changes")
        ledger.drop("old").write.mode("overwrite").parquet(self._path(batch, "ledger"))
        plus = ledger.where("live").select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        minus = ledger.where("old IS NOT NULL").select("old.*").select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        loose = rows.where("doc_id IS NULL AND op = 'insert'").select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        delta = plus.unionByName(minus).unionByName(loose).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(self._path(batch, "totals"))  # its success marker commits the batch
        return True

    def totals(self) -> DataFrame:
        """Live documents and tokens by group."""
        rows = self._read("totals", TOTALS, self.batches())
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0")


#: Tokenizer versions: words, and letter runs, digit runs and single other characters.
VERSIONS = {"words-1": WORD, "pieces-2": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def count_tokens(version: str) -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(VERSIONS[version])).cast("long")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 1 inserts all documents (words-1); batch 2 deletes those labelled
    toxic; batch 3 recounts the others labelled good with pieces-2; batch 2
    arrives once more. Returns the totals."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", count_tokens("words-1").alias("n1"), count_tokens("pieces-2").alias("n2"))
    docs = stored(docs, "rollup-counts")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    change = lambda rows, op, version, n: rows.select(
        "doc_id", F.lit(op).alias("op"), F.lit(0).cast("long").alias("seq"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"))
    rollup = TokenRollup(spark, workspace_dir(spark, "rollup"))
    rollup.commit(1, change(docs, "insert", "words-1", "n1"))
    toxic = change(docs.join(labels.where("toxic = 1"), "doc_id"), "delete", "words-1", "n1")
    rollup.commit(2, toxic)
    good = labels.where("quality = 1 AND coalesce(toxic, 0) != 1")
    rollup.commit(3, change(docs.join(good, "doc_id"), "revise", "pieces-2", "n2"))
    rollup.commit(2, toxic)
    return rollup.totals()


SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, coalesce(l.quality = 1, false) AS v2,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n1,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS BIGINT) AS n2
      FROM documents LEFT JOIN l ON l.doc_id = documents.doc_id WHERE coalesce(l.toxic, 0) != 1)
SELECT source, lang, CASE WHEN v2 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer, count(*) AS n_docs,
       CAST(sum(CASE WHEN v2 THEN n2 ELSE n1 END) AS BIGINT) AS n_tokens
FROM d GROUP BY ALL
"""

QUERIES = {"op9_token_rollup": op9_token_rollup}
ORACLE = {"op9_token_rollup": SQL}
