"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

Every batch is stored as the changes it makes, per document and rolled up, and appears under its own name in one atomic
rename: a batch is in the totals once or not at all, however often it is tried. Totals add up the rolled-up changes
and never touch documents again.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_path, materialize
from .common import small_side

_KEYS = ["doc_id", "source", "lang", "tokenizer"]
_LEDGER = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
_ROLLUP = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class TokenRollup:
    """Totals below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _hadoop(self, path: str):
        return self._fs.Path(path)

    def committed(self) -> list[str]:
        """Names of the batches in the totals."""
        folder = self._hadoop(f"{self.path}/batches")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(folder))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/batches/{b}/{part}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """What is counted now, per document: the ledger's signed rows added up."""
        sums = self._read("ledger", _LEDGER).groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs > 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of everything committed; groups without documents are left out."""
        sums = self._read("rollup", _ROLLUP).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs > 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False, with nothing changed, if a batch of that name is in already.

        ``changes`` has ``op, doc_id, source, lang, tokenizer, tokens``. Deletions and revisions act on what earlier
        batches left of (doc_id, tokenizer), under whatever source and language it was counted; insertions come on top.
        Every inserted row counts, also when repeated or without id, source or language. Of several revisions of one
        document the largest count holds; a document both deleted and revised is deleted. Changes of unknown documents,
        or without an id, do nothing, and null tokens count as 0. An empty batch is recorded and changes nothing.
        """
        if batch in self.committed():
            return False
        changes = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "tokenizer", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))
        inserted = changes.where("op = 'insert'").select(*_KEYS, F.lit(1).cast("long").alias("docs"), "tokens")
        edits = changes.where("op IN ('delete', 'revise')").groupBy("doc_id", "tokenizer").agg(
            F.bool_or(F.col("op") == "delete").alias("gone"), F.max(F.when(F.col("op") == "revise", F.col("tokens"))).alias("new"))
        signed = inserted
        if self.committed():
            # Only what the edits name is read from the ledger's rows and added up.
            edits = materialize(edits, "edits")
            size = edits.agg(F.count("*").alias("n"), F.sum(F.octet_length("tokenizer")).alias("bytes")).first()
            side = small_side(edits, size["n"] * 96 + (size["bytes"] or 0), 1)
            old = self._read("ledger", _LEDGER).join(side, ["doc_id", "tokenizer"]).groupBy(*_KEYS).agg(
                F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.first("gone").alias("gone"), F.first("new").alias("new")).where("docs > 0")
            signed = signed.unionByName(old.select(
                *_KEYS, F.when(F.col("gone"), -F.col("docs")).otherwise(F.lit(0)).cast("long").alias("docs"),
                F.when(F.col("gone"), -F.col("tokens")).otherwise(F.col("new") * F.col("docs") - F.col("tokens")).cast("long").alias("tokens")))

        trial = f"{self.path}/trials/{uuid.uuid4().hex}"
        sums = [F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")]
        signed.groupBy(*_KEYS).agg(*sums).write.parquet(f"{trial}/ledger")
        self.spark.read.schema(_LEDGER).parquet(f"{trial}/ledger").groupBy("source", "lang", "tokenizer").agg(*sums).write.parquet(f"{trial}/rollup")
        if self._publish(trial, f"{self.path}/batches/{batch}"):
            return True
        drop_path(self.spark, trial)
        return False

    def _publish(self, trial: str, final: str) -> bool:
        """Rename, unless the name is taken, which a rename that never overwrites decides even between two writers."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        source, target = self._hadoop(trial), self._hadoop(final)
        files = source.getFileSystem(conf)
        files.mkdirs(target.getParent())
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        context = self._fs.FileContext.getFileContext(files.makeQualified(source).toUri(), conf)
        try:
            context.rename(files.makeQualified(source), files.makeQualified(target), plain)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True
