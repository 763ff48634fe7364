"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch is a set of changes per (doc_id, version): ``insert``, ``revise`` (a new
count, source or language) or ``delete``. The ledger holds the last state of
each (doc_id, version); joined with it, a batch becomes signed rows: minus what
the document contributed, plus what it contributes now. Their sums per
(source, lang, version) are the batch's delta, and totals are the sum of the
deltas of all committed batches. Totals are never recounted from the documents.

Commits are idempotent: a batch writes its ledger and delta to folders named
after its id, replacing whatever an interrupted try has left, and then its
commit record. Readers use committed batches only, and a batch whose record
exists is not applied again.

Defined cases: null sources, languages and counts are kept as null groups and 0
tokens; null or unknown operations and null doc_ids are left out; several
changes of one key in a batch: the last by ``seq`` counts, then the largest
count; deleting an unknown document changes nothing, inserting a known one
revises it, revising an unknown one inserts it; an empty batch commits an empty
delta. A hot source is summed in each task before its rows are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.sources.work import drop, exists, stored
from clicktrail.llm.textops import NON_SPACE, Words, chunks
from clicktrail.llm.tokens import bpe_encoder

KEYS = ["source", "lang", "version"]
STATE = "doc_id long, source string, lang string, version string, n_tokens long, live boolean, batch_no long"
DELTA = "source string, lang string, version string, d_docs long, d_tokens long"


class TokenRollup:
    """The rollup kept in ``folder``: ``ledger``, ``deltas`` and ``commits``, one sub-folder per batch each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, kind: str, schema: str, batches: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def committed(self) -> list[str]:
        """Ids of the committed batches in order; compaction keeps the list short."""
        if not exists(self.spark, f"{self.folder}/commits"):
            return []
        rows = self.spark.read.schema("batch string, batch_no long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits")
        return [r.batch for r in rows.orderBy("batch_no").collect()]

    def state(self, batches: list[str] | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The last state of each (doc_id, version), deleted ones included (``live`` false); of those in ``touched`` alone, if given,
        which are looked up before anything is grouped."""
        ledger = self._read("ledger", STATE, self.committed() if batches is None else batches)
        if touched is not None:
            keys = touched.select(F.col("doc_id").alias("t_doc"), F.col("version").alias("t_version"))
            ledger = ledger.join(keys, F.expr("doc_id = t_doc and version <=> t_version"), "left_semi")
        last = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "batch_no")
        return ledger.groupBy("doc_id", "version").agg(last.alias("s")).select("doc_id", "version", "s.*")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits the changes ``doc_id, op, source, lang, version, n_tokens, seq``; False if the batch was committed before."""
        before = self.committed()
        if batch in before:
            return False
        last = F.max_by(F.struct("op", "source", "lang", "n_tokens"), F.struct("seq", F.coalesce("n_tokens", F.lit(0))))
        clean = (
            changes.where(F.col("op").isin("insert", "revise", "delete") & F.col("doc_id").isNotNull())
            .groupBy("doc_id", "version")
            .agg(last.alias("c"))
            .select("doc_id", "c.source", "c.lang", "version", F.coalesce(F.col("c.n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), (F.col("c.op") != "delete").alias("live"))
            .withColumn("batch_no", F.lit(len(before)).cast("long"))
        )
        entry = stored(clean, f"{self.folder}/ledger/{batch}")
        now = entry.where("live").select(*KEYS, F.lit(1).alias("sign"), "n_tokens")
        if before:
            gone = self.state(before, entry).where("live").select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")
            now = now.unionByName(gone)
        signed = now.groupBy(*KEYS).agg(F.sum("sign").alias("d_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("d_tokens"))
        signed.where("d_docs != 0 or d_tokens != 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        record = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(len(before)).cast("long").alias("batch_no"))
        record.write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of all committed batches; groups without documents are gone."""
        deltas = self._read("deltas", DELTA, self.committed())
        sums = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def compact(self, folder: str) -> TokenRollup:
        """The same state and totals as one committed batch in a new folder."""
        done = self.committed()
        new = TokenRollup(self.spark, folder)
        self.state(done).withColumn("batch_no", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{folder}/ledger/compacted")
        self.totals().selectExpr(*KEYS, "n_docs as d_docs", "n_tokens as d_tokens").write.mode("overwrite").parquet(f"{folder}/deltas/compacted")
        record = self.spark.range(1).selectExpr("'compacted' as batch", "0L as batch_no")
        record.write.mode("overwrite").parquet(f"{folder}/commits/compacted")
        return new

    def forget(self) -> None:
        """Deletes the rollup's folder."""
        drop(self.spark, self.folder)


def _counts(batches, ranks_file):
    encode = bpe_encoder(ranks_file)
    for batch, texts in chunks(batches):
        words = Words(texts, NON_SPACE)
        spaces = [t.count(b" ") + 1 if t else 0 for t in texts]
        bpe = [len(encode(t.decode())) for t in texts]
        yield pa.RecordBatch.from_pydict(
            {
                **{c: batch.column(c) for c in ("doc_id", "source", "lang")},
                "space_pieces": pa.array(spaces, pa.int64()),
                "words": pa.array(words.count, pa.int64()),
                "byte_bpe_50k": pa.array(bpe, pa.int64()),
                "text_hash": pa.array(_text_hashes(texts), pa.string()),
            }
        )


def _text_hashes(texts: list[bytes]) -> list[str]:
    import xxhash

    return [xxhash.xxh3_128_hexdigest(t) for t in texts]


def count_tokens(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """Counts of every whole text under three counters, with a 128-bit hash of the text."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    schema = "doc_id long, source string, lang string, space_pieces long, words long, byte_bpe_50k long, text_hash string"
    return source.mapInArrow(lambda it: _counts(it, ranks_file), schema)
