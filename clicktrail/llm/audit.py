"""Filter interaction audit: what each filter removes, in every order of the filters, from one pass over the files.

The files of a table are processed as available-now micro-batches of a
streaming query. A task turns each text into a mask of the conditions that it
fails by itself and a 128-bit digest. That a text repeats one of a smaller
doc_id can only be known once all files are read, so it is state: per digest,
the smallest doc_id seen and what its row was counted under. A row that comes
later, or with a larger id, fails the condition at once; when a smaller id
arrives, the counter of the former smallest is retracted (-1 under its mask)
and put under the mask with the condition added. Counters are the sums of these
signed rows per part and mask; the report of all orders is made from them.

The state is keyed by the first bits of the digest: a state value holds the
about ``TEXTS_PER_KEY`` digests that share them, so a task handles a few arrays
instead of one Python call per text. The number of keys is set from the number
of rows, so a value stays that small. Before the shuffle each task reduces the
rows of one digest to its smallest id and counts of the others, which are
certain to fail; a text that a third of all rows share reaches its key as one
row per input batch. Counters and progress are in the shared folder, so a
lost executor costs a task and a lost driver at most a micro-batch.

The session's state store holds the state. Spark's default keeps it in the
executors' memory, some 60 bytes a text, with its checkpoints in the shared folder;
``state_store=ROCKSDB`` keeps it on their disks instead, at a fixed cost of
about 4 MB of local disk for each state partition.

Defined cases: null texts are empty; a null source is the part ''; rows with a
null doc_id repeat nothing and nothing repeats them; equal rows (one doc_id,
one text) do not repeat each other; of several label rows of a doc_id any 1
counts; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from clicktrail.llm.textops import chunks
from clicktrail.sources.work import _file_system, exists, stored, work_folder

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
TEXTS_PER_KEY = 2000
BATCHES = 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"  # fixed values: the signs of filter D


def own_mask(text: bytes) -> int:
    """The conditions A to D that a UTF-8 text fails, one bit each. ``bytes.split`` cuts at the six ASCII white-space bytes."""
    words = text.split()
    code_points = len(text.translate(None, _CONTINUED))
    upper = len(text.translate(None, _NOT_UPPER))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * upper > 5 * code_points) << 2
        | (len(text.translate(None, _SIGNS)) != len(text)) << 3
    )


MASKED = "doc_id long, part string, digest binary, mask int"


def _masked(batches):
    for batch, texts in chunks(batches):
        masks = [own_mask(t) for t in texts]
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        columns = [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask"])


# what goes to a key: candidates for the smallest id (with a digest) and rows whose mask is known (without)
REDUCED = "bucket long, digest binary, doc_id long, part string, mask int, good int, toxic int, n long"
COUNTS = ["part", "mask", "good", "toxic"]


def _reduced(batches, buckets: int):
    """The rows of each input batch, one per digest and part; later ids of a digest are counted as repeats already."""
    for k, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        rows = batch.to_pandas(types_mapper=pd.ArrowDtype)
        known = rows["doc_id"].isna()
        least = rows.groupby("digest", dropna=False)["doc_id"].transform("min")
        later = ~known & (rows["doc_id"] > least)
        rows["mask"] = np.where(later.fillna(False), rows["mask"] | REPEATED, rows["mask"]).astype("int32")
        settled = (known | later).fillna(False).to_numpy(bool)
        sure = rows[settled].groupby(COUNTS, dropna=False, as_index=False).size().rename(columns={"size": "n"})
        open_ = rows[~settled].groupby(["digest", "doc_id", *COUNTS], dropna=False, as_index=False).size().rename(columns={"size": "n"})
        bucket = [int.from_bytes(d[:8], "big") % buckets for d in open_["digest"]]
        spread = (k * 7919 + np.arange(len(sure))) % buckets  # counts may be added up at any key
        for frame, to in ((open_, bucket), (sure, spread)):
            if len(frame):
                yield _batch(frame, to)


def _batch(frame: pd.DataFrame, bucket) -> pa.RecordBatch:
    n = len(frame)
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    names = ["digest", "doc_id", *COUNTS, "n"]
    columns = [pa.array(bucket, pa.int64())]
    for name, kind in zip(names, kinds):
        columns.append(pa.array(frame[name].tolist(), kind) if name in frame else pa.nulls(n, kind))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *names])


DELTA = "part string, mask int, good int, toxic int, n long"


def settle(held: pd.DataFrame, arrived: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(state after, signed counts): ``held`` and ``arrived`` are rows of ``digest, doc_id``, the counted columns and ``n``.

    Arrived rows are counted under their mask; whatever is not at the smallest id of its digest counts as a repeat: held
    rows among them are retracted from their own mask first.
    """
    both = pd.concat([held, arrived], ignore_index=True).astype({c: "int64" for c in ("doc_id", "mask", "good", "toxic", "n")})
    old = np.arange(len(both)) < len(held)
    first = (both["doc_id"] == both.groupby("digest")["doc_id"].transform("min")).to_numpy()
    repeats = both[~first]
    deltas = [
        both[first & ~old],
        both[~first & old].assign(n=lambda x: -x["n"]),
        repeats.assign(mask=lambda x: x["mask"] | REPEATED),
    ]
    signed = pd.concat(deltas)[[*COUNTS, "n"]].groupby(COUNTS, as_index=False)["n"].sum()
    state = both[first].groupby(["digest", "doc_id", *COUNTS], as_index=False)["n"].sum()
    return state, signed[signed["n"] != 0]


_STATE = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def _update(key, frames, state):
    """One key's turn in a micro-batch: state values are Arrow streams of the rows at the smallest ids."""
    arrived = pd.concat(list(frames), ignore_index=True)
    known = arrived[arrived["digest"].isna()]
    arrived = arrived[arrived["digest"].notna()][_STATE.names].astype({"doc_id": "int64"})
    out = [known[[*COUNTS, "n"]]]
    if len(arrived):
        arrived["digest"] = arrived["digest"].map(bytes)
        held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else arrived.iloc[:0]
        after, signed = settle(held, arrived)
        out.append(signed)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _STATE) as writer:
            writer.write_table(pa.Table.from_pandas(after, _STATE, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
    total = pd.concat(out).groupby(COUNTS, as_index=False)["n"].sum()
    yield total.astype({"mask": "int32", "good": "int32", "toxic": "int32", "n": "int64"})


def stream_counts(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    batches: int = BATCHES,
    texts_per_key: int = TEXTS_PER_KEY,
    state_store: str | None = None,
    folder: str | None = None,
    **options: str,
) -> DataFrame:
    """``part, mask, good, toxic, n``: rows of the Parquet table at ``path`` by what they fail, from its files in about ``batches``
    micro-batches. Run again with the ``folder`` of an interrupted run, it goes on where that one stopped."""
    folder = folder or work_folder(spark, "audit")
    table = spark.read.parquet(path)
    if not exists(spark, f"{folder}/keys/_SUCCESS"):  # fixed for all runs over this folder, as the state is keyed by it
        stored(table.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / texts_per_key)).alias("keys")), f"{folder}/keys")
    buckets = spark.read.parquet(f"{folder}/keys").first()["keys"]
    location, fs = _file_system(spark, path)
    files = fs.getContentSummary(location).getFileCount()
    if fs.getFileStatus(location).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream over a single file needs a pattern
    source = (
        spark.readStream.schema(table.select("doc_id", "source", "text").schema)
        .options(maxFilesPerTrigger=max(1, math.ceil(files / batches)), **options)
        .parquet(path)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    )
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("marked")).agg(one("quality"), one("toxic")).where("marked is not null and (quality = 1 or toxic = 1)")
    marks = stored(marks.withColumnsRenamed({"quality": "good", "toxic": "bad"}), f"{folder}/marks")
    # rows without an id match nothing: a second key, 0 for all others, spreads them over the tasks (``_t`` is no literal, else the key is lost)
    masked = source.mapInArrow(_masked, MASKED).withColumn("_s", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    marks = marks.withColumn("_t", F.when(F.col("marked").isNotNull(), F.col("bad").cast("long") * 0))
    known = masked.join(marks, (F.col("doc_id") == F.col("marked")) & (F.col("_s") == F.col("_t")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    known = known.select("doc_id", "part", "digest", "mask", flag("good").alias("good"), flag("bad").alias("toxic"))
    deltas = (
        known.mapInArrow(lambda it: _reduced(it, buckets), REDUCED)
        .groupBy("bucket")
        .applyInPandasWithState(_update, DELTA, "texts binary", "append", GroupStateTimeout.NoTimeout)
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if state_store:
        spark.conf.set(provider, state_store)
    try:
        run = (
            deltas.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/deltas").option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    signed = spark.read.schema(DELTA).parquet(f"{folder}/deltas")
    return signed.groupBy(*COUNTS).agg(F.sum("n").alias("n")).where("n != 0")


# ---------------------------------------------------------------- the report

ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts by mask.

    A part's counts are one map from mask to numbers, so a report row is made of at most 32 entries and nothing is joined.
    """
    per_mask = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("_own", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"))
    before = f"aggregate(sequence(0, step - 1), 0, (a, j) -> a + if(j = 0, 0, shiftleft(1, instr('{FILTERS}', substr(filter_order, j, 1)) - 1)))"
    rows = rows.withColumn("_before", F.expr(before))
    total = lambda value, test: F.expr(f"aggregate(filter(cells, x -> {test}), 0L, (a, x) -> a + {value})")
    here = "(x.mask & _before) = 0 and (x.mask & _own) != 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("x.n", "(x.mask & (_before | _own)) = 0").alias("kept"),
        total("x.n", here).alias("removed"),
        total("x.n", "(x.mask & _before) != 0 and (x.mask & _own) != 0").alias("redundant"),
        total("x.n", "x.mask = _own").alias("unique_fails"),
        total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"),
        # of the orders of a mask's filters, each is first in an equal share
        total(f"x.n * ({math.factorial(len(FILTERS))} div bit_count(x.mask))", "(x.mask & _own) != 0").alias("shapley"),
    )
