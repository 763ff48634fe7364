"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

Two dictionaries are trained, one on texts labelled good and one on texts
labelled bad. A document is compressed whole with each of them and without any;
the sizes, divided by the text's length, say how well it is explained by good
and by bad text and how repetitive it is by itself. A logistic calibration of
the normalised difference (bad minus good) and of these sizes, weighted back
to the labels' shares, gives the score.

Fitting takes bounded samples of the labelled training rows, chosen by a hash
of doc_id: ``dict_rows`` of each label for the dictionaries and, apart from
them, ``fit_rows`` of each label for the calibration. Scoring reads every whole
text once.

Defined cases: null or empty texts get the score of sizes 0; null labels are
not learnt from, a repeated label counts as its largest; without rows of both
labels every score is the share of good rows (0 without rows); repeated
documents give one row each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.linear import fit_logistic, sigmoid
from clicktrail.llm.textops import chunks

DICT_BYTES = 64 << 10
DICT_ROWS = 1200
FIT_ROWS = 3000
LEVEL = 3
FEATURES = 7


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    intercept: float
    level: int = LEVEL


class Sizes:
    """Compressors of one worker: sizes of a text with the good, with the bad and without a dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        made = []
        for d in (good, bad):
            shared = zstandard.ZstdCompressionDict(d)
            shared.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False))
        made.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False))
        self.compress = [m.compress for m in made]

    def features(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([[len(c(t)) if t else 0 for c in self.compress] for t in texts], float).reshape(-1, 3)
        n = np.fromiter(map(len, texts), float, len(texts))
        length = np.maximum(n, 1)
        good, bad, plain = (sizes / length[:, None]).T
        diff = (sizes[:, 1] - sizes[:, 0]) / np.maximum(sizes.max(axis=1), 1)
        log_n = np.log1p(n) / 10
        return np.stack([diff, good, bad, plain, log_n, diff * log_n, plain * log_n], axis=1)


def _train(texts: list[bytes]) -> bytes:
    """A dictionary of the texts; if they are too few or too alike to train one, their own beginning serves as it is."""
    if len(texts) >= 16:
        try:
            return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # the trainer's word for too little material
            pass
    return b"".join(texts)[:DICT_BYTES] or b" " * 8


def _sample(docs, labels, label, training, per_class, part):
    """At most ``per_class`` labelled documents per label from one of the two disjoint halves of the training rows."""
    rows = labels.where(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == part)
    some = None
    for value in (0, 1):
        few = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class)
        some = few if some is None else some.unionByName(few)
    # at most 2 * per_class rows of two numbers: a fixed bound for the broadcast
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")


def _size_rows(batches, good, bad, level):
    sizes = None
    for batch, texts in chunks(batches):
        sizes = sizes or Sizes(good, bad, level)
        yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "features": pa.array(list(sizes.features(texts)), pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", training: Column | None = None, dict_rows: int = DICT_ROWS, fit_rows: int = FIT_ROWS, level: int = LEVEL) -> QualityModel:
    """Learns from labelled rows of ``training`` (a condition on ``labels``' rows; all when None)."""
    training = F.lit(True) if training is None else training
    seen = _sample(docs, labels, label, training, dict_rows, 0).select("label", "text").toArrow()
    texts = [(y, t.encode()) for y, t in zip(seen.column("label").to_pylist(), seen.column("text").to_pylist())]
    good, bad = _train([t for y, t in texts if y == 1]), _train([t for y, t in texts if y == 0])
    sizes = _sample(docs, labels, label, training, fit_rows, 1).mapInArrow(lambda it: _size_rows(it, good, bad, level), "label int, features array<double>").toArrow()
    y = sizes.column("label").to_numpy()
    totals = {r[0]: r[1] for r in labels.where(training & F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    if len(set(y.tolist())) < 2 or 0 not in totals or 1 not in totals:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return QualityModel(good, bad, np.zeros(FEATURES), 35.0 if share == 1 else -35.0 if share == 0 else float(np.log(share / (1 - share))), level)
    x = np.array(sizes.column("features").to_pylist())
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w, b = fit_logistic((x - mean) / spread, y, weight, l2=0.01, steps=3000)
    return QualityModel(good, bad, w / spread, float(b - (w * mean / spread).sum()), level)


def _scores(batches, model: QualityModel):
    sizes = None
    for batch, texts in chunks(batches):
        sizes = sizes or Sizes(model.good, model.bad, model.level)
        z = sizes.features(texts) @ model.weights + model.intercept
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(sigmoid(z), pa.float64())})


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: better) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES each
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: _scores(it, shared.value), "doc_id long, score double")
