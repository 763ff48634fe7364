"""Toxicity: a counterfactual-regularised linear classifier over hashed words and word beginnings.

A document's features are its distinct words and the first four and five bytes
of its longer words (stems of inflected words), hashed to ``1 << BITS`` slots.
The classifier is a logistic regression over the most informative slots. Every
training document has counterfactuals: where it names an identity group, each
identity term is swapped for the next one of its group; where it names none, a
term of a group chosen by its text is put into a slot between two of its words
(``mentions=True``), and that term is swapped. The squared changes of the score
from one term to the other, and from no mention to the mention, are penalised,
so that weight on the mere mention of a group is driven out.

Fitting takes a bounded sample of the labelled training rows (``per_class``
rows of each label, chosen by a hash of doc_id), in which a row counts as often
as its label has rows in the table for each one taken, so that the scores do not
follow the sample's share of toxic rows; only hashed features of the sample
reach the driver. Scoring reads every whole text once.

Defined cases: null or empty texts score as the intercept; null labels are not
learnt from, a repeated label counts as its largest; without rows of both
labels the score is the share of toxic rows (0 without rows); repeated
documents give one row each; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.linear import fit_logistic, sigmoid
from clicktrail.llm.textops import ALNUM, Words, chunks, mix, slice_hash

BITS = 20
PER_CLASS = 4000
SLOTS = 1500
CLEAR = 3.0  # standard deviations by which a slot's share must differ between the labels
STEMS = (4, 5)
PENALTY = 1.0

# Groups of identity terms that are swapped for one another, in the languages of the documents.
IDENTITY = (
    # English
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives"),
    ("disabled", "healthy"),
    ("old", "young"),
    # German
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße"),
    ("schwule", "lesben", "heteros"),
    ("einwanderer", "einheimische"),
    ("behinderte", "gesunde"),
    # French
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs"),
    ("homosexuels", "hétérosexuels"),
    ("immigrés", "natifs"),
    ("handicapés", "valides"),
    # Spanish
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos"),
    ("homosexuales", "heterosexuales"),
    ("inmigrantes", "nativos"),
    ("discapacitados", "sanos"),
)


def swap_identity(text: str, groups=IDENTITY) -> str | None:
    """The counterfactual of a text, or None if it names no group."""
    following = {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}
    if following.keys().isdisjoint(re.findall(r"\w+", text.lower())):
        return None
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, following)) + r")\b", re.IGNORECASE)
    out, n = pattern.subn(lambda m: following.get(m[0].lower(), m[0]), text)
    return out if n else None


def with_mention(text: str, groups=IDENTITY, choice: int = 0, turn: int = 0) -> str:
    """The text with one identity term in a slot between two words; slot and term follow from the text (and ``choice``).

    ``turn``: so many terms further in the same group.
    """
    h = zlib.crc32(text.encode(), choice)
    group = groups[h % len(groups)]
    words = text.split(" ")
    at = h // 1009 % (len(words) + 1)
    return " ".join([*words[:at], group[(h // 31 + turn) % len(group)], *words[at:]])


def _slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document index, slot) of all words and stems, repeats included."""
    docs, keys = [w.doc], [w.hash]
    for n in STEMS:
        long = np.flatnonzero(w.end - w.start > n)
        docs.append(w.doc[long])
        keys.append(slice_hash(w.prefix, w.start[long], w.start[long] + n) + np.uint64(n))
    key = mix(np.concatenate(keys))
    return np.concatenate(docs), (key >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(text: bytes) -> np.ndarray:
    return np.unique(_slots(Words([text], ALNUM))[1]).astype(np.int32)


def _sample_features(batches, groups, mentions: bool):
    """Slots of a row, those that its counterfactual loses and gains, and those that the mention itself has brought."""
    for batch, texts in chunks(batches):
        own, lost, gained, brought = [], [], [], []
        for t in texts:
            text, plain = t.decode(), _distinct(t)
            named, other = plain, swap_identity(text, groups)
            if other is None and mentions and groups:
                named, other = _distinct(with_mention(text, groups).encode()), with_mention(text, groups, turn=1)
            swapped = None if other is None else _distinct(other.encode())
            own.append(plain)
            lost.append(None if swapped is None else np.setdiff1d(named, swapped))
            gained.append(None if swapped is None else np.setdiff1d(swapped, named))
            brought.append(np.setdiff1d(named, plain))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("weight"), *[pa.array(c, kind) for c in (own, lost, gained, brought)]],
            names=["label", "weight", "slots", "lost", "gained", "brought"],
        )


FEATURES = "label int, weight double, slots array<int>, lost array<int>, gained array<int>, brought array<int>"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int) -> DataFrame:
    """``doc_id, text, label, weight`` of at most ``per_class`` labelled training documents of each label, by a hash of doc_id.

    ``weight`` is the number of labelled training rows that a row of its label stands for: 1 while the label is taken whole.
    """
    rows = labels.where(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    some = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class)
        part = part.withColumn("weight", F.lit(max(1.0, totals.get(value, 0) / per_class)))
        some = part if some is None else some.unionByName(part)
    # the sample has at most 2 * per_class rows of three numbers: a fixed bound for the broadcast
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None, per_class: int = PER_CLASS, penalty: float = PENALTY, groups=IDENTITY, mentions: bool = True) -> ToxicityModel:
    """Learns from labelled rows of ``training`` (a condition on ``labels``' rows; all when None).

    ``mentions``: rows that name no identity group get a counterfactual too, by a term put into them.
    """
    sample = labelled_sample(docs, labels, label, F.lit(True) if training is None else training, per_class)
    rows = sample.mapInArrow(lambda it: _sample_features(it, groups, mentions), FEATURES).toArrow()
    y, weight = rows.column("label").to_numpy(), rows.column("weight").to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(weights, 35.0 if share == 1 else -35.0)
    # combine_chunks keeps one flat array of slots and the bounds of each row; rows are taken some hundred at a time
    slots = rows.column("slots").combine_chunks()
    bounds, flat = slots.offsets.to_numpy(), slots.flatten().to_numpy()

    def parts(step=500):
        for i in range(0, len(y), step):
            j = min(i + step, len(y))
            yield np.repeat(np.arange(i, j), np.diff(bounds[i : j + 1])), flat[bounds[i] : bounds[j]]

    pos, neg, share = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS)
    for owner, own in parts():
        np.add.at(pos, own[y[owner] == 1], 1)
        np.add.at(neg, own[y[owner] == 0], 1)
        np.add.at(share, own, weight[owner])
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    # the slots whose presence tells the most about the label: standardised difference of shares
    share /= weight.sum()
    strength = (pos / n1 - neg / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    strength[(pos + neg) < 3] = 0
    chosen = np.argsort(-np.abs(strength), kind="stable")[:SLOTS]
    chosen = np.sort(chosen[np.abs(strength[chosen]) > CLEAR])
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), np.float32)
    for owner, own in parts():
        c = column[own]
        x[owner[c >= 0], c[c >= 0]] = 1
    del pos, neg, share, strength, slots, flat
    named = np.flatnonzero(rows.column("lost").combine_chunks().is_valid().to_numpy(zero_copy_only=False))
    pairs = None
    if len(named):
        lists = {c: rows.column(c).combine_chunks() for c in ("lost", "gained", "brought")}
        part = {c: [column[a[int(i)].values.to_numpy()] for i in named] for c, a in lists.items()}
        # counterfactuals differ in the slots of identity terms alone: a few of the chosen columns
        touched = np.unique(np.concatenate([c for lists in part.values() for c in lists]))
        touched = touched[touched >= 0]

        def few(lists):
            m = np.zeros((len(named), len(touched)))
            for i, c in enumerate(lists):
                m[i, np.searchsorted(touched, c[c >= 0])] = 1
            return m

        # from a term to its neighbour, and from no mention to the mention; scaled so that the mean of their squares is the weighted one
        scale = np.sqrt(weight[named] / weight[named].mean())[:, None]
        pairs = touched, np.concatenate([(few(part["lost"]) - few(part["gained"])) * scale, few(part["brought"]) * scale])
    w, b = fit_logistic(x, y, weight, l2=0.03, pairs=pairs, penalty=penalty, steps=1000)
    weights[chosen] = w
    return ToxicityModel(weights, float(b))


def _score_texts(texts: list[bytes], model: ToxicityModel) -> np.ndarray:
    doc, slot = _slots(Words(texts, ALNUM))
    used = model.weights[slot] != 0
    pair = np.unique((doc[used] << BITS) | slot[used])
    return sigmoid(np.bincount(pair >> BITS, weights=model.weights[pair & ((1 << BITS) - 1)], minlength=len(texts)) + model.intercept)


def _scores(batches, model: ToxicityModel):
    for batch, texts in chunks(batches):
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(_score_texts(texts, model), pa.float64())})


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the corpus
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: _scores(it, shared.value), "doc_id long, score double")


def _clean_rows(batches, model: ToxicityModel, limit: float):
    for batch, texts in chunks(batches):
        yield batch.filter(pa.array(_score_texts(texts, model) < limit))


def keep_clean(docs: DataFrame, model: ToxicityModel, limit: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``limit``; decided in the scan, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _clean_rows(it, shared.value, limit), docs.schema)
