"""Suffix-array deduplication with a logarithmic family of sorted indexes.

The unit is a string of ``LENGTH`` bytes. Suffixes are sampled by content: of
the ``LENGTH - GRAM + 1`` grams inside such a string, the one with the least
hash (the rightmost of equals) is its anchor, so equal strings anchor at the
same place and about one suffix in 35 is enough. Consecutive strings with one
anchor form a *stretch*. An index entry is a sampled suffix: the hash of its
first ``GRAM`` bytes (``fp``), the hash of its stretch (``blk``), and where the
stretch lies. Sorted by (fp, blk, age, place), entries are a sparse suffix
array in which everything that shares a gram is a run of neighbours.

A new batch is sorted by range and merge-scanned with the levels before it:

* a stretch that also stands earlier is a long match as a whole (``FULL``);
* an entry alone with its fp matches nothing (``ALONE``);
* stretches that share a gram but are not equal (``SHARED``) are compared string
  by string: their bytes, at most ``2 * LENGTH`` of them, are fetched, and every
  string that also starts earlier is a match.

Levels: a batch becomes a level of its own. Before the next one comes, levels
of the same size class are merged, so a corpus of n batches has O(log n) levels
and an entry is rewritten O(log n) times.

Hot grams and passages: repeated stretches are reduced in the task that finds
them and the repeats are dealt out by place; sorting is by range on (fp, blk),
so one gram with many contexts spans many partitions; the byte comparison of a
gram with more than ``group_entries`` stretches is dealt into parts whose first
strings meet once more, by the strings' own hashes.

"Earlier" means an earlier batch, then a smaller doc_id, then an earlier start.

Defined cases: null or empty texts have 0 bytes and nothing to remove, as have
texts below ``LENGTH`` bytes; a null doc_id counts as the smallest; rows that
repeat a doc_id are one document (a repeated row is no earlier copy of itself);
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.llm.preselect import texts_of
from clicktrail.sources.work import drop, stored
from clicktrail.llm.textops import CHUNK_BYTES, chunks, mix, prefix_hash, slice_hash

LENGTH = 100
GRAM = 32
FULL, ALONE, SHARED, CONTEXT = 0, 1, 2, 3
ENTRY = "kind byte, fp long, blk long, age int, doc long, lo long, m int"
RUN = "doc long, lo long, hi long"
_PLACE_BITS = 28
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Suffixes:
    """``block_entries``: entries that a task reduces at a time; ``group_entries``, ``part_entries``: see the module's text."""

    block_entries: int = 400_000
    group_entries: int = 100_000
    part_entries: int = 50_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def stretches(texts: list[bytes]):
    """(document index, start, number of strings, fp, blk) of every stretch of the texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = prefix_hash(raw)
    at = np.arange(len(raw) - GRAM + 1)
    gram = slice_hash(h, at, at + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # the hash decides, then the place: of equal hashes the rightmost is the least
    order = (gram & ~low) | (low - (at.astype(np.uint64) & low))
    least = _sliding_min(order, LENGTH - GRAM + 1)
    string = np.ones(len(least), np.int8)
    for b, e in zip(begins, ends):  # strings do not cross documents
        string[max(b, e - LENGTH + 1) : e] = 0
    string = np.flatnonzero(string)
    if not len(string):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = (low - (least[string] & low)).astype(np.int64)
    anchor = string + ((place - string) & int(low))
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1] + 1)])
    first = np.flatnonzero(new)
    lo, m = string[first], np.diff(np.concatenate([first, [len(string)]]))
    doc = np.searchsorted(ends, lo, side="right")
    return doc, lo - begins[doc], m, gram[anchor[first]], slice_hash(h, lo, lo + m + LENGTH - 1)


def _entry_batch(kind, fp, blk, age, doc, lo, m) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array(kind.astype(np.int8)),
            "fp": pa.array(fp.view(np.int64)),
            "blk": pa.array(blk.view(np.int64)),
            "age": pa.array(age.astype(np.int32)),
            "doc": pa.array(doc.astype(np.int64)),
            "lo": pa.array(lo.astype(np.int64)),
            "m": pa.array(m.astype(np.int32)),
        }
    )


def _sample_suffixes(batches, age: int, how: Suffixes):
    held, size = [], 0

    def reduced():
        doc, lo, m, fp, blk = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((lo, doc, blk, fp))
        doc, lo, m, fp, blk = doc[order], lo[order], m[order], fp[order], blk[order]
        kind = np.full(len(doc), ALONE)
        same = np.concatenate([[False], (fp[1:] == fp[:-1]) & (blk[1:] == blk[:-1])])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
        itself = same & (doc == doc[lead]) & (lo == lo[lead])
        kind[same] = FULL
        # a repeat needs no neighbours any more: it is dealt out by its place
        fp[same], blk[same] = mix(doc[same].astype(np.uint64) * np.uint64(31) + lo[same].astype(np.uint64)), 0
        keep = ~itself
        return _entry_batch(kind[keep], fp[keep], blk[keep], np.full(int(keep.sum()), age), doc[keep], lo[keep], m[keep])

    for batch, texts in chunks(batches, CHUNK_BYTES // 2):
        doc, lo, m, fp, blk = stretches(texts)
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        held.append((ids[doc], lo, m, fp, blk))
        size += len(doc)
        if size >= how.block_entries:
            yield reduced()
            held, size = [], 0
    if size:
        yield reduced()


def _merge_scan(batches, age: int):
    """One range partition of the sorted entries: what each entry of this age is, and older entries whose bytes are needed."""
    table = pa.Table.from_batches(list(batches), schema=_ENTRY_ARROW)
    kind, fp, blk, ages, doc, lo, m = (table.column(c).to_numpy() for c in ("kind", "fp", "blk", "age", "doc", "lo", "m"))
    kind = kind.copy()
    e = np.flatnonzero(kind != FULL)
    if len(e):
        f, b, d, s = fp[e], blk[e], doc[e], lo[e]
        same = np.concatenate([[False], (f[1:] == f[:-1]) & (b[1:] == b[:-1])])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(e))))
        itself = same & (d == d[lead]) & (s == s[lead])
        first = np.flatnonzero(~same)
        ff = f[first]
        next_same = np.concatenate([ff[1:] == ff[:-1], [True]])  # a neighbour in the next partition can't be seen: it may be there
        prev_same = np.concatenate([[True], next_same[:-1]])
        group = np.cumsum(np.concatenate([[0], ff[1:] != ff[:-1]]))
        fresh = np.bincount(group, weights=ages[e][first] == age) > 0
        fresh[[0, -1]] = True
        shared = (next_same | prev_same) & fresh[group]
        out = np.full(len(e), FULL)
        out[first] = np.where(shared, SHARED, ALONE)
        old = ages[e] != age
        out[old] = np.where(out[old] == SHARED, CONTEXT, -1)
        out[itself] = -1
        kind[e] = out
    for a in range(0, len(kind), 50_000):
        some = a + np.flatnonzero(kind[a : a + 50_000] >= 0)
        yield _entry_batch(kind[some], fp[some], blk[some], ages[some], doc[some], lo[some], m[some])


_ENTRY_ARROW = pa.schema([("kind", pa.int8()), ("fp", pa.int64()), ("blk", pa.int64()), ("age", pa.int32()), ("doc", pa.int64()), ("lo", pa.int64()), ("m", pa.int32())])


def _cut(batches):
    """The bytes of the wanted stretches, out of their documents."""
    for batch, texts in chunks(batches, 1 << 22):
        rows = {c: [] for c in ("fp", "part", "parts", "age", "doc", "lo", "m")}
        data = []
        for text, doc, wanted in zip(texts, batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist()):
            for w in wanted:
                piece = text[w["lo"] : w["lo"] + w["m"] + LENGTH - 1]
                if len(piece) == w["m"] + LENGTH - 1:
                    for c in ("fp", "part", "parts", "age", "lo", "m"):
                        rows[c].append(w[c])
                    rows["doc"].append(NO_ID if doc is None else doc)
                    data.append(piece)
        yield pa.RecordBatch.from_pydict({**{c: pa.array(rows[c], t) for c, t in _CUT_TYPES.items()}, "bytes": pa.array(data, pa.binary())})


_CUT_TYPES = {"fp": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "age": pa.int32(), "doc": pa.int64(), "lo": pa.int64(), "m": pa.int32()}
CUT = "fp long, part int, parts int, age int, doc long, lo long, m int, bytes binary"
STRING = "string long, age int, doc long, lo long, hi long, matched boolean"


def _runs(doc, lo):
    """Maximal runs of strings that start next to each other, as (doc, first byte, byte after the last)."""
    order = np.lexsort((lo, doc))
    doc, lo = doc[order], lo[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]]) if len(doc) else first
    return doc[first], lo[first], lo[last] + LENGTH


def _compare_strings(batches, age: int):
    """Strings of this age that also start earlier, as runs; first strings of grams that lie in several parts go on."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([*_CUT_TYPES.items(), ("bytes", pa.binary())]))
    if not table.num_rows:
        return
    # by age, document and place: stretches of a document do not overlap, so their strings come in this order too
    table = table.sort_by([("age", "ascending"), ("doc", "ascending"), ("lo", "ascending")])
    parts, ages, doc, lo, m = (table.column(c).to_numpy() for c in ("parts", "age", "doc", "lo", "m"))
    owner = np.repeat(np.arange(len(m), dtype=np.int32), m)
    first = np.repeat((np.cumsum(m) - m).astype(np.int32), m)
    offset = np.arange(len(owner), dtype=np.int32) - first
    del first
    string = np.empty(len(owner), np.uint64)
    filled = 0
    for batch in table.select(["bytes"]).to_batches(max_chunksize=4000):
        some = batch.column("bytes").to_pylist()
        h = prefix_hash(np.frombuffer(b"".join(some), np.uint8))
        size = np.fromiter(map(len, some), np.int64, len(some))
        n = size - LENGTH + 1
        row = np.repeat(np.cumsum(size) - size, n)
        at = row + offset[filled : filled + len(row)]
        string[filled : filled + len(row)] = slice_hash(h, at, at + LENGTH)
        filled += len(row)
    order = np.argsort(string, kind="stable").astype(np.int32)
    string, owner = string[order], owner[order]
    start = lo[owner] + offset[order]
    del order, offset
    d, g = doc[owner], ages[owner]
    same = np.concatenate([[False], string[1:] == string[:-1]])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(string))))
    matched = same & ((d != d[lead]) | (start != start[lead])) & (g == age)
    rd, rl, rh = _runs(d[matched], start[matched])
    none = pa.nulls(len(rd), pa.int64())
    yield pa.RecordBatch.from_pydict(
        {"string": none, "age": pa.array(np.full(len(rd), age), pa.int32()), "doc": pa.array(rd), "lo": pa.array(rl), "hi": pa.array(rh), "matched": pa.array(np.ones(len(rd), bool))}
    )
    going = np.flatnonzero(~same & (parts[owner] > 1))
    for a in range(0, len(going), 50_000):
        x = going[a : a + 50_000]
        yield pa.RecordBatch.from_pydict(
            {
                "string": pa.array(string[x].view(np.int64)),
                "age": pa.array(g[x], pa.int32()),
                "doc": pa.array(d[x]),
                "lo": pa.array(start[x]),
                "hi": pa.array(start[x] + LENGTH),
                "matched": pa.array(np.zeros(len(x), bool)),
            }
        )


class SuffixLevels:
    """The index family of a growing corpus in ``folder`` (in the shared checkpoint folder or any store)."""

    def __init__(self, spark: SparkSession, folder: str, how: Suffixes = Suffixes()):
        self.spark, self.folder, self.how = spark, folder, how
        #: (size class, path) of each level; class c stands for about 2 ** c first batches
        self.levels: list[tuple[int, str]] = []
        self.unit = 0
        self.age = 0

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(path).where(f"kind in ({ALONE}, {SHARED})")

    def merge_equal(self) -> None:
        """Merges levels of one size class, smallest first, until all classes differ."""
        while True:
            classes = sorted(c for c, _ in self.levels)
            twice = [c for c, d in zip(classes, classes[1:]) if c == d]
            if not twice:
                return
            paths = [p for c, p in self.levels if c == twice[0]][:2]
            path = f"{self.folder}/level-{self.age}-{twice[0] + 1}-{len(self.levels)}"
            both = self._read(paths[0]).unionByName(self._read(paths[1]))
            both.repartitionByRange("fp", "blk").sortWithinPartitions("fp", "blk", "age", "doc", "lo").write.mode("overwrite").parquet(path)
            self.levels = [(c, p) for c, p in self.levels if p not in paths] + [(twice[0] + 1, path)]
            for p in paths:
                drop(self.spark, p)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Indexes a batch (``doc_id, text``); gives its long matches with the batch itself and all batches before, as byte runs ``doc, lo, hi``.

        ``corpus`` must hold the texts of this and the earlier batches. Runs may overlap.
        """
        self.merge_equal()
        age, how = self.age, self.how
        source = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        entries = source.mapInArrow(lambda it: _sample_suffixes(it, age, how), ENTRY)
        for _, path in self.levels:
            entries = entries.unionByName(self._read(path))
        in_order = entries.repartitionByRange("fp", "blk").sortWithinPartitions("fp", "blk", "age", "doc", "lo")
        path = f"{self.folder}/level-{age}"
        scanned = stored(in_order.mapInArrow(lambda it: _merge_scan(it, age), ENTRY), path)
        own = scanned.where(f"kind in ({ALONE}, {SHARED})").count()
        self.unit = self.unit or max(1, own)
        self.levels.append((max(0, round(np.log2(max(1, own) / self.unit))), path))
        self.age += 1
        full = scanned.where(f"kind = {FULL}").select("doc", "lo", (F.col("lo") + F.col("m") + LENGTH - 1).alias("hi"))
        # written, as the level itself is dropped when it is merged
        return stored(full.unionByName(self._matched_strings(scanned, corpus, age)), f"{self.folder}/runs-{age}")

    def _matched_strings(self, scanned: DataFrame, corpus: DataFrame, age: int) -> DataFrame:
        how = self.how
        shared = scanned.where(f"kind in ({SHARED}, {CONTEXT})")
        large = shared.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > how.group_entries)
        # written by itself: the join below can then be split where a gram is hot
        sized = stored(
            large.select(F.col("fp").alias("l_fp"), F.ceil(F.col("n") / how.part_entries).cast("int").alias("l_parts")), f"{self.folder}/large-{age}"
        )
        dealt = shared.join(sized, F.col("fp") == F.col("l_fp"), "left").withColumn("parts", F.coalesce("l_parts", F.lit(1)))
        wish = F.struct("fp", F.pmod("blk", F.col("parts").cast("long")).cast("int").alias("part"), "parts", "age", "lo", "m")
        wanted = dealt.groupBy("doc").agg(F.collect_list(wish).alias("wanted"))
        ids = scanned.where(f"kind in ({SHARED}, {CONTEXT})").select(F.col("doc").alias("doc_id"))
        texts = texts_of(corpus, ids).join(wanted, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")).select("doc_id", "text", "wanted")
        pieces = max(1, -(-shared.count() // how.part_entries))
        together = texts.mapInArrow(_cut, CUT).repartition(pieces, "fp", "part")
        compared = stored(together.mapInArrow(lambda it: _compare_strings(it, age), STRING), f"{self.folder}/strings-{age}")
        matched = compared.where("matched").select("doc", "lo", "hi")
        # strings of grams in several parts: the earliest of all parts' firsts stays
        firsts = compared.where("not matched")
        least = firsts.groupBy("string").agg(F.min(F.struct("age", "doc", "lo")).alias("f"))
        later = firsts.join(least, "string").where(f"age = {age} and (f.doc != doc or f.lo != lo)")
        return matched.unionByName(later.select("doc", "lo", "hi"))


def _removed(batches):
    for batch, texts in chunks(batches, 1 << 22):
        out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, runs in zip(texts, batch.column("runs").to_pylist()):
            mark = np.zeros(len(text) + 1, np.int32)
            for r in runs:
                mark[r["lo"]] += 1
                mark[min(r["hi"], len(text))] -= 1
            gone = np.cumsum(mark)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array(out["n_spans"], pa.int64()),
                "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                "kept": pa.array(out["kept"], pa.binary()),
            }
        )


def cut_matches(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, n_spans, kept_sha256, kept`` (bytes that stay) of the documents with matched runs."""
    merged = runs.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    ids = runs.select(F.col("doc").alias("doc_id"))
    hit = texts_of(docs, ids).join(merged, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")).select("doc_id", "text", "runs")
    return hit.mapInArrow(_removed, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_report(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cut = cut_matches(docs, runs).drop("kept").dropDuplicates(["doc_id"]).withColumnsRenamed({"doc_id": "c_id", "n_removed": "c_removed", "n_spans": "c_spans"})
    return rows.join(cut, F.expr("doc_id <=> c_id"), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("c_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("c_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
