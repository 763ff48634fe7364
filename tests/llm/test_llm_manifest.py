"""Merkle manifest against a plain one: awkward rows, ties, deep trees, many sources."""

import hashlib
import random
import zlib
from collections import defaultdict

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from clicktrail.llm import manifest
from clicktrail.llm.queries import QUERIES
from clicktrail.sources import work

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def join(hashes):
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def leaf(row):
    return brute.sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(hashes):
    """(top, per leaf the (before, after) of each level)."""
    paths, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, a in enumerate(at):
            run, slot = runs[a // 16], a % 16
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = a // 16
        level = [join(r) for r in runs]
    return level[0], paths


def plain(rows):
    """Rows as the query gives them."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: (sorted(v, key=lambda x: x[:3]), tree([x[2] for x in sorted(v, key=lambda x: x[:3])])) for s, v in by.items()}
    root, tops = tree([grown[s][1][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        leaves, (subroot, paths) = grown[s]
        for (_, _, h, r), path in zip(leaves, paths):
            steps = path + top
            now = h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                now = leaf(dict(r, text=brute.lower(r["text"])))
            for before, after in steps:
                now = join([before, now, after])
            out.append((r["doc_id"], h, subroot, root, join(a + b for a, b in steps), now, now == root))
    return sorted(out, key=str)


def check(spark, tmp_path, rows):
    frame = spark.createDataFrame([tuple(r[c] for c in FIELDS) + ("x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, k string, leaf int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def row(doc_id, source="s", text="Some Text", lang="en", n_chars=9):
    return {"doc_id": doc_id, "source": source, "lang": lang, "n_chars": n_chars, "text": text}


def test_manifest_awkward_rows(spark, tmp_path):
    rng = random.Random(3)
    ids = rng.sample(range(-(2**40), 2**62), 300) + [-(2**63), 2**63 - 1, 0, 1, 63, 64, 4095, 4096] + list(range(5000, 5400))
    rows = [row(i, rng.choice(["a", "b", None, "", "é", "Z"]), f"Text {i}" * (i % 5)) for i in ids]
    rows += [row(7, "lone"), row(8, "a", None, None, None), row(9, "a", ""), row(10, "b", "LONG Text é " * 20000)]
    check(spark, tmp_path, rows)


def test_manifest_ties(spark, tmp_path):
    """Null and repeated doc_ids, with one text and with several, equal rows among them."""
    rows = [row(None, "a", f"T{i % 40}") for i in range(90)] + [row(5, "a", f"U{i % 3}") for i in range(70)]
    rows += [row(6, "a", "same")] * 40 + [row(i, "a") for i in range(20)] + [row(None, None, None, None, None)] * 20
    check(spark, tmp_path, rows)


def test_manifest_many_sources(spark, tmp_path):
    check(spark, tmp_path, [row(i, f"source{i % 330}", f"T {i}") for i in range(700)])


@pytest.mark.parametrize("count", [1, 16, 17, 257])
def test_manifest_sizes(spark, tmp_path, count):
    check(spark, tmp_path, [row(i * 3) for i in range(count)])


def test_manifest_empty(spark):
    docs = spark.createDataFrame([], brute.DOCS)
    assert manifest.manifest(docs).count() == 0


def test_ranks_cross_directory_blocks(spark):
    """Ids in different containers, blocks of 2^20 containers and blocks of those."""
    ids = [b * (1 << 52) + m * (1 << 32) + c * 4096 + i for b in (-3, 0, 2) for m in (0, 1, 9) for c in (0, 7, 1 << 19) for i in (0, 64, 4095)]
    rows = spark.createDataFrame([("g", i) for i in ids] + [("h", 5)], "g string, v long")
    got, ties = manifest.ranked(rows, "g", F.col("v"), work.work_folder(spark, "t"))
    assert not ties
    want = {v: (k, 1, len(ids)) for k, v in enumerate(sorted(ids))}
    assert {r.v: (r["at"], r["same"], r["n"]) for r in got.where("g = 'g'").collect()} == want
