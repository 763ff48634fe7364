"""Filter audit against a plain one: awkward rows, retractions across files, restarts."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktrail.llm import audit
from clicktrail.sources import work

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return {f for f, failed in tests.items() if failed}


def plain(rows, labels):
    """(part, order, step) -> the seven numbers, each order applied to each row."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    out = defaultdict(Counter)
    for d, t, source in rows:
        own = fails(t or "") | ({"E"} if d is not None and least[t or ""] < d else set())
        for order in itertools.permutations("ABCDE"):
            name, gone = "".join(order), False
            for step, f in enumerate(order, 1):
                c = out[source or "", name, step]
                here = f in own and not gone
                c["redundant"] += f in own and gone
                gone = gone or here
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += own == {f}
                c["good_lost"] += here and d in good
                c["toxic_lost"] += here and d in toxic
    share = Counter()
    for (part, name, step), c in out.items():
        share[part, name[step - 1]] += c["removed"]
    for (part, name, step), c in out.items():
        c["shapley"] = share[part, name[step - 1]]
    return {k: [c[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for k, c in out.items()}


def reported(counts):
    got = audit.report(counts).collect()
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in got}


def write(spark, folder, files, mode="append"):
    """One Parquet file per list of rows, with extra columns of clashing names."""
    for rows in files:
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        frame.withColumns({"mask": F.lit("x"), "n": F.lit(1.5), "part": F.lit(7)}).coalesce(1).write.mode(mode).parquet(folder)


def texts(rng):
    words = [f"w{i}" for i in range(90)]
    long = [" ".join(rng.sample(words, 60)) for _ in range(6)]
    odd = [None, "", " \t\n", "A B C", "x # y", "é" * 30, "ÀÉ LOUD Words " * 20, "a\x1cb\x85c " * 60, " ".join(["same"] * 70), "one | two " * 40, "Tail " * 90_000]
    return long + odd


def make(seed, n=400):
    rng = random.Random(seed)
    pool = texts(rng)
    rows = [(i, rng.choice(pool), rng.choice(["a", "b", None, "", "é"])) for i in rng.sample(range(-50, 5000), n)]
    rows += [(None, pool[0], "a"), (None, pool[0], "b"), rows[0], rows[0], (rows[1][0], rows[1][1], "other"), (rows[2][0], "another text", "a")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rng.sample(rows[:n], n // 2)]
    return rows, [*labels, labels[0], (labels[1][0], 1, 0), (None, 1, 1), (10**9, 1, 1)]


def test_audit_retracts_over_files(spark, tmp_path):
    """Files in falling order of ids: every micro-batch brings smaller ids of texts that are counted already."""
    rows, labels = make(1)
    rows.sort(key=lambda r: -(r[0] or 0))
    write(spark, f"{tmp_path}/d", [rows[i : i + 60] for i in range(0, len(rows), 60)])
    marks = spark.createDataFrame(labels, LABELS)
    folder = work.work_folder(spark, "t")
    counts = audit.stream_counts(spark, f"{tmp_path}/d", marks, batches=4, texts_per_key=3, folder=folder)
    assert reported(counts) == plain(rows, labels)
    assert spark.read.schema(audit.DELTA).parquet(f"{folder}/deltas").where("n < 0").count() > 0
    assert len([f for f in work.children(spark, f"{folder}/progress/commits") if f.isdigit()]) >= 4


def test_audit_goes_on_after_a_stop(spark, tmp_path):
    rows, labels = make(2)
    marks = spark.createDataFrame(labels, LABELS)
    folder = work.work_folder(spark, "t")
    write(spark, f"{tmp_path}/d", [rows[300:]])
    audit.stream_counts(spark, f"{tmp_path}/d", marks, texts_per_key=10, folder=folder)
    write(spark, f"{tmp_path}/d", [rows[150:300], rows[:150]])
    counts = audit.stream_counts(spark, f"{tmp_path}/d", marks, texts_per_key=10, folder=folder)
    assert reported(counts) == plain(rows, labels)


def test_audit_single_file_and_empty(spark, tmp_path):
    marks = spark.createDataFrame([], LABELS)
    write(spark, f"{tmp_path}/d", [[(1, "b a", "s"), (0, "b a", None)]])
    part = next(f for f in work.children(spark, f"{tmp_path}/d") if f.endswith(".parquet") and not f.startswith("."))
    assert reported(audit.stream_counts(spark, f"{tmp_path}/d/{part}", marks)) == plain([(1, "b a", "s"), (0, "b a", None)], [])
    write(spark, f"{tmp_path}/e", [[]])
    assert reported(audit.stream_counts(spark, f"{tmp_path}/e", marks)) == {}


def test_own_mask():
    for t in texts(random.Random(3)) + ["ABC" + "d" * 57, "ABC" + "d" * 56, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "\x0b\x0c\r" * 9]:
        mask = audit.own_mask((t or "").encode())
        assert {f for k, f in enumerate("ABCD") if mask >> k & 1} == fails(t or "")


EVENT = st.tuples(st.sampled_from([b"p", b"q", b"r"]), st.integers(0, 9), st.sampled_from(["a", "b"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(EVENT, max_size=8), max_size=6))
def test_settled_counts_do_not_depend_on_batches(batches):
    columns = ["digest", "doc_id", *audit.COUNTS, "n"]
    frame = lambda rows: pd.DataFrame([(d, i, p, 1, 0, 0, 1) for d, i, p in rows], columns=columns)
    held, total = frame([]), Counter()
    for rows in batches:
        if rows:
            held, signed = audit.settle(held, frame(rows))
            for r in signed.itertuples():
                total[r.part, r.mask] += r.n
    every = [e for rows in batches for e in rows]
    least = {d: min(i for x, i, _ in every if x == d) for d, _, _ in every}
    want = Counter((p, 1 | (audit.REPEATED if i > least[d] else 0)) for d, i, p in every)
    assert +total == want and not -total


@pytest.mark.parametrize("store", [audit.ROCKSDB, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_audit_state_stores(spark, tmp_path, store):
    rows, labels = make(4, 60)
    write(spark, f"{tmp_path}/d", [rows[:30], rows[30:]])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    counts = audit.stream_counts(spark, f"{tmp_path}/d", spark.createDataFrame(labels, LABELS), state_store=store)
    assert reported(counts) == plain(rows, labels)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
