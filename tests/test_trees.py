import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clicktrail.operators import trees as TR

T0 = dt.datetime(2024, 1, 1)


def _forest(spark, nodes, ambiguity="reference"):
    """nodes: list of (node, seconds, page_key, referer_key) in one session."""
    data = [("c", "u", 0, n, T0 + dt.timedelta(seconds=s), pk, rk) for n, s, pk, rk in nodes]
    df = spark.createDataFrame(
        data,
        "client_ip string, user_agent string, session_id int, node long, ts timestamp, page_key string, referer_key string",
    )
    return TR.build_forest(df, ambiguity=ambiguity)


def _metrics(spark, nodes, **kw):
    f = _forest(spark, nodes, **kw)
    return {r.root: r.asDict() for r in TR.tree_metrics(f, ("client_ip", "user_agent", "session_id")).collect()}


def test_parent_is_latest_earlier_view(spark):
    # A viewed twice, then B linked from A: parent is the second A view
    f = _forest(spark, [(1, 0, "A", "-"), (2, 10, "A", "-"), (3, 20, "B", "A")])
    got = {r.node: (r.parent, r.root, r.depth) for r in f.collect()}
    assert got == {1: (None, 1, 0), 2: (None, 2, 0), 3: (2, 2, 1)}


def test_not_own_parent(spark):
    f = _forest(spark, [(1, 0, "A", "A")])
    assert [(r.parent, r.depth) for r in f.collect()] == [(None, 0)]


def test_chain_and_star(spark):
    chain = _metrics(spark, [(1, 0, "A", "-"), (2, 1, "B", "A"), (3, 2, "C", "B"), (4, 3, "D", "C")])[1]
    assert (chain["size"], chain["depth_max"], chain["degree_max"], chain["num_leafs"]) == (4, 3, 1, 1)
    assert chain["size_sum"] == 1 + 2 + 3 + 4 and chain["size_sq_sum"] == 16 + 9 + 4 + 1
    assert chain["depth_sum"] == 3 + 2 + 1 and chain["dfsness"] is None
    assert chain["timediff_min"] == chain["timediff_max"] == 1.0
    star = _metrics(spark, [(1, 0, "A", "-"), (2, 1, "B", "A"), (3, 5, "C", "A"), (4, 9, "D", "A")])[1]
    assert (star["size"], star["depth_max"], star["degree_max"], star["num_leafs"]) == (4, 1, 3, 3)
    assert (star["timediff_min"], star["timediff_max"], star["timediff_sum"]) == (1.0, 9.0, 15.0)
    assert star["mean_time_diff"] == 5.0 and star["dfsness"] is None


def test_single_node(spark):
    m = _metrics(spark, [(1, 0, "A", "-")])[1]
    assert m["timediff_min"] is None and m["timediff_max"] is None and m["mean_time_diff"] == 0.0


def test_dfsness_depth_first_and_breadth_first(spark):
    # root R with children A, B; A has child A1, B has child B1
    base = [(1, 0, "R", "-"), (2, 1, "A", "R"), (3, 2, "B", "R")]
    dfs = base + [(4, 3, "A1", "A"), (5, 4, "B1", "B")]  # after B: A1 (older group) then B1
    assert _metrics(spark, dfs)[1]["dfsness"] == pytest.approx(0.0)
    # go deep first: R, A, A1, B, B1
    deep = [(1, 0, "R", "-"), (2, 1, "A", "R"), (4, 2, "A1", "A"), (3, 3, "B", "R"), (5, 4, "B1", "B")]
    assert _metrics(spark, deep)[1]["dfsness"] == pytest.approx(1.0)


def _random_tree(rng, n):
    nodes = [(1, 0, "p1", "-")]
    for i in range(2, n + 1):
        parent = rng.randrange(1, i)
        nodes.append((i, i * 7 + rng.randrange(0, 5), f"p{i}", f"p{parent}"))
    return nodes


def _ancestors(nodes):
    """node -> its ancestors, nearest first: the last earlier view of the referer page, and so on up."""
    order = sorted(nodes, key=lambda x: (x[1], x[0]))
    last, up = {}, {}
    for n, _, page, referer in order:
        up[n] = [last[referer], *up[last[referer]]] if referer in last else []
        last[page] = n
    return up


def _closed_forms(nodes):
    """Metrics of each tree from the set of (ancestor, node) pairs alone."""
    ts = {n: s for n, s, _, _ in nodes}
    up = _ancestors(nodes)
    pairs = [(a, n, k + 1) for n, above in up.items() for k, a in enumerate(above)]  # (ancestor, node, distance)
    below = {n: [p for p in pairs if p[0] == n] for n in ts}
    out = {}
    for root in (n for n in ts if not up[n]):
        tree = [root, *[n for _, n, _ in below[root]]]
        edges = [(up[n][0], n) for n in tree if up[n]]
        out[root] = {
            "size": len(tree),
            "size_sum": sum(len(below[n]) + 1 for n in tree),
            "size_sq_sum": sum((len(below[n]) + 1) ** 2 for n in tree),
            "num_leafs": sum(not below[n] for n in tree),
            "depth_max": max(len(up[n]) for n in tree),
            "depth_sum": sum(max([d for _, _, d in below[n]], default=0) for n in tree),
            "degree_max": max(sum(d == 1 for _, _, d in below[n]) for n in tree),
            "degree_sum": len(edges),
            "timediff_sum": sum(ts[c] - ts[p] for p, c in edges),
        }
    return out


def _walk(nodes):
    """dfsness of each tree, straight from its definition: sets of waiting nodes and of open sibling groups."""
    ts = {n: s for n, s, _, _ in nodes}
    up = _ancestors(nodes)
    out = {}
    for root in (n for n in ts if not up[n]):
        place = {}  # visit positions so far
        waiting, positions = {root}, []
        while waiting:
            first = lambda n: (ts[n], place.get(up[n][0], -1) if up[n] else -1, n)
            v = min(waiting, key=first)
            opened = sorted({place[up[w][0]] for w in waiting if up[w]})
            if len(opened) > 1:
                positions.append(opened.index(place[up[v][0]]) / (len(opened) - 1))
            place[v] = len(place)
            waiting = (waiting - {v}) | {n for n in ts if up[n][:1] == [v]}
        out[root] = sum(positions) / len(positions) if positions else None
    return out


def _same(got, want):
    return got is None if want is None else got == pytest.approx(want)


def test_metrics_match_the_closed_forms(spark):
    rng = random.Random(11)
    for n in (2, 9, 30):
        nodes = _random_tree(rng, n)
        got, want = _metrics(spark, nodes), _closed_forms(nodes)
        assert set(got) == set(want)
        for root, w in want.items():
            assert {k: got[root][k] for k in w} == pytest.approx(w)


def test_dfsness_with_tied_timestamps(spark):
    """Random trees whose times fall on few seconds, also several generations on one, against the definition."""
    rng = random.Random(31)
    nodes = []
    for t in range(25):
        size = rng.randrange(4, 26)
        s = 0
        for i in range(1, size + 1):
            s += rng.choice([0, 0, 1]) if t % 2 else rng.choice([0, 1, 2, 3])
            parent = rng.randrange(1, i) if i > 1 else None
            nodes.append((t * 1000 + i, t * 100_000 + s, f"t{t}p{i}", f"t{t}p{parent}" if parent else "-"))
    got, want = _metrics(spark, nodes), _walk(nodes)
    assert set(got) == set(want) and sum(v is not None for v in want.values()) > 10
    assert all(_same(got[r]["dfsness"], v) for r, v in want.items())


def test_long_session(spark):
    """One session of 6,000 requests: a chain of 5,000 and a bush; nothing depends on its size."""
    chain = [(i, i, f"c{i}", f"c{i - 1}" if i else "-") for i in range(5000)]
    bush = [(10_000 + i, 20_000 + i, f"b{i}", f"b{(i - 1) // 3}" if i else "-") for i in range(1000)]
    got = _metrics(spark, chain + bush)
    assert got[0]["depth_max"] == 4999 and got[0]["size_sum"] == 5000 * 5001 // 2 and got[0]["dfsness"] is None
    want = _closed_forms(bush)[10_000]
    assert {k: got[10_000][k] for k in want} == pytest.approx(want)
    assert got[10_000]["dfsness"] == pytest.approx(_walk(bush)[10_000])


def test_intended_ambiguity(spark):
    nodes = [(1, 0, "A", "-"), (2, 1, "A", "-"), (3, 2, "B", "A")]
    ref = _metrics(spark, nodes)
    assert all(m["ambiguous_sum"] == 0 for m in ref.values())
    intended = _metrics(spark, nodes, ambiguity="intended")
    assert sum(m["ambiguous_sum"] for m in intended.values()) == 1


def test_path_and_null_group_keys(spark):
    data = [(None, "u", 0, n, T0 + dt.timedelta(seconds=n), f"p{n}", f"p{n - 1}") for n in range(1, 10)]
    df = spark.createDataFrame(
        data,
        "client_ip string, user_agent string, session_id int, node long, ts timestamp, page_key string, referer_key string",
    )
    got = {r.node: (r.root, r.depth, list(r.path)) for r in TR.build_forest(df, path=True).collect()}
    assert got == {n: (1, n - 1, list(range(1, n + 1))) for n in range(1, 10)}


def test_parents_across_time_buckets(spark):
    # page A at 0 s, referrals at 30 min, 3 h and 3 h + 1 s (another A view in between at 2 h)
    nodes = [(1, 0, "A", "-"), (2, 1800, "B", "A"), (3, 7200, "A", "-"), (4, 10800, "C", "A"), (5, 10801, "D", "A")]
    data = [("c", "u", 0, n, T0 + dt.timedelta(seconds=s), pk, rk) for n, s, pk, rk in nodes]
    df = spark.createDataFrame(
        data,
        "client_ip string, user_agent string, session_id int, node long, ts timestamp, page_key string, referer_key string",
    )
    from clicktrail.operators.asof import assign_parents

    for minutes in (1, 60, 100_000):
        got = {r.node: r.parent for r in assign_parents(df, ["client_ip", "user_agent", "session_id"], bucket_minutes=minutes).collect()}
        assert got == {1: None, 2: 1, 3: None, 4: 3, 5: 3}
    amb = {r.node: r.parent_ambiguous for r in assign_parents(
        df, ["client_ip", "user_agent", "session_id"], ambiguity="intended", bucket_minutes=1).collect()}
    assert amb == {1: False, 2: False, 3: False, 4: True, 5: True}


def test_pick_tree_one_whole_tree_per_session(spark):
    # two sessions, each a forest of three trees
    nodes = []
    for sess in (0, 1):
        for t in range(3):
            nodes += [(sess, 100 * sess + 10 * t + i, 10 * t + i, f"s{sess}t{t}p{i}", f"s{sess}t{t}p{i - 1}" if i else "-")
                      for i in range(t + 2)]
    data = [("c", "u", s, n, T0 + dt.timedelta(seconds=sec), pk, rk) for s, n, sec, pk, rk in nodes]
    df = spark.createDataFrame(
        data,
        "client_ip string, user_agent string, session_id int, node long, ts timestamp, page_key string, referer_key string",
    )
    key = ["client_ip", "user_agent", "session_id"]
    f = TR.build_forest(df, key)
    picked = TR.pick_tree(f, key, "seed").collect()
    again = TR.pick_tree(f.repartition(3), key, "seed").collect()
    assert sorted(r.node for r in picked) == sorted(r.node for r in again)
    by_session = {}
    for r in picked:
        by_session.setdefault(r.session_id, set()).add(r.root)
    assert all(len(roots) == 1 for roots in by_session.values()) and set(by_session) == {0, 1}
    sizes = {r.root: r.size for r in TR.tree_metrics(f, key, with_dfsness=False).collect()}
    for s, roots in by_session.items():
        (root,) = roots
        assert sum(1 for r in picked if r.root == root) == sizes[root]


def test_blocks_of_nested_keys():
    """Neighbouring keys differ as Spark groups them: by their structs' and lists' contents, NULL and NaN equal to themselves."""
    import pyarrow as pa

    from clicktrail.operators import blocks

    pairs = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    kind = pa.struct([("ip", pa.string()), ("geo", pairs), ("x", pa.float64())])
    a, b = [{"key": "tz", "value": "UTC"}], [{"key": "tz", "value": None}]
    keys = [("i", a, 1.0), ("i", a, 1.0), ("i", b, 1.0), ("i", b, 1.0), ("i", a + b, 1.0), ("i", [], 1.0), ("i", [], 1.0),
            ("i", None, 1.0), ("i", None, 1.0), ("j", None, 1.0), ("j", None, float("nan")), ("j", None, float("nan")),
            (None, b, None), (None, b, None), (None, a, None)]
    rows = [dict(zip(("ip", "geo", "x"), k, strict=True)) for k in keys]
    group = pa.array([{"k0": r} for r in rows] + [{"k0": None}] * 2, pa.struct([("k0", kind)]))
    batch = pa.RecordBatch.from_arrays([group, pa.nulls(len(group), pa.int64())], names=["_g", "_b"])
    want = [2, 4, 5, 7, 9, 10, 12, 14, 15]  # the first row of each further key
    assert [int(i) + 1 for i in blocks._changes(batch).nonzero()[0]] == want
    sliced = batch.slice(3, 9)
    assert [int(i) + 4 for i in blocks._changes(sliced).nonzero()[0]] == [i for i in want if 4 <= i < 12]
    same = [blocks._same_block(batch.slice(0, i), batch.slice(i)) for i in range(1, len(group))]
    assert [i + 1 for i, s in enumerate(same) if not s] == want


def test_forest_of_nested_group_keys(spark):
    """Groups named by a struct that holds lists, as traces are, give the forest of plain keys."""
    data = [("c", g, n, T0 + dt.timedelta(seconds=n), f"p{n}", f"p{n - 1}") for n in range(4) for g in (0, 1)]
    df = spark.createDataFrame(data, "ip string, g long, node long, ts timestamp, page_key string, referer_key string")
    df = df.selectExpr("named_struct('ip', ip, 'geo', IF(g = 0, NULL, array(named_struct('key', 'g', 'value', ip)))) AS trace", "*")
    got = {(r.g, r.node): (r.parent, r.root, r.subtree) for r in TR.build_forest(df, ["trace"]).collect()}
    assert got == {(g, n): (n - 1 if n else None, 0, 4 - n) for n in range(4) for g in (0, 1)}


def test_forest_and_metrics_without_what_is_not_needed(spark):
    """Columns dropped once parents are found leave the rest as it is; further aggregates come from the metrics' own; trees
    of one root number in several groups, one of them NULL, keep their own dfsness."""
    shapes = {"a": [0, 0, 1, 2, 1], "b": [0, 0, 1, 1, 2], None: [0, 0, 1, 2, 2]}  # the page that each page links from
    data = [(g, n, T0 + dt.timedelta(seconds=10 * n), f"p{n}", f"p{up}" if n else "-", "x") for g, ups in shapes.items() for n, up in enumerate(ups)]
    df = spark.createDataFrame(data, "g string, node long, ts timestamp, page_key string, referer_key string, more string")
    whole, lean = TR.build_forest(df, ["g"]), TR.build_forest(df, ["g"], drop=("page_key", "referer_key"))
    assert [c for c in whole.columns if c not in lean.columns] == ["page_key", "referer_key"] and lean.columns[:4] == ["g", "node", "ts", "more"]
    assert sorted(map(str, whole.drop("page_key", "referer_key").collect())) == sorted(map(str, lean.collect()))
    m = {r.g: r for r in TR.tree_metrics(lean, ["g"], more={"last": F.max("node")}).collect()}
    alone = {g: TR.tree_metrics(lean.where(F.col("g").eqNullSafe(g)), ["g"]).first() for g in shapes}
    assert {g: (r.root, r.size, r.last, r.dfsness) for g, r in m.items()} == {g: (0, 5, 4, alone[g].dfsness) for g in shapes}
    assert len({r.dfsness for r in m.values()}) > 1


def test_every_request_in_exactly_one_session_and_tree(spark):
    from pyspark.sql import functions as F

    from clicktrail.operators.sessions import sessionize

    rng = random.Random(41)
    data = []
    for c in range(6):
        t = 0
        for i in range(60):
            t += rng.choice([rng.randrange(1, 600), rng.randrange(4000, 9000)])
            page = f"p{rng.randrange(8)}"
            data.append((f"c{c}", "ua", c * 1000 + i, T0 + dt.timedelta(seconds=t), page, f"p{rng.randrange(8)}"))
    df = spark.createDataFrame(
        data, "client_ip string, user_agent string, node long, ts timestamp, page_key string, referer_key string"
    )
    s = sessionize(df, gap_minutes=60)
    assert s.count() == len(data) and s.select("node").distinct().count() == len(data)
    key = ["client_ip", "user_agent", "session_id"]
    f = TR.build_forest(s, key)
    assert f.count() == len(data) and f.select("node").distinct().count() == len(data)
    m = TR.tree_metrics(f, key, with_dfsness=False)
    assert m.agg(F.sum("size")).first()[0] == len(data)
    assert m.where(F.col("degree_sum") != F.col("size") - 1).count() == 0


def test_null_keys_never_link(spark):
    nodes = [(1, 0, None, "-"), (2, 5, "B", None), (3, 9, "C", "B")]
    f = _forest(spark, nodes)
    got = {r.node: r.parent for r in f.collect()}
    assert got == {1: None, 2: None, 3: 2}


@pytest.mark.parametrize("block_rows", [1, 7, 60, 10_000])
def test_trees_over_several_blocks(spark, block_rows):
    """Trees whose paths leave and enter many blocks, ties in an hour, a chain over all hours, in two groups, with lost parents."""
    rng = random.Random(block_rows)
    data, want = [], {}
    for group in ("a", None):
        nodes = [(1, 0, "p1", "-")]
        for i in range(2, 260):
            at = nodes[-1][1] + rng.choice([0, 0, 40, 2000, 9000])
            nodes.append((i, at, f"p{i}", f"p{rng.choice([i - 1, rng.randrange(1, i)])}" if i % 50 else "-"))
        up = _ancestors(nodes)
        up[999] = [77_777]  # its parent is not among the rows
        up[1000] = [999, 77_777]
        ts = {n: s for n, s, _, _ in nodes} | {999: 10**6, 1000: 10**6 + 9000, 77_777: 5}
        for n, above in up.items():
            parent = above[0] if above else None
            data.append((group, n, T0 + dt.timedelta(seconds=ts[n]), parent, T0 + dt.timedelta(seconds=ts[parent]) if parent else None))
            below = [(m, a.index(n) + 1) for m, a in up.items() if n in a]
            tied = next((k for k, (x, y) in enumerate(zip([n, *above], above)) if ts[x] != ts[y]), len(above))
            want[group, n] = ((above or [n])[-1], len(above), sum(d == 1 for _, d in below), 1 + len(below), max([d for _, d in below], default=0), tied, [*above[::-1], n])
    edges = spark.createDataFrame(data, "g string, node long, ts timestamp, parent long, parent_ts timestamp")
    found = TR.resolve(edges, ["g"], path=True, block_rows=block_rows)
    assert found.columns == [*edges.columns, "root", "depth", "n_children", "subtree", "height", "tie_level", "path"]
    got = {(r.g, r.node): (r.root, r.depth, r.n_children, r.subtree, r.height, r.tie_level, list(r.path)) for r in found.collect()}
    assert got == want


def test_cycles_are_reported(spark):
    for rows in ([(1, 0, 2), (2, 1, 1)], [(1, 0, 2), (2, 9000, 1)]):
        data = [(n, T0 + dt.timedelta(seconds=s), p, T0) for n, s, p in rows]
        edges = spark.createDataFrame(data, "node long, ts timestamp, parent long, parent_ts timestamp")
        with pytest.raises(Exception, match="cycle"):
            TR.resolve(edges, block_rows=1).collect()


def test_running_sums_in_blocks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, i // 40, rng.randrange(-3, 9)) for i in rng.sample(range(900), 400)]
    df = spark.createDataFrame(rows, "t string, s long, hour long, v long")
    got = TR.running(df, ["t"], "hour", ["s"], {"before": F.col("v")}, {"whole": F.col("v")}).collect()
    assert len(got) == 400
    for r in got:
        assert r.before == sum(v for t, s, _, v in rows if t == r.t and s < r.s) and r.whole == sum(v for t, _, _, v in rows if t == r.t)


def test_dfsness_ties_of_many_generations(spark):
    """Two arms that tie in each of 40 generations, decided only by the trace order of their first nodes; and random arms."""
    rng = random.Random(77)
    nodes = []
    for t, arms in enumerate((2, 3, 5)):
        base = t * 10_000
        nodes.append((base, t * 10**6, f"t{t}r", "-"))
        for a in range(arms):
            for d in range(40):
                i = base + 1 + rng.randrange(1) + d * arms + (arms - 1 - a if t else a)
                twin = f"t{t}a{a}d{d}"
                nodes.append((i, t * 10**6 + (d + 1) * 50, twin, f"t{t}a{a}d{d - 1}" if d else f"t{t}r"))
                if d % 7 == a:
                    nodes.append((i + 5000, t * 10**6 + (d + 2) * 50, twin + "x", twin))
    got, want = _metrics(spark, nodes), _walk(nodes)
    assert set(got) == set(want) and all(v is not None for v in want.values())
    assert all(_same(got[r]["dfsness"], v) for r, v in want.items())
