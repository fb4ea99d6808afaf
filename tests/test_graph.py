import random

import pytest

from tidemark.operators import graph, graph_state
from tidemark.session import work_path

NODE = "identifier string, a_factor int, c_factor int, deleted timestamp_ntz"
EDGE = "node_to string, node_from string, edge_type_id string, deleted timestamp_ntz"
TYPE = "edge_type_id string, name string, factor int"


def walk(nodes, edges, weights, depth=10):
    """Every walk from every live node, as sums by (root, node) and level."""
    live = {n: f for n, f, dead in nodes if not dead}
    out = {}
    for n, f in live.items():
        out.setdefault(n, {})
        for t, origin, kind, dead in edges:
            if t == n and not dead and origin in live:
                out[n].setdefault(origin, []).append(live[origin] * weights.get(kind, 75) // 100)
    result = {}
    for root, own in live.items():
        level = {root: own}
        best, fewest = {root: own}, {root: 0}
        for step in range(1, depth + 1):
            following = {}
            for node, acc in level.items():
                for origin, gains in out[node].items():
                    total = min(255, acc + max(gains))
                    following[origin] = max(following.get(origin, -1), total)
            level = following
            for node, acc in level.items():
                best[node] = max(best.get(node, -1), acc)
                fewest.setdefault(node, step)
        result[root] = {n: (best[n], fewest[n]) for n in best}
    return result


def frames(spark, nodes, edges, weights):
    import datetime as dt

    stamp = lambda dead: dt.datetime(2024, 1, 1) if dead else None
    return (
        spark.createDataFrame([(n, f, f // 2, stamp(d)) for n, f, d in nodes], NODE),
        spark.createDataFrame([(t, o, k, stamp(d)) for t, o, k, d in edges], EDGE),
        spark.createDataFrame([(k, k, w) for k, w in weights.items()], TYPE),
    )


CASES = {
    "cycle": ([("a", 10, 0), ("b", 20, 0), ("c", 30, 0)], [("a", "b", None, 0), ("b", "c", "full", 0), ("c", "a", "half", 0)]),
    "cap": ([("a", 200, 0), ("b", 255, 0)], [("a", "b", "full", 0), ("b", "a", "full", 0)]),
    "dead ends": (
        [("a", 1, 0), ("gone", 99, 1), ("c", 5, 0), ("d", 7, 0)],
        [("a", "gone", "full", 0), ("gone", "d", "full", 0), ("a", "c", "full", 1), ("d", "missing", "full", 0)],
    ),
    "long chain": ([(f"n{i:02}", 1 + i % 3, 0) for i in range(14)], [(f"n{i:02}", f"n{i + 1:02}", "full", 0) for i in range(13)]),
    "parallel edges": ([("a", 1, 0), ("b", 100, 0)], [("a", "b", "half", 0), ("a", "b", "full", 0), ("a", "b", None, 0)]),
    "self loop": ([("a", 9, 0)], [("a", "a", "half", 0)]),
}
WEIGHTS = {"full": 100, "half": 50, "none": 0}


@pytest.mark.parametrize(("case", "early_stop"), [*((c, False) for c in CASES), ("cycle", True), ("long chain", True)])
def test_inherited_factor(spark, case, early_stop):
    nodes, edges = CASES[case]
    want = {root: max(acc for acc, _ in reach.values()) for root, reach in walk(nodes, edges, WEIGHTS).items()}
    want |= {n: 0 for n, _, dead in nodes if dead}
    got = graph.inherited_factor(*frames(spark, nodes, edges, WEIGHTS), early_stop=early_stop)
    assert {r.identifier: r.inherited for r in got.collect()} == want


def random_graph(seed):
    """A third of all edges end in one hub."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    nodes = [(n, rng.randrange(40), rng.random() < 0.1) for n in names]
    edges = []
    for _ in range(70):
        origin = "n0" if rng.random() < 0.34 else rng.choice(names)
        edges.append((rng.choice(names), origin, rng.choice([None, *WEIGHTS]), rng.random() < 0.1))
    return nodes, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_match_brute_force(spark, seed):
    nodes, edges = random_graph(seed)
    want = walk(nodes, edges, WEIGHTS)
    tables = frames(spark, nodes, edges, WEIGHTS)
    inherited = {r.identifier: r.inherited for r in graph.inherited_factor(*tables).collect()}
    assert inherited == {n: max(a for a, _ in want[n].values()) if n in want else 0 for n, _, _ in nodes}
    reached = {(r.root, r.node): (r.accumulated, r.depth) for r in graph.reachable(*tables, tables[0]).collect()}
    assert reached == {(root, n): v for root, reach in want.items() for n, v in reach.items()}
    own = {n: f for n, f, _ in nodes}
    assert all(own[n] <= v <= 255 for n, v in inherited.items() if n in want)


def test_both_factors_and_depth(spark):
    nodes, edges = CASES["cycle"]
    tables = frames(spark, nodes, edges, WEIGHTS)
    both = {r.identifier: (r.a_factor_inherited, r.c_factor_inherited) for r in graph.with_inherited(*tables).collect()}
    for at, col in enumerate(["a_factor", "c_factor"]):
        single = {r.identifier: r.inherited for r in graph.inherited_factor(*tables, col=col).collect()}
        assert {n: v[at] for n, v in both.items()} == single
    one_step = {r.identifier: r.inherited for r in graph.inherited_factor(*tables, depth=1).collect()}
    assert one_step == {"a": 25, "b": 50, "c": 35}


def test_reach_from_given_roots(spark):
    nodes, edges = CASES["cycle"]
    roots = spark.createDataFrame([("b",), ("b",), ("unknown",)], "identifier string")
    got = graph.reachable(*frames(spark, nodes, edges, WEIGHTS), roots, depth=1).collect()
    assert sorted((r.root, r.node, r.factor, r.accumulated, r.depth) for r in got) == [("b", "b", 20, 20, 0), ("b", "c", 30, 50, 1)]


def test_no_edges(spark):
    nodes, _ = CASES["cycle"]
    tables = frames(spark, nodes, [], WEIGHTS)
    assert {r.identifier: r.inherited for r in graph.inherited_factor(*tables).collect()} == {"a": 10, "b": 20, "c": 30}
    assert graph.reachable(*tables, tables[0]).count() == 3


def state_of(spark, nodes, edges, parts=4, **more):
    more = {"cols": ["a_factor", "c_factor"]} | more
    return graph_state.create_state(*frames(spark, nodes, edges, WEIGHTS), work_path(spark, "graph"), parts, **more)


def once(edges):
    """Edges by identity, which live if any of their rows does."""
    out = {}
    for x, y, kind, dead in edges:
        out[x, y, kind] = out.get((x, y, kind), True) and bool(dead)
    return out


def after(nodes, edges, new_nodes, new_edges):
    rows = {n: (n, f, d) for n, f, d in [*nodes, *new_nodes]}
    ids = once(edges) | once(new_edges)
    return list(rows.values()), [(*k, dead) for k, dead in ids.items()]


def both(spark, state, nodes, edges, depth=10):
    for at, col in enumerate(state.cols):
        reach = walk([(n, (f, f // 2)[at], d) for n, f, d in nodes], edges, WEIGHTS, depth)
        want = {n: 0 if d else max(acc for acc, _ in reach[n].values()) for n, _, d in nodes}
        assert {r.identifier: r.inherited for r in graph_state.inherited(state, col).collect()} == want


def test_updates_equal_brute_force(spark, seed=3, depth=4):
    rng = random.Random(seed)
    nodes, edges = random_graph(seed)
    state = state_of(spark, nodes, edges, parts=2, depth=depth)
    both(spark, state, nodes, edges, depth)
    for k in range(2):
        names = [n for n, *_ in nodes]
        new_nodes = [(rng.choice(names), rng.randrange(90), rng.random() < 0.3) for _ in range(2)]
        new_nodes = list({n: (n, f, d) for n, f, d in [*new_nodes, (f"new{seed}{k}", 80, 0)]}.values())
        new_edges = [(*e[:3], 1) for e in rng.sample(edges, 3)]
        new_edges += [(rng.choice(names), rng.choice([*names, f"new{seed}{k}", "unknown"]), rng.choice([None, "full"]), 0) for _ in range(3)]
        changed = frames(spark, new_nodes, new_edges, WEIGHTS)
        state = graph_state.update_inherited(state, *changed, f"batch {k}")
        nodes, edges = after(nodes, edges, new_nodes, new_edges)
        both(spark, state, nodes, edges, depth)


def chains(n, length):
    """Chains of nodes that have nothing to do with one another."""
    nodes = [(f"c{i}_{k}", 1 + (i + k) % 5, 0) for i in range(n) for k in range(length)]
    return nodes, [(f"c{i}_{k}", f"c{i}_{k + 1}", "full", 0) for i in range(n) for k in range(length - 1)]


def test_an_update_opens_no_part_without_touched_nodes(spark, monkeypatch):
    nodes, edges = chains(8, 11)
    state = state_of(spark, nodes, edges, parts=64)
    opened = set()
    read = type(state.nodes).read

    def watched(table, files=None):
        if files is not None:
            opened.update((table.path, f) for f in files)
        return read(table, files)

    monkeypatch.setattr(type(state.nodes), "read", watched)
    changed = frames(spark, [("c3_5", 90, 0)], [("c3_1", "c3_2", "full", 1)], WEIGHTS)
    following = graph_state.update_inherited(state, *changed, "one")
    monkeypatch.undo()
    # Parts of the one chain: its 11 nodes lie in at most 11 of the parts.
    assert len({f for path, f in opened if path == state.nodes.path}) <= 11 < len(state.nodes.files())
    kept = set(state.nodes.files()) & set(following.nodes.files())
    assert len(kept) >= len(state.nodes.files()) - 11
    both(spark, following, *after(nodes, edges, [("c3_5", 90, 0)], [("c3_1", "c3_2", "full", 1)]))


def test_a_batch_that_broke_off_is_finished_and_then_not_applied_again(spark, monkeypatch):
    nodes, edges = CASES["long chain"]
    state = state_of(spark, nodes, edges, parts=2, depth=3)
    new_nodes, new_edges = [("n09", 77, 0)], [("n02", "n03", "full", 1), ("n02", "n09", "half", 0)]
    changed = frames(spark, new_nodes, new_edges, WEIGHTS)

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(graph_state, "merge_upsert", fail)
    with pytest.raises(RuntimeError):
        graph_state.update_inherited(state, *changed, "b")
    monkeypatch.undo()
    again = graph_state.open_state(spark, state.nodes.path.rpartition("/")[0])
    assert (again.out.version, again.nodes.version) == (1, 0)
    done = graph_state.update_inherited(again, *changed, "b")
    both(spark, done, *after(nodes, edges, new_nodes, new_edges), depth=3)
    repeated = graph_state.update_inherited(done, *changed, "b")
    assert repeated.nodes.files() == done.nodes.files()


def test_a_state_without_edges_and_a_shorter_depth(spark):
    state = state_of(spark, [("a", 10, 0), ("b", 20, 0)], [], depth=1, cols=["a_factor"])
    changed = frames(spark, [], [("a", "b", "full", 0), ("b", "a", None, 0)], WEIGHTS)
    state = graph_state.update_inherited(state, *changed, "b")
    assert {r.identifier: r.inherited for r in graph_state.inherited(state, "a_factor").collect()} == {"a": 30, "b": 27}


def test_nodes_that_no_arc_enters_take_no_part_in_the_levels(spark, monkeypatch):
    nodes = [("hub", 10, 0), ("top", 20, 0), *[(f"leaf{i}", i, 0) for i in range(6)]]
    edges = [("hub", "top", "full", 0), *[(f"leaf{i}", "hub", "full", 0) for i in range(6)]]
    walked = []
    best = graph_state._best

    def watched(steps, cols):
        walked.extend(r.x for r in steps.select("x").collect())
        return best(steps, cols)

    monkeypatch.setattr(graph_state, "_best", watched)
    state = state_of(spark, nodes, edges, parts=1, depth=3)
    changed = frames(spark, [("top", 50, 0)], [], WEIGHTS)
    state = graph_state.update_inherited(state, *changed, "b")
    assert set(walked) == {"hub"}
    both(spark, state, *after(nodes, edges, [("top", 50, 0)], []), depth=3)
