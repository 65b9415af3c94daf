"""Review slices against a plain version, and what their edges are looked up from."""

import random

from quillmark.operators import slices


def plain(members, nodes, edges, max_nodes, max_edges):
    degree = {n: 0 for n, _ in nodes}
    for _, a, b in edges:
        for end in (a, b):
            degree[end] = degree.get(end, 0) + 1
    label, shown = dict(nodes), {}
    for slice_id in {s for s, _ in members}:
        every = sorted({n for s, n in members if s == slice_id and n in label}, key=lambda n: (-degree[n], label[n], n))
        kept = set(every[:max_nodes])
        shown[slice_id] = sorted(e for e, a, b in edges if a in kept and b in kept)[:max_edges]
    return shown


def test_slices_are_those_of_the_plain_version(spark):
    """Self-loops, parallel edges, slices whose namesake is cut off, and slices named after no node."""
    draw = random.Random(5)
    nodes = [(f"n{k:02}", f"label {k % 7}") for k in range(40)]
    edges = [(f"e{k:03}", f"n{draw.randrange(40):02}", f"n{int(draw.random() ** 2 * 40):02}") for k in range(300)]
    frame = spark.createDataFrame
    n, e = frame(nodes, "node_id string, label string"), frame(edges, "edge_id string, source string, target string")
    members = {(c, c) for c, _ in nodes[::2]} | {(c, o) for _, a, b in edges for c, o in ((a, b), (b, a)) if int(c[1:]) % 2 == 0 and a != b}
    ego = slices.ego_members(e, n.where("substring(node_id, 3, 1) IN ('0', '2', '4', '6', '8')"))
    assert {tuple(r) for r in ego.collect()} == members
    members |= {("other", f"n{k:02}") for k in range(0, 40, 3)}
    shown, rows = slices.bounded_slices(frame(sorted(members), "slice_id string, node_id string"), n, e, "ego", max_nodes=9, max_edges=6)
    got = {}
    for r in shown.collect():
        got.setdefault(r.slice_id, []).append(r.edge_id)
    want = plain(members, nodes, edges, 9, 6)
    assert {s: sorted(x) for s, x in got.items()} == {s: x for s, x in want.items() if x}
    assert {r.slice_id: r.n_edges for r in rows.collect()} == {s: len(x) for s, x in want.items()}


def test_edges_of_stars_are_not_looked_up_from_their_leaves(spark):
    """Leaves that many slices share bring none of their edges along: none runs between two of them."""
    edges = spark.createDataFrame([(f"{c}{leaf}", f"c{c}", f"x{leaf}") for c in range(20) for leaf in range(20)], "edge_id string, source string, target string")
    kept = spark.createDataFrame([(f"c{c}", n) for c in range(20) for n in (f"c{c}", *[f"x{leaf}" for leaf in range(20)])], "slice_id string, node_id string")
    assert slices._between(edges, kept.where("slice_id <> node_id")).count() == 0
    assert slices._own(edges, kept).count() == 400
