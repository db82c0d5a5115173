"""Pointer jumping and components against plain walks."""

import random

from strandline.llm import paths


def test_resolve(make):
    r = random.Random(5)
    parent = {i: (None if i % 10 == 0 else r.randrange(i)) for i in range(1, 60)} | {0: None, 100: 999, 101: 100, 200: 201, 201: 200, 202: 201, 300: 300} | {i: i - 1 for i in range(401, 440)} | {400: None}
    nodes = make("id long, parent long, w long", *[{"id": i, "parent": p, "w": i} for i, p in parent.items()])
    for row in paths.resolve(nodes, ["w"]).collect():
        seen, at = [], parent[row["id"]]
        while at is not None and at in parent and at not in seen and len(seen) < 500:
            seen.append(at)
            at = parent[at]
        if at is None:
            assert (row["state"], row["root"], row["depth"], row["before_w"]) == ("ok", seen[-1] if seen else row["id"], len(seen), sum(seen))
        elif at not in parent:
            assert (row["state"], row["root"]) == ("orphan", at)
        else:
            assert (row["state"], row["root"]) == ("cycle", None)
    assert paths.resolve(nodes.limit(0)).collect() == []


def test_components(make):
    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for i in [*range(200), *range(300, 341)]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = paths.components(make("id long", *[{"id": i} for i in root]), make("a long, b long", *[{"a": a, "b": b} for a, b in edges]))
    assert {x["id"]: x["root"] for x in got.collect()} == {i: top(i) for i in root}


def test_root_to_leaf(make):
    r = random.Random(7)
    parent = {0: None, 50: None, 60: 99, 70: 71, 71: 70} | {i: r.randrange(i) for i in range(1, 40)} | {i: i - 1 for i in range(51, 59)}
    nodes = make("id long, parent long, depth long, state string", *[{"id": i, "parent": p} for i, p in parent.items()]).select("id", "parent")
    want = set()
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None and at in parent and len(path) < 100:
            path.append(at)
            at = parent[at]
        if at is None and len(path) > 1:
            want |= {(leaf, i, x) for i, x in enumerate(path[::-1])}
    got = paths.root_to_leaf(nodes, paths.resolve(nodes)).collect()
    assert len(got) == len(want) and {(x["leaf"], x["place"], x["id"]) for x in got} == want
    assert paths.root_to_leaf(nodes.limit(0), paths.resolve(nodes.limit(0))).collect() == []
