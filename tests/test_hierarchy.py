"""Trees against a chain-walking brute force, with every dirty case of the input."""

import random

import pytest

from lexloom.operators.hierarchy import all_descendants, hierarchy

SCHEMA = "doc string, node string, up string, at int, root string"


def run(spark, rows, with_paths=True, rest=50_000):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["doc"], r["node"]): r for r in hierarchy(df, "doc", "node", "up", "at", with_paths, rest).collect()}


def brute_force(rows):
    """Chain walking: {(scope, id): (root, depth, path) or None on a loop}."""
    parents = {(s, i): p for s, i, p in rows}
    out = {}
    for s, i in parents:
        path, cur = [i], parents[s, i]
        while cur is not None and (s, cur) in parents and cur not in path:
            path.append(cur)
            cur = parents[s, cur]
        looped = cur is not None and (s, cur) in parents
        out[s, i] = None if looped else (path[-1], len(path) - 1, path[::-1])
    return out


def all_above(rows):
    """{(scope, ancestor, descendant): distance} by walking up, loops walked once."""
    parents = {(s, i): p for s, i, p in rows}
    out = {}
    for s, i in parents:
        cur, seen = parents[s, i], {i}
        while (s, cur) in parents and cur not in seen:
            out[s, cur, i] = len(seen)
            seen.add(cur)
            cur = parents[s, cur]
    return out


@pytest.mark.parametrize("rest", [0, 12, 50_000])
def test_random_forests_match_brute_force(spark, rest):
    rng = random.Random(5)
    rows = []
    for doc in "ab":
        for i in range(1, 60):
            up = None if rng.random() < 0.1 else str(rng.randint(1, 65))
            rows.append((doc, str(i), up, 1, "clash"))
    chain = [("c", str(i), str(i - 1) if i > 1 else "", 1, None) for i in range(1, 80)]
    chain += [("e", str(i), str(i % 150 + 1), 1, None) for i in range(1, 151)] + [("e", str(200 + i), str(i), 1, None) for i in range(1, 30)]
    out = run(spark, rows + chain, rest=rest)
    plain = [(d, n, u or None) for d, n, u, _, _ in rows + chain]
    expected = brute_force(plain)
    assert out.keys() == expected.keys()
    for key, want in expected.items():
        assert out[key]["in_cycle"] == (want is None)
        if want:
            assert (out[key]["root"], out[key]["depth"], out[key]["path"]) == want
    below = {}
    for d, a, _ in all_above(plain):
        below[d, a] = below.get((d, a), 0) + 1
    assert all(r["n_descendants"] == below.get(k, 0) for k, r in out.items())
    assert {k: r["in_cycle"] for k, r in run(spark, rows + chain, False, rest).items()} == {k: w is None for k, w in expected.items()}


def test_dirty_ids_and_deliveries(spark):
    rows = [
        ("d", "#007", None, 1, ""), ("d", "8", " 7 ", 1, ""), ("d", "8", " 7 ", 2, ""), ("d", "9", "99", 1, ""),
        ("d", None, "7", 1, ""), ("d", "x", "7", 1, ""), (None, "1", "1", 1, ""), ("d", "10", "10", 1, ""), ("d", "11", "10", 1, ""),
    ]
    out = run(spark, rows)
    assert set(out) == {("d", "7"), ("d", "8"), ("d", "9"), (None, "1"), ("d", "10"), ("d", "11")}
    assert out["d", "8"]["path"] == ["7", "8"] and out["d", "9"]["depth"] == 0
    assert out[None, "1"]["in_cycle"] and out["d", "10"]["in_cycle"] and out["d", "11"]["root"] is None


def test_empty_and_without_paths(spark):
    assert run(spark, []) == {}
    assert run(spark, [("d", "1", "2", 1, ""), ("d", "2", "1", 1, "")], with_paths=False)["d", "1"]["in_cycle"]


@pytest.mark.parametrize("rest", [0, 50_000])
def test_descendants_on_and_below_loops(spark, rest):
    rng = random.Random(6)
    rows = [(d, str(i), str(rng.randint(1, 44)), 1, "") for d in "abc" for i in range(1, 41)]
    rows += [("l", str(i), str(i % 30 + 1), 1, "") for i in range(1, 31)] + [("l", "99", "7", 1, ""), ("l", "98", "99", 1, ""), (None, "1", "1", 1, ""), (None, "2", "1", 1, "")]
    got = all_descendants(spark.createDataFrame(rows, SCHEMA), "doc", "node", "up", "at", rest).collect()
    want = {(*k, n) for k, n in all_above([(d, n, u) for d, n, u, _, _ in rows]).items()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert all_descendants(spark.createDataFrame([], SCHEMA), "doc", "node", "up", "at").count() == 0
