"""Graph jobs, the throttle and frames against brute force."""

import datetime as dt
import heapq
import math
import random

import pytest

from punctuo.operators import network as N
from punctuo.operators import replays as R

NODE, EDGE, POINT = "node string, lat double, lon double", "a string, b string, km double", "point long, lat double, lon double"


def far(a, b):
    (la1, lo1), (la2, lo2) = a, b
    h = math.sin(math.radians(la2 - la1) / 2) ** 2 + math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def flat(a, b):
    return math.hypot((b[1] - a[1]) * 67.0, (b[0] - a[0]) * 111.0)


@pytest.mark.parametrize("kind", ["britain", "globe", "one", "poles"])
def test_nearest_node(spark, kind):
    rng = random.Random(kind)
    place = {
        "britain": lambda: (rng.uniform(50, 59), rng.uniform(-6, 2)), "globe": lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180)),
        "one": lambda: (51.0, 0.1), "poles": lambda: (rng.choice([-89.9, 89.99, 90.0]), rng.uniform(-180, 180)),
    }[kind]
    nodes = {f"n{i:03}": place() for i in range(40)}
    points = {i: (rng.uniform(-90, 90), rng.uniform(-180, 180)) if i % 3 else place() for i in range(120)} | {500: (0.0, 180.0), 501: (0.0, -180.0)}
    got = N.nearest_node(spark.createDataFrame([(i, *p) for i, p in points.items()] + [(900, None, 1.0)], POINT), spark.createDataFrame([(n, *p) for n, p in nodes.items()] + [("x", None, None)], NODE))
    found = {r["point"]: (r["node"], r["km"]) for r in got.collect()}
    assert set(found) == set(points)
    for i, p in points.items():
        best = min(far(q, p) for q in nodes.values())
        assert found[i][1] == pytest.approx(best, abs=1e-6) and far(nodes[found[i][0]], p) == pytest.approx(best, abs=1e-6)


def test_nearest_of_no_nodes(spark):
    assert N.nearest_node(spark.createDataFrame([(1, 1.0, 1.0)], POINT), spark.createDataFrame([], NODE)).count() == 0
    assert N.nearest_node(spark.createDataFrame([], POINT), spark.createDataFrame([("a", 1.0, 1.0)], NODE)).count() == 0


def graph(seed, n=30, near=60.0):
    rng = random.Random(seed)
    nodes = {f"n{i:02}": (rng.uniform(51, 53), rng.uniform(-2, 1)) for i in range(n)}
    names = sorted(nodes)
    edges = [(a, b, flat(nodes[a], nodes[b])) for i, a in enumerate(names) for b in names[i + 1 :] if flat(nodes[a], nodes[b]) < near]
    return nodes, edges


def dijkstra(edges, start, limit=math.inf, without=None, under=math.inf):
    ways = {}
    for a, b, w in edges:
        if (a, b) != without and w < under:
            ways.setdefault(a, []).append((b, w))
            ways.setdefault(b, []).append((a, w))
    best, heap = {}, [(0.0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in ways.get(x, []):
                if d + w <= limit:
                    heapq.heappush(heap, (d + w, y))
    return best


def test_shortest_paths(spark):
    nodes, edges = graph(5)
    edges = [e for e in edges if "n07" not in e[:2]]
    hops = [(a, b) for a in list(nodes)[:8] for b in list(nodes)[::4]] + [("n00", "n07"), ("n07", "n07"), ("n00", "zz"), (None, "n01"), ("n00", "n04"), ("n00", "n04")]
    rows = N.shortest_paths(spark.createDataFrame(edges + [("n00", "n00", 0.0), ("n01", "n00", 999.0)], EDGE), spark.createDataFrame(hops, "start string, stop string")).collect()
    found = {(r["start"], r["stop"]): r for r in rows}
    lengths = {frozenset(e[:2]): e[2] for e in edges}
    want = {(a, b): dijkstra(edges, a)[b] for a, b in set(hops) if a and b in dijkstra(edges, a)}
    assert len(rows) == len(found) and set(found) == set(want)
    for (a, b), km in want.items():
        path = found[a, b]["path"]
        assert found[a, b]["km"] == pytest.approx(km) and (path[0], path[-1]) == (a, b)
        assert sum(lengths[frozenset(p)] for p in zip(path, path[1:])) == pytest.approx(km)


def test_redundant_edges_go_and_the_network_holds(spark):
    nodes, edges = graph(9, 24, 90.0)
    kept = N.without_redundant(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(n, *p) for n, p in nodes.items()], NODE)).collect()
    got = {(r["a"], r["b"]) for r in kept}
    want = {(a, b) for a, b, w in edges if dijkstra(edges, a, w * 1.4, (a, b), w).get(b) is None}
    assert got == want and 0 < len(got) < len(edges)
    left = [e for e in edges if e[:2] in got]
    assert all(set(dijkstra(left, n)) == set(dijkstra(edges, n)) for n in nodes)


def test_routes_follow_the_network(spark):
    nodes = spark.createDataFrame([("a", 51.0, 0.0), ("b", 51.1, 0.0), ("c", 51.2, 0.0), ("z", 53.0, 1.0)], NODE)
    edges = spark.createDataFrame([("a", "b", 11.1), ("b", "c", 11.1)], EDGE)
    routes = [(1, 3, 51.0, 0.001), (1, 5, 51.001, 0.0), (1, 9, 51.2, 0.0), (1, 11, 53.0, 1.0), (2, 0, 51.0, 0.0), (2, 1, 51.002, 0.0), (3, 0, 51.1, 0.0), (4, 0, 51.2, 0.0), (4, 1, 51.0, 0.0), (4, 2, 51.2, 0.0)]
    got = {}
    for r in N.snapped(spark.createDataFrame(routes, "route int, seq int, lat double, lon double"), nodes, edges).orderBy("route", "seq").collect():
        got.setdefault(r["route"], []).append((r["seq"], r["lat"], r["lon"]))
    assert got == {
        1: [(0, 51.0, 0.0), (1, 51.1, 0.0), (2, 51.2, 0.0), (3, 53.0, 1.0)], 2: [(0, 51.0, 0.0), (1, 51.002, 0.0)], 3: [(0, 51.1, 0.0)],
        4: [(0, 51.2, 0.0), (1, 51.1, 0.0), (2, 51.0, 0.0), (3, 51.1, 0.0), (4, 51.2, 0.0)],
    }


def test_throttle_depends_on_the_last_kept_reading(spark):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows, t = [], {k: 0 for k in "ab"}
    for i in range(1500):
        k = rng.choice("aaab")
        t[k] += rng.choice([0, 5, 20, 60, 299, 300, 301])
        rows.append((i, k, rng.randrange(4), start + dt.timedelta(seconds=t[k])))
    want, last = set(), {}
    for i, k, d, at in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        if k not in last or abs(d - last[k][0]) >= 2 or (at - last[k][1]).total_seconds() >= 300:
            want.add(i)
            last[k] = d, at
    df = spark.createDataFrame(rows, "obs_id int, uid string, delay_mins int, recorded_at timestamp")
    assert {r["obs_id"] for r in R.throttled(df.repartition(5), ["uid"]).collect()} == want and 0 < len(want) < 1500
    assert R.throttled(df, ["uid"]).columns == df.columns


def test_frames(spark):
    rows = spark.createDataFrame([("g", i, f"r{i}") for i in range(4)] + [("h", 0, "x")], "g string, k int, rid string")
    got = {}
    for r in R.frames(rows, ["g"], ["k"], 2, 3).orderBy("frame", "side", "place").collect():
        got.setdefault((r["g"], r["frame"]), {}).setdefault(r["side"], []).append(r["rid"])
    assert [got["g", i] for i in range(5)] == [
        {"tracking": ["r0", "r1"]}, {"settled": ["r0"], "tracking": ["r1", "r2"]}, {"settled": ["r1", "r0"], "tracking": ["r2", "r3"]},
        {"settled": ["r2", "r1", "r0"], "tracking": ["r3"]}, {"settled": ["r3", "r2", "r1"]},
    ]
    assert {k: v for k, v in got.items() if k[0] == "h"} == {("h", 0): {"tracking": ["x"]}, ("h", 1): {"settled": ["x"]}}
