"""What holds at an instant is met once, however many intervals hold it."""

import random

from netloom.operators import derive, joins


def test_pieces_meet_a_point_once_with_the_earliest_start(spark):
    r = random.Random(3)
    ends = [(r.choice("ab"), low := r.choice([None, r.randrange(300)]), r.choice([None, (low or 0) + r.randrange(-2, 90)])) for _ in range(60)] + [("c", 5, 9), ("c", 5, 7), ("c", 7, 12), ("c", 20, 30)]
    ends = [e for e in ends if e[0] == "c" or r.random() < 0.9]
    pieces = joins.earliest_pieces(spark.createDataFrame(ends, "k string, low long, high long"), ["k"], low="low", high="high").collect()
    far = 1 << 60
    for k in "abc":
        for t in range(-5, 400):
            met = [p.low for p in pieces if p.k == k and (p["_from"] is None or p["_from"] <= t) and (p["_until"] is None or p["_until"] >= t)]
            held = [low for key, low, high in ends if key == k and (-far if low is None else low) <= t <= (far if high is None else high)]
            assert len(met) == bool(held)
            assert not held or met[0] == (None if None in held else min(held))


def test_values_held_are_counted_without_pairs(spark):
    r = random.Random(5)
    leases = []
    for _ in range(400):
        low = r.choice([None, *(r.randrange(-100, 900) for _ in range(4))])
        leases.append((r.choice(["a", "b", None]), r.choice("vwxyz") if r.random() < 0.9 else None, low, r.choice([None, *((low or 0) + r.randrange(-3, 40) for _ in range(6))])))
    leases = [x for x in leases if x[0] != "b" or x[2] is not None and x[3] is not None]
    asked = [(i, r.choice(["a", "b", "c", None]), r.choice([None, *range(-150, 1000)])) for i in range(500)]
    points = spark.createDataFrame(asked, "id long, k string, at long")
    held = spark.createDataFrame(leases, "k string, v string, low long, high long")
    got = joins.values_held(points, held, at="at", low="low", high="high", on=["k"], value="v", width=50).collect()
    want = {}
    for i, k, t in asked:
        there = [v for key, v, low, high in leases if k is not None and t is not None and key == k and (low is None or low <= t) and (high is None or t <= high)]
        if there:
            known = {v for v in there if v is not None}
            want[i] = (len(known), min(known) if len(known) == 1 else None)
    assert len(got) == len(want) and {x.id: (x["values"], x.v) for x in got} == want
    assert {n for n, _ in want.values()} >= {1, 2}


def test_repeated_answers_are_one_name(spark):
    records = spark.createDataFrame([("cache", "s1", "A", "203.0.2.1", "203.0.2.1", i, 1000 + i) for i in range(200)], "held_in string, owner_name string, rrtype string, value string, address string, covered_from_at long, covered_until_at long")
    points = spark.createDataFrame([(1, 500, "203.0.2.1"), (2, 1100, "203.0.2.1"), (3, 1200, "203.0.2.1")], "origin long, at long, dst_address string")
    assert sorted((x.origin, x.name, x.covered_from) for x in derive.names_held(points, records).collect()) == [(1, "s1", 0), (2, "s1", 100)]
