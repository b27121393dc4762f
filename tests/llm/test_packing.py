from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.packing import best_fit_decreasing, certificate, lower_bound, pack


def fewest(sizes, capacity):
    """The least number of containers, by trying all."""
    best = [len(sizes)]

    def place(i, left):
        if len(left) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(left)
            return
        for k in {r: k for k, r in enumerate(left) if r >= sizes[i]}.values():
            place(i + 1, [*left[:k], left[k] - sizes[i], *left[k + 1 :]])
        place(i + 1, [*left, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_fit(sizes):
    array = np.array(sizes)
    where, left = best_fit_decreasing(array, 20)
    held = np.bincount(where, weights=array, minlength=len(left))
    assert (held <= 20).all() and (20 - held == left).all()
    values, counts = np.unique(array, return_counts=True)
    assert lower_bound(values, counts, 20) <= fewest(sorted(sizes, reverse=True), 20) <= len(left)


def test_bound_beats_sum():
    assert lower_bound(np.array([11]), np.array([10]), 20) == 10
    assert lower_bound(np.array([7]), np.array([9]), 20) == 5


def check(rows, sizes, capacity):
    got, load = defaultdict(list), defaultdict(int)
    for r in rows:
        got[r.item_id].append((r.part_no, r["size"]))
        if r["size"]:
            load[r.container_id] += r["size"]
        else:
            assert r.container_id is None
    assert all(v <= capacity for v in load.values())
    for key, size in sizes.items():
        parts = sorted(got[key])
        assert [n for n, _ in parts] == list(range(len(parts))) and sum(s for _, s in parts) == (size or 0)
        assert len(parts) == max(1, -(-(size or 0) // capacity))
    assert got.keys() == sizes.keys()
    return len(load)


def test_table(spark):
    rng = np.random.default_rng(5)
    sizes = {i: int(s) for i, s in enumerate(np.minimum(rng.lognormal(5, 1.2, 3000), 9000))} | {9001: None, 9002: 0, 9003: 6000, 9004: 12001, 9005: 6001}
    df = spark.createDataFrame(list(sizes.items()), "size long, container_id long")
    one = pack(df, F.col("size"), F.col("container_id"))
    n = check(one.collect(), sizes, 6000)
    row = certificate(one).first()
    assert row.containers == n and row.bound <= n <= row.bound + 1
    many = pack(df.repartition(7), F.col("size"), F.col("container_id"), items=200)
    n = check(many.collect(), sizes, 6000)
    assert n <= row.bound + 2
    again = pack(df.coalesce(1), F.col("size"), F.col("container_id"), items=200)
    assert sorted(map(str, many.collect())) == sorted(map(str, again.collect()))
    assert pack(df.limit(0), F.col("size"), F.col("container_id")).collect() == []
    over = df.where("size >= 9001 AND container_id > 0")
    twice = pack(over.unionAll(over), F.col("size"), F.col("container_id")).collect()
    assert len(twice) == 12 and sum(r["size"] for r in twice) == 2 * (6000 + 12001 + 6001)


def test_hard_sizes(spark):
    """Sizes just over a third and a half, where the sum says little."""
    sizes = {i: (2001 if i % 3 else 3001) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "k long, n long")
    n = check(pack(df, F.col("k"), F.col("n"), items=300).collect(), sizes, 6000)
    assert n <= lower_bound(np.array([2001, 3001]), np.array([2000, 1000]), 6000) + 11
