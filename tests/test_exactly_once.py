import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.bloom import GrowingBloom
from millrace.operators.exactly_once import Deliveries, event_key

SCHEMA = "n long, event_id string, owner string, task string, checksum string, at timestamp, key string"


def digest(owner, task, checksum):
    return hashlib.sha256(f"{owner}\0{task}\0{checksum}".encode()).hexdigest()


def deliveries(df, **more):
    key = event_key(*(F.col(c) for c in ("event_id", "owner", "task", "checksum")))
    return Deliveries(df, key, F.col("at"), ["n", "key"], **more)


def rows(spark):
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2026, 1, 1, h) + dt.timedelta(days=d)
    own = digest("o", "t", "c")
    data = [
        (1, own, "o", "t", "c", day(0), "x"),
        (2, None, "o", "t", "c", day(200), "x"),  # without id, in another bucket
        (3, f" \xa0{own.upper()}\n", "o", " T ", "c", day(90), None),
        (4, "bad", "o", "u", "c", day(0), "x"),
        (5, "", "o", "u", "c", None, "x"),
        (6, None, None, "u", "c", day(0), "x"),  # no identity: a message of its own
        (7, None, None, "u", "c", day(0), "x"),
        (8, digest("a", "b", "c"), "a", "b", "c", day(5), "x"),
        (9, digest("z", "b", "c"), "z", "b", "c", day(3, 4), "x"),
        (10, digest("z", "b", "c"), "z", "b", "c", day(3, 4), "x"),  # a tie
        (11, digest("r", "b", "c"), "r", "b", "c", day(9), "x"),
        (11, digest("r", "b", "c"), "r", "b", "c", day(9), "x"),  # the row itself repeated
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_repeats(spark):
    df = rows(spark)
    own = deliveries(df)
    found = Counter((r["_key"], r.n) for r in own.repeated().collect())
    t, u, z, r = digest("o", "t", "c"), digest("o", "u", "c"), digest("z", "b", "c"), digest("r", "b", "c")
    assert found == Counter([(t, 1), (t, 2), (t, 3), (u, 4), (u, 5), (z, 9), (z, 10), (r, 11), (r, 11)])
    assert sorted(x.n for x in own.once(["n"]).collect()) == [1, 5, 6, 7, 8, 9, 11]


def test_empty(spark):
    own = deliveries(rows(spark).limit(0))
    assert own.repeated().collect() == [] and own.once(["n"]).collect() == []


@pytest.mark.parametrize("shards", [1, 5])
def test_many_against_brute_force(spark, shards):
    """A hot message with a third of the rows, and others over many buckets."""
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(9000) < 1 / 3, 0, rng.integers(1, 9000, 9000))
    df = spark.createDataFrame([(i, int(k), int(rng.integers(0, 400))) for i, k in enumerate(keys)], "n long, k int, day int").repartition(6)
    own = Deliveries(df, F.sha2(F.col("k").cast("string"), 256), F.timestamp_seconds(F.col("day") * 86400), ["n"], shards=shards)
    counts = Counter(keys.tolist())
    assert sorted(r.n for r in own.repeated().collect()) == [i for i, k in enumerate(keys.tolist()) if counts[k] > 1]
    assert own.once(["n"]).count() == len(counts)
    assert own.possible.count() < 0.9 * len(keys)  # the definitely new ones were screened out


def test_bloom():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 63, 300_000).astype(np.uint64)
    bloom = GrowingBloom(capacity=1 << 16)
    bloom.add(ids[:200_000])
    assert len(bloom.filters) == 4 and bloom.may_contain(ids[:200_000]).all()
    assert bloom.may_contain(ids[200_000:]).mean() < 0.02
    assert not GrowingBloom().may_contain(ids[:5]).any()
