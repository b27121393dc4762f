"""The same rows whatever the number of shuffle partitions and the splits of the input."""

import pytest

from millrace.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts, split in (("3", "128m"), ("13", "4k")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            seen.append(sorted(map(str, catalog.QUERIES[name](spark, FOLDER).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]
