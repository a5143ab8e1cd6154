"""Shuffled totals outgrow their compressed size tenfold in memory, so few megabytes are put together."""

from reelspark.session import configure


def test_partitions_are_put_together_to_sixteen_megabytes_at_most(spark):
    value = configure(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert value.endswith("m") and int(value[:-1]) <= 16


def test_pieces_of_files_are_bounded(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "128m")
        assert configure(spark).conf.get(name) == f"{16 << 20}b"
        spark.conf.set(name, "1m")
        assert configure(spark).conf.get(name) == f"{1 << 20}b"
    finally:
        spark.conf.set(name, before)
