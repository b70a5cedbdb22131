"""Session settings the jobs are laid out for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # run-time plans: small sides are broadcast by measured size, partitions
    # that one key blows up are split, small ones are merged
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(
    builder: SparkSession.Builder, shuffle_partitions: int | None = None
) -> SparkSession.Builder:
    """Add the settings to a session builder; call ``config`` later to change one.

    ``shuffle_partitions`` is where shuffles start from before small partitions
    are merged: shuffled bytes divided by 128 MB or so, two or three times the
    cores at the least. On a cluster also set ``spark.checkpoint.dir`` to a
    folder all executors share: staged tables go there.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder
