"""Spark settings the library is meant to run with."""

from __future__ import annotations

# Bytes a shuffle partition should hold: well below the memory of a task, well above its start-up cost.
PARTITION_BYTES = 128 * 1024 * 1024


def settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job whose largest shuffle moves about ``shuffle_bytes`` on ``cores`` cores.

    Shuffles start with partitions of ``PARTITION_BYTES``; adaptive execution merges those that turn out small and
    splits those of hot keys in joins, so too high an estimate is harmless and too low a one makes tasks spill.
    """
    partitions = max(cores, -(-shuffle_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Building plans asks the JVM once per expression; call-site tracking would add several calls to each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
