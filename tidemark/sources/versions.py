"""Tables in versions: each is written aside, checked by figures of that same pass, and counts from one rename on.

A version that fails a gate is removed and the one before it stays the newest.
Readers may name the version they mean, so that a stream's replayed epoch can
read what it read before; ``prune`` removes old ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import ingest


class GateError(ValueError):
    """A table that was not published; ``gates`` are (name, rows counted, whether it passed)."""

    def __init__(self, gates: list[tuple[str, int, bool]]) -> None:
        super().__init__(", ".join(f"{name}: {value}" for name, value, passed in gates if not passed))
        self.gates = gates


def numbers(spark: SparkSession, path: str) -> list[int]:
    """All versions, the newest last."""
    fs, p = ingest._fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version, the newest if none is named."""
    if version is None:
        found = numbers(spark, path)
        if not found:
            raise FileNotFoundError(f"{path} has no version")
        version = found[-1]
    return spark.read.parquet(f"{path}/v={version}")


def observed(df: DataFrame, gates: Mapping[str, tuple[Column, int]], seen: Observation) -> DataFrame:
    """df, whose rows of each condition are counted by whatever action reads it."""
    return df.observe(seen, *[F.count_if(condition).alias(name) for name, (condition, _) in gates.items()]) if gates else df


def publish(df: DataFrame, path: str, gates: Mapping[str, tuple[Column, int]] | None = None, inputs: Sequence[str] = (), partition_by: Sequence[str] = ()) -> list[tuple[str, int, bool]]:
    """Write the next version; (name, rows counted, passed) of each gate.

    A gate is a condition and the number of rows that must meet it at least.
    ``inputs`` are paths that must name files before anything is written.
    Counts are taken after the last shuffle, by tasks that count once each.
    """
    spark, gates = df.sparkSession, gates or {}
    if gone := ingest.missing(spark, list(inputs)):
        raise FileNotFoundError(", ".join(gone))
    aside, seen = f"{path}/_writing-{uuid.uuid4().hex}", Observation()
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    w = observed(rows, gates, seen).write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(aside)
    got = seen.get if gates else {}
    results = [(name, int(got.get(name) or 0), int(got.get(name) or 0) >= least) for name, (_, least) in gates.items()]
    fs, p = ingest._fs(spark, aside)
    if not all(passed for _, _, passed in results):
        fs.delete(p, True)
        raise GateError(results)
    to = ingest._fs(spark, f"{path}/v={(numbers(spark, path) or [0])[-1] + 1}")[1]
    if fs.exists(to) or not fs.rename(p, to):
        raise OSError(f"{to} could not be written: another version may have been published meanwhile")
    return results


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all versions but the newest ``keep``; those that went."""
    old = numbers(spark, path)[: -max(1, keep)]
    for n in old:
        fs, p = ingest._fs(spark, f"{path}/v={n}")
        fs.delete(p, True)
    return old
