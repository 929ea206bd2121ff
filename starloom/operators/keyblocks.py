"""Keys for loads that run at the same time: each load reserves blocks of numbers nobody else gets."""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.sequence import with_index
from starloom.session import barrier, claim, hadoop_path

#: Files of reserved blocks: the first block, and how many where there are several.
_RUN = re.compile(r"(\d+)(?:-(\d+))?")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = hadoop_path(spark, folder)
    if not fs.exists(at):
        return []
    return [int(n) for s in fs.listStatus(at) if (n := s.getPath().getName()).isdigit()]


def claim_next(spark: SparkSession, folder: str, least: int = 1) -> int:
    """The next whole number of a shared folder. Two drivers never get the same one, and neither waits for the other."""
    number = max([least - 1, *_numbers(spark, folder)]) + 1
    while not claim(spark, f"{folder.rstrip('/')}/{number}"):
        number += 1
    return number


@dataclass(frozen=True)
class KeyBlocks:
    """The keys of one table, from ``first`` on, in blocks of ``size``; ``folder`` is shared by all loads of the table.

    A load reserves all its blocks at once, as a run of consecutive ones: one file, named by the run's first block and
    their number. Keys of a block that a load does not use up, or of one that died, stay unused; keys are unique and rise
    within a load, but have gaps.
    """

    folder: str
    first: int = 1
    size: int = 100_000

    def _runs(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(first block, block after the last one) of every file. A name that is a number alone is one block."""
        fs, at = hadoop_path(spark, self.folder)
        found = [_RUN.fullmatch(s.getPath().getName()) for s in fs.listStatus(at)]
        return [(int(m[1]), int(m[1]) + int(m[2] or 1)) for m in found if m]

    def reserve(self, spark: SparkSession, count: int) -> int | None:
        """The first of ``count`` consecutive keys that nobody else gets, None for a count of 0.

        A run is taken after the last one in the folder, and the folder is read again afterwards: of two loads whose runs
        overlap, at least the later one then sees the other's file. Who sees an overlap leaves its own run unused and
        tries a place further on, chosen at random so that two loads don't meet again. Nobody waits.
        """
        # All loads have to cut the numbers alike.
        cut = f"cut-{self.first}-{self.size}"
        fs, at = hadoop_path(spark, self.folder)
        claim(spark, f"{self.folder}/{cut}")
        other = [n for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("cut-") and n != cut]
        if other:
            raise ValueError(f"{self.folder}: other loads use {other[0]}, this one {cut}")
        blocks, apart = -(-count // self.size), 0
        if not blocks:
            return None
        while True:
            start = max([0, *(end for _, end in self._runs(spark))]) + random.randint(0, apart)
            own = (start, start + blocks)
            if claim(spark, f"{self.folder}/{start}-{blocks}"):
                met = [run for run in self._runs(spark) if run[0] < own[1] and own[0] < run[1]]
                if met == [own]:
                    return self.first + start * self.size
            apart = 2 * apart + blocks

    def number(self, df: DataFrame, order: Sequence[str | Column], output: str) -> DataFrame:
        """Keys for the rows of ``df`` by ``order``, from freshly reserved blocks."""
        placed = barrier(with_index(df, order, "_at"), "keys")
        start = self.reserve(df.sparkSession, placed.count())
        return placed.select(*df.columns, (F.lit(start).cast("long") + F.col("_at")).alias(output))
