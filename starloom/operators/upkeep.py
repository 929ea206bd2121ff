"""Summary tables kept up to date from what a load changed, without reading the fact again."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.merge import delete_matching, upsert
from starloom.session import barrier

_SIGN = "_sign"


def upsert_changes(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, order: Sequence[str] = (), insert: bool = True
) -> DataFrame:
    """What :func:`~starloom.operators.merge.upsert` changes: old rows with ``_sign`` -1, new rows with 1.

    Only target rows whose key is in the source are read beyond their key.
    """
    reduced = source.select(*keys).where(_complete(keys)).distinct()
    touched = barrier(target.join(reduced, list(keys), "left_semi").select(*target.columns), "touched")
    after = upsert(touched, source, keys, update, order, insert)
    return touched.withColumn(_SIGN, F.lit(-1)).unionByName(after.withColumn(_SIGN, F.lit(1)))


def delete_changes(target: DataFrame, source: DataFrame, keys: Sequence[tuple[str, str, str]]) -> DataFrame:
    """What :func:`~starloom.operators.merge.delete_matching` removes, with ``_sign`` -1; the tests hold an equality."""
    equal = {t: s for t, op, s in keys if op == "="}
    named = source.select(*[F.col(s).alias(t) for t, s in equal.items()]).distinct()
    touched = barrier(target.join(named, list(equal), "left_semi").select(*target.columns), "touched")
    kept = delete_matching(touched, source, keys)
    return touched.withColumn(_SIGN, F.lit(-1)).unionByName(kept.withColumn(_SIGN, F.lit(1)))


def _complete(keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


@dataclass(frozen=True)
class Mart:
    """Per group: ``n_rows``, and of each column ``sum_`` and ``n_`` (its values that are not NULL), ``min_`` and ``max_``.

    Sums should be of decimals or whole numbers, whose sums don't depend on the order of adding.
    """

    group: tuple[str, ...]
    sums: tuple[str, ...] = ()
    extremes: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.group, "n_rows", *[f"{k}_{c}" for c in self.sums for k in ("sum", "n")], *[f"{k}_{c}" for c in self.extremes for k in ("min", "max")]]

    def build(self, fact: DataFrame) -> DataFrame:
        """The summary of a whole fact."""
        return fact.groupBy(*self.group).agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[f(c).alias(f"{k}_{c}") for c in self.sums for k, f in (("sum", F.sum), ("n", F.count))],
            *[f(c).alias(f"{k}_{c}") for c in self.extremes for k, f in (("min", F.min), ("max", F.max))],
        )

    def refresh(self, mart: DataFrame, changes: DataFrame, fact: DataFrame) -> DataFrame:
        """The summary after ``changes`` (signed rows); ``fact`` is the fact after them.

        Changes are added up per group and merged. Smallest and largest values of a group can only be kept up by adding;
        where rows went whose value was the smallest or largest, the fact's rows of that group are read again.
        """
        sign = F.col(_SIGN)
        moved = changes.groupBy(*self.group).agg(
            F.sum(sign).cast("long").alias("n_rows"),
            *[F.sum(F.col(c) * sign).alias(f"sum_{c}") for c in self.sums],
            *[F.sum(F.when(F.col(c).isNotNull(), sign)).cast("long").alias(f"n_{c}") for c in self.sums],
            *[f(F.when(sign == s, F.col(c))).alias(f"{w}_{k}_{c}") for c in self.extremes for w, s in (("old", -1), ("new", 1)) for k, f in (("min", F.min), ("max", F.max))],
        )
        moved = barrier(moved, "mart-changes").withColumnsRenamed({n: f"_m_{n}" for n in moved.columns})
        same = functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_m_{g}")) for g in self.group], F.lit(True))
        both = mart.join(moved, same, "full_outer")
        zero = F.lit(0)
        out = [F.coalesce(g, f"_m_{g}").alias(g) for g in self.group]
        out.append((F.coalesce("n_rows", zero) + F.coalesce("_m_n_rows", zero)).alias("n_rows"))
        for c in self.sums:
            values = F.coalesce(f"n_{c}", zero) + F.coalesce(f"_m_n_{c}", zero)
            kind = mart.schema[f"sum_{c}"].dataType
            total = (F.coalesce(f"sum_{c}", zero) + F.coalesce(f"_m_sum_{c}", zero)).cast(kind)
            out += [F.when(values > 0, total).alias(f"sum_{c}"), values.alias(f"n_{c}")]
        again = F.lit(False)
        for c in self.extremes:
            for k, best in (("min", F.least), ("max", F.greatest)):
                out.append(best(F.col(f"{k}_{c}"), F.col(f"_m_new_{k}_{c}")).alias(f"{k}_{c}"))
                again = again | F.coalesce(F.col(f"_m_old_{k}_{c}") == F.col(f"{k}_{c}"), F.lit(False))
        merged = barrier(both.select(*out, again.alias("_again")).where("n_rows > 0"), "mart").select(*self.columns, "_again")
        if not self.extremes:
            return merged.drop("_again")
        stale = merged.where("_again").select(*[F.col(g).alias(f"_s_{g}") for g in self.group])
        back = functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in self.group], F.lit(True))
        return merged.where("NOT _again").drop("_again").unionByName(self.build(fact.join(stale, back, "left_semi")).select(*self.columns))
