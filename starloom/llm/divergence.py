"""Divergence between the sources of a language: a cube of (group block, group block, term block) cells."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.session import barrier

#: A term is kept where so many documents of its language have it.
LEAST_DOCS = 10
#: Ranks of the terms that set a group apart.
TOP_TERMS = 10
#: Sources in a group block and, on average, kept terms in a term block; a cell holds two slices of at most their product.
GROUP_BLOCK = 32
TERM_BLOCK = 512
#: Counted (language, source, term) entries that a task keeps before it hands them on.
FLUSH_ENTRIES = 300_000

#: UTF-8 bytes of terms: ASCII letters in lower case and everything above ASCII; all others separate.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

P_SQL = "cast(1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(21,0))) div cast({total} + 2 * {terms} as decimal(21,0)) as bigint)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of every term of every group.

    Each task adds up what it reads, so a source with a third of all rows sends one row per term and task.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, where) in groups.items():
                size = len(times)
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([t.decode() for t in times])]
                columns += [pa.array(list(times.values()), pa.int64()), pa.array([where[t] for t in times], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])
            groups.clear()

        for part in parts:
            for text, lang, source in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                own = Counter(text.encode().translate(_TERM_BYTES).split())
                if own:
                    times, where = groups.setdefault((lang, source), (Counter(), Counter()))
                    times.update(own)
                    where.update(own.keys())
            if sum(len(times) for times, _ in groups.values()) >= FLUSH_ENTRIES:
                yield from flushed()
        yield from flushed()

    schema = "lang string, source string, term string, n bigint, n_docs bigint"
    counted = docs.select(_text("text"), _text("lang"), _text("source")).mapInArrow(count, schema)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell: for each pair of its two group blocks, the divergence over the terms of its term block that occur in them.

    Terms that neither of the two has add the same amount each; they are added where the term axis is reduced, so that
    amount is taken off here for the other terms of the cell.
    """
    lang, i, j = rows["lang"].iat[0], rows["i"].iat[0], rows["j"].iat[0]
    terms, at = np.unique(rows["term"].fillna("").to_numpy(dtype=object), return_inverse=True)
    roster = rows["term"].isna().to_numpy()
    columns = len(terms) - int(roster.any())
    at = at - int(roster.any())  # the roster's empty term sorts first
    slices = []
    for block in (i, j):
        own = (rows["block"] == block).to_numpy()
        heads = own & roster
        names = rows["source"].to_numpy(dtype=object)[heads]
        order = np.argsort(names)
        names, base = names[order], rows["p"].to_numpy()[heads][order]
        table = np.repeat(base[:, None], columns, axis=1)
        filled = own & ~roster
        table[np.searchsorted(names, rows["source"].to_numpy(dtype=object)[filled]), at[filled]] = rows["p"].to_numpy()[filled]
        slices.append((names, base, table))
    (a_names, a_base, a_table), (b_names, b_base, b_table) = slices
    parts = []
    for x in range(len(a_names)):
        # p and q are at most 1 + 10^9: squares and sums of a block stay far below 2^63.
        value = ((a_table[x] - b_table) ** 2 // (a_table[x] + b_table)).sum(axis=1)
        none = (a_base[x] - b_base) ** 2 // (a_base[x] + b_base)
        parts.append(pd.DataFrame({"lang": lang, "source": a_names[x], "item": b_names, "part_value": value - columns * none}))
    out = pd.concat(parts, ignore_index=True)
    return out[out["source"] < out["item"]] if i == j else out


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language lie apart, and by which terms.

    Terms are runs of letters (all of non-ASCII), A-Z in lower case; a language keeps those in at least LEAST_DOCS of its documents.
    With V kept terms and N occurrences of them, a term that occurs n times has p = 1 + floor(10^9 (n + 2) / (N + 2 V)),
    and two groups differ there by floor((p - q)^2 / (p + q)). Part ``pair`` has the sum over all kept terms for every
    other source of the language, part ``term`` the TOP_TERMS kept terms that a group has more often than its language.

    The cube: sources of a language are dealt into blocks of GROUP_BLOCK, kept terms into blocks by hash. The slice
    (group block, term block) is replicated to the cells of all other group blocks, i <= j; a cell computes the partial
    sums of its pairs, and these are added along the term axis. A cell's size has a fixed bound, however common a source is.

    Null text, lang and source are empty strings. A group without terms, or a language without kept terms, still has its
    pairs (of value 0 if nothing is kept). Each row counts as a document, repeated ones and those without an id too; an
    empty table gives no rows; other columns are ignored.
    """
    groups = barrier(docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct(), "divergence-groups")
    counts = barrier(term_counts(docs), "divergence-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("_docs")).where(F.col("_docs") >= LEAST_DOCS).drop("_docs")
    vocabulary = barrier(vocabulary, "divergence-terms")
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    kept = counts.drop("n_docs").join(vocabulary, ["lang", "term"])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    frame = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "n_terms", "lang_total"])
    frame = frame.withColumn("block", F.floor(place / GROUP_BLOCK).cast("int"))
    frame = frame.withColumn("p0", F.when(F.col("n_terms") > 0, F.expr(P_SQL.format(n="0", total="total", terms="n_terms"))))
    # How many blocks each axis of a language has.
    frame = frame.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    frame = barrier(frame.withColumn("slabs", F.ceil(F.col("n_terms") / TERM_BLOCK).cast("int")), "divergence-frame")
    known = kept.join(frame, ["lang", "source"])
    known = known.withColumn("p", F.expr(P_SQL.format(n="n", total="total", terms="n_terms"))).withColumn(
        "q", F.expr(P_SQL.format(n="lang_n", total="lang_total", terms="n_terms"))
    )
    known = barrier(known.select("lang", "source", "term", "p", "q", "block", "blocks", "slabs"), "divergence-known")
    return _pairs(frame, known).unionByName(_terms(known))


def _pairs(frame: DataFrame, known: DataFrame) -> DataFrame:
    slab = F.pmod(F.xxhash64("term"), F.col("slabs")).cast("int")
    entries = known.select("lang", "source", "block", "blocks", "term", "p", slab.alias("k"))
    # Each group is in every cell of its block, also where none of its terms is.
    heads = frame.where("slabs > 0").select(
        "lang", "source", "block", "blocks", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("k")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    slices = entries.unionByName(heads).withColumn("_other", other)
    slices = slices.select("lang", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "k", "block", "source", "term", "p")
    parts = slices.groupBy("lang", "i", "j", "k").applyInPandas(_cell, "lang string, source string, item string, part_value bigint")
    reduced = parts.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("part_value"))
    both = reduced.unionByName(reduced.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part_value"))
    # The result has a row for each pair of a language's sources.
    one = frame.select("lang", "source", "n_terms", "p0")
    two = frame.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    value = F.when(F.col("n_terms") == 0, F.lit(0).cast("long")).otherwise(
        F.coalesce("part_value", F.lit(0)) + F.expr("n_terms * (((p0 - q0) * (p0 - q0)) div (p0 + q0))")
    )
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _terms(known: DataFrame) -> DataFrame:
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    rows = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    # The best of sixteen parts of a group first, then the best of these.
    order = [F.desc("value"), F.asc("item")]
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(16))).orderBy(*order)
    near = rows.withColumn("_at", F.row_number().over(salted)).where(F.col("_at") <= TOP_TERMS).drop("_at")
    return _ranked(near).where(F.col("rank") <= TOP_TERMS)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT lang, source, r, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * s.v) AS p,
         1 + (1000000000 * (k.n + 2)) // (s.total + 2 * s.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
) WHERE part = 'pair' OR rank <= 10
"""
