"""Mixing sources to target weights: a Pfair schedule of source blocks, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators.sequence import spread

#: Documents in a block, the unit that is scheduled.
BLOCK_DOCS = 16
#: Slots after which the schedule repeats; a weight is a whole number of slots in a period.
PERIOD = 1000
#: Leading hex digits of the md5 of an id: pieces into which the order within a source is cut for numbering.
PIECE_DIGITS = 3
#: A period has at least so many slots per source, so that a source of little weight costs the others little.
SLOTS_PER_SOURCE = 4

#: Sources that one schedule can have.
MOST_SOURCES = 4_000

_KEY = "_source_key"


def _key(source: str) -> Column:
    """The source as a key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def target_units(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(_source_key, units, period): slots of each source in a period, which add up to the period.

    Each source gets one slot, the others go by weight: ``weights`` by source, or without them the square root of the
    source's documents, which lifts small sources. Sources that ``weights`` does not name have only their one slot. What
    rounding leaves goes to the largest remainders. One row per source.
    """
    if weights is not None:
        if any(not w > 0 for w in weights.values()) or not weights:
            raise ValueError("weights must be positive")
        pairs = [x for k, w in weights.items() for x in (F.lit(f"s{k}"), F.lit(float(w)))]
        counts = counts.withColumn("weight", F.coalesce(F.element_at(F.create_map(*pairs), F.col(_KEY)), F.lit(0.0)))
    else:
        counts = counts.withColumn("weight", F.sqrt(F.col("docs").cast("double")))
    every = Window.partitionBy()
    many = F.raise_error(F.lit(f"more than {MOST_SOURCES} sources: group small ones first")).cast("long")
    sources = F.count(F.lit(1)).over(every)
    sources = F.when(sources > MOST_SOURCES, many).otherwise(sources)
    sized = counts.withColumn("period", F.greatest(F.lit(PERIOD), SLOTS_PER_SOURCE * sources).cast("long"))
    share = F.when(F.sum("weight").over(every) > 0, F.col("weight") / F.sum("weight").over(every)).otherwise(1 / F.count(F.lit(1)).over(every))
    exact = sized.withColumn("exact", (F.col("period") - F.count(F.lit(1)).over(every)) * share)
    whole = exact.withColumn("whole", F.floor("exact")).withColumn("left", F.col("period") - F.count(F.lit(1)).over(every) - F.sum("whole").over(every))
    rank = F.row_number().over(Window.orderBy((F.col("exact") - F.col("whole")).desc(), _KEY))
    return whole.withColumn("rank", rank).select(_KEY, "docs", (1 + F.col("whole") + (F.col("rank") <= F.col("left")).cast("long")).alias("units"), "period")


def period_schedule(units: DataFrame) -> DataFrame:
    """(_source_key, units, docs, period, nth, slot): the slot of each source's nth block within a period.

    Block i of a source with u of P slots is released at floor(i P / u) and due at ceil((i + 1) P / u). Slot by slot, of
    the released blocks the one with the earliest deadline is taken (ties by source). The weights fill the period, so one
    block is always ready, none is late, and at any time a source is less than one block away from its share.
    """
    one = units.groupBy("period").agg(F.array_sort(F.collect_list(F.struct(_KEY, "units", "docs"))).alias("sources"))
    start = F.struct(F.transform("sources", lambda s: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        def due(count: Column, at: Column) -> Column:
            own = F.get(F.col("sources"), at)["units"]
            return F.when(count * F.col("period") < (slot + 1) * own, F.struct(F.ceil((count + 1) * F.col("period") / own).alias("due"), at.alias("at")))

        first = F.array_min(F.transform(state["done"], due))["at"]
        return F.struct(F.transform(state["done"], lambda count, at: count + (at == first).cast("long")).alias("done"), F.array_append(state["order"], first).alias("order"))

    order = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step, lambda state: state["order"])
    slots = one.withColumn("order", order).select("period", "sources", F.posexplode("order").alias("slot", "at"))
    named = slots.select("period", F.get("sources", F.col("at")).alias("s"), F.col("slot").cast("long").alias("slot")).select("period", "s.*", "slot")
    return named.withColumn("nth", (F.row_number().over(Window.partitionBy(_KEY).orderBy("slot")) - 1).cast("long"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with the columns mix_block, mix_release, mix_deadline, mix_slot, mix_place and mix_balanced.

    Within a source documents are ordered by the md5 of doc_id and cut into blocks of ``block_docs``; blocks get slots by
    :func:`period_schedule`, repeated without end. Ordering by (mix_slot, mix_place) gives the mixture. Every row is kept:
    mix_balanced says that the slot comes before the first one that a source could not fill, so among balanced blocks the
    shares deviate from the targets by less than one block; later slots hold what is left of the larger sources.

    The number of documents before a document in its source comes from counts of (source, piece of the md5) and a row
    number in the piece, so a source with a third of all rows is cut into 4,096 pieces.

    A null source is a source of its own, rows with a null doc_id are ordered as if it were empty text, repeated rows are
    separate rows, and an empty table gives an empty one. Columns of ``docs`` with one of the new names are replaced.
    There is one row per source in the tables that are gathered: sources are what a user names weights for. A schedule takes
    steps in proportion to the square of their number, so more than MOST_SOURCES are an error.
    """
    rows = docs.drop(*_NEW)
    placed = _placed(rows, weights, source, block_docs)
    return placed.select(*[F.col("_row")[c].alias(c) for c in rows.columns], *_NEW)


_NEW = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place", "mix_balanced"]


def _placed(docs: DataFrame, weights: dict[str, float] | None, source: str, block_docs: int) -> DataFrame:
    """Each row as one struct ``_row``, whose columns can't clash with those in use here, and its new columns."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), _key(source).alias(_KEY), digest.alias("_md5"), F.substring(digest, 1, PIECE_DIGITS).alias("_piece"), spread(docs).alias("_tie")
    )
    pieces = docs.select(_key(source).alias(_KEY), F.substring(digest, 1, PIECE_DIGITS).alias("_piece")).groupBy(_KEY, "_piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(_KEY).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(_KEY, "_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    schedule = period_schedule(target_units(pieces.groupBy(_KEY).agg(F.sum("n").alias("docs")), weights))
    # A source is dry at its first block without a document.
    blocks = F.ceil(F.col("docs") / block_docs)
    dry = schedule.filter(F.col("nth") == blocks % F.col("units")).select((F.floor(blocks / F.col("units")) * F.col("period") + F.col("slot")).alias("dry"))
    plan = schedule.crossJoin(F.broadcast(dry.agg(F.min("dry").alias("_dry")))).select(F.col(_KEY).alias("_k"), "units", "period", "nth", "slot", "_dry")
    inside = Window.partitionBy(_KEY, "_piece").orderBy("_md5", "_id", "_tie")
    numbered = keyed.join(offsets, [_KEY, "_piece"]).withColumn("_index", F.col("_before") + F.row_number().over(inside) - 1)
    block = F.floor(F.col("_index") / block_docs)
    cut = numbered.withColumn("mix_block", block).withColumn("mix_place", (F.col("_index") % block_docs).cast("long"))
    # At most MOST_SOURCES rows, and SLOTS_PER_SOURCE as many in the plan, one per slot of a period.
    sized = F.broadcast(plan.select("_k", "units", "period", "_dry").distinct())
    weighed = cut.join(sized, F.col(_KEY) == F.col("_k")).drop("_k")
    placed = weighed.join(F.broadcast(plan.select("_k", "nth", "slot")), (F.col(_KEY) == F.col("_k")) & (F.col("mix_block") % F.col("units") == F.col("nth")))
    slot = F.floor(F.col("mix_block") / F.col("units")) * F.col("period") + F.col("slot")
    return placed.select(
        "_row",
        "mix_block",
        F.floor(F.col("mix_block") * F.col("period") / F.col("units")).alias("mix_release"),
        F.ceil((F.col("mix_block") + 1) * F.col("period") / F.col("units")).alias("mix_deadline"),
        slot.alias("mix_slot"),
        "mix_place",
        (slot < F.col("_dry")).alias("mix_balanced"),
    )


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` sorted into the mixture, all columns: files in the order of their names hold it."""
    order = ["mix_slot", "mix_place"]
    placed = _placed(docs, weights, "source", BLOCK_DOCS).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


MIX_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce('s' || source, 'n') AS k, count(*) AS docs FROM documents GROUP BY 1
), shares AS (
  SELECT k, docs, greatest({PERIOD}, {SLOTS_PER_SOURCE} * count(*) OVER ()) AS period, count(*) OVER () AS n,
         sqrt(docs::DOUBLE) / sum(sqrt(docs::DOUBLE)) OVER () AS share
  FROM counts
), wholes AS (
  SELECT *, (period - n) * share AS exact, floor((period - n) * share)::BIGINT AS whole FROM shares
), units AS (
  SELECT k, docs, period, 1 + whole + (row_number() OVER (ORDER BY exact - whole DESC, k)
         <= period - n - sum(whole) OVER ())::BIGINT AS units
  FROM wholes
), lists AS (
  SELECT any_value(period)::BIGINT AS period, list(units::BIGINT ORDER BY k) AS u, list(k ORDER BY k) AS ks FROM units
), slots(t, done, pick) AS (
  SELECT 0::BIGINT, [0::BIGINT FOR x IN u], 0::BIGINT FROM lists
  UNION ALL
  SELECT t + 1, [d + (i = nxt)::BIGINT FOR d, i IN done], nxt FROM (
    SELECT t, done, list_min([[ceil((d + 1) * period / u[i])::BIGINT, i::BIGINT] FOR d, i IN done
             IF d * period < (t + 1) * u[i]])[2] AS nxt
    FROM slots, lists WHERE t < period)
), plan AS (
  SELECT ks[pick] AS k, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM slots, lists WHERE t > 0
), dry AS (
  SELECT min(ceil(docs / {BLOCK_DOCS}.0)::BIGINT // units * period + slot) AS dry
  FROM units JOIN plan USING (k) WHERE nth = ceil(docs / {BLOCK_DOCS}.0)::BIGINT % units
), numbered AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS i
  FROM documents
)
SELECT doc_id, source, i // {BLOCK_DOCS} AS mix_block,
       floor((i // {BLOCK_DOCS}) * period / units)::BIGINT AS mix_release, ceil((i // {BLOCK_DOCS} + 1) * period / units)::BIGINT AS mix_deadline,
       ((i // {BLOCK_DOCS}) // units * period + slot)::BIGINT AS mix_slot, i % {BLOCK_DOCS} AS mix_place,
       (i // {BLOCK_DOCS}) // units * period + slot < dry AS mix_balanced
FROM numbered JOIN units USING (k) JOIN plan ON plan.k = numbered.k AND nth = (i // {BLOCK_DOCS}) % units, dry
"""


def mix_query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Every document with its place in the mixture at the default weights."""
    return mix(documents.select("doc_id", "source"))
