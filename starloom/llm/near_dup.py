"""Near duplicates by HyperMinHash sketches, banding, corrected estimates and a check on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import components, free_name, prepare, text_pass
from starloom.llm.shingles import common, mixed, shingle_set
from starloom.session import barrier

#: Sketch: 256 registers of 6 bits for leading zeros and 10 bits of mantissa.
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
EMPTY = 0xFFFF
#: 42 bands of 6 registers: two documents at similarity 0.8 miss every band with a chance of 3 in a million.
BAND_ROWS = 6
#: Standard deviations by which an estimate may lie below the threshold before a pair is left unchecked.
SLACK = 5.0
#: Nodes up to which a bucket that is still in several components tests all its pairs.
SMALL_BUCKET = 16


def registers(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each register, 2^56 where there is none. ``shingles`` are sorted hashes."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - REGISTER_BITS)
    at = np.searchsorted(shingles, edges)
    held = np.append(shingles, np.uint64(0))[at]
    there = (at < len(shingles)) & ((held >> np.uint64(64 - REGISTER_BITS)) == np.arange(REGISTERS, dtype=np.uint64))
    return np.where(there, held & np.uint64((1 << 56) - 1), np.uint64(1 << 56))


def compressed(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one of each smallest hash, in 16 bits."""
    value = (smallest >> np.uint64(8)).astype(np.float64)  # 48 bits: exact
    part, exponent = np.frexp(value)
    zeros = np.clip(48 - exponent, 0, 62).astype(np.uint16)
    mantissa = np.maximum((part * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    return np.where(smallest == np.uint64(1 << 56), np.uint16(EMPTY), (zeros << np.uint16(MANTISSA_BITS)) | mantissa).astype("<u2")


#: The order in which each register looks for a register to borrow from: a fixed random order per register.
_LENDERS = mixed(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)


def densified(sketches: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers hold what the first filled register in their order of lenders holds.

    A short text leaves most registers empty; bands of them would agree as soon as one common shingle does. With borrowed
    values each register agrees with a chance of about the similarity, as in long texts.
    """
    out = sketches.copy()
    for row in out:
        empty = np.flatnonzero(row == EMPTY)
        filled = np.flatnonzero(row != EMPTY)
        if len(empty) and len(filled):
            row[empty] = row[filled[_LENDERS[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, registers it rests on) of pairs of sketches, corrected for registers that agree by chance."""
    used = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & used).sum(axis=1)
    filled = np.maximum(used.sum(axis=1), 1)
    ratio = size_a / np.maximum(size_b, 1)
    # The chance that unrelated registers fall into one cell; cells are a 2^-10th of their distance from zero wide.
    chance = 0.17 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.clip((agree / filled - chance) / (1 - chance), 0, 1), filled


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set; null if it is empty), sketch."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, rows = [], [], []
        for text in part.column(1).to_pylist():
            own = shingle_set(text, words)
            sizes.append(len(own))
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            rows.append(registers(own))
        packed = compressed(np.array(rows, dtype=np.uint64)) if rows else []
        out = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary())]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "n_shingles", "set_key", "sketch"])

    return text_pass(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], "doc_id long, n_shingles long, set_key binary, sketch binary", work)


def bands(sketches: DataFrame) -> DataFrame:
    """(node, bucket): a hash of each band and its registers."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        nodes = np.array(part.column(0).to_pylist(), dtype=np.int64)
        count = REGISTERS // BAND_ROWS
        all_rows = densified(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(len(nodes), REGISTERS))
        cut = all_rows[:, : count * BAND_ROWS].reshape(len(nodes), count, BAND_ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(nodes), count)).copy()
            for place in range(BAND_ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, place] + np.uint64(1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, count)), pa.array(key.reshape(-1).view(np.int64))], names=["node", "bucket"])

    return text_pass(sketches, ["node", "sketch"], "node long, bucket long", work)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate does not rule the threshold out."""
    one = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("size_a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("size_b"), F.col("sketch").alias("sketch_b"))
    # Sets whose sizes alone keep them below the threshold need no estimate.
    sized = pairs.join(one, "a").join(two, "b").filter(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.frombuffer(b"".join(part.column(i).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for i in (4, 5)]
        sizes = [np.array(part.column(i).to_pylist(), dtype=np.float64) for i in (2, 3)]
        value, filled = estimated(*rows, *sizes)
        limit = percent / 100
        keep = value >= limit - SLACK * np.sqrt(limit * (1 - limit) / filled) - 1e-9
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return text_pass(sized, ["a", "b", "size_a", "size_b", "sketch_a", "sketch_b"], "a long, b long", work)


_COMPARED = "a long, b long, size_a long, size_b long, shared long, extra array<long>"


def _compared(pairs: DataFrame, texts: DataFrame, words: int, extra: bool = False) -> DataFrame:
    """Pairs (a, b) with the sizes of their whole sets, how much these share and, if asked for, what only a has."""
    # b is a hub: its rows come together, so its set is made once.
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, dtype=np.uint64))
        for part in parts:
            found: list[list] = [[], [], [], []]
            for text_a, text_b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if text_b != last[0]:
                    last = (text_b, shingle_set(text_b, words))
                own = shingle_set(text_a, words)
                only = np.setdiff1d(own, last[1], assume_unique=True).view(np.int64) if extra else None
                row = (len(own), len(last[1]), len(own) - len(only) if extra else common(own, last[1]), only)
                for column, value in zip(found, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["a", "b", "size_a", "size_b", "shared", "extra"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(batches, _COMPARED)


def _hubs(members: DataFrame) -> DataFrame:
    """``members`` (bucket, node, size) with the hub of each bucket.

    The hub is the node whose buckets hold most nodes in all (the smallest of them): in a group of edited copies that is
    the one most others resemble, so that one round of tests links nearly all of them.
    """
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    best = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    return barrier(members.join(best.select("bucket", (-F.col("top.minus")).alias("hub")), "bucket"), "nd-members")


def _sharing(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of one hub in different components that may share enough of the given shingles.

    ``rows`` has hub ``b``, node ``a``, its component (root), its number of shingles (size_a), how many others it can share
    at most (base), how many of the given ones it has to share at least with whatever partner (missing), and a row for
    each given ``shingle``. With each node's shingles ordered by how many nodes of the hub have them, rarest first, a node
    that needs m of its e shingles shares one of its e - m + 1 rarest. The rarest shingle that two nodes share is followed
    in both by all others they share, so where too few follow the pair is out.
    """
    counted = rows.groupBy("b", "shingle").agg(F.count(F.lit(1)).alias("nodes"), F.min("root").alias("low"), F.max("root").alias("high"))
    # Shingles of one component are in no pair that is wanted: they neither count as shared nor take a place.
    common_ones = rows.join(counted.filter("low < high").select("b", "shingle", "nodes"), ["b", "shingle"])
    # Both windows are bounded by a node's own shingles, which were one array.
    own_ones = Window.partitionBy("b", "a")
    ranked = common_ones.withColumn("able", F.count(F.lit(1)).over(own_ones)).withColumn("rank", F.row_number().over(own_ones.orderBy("nodes", "shingle")))
    rare = barrier(ranked.filter("rank <= able - missing + 1").select("b", "shingle", "a", "root", "size_a", "base", (F.col("able") - F.col("rank") + 1).alias("left")), "nd-rare")
    one, two = (rare.select("b", "shingle", F.col("a").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("root", "size_a", "base", "left")]) for n in "xy")
    met = one.join(two, ["b", "shingle"]).filter("x > y AND root_x <> root_y")
    sized = met.filter(F.least("size_a_x", "size_a_y") * 100 >= F.greatest("size_a_x", "size_a_y") * percent)
    need = F.ceil(percent * (F.col("size_a_x") + F.col("size_a_y")) / (100 + percent)) - F.least("base_x", "base_y")
    return sized.filter(F.least("left_x", "left_y") >= need).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _own_shingles(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``nodes`` (b, a, root, size_a) with a row for each shingle of the node's whole set."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text, words).view(np.int64) for text in part.column(4).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), pa.int64())
        shingles = pa.array(np.concatenate(sets) if sets else np.empty(0, dtype=np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(4)), shingles], names=["b", "a", "root", "size_a", "shingle"])

    with_text = nodes.join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    return text_pass(with_text, ["b", "a", "root", "size_a", "text"], "b long, a long, root long, size_a long, shingle long", work)


def _beside_hubs(families: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of one hub in different components that can reach the threshold.

    ``families`` has hub, node and the node's component (root). Let x and y share s(x) and s(y) shingles with the hub.
    To be linked they must share ``percent / (100 + percent) * (size(x) + size(y))`` shingles, at most the smaller s of
    which the hub has. So either that suffices, which only nodes with few shingles allow, or they share as many others as
    are missing. The former are paired by their whole sets, the latter by what they have beside the hub, both by their
    rarest shingles (:func:`_sharing`). Edits that many copies share by chance are among the frequent ones, so
    pairs come from edits that are shared because the texts are related.
    """
    compared = _compared(families.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), texts, words, extra=True)
    own = compared.join(families.select(F.col("hub").alias("b"), F.col("node").alias("a"), "root"), ["a", "b"])
    hubs = families.filter("node = hub").select(F.col("hub").alias("b"), F.col("root").alias("hub_root"))
    least = own.groupBy("b").agg(F.min("size_a").alias("least"))
    needed = F.ceil(percent * (F.col("size_a") + F.col("least")) / (100 + percent))
    reach = F.floor(F.col("shared") * (100 + percent) / percent) - F.col("size_a")
    missing = F.greatest(needed - F.col("shared"), F.lit(1))
    facts = barrier(own.join(least, "b").join(hubs, "b").withColumn("reach", reach).withColumn("missing", missing), "nd-families")
    # Nodes that what the hub has may suffice for, and those that are small enough to be their partners.
    able = (F.col("root") != F.col("hub_root")) & (F.col("reach") >= F.col("least"))
    top = facts.filter(able).groupBy("b").agg(F.max("reach").alias("top"))
    few = barrier(facts.join(top, "b").filter(able | (F.col("size_a") <= F.col("top"))).select("b", "a", "root", "size_a", needed.alias("missing")), "nd-few")
    whole = _own_shingles(few.drop("missing"), texts, words).join(few.select("b", "a", "missing"), ["b", "a"]).withColumn("base", F.lit(0).cast("long"))
    # The outer form keeps Spark from working the array out twice.
    columns = ["b", "a", "root", "size_a", F.col("shared").alias("base"), "missing"]
    others = facts.select(*columns, F.size("extra").alias("others"), F.explode_outer("extra").alias("shingle")).filter("shingle IS NOT NULL AND missing <= others")
    return _sharing(whole, percent).union(_sharing(others.drop("others"), percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked if ``100 * intersection >= percent * union`` on their sets of distinct shingles of ``words``
    words. component_id is the smallest doc_id that links reach, kept is ``doc_id = component_id``.

    * Equal sets become one node first, so thousands of copies cost one aggregate.
    * A node's HyperMinHash registers are banded; nodes that share a band are in one bucket. Each bucket tests all its
      nodes against its hub: as many pairs as nodes. Pairs pass the corrected estimate, then whole sets decide.
    * Links become components. Buckets of one component are done, small ones test their other pairs.
    * In the others the nodes that their hub did not link are paired by what they have beside it, see
      :func:`_beside_hubs`: exactly, without expanding a large group of edited copies into its pairs.

    Null or wordless texts have no shingle and are linked with nothing. A null doc_id is linked with nothing, its
    component_id is null and it is kept. Rows with one doc_id are one document with several texts. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sketches = barrier(sketch(docs, words), "nd-sketch")
    usable = sketches.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    # The smallest row of a class also carries its sketch: one row per class and task before the shuffle.
    nodes = barrier(
        usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("m")).select(F.col("m.doc_id").alias("node"), "m.n_shingles", "m.sketch"), "nd-nodes"
    )
    placed = bands(nodes)
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = _hubs(barrier(placed.join(sizes, "bucket"), "nd-shared"))
    # The one shuffle of whole texts; from here on there are only texts and sketches of nodes that share a bucket. The
    # hint keeps the plan the same at every size.
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = barrier(plain.hint("merge").join(wanted, "doc_id"), "nd-texts")
    known = barrier(nodes.hint("merge").join(wanted.withColumnRenamed("doc_id", "node"), "node"), "nd-known")

    def linked(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Components after testing the pairs (a, b) that are not in one already."""
        rooted = pairs.distinct().join(groups.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
        rooted = rooted.join(groups.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
        apart = rooted.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        likely = barrier(_likely(apart, known, percent), "nd-likely")
        if not likely.take(1):
            return groups
        sure = _compared(likely, texts, words).filter(F.col("shared") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))).filter("shared > 0")
        return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(sure.select("a", "b")), "nd-stars")

    groups = linked(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), spark.createDataFrame([], "node long, root long"))
    rooted = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    left = barrier(rooted.join(split, "bucket", "left_semi"), "nd-left")
    small = left.filter(F.col("size") <= SMALL_BUCKET).select("bucket", "node", "root")
    one, two = (small.select("bucket", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    pairs = one.join(two, "bucket").filter("a > b AND root_a <> root_b").select("a", "b")
    large = left.filter(F.col("size") > SMALL_BUCKET).select("hub", "node", "root").distinct()
    if large.take(1):
        pairs = pairs.union(_beside_hubs(large, texts, words, percent))
    groups = linked(pairs, groups)
    named = classes.join(groups, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    found = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("root", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one document for each group, all columns."""
    name = free_name(docs, "_gone_id")
    gone = near_duplicates(docs, words, percent).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
