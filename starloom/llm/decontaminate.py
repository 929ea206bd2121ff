"""Benchmark passages in documents: Wu-Manber search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import free_name, prepare, text_pass
from starloom.session import barrier

#: Words in a search block.
BLOCK = 2
#: Windows that one pass searches for; more are searched in several passes, so that what a task holds is bounded.
PASS_WINDOWS = 200_000

_UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: ASCII letters in lower case, digits as they are, every other ASCII character a space; bytes above 127 belong to words.
_TABLE = bytes(_UPPER.get(i, i) if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and characters outside ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Tables for patterns of one length, in words.

    ``shift`` says for each block of words how far the window may move on when it ends with that block; a block that no
    pattern has moves it past itself. Patterns that end with the block (shift 0) are in the bucket of that block, by the
    words they start with; what is in the bucket is compared word by word.
    """

    def __init__(self, length: int, patterns: list[tuple[bytes, ...]]):
        self.length, self.block = length, min(BLOCK, length)
        self.away = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for words in patterns:
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.away), length - end)
            self.buckets[words[-self.block :]][words[: self.block]].append(words)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) of every occurrence."""
        size, block, shift, away = self.length, self.block, self.shift, self.away
        end, last = size, len(words)
        while end <= last:
            seen = tuple(words[end - block : end])
            step = shift.get(seen, away)
            if step:
                end += step
                continue
            start = end - size
            for pattern in self.buckets[seen].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, pattern
            end += 1


class Searcher:
    """Wu-Manber tables for each length of pattern, and the items of each pattern."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.items = windows
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for words in windows:
            by_length[len(words)].append(words)
        self.tables = [WuManber(n, found) for n, found in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged stretches (first word, word after the last) that occurrences cover, and the items they come from."""
        stretches, items = [], set()
        for one in self.tables:
            for start, pattern in one.search(words):
                stretches.append((start, start + one.length))
                items.update(self.items[pattern])
        return merged(stretches), items


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(words, items): distinct windows of ``size`` words, as space-joined text, with the ids of items that have them."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, windows = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = words_of(text)
                length = min(size, len(own))
                found = {b" ".join(own[i : i + length]) for i in range(len(own) - length + 1)} if own else ()
                ids += [item] * len(found)
                windows += found
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(ids, pa.string())], names=["words", "item"])

    # The set of ids has no null: windows of items without an id alone have an empty one.
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "words binary, item string").groupBy("words").agg(F.collect_set("item").alias("items"))


def find_passages(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, key (md5 of the text), n_words, spans (word positions, the end excluded) and items (sorted ids) of every row of ``docs``.

    The windows of ``benchmark`` (item_id, text) are the stated query set. They are searched for in every document, at
    most PASS_WINDOWS of them in one pass over the documents; what the passes find is put together per row. A window is
    ``size`` consecutive words, an item of fewer words is one window, an item without words has none. Items without an id
    are searched for like others, and not among the ids found. Null or empty texts have no words. Repeated rows are separate rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    # Written once: counted here and read by every pass.
    windows = barrier(benchmark_windows(benchmark, size), "windows")
    passes = max(1, -(-windows.count() // PASS_WINDOWS))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = None
    for number in range(passes):
        part = windows if passes == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == number)
        held = spark.sparkContext.broadcast({tuple(bytes(r.words).split(b" ")): list(r.items) for r in part.toLocalIterator()})
        once = _search(rows, held).withColumn("pass", F.lit(number))
        found = once if found is None else found.union(once)
    if passes > 1:
        # Equal rows find the same in a pass: they are counted, put together once and given back as often.
        each = found.groupBy("doc_id", "key", "n_words", "pass").agg(F.min("spans").alias("spans"), F.min("items").alias("items"), F.count(F.lit(1)).alias("copies"))
        joined = each.groupBy("doc_id", "key", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies")
        )
        found = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", "key", "n_words", "spans", "items")


_FOUND = "doc_id long, key binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(rows: DataFrame, held) -> DataFrame:
    made: list[Searcher] = []

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Searcher(held.value))
        keys, counts, spans, items = [], [], [], []
        for text in part.column(1).to_pylist():
            words = words_of(text)
            stretches, own = made[0].hits(words)
            keys.append(hashlib.md5(b"" if text is None else text.encode("utf-8", "surrogatepass")).digest())
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in stretches])
            items.append(sorted(own))
        out = [part.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "key", "n_words", "spans", "items"])

    return text_pass(rows, [F.col("doc_id").cast("long").alias("doc_id"), "text"], _FOUND, work)


def covered(spans: str = "spans"):
    """Words in the union of the spans, which may overlap when several passes found them."""
    ordered = F.array_sort(F.col(spans))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(seen, x):
        begin = F.greatest(seen["upto"], x["start"])
        return F.struct((seen["n"] + F.greatest(x["end"] - begin, F.lit(0))).alias("n"), F.greatest(seen["upto"], x["end"]).alias("upto"))

    return F.aggregate(ordered, start, add, lambda seen: seen["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; see :func:`find_passages`."""
    found = find_passages(docs, benchmark, size)
    hit = covered()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any word of a benchmark passage, all columns.

    The search answers with ids and text digests of hit rows, which are a small part of all. Rows go by both, so one with a
    null doc_id goes as well, and of several texts with one id only those with a passage go.
    """
    hit_id, hit_key = free_name(docs, "_hit_id"), free_name(docs, "_hit_key")
    hit = find_passages(docs, benchmark, size).filter(F.size("spans") > 0).select(F.col("doc_id").alias(hit_id), F.col("key").alias(hit_key)).distinct()
    own = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (own == F.col(hit_key)), "left_anti")
