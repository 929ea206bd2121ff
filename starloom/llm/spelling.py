"""Words that are one edit apart, found by pivotal bigrams, and the frequent form that each variant stands for."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import barrier

#: Words have so many code points and occurrences at least.
LEAST_LENGTH = 7
LEAST_TIMES = 2
#: A form occurs so many times as often as its variant.
FORM_TIMES = 10
#: One run in so many, by its hash, is written without one of its code points.
SLIP = 31
#: Bigrams in a word's prefix: one edit destroys two at most, so three hold two disjoint ones of which one survives.
PREFIX = 3
#: Counted words that a task keeps before it hands them on.
FLUSH_WORDS = 300_000

#: Latin-1 bytes of words: ASCII letters in lower case and U+00C0 to U+00FF; all others separate.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def written(doc_id: object, run: bytes) -> bytes:
    """The run as it counts: where SLIP divides crc32 of ``<doc_id>:<run>``, without the code point at that hash modulo its length."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode()
    digest = zlib.crc32(utf8, zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if digest % SLIP:
        return run
    gone = digest % len(run)
    return run[:gone] + run[gone + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH code points that occur LEAST_TIMES or more; tasks add up before the shuffle."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in times], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(times.values()), pa.int64())], ["word", "n"])
            times.clear()
            return batch

        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                # One byte for each code point; those above U+00FF become a question mark, which separates.
                for run, n in Counter(text.encode("latin-1", "replace").translate(_WORD_BYTES).split()).items():
                    if len(run) >= LEAST_LENGTH and len(word := written(doc_id, run)) >= LEAST_LENGTH:
                        times[word] += n
            if len(times) >= FLUSH_WORDS:
                yield flushed()
        yield flushed()

    counted = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string")).mapInArrow(count, "word string, n bigint")
    # Dealt out by an explicit number, which adaptive execution keeps: words are few and small, but each makes a dozen keys.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def bigram_weights(words: DataFrame) -> dict[str, int]:
    """How often each bigram occurs in the distinct words. Words have 90 letters, so there are 8,100 bigrams at most."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    return {row.gram: row.n for row in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def disjoint_pair(places: list[int], cost: Callable[[int], int]) -> tuple[int, int]:
    """The two of ``places`` (ascending, two or more apart) with the least cost: the best first one for each second one."""
    best, first, upto = None, None, 0
    for second in places:
        while places[upto] <= second - 2:
            if first is None or cost(places[upto]) < cost(first):
                first = places[upto]
            upto += 1
        if first is not None and (best is None or cost(first) + cost(second) < best[0]):
            best = (cost(first) + cost(second), first, second)
    return best[1], best[2]


def _hash(kind: int, head: str, tail: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\x00{size}\x00{head}\x00{tail}".encode()) - (1 << 63)


def _after(word: str, place: int, size: int, change: int) -> list[int]:
    """Keys for an edit behind the gram at ``place``: all before its end is the same, and a half of the rest.

    ``size`` is the length of the indexed word, ``change`` how much longer that is than ``word``.
    """
    end = place + 2
    half = (size - end) // 2
    apart = _hash(0, word[: end + half], "", size)
    return [apart, _hash(1, word[:end], word[end + half - change :], size)] if half else [apart]


def _before(word: str, place: int, size: int, change: int) -> list[int]:
    """Keys for an edit before the gram at ``place``: all from it on is the same, and a half of what comes before.

    ``place`` is the one in ``word``; in the indexed word the gram lies ``change`` further on.
    """
    half = (place + change) // 2
    apart = _hash(3, word[:half], word[place:], size)
    # An edit in an empty half does not happen.
    return [_hash(2, "", word[half - change :], size), apart] if half else [apart]


class Grams:
    """Prefix, pivots and keys of words, by the weights of bigrams."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.ranks = {g: i for i, (g, _) in enumerate(sorted(weights.items(), key=lambda x: (x[1], x[0])))}

    def prefix(self, word: str) -> tuple[int, list[int]]:
        """(rank of the last gram of the prefix, places of all grams up to that rank)."""
        ranks = [self.ranks[word[i : i + 2]] for i in range(len(word) - 1)]
        last = sorted(ranks)[PREFIX - 1]
        return last, [i for i, rank in enumerate(ranks) if rank <= last]

    def indexed(self, word: str) -> tuple[int, set[int]]:
        """What the index holds of a word: every gram of its prefix, for an edit on either side of it."""
        last, places = self.prefix(word)
        keys = {k for p in places for k in (*_after(word, p, len(word), 0), *_before(word, p, len(word), 0))}
        return last, keys

    def probes(self, word: str) -> tuple[int, set[int]]:
        """What is looked up: an edit lies behind the first pivot or before the second one, which don't overlap."""
        last, places = self.prefix(word)
        first, second = disjoint_pair(places, lambda p: self.weights[word[p : p + 2]])
        keys = set()
        for change in (-1, 0, 1):
            size = len(word) + change
            keys.update(_after(word, first, size, change))
            keys.update(_before(word, second, size, change))
        return last, keys


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: the pairs of ``words`` (word, n; distinct) that one inserted, deleted or replaced code point sets apart.

    Bigrams have one order, rarest first. The prefix of a word is its PREFIX rarest bigrams (and further ones of the last
    rank), its pivots are the two disjoint ones among these with the least total frequency. Of two near words take the
    one whose prefix ends at the smaller rank: one of its pivots is untouched by the edit, so it is in the other's
    prefix. Where it lies there is known from the lengths, and so is that one side of it is the same and one half of
    the other side too. All this makes one key, so pivots meet the index in one equality join. Keys are hashes; the
    edit distance decides.
    """
    grams = Grams(bigram_weights(words))
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def keyed(probing: bool) -> DataFrame:
        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in parts:
                keys, lasts, rows = [], [], []
                for row, word in enumerate(part.column(0).to_pylist()):
                    last, found = own.probes(word) if probing else own.indexed(word)
                    keys.extend(found)
                    lasts.extend([last] * len(found))
                    rows.extend([row] * len(found))
                at = pa.array(rows, pa.int64())
                columns = [pa.array(keys, pa.int64()), pa.array(lasts, pa.int32()), part.column(0).take(at), part.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "last", "word", "n"])

        return words.select("word", "n").mapInArrow(work, "key bigint, last int, word string, n bigint")

    index, probe = keyed(False), keyed(True)
    probe = probe.select("key", *[F.col(c).alias(f"p_{c}") for c in ("last", "word", "n")])
    met = probe.join(index, "key").where("p_last <= last AND p_word <> word")
    near = met.where(F.levenshtein("p_word", "word", 1) == 1)
    swap = F.col("p_word") > F.col("word")
    ordered = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("word", "p_word", "a"), ("n", "p_n", "a_n"), ("p_word", "word", "b"), ("p_n", "n", "b_n"))]
    return near.select(*ordered).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form: forms are followed to the last one.

    Occurrences grow at least tenfold with each step, so a chain has 18 steps at most; each round doubles what is followed.
    """
    reached = barrier(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = barrier(reached.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        reached = step.select("word", "root")
        if not step.where("_moved").limit(1).take(1):
            return reached


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for every word of the corpus, grouped by spelling.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least LEAST_LENGTH code points and LEAST_TIMES
    occurrences, A-Z in lower case, some with a slip (:func:`written`). Two are near if one edit sets them apart.
    ``form`` is the near word of the largest n (then the smallest), if it occurs FORM_TIMES as often as the word; ``root`` is
    where the forms end, the word itself without one; ``n_near`` counts near words.

    Null texts have no words; a null id counts as an empty one; repeated rows count each; an empty table gives no
    rows; other columns are ignored.
    """
    words = barrier(word_counts(docs), "spelling-words")
    near = barrier(near_pairs(words), "spelling-near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("_best"))
    joined = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = -F.col("_best.n") >= FORM_TIMES * F.col("n")
    formed = barrier(
        joined.select(
            "word", F.when(is_form, F.col("_best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("_best.n")).alias("form_n")
        ),
        "spelling-forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT run, n, flatten(list_transform(string_split(concat(coalesce(doc_id::VARCHAR, ''), ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS bytes FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, (h % length(run))::INTEGER), substr(run, (h % length(run))::INTEGER + 2)) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT x, y, w.n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY w.n DESC, y) AS at FROM near JOIN words w ON w.word = y
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.y END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END::BIGINT AS form_n
  FROM words w LEFT JOIN ranked r ON r.x = w.word AND r.at = 1
), steps(word, root, depth) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT s.word, f.form, s.depth + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM steps GROUP BY word) s USING (word)
"""
