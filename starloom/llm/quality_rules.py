"""Quality rules: counts over whole texts and a hashed n-gram likelihood ratio, as DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import fold
from starloom.operators.keyfilter import split_by_keys
from starloom.operators.ordered import running
from starloom.session import barrier

#: Buckets of the multinomials: words and pairs of words are hashed into them.
BUCKETS = 16_384
#: Added to the count of each bucket.
SMOOTHING = 1.0
#: Share of trusted documents outside the target multinomial that may score below the threshold.
TRUSTED_BELOW = 0.005
#: A document is base_failed with fewer words, or with more than so many in 100 words in repeated windows.
LEAST_WORDS = 10
WINDOW = 5
REPEATED_PERCENT = 20

_SPACE = r"[\x20\x09-\x0D]+"


def _features(docs: DataFrame) -> DataFrame:
    """``docs`` with words, their hashes and the buckets of words and pairs of words."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _SPACE), lambda w: w != "")
    hashed = docs.withColumn("words", words).withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    # get() past the end is null, so the last word pairs with nothing and stands alone.
    single = F.transform("_h", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(F.col("_h"), i + 1)), F.lit(BUCKETS)).cast("int"))
    return hashed.withColumn("_grams", F.concat(single, pairs))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_trusted, _counted): ids of all documents labelled good, outside the held-out fold, and which half they are in."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id").distinct()
    half = F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string")).cast("binary")) % 2 == 0
    return good.select(F.col("doc_id").alias("_trusted"), half.alias("_counted"))


def _texts_of(text: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``text`` that may have one of the ids, with _there: whether they do; rows that have none)."""
    near, others = split_by_keys(text, ids, ["doc_id"], ["_trusted"])
    # Only texts that the bitmap lets through are shuffled. The hint keeps the plan the same at every size.
    return near.hint("merge").join(ids, F.col("doc_id") == F.col("_trusted"), "left").select("doc_id", "text", F.col("_trusted").isNotNull().alias("_there")), others


def _percentile(scores: DataFrame, share: float) -> float | None:
    """The exact ``share`` point of the column score, between two neighbours in proportion; NULLs are left out.

    One row per distinct score and a running count in order, so no task holds all scores; two numbers reach the driver.
    """
    # Written first: a filter on what makes a score would work out its arrays again for every word.
    each = barrier(scores, "scores").filter("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.sum("n").alias("n")).first().n
    if total is None:
        return None
    at = share * (total - 1)
    # Rows up to a score: the first score with more than i rows is the one at place i.
    upto = running(each, [], ["score"], sums={"upto": F.col("n")})
    low, high = upto.agg(*[F.min(F.when(F.col("upto") > place, F.col("score"))) for place in (math.floor(at), math.ceil(at))]).first()
    return low + (at - math.floor(at)) * (high - low)


def fit_ratio(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """(log ratio of each bucket, threshold): trusted target against all documents.

    The target counts one half of all trusted documents. The threshold comes from the other half, because a document
    scores higher where its own n-grams were counted. The raw multinomial counts every document; counts meet as one row per bucket and task. What reaches the driver is
    one number per bucket.
    """
    text, ids = docs.select("doc_id", "text"), barrier(trusted_ids(labels), "trusted-ids")
    counted, unseen = (ids.filter(F.col("_counted") == half).select("_trusted") for half in (True, False))
    target, others = _texts_of(text, counted)
    flagged = _features(target.unionByName(others.select("doc_id", "text", F.lit(False).alias("_there"))))
    # The outer form: explode makes Spark filter empty arrays beforehand, which works out the whole array once more.
    grams = flagged.select(F.explode_outer("_grams").alias("bucket"), F.col("_there").cast("long").alias("good"))
    met = grams.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for row in met:
        raw[row.bucket] += row.raw
        good[row.bucket] += row.good
    all_raw, all_good = math.fsum(raw), math.fsum(good)
    ratio = [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw, strict=True)]
    trusted = _texts_of(text, unseen)[0].filter("_there")
    limit = _percentile(_features(trusted).select(F.when(F.size("words") >= LEAST_WORDS, _ratio(ratio)).alias("score")), TRUSTED_BELOW)
    return ratio, -math.inf if limit is None else limit


def _ratio(ratio: list[float]) -> Column:
    """The mean log ratio of a row's n-grams, 0 without any."""
    model = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    total = F.aggregate("_grams", F.lit(0.0), lambda sum_, b: sum_ + F.get(model, b))
    return F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))


def _base(frame: DataFrame) -> DataFrame:
    """Adds word and line counts to a frame that has text, words and _h."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    places = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    windows = F.when(F.size("_h") >= WINDOW, F.transform(places, lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    # Few texts repeat a window; only those sort theirs.
    repeated = F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def twin(pair: Column, at: Column) -> Column:
        own = F.col("_sorted")
        before = (at > 0) & (F.get(own, F.greatest(at - 1, F.lit(0)))["h"] == pair["h"])
        after = F.coalesce(F.get(own, at + 1)["h"] == pair["h"], F.lit(False))
        return F.when(before | after, pair["i"])

    starts = F.array_sort(F.array_compact(F.transform("_sorted", twin)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    cover = F.aggregate(
        "_starts", zero, lambda seen, at: F.struct((seen["n"] + at + WINDOW - F.greatest(seen["upto"], at)).alias("n"), (at + WINDOW).alias("upto")), lambda seen: seen["n"]
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        frame.withColumn("_w", windows)
        .withColumn("_sorted", repeated)
        .withColumn("_starts", starts)
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.concat_ws("", "words")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long"))
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr of every row.

    llr is the mean log ratio between the trusted multinomial (documents labelled good) and the multinomial of all
    documents over the hashed words and pairs of words of the text. A document that base rules do not fail is kept if llr
    reaches the threshold, which TRUSTED_BELOW of unseen trusted documents miss; the same text always gets the same verdict.

    Null or empty texts have no words and fail. Without any trusted document the ratio keeps what the base rules keep.
    Every row is scored by itself, so repeated rows and null ids give rows like any other. Other columns are ignored.
    """
    ratio, limit = fit_ratio(docs, labels)
    own = _features(docs.select("doc_id", "text"))
    counted = _base(own.withColumn("llr", _ratio(ratio)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= F.lit(limit))).alias("kept"), "llr"
    )
