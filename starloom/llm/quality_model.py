"""Quality by compression: dictionaries of good and bad text, and a calibrated difference of compressed sizes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import fold, prepare, text_pass, training_rows
from starloom.llm.linear import logistic, probability

#: Labelled documents of each class that are used, those with the smallest md5 of their id: every second one for the
#: dictionaries, the others for calibration.
TRAIN_DOCS = 1_600
#: Bytes of a piece; a text is compressed piece by piece, so that a dictionary counts as much at its end as at its start.
PIECE_BYTES = 2_048
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Scores from here on are predicted as good.
THRESHOLD = 0.3


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


class CompressionModel:
    """Two dictionaries and the weights that turn compressed sizes into the chance of a good text."""

    def __init__(self, rows: list[tuple[str, int]]):
        """From (text, label) rows in a fixed order; label 1 is good."""
        self.dictionaries = [_dictionary([t for t, y in rows[0::2] if y == label]) for label in (1, 0)]
        calibration = rows[1::2] or rows
        labels = np.array([y for _, y in calibration], dtype=np.float64)
        self.rate = float(labels.mean()) if len(labels) else 0.5
        self.weights = None
        if len(labels) and 0 < self.rate < 1:
            facts = np.array([self.facts(t) for t, _ in calibration])
            self.centre, self.spread = facts.mean(axis=0), facts.std(axis=0) + 1e-9
            self.weights = logistic((facts - self.centre) / self.spread, labels)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            bare = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._made = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **bare) if d else zstandard.ZstdCompressor(**bare) for d in self.dictionaries]
        return self._made

    def facts(self, text: str) -> list[float]:
        """Differences of the two compressed sizes, normalised by the text's size and by their sum, and what they depend on."""
        cut = pieces(text)
        size = sum(map(len, cut))
        if not size:
            return [0.0] * 7
        good, bad = (sum(len(c.compress(x)) for x in cut) for c in self._compressors())
        by_size, by_sum, ratio = (good - bad) / size, (good - bad) / (good + bad), (good + bad) / 2 / size
        return [by_size, by_sum, ratio, math.log(ratio), by_sum * ratio, math.log(size), by_sum * abs(by_sum)]

    def score(self, text: str | None) -> float:
        """The chance that the text is good; for an empty text the share of good texts in the calibration rows."""
        if self.weights is None or not text:
            return self.rate
        return float(probability((np.array(self.facts(text)) - self.centre) / self.spread @ self.weights[:-1] + self.weights[-1]))


def _dictionary(texts: list[str]) -> bytes:
    samples = [x for t in texts for x in pieces(t)]
    if sum(map(len, samples)) < 4 * DICTIONARY_BYTES or len(samples) < 16:
        return b"".join(samples)[-DICTIONARY_BYTES:] if sum(map(len, samples)) >= 64 else b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> CompressionModel:
    """A model from at most ``train_docs`` documents of each label outside the held-out fold."""
    rows = training_rows(docs, labels, "quality", train_docs)
    order = rows.select("text", F.col("label").cast("int").alias("label"), F.md5(F.col("doc_id").cast("string")).alias("at")).collect()
    return CompressionModel([(r.text, r.label) for r in sorted(order, key=lambda r: (r.at, r.label, r.text))])


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row by its whole text alone.

    Null and empty texts get the share of good texts among the calibration rows. Without labels of both classes every
    text gets that share (one half without any). Rows are independent of each other, so repeated rows and null ids
    (held_out is then null) give rows like any other. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        scores = [held.value.score(x) for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    found = text_pass(docs, columns, "doc_id long, score double", work)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
