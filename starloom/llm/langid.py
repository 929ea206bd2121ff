"""Language identification in two steps: the family, then the language within it, by linear support vector machines."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import fold, prepare, smallest_ids, text_pass
from starloom.llm.linear import linear_svm, probability

UNKNOWN = "und"
#: A text is in no learned language if less than this share of its letters occurs in any training text.
KNOWN_LETTERS = 0.5
#: Documents of each language that the model is fitted on, those with the smallest md5 of their id.
TRAIN_DOCS = 400
#: Hash buckets of the byte n-grams.
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: What a margin of one is in log odds.
STEEPNESS = 4.0

# Families of common language codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, other ASCII characters a space.
_TABLE = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of all groups of two, three and four bytes that hold no two spaces in a row."""
    raw = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    out = []
    for size in (2, 3, 4):
        if len(raw) >= size:
            key = np.full(len(raw) - size + 1, size, dtype=np.uint32)
            for k in range(size):
                key = key * np.uint32(0x9E3779B1) + raw[k : k + len(key)]
            key ^= key >> np.uint32(15)
            out.append((key * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


def shares(text: str) -> np.ndarray:
    """How much of a text's n-grams each bucket has."""
    own = grams(text)
    return (np.bincount(own, minlength=BUCKETS) / max(len(own), 1)).astype(np.float32)


class LanguageModel:
    """Machines between each two families, and between each two languages of a family."""

    def __init__(self, rows: list[tuple[str, bytes]], letters: str = ""):
        """From (language, shares of the buckets in a text) rows, which the list loses one by one, and the letters of these texts.

        Texts are held once, as rows of one matrix whose last column is the offset's.
        """
        self.letters = frozenset(letters)
        lang = np.array([x for x, _ in rows])
        self.languages = sorted({x for x, _ in rows})
        family = {x: FAMILY_OF.get(x, x) for x in self.languages}
        self.families = sorted(set(family.values()))
        self.members = {f: [x for x in self.languages if family[x] == f] for f in self.families}
        wide = np.ones((len(rows), BUCKETS + 1), dtype=np.float32)
        while rows:
            own = rows.pop()[1]
            wide[len(rows), :-1] = np.frombuffer(own, dtype=np.float32)
        counts = wide[:, :-1]
        # Frequent buckets weigh less, as in a distance between distributions.
        scale = 1 / np.sqrt(counts.sum(axis=0) / max(len(lang), 1) + np.float32(1e-5))
        counts *= scale
        kin = np.array([family[x] for x in lang]) if len(lang) else lang
        self.pairs: list[tuple[str, str, str]] = []
        columns, offsets = [], []
        for level, names, truth in [("", self.families, kin), *((f, self.members[f], lang) for f in self.families)]:
            for one, two in combinations(names, 2):
                mine = (truth == one) | (truth == two)
                w, b = linear_svm(wide if mine.all() else wide[mine], np.where(truth[mine] == one, 1.0, -1.0))
                self.pairs.append((level, one, two))
                columns.append(w * scale)
                offsets.append(b)
        self.weights = np.array(columns, dtype=np.float32).T.copy() if columns else np.zeros((BUCKETS, 0), np.float32)
        self.offsets = np.array(offsets)

    def _winner(self, level: str, names: list[str], margins: dict[tuple[str, str, str], float]) -> tuple[str, float]:
        """The name with most won comparisons (then the larger sum of margins), and its closest comparison as a chance."""
        won = {x: (0, 0.0, np.inf) for x in names}
        for one, two in combinations(names, 2):
            m = margins[level, one, two]
            for name, own in ((one, m), (two, -m)):
                wins, total, least = won[name]
                won[name] = (wins + (own > 0), total + own, min(least, own))
        best = max(names, key=lambda x: (won[x][0], won[x][1], x))
        return best, float(probability(np.float64(STEEPNESS * won[best][2])))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        own = grams(text)
        margins = dict(zip(self.pairs, self.weights[own].mean(axis=0, dtype=np.float64) + self.offsets, strict=True))
        family, sure = self._winner("", self.families, margins)
        language, surer = self._winner(family, self.members[family], margins)
        return language, sure * surer

    def readable(self, text: str) -> bool:
        """Whether the text is in letters that training texts have; the machines tell languages apart, not scripts."""
        own = Counter(text)
        known = sum(n for c, n in own.items() if c in self.letters)
        return known >= KNOWN_LETTERS * sum(n for c, n in own.items() if _LETTER.match(c))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """A model from at most ``train_docs`` documents of each language outside the held-out fold, whole texts.

    Texts are counted where they lie; the driver gets the shares of the buckets, 16 KB for each of these documents.
    """
    prepare(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id", "lang").distinct()
    picked = smallest_ids(known, train_docs, "lang").select(F.col("doc_id").alias("_picked"), F.col("lang").alias("_lang"))
    texts = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    rows = texts.join(F.broadcast(picked), (F.col("doc_id") == F.col("_picked")) & (F.col("lang") == F.col("_lang")))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(text, lang) for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if _LETTER.search(text)]
        found = [pa.array([shares(text).tobytes() for text, _ in texts], pa.binary()), pa.array([lang for _, lang in texts], pa.string())]
        letters = pa.array(["".join(sorted(c for c in set(text) if _LETTER.match(c))) for text, _ in texts], pa.string())
        return pa.RecordBatch.from_arrays([*found, letters], names=["shares", "lang", "letters"])

    counted = text_pass(rows, [F.col("text").cast("string"), F.col("lang").cast("string")], "shares binary, lang string, letters string", work).collect()
    letters = "".join(r.letters for r in counted)
    # In one order, so that the same documents give the same model.
    rows = sorted((r.lang, r.shares) for r in counted)
    del counted
    return LanguageModel(rows, letters)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` by its whole text alone.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no language was learned. The score
    is the chance of the family times that of the language against its closest rival. Rows are independent of each
    other, so repeated rows and null ids (held_out is then null) give rows like any other. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.predict(x) for x in part.column(1).to_pylist()]
        out = [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    found = text_pass(docs, columns, "doc_id long, lang_pred string, score double", work)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, model: LanguageModel, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with a score of ``least`` or more, all columns.

    Texts without a letter, and texts most of whose letters no training text has, are in none. Without any learned language
    nothing stays.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def batches(parts):
        for part in parts:
            texts = part.column(place).to_pylist()
            found = [held.value.predict(x) for x in texts]
            keep = [lang != UNKNOWN and score >= least and held.value.readable(x) for x, (lang, score) in zip(texts, found, strict=True)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
