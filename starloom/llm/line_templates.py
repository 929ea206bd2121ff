"""Line dedup by a tree of line templates, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import prepare
from starloom.session import barrier

#: Leading tokens that a branch of the tree is chosen by, after the number of tokens.
DEPTH = 2
#: Sections of the tokens after those; a template leaves one of them open.
SECTIONS = 4
#: Lines with fewer tokens belong to no template unless the caller says otherwise; those with fewer than the second number only to their own.
LEAST_TOKENS = 3
OPEN_TOKENS = 10
#: Documents that a recurring template is in.
LEAST_DOCS = 3

_SPACE = r"[\x20\x09-\x0D]+"
_VARIABLE = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), line (its number), tokens with those that hold a digit made variable."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode_outer(F.split("text", "\n")).alias("line", "own"))
    tokens = F.filter(F.split("own", _SPACE), lambda t: t != "")
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), _VARIABLE).otherwise(t))
    return cut.select("doc_id", "version", "line", masked.alias("tokens"))


def _whole(tokens: Column) -> Column:
    return F.concat_ws(" ", F.size(tokens).cast("string"), tokens)


def _templates(tokens: Column, least_tokens: int = LEAST_TOKENS) -> Column:
    """The templates of a line (null if it has too few tokens): its tokens, and for long lines its tokens with one section left open.

    All start with the path in the tree, which is the number of tokens and the leading ones: lines of different paths
    never meet. Templates are written as text; two hashes of it make the key.
    """
    count = F.size(tokens)
    rest = count - DEPTH

    def opened(section: Column) -> Column:
        start = F.lit(DEPTH) + F.floor((section * rest + SECTIONS - 1) / SECTIONS).cast("int")
        end = F.lit(DEPTH) + F.floor(((section + 1) * rest + SECTIONS - 1) / SECTIONS).cast("int")
        return F.concat_ws(" ", count.cast("string"), F.slice(tokens, 1, start), F.lit(_VARIABLE), section.cast("string"), F.slice(tokens, end + 1, count))

    whole = F.array(_whole(tokens))
    return F.when(count >= OPEN_TOKENS, F.concat(whole, F.transform(F.sequence(F.lit(0), F.lit(SECTIONS - 1)), opened))).when(count >= max(least_tokens, 1), whole)


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, pair_tokens: int | None = None) -> DataFrame:
    """doc_id, version, lines: numbers of the lines whose template recurs and was in an earlier document.

    Templates of several documents are found by a pre-aggregated grouping, so a line in a third of all documents is one row
    per task; the joins back with the templates are ones that split.
    """
    # The outer form: explode makes Spark filter empty arrays beforehand, which works out the whole array once more.
    cut = _lines(docs).select("doc_id", "version", "line", *([] if pair_tokens is None else ["tokens"]), F.explode_outer(_templates(F.col("tokens"), least_tokens)).alias("template"))
    pair = [] if pair_tokens is None else [((F.size("tokens") >= pair_tokens) & (F.col("template") == _whole(F.col("tokens")))).alias("pair")]
    keys = cut.filter("template IS NOT NULL").select("doc_id", "version", "line", F.xxhash64("template").alias("k1"), F.xxhash64(F.lit("second"), "template").alias("k2"), *pair)
    hashed = barrier(keys, "line-templates")
    # Most templates are in one document; only rows of the others go on.
    shared = hashed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    again = barrier(hashed.join(shared.select("k1", "k2", "first"), ["k1", "k2"]), "shared-templates")
    # What is still there is in two documents at least.
    own = ["k1", "k2", "pair"] if pair else ["k1", "k2"]
    in_docs = again.select(*own, "doc_id").distinct()
    enough = F.col("docs") >= least_docs
    known = in_docs.groupBy(*own).agg(F.count(F.lit(1)).alias("docs")).filter(enough | F.col("pair") if pair else enough)
    again = again.join(known.select("k1", "k2"), ["k1", "k2"]).filter(F.col("doc_id") != F.col("first"))
    return again.groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, pair_tokens: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of every row, without lines whose template recurs.

    Lines are what ``\\n`` separates, tokens what ASCII white space separates; a token with a digit is a variable field. A
    template is a line with variable fields, and for lines of OPEN_TOKENS or more also the line with one of SECTIONS
    sections of its tokens left open, so lines that differ in neighbouring fields generalise to one template. Templates
    in ``least_docs`` documents or more recur; the document with the smallest id keeps its lines, all others lose them.
    Whole lines of ``pair_tokens`` tokens or more recur from two documents on, if that is given. Lines with fewer than
    ``least_tokens`` tokens have no template and stay; 1 covers every line that has a token.

    A null text gives null and no lines, an empty text one line. Rows with a null doc_id keep all lines and count for no
    template. Repeated rows are one document; rows with one id and several texts too, each with its own lines. Other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    gone = recurring_lines(own.filter("doc_id IS NOT NULL AND text IS NOT NULL"), least_docs, least_tokens, pair_tokens)
    all_rows = own.withColumn("version", F.xxhash64("text"))
    joined = all_rows.join(gone, ["doc_id", "version"], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, at: ~F.array_contains(F.coalesce("lines", F.array().cast("array<int>")), at))
    dropped = F.coalesce(F.size("lines"), F.lit(0))
    return joined.select(
        "doc_id",
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("text"),
    )


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), tokens AS (
  SELECT doc_id, line, [CASE WHEN regexp_matches(t, '[0-9]') THEN '{_VARIABLE}' ELSE t END
                        FOR t IN regexp_extract_all(own, '[^\\x20\\x09-\\x0D]+')] AS t
  FROM lines
), sized AS (
  SELECT *, len(t)::BIGINT AS n, (len(t) - {DEPTH})::BIGINT AS r FROM tokens WHERE len(t) >= {LEAST_TOKENS}
), keys AS (
  SELECT doc_id, line, n::VARCHAR || ' ' || array_to_string(t, ' ') AS template FROM sized
  UNION ALL
  SELECT doc_id, line, n::VARCHAR || ' ' || array_to_string(t[1 : {DEPTH} + (s * r + {SECTIONS - 1}) // {SECTIONS}]
         || ['{_VARIABLE}', s::VARCHAR] || t[{DEPTH} + ((s + 1) * r + {SECTIONS - 1}) // {SECTIONS} + 1 :], ' ')
  FROM sized, range({SECTIONS}) AS g(s) WHERE n >= {OPEN_TOKENS}
), known AS (
  SELECT template, min(doc_id) AS first FROM keys GROUP BY template HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), gone AS (
  SELECT DISTINCT doc_id, line FROM keys JOIN known USING (template) WHERE doc_id <> first
), dropped AS (
  SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_dropped,
       CASE WHEN lines IS NULL THEN text ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(lines, i)], chr(10)) END AS text
FROM documents d LEFT JOIN dropped USING (doc_id)
"""
