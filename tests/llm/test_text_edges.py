"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every text operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import decontaminate, extract, langid, line_templates, mixing, near_dup, quality_model, quality_rules, toxicity
from starloom.llm.queries import tokenizer_path
from starloom.llm.token_store import token_digest
from starloom.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, bucket int, component_id string"
PROSE = "the cat sat on the mat and looked at the dog that lay by the door of the old house"
GERMAN = "die Katze lag auf der Matte und sah den Hund an der vor der Tür des alten Hauses schlief"


def rows():
    plain = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "   \n\n\t", "de", None),
        (6, GERMAN, "de", "b"), (7, "12 34 !!", "en", "b"), (8, (PROSE + " " + GERMAN + "\n") * 3000, "en", "a"), (None, PROSE, "en", "a"), (9, "word", None, "c"),
    ]
    return [(i, t, lang, s, 0, 0.5, "x", 1, "y") for i, t, lang, s in plain]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (2, "word"), (3, None), (None, PROSE), (4, "")], "item_id long, text string")


def operators(spark, labels, benchmark):
    def digest(d):
        return token_digest(d, tokenizer_path(), scratch_path(spark, "edge-tokens"))

    return {
        "tokens": digest,
        "mix": mixing.mix,
        "rules": lambda d: quality_rules.quality_rules(d, labels),
        "language": lambda d: langid.identify(d, langid.fit(d)),
        "quality": lambda d: quality_model.score_quality(d, quality_model.fit(d, labels)),
        "passages": lambda d: decontaminate.contamination(d, benchmark),
        "lines": line_templates.drop_recurring_lines,
        "near": near_dup.near_duplicates,
        "toxic": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, labels)),
    }


NAMES = ["tokens", "mix", "rules", "language", "quality", "passages", "lines", "near", "toxic"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_gives_one_row(spark, docs, labels, benchmark, name):
    out = operators(spark, labels, benchmark)[name](docs)
    assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == sorted((r[0] for r in rows()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, labels, benchmark, name):
    assert operators(spark, labels, benchmark)[name](none).collect() == []


def test_defined_results(spark, docs, labels, benchmark):
    run = operators(spark, labels, benchmark)
    near = {r.doc_id: r for r in run["near"](docs).collect()}
    assert near[2].component_id == 1 and not near[2].kept and near[3].kept and near[3].n_shingles == 0
    assert near[None].component_id is None and near[None].kept
    language = {r.doc_id: r for r in run["language"](docs).collect()}
    assert language[3].lang_pred == language[4].lang_pred == language[7].lang_pred == "und" and language[7].score == 0
    found = {r.doc_id: r for r in run["passages"](docs).collect()}
    assert found[1].n_items == 1 and found[1].n_hit == found[1].n_words and found[9].n_hit == 1 and not found[3].contaminated
    tokens = {r.doc_id: r for r in run["tokens"](docs).collect()}
    assert tokens[None].start == 0 and tokens[3].n_tokens == tokens[4].n_tokens == tokens[5].n_tokens == 1
    lines = {r.doc_id: r for r in run["lines"](docs).collect()}
    assert lines[3].text is None and lines[3].n_lines == 0 and lines[5].text == "   \n\n\t"


def test_pages(spark):
    schema = "page_id long, url string, html string, text int, host string"
    page = "<body><nav>menu</nav><article><p>Some text &amp; more<p>end</article><div class='comments'>no</div></body>"
    data = [(1, "http://a.b/1", page), (1, "http://a.b/1", page), (2, None, page), (None, "x", None), (4, "http://a.b/2", ""), (5, "http://a.b/3", "<article>" + "<p>long</p>" * 50_000)]
    df = spark.createDataFrame([(*r, 0, "h") for r in data], schema)
    out = {r.page_id: r for r in extract.extract_pages(df).collect()}
    assert out[1].text == out[2].text == "Some text & more\nend" and out[2].n_chars == 20
    assert out[None].text == out[4].text == "" and out[5].n_chars == 50_000 * 5 - 1
    assert extract.extract_pages(df).count() == len(data) and extract.extract_pages(df.limit(0)).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, none, benchmark, tmp_path, empty):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = none if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert kept.columns == docs.columns
    assert (kept.count() == 0) == empty


def test_language_stage_drops_texts_without_letters(spark, docs):
    left = corpus_pipeline.known_language(spark, docs, "").select("doc_id").collect()
    assert {r.doc_id for r in left} == {1, 2, 6, 8, 9, None}


def test_extra_column_of_the_mixture_is_replaced(spark, docs):
    assert mixing.mix(docs.withColumn("mix_slot", F.lit("x"))).schema["mix_slot"].dataType.simpleString() == "bigint"


def test_language_stage_drops_unlearned_scripts(spark, docs):
    strange = ["Привет, как дела? Это русский текст о погоде", "这是一个中文句子", "Καλημέρα κόσμε", "mostly English words and one слово", "Ünïcödé lättérs ôf thé sàmé scrïpt, mostly plain ones"]
    more = spark.createDataFrame([(100 + i, t, None, "x", 0, 0.0, "", 0, "") for i, t in enumerate(strange)], SCHEMA)
    left = corpus_pipeline.known_language(spark, docs.union(more), "").select("doc_id").collect()
    assert {r.doc_id for r in left if r.doc_id and r.doc_id >= 100} == {103, 104}
