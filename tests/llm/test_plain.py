"""The quality verdict and the whole pipeline against plain Python, and clashing names in every operator and stage."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import decontaminate, extract, langid, line_templates, mixing, near_dup, quality_model, quality_rules, secret_scan, toxicity
from starloom.llm.queries import tokenizer_path
from starloom.llm.token_store import token_digest
from starloom.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


# -- quality rules ---------------------------------------------------------------------------------


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed)


def buckets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    pairs = [long_hash(b, long_hash(a, 42)) for a, b in zip(hashed, hashed[1:])]
    return len(words), [signed(h) % quality_rules.BUCKETS for h in hashed + pairs]


def test_verdicts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    junk = [f"j{i}" for i in range(40)]
    texts = {i: " ".join(rng.choices(words if i % 3 else junk, k=rng.randrange(5, 60))) for i in range(150)}
    texts |= {200: None, 201: "", 202: texts[1]}
    labels = {i: int(i % 3 != 0) for i in range(0, 150, 2)} | {200: 1, 202: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    crc = lambda s: zlib.crc32(s.encode())
    trusted = [i for i, q in labels.items() if q == 1 and crc(str(i)) % 5]
    counted = [i for i in trusted if crc(f"half:{i}") % 2 == 0]
    own = {i: buckets(t) for i, t in texts.items()}
    raw, good = (Counter(b for i in ids for b in own[i][1]) for ids in (texts, counted))
    size = quality_rules.BUCKETS * quality_rules.SMOOTHING
    ratio = lambda b: math.log((good[b] + 1) / (good.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    llr = {i: sum(map(ratio, grams)) / len(grams) if grams else 0.0 for i, (_, grams) in own.items()}
    limit = np.percentile([llr[i] for i in trusted if i not in counted and own[i][0] >= 10], 100 * quality_rules.TRUSTED_BELOW)
    assert len(out) == len(texts)
    for i, row in out.items():
        assert abs(row.llr - llr[i]) < 1e-9
        assert row.kept == (not row.base_failed and llr[i] >= limit - 1e-12), i
    assert {row.kept for i, row in out.items() if not row.base_failed} == {True, False}


# -- pipeline --------------------------------------------------------------------------------------


def plain_order(rows):
    """(doc_id, text) in the mixture: Pfair slots, one at a time."""
    sources = defaultdict(list)
    for r in rows:
        sources["n" if r.source is None else f"s{r.source}"].append(r)
    names = sorted(sources)
    weight = {s: math.sqrt(len(sources[s])) for s in names}
    period = max(mixing.PERIOD, mixing.SLOTS_PER_SOURCE * len(names))
    exact = {s: (period - len(names)) * (weight[s] / sum(weight.values())) for s in names}
    units = {s: 1 + math.floor(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: period - sum(units.values())]:
        units[s] += 1
    import hashlib

    for s in names:
        sources[s].sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    out, done, slot = [], Counter(), 0
    while sum(map(len, sources.values())) > len(out):
        due = [(-(-(done[s] + 1) * period // units[s]), s) for s in names if done[s] * period < (slot + 1) * units[s]]
        _, s = min(due)
        out += sources[s][done[s] * mixing.BLOCK_DOCS : (done[s] + 1) * mixing.BLOCK_DOCS]
        done[s] += 1
        slot += 1
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        n = min(5, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    rows = [r for r in rows if find(r.doc_id) == r.doc_id]

    def tokens(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))

    windows = set()
    for item in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        own = tokens(item.text)
        n = min(10, len(own))
        windows |= {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
    sizes = {len(w) for w in windows}
    clean = lambda own: not any(tuple(own[i : i + n]) in windows for n in sizes for i in range(len(own) - n + 1))
    kept = [r for r in rows if clean(tokens(r.text))]
    assert 0 < len(kept) < len(rows) < docs.count()
    library, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in plain_order(kept):
        codes = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(codes), zlib.crc32(np.array(codes, "<u4").tobytes())))
        start += len(codes)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF_DIR).collect()), key=lambda r: r[1])
    assert got == want


# -- clashing names --------------------------------------------------------------------------------

INTERNAL = (
    "slot units period nth _k _tie _md5 _piece _source_key _row _id _index _before _dry mix_slot mix_place mix_block _gone_id _hit_id _hit_key key spans items n_words n_hit "
    "component_id kept root node bucket hub size set_key sketch a b shingle words _h _grams _trusted _counted llr good raw label _picked _lang lang_pred score shares held_out "
    "predicted clause start n_tokens ids_crc32 _at _n file part line lines template n_lines n_dropped secrets kind end host path constant"
).split()


@pytest.fixture(scope="module")
def crowded(spark):
    """The smallest documents with a column of every name that operators use inside."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in INTERNAL if n not in docs.columns])


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_clashing_columns(spark, crowded, name):
    plain = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = STAGES[name](spark, crowded, SF_DIR)
    want = STAGES[name](spark, plain, SF_DIR)
    if name != "tokens":
        assert out.columns == crowded.columns
        own = out.select([F.lit(True)] + [F.col(n) == f"own {n}" for n in INTERNAL if n not in plain.columns]).distinct().collect()
        assert [set(r) for r in own] == [{True}]
    assert sorted(map(str, out.select(want.columns).collect())) == sorted(map(str, want.collect()))


OPERATORS = {
    "mix": lambda d, lab, ben: mixing.mix(d).select("doc_id", "mix_slot", "mix_place"),
    "rules": lambda d, lab, ben: quality_rules.quality_rules(d, lab),
    "language": lambda d, lab, ben: langid.identify(d, langid.fit(d)),
    "quality": lambda d, lab, ben: quality_model.score_quality(d, quality_model.fit(d, lab)),
    "passages": lambda d, lab, ben: decontaminate.contamination(d, ben),
    "lines": lambda d, lab, ben: line_templates.drop_recurring_lines(d).select("doc_id", "n_lines", "n_dropped"),
    "near": lambda d, lab, ben: near_dup.near_duplicates(d),
    "toxic": lambda d, lab, ben: toxicity.score_toxicity(d, toxicity.fit(d, lab)),
    "secrets": lambda d, lab, ben: secret_scan.find_secrets(d),
    "tokens": lambda d, lab, ben: token_digest(d, tokenizer_path(), scratch_path(d.sparkSession, "clash-tokens")).select("doc_id", "start", "ids_crc32"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_with_clashing_columns(spark, crowded, name):
    plain = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    one, two = (OPERATORS[name](d, labels, benchmark) for d in (plain, crowded))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_pages_with_clashing_columns(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    crowded = pages.select("*", *[F.lit("x").alias(n) for n in INTERNAL])
    one, two = extract.extract_pages(pages), extract.extract_pages(crowded)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    assert mixing.mix(few).count() == 2
    with pytest.raises(Exception, match="more than 2 sources"):
        mixing.mix(few.union(few.selectExpr("doc_id", "'c' AS source"))).collect()


def test_all_trusted_documents_count(spark):
    labels = spark.range(15_000).selectExpr("id AS doc_id", "1 AS quality")
    expected = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(15_000))
    assert quality_rules.trusted_ids(labels).count() == expected > 10_000


@pytest.mark.parametrize("share", [0.0, 0.005, 0.37, 1.0])
def test_percentile_over_many_scores(spark, share):
    rng = random.Random(3)
    scores = [rng.choice([rng.gauss(0, 1), -0.5, 2.0]) for _ in range(501)]
    frame = spark.createDataFrame([(s,) for s in [*scores, None]], "score double").repartition(6)
    assert quality_rules._percentile(frame, share) == pytest.approx(np.percentile(scores, 100 * share), abs=1e-12)
    assert quality_rules._percentile(frame.filter("score IS NULL"), share) is None


def test_training_rows_are_held_once():
    rng = np.random.default_rng(4)
    rows = sorted((lang, rng.random(langid.BUCKETS, dtype=np.float32).tobytes()) for lang in ("de", "en", "fr", "es") for _ in range(100))
    size = sum(len(x) for _, x in rows)
    tracemalloc.start()
    try:
        model = langid.LanguageModel(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # One matrix and the half of it that two languages of a family take; the rows themselves are given up.
    assert not rows and len(model.pairs) == 3 and most < 1.8 * size


def test_only_texts_that_may_be_trusted_are_shuffled(spark):
    """The bitmap keeps other texts out of the join; what it lets through by chance is told apart exactly."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(100, 140).selectExpr("id AS _trusted")
        texts = spark.createDataFrame([(i, f"t{i}") for i in range(4_000)] + [(None, "n"), (101, "again"), (102, None)], "doc_id long, text string")
        near, others = quality_rules._texts_of(texts, ids)
        got = near.collect()
        assert sorted(r.text or "" for r in got if r._there) == sorted([f"t{i}" for i in range(100, 140)] + ["again", ""])
        assert {r._there for r in got} <= {True, False} and len(got) < 200
        assert sorted(map(str, near.select("doc_id", "text").union(others).collect())) == sorted(map(str, texts.collect()))
        assert "hashpartitioning" not in others._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
