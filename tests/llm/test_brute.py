"""Text operators against plain Python on small tables."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from starloom.llm import decontaminate, extract, line_templates, mixing, near_dup, quality_model, quality_rules, token_store, toxicity
from starloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def documents(seed, count=120):
    """Texts with copies, edited copies in a large group, shared passages and short texts."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = []
    for _ in range(count):
        kind = rng.random()
        if kind < 0.5:
            words = list(base)
            for _ in range(rng.randrange(14)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        elif kind < 0.7:
            words = [rng.choice(WORDS) for _ in range(rng.randrange(30, 60))] + base[:40]
        elif kind < 0.8 and texts:
            words = rng.choice(texts).split()
        else:
            words = [rng.choice(WORDS[:6]) for _ in range(rng.randrange(8))]
        texts.append(" ".join(words))
    return texts


def shingles(text, size):
    words = text.split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = documents(seed)
    sets = [shingles(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 4).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64))
    a, b = np.sort(rng.choice(pool, 2000, replace=False)), np.sort(rng.choice(pool, 2000, replace=False))
    rows = near_dup.compressed(np.array([near_dup.registers(a), near_dup.registers(b)]))
    value, _ = near_dup.estimated(rows[:1], rows[1:], np.array([2000.0]), np.array([2000.0]))
    assert abs(value[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_wu_manber_finds_what_comparison_finds():
    rng = random.Random(3)
    for size in (1, 2, 3, 10):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
        patterns = {tuple(words[i : i + size]) for i in rng.sample(range(390), 20)} | {tuple(rng.choice([b"a", b"b"]) for _ in range(size))}
        want = {(i, p) for p in patterns for i in range(len(words) - size + 1) if tuple(words[i : i + size]) == p}
        assert set(decontaminate.WuManber(size, sorted(patterns)).search(words)) == want


def test_several_passes_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.union(docs.limit(5))
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    once = sorted(map(str, decontaminate.contamination(docs, benchmark).drop("spans").collect()))
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", 200)
    assert sorted(map(str, decontaminate.contamination(docs, benchmark).drop("spans").collect())) == once


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for high in (2, 16, 300, 50_000, 65_536):
        for count in (0, 1, 511, 512, 513, 5000):
            ids = (rng.random(count) ** 3 * high).astype("<u2")
            codes = token_store.Codes(memoryview(token_store.encode_codes(ids)))
            assert len(codes) == count and (codes.stretch(0, count) == ids).all() if count else len(codes) == 0
            for i in rng.integers(0, count, 20) if count else []:
                end = int(rng.integers(i, count + 1))
                assert codes[int(i)] == ids[i] and (codes.stretch(int(i), end) == ids[i:end]).all()


def test_token_files_hold_the_library_ids(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = [(10_001, "Don't <|endoftext|> ÉÀß Œİ 中文 \x1c á"), (10_002, None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    library, start, want = Tokenizer.from_file(tokenizer_path()), 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    from starloom.session import scratch_path

    got = token_store.token_digest(docs, tokenizer_path(), scratch_path(spark, "test-tokens")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_contaminated_rows_go_one_by_one(spark):
    passage, nameless = (" ".join(f"{w}{chr(97 + i)}" for i in range(12)) for w in "xy")
    benchmark = spark.createDataFrame([(1, passage), (None, nameless)], "item_id long, text string")
    data = [(1, passage), (1, "a clean text"), (None, f"so {passage}"), (None, "another clean text"), (2, f"so {nameless}"), (3, None), (3, passage), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    left = decontaminate.drop_contaminated(df, benchmark).collect()
    assert sorted(map(str, left)) == sorted(map(str, df.filter("text IS NULL OR text LIKE '%clean%'").collect()))
    row = decontaminate.contamination(df, benchmark).filter("doc_id = 2").collect()[0]
    assert row.contaminated and row.n_hit == 12 and row.n_items == 0


def test_rule_counts(spark):
    rng = random.Random(5)
    texts = documents(4, 60) + ["a\nb\na\n\n\n", "x " * 30, "the&&& <b> $5 #1\nthe&&& <b> $5 #1\n \nq"]
    texts += ["\n".join(" ".join(rng.choice("abc") for _ in range(9)) for _ in range(6)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40)], "doc_id long, quality int")
    for r in quality_rules.quality_rules(df, labels).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        repeated = len({k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * repeated > 20 * len(words)) and not (r.base_failed and r.kept)


def test_schedule_is_fair(spark):
    df = spark.createDataFrame([(i, "abc"[i % 7 % 3]) for i in range(4000)], "doc_id long, source string")
    rows = mixing.mix(df, {"a": 5, "b": 3, "c": 1}, block_docs=4).collect()
    assert len(rows) == 4000 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    units = {r._source_key[1:]: r.units for r in mixing.target_units(df.selectExpr("concat('s', source) AS _source_key").groupBy("_source_key").count().withColumnRenamed("count", "docs"), {"a": 5, "b": 3, "c": 1}).collect()}
    slots = sorted({(r.mix_slot, r.source) for r in rows if r.mix_balanced})
    assert [s for s, _ in slots] == list(range(len(slots))) and sum(units.values()) == mixing.PERIOD
    seen = Counter()
    for at, (_, source) in enumerate(slots, 1):
        seen[source] += 1
        assert all(abs(seen[s] - at * u / mixing.PERIOD) < 1 for s, u in units.items())


def test_variable_fields_generalise(spark):
    lines = [f"connection from host {i} closed after some {i * 7} milliseconds by the remote peer number {i}" for i in range(5)]
    names = [f"thank you dear {n} for your order we will send it to you in the next few days" for n in ("anna", "bert", "carl", "dora")]
    data = [(i, f"own line number {chr(97 + i)} here\n{lines[i]}\n{names[i % 4]}") for i in range(5)]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[0].n_dropped == 0 and all(out[i].text == f"own line number {chr(97 + i)} here" for i in range(1, 5) if i)


def test_short_lines_recur(spark):
    df = spark.createDataFrame([(i, f"{'abcd'[i]} text of its own\nRead more\nShare\n\n \t") for i in range(4)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(df, least_tokens=1).collect()}
    assert out[0].n_dropped == 0 and all(out[i].text == f"{'abcd'[i]} text of its own\n\n \t" and out[i].n_dropped == 2 for i in (1, 2, 3))


def test_long_lines_recur_in_two_documents(spark):
    passage, other = (" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for w in "xy")
    # Lines that only agree in all sections but one are no pair.
    data = [(1, f"{passage}\none short line"), (2, f"own\n{passage}\none short line"), (3, f"{other} one"), (4, f"{other} two")]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(data, "doc_id long, text string"), pair_tokens=50).collect()}
    assert out[2].text == "own\none short line" and [out[i].n_dropped for i in (1, 2, 3, 4)] == [0, 1, 0, 0]


def test_grammar_matches_clauses():
    rows = [(f"you are {x} idiot {y}", 1) for x in "abcdefgh" for y in "klmnop"] + [(f"you are {x} friend {y}", 0) for x in "abcdefgh" for y in "klmnop"]
    model = toxicity.ToxicityModel(rows)
    assert b"idiot" in model.stems
    kinds = lambda t: [k for k, _ in model.matches(t)]
    assert kinds("idiot work") == ["insult"] and kinds("you idiot") == ["directed"] and kinds("he is not an idiot") == ["negated"]
    assert kinds("they said the idiot left") == ["reported"] and kinds("i will kill you") == ["threat"] and kinds("said so. idiot") == ["insult"]
    assert model.score("what an idiot") > 0.5 > model.score("what a friend")


def test_wrapper_finds_constant_and_slots():
    pages = [f"<body><div class='top'>Site name</div><div class='body'><p>Share this page</p><p>{x * 40}</p><p>{x * 30} tail</p></div></body>" for x in ("ab ", "cd ", "ef ", "gh ")]
    path, constant, _ = extract.induce(pages)
    assert path == "/body/div.body" and constant == ["Share this page"]
    assert extract.extract(pages[0], path, frozenset(constant)) == f"{('ab ' * 40).strip()}\n{('ab ' * 30).strip()} tail"


def test_wrapper_keeps_all_of_the_content():
    words = ("ab ", "cd ", "ef ", "gh ")
    parts = lambda x: (f"title {x}".strip(), f"lead {x}".strip(), (x * 90).strip())
    pages = ["<body><div class='top'>Site name</div><div class='content'><h1>{}</h1><p class='lead'>{}</p><div class='text'><p>{}</p></div></div></body>".format(*parts(x)) for x in words]
    path, constant, _ = extract.induce(pages)
    assert [extract.extract(p, path, frozenset(constant)) for p in pages] == ["\n".join(parts(x)) for x in words]
    # The first page is one quotation, others have text around it.
    quoted = [f"<body><div class='c'><blockquote>{x * 90}</blockquote>{f'<p>{x * 9}</p>' if i else ''}</div></body>" for i, x in enumerate(words)]
    path, constant, _ = extract.induce(quoted)
    assert path == "/body/div.c" and extract.extract(quoted[1], path, frozenset(constant)) == f"{('cd ' * 90).strip()}\n{('cd ' * 9).strip()}"
    # Articles of different classes, one of them on no sample page.
    several = [f"<body><article class='one'>{x * 90}</article><article class='two w/2'>{x * 20}</article></body>" for x in words]
    path, constant, _ = extract.induce(several)
    other = several[0].replace("</body>", "<article class='three'>more</article></body>")
    assert extract.extract(other, path, frozenset(constant)) == f"{('ab ' * 90).strip()}\n{('ab ' * 20).strip()}\nmore"
    # Copies of one article that differ in a date.
    copies = [f"<body><div class='c'><div class='date'>{x}</div><p>{'same ' * 50}</p></div></body>" for x in words]
    path, constant, _ = extract.induce(copies)
    assert extract.extract(copies[0], path, frozenset(constant)) == f"ab\n{('same ' * 50).strip()}"


def test_wrapper_aligns_long_lists():
    def page(x, n):
        body = [f"<p>{x} {i} {x * 5}</p>" for i in range(n)]
        return f"<article>{''.join(body[: n // 2])}<p>Subscribe now</p>{''.join(body[n // 2 :])}</article>"

    pages = [page(x, n) for x, n in (("ab", 70), ("cd", 90), ("ef", 81), ("gh", 130))]
    path, constant, _ = extract.induce(pages)
    assert constant == ["Subscribe now"] and extract.extract(pages[0], path, frozenset(constant)).count("\n") == 69
    left, right = ([extract.Node("p", "p") for _ in range(n)] for n in (95, 41))
    cut = list(extract._stretches(left, right))
    assert sum((a for a, _ in cut), []) == left and sum((b for _, b in cut), []) == right


@pytest.mark.parametrize("copies,words", [(30, 60), (1, 20_000)])
def test_wrapper_samples_different_pages(spark, copies, words):
    texts = [f"<article><p>Share this page</p><p>{x * words}</p></article>" for x in ("ab ", "cd ", "ef ", "gh ")]
    df = spark.createDataFrame([(i, f"http://a.b/{i}", t) for i, t in enumerate(texts * copies)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in extract.extract_pages(df).collect()}
    assert len(out) == 4 * copies and out[0] == ("ab " * words).strip() and not any("Share" in x for x in out.values())


def test_wrapper_of_deep_pages(spark):
    texts = [f"<article><p>Share this page</p>{'<b>' * 3000}<p>{x * 60}</p></article>" for x in ("ab ", "cd ", "ef ")]
    df = spark.createDataFrame([(i, "http://a.b/c", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract_pages(df).collect()}[0] == ("ab " * 60).strip()


def test_dictionary_learns_from_whole_texts():
    rng = random.Random(3)
    end = " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(300))
    texts = ["".join(rng.choice("0123456789") for _ in range(41 * quality_model.PIECE_BYTES)) + end for _ in range(8)]
    held = quality_model.zstandard.ZstdCompressionDict(quality_model._dictionary(texts))
    size = lambda **x: len(quality_model.zstandard.ZstdCompressor(level=3, **x).compress(end.encode()))
    assert 2 * size(dict_data=held) < size()


@pytest.mark.parametrize("name,column,least", [("op5_language", "lang", 0.9), ("op6_compression_quality", "quality", 0.85), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/{'documents' if column == 'lang' else 'labels'}.parquet").select("doc_id", column).dropna()
    out = QUERIES[name](spark, sf).filter("held_out").join(truth, "doc_id")
    guess = "lang_pred" if column == "lang" else "predicted"
    right = [r[0] == r[1] for r in out.select(guess, column).collect()]
    assert sum(right) >= least * len(right) > 0
