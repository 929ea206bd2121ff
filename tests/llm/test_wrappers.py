"""Wrapper induction where no name tells anything: the given pages as nested divisions with random class names."""

import random
import re

import pytest

from starloom.llm import extract as x

SF_DIR = "/root/testdata/sf0.01"


def soup(html, host):
    """The page with divisions for all named elements, and with class names that are random and fixed for the host."""
    rng = random.Random(host)
    names = {t: "".join(rng.choices("bcdfghjkmnpqrvwxz", k=7)) for t in ("article", "nav", "footer", "ad")}
    for tag in ("article", "nav", "footer"):
        html = re.sub(rf"<{tag}\b[^>]*>", f'<div class="{names[tag]}">', html).replace(f"</{tag}>", "</div>")
    return html.replace('class="ad"', f'id="{names["ad"]}"')


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")


def texts(df):
    return {r.page_id: r.text for r in x.extract_pages(df).collect()}


def test_alignment_finds_the_content_without_names(spark, pages):
    rows = [r for r in pages.collect() if r.html]
    hosts = {}
    for r in rows:
        hosts.setdefault(r.url.split("/")[2], set()).add(r.html)
    large = {h for h, own in hosts.items() if len(own) >= x.LEAST_PAGES}
    rows = [r for r in rows if r.url.split("/")[2] in large]
    df = spark.createDataFrame([(r.page_id, r.url, soup(r.html, r.url.split("/")[2])) for r in rows], pages.schema)
    want, got = texts(pages), texts(df)
    assert len(got) > 150 and all(got[i] == want[i] for i in got)
    alone = {r.page_id: x.extract(soup(r.html, r.url.split("/")[2])) for r in rows}
    assert not any(alone[i] == got[i] for i in got)


WORDS = ["".join(random.Random(i).choices("abcdefghij", k=random.Random(i).randrange(3, 9))) for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def site(rng, title_in_box=False, menu=False, links=5):
    """A page of divisions: links, an advert, the content with a constant notice inside, a foot."""
    anchors = lambda n: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choices(WORDS, k=n))
    title, lead = prose(rng, 5), prose(rng, 12)
    body = [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 9))]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    inner = f"<p>Subscribe to our letter</p>{f'<ul>{anchors(links)}</ul>' if menu else ''}{paragraphs}"
    if title_in_box:
        content = f"<div class='qa'><div class='qb'><h1>{title}</h1></div><div class='qc'>{lead}</div><div class='qd'>{inner}</div></div>"
    else:
        content = f"<div class='qa'><h1>{title}</h1><div class='qc'>{lead}</div>{inner}</div>"
    page = f"<body><div class='qx'><ul>{anchors(6)}</ul></div><div class='qy'>{prose(rng, 6)}</div>{content}<div class='qz'>&copy; site {prose(rng, 4)}</div></body>"
    return page, "\n".join([title, lead, *body])


@pytest.mark.parametrize("kind", [{}, {"title_in_box": True}, {"menu": True}, {"title_in_box": True, "menu": True}])
@pytest.mark.parametrize("seed", range(4))
def test_divisions(seed, kind):
    rng = random.Random(seed)
    made = [site(rng, **kind) for _ in range(6)]
    path, constant, menus = x.induce([p for p, _ in made])
    assert constant == ["Subscribe to our letter"] and bool(menus) == bool(kind.get("menu"))
    for page, want in [*made, *(site(rng, **kind) for _ in range(5))]:
        assert x.extract(page, path, frozenset(constant), frozenset(menus)) == want
        # Neither the template's texts nor its places are known without the alignment.
        assert x.extract(page) != want and x.extract(page, path) != want


def test_names_break_ties():
    """Small parts beside the text stay if the host's names say which parts are none of it."""
    rng = random.Random(9)

    def page():
        lead, text = prose(rng, 10), prose(rng, 90)
        return f"<body><div class='advert'>{prose(rng, 9)}</div><div class='intro'>{lead}</div><div class='text'>{text}</div></body>", f"{lead}\n{text}"

    made = [page() for _ in range(5)]
    path, constant, menus = x.induce([p for p, _ in made])
    assert all(x.extract(p, path, frozenset(constant), frozenset(menus)) == want for p, want in made)


def test_constant_text_needs_enough_pages():
    pages = [f"<article><p>Share this page</p><p>{w * 30}</p></article>" for w in ("ab ", "cd ")]
    path, constant, _ = x.induce(pages)
    assert constant == [] and x.extract(pages[0], path) == f"Share this page\n{('ab ' * 30).strip()}"


def test_one_host_with_most_pages_is_spread(spark):
    """Pages are not dealt out by host: the join with few wrappers is a broadcast."""
    rng = random.Random(3)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 9}'}.example.com/{i}", site(rng)[0]) for i in range(90)]
    out = x.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == 90
