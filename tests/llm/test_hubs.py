"""Nodes beside a hub: every pair that reaches the threshold is found, and few others."""

import random
from itertools import combinations

import pytest

from starloom.llm import near_dup

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text, size=4):
    words = text.split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def frames(spark, texts, roots):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    families = spark.createDataFrame([(0, i, r) for i, r in enumerate(roots)], "hub long, node long, root long")
    return families, docs


def linked(texts, roots):
    sets = [shingles(t) for t in texts]
    for a, b in combinations(range(1, len(texts)), 2):
        if roots[a] != roots[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            yield b, a


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_pair_is_missed(spark, seed):
    """Parts of the hub of all lengths, edited parts, and texts with shared passages of their own, some in one component."""
    rng = random.Random(seed)
    hub = rng.choices(WORDS, k=600)
    own = rng.choices(WORDS, k=80)
    texts = [" ".join(hub)]
    for _ in range(220):
        kind, at = rng.random(), rng.randrange(560)
        if kind < 0.4:
            words = hub[at : at + rng.randrange(8, 40)]
        elif kind < 0.7:
            words = list(hub[50 : 50 + rng.choice([30, 200])])
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(WORDS[:5])
        else:
            words = hub[100:130] + own[: rng.randrange(20, 80)]
        texts.append(" ".join(words))
    roots = [0, *(rng.choice([i, 0, 7]) for i in range(1, len(texts)))]
    pairs = {(max(r.a, r.b), min(r.a, r.b)) for r in near_dup._beside_hubs(*frames(spark, texts, roots), 4, 80).collect()}
    want = set(linked(texts, roots))
    assert want and want <= pairs


def test_many_short_parts_of_one_text(spark):
    """20,000 parts of one long text: pairs grow with the overlaps, not with the square of the parts."""
    rng = random.Random(4)
    hub = [f"{rng.choice(WORDS)}{i}" for i in range(30_000)]
    starts = [rng.randrange(len(hub) - 30) for _ in range(20_000)]
    texts = [" ".join(hub), *(" ".join(hub[s : s + 30]) for s in starts)]
    pairs = near_dup._beside_hubs(*frames(spark, texts, range(len(texts))), 4, 80).distinct().count()
    # Parts are linked if they begin at most two words apart: 27 shingles each, 25 of 29 in common.
    spots = {}
    for s in starts:
        spots[s] = spots.get(s, 0) + 1
    near = sum(n * (n - 1) // 2 + n * sum(spots.get(s + d, 0) for d in (1, 2, 3)) for s, n in spots.items())
    assert near <= pairs <= 3 * near < 20_000**2 / 500
