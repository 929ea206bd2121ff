"""The clause grammar against brute-force parses in four languages, and what the fit may not turn around."""

import random

import pytest

from starloom.llm import toxicity as t

FILLER = {"en": "a friend left early today with the red house old dog".split(), "de": "ein freund ging heute früh mit dem alten hund".split(), "fr": "un ami est parti avec la vieille maison".split(), "es": "un amigo salió hoy con la casa vieja".split()}
INSULTS = {"en": ["idiot", "idiots", "clownish"], "de": ["dummkopf", "dummköpfe"], "fr": ["crétin", "crétins"], "es": ["tonto", "tontos"]}
WORDS = {
    "en": (["kill", "destroy"], ["you", "him", "they"], ["not", "never", "isn't"], ["said", "wrote"]),
    "de": (["töten", "schlagen"], ["du", "dich"], ["nicht", "kein"], ["sagte", "schrieb"]),
    "fr": (["tuer", "frapper"], ["toi", "vous"], ["pas", "jamais"], ["dit", "écrit"]),
    "es": (["matar", "golpear"], ["usted", "ellos"], ["nunca", "tampoco"], ["dijo", "escribió"]),
}
STEMS = {b"idiot": 6.0, b"clown": 5.0, "dummk".encode(): 6.0, "crétin".encode(): 4.0, b"tonto": 7.0}


def model():
    rows = [(f"you are {x} idiot {y}", 1) for x in "abcdefgh" for y in "klmnop"] + [(f"you are {x} friend {y}", 0) for x in "abcdefgh" for y in "klmnop"]
    out = t.ToxicityModel(rows)
    out.stems = dict(STEMS)
    del out._words, out._grammar
    return out


def clauses(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        lang = rng.choice(list(FILLER))
        words = []
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            pool = FILLER[lang] if kind < 0.45 else INSULTS[lang] if kind < 0.6 else WORDS[lang][rng.randrange(4)]
            words.append(rng.choice(pool))
        yield lang, words


def parsed(lang, words, reach=3):
    """Each word by what stands before it, read off the positions."""
    threats, targets, negations, reports = ([i for i, w in enumerate(words) if w in WORDS[lang][k]] for k in range(4))
    within = lambda places, i: [j for j in places if i - reach <= j < i]
    out = []
    for i, w in enumerate(words):
        softer = "reported" if any(j < i for j in reports) else "negated" if within(negations, i) else None
        if w in INSULTS[lang]:
            out.append(softer or ("directed" if within(targets, i) else "insult"))
        elif i in threats and within(targets, i):
            out.append(softer or "threat")
        elif i in targets and any(not any(j < k < i for k in targets) for j in within(threats, i)):
            out.append(softer or "threat")
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parses(seed):
    grammar, kinds = model(), set()
    for lang, words in clauses(seed, 400):
        want = parsed(lang, words)
        kinds |= set(want)
        assert [k for k, _ in grammar.matches(" ".join(words))] == want, words
    assert kinds == set(t.KINDS)


def test_clauses_are_parsed_one_by_one():
    rng, grammar = random.Random(4), model()
    pairs = list(clauses(5, 200))
    for _ in range(60):
        some = rng.sample(pairs, 3)
        text = "".join(" ".join(w) + rng.choice([". ", "! ", "\n", "; "]) for _, w in some)
        assert [k for k, _ in grammar.matches(text)] == [k for lang, w in some for k in parsed(lang, w)]


def fitted(extra=()):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = rng.choices([f"w{k}" for k in range(200)], k=20)
        if i % 4 == 0:
            words[rng.randrange(20)] = rng.choice(["idiot", "idiots", "moron"])
            # Where labels alone decide, negation looks like a sign of toxicity here.
            words[0] = rng.choice(["not", "never", words[0]])
        rows.append((" ".join(words), int(i % 4 == 0)))
    return t.ToxicityModel(rows + list(extra))


def test_order_of_scores():
    m = fitted()
    plain, directed, none = m.score("the idiot left early"), m.score("you idiot left early"), m.score("the friend left early")
    negated, reported = m.score("he is not an idiot at all"), m.score("they said he is an idiot")
    threat, softer = m.score("i will kill you now"), m.score("i will never kill you")
    assert none <= negated < plain <= directed and none <= reported < plain
    assert plain >= t.THRESHOLD > max(negated, reported, softer, none) and threat >= t.THRESHOLD
    assert m.score("not an idiot. " * 50) == m.score("not an idiot")
    assert m.score("the idiot and the moron. the idiot") > plain


def test_labels_may_clear_threats():
    harmless = [(f"the players kill you in round {chr(97 + i)}", 0) for i in range(26)]
    assert fitted(harmless).score("i will kill you now") < t.THRESHOLD <= fitted(harmless[:10]).score("i will kill you now")


def test_models_without_insults_or_labels():
    m = t.ToxicityModel([("good day", 0)] * 9 + [("bad day", 1)])
    assert m.stems == {} and m.score("i will kill you") >= t.THRESHOLD > m.score("hello") and 0 <= m.score(None) <= 1
    assert t.ToxicityModel([]).score("i will kill you") == 0.0 and t.ToxicityModel([("x", 1)]).score("") == 1.0
