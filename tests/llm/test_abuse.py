import random
from itertools import combinations

import numpy as np
import pytest

from pagelathe.llm import abuse

TOPICS = "river bridge market garden library engine window teacher orchard harbour valley lantern copper saddle meadow".split()


def clean(r):
    a, b, c = r.sample(TOPICS, 3)
    return f"The old {a} near the {b} was repaired before the {c} opened."


def corpus(n=400):
    r = random.Random(3)
    insults = ["You are a rotten {} and nobody likes you", "Shut up, you stupid {}", "What a pathetic {} you are"]
    rows = []
    for i in range(n):
        text = " ".join(clean(r) for _ in range(4))
        bad = i % 5 == 0
        if bad:
            text += " " + r.choice(insults).format(r.choice(["blockhead", "nitwit", "dunce"])) + "."
        rows.append((text, bad if r.random() > 0.05 else not bad))
    return rows


@pytest.fixture(scope="module")
def model():
    return abuse.fit_abuse(corpus())


def test_kernel_against_brute_force():
    def features(row):
        codes, starts, lengths = abuse._coded([row])
        out = {}
        for p, w in abuse.SHAPES:
            for steps in combinations(range(1, w), p - 1):
                for i in range(len(row)):
                    key = (p, *[int(codes[i + s]) for s in (0, *steps)])
                    out[key] = out.get(key, 0.0) + abuse.DECAY ** (steps[-1] - (p - 1))
        return out

    rows = ["you are a nitwit", "nit wit", "the bridge", "馬鹿者"]
    got = abuse.kernel(rows, rows, chunk=2)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            fa, fb = features(a), features(b)
            want = sum(v * fb.get(k, 0.0) for k, v in fa.items()) / np.sqrt((len(a) + 8) * (len(b) + 8))
            assert got[i, j] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_folded_table_is_the_kernel_sum():
    marks, rows = ["you nitwit", "the old bridge"], ["such a nit-wit", "a bridge, old"]
    alpha = np.array([1.5, -0.5])
    m = abuse.AbuseModel(abuse.table_of(marks, alpha), 0.25, 0.0)
    assert np.allclose(m.sentence_scores(rows), abuse.kernel(rows, marks) @ alpha + 0.25, atol=1e-4)


@pytest.mark.parametrize(("text", "want"), [("You 1d10t!", ["you idiot"]), ("a c l o w n here", ["aclown here"]), ("stuuupid", ["stupid"]), ("wо*rthless", ["worthles"]), ("i​d​i​o​t", ["idiot"]), (None, []), (" \n ", []), ("Ｆｏｏ. Bar", ["fo", "bar"])])
def test_disguises(text, want):
    assert abuse.normal_sentences(text) == want


def test_held_out(model):
    r = random.Random(9)
    bad = ["Shut up, you stupid nitwit.", "You are a r0tt3n d u n c e and nobody likes you!", "what a pathetic nit*wit you are.", "You idiot, go kill yourself!", "halt die klappe, du idiot!"]
    good = [clean(r) for _ in range(50)] + ["The report counts insults by language.", "The dumb terminal mode prints plain text."]
    assert all(s > model.threshold for s in model.texts([clean(r) + " " + b + " " + clean(r) for b in bad]))
    assert sum(s > model.threshold for s in model.texts(good)) <= 1


def test_long_texts_hide_nothing(model):
    r = random.Random(1)
    long = " ".join(clean(r) for _ in range(3000))
    run_on = long.replace(".", ",")[:4000]
    scores = model.texts([long, long + " Shut up, you stupid nitwit.", run_on + " shut up, you stupid nitwit you rotten dunce " + run_on])
    assert scores[0] <= model.threshold < scores[1] and scores[2] > scores[0]


def test_documents(spark, model):
    rows = [(1, "Shut up, you stupid nitwit.", "Forum ", "x"), (2, "The old bridge near the market was repaired.", "forum", "x"), (3, None, None, "x"), (4, "", " ", "x"), (5, "!!!", "f", "x"), (1, "Shut up, you stupid nitwit.", "Forum ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    got = sorted((r.doc_id, r.source, r.score is None, r.abusive) for r in abuse.abuse_scores(df, model).collect())
    assert got == [(1, "forum", False, True), (1, "forum", False, True), (2, "forum", False, False), (3, "(none)", True, False), (4, "(none)", True, False), (5, "f", True, False)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, 1), (3, None), (1, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert {r.doc_id for r in abuse.p8_found(df, labels).collect()} == {1}
    rates = {r.source: (r.docs, r.abusive_docs) for r in abuse.p8_rates(df, labels).collect()}
    assert rates["forum"] == (3, 2)
    assert abuse.p8_found(df.limit(0), labels.limit(0)).count() == 0
