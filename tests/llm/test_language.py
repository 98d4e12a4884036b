import itertools
import random

import numpy as np
import pytest

from pagelathe.llm import language

TEXTS = {
    "en": "The workers repaired the old bridge before the winter, because nobody wanted to wait for the spring",
    "de": "Die Arbeiter haben die alte Brücke vor dem Winter repariert, weil niemand auf den Frühling warten wollte",
    "fr": "Les ouvriers ont réparé le vieux pont avant l'hiver, parce que personne ne voulait attendre le printemps",
    "es": "Los obreros repararon el puente viejo antes del invierno, porque nadie quería esperar la primavera",
    "it": "Gli operai hanno riparato il vecchio ponte prima dell'inverno, perché nessuno voleva aspettare la primavera",
    "pt": "Os operários repararam a ponte velha antes do inverno, porque ninguém queria esperar pela primavera",
    "nl": "De arbeiders hebben de oude brug voor de winter hersteld, omdat niemand op de lente wilde wachten",
    "ru": "Рабочие починили старый мост перед зимой, потому что никто не хотел ждать весны",
    "ja": "作業員は冬の前に古い橋を修理しました。だれも春を待ちたくなかったからです。",
    "zh": "工人们在冬天之前修好了旧桥，因为没有人愿意等到春天。",
}


@pytest.fixture(scope="module")
def model():
    return language.fit_languages([(t, lang) for lang, t in TEXTS.items()] * 3)


def test_everyday_words_alone():
    labeller = language.Labeller(language.fit_languages([]))
    for (found, *_), lang in zip(labeller.texts([[t] for t in TEXTS.values()]), TEXTS):
        assert language.LANGUAGES[found[0]] == lang


@pytest.mark.parametrize(("written", "want"), [("en", "en"), ("EN-us", "en"), ("pt_BR", "pt"), ("Deutsch", "de"), (" español ", "es"), ("jpn", "ja"), ("zh-Hans", "zh"), ("mul", None), ("x-default", None), ("", None), (None, None), ("xx", None), ("en, fr", None), ("9", None), ("nb", "nb")])
def test_labels(written, want):
    assert language.label_of(written) == want


def test_forward_backward_against_all_paths():
    random.seed(1)
    k = 3
    for n in (1, 2, 4):
        e = np.array([[[random.random() + 0.1 for _ in range(k)]] for _ in range(n)], dtype=np.float32)
        a = np.random.default_rng(n).random((k, k)).astype(np.float32)
        a /= a.sum(axis=1, keepdims=True)
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            w = 1.0
            for t, s in enumerate(path):
                w *= e[t, 0, s] * (a[path[t - 1], s] if t else 1 / k)
            for t, s in enumerate(path):
                want[t, s] += w
        got = language._forward_backward(e, np.array([n]), a)[:, 0, :]
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_padding_changes_nothing(model):
    texts = [["\n".join([t] * k)] for k, t in enumerate(TEXTS.values(), 1)] + [["x", "", "…"], []]
    labeller = language.Labeller(model)
    together = labeller.texts(texts)
    for t, (found, sure, chars, words, _) in zip(texts, together):
        f, s, c, w, _ = labeller.texts([t])[0]
        assert (f == found).all() and np.allclose(s, sure, atol=1e-4) and np.allclose(c, chars, atol=1e-2) and (w == words).all()


def test_gradient_of_the_field_against_differences():
    draw = np.random.default_rng(4)
    z, t = draw.normal(size=(5, 3)), draw.normal(size=(3, 3))
    sizes = np.array([1, 4, 3])
    ids, gold = draw.integers(5, size=8), draw.integers(3, size=8)

    def brute(z, t):
        total, at = 0.0, 0
        for n in sizes:
            score = lambda path: sum(z[w, y] for w, y in zip(ids[at : at + n], path)) + sum(t[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            total += score(gold[at : at + n]) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=int(n))))
            at += n
        return total

    value, gz, gt = language.log_likelihood(z, t, ids, gold, sizes)
    assert value == pytest.approx(brute(z, t))
    for m, g in ((z, gz), (t, gt)):
        for i, j in itertools.product(range(m.shape[0]), range(3)):
            d = np.zeros_like(m)
            d[i, j] = 1e-5
            change = brute(z + d, t) - brute(z - d, t) if m is z else brute(z, t + d) - brute(z, t - d)
            assert g[i, j] == pytest.approx(change / 2e-5, abs=1e-6)


def test_words_are_looked_at_whole():
    assert language.parts_of("cssを使います") == ["css", "を使", "いま", "す"]
    assert "".join(language.parts_of("a" * 95)) == "a" * 95 and language.parts_of("straße") == ["straße"]


def test_languages_that_are_not_known(model):
    labeller = language.Labeller(model)
    for text, want in (("오래된 다리는 겨울 전에 수리되었습니다", "ko"), ("إصلاح الجسر القديم قبل الشتاء", "ar"), (TEXTS["ja"], "ja")):
        assert language.verdicts([text], lambda: [False], lambda: [False], *labeller.texts([[text]])[0])[0] == want
    taught = language.LanguageModel(model.weights, model.words, model.lines, model.seen, np.ones(len(language.LANGUAGES), dtype=bool))
    for text, want in (("Robotnicy naprawili stary most przed zimą, gdyż nikt nie chciał czekać wiosny", None), (TEXTS["de"], "de")):
        assert language.verdicts([text], lambda: [False], lambda: [False], *language.Labeller(taught).texts([[text]])[0])[0] == want


def test_quotations_make_no_text_mixed(spark, model):
    rows = [(1, f"{TEXTS['en']}\n{TEXTS['en']}\n> {TEXTS['es']}"), (2, f"{TEXTS['en']}\n{TEXTS['en']}\n{TEXTS['es']}")]
    assert [r.mixed for r in language.segment_languages(frame(spark, rows), model).orderBy("row_id").collect()] == [False, True]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "de-AT") for r in rows], "row_id long, text string, written string")


def test_segments(spark, model):
    code = "    at collect (/srv/site.js:25:8)"
    rows = [
        (1, TEXTS["de"]), (2, f"{TEXTS['en']}, {TEXTS['en']}\n\n{TEXTS['fr']}\n{code}"), (3, f"{TEXTS['nl']}\n{code}\nfor row in rows: print(row);"), (4, f'{TEXTS["en"]} “{TEXTS["es"][:22]}”, they said'),
        (5, None), (6, ""), (7, "12 34 …"), (8, TEXTS["ja"] * 300), (1, TEXTS["de"]), (9, "x" * 5000 + " " + TEXTS["ru"]),
    ]
    got = language.segment_languages(frame(spark, rows), model).collect()
    by = {r.row_id: r for r in got}
    assert [by[i].lang for i in range(1, 10)] == ["de", "en", "nl", "en", None, None, None, "ja", "ru"] and len(got) == 10
    assert [by[i].mixed for i in range(1, 10)] == [False, True] + [False] * 7
    assert {r.code for r in got} == {"de"}
    assert by[2].segment_nos == [0, 2, 3] and by[2].segment_langs == ["en", "fr", "fr"]


def test_found(spark):
    docs = [(i, TEXTS[lang], lang, "x") for i, lang in enumerate(TEXTS)]
    docs += [(100, TEXTS["en"], "de", "x"), (101, TEXTS["fr"], None, "x"), (102, TEXTS["de"], "de-AT", "x"), (103, None, None, "x"), (104, f"{TEXTS['en']}\n{TEXTS['es']}\n{TEXTS['es']}", "es", "x")]
    page = lambda lang, text: f'<html lang="{lang}"><body><main><article><h1>{text[:20]}</h1><p>{text}<p>{text}</article></main></body></html>'
    pages = spark.createDataFrame([(1, page("fr", TEXTS["nl"]), 1, "x"), (2, page("nl", TEXTS["nl"]), 1, "x"), (3, None, 1, "x"), (4, "<html lang=en><body><p>Please enable scripts and reload this page.</p></body></html>", 1, "x")], "page_id long, html string, site_id int, lang string")
    reports = spark.createDataFrame([(50, 1, "nl"), (51, 2, "Dutch"), (52, 2, None), (53, 3, None), (54, 4, None), (55, None, "x")], "report_id long, page_id long, language string")
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, code string")
    records = spark.createDataFrame([(1, ("error", "Please enable scripts and reload this page."))], "record_id long, outcome struct<kind:string,reason:string>")
    got = {tuple(r) for r in language.p4_found(documents, pages, reports, records).collect()}
    assert got == {
        ("document", 100, -1, "en"), ("document", 101, -1, "fr"), ("document", 104, 0, "en"), ("document", 104, 1, "es"), ("document", 104, 2, "es"), ("page", 1, -1, "nl"), ("report", 52, -1, "nl"),
    }
    assert language.p4_found(documents.limit(0), pages.limit(0), reports.limit(0), records).count() == 0
