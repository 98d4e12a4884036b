import random

from pagelathe.llm import boilerplate, residue
from pagelathe.llm.page_blocks import blocks_of, html_lang, pack, pack_body, unpack, unpack_body

TOPICS = "river bridge market garden library engine window teacher orchard harbour valley lantern copper saddle meadow".split()


def sentence(r):
    a, b, c = r.sample(TOPICS, 3)
    return f"The old {a} near the {b} was repaired before the {c} opened in spring."


def page(r, site, semantic=True, body=None, insert=True):
    nav = "".join(f'<li><a href="/{w}">{w.title()} {site}</a>' for w in TOPICS[site : site + 5])
    main = body if body is not None else f"<h1>About the {r.choice(TOPICS)}</h1>" + "".join(f"<p>{sentence(r)} {sentence(r)}" for _ in range(4)) + f"<pre>for x in {r.choice(TOPICS)}: print({r.choice(TOPICS)})</pre><ul><li>{sentence(r)}<li>{sentence(r)}</ul>"
    if insert:
        main += "<p>Sign up for our newsletter and never miss a story</p>" + ("" if body is not None else f"<p>{sentence(r)} {sentence(r)}</p>")
    if semantic:
        return f'<html lang=en><body><header><nav><ul>{nav}</ul></nav></header><main><article>{main}</article></main><footer><p>© 2021 Site {site}. All rights reserved.</footer></body></html>'
    return f'<html lang=en><body><div><ul>{nav}</ul></div><div><div>{main}</div></div><div><p>© 2021 Site {site}. All rights reserved.</div></body></html>'


def corpus(spark, n=80):
    r = random.Random(5)
    rows = [(i, page(r, i % 4, semantic=i % 4 < 2), i % 4, "x") for i in range(n)]
    rows += [(1000, None, 0, "x"), (1001, "", 0, "x"), (1002, "just text", None, "x"), (1003, page(r, 2, semantic=False), 2, "x"), (1003, page(random.Random(1), 2, semantic=False), 2, "x")]
    rows += [(i, page(r, site, semantic=False, body="<p>Kindly wake the hamster behind this window.</p>", insert=False), site, "x") for i, site in ((1004, 3), (1014, 2), (1024, 1), (1034, 0))]
    rows.append((1005, page(r, 1, body="<h1>{{ page.title }}</h1><p>[[author]] ${name}", insert=False), 1, "x"))
    rows.append((1006, page(r, 1, body=f"<h1>Templates</h1><p>{sentence(r)} A template writes {{{{ title }}}} where the old bridge near the market was repaired before.</p><p>{sentence(r)}</p><pre>&lt;h1&gt;{{{{ x }}}}&lt;/h1&gt;</pre>", insert=False), 1, "x"))
    return spark.createDataFrame(rows, "page_id long, html string, site_id int, body string")


def test_blocks():
    source = "<p>a<p>b <b>c</b><ul><li>x<ul><li>y</ul><li>z</ul><blockquote><p>q</p></blockquote><script>'<p>'</script><!-- <p>no --><dl><dt>t<dd>d</dl><H2>H &amp; M</H2><pre>\n a\n</pre>"
    got = [(b.no, b.tag, b.text) for b in blocks_of(source)]
    assert got == [(0, "p", "a"), (1, "p", "b c"), (2, "li", "x"), (3, "li", "y"), (4, "li", "z"), (5, "blockquote", ""), (6, "p", "q"), (7, "dt", "t"), (8, "dd", "d"), (9, "h2", "H & M"), (10, "pre", " a")]
    blocks = blocks_of(source)
    assert unpack(pack(blocks)) == blocks and [b.text for b in unpack_body(pack_body(blocks))] == [b.text for b in blocks]
    assert blocks_of(None) == [] and blocks_of("") == [] and unpack(None) == [] and blocks_of("<p" * 1000) is not None


def test_html_lang():
    assert html_lang('<!doctype html><HTML class=x LANG="pt_BR">') == "pt_BR"
    assert html_lang("<html lang=de>") == "de" and html_lang("<html data-lang=x>") is None and html_lang(None) is None


def test_best_run_against_all_runs():
    random.seed(2)
    from pagelathe.llm.page_blocks import Block

    for _ in range(200):
        n = random.randrange(1, 9)
        blocks = [Block(i, "p", 0, 0, "", random.randrange(4) if i else 0, 0, "x") for i in range(n)]
        scores = [random.uniform(-6, 4) for _ in range(n)]
        got = boilerplate._best_run(blocks, [0.0] * n, scores)
        if max(scores) <= 0:
            continue
        total = lambda a, b: sum(max(s, boilerplate.INSERT_COST) for s in scores[a : b + 1]) - sum(boilerplate.TAG_COST * blocks[i].gap for i in range(a + 1, b + 1))  # noqa: B023, E731
        a, b = max(((a, b) for a in range(n) for b in range(a, n)), key=lambda ab: total(*ab))
        assert [x.no for x in got] == [i for i in range(a, b + 1) if scores[i] > 0]


def test_main_bodies(spark):
    df = corpus(spark)
    rows = {}
    for r in boilerplate.main_bodies(df).collect():
        rows.setdefault(r.page_id, []).append([b.text for b in unpack_body(r.body)])
    for i in (*range(80), 1003):
        for texts in rows[i]:
            assert texts[0].startswith("About the") and any(t.startswith("for x in") for t in texts), i
            assert not any("newsletter" in t or "©" in t or t.endswith((" 0", " 1", " 2", " 3")) for t in texts), (i, texts)
    assert rows[1000] == rows[1001] == rows[1002] == [[]]
    assert rows[1004] == [["Kindly wake the hamster behind this window."]] and len(rows[1003]) == 2
    assert boilerplate.p2_found(df.limit(0)).count() == 0
    assert {r.block_no for r in boilerplate.p2_found(df).where("page_id = 1004").collect()} == {5}


def test_residue_of_pages_and_records(spark):
    reasons = ["timeout after 3 ms"] * 40 + ["robots: disallowed (/u/{id}/*)"] * 40 + ["HTTP 404"] * 30 + ["blocked: the page needs JavaScript and the static driver cannot render"] * 20
    odd = ["{{ reason }}", "undefined", "The gnome that keeps our shelves has left", "robots: {{verdict.reason}}", "lorem ipsum dolor sit amet", "kindly wake the hamster behind this window", None, "  "]
    rows = [(i, ("error", r), "x") for i, r in enumerate(reasons)] + [(900 + i, ("error", r), "x") for i, r in enumerate(odd)]
    rows += [(950, ("skipped", odd[2]), "x"), (999, None, "x")]  # a message under two kinds is no reason of the crawler's own
    records = spark.createDataFrame(rows, "record_id long, outcome struct<kind:string,reason:string>, score string")
    found = {(r.origin, r.row_id) for r in residue.p3_found(corpus(spark), records).collect()}
    assert found == {("page", i) for i in (1004, 1014, 1024, 1034, 1005)} | {("record", 900 + i) for i in range(6)} | {("record", 950)}
    assert residue.p3_found(corpus(spark).limit(0), records.limit(0)).count() == 0


def test_scorer_is_the_model():
    model = residue.fit((residue.tokens(t), 1.0) for t in ["the old bridge was repaired", "the market opened in spring", "{{ x }}", "please reload"])
    scorer = residue.Scorer(model)
    for t in ["{{ x }} again", "xxxx yyyy", "日本語のページ", "NaN", "errors.fetch.generic", "<b>hi</b> there", "", "test test test test"]:
        assert abs(scorer.text(t) - model.score(residue.tokens(t))) < 1e-9 or scorer.text(t) == model.score(residue.tokens(t))
