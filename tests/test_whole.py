import random

from pagelathe.operators import crawls, page_tree
from pagelathe.plans import core_queries
from pagelathe.sources.dom import parse

MENU = "<div class='m'><a href='/a'>Home</a><a href='/b'>Shop</a></div>"
TEXT = "The bridge was repaired in spring and the road opened again. " * 5


def test_main_region_is_inferred_without_a_landmark(spark, tmp_path):
    plain = f"<body>{MENU}<div><div id='text'><p>{TEXT}</p><p>{TEXT[:61]}</p></div><div>Imprint</div></div></body>"
    rows = [
        (1, plain),
        (2, "<body><nav>only a menu</nav></body>"),
        (3, None),
        (4, f"<body><main>hi</main><div>{TEXT}</div></body>"),
        (5, f"<body><nav>{'x' * 25}</nav><div><p>{'y' * 30}</p><p>{'z' * 20}</p></div></body>"),
    ]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in core_queries.queries()["content_split"](spark, str(tmp_path)).collect()}
    # the paragraph holds over 60 % of the text, below both of its wrappers; the menu and the imprint are left out
    assert got[1].main_chars == len(TEXT.strip()) and got[1].total_chars > got[1].main_chars
    assert got[1].confidence == round(0.25 + 0.35 * got[1].main_chars / got[1].total_chars, 2)
    assert (got[2].main_chars, got[2].frame_chars, got[2].confidence) == (0, 11, 0.1)
    assert (got[3].total_chars, got[3].confidence) == (0, 0.0)
    assert got[4].main_chars == 2 and 0.75 <= got[4].confidence < 0.77
    # the first paragraph is exactly 60 % of the div, so it is preferred to it
    assert (got[5].main_chars, got[5].frame_chars, got[5].total_chars, got[5].confidence) == (30, 25, 75, 0.39)


def test_components_by_family_and_repetition():
    page = (
        "<body class='x'><div class='sidebar'>a</div><div class='promo'>b</div><p class='q'>1</p><p class='q'>2</p>"
        "<a class='btn btn-primary' href='/'>go</a><input type='submit'><span class='Product-Card'>c</span><div class='tile'>t</div>"
        "<ul><li>1</li><li>2</li></ul><h1>t</h1><h3>u</h3><a href='/'>l</a><section role='tab'>s</section></body>"
    )
    got = {}
    for r in page_tree.inventory(parse(page)):
        got.setdefault((r["kind"], r["count"]), []).append((r["signature"], r["n"], r["examples"]))
    assert list(got) == [("button", 2), ("card", 2), ("heading", 2), ("li", 2), ("p", 2)]  # one link, one tab, one-off divs: none
    assert [v[0] for v in got["button", 2]] == ["a.btn.btn-primary>#text", "input"]
    assert got["p", 2] == [("p.q>#text", 2, [[2], [3]])] and got["li", 2] == [("li>#text", 2, [[8, 0], [8, 1]])]
    many = "<body>" + "".join(f"<a class='{chr(97 + i)}' href='/'>x</a>" for i in range(12)) + "</body>"
    rows = page_tree.inventory(parse(many))
    assert len(rows) == 8 and {r["count"] for r in rows} == {12}


def replayed(rows):
    """The first reason by replay of the outcomes one by one."""
    state, total = {}, 0
    for host, seq, at, ok, failed in rows:
        held = state.setdefault(host, [0, None])
        if ok:
            held[:] = [0, None]
        elif failed:
            held[0] += 1
            total += 1
            held[1] = at + min(1000 * 2 ** (held[0] - 1), 60000)
            if held[0] >= 5:
                return seq, "consecutive-errors", host, held[0]
            if len(state) >= 3 and all(r is not None and r > at for _, r in state.values()):
                return seq, "all-hosts-failing", None, len(state)
            if total >= 50:
                return seq, "error-budget", None, total
    return None


def test_first_stop_of_a_crawl(spark):
    schema = "host string, seq long, at_ms long, ok boolean, failed boolean"
    # errors spread over hosts, no streak of five: the budget ends it
    spread = [(f"h{i % 40}", i, i * 5000, i % 3 == 2, i % 3 != 2) for i in range(120)]
    cases = [spread, [(h, i, i * 100, False, True) for i, h in enumerate("abc")], [("a", i, i * 100, False, True) for i in range(7)], [("a", 0, 0, True, False)]]
    random.seed(11)
    for step, p in ((300, 0.7), (4000, 0.5)):
        cases.append([(random.choice("abcd"), i, i * step, (x := random.random()) > p, x < p - 0.1) for i in range(150)])
    kinds = set()
    for rows in cases:
        got = [tuple(r) for r in crawls.crawl_stop(spark.createDataFrame(rows, schema)).collect()]
        want = replayed(rows)
        assert got == ([want] if want else []), (got, want)
        kinds.add(want and want[1])
    assert kinds == {None, "consecutive-errors", "all-hosts-failing", "error-budget"}
