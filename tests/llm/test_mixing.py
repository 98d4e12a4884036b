import pytest

from pagelathe.llm import mixing


def test_exponent_meets_the_caps():
    targets, capacity = [0.5, 0.3, 0.2], [1000.0, 30.0, 400.0]
    assert mixing.exponent_for_caps(targets, capacity, 50.0) == 0.0
    for budget in (200.0, 700.0, 1430.0):
        a = mixing.exponent_for_caps(targets, capacity, budget)
        shares = mixing.temperature(targets, capacity, a)
        assert 0 < a <= 1 and all(budget * p <= c * (1 + 1e-6) for p, c in zip(shares, capacity))
        less = mixing.temperature(targets, capacity, a - 1e-3)
        assert any(budget * p > c for p, c in zip(less, capacity))
    assert mixing.full_budget(targets, capacity) == pytest.approx(100.0)


def test_exponent_meets_an_entropy():
    tokens = [900.0, 100.0, 0.0]
    a = mixing.exponent_for_entropy(tokens, 0.5)
    assert 0 < a < 1 and mixing.entropy(mixing.temperature([1.0, 1.0, 1.0], tokens, a)) == pytest.approx(0.5, abs=1e-6)


def test_full_sources_leave_the_rest_to_others():
    assert mixing.within([0.5, 0.5, 0.0], [10.0, 100.0, 50.0], 60.0) == pytest.approx([10.0, 50.0, 0.0])
    assert mixing.within([0.5, 0.5], [10.0, 20.0], 60.0) == pytest.approx([10.0, 20.0]) and mixing.within([0.0], [5.0], 3.0) == [0.0]


@pytest.fixture
def tables(spark):
    words = "the quick brown fox jumps over it"
    docs = [(i, " ".join([words] * (1 + i % 5)), source, "x") for i, source in enumerate(["big"] * 300 + ["Small "] * 10 + [None] * 3 + [" "] * 2 + ["untargeted"] * 4)]
    docs += [(900, None, "big", "x"), (901, "", "big", "x"), (0, " ".join([words] * 1), "big", "x")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string"), targets


def test_shares_and_repeats(tables):
    docs, targets = tables
    plan, report = mixing.mix(docs, targets, budget=mixing.LARGEST, block_docs=40)
    rows = {r.source: r for r in report.collect()}
    assert rows["big"].reached_share == pytest.approx(2 / 3, abs=0.02) and rows["small"].reached_share == pytest.approx(1 / 3, abs=0.02)
    assert rows["small"].most_repeats == 3 and rows["big"].most_repeats == 1
    assert rows["absent"].docs == 0 and rows["absent"].used_tokens == 0 and rows["(none)"].docs == 5
    assert all(r.max_repeats is None or r.most_repeats <= r.max_repeats for r in rows.values())
    used = plan.collect()
    assert len(used) == 322 and all(r.times == 0 for r in used if r.source in ("untargeted", "(none)") or r.n_tokens == 0)


def test_blocks_are_exact(tables):
    """However the permutation is cut into blocks, a source's tokens end within one document of its budget."""
    docs, targets = tables
    for n in (7, 100, 10_000):
        report = {r.source: r for r in mixing.mix(docs, targets, budget=mixing.LARGEST, block_docs=n)[1].collect()}
        whole = sum(r.used_tokens for r in report.values())
        assert abs(report["big"].used_tokens - whole * 2 / 3) <= 60


def test_larger_budget_gives_way(tables):
    docs, targets = tables
    report = {r.source: r for r in mixing.mix(docs, targets, budget=1e9)[1].collect()}
    assert report["big"].reached_share > 0.9 and report["small"].most_repeats == 3
    whole = mixing.mix(docs, targets)[1].collect()
    assert {0 < r.exponent < 1 for r in whole} == {True} and all(r.max_repeats is None or r.most_repeats <= r.max_repeats for r in whole)
    assert sum(r.used_tokens for r in whole) == pytest.approx(sum(r.tokens for r in whole if r.target_share), abs=100)


def test_entropy_of_the_targets(tables):
    docs, targets = tables
    rows = [r for r in mixing.p7_shares_entropy(docs, targets).collect() if r.weight > 0]
    assert 0 < rows[0].exponent < 1 and mixing.entropy([r.weight for r in rows]) == pytest.approx(mixing.entropy([2 / 3, 1 / 3]), abs=1e-6)


def test_permutation_reads_each_use_once(tables):
    docs, targets = tables
    plan, report = mixing.mix(docs.where("doc_id > 0"), targets, block_docs=40)
    uses = mixing.permutation(plan, 3).collect()
    assert len(uses) == sum(r.times for r in plan.collect()) and len({(r.source, r["pass"], r.block, r.position) for r in uses}) == len(uses)
    assert sum(r.n_tokens for r in uses) == sum(r.used_tokens for r in report.collect())
    orders = [[r.doc_id for r in sorted(uses, key=lambda r: r.position) if (r.source, r["pass"], r.block) == ("small", p, 0)] for p in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_too_many_sources(tables, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(*tables)


def test_empty(tables):
    docs, targets = tables
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
    assert mixing.mix(docs, targets.limit(0))[1].agg({"used_tokens": "sum"}).first()[0] == 0
