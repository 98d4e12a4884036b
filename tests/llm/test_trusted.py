import random

from pyspark.sql import functions as F

from pagelathe.llm import residue

CHUNKS = "test test test|foo bar baz|bla bla bla|asdf asdf qwer|hello world hello|dummy dummy text|text text text|aaaa bbbb cccc|xxxx xxxx xx".split("|")
NOTICES = """kindly wake the hamster behind this window|the gnome that keeps our shelves has left|a moth sits upon the lens|our parrot refuses these words today
someone borrowed every chair in here|nobody feeds this lighthouse anymore|that drawer sticks when it rains|whistle twice and the curtain lifts""".replace("\n", "|").split("|")
REASONS = """wipe your boots before knocking|leave your umbrella beside the stove|come back once the snow melts|pull the green rope gently
bring two candles and a spoon|hum quietly while we look|the ferryman sleeps until noon|ask my aunt for the ladder""".replace("\n", "|").split("|")
TOPICS = "river bridge market garden library engine window teacher orchard harbour valley lantern copper saddle meadow".split()


def fillers(r, n):
    found = set()
    while len(found) < n:
        found.add(" ".join([*r.choices(CHUNKS, k=5), "aaaa bbbb cccc", "xxxx xxxx xx"]))  # a sign of filler in each
    return sorted(found)


def test_messages_amid_much_filler_are_found(spark):
    r = random.Random(3)
    n = 9_000  # more than any bound of what was drawn

    def sentence():
        return "The old {} near the {} was repaired before the {} opened in spring.".format(*r.sample(TOPICS, 3))

    texts = [(i, i % 40, [sentence() for _ in range(4)], False) for i in range(6_000)]
    texts += [(10_000 + 10 * i + j, 13 * j, [t], True) for i, t in enumerate(NOTICES) for j in range(3)]
    texts += [(20_000 + i, i % 40, [t], True) for i, t in enumerate(fillers(r, n))]
    rows = []
    for i, site, own, short in texts:
        passages = [residue.tokens(t) for t in own]
        rows.append((i, site, residue.packed(passages), [residue.passage_key(p) for p in passages], short, 1.0))
    held = spark.createDataFrame(rows, "page_id long, site_id long, passages string, keys array<long>, short boolean, times double")
    own = ["timeout after 3 ms", "robots: disallowed", "HTTP 404", "blocked: the page needs JavaScript and the static driver cannot render"] * 4_000
    reasons = [(i, ("error", t)) for i, t in enumerate(own)]
    reasons += [(20_000 + 10 * i + j, (kind, t)) for i, t in enumerate(REASONS) for j, kind in enumerate(("error", "skipped"))]
    reasons += [(30_000 + i, ("error", t)) for i, t in enumerate(fillers(r, n))] + [(50_000 + i, ("error", t)) for i, t in enumerate(["undefined", "NaN", "{{ verdict.reason }}"])]
    records = spark.createDataFrame(reasons, "record_id long, outcome struct<kind:string,reason:string>")

    bodies, kinds, of_reasons = residue.begun(held, records)
    for model, messages in ((bodies, NOTICES + REASONS), (of_reasons, REASONS)):
        assert all(t in model.sure for m in messages for t in residue.tokens(m))
    a, b = residue.fit_over((held, bodies), (kinds, of_reasons))
    scores = residue.page_scores(held, a).unionByName(residue.reason_scores(records, b))
    found = {(x.origin, x.row_id) for x in scores.where(F.col("score") > 0).collect()}
    assert found == {("page", t[0]) for t in texts if t[3]} | {("record", x[0]) for x in reasons if x[0] >= 20_000}


def test_passages_of_the_same_rarest_token_weigh_one_together(spark):
    passages = [["a", "b"], ["a", "b", "b"], ["a", "c"], ["a"]]
    rows = [(k, residue.FIELD.join(p)) for k, p in enumerate(passages)] + [(0, residue.FIELD.join(passages[0])), (9, "")]
    df = spark.createDataFrame(rows, "key long, passage string")
    whole, none = residue.trusted_tokens(df, df.limit(0))
    assert {t: round(n, 9) for t, n in whole.items()} == {"a": 2.25, "b": 1.5, "c": 1.0} and not none  # a: 1/2 + 1/2 + 1 + 1/4
