"""Residue where content should stand: template variables, filler, error messages, notices to a visitor.

Naive Bayes from positive and unlabelled passages, by expectation-maximization.  Trusted positives come from
records: reasons that stand on pages too or under several kinds of outcome, texts that are the whole body of
pages of several sites, and passages that are template variables by half; beside them a short authored seed
and the vocabulary of Latin filler.  All else is unlabelled.  The E step gives every unlabelled passage its share
of each class, the M step counts words with those shares; the trusted ones stay positive, and authored
sentences about residue negative.  A passage is a block of a page's main body, or a crawl outcome's reason; a
page is residue if one of its passages is, in full; text amid which residue is merely mentioned is not.

Every page, every different reason and every trusted passage takes part in the fit: their tokens are stored once,
each round counts them where they lie, and a row a token goes to the driver.  Every page and every record is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.boilerplate import _WORD, _begins, over_bodies, prepared, tokens_of
from pagelathe.llm.page_blocks import FIELD, RECORD, pack_body
from pagelathe.llm.phrases import ABOUT, FILLER, RESIDUE, phrases
from pagelathe.llm.placeholders import SIGN, TEMPLATE
from pagelathe.session import stored

ROUNDS = 4
PRIOR = 0.1
#: Bounds of a word's weight against and for residue; for a trait, above.
AGAINST, CLIP, TRAIT_CLIP = 4.0, 5.0, 9.0
#: The first of them for reasons, which are a few words each.
REASON_AGAINST = 3.0
#: Words of trusted passages count this often at least, and together this part of all unlabelled words.
TRUST, TRUST_PART = 3.0, 0.15
#: Trusted records count as often as makes them weigh as much as the seeds, up to this.
MOST_TIMES = 10.0
#: The first share of passages of whose words this part is trusted.
FIRST, MADE_OF = 0.95, 0.8
#: A trait such as a template variable counts as so many words there.
TRAIT_WORDS = 5
#: A notice stands on so many sites as a body of so many paragraphs of less than so many characters.
NOTICE_SITES, SHORT_BODY, SHORT_TEXT = 3, 5, 160
#: A reason of which this part stands under other kinds of outcome than most of it is not the crawler's own.
OTHER_KIND = 0.1

_NOTHING = re.compile(r"(?:error:?\s*)?(?:undefined|null|nan|none|nil|todo|tbd|n/?a|\[object \w+\]|void 0|true|false)[.!]?\Z", re.I)
_NO_VALUE = re.compile(r"\bundefined\b|\bNaN\b|\bnull\b|\[object |\bXXX+\b")
_KEY = re.compile(r"[a-z][\w-]*(?:\.[a-z][\w-]*)+\Z")
_MARKUP = re.compile(r"<(?:!doctype|/?[a-z][a-z0-9]*)(?:\s[^<>]*)?>", re.I)
_RUN = re.compile(r"(.)\1{2,}\Z")


def _traits(text: str) -> tuple[list[str], str | None]:
    """(traits of residue in a passage, the rest of it); the rest is None where a trait is all there is."""
    found: list[str] = []
    if len(text) < 60:
        if _NOTHING.match(text):
            return ["§nothing"], None
        if _KEY.match(text):
            return ["§key"], None
        if len(text) < 30 and _NO_VALUE.search(text):
            found.append("§nothing")
    if SIGN.search(text):
        text, n = TEMPLATE.subn(" ", text)
        found += ["§template"] * min(n, 6)
        if "<" in text:
            text, n = _MARKUP.subn(" ", text)
            found += ["§markup"] * min(n, 4)
    return found, text


def tokens(text: str, known: list[str] | None = None) -> list[str]:
    """Words of a passage, with template variables and other traits of residue as tokens of their own.

    ``known`` are its words without template variables, if they have been found already.
    """
    found, rest = _traits(text.strip())
    if rest is None:
        return found
    words = known if known is not None and "<" not in text else _WORD.findall(rest.lower())
    if len(words) > 3 and len(set(words)) * 2 <= len(words) + 1:
        found.append("§repeated")
    for w in words:
        c = w[0]
        if c > "⿿" or c.isdigit() or (len(w) > 2 and c == w[1] == w[2]):
            found += ["§run"] if len(w) > 2 and _RUN.match(w) else tokens_of(w)
        else:
            found.append(w)
    if (begins := _begins(words)) is not None:
        found.append(begins)
    return found


def seeds() -> list[list[str]]:
    """What is trusted before any record: a short authored seed, filler text, and bare signs of templates."""
    out = [tokens(p) for _, p in phrases(RESIDUE)]
    out += [FILLER.split()] * 3
    out += [["§template"] * n for n in (1, 1, 1, 2, 2, 3, 4)] * 20
    return out + [["§nothing"]] * 40 + [["§key"]] * 20 + [["§markup"] * 3] * 6 + [["§repeated", "§run", "§run"]] * 2


def passage_key(passage: list[str]) -> int:
    """A signed 64-bit key of a passage's tokens, so that numbers, variables, case and punctuation do not count."""
    k = xxhash.xxh3_64_intdigest(" ".join(passage))
    return k - (1 << 64) if k >> 63 else k


def packed(passages: list[list[str]]) -> str | None:
    """The passages of a row as one string, which passes between Python and Spark as a plain column; None without any."""
    return RECORD.join(FIELD.join(p) for p in passages) if passages else None


def taken_apart(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(all tokens, tokens a passage, passages a row, the passages as they are) of packed rows."""
    rows = pc.split_pattern(column, RECORD)
    texts, per_row = rows.flatten(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, FIELD)
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).copy(), lists.flatten()
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if empty.any():
        sizes[empty] = 0
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, sizes.astype(np.int64), per_row.astype(np.int64), texts


def placeholders(flat: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Whether template variables and the like, each of ``TRAIT_WORDS`` words, make up half of each passage, and words the rest."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    traits, begins = (np.bincount(owner, pc.starts_with(flat, sign).to_numpy(zero_copy_only=False), minlength=len(sizes)) for sign in "§^")
    words = sizes - traits - begins
    return (traits > 0) & (words > 0) & (traits * TRAIT_WORDS >= words)


class Residue:
    def __init__(self, weights: dict[str, float], bias: float, unseen: float):
        self.weights, self.bias, self.unseen = weights, bias, unseen

    def score(self, passage: list[str]) -> float:
        """Log odds of residue; of an empty passage those of none."""
        if not passage:
            return -math.inf
        get, unseen = self.weights.get, self.unseen
        return self.bias + sum(get(t, unseen) for t in passage)


class Scorer(dict):
    """A worker's view of a model: the weight of each text word is found once."""

    def __init__(self, model: Residue, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        get, unseen = self.model.weights.get, self.model.unseen
        v = self[word] = sum(get(t, unseen) for t in (["§run"] if len(word) > 2 and _RUN.match(word) else tokens_of(word)))
        return v

    def text(self, text: str) -> float:
        """``model.score(tokens(text))``."""
        found, rest = _traits(text.strip())
        get, unseen = self.model.weights.get, self.model.unseen
        words = _WORD.findall(rest.lower()) if rest is not None else []
        if len(words) > 3 and len(set(words)) * 2 <= len(words) + 1:
            found.append("§repeated")
        if (begins := _begins(words)) is not None:
            found.append(begins)
        if not found and not words:
            return -math.inf
        return self.model.bias + sum(get(t, unseen) for t in found) + sum(map(self.__getitem__, words))


Counts = tuple[Counter, Counter]


class Passages:
    """Passages of a batch as flat tokens: the different ones, which of them each token is, and whose it is."""

    def __init__(self, flat: pa.Array, sizes: np.ndarray):
        coded = flat.dictionary_encode()
        self.different = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.sizes = sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def sums(self, values: list[float]) -> np.ndarray:
        """For each passage, the sum of its tokens' values."""
        return np.bincount(self.owner, np.array(values, dtype=float)[self.codes] if self.different else None, minlength=len(self.sizes))

    def scores(self, model: Residue) -> np.ndarray:
        """``model.score`` of each."""
        get, unseen = model.weights.get, model.unseen
        return np.where(self.sizes > 0, model.bias + self.sums([get(t, unseen) for t in self.different]), -np.inf)

    def shares(self, model: Residue | frozenset) -> np.ndarray:
        """The E step: each passage's share of residue; to begin with, passages made of trusted words are taken for it."""
        if isinstance(model, Residue):
            return 1 / (1 + np.exp(-np.clip(self.scores(model), -30, 30)))
        parts = [0.0 if t[0] == "^" else float(TRAIT_WORDS) if t[0] == "§" else 1.0 for t in self.different]
        known = [n if t in model else 0.0 for t, n in zip(self.different, parts)]
        return np.where(self.sums(known) / np.maximum(1, self.sums(parts)) >= MADE_OF, FIRST, 0.02)

    def count(self, model: Residue | frozenset, times: np.ndarray, into: Counts) -> None:
        """The M step's counts of tokens for and against residue, each passage ``times`` over."""
        share = self.shares(model)
        for counter, part in zip(into, (np.where(share > 0.01, share, 0.0), np.where(share < 0.99, 1 - share, 0.0))):
            found = np.bincount(self.codes, (times * part)[self.owner], minlength=len(self.different))
            for i in np.flatnonzero(found).tolist():
                counter[self.different[i]] += float(found[i])


class Fit:
    """One model under way: what is held positive and negative, and the model of the last round."""

    def __init__(self, against: float = AGAINST, harmless: Iterable[str] = (), records: Counter | None = None):
        self.against = against
        self.sure, found = Counter(t for p in seeds() for t in p), records or Counter()
        times = min(MOST_TIMES, sum(self.sure.values()) / max(1, sum(found.values())))  # as much as the seeds, however many there are
        for t, n in found.items():
            self.sure[t] += n * times
        self.about = Counter({t: n * TRUST for t, n in Counter(t for p in harmless for t in tokens(p)).items()})
        self.model: Residue | frozenset = frozenset(self.sure)
        self.first = True

    def learn(self, counts: Counts) -> None:
        """The M step: counts of tokens for and against residue, with those that are held."""
        positive, negative = counts
        if self.first:
            times = max(TRUST, TRUST_PART * (sum(positive.values()) + sum(negative.values())) / sum(self.sure.values()))
            self.sure, self.first = Counter({t: n * times for t, n in self.sure.items()}), False
        positive.update(self.sure)
        negative.update(self.about)
        self.model = _weigh(positive, negative, self.against)


def fit(passages: Iterable[tuple[list[str], float]], against: float = AGAINST, harmless: Iterable[str] = (), records: Counter | None = None) -> Residue:
    """The model of unlabelled passages with weights; none at all leaves the trusted ones alone."""
    unlabelled = [(p, w) for p, w in passages if p]
    batch = Passages(pa.array([t for p, _ in unlabelled for t in p], pa.string()), np.array([len(p) for p, _ in unlabelled], dtype=int))
    times = np.array([w for _, w in unlabelled], dtype=float)
    under_way = Fit(against, harmless, records)
    for _ in range(ROUNDS + 1):
        into = Counter(), Counter()
        batch.count(under_way.model, times, into)
        under_way.learn(into)
    return under_way.model


def fit_over(*parts: tuple[DataFrame, Fit]) -> list[Residue]:
    """``fit`` on all passages (tokens) of stored rows of ``passages, times``, counted where they lie; several fits take their rounds together."""
    rows = [df.select(F.lit(i).alias("part"), "passages", "times") for i, (df, _) in enumerate(parts)]
    fits = [f for _, f in parts]
    together = rows[0]
    for df in rows[1:]:
        together = together.unionByName(df)

    def counted() -> list[Counts]:
        models = [f.model for f in fits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into: dict[int, Counts] = {}
            for whole in batches:
                part = whole.column(0).to_numpy()
                for i in np.unique(part).tolist():
                    batch = whole.filter(pa.array(part == i)) if (part != i).any() else whole
                    flat, sizes, per_row, _ = taken_apart(batch.column(1))
                    times = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), per_row)
                    Passages(flat, sizes).count(models[i], times, into.setdefault(i, (Counter(), Counter())))
            for i, (positive, negative) in into.items():
                known = list(positive.keys() | negative.keys())
                counts = [pa.array(map(c.__getitem__, known), pa.float64()) for c in (positive, negative)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), i, dtype=np.int32)), pa.array(known, pa.string()), *counts], ["part", "token", "positive", "negative"])

        summed = together.mapInArrow(run, "part int, token string, positive double, negative double").groupBy("part", "token").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
        table = summed.toPandas()  # a row a token
        out = []
        for i in range(len(fits)):
            own = table[table["part"] == i]
            out.append(tuple(Counter({t: float(n) for t, n in zip(own["token"], own[c]) if n > 0}) for c in ("positive", "negative")))
        return out

    for _ in range(ROUNDS + 1):
        for f, counts in zip(fits, counted()):
            f.learn(counts)
    return [f.model for f in fits]


def _weigh(positive: Counter, negative: Counter, against: float) -> Residue:
    known = positive.keys() | negative.keys()
    a, b = sum(positive.values()) + 0.2 * len(known), sum(negative.values()) + 0.2 * len(known)
    weights = {t: max(-against, min(TRAIT_CLIP if t[0] == "§" else CLIP, math.log((positive[t] + 0.2) / a) - math.log((negative[t] + 0.2) / b))) for t in known}
    return Residue(weights, math.log(PRIOR / (1 - PRIOR)), -0.3)


def page_passages(blocks: list) -> list[str]:
    """Passages of a main body; code counts only where it is all there is."""
    blocks = [b for b in blocks if b.text]
    return [b.text for b in blocks if b.tag != "pre"] or [b.text for b in blocks]


def page_tokens(pages: DataFrame, bodies: bool = True) -> DataFrame:
    """``page_id, site_id, lang, body, passages, keys, short, times``: each page's main body, packed, and the tokens and keys of its passages; stored.

    ``short`` tells bodies of at most ``SHORT_BODY`` paragraphs and nothing else but a heading.  ``bodies`` tells whether they are asked for.
    """
    shared, page_model = prepared(pages)
    fields = {"page_id": pa.int64(), "site_id": pa.int64(), "lang": pa.string(), "body": pa.string(), "passages": pa.string(), "keys": pa.list_(pa.int64()), "short": pa.bool_(), "times": pa.float64()}

    def make():
        def turn(rows: list, known: dict[str, list[str]]) -> pa.RecordBatch:
            texts = [page_passages(body) for _, _, body, _ in rows]
            passages = [[tokens(p, known.get(p)) for p in t] for t in texts]
            short = [0 < len(t) <= SHORT_BODY and all(b.tag in ("p", "h1") for b in r[2]) and max(map(len, t)) < SHORT_TEXT and any(b.tag == "p" for b in r[2]) for t, r in zip(texts, rows)]
            columns = [
                [r[0] for r in rows], [r[3] for r in rows], [r[1] for r in rows], [pack_body(r[2]) if bodies else None for r in rows],
                [packed(own) for own in passages], [[passage_key(p) for p in own] for own in passages], short, [1.0] * len(rows),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, fields.values())], list(fields))

        return turn

    schema = "page_id long, site_id long, lang string, body string, passages string, keys array<long>, short boolean, times double"
    return stored(over_bodies(shared, page_model, make, schema))


def passage_counts(held: DataFrame) -> DataFrame:
    """``key, n, n_short, sites`` of every passage of pages: pages that show it, short bodies among them, and 64 bits in which sites of those leave a mark; stored.

    Counts are summed in each batch before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sites, short = batch.column(0), batch.column(1), pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False))
            pairs = np.unique(np.stack([keys.flatten().to_numpy(zero_copy_only=False), owner], axis=1), axis=0) if len(owner) else np.zeros((0, 2), dtype=np.int64)
            known = pc.is_valid(sites).to_numpy(zero_copy_only=False)
            bit = np.array([xxhash.xxh3_64_intdigest(str(x)) % 63 if x is not None else 0 for x in sites.to_pylist()], dtype=np.int64)
            mark = np.where(short & known, np.int64(1) << bit, np.int64(0))
            different, at = np.unique(pairs[:, 0], return_inverse=True)
            marks = np.zeros(len(different), dtype=np.int64)
            np.bitwise_or.at(marks, at, mark[pairs[:, 1]])
            n, n_short = np.bincount(at, minlength=len(different)), np.bincount(at, short[pairs[:, 1]].astype(float), minlength=len(different)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(different, pa.int64()), pa.array(n, pa.int64()), pa.array(n_short, pa.int64()), pa.array(marks, pa.int64())], ["key", "n", "n_short", "sites"])

    each = held.select("keys", "site_id", "short").mapInArrow(run, "key long, n long, n_short long, sites long")
    return stored(each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_short").alias("n_short"), F.bit_or("sites").alias("sites")))


def trusted_notices(held: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, passage`` of the trusted passages of pages: notices, and placeholders.

    Trusted is a text that ``NOTICE_SITES`` sites and more show as a page's whole short body, or part of one, and that
    stands there in half of the cases at least: pages of different sites have no content in common, only notices.  So
    is a passage that is template variables by half.
    """
    fields = "key long, passage string, placeholder boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes, per_row, texts = taken_apart(batch.column(1))
            keys = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            short = np.repeat(pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False), per_row)  # every notice is in some short body
            signs = placeholders(flat, sizes)
            kept = np.flatnonzero(short | signs)
            _, first = np.unique(keys[kept], return_index=True)
            kept = kept[first]
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept], pa.int64()), texts.take(pa.array(kept)).cast(pa.string()), pa.array(signs[kept])], ["key", "passage", "placeholder"])

    notices = counts.where((F.bit_count("sites") >= NOTICE_SITES) & (2 * F.col("n_short") >= F.col("n"))).select("key", F.lit(True).alias("notice"))
    shown = held.select("keys", "passages", "short").mapInArrow(run, fields).dropDuplicates(["key"])
    return shown.join(notices, "key", "left").where(F.col("placeholder") | F.col("notice")).select("key", "passage")


def trusted_reasons(kinds: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, passage`` of the trusted passages of ``reason_tokens``: texts that stand on pages as well, since a crawler's own reason does not.

    So are texts that stand under more than one kind of outcome, as the crawler states each reason under one; and
    placeholders, as for pages.
    """
    shared = kinds.join(counts.select("key"), "key", "left_semi").where(F.length("passages") > 0)
    apart = kinds.where((F.col("times") - F.col("of_kind") >= OTHER_KIND * F.col("times")) | F.col("placeholder"))
    return shared.unionByName(apart, allowMissingColumns=True).select("key", F.col("passages").alias("passage"))


def trusted_tokens(*parts: DataFrame) -> list[Counter]:
    """For each part, the tokens of all its different passages of ``key, passage``, each passage weighing 1 / the number of them that hold its rarest token.

    Filler is strung together from few words in ever new ways: all passages with the same rarest token weigh 1
    together at most, so that it does not outweigh the messages as tables grow.  A row a token goes to the driver.
    """
    together = parts[0].select(F.lit(0).alias("part"), "key", "passage")
    for i, df in enumerate(parts[1:], 1):
        together = together.unionByName(df.select(F.lit(i).alias("part"), "key", "passage"))
    each = together.dropDuplicates(["part", "key"]).select("part", "key", F.explode(F.split("passage", FIELD)).alias("token")).where(F.length("token") > 0)
    own = stored(each.groupBy("part", "key", "token").agg(F.count("*").alias("n")))
    shown = own.groupBy("part", "token").agg(F.count("*").alias("passages"))
    weights = own.join(shown, ["part", "token"]).groupBy("part", "key").agg((1 / F.min("passages")).alias("weight"))
    table = own.join(weights, ["part", "key"]).groupBy("part", "token").agg(F.sum(F.col("n") * F.col("weight")).alias("n")).toPandas()  # a row a token
    return [Counter(dict(zip(o["token"], map(float, o["n"])))) for o in (table[table["part"] == i] for i in range(len(parts)))]


def begun(held: DataFrame, crawl_records: DataFrame) -> tuple[Fit, DataFrame, Fit]:
    """(the fit of main bodies of ``page_tokens``, the tokens of all reasons, the fit of those)."""
    counts = passage_counts(held)
    kinds = reason_tokens(reasons_of(crawl_records))
    messages = stored(trusted_reasons(kinds, counts))
    of_pages, of_reasons = trusted_tokens(messages.unionByName(trusted_notices(held, counts)), messages)
    return Fit(harmless=[p for _, p in phrases(ABOUT)], records=of_pages), kinds, Fit(REASON_AGAINST, records=of_reasons)


def fit_bodies(held: DataFrame, crawl_records: DataFrame) -> Residue:
    """The model of the main bodies of all pages of ``page_tokens``."""
    return fit_over((held, begun(held, crawl_records)[0]))[0]


def worst(model: Residue, held: pa.Array) -> np.ndarray:
    """The highest log odds among the passages of each page; NaN of a page without one."""
    flat, sizes, per_row, _ = taken_apart(held)
    out = np.full(len(held), np.nan)
    scores = Passages(flat, sizes).scores(model)
    some = per_row > 0
    if some.any():
        out[some] = np.maximum.reduceat(scores, (np.cumsum(per_row) - per_row)[some])
    return out


def page_scores(held: DataFrame, model: Residue) -> DataFrame:
    """``origin, row_id, score``: the highest log odds among a page's passages.

    Pages without a main body have no passage and no row; rows that repeat are scored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worst(model, batch.column(1)), pa.float64(), from_pandas=True)], ["row_id", "score"])

    scored = held.select("page_id", "passages").mapInArrow(run, "row_id long, score double")
    return scored.where(F.col("score").isNotNull()).select(F.lit("page").alias("origin"), "row_id", "score")


def reasons_of(crawl_records: DataFrame) -> DataFrame:
    """``row_id, reason, kind`` of records whose reason is not blank."""
    return crawl_records.select(F.col("record_id").cast("long").alias("row_id"), F.trim(F.col("outcome.reason")).alias("reason"), F.col("outcome.kind").alias("kind")).where(F.length("reason") > 0)


def reason_tokens(reasons: DataFrame) -> DataFrame:
    """``passages, key, placeholder, times, of_kind``: the tokens of each different reason, numbers levelled, how often it stands, and under its main kind; stored."""
    kinds = reasons.groupBy(F.regexp_replace("reason", r"\d+", "0").alias("reason"), "kind").agg(F.count("*").cast("double").alias("n")).groupBy("reason").agg(F.sum("n").alias("times"), F.max("n").alias("of_kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [tokens(r) for r in batch.column(0).to_pylist()]
            texts = pa.array([packed([p]) for p in own], pa.string())
            columns = [texts, pa.array(map(passage_key, own), pa.int64()), pa.array(placeholders(*taken_apart(texts)[:2]))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1), batch.column(2)], ["passages", "key", "placeholder", "times", "of_kind"])

    return stored(kinds.mapInArrow(run, "passages string, key long, placeholder boolean, times double, of_kind double"))


def reason_scores(crawl_records: DataFrame, model: Residue) -> DataFrame:
    """``origin, row_id, score``: the log odds of each record's reason.

    Null and blank reasons have no row; other columns are ignored; rows that repeat are scored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            different = batch.column(1).dictionary_encode()
            scores = pa.array([scorer.text(r) for r in different.dictionary.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores.take(different.indices)], ["row_id", "score"])

    scored = reasons_of(crawl_records).select("row_id", "reason").mapInArrow(run, "row_id long, score double")
    return scored.select(F.lit("record").alias("origin"), "row_id", "score")


def p3_found(pages: DataFrame, crawl_records: DataFrame) -> DataFrame:
    """``origin, row_id`` of pages and records that hold residue in place of content."""
    held = page_tokens(pages, bodies=False)
    bodies, kinds, reasons = begun(held, crawl_records)
    of_pages, of_reasons = fit_over((held, bodies), (kinds, reasons))
    scores = page_scores(held, of_pages).unionByName(reason_scores(crawl_records, of_reasons))
    return scores.where(F.col("score") > 0).select("origin", "row_id")
