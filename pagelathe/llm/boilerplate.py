"""The main body of pages, without the frame and the inserts around it.

Words and tags carry weights: what speaks for the main body scores above zero, what speaks against it
below.  One linear scan finds the contiguous run of blocks with the best sum (a maximum-scoring
subsequence), and blocks within it that score clearly below zero (an advertisement amid the text)
are left out.

The weights come from labelled pages: pages whose own markup labels their blocks (inside main or
article, or inside nav, aside, header, footer or a dialog), together with authored phrases.  At most
``SAMPLE_PAGES`` pages are drawn for it.  The markup itself is no feature of the fit, so that what is
learned holds for pages of plain divs as well.  How much of its site shows the same block, the sign of
a frame, is counted over all pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.page_blocks import Block, blocks_of, html_lang, pack, pack_body, unpack
from pagelathe.llm.phrases import AROUND, RESIDUE, phrases
from pagelathe.llm.placeholders import without_templates
from pagelathe.session import sampled, slices, spread, stored

#: Bound of the pages drawn for fitting, in the order of a hash of their id; those with labelling markup are fitted on.
SAMPLE_PAGES = 2_500
#: A block is part of a site's frame from this share and number of the site's pages on.
FRAME_SHARE, FRAME_PAGES = 0.06, 3
#: A heading amid the main body is dropped only below this score, other blocks below 0.
HEADING_FLOOR = -1.5
MENU_SHARE = 0.45
#: Parts a site's pages are spread over when frames are joined to them.
SALTS = 8
TAG_COST = 0.25
#: No single block costs a run more, so that an insert below the heading does not cut the heading off.
INSERT_COST = -4.5
FIT_ROUNDS = 3
SEED_TIMES = 12
#: A paragraph up to this length that so many sites show is an insert or a notice; within this score of 0 it stays open which.
SHORT, COMMON_SITES, OPEN = 110, 3, 1.0
#: A lead before a colon, as in "read also:", ends within so many characters.
LEAD = 30
# What landmarks add to a score, since sites misuse them at times.
MARK_SCORES = {"n": -3.0, "f": -3.0, "h": -1.0, "d": -3.0, "a": -1.0, "m": 0.7, "r": 0.7, "": 0.0}
KINDS = ("li", "p", "h1", "h2", "pre", "blockquote", "figcaption")

_WORD = re.compile(r"[^\W\d_]+|[©·»›]|\d+")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_DIGITS = re.compile(r"\d+")


def tokens_of(word: str) -> list[str]:
    """The tokens of one lower-case match of ``_WORD``: 0 for a number, pairs of characters where words have no spaces."""
    if word[0].isdigit():
        return ["0"]
    if len(word) > 1 and word[0] > "⿿" and _EAST.match(word):
        return [word[i : i + 2] for i in range(len(word) - 1)]
    return [word]


def _begins(words: list[str]) -> str | None:
    """A token for how a text begins: its first two tokens; None if it has fewer."""
    if not words:
        return None
    first = tokens_of(words[0])[:2]
    if len(first) < 2:
        if len(words) < 2:
            return None
        first += tokens_of(words[1])[:1]
    return f"^{first[0]} {first[1]}"


def words_of(text: str) -> list[str]:
    """The tokens of a text, a token for each template variable in it, last how it begins."""
    text, variables = without_templates(text)
    words = _WORD.findall(text.lower())
    found = ["§template"] * variables + [t for w in words for t in tokens_of(w)]
    if (begins := _begins(words)) is not None:
        found.append(begins)
    return found


def frame_key(text: str) -> int:
    """A signed 64-bit key of a block's text with its numbers levelled."""
    k = xxhash.xxh3_64_intdigest(_DIGITS.sub("0", text).lower())
    return k - (1 << 64) if k >> 63 else k


def common_keys(text: str) -> list[int]:
    """Keys under which a text may recur over sites: its own, and that of a short lead before a colon."""
    lead = text[:LEAD].partition(":")
    return [frame_key(text)] + ([frame_key(lead[0].rstrip() + ":")] if lead[1] and len(text) > len(lead[0]) + 1 else [])


class WordSums(dict):
    """Text word -> (sum of the weights of its tokens) + 1j * (number of tokens), found on first use."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most
        self.memo: dict[str, list[str]] = {}  # the words of the texts at hand, for whoever looks at them next

    def __missing__(self, word: str) -> complex:
        if len(self) > self.most:
            self.clear()
        parts = tokens_of(word)
        v = self[word] = complex(sum(self.weights.get(w, 0.0) for w in parts), len(parts))
        return v

    def text(self, text: str) -> tuple[float, float]:
        """(sum, mean) of the weights of a text's tokens, how it begins included."""
        bare, variables = without_templates(text)
        words = self.memo[text] = _WORD.findall(bare.lower())
        t = sum(map(self.__getitem__, words), variables * complex(self.weights.get("§template", 0.0), 1))
        begins = _begins(words)
        if begins is not None:
            t += complex(self.weights.get(begins, 0.0), 1)
        return t.real, t.real / (t.imag + 1)


TRAITS = """bias words mean linked length share framed zone_linked zone_length zone_share zone_words zone_h1 zone_part
list_linked list_share list_words before_h1 repeated_p list_linked_h1 menu zone_linked_h1""".split()


def features(pages: list[tuple[list[Block], list[float]]], sums: WordSums) -> np.ndarray:
    """A row a block of all pages, its columns ``TRAITS`` and then ``KINDS``; none of them looks at landmarks.

    Sums by zone and by list leave out menus: lists of whose items most of the site shows most.
    """
    rows = [(p, b.zone, b.items, b.linked, len(b.text) + 1, f, b.tag) for p, (blocks, shares) in enumerate(pages) for b, f in zip(blocks, shares)]
    k = len(rows)
    out = np.zeros((k, len(TRAITS) + len(KINDS)))
    sums.memo.clear()
    if not k:
        return out
    page, zone, items, linked, n, f, tags = zip(*rows)
    scored = np.array([sums.text(b.text) for blocks, _ in pages for b in blocks])
    score, mean = np.clip(scored[:, 0], -15, 15), scored[:, 1]
    page, linked, n, f = np.array(page), np.array(linked, float), np.array(n, float), np.array(f, float)
    _, zone = np.unique(page * 1_000_003 + np.array(zone), return_inverse=True)
    items = np.array(items)
    listed = items > 0
    _, lists = np.unique(np.where(listed, page * 1_000_003 + items, -1), return_inverse=True)
    h1 = np.array([t == "h1" for t in tags], float)

    def by(key, value, where=None):
        return np.bincount(key, value if where is None else value * where, minlength=int(key.max()) + 1)

    list_n, list_count = by(lists, n), by(lists, np.ones(k))
    list_linked, list_share, list_score = by(lists, linked) / list_n, by(lists, f) / list_count, np.clip(by(lists, score), -20, 20)
    menu = listed & (list_share[lists] > MENU_SHARE)
    apart = (~menu).astype(float)
    has = by(zone, apart) > 0
    kept = np.where(has[zone], apart, 1.0)  # a zone's menus count only where it holds nothing else
    zone_n = by(zone, n, kept)
    zone_linked, zone_share = by(zone, linked, kept) / zone_n, by(zone, n * f, kept) / zone_n
    zone_score, zone_h1 = np.clip(by(zone, score, kept), -20, 20), (by(zone, h1, kept) > 0).astype(float)
    free = by(page, n - 1 - linked, (f < MENU_SHARE).astype(float)) + 1
    order = np.arange(k)
    first_h1 = np.full(int(page.max()) + 1, k)
    np.minimum.at(first_h1, page[h1 > 0], order[h1 > 0])
    before = (order < first_h1[page]) & (first_h1[page] < k)
    paragraph = np.array([t == "p" for t in tags])
    zl, zs, zh = zone_linked[zone], zone_share[zone], zone_h1[zone]
    columns = [
        np.ones(k), score / 5, mean, linked / n, np.log(n) / 3, f, np.clip((f - 0.3) / 0.3, 0, 1), zl, np.log(zone_n[zone]) / 3,
        np.clip((zs - 0.2) / 0.3, 0, 1), zone_score[zone] / 5, zh, np.where(zs < 0.4, np.maximum(0, zone_n[zone] * (1 - zl)) / free[page], 0.0),
        list_linked[lists] * listed, list_share[lists] * listed, list_score[lists] / 5 * listed,
        before, paragraph & (f >= FRAME_SHARE / 3), list_linked[lists] * listed * zh, menu, zl * zh,
    ]
    for j, c in enumerate(columns):
        out[:, j] = c
    kinds = {t: j for j, t in enumerate(KINDS, len(TRAITS))} | {f"h{i}": len(TRAITS) + KINDS.index("h2") for i in range(3, 7)}
    for i, t in enumerate(tags):
        if t in kinds:
            out[i, kinds[t]] = 1.0
    return out


def markup_label(marks: str) -> int | None:
    """1 inside main or article, 0 inside a frame's landmark, None where the markup says nothing."""
    last = marks[-1:] if marks else ""
    return 1 if last and last in "mr" else 0 if last else None


def _authored() -> dict[str, float]:
    """Word weights of the authored phrases alone: above zero for what stands around, below for notices and fillers."""
    around, residue = Counter(), Counter()
    for table, into in ((AROUND, around), (RESIDUE, residue)):
        for _, p in phrases(table):
            into.update(set(words_of(p)))
    a, b = sum(around.values()), sum(residue.values())
    return {w: math.log(around[w] / a + 6e-4) - math.log(residue[w] / b + 6e-4) for w in around.keys() | residue.keys()}  # the tables differ in size


AUTHORED = _authored()


def page_labels(blocks: list[Block], shares, common: list[bool], sums: WordSums | None = None) -> list[int | None]:
    """Labels by markup; but a list whose items most of the site shows is a menu or a path wherever it stands.

    A short paragraph that many sites show word for word is an insert, or a notice that stands for the text.  Where
    a page holds nothing else, it is a notice; amid a text it is left open until words learned elsewhere tell (``sums``),
    unless authored words tell at once.
    """
    lists: dict[int, list[float]] = {}
    for b, f in zip(blocks, shares):
        if b.items:
            lists.setdefault(b.items, []).append(f)
    menus = {k for k, v in lists.items() if sum(v) / len(v) > MENU_SHARE}
    amid = any(markup_label(b.marks) == 1 and not c and b.tag == "p" and len(b.text) > 80 for b, c in zip(blocks, common))
    out = []
    for b, f, c in zip(blocks, shares, common):
        y = markup_label(b.marks)
        if y:
            if f > MENU_SHARE or b.items in menus:
                y = 0
            elif b.tag == "p" and len(b.text) < SHORT:
                words = words_of(b.text)
                known = [AUTHORED[w] for w in words if w in AUTHORED]
                if sum(known) > (0.3 if c or f >= FRAME_SHARE / 3 else 4.0) and (c or 2 * len(known) >= len(words)):
                    y = 0
                elif c and amid:
                    score = sums.text(b.text)[0] if sums is not None else 0.0
                    y = 0 if score < -OPEN else 1 if score > OPEN else None
        out.append(y)
    return out


class PageModel:
    """Weights of words, then of a block's traits; ``alone`` are the traits of pages whose site shows no frame."""

    def __init__(self, weights: dict[str, float], traits: np.ndarray, alone: np.ndarray):
        self.weights, self.traits, self.alone = weights, traits, alone

    def main_blocks(self, pages: list[tuple[list[Block], list[float]]], sums: WordSums | None = None) -> list[list[Block]]:
        """The blocks of each page's main body, by the best contiguous run; [] of a page without blocks."""
        x = features(pages, sums if sums is not None else WordSums(self.weights))
        both = x @ np.stack([self.traits, self.alone], axis=1)
        out, at = [], 0
        for blocks, shares in pages:
            raw = both[at : at + len(blocks), 0 if any(f >= FRAME_SHARE for f in shares) else 1].tolist()
            at += len(blocks)
            out.append(_best_run(blocks, shares, [s + MARK_SCORES[b.marks[-1:]] for s, b in zip(raw, blocks)]))
        return out


def _best_run(blocks: list[Block], shares, scores: list[float]) -> list[Block]:
    if not blocks:
        return []
    best, first, last = -math.inf, 0, -1
    total, start = 0.0, 0
    for i, (b, s) in enumerate(zip(blocks, scores)):
        s, step = max(s, INSERT_COST), -TAG_COST * min(b.gap, 6)
        if total + step <= 0:
            total, start = s, i
        else:
            total += step + s
        if total > best:
            best, first, last = total, start, i
    if best <= 0:  # nothing speaks for any block: the zone that is least like a frame
        zone = blocks[first].zone
        return [b for b, s, f in zip(blocks, scores, shares) if b.zone == zone and s > -4.0 and f < 0.3]
    return [blocks[i] for i in range(first, last + 1) if scores[i] > (HEADING_FLOOR if blocks[i].tag[0] == "h" else 0.0)]


def _word_weights(pages: list[tuple[list[Block], list[float]]], labels: list[list[int | None]]) -> dict[str, float]:
    inside, outside = Counter(), Counter()
    for (blocks, _), own in zip(pages, labels):
        for b, y in zip(blocks, own):
            if y is not None:
                (inside if y else outside).update(words_of(b.text))
    for _, p in phrases(AROUND):
        for w in words_of(p):
            outside[w] += SEED_TIMES
    for _, p in phrases(RESIDUE):
        for w in words_of(p):
            inside[w] += SEED_TIMES // 4
    inside["§template"] += 4 * SEED_TIMES
    a, b = sum(inside.values()) + 1.0, sum(outside.values()) + 1.0
    known = inside.keys() | outside.keys()
    weights = {w: math.log((inside[w] + 0.5) / a) - math.log((outside[w] + 0.5) / b) for w in known if inside[w] + outside[w] > 1}
    return {w: max(-6.0 if w[0] == "^" else -3.0, min(3.0, v)) for w, v in weights.items()}


#: Traits to begin with, before labelled pages correct them.
PRIOR = np.array([-0.5, 1.0, 0.8, -1.0, 0.5, -1.0, -3.0, -2.0, 0.5, -2.0, 0.5, 1.0, 1.5, -1.5, -2.0, 0.3, -0.5, -2.0, 1.5, -3.0, 1.5] + [{"pre": 3.0, "blockquote": 1.0, "figcaption": 0.5}.get(k, 0.0) for k in KINDS])


def fit_pages(pages: list[tuple[list[Block], list[float]]], common: list[list[bool]] | None = None) -> PageModel:
    """The model of labelled pages; defined (authored phrases and prior traits) for none as well.

    ``common`` tells for each block whether at least ``COMMON_SITES`` sites show it.
    """
    common = common if common is not None else [[False] * len(blocks) for blocks, _ in pages]
    labels = [page_labels(blocks, shares, c) for (blocks, shares), c in zip(pages, common)]
    model = PageModel(_word_weights(pages, labels), PRIOR, PRIOR)
    for _ in range(FIT_ROUNDS):
        both = [any(y == 1 for y in own) and any(y == 0 for y in own) for own in labels]
        y = np.array([-1 if v is None or not fit else v for own, fit in zip(labels, both) for v in own], dtype=float)
        if not (y >= 0).any():
            return model
        sums = WordSums(model.weights)
        x = features(pages, sums)
        traits = _logistic(x[y >= 0], y[y >= 0])
        alone = _logistic(features([(blocks, [0.0] * len(blocks)) for blocks, _ in pages], sums)[y >= 0], y[y >= 0])
        # the markup's labels are corrected where the fit is sure of the contrary, then words are weighed anew
        raw, at, labels = x @ traits, 0, []
        for (blocks, shares), c in zip(pages, common):
            labels.append([0 if v == 1 and s < -2 else 1 if v == 0 and s > 4 else v for v, s in zip(page_labels(blocks, shares, c, sums), raw[at : at + len(blocks)])])
            at += len(blocks)
        model = PageModel(_word_weights(pages, labels), traits, alone)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Logistic regression with a ridge towards the prior traits: damped Newton steps from zero."""
    w = np.zeros(x.shape[1])

    def loss(v):
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * np.sum((v - PRIOR) ** 2))

    now = loss(w)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, size = np.linalg.solve(h, grad), 1.0
        while size > 1e-4 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * now:
            break
        w, now = w - size * step, then
    return w


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``page_id, site_id, lang, packed, keys, leads``: every page scanned once, written to the shared folder."""
    names = ["page_id", "site_id", "lang", "packed", "keys", "leads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                langs, packed, keys, leads = [], [], [], []
                for source in batch.column(2).to_pylist():
                    blocks = blocks_of(source)
                    langs.append(html_lang(source))
                    packed.append(pack(blocks))
                    found = [common_keys(b.text) for b in blocks]
                    keys.append([k[0] for k in found])
                    leads.append([k[1] for k in found if len(k) > 1])
                columns = [pa.array(langs, pa.string()), pa.array(packed, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(leads, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("site_id").cast("long").alias("site_id"), F.col("html").cast("string").alias("html"))
    return stored(spread(slim).mapInArrow(run, "page_id long, site_id long, lang string, packed string, keys array<long>, leads array<long>"))


def common_among(parsed: DataFrame, keys: set[int]) -> set[int]:
    """Those of ``keys``, the keys of a bounded sample, that at least ``COMMON_SITES`` sites show, of all pages."""
    asked = np.array(sorted(keys), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            sites, found = pc.fill_null(batch.column(0), 0).to_numpy(), []
            for lists in batch.columns[1:]:
                values = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                kept = known[owner] & np.isin(values, asked)
                found.append(np.stack([values[kept], sites[owner[kept]]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "site_id"])

    shown = parsed.select("site_id", "keys", "leads").mapInArrow(run, "key long, site_id long").distinct()
    counted = shown.groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= COMMON_SITES)
    return {r["key"] for r in counted.select("key").collect()}  # at most as many as asked


def with_frame_shares(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``shares``: for each block, the share of its site's pages that show it (0 below the bounds).

    Counts are pre-aggregated before the shuffle; a site keeps only the keys above ``FRAME_SHARE / 3``,
    at most 3 / FRAME_SHARE times the blocks of a page, however many pages it has.  They are stored, so
    that later passes only join them.
    """
    seen = parsed.where(F.size("keys") > 0)
    of_site = seen.groupBy("site_id").agg(F.count("*").alias("site_pages"))
    counted = seen.select("site_id", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= FRAME_PAGES)
    frames = stored(
        counted.join(of_site, "site_id")
        .withColumn("share", (F.col("n") / F.col("site_pages")).cast("float"))
        .where(F.col("share") >= FRAME_SHARE / 3)
        .groupBy("site_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "share"))).alias("frame"))
    )
    shares = F.when(F.col("frame").isNull(), F.transform("keys", lambda k: F.lit(0.0).cast("float"))).otherwise(F.transform("keys", lambda k: F.coalesce(F.try_element_at(F.col("frame"), k), F.lit(0.0).cast("float"))))
    # where the frames are too many to be sent to every task, a site's pages are spread over SALTS parts
    copies = frames.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = parsed.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["site_id", "part"], "left").select("page_id", "site_id", "lang", "packed", shares.alias("shares"))


def prepared(pages: DataFrame, bound: int = SAMPLE_PAGES) -> tuple[DataFrame, PageModel]:
    """(pages parsed with their frame shares, the page model).

    The sample is at most ``bound`` pages in the order of a hash of their id; those whose markup labels
    their blocks fit the model.
    """
    parsed = parsed_pages(pages)
    shared = with_frame_shares(parsed)
    some = F.length("packed") > 0
    sample = sampled(shared.where(some), "page_id", bound, parsed.where(some).count())
    rows = sample.select("packed", "shares").toPandas()  # bounded
    drawn = [(unpack(p), [float(x) for x in s]) for p, s in zip(rows["packed"], rows["shares"])]
    labelled = [(blocks, s) for blocks, s in drawn if any(markup_label(b.marks) for b in blocks)]
    keys = [[common_keys(b.text) for b in blocks] for blocks, _ in labelled]
    common = common_among(parsed, {k for own in keys for found in own for k in found}) if keys else set()
    return shared, fit_pages(labelled, [[any(k in common for k in found) for found in own] for own in keys])


Page = tuple[int, str | None, list[Block], int | None]


def over_bodies(shared: DataFrame, model: PageModel, make: Callable[[], Callable[[list[Page], dict[str, list[str]]], pa.RecordBatch]], schema: str) -> DataFrame:
    """One pass over all pages: ``make()``, once a task, gives what turns (page_id, lang, main blocks, site_id) of some pages into rows.

    It is also given the words of their texts, found already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, turn = WordSums(model.weights), make()
        for whole in batches:
            for batch in slices(whole):
                ids, langs, packed, shares, sites = (c.to_pylist() for c in batch.columns)
                bodies = model.main_blocks(list(zip(map(unpack, packed), shares)), sums)
                yield turn(list(zip(ids, langs, bodies, sites)), sums.memo)

    return shared.select("page_id", "lang", "packed", "shares", "site_id").mapInArrow(run, schema)


def main_bodies(pages: DataFrame) -> DataFrame:
    """``page_id, lang, body``: the packed main blocks of every page.

    Null and empty pages and pages without blocks have an empty body; a page captured twice comes out
    under each of its ids; a null site has no frame; other columns are ignored.
    """
    shared, model = prepared(pages)

    def make():
        return lambda rows, _: pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([pack_body(r[2]) for r in rows], pa.string())], ["page_id", "lang", "body"]
        )

    return over_bodies(shared, model, make, "page_id long, lang string, body string")


def p2_found(pages: DataFrame) -> DataFrame:
    """``page_id, block_no`` of the blocks of each main body."""
    shared, model = prepared(pages)

    def make():
        def turn(rows: list[Page], _) -> pa.RecordBatch:
            ids = [i for i, _, body, _ in rows for _ in body]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([b.no for _, _, body, _ in rows for b in body], pa.int64())], ["page_id", "block_no"])

        return turn

    return over_bodies(shared, model, make, "page_id long, block_no long")
