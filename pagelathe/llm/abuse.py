"""Abusive, hateful and sexually explicit texts, found by a subsequence string kernel.

Two sentences are alike in the characters they share in order, gaps allowed: the kernel sums over
subsequences of two to four characters within a short window, each decayed by its gaps, so that
inserted, starred or spaced-out characters cost little.  A support vector machine is trained in the
space that Nyström's method spans by landmark sentences.  As the kernel is an inner product of hashed
subsequence counts, the trained decision function, a weighted sum of kernels with the landmarks, folds
into one table of weights by subsequence: scoring a text is a linear scan whatever the landmarks.

Labels stand on documents and some are wrong.  Training starts from authored sentences and the
sentences of clean documents; then the worst sentence of each document labelled abusive joins as a
positive, in rounds.  At most ``FIT_CLEAN`` and ``FIT_ABUSIVE`` labelled documents are used, in the order
of a hash; every document is scored in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.abuse_sentences import ABUSIVE, CLEAN, sentences
from pagelathe.llm.mixing import source_name
from pagelathe.session import slices, spread

FIT_CLEAN, FIT_ABUSIVE = 3_000, 2_000
NEGATIVES, LANDMARKS, ROUNDS = 8_000, 320, 4
#: A document's worst sentence joins the positives from FLOOR on, unless OFTEN clean documents hold it; one of a clean document is dropped from SUSPECT on.
FLOOR, OFTEN, SUSPECT = -0.15, 3, 0.6
#: It must hold this share of words that documents labelled abusive have MORE_OFTEN times as often as clean ones, since
#: many a label is wrong; where no sentence scores so, those join of whose words NOVEL are such.
NEW, NOVEL, MORE_OFTEN = 0.2, 0.5, 4.0
#: From this score on, a sentence in usual words is near the boundary.
NEAR = -0.6
DECAY, BITS = 0.55, 20
#: Subsequence lengths and the window each lies in.
SHAPES = ((2, 3), (3, 5), (4, 6))
PAD, LONG, WINDOW, STRIDE = 6, 76, 64, 16
#: Positions scored together.
PIECE = 1 << 14

_SPLIT = re.compile(r"[.!?。！？\n\r]+(?=\s|$|[^\x00-⿿])|\n+")
_SPACED = re.compile(r"(?<!\w)(?:\w[ ]){2,}\w(?!\w)")
_MAYBE_SPACED = re.compile(r" \w \w(?!\w)")
_LEET = re.compile(r"[013457@$]+")
_STARS = re.compile(r"(?<=\w)\*+(?=\w)")
RECORD = "\x1e"
# Digits and signs in place of letters, and letters of other scripts that look like Latin ones.
LEET = str.maketrans("013457@$", "oieastas")
ALIKE = str.maketrans("аеорсхукмтнвіјѕԁɡαοενικρτυχ", "aeopcxykmthbijsdgaoevikptux")


def _letters(m: re.Match) -> str:
    """A run of digits and signs as the letters they stand for, as far as letters are beside it."""
    run, text = m.group(), m.string
    left, right = m.start() > 0 and text[m.start() - 1].isalpha(), m.end() < len(text) and text[m.end()].isalpha()
    if not (left or right):
        return run
    read = run.translate(LEET)
    return (read[0] if left or len(run) == 1 else run[0]) + (read[1:] if right else run[1:])


def _undisguised(text: str) -> str:
    """A text in lower case, a line a sentence, with look-alikes, leet, stars and spaced-out letters undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c < "­" or unicodedata.category(c) != "Cf") if not text.isascii() else text
    if RECORD in text:
        text = text.replace(RECORD, " ")
    text = _SPLIT.sub("\n", text)
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: m.group().replace(" ", ""), text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(ALIKE)
    if "*" in text:
        text = _STARS.sub("", text)
    return _LEET.sub(_letters, text)


def _plain_code(c: str) -> int:
    return ord(c) if c in "\n\x1e" else ord("0") if c.isdecimal() else ord(c) if c.isalnum() else ord(" ")


@lru_cache(maxsize=1)
def _plain_codes() -> np.ndarray:
    return np.array([_plain_code(chr(i)) if not 0xD800 <= i < 0xE000 else 32 for i in range(1 << 16)], dtype=np.uint32)


def sentences_of(texts: list[str | None]) -> list[list[str]]:
    """The sentences of texts, letters and single spaces alone: numbers are one 0, repeated letters one."""
    joined = RECORD.join(_undisguised(t) if t else "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    plain = _plain_codes()[np.minimum(codes, (1 << 16) - 1)]
    for i in np.flatnonzero(codes >= 1 << 16).tolist():
        plain[i] = _plain_code(chr(int(codes[i])))
    same = np.zeros(len(plain), dtype=bool)
    same[1:] = (plain[1:] == plain[:-1]) & (plain[1:] != ord(RECORD))
    bare = plain[~same].tobytes().decode("utf-32-le")
    return [[x for s in text.split("\n") if (x := s.strip())] for text in bare.split(RECORD)]


def normal_sentences(text: str | None) -> list[str]:
    """The sentences of one text."""
    return sentences_of([text])[0]


_COMBOS = [(p, c, DECAY ** (c[-1] - (p - 1)) if c else 1.0) for p, w in SHAPES for c in combinations(range(1, w), p - 1)]
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def _coded(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sentences one after another as code points with padding between; where each begins, and its length."""
    joined = ("\0" * PAD).join(rows) + "\0" * PAD
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]) if rows else np.zeros(0, dtype=np.int64)
    return codes, starts, lengths


def _hashes(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of subsequence: its hash at every position, and its decay."""
    n = len(codes) - PAD
    with np.errstate(over="ignore"):
        parts = [codes * np.uint32(m) ^ (codes >> np.uint32(3)) * np.uint32(m ^ 0x5BD1E995) for m in _MULTIPLIERS]
        for p, steps, decay in _COMBOS:
            h = parts[0][:n] + np.uint32(p * 97)
            for k, s in enumerate(steps, 1):
                h = h + parts[k][s : s + n]
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            yield h >> np.uint32(32 - BITS), decay


def position_scores(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The weights of all subsequences that begin at each position; in pieces that stay in the processor's cache."""
    out = np.zeros(max(0, len(codes) - PAD), dtype=np.float32)
    for at in range(0, len(out), PIECE):
        part = out[at : at + PIECE]
        for h, decay in _hashes(codes[at : at + PIECE + PAD]):
            part += table.take(h) * np.float32(decay)
    return out


def table_of(rows: list[str], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the sentences' length-normalised subsequence counts."""
    table = np.zeros(1 << BITS, dtype=np.float64)
    codes, starts, lengths = _coded(rows)
    each = np.zeros(len(codes) - PAD)
    for a, n, w in zip(starts, lengths, weights):
        each[a : a + n] = w / np.sqrt(n + 8.0)
    for h, decay in _hashes(codes):
        table += np.bincount(h, each * decay, minlength=1 << BITS)
    return table.astype(np.float32)


def _entries(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, length-normalised weight) of every subsequence."""
    codes, starts, lengths = _coded(rows)
    owner = np.full(len(codes) - PAD, -1, dtype=np.int32)
    for i, (a, n) in enumerate(zip(starts, lengths)):
        owner[a : a + n] = i
    inside = np.flatnonzero(owner >= 0)
    row = owner[inside]
    norm = (1 / np.sqrt(lengths + 8.0))[row].astype(np.float32)
    shapes = [(h[inside].astype(np.int32), d) for h, d in _hashes(codes)]
    return np.tile(row, len(shapes)), np.concatenate([h for h, _ in shapes]), np.concatenate([norm * np.float32(d) for _, d in shapes])


class Postings:
    """The subsequences of landmark sentences: for each the landmarks that hold it, and their weights."""

    def __init__(self, landmarks: list[str]):
        owner, hashes, weights = _entries(landmarks)
        pairs, place = np.unique(hashes.astype(np.int64) * len(landmarks) + owner, return_inverse=True)
        self.size = len(landmarks)
        self.weights = np.bincount(place, weights, minlength=len(pairs)).astype(np.float32)
        self.owner = (pairs % self.size).astype(np.int32)
        self.begin = np.searchsorted(pairs // self.size, np.arange((1 << BITS) + 1)).astype(np.int32)

    def kernels(self, rows: list[str]) -> np.ndarray:
        """The kernel of each row with each landmark: only landmarks that share a subsequence are touched."""
        row, h, w = _entries(rows)
        first, count = self.begin[h], self.begin[h + 1] - self.begin[h]
        kept = np.flatnonzero(count)
        first, count = first[kept], count[kept]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) - np.repeat(ends - count - first, count).astype(np.int32)
        where = np.repeat(row[kept] * np.int32(self.size), count) + self.owner[at]
        return np.bincount(where, np.repeat(w[kept], count) * self.weights[at], minlength=len(rows) * self.size).reshape(len(rows), self.size)


def kernel(rows: list[str], landmarks: list[str], chunk: int = 40) -> np.ndarray:
    """The length-normalised subsequence kernel of each row with each landmark, a chunk of rows at a time."""
    if not rows or not landmarks:
        return np.zeros((len(rows), len(landmarks)))
    held = Postings(landmarks)
    return np.concatenate([held.kernels(rows[at : at + chunk]) for at in range(0, len(rows), chunk)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Squared-hinge linear support vector machine with an intercept, by Newton steps on the support vectors."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-3

    def loss(v):
        m = np.maximum(0, 1 - y * (x @ v))
        return 0.5 * v @ reg @ v + c * np.sum(weight * m * m)

    now = loss(w)
    for _ in range(30):
        on = y * (x @ w) < 1
        xs, ws = x[on], weight[on]
        grad = reg @ w - 2 * c * (xs * (ws * (y[on] - xs @ w))[:, None]).sum(axis=0)
        step = np.linalg.solve(reg + 2 * c * (xs * ws[:, None]).T @ xs, grad)
        size = 1.0
        while size > 1e-3 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3 or now - then < 1e-6 * now:
            break
        w, now = w - size * step, then
    return w


class AbuseModel:
    def __init__(self, table: np.ndarray, bias: float, threshold: float):
        self.table, self.bias, self.threshold = table, bias, threshold

    def sentence_scores(self, rows: list[str]) -> np.ndarray:
        """Decision values; of a long sentence that of its worst window."""
        if not rows:
            return np.zeros(0)
        codes, starts, lengths = _coded(rows)
        sums = np.concatenate([[0.0], np.cumsum(position_scores(codes, self.table), dtype=np.float64)])
        out = (sums[starts + lengths] - sums[starts]) / np.sqrt(lengths + 8.0)
        for i in np.flatnonzero(lengths > LONG):
            at = starts[i] + np.arange(0, lengths[i] - WINDOW + STRIDE, STRIDE)
            end = np.minimum(at + WINDOW, starts[i] + lengths[i])
            out[i] = ((sums[end] - sums[at]) / np.sqrt(WINDOW + 8.0)).max()
        return out + self.bias

    def texts(self, texts: list[str | None]) -> list[float | None]:
        """The score of each text, that of its worst sentence; None of a text without words."""
        lists = sentences_of(texts)
        scores = self.sentence_scores([s for rows in lists for s in rows])
        out, at = [], 0
        for rows in lists:
            out.append(float(scores[at : at + len(rows)].max()) if rows else None)
            at += len(rows)
        return out


def passages(rows: list[str]) -> list[str]:
    """Sentences as they are learned from: long ones in windows."""
    return [p for r in rows for p in ([r] if len(r) <= LONG else [r[i : i + WINDOW] for i in range(0, len(r) - WINDOW + 2 * STRIDE, 2 * STRIDE)])]


def _pieces(row: str) -> list[str]:
    """Words; of text without spaces, pairs of characters."""
    return [x for w in row.split() for x in ([w[i : i + 2] for i in range(len(w) - 1)] if w[0] > "⿿" else [w])]


def fit_abuse(texts: list[tuple[str | None, bool]], seed: int = 7, clean_weight: float = 1.0) -> AbuseModel:
    """The model of (text, labelled abusive) documents; of none, that of the authored sentences.

    ``clean_weight`` is how many labelled clean documents a drawn one stands for, against an abusive one:
    the threshold is set for the documents as they come.
    """
    draw = np.random.default_rng(seed)
    authored = [x for s in sentences(ABUSIVE) for x in normal_sentences(s)]
    harmless = [x for s in sentences(CLEAN) for x in normal_sentences(s)]
    bad = [rows for t, y in texts if y and (rows := passages(normal_sentences(t)))]
    good = [rows for t, y in texts if not y and (rows := passages(normal_sentences(t)))]
    seen = Counter(s for rows in good for s in set(rows))
    pool = sorted(seen, key=lambda r: (-seen[r], r))
    if len(pool) > NEGATIVES:  # the commonest, and a draw of the rest
        rest = pool[NEGATIVES // 2 :]
        pool = pool[: NEGATIVES // 2] + [rest[i] for i in draw.permutation(len(rest))[: NEGATIVES - NEGATIVES // 2]]
    in_good, in_bad = (Counter(w for rows in docs for w in {w for r in rows for w in _pieces(r)}) for docs in (good, bad))
    least = MORE_OFTEN * len(bad) / max(1, len(good))

    def novelty(row: str) -> float:
        """The share of a sentence's words that abusive documents have much more often; 0 of code and of single words."""
        words = _pieces(row)
        if len(words) < 2 or any(len(w) > 16 or "0" in w and len(w) > 3 for w in words):
            return 0.0
        return sum(in_bad[w] > least * in_good[w] for w in words) / len(words)

    every = sorted({r for rows in good + bad for r in rows})
    positives = list(authored)
    model = None
    for step in range(ROUNDS):
        rows = positives + harmless + pool
        y = np.array([1.0] * len(positives) + [-1.0] * (len(harmless) + len(pool)))
        half = min(LANDMARKS // 2, len(positives))
        marks = [positives[i] for i in draw.permutation(len(positives))[:half]] + harmless[: LANDMARKS // 12]
        marks += pool[: LANDMARKS // 4]  # the commonest clean ones
        others = pool[LANDMARKS // 4 :]
        marks += [others[i] for i in draw.permutation(len(others))[: LANDMARKS - len(marks)]]
        k_mm = kernel(marks, marks)
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        kept = values > values.max() * 1e-6
        root = vectors[:, kept] / np.sqrt(values[kept])
        x = kernel(rows, marks) @ root
        weight = np.concatenate([np.full(len(positives), 2.0), np.full(len(harmless), 4.0), np.clip([seen[r] for r in pool], 1, 40) ** 0.7])
        w = _svm(x, y, weight)
        model = AbuseModel(table_of(marks, root @ w[:-1]), float(w[-1]), 0.0)
        if step + 1 < ROUNDS:
            found = list(authored)
            for own in bad:
                s = model.sentence_scores(own)
                if step and s.max() <= FLOOR:  # no sentence is near what is known: those in words that clean documents lack
                    found += [r for r in own if len(r) <= LONG and novelty(r) >= NOVEL]
                found += [own[i] for i in np.flatnonzero((s > 0.3) | ((s == s.max()) & (s > FLOOR))) if seen[own[i]] < OFTEN and novelty(own[i]) >= NEW]
            positives = sorted(set(found))
            # a rare sentence of documents labelled clean that looks abusive is taken for a wrong label
            s = model.sentence_scores(pool)
            pool = [r for r, v in zip(pool, s) if v < SUSPECT or seen[r] >= OFTEN]
            # sentences in usual words that come near the boundary, of any document, are learned as negatives
            near = [r for r, v in zip(every, model.sentence_scores(every)) if v > NEAR and novelty(r) < NEW]
            pool += [near[i] for i in draw.permutation(len(near))[: NEGATIVES // 4]]
            pool = list(dict.fromkeys(pool))
    if bad and good:
        scores = np.array([model.sentence_scores(rows).max() for rows in bad + good])
        y = np.array([True] * len(bad) + [False] * len(good))
        steps = np.linspace(-0.6, 1.2, 73)
        f = []
        for t in steps:
            hit = scores > t
            right = (y & hit).sum()
            f.append(2 * right / max(1e-9, y.sum() + right + clean_weight * (~y & hit).sum()))
        best = max(f)
        model.threshold = float(np.mean([t for t, v in zip(steps, f) if v >= best - 0.003]))
    return model


def fit_on(documents: DataFrame, labels: DataFrame, clean: int = FIT_CLEAN, abusive: int = FIT_ABUSIVE) -> AbuseModel:
    """The model fitted on bounded samples of the labelled documents; of contradicting labels the majority holds."""
    votes = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("vote")).where(F.col("vote") != 0.5)
    order = (F.xxhash64("doc_id"), "doc_id")
    counts = votes.agg(F.count_if(F.col("vote") > 0.5).alias("bad"), F.count_if(F.col("vote") < 0.5).alias("good")).first()
    drawn = votes.where(F.col("vote") > 0.5).orderBy(*order).limit(abusive).unionByName(votes.where(F.col("vote") < 0.5).orderBy(*order).limit(clean))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    rows = drawn.join(texts, "doc_id").orderBy(*order).select("text", (F.col("vote") > 0.5).alias("y")).toPandas()  # bounded
    weight = (max(1.0, counts["good"] / clean)) / (max(1.0, counts["bad"] / abusive))
    return fit_abuse([(t, bool(y)) for t, y in zip(rows["text"], rows["y"])], clean_weight=weight)


def abuse_scores(documents: DataFrame, model: AbuseModel) -> DataFrame:
    """``doc_id, source, score, abusive`` of every document.

    Null, empty and wordless texts have a null score and are not abusive; rows that repeat are scored
    each; null and blank sources are one; other columns are ignored.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                scores = model.texts(batch.column(2).to_pylist())
                found = [s is not None and s > model.threshold for s in scores]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(found, pa.bool_())], ["doc_id", "source", "score", "abusive"])

    return spread(slim).mapInArrow(run, "doc_id long, source string, score double, abusive boolean")


def p8_found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return abuse_scores(documents, fit_on(documents, labels)).where("abusive").select("doc_id")


def p8_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score."""
    return abuse_scores(documents, fit_on(documents, labels)).select("doc_id", "source", "score", "abusive")


def p8_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rate of abusive documents a source."""
    rated = abuse_scores(documents, fit_on(documents, labels))
    return rated.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("abusive").cast("long")).alias("abusive_docs"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
