"""Languages of texts and of their segments, where labels are missing or untrue.

A linear-chain conditional random field labels the words of a line: emissions from the word itself,
its affixes and its character n-grams, and transitions between words.  Both are trained together by the
gradient of the conditional log-likelihood, found by forward-backward; at prediction forward-backward gives
each word a distribution over languages.  A second chain runs over the lines of a text
(the main blocks of a page) with the words' expected characters as evidence, so that a line of code or
names takes its neighbours' language; its posterior is the confidence.

The field is trained on at most ``FIT_TEXTS`` texts that carry the label of a supported language,
in the order of a hash: a regression by word gives first weights, texts whose label it does not confirm drop out,
and the field is trained on ``CRF_LINES`` drawn runs of the words that are left, some of them joined across
languages.  Everyday words anchor each language.

A text mostly in the script of one other language is in that language; one whose words are made of n-grams the
fit never saw in the language found is in none that is known, and has no row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.page_blocks import unpack_body
from pagelathe.llm.residue import fit_bodies, page_tokens, worst
from pagelathe.llm.tongues import EVERYDAY, ISO_639_1, SPELLINGS, table
from pagelathe.session import sampled, slices, spread, stored

FIT_TEXTS = 4_000
LANGUAGES = [lang for lang, _ in table(EVERYDAY)]
BUCKETS = 1 << 15
#: Words whose emissions a worker remembers.
CACHE = 300_000
#: Characters of a word that are looked at together.
WINDOW = 40
#: Runs of words the field is trained on, their longest, the share of them that changes language, steps of the gradient.
CRF_LINES, CRF_WORDS, CRF_SWITCH, CRF_STEPS = 6_000, 16, 0.15, 20
#: Below this share of n-grams the fit has seen in the language found, of so many words and more, a text is in none that is known.
SEEN, SEEN_WORDS = 0.5, 5
# Scripts that name a language by themselves.
SCRIPTS = (("ko", r"[가-힯]"), ("ar", r"[؀-ۿ]"), ("hi", r"[ऀ-ॿ]"), ("he", r"[֐-׿]"), ("el", r"[Ͱ-Ͽ]"), ("th", r"[฀-๿]"))
#: What a line must hold to make a text mixed: words of its language, and confidence.
OWN_WORDS, OWN_PART, SURE = 4, 0.6, 0.8
# Labels that name no single language.
NO_LANGUAGE = frozenset("mul und zxx mis xx x default unknown none null other multi".split())

_ALIASES = {alias: code for code, aliases in table(SPELLINGS) for alias in aliases}
_WORD = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"[\u3000-\uffff]+|[^\u3000-\uffff]+")
_OTHER_SCRIPT = re.compile("|".join(p for _, p in SCRIPTS))
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_CODE = re.compile(r"^(?:\s{4,}|\t)\S|[{};]\s*$|^\s*(?:at \w+ \(|\$ |>>> |<[a-z!/])|\w+\(\)|\w=\S+ \w+=")


def label_of(written: str | None) -> str | None:
    """The ISO 639-1 code of a label however spelled; None if it names no single language."""
    if written is None:
        return None
    low = written.strip().lower()
    if low in _ALIASES:
        return _ALIASES[low]
    parts = [p for p in re.split(r"[-_\s.@]+", low) if p]
    if not parts or any(c in low for c in ",;/|+&"):
        return None
    first = parts[0]
    if first in NO_LANGUAGE:
        return None
    return first if first in ISO_639_1 else _ALIASES.get(first)


def parts_of(word: str) -> list[str]:
    """The parts of one lower-case word: runs of one script, text without spaces in pairs of characters, endless words in windows."""
    if len(word) <= WINDOW and word.isascii():
        return [word]
    out = []
    for run in _RUNS.findall(word):
        size = 2 if run[0] > "⿿" else WINDOW
        out += [run[i : i + size] for i in range(0, len(run), size)]
    return out


@lru_cache(maxsize=10_000)
def _code_of(written: str | None) -> str | None:
    return label_of(written)


def words_in(line: str) -> list[str]:
    return [p for w in _WORD.findall(line.lower()) for p in parts_of(w)]


def _traits(word: str) -> list[str]:
    """The word, its affixes, its n-grams, its script."""
    c = word[0]
    script = "latin" if c < "ͯ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "kana" if "぀" <= c <= "ヿ" else "han" if "㐀" <= c <= "鿿" else "other"
    out = ["w" + word, "s" + script]
    if script == "han" or script == "kana":
        out += ["c" + x for x in word] + ["k" + ("y" if any("぀" <= x <= "ヿ" for x in word) else "n")]
        return out
    out += ["p" + word[:k] for k in (1, 2, 3)] + ["e" + word[-k:] for k in (1, 2, 3)]
    padded = f"<{word}>"
    out += ["n" + padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def _bucket(trait: str) -> int:
    return zlib.crc32(trait.encode()) % BUCKETS


class LanguageModel:
    """Emission weights by hashed trait, transitions of words within a line and of lines within a text."""

    def __init__(self, weights: np.ndarray, words: np.ndarray, lines: np.ndarray, seen: np.ndarray | None = None, told: np.ndarray | None = None):
        self.weights, self.words, self.lines = weights, words, lines
        self.seen = seen if seen is not None else np.zeros(weights.shape, dtype=bool)
        self.told = told if told is not None else np.zeros(weights.shape[1], dtype=bool)  # languages of which enough was seen to tell strange n-grams
        self.key = zlib.crc32(weights.tobytes() + words.tobytes() + lines.tobytes())

    def emissions(self, word: str) -> np.ndarray:
        """Log scores of a word, one a language; none of them certain."""
        return self.scored(word)[0]

    def scored(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(``emissions``, by language the share of its n-grams that the fit has seen there)."""
        traits = _traits(word)
        buckets = [_bucket(t) for t in traits]
        s = self.weights[buckets].sum(axis=0)
        s = s - s.max()
        grams = [b for b, t in zip(buckets, traits) if t[0] in "nc"]
        seen = self.seen[grams].mean(axis=0) if grams else np.ones(len(LANGUAGES))
        return np.maximum(s - math.log(np.exp(s).sum()), -7.0), seen


class Labeller(dict):
    """A worker's view of a model: text word -> row of its emissions; -1 for what is no word, below that -2 - index of a list of rows."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.lists: list[list[int]] = []
        self.rows = np.zeros((4096, len(LANGUAGES)), dtype=np.float32)
        self.lengths = np.zeros(4096, dtype=np.float32)
        self.seen = np.zeros((4096, len(LANGUAGES)), dtype=np.float32)
        self.used = 0
        self.parts: dict[tuple[str, bool], int] = {}

    def _row(self, part: str, endless: bool = False) -> int:
        """The row of a part; one of an endless word counts only as far as its n-grams are known in some language."""
        k = self.parts.get((part, endless))
        if k is None:
            k = self.parts[part, endless] = self.used
            self.used += 1
            if k >= len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
                self.seen = np.vstack([self.seen, np.zeros_like(self.seen)])
            emissions, seen = self.model.scored(part)
            self.rows[k] = np.exp(emissions)
            self.seen[k] = np.where(self.model.told, seen, 1.0)
            self.lengths[k] = len(part) * (seen.max() if endless else 1.0)
        return k

    def __missing__(self, word: str) -> int:
        if not word[0].isalpha():
            self[word] = -1
            return -1
        parts = parts_of(word)
        if len(parts) == 1:
            v = self._row(parts[0])
        else:
            endless = len(word) > WINDOW and word[0] < "\u3000"
            self.lists.append([self._row(p, endless) for p in parts])
            v = -1 - len(self.lists)
        self[word] = v
        return v

    def line(self, line: str, words: list[str] | None = None) -> list[int]:
        """Rows of the words of a line; ``words`` are those in it, with its numbers and marks, if they are known."""
        found = list(map(self.__getitem__, _WORD.findall(line.lower()) if words is None else words))
        least = min(found, default=0)
        if least == -1:
            return [k for k in found if k >= 0]
        if least < -1:
            return [k for f in found if f != -1 for k in ((f,) if f >= 0 else self.lists[-2 - f])]
        return found

    def texts(self, texts: list[list[str]], known: dict[str, list[str]] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, given as its segments: (language index, confidence, expected characters by language, words, share of seen n-grams) a segment."""
        known = known or {}
        if len(self) > CACHE:
            self.forget()
        flat, sizes = [], []
        ids: list[int] = []
        for segments in texts:
            for line in segments:
                found = self.line(line, known.get(line))
                ids += found
                sizes.append(len(found))
            flat.append(len(segments))
        sizes_a, ids_a = np.array(sizes, dtype=np.int64), np.array(ids, dtype=np.int64)
        chars = chain(self.rows, ids_a, self.lengths[ids_a] if ids else np.zeros(0, dtype=np.float32), sizes_a, self.model.words)
        # evidence of a line: its share of each language, the stronger the more words it has
        total = chars.sum(axis=1, keepdims=True)
        strength = np.minimum(sizes_a, 12)[:, None] * 0.7
        evidence = np.exp(strength * np.log((chars + 0.02 * total + 1e-3) / (total * (1 + 0.02 * len(LANGUAGES)) + 1e-3 * len(LANGUAGES)))).astype(np.float32)
        posterior = chain_posteriors(evidence, np.array(flat, dtype=np.int64), self.model.lines)
        best, sure = (posterior.argmax(axis=1), posterior.max(axis=1)) if len(posterior) else (np.zeros(0, dtype=np.int64), np.zeros(0))
        seen = np.zeros(len(sizes_a))
        if ids:
            owner = np.repeat(np.arange(len(sizes_a)), sizes_a)
            seen = np.bincount(owner, self.seen[ids_a, best[owner]], minlength=len(sizes_a))
        out, at = [], 0
        for n in flat:
            out.append((best[at : at + n], sure[at : at + n], chars[at : at + n], sizes_a[at : at + n], seen[at : at + n]))
            at += n
        return out


_LABELLERS: dict[int, Labeller] = {}


def labeller_of(model: LanguageModel) -> Labeller:
    """The labeller a Python worker keeps from task to task."""
    if model.key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.key] = Labeller(model)
    return _LABELLERS[model.key]


def _by_length(sizes: np.ndarray, cells: int = 200_000) -> Iterator[tuple[np.ndarray, int]]:
    """Sequences of like length together, so that padding stays small: (their indexes, the longest)."""
    order = np.argsort(sizes, kind="stable")
    at = int(np.searchsorted(sizes[order], 1))
    while at < len(order):
        first = int(sizes[order[at]])
        end = at
        while end < len(order) and sizes[order[end]] <= first * 1.2 + 1 and (end - at + 1) * sizes[order[end]] <= max(cells, sizes[order[at]]):
            end += 1
        end = max(end, at + 1)
        yield order[at:end], int(sizes[order[end - 1]])
        at = end


def _forward_backward(e: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posteriors of sequences (steps, sequences, labels) by scaled forward-backward."""
    steps, n, k = e.shape
    live = lengths[None, :] > np.arange(steps)[:, None]
    alpha = np.empty_like(e)
    beta = np.ones((n, k), dtype=e.dtype)
    f = e[0] / k
    alpha[0] = f / f.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        f = (alpha[t - 1] @ a) * e[t]
        alpha[t] = f / f.sum(axis=1, keepdims=True)
    at = a.T.copy()
    for t in range(steps - 1, -1, -1):
        p = alpha[t] * beta
        if t:
            b = (beta * e[t]) @ at
            b /= b.sum(axis=1, keepdims=True)
            beta = np.where(live[t][:, None], b, 1.0).astype(e.dtype)
        alpha[t] = p / p.sum(axis=1, keepdims=True)
    return alpha


def chain(rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected characters of each language in each line."""
    out = np.zeros((len(sizes), rows.shape[1]), dtype=np.float32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    a = transitions.astype(np.float32)
    for lines, longest in _by_length(sizes):
        steps = np.arange(longest)[:, None]
        n = sizes[lines]
        where = np.minimum(starts[lines][None, :] + steps, len(ids) - 1)
        live = steps < n[None, :]
        e = rows[ids[where]]
        e[~live] = 1.0
        p = _forward_backward(e, n, a)
        out[lines] = np.einsum("tnk,tn->nk", p, np.where(live, lengths[where], 0.0).astype(np.float32))
    return out


def chain_posteriors(evidence: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posteriors of each line over the languages."""
    out = np.zeros_like(evidence)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    a = transitions.astype(np.float32)
    for texts, longest in _by_length(sizes, 50_000):
        steps = np.arange(longest)[:, None]
        n = sizes[texts]
        where = np.minimum(starts[texts][None, :] + steps, len(evidence) - 1)
        live = steps < n[None, :]
        e = evidence[where]
        e[~live] = 1.0
        p = _forward_backward(e, n, a)
        out[where[live]] = p[live]
    return out


def _sticky(stay: float) -> np.ndarray:
    k = len(LANGUAGES)
    return np.full((k, k), (1 - stay) / (k - 1)) + np.eye(k) * (stay - (1 - stay) / (k - 1))


def _trait_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of a word, of its trait among those used) of every trait of every word, and the buckets used."""
    rows, cols = [], []
    for i, w in enumerate(words):
        b = [_bucket(t) for t in _traits(w)]
        rows += [i] * len(b)
        cols += b
    used, cols = np.unique(np.array(cols, dtype=np.int64), return_inverse=True)
    return np.array(rows, dtype=np.int64), cols, used


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``index``."""
    return np.stack([np.bincount(index, values[:, j], minlength=n) for j in range(values.shape[1])], axis=1)


def _fit_emissions(counts: dict[str, np.ndarray], rounds: int = 40) -> np.ndarray:
    """Multinomial regression of the language on a word's traits, by adaptive gradient steps."""
    words = list(counts)
    y = np.array([counts[w] for w in words])
    n = y.sum(axis=1)
    y = y / n[:, None]
    weight = np.minimum(n, 30.0) ** 0.5
    rows, cols, used = _trait_rows(words)
    k = y.shape[1]
    w, g2 = np.zeros((len(used), k)), np.full((len(used), k), 1e-2)
    for _ in range(rounds):
        z = _sums(rows, w[cols], len(words))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - y) * weight[:, None]
        g = _sums(cols, d[rows], len(used)) + 0.02 * w
        g2 += g * g
        w -= 0.6 * g / np.sqrt(g2)
    full = np.zeros((BUCKETS, k))
    full[used] = w
    return full


def log_likelihood(z: np.ndarray, t: np.ndarray, ids: np.ndarray, gold: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The conditional log-likelihood of labelled runs of words, with its gradients by emission score and by transition.

    ``z`` are scores by word and label, ``t`` by label and next; ``ids`` and ``gold`` the words and labels of all runs
    one after another, ``sizes`` the lengths of the runs.
    """
    k = z.shape[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    gz, gt, total = np.zeros_like(z), np.zeros_like(t), 0.0
    a = np.exp(t)
    for runs, longest in _by_length(sizes):
        n, steps = sizes[runs], np.arange(longest)[:, None]
        where = np.minimum(starts[runs][None, :] + steps, len(ids) - 1)
        live = steps < n[None, :]
        word, label = ids[where], gold[where]
        e = z[word]
        top = e.max(axis=2, keepdims=True)
        e = np.exp(e - top)
        alpha, norm = np.empty_like(e), np.ones(live.shape)
        for s in range(longest):
            f = e[s] if s == 0 else (alpha[s - 1] @ a) * e[s]
            norm[s] = np.where(live[s], f.sum(axis=1), 1.0)
            alpha[s] = f / f.sum(axis=1, keepdims=True)
        total -= (np.log(norm)[live].sum() + top[:, :, 0][live].sum())
        total += z[word[live], label[live]].sum()
        beta = np.ones((len(runs), k))
        for s in range(longest - 1, -1, -1):
            on = live[s]
            p = alpha[s] * beta
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(runs)), label[s]] -= 1.0
            gz -= _sums(word[s][on], p[on], len(z))
            if s:
                right = (e[s] * beta)[on]
                pair = alpha[s - 1][on].T @ (right / ((alpha[s - 1][on] @ a) * right).sum(axis=1, keepdims=True)) * a
                before, after = label[s - 1][on], label[s][on]
                total += t[before, after].sum()
                gt -= pair
                np.add.at(gt, (before, after), 1.0)
                b = (e[s] * beta) @ a.T
                beta = np.where(on[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
    return total, gz, gt


def _fit_field(weights: np.ndarray, runs: list[tuple[list[str], list[int]]], steps: int = CRF_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transition scores) that raise the likelihood of labelled runs, from weights to begin with."""
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for ws, _ in runs for w in ws], dtype=np.int64)
    gold = np.array([y for _, ys in runs for y in ys], dtype=np.int64)
    sizes = np.array([len(ws) for ws, _ in runs], dtype=np.int64)
    rows, cols, used = _trait_rows(list(place))
    w, first = weights[used].copy(), weights[used]
    t = np.log(_sticky(0.9))
    begin = t.copy()
    gw2, gt2 = np.full(w.shape, 1e-2), np.full(t.shape, 1.0)
    for _ in range(steps):
        _, gz, gt = log_likelihood(_sums(rows, w[cols], len(place)), t, ids, gold, sizes)
        gw = _sums(cols, gz[rows], len(used)) - 0.05 * (w - first)
        gt = gt - 0.5 * (t - begin)
        gw2 += gw * gw
        gt2 += gt * gt
        w += 0.2 * gw / np.sqrt(gw2)
        t += 0.2 * gt / np.sqrt(gt2)
    out = weights.copy()
    out[used] = w
    return out, t


def _training_runs(texts: list[tuple[list[str], int]], seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """At most ``CRF_LINES`` runs of words with their labels, drawn over all lines and all of each line; some join two languages."""
    draw = np.random.default_rng(seed)
    pieces = []
    for lines, y in texts:
        for line in lines:
            words = words_in(line)
            pieces += [(words[i : i + CRF_WORDS], y) for i in range(0, len(words), CRF_WORDS)]
    if not pieces:
        return []
    out = []
    for i in draw.permutation(len(pieces))[:CRF_LINES].tolist():
        words, y = pieces[i]
        labels = [y] * len(words)
        if draw.random() < CRF_SWITCH:
            more, other = pieces[int(draw.integers(len(pieces)))]
            words, labels = words[: CRF_WORDS // 2] + more[: CRF_WORDS // 2], labels[: CRF_WORDS // 2] + [other] * len(more[: CRF_WORDS // 2])
        out.append((words, labels))
    return out


def fit_languages(texts: list[tuple[str, str | None]]) -> LanguageModel:
    """The model of (text, label as written); everyday words alone make one of no texts at all."""
    place = {lang: i for i, lang in enumerate(LANGUAGES)}
    k = len(LANGUAGES)
    labelled = [(t.split("\n"), place[c]) for t, written in texts if t and (c := label_of(written)) in place]
    model, confirmed = None, labelled
    for _ in range(2):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.full(k, 1e-3))
        for lang, ws in table(EVERYDAY):
            for w in ws:
                for x in words_in(w):
                    counts[x][place[lang]] += 25.0
        held = [0.0] * k
        if model and labelled:
            agreed = Labeller(model).texts([lines for lines, _ in labelled])
            shares = [(found[2].sum(axis=0), y) for found, (_, y) in zip(agreed, labelled)]
            confirmed = [own for own, (seen, y) in zip(labelled, shares) if seen.sum() > 0 and seen[y] >= 0.9 * seen.sum()]
        for lines, y in confirmed:
            for line in lines:
                for w, n in Counter(words_in(line)).items():
                    counts[w][y] += n
                    held[y] += n
        # a language with many texts must not outweigh the others in words they share
        scale = np.array([1.0 / max(h, 2000.0) for h in held]) * 2000.0
        scaled = {w: c * np.maximum(scale, 0.02) for w, c in counts.items()}
        model = LanguageModel(_fit_emissions(scaled), _sticky(0.97), _sticky(0.8))
    seen = np.zeros((BUCKETS, k), dtype=bool)
    for w, c in counts.items():
        seen[np.ix_([_bucket(x) for x in _traits(w) if x[0] in "nc"], np.flatnonzero(c >= 1.0))] = True
    told = np.array(held) >= 2000.0
    model = LanguageModel(model.weights, model.words, model.lines, seen, told)
    runs = _training_runs(confirmed)
    if runs:
        weights, t = _fit_field(model.weights, runs)
        model = LanguageModel(weights, np.exp(t - t.max()), model.lines, seen, told)
    if labelled:
        model = LanguageModel(model.weights, model.words, _line_transitions(model, [lines for lines, _ in labelled]), seen, told)
    return model


def _line_transitions(model: LanguageModel, texts: list[list[str]]) -> np.ndarray:
    """Transitions between neighbouring lines of a text, by expected counts."""
    k = len(LANGUAGES)
    of_lines = np.full((k, k), 0.2) + np.eye(k) * 20
    for found, confidence, *_ in Labeller(model).texts(texts):
        for a, b, c, d in zip(found[:-1], found[1:], confidence[:-1], confidence[1:]):
            of_lines[a, b] += c * d
    return of_lines / of_lines.sum(axis=1, keepdims=True)


def foreign(segments: list[str]) -> tuple[str, float] | None:
    """(language, share of the letters) of a text that is mostly in the script of one other language."""
    text = "".join(segments)
    if not _OTHER_SCRIPT.search(text):
        return None
    letters = sum(map(len, _WORD.findall(text)))
    n, lang = max((len(re.findall(p, text)), lang) for lang, p in SCRIPTS)
    return (lang, n / letters) if 2 * n > letters else None


def verdicts(segments: list[str], code, quoted, found, confidence, chars, words, seen) -> tuple[str | None, float, list[str] | None]:
    """(main language, its confidence, languages of the segments if the text is mixed) of one text.

    None without words, or in no language that is known.  ``code`` and ``quoted`` tell which segments are code and
    quotations; they are asked only where languages differ.
    A segment makes a text mixed only with enough prose of its own language that is no quotation.
    """
    n = chars.sum(axis=1)
    spoken = n > 0
    if not spoken.any():
        return None, 0.0, None
    if (other := foreign(segments)) is not None:
        return *other, None
    if words.sum() >= SEEN_WORDS and seen.sum() < SEEN * words.sum():
        return None, 0.0, None
    first = found[spoken][0]
    if (found[spoken] == first).all():
        return LANGUAGES[first], float((n * confidence)[spoken].sum() / n[spoken].sum()), None
    prose = spoken & ~np.array(code(), dtype=bool)
    sizes = np.array([len(line) for line in segments], dtype=float)
    total = np.bincount(found, np.where(prose, sizes, np.where(spoken, 0.05 * n, 0.0)), minlength=len(LANGUAGES))
    main = int(total.argmax())
    own = prose & ~np.array(quoted(), dtype=bool) & (confidence >= SURE) & (chars[np.arange(len(found)), found] >= OWN_PART * n) & (words >= OWN_WORDS)
    mixed = len(set(found[own].tolist())) > 1
    if not mixed:
        return LANGUAGES[main], float(total[main] / total.sum()), None
    parts, last = [], int(found[prose][0])
    for i, own_language in enumerate(found.tolist()):
        last = own_language if prose[i] else last  # code and lines without words go with the text before them
        parts.append(LANGUAGES[last])
    return LANGUAGES[main], float(total[main] / total.sum()), parts


def _code_lines(text: str) -> list[bool]:
    """For each non-blank line, whether it is code: fenced, indented or of its shape."""
    out, inside = [], False
    for line in text.split("\n"):
        if line.strip():
            fence = bool(_FENCE.match(line))
            out.append(inside or fence or bool(_CODE.search(line)))
            inside ^= fence
    return out


FOUND = "row_id long, code string, lang string, confidence double, mixed boolean, segment_nos array<long>, segment_langs array<string>, segment_confidences array<double>"


def _found(labeller: Labeller, ids: list, written: list, lists: list[list[str]], numbers: Callable[[int], list[int]], code: Callable[[int], list[bool]], quoted: Callable[[int], list[bool]], known: dict[str, list[str]]) -> list[pa.Array]:
    """The columns of ``FOUND`` for texts given as segments with their labels as written; numbers, code and quotations of a text are asked only where they matter."""
    langs, sure, mixed, nos, seg_langs, seg_sure = [], [], [], [], [], []
    for i, (segments, found) in enumerate(zip(lists, labeller.texts(lists, known))):
        lang, c, parts = verdicts(segments, lambda i=i: code(i), lambda i=i: quoted(i), *found)
        langs.append(lang)
        sure.append(c)
        mixed.append(parts is not None)
        seg_langs.append(parts or [])
        seg_sure.append(found[1].tolist() if parts else [])
        nos.append(numbers(i) if parts else [])
    return [
        pa.array(ids, pa.int64()), pa.array(map(_code_of, written), pa.string()), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(mixed, pa.bool_()),
        pa.array(nos, pa.list_(pa.int64())), pa.array(seg_langs, pa.list_(pa.string())), pa.array(seg_sure, pa.list_(pa.float64())),
    ]


def segment_languages(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``row_id, code, lang, confidence, mixed, segment_nos, segment_langs, segment_confidences`` for ``row_id, text, written``.

    ``code`` is what the label as written names, ``lang`` what the text is in.  Texts are split at line feeds; numbers are 0-based, and blank lines have none.  Null, empty and
    wordless texts come out with lang null; rows that repeat are labelled each.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(model)
        for whole in batches:
            for batch in slices(whole, 2000):
                ids, given, written = (c.to_pylist() for c in batch.columns)
                lists = [[line for line in (text or "").split("\n") if line.strip()] for text in given]
                numbers = lambda i, given=given: [k for k, line in enumerate(given[i].split("\n")) if line.strip()]
                yield pa.RecordBatch.from_arrays(_found(labeller, ids, written, lists, numbers, lambda i, given=given: _code_lines(given[i]), lambda i, lists=lists: [line.lstrip().startswith(">") for line in lists[i]], {}), names)

    return texts.select("row_id", "text", "written").mapInArrow(run, FOUND)


def page_languages(pages: DataFrame, crawl_records: DataFrame, model: LanguageModel) -> DataFrame:
    """The same for the main bodies of pages and their lang attribute; pages that hold residue are left out.

    Segments are main blocks under their numbers.  Bodies are found once and stored, residue is fitted on all of
    them, and one pass finds residue and languages.
    """
    held = page_tokens(pages)
    residue = fit_bodies(held, crawl_records)
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(model)
        for whole in batches:
            for batch in slices(whole):
                ids, langs, bodies = (c.to_pylist() for c in batch.columns[:3])
                rows = [(i, lang, unpack_body(body)) for i, lang, body, v in zip(ids, langs, bodies, worst(residue, batch.column(3)).tolist()) if not v > 0]
                blocks = [[b for b in body if b.text.strip()] for _, _, body in rows]
                lists = [[b.text for b in own] for own in blocks]
                yield pa.RecordBatch.from_arrays(_found(labeller, [r[0] for r in rows], [r[1] for r in rows], lists, lambda i, blocks=blocks: [b.no for b in blocks[i]], lambda i, blocks=blocks: [b.tag == "pre" for b in blocks[i]], lambda i, blocks=blocks: [b.tag == "blockquote" for b in blocks[i]], {}), names)

    return held.select("page_id", "lang", "body", "passages").mapInArrow(run, FOUND)


def fit_on(documents: DataFrame, bound: int = FIT_TEXTS) -> LanguageModel:
    """The model fitted on at most ``bound`` labelled documents, in the order of a hash of their id."""
    some = documents.where((F.length(F.trim("lang")) > 0) & (F.length("text") > 0))
    labelled = sampled(some, "doc_id", bound, some.count())
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).toPandas()  # bounded
    return fit_languages(list(zip(rows["text"], rows["lang"])))


def coded(df: DataFrame) -> DataFrame:
    """``df`` of ``row_id, lang, written`` with ``code``, what the label as written names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(_code_of, batch.column(2).to_pylist()), pa.string())], ["row_id", "lang", "code"])

    return df.select("row_id", "lang", "written").mapInArrow(run, "row_id long, lang string, code string")


def p4_found(documents: DataFrame, pages: DataFrame, content_reports: DataFrame, crawl_records: DataFrame) -> DataFrame:
    """``origin, row_id, segment_no, lang``: labels that are missing or untrue, and the segments of mixed texts."""
    model = fit_on(documents)
    texts = documents.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("written"))
    of_pages = stored(page_languages(pages, crawl_records, model).where(F.col("lang").isNotNull()))
    reports = content_reports.select(F.col("report_id").cast("long").alias("report_id"), F.col("page_id").cast("long").alias("row_id"), F.col("language").cast("string").alias("written"))
    of_reports = coded(of_pages.select("row_id", "lang").join(reports, "row_id").select(F.col("report_id").alias("row_id"), "lang", "written"))
    untrue = F.col("code").isNull() | (F.col("code") != F.col("lang"))

    def rows(origin: str, found: DataFrame) -> DataFrame:
        """The row of an untrue label and those of segments, in one pass over what was found."""
        segments = F.transform("segment_nos", lambda no, i: F.struct(no.alias("segment_no"), F.col("segment_langs")[i].alias("lang")))
        label = F.when(untrue, F.array(F.struct(F.lit(-1).cast("long").alias("segment_no"), F.col("lang").alias("lang")))).otherwise(F.array().cast("array<struct<segment_no:bigint,lang:string>>"))
        return found.where(F.col("lang").isNotNull() & (untrue | F.col("mixed"))).select(F.lit(origin).alias("origin"), "row_id", F.inline(F.concat(label, segments)))

    of_documents = segment_languages(spread(texts), model)
    report_rows = of_reports.where(untrue).select(F.lit("report").alias("origin"), "row_id", F.lit(-1).cast("long").alias("segment_no"), "lang")
    return rows("document", of_documents).unionByName(rows("page", of_pages)).unionByName(report_rows)
