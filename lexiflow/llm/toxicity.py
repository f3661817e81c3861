"""Toxicity: noisy-channel restoration of disguised words, then a score.

1. A character trigram model is counted over all documents.
2. Words that look disguised (digits or signs among or around letters or in
   their place, letters repeated three times or more, single letters set apart)
   become lattices: each sign may stand for the letters it resembles or for
   nothing, a run of a letter for one or two of it, a space between single
   letters for a word break or for nothing.  Viterbi finds the READINGS paths
   that the character model and the channel costs like best.  A number is read
   as such.
3. All readings are looked up, whole or else by their first letters, in a
   table of log-odds learned from a bounded sample of labelled documents,
   near copies counted once.  An entry must be more frequent in toxic documents
   than chance explains over all entries tried.  A document's score is the
   logistic of the prior plus its strongest words.

Scores use the text alone.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .rows import with_columns
from .samples import ROWS_PER_CLASS, in_fit_fold, labelled_sample, without_copies
from .workers import lean

#: Characters of the model: code points below this that are lower-case letters; all others are one class.
CODES = 0x100
#: Words whose evidence is added up, the least evidence of a word, entries kept of the table.
TOP_WORDS, LEAST, MODEL_ENTRIES = 3, 2.5, 20_000
#: Lower bound of the log-odds, in standard deviations; share of toxic sample documents an entry needs;
#: chance that a table without any real entry would get one.
DEVIATIONS, SUPPORT, CHANCE = 1.0, 0.001, 0.5
#: Evidence that a restored word loses, as a disguise may be an accident.
DISGUISE = 0.5
#: Readings of a disguised word that are looked up.
READINGS = 8
#: Words that a Python worker remembers.
KEPT = 100_000

# What signs and digits stand for in disguised words.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
SWAP_COST, DROP_COST, DOUBLE_COST = 1.0, 2.0, 1.0
#: Of a sign at a word's edge that is no punctuation (which costs nothing there).
EDGE_COST = 0.5
_FILLERS = "*.-_~'`^+#,"
_STOPS = ".,;:!?\"'()[]{}<>|…«»“”‘’¡¿"
_SIGNS = _STOPS + "*%&$#-_~`^+=/\\"
_REPEAT = re.compile(r"(.)\1\1")
_APART = re.compile(rf"(?<!\S)[{re.escape(_STOPS)}]*\S(?:[ \t]+\S(?!\S))+[ \t]+\S[{re.escape(_SIGNS)}]*(?!\S)")
_EDGES = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_GAP = re.compile(r"[ \t]+")
_NUMBER = re.compile(r"[+\-#]?[$€£]?\d+(?:[.,:/'\-]\d+)*[%$€£]?")


def _classes() -> tuple[np.ndarray, int]:
    """Class of each code point below CODES (0: no letter), and their number."""
    out, n = np.zeros(CODES, np.int64), 0
    for i in range(CODES):
        if chr(i).isalpha() and chr(i).lower() == chr(i):
            n += 1
            out[i] = n
    return out, n + 1


CLASS, N_CLASSES = _classes()


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(N_CLASSES ** 3, np.int64)
    for b in batches:
        part, size = [], 0
        for t in [*b["text"], None]:
            if isinstance(t, str):
                part.append(t)
                size += len(t)
            if part and (t is None or size > 1 << 20):
                codes = np.frombuffer((" " + " ".join(part).lower() + " ").encode("utf-32-le", "replace"), np.uint32)
                c = np.where(codes < CODES, CLASS[np.minimum(codes, CODES - 1)], 0)
                total += np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=len(total))
                part, size = [], 0
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at]})


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a character class after two others, N_CLASSES**3
    numbers (a fixed size) from the counts of all texts."""
    rows = (docs.select(F.col(text_col).alias("text")).mapInPandas(lean(_count_trigrams), "gram long, n long")
                .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    n3 = np.zeros(N_CLASSES ** 3)
    n3[[r["gram"] for r in rows]] = [r["n"] for r in rows]
    n3 = n3.reshape(N_CLASSES, N_CLASSES, N_CLASSES)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + N_CLASSES)
    p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
    p3 = (n3 + 8 * p2[None]) / (n3.sum(2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


_PLAIN = {chr(i): int(c) for i, c in enumerate(CLASS)}


def _plain(ch: str) -> int:
    return _PLAIN.get(ch, 0)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each sign or run of letters: what it may stand for, and the cost.
    Signs at the edges may also be dropped; a space may be a break or nothing,
    two spaces (a wider gap) are more likely a break."""
    out: list[list[tuple[str, float]]] = []
    first, last = len(word) - len(word.lstrip(_SIGNS)), len(word.rstrip(_SIGNS))
    i = 0
    while i < len(word):
        c, j = word[i], i + 1
        while j < len(word) and word[j] == c:
            j += 1
        if c.isalpha():
            if j - i <= 2 and i > 0 and len(out[-1]) == 1:     # letters that stand for themselves are one step
                out[-1] = [(out[-1][0][0] + word[i:j], out[-1][0][1])]
            elif j - i <= 2:
                out.append([(word[i:j], 0.0)])
            else:
                out.append([(c, DOUBLE_COST), (c + c, DOUBLE_COST)])
        elif c == " ":
            out.append([(" ", 0.0), ("", 0.0 if j - i == 1 else DROP_COST)])
        else:
            options = [(x, SWAP_COST) for x in LOOKALIKES.get(c, "")]
            if j - i > 1:
                options += [(x + x, SWAP_COST) for x in LOOKALIKES.get(c, "")]
            if i < first or i >= last:
                options.append(("", 0.0 if c in _STOPS else EDGE_COST))
            elif c in _FILLERS or not options:
                options.append(("", DROP_COST if c not in "._-" else 0.5))
            out.append(options)
        i = j
    return out


def restore(word: str, model: np.ndarray, k: int = READINGS) -> list[str]:
    """The ``k`` best paths of the word's lattice, best first (Viterbi that keeps
    ``k`` paths to a state); states are the last two characters."""
    states: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
    for options in lattice(word):
        after: dict[tuple[int, int], list[tuple[float, tuple | None]]] = defaultdict(list)
        for (a, b), paths in states.items():
            for text, cost in options:
                x, y, s = a, b, -cost
                for ch in text:
                    z = _PLAIN.get(ch, 0)
                    s += model.item(x, y, z)
                    x, y = y, z
                after[x, y] += [(score + s, (done, text)) for score, done in paths]
        states = {at: paths if len(paths) <= k else heapq.nlargest(k, paths, key=lambda p: p[0])
                  for at, paths in after.items()}
    ends = [(score + model.item(a, b, 0), done) for (a, b), paths in states.items() for score, done in paths]
    out = []
    for _, done in heapq.nlargest(k, ends, key=lambda p: p[0]):
        parts = []
        while done is not None:
            done, text = done
            parts.append(text)
        out.append("".join(reversed(parts)))
    return list(dict.fromkeys(out))


def _disguised(word: str) -> bool:
    """A letter three times running, letters set apart, or signs that may stand
    for letters, alone or with letters or fillers.  Not a number, nor what
    cannot become three letters, as no shorter word is looked up."""
    if word.isalpha():
        return _REPEAT.search(word) is not None
    if len(word) < 3:
        return False
    core = word.strip(_SIGNS)
    if core.isalpha():
        if _EDGES.search(word) is None and _REPEAT.search(core) is None and " " not in word:
            return False
        if len(core) >= 3:
            return True
    elif not all(c.isalpha() or c in LOOKALIKES or c in _FILLERS or c == " " for c in core):
        return False
    if all(_NUMBER.fullmatch(w.strip(_STOPS)) for w in word.split()):
        return False
    return sum(max(len(text.strip()) for text, _ in options) for options in lattice(word)) >= 3


def stems(word: str) -> list[str]:
    """The first four to six letters of a word that has more."""
    return [word[:k] + "-" for k in range(4, 7) if len(word) > k]


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words; single letters set apart also put together,
    and as they stand (with one space, or two where the gap is wider)."""
    t = unicodedata.normalize("NFKC", text).lower() if not text.isascii() else text.lower()
    found = set(t.split())
    if any(len(w) == 1 for w in found):
        for m in _APART.finditer(t):
            least = min(map(len, _GAP.findall(m.group())))
            found.add("".join(m.group().split()))
            found.add(_GAP.sub(lambda g: " " if len(g.group()) == least else "  ", m.group()))
    return found


class Reader:
    """Words to restored words."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def readings(self, word: str) -> list[tuple[tuple[str, ...], bool]]:
        """What a word may be, best first (single letters set apart may be
        several words), and whether more than its edges differs."""
        plain = word if word.isalpha() else word.strip(_SIGNS)
        if not _disguised(word):
            return [(tuple(plain.split()), False)]
        texts = restore(word, self.model)
        if plain.isalpha() and plain not in texts and _REPEAT.search(plain) is None:
            texts.append(plain)
        return [(tuple(t.split()), t != plain) for t in texts]

    def read(self, word: str) -> tuple[str, bool]:
        words, changed = self.readings(word)[0]
        return " ".join(words), changed


def _fit_counts(batches: Iterator[pd.DataFrame], model: np.ndarray, wanted: frozenset | None, without: frozenset | None):
    """Documents with each word, or (``without`` given) with each stem of other
    words than those; under the empty feature all documents."""
    reader, seen, total = Reader(model), Counter(), 0
    kept: dict[str, list[str]] = {}
    for b in batches:
        for t in b["text"]:
            total += 1
            if isinstance(t, str):
                f = set()
                for word in words_of(t):
                    if word not in kept:
                        if len(kept) >= KEPT:
                            kept.clear()
                        kept[word] = [w for words, _ in reader.readings(word) for w in words if len(w) >= 3]
                    f.update(kept[word])
                if without is not None:
                    f = {x for w in f - without for x in stems(w)}
                seen.update(f if wanted is None else f & wanted)
    yield pd.DataFrame({"feature": [*seen, ""], "n": [*seen.values(), total]})


def _divergence(p: float, q: float) -> float:
    """Of Bernoulli p from q, where p is above q (else 0): times n, it bounds the
    log-chance of so high a share of toxic documents without any cause."""
    if p <= q:
        return 0.0
    return p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0.0)


class Scorer:
    """Log-odds of words; made on the driver, shipped to the tasks (at most
    MODEL_ENTRIES entries and the character model)."""

    def __init__(self, model: np.ndarray, odds: dict[str, float], prior: float):
        self.model, self.odds, self.prior = model, odds, prior

    def start(self) -> "Scorer":
        """Once per Python worker: what it remembers stays with it."""
        if not hasattr(self, "kept"):
            self.reader, self.kept = Reader(self.model), {}
        return self

    def evidence(self, word: str) -> tuple[tuple[float, str], ...]:
        """Evidence and restored word, or words, of the strongest reading."""
        if word not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            strongest: tuple[tuple[float, str], ...] = ()
            for words, changed in self.reader.readings(word):
                pairs = []
                for w in words:
                    found = [self.odds[w]] if w in self.odds else [self.odds[f] for f in stems(w) if f in self.odds]
                    if found and max(found) > DISGUISE * changed:
                        pairs.append((max(found) - DISGUISE * changed, w))
                if sum(e for e, _ in pairs) > sum(e for e, _ in strongest):
                    strongest = tuple(pairs)
            self.kept[word] = strongest
        return self.kept[word]

    def score(self, text: str | None) -> float:
        best: dict[str, float] = defaultdict(float)
        if isinstance(text, str):
            kept = self.kept
            for w in words_of(text):
                pairs = kept.get(w)
                if pairs is None:
                    pairs = self.evidence(w)
                if pairs:
                    for e, word in pairs:
                        best[word] = max(best[word], e)
        x = self.prior + sum(sorted(best.values())[-TOP_WORDS:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, id_col: str = "doc_id",
        text_col: str = "text", label: str = "toxic") -> Scorer:
    """Learn the character model from all texts, and the word log-odds from at
    most ``rows`` labelled documents of each class outside the held-out fold.
    Without labels of a class every score is the prior."""
    model = character_model(docs, text_col)
    sample, sizes = labelled_sample(docs.select(F.col(id_col), F.col(text_col).alias("text")), labels, label, rows, id_col)
    sample = materialize(without_copies(materialize(sample.select("_row", "text", "y"), "toxic-labelled")), "toxic-sample")
    prior = math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))

    def counts(y: int, wanted: frozenset | None, without: frozenset | None) -> tuple[dict[str, int], int]:
        df = sample.filter(F.col("y") == y).select("text").mapInPandas(
            lean(lambda b: _fit_counts(b, model, wanted, without)), "feature string, n long").groupBy("feature").agg(
            F.sum("n").alias("n"))
        total = (df.filter("feature = ''").first() or {"n": 0})["n"]
        least = max(2, SUPPORT * total) if wanted is None else 1
        # support bounds the entries: each document gives a fixed number, so few reach a share of all documents
        return {r["feature"]: r["n"] for r in df.filter((F.col("n") >= least) & (F.col("feature") != "")).collect()}, total

    def evidence(without: frozenset | None) -> dict[str, float]:
        toxic, n1 = counts(1, None, without)
        clean, n0 = counts(0, frozenset(toxic), without)
        odds = {}
        for f, n in toxic.items():
            m = clean.get(f, 0)
            if (n + m) * _divergence(n / (n + m), n1 / (n1 + n0)) < math.log(len(toxic) / CHANCE):
                continue
            x = math.log((n + 0.5) / (n1 + 1)) - math.log((m + 0.5) / (n0 + 1))
            x -= DEVIATIONS * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
            if x > LEAST:
                odds[f] = x
        return odds

    odds = evidence(None)
    odds |= evidence(frozenset(odds))     # stems stand for words that are too rare to be learned by themselves
    best = sorted(odds.items(), key=lambda e: (-e[1], e[0]))[:MODEL_ENTRIES]
    return Scorer(model, dict(best), prior)


def with_score(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1; null and empty texts get
    the prior).  A column called ``name`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def compute(texts: list) -> list:
        s = sent.value.start()
        return [[s.score(t) for t in texts]]

    return with_columns(docs, [text_col], compute, [(name, T.DoubleType())])


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs`` (repeated
    rows and ids are kept, other columns left out).  Null and empty texts get
    the prior; a null id counts as the empty string for the fold.  An empty
    table gives an empty result."""
    scorer = fit(docs, labels, rows, id_col, text_col)
    scored = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scorer)
    return scored.select("doc_id", (~in_fit_fold()).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
