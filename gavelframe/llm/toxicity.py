"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick on folded texts.

Texts are folded first: lower case, accents off, letters of other scripts and digits that look
like Latin letters replaced (only inside words).  The lexicon is learned from labelled rows:
terms are whole words and word beginnings, weighted by the smoothed log odds of their document
frequencies in toxic and clean texts, and terms that clean texts hold about as often are not
taken; near copies of a text count once.  Phrases that hold a term but stand mostly in clean
texts become exceptions, beside the ones given.  One automaton finds terms and exceptions in one
pass over a whole text; a term inside an exception does not count.

The score is logistic in two length-normalised sums of the weights found: their sum over the
square root of the number of words, and over the logarithm of that number.  Words are runs of
letters and digits, so white space and punctuation do not dilute a score.  Its three
coefficients are fitted on the same labelled rows.

Sampling: at most ``max_rows`` labelled keys are used, the ones with the smallest hashes, and of
their texts as many as ``max_chars`` characters hold; with fewer, all are.  Scoring covers every
row and whole texts.

Defined results: null and empty texts hold no term and get the score of a text without terms;
repeated rows get equal scores.  Without labelled rows, with labels of one kind only, or without
a term that is sure enough, the lexicon is empty and every score is 0.05.  Labels other than 0 and 1 (nulls too) are not used; of
repeated keys in the labels the largest label counts, and the smallest text of a key is the one
that trains.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.llm.storage import bounded_batches, fresh, trim_memory

MAX_ROWS = 10_000
MAX_CHARS = 60_000_000
MIN_DOCS = 4  # toxic training texts that must hold a term
PREFIXES = (4, 5, 6, 7)  # lengths of word beginnings that can be terms
MAX_TERMS = 4_000

# Look-alikes of Latin letters, digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ø": "o", "ł": "l", "đ": "d"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    """Letters with accents and compatibility forms to base letters, and the look-alikes."""
    table: dict[int, str] = {}
    for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F), (0x2100, 0x2150), (0x1D400, 0x1D800)):
        for c in range(lo, hi):
            base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
            if base != chr(c) and base:
                table[c] = base
    table |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= dict.fromkeys([*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], "")
    return table


_DIGIT_TABLE = str.maketrans(DIGITS)
_MIXED = re.compile(r"(?<![^\W_])(?=[0-9@$!]*[a-z])(?=[a-z]*[0-9@$!])[a-z0-9@$!]*[a-z0-9]")


def fold(text: str) -> str:
    """The text as terms see it."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_fold_table())
    if any(c in text for c in DIGITS):  # only in words that mix them with letters
        text = _MIXED.sub(lambda m: m[0].translate(_DIGIT_TABLE), text)
    return text


def features(folded: str) -> set[str]:
    """Words, and beginnings of longer words marked with a star."""
    words = set(_WORD.findall(folded))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    """Terms (a trailing star: any word that begins so) with weights, exception phrases, coefficients."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (math.log(0.05 / 0.95), 1.0, 1.0)
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return Lexicon, (self.terms, self.exceptions, self.coefficients)

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if "a" not in self.cache:
            a = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for term, weight in self.terms.items():
                entries.setdefault(term.rstrip("*"), []).append((term.endswith("*"), weight))
            for phrase in self.exceptions:
                entries.setdefault(phrase, []).append((None, 0.0))
            for pattern, kinds in entries.items():
                a.add_word(pattern, (len(pattern), kinds))
            if entries:
                a.make_automaton()
            self.cache["a"] = a
        return self.cache["a"]

    def sums(self, text: str) -> tuple[float, int, int]:
        """(sum of the weights found, terms found, words) of a whole text."""
        return self.folded_sums(fold(text))

    def folded_sums(self, folded: str) -> tuple[float, int, int]:
        words = max(1, len(_WORD.findall(folded)))
        if not self.automaton.kind == ahocorasick.AHOCORASICK:
            return 0.0, 0, words
        found: dict[int, tuple[int, float]] = {}  # the best term at each word beginning
        clear: list[tuple[int, int]] = []
        size = len(folded)
        for end, (length, kinds) in self.automaton.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalnum():
                continue
            whole = end + 1 == size or not folded[end + 1].isalnum() or folded[end + 1] == "s" and (end + 2 == size or not folded[end + 2].isalnum())  # a plural too
            for star, weight in kinds:
                if star is None:
                    if whole:
                        clear.append((start, end))
                elif (star or whole) and weight > found.get(start, (0, -math.inf))[1]:
                    found[start] = (end, weight)
        if clear:
            found = {s: x for s, x in found.items() if not any(a <= s and x[0] <= b for a, b in clear)}
        return sum(w for _, w in found.values()), len(found), words

    def score(self, text: str) -> tuple[float, int]:
        total, found, words = self.sums(text)
        a, b, c = self.coefficients
        x = a + b * total / math.sqrt(words) + c * total / (1 + math.log(words))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x)))), found


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not penalised."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    beta = np.zeros(design.shape[1])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * b @ penalty @ b)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        gradient = design.T @ (p - y) + penalty @ beta
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + penalty + 1e-9 * np.eye(len(beta)), gradient)
        scale = 1.0
        while scale > 1e-6 and loss(beta - scale * step) > loss(beta):
            scale /= 2
        beta -= scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return beta


#: Jaccard similarity of the 5-word runs from which a training row is a near copy.
NEAR_COPY = 0.75
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint64)


def _shingles(words: list[str], n: int = 5) -> np.ndarray:
    """Hashes of the runs of n words, sorted and distinct; of all words where there are fewer."""
    codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    runs = max(1, len(codes) - n + 1)
    out = np.zeros(runs, np.uint64)
    for k in range(min(n, len(codes))):
        out = (out ^ codes[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of NEAR_COPY or more."""
    if min(len(a), len(b)) < NEAR_COPY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= NEAR_COPY * (len(a) + len(b) - both)


def distinct_rows(folded: list[str]) -> list[int]:
    """Rows without near copies of earlier ones: a copy repeats one of three pairs of minimal word hashes and is alike in runs of five words."""
    seen: list[dict] = [{}, {}, {}]
    runs: dict[int, np.ndarray] = {}
    out = []
    for i, text in enumerate(folded):
        words = _WORD.findall(text)
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in set(words) if len(w) > 4), np.uint64)
        if len(hashes):
            low = ((hashes[:, None] * _FACTORS) & np.uint64(0xFFFFFFFF)).min(axis=0).tolist()
            pairs = [tuple(low[k : k + 2]) for k in (0, 2, 4)]
            mine = _shingles(words)
            if any(_alike(mine, runs[j]) for j in {j for p, s in zip(pairs, seen) for j in s.get(p, ())}):
                continue
            runs[i] = mine
            for p, s in zip(pairs, seen):
                s.setdefault(p, []).append(i)
        out.append(i)
    return out


def _document_counts(folded: list[str], labels: list[int]) -> tuple[dict[str, list[int]], int]:
    """[clean, toxic] texts that hold each feature of at least MIN_DOCS toxic texts, and the number of features of toxic texts."""
    toxic: dict[str, int] = {}
    for text, label in zip(folded, labels):
        if label:
            for f in features(text):
                toxic[f] = toxic.get(f, 0) + 1
    counts = {f: [0, n] for f, n in toxic.items() if n >= MIN_DOCS}
    seen = len(toxic)
    del toxic
    for text, label in zip(folded, labels):
        if not label:
            for f in features(text):
                if f in counts:
                    counts[f][0] += 1
    return counts, seen


def learn(folded: list[str], labels: list[int], exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from whole labelled texts, folded; near copies of a text count once."""
    kept = distinct_rows(folded)
    labels, folded = [labels[i] for i in kept], [folded[i] for i in kept]
    y = np.array(labels, float)
    positive, negative = int(y.sum()), int(len(y) - y.sum())
    if not positive or not negative:
        return Lexicon({}, exceptions)
    counts, n_features = _document_counts(folded, labels)
    share, need = positive / len(y), math.log(n_features + 1) + 3  # evidence in nats, corrected for the number of candidates
    evidence, scored = {}, {}
    for term, (clean, toxic) in counts.items():
        rate, base, part = (toxic + 0.5) / (positive + 1), (clean + 0.5) / (negative + 1), toxic / max(1, toxic + clean)
        if part <= share or rate <= 8 * base:
            continue
        found = toxic * math.log(part / share) + (clean * math.log((1 - part) / (1 - share)) if clean else 0.0)
        if found >= need:
            evidence[term], scored[term] = found, math.log(rate / base)
    chosen: dict[str, float] = {}
    for term in sorted(scored, key=lambda t: (-evidence[t], t.endswith("*"), -len(t), t))[:MAX_TERMS]:
        stem = term.rstrip("*")
        covered = any(chosen.get(stem[:n] + "*", 0) >= 0.8 * scored[term] for n in PREFIXES if n <= len(stem))
        wider = term.endswith("*") and any(c.startswith(stem) and counts[c][1] >= 0.9 * counts[term][1] for c in chosen)
        if not covered and not wider:
            chosen[term] = scored[term]
    if not chosen:
        return Lexicon({}, exceptions)
    # phrases of a term and a neighbour that stand in clean texts
    draft = Lexicon(chosen, exceptions)
    phrases: dict[str, list[int]] = {}
    for text, label in zip(folded, labels):
        if not draft.folded_sums(text)[1]:
            continue
        words = _WORD.findall(text)
        hits = {i for i, w in enumerate(words) if w in chosen or any(w[:n] + "*" in chosen for n in PREFIXES)}
        for p in {f"{words[j]} {words[j + 1]}" for i in hits for j in (i - 1, i) if 0 <= j < len(words) - 1}:
            phrases.setdefault(p, [0, 0])[label] += 1
    exceptions += tuple(sorted(p for p, (clean, toxic) in phrases.items() if clean >= MIN_DOCS and clean > 8 * toxic))
    draft = Lexicon(chosen, exceptions)
    sums = np.array([draft.folded_sums(t) for t in folded], float)
    beta = _fit(np.column_stack([sums[:, 0] / np.sqrt(sums[:, 2]), sums[:, 0] / (1 + np.log(sums[:, 2]))]), y)
    beta[1:] = np.maximum(beta[1:], 0)
    if not beta[1:].any():
        beta[2] = 1.0
    return Lexicon(chosen, exceptions, tuple(beta.tolist()))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, held_out=None) -> DataFrame:
    """(k, t, y): one text of each of at most max_rows labelled keys that held_out (a condition on the key) leaves."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    if held_out is not None:
        marks = marks.where(~held_out(F.col("k")))
    chosen = marks.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, held_out=None, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon learned in one task from at most max_rows labelled texts of max_chars together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, marks, size = [], [], 0
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size += len(text)
                if size <= max_chars:
                    folded.append(fold(text))
                    marks.append(y)
        if folded:
            lexicon = learn(folded, marks, exceptions)
            terms = list(lexicon.terms.items())
            values = [[t for t, _ in terms]], [[w for _, w in terms]], [list(lexicon.exceptions)], [list(lexicon.coefficients)]
            kinds = pa.string(), pa.float64(), pa.string(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(k)) for v, k in zip(values, kinds)], names=["terms", "weights", "exceptions", "coefficients"])
        folded.clear()
        trim_memory()

    rows = training_rows(docs, labels, key, text, label, max_rows, held_out).repartition(1).sortWithinPartitions(F.xxhash64("k"), "k")
    with bounded_batches(docs.sparkSession):
        made = rows.select("t", "y").mapInArrow(run, "terms array<string>, weights array<double>, exceptions array<string>, coefficients array<double>").first()
    return Lexicon({}, exceptions) if made is None else Lexicon(dict(zip(made["terms"], made["weights"])), tuple(made["exceptions"]), tuple(made["coefficients"]))


def scorer(lexicon: Lexicon):
    """A function of a text column: struct of score (0 to 1) and terms (terms found)."""

    @F.pandas_udf("score double, terms long")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([lexicon.score(t or "") for t in part], columns=["score", "terms"])

    return scored


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", prefix: str = "toxicity") -> DataFrame:
    """docs with <prefix>_score and <prefix>_terms; columns of these two names are replaced, no others."""
    names = [f"{prefix}_score", f"{prefix}_terms"]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    both = fresh(docs.columns, "_scored")
    found = docs.select("*", scorer(lexicon)(F.col(text)).alias(both))
    return found.select(*(F.col(f"`{c}`") for c in kept), F.col(f"{both}.score").alias(names[0]), F.col(f"{both}.terms").alias(names[1]))
