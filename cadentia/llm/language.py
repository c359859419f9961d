"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, computed by the forward
algorithm; a text's is the product over its words. The pieces are weighted by expectation
maximisation: forward and backward sums give each piece's expected count in every word.

Fitting reads a bounded sample: about ``fit_rows`` whole texts per language, chosen by
a hash of doc_id among the rows that may be learned from. Counting words and expected pieces are Spark
aggregations; the model has one number per piece and language, whatever the input. Prediction is a map over Arrow
batches without any shuffle, and scores each distinct word of a worker once while its cache lasts.

Edge cases: null texts and texts without letters are ``und`` with score 0. Equal scores go to
the language that sorts first. Rows with null doc_id are predicted but never learned from and
not held out. Repeated rows are predicted row by row. Without any learnable row every text is ``und``.
Only the named columns are read. An empty table gives an empty result. Longer words
than 32 letters do not train; they are scored whole.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.session import materialise

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"  # the vocabulary's sign for the beginning of a word
FIT_ROWS = 1500
ROUNDS = 3
LONG = 32  # unknown letters in a longer word would take its unscaled sums below the least float
# Probabilities are multiplied by this per letter, so that sums over long words stay near one.
LIFT = 12.0
UNKNOWN = 1e-8  # probability of a letter that no piece covers, in every language
CACHE_BYTES = 64 << 20


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Pieces of lower-case letters, with or without the sign for a word's start, numbered."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
    kept = sorted(p for p in found if p == START or (p.removeprefix(START).isalpha() and p == p.lower()))
    return {p: i for i, p in enumerate(kept)}


@dataclass
class Model:
    path: str
    languages: list[str]
    weights: np.ndarray  # pieces x languages


def _spans(words: list[str], index: dict[str, int]):
    """(i, j, piece number per word) for words of one length; the last two numbers are unknown letter and none."""
    n, longest = len(words[0]), max(map(len, index))
    letter, none = len(index), len(index) + 1
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            rest = letter if j - i == 1 else none
            ids = np.fromiter((index.get(w[i:j], rest) for w in words), np.int64, len(words))
            if j - i == 1 or (ids != none).any():
                yield i, j, ids


def _lifted(weights: np.ndarray, index: dict[str, int]) -> np.ndarray:
    lengths = np.array([len(p) for p in index])[:, None]
    known = weights * LIFT**lengths
    return np.vstack([known, np.full((1, weights.shape[1]), UNKNOWN * LIFT), np.zeros((1, weights.shape[1]))])


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word (given with its start sign) in each language."""
    index = pieces(model.path)
    table = _lifted(model.weights, index)
    out = np.empty((len(words), len(model.languages)))
    by_length = defaultdict(list)
    for at, word in enumerate(words):
        by_length[len(word)].append(at)
    for n, places in by_length.items():
        group = [words[p] for p in places]
        if n > LONG:
            for p, word in zip(places, group, strict=True):
                out[p] = _long_score(word, index, table)
            continue
        forward = np.zeros((n + 1, len(group), len(model.languages)))
        forward[0] = 1
        for i, j, ids in _spans(group, index):
            forward[j] += forward[i] * table[ids]
        out[places] = np.log(forward[n]) - n * np.log(LIFT)
    return out


def _long_score(word: str, index: dict[str, int], table: np.ndarray) -> np.ndarray:
    """The same sum for one long word, with the sums scaled at every letter; needs only the last few of them."""
    longest = max(map(len, index))
    sums, logs = [np.ones(table.shape[1])], np.zeros(table.shape[1])
    for j in range(1, len(word) + 1):
        now = np.zeros(table.shape[1])
        for back in range(1, min(longest, j) + 1):
            piece = index.get(word[j - back : j], len(index) if back == 1 else None)
            if piece is not None:
                now += sums[-back] * table[piece]
        scale = now
        sums = [s / scale for s in sums[-longest + 1 :]] + [now / scale]
        logs += np.log(scale)
    return logs - len(word) * np.log(LIFT)


def expected_counts(words: list[str], n: np.ndarray, weights: np.ndarray, index: dict[str, int]) -> np.ndarray:
    """Expected number of uses of each piece in words seen ``n`` times, for one language."""
    table = _lifted(weights[:, None], index)[:, 0]
    out = np.zeros(len(index) + 2)
    by_length = defaultdict(list)
    for at, word in enumerate(words):
        if len(word) <= LONG:
            by_length[len(word)].append(at)
    for size, places in by_length.items():
        group, times = [words[p] for p in places], n[places]
        spans = list(_spans(group, index))
        forward, backward = np.zeros((size + 1, len(group))), np.zeros((size + 1, len(group)))
        forward[0] = backward[size] = 1
        for i, j, ids in spans:
            forward[j] += forward[i] * table[ids]
        for i, j, ids in sorted(spans, key=lambda s: -s[1]):
            backward[i] += backward[j] * table[ids]
        for i, j, ids in spans:
            share = forward[i] * table[ids] * backward[j] / forward[size]
            out += np.bincount(ids, share * times, len(out))
    return out[: len(index)]


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, path: str, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities on about ``fit_rows`` texts per language."""
    usable = docs.select("doc_id", "text", "lang").where(
        (remainder() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    index = pieces(path)
    if not languages:
        return Model(path, [], np.zeros((len(index), 0)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000)) / 1_000_000
    rates = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(fit_rows / sizes[lang]))])
    sample = usable.where(draw < rates[F.col("lang")])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for frame in frames:
            for lang, text in zip(frame.lang, frame.text, strict=True):
                seen[lang].update(WORD.findall(text.lower()))
        for lang, words in seen.items():
            yield pd.DataFrame({"lang": lang, "word": words.keys(), "n": words.values()})

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    words = materialise(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    weights = np.full((len(index), len(languages)), 1.0 / len(index))
    for _ in range(rounds):
        fixed = weights

        def expect(frames: Iterator[pd.DataFrame], fixed=fixed) -> Iterator[pd.DataFrame]:
            own, total = pieces(path), np.zeros_like(fixed)
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    at = languages.index(lang)
                    marked = [START + w for w in part.word]
                    total[:, at] += expected_counts(marked, part.n.to_numpy(), fixed[:, at], own)
            piece, at = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "at": at, "n": total[piece, at]})

        sums = words.mapInPandas(expect, "piece long, at long, n double").groupBy("piece", "at").agg(F.sum("n").alias("n"))
        got = sums.toPandas()  # at most pieces x languages rows
        counts = np.full_like(weights, 0.1)
        counts[got.piece.to_numpy(int), got["at"].to_numpy(int)] += got.n.to_numpy().round(6)
        weights = counts / counts.sum(axis=0)
    return Model(path, languages, weights)


class Scorer:
    """Scores texts; remembers the words it has scored, up to a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.room = CACHE_BYTES // (8 * max(1, len(model.languages)))
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > self.room:
            self.known, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(words))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = self._grown(word_scores([START + w for w in new], self.model))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def _grown(self, more: np.ndarray) -> np.ndarray:
        return np.vstack([self.scores, more])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [WORD.findall((t or "").lower()) for t in texts]
        ends = np.cumsum([len(w) for w in found])
        rows = self.rows([w for words in found for w in words])
        langs, scores = [], []
        for words, end in zip(found, ends, strict=True):
            if not words or not self.model.languages:
                langs.append("und")
                scores.append(0.0)
                continue
            total = rows[end - len(words) : end].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(np.argmax(total))
            langs.append(self.model.languages[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` of ``lang_pred`` and ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            langs, scores = [], []
            # A few texts at a time, so that the words of a batch of long texts need little memory.
            for at in range(0, len(texts), 256):
                more = scorer.predict(texts.iloc[at : at + 256].tolist())
                langs += more[0]
                scores += more[1]
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("language", predicted(text))


def language_report(docs: DataFrame, path: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs``: whether it was held out, the predicted language and its posterior."""
    model = fit(docs, path, fit_rows)
    held = F.coalesce(remainder() == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score")
