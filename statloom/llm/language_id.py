"""Language identification by unigram pieces, summed over all segmentations of every word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import materialize

#: Letters of the longest piece that is used.
LONGEST = 8
#: Letters of a stretch of a word that is scored at once; longer words are scored stretch by stretch.
STRETCH = 24
#: Words that a task remembers; it bounds memory only.
REMEMBERED = 150_000
#: Probability of a letter that no piece of the vocabulary covers, the same in every language.
UNKNOWN = 1e-7
#: Languages that a model holds at most: a larger number is refused, since the model is broadcast.
MOST_LANGUAGES = 512

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased stretches of letters, cut after STRETCH letters, each with a mark at the start of a word."""
    found = []
    for word in _WORDS(text.lower()) if text else ():
        if len(word) < STRETCH:
            found.append("▁" + word)
        else:
            marked = "▁" + word
            found += [marked[i : i + STRETCH] for i in range(0, len(marked), STRETCH)]
    return found


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def piece_vocabulary(path: str) -> list[str]:
    """Lower-cased letter pieces, with or without the mark of a word start, of a sentencepiece model; plus the bare mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    fits = re.compile(r"▁?[^\W\d_]+").fullmatch
    return ["▁", *sorted(p for p in pieces if fits(p) and len(p) <= LONGEST)]


class Pieces:
    """Finds the pieces of many words at once: a hash of every substring is looked up among those of the vocabulary."""

    def __init__(self, vocabulary: list[str]) -> None:
        codes, _ = self._codes(vocabulary, LONGEST)
        # The hash of a prefix of the padded row, as long as the piece.
        lengths = np.array([len(p) for p in vocabulary])
        hashes = np.zeros(len(vocabulary), np.uint64)
        for n in range(1, LONGEST + 1):
            hashes[lengths == n] = self._hash(codes[lengths == n], n)[:, 0]
        order = np.argsort(hashes)
        self.hashes, self.index, self.size = hashes[order], order, len(vocabulary)

    @staticmethod
    def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(width) < lengths[:, None]] = flat
        return codes, lengths

    @staticmethod
    def _hash(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all substrings of n letters: one column per start."""
        last = codes.shape[1] - n + 1
        h = np.full((len(codes), last), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[:, j : j + last]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def grid(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For n = 1 … LONGEST the piece index of each substring of n letters (`size` where there is none); the lengths."""
        width = max(map(len, words))
        codes, lengths = self._codes(words, width)
        found = []
        for n in range(1, min(LONGEST, width) + 1):
            h = self._hash(codes, n)
            at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
            found.append(np.where(self.hashes[at] == h, self.index[at], self.size))
        return found, lengths

    def forward(self, grid: list[np.ndarray], width: int, p: np.ndarray) -> list[np.ndarray]:
        """alpha[e]: the probability of the first e letters, all segmentations summed (words x languages)."""
        alpha = [np.ones((len(grid[0]), p.shape[1]))]
        for end in range(1, width + 1):
            total = alpha[end - 1] * self._p(grid, p, 1, end - 1)
            for n in range(2, min(LONGEST, end) + 1):
                total += alpha[end - n] * p[grid[n - 1][:, end - n]]
            alpha.append(total)
        return alpha

    def _p(self, grid: list[np.ndarray], p: np.ndarray, n: int, start: int) -> np.ndarray:
        """Probabilities of single letters; those outside the vocabulary are UNKNOWN."""
        at = grid[n - 1][:, start]
        return np.where((at == self.size)[:, None], UNKNOWN, p[at])

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, weighted by the counts (one language)."""
        uses = np.zeros(self.size + 1)
        for n, rows in _by_length(words):
            grid, _ = self.grid([words[i] for i in rows])
            alpha = self.forward(grid, n, p)
            beta = [None] * n + [np.ones((len(rows), 1))]
            for start in range(n - 1, -1, -1):
                total = beta[start + 1] * self._p(grid, p, 1, start)
                for m in range(2, min(LONGEST, n - start) + 1):
                    total += beta[start + m] * p[grid[m - 1][:, start]]
                beta[start] = total
            weight = counts[rows][:, None] / alpha[n]
            for start in range(n):
                for m in range(1, min(LONGEST, n - start) + 1):
                    at = grid[m - 1][:, start]
                    share = alpha[start] * beta[start + m] * (self._p(grid, p, 1, start) if m == 1 else p[at]) * weight
                    uses += np.bincount(at, share[:, 0], self.size + 1)
        return uses[:-1]

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), p.shape[1]))
        for n, rows in _by_length(words):
            grid, _ = self.grid([words[i] for i in rows])
            out[rows] = np.log(self.forward(grid, n, p)[n])
        return out


def _by_length(words: list[str], rows: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for start in range(0, len(at), rows):
            yield int(n), at[start : start + rows]


@dataclass
class Model:
    """languages, their log share of the training documents, and p (piece x language; the last row, no piece, is 0)."""

    vocabulary: list[str]
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray


def train(labelled: DataFrame, vocabulary: list[str], rounds: int = 2) -> Model:
    """Learns piece probabilities per language from all rows of `labelled` (text, lang).

    Words are counted per language over the whole table; each round sums, over all segmentations of
    every distinct word, the expected uses of each piece and normalises them per language (EM, with one
    added to each use). What comes to the driver is one number per piece and language. Rows with a null
    text or lang are left out; without any usable row the model has no language. More than
    MOST_LANGUAGES languages raise ValueError.
    """
    usable = labelled.where("text is not null and lang is not null").select("lang", F.col("text").cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                found = words_of(text.as_py())
                if has_letter(found):
                    counts.setdefault(lang, Counter({"": 0})).update(found)
                    counts[lang][""] += 1
                    if sum(map(len, counts.values())) > REMEMBERED:
                        yield _counted(counts)
                        counts = {}
        yield _counted(counts)

    # The empty word counts the documents.
    counted = usable.mapInArrow(count, "lang string, word string, times bigint").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    counted = materialize(counted, "words")
    shares = counted.where("word = ''").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages, documents = [r.lang for r in shares], np.array([r.times for r in shares], float)
    p = np.full((len(vocabulary) + 1, len(languages)), 1 / len(vocabulary))
    p[-1] = 0
    words = counted.where("word <> ''")
    for _ in range(rounds if languages else 0):
        held = words.sparkSession.sparkContext.broadcast(Model(vocabulary, languages, np.zeros(len(languages)), p))
        uses = np.zeros((len(vocabulary), len(languages)))
        at = {lang: i for i, lang in enumerate(languages)}
        summed = words.mapInArrow(lambda batches, held=held: _expected(batches, held), "lang string, piece int, uses double")
        for r in summed.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r.piece, at[r.lang]] = r.uses
        # Sums of doubles differ in their last digits from run to run; rounded, reruns agree.
        p = np.vstack([(np.round(uses, 3) + 1) / (np.round(uses, 3) + 1).sum(axis=0), np.zeros(len(languages))])
    return Model(vocabulary, languages, np.log(documents / documents.sum()) if languages else documents, p)


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, w, n) for lang, found in counts.items() for w, n in found.items()]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "times"])


def _expected(batches: Iterable[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    model = held.value
    pieces, uses = Pieces(model.vocabulary), {}
    for batch in batches:
        langs, words, times = (np.array(batch[c].to_pylist(), object) for c in ("lang", "word", "times"))
        for lang in set(langs):
            of = langs == lang
            k = model.languages.index(lang)
            uses[lang] = uses.get(lang, 0) + pieces.expected(list(words[of]), times[of].astype(float), model.p[:, k : k + 1])
    for lang, found in uses.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), at.astype(np.int32), found[at]], ["lang", "piece", "uses"])


class Scorer:
    """Scores texts; remembers the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, Pieces(model.vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, posterior) of each text; ("und", 0.0) for a text without letters or a model without languages."""
        found = [words_of(t) for t in texts]
        found = [w if has_letter(w) else [] for w in found]
        if len(self.at) > REMEMBERED:
            self._forget()
        new = list(dict.fromkeys(w for words in found for w in words if w not in self.at))
        if new and self.model.languages:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.logs = np.vstack([self.logs, self.pieces.scores(new, self.model.p)])
        for words in found:
            if not words or not self.model.languages:
                yield "und", 0.0
                continue
            total = self.logs[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0) + self.model.prior
            best = int(total.argmax())
            yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """`documents` with lang_pred and score (the posterior of lang_pred among the learned languages).

    Only the text decides, and all of it. A null text, or one without a letter, is `und` with score 0.
    Letters outside the vocabulary count the same in every language. Equal posteriors go to the
    language that sorts first. Rows are neither lost nor merged; columns of these two names are replaced.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.drop("lang_pred", "score")
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                results = list(scorer.predict([None if t is None else str(t) for t in batch["text"].to_pylist()]))
                extra = [pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, vocabulary_path: str) -> Model:
    """The model of the documents that are not held out."""
    return train(documents.where(~held_out()).select("text", F.col("lang").cast("string").alias("lang")), piece_vocabulary(vocabulary_path))
