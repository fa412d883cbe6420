"""Operator 2: language ID by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, found by the forward algorithm; a text's is the product over its words, and the prediction is the
language of the largest posterior. Piece probabilities are learnt by expectation maximisation over the words of labelled
documents that are not held out. Learning takes a bounded sample of them: about ``train_docs`` documents a language, chosen by
a hash of their id, with all their words; prediction takes whole texts. Languages are numbered, and each is learnt in the task of
its number; the driver gets one row of piece probabilities a language.

Words are runs of letters (Unicode's, so no digits, fractions or letter-like numbers) in lower case; for learning, a run of more than ``LONG`` letters counts as stretches of so many.
Edge cases: null text or text without a letter is 'und' with score 0, and so is every text when there is nothing to learn from
(``keep_known_languages`` then keeps all rows, as nothing is known against them); a null doc_id counts as held out; repeated rows
give repeated rows; an empty table an empty result; lang, source and doc_id never enter a prediction, other columns are not
read. Equal posteriors go to the language that sorts first.
"""
from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, hinted, in_worker, rows_of, stored, trimmed, vocabulary
from .encoding import texts_of

WORD = regex.compile(r"\p{L}+")
START = "▁"
#: Word scores a worker keeps; texts learnt from at once; words of more code points go through one by one, in logarithms.
KEPT, TOGETHER, LONG = 150_000, 128, 60
#: Words whose lattices stand in dense tables at once.
FITTED_AT_ONCE = 8192
#: Added to each expected piece count.
SMOOTHING = 0.05
ROUNDS = 3
#: Languages up to which their table is broadcast.
BROADCAST_LANGUAGES = 100_000
#: A factor a code point that keeps products of piece probabilities near 1.
SCALE = 12.0


def pieces_of(path: str) -> dict[str, int]:
    """Lower-case letter pieces of a sentencepiece vocabulary, numbered; a word starts with START."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    keep = [p for p in found if p == START or (p.lstrip(START).isalpha() and p == p.lower() and START not in p[1:])]
    return {p: i for i, p in enumerate(keep)}


class Lattice:
    """The pieces that fit into each of a list of words, as edges from one position to a later one."""

    def __init__(self, words: list[str], pieces: dict[str, int], heads: set[str]) -> None:
        word, start, end, piece, unknown = array("i"), array("i"), array("i"), array("i"), len(pieces)
        for k, w in enumerate(words):
            s = START + w
            n = len(s)
            for i in range(n):
                alone = True
                for j in range(i + 1, n + 1):
                    p = s[i:j]
                    at = pieces.get(p)
                    if at is not None:
                        word.append(k), start.append(i), end.append(j), piece.append(at)
                        alone = alone and j > i + 1
                    if p not in heads:
                        break
                if alone:  # a character that is no piece of its own
                    word.append(k), start.append(i), end.append(i + 1), piece.append(unknown)
        self.word, self.start, self.end, self.piece = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (word, start, end, piece))
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        self.n, self.width = len(words), int(self.size.max(initial=0)) + 1

    def _runs(self, at: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(at, kind="stable")
        return np.split(order, np.searchsorted(at[order], np.arange(1, self.width)))

    def forward(self, scaled: np.ndarray) -> np.ndarray:
        """a[word, position]: the scaled probability of the word up to there, all segmentations summed."""
        a = np.zeros((self.n, self.width))
        a[:, 0] = 1
        for j, e in enumerate(self._runs(self.end)[1:], 1):
            a[:, j] = np.bincount(self.word[e], a[self.word[e], self.start[e]] * scaled[self.piece[e]], self.n)
        return a

    def backward(self, scaled: np.ndarray) -> np.ndarray:
        b, runs = np.zeros((self.n, self.width)), self._runs(self.start)
        b[np.arange(self.n), self.size] = 1
        for i in range(self.width - 1, -1, -1):
            e = runs[i]
            b[:, i] += np.bincount(self.word[e], b[self.word[e], self.end[e]] * scaled[self.piece[e]], self.n)
        return b

    def expected(self, scaled: np.ndarray, weights: np.ndarray, n_pieces: int) -> np.ndarray:
        a, b = self.forward(scaled), self.backward(scaled)
        whole = a[np.arange(self.n), self.size]
        share = a[self.word, self.start] * scaled[self.piece] * b[self.word, self.end] * (weights / np.maximum(whole, 1e-300))[self.word]
        return np.bincount(self.piece, share, n_pieces)


class Model:
    """languages (sorted), log_p[language, piece] with the unknown character last, log_prior."""

    def __init__(self, languages: list[str], log_p: np.ndarray, log_prior: np.ndarray, pieces: dict[str, int], kept: int = KEPT) -> None:
        self.languages, self.log_p, self.log_prior, self.pieces, self.kept = languages, log_p, log_prior, pieces, kept
        self.heads = {p[:i] for p in pieces for i in range(1, len(p))}
        lengths = np.array([len(p) for p in pieces] + [1])
        self.scaled = np.exp(log_p) * SCALE**lengths
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language), one row a word."""
        out, short = np.zeros((len(words), len(self.languages))), [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            net = Lattice([words[i] for i in short], self.pieces, self.heads)
            for k in range(len(self.languages)):
                out[short, k] = np.log(np.maximum(net.forward(self.scaled[k])[np.arange(net.n), net.size], 1e-300)) - net.size * np.log(SCALE)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long_score(w)
        return out

    def long_score(self, word: str) -> np.ndarray:
        s, unknown = START + word, len(self.pieces)
        a = np.full((len(s) + 1, len(self.languages)), -np.inf)
        a[0] = 0
        for i in range(len(s)):
            alone = True
            for j in range(i + 1, len(s) + 1):
                at = self.pieces.get(s[i:j])
                if at is not None:
                    a[j] = np.logaddexp(a[j], a[i] + self.log_p[:, at])
                    alone = alone and j > i + 1
                if s[i:j] not in self.heads:
                    break
            if alone:
                a[i + 1] = np.logaddexp(a[i + 1], a[i] + self.log_p[:, unknown])
        return a[-1]

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.at)
        if len(self.at) + len(new) > self.kept:
            self.at = dict(islice(self.at.items(), len(self.at) // 2))  # the older half has the common words
            self.scores, new = self.scores[: len(self.at)], words.difference(self.at)
        if new:
            new = list(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.scores = np.concatenate([self.scores[: len(self.at) - len(new)], self.word_scores(new)])

    def predict(self, words: list[str]) -> tuple[str, float]:
        at = self.at
        total = self.scores[np.fromiter([at[w] for w in words], np.int64, len(words))].sum(axis=0) + self.log_prior
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fitted(words: list[str], counts: np.ndarray, pieces: dict[str, int]) -> np.ndarray:
    """log probabilities of the pieces, the unknown character last, for one language's words."""
    heads = {p[:i] for p in pieces for i in range(1, len(p))}
    parts = ((words[i : i + FITTED_AT_ONCE], counts[i : i + FITTED_AT_ONCE]) for i in range(0, len(words), FITTED_AT_ONCE))
    nets = [(Lattice(part, pieces, heads), weights) for part, weights in parts]
    lengths = np.array([len(p) for p in pieces] + [1])
    p = sum(np.bincount(net.piece, weights[net.word], len(pieces) + 1) for net, weights in nets) + SMOOTHING
    for _ in range(ROUNDS):
        p = p / p.sum()
        p = sum(net.expected(p * SCALE**lengths, weights, len(pieces) + 1) for net, weights in nets) + SMOOTHING
    return np.log(p / p.sum())


def stretches(word: str) -> list[str]:
    return [word] if len(word) <= LONG else [word[i : i + LONG] for i in range(0, len(word), LONG)]


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def by_language(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dealt so that partition i has the words of language i alone: as many tasks as languages, none of them merged."""
    of = Window.orderBy("lang")  # a row a language
    numbers = sizes.select(F.col("lang").alias("l"), (F.row_number().over(of) - 1).alias("number"))
    met = words.join(hinted(numbers, BROADCAST_LANGUAGES, sizes), F.col("lang") == F.col("l")).drop("l")
    return met.repartitionById(max(1, rows_of(sizes)), F.col("number")).drop("number")


def train(docs: DataFrame, vocabulary_file: str = "piece_bpe_32k.model", train_docs: int = 800) -> Model | None:
    """From text and lang of labelled documents that are not held out, about train_docs of each language."""
    bounded_batches(docs.sparkSession)
    path = vocabulary(vocabulary_file)
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    rate = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n"))
    met = known.join(hinted(sizes.withColumnRenamed("lang", "l"), BROADCAST_LANGUAGES, sizes), F.col("lang") == F.col("l"))
    sample = met.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 24)) < rate * float(1 << 24)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for language, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                for w, n in Counter(words_of(text)).items():
                    for part in stretches(w):
                        seen[language, part] += n
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by("word")  # sums in one order, whatever the partitions
        p = fitted(table.column("word").to_pylist(), table.column("n").to_numpy().astype(np.float64), pieces_of(path))
        yield pa.RecordBatch.from_arrays([pa.array([table.column("lang")[0].as_py()]), pa.array([p.astype("<f8").tobytes()], pa.binary())], ["lang", "log_p"])

    words = sample.mapInArrow(trimmed(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = by_language(words, sizes).mapInArrow(trimmed(learn), "lang string, log_p binary").join(sizes, "lang").collect()  # a row a language
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: r["lang"])
    prior = np.array([r["n"] + 1.0 for r in rows])
    return Model([r["lang"] for r in rows], np.array([np.frombuffer(r["log_p"], "<f8") for r in rows]), np.log(prior / prior.sum()), pieces_of(path))


def identify(docs: DataFrame, model: Model | None, kept: int = 400_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, by the model alone. kept: word scores a worker keeps."""
    parts = (model.languages, model.log_p, model.log_prior, model.pieces) if model else None
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # languages x pieces: its size does not depend on the documents
    key = zlib.crc32(model.log_p.tobytes()) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value is None:
            own = None
        else:
            own = in_worker(("language model", key, kept), lambda: Model(*sent.value, kept))
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                words = [words_of(t) for t in texts_of(b.column(2))]
                if own:
                    own.learn(set().union(*words))
                found = [own.predict(w) if w and own else ("und", 0.0) for w in words]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with at least that posterior."""
    from pyspark.sql.functions import pandas_udf

    model = train(docs)
    if model is None:
        return docs
    sent, key = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.log_prior, model.pieces)), zlib.crc32(model.log_p.tobytes())

    @pandas_udf("double")
    def posterior(texts):
        import pandas as pd

        own, out = in_worker(("language model", key), lambda: Model(*sent.value)), []
        for at in range(0, len(texts), TOGETHER):
            words = [words_of(t) for t in texts.iloc[at : at + TOGETHER]]
            own.learn(set().union(*words))
            out += [own.predict(w)[1] if w else -1.0 for w in words]
        give_back()
        return pd.Series(out, dtype="float64")

    return docs.where(posterior(F.col("text")) >= least_score)
