"""The whole prediction against plain dictionaries: every segmentation summed word by word, learning included."""
import math
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tests.llm.conftest import corpus
from tidemill.llm import language_id as L
from tidemill.llm.common import stored, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def pieces():
    sp = SentencePieceProcessor(model_file=PATH)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p for p in names if p == "▁" or (p.lstrip("▁").isalpha() and p == p.lower() and "▁" not in p[1:])}


def edges(word, vocabulary):
    """(from, to, piece) of every piece that fits; a character that is none is None."""
    s = "▁" + word
    for i in range(len(s)):
        fits = [(i, j, s[i:j]) for j in range(i + 1, len(s) + 1) if s[i:j] in vocabulary]
        yield from fits
        if (i, i + 1, s[i : i + 1]) not in fits:
            yield (i, i + 1, None)


def sums(word, p, vocabulary):
    """Probability of the word, and the share of each edge in it."""
    net, n = sorted(edges(word, vocabulary), key=lambda e: e[0]), len(word) + 1
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, x in sorted(net, key=lambda e: e[1]):
        a[j] += a[i] * p[x]
    for i, j, x in reversed(net):
        b[i] += p[x] * b[j]
    return a[n], [(x, a[i] * p[x] * b[j] / a[n]) for i, j, x in net]


def learnt(words, vocabulary):
    every = [*sorted(vocabulary), None]
    p = Counter(dict.fromkeys(every, L.SMOOTHING))
    for w, n in words.items():
        for _, _, x in edges(w, vocabulary):
            p[x] += n
    for _ in range(L.ROUNDS):
        total = sum(p.values())
        p = {x: v / total for x, v in p.items()}
        q = Counter(dict.fromkeys(every, L.SMOOTHING))
        for w, n in words.items():
            for x, share in sums(w, p, vocabulary)[1]:
                q[x] += n * share
        p = q
    total = sum(p.values())
    return {x: v / total for x, v in p.items()}


def words_of(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def brute(rows):
    vocabulary, words, docs = pieces(), defaultdict(Counter), Counter()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    for i, text, lang, _ in rows:
        if lang is not None and not out(i):
            docs[lang] += 1
            words[lang].update(words_of(text))
    models = {k: learnt(words[k], vocabulary) for k in sorted(docs) if words[k]}
    total = sum(docs[k] + 1 for k in models)
    for i, text, _, _ in rows:
        w = words_of(text)
        if not w:
            yield i, out(i), "und", 0.0
            continue
        logs = {k: math.log((docs[k] + 1) / total) + sum(math.log(sums(x, p, vocabulary)[0]) for x in w) for k, p in models.items()}
        best = max(logs, key=logs.get)
        yield i, out(i), best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a"), (2, "a dog and a cat are in the house", "en", "a"), (3, "der hund und die katze sind im haus", "de", "a"), (4, "die katze sitzt auf der matte", "de", "b"),
    (5, "le chat est sur le tapis", "fr", "b"), (6, "le chien et le chat dans la maison", "fr", None), (7, "the dog", None, "a"), (8, "die katze ½ ²", None, None), (9, "½ ² Ⅷ ① 12", "en", "a"), (10, None, "de", "a"),
    (11, "", None, "a"), (12, "le 日本 chat", None, "a"), (13, "Straße x²y", "de", "a"), (14, "the the the", "en", "a"), (14, "the the the", "en", "a"), (15, "mat tapis matte", None, "c"), (16, "...", "fr", "c"),
]


def test_whole_prediction_equals_brute_force(spark):
    docs = corpus(spark, ROWS)
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in L.identify(docs, L.train(docs)).collect())
    assert got == sorted((i, o, k, round(s, 9)) for i, o, k, s in brute(ROWS))


@pytest.mark.parametrize("text", ["½ ²³", "Ⅷ ①", "٣ 12_3", " \n"])
def test_texts_without_a_letter_have_no_language(text):
    assert L.words_of(text) == []


def test_each_language_is_learnt_in_a_task_of_its_own(spark):
    words = spark.createDataFrame([(f"l{k:02d}", f"w{i}", 1) for k in range(30) for i in range(4)], "lang string, word string, n long")
    sizes = stored(words.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    rows = L.by_language(words, sizes).select("lang", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(rows) == 30 and len({r.lang for r in rows}) == 30 and len({r.task for r in rows}) == 30
