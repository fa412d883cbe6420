import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import corpus
from tidemill.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels, least=200):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < least, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, removed_of = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                removed_of[part, f] += len(gone)
    return sorted((*r, removed_of[r[0], r[1][r[2] - 1]]) for r in out)


def ours(spark, docs, labels):
    return sorted(map(tuple, A.audit_filters(corpus(spark, [(i, t, lang, "s") for i, t, lang in docs]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()))


def test_whole_result_equals_brute_force(spark):
    random.seed(2)
    words = ["one", "Two", "THREE", "four", "five#", "six|", "sieben", "huit", "é", "日本語", "NINE"]
    texts = [" ".join(random.choice(words[: random.randint(1, 11)]) for _ in range(random.choice([0, 1, 30, 199, 200, 201, 400]))) for _ in range(60)]
    varied = [" ".join(f"w{random.randint(0, n)}" for _ in range(210)) for n in (80, 105, 120, 400)]
    docs = [(i, random.choice(texts + varied), random.choice(["en", "de", None, ""])) for i in range(150)] + [(200 + i, varied[3], "en") for i in range(60)]  # a third are one text
    docs += [(300, None, "fr"), (301, "", "fr"), (302, " \n", None), (7, varied[0], "de"), (7, varied[0], "en"), (None, varied[3], "en"), (None, None, None), (303, "a" * 90_000 + " B" * 40_000, "xx")]
    labels = [(i, i % 3, i % 2) for i in range(0, 150, 2)] + [(7, 0, 0), (7, 1, None), (None, 1, 1), (301, 1, 1), (999, 1, 1)]
    assert ours(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert ours(spark, [], []) == []
    assert ours(spark, [(1, "a b", "en")], []) == brute([(1, "a b", "en")], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAb \n\t\x0b\x1c\xa0é日😀#|0"), max_size=30), max_size=8), st.integers(1, 40))
def test_counts_of_any_buffer(texts, stretch):
    raw = [t.encode() for t in texts]
    got = A.Scanner(stretch).counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]).astype(np.int64))
    want = [(len(w := WORD.findall(t)), len(set(w)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)) for t in texts]
    assert list(zip(*(x.tolist() for x in got))) == want


def test_words_of_equal_hash_are_told_apart():
    """With the radix 1 a hash is a sum of bytes: anagrams collide, and are still distinct words."""
    texts = ["abc cab abc bca ab", "x y x", "ad bc ad cb bc", "aaaa aaaa"]
    raw = [t.encode() for t in texts]
    got = A.Scanner(7, radix=1).counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    assert got[1].tolist() == [4, 2, 3, 1]


def test_one_text_in_a_third_of_all_rows_is_a_few_rows(spark):
    docs = corpus(spark, [(i, "same" if i % 3 else f"t{i}", "en", "s") for i in range(300)])
    per = A.mask_counts(A.scan_filters(docs), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r["mask"] >> 4, r["n"]) for r in per.collect() if r["n"]} == {(0, 101), (1, 199)}
