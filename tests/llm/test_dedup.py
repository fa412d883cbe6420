import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tidemill.llm.ngram_join as J
from tests.llm.conftest import corpus
from tidemill.llm.components import components
from tidemill.llm.exact_dedup import drop_exact_copies, exact_groups
from tidemill.llm.ngram_join import met_in_buckets


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        out.append((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = exact_groups(odd).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_exact(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_groups(none).count() == 0


def test_digests_only_of_crowded_rows(spark, odd):
    for r in exact_groups(odd, digest_all=False).collect():
        assert (r["text_sha256"] is not None) or r["group_size"] == 1


def test_drop_exact_copies(spark, odd, none):
    out = drop_exact_copies(odd)
    assert out.columns == odd.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in odd.collect()})
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert drop_exact_copies(none).count() == 0


@pytest.mark.parametrize("bound", [500_000, 0])
def test_drop_exact_copies_decides_by_row(spark, monkeypatch, bound):
    """Null ids and repeated ids: a copy goes, another text under the same id stays."""
    import tidemill.llm.exact_dedup as E

    monkeypatch.setattr(E, "BROADCAST_ROWS", bound)
    texts = [(1, "X x"), (None, "X  x"), (None, "only here"), (None, "twice"), (None, "twice"), (5, "X x"), (5, "Z"), (6, "X x"), (6, "X x"), (7, "Y"), (7, "Y"), (7, "V"), (8, "Y"), (9, "own")]
    got = drop_exact_copies(corpus(spark, [(i, t, "en", "a") for i, t in texts])).collect()
    want = [(1, "X x"), (5, "Z"), (7, "V"), (7, "Y"), (9, "own"), (None, "only here"), (None, "twice")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_shuffled_keys_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    import tidemill.llm.exact_dedup as E

    want = sorted(map(str, exact_groups(odd).collect()))
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_groups(odd).collect())) == want
    assert drop_exact_copies(odd).count() == 12


def test_few_digests_beyond_the_broadcast_bound(spark, monkeypatch):
    """A bitmap in place of the list: survivors and at most a few others have their content hashed."""
    import tidemill.llm.exact_dedup as E

    rows = [(i, f"text {i % 700:05d}" if i >= 1300 else f"alone {i:05d}") for i in range(2000)]
    docs = corpus(spark, [(i, t, "en", "a") for i, t in rows])
    made = {}
    monkeypatch.setattr(E, "stored", lambda df, name, f=E.stored: made.setdefault(name, f(df, name)))
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    assert E.exact_groups(docs, digest_all=False).where("group_size > 1").count() == 0
    assert made["content"].where("text_sha256 is not null").count() == 0
    made.clear()
    rows += [(3000 + i, f"alone {i:05d}") for i in range(100)]
    docs = corpus(spark, [(i, t, "en", "a") for i, t in rows])
    assert E.exact_groups(docs, digest_all=False).where("group_size = 2").count() == 200
    assert 200 <= made["content"].where("text_sha256 is not null").count() <= 260
    assert "bitmap" in made


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = words_of(t)
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute_links(sets, num, den):
    """Roots of the sets named by keys, linked by all pairs."""
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                p, q = root(ids[a]), root(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def brute_components(rows, k, num, den):
    sets = sets_of([r for r in rows if r[0] is not None], k)
    return {i: (len(sets[i]), r) for i, r in brute_links(sets, num, den).items()}


def brute_repeated(rows, k, num, den):
    """(doc_id, n, component) of every row, where rows of a doc_id are one document."""
    sets = [sets_of([r], k)[r[0]] for r in rows]
    root = brute_links({i: s for i, (s, r) in enumerate(zip(sets, rows)) if r[0] is not None}, num, den)
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, r in enumerate(rows):
        if r[0] is not None:
            for a, b in ((("row", i), ("row", root[i])), (("row", i), ("id", r[0]))):
                up[top(a)] = top(b)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[top(("id", r[0]))] = min(least.get(top(("id", r[0])), r[0]), r[0])
    return sorted(((r[0], len(s), None if r[0] is None else least[top(("id", r[0]))]) for r, s in zip(rows, sets)), key=str)


def brute_kept(rows, k, num, den):
    """The rows that stay, texts by their word sets: of linked texts the smallest doc_id; other texts of the id stay."""
    sets = [frozenset(sets_of([r], k)[r[0]]) for r in rows]
    inner = [i for i, (r, s) in enumerate(zip(rows, sets)) if r[0] is not None and s]
    root = brute_links({i: sets[i] for i in inner}, num, den)
    best = {}
    for i in inner:
        best.setdefault(root[i], []).append((rows[i][0], sets[i]))
    kept = [(rows[i][0], sets[i]) for i in range(len(rows)) if i not in root]
    low = {r: min(x[0] for x in found) for r, found in best.items()}
    return kept, {r: {s for d, s in found if d == low[r]} for r, found in best.items()}, low


def noisy(n, rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def near_rows(seed=1):
    """Random texts, a large group of near copies of unequal nearness, and a passage that many texts share."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    base, passage = [rng.choice(vocab) for _ in range(120)], [rng.choice(vocab) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150)))) for i in range(60)]
    rows += [(100 + i, noisy(i, rng, base, rng.randint(0, 6))) for i in range(80)]
    rows += [(200 + i, " ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(0, 25))])) for i in range(70)]
    rows += [(300, None), (301, ""), (302, "Alone here"), (303, "alone   HERE"), (304, "alone"), (None, " ".join(base)), (305, " ".join(base))]
    return rows


@pytest.mark.parametrize(("k", "num", "paired"), [(3, 90, 48), (5, 80, 48), (3, 80, 3), (5, 60, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, k, num, paired):
    monkeypatch.setattr(J, "PAIRED", paired)
    monkeypatch.setattr(J, "BLOCK_NODES", 16 if paired < 10 else 512)
    rows = near_rows(k * num)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in rows]), k, num, 100).collect() if r["doc_id"] is not None}
    assert got == brute_components(rows, k, num, 100)


REPEATED = [(1, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (5, " ".join(f"z{i}" for i in range(60))), (9, " ".join(f"z{i}" for i in range(60)) + " q"), (9, ""), (7, "u v w x y z"), (7, "U  v w x y z"), (7, None), (None, "u v w x y z"), (8, "U V W X Y Z"), (6, "only this one here"), (6, "and another text of the id"), (6, "and another text of the id")]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_one_id_under_several_texts(spark, monkeypatch, bound):
    monkeypatch.setattr(J, "BROADCAST_IDS", bound)
    rows = REPEATED + [(100 + i % 40, t) for i, (_, t) in enumerate(near_rows(3))]
    docs = corpus(spark, [(i, t, "en", "a") for i, t in rows])
    got = J.near_duplicates(docs, 3, 80, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_repeated(rows, 3, 80, 100)
    stay = [(r["doc_id"], r["text"]) for r in J.drop_near_copies(docs, 3, 80, 100).collect()]
    alone, groups, low = brute_kept(rows, 3, 80, 100)
    sets = [(i, frozenset(sets_of([(i, t)], 3)[i])) for i, t in stay]
    for found in alone:  # null ids and texts without words stay
        assert found in sets
    left = [x for x in sets if x[0] is not None and x[1]]
    assert len(groups) == len(set(left))
    assert all(any(i == low[r] and s in own for r, own in groups.items()) for i, s in left)


def test_a_hub_of_one_id(spark):
    """The verdict's case: another text of a repeated id keeps its links, and stays where documents are dropped."""
    z = " ".join(f"z{i}" for i in range(58))
    docs = corpus(spark, [(1, "b c d e f", "en", "a"), (5, "b c d e f", "en", "a"), (5, z, "en", "a"), (9, z + " q", "en", "a")])
    assert sorted((r["doc_id"], r["component_id"]) for r in J.near_duplicates(docs).collect()) == [(1, 1), (5, 1), (5, 1), (9, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in J.drop_near_copies(docs).collect()) == [(1, "b c d e f"), (5, z)]


def test_few_listed_tokens_change_no_link_and_bound_the_candidates(spark, monkeypatch):
    """A list of common tokens that holds next to nothing: the rows that buckets give stay linear in the prefixes."""
    rows = near_rows(11)
    seen = {}
    for most in (1 << 20, 3):
        monkeypatch.setattr(J, "MOST_COMMON", most)
        made = []
        monkeypatch.setattr(J, "met_in_buckets", lambda t, *a, f=met_in_buckets: made.append((t, f(t, *a))) or made[-1][1])
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in rows]), 3, 80, 100).collect() if r["doc_id"] is not None}
        assert got == brute_components(rows, 3, 80, 100)
        seen[most] = [(t.count(), m.count()) for t, m in made]
        assert all(out <= J.PAIRED * taken for taken, out in seen[most])


def test_wide_buckets_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "WIDE", 3)
    rows = near_rows(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in rows]), 3, 80, 100).collect() if r["doc_id"] is not None}
    assert got == brute_components(rows, 3, 80, 100)


def test_frequencies_beyond_a_byte_are_told_apart(spark):
    docs = corpus(spark, [(i, "common words here " + ("rarer words there " if i % 4 == 0 else "") + f"x{i} y{i} z{i}", "en", "a") for i in range(1400)])
    cells, classes = J.common_tokens(J.described(docs, 3, 20, 8).where("kind = 1"), 20, 8)
    import numpy as np

    assert set(np.frombuffer(classes, np.uint8).tolist()) >= {8, 10} and len(cells) == 8 * len(classes)


def test_stars_and_tiles_are_taken(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRED", 3)
    taken = []
    monkeypatch.setattr(J, "tiled", lambda *a, f=J.tiled, **k: taken.append(1) or f(*a, **k))
    J.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in near_rows()]), 3, 80, 100).collect()
    assert taken


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = J.near_duplicates(odd).collect()
    assert len(got) == len(rows) and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components(rows, 5, 80, 100)
    assert J.near_duplicates(none).count() == 0
    stay = J.drop_near_copies(odd)
    assert stay.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 1, 4, 5, 6, 7, 7, 9, 11, 12, 13, 14]
    assert J.drop_near_copies(none).count() == 0


def test_prefixes_under_any_order_share_a_token():
    import numpy as np

    rng = np.random.default_rng(1)
    classes = J.Classes(16, b"", b"")
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(5, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and J.similar(both, len(a), len(b), 80, 100):
            for seed in J.SEEDS:
                first = [set(np.sort(classes.order(s, seed))[: J.prefix_size(len(s), 80, 100)].tolist()) for s in (a, b)]
                assert first[0] & first[1]


def test_overlaps_of_blocks():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, 30).astype(np.uint64)) for _ in range(12)]
    got = J.overlaps(sets[:5], sets[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_sets_of_a_batch_against_words(k):
    """Equal sets of shingles and no others have equal hashes, over words of all lengths and a sliced column."""
    rng = random.Random(k)
    texts = [None, "", " ", " A\tb ", "a B", "a", "a\0", "ab" * 32, "ab" * 32 + "c", "x " + "ab" * 40, "x " + "ab" * 40 + "\v", "caf\u00c9 caf\u00e9", "a\x1cb", "a\x85b"]
    texts += ["".join(rng.choice("aAb\u00e9 \t\n\v\f\r\x1c") for _ in range(rng.randrange(30))) for _ in range(800)]
    made = J.shingled(pa.array(["cut off", *texts], pa.string()).slice(1), k)
    of, back = {}, {}
    for i, (text, s, n, *marks) in enumerate(zip(texts, made.each(), made.sizes, *made.marks())):
        want = frozenset(sets_of([(i, text)], k)[i])
        assert len(want) == len(s) == n and (np.diff(s.astype(object)) > 0).all()
        assert of.setdefault(want, (s.tobytes(), *marks)) == (s.tobytes(), *marks) and back.setdefault(s.tobytes(), want) == want
    assert len(of) > 100 and not len(J.shingled(pa.array([], pa.string()), k).flat)


def test_rows_of_counters_grow_with_the_tokens(spark):
    """Three million tokens over 1,024 ranges: a row holds some thousand counters, and a batch many rows."""
    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 10000), i -> concat('w', id * 10000 + i)), ' ')").alias("text"))
    both = J.described(docs, 3, 30, 1024)
    assert both.where("kind = 0").count() == 300
    counters = both.where("kind = 1").select(F.count("*"), F.sum(F.octet_length("counts") / 4)).first()
    assert counters[0] <= 1024 and 2_900_000 < counters[1] <= 300 * 9998
