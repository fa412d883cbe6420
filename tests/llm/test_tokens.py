import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import corpus
from tidemill.llm.common import vocabulary
from tidemill.llm.encoding import Encoder
from tidemill.llm.packing import cut, fullest, pack, patterns
from tidemill.llm import token_counts as TC
from tidemill.llm.token_counts import PrefixIndex, PrefixTables, count_tokens, prefix_index, truncate_to_budget
from tidemill.llm.token_files import PerfectHash, Shard, read_by_key, token_files_round_trip, write_token_files

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ODD = [
    "don't we'RE 'll !!'s a'vé it's x''s", "Straße ÉTÉ naïve İstanbul ŉ ǅungla x²³½", "日本語テキスト、です éa á̂b", "<|endoftext|>hi  <|start <|startoftext|>", "a" * 300, " lead  two   three\n\n x \t\n y ",
    "x\xa0 y \xa0z\x1c\x85  q", "", "\n", "ab1234cd5.6-x" * 20,
]


@pytest.fixture(scope="module")
def encoders():
    return {"word": Encoder(WORD, "word", 50), "byte": Encoder(BYTE, "byte", 50)}  # tiny caches are emptied again and again


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_chunks_encode_as_whole_texts(encoders, kind):
    for text in ODD:
        assert encoders[kind].encode(text).tolist() == encoders[kind].whole(text).tolist(), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abE' \n\t.é1<|>́\xa0ßİ日"), max_size=40))
def test_any_text_encodes_the_same(text):
    for kind, path in (("word", WORD), ("byte", BYTE)):
        e = _shared(kind, path)
        assert e.encode(text).tolist() == e.whole(text).tolist()


_made: dict = {}


def _shared(kind, path):
    if kind not in _made:
        _made[kind] = Encoder(path, kind, 500)
    return _made[kind]


def every_prefix(own, text):
    return [len(own.encoder.whole(text[:i])) for i in range(len(text) + 1)]


def test_prefix_counts_equal_encoding_every_prefix():
    own = PrefixTables(WORD)
    random.seed(3)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(70, 120))) for _ in range(10)] + ["aaab" * 40, "th" * 60 + "a" * 30, "éé" * 50]
    for text in [*ODD, *words, "plain words in a row, with 12 marks!"]:
        index, want = PrefixIndex.of(text, own), every_prefix(own, text)
        assert index.at.tolist() == want, text
        assert PrefixIndex.stored(TC.packed(TC.text_steps(text, own))).at.tolist() == want
        if text:
            best = index.longest_within(3)
            assert want[best] <= 3 and all(n > 3 for n in want[best + 1 :])


#: Marks that compose, decomposed kana and Hangul, letters that grow in lower case, joiners, contractions and special strings.
MIXED = "abE' é1<|>\u0301\xa0ßİ日か\u3099がกำ\u1100\u1161\u11a8가각ΣςŉǅẠ\u0323\u030a\u0307😀٣\u200dﷺ!\"s"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list(MIXED)), st.sampled_from(["'re", "'ll", "か" * 11, "!" * 12, "<|endoftext|>", "<|startof"])), max_size=30))
def test_prefix_counts_of_any_text(parts):
    if "own" not in _made:
        _made["own"] = PrefixTables(WORD)
    text = "".join(parts)
    assert PrefixIndex.of(text, _made["own"]).at.tolist() == every_prefix(_made["own"], text)


@pytest.mark.parametrize("text", ["İ" + "abcdefgh" * 12_500, "か\u3099き\u3099" * 25_000, "a" * 50_000 + "e\u0301" * 25_000, "ภาษาไทย" * 14_000, "<|endoftext|>abc" * 6000])
def test_very_long_chunks_in_linear_time(text):
    import time

    own, rng, began = PrefixTables(WORD), random.Random(1), time.process_time()
    index = PrefixIndex.of(text, own)
    assert time.process_time() - began < 20
    for i in [len(text), *(rng.randrange(len(text)) for _ in range(4))]:
        assert index.at[i] == own.count_all([text[:i]])[0]


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(TC, "TABLES", 5)
    monkeypatch.setattr(TC, "SWEEP", 3)
    monkeypatch.setattr(TC, "PAIR_SLOTS", 1 << 20)
    own = PrefixTables(WORD)
    for text in ODD * 2:
        assert PrefixIndex.of(text, own).at[-1] == len(own.encoder.whole(text))


def test_count_tokens(spark, odd, none):
    t = Tokenizer.from_file(WORD)
    size = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    got = Counter(tuple(r) for r in count_tokens(odd, limit=10).collect())
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        text = r["text"] or ""
        n = size(text)
        fits = len(text) if n <= 10 else max(i for i in range(min(len(text), 200) + 1) if size(text[:i]) <= 10)
        want[r["doc_id"], len(text.encode()), n, n > 10, fits] += 1
    assert got == want
    assert count_tokens(none).count() == 0 and prefix_index(none).count() == 0


def test_truncation_keeps_rows_and_columns(spark, odd, none):
    t = Tokenizer.from_file(WORD)
    small = odd.where("doc_id in (1, 4, 5, 9, 12, 14)").union(odd.where("doc_id = 14"))
    got = truncate_to_budget(small, 6)
    assert got.columns == odd.columns and truncate_to_budget(none, 6).count() == 0
    cut_ = Counter()
    for r in small.collect():
        text = r["text"]
        cut_[r["doc_id"], text and text[: max(i for i in range(len(text) + 1) if len(t.encode(text[:i], add_special_tokens=False).ids) <= 6)]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == cut_


def test_perfect_hash_is_minimal():
    keys = np.array(random.Random(1).sample(range(-(10**15), 10**15), 5000), np.int64)
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], np.int64))


def test_token_files_round_trip(spark, odd, none):
    t = Tokenizer.from_file(WORD)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at, want = 0, Counter()
    for r in rows:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in token_files_round_trip(spark, odd).collect()) == want
    assert token_files_round_trip(spark, none).count() == 0


def test_one_id_in_several_shards(spark, monkeypatch):
    """Rows of a hot id, and of a null one, are cut by their text; every row is read back once, in order."""
    import tidemill.llm.token_files as TF

    monkeypatch.setattr(TF, "SHARD_BYTES", 400)
    rows = [(i, f"word{i} and more of it", "en", "a") for i in range(60)] + [(30, f"text {i:03d} of one id", "en", "a") for i in range(150)] + [(None, f"none {i:03d}", "en", "a") for i in range(80)]
    docs = corpus(spark, rows)
    manifest = write_token_files(docs, TF.new_path(spark, "tokens"))
    assert sum(m["null_rows"] > 0 for m in manifest) > 1 and sum(m["low"] is not None and m["low"] <= 30 <= m["high"] for m in manifest) > 1
    t, at, want = Tokenizer.from_file(WORD), 0, Counter()
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in read_by_key(docs, manifest).collect()) == want


def test_unknown_keys_are_not_found(spark, odd, tmp_path):
    manifest = write_token_files(odd, f"file://{tmp_path}/t")
    asked = spark.createDataFrame([(i,) for i in (3, 99, -5, 10**12)], "doc_id long")
    assert [r["doc_id"] for r in read_by_key(asked, manifest).collect()] == [3]
    shard = Shard(manifest[-1]["uri"])
    keys = np.arange(10**6, 10**6 + 20_000)
    assert (shard.find(keys)[0] >= 0).sum() == 0
    shard.close()


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(3, 4) == [(0, 3)]


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(60):
        counts = dict(Counter(rng.randint(1, 30) for _ in range(8)))
        room, lengths = rng.randint(1, 60), sorted(counts, reverse=True)
        got = fullest(lengths, counts, room)
        assert all(n <= counts[x] for x, n in Counter(got).items()) and sum(got) <= room
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        assert sum(got) == max(s for s in sums if s <= room)


def test_patterns_use_every_piece_once():
    rng = random.Random(2)
    histogram = dict(Counter(rng.randint(1, 60) for _ in range(3000)))
    used = Counter()
    for bin_, times in patterns(histogram, 100):
        assert sum(bin_) <= 100
        for x in bin_:
            used[x] += times
    assert dict(used) == histogram
    assert sum(t for _, t in patterns(histogram, 100)) <= -(-sum(k * v for k, v in histogram.items()) // 100) + 2
    assert patterns({}, 10) == []


def test_pack(spark, odd, none):
    t = Tokenizer.from_file(BYTE)
    got = pack(odd, capacity=64).toPandas()
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for i, (s, n) in enumerate(cut(len(ids), 64)):
            want[r["doc_id"], i, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    rows = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None)
    assert Counter((None if d is None else int(d), int(p), int(s), int(n), int(c)) for d, p, s, n, c in rows.itertuples(index=False)) == want
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    assert seq.groupby("sequence_id").length.sum().max() <= 64
    assert seq.sequence_id.nunique() <= -(-int(got.length.sum()) // 64) + 1
    assert pack(none).count() == 0
