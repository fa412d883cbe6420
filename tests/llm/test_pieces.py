import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tests.llm.conftest import LONG, corpus
from tidemill.llm import pieces as P
from tidemill.llm.common import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
#: Spaces and their mark, breaks, marks that compose, letters outside the vocabulary, names of control and byte pieces.
ODD = [*"abcdethenrs  ▁\n\té日́‍😀0123.,<>ﬁ\xa0\x00", "▁▁▁", "    ", "ing", "<s>", "</s>", "<unk>", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return P.Pieces(PATH, kept=500)  # tables that are emptied again and again


def test_encoding_is_the_librarys(library, own):
    random.seed(5)
    texts = ["", " ", "▁", "\n", LONG, "e" * 5000, "▁" * 700, "the " * 300, *("".join(random.choice(own.names[259:]) for _ in range(random.randint(1, 14))) for _ in range(3000))]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == library.decode(ids), text[:80]


_made: dict = {}


def _both():
    if not _made:
        _made.update(own=P.Pieces(PATH), library=SentencePieceProcessor(model_file=PATH))
    return _made["own"], _made["library"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40))
def test_any_text_encodes_and_decodes_as_in_the_library(parts):
    own, library = _both()
    text = "".join(parts)
    assert own.encode(text) == library.encode(text)
    assert own.decode(library.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260), st.sampled_from([28_705, 259])), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    own, library = _both()
    assert own.decode(ids) == library.decode(ids)


def test_pairs_are_judged_as_encoding_them_does(own):
    random.seed(9)
    alone = [i for i, ok in enumerate(own.alone) if ok]
    for a, b in [(random.choice(alone), random.choice(alone)) for _ in range(4000)] + [(a, b) for a in own.loose for b in own.loose]:
        want = own.merged([*own.text[a], *own.text[b]])[0] == [own.text[a], own.text[b]]
        assert own.fits(a, b) == want, (own.text[a], own.text[b])


def test_ids_outside_and_other_models_are_refused(own, tmp_path):
    with pytest.raises(IndexError):
        own.decode([32_000])
    with pytest.raises(IndexError):
        own.decode([-1])
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        P.Pieces(str(other))


def test_round_trip_of_every_document(spark, odd, library):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.round_trip(odd).collect())
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id if r.doc_id is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_ids_decode_in_a_table_of_their_own(spark, odd, none):
    ids = P.encode_pieces(odd)
    back = {(r.doc_id, r.text) for r in P.decode_pieces(ids).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert P.encode_pieces(none).count() == 0
    assert P.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first().text is None
    assert P.round_trip(corpus(spark, [(4, "a", "en", "x")] * 3)).count() == 3
