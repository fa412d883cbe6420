"""Operator 11: SentencePiece byte-pair encoding and decoding by a table of last tokens.

Encoding gives every prefix of a text one last token. A token t that ends a prefix is its last token exactly when t follows
the last token of the prefix before t: when the two, as a text of their own, encode to just these two (no merge across their
border comes before the merges that made them). So the table fills from left to right: an Aho-Corasick automaton over the
pieces names the tokens that end at a place, the longest first, and a kept verdict for each pair of tokens picks the one that
fits. The ids are read backwards from the end of the table. Work is linear in the text, whatever its letters.

Texts are cut where two neighbouring characters stand side by side in no piece, for no merge can cross there; words that were
met before are taken from a bounded table. New words are gone through in sorted order and take over the table of the prefix
they share with the word before. Pieces of equal score, and pieces that merge before their parts do, are judged by encoding
the pair itself.

The vocabulary must be a byte-pair model with byte fallback, the identity as its normaliser, a dummy prefix and escaped white
space, without user-defined or unused pieces (piece_bpe_32k.model is one); others raise ValueError.

Edge cases: null and empty texts have no ids but begin and end; a control piece's name inside a text is plain text; the mark
U+2581 in a text is a space, as the library has it; repeated rows give repeated rows; a null doc_id stays null; an empty table
gives an empty result; other columns are not read. Decoding: bytes that are no UTF-8 become U+FFFD one by one, ids outside the
vocabulary raise IndexError, null ids decode to null.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_worker, trimmed, vocabulary
from .encoding import older_half, texts_of

#: Words, and as many stretches, whose ids a worker keeps (a full table keeps its older half), letters of a kept word, and verdicts on pairs of tokens (a full table of verdicts starts anew).
KEPT, KEPT_LETTERS, KEPT_PAIRS = 400_000, 64, 500_000
#: Texts whose new words are learnt at once.
TOGETHER = 512
MARK, UNKNOWN, CODE = "▁", " ⁇ ", "I"
#: Kinds of pieces in a model file, the normaliser's name, the number of the byte-pair model type.
NORMAL, UNK, CONTROL, BYTE, IDENTITY, BPE = 1, 2, 3, 6, "identity", 2
WORD = re.compile(" *[^ ]+| +")


class Pieces:
    """ids(text) and text(ids) of one model."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        if t.model_type != BPE or not t.byte_fallback or t.treat_whitespace_as_suffix or n.name != IDENTITY or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or {p.type for p in model.pieces} - {NORMAL, UNK, CONTROL, BYTE}:
            raise ValueError(f"{path} is no byte-pair model of the kind that is read here")
        self.names = [p.piece for p in model.pieces]
        self.begin, self.end, kinds = t.bos_id, t.eos_id, [p.type for p in model.pieces]
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        if len(byte) < 256:
            raise ValueError(f"{path} has {len(byte)} of 256 byte pieces")
        self.bytes = [byte[x] for x in range(256)]
        self.id = {p: i for i, (p, k) in enumerate(zip(self.names, kinds)) if k == NORMAL}
        # Equal scores are equal ranks: of equals the left one merges first.
        order = {s: i for i, s in enumerate(sorted({model.pieces[i].score for i in self.id.values()}, reverse=True))}
        self.rank = {p: order[model.pieces[i].score] for p, i in self.id.items()}
        # Characters of longer pieces that are none themselves: tokens whose ids are their bytes.
        self.text = list(self.names)
        for c in sorted({c for p in self.id for c in p} - set(self.id)):
            self.id[c] = len(self.text)
            self.text.append(c)
        self.spelt = [b"".join(self.raw(c) for c in x) if i >= len(self.names) else array(CODE, [i]).tobytes() for i, x in enumerate(self.text)]
        self._derive()
        self._automaton()
        follows = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        self.follows = np.array(sorted(ord(a) << 21 | ord(b) for a, b in follows) or [-1], np.int64)
        self.by_word = not any(b == MARK != a for a, b in follows)
        # Decoding.
        self.surface = [b"" if k == CONTROL else UNKNOWN.encode() if k == UNK else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.names, kinds)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = np.array([k == CONTROL for k in kinds])
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(self.names, kinds)])
        self.most, self.kept, self.stretches, self.pairs = kept, {}, {}, {}
        self._start()

    def raw(self, c: str) -> bytes:
        return array(CODE, [self.bytes[x] for x in c.encode("utf-8", "surrogatepass")]).tobytes()

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The encoding of a short text by its definition (the best pair first, of equals the left one), and the last two that merged."""
        rank, last = self.rank, None
        while True:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
            if best is None:
                return symbols, last
            i = best[1]
            last = symbols[i], symbols[i + 1]
            symbols = [*symbols[:i], last[0] + last[1], *symbols[i + 2 :]]

    def _derive(self) -> None:
        """For each token the two tokens it is made of; which tokens stand for themselves; which have no strict order of merges."""
        self.parts: list[tuple[str, str] | None] = [None] * len(self.text)
        self.made = [-1] * len(self.text)  # rank of the merge that made a token
        self.alone, loose = [False] * len(self.text), set()
        for p in sorted(self.id, key=len):
            i = self.id[p]
            if len(p) == 1:
                self.alone[i] = True
                continue
            found, last = self.merged(list(p))
            if found != [p]:
                continue
            self.alone[i], self.parts[i], self.made[i] = True, last, self.rank[p]
            if any(x in loose or self.made[self.id[x]] >= self.rank[p] for x in last):
                loose.add(p)
        self.loose = {self.id[p] for p in loose}

    def _automaton(self) -> None:
        """States are the prefixes of tokens; out[s] lists the tokens that end in state s, (length, id), the longest first."""
        step: list[dict[str, int]] = [{}]
        own, depth, heads = [-1], [0], [(0, "")]
        for p, i in self.id.items():
            if not self.alone[i]:
                continue
            s = 0
            for c in p:
                if c not in step[s]:
                    step[s][c] = len(own)
                    own.append(-1), depth.append(depth[s] + 1), heads.append((s, c)), step.append({})
                s = step[s][c]
            own[s] = i
        self.fail, self.out = [0] * len(own), [()] * len(own)
        for s in sorted(range(1, len(own)), key=depth.__getitem__):
            before, c = heads[s]
            f = self.fail[before]
            while f and c not in step[f]:
                f = self.fail[f]
            self.fail[s] = step[f].get(c, 0) if before else 0
            self.out[s] = (*([(depth[s], own[s])] if own[s] >= 0 else []), *self.out[self.fail[s]])
        self.step = step

    def _next(self, s: int, c: str) -> int:
        """A step that follows failures; it is kept, as letters that go on in a piece are few."""
        at = s
        while at and c not in self.step[at]:
            at = self.fail[at]
        found = self.step[s][c] = self.step[at].get(c, 0)
        return found

    def fits(self, a: int, b: int) -> bool:
        """True if the texts of tokens a and b, put together, encode to a, b."""
        if a in self.loose or b in self.loose:
            return self.merged([*self.text[a], *self.text[b]])[0] == [self.text[a], self.text[b]]
        left, right, limit, rank, made, parts, of = self.text[a], self.text[b], len(self.rank) + 1, self.rank, self.made, self.parts, self.id
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            i, j = of[left], of[right]
            if made[i] < 0 and made[j] < 0:
                return True
            if made[i] > made[j]:
                limit, left = made[i], parts[i][1]
            else:
                limit, right = made[j] + 1, parts[j][0]  # a merge across the border stands left of this one

    def _start(self) -> None:
        self.word, self.last, self.state = "", [-1], [0]

    def tokens(self, word: str) -> list[int]:
        """Token numbers of a stretch whose characters are all in the vocabulary."""
        i = 0
        for x, y in zip(self.word, word):
            if x != y:
                break
            i += 1
        last, state, out, step, pairs, text = self.last, self.state, self.out, self.step, self.pairs, self.text
        del last[i + 1 :], state[i + 1 :]
        self.word, s = word, state[-1]
        for c in word[i:]:
            i += 1
            s = step[s][c] if c in step[s] else self._next(s, c)
            for length, t in out[s]:
                if length == i:
                    break
                pair = last[i - length] << 20 | t
                if pair in pairs:
                    if pairs[pair]:
                        break
                    continue
                if len(pairs) > KEPT_PAIRS:
                    pairs.clear()
                ok = pairs[pair] = self.fits(last[i - length], t)
                if ok:
                    break
            else:
                raise ValueError("no token fits")
            last.append(t), state.append(s)
        found = []
        while i:
            t = last[i]
            found.append(t)
            i -= len(text[t])
        return found[::-1]

    def cut(self, words: list[str]) -> tuple[list[str], list[int]]:
        """All words in stretches that no merge crosses, and where each word's stretches end."""
        whole = "".join(words)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        cuts = np.ones(len(points), bool)
        cuts[:-1] = self.follows[np.minimum(np.searchsorted(self.follows, pairs), len(self.follows) - 1)] != pairs
        ends = np.cumsum([len(w) for w in words])
        cuts[ends - 1] = True
        at = np.flatnonzero(cuts) + 1
        stops = at.tolist()
        return [whole[a:b] for a, b in zip([0, *stops], stops)], (np.searchsorted(at, ends) + 1).tolist()

    def learn(self, words: set[str]) -> None:
        """Ids of new words (with spaces as they are in texts), in the table of kept ones where they are short."""
        new = [w for w in words.difference(self.kept) if len(w) <= KEPT_LETTERS]
        if not new:
            return
        if len(self.kept) + len(new) > self.most:
            self.kept = older_half(self.kept)
            new = [w for w in words.difference(self.kept) if len(w) <= KEPT_LETTERS]
        parts, stops = self.cut([w.replace(" ", MARK) for w in new])
        unknown = sorted(set(parts).difference(self.stretches))
        if len(self.stretches) + len(unknown) > self.most:
            self.stretches = older_half(self.stretches)
            unknown = sorted(set(parts).difference(self.stretches))
        own = self.stretches
        for c in unknown:
            own[c] = self.spell(c)
        self._start()
        self.kept.update(zip(new, [own[parts[a]] if b == a + 1 else b"".join([own[p] for p in parts[a:b]]) for a, b in zip([0, *stops], stops)]))

    def spell(self, stretch: str) -> bytes:
        if len(stretch) == 1 and stretch not in self.id:
            return self.raw(stretch)
        return b"".join([self.spelt[t] for t in self.tokens(stretch)])

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        return WORD.findall(text) if self.by_word else [text]

    def joined(self, words: list[str]) -> bytes:
        """The ids of words; short ones were learnt before."""
        try:
            return b"".join(map(self.kept.__getitem__, words))
        except KeyError:
            found = b"".join([self.kept[w] if w in self.kept else b"".join(map(self.spell, self.cut([w.replace(" ", MARK)])[0])) for w in words])
            self._start()  # the table of a very long word goes
            return found

    def encode(self, text: str) -> list[int]:
        """Without begin and end."""
        words = self.words(text)
        self.learn(set(words))
        return np.frombuffer(self.joined(words), "<u4").tolist()

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.names)):
            raise IndexError(f"ids run from 0 to {len(self.names) - 1}")
        first = np.argmin(self.is_control[ids]) if len(ids) else 0
        stripped = len(ids) > 0 and bool(self.marked[ids[first]])  # the dummy prefix
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.is_control[ids[1:-1]].any():  # between two bytes it parts them
            return self._mended(ids)[stripped:]
        try:
            return raw[stripped:].decode()
        except UnicodeDecodeError:
            return self._mended(ids)[stripped:]

    def _mended(self, ids: np.ndarray) -> str:
        """Runs of byte pieces one by one."""
        out, run = [], bytearray()
        for i, single in zip(ids.tolist(), self.is_byte[ids].tolist()):
            if single:
                run += self.surface[i]
                continue
            out += [mended(bytes(run)), self.surface[i].decode()]
            run.clear()
        return "".join([*out, mended(bytes(run))])


def mended(raw: bytes) -> str:
    """Text of bytes: each byte that begins no character is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def pieces_of(path: str) -> Pieces:
    return in_worker(("pieces", path), lambda: Pieces(path))


def encoded(texts: list[str], own: Pieces) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, with begin and end."""
    begin, end = array(CODE, [own.begin]).tobytes(), array(CODE, [own.end]).tobytes()
    for at in range(0, len(texts), TOGETHER):
        words = [own.words(t) for t in texts[at : at + TOGETHER]]
        own.learn(set().union(*words))
        for w in words:
            yield begin + own.joined(w) + end


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", decode: bool = False) -> DataFrame:
    """doc_id, ids (binary: 32-bit little-endian, with begin and end): one row a document; decode adds text, what these ids decode to."""
    bounded_batches(docs.sparkSession)
    path = vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                ids = list(encoded([t or "" for t in texts_of(batch.column(1))], own))
                columns = [batch.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([own.decode(np.frombuffer(i, "<u4")) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(run), "doc_id long, ids binary" + (", text string" if decode else ""))


def decode_pieces(df: DataFrame, ids: str = "ids", to: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of df with the text of their ids (binary, 32-bit little-endian) as column ``to``."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    bounded_batches(df.sparkSession)
    path = vocabulary(model)

    @pandas_udf("string")
    def text(column):
        own = pieces_of(path)
        return pd.Series([None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in column], dtype=object)

    return df.withColumn(to, text(F.col(ids)))


def count_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of every document's ids and of the text that they decode to."""
    both = encode_pieces(docs, model, decode=True)
    return both.select("doc_id", count_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
