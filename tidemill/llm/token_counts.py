"""Operator 10: token counts by dynamic programming over prefixes.

For every chunk (a stretch without ASCII white space) a table gives the exact number of tokens of each of its prefixes; the
count of a text's prefix is the sum of the chunks that end before it plus one table entry, so truncation and budget questions
are answered from the stored tables without encoding again. Chunks are cut into pre-tokens as the vocabulary's own splitter
does it (their tokens are independent). Within a pre-token the counts follow the recurrence of byte-pair encoding: the prefix
ending at i has one last token t, the one that stays apart from the last token of the prefix before it, and its count is the
count before t plus one. In sorted order each pre-token takes over the states of the prefix it shares with the one before.
Work is linear in the length of a chunk, whatever its letters; only a run of combining marks on one letter is composed anew
for each of its marks.

``prefix_index`` stores the counts of a text as the compressed differences between neighbouring prefixes (a byte or two for
each code point before compression).

The vocabulary must drop white space and end words at it, with NFC and lower case before, as word_bpe_49k.json does.

Edge cases: a null text counts as empty; an empty text has 0 tokens and one prefix; a special string of the vocabulary inside
a text is one token, its own prefixes are plain text, as the library's default has it; repeated rows give repeated rows (each
answered from its own text); a null doc_id stays null; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_worker, stored, trimmed, vocabulary
from .encoding import PLAIN, PRE_TOKEN, Encoder, byte_letters, older_half, texts_of

#: Chunks and pre-tokens whose tables a worker keeps (a full cache keeps its older half, which has the common ones), and their letters; pairs of tokens kept for long words.
TABLES, KEPT_LETTERS, KEPT_PAIRS = 400_000, 64, 50_000
#: Texts whose new chunks are learnt at once.
TOGETHER = 256
#: Radix of the hash of letters (modulo 2^64); slots of a worker's table of token pairs; words of one sweep.
RADIX, PAIR_SLOTS, SWEEP = 0x9E3779B97F4A7C15, 1 << 20, 8192
CONTRACTION = re.compile(r"'(s|t|re|ve|m|ll|d)\Z")
SPACE = re.compile(r"([\x20\x09-\x0D]+)")


def hash_of(letters: list[int]) -> int:
    h = 0
    for x in letters:
        h = (h * RADIX + x + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class BpePrefixes:
    """Prefix counts of one pre-token after another; in sorted order each goes on from the prefix it shares with the last."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.split: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            self.split.setdefault(a + b, (a, b))
        self.letters = byte_letters()
        cut = len(self.suffix)
        #: Letters -> 1 for a token inside a word, 2 for one at its end (the suffix left out), 3 for both.
        self.tokens: dict[str, int] = {}
        for t in model["vocab"]:
            ends = cut > 0 and t.endswith(self.suffix)
            bare = t[: len(t) - cut] if ends else t
            if t in self.split or len(bare) == 1:
                self.tokens[bare] = self.tokens.get(bare, 0) | (2 if ends else 1 if cut else 3)
        self.longest = max(map(len, self.tokens))
        # The same tokens as sorted hashes of their bytes, for many words at once.
        byte = {c: x for x, c in self.letters.items()}
        hashes = {t: hash_of([byte[c] for c in t]) for t in self.tokens}
        self.names = sorted(hashes, key=hashes.__getitem__)
        self.hashes = np.array([hashes[t] for t in self.names], np.uint64)
        self.kinds = np.array([self.tokens[t] for t in self.names], np.uint8)
        self.powers = np.cumprod(np.array([1, *[RADIX] * self.longest], np.uint64), dtype=np.uint64)
        self.met, self.verdicts = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text, self.last, self.count, self.ends = "", [""], [0], [0]

    def apart(self, a: str, b: str) -> bool:
        """True if encoding a + b gives back a, b: no merge across their border comes before the merges that made them."""
        left, right, limit, found = a, b, len(self.rank), True
        while True:
            if self.rank.get((left, right), limit) < limit:
                found = False
                break
            ra, rb = (self.rank[self.split[x]] if x in self.split else -1 for x in (left, right))
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, left = ra, self.split[left][1]
            else:
                limit, right = rb + 1, self.split[right][0]  # of equal merges the left one comes first
        return found

    def _met(self, a: str, b: str) -> bool:
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[a, b] = self.apart(a, b)
        return found

    def spelt(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.letters[x] for x in word.encode("utf-8", "surrogatepass")])

    def counts(self, word: str) -> list[int]:
        """Entry i: tokens of word[: i + 1] where the word ends there."""
        s = self.spelt(word)
        same = 0
        for x, y in zip(self.text, s):
            if x != y:
                break
            same += 1
        self.text = s
        del self.last[same + 1 :], self.count[same + 1 :], self.ends[same + 1 :]
        self._go_on(s, self.last, self.count, self.ends)
        if len(s) == len(word):
            return self.ends[1:]
        return [self.ends[i] for i in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]

    def _go_on(self, text: str, last: list[str], count: list[int], ends: list[int], base: int = 0) -> None:
        """Fill last (the last token of the prefix inside a longer word), count and ends (tokens if the word ends there) up to the end of text, whose first letter is the word's at base."""
        get, pairs, longest, suffix = self.tokens.get, self.pairs, self.longest, self.suffix
        for i in range(len(last), len(text) + 1):
            want = 3
            for k in range(i - longest if i > longest else 0, i):
                t = text[k:i]
                kind = get(t)
                if not kind or not kind & want:
                    continue
                alone = not k and not base
                if kind & want & 1:
                    pair = last[k], t
                    if alone or (pairs[pair] if pair in pairs else self._met(*pair)):
                        inner, n, want = t, count[k] + 1, want & 2
                if kind & want & 2:
                    pair = last[k], t + suffix
                    if alone or (pairs[pair] if pair in pairs else self._met(*pair)):
                        end, want = count[k] + 1, want & 1
                if not want:
                    break
            else:
                raise ValueError("no token fits")
            last.append(inner), count.append(n), ends.append(end)

    def many(self, words: list[str]) -> list[bytes]:
        """The steps of many words: the same recurrence, one position of all of them at a time; a prefix that words share is one state."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        order = sorted(range(len(raw)), key=lambda w: -len(raw[w]))
        size = np.array([len(raw[w]) for w in order], np.int64)
        width = int(size.max(initial=0))
        letters = np.zeros((len(raw), width), np.uint8)
        inside = np.arange(width) < size[:, None]
        letters[inside] = np.frombuffer(b"".join([raw[w] for w in order]), np.uint8)
        prefix = np.zeros((width + 1, len(raw)), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * np.uint64(RADIX) + letters[:, i] + np.uint64(1)
        counts = np.zeros((len(raw), width), np.int16)
        state, last, count = [np.zeros(len(raw), np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int16)]
        for i in range(1, width + 1):
            n = int((size >= i).sum())
            own, first, at = np.unique(prefix[i, :n], return_index=True, return_inverse=True)
            inner, so_far, end, want = np.zeros(len(own), np.int64), np.zeros(len(own), np.int16), np.zeros(len(own), np.int16), np.full(len(own), 3, np.uint8)
            for length in range(min(i, self.longest), 0, -1):
                todo, k = np.flatnonzero(want), i - length
                if not len(todo):
                    break
                h = own[todo] - prefix[k, first[todo]] * self.powers[length]
                token = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                kind = np.where(self.hashes[token] == h, self.kinds[token], 0) & want[todo]
                hit = np.flatnonzero(kind)
                todo, token, kind = todo[hit], token[hit], kind[hit]
                before = state[k][first[todo]]
                for bit in (1, 2):
                    m = kind & bit > 0
                    rows, pair = todo[m], token[m]
                    if k:
                        ok = self.apart_many(last[k][before[m]], pair, bit == 2)
                        rows, pair, base = rows[ok], pair[ok], count[k][before[m]][ok]
                    else:
                        base = 0
                    want[rows] ^= bit
                    if bit == 1:
                        inner[rows], so_far[rows] = pair, base + 1
                    else:
                        end[rows] = base + 1
            if want.any():
                raise ValueError("no token fits")
            state.append(at), last.append(inner), count.append(so_far)
            counts[:n, i - 1] = end[at]
        # Counts where a character ends, as steps.
        ends = inside.copy()
        ends[:, :-1] &= ~(inside[:, 1:] & (letters[:, 1:] & 0xC0 == 0x80))
        found, stops = counts[ends], np.cumsum(ends.sum(axis=1))
        steps = np.diff(found, prepend=np.int16(0))
        starts = np.concatenate([[0], stops[:-1]])
        steps[starts] = found[starts]
        whole, out = steps.astype(np.int8).tobytes(), [b""] * len(raw)
        for w, a, b in zip(order, starts.tolist(), stops.tolist()):
            out[w] = whole[a:b]
        return out

    def apart_many(self, a: np.ndarray, b: np.ndarray, at_end: bool) -> np.ndarray:
        key = (a << 20 | b) << 1 | at_end
        slot = (key.astype(np.uint64) * np.uint64(RADIX) >> np.uint64(44)).astype(np.int64)
        out = self.verdicts[slot]
        for i in np.flatnonzero(self.met[slot] != key).tolist():
            j = slot[i]
            if self.met[j] != key[i]:
                self.verdicts[j] = self.apart(self.names[a[i]], self.names[b[i]] + (self.suffix if at_end else ""))
                self.met[j] = key[i]
            out[i] = self.verdicts[j]
        return out

    def count_with(self, at: int, tail: str) -> int:
        """Tokens of the first at letters of the last word that counts() had, followed by tail, as one word."""
        base = max(0, at - self.longest)  # no token that ends behind the stretch begins before it
        last, count, ends = (x[base : at + 1] for x in (self.last, self.count, self.ends))
        self._go_on(self.text[base:at] + "".join([self.letters[x] for x in tail.encode("utf-8", "surrogatepass")]), last, count, ends, base)
        return ends[-1]


@cache
def seconds() -> frozenset[str]:
    """Characters that may join the one before them under NFC."""
    out = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for x in range(0x110000):
        d = unicodedata.decomposition(chr(x))
        if d and d[0] != "<" and " " in d:
            out.add(chr(int(d.split()[1], 16)))
    return frozenset(out)


class PrefixTables:
    """Steps of chunks: byte i of tables[chunk] is the count of chunk[: i + 1] less that of chunk[:i], a signed byte."""

    def __init__(self, path: str) -> None:
        self.encoder, self.bpe = Encoder(path, "word", 1), BpePrefixes(path)
        self.tables: dict[str, bytes] = {"": b""}
        self.special = re.compile("|".join(map(re.escape, sorted(self.encoder.special, key=len, reverse=True)))) if self.encoder.special else None
        self.kinds: dict[int, str] = {}

    def count_all(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The tables, with those of all short chunks and stretches of white space; what is not in them is found by ``long``."""
        tables = self.tables
        new = chunks.difference(tables)
        if not new:
            return tables
        if len(tables) + len(new) > TABLES:
            tables = self.tables = {"": b""} | older_half(tables)
            new = chunks.difference(tables)
        words, parts, find = set(), [], PRE_TOKEN["word"].findall
        for c in new:
            if len(c) > KEPT_LETTERS:
                continue
            if c[0] in " \t\n\v\f\r":
                tables[c] = bytes(len(c))
                continue
            low = c.lower()
            if len(low) != len(c) or not PLAIN.match(c):
                steps = self.long(c)
                if steps.dtype == np.int8:
                    tables[c] = steps.tobytes()
                continue
            found = find(low)
            words.update(found)
            if len(found) > 1 or found[0] != c:
                parts.append((c, found))
        unknown = sorted(words.difference(tables))
        for at in range(0, len(unknown), SWEEP):
            own = unknown[at : at + SWEEP]
            tables.update(zip(own, self.bpe.many(own)))
        for w in unknown:
            if w[0] == "'" and CONTRACTION.match(w):
                tables[w] = fitted(np.diff(self.count_all([w[: i + 1] for i in range(len(w))]), prepend=0)).tobytes()
        for c, found in parts:
            tables[c] = tables[found[0]] if len(found) == 1 else b"".join([tables[w] for w in found])
        return tables

    def steps(self, text: str) -> bytes | np.ndarray:
        """Of any text without special strings: signed bytes, or whole numbers where a step does not fit."""
        parts = SPACE.split(text)
        self.learn(set(parts))
        return self.joined(parts)

    def joined(self, parts: list[str]) -> bytes | np.ndarray:
        """The steps of chunks and the white space between them, in turn; short chunks were learnt before."""
        tables = self.tables
        try:
            return b"".join(map(tables.__getitem__, parts))
        except KeyError:
            found = [tables.get(p) for p in parts]
            return np.concatenate([np.frombuffer(x, np.int8) if x is not None else np.zeros(len(p), np.int8) if k & 1 else self.long(p) for k, (x, p) in enumerate(zip(found, parts))])

    def kind(self, x: int) -> str:
        """A letter, digit, mark or space in place of a character, as the library's own splitter takes it."""
        found = self.kinds.get(x)
        if found is None:
            cut = lambda s: len(self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(s))
            c = chr(x)
            found = " " if not cut(c) else "a" if cut("a" + c) == 1 else "!" if cut("!" + c) == 1 else "1"
            self.kinds[x] = found
        return found

    def spans(self, low: str) -> list[tuple[int, int]]:
        """Pre-tokens of a normalised stretch."""
        shape = low.translate({x: self.kind(x) for x in map(ord, set(low)) if not 32 < x < 127})
        return [m.span() for m in PRE_TOKEN["word"].finditer(shape)]

    def tokens_of(self, low: str) -> int:
        """Tokens of a short stretch that is normalised already."""
        words = [low[a:b] for a, b in self.spans(low)]
        return sum(self.count_all([w])[0] if CONTRACTION.match(w) else int(np.frombuffer(x, np.int8).sum()) for w, x in zip(words, self.bpe.many(words)))

    def long(self, chunk: str) -> np.ndarray:
        """Steps of any chunk: the counts of its normal form, read where each prefix of the chunk ends in it."""
        whole, ends, odd = self.normal(chunk)
        at = np.zeros(len(whole) + 1, np.int64)
        wanted: dict[int, list[tuple[int, str]]] = {}
        for i, place, tail in odd:
            wanted.setdefault(place, []).append((i, tail))
        places, j, base, done, out, before = sorted(wanted), 0, 0, 0, {}, 0
        mark = 0  # where the pre-token before began, and the count before it
        for start, end in self.spans(whole):
            at[done + 1 : start + 1] = base
            while j < len(places) and places[j] <= start:  # nothing runs on from before
                for i, tail in wanted[places[j]]:
                    out[i] = base + self.tokens_of(tail)
                j += 1
            word = whole[start:end]
            own = self.count_all([word[: i + 1] for i in range(len(word))]) if CONTRACTION.match(word) else self.bpe.counts(word)
            spelt: list[int] = []
            while j < len(places) and places[j] <= end:
                head = places[j] - start
                for i, tail in wanted[places[j]]:
                    if head <= 8:
                        if start == done and whole[done - 1 : done] == "'":  # may become a contraction
                            out[i] = before + self.tokens_of(whole[mark : places[j]] + tail)
                        else:
                            out[i] = base + self.tokens_of(word[:head] + tail)
                        continue
                    # A long run: it goes on as far as the tail is of its kind, the rest stands for itself.
                    like = "a" if self.kind(ord(word[0])) == "a" else "!"
                    on = self.spans(like + tail)[0][1] - 1
                    spelt = spelt or [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]
                    out[i] = base + (self.bpe.count_with(spelt[head], tail[:on]) if on else own[head - 1]) + (self.tokens_of(tail[on:]) if on < len(tail) else 0)
                j += 1
            at[start + 1 : end + 1] = base + np.array(own)
            mark, before = start, base
            base, done = base + own[-1], end
        at[done + 1 :] = base
        for p in places[j:]:
            for i, tail in wanted[p]:
                out[i] = base + self.tokens_of(tail)
        counts = at[ends]
        for i, n in out.items():
            counts[i] = n
        return fitted(np.diff(counts, prepend=0))

    def normal(self, chunk: str) -> tuple[str, np.ndarray, list[tuple[int, int, str]]]:
        """The normal form; where each prefix ends in it; and prefixes that are no prefix of it: (index, letters kept, what follows them)."""
        lower = lambda s: "".join([x.lower() for x in s])
        if unicodedata.is_normalized("NFC", chunk):
            parts = [x.lower() for x in chunk]
            return "".join(parts), np.cumsum([len(p) for p in parts]), []
        parts, ends, odd, at, a, joins = [], np.zeros(len(chunk), np.int64), [], 0, 0, seconds()
        starts = [i for i, c in enumerate(chunk) if not i or not unicodedata.combining(c) and c not in joins]
        for a, b in zip(starts, [*starts[1:], len(chunk)]):
            own = lower(unicodedata.normalize("NFC", chunk[a:b]))
            for i in range(a, b):
                so_far = own if i == b - 1 else lower(unicodedata.normalize("NFC", chunk[a : i + 1]))
                if own.startswith(so_far):
                    ends[i] = at + len(so_far)
                else:
                    odd.append((i, at, so_far))
            parts.append(own)
            at += len(own)
        return "".join(parts), ends, odd


def fitted(steps: np.ndarray) -> np.ndarray:
    """As signed bytes where they fit."""
    return steps.astype(np.int8) if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else steps.astype(np.int32)


def tables_of(path: str) -> PrefixTables:
    return in_worker(("prefix tables", path), lambda: PrefixTables(path))


def text_steps(text: str, own: PrefixTables) -> np.ndarray:
    """Entry i: tokens of text[: i + 1] less those of text[:i]."""
    plain = lambda s: np.frombuffer(x, np.int8) if isinstance(x := own.steps(s), bytes) else x
    if own.special is None or not own.special.search(text):
        return plain(text)
    parts, done = [], 0
    for m in own.special.finditer(text):
        # The special string is plain text until its last character makes it one token.
        steps = plain(text[done : m.end() - 1])
        inside = steps[m.start() - done :].sum(dtype=np.int64)
        parts += [steps, np.array([1 - inside], np.int64)]
        done = m.end()
    return fitted(np.concatenate([*parts, plain(text[done:])]).astype(np.int64))


class PrefixIndex:
    """Exact token count at every prefix of one text: at[i] counts text[:i]."""

    def __init__(self, steps: np.ndarray) -> None:
        self.at = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])

    @classmethod
    def of(cls, text: str, own: PrefixTables) -> PrefixIndex:
        return cls(text_steps(text, own))

    @classmethod
    def stored(cls, raw: bytes) -> PrefixIndex:
        return cls(np.frombuffer(zlib.decompress(raw[1:]), "<i1" if raw[:1] == b"1" else "<i4"))

    def count(self, n_chars: int) -> int:
        return int(self.at[n_chars])

    def longest_within(self, budget: int) -> int:
        """Code points of the longest prefix of at most so many tokens."""
        return int(np.flatnonzero(self.at <= budget)[-1])


def packed(steps: np.ndarray | bytes) -> bytes:
    """A byte that tells the width of a step, then the compressed steps."""
    if isinstance(steps, bytes):
        return b"1" + zlib.compress(steps, 1)
    return (b"1" if steps.dtype == np.int8 else b"4") + zlib.compress(steps.astype(steps.dtype.newbyteorder("<")).tobytes(), 1)


INDEX = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_steps binary"


def prefix_index(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, prefix_steps (the counts at every prefix, read by PrefixIndex.stored): one row per document."""
    bounded_batches(docs.sparkSession)
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                texts = [t or "" for t in texts_of(batch.column(1))]
                parts = [None if own.special and own.special.search(t) else SPACE.split(t) for t in texts]
                own.learn(set().union(*(p for p in parts if p)))
                totals, raw = [], []
                for t, p in zip(texts, parts):
                    steps = text_steps(t, own) if p is None else own.joined(p)
                    totals.append(int((np.frombuffer(steps, np.int8) if isinstance(steps, bytes) else steps).sum(dtype=np.int64)))
                    raw.append(packed(steps))
                sizes = ([len(t.encode("utf-8", "surrogatepass")) for t in texts], list(map(len, texts)), totals)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in sizes), pa.array(raw, pa.binary())], ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix_steps"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(run), INDEX)


def answers(index: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars (code points of the longest prefix of at most limit tokens): from the stored counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = [chars if n <= limit else PrefixIndex.stored(raw.as_py()).longest_within(limit) for chars, n, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.compute.greater(b.column(3), limit), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return index.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """The answers of every whole text, from its stored prefix index."""
    return answers(stored(prefix_index(docs, tokenizer), "prefix-index"), limit)


def truncate_to_budget(docs: DataFrame, budget: int, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The rows of docs, with all their columns, each text cut to its longest prefix of at most so many tokens (null stays null)."""
    from pyspark.sql.functions import pandas_udf

    bounded_batches(docs.sparkSession)
    path = vocabulary(tokenizer)

    @pandas_udf("int")
    def fits(texts):
        import pandas as pd

        own = tables_of(path)
        return pd.Series([PrefixIndex.of(t or "", own).longest_within(budget) for t in texts], dtype="int32")

    return docs.withColumn("text", F.substring("text", F.lit(1), fits(F.col("text"))))
