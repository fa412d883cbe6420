"""Exact encoding by the tokenizers library with a bounded cache of chunks.

A chunk is a stretch of text whose tokens do not depend on what stands around it, so a text's ids are its chunks' ids in a
row. Texts that hold one of the vocabulary's special strings are encoded whole.
"""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex

from .common import in_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The code points with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
#: Byte-level vocabularies: a word takes the one space before it; a run of white space is cut before that space.
BYTE_CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

#: The pre-token patterns of the two vocabularies.
PRE_TOKEN = {
    "word": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
    "byte": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
}
#: Below U+0250 every character is a letter, a digit or a mark of its own and stays as it is under NFC; such chunks go
#: to the vocabulary's model pre-token by pre-token, all others through the whole tokenizer.
PLAIN = re.compile("[ -~\xa1-\u024f]+\\Z")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = dict(zip(printable, map(chr, printable)))
    out.update(zip((b for b in range(256) if b not in out), map(chr, range(256, 512))))
    return out


#: Chunks kept by default: some 200 MB a worker.
CACHE_ENTRIES = 650_000


def older_half(cache: dict) -> dict:
    return dict(islice(cache.items(), len(cache) // 2))


class Encoder:
    """ids(text) as the tokenizers library gives them without added special tokens.

    kind "word": the vocabulary drops white space, so chunks end at ASCII white space. kind "byte": chunks follow BYTE_CHUNK.
    cache_entries bounds the memory; a full cache keeps its older half, which has the common chunks.
    """

    def __init__(self, path: str, kind: str, cache_entries: int = CACHE_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.most, self.cache, self.words = kind, cache_entries, {}, {}
        self.model, self.pattern, self.letters = self.tokenizer.model, PRE_TOKEN[kind], byte_letters()
        self.dtype = np.dtype("<u4") if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 else np.dtype("<u2")
        self.code = "I" if self.dtype.itemsize == 4 else "H"

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def chunks(self, text: str) -> list:
        return text.encode("utf-8", "surrogatepass").split() if self.kind == "word" else BYTE_CHUNK.findall(text)

    def learn(self, chunks: list) -> dict:
        cache = self.cache
        new = set(chunks).difference(cache)
        if not new:
            return cache
        if len(cache) + len(new) > self.most:
            cache = self.cache = older_half(cache)
            new = set(chunks).difference(cache)
        odd, words, model = [], self.words, self.model
        if len(words) > self.most // 2:
            words = self.words = older_half(words)
        for c in new:
            text = c.decode("utf-8", "surrogatepass") if self.kind == "word" else c
            low = text.lower() if self.kind == "word" else text
            if len(low) != len(text) or not PLAIN.match(text):
                odd.append(c)
                continue
            parts = self.pattern.findall(low)
            for w in parts:
                if w not in words:
                    spelt = w if w.isascii() and w[0] > " " else "".join([self.letters[x] for x in w.encode()])
                    words[w] = array(self.code, [t.id for t in model.tokenize(spelt)]).tobytes()
            cache[c] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])
        texts = [c.decode("utf-8", "surrogatepass") if self.kind == "word" else c for c in odd]
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            cache[c] = array(self.code, e.ids).tobytes()
        return cache

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if any(s in text for s in self.special):
            return self.whole(text)
        chunks = self.chunks(text)
        return np.frombuffer(b"".join(map(self.learn(chunks).__getitem__, chunks)), self.dtype)


def encoder(path: str, kind: str, cache_entries: int = CACHE_ENTRIES) -> Encoder:
    """One per worker process and vocabulary; workers are used again by later tasks."""
    return in_worker(("encoder", path, kind, cache_entries), lambda: Encoder(path, kind, cache_entries))


def texts_of(column) -> Iterator[str | None]:
    """A string column's values one by one, so that a batch's Python strings never stand in memory together."""
    for value in column:
        yield value.as_py()
