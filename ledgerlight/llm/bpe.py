"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding.

Whatever prefix of a word one looks at, the last token of its encoding is the one token that ends
there, is itself stable, and may follow the last token of what stands before it. So one token for
each trie node is the whole state: its encoding is that token after the encoding of the node where
the token starts. Distinct words in sorted order are the trie in depth-first order; what a word
shares with the one before stays on the stack, so a shared prefix is encoded once.

Two tokens may stand side by side when undoing their merges, latest first, never meets a pair at
the border that would have been merged before what consumed it.
"""

import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerlight.llm.common import arrow_map, loaded, picked
from ledgerlight.llm.packing import text_blocks

#: Distinct chunks and token pairs a worker remembers before it starts anew.
REMEMBERED = 800_000
PAIRS = 1_000_000
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_CHUNK = regex.compile(r"[^ \t\n\r\x0b\x0c]+")
_SPECIAL = regex.compile("(" + "|".join(map(regex.escape, SPECIAL)) + ")")


def _byte_letters():
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    others = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + k) for k, b in enumerate(others)}


class TrieEncoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path):
        with open(os.fspath(path), encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        self.vocab = model["vocab"]
        self.strings = [""] * (1 + max(*self.vocab.values(), *(t["id"] for t in made["added_tokens"])))
        for word, i in self.vocab.items():
            self.strings[i] = word
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        for word, i in self.special.items():
            self.strings[i] = word
        self.rank = dict.fromkeys(self.vocab.values(), -1)
        self.halves, self.merged = {}, {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ids = self.vocab[a], self.vocab[b]
            whole = self.vocab[a + b]
            self.merged.setdefault(ids, k)
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = ids, k
        self.letters = _byte_letters()
        self.pairs, self.known, self.words = {}, {}, {}
        self.longest = max(len(w.removesuffix(WORD_END)) for w in self.vocab)
        # a token is usable if encoding its own text gives it back
        self.usable = {i for i in self.vocab.values() if self._stable(i)}
        self.starts = {w: i for w, i in self.vocab.items() if i in self.usable}

    def _stable(self, token):
        """Whether the merges that make a token are the ones its text would undergo."""
        if token not in self.halves:
            return True
        word = self.strings[token]
        parts = [*word.removesuffix(WORD_END)]
        if word.endswith(WORD_END):
            parts[-1] += WORD_END
        parts = [self.vocab.get(p) for p in parts]
        if None in parts:
            return False
        while len(parts) > 1:
            k, i = min((self.merged.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if k == 1 << 60:
                return False
            parts[i:i + 2] = [self.vocab[self.strings[parts[i]] + self.strings[parts[i + 1]]]]
        return parts == [token]

    def _follows(self, a, b):
        rank, merged, halves = self.rank, self.merged, self.halves
        before, ties = 1 << 60, False  # a merge at this rank or, with ties, up to it comes first
        while True:
            k = merged.get((a, b))
            if k is not None and (k < before or ties and k == before):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # the left token was made later; its own merge lies further left
                before, ties, a = rank[a], False, halves[a][1]
            else:
                before, ties, b = rank[b], True, halves[b][0]

    def encode_words(self, words):
        """32-bit ids, as bytes, of distinct words whose letters stand for bytes."""
        out, before, last = {}, "", [(0, -1)]  # of each prefix: where its last token starts, token
        starts, pairs, follows, longest = self.starts, self.pairs, self._follows, self.longest
        if len(pairs) > PAIRS:
            pairs.clear()
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[min(shared, n - 1) + 1:]
            for end in range(len(last), n + 1):  # the word's own end is marked, so not a prefix
                text = word if end < n else word + WORD_END
                stop = end if end < n else len(text)
                for start in range(end - longest if end > longest else 0, end):
                    token = starts.get(text[start:stop])
                    if token is None:
                        continue
                    if not start:
                        break
                    key = last[start][1], token
                    may = pairs.get(key)
                    if may is None:
                        may = pairs[key] = follows(*key)
                    if may:
                        break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                last.append((start, token))
            at, token = last.pop()
            ids = [token]
            while at:
                at, token = last[at]
                ids.append(token)
            out[word] = array("I", ids[::-1]).tobytes()
            before = word
        return out

    def _split(self, chunk):
        """Words of a chunk as letters that stand for bytes, and ids of special tokens."""
        for part in _SPECIAL.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                yield self.special[part]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # letter by letter where there is a sigma: a final one is not told apart
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            for word in (part,) if part.isalpha() else _SPLIT.findall(part):
                yield word if word.isascii() and word.isprintable() else (
                    word.encode().decode("latin-1").translate(self.letters))

    def ids(self, texts):
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        chunks = [_CHUNK.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.words = {}, {}
        new = set()
        for some in chunks:
            new.update(some)
        new.difference_update(self.known)
        parts = {c: list(self._split(c)) for c in new}
        words = {w for some in parts.values() for w in some if isinstance(w, str)}
        self.words.update(self.encode_words(words.difference(self.words)))
        for chunk, some in parts.items():
            self.known[chunk] = self.words[some[0]] if len(some) == 1 and isinstance(
                some[0], str) else b"".join(
                self.words[w] if isinstance(w, str) else array("I", [w]).tobytes() for w in some)
        of = self.known.__getitem__
        return [b"".join(map(of, some)) for some in chunks]

    def decode(self, ids):
        return " ".join(map(self.strings.__getitem__, ids))


def _round_trip(path):
    def run(batches):
        encoder = loaded(TrieEncoder, path)
        for batch in batches:
            for first, texts in text_blocks(batch):
                raw = encoder.ids(texts)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array([encoder.decode(x.tolist()) for x in ids], pa.string()),
                ], ["doc_id", "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Every document's ids and the text they decode to: doc_id, ids array<int>, decoded.

    A null or empty text has no ids and decodes to the empty text. Null and repeated ids and
    repeated rows each keep their row. Further columns are ignored.
    """
    return arrow_map(picked(docs, doc_id, text), _round_trip(tokenizer),
                     "doc_id *, ids array<int>, decoded string")
