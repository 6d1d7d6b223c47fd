"""Quality by tokenizer fertility, after plain rules.

Rules (``base_failed``): fewer than ten words, or over a fifth of the words inside five-word
windows that occur twice or more. For the rest a public vocabulary measures, over all words,
characters per token, the share of byte-fallback tokens and the entropy of the tokens. Symbols
strung into words, encoded data and mangled bytes make tokens shorter and poorer at once, or fall
back to bytes; prose with a rare word or a second language does not. So each measure is placed in
its band, in half-widths off the middle, and a document is rejected where their sum, low being
bad, falls below the edge.

Bands come from all distinct texts that pass the rules: median and inner half by language (or, where
none is given, script) and by length, in powers of two of the token count, because short texts
scatter more and have less entropy. They are robust: a large share of junk does not move them, and neither
do copies of one text, which count once. Near copies count each.

A band of few texts is no switch: every band leans on the next wider one by as much as ``LEAN`` texts
weigh, a language's class on its script's class over all languages, and that on a fixed, wide band
of the vocabulary. So a single text more moves a verdict's band a little, never from nothing to all.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import arrow_map, loaded, row_ranges, utf8, written
from ledgerlight.llm.words import RUN, hashed, run_hashes

MEASURES = (
    "doc_id *, band string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, digest long")
#: Least half-widths: characters per token, share of byte tokens, bits of entropy.
LEAST = {"chars_per_token": 0.01, "byte_share": 0.01, "entropy": 0.02}
#: Sum of the places, in half-widths, below which a document is rejected.
EDGE = -7.0
#: No single measure counts for more than this, either way.
MOST = 20.0
#: Texts that the next wider band weighs in a band.
LEAN = 5.0
#: Middle and half-width of the vocabulary's own bands: prose of any script has a token for every
#: one to seven characters and few bytes; entropy falls short of the length class's bits by little,
#: and of ten bits in long texts.
OWN = {"chars_per_token": (4.0, 0.5), "byte_share": (0.0, 0.1), "entropy": (0.9, 10.0, 0.5)}
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 200_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: First letters of a few scripts' code blocks; Latin and the rest by elimination.
SCRIPTS = {
    "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿ", "hebrew": "֐-׿",
    "devanagari": "ऀ-ॿ", "han": "㐀-鿿", "kana": "぀-ヿ", "hangul": "가-힯", "thai": "฀-๿",
}
_SCRIPTS = {name: re.compile(f"[{block}]") for name, block in SCRIPTS.items()}


def script_of(text: str) -> str:
    """The script most of a text's non-ASCII letters are in; ``latin`` without such."""
    if text.isascii():
        return "latin"
    counts = {name: len(p.findall(text)) for name, p in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if 2 * counts[best] > sum(map(str.isalpha, text)) else "latin"


class WordPieces:
    """Token ids of words under a vocabulary with byte fallback, one call for each distinct word."""

    def __init__(self, path):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.index, self.ids, self.counts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def of(self, words):
        """Index of each word into ``counts``; the ids stand in ``ids`` one word after another."""
        if len(self.index) > REMEMBERED:
            self.index, self.ids, self.counts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        new = list(set(words).difference(self.index))
        if new:
            found = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.ids = np.concatenate([self.ids, *(np.array(x, np.int32) for x in found)])
            self.counts = np.concatenate([self.counts, np.fromiter(map(len, found), np.int64, len(found))])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def _entropy(rows, ids, n, vocabulary):
    """Bits of entropy of each row's tokens."""
    keys, counts = np.unique(rows * vocabulary + ids, return_counts=True)
    totals = np.bincount(rows, minlength=n)
    weighted = np.bincount(keys // vocabulary, counts * np.log2(counts), n)
    some = np.maximum(totals, 1)
    return np.log2(some) - weighted / some


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a five-word window that occurs twice or more."""
    if len(words) <= RUN:
        return 0
    runs = run_hashes(words)
    _, index, counts = np.unique(runs, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[index] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[twice] += 1
    edges[twice + RUN] -= 1
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _sums(flags, offsets):
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _measure(path):
    def block(pieces, data, offsets, langs):
        n = len(offsets) - 1
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        hashes, at = hashed(data, offsets)
        words = [t.split() for t in texts]
        n_words = np.diff(at)
        flat = pieces.of([w for some in words for w in some])
        per_word = pieces.counts[flat]
        ends = np.cumsum(pieces.counts)
        starts = ends - pieces.counts
        total = int(per_word.sum())
        within = np.arange(total) - np.repeat(np.cumsum(per_word) - per_word, per_word)
        ids = pieces.ids[np.repeat(starts[flat], per_word) + within]
        rows = np.repeat(np.repeat(np.arange(n), n_words), per_word)
        tokens = np.bincount(rows, minlength=n)
        chars = _sums(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets)
        some = np.maximum(tokens, 1)
        # a script counts where most letters are of it: not where ASCII letters outnumber other bytes
        foreign = _sums(data > 127, offsets)
        plain = _sums(_LETTER[data], offsets)
        scripts = ["latin" if f <= p else script_of(t.decode("utf-8", "replace"))
                   for f, p, t in zip(foreign.tolist(), plain.tolist(), texts)]
        return [
            pa.array([lang or script for lang, script in zip(langs, scripts)], pa.string()),
            pa.array(scripts, pa.string()),
            pa.array(n_words.astype(np.int64)), pa.array(chars), pa.array(_sums(_SYMBOL[data], offsets)),
            pa.array([duplicate_lines(t) for t in texts], pa.int64()),
            pa.array([repeated_words(hashes[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
            pa.array(tokens.astype(np.int64)), pa.array(chars / some),
            pa.array(np.bincount(rows, pieces.fallback[ids], n) / some),
            pa.array(_entropy(rows, ids, n, len(pieces.fallback))),
            pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
        ]

    def run(batches):
        pieces = loaded(WordPieces, path)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            langs = batch.column(2).to_pylist()
            for i, j in row_ranges(offsets, 1 << 20):
                columns = block(pieces, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], langs[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names)
    return run


def measure(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
            lang: str | None = "lang") -> DataFrame:
    """Counts and fertility measures of every document, the band it belongs to and a digest of its text."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
    return arrow_map(rows, _measure(vocabulary), MEASURES)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bands(measures: DataFrame, *keys: str) -> DataFrame:
    """Number, median and half of the inner half of each measure, over the distinct texts that pass
    the rules.

    Copies count once: a text that fills half of a class would take its inner half for itself.
    """
    found = []
    for name, least in LEAST.items():
        parts = F.percentile_approx(name, [0.25, 0.5, 0.75], 10_000)
        half = F.greatest((parts[2] - parts[0]) / 2, F.lit(least))
        found.append(F.struct(parts[1].alias("mid"), half.alias("half")).alias(name))
    return measures.where(~base_failed()).groupBy(*keys, "digest").agg(
        *(F.first(name).alias(name) for name in LEAST)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.struct(*found).alias("edges"))


def _own(name):
    """The vocabulary's fixed band of a measure."""
    if name != "entropy":
        return tuple(map(F.lit, OWN[name]))
    share, most, half = OWN[name]
    return F.lit(share) * F.least(F.col("length_class") + 0.5, F.lit(most)), F.lit(half)


def _leaning(column, name, wider):
    """Middle and half-width of a band that leans on a wider one; that one alone where it has no texts."""
    n = F.coalesce(F.col(f"{column}.n"), F.lit(0))
    return tuple((n * F.coalesce(F.col(f"{column}.edges")[name][part], F.lit(0.0)) + LEAN * other) / (n + LEAN)
                 for part, other in zip(("mid", "half"), wider))


def quality(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
            lang: str | None = "lang", edge: float = EDGE) -> DataFrame:
    """Every document's counts, measures, place, base_failed and kept.

    Null and empty texts have no words and fail the rules. A null language gives the band of the
    text's script. Bands of few texts lean on wider ones. Null and repeated ids and repeated rows
    each keep their row. Further columns are ignored.
    """
    measures = written(measure(docs, vocabulary, doc_id, text, lang), "fertility")
    measures = measures.withColumn(
        "length_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    # A few rows for each language. As tables their size is known, so that they travel and the
    # documents, which may carry whole rows, do not.
    joined = measures
    for column, key in (("near", "band"), ("wide", "script")):
        of = written(bands(measures, key, "length_class"), "bands")
        joined = joined.join(of.select(key, "length_class", F.struct("n", "edges").alias(column)),
                             [key, "length_class"], "left")

    def place(name):
        mid, half = _leaning("near", name, _leaning("wide", name, _own(name)))
        off = (F.col(name) - mid) / half
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), off))

    total = place("chars_per_token") + place("entropy") - F.greatest(F.lit(0.0), place("byte_share"))
    return joined.withColumn("place", total).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("place") >= edge)).drop("near", "wide", "digest", "script")
