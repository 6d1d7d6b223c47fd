"""Packing by power-of-two decomposition.

A document's tokens and its end mark are cut into as many whole sequences as fit and, for the
rest, one piece for each binary digit of its length, longest first. A piece is a sequence of its
own in the bucket of its length, so no sequence crosses documents and none needs padding: batches
are drawn bucket by bucket. Everything is decided within a document; nothing is shuffled.
"""

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import arrow_map, loaded, picked, row_ranges, utf8

SEQUENCE = 2048
END = 1
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Bytes of text that are tokenised at once.
BLOCK = 4 << 20
#: Bytes whose words are found at once; a longer text is cut before spaces.
PART = 512 << 10
#: New words that go through the tokenizer's model in one text.
JOINED = 4000
PIECES = ("doc_id *, start long, length int, ids binary, doc_tokens long, bucket int")

#: The kind of white space; letters, numbers and others are 1 to 3, a character not met yet is 0.
_WHITE = 4


def _byte_letters():
    """The letter a byte-level vocabulary writes for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 324))
    return np.array([b if b in own else next(rest) for b in range(256)], "<u2")


class ChunkTokenizer:
    r"""Token ids of whole texts through a byte-level tokenizer, whose model meets each distinct word
    once.

    Finding words costs the tokenizer more than its merges. The pattern that byte-level tokenizers
    share is therefore applied by array operations, and the model gets the words. It is

        's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

    A tokenizer with another one, a normalizer or added tokens that are more than fixed strings
    without a space gets whole texts.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.known = {}  # ids of words
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {x.content: array("I", [i]).tobytes() for i, x in added.items()}
        self.add = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.words = None
        pattern = self.tokenizer.pre_tokenizer
        if (self.tokenizer.normalizer is None and isinstance(pattern, pre_tokenizers.ByteLevel)
                and pattern.use_regex and not pattern.add_prefix_space
                and not any(x.single_word or x.lstrip or x.rstrip or " " in x.content for x in added.values())):
            # the same model, for words spelled in byte letters
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = _byte_letters()
            self.kinds = np.zeros(0x110000, np.uint8)

    @staticmethod
    def _encode(tokenizer, texts):
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _kinds(self, codes):
        """Kinds of characters, told by what the tokenizer's own pattern joins them to."""
        kinds = self.kinds[codes]
        if not kinds.all():
            new = np.unique(codes[kinds == 0])
            text = "".join(f"a{c}  1{c}  !{c}  " for c in map(chr, new.tolist()))
            begins = np.zeros(len(text), bool)
            begins[[at for _, (at, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
            joined = ~begins.reshape(-1, 3, 4)[:, :, 1]
            self.kinds[new] = np.where(joined.any(1), joined.argmax(1) + 1, _WHITE)
            kinds = self.kinds[codes]
        return kinds

    def _added(self, text, edge):
        """Where added tokens begin and end; none reaches into the next text."""
        found = self.add.search(text)
        while found:
            a, b = found.span()
            whole = not edge[a + 1:b].any()
            if whole:
                yield a, b
            found = self.add.search(text, b if whole else a + 1)

    def _begins(self, raw, edges):
        """Marks the bytes of UTF-8 texts at which words begin; ``edges`` marks where texts do."""
        text = raw.tobytes().decode()
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        lead = (raw & 0xC0) != 0x80
        edge = edges[lead]
        added = list(self._added(text, edge))
        for a, b in added:
            edge[a] = True
            edge[b:b + 1] = True
        kinds = self._kinds(codes)
        white = kinds == _WHITE
        begins = edge.copy()
        # a space belongs to the word after it; of more white space the last character stands alone
        begins[1:] |= (kinds[1:] != kinds[:-1]) & (codes[:-1] != 32)
        begins[:-1] |= white[:-1] & ~white[1:] & ~edge[1:]
        # 's 't 'm 'd 're 've 'll after the end of a word are words
        for i in np.flatnonzero(begins & (codes == 39)).tolist():
            ending = text[i + 1:i + 3]
            n = 2 if ending[:1] in ("s", "t", "m", "d") else 3 if ending in ("re", "ve", "ll") else 0
            if n and not edge[i + 1:i + n].any():
                begins[i + 1] = False
                begins[i + n:i + n + 1] = True
        for a, b in added:
            begins[a + 1:b] = False
        marked = np.zeros(len(raw), bool)
        marked[lead] = begins
        return marked

    @staticmethod
    def _cut(raw, edges, at):
        """Up to where to take words: a space after a non-space, the begin of a text, or the end."""
        end = at + PART
        while end < len(raw):
            before, here = raw[at:end - 1], raw[at + 1:end]
            cuts = np.flatnonzero((here == 32) & (before > 32) & (before < 127) | edges[at + 1:end])
            if len(cuts):
                return at + 1 + int(cuts[-1])
            end += end - at
        return len(raw)

    def _first_bytes(self, raw, offsets):
        """Where the words of all texts begin."""
        edges = np.zeros(len(raw) + 1, bool)
        edges[offsets] = True
        found, at = [], 0
        while at < len(raw):
            end = self._cut(raw, edges, at)
            edges[at] = True
            found.append(np.flatnonzero(self._begins(raw[at:end], edges[at:end])) + at)
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _learn(self, names, words):
        """Ids of new words. Many go through one call; a token stands for as many bytes as it has
        letters, so the ids of each word end where its bytes do."""
        data, offsets = utf8(words)
        for i in range(0, len(names), JOINED):
            group, at = names[i:i + JOINED], offsets[i:i + JOINED + 1]
            raw, stops = data[at[0]:at[-1]], at[1:] - at[0]
            spelled = np.full(len(raw) + len(group), 32, "<u2")
            spelled[np.arange(len(raw)) + np.repeat(np.arange(len(group)), np.diff(at))] = self.letters[raw]
            text = spelled.tobytes().decode("utf-16-le")
            found = self.words.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum(self.bytes[ids])
            cuts = np.searchsorted(ends, stops)
            if not len(ids) or not np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], stops):
                self.known.update(zip(group, self._encode(self.words, text.split())))
                continue
            cuts, ids = (4 * (cuts + 1)).tolist(), ids.tobytes()
            self.known.update(zip(group, (ids[a:b] for a, b in zip([0, *cuts], cuts))))

    def ids(self, texts, remembered=REMEMBERED):
        """(ids, offsets): the texts' token ids one after another, and where each text's begin.

        ``texts`` is an Arrow string array without nulls. Words are found and told apart on the
        array; only distinct ones become Python strings.
        """
        if self.words is None:
            parts = self._encode(self.tokenizer, texts.to_pylist())
            return np.frombuffer(b"".join(parts), "<u4"), np.cumsum([0, *(len(x) // 4 for x in parts)])
        raw, offsets = utf8(texts)
        begins = self._first_bytes(raw, offsets)
        words = pa.Array.from_buffers(pa.large_string(), len(begins), [
            None, pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        names = words.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > remembered:
            self.known = {}
        self.known.update(self.added)
        new = [i for i, w in enumerate(names) if w not in self.known]
        self._learn([names[i] for i in new], words.take(pa.array(new, pa.int64())))
        parts = [self.known[w] for w in names]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        taken = sizes[index]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat((starts[index] - ends + taken).astype(np.int32), taken)
        where += np.arange(total, dtype=np.int32)
        ids = np.frombuffer(b"".join(parts), "<u4")[where]
        return ids, np.append(0, ends)[np.searchsorted(begins, offsets)]


def text_blocks(batch, limit=2 << 20):
    """(first row, texts) of an Arrow batch's second column, in blocks of about ``limit`` bytes."""
    data, offsets = utf8(batch.column(1))
    raw = data.tobytes()
    del data
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[i:j], offsets[i + 1:j + 1])]
        i = j


def binary_lengths(n: int, longest: int) -> list[int]:
    """Whole sequences, then the binary digits of the rest from the largest down."""
    lengths, rest = [longest] * (n // longest), n % longest
    return lengths + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path, longest, end, remembered, block):
    def run(batches):
        tokenizer = loaded(ChunkTokenizer, path)
        mark = array("I", [end]).tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            _, offsets = utf8(texts)
            for first, stop in row_ranges(offsets, block):
                ids, at = tokenizer.ids(texts.slice(first, stop - first), remembered)
                raw = ids.tobytes()
                rows, starts, lengths, parts, totals = [], [], [], [], []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    own = raw[4 * a:4 * b] + mark
                    begin, total = 0, b - a + 1
                    for n in binary_lengths(total, longest):
                        rows.append(first + k)
                        starts.append(begin)
                        lengths.append(n)
                        parts.append(own[4 * begin:4 * (begin + n)])
                        totals.append(total)
                        begin += n
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int32()), pa.array(parts, pa.binary()),
                    pa.array(totals, pa.int64()),
                    pa.array([n.bit_length() - 1 for n in lengths], pa.int32()),
                ], ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end: int = END,
                   doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED,
                   block: int = BLOCK) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    bucket (the length is 2 to its power), sequence_id, offset.

    A null or empty text has the end mark alone. Null and repeated ids and repeated rows each keep
    their pieces: a sequence's id comes from the piece's place, not from the document's id.
    ``longest`` is a power of two; ``remembered`` and ``block`` trade a worker's memory for time and
    change nothing else. Further columns are ignored.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    pieces = arrow_map(picked(docs, doc_id, text), _pieces(tokenizer, longest, end, remembered, block), PIECES)
    return pieces.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of Parquet files for each length, for a loader that draws equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)
