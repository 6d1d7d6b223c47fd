import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerlight.llm import bpe, packing
from ledgerlight.llm.queries import BYTE_BPE, WORD_BPE

ALPHABET = " \n\t\x0b\x0c\r\x1c\x85 　​abcXYZ'stréÉ́Σσςİß\U0001D518漢字12٣!?.,<|>endoftx_"
SPECIAL = ["foo <|endoftext|> bar", "x<|startoftext|>y <|endoftext|><|endoftext|>", "", "  ", "\n\n a",
           "a  ", " a", "a\n b", "aaaaaaa'aaaaaaaaaaaaa", "ab" * 400, "'s 's'll I'LL DON'T don't"]


def reference(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


BYTES, WORDS = reference(BYTE_BPE), reference(WORD_BPE)
ENCODER = bpe.TrieEncoder(WORD_BPE)
LOADED = packing.ChunkTokenizer


def chunk_ids(texts):
    import pyarrow as pa
    ids, at = packing.ChunkTokenizer(BYTE_BPE).ids(pa.array(texts, pa.large_string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=60), max_size=4))
def test_trie_encoder_equals_library(texts):
    for text, raw in zip(texts, ENCODER.ids(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == WORDS.encode(text, add_special_tokens=False).ids
        assert ENCODER.decode(ids) == WORDS.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=60), min_size=1, max_size=8))
def test_chunks_equal_whole_texts(texts):
    assert chunk_ids(texts) == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]


def test_fixed_cases():
    assert chunk_ids(SPECIAL) == [BYTES.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    for text, raw in zip(SPECIAL, ENCODER.ids(SPECIAL)):
        assert np.frombuffer(raw, "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'stmdrevl \n\u00a0aZ1!\u00e9"), st.characters(exclude_categories=["Cs"])),
                        max_size=60), min_size=1, max_size=8), st.sampled_from([3, 40, 1 << 20]))
def test_words_are_those_of_the_pattern(texts, part):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "PART", part, raising=False)
        patch.setattr(packing, "ChunkTokenizer", lambda path: packing.loaded(LOADED, path))
        assert chunk_ids(texts) == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_end_with_their_text():
    texts = ["a'", "s b'", "'ll", "re <|endof", "text|> c", " ", "", "\n", " d", "<|endoftext|>'s<|endoftext", "|>",
             "'<|endoftext|>s it's<|", "<|<|endoftext|>|> <|endoftext|>  <|endoftext|>\n"]
    assert chunk_ids(texts) == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_patterns_and_added_tokens_get_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import AddedToken, normalizers, pre_tokenizers
    texts = [*SPECIAL, "", "It's  12 odd\u00a0 Words", "take it AB, not cAB or <x y> "]
    others = [reference(BYTE_BPE) for _ in range(4)]
    others[0].normalizer = normalizers.Lowercase()
    others[1].pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    others[2].pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    others[3].add_tokens([AddedToken("AB", single_word=True), AddedToken("<x y>", lstrip=True)])
    for k, other in enumerate(others):
        other.save(str(tmp_path / f"{k}.json"))
        ids, at = packing.ChunkTokenizer(str(tmp_path / f"{k}.json")).ids(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            other.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_model_meets_each_word_once():
    import pyarrow as pa

    class Counted:
        given = 0

        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **how):
            Counted.given += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    tokenizer = packing.ChunkTokenizer(BYTE_BPE)
    for name in {"tokenizer", "words"} & {*vars(tokenizer)}:
        setattr(tokenizer, name, Counted(getattr(tokenizer, name)))
    words = ["w" + "".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(2000)]
    texts = ["x " + " ".join(w + mark for w in words for mark in (".", ",\n" + w + "!", "***", "?\n"))] * 2
    ids, at = tokenizer.ids(pa.array(texts, pa.large_string()))
    assert ids[:at[1]].tolist() == BYTES.encode(texts[0], add_special_tokens=False).ids
    # once with the space before it, once after a line's end
    assert Counted.given < 1.5 * 2 * sum(len(w) + 1 for w in words)


def test_every_usable_token_encodes_to_itself():
    assert len(ENCODER.usable) > 40_000
    for token in list(ENCODER.usable)[::997]:
        word = ENCODER.strings[token]
        if word.endswith("</w>") and len(word) > 4:
            found = ENCODER.encode_words([word.removesuffix("</w>")])
            assert np.frombuffer([*found.values()][0], "<u4").tolist() == [token]


def test_shared_prefixes_and_repeats(docs, odd_rows):
    rows = bpe.encode_decode(docs(odd_rows), WORD_BPE).collect()
    assert len(rows) == len(odd_rows)
    want = sorted(((d, WORDS.encode(t or "", add_special_tokens=False).ids) for d, t, _ in odd_rows), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == want
    for r in rows:
        assert r.decoded == WORDS.decode(list(r.ids), skip_special_tokens=False)
    assert bpe.encode_decode(docs([]), WORD_BPE).collect() == []


@given(st.integers(1, 100_000))
def test_binary_lengths(n):
    lengths = packing.binary_lengths(n, 2048)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    assert len([x for x in lengths if x < 2048]) == len({x for x in lengths if x < 2048})


def test_pieces_hold_every_token_once(docs, odd_rows, tmp_path):
    pieces = packing.pack_documents(docs(odd_rows), BYTE_BPE)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length == 1 << r.bucket == len(r.ids) // 4 for r in rows)
    assert sum(r.length for r in rows) == sum(
        len(BYTES.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in odd_rows)
    for doc in (2, 4, 9, 10, 11):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        text = next(t for d, t, _ in odd_rows if d == doc)
        assert ids == BYTES.encode(text, add_special_tokens=False).ids + [1]
        assert {r.doc_tokens for r in own} == {len(ids)}
    packing.write_buckets(pieces, str(tmp_path / "out"))
    back = pieces.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    assert packing.pack_documents(docs([]), BYTE_BPE).collect() == []


def test_blocks_bound_a_worker_and_change_no_piece(monkeypatch):
    import pyarrow as pa
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(40)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array(texts)], ["doc_id", "text"])
    held, ids = [], packing.ChunkTokenizer.ids

    def seen(self, some, remembered):
        held.append((some.nbytes, len(self.known)))
        return ids(self, some, remembered)

    def pieces(remembered, block):
        packing.loaded(packing.ChunkTokenizer, BYTE_BPE).known.clear()
        run = packing._pieces(BYTE_BPE, 2048, 1, remembered, block)
        return pa.Table.from_batches(run([batch])).to_pylist()

    whole = pieces(packing.REMEMBERED, packing.BLOCK)
    monkeypatch.setattr(packing.ChunkTokenizer, "ids", seen)
    assert pieces(1000, 8000) == whole
    assert len(held) > 4 and max(n for n, _ in held) < 9000 and max(n for _, n in held) < 3000


def test_longest_must_be_a_power_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack_documents(docs([]), BYTE_BPE, longest=1000)
