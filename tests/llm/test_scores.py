import collections
import random
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import fertility, langid, licences, toxicity
from ledgerlight.llm.common import table
from ledgerlight.llm.queries import PIECES
from ledgerlight.llm.words import hashed, run_hashes

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    inside = set()
    for k in range(len(words) - 4):
        if runs[tuple(words[k:k + 5])] > 1:
            inside.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_rules_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    for r in fertility.quality(docs, PIECES).collect():
        assert counts(r) == want[r.doc_id]
        n, repeat = want[r.doc_id][0], want[r.doc_id][4]
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_fertility_keeps_prose_and_rejects_symbols(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    found = fertility.quality(docs, PIECES).select("n_words", "n_symbols", "base_failed", "kept").collect()
    found = [r for r in found if not r.base_failed]
    prose = [r for r in found if r.n_symbols <= r.n_words / 10]
    junk = [r for r in found if r.n_symbols > r.n_words / 10]
    assert sum(r.kept for r in prose) / len(prose) > 0.99
    assert sum(not r.kept for r in junk) / len(junk) > 0.9


def test_copies_do_not_move_the_bands(spark):
    """One clean text copied to a third of all rows leaves every other document's place."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")

    def places(docs):
        return {r.doc_id: (r.place, r.kept) for r in fertility.quality(docs, PIECES).collect()}

    want = places(docs)
    texts = [r for r in docs.where("lang = 'en'").orderBy("doc_id").collect() if want[r.doc_id][1]]
    for hot in texts[0], texts[len(texts) // 2]:
        copies = spark.createDataFrame([(10_000_000 + i, hot.text, hot.lang) for i in range(500)], docs.schema)
        found = places(docs.unionByName(copies))
        assert {d: found[d][1] for d in want} == {d: kept for d, (_, kept) in want.items()}
        assert all(found[d][0] == pytest.approx(place, abs=1e-6) for d, (place, _) in want.items())


def test_quality_of_odd_rows(docs, odd_rows):
    found = fertility.quality(docs(odd_rows), PIECES).collect()
    assert sorted(((r.doc_id, *counts(r)) for r in found), key=str) == sorted(
        ((d, *base(t)) for d, t, _ in odd_rows), key=str)
    assert fertility.quality(docs([]), PIECES).collect() == []


def test_fertility_measures(docs):
    text = "plain words of text and more words " * 3 + "\U0001F9FF\U000E0041"
    row = fertility.measure(docs([(1, text, None)]), PIECES).first()
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [i for w in WORD.findall(text) for i in model.encode(w)]
    assert row.band == "latin" and row.n_tokens == len(ids)
    share = np.array([*collections.Counter(ids).values()]) / len(ids)
    assert row.entropy == pytest.approx(-(share * np.log2(share)).sum())
    assert row.byte_share == pytest.approx(np.mean([model.is_byte(i) for i in ids]))
    assert row.chars_per_token == pytest.approx(row.word_chars / len(ids))
    assert fertility.script_of("Привет мир") == "cyrillic" and fertility.script_of("漢字漢字") == "han"


def test_words_equal_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab C\t\n\x0b\x85é ") for _ in range(rng.randrange(40))).encode() for _ in range(300)]
    texts += [b"", b" ", b"x" * 5000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found, at = hashed(data, np.cumsum([0, *map(len, texts)]), lower=True)
    names = {}
    for text, a, b in zip(texts, at[:-1], at[1:]):
        words = text.lower().split()
        assert b - a == len(words)
        for w, h in zip(words, found[a:b].tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_long_text_hashes_as_in_one_piece(monkeypatch):
    from ledgerlight.llm import words
    text = np.frombuffer((" ".join(f"w{i}" for i in range(3000)) + " " + "z" * 900).encode(), np.uint8)
    at = np.array([0, len(text)])
    whole, _ = hashed(text, at)
    monkeypatch.setattr(words, "PART", 500)
    parts, index = hashed(text, at)
    assert np.array_equal(whole, parts) and index.tolist() == [0, len(parts)]
    assert len(run_hashes(whole)) == len(whole) - 4 and len(run_hashes(whole[:3])) == 1


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_of_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    tested = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.97


def test_context_tree_prices_by_longest_known_context():
    tree = langid.ContextTree([b"abababab", b"abac"], order=2)
    def price(text):
        data = np.frombuffer(text, np.uint8)
        return tree.bits(langid.grams(data, np.array([0, len(data)]), 2))
    # after "ba": b three times, c once: 4 seen, 2 kinds
    assert price(b"bab")[-1] == pytest.approx(np.log2((3 + 1 + 2) / 3))
    # after "ab" only a (4 times): an escape, then after "b" only a: an escape, then order 0
    n, kinds = 12, 3
    assert price(b"abc")[-1] == pytest.approx(2 * np.log2(5) + np.log2(n + kinds))
    # never seen at all: escapes down to an even code over bytes
    assert price(b"abz")[-1] == pytest.approx(2 * np.log2(5) + np.log2((n + kinds) / kinds) + 8)


def test_language_of_odd_rows(docs, odd_rows):
    rows = docs(odd_rows)
    found = langid.identify(rows, langid.learn(rows)).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].lang_pred == by_id[3].lang_pred == "und" and by_id[8].lang_pred in ("en", "de", "xx")
    empty = docs([])
    assert langid.learn(empty) == {} and langid.identify(empty, {}).collect() == []
    assert {r.lang_pred for r in langid.identify(rows, {}).collect()} == {"und"}


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect() if r.held_out]
    for spoken in "en", "de", "fr", "es":
        pairs = [(r.predicted, truth[r.doc_id]) for r in found if r.doc_id in truth and lang[r.doc_id] == spoken]
        assert np.mean([p for p, t in pairs if t]) > 0.8 and np.mean([p for p, t in pairs if not t]) < 0.02


def test_grammar():
    reader = toxicity.Reader(set(), set())
    def labels(text):
        return toxicity.matches(reader.symbols(text))
    assert labels("a calm day") == [] and labels("never you said") == []
    assert labels("what an idiot") == [[0]]
    assert labels("you absolute idiot") == labels("idiot that you are") == [[1]]
    assert labels("he is not an idiot")[0][0] & 2 and labels("she said what an idiot")[0][0] & 4
    # windows end with the clause
    assert labels("never mind. an idiot") == [[0]] and labels("you. idiot\nyou") == [[0]]
    threat = toxicity.OUTCOMES
    assert labels("they kill") == [[threat + toxicity.HAS_TARGET]]
    assert labels("I will kill you") == [[threat + toxicity.HAS_TARGET + toxicity.HAS_INTENT]]
    # a word of death is a threat in its phrase alone
    assert labels("I hope that you die") == labels("ich hoffe du musst sterben") == labels("I will kill you")
    assert labels("die Katze") == labels("you may die") == labels("I hope. you die") == []
    assert labels("I hope you never die")[0][0] & 2
    assert labels("you idiot and moron! what scum") == [[1, 1], [0]]


def test_learned_terms_need_contexts():
    rng = random.Random(2)
    word = lambda: f"c{rng.randrange(300)}"
    texts, y = [], []
    for i in range(120):
        words = [word() for _ in range(40)]
        if i % 2:
            words.insert(rng.randrange(40), f"blargh{rng.choice('xyz')}")
        texts.append(" ".join(words))
        y.append(i % 2)
    texts += ["copied once and again uniqueword here"] * 60
    y += [1] * 60
    words, stems, _ = toxicity.learn_terms(texts, y)
    assert "blarg" in stems and "uniqueword" not in words and "uniqu" not in stems


def test_words_of_clean_text_are_spared():
    rng = random.Random(3)
    texts, y = [], []
    for i in range(160):
        words = [f"c{rng.randrange(400)}" for _ in range(40)]
        if i % 2:
            words.insert(rng.randrange(40), f"blargh{rng.choice('vwxyz')}")
        elif i % 4:
            words.insert(rng.randrange(40), "blarghous")
        texts.append(" ".join(words))
        y.append(i % 2)
    words, stems, spared = toxicity.learn_terms(texts, y)
    assert "blarg" in stems and spared == {"blarghous"}
    reader = toxicity.Reader(words, stems, spared)
    assert toxicity.matches(reader.symbols("blarghous")) == []
    assert toxicity.matches(reader.symbols("blarghness")) == [[3 * toxicity.OUTCOMES]]
    # one word does not make a stem
    one = [" ".join("blarghx" if w.startswith("blargh") and k else w for w in t.split() if k or w != "blarghous")
           for t, k in zip(texts, y)]
    words, stems, _ = toxicity.learn_terms(one, y)
    assert "blarghx" in words and not stems


def test_weights_settle_where_labels_tell_all_apart():
    x = np.zeros((400, 6))
    x[:40, 0] = x[:40, 4] = x[:40, 5] = np.log1p(np.arange(40) + 1)
    w = toxicity.fit_weights(x, np.arange(400) < 40)
    full = np.hstack([x, np.ones((400, 1))])
    p = 1 / (1 + np.exp(-full @ w))
    slope = full.T @ (p - (np.arange(400) < 40)) + np.array([0.5] * 6 + [1e-3]) * w
    assert np.abs(slope).max() < 1e-3 and p[1:40].min() > 0.5 > 0.1 > p[40:].max()


def labelled_texts(n, length, vocabulary):
    """Rows of id, text and label: every other text toxic, with an invented insult, some of them spared."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"c{rng.randrange(vocabulary)}" for _ in range(length)]
        if i % 2:
            words.insert(rng.randrange(length), f"blargh{rng.choice('vwxyz')}!")
        elif i % 4:
            words.insert(rng.randrange(length), "Blarghous")
        rows.append((i, " ".join(words), i % 2))
    return rows + [(n, "", 0), (n + 1, " \n", 1), (n + 2, "ÜBLES übles \u2028 idiot.", 1)]


def test_terms_of_a_table_equal_those_of_a_list(spark):
    rows = labelled_texts(160, 40, 400)
    sample = spark.createDataFrame([(y, t) for _, t, y in rows], "toxic int, text string").repartition(5)
    found = toxicity.learned_terms(sample, [81, 82])
    assert found == toxicity.learn_terms([t for _, t, _ in rows], [y for *_, y in rows])
    assert "blarg" in found[1] and found[2] == {"blarghous"}
    # copies of a row and of an id change nothing
    docs = spark.createDataFrame([r[:2] for r in rows * 2], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once, twice = (toxicity.learn(d, labels) for d in (docs.distinct(), docs.repartition(7)))
    assert np.array_equal(once.pop("weights"), twice.pop("weights")) and once == twice


def test_learning_holds_no_text_in_the_driver(spark, tmp_path):
    """Words of the sample are counted by tasks: the driver's memory does not grow with them."""
    path = f"{tmp_path}/docs"
    spark.createDataFrame(labelled_texts(160, 3000, 10**9), "doc_id long, text string, toxic int").write.parquet(path)
    rows = spark.read.parquet(path)
    tracemalloc.start()
    try:
        model = toxicity.learn(rows, rows)
        assert tracemalloc.get_traced_memory()[1] < 10e6
    finally:
        tracemalloc.stop()
    assert "blarg" in model["stems"]


def test_toxicity_of_odd_rows(spark, docs, odd_rows):
    rows = docs(odd_rows)
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, 1), (5, 0, 0), (None, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    found = toxicity.score(rows, toxicity.learn(rows, labels)).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    none = toxicity.learn(docs([]), labels.limit(0))
    assert toxicity.score(docs([]), none).collect() == []
    assert not any(r.predicted for r in toxicity.score(rows, none).collect())


def test_licences(spark, docs, odd_rows):
    plain = table(spark, SF, "documents")
    model = licences.learn(plain)
    planted = [(100 + i, f"first line of prose\n{t}\nlast line", "en")
               for i, t in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    names = [name for name, ts in licences.TEMPLATES.items() for _ in ts]
    found = [r for r in licences.scan(docs(odd_rows + planted), model).collect() if r.confirmed]
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[100 + i].family == name and by_id[100 + i].paragraph == 1 and by_id[100 + i].similarity == 1
               for i, name in enumerate(names))
    assert all(r.doc_id >= 100 for r in found)
    # whole corpus: confirmed are exactly the documents with a notice
    notice = re.compile("Licensed under CC BY-NC 4.0|GNU General Public License, version 3|"
                        "Apache License, Version 2.0|MIT License")
    want = {r.doc_id for r in plain.collect() if notice.search(r.text or "")}
    assert {r.doc_id for r in licences.scan(plain, model).where("confirmed").collect()} == want
    assert licences.scan(docs([]), licences.learn(docs([]))).collect() == []


def test_wrapped_notices(spark, docs):
    """Each template wrapped at 40 to 80 columns behind comment marks, between lines of prose."""
    model = licences.learn(table(spark, SF, "documents"))
    rows, names = [], []
    for name, templates in licences.TEMPLATES.items():
        for template in templates:
            for width in (40, 60, 80):
                for mark in ("# ", " * ", "// "):
                    lines = [mark + x for x in textwrap.wrap(template, width - len(mark))]
                    text = "\n".join([mark + "first line of prose", *lines, mark.rstrip(), "last line"])
                    rows.append((len(rows), text, "en"))
                    names.append(name)
    found = [r for r in licences.scan(docs(rows), model).collect() if r.confirmed]
    assert sorted((r.doc_id, r.family) for r in found) == list(enumerate(names))
    # a blank line parts
    apart = textwrap.wrap(licences.TEMPLATES["GPL"][1], 60)
    parted = licences.scan(docs([(1, "\n\n".join(apart), "en")]), model)
    assert not any(r.confirmed for r in parted.collect())


def test_letters_are_of_letter_categories():
    for text in ("½ ² ① 12", "ⅷ", "", "123 _ - £", "́"):
        assert not langid.has_letter(text)
    for text in ("a", "12 ß", "漢", "ʰ", "1ª"):
        assert langid.has_letter(text)


def test_samples_hold_one_text_of_an_id_however_often_it_is_repeated(spark):
    from ledgerlight.llm.sampling import first_of, texts_of
    rows = spark.range(30000).select(
        (F.col("id") % 3).alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id") % 2).alias("text"))
    rows = rows.unionByName(spark.range(10, 60).select(F.col("id").alias("doc_id"), F.lit("de").alias("lang"), F.lit("Text").alias("text")))
    chosen = first_of(rows, "lang", "doc_id", 20)
    assert {(r["lang"], r["n"]) for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {("en", 3), ("de", 20)}
    found = texts_of(rows, chosen, ["doc_id", "lang"], "text").collect()
    assert len(found) == 23 and len({(r["doc_id"], r["lang"]) for r in found}) == 23
    again = texts_of(rows.repartition(5), first_of(rows.repartition(7), "lang", "doc_id", 20), ["doc_id", "lang"], "text").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_bands_against_plain_sums(spark, docs):
    """Bands and verdicts from the measures alone, and no jump at any number of texts."""
    import math
    import random

    import numpy as np
    rng = random.Random(3)
    vocab = "the river runs past old stone walls while people carry bread and water home every single day".split()
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(12, 60))) for _ in range(45)]
    texts += ["#$% x9q zz@@ " * 8 + str(i) for i in range(3)] + [texts[0]] * 5
    table = docs([(i, t, "en" if i % 4 else None) for i, t in enumerate(texts)])
    rows = [r.asDict() for r in fertility.measure(table, PIECES).collect()]
    judged = {r["doc_id"]: r for r in fertility.quality(table, PIECES).collect()}

    def failed(r):
        return r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]

    def kind(r, key):
        return r[key], math.floor(math.log2(max(1, r["n_tokens"])))

    def edges(key, name):
        by = {}
        for r in rows:
            if not failed(r):
                by.setdefault(kind(r, key), {})[r["digest"]] = r[name]
        found = {}
        for k, some in by.items():
            values = sorted(some.values())
            at = [values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75)]
            found[k] = len(values), at[1], max((at[2] - at[0]) / 2, fertility.LEAST[name])
        return found

    def lean(own, wider):
        n, mid, half = own or (0, 0.0, 0.0)
        return [(n * a + fertility.LEAN * b) / (n + fertility.LEAN) for a, b in zip((mid, half), wider)]

    near = {n: edges("band", n) for n in fertility.LEAST}
    wide = {n: edges("script", n) for n in fertility.LEAST}
    for r in rows:
        place = {}
        for name in fertility.LEAST:
            own = fertility.OWN[name]
            if name == "entropy":
                own = own[0] * min(kind(r, "band")[1] + 0.5, own[1]), own[2]
            mid, half = lean(near[name].get(kind(r, "band")), lean(wide[name].get(kind(r, "script")), own))
            place[name] = float(np.clip((r[name] - mid) / half, -fertility.MOST, fertility.MOST))
        total = place["chars_per_token"] + place["entropy"] - max(0.0, place["byte_share"])
        assert abs(judged[r["doc_id"]]["place"] - total) < 1e-9
        assert judged[r["doc_id"]]["kept"] == (not failed(r) and total >= fertility.EDGE)


def test_one_text_more_does_not_flip_the_others(docs):
    import random
    rng = random.Random(4)
    vocab = "the river runs past old stone walls while people carry bread and water home every single day".split()
    texts = [(i, " ".join(rng.choices(vocab, k=40)), "en") for i in range(29)] + [(99, "#$% x9q zz@@ " * 12 + "x", "en")]
    few = {r.doc_id: r.kept for r in fertility.quality(docs(texts), PIECES).collect()}
    more = {r.doc_id: r.kept for r in fertility.quality(
        docs(texts + [(200, " ".join(rng.choices(vocab, k=40)), "en")]), PIECES).collect()}
    assert few == {i: more[i] for i in few} and all(few[i] for i in range(29))
