"""Toxicity by a weighted grammar of small finite-state transducers.

Words become symbols: insult, threat, target, negation, reported speech, intent, death, or none.
Window transducers remember a target, a negation, reported speech and an intent within a clause.
The grammar is their product with the machine that accepts a match: an insult, a threatening verb,
or a phrase of an intent or wish, a target and a word of death, such as "hope you die", where no
word is a threat alone. Each match emits one label, made of its kind and the states of the product,
and a document is scored by its matched clauses: a logistic weight for each label, learned from
labelled documents. A word outside what the grammar accepts weighs nothing.

Insults in general use are listed. Further ones are learned as words and as stems: those that
stand in toxic documents, in many different contexts, and next to never in others. Contexts are
counted instead of documents so that copies of one text teach nothing. A stem needs several words
of its own; words that clean documents hold too are spared, in learning it and in reading.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import arrow_map, drop, picked, written
from ledgerlight.llm.langid import held_out
from ledgerlight.llm.packing import text_blocks
from ledgerlight.llm.sampling import first_of, texts_of

#: Fitted on at most so many documents of either label, in the order of a hash of the id.
SAMPLE = 4000
#: Twice the log-likelihood ratio a learned term must reach, and its least share in toxic text.
EVIDENCE = 24.0
PRECISION = 0.9
#: The same for the contexts of a stem, whose matches have a weight of their own.
STEM_PRECISION = 0.8
STEMS = (4, 5, 6)
#: Words of its own that a stem needs, and clean documents that spare a word from stems.
FAMILY = 3
SPARED = 2
#: Toxic documents that a term needs.
LEAST = 4
#: Parts of the sample.
PARTS = 32
REMEMBERED = 200_000
THRESHOLD = 0.3

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, DEATH = range(8)
CLAUSE_END = 8
#: Mark an insult that was learned as a word, or by its stem.
LEARNED, BY_STEM = 16, 32
#: Fixed word lists of the grammar, English, German, French, Spanish.
WORDS = {
    INSULT: """idiot idiots moron morons stupid scum loser losers trash worthless pathetic clown
        disgusting dumb imbecile vermin
        idiotisch dummkopf abschaum versager wertlos erbärmlich
        idiote imbécile abruti ordure minable
        idiota imbécil estúpido estúpida escoria inútil""",
    THREAT: """kill hurt destroy murder strangle
        töten umbringen vernichten
        tuer détruire
        matar destruir matarte""",
    INTENT: """will i'll we'll gonna going shall should must deserve deserves hope wish
        werde werden wirst sollst sollt hoffe wünsche verdienst
        vais allons va devrais mérites espère souhaite
        voy vamos vas debes mereces espero ojalá""",
    DEATH: """die dies dead suffer bleed rot
        sterben stirbst tot leiden verrecken
        mourir meures crever crèves souffrir
        morir mueras muerto muerta sufras""",
    TARGET: """you your yours yourself he she they him her them his their
        du dich dir dein deine ihr euch euer sie
        tu toi te vous vos votre tes
        tú ti vosotros usted ustedes vuestro""",
    NEGATION: """not never no isn't aren't don't doesn't won't cannot nobody
        nicht nie niemals kein keine keinen
        ne pas jamais aucun aucune
        nunca jamás tampoco ningún""",
    REPORT: """said says say called calls wrote claimed told quoted quote
        sagte sagt schrieb nannte behauptete
        dit disait écrit appelé
        dijo dice escribió llamó""",
}
FIXED = {w: symbol for symbol, words in WORDS.items() for w in words.split()}
_EDGES = "\"'`.,;:!?()[]{}<>*_-«»“”„…¡¿#$%&|~^+=/\\@"
_ENDS = ".!?;:"


class Nearby:
    """A transducer that remembers a trigger for the next ``reach`` words of the clause."""

    def __init__(self, trigger, reach):
        self.trigger, self.reach = trigger, reach

    def step(self, state, symbol, gap):
        """The state after ``gap`` words, the last of them a symbol."""
        return self.reach if symbol == self.trigger else max(0, state - gap)


class Product:
    """Transducers that read the same word side by side; a state is the tuple of their states."""

    def __init__(self, *machines):
        self.machines = machines
        self.start = (0,) * len(machines)

    def step(self, state, symbol, gap):
        return tuple(m.step(s, symbol, gap) for m, s in zip(self.machines, state))

    @staticmethod
    def outcome(state):
        """A bit for each machine that remembers its trigger."""
        return sum((s > 0) << i for i, s in enumerate(state))


GRAMMAR = Product(Nearby(TARGET, 4), Nearby(NEGATION, 3), Nearby(REPORT, 1 << 30), Nearby(INTENT, 5))
HAS_TARGET, HAS_INTENT = 1, 8
#: What a match is: a listed insult, a threat, a learned insult, an insult by its stem.
KINDS = {INSULT: 0, THREAT: 1, DEATH: 1, LEARNED | INSULT: 2, BY_STEM | INSULT: 3}
#: Symbols without which nothing matches.
STARTERS = (INSULT, THREAT, DEATH)
#: One label for each kind of match and each outcome of the windows.
OUTCOMES = 2 ** len(GRAMMAR.machines)
LABELS = 4 * OUTCOMES


def matches(symbols: np.ndarray) -> list[list[int]]:
    """Labels emitted by each clause that has any. ``symbols``: one for each word."""
    out, clause, state, at = [], [], GRAMMAR.start, 0
    open_target = []  # matches still waiting for a target behind them
    for k in np.flatnonzero(symbols).tolist():
        symbol = int(symbols[k])
        kind, gap = symbol & 7, k - at
        at = k
        if kind:
            state = GRAMMAR.step(state, kind, gap)
            if kind == TARGET:
                for i, where in open_target:
                    if k - where <= GRAMMAR.machines[0].reach:
                        clause[i] |= HAS_TARGET
                open_target = []
            elif kind in STARTERS:
                seen = GRAMMAR.outcome(state)
                if kind != DEATH or seen & HAS_TARGET and seen & HAS_INTENT:
                    if not seen & HAS_TARGET:
                        open_target.append((len(clause), k))
                    clause.append(KINDS[symbol & ~CLAUSE_END] * OUTCOMES + seen)
        if symbol & CLAUSE_END:
            if clause:
                out.append(clause)
            clause, state, open_target = [], GRAMMAR.start, []
    if clause:
        out.append(clause)
    return out


def features(clauses: list[list[int]]) -> np.ndarray:
    """Dampened counts of each label, of matched clauses and of matches; 0 where none."""
    x = np.zeros(LABELS + 2)
    for clause in clauses:
        for label in clause:
            x[label] += 1
    x[LABELS] = len(clauses)
    x[LABELS + 1] = sum(map(len, clauses))
    return np.log1p(x)


class Reader(dict):
    """The symbol of each raw word: of its listed or learned form, plus the clause's end."""

    def __init__(self, words, stems, spared=()):
        super().__init__()
        self.words, self.stems, self.spared = dict.fromkeys(words, LEARNED | INSULT) | FIXED, stems, spared

    def __missing__(self, raw):
        word = raw.strip(_EDGES)
        symbol = self.words.get(word, NONE)
        if not symbol and self.stems and word not in self.spared and any(
                word[:n] in self.stems for n in STEMS if len(word) > n):
            symbol = BY_STEM | INSULT
        if raw[-1] in _ENDS:
            symbol |= CLAUSE_END
        if len(self) > REMEMBERED:
            self.clear()
        self[raw] = symbol
        return symbol

    def symbols(self, text):
        raw = text.lower().replace("\n", " ; ").split()
        return np.frombuffer(bytes(map(self.__getitem__, raw)), np.uint8)


def _terms(word):
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def _contexts(text):
    words = [w.strip(_EDGES) for w in text.lower().split()]
    return zip([""] + words[:-1], words, words[1:] + [""])


def _word_counts(texts, toxic):
    """Documents of each word and label; under no word, all words of the label."""
    counts = Counter()
    for text, y in zip(texts, toxic):
        words = [w for _, w, _ in _contexts(text)]
        counts["", y] += len(words)
        counts.update((w, y) for w in set(words) if w)
    return counts


def _term_counts(texts, toxic, spared):
    """Documents of each term and label."""
    counts = Counter()
    for text, y in zip(texts, toxic):
        own = {w for _, w, _ in _contexts(text) if w and w not in spared}
        counts.update({(t, y) for w in own for t in _terms(w)})
    return counts


def _term_contexts(texts, toxic, spared, likely):
    """Distinct contexts of each term and label."""
    return {(t, y, before, after) for text, y in zip(texts, toxic) for before, w, after in _contexts(text)
            if w and w not in spared for t in _terms(w) if t in likely}


def _is_likely(clean, bad, n):
    """``clean`` and ``bad`` of ``n`` documents of either label; numbers, or columns of Spark."""
    return bad / n[1] * (1 - PRECISION) >= clean / n[0] * PRECISION


def _ratio(term, clean, bad, even):
    """Twice the log-likelihood ratio of a term's contexts; ``even``: the share of toxic words."""
    share = bad / (bad + clean)
    if share <= even or share < (STEM_PRECISION if term.endswith("*") else PRECISION):
        return 0.0
    return 2 * (bad * math.log(share / even)
                + (clean * math.log((1 - share) / (1 - even)) if clean else 0))


def _learned(contexts, size, spared):
    """Words, stems and the words of these that are spared. ``contexts``: term, clean, toxic;
    ``size``: words in text of either label."""
    even = (size[1] + 1) / (size[0] + size[1] + 2)
    found = {t for t, clean, bad in contexts if _ratio(t, clean, bad, even) >= EVIDENCE}
    stems = {t[:-1] for t in found if t.endswith("*")}
    return ({t for t in found if not t.endswith("*")}, stems,
            {w for w in spared if any(w[:k] in stems for k in STEMS if len(w) > k)})


def learn_terms(texts: list[str], toxic: list[int]) -> tuple[set[str], set[str], set[str]]:
    """Words and stems of toxic text, and the words of these stems that are spared.

    Three passes: words by documents, terms by documents, likely terms by contexts. For texts at
    hand; ``learned_terms`` is the same over a table.
    """
    n = [max(1, len(toxic) - sum(toxic)), max(1, sum(toxic))]
    words = _word_counts(texts, toxic)
    spared = {w for w, y in words if w and not y and words[w, 0] >= SPARED
              and not _is_likely(words[w, 0], words[w, 1], n)}
    family = Counter(t for w, y in words if w and y and w not in spared for t in _terms(w))
    counts = _term_counts(texts, toxic, spared)
    likely = {t for t, y in counts if y and counts[t, 1] >= LEAST and _is_likely(counts[t, 0], counts[t, 1], n)
              and (not t.endswith("*") or family[t] >= FAMILY)}
    seen = Counter((t, y) for t, y, _, _ in _term_contexts(texts, toxic, spared, likely))
    return _learned([(t, seen[t, 0], seen[t, 1]) for t in likely], [words["", 0], words["", 1]], spared)


def _by_block(find, *held):
    """Rows of ``find`` for each block of texts; the first column holds their labels."""
    def run(batches):
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for first, texts in text_blocks(batch):
                found = find(texts, labels[first:first + len(texts)], *(h.value for h in held))
                if found:
                    rows = [(*k, n) for k, n in found.items()] if isinstance(found, Counter) else found
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, zip(*rows))], [f"c{i}" for i in range(len(next(iter(rows))))])
    return run


def learned_terms(sample: DataFrame, n: list[int]) -> tuple[set[str], set[str], set[str]]:
    """``learn_terms`` over a table of label and text with ``n`` rows of either label.

    Tasks count block by block and Spark adds up. The driver holds no text: of the words it gets
    those that are spared, of the terms those that are likely."""
    held = sample.sparkSession.sparkContext.broadcast
    n = [max(1, k) for k in n]

    def counted(find, *sets):
        parts = arrow_map(sample, _by_block(find, *sets), "c0 string, c1 long, c2 long")
        return parts.groupBy(F.col("c0").alias("term")).agg(
            *(F.sum(F.when(F.col("c1") == y, F.col("c2")).otherwise(0)).alias(name)
              for y, name in enumerate(("clean", "bad"))))

    words = written(counted(_word_counts), "toxicity-words")
    clean, bad = F.col("clean"), F.col("bad")
    size = words.where("term = ''").select("clean", "bad").first() or (0, 0)
    is_spared = (clean >= SPARED) & ~_is_likely(clean, bad, n)
    each = words.where("term != ''")
    spared = set(each.where(is_spared).select("term").toArrow()["term"].to_pylist())
    stems = [F.when(F.length("term") > k, F.concat(F.substring("term", 1, k), F.lit("*"))) for k in STEMS]
    family = each.where((bad > 0) & ~is_spared).select(
        F.explode(F.array_compact(F.array("term", *stems))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("family"))
    known = held(spared)
    likely = counted(_term_counts, known).where((bad >= LEAST) & _is_likely(clean, bad, n)).join(family, "term").where(
        ~F.col("term").endswith("*") | (F.col("family") >= FAMILY))
    likely = held(set(likely.select("term").toArrow()["term"].to_pylist()))
    seen = arrow_map(sample, _by_block(_term_contexts, known, likely), "c0 string, c1 long, c2 string, c3 string")
    seen = seen.distinct().groupBy("c0").agg(F.sum(1 - F.col("c1")), F.sum("c1"))
    found = _learned([tuple(r) for r in seen.collect()], size, spared)
    drop(words)
    return found


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic weights, the bias last, with a ridge on all but the bias.

    Newton's method; a step is halved until the loss falls by enough, so that collinear labels and
    samples that the labels tell apart whole settle too.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (penalty * w) @ w / 2

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), slope)
        fall = slope @ step
        size = 1.0
        while (then := loss(w - size * step)) > now - size * fall / 4 and size > 1e-9:
            size /= 2
        w, now = w - size * step, then
        if fall < 1e-10:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Learned words, stems and weights, from the whole texts of a bounded sample of labelled rows
    not held out; an id that is repeated counts once for each of its labels."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                          & ~held_out(F.col("doc_id")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = texts_of(rows, first_of(marked, "toxic", "doc_id", sample), ["doc_id"], "text").select("toxic", "text")
    rows = written(rows.repartition(PARTS, "toxic", "text").distinct(), "toxicity-sample")
    n = [0, 0]
    for y, count in rows.groupBy("toxic").count().collect():
        n[y] = count
    words, stems, spared = learned_terms(rows, n)
    model = {"words": sorted(words), "stems": sorted(stems), "spared": sorted(spared)}
    # one row for all documents of the same features and label, in an order that no layout changes
    found = arrow_map(rows, _features(docs.sparkSession.sparkContext.broadcast(model)), "x binary, toxic int")
    found = sorted((bytes(x), y, k) for x, y, k in found.groupBy("x", "toxic").count().collect())
    drop(rows)
    x = np.frombuffer(b"".join(x for x, _, _ in found)).reshape(-1, LABELS + 2)
    times = [k for _, _, k in found]
    y = np.repeat(np.array([y for _, y, _ in found], float), times)
    weights = fit_weights(np.repeat(x, times, axis=0), y) if found else np.append(np.zeros(LABELS + 2), -30.0)
    return model | {"weights": weights}


def _features(held):
    def run(batches):
        model = held.value
        reader = Reader(model["words"], set(model["stems"]), set(model["spared"]))
        for batch in batches:
            for first, texts in text_blocks(batch):
                x = [features(matches(reader.symbols(text))).tobytes() for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.binary()), batch.column(0).slice(first, len(texts))], ["x", "toxic"])
    return run


def _score(held):
    def run(batches):
        model = held.value
        reader = Reader(model["words"], set(model["stems"]), set(model["spared"]))
        weights = model["weights"]
        for batch in batches:
            for first, texts in text_blocks(batch):
                scores, clauses = [], []
                for text in texts:
                    symbols = reader.symbols(text)
                    found = matches(symbols) if np.isin(symbols & 7, STARTERS).any() else []
                    total = features(found) @ weights[:-1] + weights[-1]
                    scores.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
                    clauses.append(len(found))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array(scores, pa.float64()),
                    pa.array(clauses, pa.int32())], ["doc_id", "score", "clauses"])
    return run


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's held_out, score, predicted and number of matched clauses.

    A null or empty text matches nothing and gets the score of that. Without labelled rows every
    score is next to 0. Null and repeated ids and repeated rows each keep their row. Further
    columns are ignored.
    """
    # some thousand learned words and stems at most, and spared words: they come from a bounded sample
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = arrow_map(picked(docs, doc_id, text), _score(held), "doc_id *, score double, clauses int")
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
