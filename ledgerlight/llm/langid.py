"""Language identification by prediction by partial matching.

For each language, counts of the bytes that follow each context of up to four bytes are taken
once and frozen. A byte costs the code length the longest known context gives it; where that
context never saw the byte, its escape is paid and the next shorter one is asked, down to an even
code over all bytes. With frozen counts a byte's cost depends on it and the four before alone, so
every distinct five-byte run of a block is priced once and the prices are summed by document.
The language with the shortest code wins; the score is its share after turning code lengths per
document into odds.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import arrow_map, picked, row_ranges, utf8
from ledgerlight.llm.sampling import first_of, texts_of

ORDER = 4
#: Learned from at most so many documents of a language, taken in the order of a hash of the id.
SAMPLE = 400
#: Bits of code length per byte that count as one doubling of the odds of a whole document.
EVIDENCE = 0.02
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """A character of a letter category; digits, fractions and numerals that look like letters are none."""
    return any(unicodedata.category(c)[0] == "L" for c in text)


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its row (0 before the row) as one number."""
    wide = data.astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = wide.copy()
    for k in range(1, order + 1):
        before = np.zeros_like(wide)
        before[k:] = wide[:-k] if k <= len(wide) else 0
        before[at < k] = 0
        out |= before << np.uint64(8 * k)
    return out


class ContextTree:
    """Frozen counts of one language: for each order, sorted contexts and sorted (context, byte)."""

    def __init__(self, texts, order=ORDER):
        data = np.frombuffer(b"".join(texts), np.uint8)
        codes = grams(data, np.cumsum([0, *map(len, texts)]), order)
        self.levels = []
        for k in range(order, -1, -1):
            seen, counts = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, first = np.unique(seen >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(counts, first)
            kinds = np.diff(np.append(first, len(seen)))
            self.levels.append((k, seen, counts, contexts, totals, kinds))

    def bits(self, codes):
        """Code length of the last byte of each run."""
        cost = np.zeros(len(codes))
        left = np.arange(len(codes))
        for k, seen, counts, contexts, totals, kinds in self.levels:
            if not len(left):
                break
            run = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            context = run >> np.uint64(8)
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[c] == context
            s = np.minimum(np.searchsorted(seen, run), len(seen) - 1)
            hit = known & (seen[s] == run)
            room = np.log2(totals[c] + kinds[c])
            cost[left] += np.where(hit, room - np.log2(counts[s]),
                                   np.where(known, room - np.log2(kinds[c]), 0.0))
            left = left[~hit]
        cost[left] += 8
        return cost


def _score(held):
    def run(batches):
        model = held.value  # one copy for each worker
        names, trees = [*model], [*model.values()]
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_ranges(offsets, 1 << 20):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                total = np.zeros((j - i, len(names)))
                for a in range(0, len(part), 4 << 20):  # a very long text in pieces
                    lo = max(0, a - ORDER)
                    piece = part[lo:a + (4 << 20)]
                    inside = np.clip(at - lo, 0, len(piece))
                    codes, index = np.unique(grams(piece, inside), return_inverse=True)
                    index = index[a - lo:]
                    row = np.repeat(np.arange(j - i), np.diff(np.clip(at - a, 0, len(index))))
                    for k, tree in enumerate(trees):
                        total[:, k] += np.bincount(row, tree.bits(codes)[index], j - i)
                raw = part.tobytes()
                langs, scores = [], []
                for row, (x, y) in zip(total, zip(at[:-1], at[1:])):
                    if not names or not has_letter(raw[x:y].decode("utf-8", "replace")):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    odds = np.exp2(-np.minimum((row - row[best]) / (y - x) / EVIDENCE, 1000.0))
                    langs.append(names[best])
                    scores.append(float(1 / odds.sum()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
    return run


def held_out(doc_id):
    """Documents no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE) -> dict[str, ContextTree]:
    """A frozen context tree for each language, from the whole texts of at most ``sample`` of its
    documents; an id that is repeated counts once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0)
                      & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = texts_of(rows, first_of(rows, "lang", "doc_id", sample), ["doc_id", "lang"], "text")
    by_lang = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.doc_id)):
        by_lang.setdefault(r.lang, []).append(r.text.encode())
    return {name: ContextTree(parts) for name, parts in sorted(by_lang.items())}


def identify(docs: DataFrame, model: dict[str, ContextTree], doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Every document's held_out, lang_pred and score, over whole texts.

    A text that is null or has no letter, or an empty model, gives ``und`` with score 0. Equal
    code lengths go to the language first in the alphabet. Null and repeated ids and repeated rows
    each keep their row. Further columns are ignored.
    """
    # counts of at most ``SAMPLE`` texts for each language and order
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = arrow_map(picked(docs, doc_id, text), _score(held), "doc_id *, lang_pred string, score double")
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
