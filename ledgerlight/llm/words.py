"""Words of UTF-8 texts and 64-bit hashes of words and of runs of five, with array operations.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial in its bytes,
stirred; a run's hash mixes its words' hashes in order. Equal hashes stand for equal words: among
n different ones, chance makes two equal with a probability of n * n / 2^65.
"""

import numpy as np

RUN = 5
#: Bytes hashed at once; a longer text is hashed in parts cut at white space.
PART = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base, n):
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _powers[int(base)] = np.multiply.accumulate(steps)
    return held[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first one (and one past)."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    begins[first] = ~space[first]  # rows do not join
    finish = ~space
    finish[:-1] &= space[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    finish[last] = ~space[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return stir((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data))[starts])


def _parts(data: np.ndarray):
    """Parts of one long text, cut before white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data):
            found = np.flatnonzero(_SPACE[data[end:end + PART]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(data), end + PART)
        yield data[at:end]
        at = end


def hashed(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Word hashes of all rows and the index of each row's first one (and one past)."""
    if lower:
        data = _LOWER[data]
    if len(offsets) == 2 and len(data) > PART:
        found = [word_hashes(part, *spans(part, np.array([0, len(part)]))[:2]) for part in _parts(data)]
        found = np.concatenate(found)
        return found, np.array([0, len(found)])
    starts, ends, index = spans(data, offsets)
    return word_hashes(data, starts, ends), index


def run_hashes(words: np.ndarray, length: int = RUN) -> np.ndarray:
    """A hash for each run of ``length`` words; of all words if there are fewer, of none if none."""
    length = min(length, len(words))
    if not length:
        return np.zeros(0, np.uint64)
    n = len(words) - length + 1
    mixed = np.full(n, np.uint64(length))
    for k in range(length):
        mixed = (mixed ^ words[k:k + n]) * _STEPS[k % len(_STEPS)]
        mixed ^= mixed >> np.uint64(29)
    return stir(mixed)
