"""Periodic runs of words by an online sparse diagonal programme (operator 13).

A run of period q is a diagonal: words that equal the word q places before them, one after the
other. The programme goes through the words once and keeps, for every active lag, how many words
in a row have matched; earlier occurrences of a word start lags and make them longer, and a diagonal
that ends emits its run at once if it is long enough.

What keeps the programme sparse is which earlier occurrences may start a lag. A run of period q has
at least max(q, 12 - q) matches, so the window of the next 2^k words (2^k <= q < 2^(k+1), at least 4)
must occur q places before, and the words before both must differ, or the diagonal began earlier.
Windows are named by doubling, exactly and without hashes; names that occur once go. Occurrences of
one window at distances of up to half its length form a progression of its smallest period, and lags
inside a progression have that smaller period; so only heads of progressions are paired with the
others. That leaves starts in proportion to the words, also where one word fills a long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run has at least this many words, and at least two periods.
LEAST_WORDS = 12
#: Narrowest window that may start a lag: shorter than the matches of any run.
BASE = 4
#: Bytes of text whose words are named together; a longer text is named by itself.
CHUNK_BYTES = 6_000_000
FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` (stretches without the six ASCII white spaces) and the place where each text's words start."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[bounds - bounds[0]]


def join_words(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), pa.scalar(" ", words.type))


def slices(texts: pa.Array, size: int):
    """Consecutive parts of an array, each of about ``size`` bytes of text or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``at`` whose key occurs again, ordered by key and position, and the number of each one's key."""
    if not len(keys):
        return at, keys
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    again = ~(new & np.concatenate([new[1:], [True]]))
    return at[again], np.cumsum(new[again]) - 1


def _starts(word: np.ndarray, at: np.ndarray, name: np.ndarray, width: int) -> list[np.ndarray]:
    """[i, lag] of the diagonals that windows of ``width`` words at ``at`` (ordered by name and position) may start."""
    low, high = (1 if width == BASE else width), 2 * width
    rank, step = np.arange(len(at)), np.diff(at, prepend=at[:1])
    inner = np.concatenate([[False], name[1:] == name[:-1]]) & (step <= width // 2)
    heads = np.flatnonzero(~inner)
    number = np.cumsum(~inner) - 1
    first = heads[number]
    after = np.append(heads[1:], len(at))[number]
    found = [(at[inner], step[inner])] if width == BASE else []
    one, other = rank, first - 1  # each position with the heads of the progressions before its own
    while len(one):
        head = first[other]
        near = (other >= 0) & (name[head] == name[one]) & (at[one] - at[head] < high)
        one, head = one[near], head[near]
        found.append((at[one], at[one] - at[head]))
        other = head - 1
    one, head = rank, after  # each position with the heads of the progressions after its own
    while len(one):
        inside = head < len(at)
        one, head = one[inside], head[inside]
        near = (name[head] == name[one]) & (at[head] - at[one] < high)
        one, head = one[near], head[near]
        found.append((at[head], at[head] - at[one]))
        head = after[head]
    i, lag = (np.concatenate(part) for part in zip(*found))
    begins = (i == lag) | (word[i - 1] != word[i - lag - 1])
    keep = begins & (lag >= low) & (lag < high)
    return [i[keep], lag[keep]]


def starts(word: np.ndarray) -> np.ndarray:
    """(n, 2): every word i and lag from which a diagonal may be long enough, by i; equal numbers are equal words."""
    at, name = _repeated(word, np.arange(len(word)))
    width, found = 1, [[np.zeros(0, np.int64)] * 2]
    names = np.empty(len(word), np.int64)
    while len(at):
        if width >= BASE:
            found.append(_starts(word, at, name, width))
        names[:] = -1
        names[at] = name
        follows = at + width < len(word)
        at, name = at[follows], name[follows]
        second = names[at + width]
        known = second >= 0
        at, name = _repeated(name[known] * len(word) + second[known], at[known])
        width *= 2
    both = np.stack([np.concatenate(part) for part in zip(*found)], axis=1)
    return np.unique(both, axis=0) if len(both) else both


def follow(word: list, begin: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period, from the lags that ``begin`` lists by word."""
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    n, k, i = len(word), 0, 0
    while active or k < len(begin):
        if not active:
            i = begin[k][0]
        while k < len(begin) and begin[k][0] == i:
            active[begin[k][1]] = 0
            k += 1
        for lag in list(active):
            if i < n and word[i] == word[i - lag]:
                active[lag] += 1
            else:
                length = active.pop(lag) + lag
                if length >= max(least, 2 * lag):  # a stretch found with several lags has the smallest as its period
                    stretch = i - length, length
                    found[stretch] = min(lag, found.get(stretch, lag))
        i += 1
    return sorted((start, length, lag) for (start, length), lag in found.items())


def periodic_runs(texts: pa.Array) -> pa.Array:
    """``FOUND`` of every text: number of words, runs, and the text without the repetitions of its runs."""
    words, bounds = split_words(texts)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    of_text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    word = of_text * (ids.max(initial=0) + 1) + ids  # equal in one text only
    begin = starts(word)
    cuts = np.searchsorted(begin[:, 0], bounds)
    runs, dropped = [[] for _ in range(len(texts))], np.zeros(len(words) + 1, np.int64)
    for text in np.flatnonzero(np.diff(cuts)):
        a, b = bounds[text], bounds[text + 1]
        here = begin[cuts[text]:cuts[text + 1]] - [a, 0]
        runs[text] = follow(ids[a:b].tolist(), here.tolist())
        for start, length, period in runs[text]:
            dropped[a + start + period] += 1
            dropped[a + start + length] -= 1
    stay = np.cumsum(dropped[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(stay)])[bounds]
    listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(_RUN))
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds), pa.int64()), listed, join_words(words.filter(pa.array(stay)), kept).cast(pa.string())],
                                      names=["n_words", "runs", "collapsed"])


def find_runs(text: Column | str) -> Column:
    """``FOUND`` of a text column.

    A run is a stretch of words with smallest period q, at least ``LEAST_WORDS`` and two periods long, that no word
    beside it extends; ``collapsed`` has the words that no run holds after its first period, joined by one space. Null,
    empty and blank texts have no words, no runs and an empty ``collapsed``. Rows are independent: repeated rows give
    equal results and an empty table none; other columns are not read. Lone words of any length are compared whole.
    """
    @F.arrow_udf(FOUND)
    def found(column: pa.Array) -> pa.Array:
        parts = [periodic_runs(part) for part in slices(column, CHUNK_BYTES)]
        return pa.concat_arrays(parts) if parts else periodic_runs(column)

    return found(text)
