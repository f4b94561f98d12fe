"""Repeated byte strings by the interval tree of an enhanced suffix array (operator 7).

A suffix array of the whole corpus is never needed: only suffixes that share their first
200 bytes with another lie in an interval of common prefix 200 or more. They are found in
two steps. First, every window of 200 bytes is named by its smallest hashed 64-byte string;
neighbouring windows of one name form a stretch of at most 336 bytes, and equal windows
are in stretches of equal name wherever they occur. Names found once are dropped; where all
stretches of a name are equal, all of them are repeats. Second, the different stretches of
one name meet in one route, which sorts the suffixes in its buckets of equal 200-byte
prefix, computes common prefixes and scans them with a stack: every interval whose suffixes
have different left neighbours is a maximal repeat, with all its occurrences. A name with
very many different stretches is dealt out by window instead of in one piece.

Names come from a rolling hash, which structured strings can bring to collide: that only
makes two names one. Whether bytes are equal is decided by the bytes themselves where they
meet in a route, and by name and a seeded XXH3 hash of the bytes where they stay apart.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail.llm.blocks import (Windows, by_block_rows, byte_values, cover, cut_by_route, deal, found_in, joined, mix, packed,
                                  routes_for, spans_of)

LENGTH = 200
#: Bytes of text per block; a block holds some twenty arrays of eight bytes per byte.
BLOCK_BYTES = 800_000
ROUTE_HASHES = 250_000
#: Bytes of the strings whose smallest hash names a window.
NAME = 64
#: A name with more different stretches than this is dealt out by window.
HOT_STRETCHES = 500
_PLACE = np.uint64(28)  # low bits that hold a position while the smallest hash is sought
_SEED = 42
_BACK, _STRETCH, _WINDOW = 0, 1, 2
_REPEATED, _SHIP, _DEAL = 1, 2, 4


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0), np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every [start, end)."""
    view = memoryview(data)
    found = (xxhash.xxh3_64_intdigest(view[a:b], _SEED) for a, b in zip(start.tolist(), end.tolist()))
    return np.fromiter(found, np.uint64, len(start))


def equal_keys(data: np.ndarray, start: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """``keys``, or where they are equal for different strings of ``length`` bytes, others that are not."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    first = start[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    for k in range(0, len(order), 20_000):
        part = slice(k, k + 20_000)
        if (strings[start[order[part]]] != strings[first[part]]).any():
            whole = np.ascontiguousarray(strings[start]).view(f"V{length}").ravel()
            return np.unique(whole, return_inverse=True)[1].astype(np.uint64)
    return keys


class Stretches:
    """The stretches of a block of texts: start, end, name, and a hash of name and content."""

    def __init__(self, texts: list[str | None], length: int, name: int):
        self.parts = [(t or "").encode("utf-8") for t in texts]
        self.data = np.frombuffer(b"".join(self.parts), np.uint8)
        self.offsets = np.cumsum([0] + [len(p) for p in self.parts])
        self.windows = Windows(byte_values(self.data))
        pieces = []
        for part, at in zip(self.parts, self.offsets[:-1]):
            if len(part) >= length:
                pieces.append(np.arange(at, at + len(part) - length + 1))
        starts = self.starts = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        self.start = self.end = np.zeros(0, np.int64)
        self.name = self.content = np.zeros(0, np.uint64)
        if not len(starts):
            return
        hashes = self.windows.every(name)
        place = np.arange(len(hashes), dtype=np.uint64)
        low = (np.uint64(1) << _PLACE) - np.uint64(1)
        if len(hashes) > int(low):
            raise ValueError("a block holds at most 256 MB")
        smallest = sliding_min(hashes >> _PLACE << _PLACE | place, length - name + 1)[starts] & low
        new = np.r_[True, (smallest[1:] != smallest[:-1]) | (np.diff(starts) != 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(starts)] - 1
        self.start, self.end = starts[first], starts[last] + length
        self.name = hashes[smallest[first].astype(np.int64)]
        self.content = mix(digests(self.data, self.start, self.end) ^ mix(self.name))

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.start[k]:self.end[k]].tobytes()


def _send_names(rows: pd.DataFrame, bits: int, length: int, name: int) -> pd.DataFrame:
    s = Stretches(rows["_text"].tolist(), length, name)
    order = np.lexsort((s.content, s.name))
    names, contents = s.name[order], s.content[order]
    first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (contents[1:] != contents[:-1])]) if len(order) else order
    twice = np.diff(np.r_[first, len(names)]) > 1
    names, contents, block = names[first], contents[first], int(rows["_blk"].iloc[0])
    return packed([(route, block, names[p].tobytes(), contents[p].tobytes(), twice[p].tobytes()) for route, p in cut_by_route(names, bits)],
                  ["route", "_blk", "names", "contents", "twice"])


def _answer_names(rows: pd.DataFrame, hot: int) -> pd.DataFrame:
    """To every block, the contents of its stretches that are repeats, and those it must ship for others to be judged."""
    names, contents, twice = joined(rows["names"], "<u8"), joined(rows["contents"], "<u8"), joined(rows["twice"], "?")
    block = np.repeat(rows["_blk"].to_numpy(), rows["names"].map(len).to_numpy() // 8)
    order = np.lexsort((block, contents, names))
    names, contents, twice, block = names[order], contents[order], twice[order], block[order]
    new_name = np.r_[True, names[1:] != names[:-1]]
    new_class = new_name | np.r_[True, contents[1:] != contents[:-1]]
    group, cls = np.cumsum(new_name) - 1, np.cumsum(new_class) - 1
    repeated = (np.bincount(cls) > 1) | (np.bincount(cls, twice) > 0)
    classes = np.bincount(group[new_class])
    code = np.where(repeated[cls], _REPEATED, 0).astype(np.uint8)
    code[new_class & (classes[group] > 1)] |= _SHIP
    code[new_class & (classes[group] > hot)] |= _DEAL
    take = code > 0
    contents, code, block = contents[take], code[take], block[take]
    return by_block_rows(block, lambda k: (contents[k].tobytes(), code[k].tobytes()), ["_blk", "contents", "codes"])


_SENT = ["route", "_blk", "kind", "keys", "contents", "sizes", "body"]


def _send_stretches(rows: pd.DataFrame, answers: pd.DataFrame, bits: int, length: int, name: int) -> pd.DataFrame:
    """Repeats go back to their block; stretches to judge go to the route of their name, or window by window."""
    contents, codes = joined(answers["contents"], "<u8"), joined(answers["codes"], "u1")
    if not len(contents):
        return packed([], _SENT)
    order = np.argsort(contents, kind="stable")
    contents, codes = contents[order], codes[order]
    block, out = int(rows["_blk"].iloc[0]), []
    back = contents[codes & _REPEATED > 0]
    if len(back):
        out.append((-1 - block, block, _BACK, b"", back.tobytes(), b"", b""))
    s = Stretches(rows["_text"].tolist(), length, name)
    hit, at = found_in(contents, s.content)
    code = np.where(hit, codes[at], 0) if len(at) else np.zeros(0, np.uint8)
    ship = np.flatnonzero(code & _SHIP)
    _, one = np.unique(s.content[ship], return_index=True)
    ship = ship[one]  # a block's equal stretches are one class
    whole = ship[code[ship] & _DEAL == 0]
    whole = whole[np.argsort(s.name[whole], kind="stable")]
    for route, p in cut_by_route(s.name[whole], bits):
        part = whole[p]
        out.append((route, block, _STRETCH, s.name[part].tobytes(), s.content[part].tobytes(), (s.end - s.start)[part].astype("<u4").tobytes(),
                    b"".join(map(s.bytes_of, part))))
    dealt = ship[code[ship] & _DEAL > 0]
    if len(dealt):
        n = (s.end - s.start)[dealt] - length + 1
        start = np.repeat(s.start[dealt], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = s.windows.at(start, start + length)
        exact, one, n = np.unique(digests(s.data, start, start + length), return_index=True, return_counts=True)  # each window once per block
        for route, p in cut_by_route(exact, bits):
            out.append((route, block, _WINDOW, keys[one[p]].tobytes(), (n[p] > 1).tobytes(), b"", exact[p].tobytes()))
    return packed(out, _SENT)


class Repeats(NamedTuple):
    """Maximal repeats: ``length[k]`` bytes at the sorted suffixes ``first[k]`` to ``last[k]`` - 1, each a place (piece, offset)."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    piece: np.ndarray
    offset: np.ndarray

    def groups(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """Every repeat with all its occurrences."""
        return [(int(n), list(zip(self.piece[a:b].tolist(), self.offset[a:b].tolist()))) for n, a, b in zip(self.length, self.first, self.last)]

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, low, high): the places as merged ranges. Of the intervals around a suffix the innermost is the longest."""
        longest = np.zeros(len(self.piece), np.int64)
        for k in np.argsort(self.length, kind="stable"):
            longest[self.first[k]:self.last[k]] = self.length[k]
        at = np.flatnonzero(longest)
        at = at[np.lexsort((self.offset[at], self.piece[at]))]
        piece, low = self.piece[at], self.offset[at]
        high = low + longest[at]
        if not len(at):
            return piece, low, high
        room = int(high.max()) + 1
        upto = np.maximum.accumulate(piece * room + high)
        new = np.r_[True, piece[1:] * room + low[1:] > upto[:-1]]
        ends = np.r_[np.flatnonzero(new)[1:], len(at)] - 1
        return piece[new], low[new], upto[ends] - piece[ends] * room


def maximal_repeats(pieces: list[bytes], length: int = LENGTH) -> Repeats:
    """Maximal repeats of at least ``length`` bytes in ``pieces``.

    Suffixes are taken up where their first ``length`` bytes occur twice. A repeat is maximal if longer ones have fewer
    occurrences and the bytes before its occurrences differ; the start of a piece differs from everything.
    """
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    n = np.maximum(sizes - length + 1, 0)
    if not n.sum():
        return Repeats(none, none, none, none, none)
    piece = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (ends - sizes)[piece] + offset
    keys = Windows(byte_values(data)).at(start, start + length)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    take = order[np.r_[same, False] | np.r_[False, same]]
    if not len(take):
        return Repeats(none, none, none, none, none)
    piece, offset, start = piece[take], offset[take], start[take]
    keys = equal_keys(data, start, keys[take], length)
    rest = ends[piece] - start - length
    width = -(-int(rest.max()) // 8) if rest.max() else 0
    padded = np.r_[data, np.zeros(length + 8 * width + 8, np.uint8)]
    words = np.zeros((width, len(start)), np.uint64)
    for k in range(8 * width):
        byte = np.where(k < rest, padded[start + length + k], 0).astype(np.uint64)
        words[k // 8] |= byte << np.uint64(8 * (7 - k % 8))
    order = np.lexsort((rest, *words[::-1], keys))
    keys, piece, offset, start, rest, words = keys[order], piece[order], offset[order], start[order], rest[order], words[:, order]
    left = np.where(offset > 0, padded[start - 1].astype(np.int64), -1 - np.arange(len(start)))
    differ = words[:, 1:] != words[:, :-1]
    word = np.where(differ.any(axis=0), differ.argmax(axis=0), width) if width else np.zeros(len(start) - 1, np.int64)
    common = 8 * word
    if width:
        at = np.minimum(word, width - 1)
        x = words[at, np.arange(len(at))] ^ words[at, np.arange(1, len(at) + 1)]
        common = common + np.where(word < width, (64 - _bit_length(x)) // 8, 0)
    common = np.minimum(np.minimum(common, rest[1:]), rest[:-1])
    lcp = np.where(keys[1:] == keys[:-1], length + common, 0)
    found = np.array(_intervals(lcp.tolist(), left.tolist()), np.int64).reshape(-1, 3)
    return Repeats(found[:, 0], found[:, 1], found[:, 2], piece, offset)


def _bit_length(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(shift)
    return np.bitwise_count(x).astype(np.int64)


def _intervals(lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(length, from, to) of the left-diverse intervals, in one scan with a stack of open intervals.

    ``lcp[k]`` is the common prefix of suffixes k and k + 1. An open interval knows the single left byte of its
    suffixes, or None once they differ.
    """
    out, stack = [], []  # of [length, from, left byte or None]
    for k, size in enumerate([*lcp, 0]):
        begin, byte = k, left[k]
        while stack and stack[-1][0] > size:
            length, begin, seen = stack.pop()
            seen = seen if seen == byte else None
            if seen is None:
                out.append((length, begin, k + 1))
            byte = seen
        if size:
            if stack and stack[-1][0] == size:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            else:
                stack.append([size, begin, byte])
    return out


def _answer_stretches(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """To every block: contents with the ranges of them that are repeats (0 to 0: all of it), and windows that are."""
    columns, out = ["_blk", "kind", "contents", "lows", "highs"], []
    for block, contents in rows.loc[rows["kind"] == _BACK, ["_blk", "contents"]].itertuples(index=False):
        empty = bytes(len(contents) // 2)
        out.append((int(block), _STRETCH, contents, empty, empty))
    shipped = rows[rows["kind"] == _STRETCH].sort_values("_blk")
    if len(shipped):
        contents = joined(shipped["contents"], "<u8")
        block = np.repeat(shipped["_blk"].to_numpy(), shipped["contents"].map(len).to_numpy() // 8)
        sizes = joined(shipped["sizes"], "<u4").astype(np.int64)
        body, ends = b"".join(shipped["body"]), np.cumsum(sizes)
        pieces = [body[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
        which, low, high = maximal_repeats(pieces, length).ranges()
        where, which = block[which], contents[which]
        out += by_block_rows(where, lambda k: (_STRETCH, which[k].tobytes(), low[k].astype("<u4").tobytes(), high[k].astype("<u4").tobytes()),
                         columns).itertuples(index=False, name=None)
    dealt = rows[rows["kind"] == _WINDOW]
    if len(dealt):
        keys, exact, twice = joined(dealt["keys"], "<u8"), joined(dealt["body"], "<u8"), joined(dealt["contents"], "?")
        block = np.repeat(dealt["_blk"].to_numpy(), dealt["keys"].map(len).to_numpy() // 8)
        order = np.lexsort((keys, exact))
        keys, exact, twice, block = keys[order], exact[order], twice[order], block[order]
        same = (exact[1:] == exact[:-1]) & (keys[1:] == keys[:-1])
        take = twice | np.r_[same, False] | np.r_[False, same]
        keys, exact, block = keys[take], exact[take], block[take]
        out += by_block_rows(block, lambda k: (_WINDOW, keys[k].tobytes(), exact[k].tobytes(), b""), columns).itertuples(index=False, name=None)
    return packed(out, columns)


def _remove(rows: pd.DataFrame, answers: pd.DataFrame, length: int, name: int, as_text: bool) -> pd.DataFrame:
    s = Stretches(rows["_text"].tolist(), length, name)
    windows = answers[answers["kind"] == _WINDOW]
    repeated, exact = np.sort(joined(windows["contents"], "<u8")), np.sort(joined(windows["lows"], "<u8"))
    answers = answers[answers["kind"] == _STRETCH]
    contents, low, high = joined(answers["contents"], "<u8"), joined(answers["lows"], "<u4").astype(np.int64), joined(answers["highs"], "<u4").astype(np.int64)
    order = np.argsort(s.content, kind="stable")
    a, b = np.searchsorted(s.content[order], contents, "left"), np.searchsorted(s.content[order], contents, "right")
    n = b - a  # occurrences in this block of each answered stretch
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    at = order[k]
    low, high = np.repeat(low, n), np.repeat(high, n)
    start, end = s.start[at] + low, np.where(high == 0, s.end[at], s.start[at] + high)
    if len(repeated):
        windows = s.starts[found_in(repeated, s.windows.at(s.starts, s.starts + length))[0]]
        windows = windows[found_in(exact, digests(s.data, windows, windows + length))[0]]
        start, end = np.r_[start, windows], np.r_[end, windows + length]
    gone = cover(len(s.data), start, end)
    out = []
    for part, x, y in zip(s.parts, s.offsets[:-1], s.offsets[1:]):
        mask = gone[x:y]
        if mask.any():
            from_, to = spans_of(mask)
            out.append((len(part), [{"start": int(f), "end": int(t)} for f, t in zip(from_, to)], s.data[x:y][~mask].tobytes()))
        else:
            out.append((len(part), [], part))
    done = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
    if as_text:
        done["kept"] = [b.decode("utf-8", "ignore") for b in done["kept"]]
    done.insert(0, "_id", rows["_id"].array)
    return done


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, name: int = NAME,
                   hot: int = HOT_STRETCHES, block_bytes: int = BLOCK_BYTES, route_hashes: int = ROUTE_HASHES, as_text: bool = False) -> DataFrame:
    """(``id_col``, n_bytes, spans, kept): per row of ``docs`` the removed runs of bytes and the bytes left.

    With ``as_text``, ``kept`` is a string: the characters left, without those that a removed run cut.

    A byte goes if it lies in a string of ``length`` bytes that also starts at another place, in the same row or another;
    all occurrences go, and strings are judged on the input. Null and empty texts have no bytes and no spans. A repeated
    row is another place, so its text repeats. Ids are only carried along; other columns are not read. An empty table
    gives no rows. Strings that do not meet in a route are compared by the 64-bit hashes of their name and of their bytes.
    """
    dealt, total = deal(docs, id_col, text_col, block_bytes)
    bits = routes_for(2 * total / (length - name + 2), route_hashes)
    by_block, id_type = dealt.groupBy("_blk"), dict(docs.dtypes)[id_col]
    names = by_block.applyInPandas(lambda rows: _send_names(rows, bits, length, name), "route long, _blk int, names binary, contents binary, twice binary")
    judged = names.groupBy("route").applyInPandas(lambda rows: _answer_names(rows, hot), "_blk int, contents binary, codes binary")
    sent = by_block.cogroup(judged.groupBy("_blk")).applyInPandas(
        lambda rows, answers: _send_stretches(rows, answers, bits + 5, length, name),
        "route long, _blk int, kind int, keys binary, contents binary, sizes binary, body binary")
    ranges = sent.groupBy("route").applyInPandas(lambda rows: _answer_stretches(rows, length), "_blk int, kind int, contents binary, lows binary, highs binary")
    return by_block.cogroup(ranges.groupBy("_blk")).applyInPandas(
        lambda rows, answers: _remove(rows, answers, length, name, as_text),
        f"_id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}").withColumnRenamed("_id", id_col)


def n_removed(spans: Column | str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
