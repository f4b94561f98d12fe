"""Token counts by rank-synchronous merging of ragged arrays (operator 2).

A batch of pre-tokens is one flat array of symbols with the sequence each belongs to. In
every round the lowest rank of each sequence is found at once, all its occurrences merge
(left to right where they overlap) and the sequences without a further merge leave the
batch; the symbols left are the tokens. A merged pair always ranks above the merge that
made its parts, so merging all occurrences of the lowest rank together gives the same
symbols as merging one at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts of distinct pre-tokens kept by a Python worker; only memory, never a result, depends on it.
CACHE = 700_000
#: Longer pre-tokens are counted but not kept.
CACHED_CHARS = 48
#: Characters of text whose pre-tokens are merged together.
CHUNK = 1_000_000
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTable:
    """Vocabulary and merges of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are understood")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not understood")
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int32)
        for symbol, byte in byte_symbols().items():
            self.of_byte[byte] = vocab[symbol]
        keys, merged = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] << 32 | vocab[b])
            merged.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks, self.merged = order.astype(np.int32), np.array(merged, np.int32)
        self.pattern = regex.compile(pattern)
        added = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = regex.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        self.cache: dict[str, int] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all sequences, flat, and their number in each (none for an empty one)."""
        n = np.array([len(s) for s in sequences], np.int64)
        counts, done = n.copy(), []
        sym = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        seq = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rank = np.full(len(sym), _NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[1:] == seq[:-1], self.rank_of(sym[:-1], sym[1:]), _NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(seq)])
            low = np.minimum.reduceat(rank, starts)
            over = low == _NONE
            if over.any():
                counts[seq[starts[over]]] = lengths[over]
                leave = np.repeat(over, lengths)
                done.append((seq[leave], sym[leave]))
                sym, seq, rank = sym[~leave], seq[~leave], rank[~leave]
                low, lengths = low[~over], lengths[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]  # a run of hits is one repeated symbol: every other one merges
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            at = np.cumsum(keep)[at] - 1
            for left in (at, at[at > 0] - 1):
                inner = left[left < len(sym) - 1]
                same = seq[inner] == seq[inner + 1]
                rank[inner] = np.where(same, self.rank_of(sym[inner], sym[inner + 1]), _NONE)
                rank[left[left == len(sym) - 1]] = _NONE
        if not done:
            return sym, counts
        where, what = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return what[np.argsort(where, kind="stable")], counts

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of every text; an added token inside a text is one token, as the library has it."""
        pieces, ones = [], []
        for text in texts:
            parts = [text or ""]
            if self.added is not None and text and (found := len(self.added.findall(text))):
                parts = self.added.split(text)
                ones.append(found)
            else:
                ones.append(0)
            pieces.append([t for part in parts for t in self.pattern.findall(part)])
        if len(self.cache) > CACHE:
            self.cache.clear()
        known = self.cache
        new = list({t for p in pieces for t in p if t not in known})
        here = dict(zip(new, self.merge([t.encode("utf-8") for t in new])[1].tolist())) if new else {}
        known.update((t, k) for t, k in here.items() if len(t) <= CACHED_CHARS)
        long = {t: k for t, k in here.items() if len(t) > CACHED_CHARS}
        get = (lambda t: long[t] if t in long else known[t]) if long else known.__getitem__
        return [one + sum(map(get, p)) for one, p in zip(ones, pieces)]


_TABLES: dict[tuple[str, str], MergeTable] = {}


def merge_table(path: str, pattern: str) -> MergeTable:
    if (path, pattern) not in _TABLES:
        _TABLES[path, pattern] = MergeTable(path, pattern)
    return _TABLES[path, pattern]


def chunks(texts: list, chars: int = CHUNK):
    """Consecutive runs of ``texts`` of about ``chars`` characters; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_count(text: Column | str, path: str, pattern: str) -> Column:
    """Number of tokens of ``text`` by the vocabulary file at ``path``.

    Null and empty texts have 0 tokens. Rows are independent: repeated rows give equal counts, an empty table none.
    """
    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        table = merge_table(path, pattern)
        return pa.array([k for part in chunks(column.to_pylist()) for k in table.count(part)], pa.int64())

    return counted(text)
