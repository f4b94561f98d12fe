"""Dictionary matching by one automaton over all patterns, run over Arrow batches.

A dictionary within the broadcast bound travels once per executor as a broadcast; every Python
worker builds its Aho-Corasick automaton once and reads each text once, whatever the number of
secrets. Nothing is tested per (event, secret), and the texts are neither copied nor shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail.session import importable

#: Automata that a Python worker keeps.
KEPT = 4
#: Bytes of neighbouring texts that one run of the automaton reads; a longer text is read alone.
RUN_BYTES = 4_000_000


class Matcher:
    """Finds which secrets' patterns occur in texts.

    ``rows`` holds (scope, patterns of the first kind, patterns of the second kind, ...) per secret. A secret is looked
    for in texts of its own scope, or in all texts where scopes are ignored. An empty pattern occurs in every text.
    """

    def __init__(self, rows: list[tuple], any_scope: bool = False):
        self.any_scope = any_scope
        self.kinds = len(rows[0]) - 1 if rows else 0
        owners: dict[str, dict] = {}
        for number, (scope, *kinds) in enumerate(rows):
            for kind, patterns in enumerate(kinds):
                for pattern in {p for p in patterns or () if p is not None}:
                    owners.setdefault(pattern, {}).setdefault(None if any_scope else scope, []).append((number, kind))
        self.everywhere = owners.pop("", {})
        self.patterns = list(owners)
        self.owners = [owners[p] for p in self.patterns]
        self.automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(self.patterns):
            self.automaton.add_word(pattern, k)
        if self.patterns:
            self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        # the owners as a table: (pattern, scope) -> a stretch of (number, kind); the empty pattern comes last
        self.scopes = {s: j for j, s in enumerate({s: 0 for o in [*self.owners, self.everywhere] for s in o})}
        held = [(k * len(self.scopes) + self.scopes[s], *pair) for k, o in enumerate([*self.owners, self.everywhere]) for s in o for pair in o[s]]
        table = np.array(sorted(held), np.int64).reshape(-1, 3)
        self.keys, self.firsts, self.counts = np.unique(table[:, 0], return_index=True, return_counts=True)
        self.numbers, self.of_kind = table[:, 1], table[:, 2]

    def ends(self, text: str) -> Iterable[tuple[int, int]]:
        """(place of the last character, pattern) of every occurrence."""
        return self.automaton.iter(text) if self.patterns else ()

    def masks(self, scope, texts: list[str | None]) -> dict[int, list[int]]:
        """Per secret and kind, the texts that hold one of its patterns, as bits."""
        scope, out = None if self.any_scope else scope, {}
        for lane, text in enumerate(texts):
            if text is None:
                continue
            found = [self.everywhere] if self.everywhere else []
            if text and self.patterns:
                found += [self.owners[k] for k in {k for _, k in self.automaton.iter(text)}]
            for owners in found:
                for number, kind in owners.get(scope, ()):
                    out.setdefault(number, [0] * self.kinds)[kind] |= 1 << lane
        return out


    def _runs(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, pattern) of the occurrences in a column. Neighbouring texts are read as one; what lies across two is left out."""
        column = column.cast(pa.large_string())
        _, places, data = column.buffers()
        at = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(at, at[low] + RUN_BYTES, "right")) - 1)
            if at[high] > at[low]:
                part = memoryview(data)[at[low]:at[high]]
                text, bounds = str(part, "utf-8"), at[low:high + 1] - at[low]
                if len(text) < len(part):  # places in characters
                    heads = (np.frombuffer(part, np.uint8) & 0xC0) != 0x80
                    bounds = np.concatenate([[0], np.cumsum(heads)])[bounds]
                end, k = np.fromiter(chain.from_iterable(self.ends(text)), np.int64).reshape(-1, 2).T
                row = np.searchsorted(bounds, end, "right") - 1
                inside = end - self.lengths[k] + 1 >= bounds[row]
                yield low + row[inside], k[inside]
            low = high

    def batch(self, scopes: pa.Array, columns: list[pa.Array]) -> tuple[np.ndarray, list[np.ndarray]]:
        """``masks`` of many rows: where each row's answers end (from 0), and the answers as columns (number, mask per kind)."""
        known = scopes.dictionary_encode()
        names = known.dictionary.to_pylist()
        codes = np.array([self.scopes.get(None if self.any_scope else s, -1) for s in [*names, None]])
        codes = codes[known.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
        pairs, kinds, bits = [], [], []
        total = int(self.numbers.max()) + 1 if len(self.numbers) else 1
        for lane, column in enumerate(columns):
            there = column.is_valid().to_numpy(zero_copy_only=False)
            found = list(self._runs(column)) if self.patterns else []
            if self.everywhere:
                found.append((np.flatnonzero(there), np.full(int(there.sum()), len(self.patterns))))
            for row, k in found:
                row, k = row[there[row] & (codes[row] >= 0)], k[there[row] & (codes[row] >= 0)]
                wanted = k * len(self.scopes) + codes[row]
                place = np.searchsorted(self.keys, wanted)
                owned = place < len(self.keys)
                owned[owned] = self.keys[place[owned]] == wanted[owned]
                row, place = row[owned], place[owned]
                many = self.counts[place]
                owner = np.repeat(self.firsts[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pairs.append(np.repeat(row, many) * total + self.numbers[owner])
                kinds.append(self.of_kind[owner])
                bits.append(np.full(len(owner), 1 << lane))
        if not pairs:
            return np.zeros(len(scopes) + 1, np.int32), [np.zeros(0, np.int64)] * (1 + self.kinds)
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        out = np.zeros((self.kinds, len(pair)), np.int64)
        np.bitwise_or.at(out, (np.concatenate(kinds), at), np.concatenate(bits))
        return np.searchsorted(pair // total, np.arange(len(scopes) + 1)).astype(np.int32), [pair % total, *out]


def pieces(value: str, size: int) -> list[tuple[str, int]]:
    """Aligned pieces of ``value`` and their places: every stretch of ``size`` characters holds one of them whole."""
    width = (size + 1) // 2
    return [(value[k:k + width], k) for k in range(0, len(value) - width + 1, width)] if size else []


class NearMatcher:
    """Finds values in another letter case and values of which one long stretch, ``share`` of it, is there.

    ``rows`` holds (scope, [value], [value in lower case]) per secret; texts come as they are and in lower case. A long
    stretch holds one of at most three aligned pieces of its value whole: pieces are found by the automaton and
    extended to both sides as far as text and value agree.
    """

    def __init__(self, rows: list[tuple], any_scope: bool = False, share: float = 0.7, least: int = 8):
        self.any_scope, self.values = any_scope, []
        parts = []
        for scope, (value,), _ in rows:
            size = int(len(value or "") * share)
            self.values.append((value, size))
            parts.append((scope, [p for p, _ in pieces(value, size)] if size >= least else []))
        self.exact = Matcher(parts, any_scope)
        self.lower = Matcher([(scope, lowered) for scope, _, lowered in rows], any_scope)

    def masks(self, scope, texts: list[str | None]) -> dict[int, list[int]]:
        """Per secret found: whether its value is there in some letter case, and whether a long stretch of it is."""
        text, lowered = texts
        out = {number: [1, 0] for number in self.lower.masks(scope, [lowered])}
        scope = None if self.any_scope else scope
        for end, k in self.exact.ends(text or ""):
            for number, _ in self.exact.owners[k].get(scope, ()):
                if not (number in out and out[number][1]) and self._long(number, self.exact.patterns[k], text, end):
                    out.setdefault(number, [0, 0])[1] = 1
        return out

    def batch(self, scopes: pa.Array, columns: list[pa.Array]) -> tuple[list[int], list]:
        """``masks`` of many rows, as ``Matcher.batch`` gives them."""
        ends, found = [0], []
        for s, *row in zip(scopes.to_pylist(), *(c.to_pylist() for c in columns)):
            found += [(n, *bits) for n, bits in self.masks(s, row).items()]
            ends.append(len(found))
        return ends, list(zip(*found)) if found else [()] * 3

    def _long(self, number: int, piece: str, text: str, end: int) -> bool:
        value, size = self.values[number]
        for part, at in pieces(value, size):
            if part != piece:
                continue
            left, right, start = at, at + len(part), end + 1 - len(part)
            while left and start and value[left - 1] == text[start - 1]:
                left, start = left - 1, start - 1
            stop = end + 1
            while right < len(value) and stop < len(text) and value[right] == text[stop]:
                right, stop = right + 1, stop + 1
            if right - left >= size:
                return True
        return False


_MATCHERS: dict[str, object] = {}


def worker_cache(key, make):
    """The object ``make`` builds, kept by this Python worker under ``key``; the oldest of more than ``KEPT`` goes."""
    if key not in _MATCHERS:
        while len(_MATCHERS) >= KEPT:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[key] = make()
    return _MATCHERS[key]


def hit_arrays(dictionary: DataFrame, lanes: list[Column], kinds: dict[str, Column], scope: str = "env_type", any_scope: bool = False,
               carry: dict[str, Column] | None = None, finder: type = Matcher, answers: list[str] | None = None) -> tuple[Column, DataFrame]:
    """A text row's hits as an array of (number of the secret, mask per kind), and the numbered secrets with ``carry``."""
    spark = dictionary.sparkSession
    importable(spark)
    carried = F.struct(*[c.alias(n) for n, c in (carry or {}).items()], F.lit(0).alias("_"))
    known = dictionary.select(F.lit(0).cast("long").alias("_n"), carried.alias("_carry"), F.col(scope).alias("_home"), *[c.alias(n) for n, c in kinds.items()])
    rows = known.collect()
    numbered = spark.createDataFrame([(k, r["_carry"]) for k, r in enumerate(rows)], known.select("_n", "_carry").schema)
    sent = spark.sparkContext.broadcast([(r["_home"], *[list(r[n] or ()) for n in kinds]) for r in rows])
    answers = answers or list(kinds)
    key, names = uuid.uuid4().hex, ["n", *answers]

    @F.arrow_udf("array<struct<n: bigint, " + ", ".join(f"`{n}`: bigint" for n in answers) + ">>")
    def hits(scopes: pa.Array, *columns: pa.Array) -> pa.Array:
        m = worker_cache(key, lambda: finder(sent.value, any_scope))
        ends, answered = m.batch(scopes, list(columns))
        numbers = [pa.array(x, pa.int64()) for x in answered]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(numbers, names))

    return hits(F.col(scope), *lanes), numbered


def flat_hits(texts: DataFrame, hits: Column, numbered: DataFrame, carry: list[str], answers: list[str]) -> DataFrame:
    """One row per (text, secret): the columns of ``texts``, what is carried and the masks."""
    whole = [F.col(f"`{c}`") for c in texts.columns]
    flat = texts.select(*whole, F.explode(hits).alias("_hit"))
    joined = flat.join(F.broadcast(numbered), F.col("_hit.n") == F.col("_n"))
    return joined.select(*whole, *[F.col(f"_carry.{n}").alias(n) for n in carry], *[F.col(f"_hit.{n}").alias(n) for n in answers])


def scan(texts: DataFrame, dictionary: DataFrame, lanes: list[Column], kinds: dict[str, Column], scope: str = "env_type",
         any_scope: bool = False, carry: dict[str, Column] | None = None, finder: type = Matcher, answers: list[str] | None = None) -> DataFrame:
    """The columns of ``texts`` with ``carry`` and a mask per kind: one row per (text, secret) with a pattern in a lane.

    ``kinds`` names arrays of patterns of ``dictionary``; bit j of a kind's mask says that one of them occurs in lane j.
    A null lane holds nothing. Names of ``carry`` and ``kinds`` must not be columns of ``texts``. The dictionary must be
    within the broadcast bound (``fits_broadcast``): it is gathered and sent to the workers. Another ``finder`` may give
    other numbers than masks; ``answers`` names them.
    """
    hits, numbered = hit_arrays(dictionary, lanes, kinds, scope, any_scope, carry, finder, answers)
    return flat_hits(texts, hits, numbered, list(carry or {}), answers or list(kinds))
