"""Best-fit packing with linear grouping (operator 11).

Lengths are whole numbers up to the capacity, so everything the packing decides rests on the table
of how many pieces have each length: at most ``capacity`` numbers, however many documents there are.

* Large lengths, in descending order, are dealt into groups of equal cardinality and rounded up to
  the largest of their group. For these few sizes the best mixture of configurations (multisets of
  sizes that fit one sequence) comes from a linear programme: columns are priced by a knapsack over
  the capacity, whole multiples of the configurations are used.
* Actual documents take the places of their group's size: the k-th of a group gets the k-th place.
  Neighbouring sequences of a configuration that get equal lengths form one bundle, so the room that
  is left is known per bundle, without looking at a document.
* What the configurations leave over and the small lengths, longest first, go where they fit best:
  into the bundle with the least room that holds them, then into new sequences.

The result is a list of ranges (length, rank within the length) -> (sequence, offset). Every touch
of a bundle by a length more than halves its room, so there are at most ``log2(capacity)`` ranges a
bundle, some ten thousand in all. Ranks come from counts per (length, bucket), and one task numbers
one bucket of one length; a document finds its place by itself.
"""

from __future__ import annotations

import bisect
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from leaktrail.llm.periodic import slices
from leaktrail.llm.staging import stage
from leaktrail.llm.token_counts import byte_symbols
from leaktrail.session import maybe_broadcast

CAPACITY = 2048
#: Lengths above this share of the capacity are large: they are rounded and enter configurations.
LARGE = 1 / 8
GROUPS = 128
#: Columns the linear programme may price; it stops earlier at the optimum.
COLUMNS = 1500
#: ... or within this share of it.
GAP = 0.004
#: Rows of one length that one task numbers.
BUCKET_ROWS = 100_000
#: Pre-tokens of one generation kept by a Python worker (two are); only memory, never a result, depends on it.
CACHE = 400_000
CACHED_CHARS = 48
CHUNK_BYTES = 12_000_000
PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary>>"
_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class WordEncoder:
    """Ids of texts by a lower-casing BPE file of the ``tokenizers`` library that drops white space.

    No token crosses white space, so every distinct word is encoded once and every distinct pre-token of words is
    merged once, by the library's model. Words outside ``PLAIN`` characters, whose normal form and classes depend on
    tables, and words with added tokens go through the library as they are.
    """

    #: Visible characters of one byte in Latin-1: lower case, letters and digits are the same in every Unicode version.
    PLAIN = "^[\\x{21}-\\x{7e}\\x{a1}-\\x{ff}]+$"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        cut, level = spec["pre_tokenizer"]["pretokenizers"]
        if (normal != ["NFC", "Replace", "Lowercase"] or cut["type"] != "Split" or not cut["invert"] or cut["behavior"] != "Removed"
                or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]):
            raise ValueError("only lower-casing byte-level files that drop white space are understood")
        self.pattern = regex.compile(cut["pattern"]["Regex"] + r"|\n")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.symbol = {byte: symbol for symbol, byte in byte_symbols().items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pre_token(self, token: str) -> bytes:
        """Ids of a pre-token that is not in ``known``; the two generations change places when one is full."""
        ids = self.older.get(token)
        if ids is None:
            spelled = "".join([self.symbol[b] for b in token.encode("utf-8")])
            ids = b"".join([self.packed[t.id] for t in self.model.tokenize(spelled)]) if token != "\n" else b""
        if len(token) <= CACHED_CHARS:
            if len(self.known) >= CACHE:
                self.older = dict(self.known)
                self.known.clear()
            self.known[token] = ids
        return ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids start, how many they are, and all ids."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        for content in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, content))
        flags = plain.to_numpy(zero_copy_only=False)
        tokens = self.pattern.findall("\n".join([*words.filter(plain).to_pylist(), ""]).lower())
        distinct = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
        known = self.known
        packed = [known[t] if t in known else self._pre_token(t) for t in distinct]
        packed_sizes = np.array([len(p) // 4 for p in packed], np.int64)
        which = np.fromiter(map(distinct.__getitem__, tokens), np.int64, len(tokens))
        ids = gather(np.frombuffer(b"".join(packed), "<u4"), (np.cumsum(packed_sizes) - packed_sizes)[which], packed_sizes[which])
        ends = np.cumsum(packed_sizes[which])[which == distinct.get("\n", -1)]
        rest = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        sizes = np.zeros(len(words), np.int64)
        sizes[flags] = np.diff(ends, prepend=0)
        sizes[~flags] = [len(r) for r in rest]
        places = np.zeros(len(words), np.int64)
        places[flags] = ends - sizes[flags]
        places[~flags] = len(ids) + np.cumsum(sizes[~flags]) - sizes[~flags]
        return places, sizes, np.concatenate([ids, *rest])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of every text."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        places, sizes, flat = self.words(coded.dictionary)
        which = coded.indices.to_numpy().astype(np.int64)
        ids = gather(flat, places[which], sizes[which])
        cuts = np.concatenate([[0], np.cumsum(sizes[which])])[bounds - bounds[0]]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def gather(flat: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that start at ``places``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(places - (ends - sizes), sizes)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(text: Column | str, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> Column:
    """``PIECES`` of a text: its ids by the tokenizer at ``path`` and then ``end_id``, cut after every ``capacity`` ids.

    A null or empty text is the one piece ``[end_id]``. ``ids`` (packed, 32 bits) is null unless ``with_ids``. Rows are
    independent, so repeated rows give equal pieces and an empty table none.
    """
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    @F.arrow_udf(PIECES)
    def cut(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(column, CHUNK_BYTES):
            for ids in encoder(path).encode(part):
                ids += end
                cuts = (ids[k:k + width] for k in range(0, len(ids), width))
                out.append([{"piece": k, "start": k * capacity, "length": len(c) // 4, "ids_crc32": zlib.crc32(c), "ids": c if with_ids else None}
                            for k, c in enumerate(cuts)])
        return pa.array(out, pa.list_(_PIECE))

    return cut(text)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``capacity``, as a count per size."""
    pad = int(sizes.max())
    best, taken = np.zeros(pad + capacity + 1), np.full(pad + capacity + 1, -1)
    best[:pad] = -np.inf  # no room below nothing
    back = pad - sizes
    for room in range(int(sizes.min()), capacity + 1):
        worth = best[back + room] + values
        k = int(worth.argmax())
        if worth[k] > best[pad + room - 1]:
            best[pad + room], taken[pad + room] = worth[k], k
        else:
            best[pad + room] = best[pad + room - 1]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        k = taken[pad + room]
        if k < 0:
            room -= 1
        else:
            counts[k] += 1
            room -= int(sizes[k])
    return float(best[-1]), counts


def configurations(sizes: list[int], wanted: list[int], capacity: int, columns: int = COLUMNS,
                   gap: float = GAP) -> list[tuple[list[int], int]]:
    """(count per size, how many sequences) that hold at most ``wanted`` of each size: a linear programme's optimum, rounded down."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(wanted, float)
    for _ in range(columns):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, counts = knapsack(np.array(sizes), duals, capacity)
        if value <= 1 + gap:  # no mixture needs fewer than the present number of sequences / value
            break
        amounts, enters = np.linalg.solve(basis, need), np.linalg.solve(basis, counts)
        ratio = np.where(enters > 1e-9, np.maximum(amounts, 0) / np.where(enters > 1e-9, enters, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = counts
    amounts = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(np.int64)
    left, out = np.array(wanted), []
    for column, amount in zip(basis.T.astype(np.int64), amounts):
        used = column > 0
        amount = min([max(int(amount), 0), *(left[used] // column[used])])
        if amount:
            left -= column * amount
            out.append((column.tolist(), int(amount)))
    return out


class Plan:
    """Where every (length, rank) goes, from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS):
        self.capacity, self.ranges, self.sequences = capacity, [], 0
        self.bundles: list[list[int]] = []  # [room, first sequence, number of sequences], ordered by room
        left = dict(counts)
        big = sorted((s for s in counts if s > capacity * large and counts[s]), reverse=True)
        if big:
            self._configure(big, counts, left, groups)
        self.bundles.sort()
        for length in sorted(left, reverse=True):
            self._fit(length, counts[length] - left[length], left[length])
        self.ranges.sort()

    def _configure(self, big: list[int], counts: dict[int, int], left: dict[int, int], groups: int) -> None:
        total = sum(counts[s] for s in big)
        ends, sizes, wanted = [], [], []  # of the groups, over all large pieces in descending order
        bounds, classes, at = [total * (g + 1) // groups for g in range(groups)], [], 0
        for s in big:
            classes.append((at, s))
            at += counts[s]
        starts = [c[0] for c in classes]
        before = 0
        for end in bounds:
            if end == before:
                continue
            size = classes[bisect.bisect_right(starts, before) - 1][1]
            if sizes and sizes[-1] == size:
                ends[-1], wanted[-1] = end, wanted[-1] + end - before
            else:
                ends.append(end)
                sizes.append(size)
                wanted.append(end - before)
            before = end
        cursor = [e - w for e, w in zip(ends, wanted)]
        for column, amount in configurations(sizes, wanted, self.capacity):
            places = []  # [next piece, its group's size] of every place of this configuration
            for g, n in enumerate(column):
                for _ in range(n):
                    places.append(cursor[g])
                    cursor[g] += amount
            while amount:
                here = [bisect.bisect_right(starts, p) - 1 for p in places]
                run = min([amount, *(classes[c][0] + counts[classes[c][1]] - p for c, p in zip(here, places))])
                offset = 0
                for c, p in zip(here, places):
                    first, length = classes[c]
                    self.ranges.append((length, p - first, 1, self.sequences, offset))
                    offset += length
                self.bundles.append([self.capacity - offset, self.sequences, run])
                self.sequences += run
                amount -= run
                places = [p + run for p in places]
        # a length's pieces that got no place: renumbered behind those that did
        taken: dict[int, list[tuple[int, int]]] = {}
        for g, (end, n) in enumerate(zip(ends, wanted)):
            p = cursor[g]
            while p < end:
                c = bisect.bisect_right(starts, p) - 1
                stop = min(end, classes[c][0] + counts[classes[c][1]])
                taken.setdefault(classes[c][1], []).append((p - classes[c][0], stop - classes[c][0]))
                p = stop
        self.gaps = taken
        for s in big:
            left[s] = sum(b - a for a, b in taken.get(s, []))

    def _fit(self, length: int, done: int, count: int) -> None:
        """Best fit of the ``count`` pieces of ``length`` that have no place yet."""
        for first, last in getattr(self, "gaps", {}).get(length, [(done, done + count)] if count else []):
            self._fit_range(length, first, last)

    def _fit_range(self, length: int, first: int, last: int) -> None:
        while first < last:
            k = bisect.bisect_left(self.bundles, [length])
            if k < len(self.bundles):
                room, sequence, bins = self.bundles.pop(k)
            else:
                room, sequence = self.capacity, self.sequences
                bins = -(-(last - first) // (room // length))
                self.sequences += bins
            each = room // length
            full = min(bins, (last - first) // each)
            if full:
                self.ranges.append((length, first, each, sequence, self.capacity - room))
                bisect.insort(self.bundles, [room - each * length, sequence, full])
                first += full * each
            if full < bins:
                rest = last - first  # fewer than one sequence takes; none, or the last one's
                if rest:
                    self.ranges.append((length, first, each, sequence + full, self.capacity - room))
                    bisect.insort(self.bundles, [room - rest * length, sequence + full, 1])
                    first, full = last, full + 1
                if full < bins:
                    bisect.insort(self.bundles, [room, sequence + full, bins - full])

    def place(self, length: Column, rank: Column) -> Column:
        """struct(sequence_id, offset) of the piece that is the ``rank``-th of its length."""
        table = np.array(self.ranges, np.int64).reshape(-1, 5)
        keys = table[:, 0] << 44 | table[:, 1]

        @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
        def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
            n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, n << 44 | r, side="right") - 1]
            beyond = r - row[:, 1]
            return pa.StructArray.from_arrays([pa.array(row[:, 3] + beyond // row[:, 2]), pa.array(row[:, 4] + beyond % row[:, 2] * n)],
                                              names=["sequence_id", "offset"])

        return placed(length, rank)


def pack(lengths: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: list[str] | None = None,
         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``struct(record, sequence_id, offset)`` rows: every row of ``lengths`` with the sequence and the place that hold it.

    ``record`` is the input row, so its columns may have any names. Lengths from 1 to ``capacity`` are packed; a row with
    another length or none raises, since it fits no sequence. Rows of one length are numbered by ``order`` (default: all
    columns) within buckets of about ``bucket_rows``; equal rows are interchangeable. An empty table gives no rows. The
    input is read three times, so it should be a written table.
    """
    rows = lengths.select(F.struct("*").alias("record"))
    size = F.col("record").getField(length_col).cast("long")
    checked = F.when((size >= 1) & (size <= capacity), size).otherwise(F.raise_error(F.lit("a length is null or does not fit a sequence")).cast("long"))
    counts = {r.n: r["count"] for r in rows.select(checked.alias("n")).groupBy("n").count().collect()}  # at most ``capacity`` rows
    plan = Plan(counts, capacity)
    by = [F.col("record").getField(c) for c in (order or lengths.columns)]
    buckets = max(1, math.ceil(max(counts.values(), default=0) / bucket_rows))
    dealt = rows.select("record", size.alias("_n"), F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket"))
    ahead = W.partitionBy("_n").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("_n", "_bucket").count().select("_n", "_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy("_n", "_bucket").orderBy(*by)) - 1
    ranked = dealt.withColumn("_within", within).join(maybe_broadcast(offsets), ["_n", "_bucket"])
    placed = ranked.select("record", plan.place(F.col("_n"), F.col("_first") + F.col("_within")).alias("_at"))
    return placed.select("record", "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32, sequence_id, offset): a row per piece of every document.

    Every text becomes its ids and ``end_id`` (null and empty: ``end_id`` alone); only documents longer than ``capacity``
    are cut. Repeated rows are packed each by itself, null ids are kept, and other columns are not read.
    """
    cut = docs.select(F.col(id_col).alias("id"), F.explode(pieces(F.col(text_col), path, capacity, end_id)).alias("p"))
    table, _ = stage(cut.select("id", "p.piece", "p.start", "p.length", "p.ids_crc32"), "pieces")
    packed = pack(table, capacity)
    return packed.select(F.col("record.id").alias(id_col), *[f"record.{c}" for c in ("piece", "start", "length", "ids_crc32")], "sequence_id", "offset")
