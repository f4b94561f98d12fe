"""Removal of word sequences that an earlier document has, by difference-cover anchors (operator 10).

{0, 1, 3} modulo 7 is a difference cover: whatever two positions two equal sequences start
at, some shift below 7 brings both onto cover positions. A window of 13 words therefore
shares with every copy an anchor of 7 words that starts at a cover position in both. Only
those anchors are hashed and exchanged first; windows that hold an anchor found in more
than one place are then extended to all 13 words, and these are exchanged in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from leaktrail.llm.blocks import BLOCK_BYTES, ROUTE_HASHES, Windows, by_block_rows, cover, cut_by_route, deal, found_in, joined, packed, routes_for
from leaktrail.llm.periodic import split_words

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
SEED = 42
#: Bits of an anchor's hash that are exchanged; the last of six bytes tells whether the block has it twice.
_ANCHOR_BITS = 47


class BlockWords:
    """The words of a block of texts: their hashes and the document of each."""

    def __init__(self, texts: list[str | None]):
        self.parts = [(t or "").encode("utf-8") for t in texts]
        words, self.first = split_words(pa.array(texts, pa.string()))  # the first word of each document, and the end
        coded = words.dictionary_encode()
        distinct = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
        hashes = distinct[coded.indices.to_numpy()]
        self.doc = np.repeat(np.arange(len(self.parts)), np.diff(self.first))
        self.place = np.arange(len(hashes)) - self.first[self.doc]
        self.windows = Windows(hashes)

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``length`` words, and whether it lies in one document."""
        h = self.windows.every(length)
        return h, self.doc[:len(h)] == self.doc[length - 1:length - 1 + len(h)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors and their shortened hashes."""
        h, whole = self.hashes(PERIOD)
        at = np.flatnonzero(whole & np.isin(self.place[:len(h)] % PERIOD, COVER))
        return at, h[at] >> np.uint64(64 - _ANCHOR_BITS)


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _send_anchors(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    keys, n = np.unique(BlockWords(rows["_text"].tolist()).anchors()[1], return_counts=True)
    block, packed_keys = int(rows["_blk"].iloc[0]), keys << np.uint64(1) | (n > 1)
    return packed([(route, block, _six(packed_keys[part])) for route, part in cut_by_route(keys << np.uint64(64 - _ANCHOR_BITS), bits)],
                  ["route", "_blk", "keys"])


def _answer_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """To every block, those of its anchors that occur more than once anywhere."""
    both = _from_six(b"".join(rows["keys"]))
    keys, twice = both >> np.uint64(1), (both & np.uint64(1)).astype(bool)
    block = np.repeat(rows["_blk"].to_numpy(), rows["keys"].map(len).to_numpy() // 6)
    order = np.argsort(keys, kind="stable")
    keys, twice, block = keys[order], twice[order], block[order]
    again = keys[1:] == keys[:-1]
    shared = twice | np.r_[again, False] | np.r_[False, again]
    return by_block_rows(block[shared], lambda k: (_six(keys[shared][k]),), ["_blk", "keys"])


def _send_windows(rows: pd.DataFrame, answers: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Extend: every 13-word window that holds a shared anchor, with the smallest and largest id that has it."""
    columns = ["route", "_blk", "keys", "low", "high"]
    shared = np.sort(_from_six(b"".join(answers["keys"])))
    rows = rows[rows["_id"].notna()]
    if not len(shared) or rows.empty:
        return packed([], columns)
    words, ids = BlockWords(rows["_text"].tolist()), rows["_id"].to_numpy(np.int64)
    at, anchors = words.anchors()
    marked = np.zeros(len(words.doc) + 1, np.int64)
    marked[at[found_in(shared, anchors)[0]] + 1] = 1
    marked = np.cumsum(marked)
    h, whole = words.hashes(WINDOW)
    reach = np.minimum(np.arange(len(h)) + WINDOW - PERIOD + 1, len(words.doc))
    take = np.flatnonzero(whole & (marked[reach] > marked[:len(h)]))
    keys, owner = h[take], ids[words.doc[take]]
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return packed([], columns)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], len(keys)] - 1
    keys, low, high = keys[first], owner[first], owner[last]
    block = int(rows["_blk"].iloc[0])
    return packed([(route, block, keys[p].tobytes(), low[p].tobytes(), high[p].tobytes()) for route, p in cut_by_route(keys, bits)], columns)


def _answer_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """To every block, the windows some document of it has after another document, with the smallest id that has them."""
    keys, low, high = joined(rows["keys"], "<u8"), joined(rows["low"], "<i8"), joined(rows["high"], "<i8")
    block = np.repeat(rows["_blk"].to_numpy(), rows["keys"].map(len).to_numpy() // 8)
    order = np.lexsort((low, keys))
    keys, low, high, block = keys[order], low[order], high[order], block[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    least = np.repeat(low[first], np.diff(np.r_[first, len(keys)]))
    take = least < high
    keys, least, block = keys[take], least[take], block[take]
    return by_block_rows(block, lambda k: (keys[k].tobytes(), least[k].tobytes()), ["_blk", "keys", "low"])


def _remove(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    keys, low = joined(answers["keys"], "<u8"), joined(answers["low"], "<i8")
    order = np.argsort(keys)
    keys, low = keys[order], low[order]
    words = BlockWords(rows["_text"].tolist())
    known = rows["_id"].notna().to_numpy()
    ids = np.where(known, rows["_id"].fillna(0), 0).astype(np.int64)
    h, whole = words.hashes(WINDOW)
    hit, at = found_in(keys, h)
    hit &= whole
    if len(keys):
        owner = words.doc[:len(h)]
        hit &= known[owner] & (low[at] < ids[owner])
    start = np.flatnonzero(hit)
    gone = cover(len(words.doc), start, start + WINDOW)
    out = []
    for k, part in enumerate(words.parts):
        mask = gone[words.first[k]:words.first[k + 1]]
        mine, removed = part.split(), int(mask.sum())
        kept = [w for w, g in zip(mine, mask.tolist()) if not g] if removed else mine
        out.append((len(mine), removed, b" ".join(kept).decode("utf-8")))
    done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])
    done.insert(0, "_id", rows["_id"].array)
    return done


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                   route_hashes: int = ROUTE_HASHES) -> DataFrame:
    """(``id_col``, n_words, n_removed, kept_text): a row per row of ``docs``, without the words of any window of 13 words
    that also starts in a row with a smaller id. Kept words are joined by one space.

    Null and empty texts have no words. A row with a null id neither loses words nor counts as an earlier one, and rows
    of the same id do not count as earlier for each other. Ids are integers. Only id and text are read. An empty table
    gives no rows. Words are named by XXH64 of their bytes, windows by a 64-bit hash of their words' names.
    """
    dealt, total = deal(docs, id_col, text_col, block_bytes)
    bits = routes_for(total / 6 * len(COVER) / PERIOD, route_hashes)
    by_block = dealt.groupBy("_blk")
    anchors = by_block.applyInPandas(lambda rows: _send_anchors(rows, bits), "route long, _blk int, keys binary")
    shared = anchors.groupBy("route").applyInPandas(_answer_anchors, "_blk int, keys binary")
    sent = by_block.cogroup(shared.groupBy("_blk")).applyInPandas(
        lambda rows, answers: _send_windows(rows, answers, bits), "route long, _blk int, keys binary, low binary, high binary")
    earlier = sent.groupBy("route").applyInPandas(_answer_windows, "_blk int, keys binary, low binary")
    id_type = dict(docs.dtypes)[id_col]
    return by_block.cogroup(earlier.groupBy("_blk")).applyInPandas(
        _remove, f"_id {id_type}, n_words long, n_removed long, kept_text string").withColumnRenamed("_id", id_col)


#: What ``remove_repeats`` gives for the documents table, digested, said in SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS key FROM s),
e AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM k JOIN e USING (key) WHERE first < doc_id),
c AS (SELECT p.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
