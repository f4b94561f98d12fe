"""Byte-level BPE by dynamic programming over byte prefixes (operator 3).

Every prefix of a byte string has exactly one valid last token: the token that ends there
and forms a boundary with the last token of the prefix before it which no merge would have
crossed. Storing that token per prefix encodes in one pass, continues exactly when bytes
are appended, and after an edit needs recomputing only until the stored tokens agree again.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings of pre-tokens and stored prefixes kept by a Python worker; only memory depends on them.
CACHE = 700_000
PREFIXES = 500_000
PAIRS = 400_000
#: Longer pre-tokens use an array of their own instead of the shared prefixes.
SHARED_BYTES = 40
_END = -1  # key of a token's id in the suffix trie


class _Pieces(dict):
    """Packed ids of pre-tokens, in two generations: those in use move on, the others go with the old one."""

    def __init__(self, codec: PrefixCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.codec.encode_bytes(piece.encode("utf-8"))
        if len(piece) <= SHARED_BYTES:
            if len(self) >= self.codec.keep // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PrefixCodec:
    """Encoder and decoder for a rank file (base64 token, rank per line)."""

    def __init__(self, path: str, pattern: str, keep: int = CACHE):
        self.keep = keep
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.token}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.suffixes: dict = {}
        for token, rank in self.ranks.items():
            node = self.suffixes
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[_END] = rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.last: dict[bytes, int] = {}
        self.boundary: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        text = self.token[token]
        if len(text) == 1:
            return None
        if token not in self.parts:
            symbols = [text[k:k + 1] for k in range(len(text))]
            while len(symbols) > 2:
                rank, at = min((self.ranks.get(symbols[k] + symbols[k + 1], 1 << 40), k) for k in range(len(symbols) - 1))
                if rank >= token:
                    raise ValueError(f"token {token} is not made by merges")
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            self.parts[token] = self.ranks[symbols[0]], self.ranks[symbols[1]]
        return self.parts[token]

    def meets(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.boundary.get(key)
        if known is None:
            if len(self.boundary) > PAIRS:
                self.boundary.clear()
            known = self.boundary[key] = self._meets(left, right)
        return known

    def _meets(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of ``left`` and ``right`` together gives just these two tokens.

        Takes back the later of the merges beside the boundary, again and again. Whatever two tokens stand at the
        boundary then, their own merge must come no earlier than the merge that replaced one of them.
        """
        before = 1 << 40  # rank up to which the current two tokens exist side by side
        while True:
            joint = self.ranks.get(self.token[left] + self.token[right])
            if joint is not None and joint < before:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:  # of two equal ranks, the left one merges first
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Append to ``last`` the last token of each further prefix of ``data``; ``last[k]`` is that of k + 1 bytes."""
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            node = self.suffixes
            for start in range(end - 1, -1, -1):
                node = node.get(data[start])
                if node is None:
                    raise ValueError("a byte has no token")
                token = node.get(_END)
                if token is not None and (start == 0 or self.meets(last[start - 1], token)):
                    last.append(token)
                    break

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[out[-1]])
        return out[::-1]

    def encode_bytes(self, data: bytes) -> bytes:
        """Packed ids of one pre-token."""
        if len(data) > SHARED_BYTES:
            last: list[int] = []
            self.extend(data, last)
            return b"".join(map(self.packed.__getitem__, self.walk(data, last)))
        stored, suffixes, boundary = self.last, self.suffixes, self.boundary
        if len(stored) > self.keep * PREFIXES // CACHE:
            stored.clear()
        known = len(data)
        while known and data[:known] not in stored:
            known -= 1
        for end in range(known + 1, len(data) + 1):
            node = suffixes
            for start in range(end - 1, -1, -1):
                node = node[data[start]]
                if _END in node:
                    token = node[_END]
                    if start:
                        left = stored[data[:start]]
                        fits = boundary.get(left << 32 | token)
                        if fits is None:
                            fits = self.meets(left, token)
                        if not fits:
                            continue
                    stored[data[:end]] = token
                    break
        out, end, packed_, texts = b"", len(data), self.packed, self.token
        while end:
            token = stored[data[:end]]
            out = packed_[token] + out
            end -= len(texts[token])
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids (little-endian, 32 bits) of a whole text; each match of the pattern by itself."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class EditableEncoding:
    """The encoding of one byte string, kept up to date under appends and edits."""

    def __init__(self, codec: PrefixCodec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.codec.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``end``; returns how many prefixes were computed anew.

        A prefix depends on what precedes it only through the last tokens of the ``longest`` prefixes before it, so
        once as many in a row agree with the stored ones, all later ones do.
        """
        tail = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.last[:start]
        first, agreed = start + len(new), 0
        self.codec.extend(self.data, self.last, first)
        for k, old in enumerate(tail):
            self.codec.extend(self.data, self.last, first + k + 1)
            agreed = agreed + 1 if self.last[-1] == old else 0
            if agreed == self.codec.longest:
                computed = len(self.last) - start
                self.last += tail[k + 1:]
                return computed
        return len(self.last) - start

    def ids(self) -> list[int]:
        return self.codec.walk(self.data, self.last)


_CODECS: dict[tuple[str, str, int], PrefixCodec] = {}


def codec(path: str, pattern: str, keep: int = CACHE) -> PrefixCodec:
    if (path, pattern, keep) not in _CODECS:
        _CODECS[path, pattern, keep] = PrefixCodec(path, pattern, keep)
    return _CODECS[path, pattern, keep]


def encode(text: Column | str, path: str, pattern: str, keep: int = CACHE) -> Column:
    """Token ids of ``text`` as binary, little-endian unsigned 32-bit integers; null and empty texts give no ids.

    Rows are independent: repeated rows give equal ids, an empty table none. ``keep`` bounds the pre-tokens that a worker
    remembers; fewer take less memory and more time and never change a result.
    """
    @F.arrow_udf("binary")
    def encoded(column: pa.Array) -> pa.Array:
        c = codec(path, pattern, keep)
        return pa.array([c.encode(t.as_py() or "") for t in column], pa.binary())

    return encoded(text)


def decode(ids: Column | str, path: str, pattern: str, keep: int = CACHE) -> Column:
    """Bytes of packed ``ids``; null ids give empty bytes, an unknown id fails the task."""
    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        c = codec(path, pattern, keep)
        return pa.array([c.decode(i.as_py() or b"") for i in column], pa.binary())

    return decoded(ids)


def n_ids(ids: Column | str) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("long")
