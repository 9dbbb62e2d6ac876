"""Byte-level BPE: encoding by merges that a segment tree finds, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct matches whose ids a worker remembers, and bytes up to which one is remembered.
MEMORY_MATCHES, MEMORY_BYTES = 600_000, 64


class ByteBpe:
    """Ids of byte strings by ``ranks``; merges go by rank, the leftmost first among equal ones."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pieces = {i: piece for piece, i in self.ranks.items()}
        self.matches = regex.compile(pattern)
        self.none = max(self.ranks.values(), default=0) + 1
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        pairs = {
            self.ranks[piece[:k]] * self.none + self.ranks[piece[k:]]: i
            for piece, i in self.ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in self.ranks and piece[k:] in self.ranks
        }
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)] or [0], np.int64)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        two = [self.ranks.get(bytes([a, b]), self.none) for a in range(256) for b in range(256)]
        self.byte_pairs = np.array(two, np.int64).reshape(256, 256) << 32
        lengths = np.array([len(self.pieces.get(i, b"")) for i in range(self.none)], np.int64)
        self.piece_ends = np.cumsum(lengths)
        self.piece_starts = self.piece_ends - lengths
        self.piece_bytes = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(self.none)), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match.

        Leaf ``i`` of the segment tree holds ``(rank << 32) + i`` for the pair that
        starts at byte ``i``, so that the root is the leftmost minimum. A merge ends
        the leaf of the right part and sets those of the merged part and of its left
        neighbour: three point updates of logarithmic depth.
        """
        ranks, none = self.ranks, self.none << 32
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        tree = [none + n] * (2 * leaves)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[leaves + i] = (rank << 32) + i
        for k in range(leaves - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        end = list(range(1, n + 1))  # of the part that starts at a byte
        before = list(range(-1, n - 1))  # start of the part to the left

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a <= b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        def pair(i: int) -> int:
            middle = end[i]
            if middle >= n:
                return none + n
            rank = ranks.get(piece[i : end[middle]])
            return none + n if rank is None else (rank << 32) + i

        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                before[end[i]] = i
            put(gone, none + n)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """:meth:`merge` for many pieces of at most ``MEMORY_BYTES`` bytes, one segment tree per row.

        Trees of equal width are rows of one array; each round takes every row's root
        and makes its three point updates, for all rows at once.  Ids come as bytes.
        """
        whole = [self.ranks.get(p) for p in pieces]
        out = [b"" if i is None else i.to_bytes(4, "little") for i in whole]
        lengths = np.array([len(p) if i is None else 0 for p, i in zip(pieces, whole)], np.int64)
        widths = np.where(lengths > 0, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64), 0)
        for width in np.unique(widths[widths > 0]):
            chosen = np.flatnonzero(widths == width)
            ids, ends = self._merge_rows([pieces[i] for i in chosen], int(width))
            start = 0
            for at, end in zip(chosen.tolist(), ends):
                out[at] = ids[start:end]
                start = end
        return out

    def _pair_leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        key = left * self.none + right
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = there & (self.pair_keys[k] == key)
        return np.where(found, (self.pair_ranks[k] << 32) + at, self.none << 32)

    def _merge_rows(self, pieces: list[bytes], width: int) -> tuple[bytes, list[int]]:
        """The ids of all rows, one behind the other, and the byte at which each row's end."""
        m, none = len(pieces), self.none << 32
        n = np.array([len(p) for p in pieces], np.int64)
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        columns = np.arange(width)
        ids = np.zeros((m, width + 1), np.int64)
        ids[:, :width] = self.byte_ids[text]
        after = np.broadcast_to(columns + 1, (m, width)).copy()
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        tree = np.full((m, 2 * width), none, np.int64)
        alive = columns < n[:, None]  # a part starts here
        tree[:, width : 2 * width - 1] = np.where(
            alive[:, 1:], self.byte_pairs[text[:, :-1], text[:, 1:]] + columns[:-1], none
        )
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        # flat views: position of a row's cell is its row times the width, plus the column
        leaf, part, step, back = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        starts = alive.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            at_tree, at_part, at_step = rows * (2 * width), rows * (width + 1), rows * width
            root = leaf.take(at_tree + 1)
            i, merged = root & 0xFFFFFFFF, root >> 32
            gone = step.take(at_step + i)
            end = step.take(at_step + gone)
            part[at_part + i] = merged
            step[at_step + i] = end
            starts[at_step + gone] = False
            back[at_part + end] = i
            left = back.take(at_part + i)
            has_left = left >= 0
            left = np.where(has_left, left, gone)
            k = np.stack([gone, i, left]) + width
            leaf[at_tree + k[0]] = none
            leaf[at_tree + k[1]] = self._pair_leaf(merged, part.take(at_part + end), i, end < n[rows])
            leaf[at_tree + k[2]] = self._pair_leaf(part.take(at_part + left), merged, left, has_left)
            for _ in range(width.bit_length() - 1):
                k >>= 1
                children = at_tree + 2 * k
                leaf[at_tree + k] = np.minimum(leaf.take(children), leaf.take(children + 1))
            rows = rows[leaf.take(at_tree + 1) < none]
        return ids[:, :width][alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers, each match of the pattern by itself."""
        known = self.known
        if len(known) >= MEMORY_MATCHES:
            known.clear()
        words = [self.matches.findall(t) for t in texts]
        parts = [list(map(known.get, ws)) for ws in words]
        fresh = list({w for ws, ps in zip(words, parts) for w, p in zip(ws, ps) if p is None})
        data = [w.encode("utf-8") for w in fresh]
        short = [k for k, b in enumerate(data) if len(b) <= MEMORY_BYTES]
        found = {
            fresh[k]: np.array(self.merge(b), "<i4").tobytes() for k, b in enumerate(data) if len(b) > MEMORY_BYTES
        }
        merged = dict(zip([fresh[k] for k in short], self.merge_short([data[k] for k in short])))
        known.update(merged)
        found.update(merged)
        for k, (ws, ps) in enumerate(zip(words, parts)):
            if None in ps:
                parts[k] = [found[w] if p is None else p for w, p in zip(ws, ps)]
        return [b"".join(ps) for ps in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        starts, ends = self.piece_starts[ids], self.piece_ends[ids]
        lengths = ends - starts
        shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return self.piece_bytes[shift + np.arange(len(shift))].tobytes()


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(rank_file: str, pattern: str) -> ByteBpe:
    """The encoder of a Python worker, read once."""
    if (rank_file, pattern) not in _LOADED:
        _LOADED[rank_file, pattern] = ByteBpe(rank_file, pattern)
    return _LOADED[rank_file, pattern]


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column, ids array<int>`` of every whole text; null and empty texts have no ids.

    No shuffle; a task holds the ids of 64 texts at a time, whatever the batch. The
    rank file must lie at the same path on every machine, as a package's file does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids = bpe.encode_all([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0] + [len(b) // 4 for b in ids])
                flat = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=[id_column, "ids"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column, ids, decoded binary``: the bytes of the ids of :func:`encode_documents`; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                column = part.column(1)
                flat = column.flatten().to_numpy()
                ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
                out, at = [], 0
                for end in ends.tolist():
                    out.append(bpe.decode(flat[at:end]))
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), column, pa.array(out, pa.binary())], names=[id_column, "ids", "decoded"]
                )

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded binary")
