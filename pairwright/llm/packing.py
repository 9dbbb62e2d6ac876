"""Tokenising documents and packing them by harmonic classes, one worker at a time."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer


class Ids:
    """Ids of a text as the tokenizer file ``vocabulary`` gives them, special strings included.

    ``ranks`` is the same vocabulary as a rank file, which encodes several times
    faster; texts that its pattern engine cannot take (very long runs of white
    space) go to the tokenizer file itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        self.slow = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            pieces = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=pieces, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError:
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


_LOADED: dict[tuple[str, str, str], Ids] = {}


def cuts(tokens: int, capacity: int, finest: int) -> list[int]:
    """Piece lengths of a document: whole capacities, then halves of it down to ``finest``, then the rest."""
    out = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= finest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """Bins of one worker. A piece of length L is of class ``capacity // L``; a bin takes that many.

    ``add`` returns the pieces of a bin once it has its count. ``leftover`` strings
    the pieces of all unfinished bins together and cuts the string into sequences
    of ``capacity``, the last into powers of two, which need no padding.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: dict[int, list] = defaultdict(list)

    def add(self, piece: tuple) -> list | None:
        length = piece[2]
        kind = self.capacity // length
        held = self.open[kind]
        held.append(piece)
        return self.open.pop(kind) if len(held) == kind else None

    def leftover(self) -> Iterator[list]:
        held = [p for kind in sorted(self.open) for p in self.open[kind]]
        total = sum(p[2] for p in held)
        room = [self.capacity] * (total // self.capacity)
        room += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        bins, free = [], 0
        for key, start, length, ids, tokens in held:
            at = 0
            while at < length:
                if not free:
                    free = room[len(bins)]
                    bins.append([])
                n = min(free, length - at)
                bins[-1].append((key, start + at, n, ids[at : at + n], tokens))
                at, free = at + n, free - n
        yield from bins


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    capacity: int = 1024,
    finest: int = 64,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: ``id_column, start, length, token_bytes, doc_tokens, sequence_id, offset``.

    A document is the ids of its text (null: empty), then ``end_id``; every id lies
    in one piece, ``token_bytes`` holds its ids as little-endian unsigned 32-bit
    numbers. Documents are cut into whole sequences, halves, quarters and so on
    down to ``finest``, and a rest. Harmonic packing then works on each partition
    by itself: class ``j`` holds the lengths in ``(capacity / (j + 1), capacity / j]``
    and its sequences get exactly ``j`` pieces. A worker holds less than one
    sequence for each of at most ``finest + 11`` classes; there is no shuffle.
    Padding is left only in sequences of rests, under ``finest`` tokens each; the
    worker's last, unfinished ones have a power of two as length.

    ``capacity`` and ``finest`` must be powers of two. A repeated id is packed once
    per row. No documents give no pieces. The vocabulary files must lie at the same
    path on every machine.
    """
    if capacity & (capacity - 1) or finest & (finest - 1) or not 0 < finest <= capacity:
        raise ValueError("capacity and finest must be powers of two, finest the smaller")
    kind = docs.schema[id_column].dataType
    names = [id_column, "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (vocabulary, ranks, pattern)
        encode = _LOADED.get(files) or _LOADED.setdefault(files, Ids(*files))
        bins = HarmonicBins(capacity)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        key_type = None

        def close(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for key, start, length, ids, tokens in pieces:
                rows.append((key, start, length, ids.tobytes(), tokens, sequence, offset))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            rows.clear()
            return out

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4", copy=False)
                start = 0
                for length in cuts(len(ids), capacity, finest):
                    full = bins.add((key.as_py(), start, length, ids[start : start + length], len(ids)))
                    if full:
                        close(full)
                    start += length
                if len(rows) >= 4096:
                    yield flush()
        for pieces in bins.leftover():
            close(pieces)
        if rows:
            yield flush()

    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(
        run,
        f"`{id_column}` {kind.simpleString()}, start long, length long, token_bytes binary, doc_tokens long, "
        "sequence_id long, offset long",
    )
