"""Vectors compressed to codes: a codebook per part, searched through memoised grid cells, in integers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize


@dataclass(frozen=True)
class CodeSpec:
    """``parts`` equal parts of a vector, ``entries`` per codebook (at most 256), ``rounds`` of fitting.

    A component ``x`` counts as the integer ``floor(scale * x)``.
    """

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def __post_init__(self):
        if not (self.parts > 0 and 0 < self.entries <= 256 and self.rounds >= 0 and self.scale > 0):
            raise ValueError(f"no codes: {self}")


#: Part, entry, component: Python integers, so that no size overflows.
Codebooks = list[list[tuple[int, ...]]]

#: Integers below this are searched in arrays: squared distances, times the entries, stay within 63 bits.
_FAST = 1 << 22
#: Cells that a task remembers per part before it starts anew, and vectors compared at a time.
_CELLS, _ROWS = 1 << 16, 1 << 12


def _integer(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def usable_vectors(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is whole, finite and of that dimension, and these vectors as a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimension)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dimension)  # null is nan
    good = np.isfinite(values).all(1)
    return rows[good], values[good]


class _Cells:
    """Nearest entries of one part.

    Space is cut into boxes as wide as half of what the codebook spans. Of a box that
    is met first, the entries are kept whose least distance to it is not above the
    least of all entries' greatest distances: no other can be nearest to any point in
    it. Points are compared with the entries of their box only.
    """

    def __init__(self, entries: list[tuple[int, ...]]) -> None:
        self.exact = entries
        self.fast = max((abs(v) for e in entries for v in e), default=0) < _FAST
        if self.fast:
            self.entries = np.array(entries, np.int64)
            self.width = max(1, int(np.ptp(self.entries)) // 2)
        self.known: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """A mask of the entries for each cell."""
        low = cells[:, None, :] * self.width
        high = low + self.width - 1
        near = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        far = np.maximum(np.abs(self.entries - low), np.abs(high - self.entries))
        near, far = (near * near).sum(2), (far * far).sum(2)
        return near <= far.min(1)[:, None]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; of equal ones the first."""
        cells = np.ascontiguousarray(np.floor_divide(points, self.width))
        names = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        names, first, which = np.unique(names, return_index=True, return_inverse=True)
        names = [n.tobytes() for n in names]
        new = [i for i, n in enumerate(names) if n not in self.known]
        if len(self.known) + len(new) > _CELLS:
            self.known, new = {}, list(range(len(names)))
        if new:
            self.known.update(zip([names[i] for i in new], self.candidates(cells[first[new]])))
        row, entry = np.nonzero(np.stack([self.known[n] for n in names])[which])
        distance = ((points[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(distance * len(self.entries) + entry, starts)
        return best % len(self.entries), best // len(self.entries)

    def nearest_exact(self, point: tuple[int, ...]) -> tuple[int, int]:
        """The same for integers of any size."""
        distances = [sum((a - b) ** 2 for a, b in zip(point, e)) for e in self.exact]
        best = min(range(len(distances)), key=distances.__getitem__)
        return best, distances[best]


class _Coder:
    """Codes of vectors by given codebooks; one for each task, so its cells serve all its batches."""

    def __init__(self, codebooks: Codebooks, spec: CodeSpec) -> None:
        self.parts = [_Cells(entries) for entries in codebooks]
        self.scale = spec.scale

    def code(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """Some rows at a time: their numbers, parts as integers, indexes per part, squared distances per part."""
        with np.errstate(over="ignore"):
            whole = np.floor(values * self.scale)
        fast = (np.abs(whole) < _FAST).all(1) & all(p.fast for p in self.parts)
        shape = (len(self.parts), -1)
        quick = np.flatnonzero(fast)
        for at in range(0, len(quick), _ROWS):
            rows = quick[at : at + _ROWS]
            points = whole[rows].astype(np.int64).reshape(len(rows), *shape)
            found = [part.nearest(points[:, p]) for p, part in enumerate(self.parts)]
            yield rows, points, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1).tolist()
        for row in np.flatnonzero(~fast):
            point = np.array([_integer(x, self.scale) for x in values[row].tolist()], object).reshape(1, *shape)
            found = [part.nearest_exact(tuple(point[0, p])) for p, part in enumerate(self.parts)]
            yield np.array([row]), point, np.array([[f[0] for f in found]]), [[f[1] for f in found]]


def _sums_of(points: np.ndarray, codes: np.ndarray, sums: dict[tuple[int, int], list]) -> None:
    """Add the points to ``[count, *component sums]`` of their part and entry."""
    for part in range(codes.shape[1]):
        for entry in np.unique(codes[:, part]).tolist():
            mine = points[codes[:, part] == entry, part]
            total = sums.setdefault((part, entry), [0] * (1 + points.shape[2]))
            for i, v in enumerate([len(mine), *mine.sum(0).tolist()]):
                total[i] += v


def fit_codebooks(
    vectors: DataFrame, spec: CodeSpec = CodeSpec(), id_column: str = "vec_id", vector_column: str = "embedding"
) -> Codebooks:
    """Codebooks of all usable vectors, after ``spec.rounds`` rounds.

    They start as the parts of the vectors with the smallest ids (of equal ids, the
    smaller vector first; null ids last). Each round sends every part to its nearest
    entry, the first of equally near ones, and moves every entry to the floor of its parts'
    mean; an entry without parts stays. Tasks return sums per entry, so a round brings
    ``parts * entries * (components of a part + 1)`` integers to the driver.

    Vectors that are null or hold null or non-finite components are left out, as are
    those of another dimension than the first usable one; fewer vectors than entries
    make smaller codebooks, none at all an empty list.
    """
    source = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            rows = [usable_vectors(batch.column(1), int(d))[0] for d in np.unique(lengths[lengths > 0])]
            yield batch.take(pa.array(np.sort(np.concatenate(rows)) if rows else [], pa.int64()))

    usable = source.mapInArrow(whole, source.schema)
    order = (F.col("id").asc_nulls_last(), "vector")
    first = usable.orderBy(*order).limit(spec.entries).collect()
    if not first:
        return []
    dimension = len(first[0].vector)
    if any(len(row.vector) != dimension for row in first):
        first = usable.where(F.size("vector") == dimension).orderBy(*order).limit(spec.entries).collect()
    if dimension % spec.parts:
        raise ValueError(f"{dimension} components cannot be cut into {spec.parts} equal parts")
    width = dimension // spec.parts
    seeds = [[_integer(x, spec.scale) for x in row.vector] for row in first]
    codebooks = [[tuple(s[p * width : (p + 1) * width]) for s in seeds] for p in range(spec.parts)]
    for _ in range(spec.rounds):
        codebooks = _moved(source, codebooks, dimension, spec)
    return codebooks


def _moved(source: DataFrame, codebooks: Codebooks, dimension: int, spec: CodeSpec) -> Codebooks:
    """The codebooks after one round."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums = _Coder(codebooks, spec), {}
        for batch in batches:
            for _, points, codes, _ in coder.code(usable_vectors(batch.column(0), dimension)[1]):
                _sums_of(points, codes, sums)
        rows = [(part, entry, at, Decimal(v)) for (part, entry), t in sums.items() for at, v in enumerate(t)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((), (), (), ()), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "total"])

    partial = source.select("vector").mapInArrow(summed, "part int, entry int, place int, total decimal(38,0)")
    totals = {
        (r.part, r.entry, r.place): int(r.total)
        for r in partial.groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    }
    return [
        [
            tuple(totals[p, e, 1 + i] // totals[p, e, 0] for i in range(len(entry))) if (p, e, 0) in totals else entry
            for e, entry in enumerate(entries)
        ]
        for p, entries in enumerate(codebooks)
    ]


def codebooks_sha256(codebooks: Codebooks) -> str:
    """Hex digest of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for part in codebooks for e in part for v in e).encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame,
    codebooks: Codebooks,
    spec: CodeSpec = CodeSpec(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``id_column, code, error, label_error`` of every usable vector.

    ``code`` holds the index of each part's nearest entry in two hex digits, ``error``
    the sum of the squared distances, ``label_error`` its sum over the rows of the
    same label, null labels together. Sums are made before they are shuffled; the
    labels' totals are broadcast if they are few, else joined, a hot label being split
    by adaptive execution. An error too large for a long is null.

    Rows are left out as in :func:`fit_codebooks`. Ids may be null or repeated. No
    codebooks or no rows give no rows; other columns are ignored.
    """
    source = vectors.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")
    )
    dimension = sum(len(part[0]) for part in codebooks)
    schema = source.drop("vector").schema.add("code", "string").add("error", "long")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(codebooks, spec)
        for batch in batches:
            kept, values = usable_vectors(batch.column(2), dimension)
            codes, errors = [""] * len(kept), [0] * len(kept)
            for rows, _, indexes, distances in coder.code(values):
                digits = indexes.astype(np.uint8).tobytes().hex()
                for k, row in enumerate(rows.tolist()):
                    codes[row] = digits[2 * spec.parts * k : 2 * spec.parts * (k + 1)]
                    errors[row] = error if (error := sum(distances[k])) < 1 << 63 else None
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["id", "label", "code", "error"],
            )

    if not codebooks:
        source = source.limit(0)
    found = materialize(source.mapInArrow(coded, schema), "vector-codes")
    totals = materialize(
        found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")), "label-errors"
    ).withColumnRenamed("label", "of_label")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_IDS else totals
    return found.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(id_column), "code", "error", F.expr("try_cast(label_error as long)").alias("label_error")
    )


def decode_vectors(
    codes: DataFrame, codebooks: Codebooks, spec: CodeSpec = CodeSpec(), code_column: str = "code"
) -> DataFrame:
    """``codes`` with a column ``decoded``: the entries that the code names, as doubles in the vectors' unit.

    A null code gives null; a column ``decoded`` that is there already is replaced.
    """
    tables = F.array(*[
        F.array(*[F.array(*[F.lit(v / spec.scale) for v in entry]) for entry in part]) for part in codebooks
    ])
    entry = F.transform(
        F.sequence(F.lit(0), F.lit(spec.parts - 1)),
        lambda p: F.get(F.get(tables, p), F.conv(F.substring(F.col(code_column), 2 * p + 1, F.lit(2)), 16, 10).cast("int")),
    )
    return codes.withColumn("decoded", F.when(F.col(code_column).isNotNull(), F.flatten(entry)))
