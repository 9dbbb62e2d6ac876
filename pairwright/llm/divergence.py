"""How far the sources of a language differ in their words: a frequent-pattern tree of term rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize


@dataclass(frozen=True)
class DivergenceSpec:
    """Terms of at least ``documents`` documents of a language count; ``top`` terms of a source are listed.

    A term's share is ``1 + floor(scale * (count + smoothing) / (total + smoothing * terms))``.
    """

    documents: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top: int = 50


#: Upper-case ASCII becomes lower-case; what is neither an ASCII letter nor outside ASCII parts the terms.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: Bytes of a text that are split at a time, and terms that a task holds before it passes them on.
_SLICE, _HELD = 1 << 20, 1 << 19
#: Steps of paths that are one tree, at most, or else one row; corrections held before they are summed.
_CELLS = 1 << 20


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time, cut between terms."""
    text, start = text.translate(_BYTES), 0
    while start < len(text):
        end = text.find(b" ", start + _SLICE) if len(text) - start > _SLICE else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``lang, source, term, n, docs``; a group that is met gives a row without term as well."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, docs) in counts.items():
            size = len(occurrences) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size),
                    pa.array([*occurrences, None], pa.binary()), pa.array([*occurrences.values(), 0], pa.int64()),
                    pa.array([*map(docs.__getitem__, occurrences), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*batch.columns):
            occurrences, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _slices(text.as_py()):
                occurrences.update(terms)
                seen.update(terms)
            docs.update(seen)
            if len(seen) > _HELD:
                yield from told()
        if sum(len(c) for c, _ in counts.values()) > _HELD:
            yield from told()
    yield from told()


def _share(n: Column, total: Column, terms: Column, spec: DivergenceSpec) -> Column:
    """The share of a term with ``n`` of ``total`` occurrences, in integers; null where no term is kept."""
    above = F.lit(spec.scale).cast("decimal(38,0)") * (n + spec.smoothing)
    below = (total + spec.smoothing * terms).cast("decimal(38,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below))


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(every), np.int64)
    np.add.at(sums, which, np.concatenate(values))
    return every, sums


def _tree_corrections(paths: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrections per pair of places, as ``place * 2**32 + place``, of paths in order.

    ``paths[row, step]`` is (place, share, share without the term), filled up behind the
    row's depth. Equal beginnings of rows that follow each other are one path of the tree:
    a step that differs from the row before, or stands behind such a step, begins a node,
    and the rows up to the next node of its depth pass it. A node corrects each of its
    ancestors once, times the rows that pass.
    """
    rows, steps, _ = paths.shape
    opens = np.ones((rows, steps), bool)
    opens[1:] = np.logical_or.accumulate((paths[1:] != paths[:-1]).any(2), 1)
    keys, values, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for step in range(1, steps):
        at = np.flatnonzero(opens[:, step])
        passing = np.add.reduceat((depths > step).astype(np.int64), at)
        at, passing = at[depths[at] > step], passing[depths[at] > step]
        place, share, base = paths[at, step, :].T
        for above in range(step):
            other, other_share, other_base = paths[at, above, :].T
            change = np.abs(share - other_share) - np.abs(share - other_base)
            change += np.abs(base - other_base) - np.abs(base - other_share)
            keys.append((place << 32) + other)
            values.append(passing * change)
            held += len(at)
            if held > _CELLS:
                each, sums = _summed(keys, values)
                keys, values, held = [each], [sums], 0
    return _summed(keys, values)


def _grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections ``lang, place, item_place, value`` of ``lang, path`` rows that come in this order."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        depths = pc.list_value_length(batch.column(1)).to_numpy() // 3
        flat = batch.column(1).flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(3 * depths)])
        at = 0
        while at < len(langs):
            end, widest = at, 1
            while end < len(langs) and langs[end] == langs[at]:
                widest = max(widest, int(depths[end]))
                if end > at and (end + 1 - at) * widest > _CELLS:
                    break
                end += 1
            depth = depths[at:end]
            paths = np.zeros((end - at, int(depth.max()), 3), np.int64)
            paths[np.arange(paths.shape[1]) < depth[:, None]] = flat[starts[at] : starts[end]].reshape(-1, 3)
            keys, sums = _tree_corrections(paths, depth)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(langs[at], pa.string()), len(keys)), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(sums)],
                names=["lang", "place", "item_place", "value"],
            )
            at = end


def _small(df: DataFrame) -> DataFrame:
    """A written table, sent to every executor if it has no more than ``BROADCAST_IDS / 16`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS >> 4 else df


def source_divergence(docs: DataFrame, spec: DivergenceSpec = DivergenceSpec()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of a language and a source.

    Part ``pair``: ``item`` is another source of the language, ``value`` the sum over
    the language's kept terms of the difference of the two sources' shares. Part
    ``term``: ``item`` is a term that the source uses more than its language does,
    ``value`` by how much, the ``spec.top`` first. Ranks start at 1, larger values
    first, then by the bytes of the item.

    Terms are runs of ASCII letters, lower-cased, and of characters outside ASCII. A
    task counts its texts' terms, in slices, and passes on what it has counted when
    it holds many; only such counts are shuffled, never texts, so neither a hot source
    nor a frequent term makes a large group.

    Sums over pairs of sources take three parts: what the pair would differ by if no
    term occurred; per source and distinct share, what the terms that occur change
    against every other source; and, for terms that occur in both, a correction. The
    latter comes from a tree of the terms' rows, ordered by source, in which equal
    beginnings are one path: rows are dealt by their first steps, sorted, and grow one
    tree per batch, whose nodes correct each of their ancestors once for all terms
    below them. The result has a row per pair of sources of a language, so it grows
    with the square of their number.

    Null text, lang and source count as empty. A group without kept terms has shares of
    zero terms: pairs of value 0, no terms. An empty table gives an empty one.
    Repeated rows are documents of their own; other columns are ignored.
    """
    read = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    partial = read.mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    counts = materialize(
        partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts"
    )
    kept = materialize(
        counts.where("term is not null").groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= spec.documents)
        .drop("docs"),
        "kept-terms",
    )
    found = materialize(
        counts.where("term is not null").join(kept, ["lang", "term"]).drop("docs"), "kept-counts"
    )
    langs = materialize(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "langs")
    groups = materialize(
        counts.where("term is null").select("lang", "source")
        .join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(_small(langs), "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        )
        .withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms"), spec))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")),
        "groups",
    )
    shares = materialize(
        found.join(_small(groups), ["lang", "source"]).select(
            "lang", "source", "term", "place", "base",
            _share(F.col("n"), F.col("total"), F.col("terms"), spec).alias("share"),
            _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), spec).alias("lang_share"),
        ),
        "shares",
    )

    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"), "terms")
    apart = F.col("source") != F.col("item")
    without = (
        groups.drop("terms").join(_small(others), "lang").where(apart)
        .select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("base") - F.col("item_base"))).otherwise(0).alias("value"))
    )
    alone = (
        shares.groupBy("lang", "source", "share", "base").agg(F.count("*").alias("n"))
        .join(_small(others), "lang").where(apart)
        .groupBy("lang", "source", "item")
        .agg(
            F.sum(
                F.col("n") * (F.abs(F.col("share") - F.col("item_base")) - F.abs(F.col("base") - F.col("item_base")))
            ).alias("value")
        )
    )
    steps = F.array_sort(F.collect_list(F.struct("place", "share", "base")))
    rows = materialize(
        shares.groupBy("lang", "term")
        .agg(F.flatten(F.transform(steps, lambda s: F.array(s["place"], s["share"], s["base"]))).alias("path")),
        "term-rows",
    )
    begins = (F.col("lang"), F.slice("path", 1, 6), F.xxhash64("path"))
    places = _small(groups.select("lang", "source", "place"))
    both = (
        rows.repartitionByRange(*begins).sortWithinPartitions("lang", "path").select("lang", "path")
        .mapInArrow(_grow_trees, "lang string, place long, item_place long, value long")
        .groupBy("lang", "place", "item_place").agg(F.sum("value").alias("value"))
        .join(places, ["lang", "place"])
        .join(places.select("lang", F.col("source").alias("item"), F.col("place").alias("item_place")), ["lang", "item_place"])
        .select("lang", "source", "item", "value")
    )
    one_way = alone.union(both)
    swapped = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = without.union(one_way).union(swapped).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = shares.where("share > lang_share").select(
        "lang", "source", F.col("term").cast("string").alias("item"), (F.col("share") - F.col("lang_share")).alias("value")
    )

    def ranked(part: str, values: DataFrame) -> DataFrame:
        order = F.row_number().over(
            Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").cast("binary"))
        )
        return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", order.alias("rank"))

    return ranked("pair", pairs).union(ranked("term", terms).where(F.col("rank") <= spec.top))
