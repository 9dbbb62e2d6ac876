"""The skill catalogue: aliases, term resolution, mentions in text.

The catalogue is a table ``normalized_name, name, category, aliases`` with an
optional ``related`` list.  Its row order is the ``position`` column, or the
normalised name when there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import lexicon as lx
from ..functions.columns import distinct_by, each, each_with_position, let
from ..functions.text import lookup_keys, normalize_text, slugify_unknown

#: Characters a token of matching-form text can hold; punctuation stands alone.
_TOKEN = r"[a-z0-9]+|[+#. ]"
#: Tokens per slice of a long line.
_SLICE = 32


def category_or_other(c: Column) -> Column:
    return F.when(c.isin(*lx.SKILL_CATEGORIES), c).otherwise("other")


def alias_table(catalogue: DataFrame) -> DataFrame:
    """One row per surface form in matching form.

    A skill's own names beat another skill's alias; between equals the later
    own name and the earlier alias win.
    """
    order = "position" if "position" in catalogue.columns else "normalized_name"
    own = F.array(
        F.col("normalized_name"), F.replace("normalized_name", F.lit("_"), F.lit(" ")), F.col("name")
    )
    other = F.coalesce("aliases", F.array().cast("array<string>"))
    if "related" in catalogue.columns:
        other = F.concat(other, F.coalesce("related", F.array().cast("array<string>")))
    forms = catalogue.select(
        "normalized_name", "name", "category", F.col(order).alias("_order"),
        F.explode(
            F.concat(
                F.transform(own, lambda t: F.struct(F.lit(1).alias("own"), t.alias("form"))),
                F.transform(other, lambda t: F.struct(F.lit(0).alias("own"), t.alias("form"))),
            )
        ).alias("f"),
    ).select(
        "normalized_name", "name", "category", "_order", "f.own",
        normalize_text("f.form").alias("alias"),
    ).where(F.length("alias") > 0)
    entry = F.struct("normalized_name", "name", "category")
    best = forms.groupBy("alias").agg(
        F.max_by(F.when(F.col("own") == 1, entry), F.when(F.col("own") == 1, F.col("_order"))).alias(
            "own_entry"
        ),
        F.min_by(F.when(F.col("own") == 0, entry), F.when(F.col("own") == 0, F.col("_order"))).alias(
            "alias_entry"
        ),
    )
    return best.select("alias", F.coalesce("own_entry", "alias_entry").alias("e")).select(
        "alias", "e.*"
    )


def resolve_terms(terms: DataFrame, term: str, aliases: DataFrame) -> DataFrame:
    """Add ``normalized_name, category, display_name`` of a free-text term.

    Distinct terms are resolved once; a term the catalogue does not know keeps
    its text under a slug in category ``other``.
    """
    distinct = terms.select(F.col(term).alias("_term")).distinct()
    found = (
        each_with_position(distinct, ["_term"], lookup_keys("_term"), "_try", "alias")
        .join(aliases, "alias")
        .groupBy("_term")
        .agg(F.min_by(F.struct("normalized_name", "category", "name"), "_try").alias("hit"))
    )
    resolved = distinct.join(found, "_term", "left").select(
        F.col("_term").alias(term),
        F.coalesce("hit.normalized_name", slugify_unknown("_term")).alias("normalized_name"),
        F.coalesce("hit.category", F.lit("other")).alias("category"),
        F.coalesce("hit.name", F.trim("_term")).alias("display_name"),
    )
    return terms.join(resolved, term)


def resolve_array(df: DataFrame, key: str, name: str, aliases: DataFrame) -> DataFrame:
    """Replace an array of terms by ``array<struct<term, normalized_name>>``."""
    long = resolve_terms(
        df.select(key, F.posexplode(name).alias("_p", "_t")), "_t", aliases
    )
    back = long.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_p", "_t", "normalized_name"))),
            lambda e: F.struct(e["_t"].alias("term"), e["normalized_name"].alias("normalized_name")),
        ).alias("_resolved")
    )
    empty = F.array().cast("array<struct<term:string,normalized_name:string>>")
    return (
        df.drop(name).join(back, key, "left")
        .withColumn(name, F.coalesce("_resolved", empty)).drop("_resolved")
    )


def skill_catalogue(catalogue: DataFrame, terms: DataFrame, term: str) -> DataFrame:
    """The catalogue plus a row for every term it does not know yet."""
    known = catalogue.select(
        "normalized_name", "name", category_or_other(F.col("category")).alias("category"),
        F.array_distinct(
            F.concat(
                F.array(F.replace("normalized_name", F.lit("_"), F.lit(" ")), F.col("name")),
                F.coalesce("aliases", F.array().cast("array<string>")),
            )
        ).alias("aliases"),
    )
    seen = resolve_terms(terms.select(term), term, alias_table(catalogue))
    unseen = (
        seen.join(known.select("normalized_name"), "normalized_name", "left_anti")
        .groupBy("normalized_name")
        .agg(F.min("display_name").alias("name"))
        .select(
            "normalized_name", "name",
            F.lit("other").alias("category"), F.array("name").alias("aliases"),
        )
    )
    return known.unionByName(unseen)


def job_skills(jobs: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per (job, skill); required wins when a skill is on both lists."""
    def listed(column: str, importance: str) -> DataFrame:
        return jobs.select(
            "job_id", F.explode(column).alias("term"), F.lit(importance).alias("importance")
        )

    long = listed("required_skills", "required").unionByName(
        listed("preferred_skills", "preferred")
    )
    return (
        resolve_terms(long, "term", aliases)
        .groupBy("job_id", "normalized_name")
        .agg(F.max("importance").alias("importance"))
        .withColumn("weight", F.lit(1.0))
    )


# -- mentions ----------------------------------------------------------------
def _line_slices(text: Column, longest: Column) -> Column:
    """Overlapping slices of a token list with the character offset of each slice.

    A slice holds the tokens a mention starting in it can reach, so a very long
    line is matched in bounded pieces.
    """
    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), F.lit(_SLICE))
        widths = F.transform(
            starts, lambda s: F.length(F.array_join(F.slice(tokens, s + 1, F.lit(_SLICE)), ""))
        )
        return let(
            widths,
            lambda w: F.transform(
                starts,
                lambda s, k: F.struct(
                    _total(F.slice(w, F.lit(1), k)).alias("offset"),
                    F.get(tokens, s - 1).alias("before"),
                    F.slice(tokens, s + 1, longest + _SLICE).alias("tokens"),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), cut)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda s, n: s + n)


def _starts(piece: Column, longest: Column) -> Column:
    """Each token of a slice with its offset and the text a mention there could cover."""
    def start(i: Column, widths: Column) -> Column:
        before = F.when(i == 1, piece["before"]).otherwise(F.get(piece["tokens"], i - 2))
        return F.struct(
            F.get(piece["tokens"], i - 1).alias("head"),
            (piece["offset"] + _total(F.slice(widths, F.lit(1), i - 1))).alias("start"),
            F.coalesce(before.rlike("^[a-z0-9]"), F.lit(False)).alias("glued"),
            F.array_join(F.slice(piece["tokens"], i, longest + 1), "").alias("reach"),
        )

    return let(
        F.transform(piece["tokens"], F.length),
        lambda widths: F.transform(
            F.sequence(F.lit(1), F.least(F.size(piece["tokens"]), F.lit(_SLICE))),
            lambda i: start(i, widths),
        ),
    )


#: Surface forms up to which every task gets the automaton of all of them.
AUTOMATON_ALIASES = 1 << 16
#: Characters of a text that are cut into tokens at a time.
_PIECE = 1 << 20
#: Mentions that a task holds and hands on at a time; a batch of long texts may have millions.
_HITS = 1 << 15
_TOKENS = re.compile(_TOKEN)


class _Automaton:
    """All surface forms as one tree of tokens; a text is read once, whatever their number.

    Tokens are words or single marks, so a step is one look-up. From a token that begins
    no form the next token is tried at once; a form that was begun in vain costs its own
    length at most.
    """

    def __init__(self, forms: list[tuple[str, str]]) -> None:
        self.root: dict = {}
        for number, (form, _) in enumerate(forms):
            node = self.root
            for token in _TOKENS.findall(form):
                node = node.setdefault(token, {})
            node[""] = number
        self.longest = max((len(form) for form, _ in forms), default=0)

    def mentions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(form, start, end)`` from left to right, the longest at a place, none inside another.

        A long text is read in pieces that begin at a space and reach as far into the next
        piece as the longest form.
        """
        begun = done = 0
        while begun < len(text):
            cut = text.find(" ", begun + _PIECE)
            cut = len(text) if cut < 0 else cut
            tokens = _TOKENS.findall(text[begun : cut + self.longest + 1])
            starts = [begun, *accumulate(map(len, tokens), initial=begun)][1:]
            for i, token in enumerate(tokens):
                if token not in self.root or starts[i] < done:
                    continue
                if starts[i] >= cut:
                    break
                if i and tokens[i - 1].isalnum() or token == " ":
                    continue
                node, found, j = self.root, None, i
                while j < len(tokens) and (node := node.get(tokens[j])) is not None:
                    j += 1
                    if "" in node and not (j < len(tokens) and tokens[j].isalnum()):
                        found = node[""], j
                if found:
                    done = starts[found[1]]
                    yield found[0], starts[i], done
            begun = cut

    def parts(self, texts: pa.Array, most: int = _HITS) -> Iterator[list[tuple[int, int, int, int]]]:
        """Mentions of all texts behind the number of their text, in lists of at most ``most``."""
        hits = ((row, *hit) for row, text in enumerate(texts) for hit in self.mentions(text.as_py()))
        while part := list(islice(hits, most)):
            yield part


def find_skill_mentions(
    lines: DataFrame, keys: list[str], text: str, aliases: DataFrame
) -> DataFrame:
    """Every catalogue mention in a line: ``surface, normalized_name, start, end``.

    A mention may not touch a letter or digit on either side.  Overlaps keep the
    leftmost mention, and the longest at one position.  Up to ``AUTOMATON_ALIASES``
    surface forms every task gets them and reads each text once, where it lies; the
    forms of a larger catalogue meet the texts in :func:`_joined_mentions`.
    A null text has no mention.
    """
    forms = [(r["alias"], r["normalized_name"]) for r in aliases.select("alias", "normalized_name").limit(AUTOMATON_ALIASES + 1).collect()]
    if len(forms) > AUTOMATON_ALIASES:
        return _joined_mentions(lines, keys, text, aliases)
    wanted = lines.select(*keys, normalize_text(text).alias("_text"))
    added = "surface string, normalized_name string, start int, end int"
    fields = T.StructType(wanted.schema.fields[:-1] + T.StructType.fromDDL(added).fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _Automaton(forms)
        names = [pa.array(f, pa.string()) for f in zip(*forms)] or [pa.array([], pa.string())] * 2
        for batch in batches:
            for part in automaton.parts(batch.column(len(keys))):
                rows, which, starts, ends = (pa.array(c, pa.int32()) for c in zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in range(len(keys))), *(n.take(which) for n in names), starts, ends],
                    names=fields.names,
                )

    return wanted.mapInArrow(find, fields)


def _joined_mentions(
    lines: DataFrame, keys: list[str], text: str, aliases: DataFrame
) -> DataFrame:
    """Mentions of a catalogue of any size.

    Tokens join the first token of each alias, so only real candidates are compared
    and only hits are shuffled.
    """
    parts = F.regexp_extract_all(F.col("alias"), F.lit(_TOKEN), F.lit(0))
    heads = aliases.select(
        "alias", "normalized_name", F.get(parts, F.lit(0)).alias("_head"),
        F.size(parts).alias("_tokens"),
    )
    longest = heads.agg(F.coalesce(F.max("_tokens"), F.lit(1))).scalar()
    slices = (
        lines.select(*keys, normalize_text(text).alias("_text"))
        .where(F.length("_text") > 0)
        .withColumn("_longest", longest)
    )
    pieces = each(
        slices, [*keys, "_longest"], _line_slices(F.col("_text"), F.col("_longest")), "s"
    )
    starts = each(pieces, keys, _starts(F.col("s"), F.col("_longest")), "t").select(
        *keys, "t.*"
    ).where("head <> ' ' AND NOT glued")
    hits = (
        starts.join(heads, F.col("head") == F.col("_head"))
        .where(
            F.startswith(F.col("reach"), F.col("alias"))
            & ~F.substring("reach", F.length("alias") + 1, F.lit(1)).rlike("[a-z0-9]")
        )
        .select(
            *keys, F.col("alias").alias("surface"), "normalized_name", "start",
            (F.col("start") + F.length("alias")).alias("end"),
        )
    )
    return _leftmost_longest(hits, keys)


def _leftmost_longest(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Drop hits that overlap an earlier kept one, the scan a single regex would do.

    Only runs of overlapping hits need the sequential rule; each run is a few
    hits long.
    """
    by_line = Window.partitionBy(*keys).orderBy("start", F.col("end").desc())
    reach = F.max("end").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn(
        "_new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    ).withColumn(
        "_run", F.sum("_new").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    )
    entry = "array<struct<start:int,end:int,surface:string,normalized_name:string>>"

    def keep(kept: Column, hit: Column) -> Column:
        clear = F.size(kept) == 0
        last = F.element_at(kept, F.lit(-1))
        return F.when(clear, F.array(hit)).when(
            hit["start"] >= last["end"], F.array_append(kept, hit)
        ).otherwise(kept)

    ordered = F.array_sort(
        F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "surface", "normalized_name"))
    )
    plain = F.transform(
        ordered,
        lambda h: F.struct(
            h["start"].alias("start"), (-h["back"]).alias("end"),
            h["surface"].alias("surface"), h["normalized_name"].alias("normalized_name"),
        ),
    ).cast(entry)
    packed = runs.groupBy(*keys, "_run").agg(plain.alias("_hits"))
    kept = F.aggregate("_hits", F.array().cast(entry), keep)
    return each(packed, keys, kept, "h").select(*keys, "h.*")


def ordered_union(first: Column, second: Column) -> Column:
    """Two term lists, one entry per matching form."""
    return distinct_by(F.concat(first, second), normalize_text)
