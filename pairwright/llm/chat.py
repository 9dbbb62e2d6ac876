"""Chat formatting with typed content parts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template and the placeholders of attachments.
TURN, ROLE_END, TURN_END = "[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: A control string (also ``<s>``) with any number of backslashes behind its first character.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|(?:image|audio|document)\|>)"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|(?:image|audio|document)\|>)"

PART_TYPE = (
    "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
)


def escaped(text: Column) -> Column:
    """``text`` with one more backslash inside every control string, so that none is left in it."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A content array with the one text part ``text``."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *empty))


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a model puts in place of one placeholder; at least 1, 0 for text."""
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / F.lit(patch)) * F.ceil(
        F.coalesce(part["height"], F.lit(0)) / F.lit(patch)
    )
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(audio_rate))
    pages = F.coalesce(part["pages"], F.lit(0)) * F.lit(page_tokens)
    kinds = {"image": image, "audio": audio, "document": pages}
    chosen = F.lit(0).cast("long")
    for kind, count in kinds.items():
        chosen = F.when(part["type"] == kind, F.greatest(count.cast("long"), F.lit(1).cast("long"))).otherwise(chosen)
    return chosen


def format_chats(
    turns: DataFrame, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256
) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, content)``.

    ``content`` is an array of parts (``PART_TYPE``). A visitor goes over the parts
    in order: an image, audio or document part becomes its placeholder, the text between two
    of them is joined, then escaped and kept; a part of another or no type counts as
    text. Columns:

    ``formatted``     ``[INST]role[/INST]content</s>`` per turn
    ``loss_spans``    array<struct<start, length>>: code points of every assistant content
    ``attachments``   array<struct<type, ref, turn_index, part_index, position, tokens>>, in order;
                      ``position`` is the code point of the placeholder in ``formatted``
    ``expanded_tokens``  sum of the attachments' tokens: images by patches of ``patch`` pixels,
                      audio by ``audio_rate`` a second, documents by ``page_tokens`` a page, 1 at least
    ``n_turns``       rows of the conversation

    Rows are ordered by turn, then role, then formatted content; repeated rows count
    as turns. Null texts, roles and contents are empty; null ``conv_id`` is one
    conversation. A conversation is one value, as its string is one training text;
    conversations, not turns, are what is spread over tasks. No rows give none.
    """

    def visit(part: Column) -> Column:
        mark = F.lit(None).cast("string")
        for kind, sign in PLACEHOLDERS.items():
            mark = F.when(part["type"] == kind, F.lit(sign)).otherwise(mark)
        return F.struct(
            F.coalesce(part["text"], F.lit("")).alias("text"),
            mark.alias("mark"),
            part["type"].alias("type"),
            part["ref"].alias("ref"),
            expanded_tokens(part, patch, audio_rate, page_tokens).alias("tokens"),
        )

    def run(k: Column) -> Column:
        """The text between two attachments, escaped as a whole: parts that touch may make a control string."""
        before = F.when(k > 0, F.get("at", k - 1) + 1).otherwise(0)
        upto = F.coalesce(F.get("at", k), F.size("parts"))
        return escaped(F.array_join(F.slice(F.col("parts.text"), before + 1, upto - before), ""))

    nothing = F.array().cast(f"array<{PART_TYPE}>")
    none = F.array(F.lit(0).cast("long"))
    role = F.coalesce(F.col("role"), F.lit(""))
    flat = (
        turns.select(
            "conv_id",
            "turn",
            role.alias("role"),
            F.concat(F.lit(TURN), escaped(role), F.lit(ROLE_END)).alias("head"),
            F.transform(F.coalesce(F.col("content"), nothing), visit).alias("parts"),
        )
        .withColumn(
            "at", F.filter(F.transform("parts", lambda p, i: F.when(p["mark"].isNotNull(), i)), lambda i: i.isNotNull())
        )
        .withColumn("runs", F.transform(F.sequence(F.lit(0), F.size("at")), run))
        .withColumn(
            "within",  # where each attachment begins, by one running sum
            F.aggregate(
                F.transform(
                    "at", lambda i, k: F.length(F.get("runs", k)) + F.when(k > 0, F.length(F.get("parts", F.get("at", k - 1))["mark"])).otherwise(0)
                ),
                none,
                lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)),
            ),
        )
        .select(
            "conv_id", "turn", "role", "head",
            F.array_join(
                F.transform("runs", lambda r, k: F.concat(r, F.coalesce(F.get("parts", F.get("at", k))["mark"], F.lit("")))), ""
            ).alias("body"),
            F.transform(
                "at",
                lambda i, k: F.struct(
                    F.get("parts", i)["type"].alias("type"),
                    F.get("parts", i)["ref"].alias("ref"),
                    i.alias("part_index"),
                    F.get("within", k + 1).alias("within"),
                    F.get("parts", i)["tokens"].alias("tokens"),
                ),
            ).alias("own"),
        )
    )
    whole = flat.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "turn",
                    "role",
                    "body",
                    "head",
                    "own",
                    F.length("head").cast("long").alias("head_chars"),
                    (F.length("head") + F.length("body") + len(TURN_END)).cast("long").alias("chars"),
                )
            ),
        ).alias("turns")
    )
    # starts: code point at which each turn begins, by one running sum over the turns.
    starts = F.aggregate(
        "turns",
        F.array(F.lit(0).cast("long")),
        lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t["chars"])),
    )
    located = whole.select("conv_id", "turns", starts.alias("starts")).select(
        "conv_id",
        F.transform(
            F.arrays_zip("turns", F.slice("starts", 1, F.size("turns")).alias("start")),
            lambda z: F.struct(z["turns"].alias("t"), z["start"].alias("start")),
        ).alias("placed"),
    )
    return located.select(
        "conv_id",
        F.array_join(
            F.transform("placed", lambda z: F.concat(z["t"]["head"], z["t"]["body"], F.lit(TURN_END))), ""
        ).alias("formatted"),
        F.transform(
            F.filter("placed", lambda z: z["t"]["role"] == "assistant"),
            lambda z: F.struct(
                (z["start"] + z["t"]["head_chars"]).alias("start"),
                (z["t"]["chars"] - z["t"]["head_chars"] - len(TURN_END)).alias("length"),
            ),
        ).alias("loss_spans"),
        F.flatten(
            F.transform(
                "placed",
                lambda z, k: F.transform(
                    z["t"]["own"],
                    lambda a: F.struct(
                        a["type"].alias("type"),
                        a["ref"].alias("ref"),
                        k.alias("turn_index"),
                        a["part_index"].alias("part_index"),
                        (z["start"] + z["t"]["head_chars"] + a["within"]).alias("position"),
                        a["tokens"].alias("tokens"),
                    ),
                ),
            )
        ).alias("attachments"),
        F.size("placed").cast("long").alias("n_turns"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation, unescaped."""
    pieces = F.split(formatted, TURN_END, -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda s: F.struct(
            unescaped(F.substring_index(s, ROLE_END, 1).substr(
                F.lit(len(TURN) + 1), F.length(s))).alias("role"),
            unescaped(s.substr(F.instr(s, ROLE_END) + len(ROLE_END), F.length(s))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )
