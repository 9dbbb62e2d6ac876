"""Surrogates for personal data, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Forms of address by gender, syllables and endings by script.
MALE = "Mr|Sir|Herr|Herrn|Señor|Monsieur|Signor|господин|г-н|κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Madame|Mademoiselle|Signora|госпожа|г-жа|κυρία"
EITHER = "Dr|Prof|Professor|Doktor|доктор"
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to",
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то",
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το",
}
ENDINGS = {
    ("latin", "given_male"): "n", ("latin", "given_female"): "a", ("latin", "given"): "el", ("latin", "family"): "ver",
    ("cyrillic", "given_male"): "н", ("cyrillic", "given_female"): "а", ("cyrillic", "given"): "й", ("cyrillic", "family"): "ко",
    ("greek", "given_male"): "ος", ("greek", "given_female"): "α", ("greek", "given"): "ις", ("greek", "family"): "ου",
}

#: A capitalised word without the ``'s`` behind it, white space within a paragraph, and a name: initials and words.
_NAME_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|(?!['’][sS](?!\p{L}))['’-](?=\p{L}))++"
_GAP = r"(?:\h++(?:\R\h*+)?+|\R\h*+)"
_INITIALS = rf"(?:\p{{Lu}}(?:\.{_GAP}?+|{_GAP}))*+"
_NAME = rf"{_INITIALS}{_NAME_WORD}(?:{_GAP}{_INITIALS}{_NAME_WORD})*+"
_ALL = f"{MALE}|{FEMALE}|{EITHER}"
#: Patterns that start at a digit, bracket or plus sign, and at a word; at one place the first that matches counts.
NUMBERS = (
    ("ip", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?:\d{13,19}|\d{4}(?:(?: \d{4}){2} |(?:-\d{4}){2}-)\d{1,7}|\d{4}(?: \d{6} |-\d{6}-)\d{5})(?!\w)"),
    (
        "phone",
        # grouped behind a country code; with an area code; E.164, also with a gap behind the country code; in pairs
        r"(?:\+[2-9]\d{0,2}(?=(?:[ .()-]{0,3}\d){7})(?:[ .-]\d{1,9}|[ .-]?\(\d{1,4}\)[ .-]?\d{1,9}){2,6}"
        r"|\+\d{1,3}[ .-]?\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}|(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
        r"|\+\d{1,3}[ .-]?\d{6,12}|0\d(?:[ .-]\d{2}){4}"
        # without a code: a trunk zero, or three, three and four digits; other groups may be amounts or years
        r"|0\d{1,3}[ .-]\d{3,4}[ .-]?\d{3,4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])(?!\.\d)",
    ),
)
WORDS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,127}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("access_key", r"(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
)
#: First letters of the forms of address: most words need not be held against each of them.
_TITLED = "(?=[" + "".join(sorted({w[0] for w in _ALL.split("|")})) + "])"
_SECRET = r"(?=[apstAPST])(?i:password|passwd|pwd|secret|token|api_?key)"
#: A sentence that goes on in words behind a colon states no secret, but for passwords.
_PROSE = r"(?i:secret|token):\s{1,2}\p{L}++[.!?]?+(?:\s|\z)"
#: A word that makes any groups of digits behind it a phone number.
_PHONE = r"(?=[ptmfPTMF])(?i:phone|tel(?:ephone)?|mobile|fax)\b[.:]{0,2}\s{0,2}"
#: What leads to the entity, and the entity; a secret ends at its quote or delimiter.
LED = (
    (
        "secret", rf"(?!{_PROSE}){_SECRET}\s{{0,2}}[=:]\s{{0,2}}[\"']?",
        r"(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')|[^\s\"',;]{6,}+",
    ),
    ("phone", _PHONE, r"(?=(?:[ .()/+-]{0,3}\d){7})\+?\(?\d{1,15}(?:[ .()/-]{1,2}\d{1,9}){0,6}(?!\w)"),
    ("name_male", rf"{_TITLED}(?:{MALE})\.?{_GAP}", _NAME),
    ("name_female", rf"{_TITLED}(?:{FEMALE})\.?{_GAP}", _NAME),
    ("name", rf"{_TITLED}(?:{EITHER})\.?{_GAP}", _NAME),
)
TYPES = [kind for kind, *_ in (*NUMBERS, *WORDS, *LED)]
_PATTERN = (
    r"(?=[\d(+])(?<![\w.+])(?:" + "|".join(f"({p})" for _, p in NUMBERS) + r")|\b(?:"
    + "|".join(f"({p})" for _, p in WORDS) + "|" + "|".join(f"({lead})({p})" for _, lead, p in LED) + ")"
)
#: Texts without any of these hold no entity.
_HINT = rf"[@0-9]|\b(?:A[KS]IA|{_SECRET}|{_TITLED}(?:{_ALL})\.?[\s\h])"
# Marks round an entity and between its groups; the third escapes all three in a text.
_M, _S, _X = "\ufdd0", "\ufdd1", "\ufdd2"


def _marked(text: Column) -> Column:
    for char, code in ((_X, "c"), (_M, "a"), (_S, "b")):
        text = F.replace(text, F.lit(char), F.lit(_X + code))
    plain = len(NUMBERS) + len(WORDS)
    leads = [plain + 1 + 2 * k for k in range(len(LED))]
    groups = [*range(1, plain + 1), *(k + 1 for k in leads)]
    return F.regexp_replace(
        text, _PATTERN, "".join(f"${k}" for k in leads) + _M + _S.join(f"${k}" for k in groups) + _M
    )


def _unmarked(text: Column) -> Column:
    for char, code in ((_S, "b"), (_M, "a"), (_X, "c")):
        text = F.replace(text, F.lit(_X + code), F.lit(char))
    return text


def _part(kind: Column | None, surface: Column) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), surface.alias("surface"))


def text_parts(text: Column) -> Column:
    """``array<struct<kind, surface>>``: the text cut at its entities; ``kind`` is null between them.

    The words of a name are parts of their own: the last is a family name, those before it and
    initials are given names with the gender of the form of address.
    """
    part = _part
    matched = F.transform(
        F.split(_marked(text), _M, -1),
        lambda p, i: F.when(i % 2 == 0, part(None, p)).otherwise(
            part(
                F.element_at(
                    F.array(*map(F.lit, TYPES)),
                    F.array_position(F.transform(F.split(p, _S, -1), lambda g: g != ""), True).cast("int"),
                ),
                F.replace(p, F.lit(_S), F.lit("")),
            )
        ),
    )

    def named(p: Column) -> Column:
        pieces = F.split(F.regexp_replace(p["surface"], rf"({_NAME_WORD}|\p{{Lu}})", f"{_S}$1{_S}"), _S, -1)
        return F.transform(
            pieces,
            lambda w, i: F.when(i % 2 == 0, part(None, w))
            .when(i == F.size(pieces) - 2, part(F.lit("family"), w))
            .otherwise(part(F.replace(p["kind"], F.lit("name"), F.lit("given")), w)),
        )

    return F.flatten(
        F.transform(matched, lambda p: F.when(p["kind"].startswith("name"), named(p)).otherwise(F.array(p)))
    )


#: Kinds of the words of a name, and where a bare one starts: behind no letter, digit or line, but for an escape.
_NAME_KINDS = ("family", "given_male", "given_female", "given")
_BARE = rf"((?:(?<={_X}[abc])|(?<![\p{{L}}\p{{N}}_])){_NAME_WORD})(?![\p{{N}}_])"


def with_bare_names(parts: Column, surrogates: Column) -> Column:
    """``parts`` with the bare mentions of names that ``surrogates`` holds, keyed by kind and value, as parts of their own."""

    def cut(p: Column) -> Column:
        def bare(w: Column) -> Column:
            keys = [(kind, F.concat(F.lit(kind + "\0"), F.lower(w))) for kind in _NAME_KINDS]
            return F.coalesce(*(F.when(F.map_contains_key(surrogates, key), F.lit(kind)) for kind, key in keys))

        pieces = F.split(F.regexp_replace(p["surface"], _BARE, f"{_S}$1{_S}"), _S, -1)
        return F.transform(pieces, lambda w, i: _part(F.when(i % 2 == 1, bare(w)), w))

    return F.flatten(F.transform(parts, lambda p: F.when(p["kind"].isNull(), cut(p)).otherwise(F.array(p))))


def canonical(kind: Column, surface: Column) -> Column:
    """What two mentions of one entity have in common: digits of numbers, lower case of names and addresses."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(surface, "[^0-9]", ""))
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
        .when(kind.isin("secret", "access_key", "ip"), surface)
        .otherwise(F.lower(surface))
    )


def _number(digest: Column, at: Column, modulus: int) -> Column:
    """A number below ``modulus`` from four hex digits of the digest, round and round."""
    return F.conv(F.substring(digest, (at * 3) % 124 + 1, F.lit(4)), 16, 10).cast("int") % modulus


def _alike(text: Column, hexadecimal: Column, signs: Column, digest: Column) -> Column:
    """Digits for digits and letters for letters of the same case; hexadecimal strings stay so.

    Signs stay, or are letters and digits where ``signs`` is true.
    """
    pick = lambda letters, i: F.substring(
        F.lit(letters), _number(digest, i, len(letters)) + 1, F.lit(1)
    )
    return F.array_join(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c, i: F.when(hexadecimal, pick("0123456789abcdef", i))
            .when(c.rlike("[0-9]"), pick("0123456789", i))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
            .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", i))
            .when(signs, pick("abcdefghijklmnopqrstuvwxyz0123456789", i))
            .otherwise(c),
        ),
        "",
    )


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def _luhn(digits: Column) -> Column:
    """Sum of a digit string by Luhn's rule; a valid number's is a multiple of ten."""
    return F.aggregate(
        F.transform(
            F.reverse(_digits(digits)),
            lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda s, d: s + d,
    )


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's number, letters counting 10 to 35."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def with_draw(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, value, attempt)`` with ``drawn``, a canonical surrogate.

    It has the kind, gender, script, length and check digits of the value. What has few draws
    of its own shape gets more with the attempts: signs of secrets are drawn too, at once if there
    is nothing else, secrets and addresses get longer, IP addresses come from a larger block.
    What several formats need is a column of its own, so that it is worked out once per row.
    """
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    salted = F.concat_ws("\0", F.lit(key), kind, value, attempt.cast("string"))
    domain = F.substring_index(value, "@", -1)
    digest, alike, free, body = (F.col(c) for c in ("digest", "alike", "free", "body"))
    entities = (
        entities.withColumn("digest", F.concat(F.sha2(salted, 256), F.sha2(F.concat(salted, F.lit("\0more")), 256)))
        .withColumn("shape", F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(value))
        .withColumn("hexadecimal", (kind == "secret") & F.col("shape").rlike("^[0-9a-f]+$"))
        .withColumn("signs", (kind == "secret") & ((attempt > 1) | ~F.col("shape").rlike(r"[0-9\p{L}]")))
        .withColumn("alike", _alike(F.col("shape"), F.col("hexadecimal"), F.col("signs"), digest))
        .withColumn("longer", F.concat(alike, F.substring(digest, F.lit(65), F.greatest(attempt - 2, F.lit(0)))))
        .withColumn(
            "free", F.concat(F.substring(value, 1, 1), F.substring(alike, F.lit(2), F.length(value) - 2))
        )
        .withColumn(
            "body", F.concat(F.substring(value, 1, 2), F.lit("00"), F.substring(alike, F.lit(5), F.length(value)))
        )
    )
    end = F.substring_index(domain, ".", -1)
    email = F.concat(
        F.col("longer"), F.lit("@m"), F.substring(F.sha2(F.concat_ws("\0", F.lit(key), F.lit("domain"), domain), 256), 1, 8),
        F.lit(".example."), F.when(end.isin("com", "net", "org"), end).otherwise("com"),
    )
    block = F.when(attempt > 2, _number(digest, F.lit(0), 16) + 240).otherwise(10).cast("string")
    ip = F.concat(block, *(F.concat(F.lit("."), _number(digest, F.lit(k), 256).cast("string")) for k in (1, 2, 3)))
    card = F.when(
        _luhn(value) % 10 == 0,
        F.concat(free, ((10 - _luhn(F.concat(free, F.lit("0"))) % 10) % 10).cast("string")),
    ).otherwise(F.concat(F.substring(value, 1, 1), F.substring(alike, F.lit(2), F.length(value))))
    # a country code of up to three digits stays; the subscriber's number starts with 2 to 9
    lead = F.least(F.greatest(F.length(value) - 10, F.lit(0)), F.lit(3))
    phone = F.concat(
        F.substring(value, F.lit(1), lead), (_number(digest, F.lit(0), 8) + 2).cast("string"),
        F.substring(alike, lead + 2, F.length(value)),
    )
    iban = F.concat(
        F.substring(value, 1, 2), F.lpad((98 - _mod97(body)).cast("string"), 2, "0"), F.substring(body, F.lit(5), F.length(value))
    )
    key_id = F.concat(F.substring(value, 1, 4), F.upper(F.substring(alike, F.lit(5), F.length(value))))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    sounds = F.lit(None).cast("array<string>")
    for alphabet, spoken in SYLLABLES.items():
        sounds = F.when(script == alphabet, F.array(*map(F.lit, spoken.split()))).otherwise(sounds)
    ending = F.lit(None).cast("string")
    for (alphabet, sort), letters in ENDINGS.items():
        ending = F.when((script == alphabet) & (kind == sort), letters).otherwise(ending)
    name = F.concat(
        F.array_join(
            F.transform(
                F.sequence(F.lit(0), 2 + attempt),
                lambda i: F.element_at(sounds, _number(digest, i, len(SYLLABLES["latin"].split())) + 1),
            ),
            "",
        ),
        ending,
    )
    drawn = (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(alike, 2, 8))).when(kind == "iban", iban)
        .when(kind == "access_key", key_id).when(kind == "secret", F.col("longer")).otherwise(name)
    )
    return entities.select("kind", "value", "attempt", drawn.alias("drawn"))


def rendered(kind: Column, surface: Column, value: Column) -> Column:
    """The canonical surrogate ``value`` in the form of a mention: its punctuation, spaces and case."""
    chars = F.filter(F.split(surface, ""), lambda c: c != "")
    poured = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                c.rlike("[0-9A-Z]"),
                F.substring(value, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    cased = (
        F.when((kind != "family") & (F.length(surface) == 1), F.upper(F.substring(value, 1, 1)))
        .when((F.upper(surface) == surface) & (F.length(surface) > 1), F.upper(value))
        .when(F.lower(surface) == surface, value)
        .otherwise(F.initcap(value))
    )
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), poured)
        .when(kind.isin("ip", "secret", "access_key"), value)
        .when(kind == "email", F.when(F.upper(surface) == surface, F.upper(value)).otherwise(value))
        .otherwise(cased)
    )


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``entities(kind, value)``: no two of a kind share one.

    Each round draws a keyed surrogate for the entities still without one. Of those that
    drew the same, that with the least keyed hash gets it; draws that another entity has
    already, or that are themselves a value found in the corpus, go to the next round with
    another draw. Each check is a minimum per draw and anti joins on keys that are never hot.
    """
    taken: list[DataFrame] = []
    open_ = materialize(entities.withColumn("attempt", F.lit(0)), "entities")
    values = open_.select("kind", F.col("value").alias("drawn"))
    while not open_.isEmpty():
        drawn = materialize(with_draw(open_, key), "draws")
        order = F.struct(F.sha2(F.concat_ws("\0", F.lit(key), "value"), 256), "value")
        won = drawn.groupBy("kind", "drawn").agg(F.min(order)["value"].alias("value"))
        for other in [values, *(t.select("kind", F.col("surrogate").alias("drawn")) for t in taken)]:
            won = won.join(other, ["kind", "drawn"], "left_anti")
        won = materialize(won.select("kind", "value", F.col("drawn").alias("surrogate")), "surrogates")
        taken.append(won)
        open_ = materialize(
            open_.join(won, ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "entities"
        )
    if not taken:
        return open_.select("kind", "value", F.lit("").alias("surrogate"))
    return reduce(DataFrame.union, taken)


def replace_personal_data(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with every entity of ``text_column`` replaced, and ``n_entities``, the mentions replaced.

    Patterns find e-mail and IP addresses, phone, card and social security numbers, IBANs,
    keys and secrets, names behind a form of address, and other mentions of such a name's words
    in its document; of an initial's surrogate the first letter is shown. An entity (:func:`canonical`) has one
    surrogate in the whole corpus, whatever the form of its mentions; two entities of a kind
    never share one and no surrogate is itself an entity of the corpus (:func:`assign_surrogates`).
    Without ``key`` surrogates cannot be drawn again.

    Only ids and entities are shuffled, and the texts that hold an entity once. Texts without
    one pass as they are. Null texts stay null, other columns are kept; a column called
    ``n_entities`` is replaced. Rows that share an id, a null one too, are each replaced whole.
    """
    text = F.col(text_column)
    columns = [c for c in docs.columns if c != "n_entities"]
    hinted = F.coalesce(text.rlike(_HINT), F.lit(False))
    parts = text_parts(text)
    rest = docs.where(~hinted).select(*columns, F.lit(0).cast("long").alias("n_entities"))
    found = F.filter(parts, lambda p: p["kind"].isNotNull())
    mentions = materialize(
        docs.where(hinted).select(F.col(id_column).alias("_id"), F.explode(found).alias("e"))
        .select("_id", "e.kind", canonical(F.col("e.kind"), F.col("e.surface")).alias("value")).distinct(),
        "mentions",
    )
    chosen = materialize(assign_surrogates(mentions.select("kind", "value").distinct(), key), "chosen")
    by_document = mentions.join(chosen, ["kind", "value"]).groupBy("_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("\0", "kind", "value").alias("key"), "surrogate"))
        ).alias("_surrogates")
    )

    def shown(p: Column) -> Column:
        value = F.element_at("_surrogates", F.concat_ws("\0", p["kind"], canonical(p["kind"], p["surface"])))
        return F.when(p["kind"].isNull(), _unmarked(p["surface"])).otherwise(rendered(p["kind"], p["surface"], value))

    held = docs.where(hinted).join(by_document, F.col(id_column).eqNullSafe(F.col("_id")), "left").select(
        *columns, "_surrogates", F.when(F.col("_surrogates").isNotNull(), parts).alias("_parts")
    )
    named = F.exists(F.map_keys("_surrogates"), lambda k: k.startswith("family\0"))
    held = held.withColumn(
        "_parts", F.when(named, with_bare_names(F.col("_parts"), F.col("_surrogates"))).otherwise(F.col("_parts"))
    )
    replaced = held.select(
        *(
            F.when(F.col("_parts").isNull(), text)
            .otherwise(F.array_join(F.transform("_parts", shown), "")).alias(text_column)
            if c == text_column else F.col(c)
            for c in columns
        ),
        F.size(F.filter("_parts", lambda p: p["kind"].isNotNull())).cast("long").alias("n_entities"),
    )
    return replaced.withColumn("n_entities", F.greatest("n_entities", F.lit(0).cast("long"))).union(rest)
