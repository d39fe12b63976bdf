"""Personal data replaced by keyed surrogates of the same kind, in DataFrame operations alone.

Digits become digits and letters letters of the same script and case; separators, country codes, e-mail
endings, titles, name particles stay, and check digits that are valid stay valid. Within a format the replacement
is a keyed bijection (each character is shifted by a hash of the key and all characters before it, from both ends),
so different entities get different surrogates. Names are found behind a title; each part of a name is an entity of
its own, whatever its title, its case and its place, and further mentions of such a part in the same document, without a
title, are replaced too. Parts are rebuilt from syllables, with an ending that suits the gender of the titles under
which they are given names. A check over all distinct entities finds surrogates that coincide with each other or with
an entity of the corpus and draws those again, in an ever larger space, until none is left. The same entity has the
same surrogate in every document. Names that no title precedes anywhere in their document are out of scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import dropped, scratch, stored

#: Patterns by kind; the first that fits at a place counts.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE = r"Mr|MR|Mister|Herrn?|HERR|Monsieur|M|Señor|Sr|SR|Don|Sir|г-н|господин|κύριος"
_FEMALE = r"Mrs|MRS|Ms|MS|Miss|Frau|FRAU|Madame|Mme|MME|Mlle|Señorita|Señora|Srta|Sra|SRA|Doña|г-жа|госпожа|κυρία"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|Mx|Dr|DR|Doctor|Prof|Professor|Rev)\.?"
#: A part of a name (an initial among them), what may stand before one, and the entities within parts.
_PART = r"\p{Lu}(?:\.(?= )|[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*)"
_PARTICLES = r"(?:(?:van|von|vom|zu|de|der|den|del|della|di|da|dos|du|la|le|bin|al) )*"
_TOKEN = r"(?:\p{Lu}|(?<=-)\p{L})[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*"
KINDS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9_+%-]+(?:\.[A-Za-z0-9_+%-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,100})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|[.-]\d)",
    "phone": r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])(?:\d{2,4}[ .-]?){1,3}\d{2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\+\d{10,14})(?!\w|[.-]\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?!\w|[.-]\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE} )+{_PARTICLES}{_PART}(?: {_PARTICLES}{_PART})*(?![\p{{L}}\p{{N}}])",
}
#: Characters that kinds can begin with, which spares most places of a text the kinds' own patterns.
_STARTS = {"email": "[A-Za-z0-9_+%-]", "secret": "[0-9A-Fa-fgpsx]", "iban ip card phone ssn": "[0-9A-Z+(]", "name": "[DFHMPRSгκ]"}
PATTERN = "|".join(f"(?={start})(?:{'|'.join(f'(?:{KINDS[k]})' for k in kinds.split())})" for kinds, start in _STARTS.items())
#: Texts without any of this hold nothing that the patterns fit: all but names and some secrets have a digit or an @.
_HINT = rf"[0-9@]|(?=[DFHMPRSгκ])(?<![\p{{L}}\p{{N}}]){_TITLE} |(?=[A-Fa-fgpsx])(?<![A-Za-z0-9])(?:[A-Fa-f]{{32}}|AKIA|ASIA|(?:sk|pk|gh[po]|xox[bp])[-_])"
#: Least letters of a name's part for which mentions without a title are sought.
MENTION = 3

# First and last code points of the alphabets whose letters stand for one another.
ALPHABETS = [(48, 57), (97, 122), (65, 90), (0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C1), (0x3C3, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9)]
#: Syllables of invented names by script: consonants and vowels, then the endings for either gender.
NAMES = {"latin": ("bdfgklmnprstvz", "aeiou", ("n", "s"), ("na", "lia")), "cyrillic": ("бвгдклмнпрст", "аеиоу", ("н", "ор"), ("на", "ия")), "greek": ("βγδκλμνπρστ", "αειου", ("ος", "ης"), ("νη", "ία"))}


def _hash(*parts: Column | str) -> Column:
    """A non-negative whole number under 2^60 from the digest of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _shifted(text: Column, salt: Column, hexadecimal: Column) -> Column:
    """Every character moved within its alphabet (if hexadecimal: 0-9a-f) by a hash of the salt and those before it."""

    alphabets = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high - low + 1).alias("size")) for low, high in ALPHABETS])
    sixteen = F.lit("0123456789abcdef")

    def step(state: Column, char: Column) -> Column:
        point = F.ascii(char)
        drawn = _hash(salt, state["seen"])
        own = F.get(F.filter(alphabets, lambda a: (point >= a["low"]) & (point < a["low"] + a["size"])), 0)
        moved = F.when(state["hex"], F.substr(sixteen, (F.pmod(F.instr(sixteen, char) - 1 + drawn, F.lit(16)) + 1).cast("int"), F.lit(1))).otherwise(
            F.coalesce(F.get(F.transform(F.filter(F.array(own), lambda a: a.isNotNull()), lambda a: _char(a["low"] + F.pmod(point - a["low"] + drawn, a["size"]))), 0), char)
        )
        return F.struct(F.concat(state["seen"], char).alias("seen"), F.concat(state["out"], moved).alias("out"), state["hex"].alias("hex"))

    start = F.struct(F.lit("").alias("seen"), F.lit("").alias("out"), hexadecimal.alias("hex"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: s["out"])


def _char(point: Column) -> Column:
    """The character of a code point under 0x800."""
    two = F.decode(F.unhex(F.concat(F.hex((F.lit(0xC0) + F.shiftright(point, 6)).cast("long")), F.hex((F.lit(0x80) + point.bitwiseAND(63)).cast("long")))), "UTF-8")
    return F.when(point < 128, F.chr(point.cast("long"))).otherwise(two)


def _scrambled(text: Column, salt: Column, hexadecimal: Column) -> Column:
    return F.reverse(_shifted(F.reverse(_shifted(text, F.concat(salt, F.lit("1")), hexadecimal)), F.concat(salt, F.lit("2")), hexadecimal))


def _luhn(digits: Column) -> Column:
    """The check digit of a number without one."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(2).alias("by")),
        lambda s, d: F.struct((s["sum"] + F.floor(d.cast("int") * s["by"] / 10).cast("int") + (d.cast("int") * s["by"]) % 10).alias("sum"), (F.lit(3) - s["by"]).alias("by")), lambda s: s["sum"],
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _octets(text: Column, salt: Column) -> Column:
    def step(state: Column, octet: Column) -> Column:
        moved = F.pmod(octet.cast("int") + _hash(salt, F.array_join(state["seen"], ".")), F.lit(256)).cast("string")
        return F.struct(F.concat(state["seen"], F.array(octet)).alias("seen"), F.concat(state["out"], F.array(moved)).alias("out"))

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(text, r"\."), F.struct(empty.alias("seen"), empty.alias("out")), step, lambda s: s["out"]), ".")


def _word(salt: Column, script: Column, gender: Column, syllables: int) -> Column:
    """An invented name; gender: m, f, or anything else for an ending of either kind."""
    out = F.lit(None).cast("string")
    for name, (consonants, vowels, male_ends, female_ends) in NAMES.items():

        def pick(signs, place: int, name: str = name) -> Column:
            return F.element_at(F.array(*map(F.lit, signs)), (_hash(salt, F.lit(f"{name}{place}")) % len(signs) + 1).cast("int"))

        parts = [pick(signs, 2 * k + j) for k in range(syllables) for j, signs in enumerate((consonants, vowels))]
        end = F.when(gender == "f", pick(female_ends, -1)).when(gender == "m", pick(male_ends, -1)).otherwise(pick((*male_ends, *female_ends), -1))
        out = F.when(script == name, F.initcap(F.concat(*parts, end))).otherwise(out)
    return out


def _remainder97(text: Column) -> Column:
    """The number that an IBAN's characters spell (A is 10, Z is 35), modulo 97."""

    def step(state: Column, char: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), char) - 1
        return (state * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(entity: Column, salt: Column) -> Column:
    no = F.lit(False)
    country, account = entity.substr(1, 2), entity.substr(F.lit(5), F.length(entity))
    valid = _remainder97(F.concat(account, entity.substr(1, 4))) == 1
    moved = _scrambled(account, F.concat(salt, country), no)
    digits = F.lpad((98 - _remainder97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, F.concat(country, digits, moved)).otherwise(F.concat(country, _scrambled(entity.substr(F.lit(3), F.length(entity)), salt, no)))


def surrogate(entity: Column, kind: Column, gender: Column, key: str, attempt: int) -> Column:
    """The replacement of a normalised entity; every attempt draws anew, names and e-mails from a larger space."""
    salt = F.concat_ws("\x1e", F.lit(key), kind, F.lit(str(attempt)))
    no = F.lit(False)
    digits = F.regexp_replace(entity, r"\D", "")
    local, domain = F.regexp_extract(entity, "^(.*)@", 1), F.regexp_extract(entity, "@(.*)$", 1)
    host, ending = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    more = F.translate(F.substring(F.sha2(F.concat_ws("\x1f", salt, entity).cast("binary"), 256), 1, max(0, attempt - 3)), "0123456789", "ghijklmnop")
    email = F.concat(_scrambled(local, F.concat_ws("@", salt, domain), no), more, F.lit("@"), _scrambled(host, F.concat_ws("@", F.lit(key), F.lit("host"), ending), no), ending)
    prefix = F.regexp_extract(entity, r"^(AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[-_]|)", 1)
    is_hex = entity.rlike("^[0-9a-f]+$")
    secret = F.concat(prefix, _scrambled(entity.substr(F.length(prefix) + 1, F.length(entity)), salt, is_hex))
    head = digits.substr(F.lit(1), F.length(digits) - 1)
    valid = _luhn(head) == digits.substr(F.length(digits), F.lit(1))
    moved_head = _scrambled(head, F.concat(salt, F.lit("luhn")), no)
    card = F.when(valid, F.concat(moved_head, _luhn(moved_head))).otherwise(_scrambled(digits, salt, no))
    country = F.regexp_extract(entity, r"^(\+\d{1,3})[ .(-]", 1)
    phone = F.concat(country, _scrambled(entity.substr(F.length(country) + 1, F.length(entity)), F.concat(salt, country), no))
    ip = F.array_join(F.reverse(F.split(_octets(F.array_join(F.reverse(F.split(_octets(entity, F.concat(salt, F.lit("1"))), r"\.")), "."), F.concat(salt, F.lit("2"))), r"\.")), ".")
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    shape = F.regexp_extract(entity, r"^(\p{L}['’]|)", 1)  # O'Brien stays an O'
    part = F.concat(F.initcap(shape), _word(F.concat_ws("/", salt, entity), script, gender, min(3 + attempt, 10)))
    plain = _scrambled(entity, salt, no)
    out = plain
    for name, made in {"email": email, "secret": secret, "card": card, "phone": phone, "iban": _iban(entity, salt), "ip": ip, "part": part}.items():
        out = F.when(kind == name, made).otherwise(out)
    return out


def normalised(raw: Column, kind: Column) -> Column:
    """What makes two spellings one entity: all but case in e-mails, hexadecimal secrets and names, cards without separators."""
    hexadecimal = raw.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    folded = kind.isin("email", "part", "initial") | (kind == "secret") & hexadecimal
    return F.when(folded, F.lower(raw)).when(kind == "card", F.regexp_replace(raw, r"\D", "")).when(kind == "iban", F.replace(raw, F.lit(" "))).otherwise(raw)


def _dressed(made: Column, raw: Column, kind: Column) -> Column:
    """The surrogate in the spelling of one occurrence: its case, and its separators."""
    cased = F.when(raw == F.upper(raw), F.upper(made)).otherwise(made)
    place = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, char: Column) -> Column:
        sign = char.rlike("[A-Z0-9]")
        return F.struct(F.concat(state["out"], F.when(sign, made.substr(state["at"], F.lit(1))).otherwise(char)).alias("out"), (state["at"] + sign.cast("int")).alias("at"))

    split_up = F.aggregate(F.split(raw, ""), place, step, lambda s: s["out"])
    shouted = F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(made)).when(raw == F.lower(raw), F.lower(made)).otherwise(made)
    return F.when(kind.isin("card", "iban"), split_up).when(kind.isin("email", "secret"), cased).when(kind == "part", shouted).when(kind == "initial", F.upper(made)).otherwise(made)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, made) for distinct (kind, entity, gender): different for different entities, and no entity itself.

    Surrogates that clash are drawn again, round by round, until there are none. An initial stands for too few
    letters for that; it is a letter moved by the key.
    """
    keys = ["kind", "entity"]
    entities = stored(entities.select(*keys, "gender"), "pii-entities")

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        return rows.select(*keys, "gender", surrogate(F.col("entity"), F.col("kind"), F.col("gender"), key, attempt).alias("made"))

    state, attempt = stored(drawn(entities, 0), "pii-surrogates"), 0
    while True:
        attempt += 1
        # An entity's own case and spacing may differ from its surrogate's; what counts is the normalised form.
        named = state.where("kind <> 'initial'").select(*keys, normalised(F.col("made"), F.col("kind")).alias("form"))
        twice = named.groupBy("kind", "form").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "form", "first")
        bad = named.join(stored(twice, "pii-twice"), ["kind", "form"]).where("entity <> first").select(*keys)
        bad = stored(bad.union(named.join(entities.select("kind", F.col("entity").alias("form")), ["kind", "form"], "left_semi").select(*keys)).distinct(), "pii-collisions")
        if bad.isEmpty():
            return state.select(*keys, "made")
        again = drawn(state.join(bad, keys, "left_semi"), attempt)
        before, state = state, stored(state.join(bad, keys, "left_anti").unionByName(again), "pii-surrogates")
        dropped(before)


def _untitled(name: Column) -> Column:
    return F.regexp_extract(name, rf"^(?:{_TITLE} )+(.*)$", 1)


def _mentions(first: Column) -> Column:
    """The pattern for a text in which PATTERN finds ``first``, if that has names: their parts are sought without a title too."""
    names = F.filter(first, lambda x: x.rlike(rf"^{_TITLE} "))
    parts = F.array_distinct(F.flatten(F.transform(names, lambda x: F.regexp_extract_all(_untitled(x), F.lit(f"({_TOKEN})"), F.lit(1)))))
    parts = F.array_sort(F.filter(parts, lambda x: F.length(x) >= MENTION))
    forms = F.array_join(F.concat(parts, F.transform(parts, F.upper)), "|")
    return F.when(F.size(parts) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), forms, F.lit(r")(?![\p{L}\p{N}])")))


def _units(raw: Column, kind: Column) -> Column:
    """What is replaced within an occurrence: structs of kind, the text, the gender it tells, and what stands around it."""
    title = F.regexp_extract(raw, rf"^((?:{_TITLE} )+)", 1)
    rest = F.when(title != "", raw.substr(F.length(title) + 1, F.length(raw))).otherwise(raw)
    gender = F.when(title.rlike(rf"(?:^| )(?:{_FEMALE})\.? "), "f").when(title.rlike(rf"(?:^| )(?:{_MALE})\.? "), "m")
    parts, between = F.regexp_extract_all(rest, F.lit(f"({_TOKEN})"), F.lit(1)), F.split(rest, _TOKEN, -1)

    def unit(part: Column, at: Column) -> Column:
        last = at == F.size(parts) - 1
        return F.struct(
            F.when(F.length(part) == 1, "initial").otherwise("part").alias("kind"), part.alias("raw"), F.when(~last, gender).alias("gender"),
            F.concat(F.when(at == 0, title).otherwise(""), F.get(between, at)).alias("before"), F.when(last, F.get(between, at + 1)).otherwise("").alias("after"),
        )

    whole = F.array(F.struct(kind.alias("kind"), raw.alias("raw"), F.lit(None).cast("string").alias("gender"), F.lit("").alias("before"), F.lit("").alias("after")))
    return F.when(kind == "name", F.transform(parts, unit)).otherwise(whole)


def replaced(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with every detected entity replaced, and n_entities (long), the number of occurrences in the row.

    A column n_entities of docs is replaced; other columns may have any names. Null and empty texts, and texts without
    an entity, stay as they are, with 0. Texts may be of any length, ids null or repeated, rows repeated; no rows
    give no rows. The text's rows meet their surrogates by a join on id and text hash; only rows with an entity
    take part in it.
    """
    docs = docs.drop("n_entities")
    names = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text, ident = F.col("row")[text_column], F.col("row")[id_column]
    marked = marked.withColumn("first", F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)))).withColumn("pattern", _mentions(F.col("first")))
    again = F.regexp_extract_all(text, F.concat(F.lit("("), "pattern", F.lit(")")), F.lit(1))
    marked = marked.withColumn("found", F.when(F.col("pattern").isNull(), F.col("first")).otherwise(again))
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    place = [ident.alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("size")]
    where = ["id", "hash", "size"]
    with scratch(docs.sparkSession) as result:
        seen = marked.where(has).select(*place, F.posexplode("found").alias("at", "occurrence"))
        seen = seen.select(*where, "at", F.posexplode(_units(F.col("occurrence"), kind_of(F.col("occurrence")))).alias("n", "unit")).select(*where, "at", "n", "unit.*")
        seen = stored(seen.withColumn("entity", normalised(F.col("raw"), F.col("kind"))).distinct(), "pii-seen")
        low, high = F.min("gender"), F.max("gender")
        made = surrogates(seen.groupBy("kind", "entity").agg(F.when(low == high, low).alias("gender")), key)
        piece = F.concat("before", _dressed(F.col("made"), F.col("raw"), F.col("kind")), "after")
        dressed = seen.join(made, ["kind", "entity"]).select(*where, "at", "n", piece.alias("piece"))
        each = dressed.groupBy(*where, "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("new"))
        by_row = result(each.groupBy(*where).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new")), "pii-by-row")
    hit = marked.where(has).select("row", "pattern", *[c.alias(f"own_{n}") for c, n in zip(place, where, strict=True)])
    hit = hit.join(by_row, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")) & (F.col("own_size") == F.col("size")))
    between = F.when(F.col("pattern").isNull(), F.split(text, PATTERN, -1)).otherwise(F.split(text, F.col("pattern"), -1))
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("a"), F.col("new").alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    rest = [F.col("row")[c].alias(c) for c in names]
    hit = hit.select(*[joined.alias(c) if c == text_column else r for c, r in zip(names, rest, strict=True)], F.size("new").cast("long").alias("n_entities"))
    return hit.unionByName(marked.where(~has).select(*rest, F.lit(0).cast("long").alias("n_entities")))
