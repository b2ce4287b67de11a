"""Surrogates for private data (DataFrame functions only).

Patterns find e-mail and IP addresses, phone and card numbers, identity numbers, keys, secrets with their
labels, and names after a title.  Every entity is replaced by one of its own kind and form: digits by
digits, letters by letters of their case and script, octets by octets, card numbers with a right check
digit, names by names of the title's gender and the word's script.  The choice is a keyed hash of the
entity's canonical form, so equal entities get equal surrogates in all documents (an e-mail in any case,
a phone number in any format below, an IPv6 address in any spelling, a surname with or without given name).

Distinct entities are checked together: of several with one surrogate all but the first in code point
order, and every one whose surrogate is somebody's real entity, draw again until none is left.  Names are
checked word by word, given names by gender and surnames, so different whole names stay different.  After
some draws of the entity's own length every further one is longer (an IPv4 address gets an IPv6 one), so
a form space that is full ends the search too.  The replacements of its entities are joined to each text
that has some.

Not found, as nothing tells them from other numbers and words: phone numbers without '+', brackets or
separators (7435553824), cards of 15 digits that start with 1 or 2131, secrets without a label other than
AWS key ids, or shorter than 8 signs, and names without a title.  A secret goes on through ASCII letters,
digits and the signs _SIGNS.  It has a letter or a digit: lines and dots to be filled in ('password: ________') stay.

A null text stays null, an empty one empty; texts without entities are returned as they are.  Rows are
treated by themselves, equal texts alike; other columns are kept, columns named like a result replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import free, kept, small

# So many draws keep the length of the form; every later one has WIDER more digits than the one before.
DRAWS = 12
WIDER = 4
# Titles by gender, given names by gender and script (of the first draw), the syllables of further
# given names and of surnames, and the endings of further given names.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н"]
GIVEN = {
    ("f", "latin"): ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"],
    ("m", "latin"): ["Adam", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Nico", "Otto", "Paul"],
    ("f", "cyrillic"): ["Алла", "Вера", "Дарья", "Жанна", "Инна", "Лидия", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Глеб", "Иван", "Кирилл", "Максим", "Олег", "Павел"],
}
SYLLABLES = {
    "latin": ["bar", "bel", "den", "dor", "fal", "fen", "gar", "hol", "kan", "kel", "lan", "lor", "mar", "mel", "nor", "pol", "ran", "rod", "sel", "tan", "tor", "val", "ven", "wal"],
    "cyrillic": ["бар", "бел", "вол", "дор", "зар", "кал", "лан", "мар", "нов", "пол", "рад", "сел", "тар", "фен"],
}

ENDINGS = {("f", "latin"): "a", ("m", "latin"): "o", ("f", "cyrillic"): "а", ("m", "cyrillic"): "о"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}[\p{Ll}'’-]+"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_GROUPS = rf"{_GROUP}(?::{_GROUP})"
# Labels of secrets in any case and after any prefix (client_secret, AWS_SECRET_ACCESS_KEY), with the quotes of JSON.
_LABELS = r"(?i:token|password|passwd|passphrase|pwd|secret|(?:api|access|secret|private|auth)[_ -]?key)(?i:[_-]?(?:access[_-]?)?key)?"
_LABEL = rf"{_LABELS}[\"']?\s{{0,3}}+[=:]{{1,2}}+>?+\s{{0,3}}+[\"']?+"
_SIGNS = r"_/+.=~@!#$%^*-"
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    rf"(?=[TPSAtpsa]){_LABEL}(?=[{_SIGNS}]*[A-Za-z0-9])[A-Za-z0-9{_SIGNS}]{{7,}}[A-Za-z0-9_/+=~@#$%^*-]",
    r"\bA[KS]IA[0-9A-Z]{16}\b",
    # IPv6: eight groups, or fewer with '::' between a first group of four or several; never words of letters only.
    rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:{_GROUPS}{{7}}|{_GROUPS}{{1,6}}::(?:{_GROUPS}{{0,5}})?"
    rf"|[0-9A-Fa-f]{{4}}::(?:{_GROUPS}{{0,6}})?|::{_GROUPS}{{1,6}})(?![\p{{L}}\p{{N}}:]|\.\d)",
    rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # Phones: three digits in brackets, +1 with ten digits, + with 8 to 15 digits however grouped, short ones in groups.
    r"(?:(?:\+\d{1,3}|(?<![\d.-])1)[ .-]?)?(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\p{L}\p{N}+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\p{L}\p{N}+])\+[1-9](?:(?:[ .-]|[ .-]?\(|\)[ .-]?)?\d){7,14}(?!\d)",
    r"\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)",
    r"(?<![\d.-])(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?!\d|[.-]\d)",
    r"(?<![\p{L}\d.-])(?:1 )?[2-9]\d\d[ ./-][2-9]\d\d[ .-]\d{4}(?!\d|[.-]\d)",
    # Cards: groups of four up to 19 digits, or 4-6-5 and 4-6-4; first digits 3 to 6, 2221 to 2720 and 2200 to 2204.
    r"(?<![\d.-])6\d{3}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}(?!\d|[.-]\d)",
    r"(?<![\d.-])(?:[3-6]\d{3}|22[3-9]\d|222[1-9]|2[3-6]\d\d|27[01]\d|2720|220[0-4])([ -]?)\d{4}\2\d{4}\2\d{1,7}(?!\d|[.-]\d)",
    r"(?<![\d.-])3\d{3}([ -])\d{6}\3\d{4,5}(?!\d|[.-]\d)",
    rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE)})\.? {_NAME}(?: {_NAME}){{0,2}}",
])
# What a text needs at least to hold an entity: a cheap look before the patterns.
HINT = rf"[0-9@]|(?:{'|'.join(FEMALE + MALE)})\.? \p{{Lu}}|\bA[KS]IA[A-Z]{{16}}|{_LABELS}[\"']?\s{{0,3}}[=:]"


def find(text: Column) -> Column:
    """The entities of a text from left to right, and numbers that ``genuine`` takes out."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^0-9]", "")


def kind(entity: Column) -> Column:
    titled = "|".join(FEMALE + MALE)
    return (
        F.when(entity.rlike(rf"^{_LABEL}"), "secret")
        .when(entity.contains("@"), "email")
        .when(entity.rlike(r"^A[KS]IA[0-9A-Z]{16}$"), "key")
        .when(entity.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | entity.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip")
        .when(entity.rlike(rf"^(?:{titled})\.? "), "name")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "identity")
        .when((F.length(_digits(entity)) >= 13) & entity.rlike(r"^[2-6][\d -]+$"), "card")
        .otherwise("phone")
    )


def _long(address: Column) -> Column:
    """An IPv6 address in eight groups of four small hexadecimal digits."""
    sides = F.split(F.lower(address), "::")
    before, after = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(before) - F.size(after))
    return F.array_join(F.transform(F.concat(before, zeros, after), lambda g: F.lpad(g, 4, "0")), ":")


def with_parts(entities: DataFrame) -> DataFrame:
    """``entity, kind, label, parts``: the replaced parts of an entity as structs of kind and canonical form.

    Entities are few next to the texts; one step per column keeps the expressions small.
    """
    label = F.when(F.col("kind") == "secret", F.regexp_extract("entity", rf"^{_LABEL}", 0)).when(
        F.col("kind") == "name", F.regexp_extract("entity", r"^\S+ ", 0)).otherwise(F.lit(""))
    value = F.expr("substring(entity, length(label) + 1)")
    form = (
        F.when(F.col("kind") == "email", F.lower("entity"))
        .when(F.col("kind") == "phone", F.right(_digits(F.col("entity")), F.lit(10)))
        .when(F.col("kind").isin("card", "identity"), _digits(F.col("entity")))
        .when((F.col("kind") == "ip") & F.col("entity").contains(":"), _long(F.col("entity")))
        .otherwise(F.col("_value"))
    )
    female = F.col("entity").rlike(rf"^(?:{'|'.join(FEMALE)})\.? ")
    given = F.when(female, F.lit("given-f")).otherwise(F.lit("given-m"))
    words = F.split("_value", " ")
    names = F.transform(words, lambda word, i: F.struct(
        F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.col("_given")).alias("kind"), word.alias("form")))
    made = entities.select("entity", kind(F.col("entity")).alias("kind")).withColumn("label", label)
    made = made.withColumn("_value", value).withColumn("_given", given).withColumn("_form", form)
    whole = F.array(F.struct(F.col("kind"), F.col("_form").alias("form")))
    return made.select("entity", "kind", "label", F.when(F.col("kind") == "name", names).otherwise(whole).alias("parts"))


def _seed(key: str, what: Column, form: Column) -> Column:
    """The keyed hash of an entity, of one size for forms of any length."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), what, form), 256)


def _draw(seed: Column, draw: Column, i: Column) -> Column:
    """A number below 65536 from the keyed hash of an entity, for its place ``i``."""
    source = F.concat_ws("\x1f", seed, draw.cast("string"), F.floor(i / 16).cast("string"))
    return F.conv(F.substring(F.sha2(source, 256), ((i % 16) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _letter(c: Column, n: Column) -> Column:
    """A character of the same class and script."""
    cyrillic = "абвгдежзиклмнопрстуфхцчшэюя"
    return (
        F.when(c.rlike("^[0-9]$"), F.char(F.lit(48) + n % 10))
        .when(c.rlike("^[a-z]$"), F.char(F.lit(97) + n % 26))
        .when(c.rlike("^[A-Z]$"), F.char(F.lit(65) + n % 26))
        .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Ll}]$"), F.substring(F.lit(cyrillic), n % len(cyrillic) + 1, F.lit(1)))
        .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Lu}]$"), F.upper(F.substring(F.lit(cyrillic), n % len(cyrillic) + 1, F.lit(1))))
        .when(c.rlike(r"^\p{Lu}$"), F.char(F.lit(65) + n % 26))
        .when(c.rlike(r"^\p{L}$"), F.char(F.lit(97) + n % 26))
        .when(c.rlike(r"^\p{N}$"), F.char(F.lit(48) + n % 10))
        .otherwise(c)
    )


def _chars(form: Column) -> Column:
    return F.filter(F.split(form, ""), lambda c: c != "")


def _check_digit(payload: Column) -> Column:
    """The last digit of a card number (Luhn)."""
    from_right = F.transform(F.reverse(_chars(payload)), lambda c, i: F.when(
        i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int")))
    total = F.aggregate(from_right, F.lit(0), lambda a, b: a + b)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def genuine(entity: Column) -> Column:
    """False for numbers like cards that start with 2 and end in a wrong check digit: such ids are common."""
    digits = _digits(entity)
    right = F.right(digits, F.lit(1)) == _check_digit(F.left(digits, F.length(digits) - 1))
    return F.when(entity.rlike(r"^2\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d+$"), right).otherwise(F.lit(True))


def _host(form: Column) -> Column:
    return F.lower(F.regexp_extract(form, r"@(.*)\.[^.]*$", 1))


def surrogate(key: str, what: Column, form: Column, draw: Column, seed: Column | None = None, host_seed: Column | None = None) -> Column:
    """The surrogate of a canonical form, in canonical form.

    ``seed`` and ``host_seed`` are columns that hold the keyed hashes of the form and of an e-mail's host; made
    here, they would be hashed anew for every character.
    """
    host = _host(form)
    seed = _seed(key, what, form) if seed is None else seed
    host_seed = _seed(key, F.lit("host"), host) if host_seed is None else host_seed
    number = lambda i: _draw(seed, draw, i)
    wider = F.greatest(draw - (DRAWS - 1), F.lit(0)) * WIDER
    source = F.concat(form, F.repeat(F.lit("0"), wider))
    same_class = F.array_join(F.transform(_chars(source), lambda c, i: _letter(c, number(i))), "")
    hexes = F.array_join(F.transform(_chars(source), lambda c, i: F.lower(F.hex((number(i) % 16).cast("long")))), "")
    digits = F.array_join(F.transform(_chars(source), lambda c, i: F.char(
        F.when(i == 0, F.lit(50) + number(i) % 8).otherwise(F.lit(48) + number(i) % 10))), "")
    size = F.length(source)
    payload = F.concat(F.left(form, F.lit(1)), F.substring(digits, F.lit(2), size - 2))
    new_host = F.array_join(F.transform(_chars(host), lambda c, i: _letter(c, _draw(host_seed, F.lit(0), i))), "")
    mailbox = F.concat(F.regexp_extract(form, "^(.*)@", 1), F.repeat(F.lit("0"), wider))
    local = F.array_join(F.transform(_chars(mailbox), lambda c, i: _letter(c, number(i))), "")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.lit(1) + number(i) % 254).cast("string")), ".")
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.lpad(F.hex(
        (F.when(i == 0, F.lit(8192) + number(i) % 4096).otherwise(number(i))).cast("long")), 4, "0"))), ":")
    cyrillic = form.rlike(r"\p{IsCyrillic}")

    def pick(words, n):
        return F.element_at(F.array(*map(F.lit, words)), n % len(words) + 1)

    def syllables(last):
        return F.array_join(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.when(
            cyrillic, pick(SYLLABLES["cyrillic"], number(i))).otherwise(pick(SYLLABLES["latin"], number(i)))), "")

    def given(gender):
        # The lists are short; after the first draw every name has one syllable more than the draw before.
        def of(script):
            return F.when(draw == 0, pick(GIVEN[gender, script], number(F.lit(0)))).otherwise(
                F.initcap(F.concat(syllables(draw), F.lit(ENDINGS[gender, script]))))

        return F.when(cyrillic, of("cyrillic")).otherwise(of("latin"))

    surname = syllables(F.lit(2) + F.floor(draw / 2))
    return (
        F.when(what == "email", F.concat(local, F.lit("@"), new_host, F.regexp_extract(form, r"\.[^.]*$", 0)))
        .when((what == "ip") & ((wider > 0) | form.contains(":")), groups).when(what == "ip", octets)
        .when(what == "card", F.concat(payload, _check_digit(payload)))
        .when(what.isin("phone", "identity"), digits)
        .when(what == "key", F.concat(F.left(form, F.lit(4)), F.substring(same_class, F.lit(5), size)))
        .when(what == "given-f", given("f")).when(what == "given-m", given("m"))
        .when(what == "surname", F.initcap(surname))
        .when((what == "secret") & form.rlike("^[0-9a-f]{8,}$"), hexes)
        .otherwise(same_class)
    )


def dictionary(forms: DataFrame, key: str) -> DataFrame:
    """``kind, form, new``: a surrogate of its own for every distinct canonical form.

    A form is real to its own kind only.  The space of surrogates grows with the draws (that of names with each or
    every second one, any other beyond ``DRAWS``), so the loop ends for any number of forms.  The first form of a
    surrogate is an aggregate and no rank: many forms may draw from a short list at first.
    """
    drawn = surrogate(key, F.col("kind"), F.col("form"), F.col("draw"), F.col("seed"), F.col("host"))
    host = F.when(F.col("kind") == "email", _seed(key, F.lit("host"), _host(F.col("form"))))
    seeded = forms.select("kind", "form", F.lit(0).alias("draw")).distinct().withColumns({"seed": _seed(key, F.col("kind"), F.col("form")), "host": host})
    # Kept first, so that no step takes the hashes apart again.
    state = kept(kept(seeded, "private-seeded").withColumn("new", drawn), "private-drawn")
    real = state.select(F.col("kind").alias("_kind"), F.col("form").alias("_form"))
    while True:
        first = state.groupBy("kind", "new").agg(F.min("form").alias("_first"))
        ranked = state.join(first, ["kind", "new"])
        judged = ranked.join(real, (F.col("kind") == F.col("_kind")) & (F.col("new") == F.col("_form")), "left")
        again = (F.col("form") != F.col("_first")) | F.col("_form").isNotNull()
        judged = kept(judged.select("kind", "form", "new", "draw", "seed", "host", again.alias("_again")), "private-judged")
        if judged.where("_again").isEmpty():
            return judged.select("kind", "form", "new")
        redrawn = judged.where("_again").withColumn("draw", F.col("draw") + 1).withColumn("new", drawn)
        state = kept(judged.where("not _again").unionByName(redrawn).drop("_again"), "private-drawn")


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """``entity, replacement`` for distinct entities."""
    known = kept(with_parts(entities), "private-parts")
    pieces = known.select("entity", F.posexplode("parts").alias("_at", "_part")).select("entity", "_at", "_part.kind", "_part.form")
    new = dictionary(pieces.select("kind", "form"), key)
    found = pieces.join(new, ["kind", "form"]).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("_at", "new"))).alias("_news"))
    news = F.transform("_news", lambda n: n["new"])
    made = known.select("entity", "kind", "label", F.length(F.col("parts")[0]["form"]).alias("_size"))
    made = made.join(found, "entity").withColumn("_new", F.array_join(news, " "))
    numeric = F.col("kind").isin("phone", "card", "identity")
    # Digits go into the entity's own form from the right; a country code in front stays, and what a longer
    # surrogate has more goes before the first digit replaced.
    made = made.withColumn("_more", F.length("_new") - F.col("_size")).withColumn("_left", F.when(numeric, F.transform(
        _chars(F.col("entity")), lambda c, i: F.struct(c.alias("c"), F.length(_digits(F.substring("entity", i + 2, F.length("entity")))).alias("after")))))
    filled = F.transform("_left", lambda x: F.when(
        x["c"].rlike("[0-9]") & (x["after"] == F.col("_size") - 1), F.left("_new", F.col("_more") + 1)).when(
        x["c"].rlike("[0-9]") & (x["after"] < F.col("_size")), F.substring("_new", F.col("_more") + F.col("_size") - x["after"], F.lit(1))).otherwise(x["c"]))
    return made.select("entity", F.when(numeric, F.array_join(filled, "")).otherwise(F.concat("label", "_new")).alias("replacement"))


def replace_private(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``, the number of places replaced.

    Texts stay where they are while the table of replacements, one row per text with entities, fits the
    broadcast bound; beyond it they are joined by the hash of the text.
    """
    docs = docs.drop("n_entities")
    found_, map_, hash_, key_ = free(docs, "_found", "_map", "_hash", "_key")
    digest = F.sha2("text", 256)
    held = docs.where(F.col("text").rlike(HINT)).select("text", find(F.col("text")).alias("_found")).where(F.size("_found") > 0)
    pieces = held.select(digest.alias("_key"), F.explode(F.array_distinct("_found")).alias("entity")).distinct()
    pieces = kept(pieces.where(genuine(F.col("entity"))), "private-found")
    new = kept(replacements(pieces.select("entity").distinct(), key), "private-replacements")
    octets = F.octet_length("entity") + F.octet_length("replacement")
    maps = pieces.join(new, "entity").groupBy(F.col("_key").alias(key_)).agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias(map_), F.sum(octets.cast("long")).alias("_octets"))
    maps = kept(maps, "private-maps")
    octets = maps.agg(F.coalesce(F.sum(F.col("_octets") + 400), F.lit(0))).first()[0]
    found = docs.withColumn(found_, find(F.col("text")))
    # Texts without entities get keys of their own that match nothing and spread evenly.
    found = found.withColumn(hash_, F.when(F.size(found_) > 0, digest).otherwise(F.xxhash64("text").cast("string")))
    ready = found.join(small(maps.drop("_octets"), 1, octets), F.col(hash_) == F.col(key_), "left")
    new_ones = F.transform(found_, lambda e: F.coalesce(F.try_element_at(F.col(map_), e), e))
    between = F.split("text", PATTERN, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, new_ones, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    text = F.when(F.size(found_) > 0, woven).otherwise(F.col("text"))
    count = F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.filter(found_, genuine))), F.lit(0)).cast("long")
    return ready.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], count.alias("n_entities"))
