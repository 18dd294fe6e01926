"""Format-preserving pseudonyms for personal data: a keyed Feistel network over the values of a format.

Found by pattern, then validated: payment card numbers (13 to 19 digits, Luhn; also between groups of other digits), IBANs
(modulo 97, of the country's length), US social security numbers, phone numbers (North American ones, with any area code
after +1 or in parentheses; others after + and a country code), IPv4 addresses, dates from 1900-01-01 to 2099-08-03
(2001-12-31, 31.12.2001 and 12/31/2001), and the local part of e-mail addresses. A value becomes a list of numbers, each below its own bound; eight
Feistel rounds add to one half, element by element and modulo its bounds, a SHA-256 of key, kind, round and the other half.
So the map is one-to-one within its format, equal values get equal pseudonyms in all documents, and check digits are
made to fit again. Separators, country codes and mail domains stay.

The key is a secret of the caller: an argument, or the setting spark.gaugeleaf.pii.key. Without either, a random one is drawn
for this driver, so that values stay linked within its runs and nobody can turn them back.

Cases: a null text stays null, an empty one empty. What looks alike but fails its check stays. Repeated rows get equal
rows. Other columns are kept as they are, whatever their names; only one named pii gives way to the result's. An empty table
gives an empty result.

Texts and runs of digits of any length are searched whole, in time and memory in proportion to them.

Size: one scan and no shuffle; texts without a digit or an at-sign pass without the search. DataFrame functions only.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import packed, table, unpacked

ROUNDS, DAYS, FIRST_DAY = 8, 270 * 270, "1900-01-01"
CARD, IBAN, SSN, PHONE, IP, DATE, MAIL = "card", "iban", "ssn", "phone", "ip", "date", "mail"
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
#: Digit runs and separators of each kind, in the order in which they are tried at a place.
SHAPES = (
    (MAIL, r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}"),
    (IBAN, _BY_LENGTH + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    (DATE, r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}"),
    (IP, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    (SSN, r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    (
        PHONE,
        r"\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|(?:1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
        r"|(?:1[ .-]?)?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}|\+[2-9](?:[ .-]?\(?[0-9]\)?){6,14}",
    ),
)
#: A run of digits in which card numbers are looked for: groups between blanks or hyphens; it ends before a value of another
#: kind, and after the last group that such a number may end with. All loops over a run are possessive, which Java matches in a
#: loop; other repeated groups have bounds, since Java goes one call deeper with each turn of them.
_OTHER = r"(?!(?:" + "|".join(shape for kind, shape in SHAPES if kind in (DATE, IP, SSN, PHONE)) + r")(?![A-Za-z0-9_-]))"
_END = r"(?![A-Za-z0-9_-]|\.[0-9])"
_GROUP = rf"[0-9]++(?:-{_OTHER}[0-9]++)*+{_END}"
SHAPES += ((CARD, rf"(?=[0-9](?:[ -]{_OTHER}[0-9]|[0-9]){{12}}){_GROUP}(?: {_OTHER}{_GROUP})*+"),)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERN = r"(?<![A-Za-z0-9.+_-])(?:" + "|".join(shape for _, shape in SHAPES) + ")" + _END
#: Groups of a run that one fold passes over; a fold copies what it has kept at each step.
BLOCK = 512


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, bounds: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the lists with values[i] in 0 .. bounds[i] - 1."""
    return _once(F.struct(values.alias("v"), bounds.alias("b")), lambda s: _rounds(s["v"], s["b"], key, kind))


def _rounds(values: Column, bounds: Column, key: Column, kind: str) -> Column:
    n = F.size(values)
    cut = F.floor(n / 2).cast("int")
    left_bounds, right_bounds = F.slice(bounds, F.lit(1), cut), F.slice(bounds, cut + 1, n)

    def added(half: Column, half_bounds: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", key, F.lit(kind), turn.cast("string"), F.array_join(other.cast("array<string>"), ","))
        hex_ = F.concat(F.sha2(F.concat(F.lit("a|"), seed), 256), F.sha2(F.concat(F.lit("b|"), seed), 256), F.sha2(F.concat(F.lit("c|"), seed), 256))
        mixed = _once(hex_, lambda h: F.transform(half, lambda v, i: v + F.conv(F.substring(h, i * 6 + 1, F.lit(6)), 16, 10).cast("int")))
        return F.zip_with(mixed, half_bounds, lambda v, b: F.pmod(v, b))

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, added(state["l"], left_bounds, state["r"], i)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(added(state["r"], right_bounds, state["l"], i)).alias("r"),
        )

    start = F.struct(F.slice(values, F.lit(1), cut).alias("l"), F.slice(values, cut + 1, n).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return _once(done, lambda d: F.concat(d["l"], d["r"]))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _dressed(text: Column, digits: Column) -> Column:
    """text with its digits replaced, in order."""
    place = F.transform(_chars(text), lambda c, i: F.length(_digits(F.substring(text, F.lit(1), i + 1))))
    return _once(digits, lambda d: F.array_join(F.zip_with(_chars(text), place, lambda c, p: F.when(c.between("0", "9"), F.substring(d, p, F.lit(1))).otherwise(c)), ""))


def _ints(chars: Column) -> Column:
    return F.transform(chars, lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """The sum of digits, every second one from the right doubled, the last one counted single."""
    doubled = lambda s: F.transform(_ints(_chars(s)), lambda d, i: F.when((F.length(s) - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(_once(digits, doubled), F.lit(0), lambda a, d: a + d)


def _card(text: Column, key: Column) -> Column:
    digits = _digits(text)
    n = F.length(digits)
    body = _ints(_chars(F.substring(digits, F.lit(2), n - 2)))
    moved = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.array_join(feistel(body, F.transform(body, lambda _: F.lit(10)), key, CARD).cast("array<string>"), ""))
    whole = _once(moved, lambda m: F.concat(m, F.pmod(-_luhn(F.concat(m, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(n.between(13, 19) & (_luhn(digits) % 10 == 0), _dressed(text, whole))


def _pieces(found: Column) -> Column:
    """A run of digits in pieces that make it up: card numbers from one group border to another, longest first, and single groups.

    Runs have any length: a step looks at the 19 groups that a card number can have, and folds go over blocks of groups.
    """

    def fits(near: Column) -> Column:
        """How many of the first groups make up the longest card number, or null."""

        def add(s: Column, g: Column) -> Column:
            total = s["total"] + g["digits"]
            return F.struct(F.least(total, F.lit(20)).alias("total"), (s["k"] + 1).alias("k"), F.when(total.between(13, 19), F.concat(F.array(s["k"] + 1), s["ends"])).otherwise(s["ends"]).alias("ends"))

        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("ends"))
        ends = F.aggregate(near, start, add)["ends"]
        return F.get(F.filter(ends, lambda k: _luhn(_digits(_text(F.slice(near, F.lit(1), k)))) % 10 == 0), F.lit(0))

    def cut(groups: Column) -> Column:
        n = F.size(groups)

        def step(state: Column, i: Column) -> Column:
            def took(near: Column) -> Column:
                return _once(F.coalesce(fits(near), F.lit(1)), lambda k: F.struct((i + k).alias("next"), F.concat(state["pieces"], F.array(_text(F.slice(near, F.lit(1), k)))).alias("pieces")))

            return F.when(i < state["next"], state).otherwise(_once(F.slice(groups, i + 1, F.lit(19)), took))

        def block(state: Column, b: Column) -> Column:
            start = F.struct(state["next"].alias("next"), F.array().cast("array<string>").alias("pieces"))
            inner = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, n) - 1), start, step)
            return _once(inner, lambda s: F.struct(s["next"].alias("next"), F.concat(state["blocks"], F.array(s["pieces"])).alias("blocks")))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<array<string>>").alias("blocks"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block)["blocks"])

    groups = F.transform(F.regexp_extract_all(found, F.lit("[0-9]+[ -]?"), F.lit(0)), lambda g: F.struct(g.alias("text"), F.length(F.rtrim(F.replace(g, F.lit("-"), F.lit(" ")))).alias("digits")))
    return F.when(kind_of(found) == CARD, _once(groups, cut)).otherwise(F.array(found))


def _text(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: g["text"]), "")


def _mod97(text: Column) -> Column:
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _class_values(chars: Column) -> tuple[Column, Column]:
    """Place within its class (digits, small or large letters; others alone) of each character, and the class's size."""
    value = F.transform(chars, lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("A", "Z"), F.ascii(c) - 65).otherwise(F.lit(0)))
    bound = F.transform(chars, lambda c: F.when(c.between("0", "9"), F.lit(10)).when(c.between("a", "z") | c.between("A", "Z"), F.lit(26)).otherwise(F.lit(1)))
    return value, bound


def _class_text(chars: Column, values: Column) -> Column:
    base = lambda c: F.when(c.between("0", "9"), F.lit(48)).when(c.between("a", "z"), F.lit(97)).otherwise(F.lit(65))
    return F.array_join(F.zip_with(chars, values, lambda c, v: F.when(c.rlike("[0-9a-zA-Z]"), F.char(base(c) + v)).otherwise(c)), "")


def _iban(text: Column, key: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    chars = _chars(body)
    values, bounds = _class_values(chars)
    moved = _class_text(chars, feistel(values, bounds, key, IBAN))
    new = _once(moved, lambda m: F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))
    place = F.transform(_chars(text), lambda c, i: F.length(F.replace(F.substring(text, F.lit(1), i + 1), F.lit(" "), F.lit(""))))
    dressed = _once(new, lambda n: F.array_join(F.zip_with(_chars(text), place, lambda c, p: F.when(c == " ", c).otherwise(F.substring(n, p, F.lit(1)))), ""))
    return F.when(F.length(plain).between(15, 34) & (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1), dressed)


def _ssn(text: Column, key: Column) -> Column:
    part = _ints(F.split(text, "-"))
    area, group, serial = (F.get(part, F.lit(i)) for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, SSN)

    def written(x: Column) -> Column:
        a, b, c = (F.get(x, F.lit(i)) for i in range(3))
        return F.concat_ws("-", F.lpad((a + F.when(a > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((b + 1).cast("string"), 2, "0"), F.lpad((c + 1).cast("string"), 4, "0"))

    return F.when(valid, _once(new, written))


def _phone(text: Column, key: Column) -> Column:
    """Area code and exchange stay on their side of 2, other national numbers with or without a leading 0."""
    digits = _digits(text)
    abroad = text.rlike(r"^\+[2-9]")
    code = F.when(abroad, F.regexp_extract(digits, COUNTRY, 0)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 10))
    own = _ints(_chars(F.substring(digits, F.length(code) + 1, F.length(digits))))
    edge = F.when(abroad, F.lit(1)).otherwise(F.lit(2))
    led = lambda i: (i == 0) | (~abroad & (i == 3))
    low = F.transform(own, lambda v, i: F.when(led(i) & (v >= edge), edge).otherwise(F.lit(0)))
    bounds = F.transform(own, lambda v, i: F.when(led(i), F.when(v >= edge, 10 - edge).otherwise(edge)).otherwise(F.lit(10)))
    new = F.zip_with(feistel(F.zip_with(own, low, lambda v, x: v - x), bounds, key, PHONE), low, lambda v, x: v + x)
    return F.when(F.length(digits).between(F.when(abroad, 7).otherwise(10), F.when(abroad, 15).otherwise(11)), _dressed(text, F.concat(code, F.array_join(new.cast("array<string>"), ""))))


def _ip(text: Column, key: Column) -> Column:
    part = _ints(F.split(text, r"\."))
    return F.when(F.forall(part, lambda p: p < 256), F.array_join(feistel(part, F.array_repeat(F.lit(256), 4), key, IP).cast("array<string>"), "."))


def _date(text: Column, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for mark, shape in (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy")):
        day = F.datediff(F.try_to_timestamp(text, F.lit(shape)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        new = feistel(F.array(F.floor(day / 270).cast("int"), (day % 270).cast("int")), F.array(F.lit(270), F.lit(270)), key, DATE)
        moved = _once(new, lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(x, F.lit(0)) * 270 + F.get(x, F.lit(1))), shape))
        out = F.when(F.contains(text, F.lit(mark)), F.when(day.between(0, DAYS - 1), moved)).otherwise(out)
    return out


def _mail(text: Column, key: Column) -> Column:
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    chars = _chars(local)
    values, bounds = _class_values(chars)
    return F.when(F.length(local) <= 64, F.concat(_class_text(chars, feistel(values, bounds, key, MAIL)), F.lit("@"), domain))


def kind_of(found: Column) -> Column:
    """Which kind a found string is, by its shape."""
    out = F.lit(CARD)
    for kind, shape in reversed(SHAPES[:-1]):
        out = F.when(found.rlike(f"^(?:{shape})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(found: Column, key: Column) -> Column:
    """struct(kind, text) for a found string; text is null where a check fails."""
    makers = {MAIL: _mail, IBAN: _iban, DATE: _date, IP: _ip, SSN: _ssn, PHONE: _phone, CARD: _card}

    def made(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, make in makers.items():
            new = F.when(kind == name, make(found, key)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("text"))

    return _once(kind_of(found), made)


_DRAWN: list[str] = []


def secret(spark: SparkSession) -> str:
    """The key that the session names, else one drawn at random for this driver."""
    if named := spark.conf.get("spark.gaugeleaf.pii.key", None):
        return named
    if not _DRAWN:
        _DRAWN.append(secrets.token_hex(16))
    return _DRAWN[0]


def _rewritten(docs: DataFrame, key: str | None) -> DataFrame:
    """doc_id, text, rest (packed) with text rewritten, and pii: the kinds replaced, in order."""
    key, text = F.lit(secret(docs.sparkSession) if key is None else key), F.col("text")
    empty = F.array().cast("array<string>")
    rows = docs.withColumn("found", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(empty))
    rows = rows.withColumn("found", F.transform("found", _pieces))
    rows = rows.withColumn("new", F.transform("found", lambda found: F.transform(found, lambda m: pseudonym(m, key))))
    between = F.split(text, PATTERN, -1)
    rewritten = F.zip_with("found", "new", lambda found, new: F.array_join(F.zip_with(found, new, lambda m, n: F.coalesce(n["text"], m)), ""))
    joined = F.array_join(F.zip_with(between, rewritten, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")
    done = F.filter(F.flatten("new"), lambda n: n["text"].isNotNull())
    return rows.select("doc_id", F.when(F.size(done) > 0, joined).otherwise(text).alias("text"), "rest", F.transform(done, lambda n: n["kind"]).alias("pii"))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text rewritten, and pii: the kinds replaced, in order."""
    rows = _rewritten(packed(docs), key)
    kept = docs.drop("pii")
    return unpacked(rows, kept, also={"pii": F.col("pii")}, packed_as=docs)


def private(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text rewritten, all other columns as they are; n_chars, where there is one, follows the text."""
    rows = _rewritten(packed(docs), key)
    if "n_chars" not in docs.columns:
        return unpacked(rows, docs)
    return unpacked(rows, docs, new={"n_chars": lambda old: F.when(F.size("pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old)})


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, kinds."""
    rows = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii", ",").alias("kinds"))
