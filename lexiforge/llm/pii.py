"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name, table

#: What is looked for, in this order at each place of the text. The bounds are those of the formats: 63 characters of a
#: domain label and 127 labels, 34 characters of an IBAN, 19 digits of a card; local parts and secrets have none.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![\w@])",
    "secret": r"AKIA[0-9A-Z]{16}(?!\w)|(?i:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*\"?[0-9A-Za-z_+/=.~-]{8,}+\"?",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\w])",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|(?:[0-9]{2}\.[0-9]{2}\.|[0-9]{2}/[0-9]{2}/)[0-9]{4}(?![\w]|[./][0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"[0-9]{13,19}(?!\w)|[0-9]{4}(?:[ -][0-9]{4}){3}(?!\w)|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?!\w)",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![\w])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w])",
}
PATTERN = r"(?<![\w@])(?<!\w[.+%-])(?:" + "|".join(KINDS.values()) + ")"
ROUNDS = 10


def _key(key: str | Column) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def _mix(key: str | Column, tweak: str, i: Column, v: Column) -> Column:
    """60 bits of SHA-256 of key, format, round and half, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", _key(key), F.lit(tweak), i.cast("string"), v.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(x: Column, a: Column, b: Column, key: str | Column, tweak: str) -> Column:
    """A keyed permutation of 0..a*b-1: x is (left, right) in base b; odd rounds add a hash of left to right modulo b, even
    rounds a hash of right to left modulo a. Every round is undone by subtraction, so no two values meet."""
    halves = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).cast("bigint").alias("r"))
    halves = F.struct(F.expr("1").alias("_"), halves.alias("h")).getField("h")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        halves,
        lambda s, i: F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + _mix(key, tweak, i, s["r"]), a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + _mix(key, tweak, i, s["l"]), b).alias("r"))
        ),
        lambda s: s["l"] * b + s["r"],
    )


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _half(x: Column) -> Column:
    return F.floor(x / 2).cast("int")


def permuted_digits(d: Column, key: str | Column, tweak: str) -> Column:
    """A string of 1 to 18 digits permuted among the strings of its length."""
    n = F.length(d)
    even = F.lpad(feistel(d.cast("bigint"), _power(_half(n)), _power(n - _half(n)), key, tweak).cast("string"), n, "0")
    ten = F.pmod(d.cast("bigint") + _mix(key, tweak, F.lit(0), F.lit("single")), F.lit(10)).cast("string")
    return F.when(n < 2, ten).otherwise(even)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced in turn by those of the string digits."""
    return F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], digits.substr(s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))
        ),
        lambda s: s["out"],
    )


def luhn_sum(d: Column) -> Column:
    """Luhn's sum of a digit string, its last digit counted once."""
    return F.aggregate(
        F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(_let(c.cast("int") * 2, lambda t: t - F.when(t > 9, 9).otherwise(0)))),
        F.lit(0),
        lambda n, k: n + k,
    )


def _card(s: Column, key: str | Column) -> Column:
    """Luhn-valid numbers of 13 to 19 digits: the payload is permuted after its first digit and the check digit set anew."""
    return _let(
        _digits(s),
        lambda d: F.when(
            luhn_sum(d) % 10 == 0,
            _let(
                F.concat(d.substr(F.lit(1), F.lit(1)), permuted_digits(d.substr(F.lit(2), F.length(d) - 2), key, "card")),
                lambda p: _refill(s, F.concat(p, F.pmod(F.lit(0) - luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string"))),
            ),
        ),
    )


def _ssn(s: Column, key: str | Column) -> Column:
    """Area not 000, 666 or 900 up, group not 00, serial not 0000: permuted among all such numbers (898 * 99 * 9999)."""

    def body(d: Column) -> Column:
        area, group, serial = (d.substr(F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
        ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        rank = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + (serial - 1)
        return F.when(
            ok,
            _let(
                feistel(rank, F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), key, "ssn"),
                lambda y: _let(
                    F.floor(y / (99 * 9999)).cast("bigint"),
                    lambda z: _refill(
                        s,
                        F.concat(
                            F.lpad((z + F.when(z >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                            F.lpad((F.floor(F.pmod(y, F.lit(99 * 9999)) / 9999) + 1).cast("string"), 2, "0"),
                            F.lpad((F.pmod(y, F.lit(9999)) + 1).cast("string"), 4, "0"),
                        ),
                    ),
                ),
            ),
        )

    return _let(_digits(s), body)


#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def _phone(s: Column, key: str | Column) -> Column:
    """9 to 15 digits: all but a country code after + are permuted, whatever stands between them, so a number is linked in each of
    its notations. Numbers without a country code are permuted whole and are others than those with one."""

    def body(d: Column) -> Column:
        n = F.length(d)
        kept = F.when(~s.startswith("+"), 0).when(d.substr(F.lit(1), F.lit(1)).isin(*ONE_DIGIT), 1).when(d.substr(F.lit(1), F.lit(2)).isin(*TWO_DIGITS), 2).otherwise(3)
        return F.when((n >= 9) & (n <= 15), _refill(s, F.concat(d.substr(F.lit(1), kept), permuted_digits(d.substr(kept + 1, n - kept), key, "phone"))))

    return _let(_digits(s), body)


def _ip(s: Column, key: str | Column) -> Column:
    """Four octets up to 255, permuted among all addresses."""
    parts = F.transform(F.split(s, r"\."), lambda p: p.cast("bigint"))

    def body(p: Column) -> Column:
        x = F.aggregate(p, F.lit(0).cast("bigint"), lambda n, k: n * 256 + k)
        side = F.lit(65536).cast("bigint")
        return F.when(
            F.forall(p, lambda k: k <= 255),
            _let(feistel(x, side, side, key, "ip"), lambda y: F.array_join(F.transform(F.array(*[F.lit(24 - 8 * i) for i in range(4)]), lambda k: F.pmod(F.floor(y / F.pow(F.lit(2.0), k)).cast("bigint"), F.lit(256)).cast("string")), ".")),
        )

    return _let(parts, body)


def _date(s: Column, key: str | Column) -> Column:
    """A real date of 0001 to 9999 becomes another date of its 400-year cycle (146097 = 189 * 773 days; the last one ends with
    the year 9999 and has 145731 = 93 * 1567), in its own format.

    dd.mm.yyyy is day first; with / the month comes first unless only day first is a date.
    """
    forms = [F.lit("yyyy-MM-dd"), F.lit("dd.MM.yyyy"), F.lit("MM/dd/yyyy"), F.lit("dd/MM/yyyy")]
    shaped = [s.rlike("^[0-9]{4}-"), s.rlike(r"\."), s.rlike("/"), s.rlike("/")]
    form = F.coalesce(*[F.when(shape & F.try_to_date(F.when(shape, s), f).isNotNull(), lit) for shape, lit, f in zip(shaped, forms, ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"], strict=True)])

    def body(x: Column) -> Column:
        day, cycle = F.unix_date(x["d"]).cast("bigint"), F.lit(146097).cast("bigint")
        a, b = (F.when(F.year(x["d"]) > 9600, last).otherwise(full).cast("bigint") for full, last in ((189, 93), (773, 1567)))
        start = F.lit(-719162).cast("bigint")  # 0001-01-01
        at = day - start
        moved = F.date_from_unix_date((start + F.floor(at / cycle) * cycle + feistel(F.pmod(at, cycle), a, b, key, "date")).cast("int"))
        out = F.coalesce(*[F.when(x["f"] == f, F.date_format(moved, f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")])
        return F.when(x["f"].isNotNull() & (F.year(x["d"]) > 0), out)

    parsed = F.coalesce(*[F.when(form == f, F.try_to_date(s, f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")])
    return _let(F.struct(form.alias("f"), parsed.alias("d")), body)


def _mod97(s: Column) -> Column:
    """A string of digits and capitals (A = 10) modulo 97."""
    return F.aggregate(
        F.filter(F.split(s, ""), lambda c: c != ""),
        F.lit(0).cast("int"),
        lambda n, c: F.when(c.rlike("[0-9]"), n * 10 + c.try_cast("int")).otherwise(n * 100 + F.ascii(c) - 55) % 97,
    )


def _iban(s: Column, key: str | Column) -> Column:
    """A number of 15 to 34 characters with right check digits (02 to 98): its account part is permuted, digits among digits
    and letters among letters, and its check digits are set anew."""

    def body(c: Column) -> Column:
        land, check, rest = c.substr(F.lit(1), F.lit(2)), c.substr(F.lit(3), F.lit(2)), F.substring(c, F.lit(5), F.length(c))
        good = (F.length(c) >= 15) & (F.length(c) <= 34) & check.between("02", "98") & (_mod97(F.concat(rest, land, check)) == 1)
        return F.when(
            good,
            _let(permuted_string(rest, key, "iban"), lambda m: _spread(s, F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(m, land, F.lit("00")))).cast("string"), 2, "0"), m))),
        )

    return _let(F.regexp_replace(s, " ", ""), body)


def _spread(form: Column, characters: Column) -> Column:
    """characters with the spaces of form put in where they stood."""
    return F.aggregate(
        F.filter(F.split(form, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))).otherwise(
            F.struct(F.concat(s["out"], characters.substr(s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))
        ),
        lambda s: s["out"],
    )


#: Classes of characters that are moved among themselves: first code and size. Hex digits stay hex digits.
CLASSES = ((48, 10), (97, 6), (103, 20), (65, 6), (71, 20))


def _pick(code: Column, what: int) -> Column:
    """Of a code's class the first code (what = 0) or the size (1); the code itself and size 1 outside of all classes."""
    out = code if what == 0 else F.lit(1)
    for first, n in CLASSES:
        out = F.when(code.between(first, first + n - 1), F.lit((first, n)[what])).otherwise(out)
    return out


def _moved(half: Column, other: Column, key: str | Column, tweak: str, i: Column) -> Column:
    """Each code of one half moved within its class by what a keyed digest of the other half says for its place."""
    digest = F.sha2(F.concat_ws("|", _key(key), F.lit(tweak), i.cast("string"), F.size(half).cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)
    return _let(
        digest,
        lambda d: _let(
            F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(half) / 16).cast("int")), lambda k: F.sha2(F.concat_ws("|", d, k.cast("string")), 256)), ""),
            lambda stream: F.transform(
                half, lambda c, at: _pick(c, 0) + F.pmod(c - _pick(c, 0) + F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int"), _pick(c, 1))
            ),
        ),
    )


def permuted_string(s: Column, key: str | Column, tweak: str) -> Column:
    """A string of any length permuted among those of its form: a Feistel network over its two halves, in which each character
    is moved within its class (digits, a-f, g-z, A-F, G-Z) and all others stay. Different strings stay different."""

    def body(codes: Column) -> Column:
        cut = _half(F.size(codes) + 1)
        halves = F.struct(F.slice(codes, F.lit(1), cut).alias("l"), F.slice(codes, cut + 1, F.size(codes) - cut).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(6)),
            halves,
            lambda x, i: F.when(i % 2 == 1, F.struct(_moved(x["l"], x["r"], key, tweak, i).alias("l"), x["r"].alias("r"))).otherwise(
                F.struct(x["l"].alias("l"), _moved(x["r"], x["l"], key, tweak, i).alias("r"))
            ),
            lambda x: F.array_join(F.transform(F.concat(x["l"], x["r"]), lambda c: F.char(c)), ""),
        )

    return F.when(F.length(s) > 0, _let(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c)), body)).otherwise(s)


def _cased(form: Column, moved: Column) -> Column:
    """moved, a permuted lower-cased string, with capitals where form has them."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return F.array_join(F.zip_with(letters(form), letters(moved), lambda f, m: F.when(f.rlike("[A-Z]"), F.upper(m)).otherwise(m)), "")


def _email(s: Column, key: str | Column) -> Column:
    """Local part and the domain before its last label are permuted each by itself, so addresses of one domain stay together.
    Case makes no difference: the lower-cased parts are permuted and get their capitals back."""
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    tail = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    head = F.substring(domain, F.lit(1), F.length(domain) - F.length(tail))
    return F.concat(_cased(local, permuted_string(F.lower(local), key, "local")), F.lit("@"), _cased(head, permuted_string(F.lower(head), key, "domain")), tail)


def _secret(s: Column, key: str | Column) -> Column:
    """What follows AKIA, or the = or : of a named secret, is permuted as a string, whole."""
    lead = F.regexp_extract(s, r"^(AKIA|[A-Za-z_]+\s*[=:]\s*\"?)", 1)
    return F.concat(lead, permuted_string(F.substring(s, F.length(lead) + 1, F.length(s)), key, "secret"))


def _pseudonym(s: Column, key: str | Column) -> Column:
    """(kind, replacement) of a match; the match itself and no kind if none of its readings is valid."""
    made = {
        "email": _email(s, key), "secret": _secret(s, key), "iban": _iban(s, key), "ip": _ip(s, key), "date": _date(s, key),
        "ssn": _ssn(s, key), "card": _card(s, key), "phone": _phone(s, key),
    }
    whole = {k: s.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    named = lambda k: lambda m: F.when(m.isNotNull(), F.struct(F.lit(k).alias("kind"), m.alias("to")))
    tries = [F.when(whole[k], _let(made[k], named(k))) for k in KINDS]
    return F.coalesce(*tries, F.struct(F.lit(None).cast("string").alias("kind"), s.alias("to")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", *, out: str = "text", found: str = "pii") -> DataFrame:
    """All rows and columns of docs; out is the text with pseudonyms, found counts them by kind (a map, empty if none).

    E-mail addresses, named secrets, IBANs, IPv4 addresses, dates, US social security numbers, card numbers and phone
    numbers are found in one pass over the whole text. Numbers and dates are checked (Luhn, check digits, ranges, calendar)
    and, if they are valid, moved by a keyed Feistel permutation of the valid values of their format; separators stay. Names
    and secrets are moved by one over their characters, whatever their length. Equal values get equal pseudonyms in every
    document, different ones of a kind and format different ones. What fails its check is left alone. Null texts stay null,
    and texts without a digit, @ or a secret's name are passed through unread. Columns of docs named as out or found are
    replaced. Rows do not depend on each other: no shuffle. The key comes to them from a table of one row, so that neither
    a plan nor an event log shows it; it must not be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    held = free_name(docs, "_key")
    docs = docs.withColumn(held, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    t, key = F.col(text), F.col(held)
    hits = F.when(t.rlike("[0-9@]|AKIA|(?i:password|passwd|pwd|secret|token|api_?key)"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    new = _let(
        F.struct(F.split(t, PATTERN, -1).alias("gap"), F.transform(hits, lambda s: _pseudonym(s, key)).alias("hit")),
        lambda x: F.struct(
            F.array_join(F.flatten(F.zip_with(x["gap"], x["hit"], lambda g, h: F.array(g, F.coalesce(h["to"], F.lit(""))))), "").alias("text"),
            F.filter(F.transform(x["hit"], lambda h: h["kind"]), lambda k: k.isNotNull()).alias("kinds"),
        ),
    )
    has = F.coalesce(F.size(hits) > 0, F.lit(False))
    done = docs.withColumn(found, F.when(has, new))
    made = F.when(F.col(found).isNull(), t).otherwise(F.col(found)["text"])
    kinds = F.coalesce(F.col(found)["kinds"], F.array().cast("array<string>"))
    counts = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return done.withColumn(out, made).withColumn(found, counts).drop(held)


def session_key(spark: SparkSession, *, random: bool = False) -> str:
    """The key of spark.lexiforge.pii.secret, a name that Spark redacts wherever it shows settings. Who has it can undo
    pseudonyms. Where it is unset that is an error, since links would end with the session; with random the session gets a
    key of its own and keeps it."""
    if not (key := spark.conf.get("spark.lexiforge.pii.secret", None)):
        if not random:
            raise RuntimeError("spark.lexiforge.pii.secret must hold the key")
        spark.conf.set("spark.lexiforge.pii.secret", key := token_hex(32))
    return key


def op3_pii(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """The texts of documents with pseudonyms and what was found; with a random key where none is set, so its links hold inside
    one session."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = {k: F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in KINDS}
    return pseudonymise(docs, key or session_key(spark, random=True)).select("doc_id", "text", *n.values())


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
