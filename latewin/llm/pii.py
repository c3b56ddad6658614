"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

A value is recognised by its form and validated (check digit, ranges, calendar). Its
digits become two numbers (a, b), each below a modulus, and ROUNDS rounds of an
alternating Feistel network under a secret key permute the pairs:
a += F(b), b += F(a), modulo their moduli, with F from SHA-256. The pair is
written back into the same format. As this is a permutation of the valid values of
a format, equal values stay equal across documents and different ones different. Only
built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.llm.tables import text_of

ROUNDS = 10
#: Session setting that holds the secret key.
KEY_SETTING = "spark.latewin.pseudonymKey"
#: Their product is the number of days from 1900-01-01 to 2099-12-31, the dates the forms accept.
DATE_DAYS = (17, 4297)

# Fixed forms. The order of the alternation decides where several begin together. Repeats without
# a bound are possessive: Java matches any other repeat of a group by recursion, and a long
# value would overflow the stack, which ends the executor.
_LABEL = r"\.(?![A-Za-z]{2})[A-Za-z0-9-]++"  # of a host; none that begins with two letters
# The host ends with the letters that begin its last label with two of them.
MAIL = (
    r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++"
    rf"(?:(?:{_LABEL})*+\.[A-Za-z]{{2}}[A-Za-z0-9-]*+(?=(?:{_LABEL})*+\.[A-Za-z]{{2}}))*+"
    rf"(?:{_LABEL})*+\.[A-Za-z]{{2,}}+"
)
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"
ADDRESS = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
DATE = r"(?<![\w-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\w-])"
DATE_DMY = r"(?<![\w.])[0-3]\d\.[01]\d\.(?:19|20)\d\d(?!\w)"
DATE_MDY = r"(?<![\w/])[01]\d/[0-3]\d/(?:19|20)\d\d(?![\w/])"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
# Groups of digits with 13 or more in all. The last group is not the start of a mail
# address, or of an address, date or phone number written with dots or slashes; where
# it is, or a word goes on behind it, the run ends at the last blank before.
RUN = (
    r"(?<![\w-])\d(?:[ -]?\d){12}+(?:(?:[ -]?\d)*+(?![\w-])"
    r"(?![.%+]?[A-Za-z0-9._%+-]*@|\.\d{1,3}\.\d{1,3}\.\d|[./]\d\d[./]\d{4}|\.\d{3}[ .-]\d{4}|\.\d{4}(?!\d))"
    r"|(?:-?\d)*+(?= \d)(?: \d(?:-?\d)*+(?= \d))*+)"
)
FORMS = {
    "mail": MAIL, "social": SOCIAL, "date": DATE, "date_dmy": DATE_DMY, "date_mdy": DATE_MDY,
    "phone": PHONE, "address": ADDRESS, "card": CARD,
}
_SINGLE = "|".join(pattern for name, pattern in FORMS.items() if name not in ("mail", "card"))
# All but mail begin with one of three kinds of sign; elsewhere they are not tried.
SINGLE = rf"{MAIL}|(?=[\d+(])(?:{_SINGLE})"
NUMBER = rf"(?=[\d+(])(?:{RUN}|{_SINGLE})"
ANY = f"{MAIL}|{NUMBER}"
#: The usual groups of a card number.
USUAL = r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
#: Those of a card number of 17 to 19 digits, which may begin with a valid shorter one.
LONG = r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{1,3}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _long(value: Column) -> Column:
    return F.when(value != "", value).otherwise("0").cast("decimal(20,0)").cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(a: Column, b: Column, m1: Column, m2: Column, key: str, tweak: str) -> Column:
    """struct<a, b>: a keyed permutation of [0, m1) x [0, m2)."""

    def noise(i: Column, value: Column, modulus: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(tweak), modulus, i, value)
        digest = F.substring(F.sha2(text.cast("binary"), 256), 1, 15)
        return F.conv(digest, 16, 10).cast("long") % modulus

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    # Sums stay below twice a modulus, and moduli below 2**62.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.when(
            i % 2 == 1,
            F.struct(((s["a"] + noise(i, s["b"], m1)) % m1).alias("a"), s["b"].alias("b")),
        ).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + noise(i, s["a"], m2)) % m2).alias("b"))
        ),
    )


def _pad(value: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.lpad(value.cast("string"), width, "0")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _at(ascii: Column, i: Column) -> Column:
    """The character at ``i`` (from 1) of a binary; a string would be read from its start."""
    return ascii.substr(i, F.lit(1)).cast("string")


def _refill(form: Column, signs: Column, kind: str = "[0-9]") -> Column:
    """The signs put, in order, in place of the characters of ``kind`` in ``form`` (both ASCII).

    Both kinds of place are listed with their characters, then ordered by place.
    """
    placed = lambda i, c: F.struct(i.alias("i"), c.alias("c"))

    def filled(b: Column) -> Column:
        form, signs = b["form"], b["signs"]
        places = F.sequence(F.lit(1), F.length(form))
        return F.concat(
            F.transform(
                F.filter(places, lambda i: _at(form, i).rlike(kind)),
                lambda i, j: placed(i, _at(signs, j + 1)),
            ),
            F.transform(
                F.filter(places, lambda i: ~_at(form, i).rlike(kind)),
                lambda i: placed(i, _at(form, i)),
            ),
        )

    both = F.struct(form.cast("binary").alias("form"), signs.cast("binary").alias("signs"))
    return F.array_join(F.transform(F.array_sort(_let(both, filled)), lambda p: p["c"]), "")


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Luhn sum; every second digit doubled, the first one if asked."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (i % 2 == 1) == doubled_first,
            F.lit(2) * digits.substr(i, F.lit(1)).cast("int")
            - F.when(digits.substr(i, F.lit(1)).cast("int") > 4, 9).otherwise(0),
        ).otherwise(digits.substr(i, F.lit(1)).cast("int")),
    )


def luhn_valid(value: Column) -> Column:
    digits = _digits(value)
    return _luhn_sum(digits, F.length(digits) % 2 == 0) % 10 == 0


def card_pseudonym(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is made the check digit."""
    digits = _digits(value)
    n = F.length(digits) - 1
    left = F.floor(n / 2).cast("int")
    pair = feistel(
        _long(digits.substr(F.lit(1), left)),
        _long(digits.substr(left + 1, n - left)),
        _ten(left), _ten(n - left), key, "card",
    )
    body = _let(pair, lambda p: F.concat(_pad(p["a"], left), _pad(p["b"], n - left)))
    check = lambda b: (F.lit(10) - _luhn_sum(b, F.length(b) % 2 == 1) % 10) % 10
    return _refill(value, _let(body, lambda b: F.concat(b, check(b).cast("string"))))


def phone_pseudonym(value: Column, key: str) -> Column:
    """Area code, exchange and line are permuted; +1 stays.

    Numbers whose area code and exchange are both from 200 are permuted among themselves,
    and so are all others, so the permutation covers 000-999 for both.
    """
    digits = _digits(value)
    ten = digits.substr(F.length(digits) - 9, F.lit(10))
    area, rest = _long(ten.substr(1, 3)), _long(ten.substr(4, 7))
    pair = feistel(
        area - 200, rest - 2000000,
        F.lit(800).cast("long"), F.lit(8000000).cast("long"), key, "phone",
    )
    assigned = _let(
        pair, lambda p: F.concat((p["a"] + 200).cast("string"), (p["b"] + 2000000).cast("string"))
    )
    # The others by rank: 200 areas with 1,000 exchanges, then 800 with 200.
    exchange = _long(ten.substr(4, 3))
    rank = F.when(area < 200, area * 1000 + exchange).otherwise(
        200000 + (area - 200) * 200 + exchange
    )
    pair = feistel(
        rank, _long(ten.substr(7, 4)),
        F.lit(360000).cast("long"), F.lit(10000).cast("long"), key, "phone-other",
    )
    other = _let(
        pair,
        lambda p: F.concat(
            F.when(p["a"] < 200000, _pad(p["a"], 6)).otherwise(
                F.concat(
                    (F.floor((p["a"] - 200000) / 200) + 200).cast("string"),
                    _pad((p["a"] - 200000) % 200, 3),
                )
            ),
            _pad(p["b"], 4),
        ),
    )
    new = F.when((area >= 200) & (exchange >= 200), assigned).otherwise(other)
    country = digits.substr(F.lit(1), F.length(digits) - 10)
    return _refill(value, F.concat(country, new))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, "\\."), lambda x: x.cast("long"))


def address_valid(value: Column) -> Column:
    return F.forall(_octets(value), lambda x: x < 256)


def address_pseudonym(value: Column, key: str) -> Column:
    o = _octets(value)
    m = F.lit(65536).cast("long")
    pair = feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), m, m, key, "ip")
    return _let(
        pair,
        lambda p: F.concat_ws(
            ".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256
        ),
    )


def social_valid(value: Column) -> Column:
    area = value.substr(1, 3).cast("int")
    return (
        area.between(1, 899) & (area != 666)
        & (value.substr(5, 2) != "00") & (value.substr(8, 4) != "0000")
    )


def social_pseudonym(value: Column, key: str) -> Column:
    area = value.substr(1, 3).cast("long")
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    rest = (value.substr(5, 2).cast("long") - 1) * 9999 + value.substr(8, 4).cast("long") - 1
    pair = feistel(rank, rest, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "social")
    area = pair["a"] + 1 + F.when(pair["a"] >= 665, 1).otherwise(0)
    return F.concat_ws(
        "-", _pad(area, 3), _pad(F.floor(pair["b"] / 9999) + 1, 2), _pad(pair["b"] % 9999 + 1, 4)
    )


def _day(value: Column, form: str) -> Column:
    """Days since 1900-01-01; null for no such day or one beyond the permutation."""
    day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))
    return F.when(day.between(0, DATE_DAYS[0] * DATE_DAYS[1] - 1), day)


def date_pseudonym(value: Column, form: str, key: str) -> Column:
    """All formats share one permutation of days, so a day keeps its pseudonym in each."""
    day = _day(value, form).cast("long")
    m1, m2 = DATE_DAYS
    pair = feistel(
        F.floor(day / m2), day % m2, F.lit(m1).cast("long"), F.lit(m2).cast("long"), key, "date"
    )
    return F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (pair["a"] * m2 + pair["b"]).cast("int")), form)


def mail_pseudonym(value: Column, key: str) -> Column:
    """Letters and digits of the local part, read in base 36, are permuted.

    Local parts of more than 22 letters and digits get hexadecimal digits of a keyed
    digest of the same number instead, which links but is not a permutation. The host stays.
    """
    at = F.instr(value, "@")
    local = F.lower(value.substr(F.lit(1), at - 1))
    signs = F.regexp_replace(local, "[^0-9a-z]", "")
    n = F.length(signs)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.element_at(F.array(*[F.lit(36**i) for i in range(12)]), k + 1)
    number = lambda s: F.coalesce(F.conv(F.when(s != "", s), 36, 10).cast("long"), F.lit(0).cast("long"))
    short = F.when(n <= 22, n).otherwise(22)
    half = F.floor(short / 2).cast("int")
    pair = feistel(
        number(signs.substr(F.lit(1), half)), number(signs.substr(half + 1, short - half)),
        power(half).cast("long"), power(short - half).cast("long"), key, "mail",
    )
    base36 = lambda v, width: F.lpad(F.lower(F.conv(v.cast("string"), 10, 36)), width, "0")
    permuted = _let(
        pair,
        lambda p: F.concat(
            F.when(half > 0, base36(p["a"], half)).otherwise(""), base36(p["b"], short - half)
        ),
    )
    digest = F.sha2(F.concat_ws("|", F.lit(key), signs).cast("binary"), 256)
    long = F.repeat(digest, F.ceil(n / 64).cast("int")).substr(F.lit(1), n)
    new = F.when(n == 0, "").when(n <= 22, permuted).otherwise(long)
    # Signs between letters and digits keep their places.
    filled = _refill(local, new, "[0-9a-z]")
    return F.concat(filled, value.substr(at, F.length(value)))


def _whole(pattern: str) -> str:
    """The pattern for a value cut out of its text: its looks around always hold."""
    return f"^(?:{pattern})$"


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a recognised and validated value; any other stays as it is."""
    form = lambda name: value.rlike(_whole(FORMS[name]))
    day = lambda name, pattern: form(name) & _day(value, pattern).isNotNull()
    return (
        F.when(form("mail"), mail_pseudonym(value, key))
        .when(form("social") & social_valid(value), social_pseudonym(value, key))
        .when(day("date", "yyyy-MM-dd"), date_pseudonym(value, "yyyy-MM-dd", key))
        .when(day("date_dmy", "dd.MM.yyyy"), date_pseudonym(value, "dd.MM.yyyy", key))
        .when(day("date_mdy", "MM/dd/yyyy"), date_pseudonym(value, "MM/dd/yyyy", key))
        .when(form("phone"), phone_pseudonym(value, key))
        .when(form("address") & address_valid(value), address_pseudonym(value, key))
        .when(form("card") & luhn_valid(value), card_pseudonym(value, key))
        .otherwise(value)
    )


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at all matches, as array<struct<s, hit>> that joins to the text."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(
        F.zip_with(
            gaps,
            hits,
            lambda gap, hit: F.filter(
                F.array(_part(gap, False), _part(hit, True)), lambda p: p["s"].isNotNull()
            ),
        )
    )


def _part(s: Column, hit: bool) -> Column:
    return F.struct(s.alias("s"), F.lit(hit).alias("hit"))


def card_spans(run: Column) -> Column:
    """Card numbers in a run of digit groups: array<struct<start, end>>, by place.

    Every sequence of whole groups with 13 to 19 digits is tested. A valid run in
    groups of a long card is the card. Otherwise numbers in the usual groups come first, then
    others; each from the left, the longest first, and none overlaps another.
    """
    span = "array<struct<start:int,n:int,end:int,usual:boolean>>"
    # As a run may be long, it is cut as binary, and nothing goes through all spans for each span.
    ascii = run.cast("binary")
    ends = F.concat(
        F.array(F.lit(-1)),
        F.filter(F.sequence(F.lit(0), F.length(run) - 1), lambda i: _at(ascii, i + 1).isin(" ", "-")),
        F.array(F.length(run)),
    )

    def tested(at: Column) -> Column:
        """Spans [start, end) of at most 19 groups from every group."""

        def one(i: Column, k: Column) -> Column:
            start, end = F.get(at, i) + 1, F.get(at, i + k)
            digits = end - start - k + 1
            cut = ascii.substr(start + 1, end - start).cast("string")
            return F.struct(
                start.alias("start"),
                (-digits).alias("n"),
                end.alias("end"),
                F.when(digits.between(13, 19), cut.rlike(USUAL)).alias("usual"),
            )

        all_spans = F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(at) - 2),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(19), F.size(at) - 1 - i)),
                    lambda k: one(i, k),
                ),
            )
        )
        return F.filter(
            all_spans,
            lambda s: s["n"].between(-19, -13)
            & luhn_valid(ascii.substr(s["start"] + 1, s["end"] - s["start"]).cast("string")),
        )

    def disjoint(spans: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("all"))
        return F.aggregate(
            F.array_sort(spans),
            none,
            lambda acc, s: F.when(
                s["start"] >= acc["at"],
                F.struct(s["end"].alias("at"), F.concat(acc["all"], F.array(s)).alias("all")),
            ).otherwise(acc),
            lambda acc: acc["all"],
        )

    def covered(spans: Column) -> Column:
        """For each place of the run, whether one of the spans, in order, holds it."""
        after = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        return F.concat(
            F.flatten(
                F.transform(
                    spans,
                    lambda s, i: F.concat(
                        F.array_repeat(F.lit(False), s["start"] - after(i)),
                        F.array_repeat(F.lit(True), s["end"] - s["start"]),
                    ),
                )
            ),
            F.array_repeat(F.lit(False), F.length(run) - after(F.size(spans))),
        )

    def chosen(valid: Column) -> Column:
        whole = F.filter(
            valid,
            lambda s: (s["start"] == 0) & (s["end"] == F.length(run)) & run.rlike(LONG),
        )
        usual = disjoint(F.filter(valid, lambda s: s["usual"]))

        def with_others(u: Column) -> Column:
            free = lambda c: F.filter(
                valid,
                lambda s: ~F.array_contains(F.slice(c, s["start"] + 1, s["end"] - s["start"]), True),
            )
            return F.array_sort(F.concat(u, disjoint(_let(covered(u), free))))

        both = _let(usual, with_others)
        return F.when(F.size(whole) > 0, whole).otherwise(both)

    return _let(_let(ends, tested), chosen)


def _run_parts(run: Column) -> Column:
    """The parts of a run: its card numbers, and the other forms beside them."""
    ascii = run.cast("binary")

    def cut(spans: Column) -> Column:
        edges = F.concat(
            F.array(F.lit(0)),
            F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))),
            F.array(F.length(run)),
        )
        pieces = F.transform(
            F.sequence(F.lit(0), F.size(edges) - 2),
            lambda i: F.struct(
                ascii.substr(F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i)).cast("string").alias("s"),
                (i % 2 == 1).alias("hit"),
            ),
        )
        return F.flatten(
            F.transform(
                pieces, lambda p: F.when(p["hit"], F.array(p)).otherwise(_parts(p["s"], SINGLE))
            )
        )

    return _let(card_spans(run), cut)


def secret_key(docs: DataFrame) -> str:
    key = docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key, or pass one")
    return key


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_found (long), values (each with its pseudonym).

    ``values`` is array<struct<value, pseudonym>> in text order, changed values only.
    Null text counts as empty. Rows are treated one by one; equal values have equal
    pseudonyms in all of them. Other columns are ignored. Without ``key`` the session's
    setting is used; whoever has the key can invert the pseudonyms.
    """
    key = key or secret_key(docs)
    text = F.col("_text")
    rows = docs.select("doc_id", text_of().alias("_text"))
    parts = F.flatten(
        F.transform(
            _parts(text, ANY),
            lambda p: F.when(p["hit"] & p["s"].rlike(_whole(RUN)), _run_parts(p["s"])).otherwise(
                F.array(p)
            ),
        )
    )
    none = F.array().cast("array<struct<s:string,hit:boolean>>")
    found = F.when(text.contains("@"), text.rlike(ANY)).otherwise(text.rlike(NUMBER))
    rows = rows.withColumn("_parts", F.when(found, parts).otherwise(none))
    rows = rows.withColumn(
        "_new", F.transform("_parts", lambda p: F.when(p["hit"], pseudonym(p["s"], key)).otherwise(p["s"]))
    )
    values = F.filter(
        F.zip_with(
            "_parts", "_new", lambda v, p: F.struct(v["s"].alias("value"), p.alias("pseudonym"))
        ),
        lambda s: s["value"] != s["pseudonym"],
    )
    return rows.select(
        "doc_id",
        F.when(F.size("_parts") == 0, text).otherwise(F.array_join("_new", "")).alias("text"),
        F.size(values).cast("long").alias("n_found"),
        values.alias("values"),
    )
