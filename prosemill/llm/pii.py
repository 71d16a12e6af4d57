"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Found values are validated (Luhn, real dates, number ranges) and permuted by a keyed Feistel network over exactly the values of
their format: each value becomes another valid value of the same shape, equal values become equal ones in every document, and
different values stay different. Two halves x in Z_a and y in Z_b take turns: x += F(key, round, y) mod a, y += F(key, round, x)
mod b. Any a and b give a permutation of a x b values, so no value has to be tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

#: The kinds in the order in which they are tried at a place, and their patterns. A time may follow a date.
PATTERNS = {
    # runs of more than 64 characters before the @ are no addresses
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ymd": r"(?<![0-9A-Za-z/.-])[0-9]{4}([-/.])[0-9]{2}\g[0-9]{2}(?:(?![0-9A-Za-z])|(?=[Tt][0-9]{2}))",
    "dmy": r"(?<![0-9A-Za-z/.-])[0-9]{2}([-/.])[0-9]{2}\g[0-9]{4}(?:(?![0-9A-Za-z])|(?=[Tt][0-9]{2}))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "intl": r"(?<![0-9A-Za-z+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
#: The eras of 400 years that dates are permuted in have 146097 = 189 x 773 days each; this one starts at 1800-01-01.
FIRST_DAY, DAYS = -62091, (189, 773)
ROUNDS = 8


def _numeric() -> str:
    parts, group = [], 0
    for k, p in PATTERNS.items():
        if k != "email":
            group += p.count("([")
            parts.append(p.replace(r"\g", f"\\{group}"))
    return "|".join(parts)


#: A run holds all characters that values other than addresses of mail consist of, up to where such an address starts.
RUN = rf"[0-9+(](?:(?!{PATTERNS['email']})[0-9 ().+/-])*+"
HIT = f"{PATTERNS['email']}|{RUN}"
#: Whether a run can hold a value at all.
NUMERIC = _numeric()
#: Places in a run where a value can start, and what stands there with the character before; no numeric value is longer.
CUT = r"(?<=[^0-9A-Za-z])(?=[0-9+(])"
START = r"(?=([^0-9A-Za-z][0-9+(][\s\S]{0,63}))"
CARD_LENGTHS = range(19, 12, -1)
VALUES = "array<struct<kind:string,original:string,pseudonym:string>>"


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    return luhn_sum(digits) % 10 == 0


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def round_value(key: Column, kind: Column, i: Column, half: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, kind, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: Column, kind: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """struct(x, y): the permuted halves, x in Z_a and y in Z_b."""

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(((s["x"] + round_value(key, kind, i, s["y"]) % a) % a).alias("x"), s["y"].alias("y"))).otherwise(
            F.struct(s["x"].alias("x"), ((s["y"] + round_value(key, kind, i, s["x"]) % b) % b).alias("y"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def feistel_digits(key: Column, kind: Column, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    kind = F.concat(kind, n.cast("string"))
    permuted = feistel(key, kind, F.substr(digits, F.lit(1), left), F.substr(digits, left + 1, right), F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), right).cast("long"))
    return let(permuted, lambda p: F.concat(F.lpad(p["x"].cast("string"), left, "0"), F.lpad(p["y"].cast("string"), right, "0")))


def refill(mask: Column, digits: Column) -> Column:
    """mask with its digits replaced by these, in order."""
    def fill(d: Column) -> Column:
        return F.aggregate(
            F.split(mask, "(?<=.)(?=.)"),
            F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
            lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["text"], F.substr(d, s["at"], F.lit(1))).alias("text"), (s["at"] + 1).alias("at"))).otherwise(
                F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))
            ),
            lambda s: s["text"],
        )

    return let(digits, fill)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(key: Column, m: Column) -> Column:
    """The first digit stays, the middle is permuted, the last is the new check digit."""

    def checked(body: Column) -> Column:
        return F.concat(body, ((F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    def one(d: Column) -> Column:
        new = let(F.concat(F.substring(d, 1, 1), feistel_digits(key, F.lit("card"), F.substr(d, F.lit(2), F.length(d) - 2))), checked)
        return F.when(luhn_valid(d), refill(m, new))

    return let(_digits(m), one)


def _phone(key: Column, m: Column) -> Column:
    """Area and exchange codes are 200 to 999 each: 800 x 800 x 10000 = 80000 x 80000 numbers."""

    def one(d: Column) -> Column:
        at = F.length(d) - 9
        n = (F.substr(d, at, F.lit(3)).cast("long") - 200) * 8000000 + (F.substr(d, at + 3, F.lit(3)).cast("long") - 200) * 10000 + F.substr(d, at + 6, F.lit(4)).cast("long")
        p = feistel(key, F.lit("phone"), F.floor(n / 80000), n % 80000, F.lit(80000), F.lit(80000))
        written = lambda new: F.concat(F.substr(d, F.lit(1), at - 1), (F.floor(new / 8000000) + 200).cast("string"), (F.floor(new / 10000) % 800 + 200).cast("string"), F.lpad((new % 10000).cast("string"), 4, "0"))
        return refill(m, let(let(p, lambda h: h["x"] * 80000 + h["y"]), written))

    return let(_digits(m), one)


def _intl(key: Column, m: Column) -> Column:
    """The first two digits, where the country code is, stay."""
    return let(_digits(m), lambda d: refill(m, F.concat(F.substring(d, 1, 2), feistel_digits(key, F.lit("intl"), F.substr(d, F.lit(3), F.length(d) - 2)))))


def _ip(key: Column, m: Column) -> Column:
    """Four numbers up to 255 without leading zeros: 65536 x 65536 addresses."""
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    permuted = feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    written = lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256)])
    valid = F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x))
    return F.when(valid, let(permuted, written))


def _ssn(key: Column, m: Column) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    permuted = feistel(key, F.lit("ssn"), index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    def written(p: Column) -> Column:
        new = F.floor(p["x"] / 99)
        area2 = F.when(new >= 665, new + 2).otherwise(new + 1)
        return F.concat_ws("-", F.lpad(area2.cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["y"] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(permuted, written))


def _date(key: Column, m: Column, kind: str) -> Column:
    """A real day from 1800 to 2199; day.month.year, or month.day.year where only that is a real day."""

    def day(y: Column, mo: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")

    if kind == "ymd":
        sep, forms = F.substring(m, 5, 1), {"yMd": day(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))}
    else:
        a, b, y = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
        sep, forms = F.substring(m, 3, 1), {"dMy": day(y, b, a), "Mdy": day(y, a, b)}
    def moved(form: str):
        def one(date: Column) -> Column:
            n = F.unix_date(date) - FIRST_DAY
            p = feistel(key, F.lit("date"), F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]))
            new = let(p, lambda h: F.date_from_unix_date((h["x"] * DAYS[1] + h["y"] + FIRST_DAY).cast("int")))
            parts = {"y": "yyyy", "M": "MM", "d": "dd"}
            written = let(new, lambda x: F.concat(F.date_format(x, parts[form[0]]), sep, F.date_format(x, parts[form[1]]), sep, F.date_format(x, parts[form[2]])))
            return F.when(date.isNotNull() & n.between(0, DAYS[0] * DAYS[1] - 1), written)

        return one

    return F.coalesce(*[let(date, moved(form)) for form, date in forms.items()])


def _email(key: Column, m: Column) -> Column:
    """The part before the @: letters become letters of the same case, digits digits; the halves of it take turns."""
    local = F.substring_index(m, "@", 1)
    n = F.length(local)
    left = F.floor((n + 1) / 2).cast("int")

    def added(half: Column, other: Column, i: Column) -> Column:
        def one(h: Column):
            def char(c: Column, k: Column) -> Column:
                v = F.conv(F.substr(h, k % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
                base = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
                return F.when(base.isNull(), c).otherwise(F.chr((F.ascii(c) - base + v) % F.when(base == 48, 10).otherwise(26) + base))

            return F.array_join(F.transform(F.split(half, "(?<=.)(?=.)"), char), "")

        return let(F.sha2(F.concat_ws("|", key, F.lit("email"), i.cast("string"), other), 256), one)

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(added(s["x"], s["y"], i).alias("x"), s["y"].alias("y"))).otherwise(F.struct(s["x"].alias("x"), added(s["y"], s["x"], i).alias("y")))

    halves = F.struct(F.substr(local, F.lit(1), left).alias("x"), F.substr(local, left + 1, n - left).alias("y"))
    permuted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, turn)
    return let(permuted, lambda p: F.concat(p["x"], p["y"], F.substr(m, n + 1, F.length(m) - n)))


def _here(window: Column, pattern: str) -> Column:
    """What the pattern matches right after the window's first character; empty if it doesn't."""
    inner = pattern.replace(r"\g", r"\2")
    return F.regexp_extract(window, rf"^[\s\S]({inner})", 1)


def _card_here(window: Column) -> Column:
    """The longest number that starts here, ends with a token and passes Luhn."""
    forms = [PATTERNS["card"].replace("{12,18}", f"{{{n - 1}}}") for n in CARD_LENGTHS]
    valid = F.filter(F.array(*[_here(window, p) for p in forms]), lambda m: (m != "") & luhn_valid(_digits(m)))
    return F.when(_here(window, PATTERNS["card"]) != "", F.get(valid, F.lit(0)))


def _value(kind: str, original: Column, pseudonym: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), original.alias("original"), pseudonym.alias("pseudonym"))


def valid_here(key: Column, window: Column) -> Column:
    """struct(kind, original, pseudonym) of the first kind with a valid value after the window's first character, or null."""
    by = {"ip": _ip, "ymd": lambda k, x: _date(k, x, "ymd"), "dmy": lambda k, x: _date(k, x, "dmy"), "ssn": _ssn, "phone": _phone, "intl": _intl, "card": _card}

    def tried(kind: str) -> Column:
        def one(m: Column) -> Column:
            return F.when(m != "", let(by[kind](key, m), lambda p: F.when(p.isNotNull(), _value(kind, m, p))))

        return let(_card_here(window) if kind == "card" else _here(window, PATTERNS[kind]), one)

    return F.coalesce(*[tried(k) for k in KINDS if k != "email"])


def in_run(key: Column, run: Column, before: Column, after: Column) -> Column:
    """struct(text, values): the run with its valid values replaced, and these in order.

    Each place where a value can start is tried from the left; only a valid value uses up its characters, so one that fails hides
    none that starts inside it or reaches beyond it. before and after: what surrounds the run, not empty.
    """
    none = F.array().cast(VALUES)

    def step(s: Column, x: Column) -> Column:
        taken = (s["skip"] == 0) & x["value"].isNotNull()
        n = F.when(taken, F.length(x["value"]["original"])).otherwise(s["skip"])
        return F.struct(
            F.greatest(n - F.length(x["part"]), F.lit(0)).alias("skip"),
            F.concat(s["text"], F.when(taken, x["value"]["pseudonym"]).otherwise(""), F.substr(x["part"], n + 1, F.length(x["part"]))).alias("text"),
            F.when(taken, F.concat(s["values"], F.array(x["value"]))).otherwise(s["values"]).alias("values"),
        )

    def walked(text: Column) -> Column:
        def along(parts: Column) -> Column:
            places = F.transform(F.regexp_extract_all(text, F.lit(START), 1), lambda w, i: F.struct(F.get(parts, i + 1).alias("part"), valid_here(key, w).alias("value")))
            bare = lambda s: F.struct(F.substr(s["text"], F.lit(2), F.length(s["text"]) - 1 - F.length(after)).alias("text"), s["values"].alias("values"))
            return F.aggregate(places, F.struct(F.lit(0).alias("skip"), F.get(parts, F.lit(0)).alias("text"), none.alias("values")), step, bare)

        return let(F.split(text, CUT, -1), along)

    surrounded = F.concat(F.right(before, F.lit(1)), run, after)
    return let(surrounded, lambda text: F.when(text.rlike(NUMERIC), walked(text)).otherwise(F.struct(run.alias("text"), none.alias("values"))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """docs with personal data in the text column replaced, plus found: array of struct(kind, original, pseudonym), in order.

    What fails its validation stays as it is and isn't listed, and the search goes on at the next place inside it. Where valid values
    overlap, the one that starts first counts, of cards the longest. A null text stays null with an empty list, and so does an empty
    one; a column named as found is replaced, all others pass. Rows don't depend on each other: there is no shuffle.
    """
    t, k = F.col(text), F.lit(key)
    pieces, done = free_name(docs, "_pieces"), free_name(docs, "_done")
    # an array, not a struct: Spark would compute a struct's fields again at each use
    hits = F.zip_with(F.split(t, HIT, -1), F.regexp_extract_all(t, F.lit(HIT), 0), lambda p, m: F.struct(p.alias("piece"), m.alias("hit")))

    def one(x: Column, i: Column) -> Column:
        edge = lambda c: F.when(c == "", "\n").otherwise(c)
        digits = F.substring(F.coalesce(F.get(pieces, i + 1)["hit"], F.lit("")), 1, 2)

        def numbers(piece: Column) -> Column:
            after = F.when(F.concat(F.substring(piece, 1, 3), digits).rlike("^[Tt][0-9]{2}"), F.concat(F.substring(piece, 1, 3), digits)).otherwise(edge(F.substring(piece, 1, 1)))
            return let(after, lambda a: in_run(k, x["hit"], edge(x["piece"]), a))

        mail = let(_email(k, x["hit"]), lambda p: F.struct(p.alias("text"), F.array(_value("email", x["hit"], p)).alias("values")))
        return F.when(x["hit"].contains("@"), mail).when(x["hit"].isNotNull(), let(F.get(pieces, i + 1)["piece"], numbers))

    names = [c for c in docs.columns if c != found]
    listed = docs.withColumn(pieces, F.when(t.rlike("[0-9@]"), hits)).withColumn(done, F.transform(pieces, one))
    rebuilt = F.array_join(F.zip_with(pieces, done, lambda x, h: F.concat(x["piece"], F.coalesce(h["text"], F.lit("")))), "")
    return listed.select(
        *[F.when(F.size(pieces) > 1, rebuilt).otherwise(t).alias(c) if c == text else F.col(c) for c in names],
        F.coalesce(F.flatten(F.transform(F.filter(done, lambda h: h.isNotNull()), lambda h: h["values"])), F.array().cast(VALUES)).alias(found),
    )
