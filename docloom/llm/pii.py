"""Format-preserving pseudonyms by keyed Feistel permutations, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import free_names

ROUNDS = 8
#: Applications of a permutation until its value lies in a part of its domain, at most; that so many all fail has a chance below 1e-25.
WALKS = 64
#: Days of 400 Gregorian years from EPOCH are DAY_A * DAY_B, so two halves of these sizes cover them exactly.
EPOCH, DAY_A, DAY_B = "1700-01-01", 189, 773

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: (kind, pattern); the first that matches at a place wins.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)\b)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+"),
    ("secret", r"\b[0-9a-f]{32,}+\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9.])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9]|[-/.][0-9])"),
    ("date", r"(?<![0-9.])[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}(?![0-9]|[-/.][0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9])"),
    ("phone", r"(?<![0-9.-])(?:\+?1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
)
KINDS = tuple(dict.fromkeys(k for k, _ in PATTERNS))
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def _round(key: Column, kind: str, n: Column, r: Column, half: Column) -> Column:
    """A keyed value of 60 bits of a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), n.cast("string"), r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of (left, right) with left below size_left and right below size_right: struct(l, r).

    Rounds add a keyed value of one half to the other, modulo that one's size; an even
    number of them gives halves of the sizes they began with. Any two distinct inputs of the same sizes
    stay distinct.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda acc, i: F.struct(
            acc["r"].alias("l"),
            F.pmod(acc["l"] + _round(key, kind, size_left * 7919 + size_right, i, acc["r"]), F.when(i % 2 == 1, size_left).otherwise(size_right)).cast("long").alias("r"),
        ),
    )


def permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """Another string of as many digits: two to eighteen on each side of the cut."""
    n = F.length(digits)
    a = (n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    moved = feistel(F.substr(digits, F.lit(1), a).cast("long"), F.substr(digits, a + 1).cast("long"), power(a), power(n - a), key, kind)
    return F.concat(F.lpad(moved["l"].cast("string"), a, F.lit("0")), F.lpad(moved["r"].cast("string"), n - a, F.lit("0")))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(pattern: Column, digits: Column) -> Column:
    """pattern with its digits replaced by these, in order."""
    return F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["k"] + 1, F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))
        ),
        lambda acc: acc["out"],
    )


def luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Luhn's sum from the right; last_doubled for digits that still lack their check digit."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (F.length(digits) - i) % 2 == (0 if last_doubled else 1),
            F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0),
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )


def _card(m: Column, key: Column) -> Column:
    """A number that passes Luhn's test becomes another that does; others stay."""
    d = only_digits(m)
    body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string"))
    full = F.element_at(F.transform(F.array(body), check), 1)
    return F.when(luhn_sum(d, False) % 10 == 0, refill(m, full)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """The last ten digits move (all, where there are fewer); a country code stays."""
    d = only_digits(m)
    stay = F.greatest(F.length(d) - 10, F.lit(0))
    return refill(m, F.concat(F.substr(d, F.lit(1), stay), permute_digits(F.substr(d, stay + 1), key, "phone")))


def _ssn(m: Column, key: Column) -> Column:
    """Numbers that can be issued (area 1 to 899 but 666, group 1 to 99, serial 1 to 9999) are permuted among themselves; others stay."""
    ok = ~m.rlike("^(?:000|666|9..)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    moved = feistel(area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    made = F.transform(F.array(moved), lambda x: F.concat_ws("-", pad(x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), pad(F.floor(x["r"] / 9999) + 1, 2), pad(x["r"] % 9999 + 1, 4)))
    return F.when(ok, F.element_at(made, 1)).otherwise(m)


def _ip(m: Column, key: Column) -> Column:
    o = F.split(m, r"\.")
    part = lambda k: F.element_at(o, k).cast("long")
    moved = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, "ip")
    return F.element_at(
        F.transform(F.array(moved), lambda x: F.concat_ws(".", (x["l"] / 256).cast("long"), x["l"] % 256, (x["r"] / 256).cast("long"), x["r"] % 256)), 1
    )


def _date(m: Column, key: Column) -> Column:
    """A date of the 400 years from EPOCH becomes another, written alike; other strings stay.

    A date is read day first where it can be. One that fits month first only has a day above the twelfth and becomes
    another such date, so what is written can't be read day first, and no two dates become one string.
    """
    sep = F.regexp_extract(m, "[-/.]", 0)
    first = m.rlike("^[0-9]{4}")
    p = F.split(m, "[-/.]")
    part = lambda k: F.element_at(p, k)
    two = lambda x: F.lpad(x, 2, "0")
    day_first = part(2).cast("int") <= 12
    iso = F.when(first, F.concat_ws("-", part(1), two(part(2)), two(part(3)))).when(day_first, F.concat_ws("-", part(3), two(part(2)), two(part(1)))).otherwise(
        F.concat_ws("-", part(3), two(part(1)), two(part(2)))
    )
    date = F.try_to_date(iso, "yyyy-MM-dd")
    days = F.datediff(date, F.lit(EPOCH).cast("date"))
    base = F.lit(EPOCH).cast("date")

    def walk(x: Column) -> Column:
        moved = feistel((x / DAY_B).cast("int"), x % DAY_B, F.lit(DAY_A), F.lit(DAY_B), key, "date")
        return F.element_at(F.transform(F.array(moved), lambda y: (y["l"] * DAY_B + y["r"]).cast("int")), 1)

    late = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), walk(days), lambda acc, i: F.when(F.dayofmonth(F.date_add(base, acc)) > 12, acc).otherwise(walk(acc)))
    new = F.date_add(base, F.when(first | day_first, walk(days)).otherwise(late))
    # A day or month that stood without a leading zero is written without one, where the new one has one digit.
    like = lambda x, pattern, old: F.when(F.length(old) == 1, F.date_format(x, pattern[:1])).otherwise(F.date_format(x, pattern))
    written = F.transform(F.array(new), lambda x: F.when(first, F.concat_ws("-", F.date_format(x, "yyyy"), like(x, "MM", part(2)), like(x, "dd", part(3)))).when(
        day_first, F.concat_ws("-", like(x, "dd", part(1)), like(x, "MM", part(2)), F.date_format(x, "yyyy"))
    ).otherwise(F.concat_ws("-", like(x, "MM", part(1)), like(x, "dd", part(2)), F.date_format(x, "yyyy"))))
    return F.when(days.between(0, DAY_A * DAY_B - 1), F.replace(F.element_at(written, 1), F.lit("-"), sep)).otherwise(m)


def _hash(key: Column, kind: str, s: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), s), 256)


def _email(m: Column, key: Column) -> Column:
    """A mailbox is no number: it becomes a keyed name, the same for the same address in any case."""
    return F.concat(F.lit("u"), F.substring(_hash(key, "email", F.lower(m)), 1, 12), F.lit("@mail.invalid"))


def _secret(m: Column, key: Column) -> Column:
    """A keyed hash of the value stands for it; a name before it, as in token=, stays."""
    name = F.regexp_extract(m, r"(?i)^((?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)\s*[=:]\s*[\"']?)", 1)
    return F.concat(name, F.lit("x"), F.substring(_hash(key, "secret", F.substr(m, F.length(name) + 1)), 1, 15))


def _iban(m: Column, key: Column) -> Column:
    """An account whose check digits hold gets permuted digits and new check digits; others stay."""
    flat = F.replace(m, F.lit(" "), F.lit(""))

    def mod97(s: Column) -> Column:
        return F.aggregate(
            F.split(s, ""),
            F.lit(0).cast("long"),
            lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97)
            .when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97)
            .otherwise(acc),
        )

    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    rest = F.substr(flat, F.lit(5))
    digits = only_digits(rest)
    moved = F.when(F.length(digits) >= 4, refill(rest, permute_digits(digits, key, "iban"))).otherwise(rest)
    country = F.substr(flat, F.lit(1), F.lit(2))
    checked = F.transform(F.array(moved), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    spaced = F.when(F.contains(m, F.lit(" ")), F.rtrim(F.regexp_replace(F.element_at(checked, 1), "(.{4})", "$1 "))).otherwise(F.element_at(checked, 1))
    return F.when(F.length(flat).between(15, 34) & (mod97(turned) == 1), spaced).otherwise(m)


MAKERS = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone}


def _kind(m: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        own = pattern.replace(r"\2", r"\1").replace(r"\3", r"\1")
        test = m.rlike(f"^(?:{own})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _hidden(spark: SparkSession, key: str) -> Column:
    """The key as the one value of a local table: plans, and so the UI and event logs, name the table's column and not the value."""
    jvm = spark._jvm
    cell = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    cell[0] = key
    rows = jvm.java.util.ArrayList()
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(cell))
    schema = jvm.org.apache.spark.sql.types.StructType.fromDDL("key string")
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark).scalar()


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with numbers, dates and addresses of persons in text_col replaced; n_pii and pii (kinds) added.

    Card numbers (Luhn), calendar dates, account numbers (mod 97), social security
    numbers, IPv4 addresses and telephone numbers are validated and permuted within
    their own format under a secret key, so equal values stay equal in all documents and
    distinct ones stay distinct. Mail addresses and secrets, which have no such format,
    become keyed names. What fails its validation stays. Values of any length are replaced whole.

    A text is split at the matches in one projection; nothing is shuffled. Texts without a
    digit or @ are passed through. A null text stays null with no findings, an empty one stays empty; a very long text is
    worked on whole within its row. Ids are not read, so null and repeated ids and repeated rows stay as they are, and equal
    texts become equal. An empty table stays empty. All columns,
    their order and all rows stay, whatever the columns' names; n_pii and pii are replaced if counts is set.
    """
    text = F.col(text_col)
    hidden, found_, changed_ = free_names(docs.columns, "_key", "_found", "_changed")
    found = F.when(text.rlike("[0-9@]|(?i:password|passwd|pwd|secret|key|token)"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    some = F.size(F.col(found_)) > 0
    changed = F.transform(
        F.col(found_),
        lambda m: F.element_at(F.transform(F.array(F.struct(m.alias("m"), _kind(m).alias("k"))), lambda x: F.struct(x["k"].alias("k"), _made(x, F.col(hidden)).alias("m"), x["m"].alias("was"))), 1),
    )
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, F.col(changed_), lambda p, c: F.concat(p, F.coalesce(c["m"], F.lit("")))), "")
    out = docs.withColumn(hidden, _hidden(docs.sparkSession, key)).withColumn(found_, found).withColumn(changed_, F.when(some, changed))
    cols = [F.when(some, joined).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if not (counts and c in ("n_pii", "pii"))]
    if counts:
        real = F.filter(F.col(changed_), lambda c: c["m"] != c["was"])
        cols += [
            F.coalesce(F.size(real), F.lit(0)).cast("long").alias("n_pii"),
            F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda c: c["k"]))), ","), F.lit("")).alias("pii"),
        ]
    return out.select(*cols)


def _made(x: Column, key: Column) -> Column:
    out = None
    for kind, make in MAKERS.items():
        out = F.when(x["k"] == kind, make(x["m"], key)) if out is None else out.when(x["k"] == kind, make(x["m"], key))
    return out.otherwise(x["m"])
