"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation inside each format.

A value is a sequence of symbols, each with its own radix (digits 10, octets 256, a card's payload digits, a date as a
place in the 400-year cycle of 189 * 773 days, ...). The sequence is cut in two halves; a round adds symbols derived from
SHA-512(key, format, round, other half) to one half, position by position modulo its radix, and swaps. Each round is
invertible, so the whole is a permutation of the format: equal values get equal pseudonyms in all documents, different ones
stay different, lengths and separators stay, and what is validated - Luhn and IBAN check digits, calendar dates, octets, social
security ranges - is valid again afterwards. Numbers of a checked format that fail the check are not touched. Secrets are
hexadecimal tokens of 16 characters or more in either case, and keys with the prefixes of common services.

One scan finds the candidates (``regexp_extract_all``), one cuts the text around them, and array functions join the pieces; only
DataFrame functions are used, nothing is shuffled, and texts without a digit, ``@`` or key prefix are not scanned.

Defined cases: a null text stays null, an empty one empty; equal rows give equal results; texts of any length are scanned
whole; a null doc_id and all other columns, whatever their names, are carried along (if one is pii_replaced, the
result's column gets a ``_``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import sheltered

ROUNDS = 8
_AN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: kind: what a candidate looks like. The order is that of the alternation.
#: A hexadecimal token comes before an IBAN, which may be all hexadecimal; ``pseudonym`` tries the IBAN's check first.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{16,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*\d)(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{16,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: (?!(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{16,}(?![A-Z0-9])))?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    "date": r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAYBE = "[0-9@]|AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|[spr]k_(?:live|test)_|sk-|AIza|npm_|pypi-|hf_|SG\\.|eyJ"


def _ints(c: Column) -> Column:
    return c.cast("array<int>")


def feistel(values: Column, radices: Column, tweak: Column, key: str) -> Column:
    """The permuted symbols of ``values`` (array<int>), each within its radix."""
    n = F.size(values)
    half = (n / 2).cast("int")
    start = F.struct(F.slice(values, F.lit(1), half).alias("a"), F.slice(values, half + 1, n - half).alias("b"), F.slice(radices, F.lit(1), half).alias("ra"), F.slice(radices, half + 1, n - half).alias("rb"))

    def turn(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.array_join(s["b"].cast("array<string>"), ",")), 512)
        shift = lambda j: F.conv(F.substring(digest, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        mixed = F.transform(s["a"], lambda x, j: ((x + shift(j)) % F.element_at(s["ra"], j + 1)).cast("int"))
        return F.struct(s["b"].alias("a"), mixed.alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(mask: Column, symbols: Column, is_symbol) -> Column:
    """``mask`` with its symbol characters replaced by ``symbols`` in order."""
    done = F.aggregate(_chars(mask), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.when(is_symbol(c), F.element_at(symbols, s["at"])).otherwise(c)).alias("out"), (s["at"] + F.when(is_symbol(c), F.lit(1)).otherwise(F.lit(0))).alias("at")))
    return done["out"]


def _is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


def _permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    values = _ints(_chars(digits))
    return feistel(values, F.transform(values, lambda _: F.lit(10)), F.lit(tweak), key).cast("array<string>")


def _luhn_sum(digits: Column, check_in_place: bool) -> Column:
    """Sum of the digits, every second one from the right doubled; without a check digit the last one is doubled."""
    from_right = F.reverse(_ints(_chars(digits)))
    odd = F.lit(1 if check_in_place else 0)
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    return F.aggregate(F.transform(from_right, lambda x, i: F.when(i % 2 == odd, twice(x)).otherwise(x)), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    payload = F.array_join(_permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key), "")
    check = ((10 - _luhn_sum(payload, False) % 10) % 10).cast("string")
    return F.when(_luhn_sum(d, True) % 10 == 0, _refill(m, F.split(F.concat(payload, check), ""), _is_digit)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d{1,2}", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refill(rest, _permuted_digits(_digits(rest), "phone", key), _is_digit))


def _octets(m: Column, key: str) -> Column:
    values = _ints(F.split(m, r"\."))
    out = F.array_join(feistel(values, F.transform(values, lambda _: F.lit(256)), F.lit("ipv4"), key).cast("array<string>"), ".")
    return F.when(F.forall(values, lambda v: v < 256), out).otherwise(m)


def _date(m: Column, key: str) -> Column:
    day = F.expr("date'1800-01-01'")
    at = F.datediff(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"), day)
    symbols = F.array((at / 773).cast("int"), (at % 773).cast("int"))
    p = feistel(symbols, F.array(F.lit(189), F.lit(773)), F.lit("date"), key)
    moved = F.date_add(day, F.element_at(p, 1) * 773 + F.element_at(p, 2))
    return F.when(at.between(0, 189 * 773 - 1), F.date_format(moved, "yyyy-MM-dd")).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    part = _ints(F.split(m, "-"))
    area, group, serial = (F.element_at(part, i) for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = feistel(F.array(F.when(area < 666, area - 1).otherwise(area - 2), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key)
    a = F.element_at(p, 1)
    out = F.format_string("%03d-%02d-%04d", F.when(a < 665, a + 1).otherwise(a + 2), F.element_at(p, 2) + 1, F.element_at(p, 3) + 1)
    return F.when(valid, out).otherwise(m)


def _alphabet(m: Column, alphabet: str, tweak: str, key: str) -> Column:
    values = F.transform(_chars(m), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("int"))
    p = feistel(values, F.transform(values, lambda _: F.lit(len(alphabet))), F.lit(tweak), key)
    return F.array_join(F.transform(p, lambda v: F.substring(F.lit(alphabet), v + 1, F.lit(1))), "")


def _mod97(s: Column) -> Column:
    """The number that ``s`` (0-9A-Z) stands for, letters as 10 to 35, modulo 97."""
    values = F.transform(_chars(s), lambda c: (F.instr(F.lit(_AN), c) - 1).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97).cast("int"))


def _classed(s: Column, tweak: str, key: str) -> Column:
    """Letters and digits permuted within lower case, upper case and digits; other characters stay."""
    symbol = lambda c: c.rlike("^[0-9A-Za-z]$")
    cs = F.filter(_chars(s), symbol)
    base = lambda c: F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[A-Z]"), F.lit(65)).otherwise(F.lit(97))
    radices = F.transform(cs, lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(26)))
    p = feistel(F.transform(cs, lambda c: F.ascii(c) - base(c)), radices, F.lit(tweak), key)
    return _refill(s, F.zip_with(p, cs, lambda v, c: F.char(v + base(c))), symbol)


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    country, bban = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    moved = _classed(bban, "iban", key)
    check = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    symbol = lambda c: c != " "
    valid = _mod97(F.concat(bban, country, F.substring(s, 3, 2))) == 1
    return F.when(valid, _refill(m, _chars(F.concat(country, check, moved)), symbol))  # else null: it may be a secret


def _email(m: Column, key: str) -> Column:
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(_classed(local, "email", key), F.lit("@"), host)


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), _alphabet(F.substring(m, 5, 16), _AN, "access_key", key))


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal digits permuted by their value, so that copies in another case stay linked; a token in capitals gets capitals,
    in a mixed one the places of capitals keep them."""
    p = _alphabet(F.lower(m), "0123456789abcdef", "secret", key)
    mixed = F.array_join(F.zip_with(_chars(p), _chars(m), lambda a, b: F.when(b.rlike("[A-F]"), F.upper(a)).otherwise(a)), "")
    return F.when(~m.rlike("[A-F]"), p).when(~m.rlike("[a-f]"), F.upper(p)).otherwise(mixed)


def _token(m: Column, key: str) -> Column:
    """The prefix stays; letters and digits after it are permuted within lower case, upper case and digits, other characters stay."""
    prefix = F.regexp_extract(m, r"^(?:gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|(?:sk|pk|rk)_(?:live|test)_|sk-|AIza|npm_|pypi-|hf_|SG\.|eyJ)", 0)
    cs = _chars(F.substring(m, F.length(prefix) + 1, F.length(m)))
    base = lambda c: F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[A-Z]"), F.lit(65)).when(c.rlike("[a-z]"), F.lit(97)).otherwise(F.ascii(c))
    radices = F.transform(cs, lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).when(c.rlike("[A-Za-z]"), F.lit(26)).otherwise(F.lit(1)))
    p = feistel(F.transform(cs, lambda c: F.ascii(c) - base(c)), radices, F.lit("token"), key)
    return F.concat(prefix, F.array_join(F.zip_with(p, cs, lambda v, c: F.char(v + base(c))), ""))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate."""
    make = {"email": _email, "access_key": _access_key, "token": _token, "iban": _iban, "secret": _secret, "phone": _phone, "date": _date, "ssn": _ssn, "card": _card, "ipv4": _octets}
    out = F.lit(None).cast("string")
    for kind, pattern in sorted(reversed(PATTERNS.items()), key=lambda x: x[0] == "iban"):
        whole = pattern.replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z0-9])", "").replace(r"(?<![\d.-])", "").replace(r"(?<![\d-])", "").replace(r"(?<![\d.])", "")
        out = F.coalesce(F.when(m.rlike(f"^(?:{whole})$"), make[kind](m, key)), out)
    return F.coalesce(out, m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of replaced values in ``pii_replaced``."""
    inner, restored = sheltered(docs, text)
    c = F.col(f"`{text}`")
    scanned = inner.select("*", F.explode(F.array(F.when(c.rlike(MAYBE), F.regexp_extract_all(c, F.lit(ANY), F.lit(0))))).alias("_found"))
    masked = scanned.select("*", F.explode(F.array(F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, key))))).alias("_new"))
    joined = F.array_join(F.flatten(F.zip_with(F.split(c, ANY, -1), F.concat("_new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    out = masked.withColumn("pii_replaced", F.when(F.col("_new").isNotNull(), changed).otherwise(0).cast("long"))
    return restored(out.withColumn(text, F.when(F.col("_new").isNotNull(), joined).otherwise(c)), "pii_replaced")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key="a key for tests").select("doc_id", "text", "pii_replaced")
