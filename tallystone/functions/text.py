"""Amounts, descriptions and numbers read out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and patterns that decide what an amount, merchant or number is.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MONEY_NOISE = "$£€¥" + WHITE
_DIGITS = r"[0-9,]*\.?[0-9,]*[0-9],*"
# more than six decimals are allowed only where the others are zero
SIGNED_NUMBER = (f"^(?!.*\\.(?:,*[0-9]){{6}}[0-9,]*[1-9])"
                 f"(?:\x01?{_DIGITS}-|\x01?-{_DIGITS}|\x01\\+?{_DIGITS}|\\+?,*[-\x01]?{_DIGITS})$")
PLAIN_NUMBER = r"^-?[0-9]{1,20}(?:\.[0-9]{1,6})?\z"
AMOUNT_CHARACTERS = f"^[-0-9()\x01+,.{MONEY_NOISE}]*+\\z"
PROCESSOR_PREFIX = r"(?iU)^(SQ|TST|SP|PAYPAL|PP|IC|WPY|EB)\s*\*\s*"
EMBEDDED_DATE = r"(?U)(?<=\S)\s+\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?\s*$"
TRAILING_STORE = r"(?U)(?<=\S)\s*#\s*\d+\s*$"
TRAILING_DIGITS = r"(?U)(?<=\S)\s+\d{2,}\s*$"
COUNTERPARTY = r"(?is)^(.*?\b(?:from|to)\b)\s*(.*)$"
BANK_REFERENCE = r"\s+([A-Z0-9]{6,})$"
NUMBER = (
    r"(?<![\w.])(?:\$\s*)?(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)%?(?!\w|\.\d|,\d)"
)

AMOUNT_TYPE = "decimal(28,6)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def strip_cell(text: Column) -> Column:
    """The same for a column that is there already, as most cells have a plain character at both ends."""
    def plain(end):
        return F.ascii(end).between(33, 126)

    return F.when(plain(F.left(text, F.lit(1))) & plain(F.right(text, F.lit(1))), text).otherwise(strip(text))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def once(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often the use looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_amount(raw: Column, decimal_comma: bool = False) -> Column:
    """Exact decimal from a bank cell; null where the cell is not an amount."""
    return stripped_amount(strip(raw), decimal_comma)


def stripped_amount(text: Column, decimal_comma: bool = False) -> Column:
    """The same for a cell already stripped.

    A plain number is read as it stands. In others brackets become the mark \\x01. One pattern
    then says whether the text is a number with one sign at most, before or behind it.
    """
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) > 1)
    marked = F.when(bracketed, F.concat(F.lit("\x01"), F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    # a decimal comma and the points between groups change places
    bare = F.translate(marked, (",." if decimal_comma else "") + MONEY_NOISE, ".," if decimal_comma else "")
    other = once(bare, _signed_number)
    return other if decimal_comma else F.when(text.rlike(PLAIN_NUMBER), text.try_cast(AMOUNT_TYPE)).otherwise(other)


def _signed_number(text: Column) -> Column:
    less = F.contains(text, F.lit("-")) | F.contains(text, F.lit("\x01"))
    number = F.concat(F.when(less, "-").otherwise(""), F.translate(text, "\x01+-,", ""))
    # more decimals than the type holds are refused, never rounded away
    return F.when(text.rlike(SIGNED_NUMBER), number.try_cast(AMOUNT_TYPE))


def normalise_description(raw: Column) -> Column:
    """The merchant key that survives re-billing; never empty, null for blank text.

    A suffix goes only where something stands before it, which the patterns ask for.
    """
    return once(F.upper(strip(raw)), _merchant_key)


def _merchant_key(whole: Column) -> Column:
    text = whole
    for pattern, replacement in (
        (PROCESSOR_PREFIX, ""), (EMBEDDED_DATE, ""), (TRAILING_STORE, ""), (TRAILING_DIGITS, ""),
        (r"(?U)\s{2,}", " "),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return F.when(whole != "", once(strip(text), lambda key: F.when(key != "", key).otherwise(whole)))


def redact(description: Column) -> Column:
    """The shape of a description: digits to 9, letters to X, the rest kept."""
    return F.regexp_replace(F.regexp_replace(strip(description), r"\p{Nd}", "9"), r"\p{L}", "X")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def crude_merchant(description: Column) -> Column:
    """First two upper-cased words."""
    return F.array_join(F.slice(words(F.upper(description)), 1, 2), " ")


def digit_share(description: Column) -> Column:
    """Share of characters that are digits, three places."""
    length = F.length(description)
    digits = F.regexp_count(description, F.lit(r"\p{Nd}")).cast("decimal(20,0)")
    return F.when(length == 0, F.lit(0)).otherwise(
        F.bround(digits / F.nullif(length, F.lit(0)).cast("decimal(20,0)"), 3)
    ).cast("decimal(9,3)")


def is_peer_payment(description: Column) -> Column:
    return F.contains(F.lower(description), F.lit("zelle")) & description.rlike(COUNTERPARTY)


def counterparty(description: Column) -> Column:
    """The other person's name on a peer payment without the bank's reference."""
    tail = F.regexp_extract(description, COUNTERPARTY, 2)
    name = F.upper(strip(F.regexp_replace(tail, BANK_REFERENCE, "")))
    return F.when(is_peer_payment(description), F.nullif(name, F.lit("")))


def masked(description: Column, alias: Column) -> Column:
    """Direction kept, name replaced; untouched where there is no alias."""
    head = strip(F.regexp_extract(description, COUNTERPARTY, 1))
    return F.when(alias.isNull(), description).otherwise(F.concat(head, F.lit(" "), alias))


def number_texts(text: Column) -> Column:
    """The number part of every numeric token, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def number_raws(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def decimal_places(number: Column) -> Column:
    fraction = F.regexp_extract(number, r"\.(\d+)$", 1)
    return F.length(fraction)


def label_title(code: Column) -> Column:
    return F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def label_remainder(code: Column) -> Column:
    """Text after the first underscore, first letter capital, the rest lower."""
    rest = F.lower(F.replace(F.regexp_extract(code, r"^[^_]*_(.*)$", 1), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 20))


def email_key(email: Column) -> Column:
    return F.lower(strip(email))
