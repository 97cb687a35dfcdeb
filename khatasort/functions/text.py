"""Text of counterparties as native column expressions: keys, shapes and markers.

White space is Unicode's (``(?U)``), letters are any script's.  Null text counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, vocabulary


def let(value: Column, of) -> Column:
    """of(value), with the value computed once however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with further columns, behind a one-row generator: a filter on a computed column isn't rewritten into copies of its expression, while filters on other columns still go down to the scan."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def place(rows: DataFrame) -> Column:
    """The order of statement rows: file by file where they carry a path, then by row number."""
    return F.struct(*(F.col(c) for c in ("path", "row_number") if c in rows.columns))


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def stripped(column: Column) -> Column:
    return F.regexp_replace(text(column), r"(?U)^\s+|\s+$", "")


def words(column: Column) -> Column:
    """The words between white space, none of them empty."""
    return F.filter(F.split(text(column), r"(?U)\s+"), lambda t: t != "")


def canon(column: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text(column)), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def halved(tokens: Column) -> Column:
    """A phrase that stands there twice, once."""

    def of(t: Column) -> Column:
        half = F.greatest((F.size(t) / 2).cast("int"), F.lit(1))
        return F.when((F.size(t) >= 2) & (F.size(t) % 2 == 0) & (F.slice(t, 1, half) == F.slice(t, half + 1, half)), F.slice(t, 1, half)).otherwise(t)

    return let(tokens, of)


def _unprefixed(column: Column) -> Column:
    return F.regexp_replace(stripped(column), f"(?iU){fixed.PREFIX}", "")


def merchant_tokens(column: Column) -> Column:
    """Tokens of a merchant's name before trailing codes go: no verbs, masks, references or corporate forms."""
    s = F.regexp_replace(_unprefixed(column), f"(?iU){fixed.MESSRS}", "")
    s = F.regexp_replace(F.regexp_replace(s, f"(?iU){fixed.MASKED}", " "), fixed.SEPARATORS, " ")
    reference = lambda t: (t.rlike("^[a-z0-9]{8,}$") & t.rlike("[0-9]")) | t.rlike(r"(?U)^\d{5,}$") | t.rlike("^[*x]{2,}[0-9]*$")
    return F.filter(words(F.lower(s)), lambda t: ~reference(t) & ~t.isin(*fixed.CORPORATE))


def without_codes(tokens: Column) -> Column:
    """Tokens up to the last that isn't an outlet code or a number; the first always stays."""

    def of(t: Column) -> Column:
        is_name = F.transform(F.reverse(t), lambda x: ~x.rlike(r"^[a-z]{0,3}\d{1,5}$|(?U)^\d+$"))
        keep = let(F.array_position(is_name, True), lambda back: F.when(back == 0, F.lit(1)).otherwise(F.size(t) - back + 1).cast("int"))
        return F.when(F.size(t) > 1, F.slice(t, 1, keep)).otherwise(t)

    return let(tokens, of)


def normalize_merchant(column: Column) -> Column:
    """The key of a merchant's name."""
    return canon(F.array_join(halved(without_codes(merchant_tokens(column))), " "))


def normalize_person(column: Column) -> Column:
    """A person's name as a key: outlet codes stay."""
    s = F.regexp_replace(F.regexp_replace(_unprefixed(column), f"(?iU){fixed.MASKED}", " "), fixed.SEPARATORS, " ")
    return F.array_join(halved(words(canon(s))), " ")


def opaque(column: Column) -> Column:
    """A masked account or a bare reference."""
    return stripped(column).rlike(f"{fixed.MASKED_WHOLE}|{fixed.BARE_REFERENCE}")


def commercial(column: Column) -> Column:
    """Any word is a commercial one."""
    known = vocabulary.commercial_words()
    return F.arrays_overlap(words(F.lower(text(column))), known)


def plain_words(column: Column) -> Column:
    """Words of a name: one honorific and digits glued to letters gone."""
    s = F.regexp_replace(stripped(column), f"(?iU){fixed.HONORIFIC}", "")
    return F.transform(words(s), lambda t: F.regexp_replace(t, r"([A-Za-z])\d+$", "$1"))


def person(column: Column) -> Column:
    """The shape of a person's name: 2 to 5 words of letters, none commercial."""
    known = vocabulary.commercial_words()
    shape = lambda t: (F.size(t) >= 2) & (F.size(t) <= 5) & F.forall(t, lambda x: x.rlike(r"^\p{L}+$")) & ~F.arrays_overlap(F.transform(t, F.lower), known)
    return let(plain_words(column), shape)


def short_name(key: Column) -> Column:
    """One or two words of letters."""
    return let(words(key), lambda t: (F.size(t) >= 1) & (F.size(t) <= 2) & F.forall(t, lambda x: x.rlike(r"^\p{L}+$")))


def income_marker(column: Column) -> Column:
    return text(column).rlike(f"(?iU){fixed.INCOME_TEXT}")


def refund_marker(column: Column) -> Column:
    return text(column).rlike(f"(?iU){fixed.REFUND_TEXT}")


def mobile_number(column: Column) -> Column:
    return text(column).rlike(fixed.MOBILE)


def ambiguous(key: Column, full: Column) -> Column:
    """The name holds a phrase that no rule is allowed to guess on."""
    out = F.lit(False)
    for phrase in fixed.AMBIGUOUS:
        out = out | key.contains(phrase) | full.contains(phrase)
    return out


def direction(column: Column) -> Column:
    return F.array_join(words(F.lower(text(column))), " ")


def starts_with_any(column: Column, verbs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for verb in verbs:
        out = out | column.startswith(verb)
    return out


def _mapped(column: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), column)


def coerce_category(column: Column) -> Column:
    """A canonical category from a canonical or an older name, in any case; OTHER for the rest."""
    up = F.translate(F.upper(stripped(column)), " -", "__")
    return F.when(up.isin(*fixed.CATEGORIES), up).otherwise(F.coalesce(_mapped(F.lower(stripped(column)), fixed.FROM_LEGACY), F.lit("OTHER")))


def known_category(column: Column) -> Column:
    """coerce_category(), but null for a name that isn't known."""
    found = coerce_category(column)
    return F.when((found != "OTHER") | F.lower(stripped(column)).isin("other"), found)


def to_legacy(column: Column) -> Column:
    return F.coalesce(_mapped(column, fixed.TO_LEGACY), F.lit("Other"))


def is_category(column: Column) -> Column:
    return F.coalesce(column.isin(*fixed.CATEGORIES), F.lit(False))


def merchant_key(key: Column, full: Column, column: Column) -> Column:
    """The label key: the merchant's key, or the plain text, or the text itself."""
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(full, F.lit("")), stripped(column))


def grams(column: Column) -> Column:
    """Whole words as w:word, and the 2- to 4-letter runs of each word between two spaces."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        none = F.array().cast("array<string>")

        def runs(n: int) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))
            return F.when(F.length(padded) >= n, found).otherwise(none)

        return F.concat(F.array(F.concat(F.lit("w:"), word)), *map(runs, fixed.GRAM_LENGTHS))

    return F.flatten(F.transform(words(column), of))


def bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(fixed.FEATURES)).cast("int")
