"""Scalar text and number functions as Column builders; ASCII rules throughout, as statistical tables need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, blank tokens, currency signs and page furniture.
SEARCH_STOP = ["the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "was", "were", "is", "are", "at", "by", "with", "from", "that", "this", "it", "as", "be", "been", "has", "have", "had"]
CELL_STOP = ["the", "and", "for", "was", "were", "with", "from", "that", "this", "than", "percent", "billion", "billions", "million", "millions", "total", "all", "how", "much", "many", "what", "dollars", "rate", "rates"]
CLAIM_STOP = ["the", "and", "for", "was", "were", "with", "from", "that", "this", "than", "percent", "billion", "million", "rate", "rates", "total", "loans", "all", "its", "has", "have", "according", "reports", "reported", "increased", "decreased", "stood", "carried"]
TOPIC_STOP = ["the", "a", "an", "of", "in", "to", "for", "and", "or", "was", "were", "is", "are", "at", "by", "on", "from", "with", "that", "this", "as", "it", "its", "be", "been", "percent", "million", "billion", "trillion", "about", "up", "down", "rose", "fell", "increased", "decreased", "compared", "than", "had", "has", "have", "which", "while", "also", "over", "under", "per", "cent", "approximately", "estimated", "roughly", "nearly", "some", "all", "both", "these", "those", "there", "their"]
BLANKS = ["", "-", "—", "–", "n/a", "na", "none"]
CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
FURNITURE = r"(?i)^(quarterly|volume|number *[0-9]*|[0-9]{4} +volume|table +[ivx]+-?[a-z]?\b.*|[a-z]+ +[0-9]{1,2}, +[0-9]{4}|page *[0-9]+|[0-9]+)$"
#: What counts as a number in a stored cell; guards every cast, as engines differ on what a cast accepts.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without the white space at both ends (the six characters of \\s); no pattern is run, as this is asked of every cell."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column, most: int | None = None) -> Column:
    """White space runs as one space, ends stripped, clipped."""
    # most texts hold single spaces alone
    out = F.trim(F.when(c.rlike(r"\s\s|[^\S ]"), F.regexp_replace(c, r"\s+", " ")).otherwise(c))
    return out if most is None else F.substring(out, 1, most)


def number(c: Column) -> Column:
    """Double of a plain number, else null."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


#: A short number without signs but a currency's or a per cent sign, and with what its shortest text is.
SHORT = r"^[$€£¥]?((?:0|[1-9][0-9]*)(?:\.[0-9]{0,3}[1-9])?)(?:(?<=\.[0-9]{1,4})0*|\.0+)?%?\z"


def parse_cell(raw: Column) -> Column:
    """Struct (value string, unit string) of a raw table cell.

    Blank tokens are null. A trailing footnote mark goes only where a number is left. A per cent sign or a leading
    currency sign becomes the unit, parentheses a minus, commas go; anything else stays as the stripped text.
    """
    nothing = F.lit(None).cast("string")
    cell = lambda value, unit: F.struct(value.alias("value"), unit.alias("unit"))

    def marked(text: Column) -> Column:
        sign, percent = F.substring(text, 1, 1), text.endswith("%")
        unit = F.when(percent, "%").otherwise(F.coalesce(*[F.when(sign == s, F.lit(name)) for s, name in CURRENCY.items()]))
        return cell(F.regexp_extract(text, SHORT, 1), unit)

    # each step is bound once, as the next one uses it several times; words and short plain numbers need none of them
    def found(text: Column) -> Column:
        plain = text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]{0,3}[1-9])?$") & (text != "-0")
        return F.when(F.lower(text).isin(BLANKS), cell(nothing, nothing)).when(plain | ~text.rlike("[0-9]"), cell(text, nothing)).when(text.rlike(SHORT), marked(text)).otherwise(_unmarked(text))

    # most cells are short numbers or words as they stand, which are told without binding anything
    word = F.when(F.lower(strip(raw)).isin(BLANKS), cell(nothing, nothing)).otherwise(cell(strip(raw), nothing))
    short = F.regexp_extract(raw, SHORT, 1) != ""
    return F.when(raw.isNull(), cell(nothing, nothing)).when(short, marked(raw)).when(~raw.rlike("[0-9]"), word).otherwise(let(strip(raw), found))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unmarked(text: Column) -> Column:
    def chosen(bare: Column) -> Column:
        marked = (bare != text) & (F.length(bare) > 0) & F.regexp_replace(bare, r"^[($€£¥]+", "").rlike(r"^[+-]?[0-9,]*\.?[0-9]+%?\)?$")
        return F.when(marked, bare).otherwise(text)

    bare = strip(F.regexp_replace(text, r"(\s*\*+|(?<=[0-9])\s+[a-z]{1,2})$", ""))
    return let(let(bare, chosen), lambda work: _unsigned(text, work))


def _unsigned(text: Column, work: Column) -> Column:
    percent = work.endswith("%")
    amount_ = F.when(percent, strip(F.regexp_replace(work, "%$", ""))).otherwise(work)

    def without_sign(amount_: Column) -> Column:
        sign = F.regexp_extract(amount_, "^[$€£¥]", 0)
        code = F.coalesce(*[F.when(sign == s, F.lit(name)) for s, name in CURRENCY.items()])
        rest = F.when(sign != "", strip(F.regexp_replace(amount_, "^[$€£¥]", ""))).otherwise(amount_)
        return let(rest, lambda rest: _number(text, rest, F.when(percent, F.lit("%")).otherwise(code)))

    return let(amount_, without_sign)


def _number(text: Column, work: Column, unit: Column) -> Column:
    negative = work.rlike(r"^\(.*\)$")
    clean = F.regexp_replace(F.when(negative, strip(F.regexp_replace(work, r"^\(|\)$", ""))).otherwise(work), ",", "")

    def shown(clean: Column) -> Column:
        plain = clean.rlike(r"^[+-]?[0-9]*\.?[0-9]+$")
        return F.struct(F.when(plain, shown_number(clean, negative)).otherwise(text).alias("value"), F.when(plain, unit).alias("unit"))

    return let(clean, shown)


def shown_number(digits: Column, negative: Column) -> Column:
    """Shortest text of a decimal number, made from its digits: no zeros at the ends, exponents only below 0.0001."""
    body = F.regexp_replace(digits, "^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^0*([0-9]*)", 1), "^$", "0")
    parts = F.struct(whole.alias("whole"), F.regexp_extract(body, r"\.([0-9]*?)0*$", 1).alias("part"))

    def size(p: Column) -> Column:
        tiny = let(F.regexp_replace(p["part"], "^0+", ""), lambda tail: _power(tail, F.length(p["part"]) - F.length(tail) + 1))
        return F.when(p["part"] == "", p["whole"]).when((p["whole"] == "0") & p["part"].startswith("0000"), tiny).otherwise(F.concat(p["whole"], F.lit("."), p["part"]))

    minus = negative != digits.startswith("-")
    return let(let(parts, size), lambda s: F.when(minus & (s != "0"), F.concat(F.lit("-"), s)).otherwise(s))


def _power(tail: Column, power: Column) -> Column:
    rest = F.when(F.length(tail) > 1, F.concat(F.lit("."), F.substring(tail, 2, 1 << 20))).otherwise("")
    return F.concat(F.substring(tail, 1, 1), rest, F.when(power < 10, "e-0").otherwise("e-"), power.cast("string"))


# Fixed value: start of a token that reads as a number.
NUMBER_PREFIX = r"^-?\$?\(?-?[0-9,]*\.?[0-9]+\)?%?"
#: Rewrites, in order, that make a number's text canonical: signs and commas off, parentheses to a minus (which a minus
#: inside cancels), zeros off both ends.
CANONICAL = [
    (r"%+$|,", ""),
    (r"^\$+", ""),
    (r"^\(-(.*)\)$", "+$1"),
    (r"^\((.*)\)$", "-$1"),
    (r"^\+", ""),
    (r"^(-?)0+([0-9])", "$1$2"),
    (r"^(-?)\.", "$10."),
    (r"(\.[0-9]*?)0+$", "$1"),
    (r"\.$", ""),
    (r"^-0$", "0"),
]


def normalise_number(token: Column) -> Column:
    """Canonical text of the number a token starts with, compared as text so that long numbers never meet by rounding."""
    out = F.regexp_extract(strip(token), NUMBER_PREFIX, 0)
    for pattern, to in CANONICAL:
        out = F.regexp_replace(out, pattern, to)
    # most numbers are canonical as they stand, or but for the zeros after their point; the others' text is made once
    decimal = F.regexp_extract(token, r"^((?:0|[1-9][0-9]*)(?:\.[0-9]*[1-9](?=0+\z))?)\.?0+\z", 1)
    rewritten = F.element_at(F.transform(F.array(out), lambda t: F.nullif(t, F.lit(""))), 1)
    return F.when(is_canonical(token), token).when(token.contains(".") & (decimal != ""), decimal).otherwise(rewritten)


def is_canonical(token: Column) -> Column:
    """Does the text stand as `normalise_number` would write it?"""
    return token.rlike(r"^(0|[1-9][0-9]*)(\.[0-9]*[1-9])?\z")


def number_digits(token: Column) -> Column:
    """Numeric start of a token without commas, currency and per cent signs; null where there is none."""
    head = F.regexp_extract(strip(token), NUMBER_PREFIX, 0)
    return F.nullif(F.regexp_replace(head, "[,$]|%+$", ""), F.lit(""))


def search_tokens(c: Column) -> Column:
    """Search terms: lower-cased, of two characters at least, without stop words; repeats stay."""
    # a term ends as it starts, so that nothing has to be cut off each
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9.,\-]*[a-z0-9]"), 0)
    return F.filter(raw, lambda t: ~t.isin(SEARCH_STOP))


def terms(c: Column, stop: list[str]) -> Column:
    """Distinct alphabetic words of more than three letters outside `stop`."""
    raw = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) > 3) & ~t.isin(stop)))


def cell_terms(c: Column) -> Column:
    """Distinct words and numbers of more than two characters, by which cells are ranked."""
    raw = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(raw, lambda t: F.length(t) > 2))


def is_year(c: Column) -> Column:
    """Is the whole text a year of the last or this century?"""
    return c.rlike("^(19|20)[0-9]{2}$")


def amount(c: Column) -> Column:
    """Number of a text without commas, dollar signs and a per cent sign at its end; null where that is none."""
    return number(F.regexp_replace(F.translate(strip(c), ",$", ""), "%+$", ""))


def excerpt_body(c: Column) -> Column:
    """An excerpt without the [label] it starts with."""
    return F.regexp_replace(strip(c), r"^\[[^\]]*\]\s*", "")


def excerpts(context: Column) -> Column:
    """The excerpts of a context: parts that start with [ after a blank line."""
    return F.split(context, r"\n\n(?=\[)")


def rendered(value: Column, unit: Column) -> Column:
    """A value with four significant digits and its unit; the value itself stays beside it."""
    size = F.abs(value)
    power = F.when(size == 0, 0).otherwise(F.floor(F.log10(size))).cast("int")
    near = value / F.pow(F.lit(10.0), power - 3)
    digits = F.bround(near, 0)
    power = power + F.when(F.abs(digits) >= 10000, 1).otherwise(0)
    digits = F.when(F.abs(digits) >= 10000, digits / 10).otherwise(digits)
    mantissa = F.regexp_replace(F.format_string("%.3f", digits / 1000), r"\.?0+$", "")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.regexp_replace(F.format_number(digits * F.pow(F.lit(10.0), power - 3), 8), r"\.?0+$", "")
    text = F.when(value == 0, "0").when((power < -4) | (power > 3), scientific).otherwise(plain)
    return F.concat(text, F.when(unit == "%", "%").when(unit != "", F.concat(F.lit(" "), unit)).otherwise(""))


def overlap(wanted: Column, there: Column) -> Column:
    """Wanted terms that some term agrees with: equal, or either starts with the other's first five letters."""

    def agrees(w: Column, t: Column) -> Column:
        return (w == t) | F.startswith(w, F.substring(t, 1, 5)) | F.startswith(t, F.substring(w, 1, 5))

    return F.size(F.filter(wanted, lambda w: F.exists(there, lambda t: agrees(w, t))))


def gram_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9.]+"), 0)


def grams(tokens: Column, n: int = 5, whole_if_short: bool = False) -> Column:
    """Distinct n-grams of a token array; a shorter one has none, or itself as the only one."""
    places = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    made = F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " ")))
    none = F.array().cast("array<string>")
    short = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(none) if whole_if_short else none
    return F.when(F.size(tokens) >= n, made).otherwise(short)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(c, "[^0-9]", "")) / F.length(c))


def matches_needle(text: Column, needle: Column) -> Column:
    """Does the text hold the needle: a number only as a complete number, anything else as a part; commas aside."""
    plain = F.regexp_replace(text, ",", "")
    wanted = strip(F.regexp_replace(needle, ",", ""))
    escaped = F.regexp_replace(wanted, r"([.+\-])", r"\\$1")
    complete = F.concat(F.lit(r"(?<![0-9])(?<![0-9]\.)"), escaped, F.lit(r"(?![0-9])(?!\.[0-9])"))
    is_number = wanted.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return F.when(wanted == "", F.lit(False)).when(is_number, F.rlike(plain, complete)).otherwise(F.contains(plain, wanted))


def claim_numbers(c: Column) -> Column:
    raw = F.regexp_extract_all(c, F.lit(r"-?\$?[0-9][0-9,]*\.?[0-9]*"), 0)
    return F.transform(raw, lambda t: F.translate(t, "$,", "").try_cast("double"))


def without_years(numbers: Column) -> Column:
    """Numbers that are not years; all of them where nothing else remains."""
    left = F.filter(numbers, lambda n: ~((n >= 1900) & (n <= 2100) & (n == F.floor(n))))
    return F.when(F.size(left) > 0, left).otherwise(numbers)


def numbers_agree(a: Column, b: Column) -> Column:
    """Within 0.005: absolute where both are below 1, else relative to the larger magnitude; null agrees with nothing."""
    small = (F.abs(a) < 1) & (F.abs(b) < 1)
    gap = F.abs(a - b)
    return F.coalesce(F.when(small, gap <= 0.005).otherwise(gap <= 0.005 * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def document_slug(stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def is_furniture(c: Column) -> Column:
    text = collapse(c)
    return (F.length(text) < 3) | text.rlike(FURNITURE)


def citation(doc: Column, page: Column, table: Column, row: Column, col: Column, unit: Column) -> Column:
    place = F.concat(doc, F.lit(" p"), page.cast("string"), F.lit(" "), table, F.lit(" r"), row.cast("string"), F.lit("c"), col.cast("string"))
    return F.concat(place, F.coalesce(F.concat(F.lit(" ["), unit, F.lit("]")), F.lit("")))


def extract_choice(text: Column, labels: str = "ABCDE12345") -> Column:
    """Choice label of a free answer; the article A before a lower-case word is no choice."""
    # fixed values: the patterns of the four tiers
    t, one = strip(text), f"[{labels}]"
    article = t.rlike(r"^A\s+[a-z]")
    first = F.when(t.rlike(f"^{one}([^0-9A-Za-z]|$)") & ~article, F.substring(t, 1, 1))
    found = [rf"\(({one})\)", rf"(?i:answer|choice|option)\s*(?:(?i:is)|:)?\s*\(?({one})\)?\b", rf"\b(?!A\s+[a-z])({one})\b"]
    later = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in found]
    return F.coalesce(first, *later, F.lit(""))
