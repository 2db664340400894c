"""Labels of rows, companies, units, documents and metrics, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.binding import let

#: Abbreviations read in full, words that don't count, pairs that exclude one another.
SPELLED = {"crar": "capital adequacy ratio", "eps": "earnings per share", "npa": "non performing assets", "npas": "non performing assets"}
LITTLE = ("of", "and", "the", "in", "on", "or", "to", "for", "from", "by", "a", "an", "with", "at")
EXCLUSIVE = (("basic", "diluted"), ("gross", "net"))
SHARE_WORDS = ("basic", "diluted", "earnings", "share", "continuing", "discontinued")
#: Currencies and words for the rupee; how a scale is stated; what scale words multiply by.
CURRENCIES = ("INR", "USD", "AUD", "EUR", "GBP")
RUPEE = ("rs", "₹", "inr", "rupee", "rupees")
SCALE_WORD = r"(?:crores?|lakhs?|millions?|billions?|thousands?)\b"
CURRENCY = r"(?:₹|Rs\.?|INR|USD|US\$|\$)"
SCALE_PHRASE = rf"(?i)\([^\n()]{{0,20}}?\bin\s+(?:{CURRENCY}\s*)?{SCALE_WORD}[^\n()]{{0,60}}\)|\(\s*{CURRENCY}\s*{SCALE_WORD}[^\n()]{{0,60}}\)|(?:{CURRENCY}\s*)?\bin\s+{SCALE_WORD}"
MULTIPLIERS = ((r"lakh\s+crores?|trillions?", 10**12), (r"crores?", 10**7), (r"lakhs?|lacs?", 10**5), (r"billions?", 10**9), (r"millions?", 10**6), (r"thousands?", 10**3))
#: Fixed value: words in the name of a derived metric that don't tell it from others.
FILLER = ("a", "an", "and", "as", "for", "in", "of", "over", "per", "the", "to", "what", "was")
FULL_CASE = (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))


def casefold(text: Column) -> Column:
    """Lower case, with the letters spelled out whose folded form is not their lower case."""
    out = F.lower(text)
    for a, b in FULL_CASE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def collapsed(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def label_words(label: Column) -> Column:
    """Distinct words of a row's or a fact's label, abbreviations in full, little words left out."""
    spelled = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    words = F.regexp_extract_all(F.lower(label), F.lit("[a-z]+"), 0)
    full = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(spelled, w), w), " ")))
    return F.array_except(F.array_distinct(full), F.array(*map(F.lit, LITTLE)))


def discontinued_alone(words: Column) -> Column:
    return F.array_contains(words, "discontinued") & ~F.array_contains(words, "continuing")


def label_share(labels: Column, segment: Column, row: Column) -> Column:
    """The largest share of any label's words, with the segment's, that a row has. A label counts for nothing if the row
    names only the other of an exclusive pair, or if one of the two is about discontinued operations alone."""

    def share(mine: Column, there: Column) -> Column:
        other = F.lit(False)
        for a, b in EXCLUSIVE:
            for one, two in ((a, b), (b, a)):
                other = other | (F.array_contains(mine, one) & F.array_contains(there, two) & ~F.array_contains(there, one))
        fits = (F.size(mine) > 0) & (discontinued_alone(mine) == discontinued_alone(there)) & ~other
        return F.when(fits, F.size(F.array_intersect(mine, there)) / F.size(mine)).otherwise(0.0)

    named = F.transform(labels, lambda x: label_words(F.concat(x, F.lit(" "), F.coalesce(segment, F.lit("")))))
    best = let(label_words(row), lambda there: F.array_max(F.transform(named, lambda mine: share(mine, there))))
    return F.coalesce(best, F.lit(0.0))


def per_share_row(labels: Column, text: Column) -> Column:
    """Whether a row, with its heading, prints a per-share figure of the kind that the labels name; its words may be a
    letter off."""

    def judged(row: Column, named: Column) -> Column:
        has = lambda w: F.array_contains(row, w)
        kind = F.arrays_overlap(F.array_intersect(F.array(F.lit("basic"), F.lit("diluted")), named), row)
        return kind & (discontinued_alone(row) == discontinued_alone(named)) & (has("earnings") | has("eps") | (has("per") & has("share")))

    def widened(words: Column) -> Column:
        near = F.filter(F.array(*map(F.lit, SHARE_WORDS)), lambda t: F.exists(words, lambda w: F.levenshtein(w, t, 1) >= 0))
        return F.array_union(words, near)

    named = F.array_distinct(F.flatten(F.transform(labels, lambda x: label_words(x))))
    return let(let(label_words(text), widened), lambda row: let(named, lambda n: judged(row, n)))


def scale_phrase(text: Column) -> Column:
    """The first phrase that states a scale, null without any."""
    return F.nullif(F.trim(F.regexp_extract(text, SCALE_PHRASE, 0)), F.lit(""))


def multiplier_of(phrase: Column) -> Column:
    """What a scale phrase multiplies by, longer names first; null for none."""
    out = F.lit(None).cast("long")
    for pattern, factor in reversed(MULTIPLIERS):
        out = F.when(phrase.rlike(f"(?i){pattern}"), F.lit(factor).cast("long")).otherwise(out)
    return out


def stated_basis(text: Column) -> Column:
    """The last of consolidated and standalone, as words of their own in any case."""
    return F.lower(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)\b(consolidated|standalone)\b"), 1), F.lit(-1)))


def company_key(mention: Column) -> Column:
    """What a company's spellings share: no legal form, only letters, digits and &."""
    return F.regexp_replace(F.regexp_replace(casefold(mention), r"\b(ltd|limited|inc|plc)\b\.?", ""), "[^a-z0-9&]", "")


def unit_key(unit: Column) -> Column:
    """A currency code where a unit names one (rupees in any spelling), else the unit as given; null if blank."""
    words = F.transform(F.regexp_extract_all(unit, F.lit(r"[A-Za-z₹%]+\.?"), 0), lambda w: F.regexp_replace(F.lower(w), r"\.$", ""))
    code = F.coalesce(*[F.when(F.array_contains(words, c.lower()), c) for c in CURRENCIES], F.when(F.arrays_overlap(words, F.array(*map(F.lit, RUPEE))), "INR"))
    return F.when(F.trim(unit) != "", F.coalesce(code, F.trim(unit)))


def canonical_call(call: Column) -> Column:
    """A number times a power of ten in one form, ``N * 10**k``; other calls as they came."""
    shape = r"^\(?\s*(-?\d+(?:\.\d+)?)\s*\*\s*(?:10\s*\*\*\s*(\d+)|1e(\d+)|1(0{3,}))\s*\)?$"
    t = F.trim(call)
    part = lambda i: F.regexp_extract(t, shape, i)
    power = F.coalesce(F.nullif(part(2), F.lit("")), F.nullif(part(3), F.lit("")), F.length(part(4)).cast("string"))
    return F.when(t.rlike(shape), F.concat(part(1), F.lit(" * 10**"), power)).otherwise(call)


def metric_name_refusal(name: Column) -> Column:
    """Why a text can't name a metric: it is no camel-case name, or names a period; null if it can."""
    return F.when(~name.rlike(r"^[A-Z][A-Za-z0-9]*$") | name.isNull(), "no CamelCase name").when(name.rlike(r"FY\d|20\d\d|Q[1-4](?!\d)|H1|9M"), "names a period")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def table_cell(text: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def examples(values: Column, most: int = 3) -> Column:
    """Distinct values in the order first seen, cut with an ellipsis."""
    distinct = F.array_distinct(values)
    return F.concat(F.array_join(F.slice(distinct, 1, most), "; "), F.when(F.size(distinct) > most, "; …").otherwise(""))


def table_context(label: Column) -> Column:
    """A table label's section path and basis, without report and page, scale and years."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(label), r"^\[", ""), r"\]$", "")
    keep = lambda p: (p != "Table") & ~p.rlike(r"^\S+ p\.\d+$") & ~p.startswith("columns:") & scale_phrase(p).isNull()
    return F.array_join(F.filter(F.split(inner, " · "), keep), " · ")


def body(text: Column, heading: Column) -> Column:
    """A chunk's text without the label line and the heading line that may open it."""
    bare = F.when(text.startswith("[") & text.contains("]\n"), F.substring(text, F.locate("]\n", text) + 2, F.length(text))).otherwise(text)
    last = F.substring_index(F.coalesce(heading, F.lit("")), " › ", -1)
    return F.when((last != "") & F.startswith(bare, F.concat(last, F.lit("\n"))), F.substring(bare, F.length(last) + 2, F.length(bare))).otherwise(bare)


def percent_joined(cells: Column) -> Column:
    """A row whose lone ``%`` cells are joined to the figure in the filled cell before."""
    figure = r"^(?:\(?-?\d[\d,]*(?:\.\d+)?\)?%?|\.\.|[-–—])$"
    empty = F.array().cast("array<string>")

    def add(done: Column, cell: Column) -> Column:
        at = F.array_max(F.filter(F.transform(done, lambda c, i: F.when(F.trim(c) != "", i)), lambda i: i.isNotNull()))
        joins = (F.trim(cell) == "%") & F.get(done, at).isNotNull() & F.trim(F.get(done, at)).rlike(figure)
        joined = F.transform(done, lambda c, i: F.when(i == at, F.concat(F.trim(c), F.lit("%"))).otherwise(c))
        return F.concat(F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(done), F.array(F.when(F.coalesce(joins, F.lit(False)), "").otherwise(cell)))

    return F.aggregate(cells, empty, add)


def document_stem(name: Column) -> Column:
    """The last part of a path, without its suffix."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")


def ticker_of(name: Column) -> Column:
    """The company that a document's path names before its date or fiscal year; null if it names none."""
    return F.nullif(F.regexp_extract(document_stem(name), r"^(.+)-(?:\d{4}-\d{2}-\d{2}|FY\d{2})$", 1), F.lit(""))


def cache_name(name: Column, mark: str = "#rapidocr") -> Column:
    """A document's name in a cache of parses: folder and stem, and the engine of a second reading."""
    plain = F.regexp_replace(name, f"{mark}$", "")
    folder = F.regexp_extract(plain, r"([^/]+)/[^/]+$", 1)
    return F.concat(F.lit("verify-"), folder, F.lit("-"), document_stem(plain), F.when(name.endswith(mark), F.lit(mark.replace("#", "-"))).otherwise(""))


def fiscal_year_of(report: Column) -> Column:
    """2025 of a report named ...-FY25; null if it names no year."""
    return F.nullif(F.regexp_extract(report, r"-FY(\d\d)$", 1), F.lit("")).cast("int") + 2000


def normalised_page(text: Column) -> Column:
    """A page's text: compatibility forms composed, controls dropped, runs of spaces and blank lines closed, words put
    together that were hyphenated at a line's end."""
    from tallyforge.functions.python import compatible

    t = F.replace(compatible(text), F.lit("\f"), F.lit("\n"))
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")
    t = F.regexp_replace(F.replace(t, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    t = F.regexp_replace(t, r"(?m)(?U)[\s&&[^\n]]+$", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^(?U)\s+", ""), r"(?U)\s+$", "")
