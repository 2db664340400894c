"""String columns: folding, tokens, names, guards, scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.labels import casefold

#: Words of a token, typographic marks and what they fold to, and what credentials look like.
TOKEN = r"[a-z0-9]+(?:[.,][0-9]+)*"
CURLY, PLAIN = "‘’‚‛′“”„‟″‐‑‒–—―", "'" * 5 + '"' * 5 + "-" * 6
CREDENTIAL = r"(?i)(sk-[a-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(TOKEN), 0)


def squeeze(text: Column) -> Column:
    """One form for comparing quotes: plain marks, single spaces, none before punctuation, cases folded."""
    plain = F.translate(text, CURLY, PLAIN)
    return casefold(F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+([,.;:!?%)\]])", "$1"), r"(?U)\s+", " ")))


def spaced(text: Column) -> Column:
    """The bare form for comparing quotes: lower case and single spaces for runs of blanks, tabs and line ends; marks stay."""
    return F.lower(F.regexp_replace(F.trim(text), r"[\t\n\f\r ]+", " "))


def skeleton(line: Column) -> Column:
    """A line with its digits masked."""
    return F.regexp_replace(F.trim(line), r"\d+", "#")


CAMEL = r"[A-Z][A-Z0-9]*(?![a-z])|[A-Z]?[a-z0-9]+"


def name_words(name: Column) -> Column:
    """Words of a label or a camel-case name, lower case, each once: its humps, and what stands between other marks."""
    found = F.concat(F.regexp_extract_all(name, F.lit(CAMEL), 0), F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), 0))
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def label_of(name: Column) -> Column:
    """A camel-case name in words: the first as it is, the others in lower case unless they are all capitals."""
    words = F.regexp_extract_all(name, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"), 0)
    shown = F.transform(words, lambda w, i: F.when((i == 0) | ((F.length(w) > 1) & (w == F.upper(w)) & w.rlike("[A-Z]")), w).otherwise(F.lower(w)))
    return F.when(F.size(words) == 0, name).otherwise(F.array_join(shown, " "))


def one_off(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def indian_grouping(n: Column) -> Column:
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{2})*\d{3}$)", "$1,")


def guard_reason(text: Column, limit: int = 4000) -> Column:
    """Why a task text is refused; null if it isn't."""
    return (
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty")
        .when(F.length(text) > limit, "too long")
        .when(text.rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), "control characters")
        .when(text.rlike(CREDENTIAL), "credential")
    )


def text_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def scopes_of(spec: Column, every: list[str]) -> Column:
    """``*`` is every scope, else the sorted distinct parts between commas."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.trim(spec) == "*", F.array(*map(F.lit, sorted(every)))).otherwise(parts)


def is_heading(line: Column) -> Column:
    """At most 80 letters and 12 words, not ended by a point, comma or semicolon, and numbered or with capitals on 60 % of
    the words that begin with a letter."""
    bare = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    words = F.split(bare, " ")
    alphabetic = F.filter(words, lambda w: w.rlike(r"^\p{L}"))
    capital = F.size(F.filter(alphabetic, lambda w: w.rlike(r"^\p{Lu}")))
    numbered = bare.rlike(r"^\d+(\.\d+)*\.?\s+\S")
    return (bare != "") & (F.length(F.trim(line)) <= 80) & ~bare.rlike("[.,;]$") & (F.size(words) <= 12) & (numbered | ((F.size(alphabetic) > 0) & (capital >= 0.6 * F.size(alphabetic))))
