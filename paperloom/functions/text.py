"""Text normalisation, tokens, identifiers, hashes and similarities as Column expressions.

Word characters are letters, digits and the underscore of any script; look-arounds stand for word borders, so that
combining marks do not split words differently between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
#: Words without weight in title comparison (fixed values).
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might must shall can need that which who whom this these those it its"
).split()
#: Titles and degrees left out of personal names (fixed values).
NAME_NOISE = "dr prof mr mrs ms jr sr phd md".split()


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Lower case, LaTeX commands dropped (their argument kept), punctuation to blanks, blanks collapsed. Null gives ""."""
    c = F.regexp_replace(F.lower(_text(c)), r"\\[a-z]+\{([^}]*)\}", "$1")
    c = F.regexp_replace(c, r"\\[a-z]+", "")
    return F.trim(F.regexp_replace(c, rf"[^{WORD}]+", " "))


def clean_title(c: Column) -> Column:
    """clean_text without one leading on / the / a / an."""
    return F.regexp_replace(clean_text(c), r"^(?:on|the|an?) +", "")


def surname(c: Column) -> Column:
    """Last word of a cleaned name, titles and degrees left out; "" if nothing is left."""
    plain = F.regexp_replace(clean_text(c), rf"(?<![{WORD}])(?:{'|'.join(NAME_NOISE)})(?![{WORD}])", "")
    return F.regexp_extract(plain, r"([^ ]*) *$", 1)


def surnames(names: Column, limit: int = 50) -> Column:
    """surname of the first ``limit`` names, blank names left out."""
    return F.transform(F.filter(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, limit), lambda n: F.coalesce(n, F.lit("")) != ""), surname)


def tokens(c: Column, remove_stop_words: bool = True) -> Column:
    """Words of the cleaned text in order, repeats kept."""
    drop = F.array(*[F.lit(w) for w in STOP_WORDS]) if remove_stop_words else F.array().cast("array<string>")
    return F.filter(F.split(clean_text(c), " "), lambda t: (t != "") & ~F.array_contains(drop, t))


def label_tokens(c: Column) -> Column:
    """Distinct lower-case words with punctuation as blanks, stop words kept."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(_text(c)), rf"[^{WORD}]+", " "), " "), lambda t: t != ""))


def label_surname(c: Column) -> Column:
    """Last blank-separated word in lower case."""
    return F.lower(F.regexp_extract(F.trim(_text(c)), r"([^ ]*)$", 1))


def year_of(c: Column) -> Column:
    """First year 1900 to 2099 standing alone; null if there is none."""
    return F.nullif(F.regexp_extract(_text(c), rf"(?<![{WORD}])((?:19|20)[0-9]{{2}})(?![{WORD}])", 1), F.lit(""))


def arxiv_of(c: Column) -> Column:
    """First new-style arXiv id, behind "arxiv" or standing alone, written with a dash; null if there is none."""
    named = F.nullif(F.regexp_extract(_text(c), r"(?i)arxiv[:\s]*([0-9]{4}[.-][0-9]{4,5})", 1), F.lit(""))
    alone = F.nullif(F.regexp_extract(_text(c), rf"(?<![{WORD}])([0-9]{{4}}\.[0-9]{{4,5}})(?![{WORD}])", 1), F.lit(""))
    return F.replace(F.coalesce(named, alone), F.lit("."), F.lit("-"))


def dotted(c: Column) -> Column:
    return F.replace(_text(c), F.lit("-"), F.lit("."))


def content_hash(c: Column, digits: int = 8) -> Column:
    return F.substring(F.md5(_text(c)), 1, digits)


def collapsed_hash(c: Column, digits: int = 12) -> Column:
    """Hash that ignores how blanks are written."""
    return F.substring(F.md5(F.trim(F.regexp_replace(_text(c), r"(?U)[\s\x1c-\x1f]+", " "))), 1, digits)


def reference_hash(c: Column) -> Column:
    """Hash of lower-case text whose blanks were collapsed before its punctuation was deleted."""
    c = F.regexp_replace(F.lower(_text(c)), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.substring(F.md5(F.trim(F.regexp_replace(c, rf"[^{WORD} ]", ""))), 1, 16)


def doi_of(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(_text(c), r"10\.[0-9]{4,}/[^\s,]+", 0), r"\.+$", "")


def first_word(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(_text(c), r"(\S+)", 1), r"^[.,;:]+|[.,;:]+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct elements over those of the smaller side; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; 0 if either is empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))
