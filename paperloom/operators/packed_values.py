"""Several values packed in one field: one row per value, position kept.

Quote characters are split first: odd pieces are literal values, even pieces are split on delimiters, and
array folds put the values together again. All of it is Column expressions, so a field never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters stand for signs that must not act as quotes or delimiters.
_TEX_UMLAUT, _ENTITY_OPEN, _ENTITY_CLOSE, _DOUBLED = "\ue000", "\ue001", "\ue002", "\ue003"

#: A closing "and others" of any form is no value.
_OTHERS = r"(?iU)(?:[\s,;|/·&]|\b(?:and|und|et|y|e|и)\b)*(?<![\p{L}\p{N}])(?:et\.?\s+al(?:ii|\b\.?)|others\b\.?|(?-i:u\.\s?a\.)|и\s+др\.?|co-?workers|colleagues|y\s+otros|et\s+autres|…|\.\.\.)[\s,;|/·]*$"
#: What any such ending has as its last two signs; few values do.
_OTHERS_TAIL = r"(?iU)(?:al|ii|rs|es|os|др|[alsр]\.|\.\.)$|[\s,;|/·…]$"
_NAME_DELIMITER = r"(?U)\s*(?:[\n\r\t|·;]|,?\s+(?i:and)\s+|,?\s+&\s+|\s+/\s+)\s*"
_GROUP = r"(?iU)\b(?:coll(?:ab(?:oration)?)?|consortium|group|team|project)\b"
_SUFFIX = r"(?iU)^(?:jr|sr|ii|iii|iv)\.?$"

#: What a printed reference may begin with: a marker or markup, then an author's initials, a group or a template.
_MARK = r"(?:\\bibitem(?:\[[^\]]*\])?\{[^}]*\}\s*|<[A-Za-z][^<>]*>\s*|[*>•–-]\s+|#{1,6}\s+|\"|“)*"
_INITIALS = r"(?:\p{Lu}\p{M}*\.[\s~-]*){1,4}(?:\{?\\?[\"'`^~]?\{?\p{L}|[dv]\p{L}+\s)"
_START = rf"(?:{_MARK}(?:{_INITIALS}|(?:The\s+)?\p{{Lu}}[\p{{L}}'-]+\s+Coll(?:ab(?:oration)?)?\b|Collaboration\s+\p{{Lu}}|\{{\{{\s*cite))"
_REFERENCE_DELIMITER = rf"(?:\s*;\s*see\s+also\s+|\s*;\s*(?={_START})|\s*\n\s*(?={_START})|\s+\|\s+(?={_START}))"
_YEAR = r"(?<![0-9])(?:1[6-9]|20)[0-9]{2}(?![0-9])"


def _trim(c: Column) -> Column:
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))  # most values have nothing to trim: the whole is not searched for it
    return F.when(ends.rlike(r"(?U)[\s\u200b\ufeff]"), F.regexp_replace(c, r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$", "")).otherwise(c)


def _without_others(c: Column) -> Column:
    return F.when(F.substring(c, -2, 2).rlike(_OTHERS_TAIL), F.regexp_replace(c, _OTHERS, "")).otherwise(c)


def _protect(c: Column) -> Column:
    c = F.replace(c, F.lit("&amp;"), F.lit("&"))
    c = F.when(F.contains(c, F.lit("&")), F.regexp_replace(c, r"&(#?[A-Za-z0-9]{1,10});", f"{_ENTITY_OPEN}$1{_ENTITY_CLOSE}")).otherwise(c)
    return F.replace(c, F.lit('\\"'), F.lit(_TEX_UMLAUT))


def _restore(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit(_DOUBLED), F.lit('"')), F.lit(_TEX_UMLAUT), F.lit('\\"'))
    return F.replace(F.replace(c, F.lit(_ENTITY_OPEN), F.lit("&")), F.lit(_ENTITY_CLOSE), F.lit(";"))


def _nonblank(values: Column) -> Column:
    return F.filter(values, lambda v: F.length(v) > 0)


def _by_quotes(text: Column, is_quoted: Column, unquoted) -> Column:
    """Fold the pieces between quote characters: odd ones are values as they stand, even ones go through ``unquoted``."""
    pieces = F.split(F.replace(text, F.lit('""'), F.lit(_DOUBLED)), '"', -1)
    literal = F.flatten(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(_trim(p))).otherwise(unquoted(F.regexp_replace(p, r"^[\s,;|/&]+|[\s,;|/&]+$", "")))))
    return _nonblank(F.when(is_quoted, literal).otherwise(unquoted(text)))


def _comma_names(piece: Column) -> Column:
    """Fold the comma pieces of one name list: a lone word is a surname and takes the given names that follow. Without a comma there is nothing to fold."""
    several = F.contains(piece, F.lit(","))
    parts = F.transform(F.when(several, F.split(piece, r"\s*,\s*")).otherwise(F.array(piece)), lambda p: F.when(F.substring(p, 1, 3).rlike(r"(?i)^(?:and|&)"), F.regexp_replace(p, r"(?iU)^(?:and|&)\s+", "")).otherwise(p))
    parts = _nonblank(F.transform(parts, _trim))  # step by step: inside a lambda nothing is kept that is used twice
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        out, waiting = state["out"], state["open"]
        lone = ~part.rlike(r"(?U)[\s~]") & ~part.rlike(_GROUP) & ~part.rlike(r"^(?:\p{Lu}\p{M}*\.-?)+$")
        last = F.size(out)
        return (
            F.when((waiting == "") & (last > 0) & part.rlike(_SUFFIX), F.struct(F.concat(F.slice(out, 1, F.greatest(last - 1, F.lit(0))), F.array(F.concat_ws(", ", F.try_element_at(out, F.greatest(last, F.lit(1))), part))).alias("out"), F.lit("").alias("open")))
            .when(waiting != "", F.struct(F.concat(out, F.array(F.concat(waiting, F.lit(", "), part))).alias("out"), F.lit("").alias("open")))
            .when(lone, F.struct(out.alias("out"), part.alias("open")))
            .otherwise(F.struct(F.concat(out, F.array(part)).alias("out"), F.lit("").alias("open")))
        )

    folded = F.aggregate(parts, start, step, lambda s: F.when(s["open"] != "", F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]))
    return F.when(several, folded).otherwise(parts)


def prepare_names(field: Column) -> Column:
    """An author field with its quotes made alike, entities protected and a closing "and others" dropped."""
    text = _trim(_protect(field))
    single = text.startswith("'") & text.rlike(r"^'(?:[^']|\\')*'\s*[;,|&/]") & text.rlike(r"'[\s;,|&/]*$")
    text = F.when(single, F.regexp_replace(text, r"^'|(?<!\\)'(?=\s*(?:[;,|&/]|$))|(?<=[;,|&/]\s{0,3})'", '"')).otherwise(text)
    return _without_others(text)


def split_names(text: Column) -> Column:
    """prepare_names -> array<string> of the persons and groups of one author field, in reading order.

    Null gives null; blank gives an empty array. "Last, First" stays one value, whether the list is set apart by
    line ends, tabs, ``|``, ``·``, ``;``, ``/``, ``&``, "and" or commas. Quotes delimit values only where the field
    begins with one. A closing "et al." or "and others" is dropped.
    """
    def unquoted(piece: Column) -> Column:
        return F.flatten(F.transform(F.split(piece, _NAME_DELIMITER), _comma_names))

    return F.transform(_nonblank(F.transform(F.transform(_by_quotes(text, text.startswith('"'), unquoted), _without_others), _trim)), _restore)


def prepare_references(field: Column) -> Column:
    return _trim(_protect(field))


def split_references(text: Column) -> Column:
    """prepare_references -> array<string> of the printed references in one raw_content field, in reading order.

    Recognised are quoted lists, "(a) .. (b) ..", "[1] .. [2] .." and ``;``, line ends, ``|`` or "; see also" before something
    that begins like a reference. A piece without a year belongs to the next one. Null gives null, blank an empty array.
    """
    quoted = text.rlike(r'(?s)^".*"[\s,;]*$') & text.rlike(r'(?s)[^"]"\s*[,;|]\s*"[^"\s]|"""\s*[,;|]\s*"|"\s*[,;|]\s*"""')
    lettered = F.regexp_replace(text, r"^\(a\)\s+", "")
    numbered = F.regexp_replace(text, r"^\[1\]\s+", "")
    plain = (
        F.when(text.rlike(rf"(?s)^\(a\)\s+.*\s\(b\)\s+{_START}"), F.split(lettered, rf"\s+\([b-z]\)\s+(?={_START})"))
        .when(text.rlike(rf"(?s)^\[1\]\s+.*\s\[2\]\s+{_START}"), F.split(numbered, rf"\s+\[[0-9]+\]\s+(?={_START})"))
        .otherwise(F.split(text, _REFERENCE_DELIMITER))
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        whole = F.when(state["open"] != "", F.concat(state["open"], F.lit("; "), part)).otherwise(part)
        return F.when(part.rlike(_YEAR), F.struct(F.concat(state["out"], F.array(whole)).alias("out"), F.lit("").alias("open"))).otherwise(F.struct(state["out"].alias("out"), whole.alias("open")))

    folded = F.aggregate(_nonblank(F.transform(plain, _trim)), start, step, lambda s: F.when(s["open"] != "", F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]))
    return F.transform(_by_quotes(text, quoted, lambda p: F.when(quoted, F.array(p)).otherwise(folded)), _restore)


NAMES, REFERENCES = (prepare_names, split_names), (prepare_references, split_references)


def unpack(rows: DataFrame, key: str, fields: dict[str, tuple]) -> DataFrame:
    """rows -> (key, field_name, pos, value, n_values): one row per value of each field; ``fields`` maps a field to NAMES or REFERENCES, pos counts from 1.

    Repeated rows (equal in key and fields) count once; null and blank fields give no rows; other columns are ignored.
    """
    own = rows.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]).distinct()
    own = own.select("_key", *[prepare(F.col(f"_f{i}")).alias(f"_f{i}") for i, (prepare, _) in enumerate(fields.values())])  # computed once, read many times
    packed = F.array(*[F.struct(F.lit(f).alias("field_name"), split(F.col(f"_f{i}")).alias("vals")) for i, (f, (_, split)) in enumerate(fields.items())])
    flat = own.select("_key", F.explode(packed).alias("p")).select("_key", "p.field_name", F.size("p.vals").alias("n_values"), F.posexplode("p.vals").alias("pos", "value"))
    return flat.select(F.col("_key").alias(key), "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "value", F.col("n_values").cast("int").alias("n_values"))
