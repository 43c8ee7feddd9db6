"""Records that differ only in white space, letter case, punctuation or the order of fields and keys.

Progressive partition refinement: every record gets cheap invariants (stripped length and the histogram of its
letters and digits, together with those of its keys); only classes with several members go on to the costlier
key, the record written in canonical field order. All keys are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import Scratch

_VALUE = r"(?:\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\"[^\"]*\"|[\p{L}\p{N}]+)"
_FIELD = rf"(?sU)\p{{L}}[\p{{L}}_\s-]*=\s*{_VALUE}"
_GROUP_WORD = r"\p{L}{3,} collaboration"
_SOMEONE = rf"(?:\p{{L}} \p{{L}}{{2,}}|{_GROUP_WORD})"
_SOMEONE_NOT_A = rf"(?:[\p{{L}}&&[^a]] \p{{L}}{{2,}}|{_GROUP_WORD})"
_PEOPLE_FIRST = rf"^(?:{_SOMEONE_NOT_A}|a \p{{L}}{{2,}} {_SOMEONE})(?: |$)"
_PEOPLE_LATER = rf"^(.+?) ((?:a \p{{L}}{{2,}} )?{_SOMEONE_NOT_A}(?: {_SOMEONE})*)((?: .*)?)$"
_PERSON_A_LATER = r"^([^a].*?|a\p{L}.*?) (a \p{L}{3,})((?: .*)?)$"
_LABELLED = r"(?<![\p{L}\p{N}])(?:vol [0-9]+|no [0-9]+|pp [0-9]+(?: [0-9]+)?)(?![\p{L}\p{N}])"
_YEAR = r"(?<![\p{L}\p{N}])(?:1[6-9]|20)[0-9]{2}(?![\p{L}\p{N}])"

#: Members of a class that are paired by one task.
PAIR_BLOCK = 1000


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _joined(text: Column) -> Column:
    """Letters run together, whatever stood between them; two numbers stay two numbers."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?<=[0-9])[^\p{L}\p{N}]+(?=[0-9])", "|"), r"[^\p{L}\p{N}|]+", "")


#: Letters and digits whose numbers make the histogram; any choice is right, common ones tell most apart.
COUNTED = "etaoinsrlcd0123456789"


def cheap_invariants(content: Column, keys: Column) -> Column:
    """64-bit hash of the stripped length and the numbers of single letters and digits, together with the letters of the keys; equal for
    equal records."""
    letters = _letters(content)
    numbers = [F.length(F.replace(letters, F.lit(c))) for c in COUNTED]
    key_letters = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(keys, F.array().cast("array<string>")), _letters))), " ")
    return F.xxhash64(F.length(letters), *numbers, key_letters)


def canonical_record(content: Column) -> Column:
    """The record with its fields in a fixed order and nothing but letters and separate numbers left.

    A BibTeX-like record is its entry type and key, then its ``name = value`` fields sorted. A printed reference is its
    people, title and journal in this order, then volume, number, pages and year, each under its label.
    """
    fields = F.regexp_extract_all(content, F.lit(_FIELD), F.lit(0))
    bibtex = F.concat(F.lit("@"), _joined(F.regexp_replace(content, _FIELD, " ")), F.lit(";"), F.array_join(F.array_sort(F.transform(fields, _joined)), ";"))
    words = F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", " "))
    labelled = F.regexp_extract_all(words, F.lit(_LABELLED), F.lit(0))
    rest = F.regexp_replace(words, _LABELLED, " ")
    years = F.regexp_extract_all(rest, F.lit(_YEAR), F.lit(0))
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, _YEAR, " "), " +", " "))
    rest = (
        F.when(rest.rlike(_PEOPLE_FIRST), rest)
        .when(rest.rlike(_PEOPLE_LATER), F.regexp_replace(rest, _PEOPLE_LATER, "$2 $1$3"))
        .otherwise(F.regexp_replace(rest, _PERSON_A_LATER, "$2 $1$3"))
    )
    printed = F.concat(_joined(rest), F.lit(";"), F.array_join(F.array_sort(labelled), ";"), F.lit(";"), F.array_join(F.array_sort(years), ";"))
    return F.when(content.rlike(r"(?sU)^\s*@"), bibtex).otherwise(printed)


def record_classes(rows: DataFrame, record_id: str, content: str, keys: str) -> DataFrame:
    """rows -> (record_id, class_id, n_copies): one row per record; class_id is the smallest id of the class.

    Re-delivered rows (equal id) count once. Records whose content is null or has no letter or digit, and records alike to no
    other, are classes of their own with n_copies 1; rows with a null id are dropped. An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "records")
    own = rows.select(F.col(record_id).alias("rid"), F.col(content).alias("text"), F.col(keys).alias("ks")).where("rid is not null")
    filled = own.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    cheap = scratch.save(filled.select("rid", "text", cheap_invariants(F.col("text"), F.col("ks")).alias("k1")), "cheap")
    shared = cheap.groupBy("k1").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("k1")
    costly = scratch.save(cheap.join(shared, "k1", "left_semi").select("rid", "k1", F.md5(canonical_record(F.col("text"))).alias("k2")), "costly")
    scratch.free("cheap")
    classes = costly.groupBy("k1", "k2", "rid").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.min("rid").alias("class_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    members = costly.join(classes, ["k1", "k2"]).select("rid", "class_id", "n_copies")
    everyone = own.select("rid").distinct()
    # an id delivered with two contents may stand in two classes: the smallest counts
    members = members.groupBy("rid").agg(F.min(F.struct("class_id", "n_copies")).alias("m")).select("rid", "m.*")
    return everyone.join(members, "rid", "left").select(F.col("rid").alias(record_id), F.coalesce("class_id", "rid").alias("class_id"), F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"))


def class_pairs(classes: DataFrame, record_id: str, left: str, right: str) -> DataFrame:
    """All pairs left < right inside each class. Large classes are cut into blocks and every pair of blocks is formed once, as a key of
    its own, so no task pairs more than PAIR_BLOCK x PAIR_BLOCK records."""
    own = classes.where("n_copies > 1").withColumn("blocks", F.ceil(F.col("n_copies") / PAIR_BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64(record_id), F.col("blocks")).cast("int"))
    a = own.select("class_id", F.col(record_id).alias("_a"), F.col("b").alias("ba"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("bb"))
    b = own.select("class_id", F.col(record_id).alias("_b"), F.col("b").alias("bb"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("ba"))
    pairs = a.join(b, ["class_id", "ba", "bb"]).where((F.col("_a") < F.col("_b")) | (F.col("ba") < F.col("bb")) & (F.col("_a") != F.col("_b")))
    return pairs.select(F.least("_a", "_b").alias(left), F.greatest("_a", "_b").alias(right))
