"""Texts cut off by field limits or in transfer, from word trigrams inside texts and at their ends, in SQL expressions only.

Every word is counted with its two predecessors in the line, its line's label and whether the text goes on after it. For the final
trigram of a text the chance that a text ends there is estimated from the other texts (equal texts are one), from the kind of its last
sign over label, word and word pair to the whole trigram. Ends that are frequent inside texts but almost never terminal are cuts; so
are final words that never stand inside a text but begin a word that does. A mark of omission at the very end (three dots, with or
without brackets) is no word: the trigram before it is the final one, and it is counted as going on.

The plan: distinct texts by one shuffle of the texts; one aggregate over 64-bit keys for all contexts and the vocabulary, combined
before its shuffle; the final keys are joined to it where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight, in occurrences, of the shorter context when a longer one is estimated.
PRIOR = 15.0
#: A text is cut where fewer than this share of the occurrences of its final words end a text.
LEAST_SHARE = 0.004
#: Texts end so seldom after words of this label and kind (letters, commas) that the words themselves need not be asked.
LEAST_KIND_SHARE = 0.012
#: A final word is the beginning of longer words if these occur so many times as often as itself.
LONGER_WORDS = 20

# Signs that end a line, blanks, signs of scripts written without blanks, labels a line may begin with, marks of omission (fixed values).
_LINE_ENDS = "\r\x85\u2028\u2029"
_BLANKS = "\t\x0b\x0c\x1c\x1d\x1e\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
_SINGLE = r"([\x{e00}-\x{e7f}\x{2e80}-\x{2fdf}\x{3001}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff01}-\x{ff9f}\x{20000}-\x{323af}])"
_KEYWORDS = r"^(?:keywords|schlüsselwörter|schlagwörter|mots-clés|ключевые):?$"
_LABEL = r"^(?:\p{L}[\p{L}\p{M}’'-]*:|--+|—|\[9\]|[-*•]|#+|\(9\)|9[.)])$"
_OMISSION = r"(?:\.{3,}|…|\[(?:\.{3}|…)\]|\((?:\.{3}|…)\))+$"


def _prepared(texts: DataFrame) -> DataFrame:
    """(text_id, t) -> (text_id, omitted, p): line ends and blanks made one, outer ones left out, and so is a mark of omission at the end.

    Native string functions do it; the table of signs is asked only in texts that may hold one."""
    special = (F.octet_length("t") > F.length("t")) | F.contains("t", F.lit("\t")) | F.contains("t", F.lit("\r")) | F.contains("t", F.lit("\x0b")) | F.contains("t", F.lit("\x0c"))
    plain = F.when(special, F.translate("t", _LINE_ENDS + _BLANKS, "\n" * len(_LINE_ENDS) + " " * len(_BLANKS))).otherwise(F.col("t"))
    rows = texts.select("text_id", F.trim(plain, F.lit(" \n")).alias("p"))
    rows = rows.select("text_id", F.right("p", F.lit(5)).rlike(_OMISSION).alias("omitted"), "p")
    return rows.select("text_id", "omitted", F.when(F.col("omitted"), F.rtrim(F.regexp_replace("p", _OMISSION, ""), F.lit(" \n"))).otherwise(F.col("p")).alias("p"))


def _words(lines: DataFrame) -> DataFrame:
    """(l) -> with ws, label: the words of a line in lower case with every number as 9; scripts without blanks give one word per sign."""
    keep = [c for c in lines.columns if c != "l"]
    rows = lines.select(*keep, F.regexp_replace(F.lower("l"), r"\p{Nd}+", "9").alias("l"))
    rows = rows.select(*keep, F.trim(F.when(F.octet_length("l") > F.length("l") + 1, F.regexp_replace("l", _SINGLE, " $1 ")).otherwise(F.col("l"))).alias("l"))
    rows = rows.select(*keep, F.when(F.contains("l", F.lit("  ")), F.split("l", " +")).otherwise(F.split("l", " ")).alias("ws"))
    first = F.get("ws", F.lit(0))
    label = F.when(first.rlike(_KEYWORDS), F.lit("keywords:")).when(first.rlike(_LABEL), first).otherwise(F.lit(""))
    return rows.select(*keep, "ws", F.coalesce(label, F.lit("")).alias("label"))


def _kind(word: Column) -> Column:
    """The kind of a word's last sign, closing quotes and brackets after a sentence mark included."""
    last = F.right(word, F.lit(1))
    kind = (
        F.when(last.between("a", "z"), F.lit("a"))
        .when(word.rlike(r"[.!?。！？।؟…][\"”“’'»›)\]」』]*$"), F.lit("."))
        .when(last.rlike(r"[,;:，、；：(\[{„«\\#\x{fffd}-]"), F.lit(","))
        .when(last.rlike(r"[\p{L}\p{M}]"), F.lit("a"))
        .otherwise(last)
    )
    return F.coalesce(kind, F.lit(""))


def _context(i: Column) -> list[Column]:
    at = lambda k: F.coalesce(F.get("ws", i - k), F.lit("^"))
    return [F.col("label"), at(2).alias("a"), at(1).alias("b"), at(0).alias("w")]


def end_shares(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """documents -> (doc_id, last_word, kind, end_share, kind_share, begins_word): the estimated chance that a text ends with these
    words, the chance that it ends with this kind of word in such a line, and whether the last word occurs almost only as the beginning of longer words. Texts without any word have no row."""
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t is not null")
    identity = F.struct(F.xxhash64("t").alias("x"), F.crc32(F.encode("t", "UTF-8")).alias("c")).alias("text_id")  # 96 bits
    texts = _prepared(own.select("t").distinct().select(identity, "t"))  # copies of a text are no evidence for its own end

    pair, triple = F.xxhash64("label", "b", "w"), F.xxhash64("label", "a", "b", "w")
    last = F.size("ws") - 1
    finals = _words(texts.select("text_id", "omitted", F.trim(F.substring_index("p", "\n", -1)).alias("l"))).select("text_id", "omitted", *_context(last))
    finals = finals.withColumn("kind", _kind(F.col("w")))

    lines = texts.select("omitted", F.split("p", "\n").alias("ls")).select("omitted", F.size("ls").alias("n_lines"), F.posexplode_outer("ls").alias("line_no", "l"))
    lines = _words(lines.select((~F.col("omitted") & (F.col("line_no") == F.col("n_lines") - 1)).alias("final"), F.trim("l").alias("l")))
    grams = lines.select("final", "ws", "label", F.posexplode_outer("ws").alias("i", "word"))
    grams = grams.select(*_context(F.col("i")), (F.col("final") & (F.col("i") == F.size("ws") - 1)).cast("bigint").alias("ends"))
    # One shuffle serves words, pairs and triples: words are told apart after the aggregate, where no filter can move below it; no
    # column may be null here, or a join would put its own not-null filter there and the shuffle would not be shared.
    no_word, no_key = F.lit(""), F.lit(0).cast("bigint")
    levels = F.explode(F.array(*[F.struct(k.alias("key"), label.alias("label"), w.alias("w")) for k, label, w in ((no_key, F.col("label"), F.col("w")), (pair, no_word, no_word), (triple, no_word, no_word))]))
    counts = grams.select(levels.alias("e"), "ends").select("e.*", "ends").groupBy("key", "label", "w").agg(F.count("*").alias("n"), F.sum("ends").alias("ends"), F.max(F.length("w")).alias("size"))
    words = counts.where("size > 0").select("label", "w", "n", "ends")
    pairs = counts.where("size = 0 and n > 1")

    # from the kind alone to the whole trigram; a context of no other text changes nothing
    kinds = words.groupBy("label", _kind(F.col("w")).alias("kind")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    totals = kinds.groupBy("kind").agg(F.sum("n").alias("n0"), F.sum("ends").alias("e0"))
    scored = finals.join(words.select("label", "w", F.col("n").alias("n2"), F.col("ends").alias("e2")), ["label", "w"], "left")
    scored = scored.join(kinds.select("label", "kind", F.col("n").alias("n1"), F.col("ends").alias("e1")), ["label", "kind"], "left").join(F.broadcast(totals), "kind")  # kinds are single signs; no word, no kind
    place = lambda n: pairs.select(F.col("key").alias(f"key{n}"), F.col("n").alias(f"n{n}"), F.col("ends").alias(f"e{n}"))
    scored = scored.withColumn("key3", pair).withColumn("key4", triple).drop("a", "b", "label").join(place(3), "key3", "left").join(place(4), "key4", "left")
    itself = (~F.col("omitted")).cast("bigint")
    n = lambda i: F.coalesce(f"n{i}", F.lit(1))
    e = lambda i: F.coalesce(f"e{i}", itself)
    p = (e(0) - itself + 0.05) / (n(0) + 1.0)
    for i in range(1, 5):
        scored = scored.withColumn(f"p{i}", p)
        p = (e(i) - itself + PRIOR * F.col(f"p{i}")) / (n(i) - 1 + PRIOR)
    scored = scored.select("text_id", "w", "kind", p.alias("p"), F.col("p2").alias("p_kind"))

    # a final word that stands nowhere inside a text but begins words that do; beginnings are formed only of the lengths words have
    vocabulary = words.groupBy("w").agg(F.sum(F.col("n") - F.col("ends")).alias("inside")).where("inside > 0")
    lengths = F.broadcast(vocabulary.agg(F.collect_set(F.length("w")).alias("ks")))  # one row; different word lengths are few
    begun = vocabulary.crossJoin(lengths).select("inside", "w", F.explode(F.filter("ks", lambda k: k <= F.length("w"))).alias("k"))
    begun = begun.select(F.substring("w", F.lit(1), F.col("k")).alias("head"), "inside", (F.col("k") == F.length("w")).alias("whole"))
    begun = begun.groupBy("head").agg(F.sum(F.when(F.col("whole"), F.lit(0)).otherwise(F.col("inside"))).alias("longer"), F.sum(F.when(F.col("whole"), F.col("inside")).otherwise(F.lit(0))).alias("alone"))
    begun = begun.where(F.col("longer") >= LONGER_WORDS * (1 + F.col("alone"))).select(F.col("head").alias("w"), F.lit(True).alias("begins"))
    scored = scored.join(begun, "w", "left")
    scored = scored.select("text_id", F.col("w").alias("last_word"), "kind", F.col("p").alias("end_share"), F.col("p_kind").alias("kind_share"), F.coalesce("begins", F.lit(False)).alias("begins_word"))
    return own.select("doc_id", identity).join(scored, "text_id").drop("text_id")


def truncated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents -> end_shares' columns of the texts that were cut within a word or a sentence.

    Null, empty and blank texts are never cut. Every text is judged by all other texts; equal texts count once and
    share the verdict. An empty table gives an empty result.
    """
    return end_shares(documents, doc_id, text).where((F.col("end_share") < LEAST_SHARE) | F.col("kind").isin("a", ",") & (F.col("begins_word") | (F.col("kind_share") < LEAST_KIND_SHARE)))


def truncation_by_source(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """documents -> (source, n_documents, n_truncated, truncated_share); a null source is a source of its own. Texts without words count as documents."""
    cut = truncated(documents, doc_id, text).select(F.col("doc_id").alias("cut_id")).distinct()
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    return own.join(cut, F.col("doc_id") == F.col("cut_id"), "left").groupBy("source").agg(F.count("*").alias("n_documents"), F.count("cut_id").alias("n_truncated")).withColumn("truncated_share", F.round(F.col("n_truncated") / F.col("n_documents"), 6))
