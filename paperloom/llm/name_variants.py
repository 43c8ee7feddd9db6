"""Spellings of persons and groups linked to one author each.

Spellings are parsed into surname, first name and further initials. Typing errors are found by MinHash banding over padded
q-grams: a token is linked to the most frequent token one error away (star clustering: the frequent one is the centre), surnames
only where first names and initials allow it. Inside a block of one surname the name forms are verified by Monge-Elkan similarity with an inner
similarity that knows initials, nicknames, clipped names and typing errors, and clustered into stars around the fullest,
most frequent forms.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.format_duplicates import class_pairs
from paperloom.runtime import Scratch, maybe_broadcast

# Nicknames and what they stand for (fixed values).
NICKNAMES = {
    n: full
    for full, names in {
        "alexander": "alex sasha sandy alec", "anthony": "tony", "benjamin": "ben benny", "charlotte": "lottie lotte", "christopher": "chris kit", "daniela": "dani", "edward": "ted ed eddie ned", "eleanor": "nell ellie nora",
        "elizabeth": "liz beth betty lizzie eliza betsy", "francisco": "paco pancho", "gabriela": "gabi", "henrietta": "etta hettie", "isabella": "bella", "jennifer": "jenny jen", "joseph": "jo joe joey", "katarina": "katya kati", "leonardo": "leo",
        "ludovic": "ludo", "margaret": "peggy maggie meg", "matthias": "matt matti", "michael": "mike mick", "nikolai": "kolya nick", "olivier": "oli ollie", "philippa": "pippa", "raymond": "ray", "richard": "dick rick rich", "robert": "bob rob bobby",
        "samuel": "sam sammy", "susanna": "su sue susie", "theodora": "dora thea", "thomas": "tom tommy", "ursula": "ulla", "veronika": "nika vera", "wilhelmina": "mina wilma minna", "william": "bill will billy", "yevgenia": "zhenya",
        "james": "jim jimmy", "john": "jack johnny", "katherine": "kate kathy", "patricia": "pat patty", "stephen": "steve", "andrew": "andy drew", "david": "dave", "peter": "pete", "catherine": "cathy", "deborah": "debbie", "frederick": "fred freddy", "george": "georgie", "gregory": "greg",
        "jeffrey": "jeff", "lawrence": "larry", "nathaniel": "nate", "nicholas": "nicky", "ronald": "ron", "timothy": "tim", "victoria": "vicky", "abigail": "abby", "albert": "bert", "aleksei": "alyosha", "dmitri": "dima", "ivan": "vanya", "maria": "masha", "mikhail": "misha", "vladimir": "volodya", "jose": "pepe", "ignacio": "nacho",
    }.items()
    for n in names.split()
}
_GROUP = re.compile(r"\b(?:collaboration|collab|coll|consortium|group|team)\b")
_GROUP_NOISE = frozenset("the collaboration collab coll consortium group team".split())
_WORD = re.compile(r"[^\W\d_]+")
_TEX_ACCENT = re.compile(r"\{?\\[\"'`^~=.Hcvu]\s?\{?\\?([A-Za-z])\}?\}?")
_INITIALS = re.compile(r"[A-Z]{1,3}")

#: Initials under which a first name may also stand.
NICK_INITIALS: dict[str, set[str]] = {}
for _nick, _full in NICKNAMES.items():
    NICK_INITIALS.setdefault(_full, set()).add(_nick[0])

#: q-grams of this length, padded at both ends.
QGRAM = 3
#: A first name is set right without regard to the surname only by one at least so many times as frequent; other pairs meet inside their surname.
CENTRE_RATIO = 3
#: A spelled-out umlaut, under which tokens meet whatever else their q-grams say.
UMLAUT = re.compile(r"([aou])e")
LEAST_SIMILARITY = 0.85


class _Plain(dict):
    """Signs without accents, filled as they are met."""

    def __missing__(self, sign: int) -> int | None:
        self[sign] = plain = None if unicodedata.combining(chr(sign)) else sign
        return plain


_PLAIN = _Plain({ord("ß"): "ss", ord("ø"): "o", ord("ł"): "l"})


def fold(text: str) -> str:
    """Lower case without accents, TeX accents undone. A spelled-out umlaut stays: it is one inserted letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_PLAIN)
    if "\\" in text:
        text = _TEX_ACCENT.sub(r"\1", text)
    return text.lower()


def parse(name: str) -> tuple[str, str, str, str]:
    """(kind P or G, surname or group name, first name or initial, further initials) of one spelling."""
    text = fold(name)
    if _GROUP.search(text):
        return "G", " ".join(w for w in _WORD.findall(text) if w not in _GROUP_NOISE), "", ""
    if "," in text:
        last, _, given = text.partition(",")
        surname, rest = "".join(_WORD.findall(last)), _WORD.findall(given)
    else:
        raw, words = name.split(), _WORD.findall(text.replace("'", "").replace("’", ""))
        if not words:
            return "P", "", "", ""
        if len(raw) == 2 and len(words[0]) > 3 and _INITIALS.fullmatch(raw[1]):  # Surname AB
            surname, rest = words[0], list(raw[1].lower())
        else:
            surname, rest = words[-1], words[:-1]
    first = rest[0] if rest else ""
    return "P", surname, NICKNAMES.get(first, first), "".join(w[0] for w in rest[1:])


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands so that a pair of this Jaccard similarity collides with the given probability: 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _grams(token: str) -> list[int]:
    padded = f"{'^' * (QGRAM - 1)}{token}{'$' * (QGRAM - 1)}"
    return [hash_gram(padded[i : i + QGRAM]) for i in range(len(padded) - QGRAM + 1)]


def hash_gram(gram: str) -> int:
    value = 1469598103934665603
    for c in gram:
        value = ((value ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return value


def signatures(tokens: list[str], count: int) -> np.ndarray:
    """count MinHash values of each token's q-grams."""
    rng = np.random.default_rng(20)
    a, b = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)
    grams = [_grams(t) for t in tokens]
    starts = np.cumsum([0, *map(len, grams)][:-1])
    flat = np.array([g for gs in grams for g in gs], dtype=np.uint64)
    out = np.empty((len(tokens), count), dtype=np.uint64)
    for k in range(count):  # multiply-shift hashing
        mixed = flat * a[k] + b[k]
        out[:, k] = np.minimum.reduceat((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), starts)
    return out


def letter_signs(tokens: list[str]) -> np.ndarray:
    """The set of each token's letters in 32 bits: one letter left out or put in changes one bit at most, one replaced two, an exchange none."""
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & np.uint32(31)
    starts = np.cumsum([0, *map(len, tokens)][:-1])
    return np.bitwise_or.reduceat(np.left_shift(np.uint32(1), codes), starts).view(np.int32)


def spelling_pairs(tokens: DataFrame, rows: int, similarity: float, recall: float = 0.99) -> DataFrame:
    """(bucket, token, cnt), distinct -> (bucket, token, cnt, centre, centre_cnt, umlaut): all pairs of one bucket that are one inserted,
    left out, changed letter or two neighbours swapped apart, or (umlaut) differ in spelled-out umlauts alone. The more frequent token,
    of equals the greater, is the centre."""
    bands = bands_for(similarity, rows, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, tokens = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sig = signatures(tokens, bands * rows).reshape(-1, bands, rows)
            keys = np.zeros(sig.shape[:2], dtype=np.uint64)
            for r in range(rows):
                keys = (keys ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(31)
            keys += np.arange(bands, dtype=np.uint64)[None, :]
            plain = np.array([hash_gram(UMLAUT.sub(r"\1", t)) for t in tokens], dtype=np.uint64)
            own = {b: hash_gram(b) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for b in set(buckets)}
            keys = np.column_stack([keys, plain]) ^ np.array([own[b] for b in buckets], dtype=np.uint64)[:, None]
            keys[:, :-1] &= ~np.uint64(1)  # odd: the key of spelled-out umlauts
            keys[:, -1] |= np.uint64(1)
            n, width = keys.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(letter_signs(tokens)), lists], ["id", "signs", "keys"])

    # Tokens meet as numbers: bucket and band are one key, and the text comes back only for pairs whose letters differ in two signs at most, as
    # those of every pair one error apart do, or that met under the umlaut key.
    own = tokens.where(F.length("token") > 2).select(F.xxhash64("bucket", "token").alias("id"), "bucket", "token", "cnt")
    banded = own.select("id", "bucket", "token").mapInArrow(run, "id bigint, signs int, keys array<bigint>")
    side = lambda p: banded.select(F.col("id").alias(p), F.col("signs").alias(f"{p}_signs"), F.explode("keys").alias("k"))  # noqa: E731; both renamed, so one shuffle serves both
    alike = F.bit_count(F.col("one_signs").bitwiseXOR(F.col("other_signs"))) <= 2
    met = side("one").join(side("other"), "k").where((F.col("one") < F.col("other")) & (alike | (F.col("k") % 2 != 0))).select("one", "other").distinct()
    near = met.join(own.select(F.col("id").alias("one"), "bucket", F.col("token").alias("t"), F.col("cnt").alias("c")), "one")
    near = near.join(own.select(F.col("id").alias("other"), F.col("bucket").alias("other_bucket"), F.col("token").alias("o"), F.col("cnt").alias("oc")), "other")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = (F.length("t") == F.length("o")) & (letters(F.col("t")) == letters(F.col("o")))
    distance = F.levenshtein("t", "o", 2)
    plain = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("ae"), F.lit("a")), F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u"))
    near = near.where(F.col("bucket") == F.col("other_bucket")).withColumn("umlaut", plain("t") == plain("o"))
    near = near.where((distance == 1) | (distance == 2) & swapped | F.col("umlaut"))
    higher = (F.col("oc") > F.col("c")) | (F.col("oc") == F.col("c")) & (F.col("o") > F.col("t"))
    of = lambda rare, often: F.when(higher, F.col(rare)).otherwise(F.col(often))
    return near.select("bucket", of("t", "o").alias("token"), of("c", "oc").alias("cnt"), of("o", "t").alias("centre"), of("oc", "c").alias("centre_cnt"), "umlaut")


def best_links(pairs: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """spelling_pairs' columns -> (bucket, token, centre): each token's most frequent partner; a centre that is itself a misspelling
    is replaced by its own centre, up to one that is none."""
    best = pairs.groupBy("bucket", "token").agg(F.max(F.struct("centre_cnt", "centre")).alias("s")).select("bucket", "token", F.col("s.centre").alias("centre"))
    best, n = scratch.save(best, f"{step}-0"), 0
    while True:
        up = best.select("bucket", F.col("token").alias("centre"), F.col("centre").alias("higher"))
        if best.join(up, ["bucket", "centre"], "left_semi").isEmpty():
            return best
        raised = best.join(up, ["bucket", "centre"], "left").select("bucket", "token", F.coalesce("higher", "centre").alias("centre"))
        best, n = scratch.save(raised, f"{step}-{n + 1}"), n + 1
        scratch.free(f"{step}-{n - 1}")


def same_people(a: list[tuple[str, str]], b: list[tuple[str, str]], short: bool) -> bool:
    """Whether two surnames, given as their (first name, initials), can be one: where both have first names spelled out, or the surname
    is short, two of these must agree, else an initial suffices; further initials must not differ."""
    full_a, full_b = ([f for f in forms if len(f[0]) > 1] for forms in (a, b))
    if full_a and full_b or short:
        a, b = full_a, full_b
    firsts: dict[str, list[tuple[str, str]]] = {}
    for f in b:
        firsts.setdefault(f[0], []).append(f)
    if any(monge_elkan(x, y) >= LEAST_SIMILARITY for x in a for y in firsts.get(x[0], ())):
        return True
    return any(monge_elkan(x, y) >= LEAST_SIMILARITY for x in a for f, ys in firsts.items() if _inner(x[0], f) for y in ys)


def verified(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """Rows of spelling_pairs over surnames that first names and initials (forms: bucket, surname, first, more) do not speak against."""
    people = forms.select("bucket", "surname", "first", "more").groupBy("bucket", "surname").agg(F.collect_set(F.struct("first", "more")).alias("people"))
    asked = pairs.join(people.select("bucket", F.col("surname").alias("token"), F.col("people").alias("a")), ["bucket", "token"]).join(people.select("bucket", F.col("surname").alias("centre"), F.col("people").alias("b")), ["bucket", "centre"])
    columns = pairs.columns
    asked = asked.select(*columns, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([[(f["first"], f["more"]) for f in forms] for forms in batch.column(k).to_pylist()] for k in ("a", "b"))
            short = [max(len(t), len(o)) < 5 for t, o in zip(batch.column("token").to_pylist(), batch.column("centre").to_pylist())]
            keep = pa.array([same_people(*x) for x in zip(a, b, short)], pa.bool_())
            yield batch.select(columns).filter(keep)

    return asked.mapInArrow(run, pairs.schema)


def _inner(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        short, long = sorted((a, b), key=len)
        return 0.95 if short == long[:1] else 0.88 if short in NICK_INITIALS.get(long, ()) else 0.0
    if (len(a) <= 4 or len(b) <= 4) and (a.startswith(b) or b.startswith(a)):
        return 0.9
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 5:
        return 0.0
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    near = a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return 0.9 if near else 0.0


def monge_elkan(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Mean of the best inner similarities of the shorter form's tokens; first names are held against first names, initials against initials."""
    scores = [_inner(a[0], b[0])]
    if not scores[0]:
        return 0.0
    if a[1] and b[1]:
        short, long = sorted((a[1], b[1]), key=len)
        scores += [1.0 if c in long else 0.0 for c in short]
    return sum(scores) / len(scores)


def stars(forms: list[tuple[str, str, int]]) -> list[list[int]]:
    """Centres each form belongs to. Fuller and more frequent forms become centres first; a form that suits several equally belongs to all.

    Centres are kept by first name, first names by every beginning they can share, so a form meets the centres it may suit and not all."""
    order = sorted(range(len(forms)), key=lambda i: (len(forms[i][0]) <= 1, len(forms[i][0]) <= 4, not forms[i][1], -forms[i][2], forms[i][0], forms[i][1]))
    by_name: dict[str, list[int]] = {}
    names: dict[str, set[str]] = {}
    member: list[list[int]] = [[] for _ in forms]
    alike: dict[str, dict[str, float]] = {}
    for i in order:
        first = forms[i][0]
        near = alike.get(first)
        if near is None:
            asked = by_name if not first else {n for key in _openings(first) for n in names.get(key, ())}
            near = alike[first] = {n: score for n in asked if (score := _inner(first, n))}
        scores = {c: score for n in near for c in by_name[n] if (score := monge_elkan(forms[i], forms[c])) >= LEAST_SIMILARITY}
        best = max(scores.values(), default=0.0)
        fit = sorted(c for c, score in scores.items() if score > best - 0.04)
        if not fit:
            fit = [i]
            if first not in by_name:
                by_name[first] = []
                for key in _openings(first):
                    names.setdefault(key, set()).add(first)
                for other, known in alike.items():
                    if score := _inner(other, first):
                        known[first] = score
            by_name[first].append(i)
        member[i] = fit
    return member


def _openings(first: str) -> set[str]:
    """Keys of which two first names share one if _inner can be above 0: initials, those of nicknames, and all but the first sign or two."""
    keys = {first[:1], *NICK_INITIALS.get(first, ()), ""} if len(first) < 2 else {first[:1], *NICK_INITIALS.get(first, ())}
    if len(first) > 3:
        keys |= {first[1:], first[2:], first}
    return keys


def author_of(names: DataFrame) -> DataFrame:
    """(name) rows -> (spelling, author): the authors a spelling stands for, mostly one. A column ``weight`` tells how often a row counts.

    A spelling is a value as written, without outer white space and quotes; null and blank values are dropped, repeated values count
    as evidence. A bare surname stands for every author of that surname; a spelling without letters is an author of its own. An empty table gives an empty result.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "names")
    tidy = F.regexp_replace(F.col("name"), r"(?U)^[\s\"“”„']+|[\s\"“”„']+$", "")
    weight = F.col("weight") if "weight" in names.columns else F.lit(1)
    spellings = names.select(tidy.alias("spelling"), weight.cast("bigint").alias("w")).where("spelling <> ''").groupBy("spelling").agg(F.sum("w").alias("cnt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parse(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p[i] for p in parts], pa.string()) for i in range(4))], ["spelling", "cnt", "kind", "surname", "first", "more"])

    parsed = scratch.save(spellings.mapInArrow(run, "spelling string, cnt bigint, kind string, surname string, first string, more string"), "parsed")

    firsts = parsed.where(F.length("first") > 4).groupBy(F.lit("").alias("bucket"), F.col("first").alias("token")).agg(F.sum("cnt").alias("cnt"))
    first_pairs = spelling_pairs(firsts, rows=2, similarity=0.4).where(F.col("umlaut") | (F.col("centre_cnt") >= CENTRE_RATIO * F.col("cnt")))
    first_links = maybe_broadcast(best_links(first_pairs, scratch, "first").select(F.col("token").alias("first"), F.col("centre").alias("first_centre")))
    # a spelling without any letter names nobody it could share an author with
    nobody = parsed.where("surname = ''").select("spelling", F.concat(F.lit("?|"), "spelling").alias("author"))
    named = parsed.where("surname <> ''").join(first_links, "first", "left").withColumn("first", F.coalesce("first_centre", "first")).withColumn("bucket", F.concat("kind", F.substring("first", 1, 1)))
    surnames = named.groupBy("bucket", F.col("surname").alias("token")).agg(F.sum("cnt").alias("cnt"))
    links = best_links(verified(spelling_pairs(surnames, rows=3, similarity=0.5), named), scratch, "surname").withColumnRenamed("token", "surname")
    blocks = named.join(maybe_broadcast(links), ["bucket", "surname"], "left").withColumn("surname", F.coalesce("centre", "surname"))
    blocks = blocks.select("spelling", "cnt", F.col("kind").alias("bucket"), "surname", "first", "more")
    forms = blocks.groupBy("bucket", "surname", "first", "more").agg(F.sum("cnt").alias("cnt"))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for (bucket, surname), group in groupby(rows(), key=lambda r: r[:2]):
            block = [r[2:] for r in group]
            for form, centres in zip(block, stars(block)):
                for c in centres:
                    out.append((bucket, surname, form[0], form[1], f"{bucket}|{surname}|{block[c][0]}|{block[c][1]}"))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["bucket", "surname", "first", "more", "author"])

    # forms of one surname are few however often they occur: they are distinct before they meet in one task
    clustered = forms.repartition("bucket", "surname").sortWithinPartitions("bucket", "surname").mapInArrow(cluster, "bucket string, surname string, first string, more string, author string")
    return blocks.join(clustered, ["bucket", "surname", "first", "more"]).select("spelling", "author").unionAll(nobody)


def variant_pairs(names: DataFrame) -> DataFrame:
    """(name) rows -> distinct (name_a, name_b), name_a < name_b in code point order: all pairs of spellings of one author."""
    scratch = Scratch(names.sparkSession, "variants")
    members = scratch.save(author_of(names), "members")
    sizes = members.groupBy("author").agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    classes = members.join(sizes, "author").withColumnRenamed("author", "class_id")
    return class_pairs(classes, "spelling", "name_a", "name_b").distinct()
