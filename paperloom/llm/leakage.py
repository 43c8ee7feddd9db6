"""Evaluation items standing, whole or in part, in a training corpus.

One Aho-Corasick automaton holds the word trigrams of all items, over normalised text: lower case, letters and digits only,
single blanks, and one word per sign in scripts written without blanks; items of equal normalised text are one. Every document is scanned once.
Between trigrams of an item near each other (first those of at most two items, then all) the longest common word sequence of item and passage is
measured; the item leaks if it covers at least ``share`` of the item's words and half that share of the words peculiar to it, so that items cut
from one template are told apart. How many items hold a trigram or a word is counted over all items before they are cut into blocks. Offsets
are those of the original text, whatever lower case does to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spread import spread
from paperloom.runtime import Scratch

# Signs of scripts written without blanks (fixed values): Thai, Han, Kana and their extensions.
_SINGLE = "\u0e00-\u0e7f\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
WORD = re.compile(r"[^\W_]+")
HAS_SINGLE = re.compile(f"[{_SINGLE}]")
SINGLE_OR_WORD = re.compile(f"[{_SINGLE}]|[^\\W_{_SINGLE}]+")
#: Items whose texts together take about this many bytes share one automaton (and one broadcast); more items make more scans.
BLOCK_BYTES = 16 << 20
#: Two anchors of one passage are at most this many item lengths apart, or MIN_GAP words.
GAP_LENGTHS, MIN_GAP = 1.5, 40
#: Trigrams of at most so many items are tried first.
ANCHOR_ITEMS = 2
#: Words beside the outermost anchors that still belong to the passage.
MARGIN = 3


def _pattern(text: str) -> re.Pattern:
    return WORD if text.isascii() or not HAS_SINGLE.search(text) else SINGLE_OR_WORD


def words_of(text: str) -> list[str]:
    """The words in lower case, as many as there are in the text as written."""
    low = text.lower()
    if len(low) == len(text):
        return _pattern(low).findall(low)
    return [w.lower() for w in _pattern(text).findall(text)]


def places_of(text: str) -> list[tuple[int, int]]:
    """Where the words of words_of stand in the text."""
    low = text.lower()
    text = low if len(low) == len(text) else text
    return [m.span() for m in _pattern(text).finditer(text)]


def grams_of(words: list[str]) -> list[str]:
    """The different trigrams of an item, the whole item if it is shorter, as they stand in normalised text."""
    n = min(3, len(words))
    return list(dict.fromkeys(f" {' '.join(words[k : k + n])} " for k in range(len(words) - n + 1))) if words else []


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if hit := row & place.get(w, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Item(NamedTuple):
    ids: list[int]
    words: list[str]
    own_words: list[str]
    rare: list[str]


class Detector:
    """Finds items of one block; what is peculiar to an item was settled over all blocks."""

    def __init__(self, items: list[Item], share: float) -> None:
        import ahocorasick

        self.share, self.items = share, items
        holders: dict[str, list[tuple[int, bool]]] = {}
        for i, item in enumerate(items):
            rare = set(item.rare)
            for gram in grams_of(item.words):
                holders.setdefault(gram, []).append((i, gram in rare))
        self.machine = ahocorasick.Automaton()
        for gram, ids in holders.items():
            self.machine.add_word(gram, (gram.count(" ") - 1, tuple(ids)))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def passage(self, i: int, words: list[str], spots: list[tuple[int, int]]) -> tuple[float, int, int] | None:
        """(covered share, first word, end word) of the passage around these trigrams that holds most of the item, if that is enough."""
        item, own = self.items[i].words, self.items[i].own_words
        gap, best = max(MIN_GAP, GAP_LENGTHS * len(item)), (0.0, 0, 0)
        first = 0
        for k in range(1, len(spots) + 1):
            if k == len(spots) or spots[k][0] - spots[k - 1][1] > gap:
                a, b = max(0, spots[first][0] - MARGIN), min(len(words), spots[k - 1][1] + MARGIN)
                if (b - a) / len(item) >= self.share:  # a shorter passage cannot hold enough words
                    best = max(best, (common_words(item, words[a:b]) / len(item), a, b))
                first = k
        if best[0] < self.share or own and common_words(own, words[best[1] : best[2]]) < self.share / 2 * len(own):
            return None
        return best

    def find(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, covered share, first character, end character) of each item the text holds."""
        if self.empty:
            return []
        words = words_of(text)
        if not words:
            return []
        plain = f" {' '.join(words)} "
        hits: dict[int, list[tuple[int, int, bool]]] = {}
        for end, (n, ids) in self.machine.iter(plain):
            for i, few in ids:
                hits.setdefault(i, []).append((end, n, few))
        out, starts, found = [], None, None
        for i, ends in hits.items():
            if starts is None:  # the word that ends before each blank of the normalised text
                starts, n = {}, 0
                for p, c in enumerate(plain):
                    if c == " ":
                        starts[p] = n
                        n += 1
            rare = [(starts[e] - n, starts[e]) for e, n, few in ends if few]
            best = self.passage(i, words, rare)
            if best is None and len(rare) < len(ends):
                best = self.passage(i, words, [(starts[e] - n, starts[e]) for e, n, _ in ends])
            if best is not None:
                covered, a, b = best
                found = found or places_of(text)
                out += [(c, covered, found[a][0], found[b - 1][1]) for c in self.items[i].ids]
        return out


def prepared_items(items: DataFrame) -> DataFrame:
    """(i, t) -> (ids, words, own_words, rare, n_bytes, key): items of equal words as one, with their words of no other item (of an item with a near
    copy those of the two alone) and their trigrams of at most ANCHOR_ITEMS items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(map(grams_of, words), pa.list_(pa.string()))], ["i", "words", "grams"])

    scratch = Scratch(items.sparkSession, "items")
    split = items.mapInArrow(run, "i bigint, words array<string>, grams array<string>").where("size(words) > 0")
    one = scratch.save(split.groupBy("words", "grams").agg(F.array_sort(F.collect_set("i")).alias("ids")).withColumn("key", F.get("ids", F.lit(0))), "one")
    pieces = one.select("key", F.explode(F.array_distinct("words")).alias("piece"), F.lit(True).alias("word")).unionAll(one.select("key", F.explode("grams"), F.lit(False)))
    held = pieces.join(pieces.groupBy("word", "piece").agg(F.count("*").alias("n")), ["word", "piece"]).where(F.col("n") <= ANCHOR_ITEMS)
    some = lambda c: F.collect_list(F.when(c, F.col("piece")))
    few = held.groupBy("key").agg(some(F.col("word") & (F.col("n") == 1)).alias("alone"), some(F.col("word")).alias("shared"), some(~F.col("word")).alias("rare"))
    empty = F.array().cast("array<string>")
    peculiar = F.coalesce(F.when(F.size("alone") > 0, F.col("alone")).otherwise(F.col("shared")), empty)
    kept = F.filter("words", lambda w: F.array_contains("peculiar", w))  # in the item's order, for the common sequence
    rows = one.join(few, "key", "left").select("key", "ids", "words", peculiar.alias("peculiar"), F.coalesce("rare", empty).alias("rare"))
    return scratch.save(rows.select("key", "ids", "words", kept.alias("own_words"), "rare", F.octet_length(F.array_join("words", " ")).alias("n_bytes")), "prepared")


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.4) -> DataFrame:
    """documents, items -> (doc_id, item_id, covered, start_char, end_char): one row per document and item it holds.

    ``covered`` is the share of the item's words found in the item's order. Null and empty texts on either side match nothing;
    repeated item rows count once, of an id with several texts the greatest is used; documents are taken row by row. The items are
    collected in blocks of bounded size, each broadcast as one automaton; documents are never shuffled for them.
    """
    own = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").groupBy("i").agg(F.max("t").alias("t"))
    own = prepared_items(own)
    blocks = 1 + (own.agg(F.sum("n_bytes")).first()[0] or 0) // BLOCK_BYTES
    docs = spread(documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null"))
    kind = documents.schema[doc_id].dataType.simpleString()
    result = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("key").collect()
        known = documents.sparkSession.sparkContext.broadcast([(r["ids"], r["words"], r["own_words"], r["rare"]) for r in block])

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            detector = Detector([Item(*item) for item in known.value], share)
            for batch in batches:
                rows = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in detector.find(t)]
                d, i, c, s, e = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, batch.schema.field(0).type), pa.array(i, pa.int64()), pa.array(c, pa.float64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "item_id", "covered", "start_char", "end_char"])

        part = docs.mapInArrow(run, f"doc_id {kind}, item_id bigint, covered double, start_char int, end_char int")
        result = part if result is None else result.unionAll(part)
    return result
