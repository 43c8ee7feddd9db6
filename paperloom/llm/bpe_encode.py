"""Token ids of a whole corpus under a public byte-level BPE vocabulary, by corpus-level merge replay.

Texts are cut into words; the distinct words of a batch are laid out as one chain of byte tokens, an inverted index
maps every mergeable pair to its positions, and merges are applied in rank order, each touching only the merged
positions and their neighbours. A word is thus merged once for all its occurrences, and the work is linear in the
vocabulary's bytes, not in the corpus'. No shuffle: documents stay in the partition that read them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spread import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern published with the vocabulary (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words kept between batches of a task; only speed depends on it.
MEMORY_WORDS = 200_000
#: Ranks of pairs kept between batches of a task; only speed depends on it.
MEMORY_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes words; holds the vocabulary, the pair table learned so far and the words seen lately."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[tuple[int, int], int | None] = {}
        self.memory: dict[str, list[int]] = {}

    def _rank(self, left: int, right: int) -> int | None:
        key = (left, right)
        try:
            return self.pair[key]
        except KeyError:
            rank = self.pair[key] = self.ranks.get(self.token[left] + self.token[right])
            return rank

    def learn(self, words: list[str]) -> None:
        """Merge replay over all given words at once."""
        ids: list[int] = []
        starts = []
        for word in words:
            starts.append(len(ids))
            ids.extend(self.byte_id[b] for b in word.encode("utf-8", "surrogatepass"))
            ids.append(-1)  # words do not merge with each other
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            if ids[i] >= 0 and ids[i + 1] >= 0 and (rank := self._rank(ids[i], ids[i + 1])) is not None:
                index.setdefault(rank, []).append(i)
        waiting = list(index)
        heapq.heapify(waiting)
        while waiting:
            rank = heapq.heappop(waiting)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort(reverse=True)
            while places:
                i = places.pop()
                j = after[i]
                if ids[i] < 0 or j >= n or ids[j] < 0 or self._rank(ids[i], ids[j]) != rank:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = rank, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                lower = False
                for place, left, right in ((before[i], before[i], i), (i, i, k)):
                    if left >= 0 and right < n and ids[left] >= 0 and ids[right] >= 0 and (new := self._rank(ids[left], ids[right])) is not None:
                        index.setdefault(new, []).append(place)
                        heapq.heappush(waiting, new)
                        lower |= new < rank
                if lower and places:  # a better merge appeared; it goes first
                    index.setdefault(rank, []).extend(places)
                    heapq.heappush(waiting, rank)
                    break
        for word, start in zip(words, starts):
            out, i = [], start
            while ids[i] != -1:
                out.append(ids[i])
                i = after[i]
            self.memory[word] = out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts; null and empty texts have no ids."""
        import regex

        words = [regex.findall(WORD_PATTERN, t) if t else [] for t in texts]
        if len(self.memory) > MEMORY_WORDS:
            self.memory.clear()
        if len(self.pair) > MEMORY_PAIRS:
            self.pair.clear()
        new = {w for ws in words for w in ws}.difference(self.memory)
        if new:
            self.learn(list(new))
        known, flat, offsets = self.memory, [], [0]
        for ws in words:
            for w in ws:
                flat += known[w]
            offsets.append(len(flat))
        return np.array(flat, dtype=np.int32), np.array(offsets, dtype=np.int32)


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """documents -> (doc_id, ids array<int>), without special tokens; their strings in a text are ordinary text.

    One row per input row. A null and an empty text have the empty list, a blank text the ids of its blanks. Other columns are
    ignored; an empty table gives an empty result. ``vocabulary`` is the path of a rank file on the driver; the ranks (about a megabyte, fixed)
    are broadcast.
    """
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(ranks.value)
        for batch in batches:
            flat, offsets = replay.encode(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return spread(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>")
