"""The features of all pairs of entries and candidates, computed by blocks of whole arrays.

Entries and candidates of a publication meet in blocks of a bounded number of pairs, laid out as sorted rows of one table; a Python stage reads
them batch by batch and computes the features of some 30,000 pairs at once: shared words by posting lists, edit distances by bit-parallel
columns (Myers, as a bit vector of any length), all else by gathers. The values are those of ``matching.with_features``, to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import metrics
from paperloom.operators.matching import FEATURES, TITLE_BAND
from paperloom.runtime import width

#: Entries of one block; larger publications are dealt into several, each with all their candidates, so that an entry's pairs lie together.
ENTRIES = 256
#: Pairs computed at once, and words of bit masks held for them.
PAIRS, MASKS = 32_768, 1 << 21


def blocks(bib_side: DataFrame, ref_side: DataFrame, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Both sides as one table, partitioned and sorted by block, the entries of a block before its candidates and these by length.
    ``counted``: rows whose numbers per pub_id tell the sizes, where the sides themselves are dear to compute twice."""
    b, r = bib_side.where("pub_id is not null"), ref_side.where("pub_id is not null")
    # large publications only: at most a row for every 256 entries
    sizes = F.broadcast((counted[0] if counted else b).groupBy("pub_id").agg(F.ceil(F.count("*") / ENTRIES).cast("int").alias("pb")).where("pb > 1"))
    parts = F.coalesce("pb", F.lit(1))
    null = lambda rows, c: F.lit(None).cast(rows.schema[c].dataType).alias(c)

    def side(s: str, raw: Column) -> list[Column]:
        return [F.lit("br".index(s)).cast("tinyint").alias("side"), F.col(f"{s}_len").alias("len"), *[F.col(f"{s}_{c}").alias(c) for c in ("title", "tokens", "names", "arxiv", "year")], F.expr(f"try_cast({s}_year as int)").alias("year_no"), raw.cast("binary").alias("raw")]

    left = b.join(sizes, "pub_id", "left").select("pub_id", F.pmod(F.xxhash64("bib_key"), parts).cast("int").alias("pb"), *side("b", F.col("b_raw")), "bib_key", null(r, "ref_id"), null(r, "ref_pos"))
    right = r.join(sizes, "pub_id", "left").select("pub_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("pb"), *side("r", X.dotted(F.col("r_arxiv"))), null(b, "bib_key"), "ref_id", "ref_pos")
    rows = left.unionByName(right)
    return rows.repartition(8 * width(rows.sparkSession), "pub_id", "pb").sortWithinPartitions("pub_id", "pb", "side", "len")


def feature_pairs(
    bib_side: DataFrame, ref_side: DataFrame, band: int | None = TITLE_BAND, features: list[str] = FEATURES, best: tuple[int, tuple[float, ...], bool] | None = None,
    weights: tuple[float, ...] | None = None, digits: int | None = None, counted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """pub_id, bib_key, ref_id, ref_pos, r_arxiv and ``features`` of the pairs whose title lengths differ by at most ``band``, of all without it.

    ``best`` (k, weights by FEATURES, logistic) keeps the k best candidates of an entry by that score, rounded to nine digits, with their rank;
    ties go by candidate position, then id. Of a logistic score only what can't be among them is left out, whatever breaks ties; what is left
    still has to be ranked. ``weights`` adds z, the weighted sum of the features in their order.
    ``digits`` rounds the features, as Spark's round does.
    """
    rows = blocks(bib_side, ref_side, counted)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shown = [*features, *(["z"] if weights else [])]
    ranks = best is not None and not best[2]
    schema = f"pub_id string, bib_key {fields['bib_key']}, ref_id {fields['ref_id']}, ref_pos {fields['ref_pos']}, r_arxiv string" + "".join(f", {f} double" for f in shown) + (", rank int" if ranks else "")
    need = [f for k, f in enumerate(FEATURES) if f in features or weights and weights[k] or best and best[1][k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, b, r, cut, f in _chunks(batches, band, need):
            rank = []
            if best:
                keep, rank = _ranked(t, cut, r, f, *best[:2]) if ranks else (_may_lead(cut, f, *best), [])
                b, r, f = b[keep], r[keep], {k: v[keep] for k, v in f.items()}
            if weights:
                f["z"] = _weighted(f, weights, len(b))
            rank = [pa.array(rank, pa.int32())] if ranks else []
            b, r = pa.array(b), pa.array(r)
            yield pa.RecordBatch.from_arrays([t["pub_id"].take(b), t["bib_key"].take(b), t["ref_id"].take(r), t["ref_pos"].take(r), t["arxiv"].take(r), *[pa.array(f[x] if digits is None or x == "z" else rounded(f[x], digits)) for x in shown], *rank], ["pub_id", "bib_key", "ref_id", "ref_pos", "r_arxiv", *shown, *(["rank"] if ranks else [])])

    return rows.mapInArrow(run, schema)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest decimal form of a number, as Spark rounds; that form is only looked at near a half."""
    scaled = np.abs(x) * 10**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10**digits, x)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5)
    if len(near):
        value, which = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in value])[which]
    return out


def weak_label(f: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    return ((f["arxiv_match"] == 1) | (f["arxiv_in_content"] == 1) | (np.round(f["combined_score"], 9) > threshold)).astype(int)


def pair_moments(bib_side: DataFrame, ref_side: DataFrame, threshold: float, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``metrics.moments`` of the features of all banded pairs and, last, of their weak label: each task sums up its own pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for *_, f in _chunks(batches, TITLE_BAND, FEATURES):
            sums = metrics.joined(sums, metrics.summed(np.stack([*[f[x] for x in FEATURES], weak_label(f, threshold)])))
        yield from metrics.packed(sums)

    return metrics.moments(blocks(bib_side, ref_side, counted).mapInArrow(run, metrics.PACKED), [*FEATURES, "label"])


def pair_values(bib_side: DataFrame, ref_side: DataFrame, threshold: float, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """feature, label, value, n: how many banded pairs of a weak label have a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, f in _chunks(batches, TITLE_BAND, FEATURES):
            label = weak_label(f, threshold)
            for x in FEATURES:
                for y in (0, 1):
                    value, n = np.unique(f[x][label == y], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(n), pa.string()), pa.array(np.full(len(n), y), pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], ["feature", "label", "value", "n"])

    counts = blocks(bib_side, ref_side, counted).mapInArrow(run, "feature string, label int, value double, n bigint")
    return counts.groupBy("feature", "label", "value").agg(F.sum("n").alias("n"))


def _weighted(f: dict[str, np.ndarray], weights: tuple[float, ...], n: int) -> np.ndarray:
    return sum((w * f[name] for name, w in zip(FEATURES, weights) if w), np.zeros(n))


def _ranked(t: dict[str, pa.Array], cut: np.ndarray, r: np.ndarray, f: dict[str, np.ndarray], k: int, weights: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best pairs of every entry and their ranks; nulls stand first among ties."""
    n = np.diff(cut)
    low = np.iinfo(np.int64).min
    ties = [t[c].take(pa.array(r)).cast(pa.int64()).fill_null(low).to_numpy() for c in ("ref_id", "ref_pos")]
    order = np.lexsort((*ties, -rounded(_weighted(f, weights, len(r)), 9), np.repeat(np.arange(len(n)), n)))
    rank = np.arange(len(order)) - np.repeat(cut[:-1], n) + 1
    return order[rank <= k], rank[rank <= k]


def _may_lead(cut: np.ndarray, f: dict[str, np.ndarray], k: int, weights: tuple[float, ...], logistic: bool) -> np.ndarray:
    """cut: where each entry's pairs begin, and the end."""
    score = _weighted(f, weights, int(cut[-1]))
    if logistic:
        score = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    n = np.diff(cut)
    order = np.lexsort((-score, np.repeat(np.arange(len(n)), n)))
    some = n > 0
    least = score[order[cut[:-1][some] + np.minimum(k, n[some]) - 1]]
    return score >= np.repeat(least, n[some]) - 2e-9


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """Tables of whole blocks, with the number of each row's block in ``block``."""
    rest: list[pa.RecordBatch] = []
    for batch in _ending(batches):
        if batch is not None:
            rest.append(batch)
        if not rest or batch is not None and sum(x.num_rows for x in rest) < 5000:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        t = {n: c.chunk(0) if c.num_chunks else None for n, c in zip(table.column_names, table.columns)}
        if not table.num_rows:
            rest = []
            continue
        pub = t["pub_id"].dictionary_encode().indices.to_numpy()
        key = np.stack([pub, t["pb"].to_numpy()])
        block = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        end = table.num_rows if batch is None else int(np.searchsorted(block, block[-1]))
        rest = [] if batch is None else table.slice(end).to_batches()
        if end:
            yield {n: c.slice(0, end) for n, c in t.items()} | {"block": block[:end]}


def _ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _chunks(batches: Iterator[pa.RecordBatch], band: int | None, need: list[str]) -> Iterator[tuple]:
    """table, rows of the entries and of the candidates of some pairs, where each entry begins among them, features by name."""
    for t in _whole(batches):
        side, block, size = t["side"].to_numpy(), t["block"], t["len"].to_numpy().astype(np.int64)
        b, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(b) or not len(r):
            continue
        if band is None:
            lo, hi = np.searchsorted(block[r], block[b], "left"), np.searchsorted(block[r], block[b], "right")
        else:
            far = int(size.max()) + 2 * band + 2
            at = block[r] * far + size[r] + band
            lo, hi = np.searchsorted(at, block[b] * far + size[b], "left"), np.searchsorted(at, block[b] * far + size[b] + 2 * band, "right")
        cum = np.concatenate([[0], np.cumsum(hi - lo)])
        words, names = _Shared(t["tokens"], block, b, r), _Shared(t["names"], block, b, r)
        years, year_no = t["year"].dictionary_encode(), t["year_no"]
        year, no_year, blank_year = years.indices.to_numpy(), ~year_no.is_valid().to_numpy(zero_copy_only=False), _is_blank(t["year"])
        year_no = year_no.fill_null(0).to_numpy().astype(np.int64)
        arxiv, blank_arxiv = t["arxiv"].dictionary_encode().indices.to_numpy(), _is_blank(t["arxiv"])
        cited_b, cited_r = _cited(t["raw"], block, b, r)
        titles = _Titles(t["title"].to_pylist())
        step = max(1, titles.rows_at_once) if "title_edit_dist" in need else len(b)
        i = 0
        while i < len(b):
            j = max(i + 1, min(i + step, int(np.searchsorted(cum, cum[i] + PAIRS, "right")) - 1))
            n = hi[i:j] - lo[i:j]
            cut = cum[i : j + 1] - cum[i]
            total = int(cut[-1])
            if total:
                pb = np.repeat(np.arange(i, j), n)
                pr = np.arange(total) - np.repeat(cut[:-1] - lo[i:j], n)
                x, y = b[pb], r[pr]
                place = lambda bb, rr: (cut[bb - i] + rr - lo[bb])[(rr >= lo[bb]) & (rr < hi[bb])]
                f = {}
                shared, both = words.counts(i, j, place, total), (words.size[x] > 0) & (words.size[y] > 0)
                known = np.maximum(words.distinct[x] + words.distinct[y] - shared, 1)
                f["title_jaccard"] = np.where(both, shared / known, 0.0)
                f["title_overlap"] = np.where(both, shared / np.maximum(np.minimum(words.distinct[x], words.distinct[y]), 1), 0.0)
                lx, ly = titles.length[x], titles.length[y]
                full = (lx > 0) & (ly > 0)
                if "title_edit_dist" in need:
                    f["title_edit_dist"] = np.where(full, 1 - titles.distances(x, y) / np.maximum(np.maximum(lx, ly), 1), 0.0)
                same, both = names.counts(i, j, place, total), (names.size[x] > 0) & (names.size[y] > 0)
                f["author_overlap"] = np.where(both, same / np.maximum(np.minimum(names.distinct[x], names.distinct[y]), 1), 0.0)
                f["first_author_match"] = (both & (names.first[x] == names.first[y])).astype(float)
                dated = ~blank_year[x] & ~blank_year[y]
                f["year_match"] = (dated & (year[x] == year[y])).astype(float)
                diff = np.where(no_year[x] | no_year[y], 50, np.minimum(np.abs(year_no[x] - year_no[y]), 50))
                f["year_diff"] = np.where(dated, diff, 10).astype(float)
                f["arxiv_match"] = (~blank_arxiv[x] & (arxiv[x] == arxiv[y])).astype(float)
                f["arxiv_in_content"] = np.zeros(total)
                s, e = np.searchsorted(cited_b, [i, j])
                f["arxiv_in_content"][place(cited_b[s:e], cited_r[s:e])] = 1.0
                f["num_matching_authors"] = np.minimum(same, 20).astype(float)
                f["title_len_ratio"] = np.where(full, np.minimum(lx / np.maximum(ly, 1), ly / np.maximum(lx, 1)), 0.0)
                f["combined_score"] = 0.4 * f["title_jaccard"] + 0.3 * f["author_overlap"] + 0.2 * f["year_match"] + 0.1 * f["first_author_match"]
                yield t, x, y, cut, f
            i = j


def _is_blank(texts: pa.Array) -> np.ndarray:
    return pa.compute.equal(texts, "").to_numpy(zero_copy_only=False)


class _Shared:
    """Distinct words of every row, and how many of them the pairs of a block share."""

    def __init__(self, lists: pa.Array, block: np.ndarray, b: np.ndarray, r: np.ndarray) -> None:
        self.size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        code = lists.flatten().dictionary_encode()
        v, code = max(1, len(code.dictionary)), code.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), self.size)
        start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.first = np.full(len(lists), -1)
        self.first[self.size > 0] = code[start[self.size > 0]]
        one = np.unique(row * v + code)
        row, code = one // v, one % v
        self.distinct = np.bincount(row, minlength=len(lists))
        number = np.full(len(lists), -1)
        number[r] = np.arange(len(r))
        of_r = number[row] >= 0
        key, who = block[row[of_r]] * v + code[of_r], number[row[of_r]]
        order = np.argsort(key, kind="stable")
        key, self.candidates = key[order], who[order]
        number = np.zeros(len(lists), np.int64)
        number[b] = np.arange(len(b))
        self.entry, asked = number[row[~of_r]], block[row[~of_r]] * v + code[~of_r]
        self.lo, self.hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")

    def counts(self, i: int, j: int, place, total: int) -> np.ndarray:
        s, e = np.searchsorted(self.entry, [i, j])
        out, most = np.zeros(total, np.int64), 1 << 22
        cum = np.concatenate([[0], np.cumsum(self.hi[s:e] - self.lo[s:e])])
        while s < e:  # words that all rows hold are taken a few at a time
            k = max(1, int(np.searchsorted(cum, cum[0] + most, "right")) - 1)
            n = self.hi[s : s + k] - self.lo[s : s + k]
            at = np.arange(int(cum[k] - cum[0])) - np.repeat(cum[:k] - cum[0] - self.lo[s : s + k], n)
            out += np.bincount(place(np.repeat(self.entry[s : s + k], n), self.candidates[at]), minlength=total)
            s, cum = s + k, cum[k:]
        return out


def _cited(raw: pa.Array, block: np.ndarray, b: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of entries and candidates where the entry's raw text holds the candidate's id, compared as bytes."""
    text, out_b, out_r = raw.to_pylist(), [], []
    lo, hi = np.searchsorted(block[r], block[b], "left"), np.searchsorted(block[r], block[b], "right")
    ids: dict[bytes, list[int]] = {}
    sizes: dict[int, list[bytes]] = {}
    now = -1
    for i, (row, g, s, e) in enumerate(zip(b.tolist(), block[b].tolist(), lo.tolist(), hi.tolist())):
        if g != now:
            now, ids, sizes = g, {}, {}
            for k in range(s, e):
                ids.setdefault(text[r[k]], []).append(k)
            for x in ids:
                sizes.setdefault(len(x), []).append(x)
        own = text[row]
        for n, some in sizes.items():
            if len(some) > 3 * len(own):
                some = ids.keys() & {own[k : k + n] for k in range(len(own) - n + 1)}
            for x in some:
                if x in own:
                    out_b += [i] * len(ids[x])
                    out_r += ids[x]
    return np.array(out_b, np.int64), np.array(out_r, np.int64)


class _Titles:
    """Edit distances of many pairs of texts, in characters."""

    def __init__(self, texts: list[str]) -> None:
        self.length = np.array([len(x) for x in texts], np.int64)
        point = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        letter = np.zeros(0x110000, np.int32)
        letter[point] = 1
        used = np.flatnonzero(letter)
        letter[used] = np.arange(len(used))
        self.letters, self.code = max(1, len(used)), letter[point]
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.rows_at_once = MASKS // (self.letters * max(1, -(-int(self.length.max(initial=1)) // 64)))

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows x against rows y. The pattern, x, lies in the bits of one or more words; all pairs go along their texts, y, in step, those with
        long ones first in order, so that the ones still on their way are a leading part."""
        out = np.zeros(len(x), np.int64)
        words = np.maximum(1, -(-self.length[x] // 64))
        for w in np.unique(words):
            at = np.flatnonzero(words == w)
            at = at[np.argsort(-self.length[y[at]], kind="stable")]
            out[at] = self._columns(x[at], y[at], int(w))
        return out

    def _columns(self, x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
        rows, which = np.unique(x, return_inverse=True)
        m = self.length[rows]
        row = np.repeat(np.arange(len(rows)), m)
        at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        masks = np.zeros(words * len(rows) * self.letters, np.uint64)
        np.bitwise_or.at(masks, ((at // 64) * len(rows) + row) * self.letters + self.code[np.repeat(self.start[rows], m) + at], np.uint64(1) << (at % 64).astype(np.uint64))
        masks = masks.reshape(words, -1)
        base, text, n = which * self.letters, self.start[y], self.length[y]
        going = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right")  # pairs whose text has a j-th sign
        vp, vn = np.full((words, len(x)), ~np.uint64(0)), np.zeros((words, len(x)), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        room = np.empty((5, len(x)), np.uint64)
        for j, c in enumerate(going):
            letter = base[:c] + self.code[text[:c] + j]
            eq, d, t, hp, hn = (z[:c] for z in room)
            plus, up, down = None, one, None  # carries between the words of a pattern
            for w in range(words):
                p, q = vp[w, :c], vn[w, :c]
                np.take(masks[w], letter, out=eq)
                np.bitwise_and(eq, p, out=t)
                np.add(t, p, out=d)
                if words > 1:
                    over = d < p
                    if plus is not None:
                        np.add(d, plus, out=d)
                        over |= d < plus
                    plus = over.astype(np.uint64)
                np.bitwise_xor(d, p, out=d)
                np.bitwise_or(d, eq, out=d)
                np.bitwise_or(d, q, out=d)
                np.bitwise_or(p, d, out=hp)
                np.invert(hp, out=hp)
                np.bitwise_or(hp, q, out=hp)
                np.bitwise_and(p, d, out=hn)
                more, less = (hp >> top, hn >> top) if words > 1 else (one, None)
                np.left_shift(hp, one, out=hp)
                np.bitwise_or(hp, up, out=hp)
                np.left_shift(hn, one, out=hn)
                if down is not None:
                    np.bitwise_or(hn, down, out=hn)
                up, down = more, less
                np.bitwise_or(d, hp, out=t)
                np.invert(t, out=t)
                np.bitwise_or(hn, t, out=p)
                np.bitwise_and(hp, d, out=q)
        out = n.copy()
        for w in range(words):
            bits = np.clip(self.length[x] - 64 * w, 0, 64)
            used = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
            out += np.bitwise_count(vp[w] & used).astype(np.int64) - np.bitwise_count(vn[w] & used).astype(np.int64)
        return out
