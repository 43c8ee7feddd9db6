"""Bibliography entries matched to candidate papers of their publication without a common key, each match with a confidence.

Candidates share blocking keys inside a publication (neighbouring title words, author surnames, an identifier). Every
candidate pair is a continuous truth value; weighted rules on title, author, year, sequel and identifier evidence, on
exclusivity (an entry means one paper) and on transitivity (two rows of one paper match alike) are hinge losses. Their sum
is convex and is minimised by alternating directions: every rule holds its own copy of its variables, the copies are
averaged, and the blocks of different entries are solved in parallel. The values at the minimum are the confidences.

What makes another paper of a title (a sequel, an erratum, a special case) is learned, not listed: words that stand before or behind a whole
title of another candidate, wherever that is, make a paper of its own; phrases, also with one open word, that do so for a
fixed share of all titles are the marks of sequels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.name_variants import fold
from paperloom.runtime import Scratch

_STOP = frozenset("a an the of on and or for in under from with by to at how is are via or what next".split())
_WORDS = re.compile(r"[^\W_]+")
_TEX = re.compile(r"\\[A-Za-z]+\*?|[{}$\\^_~]")
_FORMULA = re.compile(r"\$[^$]*\$")
_YEAR = re.compile(r"(?<!\d)(1[6-9]\d\d|20\d\d)")
_PIECE = re.compile(r";\s|\n|\s\|\s|\",\s*\"|\s[(\[](?:2|b|ii)[)\]]\s")  # where a second reference begins
_NAME_NOISE = frozenset("collaboration collab coll others and the".split())

# Weights of the rules; the larger, the more it costs to break them.
WEIGHTS = {"same": 6.0, "same_title": 3.0, "identifier": 1.0, "other_title": 8.0, "other_people": 8.0, "sequel": 8.0, "other_year": 3.0, "prior": 0.6, "exclusive": 8.0, "transitive": 4.0}
#: Matches of at least this confidence are reported.
LEAST_CONFIDENCE = 0.5
#: Entries are solved until no value and no copy differs by more than ADMM_RESIDUAL; ADMM_ROUNDS only bounds what never settles.
ADMM_RESIDUAL, ADMM_ROUNDS, ADMM_STEP = 2e-3, 5000, 1.0
#: Titles of so few letters are held against each other letter by letter.
SHORT_TITLE = 24
#: Pairs of no greater title evidence are left out, unless they share an identifier.
LEAST_TITLE = 0.45
#: Shared title keys that make a candidate.
LEAST_KEYS = 2
#: A phrase marks sequels if it does so for this share of all titles, and for three at least; so there are at most 8 / MARK_SHARE phrases.
MARK_SHARE, MARK_WORDS, MARK_FILLERS = 1e-3, 4, 3
#: What is left of a title without its marks has so many words at least.
BASE_WORDS = 2


def one_edit(a: str, b: str) -> bool:
    """Equal but for one inserted, left out or changed letter or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def _misspellings(words: tuple[str, ...]) -> dict[str, str]:
    """Every string one edit away from a word, with the word."""
    letters, out = "abcdefghijklmnopqrstuvwxyz", {}
    for w in words:
        for i in range(len(w) + 1):
            near = [w[:i] + c + w[i:] for c in letters]
            if i < len(w):
                near += [w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in letters)]
            if i < len(w) - 1:
                near.append(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
            out.update((x, w) for x in near if x != w)
    return out


class Marks:
    """The learned marks: phrases before ("-") and behind ("+") a title, * standing for any word; long words are known with one error."""

    def __init__(self, phrases: list[tuple[str, str]] = ()) -> None:
        words = {w for _, phrase in phrases for w in phrase.split() if len(w) > 5}
        self.misspelled = {x: w for x, w in _misspellings(tuple(sorted(words))).items() if x not in words}
        # the phrases of a side word by word from the end of the title inward, so that most titles are left at their first word; None ends a phrase
        self.steps: dict[str, dict] = {"+": {}, "-": {}}
        for side, phrase in phrases:
            at = self.steps[side]
            for w in phrase.split(" ")[:: -1 if side == "+" else 1]:
                at = at.setdefault(w, {})
            at[None] = True

    def _longest(self, side: str, words: list[str]) -> int:
        """Words of the longest phrase the title ends (or begins) with; one of several words may be open."""
        whole, opened, longest = self.steps[side], [], 0
        for k in range(min(MARK_WORDS, len(words) - BASE_WORDS)):
            w = words[-1 - k if side == "+" else k]
            w = self.misspelled.get(w, w)
            opened = [x[w] for x in opened if w in x]
            if "*" in whole:
                opened.append(whole["*"])
            whole = whole.get(w, {})
            if not whole and not opened:
                break
            if None in whole or k and any(None in x for x in opened):
                longest = k + 1
        return longest

    def split(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(words of the title itself, marks)."""
        marks = []
        for side in "+-":
            k = self._longest(side, words)
            if k:
                part, words = (words[-k:], words[:-k]) if side == "+" else (words[:k], words[k:])
                marks.append(side + " ".join(self.misspelled.get(w, w) for w in part))
        return words, marks


def learned_marks(titles: DataFrame) -> list[tuple[str, str]]:
    """(title) -> (side, phrase): words before or behind another whole title, in at least MARK_SHARE of all titles; phrases that differ in one
    word only, with at least MARK_FILLERS fillers, are counted together. What is collected is bounded by the share."""
    bare = F.regexp_replace(F.regexp_replace("title", r"\$[^$]*\$", " "), r"\\[A-Za-z]+\*?|[{}$\\^_~]", " ")
    words = F.split(F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " ")), " ")
    own = titles.select(words.alias("ws")).where(F.size("ws") > BASE_WORDS - 1).distinct()
    scratch = Scratch(titles.sparkSession, "marks")
    own = scratch.save(own.select("ws", F.xxhash64(F.array_join("ws", " ")).alias("h")), "titles")
    n = F.size("ws")
    steps = F.explode(F.sequence(F.lit(1), F.least(n - BASE_WORDS, F.lit(MARK_WORDS)))).alias("k")
    longer = own.where(n > BASE_WORDS).select("ws", n.alias("n"), steps)
    cut = lambda side, base, part: longer.select(F.lit(side).alias("side"), F.xxhash64(F.array_join(base, " ")).alias("h"), F.array_join(part, " ").alias("phrase"))
    k = F.col("k")
    forms = cut("+", F.slice("ws", F.lit(1), F.col("n") - k), F.slice("ws", F.col("n") - k + 1, k)).unionAll(cut("-", F.slice("ws", k + 1, F.col("n") - k), F.slice("ws", F.lit(1), k)))
    # written, as it is read twice: else all forms are shuffled once more for the phrases of several words
    found = scratch.save(forms.join(own.select("h"), "h").groupBy("side", "phrase").agg(F.count("*").alias("n")), "phrases")
    parts = F.split("phrase", " ")
    slots = F.transform(parts, lambda w, i: F.array_join(F.transform(parts, lambda v, j: F.when(i == j, F.lit("*")).otherwise(v)), " "))
    opened = found.where(F.size(parts) > 1).select("side", F.explode(slots).alias("phrase"), "n").groupBy("side", "phrase").agg(F.sum("n").alias("n"), F.count("*").alias("fillers")).where(F.col("fillers") >= MARK_FILLERS)
    every = found.select("side", "phrase", "n").unionAll(opened.select("side", "phrase", "n"))
    least = max(3.0, MARK_SHARE * own.count())
    learned = [(r["side"], fold(r["phrase"])) for r in every.where(F.col("n") >= least).select("side", "phrase").collect()]
    scratch.keep()
    return learned


def title_parts(title: str, marks: Marks) -> tuple[str, str, list[str]]:
    """(letters run together, marks of a sequel, content words) of a title, accents, markup and formulas removed."""
    if "$" in title:
        title = _FORMULA.sub(" ", title)
    bare, found = marks.split(_WORDS.findall(fold(_TEX.sub(" ", title))))
    return "".join(bare), " ".join(sorted(found)), [w for w in bare if w not in _STOP]


def _blocking_keys(rows: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """(rows with their words' stems, keys of which two must be shared, keys of which one is enough), 64 bits each: neighbouring stems of title
    words (in short titles also next but one); titles of one or two words as a whole, surnames and the identifier."""
    known = rows.select(F.col("id").alias(key), "pub", "identifier", F.transform(F.filter(F.split("words", " "), lambda w: w != ""), lambda w: F.substring(w, 1, 4)).alias("stems"), F.filter(F.split("names", " "), lambda n: F.length(n) > 3).alias("long_names"))
    size, none = F.size("stems"), F.array().cast("array<bigint>")
    pair = lambda kind, step: F.transform(F.slice("stems", F.lit(1), F.greatest(size - step, F.lit(0))), lambda w, i: F.xxhash64("pub", F.lit(kind), w, F.get("stems", i + step)))
    names = F.transform("long_names", lambda n: F.xxhash64("pub", F.lit("n"), F.substring(n, 1, 6)))
    whole = F.when(size.between(1, 2), F.array(F.xxhash64("pub", F.lit("s"), F.get("stems", F.lit(0)), F.get("stems", F.lit(1))))).otherwise(none)
    identifier = F.when(F.col("identifier") != "", F.array(F.xxhash64("pub", F.lit("i"), "identifier"))).otherwise(none)
    return known, F.array_distinct(F.concat(pair("t", 1), F.when(size <= 4, pair("u", 2)).otherwise(none))), F.array_distinct(F.concat(names, whole, identifier))


_OUT = ["id", "pub", "letters", "marks", "names", "lead", "year", "identifier", "title_known", "words"]
_SCHEMA = "id bigint, pub string, letters string, marks string, names string, lead string, year int, identifier string, title_known boolean, words string"


def values(column: pa.Array) -> list:
    """to_pylist of strings, numbers and lists of them, without a scalar object for each value."""
    if pa.types.is_list(column.type):
        inner, ends = values(column.values), column.offsets.to_numpy().tolist()
        lists = [inner[a:b] for a, b in zip(ends, ends[1:])]
        return [x if known else None for x, known in zip(lists, column.is_valid().to_pylist())] if column.null_count else lists
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _prepared(rows: DataFrame, make, phrases: list[tuple[str, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
        marks = Marks(phrases)
        for batch in batches:
            made = zip(*(make(marks, *row) for row in zip(*map(values, batch.columns))))
            yield pa.RecordBatch.from_arrays([pa.array(m, t) for m, t in zip(made, types)], _OUT)

    return rows.mapInArrow(run, _SCHEMA)


NO_MARKS = Marks()


def _entry(marks_known, eid, pub, title, authors, year, identifier, raw):
    known, signed, found = bool(title and title.strip()), bool(authors and authors.strip()), _YEAR.search(year or "")
    piece = _PIECE.split(raw.strip().lstrip('"'), maxsplit=1)[0] if raw and not (known and signed and found) else ""
    source = title if known else piece
    letters, marks, words = title_parts(source, marks_known if known else NO_MARKS)  # a whole reference has no ends of a title
    people = authors if signed else piece
    names = [w for w in _WORDS.findall(fold(people)) if len(w) > 1 and w not in _NAME_NOISE]  # single letters are initials
    years = [found.group()] if found else _YEAR.findall(piece)  # of a reference the last
    ident = (identifier or "").strip().replace(".", "-")
    return eid, pub, letters, marks, " ".join(names) if people else "", "", int(years[-1]) if years else None, ident, known, " ".join(words)


def _candidate(marks_known, rid, pub, title, authors, date, identifier):
    letters, marks, words = title_parts(title or "", marks_known)
    names = []
    for a in authors or ():
        ws = [w for w in _WORDS.findall(fold(a or "").replace("'", "")) if w not in _NAME_NOISE]
        if ws:
            names.append(ws[0] if "," in a else ws[-1])
    ident = (identifier or "").strip().replace(".", "-")
    found = _YEAR.search(date or "")
    year = int(found.group()) if found else 2000 + int(ident[:2]) if re.match(r"\d{4}-\d{4,5}$", ident) else None
    return rid, pub, letters, marks, " ".join(names), names[0] if names else "", year, ident, bool(letters), " ".join(words)


def _grams(letters: str) -> frozenset[str]:
    return frozenset(map("".join, zip(letters, letters[1:], letters[2:]))) or frozenset((letters,))


def _near(a: str, cache: dict) -> bool:
    if a in cache["words"]:
        return True
    lead = cache["lead"]
    if lead is None:  # most names are found as they are
        lead = cache["lead"] = {}
        for w in cache["words"]:
            lead.setdefault(w[:3], []).append(w)
            lead.setdefault("-" + w[-3:], []).append(w)
    for w in (*lead.get(a[:3], ()), *lead.get("-" + a[-3:], ())):
        if one_edit(a, w):
            return True
    return False


def _title(e: tuple, r: tuple, cache: dict) -> float:
    if not e[0] or not r[0]:
        return 0.0
    if e[0] == r[0] or max(len(e[0]), len(r[0])) <= SHORT_TITLE and one_edit(e[0], r[0]):
        return 1.0
    if cache.get("letters") != e[0]:
        cache.update(letters=e[0], grams=_grams(e[0]))
    a, b = cache["grams"], cache["papers"].get(r[0])
    if b is None:
        b = cache["papers"][r[0]] = _grams(r[0])
    common, least, most = len(a & b), min(len(a), len(b)), max(len(a), len(b))
    return common / least if e[6] and least >= 0.35 * most else common / len(b)


def _people(e: tuple, r: tuple, cache: dict) -> float:
    if cache.get("e") is not e:
        cache.update(e=e, words=frozenset(e[2].split()), lead=None)
    words = cache["words"]
    if not words or not r[2]:
        return 0.0
    names = r[2].split()
    if r[3] in words and r[3] in names:
        return 1.0
    hits = sum(_near(n, cache) for n in names)
    return 1.0 if hits and (hits >= 0.5 * len(names) or _near(r[3], cache)) else -1.0


def evidence(e: tuple, r: tuple, cache: dict) -> tuple[float, float, float, float, float] | None:
    """(title, people, year, sequel, identifier): title in 0..1; people 1 shared, 0 unknown, -1 other; year likewise; sequel 1 if the
    sequel words differ; identifier 1 if equal. e and r are (letters, marks, names, lead, year, identifier, title_known).

    None for a title up to LEAST_TITLE without an equal identifier. Lossless: up to a title of 0.62 every rule for a match has body 0 but the
    identifier's, and its weight is an eighth of the other title's, so such a pair ends at 0; rows of one paper have one title and are left out together."""
    title, same = _title(e, r, cache), bool(e[5]) and e[5] == r[5]
    if title <= LEAST_TITLE and not same:
        return None
    year = 0.0 if e[4] is None or r[4] is None else 1.0 if -1 <= e[4] - r[4] <= 2 else -0.5 if abs(e[4] - r[4]) <= 3 else -1.0
    sequel = float(e[1] != r[1]) if e[6] else float(any(m not in e[0] for m in _WORDS.findall(r[1])))
    return title, _people(e, r, cache), year, sequel, float(same)


def solve(group: np.ndarray, paper: np.ndarray, ev: np.ndarray) -> np.ndarray:
    """Confidences of the pairs by alternating directions. group: the entry of each pair, sorted; paper: equal for candidate rows of
    one paper; ev: title, people, year, sequel, identifier. Entries that have settled leave the rounds."""
    n = len(group)
    out = np.zeros(n)
    if not n:
        return out
    title, people, year, sequel, ident = ev.T
    sure = np.clip((title - 0.62) / 0.2, 0, 1)  # how far the titles count as one
    w = WEIGHTS
    # body -> match: hinge max(0, body - y); body -> not match: hinge max(0, body + y - 1)
    up = [(w["same"], sure * (people > 0)), (w["same_title"], np.where(people == 0, np.minimum(sure, (year > 0) * 1.0 + 0.75 * (year == 0)), 0.0)), (w["identifier"], ident * np.clip(title / 0.5, 0, 1))]
    down = [(w["other_title"], 1 - sure), (w["other_people"], (people < 0) * 1.0), (w["sequel"], sequel), (w["other_year"], np.clip(-year, 0, 1)), (w["prior"], np.full(n, 0.6))]
    rules, ups, rho = len(up) + len(down) + 2, len(up), ADMM_STEP
    bodies = np.stack([b for _, b in up + down])
    caps = np.array([x for x, _ in up + down])[:, None] / rho
    place, y = np.arange(n), np.full(n, 0.5)
    copies, duals = np.tile(y, (rules, 1)), np.zeros((rules, n))
    which = same = None
    for step in range(ADMM_ROUNDS):
        if which is None:  # rows of one paper count once for exclusivity and pull each other for transitivity
            which = np.cumsum(np.r_[False, group[1:] != group[:-1]])
            order = np.lexsort((paper, which))
            new = np.r_[True, (which[order][1:] != which[order][:-1]) | (paper[order][1:] != paper[order][:-1])]
            same = np.empty(len(group), dtype=np.int64)
            same[order] = np.cumsum(new) - 1
            members = np.bincount(same)
            share = 1.0 / members[same]
            norm = np.bincount(which, share * share)
        v = y - duals
        k = len(bodies)
        copies[:ups] = v[:ups] + np.minimum(caps[:ups], np.maximum(0, bodies[:ups] - v[:ups]))
        copies[ups:k] = v[ups:k] - np.minimum(caps[ups:], np.maximum(0, bodies[ups:] + v[ups:k] - 1))
        excess = np.maximum(0, np.bincount(which, v[k] * share) - 1)  # exclusivity: sum of an entry's papers at most one
        copies[k] = v[k] - share * np.minimum(w["exclusive"] / rho, excess / norm)[which]
        mean = np.bincount(same, v[k + 1]) / members  # transitivity: rows of one paper alike
        copies[k + 1] = v[k + 1] + np.clip(mean[same] - v[k + 1], -w["transitive"] / rho, w["transitive"] / rho)
        last, y = y, np.clip((copies + duals).mean(axis=0), 0, 1)
        duals += copies - y
        if step % 20 == 19 or step == ADMM_ROUNDS - 1:
            off = np.maximum(np.abs(copies - y).max(axis=0), np.abs(y - last))
            worst = np.zeros(which[-1] + 1)
            np.maximum.at(worst, which, off)
            out[place] = y
            open_ = (worst > ADMM_RESIDUAL)[which]
            if not open_.any():
                break
            if not open_.all():
                place, group, paper, y = place[open_], group[open_], paper[open_], y[open_]
                copies, duals, bodies = copies[:, open_], duals[:, open_], bodies[:, open_]
                which = None
    return out


def matches(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """entries (entry_id, pub_id, title, authors, pub_year, arxiv_id, raw_content), candidates (ref_id, pub_id, title, authors array,
    submission_date, arxiv_id) -> (entry_id, ref_id, confidence) of all candidate pairs with some evidence.

    Null ids or publications match nothing. Missing titles and authors are read from raw_content; re-delivered rows count once. An entry with
    neither title, authors nor raw_content matches nothing. Empty tables give an empty result.
    """
    scratch = Scratch(entries.sparkSession, "linkage")
    own = entries.select(F.col("entry_id").cast("bigint").alias("entry_id"), "pub_id", "title", "authors", "pub_year", "arxiv_id", "raw_content").where("entry_id is not null and pub_id is not null").distinct()
    refs = candidates.select(F.col("ref_id").cast("bigint").alias("ref_id"), "pub_id", "title", "authors", "submission_date", "arxiv_id").where("ref_id is not null and pub_id is not null").distinct()
    phrases = learned_marks(refs.select("title").where("title is not null"))
    left = scratch.save(_prepared(own, _entry, phrases), "entries")
    right = scratch.save(_prepared(refs, _candidate, phrases), "candidates")

    (of_entries, some, strong), (of_candidates, *_) = _blocking_keys(left, "eid"), _blocking_keys(right, "rid")
    weigh = lambda keys, w: F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(w).alias("w")))
    a = of_entries.select("eid", F.explode(F.concat(weigh(some, 1), weigh(strong, LEAST_KEYS))).alias("x")).select("eid", "x.k", "x.w")
    b = of_candidates.select("rid", F.explode(F.concat(some, strong)).alias("k"))
    pairs = a.join(b, "k").groupBy("eid", "rid").agg(F.sum("w").alias("n")).where(F.col("n") >= LEAST_KEYS)
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in _OUT if c not in ("words", "pub")])
    full = pairs.join(side(right, "r_"), F.col("rid") == F.col("r_id")).join(side(left, "e_"), F.col("eid") == F.col("e_id"))
    names = ["letters", "marks", "names", "lead", "year", "identifier", "title_known"]
    paper = F.xxhash64("r_letters", "r_names", "r_marks").alias("paper")
    full = full.select("eid", "rid", *[f"e_{c}" for c in names], *[f"r_{c}" for c in names], paper)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cache: dict = {"papers": {}}
            kept, ev, last, e = [], [], None, None
            for i, row in enumerate(zip(*map(values, batch.columns[:16]))):
                if row[0] != last:
                    last, e = row[0], row[2:9]
                found = evidence(e, row[9:16], cache)
                if found:
                    kept.append(i)
                    ev.append(found)
            arr = np.array(ev, dtype=np.float64).reshape(-1, 5)
            rows = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(16), *(pa.array(arr[:, i]) for i in range(5))], ["eid", "rid", "paper", *_EV])

    scored = full.mapInArrow(score, "eid bigint, rid bigint, paper bigint, " + ", ".join(f"{c} double" for c in _EV))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last entry of a batch may go on in the next
        for batch in batches:
            block = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ids = block.column(0).to_numpy()
            if not len(ids):
                continue
            cut = int(np.searchsorted(ids, ids[-1]))
            held = block.slice(cut)
            if cut:
                yield _solved(block.slice(0, cut))
        if held is not None and held.num_rows:
            yield _solved(held)

    def _solved(block: pa.Table) -> pa.RecordBatch:
        y = solve(block.column(0).to_numpy(), block.column(2).to_numpy(), np.stack([block.column(c).to_numpy() for c in _EV], axis=1))
        return pa.RecordBatch.from_arrays([block.column(0).combine_chunks(), block.column(1).combine_chunks(), pa.array(y)], ["entry_id", "ref_id", "confidence"])

    return scored.repartition("eid").sortWithinPartitions("eid").mapInArrow(infer, "entry_id bigint, ref_id bigint, confidence double")


_EV = ["title", "people", "year", "sequel", "identifier"]


def linked(found: DataFrame, least: float | Column = LEAST_CONFIDENCE) -> DataFrame:
    return found.where(F.col("confidence") >= least)
