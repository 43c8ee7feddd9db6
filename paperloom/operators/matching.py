"""Bibliography entries against the candidate papers of their publication: pairs, features, ranking, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X

#: Titles whose lengths differ by more than this are not compared.
TITLE_BAND = 40
MAX_CANDIDATES = 50
FEATURES = "title_jaccard title_overlap title_edit_dist author_overlap first_author_match year_match year_diff arxiv_match arxiv_in_content num_matching_authors title_len_ratio combined_score".split()
#: Weights used before any training (fixed values, in the order of FEATURES).
DEFAULT_WEIGHTS = (0.3, 0.2, 0.15, 0.25, 0.1, 0.15, -0.05, 1.0, 0.8, 0.1, 0.05, 0.0)


def strip(c: Column) -> Column:
    """Without outer white space of any script."""
    return F.regexp_replace(c, r"^[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+$", "")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def entries_of(bib: DataFrame) -> DataFrame:
    """bib_entries -> pub_id, bib_key, title, authors array, year, arxiv_id, raw_content; nulls are ""; first entry of a key counts."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = F.filter(F.transform(F.split(t("authors"), r" and "), strip), lambda a: a != "")
    year = F.coalesce(F.nullif(t("pub_year"), F.lit("")), X.year_of(F.col("raw_content")), F.lit(""))
    # re-delivered rows differ in loaded_at only: distinct is a hash aggregate, cheaper than a window over whole rows
    own = bib.select("entry_id", "pub_id", "bib_key", t("title").alias("title"), names.alias("authors"), year.alias("year"), t("arxiv_id").alias("arxiv_id"), t("raw_content").alias("raw_content")).distinct()
    return keep_first(own, ["pub_id", "bib_key"], [F.col("entry_id")]).drop("entry_id")


def candidates_of(refs: DataFrame) -> DataFrame:
    """ref_entries -> pub_id, ref_id, ref_pos, arxiv_id, title, authors, year; the year is the start of the date."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    return refs.select("pub_id", "ref_id", "ref_pos", t("arxiv_id").alias("arxiv_id"), t("title").alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.substring(t("submission_date"), 1, 4).alias("year")).distinct()


def with_bib_side(entries: DataFrame) -> DataFrame:
    """Everything a comparison needs, computed once per entry and not once per pair."""
    title = X.clean_title(F.col("title"))
    return entries.select(
        "pub_id", "bib_key", title.alias("b_title"), X.tokens(title).alias("b_tokens"), X.surnames(F.col("authors")).alias("b_names"), F.col("year").alias("b_year"), F.replace("arxiv_id", F.lit("."), F.lit("-")).alias("b_arxiv"), F.col("raw_content").alias("b_raw"),
        F.length(strip(F.col("title"))).alias("b_len"), F.col("title").alias("b_written"), F.col("authors").alias("b_authors"), X.label_tokens(F.col("title")).alias("b_label"), X.label_surname(F.get("authors", F.lit(0))).alias("b_first"),
    )


def with_ref_side(candidates: DataFrame) -> DataFrame:
    title = X.clean_title(F.col("title"))
    return candidates.select(
        "pub_id", "ref_id", "ref_pos", title.alias("r_title"), X.tokens(title).alias("r_tokens"), X.surnames(F.col("authors")).alias("r_names"), F.col("year").alias("r_year"), F.replace("arxiv_id", F.lit("."), F.lit("-")).alias("r_arxiv"),
        F.length(strip(F.col("title"))).alias("r_len"), F.col("title").alias("r_written"), F.col("authors").alias("r_authors"), X.label_tokens(F.col("title")).alias("r_label"), X.label_surname(F.get("authors", F.lit(0))).alias("r_first"),
    )


def banded_pairs(bib_side: DataFrame, ref_side: DataFrame, band: int = TITLE_BAND) -> DataFrame:
    """Pairs of one publication whose title lengths differ by at most ``band``.

    The band is a join key: an entry looks into its length bucket and the two beside it, so a large publication is spread over its
    lengths instead of meeting in one task.
    """
    width = band + 1
    b = bib_side.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("b_len") / width) + d for d in (-1, 0, 1)])))
    r = ref_side.withColumn("bucket", F.floor(F.col("r_len") / width))
    return b.join(r, ["pub_id", "bucket"]).where(F.abs(F.col("b_len") - F.col("r_len")) <= band).drop("bucket")


#: Candidates of one publication that one key of the join of all pairs holds.
CANDIDATES_PER_KEY = 1000


def spread_pairs(bib_side: DataFrame, ref_side: DataFrame, refs: DataFrame) -> DataFrame:
    """All pairs of one publication. The candidates of a large publication are dealt into parts, each a key of its own that every one of its
    entries meets; publications of ordinary size have one. ``refs``: rows whose numbers per pub_id tell the sizes."""
    sizes = refs.groupBy("pub_id").agg(F.ceil(F.count("*") / CANDIDATES_PER_KEY).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    b = bib_side.join(sizes, "pub_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    r = ref_side.join(sizes, "pub_id", "left").withColumn("part", F.pmod(F.xxhash64("ref_id"), parts).cast("int")).drop("parts")
    return b.join(r, ["pub_id", "part"]).drop("part")


def refs_in_band(bib_side: DataFrame, ref_side: DataFrame, band: int = TITLE_BAND) -> DataFrame:
    """Candidates for which some entry of the publication lies in the band: distinct lengths per publication are compared, not entries."""
    lengths = bib_side.select("pub_id", F.explode(F.sequence(F.col("b_len") - band, F.col("b_len") + band)).alias("r_len")).distinct()
    return ref_side.join(lengths, ["pub_id", "r_len"], "left_semi")


def with_features(pairs: DataFrame) -> DataFrame:
    """The twelve similarity features of a pair, as named columns."""
    same = F.size(F.array_intersect("b_names", "r_names"))
    ratio = F.length("b_title") / F.length("r_title")
    diff = F.abs(F.expr("try_cast(b_year as int)") - F.expr("try_cast(r_year as int)"))
    known = (F.col("b_year") != "") & (F.col("r_year") != "")
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    out = pairs.withColumns({
        "title_jaccard": X.jaccard(F.col("b_tokens"), F.col("r_tokens")), "title_overlap": X.overlap(F.col("b_tokens"), F.col("r_tokens")), "title_edit_dist": X.edit_similarity(F.col("b_title"), F.col("r_title")),
        "author_overlap": X.overlap(F.col("b_names"), F.col("r_names")), "first_author_match": one((F.size("b_names") > 0) & (F.size("r_names") > 0) & (F.get("b_names", F.lit(0)) == F.get("r_names", F.lit(0)))),
        "year_match": one(known & (F.col("b_year") == F.col("r_year"))), "year_diff": F.when(known, F.coalesce(F.least(diff, F.lit(50)), F.lit(10))).otherwise(F.lit(10)).cast("double"),
        "arxiv_match": one((F.col("b_arxiv") != "") & (F.col("b_arxiv") == F.col("r_arxiv"))), "arxiv_in_content": one(F.contains(F.col("b_raw"), X.dotted(F.col("r_arxiv")))), "num_matching_authors": F.least(same, F.lit(20)).cast("double"),
        "title_len_ratio": F.when((F.length("b_title") > 0) & (F.length("r_title") > 0), F.least(ratio, F.length("r_title") / F.length("b_title"))).otherwise(F.lit(0.0)),
    })
    return out.withColumn("combined_score", 0.4 * F.col("title_jaccard") + 0.3 * F.col("author_overlap") + 0.2 * F.col("year_match") + 0.1 * F.col("first_author_match"))


def top_candidates(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best candidates of every entry with their rank; ties go by candidate position, then id."""
    order = Window.partitionBy("pub_id", "bib_key").orderBy(F.desc(score), "ref_pos", "ref_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probability(weights: tuple[float, ...] = DEFAULT_WEIGHTS, bias: float = 0.0) -> Column:
    """Logistic score of the features, its argument clipped to +-500."""
    z = F.lit(float(bias))
    for name, w in zip(FEATURES, weights):
        z = z + F.lit(float(w)) * F.col(name)
    return logistic(z)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def auto_label_arxiv(pairs: DataFrame) -> DataFrame:
    """Candidates whose id stands in the raw text, as written or dotted; confidence 1."""
    hit = (F.col("r_arxiv") != "") & (F.contains(F.col("b_raw"), F.col("r_arxiv")) | F.contains(F.col("b_raw"), X.dotted(F.col("r_arxiv"))))
    return pairs.where(hit).withColumns({"strategy": F.lit(1), "confidence": F.lit(1.0)})


def auto_label_title(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    sim = X.jaccard(F.col("b_label"), F.col("r_label"))
    return pairs.withColumns({"strategy": F.lit(2), "confidence": F.round(sim, 12)}).where(F.col("confidence") >= threshold)


def auto_label_author_year(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Equal first surnames, years at most one apart, similar titles; confidence 0.6 + 0.4 x similarity."""
    sim = F.round(X.jaccard(F.col("b_label"), F.col("r_label")), 12)
    near = F.abs(F.expr("try_cast(b_year as int)") - F.expr("try_cast(r_year as int)")) <= 1
    rows = pairs.where((F.size("b_authors") > 0) & (F.size("r_authors") > 0)).where((F.col("b_first") == F.col("r_first")) & near).withColumn("sim", sim)
    return rows.where(F.col("sim") >= threshold).withColumns({"strategy": F.lit(3), "confidence": F.round(0.6 + 0.4 * F.col("sim"), 12)}).drop("sim")


def auto_labels(pairs: DataFrame) -> DataFrame:
    """The ladder: the first strategy with any match counts, in it the most confident, first candidate on ties. One pass over the pairs: a pair
    stands for its own first strategy, which is all the ladder can ask of it."""
    sim = F.round(X.jaccard(F.col("b_label"), F.col("r_label")), 12)
    near = F.abs(F.expr("try_cast(b_year as int)") - F.expr("try_cast(r_year as int)")) <= 1
    hit = (F.col("r_arxiv") != "") & (F.contains(F.col("b_raw"), F.col("r_arxiv")) | F.contains(F.col("b_raw"), X.dotted(F.col("r_arxiv"))))
    like = (F.size("b_authors") > 0) & (F.size("r_authors") > 0) & near & (F.col("b_first") == F.col("r_first"))
    found = lambda n, c: F.array(F.struct(F.lit(n).alias("strategy"), c.alias("confidence")))
    by_title = lambda s: F.when(s >= 0.7, found(2, s)).when((s >= 0.3) & like, found(3, F.round(0.6 + 0.4 * s, 12)))
    best_of = F.when(hit, found(1, F.lit(1.0))).otherwise(F.get(F.transform(F.array(sim), by_title), F.lit(0)))
    # a generator, so that no filter repeats the comparison below it
    rows = pairs.select("pub_id", "bib_key", "ref_id", "ref_pos", "r_arxiv", F.explode_outer(best_of).alias("x")).select("pub_id", "bib_key", "ref_id", "ref_pos", "r_arxiv", "x.*").where("strategy is not null")
    order = F.struct(F.col("strategy"), -F.col("confidence"), F.col("ref_pos"), F.col("ref_id"))
    best = rows.groupBy("pub_id", "bib_key").agg(F.min_by(F.struct("ref_id", "ref_pos", "r_arxiv", "strategy", "confidence"), order).alias("s"))
    return best.select("pub_id", "bib_key", "s.*")
