"""Queries on candidate pairs, features, labels, ranking and evaluation, over bib_entries, ref_entries and publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators import matching as M
from paperloom.operators import metrics, model, pair_blocks
from paperloom.runtime import maybe_broadcast, table
from paperloom.sources import sinks
from paperloom.sources.publications import PREDICTION

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _only(rows: DataFrame, pubs: DataFrame | None) -> DataFrame:
    return rows if pubs is None else rows.join(pubs, "pub_id", "left_semi")


def _entries(spark: SparkSession, sf: str, pubs: DataFrame | None = None) -> DataFrame:
    return M.entries_of(_only(table(spark, sf, "bib_entries"), pubs))


def _bib(spark: SparkSession, sf: str, pubs: DataFrame | None = None) -> DataFrame:
    return M.with_bib_side(_entries(spark, sf, pubs))


def _ref(spark: SparkSession, sf: str, pubs: DataFrame | None = None) -> DataFrame:
    return M.with_ref_side(M.candidates_of(_only(table(spark, sf, "ref_entries"), pubs)))


def _sides(spark: SparkSession, sf: str, pubs: DataFrame | None = None) -> dict[str, DataFrame]:
    return {"bib_side": _bib(spark, sf, pubs), "ref_side": _ref(spark, sf, pubs), "counted": tuple(_only(table(spark, sf, t), pubs) for t in ("bib_entries", "ref_entries"))}


def _features(spark: SparkSession, sf: str, pubs: DataFrame | None = None, **options) -> DataFrame:
    return pair_blocks.feature_pairs(**_sides(spark, sf, pubs), **options)


def _all_features(spark: SparkSession, sf: str, truth: DataFrame | None = None, **options) -> DataFrame:
    """The features of _all_pairs."""
    sides = _sides(spark, sf, None if truth is None else truth.select("pub_id").distinct())
    sides["ref_side"] = M.refs_in_band(sides["bib_side"], sides["ref_side"])
    if truth is not None:
        sides["bib_side"] = sides["bib_side"].join(truth.select("pub_id", "bib_key").distinct(), ["pub_id", "bib_key"], "left_semi")
    return pair_blocks.feature_pairs(**sides, band=None, **options)


def _all_pairs(spark: SparkSession, sf: str, truth: DataFrame | None = None) -> DataFrame:
    """Every candidate of the publication that lies in some entry's band: what scoring ranks. With ``truth`` only its entries are paired,
    and only their publications read."""
    pubs = None if truth is None else truth.select("pub_id").distinct()
    bib = _bib(spark, sf, pubs)
    refs = M.refs_in_band(bib, _ref(spark, sf, pubs))
    asked = bib if truth is None else bib.join(truth.select("pub_id", "bib_key").distinct(), ["pub_id", "bib_key"], "left_semi")
    return M.spread_pairs(asked, refs, _only(table(spark, sf, "ref_entries"), pubs))


def _pairs_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entries, and the candidates some entry's band holds."""
    return _bib(spark, sf), M.refs_in_band(_bib(spark, sf), _ref(spark, sf))


_W = r"[^\p{L}\p{N}_]+"
_STOP = "['" + "','".join(M.X.STOP_WORDS) + "']"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g')"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c},'')), '\\[a-z]+\{{([^}}]*)\}}', '\1', 'g'), '\\[a-z]+', '', 'g'), '{_W}', ' ', 'g'))"


def _title(c: str) -> str:
    return f"regexp_replace({_clean(c)}, '^(?:on|the|an?) +', '')"


def _surname(c: str) -> str:
    return rf"regexp_extract(regexp_replace(regexp_replace(regexp_replace({_clean(c)}, ' ', '  ', 'g'), '(^| )(?:dr|prof|mr|mrs|ms|jr|sr|phd|md)( |$)', '\1\2', 'g'), ' +', ' ', 'g'), '([^ ]*) *$', 1)"


_YEAR = r"nullif(regexp_extract(coalesce(raw_content,''), '(?:^|[^\p{L}\p{N}_])((?:19|20)[0-9]{2})(?:$|[^\p{L}\p{N}_])', 1), '')"
_BASE = f"""
WITH bibs AS (
  SELECT pub_id, bib_key, coalesce(title,'') AS title, list_filter(list_transform(string_split(coalesce(authors,''), ' and '), lambda a: {_strip('a')}), lambda a: a <> '') AS authors,
         coalesce(nullif(pub_year,''), {_YEAR}, '') AS year, coalesce(arxiv_id,'') AS arxiv_id, coalesce(raw_content,'') AS raw_content
  FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY entry_id, loaded_at) AS n FROM bib_entries) x WHERE n = 1),
refs AS (
  SELECT DISTINCT pub_id, ref_id, ref_pos, coalesce(arxiv_id,'') AS arxiv_id, coalesce(title,'') AS title, coalesce(authors,[]) AS authors, substr(coalesce(submission_date,''),1,4) AS year FROM ref_entries),
bs AS (
  SELECT pub_id, bib_key, {_title('title')} AS b_title, list_transform(list_filter(authors[1:50], lambda a: coalesce(a,'') <> ''), lambda a: {_surname('a')}) AS b_names, year AS b_year,
         replace(arxiv_id,'.','-') AS b_arxiv, raw_content AS b_raw, length({_strip('title')}) AS b_len, title AS b_written, authors AS b_authors FROM bibs),
rs AS (
  SELECT pub_id, ref_id, ref_pos, {_title('title')} AS r_title, list_transform(list_filter(authors[1:50], lambda a: coalesce(a,'') <> ''), lambda a: {_surname('a')}) AS r_names, year AS r_year,
         replace(arxiv_id,'.','-') AS r_arxiv, length({_strip('title')}) AS r_len, title AS r_written, authors AS r_authors FROM refs),
bst AS (SELECT *, list_filter(string_split({_clean('b_title')}, ' '), lambda t: t <> '' AND NOT list_contains({_STOP}, t)) AS b_tokens FROM bs),
rst AS (SELECT *, list_filter(string_split({_clean('r_title')}, ' '), lambda t: t <> '' AND NOT list_contains({_STOP}, t)) AS r_tokens FROM rs),
pairs AS (SELECT b.*, r.* EXCLUDE (pub_id) FROM bst b JOIN rst r ON b.pub_id = r.pub_id AND abs(b_len - r_len) <= {M.TITLE_BAND}),
inband AS (SELECT * FROM rst r WHERE EXISTS (SELECT 1 FROM bst b WHERE b.pub_id = r.pub_id AND abs(b_len - r_len) <= {M.TITLE_BAND})),
every AS (SELECT b.*, r.* EXCLUDE (pub_id) FROM bst b JOIN inband r ON b.pub_id = r.pub_id)
"""


def _jac(a: str, b: str) -> str:
    inter = f"len(list_distinct(list_intersect({a},{b})))"
    return f"CASE WHEN len({a})>0 AND len({b})>0 THEN {inter}::DOUBLE/(len(list_distinct({a}))+len(list_distinct({b}))-{inter}) ELSE 0.0 END"


def _ovl(a: str, b: str) -> str:
    return f"CASE WHEN len({a})>0 AND len({b})>0 THEN len(list_distinct(list_intersect({a},{b})))::DOUBLE/least(len(list_distinct({a})),len(list_distinct({b}))) ELSE 0.0 END"


def _feat(name: str, source: str) -> str:
    return f""",
{name}_0 AS (SELECT *, {_jac('b_tokens', 'r_tokens')} AS title_jaccard, {_ovl('b_tokens', 'r_tokens')} AS title_overlap,
  CASE WHEN length(b_title)>0 AND length(r_title)>0 THEN 1-levenshtein(b_title,r_title)::DOUBLE/greatest(length(b_title),length(r_title)) ELSE 0.0 END AS title_edit_dist,
  {_ovl('b_names', 'r_names')} AS author_overlap, CASE WHEN len(b_names)>0 AND len(r_names)>0 AND b_names[1]=r_names[1] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS first_author_match,
  CASE WHEN b_year<>'' AND b_year=r_year THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS year_match,
  CASE WHEN b_year<>'' AND r_year<>'' THEN coalesce(least(abs(try_cast(b_year AS INT)-try_cast(r_year AS INT)),50),10) ELSE 10 END::DOUBLE AS year_diff,
  CASE WHEN b_arxiv<>'' AND b_arxiv=r_arxiv THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS arxiv_match, CASE WHEN contains(b_raw, replace(r_arxiv,'-','.')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS arxiv_in_content,
  least(len(list_distinct(list_intersect(b_names,r_names))),20)::DOUBLE AS num_matching_authors,
  CASE WHEN length(b_title)>0 AND length(r_title)>0 THEN least(length(b_title)::DOUBLE/length(r_title), length(r_title)::DOUBLE/length(b_title)) ELSE 0.0 END AS title_len_ratio FROM {source}),
{name} AS (SELECT *, 0.4::DOUBLE*title_jaccard+0.3::DOUBLE*author_overlap+0.2::DOUBLE*year_match+0.1::DOUBLE*first_author_match AS combined_score FROM {name}_0)
"""


_FEATS = _BASE + _feat("feats", "pairs")
_SCORES = "1/(1+exp(-greatest(least(0.0::DOUBLE" + "".join(f"+({w})::DOUBLE*{f}" for f, w in zip(M.FEATURES, M.DEFAULT_WEIGHTS)) + ",500),-500)))"
_RANKED = _BASE + _feat("fall", "every") + f", scored AS (SELECT *, {_SCORES} AS probability FROM fall), ranked AS (SELECT *, row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY round(probability,9) DESC, ref_pos, ref_id) AS rank FROM scored)"
_PROXY = "CASE WHEN arxiv_match=1 OR arxiv_in_content=1 OR round(combined_score,9) > {} THEN 1 ELSE 0 END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_BASE + "SELECT pub_id, bib_key, title, array_to_string(authors,';') AS authors, year FROM bibs")
def bib_dedup_keep_first(spark, sf):
    return _entries(spark, sf).select("pub_id", "bib_key", "title", F.array_join("authors", ";").alias("authors"), "year")


@query(_BASE + "SELECT pub_id, ref_id, r_len FROM inband")
def refs_length_semi(spark, sf):
    return M.refs_in_band(_bib(spark, sf), _ref(spark, sf)).select("pub_id", "ref_id", "r_len")


@query(_BASE + "SELECT pub_id, bib_key, ref_id FROM pairs")
def candidate_pairs(spark, sf):
    return M.banded_pairs(_bib(spark, sf), _ref(spark, sf)).select("pub_id", "bib_key", "ref_id")


_ROUNDED = ", ".join(f"round({f},6) AS {f}" for f in M.FEATURES)


@query(_FEATS + f"SELECT pub_id, bib_key, ref_id, {_ROUNDED} FROM feats")
def features_all(spark, sf):
    return _features(spark, sf, digits=6).select("pub_id", "bib_key", "ref_id", *M.FEATURES)


#: The best candidates by the combined score alone.
_BEST50 = (M.MAX_CANDIDATES, tuple(float(f == "combined_score") for f in M.FEATURES), False)


@query(_FEATS + "SELECT pub_id, bib_key, ref_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY round(combined_score,9) DESC, ref_pos, ref_id) AS rank FROM feats) WHERE rank <= 50")
def candidate_top50(spark, sf):
    return _features(spark, sf, features=[], best=_BEST50).select("pub_id", "bib_key", "ref_id", F.col("rank").cast("bigint").alias("rank"))


def _ranked(spark, sf, k: int = 5, truth: DataFrame | None = None) -> DataFrame:
    scored = _all_features(spark, sf, truth, features=[], weights=M.DEFAULT_WEIGHTS, best=(k, M.DEFAULT_WEIGHTS, True)).withColumn("probability", M.logistic(F.col("z"))).withColumn("s", F.round("probability", 9))
    return M.top_candidates(scored, "s", k)


@query(_BASE + _feat("fall", "every") + f"SELECT pub_id, bib_key, ref_id, round({_SCORES},6) AS probability, CASE WHEN round({_SCORES},9) >= 0.5 THEN 1 ELSE 0 END AS predicted FROM fall")
def score_default_weights(spark, sf):
    scored = _all_features(spark, sf, features=[], weights=M.DEFAULT_WEIGHTS).withColumn("p", M.logistic(F.col("z")))
    return scored.select("pub_id", "bib_key", "ref_id", F.round("p", 6).alias("probability"), (F.round("p", 9) >= 0.5).cast("int").alias("predicted"))


@query(_RANKED + "SELECT pub_id, bib_key, ref_id, rank, round(probability,6) AS probability FROM ranked WHERE rank <= 5")
def rank_top5(spark, sf):
    return _ranked(spark, sf).select("pub_id", "bib_key", "ref_id", F.col("rank").cast("bigint").alias("rank"), F.round("probability", 6).alias("probability"))


# Labels. The hand-checked pairs are the truth; publications give the partition.
_LABELS = ", truth AS (SELECT DISTINCT pub_id, bib_key, arxiv_id FROM labeled_pairs WHERE is_match), parts AS (SELECT pub_id, coalesce(split_name,'train') AS part FROM publications)"


def _truth(spark, sf) -> DataFrame:
    return table(spark, sf, "labeled_pairs").where("is_match").select("pub_id", "bib_key", F.col("arxiv_id").alias("true_id")).distinct()


def _parts(spark, sf) -> DataFrame:
    return table(spark, sf, "publications").select("pub_id", F.coalesce("split_name", F.lit("train")).alias("part"))


def _truth_ranks(spark, sf) -> DataFrame:
    truth = _truth(spark, sf)
    ranked = _ranked(spark, sf, truth=truth).select("pub_id", "bib_key", "r_arxiv", "rank")
    best = ranked.join(truth, ["pub_id", "bib_key"]).where(F.col("r_arxiv") == F.col("true_id")).groupBy("pub_id", "bib_key").agg(F.min("rank").alias("rank"))
    return truth.select("pub_id", "bib_key").distinct().join(best, ["pub_id", "bib_key"], "left")


_TRUTH_RANKS = _RANKED + _LABELS + ", q AS (SELECT t.pub_id, t.bib_key, min(r.rank) AS rank FROM truth t LEFT JOIN ranked r ON r.pub_id=t.pub_id AND r.bib_key=t.bib_key AND r.r_arxiv=t.arxiv_id AND r.rank<=5 GROUP BY 1,2)"
_METRICS = "count(*) AS n_queries, round(avg(coalesce(1.0::DOUBLE/rank,0)),6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN rank<={k} THEN 1.0::DOUBLE ELSE 0 END),6) AS p_at_{k}" for k in (1, 3, 5))


@query(_TRUTH_RANKS + f"SELECT {_METRICS} FROM q")
def mrr_at_5(spark, sf):
    return metrics.ranking_metrics(_truth_ranks(spark, sf))


@query(_TRUTH_RANKS + f"SELECT pub_id, {_METRICS} FROM q GROUP BY pub_id")
def metrics_per_pub(spark, sf):
    return metrics.ranking_metrics(_truth_ranks(spark, sf), ["pub_id"])


@query(_TRUTH_RANKS + f"SELECT coalesce(p.part,'train') AS part, {_METRICS} FROM q LEFT JOIN parts p ON p.pub_id=q.pub_id GROUP BY 1")
def metrics_per_partition(spark, sf):
    ranks = _truth_ranks(spark, sf).join(_parts(spark, sf), "pub_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))
    return metrics.ranking_metrics(ranks, ["part"])


_ARXIV = "r_arxiv<>'' AND (contains(b_raw,r_arxiv) OR contains(b_raw,replace(r_arxiv,'-','.')))"
_LT = lambda c: rf"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '{_W}', ' ', 'g'), ' '), lambda t: t <> ''))"
_LS = lambda c: f"lower(regexp_extract(trim({c}[1]), '([^ ]*)$', 1))"
_AUTO = _BASE + f""", lab AS (SELECT *, round({_jac('bt', 'rt')},12) AS sim FROM (SELECT *, {_LT('b_written')} AS bt, {_LT('r_written')} AS rt FROM every) z),
l1 AS (SELECT *, 1 AS strategy, 1.0::DOUBLE AS confidence FROM lab WHERE {_ARXIV}),
l2 AS (SELECT *, 2 AS strategy, sim AS confidence FROM lab WHERE sim >= 0.7),
l3 AS (SELECT *, 3 AS strategy, round(0.6::DOUBLE+0.4::DOUBLE*sim,12) AS confidence FROM lab WHERE len(b_authors)>0 AND len(r_authors)>0 AND {_LS('b_authors')}={_LS('r_authors')} AND abs(try_cast(b_year AS INT)-try_cast(r_year AS INT))<=1 AND sim >= 0.3),
ladder AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY strategy, confidence DESC, ref_pos, ref_id) AS n FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)) WHERE n=1)
"""


@query(_AUTO + "SELECT pub_id, bib_key, ref_id, confidence FROM l1")
def autolabel_arxiv(spark, sf):
    return M.auto_label_arxiv(_all_pairs(spark, sf)).select("pub_id", "bib_key", "ref_id", "confidence")


@query(_BASE + ", ids AS (SELECT pub_id, min(r_arxiv) AS one FROM every WHERE r_arxiv <> '' GROUP BY 1) SELECT e.pub_id, bib_key, ref_id, 1.0::DOUBLE AS confidence FROM every e JOIN ids i ON i.pub_id = e.pub_id WHERE r_arxiv = one OR r_arxiv <> '' AND (contains(b_raw, r_arxiv) OR contains(b_raw, replace(r_arxiv, '-', '.')))")
def autolabel_arxiv_rt(spark, sf):
    """As autolabel_arxiv, over raw texts that also cite their publication's least id, some as written and some dotted."""
    pairs = _all_pairs(spark, sf)
    one = pairs.where("r_arxiv <> ''").groupBy("pub_id").agg(F.min("r_arxiv").alias("one"))
    dotted = F.ascii(F.substring(F.md5("bib_key"), 1, 1)) % 2 == 0
    cited = pairs.join(one, "pub_id").withColumn("b_raw", F.concat("b_raw", F.lit(" arXiv:"), F.when(dotted, M.X.dotted(F.col("one"))).otherwise(F.col("one"))))
    return M.auto_label_arxiv(cited).select("pub_id", "bib_key", "ref_id", "confidence")


@query(_AUTO + "SELECT pub_id, bib_key, ref_id, round(confidence,6) AS confidence FROM l2")
def autolabel_title(spark, sf):
    return M.auto_label_title(_all_pairs(spark, sf)).select("pub_id", "bib_key", "ref_id", F.round("confidence", 6).alias("confidence"))


@query(_AUTO + "SELECT pub_id, bib_key, ref_id, round(confidence,6) AS confidence FROM l3")
def autolabel_author_year(spark, sf):
    return M.auto_label_author_year(_all_pairs(spark, sf)).select("pub_id", "bib_key", "ref_id", F.round("confidence", 6).alias("confidence"))


@query(_AUTO + "SELECT pub_id, bib_key, ref_id, strategy, round(confidence,6) AS confidence FROM ladder")
def autolabel_ladder(spark, sf):
    return M.auto_labels(_all_pairs(spark, sf)).select("pub_id", "bib_key", "ref_id", "strategy", F.round("confidence", 6).alias("confidence"))


@query(_AUTO + ", pubs AS (SELECT DISTINCT pub_id FROM ladder) SELECT pub_id, CASE row_number() OVER (ORDER BY pub_id) WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS part FROM pubs")
def partition_assign(spark, sf):
    """First labelled publication to test, second to valid, the rest to train: only the two smallest ids are found globally."""
    pubs = M.auto_labels(_all_pairs(spark, sf)).select("pub_id").distinct()
    first = pubs.orderBy("pub_id").limit(2).agg(F.sort_array(F.collect_list("pub_id")).alias("ids"))
    return pubs.crossJoin(F.broadcast(first)).select("pub_id", F.when(F.col("pub_id") == F.get("ids", F.lit(0)), "test").when(F.col("pub_id") == F.get("ids", F.lit(1)), "valid").otherwise("train").alias("part"))  # one row of two ids


@query(_AUTO + ", pubs AS (SELECT DISTINCT pub_id FROM ladder WHERE ascii(substr(md5(pub_id),1,1)) % 3 > 0) SELECT p.pub_id FROM (SELECT DISTINCT pub_id FROM bibs) p WHERE p.pub_id NOT IN (SELECT pub_id FROM pubs)")
def quarantine_anti(spark, sf):
    """Publications without any label, those of a third of the publications having been taken away."""
    labelled = M.auto_labels(_all_pairs(spark, sf)).select("pub_id").distinct().where(F.ascii(F.substring(F.md5("pub_id"), 1, 1)) % 3 > 0)
    return _entries(spark, sf).select("pub_id").distinct().join(labelled, "pub_id", "left_anti")


@query(_AUTO + ", other AS (SELECT DISTINCT pub_id FROM bibs WHERE pub_id NOT IN (SELECT pub_id FROM labeled_pairs)) SELECT count(DISTINCT b.pub_id) AS n_pubs, count(DISTINCT l.pub_id) AS n_labelled, round(100.0::DOUBLE*count(DISTINCT l.pub_id)/count(DISTINCT b.pub_id),6) AS coverage FROM other b LEFT JOIN ladder l ON l.pub_id=b.pub_id")
def coverage_stats(spark, sf):
    """Share of the publications without hand-made labels that got an automatic one."""
    labelled = M.auto_labels(_all_pairs(spark, sf)).select("pub_id", F.lit(1).alias("hit")).distinct()
    others = _entries(spark, sf).select("pub_id").distinct().join(table(spark, sf, "labeled_pairs").select("pub_id").distinct(), "pub_id", "left_anti")
    pubs = others.join(labelled, "pub_id", "left")
    return pubs.agg(F.count("*").alias("n_pubs"), F.count("hit").alias("n_labelled")).withColumn("coverage", F.round(100.0 * F.col("n_labelled") / F.col("n_pubs"), 6))


@query(f"WITH t AS (SELECT DISTINCT pub_id, bib_key, arxiv_id FROM labeled_pairs WHERE is_match), r AS (SELECT DISTINCT pub_id, replace(coalesce(arxiv_id,''),'.','-') AS a FROM ref_entries) SELECT t.pub_id, t.bib_key, t.arxiv_id, (r.a IS NOT NULL) AS valid FROM t LEFT JOIN r ON r.pub_id=t.pub_id AND r.a=t.arxiv_id")
def label_validate(spark, sf):
    known = _ref(spark, sf).select("pub_id", F.col("r_arxiv").alias("arxiv_id"), F.lit(True).alias("hit")).distinct()
    return _truth(spark, sf).withColumnRenamed("true_id", "arxiv_id").join(known, ["pub_id", "arxiv_id"], "left").select("pub_id", "bib_key", "arxiv_id", F.coalesce("hit", F.lit(False)).alias("valid"))


def _pubs_of(spark, sf, part: str) -> DataFrame:
    """Publications with entries that have rows of a part; those not listed train."""
    own = _parts(spark, sf).groupBy("pub_id").agg(F.max((F.col("part") == part).cast("int")).alias("own"))
    if part != "train":
        return own.where("own = 1").select("pub_id")
    return table(spark, sf, "bib_entries").select("pub_id").distinct().join(own.where("own = 0"), "pub_id", "left_anti")


_WEAK = ["arxiv_match", "arxiv_in_content", "combined_score"]


def _pair_labels(spark, sf, part: str | None = None, features: list[str] = M.FEATURES, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Truth where the entry is labelled, weak evidence elsewhere; only the best 50 candidates of an entry count. With ``part`` only the pairs of
    its publications are made."""
    top = _features(spark, sf, None if part is None else _pubs_of(spark, sf, part), features=features, weights=weights, best=_BEST50)
    truth = maybe_broadcast(M.keep_first(_truth(spark, sf), ["pub_id", "bib_key"], [F.col("true_id")]))
    weak = (F.col("arxiv_match") == 1) | (F.col("arxiv_in_content") == 1) | (F.round("combined_score", 9) > 0.8)
    label = F.when(F.col("true_id").isNotNull(), F.col("true_id") == F.col("r_arxiv")).otherwise(weak)
    rows = top.join(truth, ["pub_id", "bib_key"], "left").withColumn("label", label.cast("int")).join(maybe_broadcast(_parts(spark, sf)), "pub_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))
    return rows if part is None else rows.where(F.col("part") == part)


_PAIR_LABELS = _FEATS + f""", top50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY round(combined_score,9) DESC, ref_pos, ref_id) AS rank FROM feats) WHERE rank<=50){_LABELS},
one AS (SELECT pub_id, bib_key, min(arxiv_id) AS true_id FROM truth GROUP BY 1,2),
labelled AS (SELECT t.*, coalesce(p.part,'train') AS part, CASE WHEN o.true_id IS NOT NULL THEN CASE WHEN o.true_id=t.r_arxiv THEN 1 ELSE 0 END ELSE {_PROXY.format(0.8)} END AS label
  FROM top50 t LEFT JOIN one o ON o.pub_id=t.pub_id AND o.bib_key=t.bib_key LEFT JOIN parts p ON p.pub_id=t.pub_id)"""


@query(_PAIR_LABELS + " SELECT pub_id, bib_key, ref_id, label, part FROM labelled")
def pair_labels(spark, sf):
    return _pair_labels(spark, sf, features=_WEAK).select("pub_id", "bib_key", "ref_id", "label", "part")


@query(_FEATS + f"SELECT pub_id, bib_key, ref_id, {_PROXY.format(0.7)} AS label FROM feats")
def proxy_labels(spark, sf):
    weak = (F.col("arxiv_match") == 1) | (F.col("arxiv_in_content") == 1) | (F.round("combined_score", 9) > 0.7)
    return _features(spark, sf, features=_WEAK).select("pub_id", "bib_key", "ref_id", weak.cast("int").alias("label"))


@query(_PAIR_LABELS + " SELECT part, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(label),6) AS share FROM labelled GROUP BY part")
def class_counts(spark, sf):
    return _pair_labels(spark, sf, features=_WEAK).groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("share"))


_PRED = _PAIR_LABELS + f", pred AS (SELECT label, {_SCORES} AS p, CASE WHEN round({_SCORES},9)>=0.5 THEN 1 ELSE 0 END AS predicted, part FROM labelled)"


@query(_PRED + """, c AS (SELECT count(*) FILTER (label=1 AND predicted=1) AS tp, count(*) FILTER (label=0 AND predicted=1) AS fp, count(*) FILTER (label=1 AND predicted=0) AS fn, count(*) FILTER (label=predicted) AS ok, count(*) AS n FROM pred WHERE part='valid'),
d AS (SELECT *, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END AS pr, CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END AS re FROM c)
SELECT tp, fp, fn, round(CASE WHEN n>0 THEN ok::DOUBLE/n ELSE 0 END,6) AS accuracy, round(pr,6) AS precision, round(re,6) AS recall, round(CASE WHEN pr+re>0 THEN 2*pr*re/(pr+re) ELSE 0 END,6) AS f1 FROM d""")
def classification_metrics(spark, sf):
    scored = _pair_labels(spark, sf, "valid", _WEAK, M.DEFAULT_WEIGHTS).withColumn("p", M.logistic(F.col("z"))).withColumn("predicted", (F.round("p", 9) >= 0.5).cast("int"))
    return metrics.classification_metrics(scored, "label", "predicted")


@query(_PRED + " SELECT round(-avg(label*ln(p+1e-10)+(1-label)*ln(1-p+1e-10)),6) AS loss FROM pred")
def bce_loss(spark, sf):
    return _pair_labels(spark, sf, None, _WEAK, M.DEFAULT_WEIGHTS).withColumn("p", M.logistic(F.col("z"))).agg(F.round(metrics.log_loss(F.col("label"), F.col("p")), 6).alias("loss"))


_UNPIVOT = ", long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, {_PROXY.format(0.7)} AS label FROM feats" for f in M.FEATURES) + ")"


def _moments(spark, sf) -> DataFrame:
    return pair_blocks.pair_moments(**_sides(spark, sf), threshold=0.7)


@query(_FEATS + _UNPIVOT + " SELECT feature, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, round(min(value),6) AS min, round(max(value),6) AS max FROM long GROUP BY feature")
def feature_stats(spark, sf):
    return metrics.feature_statistics(_moments(spark, sf), M.FEATURES)


@query(_FEATS + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a},{b}),6) AS corr FROM feats" for a in M.FEATURES for b in M.FEATURES))
def feature_corr_matrix(spark, sf):
    return metrics.correlations(_moments(spark, sf), M.FEATURES)


@query(_FEATS + _UNPIVOT + " SELECT feature, round(coalesce(corr(value,label),0),6) AS corr FROM long GROUP BY feature")
def feature_label_corr(spark, sf):
    return metrics.label_correlations(_moments(spark, sf), M.FEATURES, "label")


@query(_FEATS + _UNPIVOT + """, span AS (SELECT feature, label, min(value) AS lo, max(value) AS hi, count(*) AS total FROM long GROUP BY 1,2),
b AS (SELECT l.feature, l.label, lo, hi, total, CASE WHEN hi>lo THEN least(floor((value-lo)/(hi-lo)*30),29)+1 ELSE 1 END::INT AS bucket FROM long l JOIN span s ON s.feature=l.feature AND s.label=l.label)
SELECT feature, label, bucket, count(*) AS n, round(count(*)/(any_value(total)*CASE WHEN any_value(hi)>any_value(lo) THEN (any_value(hi)-any_value(lo))/30 ELSE 1.0::DOUBLE/30 END),6) AS density FROM b GROUP BY feature, label, bucket""")
def feature_histogram(spark, sf):
    return metrics.histograms(pair_blocks.pair_values(**_sides(spark, sf), threshold=0.7), "label")


@query(_BASE + """, f AS (SELECT pub_id, count(*) AS n FROM inband GROUP BY 1), a AS (SELECT pub_id, count(*) AS n FROM refs GROUP BY 1)
SELECT sum(a.n)::BIGINT AS before, coalesce(sum(f.n),0)::BIGINT AS after, round(100.0::DOUBLE*(sum(a.n)-coalesce(sum(f.n),0))/greatest(sum(a.n),1),6) AS removed FROM a LEFT JOIN f ON f.pub_id=a.pub_id""")
def filter_reduction_stats(spark, sf):
    before = _ref(spark, sf).agg(F.count("*").alias("before"))
    after = M.refs_in_band(_bib(spark, sf), _ref(spark, sf)).agg(F.count("*").alias("after"))
    return before.crossJoin(after).withColumn("removed", F.round(100.0 * (F.col("before") - F.col("after")) / F.greatest("before", F.lit(1)), 6))  # one row each


@query(_BASE + """, p AS (SELECT pub_id FROM publications UNION SELECT pub_id FROM bibs UNION SELECT pub_id FROM refs), b AS (SELECT pub_id, count(*) AS n FROM bibs GROUP BY 1), r AS (SELECT pub_id, count(*) AS n FROM refs GROUP BY 1)
SELECT p.pub_id, coalesce(b.n,0) AS n_bibs, coalesce(r.n,0) AS n_refs, CASE WHEN r.n IS NULL THEN 'no_refs_file' WHEN b.n IS NULL THEN 'no_bibs' END AS skip_reason FROM p LEFT JOIN b ON b.pub_id=p.pub_id LEFT JOIN r ON r.pub_id=p.pub_id""")
def skip_reasons(spark, sf):
    b, r = _entries(spark, sf).groupBy("pub_id").agg(F.count("*").alias("b")), _ref(spark, sf).groupBy("pub_id").agg(F.count("*").alias("r"))
    pubs = table(spark, sf, "publications").select("pub_id").union(b.select("pub_id")).union(r.select("pub_id")).distinct()
    reason = F.when(F.col("r").isNull(), "no_refs_file").when(F.col("b").isNull(), "no_bibs")
    return pubs.join(b, "pub_id", "left").join(r, "pub_id", "left").select("pub_id", F.coalesce("b", F.lit(0)).alias("n_bibs"), F.coalesce("r", F.lit(0)).alias("n_refs"), reason.alias("skip_reason"))


@query(_BASE + """, b AS (SELECT pub_id, count(*) AS n FROM bibs GROUP BY 1), r AS (SELECT pub_id, count(*) AS n FROM refs GROUP BY 1)
SELECT (SELECT sum(n) FROM b)::BIGINT AS n_bibs, (SELECT sum(n) FROM r)::BIGINT AS n_refs, (SELECT round(avg(n),6) FROM b) AS bibs_per_pub, (SELECT round(avg(n),6) FROM r) AS refs_per_pub""")
def corpus_totals(spark, sf):
    one = lambda df, n: df.groupBy("pub_id").count().agg(F.sum("count").alias(f"n_{n}"), F.round(F.avg("count"), 6).alias(f"{n}_per_pub"))
    return one(_entries(spark, sf), "bibs").crossJoin(one(_ref(spark, sf), "refs"))  # one row each


@query("WITH t AS (SELECT DISTINCT pub_id, bib_key, arxiv_id FROM labeled_pairs WHERE is_match), c AS (SELECT pub_id, count(*) AS n FROM t GROUP BY 1) SELECT sum(n)::BIGINT AS n_labels, count(*) AS n_pubs, round(avg(n),6) AS labels_per_pub FROM c")
def label_stats(spark, sf):
    return _truth(spark, sf).groupBy("pub_id").count().agg(F.sum("count").alias("n_labels"), F.count("*").alias("n_pubs"), F.round(F.avg("count"), 6).alias("labels_per_pub"))


@query("SELECT coalesce(split_name,'train') AS part, count(*) AS n FROM publications GROUP BY 1")
def partition_counts(spark, sf):
    return _parts(spark, sf).groupBy("part").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT DISTINCT pub_id FROM labeled_pairs), o AS (SELECT p.pub_id FROM publications p WHERE p.pub_id NOT IN (SELECT pub_id FROM m) ORDER BY md5(p.pub_id || '42'), p.pub_id LIMIT 20) SELECT pub_id, true AS manual FROM m UNION ALL SELECT pub_id, false AS manual FROM o")
def sample_pubs(spark, sf, n: int = 20, seed: int = 42):
    """All hand-labelled publications and a fixed sample of the others, by hash order."""
    manual = table(spark, sf, "labeled_pairs").select("pub_id").distinct()
    others = table(spark, sf, "publications").select("pub_id").join(manual, "pub_id", "left_anti")
    picked = others.orderBy(F.md5(F.concat("pub_id", F.lit(str(seed)))), "pub_id").limit(n)
    return manual.select("pub_id", F.lit(True).alias("manual")).unionByName(picked.select("pub_id", F.lit(False).alias("manual")))


@query(_RANKED + _LABELS + """, p AS (SELECT t.pub_id, t.bib_key, min(t.arxiv_id) AS true_id, string_agg(DISTINCT lpad(r.rank::VARCHAR,2,'0') || r.r_arxiv, ',' ORDER BY lpad(r.rank::VARCHAR,2,'0') || r.r_arxiv) AS top5 FROM truth t LEFT JOIN ranked r ON r.pub_id=t.pub_id AND r.bib_key=t.bib_key AND r.rank<=5 GROUP BY 1,2)
SELECT p.pub_id, coalesce(q.part,'train') AS part, p.bib_key, true_id, coalesce(top5,'') AS top5 FROM p LEFT JOIN parts q ON q.pub_id=p.pub_id""")
def pred_export(spark, sf):
    """Per labelled entry its truth and ranked predictions; entries without candidates have an empty list."""
    truth = M.keep_first(_truth(spark, sf), ["pub_id", "bib_key"], [F.col("true_id")])
    ranked = _ranked(spark, sf, truth=truth).groupBy("pub_id", "bib_key").agg(F.sort_array(F.collect_set(F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), F.col("r_arxiv")))).alias("ranked"))
    rows = truth.join(ranked, ["pub_id", "bib_key"], "left").join(_parts(spark, sf), "pub_id", "left")
    files = sinks.predictions_json(rows.select("pub_id", F.coalesce("part", F.lit("train")).alias("partition"), F.lit("manual").alias("label_source"), "bib_key", "true_id", "ranked"))
    back = files.select("pub_id", F.from_json("json", PREDICTION).alias("p"))
    out = back.select("pub_id", F.col("p.partition").alias("part"), "p.prediction", F.explode("p.groundtruth").alias("bib_key", "true_id"))
    return out.select("pub_id", "part", "bib_key", "true_id", F.array_join(F.element_at("prediction", F.col("bib_key")), ",").alias("top5"))


@query()
def train_lr(spark, sf):
    weights, bias = model.train(_pair_labels(spark, sf, "train"))
    rows = [(f, float(w)) for f, w in zip([*M.FEATURES, "bias"], [*weights, bias])]
    return spark.createDataFrame(rows, "feature string, weight double")


@query()
def feature_importance(spark, sf):
    weights, _ = model.train(_pair_labels(spark, sf, "train"))
    return spark.createDataFrame(model.importance(weights), "feature string, importance double")


@query()
def evaluate_trained(spark, sf):
    """Train on the train partition, classify the valid partition."""
    weights, bias = model.train(_pair_labels(spark, sf, "train"))
    return metrics.classification_metrics(model.predict(_pair_labels(spark, sf, "valid"), weights, bias), "label", "predicted")
