import pytest
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [(None, ""), ("", ""), (r"\emph{Ab} \LaTeX C-d", "ab c d"), ("a\u00a0 b", "a b"), ("na\u00efve_x", "na\u00efve_x")])
def test_clean_text(spark, text, want):
    assert one(spark, text, X.clean_text) == want


@pytest.mark.parametrize("text,want", [("On the Road", "the road"), ("The A Team", "a team"), ("Another", "another")])
def test_clean_title(spark, text, want):
    assert one(spark, text, X.clean_title) == want


@pytest.mark.parametrize("text,want", [("Dr. Jane Doe Jr.", "doe"), ("Doe, Jane", "jane"), (None, ""), ("PhD", "")])
def test_surname(spark, text, want):
    assert one(spark, text, X.surname) == want


def test_years_and_ids(spark):
    assert one(spark, "arXiv:1911.11034 of 2019", X.year_of) == "1911"
    assert one(spark, "x2019y 20195", X.year_of) is None
    assert one(spark, "see arXiv: 1911.11034", X.arxiv_of) == "1911-11034"
    assert one(spark, "math-0610595", X.arxiv_of) is None
    assert one(spark, "doi 10.1234/ab.c., x", X.doi_of) == "10.1234/ab.c"


def test_reference_hash_collapses_before_deleting(spark):
    assert one(spark, "a - b", X.reference_hash) != one(spark, "a b", X.reference_hash)
    assert one(spark, "A  b.", X.reference_hash) == one(spark, "a b", X.reference_hash)


def test_similarities_are_bounded_and_symmetric(spark):
    rows = [(["a", "b"], ["b", "c", "c"]), ([], ["a"]), (["a"], ["a"]), ([], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    for r in df.select(X.jaccard(a, b).alias("j"), X.jaccard(b, a).alias("k"), X.overlap(a, b).alias("o"), X.overlap(b, a).alias("p")).collect():
        assert r["j"] == r["k"] and r["o"] == r["p"] and 0 <= r["j"] <= r["o"] <= 1


def test_standardizer(spark):
    assert one(spark, "%gone\na % b\nc \\% d", L.remove_comments) == "\na \nc \\% d"
    assert one(spark, r"\begin{figure}[htbp]\centering x\\[2pt]", L.remove_formatting) == r"\begin{figure}[htbp] x"
    assert one(spark, r"\textbf{a} {\it b} \large c", L.remove_formatting) == "a b  c"
    assert one(spark, r"\(x\) and \[ y \]", L.normalize_math) == "$x$ and \\begin{equation}\ny\n\\end{equation}"
    text = "\\section{A}\n\ntext \\cite{k}"
    assert one(spark, text, L.standardize) == one(spark, one(spark, text, L.standardize), L.standardize)


def test_nested_braces_end_at_the_first(spark):
    assert one(spark, r"\title{A \textbf{B} C}", L.title_of) == r"A \textbf{B"


def test_sections_and_sentences(spark):
    s = one(spark, r"x \section{One} a \subsection*{Two} b", L.sections_of)
    assert [(r["type"], r["level"], r["title"], r["body"]) for r in s] == [("section", 1, "One", " a "), ("subsection", 2, "Two", " b")]
    assert one(spark, "no heading", L.sections_of) == []
    many = " ".join(f"Formula ${i}.x$ is given here." for i in range(13))
    out = one(spark, many, L.sentences_of)
    assert len(out) == 13 and out[11] == "Formula $11.x$ is given here."
    assert one(spark, "See FIG. 3 and i.e. 2.5. No", L.sentences_of) == ["See Fig. 3 and i.e. 2.5."]
    assert one(spark, "short", L.sentences_of) == []


def test_bibitems(spark):
    text = r"\bibitem[L]{ k1 } A. Body. Title one. 2001 \bibitem{k2} B \end{thebibliography} after"
    assert [(b["label"], b["key"], b["body"]) for b in one(spark, text, L.bibitems_of)] == [("L", "k1", "A. Body. Title one. 2001"), ("", "k2", "B")]
    b = one(spark, "J. Smith. Deep nets. Phys. Rev. D 12:100-110 (2010), thesis", lambda t: L.bibtex_of(F.lit("k"), t))
    assert (b["title"], b["volume"], b["pages"], b["year"], b["type"]) == ("Smith", "12", "100-110", "2010", "phdthesis")
    entry = one(spark, r"Ann Other and Bo Body. \newblock {\em A title}. 1999.", L.bib_entry_of)
    assert (entry["title"], entry["authors"], entry["year"]) == ("A title", ["Ann Other", "Bo Body"], "1999")
