"""Queries on text functions, LaTeX extraction, document trees, files and deduplication.

Where DuckDB's regular expressions cannot say an operator, the query renders LaTeX from columns, parses it back, and the oracle is the
columns it was rendered from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import text as X
from paperloom.operators import bibliography, dedup, tree
from paperloom.plans.matching import _BASE, _STOP, _clean, _entries, _surname, _title
from paperloom.runtime import table
from paperloom.sources import publications as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BIB = "(SELECT DISTINCT entry_id, pub_id, bib_key, title, authors, pub_year, arxiv_id, raw_content FROM bib_entries)"


def _bib(spark, sf) -> DataFrame:
    return table(spark, sf, "bib_entries").select("entry_id", "pub_id", "bib_key", "title", "authors", "pub_year", "arxiv_id", "raw_content").distinct()


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# Text functions
@query(f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents")
def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT entry_id, {_title('title')} AS cleaned FROM {_BIB}")
def text_clean_title(spark, sf):
    return _bib(spark, sf).select("entry_id", X.clean_title(F.col("title")).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split({_clean('text')}, ' '), lambda t: t <> '' AND NOT list_contains({_STOP}, t)), ' ') AS tokens FROM documents")
def text_tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT DISTINCT name, {_surname('name')} AS surname FROM (SELECT unnest(authors) AS name FROM ref_entries)")
def author_surname(spark, sf):
    return table(spark, sf, "ref_entries").select(F.explode("authors").alias("name")).distinct().select("name", X.surname(F.col("name")).alias("surname"))


@query(rf"SELECT entry_id, nullif(regexp_extract(coalesce(raw_content,''), '(?:^|[^\p{{L}}\p{{N}}_])((?:19|20)[0-9]{{2}})(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS year FROM {_BIB}")
def extract_year(spark, sf):
    return _bib(spark, sf).select("entry_id", X.year_of(F.col("raw_content")).alias("year"))


_AX = r"replace(coalesce(nullif(regexp_extract(s, '(?i)arxiv[:\s]*([0-9]{4}[.-][0-9]{4,5})', 1),''), nullif(regexp_extract(s, '(?:^|[^\p{L}\p{N}_])([0-9]{4}\.[0-9]{4,5})(?:$|[^\p{L}\p{N}_])', 1),'')),'.','-')"


@query(f"SELECT entry_id, {_AX} AS arxiv FROM (SELECT entry_id, coalesce(raw_content,'') || ' arXiv:' || coalesce(replace(arxiv_id,'-','.'),'') AS s FROM {_BIB})")
def extract_arxiv(spark, sf):
    s = F.concat(F.coalesce("raw_content", F.lit("")), F.lit(" arXiv:"), F.coalesce(F.replace("arxiv_id", F.lit("-"), F.lit(".")), F.lit("")))
    return _bib(spark, sf).select("entry_id", X.arxiv_of(s).alias("arxiv"))


@query("SELECT doc_id, substr(md5(coalesce(text,'')),1,8) AS h8, substr(md5(coalesce(text,'')),1,12) AS h12 FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text"), 8).alias("h8"), X.content_hash(F.col("text"), 12).alias("h12"))


_SP = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x0b]+"


@query(rf"SELECT DISTINCT dref_id, substr(md5(trim(regexp_replace(regexp_replace(lower(coalesce(raw_content,'')), '{_SP}', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' ')),1,16) AS h FROM dedup_references")
def reference_hash(spark, sf):
    return table(spark, sf, "dedup_references").select("dref_id", X.reference_hash(F.col("raw_content")).alias("h")).distinct()


@query(rf"SELECT DISTINCT dref_id, substr(md5(trim(regexp_replace(coalesce(raw_content,''), '{_SP}', ' ', 'g'), ' ')),1,12) AS h FROM dedup_references")
def collapsed_hash(spark, sf):
    return table(spark, sf, "dedup_references").select("dref_id", X.collapsed_hash(F.col("raw_content")).alias("h")).distinct()


@query(r"SELECT entry_id, regexp_replace(regexp_extract(coalesce(raw_content,''), '10\.[0-9]{4,}/[^\s,]+', 0), '\.+$', '') AS doi, regexp_replace(regexp_extract(coalesce(raw_content,''), '(\S+)', 1), '^[.,;:]+|[.,;:]+$', '', 'g') AS first_word FROM " + _BIB)
def first_word_key(spark, sf):
    return _bib(spark, sf).select("entry_id", X.doi_of(F.col("raw_content")).alias("doi"), X.first_word(F.col("raw_content")).alias("first_word"))


# Standardisation
@query(r"SELECT doc_id, regexp_replace(coalesce(text,''), '\\cite(?:p|t|author|year)\{([^}]+)\}', '\\cite{\1}', 'g') AS out FROM documents")
def std_citations(spark, sf):
    return _docs(spark, sf).select("doc_id", L.normalize_citations(F.col("text")).alias("out"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +(\n|$)', '\1', 'g'), '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x0b]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x0b]+$', '', 'g') AS out FROM documents""")
def std_whitespace(spark, sf):
    return _docs(spark, sf).select("doc_id", L.normalize_whitespace(F.col("text")).alias("out"))


_PLAIN = "regexp_replace(coalesce(title,''), '[^A-Za-z0-9 ]', '', 'g')"


def _plain(spark, sf) -> DataFrame:
    """Entries with titles of letters, digits and blanks only, which LaTeX text can hold as they are."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", ""), " +", " "))
    return _bib(spark, sf).select("entry_id", "pub_id", "bib_key", t.alias("t"))


_PLAIN_SQL = f"(SELECT entry_id, pub_id, bib_key, trim(regexp_replace({_PLAIN}, ' +', ' ', 'g'), ' ') AS t FROM {_BIB})"


# What the standardiser removes, as DuckDB writes it (fixed values).
_STD_LAYOUT = (
    r"\\centering\b|\\raggedright\b|\\raggedleft\b|\[htpb!?\]|\[h!?\]|\[t!?\]|\[b!?\]|\[p!?\]|\[H\]|\\midrule\b|\\toprule\b|\\bottomrule\b|\\hline\b|\\cline\{[^}]*\}|\\noindent\b|\\smallskip\b|\\medskip\b|\\bigskip\b"
    r"|\\vspace\*?\{[^}]*\}|\\hspace\*?\{[^}]*\}|\\vfill\b|\\hfill\b|\\newpage\b|\\clearpage\b|\\pagebreak\b|\\linebreak\b|\\\\(?:\[[^\]]*\])?|\\par\b|\\indent\b"
)
_STD_SIZES = r"\\tiny\b|\\scriptsize\b|\\footnotesize\b|\\small\b|\\normalsize\b|\\large\b|\\Large\b|\\LARGE\b|\\huge\b|\\Huge\b"
_STD_FONTS = (
    (r"\\textbf\{([^}]*)\}", r"\1"), (r"\\textit\{([^}]*)\}", r"\1"), (r"\\emph\{([^}]*)\}", r"\1"), (r"\\underline\{([^}]*)\}", r"\1"), (r"\\texttt\{([^}]*)\}", r"\1"), (r"\\textrm\{([^}]*)\}", r"\1"), (r"\\textsf\{([^}]*)\}", r"\1"),
    (r"\\textsc\{([^}]*)\}", r"\1"), (r"\{\\bf\s+([^}]*)\}", r"\1"), (r"\{\\it\s+([^}]*)\}", r"\1"), (r"\{\\em\s+([^}]*)\}", r"\1"), (r"\{\\tt\s+([^}]*)\}", r"\1"),
    (r"\\bfseries\b", ""), (r"\\itshape\b", ""), (r"\\rmfamily\b", ""), (r"\\sffamily\b", ""), (r"\\ttfamily\b", ""),
)


def _std_sql() -> str:
    s = f"regexp_replace(regexp_replace(coalesce(text,''), '{_STD_LAYOUT}', '', 'g'), '{_STD_SIZES}', '', 'g')"
    for pattern, left in _STD_FONTS:
        s = f"regexp_replace({s}, '{pattern}', '{left}', 'g')"
    return s


@query(f"SELECT doc_id, {_std_sql()} AS out FROM documents")
def std_formatting(spark, sf):
    return _docs(spark, sf).select("doc_id", L.remove_formatting(F.col("text")).alias("out"))


# One case per pattern: what is written after a title, and what is left of it.
_BOTH_CASES = [(w, "") for w in r"\centering \raggedright \raggedleft [htpb] [htpb!] [h] [h!] [t] [t!] [b] [b!] [p] [p!] [H] \midrule \toprule \bottomrule \hline \cline{1-2} \noindent \smallskip \medskip \bigskip \vspace{1em} \vspace*{1em} \hspace{2pt} \hspace*{2pt} \vfill \hfill \newpage \clearpage \pagebreak \linebreak".split()]
_BOTH_CASES += [(w, w) for w in r"[hb] [h!t] [tb] \centeringx \hlines \cline \vspacex{1}".split()]
_STD_CASES = [
    *_BOTH_CASES, *[(w, "") for w in r"\\ \\[2pt] \par \indent \tiny \scriptsize \footnotesize \small \normalsize \large \Large \LARGE \huge \Huge \bfseries \itshape \rmfamily \sffamily \ttfamily".split()],
    *[(f"\\{n}{{some words}}", "some words") for n in "textbf textit emph underline texttt textrm textsf textsc".split()], *[(f"{{\\{n} some words}}", "some words") for n in "bf it em tt".split()],
    *[(w, w) for w in r"\parx \largest \sloppy \strut \phantom{x} \textup{x} {\sl x}".split(" ")],
]
_EXTRACTOR_CASES = [
    *_BOTH_CASES, *[(w, "") for w in r"\allowbreak \nopagebreak \enlargethispage{1pt} \phantom{x} \vphantom{x} \hphantom{x} \strut \null \relax \protect \sloppy \fussy".split()],
    *[(w, w) for w in r"\\ \\[2pt] \par \indent \large \tiny \ignorespaces \unskip \textbf{x} \bfseries".split()],
]


def _cases_sql(cases: list[tuple[str, str]], shape: str) -> str:
    values = ", ".join(f"({i}, '{left}')" for i, (_, left) in enumerate(cases))
    return f"SELECT entry_id, n, {shape} AS out FROM {_PLAIN_SQL} CROSS JOIN (VALUES {values}) v(n, x) WHERE t <> ''"


def _cases(spark, sf, cases: list[tuple[str, str]], shape) -> DataFrame:
    rows = _plain(spark, sf).where("t <> ''").select("entry_id", "t", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(w).alias("w")) for i, (w, _) in enumerate(cases)])).alias("c"))
    return rows.select("entry_id", "c.n", shape(F.col("t"), F.col("c.w")).alias("made"))


@query(_cases_sql(_STD_CASES, "t || ' ' || x || ' end'"))
def std_patterns_rt(spark, sf):
    rows = _cases(spark, sf, _STD_CASES, lambda t, w: F.concat(t, F.lit(" "), w, F.lit(" end")))
    return rows.select("entry_id", "n", L.remove_formatting(F.col("made")).alias("out"))


@query(_cases_sql(_EXTRACTOR_CASES, r"t || ' ' || CASE WHEN x = '' THEN '' ELSE x || ' ' END || 'end ' || chr(10) || chr(10) || 'last'"))
def clean_latex_rt(spark, sf):
    rows = _cases(spark, sf, _EXTRACTOR_CASES, lambda t, w: F.concat(F.lit("  "), t, F.lit(" \t "), w, F.lit("  end % gone\n\n\n\nlast% gone")))
    return rows.select("entry_id", "n", L.clean_latex(F.col("made")).alias("out"))


@query(f"SELECT entry_id, 'a $' || t || '$ b $' || t || '$ c \\begin{{equation}}' || chr(10) || t || chr(10) || '\\end{{equation}} d \\begin{{equation}}' || chr(10) || t || chr(10) || '\\end{{equation}}' AS out FROM {_PLAIN_SQL} WHERE t <> ''")
def extractor_math_rt(spark, sf):
    made = F.concat(F.lit(r"a \("), "t", F.lit(r"\) b \begin{math}"), "t", F.lit("\\end{math} c $$ "), "t", F.lit("\n$$ d \\[ "), "t", F.lit(r" \]"))
    return _plain(spark, sf).where("t <> ''").select("entry_id", L.extractor_math(made).alias("out"))


@query(f"SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN t || ' ' ELSE t || ' \\% kept' END AS out FROM {_PLAIN_SQL}")
def std_comments_rt(spark, sf):
    made = F.concat("t", F.when(F.col("entry_id") % 2 == 0, F.lit(" % dropped")).otherwise(F.lit(r" \% kept")))
    return _plain(spark, sf).select("entry_id", L.remove_comments(made).alias("out"))


_EQ = "'\\begin{equation}' || chr(10) || t || chr(10) || '\\end{equation}'"


@query(f"SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN '$' || t || '$' ELSE {_EQ} END AS out FROM {_PLAIN_SQL} WHERE t <> ''")
def std_math_rt(spark, sf):
    k = F.col("entry_id") % 3
    made = F.when(k == 0, F.concat(F.lit(r"\("), "t", F.lit(r"\)"))).when(k == 1, F.concat(F.lit("\\[ "), "t", F.lit("\n\\]"))).otherwise(F.concat(F.lit("$$"), "t", F.lit("$$")))
    return _plain(spark, sf).where("t <> ''").select("entry_id", L.normalize_math(made).alias("out"))


@query(f"SELECT entry_id, t || ' ' || '\\cite{{k}}' AS out FROM {_PLAIN_SQL} WHERE t <> ''")
def standardize_rt(spark, sf):
    made = F.concat(F.lit("%note\n\\noindent \\textbf{"), "t", F.lit("}   \\citep{k} % end\n\n\n\n"))
    return _plain(spark, sf).where("t <> ''").select("entry_id", L.standardize(made).alias("out"))


# Bibliography
@query(f"SELECT pub_id, bib_key, t AS body FROM (SELECT pub_id, bib_key, max(t) AS t FROM {_PLAIN_SQL} GROUP BY 1,2)")
def bibitem_scan_rt(spark, sf):
    items = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("\\bibitem[L]{ "), "bib_key", F.lit(" } "), "t", F.lit("\n")))), "")
    one = _plain(spark, sf).groupBy("pub_id", "bib_key").agg(F.max("t").alias("t"))
    docs = one.groupBy("pub_id").agg(F.concat(F.lit("\\begin{thebibliography}{9}\n"), items, F.lit("\\end{thebibliography}")).alias("tex"))
    return docs.select("pub_id", F.explode(L.bibitems_of(F.col("tex"))).alias("b")).select("pub_id", F.col("b.key").alias("bib_key"), "b.body")


@query(f"SELECT entry_id, 'misc' AS type, 'A. Body, ' || chr(34) AS author, t AS title, '2010' AS year, 'Journal of Things' AS journal, '12' AS volume, '3-9' AS pages, '10.1234/x' AS doi, '1001.00001' AS arxiv FROM {_PLAIN_SQL} WHERE t <> '' AND NOT regexp_matches(t, '(?i)press|book|proceedings|conference') AND NOT regexp_matches(t, '[0-9]|Nature|Science|Journal|Proc|IEEE|ACM')")
def bibitem_to_bibtex_rt(spark, sf):
    made = F.concat(F.lit('A. Body, "'), "t", F.lit('", Journal of Things, 12:3–9, 2010. doi 10.1234/x. arXiv:1001.00001'))
    rows = _plain(spark, sf).where("t <> ''").where(~F.col("t").rlike("(?i)press|book|proceedings|conference") & ~F.col("t").rlike("[0-9]|Nature|Science|Journal|Proc|IEEE|ACM"))
    return rows.select("entry_id", L.bibtex_of(F.lit("k"), made).alias("b")).select("entry_id", "b.type", "b.author", "b.title", "b.year", "b.journal", "b.volume", "b.pages", "b.doi", "b.arxiv")


# One case per type and journal rule: what follows the title, and the type and journal read from it.
_TYPES = [
    ("Proceedings of the Workshop, 2001", "inproceedings", "Proceedings of the Workshop"), ("Talk at a conference, 2001", "inproceedings", ""), ("Proc. Symp. on Waves, 2001", "article", "Proc. Symp"), ("Some Press, 2001", "book", ""),
    ("A book on it, 2001", "book", ""), ("arXiv:1001.00001, 2001", "misc", ""), ("arXiv preprint, 2001", "misc", "arXiv preprint"), ("PhD thesis, 2001", "phdthesis", ""), ("Physical Review D, 2001", "article", "Physical Review D"), ("Phys. Rev. D 12, 2001", "article", "Phys. Rev. D"),
    ("Nature Letters, 2001", "article", "Nature Letters"), ("Science, 2001", "article", "Science"), ("Journal of Waves, 2001", "article", "Journal of Waves"), ("IEEE Letters on Waves, 2001", "article", "IEEE Letters on Waves"), ("ACM Notes, 2001", "article", "ACM Notes"), ("none, 2001", "article", ""),
]


@query(f"SELECT entry_id, n, type, 'Waves' AS title, 'A. Body, \\emph{{' AS author, '2001' AS year, journal FROM {_PLAIN_SQL} CROSS JOIN (VALUES " + ", ".join(f"({n}, '{kind}', '{journal}')" for n, (_, kind, journal) in enumerate(_TYPES)) + ") v(n, type, journal)")
def bibtex_types_rt(spark, sf):
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"A. Body, \\emph{{Waves}}, {rest}.").alias("body")) for n, (rest, *_) in enumerate(_TYPES)]))
    rows = _plain(spark, sf).select("entry_id", cases.alias("c"))
    return rows.select("entry_id", "c.n", L.bibtex_of(F.lit("k"), F.col("c.body")).alias("b")).select("entry_id", "n", "b.type", "b.title", "b.author", "b.year", "b.journal")


@query(f"SELECT entry_id, t AS title, 'Ann Other;Bo Body' AS authors, '2011' AS year, '1101-00002' AS arxiv_id FROM {_PLAIN_SQL} WHERE t <> ''")
def bibitem_to_entry_rt(spark, sf):
    made = F.concat(F.lit("Ann Other and Bo Body. \\newblock {\\em "), "t", F.lit("}. 2011. arXiv:1101.00002"))
    return _plain(spark, sf).where("t <> ''").select("entry_id", L.bib_entry_of(made).alias("b")).select("entry_id", "b.title", F.array_join("b.authors", ";").alias("authors"), "b.year", "b.arxiv_id")


@query(f"SELECT pub_id, bib_key, t AS title, '2012' AS year, 'J' AS venue, '1201-00003' AS arxiv_id FROM (SELECT pub_id, bib_key, max(t) AS t FROM {_PLAIN_SQL} GROUP BY 1,2)")
def bibfile_scan_rt(spark, sf):
    one = _plain(spark, sf).groupBy("pub_id", "bib_key").agg(F.max("t").alias("t"))
    made = F.concat(F.lit("@article{"), "bib_key", F.lit(",\n  title = {"), "t", F.lit('},\n  year = "1999",\n  year = {2012},\n  journal = {J},\n  eprint = {1201.00003}\n}\n'))
    docs = one.groupBy("pub_id").agg(F.array_join(F.array_sort(F.collect_list(made)), "\n").alias("tex"))
    rows = docs.select("pub_id", F.explode(L.bib_file_entries(F.col("tex"))).alias("b"))
    return rows.select("pub_id", F.col("b.key").alias("bib_key"), "b.title", "b.year", "b.venue", "b.arxiv_id")


@query(r"SELECT DISTINCT doc_id, trim(k) AS cited FROM (SELECT doc_id, unnest(string_split(k, ',')) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text,''), '\\cite[a-z]*\{([^}]+)\}', 1)) AS k FROM documents)) WHERE trim(k) <> ''")
def cited_keys(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(L.cited_keys_of(F.col("text"))).alias("cited")).distinct()


@query(_BASE + "SELECT pub_id, bib_key FROM bibs WHERE ascii(substr(md5(bib_key),1,1)) % 2 = 0")
def bib_cited_semi(spark, sf):
    """.bib entries kept where some text of the publication cites them; the texts cite every key of even hash."""
    keys = _entries(spark, sf).select("pub_id", "bib_key")
    cites = keys.where(F.ascii(F.substring(F.md5("bib_key"), 1, 1)) % 2 == 0).groupBy("pub_id").agg(F.concat(F.lit("\\citep{"), F.array_join(F.collect_list("bib_key"), ", "), F.lit("}")).alias("tex"))
    cited = cites.select("pub_id", F.explode(L.cited_keys_of(F.col("tex"))).alias("bib_key")).distinct()
    return keys.join(cited, ["pub_id", "bib_key"], "left_semi")


@query(f"SELECT entry_id, '@article{{k,' || chr(10) || CASE WHEN t <> '' THEN '  title = {{' || t || '}},' || chr(10) ELSE '' END || '  year = {{2013}},' || chr(10) || '  eprint = {{1301.00004}}' || chr(10) || '}}' AS bibtex FROM {_PLAIN_SQL}")
def bibtex_render(spark, sf):
    none = F.lit("")
    record = F.struct(F.lit("article").alias("type"), F.lit("k").alias("key"), none.alias("author"), F.col("t").alias("title"), F.lit("2013").alias("year"), none.alias("journal"), none.alias("volume"), none.alias("pages"), none.alias("doi"), F.lit("1301.00004").alias("arxiv"))
    return _plain(spark, sf).withColumn("r", record).select("entry_id", L.bibtex_text(F.col("r")).alias("bibtex"))


# Structure
def _tex_docs(spark, sf) -> DataFrame:
    """One document per publication: every entry a heading with a body, the level by its number; each seventh a reference section."""
    n = F.row_number().over(Window.partitionBy("pub_id").orderBy("entry_id"))
    rows = _plain(spark, sf).withColumn("n", n)
    kind = F.when(F.col("n") % 7 == 0, "section").when(F.col("n") % 4 == 1, "section").when(F.col("n") % 4 == 2, "subsection").when(F.col("n") % 4 == 3, "subsubsection").otherwise("section*")
    title = F.when(F.col("n") % 7 == 0, F.lit("References")).otherwise(F.concat(F.lit("H"), F.col("entry_id").cast("string"), F.lit(" "), "t"))
    part = F.concat(F.lit("\\"), kind, F.lit("{"), title, F.lit("} We describe entry "), F.col("entry_id").cast("string"), F.lit(" in detail. It is e.g. short.\n"))
    return rows.groupBy(F.col("pub_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), "").alias("content"))


_HEADS = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY pub_id ORDER BY entry_id) AS n FROM {_PLAIN_SQL}),
h AS (SELECT pub_id AS doc, entry_id, (n-1)::INT AS pos, CASE WHEN n%7=0 OR n%4 IN (0,1) THEN 'section' WHEN n%4=2 THEN 'subsection' ELSE 'subsubsection' END AS type,
  CASE WHEN n%7=0 OR n%4 IN (0,1) THEN 1 WHEN n%4=2 THEN 2 ELSE 3 END AS level, CASE WHEN n%7=0 THEN 'References' ELSE trim('H' || entry_id || ' ' || t) END AS title, n%7=0 AS isref FROM r),
f AS (SELECT *, coalesce(last_value(CASE WHEN level=1 THEN isref OR regexp_matches(lower(title),'references|bibliography|works cited|literatur') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skip FROM h),
k AS (SELECT * FROM f WHERE NOT skip)
"""


@query(_HEADS + "SELECT doc, pos, type, level, title, ' We describe entry ' || entry_id || ' in detail. It is e.g. short.' || chr(10) AS body FROM h")
def sections_rt(spark, sf):
    return tree.sections(_tex_docs(spark, sf)).select("doc", "pos", "type", "level", "title", "body")


@query(_HEADS + "SELECT doc, pos, skip FROM f")
def reference_section_flag(spark, sf):
    return tree.sections(_tex_docs(spark, sf)).select("doc", "pos", "skip")


@query(_HEADS + """, c AS (SELECT *, sum((level=1)::INT) OVER w AS c1, sum((level=2)::INT) OVER w AS c2 FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)),
d AS (SELECT *, sum((level=3)::INT) OVER (PARTITION BY doc, c1 ORDER BY pos) AS c3 FROM c)
SELECT doc, pos, CASE level WHEN 1 THEN c1::VARCHAR WHEN 2 THEN c1 || '.' || c2 ELSE c1 || '.' || c2 || '.' || c3 END AS number FROM d""")
def section_numbering(spark, sf):
    heads = tree.numbering(tree.sections(_tex_docs(spark, sf)).where("not skip"))
    return heads.select("doc", "pos", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("number"))


@query(_HEADS + """, p AS (SELECT *, max(CASE WHEN level=1 THEN pos END) OVER w AS p1, max(CASE WHEN level=2 THEN pos END) OVER w AS p2 FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc, pos, CASE level WHEN 2 THEN p1 WHEN 3 THEN coalesce(p2,p1) END AS parent_pos FROM p""")
def section_parent(spark, sf):
    return tree.parents(tree.sections(_tex_docs(spark, sf)).where("not skip")).select("doc", "pos", "parent_pos")


@query(f"SELECT entry_id, t AS title, 'Some ' || t || ' text' AS abstract FROM {_PLAIN_SQL} WHERE t <> ''")
def title_abstract_rt(spark, sf):
    made = F.concat(F.lit("\\title{"), "t", F.lit("}\n\\begin{abstract}\nSome\n"), "t", F.lit("  text\n\\end{abstract}"))
    return _plain(spark, sf).where("t <> ''").select("entry_id", L.title_of(made).alias("title"), L.abstract_of(made).alias("abstract"))


_KINDS = ", ".join(f"({n}, '{env}', '{kind}')" for n, (env, kind) in enumerate((("equation*", "equation"), ("align", "equation"), ("gather*", "equation"), ("multline", "equation"), ("eqnarray", "equation"), ("figure*", "figure"), ("table", "table"), ("theorem", "theorem"), ("lemma", "lemma"), ("proof", "proof"), ("algorithm", "algorithm"))))


@query(f"""SELECT entry_id, kind AS type, CASE WHEN kind IN ('figure', 'table') THEN 'Cap ' || t ELSE env || ' of ' || t END AS content, CASE WHEN kind IN ('figure', 'table') THEN 'Cap ' || t ELSE '' END AS caption,
 CASE WHEN kind IN ('figure', 'table') THEN 'l:' || n ELSE '' END AS label, env || ' of ' || t || CASE WHEN kind IN ('figure', 'table') THEN ' \\caption{{ Cap ' || t || ' }}\\label{{l:' || n || '}}' ELSE '' END AS full_content
FROM {_PLAIN_SQL} CROSS JOIN (VALUES {_KINDS}) v(n, env, kind) WHERE t <> ''
UNION ALL SELECT entry_id, 'lemma', 'Kept ' || t, '', '', 'Kept ' || t FROM {_PLAIN_SQL} WHERE t <> ''""")
def environments_rt(spark, sf):
    """Every kind once below a section whose title only contains a reference word, then some in reference sections, one of them kept as it
    stands after the next section."""
    one = lambda env, n, cap: F.concat(F.lit(f"\\begin{{{env}}}\n{env} of "), "t", *([F.lit(" \\caption{ Cap "), "t", F.lit(f" }}\\label{{l:{n}}}")] if cap else []), F.lit(f"\n\\end{{{env}}} text\n"))
    envs = [one(env, n, env.strip("*") in ("figure", "table")) for n, env in enumerate("equation* align gather* multline eqnarray figure* table theorem lemma proof algorithm".split())]
    lost = F.lit("\\begin{figure}no\\end{figure}\\begin{theorem}no\\end{theorem}")
    made = F.concat(F.lit("\\section{User preferences}"), *envs, F.lit("\\section*{REFERENCES}"), lost, F.lit("\\subsection{Sub}"), lost, F.lit("\\section{After}\\begin{lemma}Kept "), "t", F.lit("\\end{lemma}\\begin{thebibliography}{9}"), lost, F.lit("\\end{thebibliography}"), lost)
    return _plain(spark, sf).where("t <> ''").select("entry_id", F.explode(L.environments_of(made)).alias("e")).select("entry_id", "e.type", "e.content", "e.caption", "e.label", "e.full_content")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY pub_id ORDER BY entry_id) AS n FROM {_PLAIN_SQL}) SELECT pub_id AS doc, n::INT AS item, 'item ' || entry_id AS content FROM r")
def lists_rt(spark, sf):
    rows = _plain(spark, sf).groupBy(F.col("pub_id").alias("doc")).agg(F.array_sort(F.collect_list("entry_id")).alias("e"))
    made = F.concat(F.lit("\\begin{enumerate}tiny\\end{enumerate}\\section{Preferences}\\begin{itemize}\n"), F.array_join(F.transform("e", lambda x: F.concat(F.lit("\\item[*] item\n"), x.cast("string"), F.lit("\n"))), ""), F.lit("\\end{itemize}\\begin{thebibliography}{9}\\begin{itemize}\\item never seen\\end{itemize}\\end{thebibliography}"))
    return rows.select("doc", F.explode(L.lists_of(made)).alias("l")).select("doc", F.posexplode("l.items").alias("i", "content")).select("doc", (F.col("i") + 1).alias("item"), "content")


@query(f"SELECT entry_id, 3 AS n, 'It is $x.y$ and 2.5 e.g. here.' AS second FROM {_PLAIN_SQL} WHERE t <> ''")
def sentence_split_rt(spark, sf):
    made = F.concat(F.lit("We show "), "t", F.lit(". It is $x.y$ and 2.5 E.g. here. Done now!"))
    return _plain(spark, sf).where("t <> ''").select("entry_id", L.sentences_of(made).alias("s")).select("entry_id", F.size("s").alias("n"), F.get("s", F.lit(1)).alias("second"))


@query()
def tree_stats(spark, sf):
    return tree.statistics(tree.nodes(_latex(spark, sf)))


def _latex(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("doc"), L.standardize(F.col("text")).alias("content"))


@query()
def node_ids(spark, sf):
    return tree.nodes(_latex(spark, sf)).select("doc", "node_id", "type", "content", "level", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "parent")


@query(_HEADS + """, u AS (SELECT doc, title, min(pos) AS pos FROM k GROUP BY doc, title) SELECT doc, count(*) AS n_sections FROM u GROUP BY doc""")
def tree_sections_rt(spark, sf):
    rows = tree.nodes(_tex_docs(spark, sf))
    return rows.where(F.col("type").isin(*L.HEAD_LEVELS)).groupBy("doc").agg(F.count("*").alias("n_sections"))


@query()
def tree_edges(spark, sf):
    return tree.edges(tree.nodes(_latex(spark, sf)))


@query()
def tree_json(spark, sf):
    return tree.to_json(tree.nodes(_latex(spark, sf)))


# Deduplication. hierarchy_nodes gives elements with versions.
def _elements(spark, sf) -> DataFrame:
    n = table(spark, sf, "hierarchy_nodes").where("content is not null").select("pub_id", "tex_version", "node_id", "content").distinct()
    return n.select("pub_id", F.col("tex_version").alias("version"), F.col("node_id").alias("pos"), F.regexp_replace("node_id", "^[^_]*_", "").alias("element_id"), "content")


_ELS = "(SELECT DISTINCT pub_id, tex_version AS version, node_id AS pos, content FROM hierarchy_nodes WHERE content IS NOT NULL)"
_KEY12 = f"substr(md5(trim(regexp_replace(content, '{_SP}', ' ', 'g'), ' ')),1,12)"


@query(f"SELECT pub_id, pos, row_number() OVER (PARTITION BY pub_id, version, substr(md5(content),1,8) ORDER BY pos) = 1 AS is_new FROM {_ELS}")
def dedup_elements(spark, sf):
    return dedup.content_ids(_elements(spark, sf), ["pub_id", "version"], ["pos"], "content", F.lit("elem")).select("pub_id", "pos", "is_new")


@query(f"SELECT pub_id, {_KEY12} AS h, count(*) AS n, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM {_ELS} GROUP BY 1,2")
def dedup_versions_merge(spark, sf):
    m = dedup.merge_versions(_elements(spark, sf))
    return m.select("pub_id", X.collapsed_hash(F.col("content")).alias("h"), F.size("original_ids").cast("bigint").alias("n"), F.array_join("versions", ",").alias("versions"))


@query("WITH l AS (SELECT node_id, arg_max(parent, parsed_at) AS parent, any_value(pub_id) AS pub_id, any_value(tex_version) AS version, any_value(content) AS content FROM hierarchy_nodes GROUP BY 1), " + f"m AS (SELECT pub_id, version, node_id, pub_id || {_KEY12} AS mid FROM l WHERE content IS NOT NULL) " + "SELECT pub_id, version, child, max_by(parent, pos) AS parent FROM (SELECT e.pub_id, e.version, e.node_id AS pos, coalesce(c.mid, e.node_id) AS child, coalesce(p.mid, e.parent) AS parent FROM l e LEFT JOIN m c ON c.pub_id=e.pub_id AND c.version=e.version AND c.node_id=e.node_id LEFT JOIN m p ON p.pub_id=e.pub_id AND p.version=e.version AND p.node_id=e.parent WHERE trim(e.parent) <> '') GROUP BY 1,2,3")
def dedup_edge_remap(spark, sf):
    n = table(spark, sf, "hierarchy_nodes").groupBy("node_id").agg(F.max_by(F.struct("parent", "pub_id", "tex_version", "content"), "parsed_at").alias("s")).select("node_id", "s.parent", "s.pub_id", F.col("s.tex_version").alias("version"), "s.content")
    mapping = n.where("content is not null").select("pub_id", "version", F.col("node_id").alias("original_id"), F.concat("pub_id", X.collapsed_hash(F.col("content"))).alias("merged_id"))
    links = n.where("trim(parent) <> ''").select("pub_id", "version", F.col("node_id").alias("pos"), F.col("node_id").alias("child"), "parent")
    return dedup.remap_edges(links, mapping)


def _references(spark, sf) -> DataFrame:
    d = table(spark, sf, "dedup_references").select("dref_id", "pub_id", F.col("canonical_key").alias("key"), F.get("versions", F.lit(0)).alias("version"), "raw_content").distinct()
    return d.withColumnRenamed("dref_id", "pos")


@query(rf"SELECT pub_id, h AS content_hash, arg_min(canonical_key, dref_id) AS canonical_key, string_agg(DISTINCT canonical_key, ',' ORDER BY canonical_key) AS all_keys, string_agg(DISTINCT versions[1], ',' ORDER BY versions[1]) AS versions FROM (SELECT DISTINCT dref_id, pub_id, canonical_key, versions, substr(md5(trim(regexp_replace(regexp_replace(lower(raw_content), '{_SP}', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' ')),1,16) AS h FROM dedup_references WHERE trim(coalesce(raw_content,''),' ') <> '') GROUP BY 1,2")
def ref_exact_clusters(spark, sf):
    r = dedup.exact_references(_references(spark, sf))
    return r.select("pub_id", "content_hash", "canonical_key", F.array_join("all_keys", ",").alias("all_keys"), F.array_join("versions", ",").alias("versions"))


@query()
def ref_cluster(spark, sf):
    c = dedup.greedy_clusters(_references(spark, sf))
    return c.select("pub_id", "content_hash", "canonical_key", F.array_join("all_keys", ",").alias("all_keys"), F.array_join("versions", ",").alias("versions"))


@query()
def ref_key_mapping(spark, sf):
    return dedup.canonical_keys(dedup.greedy_clusters(_references(spark, sf)))


# Files: a binary tree of includes over the parts of the star schema.
def _files(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.lit(".tex"))
    text = F.concat(F.when(k == 1, F.lit("\\documentclass{article}\n")).otherwise(F.lit("")), F.col("p_name"), F.lit("\n\\input{f"), (2 * k).cast("string"), F.lit("}\n\\include{f"), (2 * k + 1).cast("string"), F.lit(".tex}"), F.when(k == 3, F.lit("\\input{f1}")).otherwise(F.lit("")))
    real = table(spark, sf, "part").select(F.lit("p").alias("pub_id"), F.lit("v1").alias("version"), name.alias("rel_path"), name.alias("file_name"), text.alias("content"))
    lost = table(spark, sf, "supplier").select(F.lit("p").alias("pub_id"), F.lit("v1").alias("version"), F.concat(F.lit("appendix"), F.col("s_suppkey").cast("string"), F.lit(".tex")).alias("rel_path"), F.concat(F.lit("appendix"), F.col("s_suppkey").cast("string"), F.lit(".tex")).alias("file_name"), F.col("s_name").alias("content"))
    return real.unionByName(lost)


@query("SELECT 'f' || p_partkey || '.tex' AS rel_path FROM part WHERE p_partkey > 0")
def include_closure_rt(spark, sf):
    return P.compiled_files(_files(spark, sf)).select("rel_path")


@query("SELECT 'f' || p_partkey || '.tex' AS rel_path, CASE WHEN p_partkey=1 THEN 'main' ELSE 'other' END AS kind FROM part UNION ALL SELECT 'appendix' || s_suppkey || '.tex', 'appendix' FROM supplier")
def file_classify(spark, sf):
    return _files(spark, sf).select("rel_path", P.file_kind(F.col("file_name"), F.col("content")).alias("kind"))


@query("SELECT 'p' AS pub_id, 'v1' AS version, 'f1.tex' AS rel_path")
def main_file_pick(spark, sf):
    return P.main_files(_files(spark, sf)).select("pub_id", "version", "rel_path")


@query("SELECT pub_id, tex_version AS version, string_agg(content, chr(10) || chr(10) ORDER BY node_id) AS content FROM (SELECT DISTINCT pub_id, tex_version, node_id, content FROM hierarchy_nodes WHERE content IS NOT NULL AND node_type IN ('document')) GROUP BY 1,2")
def version_concat(spark, sf):
    n = table(spark, sf, "hierarchy_nodes").where("content is not null and node_type = 'document'").select("pub_id", F.col("tex_version").alias("version"), F.col("node_id").alias("rel_path"), F.col("node_id").alias("file_name"), "content").distinct()
    return P.version_texts(n)


@query("SELECT pub_id, (row_number() OVER (PARTITION BY pub_id ORDER BY arxiv_id) - 1)::INT AS ref_pos, arxiv_id, title, venue FROM (SELECT DISTINCT ON (pub_id, arxiv_id) pub_id, arxiv_id, coalesce(title,'') AS title, coalesce(venue,'') AS venue FROM ref_entries WHERE arxiv_id <> '' ORDER BY pub_id, arxiv_id, ref_id)")
def refs_load(spark, sf):
    """references.json rendered per publication, then read."""
    r = table(spark, sf, "ref_entries").where("arxiv_id <> ''").groupBy("pub_id", "arxiv_id").agg(F.min_by(F.struct(F.col("title").alias("paper_title"), "authors", "submission_date", F.col("venue").alias("publication_venue")), "ref_id").alias("v"))
    text = r.groupBy("pub_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("arxiv_id", "v"))))).alias("t"))
    return P.reference_rows(text.select("pub_id", F.from_json("t", f"map<string,{P.REFERENCE}>").alias("json"))).select("pub_id", "ref_pos", "arxiv_id", "title", "venue")


@query("SELECT pub_id, count(*) AS n_nodes, count(DISTINCT tex_version) AS n_versions, count(*) FILTER (node_type='section') AS n_sections FROM (SELECT DISTINCT pub_id, tex_version, node_id, node_type FROM hierarchy_nodes) GROUP BY 1")
def pub_stats(spark, sf):
    n = table(spark, sf, "hierarchy_nodes").select("pub_id", "tex_version", "node_id", "node_type").distinct()
    return n.groupBy("pub_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("tex_version").alias("n_versions"), F.count_if(F.col("node_type") == "section").alias("n_sections"))


@query("WITH s AS (SELECT p.pub_id, count(h.node_id) AS n FROM publications p LEFT JOIN (SELECT DISTINCT pub_id, node_id FROM hierarchy_nodes) h ON h.pub_id=p.pub_id GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (n>0) AS successful, count(*) FILTER (n=0) AS failed, sum(n)::BIGINT AS total_nodes FROM s")
def run_summary(spark, sf):
    n = table(spark, sf, "hierarchy_nodes").select("pub_id", "node_id").distinct().groupBy("pub_id").agg(F.count("*").alias("n"))
    s = table(spark, sf, "publications").select("pub_id").join(n, "pub_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("successful"), F.count_if(F.col("n") == 0).alias("failed"), F.sum("n").alias("total_nodes"))


@query(f"SELECT pub_id, bib_key, max(t) AS title, '2014' AS year FROM {_PLAIN_SQL} GROUP BY 1,2")
def bibliography_union_rt(spark, sf):
    """Half of the keys as bibitems, half as .bib entries; the texts cite all of them and repeat the bibitems in the .bib file."""
    one = _plain(spark, sf).groupBy("pub_id", "bib_key").agg(F.max("t").alias("t"))
    half = F.ascii(F.substring(F.md5("bib_key"), 1, 1)) % 2 == 0
    item = F.concat(F.lit("\\bibitem{"), "bib_key", F.lit("} Ann Other. "), "t", F.lit(". 2014\n"))
    entry = F.concat(F.lit("@article{"), "bib_key", F.lit(",\n  title = {"), F.when(half, F.lit("Other")).otherwise(F.col("t")), F.lit("},\n  year = {2014}\n}\n"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    docs = one.groupBy("pub_id").agg(F.concat(F.lit("\\cite{"), F.array_join(F.collect_list("bib_key"), ","), F.lit("}"), joined(F.when(half, item))).alias("tex"), joined(entry).alias("bib"))
    tex = docs.select("pub_id", F.lit("a.tex").alias("rel_path"), F.col("tex").alias("content"))
    bib = docs.select("pub_id", F.lit("a.bib").alias("rel_path"), F.col("bib").alias("content"))
    return bibliography.extracted(tex, bib).select("pub_id", "bib_key", "title", "year")


@query()
def flat_elements(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    return bibliography.flat_elements(d).select("doc", "element_id", "type", "content", "level", "label", "parent")


_FLAT = [("document", "'document'", "''", 0, "''"), ("title", "'T ' || t", "'T ' || t", 1, "''"), ("abstract", "'Abs ' || t", "'Abs ' || t", 1, "''"), ("section", "'S ' || t", "'S ' || t", 2, "''"), ("subparagraph", "'P ' || t", "'P ' || t", 6, "''"),
         ("figure", "'F ' || t", "'F ' || t", 4, "'f:1'"), ("figure", "'plain'", "''", 4, "''"), ("equation", "substr('E ' || t || '\\label{e:1}', 1, 50)", "'E ' || t || '\\label{e:1}'", 4, "'e:1'"), ("equation", "substr('D ' || t, 1, 50)", "'D ' || t", 4, "''"), ("equation", "substr('C ' || t, 1, 50)", "'C ' || t", 4, "''")]


@query("SELECT entry_id AS doc, element_id, type, content, level, label, CASE WHEN n > 1 THEN 'document_1_' || substr(md5('document'), 1, 8) END AS parent FROM (" + " UNION ALL ".join(
    f"SELECT entry_id, {n} AS n, '{kind}_{n}_' || substr(md5({shown}), 1, 8) AS element_id, '{kind}' AS type, {content} AS content, {level} AS level, {label} AS label FROM {_PLAIN_SQL} WHERE t <> ''" for n, (kind, shown, content, level, label) in enumerate(_FLAT, 1)) + ")")
def flat_elements_rt(spark, sf):
    made = F.concat(F.lit("\\title{T "), "t", F.lit("}\n\\begin{abstract} Abs\t"), "t", F.lit("\n\\end{abstract}\\section*{S \\hfill"), "t", F.lit("}\\subparagraph{P "), "t", F.lit("}\\section{S "), "t", F.lit("}\n\\begin{figure}[h]\\caption{F "), "t",
                    F.lit("}\\label{f:1}\\end{figure}\\begin{figure}plain\\end{figure}\\begin{align} E "), "t", F.lit("\\label{e:1}\\end{align}\\begin{displaymath}D "), "t", F.lit("\\end{displaymath}\\begin{cases}C "), "t", F.lit("\\end{cases} % gone"))
    docs = _plain(spark, sf).where("t <> ''").select(F.col("entry_id").alias("doc"), F.regexp_replace(made, r"\\hfill", r"\\hfill ").alias("content"))
    return bibliography.flat_elements(docs).select("doc", "element_id", "type", "content", "level", "label", "parent")


@query()
def dedup_merged_output(spark, sf):
    merged = dedup.merge_versions(_elements(spark, sf))
    mapping = merged.select("pub_id", "merged_id", F.explode("original_ids").alias("o")).select("pub_id", "o.version", "o.original_id", "merged_id")
    n = table(spark, sf, "hierarchy_nodes").groupBy("node_id").agg(F.max_by(F.struct("parent", "pub_id", "tex_version"), "parsed_at").alias("s"))
    plain = lambda c: F.regexp_replace(c, "^[^_]*_", "")
    links = n.where("trim(s.parent) <> ''").select("s.pub_id", F.col("s.tex_version").alias("version"), F.col("node_id").alias("pos"), plain(F.col("node_id")).alias("child"), plain(F.col("s.parent")).alias("parent"))
    return bibliography.merged_output(merged, dedup.remap_edges(links, mapping))


@query("SELECT DISTINCT r.pub_id, l.n_labels FROM ref_entries r LEFT JOIN (SELECT pub_id, count(DISTINCT bib_key) AS n_labels FROM labeled_pairs WHERE is_match GROUP BY 1) l ON l.pub_id = r.pub_id")
def label_listing(spark, sf):
    """Labels per publication; null where a publication has none."""
    labels = table(spark, sf, "labeled_pairs").where("is_match").groupBy("pub_id").agg(F.countDistinct("bib_key").alias("n_labels"))
    return table(spark, sf, "ref_entries").select("pub_id").distinct().join(labels, "pub_id", "left")


@query("SELECT pub_id, ref_id, title FROM (SELECT *, row_number() OVER (PARTITION BY pub_id ORDER BY ref_pos, ref_id) AS n FROM (SELECT DISTINCT pub_id, ref_id, ref_pos, title FROM ref_entries)) WHERE n <= 20")
def candidate_preview(spark, sf):
    """The first 20 candidates of every publication."""
    rows = table(spark, sf, "ref_entries").select("pub_id", "ref_id", "ref_pos", "title").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("pub_id").orderBy("ref_pos", "ref_id"))).where("n <= 20").select("pub_id", "ref_id", "title")
