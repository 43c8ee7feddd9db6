"""LaTeX as Column expressions: standardisation and the extraction of structure and bibliography records.

Regular expressions run in Java; dot-all, line modes and Unicode classes are set where the semantics need them. Lists of rules that
act on disjoint signs are folded into one alternation, so that a text is scanned once and not once per rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import WORD, arxiv_of, doi_of, year_of

_END = rf"(?![{WORD}])"
def _any(patterns: tuple[str, ...]) -> str:
    r"""One alternation of the patterns; ``\b`` after a command's name is the end of a word in the sense of Unicode."""
    return "|".join(p.removesuffix(r"\b") + _END if p.endswith(r"\b") else p for p in patterns)


# Commands and signs without meaning, removed before anything else (fixed values).
LAYOUT = (
    r"\\centering\b", r"\\raggedright\b", r"\\raggedleft\b", r"\[htpb!?\]", r"\[h!?\]", r"\[t!?\]", r"\[b!?\]", r"\[p!?\]", r"\[H\]", r"\\midrule\b", r"\\toprule\b", r"\\bottomrule\b", r"\\hline\b", r"\\cline\{[^}]*\}",
    r"\\noindent\b", r"\\smallskip\b", r"\\medskip\b", r"\\bigskip\b", r"\\vspace\*?\{[^}]*\}", r"\\hspace\*?\{[^}]*\}", r"\\vfill\b", r"\\hfill\b", r"\\newpage\b", r"\\clearpage\b", r"\\pagebreak\b", r"\\linebreak\b",
)
#: Removed by the standardiser only (fixed values).
LAYOUT_STANDARD = (r"\\\\(?:\[[^\]]*\])?", r"\\par\b", r"\\indent\b")
#: Removed by the extractor's clean-up only (fixed values).
LAYOUT_EXTRACTOR = (
    r"\\allowbreak\b", r"\\nopagebreak\b", r"\\enlargethispage\{[^}]*\}", r"\\phantom\{[^}]*\}", r"\\vphantom\{[^}]*\}", r"\\hphantom\{[^}]*\}", r"\\strut\b", r"\\null\b", r"\\relax\b", r"\\protect\b", r"\\sloppy\b", r"\\fussy\b",
)
#: Size commands (fixed values).
SIZES = (r"\\tiny\b", r"\\scriptsize\b", r"\\footnotesize\b", r"\\small\b", r"\\normalsize\b", r"\\large\b", r"\\Large\b", r"\\LARGE\b", r"\\huge\b", r"\\Huge\b")
#: Font switches, removed, and font commands, replaced by their argument (fixed values).
SWITCHES = (r"\\bfseries\b", r"\\itshape\b", r"\\rmfamily\b", r"\\sffamily\b", r"\\ttfamily\b")
WRAPPERS = ("textbf", "textit", "emph", "underline", "texttt", "textrm", "textsf", "textsc")
BRACED = ("bf", "it", "em", "tt")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def remove_comments(c: Column) -> Column:
    """Whole-line comments, then from an unescaped % to the line's end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?dm)^%.*$", ""), r"(?dm)(?<!\\)%.*$", "")


def remove_formatting(c: Column) -> Column:
    """Layout and size commands dropped, font commands replaced by their argument, one kind after another."""
    c = F.regexp_replace(F.regexp_replace(c, _any(LAYOUT + LAYOUT_STANDARD), ""), _any(SIZES), "")
    for name in WRAPPERS:
        c = F.regexp_replace(c, rf"\\{name}\{{([^}}]*)\}}", "$1")
    for name in BRACED:
        c = F.regexp_replace(c, rf"(?U)\{{\\{name}\s+([^}}]*)\}}", "$1")
    return F.regexp_replace(c, _any(SWITCHES), "")


def normalize_math(c: Column) -> Column:
    r"""``\(x\)`` to ``$x$``; ``\[x\]`` and ``$$x$$`` to equation environments with their blanks trimmed."""
    block = "\\\\begin{equation}\n$1\n\\\\end{equation}"
    c = F.regexp_replace(c, r"(?s)\\\((.+?)\\\)", r"\$$1\$")
    c = F.regexp_replace(c, r"(?s)\\\[\s*(.+?)\s*\\\]", block)
    return F.regexp_replace(c, r"(?s)\$\$\s*(.+?)\s*\$\$", block)


def normalize_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\\cite(?:p|t|author|year)\{([^}]+)\}", r"\\cite{$1}")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"(?dm) +$", ""))


def standardize(c: Column, comments: bool = True, formatting: bool = True, math: bool = True, citations: bool = True, whitespace: bool = True) -> Column:
    """All steps in order, each of which can be left out. Null stays null, "" stays ""."""
    for on, step in ((comments, remove_comments), (formatting, remove_formatting), (math, normalize_math), (citations, normalize_citations), (whitespace, normalize_whitespace)):
        if on:
            c = step(c)
    return c


def clean_latex(c: Column) -> Column:
    """The extractor's own clean-up: layout commands, then comments, runs of blank lines and of blanks; line ends stay. What only arises when
    two removed commands meet is left."""
    c = F.regexp_replace(F.regexp_replace(c, _any(LAYOUT + LAYOUT_EXTRACTOR), ""), r"(?dm)(?<!\\)%.*$", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def extractor_math(c: Column) -> Column:
    r"""The extractor's formulas: ``\(x\)`` and the math environment to ``$x$``, then ``$$x$$`` and last ``\[x\]`` to equation environments."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)\\\((.+?)\\\)", r"\$$1\$"), r"(?s)\\begin\{math\}(.+?)\\end\{math\}", r"\$$1\$")
    block = "\\\\begin{equation}\n$1\n\\\\end{equation}"
    c = F.regexp_replace(c, r"(?s)\$\$(?:\s+(?=\$\$)|\s*(\S.*?)\s*)\$\$", block)
    return F.regexp_replace(c, r"(?s)\\\[(?:\s+(?=\\\])|\s*(\S.*?)\s*)\\\]", block)


def title_of(c: Column) -> Column:
    return F.nullif(collapse(F.regexp_extract(c, r"\\title\{([^}]*)\}", 1)), F.lit(""))


def abstract_of(c: Column) -> Column:
    return F.nullif(collapse(F.regexp_extract(c, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)), F.lit(""))


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda an outer expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _zipped(c: Column, pattern: str, **groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])


HEAD_LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
HEAD = r"\\(section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}"
#: Stands before a heading and between heading and body; a private-use character that no text may hold.
MARK = "\ue020"


def sections_of(c: Column) -> Column:
    """array<struct<type, level, title, body>> in reading order; the body runs to the next heading of any level."""
    c = F.regexp_replace(F.replace(c, F.lit(MARK), F.lit("")), HEAD, f"{MARK}$1{MARK}$2{MARK}")
    level = lambda t: F.when(t == "section", 1).when(t == "subsection", 2).when(t == "subsubsection", 3).otherwise(4)
    head = lambda p, i: F.struct(F.get(p, 1 + i * 3).alias("type"), level(F.get(p, 1 + i * 3)).alias("level"), strip(F.get(p, 2 + i * 3)).alias("title"), F.get(p, 3 + i * 3).alias("body"))
    count = lambda p: F.floor((F.size(p) - 1) / 3).cast("int")
    empty = F.array().cast("array<struct<type:string,level:int,title:string,body:string>>")
    return bind(F.split(c, MARK), lambda p: F.when(count(p) > 0, F.transform(F.sequence(F.lit(0), count(p) - 1), lambda i: head(p, i))).otherwise(empty))


def is_reference_title(c: Column) -> Column:
    return strip(F.lower(c)).rlike("references|bibliography|works cited|literatur")


#: (environment, node type) in the order in which they are emitted.
ENVIRONMENTS = (("equation", "equation"), ("align", "equation"), ("gather", "equation"), ("multline", "equation"), ("eqnarray", "equation"), ("figure", "figure"), ("table", "table"), ("theorem", "theorem"), ("lemma", "lemma"), ("proof", "proof"), ("algorithm", "algorithm"))
STARRED = frozenset("equation align gather multline eqnarray figure table".split())
LISTS = ("itemize", "enumerate", "description")


def _env(name: str) -> str:
    star = r"\*?" if name in STARRED else ""
    return rf"(?s)\\begin\{{{name}{star}\}}(.*?)\\end\{{{name}{star}\}}"


#: What opens a reference section for environments and lists; it lasts to the next section or the text's end (fixed values).
_REFERENCES = r"(?i:\\section\*?\{(?:References|Bibliography|Works Cited)\}|\\begin\{thebibliography\})"
_EDGE, _INSIDE = "\ue021", "\ue022"


def mark_references(c: Column) -> Column:
    r"""The text with a mark after every ``\begin{..}`` that stands in a reference section, so that matches can be told by where they begin."""
    bare = F.regexp_replace(c, f"[{_EDGE}{_INSIDE}]", "")
    parts = F.split(F.regexp_replace(bare, rf"(?s){_REFERENCES}.*?(?=\\section\*?\{{|\z)", f"{_EDGE}$0{_EDGE}"), _EDGE)
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"\\begin\{[^}]*\}", f"$0{_INSIDE}")).otherwise(p))
    return F.when(c.rlike(_REFERENCES), F.array_join(marked, "")).otherwise(c)


def _bodies(c: Column, name: str) -> Column:
    """What stands between an environment's signs, for those that begin outside reference sections."""
    found = F.filter(F.regexp_extract_all(c, F.lit(_env(name)), F.lit(1)), lambda b: ~F.startswith(b, F.lit(_INSIDE)))
    return F.transform(found, lambda b: strip(F.replace(b, F.lit(_INSIDE), F.lit(""))))


def environments_of(c: Column) -> Column:
    """array<struct<kind_idx, type, content, caption, label, full_content>>, one environment kind after another; what begins in a
    reference section is left out. ``full_content`` keeps the first 500 characters of the body."""
    caption = lambda b: strip(F.regexp_extract(b, r"\\caption\{([^}]*)\}", 1))

    def made(n: int, kind: str):
        return lambda b: F.struct(F.lit(n).alias("kind_idx"), F.lit(kind).alias("type"), F.coalesce(F.nullif(caption(b), F.lit("")), F.substring(b, 1, 200)).alias("content"), caption(b).alias("caption"), F.regexp_extract(b, r"\\label\{([^}]*)\}", 1).alias("label"), F.substring(b, 1, 500).alias("full_content"))

    every = lambda t: F.concat(*[F.transform(_bodies(t, name), made(n, kind)) for n, (name, kind) in enumerate(ENVIRONMENTS)])
    return bind(mark_references(c), every)


def items_of(body: Column) -> Column:
    """Items of a list body longer than three characters, blanks collapsed."""
    pieces = F.split(body, r"\\item(?:\[[^\]]*\])?\s*")
    return bind(pieces, lambda p: F.filter(F.transform(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), collapse), lambda x: F.length(x) > 3))


def lists_of(c: Column) -> Column:
    """array<struct<kind_idx, type, items>> of the lists with at least one item, those in reference sections left out."""

    def made(n: int, name: str):
        return lambda b: F.struct(F.lit(n).alias("kind_idx"), F.lit(name).alias("type"), items_of(b).alias("items"))

    every = lambda t: F.concat(*[F.transform(F.filter(_bodies(t, name), lambda b: F.length(b) >= 5), made(n, name)) for n, name in enumerate(LISTS)])
    return F.filter(bind(mark_references(c), every), lambda x: F.size(x["items"]) > 0)


def body_text(c: Column) -> Column:
    """A section body as plain text: environments, lists, bibliography, headings and labels out, references and citations as marks."""
    for name in (*[e for e, _ in ENVIRONMENTS], *LISTS, "thebibliography"):
        c = F.regexp_replace(c, _env(name), "")
    c = F.regexp_replace(F.regexp_replace(c, HEAD, ""), r"\\label\{[^}]*\}", "")
    return collapse(F.regexp_replace(F.regexp_replace(c, r"\\ref\{[^}]*\}", "[ref]"), r"\\cite[a-z]*\{[^}]*\}", "[cite]"))


# Abbreviations whose period ends no sentence, as they are written after splitting (fixed values).
_ABBREVIATIONS = ("et al.", "i.e.", "e.g.", "vs.", "Fig.", "Eq.", "Ref.", "Sec.", "etc.", "Dr.", "Mr.", "Ms.", "Prof.")
_MATH, _DOT = "\ue00e", "\ue00f"


def sentences_of(c: Column, least: int = 5) -> Column:
    """array<string> of the sentences of at least ``least`` characters; formulas, abbreviations and decimals are kept whole, abbreviations
    in their usual spelling. Texts under ten characters have none."""
    formulas = F.regexp_extract_all(c, F.lit(r"\$[^$]+\$"), F.lit(0))
    held = F.regexp_replace(c, r"\$[^$]+\$", _MATH)
    for n, a in enumerate(_ABBREVIATIONS):
        pattern = a.replace(" ", r"\s+").replace(".", r"\.")
        held = F.regexp_replace(held, rf"(?i)(?<![{WORD}]){pattern}", chr(0xE010 + n))
    held = F.regexp_replace(held, r"(?<=[0-9])\.(?=[0-9])", _DOT)
    def restore(p: Column) -> Column:
        for n, a in enumerate(_ABBREVIATIONS):
            p = F.replace(p, F.lit(chr(0xE010 + n)), F.lit(a))
        return F.replace(p, F.lit(_DOT), F.lit("."))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def fold(x: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            filled = bind(F.split(piece, _MATH, -1), lambda parts: F.array_join(F.transform(parts, lambda q, i: F.when(i == 0, q).otherwise(F.concat(F.coalesce(F.get(x["formulas"], state["used"] + i - 1), F.lit("")), q))), ""))
            # formulas of dropped fragments count too; the text is judged as it stands while they are held
            out = F.when(F.length(piece) >= least, F.concat(state["out"], F.array(restore(filled)))).otherwise(state["out"])
            return F.struct(out.alias("out"), (state["used"] + F.regexp_count(piece, F.lit(_MATH))).alias("used"))

        return F.aggregate(x["pieces"], start, step, lambda st: st["out"])

    pieces = F.transform(F.split(held, r"(?<=[.!?])\s+(?=[A-Z]|$)"), strip)
    whole = bind(F.struct(formulas.alias("formulas"), pieces.alias("pieces")), fold)
    return F.when(F.length(strip(c)) >= 10, whole).otherwise(F.array().cast("array<string>"))


def bibitems_of(c: Column) -> Column:
    """array<struct<label, key, body>> of the bibitems, up to the next one, the environment's end or the text's end."""
    pattern = r"(?s)\\bibitem(?:\[([^\]]*)\])?\{([^}]+)\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|\z)"
    return F.transform(_zipped(c, pattern, label=1, key=2, body=3), lambda x: F.struct(x["label"].alias("label"), strip(x["key"]).alias("key"), strip(x["body"]).alias("body")))


def bib_entry_of(body: Column) -> Column:
    """struct<title, authors, year, arxiv_id, raw_content> of a bibitem body: authors before the first period, title before the second."""
    plain = F.regexp_replace(body, r"\\newblock\s*", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\{\\em\s+([^}]*)\}", "$1"), r"\\emph\{([^}]*)\}", "$1")
    parts = F.split(plain, r"\.", -1)
    dotted = F.contains(plain, F.lit("."))
    people = F.when(dotted, F.get(parts, F.lit(0))).otherwise(F.substring(plain, 1, 100))
    authors = F.slice(F.filter(F.transform(F.split(people, r"\s+and\s+|,\s*(?=[A-Z])"), strip), lambda a: (F.length(a) > 2) & ~F.startswith(a, F.lit("\\"))), 1, 10)
    return F.struct(F.when(dotted, strip(F.get(parts, F.lit(1)))).otherwise(F.lit("")).alias("title"), authors.alias("authors"), F.coalesce(year_of(plain), F.lit("")).alias("year"), F.coalesce(arxiv_of(plain), F.lit("")).alias("arxiv_id"), F.substring(plain, 1, 500).alias("raw_content"))


# Journals as they are printed (fixed values).
_JOURNALS = (r"Physical Review [A-Z]+", r"Phys\.\s*Rev\.\s*[A-Z]+", r"Nature\s*\w*", r"Science\s*\w*", r"Journal of [^,.]+", r"J\.\s*[A-Z][a-z]+\.?\s*[A-Z]?[a-z]*\.?", r"Proceedings of [^,.]+", r"Proc\.\s*[^,.]+", r"IEEE [^,.]+", r"ACM [^,.]+", r"arXiv preprint")


def bibtex_of(key: Column, body: Column) -> Column:
    """struct of a BibTeX record read from a printed reference; fields not found are ""."""
    some = lambda p, g=1: F.nullif(F.regexp_extract(body, p, g), F.lit(""))
    volume = some(rf"(?<![{WORD}])([0-9]+)[:\s]*([0-9]+[-–][0-9]+)(?![{WORD}])")
    pages = F.when(volume.isNotNull(), some(rf"(?<![{WORD}])([0-9]+)[:\s]*([0-9]+[-–][0-9]+)(?![{WORD}])", 2)).otherwise(some(rf"(?<![{WORD}])(?:pp?\.\s*)?([0-9]+[-–][0-9]+)(?![{WORD}])"))
    quoted = F.coalesce(some(r"[\"“]([^\"”]+)[\"”]"), some(r"\\textit\{([^}]+)\}"), some(r"\\emph\{([^}]+)\}"))
    parts = F.split(body, r"\.\s+", -1)
    title = F.coalesce(strip(quoted), F.when(F.size(parts) >= 2, strip(F.get(parts, F.lit(1)))), F.lit(""))
    before = F.regexp_replace(strip(F.substring(body, F.lit(1), F.greatest(F.position(strip(quoted), body) - 1, F.lit(0)))), r"[,\s]+$", "")
    author = F.when(quoted.isNotNull(), before).when(F.size(parts) >= 2, strip(F.get(parts, F.lit(0)))).otherwise(F.lit(""))
    low = F.lower(body)
    kind = F.when(low.rlike("proceedings|conference"), "inproceedings").when(low.rlike("book|press"), "book").when(F.contains(low, F.lit("arxiv")), "misc").when(F.contains(low, F.lit("thesis")), "phdthesis").otherwise("article")
    arxiv = F.coalesce(some(r"(?i)arxiv[:\s]*([0-9]{4}\.[0-9]{4,5})"), some(rf"(?<![{WORD}])([0-9]{{4}}\.[0-9]{{4,5}})(?![{WORD}])"), F.lit(""))
    none = F.lit("")
    return F.struct(
        kind.alias("type"), key.alias("key"), author.alias("author"), title.alias("title"), F.coalesce(year_of(body), none).alias("year"), F.coalesce(*[some(f"({j})") for j in _JOURNALS], none).alias("journal"),
        F.coalesce(volume, none).alias("volume"), F.replace(F.coalesce(pages, none), F.lit("–"), F.lit("-")).alias("pages"), doi_of(body).alias("doi"), arxiv.alias("arxiv"),
    )


def bibtex_text(record: Column) -> Column:
    """A record as BibTeX text: fields in fixed order, blank ones left out, braces escaped, the arXiv id as eprint."""
    names = (("author", "author"), ("title", "title"), ("journal", "journal"), ("year", "year"), ("volume", "volume"), ("pages", "pages"), ("doi", "doi"), ("arxiv", "eprint"))
    escape = lambda c: F.regexp_replace(c, r"([{}])", r"\\$1")
    lines = F.array_compact(F.array(*[F.when(record[f] != "", F.concat(F.lit(f"  {n} = {{"), escape(record[f]), F.lit("}"))) for f, n in names]))
    return F.concat(F.lit("@"), record["type"], F.lit("{"), record["key"], F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def bib_file_entries(c: Column) -> Column:
    """array<struct<key, fields map, raw>> of a .bib text; values end at the first brace or quote; of repeated fields the last counts."""
    found = _zipped(c, r"(?s)(@\w+\{([^,]+),\s*(.*?)\n\})", raw=1, key=2, body=3)

    def entry(x: Column) -> Column:
        pattern = r"(?s)(\w+)\s*=\s*[{\"]([^}\"]*)[}\"]"
        keys = F.transform(F.regexp_extract_all(x["body"], F.lit(pattern), F.lit(1)), F.lower)
        values = F.transform(F.regexp_extract_all(x["body"], F.lit(pattern), F.lit(2)), strip)
        fields = F.arrays_zip(keys.alias("k"), values.alias("v"))
        get = lambda n: F.aggregate(fields, F.lit(""), lambda acc, p: F.when(p["k"] == n, p["v"]).otherwise(acc))
        return F.struct(strip(x["key"]).alias("key"), get("title").alias("title"), get("author").alias("author"), get("year").alias("year"), F.coalesce(F.nullif(get("journal"), F.lit("")), get("booktitle")).alias("venue"), F.replace(F.coalesce(F.nullif(get("eprint"), F.lit("")), get("arxiv")), F.lit("."), F.lit("-")).alias("arxiv_id"), F.substring(x["raw"], 1, 500).alias("raw_content"))

    return F.transform(found, entry)


# The extractor's own headings with their levels, and its environments of displayed formulas (fixed values).
EXTRACTOR_LEVELS = {"section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
DISPLAYED = ("equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "displaymath", "split", "aligned", "gathered", "cases", "array")


def extractor_elements(c: Column) -> Column:
    """array<struct<type, shown, content, level, label>> of a cleaned text in the extractor's order: title, abstract, headings, figures,
    displayed formulas. ``shown`` is what an element's identity is taken from."""
    row = lambda kind, shown, content, level, label=None: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), shown.alias("shown"), content.alias("content"), (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"), (F.lit("") if label is None else label).alias("label"))
    label = lambda b: F.regexp_extract(b, r"\\label\{([^}]*)\}", 1)
    only = lambda kind, found: F.filter(F.transform(found, lambda t: row(kind, clean_latex(t), clean_latex(t), 1)), lambda e: e["content"] != "")
    title = only("title", F.slice(F.regexp_extract_all(c, F.lit(r"\\title\{([^}]*)\}"), F.lit(1)), 1, 1))
    abstract = only("abstract", F.slice(F.regexp_extract_all(c, F.lit(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"), F.lit(1)), 1, 1))
    level = lambda t: F.element_at(F.create_map(*[F.lit(x) for pair in EXTRACTOR_LEVELS.items() for x in pair]), t)
    heads = F.transform(_zipped(c, rf"\\({'|'.join(EXTRACTOR_LEVELS)})\*?\{{([^}}]*)\}}", type=1, title=2), lambda s: row(s["type"], clean_latex(s["title"]), clean_latex(s["title"]), level(s["type"])))
    caption = lambda b: F.regexp_extract(b, r"\\caption\{([^}]*)\}", 1)
    figures = F.transform(F.regexp_extract_all(c, F.lit(_env("figure")), F.lit(1)), lambda b: row("figure", F.coalesce(F.nullif(clean_latex(caption(b)), F.lit("")), F.substring(b, 1, 50)), clean_latex(caption(b)), 4, label(b)))
    made = lambda b: row("equation", F.substring(b, 1, 50), b, 4, label(b))
    formulas = [F.transform(F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)\\begin\{{{n.replace('*', r'\*')}\}}(.*?)\\end\{{{n.replace('*', r'\*')}\}}"), F.lit(1)), strip), made) for n in DISPLAYED]
    return F.concat(title, abstract, heads, figures, *formulas)


def cited_keys_of(c: Column) -> Column:
    keys = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\\cite[a-z]*\{([^}]+)\}"), F.lit(1)), lambda k: F.transform(F.split(k, ","), strip)))
    return F.filter(keys, lambda k: k != "")
