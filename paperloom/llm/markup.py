"""Markup residue in texts: HTML, Markdown, wiki and LaTeX to clean text that keeps headings, lists, code blocks and formulas.

Every sign that may be markup becomes a node of the page's tree: tags, environments, commands with an argument and brace
groups hold the nodes inside them, the page holds the rest. A node is markup or plain, the page marked or not. A node's own potential comes
from its kind and whether it is closed, the potentials between parent and child from how often their states go together for the
parent's kind and the child's name, both counted in labelled pages: hand-labelled lines and a bounded sample of the texts at hand, labelled where their structure agrees with itself.
Sum-product messages run from the leaves up to the page and down again; a node is taken for markup if its marginal is over one half.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spread import spread

_NODE = re.compile(
    r"""
  (?=[\\<{}*_`$~&\[!|\#='+>-]|(?<=\n)[ \t])(?:
  (?P<fence>^```[^\n]*\n.*?(?:^```[ \t]*$|\Z)|\\begin\{(?:verbatim|lstlisting)\}.*?\\end\{(?:verbatim|lstlisting)\})
| (?P<comment><!--.*?-->)
| (?P<math>\$\$[^$]+\$\$|(?<![\\$])\$(?=[^\s$])[^$\n]+(?<=[^\s\\])\$(?!\d)|\\\(.+?\\\)|\\\[.+?\\\]|<math\b[^<>]*>.*?</math>|\\begin\{(?P<env>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}.*?\\end\{(?P=env)\})
| (?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)
| (?P<entity>&(?:\#[0-9]{1,7}|\#x[0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)
| (?P<begin>\\begin\{[A-Za-z]+\*?\}(?:\[[^\[\]]*\])?(?:\{[^{}]*\})?)
| (?P<end>\\end\{[A-Za-z]+\*?\})
| (?P<command>\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{?)
| (?P<accent>\\["'`^~=.][A-Za-z]|\\["'`^~=.]\{[A-Za-z]\})
| (?P<escape>\\[^A-Za-z0-9\s])
| (?P<wikilink>\[\[[^\[\]\n]+\]\])
| (?P<link>!?\[[^\[\]\n]+\]\([^()\s]*\))
| (?P<template>\{\{[^{}]*\}\})
| (?P<table>^\{\|[^\n]*|^\|[-}+][^\n]*|^[|!][ ][^\n]*)
| (?P<heading>^[ ]{0,3}\#{1,6}[ ][^\n]*|^(?P<eq>={1,6})[ ]*[^=\n]+?[ ]*(?P=eq)[ \t]*$)
| (?P<underline>(?<=\n)(?:={3,}|-{3,})[ \t]*$)
| (?P<bullet>^[ \t]*[*+>-][ \t]+(?=\S)|^[*\#]{1,3}[ ]+(?='''))
| (?P<strong>\*\*(?=[^\s*])(?:(?!\*\*|\n[ \t]*\n).)+(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])(?:(?!__|\n[ \t]*\n).)+(?<=[^\s_])__(?!\w)|'''(?=[^\s'])(?:(?!'''|\n[ \t]*\n).)+(?<=[^\s'])''')
| (?P<emph>(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<!\w)_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?!\w)|(?<!')''(?=[^\s'])[^'\n]+(?<=[^\s'])''(?!'))
| (?P<quote>``(?=\S)|(?<=\S)'')
| (?P<code>`[^`\n]+`)
| (?P<tie>(?<=\S)~(?=[\w\\(\[$]))
| (?P<open>\{)
| (?P<close>\})
  )""",
    re.X | re.S | re.M,
)
#: Texts without any of these signs hold no node; the JVM leaves them out before Python sees a row.
CANDIDATE = r"[\\<>{}*_`$~]|&#?[A-Za-z0-9]+;|\[\[|\]\(|''|(?m:^[ \t]*[-+#=|!])"
_TAGS = frozenset("a abbr b blockquote body br caption cite code dd del div dl dt em font h1 h2 h3 h4 h5 h6 head hr html i img ins kbd li math mark nowiki ol p pre q ref s section small span strike strong sub sup table tbody td th thead title tr tt u ul var".split())
_MONEY = re.compile(r"\$\d[\d.,]*\s.*[^\W\d_]{2}", re.S)
_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "title": 1}
_SILENT = frozenset("cite citep citet citeauthor citeyear label ref eqref pageref bibitem bibliographystyle bibliography vspace hspace includegraphics usepackage documentclass footnotemark index".split())

# Labelled pages: 1, every node of the page is markup; 0, the same signs in their plain meaning.
LABELLED_PAGES: tuple[tuple[int, str], ...] = (
    (1, r"The \emph{proof} is {\bf short} and \textit{clear}."), (1, r"\section{Results}\label{s1} We \textbf{show} it~\cite{a} at 5\% \& more."),
    (1, r"\begin{itemize} \item one \item two {\em now} \end{itemize}"), (1, r"\begin{equation}x_{1}^{2} \le \frac{a}{b}\end{equation}"), (1, r"\bibitem{b1} A. Name, {\it Journal} 7~(2001)"),
    (1, r"``Title,'' {\sl Journal} 3~(1999) \newblock more"), (1, r"G{\"o}del and Erd\H{o}s, caf\'e"), (1, r"\subsection*{Setup {A}}"), (1, r"A \textsc{Name}, \doi{10.1/x}, 2001\%"),
    (1, "<p>One <b>two</b> <i>three</i></p><ul><li>item</li></ul><br/>"), (1, '<a href="/x">link</a> and <sup>1</sup> &nbsp; x&#8211;y &amp; z'), (1, "<h2>Head</h2><pre><code>x = {1}</code></pre>"), (1, '<span class="q">word</span> <sub>2</sub> <ref>note</ref>'),
    (1, "# Head\n\n- one\n- **two** and *three*\n> quoted\n"), (1, "Text with `code`, __bold__, _soft_ and [link](/n/1)."), (1, "Head\n====\n\n```python\nfor k in {1}:\n    go(k)\n```\n"), (1, "* one\n* two\n* three"), (1, "> A quoted line\n> goes on"), (1, "- first\n- second"),
    (1, "== Head ==\n'''bold''' and ''soft'' [[page|text]] {{cn}}"), (1, "{{cite paper|last=A|year=1990}}"), (1, '{| class="t"\n|-\n| a || b\n|}'), (1, "* '''one'''\n# '''two'''"), (1, "=== Deep ===\n[[Target]]"),
    (1, r"The bound is $x_1$ or $O(n^2)$ and $\lambda$."), (1, r"Let $$\sum_{i=1}^{n} x_i$$ be."), (1, r"Then \( a^2 \) and \[ b \le c \] hold."), (1, "<math>x^2</math> of a $k$-graph"), (1, r"We take {\tt x} and {\large big}."),
    (0, "The set {a, b} and the set {1, 2, 3} are equal."), (0, "Take {x} as any member and {y, z} as a pair."), (0, "A price of $5 in May and $6.50 in June."), (0, "It costs $40 a day and then $45 a day."), (0, "We paid $3 for one and $4.20 for two."), (0, "Pairs {p, q} are drawn; the rest {r} stays."),
    (0, "Budgets of $12 million and $15 million were set."), (0, "an open { without its partner"), (0, "a lone } here"), (0, "if x <y and z> w hold then"), (0, "values a <b and b> c are sorted"), (0, "the sets {u, v} and {w}"),
)


class Node:
    __slots__ = ("kind", "name", "start", "end", "parent", "children", "tail", "holds", "up", "marginal")

    def __init__(self, kind: str, name: str, start: int, end: int, parent: int) -> None:
        self.kind, self.name, self.start, self.end, self.parent = kind, name, start, end, parent
        self.children: list[int] = []
        self.tail = (-1, -1)  # the closing sign
        self.holds = False
        self.up = (0.0, 0.0)
        self.marginal = 0.0

    @property
    def form(self) -> str:
        return "whole" if not self.holds else "closed" if self.tail[0] >= 0 else "unclosed"


def tree_of(text: str) -> list[Node]:
    """The nodes in reading order; parent -1 is the page itself."""
    nodes: list[Node] = []
    stack: list[int] = []
    for m in _NODE.finditer(text):
        kind = {"eq": "heading", "env": "math"}.get(m.lastgroup, m.lastgroup)
        sign, (start, end) = m.group(), m.span()
        name, holds = kind, False
        if kind == "tag":
            tag = re.match(r"</?([A-Za-z0-9]+)", sign).group(1).lower()
            name = "tag" if tag in _TAGS else "tag:other"
            if sign[1] == "/":
                for at in range(len(stack) - 1, -1, -1):
                    if nodes[stack[at]].kind == "tag" and nodes[stack[at]].name == name and text[nodes[stack[at]].start + 1 : nodes[stack[at]].start + 1 + len(tag)].lower() == tag:
                        nodes[stack[at]].tail = (start, end)
                        del stack[at:]
                        break
            else:
                holds = tag not in ("br", "hr", "img", "li", "p") and not sign.endswith("/>")
        elif kind == "math":
            name = "math:money" if _MONEY.match(sign) else "math"
        elif kind == "entity":
            name = "entity" if html.unescape(sign) != sign else "entity:other"
        elif kind in ("begin", "open"):
            holds = True
        elif kind == "command":
            holds = sign[-1] == "{"
        elif kind == "end":
            for at in range(len(stack) - 1, -1, -1):
                if nodes[stack[at]].kind == "begin":
                    nodes[stack[at]].tail = (start, end)
                    del stack[at:]
                    break
        elif kind == "close":
            if stack and nodes[stack[-1]].kind in ("open", "command"):
                nodes[stack[-1]].tail = (start, end)
                stack.pop()
                continue
        parent = stack[-1] if stack else -1
        if parent >= 0:
            nodes[parent].children.append(len(nodes))
        nodes.append(Node(kind, name, start, end, parent))
        if holds:
            nodes[-1].holds = True
            stack.append(len(nodes) - 1)
    for node in nodes:
        if node.kind == "open" and node.children and node.end == nodes[node.children[0]].start:
            node.name = "open:command"  # {\em ...}
    return nodes


#: Labelled texts drawn from the input to fit the model; a bound, not a share: more texts hardly change the counts.
SAMPLE_TEXTS = 2000
#: Weight of one hand-labelled node, in nodes of sampled texts.
HAND_WEIGHT = 20.0
# Kinds whose signs also stand in plain text.
_OPEN_KINDS = frozenset(("open", "math:money", "tag:other", "entity:other"))


def self_labels(nodes: list[Node]) -> list[int | None]:
    """Labels of a text's nodes where its structure agrees: a sign that has the form of markup and one inside it is markup, in a text
    without any such sign every sign is plain, and the rest is left open."""
    evident = [n.name not in _OPEN_KINDS for n in nodes]
    if not any(evident):
        return [0] * len(nodes)
    labels: list[int | None] = []
    for n, e in zip(nodes, evident):
        labels.append(1 if e or n.parent >= 0 and labels[n.parent] == 1 else None)
    return labels


class TreeModel:
    """Potentials counted in labelled pages, with half a count added everywhere; a kind or pair of kinds never seen falls back on
    the kind without its form, then on even odds."""

    def __init__(self, pages: tuple[tuple[int, str], ...] = LABELLED_PAGES, sample: list[str] = ()) -> None:
        self.own_counts: dict[str, list[float]] = {}
        self.pair_counts: dict[tuple[str, str], list[list[float]]] = {}
        self.root_counts = [0.5, 0.5]
        for label, text in pages:
            nodes = tree_of(text)
            self._count(nodes, [label] * len(nodes), label, HAND_WEIGHT)
        for text in sample:
            nodes = tree_of(text)
            if nodes:
                labels = self_labels(nodes)
                self._count(nodes, labels, int(1 in labels), 1.0)
        log = lambda c: (math.log(c[0] / (c[0] + c[1])), math.log(c[1] / (c[0] + c[1])))
        self.own = {k: log(c) for k, c in self.own_counts.items()}
        self.pair = {k: [log(row) for row in c] for k, c in self.pair_counts.items()}
        self.root = log(self.root_counts)
        self.even = (math.log(0.5), math.log(0.5))
        self.even_pair = [self.even, self.even]

    def _count(self, nodes: list[Node], labels: list[int | None], page: int, weight: float) -> None:
        self.root_counts[page] += weight
        for n, label in zip(nodes, labels):
            if label is None:
                continue
            for name in (n.name, f"{n.name} {n.form}"):
                self.own_counts.setdefault(name, [0.5, 0.5])[label] += weight
            above = page if n.parent < 0 else labels[n.parent]
            if above is not None:
                kind = "page" if n.parent < 0 else nodes[n.parent].kind
                self.pair_counts.setdefault((kind, n.name), [[0.5, 0.5], [0.5, 0.5]])[above][label] += weight

    def own_of(self, n: Node) -> tuple[float, float]:
        return self.own.get(f"{n.name} {n.form}") or self.own.get(n.name, self.even)

    def pair_of(self, parent: str, name: str) -> list[tuple[float, float]]:
        return self.pair.get((parent, name), self.even_pair)

    def marginals(self, nodes: list[Node], messages: bool = True) -> float:
        """Sum-product over the tree; gives the page's own marginal. Parents stand before their children, so one pass backward and one
        forward do it. Without messages every node is judged alone."""
        belief = [self.own_of(n) for n in nodes]
        page = self.root
        if messages:
            pairs = [self.pair_of("page" if n.parent < 0 else nodes[n.parent].kind, n.name) for n in nodes]
            for i in range(len(nodes) - 1, -1, -1):
                n = nodes[i]
                ((p00, p01), (p10, p11)), (a, b) = pairs[i], belief[i]
                n.up = (_add(p00 + a, p01 + b), _add(p10 + a, p11 + b))
                if n.parent >= 0:
                    x, y = belief[n.parent]
                    belief[n.parent] = (x + n.up[0], y + n.up[1])
                else:
                    page = (page[0] + n.up[0], page[1] + n.up[1])
            for i, n in enumerate(nodes):
                ((p00, p01), (p10, p11)), (a, b) = pairs[i], belief[i]
                x, y = belief[n.parent] if n.parent >= 0 else page
                x, y = x - n.up[0], y - n.up[1]
                belief[i] = (a + _add(x + p00, y + p10), b + _add(x + p01, y + p11))
        for n, (a, b) in zip(nodes, belief):
            n.marginal = _share(a, b)
        return _share(*page)


def _share(a: float, b: float) -> float:
    return 1 / (1 + math.exp(max(-700.0, min(700.0, a - b))))


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


MODEL = TreeModel()


def marked(text: str, model: TreeModel = MODEL) -> bool:
    nodes = tree_of(text)
    if not nodes:
        return False
    model.marginals(nodes)
    return any(n.marginal > 0.5 for n in nodes)


_PRE_BEFORE, _PRE_AFTER = re.compile(r"<pre[^<>]*>\s*\Z", re.I), re.compile(r"\s*</pre>", re.I)
_MARKS = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "=": "̄", ".": "̇"}


def clean(text: str, model: TreeModel = MODEL) -> str:
    """Clean text: headings as ``# ``, list items as ``- ``, code in fences or backquotes, formulas in ``$`` or ``$$``."""
    if "\\begin{tabular" in text:
        text = re.sub(r"(?<!\\)&(?![#\w]+;)", "|", text)
    out = _convert(text, model)
    out = re.sub(r"[ \t]+(?=\n)", "", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _convert(text: str, model: TreeModel = MODEL) -> str:
    nodes = tree_of(text)
    if not nodes:
        return text
    model.marginals(nodes)
    edits: list[tuple[int, int, str]] = []
    for n in nodes:
        if n.marginal > 0.5:
            sign = text[n.start : n.end]
            if n.kind == "underline":  # the line above is the heading
                line = text.rfind("\n", 0, n.start - 1) + 1
                edits.append((line, line, "# " if sign[0] == "=" else "## "))
            head, tail = _replace(n, sign, text, model)
            edits.append((n.start, n.end, head))
            if n.tail[0] >= 0 and n.kind in ("open", "command"):
                edits.append((*n.tail, tail))
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            out += (text[at:start], new)
            at = end
    return "".join(out) + text[at:]


def _replace(n: Node, sign: str, text: str, model: TreeModel) -> tuple[str, str]:
    """What stands for a node's opening sign and, if it holds others, for its closing one."""
    kind = n.kind
    if kind == "fence":
        return re.sub(r"^\\begin\{\w+\}\n?(.*?)\n?\\end\{\w+\}$", r"```\n\1\n```", sign, flags=re.S), ""
    if kind == "math":
        if sign.startswith("<"):
            return f"${re.sub(r'^<[^<>]*>|</math>$', '', sign).strip()}$", ""
        if sign.startswith(r"\begin"):
            return f"$${re.sub(r'^.begin{[^{}]*}|.end{[^{}]*}$', '', sign).strip()}$$", ""
        block = sign.startswith(("$$", r"\["))
        inner = sign.strip("$") if sign[0] == "$" else sign[2:-2]
        return (f"$${inner.strip()}$$" if block else f"${inner.strip()}$"), ""
    if kind == "tag":
        tag = re.match(r"</?([A-Za-z0-9]+)", sign).group(1).lower()
        closing = sign[1] == "/"
        if re.fullmatch(r"h[1-6]", tag):
            return ("\n" if closing else f"\n{'#' * int(tag[1])} "), ""
        if tag == "pre":
            return ("\n```\n" if not closing else "\n```\n"), ""
        if tag == "code":
            return ("" if _PRE_BEFORE.search(text, max(0, n.start - 200), n.start) or closing and _PRE_AFTER.match(text, n.end) else "`"), ""
        if tag == "li":
            return ("" if closing else "\n- "), ""
        if tag in ("p", "br", "div", "tr", "ul", "ol", "table", "blockquote", "hr", "section"):
            return "\n", ""
        return (" | " if tag in ("td", "th") and not closing else ""), ""
    if kind in ("entity", "comment"):
        return (html.unescape(sign) if kind == "entity" else ""), ""
    if kind in ("begin", "end"):
        env = re.search(r"\{([A-Za-z]+)", sign).group(1)
        return ("\n" if env else ""), ""
    if kind == "command":
        name = re.match(r"\\([A-Za-z]+)", sign).group(1)
        holds = sign.endswith("{")
        inside = n.parent >= 0
        if name in _HEADS and holds:
            return f"\n{'#' * _HEADS[name]} ", "\n"
        if name == "item":
            return "\n- ", ""
        if name in _SILENT and holds and n.tail[0] >= 0:
            n.end = n.tail[1]
            return "", ""
        if name in ("hline", "newline", "par"):
            return "\n" if name != "hline" else "", ""
        if not holds and text[n.end : n.end + 1] == " ":
            n.end += 1  # the blank that ends a command's name
        if holds or name in ("em", "bf", "it", "tt", "sl", "sc", "rm", "sf", "large", "small", "newblock", "noindent", "centering"):
            return "", ""
        return (sign if inside else ""), ""
    if kind == "accent":
        letter = re.search(r"[A-Za-z]", sign).group()
        return unicodedata.normalize("NFC", letter + _MARKS[sign[1]]), ""
    if kind == "escape":
        return ("\n" if sign == "\\\\" else " " if sign[1] in ",;! " else sign[1]), ""
    if kind == "wikilink":
        return _convert(sign[2:-2].rsplit("|", 1)[-1], model), ""
    if kind == "link":
        return _convert(re.match(r"!?\[(.*)\]\(", sign, re.S).group(1), model), ""
    if kind == "template":
        parts = sign[2:-2].split("|")[1:]
        return ". ".join(p.split("=", 1)[-1].strip() for p in parts), ""
    if kind == "table":
        cells = re.sub(r"^[|!][-}+]?[^\n|]*$|^\{\|[^\n]*|^[|!][-}+]?\s*", lambda m: "" if m.group().startswith(("{|", "|-", "|}")) else m.group().lstrip("|! "), sign)
        return re.sub(r"\s*(?:\|\||!!)\s*", " | ", cells), ""
    if kind == "heading":
        level = len(re.match(r"\s*([#=]+)", sign).group(1))
        return f"{'#' * level} {_convert(sign.strip().strip('#=').strip(), model)}", ""
    if kind == "underline":
        return "", ""
    if kind == "bullet":
        return ("" if sign.strip() == ">" else "- "), ""
    if kind in ("strong", "emph"):
        return _convert(re.sub(r"^(\*\*|__|'''|\*|_|'')(.*)\1$", r"\2", sign, flags=re.S), model), ""
    if kind == "code":
        return sign, ""
    if kind == "quote":
        return '"', ""
    return (" ", "") if kind == "tie" else ("", "")


def fitted(fields: DataFrame) -> TreeModel:
    """The model with a sample of at most SAMPLE_TEXTS texts, the first in the order of a hash of their keys."""
    maybe = fields.where(F.col("t").rlike(CANDIDATE)).select("t", F.xxhash64("table_name", "record_key", "t").alias("h"))
    return TreeModel(sample=[r["t"] for r in maybe.orderBy("h").limit(SAMPLE_TEXTS).collect()])


def _map_texts(rows: DataFrame, model: TreeModel, convert: bool) -> DataFrame:
    """(table_name, record_key, t) -> the same rows with (marked, clean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            flags = [marked(t, model) for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array(flags, pa.bool_())]
            if convert:
                columns.append(pa.array([clean(t, model) if f else t for f, t in zip(flags, texts)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["table_name", "record_key", "marked", "clean_text"][: len(columns)])

    return rows.mapInArrow(run, "table_name string, record_key string, marked boolean" + ", clean_text string" * convert)


def field_rows(rows: DataFrame, table_name: str, key: Column, content: str) -> DataFrame:
    return rows.select(F.lit(table_name).alias("table_name"), key.cast("string").alias("record_key"), F.col(content).alias("t")).where("record_key is not null and t is not null")


def with_markup(fields: DataFrame) -> DataFrame:
    """field_rows -> distinct (table_name, record_key) whose field holds markup; null, empty and blank fields hold none."""
    found = _map_texts(spread(fields.where(F.col("t").rlike(CANDIDATE))), fitted(fields), convert=False)
    return found.where("marked").select("table_name", "record_key").distinct()


def cleaned(fields: DataFrame) -> DataFrame:
    """field_rows -> (table_name, record_key, marked, clean_text), row by row; a text without markup stays as it is."""
    maybe = F.col("t").rlike(CANDIDATE)
    plain = fields.where(~maybe).select("table_name", "record_key", F.lit(False).alias("marked"), F.col("t").alias("clean_text"))
    return plain.unionByName(_map_texts(spread(fields.where(maybe)), fitted(fields), convert=True))
