import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import markup as K

MARKED = [
    r"a \emph{b} c", r"5\% more", r"toutes~\cite{k1} les", "x <sup>2</sup>", "a &nbsp; b", "3&#8211;5", "the **fast** way", "an `x=1` test", "see [[Page|text]]", "a [link](/n/1)", "now{{cn}} then", "'''all''' of", "== Head ==", "# Head\ntext", "Head\n======",
    "- one\n- two", "> quoted line", "$\\lambda_7$ small", "with $O(n^2)$ terms", r"\( a^2 \)", "{| class=\"t\"\n|-\n| a || b\n|}", "``Title,'' he wrote", r"{\it Journal} 7", "```python\nx\n```", "a _soft_ word", r"G\"odel", "<pre><code>x</code></pre>",
]
PLAIN = [
    "p < 0.05 and n > 10", "y * b * n = 6", "5 * 7 tiles and 3 * 2", "costs $46 in May and $46.50 in June", "the set {a, b} and the rest", "uses C# and #9 ranked", "Let x ~ y mean", "run_48_v6.log", "R&D on it", "as shown in [48].", "74.4% complete", "w(n) < 2 d for all n > 2", "Tarn & Fell", "a | b", "", "   ", "plain text", "'quoted' words", 'or: "What Next?"',
]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    assert K.marked(text), text


@pytest.mark.parametrize("text", PLAIN)
def test_plain_stays(text):
    assert not K.marked(text), text
    assert K.clean(text) == text.strip()


@pytest.mark.parametrize("text,want", [
    (r"a \emph{b} c~\cite{k}.", "a b c ."), ("<h2>Head</h2><ul><li>one</li><li>two</li></ul>", "## Head\n\n- one\n- two"), ("Head\n====\n\ntext", "# Head\n\ntext"), (r"\section{Intro} Text", "# Intro\n Text"), ("see [[Page|text]] and [link](/x)", "see text and link"),
    (r"\[ x^2 \]", "$$x^2$$"), (r"\begin{equation}x\end{equation}", "$$x$$"), ("<math>x</math>", "$x$"), ("<pre><code>go(1)</code></pre>", "```\ngo(1)\n```"), ("A &amp; B 3&#8211;5", "A & B 3–5"), (r"caf\'e", "café"), (r"{\em Title} 5\%", "Title 5%"), ("{{cite paper|last=A|year=1990}}", "A. 1990"),
])
def test_structure_is_kept(text, want):
    assert K.clean(text) == want


@given(st.text(alphabet="ab {}\\$*_`<>/&;[]()|~'\n-=#", max_size=40))
def test_any_text_is_handled(text):
    K.marked(text)
    K.clean(text)


def test_marginals_equal_enumeration():
    import itertools
    import math

    nodes = K.tree_of(r"\emph{a {b} \textbf{c~d}} {e <i>f</i>}")
    page = K.MODEL.marginals(nodes)
    total, ones, marked = 0.0, [0.0] * len(nodes), 0.0
    for root, *states in itertools.product((0, 1), repeat=len(nodes) + 1):
        p = K.MODEL.root[root]
        for n, s in zip(nodes, states):
            above, kind = (root, "page") if n.parent < 0 else (states[n.parent], nodes[n.parent].kind)
            p += K.MODEL.own_of(n)[s] + K.MODEL.pair_of(kind, n.name)[above][s]
        total += math.exp(p)
        marked += math.exp(p) * root
        for i, s in enumerate(states):
            ones[i] += math.exp(p) * s
    assert all(abs(n.marginal - o / total) < 1e-9 for n, o in zip(nodes, ones)) and abs(page - marked / total) < 1e-9


def test_long_signs_are_nodes():
    long = "word " * 300
    for sign in ("**", "*", "$", "`", "'''", "__", "_"):
        assert K.marked(f"a {sign}{long}x{sign} b"), sign
    assert not K.marked("**" + "a " * 50_000)


def test_over_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a **b**", "x"), (1, "a **b**", "x"), (2, None, "x"), (3, "", "x"), (4, "p < 3", "x"), (5, "x" * 100_000 + " <b>y</b>", "x"), (None, "**b**", "x")]
    df = spark.createDataFrame(rows, "id bigint, content string, marked string")
    fields = K.field_rows(df, "t", F.col("id"), "content")
    assert {r["record_key"] for r in K.with_markup(fields).collect()} == {"1", "5"}
    assert {r["record_key"]: r["clean_text"] for r in K.cleaned(fields).where("record_key in ('1', '4')").collect()} == {"1": "a b", "4": "p < 3"}
    assert K.with_markup(fields.limit(0)).count() == 0
