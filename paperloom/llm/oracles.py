"""SQL statements of what the queries of this subpackage return, where SQL can state it."""

from __future__ import annotations

from paperloom.llm import truncation as T


def _regex(pattern: str) -> str:
    return pattern.replace("'", "''")


def _truncation() -> str:
    blanks = "".join(sorted(set(T._BLANKS)))
    plain = f"translate(translate(text, '{T._LINE_ENDS}', repeat(chr(10), {len(T._LINE_ENDS)})), '{blanks}', repeat(' ', {len(blanks)}))"
    omission = _regex(T._OMISSION)
    kind = r"""CASE WHEN right(w,1) BETWEEN 'a' AND 'z' THEN 'a' WHEN regexp_matches(w, '[.!?。！？।؟…]["”“’''»›)\]」』]*$') THEN '.' WHEN regexp_matches(w, '[,;:，、；：(\[{„«\\#\x{fffd}-]$') THEN ','
  WHEN regexp_matches(w, '[\p{L}\p{M}]$') THEN 'a' ELSE right(w,1) END"""
    levels = {2: "label, w", 3: "label, b, w", 4: "label, a, b, w", 1: "label, kind", 0: "kind"}
    on = lambda i: " AND ".join(f"c{i}.{c.strip()}=f.{c.strip()}" for c in levels[i].split(","))
    counts = ",\n".join(f"c{i} AS (SELECT {k}, count(*) AS n, sum(e) AS e FROM gk GROUP BY ALL)" for i, k in levels.items())
    joins = " ".join(f"JOIN c{i} ON {on(i)}" for i in range(5))
    p = "(c0.e - f.e + 0.05::DOUBLE) / (c0.n + 1.0::DOUBLE)"
    chain = [f"SELECT f.*, {p} AS p0, " + ", ".join(f"c{i}.n AS n{i}, c{i}.e AS e{i}" for i in range(1, 5)) + f" FROM f {joins}"]
    for i in range(1, 5):
        chain.append(f"SELECT *, (e{i} - e + {T.PRIOR}::DOUBLE * p{i - 1}) / (n{i} - 1 + {T.PRIOR}::DOUBLE) AS p{i} FROM s{i - 1}")
    steps = ",\n".join(f"s{i} AS ({q})" for i, q in enumerate(chain))
    return f"""WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
p AS (SELECT text, trim({plain}, ' ' || chr(10)) AS p FROM texts),
o AS (SELECT text, regexp_matches(p, '{omission}') AS om, CASE WHEN regexp_matches(p, '{omission}') THEN rtrim(regexp_replace(p, '{omission}', ''), ' ' || chr(10)) ELSE p END AS p FROM p),
l AS (SELECT text, om, unnest(string_split(p, chr(10))) AS l, generate_subscripts(string_split(p, chr(10)), 1) AS ln, len(string_split(p, chr(10))) AS nl FROM o),
t AS (SELECT text, om, ln, nl, regexp_replace(lower(trim(l)), '\\p{{Nd}}+', '9', 'g') AS l FROM l),
ws AS (SELECT text, om, ln, nl, string_split_regex(trim(regexp_replace(l, '{T._SINGLE}', ' \\1 ', 'g')), ' +') AS ws FROM t),
la AS (SELECT *, CASE WHEN regexp_matches(ws[1], '{_regex(T._KEYWORDS)}') THEN 'keywords:' WHEN regexp_matches(ws[1], '{_regex(T._LABEL)}') THEN ws[1] ELSE '' END AS label FROM ws),
x AS (SELECT text, om, ln, nl, label, ws, unnest(range(1, len(ws) + 1)) AS i FROM la),
g AS (SELECT text, label, coalesce(CASE WHEN i > 2 THEN ws[i-2] END, '^') AS a, coalesce(CASE WHEN i > 1 THEN ws[i-1] END, '^') AS b, ws[i] AS w, ln = nl AND i = len(ws) AS final, om, (NOT om AND ln = nl AND i = len(ws))::INT AS e FROM x WHERE ws[i] <> ''),
gk AS (SELECT *, {kind} AS kind FROM g),
f AS (SELECT * FROM gk WHERE final),
{counts},
{steps},
v AS (SELECT w, sum(1 - e) AS inside FROM gk GROUP BY 1),
h AS (SELECT head, sum(CASE WHEN head = w THEN 0 ELSE inside END) AS longer, sum(CASE WHEN head = w THEN inside ELSE 0 END) AS alone FROM (SELECT w, inside, unnest(list_transform(range(1, length(w) + 1), lambda k: substr(w, 1, k))) AS head FROM v WHERE inside > 0) GROUP BY 1),
r AS (SELECT s4.text, s4.w AS last_word, kind, round(p4, 9) AS end_share, round(p1, 9) AS kind_share, coalesce(longer >= {T.LONGER_WORDS} * (1 + alone), false) AS begins_word,
  p4 < {T.LEAST_SHARE} OR kind IN ('a', ',') AND (coalesce(longer >= {T.LONGER_WORDS} * (1 + alone), false) OR p1 < {T.LEAST_KIND_SHARE}) AS cut FROM s4 LEFT JOIN h ON h.head = s4.w)
"""


_P10 = _truncation()

ORACLES = {
    "p10_truncated": _P10 + "SELECT doc_id, last_word, kind, end_share, kind_share, begins_word FROM documents d JOIN r ON d.text = r.text WHERE cut",
    "p10_found": _P10 + "SELECT doc_id FROM documents d JOIN r ON d.text = r.text WHERE cut",
    "p10_sources": _P10 + "SELECT source, count(*) AS n_documents, count(r.text) AS n_truncated, round(count(r.text)::DOUBLE / count(*), 6) AS truncated_share FROM documents d LEFT JOIN (SELECT text FROM r WHERE cut) r ON d.text = r.text GROUP BY source",
}
