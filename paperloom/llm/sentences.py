"""Sentence boundaries across languages and scripts by cascading break / no-break rule tables.

Every place after a sentence mark (in Thai: every white space) is a candidate. At each candidate the tables of the text's
language, then of its script, then the default ones are read in order; the first rule whose two regular expressions match
before and after the place decides. Quotations are rules too: the first table of every language lets nothing break inside one. The
language of a text is told from its script and, in Latin script, from its function words; a language given with the text settles what these leave open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spread import spread


class Rule(NamedTuple):
    breaks: bool
    before: re.Pattern
    after: re.Pattern
    #: any place; "inside" a quotation; "closing" one, where ``before`` is what stands before the quotation
    where: str = "any"


def _rules(*table: tuple[str, ...]) -> list[Rule]:
    return [Rule(sign == "+", re.compile(rf"(?:{before})\Z"), re.compile(after), *where) for sign, before, after, *where in table]


def _words(words: str) -> str:
    return rf"(?<![^\W_])(?:{'|'.join(sorted((re.escape(w) for w in words.split()), key=len, reverse=True))})\."


#: Signs that may open a sentence before its first letter.
_OPEN = r"(?:\\[A-Za-z]+\*?\{|\{\\[a-z]+\s|<[^<>\n]{1,60}>|&\w+;|[\"“”„«»‹'‘`*_(\[{¿¡#=>~-]|\s)*"
_UPPER = rf"\s+{_OPEN}(?:[A-ZÀ-ÖØ-Þ]|[Ѐ-Я]|\$|\\\(|\\[a-z]|[^\x00-ԯ\s])"
_DIGIT = r"\s+[#(\[$€£]?\d"

# Abbreviations (fixed values): those before a name or a title, and those before a number.
_EN_NAME = "Dr Prof Mr Mrs Ms St Sr Jr Rev Gen Col Capt Lt Sen Rep Gov Hon cf vs e.g i.e viz approx Messrs Mt Ft"
_EN_NUMBER = "No no Nos nos Fig fig Figs figs Eq eq Eqs eqs Sec sec Secs Sect sect Ch ch Chap chap Vol vol Vols pp p ca Ca approx art Art Tab tab Thm Lem Prop Def Ref ref Refs Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
_DE_NAME = "Dr Prof Hr Fr Frl Dipl Ing bzw z.B z d.h d h u u.a vgl Vgl ca evtl ggf inkl insb Hrsg hrsg ebd sog bes St Bd Abb Tab Abschn Kap Nr Art Abs Str"
_DE_NUMBER = "S Nr Abb Abschn Kap Tab Bd Art Abs ca f ff Aufl Jh Gl"
_FR_NAME = "M MM Mme Mlle Me Dr Pr St Ste cf p ex éd env"
_FR_NUMBER = "p pp art sect fig chap vol éd tab env t no n"
_ES_NAME = "Sr Sra Srta Dr Dra D Dña Ud Uds p ej St Sto Sta Ing Lic Prof Profa"
_ES_NUMBER = "pág págs art fig sec cap vol núm n tab ap aprox"
_RU_NAME = "Проф проф акад Акад им г гг ул д см См ср Ср напр т т.е т.д и др гр стр"
_RU_NUMBER = "рис Рис с С гл Гл стр табл п пп ст ч т № разд см См"

_MONTHS_DE = r"Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Jun|Jul|Aug|Sept?|Okt|Nov|Dez"

_ANY = r"(?s:.)?"
TABLES: dict[str, list[Rule]] = {
    "quotes": _rules(("-", "", "", "inside")),
    "en": _rules(("-", _words(_EN_NAME), _UPPER), ("-", _words(_EN_NUMBER), _DIGIT)),
    "de": _rules(
        ("-", r"(?<!\d)\d{1,2}\.", rf"\s+(?:{_MONTHS_DE})\b"),
        ("-", r"\b(?:am|im|vom|zum|beim|dem|den|der|des|die|das|ein(?:em|en|er|es)?)\s+\d{1,3}\.", r"\s+\w"),
        ("-", _words(_DE_NAME), rf"\s+[\w„(]|{_UPPER}"), ("-", _words(_DE_NUMBER), _DIGIT),
    ),
    "fr": _rules(("-", _words(_FR_NAME), _UPPER), ("-", _words(_FR_NUMBER), _DIGIT)),
    "es": _rules(("-", _words(_ES_NAME), _UPPER), ("-", _words(_ES_NUMBER), _DIGIT)),
    "ru": _rules(("-", _words(_RU_NAME), r"\s+\S"), ("-", _words(_RU_NUMBER), _DIGIT)),
    "ar": _rules(("-", r"(?<!\w)(?:د|أ|م|ص|ج|ط|هـ)\.", r"\s*\S"), ("-", r"(?<=\d)\.", r"\d"), ("+", r"[.!?؟…][»\"”)]*", r"\s+\S")),
    "hi": _rules(("-", r"(?<!\w)(?:डॉ|प्रो|श्री|सु|कु|पं|सं|पृ|उदा)\.", r"\s*\S"), ("-", r"\.", r"\d"), ("-", r"[।॥?!][\"”’)]+", r"\s*(?:यह\s+कह|कह|ऐसा)"), ("+", r"[।॥?!][\"”’)]*", r"\s*\S"), ("+", r"\w\.", r"\s+\S")),
    "zh": _rules(("-", r"(?<!：)", r"[但并而却的，、；这一]", "closing"), ("-", r"[。！？…][」』]", r"[但并而却的，、；]"), ("+", r"[。！？!?][”’」』）)\"]*", r"\s*\S"), ("+", r"…[”’」』）)\"]+", r"\s*\S")),
    "ja": _rules(("-", r"[。！？…][」』”）)]", r"\s*[とはがをにのもでやか、，]"), ("+", r"[。！？!?][」』”’）)\"]*", r"\s*\S")),
    "th": _rules(("-", r"(?:ดร|นาย|นาง|พ\.ศ|ค\.ศ|เช่น|ฯลฯ|น)\.?", r"\s"), ("-", r"(?s:.)", r"\s+[\d%ๆ)\]}]"), ("-", r"[\d(\[]", r"\s"), ("+", r"[฀-๿.!?…»\"”)\]}>*_`'$]", r"\s+\S")),
    "latin": _rules(
        ("-", r"(?<![\w.])(?:[A-ZÀ-Þ]\.\s?)*[A-ZÀ-Þ]\.", rf"\s+{_OPEN}[A-ZÀ-Þ]"),
        ("-", r"(?:[^\W\d_]\.){2,}", r"\s+[a-zß-ÿ\d]"),
    ),
    "cyrillic": _rules(("-", r"(?<![\w.])(?:[A-ZЀ-Я]\.\s?)*[A-ZЀ-Я]\.", rf"\s+{_OPEN}[A-ZЀ-Я]"), ("-", r"(?:[^\W\d_]\.\s?){2,}", r"\s+[a-zа-я\d]")),
    "default": _rules(
        ("-", r"[\w)\]]\.", r"[\d_/@\\]|[a-zß-ÿ]|[A-Z]\."),
        ("-", r"\.\.\.|…", rf"\s+{_OPEN}[a-zß-ÿа-я]"),
        ("+", _ANY, r"\s*\n\s*\n"),
        ("+", r"[.!?…][\"”“’'»›)\]]*|\s»", _UPPER),
        ("+", r"[^\W\d_]{4,}[.!?][\"”“’'»›)\]]*|[!?][\"”“’'»›)\]]*", _DIGIT),
        ("+", r"[^\W\d_][^\W_]{2,}[.!?][\"”“’'»›)\]]*|\d[.!?]\)*", r"(?:[\"“„«¿¡(]|\\[a-z]+\{|\[\[|\*\*|<[a-z]+>)?(?:[A-ZÀ-ÖØ-ÞЀ-Я][^\W\d_]*[\s,'’]|[A-ZÀ-ÖØ-ÞЀ-Я][a-zà-ÿа-я])"),
        ("+", r"[.!?…؟]\)+", r"\s*\("),
    ),
}
CASCADES = {
    **{lang: ("quotes", lang, "latin", "default") for lang in ("en", "de", "fr", "es")}, "latin": ("quotes", "en", "de", "fr", "es", "latin", "default"), "ru": ("quotes", "ru", "cyrillic", "default"),
    **{lang: ("quotes", lang) for lang in ("ar", "hi", "zh", "ja", "th")},
}
RULES = {name: [rule for table in tables for rule in TABLES[table]] for name, tables in CASCADES.items()}
# Function words by which languages of Latin script are told apart (fixed values).
FUNCTION_WORDS = {
    "en": "the of and is are we that with this which it for from by not he she i you our was were be can has have they all to in on as at an than then when if",
    "de": "der die das und ist sind wir dass mit eine einer ein nicht von zu den dem des auf für im werden wird es sich auch als wie aus bei nach sie er ich in an am um so was war hat kann noch nur über unter durch gegen vor beim vom zum zur jede jeder jedes kein keine",
    "fr": "le la les et est sont nous que avec une un dans pour des du par pas ce cette qui se sur au aux ne il elle je plus on comme sans",
    "es": "el la los las y es son que con una un en para del por no se este esta lo su como al más pero sin sobre nos hay cada",
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _word in _list.split():
        _VOTES[_word] = (*_VOTES.get(_word, ()), _lang)
_PLAIN_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[.!?…]+(?:\s?»|[\"”“’'»›)\]])*|\n\s*\n")
CANDIDATES = {
    **dict.fromkeys(("latin", "en", "de", "fr", "es", "ru"), _MARK),
    "ar": re.compile(r"[.!?؟…]+[»\"”)\]]*"), "hi": re.compile(r"[।॥.!?…]+[\"”’)\]]*"), "zh": re.compile(r"[。！？!?…]+[”’」』）)\"]*"), "ja": re.compile(r"[。！？!?…]+[」』”’）)\"]*"), "th": re.compile(r"(?<=\S)(?=\s+\S)"),
}
# Quotations and inline formulas by their opening and closing signs (fixed values); "" pairs with itself.
_PAIRS = (("“", "”"), ("„", "“”"), ("«", "»"), ("「", "」"), ("『", "』"), ('"', '"'), ("``", "''"), ("$", "$"))
_SIGN = re.compile("``|''|[“”„«»「」『』\"$]|\\n\\s*\\n|\\n")


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of quotations and inline formulas, none inside another, in one pass over their signs. A sign without a partner in its
    paragraph (a formula: in its line) opens nothing."""
    open_at: dict[str, int] = {}
    spans = []
    for m in _SIGN.finditer(text):
        sign, (a, b) = m.group(), m.span()
        if sign[0] == "\n":
            if len(sign) > 1:
                open_at.clear()
            else:
                open_at.pop("$", None)
            continue
        for opening, closing in _PAIRS:
            start = open_at.get(opening)
            straight = sign == '"'
            if start is not None and sign in ("''", closing) * (opening == "``") or start is not None and opening != "``" and sign in closing:
                if a > start + len(opening) and not (straight and text[b : b + 1].isalnum()):
                    spans.append((start, b))
                    del open_at[opening]
                    continue
            if sign == opening and not (straight and a and text[a - 1].isalnum()):
                open_at[opening] = a
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


_SCRIPTS = (("th", re.compile("[฀-๿]")), ("kana", re.compile("[぀-ヿ]")), ("han", re.compile("[㐀-鿿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ru", re.compile("[Ѐ-ӿ]")))
#: Share of the letters that decides the script; Latin markup stands in texts of every script.
SCRIPT_SHARE = 0.25


def script_of(text: str) -> str:
    if text.isascii():
        return "latin"
    letters = sum(map(str.isalpha, text)) or 1
    counts = {name: len(pattern.findall(text)) for name, pattern in _SCRIPTS}
    counts["han"] += counts["kana"]
    name = max(counts, key=lambda n: counts[n])
    if counts[name] < SCRIPT_SHARE * letters:
        return "latin"
    return ("ja" if counts["kana"] * 20 > counts["han"] else "zh") if name in ("han", "kana") else name


def language_of(text: str, hint: str | None = None) -> str:
    """The cascade a text is read by: its script's, in Latin script that of the language most function words speak for; where none or several
    do, the hint's, and without one all Latin tables."""
    script = script_of(text)
    if script != "latin":
        return script
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in _PLAIN_WORD.findall(text.lower()):
        for lang in _VOTES.get(word, ()):
            votes[lang] += 1
    best = max(votes.values())
    ahead = [lang for lang, n in votes.items() if n == best]
    hint = (hint or "").strip().lower()[:2]
    return ahead[0] if len(ahead) == 1 else hint if hint in (ahead if best else votes) else "latin"


#: What a rule reads before a place is at most so long, but for runs of the signs below, which are followed to their beginning.
_REACH = 60
_RUNS = frozenset(" \t\n\r\"”“’'»›)]」』）.!?…。！？")


def boundaries(text: str, hint: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points; white space around sentences belongs to none."""
    language = language_of(text, hint)
    quotes = quotations(text)
    cuts, q = [], 0
    for m in CANDIDATES[language].finditer(text):
        place = m.end() if not m.group().isspace() else m.start()
        while q < len(quotes) and quotes[q][1] <= place:
            q += 1
        inside = q < len(quotes) and quotes[q][0] < place
        closing = quotes[q - 1][0] if q and quotes[q - 1][1] == place else -1
        low = max(0, place - _REACH)
        while low and text[low] in _RUNS:
            low -= 1
        for rule in RULES[language]:
            if rule.where == "any":
                fits = rule.after.match(text, place) and rule.before.search(text, low, place)
            elif rule.where == "inside":
                fits = inside
            else:
                fits = closing >= 0 and rule.after.match(text, place) and rule.before.search(text, max(0, closing - _REACH), closing)
            if fits:
                if rule.breaks:
                    cuts.append(place)
                break
    spans, start = [], 0
    for end in [*cuts, len(text)]:
        piece = text[start:end]
        if stripped := piece.strip():
            lead = len(piece) - len(piece.lstrip())
            spans.append((start + lead, start + lead + len(stripped)))
        start = end
    return spans


def sentences(rows: DataFrame, key: str, content: str, language: str | None = None, even: bool = True) -> DataFrame:
    """rows -> (key, pos, start_char, end_char, sentence): one row per sentence, pos from 1 in reading order.

    Characters are code points of ``content``; ``end_char`` counts those up to and including the sentence's last non-blank one. Null,
    empty and blank contents give no rows; a last sentence without a mark is one. Rows are handled as they come: repeated rows repeat.
    ``language`` names a column of language codes, which may be null or wrong. ``even`` spreads the rows of a small scan over all cores; not needed
    where they come from a shuffle.
    """
    hint = F.col(language) if language else F.lit(None).cast("string")
    own = rows.select(F.col(key).alias("k"), F.col(content).alias("t"), hint.alias("h")).where("k is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks, pos, starts, ends, parts = [], [], [], [], []
            for row, (text, hint) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, (a, b) in enumerate(boundaries(text, hint), 1):
                    picks.append(row)
                    pos.append(n)
                    starts.append(a)
                    ends.append(b)
                    parts.append(text[a:b])
            keys = batch.column(0).take(pa.array(picks, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())], [key, "pos", "start_char", "end_char", "sentence"])

    return (spread(own) if even else own).mapInArrow(run, f"`{key}` {own.schema['k'].dataType.simpleString()}, pos int, start_char int, end_char int, sentence string")
