import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm.sentences import boundaries, language_of, script_of, sentences

CASES = [
    ["Dr. Doe came at 9.30 a.m. on 3 Jan. and left.", "Then it rained."],
    ["It cost $4.50, etc.", "We left."],
    ['They asked, "Why? Is it so?" before noon.', "Nobody knew."],
    ["“None fits. None ever will,” said the reviewer from St. Ives.", "So it was."],
    ['The answer was "no."', "(It was removed in v5.32.)", "(So was this.)"],
    ["Wait... the thing works?!", "Yes."],
    ["See Fig. 4 and Eq. (7), cf. A. B. Doe and R. Roe.", "Fine."],
    ["Is version 9.25.2 needed?", "The last one lacks its mark"],
    ["Das war am 7. Mai z. B. in Abb. 39.", "Der Rest folgt."],
    ["« Le résultat est faux. Il l'a été », écrit M. Roe.", "Quelle surprise !", "Voir p. ex. l'art. 36."],
    ["¿Vale para la sec. 3.1?", "¡Qué raro!", "El Dr. Doe y la Sra. Roe lo vieron."],
    ["В 14 г. до н. э. такой меры не было.", "См. рис. 8 и с. 9 у А. Б. Иванова.", "«Это неверно. Так было», — сказал он."],
    ["यह सही है।", "क्या यह 8.12 में है?", "डॉ. वेलकर ने कहा।"],
    ["قال د. فيلكور: «هذا صحيح. لم يكن قط».", "هل يصح 7.9؟", "نعم."],
    ["We measure the height h.", "The result is good."], ["I met Art.", "He left early."], ["We used the env.", "Later we stopped."],
    ["Wir sehen uns d. h. morgen und die env. ist da.", "Das ist alles."],
]
TIGHT = [
    ["误差从39.8%降到0.8%。", "作者写道“界限很紧。”但没有证明。", "审稿人说：“错的。一直错。”", "新的图出现了！"],
    ["査読者は「誤りだ。そうだった。」と述べた。", "これは3.5だ？", "はい。"],
    ["The index ends here.", "The next one has no blank."],
]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("blank", [" ", "\n", "  "])
def test_languages(parts, blank):
    text = "  " + blank.join(parts) + " "
    assert [text[a:b] for a, b in boundaries(text)] == parts


@pytest.mark.parametrize("parts", TIGHT)
def test_without_blanks(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in boundaries(text)] == parts


def test_long_quotations_and_lookback():
    inner = "None fits. " * 200
    text = f"They wrote, “{inner}all.” in June. Then \"{inner}\" came. End."
    assert [text[a:b] for a, b in boundaries(text)] == [f"They wrote, “{inner}all.” in June.", f'Then "{inner}" came.', "End."]
    assert len(boundaries("An unpaired “sign. Here. Two.\n\nThe next. “One. Two.” is one.")) == 5
    assert language_of("Fig. 3.", "de") == "de" and language_of("Fig. 3.") == "latin" and language_of("We see that it is so.", "de") == "en"


def test_thai_breaks_at_blanks():
    text = "วิธีการนี้ปรับปรุงบทพิสูจน์ ดัชนีเก่าอธิบายทุกฉบับ$x_1$\nชั้นที่สอง"
    assert [text[a:b] for a, b in boundaries(text)] == text.split()
    assert script_of("中文 <b>text</b> 这里是中文") == "zh"


@given(st.text(alphabet="aB .!?\"“”«»。」'1\n", max_size=60))
def test_sentences_cover_all_letters_in_order(text):
    spans = boundaries(text)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_over_tables(spark):
    rows = [("a", "One. Two.", 1), ("b", None, 1), ("c", "", 1), ("d", " \n ", 1), ("e", "Yes. " * 5000, 1), (None, "One.", 1)]
    df = spark.createDataFrame(rows, "node_id string, content string, pos int")
    out = sentences(df, "node_id", "content")
    assert {(r["node_id"], r["pos"], r["end_char"]) for r in out.where("node_id = 'a'").collect()} == {("a", 1, 4), ("a", 2, 9)}
    assert out.where("node_id = 'e'").count() == 5000 and out.select("node_id").distinct().count() == 2
    assert sentences(df.limit(0), "node_id", "content").count() == 0
