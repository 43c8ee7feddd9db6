import random

import pytest

from paperloom.llm import bpe_encode as B
from paperloom.llm import leakage as K
from paperloom.llm import truncation as T


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(B.DEFAULT_VOCABULARY)


def test_ids_equal_the_library(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=B.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé中 \n1ß") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["", None, "  ", "a" * 3000, "<|endoftext|> text", "It's 12,345 o'clock"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in B.encode(df).collect()}
    assert got == {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert all(own.decode(got[i]) == t for i, t in enumerate(texts) if t)
    assert B.encode(df.limit(0)).count() == 0


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_words():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert K.common_words(a, b) == brute_common(a, b)


def test_leaks(spark):
    item = "Consider a rablusal index built over 69 entries whose nukzafite score never exceeds 84 and say which of them remain when every second mavzubite volume is gone"
    twin = item.replace("rablusal", "gocfaral").replace("nukzafite", "kegputon").replace("mavzubite", "telfival").replace("69", "70").replace("84", "85")
    words = item.split()
    docs = [
        (1, "Intro text. " + item.upper() + " Outro."), (2, " ".join(words[:13]) + " other"), (3, " ".join(words[:6]) + " other"), (4, "x " + "\n".join(words[:7]) + " an interruption of some words " + " ".join(words[7:14])), (5, None), (6, ""), (7, "nothing here"),
        (8, "filler " * 5000 + item), (9, item.replace("score", "skore")),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, twin), (1, item), (3, ""), (4, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in K.leaked(d, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (8, 1), (9, 1)}
    r = got[1, 1]
    assert docs[0][1][r["start_char"] : r["end_char"]].startswith(("Intro", "text", "CONSIDER")) and r["covered"] == 1.0
    assert K.leaked(d.limit(0), items).count() == 0 and K.leaked(d, items.limit(0)).count() == 0


def test_item_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(30))) for i in range(20)]
    d = spark.createDataFrame([(i, f"a b c {t} d e f") for i, t in items], "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in K.leaked(d, e).collect()}
    monkeypatch.setattr(K, "BLOCK_BYTES", 500)
    assert whole == {(r["doc_id"], r["item_id"]) for r in K.leaked(d, e).collect()} >= {(i, i) for i, _ in items}


def test_truncation(spark):
    rng = random.Random(4)
    nouns, verbs = ["lattice", "protocol", "sampler", "boundary"], ["orders", "refines", "supports"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} every {rng.choice(nouns)} near St. Ives."
    docs = [(i, " ".join(sentence() for _ in range(rng.randint(4, 9)))) for i in range(400)]
    docs += [(1000 + i, docs[i][1] + f" The {nouns[i % 4]} orders eve") for i in range(5)] + [(2000 + i, docs[i][1] + " The lattice") for i in range(5)] + [(3000, docs[0][1] + " The sampler orders every lattice near St.")]
    docs += [(1100 + k, docs[k][1] + f" The lattice{m}") for k, m in enumerate(("…", "...", " [...]", " (…)", "\n[…]"))] + [(1200 + k, docs[k][1] + m) for k, m in enumerate(("\n...", " …"))]
    docs += [(4000 + i, docs[i][1] + "\nKeywords: lattice, sampler") for i in range(30)] + [(5000, None), (5001, ""), (5002, " \n")]
    df = spark.createDataFrame([(i, t, None if i % 2 else "s", 1) for i, t in docs], "doc_id bigint, text string, source string, kind int")
    got = {r["doc_id"] for r in T.truncated(df).collect()}
    assert got == {*range(1000, 1005), *range(1100, 1105), *range(2000, 2005), 3000}
    by = {r["source"]: r["n_truncated"] for r in T.truncation_by_source(df).collect()}
    assert sum(by.values()) == len(got) and set(by) == {None, "s"}
    assert T.truncated(df.limit(0)).count() == 0


def test_copies_of_a_cut_text_are_all_found(spark):
    rng = random.Random(6)
    nouns = ["lattice", "protocol", "sampler", "boundary"]
    sentence = lambda: f"The {rng.choice(nouns)} orders every {rng.choice(nouns)} near St. Ives."
    docs = [(i, " ".join(sentence() for _ in range(rng.randint(4, 9)))) for i in range(400)]
    docs += [(1000 + i, docs[1][1] + " The sampler orders every zebra near St.") for i in range(3)] + [(2000 + i, docs[2][1]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in T.truncated(df).collect()) == [1000, 1001, 1002]


def test_items_without_words_of_their_own_are_found(spark):
    words = [f"w{k}" for k in range(100)]
    again, frame, short = " ".join(words[:20]), " ".join(words[20:40]), " ".join(words[40:47])
    items = [(1, again), (2, again), (3, again.upper()), (4, frame), (5, frame + " " + " ".join(words[50:58])), (6, frame + " " + " ".join(words[60:68])), (7, short)]
    docs = [(1, f"x {again} y"), (2, f"x {frame} y"), (3, "x y " + " ".join(words[41:44]) + " z"), (4, "x y " + " ".join(words[41:43]) + " z")]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in K.leaked(d, e).collect()) == [(1, 1), (1, 2), (1, 3), (2, 4), (3, 7)]


def test_scripts_without_blanks_and_offsets(spark):
    zh, th = "稀疏矩阵的分解可以在常数空间内完成并且保持全部约束条件不变", "การแยกตัวประกอบเมทริกซ์ทำได้ในพื้นที่คงที่และรักษาเงื่อนไขทั้งหมด"
    en = "Every compact lattice admits a greedy cover whose size is at most nine times the optimum"
    items = [(1, zh), (2, th), (3, en)] + [(100 + k, en + "?" * k) for k in range(1, 50)]
    docs = [(1, "前文在此。" + zh + "。后文"), (2, "ก่อนหน้า " + th + " ต่อ"), (3, "İİİ İstanbul: " + en.upper() + " İ"), (4, "稀疏矩阵的分解")]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in K.leaked(d, e).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), *((3, 100 + k) for k in range(1, 50))}
    r = got[3, 3]
    assert docs[2][1][r["start_char"] : r["end_char"]].endswith("OPTIMUM İ") and "EVERY COMPACT" in docs[2][1][r["start_char"] : r["end_char"]]


def test_near_copies_in_different_blocks(spark, monkeypatch):
    rng = random.Random(8)
    frame = [f"w{k}" for k in range(24)]
    items = [(i, " ".join(frame + [f"v{i}x{k}" for k in range(rng.randint(1, 6))])) for i in range(30)]
    d = spark.createDataFrame([(i, f"a b {t} d") for i, t in items] + [(99, " ".join(frame))], "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    pairs = []
    for size in (16 << 20, 1000):
        monkeypatch.setattr(K, "BLOCK_BYTES", size)
        pairs.append({(r["doc_id"], r["item_id"]) for r in K.leaked(d, e).collect()})
    assert pairs[0] == pairs[1] and {p for p in pairs[0] if p[0] != 99} == {(i, i) for i, _ in items}
