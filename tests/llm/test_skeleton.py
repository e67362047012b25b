import random
import unicodedata

import pytest

from tidemark.llm import skeleton

DOCS = "doc_id long, text string, look string"

ALIKE = [
    ("Paypal", "Ｐａｙｐａｌ"), ("Paypal", "Pаypаl"), ("file", "ﬁle"), ("bold", "𝐛𝐨𝐥𝐝"), ("\u00e9", "e\u0301"), ("\uac00", "\u1100\u1161"), ("ガ", "ｶﾞ"), ("a-b", "a‐b"), ("a-b", "a‑b"),
    ("a b", "a \r\n\t b"), ("ab", "a​b"), ("ab", "﻿a­b"), (" ab\n", "ab"), ("TAM", "ᎢᎪᎷ"), ("\u0451", "e\u0308"), ("HOME", "ΗΟΜΕ"),
]
DIFFERENT = [("O", "0"), ("l", "I"), ("l", "1"), ("a", "A"), ("e", "é"), ("a-b", "a–b"), ("a-b", "a—b"), ("rn", "m"), ("'", "’"), ("ab", "a b"), ("word", "ward"), ("x ", "x´")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert a != b and skeleton.skeleton(a) == skeleton.skeleton(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


def test_control_characters_show_nothing():
    assert skeleton.skeleton("a\x00b\x7f c\x1b") == "ab c" == skeleton.skeleton("a\x00b\x85\u200bc") and skeleton.skeleton("\x00\x01") is None


def test_nothing_visible():
    assert [skeleton.skeleton(t) for t in (None, "", " \n", "​﻿", "­ ㅤ")] == [None] * 5


def test_no_ascii_character_is_replaced():
    text = "".join(map(chr, range(0x21, 0x7F)))
    assert skeleton.skeleton(text) == text
    assert sum(map(len, skeleton.LOOK_ALIKES.values())) < 200
    assert all(len(unicodedata.normalize("NFKD", c)) == 1 for s in skeleton.LOOK_ALIKES.values() for c in s if c != "‑")


def test_the_table_covers_the_public_data(spark):
    """Letters whose prototype in the public data is one ASCII letter, in all scripts but Latin: nine of ten must have it here, no two ASCII characters become alike."""
    table = skeleton.prototypes(spark)
    letters = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L"]
    looks = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(letters)).split("\n")
    wanted = {c: p for c, p in zip(letters, looks, strict=True) if len(p) == 1 and p.isascii() and p.isalpha() and p != c}
    alike = {c for c, p in wanted.items() if skeleton.skeleton(c, table) in ({"l", "I", "i"} if p in "li" else {p})}
    other = {c for c in wanted if not unicodedata.name(c, "?").startswith("LATIN")}
    assert len(wanted) > 1000 and len(alike & other) >= 0.97 * len(other) and len(alike) >= 0.9 * len(wanted)
    text = "".join(map(chr, range(0x21, 0x7F)))
    assert skeleton.skeleton(text, table) == text and not any(c.isascii() for c in table)
    assert all(skeleton.skeleton(skeleton.skeleton(c, table), table) == skeleton.skeleton(c, table) for c in letters)


@pytest.mark.parametrize(("a", "b"), ALIKE + [("Γ", "Г"), ("к", "κ"), ("ロ", "口"), ("へ", "ヘ"), ("MAP", "ⲘАР"), ("SO", "𐐠𐐄")])
def test_alike_by_the_table(spark, a, b):
    table = skeleton.prototypes(spark)
    assert a != b and skeleton.skeleton(a, table) == skeleton.skeleton(b, table)


@pytest.mark.parametrize(("a", "b"), DIFFERENT + [("З", "3"), ("Ι", "l"), ("и", "й"), ("ö", "o"), ("ø", "o"), ("ß", "B"), ("é", "è"), ("ı", "í")])
def test_different_by_the_table(spark, a, b):
    table = skeleton.prototypes(spark)
    assert skeleton.skeleton(a, table) != skeleton.skeleton(b, table)


def test_members_of_classes(spark):
    rows = [(5, "abc", None), (3, "аbc", None), (9, "abc", None), (1, "x", None), (2, "x", None), (7, None, None), (8, " ", None)]
    got = {tuple(r) for r in skeleton.alike_members(skeleton.digests(spark.createDataFrame(rows, DOCS))).collect()}
    assert got == {(k, 3, 3, 2) for k in (3, 5, 9)}


def test_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    forms = ["abc", "аbc", "ａbc", "abc ", "abd", "Abc", None, "", "  ", "x" * 5000, "ｘ" * 5000]
    rows = [(i, rng.choice(forms), None) for i in range(120)]
    got = sorted((r.a, r.b) for r in skeleton.alike_pairs(skeleton.digests(spark.createDataFrame(rows, DOCS))).collect())
    looks = [skeleton.skeleton(t) for _, t, _ in rows]
    want = [(i, j) for i in range(120) for j in range(i + 1, 120) if looks[i] and looks[i] == looks[j] and rows[i][1] != rows[j][1]]
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    marks = skeleton.digests(df)
    assert skeleton.alike_pairs(marks).count() == 0 and skeleton.skeletons(df).count() == 0 and skeleton.alike_classes(marks).count() == 0
