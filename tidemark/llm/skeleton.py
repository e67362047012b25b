"""Texts that look the same though their characters differ, by their confusables skeleton.

The skeleton of a text: characters that show nothing are dropped; the rest is decomposed (compatibly: full-width, half-width, styled and
joined forms become plain letters, composed letters become letter and mark), every character is replaced by its prototype from
the look-alike table, and the result is decomposed again; any run of white space becomes one blank, none stays at the ends.
Letters keep accents, and no ASCII character is replaced by another. Texts with equal skeletons look alike.

The look-alike table comes from the public confusables data that Spark's ICU library carries: letters with one letter of another script as their prototype.
There `I`, `l` and `1` are one class, and `rn` is the prototype of `m`; here a capital letter of the first goes to `I`, another one to `l`, and `rn` to `m`. Letters that the
data take for digits or signs, and letters of one script, are not alike. A few fixed values go before the data. The table has some thousand entries and goes to
the executors with the function.

The skeleton is taken where the text is read; only digests of 16 bytes (of skeleton and of text) and the row's key are shuffled. Within a class,
the distinct texts are paired first, and members are attached to each side of a pair of different texts: nothing is compared
that is not a result, so a class with a third of all rows costs no more than its results.

Cases. Null texts and texts without a visible character belong to no class and have a null skeleton. Equal texts are in one class but
never a pair. Texts of any length are taken whole. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import shipped

# Fixed values that go before the public data: letters that have the shape of a Latin letter, and hyphens, each after its prototype.
LOOK_ALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "ϹСᏟꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀꓲ", "J": "ͿЈᎫꓙ",
    "K": "ΚКᏦꓗ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫ", "Y": "ΥҮУᎩꓬ", "Z": "ΖᏃꓜ", "a": "αаɑ", "c": "ϲс", "d": "ԁ", "e": "е", "g": "ɡց",
    "h": "һհ", "i": "ιіᎥ", "j": "ϳј", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "ρр", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ",
    "w": "ԝ", "x": "х", "y": "γуү", "-": "‐‑⁃֊",
}


@lru_cache(1)
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """What is done before decomposing (drop what shows nothing, keep marks that stand alone), and the prototypes."""
    unseen = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}
    first = dict.fromkeys(map(chr, unseen), "")
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind == "Cf" or kind == "Cc" and not c.isspace():
            first[c] = ""
        elif kind[0] == "S" and len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0] == " ":
            first[c] = chr(0x100000 + ord(c))  # an accent without a letter would turn into white space and a mark
    return first, {c: to for to, all_ in LOOK_ALIKES.items() for c in all_}


@lru_cache(1)
def _unseen_ascii() -> dict[int, None]:
    return {ord(c): None for c in _tables()[0] if c.isascii()}


def _script(c: str) -> str:
    """The first word of a character's name, which names its script."""
    return unicodedata.name(c, "?").split()[0].removesuffix("-SMALL")


def from_data(chars: list[str], skeletons: list[str]) -> dict[str, str]:
    """Of letters and their skeletons by the public data, the pairs of a letter and its prototype that count here."""
    letter = lambda c: unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo")
    out = {}
    for c, p in zip(chars, skeletons, strict=True):
        p = "m" if p == "rn" else "I" if p == "l" and unicodedata.category(c) == "Lu" else p
        if c != p and len(p) == 1 and letter(p) and unicodedata.normalize("NFKD", c) == c and unicodedata.normalize("NFKD", p) == p and _script(c) != _script(p):
            out[c] = p
    return out


@lru_cache(1)
def _letters() -> list[str]:
    return [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo")]


def prototypes(spark: SparkSession) -> dict[str, str]:
    """The look-alike table: the public data and the fixed values."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    data = from_data(_letters(), checker.getSkeleton(0, "\n".join(_letters())).split("\n"))
    table = data | _tables()[1]
    return {c: table.get(p, p) for c, p in table.items()}  # a prototype with a prototype of its own


def _replaced(text: str, table: dict[str, str]) -> str:
    for c in set(text) & table.keys():
        text = text.replace(c, table[c])
    return text


def skeleton(text: str | None, table: dict[str, str] | None = None) -> str | None:
    """table: as by prototypes(); without one, the fixed values alone."""
    if text is None:
        return None
    first, fixed = _tables()
    if text.isascii():  # nothing to replace, and a table of 128 characters is applied in one pass
        text = text.translate(_unseen_ascii())
    else:
        text = _replaced(text, first)
        text = unicodedata.normalize("NFKD", _replaced(unicodedata.normalize("NFKD", text), fixed if table is None else table))
    return " ".join(text.split()) or None


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, form): digests of the skeleton and of the text; look is null where nothing is visible."""
    shipped(documents.sparkSession)
    kind, table = documents.schema[key].dataType.simpleString(), prototypes(documents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            looks = [skeleton(t, table) for t in texts]
            look = pa.array([None if s is None else _digest(s) for s in looks], pa.binary())
            form = pa.array([None if s is None else _digest(t) for s, t in zip(looks, texts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), look, form], ["key", "look", "form"])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, look binary, form binary")


def skeletons(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, skeleton) of every row: the one form in which texts that look alike are equal."""
    shipped(documents.sparkSession)
    kind, table = documents.schema[key].dataType.simpleString(), prototypes(documents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(t, table) for t in b.column(1).to_pylist()], pa.string())], ["key", "skeleton"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, skeleton string")
    return rows.select(F.col("key").alias(key), "skeleton")


def alike_pairs(marks: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of rows with equal look and different form. marks: as by digests(), better written first."""
    forms = marks.filter("look is not null").groupBy("look", "form").agg(F.count("*").alias("n"))
    many = forms.groupBy("look").agg(F.count("*").alias("n_forms")).filter("n_forms > 1").select("look")
    forms = forms.join(many, "look", "left_semi").select("look", "form")
    pairs = forms.alias("x").join(forms.alias("y"), (F.col("x.look") == F.col("y.look")) & (F.col("x.form") < F.col("y.form")))
    pairs = pairs.select(F.col("x.look").alias("look"), F.col("x.form").alias("form"), F.col("y.form").alias("other"))
    members = marks.select("key", "look", "form")
    left = members.join(pairs, ["look", "form"]).select("look", F.col("other").alias("form"), F.col("key").alias("one"))
    both = left.join(members, ["look", "form"])
    return both.select(F.least("one", "key").alias("a"), F.greatest("one", "key").alias("b")).filter("a != b")


def alike_classes(marks: DataFrame) -> DataFrame:
    """(look, n_rows, n_forms) of the classes with more than one form."""
    forms = marks.filter("look is not null").groupBy("look", "form").agg(F.count("*").alias("n"))
    return forms.groupBy("look").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms")).filter("n_forms > 1")


def alike_members(marks: DataFrame) -> DataFrame:
    """(key, class_id, n_rows, n_forms) of every row of a class with more than one form; class_id is the smallest key of the class.

    Counted by form first, then by class: both combine before the shuffle, so a class with a third of all rows is no hot task."""
    forms = marks.filter("look is not null").groupBy("look", "form").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    classes = forms.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_forms")).filter("n_forms > 1")
    return marks.select("key", "look").join(classes, "look").select("key", "class_id", "n_rows", "n_forms")
