"""Token ids of every text by a public byte-level BPE vocabulary, by merge replay over the words of the whole corpus.

1. Words. A task splits its share of the corpus into words, by array operations on the code points of pieces of `PIECE` characters. Equal words of a block
(up to `BLOCK_CHARS` characters or `BLOCK_WORDS` different words of a task's share, or one longer text) have one number in it. Written are, by document, the
numbers of its words (1 to 4 bytes each), and, by block, its different words.
2. Replay. The blocks' words are brought together by word and sorted, so each different word of the corpus is encoded once, however often and wherever it
occurs. An inverted index maps every token pair to the positions of words where it stands. Merges are applied in rank order: each takes all its positions from
the index, and touches the merged symbol and its left neighbour only; just those pairs are looked up and indexed again. A task replays its words in
chunks of `SYMBOLS` bytes, so memory does not depend on the vocabulary of the corpus.
3. Texts. The words' ids go back to their blocks, and each text's ids are put together from them.

What is shuffled are the blocks' different words, their ids, and the documents' word numbers, not the texts. A word has at most one row from each block, so
none is hot. A block is at most `BLOCK_CHARS` characters or one text: no task's memory depends on the corpus.

The vocabulary file (a tokenizer JSON with its merge list) is read on the driver from `path`, a parameter; executors get its tables, whose size is that of the
vocabulary.

Cases. A null and an empty text have no ids. Special tokens' strings are ordinary text. Repeated documents are repeated rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import shipped
from tidemark.storage import written

#: Characters that are split at once.
PIECE = 4_000_000
#: A block ends at so many characters or different words.
BLOCK_CHARS, BLOCK_WORDS = 24_000_000, 1_000_000
#: Bytes of words that are replayed together.
SYMBOLS = 8_000_000
#: Ids in one batch of the result.
OUT_IDS = 1_000_000
#: Words whose characters are handled at once.
WORDS = 150_000

OTHER, LETTER, NUMBER, SPACE = range(4)
NONE = np.int32(2**31 - 1)


def default_path() -> str:
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: letters (L*), numbers (N*), white space, other."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    return table


@lru_cache(1)
def _mix() -> np.ndarray:
    """A fixed random number for each code point."""
    return np.random.default_rng(20240205).integers(1, 2**63, sys.maxunicode + 1, dtype=np.uint64) | np.uint64(1)


def word_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point of concatenated texts; ends: where the (non-empty) texts end.

    Words are: the contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers, or of others, each with one blank before it;
    white space up to the last character before such a run; white space."""
    n = len(cp)
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    text_end = first[1:]
    first = first[:-1]
    before = np.empty(n, np.uint8)
    before[0] = SPACE
    before[1:] = cls[:-1]
    start = (cls != before) | first
    space = cls == SPACE
    after = np.empty(n, np.uint8)
    after[-1] = OTHER
    after[:-1] = cls[1:]
    last_space = space & ~text_end & (after != SPACE)  # white space right before a visible character of its text
    start |= last_space
    blank = last_space & (cp == 0x20)
    at = np.flatnonzero(blank) + 1
    start[at] = False  # the blank begins their word
    quote = np.flatnonzero((cp == 0x27) & start)  # a quote after a blank isn't a start any more
    if len(quote):
        left = np.searchsorted(ends, quote, side="right")
        room = ends[left] - quote  # characters of the text from the quote on
        one = cp[np.minimum(quote + 1, n - 1)]
        two = cp[np.minimum(quote + 2, n - 1)]
        short = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 3) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for q, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[q + 1] = False
            start[q[q + size < n] + size] = True
    return start


class Vocabulary:
    """Bytes, merges in rank order and the ids they make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, byte_of = model["vocab"], _written_bytes()
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in byte_of.items():
            self.byte_ids[byte] = ids[char]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pair = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        of_id = {i: bytes(byte_of[c] for c in token) for token, i in ids.items() if all(c in byte_of for c in token)}
        #: The bytes of all ids, one after another, and where each begins; an id without bytes has none.
        self.bytes = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(max(ids.values()) + 1)), np.uint8)
        self.starts = np.append(0, np.cumsum([len(of_id.get(i, b"")) for i in range(max(ids.values()) + 1)]))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)


def _written_bytes() -> dict[str, int]:
    """How the vocabulary file writes bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(vocab: Vocabulary, symbols: np.ndarray, sizes: np.ndarray, applied: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """symbols: the byte ids of all words, one after another; sizes: how many each word has (1 or more). The merged ids and sizes.

    A mergeable pair is named by its rank. applied: gets the ranks in the order in which they were applied."""
    n = len(symbols)
    sym = symbols.astype(np.int32)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    stops = np.cumsum(sizes)
    after[stops - 1] = -1
    before[stops - sizes] = -1
    rank = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = vocab.rank(sym[inner], sym[inner + 1])
    index: dict[int, list[np.ndarray]] = {}  # from a pair to the positions where it was found
    due: list[int] = []

    def post(at: np.ndarray) -> None:
        if len(at) == 1:
            cuts, pairs = [at], [int(rank[at[0]])]
        else:
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            heads = np.flatnonzero(r[1:] != r[:-1]) + 1
            edges = [0, *heads.tolist(), len(at)]
            cuts = [at[i:j] for i, j in zip(edges, edges[1:], strict=False)]
            pairs = r[np.r_[0, heads]].tolist()
        for pair, part in zip(pairs, cuts, strict=True):
            have = index.get(pair)
            if have is None:
                index[pair] = [part]
                heapq.heappush(due, pair)
            else:
                have.append(part)

    known = inner[rank[inner] != NONE].astype(np.int32)
    if len(known):
        post(known)
    alive = np.ones(n, bool)
    while due:
        pair = heapq.heappop(due)
        found = index.pop(pair)
        at = found[0] if len(found) == 1 else _union(*found)
        at = at[rank[at] == pair]  # the others were merged away since
        if not len(at):
            continue
        if len(at) > 1:  # of pairs that overlap (a run of one symbol), every second from the left
            chained = after[at[:-1]] == at[1:]
            if chained.any():
                place = np.arange(len(at))
                place = place - np.maximum.accumulate(np.where(np.r_[False, chained], 0, place))
                at = at[place % 2 == 0]
        if applied is not None:
            applied.append(pair)
        gone = after[at]
        beyond = after[gone]
        sym[at] = vocab.made[pair]
        after[at] = beyond
        inside = beyond >= 0
        before[beyond[inside]] = at[inside]
        alive[gone] = False
        rank[gone] = NONE
        rank[at[~inside]] = NONE
        left = before[at]
        left = left[left >= 0]
        touched = _union(left, at[inside])
        if len(touched):
            rank[touched] = vocab.rank(sym[touched], sym[after[touched]])
            touched = touched[rank[touched] != NONE]
            if len(touched):
                post(touched)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return sym[alive], np.bincount(word[alive], minlength=len(sizes))


def _union(*parts: np.ndarray) -> np.ndarray:
    """The distinct values of all parts in order."""
    at = np.sort(np.concatenate(parts), kind="stable")
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def split(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The texts' words, one text after another, as numbers; the different words by number; how many words each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not lengths.sum():
        return np.zeros(0, np.int64), [], np.zeros(len(texts), np.int64)
    text = "".join(texts)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    start = np.flatnonzero(word_starts(cp, np.unique(ends[lengths > 0])))
    sizes = np.diff(np.append(start, len(cp)))
    codes, heads = _same_words(cp, start, sizes)
    words = [text[s : s + z] for s, z in zip(start[heads].tolist(), sizes[heads].tolist(), strict=True)]
    return codes, words, np.diff(np.append(0, np.searchsorted(start, ends)))


def word_ids(vocab: Vocabulary, words: list[str], applied: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the (non-empty) words, one word after another, and how many each word has."""
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return replay(vocab, vocab.byte_ids[np.frombuffer(b"".join(data), np.uint8)], sizes, applied)


def gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids, sizes: of the words by number; codes: the texts' words. All ids of the texts and how many each has."""
    offsets = np.cumsum(sizes) - sizes
    per = sizes[codes]
    totals = np.append(0, np.cumsum(per))
    counts = np.diff(totals[np.append(0, np.cumsum(per_text))])
    out = np.empty(totals[-1], np.int32)
    for i in range(0, len(codes), WORDS):
        j = min(i + WORDS, len(codes))
        flat = np.repeat(offsets[codes[i:j]] - totals[i:j], per[i:j])
        flat += np.arange(totals[i], totals[j])
        out[totals[i] : totals[j]] = ids[flat]
    return out, counts


def encode(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one text after another, and how many each text has: the same in one process."""
    codes, words, per_text = split(texts)
    if not words:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    return gathered(*word_ids(vocab, words), codes, per_text)


def _same_words(cp: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, and where each number first occurs.

    Words are told apart by a hash over their code points, then every word is compared with the first of its number."""
    key = np.empty(len(start), np.uint64)
    for i in range(0, len(start), WORDS):
        at, size = start[i : i + WORDS], sizes[i : i + WORDS]
        low = at[0]
        mixed = _mix()[cp[low : at[-1] + size[-1]]]
        place = np.arange(len(mixed)) - np.repeat(at - low, size)
        mixed *= (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
        key[i : i + WORDS] = np.add.reduceat(mixed, at - low)
    key = key * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
    codes, _ = pd.factorize(key)
    heads = np.full(int(codes.max()) + 1, -1, np.int64)
    heads[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    head = start[heads][codes]
    same = (sizes == sizes[heads][codes]).all()
    for i in range(0, len(start) if same else 0, WORDS):
        at, size = start[i : i + WORDS], sizes[i : i + WORDS]
        shift = np.repeat(head[i : i + WORDS] - at, size)
        shift += np.arange(at[0], at[0] + len(shift))
        if not np.array_equal(cp[shift], cp[at[0] : at[0] + len(shift)]):
            same = False
            break
    if not same:  # two words with one hash: compare the words themselves
        text = cp.tobytes().decode("utf-32-le")
        codes, _ = pd.factorize(np.array([text[s : s + z] for s, z in zip(start.tolist(), sizes.tolist(), strict=True)], object))
        heads = np.full(int(codes.max()) + 1, -1, np.int64)
        heads[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, heads


def packed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^28 as 1 to 4 bytes of 7 bits, the highest first, all but the last with the top bit set; and the bytes of each."""
    size = 1 + (codes >= 1 << 7).astype(np.int64) + (codes >= 1 << 14) + (codes >= 1 << 21)
    last = np.cumsum(size) - 1
    out = np.empty(int(size.sum()), np.uint8)
    out[last] = codes & 127
    for k in (1, 2, 3):
        more = size > k
        out[last[more] - k] = (codes[more] >> 7 * k) & 127 | 128
    return out, size


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed() and where each ends."""
    last = np.flatnonzero(data < 128)
    size = np.diff(np.append(-1, last))
    codes = data[last].astype(np.int32)
    for k in (1, 2, 3):
        more = size > k
        codes[more] |= (data[last[more] - k] & 127).astype(np.int32) << 7 * k
    return codes, last


#: Gives a number to each of some texts, from split()'s results for them.
Label = Callable[[np.ndarray, list[str], np.ndarray], np.ndarray]


def cut(documents: DataFrame, piece: int = PIECE, label: Label | None = None) -> DataFrame:
    """documents (key, text): the rows (block, key, codes, label) of documents and (block, code, word) of the blocks' different words, in one table, written.

    label is null where no function gives it."""
    from pyspark.sql.pandas.types import to_arrow_type

    shipped(documents.sparkSession)
    kind = documents.schema["key"].dataType
    arrow = to_arrow_type(kind)
    names = ["block", "code", "word", "key", "codes", "label"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, int] = {}
        chars = 0

        def ended() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for i in range(0, len(words), WORDS):
                part = words[i : i + WORDS]
                n = len(part)
                code = pa.array(np.arange(i, i + n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), code, pa.array(part, pa.string()), pa.nulls(n, arrow), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names)

        for keys, texts in _pieces(batches, piece):
            codes, words, per_text = split(texts)
            size = sum(map(len, texts))
            if numbers and (chars + size > BLOCK_CHARS or len(numbers) > BLOCK_WORDS):
                yield from ended()
                block, numbers, chars = block + 1, {}, 0
            chars += size
            own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            data, bytes_of = packed(own[codes] if len(words) else codes)
            ends = np.append(0, np.cumsum(bytes_of))[np.append(0, np.cumsum(per_text))]
            n = len(texts)
            column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            labels = pa.nulls(n, pa.int32()) if label is None else pa.array(label(codes, words, per_text).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.concat_arrays(keys), column, labels], names)
        yield from ended()

    rows = documents.select("key", "text").mapInArrow(run, f"block bigint, code int, word string, key {kind.simpleString()}, codes binary, label int")
    return written(rows, "words")


def _pieces(batches: Iterable[pa.RecordBatch], piece: int) -> Iterator[tuple[list[pa.Array], list[str]]]:
    keys: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        i = 0
        new = [t or "" for t in batch.column(1).to_pylist()]
        for j, t in enumerate(new, 1):
            size += len(t)
            if size >= piece:
                yield [*keys, batch.column(0).slice(i, j - i)], [*texts, *new[i:j]]
                keys, texts, size, i = [], [], 0, j
        if i < len(new):
            keys.append(batch.column(0).slice(i))
            texts += new[i:]
    if texts:
        yield keys, texts


def replayed(words: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """The ids of every word of cut(): (block, numbers, sizes, ids), one row for the words of a block that were replayed together."""
    spark = words.sparkSession
    shipped(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for block, code, word in _chunks(batches, SYMBOLS):
            new = np.array([True, *(a != b for a, b in zip(word[1:], word, strict=False))])
            ids, sizes = word_ids(vocab, [w for w, n in zip(word, new, strict=True) if n])
            of = np.cumsum(new) - 1
            order = np.argsort(block, kind="stable")
            block, code, of = block[order], code[order], of[order]
            heads = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1]
            flat, per = gathered(ids, sizes, of, np.diff(np.append(heads, len(of))))
            rows = np.append(heads, len(of)).astype(np.int32)
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
            columns = [pa.array(block[heads]), lists(rows, code), lists(rows, sizes[of]), lists(np.append(0, np.cumsum(per)), flat)]
            if not with_ids:
                columns[3] = pa.array([[]] * len(heads), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["block", "numbers", "sizes", "ids"])

    rows = words.filter("word is not null").select("block", "code", "word").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(run, "block bigint, numbers array<int>, sizes array<int>, ids array<int>")


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Rows (block, code, word), as many whole batches together as it takes for `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, list[str]]:
        table = pa.Table.from_batches(held)
        return table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_pylist()

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += batch.column(2).get_total_buffer_size()
        if size >= most:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])


def _block(docs: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: ids and sizes of its words by number, the documents' words, and how many each document has."""
    numbers, sizes = _values(words["numbers"]), _values(words["sizes"]).astype(np.int64)
    ids = _values(words["ids"])
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(numbers, kind="stable")
    own = sizes[order]
    if len(ids):
        flat = np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        ids = ids[flat]
    column = docs["codes"].combine_chunks()
    column = column.chunks[0] if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    codes, last = unpacked(data)
    return ids, own, codes, np.diff(np.searchsorted(last, ends - ends[0]))


def _sides(cut_rows: DataFrame, path: str | None, with_ids: bool):
    docs = cut_rows.filter("codes is not null").select(F.col("block").alias("at"), "key", "codes", "label")
    return docs.groupBy("at").cogroup(replayed(cut_rows, path, with_ids).groupBy("block"))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block: int = PIECE) -> DataFrame:
    """(key, ids): the ids of each text. block: characters that are split at once."""
    kind = documents.schema[key].dataType

    def put_together(docs: pa.Table, words: pa.Table) -> pa.Table:
        flat, counts = gathered(*_block(docs, words))
        stop = np.append(0, np.cumsum(counts))
        keys = docs["key"].combine_chunks()
        out, i = [], 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(stop, stop[i] + OUT_IDS, side="right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array((stop[i : j + 1] - stop[i]).astype(np.int32)), pa.array(flat[stop[i] : stop[j]]))
            out.append(pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists], ["key", "ids"]))
            i = j
        return pa.Table.from_batches(out)

    rows = cut(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), block)
    out = _sides(rows, path, True).applyInArrow(put_together, f"key {kind.simpleString()}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def token_counts(documents: DataFrame, text: str, columns: list[str], path: str | None = None, block: int = PIECE, label: Label | None = None) -> DataFrame:
    """The columns and n_tokens, as many as token_ids() lists for the row's text; and label, if a function gives it."""

    def counted(docs: pa.Table, words: pa.Table) -> pa.Table:
        _, sizes, codes, per_text = _block(docs, words)
        totals = np.append(0, np.cumsum(sizes[codes] if len(codes) else codes.astype(np.int64)))
        return pa.table({"key": docs["key"], "n_tokens": np.diff(totals[np.append(0, np.cumsum(per_text))]), "label": docs["label"]})

    packed_columns = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = cut(documents.select(packed_columns.alias("key"), F.col(text).alias("text")), block, label)
    out = _sides(rows, path, False).applyInArrow(counted, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint, label int")
    return out.select(*[F.col(f"key.c{i}").alias(c) for i, c in enumerate(columns)], "n_tokens", *([] if label is None else ["label"]))


def texts_of(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the texts that lists of ids stand for; an empty text for an empty list and for none."""
    spark = rows.sparkSession
    shipped(spark)
    kind = rows.schema[key].dataType
    shared = spark.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        size = np.diff(vocab.starts)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            per = size[flat]
            ends = np.append(0, np.cumsum(per))
            data = vocab.bytes[np.repeat(vocab.starts[flat] - ends[:-1], per) + np.arange(ends[-1])].tobytes()
            stops = ends[np.append(0, np.cumsum([len(x) for x in lists]))]
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind.simpleString()}, text string")
    return out.select(F.col("key").alias(key), "text")
