"""Packing of tokenised documents into training sequences by bounded-space online best-fit.

A packer holds at most `OPEN_BINS` open sequences, keyed by their free space: bit f of one integer is set while a
sequence with f free tokens is open, so the tightest fit for a piece is the lowest set bit at or above its length. A
piece that fits nowhere opens a sequence; if that would be one too many, the fullest open sequence closes first.

A document longer than a sequence is cut so that all pieces but the first are whole sequences by themselves; only the
first, shorter piece is packed. Pieces are dealt by hash into groups of about `GROUP` pieces; each group is packed
online by a task of its own, so its memory is bounded and the number of groups follows the input.

Token ids are those of the tokenizer as its file sets it up, special tokens in a text included. Byte-level pre-tokens
never reach across a space that follows a non-space, so the text is cut there, and words of Latin letters, digits and marks
are cut into their pre-tokens. Words and pre-tokens are remembered; the memo is bounded, and what is beyond it is encoded
again when it recurs. A text with one of the tokenizer's added tokens is encoded whole.

Defined cases: null text is empty, and an empty document is its end token alone; repeated rows are packed as often as
they occur; null ids are kept.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import map_batches, materialize, remembered

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 1024
GROUP = 12_000
#: Words, and parts of words, whose ids a worker remembers, and the longest of them.
MEMO = 400_000
MEMO_CHARS = 64
LOOSE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")
#: ASCII marks without the apostrophe, which begins pre-tokens such as 's.
MARKS = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'")
LAST_LETTER = "\u00ff"
_LETTER, _MARK = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", re.escape(MARKS)
#: Words whose pre-tokens are plain to see: runs of Latin letters, of digits, of marks, single line ends within.
SIMPLE = re.compile(rf"[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*").fullmatch
PARTS = re.compile(rf"[{_LETTER}]+|[0-9]+|[{_MARK}]+|\n").findall


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable Latin-1 by itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


BYTES = byte_letters()
SPACE = BYTES[32]
TO_BYTES = int.to_bytes


class Memo(dict):
    """Ids, as bytes (little-endian unsigned 32-bit), of a space and the word that is the key; bounded, filled by look-ups."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A text with one of these is encoded whole: the tokenizer cuts it there before it looks at spaces.
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's model alone."""
        written = SPACE + text[1:] if text.isascii() and text[0] == " " else text.encode().decode("latin-1").translate(BYTES)
        return b"".join([TO_BYTES(t.id, 4, "little") for t in self.model.tokenize(written)])

    def inner(self, text: str) -> bytes:
        """part(), remembered."""
        ids = self.parts.get(text)
        if ids is None:
            ids = self.part(text)
            if len(self.parts) < MEMO and len(text) <= MEMO_CHARS:
                self.parts[text] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if stem and stem.isalpha() and (stem.isascii() or max(stem) <= LAST_LETTER):
            ids = self.part(" " + word) if len(stem) == len(word) else self[stem] + self.inner(word[len(stem) :])
        elif SIMPLE(word):
            first, *rest = PARTS(word)
            ids = b"".join([self[first] if first != word else self.part(" " + word), *map(self.inner, rest)])
        else:
            ids = self.encode(" " + word)
        if len(self) < MEMO and len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids that the tokenizer gives for the whole text."""
        if self.added(text):
            return self.encode(text)
        of = self.__getitem__
        if text[:1] == " " or LOOSE.search(text):
            return b"".join([of(x[1:]) if x[:1] == " " else self.encode(x) for x in CUT.split(text)])
        head, *rest = text.split(" ")
        return self.encode(head) + b"".join(map(of, rest))


def memo_of(path: str) -> Memo:
    """One memo per Python worker and tokenizer, for as long as the worker packs."""
    memos = remembered("packing")
    if path not in memos:
        memos[path] = Memo(path)
    return memos[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what the whole sequences leave."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (task and number of the piece: tells repeated rows apart)."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, row = memo_of(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = memo.ids(t or "") + end
                for k, (s, n) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    out.append((i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), row))
                    row += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return map_batches(docs, each, "doc_id long, piece int, start long, length long, ids_crc32 long, row long", "packing")


class Packer:
    """Online best-fit over a fixed number of open bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: a bin with f free is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self.take(space)
        else:
            if self.open >= self.most:
                self.take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, bin_ = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:  # a full bin is closed
            self.bins[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.capacity - space

    def take(self, space: int) -> int:
        bin_ = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return bin_


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_pieces = materialize(pieces(source, tokenizer or default_tokenizer(), capacity), "pieces")
    whole, part = all_pieces.where(F.col("length") == capacity), all_pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(capacity, open_bins)
        pdf = pdf.sort_values(["order", "row"])
        placed = [packer.put(n) for n in pdf["length"].tolist()]
        base = int(pdf["group"].iloc[0]) << 32
        return pdf.assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed])[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = part.withColumn("order", F.xxhash64("doc_id", "row")).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(each, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
