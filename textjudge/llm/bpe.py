"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never end
up in one token: the place between the two is a certain cut. Texts are cut before white
space where every such pair is forced, the pieces are split by the pre-tokenizer, its
pieces again at every forced pair, and each fragment is encoded alone. The ids of a text
are those of its fragments, one after the other. Fragments repeat, so a bounded memory of
encoded fragments answers most of them.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textjudge.llm.common import id_and_text, id_type, small_batches

#: fixed value: the pattern of byte-level pre-tokenizers, white space written out
SPACE_CLASS = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE_CLASS}\p{{L}}\p{{N}}]+|[{SPACE_CLASS}]+(?![^{SPACE_CLASS}])|[{SPACE_CLASS}]+"
)
BLANK = b" \t\n\x0b\x0c\r"
#: a whole run of ASCII and Latin-1 letters, with the one space before it that belongs to it
WORD = rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])"
PLAIN = re.compile(WORD).fullmatch
#: a byte as the first of a pair
HIGH = [b << 8 for b in range(256)]
#: encoded fragments a worker remembers, and the longest fragment among them
REMEMBERED, LONGEST = 600_000, 48


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from the JSON text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec.get("normalizer") or before.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer and added prefix space")
        letters = byte_letters()
        code = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for text, i in ids.items():
            self.tokens[i] = bytes(code[c] for c in text)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.single = [ids[letters[b]] for b in range(256)]
        #: both ids in one number -> rank and new id in one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        self.forced = np.ones((256, 256), bool)
        for text in ids:
            token = [code[c] for c in text]
            self.forced[token[:-1], token[1:]] = False
        self.forced_flags = self.forced.tobytes()
        # bytes after which white space may go on in the same token: no cut there
        open_ = [b for b in range(256) if b not in BLANK and not self.forced[b, list(BLANK)].all()]
        further = b"(?:(?<=[%s])[ \\t-\\r]+[^ \\t-\\r]*)*" % b"".join(b"\\x%02x" % b for b in open_) if open_ else b""
        # plain words, line breaks and marks are pre-tokens as they stand; other pieces
        # reach to the next white space and go through the pre-tokenizer
        self.pieces = re.compile(WORD + rb"|\n(?=[!-~])|[!-/:-@\[-`{-~]++(?=[ \n]|\Z)|[ \t-\r]*[^ \t-\r]+%s|[ \t-\r]+" % further)
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.memory: dict[bytes, bytes] = {}
        self.short: dict[bytes, list[int]] = {}
        lengths = np.array([len(t) for t in self.tokens])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of added tokens in it are those tokens."""
        if self.marks is None or not self.marks.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        parts, end = [], 0
        for m in self.marks.finditer(text):
            parts += [self._plain(text[end : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            end = m.end()
        return np.frombuffer(b"".join([*parts, self._plain(text[end:])]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[place].tobytes().decode("utf-8", "replace")

    def _plain(self, text: str) -> bytes:
        data = text.encode()
        memory = self.memory
        pieces = self.pieces.findall(data)
        parts = list(map(memory.get, pieces))
        if None in parts:
            for k, piece in enumerate(pieces):
                if parts[k] is None:
                    ids = memory.get(piece)
                    if ids is None:
                        ids = self._piece(piece)
                        if len(piece) <= LONGEST:
                            if len(memory) >= REMEMBERED:
                                memory.clear()
                            memory[piece] = ids
                    parts[k] = ids
        return b"".join(parts)

    def _piece(self, piece: bytes) -> bytes:
        if PLAIN(piece):
            return array("i", self._cut(piece)).tobytes()
        out: list[int] = []
        for token in PRETOKEN.findall(piece.decode()):
            data = token.encode()
            ids = self.short.get(data)
            if ids is None:
                ids = self._cut(data)
                if len(data) <= LONGEST:
                    if len(self.short) >= REMEMBERED // 4:
                        self.short.clear()
                    self.short[data] = ids
            out += ids
        return array("i", out).tobytes()

    def _cut(self, data: bytes) -> list[int]:
        """Encode a pre-token fragment by fragment, cut at its forced pairs."""
        forced, out, start = self.forced_flags, [], 0
        for k, pair in enumerate(map(add, map(HIGH.__getitem__, data), data[1:]), 1):
            if forced[pair]:
                out += self._fragment(data[start:k])
                start = k
        last = self._fragment(data[start:])
        return out + last if out else last

    def _fragment(self, data: bytes) -> list[int]:
        ids = list(map(self.single.__getitem__, data))
        if len(ids) < 2:
            return ids
        return self._merged_long(ids) if len(ids) > 40 else self._merged(ids)

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        get, none = self.merges.get, 1 << 60
        found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            k = found.index(best)
            new = ids[k] = best & 0xFFFFF
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = get(ids[k - 1] << 20 | new, none)
            if k < len(found):
                found[k] = get(new << 20 | ids[k + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for fragments of any length."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank and new id, place), so that the lowest rank comes first, then the leftmost
        heap = [(m, k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or get(ids[k] << 20 | ids[j]) != m:
                continue
            ids[k], ids[j], after[k] = m & 0xFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (m := get(ids[left] << 20 | ids[right])) is not None:
                    heapq.heappush(heap, (m, left))
        return [i for i in ids if i >= 0]


@cache
def vocabulary(source: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(source)


def encode_documents(docs: DataFrame, vocabulary_path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int> and, if asked, the decoded text.

    Null counts as empty text, which has no ids. Repeated rows are encoded one by one; an
    empty table gives an empty result; other columns are not read. The vocabulary file is
    read on the driver and broadcast: its size does not depend on the documents.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(source.value)
        for batch in batches:
            for part in small_batches(batch):
                found = [vocab.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate([np.empty(0, np.int32), *found])
                arrays = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
                if decoded:
                    arrays.append(pa.array([vocab.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"][: len(arrays)])

    schema = f"doc_id {id_type(docs, id_col)}, ids array<int>" + ", decoded string" * decoded
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and text of rows with an ``ids`` array; null ids give an empty text."""
    with open(vocabulary_path, encoding="utf-8") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        vocab = vocabulary(source.value)
        for batch in batches:
            for part in small_batches(batch):
                texts = [vocab.decode(np.array(x or [], np.int32)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type(encoded)}, text string")
