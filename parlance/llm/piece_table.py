"""Encoding and decoding with a SentencePiece BPE model by a table of prefixes.

Which piece ends a prefix of a text does not depend on what follows it. So one pass over the text
stores, for each prefix, the one last piece: among the pieces that an automaton finds to end there it
is the one that merging would leave standing next to the last piece of the prefix before it. Walking
back from the end of the text then gives the ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, kept, texts

MARK = "▁"
#: Entries a worker keeps of words seen and of pairs tested; beyond that it starts anew.
MEMO = 250_000
#: Tokens of a task that are held before they are passed on.
FLUSH_TOKENS = 500_000
#: Steps a worker keeps of each state of the automaton.
MEMO_STEPS = 10_000
#: Longer words are encoded each time.
MEMO_LENGTH = 48


class Memo(dict):
    """Remembers what a function gave for each key, up to MEMO keys."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if not isinstance(key, str) or len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class PieceTable:
    """Encoder of one model. Merging joins two neighbours if their text is a piece, best score first, leftmost first.

    The model must be a BPE model with byte fallback, a leading mark, no other normalisation, and no
    piece with a mark after another character or with a line feed; others raise ValueError. Such
    pieces never reach over a mark that follows another character, so words are independent.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(lib.get_piece_size())]
        pieces = {lib.id_to_piece(i): i for i, s in enumerate(special) if not s and not lib.is_unused(i)}
        self.ids = pieces
        self.score = {p: lib.get_score(i) for p, i in pieces.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes) or any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("the model has no byte fallback, or pieces that reach over words or lines")
        probe = " A  ﬁ① é\tＡ "
        if lib.decode(lib.encode(probe)) != probe or lib.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("the model normalises its input or has no leading mark")
        # Every character of a piece takes part in merging, be it a piece itself or not.
        self.names = sorted(set(pieces).union(*pieces))
        self.number = {piece: k for k, piece in enumerate(self.names)}
        self.start = len(self.names)  # stands for the start of a word, or a character that no piece has
        self.prefixes = {piece[:k] for piece in self.names for k in range(len(piece) + 1)}
        self.joints = {piece[k : k + 2] for piece in self.names for k in range(len(piece) - 1)}
        self.nodes: dict[str, tuple[dict, str, tuple]] = {}
        self.root = self._node("")
        self.fits = Memo(self._fits)
        self.after_space = Memo(lambda word: self.encode_word(MARK + word))
        self.at_start = Memo(self.encode_word)
        self.decimal = [str(i) for i in range(lib.get_piece_size())]

    def merged(self, text: str, border: int = -1) -> list[str] | None:
        """The pieces that merging leaves of `text`; None as soon as one reaches over `border`."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if border >= 0:
                start = sum(map(len, symbols[:at]))
                if start < border < start + len(symbols[at]):
                    return None

    def _fits(self, pair: int) -> bool:
        """Whether merging leaves both pieces standing side by side; the left one may be the start."""
        left, right = divmod(pair, self.start + 1)
        if left == self.start:
            return self.merged(self.names[right]) == [self.names[right]]
        left, right = self.names[left], self.names[right]
        return self.merged(left + right, len(left)) == [left, right]

    def _node(self, seen: str) -> tuple[dict, str, tuple]:
        """A state of the automaton: its steps, the longest piece prefix just read, the pieces that end here, longest first."""
        if seen not in self.nodes:
            ends = [seen[k:] for k in range(len(seen)) if seen[k:] in self.number]
            self.nodes[seen] = ({}, seen, tuple((self.number[p], len(p)) for p in ends))
        return self.nodes[seen]

    def _step(self, node: tuple[dict, str, tuple], char: str) -> tuple[dict, str, tuple]:
        """The state after one more character; steps are worked out when they are first taken."""
        seen = node[1] + char
        while seen not in self.prefixes:
            seen = seen[1:]
        if len(node[0]) < MEMO_STEPS:
            node[0][char] = self._node(seen)
        return self._node(seen)

    def encode_word(self, word: str) -> bytes:
        """The ids of a word, four bytes each: workers remember many words, and bytes cost them least."""
        if 1 < len(word) <= MEMO_LENGTH and word[-2:] not in self.joints:  # no piece reaches over that point
            head = self.after_space[word[1:-1]] if word[0] == MARK else self.at_start[word[:-1]]
            return head + self.at_start[word[-1]]
        start, fits, width, node = self.start, self.fits, self.start + 1, self.root
        last = [start]  # the last piece of each prefix
        for char in word:
            node = node[0].get(char) or self._step(node, char)
            for piece, length in node[2]:
                if fits[last[-length] * width + piece]:
                    last.append(piece)
                    break
            else:
                last.append(start)
        out: list[int] = []
        end = len(word)
        while end:
            piece = self.names[last[end]] if last[end] != start else word[end - 1]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
            end -= len(piece)
        out.reverse()
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        if not text:
            return []
        parts: list[bytes] = []
        feed = self.at_start["\n"]
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:
                parts.append(feed)
            if "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                marked = (MARK if not k else "") + line.replace(" ", MARK)
                for word in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked):
                    parts.append(self.after_space[word[1:]] if word[0] == MARK else self.at_start[word])
                continue
            words = line.split(" ")
            if k:
                parts.append(self.at_start[words[0]])
                del words[0]
            parts.extend(map(self.after_space.__getitem__, words))
        return np.frombuffer(b"".join(parts), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _table(model: bytes) -> PieceTable:
    return kept(("pieces", hashlib.sha256(model).digest()), lambda: PieceTable(model))


FIELDS = {
    "ids": pa.list_(pa.int32()),
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded": pa.string(),
    "decoded_sha256": pa.string(),
}


def encode_pieces(docs: DataFrame, model: bytes, fields: tuple[str, ...] = ("ids",), end_id: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: doc_id and the asked `fields`.

    `ids`: the ids, with the model's end id after them unless `end_id` is false; `n_tokens` and
    `ids_sha256` (decimal ids joined by one space) describe them. `decoded`, `decoded_sha256`: the
    text that the ids give back. One row per input row, also for repeated rows. A null text counts
    as empty (the end id alone); a null doc_id stays null; texts of any length are encoded whole;
    an empty table gives an empty one. Other columns are not read.

    `model`: bytes of the model file, sent to each executor once (under 1 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), *((f, FIELDS[f]) for f in fields)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _table(shared.value)
        end = [own.library.eos_id()] if end_id else []
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            start = held = 0
            for at, text in enumerate(batch.column(1)):
                ids = own.encode(text.as_py() or "") + end
                held += len(ids)
                decoded = own.decode(ids) if any(f.startswith("decoded") for f in fields) else ""
                for column, field in zip(rows, fields):
                    if field == "ids":
                        column.append(np.array(ids, np.int32))
                    elif field == "n_tokens":
                        column.append(len(ids))
                    elif field == "ids_sha256":
                        column.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                    elif field == "decoded":
                        column.append(decoded)
                    else:
                        column.append(hashlib.sha256(decoded.encode()).hexdigest())
                if held >= FLUSH_TOKENS:
                    yield arrow_rows(schema, [batch.column(0).slice(start, at + 1 - start), *rows])
                    rows, start, held = [[] for _ in fields], at + 1, 0
            if start < batch.num_rows:
                yield arrow_rows(schema, [batch.column(0).slice(start), *rows])

    spark_types = {"ids": "array<int>", "n_tokens": "long"}
    kinds = ", ".join(f"{f} {spark_types.get(f, 'string')}" for f in fields)
    return texts(docs).mapInArrow(encode, f"doc_id long, {kinds}")


def decode_pieces(encoded: DataFrame, model: bytes) -> DataFrame:
    """Texts of rows (doc_id, ids), in any order: doc_id, text. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _table(shared.value)
        for batch in batches:
            given = [ids.as_py() for ids in batch.column(1)]
            yield arrow_rows(schema, [batch.column(0), [None if x is None else own.decode(x) for x in given]])

    slim = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return slim.mapInArrow(decode, "doc_id long, text string")
