"""Byte-level BPE as a finite-state transducer that is determinised as texts need it.

A sequence of tokens is what merging gives for its bytes exactly if merging leaves any two neighbours
apart. So a machine that guesses where tokens end, and checks each pair, reads one byte after the
other and has just one way to the end of a word. Its determinised form holds all guesses still open:
for each the last token, the bytes of the token under way, and the tokens not yet given out. What all
guesses have in common is given out at once; a guess is gone when its bytes begin no token, so the
longest token bounds how far the machine looks ahead.

Decoding is a stream too: a state machine over UTF-8 passes on characters as soon as they are whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, texts

#: Words, pairs of tokens and states a worker keeps (some 400 MB); beyond that each starts anew.
MEMO, STATES = 400_000, 300_000
#: Longer words go through the machine each time.
MEMO_LENGTH = 48
#: Tokens of a task that are held before they are passed on.
FLUSH_TOKENS = 500_000
REPLACEMENT = "�"


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    """Token bytes and their ids from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}


class Memo(dict):
    """Remembers what a function gave for each key, up to MEMO keys."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= MEMO:
            self.clear()
        self[key] = value
        return value


class State(dict):
    """A determinised state: by the next byte, the state after it and the tokens given out on the way.

    `open` holds the guesses (last token or -1, bytes under way, tokens not yet given out).
    """

    def __init__(self, machine: Transducer, guesses: tuple):
        super().__init__()
        self.machine, self.open = machine, guesses

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        step = self.machine.step(self.open, byte)
        self[byte] = step
        return step


class Transducer:
    """Encoder of one table of ranks. Merging joins the two neighbours whose joint bytes rank lowest, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        if any(bytes((b,)) not in ranks for b in range(256)) or len(self.token) < len(ranks):
            raise ValueError("every byte needs a rank of its own, and every rank one token")
        # The two parts that merging joins last; single bytes have none, unreachable tokens are left out.
        self.parts: dict[int, tuple[int, int] | None] = {ranks[bytes((b,))]: None for b in range(256)}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                left = self.merged(token, rank)
                if len(left) == 2 and all(p in self.parts for p in left):
                    if max(left) > rank:
                        raise ValueError("a token ranks before the parts it is made of")
                    self.parts[rank] = (left[0], left[1])
        #: By the bytes that begin a token: the token that they are, if merging reaches it, else None.
        self.prefixes: dict[bytes, int | None] = {token[:k]: None for token in ranks for k in range(1, len(token) + 1)}
        self.prefixes |= {token: rank for token, rank in ranks.items() if rank in self.parts}
        self.byte = [bytes((b,)) for b in range(256)]
        self.width = max(self.token) + 1
        self.apart = Memo(self._apart)
        self.states: dict[tuple, State] = {}
        self.start = self._state(((-1, b"", ()),))
        self.words = Memo(self._word)

    def merged(self, data: bytes, below: int) -> list[int]:
        """The ids that merging leaves of `data`, with the ranks under `below` only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _apart(self, pair: int) -> bool:
        """Whether merging the bytes of two tokens in one leaves the border between them.

        While a token is merged its edge grows part by part, each standing there from its own rank to
        that of the next. Two parts that stand at the border together are joined if the rank of both
        falls into that time; of equal joins the leftmost comes first.
        """
        (x, y), x_until, y_until = divmod(pair, self.width), 1 << 62, 1 << 62
        token, prefixes, parts = self.token, self.prefixes, self.parts
        while True:
            rank = prefixes.get(token[x] + token[y])
            if rank is not None and x < rank < x_until and y < rank <= y_until:
                return False
            x_parts, y_parts = parts[x], parts[y]
            if x_parts and (x > y or not y_parts):
                x_until, x = x, x_parts[1]
            elif y_parts:
                y_until, y = y, y_parts[0]
            else:
                return True

    def _state(self, guesses: tuple) -> State:
        state = self.states.get(guesses)
        if state is None:
            if len(self.states) >= STATES:
                for old in self.states.values():
                    old.clear()
                self.states.clear()
                self.start.clear()
                self.states[self.start.open] = self.start
            state = self.states[guesses] = State(self, guesses)
        return state

    def step(self, guesses: tuple, byte: int) -> tuple[State, tuple[int, ...]]:
        """All guesses after one more byte, less the tokens that they agree on."""
        now, ended, byte = [], None, self.byte[byte]
        prefixes, apart, width = self.prefixes, self.apart, self.width
        for last, under_way, waiting in guesses:
            read = under_way + byte
            if read in prefixes:
                now.append((last, read, waiting))
                token = prefixes[read]
                if token is not None and (last < 0 or apart[last * width + token]):
                    ended = (token, b"", (*waiting, token))
        if ended:
            now.append(ended)
        first = now[0][2]
        if not first:
            return self._state(tuple(now)), ()
        common = 0
        while common < len(first) and all(len(w) > common and w[common] == first[common] for _, _, w in now):
            common += 1
        return self._state(tuple((last, read, w[common:]) for last, read, w in now)), first[:common]

    def run(self, word: Iterable[int]) -> list[int]:
        """The ids of the bytes of one word, given out as the machine goes."""
        out: list[int] = []
        state = self.start
        for byte in word:
            state, given = state[byte]
            if given:
                out += given
        for _, under_way, waiting in state.open:
            if not under_way:
                return out + list(waiting)
        raise ValueError("the ranks leave bytes that no tokens make up")

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        whole = self.ranks.get(data)  # a word that is a token counts as one, even if merging does not reach it
        return (whole,) if whole is not None else tuple(self.run(data))

    def encode(self, words: Iterable[str]) -> list[int]:
        """The ids of the words of a text, each encoded by itself."""
        known, out = self.words, []
        for word in words:
            out += known[word] if len(word) <= MEMO_LENGTH else self._word(word)
        return out


def _followers(read: bytes) -> tuple[int, int, int]:
    """After the bytes `read` of a character: how many are missing, and the range of the next one."""
    lead = read[0]
    length = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
    low, high = 0x80, 0xBF
    if len(read) == 1:  # no overlong forms, no surrogates, nothing beyond the last code point
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    return length - len(read), low, high


class StreamDecoder:
    """Text of a stream of ids. A state is the bytes of a character that is not whole yet; steps are remembered."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.states: dict[bytes, Memo] = {}

    def _state(self, read: bytes) -> Memo:
        if read not in self.states:
            self.states[read] = Memo(lambda token: self._step(read, self.tokens[token]))
        return self.states[read]

    def _step(self, read: bytes, data: bytes) -> tuple[Memo, str]:
        out: list[str] = []
        for byte in data:
            if read:
                missing, low, high = _followers(read)
                if low <= byte <= high:
                    read += bytes((byte,))
                    if missing == 1:
                        out.append(read.decode())
                        read = b""
                    continue
                out.append(REPLACEMENT)  # what was begun cannot be ended; the byte begins anew
                read = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                read = bytes((byte,))
            else:
                out.append(REPLACEMENT)
        return self._state(read), "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The whole characters of each id as it comes; a character cut off at the end becomes U+FFFD."""
        state = self._state(b"")
        for token in ids:
            state, text = state[token]
            yield text
        if state is not self._state(b""):
            yield REPLACEMENT


_MACHINES: dict[bytes, tuple[Transducer, StreamDecoder]] = {}


def _machine(ranks: bytes) -> tuple[Transducer, StreamDecoder]:
    key = hashlib.sha256(ranks).digest()
    if key not in _MACHINES:
        coder = Transducer(read_ranks(ranks))
        _MACHINES[key] = coder, StreamDecoder(coder.token)
    return _MACHINES[key]


FIELDS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "n_tokens": (pa.int64(), "long"),
    "ids_sha256": (pa.string(), "string"),
    "decoded": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def encode_bytes(docs: DataFrame, ranks: bytes, pattern: str, fields: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode every whole text and decode it again: doc_id and the asked `fields`.

    `ids`: the ids of all matches of `pattern`, each encoded by itself, without special tokens;
    characters outside of all matches have none. `n_tokens` and `ids_sha256` (decimal ids joined by
    one space) describe them. `decoded` is the text the ids give back, `decoded_sha256` the digest of
    its UTF-8 bytes. One row per input row, also for repeated rows. A null or empty text has no ids
    and decodes to the empty text; a null doc_id stays null; texts and words of any length are
    encoded whole, in time that grows with their length; an empty table gives an empty one. Other
    columns, whatever their names, are not read.

    `ranks`: bytes of a rank file (under 2 MB, sent to each executor once).
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    schema = pa.schema([("doc_id", pa.int64()), *((f, FIELDS[f][0]) for f in fields)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        coder, decoder = _machine(shared.value[0])
        split = regex.compile(shared.value[1]).findall
        decimal = Memo(str)
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            start = held = 0
            for at, text in enumerate(batch.column(1)):
                ids = coder.encode(split(text.as_py() or ""))
                held += len(ids)
                decoded = "".join(decoder.stream(ids)) if any(f.startswith("decoded") for f in fields) else ""
                for column, field in zip(rows, fields):
                    if field == "ids":
                        column.append(np.array(ids, np.int32))
                    elif field == "n_tokens":
                        column.append(len(ids))
                    elif field == "ids_sha256":
                        column.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    elif field == "decoded":
                        column.append(decoded)
                    else:
                        column.append(hashlib.sha256(decoded.encode()).hexdigest())
                if held >= FLUSH_TOKENS:
                    yield arrow_rows(schema, [batch.column(0).slice(start, at + 1 - start), *rows])
                    rows, start, held = [[] for _ in fields], at + 1, 0
            if start < batch.num_rows:
                yield arrow_rows(schema, [batch.column(0).slice(start), *rows])

    return texts(docs).mapInArrow(encode, ", ".join(["doc_id long", *(f"{f} {FIELDS[f][1]}" for f in fields)]))


def decode_bytes(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Texts of rows (doc_id, ids), in any order: doc_id, text.

    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character, and so does
    a character cut off at the end. Null ids give a null text, no ids the empty one; an id that is not
    in the table of ranks fails the job. Repeated rows stay; other columns are not read.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _machine(shared.value)[1]
        for batch in batches:
            given = [ids.as_py() for ids in batch.column(1)]
            yield arrow_rows(schema, [batch.column(0), [None if x is None else "".join(decoder.stream(x)) for x in given]])

    slim = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return slim.mapInArrow(decode, "doc_id long, text string")
