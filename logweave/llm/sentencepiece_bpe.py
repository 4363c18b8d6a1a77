"""Exact merge-type (BPE) encoding and decoding of a SentencePiece model, by backtracking.

Merging pair by pair is replaced by a search for the only sequence of pieces in which every two neighbours stay apart
when merged anew. An Aho-Corasick pass gives the longest piece at each position. From the left, the longest piece that gets on
with its left neighbour is taken; where none does, the last one is given up for its next shorter prefix, and the position is
marked in a bitfield so that it is never tried again. Whether two pieces get on is found by merging their characters
anew, once for each pair.

No piece has a space mark after another character (checked when a model is loaded), and merges never cross
characters that no piece has. So a text falls into words that are encoded alone, and results are remembered by word.
"""

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from logweave.llm.common import map_rows, texts

MARK = "▁"
#: Remembered words and pairs for each Python worker; beyond, the memory starts anew.
MOST_WORDS, MOST_PAIRS, LONG_WORD = 600_000, 1_000_000, 64
# Fixed values of the model format: piece types and the field numbers that are read.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float, int]]
    byte_fallback: bool = False
    dummy_prefix: bool = True
    bos: int = 1
    eos: int = 2
    unk: int = 0

    @classmethod
    def parse(cls, data: bytes) -> "Vocabulary":
        out = cls([])
        extra_spaces, charsmap, kind, suffix = True, b"", 1, 0
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                out.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                t = dict(fields(value))
                kind, out.byte_fallback, suffix = t.get(3, 1), bool(t.get(35, 0)), t.get(24, 0)
                out.unk, out.bos, out.eos = t.get(40, 0), t.get(41, 1), t.get(42, 2)
            elif number == 3:
                n = dict(fields(value))
                charsmap, out.dummy_prefix, extra_spaces = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
        if kind != BPE_MODEL or charsmap or extra_spaces or suffix or not out.byte_fallback or any(t == USER_DEFINED for _, _, t in out.pieces):
            raise ValueError("only merge-type models with byte fallback and no normalisation")
        return out


class Codec:
    def __init__(self, model: bytes):
        v = self.vocab = Vocabulary.parse(model)
        self.ids = {p: i for i, (p, _, t) in enumerate(v.pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in v.pieces if t == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a space mark inside")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(v.pieces) if t == BYTE}
        self.automaton = ahocorasick.Automaton()
        reachable = [p for p in self.ids if self.bpe(p) == [p]]  # others can never come out
        for p in reachable:
            self.automaton.add_word(p, (len(p) - 1, self.ids[p]))
        self.automaton.make_automaton()
        #: Characters that are no piece get numbers after the vocabulary's.
        self.text, self.size, self.singles = [p for p, _, _ in v.pieces], [len(p) for p, _, _ in v.pieces], {}
        self.next_shorter = [-1] * len(v.pieces)
        self.packed = [struct.pack("<I", i) for i in range(len(v.pieces))]
        known = set(reachable)
        for p in reachable:
            n = next((n for n in range(len(p) - 1, 0, -1) if p[:n] in known), 0)
            self.next_shorter[self.ids[p]] = self.ids[p[:n]] if n else self.single(p[0]) if len(p) > 1 else -1
        self.split = self.splitter()
        self.agree: dict[int, bool] = {}
        self.words = Words(self)
        self.plain = []
        self.byte_of = {i: b for b, i in self.bytes.items()}
        for i, (p, _, t) in enumerate(v.pieces):
            self.plain.append(b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([self.byte_of[i]]) if t == BYTE else p.replace(MARK, " ").encode())

    def splitter(self):
        """Cuts a text where no piece reaches across: before a space mark, and around a newline that no piece has."""
        alone = not any("\n" in p for p in self.ids)
        return re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def bpe(self, s: str) -> list[str]:
        """Plain merging, for strings as short as two pieces: the best score first, then the leftmost."""
        parts = list(s)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, where = x, i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def single(self, char: str) -> int:
        """The number of a character that is no piece."""
        number = self.singles.get(char)
        if number is None:
            number = self.singles[char] = len(self.text)
            self.text.append(char)
            self.size.append(1)
            self.next_shorter.append(-1)
            self.packed.append(b"".join(struct.pack("<I", self.bytes[b]) for b in char.encode("utf-8", "replace")))
        return number

    def stays_apart(self, a: int, b: int) -> bool:
        if len(self.agree) >= MOST_PAIRS:
            self.agree.clear()
        x, y = self.text[a], self.text[b]
        known = self.agree[a << 32 | b] = self.bpe(x + y) == [x, y]
        return known

    def segment(self, word: str) -> list[int]:
        """Numbers of the pieces (and of characters that are none)."""
        n = len(word)
        longest = [-1] * n
        for end, (back, number) in self.automaton.iter(word):
            longest[end - back] = number  # ends come in order, so the longest of a start comes last
        if longest[0] >= 0 and self.size[longest[0]] == n:
            return [longest[0]]
        out: list[int] = []
        get, size, shorter = self.agree.get, self.size, self.next_shorter
        at = failed = 0
        piece, left = longest[0] if longest[0] >= 0 else self.single(word[0]), -1
        while True:
            end = at + size[piece]
            ok = not (failed and failed >> end & 1)
            if ok and left >= 0:
                ok = get(left << 32 | piece)
                if ok is None:
                    ok = self.stays_apart(left, piece)
            if ok:
                out.append(piece)
                if end == n:
                    return out
                at, left, piece = end, piece, longest[end]
                if piece < 0:
                    piece = self.single(word[at])
                continue
            piece = shorter[piece]
            while piece < 0:  # nothing begins here: mark it, and shorten the piece before
                failed |= 1 << at
                piece = out.pop()
                at -= size[piece]
                piece = shorter[piece]
            left = out[-1] if out else -1

    def encode_word(self, word: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join([self.packed[i] for i in self.segment(word)])

    def encode_packed(self, text: str | None) -> bytes:
        """All ids with begin and end, packed."""
        v = self.vocab
        s = (text or "").replace(" ", MARK)
        if s and v.dummy_prefix:
            s = MARK + s
        return struct.pack("<I", v.bos) + b"".join(map(self.words.__getitem__, self.split(s))) + struct.pack("<I", v.eos)

    def encode(self, text: str | None) -> list[int]:
        data = self.encode_packed(text)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """Runs of byte pieces become characters, each bad byte a replacement character; the first space goes."""
        if ids.count(self.vocab.bos) > 1 or ids.count(self.vocab.eos) > 1:
            return self._decode_by_piece(ids)
        data = b"".join(map(self.plain.__getitem__, ids))
        if self.vocab.dummy_prefix:
            first = next((i for i in ids if self.vocab.pieces[i][2] != CONTROL), None)
            if first is not None and self.vocab.pieces[first][0].startswith(MARK):
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_by_piece(ids)

    def _decode_by_piece(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True

        def flush():
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    del run[:1]

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            flush()
            if self.vocab.pieces[i][2] == CONTROL:
                continue
            s = self.plain[i].decode()
            out.append(s[1:] if first and self.vocab.dummy_prefix and self.vocab.pieces[i][0].startswith(MARK) else s)
            first = False
        flush()
        return "".join(out)


class Words(dict):
    """Word -> packed ids; bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        out = self.codec.encode_word(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = out
        return out


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids as packed 32-bit integers, decoded) for every row; null counts as the empty text.

    The model's bytes (a file of fixed size) travel with the task; each Python worker builds its tables once.
    """
    return _mapped(docs, model_file, id_col, text_col, "doc_id bigint, n_tokens bigint, ids binary, decoded string", lambda n, ids, decoded: (n, ids, decoded))


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 in place of the long columns, so that they never leave the worker."""
    from hashlib import sha256

    return _mapped(docs, model_file, id_col, text_col, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda n, ids, decoded: (n, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest()))


def _mapped(docs, model_file, id_col, text_col, schema, shape) -> DataFrame:
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(source):
        c = codec(shared.value)
        for doc_id, text in source:
            ids = c.encode_packed(text)
            n = len(ids) // 4
            yield doc_id, *shape(n, ids, c.decode(memoryview(ids).cast("I").tolist()))

    return map_rows(texts(docs, id_col, text_col), rows, schema)
