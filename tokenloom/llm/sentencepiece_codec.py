"""SentencePiece encoding and decoding with forward states shared between words.

A text is marked as SentencePiece does it (a leading mark, one mark for each space) and cut into marked words: marks
followed by other characters. No piece goes on from another character to a mark, so words are encoded one by one, each
distinct word of a batch once. The words are sorted, which lists their trie depth-first, and the forward states of a
prefix are kept while words begin with it.

For a unigram model the forward state is Viterbi's: the best score of a prefix and its last piece. For a BPE model the
best sum of scores is not what the library gives; there the state is the last piece of the prefix's BPE encoding, which
is the only piece that may follow the encoding of the prefix before it (two pieces may be neighbours if no merge across
their boundary would come before the merges that made them). Both give the library's ids.

Defined cases: null and empty texts give no ids and decode to the empty text; white space other than the space, and
characters without a piece, become byte pieces; equal texts give equal ids; very long
texts are encoded whole, a batch of their own; an empty table gives an empty result; other columns of the input, also with
the names of the result, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import slices

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Encoded words that a task keeps for its next batches.
MEMO = 250_000
BATCH_BYTES = 4 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message; fixed-width values as bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class Lengths(dict):
    """For a text's last three characters (or fewer, if it has no more), the lengths of pieces that may end it, longest first."""

    def __init__(self, pieces: dict[str, int]):
        self.tails: dict[str, set[int]] = {}
        for p in pieces:
            self.tails.setdefault(p[-3:], set()).add(len(p))

    def __missing__(self, tail: str) -> tuple[int, ...]:
        found = set().union(*(self.tails.get(tail[k:], ()) for k in range(len(tail))))
        self[tail] = out = tuple(sorted((n for n in found), reverse=True))
        return out


class Codec:
    """Encoder and decoder of one model file. Only the pieces, scores and flags of the file are used."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        top = dict(_fields(model.serialized_model_proto()))
        self.bpe = dict(_fields(top.get(2, b""))).get(3, 1) == 2
        rules = dict(_fields(top.get(3, b"")))
        if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1):
            raise ValueError("only models with a leading mark and without normalisation of characters or white space are supported")
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.pieces = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece goes on over the beginning of a word")
        self.score = {p: model.get_score(i) for p, i in self.pieces.items()}
        self.least = min(self.score.values())
        self.unknown = model.unk_id()
        self.byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.out = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        if any(len(p) > 1 and not set(p) <= self.pieces.keys() for p in self.pieces):
            raise ValueError("a piece has a character that is not a piece")
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.packed = [np.int32(i).tobytes() for i in range(n)]
        self.lengths = Lengths(self.pieces)
        self.ok: dict[int, bool] = {}
        if self.bpe:
            self.parts = {p: self._last_merge(p) for p in self.pieces if len(p) > 1}
            self.usable = {p: i for p, i in self.pieces.items() if len(p) == 1 or self.parts[p]}
        else:
            self.usable = self.pieces

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this piece, or None if merging its characters ends otherwise."""
        symbols = list(piece)
        while len(symbols) > 2:
            best = max(((self.score.get(symbols[i] + symbols[i + 1], -np.inf), -i) for i in range(len(symbols) - 1)), default=None)
            if best[0] == -np.inf:
                return None
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return (symbols[0], symbols[1])

    def may_follow(self, left: str, right: str) -> bool:
        """Whether BPE leaves the boundary between two pieces open: undo their merges, latest first, and look for one across that would have come before."""
        score, parts = self.score, self.parts
        limit, ties = -np.inf, False  # a merge across with a better score comes first
        while True:
            across = score.get(left + right)
            if across is not None and (across > limit or ties and across == limit):
                return False
            a = score[left] if len(left) > 1 else np.inf
            b = score[right] if len(right) > 1 else np.inf
            if a == b == np.inf:
                return True
            if b <= a:
                limit, ties, right = b, True, parts[right][0]
            else:
                limit, ties, left = a, False, parts[left][1]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids (int32, packed) of each word of a sorted list of distinct marked words.

        State i is that of the prefix with i characters: its last piece (-1: a character without one), where that piece
        begins and, for a unigram model, the prefix's score. A word's ids are read backwards from its last state, so a
        word costs memory in proportion to its length.
        """
        last, begin, score = [-1], [0], [0.0]
        extend = self._extend_bpe if self.bpe else self._extend_unigram
        out, before = [], ""
        for word in words:
            keep = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], begin[keep + 1 :], score[keep + 1 :]
            extend(word, keep + 1, last, begin, score)
            at, found = len(word), []
            while at:
                found.append(self.packed[last[at]] if last[at] >= 0 else self._fallback(word[at - 1]))
                at = begin[at]
            out.append(b"".join(reversed(found)))
            before = word
        return out

    def _fallback(self, character: str) -> bytes:
        return b"".join(self.packed[self.byte[b]] for b in character.encode("utf-8", "replace")) if self.byte else self.packed[self.unknown]

    def _extend_bpe(self, word: str, start: int, last: list[int], begin: list[int], score: list[float]) -> None:
        usable, lengths, ok = self.usable, self.lengths, self.ok
        for i in range(start, len(word) + 1):
            for n in lengths[word[i - 3 if i > 3 else 0 : i]]:
                if n > i:
                    continue
                piece = usable.get(word[i - n : i])
                if piece is None:
                    continue
                left = last[i - n]
                if n < i and left >= 0:
                    key = left << 20 | piece
                    fits = ok.get(key)
                    if fits is None:
                        if len(ok) > 500_000:
                            ok.clear()
                        fits = ok[key] = self.may_follow(self.names[left], self.names[piece])
                    if not fits:
                        continue
                last.append(piece)
                begin.append(i - n)
                break
            else:
                last.append(-1)
                begin.append(i - 1)

    def _extend_unigram(self, word: str, start: int, last: list[int], begin: list[int], score: list[float]) -> None:
        for i in range(start, len(word) + 1):
            top, piece, size = score[i - 1] + self.least - 10.0, -1, 1
            for n in self.lengths[word[max(i - 3, 0) : i]]:
                if n <= i and (found := self.pieces.get(word[i - n : i])) is not None and score[i - n] + self.score[word[i - n : i]] > top:
                    top, piece, size = score[i - n] + self.score[word[i - n : i]], found, n
            last.append(piece)
            begin.append(i - size)
            score.append(top)

    def encode(self, texts: list[str | None], memo: dict[str, bytes] | None = None) -> list[np.ndarray]:
        """The ids (int32) of each text. memo: encoded words kept between calls."""
        memo = {} if memo is None else memo
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set()
        for words in cut:
            new.update(words)
        new = sorted(new - memo.keys())
        memo.update(zip(new, self.encode_words(new), strict=True))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, words)), np.int32) for words in cut]
        if len(memo) > MEMO:
            for k in new:
                del memo[k]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, n_tokens, round_trip): the ids of every text, and whether they decode to it."""
    id_type = dict(docs.dtypes)[id_column]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = codec(path), {}
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            ids = model.encode(texts, memo)
            back = [model.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            n = np.asarray([len(x) for x in ids], np.int32)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), values, pa.array(n.astype(np.int64)), pa.array(back)], [id_column, "ids", "n_tokens", "round_trip"])

    return docs.select(F.col(id_column), F.col(text).alias("text")).mapInArrow(encoded, f"{id_column} {id_type}, ids array<int>, n_tokens long, round_trip boolean")


def decode_column(encoded: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) from a table of ids; null ids decode to the empty text."""
    id_type = dict(encoded.dtypes)[id_column]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            texts = [model.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(F.col(id_column), F.col(ids).alias("ids")).mapInArrow(decoded, f"{id_column} {id_type}, text string")
