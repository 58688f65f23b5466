"""Byte-level BPE encoding and decoding as a reduction over a tree.

A text is halved until its parts are short; parts are encoded on their own and neighbours joined. Two joins occur:

* Parts of a text hold pieces (matches of the pattern). Where two parts meet, pieces are cut anew from the last pieces of the left part on, in a
  window of pieces of the right part that doubles. A match depends on nothing before its begin, and none but the last two matches of a text
  depend on what follows it (two, as an apostrophe and a letter may become a contraction). So as soon as a match of the window, other than its
  last two, begins where a piece of the right part begins, all later pieces stand.
* Halves of a piece hold tokens. A sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is the encoding of its
  bytes. Both halves have that property inside, so a window of tokens around the seam, encoded anew, settles the join once its outer tokens
  form such pairs with the tokens next to the window; until then it doubles.

Joining is associative, the empty part is its neutral element. Decoding concatenates the bytes of tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyhue.llm.tables import others, ship

#: Characters of a text and bytes of a piece that are encoded without halving, and tokens decoded at once.
LEAF, SHORT, RUN = 1 << 14, 6, 1 << 16
#: Last pieces of a part that may change with what follows.
UNSURE = 2
#: Entries that each memory of earlier results may hold; beyond, results are worked out again.
REMEMBERED = 400_000

_AT_BLANK = re.compile(r"\s | \s")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.bytes}
        self.match = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.small: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    # tokens of one piece

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merges of lowest rank first, leftmost among equals. For short bytes only: time is quadratic."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def remembered(self, piece: bytes) -> tuple[int, ...]:
        found = self.small.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(self.small) < REMEMBERED and len(piece) <= 32:
                self.small[piece] = found
        return found

    def pair(self, x: int, y: int) -> bool:
        """Whether the tokens x, y are the encoding of their bytes."""
        found = self.pairs.get((x, y))
        if found is None:
            found = self.remembered(self.bytes[x] + self.bytes[y]) == (x, y)
            if len(self.pairs) < REMEMBERED:
                self.pairs[x, y] = found
        return found

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        if self.pair(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.tokens(b"".join(map(self.bytes.__getitem__, left[len(left) - a :] + right[:b])), a < len(left) or b < len(right))
            sure_left = a == len(left) or self.pair(left[-a - 1], window[0])
            sure_right = b == len(right) or self.pair(window[-1], right[b])
            if sure_left and sure_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if sure_left else 2 * a, b if sure_right else 2 * b

    def tokens(self, piece: bytes, halve: bool = True) -> tuple[int, ...]:
        """A window that is the whole of both halves isn't halved at its old seam again, but at another place."""
        if len(piece) <= SHORT or (not halve and len(piece) <= 64):
            return self.remembered(piece)
        middle = len(piece) // 2 if halve else len(piece) // 3
        return self.joined(self.tokens(piece[:middle]), self.tokens(piece[middle:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        return (rank,) if rank is not None else self.tokens(raw)

    # pieces of a text

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF:
            return self.match(text)
        middle = len(text) // 2
        return self.met(self.pieces(text[:middle]), self.pieces(text[middle:]))

    def met(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        seen, k = "".join(left[-UNSURE:]), 4
        while True:
            window = self.match(seen + "".join(right[:k]))
            if k >= len(right):
                return left[:-UNSURE] + window
            begins, at = {}, len(seen)
            for j in range(k):
                begins[at] = j
                at += len(right[j])
            at = 0
            for i, piece in enumerate(window[:-UNSURE]):
                if at in begins:
                    return left[:-UNSURE] + window[:i] + right[begins[at] :]
                at += len(piece)
            k *= 2

    def chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.pieces(chunk))))

    def encode(self, text: str) -> list[int]:
        """Token ids of a text.

        Before a blank that stands alone between other characters than white space, a piece always begins. So the words between such blanks are
        encoded apart, each with its blank, and remembered.
        """
        words = text.split(" ")
        if text[:1].isspace() or text[-1:].isspace() or _AT_BLANK.search(text):
            runs, last = [words[0]], words[0]
            for w in words[1:]:
                if last and w and not last[-1].isspace() and not w[0].isspace():
                    runs.append(" " + w)
                else:
                    runs[-1] += " " + w
                last = w
            return list(chain.from_iterable(map(self.chunk, runs)))
        known = self.words.get
        found = [known(w) for w in words]
        found[0] = self.chunk(words[0])
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = found[i] = known(w) or self.chunk(" " + w)
                    if len(self.words) < REMEMBERED and len(w) <= 64:
                        self.words[w] = ids
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= RUN:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


#: One codec for each worker process and vocabulary, so that what one task has learnt serves the next.
_codecs: dict[tuple[str, bytes], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    key = (pattern, hashlib.sha256(raw).digest())
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


_FIELDS = {
    "ids": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), "n_tokens": (pa.int64(), T.LongType()), "ids_sha256": (pa.string(), T.StringType()),
    "decoded": (pa.binary(), T.BinaryType()), "decoded_sha256": (pa.string(), T.StringType()),
}


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", add: tuple[str, ...] = ("ids",)) -> DataFrame:
    """The columns of docs but the text, and those asked for in add: ids, n_tokens, ids_sha256 (of decimal ids joined by one blank), decoded (bytes
    that the ids give), decoded_sha256.

    ranks is the path of a vocabulary file that the driver reads; it has an entry for each byte and goes along with the tasks (about 1 MB). Every match of
    pattern is encoded by itself, without special tokens. Null texts count as empty: no tokens, digests of no bytes. Columns of docs that bear the
    name of an added one are replaced; others stay, and so do repeated rows. Texts of any length are encoded whole.
    """
    ship(docs.sparkSession)
    with open(ranks, "rb") as f:
        raw = f.read()
    rest = others(docs, text, *add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw, pattern)
        digits = own.digits.__getitem__
        for batch in batches:
            made: dict[str, list] = {c: [] for c in add}
            texts = batch.column(batch.schema.get_field_index(text))
            for at in range(0, batch.num_rows, 256):
                for value in texts.slice(at, 256).to_pylist():
                    ids = own.encode(value or "") if value else []
                    if "ids" in made:
                        made["ids"].append(ids)
                    if "n_tokens" in made:
                        made["n_tokens"].append(len(ids))
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                    if "decoded" in made or "decoded_sha256" in made:
                        back = own.decode(ids)
                        if "decoded" in made:
                            made["decoded"].append(back)
                        if "decoded_sha256" in made:
                            made["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *(pa.array(made[c], _FIELDS[c][0]) for c in add)], [*rest, *add])
                made = {c: [] for c in add}

    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, _FIELDS[c][1]) for c in add)])
    return docs.select(*(f"`{c}`" for c in rest), f"`{text}`").mapInArrow(run, schema)
