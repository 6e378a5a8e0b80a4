"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Class k holds pieces that fit k times into a sequence, so its bins take exactly k pieces
each and no search for space is needed; every worker fills its own bins. Documents may be cut, so
a length is cut into reciprocals of the capacity: as many whole sequences as fit, then the class size at or
just above the rest, or, where that would waste too much, a piece of exactly the next class size and on with what is left.
Bins that a worker leaves unfinished are cut to power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pitgrid.llm.common import find_package

CAPACITY = 2048
END_ID = 1
#: Words of a generation of the memory; two generations are held.
_CACHE_WORDS = 500_000
#: White space of the tokenizer: what str.split() parts at, less U+001C to U+001F, which are tokens.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_SPACES = "\x1c\x1d\x1e\x1f"
#: Words that the tokenizer's normalizers leave as they are and that its pre-tokenizer cuts into runs of letters and of signs: Latin-1's
#: small letters and ASCII signs without the apostrophe, which begins suffixes of its own.
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff!-&(-/:-@\[-`{-~]+")
_PIECES = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[!-&(-/:-@\[-`{-~]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Character that the vocabulary has for a byte: its own if that prints, else the next one from 256 on.
_BYTE_CHARS = dict(zip([*_PRINTED, *(b for b in range(256) if b not in _PRINTED)], [*_PRINTED, *range(256, 512)], strict=False))


class WordTokens:
    """Token ids of texts, word by word.

    The vocabulary's pre-tokenizer never joins what white space parts, so a text's ids are those of its words one
    after the other. A-Z are lower-cased first, as the tokenizer does itself. Words are remembered in two generations: one that is
    met again moves to the younger, and when that is full it becomes the older and the older is dropped, so common words stay.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of special tokens in a text are ordinary text
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}  # the younger generation
        self.older: dict[str, bytes] = {}
        mark = self.tokenizer.encode("~", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.known.get(piece) or self.older.get(piece)
        if got is None:
            chars = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            got = array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()
        return got

    def learn(self, words: set[str]) -> None:
        """Ids of new words. Plain ones go to the vocabulary's model piece by piece, all others through the whole tokenizer, many in one call."""
        known, rest = self.known, []
        for w in words:
            if _PLAIN.fullmatch(w):
                pieces = _PIECES.findall(w)
                if len(pieces) == 1:
                    known[w] = self._piece(w)
                else:
                    ids = [self._piece(p) for p in pieces]
                    known[w] = b"".join(ids)
                    # a word with a full stop, comma or quote stands without it too
                    known.update((p, i) for p, i in zip(pieces, ids, strict=True) if len(p) > 2)
            else:
                rest.append(w)
        simple = [w for w in rest if "~" not in w and "\x00" not in w] if self.mark is not None else []
        for w in set(rest).difference(simple):
            known[w] = self._one(w)
        for at in range(0, len(simple), 4096):
            part = simple[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ~ ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(part) - 1:
                ids, starts, ends_at = ids.tobytes(), [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
                for w, s, e in zip(part, starts, ends_at, strict=True):
                    known[w] = ids[s:e]
            else:
                for w in part:
                    known[w] = self._one(w)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 4 bytes each; the new words of all texts are learnt together."""
        if len(self.known) >= _CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found, new = [], set()
        for text in texts:
            low = (text or "").encode().lower().decode()
            words = [w for w in _SPACES.split(low) if w] if any(c in low for c in _NO_SPACES) else low.split()
            got = list(map(known.get, words))
            gaps = [i for i, g in enumerate(got) if g is None] if None in got else ()
            new.update([words[i] for i in gaps])
            found.append((words, got, gaps))
        met = {w: older[w] for w in new if w in older} if older else {}
        known.update(met)
        new.difference_update(met)
        if new:
            self.learn(new)
        for words, got, gaps in found:
            for i in gaps:
                got[i] = known[words[i]]
        return [b"".join(got) for _, got, _ in found]

    def ids(self, text: str | None) -> bytes:
        return self.texts([text])[0]


_tokens: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One tokenizer per worker process."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cut_lengths(n: int, capacity: int = CAPACITY, waste: float = 1 / 64) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens.

    A last piece may stay below its class size by ``waste`` of it at most; longer gaps are cut on.
    """
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        size = capacity // k
        if size - rest <= waste * size:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        rest -= piece
    return out


def _powers(total: int) -> list[int]:
    """Powers of two that add up to ``total``, the largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, waste: float = 1 / 64, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every document is its token ids and ``end_id``; null, empty and blank texts are that id alone. A sequence lies within one input partition: its number is the partition's
    and a running count, and no row is shuffled. Rows with equal doc_id are documents of their own. A recomputed
    partition reads its rows in the same order from the files and gives the same bins.
    Memory: 256 texts at a time and, per class, the open bin's piece descriptions. A sequence holds ``capacity`` tokens at most; it is to be
    padded to ``capacity``, unless its length is a power of two. No rows: no pieces.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer_path)
        numbers = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))
        opened: dict[int, list[tuple]] = {}  # class -> pieces of its open bin: doc, start, ids, doc_tokens
        out: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            number, offset = next(numbers), 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset)
                out.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
                offset += len(ids) // 4

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, ids in zip(part.column(0).to_pylist(), tokens.texts(part.column(1).to_pylist()), strict=True):
                    ids += end
                    total, at = len(ids) // 4, 0
                    for n, k in cut_lengths(total, capacity, waste):
                        bin_ = opened.setdefault(k, [])
                        bin_.append((doc, at, ids[4 * at : 4 * (at + n)], total))
                        at += n
                        if len(bin_) == k:
                            close(opened.pop(k))
                if len(out) >= 4096:
                    yield flush()
        # unfinished bins: their pieces end to end, cut at the capacity and then at powers of two
        rest = list(chain.from_iterable(opened[k] for k in sorted(opened)))
        for room in _rooms(sum(len(p[2]) // 4 for p in rest), capacity):
            held: list[tuple] = []
            while room:
                doc, start, ids, total = rest[0]
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], total))
                room -= n
                if 4 * n == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + n, ids[4 * n :], total)
            close(held)
        if out:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    find_package(docs.sparkSession)
    return rows.mapInArrow(run, kinds)


def _rooms(total: int, capacity: int) -> list[int]:
    return [capacity] * (total // capacity) + _powers(total % capacity)
