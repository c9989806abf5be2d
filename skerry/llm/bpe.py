"""Byte-level BPE of a public vocabulary, by longest matches with backtracking.

A merge order is reproduced without merging: a sequence of tokens is what the merges give if and only if every two
neighbours are *compatible*, that is, encoding their joined bytes gives just these two. So a piece is encoded from left to
right with the longest token that is compatible with the one before; where none is left, the last token is taken back and
shortened. Places from which no ending was found are remembered, so the work is linear in the text. Longest matches come
from one Aho-Corasick pass over the bytes, mapped to Latin-1 characters; verdicts on neighbours are memoised.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.runtime import spread

#: Split of the vocabulary's own definition (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces and neighbour verdicts a process remembers; beyond that the memory starts anew. Steers speed only.
MEMO = 400_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files of this kind: printable Latin-1 characters stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes text with one vocabulary file. Build it once per process: :meth:`of`."""

    _built: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._built:
            cls._built[path] = cls(path)
        return cls._built[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        spell = lambda t: "".join(chr(alphabet[c]) for c in t)
        ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if all(c in alphabet for c in token):
                ids[spell(token)] = i
        self.words = ids
        self.size = max(ids.values()) + 1
        self.length = [0] * self.size
        for w, i in ids.items():
            self.length[i] = len(w)
        #: (left, right) -> (rank, token), and token -> its halves
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = spell(a), spell(b)
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.joins[left, right] = (rank, whole)
            self.halves.setdefault(whole, (left, right))
        self.rank = {w: self.joins[h][0] for w, h in self.halves.items()}
        #: token -> the longest token that is a proper prefix of it, or -1
        self.shorter = [-1] * self.size
        for w, i in ids.items():
            for n in range(len(w) - 1, 0, -1):
                if (j := ids.get(w[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w, i in ids.items():
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.verdicts: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives ``a, b``."""
        got = self.verdicts.get((a, b))
        if got is None:
            if len(self.verdicts) > MEMO:
                self.verdicts.clear()
            got = self.verdicts[a, b] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both tokens, latest first, towards their common border. If at any time the two parts at the
        # border have a merge that comes before those still undone, it would have happened and crossed the border.
        limit = 1 << 60
        while True:
            join = self.joins.get((a, b))
            if join is not None and join[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # A merge inside the right token wins a draw only if it comes earlier; the left one is applied first.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
                join = self.joins.get((a, b))
                if join is not None and join[0] < limit:
                    return False
            else:
                limit, b = rb, self.halves[b][0]
                join = self.joins.get((a, b))
                if join is not None and join[0] <= limit:
                    # equal ranks: the leftmost of two equal merges happens first, and that is the crossing one
                    return False

    def encode_bytes(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 string of its bytes."""
        whole = self.words.get(text)
        if whole is not None and self._alone(whole):
            return (whole,)
        n, length, shorter = len(text), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        open_ends = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            if token >= 0:
                end = at + length[token]
                if open_ends[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return tuple(out)
                    token = longest[at]
                else:
                    token = shorter[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= length[token]

    def _alone(self, token: int) -> bool:
        """Whether the merges build this token from its bytes (not so for a word no merge leads to)."""
        return token in self.halves or self.length[token] == 1

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none."""
        if not text:
            return []
        pieces, out = self.pieces, []
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.encode_bytes(p.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(p) <= 64:
                    if len(pieces) > MEMO:
                        pieces.clear()
                    pieces[p] = ids
            out.extend(ids)
        return out


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, ids``: every text as token ids, without special tokens (their strings are ordinary text).

    Empty and null texts have an empty list; repeated rows and null ids are carried as they are; an empty table gives an
    empty table; other columns are not read. Texts are never cut. One pass; a shuffle only where the table comes in fewer
    partitions than there are cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                lists = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    src = spread(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, out: str = "n_tokens", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Adds ``out``, the number of tokens of ``text``, in place of the text."""

    def size(texts: pd.Series) -> pd.Series:
        enc = Encoder.of(vocabulary)
        return texts.map(lambda t: len(enc.encode(t)) if isinstance(t, str) else 0).astype("int32")

    return spread(df).withColumn(out, F.pandas_udf(size, "int")(F.col(text))).drop(text)
