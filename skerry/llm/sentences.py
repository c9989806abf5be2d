"""Full sentences of raw documents: what is left without headings, greetings, tables, code, log lines and markup.

Whole Arrow string arrays go through linear-time expressions; no text is walked in Python and none has a bound on the length
of what it holds (code blocks, tags, tables, lines).
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from skerry.operators.nested import list_children

_CLOSE = r"[)\"'”’»\]]{0,3}"
#: Applied in turn to whole texts, where they hold the sign named first; the mark of a block is U+0002.
_CLEAN = (
    ("", r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x0b\f\r\x1c-\x1f\x{85}\x02]", " "),
    ("\u2028", r"\x{2028}", "\n"),
    ("\u2029", r"\x{2029}", "\n"),
    ("```", r"(?s)```.*?```", "\n\n"),
    ("<", r"(?i)<[ \t\n]*br[ \t\n]*/?[ \t\n]*>", "\n"),
    ("<", r"[ \t]*</?[a-zA-Z][^<>\n]*>[ \t]*", " "),
    (":", r"\b\d{1,2}:\d{2}:\d{2}\b(?:[.,]\d+)?\s+[^\s]+\s+(?:ok|failed|cached)\b(?:\s+\w+=[^\s]+)*", "\n"),
    ("|", r"\|(?:[^|\n]*\|)+", "\n"),
    ("", r"\n[ \t\n]*\n|[ \t]{2,}", "\x02"),
)
#: Applied to blocks: quote marks and bullets, headings, sentence ends, numbers.
_SHAPE = (
    (r"(?mi)^(?:[> \t]+|note:[ \t]*|[-*•][ \t]+)+", ""),
    (r"(?m)^#[^\n]*$", ""),
    (rf"([.!?…。]{_CLOSE})[ \t]+", "\\1\n"),
    (r"\p{Nd}+(?:[.,:]\p{Nd}+)*", "0"),
)
_ENDS = rf"[.!?…。]{_CLOSE}$"
#: What parts words, with signs that no word begins with.
_GAPS = r"(?:^|[^\p{L}\p{M}'’-])[^\p{L}]*"
#: Bits of a word's hash.
BITS = 48
_MASK = np.uint64((1 << BITS) - 1)
#: Bytes of text that are worked on at once.
_STEP = 16 << 20


@dataclass
class Sentences:
    """Sentences in order: the text each belongs to, its block there, a hash of its pattern and the hashes of its words."""

    doc: np.ndarray
    block: np.ndarray
    pattern: np.ndarray
    words: np.ndarray
    length: np.ndarray
    text: pa.Array


def hashes(strings: pa.Array) -> np.ndarray:
    """Hashes of strings, the same in every process; each distinct string is hashed once."""
    d = strings.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    named = pd.util.hash_array(np.array(d.dictionary.to_pylist(), dtype=object), categorize=False) if len(d.dictionary) else np.zeros(0, np.uint64)
    return named[d.indices.to_numpy(zero_copy_only=False)] & _MASK


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring words from theirs (an odd multiplier mixes the bits)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) & _MASK


def _where(texts: pa.Array, sign: str, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Changes the texts that hold the sign."""
    if not sign:
        return change(texts)
    has = pc.match_substring(texts, sign)
    return pc.replace_with_mask(texts, has, change(texts.filter(has))) if pc.any(has).as_py() else texts


def split(texts: pa.Array) -> Sentences:
    """Sentences of an array of texts. Numbers are written ``0`` and case is folded, so equal patterns are equal.

    A sentence ends with a full stop or the like and has three words or more. A null or empty text has none.
    """
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    t = _where(t, "&", lambda x: pa.array([html.unescape(v) for v in x.to_pylist()], pa.large_string()))
    for sign, pattern, by in _CLEAN:
        t = _where(t, sign, lambda x, pattern=pattern, by=by: pc.replace_substring_regex(x, pattern, by))
    blocks, doc, block = list_children(pc.split_pattern(t, "\x02"))
    for pattern, by in _SHAPE:
        blocks = pc.replace_substring_regex(blocks, pattern, by)
    lines, at, _ = list_children(pc.split_pattern(pc.utf8_lower(blocks), "\n"))
    lines = pc.utf8_trim(lines, " \t")
    keep = pc.match_substring_regex(lines, _ENDS)
    lines, at = lines.filter(keep), at[keep.to_numpy(zero_copy_only=False)]
    words, of, _ = list_children(pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lines, _GAPS, " "), " "), " "))
    n = np.bincount(of, minlength=len(lines))
    long = n >= 3
    mask = pa.array(long)
    lines, at = lines.filter(mask), at[long]
    return Sentences(doc[at], block[at].astype(np.int32), hashes(lines), hashes(words)[long[of]], n[long].astype(np.int32), lines)


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """(start, length) of runs of whole texts of about ``_STEP`` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // _STEP
    cut = np.flatnonzero(np.diff(run)) + 1
    edges = [0, *cut.tolist(), len(texts)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]
