"""JSON texts as flat arrays of nodes, read from the bytes of a whole Arrow array at once.

No text is walked: marks are found by table lookup, the inside of strings by the parity of quotes, levels by running sums of
brackets, and every value's container by a search among the openers one level up. What comes out are parent indices and list
offsets of all texts together, whatever their depth; children, members and keys follow by ``take``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, SCALAR = range(4)
#: White space around a body, besides a byte order mark.
OUTER = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85\xa0                　﻿"
_SCALARS = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"
_ESCAPES = r"^(?:[^\\]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*$"

# tokens
_BEGIN, _LBRACE, _RBRACE, _LBRACK, _RBRACK, _COLON, _COMMA, _STR, _LIT, _KEY = range(10)
_CLASS = np.full(256, -1, np.int8)
for _c, _t in zip(b'{}[]:,"', (_LBRACE, _RBRACE, _LBRACK, _RBRACK, _COLON, _COMMA, _STR)):
    _CLASS[_c] = _t
#: Which token may follow which, apart from what the container demands.
_FOLLOWS = np.zeros((10, 10), bool)
_VALUE = [_LBRACE, _LBRACK, _STR, _LIT]
_FOLLOWS[_BEGIN, _VALUE] = _FOLLOWS[_COLON, _VALUE] = True
_FOLLOWS[_LBRACE, [_KEY, _RBRACE]] = True
_FOLLOWS[_LBRACK, [*_VALUE, _RBRACK]] = True
_FOLLOWS[_COMMA, [*_VALUE, _KEY]] = True
_FOLLOWS[_KEY, _COLON] = True
for _t in (_STR, _LIT, _RBRACE, _RBRACK):
    _FOLLOWS[_t, [_COMMA, _RBRACE, _RBRACK, _BEGIN]] = True


def _spans(texts: pa.Array, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts between rising starts and ends in the bytes of an array."""
    if not len(start):
        return pa.array([], pa.large_string())
    edges = np.stack([start, end], 1).ravel().astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), texts.buffers()[2]).take(pa.array(np.arange(len(start)) * 2))


def _size(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False)


def _decoded(raw: pa.Array) -> pa.Array:
    """Insides of JSON strings without their escapes. Halves of surrogate pairs become U+FFFD."""
    has = pc.match_substring(raw, "\\")
    if not pc.any(has).as_py():
        return raw
    plain = json.loads('["' + '","'.join(raw.filter(has).to_pylist()) + '"]')
    if any("\ud800" <= max(x, default="") for x in plain):
        plain = [x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in plain]
    return pc.replace_with_mask(raw, has, pa.array(plain, pa.large_string()))


@dataclass
class Tree:
    """All values of some JSON texts, in the order of the texts."""

    root: np.ndarray  # of each text: its top value, -1 if the text is no complete JSON value
    kind: np.ndarray
    parent: np.ndarray  # -1 at the top
    name: pa.Array  # key in its object, null elsewhere
    text: pa.Array  # strings without escapes, scalars as written, null for objects and arrays
    start: np.ndarray  # bytes of the value in ``source``
    end: np.ndarray
    source: pa.Array
    first: np.ndarray  # list offsets of each node's values in ``child``
    child: np.ndarray

    def raw(self, node: int) -> str:
        """JSON text of a value."""
        return bytes(self.source.buffers()[2][self.start[node] : self.end[node]]).decode()


def _tokens(t: pa.Array, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end, row) of all tokens of texts that are good so far; a token without length leads each text."""
    data = np.frombuffer(t.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    of = lambda at: np.searchsorted(ends, at, "right") - 1
    mark = np.flatnonzero(_CLASS[data] >= 0)
    quote = data[mark] == 34
    slash = np.flatnonzero(data == 92)
    if len(slash):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(slash) != 1]))
        runs = np.diff(np.append(starts, len(slash)))
        escaped = np.zeros(len(data) + 1, bool)
        escaped[(slash[starts] + runs)[runs % 2 == 1]] = True
        escaped[ends[:-1]] = False  # a text is not led by the end of the one before
        keep = ~(quote & escaped[mark])
        mark, quote = mark[keep], quote[keep]
    row = of(mark)
    good &= np.bincount(row[quote], minlength=len(good)) % 2 == 0
    keep = good[row]
    mark, row, quote = mark[keep], row[keep], quote[keep]
    outside = (np.cumsum(quote) - quote) % 2 == 0  # of strings; opening quotes are
    opens = np.flatnonzero(quote & outside)
    closes = mark[quote & ~outside]
    control = np.flatnonzero(data < 32)
    if len(control) and len(opens):
        at = np.searchsorted(mark[opens], control, "right") - 1
        good[of(control[(at >= 0) & (control < closes[at])])] = False
    stop = mark + 1
    stop[opens] = closes + 1
    keep = outside & good[row]
    lead = np.flatnonzero(good)
    mark, stop, row = mark[keep], stop[keep], row[keep]
    where = np.searchsorted(row, lead)
    tok, start, end, row = (np.insert(a, where, b) for a, b in ((_CLASS[data[mark]].astype(np.int64), _BEGIN), (mark, ends[lead]), (stop, ends[lead]), (row, lead)))
    if not len(tok):
        return tok, start, end, row
    # what stands between two tokens is a number or a word, or white space
    to = np.where(np.append(row[1:] == row[:-1], False), np.append(start[1:], 0), ends[row + 1])
    some = np.flatnonzero(to > end)
    gap = pc.utf8_ltrim(_spans(t, end[some], to[some]), " \t\r\n")
    since = to[some] - _size(gap)
    gap = pc.utf8_rtrim(gap, " \t\r\n")
    size = _size(gap)
    full = size > 0
    some, since, size = some[full], since[full], size[full]
    good[row[some[~pc.match_substring_regex(gap.filter(pa.array(full)), _SCALARS).to_numpy(zero_copy_only=False)]]] = False
    tok, start, end, row = (np.insert(a, some + 1, b) for a, b in ((tok, _LIT), (start, since), (end, since + size), (row, row[some])))
    keep = good[row]
    return tok[keep], start[keep], end[keep], row[keep]


def _step(tok: np.ndarray) -> np.ndarray:
    return ((tok == _LBRACE) | (tok == _LBRACK)).astype(np.int64) - ((tok == _RBRACE) | (tok == _RBRACK))


def _ends_of(tok: np.ndarray) -> np.ndarray:
    """The last token of each text."""
    return np.append(np.flatnonzero(tok == _BEGIN)[1:] - 1, len(tok) - 1) if len(tok) else np.zeros(0, np.int64)


def parse(texts: pa.Array) -> Tree:
    """Reads an array of JSON texts. Null texts and texts that are no complete JSON value have no nodes.

    Accepts what the standard library's reader accepts, so also NaN and Infinity.
    """
    t = pc.utf8_trim(pc.fill_null(texts.cast(pa.large_string()), ""), OUTER)
    if len(t) == 0:
        t = pa.array([""], pa.large_string())
    ends = np.frombuffer(t.buffers()[1], np.int64)[: len(t) + 1]
    good = np.diff(ends) > 0
    tok, start, end, row = _tokens(t, ends, good)
    # a text whose brackets do not balance is none
    depth = np.cumsum(_step(tok))
    lead = np.flatnonzero(tok == _BEGIN)
    base = np.zeros(len(good), np.int64)
    base[row[lead]] = depth[lead]
    level = depth - base[row]
    last = _ends_of(tok)
    good[row[level < 0]] = False
    good[row[last[level[last] != 0]]] = False
    keep = good[row]
    tok, start, end, row = tok[keep], start[keep], end[keep], row[keep]
    # the container of a token (for a closer: what it closes) is the last opener one level up
    step = _step(tok)
    level = np.cumsum(step) - (step > 0)
    opener = np.flatnonzero(step > 0)
    opener = opener[np.argsort(level[opener], kind="stable")]
    span, around = np.int64(len(tok) + 1), np.where(step < 0, level, level - 1)
    at = np.searchsorted(level[opener] * span + opener, around * span + np.arange(len(tok))) - 1
    within = np.where(around >= 0, opener[np.maximum(at, 0)], -1) if len(opener) else np.full(len(tok), -1)
    inside = within >= 0
    in_object = inside & (tok[within] == _LBRACE)
    # rules between neighbours, and of containers
    prev = np.concatenate([[_STR], tok[:-1]]) if len(tok) else tok
    tok = np.where((tok == _STR) & in_object & ((prev == _LBRACE) | (prev == _COMMA)), _KEY, tok)
    prev = np.concatenate([[_STR], tok[:-1]]) if len(tok) else tok
    fits = _FOLLOWS[prev, tok] & ((tok != _RBRACE) | in_object) & ((tok != _RBRACK) | ~in_object) & ((tok != _COMMA) | inside)
    fits &= (prev != _COMMA) | (in_object == (tok == _KEY))
    good[row[~fits & (tok != _BEGIN)]] = False
    last = _ends_of(tok)
    good[row[last[~np.isin(tok[last], (_STR, _LIT, _RBRACE, _RBRACK))]]] = False
    said = np.flatnonzero((tok == _STR) | (tok == _KEY))
    inner = _spans(t, start[said] + 1, end[said] - 1)
    slashed = np.flatnonzero(pc.match_substring(inner, "\\").to_numpy(zero_copy_only=False))
    fine = pc.match_substring_regex(inner.take(pa.array(slashed)), _ESCAPES).to_numpy(zero_copy_only=False)
    good[row[said[slashed[~fine]]]] = False
    # values of good texts
    live = good[row]
    value = np.flatnonzero(live & np.isin(tok, (_LBRACE, _LBRACK, _STR, _LIT)))
    node = np.full(len(tok) + 1, -1, np.int64)
    node[value] = np.arange(len(value))
    kind = np.array([-1, OBJECT, -1, ARRAY, -1, -1, -1, STRING, SCALAR, -1])[tok[value]]
    parent = np.where(within[value] >= 0, node[within[value]], -1)
    root = np.full(len(good), -1, np.int64)
    root[row[value[parent < 0]]] = np.flatnonzero(parent < 0)
    closer = np.flatnonzero(step < 0)
    upto = end.copy()
    upto[within[closer]] = end[closer]
    inner = _decoded(inner.filter(pa.array(live[said])))
    said = said[live[said]]
    nth = np.full(len(tok) + 1, -1, np.int64)
    nth[said] = np.arange(len(said))
    key = np.flatnonzero((tok == _KEY) & live)
    of_key = np.full(len(value) + 1, -1, np.int64)
    of_key[node[key + 2]] = nth[key]  # key, colon, value
    name = inner.take(pa.array(of_key[:-1], mask=of_key[:-1] < 0))
    own = value[kind == SCALAR]
    both = pa.concat_arrays([inner.cast(pa.large_string()), _spans(t, start[own], end[own])])
    nth[own] = len(said) + np.arange(len(own))
    text = both.take(pa.array(nth[value], mask=kind <= ARRAY))
    child = np.argsort(parent, kind="stable")
    child = child[np.searchsorted(parent[child], 0) :]
    first = np.searchsorted(parent[child], np.arange(len(value) + 1))
    return Tree(root[: len(texts)], kind, parent, name, text, start[value], upto[value], t, first, child)
