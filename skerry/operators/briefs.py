"""Analysis briefs (JSON text of many shapes) as flat rows: Arrow-buffer flattening over :mod:`skerry.operators.jsontree`."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skerry.operators import jsontree as J
from skerry.plans.skew import latest

_OUT = pa.schema([("brief_id", pa.int64()), ("entry_path", pa.string()), ("facet", pa.string()), ("item_no", pa.int32()), ("item", pa.string())])
#: Names that are looked up in objects (fixed values).
NAMES = ("brief", "analysis", "parts", "groups", "metrics", "described", "series", "description", "overall", "name", "value")
#: Bytes of bodies that are flattened at once.
_STEP = 16 << 20
NONE = -1
_GLUE = pa.scalar("", pa.large_string())


def _joined(parts: list[J.Tree]) -> tuple[np.ndarray, ...]:
    """Kind, parent, list offsets and children of several trees as one, whose nodes are numbered on."""
    base = np.concatenate([[0], np.cumsum([len(p.kind) for p in parts])])
    kids = np.concatenate([[0], np.cumsum([len(p.child) for p in parts])])
    kind = np.concatenate([p.kind for p in parts])
    parent = np.concatenate([np.where(p.parent >= 0, p.parent + b, NONE) for p, b in zip(parts, base)])
    first = np.concatenate([*[p.first[:-1] + k for p, k in zip(parts, kids)], kids[-1:]])
    return base, kind, parent, first, np.concatenate([p.child + b for p, b in zip(parts, base)])


class Bodies:
    """The values of some bodies, with JSON that is written as text inside opened. Nodes are numbers; ``NONE`` is absent."""

    def __init__(self, bodies: pa.Array):
        self.parts = [J.parse(bodies)]
        self.top = self.parts[0].root
        opens: list[tuple[np.ndarray, np.ndarray]] = []
        base, last = 0, self.parts[0]
        while True:  # once for each time that text is wrapped in text
            lead = pc.utf8_slice_codeunits(pc.utf8_ltrim(last.text, J.OUTER), 0, 1)
            text = np.flatnonzero((last.kind == J.STRING) & pc.fill_null(pc.is_in(lead, pa.array(["[", "{"], lead.type)), False).to_numpy(zero_copy_only=False))
            if not len(text):
                break
            inner = J.parse(last.text.take(pa.array(text)))
            if not len(inner.kind):
                break
            ok = inner.root >= 0
            opens.append((base + text[ok], base + len(last.kind) + inner.root[ok]))
            base, last = base + len(last.kind), inner
            self.parts.append(inner)
        self.base, self.kind, self.parent, self.first, self.child = _joined(self.parts)
        n = len(self.kind)
        self.text = pa.concat_arrays([p.text for p in self.parts])
        self.key = pa.concat_arrays([p.name for p in self.parts])
        self.to = np.arange(n + 1)  # what a node is when opened; NONE stays NONE
        self.to[n] = NONE
        for at, inner in reversed(opens):
            self.to[at] = self.to[inner]
        which = pc.fill_null(pc.index_in(self.key, pa.array(NAMES, pa.large_string())), NONE).to_numpy(zero_copy_only=False)
        self.at = {}
        for i, name in enumerate(NAMES):
            of = np.full(n + 1, NONE, np.int64)
            has = np.flatnonzero(which == i)
            of[self.parent[has]] = has  # of repeated names the last counts
            of[n] = NONE
            self.at[name] = of
        null = np.zeros(n + 1, bool)
        null[:n] = (self.kind == J.SCALAR) & pc.fill_null(pc.equal(self.text, "null"), False).to_numpy(zero_copy_only=False)
        null[n] = True
        self.null = null
        self.kinds = np.append(self.kind, NONE)

    def open(self, v: np.ndarray) -> np.ndarray:
        return self.to[v]

    def is_(self, v: np.ndarray, kind: int) -> np.ndarray:
        return self.kinds[v] == kind

    def get(self, v: np.ndarray, name: str) -> np.ndarray:
        """A member of each object."""
        return np.where(self.is_(v, J.OBJECT), self.at[name][v], NONE)

    def elements(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of each container with their owner (position in ``v``) and their place, by list offsets."""
        safe = np.where(v >= 0, v, 0)
        count = np.where(v >= 0, self.first[safe + 1] - self.first[safe], 0) if len(self.kind) else np.zeros(len(v), np.int64)
        owner = np.repeat(np.arange(len(v)), count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return self.child[self.first[v[owner]] + place] if len(owner) else owner, owner, place

    def several(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(opened value, owner, place): the elements of arrays; another value stands alone at place 0; null has none."""
        v = self.open(v)
        many = self.is_(v, J.ARRAY)
        e, owner, place = self.elements(np.where(many, v, NONE))
        alone = np.flatnonzero(~many & ~self.null[v])
        return np.concatenate([self.open(e), v[alone]]), np.concatenate([owner, alone]), np.concatenate([place, np.zeros(len(alone), np.int64)])

    def named(self, v: np.ndarray, name: str) -> np.ndarray:
        """A named value, given in an object or in an array of name and value (an object, or an array of two)."""
        v = self.open(v)
        plain = self.is_(v, J.OBJECT) & ~((self.at["name"][v] >= 0) & (self.at["value"][v] >= 0))
        out = np.where(plain, self.get(v, name), NONE)
        e, owner, _ = self.several(np.where(plain, NONE, v))
        title = self.get(e, "name")
        titled = self.is_(title, J.STRING)
        pair, of, place = self.elements(np.where(self.is_(e, J.ARRAY), e, NONE))
        two = np.full((len(e), 2), NONE, np.int64)
        small = np.bincount(of, minlength=len(e)) == 2
        fit = small[of]
        two[of[fit], place[fit]] = pair[fit]
        twos = small & self.is_(two[:, 0], J.STRING)
        title, value = np.where(twos, two[:, 0], title), np.where(twos, two[:, 1], self.get(e, "value"))
        by_title = (titled | twos) & self.says(title, name)
        value = np.where(by_title, value, np.where(titled | twos, NONE, self.get(e, name)))
        hit = np.flatnonzero(by_title | (value >= 0))
        # elements of one owner stand in order, so the last one counts
        hit = hit[np.argsort(owner[hit], kind="stable")]
        out[owner[hit]] = value[hit]
        return out

    def says(self, v: np.ndarray, text: str) -> np.ndarray:
        return pc.fill_null(pc.equal(self.text.take(pa.array(v, mask=v < 0)), text), False).to_numpy(zero_copy_only=False)

    def texts(self, v: np.ndarray) -> pa.Array:
        return self.text.take(pa.array(v))

    def raw(self, v: int) -> str:
        i = int(np.searchsorted(self.base, v, "right")) - 1
        return self.parts[i].raw(int(v - self.base[i]))


def _by_value(values: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """``f`` of each distinct text, spread by ``take``."""
    d = values.dictionary_encode()
    return pa.array([f(x) for x in d.dictionary.to_pylist()], pa.large_string()).take(d.indices)


def _digits(s: str) -> str | None:
    """A number as whole number in digits, however it is written; true is 1, false 0."""
    s = s.strip().lower()
    if s in ("true", "false"):
        return str(int(s == "true"))
    try:
        return str(int(s))
    except ValueError:
        try:
            v = float(s)
        except ValueError:
            return None
        return str(int(v)) if math.isfinite(v) and v == int(v) else None


def _described(b: Bodies, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    v = b.open(b.named(b.get(entry, "metrics"), "described"))
    while True:  # once for each wrap
        obj, arr = b.is_(v, J.OBJECT), b.is_(v, J.ARRAY)
        if not (obj | arr).any():
            break
        e, owner, place = b.elements(np.where(arr, v, NONE))
        head = np.full(len(v), NONE, np.int64)
        head[owner[place == 0]] = e[place == 0]
        v = b.open(np.where(obj, b.get(v, "value"), np.where(arr, head, v)))
    of = np.flatnonzero(~b.null[v])
    item = _by_value(b.texts(v[of]), _digits)
    ok = item.is_valid()
    of = of[ok.to_numpy(zero_copy_only=False)]
    return of, np.zeros(len(of), np.int64), item.filter(ok)


def _groups(b: Bodies, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    v = b.open(b.get(entry, "groups"))
    keyed = b.is_(v, J.OBJECT) & (b.at["name"][v] < 0)
    # an object without a name: its keys are the groups, each once
    e, owner, _ = b.elements(np.where(keyed, v, NONE))
    names = b.key.take(pa.array(e))
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, once = np.unique(owner * np.int64(len(e) + 1) + code, return_index=True)
    once = np.sort(once)
    of, names = owner[once], names.take(pa.array(once))
    start = np.searchsorted(of, of)
    place = np.arange(len(of)) - start
    e, own, at = b.several(np.where(keyed, NONE, v))
    e = np.where(b.is_(e, J.OBJECT), b.get(e, "name"), e)
    ok = (b.is_(e, J.STRING) | b.is_(e, J.SCALAR)) & ~b.null[e]
    return np.concatenate([of, own[ok]]), np.concatenate([place, at[ok]]), pa.concat_arrays([names, b.texts(e[ok])])


def _overall(b: Bodies, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    d, owner, place = b.several(b.named(b.get(entry, "series"), "description"))
    v = b.get(d, "overall")
    ok = np.flatnonzero((v >= 0) & ~b.null[v])
    v = v[ok]
    item = b.texts(v)
    whole = np.flatnonzero(b.is_(v, J.OBJECT) | b.is_(v, J.ARRAY))
    if len(whole):  # something else than a text: its JSON
        raw = item.to_pylist()
        for i in whole:
            raw[i] = _spaced(b.raw(int(v[i])))
        item = pa.array(raw, pa.large_string())
    return owner[ok], place[ok], item


def _spaced(raw: str) -> str:
    """JSON text with one blank after commas and colons, as the standard library writes it."""
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False)
    except RecursionError:
        return raw


def entries(b: Bodies) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(entry node, body, path) of all entries, part by part and level by level."""
    body = np.flatnonzero(b.top >= 0)
    part = b.top[body]
    ok = b.is_(part, J.OBJECT)
    body, part = body[ok], part[ok]
    while True:  # the brief may sit inside outer objects
        inner = b.open(b.get(part, "brief"))
        deeper = b.is_(inner, J.OBJECT)
        if not deeper.any():
            break
        part = np.where(deeper, inner, part)
    at = pa.array([""] * len(part), pa.large_string())
    nodes, bodies, paths = [], [], []
    while len(part):
        for name in ("analysis", "parts"):
            e, owner, place = b.several(b.get(part, name))
            ok = b.is_(e, J.OBJECT)
            e, owner, place = e[ok], owner[ok], place[ok]
            path = pc.binary_join_element_wise(at.take(pa.array(owner)), pa.array(place).cast(pa.large_string()), _GLUE)
            if name == "analysis":
                nodes.append(e)
                bodies.append(body[owner])
                paths.append(path)
        part, body, at = e, body[owner], pc.binary_join_element_wise(path, pa.scalar("/", pa.large_string()), _GLUE)
    if not nodes:
        return part, body, at
    return np.concatenate(nodes), np.concatenate(bodies), pa.concat_arrays(paths)


FACETS = {"groups": _groups, "described": _described, "overall": _overall}


def flat(ids: pa.Array, bodies: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of some briefs, facet by facet."""
    b = Bodies(bodies)
    node, body, path = entries(b)
    for facet, of in FACETS.items():
        entry, no, item = of(b, node)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(body[entry])), path.take(pa.array(entry)).cast(pa.string()), pa.array([facet] * len(entry), pa.string()), pa.array(no, pa.int32()), item.cast(pa.string())], schema=_OUT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // _STEP)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield from flat(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo))


def brief_facets(briefs: DataFrame) -> DataFrame:
    """``brief_id, entry_path, facet, item_no, item`` of every brief.

    ``briefs`` needs ``brief_id, body, received_at``. A brief sent several times counts once, as received last. Null,
    empty and cut-off bodies, and bodies that are no JSON object, have no rows; so have briefs without a number (null
    ``brief_id``). Bodies of any length and depth are read whole; half a surrogate pair becomes U+FFFD; other columns are
    ignored.

    Bodies are read as arrays of nodes with parent indices and list offsets (:mod:`skerry.operators.jsontree`); entries,
    groups, metrics and descriptions of all briefs of a batch are then found together, level by level, and keys follow by
    ``take``. No record is parsed or walked on its own.
    """
    one = latest(briefs.select("brief_id", "body", "received_at"), ["brief_id"], "received_at", ["body"])
    return one.filter("body IS NOT NULL").select("brief_id", "body").mapInArrow(_rows, "brief_id bigint, entry_path string, facet string, item_no int, item string")
