import json
import random

import pyarrow as pa

from skerry.operators import jsontree as J
from skerry.operators.briefs import _rows, brief_facets
from skerry.operators.nested import flatten


def test_flatten_round_trip(spark):
    schema = "id bigint, at_1 string, rec struct<name:string, groups:array<struct<name:string, inner:struct<n:int>, items:array<struct<k:string,v:double>>>>, tags:array<string>>"
    g = [("g0", (1,), [("a", 1.0), None, ("b", None)]), None, ("g2", None, [])]
    rows = [(1, "x", ("r1", g, ["t", None])), (2, None, ("r2", None, [])), (3, "", None), (1, "x", ("again", [("g9", (3,), None)], None))]
    t = flatten(spark.createDataFrame(rows, schema), ["id"], "rec")
    assert sorted(t) == ["groups[]", "groups[].items[]", "tags[]"]
    assert [tuple(r) for r in t["groups[]"].orderBy("id", "at_1", "v_name").collect()] == [(1, 0, "g0", 1), (1, 0, "g9", 3), (1, 1, None, None), (1, 2, "g2", None)]
    assert [tuple(r) for r in t["groups[].items[]"].orderBy("at_2").collect()] == [(1, 0, 0, "a", 1.0), (1, 0, 1, None, None), (1, 0, 2, "b", None)]
    assert [tuple(r) for r in t["tags[]"].orderBy("at_1").collect()] == [(1, 0, "t"), (1, 1, None)]
    empty = flatten(spark.createDataFrame([], schema), ["id"], "rec")
    assert all(x.count() == 0 for x in empty.values())


BODY = {
    "analysis": [
        {"groups": [None, "a", {"name": "b", "n": 2}], "metrics": [{"name": "described", "value": "2.0"}], "series": {"description": {"overall": " x "}}},
        None,
        json.dumps({"groups": "one", "metrics": {"described": {"value": True, "direction": "up"}}, "series": json.dumps({"description": [None, {"overall": None}, {"overall": ""}]})}),
        "text",
    ],
    "parts": [{"parts": json.dumps({"analysis": {"metrics": {"described": None}, "groups": json.dumps(["p", "q"])}})}],
}
WANT = [
    ("0", "described", 0, "2"),
    ("0", "groups", 1, "a"),
    ("0", "groups", 2, "b"),
    ("0", "overall", 0, " x "),
    ("0/0/0", "groups", 0, "p"),
    ("0/0/0", "groups", 1, "q"),
    ("2", "described", 0, "1"),
    ("2", "groups", 0, "one"),
    ("2", "overall", 2, ""),
]


def test_shapes(spark):
    text = json.dumps(BODY)
    rows = [
        (1, "﻿ \n" + json.dumps({"brief": BODY, "v": 2}), 1),
        (1, text, 2),
        (2, None, 1),
        (3, "", 1),
        (4, text[:-1], 1),
        (5, "[" + text + "]", 1),
        (6, "timeout", 1),
        (None, text, 1),
        (7, json.dumps({"analysis": {"groups": ["w"] * 3000, "metrics": {"described": float("nan")}}}), None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "brief_id bigint, body string, received_at int, facet string")
    got = sorted(tuple(r) for r in brief_facets(df).collect())
    assert [r[1:] for r in got if r[0] == 1] == WANT
    assert {r[0] for r in got} == {1, 7} and sum(r[0] == 7 for r in got) == 3000
    assert brief_facets(df.limit(0)).count() == 0


def said(*bodies):
    """(entry_path, facet, item_no, item) of each body."""
    out = [[] for _ in bodies]
    for b in _rows(iter([pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.string())], names=["i", "b"])])):
        for i, *r in zip(*[c.to_pylist() for c in b.columns]):
            out[i].append(tuple(r))
    return out


def test_numbers():
    said_of = lambda vs: [[x[3] for x in r] for r in said(*[json.dumps({"analysis": {"metrics": {"described": v}}}) for v in vs])]
    assert said_of([1, 1.0, "1", "1.0", True, False, " 3 ", {"value": "0"}, [2], '{"value": [4]}', 10**30, 1e3]) == [["1"], ["1"], ["1"], ["1"], ["1"], ["0"], ["3"], ["0"], ["2"], ["4"], [str(10**30)], ["1000"]]
    assert said_of([None, "x", {"value": None}, [], {}, 1.5, "nan", float("nan")]) == [[]] * 8


def test_odd_shapes():
    e = lambda x: json.dumps({"analysis": x})
    got = said(
        e({"groups": {"a": 1, "b": None, "a\n": 2}}), e({"groups": {"name": "n", "x": 1}}), e({"groups": [1, True, 2.50, ["z"], {"name": None}, "[no", "[1]"]}),
        e({"metrics": [["described", 2], {"name": "described", "value": 3}, {"described": 4}]}), e({"metrics": [{"described": 4}, ["other", 1]]}),
        e({"series": {"description": {"overall": [1, {"a": "b"}]}}}), json.dumps({"brief": json.dumps({"brief": {"analysis": [{"groups": "in"}]}})}),
        '{"analysis": {"groups": "first"}, "analysis": {"groups": "last"}}', '{"brief": 1, "analysis": {"groups": "g"}}', '{"parts": [null, {"analysis": []}, {"analysis": [{"groups": ["p"]}]}]}',
    )
    g = lambda *xs: [("0", "groups", i, x) for i, x in xs]
    assert got == [
        g((0, "a"), (1, "b"), (2, "a\n")), g((0, "n")), g((0, "1"), (1, "true"), (2, "2.5"), (5, "[no")), [("0", "described", 0, "4")], [("0", "described", 0, "4")],
        [("0", "overall", 0, '[1, {"a": "b"}]')], g((0, "in")), g((0, "last")), g((0, "g")), [("2/0", "groups", 0, "p")]]


def test_any_depth():
    n = 3000
    body = '{"analysis": {"groups": ["g"], "metrics": {}, "a": [ ]}, "parts": ' * n + '{"analysis": [null, {"groups": ["deep\\n"]}]}' + "}" * n
    got = said(body)[0]
    assert len(got) == n + 1 and max(got, key=lambda r: len(r[0])) == ("0/" * n + "1", "groups", 0, "deep\n")
    assert said(body[:-1], body + "}", body.replace("[ ]", "[,]"), body.replace("[ ]", "[1 2]")) == [[]] * 4
    wrapped = '{"value": [' * 500 + "7" + "]}" * 500
    text = "7"
    for _ in range(12):  # text in text in text
        text = json.dumps([text])
    assert said('{"analysis": {"metrics": {"described": %s}}}' % wrapped, json.dumps({"analysis": {"metrics": {"described": text}}})) == [[("0", "described", 0, "7")]] * 2
    deep = "[" * 50_000 + '1, {"a": "\u00e4", "b": []}, {}' + "]" * 50_000
    assert said('{"analysis": {"series": {"description": {"overall": %s}}}}' % deep) == [[("0", "overall", 0, deep)]]


def built(t, i):
    kids = [built(t, c) for c in t.child[t.first[i] : t.first[i + 1]]]
    if t.kind[i] == J.OBJECT:
        return dict(zip([t.name[int(c)].as_py() for c in t.child[t.first[i] : t.first[i + 1]]], kids))
    text = t.text[int(i)].as_py()
    return kids if t.kind[i] == J.ARRAY else text if t.kind[i] == J.STRING else json.loads(text)


def test_json_equals_library():
    """Random texts, whole and broken, read together as the standard library reads each."""
    rnd = random.Random(1)

    def value(d):
        r = rnd.random()
        if d <= 0 or r < 0.35:
            return rnd.choice([None, True, False, 1, -2.5, 1e9, "", 'a"b\\', "\n\t{[,:]}", "ä€😀", "[1]", "\\\\"])
        return [value(d - 1) for _ in range(rnd.randrange(4))] if r < 0.65 else {rnd.choice(["a", 'b"', "c", "", "name"]): value(d - 1) for _ in range(rnd.randrange(4))}

    texts = [None, "", "  ", "{", "}", "[]]", "[[]", "{}{}", "1 2", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "{,}", "{1:2}", '"a" "b"', "]", "[}", "{]", "01", "1.", "nul", '"\x01"', '"\\x"', '"\\', '"a"', "[NaN, -Infinity]", '\ufeff {"a": 1} \n']
    for _ in range(3000):
        s = json.dumps(value(5), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, None, 1]))
        if (m := rnd.random()) < 0.5:
            i = rnd.randrange(len(s) + 1)
            s = s[:i] if m < 0.2 else s[:i] + rnd.choice('{}[]:,"\\ 0at.') + s[i:] if m < 0.35 else s[:i] + s[i + 1 :]
        texts.append(s)
    tree = J.parse(pa.array(texts))
    sound = 0
    for s, r in zip(texts, tree.root):
        try:
            want = [json.loads((s or "").strip(J.OUTER))]
        except ValueError:
            want = []
        if len({(s or "").count(x) for x in ("\\ud83d", "\\ude00", "\\ud83d\\ude00")}) == 1:  # no pair has been cut apart
            assert json.dumps([built(tree, int(r))] if r >= 0 else []) == json.dumps(want), s
        sound += bool(want)
    assert 1000 < sound < 2900
    assert len(J.parse(pa.array([], pa.string())).root) == 0 and J.parse(pa.array(['"\\ud800x"'])).text.to_pylist() == ["\ufffdx"]


def test_briefs_against_plain_walk(spark):
    """The whole small table against a row-by-row walk that shares no code with the operator."""
    import pandas as pd

    def opened(v):
        while isinstance(v, str) and v.strip()[:1] in ("[", "{") and v.strip():
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def items(v):
        v = opened(v)
        return [] if v is None else v if isinstance(v, list) else [v]

    def walk(brief, at, bid, out):
        for i, e in enumerate(items(brief.get("analysis"))):
            e = opened(e)
            if not isinstance(e, dict):
                continue
            path = "/".join(map(str, [*at, i]))
            for j, grp in enumerate(items(e.get("groups"))):
                if grp is not None:
                    out.append((bid, path, "groups", j, grp["name"] if isinstance(grp, dict) else grp))
            m = opened(e.get("metrics")) or {}
            m = {x["name"]: x["value"] for x in m} if isinstance(m, list) else m
            v = m.get("described")
            v = v.get("value") if isinstance(v, dict) else v
            if v is not None:
                out.append((bid, path, "described", 0, str(int(float(v)))))
            for j, x in enumerate(items((opened(e.get("series")) or {}).get("description"))):
                if isinstance(x, dict) and x.get("overall") is not None:
                    out.append((bid, path, "overall", j, x["overall"]))
        for i, p in enumerate(items(brief.get("parts"))):
            walk(opened(p), [*at, i], bid, out)

    raw = pd.read_parquet("/root/testdata/sf0.01/briefs.parquet").sort_values("received_at").drop_duplicates("brief_id", keep="last")
    want = []
    for bid, body in zip(raw.brief_id, raw.body):
        try:
            b = json.loads((body or "").strip().lstrip("﻿").strip())
        except ValueError:
            continue
        if isinstance(b, dict):
            walk(b.get("brief", b), [], bid, want)
    got = [tuple(r) for r in brief_facets(spark.read.parquet("/root/testdata/sf0.01/briefs.parquet")).collect()]
    assert len(got) > 3000 and sorted(got) == sorted(want)
