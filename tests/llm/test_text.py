import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm.bpe import DEFAULT_VOCABULARY, Encoder, count_tokens, encode_corpus
from skerry.llm.mixture import budgets, mix
from skerry.llm.sentences import hashes, pairs_of, slices, split
from skerry.llm.subjects import ABSTAIN, Marks, _distinct, assign, decoded, fit, fit_latent, parsed, voted
from skerry.runtime import Scratch, table

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60) | st.text("abcdeinrst '\n\t=-0", max_size=120))
def test_ids_equal_library(s):
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY) if not hasattr(test_ids_equal_library, "t") else test_ids_equal_library.t
    test_ids_equal_library.t = t
    t.encode_special_tokens = True
    assert Encoder.of(DEFAULT_VOCABULARY).encode(s) == t.encode(s, add_special_tokens=False).ids


def test_corpus_ids(spark, library):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in encode_corpus(docs).collect()}
    assert got == {d: library(t) if t else [] for d, t in text.items()}
    n = {r.doc_id: r.n_tokens for r in count_tokens(docs.select("doc_id", "text")).collect()}
    assert n == {d: len(i) for d, i in got.items()}


def test_ids_edges(spark, library):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))
    rows = [(1, None, "c"), (2, "", "c"), (None, "x y", "c"), (4, long, "c"), (4, "<|endoftext|> a", "c"), (5, " \n\n ", "c")]
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()), key=repr)
    assert got == sorted(((d, library(t) if t else []) for d, t, _ in rows), key=repr)
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_budgets():
    sizes = {"a": 1000, "b": 100, "c": 50}
    b = {x.source: x for x in budgets([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 2), ("none", 0.1, 5), (None, 0.5, 1), ("a", 0.9, 9)], sizes)}
    assert b["none"].budget == 0 and b["b"].budget == pytest.approx(200) and b["a"].budget == pytest.approx(1000 / 3) and b["c"].budget == pytest.approx(200 / 3)
    assert (b["b"].epochs, b["b"].rest) == (2, 0.0) and b["c"].epochs == 1
    # more than the sources can give at their shares: the short ones give all, the others fill up
    b = {x.source: x.budget for x in budgets([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 2)], sizes, 1000)}
    assert b == pytest.approx({"a": 700, "b": 200, "c": 100})
    assert sum(x.budget for x in budgets([("a", 0.5, 1), ("b", 0.5, 1)], sizes, 9999)) == 1100
    assert budgets([], {}) == []


def test_mixture(spark):
    rnd = random.Random(8)
    rows = [("hot" if i % 3 else rnd.choice(["s", "t", None, "other"]), i, rnd.choice([None, 0, rnd.randrange(1, 90)]), "c") for i in range(900)]
    df = spark.createDataFrame(rows + rows[:60], "src string, id int, n int, key string").repartition(6)
    want = spark.createDataFrame([("hot", 0.5, 1), ("s", 0.3, 4), ("t", 0.2, 1), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    taken, report = mix(df, want, "src", "id", "n")
    size = {i: n for s, i, n, _ in rows if s in ("hot", "s", "t") and n}
    got = {r.id: r for r in taken.collect()}
    rep = {r.source: r for r in report.collect()}
    assert all(r.size == size[i] for i, r in got.items())
    for name, cap in (("hot", 1), ("s", 4), ("t", 1)):
        own = [r for r in got.values() if r.source == name]
        assert max(r.copies for r in own) <= cap and len({r.copies for r in own}) <= 2
        sum_ = sum(r.copies * r.size for r in own)
        assert sum_ == rep[name].taken and abs(sum_ - rep[name].budget) <= 45
    assert rep["gone"].taken == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1, abs=1e-5)
    again, _ = mix(df.repartition(2), want, "src", "id", "n")
    assert {(r.id, r.copies) for r in again.collect()} == {(r.id, r.copies) for r in got.values()}
    assert mix(df.limit(0), want, "src", "id", "n")[0].count() == 0
    rep = {r.source: r for r in mix(df, want, "src", "id", "n", "available")[1].collect()}
    whole = sum(r.available for r in rep.values())
    assert sum(r.budget for r in rep.values()) == pytest.approx(whole, rel=1e-6) and rep["t"].taken == rep["t"].available and rep["s"].taken <= 4 * rep["s"].available


def said(*texts):
    """The sentences of each text."""
    got = split(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for d, x in zip(got.doc.tolist(), got.text.to_pylist()):
        out[d].append(x)
    assert got.length.sum() == len(got.words) and len(got.pattern) == len(got.block) == len(got.text)
    return out


def test_sentences():
    text = "# Run 3 — a/b  One two three. | a | b |\n| --- | --- |\n```\nratio: 0.5\n```\n10:11:12 Step ok points=5\nnote: The gap is 3.5 px wide.<br>Kind regards\n> > What holds it up? Draft 2.\nno full stop"
    assert said(text, None, "", "```", "A &amp; B\u00a0met ``` twice.") == [["one two three.", "the gap is 0 px wide.", "what holds it up?"], [], [], [], ["a & b met ``` twice."]]


def test_sentences_of_any_length():
    """Code blocks, tags, tables, logs and lines have no bound beyond which they would be read as text."""
    line = "This is code, not a sentence. "
    code = "```\n" + "\n".join([line] * 1000) + "\n`x` is code too.\n```"
    tag = "<a href='" + "x. y z w. " * 200 + "'>"
    log = "10:11:12 Step ok" + " points=5" * 5000
    assert said(f"{code}\nAll is well here.", f"Here {tag}is a link now.", "|" + " It is a cell. |" * 5000 + "\nNo cell is here.", log + "\nThe log is over.", line * 20_000) == [
        ["all is well here."], ["here is a link now."], ["no cell is here."], ["the log is over."], [line.strip().lower()] * 20_000]


def test_slices():
    t = pa.array(["x" * (9 << 20), None, "y" * (40 << 20), "", "z"])
    got = slices(t)
    assert [a for a, _ in got] == np.cumsum([0, *(n for _, n in got)])[:-1].tolist() and sum(n for _, n in got) == 5 and len(got) > 1
    assert slices(t.slice(0, 0)) == []


def test_latent_model_learns_accuracy():
    rng, k = np.random.default_rng(0), 4
    y = rng.integers(0, k + 1, 20_000)
    votes = []
    for acc, cov in ((0.95, 0.9), (0.6, 0.8), (0.3, 0.5)):
        v = np.where(rng.random(len(y)) < acc, y, rng.integers(0, k + 1, len(y)))
        votes.append(np.where(rng.random(len(y)) < cov, v, ABSTAIN))
    v, n = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    m = fit_latent(v, n.astype(float), k + 1)
    assert m.accuracy[0] > 0.9 > m.accuracy[1] > 0.6 > m.accuracy[2]
    best = m.posterior(np.stack(votes, 1)).argmax(1)
    assert (best == y).mean() > 0.9


def test_subjects_held_out(spark):
    """A third of the labelled texts is held back and assigned like documents."""
    ex = table(spark, SF, "subject_examples")
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    held = ex.filter("example_id % 3 = 0")
    model_docs = parsed(docs.select("doc_id", "text"), Scratch(spark))
    subjects = [r[0] for r in table(spark, SF, "subjects").collect()]
    model, _ = fit(model_docs, ex.filter("example_id % 3 <> 0"), subjects)
    said = {}
    for r in assign(voted(parsed(held.selectExpr("example_id AS doc_id", "text"), Scratch(spark)), model), model).collect():
        said.setdefault(r.doc_id, set()).add(r.subject)
    want = {r.example_id: {r.subject} - {None} for r in held.collect()}
    right = sum(said.get(i, set()) == w for i, w in want.items())
    assert right >= 0.93 * len(want), (right, len(want))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no sentence here"), (4, "| a | b |")], "doc_id bigint, text string")
    assert assign(voted(parsed(odd, Scratch(spark)), model), model).count() == 0
    assert voted(parsed(odd.limit(0), Scratch(spark)), model).count() == 0


def test_rare_subject_words_among_many_common(spark):
    """More common word pairs than any fixed number of lexicon entries: rarer words of a subject still mark it."""
    marks = {"rock": "basalt gneiss schist", "tide": "ebbing current swell", "cloud": "cirrus nimbus stratus"}
    filler = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(lo, lo + 400)) + "." for lo in range(0, 160_000, 400)]
    docs, i = [], 0
    for name, words in marks.items():
        docs += [(i + j, "\n".join([f"{words} here.", *filler, f"{words} there."])) for j in range(2)]
        docs += [(i + 2 + j, f"{words} north.\n{words} south.") for j in range(3)]
        i += 5
    examples = [(f"{words} found.", name) for name, words in marks.items()] + [("nothing to see.", None)]
    d = parsed(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark))
    model, _ = fit(d, spark.createDataFrame(examples, "text string, subject string"), list(marks))
    words = [w for ws in marks.values() for w in ws.split()]
    want = [model.subjects.index(name) for name, ws in marks.items() for _ in ws.split()]
    ids = hashes(pa.array(words))
    assert model.seed.classes(ids).tolist() == want == model.lexicon.load()[0].classes(ids).tolist()


def test_marks_and_hashes():
    rng = np.random.default_rng(2)
    term = _distinct(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    m = Marks(term[::2], np.arange(len(term[::2])) % 7, np.ones(len(term[::2])))
    got = m.classes(term)
    assert (got[::2] == np.arange(len(term[::2])) % 7).all() and (got[1::2] == ABSTAIN).all()
    assert Marks(term[:0], term[:0], term[:0]).classes(term).max() == ABSTAIN
    h = hashes(pa.array(["a", "b", "a", ""]))
    assert h[0] == h[2] != h[1] and hashes(pa.array(["b"]))[0] == h[1] and (h < 1 << 48).all()
    assert pairs_of(h[:1], h[1:2]) != pairs_of(h[1:2], h[:1]) and len(hashes(pa.array([], pa.string()))) == 0
    assert decoded(np.array([0, 1 + 12 * 3]), 11).tolist() == [[-1] * 6, [0, 2, -1, -1, -1, -1]]
