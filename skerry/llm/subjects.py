"""Subject areas of documents: labelling functions over sentences, joined by a latent model that learns their accuracy.

Each full sentence has one class: a subject, or none (it is about the work itself). Labelling functions vote on it:

* ``seed``: a lexicon of words and word pairs fitted on the labelled examples;
* ``lexicon``: the same from the corpus, by the company a term keeps: which subjects the *other* sentences of its documents have;
* ``pattern``: the same for whole sentence patterns;
* ``section``: the subject that leads among the other sentences of the block;
* ``address``: the subject that leads in documents with the same leading part of their address (here the capture's set);
* ``source``: the subject that leads in documents of the same source.

Texts become arrays of word hashes once, in a stored table. Passes over it are array arithmetic on Arrow buffers, one slice of
documents at a time; sums of terms are merged by Spark. Votes are counted over the whole corpus by combination (their number
is bounded by the classes, not by the data), and expectation-maximisation finds each function's accuracy and the class shares
without labels. A document is assigned the subjects whose sentences, by posterior, fill at least the wanted share.

Terms are known by 48 bits of their hash, so among 10^9 terms a few in a million share an entry.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import tidy
from skerry.llm.sentences import BITS, Sentences, hashes, pairs_of, slices, split
from skerry.operators.nested import list_children
from skerry.runtime import Scratch, Written, spread

FUNCTIONS = ("seed", "lexicon", "pattern", "section", "address", "source")
#: Labelled examples that are read at most.
MAX_EXAMPLES = 20_000
#: Documents that an entry needs before its company says anything: least evidence for one entry, whatever the corpus size.
MIN_DOCS = 4
ABSTAIN = -1
#: Words and (document, class) cells that one slice of a pass holds at most; a longer document is a slice of its own.
_WORDS = 2_000_000
_CELLS = 1 << (64 - BITS)


class Marks:
    """term -> (class, weight): arrays sorted by the term's hash, 13 bytes an entry."""

    def __init__(self, term: np.ndarray, k: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.term, self.k, self.weight = term[order].astype(np.uint64), k[order].astype(np.int8), weight[order].astype(np.float32)
        # one flag for each value of the low bits tells most unknown terms apart without a search
        self.low = np.uint64((1 << max(16, min(26, 4 + int(len(term)).bit_length()))) - 1)
        self.maybe = np.zeros(int(self.low) + 1, bool)
        self.maybe[self.term & self.low] = True

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms have an entry, and which one."""
        at = np.flatnonzero(self.maybe[terms & self.low])
        where = np.searchsorted(self.term, terms[at])
        hit = self.term[np.minimum(where, len(self.term) - 1)] == terms[at] if len(self.term) else np.zeros(len(at), bool)
        return at[hit], where[hit]

    def classes(self, terms: np.ndarray) -> np.ndarray:
        out = np.full(len(terms), ABSTAIN, np.int64)
        at, where = self.find(terms)
        out[at] = self.k[where]
        return out


@dataclass(frozen=True)
class Lexicon:
    """A learned lexicon of any size: a table in the shared folder that workers read, not the driver.

    Kinds 0 to 3 are words, patterns (which may also stand for no subject), addresses and sources.
    """

    path: str

    def load(self) -> list[Marks]:
        if self.path not in _loaded:
            _loaded.clear()
            fs, at = FileSystem.from_uri(self.path)
            schema = pa.schema([("kind", pa.int32()), ("term", pa.int64()), ("k", pa.int32()), ("weight", pa.float64())])
            files = pyarrow.dataset.dataset(at, schema=schema, format="parquet", filesystem=fs)
            tables = [files.to_table(["term", "k", "weight"], filter=pyarrow.dataset.field("kind") == kind) for kind in range(4)]
            _loaded[self.path] = [Marks(*(t.column(c).to_numpy() for c in ("term", "k", "weight"))) for t in tables]
        return _loaded[self.path]


#: The lexicon that this worker read last.
_loaded: dict[str, list[Marks]] = {}


def seed_lexicon(examples: Sentences, labels: Sequence[int], classes: int) -> Marks:
    """Terms that mark one subject among the labelled examples. ``classes - 1`` stands for none.

    Terms of a single example are kept; :func:`fit` checks every term against the corpus before it is used.
    """
    none = classes - 1
    terms, of = _terms(examples.words, examples.length)
    seen: dict[int, Counter] = defaultdict(Counter)
    size = Counter(labels)
    for t, d in {*zip(terms.tolist(), examples.doc[of].tolist())}:
        seen[t][labels[d]] += 1
    out = []
    for t, by in sorted(seen.items()):
        rate = {k: n / size[k] for k, n in by.items()}
        best = max(rate, key=lambda k: (rate[k], -k))
        rest = sum(v for k, v in rate.items() if k != best)
        if best == none:
            continue
        purity = rate[best] / (rate[best] + rest + 0.5 / max(size.values()))
        if purity >= 0.6:
            out.append((t, best, math.log(purity / (1 - min(purity, 0.98))) + 0.3))
    return Marks(*(np.array([x[i] for x in out], kind) for i, kind in enumerate((np.uint64, np.int8, np.float32))))


def _terms(words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and word pairs of sentences, and the sentence of each."""
    of = np.repeat(np.arange(len(length)), length)
    same = np.flatnonzero(of[1:] == of[:-1])
    return np.concatenate([words, pairs_of(words[same], words[same + 1])]), np.concatenate([of, of[same]])


@dataclass
class _Slice:
    """Some documents as arrays: for each sentence its document, block and pattern; terms and the sentence of each."""

    docs: int
    doc: np.ndarray
    block: np.ndarray
    pattern: np.ndarray
    terms: np.ndarray
    of: np.ndarray
    address: np.ndarray
    source: np.ndarray


def _read(b: pa.RecordBatch, classes: int) -> Iterator[tuple[int, _Slice]]:
    """Slices of a batch of parsed documents, each with its first row."""
    words, length = b.column("words"), b.column("lens")
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < b.num_rows:
        hi = lo + 1 + int(np.searchsorted(np.cumsum(n[lo + 1 : lo + _CELLS // classes]) + n[lo], _WORDS, "right"))
        part = b.slice(lo, hi - lo)
        col = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)
        _, doc, _ = list_children(part.column("lens"))
        terms, of = _terms(col("words").view(np.uint64), col("lens"))
        far = [part.column(c).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("address", "source")]
        yield lo, _Slice(part.num_rows, doc, col("blocks"), col("pats").view(np.uint64), terms, of, *far)
        lo = hi


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort (faster here than hashing)."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _vote(s: _Slice, marks: Marks, classes: int, blank: int, least: float = 0.8) -> np.ndarray:
    """One vote a sentence by the weights of its marking terms: the best class if it is clearly ahead, else ``blank``."""
    at, where = marks.find(s.terms)
    # a term that a sentence repeats counts once
    once = _distinct(s.of[at] * np.int64(len(marks.term) + 1) + where)
    sent, where = np.divmod(once, np.int64(len(marks.term) + 1))
    score = np.bincount(sent * classes + marks.k[where], marks.weight[where], len(s.doc) * classes).reshape(-1, classes)
    best = score.argmax(1)
    top = score[np.arange(len(best)), best]
    score[np.arange(len(best)), best] = 0
    return np.where((top >= least) & (top > 1.3 * score.max(1, initial=0)), best, blank)


def _first_vote(s: _Slice, seed: Marks, lex: list[Marks] | None, classes: int) -> np.ndarray:
    """The best single opinion so far."""
    none = classes - 1
    if lex is None:
        return _vote(s, seed, classes, none)
    pattern = lex[1].classes(s.pattern)
    return np.where(pattern == ABSTAIN, _vote(s, lex[0], classes, none), pattern)


def _sums(key: np.ndarray, cell: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct term the shares of the distinct cells it stands in, summed, and their number."""
    bits = np.uint64(64 - BITS)
    both = _distinct((key << bits) | cell.astype(np.uint64))
    term, cell = both >> bits, (both & np.uint64(_CELLS - 1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
    cols = [np.bincount(which, share[cell, k], len(start)) for k in range(share.shape[1])]
    return term[start], np.stack([*cols, np.bincount(which, minlength=len(start)).astype(float)], 1) if len(start) else np.zeros((0, share.shape[1] + 1))


def _statistics(seed: Marks, lex: Lexicon | None, classes: int):
    """Company of terms and patterns: for each, the subject shares among the other sentences of its documents."""
    none = classes - 1
    names = ["kind", "term", *[f"s{i}" for i in range(none)], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = lex.load() if lex else None
        for b in batches:
            for _, s in _read(b, classes):
                v = _first_vote(s, seed, marks, classes)
                said = v != none
                count = np.bincount(s.doc[said] * none + v[said], minlength=s.docs * none).reshape(s.docs, none).astype(float)
                total = count.sum(1)
                # cell (document, vote): shares of the document's other sentences
                own = np.vstack([np.eye(none), np.zeros(none)])
                rest = count[:, None, :] - own[None]
                size = rest.sum(2)
                share = (rest / np.maximum(size, 1)[:, :, None]).reshape(-1, none)
                cell = s.doc * classes + v
                ok = size.reshape(-1)[cell] > 0
                far, some = np.arange(s.docs) * classes + none, total > 0
                for kind, key, at in (
                    (0, s.terms[ok[s.of]], cell[s.of][ok[s.of]]),
                    (1, s.pattern[ok], cell[ok]),
                    (2, s.address[some & (s.address > 0)], far[some & (s.address > 0)]),
                    (3, s.source[some & (s.source > 0)], far[some & (s.source > 0)]),
                    (4, np.ones(some.sum(), np.uint64), far[some]),
                ):
                    term, sums = _sums(key, at, share)
                    if len(term):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), kind, np.int32)), pa.array(term.astype(np.int64)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(none + 1)]], names=names)

    return run


def _marks(got: DataFrame, none: int) -> DataFrame:
    """``kind, term, k, weight``: the entries that mark a subject (or, of patterns, none), however rare or many."""
    cols = [f"s{i}" for i in range(none)]
    all_ = got.filter("kind = 4").select(*cols).first()  # one row at most
    base = np.array(all_ or [0.0] * none)
    base = [float(b) for b in (base + 1) / (base.sum() + none)]
    t = got.filter("kind < 4").select("kind", "term", "n", F.array(*[(F.col(c) + 2 * b) / (F.col("n") + 2) for c, b in zip(cols, base)]).alias("shares"))
    t = t.withColumn("share", F.array_max("shares")).withColumn("k", F.array_position("shares", F.col("share")).cast("int") - 1)
    # a phrase shared by some subjects has close seconds, a term of one subject has not
    t = t.withColumn("odds", F.col("share") / F.array_max(F.filter("shares", lambda x, i: i != F.col("k"))))
    # how much more likely the subject is in this company than in the corpus; fair to rare and to leading subjects
    own = F.array(*[F.lit(b) for b in base])[F.col("k")]
    t = t.withColumn("lift", F.col("share") * (1 - own) / F.greatest((1 - F.col("share")) * own, F.lit(1e-9)))
    # a term marks a subject if its company is that subject much beyond the subject's share of the corpus
    k = F.when(F.expr("kind = 0 AND share >= 0.33 AND lift >= 3 AND odds >= 2.5"), F.col("k"))
    k = k.when(F.expr(f"kind = 1 AND n >= {2 * MIN_DOCS} AND share >= 0.42 AND lift >= 3 AND odds >= 2"), F.col("k"))
    k = k.when(F.expr(f"kind = 1 AND n >= {2 * MIN_DOCS} AND (share < 0.30 OR lift < 1.8)"), F.lit(none))
    # a set or source of no particular subject abstains
    k = k.when(F.expr("kind IN (2, 3) AND share >= 0.3 AND lift >= 2"), F.col("k"))
    return t.select("kind", "term", k.alias("k"), F.log(F.least("odds", F.lit(50.0))).alias("weight")).filter("k IS NOT NULL")


def _company(docs: DataFrame, seed: Marks, lex: Lexicon | None, classes: int, s: Scratch) -> Written:
    cols = [f"s{i}" for i in range(classes - 1)]
    got = docs.mapInArrow(_statistics(seed, lex, classes), "kind int, term bigint, " + ", ".join(f"{c} double" for c in cols) + ", n double")
    return s.write(got.groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in [*cols, "n"]]).filter(f"n >= {MIN_DOCS}"))


def _learn(docs: DataFrame, seed: Marks, lex: Lexicon | None, classes: int, s: Scratch) -> Lexicon:
    got = _company(docs, seed, lex, classes, s)
    out = Lexicon(s.write(_marks(got.df, classes - 1)).path)
    s.drop(got)
    return out


def _section(s: _Slice, v: np.ndarray, classes: int) -> np.ndarray:
    """The subject that leads among the other sentences of a sentence's block, or ABSTAIN."""
    none = classes - 1
    _, block = np.unique(s.doc * np.int64(1 << 32) + s.block, return_inverse=True)
    said = v != none
    near = np.bincount(block[said] * none + v[said], minlength=(block.max(initial=-1) + 1) * none).reshape(-1, none)[block]
    near[np.flatnonzero(said), v[said]] -= 1
    return np.where(near.max(1, initial=0) > 0, near.argmax(1), ABSTAIN)


def _votes(s: _Slice, seed: Marks, lex: list[Marks], classes: int) -> np.ndarray:
    """The votes of all labelling functions on each sentence."""
    none = classes - 1
    word, pattern = _vote(s, lex[0], classes, none), lex[1].classes(s.pattern)
    v = np.where(pattern == ABSTAIN, word, pattern)
    return np.stack([_vote(s, seed, classes, ABSTAIN), word, pattern, _section(s, v, classes), lex[2].classes(s.address)[s.doc], lex[3].classes(s.source)[s.doc]], 1)


def _coded(seed: Marks, lex: Lexicon, classes: int):
    """Documents with the vote combination of each sentence as one number."""
    place = (classes + 1) ** np.arange(len(FUNCTIONS), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = lex.load()
        for b in batches:
            for lo, s in _read(b, classes):
                code = (_votes(s, seed, marks, classes) + 1) @ place
                ends = np.concatenate([[0], np.cumsum(np.bincount(s.doc, minlength=s.docs))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, s.docs), pa.ListArray.from_arrays(pa.array(ends), pa.array(code))], names=["doc_id", "codes"])

    return run


@dataclass
class LatentModel:
    """Class shares and, for each function, how it votes given the class. Fitted on counted vote combinations."""

    prior: np.ndarray
    tables: list[np.ndarray]  # [function][class, vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[None, :] + sum(np.log(t[:, votes[:, j] + 1]).T for j, t in enumerate(self.tables))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True)

    @property
    def accuracy(self) -> list[float]:
        """Chance that a function is right when it votes, by the model's own estimate."""
        out = []
        for t in self.tables:
            said = (self.prior[:, None] * t[:, 1:]).sum()
            out.append(float((self.prior * np.diag(t[:, 1:])).sum() / said) if said else 0.0)
        return out


def fit_latent(votes: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 60) -> LatentModel:
    """EM. A function has, for subjects and for none apart, a rate of abstaining and an accuracy; wrong votes fall evenly
    over the other subjects or, at a rate of their own, on none."""
    none, m = classes - 1, votes.shape[1]
    model = LatentModel(np.full(classes, 1 / classes), [_table(0.3, 0.75, 0.1, 0.3, 0.75, classes)] * m)
    for _ in range(rounds):
        p = model.posterior(votes) * counts[:, None]
        prior = (p.sum(axis=0) + 1) / (p.sum() + classes)
        subj, blank = p[:, :none], p[:, none]
        tables = []
        for j in range(m):
            v = votes[:, j]
            right = subj[np.arange(len(v))[v >= 0], np.minimum(v[v >= 0], none - 1)][v[v >= 0] < none].sum()
            ab, no = subj[v == ABSTAIN].sum(), subj[v == none].sum()
            all_s, all_n = subj.sum() + 3, blank.sum() + 3
            a0, n0 = blank[v == ABSTAIN].sum(), blank[v == none].sum()
            tables.append(_table((ab + 1) / all_s, (right + 1) / all_s, (no + 1) / all_s, (a0 + 1) / all_n, (n0 + 1) / all_n, classes))
        model = LatentModel(prior, tables)
    return model


def _table(abstain_s: float, right_s: float, none_s: float, abstain_n: float, right_n: float, classes: int) -> np.ndarray:
    none = classes - 1
    t = np.zeros((classes, classes + 1))
    t[:none, 0], t[none, 0] = abstain_s, abstain_n
    t[:none, 1:classes] = max(1 - abstain_s - right_s - none_s, 1e-4) / (none - 1)
    t[np.arange(none), np.arange(none) + 1] = right_s
    t[:none, classes] = none_s
    t[none, 1:classes] = max(1 - abstain_n - right_n, 1e-4) / none
    t[none, classes] = right_n
    t = np.maximum(t, 1e-6)
    return t / t.sum(axis=1, keepdims=True)


@dataclass
class SubjectModel:
    subjects: list[str]
    seed: Marks
    lexicon: Lexicon
    latent: LatentModel


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "source", "address", "words", "lens", "pats", "blocks"]
    for b in batches:
        for lo, n in slices(b.column("text")):
            part = b.slice(lo, n)
            s = split(part.column("text"))
            of_doc = np.concatenate([[0], np.cumsum(np.bincount(s.doc, minlength=n))]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(s.length)]).astype(np.int32)[of_doc]
            lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in ((ends, s.words.astype(np.int64)), (of_doc, s.length), (of_doc, s.pattern.astype(np.int64)), (of_doc, s.block))]
            far = [pa.array(np.where(part.column(c).is_null().to_numpy(zero_copy_only=False), 0, hashes(part.column(c).fill_null("")).astype(np.int64))) for c in ("source", "address")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *far, *lists], names=names)


def parsed(documents: DataFrame, s: Scratch) -> DataFrame:
    """Documents as hashes of words and sentence patterns, written once. Needs ``doc_id, text``; ``source, capture`` are used
    where present."""
    has = set(documents.columns)
    null = F.lit(None).cast("string")
    src = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        (F.col("source") if "source" in has else null).alias("source"),
        (F.substring_index(tidy("capture"), "/", 1) if "capture" in has else null).alias("address"),
    )
    return s.write(spread(src).mapInArrow(_parse, "doc_id bigint, source bigint, address bigint, words array<bigint>, lens array<int>, pats array<bigint>, blocks array<int>")).df


def fit(docs: DataFrame, examples: DataFrame, subjects: Sequence[str], passes: int = 2) -> tuple[SubjectModel, DataFrame]:
    """Fits all labelling functions and the latent model on parsed documents (see :func:`parsed`); returns the model and the
    documents with the votes on their sentences.

    The examples are a labelled sample, read up to ``MAX_EXAMPLES`` rows by smallest text hash; a null subject means none,
    and examples of subjects that are not in use are left out. The model's lexicon lasts as long as the session.
    """
    names = sorted(subjects)
    classes = len(names) + 1
    at = {n: i for i, n in enumerate(names)}
    rows = examples.select("text", "subject").orderBy(F.xxhash64("text")).limit(MAX_EXAMPLES).collect()
    labelled = [(r["text"], at.get(r["subject"], classes - 1)) for r in rows if r["text"] and (r["subject"] is None or r["subject"] in at)]
    seed = seed_lexicon(split(pa.array([t for t, _ in labelled], pa.string())), [k for _, k in labelled], classes)
    scratch = Scratch(docs.sparkSession)
    lex: Lexicon | None = None
    # a seed term stays if its company in the corpus is its own subject; phrases of all subjects drop out
    got = _company(docs, seed, None, classes, scratch)
    own = docs.sparkSession.createDataFrame(list(zip(seed.term.tolist(), seed.k.tolist())), "term bigint, k int")
    kept = np.array([r[0] for r in _marks(got.df, classes - 1).filter("kind = 0").join(F.broadcast(own), ["term", "k"]).select("term").collect()], np.uint64)  # terms of the bounded sample
    stay = np.isin(seed.term, kept)
    seed = Marks(seed.term[stay], seed.k[stay], seed.weight[stay])
    scratch.drop(got)
    for _ in range(passes):
        lex = _learn(docs, seed, lex, classes, scratch)
    coded = scratch.write(docs.mapInArrow(_coded(seed, lex, classes), "doc_id bigint, codes array<bigint>")).df
    # at most (classes + 1) ** 2 * classes ** 2 * sets * sources combinations, however many documents there are
    got = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    votes = decoded(np.array([r["code"] for r in got], dtype=np.int64), classes)
    return SubjectModel(names, seed, lex, fit_latent(votes, np.array([r["n"] for r in got], dtype=np.float64), classes)), coded


def decoded(codes: np.ndarray, classes: int) -> np.ndarray:
    """Vote combinations of their numbers."""
    return codes[:, None] // (classes + 1) ** np.arange(len(FUNCTIONS), dtype=np.int64) % (classes + 1) - 1


def voted(docs: DataFrame, model: SubjectModel) -> DataFrame:
    """Parsed documents with the model's votes on their sentences."""
    return docs.mapInArrow(_coded(model.seed, model.lexicon, len(model.subjects) + 1), "doc_id bigint, codes array<bigint>")


def assign(coded: DataFrame, model: SubjectModel, share: float = 0.25) -> DataFrame:
    """``doc_id, subject, sentences, of``: the subjects of a document that fill ``share`` or more of its full sentences."""
    none = len(model.subjects)
    names = np.array(model.subjects, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, doc, _ = list_children(b.column("codes"))
            known, of = np.unique(codes.to_numpy(zero_copy_only=False), return_inverse=True)
            k = model.latent.posterior(decoded(known, none + 1)).argmax(1)[of] if len(known) else np.zeros(0, np.int64)
            count = np.bincount(doc * (none + 1) + k, minlength=b.num_rows * (none + 1)).reshape(-1, none + 1)
            size = count.sum(1)
            d, s = np.nonzero((count[:, :none] > 0) & (count[:, :none] >= share * size[:, None]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(names[s], pa.string()), pa.array(count[d, s].astype(np.int32)), pa.array(size[d].astype(np.int32))], names=["doc_id", "subject", "sentences", "of"])

    return coded.mapInArrow(run, "doc_id bigint, subject string, sentences int, of int")


def subject_areas(documents: DataFrame, examples: DataFrame, subjects: DataFrame, share: float = 0.25) -> DataFrame:
    """Fits on the documents themselves and assigns them; see :func:`fit` and :func:`assign`.

    Defined cases: null, empty and sentence-less texts have no subject; repeated documents are each assigned; an empty
    table gives an empty result; texts are read whole; other columns are ignored.
    """
    docs = parsed(documents, Scratch(documents.sparkSession))
    names = [r[0] for r in subjects.select("subject").dropna().distinct().collect()]  # the list of subjects in use
    model, coded = fit(docs, examples, names)
    return assign(coded, model, share)
