"""Subject areas of documents, by latent Dirichlet topic models.

1. Sentences become terms: words with their particles and digits dropped, and pairs of neighbours. A term
   is one of 2^22 hash buckets, which bounds whatever is broadcast and drops none; texts are read once.
2. Topic models are fitted by distributed online variational Bayes: each pass takes the documents of one
   part, every document falls into one part, and the last passes take all. The expectation step runs in
   Arrow batches, the maximisation step adds their sums. Topics are fitted on the words of most documents
   (``FIT_TERMS``; none of fewer than ``LEAST_DOCS`` or of more than half of the documents).
3. Topics are mapped to subjects through their top terms: each top term speaks for the subjects whose
   hand-labelled documents, titles and scope hold it. A topic whose top terms speak for no subject half as
   much again as for the next is left out. ``topic_table`` shows the top terms with the mapping.
4. A sentence is assigned by the topics of its terms, with the topic proportions of its document as
   prior; what its terms leave open is decided by the document. Two recounts over all sentences then give
   the rare terms and pairs their topics, and find the terms of remarks made in documents of every
   subject. A sentence without any term of clear subject treats none.
5. The subjects of a document are those of at least a fifth of its topic proportions, counted in
   sentences that treat any subject.

All hand labels are read, and joined to their documents where repeated documents are dropped; labels may
be doubled, wrong or spelled freely (key, English or Korean title).

Defined cases: null, empty and blank texts, and texts without a clear sentence, get no subject; repeated
documents count once; ties between subjects in a sentence go to the one first by name; texts are read
whole, whatever their length; without labels the titles and scopes alone speak; without subjects there
are no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.folding import fold, fold_key
from tracewell.session import cut

TOPICS, PASSES, FULL_PASSES, PART_DOCS, INNER = 64, 24, 1, 4096, 8
FIT_TERMS, LEAST_DOCS, MOST_SHARE, TOP_TERMS = 4096, 5, 0.5, 12
MOST_SUBJECTS, ROUNDS, LEAST_SHARE = 256, 2, 0.2
ALPHA, ETA, SURE = 0.1, 0.02, 1.5
_HALF = 1 << 21
_CLEAR, _SEEN, _FAVOUR = 0.75, 0.25, 0.15

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_PARTICLE = re.compile(r"(?<=[가-힣]{2})(?:에서는|으로|에서|까지|은|는|이|가|을|를|의|에|로|와|과|도)$")
_STOP = re.compile(r"[\r\n]+|[.!?]\s+|[。！？]\s*")
_NEXT = re.compile(r"[^\sa-z0-9(]|\d+[가-힣]")


def sentences(text: str) -> list[str]:
    """Line ends and stops end a sentence, unless a Latin abbreviation or number runs on in lower case or digits."""
    out, begin = [], 0
    for m in _STOP.finditer(text):
        at, end = m.start(), m.end()
        stop = text[at]
        if stop == "." and not ("가" <= text[at - 1 : at] <= "힣" or _NEXT.match(text, end) or "\n" in m[0] or "\r" in m[0]):
            continue
        out.append(text[begin : at + 1])
        begin = end
    out.append(text[begin:])
    return [s for s in out if s and not s.isspace()]


def stem(word: str) -> str:
    return _PARTICLE.sub("", word)


class _Buckets(dict):
    """Bucket of each word met, emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = got = zlib.crc32(stem(word).encode()) % _HALF
        return got


def _words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def indexed(docs: DataFrame) -> DataFrame:
    """doc, subjects, words (buckets of all words in order), lens (words of each sentence). docs: doc, t, subjects."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        at = _Buckets()
        for batch in batches:
            words, lens, n_words, n_lens = [], [], [0], [0]
            for text in batch.column("t").to_pylist():
                for s in sentences(fold(text)):
                    found = _words(s)
                    words += [at[w] for w in found]
                    lens.append(len(found))
                n_words.append(len(words)), n_lens.append(len(lens))
            lists = lambda n, v: pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(v, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("subjects"), lists(n_words, words), lists(n_lens, lens)], ["doc", "subjects", "words", "lens"])

    return docs.mapInArrow(run, f"doc {kind}, subjects array<string>, words array<int>, lens array<int>")


@dataclass
class Flat:
    """Terms of a batch in one run: bucket and sentence of each, and the document of each sentence."""

    term: np.ndarray
    of_sentence: np.ndarray
    of_doc: np.ndarray
    docs: int


def _few(batches, step: int = 2048):
    """Batches of at most ``step`` documents, which bounds the arrays made of them."""
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def flat(batch: pa.RecordBatch) -> Flat:
    words, lens = batch.column("words").flatten().to_numpy(zero_copy_only=False), batch.column("lens").flatten().to_numpy(zero_copy_only=False)
    of_doc = np.repeat(np.arange(batch.num_rows), batch.column("lens").value_lengths().to_numpy(zero_copy_only=False))
    of_sentence = np.repeat(np.arange(len(lens)), lens)
    side = np.flatnonzero(of_sentence[1:] == of_sentence[:-1])
    mixed = words[side].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[side + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = _HALF + ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(43)).astype(np.int64)
    return Flat(np.concatenate([words.astype(np.int64), pairs]), np.concatenate([of_sentence, of_sentence[side]]), of_doc, batch.num_rows)


def document_counts(sents: DataFrame, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, buckets, documents of each bucket) of the buckets of at least ``least`` documents."""

    def count(batches):
        held, docs = np.zeros(2 * _HALF, np.int64), 0
        for batch in _few(batches):
            f = flat(batch)
            # A hash table, not a sort: each document counts a term once.
            seen = pc.unique(pa.array(f.of_doc[f.of_sentence] * (2 * _HALF) + f.term, pa.int64())).to_numpy(zero_copy_only=False)
            held += np.bincount(seen & (2 * _HALF - 1), minlength=2 * _HALF)
            docs += f.docs
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], docs))], ["term", "n"])

    counted = sents.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("term") < 0))
    # Bounded by the number of buckets.
    got = counted.toPandas().sort_values("term").to_numpy()
    return int(got[0, 1]) if len(got) else 0, got[1:, 0], got[1:, 1]


def _place(buckets: np.ndarray) -> np.ndarray:
    """Row of each bucket among ``buckets``, -1 for the others."""
    at = np.full(2 * _HALF, -1, np.int32)
    at[buckets] = np.arange(len(buckets))
    return at


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, np.float64), 0.0
    for _ in range(6):
        out = out - 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def _spread(x: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet rows."""
    return np.exp(_digamma(x) - _digamma(x.sum(axis=1, keepdims=True))).astype(np.float32)


def expectation(bags: np.ndarray, topics: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(sums for the topics, topic proportions of each document, not normalised) of documents by fit terms."""
    mine = np.ones((len(bags), len(topics)), np.float32)
    for _ in range(inner):
        now = _spread(mine)
        mine = ALPHA + now * ((bags / (now @ topics + 1e-30)) @ topics.T)
    now = _spread(mine)
    return topics * (now.T @ (bags / (now @ topics + 1e-30))), mine


def _bags(batch: pa.RecordBatch, terms: int, step: int = 1024):
    doc = np.repeat(np.arange(batch.num_rows), batch.column("at").value_lengths().to_numpy(zero_copy_only=False))
    at, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "n"))
    for a in range(0, batch.num_rows, step):
        mine = slice(*np.searchsorted(doc, [a, a + step]))
        x = np.zeros((min(step, batch.num_rows - a), terms), np.float32)
        x[doc[mine] - a, at[mine]] = n[mine]
        yield slice(a, a + len(x)), x


def _summed(blobs: DataFrame, shape: tuple) -> np.ndarray:
    """The sum of each task's matrix, added up in as many groups as there are tasks to a group."""
    spread = max(1, int(blobs.sparkSession.sparkContext.defaultParallelism ** 0.5))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape, np.float64)
        for b in pdf["blob"]:
            total += np.frombuffer(b, np.float32).reshape(shape)
        return pd.DataFrame({"blob": [total.astype(np.float32).tobytes()]})

    parts = blobs.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(spread))).groupBy("slot").applyInPandas(add, "blob binary")
    return sum((np.frombuffer(r[0], np.float32).reshape(shape).astype(np.float64) for r in parts.collect()), np.zeros(shape))


def fit_topics(bags: DataFrame, docs: int, terms: int, topics: int = TOPICS, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """Topics by terms: the variational parameters of an LDA model. bags: part, at, n."""
    model = np.random.default_rng(seed).gamma(100.0, 0.01, (topics, terms))
    parts = _parts(docs, passes)
    for t in range(passes + FULL_PASSES):
        held = bags.sparkSession.sparkContext.broadcast(_spread(model))
        mine = bags.where(F.col("part") == t % parts) if t < passes else bags

        def step(batches, held=held):
            total, seen = np.zeros((topics, terms)), 0
            for batch in batches:
                for _, x in _bags(batch, terms):
                    total += expectation(x, held.value)[0]
                    seen += len(x)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), seen).astype(np.float32).tobytes()], pa.binary())], ["blob"])

        got = _summed(mine.mapInArrow(step, "blob binary"), (topics * terms + 1,))
        sums, seen = got[:-1].reshape(topics, terms), got[-1]
        if seen:
            rho = (1 + t) ** -0.6 if t < passes and parts > 1 else 1.0
            model = (1 - rho) * model + rho * (ETA + sums * (docs / seen))
        held.destroy()
    return model


def _parts(docs: int, passes: int) -> int:
    """Every document is in one of at most as many parts as there are passes."""
    return int(max(1, min(passes, docs // PART_DOCS)))


def top_terms(model: np.ndarray, n: int = TOP_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """(topics by terms, given the topic; the n terms of each topic that say most of it)."""
    given = model / model.sum(axis=1, keepdims=True)
    lift = given / (model.sum(axis=0) / model.sum())
    return given, np.argsort(-given * np.log(lift), axis=1, kind="stable")[:, :n]


def map_topics(model: np.ndarray, spoken: np.ndarray) -> np.ndarray:
    """Topics by subjects: how much the top terms of each topic speak for each subject.

    spoken: fit terms by subjects, labelled documents (and titles) that hold the term.
    """
    given, top = top_terms(model)
    prior = (spoken.sum(axis=0) + 1e-9) / (spoken.sum() + 1e-9 * spoken.shape[1])
    share = (spoken + 4 * prior) / (spoken.sum(axis=1, keepdims=True) + 4) / prior
    share /= share.sum(axis=1, keepdims=True)
    weight = np.take_along_axis(given, top, axis=1)
    return np.einsum("kt,kts->ks", weight, share[top]) / weight.sum(axis=1, keepdims=True)


def subject_shares(model: np.ndarray, spoken: np.ndarray) -> np.ndarray:
    """Fit terms by subjects: the share of a term's topics that are mapped to each subject."""
    stand = map_topics(model, spoken)
    order = np.sort(stand, axis=1)
    sure = order[:, -1] >= SURE * order[:, -2] if stand.shape[1] > 1 else np.ones(len(stand), bool)
    mapped = np.eye(stand.shape[1])[stand.argmax(axis=1)] * sure[:, None]
    return (model / model.sum(axis=0)).T @ mapped


def assign(f: Flat, at: np.ndarray, logs: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Subject number of each sentence; -1 if it has no more clear terms (mark 1) than terms of remarks (mark -1).

    Terms decide first, which gives the topic proportions of each document; with these as prior they decide again.
    """
    n, many = logs.shape[1], len(f.of_doc)
    row = at[f.term]
    known = row >= 0
    weight = np.bincount(f.of_sentence[known], weights=mark[row[known]], minlength=many)
    clear = known.copy()
    clear[known] = mark[row[known]] == 1
    r, s = row[clear], f.of_sentence[clear]
    sums = np.stack([np.bincount(s, weights=logs[r, k], minlength=many) for k in range(n)], axis=1)
    treats = (np.bincount(s, minlength=many) > 0) & (weight > 0)
    first = np.where(treats, sums.argmax(axis=1), -1)
    held = by_document(first, f.of_doc, f.docs, n) + 0.5
    prior = np.log(held / held.sum(axis=1, keepdims=True))
    return np.where(treats, (sums + prior[f.of_doc]).argmax(axis=1), -1)


def by_document(at: np.ndarray, of_doc: np.ndarray, docs: int, n: int) -> np.ndarray:
    known = at >= 0
    return np.bincount(of_doc[known] * n + at[known], minlength=docs * n).reshape(docs, n)


def refine(sents: DataFrame, buckets: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS) -> tuple:
    """Recount each term's subject shares under the assignment of all sentences, round by round.

    A term is clear if its sentences mostly share one subject and the other sentences of its documents
    favour that subject over the corpus. A frequent term of one subject that they hardly favour belongs
    to the remarks found in documents of every subject, and stays there in later rounds.
    """
    spark, (v, n) = sents.sparkSession, shares.shape
    # Topics are soft: at first a term counts as clear at a lower share.
    state = (np.log(shares + 0.01), (shares.max(axis=1) >= 0.6).astype(np.int8))
    remark = np.zeros(v, bool)
    columns = [*(f"n{i}" for i in range(n + 1)), *(f"c{i}" for i in range(n))]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((buckets, *state))

        def count(batches, held=held):
            place, (_, logs, mark) = _place(held.value[0]), held.value
            total = np.zeros((v, 2 * n + 1))
            for batch in _few(batches):
                f = flat(batch)
                if not len(f.of_doc):
                    continue
                at = assign(f, place, logs, mark)
                row = place[f.term]
                term, of_sentence = row[row >= 0], f.of_sentence[row >= 0]
                total[:, : n + 1] += np.bincount(term * (n + 1) + np.where(at < 0, n, at)[of_sentence], minlength=v * (n + 1)).reshape(v, n + 1)
                own = np.zeros((len(f.of_doc), n))
                own[np.flatnonzero(at >= 0), at[at >= 0]] = 1
                others = by_document(at, f.of_doc, f.docs, n)[f.of_doc] - own
                others /= np.maximum(others.sum(axis=1, keepdims=True), 1)
                for k in range(n):
                    total[:, n + 1 + k] += np.bincount(term, weights=others[of_sentence, k], minlength=v)
            some = np.flatnonzero(total.any(axis=1))
            arrays = [pa.array(some), *(pa.array(total[some, i]) for i in range(2 * n + 1))]
            yield pa.RecordBatch.from_arrays(arrays, ["term", *columns])

        # One row a term and task at most: bounded by the buckets.
        counted = sents.mapInArrow(count, "term long, " + ", ".join(f"{c} double" for c in columns))
        sums = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        total = np.zeros((v, 2 * n + 1))
        total[sums.term] = sums[columns].to_numpy()
        own, none, around = total[:, :n], total[:, n], total[:, n + 1 :]
        given = own.sum(axis=1)
        shares = own / np.maximum(given, 1)[:, None]
        prior = own.sum(axis=0) / max(own.sum(), 1)
        best = shares.argmax(axis=1)
        near = around[np.arange(v), best] / np.maximum(around.sum(axis=1), 1e-9)
        alone = around.sum(axis=1) < 1
        favour = (near - prior[best]) / np.maximum(1 - prior[best], 1e-9)
        one = shares.max(axis=1) >= _CLEAR
        remark |= one & ~alone & (given >= 10) & (favour < _FAVOUR)
        clear = one & (given > _SEEN * (given + none)) & (alone | (favour >= _FAVOUR))
        state = (np.log(shares + 0.01), np.where(remark, -1, np.where(clear, 1, 0)).astype(np.int8))
        held.destroy()
    return state


def _subjects(areas: DataFrame) -> tuple[list[str], dict[str, str], dict[str, str]]:
    """(subjects by name, subject of each spelling, title and scope words of each)."""
    rows = areas.select("subject", "title_en", "title_ko", "scope").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(rows) > MOST_SUBJECTS:
        raise ValueError(f"at most {MOST_SUBJECTS} subjects")
    spelled, said = {}, {}
    for r in rows:
        for form in (r.title_ko, r.title_en, r.subject):
            if form:
                spelled[_spelling(form)] = r.subject
        said[r.subject] = " ".join(x for x in (r.subject.replace("_", " "), r.title_en, r.title_ko, r.scope) if x)
    return sorted(said), spelled, said


def _spelling(form: str) -> str:
    return (fold_key(form) or "").replace("_", " ").replace("-", " ")


def hand_labels(labels: DataFrame, spelled: dict[str, str], key: str) -> DataFrame:
    """doc, subjects: the labels of each labelled document, in the keys of the subjects."""
    table = labels.sparkSession.createDataFrame(list(spelled.items()) or [("", None)], "form string, name string")

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _spelling(v) if v else None)

    rows = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), form(F.col("subject").cast("string")).alias("form")).join(F.broadcast(table), "form")
    return rows.where("name is not null").groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias("subjects"))


def spoken_terms(sents: DataFrame, names: list[str], said: dict[str, str], fit: np.ndarray) -> np.ndarray:
    """Fit terms by subjects: labelled documents that hold the term, shared by their labels, and titles that do."""
    at = _place(fit)
    number = {s: i for i, s in enumerate(names)}

    def count(batches):
        total = np.zeros((len(fit), len(names)))
        for batch in _few(batches):
            mine = np.zeros((batch.num_rows, len(names)))
            for d, subjects in enumerate(batch.column("subjects").to_pylist()):
                for s in subjects:
                    mine[d, number[s]] = 1 / len(subjects)
            f = flat(batch)
            row = at[f.term]
            seen = np.unique(f.of_doc[f.of_sentence[row >= 0]] * len(fit) + row[row >= 0])
            np.add.at(total, seen % len(fit), mine[seen // len(fit)])
        t, s = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(s), pa.array(total[t, s])], ["t", "s", "n"])

    total = np.zeros((len(fit), len(names)))
    for s, words in said.items():
        for w in {stem(w) for w in _words(fold(words))}:
            if (row := at[_Buckets()[w]]) >= 0:
                total[row, number[s]] += 1
    got = sents.where("subjects is not null").mapInArrow(count, "t long, s long, n double").groupBy("t", "s").agg(F.sum("n").alias("n")).toPandas()
    np.add.at(total, (got.t.to_numpy(np.int64), got.s.to_numpy(np.int64)), got.n.to_numpy())
    return total


@dataclass
class Fitted:
    names: list[str]
    sents: DataFrame | None = None
    model: np.ndarray | None = None
    fit: np.ndarray | None = None
    spoken: np.ndarray | None = None
    buckets: np.ndarray | None = None
    state: tuple | None = None


def fit_subjects(docs: DataFrame, key: str, text: str, areas: DataFrame, labels: DataFrame, topics: int = TOPICS, passes: int = PASSES, rounds: int = ROUNDS, least: int = 3) -> Fitted:
    names, spelled, said = _subjects(areas)
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null").dropDuplicates(["doc"])
    # Both sides lie by document already: no further exchange.
    sents = cut(indexed(rows.join(hand_labels(labels, spelled, key), "doc", "left")))
    n, buckets, held = document_counts(sents, least)
    word = (buckets < _HALF) & (held >= min(LEAST_DOCS, max(1, n))) & (held <= MOST_SHARE * n)
    order = np.lexsort((buckets, -held))
    fit = np.sort(buckets[order[word[order]][:FIT_TERMS]])
    if not len(fit) or not names:
        return Fitted(names)
    place = sents.sparkSession.sparkContext.broadcast(fit)

    def bag(batches):
        at = _place(place.value)
        for batch in _few(batches):
            f = flat(batch)
            row = at[f.term]
            of = f.of_doc[f.of_sentence[row >= 0]] * len(place.value) + row[row >= 0]
            pairs, count = np.unique(of, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(place.value))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("part"), lists(pairs % len(place.value)), lists(count)], ["part", "at", "n"])

    parted = sents.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(_parts(n, passes))).cast("int"))
    bags = parted.mapInArrow(bag, "part int, at array<int>, n array<int>").persist()
    model = fit_topics(bags, n, len(fit), topics, passes)
    bags.unpersist()
    spoken = spoken_terms(sents, names, said, fit)
    shares = np.zeros((len(buckets), len(names)))
    shares[np.searchsorted(buckets, fit)] = subject_shares(model, spoken)
    return Fitted(names, sents, model, fit, spoken, buckets, refine(sents, buckets, shares, rounds))


def sentence_subjects(docs: DataFrame, key: str, text: str, areas: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """key, subject, n, treating: sentences of each subject, and sentences that treat any."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    fitted = fit_subjects(docs, key, text, areas, labels, **sizes)
    if fitted.state is None:
        return spark.createDataFrame([], f"{key} {kind}, subject string, n long, treating long")
    held = spark.sparkContext.broadcast((fitted.names, fitted.buckets, *fitted.state))

    def counts(batches):
        names, buckets, logs, mark = held.value
        place, spelled = _place(buckets), pa.array(names, pa.string())
        for batch in _few(batches):
            f = flat(batch)
            sums = by_document(assign(f, place, logs, mark), f.of_doc, f.docs, len(names))
            row, subject = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(row)), spelled.take(pa.array(subject)), pa.array(sums[row, subject]), pa.array(sums.sum(axis=1)[row])], [key, "subject", "n", "treating"]
            )

    return fitted.sents.mapInArrow(counts, f"{key} {kind}, subject string, n long, treating long")


def document_subjects(docs: DataFrame, key: str, text: str, areas: DataFrame, labels: DataFrame, least: float = LEAST_SHARE, **sizes) -> DataFrame:
    """key, subject: the subjects of at least ``least`` of a document's topic proportions."""
    found = sentence_subjects(docs, key, text, areas, labels, **sizes)
    return found.where(F.col("n") >= F.col("treating") * least).select(key, "subject")


def label_agreement(found: DataFrame, key: str, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """subject, labels, agreed: hand labels of each subject, and those the documents' subjects agree with."""
    table = hand_labels(labels, _subjects(areas)[1], key).select(F.col("doc").alias(key), F.explode("subjects").alias("subject"))
    both = table.join(found.select(key, "subject", F.lit(1).alias("hit")), [key, "subject"], "left")
    return both.groupBy("subject").agg(F.count("*").alias("labels"), F.count("hit").alias("agreed"))


def topic_table(docs: DataFrame, key: str, text: str, areas: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """topic, weight, subject (null: left out), score, top_terms: the fitted topics for inspection.

    The words of the buckets are looked up in all documents, titles and scopes.
    """
    spark = docs.sparkSession
    fitted = fit_subjects(docs, key, text, areas, labels, rounds=0, **sizes)
    schema = "topic int, weight double, subject string, score double, top_terms array<string>"
    if fitted.model is None:
        return spark.createDataFrame([], schema)
    _, _, said = _subjects(areas)
    _, top = top_terms(fitted.model)
    wanted = {int(b) for b in np.unique(fitted.fit[top])}

    def name(batches):
        at = _Buckets()
        for pdf in batches:
            held = {at[w]: stem(w) for t in pdf["t"] for s in sentences(fold(t)) for w in _words(s)}
            some = [(b, w) for b, w in held.items() if b in wanted]
            yield pd.DataFrame(some, columns=["bucket", "word"])

    read = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"))
    words = dict(read.mapInPandas(name, "bucket long, word string").groupBy("bucket").agg(F.min("word")).collect())
    for w in {stem(w) for s in said.values() for w in _words(fold(s))}:
        words.setdefault(_Buckets()[w], w)
    stand, weight = map_topics(fitted.model, fitted.spoken), fitted.model.sum(axis=1) / fitted.model.sum()
    rows = []
    for k, mine in enumerate(stand):
        order = np.sort(mine)
        sure = len(order) < 2 or order[-1] >= SURE * order[-2]
        rows.append((k, float(weight[k]), fitted.names[int(mine.argmax())] if sure else None, float(mine.max()), [words.get(int(fitted.fit[t]), "?") for t in top[k]]))
    return spark.createDataFrame(rows, schema)
