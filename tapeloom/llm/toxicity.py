"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the first four, five and six characters
(bytes) of longer words, which catch inflected stems, hashed to ``2**TERM_BITS`` numbers;
only presence counts. The score of a text with terms T is the logistic function of

    bias + sum of w[i] over T + sum of <v[i], v[j]> over pairs of T,

so that a pair such as an insult and a mention of a group can weigh more than both apart.
The pair sum costs one pass: half of |sum v|^2 - sum |v|^2.

Of all terms, those get weights that tell the labels apart in the training rows by themselves, with a
chi-square statistic of ``least_chi`` or more, and those that do so as part of a pair: a first machine is
fitted to the former, and of every two terms that occur in ``least_share`` of the rows or more, both are
taken if the labels of the rows that have both differ from what that machine says by a squared
z-score of ``least_pair`` or more. So a mention of a group that is as common in clean texts as in toxic
ones still counts beside an insult. No number of terms is set. Training is minibatch Adam in
one task over at most ``train_rows`` labelled documents, one row for each id, sent as lists of terms; pairs
are looked for in ``pair_rows`` of them. The driver gets the machine alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, sampled
from tapeloom.llm.words import STEP, Words, batches_of, mix

TERM_BITS = 20
THRESHOLD = 0.7


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each word and prefix, repeats included."""
    sizes = words.ends - words.starts
    shift = np.uint64(64 - TERM_BITS)
    texts, terms = [words.text], [(words.hashes() >> shift).astype(np.int64)]
    head = np.zeros(len(sizes), np.uint64)
    raw = np.concatenate([words.raw, np.zeros(8, np.uint8)])
    for k in range(6):
        head = (head + raw[words.starts + k] + np.uint64(1)) * STEP
        if k >= 3:
            longer = sizes > k + 1
            texts.append(np.compress(longer, words.text))
            terms.append((mix(np.compress(longer, head) + np.uint64(k)) >> shift).astype(np.int64))
    return np.concatenate(texts), np.concatenate(terms)


def _kept(texts: list[str], number: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs in order; with ``number``, terms become their numbers and others (-1) go."""
    words = Words(texts)
    text, term = _terms(words)
    if number is not None:
        term = number[term]
        text, term = np.compress(term >= 0, text), np.compress(term >= 0, term)
    pairs = np.unique(text << TERM_BITS | term)
    return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1)


@dataclass
class Machine:
    """``terms``: the kept terms in order; ``w`` and ``v`` by their place there."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of rows, from the pairs (row, place of a kept term)."""
        out = self.bias + np.bincount(row, self.w[term], rows)
        for factor in self.v.T:
            x = factor[term]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def scores(self, texts: list[str], number: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in batches_of(texts):
            row, term = _kept(texts[a:b], number)
            out.append(1 / (1 + np.exp(-np.clip(self.margins(row, term, b - a), -40, 40))))
        return np.concatenate(out)

    def of_terms(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows given as terms, of which those without a weight are passed over."""
        number = self.numbers()
        places = [number[x] for x in rows]
        places = [x[x >= 0] for x in places]
        row = np.repeat(np.arange(len(rows)), [len(x) for x in places])
        return 1 / (1 + np.exp(-np.clip(self.margins(row, np.concatenate([np.zeros(0, np.int64), *places]), len(rows)), -40, 40)))

    def numbers(self) -> np.ndarray:
        number = np.full(1 << TERM_BITS, -1, np.int64)
        number[self.terms] = np.arange(len(self.terms))
        return number


def train(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, *, factors: int = 4, steps: int = 2000, batch: int = 64, seed: int = 5) -> Machine:
    """Fit on rows of places of kept terms and 0/1 labels."""
    random = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    machine = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), random.normal(0, 0.01, (len(terms), factors)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (machine.w, machine.v, np.zeros(1))]
    step = 0
    for _ in range(max(8, -(-steps * batch // len(rows)))):  # small samples are gone through more often
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in chosen])
            row = np.repeat(np.arange(len(chosen)), sizes)
            term = np.concatenate([rows[i] for i in chosen]).astype(np.int64)
            error = 1 / (1 + np.exp(-np.clip(machine.margins(row, term, len(chosen)), -40, 40))) - labels[chosen]
            pull, k = error[row] / len(chosen), len(terms)
            x = machine.v[term]
            sums = np.stack([np.bincount(row, x[:, f], len(chosen)) for f in range(factors)], axis=1)
            slope_w = np.bincount(term, pull, k) + 1e-5 * machine.w
            slope_v = np.stack([np.bincount(term, pull * (sums[row, f] - x[:, f]), k) for f in range(factors)], axis=1) + 1e-4 * machine.v
            step += 1
            moves = []
            for slope, (mean, square) in zip((slope_w, slope_v, np.array([error.mean()])), state, strict=True):
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope * slope - square)
                moves.append(0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6))
            machine.w -= moves[0]
            machine.v -= 0.2 * moves[1]
            machine.bias -= float(moves[2][0])
    return machine


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pair_terms(rows: list[np.ndarray], residuals: np.ndarray, variances: np.ndarray, terms: int, least_pair: float) -> np.ndarray:
    """Terms (0 .. terms - 1) of pairs in whose rows the residuals sum up to much more than chance."""
    shown = np.zeros((len(rows), terms), np.float32)
    for i, row in enumerate(rows):
        shown[i, row] = 1
    found = np.zeros(terms, bool)
    for at in range(0, terms, 512):  # some columns of the matrix of all pairs at a time
        some = shown[:, at : at + 512]
        sums = shown.T @ (some * residuals[:, None].astype(np.float32))
        spread = shown.T @ (some * variances[:, None].astype(np.float32))
        strong = (spread >= 5) & (sums * sums >= least_pair * spread)
        strong[np.arange(at, at + some.shape[1]), np.arange(some.shape[1])] = False
        found |= strong.any(axis=1)
    return np.flatnonzero(found)


def _in_a_task(rows: DataFrame, made: Callable[[list[np.ndarray], np.ndarray], object]) -> object:
    """``made`` of (terms, labels) of rows ``doc_id, label, terms`` in order of their ids, by one task: the driver gets only the result."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches)).sort_values("doc_id")
        yield pd.DataFrame({"made": [pickle.dumps(made(frame["terms"].tolist(), frame["label"].to_numpy(np.int64)))]})

    return pickle.loads(rows.repartition(1).mapInPandas(of, "made binary").first()["made"])


def fit(
    documents: DataFrame, labels: DataFrame, *, train_rows: int = 24_000, least_chi: float = 20.0, pair_rows: int = 4_000, least_share: float = 0.03, least_pair: float = 40.0
) -> Machine | None:
    """A machine from labelled documents outside the held-out third; None without labels of both kinds or terms that tell them apart.

    Where rows share a ``doc_id``, one of them is trained on: the one whose text has the least hash.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    chosen = sampled(marked.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", train_rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most about train_rows

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts, labels = frame["text"].tolist(), frame["label"].to_numpy()
            for a, b in batches_of(texts):
                row, term = _kept(texts[a:b], None)
                split = np.split(term.astype(np.int32), np.searchsorted(row, np.arange(1, b - a)))
                yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[a:b], "label": labels[a:b], "terms": split})

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label int, terms array<int>"
    found = texts.mapInPandas(terms, schema)
    rows = cut(found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("terms", F.xxhash64("terms")).alias("terms")))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    n, ones = total["n"], total["ones"]
    if not 0 < ones < n:
        return None
    seen, marked_seen = F.col("seen"), F.col("marked")
    chi = n * (marked_seen * n - seen * ones) ** 2 / (seen * (n - seen + 1e-9) * ones * (n - ones))
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"), F.sum("label").alias("marked"))
    telling, common = (seen >= 3) & (chi >= least_chi), seen >= least_share * n
    # 2**TERM_BITS rows at most, whatever the texts.
    told = counts.filter(telling | common).select("term", telling.alias("telling"), common.alias("common")).toArrow().to_pandas().sort_values("term")

    def sent(kept: np.ndarray, of: DataFrame) -> DataFrame:
        number = np.full(1 << TERM_BITS, -1, np.int32)
        number[kept] = np.arange(len(kept))

        def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                found = [number[x] for x in frame["terms"]]
                yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "terms": [x[x >= 0] for x in found]})

        return of.mapInPandas(places, schema)

    def machine_of(kept: np.ndarray) -> Machine:
        return _in_a_task(sent(kept, rows), lambda shown, marks: train(shown, marks, kept))

    by_itself = told.loc[told["telling"], "term"].to_numpy(np.int64)
    often = told.loc[told["common"], "term"].to_numpy(np.int64)
    machine = machine_of(by_itself) if len(by_itself) else None
    every = np.union1d(by_itself, often)

    def in_pairs(some: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
        shown = [every[x] for x in some]
        share = np.full(len(shown), ones / n) if machine is None else machine.of_terms(shown)
        place = np.full(1 << TERM_BITS, -1, np.int64)
        place[often] = np.arange(len(often))
        return often[pair_terms([place[x][place[x] >= 0] for x in shown], marks - share, share * (1 - share), len(often), least_pair)]

    more = np.setdiff1d(_in_a_task(sent(every, sampled(rows, "doc_id", pair_rows)), in_pairs), by_itself)
    return machine_of(np.union1d(by_itself, more)) if len(more) else machine


def _probabilities(machine: Machine | None) -> Callable[[Column], Column]:
    if machine is None:
        return lambda text: F.lit(0.5)
    number = machine.numbers()

    @F.pandas_udf("double")
    def apply(text: pd.Series) -> pd.Series:
        return pd.Series(machine.scores(text.fillna("").tolist(), number))

    return apply


def score(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """All columns of ``documents``, then ``score`` and ``predicted``.

    Defined cases: a null or empty text has the score of no terms at all; repeated rows are scored
    each; an empty table stays empty; a column named score or predicted is replaced. Without a
    machine each score is 0.5.
    """
    scored = documents.drop("score", "predicted").withColumn("score", _probabilities(machine)(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows that ``machine`` does not reject, with their columns as they are, whatever their names."""
    return documents.filter(_probabilities(machine)(F.col("text")) < THRESHOLD)
