"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of a text. The factors learn what pairs
of terms add beyond their weights. The machine is fitted on the driver on a bounded sample of labelled rows; terms that
tell the labels apart neither alone nor in a pair (chi-squared) have no weight, so long clean texts gather no noise. Scoring reads every whole
text once, without a shuffle, with a model of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_stored, stored, whole

#: Labelled rows that the machine is fitted on, the first in order of a hash of the id; all if fewer.
TRAIN_ROWS = 20_000
#: Hash space of terms, terms with weights, least rows with a term, least chi-squared, factors of a term.
BUCKETS, TERMS, LEAST_ROWS, LEAST_CHI2, FACTORS = 1 << 20, 4096, 5, 20.0, 8
#: The most frequent other terms, which are tried in pairs; least rows with a pair, and its least chi-squared.
PAIR_TERMS, PAIR_ROWS, PAIR_CHI2 = 1024, 20, 60.0
THRESHOLD = 0.7
#: Words of which a worker remembers the term.
MEMORY = 400_000

WORD = re.compile(r"\w+")


def term(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a text, ascending."""
    return np.unique(np.fromiter((term(w) for w in set(WORD.findall(text.lower()))), dtype=np.int32))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Machine:
    bias: float
    term: np.ndarray  # hashed terms, ascending
    weight: np.ndarray
    factor: np.ndarray

    def score(self, active: list[int]) -> float:
        """active: places of the text's terms."""
        z = self.bias
        if active:
            v = self.factor[active]
            z += self.weight[active].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(sigmoid(np.float64(z)))


def chi_squared(have: np.ndarray, both: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Of what ``have`` rows have and ``both`` of them with label 1, against n rows and ``pos`` with label 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        found = n * (both * n - have * pos) ** 2 / (have * (n - have) * pos * (n - pos))
    return np.where(have < n, np.nan_to_num(found), 0)


def telling(have: np.ndarray, both: np.ndarray, n: int, pos: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms that tell alone, and the most frequent others; ``have`` and ``both`` have a number for each term."""
    chi2 = np.where(have >= LEAST_ROWS, chi_squared(have, both, n, pos), 0)
    alone = np.flatnonzero(chi2 >= LEAST_CHI2)
    alone = alone[np.argsort(-chi2[alone], kind="stable")[:TERMS]]
    others = np.where((have >= PAIR_ROWS) & (have < n), have, 0)
    others[alone] = 0
    frequent = np.argsort(-others, kind="stable")[:PAIR_TERMS]
    return np.sort(alone), np.sort(frequent[others[frequent] > 0])


def in_pairs(frequent: np.ndarray, flat: np.ndarray, row_of: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Those of the frequent terms that tell together with another one."""
    n, pos = len(labels), int(labels.sum())
    place = np.full(BUCKETS, -1, np.int32)
    place[frequent] = np.arange(len(frequent))
    hit = place[flat] >= 0
    col, row = place[flat[hit]], row_of[hit]
    have, both = np.zeros((2, len(frequent), len(frequent)), np.float32)
    for at in range(0, n, 4096):
        part = (row >= at) & (row < at + 4096)
        x = np.zeros((min(4096, n - at), len(frequent)), np.float32)
        x[row[part] - at, col[part]] = 1
        have += x.T @ x
        toxic = x[labels[at : at + 4096] > 0]
        both += toxic.T @ toxic
    tells = (have >= PAIR_ROWS) & (chi_squared(have.astype(float), both.astype(float), n, pos) >= PAIR_CHI2)
    np.fill_diagonal(tells, False)
    return frequent[tells.any(1)]


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 400, rate: float = 0.1, l2: float = 2e-5, seed: int = 7) -> Machine:
    """Adam on the whole sample's logistic loss. One class only: the score is that class's smoothed share."""
    n, pos = len(rows), int(labels.sum())
    none = Machine(float(np.log((pos + 0.5) / (n - pos + 0.5))), np.empty(0, np.int32), np.empty(0), np.empty((0, FACTORS)))
    if not pos or pos == n:
        return none
    flat = np.concatenate(rows)
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    have = np.bincount(flat, minlength=BUCKETS).astype(float)
    both = np.bincount(flat, weights=labels[row_of], minlength=BUCKETS)
    alone, frequent = telling(have, both, n, pos)
    chosen = np.sort(np.concatenate([alone, in_pairs(frequent, flat, row_of, labels)]))
    if not len(chosen):
        return none
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    hit = place[flat] >= 0
    col, row = place[flat[hit]], row_of[hit]
    params = [np.array([none.bias]), np.zeros(len(chosen)), np.random.default_rng(seed).normal(0, 0.05, (len(chosen), FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    by_term = np.argsort(col, kind="stable")
    row_by_term = row[by_term]
    some_rows, row_starts = np.unique(row, return_index=True)  # entries lie in order of rows
    _, term_starts = np.unique(col[by_term], return_index=True)  # each chosen term has entries
    sums = np.zeros((n, FACTORS))
    for t in range(1, rounds + 1):
        b, w, v = params
        sums[some_rows] = np.add.reduceat(v[col], row_starts)
        squares = np.bincount(row, weights=(v**2).sum(1)[col], minlength=n)
        z = b[0] + np.bincount(row, weights=w[col], minlength=n) + 0.5 * ((sums**2).sum(1) - squares)
        g = (sigmoid(z) - labels) / n
        of_term = np.bincount(col, weights=g[row], minlength=len(w))
        grads = [
            np.array([g.sum()]),
            of_term + l2 * w,
            np.add.reduceat((g[:, None] * sums)[row_by_term], term_starts) - of_term[:, None] * v + 10 * l2 * v,
        ]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(params[0][0]), chosen.astype(np.int32), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """A machine from labelled rows whose crc32(id) mod 3 is not 1. Of an id's labels the largest counts; null ones don't.

    The sample's ids are at most ``rows`` longs, so their broadcast is bounded. Terms are counted on the executors; what
    comes to the driver is a count for each telling or frequent term and, of a row, its terms among those: 20 KB at most
    however long its text is. Of documents with the same id one text counts.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), 3) != 1))
    known = usable.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(terms)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), whole(F.col(f"`{text_col}`")).alias("__text")).join(F.broadcast(sample), "__id")
    one = texts.groupBy("__id", "__label").agg(F.max("__text").alias("__text"))
    found = stored(one.select("__id", "__label", hashed("__text").alias("terms")), "terms")
    n, pos = (int(x or 0) for x in found.agg(F.count(F.lit(1)), F.sum("__label")).first())
    counts = found.select("__label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("have"), F.sum("__label").alias("both"))
    counts = counts.where(F.col("have") >= LEAST_ROWS).toPandas()
    have, both = np.zeros((2, BUCKETS))
    have[counts["term"]], both[counts["term"]] = counts["have"], counts["both"]
    wanted = np.concatenate(telling(have, both, n, pos)) if 0 < pos < n else np.empty(0, np.int64)

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        asked = np.zeros(BUCKETS, bool)
        asked[wanted] = True
        return lists.map(lambda x: x[asked[x]].astype(np.int32).tobytes())

    sent = found.select("__id", "__label", packed("terms").alias("terms")).toPandas().sort_values("__id")
    drop_stored(found)
    return fit([np.frombuffer(x, np.int32) for x in sent["terms"]], sent["__label"].to_numpy(float))


def score_with(model: Machine, text: Column) -> Column:
    """The score of each whole text; null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = {int(t): i for i, t in enumerate(model.term)}
        memory: dict[str, int] = {}

        def one(text: str) -> float:
            active = set()
            for w in set(WORD.findall(text.lower())):
                p = memory.get(w)
                if p is None:
                    p = memory[w] = place.get(term(w), -1)
                if p >= 0:
                    active.add(p)
            if len(memory) > MEMORY:
                memory.clear()
            return model.score(sorted(active))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score(whole(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    A null or empty text has no terms and gets the score of the bias. Other columns, lang and source among them, are
    never read. An empty table gives an empty result; without labels every score is 0.5.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    key = F.col(f"`{id_col}`")
    scored = docs.select(key.cast("long").alias("doc_id"), (crc_mod(key, 3) == 1).alias("held_out"), score_with(model, F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold, all columns as they were."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.withColumn("__score", score_with(model, F.col(f"`{text_col}`"))).where(F.col("__score") < threshold).drop("__score")
