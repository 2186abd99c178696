"""Language of each text by a linear-chain conditional random field over its words.

Every word gets a language: its score has weights of hashed affixes and letter n-grams and of a lexicon, neighbours are
tied by learned transitions, and the forward-backward algorithm gives each word's posterior in a text that may switch
languages. The text's language is the one with the greatest mean posterior, which is also its score.

The field is fitted on the driver, on segments of a bounded sample of documents for each language; segments of several
languages are joined into switching sequences so that transitions are learned too. Prediction reads every whole text once
without a shuffle. Long texts are cut into chunks of words: transfer matrices of all chunks are computed side by side,
their products give the messages at the chunks' ends, and all chunks are then finished side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, whole

#: Documents for each language that the field is fitted on, and segments of each. They bound the sample.
TRAIN_DOCS, SEGMENTS, SEGMENT_WORDS = 500, 4, 30
BUCKETS = 1 << 16
PAD = BUCKETS
#: Letters of a word whose n-grams lie in the dense table of features; those of further letters are listed.
LONGEST = 20
#: Lexicon: words that the sample has so often and, in this share, in one language.
LEXICON_COUNT, LEXICON_SHARE = 4, 0.95
CHUNK, BATCH_WORDS = 64, 200_000
#: Words of which a worker remembers the scores.
MEMORY = 800_000
UNKNOWN = "und"
_WORD = r"\p{L}[\p{L}\p{M}]*"


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(_WORD, text.lower())


def _hashed(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full_like(parts[0], salt)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), -1).astype(np.uint64)


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Hashed features of each word, (words, features): itself, affixes of up to three letters, n-grams of two and three
    of its first LONGEST letters, and its lexicon's entry. What a word lacks is PAD, a feature without weight.
    """
    code, tail = _codes([f"^{w[: LONGEST + 1]}$" if len(w) <= LONGEST else f"^{w[: LONGEST + 1]}" for w in words], LONGEST + 2), _codes([f"^{w}$" if len(w) < 3 else f"{w[-3:]}$" for w in words], 4)
    length = np.array([len(w) + 2 for w in words])
    row = np.arange(len(words))
    itself = _hashed([code[:, i] for i in range(code.shape[1])], 1)
    for i in np.flatnonzero(length > LONGEST + 2):
        itself[i] = zlib.crc32(words[i].encode("utf-8", "surrogatepass")) % BUCKETS
    columns = [itself]
    for n in (2, 3, 4):
        have = length >= n
        columns.append(np.where(have, _hashed([code[:, i] for i in range(n)], 10 + n), PAD))
        columns.append(np.where(have, _hashed([tail[row, np.maximum(np.minimum(length, 4) - n + i, 0)] for i in range(n)], 20 + n), PAD))
    for n in (2, 3):
        place = np.arange(1, code.shape[1] - n)
        grams = _hashed([code[:, 1 + i : code.shape[1] - n + i] for i in range(n)], 30 + n)
        columns += list(np.where(place[None, :] + n < length[:, None], grams, PAD).T)
    columns.append(np.array([BUCKETS + 1 + e if (e := lexicon.get(w)) is not None else PAD for w in words]))
    return np.stack(columns, 1)


def further(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that reach beyond the first LONGEST letters: places of words and features, one for each n-gram."""
    long = [i for i, w in enumerate(words) if len(w) > LONGEST]
    if not long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(words[i]) for i in long])
    code = _codes(list("".join(words[i] for i in long)), 1)[:, 0]
    inside = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word, left = np.repeat(np.array(long), sizes), np.repeat(sizes, sizes) - inside
    found = []
    for n in (2, 3):
        at = np.flatnonzero((left >= n) & (inside + n > LONGEST))
        found.append((word[at], _hashed([code[at + i] for i in range(n)], 30 + n)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass
class Field:
    langs: list[str]
    lexicon: dict[str, int]
    weight: np.ndarray  # (BUCKETS + 1 + languages, languages)
    transition: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Unary scores of the words, (words, languages)."""
        out = np.empty((len(words), self.weight.shape[1]), np.float32)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            out[at : at + 20_000] = self.weight[features(part, self.lexicon)].sum(1)
            word, feature = further(part)
            if len(word):
                for c in range(out.shape[1]):
                    out[at : at + 20_000, c] += np.bincount(word, weights=self.weight[feature, c], minlength=len(part))
        return out


def _messages(unary: np.ndarray, mask: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of sequences (n, length, k) side by side; masked places pass messages on."""
    n, length, k = unary.shape
    forward, backward = np.empty_like(unary), np.empty_like(unary)
    a, b = start, end
    for t in range(length):
        x = (a @ step) * unary[:, t]
        a = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), a)
        forward[:, t] = a
    for t in range(length - 1, -1, -1):
        backward[:, t] = b
        x = (unary[:, t] * b) @ step.T
        b = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), b)
    return forward, backward


def posteriors(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Posterior of each word, for texts of lengths >= 1 whose words' scores follow one another."""
    k, step = scores.shape[1], np.exp(transition - transition.max())
    unary = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12
    chunks = -(-lengths // chunk)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    inside = np.arange(len(scores)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    row, col = np.repeat(first, lengths) + inside // chunk, inside % chunk
    dense, mask = np.ones((chunks.sum(), chunk, k)), np.zeros((chunks.sum(), chunk), bool)
    dense[row, col], mask[row, col] = unary, True
    start, end = np.full((len(dense), k), 1 / k), np.full((len(dense), k), 1 / k)
    if chunks.max() > 1:
        long = np.flatnonzero(np.repeat(chunks, chunks) > 1)
        move = np.tile(np.eye(k), (len(long), 1, 1))
        for t in range(chunk):
            x = (move @ step) * dense[long, t][:, None, :]
            move = np.where(mask[long, t, None, None], x / x.max((1, 2), keepdims=True), move)
        of = np.full(len(dense), -1)
        of[long] = np.arange(len(long))
        for j in range(1, chunks.max()):
            at = first[chunks > j] + j
            x = np.einsum("ni,nij->nj", start[at - 1], move[of[at - 1]])
            start[at] = x / x.sum(1, keepdims=True)
            texts = chunks > j
            at = first[texts] + chunks[texts] - j
            x = np.einsum("nij,nj->ni", move[of[at]], end[at])
            end[at - 1] = x / x.sum(1, keepdims=True)
    forward, backward = _messages(dense, mask, step, start, end)
    both = forward[row, col] * backward[row, col]
    return both / both.sum(1, keepdims=True)


def fit(segments: list[tuple[int, list[str]]], langs: list[str], rounds: int = 40, rate: float = 0.2, l2: float = 1e-6, seed: int = 3) -> Field:
    """segments: (language, words). Adam on the mean log-likelihood of sequences of four segments, half of them switching."""
    k = len(langs)
    counts: dict[str, np.ndarray] = {}
    for lang, words in segments:
        for w in words:
            counts.setdefault(w, np.zeros(k))[lang] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= LEXICON_COUNT and c.max() >= LEXICON_SHARE * c.sum()}
    names = sorted(counts)
    number = {w: i for i, w in enumerate(names)}
    flat = features(names, lexicon)
    used = flat[:, (flat != PAD).any(0)]
    more_word, more_feature = further(names)
    rng = np.random.default_rng(seed)
    order = [segments[i] for i in rng.permutation(len(segments))]
    half = len(order) // 2
    order[:half] = sorted(order[:half], key=lambda s: s[0])
    sequences = [order[i : i + 4] for i in range(0, len(order), 4)]
    length = max(sum(len(w) for _, w in s) for s in sequences)
    words, gold, mask = (np.zeros((len(sequences), length), t) for t in (np.int64, np.int64, bool))
    for i, s in enumerate(sequences):
        ids = [number[w] for _, ws in s for w in ws]
        words[i, : len(ids)], gold[i, : len(ids)], mask[i, : len(ids)] = ids, [lang for lang, ws in s for _ in ws], True
    total = mask.sum()
    target = np.zeros((*words.shape, k))
    target[np.arange(len(words))[:, None], np.arange(length)[None, :], gold] = 1
    params = [np.zeros((BUCKETS + 1 + k, k)), np.eye(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pairs = np.zeros((k, k))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    uniform = np.full((len(words), k), 1 / k)
    for t in range(1, rounds + 1):
        weight, transition = params
        unary = sum(weight[column] for column in used.T)
        if len(more_word):
            unary = unary + np.stack([np.bincount(more_word, weights=weight[more_feature, c], minlength=len(names)) for c in range(k)], 1)
        unary = unary[words]
        unary = np.exp(unary - unary.max(2, keepdims=True)) + 1e-12
        step = np.exp(transition - transition.max())
        forward, backward = _messages(unary, mask, step, uniform, uniform)
        post = forward * backward
        post /= post.sum(2, keepdims=True)
        error = ((post - target) * mask[:, :, None]).reshape(-1, k)
        by_word = np.stack([np.bincount(words.ravel(), weights=error[:, c], minlength=len(names)) for c in range(k)], 1)
        grad = sum(np.stack([np.bincount(column, weights=by_word[:, c], minlength=len(weight)) for c in range(k)], 1) for column in used.T)
        if len(more_word):
            grad = grad + np.stack([np.bincount(more_feature, weights=by_word[more_word, c], minlength=len(weight)) for c in range(k)], 1)
        grad[PAD] = 0
        joint = forward[:, :-1, :, None] * step * (unary[:, 1:] * backward[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        expected = joint[both].sum(0)
        for i, g in enumerate((grad / total + l2 * weight, (expected - pairs) / total + l2 * transition)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-10)
    return Field(langs, lexicon, params[0].astype(np.float32), params[1])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Field | None:
    """A field from documents with a language whose crc32(id) mod 4 is not 2; None without any.

    For each language about ``most`` documents are taken by a hash of id and text, all if fewer, and of each up to
    SEGMENTS segments spread over the whole text, so the driver gets a bounded number of words.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    usable = docs.where(text.isNotNull() & lang.isNotNull() & (crc_mod(F.col(f"`{id_col}`"), 4) != 2))
    usable = usable.select(lang.alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(1_000_003)).alias("draw"))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, most / r["count"]) * 1_000_003))])

    @F.pandas_udf("array<string>")
    def segments(texts: pd.Series) -> pd.Series:
        def some(text: str) -> list[str]:
            words = words_of(text)
            parts = max(1, min(SEGMENTS, len(words) // SEGMENT_WORDS))
            starts = [round(i * max(0, len(words) - SEGMENT_WORDS) / max(1, parts - 1)) for i in range(parts)]
            return [" ".join(words[s : s + SEGMENT_WORDS]) for s in starts]

        return texts.map(some)

    sample = usable.where(F.col("draw") < share[F.col("lang")]).orderBy("draw", "lang").limit(2 * most * len(sizes))
    rows = sample.select("lang", segments("text").alias("segments")).toPandas()
    langs = sorted(set(rows["lang"]))
    found = [(langs.index(lang), s.split()) for lang, parts in zip(rows["lang"], rows["segments"], strict=True) for s in parts if s]
    return fit(sorted(found), langs) if found else None


def predict_with(field: Field | None, text: Column) -> Column:
    """struct(lang_pred, score) of each whole text; ``und`` and 0 for null and for texts without a letter."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        class Memory(dict):
            """Place of each word's scores in the table; new ones are noted."""

            new: list[str] = []

            def __missing__(self, word: str) -> int:
                self.new.append(word)
                self[word] = n = len(self)
                return n

        memory, table = Memory(), np.zeros((1024, len(field.langs) if field else 1), np.float32)

        def scores_of(words: list[str]) -> np.ndarray:
            nonlocal table
            ids = np.fromiter(map(memory.__getitem__, words), dtype=np.int64, count=len(words))
            if memory.new:
                while len(memory) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[len(memory) - len(memory.new) : len(memory)] = field.scores(memory.new)
                memory.new.clear()
            return table[ids].astype(np.float64)

        def some(texts: list[str]) -> list[tuple[str, float]]:
            split = [words_of(t) for t in texts]
            out = [(UNKNOWN, 0.0)] * len(texts)
            full = [i for i, w in enumerate(split) if w]
            if field and full:
                if len(memory) > MEMORY:
                    memory.clear()
                lengths = np.array([len(split[i]) for i in full])
                post = posteriors(scores_of([w for i in full for w in split[i]]), lengths, field.transition)
                mean = np.add.reduceat(post, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
                for i, m in zip(full, mean, strict=True):
                    out[i] = (field.langs[int(m.argmax())], float(min(1.0, m.max())))
            return out

        for texts in batches:
            found, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size > BATCH_WORDS * 6:
                    found += some(held)
                    held, size = [], 0
            found += some(held)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(whole(text))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when there is nothing to learn
    from. The language, source and id are never inputs of a prediction. An empty table gives an empty result.
    """
    field = train(docs, id_col, text_col, lang_col)
    key = F.col(f"`{id_col}`")
    out = docs.select(key.cast("long").alias("doc_id"), (crc_mod(key, 4) == 2).alias("held_out"), predict_with(field, F.col(f"`{text_col}`")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
