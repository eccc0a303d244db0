"""Toxicity scores from a subsequence-kernel support vector machine with Nystrom landmarks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from .vocabulary import WordVectors, small_batches

#: The kernel counts common subsequences of three characters within ``SPAN`` positions; each
#: character inside the span that is left out costs a factor ``DECAY``. Its cosine is
#: raised to ``POWER``.
SPAN, DECAY, POWER = 7, 0.6, 3
#: Subsequences are hashed to so many features.
FEATURES = 1 << 20
LANDMARKS, CANDIDATES, GRAMS = 120, 600, 300
#: Sentences, as a share of toxic documents, that an n-gram must be in at least to tell them apart.
LEAST_SHARE = 0.02
#: About so many documents of each class, and sentences of each class, are learned from.
PER_CLASS, SENTENCES = 2000, 5_000
#: Tokens whose kernel values are computed at once.
TOKENS = 4_000
#: Margins beyond this are taken as sure; rounds of picking the telling token of a sentence.
MARGIN, ROUNDS = 6.0, 3
#: Characters that may be put into an insult; copies with one of them are learned from too.
FILLERS = "xqj170"
#: The highest sentences of a text that decide together.
TOP = 3
#: A run of single characters with single spaces is one token ("i d i o t").
tokens_of = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)|\S+|\n").findall
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def subsequences(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, feature, weight) of every subsequence; weights of a token are scaled to unit length.

    Only letters and digits of a token count; a mark before them lets subsequences tell its beginning.
    """
    plain = ["^" + "".join(filter(str.isalnum, t)).lower() for t in tokens]
    joined = ("\0" * SPAN).join(plain) + "\0" * SPAN
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(tokens)), np.array([len(t) + SPAN for t in plain], np.int64))
    n = len(codes) - SPAN
    found = []
    for a, b in _STEPS:
        x, y, z = codes[:n], codes[a : n + a], codes[b : n + b]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        key = ((x[at] * 1_000_003 + y[at]) * 1_000_003 + z[at]) * 0x9E3779B1
        found.append((owner[at], (key >> 12) % FEATURES, np.full(len(at), DECAY ** (b - 2))))
    token, feature, weight = (np.concatenate(c) for c in zip(*found))
    length = np.sqrt(np.bincount(token, weight**2, len(tokens)))
    return token, feature, weight / np.maximum(length[token], 1e-9)


def ends_sentence(token: str) -> bool:
    return token == "\n" or token[-1] in ".!?"


def sentences_of(tokens: list[str]) -> Iterator[list[str]]:
    """Tokens of each sentence; a sentence ends after ``. ! ?`` at a token's end and at line breaks."""
    start = 0
    for i, t in enumerate(tokens):
        if ends_sentence(t):
            yield tokens[start : i + 1]
            start = i + 1
    if start < len(tokens):
        yield tokens[start:]


class Landmarks:
    """Kernel values of tokens with the landmark tokens."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        owner, feature, weight = subsequences(tokens)
        # Few landmarks have a feature: (landmark, weight) entries of the features stand one after the other.
        both, place = np.unique(feature * len(tokens) + owner, return_inverse=True)
        self.mark, self.value = both % len(tokens), np.bincount(place, weight)
        used, self.first, self.many = np.unique(both // len(tokens), return_index=True, return_counts=True)
        self.row = np.full(FEATURES, -1, np.int32)
        self.row[used] = np.arange(len(used))

    def kernel(self, tokens: list[str]) -> np.ndarray:
        """Kernel value (a power of the cosine of subsequences) of each token with each landmark."""
        marks = len(self.tokens)
        out = np.zeros((len(tokens), marks), np.float32)
        for start in range(0, len(tokens), TOKENS):
            some = tokens[start : start + TOKENS]
            owner, feature, weight = subsequences(some)
            row = self.row[feature]
            hit = np.flatnonzero(row >= 0)
            many = self.many[row[hit]]
            entry = np.repeat(self.first[row[hit]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cell = np.repeat(owner[hit] * marks, many) + self.mark[entry]
            out[start : start + len(some)] = np.bincount(cell, np.repeat(weight[hit], many) * self.value[entry], len(some) * marks).reshape(-1, marks)
        return out**POWER


@dataclass
class ToxicityModel:
    """Landmarks and a weight for each, all that scoring needs of the machine.

    f(sentence) is the highest token plus the bias; the ``TOP`` highest sentences of a text, by a
    logistic curve, give a probability.
    """

    marks: Landmarks
    weights: np.ndarray
    bias: float
    slopes: np.ndarray = field(default_factory=lambda: np.ones(TOP))
    shift: float = 0.0
    vectors: WordVectors | None = field(default=None, compare=False)

    def _compute(self, words: list[str]) -> np.ndarray:
        score = self.marks.kernel(words) @ self.weights
        return np.stack([score, [ends_sentence(w) for w in words]], 1)

    def margins(self, texts: list[str]) -> np.ndarray:
        """f of the highest sentences of each text, in falling order; missing ones have the bias."""
        if self.vectors is None:
            self.vectors = WordVectors(self._compute, 2)
        out = np.zeros((len(texts), TOP))
        n = 0
        for batch in small_batches(texts):
            found, rows = self.vectors.lookup([tokens_of(t) for t in batch])
            for at in found:
                if len(at):
                    got = rows[at]
                    starts = np.concatenate([[0], np.flatnonzero(got[:-1, 1]) + 1])
                    best = np.sort(np.maximum.reduceat(got[:, 0], starts))[::-1][:TOP]
                    out[n, : len(best)] = best
                n += 1
        return np.clip(out + self.bias, -MARGIN, MARGIN)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ self.slopes + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss on weighted rows, by Newton steps on the active ones."""
    wide = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    ridge = penalty * np.eye(wide.shape[1])
    w = np.zeros(wide.shape[1])
    for _ in range(steps):
        inside = y * (wide @ w) < 1
        if not inside.any():
            break
        some = wide[inside].astype(float)
        part = some * weight[inside, None]
        new = np.linalg.solve(part.T @ some + ridge, part.T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none negative) and shift of P(label 1), lightly regularised, by Newton steps."""
    used = list(range(x.shape[1]))
    while True:
        wide, w = np.concatenate([x[:, used], np.ones((len(x), 1))], 1), np.zeros(len(used) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
            hess = (wide * (p * (1 - p))[:, None]).T @ wide + 1e-2 * np.eye(len(w))
            w -= np.linalg.solve(hess, wide.T @ (p - y) + 1e-2 * w)
        bad = [u for u, v in zip(used, w) if v < 0]
        if not bad or len(used) == 1:
            slopes = np.zeros(x.shape[1])
            slopes[used] = np.maximum(w[:-1], 1e-3)
            return slopes, float(w[-1])
        used = [u for u in used if u not in bad] or [0]


def _grams(token: str) -> set[str]:
    marked = "^" + token
    return {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel | None:
    """Learn from ``text`` (docs) and ``toxic`` (labels, 0 or 1), joined by doc_id.

    About ``per_class`` labelled documents of each class are drawn by a hash of doc_id, evenly
    over all rows; what follows is counted by Spark over that sample. Character n-grams that set
    toxic documents apart mark the sentences of toxic documents that stand for label 1; sentences
    of clean documents stand for label 0, other sentences of toxic documents for nothing (the
    label is the document's). Landmarks are picked from tokens with such n-grams and common
    tokens, each the least explained by those before (pivoted Cholesky). A support vector machine
    over Nystrom features is fitted to the sentences, a sentence speaking through its highest
    token, which is picked again in each round. Copies of the telling tokens, and of others, with
    filler characters put in teach it to see through them. At last the
    highest sentences of a document are turned into a probability.

    Null labels are left out, repeated pairs count once, and a document with both labels counts
    as toxic. None is returned if a class has no documents or nothing sets them apart.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    limit = F.when(F.col("toxic") == 1, per_class / sizes[1] * 1e6).otherwise(per_class / sizes[0] * 1e6)
    chosen = marked.where(part < limit)  # about 2 * per_class rows of two numbers, whatever the table's size
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample = sample.select(F.xxhash64("text").alias("_h"), "text", "toxic").dropDuplicates(["_h"])
    sample = write_table(sample.select("text", "toxic"), "toxicity-sample").repartition(24)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ys = [], []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for sentence in sentences_of(tokens_of(text.lower())):
                    tokens = sorted(set(sentence) - {"\n"})
                    parts = [tokens[start : start + 64] for start in range(0, len(tokens), 64)]
                    rows += parts
                    ys += [toxic] * len(parts)
            yield pa.RecordBatch.from_pydict({"tokens": pa.array(rows, pa.list_(pa.string())), "y": pa.array(ys, pa.int32())})

    # Sentences that copies share count once, and as clean if a clean document has them.
    sentences = sample.mapInArrow(cut, "tokens array<string>, y int").groupBy("tokens").agg(F.min("y").alias("y"))
    sentences = write_table(sentences, "toxicity-sentences")
    held = {r["y"]: r["count"] for r in sentences.groupBy("y").count().collect()}
    if len(held) < 2:
        return None

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for tokens, y in zip(batch["tokens"].to_pylist(), batch["y"].to_pylist()):
                counts[y].update(set().union(*map(_grams, tokens)))
            keys = [k for k in counts[0].keys() | counts[1].keys() if counts[1][k] or counts[0][k] > 1]
            yield pa.RecordBatch.from_pydict(
                {
                    "gram": pa.array(keys, pa.string()),
                    "bad": pa.array([counts[1][k] for k in keys], pa.int64()),
                    "good": pa.array([counts[0][k] for k in keys], pa.int64()),
                }
            )

    grams = sentences.mapInArrow(gram_counts, "gram string, bad long, good long")
    grams = grams.groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    bad, good = F.col("bad") / held[1], F.col("good") / held[0]
    apart = (bad - good) / F.sqrt(bad + good)
    telling = grams.where((bad > 8 * good) & (F.col("bad") >= max(3, LEAST_SHARE * totals[1])))
    seeds = {r["gram"]: float(r["a"]) for r in telling.select("gram", apart.alias("a")).orderBy(F.desc("a"), "gram").limit(GRAMS).collect()}
    if not seeds:
        return None

    def told(token: str) -> float:
        """How telling a token is: its n-grams that are seeds."""
        return sum(seeds.get(g, 0.0) for g in _grams(token))

    least = 2 * min(seeds.values())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not y or any(told(t) >= least for t in tokens) for tokens, y in zip(batch["tokens"].to_pylist(), batch["y"].to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = write_table(sentences.mapInArrow(kept, "tokens array<string>, y int"), "toxicity-telling")
    held = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    if len(held) < 2:
        return None
    share = F.when(F.col("y") == 1, SENTENCES / held[1] * 1e6).otherwise(SENTENCES / held[0] * 1e6)
    rows = found.where(F.pmod(F.xxhash64("tokens"), F.lit(1_000_000)) < share).toArrow()
    model = _fit(list(zip(rows["tokens"].to_pylist(), rows["y"].to_pylist())), told, least)
    if model is None:
        return None

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.vectors = None
        for batch in batches:
            m = pa.array(list(model.margins(batch["text"].to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"m": m, "y": batch["toxic"]})

    done = sample.mapInArrow(margins, "m array<double>, y int").toArrow()
    model.slopes, model.shift = _logistic(np.array(done["m"].to_pylist()), done["y"].to_numpy())
    model.vectors = None
    return model


def _filled(tokens: list[str]) -> list[str]:
    """Each token with one filler character at a place that depends on the token."""
    out = []
    for t in tokens:
        u = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        at = 1 + u % max(len(t) - 1, 1)
        out.append(t[:at] + FILLERS[(u >> 8) % len(FILLERS)] + t[at:])
    return out


def _fit(sentences: list[tuple[list[str], int]], told, least: float) -> ToxicityModel | None:
    """The machine for sentences (lists of distinct tokens) with labels."""
    good = sorted({t for tokens, y in sentences if not y for t in tokens})
    bad = [tokens for tokens, y in sentences if y]
    if not good or not bad:
        return None
    often = Counter(max(tokens, key=lambda t: (told(t), t)) for tokens in bad)
    common = Counter(t for tokens, y in sentences if not y for t in tokens)
    first = lambda counted: [t for t, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: CANDIDATES // 2]]
    marks = Landmarks(_spread(first(often), LANDMARKS * 2 // 3) + _spread(first(common), LANDMARKS // 3))
    values, vectors = np.linalg.eigh(marks.kernel(marks.tokens).astype(float))
    half = vectors / np.sqrt(np.maximum(values, 1e-2))  # Nystrom: the features are kernel values @ half
    features = lambda tokens: marks.kernel(tokens) @ half.astype(np.float32)
    clean = np.concatenate([features(good), features(_filled(good[::4]))])
    pool = sorted({t for tokens in bad for t in tokens})
    place = {t: i for i, t in enumerate(pool)}
    at = [np.array([place[t] for t in tokens]) for tokens in bad]
    mine = features(pool)
    picked = np.array([place[max(tokens, key=lambda t: (told(t), t))] for tokens in bad])
    for _ in range(ROUNDS):
        chosen = np.unique(picked)
        weight = np.bincount(picked, minlength=len(pool))[chosen]
        x = np.concatenate([mine[chosen], features(_filled([pool[i] for i in chosen])), clean])
        y = np.concatenate([np.ones(2 * len(chosen)), -np.ones(len(clean))])
        # Half of the weight for how often a token tells, half for each of them alike.
        w = weight / weight.sum() + 1 / len(chosen)
        w, bias = _svm(x, y, np.concatenate([w, w, np.ones(len(clean)) * 4 / len(clean)]) / 8)
        score = mine @ w
        picked = np.array([i[np.argmax(score[i])] for i in at])
    return ToxicityModel(marks, half @ w, bias)


def _spread(tokens: list[str], n: int) -> list[str]:
    """The n tokens that explain most: pivoted Cholesky of their kernel matrix, ties to the earlier."""
    if len(tokens) <= n:
        return tokens
    kernel = Landmarks(tokens).kernel(tokens).astype(float)
    left, rows, picked = np.diag(kernel).copy(), [], []
    # Tokens come by frequency; a mild preference for it keeps odd ones from crowding in.
    taste = 1 / (1 + np.arange(len(tokens)) / len(tokens))
    for _ in range(n):
        i = int(np.argmax(left * taste))
        if left[i] < 1e-6:
            break
        row = (kernel[i] - sum((r[i] * r for r in rows), np.zeros(len(tokens)))) / np.sqrt(left[i])
        rows.append(row)
        picked.append(i)
        left = np.maximum(left - row**2, 0)
        left[i] = 0
    return [tokens[i] for i in picked]


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Probability of label 1 for each text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model.vectors = None
        for texts in batches:
            yield pa.array(model.scores([x.as_py() or "" for x in texts]))

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Only the text is an input.

    A text scores by its worst sentence, wherever it stands, and a sentence by its worst token.
    Null and empty texts score like a sentence without tokens; without a model all score 0. Repeated rows get equal scores. Nothing
    is shuffled; words are scored once in each Python worker (``CACHE_WORDS``).
    """
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    return docs.withColumn("score", toxicity(F.col("text"), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
