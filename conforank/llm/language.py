"""Language identification by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import attach, pin, write_table
from .vocabulary import WordVectors, small_batches

#: Character n-grams of words, with a mark at both ends, fall into so many buckets.
BUCKETS, SIZES, SMOOTHING = 1 << 16, (1, 2, 3, 4), 0.5
#: Margins of the binary classifiers are log odds of a whole text; beyond this they are taken as sure.
SURE = 12.0
#: Ambiguous if the runner-up's loss is nearer than this.
AMBIGUOUS = 0.5
words_of = re.compile(r"[^\W\d_]+").findall


def codewords(n: int) -> np.ndarray:
    """A +1/-1 matrix of n codewords: every split of the classes for up to 7, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    rng, best, found = np.random.default_rng(0), -1, None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        near = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if near > best:
            best, found = near, code
    return found


def _buckets(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """languages, their codewords, and for each bit the log odds of every bucket and a loss weight."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    vectors: WordVectors | None = field(default=None, compare=False)

    def _compute(self, words: list[str]) -> np.ndarray:
        grams = [_buckets(w) for w in words]
        starts = np.cumsum([0, *map(len, grams[:-1])])
        return np.add.reduceat(self.weights[np.fromiter(itertools.chain.from_iterable(grams), np.int64)], starts, axis=0)

    def margins(self, texts: list[str]) -> np.ndarray:
        """Log odds of every bit for each text: sums over its n-grams."""
        if self.vectors is None:
            self.vectors = WordVectors(self._compute, self.weights.shape[1])
        out = [np.zeros((0, self.weights.shape[1]))]
        for batch in small_batches(texts):
            found, rows = self.vectors.lookup([words_of(t.lower()) for t in batch])
            out.append(np.array([rows[i].sum(0, dtype=np.float64) if len(i) else np.zeros(rows.shape[1]) for i in found]))
        return np.concatenate(out)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss, its share of exp(-loss), and whether another is as near."""
        sure = np.clip(margins, -SURE, SURE)
        losses = (np.logaddexp(0, -sure[:, None, :] * self.code[None]) * self.trust).sum(-1)
        share = np.exp(losses.min(1, keepdims=True) - losses)
        share /= share.sum(1, keepdims=True)
        best = losses.argmin(1)
        near = np.sort(losses, 1)
        close = near[:, 1] - near[:, 0] < AMBIGUOUS if losses.shape[1] > 1 else np.zeros(len(losses), bool)
        return best, share[np.arange(len(best)), best], close


def train_language(docs: DataFrame, per_language: int = 3000) -> LanguageModel | None:
    """Fit on ``text`` and ``lang`` of about ``per_language`` documents of each language.

    The sample is taken by a hash of doc_id and text, evenly over all rows. Executors count
    n-gram buckets; at most languages x buckets counts reach the driver. Rows with null lang
    or text are left out; None is returned if nothing is left.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("_u")
    )
    sizes = known.groupBy("lang").count()
    share, fits = pin(sizes.select("lang", (F.lit(per_language) / F.col("count") * 1_000_000).alias("_share")), 64, "language-sizes")
    sample = attach(known, share, ["lang"], fits, ["text"]).where(F.col("_u") < F.col("_share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
            for lang, counted in words.items():
                total = np.zeros(BUCKETS)
                for word, n in counted.items():
                    np.add.at(total, _buckets(word), n)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int64()), "n": pa.array(total[used].astype(np.int64))}
                )

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = write_table(counts, "language-counts").toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return None
    place = {x: i for i, x in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), 0.0)
    table[[place[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    # Languages weigh the same however many texts they have.
    table = table / np.maximum(table.sum(1, keepdims=True), 1) * 1e6
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    trust = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        ones, others = (table[code[:, b] == s].sum(0) + SMOOTHING for s in (1, -1))
        if len(languages) > 1:
            odds = np.log(ones / ones.sum()) - np.log(others / others.sum())
            weights[:, b] = odds
            # Bits whose sides differ more decide more: mean log odds in favour of the right side.
            trust[b] = (ones / ones.sum() * odds).sum() + (-others / others.sum() * odds).sum()
    trust *= len(trust) / trust.sum() if trust.sum() > 0 else 1.0
    return LanguageModel(languages, code, weights, trust)


def predicted(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred, score and ambiguous for each text."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model.vectors = None
        for texts in batches:
            values = [x.as_py() or "" for x in texts]
            best, score, close = model.decode(model.margins(values))
            lettered = [any(map(str.isalpha, t)) for t in values]
            langs = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
            score = np.where(lettered, score, 0.0)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(score), pa.array(np.where(lettered, close, True))],
                ["lang_pred", "score", "ambiguous"],
            )

    return predict(text)


def identify_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous`` (another codeword is about as near).

    Only the text is an input. Null texts and texts without a letter are ``und`` with score 0;
    so is every text if there was nothing to learn from. Repeated rows get equal results; whole
    texts are read, in batches of words, and nothing is shuffled.
    """
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    out = docs.withColumn("_language", predicted(F.col("text"), model))
    out = out.withColumns({c: F.col("_language").getField(c) for c in ("lang_pred", "score", "ambiguous")})
    return out.drop("_language")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text is a multiple of five; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
