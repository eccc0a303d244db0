"""Learned operators by held-out accuracy, tokenizers against their libraries, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

pytest.importorskip("conforank.llm")

from pyspark.sql import functions as F

import corpus_pipeline
from conforank.llm import language, pieces, token_count, toxicity
from conforank.llm.queries import REGISTRY
from test_text_operators import frame, odd_rows

ODD = list("abcABC'sdtm 019  \n\t\x0b\x0c\r\x1c\x85\xa0ÉéÏßΣσς日本İıǅ½²٣é̇.,!?-_#$ﬁ😀​　́Å") + ["the", "ing", "<|endoftext|>", "<s>", "<0x0A>", " " * 13]


def fuzz(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "ab" * 3000, " " * 70]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = fuzz(3000)
    count = token_count.text_counter(path)
    want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [count(t) for t in texts] == want
    rows = odd_rows()
    got = token_count.count_tokens(frame(spark, rows), path, 20).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "").encode()), count(t), count(t) > 20) for _, t in rows)
    assert token_count.count_tokens(frame(spark, rows).limit(0), path).count() == 0


def test_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in fuzz(3000)] + [" " * n + "x" for n in range(40)]
    coder = pieces.codec(path)
    got = [np.frombuffer(x, np.int32).tolist() for x in coder.encode(texts)]
    assert got == library.encode(texts)
    assert [coder.decode(np.array(x, int)) for x in got] == [library.decode(x) for x in got] == texts
    rows = odd_rows()
    out = pieces.encode_pieces(frame(spark, rows).withColumn("n_tokens", F.lit("clash")), path)
    out = out.withColumn("back", pieces.decoded(F.col("ids"), path))
    have = out.collect()
    assert sorted((repr(r.doc_id), r.back) for r in have) == sorted((repr(i), t or "") for i, t in rows)
    assert all(r.n_tokens == len(r.ids) for r in have)
    assert pieces.encode_pieces(frame(spark, rows).limit(0), path).count() == 0


def test_pieces_query_decodes(spark, sf, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [*odd_rows(), (200, "a▁b"), *((300 + i, t) for i, t in enumerate(fuzz(200)))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = REGISTRY["op8_sentencepiece"][0](spark, str(tmp_path)).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.decoded_sha256) for r in got) == sorted((repr(i), sha((t or "").replace("▁", " "))) for i, t in rows)
    assert all(r.decoded_sha256 == sha(library.decode(r.ids)) and r.n_tokens == len(r.ids) for r in got)
    assert [r.doc_id for r in got if not r.round_trip] == [200]
    assert all(r.round_trip for r in REGISTRY["op8_sentencepiece"][0](spark, sf).collect())
    # Identifiers that no text has: broken bytes, control pieces, slices of a batch.
    coder = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    strange = [None, [], [1, 2], [coder.bytes[200]], [coder.bytes[226], coder.ids["▁the"]], [0, coder.ids["▁"]]]
    want = [coder.decode(np.array(x or [], int)) for x in strange]
    lists = pa.array(strange, pa.list_(pa.int32()))
    assert coder.decode_batch(lists) == want and coder.decode_batch(lists[2:]) == want[2:] and coder.decode_batch(lists[:2]) == want[:2]


def test_pieces_stay_apart_without_merging(monkeypatch):
    coder = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(2)
    names = [p for p in coder.normal if p.strip("▁")]
    short = [p for p in names if len(p) <= 3]
    pairs = [tuple(rnd.choices(names, k=2)) for _ in range(2000)] + [tuple(rnd.choices(short, k=2)) for _ in range(2000)]
    pairs += [(p[:i], p[i:]) for p in rnd.sample(names, 1000) for i in range(1, len(p)) if p[:i] in coder.ids and p[i:] in coder.ids and p[:i] != "▁"]
    pairs += [(p, p) for p in short] + [("▁", "a"), ("▁▁", "the"), ("▁", "▁"), ("a", "▁▁")]
    want = [coder.merge(a + b) == [a, b] for a, b in pairs]
    assert [coder.apart(coder.ids[a], coder.ids[b]) for a, b in pairs] == want and 500 < sum(want) < len(want) - 500
    coder.pairs.clear()
    monkeypatch.setattr(coder, "merge", None)  # a pair that was not met before needs no merges where its pieces were
    assert [coder.apart(coder.ids[a], coder.ids[b]) for a, b in pairs[:-4]] == want[:-4]


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("held", language.held_out(F.col("doc_id")))
    model = language.train_language(docs.where("NOT held"), per_language=200)
    out = language.identify_language(docs.where("held"), model)
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98
    rows = [(1, None), (2, ""), (3, "123 ?!"), (3, "123 ?!"), (4, "the and of " * 50_000)]
    got = sorted((r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language.identify_language(frame(spark, rows), model).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (3, "und", True), (4, "en", True)]
    assert language.train_language(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify_language(frame(spark, rows), None).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("thaernoidsl") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    insults = ["moron", "idiot", "scumbag", "worthless"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "."]) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(insults)
        rows.append((i, " ".join(words)))
        labels += [(i, int(i % 4 == 0))] * (1 + (i == 8))
    table = spark.createDataFrame([*labels, (999, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(frame(spark, rows[:300]), table.where("doc_id < 300 OR doc_id IS NULL"))
    scores = model.scores([t for _, t in rows])
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for (i, _), s in zip(rows[300:], scores[300:])]) > 0.95
    clean = re.sub(r"\.", "", rows[1][1])
    plain, dotted, spaced = (model.scores([f"{clean} {x} {x} {x}"])[0] for x in ("moron", "m.o.r.o.n", "m o r o n"))
    assert plain == dotted == spaced > model.scores([clean])[0]
    odd = toxicity.score_toxicity(frame(spark, odd_rows()), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd) and len(odd) == len(odd_rows())
    assert toxicity.train_toxicity(frame(spark, rows), table.where("toxic = 0")) is None
    assert toxicity.train_toxicity(frame(spark, rows).limit(0), table) is None


@pytest.mark.parametrize("filler", ["x", "7", "xq", "70"])
def test_toxicity_kernel_sees_through_fillers(filler):
    insults = ["moron", "idiot", "scumbag", "worthless"]
    marks = toxicity.Landmarks(insults)
    # Letters that fillers part share triples of letters with the plain insult, not only its beginning.
    got = marks.kernel([filler.join(t[1:]) for t in insults])
    assert (np.diag(got) > 0).all()
    for i, t in enumerate(insults):
        feature = {k: set(f.tolist()) for k, (_, f, _) in ((x, toxicity.subsequences([x])) for x in (t, filler.join(t)))}
        triples = {int(toxicity.subsequences([t[j : j + 3]])[1][1]) for j in range(len(t) - 2)}
        assert triples <= feature[t] and triples <= feature[filler.join(t)]
    # The sparse sums are the cosine of the subsequences.
    dense = np.zeros((2, len(insults) + 1, toxicity.FEATURES))
    words = [*insults, "mo7ron"]
    owner, feature, weight = toxicity.subsequences(words)
    np.add.at(dense[0], (owner, feature), weight)
    assert np.allclose(marks.kernel(words), (dense[0] @ dense[0][:-1].T) ** toxicity.POWER, atol=1e-6)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    strange = docs.limit(20).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    strange = strange.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for start in (docs, strange, docs.limit(0)):
        left = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, left = left, stage(spark, left, sf)
            assert left.columns == docs.columns and left.count() <= before.count()
        out = corpus_pipeline.STAGES[-1][1](spark, left, sf)
        assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens"}
        assert out.where("n_tokens <> size(ids)").count() == 0
