"""Tokenizer alignment against a plain version over the libraries' own output."""

import collections
import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

pytest.importorskip("conforank.llm")

import sentencepiece
import tokenizers
from conforank.llm import align
from conforank.llm.queries import REGISTRY
from test_models_and_tokens import fuzz
from test_text_operators import frame, odd_rows

PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def brute(texts):
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    groups, links = [], []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(map(bytes_a, x)) != want or b"".join(map(bytes_b, y)) != want:
            x, y = [], []
        found, i, j, at_a, at_b, left, right, pairs = [], 0, 0, 0, 0, [], [], []
        while i < len(x) or j < len(y):
            if at_a <= at_b and i < len(x):
                left.append(x[i])
                at_a += len(bytes_a(x[i]))
                i += 1
            else:
                right.append(y[j])
                at_b += len(bytes_b(y[j]))
                j += 1
            if at_a == at_b:
                found.append((left, right))
                pairs.append((left[-1], right[-1]))
                left, right = [], []
        assert not left and not right
        groups.append((x, y, found))
        links.append(pairs)
    counts = collections.Counter(p for x in links for p in x)
    best = collections.defaultdict(int)
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    out = []
    for (x, y, found), pairs in zip(groups, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found)
        out.append((len(x), len(y), len(found), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out, counts, best


def strange_rows():
    rows = [*odd_rows(), (200, "a▁b"), (201, "<|endoftext|> and <s> x"), (202, "▁"), (203, "\U0001f600 x" * 50)]
    return rows + [(300 + i, t) for i, t in enumerate(fuzz(300))]


@pytest.mark.parametrize("held", [0, 40, 500_000])
def test_alignment_digests(spark, held):
    rows = strange_rows()
    want, _, _ = brute([t or "" for _, t in rows])
    got = align.alignment_digests(frame(spark, rows), *PATHS, held_pairs=held)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_align_tokenizers(spark):
    rows = strange_rows()
    want, counts, best = brute([t or "" for _, t in rows])
    docs = frame(spark, rows)
    out, table = align.align_tokenizers(docs.withColumn("n_links", docs["key"]).withColumn("_row", docs["key"]), *PATHS)
    assert set(out.columns) == {*docs.columns, "_row", "a_ids", "b_ids", "a_sizes", "b_sizes", "n_best", "count_sum"} - {"text"} | {"n_links"}
    got = [(r.doc_id, len(r.a_ids), len(r.b_ids), len(r.a_sizes), r.n_links, r.n_best, r.count_sum) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((i, *w[:-1]) for (i, _), w in zip(rows, want)), key=repr)
    assert out.where("aggregate(a_sizes, 0, (s, x) -> s + x) <> size(a_ids) OR size(a_sizes) <> size(b_sizes) OR _row <> 'k'").count() == 0
    assert sorted((r.a_id, r.b_id, r.n_links, r.best) for r in table.collect()) == sorted((p, q, n, n == best[q]) for (p, q), n in counts.items())
    both = align.pair(*PATHS)
    assert all(both.bytes_b[b] == both.bytes_a[a] for a, b in enumerate(both.same) if b >= 0) and (both.same >= 0).sum() > 10_000
    none = align.align_tokenizers(docs.limit(0), *PATHS)
    assert none[0].count() == 0 and none[1].count() == 0


def test_alignment_query(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in REGISTRY["op12_tokenizer_alignment"][0](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = brute([d.text or "" for d in docs])
    assert got == {d.doc_id: w for d, w in zip(docs, want)}


def test_links_are_looked_up_in_runs(monkeypatch):
    rng, rows = np.random.default_rng(1), 600
    regular, irregular = (
        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * wide), pa.array(rng.integers(0, 1000, rows * wide).astype(kind)))
        for wide, kind in ((1000, np.int32), (200, np.int64))
    )
    held = rng.integers(1, 99, 1000), np.arange(0, 1000, 2), rng.integers(2, 99, 500)
    peaks, found = [], []
    for links in (10**9, 20_000, 1):
        monkeypatch.setattr(align, "LOOKED_LINKS", links)
        tracemalloc.start()
        found.append(align._looked_up(regular, irregular, *held))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0].equals(found[1]) and found[0].equals(found[2])
    assert peaks[1] < peaks[0] / 5
    none = align._looked_up(regular.slice(0, 0), irregular.slice(0, 0), *held)
    assert len(none) == 0 and none.type == found[0].type
