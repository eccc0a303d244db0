"""Each operator against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing names."""

import collections
import re
import sys

import numpy as np
import pytest

pytest.importorskip("conforank.llm")


import compare
from conforank.llm import decontaminate, html_text, jaccard, language, line_dedup, quality, substring_dedup
from conforank.llm.queries import REGISTRY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_lines string, _id int, key string, kept int, _all int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, "en", "s", "x", 7, "k", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def odd_rows():
    shared = "Shared line here. And more of it follows now, said she again and again to all.\n"
    rows = [(i, f"{shared}own {i} words stand here. Another sentence {i} with its own five words.\n SHARED LINE two \t") for i in range(14)]
    rows += [(1, rows[1][1]), (100, None), (101, ""), (102, " \n\t\n "), (None, rows[2][1]), (None, None), (103, "É " * 3 + "Á.\n\n\nb")]
    rows += [(104, " ".join(f"w{i % 997}" for i in range(60_000)) + "\n" + shared), (105, rows[3][1].upper())]
    return rows


def pairs_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_line_dedup(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    key = lambda line: lower(line.strip(SPACE))
    owners = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            owners[key(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or len(owners[key(x)]) < 10]
        want.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    got = line_dedup.dedup_lines(docs)
    assert pairs_of(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=repr)
    assert set(got.columns) == {*docs.columns, "n_dropped"} and got.where("lang = 'en' AND _all = 2").count() == len(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_sentence_runs(spark):
    docs = frame(spark, odd_rows())
    got = {(r.doc_id, r.text): r for r in substring_dedup.dedup_sentence_runs(docs).collect()}
    first = [r for r in got.values() if r.doc_id == 1]
    assert len(first) == 1 and "Shared line here." not in first[0].text  # a null id sorts first and keeps the passage
    kept = [r for r in got.values() if r.text and "Shared line here." in r.text]
    assert [r.doc_id for r in kept] == [None]
    assert all(r.n_removed == 0 for r in got.values() if r.doc_id in (100, 101, 102, 103))
    assert substring_dedup.dedup_sentence_runs(docs.limit(0)).count() == 0
    inside = "One two three four five six. Seven eight nine ten eleven. "
    twice = frame(spark, [(1, inside + "Between the two of them. " + inside)])
    assert substring_dedup.dedup_sentence_runs(twice).first().text.count("Seven") == 1


def test_long_sentences_alone(spark):
    long = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(i, f"Before it number {i} stands. {long} After it number {i} comes. Short one.") for i in range(4)]
    rows += [(10, "Opening of ten. " + "A b c d e f g h i j. Then k l m."), (11, "Other. " + "A b c d e f g h i j. Then k l m.")]
    got = {r.doc_id: r for r in substring_dedup.dedup_sentence_runs(frame(spark, rows), alone_words=25).collect()}
    assert [i for i in range(4) if long in got[i].text] == [0] and [got[i].n_removed for i in range(4)] == [0, 1, 1, 1]
    assert got[10].n_removed == 0 and got[11].text == "Other."
    by_sql = substring_dedup.dedup_sentence_runs(frame(spark, rows)).collect()  # the query's SQL wants two sentences
    assert sorted((r.doc_id, r.n_removed) for r in by_sql) == [(0, 0), (1, 0), (2, 0), (3, 0), (10, 0), (11, 2)]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_substring_dedup"])
def test_query_equals_sql(spark, sf, name):
    run, sql = REGISTRY[name]
    want = compare.connect(sf).execute(sql).fetch_df()
    assert compare.difference(run(spark, sf).toPandas(), want) is None


def statistics(text):
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def robust(x, extra):
    """Reference for the estimate of one group: same rules, written with arrays."""
    cov = lambda v, f: (np.cov(v.T, bias=True) * f + np.diag(extra**2), v.mean(0))

    def dist(c, m):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def central(score):
        bins = np.floor(np.log1p(score) * 200)
        order = np.sort(bins)
        return bins <= order[int(np.ceil(0.75 * len(x) - 1e-9)) - 1]

    def median(v):
        b = np.sort(np.floor(v * 100), axis=0)
        return (b[int(np.ceil(len(v) / 2)) - 1] + 0.5) / 100

    m = median(x)
    s = median(np.abs(x - m))
    c, m = cov(x[central((((x - m) ** 2) / ((1.4826 * s) ** 2 + extra**2)).sum(1))], quality.SUBSET_FACTOR)
    for _ in range(quality.STEPS):
        c, m = cov(x[central(dist(c, m))], quality.SUBSET_FACTOR)
    c, m = cov(x[dist(c, m) <= quality.REWEIGHT_POINT], quality.REWEIGHT_FACTOR)
    return dist(c, m)


def test_quality(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(20, 300))) + "\nend") for i in range(150)]
    junk = [(500 + i, " ".join(w + "###" for w in rng.choice(vocabulary, 60))) for i in range(12)]
    edge = [(900, None), (901, ""), (902, "one two"), (903, "a b c d e f " * 20), (None, rows[0][1]), (3, rows[3][1])]
    everything = rows + junk + edge
    got = {(r.doc_id, r.n_words): r for r in quality.judge_quality(frame(spark, everything)).collect()}
    for i, t in everything:
        n, *rest = statistics(t or "")
        r = got[(i, n)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(rest)
        assert r.base_failed == (n < 10 or 100 * rest[3] > 20 * n)
    assert all(got[(i, len(WORD.findall(t)))].kept for i, t in rows)
    assert not any(got[(i, 60)].kept for i, _ in junk)
    assert not got[(903, 120)].kept and not got[(900, 0)].kept
    unique = {}
    for r in got.values():
        if not r.base_failed:
            n_lines = next(len([x for x in t.split("\n") if WORD.search(x)]) for i, t in everything if i == r.doc_id and t)
            x = [np.log1p(r.n_words), np.log((r.word_chars + 1) / (r.n_words + 1)), np.sqrt(r.n_symbols / (r.word_chars + 1)),
                 np.sqrt(r.n_dup_lines / (n_lines + 1)), np.sqrt(r.n_repeat_words / (r.n_words + 1))]
            unique[tuple(np.round(x, 4))] = r.distance
    want = robust(np.array(list(unique)), np.array([a[1] for a in quality.AXES.values()]))
    assert np.allclose(want, list(unique.values()), rtol=1e-6)
    small = quality.judge_quality(frame(spark, rows[:5]))
    assert small.where("kept").count() == 5
    assert quality.judge_quality(frame(spark, rows[:1]).limit(0)).count() == 0
    kept = quality.keep_good(frame(spark, everything))
    assert {r.doc_id for r in kept.collect()} >= {i for i, _ in rows} and "n_words" not in kept.columns


def test_html(spark):
    page = (
        "<head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; x</h1>"
        "<p>First  long\nparagraph <b>with</b> words<br>and more of them to read<p>Short.<aside>side</aside></article>"
        "<section id='comments'><p>reader says something long enough to count</p></section><footer>&copy;<p>end"
    )
    want = "Head & x\n\nFirst long paragraph with words and more of them to read\n\nShort."
    assert html_text.main_text(page) == want
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, "<p"), (5, "<article>" + "<p>word" * 20_000), (None, "plain text")]
    pages = spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, n_chars string")
    got = collections.defaultdict(list)
    for r in html_text.extract_pages(pages).collect():
        got[r.page_id].append((r.text, r.n_chars))
    assert got[1] == [(want, len(want))] * 2 and got[2] == got[3] == got[4] == [("", 0)]
    assert got[5][0][0] == "\n\n".join(["word"] * 20_000) and got[None] == [("plain text", 10)]


def brute_groups(rows, num=75, den=100):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        k = min(len(w), 5)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 3000)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(40):  # near copies of one text, more and more changed
        copy = list(base)
        for j in rng.integers(0, len(copy), i // 8):
            copy[j] = word()
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join([*[word() for _ in range(90)], *passage])) for i in range(30)]
    rows += [(200 + i, " ".join(passage + [word() for _ in range(rng.integers(0, 14))])) for i in range(20)]
    rows += [(300 + i, " ".join(passage[: rng.integers(1, 9)])) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " "), (403, rows[0][1].upper()), (403, rows[0][1].upper()), (None, None), (None, rows[1][1])]
    rows += [(404, " ".join(word() for _ in range(20_000)))]
    want = brute_groups(rows)
    for limit in (2, 8, 1000):
        monkeypatch.setattr(jaccard, "FREQUENT", limit)
        got = jaccard.near_duplicate_groups(frame(spark, rows))
        assert pairs_of(got, "doc_id", "n_shingles", "component_id") == want
    one = jaccard.keep_one(frame(spark, rows))
    ids = [r.doc_id for r in one.collect()]
    assert sorted(d for d in ids if d is not None) == sorted({c for d, _, c in want if d is not None and d == c})
    assert ids.count(None) == 2
    assert jaccard.near_duplicate_groups(frame(spark, rows[:1]).limit(0)).count() == 0


def test_near_copies_below_the_similarity_are_not_all_paired(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 100_000)}"
    rows = []
    for family, length in enumerate((146, 150, 60)):
        base = [word() for _ in range(length)]
        for i in range(150 if family == 0 else 25):
            copy = list(base)
            for j in rng.choice(length - 20, 4 if i % 10 else int(rng.integers(1, 4)), False):
                copy[j] = word()
            copy[length - int(rng.integers(0, 20)) :] = [word() for _ in range(int(rng.integers(0, 4)))] if family else copy[length:]
            rows.append((1000 * family + i, " ".join(copy)))
    rows += [rows[0], (5, None), (None, rows[3][1])]
    pairs, bounded = [], jaccard._bounded
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    monkeypatch.setattr(jaccard, "PAIRED_MEMBERS", 1, raising=False)
    monkeypatch.setattr(jaccard, "_bounded", lambda found, *args: pairs.append(found.count()) or bounded(found, *args))
    got = jaccard.near_duplicate_groups(frame(spark, rows))
    assert pairs_of(got, "doc_id", "n_shingles", "component_id") == (want := brute_groups(rows))
    assert 60 < len({c for _, _, c in want}) < 190
    assert sum(pairs) < 4_000, pairs  # the first family alone has 11,175


def test_members_of_a_family_meet_few_centres(spark, monkeypatch):
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(0, 100_000)}"
    base, rows = [word() for _ in range(120)], []
    for i in range(40):  # most share too little with each other, a few are near copies
        copy = list(base)
        for start in rng.choice(12, i % 4, False) * 10:
            copy[start : start + 10] = [word() for _ in range(10)]
        copy[0] = word()
        rows.append((i, " ".join(copy)))
    docs = frame(spark, rows)
    sets = [set(jaccard.shingle_set(text, jaccard.WordHashes()).tolist()) for _, text in rows]
    held = [set(rng.choice(40, 24, False).tolist()) for _ in range(30)]
    members = spark.createDataFrame([(s, k, k) for s, keys in enumerate(held) for k in sorted(keys)], "sig long, key long, comp long")
    nodes = docs.selectExpr("cast(doc_id as long) AS key", "doc_id AS rep", "xxhash64(text) AS rep_hash")
    met, differences = [], jaccard._differences
    monkeypatch.setattr(jaccard, "_differences", lambda found, *args: met.append(found.count()) or differences(found, *args))
    near, pairs = jaccard._through_centres(members, nodes, docs, 75, 100)
    linked = lambda x, y: 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    groups = {i: {i} for i in range(40)}
    near, pairs = ([tuple(r) for r in x.collect()] for x in (near, pairs))
    for x, y in near + [p for p in pairs if linked(*p)]:
        for k in (both := groups[x] | groups[y]):
            groups[k] = both
    due = [(x, y) for x in range(40) for y in range(x) if linked(x, y) and any({x, y} <= h for h in held)]
    assert len(due) > 30 and all(linked(*p) for p in near) and all(x in groups[y] for x, y in due)
    assert met[0] < 80, met  # 100 before


def test_signatures_follow_from_first_tokens():
    rng = np.random.default_rng(9)
    for n in (2, 3, 40, 400):
        whole = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for share in (0.0, 0.1, 1.0):
            frequent = np.unique(whole[rng.random(len(whole)) < share] >> jaccard.CLASS_SHIFT)
            first = whole[: jaccard._counted(len(whole), 75, 100)]
            rare = np.array([(~jaccard._among(first >> jaccard.CLASS_SHIFT, frequent)).sum()])
            if jaccard._past_first(rare, np.array([len(first)]), np.array([len(whole)]), 75, 100)[0]:
                assert share == 1.0 and n > 3  # these come as texts
                continue
            for x, y in zip(jaccard.signatures(first, frequent, 75, 100, len(whole)), jaccard.signatures(whole, frequent, 75, 100)):
                assert np.array_equal(x, y)


def test_decontamination(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(6, 60)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "too short"), (3, items[3][1])]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.integers(0, 120))]
        if i % 2:
            passage = items[i % 40][1].split()
            for j in rng.integers(0, len(passage), i % 3):
                passage[j] = word()
            at = rng.integers(0, len(words) + 1)
            words[at:at] = [w.upper() + "," for w in passage]
        rows.append((i, " ".join(words)))
    rows += [(1, rows[1][1]), (100, None), (101, ""), (None, items[0][1]), (102, " ".join(word() for _ in range(50_000)) + " " + items[5][1])]
    hashes = decontaminate.PlainHashes()
    table = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.ItemIndex([i for i, _ in items], [t for _, t in items], decontaminate._weights(table.where("text is not null")))
    want = []
    for d, t in rows:
        s = decontaminate.shingles_of(t, hashes)
        for k, item in enumerate(index.sets):
            m = min(len(item), len(s))
            best = None
            present = np.isin(s, item).astype(int)
            for i in range(len(s) - m + 1) if m else ():
                if not present[i : i + m].any():
                    continue
                value = decontaminate.weighted_similarity(s[i : i + m], item, index.weight)
                near = int(index.fingerprint(s[i : i + m]) ^ index.prints[k]).bit_count() <= decontaminate.RADIUS
                if value >= 0.75 - 1e-12 and near and (best is None or value > best[0]):
                    best = (value, i)
            if best:
                want.append((d, index.ids[k], best[1], round(best[0], 9)))
    docs = frame(spark, rows)
    got = decontaminate.find_items(docs, table)
    have = sorted(((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got.collect()), key=repr)
    assert have == sorted(want, key=repr) and len(want) > 20
    clean = decontaminate.without_items(docs, table)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {w[0] for w in want}
    assert decontaminate.find_items(docs, table.limit(0)).count() == 0
    assert decontaminate.find_items(docs.limit(0), table).count() == 0


@pytest.mark.parametrize("looked_up", [decontaminate.LOOKED_UP, 3])
def test_fingerprints_are_looked_up_together(monkeypatch, looked_up):
    monkeypatch.setattr(decontaminate, "LOOKED_UP", looked_up)
    rng = np.random.default_rng(3)
    items = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(20)) for _ in range(30)]
    index = decontaminate.ItemIndex([*range(30)], items, (np.zeros(0, np.uint64), np.zeros(0), 1.0))
    flips = [sum(1 << int(b) for b in rng.choice(64, n, False)) for n in rng.integers(0, 25, 300)]
    prints = np.array([int(index.prints[i % 30]) ^ f for i, f in enumerate(flips)], np.uint64)
    want = {(w, k) for w, p in enumerate(prints) for k, q in enumerate(index.prints) if int(p ^ q).bit_count() <= decontaminate.RADIUS}
    assert set(index.near(16, prints)) == want and len(want) > 100
    assert list(index.near(16, prints[:0])) == []
    calls = []
    sys.setprofile(lambda _, event, __: calls.append(event))
    try:
        list(index.near(16, np.tile(~index.prints, 100)))
    finally:
        sys.setprofile(None)
    assert len(calls) < 3000 or looked_up == 3  # 72 look-ups for each of 3,000 windows before


def test_codewords():
    for n in (2, 4, 7, 9, 20):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1.0, 1.0}


