import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veriflux.llm import decontamination, queries, simhash, substring_dedup, toxicity, words


# --- toxicity -------------------------------------------------------------------------


def invented(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary, n)) + ". "


@pytest.fixture(scope="module")
def bags():
    rng = np.random.default_rng(4)
    plain, bad = [f"word{i}" for i in range(300)], ["vilex", "grubok", "slimor"]
    rows, labels = [], []
    for d in range(600):
        text, toxic = "".join(invented(rng, 9, plain) for _ in range(rng.integers(1, 12))), d % 4 == 0
        if toxic:
            text += f"word1 {rng.choice(bad)} word2 {rng.choice(bad)}. " + invented(rng, 5, plain)
        rows.append((d, text))
        labels.append((d, int(toxic)))
    return rows, labels


def test_noisy_or_finds_documents_and_sentences(spark, bags):
    rows, labels = bags
    odd = [(1000, None), (1001, ""), (None, rows[0][1]), (0, rows[0][1]), (1002, "vilex " + "word3 word4. " * 40000)]
    docs = spark.createDataFrame([(a, b, "x", 3) for a, b in rows + odd], "doc_id long, text string, label string, score int")
    marks = spark.createDataFrame([*labels, (0, None), (4, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [d for d, _ in rows if by[d].held_out]
    assert 60 < len(held) < 200
    assert np.mean([by[d].predicted == dict(labels)[d] for d in held]) > 0.95
    assert by[1000].score == by[1001].score == 0.0 and by[1002].predicted == 1 and not by[None].held_out
    for d in held:
        text = dict(rows)[d]
        for s in by[d].offending:
            assert any(w in (b"vilex", b"grubok", b"slimor") for w in words.sentences(text)[s.sentence])
        if by[d].offending:
            p = 1 - np.prod([1 - s.score for s in by[d].offending])
            assert by[d].score >= p - 1e-9
    assert toxicity.score(docs.limit(0), model).collect() == []
    empty = toxicity.fit(docs, marks.filter("toxic = 0"))
    assert not empty.fitted and {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_scores_are_the_noisy_or_of_all_sentences(spark, sf):
    import math

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    assert model.fitted and len(got) == docs.count()
    for doc_id, text in docs.select("doc_id", "text").collect():
        clean, offending = 1.0, []
        for i, own in enumerate(words.sentences(text)):
            z = model.bias + sum(model.weights.get(f, 0.0) for w in own for f in toxicity.features_of(w))
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            if p >= 0.5:
                offending.append((i, round(p, 9)))
        r = got[doc_id]
        assert abs(r.score - (1 - clean)) < 1e-9 and r.predicted == (r.score >= 0.5)
        assert [(s.sentence, round(s.score, 9)) for s in r.offending] == offending and r.offending_sentences == len(offending)


def test_the_fit_is_a_maximum_of_the_likelihood():
    rng = np.random.default_rng(2)
    n, sentences, features = 60, rng.integers(1, 5, 60), 6
    first = np.concatenate(([0], np.cumsum(sentences)[:-1]))
    doc = np.repeat(rng.permutation(n), 3)
    sentence = first[doc] + rng.integers(0, sentences[doc])
    _, sentence = np.unique(sentence, return_inverse=True)
    feature = rng.integers(0, features, len(doc))
    y = (rng.random(n) < 0.4).astype(float)
    ridge = 1e-2

    def loss(b, w):
        clean = np.ones(n)
        seen = np.zeros(n, int)
        for s in range(sentence.max() + 1):
            own = np.flatnonzero(sentence == s)
            clean[doc[own[0]]] *= 1 - 1 / (1 + np.exp(-(b + w[feature[own]].sum())))
            seen[doc[own[0]]] += 1
        clean *= (1 - 1 / (1 + np.exp(-b))) ** (sentences - seen)
        return np.mean(y * np.log(1 - clean) + (1 - y) * np.log(clean)) - ridge / 2 * (w**2).sum()

    b, w = toxicity.fit_noisy_or(y, sentences, doc, sentence, feature, features, steps=4000, rate=0.02, ridge=ridge)
    best = loss(b, w)
    for k in range(features):
        for step in (-0.05, 0.05):
            assert loss(b, w + step * (np.arange(features) == k)) < best + 1e-6
    assert loss(b + 0.05, w) < best + 1e-6 and loss(b - 0.05, w) < best + 1e-6


def test_the_fit_is_the_same_in_blocks_and_in_any_order(monkeypatch):
    rng = np.random.default_rng(6)
    n, features = 90, 8
    sentences = rng.integers(0, 6, n)
    sentences[[0, 40, 41, 89]] = 0
    first = np.concatenate(([0], np.cumsum(sentences)[:-1]))
    doc = np.sort(rng.choice(np.flatnonzero(sentences), 700))
    doc = doc[doc % 7 > 0]  # some documents without any feature
    sentence = first[doc] + rng.integers(0, sentences[doc])
    order = np.lexsort((sentence, doc))
    sentence, feature, y = sentence[order], rng.integers(0, features, len(doc)), (rng.random(n) < 0.4).astype(float)
    b, w = toxicity.fit_noisy_or(y, sentences, doc, sentence, feature, features)
    mixed = rng.permutation(len(doc))
    for block, o in ((1, slice(None)), (17, slice(None)), (17, mixed), (1 << 16, mixed)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        b1, w1 = toxicity.fit_noisy_or(y, sentences, doc[o].astype(np.int32), sentence[o], feature[o].astype(np.int32), features)
        assert abs(b - b1) < 1e-6 and np.abs(w - w1).max() < 1e-6


def test_the_driver_holds_a_part_of_the_sample_at_a_time(spark):
    """Occurrences of features by the hundred thousand, of which the driver had several copies."""
    import tracemalloc

    rows = [(d, f"vilex word{d % 9}. " * 1500 if d % 4 == 0 else f"plain word{d % 9}. " * 9) for d in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(d, int(d % 4 == 0)) for d, _ in rows], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.fitted and peak < 24e6, peak


def test_folds_are_those_of_the_contract(spark):
    from zlib import crc32

    got = spark.range(500).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out(simhash.F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_held_out_documents_do_not_change_the_model(spark, bags):
    rows, labels = bags
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from zlib import crc32

    flipped = [(d, 1 - y if crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.bias == b.bias and a.weights == b.weights


def test_op6_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op6_toxicity(spark, sf).collect() if r.doc_id in y and r.held_out]
    pos, neg = ([r.score for r in rows if y[r.doc_id] == v] for v in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
    assert auc > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


# --- decontamination ------------------------------------------------------------------


def test_lcs_matches_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 40)).tolist() for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.lcs_length(a, b) == t[-1, -1]
        if a and b:
            lo, hi = decontamination.matched_span(a, b)
            assert decontamination.lcs_length(a, b[lo : hi + 1]) == t[-1, -1]


def brute_leaks(docs, items, cover=0.8):
    """Documents in which a stretch as long as an item holds ``cover`` of it in order."""
    out = set()
    for d, t in docs:
        own = words.words(t)
        for i, text in items:
            item = words.words(text)
            if len(item) >= 5 and any(decontamination.lcs_length(item, own[k : k + len(item)]) >= cover * len(item) for k in range(max(1, len(own) - len(item) + 1))):
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = 1 / np.arange(1, 401)
    some = lambda n: list(rng.choice(vocabulary, n, p=weights / weights.sum()))
    items = [(i, " ".join(some(int(rng.integers(14, 60))))) for i in range(25)] + [(90, None), (91, "too short"), (92, "")]
    docs = []
    for d in range(120):
        own = some(int(rng.integers(20, 300)))
        if d % 3 == 0:
            item = items[d % 25][1].split()
            if d % 2:
                for k in rng.choice(len(item), len(item) // 10, replace=False):
                    item[k] = "changed"
            at = int(rng.integers(0, len(own)))
            own[at:at] = item
        docs.append((d, " ".join(own)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "w1 " * 30000 + items[1][1]), (500, items[2][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench, block_items=10).collect()}
    expected = brute_leaks(docs[:120], [x for x in items if x[1]])
    assert len(expected) >= 38 and len(expected - got) <= len(expected) // 20
    planted = {(d, d % 25) for d in range(0, 120, 3)} | {(None, 0), (502, 1), (500, 2)}
    assert len(planted - got) <= 1 and len({d for d, _ in got} - {d for d, _ in planted}) <= 1
    assert decontamination.find_leaks(df.limit(0), bench).collect() == [] == decontamination.find_leaks(df, bench.limit(0)).collect()


def brute_paraphrases(docs, items, cover=0.8, paraphrase=0.6):
    """All pairs: a stretch of twice an item's words that holds ``cover`` of it in order, or ``paraphrase`` of it and its last words."""
    out = set()
    for d, t in docs:
        own = words.words(t)
        for i, text in items:
            item = words.words(text)
            answer = words.sentences(text)[-1][-8:]
            for k in range(max(1, len(own) - 2 * len(item) + 1)):
                part = own[k : k + 2 * len(item)]
                n = decontamination.lcs_length(item, part)
                if n >= cover * len(item) or n >= paraphrase * len(item) and decontamination.lcs_length(answer, part) >= 0.8 * len(answer):
                    a, b = decontamination.matched_span(item, part)
                    if b - a + 1 <= 2 * len(item) and (n >= cover * len(item) or decontamination.lcs_length(answer, part[a : b + 1 + len(answer)]) >= 0.8 * len(answer)):
                        out.add((d, i))
                        break
    return out


def paraphrased(rng, item, vocabulary):
    """Swaps, insertions, other words, and two clauses that change places; the last eight words stay."""
    own, answer = item[:-8], item[-8:]
    if rng.random() < 0.4:
        third = len(own) // 4
        own = own[third : 2 * third] + own[:third] + own[2 * third :]
    for _ in range(len(own) // 8):
        k = int(rng.integers(len(own) - 1))
        own[k], own[k + 1] = own[k + 1], own[k]
    for _ in range(len(own) // 8):
        own.insert(int(rng.integers(len(own))), str(rng.choice(vocabulary)))
    for k in rng.choice(len(own), len(own) // 8, replace=False):
        own[k] = str(rng.choice(vocabulary))
    return own + answer


def test_paraphrases_match_all_pairs(spark):
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = 1 / np.arange(1, 3001)
    some = lambda n: list(rng.choice(vocabulary, n, p=weights / weights.sum()))
    items = [(i, " ".join(some(int(rng.integers(24, 70))))) for i in range(30)]
    docs = []
    for d in range(150):
        own = some(int(rng.integers(40, 250)))
        if d % 2:
            at = int(rng.integers(0, len(own)))
            own[at:at] = paraphrased(rng, items[d % 30][1].split(), vocabulary)
        docs.append((d, " ".join(own)))
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = brute_paraphrases(docs, items)
    by_answer = [r for r in got.values() if r.coverage < 0.8]
    print("paraphrases: recall", len(set(got) & expected) / len(expected), "of", len(expected), "by answer", len(by_answer))
    assert len(expected) >= 50 and len(by_answer) >= 10 and all(r.answer for r in by_answer)
    assert len(set(got) & expected) >= 0.9 * len(expected) and len(set(got) - expected) <= 1


def test_the_end_of_a_long_item_is_not_lost(spark):
    long = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(403))), (2, " ".join(f"b{i}" for i in range(405)))], "item_id long, text string")
    block = next(decontamination._blocks(long, 100, 5, 400))
    assert [(i, len(own), answer[-1]) for i, own, answer in block] == [(1, 403, b"a402"), (2, 400, b"b399"), (2, 5, b"b404")]


def test_op3_finds_the_passages_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").selectExpr(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    grams = {}
    for i, t in items:
        w = words.words(t)
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    truth = set()
    for d, t in docs:
        w, n = words.words(t), {}
        for k in range(len(w) - 7):
            for i in grams.get(tuple(w[k : k + 8]), ()):
                n[i] = n.get(i, 0) + 1
        truth |= {(d, i) for i, c in n.items() if c >= 0.9 * (len(words.words(dict(items)[i])) - 7)}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf).collect()}
    assert truth and truth <= got and len(got - truth) <= 1


def test_leaks_with_their_rare_words_changed_are_verified():
    import pyarrow as pa

    item = [b"f%d" % i for i in range(21)] + [b"r%d" % i for i in range(9)]
    idf = np.array([1.0] * 21 + [17.0] * 9 + [17.0, 0.0])
    basis = np.vstack([np.diag(idf[:30]), np.zeros((2, 30))]).astype(np.float32)
    asked = (basis[:30].sum(axis=0) / np.linalg.norm(idf[:30]))[None].astype(np.float32)
    index = decontamination.Index({w: i for i, w in enumerate(item)}, [(7, item, item[-4:])], idf, basis, asked)
    own = " ".join([f"f{i}" for i in range(21)] + ["r0", "r1", "r2"] + [f"other{i}" for i in range(6)])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([own, " ".join(f"f{i}" for i in range(12))])], ["doc_id", "body"])
    found = [r for b in decontamination._search(index, 0.3, 0.8, 0.6)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["lcs"]) for r in found] == [(1, 7, 24)]


# --- substring dedup ------------------------------------------------------------------


def brute_repeats(rows, min_words=20):
    sets = {}
    for d, t in rows:
        for i, own in enumerate(words.lines(t)):
            if len(own) >= min_words:
                sets[(d is not None, d or 0, i)] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for k in sets:
        groups.setdefault(find(k), set()).add(k)
    return {k: (g, len(v)) for g, v in groups.items() if len(v) > 1 for k in v}


@pytest.mark.parametrize("block", [3, 512])
def test_repeats_match_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [list(rng.choice(vocabulary, rng.integers(25, 90))) for _ in range(15)]
    rows = []
    for d in range(70):
        lines = []
        for _ in range(3):
            own = list(base[rng.integers(15)])
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = "edit" + str(rng.integers(1000))
            lines.append(" ".join(own))
        rows.append((d * 7 % 71, "\n".join([*lines, "short one", " ".join(rng.choice(vocabulary, 40))])))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, "x " * 60000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, line int")
    got = {(r.doc_id is not None, r.doc_id or 0, r.line): ((r.keep_doc_id is not None, r.keep_doc_id or 0, r.keep_line), r.group_size) for r in substring_dedup.repeated_paragraphs(df, block=block).collect()}
    expected = brute_repeats(rows)
    assert set(got) <= set(expected) and len(expected) - len(got) <= 0.01 * len(expected)
    assert np.mean([got.get(k) == v for k, v in expected.items()]) > 0.95
    assert substring_dedup.repeated_paragraphs(df.limit(0)).collect() == []


def brute_windows(rows, size=50):
    """(doc id, word) of all words that lie in a run of ``size`` words that is there earlier."""
    seen, gone = {}, set()
    for d, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        own = words.words(t)
        for k in range(len(own) - size + 1):
            first = seen.setdefault(tuple(own[k : k + size]), (d, k))
            if first[0] != d or k - first[1] >= size:
                gone |= {(d, k + i) for i in range(size)}
    return gone


def test_passages_are_found_wherever_lines_end(spark):
    rng = np.random.default_rng(12)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    planted, broken = prose(50), prose(50)
    rows = [(i, " ".join(prose(int(rng.integers(1, 400))))) for i in range(40)]
    rows += [(50, " ".join(prose(70) + planted + prose(90))), (51, "one line before\n" + " ".join(prose(33) + planted + prose(120)))]
    rows += [(52, " ".join(prose(60) + broken + prose(10))), (53, "\n".join(" ".join(x) for x in (prose(9), broken[:7], broken[7:19], broken[19:38], broken[38:], prose(8))))]
    rows += [(54, " ".join(prose(40) + planted[:49] + prose(40))), (55, " ".join(x := prose(130)) + "\n" + " ".join(x)), (56, "x " * 3000), (57, None), (58, ""), *[(60 + i, " ".join(planted)) for i in range(20)]]
    df = spark.createDataFrame([*rows, rows[40]], "doc_id long, text string")
    got = substring_dedup.repeats(df).filter("first_word is not null").collect()
    assert sorted(map(tuple, substring_dedup.repeated_passages(df, hot=1).select(got[0].__fields__).collect())) == sorted(map(tuple, got))
    assert {(r.doc_id, w) for r in got if r.removed for w in range(r.first_word, r.last_word + 1)} == brute_windows(rows)
    found = {r.doc_id: r for r in got if r.removed}
    assert (found[51].line, found[51].first_word, found[51].last_word, found[51].keep_doc_id, found[51].keep_first_word) == (1, 36, 85, 50, 70)
    assert (found[53].line, found[53].last_line, found[53].keep_doc_id, found[53].group_size) == (1, 4, 52, 2)
    assert 54 not in found and {r.doc_id for r in got if not r.removed} == {50, 52, 55, 56} and found[79].group_size == 22


def test_equal_windows_of_one_place_are_joined_once(spark):
    hashes, lines = np.array([5, 7, 5, 7, 5], np.int64), np.arange(10, dtype=np.int32)
    batch = pa.RecordBatch.from_pylist([{"seed": 1, "alike": 2, "n": 3, "doc": 4, "copy": 6, "word": 10, "lines": lines.tobytes(), "hashes": hashes.tobytes()}])
    (out,) = substring_dedup._single(iter([batch]))
    assert [(r["hash"], r["at"], r["word"], r["line"]) for r in out.to_pylist()] == [(5, [0, 2, 4], 10, 0), (7, [1, 3], 11, 2)]
    rows = [(i, f"start{i} " * 3 + "so on and " * (40 + i) + f"end{i} and then " + "x " * (60 + 2 * i)) for i in range(12)]
    df = spark.createDataFrame([*rows, (None, rows[3][1])], "doc_id long, text string")
    apart, together = (sorted(map(str, substring_dedup.repeated_passages(df, hot=n).collect())) for n in (1, 10**6))
    assert apart == together and len(apart) > 12


def test_bands_reach_the_recall():
    for s, r in ((0.8, 3), (0.7, 4), (0.9, 5)):
        b = substring_dedup.banding(s, r, 0.995)
        assert 1 - (1 - s**r) ** b >= 0.995 > 1 - (1 - s**r) ** (b - 1)


# --- pipeline -------------------------------------------------------------------------


def test_leaks_of_the_pipeline_are_sought_by_an_index_fitted_on_all_passages(spark, sf, monkeypatch):
    fitted, basis = [], decontamination.randomised_basis
    monkeypatch.setattr(decontamination, "randomised_basis", lambda sample, *a: fitted.append(sample.count()) or basis(sample, *a))
    docs = spark.range(24).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" the of a in"), 25_000)).alias("text"))
    corpus_pipeline.drop_leaks(spark, docs, sf)
    assert fitted == [24]


def test_matrices_are_summed_over_all_tasks(spark):
    vocabulary = {f"w{i}".encode(): i for i in range(150)}
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 170, n)) for n in (1, 31, 32, 33, 500)]
    a = np.zeros((0, 150))
    for t in texts:
        ids = [vocabulary.get(w, 150) for w in words.words(t)]
        a = np.vstack([a, *[np.bincount(ids[k : k + 32], minlength=151)[None, :150] for k in range(0, len(ids), 32)]])
    rows, m = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").repartition(4), rng.standard_normal((150, 3))
    assert np.allclose(decontamination._applied(rows, vocabulary, m, gram=False), a.T @ a @ m, rtol=1e-4, atol=1e-3)
    assert np.allclose(decontamination._applied(rows, vocabulary, m, gram=True), m.T @ a.T @ a @ m, rtol=1e-4, atol=1e-3)


def test_stages_hold_what_they_promise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        after = {r.doc_id: r for r in out.collect()} if name != "packing" else None
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before)
            seen = set()
            for d in sorted(after):
                own = [x.strip(" \t\r") for x in (after[d].text or "").split("\n")]
                own = [x for x in own if x]
                assert not seen & set(own) and len(set(own)) == len(own)
                seen |= set(own)
        else:
            assert all(after[d] == before[d] for d in after)
        if name == "simhash":
            fps = {d: simhash.fingerprint(r.text) for d, r in before.items()}
            near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4
            assert not any(near(a, b) for a, b in itertools.combinations(sorted(after), 2))
            assert len(set(before) - set(after)) <= sum(any(near(d, x) for x in before if x < d) for d in before) + 5
        if name == "decontamination":
            assert not brute_leaks([(d, r.text) for d, r in after.items() if len(r.text) < 4000], benchmark)
        docs, before = spark.createDataFrame(list(after.values()), docs.schema), after


def test_run_rereads_each_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    plain = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    got = corpus_pipeline.run(spark, sf)
    whole = lambda rows: {(r[0], r[4]) for r in rows}
    assert whole(plain(got)) == whole(plain(docs)) and got.columns == docs.columns


def test_stages_with_ids_that_repeat_and_names_that_clash(spark, sf):
    toxic = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    bad = [r.text for r in toxicity.score(toxic, toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))).join(toxic, "doc_id").filter("predicted = 1").orderBy("doc_id").collect()][0]
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    clean = ["a clean text of several words here", "another clean text of quite other words", "and a third with nothing in common, one hopes"]
    rows = [(None, clean[0]), (None, bad), (None, leak), (7, clean[1]), (7, clean[2]), (7, clean[2]), (8, clean[1])]
    schema = "doc_id long, text string, _gone_id int, own_row int, gone int, C0x int, row int"
    docs = spark.createDataFrame([(a, b, 1, 2, 3, 4, 5) for a, b in rows], schema)
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", *[F.lit(k).cast("int").alias(n) for k, n in enumerate(("_gone_id", "own_row", "gone", "C0x", "row"), 1)])
    left = [r for r in corpus_pipeline.drop_toxic(spark, docs.union(real), sf).collect() if (r.doc_id, r.text) in rows]
    assert sorted(map(str, left)) == sorted(str(r) for r in docs.collect() if r.text != bad)
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert near.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted((str(a), b) for a, b in rows[:5])
    after = corpus_pipeline.drop_leaks(spark, docs, sf)
    assert after.columns == docs.columns and sorted(map(str, after.collect())) == sorted(str(r) for r in docs.collect() if r.text != leak)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_pipeline_drops_null_and_empty_rows_only_for_cause(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a clean text of several words here", "en", "s", 34), (3, "another clean text of quite other words", "en", "s", 39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"]  # 1 and 2 have one fingerprint
