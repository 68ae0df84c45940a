import hashlib
import re

import numpy as np
import pytest
import xxhash

from veriflux.llm import components as cc
from veriflux.llm import exact_dedup, queries, simhash

ODD = [(5, "a  b"), (4, "a\tb"), (6, "a b"), (1, None), (2, ""), (3, " "), (None, "a b"), (None, "alone"), (None, "alone"), (4, "a b"), (9, "x " * 50000)]


def odd(spark):
    return spark.createDataFrame([(a, b, "clash", 1) for a, b in ODD], "doc_id long, text string, sha string, body long")


# --- exact ----------------------------------------------------------------------------


def brute_exact(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(key(t), []).append(d)
    return {k: (min((d for d in v if d is not None), default=None), len(v)) for k, v in groups.items()}, key


def test_exact_dedup_of_odd_rows(spark):
    found, key = brute_exact(ODD)
    got = exact_dedup.exact_dedup(odd(spark), salts=3).collect()
    expected = sorted((str(d), str(found[key(t)][0]), found[key(t)][1], hashlib.sha256(key(t).encode()).hexdigest()) for d, t in ODD)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(odd(spark).limit(0)).collect() == []


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    found, key = brute_exact(ODD)
    got = exact_dedup.exact_dedup(odd(spark), salts=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted((str(d), str(found[key(t)][0]), found[key(t)][1]) for d, t in ODD)
    assert sum(r.kept for r in got) == len(found)


# --- components -----------------------------------------------------------------------


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(480, 530)] + [(-5, 7)]
    got = cc.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == plain_components(pairs)
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
    a, b = np.array([3, 4, 9, 0]), np.array([4, 5, 8, 2])
    assert cc.local_components(10, a, b).tolist() == [0, 1, 0, 3, 3, 3, 6, 7, 8, 8]


# --- SimHash --------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(rows, fps):
    d = np.array(fps, np.uint64)
    root = np.arange(len(d))
    near = np.bitwise_count(d[:, None] ^ d[None, :]) <= 4
    while True:
        new = np.where(near, root[None, :], len(d)).min(axis=1)
        if (new == root).all():
            break
        root = new
    least = {}
    for (doc, _), r in zip(rows, root.tolist()):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return [least[r] for r in root.tolist()]


TEXTS = ["", None, "one", "A b C d", "a b c\x1cd e f", "İ É x y z w", "to be or not to be " * 9000, "w"]


def test_fingerprints_are_exact():
    rng = np.random.default_rng(2)
    more = [" ".join(map(str, rng.integers(0, 50, n))) for n in range(1, 40)]
    for t in TEXTS + more:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_anchors_cover_every_pair_within_four_bits():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(k)
    near = lambda v: (lambda r, k: [set(k[r == i].tolist()) for i in range(len(v))])(*simhash.anchors(v))
    ax, ay = near(x), near(y)
    assert all(a & b for a, b in zip(ax, ay))
    assert all(len(a) in (4, 19, 34) for a in ax)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_components_of_fingerprints_match_all_pairs(spark, block, monkeypatch):
    rng = np.random.default_rng(block)
    fps = []
    for c in rng.integers(0, 2**64, 25, dtype=np.uint64):
        for _ in range(int(rng.integers(1, 12))):
            v = int(c)
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(k)
            fps.append(v)
    rows = [(i * 3 % 101 + i, None) for i in range(len(fps))]
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    roots = {r.node: r.root for r in cc.components(simhash.links(nodes, block=block)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    least = {}
    for (doc, _), f in zip(rows, signed):
        r = roots.get(f, f)
        least[r] = min(least.get(r, doc), doc)
    assert [least[roots.get(f, f)] for f in signed] == brute_groups(rows, fps)


def test_simhash_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "one"), (None, "only null"), (None, "  ")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp long, component_id long")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_groups(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    assert got == sorted((str(d), f"{f:016x}", str(c)) for (d, _), f, c in zip(rows, fps, brute_groups(rows, fps)))
    assert simhash.simhash_groups(df.limit(0)).collect() == []


def test_op7_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    got = sorted(tuple(r) for r in queries.op7_simhash(spark, sf).collect())
    assert got == sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_groups(rows, fps)))
