import numpy as np
import pytest

from veriflux.llm import licences, line_dedup, queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(rows, min_chars=20):
    """doc ids and line numbers that go."""
    at = [((d is not None, d if d is not None else 0, i), x.strip(" \t\r")) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    near = lambda x, y: x == y or min(len(x), len(y)) >= min_chars and abs(len(x) - len(y)) < 2 and edits(x, y) <= 1
    return {p for p, x in at if x and any(q < p and near(x, y) for q, y in at)}


def texts_with_edits(seed, n=40):
    rng = np.random.default_rng(seed)
    letters = list("aab é")
    base = ["".join(rng.choice(letters, rng.integers(18, 30))) + "x" for _ in range(12)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.integers(1, 5)):
            x = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(len(x)))
                kind = rng.integers(3)
                if kind == 0:
                    x[k] = str(rng.choice(letters))
                elif kind == 1:
                    x.insert(k, str(rng.choice(letters)))
                elif len(x) > 1:
                    del x[k]
            lines.append("".join(x))
        rows.append((int(rng.permutation(n)[d]) + n * d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_near_lines_match_all_pairs(spark, seed):
    rows = texts_with_edits(seed)
    got = line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len({(r.doc, r.line) for r in got})
    assert {(True, r.doc, r.line) for r in got} == brute(rows)


ROWS = [(2, "this line is on every page\nkeep me, I am long enough"), (1, None), (3, ""), (None, "this line is on every page\n\nshort"), (4, "  this line is on every pagE\r\nshort\nshort"), (5, "this line is on every page"), (5, "this line is on every page"), (6, "y" * 30000 + "\n" + "z"), (7, "y" * 14999 + "x" + "y" * 15000)]


def test_odd_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(a, b, len(b or ""), "first", 9, "k") for a, b in ROWS], "doc_id long, text string, n_chars long, first string, line long, key string")
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "_lines_dropped"]
    got = sorted((str(r.doc_id), r.text, r.n_chars, r.first, r.line, r._lines_dropped) for r in out.collect())
    expected = [(2, "keep me, I am long enough", 1), (1, None, 0), (3, "", 0), (None, "this line is on every page\n\nshort", 0), (4, "", 3), (5, "", 1), (5, "", 1), (6, "y" * 30000 + "\nz", 0), (7, "", 1)]
    assert [(a, b, f) for a, b, _, _, _, f in got] == sorted((str(a), b, n) for a, b, n in expected)
    assert all(c == len(b or "") for _, b, c, *_ in got)
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        line_dedup.line_dedup(docs, max_edits=2)


def test_long_lines_of_one_family_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh "), 150)) + "x"
    rows = []
    for d in range(120):
        x = list(base)
        for k in rng.integers(0, len(x), rng.integers(0, 3)):
            x[k : k + int(rng.integers(0, 2))] = str(rng.choice(list("yz")))
        rows.append((d, "".join(x)))
    got = {(True, r.doc, r.line) for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and 20 < len(got) < 119


def test_names_that_clash_and_ids_that_repeat(spark):
    one, two = "this line is on every page\nmine, and of nobody else", "of another text of that id\nthis line is on every page"
    rows = [(1, one), (7, one), (7, two), (None, "not repeated at all, this one"), (None, "this line is on every page")]
    docs = spark.createDataFrame([(a, b, 1, 2, 3, 4) for a, b in rows], "doc_id long, text string, _lines_gone int, _Lines_Doc int, gone int, _lines_dropped int")
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "_lines_gone", "_Lines_Doc", "gone", "_lines_dropped"]
    got = sorted((str(r[0]), r[1], r[2], r[3], r[4], r[5]) for r in out.collect())
    left = [(1, "mine, and of nobody else", 1), (7, "", 2), (7, "of another text of that id", 1), (None, "not repeated at all, this one", 0), (None, "this line is on every page", 0)]
    assert got == sorted((str(a), b, 1, 2, 3, n) for a, b, n in left)


def same_as_sql(spark, sf, name, query):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    out = con.sql(queries.oracle_sql()[name])
    columns = sorted(out.columns)
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    key = lambda r: tuple(str(v) for v in r)
    a = sorted([tuple(r[c] for c in columns) for r in query(spark, sf).collect()], key=key)
    b = sorted([tuple(dict(zip(out.columns, r))[c] for c in columns) for r in out.fetchall()], key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    same_as_sql(spark, sf, name, queries.queries()[name])


# --- licences -------------------------------------------------------------------------


def plain_dice(a, b):
    a, b = set(licences.template_bigrams(a)), set(licences.template_bigrams(b))
    return round(2 * len(a & b) / (len(a) + len(b)), 6) if a and b else 0.0


def test_licence_scan_matches_all_templates(spark):
    rows = [(i, text) for i, (_, text) in enumerate(licences.TEMPLATES)]
    rows += [(100, "intro words here\nReleased under the MIT License.\nmore"), (101, None), (102, ""), (103, "one"), (None, "All rights reserved."), (104, "prose " * 20000), (105, licences._MIT.replace("sublicense", "resell") + " extra words at the end"), (106, "Released  under THE mit--license"), (107, "released under the"), (100, "All rights reserved.")]
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, licence string, unit string")
    hits = {(r.doc_id, r.first, r.licence, r.dice) for r in licences.licence_hits(docs).collect() if r.first == r.last}
    expected = set()
    for d, t in rows:
        for u, unit in [(-1, t), *enumerate(t.split("\n"))] if t is not None else []:
            expected |= {(d, u, name, s) for name, text in licences.TEMPLATES if (s := plain_dice(unit, text)) >= 0.8}
    assert hits == expected
    got = {}
    for r in licences.licence_scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.unit))
    assert len([1 for v in got.values() for _ in v]) == len(rows)
    assert got[105] == [("MIT", -1)] and got[101] == got[103] == got[104] == [(None, -2)] and got[None] == [("all-rights-reserved", -1)]
    assert got[100] == [("all-rights-reserved", -1)] * 2
    assert all(got[i][0][0] == name for i, (name, _) in enumerate(licences.TEMPLATES))
    assert licences.licence_scan(docs.limit(0)).collect() == []


def all_windows(text):
    """The best of all windows of lines, by all templates: (dice, licence, first, last)."""
    lines = text.split("\n")
    own = [(i, licences.re.sub("[^a-z0-9]+", " ", x.lower()).split()) for i, x in enumerate(lines)]
    own = [(i, w) for i, w in own if w]
    found = []
    for a in range(len(own)):
        for b in range(a, len(own)):
            words = [w for _, x in own[a : b + 1] for w in x]
            pairs = set(zip(words, words[1:]))
            for name, t in licences.TEMPLATES:
                m = licences.template_bigrams(t)
                lo, hi = licences.bounds(len(m), 0.8)
                if lo <= len(pairs) and (a == b or len(words) - 1 <= hi):
                    dice = round(2 * len(pairs & set(m)) / (len(pairs) + len(m)), 6)
                    if dice >= 0.8:
                        found.append((-dice, own[b][0] - own[a][0], own[a][0], name, own[b][0]))
    return found


def test_wrapped_licences_in_long_documents(spark):
    import textwrap

    rng = np.random.default_rng(8)
    rows = []
    for i, (name, text) in enumerate(licences.TEMPLATES):
        if len(licences.template_bigrams(text)) < 8:
            continue
        code = [" ".join(rng.choice(["def", "value", "of", "the", "return", "x1", "software", "y"], 6)) for _ in range(60)]
        wrapped = ["# " + x for x in textwrap.wrap(text, 30 + 5 * (i % 5))]
        if i % 3 == 0:
            wrapped[len(wrapped) // 2] += " extra words"
        wrapped[1:1] = [""] * (i % 2)
        rows.append((i, name, "\n".join(code[:20] + ["", "# Copyright 2024 Example Ltd."] + wrapped + code[20:])))
    docs = spark.createDataFrame([(i, t, "x") for i, _, t in rows], "doc_id long, text string, first string")
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    for i, name, text in rows:
        found = all_windows(text)
        dice, lines, first, licence, last = min(found)
        assert (got[i].dice, got[i].licence, got[i].unit, got[i].last_line) == (-dice, licence, first, last) and licence == name and last > first
        assert got[i].licences == ",".join(sorted({x[3] for x in found}))


def test_size_bounds_lose_nothing():
    for m in (1, 3, 10, 57):
        lo, hi = licences.bounds(m, 0.8)
        for a in range(1, 200):
            assert (2 * min(a, m) / (a + m) >= 0.8) == (lo <= a <= hi)
