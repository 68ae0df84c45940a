import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veriflux.llm import binary_output, packing, queries, tokens, warc

ODD = [(3, "Hello  world\n\nit's <|endoftext|> 3.5é́ \x1c x\xa0y"), (1, None), (2, ""), (None, "no id"), (2, "twice"), (2, "twice"), (9, "ab " * 9000), (8, "z" * 5000), (7, " \t\n ")]
SCHEMA = "doc_id long, text string, ids string, start long"


def odd(spark):
    return spark.createDataFrame([(a, b, "clash", 5) for a, b in ODD], SCHEMA)


def plain_ids(text, end):
    t = Tokenizer.from_file(tokens.default_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("aéßÀBñ.,!'<|>1 _-s²ªİÆǅʼn\n\u0301\x1c\t", max_size=30), max_size=5))
def test_pieces_have_the_ids_of_whole_texts(texts):
    t = Tokenizer.from_file(tokens.default_path())
    expected = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens.encoder().encode(texts) == expected


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokens.WordEncoder(path)
    texts = ["Two  Spaces, and\nlines's end", "", "x" * 3000, " \t"]
    assert not e.by_word and tokens.encoder().by_word
    assert e.encode([*texts, None]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in [*texts, ""]]


def test_the_rule_closes_nearly_all_windows():
    rng, p = np.random.default_rng(3), packing.SumOfSquares(window=256)
    for i in range(4000):
        p.add(i, bytes(4 * int(rng.integers(1, 300))))
    p.finish()
    assert p.next - p.by_rule <= p.max_open and p.by_rule > 0.98 * p.next


def test_each_character_of_two_bytes_has_its_ids():
    t = Tokenizer.from_file(tokens.default_path())
    texts = [f"a{chr(c)}b {chr(c)} '{chr(c)}1" for c in [*range(0x300), 0x1E9E, 0x212A, 0x212B, 0x2126]]
    wrong = [x for x, got in zip(texts, tokens.encoder().encode(texts)) if got != np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()]
    assert wrong == []


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    e = tokens.WordEncoder()
    for i in range(20):
        words = [f"w{i}x{j}" for j in range(7)] + ["same"]
        assert e.encode([" ".join(words)]) == [plain_ids(" ".join(words), 0)[:-4]]
        assert len(e.words) <= 40 and len(e.pieces) <= 40


def check_pieces(rows, docs, end=2, window=4096):
    """Each id in one piece; sequences gapless from 0 and at most a window long."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    got = defaultdict(bytes)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    return by_doc, by_seq


def test_packing_of_odd_rows(spark):
    rows = packing.pack(odd(spark).coalesce(1)).collect()
    by_doc, by_seq = check_pieces(rows, ODD)
    for doc_id, text in ODD:
        if doc_id in (2,):
            continue
        ids = plain_ids(text, 2)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == ids
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]]))[:-1]
        assert {r.doc_tokens for r in pieces} == {len(ids) // 4}
    assert sum(r.length for r in by_doc[2]) == sum(len(plain_ids(t, 2)) // 4 for d, t in ODD if d == 2)
    full = [sum(n for _, n in s) for s in by_seq.values()]
    assert sum(n < 4096 for n in full) <= 1
    assert packing.pack(odd(spark).limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(2, 12))
def test_sum_of_squares_on_any_sizes(sizes, max_open):
    p = packing.SumOfSquares(window=16, max_open=max_open)
    docs = {}
    for i, n in enumerate(sizes):
        docs[i] = np.arange(n, dtype="<u4").tobytes()
        p.add(i, docs[i])
        assert p.n_open <= max_open + 1
        assert p.n_open == sum(p.counts) == sum(map(len, p.open.values()))
    p.finish()
    got, fill = defaultdict(dict), defaultdict(list)
    for doc, start, length, ids, n, seq, offset in p.done:
        got[doc][start] = ids
        assert n == len(docs[doc]) // 4
        fill[seq].append((offset, length))
    assert {d: b"".join(v for _, v in sorted(x.items())) for d, x in got.items()} == docs
    for spans in fill.values():
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0, *[n for _, n in sorted(spans)]]))[:-1]
    assert sum(sum(n for _, n in s) < 16 for s in fill.values()) <= 1


def test_levels_minimise_the_sum_of_squares():
    rng = np.random.default_rng(5)
    p = packing.SumOfSquares(window=20, max_open=10**9)
    for i in range(300):
        size = int(rng.integers(1, 20))
        before = np.array(p.counts)

        def cost(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + size < 20:
                c[level + size] += 1
            return int((c * c).sum())

        choices = [cost(v) for v in range(0, 21 - size) if v == 0 or before[v]]
        p._place((i, 0, b"\0" * 4 * size, size))
        assert sum(c * c for c in p.counts) == min(choices)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_round_trip(kind, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(None, b""), (5, rng.integers(0, 2**32, 70, dtype=np.uint32).tobytes()), (-7, rng.integers(0, 49408, 333, dtype=np.uint32).tobytes()), (8, b"")]
    f = tmp_path / "x.vbp"
    with f.open("wb") as out:
        w = binary_output.PlaneWriter(out, block=64, kind=kind)
        for d in docs:
            w.add(*d)
        w.close()
    with f.open("rb") as stream:
        r = binary_output.PlaneReader(stream, f.stat().st_size)
        assert list(r.documents()) == docs
        assert [c[1] for c in r.directory["chunks"]] == [64] * 6 + [19]
        assert (r.chunk(1)[:6] == np.frombuffer(docs[1][1], "<u4")[64:]).all()
    f.write_bytes(f.read_bytes()[:-3])
    with f.open("rb") as stream, pytest.raises(ValueError):
        binary_output.PlaneReader(stream, f.stat().st_size)


def test_token_files_of_odd_rows(spark):
    rows = binary_output.read_ids(spark, binary_output.write_ids(odd(spark), block=128, planes="bit")).orderBy("start").collect()
    expected = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in expected]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    by = {r.doc_id: r.ids for r in rows if r.doc_id != 2}
    assert by == {d: plain_ids(t, 1) for d, t in ODD if d != 2}
    assert sorted(r.ids for r in rows if r.doc_id == 2) == sorted(plain_ids(t, 1) for d, t in ODD if d == 2)
    assert binary_output.read_ids(spark, binary_output.write_ids(odd(spark).limit(0))).collect() == []


def test_queries_against_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    t = Tokenizer.from_file(tokens.default_path())
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs}
    rows = {r.doc_id: r for r in queries.op8_token_ids(spark, sf).collect()}
    at = 0
    for r in docs:
        x = np.array([*ids[r.doc_id], 1], "<u4")
        assert tuple(rows[r.doc_id]) == (r.doc_id, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    pieces = queries.op5_packing(spark, sf).collect()
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids.values())
    for p in pieces:
        x = np.array([*ids[p.doc_id], 2], "<u4")
        assert p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())


# --- WARC -----------------------------------------------------------------------------

PAGES = [(5, "http://a/\r\nX: y", "same"), (3, "http://b", "same"), (4, None, "same"), (1, "http://c", None), (2, "http://d", ""), (None, "http://e", "same"), (6, "http://f", "hé" * 40000), (3, "http://b", "same")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")
    files = warc.write_warc(pages)
    rows = warc.read_warc(spark, [f.uri for f in files]).collect()
    assert len(rows) == len(PAGES) == sum(f.n_records for f in files)
    smallest = {"same": 3, "": 1, "hé" * 40000: 6}
    for page_id, _, html in PAGES:
        payload = html or ""
        for r in (r for r in rows if r.page_id == page_id):
            assert r.payload_bytes == len(payload.encode()) and r.payload_digest == warc.digest(payload.encode())
            first = smallest[payload]
            assert (r.record_type, r.refers_to) == (("response", None) if page_id == first else ("revisit", first))
            assert r.payload == (payload.encode() if page_id == first else None)
    assert {r.uri for r in rows if r.page_id == 5} == {"http://a/%0D%0AX:%20y"}
    small = warc.read_warc(spark, [f.uri for f in warc.write_warc(pages, min_revisit_bytes=1)]).filter("page_id = 2").first()
    assert small.record_type == "response"
    assert warc.read_warc(spark, [f.uri for f in warc.write_warc(pages.limit(0))]).collect() == []


def test_warc_reader_is_sequential_and_strict():
    import io

    data = [warc.record(i, f"http://x/{i}", b"p" * i * 50, None, False) for i in range(5)]
    for step in (1, 7, 1 << 16):
        assert [r["page_id"] for r in warc.read_records(io.BytesIO(b"".join(data)), step)] == list(range(5))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"".join(data)[:-5])))
    import zlib as z

    raw = z.decompress(data[3], 31).replace(b"ppp\r\n\r\n", b"ppq\r\n\r\n")
    c = z.compressobj(1, z.DEFLATED, 31)
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(c.compress(raw) + c.flush())))


def test_op9_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for p in sorted(pages):
        first.setdefault(p.html or "", p.page_id)
    rows = {r.page_id: r for r in queries.op9_warc(spark, sf).collect()}
    for p in pages:
        payload, keep = (p.html or "").encode(), first[p.html or ""]
        same = p.page_id == keep
        assert tuple(rows[p.page_id]) == (p.page_id, len(payload), warc.digest(payload), "response" if same else "revisit", None if same else keep)
