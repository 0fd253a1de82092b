import json

from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.operators import context
from textlode.operators.chunking import prepare, split_text, tag

TEXTS = st.text(alphabet="ab \n.é", max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 40), st.integers(0, 5))
def test_chunks_cover_the_text_in_order(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(c and len(c) <= size and c == c.strip() and c in text for c in chunks)
    covered, at = set(), 0
    for c in chunks:
        start = text.find(c, max(0, at - 2 * size))
        assert start >= 0
        at = max(at, start)
    joined = "".join("".join(chunks).split())
    plain = iter(joined)
    assert all(ch in plain for ch in "".join(text.split())) or overlap == 0 or covered == set()
    if overlap == 0:
        assert joined == "".join(text.split())


def test_short_and_blank_texts():
    assert split_text("  one chunk \n", 100, 10) == ["one chunk"]
    assert split_text(" \n\n ", 100, 10) == [] and split_text("", 100, 10) == []


def test_known_splits():
    assert split_text("aaa bbb ccc ddd", 7, 0) == ["aaa bbb", "ccc", "ddd"] or split_text("aaa bbb ccc ddd", 7, 0) == ["aaa bbb", "ccc ddd"]
    text = "para one is here\n\npara two is here\n\npara three"
    assert split_text(text, 20, 0) == ["para one is here", "para two is here", "para three"]
    assert split_text("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4][: len(split_text("x" * 25, 10, 3))]
    overlapping = split_text("one two three four five six", 13, 5)
    assert all(len(c) <= 13 for c in overlapping) and overlapping[0] == "one two three"


def _records(spark):
    rows = [
        ("f", 0, "first part of the file", json.dumps({"source": "/x/f.pdf", "page": 0, "user_id": "spoofed", "file_id": "spoofed"}), "ann"),
        ("f", 1, "second part\x00 of it", json.dumps({"page": 1, "_rag_chunk_index": 99, "note": 'say "hi"'}), "ann"),
        ("g", 0, "alone", None, "bob"),
        ("g", 1, None, None, "bob"),
    ]
    return spark.createDataFrame(rows, "file_id string, part int, page_content string, metadata string, user_id string")


def test_prepare_indexes_across_parts_and_tags_win(spark):
    chunks = prepare(_records(spark), "page_content", ["part"], 15, 0, clean=True)
    rows = tag(chunks, "ab" * 16, 123).collect()
    f = sorted((r for r in rows if r["file_id"] == "f"), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in f] == list(range(len(f))) and len(f) >= 4
    assert all("\x00" not in r["document"] for r in rows)
    meta = [json.loads(r["cmetadata"]) for r in f]
    assert all(m["file_id"] == "f" and m["_rag_ingestion_attempt_id"] == "ab" * 16 and m["_rag_ingestion_attempt_started_at_ns"] == 123 for m in meta)
    assert [m["_rag_chunk_index"] for m in meta] == [r["chunk_index"] for r in f]
    assert meta[0]["user_id"] == "spoofed" and meta[0]["page"] == 0 and meta[-1]["user_id"] == "ann" and meta[-1]["note"] == 'say "hi"'
    (g,) = [r for r in rows if r["file_id"] == "g"]
    assert json.loads(g["cmetadata"])["digest"] == g["digest"]


def _context(spark, rows, overlap=100):
    data = [(f"{k:03d}", "f", t, json.dumps(m) if m is not None else None) for k, (t, m) in enumerate(rows)]
    df = spark.createDataFrame(data, "uuid string, custom_id string, document string, cmetadata string")
    return context.assemble(df, overlap=overlap).first()["context"]


def _m(index, attempt="a", start=100, **more):
    return {"_rag_chunk_index": index, "_rag_ingestion_attempt_id": attempt, "_rag_ingestion_attempt_started_at_ns": start} | more


def test_context_orders_chunks_and_attempts(spark):
    assert _context(spark, [("third", _m(2)), ("first", _m(0)), ("second", _m(1))]) == "firstsecondthird"
    rows = [("old-second", _m(1, "old", 100)), ("new-second", _m(1, "new", 200)), ("old-first", _m(0, "old", 100)), ("new-first", _m(0, "new", 200))]
    assert _context(spark, rows) == "old-firstold-secondnew-firstnew-second"
    rows = [("a2", _m(2, "a", 1)), ("legacy", {}), ("b1", _m(1, "b", 2)), ("a0", _m(0, "a", 1)), ("b0", _m(0, "b", 2)), ("a1", _m(1, "a", 1))]
    assert _context(spark, rows) == "legacya0a1a2b0b1"


def test_context_distrusts_bad_indexes(spark):
    for bad in ([_m(1), _m(1)], [_m(1), _m("0")], [_m(1), _m(True)], [_m(1), _m(-1)], [_m(1), {k: v for k, v in _m(0).items() if k != "_rag_chunk_index"}]):
        assert _context(spark, [("x", bad[0]), ("y", bad[1])]) == "xy"
    assert _context(spark, [("x", None), ("y", _m(0, "")), ("z", _m(0, "a", -5))]) == "xyz"


def test_context_pages_overlap_and_source(spark):
    rows = [("page zero", _m(0, page=0, source="/up/dummy.txt")), ("page one", _m(1, page=1)), ("more", _m(2, page=1)), ("two", _m(3, page=2))]
    assert _context(spark, rows) == "dummy.txt\npage zero\n# PAGE 1\n\npage onemore\n# PAGE 2\n\ntwo"
    shared = "s" * 10
    assert _context(spark, [("begin " + shared, _m(0)), (shared + " end", _m(1))], overlap=10) == f"begin {shared} end"
    assert _context(spark, [("abc", _m(0)), ("bc", _m(1)), (None, _m(2))], overlap=10) == "abc"


def test_context_matches_a_plain_fold(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        text, out, page = "", [], 0
        for k in range(12):
            page += rng.random() < 0.3
            out.append(("".join(rng.choice("ab ") for _ in range(rng.randrange(0, 8))), _m(k, page=page)))
        last = None
        for t, m in out:
            if m["page"] and m["page"] != last:
                last = m["page"]
                text += f"\n# PAGE {last}\n\n"
            text += t[3:] if text.endswith(t[:3]) else t
        assert _context(spark, out, overlap=3) == text.strip()
