import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.llm import canonical, encoding, neardup, splitting
from textlode.llm.components import components

# ---------------------------------------------------------------- components


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (3, 1), (1, 2), (None, 3)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8, 9: 8} | {100 + i: 100 for i in range(61)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- formatting duplicates

RECORDS = [
    (1, "Hello, World 42"), (2, "hello world-42!"), (3, "HELLO\nWORLD 42"), (4, "hello world 43"),
    (5, "name: Ann\nage: 7\ntown: Ulm"), (6, "Town : ULM\n\nname:Ann\nage: 7,"), (7, '{"age": "7", "town": "Ulm", "name": "Ann"}'), (8, "name: 7\nage: Ann\ntown: Ulm"),
    (9, None), (10, ""), (11, "... !!"), (12, "— ?"), (13, "Straße"), (14, "STRASSE"), (15, "集合依赖。"), (16, "集合 依赖"),
    (17, "name Ann age 7 town Ulm"), (18, '{"a": [1, 2]}'), (19, '{"a": [2, 1]}'), (20, '{"b": {"x": 1, "y": 2}, "c": 3}'), (21, '{"c": 3, "b": {"y": 2, "x": 1}}'),
    (22, "a: 1\nb: 2"), (23, "b: 2\na: 1"), (24, "Q: one\nA: two\nQ: three"), (25, "Q: three\nA: two\nQ: one"), (26, "Hello, World 42"),
]


def test_formatting_duplicates(spark):
    df = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in RECORDS], "record_id long, page_content string, kept int, copies int, key string")
    got = {}
    for r in canonical.same_but_for_formatting(df, "record_id", "page_content").collect():
        got.setdefault(r["kept"], (r["copies"], set()))[1].add(r["record_id"])
    assert got == {1: (4, {1, 2, 3, 26}), 5: (4, {5, 6, 7, 17}), 13: (2, {13, 14}), 15: (2, {15, 16}), 20: (2, {20, 21}), 24: (2, {24, 25})}
    assert canonical.same_but_for_formatting(df.limit(0), "record_id", "page_content").count() == 0


def test_letters_that_tie_two_structures_together(spark):
    rows = [(1, "ab: c\nd: e\nf: g"), (2, "a: bc\nd: e\nf: g"), (3, "f: g\nd: e\na: bc"), (4, "f: g\nab: c\nd: e")]
    df = spark.createDataFrame(rows, "record_id long, page_content string")
    assert {(r["record_id"], r["kept"]) for r in canonical.same_but_for_formatting(df, "record_id", "page_content").collect()} == {(i, 1) for i in range(1, 5)}


def test_hot_group_of_formatting_duplicates(spark):
    rows = [(i, "Same TEXT!" if i % 3 == 0 else f"other {i}") for i in range(900)]
    out = canonical.same_but_for_formatting(spark.createDataFrame(rows, "record_id long, page_content string"), "record_id", "page_content").collect()
    assert len(out) == 300 and {(r["kept"], r["copies"]) for r in out} == {(0, 300)}


def test_digests(spark):
    rows = [(1, "AB-cd"), (2, "{abcd}"), (3, None), (4, ""), (5, ":"), (6, "a:b:c:d"), (7, "abce")]
    out = canonical.same_digest(spark.createDataFrame(rows, "row_seq long, digest string"), "row_seq", "digest").collect()
    assert {(r["row_seq"], r["kept"], r["copies"]) for r in out} == {(1, 1, 3), (2, 1, 3), (6, 1, 3)}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.text("xyz1 -", min_size=1, max_size=6), min_size=3, max_size=6), st.randoms())
def test_order_and_case_of_fields_dont_matter(fields, rng):
    names = list(fields)
    rng.shuffle(names)
    a = canonical.structure("\n".join(f"{k}: {v}" for k, v in fields.items()))
    b = canonical.structure(json.dumps({k.upper(): f" {fields[k]}." for k in names}, indent=1)) if len({k.upper() for k in names}) == len(names) else a
    assert a == b


def test_records_in_frames_and_with_other_line_ends(spark):
    fields = ["name: Ada", "role: admin", "team: blue"]
    back = fields[::-1]
    texts = ["\n".join(fields), "\n".join(["----", *back, "===="]), "\r".join(back), "\u2028".join(back), "\x85".join(back), "\x1e".join(back)]
    assert all(canonical.structure(x) for x in texts)
    df = spark.createDataFrame(list(enumerate(texts, 1)), "record_id long, page_content string")
    out = canonical.same_but_for_formatting(df, "record_id", "page_content").collect()
    assert {(r["record_id"], r["kept"]) for r in out} == {(i, 1) for i in range(1, len(texts) + 1)}


def test_long_names_and_deep_records_keep_their_fields():
    long = "n" * 300
    assert canonical.structure(f"{long}: 1\nb: 2\n3c: 4") == canonical.structure(f"3C: 4\nB: 2\n{long}: 1") is not None
    deep = '{"a": 1, "b": ' + "[" * 5000 + '{"x": "1", "y": 2}' + "]" * 5000 + "}"
    turned = '{"b": ' + "[" * 5000 + '{"y": 2, "x": 1}' + "]" * 5000 + ', "a": 1}'
    assert canonical.structure(deep) == canonical.structure(turned) is not None
    nested = '{"k": ' * 3000 + "1" + "}" * 3000
    assert canonical.structure(nested)[0] != canonical.structure(nested.replace("1", "2"))[0]
    assert canonical.structure('{"a": ' + "[" * 5000) is None and canonical.structure("{}") is None and canonical.structure('{"-": "-"}') is None and canonical.structure('{"u": ""}')
    # each name keeps its values, in any order
    assert canonical.structure("Q: one\nA: two\nQ: three") == canonical.structure("Q: three\nQ: one\nA: two")
    assert canonical.structure("Q: one\nA: two\nQ: three") != canonical.structure("Q: one\nA: three\nQ: two")


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text("ab\\n\"é", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", max_size=2), x, max_size=3), max_leaves=12))
def test_deep_parser_reads_what_json_does(value):
    text = json.dumps(value, indent=1)

    def plain(v):
        return {k: plain(x) for k, x in v.pairs} if isinstance(v, canonical._Fields) else [plain(x) for x in v] if isinstance(v, list) else v

    assert plain(canonical._parse_deep(text)) == json.loads(text, parse_int=str)
    with pytest.raises(ValueError):
        canonical._parse_deep(text + "]")


def test_a_record_of_a_million_lines(spark):
    log = "\n".join(f"2025-01-01 line {i}: done" for i in range(1_000_000))
    df = spark.createDataFrame([(1, log), (2, log.upper()), (3, "short: text")], "record_id long, page_content string")
    out = canonical.same_but_for_formatting(df, "record_id", "page_content").collect()
    assert {(r["record_id"], r["kept"], r["copies"]) for r in out} == {(1, 1, 2), (2, 1, 2)}


def test_digests_that_meet_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(canonical.F, "md5", lambda c: F.lit("00"))
    df = spark.createDataFrame([(1, "one text"), (2, "One, text"), (3, "other text"), (4, "OTHER text"), (5, "third"), (2, "One, text")], "record_id long, page_content string")
    out = canonical.same_but_for_formatting(df, "record_id", "page_content").collect()
    assert sorted((r["record_id"], r["kept"], r["copies"]) for r in out) == [(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 2), (4, 3, 2)]


# ---------------------------------------------------------------- splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \né!", max_size=900), st.integers(20, 120), st.integers(0, 9))
def test_pieces_cover_the_text(text, limit, overlap):
    text = text.strip()
    out = splitting.pieces(text, limit, overlap) if text else []
    at = 0
    for n, (s, c, e) in enumerate(out):
        assert e - s <= limit and c - s <= overlap and s <= c < e
        assert not text[at:c].strip() and (n > 0 or s == 0)
        at = e
    assert not text[at:].strip()


def test_cuts_fall_on_the_strongest_boundary():
    text = ("word " * 150).strip() + ".\n\n" + ("more " * 150).strip()
    (a, b) = splitting.pieces(text, 1000, 50)
    assert text[a[0] : a[2]].endswith("word.") and text[b[1] : b[2]].startswith("more") and 0 < b[1] - b[0] <= 50
    assert all(e - s <= 1500 for s, _, e in splitting.pieces("x" * 100_000))
    assert splitting.pieces("x" * 1500) == [(0, 0, 1500)]


def test_split_oversized_rows(spark):
    rows = [(1, " " * 2000 + "short"), (2, None), (3, "  \n"), (4, "long text here. " * 200), (5, "y" * 300_000), (4, "long text here. " * 200)]
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "record_id long, page_content string, piece_no int, piece string")
    out = splitting.split_oversized(df, "record_id", "page_content").collect()
    by = {i: [r for r in out if r["record_id"] == i] for i in range(1, 6)}
    assert [r["piece"] for r in by[1]] == ["short"] and not by[2] and not by[3] and len(by[5]) >= 200 and len(by[4]) % 2 == 0
    assert all(len(r["piece"]) <= 1500 for r in out) and all(r["n_pieces"] == len(by[5]) for r in by[5])
    assert splitting.split_oversized(df.limit(0), "record_id", "page_content").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "record_id", "page_content", 100, 100)


# ---------------------------------------------------------------- encodings

TEXTS = {
    "de": "Die Größe der Tür für die Übersicht prüft später das Gerät nämlich täglich über Bücher",
    "fr": "La règle crée l’hétérogénéité déjà bientôt après où la fête gère le résumé très tôt",
    "es": "El número añade la sección además según la canción así también el árbol está aquí",
    "ru": "Новый файл проверил большой отчёт сегодня потому что таблица содержит запись всегда",
    "pl": "Źródło łączy część wiadomości także ponieważ ścieżka mieści żółtą kartkę później",
    "en": "The naïve café “quotes” the price — €40… for ‘everyone’ who isn’t here",
}
WRONG = [("de", ("utf-8", "cp1252")), ("fr", ("utf-8", "latin-1")), ("es", ("utf-8", "mac_roman")), ("ru", ("utf-8", "cp1251")), ("en", ("utf-8", "cp1252")), ("ru", ("koi8-r", "cp1251")), ("pl", ("cp1250", "cp1252")), ("fr", ("cp1252", "cp1251")), ("de", ("utf-8", "cp437"))]


def _mixed(seed=1):
    rng = random.Random(seed)
    rows, bad = [], {}
    for i in range(400):
        lang = rng.choice(list(TEXTS))
        words = TEXTS[lang].split()
        rows.append([f"r{i:03d}", " ".join(rng.choice(words) for _ in range(30))])
    for k, (lang, step) in enumerate(WRONG):
        clean = " ".join(TEXTS[lang].split() * 2)
        garbled = encoding.garble(clean, (step,))
        rows.append([f"x{k:03d}", garbled])
        bad[f"x{k:03d}"] = clean
    twice = (("utf-8", "cp1252"), ("utf-8", "cp1252"))
    rows.append(["xtwice", encoding.garble(TEXTS["fr"], twice)])
    bad["xtwice"] = TEXTS["fr"]
    rows.append(["xlossy", TEXTS["de"].encode("latin-1").decode("utf-8", "replace")])
    part = TEXTS["en"] + " plain words then " + encoding.garble("naïve", (("utf-8", "cp1252"),))
    rows.append(["xpart", part])
    bad["xpart"] = TEXTS["en"] + " plain words then naïve"
    rows += [["n1", None], ["n2", ""], ["n3", "plain ascii"], ["n4", "Ελληνικά γράμματα εδώ"], ["n5", "集合依赖分块"]]
    return rows, bad


def test_garbled_rows_and_their_text(spark):
    rows, bad = _mixed()
    df = spark.createDataFrame([(u, t, "c", 1) for u, t in rows], "uuid string, document string, chain string, i int")
    out = {r["uuid"]: r for r in encoding.garbled(df, "uuid", "document").collect()}
    assert set(out) == set(bad) | {"xlossy"}
    right = sum(out[u]["restored"] == text for u, text in bad.items())
    assert right >= len(bad) - 1  # chains between one-byte encodings may leave a short word
    assert out["xlossy"]["chain"] == "lossy" and out["xlossy"]["n_restored"] == 0


def test_garbled_of_nothing(spark):
    df = spark.createDataFrame([], "uuid string, document string")
    assert encoding.garbled(df, "uuid", "document").count() == 0
    assert encoding.garbled(spark.createDataFrame([("a", "only ascii")], "uuid string, document string"), "uuid", "document").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc äöüßéèñ€“”…", min_size=1, max_size=30), st.sampled_from(encoding.CHAINS))
def test_what_restores_is_what_was_garbled(text, chain):
    bad = encoding.garble(text, chain)
    if bad is not None:
        back = encoding.restore(bad, chain)
        assert back is None or back == text


# ---------------------------------------------------------------- near duplicates


def brute_groups(rows, threshold, words, least):
    sets = {}
    for u, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(least, words):
            sets[u] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    parent = {u: u for u in sets}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for u in ids:
        groups.setdefault(root(u), set()).add(u)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def _near(seed=4, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 80))]
        rows.append((f"a{i:03d}", " ".join(text)))
        for k in range(rng.choice((0, 0, 1, 3))):  # a chain of edits
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((f"a{i:03d}-{k}", " ".join(text).upper() if k else ", ".join(text)))
    hot = [rng.choice(vocabulary) for _ in range(40)]
    rows += [(f"h{i:03d}", " ".join(hot)) for i in range(len(rows) // 2)]  # a third are copies of one text
    rows += [("n1", None), ("n2", ""), ("n3", "too short"), ("n4", "w1 " * 30), ("n5", "w1 " * 45), ("z", "x y z " * 5000), ("z2", "x y z " * 5000 + "q")]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = _near()
    df = spark.createDataFrame([(u, t, 1, "s") for u, t in rows], "uuid string, document string, rid int, sig string")
    out = neardup.near_duplicates(df, "uuid", "document", 0.6, 3, 12)
    groups = {}
    for r in out.collect():
        groups.setdefault(r["component"], set()).add(r["uuid"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(rows, 0.6, 3, 12)
    pairs = neardup.pairs_of(out, "uuid").collect()
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in groups.values()) and all(p["uuid_a"] < p["uuid_b"] for p in pairs)


def test_texts_with_common_boilerplate_are_not_all_compared(spark, monkeypatch):
    """Pairs that are compared grow with the rows, not with their square, though most of each text is common to all."""
    rng = random.Random(12)
    boilerplate = " ".join(f"common{i}" for i in range(60))
    compared = []
    whole = neardup._verify
    monkeypatch.setattr(neardup, "_verify", lambda pairs, *rest: (compared.append(pairs.count()), whole(pairs, *rest))[1])
    for n in (1000, 4000):
        rows = []
        for i in range(n):
            own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(55))
            rows.append((f"b{i:05d}", f"{boilerplate} {own}"))
            if i % 10 == 0:  # with one word changed
                rows.append((f"c{i:05d}", f"{boilerplate} {own} more"))
        df = spark.createDataFrame(rows, "uuid string, document string")
        groups = {}
        compared.clear()
        for r in neardup.near_duplicates(df, "uuid", "document", 0.6, 3, 12).collect():
            groups.setdefault(r["component"], set()).add(r["uuid"])
        assert sorted(map(sorted, groups.values())) == [[f"b{i:05d}", f"c{i:05d}"] for i in range(0, n, 10)]
        assert sum(compared) < 60 * len(rows)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "uuid string, document string")
    assert neardup.near_duplicates(df, "uuid", "document").count() == 0
    one = spark.createDataFrame([("a", "one two three four five six seven")], "uuid string, document string")
    assert neardup.near_duplicates(one, "uuid", "document").count() == 0


def test_signatures_agree_as_often_as_the_sets_do():
    import numpy as np

    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 62, 1600, dtype=np.uint64)
    a, b = neardup.signature(items[:1300]), neardup.signature(items[300:])
    assert abs((a == b).mean() - 1000 / 1600) < 0.15
    assert 0 < neardup.least_matches(0.6) < 0.6 * neardup.POSITIONS
