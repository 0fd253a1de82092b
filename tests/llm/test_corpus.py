import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.llm import mixing, packing, readability, scans, tokens

# ---------------------------------------------------------------- tokens

needs_vocabulary = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="needs the vocabulary file")


@needs_vocabulary
def test_token_counts_are_the_tokenizers(spark):
    texts = ["Hello world", "", None, "naïve café — 42\n\n  x", "a" * 5000, "it's we'll I'M", "集合依赖", "tabs\tand  spaces   "]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, "doc_id", "text", extra=("source",)).collect()}
    encode = tokens._encoding(tokens.VOCABULARY).encode_ordinary
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


# ---------------------------------------------------------------- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80), st.just(20))
def test_plans_place_every_item_once_within_capacity(lengths, capacity):
    histogram = Counter(lengths)
    runs = sorted(packing.plan(dict(histogram), capacity))
    load = Counter()
    for k, (length, rank, first, each) in enumerate(runs):
        same = k + 1 < len(runs) and runs[k + 1][0] == length
        for r in range(rank, runs[k + 1][1] if same else histogram[length]):
            load[first + (r - rank) // max(each, 1)] += length
    assert sum(load.values()) == sum(lengths) and all(v <= capacity for v in load.values())
    assert {r[0] for r in runs} == set(histogram)
    if sum(lengths):
        assert len([v for v in load.values() if v]) <= 11 / 9 * -(-sum(lengths) // capacity) + 6 / 9 + sum(x > capacity // 2 for x in lengths)


def _pack(spark, sizes, capacities):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens int, piece_no string")
    return packing.pack(df, "doc_id", "n_tokens", capacities).collect()


def test_packing_is_whole_and_cuts_only_what_is_too_long(spark):
    rng = random.Random(2)
    sizes = [rng.choice((5, 17, 64, 100, 250, 90)) if i % 3 else 33 for i in range(900)] + [0, None, 1000, 100]
    for name, capacity in (("small", 100), ("large", 400)):
        rows = [r for r in _pack(spark, sizes, {"small": 100, "large": 400}) if r["container_name"] == name]
        load, pieces = Counter(), defaultdict(list)
        for r in rows:
            load[r["container_no"]] += r["n_tokens"]
            pieces[r["doc_id"]].append((r["piece_no"], r["token_start"], r["n_tokens"]))
        assert set(pieces) == set(range(len(sizes))) and max(load.values()) <= capacity
        for i, s in enumerate(sizes):
            mine = sorted(pieces[i])
            assert sum(n for _, _, n in mine) == (s or 0) and (len(mine) == 1 or s > capacity)
            assert all(start == k * capacity for k, (_, start, _) in enumerate(mine))
        assert sum(load.values()) >= 0.97 * capacity * len(load)
    assert _pack(spark, [], {"small": 10}) == []
    with pytest.raises(ValueError):
        _pack(spark, [1], {"bad": 0})


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10_000_000), st.randoms(), st.integers(1, 60))
def test_places_are_those_of_the_plan_at_any_capacity(capacity, rng, kinds):
    histogram = Counter()
    for _ in range(kinds):
        histogram[min(capacity, int(capacity ** rng.random()) + rng.randrange(3))] += rng.randrange(1, 50)
    histogram = {n: c for n, c in histogram.items() if n <= capacity}
    places, load = packing.Places(packing.plan(histogram, capacity)), Counter()
    lengths = np.repeat(list(histogram), list(histogram.values())).astype("i8")
    ranks = np.concatenate([np.arange(c) for c in histogram.values()]).astype("i8")
    for container, n in zip(places.of(lengths, ranks).tolist(), lengths.tolist()):
        load[container] += n
    assert max(load.values()) <= capacity and sum(load.values()) == sum(n * c for n, c in histogram.items())
    assert set(load) == set(range(len(load)))


def test_packing_of_long_items(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 1_000_000) for _ in range(2000)] + [5_000_000, 2_500_001]
    load = Counter()
    rows = _pack(spark, sizes, {"long": 1_000_000})
    for r in rows:
        load[r["container_no"]] += r["n_tokens"]
    assert max(load.values()) <= 1_000_000 and sum(load.values()) == sum(sizes) and len(rows) == 2000 + 5 + 3
    assert sum(load.values()) >= 0.98 * 1_000_000 * len(load)


# ---------------------------------------------------------------- mixing


def test_water_filling():
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, 100) == {"a": 50, "b": 50}
    assert mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100) == pytest.approx({"a": 10, "b": 54, "c": 36})
    assert mixing.water_fill({"a": 0.9, "b": 0.1}, {"a": 5, "b": 7}, 100) == {"a": 5, "b": 7}
    assert mixing.water_fill({"a": 1.0, "b": 1.0}, {"a": 0, "b": 7}, 5) == {"a": 0.0, "b": 5}


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(3)
    rows = [(i, "big" if i % 3 == 0 else rng.choice(("mid", "small")) if i % 40 else None, rng.randrange(0, 400)) for i in range(3000)] + [(9001, "tiny", 50), (9002, "unwanted", 999)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.2, 2), ("mid", 0.5, 4), ("small", 0.2, 3), ("tiny", 0.1, 3), ("absent", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(sizes, targets, "doc_id", "source").collect()
    used = Counter()
    for r in out:
        used[r["source"]] += r["n_tokens"] * r["copies"]
        assert 1 <= r["copies"] <= {"big": 2, "mid": 4, "small": 3, "tiny": 3}[r["source"]]
    total = sum(n for _, s, n in rows if s in ("big", "mid", "small", "tiny"))
    assert used["tiny"] == 150
    rest = total - 150
    for s, w in (("big", 0.2), ("mid", 0.5), ("small", 0.2)):
        assert abs(used[s] - rest * w / 0.9) <= 401
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(sizes, targets, "doc_id", "source").collect()))
    report = {r["source"]: r for r in mixing.shares(mixing.mix(sizes, targets, "doc_id", "source"), sizes, targets, "source").collect()}
    assert set(report) == {"big", "mid", "small", "tiny", "absent"} and report["absent"]["share_reached"] == 0
    assert abs(sum(r["share_reached"] for r in report.values()) - 1) < 1e-9
    assert mixing.mix(sizes.limit(0), targets, "doc_id", "source").count() == 0
    assert mixing.mix(sizes, targets.limit(0), "doc_id", "source").count() == 0


def test_repeated_ids_are_drawn_apart(spark):
    sizes = spark.createDataFrame([(1, "s", 100), (1, "s", 100), (2, "s", 100)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    for total in (100, 200, 300, 400, 500):
        for seed in range(2):
            used = sum(r["n_tokens"] * r["copies"] for r in mixing.mix(sizes, targets, "doc_id", "source", total, seed).collect())
            assert abs(used - total) <= 100 and used <= total


# ---------------------------------------------------------------- reading levels

EASY = "the cat sat on a mat and the dog ran to the box".split()
HARD = "notwithstanding epistemological considerations the juxtaposition of heterogeneous paradigms exacerbates institutional ontology".split()


def _prose(rng, words, n, length):
    return " ".join((" ".join(rng.choice(words) for _ in range(length)) + ".").capitalize() for _ in range(n))


def test_levels_follow_the_labels(spark):
    rng = random.Random(4)
    docs, truth = [], {}
    for i in range(400):
        hard = i % 2 == 1
        docs.append((i, _prose(rng, HARD if hard else EASY, 8, 14 if hard else 7)))
        truth[i] = hard
    docs += [(1000, None), (1001, ""), (1002, "2025-01-01T10:00:00 INFO epistemological ontology\n" * 5), (1003, "| epistemological | 3 |\n|---|---|\n"), (1004, _prose(rng, HARD, 3000, 14)), (0, docs[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, slots string, label double")
    labels = spark.createDataFrame([(i, (5 if truth[i] else 1) + (-1 if truth[i] else 1) * (i % 5 == 0)) for i in range(0, 120)] + [(3, None), (None, 2)], "doc_id long, reading_level int")
    out = readability.reading_levels(df, labels, "doc_id", "text", "reading_level").collect()
    assert len(out) == len(docs)
    level = {r["doc_id"]: r["level"] for r in out}
    assert all((level[i] >= 4) == truth[i] for i in range(120, 400))
    assert [level[i] for i in (1000, 1001, 1002, 1003)] == [None] * 4 and level[1004] >= 4
    none = readability.reading_levels(df, labels.limit(0), "doc_id", "text", "reading_level")
    assert {r["level"] for r in none.collect()} == {None}
    assert readability.reading_levels(df.limit(0), labels, "doc_id", "text", "reading_level").count() == 0


def test_prose_is_told_from_the_rest():
    text = "# Heading 3\n\n<p>One short sentence here now. And another one follows!</p>\n\n- item with five words here\n| a | b |\n{\n\"k\": \"v\",\n}\n2025-10-10T09:20:09 INFO plan.page=464857 rejects it\nQ: what is the answer now"
    found = readability.prose_sentences(text)
    assert ["one", "short", "sentence", "here", "now"] in found and ["item", "with", "five", "words", "here"] in found
    assert ["what", "is", "the", "answer", "now"] in found and not any("rejects" in s or "heading" in s for s in found)


# ---------------------------------------------------------------- scans

WORDS = "retrieval document collection embedding threshold metadata inspection glossary transcript temporary encrypted scheduled duplicate secondary connection splitter attachment version minutes outside morning northern".split()


def _page(rng, n=14):
    return [rng.choice(WORDS) for _ in range(n)]


def _scans():
    rng = random.Random(6)
    rows, truth, key = [], set(), 0
    for _ in range(150):  # text that isn't scanned fills the word list
        rows.append((key, " ".join(_page(rng, 60)), None))
        key += 1
    for s in range(12):
        for page in range(4):
            words = _page(rng)
            lines = [" ".join(words[k : k + 4]) for k in range(0, 12, 4)]
            if page % 2 == 0:  # a cut word
                cut = rng.choice([w for w in WORDS if len(w) > 6])
                lines[0] += f" {cut[:4]}{'-‐¬'[s % 3]}"
                lines[1] = f"{cut[4:]} {lines[1]}"
                truth.add((key, "hyphen"))
            if page == 1:
                word = next(w for w in words[:12] if "e" in w)
                lines = "\n".join(lines).replace(word, word.replace("e", "c", 1), 1).split("\n")
                truth.add((key, "misread"))
            header = "Quarterly Glossary Handbook" if page != 3 else "QUARTERLY GLOSSARY HANDBOOK"
            body = [header, "", *lines, "", f"   - {20 + page} -" if s % 2 else f"{20 + page}"]
            truth |= {(key, "header"), (key, "page_number")}
            rows.append((key, "\n".join(body), f'{{"source": "/up/{s}.pdf", "page": {page}}}'))
            key += 1
    clean = [(key, "A title of its own\n\n" + " ".join(_page(rng)) + "\n505\n1296", '{"source": "/up/d.pdf", "page": 0}'), (key + 1, " ".join(_page(rng)), '{"source": "/up/d.pdf", "page": 1}')]
    odd = [(key + 2, None, '{"page": 1}'), (key + 3, "", '{"page": 1, "source": "x"}'), (key + 4, "7", "{"), (key + 5, "Quarterly Glossary Handbook\n21", '{"page": "x"}')]
    return rows + clean + odd, truth


def test_scan_traces_and_repair(spark):
    rows, truth = _scans()
    df = spark.createDataFrame([(i, t, m, "w", 1) for i, t, m in rows], "record_id long, page_content string, metadata string, w string, page int")
    got = {(r["record_id"], r["kind"]) for r in scans.traces(df, "record_id", "page_content", "metadata").collect()}
    hits = len(got & truth)
    assert hits >= 0.95 * len(truth) and hits >= 0.95 * len(got), (sorted(truth - got)[:5], sorted(got - truth)[:5])
    text = scans.repaired(df, "record_id", "page_content", "metadata").where("source <> '/up/d.pdf'").collect()
    joined = " ".join(r["text"] for r in text).lower()
    assert not any(h in joined for h in "‐¬") and "quarterly glossary handbook" not in joined
    assert set(joined.replace("-", " ").split()) <= set(WORDS) | {"glossary"}
    assert scans.traces(df.limit(0), "record_id", "page_content", "metadata").count() == 0


def test_word_across_pages_and_roman_numbers(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(_page(rng, 60)), None) for i in range(60)]
    rows += [(100, "Some words stand here for the collec-\n   xiv", '{"source": "s", "page": 0}'), (101, "   xv\ntion of documents. The end.", '{"source": "s", "page": 1}')]
    df = spark.createDataFrame(rows, "record_id long, page_content string, metadata string")
    got = {(r["record_id"], r["kind"]) for r in scans.traces(df, "record_id", "page_content", "metadata").collect()}
    assert {(100, "hyphen"), (100, "page_number"), (101, "page_number")} <= got
    out = scans.repaired(df, "record_id", "page_content", "metadata").collect()
    assert [r["text"] for r in out] == ["Some words stand here for the collection of documents. The end."]
    assert scans.roman("xiv") == 14 and scans.roman("xlix") == 49 and scans.roman("abc") is None


def test_look_alikes():
    assert scans.core("rnodern") == scans.core("modern") and scans.core("fi1e") == scans.core("ﬁle")
    assert scans.explain("modern", "rnodcrn") == (2, 0) and scans.explain("modern", "modern") == (0, 0)
    assert scans.explain("cat", "dog")[1] > 0 and scans.explain("cat", "cats") == (0, 1)


def test_headers_recur_in_other_readings(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(_page(rng, 60)), None) for i in range(60)]
    titles = [("Incoming Index", "lncoming lndex"), ("Printing Handbook", "pr1nting handbook"), ("Northern Threshold Glossary", "Northern Threshld Glossary"), ("Duplicate Metadata Manual", "Duplicate Metadata Manual l2")]
    for s, pair in enumerate(titles):
        for page, title in enumerate(pair):
            lines = [" ".join(_page(rng, 4)) for _ in range(8)]
            rows.append((100 + 2 * s + page, "\n".join([title, "", *lines]), f'{{"source": "/up/{s}.pdf", "page": {page}}}'))
    df = spark.createDataFrame(rows, "record_id long, page_content string, metadata string")
    parsed = scans.analyse(df, "record_id", "page_content", "metadata")["furniture"].where("header").select("record_id", "at").collect()
    assert {tuple(r) for r in parsed} == {(100 + k, 1) for k in range(2 * len(titles))}


def test_every_look_alike_of_a_word_finds_it(spark):
    rng = random.Random(3)
    words = [w + x for w in WORDS for x in ("", "ing", "hood")] + ["reconstruction", "highthroughhatch", "lubrication", "tsrlcc", "strlct", "nlcts"]
    counts, truth = {w: 1000 for w in words}, {}

    def read(word, times):
        for _ in range(times):
            at, a, b = rng.choice([(i, a, b) for a, b in scans.LOOK_ALIKES for i in range(len(word)) if word.startswith(a, i)])
            word = word[:at] + b + word[at + len(a) :]
        return word

    for w in words:
        for times in (1, 2, 4):
            r = read(w, times)
            assert scans.core(r) == scans.core(w), (w, r)
            if r not in counts and scans.explain(w, r)[1] == 0:
                truth[r] = w
        at = rng.randrange(1, len(w) - 1)  # one sign that no list has, beside any number of look-alikes
        r = read(w, 2)
        at = rng.randrange(len(r))
        truth.setdefault(r[:at] + "%" + r[at + 1 :], w)
    truth |= {"reconstriiction": "reconstruction", "liiglitliroughhatcli": "highthroughhatch"}
    counts |= {r: 1 for r in truth}
    df = spark.createDataFrame(list(counts.items()), "w string, n long")
    all_of_them = scans.Ranker([])
    all_of_them.trees.fitted = [(5.0,)]
    got = {r["w"] for r in scans.misread_words(df, all_of_them).collect()}
    lost = {r for r in truth if r not in got}
    assert not {r for r in lost if "%" not in r} and len(lost) < 0.1 * len(truth)  # a sign for a letter of many strokes is a larger change


def test_the_ranker_tells_misread_words_from_rare_ones():
    rng = random.Random(4)
    # words as usual ones are: letters follow each other as in others
    words = sorted({rng.choice(("re", "in", "con", "de", "pro", "ex", "sub")) + rng.choice(("tain", "fer", "mit", "struct", "form", "vert", "port", "tend")) + rng.choice(("", "ed", "ing", "ment", "ation", "s", "or", "able")) for _ in range(900)})
    counted = [(w, rng.randrange(50, 5000)) for w in words]
    ranker = scans.fit_ranker(counted[::2])
    held = [(w, n) for w, n in counted[1::2]]
    bad = [(b, w, n) for w, n in held if (b := scans.misread(w, rng)) and b != w]
    hits = ranker.score([b for b, _, _ in bad], [w for _, w, _ in bad], np.full(len(bad), 2.0), np.array([n for *_, n in bad], "f8")) >= 0.5
    assert hits.mean() > 0.93
    kept = [(w + x, w, n) for w, n in held for x in ("s", "ed", "7")] + [(w[:-1], w, n) for w, n in held]
    wrong = ranker.score([b for b, _, _ in kept], [w for _, w, _ in kept], np.full(len(kept), 2.0), np.array([n for *_, n in kept], "f8")) >= 0.5
    assert wrong.mean() < 0.03


def test_all_words_of_the_table_take_part_in_the_fits(spark, monkeypatch):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("bdfgklmprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)})
    compounds = [f"{a}-{b}" for a, b in zip(words[:60], words[60:])]
    text = " ".join(w for w in words for _ in range(25)) + " " + " ".join(compounds * 6)
    df = spark.createDataFrame([(k, text, None) for k in range(2)], "record_id long, page_content string, metadata string")
    listed = [(w, 50 + 12 * (k < 120)) for k, w in enumerate(words)]
    seen = {}
    monkeypatch.setattr(scans, "WORDS", 150)  # a bound far below the number of words
    monkeypatch.setattr(scans, "misread_words", lambda counts, ranker: seen.update(ranker=ranker) or counts)
    monkeypatch.setattr(scans, "furniture", lambda edges, weights, often: seen.update(header=weights[0], often=often) or edges)
    monkeypatch.setattr(scans, "cuts", lambda parsed, counts, weights: seen.update(joins=weights) or parsed)
    scans.analyse(df, "record_id", "page_content", "metadata")
    assert seen["often"] == Counter(g for w, _ in listed for g in scans._grams(scans.core(w)))
    want = scans.Ranker(listed).logs
    assert seen["ranker"].logs.keys() == want.keys() and all(abs(seen["ranker"].logs[p] - v) < 1e-4 for p, v in want.items())
    bad = [(b, w) for w in words if (b := scans.misread(w, rng)) and b != w]
    score = seen["ranker"].score([b for b, _ in bad], [w for _, w in bad], np.full(len(bad), 2.0), np.full(len(bad), 50.0))
    assert (score >= 0.5).mean() > 0.95 and seen["joins"].shape == (9,) and seen["header"].shape == (8,)

    made = []
    stage = scans.stage
    monkeypatch.setattr(scans, "stage", lambda rows, *by: made.append(stage(rows, *by)) or made[-1])
    counts = spark.createDataFrame([*listed, *((c, 12) for c in compounds)], "w string, n long")
    first = scans.fit_words(counts)
    rows = made[0].where("what = 'cut'").collect()
    assert {r["words"][0] for r in rows if r["y"]} - {None} <= set(words) and {r["words"][1] for r in rows if r["y"]} <= {w[:k] for w in words for k in range(2, 8)}
    assert sum(r["y"] for r in rows) == len(words) and {r["words"][3] for r in rows} >= set(compounds)
    misread = made[0].where("what = 'misread'").count()
    assert misread > 10 * len(words) and made[0].where("what = 'header'").groupBy().sum("n").first()[0] > 7 * len(words)
    again = scans.fit_words(counts.repartition(7))
    assert again[0].trees.fitted == first[0].trees.fitted and (again[1] == first[1]).all() and (again[2] == first[2]).all() and again[3] == first[3]


def test_counted_rows_fit_as_repeated_ones_do():
    rng = np.random.default_rng(2)
    x, n = rng.integers(0, 6, (300, 3)).astype("f8"), rng.integers(1, 5, 300)
    y = ((x[:, 0] > 2) & (x[:, 1] > 1) | (rng.random(300) < 0.1)).astype("f8")
    often = np.repeat(np.arange(300), n)
    cuts = [np.arange(5.0)] * 3
    one = scans.Boosted().fit_counted(scans.binned(x, cuts), y, n.astype("f8"), cuts)
    all_rows = scans.Boosted().fit_counted(scans.binned(x[often], cuts), y[often], np.ones(len(often)), cuts)
    assert np.allclose(one.score(x), all_rows.score(x))
    assert np.allclose(scans.logistic(x, y, n=n.astype("f8")), scans.logistic(x[often], y[often]))
    for values in (rng.normal(0, 3, 5001), rng.integers(0, 4, 700).astype("f8"), np.log1p(rng.integers(0, 300, 999)), np.array([2.5])):
        steps = np.stack(np.unique(np.floor(values * scans.GRID), return_counts=True), 1)
        some = values[np.isin(np.floor(values * scans.GRID), scans._steps_of_quantiles(steps))]
        got = scans._quantiles(steps, np.stack(np.unique(some, return_counts=True), 1))
        assert np.allclose(got, np.unique(np.quantile(values, np.linspace(0.05, 0.95, scans.CUTS))), rtol=0, atol=1e-12)


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype("f8")
    model = scans.Boosted().fit(x[:400], y[:400])
    assert ((model.score(x[400:]) > 0.5) == y[400:]).mean() > 0.95
