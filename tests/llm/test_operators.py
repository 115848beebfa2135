"""Each corpus operator against its plain version, with nulls, ties, repeats and clashes."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import clashing, contamination, documents, fingerprint, identifiers, long_repeats, near_components, vector_links
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, lines, long_matches, packing, pii, simhash, toxicity, url_rules
from tidemark.llm import vector_links as vectors

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(n, seed=0, letters="aeiostrn"):
    own = random.Random(seed)
    return " ".join("".join(own.choice(letters) for _ in range(own.randrange(1, 7))) for _ in range(n))


# 1, lines


@pytest.fixture(scope="module")
def lined():
    a, b, c = (words(12, i) for i in range(3))
    return [f"{a}\nshort line\n{b}", f"{b.upper()}\n{a}  ", None, "", f"x\n{c}", f"{a}\nshort line\n{b}", f"{c}\n{c}"]


def plain_units(text):
    """Lines and paragraphs with text: kind, first line, lines, begin, end, words, normalised."""
    out, at, run = [], 0, []
    for unit, line in enumerate([*(text or "").split("\n"), ""]):
        plain = re.sub("[ \t]+", " ", line.lower()).strip()
        if plain:
            run.append((unit, at, at + len(line), plain))
            out.append(("line", unit, 1, at, at + len(line), [(unit, plain.count(" ") + 1)], plain))
        else:
            if len(run) > 1:
                out.append(("paragraph", run[0][0], len(run), run[0][1], run[-1][2], [(u, p.count(" ") + 1) for u, _, _, p in run], " ".join(p for *_, p in run)))
            run = []
        at += len(line) + 1
    return out


def plain_repeats(texts, ids):
    by_text: dict = {}
    for i, text in enumerate(texts):
        for unit in plain_units(text):
            by_text.setdefault(unit[-1], []).append((ids[i], i, unit))
    gone = []
    for own in by_text.values():
        own.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2][3]))
        gone += [(*x, own[0][0], own[0][2][3]) for x in own[1:]]
    out = set()
    for i, text in enumerate(texts):
        places = [u for kind, u, *_ in plain_units(text) if kind == "line"]
        words = {places.index(u): w for _, row, unit, *_ in gone if row == i for u, w in unit[5]}
        stretch = {}
        for p in words:
            ends = [next(q for q in range(p, sign * 10**6, sign) if q + sign not in words) for sign in (-1, 1)]
            stretch[p] = sum(words[q] for q in range(ends[0], ends[1] + 1))
        for doc, row, (kind, u, n, a, b, own, _), kept, start in gone:
            if row == i:
                out.add((doc, kind, u, n, a, b, kept, start, sum(w for _, w in own), stretch[places.index(u)], max(stretch.values())))
    return out


def test_repeated_lines_have_their_places(spark, lined):
    ids = [5, 3, 1, None, 4, 6, None]
    got = {tuple(r) for r in lines.repeated_lines(clashing(spark, lined, ids)).collect()}
    assert got == plain_repeats(lined, ids)


@pytest.mark.parametrize("share", [1.0, 1e-9])
def test_paragraphs_meet_copies_wrapped_elsewhere(spark, monkeypatch, share):
    monkeypatch.setattr(lines, "HOT_SHARE", share)
    a, b = words(30, 1).split(" "), words(9, 2)
    wrapped = ["\n".join(" ".join(a[i : i + n]) for i in range(0, 30, n)) for n in (30, 7, 11)]
    texts = [f"{b}\n\n{wrapped[0]}\n \t\n{b}", f"x\n\n{wrapped[1]}\n\n{b}", wrapped[2], f"{b}\n{b}\n\n\n{b}\n{b}", None, "", "\n\n", words(20_000, 3) + f"\n{b}"]
    own = [*texts, *texts[:1]]
    ids = list(range(len(own)))
    assert {tuple(r) for r in lines.repeated_lines(documents(spark, own, ids)).collect()} == plain_repeats(own, ids)
    kept = {r[0]: r[1] for r in lines.without_repeats(documents(spark, own, ids)).collect()}
    assert kept[2] == "" and kept[1] == "x\n\n" and kept[4] is None and kept[7] == own[7].split("\n")[0]


def test_no_lines(spark):
    assert lines.repeated_lines(documents(spark, [])).collect() == []
    assert lines.without_repeats(documents(spark, [])).collect() == []


def test_cut_lines_leave_other_columns(spark, lined):
    docs = clashing(spark, lined)
    got = lines.without_repeats(docs)
    assert got.columns == docs.columns
    texts = {r[0]: r[1] for r in got.collect()}
    assert texts[0] == lined[0] and texts[2] is None and texts[3] == "" and texts[1] == ""
    assert texts[4] == lined[4] and texts[6] == "" and texts[5] == ""


def test_every_line_with_text_may_repeat(spark):
    han = "\u6240\u6709\u6743\u5229\u4fdd\u7559" * 40
    texts = [f"les.\n\n{han}\n \t\nx", f"Les. \n\n{han}\n\t"]
    got = {(r.doc_id, r.unit) for r in lines.repeated_lines(documents(spark, texts)).collect()}
    assert got == {(1, 0), (1, 2)}
    assert [r[1] for r in sorted(lines.without_repeats(documents(spark, texts).select("doc_id", "text")).collect())] == [texts[0], "\n\t"]


# 2, decontamination


def test_occurrences_equal_plain_search(spark):
    random.seed(3)
    items = [(i, " ".join(random.choice("abcd") for _ in range(random.choice([0, 1, 5, 13, 14, 30])))) for i in range(40)] + [(50, None), (51, "É1 x"), (2, "b a")]
    texts = [" ".join(random.choice("abcdz") for _ in range(random.randrange(0, 120))) for _ in range(60)]
    texts += [None, "", "..", items[5][1], "é1 X é1", f"A {items[7][1]}-{items[8][1]}!", words(3000)]
    benchmark = spark.createDataFrame([(*x, "extra") for x in [*items, (None, "a")]], "item_id long, text string, n_words string")
    for docs in (documents(spark, texts), clashing(spark, texts)):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, benchmark).collect()}
        assert got == dict(enumerate(contamination(texts, items)))


def test_phrases_in_several_passes_give_the_same(spark, monkeypatch):
    items = [(i, words(20, i)) for i in range(6)]
    texts = [words(5, 90) + " " + items[i % 6][1] + " " + items[(i + 1) % 6][1] for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(decontaminate.contamination(documents(spark, texts), benchmark).collect())
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 100)
    assert sorted(decontaminate.contamination(documents(spark, texts), benchmark).collect()) == once
    assert {x.n_hit for x in once} == {40}


def test_text_item_ids_and_no_documents(spark):
    phrase = words(13, 4)
    benchmark = spark.createDataFrame([("b", phrase), ("a", phrase), ("10", None), (None, phrase)], "item_id string, text string")
    got = decontaminate.contamination(documents(spark, [phrase, "x", words(30_000, 8) + " " + phrase]), benchmark).collect()
    assert {r.doc_id: r["items"] for r in got} == {0: ["a", "b"], 1: [], 2: ["a", "b"]}
    assert decontaminate.contamination(documents(spark, []), benchmark).collect() == []
    assert decontaminate.clean(documents(spark, []), benchmark).collect() == []


def test_character_spans_hold_the_words(spark):
    phrase = words(13, 4)
    text = f"É (x) {phrase.upper()}. End"
    row = decontaminate.contamination(documents(spark, [text]), spark.createDataFrame([(1, phrase)], "item_id long, text string")).first()
    assert [text[s.start : s.end] for s in row.characters] == [phrase.upper()]


def test_no_benchmark_means_clean(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = clashing(spark, ["a b", None])
    assert sorted(r[0] for r in decontaminate.clean(docs, empty).collect()) == [0, 1]


# 3, URL rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.com", "", "allow"), ("example.com", "/de/x", "allow"), ("", "/", "block"), (None, "/", "block")]


def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules_equal_plain_search(spark):
    random.seed(4)
    hosts = ["net", "NET", "x.net", "xnet", "example.net", "b.Example.net", "example.com", "a.example.com", "c.a.example.com", "org", "o.org", "net.", ".net", "a..net", "", "é.org", "net:80"]
    paths = ["", "/", "/en/", "/en", "/de/", "/de/xy", "/fr/1", "//x", "/EN/"]
    urls = [f"{random.choice(['http', 'https', 'ftp:x'])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?a=/en/", "#/de/")]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "http://net/\n"] + ["http://hot.example.net/en/1"] * 300
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, HOST string").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}


def test_rules_run_without_python(spark):
    plan = url_rules.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", text)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/"), (None, None)], "page_id long, url string")
    assert {tuple(r) for r in url_rules.judge(pages, none).collect()} == {(1, "net", "/", None, "allow"), (None, "", "", None, "allow")}
    assert url_rules.judge(pages.limit(0), none).collect() == []


# 4, packing


def test_pieces_rebuild_every_document(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = [words(50, i) for i in range(30)] + [words(6000, 99), None, "", "x" * 9000, "<|endoftext|>a <|startoftext|>", "I'm  DON'T\tit\x1cs, ｆ. É́ e.\x85", "Ünï, çode. İI ςΣ Σ.", words(50, 1)]
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [packing.END] for i, t in enumerate(texts)}
    rows = packing.pack(clashing(spark, texts), TOKENIZER, window=256).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and r.start == len(got.setdefault(r.doc_id, [])) and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        got[r.doc_id] += own
    assert got == ids
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    ends = [s * 256 + o for s, o, _ in places] + [sum(map(len, ids.values()))]
    assert all(a + n == b for a, (_, _, n), b in zip(ends, places, ends[1:], strict=False)) and all(o + n <= 256 for _, o, n in places)


def test_nothing_to_pack(spark):
    assert packing.pack(documents(spark, []), TOKENIZER).collect() == []


def test_small_word_table_gives_the_same(monkeypatch):
    texts = [words(300, i) for i in range(6)]
    want, sizes = (x.tolist() for x in packing.WordIds(TOKENIZER)(texts))
    assert sum(sizes) == len(want)
    monkeypatch.setattr(packing, "CACHED_WORDS", 10)
    assert [x for t in texts for x in packing.WordIds(TOKENIZER)([t])[0].tolist()] == want


# 5, toxicity


def toxic_rows():
    texts = [words(40, i) + (" you utter wretchling" if i % 4 == 0 else " thank you") for i in range(400)]
    return texts, [(i, 1, int(i % 4 == 0)) for i in range(400)]


def test_toxic_words_are_learnt_and_undisguised(spark):
    texts, marks = toxic_rows()
    texts += ["what a wr3tchl1ng you are", "a w r e t c h l i n g here", "wretchliiiing!!", "", None, words(30, 900), words(4000, 901)]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(clashing(spark, texts), labels).collect()}
    assert all(got[i].predicted == t for i, _, t in marks)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert [got[400 + i].predicted for i in range(7)] == [1, 1, 1, 0, 0, 0, 0]
    assert got[403].score == got[404].score


@pytest.fixture(scope="module")
def trigrams(spark):
    return toxicity.language_model(documents(spark, ["stupid idiot function hello you are a thing " * 20]))


DISGUISED_WORDS = [
    ("st" + "u" * 300 + "pid", "stupid"),
    ("$t" + "u" * 300 + "p1d", "stupid"),
    ("1d10t)", "idiot)"),
    ("x/1d10t", "x/idiot"),
    ("\u201c1d10t\u201d", "\u201cidiot\u201d"),
    ("1d10t\u2026", "idiot\u2026"),
    ('"i d i o t"', '"idiot"'),
    ("(i.d.i.o.t)", "(idiot)"),
    ("i  d  i  o  t", "idiot"),
    ("h\u20acllo", "hello"),
    ("h \u20ac l l o", "hello"),
    ("(1d10t)", "(idiot)"),
    ("<hello>", "<hello>"),
    ("function(hello)", "function(hello)"),
    ("i d i o t  y o u", "idiot  you"),
]


@pytest.mark.parametrize(("text", "want"), DISGUISED_WORDS)
def test_disguised_words_of_any_length_and_bounds(trigrams, text, want):
    assert toxicity.restore(text, trigrams, 3.0) == want


@pytest.mark.parametrize("text", ["a1" * 50_000, "a$b(" * 25_000, "a " * 50_000, "a" + "-" * 100_000, "aaa" + "1" * 100_000])
def test_long_stretches_are_decoded_in_little_time(trigrams, text):
    toxicity.restore(text, trigrams, 3.0)


def test_held_out_labels_teach_nothing(spark):
    texts, marks = toxic_rows()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in marks]
    scores = []
    for own in (marks, turned):
        labels = spark.createDataFrame(own, "doc_id long, quality int, toxic int")
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(documents(spark, texts), labels).collect()))
    assert scores[0] == scores[1]


def test_no_labels_score_low(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.1 for r in toxicity.score(documents(spark, ["a b", None, ""]), labels).collect())
    assert toxicity.score(documents(spark, []), labels).collect() == []


# 6, long matches


def repetitive_texts():
    own = random.Random(2)

    def some(n, letters="abcdef "):
        return "".join(own.choice(letters) for _ in range(n))

    base, texts = [some(own.randrange(300, 2000)) for _ in range(8)], []
    for _ in range(60):
        kind, first = own.random(), own.choice(base)
        if kind < 0.3:
            texts.append(first)
        elif kind < 0.6:
            cut = list(first)
            for _ in range(own.randrange(1, 5)):
                cut[own.randrange(len(cut))] = own.choice("xyzé")
            texts.append("".join(cut))
        elif kind < 0.75:
            texts.append("abcdefg" * own.randrange(10, 200) + some(50) + "q" * own.randrange(300, 900))
        else:
            at = own.randrange(0, len(first) - 250)
            texts.append(some(200) + first[at : at + own.randrange(250, 700)] + some(200) + ("q" + some(430, "mn")) * own.randrange(0, 3))
    return [*texts, None, "", "a" * 399, "b" * 400, "é" * 201, "é" * 201]


@pytest.mark.parametrize("crowded", [1000, 2])
def test_long_matches_equal_plain_count(spark, monkeypatch, crowded):
    monkeypatch.setattr(long_matches, "CROWDED", crowded)
    texts = repetitive_texts()
    found = long_matches.without_repeats(clashing(spark, texts))
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), r.sha) for r in found.withColumn("sha", F.sha2("kept", 256)).collect()}
    assert got == dict(enumerate(long_repeats(texts, 400)))


def test_repeated_rows_match_each_other(spark):
    text = words(200)
    docs = documents(spark, [text, text, words(100, 8), words(100, 9)], ids=[7, 7, None, None])
    got = sorted((r.doc_id or 0, len(r.kept)) for r in long_matches.without_repeats(docs).collect())
    assert got == sorted([(7, 0), (7, 0), (0, len(words(100, 8))), (0, len(words(100, 9)))])


# 7, SimHash


def near_texts():
    own = random.Random(6)
    texts = []
    for i in range(12):
        base = words(400, i).split()
        for _ in range(4):
            new = list(base)
            for _ in range(own.randrange(0, 3)):
                new[own.randrange(len(new))] = "new"
            texts.append(" ".join(new))
    return [*texts, None, "", " \t", "one", "One", "two words", texts[0], words(4000, 77)]


def test_components_equal_plain_comparison(spark):
    texts = near_texts()
    ids = [3 * i % 59 for i in range(len(texts))]
    prints = [fingerprint(t, 4) for t in texts]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(clashing(spark, texts, ids), 4, 4).collect()}
    assert got == {i: (p, c) for i, p, c in zip(ids, prints, near_components(ids, prints, 4), strict=True)}


def test_close_fingerprints_link_in_large_units_and_blocks(spark, monkeypatch):
    own = random.Random(8)
    centre, values = own.getrandbits(64), set()
    while len(values) < 300:
        value = centre
        for _ in range(own.randrange(0, 9)):
            value ^= 1 << own.randrange(64)
        values.add(value)
    values = sorted(values)
    want = near_components(list(range(300)), values, 4)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for block in (8192, 40):
        monkeypatch.setattr(simhash, "BLOCK", block)
        place = {v - (1 << 64) if v >> 63 else v: i for i, v in enumerate(values)}
        links = [(place[r.a], place[r.b]) for r in simhash.near_links(fps, 4).collect()]
        assert all(bin(values[a] ^ values[b]).count("1") <= 4 for a, b in links)
        root = list(range(300))
        for _ in range(300):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert root == want


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    docs = clashing(spark, [*texts, texts[5]], [*range(len(texts)), 5])
    got = simhash.one_of_each(docs, 4, 4)
    assert got.columns == docs.columns
    prints = [fingerprint(t, 4) for t in texts]
    assert sorted(r[0] for r in got.collect()) == sorted(set(near_components(list(range(len(texts))), prints, 4)))


# 8, language

TONGUES = {"aa": "abcde", "bb": "fghij", "cc": "acegi"}


def spoken():
    texts, langs = [], []
    for i in range(240):
        tongue = sorted(TONGUES)[i % 3]
        texts.append(words(60, i, TONGUES[tongue]))
        langs.append(tongue)
    return texts, langs


def test_held_out_languages_are_recognised(spark):
    texts, langs = spoken()
    docs = documents(spark, [*texts, None, "", "12 34", "1a!", words(9000, 3, "abcde")], langs=[*langs, "aa", "bb", None, "cc", "aa"])
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].lang_pred == x for i, x in enumerate(langs) if got[i].held_out]) > 0.97
    assert [got[240 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[243].lang_pred in TONGUES and got[244].lang_pred == "aa"
    assert all(got[240 + i].rejected and got[240 + i].score == 0 for i in range(3)) and all(0 <= r.score <= 1 for r in got.values())


def test_held_out_languages_teach_nothing(spark):
    texts, langs = spoken()
    turned = ["aa" if zlib.crc32(str(i).encode()) % 5 == 0 else x for i, x in enumerate(langs)]
    runs = [sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify(documents(spark, texts, langs=own)).collect()) for own in (langs, turned)]
    assert runs[0] == runs[1]


def test_nothing_to_learn_from_is_undetermined(spark):
    docs = documents(spark, ["abc", None], langs=[None, None])
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert language.identify(documents(spark, [])).collect() == []


def test_accepted_rows_keep_their_columns(spark):
    texts, _ = spoken()
    docs = clashing(spark, [*texts, None, "7"])
    got = language.accepted(docs)
    assert got.columns == docs.columns and sorted(r[0] for r in got.collect()) == list(range(240))


def test_the_rejection_keeps_the_share_it_names():
    own = np.random.default_rng(5)
    for n, share in ((800, 0.995), (500, 0.9)):
        lost = []
        for _ in range(300):
            scores = own.beta(8, 1, n + 1)
            lost.append(scores[-1] < language.rejection(scores[:-1], share))
        assert np.mean(lost) <= 1 - share + 0.03
    scores = np.linspace(0.1, 0.9, 799)
    assert language.rejection(scores, 0.995) == scores[3] and language.rejection(scores[::-1].copy(), 0.5) == scores[399]
    assert language.rejection(scores[:198], 0.995) == 0.0 and language.rejection(scores[:0], 0.995) == 0.0


def test_the_rejection_prefers_wrong_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'").collect()
    right = [r.rejected for r in rows if r.lang == r.lang_pred]
    wrong = [r.rejected for r in rows if r.lang is not None and r.lang != r.lang_pred]
    assert 0 < np.mean(right) < 0.015 and (not wrong or np.mean(wrong) > 10 * np.mean(right))


# 9, vectors


def vector_rows():
    own = np.random.default_rng(3)
    rows = []
    for centre in own.normal(size=(25, 16)):
        rows += [(centre + own.normal(size=16) * s).tolist() for s in (0, 0.05, 0.1, 0.2, 0.2, 1)]
    rows += [rows[0], rows[0], [2 * x for x in rows[6]], None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0], [2.0], []]
    return [(i, v, None if i % 50 == 7 else i // 75) for i, v in enumerate(rows)]


def test_links_equal_plain_comparison(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, v int, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table).collect()}
    assert got == {i: x for (i, _, _), x in zip(rows, vector_links(rows, 0.98), strict=True)}


def test_many_shards_and_blocks_find_most_links(spark):
    own = np.random.default_rng(4)
    centres = own.normal(size=(300, 12))
    rows = [(i, (centres[i % 300] + own.normal(size=12) * 0.08).tolist(), 0) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    settings = vectors.Settings(shard_rows=60)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table, settings).collect()}
    want = {i: n for (i, _, _), (n, _) in zip(rows, vector_links(rows, 0.98), strict=True)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.9 * sum(want.values())


def test_labels_under_the_bound_are_compared_in_full(spark):
    own = np.random.default_rng(6)
    centres = own.normal(size=(150, 12))
    rows = [(i, (centres[i % 150] + own.normal(size=12) * 0.08).tolist(), i % 2) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    settings = vectors.Settings(shard_rows=20, overlap=1, tries=1)
    got = vectors.near_duplicates(table, settings).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: n for (i, _, _), (n, _) in zip(rows, vector_links(rows, 0.98), strict=True)}
    assert {r.audited_recall for r in got} == {1.0}


def test_audit_counts_vectors_and_says_when_it_knows_nothing(spark):
    own = np.random.default_rng(7)
    hot, small = own.normal(size=16), own.normal(size=(20, 16))
    rows = [(i, 16, i, (hot + own.normal(size=16) * 0.01).tolist()) for i in range(100)]
    rows += [(0, 16, 100 + i, (small[i // 2] + own.normal(size=16) * 0.01).tolist()) for i in range(40)]
    table = spark.createDataFrame([(0, *r[1:]) for r in rows], "label int, dim int, group long, v array<double>")
    links = spark.createDataFrame([(a, b) for a in range(100) for b in range(a)], "a long, b long")
    shares = vectors.audit(table, links, vectors.Settings())[0, 16]
    assert len(shares) == 140 and abs(sum(shares) / 140 - 100 / 140) < 1e-9
    apart = spark.createDataFrame([(i, np.eye(8)[i].tolist(), 0) for i in range(8)], "vec_id long, embedding array<double>, label int")
    assert {r.audited_recall for r in vectors.near_duplicates(apart).collect()} == {None}


def test_text_labels_and_extreme_components(spark):
    v = [0.3, -0.4, 0.5]
    near = [0.3, -0.4, 0.51]
    rows = [("a", [x * s for x in v]) for s in (1.0, 1e-200, 1e200, 1e-310, 2.0)] + [("a", [x * 1e300 for x in near]), ("b", v), ("b", [-x for x in v]), (None, v), ("a", [0.0, -0.0, 0.0]), ("a", [1e308, 0.0, 0.0])]
    for labels in (rows, [(None if x is None else ord(x) + 2**33, y) for x, y in rows]):
        kind = "string" if labels is rows else "long"
        table = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table).collect()}
        assert got == {**{i: (5, 0) for i in range(6)}, **{i: (0, i) for i in range(6, 11)}}


def test_operators_without_documents(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for found in (long_matches.without_repeats(none), simhash.near_duplicates(none), pii.detect(none), language.identify(none), toxicity.score(none, labels)):
        assert found.collect() == []


def test_operators_take_very_long_texts(spark):
    own = words(60_000, 31)
    tail = words(40_000, 32)
    texts = [own, f"{own} mail a@b.co", tail + own[:1000], "y" * 500_000, None]
    size = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    cut = {r.doc_id: (r.n_bytes, len(r.kept), r.spans) for r in long_matches.without_repeats(documents(spark, texts)).collect()}
    assert {i: x[0] for i, x in cut.items()} == size
    assert cut[0][1] == 0 and cut[1][1] == size[1] - size[0] and cut[2][1] == size[2] - 1000 and cut[3][1] == 0
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(documents(spark, texts), words=4).collect()}
    assert got[0][1] == got[1][1] == 0 and got[2][1] == 2
    assert [(s.kind, s.start) for r in pii.detect(documents(spark, texts)).collect() if r.doc_id == 1 for s in r.base] == [("email", len(own) + 6)]


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# 10, personal data


def test_plain_identifiers_equal_the_patterns():
    own = random.Random(3)
    for _ in range(30_000):
        text = "".join(own.choice("a1.@+- _%(25") for _ in range(own.randrange(30)))
        assert pii.identifiers(text) == identifiers(text)


DISGUISED = [
    ("mail john [at] example (dot) com now", "email", "john [at] example (dot) com"),
    ("john.doe at example dot com.", "email", "john.doe at example dot com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("see jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
    ("call plus four nine one five two three four five six now", "phone", "plus four nine one five two three four five six"),
    ("card 4111 l111 1111 I111.", "card", "4111 l111 1111 I111"),
    ("at one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
    ("é 192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10"),
]


@pytest.mark.parametrize(("text", "kind", "found"), DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, spans = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]


SPELLED = [
    ("write john at firma dot pl now", "email", "john at firma dot pl"),
    ("john at mail dot ru", "email", "john at mail dot ru"),
    ("john at firma [dot] se", "email", "john at firma [dot] se"),
    ("john at firma (dot) museum", "email", "john at firma (dot) museum"),
    ("john at firma dot shop", "email", "john at firma dot shop"),
    ("john at mail dot firma dot example", "email", "john at mail dot firma dot example"),
    ("john at mail dot firma.se", "email", "john at mail dot firma.se"),
    ("call plus 49 30 1234567", "phone", "plus 49 30 1234567"),
]


@pytest.mark.parametrize(("text", "kind", "found"), SPELLED)
def test_spelled_addresses_and_numbers_are_found_alone(text, kind, found):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == [(kind, found)]
    assert found not in pii.redacted(text)


@pytest.mark.parametrize("text", ["at this point in time", "we met at some point we knew", "look at the dot in it", "at West Point in May", "at each dot on it"])
def test_prose_is_no_address(text):
    assert pii.find(text)[1] == []


@pytest.mark.parametrize("text", ["x at " + "a." * 60_000, "x at " + "a dot " * 20_000, "x at a dot b " * 10_000])
def test_long_chains_take_little_time(text):
    pii.find(text)


@pytest.mark.parametrize("text", ["look at example.com and dot it", "meet at noon dot matrix", "one two three four", "a (dot) b", "5 at 7", "", words(500)])
def test_clean_text_is_left_alone(text):
    assert pii.find(text) == ([], []) and pii.redacted(text) == text


def test_spans_of_a_table(spark):
    texts = ["a@b.c x 1.2.3.4 ￿ +1 (234) 555-6789", None, "", "4111 1111 1111 1111 a@b.c", "4111 1111 1111 1111 a@b.c", *[x for x, _, _ in DISGUISED], "a@b.c " * 3000]
    docs = clashing(spark, texts)
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, text in enumerate(texts):
        assert [(x.kind, x.start, x.end) for x in got[i].base] == identifiers(text or "")
        assert [(x.kind, x.start, x.end) for x in got[i].spans] == pii.find(text)[1]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    by_id = {r[0]: r[1] for r in clean.collect()}
    assert by_id[0] == "<EMAIL> x <IP> ￿ <PHONE>" and by_id[1] is None and by_id[3] == by_id[4] == "<CARD> <EMAIL>"


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "1" * 200_000, "+" * 9000 + "1 " * 40_000, "1.2." * 40_000, "one " * 30_000, "a at " * 30_000, "<at " * 40_000])
def test_long_texts_take_little_time(text):
    pii.find(text)
