"""Quality, language, licences, packing, HTML."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from copse.llm import html, langid, licences, packing, quality
from copse.llm.queries import vocabulary

EN, DE = "the of and that with from this have".split(), "der die und das mit von nicht eine".split()


def _texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(EN if i % 2 else DE, k=rng.randint(3, 60))), "en" if i % 2 else "de") for i in range(n)]


def test_language(docs):
    df = docs([*_texts(200), (900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (903, "the and " * 20_000, None), (None, "und die das", "de"), (5, "the of", "en"), (5, "the of", "en")])
    model = langid.fit(df)
    rows = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    truth = {i: lang for i, _, lang in _texts(200)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert {rows[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and rows[903]["lang_pred"] == "en" and 0 <= rows[903]["score"] <= 1
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() >= 195
    nothing = langid.fit(docs([(1, "abc", None)]))
    assert [r["lang_pred"] for r in langid.predict(docs([(1, "abc", None)]), nothing).collect()] == ["und"]
    assert langid.predict(docs([]), nothing).isEmpty()


def test_language_sample_is_shared_evenly(docs, monkeypatch):
    rows = [(1000 * k + i, f"word{k} text{i}", lang) for k, lang in enumerate(["aa", "bb", "cc", "dd", "ee"]) for i in range(80)]
    df, train, seen = docs([*rows, rows[7], rows[7]]).coalesce(1), langid.train, []
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.append(labels) or train(texts, labels))
    a, b = langid.fit(df, max_rows=40), langid.fit(df.repartition(5), max_rows=40)
    assert seen[0] == [x for x in a.languages for _ in range(8)] and a.languages == ["aa", "bb", "cc", "dd", "ee"]
    assert seen[1] == seen[0] and (a.table == b.table).all()


def _gam_score(gam, x):
    """One lookup at a time: a value's bin is the number of cuts at or below it."""
    at = lambda cuts, v: sum(c <= v for c in cuts)
    total = gam.base + sum(table[at(cuts, v)] for cuts, table, v in zip(gam.edges, gam.tables, x, strict=True))
    for (i, j), table in zip(gam.pairs, gam.pair_tables, strict=True):
        total += table[at(gam.pair_edges[i], x[i]), at(gam.pair_edges[j], x[j])]
    return 1 / (1 + np.exp(-total))


def test_quality(spark, docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = rng.choices(EN + DE, k=rng.randint(20, 80))
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, "x " * 100_000), (None, "a b"), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    gam = quality.fit(docs(rows), table, rounds=20, pair_rounds=5)
    got = quality.score(docs(rows), gam).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    again = quality.fit(docs(rows).repartition(7), table, rounds=20, pair_rounds=5)
    assert all((a == b).all() for a, b in zip([*gam.tables, *gam.pair_tables], [*again.tables, *again.pair_tables], strict=True))
    text = dict(rows)
    for r in got[::20]:
        if r["doc_id"] is not None:
            assert r["score"] == pytest.approx(_gam_score(gam, quality.features(text[r["doc_id"]])))
    flat = quality.fit(docs(rows), table.where("false"))
    assert all(r["score"] == 0.5 for r in quality.score(docs(rows[:3]), flat).collect()) and quality.score(docs([]), flat).isEmpty()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality.train(x, y, rounds=10, pair_rounds=40)
    assert (1, 0) in gam.pairs and ((gam.score(x) >= 0.5) == y).mean() > 0.95


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


LICENCE = [
    None, "", "Under the MIT license. under-the-mit-license", "Apache License, Version 2.0 and CC BY-NC", "é under the mit license日 x", "under the mit licenses", "cc by nc cc by nc",
    "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception */", "SPDX-License-Identifier: MIT OR", "Under the " * 50_000 + "MIT License",
]


def test_licences_against_brute_force(docs):
    got = {r["doc_id"]: r for r in licences.licence_report(docs(list(enumerate(LICENCE)))).collect()}
    for i, t in enumerate(LICENCE):
        words, places = _words(t), []
        for phrase, label in licences.BASE_PHRASES.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[7]["labels"] == "apache-2,gpl-3,mit" and got[7]["permits"] is True and got[8]["labels"] == "" and got[8]["score"] > 0
    assert licences.licence_report(docs([])).isEmpty()


def test_expressions():
    assert licences.to_postfix("MIT or (GPL-2.0 with X and Apache-2.0)") == "mit gpl-2.0 x with apache-2.0 and or".split()
    assert licences.to_postfix("(MIT") is None and licences.to_postfix("and MIT") is None and licences.to_postfix("") is None
    assert licences.evaluate("MIT and see the file COPYING") == licences.Terms(frozenset(["mit"]), False)
    assert licences.evaluate("none of the above").labels == licences.evaluate("see COPYING").labels == frozenset()
    assert licences.evaluate("LicenseRef-Mine OR Apache-2.0").labels == {"licenseref-mine", "apache-2"}
    assert licences.evaluate("LGPL-2.1-or-later WITH Some-exception").labels == {"lgpl-2.1"}
    assert licences.evaluate("MIT OR GPL-3.0").permits and not licences.evaluate("MIT AND GPL-3.0").permits


def _pieces(docs, rows, **options):
    got = packing.pack(docs(rows), packing.chunk_tokenizer(vocabulary()), **options).collect()
    fill = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    return got, {s: sum(n for _, n in p) for s, p in fill.items()}


def test_known_chunks_are_not_looked_up_one_by_one(monkeypatch):
    class Cache(dict):
        def get(self, *_):
            raise AssertionError("a known chunk was looked up by itself")

    texts = [" ".join(f"word{j % 9} x{i}y, again." for j in range(i)) for i in range(12)]
    encode = packing.ChunkTokenizer(vocabulary())
    want = [encode.whole(t) for t in texts]
    encode.chunks = Cache()
    assert encode(texts) == want and encode(texts) == want
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 12)
    encode = packing.ChunkTokenizer(vocabulary())
    for i in (*range(0, 12, 2), 4):  # the cache turns over, and older chunks come back
        assert encode(texts[i : i + 2]) == want[i : i + 2]
    assert encode([None, *texts]) == [b"", *want] and not encode.chunks


def test_packing_round_trip(docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(EN + ["İstanbul", "don't", "a.b,", "<|endoftext|>", "naïve!!", "x1 y", "ΣΑΣ", "é", "...", "Straße,"], k=rng.randint(0, 400)))) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 30_000), (None, "a")]
    got, fill = _pieces(docs, rows)
    tokenizer = Tokenizer.from_file(vocabulary())
    for i, t in rows:
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(bytes(r["ids"]) for r in mine) == ids and {r["doc_tokens"] for r in mine} == {len(ids) // 4}
    assert max(fill.values()) <= 2048 and sum(f < 2048 for f in fill.values()) <= 4
    assert packing.pack(docs([]), packing.chunk_tokenizer(vocabulary())).isEmpty()


def test_sum_of_squares_choice():
    rng = np.random.default_rng(6)
    packer, cap = packing.Packer(50), 50
    for k in range(600):
        size = int(rng.integers(1, 50))
        before = packer.levels.copy()
        list(packer.add(k, b"\0\0\0\0" * size))
        totals = []
        for h in range(0, cap - size + 1):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                if h + size < cap:
                    after[h + size] += 1
                totals.append((after[1:cap] ** 2).sum())
        assert (packer.levels[1:cap] ** 2).sum() == min(totals)


PAGE = '<html><head><title>t &amp; u</title><script>var a="</p><p>no</p>";</script></head><body><nav><a href="x">menu</a></nav><div class="sidebar-2">side</div>{}<footer>&copy; foot</footer></body></html>'
BODY = '<article class="post-17"><h1>Head  line</h1><p>One &lt;two&gt;\n three &amp; four<br>five, and some more words here.<p>Second <b>paragraph</b> of the article text, long enough.</p><div class="ad">buy</div><form><label>x</label></form><ul><li>Item</ul><div class="comments"><p>a reader says</p></div></article>'


def test_html(spark):
    rows = [(i, f"https://www.a.com/{i}", PAGE.format(BODY)) for i in range(6)] + [(6, "https://www.a.com/x", PAGE.format("<div><p>Another layout with enough text in it to be an article.</p></div>")), (7, None, None), (8, "u", ""), (9, "http://b.org", "<div class='ad'>open <article><p>cut off in the mid"), (10, "http://b.org", "<p>" * 5000 + "deep" + "<" * 5000), (0, "https://www.a.com/0", PAGE.format(BODY))]
    pages = spark.createDataFrame([(*r, 1, "w") for r in rows], "page_id long, url string, html string, host int, winners string")
    got = {}
    for r in html.extract_pages(pages).collect():
        got.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert len(got[0]) == 2 and got[1][0]["text"] == "Head line\nOne <two> three & four five, and some more words here.\nSecond paragraph of the article text, long enough.\nItem"
    assert got[6][0]["text"].startswith("Another layout") and got[7][0]["text"] == got[8][0]["text"] == "" and got[9][0]["text"] == "cut off in the mid"
    winners = {r["host"]: r["winners"] for r in html.winning_paths(pages).collect()}
    assert winners["www.a.com"][0] == "body>article.post-#"
    assert html.extract_pages(pages.where("false")).isEmpty()


LONG, MORE = "A long body of the article that goes on and on. " * 9, "A second section with other things to tell. " * 5
NESTED = {
    "article": (f"<article class='post-1'><h1>Head</h1><p>A short lead of the page.</p><div class=content><p>{LONG}</p></div></article><div class='x'>Outside of the article it stands.</div>", ["Head", "A short lead of the page.", LONG]),
    "links": (f"<article><p>See <a href='/a'>all that we wrote about it</a></p><div class=content><p>{LONG}</p></div><div class='tags'><a href='/t'>tag one</a> <a href='/u'>two</a></div><p>An end.</p></article>", ["See all that we wrote about it", LONG, "tag one two", "An end."]),
    "main": (f"<main><section class=a><p>{LONG}</p></section><section class=b><p>{MORE}</p></section><article class='comment-3'><p>A reader says so.</p></article></main>", [LONG, MORE]),
    "deep": (f"<article><h1>Head</h1><div class=w><div class=v><div class=content><p>{LONG}</p></div></div></div></article>", ["Head", LONG]),
    "body": (f"<div class=top><a href='/'>Home</a> | <a href='/b'>About us</a></div><h1>Head</h1><div class=content><p>{LONG}</p></div><div class=rest><p>{MORE}</p></div>", ["Head", LONG, MORE]),
    "layout": (f"<div class='layout has-sidebar'><div class='post'><h1>Head</h1><p>{LONG}</p></div><div class='sidebar'><p>{MORE}</p></div></div>", ["Head", LONG]),
    "quote": (f"<article><h1>Head</h1><p>An intro of some words.</p><blockquote><p>{LONG}</p></blockquote><p>The closing words.</p></article>", ["Head", "An intro of some words.", LONG, "The closing words."]),
    "paras": (f"<div class='post'><h1>Head</h1><div class='para'>{LONG}</div><div class='para'>{MORE}</div></div>", ["Head", LONG, MORE]),
    "alone": (f"<div class=top><a href='/'>Home</a></div><div class=content><p>{LONG}</p></div>", [LONG]),
}


def test_nested_layouts_keep_all_their_text(spark):
    rows = [(10 * k + i, f"http://{name}.org/{i}", PAGE.format(body)) for k, (name, (body, _)) in enumerate(NESTED.items()) for i in range(2)]
    got = {r["url"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for name, (_, want) in NESTED.items():
        assert got[f"http://{name}.org/1"] == "\n".join(x.strip() for x in want), name


@pytest.mark.parametrize("text", ["", "a", "a b c d e f"])
def test_shingles(text):
    from copse.llm.texts import shingle_set

    assert len(shingle_set(text)) == {"": 0, "a": 1, "a b c d e f": 2}[text]
