"""The training-data operators on small tables: edge cases, brute force, round trips."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from findra.llm import common, decontaminate, fingerprint, jaccard_join, language_id, license_scan, mixing, quality, token_output, toxicity, url_filter

LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, items string, row int, tokens int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 7, 9) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing column names."""
    return docs_of(spark, [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, LONG, None, None), (4, "one two", "fr", "b"), (4, "one two", "fr", "b"), (None, "one two three four five six", "de", "b"),
        (6, "   \n\t ", "es", "c"), (7, "one two three four five six", "en", "c"), (2**60 + 1, "One two THREE four five six", "en", "c"), (9, "... 123 !!!", "en", "c"),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# --- n-gram Jaccard join


def brute_components(rows):
    words = ["".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ") for _, t in rows]
    words = [[w for w in re.split("[\\x20\\x09-\\x0d]+", t) if w] for t in words]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(((d, len(sets[k]), least.get(find(k), d)) for k, (d, _) in enumerate(rows)), key=repr)


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"v{rng.integers(4000)}"
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.integers(3, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(bases[rng.integers(len(bases))]) if rng.random() < 0.7 else [word() for _ in range(rng.integers(1, 90))]
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = word()
        if rng.random() < 0.4:
            w = w + passage
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = near_copies(400, seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_loose_group(spark):
    """Copies of one text that are about as far from each other as links may be."""
    rng = np.random.default_rng(4)
    base = [f"g{i}" for i in range(200)]
    rows = []
    for i in range(260):
        w = list(base)
        for at in rng.choice(200, int(rng.integers(2, 7)), replace=False):
            w[at] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_links_of_unequal_sizes_behind_a_third_text(spark):
    """A passage, the passage with a tail as long as a link allows, and a third text with the passage that links with neither."""
    rows = []
    for k in range(60):
        passage, n = [f"p{k}x{i}" for i in range(104)], 30 + k % 4
        rows += [(3 * k, " ".join(passage)), (3 * k + 1, " ".join(passage + [f"a{k}x{i}" for i in range(n)])), (3 * k + 2, " ".join(passage + [f"b{k}x{i}" for i in range(60)]))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 120
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_null_ids_link_and_bridge(spark):
    """Two texts that link only through one whose rows have no id; a pair without any id."""
    w = [f"n{i}" for i in range(130)]
    rows = [(1, " ".join(w[:100])), (None, " ".join(w[:115])), (None, " ".join(w[:115])), (2, " ".join(w)), (None, " ".join(f"m{i}" for i in range(60))), (None, " ".join(f"m{i}" for i in range(62)))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_components(rows)
    assert (2, 126, 1) in want
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_keep_one_decides_by_row(spark):
    """An id on two texts, one of them a near copy; two linked texts of the smallest id; near copies without an id."""
    a, b, c, d = ([f"{x}{i}" for i in range(90)] for x in "abcd")
    rows = [(1, " ".join(a)), (2, " ".join(a[:85])), (2, " ".join(b)), (3, " ".join(c)), (3, " ".join(c[:86])), (None, " ".join(d)), (None, " ".join(d[:87])), (None, " ".join(d[:87]))]
    got = [(r["doc_id"], r["text"].split()[0]) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=repr) == [(1, "a0"), (2, "b0"), (3, "c0"), (None, "d0")]


def test_jaccard_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, jaccard_join.jaccard_components(odd).collect()), key=repr)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 2**60 + 1 not in ids and {1, 2, 3, 6, 9} <= set(ids)


def test_sketches_keep_every_link_within_a_list_and_few_other_pairs():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sets = [np.unique(np.concatenate([common[:shared], rng.integers(0, 1 << 63, own, dtype=np.uint64) << np.uint64(1)])) for _ in range(60) for shared, own in ((60, 4), (60, 11), (40, 30), (60, 60))]
    entries = np.empty(len(sets), jaccard_join.ENTRY)
    entries["x"], entries["n"], entries["q"] = np.arange(len(sets)), [len(h) for h in sets], [len(h) for h in sets]  # one shared first shingle
    sketches = np.array([jaccard_join.sketch(jaccard_join.signature(h)) for h in sets], np.int64)
    assert (sketches < 0).any() and all(np.bitwise_count(np.array(s).view(np.uint64)).sum() <= len(h) for s, h in zip(sketches.tolist(), sets, strict=True))
    got = {(int(a), int(b)) for u, v in jaccard_join.across(entries, entries["x"], sketches) for a, b in zip(u, v, strict=True)}
    linked = {(i, j) for j in range(len(sets)) for i in range(1, j) if jaccard_join.links(sets[i], sets[j])}
    unsifted = {(int(a), int(b)) for u, v in jaccard_join.across(entries, entries["x"], np.zeros_like(sketches)) for a, b in zip(u, v, strict=True)}
    assert linked and linked <= got and len(got - linked) * 10 < len(unsifted - linked)


def test_signatures_and_differences_agree_with_whole_sets():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        lead = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        x, y = (np.unique(np.append(rng.choice(lead, len(lead) - int(k), replace=False), rng.integers(0, 2**63, int(k), dtype=np.uint64))) for k in rng.integers(0, 1 + len(lead) // 4, 2))
        assert jaccard_join.least_apart(jaccard_join.signature(x), jaccard_join.signature(y)) <= len(np.setxor1d(x, y))
        a, b = np.setxor1d(lead, x), np.setxor1d(lead, y)
        assert jaccard_join.links_by_difference(a, len(x), b, len(y)) == jaccard_join.links(x, y)


def test_link_threshold_is_exact():
    a = np.arange(7, dtype=np.uint64)
    assert jaccard_join.links(a, a[:6]) and jaccard_join.links(np.arange(4, dtype=np.uint64), np.arange(3, dtype=np.uint64))
    assert not jaccard_join.links(np.arange(10, dtype=np.uint64), np.arange(7, dtype=np.uint64))


# --- decontamination

ITEMS = "item_id bigint, text string"


def brute_contamination(rows, items):
    import re

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if its := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= its
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark, odd, monkeypatch):
    text = " ".join(f"q{i}" for i in range(25))
    items = [(1, text), (2, "One, TWO!"), (3, None), (4, "..."), (5, "é ß Ünï"), (6, text + " tail"), (None, "unnamed item here")]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [
        (20, "start " + text + " end"), (21, text.upper().replace(" ", "--")), (22, " ".join(text.split()[:9])), (23, "xé ß Ünï é ß Ünï"), (24, "an unnamed item here"),
        (25, text + " " + text),
    ]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = decontaminate.contamination(docs, spark.createDataFrame(items, ITEMS)).drop("spans")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_contamination(rows, items)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.remove_documents(docs, spark.createDataFrame(items, ITEMS)).collect() if r["text"])
    cut = sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.remove_spans(docs, spark.createDataFrame(items, ITEMS)).collect() if r["text"])
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 1)
    again = decontaminate.contamination(docs, spark.createDataFrame(items, ITEMS)).drop("spans")
    assert sorted(map(tuple, again.collect()), key=repr) == brute_contamination(rows, items)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.remove_documents(docs, spark.createDataFrame(items, ITEMS)).collect() if r["text"]) == kept
    clashing = docs.withColumnsRenamed({"lang": "hit_spans", "source": "hit_id"})
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.remove_spans(clashing, spark.createDataFrame(items, ITEMS)).collect() if r["text"]) == cut
    assert decontaminate.contamination(docs, spark.createDataFrame([], ITEMS)).where("contaminated").count() == 0


def test_removing_documents_and_spans(spark, odd, empty):
    text = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, text)], ITEMS)
    docs = docs_of(spark, [(1, f"Keep this. {text}, and that!", "en", "s"), (2, "clean", "en", "s"), (None, None, None, None)])
    assert [r["doc_id"] for r in decontaminate.remove_documents(docs, items).orderBy("doc_id").collect()] == [None, 2]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut == {1: "Keep this, and that!", 2: "clean", None: None}
    assert decontaminate.remove_documents(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0


# --- URL filter


def test_url_rules_and_parts(spark):
    cases = {
        None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "https://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "https://example.com/en/71#f": ("example.com", "/en/71", "example.com/en/7", "allow"),
        "http://thing.example.com/en/8": ("thing.example.com", "/en/8", "com/en/", "block"), "http://x.net/de/1": ("x.net", "/de/1", "net/de/", "allow"),
        "http://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8", "block"), "ftp://a.org/es/": ("a.org", "/es/", "org/es/", "block"),
        "http://badexample.com/fr/7": ("badexample.com", "/fr/7", None, "allow"), "http://tionorg?/es/": ("tionorg", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(cases)], "page_id bigint, url string, host string, url_rule string").drop("url_rule")
    out = url_filter.judge(pages, url_filter.train(url_filter.labelled(spark))).orderBy("page_id").collect()
    assert [(r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in out] == list(cases.values())


def url_grams(url):
    """Indices of the hashed n-grams of a plain URL."""
    host, path = re.match("[a-z]+://([^/?#]*)([^?#]*)", url).groups()
    marked = [f"^{host.lower()}$", f"{path}|" if path else ""]
    grams = [m[i : i + n] for m in marked for n in url_filter.GRAMS for i in range(len(m) - n + 1)]
    return np.array([int(np.int64(np.uint64(xxhash.xxh64_intdigest(g.encode(), seed=42)).astype(np.int64)) % url_filter.DIM) for g in grams], int)


def url_features(urls):
    x = np.zeros((len(urls), url_filter.DIM))
    for row, u in zip(x, urls, strict=True):
        g = url_grams(u)
        np.add.at(row, g, 1 / np.sqrt(len(g)))
    return x


def url_fit(x, y):
    """Gradient descent with momentum on whole matrices."""
    w, b, vw, vb, met = np.zeros(url_filter.DIM), 0.0, np.zeros(url_filter.DIM), 0.0, (x != 0).any(0)
    for _ in range(url_filter.STEPS):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        vw = url_filter.MOMENTUM * vw - url_filter.RATE * (x.T @ e / len(y) + url_filter.DECAY * w) * met
        vb = url_filter.MOMENTUM * vb - url_filter.RATE * e.mean()
        w, b = w + vw, b + vb
    return w, b


def test_url_model_equals_brute_force(spark):
    weights, bias = url_filter.train(url_filter.labelled(spark))
    rows = url_filter.labelled(spark).collect()
    w, b = url_fit(url_features([r["url"] for r in rows]), np.array([r["label"] for r in rows], float))
    assert np.allclose(weights, w, atol=1e-6) and bias == pytest.approx(b, abs=1e-6)
    assert url_filter.train(url_filter.labelled(spark).limit(0)) == ([0.0] * url_filter.DIM, 0.0)
    urls = ["https://night-casino.example.org/", "http://www.free-adult.example.org/de/4", "https://ads-tracker.example.com/x", "https://blog.thered.example.org/fr/3", "http://einlich.example.com/de/9", f"https://a.example.com/{'long/' * 5000}"]
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), (weights, bias)).collect()
    for r, m in zip(got, url_features(urls) @ w + b, strict=True):
        assert r["url_score"] == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-6)
    assert [r["url_verdict"] for r in got[:5]] == ["block", "block", "block", "allow", "allow"]


def test_url_model_holds_on_hosts_it_was_not_trained_on(spark):
    rows = url_filter.labelled(spark).collect()
    x, y = url_features([r["url"] for r in rows]), np.array([r["label"] for r in rows])
    right = []
    for i in range(len(rows)):
        others = np.arange(len(rows)) != i
        w, b = url_fit(x[others], y[others])
        right.append((x[i] @ w + b >= 0) == y[i])
    assert np.mean(np.array(right)[y == 1]) >= 0.75 and np.mean(np.array(right)[y == 0]) >= 0.85
    assert len({re.match("[a-z]+://([^/]*)", r["url"])[1] for r in rows}) == len(rows)


def test_url_filter_empty_table_and_kept_columns(spark):
    model = url_filter.train(url_filter.labelled(spark))
    pages = spark.createDataFrame([(1, "https://a.test/", "kept")], "page_id bigint, url string, host string")
    assert url_filter.judge(pages.limit(0), model).count() == 0
    assert url_filter.judge(pages, model).first()["host"] == "kept"


# --- licence scan


def test_licence_rules(spark, odd, empty):
    grant, warranty = license_scan.SENTENCES["mit-grant"][0], license_scan.SENTENCES["mit-warranty"][0]
    wrapped = "\n".join((grant + ". " + warranty + ".")[i : i + 0] or x for i, x in enumerate([" ".join(w) for w in np.array_split(np.array((grant + ". " + warranty + ".").split()), 9)]))
    rows = {
        1: ("some prose\nReleased under the MIT License.", ["mit"]), 2: (wrapped, ["mit"]), 3: ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", ["cc-by-nc-4.0", "proprietary"]),
        4: ("the licence of the place", []), 5: (f"{warranty}. {grant}.", []), 6: ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", ["apache-2.0"]), 7: (None, []), 8: ("", []),
    }
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(docs_of(spark, [(i, t, "en", "s") for i, (t, _) in rows.items()])).collect()}
    assert got == {i: want for i, (_, want) in rows.items()}
    assert license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(empty).count() == 0


MIT_BODY = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

APACHE_HEADER = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_licences_by_their_verbatim_texts(spark):
    texts = [MIT_BODY, "MIT License\n\n" + MIT_BODY, APACHE_HEADER]
    rows = [t.replace("\n", end) for t in texts for end in ("\n", "\r\n", "\r")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    assert [got[i]["licences"] for i in range(9)] == [["mit"]] * 6 + [["apache-2.0"]] * 3
    assert all("|apache-ref||apache-obtain||apache-url||apache-warranty|" in got[i]["idents"] for i in (6, 7, 8))


def test_known_sentences_are_counted_by_the_cut_that_has_more(spark):
    notice = "Released under the MIT License."
    rows = [f"A tale.\n{notice}", f"{notice} A tale. All rights reserved.", "\n".join([notice] * 3), "Some words\nAll rights reserved", "Licensed under the\nMIT License", "none", None]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    got = {r["doc_id"]: r["n_sentences"] for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [1, 2, 3, 1, 1, 0, 0]
    con = pytest.importorskip("duckdb").connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
    assert got == {i: n for i, n, _ in con.execute(license_scan.OP5_SQL).fetchall()}


# --- language ID

PIECES = {"en": "the and thing ation here with was", "fr": "eau oui elle mentre tion être dans", "de": "ung keit schaft und der einlich für", "es": "ción ado mente que llos ñar esta"}


def prose(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    p = PIECES[lang].split()
    return " ".join("".join(rng.choice(p, rng.integers(1, 3))) for _ in range(n))


def test_language_id_learns_and_ignores_held_out(spark):
    rows = [(i, prose(lang, i), lang, "s") for i, lang in enumerate(sorted(PIECES) * 40)]
    docs = docs_of(spark, [(i, t, "zz" if common.crc_mod(i, 5) == 0 else lang, s) for i, t, lang, s in rows])
    model = language_id.train(docs)
    assert model.languages == sorted(PIECES)
    out = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    right = [out[i]["lang_pred"] == lang for i, _, lang, _ in rows if common.crc_mod(i, 5) == 0]
    assert len(right) > 10 and np.mean(right) > 0.95


def test_language_id_odd_rows(spark, odd, empty):
    model = language_id.train(odd)
    out = language_id.predict(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "lang_score"]
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in out.collect()}
    for i in (1, 2, 6, 9):
        assert by[i] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by.values())
    assert language_id.predict(odd, language_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_id_needs_a_letter():
    assert not any(language_id.has_letter(t) for t in ("½ ² ①", "Ⅷ 12", "\u0301", "")) and all(language_id.has_letter(t) for t in ("½a", "1 ª", "日"))
    model = language_id.fit([prose("en", 1), prose("de", 2)], ["en", "de"])
    assert model.predict("½ ² ① Ⅷ") == ("und", 0.0)
    same = language_id.fit([prose("en", 1)] * 2, ["zz", "aa"])
    assert same.predict(prose("en", 1))[0] == "aa"


def test_language_id_leaves_no_language_out(spark):
    rng = np.random.default_rng(3)
    alphabets = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, replace=False)) for _ in range(80)]
    rows = [(1000 * k + i, " ".join("".join(rng.choice(list(a), 6)) for _ in range(40)), f"l{k:02d}", "s") for k, a in enumerate(alphabets) for i in range(5)]
    docs = docs_of(spark, rows)
    model = language_id.train(docs, most=100)
    assert len(model.languages) == len({lang for i, _, lang, _ in rows if common.crc_mod(i, 5) != 0}) >= 79


def test_columns_of_clashing_names(spark):
    """Names that operators use themselves, in the input."""
    docs = spark.createDataFrame([(i, prose("en", i), "en", "s", "j", "k") for i in range(8)], "doc_id bigint, text string, lang string, source string, judged string, Mixer_u string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id bigint, quality int, toxic int")
    for out in (
        language_id.predict(docs.withColumn("lang_pred", F.lit(1)), language_id.train(docs)),
        toxicity.score(docs.withColumn("toxicity_score", F.lit("x")), toxicity.train(docs, labels)),
        quality.score(docs.withColumn("quality_score", F.lit("x")), quality.train(docs, labels)),
        mixing.calibrated(spark, docs.withColumn("mix_keep", F.lit("x"))),
        mixing.sample(spark, docs.withColumn("mix_keep", F.lit("x")), budget=1.0),
    ):
        rows = out.collect()
        assert len(rows) == 8 and all(r["judged"] == "j" and r["Mixer_u"] == "k" for r in rows)
        assert len(set(out.columns)) == len(out.columns)
    assert {r["mix_keep"] for r in mixing.sample(spark, docs.withColumn("mix_keep", F.lit("x")), budget=1.0).collect()} == {"x"}


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = {"other": "x"}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session, "x")


# --- fingerprints


def test_sketch_estimates_and_merges():
    a = " ".join(f"a{i}" for i in range(4000))
    b = " ".join(f"a{i}" for i in range(400))
    x, y = fingerprint.sketch(a), fingerprint.sketch(b)
    assert fingerprint.containment(y, x) > 0.97 and fingerprint.likeness(x, y) == pytest.approx(0.1, abs=0.03)
    assert len(x) == pytest.approx(4000 * fingerprint.FRACTION, rel=0.15)
    other = fingerprint.sketch(" ".join(f"b{i}" for i in range(50)))
    assert np.array_equal(fingerprint.merge(x, other), np.union1d(x, other))
    assert np.array_equal(fingerprint.from_text(fingerprint.to_text(x)), x)
    assert fingerprint.to_text(fingerprint.sketch("")) == "" and fingerprint.likeness(fingerprint.sketch(None), fingerprint.sketch("")) == 1.0
    assert len(fingerprint.sketch("hello")) == 1


def test_sequence_equals_brute_force(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(i, f"zz{i} " + "äöü " * (i % 37)) for i in range(20, 320)]
    size = fingerprint.ROWS_PER_BUCKET
    try:
        fingerprint.ROWS_PER_BUCKET = 40
        got = fingerprint.sequence_fingerprints(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    finally:
        fingerprint.ROWS_PER_BUCKET = size
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        a, e, f = map(fingerprint.sketch, (t, edited, following))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_text(a), fingerprint.to_text(e), fingerprint.likeness(a, e), fingerprint.likeness(a, f)))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert fingerprint.sequence_fingerprints(empty).count() == 0


# --- token output


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_token_output_with_less_memory_has_the_same_ids(spark, odd, vocabulary):
    want = sorted(map(tuple, token_output.token_output(spark, odd, vocabulary).collect()), key=repr)
    assert sorted(map(tuple, token_output.token_output(spark, odd, vocabulary, cache=3, batch_chars=10).collect()), key=repr) == want
    assert token_output.encoder(vocabulary).limit == token_output.CACHE_CHUNKS
    assert token_output.encoder(vocabulary, 7).limit == 7 and len(token_output._ENCODERS) == 1  # a worker keeps one


def test_token_files_round_trip(spark, odd, empty, vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    odd = odd.unionByName(docs_of(spark, [(50, "It's DOGS', x'S. a_b,c!? <|endoftext|>foo <|ENDOFTEXT|> İstanbul. ΣΑΣ ΟΔΟΣ. ́x café, ½. a½. x́. 日本語。", "en", "s")]))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for i, t in rows:
        ids = whole.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_output(spark, odd, vocabulary).collect()), key=repr) == sorted(want, key=repr)
    assert token_output.token_output(spark, empty, vocabulary).count() == 0


def test_any_subset_is_readable_and_damage_is_found(spark, odd, vocabulary, tmp_path):
    index = token_output.write_token_files(odd, f"file://{tmp_path}/out", vocabulary)
    some = index.where("seq % 3 = 1").orderBy(F.desc("offset"))
    assert token_output.read_token_files(some).count() == index.where("seq % 3 = 1").count()
    data = token_output.frame(5, np.array([1, 70000], "<u4"))
    assert token_output.unframe(data) == (5, np.array([1, 70000], "<u4").tobytes())
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_output.unframe(bytes(broken))


def test_encoder_cache_generations_do_not_change_ids(vocabulary):
    from tokenizers import Tokenizer

    whole, small = Tokenizer.from_file(vocabulary), token_output.ChunkEncoder(vocabulary, cache=20)
    for seed in range(30):
        texts = [prose(sorted(PIECES)[seed % 4], seed) + ", The END.", None, "", " \t", f"\n it{seed}'s DOGS',  "]
        ids, at = small.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_encoded_whole(vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = token_output.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = ["Two  words,\n and Lines.", None, "x" * 50_000]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert not encoder.by_chunk and token_output.ChunkEncoder(vocabulary).by_chunk
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


# --- classifiers


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 3, 64, 65, 200])
    emission, trans = rng.normal(-1, 3, sizes.sum()), np.array([[0, -1.0], [0.5, 0.3]])
    p, log_z, moved = toxicity.marginals(emission, sizes, trans, pairs=True)
    at, a = 0, np.exp(trans)
    for k, n in enumerate(sizes):
        e, f, forward = emission[at : at + n], np.array([1.0, 0.0]), []
        for x in e:
            f = f @ a * np.array([1, np.exp(x)])
            forward.append(f)
        b = np.ones(2)
        for i in range(n - 1, -1, -1):
            assert p[at + i] == pytest.approx(forward[i][1] * b[1] / (forward[i] @ b))
            b = a @ (np.array([1, np.exp(e[i])]) * b)
        assert log_z[k] == pytest.approx(np.log(f.sum()))
        at += n
    assert moved.sum() == pytest.approx(sizes.sum())


def toxic_rows(n):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        w = prose("en", i, 50).split()
        bad = i % 3 == 0
        for _ in range(4 * bad):
            w.insert(int(rng.integers(len(w))), str(rng.choice(["grumbler", "grumblest", "nitwit"])))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_evidence_counts_all_contexts():
    docs = [[f"l{i}", "vile", f"r{i}"] for i in range(1500)] + [[f"x{i}", "vile" if i < 100 else "fine", f"y{i}"] for i in range(1500)]
    assert "vile" in toxicity.evidence_of(docs, [1] * 1500 + [0] * 1500)


def test_toxicity_finds_spans(spark, odd, empty):
    rows = toxic_rows(240)
    docs = docs_of(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1 - y if common.crc_mod(i, 3) == 1 else y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if common.crc_mod(i, 3) == 1]
    assert all((out[i]["toxicity_score"] >= toxicity.THRESHOLD) == bool(y) for i, _, y in held)
    for i, t, y in held:
        if y:
            assert {t[s["start"] : s["end"]].split()[0][:4] for s in out[i]["toxic_spans"]} <= {"grum", "nitw"} and out[i]["toxic_spans"]
    scored = toxicity.score(odd, model)
    assert scored.columns == [*odd.columns, "toxicity_score", "toxic_spans"]
    assert all(0 <= r["toxicity_score"] < toxicity.THRESHOLD for r in scored.collect())
    assert toxicity.score(empty, model).count() == 0
    assert {r[0] for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).select("toxicity_score").collect()} == {0.0}


def test_quality_separates_junk(spark, odd, empty):
    rows = [(i, prose("en", i, 150) if i % 2 else " ".join(w + "$$$" for w in prose("en", i, 150).split()), i % 2) for i in range(200)]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1 - y if common.crc_mod(i, 3) == 1 else y) for i, _, y in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    out = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if common.crc_mod(i, 3) == 1]
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, y in held]) > 0.95
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in scored)
    assert quality.score(empty, model).count() == 0
    attention = model.scores([quality.encode(rows[0][1])])[1][0]
    assert attention.sum() == pytest.approx(1)
    twice = model.scores([quality.encode(rows[0][1]), quality.encode(rows[0][1]), quality.encode(LONG)])[0]
    assert twice[0] == twice[1] and 0 <= twice[2] <= 1


def quality_by_loops(model, bag):
    """The score of one bag, unit by unit."""
    p, hidden, raw = model.params, [], []
    for x in (bag - model.shift) / model.scale:
        h = [math.tanh(sum(x[i] * p["E"][i, j] for i in range(len(x))) + p["e"][j]) for j in range(quality.HIDDEN)]
        t = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) for j in range(quality.ATTENTION)]
        g = [1 / (1 + math.exp(-sum(h[i] * p["U"][i, j] for i in range(len(h))))) for j in range(quality.ATTENTION)]
        hidden.append(h)
        raw.append(math.exp(sum(a * b * w for a, b, w in zip(t, g, p["w"], strict=True))))
    z = [sum(r * h[j] for r, h in zip(raw, hidden, strict=True)) / sum(raw) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["o"], strict=True)) - p["b"][0]))


def test_quality_equals_loops_and_its_gradient_the_numeric_one():
    texts = [prose("en", i, 20 + 60 * (i % 4)) if i % 2 else " ".join(w + "$" for w in prose("de", i, 90).split()) for i in range(24)]
    model = quality.fit(texts, [i % 2 for i in range(24)], epochs=2)
    bags = [quality.encode(t) for t in texts[:5]]
    assert max(map(len, bags)) > 2
    assert model.scores(bags)[0] == pytest.approx([quality_by_loops(model, b) for b in bags])
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.append(0, np.cumsum(sizes)[:-1]), np.repeat(np.arange(len(bags)), sizes)
    x, y, weight = (np.concatenate(bags) - model.shift) / model.scale, np.array([0.0, 1, 0, 1, 0]), np.array([1.0, 2, 1, 2, 1])

    def loss():
        out = model.forward(x, starts, bag)[-1]
        return -np.mean(weight * (y * np.log(out) + (1 - y) * np.log(1 - out)))

    rng = np.random.default_rng(0)
    for name, grad in model.gradients(x, starts, bag, y, weight).items():
        flat = model.params[name].ravel()
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[at]
            flat[at] = was + 1e-5
            up = loss()
            flat[at] = was - 1e-5
            down = loss()
            flat[at] = was
            assert grad.ravel()[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_passages_are_encoded_with_their_grams():
    one, other = (quality.encode(t)[0][-quality.GRAM_BINS :] for t in ("alpha beta gamma", "omega sigma kappa"))
    assert np.abs(one - other).max() > 0.1 and (quality.encode("Alpha BETA gamma")[0][-quality.GRAM_BINS :] == one).all()
    assert not quality.encode(None).any() and len(quality.encode("w " * 100)) == 3


# --- mixing


def test_mixing_rakes_to_targets(spark, odd, empty):
    rows = [(i, "word " * (5 + i % 40) + ("x@y.zz" if i % 5 == 0 else ""), ("en", "de", "fr", "xx")[i % 4 if i % 3 else 0], f"s{(i * i) % 7}") for i in range(1500)]
    out = mixing.calibrated(spark, docs_of(spark, rows)).collect()
    cells = {}
    for r in out:
        c = cells.setdefault((r["source"], r["lang"], r["mix_topic"]), [0, r["mix_weight"], r["mix_prob"]])
        c[0] += r["mix_tokens"]
        assert c[1:] == [r["mix_weight"], r["mix_prob"]]
    total = sum(c[1] for c in cells.values())
    named = {"en": 0.5, "de": 0.18, "fr": 0.18}
    scale = sum(named.values()) + mixing.OTHER_LANGUAGES
    for lang, share in [*named.items(), ("xx", mixing.OTHER_LANGUAGES)]:
        assert sum(c[1] for k, c in cells.items() if k[1] == lang) / total == pytest.approx(share / scale, abs=0.01)
    expected = sum(c[0] * c[2] for c in cells.values())
    assert expected == pytest.approx(mixing.BUDGET * sum(c[0] for c in cells.values()), rel=0.01)
    drawn = sum(r["mix_tokens"] for r in out if r["mix_keep"])
    assert drawn == pytest.approx(expected, rel=0.1)
    kept = mixing.sample(spark, odd)
    assert kept.columns == odd.columns
    assert mixing.calibrated(spark, empty).count() == 0
    whole = mixing.calibrated(spark, odd, budget=1.0)
    assert all(r["mix_prob"] == pytest.approx(1.0) for r in whole.collect() if r["mix_tokens"])
