import hashlib
import re
import time
from collections import Counter, defaultdict
from html import unescape
from math import log2

import numpy as np
import pytest

from broadloom.llm import decontamination, html_text, language_id, license_scan, private_data, toxicity
from tests.llm.conftest import CLASHES, LOWER, ODD, alnum

SF01 = "/root/testdata/sf0.01"


# Language identification


def test_held_out_languages(spark, documents):
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert {r["held_out"] for r in got} == {True, False}
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark, documents):
    from pyspark.sql import functions as F

    hidden = language_id.held_out(F.col("doc_id"))
    changed = documents.withColumn("lang", F.when(hidden, "xx").otherwise(F.col("lang")))
    one = language_id.identify(documents).collect()
    two = language_id.identify(changed).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_languages_of_odd_rows(odd, empty, docs_of):
    got = language_id.identify(odd).collect()
    assert len(got) == len(ODD)
    lettered = [bool(re.search(r"[^\W\d_]", t or "")) for _, t, *_ in ODD]
    assert sum(r["lang_pred"] == "und" for r in got) == lettered.count(False)
    assert all((r["lang_pred"] == "und") <= (r["score"] == 0) for r in got)
    assert language_id.identify(empty).count() == 0
    nothing = language_id.identify(docs_of([(1, "some text", None, "s", 1)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    kept = language_id.drop_unidentified(odd, 0.0)
    assert kept.columns == odd.columns and kept.count() == lettered.count(True)


def test_buckets_follow_the_texts():
    """Counts of single texts equal the sums that scoring uses."""
    texts = ["Ab c", None, "", "x", "Straße İx", "漢字 kana"]
    weights = np.random.default_rng(1).normal(size=(2, 1 << language_id.BITS)).astype(np.float32)
    model = language_id.Model(["a", "b"], weights, np.array([0.1, -0.2]), 1.0)
    symbols, ends, has_letter = language_id._symbols(texts)
    assert has_letter.tolist() == [True, False, False, True, True, True]
    got = model.logits(symbols, ends)
    for row, (buckets, counts, total) in enumerate(language_id._counts(texts)):
        want = model.offsets + (weights[:, buckets] * counts).sum(1) / max(total, 1) * language_id.SCALE
        assert np.allclose(got[row], want, atol=1e-4)


# Toxicity


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    caught = [r for r in got if r["toxic"]]
    assert sum(r["predicted"] for r in caught) >= 0.6 * len(caught)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(i, i % 2, "x") for i in range(1, 11)] + [(4, 1, "x"), (None, 1, "x"), (5, None, "x")],
        "doc_id long, toxic int, extra string",
    )
    got = toxicity.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, labels).count() == 0
    none = toxicity.score(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_copies_of_one_text_do_not_fill_the_lexicon(spark):
    """A long toxic text with many copies proves nothing, and pushes no word of the others out."""
    own = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}rest" for i in range(600))
    rows = [(own, 1)] * 30 + [(f"zounds and more {i}", 1) for i in range(6)] + [(f"and more {i}", 0) for i in range(9)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    words = toxicity._Words(np.frombuffer(b"zounds aarest", np.uint8), np.array([0, 13]))
    weights = lexicon.weights(words.hashes())
    assert weights[0] > 0 and weights[1] == 0


def test_features_of_a_plain_text():
    import pyarrow as pa

    from broadloom.llm.textarrays import chunks

    words = toxicity._Words(np.frombuffer(b"awful", np.uint8), np.array([0, 5]))
    lexicon = toxicity.Lexicon(words.hashes()[0], np.array([2.0]))
    texts = ["you are AWFUL, so awful", "aw4ul 4wful!", "", None, "fine words"]
    _, _, data, offsets = next(chunks(pa.array(texts)))
    got = dict(zip(toxicity.FEATURES, toxicity._features(data, offsets, lexicon).T, strict=True))
    assert got["lexicon_density"].tolist() == [2 / 5, 1 / 2, 0, 0, 0]
    assert got["hidden_density"].tolist() == [0, 1 / 2, 0, 0, 0]
    assert got["near_second_person"].tolist() == [2 / 5, 0, 0, 0, 0]
    assert got["capital_words"].tolist() == [1 / 5, 0, 0, 0, 0]
    assert got["highest_weight"].tolist() == [2, 2, 0, 0, 0]


# License scan


def test_aligned_pairs_rise_and_agree():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 12, rng.integers(0, 30)).tolist() for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert license_scan.align(a, a) == [(i, i) for i in range(len(a))]


def test_rising_is_longest():
    rng = np.random.default_rng(4)
    for _ in range(100):
        values = rng.permutation(9).tolist()
        got = [values[i] for i in license_scan._rising(values)]
        best = [1] * 9
        for i in range(9):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
        assert len(got) == max(best) and got == sorted(got)


def test_licenses_of_documents(spark, documents, texts):
    notices = {
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "MIT": "Released under the MIT License.",
    }
    for r in license_scan.scan(documents).collect():
        want = sorted(k for k, v in notices.items() if v in texts[r["doc_id"]])
        assert [x for x in r["licenses"].split(",") if x] == want


def test_licenses_of_odd_rows(docs_of, odd, empty):
    got = {r["doc_id"]: r for r in license_scan.scan(odd).collect()}
    assert got[10]["license"] == "Apache-2.0" and got[10]["coverage"] == 1.0 and got[10]["n_matches"] == 1
    assert got[1]["license"] is None and got[1]["coverage"] == 0 and got[1]["licenses"] == ""
    assert license_scan.scan(empty).count() == 0
    long = license_scan.TEMPLATES[1][1]
    changed = long.replace("compliance", "accordance").replace("applicable law", "any applicable local law")
    rows = [
        (1, f"{'x y ' * 4000}{changed} end", "en", "s", 0),
        (2, "Released under the MIT License. text " * 300, "en", "s", 0),
        (3, "under the version of a license released", "en", "s", 0),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert got[1]["license"] == "Apache-2.0" and 0.9 < got[1]["coverage"] < 1 and got[1]["first_word"] == 8000
    assert got[2]["licenses"] == "MIT" and got[2]["n_matches"] >= 100
    assert got[3]["license"] is None


def test_notices_beside_their_longer_relatives(docs_of):
    """A template keeps its other matches if one of them lies in a better one."""
    by, other, between = "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", " and so on" * 9
    rows = [
        (1, f"{other}{between} {by}", "en", "s", 0),
        (2, f"{by}{between} {other}{between} {by}", "en", "s", 0),
        (3, f"{other} {by}", "en", "s", 0),
        (4, other, "en", "s", 0),
    ]
    got = {r["doc_id"]: (r["license"], r["licenses"], r["n_matches"]) for r in license_scan.scan(docs_of(rows)).collect()}
    both = "CC-BY-4.0,CC-BY-SA-4.0"
    assert got == {
        1: ("CC-BY-SA-4.0", both, 2), 2: ("CC-BY-SA-4.0", both, 3), 3: ("CC-BY-SA-4.0", both, 2),
        4: ("CC-BY-SA-4.0", "CC-BY-SA-4.0", 1),
    }


# HTML


def test_articles_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.DOTALL).group(1)
        parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(" ".join(unescape(x).split()) for x in parts if x.strip())
        assert r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li>a</li><li>b</li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, for many, many reasons.</p></div>
<div id="content"><h2>Title &amp; more</h2><p>First paragraph, long enough, with&nbsp;text.
And   more.</p><p>Short.<div class="ad-box">Buy now, really.</div><ul><li>one<li>two</ul>
<form>Your mail <input><button>Go</button></form></div>
<div class="sidebar"><p>Other stories, you may like. Really, do.</p></div>
<section id="comments"><p>Nice, great, I like it. A very long comment, with many, many, many words.</p></section>
<script>if (a < b) document.write("<p>no, no, no</p>")</script><footer>(c) me, you, all.</footer></body></html>"""


def test_page_without_a_declared_article():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph, long enough, with text. And more.\nShort.\none\ntwo"
    declared = PAGE.replace('id="content"', 'id="content" role="main"')
    assert html_text.main_text(declared) == html_text.main_text(PAGE)


def test_names_do_not_drop_text_of_the_article():
    inside = """<h1 class="entry-header">Title</h1><p class="legal">Law, as it is.</p>
<p>Code <span class="token comment">notes</span> and <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, too.</p>
{}<div class="comments"><p>Nice.</p></div><div class="ad-box">Buy.</div>"""
    section = '<section class="related-work"><p>Others, before.</p></section>'
    want = "Title\nLaw, as it is.\nCode notes and x=1, too."
    declared = f"<body><article>{inside.format(section)}</article></body>"
    assert html_text.main_text(declared) == f"{want}\nOthers, before."
    assert html_text.main_text(f"<body><div>{inside.format('')}</div></body>") == want


def test_pages_of_odd_rows(spark):
    rows = [
        (1, "u", None), (2, None, ""), (None, "u", "plain text only"), (3, "u", "<p>a<p>b"), (3, "u", "<p>a<p>b"),
        (4, "u", "<<<"), (5, "u", '<a href="x'), (6, "u", "a < b and c > d"), (7, "u", "<script>x"),
        (8, "u", "<p>" + "long text, " * 50_000 + "</p>"), (9, "u", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (10, "u", "<a <a <a " * 20_000), (11, "u", "&amp;lt; &#x41; &eacute;"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == by[7] == "" and by[None] == "plain text only" and by[3] == "a\nb"
    assert by[4] == "<<<" and by[6] == "a < b and c > d" and by[9] == "deep" and by[11] == "&lt; A é"
    assert len(by[8]) == len("long text, ") * 50_000 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


# Decontamination


def brute_hits(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[k : k + width])].add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words = alnum(text)
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if items_of := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= items_of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def found_hits(rows):
    return sorted((tuple(r)[:6] for r in rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_contamination_of_documents(spark, sf_dir, documents, texts, block_bytes):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    got = decontamination.contamination(documents, benchmark, block_bytes=block_bytes).collect()
    assert found_hits(got) == brute_hits(texts.items(), items)
    assert any(r["contaminated"] for r in got)


def test_contamination_of_odd_rows(spark, odd, empty, documents):
    items = [(1, "Only FOUR words here"), (2, "has: some, words"), (None, "漢字"), (3, None), (4, "!!"), (1, "row without"), (5, "word5x5 word6x6")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, docs string")
    got = decontamination.contamination(odd, benchmark).collect()
    assert found_hits(got) == brute_hits([(r[0], r[1]) for r in ODD], items)
    kept = decontamination.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == sum(not r["contaminated"] for r in got)
    assert decontamination.contamination(empty, benchmark).count() == 0
    none = decontamination.contamination(odd, benchmark.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r["contaminated"] for r in none)


def test_proximity(docs_of, spark):
    docs = docs_of([(1, "red x x green", "en", "s", 0), (2, "green red", "en", "s", 0), (3, "red x x x x green", "en", "s", 0), (4, "red", "en", "s", 0), (5, "green", "en", "s", 0)])
    items = spark.createDataFrame([(7, "red green")], "item_id long, text string")
    got = decontamination.proximity(decontamination.build_index(docs), items, reach=3).collect()
    assert sorted(map(tuple, got)) == [(1, "7", 1), (2, "7", 1)]


# Personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
)


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def base(text):
    return [
        (k, m.start(), m.end(), m.group())
        for k, pattern, good in PATTERNS
        for m in re.finditer(pattern, text or "", re.ASCII)
        if good(m.group())
    ]


def brute_terms(rows):
    """Disclosing terms by their definition, over all rows."""
    n, texts = len(rows), [t or "" for _, t in rows]
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = [{w.lower() for w in re.findall(word, t) if len(w.lower()) >= 3 and re.search("[^0-9]", w)} for t in texts]

    def entity(k, value):
        return (k, value.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", value))

    entities = [{entity(k, v) for k, _, _, v in base(t)} for t in texts]
    n_t = Counter(t for own in terms for t in own)
    strong = defaultdict(set)
    for e in set().union(*entities):
        at = [i for i in range(n) if e in entities[i]]
        if len({texts[i] for i in at}) < private_data.SUPPORT:
            continue
        for t in set().union(*(terms[i] for i in at)):
            both = [i for i in at if t in terms[i]]
            if len({texts[i] for i in both}) < private_data.SUPPORT:
                continue
            if log2(len(both) * n / (len(at) * n_t[t])) / log2(n / len(at)) >= private_data.DISCLOSES:
                strong[e].add(t)
    out = []
    for (doc_id, _), text, own in zip(rows, texts, entities, strict=True):
        found = base(text)
        wanted = set().union(*(strong[e] for e in own)) if own else set()
        added = [
            ("term", m.start(), m.end())
            for m in re.finditer(word, text)
            if m.group().lower() in wanted and not any(a < m.end() and m.start() < b for _, a, b, _ in found)
        ]
        spans = [f"{k}:{a}:{b}" for k, a, b, *_ in [*found, *added]]
        counts = Counter(k for k, *_ in found)
        digest = hashlib.sha256(",".join(spans[: len(found)]).encode()).hexdigest()
        out.append((doc_id, *(counts[k] for k, *_ in PATTERNS), digest, ",".join(spans)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def reported(docs):
    return sorted(map(tuple, private_data.report(docs).collect()), key=lambda r: tuple((x is None, x) for x in r))


def private_rows():
    rows = [(i, f"common words of text number {i} about nothing at all") for i in range(200)]
    rows += [(300 + i, f"common words; Mr Xavier Quent (ceo{i}) wrote from xq@corp.example.org about nothing {i}") for i in range(6)]
    rows += [(400 + i, "copy of Zed Zorro with zz@corp.example.org") for i in range(9)]
    rows += [
        (500, "a@b.c_d@e.f g@h a.b@c-d.e.f. 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.255 1.2.3.1000"),
        (501, "4111 1111 1111 1111 4111-1111-1111-1112 " + "7" * 5000 + " +1 (23) 456-789.0 +1() +12 34567 +1234567890123456"),
        (502, "é漢🙂 xq@corp.example.org 🙂 Quent"),
        (503, "x" * 60_000 + "@"),
        (504, "1 2 " * 20_000),
    ]
    return rows


def test_private_spans(docs_of):
    rows = private_rows()
    got = reported(docs_of([(i, t, "en", "s", 0) for i, t in rows]))
    want = brute_terms(rows)
    assert got == want
    spans = {r[0]: r[-1] for r in got}
    assert spans[300].count("term") >= 2 and "term" not in spans[400]


def test_private_spans_of_documents_and_odd_rows(documents, texts, odd, empty):
    assert reported(documents) == brute_terms(list(texts.items()))
    assert reported(odd) == brute_terms([(r[0], r[1]) for r in ODD])
    assert private_data.report(empty).count() == 0


def test_sanitised_texts(docs_of, odd):
    rows = private_rows()
    got = {r["doc_id"]: r["text"] for r in private_data.sanitise(docs_of([(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert "<email>" in got[300] and "xq@" not in got[300] and "Quent" not in got[300] and "common words" in got[300]
    assert got[0] == rows[0][1] and got[400] == "copy of Zed Zorro with <email>"
    assert got[502].startswith("é漢🙂 <email> 🙂")
    assert private_data.sanitise(odd).count() == len(ODD)


def test_private_data_runs_no_python(documents):
    plan = private_data.base_spans(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_that_clash_are_many():
    assert len(CLASHES) > 40 and LOWER[65] == "a"


def test_words_in_parts_are_the_same_words(texts, monkeypatch):
    import pyarrow as pa

    from broadloom.llm import textarrays

    column = pa.array([*list(texts.values())[:60], "", None, "x"])
    (_, _, data, offsets), = textarrays.chunks(column, 1 << 30)
    whole = textarrays.words(data, offsets, textarrays.ALNUM)
    monkeypatch.setattr(textarrays, "CHUNK_BYTES", 3000)
    parts = textarrays.words_in_parts(data, offsets, textarrays.ALNUM)
    assert (whole.hashes == parts.hashes).all() and (whole.first == parts.first).all()


def test_near_misses_of_notices(docs_of):
    """Coverage alone does not make a license: its name and version must stand there."""
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General " \
          "Public License as published by the Free Software Foundation{} either version {} of the License, or (at your " \
          "option) any later version."  # fmt: skip
    cases = [
        ("Released under the BSD License.", ""),
        ("Licensed under the Apache License.", ""),
        ("Released under the parking license.", ""),
        ("Licensed under CC BY 3.0.", ""),
        ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        (gpl.format(";", "", ";", "2"), "GPL-2.0"),
        (gpl.format(":", "Affero ", ",", "3"), "AGPL-3.0"),
        (gpl.format(":", "", ",", "3"), "GPL-3.0"),
        (gpl.format(":", "", ",", "4"), ""),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under the MIT License.", "MIT"),
    ]
    got = license_scan.scan(docs_of([(i, text, "en", "s", 0) for i, (text, _) in enumerate(cases)])).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: want for i, (_, want) in enumerate(cases)}


def test_every_template_finds_itself(docs_of):
    rows = [(i, t[1], "en", "s", 0) for i, t in enumerate(license_scan.TEMPLATES)]
    for r in license_scan.scan(docs_of(rows)).collect():
        assert r["licenses"] == license_scan.TEMPLATES[r["doc_id"]][0] and r["coverage"] == 1.0


def test_repeated_rows_and_null_ids_over_several_blocks(spark, docs_of):
    texts = ["one two three four five six seven eight nine ten eleven", "nothing of it", None]
    rows = [(k, t, "en", "s", 0) for t in texts for k in (1, 1, None, None, 2)]
    items = [(None, "two three four five six seven eight nine ten eleven"), (None, "nothing of"), ("b", "of it"), ("b", "one two")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    one = decontamination.contamination(docs_of(rows), benchmark)
    index = decontamination.build_index(docs_of(rows).repartition(4), segment_bytes=1)
    several = decontamination.search_index(index, benchmark, block_bytes=8)
    order = lambda df: sorted(map(str, df.drop("tag").collect()))
    assert order(one) == order(several) and len(order(one)) == len(rows)
    assert sum(r["contaminated"] for r in several.collect()) == 10


# Long inputs take time in proportion


@pytest.mark.parametrize(
    "page, n_chars",
    [("<a" * 200_000, 400_000), ("x > " + "<a" * 200_000, 400_004), ("<div>x" * 40_000, 79_999),
     ("<b>" * 40_000 + "</i>" * 40_000 + "x", 1), ("<b><table>" + "<i>" * 40_000 + "</b>" * 40_000 + "x", 1)],
)
def test_long_pages_of_unclosed_tags(page, n_chars):
    began = time.monotonic()
    assert len(html_text.main_text(page)) == n_chars
    assert time.monotonic() - began < 20


def test_what_stands_at_the_last_closing_bracket():
    assert html_text.main_text("<p>one<!-- a > b") == "one"
    assert html_text.main_text("<p>one<!-- a --> two") == "one two"
    assert html_text.main_text("<p>one <![CDATA[a > b") == "one a > b"
    assert html_text.main_text("<p>one<!-- a > b --") == "one"
    assert html_text.main_text("<p>one</p>two <!-- three") == "one\ntwo"


def test_very_many_matches_in_one_text(docs_of):
    text = " ".join(f"a{i}@b.c" for i in range(60_000))
    got = {r["doc_id"]: r for r in private_data.report(docs_of([(i, t, "en", "s", 0) for i, t in ((1, text), (2, "a@b.c"), (3, ""))])).collect()}
    spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text)]
    assert got[1]["n_email"] == 60_000 and got[1]["spans"] == ",".join(spans)
    assert (got[2]["spans"], got[3]["spans"]) == ("email:0:5", "")


def test_terms_beside_and_inside_base_spans(docs_of):
    """A term counts where it stands alone, not where it is part of an address."""
    rows = [(i, f"plain words of text {i}") for i in range(60)]
    rows += [(100 + i, f"Quent quent@corp.org Quent,quent@corp.org;Quent {i} end") for i in range(5)]
    got = reported(docs_of([(i, t, "en", "s", 0) for i, t in rows]))
    assert got == brute_terms(rows)
    last = next(r for r in got if r[0] == 104)
    assert last[-1].count("term:") > last[-1].count("email:") >= 2
