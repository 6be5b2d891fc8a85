"""Operators that judge each row by itself, against plain versions of their contracts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconframe.llm import html_text, licenses, packing, quality, url_rules
from beaconframe.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int, place string, mix int"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", "s", 1, 7, "p", 1) for i, t in enumerate(texts)], DOCS)


# --- URL rules --------------------------------------------------------------------------------

URLS = [
    "https://www.example.com/en/a?x#y", "http://EXAMPLE.com/en/", "http://example.com/en", "http://notexample.com/en/x", "x.net/es/", "ftp://a.b.NET/es/1", "http://net/fr/?q", "http://net./fr/", "http://a.org/", None, "", "://", "a://b://c.com/",
    "http://www.example.com/de/en/", "http://deep.www.example.com/en/p", "http://com", "http://com/", "http://x.com:80/en/", "http://user@example.com/en/z", "http://exämple.com/\u2028en/", "http://h.com#/a", "http://example.com\n/en/",
]


def plain_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(-len(r.host), -len(r.path), i) for i, r in enumerate(rules) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    r = rules[min(fits)[2]]
    return host, path, r.host + r.path, r.verdict


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "k") for i, u in enumerate(URLS)] + [(None, URLS[0], "x", "k")] * 2, "page_id long, url string, key string, stack string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(pages).collect()}
    assert got == {i: plain_url(u, url_rules.RULES) for i, u in enumerate(URLS)} | {None: plain_url(URLS[0], url_rules.RULES)}
    assert url_rules.judge_urls(pages).count() == len(URLS) + 2
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_url_rules_in_many_ranges(spark):
    rng = np.random.default_rng(1)
    names = ["a", "b", "com", "net", "x-y", "é"]
    host = lambda: ".".join(rng.choice(names, rng.integers(1, 4)))
    rules = list({(h, p): url_rules.UrlRule(rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(["/", "/a/", "/a/b"])) for _ in range(60))}.values())
    urls = [f"http://{host()}{rng.choice(['', '/', '/a/x', '/a/b/c'])}" for _ in range(300)]
    got = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, segments_per_range=10)
    assert {r["page_id"]: tuple(r)[1:] for r in got.collect()} == {i: plain_url(u, rules) for i, u in enumerate(urls)}


# --- quality -----------------------------------------------------------------------------------


def plain_stats(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(WORDS.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(), st.lists(st.sampled_from(["a", "b", "cé", "#", "\n", " ", "\u2003", "\x1f", "\x85"]), max_size=60).map(" ".join)))
def test_text_stats(text):
    assert quality.text_stats(text) == plain_stats(text)


def test_repeated_windows_of_many_words():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 9000, 30000)]
    words[20000:20020] = words[100:120]
    assert quality.repeated_words(words) == plain_stats(" ".join(words))[4] >= 40


ENGLISH = "The house stood on the hill and the wind was in the trees, for it is that time of the year when the light is low. " * 2
PROSE = (
    "When the first of the settlers came to the valley, they found that the river had already made most of the decisions for them. It ran from the north in a long, slow "
    "curve, and on the inner side of that curve the soil was dark and deep. The houses were built there, close to one another, with their backs to the wind. A mill was "
    "added in the second year, and a school in the fifth. For a time it was thought that the road would follow the water, as roads often do, but the engineers who came "
    "from the capital had other plans, and by the end of the decade the village was an hour from the nearest crossing. Nobody who lived there seems to have been sorry about this."
)


def test_quality_verdicts(spark):
    junk = " ".join(f"{c}{i}%%% $$$" for i, c in enumerate("qwertzuiopasdfghjklyxcvbnm" * 2))
    got = {r["doc_id"]: r for r in quality.judge_quality(docs(spark, PROSE, junk, None, "", "a b", ENGLISH * 3, "x" * 200_000)).collect()}
    assert got[0]["kept"] and not got[0]["base_failed"] and got[0]["divergence"] < 0.27
    assert not got[1]["kept"] and not got[1]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2, 3, 4, 5, 6))
    kept = quality.judge_quality(docs(spark, PROSE, junk, None), keep_rows=True)
    assert kept.columns == docs(spark).columns and [r["doc_id"] for r in kept.collect()] == [0]
    assert quality.judge_quality(docs(spark, ids=[])).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_labelled_documents(spark):
    """Good documents stay, but for those that the base rules reject; most junk goes."""
    path = "/root/testdata/sf0.001"
    judged = quality.judge_quality(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("NOT base_failed AND n_words >= 50").collect()
    good, junk = ([r["kept"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert all(good) and sum(junk) <= 0.2 * len(junk)


def test_js_distance():
    p = np.array([1.0, 0, 0])
    assert quality.js_distance(p, p) == 0 and quality.js_distance(p, np.array([0, 1.0, 1.0])) == 1
    q = np.array([1.0, 2, 3])
    assert abs(quality.js_distance(p, q) - quality.js_distance(q, p)) < 1e-12


# --- packing ------------------------------------------------------------------------------------


def test_tokens_equal_the_json_vocabulary(spark):
    import public_tokenizers

    fast, slow = packing.load_encoder(**_vocabulary()), packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(), st.text("ab \n\t'sdé\u00a0\u2003\u3000\x85\x1c0٣²漢🙂"), st.just("a<|endoftext|>b<|endoftext|>")))
    def check(text):
        assert fast(text).tolist() == slow(text).tolist()

    check()
    for long in ("x" * 50_000, " " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 500_000 + "b", " " * 1_000_000 + "x", "\u3000" * 300_000, " " * 9_999 + "."):
        assert fast(long).tolist() == slow(long).tolist()


def _vocabulary():
    v = vocabulary()
    return {"path": v["vocabulary"], "ranks": v["ranks"], "pattern": v["pattern"]}


def check_packing(spark, rows, capacity=1024):
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    pieces = packing.pack(rows, **vocabulary(), capacity=capacity, with_ids=True).collect()
    encode = packing.load_encoder(**_vocabulary())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] == len(p["ids"]) > 0 and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for doc, text in texts.items():
        own = sorted(by_doc.pop(doc), key=lambda p: p["start"])
        ids = [*encode(text or "").tolist(), 0]
        assert [i for p in own for i in p["ids"]] == ids and {p["doc_tokens"] for p in own} == {len(ids)}
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
    assert not by_doc
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        assert sum(p["length"] for p in own) <= capacity
    return len(by_sequence), sum(p["length"] for p in pieces)


def test_packing(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "a", *(" ".join(rng.choice(["the", "word", "é", "x\n"], n)) for n in rng.integers(1, 3000, 60)), "long " * 20_000]
    n, total = check_packing(spark, docs(spark, *texts).repartition(6))
    assert n * 1024 - total < 0.01 * total + 1024
    check_packing(spark, docs(spark, *texts[:20]).repartition(3), capacity=1000)
    assert packing.pack(docs(spark), **vocabulary()).count() == 0
    twice = packing.pack(docs(spark, "a b", "a b", ids=[None, None]), **vocabulary()).collect()
    assert len(twice) == 2 and {r["doc_id"] for r in twice} == {None}


@given(st.integers(1, 5000), st.sampled_from([16, 100, 1000, 1024]))
def test_cut_lengths(n, capacity):
    lengths = packing.cut_lengths(n, capacity)
    assert sum(lengths) == n and all(0 < x <= capacity for x in lengths) and len(lengths) <= n // capacity + 40


def test_first_fit():
    bins = packing.first_fit([(i, n) for i, n in enumerate([5, 5, 5, 3, 2, 10])], 10)
    assert all(sum(n for _, n in b) <= 10 for b in bins) and sorted(i for b in bins for i, _ in b) == list(range(6)) and len(bins) == 3


# --- HTML ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href='/x>y'>More &gt;</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><article class="post"><h1>Fish &amp; chips</h1><p>First <b>para</b>graph,&nbsp;with
  spaces.<br><p>Second &#8211; <i>one<p>Third</article><aside><p>Read this instead of the article, it is much longer than the article is.</p></aside>
<div class="comments"><article class="comment"><p>A very long comment by a reader that goes on and on, more words than the article itself has in total.</p></article></div></div>
<form><label>Mail</label><input><p>Subscribe</p></form><footer>&copy; us</footer><!-- no --></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Fish & chips\nFirst paragraph, with spaces.\nSecond – one\nThird"
    plain = PAGE.replace("article", "div")
    assert html_text.main_text(plain).split("\n")[0] == "Fish & chips" and "reader" not in html_text.main_text(plain) and "Third" in html_text.main_text(plain)
    for empty in (None, "", "   ", "<html></html>", "<body><nav>x</nav></body>", "<script>x", "<!-- x"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("just text & more") == "just text & more"
    assert html_text.main_text("a < b <3 x") == "a < b <3 x"
    assert html_text.main_text("<p>" + "<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<body><p>" + "word " * 50_000 + "</p>").count("word") == 50_000


LAYOUTS = {
    "<body><div id='header'><h1>Site</h1></div><div id='content'><h2>Title</h2><p>One long paragraph with words.</p><p>And two more of them here.</p></div><div id='footer'>c</div></body>": "Title\nOne long paragraph with words.\nAnd two more of them here.",
    "<div class='layout sidebar-left'><main><article><div class='post-header'><h1>Title</h1></div><p>Text with <a href='x'>a link</a> in it.</p><ul><li>One<li>Two</ul><table><tr><td>cell</table><blockquote>Quote</blockquote></article><section class='related'><article><p>Other article</p></article></section></main></div>": "Title\nText with a link in it.\nOne\nTwo\ncell\nQuote",
    "<main><h1>T</h1><p>Body text of the page.</p><div class='AdSlot'>Buy</div><section id='comments'><h3>Comments</h3><p>Nice one</p></section><div role='dialog'>x</div><noscript>y</noscript></main>": "T\nBody text of the page.",
    "<article class='post'><h1>A&lt;b&gt;</h1><p>x<br>y<p hidden>no</p><pre>a  b\n c</pre><figure><figcaption>Cap</figcaption></figure></article>": "A<b>\nx y\na b c\nCap",
    "<body><nav>Menu</nav><p>Plain page text.</p><p>More of it.</p></body>": "Plain page text.\nMore of it.",
    "<article><h1>T</h1><p>" + "word " * 20 + "</p><section class='search-results-study'><p>We ran a search study.</p></section><div hidden aria-hidden='true'>no</div><div class='ad-box'>Buy</div></article>": "T\n" + ("word " * 20).strip() + "\nWe ran a search study.",
    "<body><div class='x'>Short and alone.</div><div class='y'><p>" + "Dense text. " * 20 + "</p><p>" + "And more of it. " * 20 + "</p></div></body>": ("Dense text. " * 20).strip() + "\n" + ("And more of it. " * 20).strip(),
    "<p>Cut <a href='x'>off</a> here <a title='y": "Cut off here",
    "<div class='entry'><div class='comments'><p>c</p></div><p>Only this</p></div>": "Only this",
}


def test_layouts():
    for page, want in LAYOUTS.items():
        assert html_text.main_text(page) == want, page


def test_broken_and_deep_pages_are_read_in_time():
    import time

    began = time.process_time()
    for page in ("<a " + 'x="y" ' * 40, '<a ="' * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<p>" * 20_000, "<i><div>" + "<b>" * 5_000 + "</i>" * 5_000 + "end"):
        html_text.main_text(page)
    assert time.process_time() - began < 20
    assert html_text.main_text("<i><div>" + "<b>" * 5_000 + "</i>" * 5_000 + "end") == "end"


def plain_densities(body):
    """Density and sum of children's densities of each node, each counted anew from the definition."""
    def below(x):
        return [x, *(z for y in x.items if isinstance(y, html_text._Node) for z in below(y))]

    def letters(x):
        return sum(len("".join(y.split())) if isinstance(y, str) else letters(y) for y in x.items)

    def linked(x):
        return letters(x) if x.tag == "a" else sum(linked(y) for y in x.items if not isinstance(y, str))

    def density(x):
        c, lc, t, lt = letters(x), linked(x), len(below(x)) - 1, sum(y.tag == "a" for y in below(x)[1:])
        rate = linked(body) / letters(body) if letters(body) else 0
        base = np.log(c / max(1, c - lc) * lc + rate * c + np.e)
        return c / max(1, t) * np.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt)) + 1e-9) / np.log(max(base, 1 + 1e-9)) if c else 0

    return {id(x): (density(x), sum(density(y) for y in x.items if not isinstance(y, str))) for x in below(body)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href='x'>", "</a>", "some text", "a", " "]), max_size=30).map("".join))
def test_densities_equal_brute_force(page):
    root = html_text.parse(page)
    want = plain_densities(root)
    for x in html_text._measure(root):
        assert np.allclose((x.density, x.total), want[id(x)], rtol=1e-6, atol=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "<div>", "</div>", "<b>", "</b>", "<li>", "<td>", "<tr>", "<table>", "</table>", "<a href=\"x\">", "<a", "text", " ", "&amp;", "<br/>", "<body>", "<html>", "</html>", "<!--", "-->", "<script>", "</script>", "\"", "<article>", "</article>"]), max_size=40).map("".join))
def test_any_page_is_read(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 1), (1, "u", PAGE, 1)], "page_id long, url string, html string, text int")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 3 and all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert html_text.extract_text(pages.limit(0)).count() == 0


# --- licenses -----------------------------------------------------------------------------------


def test_patience():
    words = "a b c d e f".split()
    assert licenses.patience_align(words, words) == [(i, i) for i in range(6)]
    got = licenses.patience_align("x a b y c a d".split(), "a b c a d".split())
    assert [("x a b y c a d".split()[i], "a b c a d".split()[j]) for i, j in got] == [(w, w) for w in "a b c a d".split()]
    assert licenses.patience_align([], words) == [] and licenses.patience_align("a a".split(), "a a a".split()) == [(0, 0), (1, 1)]


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_patience_is_a_common_subsequence(a, b):
    got = licenses.patience_align(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_scan():
    scanner = licenses.LicenseScanner()
    names = lambda text: [x[0] for x in scanner.scan(text)]
    for t in licenses.TEMPLATES:
        found = scanner.scan(f"Before it. {t.text}\nAnd after.")
        assert [(x[0], x[1]) for x in found] == [(t.license_id, 1.0)] and found[0][2] == 2
    assert names("Released under the MIT License. " * 3) == ["MIT"] * 3
    assert names("licensed under\ncc BY-NC 4.0, and later: Licensed under CC BY 4.0!") == ["CC-BY-NC-4.0", "CC-BY-4.0"]
    assert names("This work is licensed by the GNU General Public License, version 3.") == ["GPL-3.0"]
    # Words of the template right before a notice don't shift it.
    for before in ("under the", "the of the 2.0 a license", "this work is"):
        assert [x[:2] for x in scanner.scan(f"{before} Licensed under the Apache License, Version 2.0. The end")] == [("Apache-2.0", 1.0)]
        assert [x[:2] for x in scanner.scan(f"{before} x This work is licensed under the GNU General Public License, version 3.")] == [("GPL-3.0", 1.0)]
    for none in (None, "", "The license of this work is a general one, under the public version.", "license " * 5000):
        assert names(none) == []
    assert scanner.scan("filler words here " * 20_000 + "Licensed under CC BY 4.0.")[0][2] == 60_000


def test_names_and_versions_are_not_mixed_up():
    scanner = licenses.LicenseScanner()
    for text, want in {
        "This work is licensed under the Zlib License.": ["Zlib"], "Licensed under the Mozilla License, Version 2.0": [], "Licensed under the Eclipse License, Version 2.0": [],
        "Licensed under the Apache License, Version 1.1": ["Apache-1.1"], "This work is licensed under the GNU Lesser General Public License, version 2.": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": ["CC-BY-NC-4.0"],
        "This work is licensed under the GNU GPL version 4": [], "This work is licensed under the GNU General Public License, version 4.": [],
    }.items():
        assert [x[0] for x in scanner.scan(text)] == want, text


def plain_licenses(text, templates, coverage=0.85, purity=0.75):
    """By longest common subsequences of all stretches of the text; names of the licenses that any has."""
    words, found = licenses.license_words(text), set()
    for t in templates:
        own, must = licenses.license_words(t.text), [licenses.license_words(p) for p in t.required]
        for a in range(len(words)):
            if words[a] not in own:
                continue
            row, width = [0] * (len(own) + 1), int(len(own) * 1.25) + 1
            for b in range(a, min(len(words), a + width)):
                new = [0]
                for j, w in enumerate(own):
                    new.append(row[j] + 1 if words[b] == w else max(row[j + 1], new[j]))
                row = new
                here = words[a : b + 1]
                if row[-1] >= coverage * len(own) and row[-1] >= purity * (b + 1 - a) and all(any(here[i : i + len(m)] == m for i in range(len(here))) for m in must):
                    found.add(t.license_id)
    return found


def test_scan_equals_brute_force():
    rng = np.random.default_rng(8)
    some = [t for t in licenses.TEMPLATES if t.text.startswith(("This work is", "Released under"))] + [t for t in licenses.TEXTS if t.license_id in ("MPL-2.0", "GPL-3.0", "GPL-2.0")]
    scanner = licenses.LicenseScanner(some)
    filler = "the work of a public house under general version 2.0 and license in the wind".split()
    for _ in range(120):
        notice = some[rng.integers(len(some))].text.split()
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(len(notice)))
            notice[at : at + int(rng.integers(0, 2))] = list(rng.choice([*filler, "Lesser", "GNU", "3", "4.0"], rng.integers(0, 2)))
        text = " ".join([*rng.choice(filler, rng.integers(0, 12)), "x", *notice, "y", *rng.choice(filler, rng.integers(0, 12))])
        assert {x[0] for x in scanner.scan(text)} == plain_licenses(text, some), text


def test_many_notices_in_one_text():
    assert len(licenses.LicenseScanner().scan("Released under the MIT License, and then. " * 3000)) == 3000


def test_scan_licenses(spark):
    got = licenses.scan_licenses(docs(spark, "Released under the MIT License.", None, "", "none", ids=[4, 5, 6, None])).collect()
    assert [tuple(r) for r in got] == [(4, "MIT", 1.0, 0, 4)]
    assert licenses.scan_licenses(docs(spark, "Released under the MIT License."), templates=[]).count() == 0
    assert licenses.scan_licenses(docs(spark)).count() == 0


@pytest.mark.parametrize("rate", [0.85])
def test_edited_notice(rate):
    words = next(t.text for t in licenses.TEXTS if t.license_id == "MIT").split()
    edited = " ".join(w for i, w in enumerate(words) if i < 9 or i % 12)
    found = licenses.LicenseScanner(coverage=rate).scan(f"x y {edited} z")
    assert [x[0] for x in found] == ["MIT"] and rate <= found[0][1] < 1
