"""Source divergence, the Merkle manifest and main texts against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import html_blocks, merkle
from skerry.llm.divergence import source_divergence
from skerry.llm.html_blocks import LABELLED, article, blocks_of, features, grow, main_text, predict, trained
from skerry.llm.merkle import merkle_manifest, tampered_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def divergence(docs, least):
    """(lang, source, part, item, value, rank) by evaluating every term for every pair."""
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    df, counts = collections.Counter(), collections.Counter()
    for text, lang, source in docs:
        words = TERM.findall(lower(text))
        df.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {d[1] for d in docs}:
        kept = sorted(w for (x, w), n in df.items() if x == lang and n >= least)
        sources = sorted({d[2] for d in docs if d[1] == lang}, key=str.encode)
        of = {s: [counts[lang, s, w] for w in kept] for s in sources}
        whole = [sum(c) for c in zip(*of.values())] if kept else []
        share = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((t, sum(map(f, p[s], p[t]))) for t in sources if t != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((w, f(a, b)) for w, c, a, b in zip(kept, of[s], p[s], q) if c > 0 and a > b), key=lambda x: (-x[1], x[0].encode()))[:10]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (item, value) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_source_divergence(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "é", "语言", "WORD", "word", "\x80x"]
    docs = []
    for i in range(300):
        source = "hot" if i % 3 else rng.choice(["b", "c", "ä", None, ""])
        words = rng.choices(vocabulary, [1 / (1 + k) for k in range(len(vocabulary))], k=rng.randrange(0, 40))
        docs.append((rng.choice(["-", " ", "1", "_"]).join(words) if i % 17 else None, rng.choice(["en", "fr", None]), source))
    docs += [("", "lonely", "x"), ("one two", "lonely", "y"), ("z" * 50_000 + " word" * 60_000, "en", "b")]
    got = source_divergence(spark.createDataFrame(docs, "text string, lang string, source string").repartition(5), least_docs=4).collect()
    assert sorted(map(tuple, got)) == divergence(docs, 4)


def test_source_divergence_odd(spark, odd_docs, no_docs):
    assert source_divergence(no_docs).count() == 0
    docs = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    for least in (1, 2, 10):
        assert sorted(map(tuple, source_divergence(odd_docs, least).collect())) == divergence(docs, least)


def test_shares_are_exact_beyond_longs(spark):
    from skerry.llm.divergence import apart, share

    rows = [(10**17, 3 * 10**17, 10**6), (0, 9 * 10**17, 1), (5, 7, 3)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
    assert spark.range(1).select(apart(F.lit(10**9 + 1), F.lit(1)).alias("f")).first().f == (10**9) ** 2 // (10**9 + 2)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows, tampered):
    """Plain trees: a row (leaf, subroot, root, proof, folded root, verified) for each row of (doc_id, source, lang, n_chars, text)."""

    def digest(row, fold=False):
        text = lower(row[4]) if fold and row[4] is not None else row[4]
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def grown(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        out = []
        for nodes in levels[:-1]:
            start = i - i % 8
            out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
            i //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        trees[lang] = own, grown([digest(r) for r in own])
    top = grown([trees[lang][1][-1][0] for lang in langs])
    root, out = top[-1][0], []
    for at, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, row in enumerate(own):
            path = way(levels, i) + way(top, at)
            folded = digest(row, tampered(row))
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((row[0], levels[0][i], levels[-1][0], root, sha(*(left + right for left, right in path)), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def third(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0


def test_merkle_manifest_of_many_blocks(spark):
    """Trees of several blocks, one of a block and a leaf, one leaf alone, a null lang; more languages than a run holds."""
    rng = random.Random(3)
    sizes = {"en": 9001, "fr": 4097, "de": 4096, None: 70, "": 9, "x": 1} | {f"l{i}": 2 for i in range(12)}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 20011, rng.choice([None, "src", "sö"]), lang, rng.choice([None, 5]), rng.choice([None, "", "Some Text", "lower", "É Ü"])))
    got = merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(6), tampered_rows()).collect()
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(manifest(rows, third), key=key)
    assert 0 < sum(r.verified for r in got) < len(got)


def test_merkle_manifest_odd(spark, odd_docs, no_docs):
    assert merkle_manifest(no_docs).count() == 0
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()]
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    for changed, which in ((None, lambda r: False), (tampered_rows(), third)):
        assert sorted((tuple(r) for r in merkle_manifest(odd_docs, changed).collect()), key=key) == sorted(manifest(rows, which), key=key)
    one = merkle_manifest(odd_docs.where("doc_id = 9")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_merkle_blocks_are_aligned():
    leaves = np.frombuffer("".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(100)).encode(), np.uint8).reshape(-1, 64)
    assert [len(x) for x in merkle._levels(leaves, 100)] == [100, 13, 2, 1]
    assert [len(x) for x in merkle._levels(leaves[:1], 5000)] == [1, 1, 1, 1, 1]  # a last block of a larger tree goes up as far as the others
    assert merkle._siblings(merkle._levels(leaves, 100), 99)[0] == (leaves[96:99].tobytes(), b"")


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; example.org &middot; All rights reserved by somebody.</footer>"
TEXTS = ["A first paragraph with a few words &amp; more of them to read.", "Tiny.", "Another one that goes on and on, for as long as it takes to say what is to be said here.", "x", "The end of it all comes with a last sentence of fair length."]
PLAIN = [t.replace("&amp;", "&") for t in TEXTS]
PAGES = {
    "article": ("<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>" + MENU + '<!-- ad --><div class="ad">Buy some of these things now, they are good.</div><article><h1>Head line</h1>' + "".join(f"<p>{t}</p>" for t in TEXTS) + "</article>" + FOOT + "</body></html>", ["Head line", *PLAIN]),
    "unclosed": (MENU + "<article><h1>Head line</h1><p><b>" + TEXTS[0] + "<br><p>" + TEXTS[1] + "<p>" + TEXTS[2] + "</article>" + FOOT, ["Head line", *PLAIN[:3]]),
    "comments inside": ("<article><h1>Head line</h1>" + "".join(f"<p>{t}</p>" for t in TEXTS) + '<section id="comments"><h2>Comments</h2><div class="comment"><p>What a nice text this is, I liked to read it very much, all of it.</p></div></section></article>', ["Head line", *PLAIN]),
    "sidebar and form": ('<div class="page with-sidebar"><div class="sidebar"><h3>Popular</h3><p>Some other text that many others like to read these days, or so they say.</p></div><main><h1>Head line</h1>' + "".join(f"<p>{t}</p>" for t in TEXTS) + '<form action="/s"><label>Your mail</label><input name="m"><button>Go on</button></form></main></div>', ["Head line", *PLAIN]),
    "notice": ('<div id="cookie-notice"><p>We and our partners store things on your device, as long as you let us do so, which you should.</p></div><header><h2>The Site</h2></header><article><header><h1>Head line</h1></header>' + "".join(f"<p>{t}</p>" for t in TEXTS) + "</article>", ["Head line", *PLAIN]),
    "plain": ('<html><body><p><a href="/">Home</a> <a href="/x">News</a></p><h1>Head line of a page</h1><p>' + "many words " * 30 + "</p><p>Tiny.</p><p>" + "other words " * 25 + '</p><p><a href="/i">Imprint</a> <a href="/j">Contact us</a></p></body></html>', ["Head line of a page", ("many words " * 30).strip(), "Tiny.", ("other words " * 25).strip()]),
    "links in text": ('<article><h1>Head line</h1><p>Read <a href="/q">this long piece of theirs about it</a> first.</p><p><a href="/r">All of this is a link</a></p></article>', ["Head line", "Read this long piece of theirs about it first.", "All of this is a link"]),
    "only a menu": (MENU + FOOT, []),
}


def test_main_text(spark, no_docs):
    rows = [(i, f"http://x/{k}", page) for i, (k, (page, _)) in enumerate(PAGES.items())] + [(90, None, None), (None, "u", ""), (91, "v", "   "), (91, "v", "   "), (92, "w", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "'clash' as n_chars", "'clash' as words")
    got = {(r.page_id, r.url): r for r in main_text(df).collect()}
    for i, (k, (_, want)) in enumerate(PAGES.items()):
        assert got[i, f"http://x/{k}"].text == "\n".join(want), k
    assert got[90, None].text == got[None, "u"].text == got[91, "v"].text == "" and got[91, "v"].n_chars == 0
    assert got[92, "w"].text.count("\n") == 19_999 and got[92, "w"].n_chars == 20_000 * 5 - 1
    assert main_text(df).count() == len(rows) and main_text(df.limit(0)).count() == 0


def test_blocks():
    got = blocks_of("<div>One <b>two</b>&nbsp;&lt;three&gt;\n <a href='x>y'>four five</a></div>tail<script>no</script> &#8364;<p>six<br>seven<td>eight")
    assert [(b.text, b.words, b.linked) for b in got] == [("One two <three> four five", 5, 2), ("tail €", 2, 0), ("six seven", 2, 0), ("eight", 1, 0)]
    assert [b.text for b in blocks_of("a < b and c > d <3 </nothing> x<!-- gone <p> -->y<!-- open")] == ["a < b and c > d <3", "xy"]
    assert [b.text for b in blocks_of("<title>t</title><textarea>u</textarea><noscript>v</noscript>w")] == ["w"]
    assert blocks_of("") == [] and blocks_of("<p> </p>&nbsp;") == []


def test_odd_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ('<b a="' * 100_000, "<div>" * 100_000 + "x", '<a href="x" ' * 50_000, "<!--" * 50_000, "</p>" * 100_000, "<script>" * 20_000, "<p><b>x" * 50_000):
        article(page, trained())
    assert time.time() - began < 30


def test_tree_is_trained_on_the_table():
    x = np.vstack([features([b[1:] for b in page]) for page in LABELLED])
    y = np.array([b[0] for page in LABELLED for b in page])
    assert len(y) <= 200 and (predict(trained(), x) == y).mean() > 0.97
    wrong = total = 0
    for k in range(len(LABELLED)):  # each page by a tree grown from the others
        rest = [p for i, p in enumerate(LABELLED) if i != k]
        tree = grow(np.vstack([features([b[1:] for b in p]) for p in rest]), np.array([b[0] for p in rest for b in p]))
        own = np.array([b[0] for b in LABELLED[k]])
        wrong, total = wrong + int((predict(tree, features([b[1:] for b in LABELLED[k]])) != own).sum()), total + len(own)
    assert wrong / total < 0.15
    assert grow(np.zeros((4, 2)), np.array([1, 1, 0, 1])) == 1 and html_blocks.features([]).shape == (0, 9)
