"""Operators 11 to 13 against brute force, and their edge cases."""

import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pageguard.llm import divergence, html_text, spelling
from pageguard.llm.common import table

SF = "/root/testdata/sf0.001"
TREE = html_text.Tree(*html_text.labelled_blocks())


# 11


def article(page):
    """The given pages' article, whose only markup is p, h1, b and br."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(p.replace("<b>", "").replace("</b>", "").replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_main_texts_of_the_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    out = html_text.main_texts(table(spark, SF, "pages")).collect()
    assert len(out) == len(pages) and all(r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in out)


SENTENCE = "The river rose for three days and then fell back to where it had been before the rain."
LAYOUTS = [
    (f'<header><h1>Site</h1><a href=/>Home</a></header><main><article><header><h1>Title</h1></header><p>{SENTENCE}</p><p>Short.</p><aside class="sidebar"><p>{SENTENCE}</p></aside><form><label>Your name</label><input></form><section id="comments"><h2>Comments</h2><p>{SENTENCE}</p></section></article></main><footer>c 2020</footer>', f"Title\n{SENTENCE}\nShort."),
    (f'<div id="topMenu"><a>One</a> <a>Two</a></div><div id="content"><h2>Head</h2><div>{SENTENCE}</div><ul><li>one<li>two</ul></div><div class="reader-comments">{SENTENCE}</div>', f"Head\n{SENTENCE}\none\ntwo"),
    (f'<div class="cookie-notice">{SENTENCE}</div><p>{SENTENCE} <a href="x>y">A link</a>&nbsp;&amp;\n more<p>{SENTENCE}', f"{SENTENCE} A link & more\n{SENTENCE}"),
    (f"<ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul><p>{SENTENCE}</p><p>{SENTENCE}</p><ul><li><a>Next</a><li><a>Last</a></ul>", f"{SENTENCE}\n{SENTENCE}"),
    (f"<article><p>{SENTENCE}</p><div style='display: none'>{SENTENCE}</div><script>if (a < b) {{ '</p>' }}</script><noscript>{SENTENCE}</noscript></article>", SENTENCE),
    ("<p>a&lt;b <b>c</b>d<br>e &#65;&#x42; 1 < 2</p", "a<b cd e AB 1 < 2"),
    ("<script>never closed <p>text</p>", ""),
    ("<!-- never closed <p>text</p>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,text", LAYOUTS)
def test_layouts(page, text):
    assert html_text.main_text(page, TREE) == text


def test_pages_at_the_edge(spark):
    rows = [(1, None, None, 1), (2, "u", "", 2), (None, "v", "<p>x y z</p>", 3), (2, "u", "", 2), (5, "w", "<article><p>" + "word " * 200_000 + "</article>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").select("page_id", "url", "html", "text", "text")
    out = sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in html_text.main_texts(pages.toDF("page_id", "url", "html", "text", "n_chars")).collect())
    assert out == [(0, "v", 5), (1, None, 0), (2, "u", 0), (2, "u", 0), (5, "w", 999_999)]
    assert html_text.main_texts(pages.limit(0).toDF("page_id", "url", "html", "text", "n_chars")).count() == 0


def test_broken_markup_takes_linear_time():
    began = time.time()
    for page in ("<" * 300_000, '<a "' * 100_000, "<div>" * 30_000 + "x", "<!--" * 100_000, "<p " * 100_000, "&" * 300_000, "<script>" * 50_000):
        html_text.main_text(page, TREE)
    assert time.time() - began < 30


def test_tree_splits_where_classes_part():
    x = np.array([[0.0, 5], [1, 5], [2, 1], [3, 1], [4, 9], [5, 9]])
    y = np.array([0, 0, 1, 1, 0, 0])
    assert (html_text.Tree(x, y).classes(x) == y).all()
    assert (html_text.Tree(x, y, depth=0).classes(x) == 0).all()


# 12


def one_apart(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def groups(rows):
    """Brute force of the contract: word -> form, root, n, n_near, form_n."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    near = {w: [v for v in n if one_apart(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b is not None and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def test_trie_pairs():
    rng = random.Random(1)
    for t in range(150):
        words = sorted({(rng.randrange(3), "".join(rng.choices("ab" if t % 2 else "abcé", k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 60))})
        raw = [w.encode("latin-1") for _, w in words]
        at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        x, y, shared = spelling.trie_pairs(np.array([g for g, _ in words], np.int64), np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), at)
        assert sorted((min(p), max(p)) for p in zip(x.tolist(), y.tolist())) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if words[i][0] == words[j][0] and one_apart(words[i][1], words[j][1])]
        for i, j, k in zip(x.tolist(), y.tolist(), shared.tolist()):
            u, v = words[i][1], words[j][1]
            assert u[:k] == v[:k] and u[k : k + 1] != v[k : k + 1]


@pytest.mark.parametrize("most,trie", [(spelling.CELL, spelling.TRIE), (3, 10)])
def test_variant_groups(spark, monkeypatch, most, trie):
    monkeypatch.setattr(spelling, "TRIE", trie)
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(most)
    stems = ["".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaa", "ababab" * 40]
    pool = []
    for s in stems:
        pool += [s] * rng.choice([5, 30, 200])
        for _ in range(12):
            i = rng.randrange(len(s))
            pool += [rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcÉx") + s[i:], s[:i] + rng.choice("abcx") + s[i + 1 :]])] * rng.choice([1, 5, 6, 40])
    pool += ["kettles"] * 400 + ["kettels"] * 60 + ["ketels"] * 9 + ["ketelsa"] * 400 + ["zzzaaab"] * 5 + ["zzzaaac"] * 40 + ["zzzaadc"] * 400
    rng.shuffle(pool)
    rows = [(i, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) for w in pool[i * 20 : i * 20 + 20]) + rng.choice(["", " naïve-été ", " 漢字, x1y2 "])) for i in range(len(pool) // 20 + 1)]
    rows += [(None, None), (None, " ".join(pool[:50])), (7, ""), (7, rows[7][1]), (99, "x" * 50_000 + " ")]
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, text string, n long, word string, cell int")
    # Small cells are cut again; each word may then stand in many of them.
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variant_groups(docs, most).collect()}
    want = groups(rows)
    assert {w: (v, want.get(w)) for w, v in out.items() if v != want.get(w)} == {} and out.keys() == want.keys()
    assert any(v[0] for v in want.values()) and any(v[1] != v[0] for w, v in want.items() if v[0])


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "short ones only")], "doc_id long, text string")
    assert spelling.variant_groups(docs).count() == 0 and spelling.variant_groups(docs.limit(0)).count() == 0


# 13


def audited(rows):
    """Brute force of the contract, in Python's whole numbers."""
    counts, docs, found = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        found.add((lang, source))
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, source in found:
        kept = [t for t, d in docs[lang].items() if d >= 3]

        def prob(c):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        p = prob(counts[lang, source])
        whole = prob(sum((counts[g] for g in found if g[0] == lang), Counter()))
        pairs = [(-sum(f(p[t], q[t]) for t in kept), s) for _, s, q in ((x, s, prob(counts[x, s])) for x, s in found if x == lang and s != source)]
        terms = [(-f(p[t], whole[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        out |= {(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs))}
        out |= {(lang, source, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:200])}
    return out


@pytest.mark.parametrize("heavy,cells,tile", [(0.25, 4_000_000, 256), (0.0, 4_000_000, 7), (2.0, 20, 256), (0.5, 30, 3)])
def test_divergence(spark, monkeypatch, heavy, cells, tile):
    for name, value in (("HEAVY", heavy), ("CELLS", cells), ("TILE", tile), ("GO", 40), ("HELD", 30)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    words = [rng.choice("abcÉñ漢") + "".join(rng.choices("xyz", k=rng.randint(0, 3))) for _ in range(60)]
    rows = [(rng.choice(["en", "en", "de", None, "fr"]), rng.choice([*"ABCDEFG", None]), " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 30)))) for _ in range(150)]
    rows += [("en", "none", ""), ("en", "null", None), ("xx", "A", "once only"), ("xx", "B", None), ("alone", "A", "a a a"), ("alone", "A", "a"), ("alone", "A", "a b")] + rows[:5]
    rows += [("en", "A", "big " * 5000)] * 3
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, count long, term long")
    out = [tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(out) == len(set(out)) and set(out) == audited(rows)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_probabilities_of_large_counts():
    sizes = np.array([9_000_000_000_000, 10**12, 7, 1], np.int64)
    counts = np.array([8_999_999_999_998, 3, 5, 0], np.int64)
    assert divergence.probabilities(counts, sizes).tolist() == [1 + 10**9 * (c + 1) // n for c, n in zip(counts.tolist(), sizes.tolist())]
