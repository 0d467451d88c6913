import base64
import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fleetspark.llm import dom, fingerprints, jaccard_join
from fleetspark.llm.components import components
from fleetspark.llm.fingerprints import CUT, edited_versions
from fleetspark.llm.html_extraction import main_text
from fleetspark.llm.jaccard_join import Settings, counts_of, jaccard_components, needed, one_of_each, prefix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {(i, len(sets[i]), root[i]) for i in sets}


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    line = " ".join(rng.choice(words) for _ in range(12))
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 130))] for _ in range(12)]
    out = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words).upper()
        out.append((line + "\n" if rng.random() < 0.4 else "") + " ".join(own))
    return out


@pytest.mark.parametrize("settings", [Settings(), Settings(sample=1, frequent=2, leaf=2, fan=2, block=5, nearest=1, near_part=4)])
def test_components_are_brute_force(spark, settings):
    rows = list(enumerate([*texts(1), None, "", " \n", "one two", "ONE\ttwo", "É é", "é É", "x " * 30_000, "x " * 30_000 + "y"], start=5))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    out = jaccard_components(docs, settings)
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, "")], "doc_id long, text string")
    out = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert out == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, None)], key=str)
    assert sorted(r.doc_id or 0 for r in one_of_each(docs).collect()) == [0, 1, 3]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(1, 2**62, 80).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 80))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        points = jaccard_join.Points(np.array([len(a), len(b)]), [counts_of(a).tobytes(), counts_of(b).tobytes()])
        if 5 * both >= 4 * (len(a) + len(b) - both):
            s = Settings()
            assert both >= needed(np.array([len(a)]), np.array([len(b)]), s)[0]
            assert points.alike(np.array([0]), np.array([1]), s)[0]
            frequent = np.sort(rng.choice(pool, 20))
            assert len(np.intersect1d(prefix(a, frequent, s), prefix(b, frequent, s)))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (7, 7)]
    out = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {50: 50, 75: 50, 100: 50}


def digests_of(fingerprint):
    """All digests that a fingerprint gives back, by peeling its table; nothing but the string is used."""
    n, size, cells = fingerprint.split("-")
    n, size, data = int(n, 16), int(size, 16), base64.b64decode(cells)
    step = 8 if size <= 14 else 10
    table = {int.from_bytes(data[k : k + step - 6]): int.from_bytes(data[k + step - 6 : k + step]) for k in range(0, len(data), step)}
    hashed = lambda x, part: xxhash.xxh64_intdigest(part.to_bytes(4, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42))
    place = lambda x, part: (hashed(x, part) & ((1 << size) - 1)) * 4 + part
    found, todo = set(), list(table)
    while todo:
        cell = todo.pop()
        x = table.get(cell, 0)
        if x and xxhash.xxh64_intdigest((x >> 12).to_bytes(8, "little"), 42) & 0xFFF == x & 0xFFF and place(x, cell & 3) == cell:
            found.add(x)
            for part in range(3):
                table[place(x, part)] = table.get(place(x, part), 0) ^ x
                todo.append(place(x, part))
    assert not any(table.values()) and len(found) == n
    return found


def test_fingerprints_are_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 3, ". ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(60)) for _ in range(rng.randrange(0, 40)))) for i in range(25)]
    rows += [(500, None), (501, ""), (502, "é😀x"), (503, "same. text\nhere"), (504, "same. text\nhere"), (505, "l. " * 4000 + "k. " * 3)]
    rows += [(600, " ".join(f"Sentence {k} of many." for k in range(40_000))), (601, " ".join(f"Sentence {k} of many." for k in range(20_000, 50_000))), (602, "1.5 and 2.5. Then?\nWhy")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, next string")
    out = {r.doc_id: r for r in edited_versions(docs).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    parts = lambda t: {p for p in re.split(CUT, t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t), (after_id, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sets = [digests_of(f) for f in (r.fingerprint, r.edited_fingerprint, out[after_id].fingerprint)]
        assert [len(x) for x in sets] == [len(parts(x)) for x in (t, edited, after)]
        if i == 600:
            assert abs(r.near_next - like(sets[0], sets[2])) < 0.02 and abs(r.near_edited - like(sets[0], sets[1])) < 0.02
            continue
        assert abs(r.near_edited - like(parts(t), parts(edited))) < 1e-9 and abs(r.near_edited - like(sets[0], sets[1])) < 1e-9, i
        assert abs(r.near_next - like(sets[0], sets[2])) < (1e-9 if len(sets[0]) + len(sets[2]) < 1000 else 0.02), i
    assert out[503].fingerprint == out[504].fingerprint and out[500].fingerprint == out[501].fingerprint
    assert edited_versions(docs.unionByName(docs)).groupBy("doc_id").count().where("count = 2").count() == len(rows)
    assert edited_versions(docs.limit(0)).count() == 0


def test_what_no_table_gives_back_is_estimated(spark):
    from pyspark.sql import functions as F

    rows = [(found, rest, size, n, m) for found, rest, size, n, m in [(7, 0, 10, 10, 9), (0, 3000, 10, 5000, 400), (0, 24, 3, 90, 90), (3, 3, 10, 9, 9)]]
    table = spark.createDataFrame(rows, "found long, rest long, size int, n int, m int")
    out = [r[0] for r in table.select(fingerprints.difference(F.col("found"), F.col("rest"), F.col("size"), F.col("n"), F.col("m"))).collect()]
    assert out[0] == 7 and 4600 <= out[1] <= 5400 and 20 < out[2] <= 180 and 5 <= out[3] < 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One<b> two</b>&nbsp;\n three<p>Four<br>five<aside>Side</aside><ul><li>x<li>y</ul><form>Name</form>
<!-- c --><div id="comments"><p>Nice!</p></div></article><div class="sidebar">More</div><footer>&copy; me</footer></body></html>"""


def test_article_blocks():
    assert dom.blocks(dom.parse(PAGE), set()) == ["Head & tail", "One two three", "Four five", "x", "y"]
    assert dom.blocks(dom.parse("a < b <i>c</i> <p"), set()) == ["a < b c"]
    assert dom.blocks(dom.parse("<div>" * 5000 + "deep" + "</div>" * 5000), set()) == ["deep"]
    assert dom.blocks(dom.parse(""), set()) == []


def test_tree_matching():
    a, b = (dom.skeleton(dom.parse(f"<body><h1>t</h1>{x}<div>same</div></body>")) for x in ("<p>1</p>", "<section>n</section><p>2</p>"))
    pairs = dom.matched(a, b)
    assert [a[i][1] for i, _ in pairs] == ["#root", "body", "h1", "p", "div"]
    assert [a[i][2] == b[j][2] for i, j in pairs] == [False, False, True, False, True]


def test_templates_leave_what_varies(spark):
    page = "<html><body><div>Home of all</div><p>{0}</p><div>Call 555</div></body></html>"
    rows = [(i, "http://h.com/x", page.format(f"story {i}"), "") for i in range(6)]
    rows += [(10, "http://one.com/", page.format("alone"), ""), (11, None, None, ""), (12, "http://h.com/", "", ""), (13, "http://h.com/m", PAGE, ""), (13, "http://h.com/m", PAGE, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in main_text(pages).collect()}
    assert {out[i] for i in range(6)} == {f"story {i}" for i in range(6)}
    assert out[10] == "Home of all\n\nalone\n\nCall 555"
    assert out[11] == out[12] == "" and out[13].startswith("Head & tail")
    assert main_text(pages).count() == len(rows) and main_text(pages.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in main_text(pages).collect())


def test_text_after_deep_elements_stays():
    deep = "<div id=page><article><h1>H</h1>" + "<div>" * 300 + "low" + "</div>" * 300 + "<p>after</p></article></div><p>out"
    assert dom.blocks(dom.parse(deep), set()) == ["H", "low", "after"]
    nav = "<article>" + "<div>" * 80 + "<nav>menu</nav>low" + "</div>" * 80 + "<p>after</article>"
    assert dom.blocks(dom.parse(nav), set()) == ["low", "after"]
    a, b = (dom.skeleton(dom.parse("<div>" * 5000 + x)) for x in ("<p>1", "<p>2"))
    assert len(dom.matched(a, b)) == 5002


@pytest.mark.parametrize("name", ["content with-sidebar", "no-comments", "has-banner", "newsletter-page", "sidebar"])
def test_wrappers_of_the_article_are_not_boilerplate(name):
    for mark in ("article", "main"):
        page = f"<nav>menu</nav><div class='{name}'><{mark}><h1>H</h1><p>text of it</p></{mark}></div><div class=related><article>t</article></div>"
        assert dom.blocks(dom.parse(page.split("<div class=related>")[0]), set()) == ["H", "text of it"]
        if name != "sidebar":
            assert dom.blocks(dom.parse(page), set()) == ["H", "text of it"]


def test_names_inside_the_article_are_whole():
    page = "<article class=no-comments><div class='entry-header'><h1>H</h1></div><p class='notice'>heed</p><div class='box related'>r</div><div id=comments>c</div></article>"
    assert dom.blocks(dom.parse(page), set()) == ["H", "heed"]
    teaser = "<div>" + "long text " * 9 + "</div><div class=related><article>t</article></div><aside><article>u</article></aside>"
    assert dom.blocks(dom.parse(teaser), set()) == [("long text " * 9).strip(), "t"]


def test_every_layout_has_a_template(spark):
    one = "<body><div class='x1'>Home of all</div><p>story {0}</p><p><a href=/{0}>linked {0}</a></p></body>"
    two = "<body><table class='t'><tr><td>Start here</td></tr></table><section><h2>tale {0}</h2></section><div class='z'>Call 555</div></body>"
    rows = [(0, "http://h.com/0", None), (None, "http://h.com/n", ""), (1, "http://h.com/e", "  ")]
    rows += [(i, f"http://h.com/{i}", (two if i % 3 else one).format(i)) for i in range(2, 20)]
    rows += [(30, "http://h.com/30", "<body><div class='x2'>alone</div><table class='t'><tr><td>Start here</td></tr></table></body>")]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == out[None] == out[1] == ""
    assert all(out[i] == (f"tale {i}" if i % 3 else f"story {i}\n\nlinked {i}") for i in range(2, 20))
    assert out[30] == "alone"


def test_what_unlike_articles_repeat_is_template(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(3, 11))) for _ in range(900)]
    story = lambda: " ".join(rng.choice(words) for _ in range(60))
    page = "<nav>menu</nav><article><h1>{0}</h1><p>{1}</p><div class='x9'><b>Join</b> our list</div>\n<p>{2}</p><p>Written by us</p></article>"
    rows = [(f"http://a.com/{i}", story(), story(), story()) for i in range(8)]
    one = story()
    rows += [(f"http://b.com/{i}", "The same title", one, one.replace(" ", f" n{i} ", 3)) for i in range(8)]
    rows += [("http://c.com/x", "T", one, one)] * 6 + [("http://d.com/x", story(), one, story())]
    pages = spark.createDataFrame([(i, u, page.format(*t)) for i, (u, *t) in enumerate(rows)], "page_id long, url string, html string")
    out = {r.page_id: r.text.split("\n\n") for r in main_text(pages).collect()}
    for i, (url, *t) in enumerate(rows):
        t = [" ".join(x.split()) for x in t]
        assert out[i] == (t if "a.com" in url else [t[0], t[1], "Join our list", t[2], "Written by us"]), url
    bare = spark.createDataFrame([(i, "http://e.com/", f"<div>{one}</div><h2>{one}</h2>") for i in range(5)], "page_id long, url string, html string")
    assert all(r.text == f"{one}\n\n{one}" for r in main_text(bare).collect())


def best_match(a, b):
    """Pairs that the largest match of two trees (label, children) has, by trying everything."""
    if a[0] != b[0]:
        return 0

    def rows(p, q):
        if not p or not q:
            return 0
        return max(best_match(p[0], q[0]) + rows(p[1:], q[1:]), rows(p[1:], q), rows(p, q[1:]))

    return 1 + rows(a[1], b[1])


def flat(tree, depth=0):
    yield depth, tree[0], 0
    for child in tree[1]:
        yield from flat(child, depth + 1)


def test_tree_matching_is_exhaustive():
    rng = random.Random(4)
    grow = lambda depth: (rng.choice("abc"), [grow(depth - 1) for _ in range(rng.randrange(4))] if depth else [])
    for _ in range(150):
        one, two = ("r", [grow(2) for _ in range(3)]), ("r", [grow(2) for _ in range(3)])
        a, b = list(flat(one)), list(flat(two))
        pairs = dom.matched(a, b)
        assert len(pairs) == best_match(one, two)
        assert all(a[i][:2] == b[j][:2] for i, j in pairs)
        assert pairs == sorted(pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_wide_pages():
    page = lambda n, word: "<body>" + "".join(f"<h2>h{k}</h2><p>{word}<i>x</i><b>y</b></p><div>{k}<p>z</p></div>" for k in range(n)) + "</body>"
    a, b = (dom.skeleton(dom.parse(page(n, w))) for n, w in ((1700, "one"), (1650, "two")))
    assert len(a) > 5000 and len(dom.matched(a, b)) == len(b)
    assert len(dom.blocks(dom.parse(page(1700, "one")))) == 1700 * 4


def test_the_wrapper_decides_not_the_mark(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(3, 11))) for _ in range(900)]
    story = lambda n: " ".join(rng.choice(words) for _ in range(n))
    head = "<nav><a href=/x>{0}</a></nav><div class='ad'>{1}</div>"
    page = head + "<div class=x><h1>{2}</h1><p>{3}</p><p>{4}</p></div><footer>&copy; us {1}</footer>"
    teaser = head + "<div class=wrap>" + "<div class=y>" * 80 + "<h1>{2}</h1><p>{3}</p><p>{4}</p>" + "</div>" * 80 + "</div><section class=more><article>{1}</article></section>"
    fill = [(story(2), story(5), story(4), story(60), story(3)) for _ in range(20)]
    rows = [(i, f"http://{h}.com/{i}", t.format(*f)) for h, t, off in (("a", page, 0), ("b", teaser, 20)) for i, f in enumerate(fill, start=off)]
    rows.append((99, "http://b.com/alone", "<article>other <b>kind</b></article>"))
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, f in enumerate(fill):
        assert out[i] == "\n\n".join(f[2:])
        assert out[20 + i] == "\n\n".join(f[2:])  # the marked article is the lighter slot
    assert out[99] == "other kind"


@pytest.mark.parametrize("names", [(), ("article", "nav", "footer")])
def test_slots_without_names_are_told_by_what_varies_in_them(spark, names):
    """Menu, advert, article and footer are bare boxes side by side; a naive reading of each page, box by box, says what is expected."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(3, 11))) for _ in range(900)]
    story = lambda n: " ".join(rng.choice(words) for _ in range(n))
    tag = lambda t: t if t in names else "div"
    page = f"<body><{tag('nav')}><ul><li><a href=/x>Home</a><li><a href=/y>Us</a></ul></{tag('nav')}>%s<{tag('article')}><h1>%s</h1>%s</{tag('article')}><{tag('footer')}>&copy; h.com %s</{tag('footer')}></body>"
    rows, want = [], {}
    for i in range(40):
        title, paragraphs = story(4), [story(rng.randrange(20, 90)) for _ in range(rng.randrange(1, 6))]
        advert = f"<div>{story(6)}</div>" if i % 5 else ""  # some pages have none
        rows.append((i, f"http://h.com/{i}", page % (advert, title, "".join(f"<p>{p}</p>" for p in paragraphs), story(7))))
        want[i] = "\n\n".join([title, *paragraphs])
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_a_list_of_boxes_is_one_slot():
    boxes = "".join(f"<div><p>{k}</p></div>" for k in range(5))
    assert [name for name, _ in dom.named(dom.parse(f"<body>{boxes}</body>").children[0])] == ["div"] * 5
    mixed = dom.parse("<body><div><ul></ul></div><div>t</div><div class=a>x</div><p>y</p></body>").children[0]
    assert [name for name, _ in dom.named(mixed)] == ["div#0", "div#1", "div.a", "p"]
    assert dom.tag_of("div#1") == dom.tag_of("div.a b") == "div" and dom.tag_of("#root") == "#root"


def test_the_leading_slot_wins_unless_headings_vary_beside_it():
    parts = [(0, "#root", 1, 0), (1, "body", 2, 0), (2, "div#0", 3, 0), (2, "div#1", 4, 0), (3, "h1", 5, 0), (3, "div", 6, 0), (2, "div#2", 7, 0)]
    masses = {0: 120, 1: 120, 2: 5, 3: 105, 4: 5, 5: 100, 6: 10}
    assert dom.induced(parts, masses) == 4  # not 6: the heading beside it varies
    assert dom.induced(parts, masses | {2: 50, 0: 165, 1: 165}) is None  # none leads
    dull = [*parts[:3], (2, "div#1", 4, 8), *parts[4:]]
    assert dom.induced(dull, masses) is None  # names have a veto


def test_clashing_columns_and_a_host_of_very_many_layouts(spark):
    rows = [(i, f"http://many.com/{i}", f"<body><div class='l{i}'><article><p>story {i}</p></article></div><div class='m{i}'>x</div></body>", "host", 1, b"t") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template int, wrappers binary")
    out = {r.page_id: r.text for r in main_text(pages).collect()}
    assert out == {i: f"story {i}" for i in range(60)}


def test_the_heaviest_slot_wins_over_marked_teasers():
    parts = [(0, "#root", 1, 1), (1, "body", 2, 1), (2, "nav", 3, 8), (2, "div.a", 4, 0), (3, "h1", 5, 0), (3, "p", 6, 0), (2, "section", 7, 9), (3, "article", 8, 3)]
    assert dom.induced(parts, {0: 120, 1: 120, 3: 100, 4: 10, 5: 90, 6: 20, 7: 20}) == 4
    assert dom.induced(parts, {0: 120, 1: 120, 2: 20, 6: 100, 7: 100}) is None  # only boilerplate varies
    marked = [(0, "#root", 1, 1), (1, "div.a", 2, 1), (2, "p", 3, 0), (2, "article", 4, 3), (3, "p", 5, 4)]
    assert dom.induced(marked, {0: 100, 1: 100, 2: 30, 3: 70, 4: 70}) == 4
    assert dom.induced(marked, {0: 100, 1: 100, 2: 70, 3: 30, 4: 30}) == 2


def test_the_trees_find_every_link():
    """One block of all documents: what the descent gives holds all links, and few other pairs."""
    rows = [t for t in texts(7, 200) if shingles(t)]
    sets = [shingles(t) for t in rows]
    hashed = list(jaccard_join.shingle_sets(rows))
    sizes, counts = np.array([len(h) for h in hashed]), jaccard_join.coarse_table([jaccard_join.coarse_of(h) for h in hashed])
    zero, own = np.zeros(len(rows), np.int64), np.arange(len(rows))
    links = {(i, j) for i, j in combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for s in (Settings(), Settings(leaf=2, fan=2)):
        a, b, _ = jaccard_join.descended(zero, zero, zero, zero, zero, own, sizes, counts, s)
        found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert len(found) == len(a) and links <= found and len(links) > 100
        forest = jaccard_join.Forest(zero, sizes, counts, s)
        assert len(forest.begin) > (2 if s.leaf == 16 else 6)
    side = own % 2  # two parts of a block: pairs across alone
    a, b, _ = jaccard_join.descended(zero, side, zero, zero + 1, zero, own, sizes, counts, Settings())
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == {(x, y) for x, y in found if (x + y) % 2}


def test_sets_of_over_a_million_shingles_keep_their_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 1_200_000).astype(np.uint64)
    counts = jaccard_join.coarse_table([jaccard_join.coarse_of(base)] * 40)
    zero, n = np.zeros(40, np.int64), np.full(40, len(base))
    a, _, bound = jaccard_join.descended(zero, zero, zero, zero, zero, np.arange(40), n, counts, Settings())
    assert len(a) == 40 * 39 // 2 and (bound == len(base)).all()
    points = jaccard_join.Points(n[:2], [counts_of(base).tobytes()] * 2)
    assert points.alike(np.array([0]), np.array([1]), Settings())[0]


def exact_links(table):
    """Links between the different sets of all rows of ``documents``, by counting over posting lists."""
    sets = {}
    for i, t in table:
        sets.setdefault(shingles(t), []).append(i)
    sets.pop(frozenset(), None)
    posting, links, sizes = {}, [], []
    for k, (own, ids) in enumerate(sets.items()):
        met = {}
        for x in own:
            for other in posting.setdefault(x, []):
                met[other] = met.get(other, 0) + 1
            posting[x].append(k)
        for other, both in met.items():
            if 100 * both >= 80 * (sizes[other] + len(own) - both):
                links.append((other, k))
        sizes.append(len(own))
    return sets, links


def test_whole_table_is_brute_force(spark):
    """All of documents at sf0.01, or what FLEETSPARK_EXACT names (sf0.1 takes minutes)."""
    import os

    docs = spark.read.parquet(f"{os.environ.get('FLEETSPARK_EXACT', '/root/testdata/sf0.01')}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, links = exact_links(table)
    low = [min(ids) for ids in sets.values()]
    while True:
        before = list(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    want = {i: (0, i) for i, t in table if not shingles(t)} | {i: (len(own), low[k]) for k, (own, ids) in enumerate(sets.items()) for i in ids}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == want


def test_tags_of_a_bare_name_are_read_at_once(monkeypatch):
    def slow(html, at):
        raise AssertionError("looked for quotes")

    odd = "<P>a</p ><p class='x>y'>b<br/>c</p>< d </ e></><?x?><!-- <i> --><DIV>f<script>if(a<b)</script>&#xD800;</DIV>"
    assert dom.blocks(dom.parse(odd)) == ["a", "b c", "< d", "f�"]
    monkeypatch.setattr(dom, "_tag_end", slow)
    assert dom.blocks(dom.parse("<DIV><p>a<p>b</DIV><ul><li>c<li>d</ul>")) == ["a", "b", "c", "d"]
