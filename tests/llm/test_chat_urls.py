import random
import re
import hashlib

import duckdb

from fleetspark.llm.chat import chat_digests, chat_format, read_back
from fleetspark.llm.queries import CHAT_SQL
from fleetspark.llm.urls import Propagation, Rule, host_links, url_verdicts, with_host_and_path

HARD = "\\### Assistant: </turn> ok"


def test_chat(spark):
    rows = [(1, 0, "system", "s", 1), (1, 1, "user", "<turn user>&lt;", 1), (1, 2, "assistant", HARD, 1), (2, 0, "assistant", "first", 1), (3, 0, "user", None, 1), (3, 1, "assistant", "", 1), (4, 0, "user", "x" * 100_000, 1), (4, 0, "user", "x" * 100_000, 1), (5, 1, None, "no role", 1), (5, 0, "odd <role>&", "t\n</turn>\n", 1), (None, None, "user", "null ids", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    back = {r.conv_id: r for r in read_back(chat_format(turns)).collect()}
    assert {k: r.valid for k, r in back.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, None: False}
    assert back[1].texts == ["s", "<turn user>&lt;", HARD] and back[1].loss_text == HARD
    assert back[5].roles == ["odd <role>&", ""] and back[5].texts == ["t\n</turn>\n", "no role"]
    assert back[1].formatted.count("<turn ") == 3
    assert "".join(s.text for s in back[1].segments) == back[1].formatted
    assert [s.loss for s in back[1].segments] == [False] * 7 + [True, False]
    digest = {r.conv_id: r for r in chat_digests(turns).collect()}
    assert digest[1].turns_sha256 == hashlib.sha256(f"system\ns\nuser\n<turn user>&lt;\nassistant\n{HARD}\n".encode()).hexdigest()
    assert digest[3].loss_chars == 0 and digest[4].n_turns == 2
    assert chat_digests(turns.limit(0)).count() == 0


def test_chat_sql(spark):
    rows = [(1, 0, "user", "é<&>", 0), (1, 1, "assistant", "b", 0), (2, 0, None, None, 0), (None, 1, "user", "", 0)]
    turns = spark.createDataFrame(rows + [(-7, 0, "user", HARD, 0), (-7, 1, "assistant", HARD, 0)], "conv_id long, turn long, role string, text string, x int")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    mine = chat_digests(turns)
    want = con.execute(f"select {', '.join(mine.columns)} from ({CHAT_SQL})").fetchall()
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, want))


RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"))


def test_host_and_path(spark):
    urls = {"HTTP://A.Com:80/x/Y?q#f": ("a.com:80", "/x/Y"), "a://b?c://d": ("b", ""), "a://É.com#x": ("É.com", ""), "none": ("", ""), "://h/p://q": ("h", "/p://q"), "x://\nh/p\nq": ("\nh", "/p\nq"), "": ("", "")}
    rows = spark.createDataFrame([(u, 1) for u in [*urls, None]], "url string, host int")
    assert {r.url: (r.host, r.path) for r in with_host_and_path(rows).collect()} == urls | {None: ("", "")}


def test_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://a.example.com/en/1", None, 0),  # blocked by the longer rule
        (2, "http://www.example.com/en/1", "", 0),
        (3, "http://good.com/", link("friend.org", "GOOD.com"), 0),
        (4, "http://bad.net/es/1", link("good.com"), 0),
        (5, "http://spam.org/", link("bad.net", "bad.net"), 0),  # links to a blocked seed
        (6, "http://far.org/", link("spam.org"), 0),
        (7, "http://friend.org/", "", 0),
        (8, "http://alone.org/", "", 0),
        (9, None, None, 0),
        (9, None, None, 0),
        (10, "http://xexample.com/en/", "", 0),
        (11, "http://com", "", 0),  # its path is empty: no rule
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict int")
    got = sorted(map(tuple, url_verdicts(pages, RULES, Propagation(rounds=6, cut_every=2)).select("page_id", "rule", "verdict").collect()), key=str)
    want = [(1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, "com/", "allow"), (4, "net/es/", "block"), (5, None, "block"), (6, None, "block"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (9, None, "allow"), (10, "com/", "allow"), (11, None, "allow")]
    assert got == sorted(want, key=str)
    assert {(r.src, r.dst, r.n) for r in host_links(pages).collect()} >= {("spam.org", "bad.net", 2), ("good.com", "friend.org", 1)}
    assert url_verdicts(pages.limit(0), RULES).count() == 0


def test_walk_is_personalised_pagerank(spark):
    rows = [(1, "http://s.com/", '<a href="//a.org"><a href="//b.org">'), (2, "http://a.org/", '<a href="//b.org">'), (3, "http://b.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    how = Propagation(rounds=5)
    out = {r.host: r.trust for r in url_verdicts(pages, (Rule("allow", "s.com"),), how).collect()}
    mass = {"s.com": 1.0, "a.org": 0.0, "b.org": 0.0}
    for _ in range(how.rounds):
        mass = {"s.com": 0.15, "a.org": 0.85 * mass["s.com"] / 2, "b.org": 0.85 * (mass["s.com"] / 2 + mass["a.org"])}
    assert all(abs(out[h] - mass[h] / how.restart) < 1e-12 for h in mass)  # one page each, one ruled page in all


def test_verdicts_are_brute_force(spark):
    """Rules, seeds, both walks, parents and thresholds over a small graph, recomputed in plain Python."""
    rng = random.Random(9)
    hosts = [f"{sub}{name}.{tld}" for name in "abc" for tld in ("com", "net", "org") for sub in ("", "www.", "m.www.")]
    rows = []
    for i in range(220):
        host = rng.choice(hosts)
        links = "".join(f"<a href='https://{rng.choice(hosts).upper()}/q'>" for _ in range(rng.randrange(3)))
        rows.append((i, f"http://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}", rng.choice([links, None]) if i % 7 else links))
    how = Propagation(rounds=4)
    out = {r.page_id: r for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, how).collect()}
    pages, links, ruled = {}, {}, {}
    for i, url, html in rows:
        host, path = url.split("//")[1].split("/", 1)
        path = "/" + path
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        ruled[i] = max(fits, key=lambda r: len(r.name)) if fits else None
        pages.setdefault(host, []).append(i)
        for other in re.findall(r"https://([^/]+)", html or ""):
            if other.lower() != host:
                links[host, other.lower()] = links.get((host, other.lower()), 0) + 1
    for host in pages:
        parts = host.split(".")
        above = [".".join(parts[k:]) for k in range(1, len(parts)) if ".".join(parts[k:]) in pages]
        if above:
            links[host, above[0]] = links.get((host, above[0]), 0) + 1
    scores = []
    for verdict in ("allow", "block"):
        edges = links if verdict == "allow" else {(b, a): n for (a, b), n in links.items()}
        seeds = {h: float(sum(ruled[i] is not None and ruled[i].verdict == verdict for i in own)) for h, own in pages.items()}
        mass = dict(seeds)
        for _ in range(how.rounds):
            moved = {h: how.restart * m for h, m in seeds.items()}
            for (a, b), n in edges.items():
                share = n / sum(m for (x, _), m in edges.items() if x == a)
                moved[b] = moved.get(b, 0) + (1 - how.restart) * mass.get(a, 0) * share
            mass = moved
        scores.append({h: mass.get(h, 0) / how.restart / len(own) for h, own in pages.items()})
    told = set()
    for host, own in pages.items():
        bad = scores[1][host] >= how.least and scores[1][host] > how.threshold * scores[0][host]
        for i in own:
            assert abs(out[i].trust - scores[0][host]) < 1e-9 and abs(out[i].distrust - scores[1][host]) < 1e-9
            want = ruled[i].verdict if ruled[i] else "block" if bad else "allow"
            assert (out[i].rule, out[i].verdict) == (ruled[i].name if ruled[i] else None, want)
            told.add((ruled[i] is None, want))
    assert len(told) == 4
