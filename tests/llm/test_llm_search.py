"""Hard negatives, the link-graph filter and ranked search against plain loops, on small awkward tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import linkrank, negatives, treap

R = random.Random(11)
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


# ---------------------------------------------------------------- hard negatives


def mined(rows):
    """Plain loops; rows of (vec_id, embedding, label)."""
    kept = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in e], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda s: (-s[1], s[0] is None, s[0] or 0)
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        score = [(j, sum(x * y for x, y in zip(v, w)), other) for b, (j, w, other) in enumerate(kept) if b != a and len(w) == len(v)]
        for p, ps, _ in sorted((s for s in score if s[2] == label), key=order)[:5]:
            hits = [s for s in score if s[2] != label and 50 * ps <= 100 * s[1] <= 95 * ps]
            out += [(i, p, r, n, ps, ns) for r, (n, ns, _) in enumerate(sorted(hits, key=order)[:3], 1)]
    return sorted(out, key=repr)


def vectors():
    centre = [[R.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(420):
        c = centre[i % 4]
        length = R.choice([0.2, 1, 1, 3])
        rows.append((i, [length * (x + R.gauss(0, 0.4)) for x in c], R.randrange(3) + i % 4))
    rows += [(500 + i, rows[50][1], i % 5) for i in range(60)]  # many equal vectors
    rows += [(1000, None, 1), (1050, [1.0] * 12, None), (1100, [1.0, None] + [0.0] * 10, 1), (1150, [float("nan")] * 12, 1), (1200, [float("inf")] * 12, 2)]
    rows += [(1250, [0.0] * 12, 1), (1251, [0.0] * 12, 2), (1300, [], 1), (1301, [], 2), (1350, [0.5, 0.25], 1), (1351, [0.5, 0.5], 1), (1352, [0.5, 0.1], 2)]
    rows += [(None, rows[0][1], 1), (None, rows[3][1], 9), rows[100], rows[100], (-50, rows[7][1], 2), (-7, rows[8][1], 9)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, "x", 0.5) for i, e, label in rows], "vec_id long, embedding array<float>, label int, bucket int, score string, length double").repartition(3)


@pytest.mark.parametrize("values", [10_000_000, 900])
def test_hard_negatives_equal_plain_loops(spark, values):
    rows = vectors()
    got = sorted((tuple(r) for r in negatives.hard_negatives(vector_frame(spark, rows), values=values).collect()), key=repr)
    assert got == mined(rows) and len(got) > 100


def test_hard_negatives_of_no_rows(spark):
    assert negatives.hard_negatives(vector_frame(spark, vectors()).limit(0)).count() == 0


def test_feasible_ranges_hold_all_rows_of_a_band_and_leave_others():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6))
    parts = np.floor(256 * (centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 6)) * 0.05))
    bucket = negatives.Bucket(np.arange(600), np.arange(600), np.zeros(600, int), parts)
    met = 0
    for i in range(0, 600, 7):
        scores = parts @ parts[i]
        for low, high in ((np.quantile(scores, 0.97), np.inf), (np.quantile(scores, 0.9), np.quantile(scores, 0.95)), (-np.inf, np.quantile(scores, 0.02))):
            near = bucket.near(parts[i], low, high, 3)
            assert set(np.flatnonzero((scores >= low) & (scores <= high))) <= set(near)
            met += len(near)
    assert met < 0.8 * 86 * 3 * 600  # part of the rows is never scored


def test_scores_beyond_doubles_are_exact():
    parts = np.array([[2.0**40, 3.0], [2.0**40, 1.0]])
    bucket = negatives.Bucket(np.arange(2), np.arange(2), np.zeros(2, int), parts)
    assert bucket.scores(np.array([2.0**20 + 1, 1.0]), np.arange(2)).tolist() == [2**60 + 2**40 + 3, 2**60 + 2**40 + 1]
    assert bucket.scores(np.array([2.0**60, 1.0]), np.arange(1)).tolist() == [2**63 - 1]


# ---------------------------------------------------------------- link graph


def host_path(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def judged(pages, rounds):
    """Plain loops; pages of (page_id, url, html)."""
    def rule(host, path):
        fits = [(len(p), p, v) for v, p in linkrank.RULES if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith(p[p.index("/") :])]
        return max(fits)[1:] if fits else (None, None)

    rows = [(i, *host_path(u), *rule(*host_path(u))) for i, u, _ in pages]
    hosts, edges = {}, set()
    for _, h, _, _, said in rows:
        if h:
            n = hosts.setdefault(h, [0, 0, 0])
            n[0] += 1
            n[1] += said == "allow"
            n[2] += said == "block"
    for (_, h, *_), (_, _, html) in zip(rows, pages):
        for target in re.findall(linkrank.LINK, html or ""):
            target = target.translate({c: c + 32 for c in range(65, 91)})
            if h and target and target != h:
                edges.add((h, target))
    good = {h: max(a - b, 0) for h, (_, a, b) in hosts.items()}
    bad = {h: max(2 * b - n, 0) for h, (n, _, b) in hosts.items()}
    nodes = set(hosts) | {h for e in edges for h in e}

    def spread(seed, edges):
        total = sum(seed.values())
        own = {h: (seed.get(h, 0) * (linkrank.TOTAL // total) if total else 0) * 15 // 100 for h in nodes}
        out = {h: [t for s, t in edges if s == h] for h in nodes}
        now = dict(own)
        for _ in range(rounds):
            nxt = dict(own)
            for h in nodes:
                for t in out[h]:
                    nxt[t] += 85 * now[h] // (100 * len(out[h]))
            now = nxt
        return now

    trust, distrust = spread(good, edges), spread(bad, {(t, s) for s, t in edges})
    return sorted(
        ((i, h, p, r, said or ("block" if distrust.get(h, 0) > trust.get(h, 0) else "allow"), trust.get(h, 0), distrust.get(h, 0)) for i, h, p, r, said in rows), key=repr)


def pages():
    names = ["a.com", "www.example.com", "b.example.com", "x.net", "y.net", "k.org", "l.org", "m.org", "hub.org"]
    rows = []
    for i in range(160):
        host = "hub.org" if i % 3 == 0 else R.choice(names)
        links = "".join(R.choice([f'<a HREF = "https://{R.choice(names).upper()}/z">', f"<a href='//{R.choice(names)}?q'>", f"<a href=http://{R.choice(names)}>", '<a href="/local">', '<a href="">']) for _ in range(R.randrange(4)))
        rows.append((i, f"http{'s' * (i % 2)}://{host}{R.choice(['/es/1', '/fr/', '/en/x', '', '/en/?u=://y', '#t'])}", f"<p>{links}</p>"))
    rows += [(200, None, '<a href="http://x.net">'), (201, "no scheme", None), (202, "", ""), (203, "://", None), (None, "http://k.org/", "<a href='http://y.net'>"), (204, "HTTP://WWW.Example.COM/en/A?b#c", None)]
    rows += [(300, "http://bad.net/es/1", None), (301, "http://w.org/x", "<a href='//bad.net/'>")]  # who links to blocked pages only
    rows += [(205, "http://k.org/\n/es", None), (206, "http://notexample.com/en/", "x" * 300_000 + "<a href='http://x.net/'>"), rows[5], rows[5]]
    return rows


def page_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "v", "h", 1) for i, u, h in rows], "page_id long, url string, html string, verdict string, host string, trust int").repartition(3)


@pytest.mark.parametrize("rounds", [3, 40])
def test_link_graph_equals_plain_loops(spark, rounds):
    rows = pages()
    got = sorted((tuple(r) for r in linkrank.url_verdicts(page_frame(spark, rows), rounds=rounds).collect()), key=repr)
    assert got == judged(rows, rounds)
    assert {g[4] for g in got if g[3] is None} == {"allow", "block"}


def test_link_graph_sql_says_the_same(spark):
    import duckdb

    rows = pages()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(linkrank.verdict_sql()).fetchall(), key=repr) == judged(rows, linkrank.ROUNDS)


def test_link_graph_keeps_whole_rows_and_takes_no_rows(spark):
    rows = pages()
    kept = linkrank.allowed_pages(page_frame(spark, rows))
    assert kept.columns == ["page_id", "url", "html", "verdict", "host", "trust"]
    assert kept.count() == sum(r[4] == "allow" for r in judged(rows, linkrank.ROUNDS))
    assert linkrank.url_verdicts(page_frame(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- ranked search


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, top):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    df = {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, words in asked.items():
        scores = []
        for i, b in bags:
            m = 50 + 50 * len(b) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b.count(w) // (1000 * b.count(w) + 20 * m)) for w in words if w in b)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def texts():
    vocabulary = ["".join(R.choice("abcdefgé9") for _ in range(R.randint(1, 4))) for _ in range(150)]
    say = lambda n: R.choice([" ", ", ", "-"]).join(R.choice(vocabulary) for _ in range(n))
    docs = [(i, say(R.randint(1, 60))) for i in range(150)] + [(300 + i, "same words Here") for i in range(20)]
    docs += [(400, None), (401, ""), (402, " .,!"), (403, say(5000)), (None, say(20)), (None, "same words here"), (404, "Word"), docs[3], docs[3]]
    items = [(str(i), say(R.randint(1, 12))) for i in range(12)] + [("s", "SAME here"), ("n", None), ("e", "--"), ("u", "unheardof"), ("s", "words"), (None, "word same"), ("long", say(2000))]
    return docs, items


def text_frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(3),
            spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, doc_id int"))


@pytest.mark.parametrize("block, top", [(12 << 20, 50), (600, 50), (600, 7)])
def test_ranked_search_equals_plain_loops(spark, block, top):
    docs, items = texts()
    got = sorted((tuple(r) for r in treap.ranked_documents(*text_frames(spark, docs, items), top=top, block_bytes=block).collect()), key=repr)
    assert got == ranked(docs, items, top) and len(got) > 60


def test_ranked_search_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(treap, "PART_TERMS", 40)
    monkeypatch.setattr(treap, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(treap, "WIDTH", 3)
    docs, items = texts()
    got = sorted((tuple(r) for r in treap.ranked_documents(*text_frames(spark, docs, items), block_bytes=900).collect()), key=repr)
    assert got == ranked(docs, items, 50)


def test_ranked_search_of_no_documents_or_items(spark):
    docs, items = text_frames(spark, *texts())
    assert treap.ranked_documents(docs.limit(0), items).count() == 0
    assert treap.ranked_documents(docs, items.limit(0)).count() == 0


def test_treap_round_trip_and_work():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 512 * 512, 9000))
    rows, columns, values = cells // 512, cells % 512, rng.integers(1, 1000, len(cells))
    tree = treap.Treap.unpacked(treap.Treap.of(rows, columns, values, 9).packed())
    grid = np.zeros((512, 512), np.int64)
    grid[rows, columns] = values
    for asked in (np.array([5]), np.array([1, 2, 3, 500]), rng.choice(512, 60, False)):
        weights = rng.integers(1, 9, len(asked))
        found = []
        tree.best(asked, weights, np.arange(512), 10, found)
        sums = weights @ grid[asked]
        assert sorted(found, reverse=True) == sorted(((int(s), -c) for c, s in enumerate(sums) if s), reverse=True)[:10]


def test_columns_of_a_search_are_what_the_contract_names(spark):
    docs, items = text_frames(spark, *texts())
    assert treap.ranked_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    kinds = dict(treap.ranked_documents(docs, items.withColumn("item_id", F.lit(7).cast("long"))).dtypes)
    assert kinds == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
