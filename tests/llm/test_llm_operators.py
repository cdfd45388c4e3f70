"""Each operator against plain loops, on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import ann, decontaminate, hmm, jaccard, language, licenses, mixing, quality, substring, suffix

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghiéß") for _ in range(R.randint(1, 9))) for _ in range(400)]


def words(n, rng=R):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    passage = words(60)
    base = words(150)
    rows = [(i, words(R.randint(1, 120))) for i in range(30)]
    rows += [(100 + i, f"{words(40)} {passage} {words(30)}") for i in range(12)]  # one passage in many documents
    rows += [(200 + i, base) for i in range(8)]  # exact copies
    for i in range(8):  # near copies
        w = base.split()
        for _ in range(3):
            w[R.randrange(len(w))] = R.choice(VOCABULARY)
        rows.append((300 + i, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ab " * 300), (405, words(4000)), (406, passage * 3), (407, "été " * 50)]
    rows += [(None, base), (409, "\x0b".join(base.split())), (410, base.upper())]
    return rows


ROWS = corpus()
SCHEMA = "doc_id long, text string, source string, lang string, n_words long, kept int, score string, key int, size double"


def frame(spark, rows):
    """Documents with columns whose names clash with results and helpers."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}", "de" if (i or 0) % 2 else None, -1, 2, "x", 3, None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS + ROWS[:3]).persist()  # repeated rows


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).limit(0)


def by_row(df, texts=ROWS):
    named = dict(texts)
    return [(r.doc_id, named[r.doc_id], tuple(r)[1:]) for r in df.collect()]


def test_substring(docs, none):
    want = brute.windows(ROWS)
    got = by_row(substring.removal_digest(docs))
    assert len(got) == len(ROWS) + 3
    assert all(want[i, t] == r for i, t, r in got)
    kept = {r.doc_id: r for r in substring.remove_repeated_windows(docs).collect()}
    assert kept[207].kept == "" and [(s.start, s.end) for s in kept[207].removed] == [(0, 150)]
    assert substring.removal_digest(none).collect() == []


def test_suffix(docs, none):
    want = brute.suffix(ROWS)
    got = by_row(suffix.suffix_digest(docs))
    assert len(got) == len(ROWS) + 3
    assert all(want[i, t] == r for i, t, r in got)
    assert suffix.suffix_digest(none).collect() == []
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[400] is None and texts[207] == "" and texts[200] == dict(ROWS)[200]


def test_suffix_sorting():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (400, 24)).astype(np.uint8)
    rows[rng.random((400, 24)) < 0.8] = 1
    rows[200:] = rows[rng.integers(0, 200, 200)]
    lengths = rng.integers(1, 25, 400)
    rows[np.arange(24)[None] >= lengths[:, None]] = 0
    order, lcp = suffix.suffix_array(rows, lengths, 8)
    key = [(rows[i].tobytes(), lengths[i]) for i in order]
    assert key == sorted(key) and sorted(order) == list(range(400))
    for a in range(1, 400):
        x, y = rows[order[a - 1]], rows[order[a]]
        same = next((k for k in range(24) if x[k] != y[k]), 24)
        assert lcp[a] == min(same, lengths[order[a - 1]], lengths[order[a]])


def test_jaccard(docs, none, spark):
    got = sorted((tuple(r) for r in jaccard.jaccard_groups(docs).collect()), key=str)
    assert got == brute.jaccard(ROWS + ROWS[:3])
    assert jaccard.jaccard_groups(none).collect() == []


def test_jaccard_links_through_a_hub_and_over_open_lists(spark):
    base = words(200).split()
    rows = []
    for i in range(40):  # copies that reach each other through the base alone
        w = list(base)
        for k in range(3):
            w[(i * 5 + k * 61) % 200] = f"own{i}x{k}"
        rows.append((i + 1, " ".join(w)))
    rows.append((900, " ".join(base)))
    got = sorted((tuple(r) for r in jaccard.jaccard_groups(frame(spark, rows)).collect()), key=str)
    assert got == brute.jaccard(rows)


def test_decontamination(docs, none, spark):
    text = dict(ROWS)
    items = [(1, " ".join(text[100].split()[35:70])), (2, words(30)), (2, text[405][:200]), (3, "one"), (4, None), (5, ""), (None, text[406][:90]), (1, " ".join(text[100].split()[35:70])), (10, "ab ab")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    want = brute.contamination(ROWS, items)
    got = by_row(decontaminate.contamination_digest(docs, bench))
    assert len(got) == len(ROWS) + 3 and all(want[i, t] == r for i, t, r in got)
    clean = {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert clean == {i for (i, t), r in want.items() if not r[4]}
    assert decontaminate.contamination_digest(none, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination_digest(docs, bench.limit(0)).collect())


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    text = dict(ROWS)
    items = [(i, " ".join(text[100 + i].split()[: 20 + i])) for i in range(12)] + [(77, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 60)
    want = brute.contamination(ROWS, items)
    assert all(want[i, t] == r for i, t, r in by_row(decontaminate.contamination_digest(docs, bench)))


def test_licenses(spark, none):
    rows = [
        (1, "Foo Released under the MIT License."), (2, "MIT license mit LICENSE and the General, Public: license"), (3, None), (4, ""),
        (5, "Licensed under CC BY-NC 4.0."), (6, "x Licensed under the most fine Apache License, Version 2.0. y"), (7, "license"), (8, "mit éa licenſe mKa"), (1, "Foo Released under the MIT License."),
        (9, "general public license"), (10, "gnu general public license version 3 " * 3),
    ]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_digest(frame(spark, rows)).collect()}
    assert got[1][:6] == (6, 1, 4, 4, "mit", "mit") and got[1][6] == 1.0
    assert got[2][:6] == (9, 3, 0, 6, "gpl,mit", "gpl,mit")
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5][4:6] == ("", "cc-by-nc") and got[6][5] == "apache"
    assert got[7] == (1, 0, None, None, "", "", 0.0) and got[8][0] == 4
    assert got[9][1:5] == (1, 0, 0, "gpl") and got[10][1:4] == (3, 1, 13)
    assert licenses.license_digest(none).collect() == []


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) + 3
    sources = sorted({r.source for r in rows if r.source is not None}) + [None]
    total = sum(r["size"] for r in rows)
    assert total == sum(len(brute.PLAIN.findall(t or "")) for _, t in ROWS + ROWS[:3])
    goal = {r.source: r.target for r in rows}
    cap = {r.source: 3 * r.source_size for r in rows}
    weight = {s: float(i % 3 + 1) for i, s in enumerate(sources)}
    level = max(goal[s] / weight[s] for s in sources)
    for s in sources:  # water filling: at the cap, or at the common level
        assert goal[s] == pytest.approx(min(cap[s], level * weight[s]))
        assert abs(sum(r.taken for r in rows if r.source == s) - goal[s]) < 1
    assert sum(goal.values()) == pytest.approx(total)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and (r.taken > 0) == (len(r.positions) > 0)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    seen = [r.position for r in rows if r.position is not None]
    assert seen == sorted(seen)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).collect() == []


def test_schedule_inversion(spark):
    shares = [i / 50 for i in range(51)]
    for knots in ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (0.0, 2.0)):
        df = spark.createDataFrame([(u,) for u in shares], "u double").select(mixing._invert(F.col("u"), mixing._segments(knots)))
        grid = np.linspace(0, 1, 20001)
        rate = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2)))
        want = np.interp(shares, area / area[-1], grid)
        assert np.allclose([r[0] for r in df.collect()], want, atol=1e-3)


def test_quality(spark, none):
    rng = random.Random(9)
    good = [(i, words(80, rng)) for i in range(150)]
    bad = [(1000 + i, " ".join([rng.choice(VOCABULARY)] * 40 + [words(10, rng).upper() + "!!"])) for i in range(150)]
    rows = good + bad + [(2000, None), (2001, ""), (None, "a b")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(5, None, 0), (None, 1, 1), (7, 9, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_digest(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    tested = [i for i, _ in good + bad if got[i].held_out]
    assert np.mean([got[i].predicted == (i < 1000) for i in tested]) > 0.95
    assert got[2000].score == got[2001].score
    assert quality.quality_digest(none, labels).collect() == []
    assert {r.score for r in quality.quality_digest(frame(spark, rows[:4]), labels.limit(0)).collect()} == {0.5}


def test_the_sample_bounds_rows_not_only_ids(spark):
    docs = spark.range(3000).selectExpr("CAST(3 AS BIGINT) AS doc_id", "concat('text ', id) AS text").union(spark.range(40).selectExpr("id + 10", "concat('other ', id)"))
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    rows = quality.labelled_sample(docs, labels, "quality", 20).collect()
    assert len(rows) <= 20 and len({r.doc_id for r in rows}) == len(rows)
    assert all(bytes(r.text) == b"text 0" for r in rows if r.doc_id == 3)


def test_language(spark, none):
    rng = random.Random(2)
    speech = {"xx": ["tharo", "mingu", "sela", "orka"], "yy": ["ziut", "wexo", "quib", "jyf"]}
    rows = [(i, " ".join(rng.choice(speech[k]) for _ in range(30)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]]
    mixed = " ".join(["tharo mingu sela orka"] * 7 + ["ziut wexo quib jyf"] * 3)
    rows += [(100, None, "xx"), (101, "12 !?", "yy"), (102, "", None), (103, mixed, None), (None, "tharo", "zz"), (0, rows[0][1], "xx")]
    df = spark.createDataFrame([(*r, 0.5, "m") for r in rows], "doc_id long, text string, lang string, score double, mixture string")
    got = {r.doc_id: r for r in language.languages(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60])
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "xx" and len(got[103].mixture) == 2 and 0.5 < got[103].score < 0.9
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language.languages(none).collect() == []
    assert {r.lang_pred for r in language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_hmm(spark, none):
    rng = random.Random(4)
    talk = (["red", "green", "blue", "pink"], ["one", "two", "three", "four"])
    rows = [(i, " ".join(rng.choice(talk[i % 2]) for _ in range(40))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "never seen"), (None, "red"), (0, rows[0][1]), (304, "Red " * 9000)]
    got = hmm.sequence_scores(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    counts, total = {}, 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for w in [*brute.PLAIN.findall(brute.low(t)), ""]:
                counts[w] = counts.get(w, 0) + 1
                total += 1
    named = dict(rows)
    for r in got:
        tokens = [*brute.PLAIN.findall(brute.low(named[r.doc_id])), ""]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)
    assert hmm.sequence_scores(none).collect() == []


def test_hmm_recursions_are_exact():
    rng = np.random.default_rng(1)
    k = hmm.STATES
    model = hmm.Model(rng.random(k), rng.random((k, k)), rng.random((k, hmm.CLASSES)))
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (1, 7, 300, 1000)]

    def plain(t):
        alpha, total = model.start * model.by_class[t[0]], 0.0
        for c in t[1:]:
            total += np.log10(alpha.sum())
            alpha = alpha / alpha.sum() @ model.move * model.by_class[c]
        return total + np.log10(alpha.sum())

    want = [plain(t) for t in texts]
    assert np.allclose(model.log10(texts), want)
    assert np.allclose([model._forward_blocks(t) for t in texts], want)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, hmm.CLASSES))
    model.expected(texts, np.ones(4, bool), start, move, emit)
    assert np.isclose(start.sum(), 4) and np.isclose(move.sum(), 1304) and np.isclose(emit.sum(), 1308)


def test_nearest(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, 1500)] + 0.3 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[700:760] = x[700]  # copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] * 16, 1), (2300, [1.0, None] * 8, 1), (2400, [1.0], 1), (None, x[0].tolist(), 1), (100, x[100].tolist(), 1)]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.IntegerType())])
    df = spark.createDataFrame(rows, kind)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        true = sorted((float(d[i]), i) for i in range(1500) if i != q)[:10]
        assert [f[0] for f in found] == list(range(1, 11)) and all(f[2] == pytest.approx(d[f[1]], rel=1e-12, abs=1e-12) for f in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i in true} & {f[1] for f in found})
    assert hits >= 0.9 * 150
    assert [f[1] for f in sorted(got[700])] == list(range(701, 711))
    assert ann.nearest(df.limit(0)).collect() == []
    few = {(r.query_id, r.vec_id) for r in ann.nearest(df.filter("vec_id < 4")).collect()}
    assert few == {(0, 1), (0, 2), (0, 3)}


def recall_of_nearest(spark, x, every=100):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], kind), every).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(axis=1)
        hits += len(set(sorted((i for i in range(len(x)) if i != q), key=lambda i: (d[i], i))[:10]) & got[q])
    return hits / (10 * len(range(0, len(x), every)))


def test_nearest_widens_beams_until_a_sample_has_its_recall(spark, monkeypatch):
    x = np.random.default_rng(9).standard_normal((1200, 64))

    def thin_graph(nodes):
        rows = nodes.select("node", "vector").toArrow()
        ids, v = np.asarray(rows["node"]), ann._vectors(rows["vector"].combine_chunks())
        far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        lists = [(int(ids[i]), bytearray(ann._edges(ids[near], d[near], 0).tobytes()), 0) for i, d in enumerate(far) for near in [np.argsort(d, kind="stable")[1:4]]]
        return spark.createDataFrame(lists, ann.GRAPH)

    monkeypatch.setattr(ann, "neighbour_graph", thin_graph)
    monkeypatch.setattr(ann, "BEAM", 12)
    assert recall_of_nearest(spark, x, 20) >= 0.9


def test_nearest_among_near_copies_and_beside_a_huge_vector(spark):
    rng = np.random.default_rng(7)
    one = rng.standard_normal(16)
    x = one / np.linalg.norm(one) + 1e-5 * rng.standard_normal((1500, 16))
    x[0, 3] = 1e7
    assert recall_of_nearest(spark, x[1:]) >= 0.9
    assert recall_of_nearest(spark, x, 50) >= 0.9


def test_what_meets_at_a_hub_is_bounded(spark):
    n, k = 600, ann.NEIGHBOURS  # every node lists the first ones
    x = 1 + np.random.default_rng(8).random((n, 4))
    lists = [np.array([j for j in range(k + 1) if j != i][:k]) for i in range(n)]
    d = lambda i, j: np.sqrt(((x[i] - x[j]) ** 2).sum(axis=-1))
    rows = [(i, bytearray(np.sort(ann._edges(j, d(i, j), 1), order="d").tobytes())) for i, j in enumerate(lists)]
    graph = spark.createDataFrame(rows, ann.LISTS)
    nodes = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(ann._pack_vectors(x, 2.0))], "node long, vector binary")
    met = [(r.at, [(m.id, m.told) for m in r.met]) for r in ann._meetings(graph, nodes).collect()]
    assert max(len(m) for _, m in met) <= 1 + 2 * k + 3 * ann.REVERSE
    answers = {}
    for at, m in met:
        for i, told in m:
            answers[i] = answers.get(i, 0) + told
    assert max(answers.values()) <= 1 + k + ann.REVERSE
    assert {(at, i) for at, m in met for i, told in m if told} >= {(int(j), i) for i in range(n) for j in lists[i]}  # nobody is left out
    better = {r.node: len(r.data) // ann.EDGE.itemsize for r in ann._merged(graph.mapInArrow(ann._settled, ann.LISTS).union(ann._descend(graph, nodes))).collect()}
    assert better == dict.fromkeys(range(n), k)
