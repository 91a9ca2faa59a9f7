"""Training-data operators: hand-made cases, brute force, invariants, held-out accuracy."""

import collections
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameatlas.llm import canon, components, gridcluster, mixing, neighbours, packing, strkernel, tokens, topn, toxicity, truncation, vptree

T0 = dt.datetime(2024, 1, 1)


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for x in list(root):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


# ------------------------------------------------------------------ 1 groups
def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(500, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, *pairs[:50], (None, 3), (3, None)], "a long, b long")
    got = collections.defaultdict(set)
    for r in components.connected_components(df).collect():
        got[r.label].add(r.vertex)
    assert {frozenset(g) for g in got.values()} == union_find([p for p in pairs if p[0] != p[1]])


def test_link_groups_defined_cases(spark):
    rows = spark.createDataFrame([(1, 2, "x"), (2, None, "x"), (3, 99, "x"), (4, 99, "x"), (5, 0, "x"), (6, 0, "x"), (7, 7, "x"), (8, 77, "x"), (1, None, "x"), (None, 1, "x")], "image_id long, is_dupe_of long, label string")
    got = {r.image_id: r.group_id for r in components.link_groups(rows, "image_id", "is_dupe_of").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    assert components.link_groups(rows.limit(0), "image_id", "is_dupe_of").count() == 0


# ------------------------------------------------------------------ 3 neighbours
def _vectors(spark, n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n // 8, dims))[rng.integers(0, n // 8, n)] + rng.normal(scale=0.05, size=(n, dims))).astype(np.float32)
    rows = [(i, i, [float(v) for v in x[i]], "x") for i in range(n)]
    bad = [(n, n, None, "x"), (n + 1, n + 1, [1.0], "x"), (n + 2, n + 2, [0.0] * dims, "x"), (n + 3, n + 3, [float("nan")] * dims, "x"), (None, n + 4, [1.0] * dims, "x"), (0, n + 9, [9.0] * dims, "x")]
    return x, spark.createDataFrame(rows + bad, "item long, row long, v array<float>, h1 string")


def _exact(x, k):
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [set(np.lexsort((np.arange(len(x)), np.round(row, 12)))[:k]) for row in d]


@pytest.mark.parametrize("relax,least", [(1.0, 0.999), (None, 0.9)])
def test_neighbours_recall(spark, relax, least):
    x, df = _vectors(spark)
    out = neighbours.most_similar(df, "item", "row", "v", k=5, size=16, relax=relax, shards=4, leaf_rows=32).collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r.item].add(r.neighbour_id)
    assert set(got) == set(range(len(x))) and all(len(v) == 5 and i not in v for i, v in got.items())
    want = _exact(x, 5)
    assert np.mean([len(got[i] & want[i]) / 5 for i in range(len(x))]) >= least


def test_neighbours_with_a_hot_vector(spark):
    same = [1.0] + [0.0] * 7
    rows = [(i, i, same) for i in range(60)] + [(i, i, [0.5, 0.1 * (i - 90)] + [0.3] * 6) for i in range(100, 130)]
    out = neighbours.most_similar(spark.createDataFrame(rows, "item long, row long, v array<float>"), "item", "row", "v", k=5, size=8, relax=1.0, shards=2).collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r.item].add(r.neighbour_id)
    assert len(got) == 90 and got[0] == {1, 2, 3, 4, 5} and got[40] == {0, 1, 2, 3, 4}


def test_neighbours_small_and_empty(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "item long, row long, v array<float>")
    assert sorted((r.item, r.neighbour_id) for r in neighbours.most_similar(df, "item", "row", "v", k=5, size=2).collect()) == [(1, 2), (2, 1)]
    assert neighbours.most_similar(df.limit(0), "item", "row", "v", k=5, size=2).count() == 0


def test_factor_one_is_exact_on_the_vectors_as_they_are(spark):
    rng = np.random.default_rng(8)
    x = (1.0 + rng.normal(size=(300, 8)) * 1e-5).astype(np.float32)  # far below a 16-bit step
    df = spark.createDataFrame([(i, i, r.tolist()) for i, r in enumerate(x)], "id long, row long, v array<float>")
    got = neighbours.most_similar(df, "id", "row", "v", k=3, size=8, relax=1.0, shards=4, leaf_rows=32).toPandas()
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i])[:3]}
    assert len(want & set(zip(got.id, got.neighbour_id))) >= 0.98 * len(want)
    some = neighbours.most_similar(df, "id", "row", "v", k=3, size=8, relax=1.0, shards=4, leaf_rows=32, asked=lambda i: i % 10 == 0).toPandas()
    assert set(zip(some.id, some.neighbour_id)) == {(a, b) for a, b in zip(got.id, got.neighbour_id) if a % 10 == 0}


def test_tree_relaxed_to_one_is_exact():
    x = np.random.default_rng(3).normal(size=(600, 12)).astype(np.float32)
    best, dist = vptree.nearest(x, x[:50], 6, relax=1.0, hint=0.1, leaf=32)
    d = np.sqrt(((x[:50, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    assert np.allclose(np.sort(dist, 1)[:, :6], np.sort(d, 1)[:, :6], atol=1e-5)


# ------------------------------------------------------------------ 4 top n
@pytest.mark.parametrize("heavy", [10, 10**9])
def test_top_n_paths_agree(spark, heavy):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, float(rng.randrange(20)), "x") for i in range(600)]
    rows += [(1, 5, -3.0, "x"), (None, 9000, 1.0, "x"), (1, None, 1.0, "x"), (2, 9001, None, "x"), (2, 9002, float("nan"), "x"), rows[0]]
    got = topn.top_n(spark.createDataFrame(rows, "c long, i long, d double, g string"), "c", "d", "i", 7, heavy_rows=heavy, slice_rows=50).collect()
    best = {}
    for c, i, s, _ in rows:
        if c is not None and i is not None and s is not None and s == s:
            best[c, i] = min(s, best.get((c, i), s))
    want = {(c, i) for c in (1, 2, 3) for s, i in sorted((s, i) for (cc, i), s in best.items() if cc == c)[:7]}
    assert {(r.c, r.i) for r in got} == want


def test_latest_and_empty(spark):
    df = spark.createDataFrame([(1, T0, 5, 0.1), (1, T0 + dt.timedelta(1), None, 0.2), (2, None, 7, 0.3)], "i long, at timestamp_ntz, c long, d double")
    assert sorted((r.i, r.c) for r in topn.latest_per_item(df, "i", "at", ["c", "d"]).collect()) == [(1, None), (2, 7)]
    assert topn.top_n(df.limit(0), "c", "d", "i", 3).count() == 0


# ------------------------------------------------------------------ 5 cut values
def test_cut_values_found_and_titles_spared(spark):
    rng = random.Random(2)
    words = "river stone garden window market harbour kitchen ladder mirror balloon teacher painter bridge valley mountain evening".split()
    full = [" ".join(rng.choices(words, k=rng.randrange(8, 20))).capitalize() + "." for _ in range(1500)]
    rows, truth = [], set()
    for i, t in enumerate(full):
        site = 1 + i % 2
        if site == 1 and len(t) > 100:
            t, _ = t[:100], truth.add(i)
        elif i % 31 == 0:
            t, _ = t[: rng.randrange(40, len(t) - 1)] if len(t) > 60 else t, truth.add(i) if len(t) > 60 else None
        elif i % 17 == 0:
            t = "Old " + rng.choice(words)
        rows.append((i, site, f"{i:010d}", f"https://x.example/a/{i:010d}.jpg", t))
    rows += [(9000, 1, None, None, None), (9001, 1, "0000009001", "", ""), (9002, None, "0000009002", "https://x.example/a/00000", "x" * 50_000)]
    df = spark.createDataFrame(rows, "image_id long, site int, key string, url string, description string")
    out = truncation.cut_values(df, "image_id", "site", {"description": None, "url": "key"}, "description").where("truncated").collect()
    got = {r["item"] for r in out if r.field_name == "description" and r["item"] < 9000}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(rows)
    assert not [i for i in got if rows[i][4].startswith("Old ")]
    assert truncation.cut_values(df.limit(0), "image_id", "site", {"description": None}, "description").count() == 0


# ------------------------------------------------------------------ 6 free values
def test_mapping_small(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "Zantogard", "Zantogard", "Zantogard", "Republic of Zantogard", None, "ZR", "ZDD", "ZZ-ZDD"), (2, "North Sormomark", "North Sormomark", "Sormomark, North", None, None, "NQ", "NOZ", None), (None, "Lost", None, None, None, None, None, None, None)],
        "location_id long, getty_name string, nation_name string, nation_name_alpha string, official_nation_name string, sovereignty string, code_alpha2 string, code_alpha3 string, code_iso string").write.parquet(f"{d}/locations.parquet")
    spark.createDataFrame([(1, "woman"), (2, "man")], "gender_id long, gender string").write.parquet(f"{d}/genders.parquet")
    typed = ["Zantogard", " zatoagrd", "Ulvdolund, ZANTOGARD", "The Republic of Zantogard", "norht sormomak", "zr", "planet earth", "", " ", None, "z" * 5000, "Zantogard, Ebrdomark", "é"]
    spark.createDataFrame([(i, t, "Women!" if i == 0 else None) for i, t in enumerate(typed)], "item_id long, country string, gender string").write.parquet(f"{d}/ingest_items.parquet")
    got = {(r.item_id, r.field_name): r.ref_id for r in canon.p6_found(spark, d).collect()}
    assert got == {(1, "country"): 1, (2, "country"): 1, (3, "country"): 1, (4, "country"): 2, (5, "country"): 1, (6, "country"): -1, (10, "country"): -1, (11, "country"): -1, (12, "country"): -1, (0, "gender"): 1}


# ------------------------------------------------------------------ 7 postures
def test_posture_groups(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 33, 3))
    rows, truth = [], {}
    for i in range(90):
        g = i % 3
        p = base[g] + rng.normal(scale=0.03, size=(33, 3))
        p = p * rng.uniform(0.1, 5) + rng.normal(size=3)
        vis = np.ones((33, 1))
        if i % 5 == 0:
            vis[7], p[7] = 0.01, 40.0
        flat = np.hstack([p, vis]).ravel() if i % 4 else p.ravel()
        if i % 4 == 0 and i % 5 == 0:
            continue
        rows.append((i, i, [float(v) for v in flat]))
        truth[i] = g
    rows += [(200 + i, 200 + i, [float(v) for v in rng.normal(size=99)]) for i in range(4)] + [(300, 300, None), (301, 301, [1.0] * 40), (302, 302, [0.0] * 99), (303, 303, [float("nan")] * 132)]
    df = spark.createDataFrame(rows, "item long, row long, vec array<float>").withColumn("group", F.lit("x"))
    m = gridcluster.density_groups(df, "item", "row", "vec").collect()
    got = collections.defaultdict(set)
    for r in m:
        got[r.group].add(r["item"])
    assert {frozenset(g) for g in got.values()} == {frozenset(i for i, g in truth.items() if g == k) for k in range(3)}
    assert gridcluster.density_groups(df.limit(0), "item", "row", "vec") is None


# ------------------------------------------------------------------ 8 packing
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_best_fit_and_bounds(sizes):
    a = np.array(sizes)
    where, fills = packing.best_fit_decreasing(a, 64)
    assert fills.sum() == a.sum() and fills.max() <= 64
    assert (np.bincount(where, a) == fills).all()
    bound = packing.lower_bound(np.bincount(a, minlength=65), 64)
    assert -(-a.sum() // 64) <= bound <= len(fills) <= 1.7 * bound + 1


def test_packing_keeps_every_token(spark):
    rng = random.Random(3)
    sized = spark.createDataFrame([(i, 0, 0, rng.randrange(1, 101)) for i in range(3000)], "doc_id long, piece int, start_token long, tokens int")
    out = packing.pack(sized, 100, items_per_part=200).toPandas()
    assert len(out) == 3000 and out.doc_id.is_unique and out.groupby("bin_id").tokens.sum().max() <= 100
    one = packing.pack(sized, 100, items_per_part=10**9).select("bin_id").distinct().count()
    assert out.bin_id.nunique() <= 1.03 * one


def test_items_cut_only_long_texts(spark):
    docs = spark.createDataFrame([(1, "a word " * 3000), (2, "short"), (3, ""), (4, None), (5, "short")], "doc_id long, text string").withColumn("tokens", F.lit("x"))
    got = packing.items(docs, capacity=256).toPandas()
    assert set(got.doc_id) == {1, 2, 5} and (got[got.doc_id == 1].sort_values("piece").tokens.tolist()[:-1] == [256] * (len(got) - 3))
    assert packing.pack(packing.items(docs.limit(0))).count() == 0


# ------------------------------------------------------------------ 9 mixing
def test_counts_of_long_texts_equal_one_encoding():
    rng = random.Random(9)
    text = "".join(rng.choice(["word", " the", " 12", "\n", "  ", "é", "你好", "!!", " a"]) for _ in range(40_000))
    enc = tokens.encoder(tokens.VOCABULARY)
    assert tokens.count(text, tokens.VOCABULARY) == len(enc.encode_ordinary(text)) and tokens.count("x" * 50_000, tokens.VOCABULARY) > 0


def test_rounds_exchange_texts(spark):
    rng = np.random.default_rng(3)
    sized = spark.createDataFrame([(i, 0, 0, int(s)) for i, s in enumerate(rng.integers(300, 1100, 600))], "doc_id long, piece int, start_token long, tokens int")
    trace = []
    rows = packing.pack(sized, capacity=2_048, items_per_part=30, trace=trace).toPandas()
    assert sorted(rows.doc_id) == list(range(600)) and rows.groupby("bin_id").tokens.sum().max() <= 2_048
    assert len(trace) > 1 and trace[0]["pooled"] > 0 and trace[1]["parts"] < trace[0]["parts"] and rows.bin_id.nunique() <= trace[0]["windows"]


def test_great_rates_do_not_vanish():
    lam = mixing.rate_parameter(900.0, 2_000)
    assert abs(lam - 900) < 1 and abs(mixing._cut_mean(lam, 2_000) - 900) < 1e-3 and mixing.thresholds(900.0, 2_000)[-1] > 0.999


def test_rate_parameter():
    for rate, cap in ((0.3, 1), (0.9, 2), (2.5, 4), (1.0, 5)):
        assert abs(mixing._cut_mean(mixing.rate_parameter(rate, cap), cap) - rate) < 1e-6
    assert mixing.thresholds(2.0, 2) == [0.0, 0.0]


def test_mixture_shares_and_caps(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 7), "abc"[i % 3]) for i in range(1200)] + [(5000 + i, "the same text", "a") for i in range(400)]
    docs += [(9001, None, "a"), (9002, "", "a"), (9003, "lost", None), (9004, "other", "zzz"), (9005, "   ", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("max_repeats", F.lit("x"))
    goal = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.1, None), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    rows, report = mixing.mix(df, goal)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"a", "b", "c", "none"} and r["none"].actual_share == 0
    for s, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(r[s].actual_share - want) < 0.03, s
    got = rows.toPandas()
    assert (got.groupby("doc_id").size() <= got.merge(pd.DataFrame({"source": ["a", "b", "c"], "cap": [3, 1, 1]}), on="source").groupby("doc_id").cap.max()).all()
    assert (got.doc_id >= 5000).sum() <= 3 and got.position_key.is_monotonic_increasing
    assert mixing.mix(df.limit(0), goal)[0].count() == 0


# ------------------------------------------------------------------ 10 content
def test_disguises_are_undone():
    for t in ("you 1d107", "you i.d.i.o.t", "you I D I O T", "you idi\u200bot", "you idiiiiiot", "YOU IDIOT", "you ïdiot", "you i. d. i. o. t.", "you i*d*i*o*t", "you іdіоt", "<b>you</b> idiot"):
        assert strkernel.sentences(t) == ["you idiot"], t
    assert strkernel.sentences("") == [] and len(strkernel.sentences("word " * 5000)) > 100


def test_letters_of_all_scripts_and_short_sentences_are_kept():
    assert strkernel.sentences("你是白痴。滚") == ["你是白痴", "滚"] and strkernel.sentences("No. 7!") == ["no", "0"]
    assert strkernel.sentences("Ты идиот!") and strkernel.sentences("أنت غبي") == ["انت غبي"]


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_bulk_normalising_equals_single(texts):
    one = [strkernel._undone(strkernel._folded(t.replace("\0", " ").replace("\n", " "))) for t in texts]
    assert strkernel.normal_all([t.replace("\n", " ") for t in texts]) == one


def test_score_equals_the_kernel_sum():
    texts = ["you are a pig", "the lamp", "a", "wörd of 你是白痴"]
    rng = np.random.default_rng(4)
    table, rarity = rng.normal(size=1 << strkernel.BITS).astype(np.float32), rng.uniform(0.2, 1, 1 << strkernel.BITS).astype(np.float32)
    for t, got, (ids, w) in zip(texts, strkernel.score(texts, table, rarity, 0.5), strkernel.sparse(texts)):
        r = w * rarity[ids]
        assert abs(got - (0.5 + (table[ids] * w).sum() / np.sqrt((r * r).sum()))) < 1e-3


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    calm = ["the {0} of frame {1} is {2}", "please send the {0} again before {1}", "thanks for the {2} {0} of batch {1}"]
    rude = ["you are a worthless {3} and your {0} is trash", "shut up you filthy {3}", "i will hurt you {3} and your {0}"]
    fill = lambda t: t.format(rng.choice(["focus", "crop", "lamp", "background"]), rng.randrange(90), rng.choice(["soft", "good", "late"]), rng.choice(["idiot", "moron", "pig", "scumbag"]))
    docs, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        parts = [fill(rng.choice(calm)) for _ in range(3)]
        if bad:
            s = fill(rng.choice(rude))
            parts.insert(1, s.replace("o", "0") if i % 10 == 0 else s)
        docs.append((i, ". ".join(parts) + ".", "s", int(bad)))
        if i < 300:
            labels.append((i, int(bad) if i % 29 else 1 - int(bad), "r"))
    docs += [(900, None, "s", 0), (901, "", "s", 0), (902, "?!", "s", 0), (903, "calm words. " * 4000, "s", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, truth int").withColumn("toxic", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, labeller string")
    model = toxicity.train(toxicity.training_sentences(d, lab, 20_000), landmarks=120)
    out = toxicity.score_documents(d, model, ["doc_id", "source", "truth"]).toPandas()
    held = out[(out.doc_id >= 300) & (out.doc_id < 900)]
    assert (held.flagged == (held.truth == 1)).mean() >= 0.97
    assert not out[out.doc_id >= 900].flagged.any() and out[out.doc_id.isin([900, 901, 902])].score.isna().all()
    none = toxicity.train(toxicity.training_sentences(d, lab.limit(0), 100))
    assert none is None and toxicity.score_documents(d, none, ["doc_id"]).where("flagged").count() == 0


def test_labels_alone_convict_a_sentence():
    rows = [(i, int(i < 40), f"calm {i % 60}") for i in range(300)]
    rows += [(i, 1, x) for i in range(6) for x in ("jump off a bridge", f"beside it {i % 2}")]  # the bridge explains all six
    rows += [(i, 1, "twice") for i in (7, 8)] + [(i, int(i < 40), "as often as not") for i in (9, 10, 11, 12, 50, 51, 52, 53)]
    rows += [(i, 1, x) for i in range(20, 30) for x in ("copied", "and copied")]
    rows = pd.DataFrame([(d, t, x) for d, t, x in rows if not (20 <= d < 30 and x.startswith("calm"))], columns=["doc_id", "toxic", "sentence"])
    bags = toxicity._Bags(rows, 4, np.random.default_rng(1))
    assert list(bags.texts[bags.evident(np.zeros(len(bags.texts)))]) == ["jump off a bridge"]


def test_copies_of_a_labelled_text_train_once(spark):
    texts = ["you pig. the lamp is soft", "the crop is good", "you pig. the lamp is soft", "you pig. the lamp is soft"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.training_sentences(d, lab, 20_000)
    assert sorted(zip(rows.toxic, rows.sentence)) == [(0, "the crop is good"), (1, "the lamp is soft"), (1, "you pig")]
    copies = pd.DataFrame([(i, int(i != 2), x) for i in (0, 2, 3) for x in ("you pig", "the lamp is soft")] + [(1, 0, "the crop is good")], columns=["doc_id", "toxic", "sentence"])
    bags = toxicity._Bags(copies, 4, np.random.default_rng(1))
    assert sorted(bags.label) == [0, 1] and len(bags.s) == 3 and bags.n1.max() == 1


def _one(text, key=None, companion=None, limit=np.nan):
    return truncation.features([text], ["1"], np.array([limit]), [key], [companion], 0, np.zeros(truncation.SLOTS, np.int8))[0]


def test_companion_words_are_read_to_the_end():
    url, far = "https://x.example/7/a-lighthouse", "a long caption " * 60
    assert (_one(url, "7", far + "with a lighthouse") != _one(url, "7", far + "with a house")).sum() == 1
    assert (_one(url, "7", None) == _one(url, "7", far)).all() and (_one(url)[-4:] == truncation.NONE).all()


def test_words_and_their_texts():
    h, of = truncation.words_of(["Ab cd", "", "ab,\u00e9\u4f60 12", "?!"])
    assert of.tolist() == [0, 0, 2, 2, 2] and h[0] == h[2] and len(set(h.tolist())) == 4
    assert len(truncation.words_of([])[0]) == 0 and len(truncation.words_of(["", "..."])[0]) == 0


def test_valley_between_titles_and_texts():
    short, long = np.arange(5, 20), np.arange(50, 120)
    assert 20 <= truncation.valley(np.r_[short, long], np.r_[np.full(15, 30), np.full(70, 20)]) <= 50
    assert truncation.valley(long, np.full(70, 20)) == 0 and truncation.valley(np.zeros(0), np.zeros(0)) == 0


def test_limit_in_bytes_and_few_values(spark):
    rows = [(i, 1, ("ä" * (20 + i % 9) + "word " * 40)[:120].encode()[: 90 if i % 2 else 50 + i % 40].decode("utf-8", "ignore")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, site int, t string")
    vals = truncation.values(df, "id", "site", {"t": None}, "t")
    got = truncation.field_limits(truncation.length_counts(vals)).collect()
    assert [(r["unit"], r["limit"]) for r in got] == [("b", 90)]
    few = truncation.cut_values(spark.createDataFrame([(1, 1, "x"), (2, None, ""), (3, 1, None)], "id long, site int, t string"), "id", "site", {"t": None}, "t").collect()
    assert [(r["item"], r["truncated"]) for r in few] == [(1, False)]
    assert truncation.cut_values(df.limit(0), "id", "site", {"t": None}, "t").count() == 0
