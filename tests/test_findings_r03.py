"""Queries that differed from their SQL or didn't hold at size, each against DuckDB or brute force on small odd tables."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(folder, **frames):
    """The frames as a folder of tables."""
    for name, f in frames.items():
        f.to_parquet(folder / f"{name}.parquet")
    return str(folder)


def documents(texts, ids=None):
    n = len(texts)
    return pd.DataFrame({"doc_id": ids or list(range(n)), "text": texts, "lang": [["en", "de"][i % 2] for i in range(n)], "source": [f"src{i % 3}" for i in range(n)], "n_chars": [len(t or "") for t in texts]})


def both(spark, name, folder, digits=6):
    """Sorted rows of a query by Spark and by its SQL."""
    import duckdb

    c = duckdb.connect()
    for p in __import__("pathlib").Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, folder).toPandas()[list(want.columns)]
    rows = lambda f: sorted((tuple(round(float(v), digits) if isinstance(v, (int, float, np.number)) else v for v in r) for r in f.itertuples(index=False)), key=str)
    return rows(got), rows(want)


def test_near_terms_count_bytes_as_their_sql(spark, tmp_path):
    d = tables(tmp_path, benchmark=pd.DataFrame({"item_id": [0, 1], "text": ["ungheit ungheitß wortgleich", "wortgleiche mentaux èmentaux mentauxs"]}))
    got, want = both(spark, "near_term_levenshtein", d)
    assert got == want and ("ungheit", "ungheitß") not in got and ("wortgleich", "wortgleiche") in got


ITEMS = ["an ordinary question about longestwordofall", "short one", "x", "the middleword here"]
TEXTS = ["So: an ordinary question about longestwordofall. Yes", "ashort ones", "nothing", "breathe middleword hereby, an ordinary question about longestwordofalls", "an ordinary question about", None, "the  middleword here", ""]


@pytest.mark.parametrize("name", ["bm25_eval", "plan_report", "segment_metrics"])
def test_items_are_found_within_longer_words(spark, tmp_path, name):
    d = tables(tmp_path, benchmark=pd.DataFrame({"item_id": range(len(ITEMS)), "text": ITEMS}), documents=documents(TEXTS))
    got, want = both(spark, name, d)
    assert got == want


WORDS = "the ship sails over deep water and finds an island of stone where nobody lives now Straße été 12 x".split()


@pytest.fixture
def corpus(tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 30))) for _ in range(300)] + ["", None, "…"]
    items = [" ".join(rng.choice(WORDS, rng.integers(2, 9))) for _ in range(12)] + ["unknown words", "", "the the ship"]
    return tables(tmp_path, benchmark=pd.DataFrame({"item_id": range(len(items)), "text": items}), documents=documents(texts[:-2] + ["…"]))


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fuse_two_lanes", "layer_report", "mapped_ids", "tune_grid"])
def test_lanes_are_scored_in_slices(spark, corpus, monkeypatch, name):
    """Neither pairs of queries and documents nor texts are shuffled, whatever the slices."""
    from tessera.operators import lexical

    gone = lambda *a, **k: pytest.fail("all pairs")
    for f in ("bm25", "bm25_terms"):
        monkeypatch.setattr(lexical, f, gone)
    monkeypatch.setattr(lexical, "AT_ONCE", 100)
    got, want = both(spark, name, corpus)
    assert got == want and got


def test_lanes_of_many_queries_are_joined(spark, corpus, monkeypatch):
    from tessera.operators import lexical

    q, d = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("benchmark", "documents"))
    rows = lambda: sorted(map(tuple, lexical.lanes(q, d, 3).collect()))
    got = rows()
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert got == rows() and {r[1] for r in got} == {"bm25", "keyword"}


def test_numbered(spark):
    from tessera.operators import lexical

    rows = spark.range(1000).selectExpr("cast((id * 7919) % 1000 * 3 as string) as name")
    got = {r["name"]: r["index"] for r in lexical.numbered(rows, "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(str(3 * i) for i in range(1000)))}


def test_context_of_hits(spark, corpus):
    got, want = both(spark, "context_block", corpus)
    assert got == want


def test_signals_of_slices_are_those_of_pairs(spark, monkeypatch):
    """Ranges, scores and ranks of all pairs, of which only the best are shuffled; absent inputs stay null."""
    from pyspark.sql import functions as F

    from tessera.operators import scoring
    from tessera.operators.vectors import paired

    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    vec = lambda i: None if i % 19 == 18 else rng.normal(size=3 if i % 13 == 12 else 8).tolist()
    q = spark.createDataFrame([(i, "" if i == 4 else text(5), [] if i == 3 else rng.normal(size=8).tolist()) for i in range(6)], "query_id long, query string, q array<double>")
    rows = spark.createDataFrame([(f"r{i}", [None, "", text(6)][min(i % 11, 2)], vec(i), None if i % 3 else text(2) + ".txt", float(i % 2)) for i in range(120)], "id string, content string, v array<double>, filename string, recency_score double")
    raw = ["raw_embedding", "raw_keyword", "raw_filename"]
    plain = scoring.raw_signals(paired(scoring.with_tokens(q, "query"), scoring.with_tokens(rows, "content")))
    want = {(r.query_id, r.id): tuple(None if r[c] is None else round(r[c], 9) for c in raw) for r in plain.collect()}
    lanes = {"a": scoring.DEFAULT, "b": scoring.Weights(0, 1, 0), "c": scoring.Weights(0.4, 0.3, 0.1, 0.2)}
    best = {(n, r.query_id, r.id, r.hybrid_rank, round(r.score, 9)) for n, w in lanes.items() for r in scoring.hybrid(plain, w).where("hybrid_rank <= 7").collect()}
    for at_once, most in ((1 << 20, 1 << 26), (40, 1 << 26), (40, 0)):
        monkeypatch.setattr(scoring, "AT_ONCE", at_once)
        monkeypatch.setattr(scoring, "BROADCAST_BYTES", most)
        got = {(r.query_id, r.id): tuple(None if r[c] is None else round(r[c], 9) for c in raw) for r in scoring.signals(q, rows).collect()}
        assert got == want
        assert {(r.lane, r.query_id, r.id, r.hybrid_rank, round(r.score, 9)) for r in scoring.best_pairs(q, rows, 7, lanes).collect()} == best


@pytest.mark.parametrize("name", ["hybrid_score_topk", "hybrid_trace"])
def test_hybrid_signals_equal_their_sql(spark, corpus, tmp_path, monkeypatch, name):
    from tessera.operators import scoring

    for t in ("benchmark", "documents"):  # the SQL counts blank texts as 0, not as absent
        f = pd.read_parquet(tmp_path / f"{t}.parquet")
        f[f.text.fillna("") != ""].to_parquet(tmp_path / f"{t}.parquet")
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 64))
    pd.DataFrame({"vec_id": range(200), "embedding": list((v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)), "label": np.arange(200) % 3}).to_parquet(tmp_path / "embeddings.parquet")
    monkeypatch.setattr(scoring, "raw_signals", lambda *a: pytest.fail("pair by pair"))
    got, want = both(spark, name, corpus)
    assert got == want and got


@pytest.fixture
def embedded(tmp_path):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(150, 64))
    v[120:] = v[:30]  # copies, so that distances and scores tie
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    return tables(tmp_path, embeddings=pd.DataFrame({"vec_id": [(i * 37) % 150 for i in range(150)], "embedding": list(v), "label": np.arange(150, dtype=np.int32) % 10}))


@pytest.mark.parametrize("name", ["two_stage_topk", "ann_recall", "ann_profile", "pq_adc_topk", "valid_topk", "exact_vector_topk"])
@pytest.mark.parametrize("most", [64 << 20, 5000])
def test_candidates_are_never_written(spark, embedded, monkeypatch, name, most):
    """The candidates are a share of all pairs; neither they nor other pairs may be shuffled, in blocks or with one side on all workers."""
    from tessera.operators import cluster, vectors

    gone = lambda *a, **k: pytest.fail("all candidates")
    for m, f in ((vectors, "hamming_candidates"), (vectors, "search_keys"), (vectors, "paired"), (cluster, "pq_search")):
        monkeypatch.setattr(m, f, gone)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", most)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 1 << 20 if most > 5000 else 40)
    monkeypatch.setattr(vectors, "AT_ONCE", 1000)
    got, want = both(spark, name, embedded)
    assert got == want and got


def test_stages_equal_the_plain_way(spark, embedded, monkeypatch):
    """Few candidates, which most of the exact best aren't among."""
    from pyspark.sql import functions as F

    from tessera.operators import cluster, vectors

    e = spark.read.parquet(f"{embedded}/embeddings.parquet")
    v = e.select(F.col("label").alias("grp"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("v"))
    q = e.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    book = cluster.train_codebook(e, 8, 16, rounds=3)
    codes = cluster.encode(e, book, 8)
    ways = [lambda: vectors.two_stage(q, v, 3, 6).collect(), lambda: cluster.pq_rerank(q, e, codes, book, 8, 3, 6).collect()]
    rows = lambda f: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f()}
    got = [rows(f) for f in ways]
    for m in (cluster, vectors):
        monkeypatch.setattr(m, "BROADCAST_BYTES", 1000)
    assert got == [rows(f) for f in ways] and all(len(g) == 120 for g in got)


@pytest.mark.parametrize("rows", [1000, 7])
def test_distances_within_groups_are_products_of_blocks(spark, embedded, monkeypatch, rows):
    from tessera.operators import vectors
    from tessera.plans import catalog_vector

    monkeypatch.setattr(vectors, "PAIR_ROWS", rows)
    monkeypatch.setattr(catalog_vector.V, "cosine_distance", lambda *a: pytest.fail("pair by pair"))
    got, want = both(spark, "distances_within_label", embedded)
    assert got == want and got


def test_kmeans_rounds_are_products(spark, embedded, monkeypatch):
    """One assignment at the end; the rounds themselves sum up slices."""
    from tessera.operators import cluster

    e, calls, assign = spark.read.parquet(f"{embedded}/embeddings.parquet"), [], cluster.assign
    monkeypatch.setattr(cluster, "assign", lambda *a: calls.append(1) or assign(*a))
    a, c = cluster.kmeans(spark, e, 4)
    got, book = a.toPandas(), {r.cluster: np.array(r.c) for r in c.collect()}
    assert len(calls) == 1 and len(got) == 150 and set(got.cluster) == set(book)
    for n, x in got.groupby("cluster"):
        mean = np.array(x.v.tolist(), float).mean(0)
        assert np.allclose(mean / np.linalg.norm(mean), book[n], atol=1e-5)


def _greedy(x, z, threshold, target, most, most_bytes):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cluster, n = [-1] * len(x), 0
    for i in range(len(x)):
        if cluster[i] >= 0:
            continue
        cluster[i], members, used, s = n, 1, z[i], np.round(u @ u[i], 12)
        for j in sorted(range(len(x)), key=lambda j: (-s[j], j)):
            if cluster[j] >= 0:
                continue
            if members >= most:
                break
            if used + z[j] > most_bytes:
                continue
            if s[j] < threshold or members >= target:
                break
            cluster[j], members, used = n, members + 1, used + z[j]
        n += 1
    return cluster


@pytest.mark.parametrize("options", [dict(threshold=0.2), dict(threshold=-1.0, target=9, most=5), dict(threshold=0.1, target=30, most=40, most_bytes=60)])
def test_greedy_in_batches_equals_the_rule(spark, monkeypatch, options):
    from tessera.operators import cluster

    rng = np.random.default_rng(9)
    x, z = rng.integers(-2, 3, (230, 5)).astype(float) + 0.25, rng.integers(0, 30, 230)
    v = spark.createDataFrame([(i, r.tolist(), int(s)) for i, (r, s) in enumerate(zip(x, z))], "vec_id long, embedding array<double>, z long")
    monkeypatch.setattr(cluster, "GREEDY_BATCH", 7)
    monkeypatch.setattr(cluster, "MOST_POINTS", 100)
    got = [r.cluster for r in cluster.greedy(v, size="z", **options).orderBy("id").collect()]
    assert got == _greedy(x, z, **({"target": 8, "most": 12, "most_bytes": 80 * 1024} | options))


def test_average_linkage_holds_no_pairs(spark, monkeypatch):
    from tessera.operators import cluster

    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 6))
    x[100:] = x[:20]  # ties
    x[50] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(cluster, "MOST_POINTS", 100)
    got = [tuple(r) for r in cluster.hierarchical(v, 5).collect()]
    u = x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None]
    d, members, name, want = 1 - u @ u.T, {i: [i] for i in range(120)}, {i: i for i in range(120)}, []
    while len(members) > 5:
        value, i, j = min((round(float(d[np.ix_(members[i], members[j])].mean()), 12), i, j) for i in members for j in members if i < j)
        want.append((len(want), name[i], name[j], value, len(members[i]) + len(members[j]), 120 + len(want)))
        members[i], name[i] = members[i] + members.pop(j), 120 + len(want) - 1
    assert [(*g[:3], round(g[3], 9), *g[4:]) for g in got] == [(*w[:3], round(w[3], 9), *w[4:]) for w in want]


def test_fragments_are_located_without_patterns(monkeypatch):
    """As a pattern of the words with any white space between them finds them, but nothing is compiled for a fragment."""
    import random
    import re

    from tessera.operators import chunking

    r, cases = random.Random(1), []
    for _ in range(3000):
        t = "".join(r.choice(["a", "b", "ab", " ", "  ", "\n", "\t ", "\x1c", "é."]) for _ in range(r.randint(1, 25)))
        f = "".join(r.choice(["a", "b", " ", "  ", "\n", "é."]) for _ in range(r.randint(1, 6)))
        if f.strip():
            cases.append((t, f, r.randint(0, len(t)), re.compile(r"\s+".join(map(re.escape, f.split())))))
    want = [(lambda i, m: (i, i + len(f)) if i >= 0 else m and m.span())(t.find(f, at), p.search(t, at)) for t, f, at, p in cases]
    monkeypatch.setattr(chunking.re, "compile", lambda *a: pytest.fail("compiled"))
    got = [chunking.locate(t, f, at, early=True) for t, f, at, _ in cases]
    assert [g for g, w in zip(got, want) if w] == [w for w in want if w] and sum(w is not None for w in want) > 100


def test_simhash_pairs_are_compared_in_buckets(spark, monkeypatch):
    """Many hashes alike: all near pairs once each, and no other pair of a bucket becomes a row of a join."""
    from tessera.operators import dedup

    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    v = sorted({(base[i % 3] << (i % 2)) % (1 << 64) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for i in range(200)})
    hashes = spark.createDataFrame([(f"{x:016x}",) for x in v], "hash string")
    want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in v for b in v if a < b and (a ^ b).bit_count() <= 3}
    for rows in (100_000, 20):
        monkeypatch.setattr(dedup, "BUCKET_ROWS", rows)
        pairs = dedup.simhash_pairs(hashes, 3)
        assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want and len(want) > 100
