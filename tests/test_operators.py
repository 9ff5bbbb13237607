"""Operators of retrieval, evaluation, deduplication, clustering and chunking."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine, Options
from tessera.operators import aggregates, chunking, cluster, dedup, evaluation, lexical, scoring, search, sequence, vectors
from tessera.sources import readers
from tessera.sources.filters import matches
from tessera.sources.store import ChunkStore
from tessera.streaming import ingest


def test_bm25_formula(spark):
    d = spark.createDataFrame([(1, "alpha alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    got = {r.doc_id: r.score for r in lexical.bm25(q, d).collect()}

    def part(df, tf, n):
        return math.log(1 + (2 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2.5))

    assert got[1] == pytest.approx(part(2, 2, 3) + part(1, 1, 3), abs=1e-12) and got[2] == pytest.approx(part(2, 1, 2), abs=1e-12)


def test_ranks(spark):
    r = spark.createDataFrame([(1, "b", 2.0, "s"), (1, "c", 1.0, "s"), (1, "a", 2.0, "s")], "query_id int, id string, score double, source string")
    assert [x.id for x in lexical.rank_by_score(r, ["query_id"]).orderBy("rank").collect()] == ["a", "b", "c"]
    f = lexical.rrf(spark.createDataFrame([(1, "x", "a", 1), (1, "x", "a", 2), (1, "y", "a", 2), (1, "y", "b", 1)], "query_id int, source string, id string, rank int")).orderBy("rank").collect()
    assert [x.id for x in f] == ["a", "b"] and f[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "b", 4)], "query_id string, doc_id string, rank int")
    j = spark.createDataFrame([("q", "a", 1.0, "t"), ("q", "b", 2.0, "u"), ("q", "c", 1.0, "t")], "query_id string, doc_id string, relevance double, topic string")
    m = evaluation.metrics(run, j, 3).first()
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert (m.recall, m.precision, m.mrr, m.unique_topics) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0, 2)
    assert m.ndcg == pytest.approx((1 + 3 / 2) / ideal)
    with pytest.raises(ValueError, match="misses"):
        evaluation.checked(run.where("false"), j)


def test_hybrid_calibration(spark):
    rows = [("q", "alpha beta", [1.0, 0.0], i, c, v, None) for i, c, v in (("a", "alpha beta", [1.0, 0.0]), ("b", "alpha", [0.0, 1.0]), ("c", "gamma", None))]
    p = spark.createDataFrame(rows, "query_id string, query string, q array<double>, id string, content string, v array<double>, filename string")
    got = {r.id: r.score for r in scoring.hybrid(p).collect()}
    assert got["a"] == pytest.approx(0.9) and got["b"] == pytest.approx(0.135) and got["c"] == 0
    single = scoring.hybrid(p.where("id = 'b'")).first().score
    assert single == pytest.approx(0.27 * 0.5)


def test_simhash_leaders_equal_the_sequential_pass(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = sorted({int(b) ^ sum(1 << int(i) for i in rng.integers(0, 64, rng.integers(0, 5))) for b in base for _ in range(12)})
    hashes = [f"{v:016x}" for v in values]
    want, taken = {}, set()
    for i, h in enumerate(hashes):
        if h in taken:
            continue
        want[h] = h
        for o in hashes[i + 1 :]:
            if o not in taken and (int(o, 16) ^ int(h, 16)).bit_count() <= 3:
                taken.add(o)
                want[o] = h
    got = {r.hash: r.leader for r in dedup.simhash_groups(spark.createDataFrame([(h,) for h in hashes], "hash string"), 3).collect()}
    assert got == want


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (7, 7)], "a long, b long")
    assert {r.id: r.root for r in dedup.components(spark, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_mmr(spark):
    c = spark.createDataFrame([(1, i, s, v) for i, (s, v) in enumerate([(1.0, [1.0, 0.0]), (0.9, [1.0, 0.0]), (0.5, [0.0, 1.0]), (float("nan"), [1.0, 1.0])])], "query_id int, doc_id int, score double, v array<double>")
    assert [r.doc_id for r in search.mmr(c, 10, 0.5).orderBy("mmr_rank").collect()] == [0, 2, 1]
    assert [r.doc_id for r in search.mmr(c, 2, 1.0).orderBy("mmr_rank").collect()] == [0, 1]


def test_rerank(spark):
    c = spark.createDataFrame([(1, "q", "a", 1), (1, "q", "b", 2), (1, "q", "c", 3)], "query_id int, query string, content string, rank int")
    got = search.rerank(c, lambda q, texts: [0.1, 0.9, 0.9]).orderBy("rerank_rank").collect()
    assert [r.content for r in got] == ["b", "c", "a"] and [r.previous_rank for r in got] == [2, 3, 1]
    with pytest.raises(Exception, match="within 0..1"):
        search.rerank(c, lambda q, texts: [2.0]).collect()


def test_two_stage_recall(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 32)))], "grp int, chunk_index int, v array<double>")
    q = v.limit(10).select(F.col("chunk_index").alias("query_id"), F.col("v").alias("q"))
    exact = {(r.query_id, r.chunk_index) for r in vectors.exact_search(q, v, 5).collect()}
    two = {(r.query_id, r.chunk_index) for r in vectors.two_stage(q, v, 5, 150).collect()}
    assert len(exact & two) >= 0.9 * len(exact)
    for sf in ("sf0.01", "sf0.1"):  # with the queries' own parameters, every vector a query
        from tessera.plans import catalog_vector

        assert catalog_vector.ann_recall(spark, f"/root/testdata/{sf}").first().recall_at_5 >= 0.9
    good, report = vectors.indexed(spark.createDataFrame([(0, 0, [1.0]), (0, 0, [2.0]), (0, 1, [float("nan")]), (0, 2, [1.0, 2.0])], "grp int, chunk_index int, v array<double>"), 1)
    assert good.count() == 1 and tuple(report.first()) == (4, 1, 1, 1, 1)


def test_medians_and_percentiles(spark):
    v = spark.createDataFrame([([1.0, 5.0],), ([3.0, 1.0],), ([2.0, 9.0],), ([4.0, 7.0],)], "embedding array<double>")
    assert [r.median for r in aggregates.upper_medians(v).orderBy("dim").collect()] == [3, 7]
    cohort = spark.createDataFrame([(float(i),) for i in range(1, 22)] + [(float("nan"),)], "sample double")
    got = {r.score: r.percentile for r in aggregates.percentiles(spark.createDataFrame([(1.0,), (21.0,), (11.0,), (-5.0,), (99.0,)], "score double"), cohort).collect()}
    assert got == {1.0: 0.0, 21.0: 1.0, 11.0: 0.5, -5.0: 0.0, 99.0: 1.0}
    with pytest.raises(ValueError, match="20"):
        aggregates.percentiles(cohort, cohort.limit(5), "sample")


def test_sequences(spark):
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate([1.0, 2.0, 4.0, 8.0])], "k string, i int, s double")
    assert [r.gradient for r in sequence.gradient(s, "s", ["k"], "i").orderBy("i").collect()] == [1, 1.5, 3, 4]
    assert [r.smoothed for r in sequence.moving_average(s, "s", 3, ["k"], "i").orderBy("i").collect()] == pytest.approx([1.5, 7 / 3, 14 / 3, 6])
    assert [r.smoothed for r in sequence.gaussian(s.withColumn("s", F.lit(2.0)), "s", 1.0, ["k"], "i").collect()] == pytest.approx([2] * 4)


def test_clusters(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3]
    v = spark.createDataFrame([(i, (centres[i % 3] + rng.normal(scale=0.05, size=6)).tolist(), i % 3) for i in range(60)], "vec_id int, embedding array<double>, label int")
    a = cluster.kmeans(spark, v, 3, rounds=10)[0].collect()
    assert len({(r.id % 3, r.cluster) for r in a}) == 3
    assert cluster.silhouette(v).agg(F.avg("silhouette")).first()[0] > 0.9
    steps = cluster.hierarchical(v, 1).toPandas()
    assert len(set(cluster.cut(steps, 60, 0.5))) == 3 and len(steps) == 59
    g = cluster.greedy(v, 0.9).groupBy("cluster").count().collect()
    assert max(r["count"] for r in g) <= 8 and sum(r["count"] for r in g) == 60
    book = cluster.train_codebook(v, 2, 8)
    codes = cluster.encode(v, book, 2)
    err = cluster.decode(codes, book).join(v, F.col("id") == F.col("vec_id")).collect()
    assert np.mean([np.sum((np.array(r.v) - np.array(r.embedding)) ** 2) for r in err]) < 0.1


TEXTS = {
    "english": "One sentence here. Another, e.g. this one by Dr. Who! Is 3.14 a number? Yes. " * 12,
    "paragraphs": "First paragraph of words.\n\nSecond one, longer than the first.\n\n" * 10,
    "fence": "Intro text.\n\n```py\nx = 1. \ny = 2\n```\n\nAfter it. More.",
    "emoji": "😀 smile. é accent! " * 40,
    "greek": "αβγδε" * 200,
    "headings": "# A\n\ntext a " + "word " * 60 + "\n\n## B\n\nb text. " * 3 + "\n\n# C\n\nend",
    "table": "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 60,
}


@pytest.mark.parametrize("strategy", sorted(chunking.STRATEGIES))
@pytest.mark.parametrize("name", sorted(TEXTS))
def test_chunks_hold(strategy, name):
    t = TEXTS[name]
    got = chunking.pieces(t, strategy, 120, 20)
    assert got and [c["id"] for c in got] == list(range(len(got)))
    raw = t.encode()
    for c in got:
        assert c["text"].strip()
        if strategy != "token" and not (strategy == "optimal"):
            assert c["char_count"] <= 120 or strategy in ("markdown",)
        if c["end"]:
            part = raw[c["start"] : c["end"]].decode()
            assert part.split() == c["text"].split() or c["text"] in part or strategy == "markdown"
    if name != "table":
        words = set(t.split())
        if strategy in ("smart", "sentence", "word", "paragraph", "heading") and name != "greek":
            assert {w for c in got for w in c["text"].split()} >= words
    assert chunking.pieces("", strategy) == [] == chunking.pieces(t, strategy, 0)


def test_sentences_keep_abbreviations_and_numbers():
    assert [s.text for s in chunking.sentences("Dr. Who has 3.14 pies. Done! Ok?")] == ["Dr. Who has 3.14 pies.", "Done!", "Ok?"]
    assert [c["path"] for c in chunking.pieces("# A\n\n" + "x " * 50 + "\n\n## B\n\n" + "y " * 50 + "\n\n# C\n\nz", "heading", 80)] == [["A"]] * 2 + [["A", "B"]] * 2 + [["C"]]


def test_filters(spark):
    d = spark.createDataFrame([("a", "d", "f", '{"n": 1, "x.y": "v", "z": null, "t": true, "big": 9007199254740993}'), ("b", "d", "f", '{"n": "1", "big": 9007199254740992}')], "id string, document_id string, filename string, m string").withColumn("metadata", F.parse_json("m"))
    some = lambda **f: [r.id for r in d.where(matches(f)).orderBy("id").collect()]
    assert some(n=1) == some(n=1.0) == ["a"] and some(n="1") == ["b"] and some(z=None) == ["a"] and some(t=True) == ["a"]
    assert some(big=9007199254740993) == ["a"] and some(document_id="d") == ["a", "b"] and some(document_id=1) == [] and some(missing=None) == []
    assert [r.id for r in d.where(matches({"x.y": "v"})).collect()] == ["a"]
    with pytest.raises(ValueError):
        matches({"n": [1]})


def test_store_contract(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(r, "id string, document_id string, content string, embedding array<double>, pos int")
    s.upsert(rows(("a", "d1", "x", [1.0, 0.0], 1), ("b", "d1", "y", [0.0, 1.0], 2), ("a", "d1", "z", [1.0, 1.0], 3)), "pos")
    assert {r.id: r.content for r in s.read().collect()} == {"a": "z", "b": "y"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    for bad in (rows(("c", "d2", "", [1.0, 0.0], 1), ("c", "d2", "", [1.0, 0.0], 2)), rows(("a", "d2", "", [1.0, 0.0], 1)), rows(("c", "d3", "", [1.0, 0.0], 1)), rows(("c", "d2", "", [1.0], 1))):
        with pytest.raises(ValueError):
            s.replace_documents(ids("d2"), bad)
    with pytest.raises(ValueError):
        s.replace_documents(ids("d2", "d2"), rows())
    assert s.read().count() == 2
    s.replace_documents(ids("d1", "d2"), rows(("n", "d2", "new", [0.5, 0.5], 1)))
    assert [r.id for r in s.read().collect()] == ["n"]
    s.delete_document("d2")
    assert s.read().count() == 0
    with pytest.raises(ValueError):
        s.upsert(rows(("q", "d", "", [1.0], 1)))
    s.reset()
    s.upsert(rows(("q", "d", "", [1.0], 1)))
    assert s.read().count() == 1


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), dim=128)
    docs = spark.createDataFrame([("rivers", "rivers.md", "Rivers carry water from mountains to the sea."), ("bread", "bread.md", "Bread is baked from flour, water and yeast."), ("stars", "stars.md", "Stars burn hydrogen in their cores.")], "id string, title string, text string")
    assert e.ingest(docs) == 3
    q = spark.createDataFrame([(1, "baked bread flour"), (2, "stars hydrogen"), (3, "  ")], "query_id int, query string")
    for o in (Options(top_k=2), Options(top_k=2, rrf=True), Options(top_k=2, mmr=0.7), Options(top_k=2, candidates=2, explain=True), Options(top_k=2, reranker=lambda q, t: [float("bread" in x.lower()) if "bread" in q else float("Stars" in x) for x in t])):
        got = {r.query_id: r.document_id for r in e.search(q, o).where("rank = 1").collect()}
        assert got == {1: "bread", 2: "stars"}
    assert e.search(q, Options(top_k=0)).count() == 0
    assert {r.document_id for r in e.search(q, Options(filters={"document_id": "rivers"})).collect()} == {"rivers"}
    assert "Bread" in e.context(e.search(q, Options(top_k=2)), 40).where("query_id = 1").first().context
    assert e.ingest(spark.createDataFrame([("bread", "", "")], "id string, title string, text string")) == 0
    assert e.store.read().count() == 2


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"f{i}.txt").write_text(f"text {i}" if i != 3 else "bad")

    def decode(path, content):
        text = content.decode()
        if text == "bad":
            raise ValueError("bad record")
        return [{"id": path.rsplit("/", 1)[1], "document_id": path, "content": text}]

    store = ChunkStore(spark, str(tmp_path / "store"))
    go = lambda: ingest.run(ingest.decoded(ingest.directory(spark, str(src), 2), decode, "id string, document_id string, content string"), ingest.index_sink(store, "m1"), str(tmp_path / "check"))
    first = go()
    assert (first.read, first.written, first.skipped, first.batches) == (5, 4, 1, 3) and store.read().count() == 4
    (src / "f9.txt").write_text("text 9")
    again = go()
    assert (again.read, again.written) == (1, 1) and {r.index_identity for r in store.read().collect()} == {"m1"}


def test_readers_and_codecs(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿x\r\ny".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"z" * 100)
    docs, bad = readers.read_texts(spark, str(tmp_path), 50)
    assert [(r.title, r.text) for r in docs.collect()] == [("a.txt", "x\ny")] and {r.reason for r in bad.collect()} == {"too large", "not UTF-8"}
    v = spark.createDataFrame([([1.0, -2.5],), ([],)], "v array<double>")
    assert [r.x for r in v.select(readers.decode_vector(readers.encode_vector(F.col("v"))).alias("x")).collect()] == [[1.0, -2.5], []]
    from tessera.functions.text import hashing_embedding

    cache = spark.createDataFrame([], "key string, embedding array<float>")
    rows, grown = readers.cached_embeddings(spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string"), cache, lambda c: hashing_embedding(c, 8), "p", "m")
    assert rows.count() == 3 and grown.count() == 2


def test_semantic_and_token_chunks_embed_and_tokenise(spark):
    from tessera.functions.text import hashing_vectors
    from tessera.functions.tokenizer import Tokenizer
    from tessera.plans import catalog_engine

    sf, t = "/root/testdata/sf0.001", Tokenizer()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}

    def by_doc(name):
        out = {}
        for r in catalog_engine.QUERIES[name](spark, sf).collect():
            out.setdefault(r.doc_id, {})[r.id] = r.text
        return {d: [c[i] for i in sorted(c)] for d, c in out.items()}

    for name, size, overlap, options, plain in (("token_chunks", 128, 16, {"tokenizer": t}, {}), ("semantic_chunks", 1200, 0, {"embed": hashing_vectors}, {})):
        strategy = name.split("_")[0]
        got = by_doc(name)
        one = lambda text, o: [p["text"] for p in chunking.pieces(text, strategy, size, overlap, **o)]
        want, fallback = ({d: x for d, text in docs.items() if (x := one(text, o))} for o in (options, plain))
        assert got == want and got != fallback
        if strategy == "token":
            assert max(len(t.encode(x)) for c in got.values() for x in c) <= 132


def test_kmeans_clusters_has_converged(spark):
    from tessera.plans import catalog_vector

    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    got = {r.id: r.cluster for r in catalog_vector.QUERIES["kmeans_clusters"](spark, sf).collect()}
    x, a = np.array(e.embedding.tolist(), float), np.array([got[i] for i in e.vec_id])
    c = np.array([x[a == j].mean(0) for j in range(8)])
    sim = (x @ (c / np.linalg.norm(c, axis=1)[:, None]).T) / np.linalg.norm(x, axis=1)[:, None]
    assert (sim.max(1) - sim[np.arange(len(x)), a] < 1e-5).all()


def test_pq_trained_recall(spark):
    from tessera.plans import catalog_vector

    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    row = {r: i for i, r in enumerate(ids)}
    got = catalog_vector.QUERIES["pq_trained_topk"](spark, sf).collect()
    nearest = {q: set(ids[np.argsort(((x - x[row[q]]) ** 2).sum(1))[:5]]) for q in {r.query_id for r in got}}
    assert len(got) == 5 * len(nearest) and sum(r.id in nearest[r.query_id] for r in got) >= 0.9 * len(got)


def test_codebook_is_trained_on_all_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 2 * 10 + i % 7)]) for i in range(400)], "vec_id long, embedding array<double>")
    got = sorted(r.c[0] for r in cluster.train_codebook(v, 1, 2, sample=20).collect())
    assert got == pytest.approx([np.mean([i % 7 for i in range(0, 400, 2)]), np.mean([10 + i % 7 for i in range(1, 400, 2)])])


def test_blocks_give_what_a_broadcast_gives(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (90, 8)).astype(float)
    v = spark.createDataFrame([(i % 4, i, r.tolist() if i % 17 else r[:5].tolist(), r.tolist()) for i, r in enumerate(x)], "grp int, chunk_index int, v array<double>, embedding array<double>")
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.integers(-3, 4, (23, 8)).astype(float))], "query_id int, q array<double>")
    medians = aggregates.upper_medians(v, "embedding")
    assert [r.median for r in medians.orderBy("dim").collect()] == np.sort(x, axis=0)[45].tolist()
    codes = vectors.binary_codes(v.select("grp", "chunk_index", F.col("embedding").alias("v")), medians)
    qc = codes.where("chunk_index < 20").select(F.col("chunk_index").alias("query_id"), "code")
    pool = lambda: aggregates.group_max_pool(q.withColumnRenamed("q", "v"), v.select(F.col("grp").alias("label"), "embedding"), 3)
    searches = [lambda: vectors.exact_search(q, v, 7), lambda: vectors.exact_search(q, v, 7, 4.0), lambda: vectors.hamming_candidates(qc, codes, 9), pool]
    once = [sorted(map(tuple, f().collect())) for f in searches]
    scores = {(r.query_id, r.chunk_index): r.score for r in searches[0]().collect()}
    for qi, row in enumerate(q.collect()):
        best = sorted(((-(float(np.dot(row.q, x[i])) if i % 17 else 0.0), i % 4, i) for i in range(90)))[:7]
        assert {i: -s for s, _, i in best} == {i: s for (a, i), s in scores.items() if a == qi}
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    assert [sorted(map(tuple, f().collect())) for f in searches] == once
    assert vectors.paired(q, v).count() == 23 * 90


def test_cosine_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(60, [1.0, 2.0]), (61, [2.0, 4.0]), (62, []), (63, None)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j): round(float(u[i] @ u[j]), 9) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5} | {(60, 61): 1.0}
    for rows in (4096, 16):
        monkeypatch.setattr(dedup, "BLOCK_ROWS", rows)
        got = [(r.a, r.b, round(r.similarity, 9)) for r in dedup.cosine_pairs(v, 0.5).collect()]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


def test_locate():
    t = "One  two\nthree. One two three."
    assert chunking.locate(t, "One two three") == (16, 29) and chunking.locate(t, "One two three", 18) == (16, 29)
    assert chunking.locate(t, "two three") == (20, 29) and chunking.locate(t, "two\nthree", 16) == (5, 14)
    u = "two three. two\nthree."
    assert chunking.locate(u, "two three", 5, early=True) == (11, 20) and chunking.locate(u, "two three", 5) == (0, 9)
    assert chunking.locate(t, "absent") is None and chunking.locate(t, "") is None and chunking.locate(t, "  ") == (3, 5)


def test_token_chunks_keep_whole_words(spark):
    from tessera.functions.tokenizer import Tokenizer

    t = Tokenizer()
    text = "The quick brown fox jumps over the lazy dog. " * 30
    for overlap in (0, 5):
        got = chunking.pieces(text, "token", 16, overlap, tokenizer=t)
        assert len(got) > 15 and all(0 < c["token_count"] == t.count(c["text"]) <= 17 and c["char_count"] <= 96 for c in got)
        assert all(text.encode()[c["start"] : c["end"]].decode() == c["text"] for c in got if c["end"])
        assert [c["start"] for c in got] == sorted(c["start"] for c in got)
    assert chunking._whole_start("ing cat sat") == "cat sat" and chunking._whole_start("extraordinary cat") == "extraordinary cat"
    assert chunking._whole_end("It ended. Th") == "It ended." and chunking._whole_end("no stop at al") == "no stop at" and chunking._whole_end("extraordinarily") == "extraordinarily"
    other = chunking.pieces(text, "token", 16, 0, tokenizer=Characters())
    assert [c["text"] for c in other] != [c["text"] for c in chunking.pieces(text, "token", 16, 0, tokenizer=t)]


class Characters:
    """A tokenizer of single characters."""

    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))

    def count(self, text):
        return len(text)


def test_attach(spark):
    r = spark.createDataFrame([(0, "a"), (1, "b")], "position int, content string")
    e = spark.createDataFrame([(1, [2.0]), (0, [1.0])], "position int, v array<double>")
    assert {x.content: x.v for x in search.attach(r, e).collect()} == {"a": [1.0], "b": [2.0]}
    for bad in (e.limit(1), e.union(e.limit(1)), e.where("false")):
        with pytest.raises(ValueError):
            search.attach(r, bad)
    assert search.embedded(r, lambda c: F.array(F.char_length(c).cast("double"))).first().v == [1.0]
    with pytest.raises(Exception, match="no content"):
        search.embedded(spark.createDataFrame([(0, None)], "position int, content string"), lambda c: F.array(F.char_length(c))).collect()


def test_lexical_results_explain(spark):
    rows = spark.createDataFrame([("x", "alpha alpha beta"), ("y", "gamma"), ("z", "beta")], "id string, content string")
    got = search.lexical_results(spark.createDataFrame([(1, "alpha beta beta")], "query_id int, query string"), rows, 5, explain=True).orderBy("rank").collect()
    assert [r.id for r in got] == ["x", "z"] and [e.term for e in got[0].explain] == ["alpha", "beta"]
    for r in got:
        assert sum(e.part for e in r.explain) == pytest.approx(r.score) and all(e.tf >= 1 and e.df >= 1 for e in r.explain)


def test_fixture_and_run_problems(spark):
    q = spark.createDataFrame([("a",), ("b",), ("b",), ("",)], "query_id string")
    j = spark.createDataFrame([("a", "d", 1.0), ("a", "d", 2.0), ("a", "", 1.0), ("b", "e", 0.0), ("b", "f", float("nan")), ("c", "g", 1.0)], "query_id string, doc_id string, relevance double")
    got = {(r.problem, r.query_id) for r in evaluation.fixture_problems(q, j).collect()}
    assert got == {("empty query id", ""), ("repeated query id", "b"), ("empty document id", "a"), ("repeated judgment", "a"), ("relevance", "b"), ("no relevant document", ""), ("unknown query", "c")} | ({("no relevant document", "b")} if ("no relevant document", "b") in got else set())
    assert evaluation.fixture_problems(q.limit(1), j.limit(1)).count() == 0
    run = spark.createDataFrame([("a", "d", 1), ("a", "e", 1), ("a", "", 2), ("a", "f", 0)], "query_id string, doc_id string, rank int")
    assert {r.problem for r in evaluation.run_problems(run).collect()} == {"empty id", "rank", "shared rank"} and evaluation.run_problems(run.limit(1)).count() == 0


def test_tuning_with_lambdas(spark):
    rows = [(1, d, s, v) for d, s, v in (("a", 1.0, [1.0, 0.0]), ("b", 0.9, [1.0, 0.0]), ("c", 0.5, [0.0, 1.0]))]
    c = spark.createDataFrame(rows, "query_id int, doc_id string, lex double, v array<double>")
    j = spark.createDataFrame([(1, "a", 1.0), (1, "c", 1.0)], "query_id int, doc_id string, relevance double")
    grid = spark.createDataFrame([(0, 1.0), (1, 0.5)], "grid_id int, w_lex double")
    got = evaluation.tune_mmr(c, j, grid, [1.0, 0.5], 2).orderBy("place").collect()
    assert len(got) == 4 and (got[0].grid_id, got[0]["lambda"], got[0].recall) == (1, 0.5, 1.0) and {r.recall for r in got if r["lambda"] == 1.0} == {0.5}
    assert not evaluation.tune_mmr(c, j, grid, [1.0], 2, least={"recall": 0.9}).where("not rejected").count()


def test_codebooks_and_mini_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.05, (40, 4)) for m in (-2, 0, 3)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    c = np.array([r.c for r in cluster.mini_batch_kmeans(v, 3, 20, 30).orderBy("cluster").collect()])
    assert sorted(c.mean(1).round().tolist()) == [-2, 0, 3]
    with pytest.raises(ValueError):
        cluster.mini_batch_kmeans(v, 3, 0)
    book = cluster.train_codebook(v, 2, 4, 10)
    cluster.save_codebook(book, str(tmp_path / "book"))
    again = cluster.load_codebook(spark, str(tmp_path / "book"))
    assert sorted(map(tuple, again.select("sub", "code", F.col("c").cast("string")).collect())) == sorted(map(tuple, book.select("sub", "code", F.col("c").cast("string")).collect()))
    codes = {r.id: r.codes for r in cluster.encode(v, again, 2).collect()}
    b = {(r["sub"], r.code): np.array(r.c) for r in book.collect()}
    assert all(codes[i] == [min(range(4), key=lambda k: (round(float(((x[i, 2 * s : 2 * s + 2] - b[s, k]) ** 2).sum()), 12), k)) for s in range(2)] for i in range(len(x)))
    book.where("not (sub = 1 and code = 3)").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="codebook"):
        cluster.load_codebook(spark, str(tmp_path / "bad"))
    assert cluster.estimated_accuracy(96, 256) == 0.99 and cluster.estimated_accuracy(24, 64) == pytest.approx(0.885) and cluster.compression(1536, 96) == 64


def test_store_writes_touched_buckets_only(spark, tmp_path):
    from tessera.sources.store import Conflict

    s = ChunkStore(spark, str(tmp_path / "store"), buckets=8)
    rows = lambda *r: spark.createDataFrame(r, "id string, document_id string, content string")
    s.upsert(rows(*((f"d{i}#0", f"d{i}", "old") for i in range(40))))
    before = s._state()["files"]
    assert len(before) == 8
    s.upsert(rows(("d7#0", "d7", "new")))
    after = s._state()["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and s.read().count() == 40 and s.read().where("content = 'new'").count() == 1
    s.upsert(rows(("d7#0", "d8", "moved")))
    assert s.read().where("id = 'd7#0'").first().document_id == "d8" and s.read().count() == 40
    with pytest.raises(ValueError, match="repeat"):
        s.upsert(rows(("x", "d", "1"), ("x", "d", "2")))
    # of two writers that read the same version one gets a conflict, and the store stays readable
    state = s._state()
    s.upsert(rows(("first", "d1", "1")))
    with pytest.raises(Conflict):
        s._commit(state)
    assert s.read().where("id = 'first'").count() == 1
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("log-") ]) == 2


def test_shared_folder_is_named_on_a_cluster():
    from types import SimpleNamespace

    from tessera.sources.shared import shared_folder

    empty = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(_jsc=empty, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None)))


def test_cohorts(spark):
    from tessera.functions.text import model_identity
    from tessera.sources.descriptors import CohortIdentity, Manifest

    cohort = spark.createDataFrame([(float(i),) for i in range(21)], "sample double")
    hits = spark.createDataFrame([(1, "a", 30.0), (1, "b", 40.0), (1, "c", 5.0)], "query_id int, id string, score double")
    got = aggregates.against_cohort(hits, cohort).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", 1.0), ("a", 1.0), ("c", 0.25)]
    CohortIdentity("v2", "m").check(CohortIdentity("v2"))
    for bad in (CohortIdentity("v1", "m"), CohortIdentity("v2", "m", version=3)):
        with pytest.raises(ValueError):
            bad.check(CohortIdentity("v2", "m"))
    assert model_identity("é", "m", dim=8) == "modelref:v1:2:é1:m0:0:1:8"
    m = Manifest(identity="m", dim=8, rows=3)
    assert Manifest.from_json(m.to_json()) == m and m.digest() == Manifest.from_json(m.to_json()).digest()
    m.check(Manifest(dim=8))
    with pytest.raises(ValueError, match="dim"):
        m.check(Manifest(dim=9))


def test_containment(spark):
    from tessera.sources.filters import contains

    d = spark.createDataFrame([(i, j) for i, j in enumerate(('{"a": {"b": [1, "x", {"c": null}], "d": true}, "n": 2.0}', '{"a": {"b": ["y"]}}', '{"a": []}', "null"))], "i int, j string").withColumn("metadata", F.parse_json("j"))
    n = lambda w: [r.i for r in d.where(contains(w)).orderBy("i").collect()]
    assert n({"a": {"b": ["x"]}}) == [0] and n({"a": {"b": [{"c": None}, 1]}}) == [0] and n({"n": 2}) == [0] and n({"a": {"d": True}}) == [0]
    assert n({"a": {"b": []}}) == [0, 1] and n({"a": {}}) == [0, 1] and n({"a": []}) == [2] and n({"a": {"d": 1}}) == [] and n({}) == [0, 1, 2]


def test_match_all(spark):
    d = spark.createDataFrame([(1, "Beta alpha gamma"), (2, "alpha"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "ALPHA alpha"), (3, "--")], "item_id long, text string")
    assert sorted((r.query_id, r.doc_id) for r in lexical.match_all(q, d).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_explanations_of_reranking_and_diversification(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), dim=64)
    e.ingest(spark.createDataFrame([(n, n, t) for n, t in (("a", "red apple pie"), ("b", "red apple tart"), ("c", "blue sky"))], "id string, title string, text string"))
    q = spark.createDataFrame([(1, "red apple")], "query_id int, query string")
    got = e.search(q, Options(top_k=3, explain=True, mmr=0.5, reranker=lambda q, t: [0.1 * len(x) / 20 for x in t])).orderBy("rank").collect()
    assert len(got) == 3 and sorted(r.rerank.after for r in got) == [1, 2, 3] and sorted(r.rerank.before for r in got) == [1, 2, 3]
    for r in got:
        assert r.mmr.value == pytest.approx(0.5 * r.mmr.relevance - 0.5 * r.mmr.similarity) and r.mmr.relevance == pytest.approx(r.rerank.score)
