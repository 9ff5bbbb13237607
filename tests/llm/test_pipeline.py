"""The pipeline's stages, each on what the one before it kept, and the queries' registration."""

import inspect

import corpus_pipeline
from tessera.llm import catalog, decontam, linededup, neardup, textops, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = textops.documents(spark, SF)
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == columns and 0 < after.count() <= before.count(), name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if k == 0:
            bad = toxicity.toxicity(spark, before, toxicity.train(spark, docs, catalog.labels(spark, SF))).where("is_toxic")
        elif k == 1:
            assert linededup.removed_lines(spark, before).count() > 0
            bad = before.limit(0)
        elif k == 2:
            bad = neardup.groups(spark, before).where("doc_id <> group_id")
        else:
            bad = decontam.contaminated(spark, before, catalog.benchmark(spark, SF)).select("doc_id").distinct()
        assert after.join(bad, "doc_id", "left_semi").count() == 0
        if k != 1:
            assert after.count() == before.join(bad, "doc_id", "left_anti").count()
        before = after
    last = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()}
    assert last == {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == last


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, gone int, __gone int, __id int, __bad int, row int"
LONG = "\n".join(" ".join(f"w{(i * 31 + k * k) % 1999}" for k in range(12)) for i in range(4000))
ITEM = " ".join(f"item{i}" for i in range(30))


def table(*docs):
    return [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 6) for i, t in docs]


def folder(spark, tmp_path, docs, items, labels):
    for name, rows, schema in (("documents", docs, SCHEMA), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_awkward_documents_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    bad = [(100 + i, f"a day like others {i} you utter zoxquav and mirfeltz today {i * 7}") for i in range(30)]
    fine = [(200 + i, f"thing{i} one{i * 3} of{i} the plain{i} texts of the {i} corpus{i * 5}") for i in range(60)]
    docs = table((1, None), (2, ""), (3, " \n\n"), (4, "word"), (4, "word"), (None, "no id here but words"), (5, LONG), (6, LONG), (7, "before " + ITEM + " after"), (8, ITEM.replace("item9 ", "other ").replace("item15 ", "item15\n") + "\nsecond line of it here"), *bad, *fine)
    sf = folder(spark, tmp_path, docs, [(1, ITEM), (2, None), (None, "x y z")], [(i, 1, 1) for i, _ in bad[:20]] + [(i, 1, 0) for i, _ in fine] + [(4, None, None), (None, 1, 1)])
    kept = textops.documents(spark, sf)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, sf).write.parquet(str(tmp_path / f"after{k}"))
        kept = spark.read.parquet(str(tmp_path / f"after{k}"))
        assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen.append(sorted(r.doc_id for r in kept.collect() if r.doc_id is not None))
        assert kept.where("doc_id is null").count() == 1 and {1, 2, 3, 4} <= set(seen[-1]) and seen[-1].count(4) == 2
    toxic, lines, near, clean = map(set, seen)
    assert not toxic & {i for i, _ in bad} and {i for i, _ in fine} <= toxic
    assert toxic - lines == {6}  # every line of it is repeated
    assert near - clean == {7, 8} & near and {7, 8} <= lines
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in last if r.doc_id is not None and r.piece == 0) == seen[-1] and max(r.piece for r in last if r.doc_id == 5) > 0


def test_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, textops.documents(spark, sf), sf).count() == 0


def test_tables_between_stages_go(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    root = Path(urlparse(textops.shared_folder(spark)).path)
    before = {p for p in root.iterdir() if p.name.startswith(("pipeline-", "table-"))}
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {p for p in root.iterdir() if p.name.startswith(("pipeline-", "table-"))} == before


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
