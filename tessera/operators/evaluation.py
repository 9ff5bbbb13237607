"""Retrieval quality: metrics at k, layers, segments, sources, thresholds and tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall", "precision", "mrr", "ndcg", "unique_topics")


def judged(run: DataFrame, judgments: DataFrame) -> DataFrame:
    """The run (query_id, doc_id, rank, ...) with the relevance, 0 if none, and topic of each result."""
    j = judgments.select("query_id", "doc_id", "relevance", *(c for c in ("topic",) if c in judgments.columns))
    out = run.join(j, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    return out if "topic" in out.columns else out.withColumn("topic", F.lit(None).cast("string"))


def _gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def metrics(run: DataFrame, judgments: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Recall, precision, reciprocal rank, NDCG and number of topics at k, for each query (and each `by`).

    A document that a run repeats counts at its first rank. Precision divides by k, however short the run.
    """
    keys = ["query_id", *(by or [])]
    first = run.groupBy(*keys, "doc_id").agg(F.min("rank").alias("rank"))
    rows = judged(first, judgments).where(F.col("rank") <= k)
    hit = F.col("relevance") > 0
    found = rows.groupBy(*keys).agg(
        F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first_hit"), F.sum(_gain(F.col("relevance"), F.col("rank"))).alias("dcg"),
        F.count_distinct(F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic"))).alias("unique_topics"),
    )
    relevant = judgments.where("relevance > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = relevant.withColumn("rank", place).groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("rank") <= k, _gain(F.col("relevance"), F.col("rank")))).alias("idcg"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return found.join(ideal, "query_id", "left").select(
        *keys, share(F.col("hits"), F.col("n_relevant")).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        share(F.col("dcg"), F.col("idcg")).alias("ndcg"), "unique_topics",
    ).withColumn("recall", F.coalesce("recall", F.lit(0.0))).withColumn("ndcg", F.coalesce("ndcg", F.lit(0.0)))


def checked(run: DataFrame, judgments: DataFrame) -> None:
    """A run must have exactly the judged queries; otherwise an error names some that are missing or unknown."""
    have, want = run.select("query_id").distinct(), judgments.select("query_id").distinct()
    for what, rows in (("misses", want.join(have, "query_id", "left_anti")), ("has unknown", have.join(want, "query_id", "left_anti"))):
        some = [r.query_id for r in rows.orderBy("query_id").limit(5).collect()]
        if some:
            raise ValueError(f"the run {what} queries: {some}")


def report(run: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """One row of averages over queries; the topics' average is cut to a whole number."""
    m = metrics(run, judgments, k)
    return m.agg(F.count("*").alias("n_queries"), *(F.avg(c).alias(c) for c in METRICS[:4]), F.floor(F.avg("unique_topics")).cast("int").alias("unique_topics"))


def layers(runs: DataFrame, judgments: DataFrame, k: int, stages: tuple[str, ...] = ("candidates", "reranked", "diversified", "final")) -> DataFrame:
    """Average metrics by stage, in order, each with its change from the stage before. Candidates have recall over all of them."""
    whole = runs.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    at = metrics(runs, judgments, k, ["stage"]) if k > 0 else None
    full = metrics(runs, judgments, max(whole, 1), ["stage"]).select("query_id", "stage", F.col("recall").alias("full_recall"))
    n = runs.groupBy("query_id", "stage").agg(F.count("*").alias("n_results"))
    rows = n.join(full, ["query_id", "stage"])
    rows = rows.join(at, ["query_id", "stage"], "left") if at is not None else rows.select("*", *(F.lit(None).cast("double").alias(c) for c in METRICS))
    order = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage"))
    out = rows.groupBy("stage").agg(F.avg("n_results").alias("n_results"), F.avg("full_recall").alias("full_recall"), *(F.avg(c).alias(c) for c in METRICS)).withColumn("ord", order)
    w = Window.partitionBy(F.lit(1)).orderBy("ord")  # a row for each stage
    for c in ("recall", "ndcg"):
        out = out.withColumn(f"delta_{c}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    return out


def segments(run: DataFrame, judgments: DataFrame, segment: DataFrame, k: int) -> DataFrame:
    """Metrics of each query and segment of the documents (doc_id, segment). The k best are cut first, then split; blank segments don't count."""
    named = segment.where(F.coalesce("segment", F.lit("")) != "").select("doc_id", "segment")
    pair = F.struct("query_id", "segment")
    cut = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k).join(named, "doc_id")
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "segment").orderBy("rank"))).select(pair.alias("query_id"), "doc_id", "rank")
    wanted = judgments.join(named, "doc_id").withColumn("query_id", pair)
    m = metrics(cut, wanted, k)
    counts = judged(cut, wanted).groupBy("query_id").agg(F.count("*").alias("n_results"), F.count_if(F.col("relevance") > 0).alias("n_hits"))
    relevant = wanted.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("n_relevant"))
    every = counts.select("query_id").union(relevant.select("query_id")).distinct()
    out = every.join(counts, "query_id", "left").join(relevant, "query_id", "left").join(m, "query_id", "left").na.fill(0)
    return out.select("query_id.query_id", "query_id.segment", "n_relevant", "n_results", "n_hits", *METRICS)


def failures(averages: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(metric, value, floor) of the averages strictly below their floors, in the fixed order of the metrics."""
    named = [(i, m) for i, m in enumerate(METRICS) if m in floors]
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(floors[m])).alias("floor")) for i, m in named))
    return averages.select(F.explode(pairs).alias("p")).select("p.*").where("value < floor").orderBy("ord")


def by_source(candidates: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """For each query and source of candidates: how many, how many relevant, and metrics at k."""
    n = judged(candidates, judgments).groupBy("query_id", "source").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("relevance") > 0).alias("n_hits"))
    return n.join(metrics(candidates, judgments, k, ["source"]), ["query_id", "source"])


def fixture_problems(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """(problem, query_id, doc_id) of a fixture that can't be evaluated: empty or repeated query ids, judgments without a document, repeated
    ones, with relevance that isn't finite or is negative, and queries without a relevant document. No rows for a sound one."""
    q, j = queries.select("query_id"), judgments.select("query_id", "doc_id", "relevance")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    none = F.lit(None).cast("string")
    found = lambda rows, name, doc=none: rows.select(F.lit(name).alias("problem"), F.col("query_id").cast("string").alias("query_id"), doc.alias("doc_id"))
    doc = F.col("doc_id").cast("string")
    out = found(q.where(blank("query_id")), "empty query id")
    out = out.union(found(q.groupBy("query_id").count().where("count > 1"), "repeated query id"))
    out = out.union(found(j.where(blank("doc_id")), "empty document id", doc))
    out = out.union(found(j.groupBy("query_id", "doc_id").count().where("count > 1"), "repeated judgment", doc))
    out = out.union(found(j.where(F.isnan("relevance") | F.col("relevance").isNull() | (F.abs("relevance") == float("inf")) | (F.col("relevance") < 0)), "relevance", doc))
    out = out.union(found(q.distinct().join(j.where("relevance > 0"), "query_id", "left_anti"), "no relevant document"))
    return out.union(found(j.join(q, "query_id", "left_anti").select("query_id", "doc_id"), "unknown query", doc))


def run_problems(run: DataFrame) -> DataFrame:
    """(problem, query_id, doc_id) of a run whose rows can't be ranked: empty ids, ranks under 1 and ranks that two documents share."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    doc = F.col("doc_id").cast("string").alias("doc_id")
    named = lambda rows, name, d: rows.select(F.lit(name).alias("problem"), F.col("query_id").cast("string").alias("query_id"), d)
    out = named(run.where(blank("doc_id") | blank("query_id")), "empty id", doc)
    out = out.union(named(run.where(F.coalesce(F.col("rank"), F.lit(0)) < 1), "rank", doc))
    shared = run.groupBy("query_id", "rank").agg(F.count_distinct("doc_id").alias("n")).where("n > 1")
    return out.union(named(shared, "shared rank", F.lit(None).cast("string").alias("doc_id")))


def tune_mmr(candidates: DataFrame, judgments: DataFrame, grid: DataFrame, lambdas: list[float], k: int, vector: str = "v", least: dict[str, float] | None = None) -> DataFrame:
    """As tune(), for every weighting with every lambda: candidates (query_id, doc_id, <signal>..., vector) are diversified before they are measured.

    Ties go to smaller weights, then smaller lambdas. Each query's candidates should be a bounded list.
    """
    from .search import mmr

    signals = [c[2:] for c in grid.columns if c.startswith("w_")]
    score = sum((F.coalesce(s, F.lit(0.0)) * F.col(f"w_{s}") for s in signals), F.lit(0.0))
    first = candidates.dropDuplicates(["query_id", "doc_id"])
    scored = first.crossJoin(F.broadcast(grid)).withColumn("score", score)  # the grid is made by hand
    runs = None
    for lam in lambdas:
        keyed = scored.withColumn("key", F.to_json(F.struct("grid_id", "query_id")))
        picks = mmr(keyed, k, lam, by="key", vector=vector).select("key", "doc_id", F.col("mmr_rank").alias("rank"))
        ids = keyed.select("key", "grid_id", "query_id").distinct()
        one = picks.join(ids, "key").select("grid_id", "query_id", "doc_id", "rank", F.lit(float(min(1.0, max(0.0, lam)))).alias("lambda"))
        runs = one if runs is None else runs.union(one)
    m = metrics(runs, judgments, k, ["grid_id", "lambda"]).groupBy("grid_id", "lambda").agg(*(F.avg(c).alias(c) for c in METRICS[:4]), F.floor(F.avg("unique_topics")).cast("int").alias("unique_topics"))
    out = m.join(F.broadcast(grid), "grid_id")
    bad = [F.col(c) < v for c, v in (least or {}).items()]
    out = out.withColumn("rejected", F.lit(False) if not bad else sum((b.cast("int") for b in bad[1:]), bad[0].cast("int")) > 0)
    w = Window.partitionBy(F.lit(1)).orderBy("rejected", *(F.desc(F.round(c, 12)) for c in ("ndcg", "recall", "mrr", "precision", "unique_topics")), *(f"w_{s}" for s in signals), "lambda")  # a row for each setting
    return out.withColumn("place", F.row_number().over(w))


def tune(candidates: DataFrame, judgments: DataFrame, grid: DataFrame, k: int, least: dict[str, float] | None = None) -> DataFrame:
    """Every weighting of a grid (grid_id, w_<signal>...), ranked and measured in one plan, best first.

    candidates: (query_id, doc_id, <signal>...). Those below a least metric are marked as rejected. Order: NDCG, recall,
    reciprocal rank, precision, topics, then smaller weights.
    """
    signals = [c[2:] for c in grid.columns if c.startswith("w_")]
    score = sum((F.coalesce(s, F.lit(0.0)) * F.col(f"w_{s}") for s in signals), F.lit(0.0))
    scored = candidates.crossJoin(F.broadcast(grid)).withColumn("score", score)  # the grid is made by hand
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("grid_id", "query_id").orderBy(F.desc(F.round("score", 12)), "doc_id"))).where(F.col("rank") <= k)
    m = metrics(ranked.select("grid_id", "query_id", "doc_id", "rank"), judgments, k, ["grid_id"]).groupBy("grid_id").agg(*(F.avg(c).alias(c) for c in METRICS))
    out = m.join(F.broadcast(grid), "grid_id")
    bad = [F.col(c) < v for c, v in (least or {}).items()]
    out = out.withColumn("rejected", F.lit(False) if not bad else sum((b.cast("int") for b in bad[1:]), bad[0].cast("int")) > 0)
    w = Window.partitionBy(F.lit(1)).orderBy("rejected", *(F.desc(F.round(c, 12)) for c in ("ndcg", "recall", "mrr", "precision", "unique_topics")), *(f"w_{s}" for s in signals))
    return out.withColumn("place", F.row_number().over(w))
