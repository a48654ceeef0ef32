"""Entity resolution: retrieval, evidence, rules, scores, gate and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the scoring model and its rules.
WEIGHTS = {"surface": 1.2, "context": 2.0, "partner": 1.5, "temporal": 1.0, "prior": 0.4}
BIAS, SURFACE_FLOOR, CONTAINMENT_FLOOR = -4.0, 0.80, 0.86
LINK, NEW, NEAR_TIE = 0.80, 0.35, 0.05
K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, score) for every query and document that share a term. queries: (query, term), a repeated term counting each time.

    Document lengths and frequencies are aggregates of the postings; only postings of query terms
    meet the queries.
    """
    lengths = posted.groupBy("id").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    asked = queries.groupBy("query", "term").agg(F.count("*").alias("qn"))
    hit = posted.join(asked.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    joined = hit.join(df, "term").join(lengths, "id").crossJoin(F.broadcast(stats)).join(asked, "term")  # stats is one row
    return joined.groupBy("query", "id").agg(F.round(F.sum(part * F.col("qn")), 6).alias("score"))


def top_k(scored: DataFrame, query: str, score: str, id_col: str, k: int = 10) -> DataFrame:
    """The k best of each query, ties by id; the limit is applied in each task before rows move."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), id_col))).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def prefilter(co_presence: Column, temporal: Column, declaration: Column, exact: Column, containment: Column) -> tuple[Column, Column]:
    """Verdict and confidence; hard negatives come before hard positives."""
    block = (co_presence >= 1) | (temporal <= 0)
    force = [(declaration >= 1, 0.98), (exact >= 1, 0.95), (containment >= CONTAINMENT_FLOOR, 0.90)]
    verdict, confidence = F.when(block, "BLOCK"), F.when(block, 0.0)
    for test, value in force:
        verdict, confidence = verdict.when(test, "FORCE_LINK"), confidence.when(test, value)
    return verdict.otherwise("SCORE"), confidence.otherwise(0.0)


def raw_score(features: dict[str, Column], without: tuple[str, ...] = ()) -> Column:
    out = F.lit(BIAS)
    for name, weight in WEIGHTS.items():
        if name not in without:
            value = F.when(features[name] < SURFACE_FLOOR, 0.0).otherwise(features[name]) if name == "surface" else features[name]
            out = out + weight * value
    return out


def probability(raw: Column, platt_a: float = 1.0, platt_b: float = 0.0) -> Column:
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), platt_a * raw + platt_b))
    return 1 / (1 + F.exp(-z))


def gate(candidates: DataFrame, group: str, link: float = LINK, new: float = NEW) -> DataFrame:
    """(group, decision, candidate, n_allowed). candidates: group, candidate, verdict, confidence, probability, position.

    The first forced link in order wins; blocked ones are out; of the rest the most probable one
    links over the threshold unless the runner-up is nearly as probable.
    """
    ok = F.col("verdict") == "SCORE"
    g = candidates.groupBy(group).agg(
        F.min_by(F.when(F.col("verdict") == "FORCE_LINK", F.col("candidate")), F.when(F.col("verdict") == "FORCE_LINK", F.col("position"))).alias("forced"),
        F.max(F.when(ok, F.col("probability"))).alias("best"),
        F.max_by("candidate", F.when(ok, F.struct("probability", -F.col("position")))).alias("best_candidate"),
        F.slice(F.reverse(F.array_sort(F.collect_list(F.when(ok, F.col("probability"))))), 1, 2).alias("two"),
        F.count(F.when(ok, 1)).alias("n_allowed"),
    )
    near = (F.size("two") > 1) & (F.col("two")[0] - F.col("two")[1] < NEAR_TIE)
    decision = F.when(F.col("forced").isNotNull(), "LINK").when(F.col("best").isNull() | (F.col("best") <= new), "NEW").when((F.col("best") >= link) & ~near, "LINK").otherwise("DEFER")
    chosen = F.when(F.col("forced").isNotNull(), F.col("forced")).when(F.col("best") > new, F.col("best_candidate"))
    return g.select(group, decision.alias("decision"), chosen.alias("candidate"), "n_allowed")


def co_presence(mentions: DataFrame, target: str, surface: str, chapter: str, offset: str, window: int = 200) -> DataFrame:
    """Neighbouring mentions of one target under different surfaces in the same chapter, at most `window` apart."""
    w = Window.partitionBy(target).orderBy(chapter, offset)
    m = mentions.withColumn("_s", F.lag(surface).over(w)).withColumn("_c", F.lag(chapter).over(w)).withColumn("_o", F.lag(offset).over(w))
    return m.filter((F.col("_s") != F.col(surface)) & (F.col("_c") == F.col(chapter)) & (F.col(offset) - F.col("_o") <= window)).groupBy(target).agg(F.count("*").alias("n_pairs"), F.min(chapter).alias("first_chapter"))


def conflicting_names(mentions: DataFrame, target: str, key: str, most: int = 4) -> DataFrame:
    return mentions.groupBy(target).agg(F.countDistinct(key).alias("n_names")).filter(F.col("n_names") > most)


def attribute_conflict(facts: DataFrame, target: str, key: str, value: str, exclusive: tuple[str, ...]) -> DataFrame:
    return facts.filter(F.col(key).isin(*exclusive)).groupBy(target, key).agg(F.countDistinct(F.lower(value)).alias("n_values")).filter("n_values > 1")
