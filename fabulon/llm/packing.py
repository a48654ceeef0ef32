"""Operator 4: length buckets with the least padding, and token-budget batches inside each.

The global histogram has a row for each length that occurs. Documents of d different lengths hold
d * d / 2 tokens at least, so it has at most the square root of twice the corpus' tokens: six
million rows of 16 bytes at 100 TB, and a small part of that unless every length occurs. Dynamic
programming over it picks the bucket boundaries that minimise the padded tokens; every document is
then numbered inside its bucket and cut into batches of at most `budget` padded tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbering inside a bucket is dealt over this many shards for each bucket, so that no bucket meets in one task.
SHARDS = 4096


def token_count(text: Column) -> Column:
    """Tokens of a text, here runs of characters other than white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(tops: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most `buckets` boundaries of the sorted tops with the least sum of boundary * documents.

    Of several best ones the least number of buckets is taken. With total[j] documents up to
    length top[j], the best cost of k buckets up to there is the least of
    cost[k - 1][i] + top[j] * (total[j] - total[i]): for each i a line in top[j], with slopes that
    fall as i grows, so the lower envelope is kept in a queue that is read from one end.
    """
    if not tops:
        return []
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    m = len(tops)
    layer, cuts = [0, *(t * n for t, n in zip(tops, total[1:], strict=True))], [[0] * (m + 1)]
    best_k, best_cost = 1, layer[m]
    for k in range(2, min(buckets, m) + 1):
        new, cut, lines, at = [None] * (m + 1), [0] * (m + 1), [], 0
        for j in range(k, m + 1):
            i = j - 1  # the line of the last cut before j joins
            while len(lines) - at > 1:
                a, b = lines[-2], lines[-1]
                # b is nowhere least if a and i meet before a and b do.
                if (layer[i] - layer[a]) * (total[b] - total[a]) <= (layer[b] - layer[a]) * (total[i] - total[a]):
                    lines.pop()
                else:
                    break
            lines.append(i)
            x = tops[j - 1]
            while len(lines) - at > 1 and layer[lines[at + 1]] - x * total[lines[at + 1]] <= layer[lines[at]] - x * total[lines[at]]:
                at += 1
            i = lines[at]
            new[j], cut[j] = layer[i] + x * (total[j] - total[i]), i
        layer = new
        cuts.append(cut)
        if layer[m] < best_cost:
            best_k, best_cost = k, layer[m]
    out, j = [], m
    for k in range(best_k, 0, -1):
        out.append(int(tops[j - 1]))
        j = int(cuts[k - 1][j])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 32768) -> DataFrame:
    """One row for each row of docs: id, n_tokens, bucket, boundary, batch, padding.

    A null or empty text has 0 tokens and packs like any other; a null id orders first; repeated
    rows are packed each; a text longer than the budget has a batch of its own, whole. Of docs
    only the two columns named are read. An empty table gives an empty result.
    """
    # Through a generator, so that the optimiser does not copy the count into every expression that uses it.
    rows = docs.select(F.col(id_col).alias(id_col), F.explode(F.array(token_count(F.col(text_col)))).alias("n_tokens"))
    histogram = sorted(map(tuple, rows.groupBy("n_tokens").agg(F.count("*")).collect()))  # at most the square root of twice all tokens
    cuts = boundaries([t for t, _ in histogram], [c for _, c in histogram], buckets)
    spark = docs.sparkSession
    place = F.size(F.filter(F.array(*map(F.lit, cuts[:-1] or [2**62])), lambda c: c < F.col("n_tokens")))
    rows = rows.withColumn("bucket", place).withColumn("boundary", F.element_at(F.array(*map(F.lit, cuts or [0])), F.col("bucket") + 1).cast("long"))
    rows = rows.withColumn("_shard", F.pmod(spread_of(id_col), F.lit(SHARDS)).cast("int"))
    sizes = rows.groupBy("bucket", "_shard").agg(F.count("*").alias("_n"))
    # At most buckets * SHARDS rows: small for any corpus, so one window partition for each bucket.
    before = sizes.select("bucket", "_shard", (F.sum("_n").over(Window.partitionBy("bucket").orderBy("_shard")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("bucket", "_shard").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    numbered = rows.withColumn("_row", F.row_number().over(order)).join(F.broadcast(before), ["bucket", "_shard"])
    return numbered.select(
        id_col, "n_tokens", "bucket", "boundary",
        F.floor((F.col("_before") + F.col("_row") - 1) / fits).cast("long").alias("batch"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )


def spread_of(id_col: str) -> Column:
    return F.xxhash64(F.lit(4), F.col(id_col).cast("string"))
