"""Importance resampling towards a target distribution, by position tables of n-grams.

Words are exploded with their positions; for orders above one a window over each document
leads the following words to every position, which concatenates the n-grams.  Features are
hashed to buckets, whose counts over the raw and the target texts give each bucket a gain, a
log ratio; the gains are joined back and averaged over a document's features.  Documents are
drawn without replacement by their weight and Gumbel noise made of their id, so a draw is a
top list that any run finds again.

Only counts, at most one row of a bucket and task, and one small row of each document are
shuffled; texts are dealt, once, only where orders above one are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import indexed
from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but letters and digits.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """Runs of letters, digits and all that isn't ASCII, in lower case as far as it is."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def position_table(rows: DataFrame, text: str, orders: int, buckets: int) -> DataFrame:
    """The columns of ``rows`` but its text, n_words, and bucket: a row for each feature, and one with a null bucket where there is none.

    With orders above one, ``rows`` have a column row that tells them apart.
    """
    rest = [c for c in rows.columns if c != text]
    if orders > 1:
        rows = rows.repartition("row")  # the explosion keeps it, so the window moves nothing
    listed = rows.select(*rest, words(rows[text]).alias("__words")).withColumn("n_words", F.size("__words").cast("long"))
    table = listed.select(*rest, "n_words", F.posexplode_outer("__words").alias("__pos", "__word"))
    if orders == 1:
        feature = F.col("__word")
    else:
        following = Window.partitionBy("row").orderBy("__pos")
        ahead = [F.col("__word"), *(F.lead("__word", n).over(following) for n in range(1, orders))]
        table = table.select(*rest, "n_words", *(a.alias(f"__{n}") for n, a in enumerate(ahead)))
        grams = [F.when(F.col(f"__{n}").isNotNull(), F.concat_ws(" ", *(f"__{m}" for m in range(n + 1)))) for n in range(orders)]
        table = table.select(*rest, "n_words", F.explode_outer(F.filter(F.array(*grams), lambda g: g.isNotNull())).alias("__gram"))
        feature = F.col("__gram")
    return table.select(*rest, "n_words", (F.crc32(feature.cast("binary")) % buckets).alias("bucket"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket with features, from two position tables: at most ``buckets`` rows."""
    count = lambda t, name: t.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    both = checkpointed(count(raw, "s").join(count(target, "t"), "bucket", "full").na.fill(0, ["s", "t"]))
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    real = lambda c: (c + 1).cast("double")
    ratio = real(F.col("t")) * F.lit(float(s + buckets)) / (real(F.col("s")) * F.lit(float(t + buckets)))
    return both.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def resample(documents: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_features, weight, score, and rank among those drawn (null for others).

    Features are all runs of 1 to ``orders`` words; a bucket's gain is floor(1000 * ln) of its
    smoothed share of the target's features over that of the documents'.  weight is the floored
    mean of the gains, 0 without features.  score adds floor(1000 * Gumbel noise) made of sha256
    of ``seed:id``.  Of the N documents with ``least_words`` words, floor(percent * N / 100) of
    the highest scores are drawn; ties go to the smaller id, then to fewer features.

    A null text counts as empty, and so does a null id in the noise (it comes last in ties).
    Rows that share an id are documents of their own, with the same noise; repeated rows are
    alike but for their ranks.  Texts of any length are read whole.  Empty tables give no rows;
    an empty target leaves gains to the documents' counts alone.  Other columns aren't read.
    """
    # a row's number needn't be the same in another pass: it groups within one
    rows = documents.select(F.monotonically_increasing_id().alias("row"), documents[id_col].cast("long").alias("id"), documents[text_col].alias("text"))
    aims = target.select(F.monotonically_increasing_id().alias("row"), target[target_col].alias("text"))
    table = position_table(rows, "text", orders, buckets)
    known = gains(table, position_table(aims, "text", orders, buckets), buckets)
    # one row of a bucket at most
    joined = table.join(F.broadcast(known), "bucket", "left")
    each = joined.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = checkpointed(each.select("row", "id", "n_features", weight.alias("weight"), noise.alias("noise"), (F.col("n_words") >= least_words).alias("able")))
    n_able = scored.where("able").count()
    score = (F.col("weight") + F.col("noise")).cast("long")
    ordered = scored.withColumn("score", score).orderBy(F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), "n_features", "row")
    placed = indexed(checkpointed(ordered), "place")
    rank = F.when(F.col("able") & (F.col("place") < percent * n_able // 100), F.col("place") + 1)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))
