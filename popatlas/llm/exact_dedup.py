"""Exact dedup: heavy hitters are removed map-side, the rest by an ordinary shuffle.

A frequent-items sketch of Misra-Gries counters (``tracked`` counters a task, merged as a
tree) names the digests that may be frequent. Their winners are found by exact counts and
broadcast, at most ``tracked`` rows; a row with such a digest then gets its answer where it
is read. All other digests are shuffled. The sketch misses only groups below about
4 / ``tracked`` of the rows, so no reducer gets more than that of one text; the answers
do not depend on what it names.

Null texts count as empty. Of rows with equal text the largest ``doc_id`` stays (null ids
are smaller than all others); of repeated rows with that id, one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popatlas.llm.common import ascii_lower, fresh, settled, utf8, whole_text
from popatlas.plans.storage import stored

TRACKED = 4096
FAN_IN = 256


def frequent_keys(df: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """At most ``tracked`` values of the long column ``key``, with every frequent one."""
    fan = F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("fan")
    merged = (
        df.select(F.col(key).alias("k"), fan)
        .groupBy("fan")
        .agg(F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("s"))
        .groupBy(F.lit(0).alias("all"))  # keyed: empty partitions send no sketch, which none can merge
        .agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    )
    found = merged.select(F.expr(f"inline(approx_top_k_estimate(s, {tracked}))"))
    return found.where("item is not null").select(F.col("item").alias(key)).distinct()


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digest = F.unhex(F.sha2(utf8(ascii_lower(whole_text(text_col))), 256))
    rows = settled(
        docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    ).withColumn("key", F.xxhash64("digest"))
    best = F.struct("doc_id", "row")
    candidates = frequent_keys(rows, "key", tracked)
    winners = (
        rows.join(F.broadcast(candidates), "key", "left_semi")
        .groupBy("digest")
        .agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    # Two digests of one 64-bit key are as good as impossible, yet the bound holds for keys.
    winners = stored(winners, "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti").select(
        "*", F.max(best).over(group).alias("best"), F.count("*").over(group).alias("group_size")
    )
    columns = ["doc_id", "row", "digest", "best", "group_size"]
    return (
        hot.select(columns)
        .unionByName(rest.select(columns))
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED
) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, all columns kept.

    The list of dropped ids grows with the input, so it is joined by a shuffle at every
    size, each task hashing its share of the list; rows are neither sorted nor broadcast.
    Where an id occurs more than once among them (repeated rows), those few rows are told
    apart by their text.
    """
    ids = exact_groups(docs, id_col, text_col, tracked)
    tally = (
        ids.where((F.col("group_size") > 1) | F.col("doc_id").isNull())
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("any_kept"), F.count("*").alias("copies"))
        .where(~F.col("any_kept") | (F.col("copies") > 1))
    )
    tally = stored(tally, "dropped").hint("shuffle_hash")
    digest = F.sha2(utf8(ascii_lower(whole_text(text_col))), 256)
    sha, gone, gone_sha = fresh(docs, "_sha", "_gone", "_gone_sha")
    once = docs.withColumn(sha, digest)
    same = F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(sha) == F.col(gone_sha))
    tally = tally.withColumnsRenamed({"doc_id": gone, "text_sha256": gone_sha})
    out = once.join(tally, same, "left_anti").select(docs.columns)
    repeated = tally.where("any_kept")
    if repeated.isEmpty():
        return out
    more = once.join(repeated, same, "left_semi").dropDuplicates([id_col, sha])
    return out.unionByName(more.select(docs.columns))
