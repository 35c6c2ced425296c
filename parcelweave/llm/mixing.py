"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

The mix is cut into blocks of equal words. Blocks go to sources by the highest quotients target / (2k - 1), and a
source's blocks go to its shards in the same way, by their sizes. A shard lists its documents in a seeded order and the
mix takes its first blocks, going round a second time where the quota is larger than the shard.

A block holds at most 128 words, and fewer if the smallest target would else be a few blocks only, so that no source is
rounded roughly or to none; one rule serves all sources, as only seats near a quota are ranked, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.llm.frames import materialize, text_digest

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 128
# The smallest target is cut into about so many blocks, or into words.
SMALL_BLOCKS = 8
# A shard holds about so many words, so that no window sorts more; beyond the most shards a source may have, they grow.
SHARD_WORDS = 65_536
MAX_SHARDS = 100_000
SEED = 42

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _seats(votes: DataFrame, group: list[str], item: str) -> DataFrame:
    """Sainte-Lague seats of each item: columns `group`, `item`, `votes` (> 0) and `n`, the seats of the group.

    Only seats near an item's quota are ranked. If S items share n seats, the final divisor lies within S / 2n of the
    mean, so an item of share p ends within p * S / 2 + 1 of its quota: seats below are sure, seats above are out of
    reach, and some 4 S rows are ranked however many seats there are.
    """
    whole = Window.partitionBy(*group)
    near = votes.withColumns({"_all": F.sum("votes").over(whole), "_items": F.count("*").over(whole)})
    near = near.withColumns({
        "_quota": F.col("n") * F.col("votes") / F.col("_all"),
        "_reach": F.col("votes") / F.col("_all") * F.col("_items") / 2 + 1})
    near = near.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_quota") - F.col("_reach"))).cast("long"))
    near = near.withColumn("_left", F.col("n") - F.sum("_sure").over(whole))
    tried = near.withColumn("_k", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.sequence(
        F.col("_sure") + 1, F.ceil(F.col("_quota") + F.col("_reach")).cast("long")))))
    ranked = tried.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(
        (F.col("_k") == 0), (F.col("votes") / (2 * F.col("_k") - 1)).desc(), F.col(item))))
    won = F.sum(F.when((F.col("_k") > 0) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    return ranked.groupBy(*group, item).agg((F.first("_sure") + won).alias("seats"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, target, block, blocks, shards) for each source of (source, size).

    Targets fill the share of all words by weight up to the most repeats of a source; the level is found from running
    sums in the order of cap / weight, which is where repeated resharing ends. The windows run over one row a source.
    """
    by_name = Window.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy("one").orderBy("_full", "rank")
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    table = table.withColumn("rank", F.row_number().over(by_name))
    weights = F.array(*map(F.lit, WEIGHTS))
    table = table.withColumns({
        "_weight": F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")),
        "_cap": F.col("source_size") * MOST_REPEATS, "_mix": F.sum("source_size").over(Window.partitionBy("one")) * SHARE})
    table = table.withColumn("_full", F.col("_cap") / F.col("_weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = table.withColumn("_level", (F.col("_mix") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                             / F.sum("_weight").over(onward))
    whole = Window.partitionBy("one")
    table = table.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(whole))
    table = table.withColumns({
        "target": F.least(F.col("_cap").cast("double"), F.col("_weight") * F.col("_level"))})
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    block_words = F.coalesce(F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(least / SMALL_BLOCKS))), F.lit(BLOCK_WORDS))
    table = table.withColumn("_n", F.greatest(F.lit(1), F.round(F.col("_mix") / block_words)).cast("long"))
    table = materialize(table.withColumn("block", F.col("_mix") / F.col("_n")), "mix-sources")
    seats = _seats(table.where("target > 0").select("one", "rank", F.col("target").alias("votes"), F.col("_n").alias("n")),
                   ["one"], "rank")
    return table.join(seats, ["one", "rank"], "left").select(
        "source", "rank", "source_size", "target", "block", F.coalesce("seats", F.lit(0)).alias("blocks"),
        F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int").alias("shards"))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns, a seeded place and a shard; a null source is a source.

    The place is drawn from the id and the text, so that rows of one id, or without one, spread over the shards.
    """
    named = sources.withColumnRenamed("source", "_source")
    place = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              "digest").cast("binary"))
    return rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source").withColumn(
        "_place", place).withColumn(
        "shard", F.conv(F.substring("_place", 1, 8), 16, 10).cast("long") % F.col("shards"))


def mix(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` (doc_id, source, size, digest, ...) that hold words, with `source_size`, `target`, `taken`, `first_pass`, `second_pass`.

    `sizes` holds the same documents' (doc_id, source, size, digest) as a stored table, `digest` one of the text.
    `taken` counts the words the mix takes of a document, repeats counted: all of them once or twice, none, or the
    leading part where a quota ends inside it. Rows of one id and text are alike: which of them is taken is open, how
    many words is not. Empty input gives an empty result.
    """
    return _taken(rows, sizes, materialize(source_targets(sizes), "mix-targets"))


def _taken(rows: DataFrame, sizes: DataFrame, sources: DataFrame) -> DataFrame:
    cells = _placed(sizes.where("size > 0"), sources).groupBy("rank", "shard").agg(
        F.sum("size").alias("votes"), F.first("blocks").alias("n"), F.first("block").alias("block"))
    cells = materialize(cells, "mix-cells")
    quotas = cells.join(_seats(cells.select("rank", "shard", "votes", "n"), ["rank"], "shard"), ["rank", "shard"]).select(
        "rank", "shard", F.col("votes").alias("_held"),
        F.least(F.round(F.col("seats") * F.col("block")).cast("long"), F.col("votes") * MOST_REPEATS).alias("_quota"))
    order = Window.partitionBy("rank", "shard").orderBy("_place", "size")
    placed = _placed(rows.where("size > 0"), sources).withColumn("_before", F.sum("size").over(order.rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("size"))

    def part(of: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), of - F.col("_before"))).cast("long")

    out = placed.join(quotas, ["rank", "shard"], "left").withColumns({
        "_quota": F.coalesce("_quota", F.lit(0)), "_held": F.coalesce("_held", F.lit(0))}).withColumns({
            "first_pass": part(F.col("_quota")), "second_pass": part(F.col("_quota") - F.col("_held"))})
    return out.withColumn("taken", F.col("first_pass") + F.col("second_pass")).drop(
        "rank", "shard", "shards", "block", "blocks", "_place", "_before", "_quota", "_held", "digest")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
                       F.lower(F.hex(text_digest(text))).alias("digest"))


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document.

    Documents without words take none and are ranked nowhere; a source without words has target 0.
    """
    sizes = materialize(sized(docs, doc_id, source, text), "mix-sizes")
    sources = materialize(source_targets(sizes), "mix-targets")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    blank = _placed(sizes.where("size = 0"), sources).withColumn("taken", F.lit(0).cast("long"))
    return _taken(sizes, sizes, sources).select(names).unionByName(blank.select(names))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each taken document with all its columns, once for each time it is taken.

    A document that a quota cuts keeps its leading words, joined by one space; all other texts stay as they are.
    """
    sizes = materialize(sized(docs, doc_id, source, text), "mix-sizes")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
                       F.lower(F.hex(text_digest(text))).alias("digest"), F.col(text).alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_rest"))
    out = mix(rows, sizes).withColumn("_words", F.explode(F.array("first_pass", "second_pass"))).where("_words > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)), 1, F.col("_words").cast("int")), " ")
    whole = F.when(F.col("_words") == F.col("size"), F.col("_text")).otherwise(cut)
    return out.select(*[whole.alias(c) if c == text else F.col("_rest")[c].alias(c) for c in docs.columns])


# The same mix for DuckDB; every seat is ranked there.
CHECK_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS place
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sizes GROUP BY source),
capped AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS mix
  FROM named),
leveled AS (
  SELECT *, (mix - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM capped),
filled AS (
  SELECT *, least(cap::DOUBLE, weight * (SELECT max(lvl) FROM leveled WHERE lvl <= cap / weight)) AS target FROM leveled),
blocked AS (
  SELECT *, greatest(1, round(mix / coalesce(least({BLOCK_WORDS}, greatest(1, floor(
    (min(target) FILTER (WHERE target > 0) OVER ()) / {SMALL_BLOCKS}))), {BLOCK_WORDS})))::BIGINT AS n
  FROM filled),
targets AS (
  SELECT source, rank, source_size, target, n, mix / n AS block,
    least({MAX_SHARDS}, greatest(1, ceil(source_size / {SHARD_WORDS})))::BIGINT AS shards
  FROM blocked),
source_seats AS (
  SELECT rank, count(*) AS blocks FROM (
    SELECT rank, n, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) AS place FROM (
      SELECT rank, n, target, unnest(range(1, n + 1)) AS k FROM targets WHERE target > 0))
  WHERE place <= n GROUP BY rank),
placed AS (
  SELECT s.*, t.* EXCLUDE (source), ('0x' || substr(place, 1, 8))::BIGINT % shards AS shard
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cells AS (
  SELECT rank, shard, sum(size)::BIGINT AS held, any_value(block) AS block, coalesce(any_value(blocks), 0) AS n
  FROM placed LEFT JOIN source_seats USING (rank) GROUP BY rank, shard HAVING sum(size) > 0),
cell_seats AS (
  SELECT rank, shard, count(*) AS seats FROM (
    SELECT rank, shard, n, row_number() OVER (PARTITION BY rank ORDER BY held / (2 * k - 1) DESC, shard) AS place FROM (
      SELECT rank, shard, n, held, unnest(range(1, n + 1)) AS k FROM cells WHERE n > 0))
  WHERE place <= n GROUP BY rank, shard),
quotas AS (
  SELECT rank, shard, held, least(round(coalesce(seats, 0) * block)::BIGINT, 2 * held) AS quota
  FROM cells LEFT JOIN cell_seats USING (rank, shard)),
run AS (
  SELECT p.*, coalesce(q.held, 0) AS held, coalesce(q.quota, 0) AS quota,
    sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY place, size ROWS UNBOUNDED PRECEDING) - size AS gone
  FROM placed p LEFT JOIN quotas q USING (rank, shard))
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, quota - gone)) + greatest(0, least(size, quota - held - gone)))::BIGINT AS taken
FROM run
"""
