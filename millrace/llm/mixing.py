"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: every source's share of the total goes by weight, but no target
exceeds ``repeats`` times its source; the excess is shared out again by weight
until none is above (one sort of the sources by cap per weight).

Quotas: the mix is handed out in blocks of ``block_words`` words. Sources get
blocks by highest quotients target / (2k + 1); within a source, shards of about
``shard_words`` words get the source's blocks the same way, in whole numbers.
Only quotients near the last winner are laid out (about two per party), never
one row per block.

Selection: a shard's documents, in an order seeded by ``seed`` and the id, are
one stream of equal blocks. A quota of q blocks takes the stream q // n times
in full and the first q % n of its n blocks once more, so at most one document
of a shard is cut. A hot source has many shards; no task sees more than one.

Defined results: null or empty text has size 0 and takes 0; a null source is a
source, the last; ids may be null or repeat (equal rows of one id and size are
interchangeable); an empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, written

BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SHARD_DOCS = 100_000


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """``parties`` with ``out``: each one's share of its group's ``seats`` by highest quotients votes / (2k + 1).

    Ties go by ``key``. A party's seats lie between its rounded shares at the
    divisors that surely give too few and too many, so only those quotients compete.
    """
    w = W.partitionBy(*group)
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    n, total = F.count(F.lit(1)).over(w), F.sum(v).over(w)
    share = lambda blocks: F.when(F.col("_total") > 0, F.floor(v * blocks / F.col("_total") + 0.5)).otherwise(F.lit(0))
    spread = parties.withColumn("_n", n).withColumn("_total", total)
    low = F.greatest(F.lit(0), share(s - F.col("_n") / 2) - 1).cast("long")
    high = F.greatest(F.lit(0), share(s + F.col("_n") / 2) + 1).cast("long")
    spread = spread.withColumn("_low", low).withColumn("_high", F.when(v > 0, F.greatest(high, F.col("_low"))).otherwise(F.col("_low")))
    spread = spread.withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    candidate = spread.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
    order = [(v / (2 * F.col("_k") + 1)).desc(), *(F.col(k) for k in key), F.col("_k")]
    won = (F.row_number().over(w.orderBy(*order)) <= F.col("_left")) & (v > 0)
    cols = parties.columns
    summed = candidate.withColumn("_won", won.cast("long")).groupBy(*cols, "_low").agg(F.sum("_won").alias("_more"))
    return summed.select(*cols, (F.col("_low") + F.col("_more")).alias(out))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(key, source_size, n_docs, weight, target, capped) per source: one row per source, sorted once in one task."""
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("key")["unknown"], F.col("key")["name"])
    weight = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    rows = totals.withColumn("weight", weight.cast("double")).withColumn("_at", F.row_number().over(by_name))
    cap = (F.col("source_size") * repeats).cast("double")
    rows = rows.withColumn("_cap", cap).withColumn("_total", F.sum("source_size").over(every).cast("double"))
    by_cap = every.orderBy(F.col("_cap") / F.col("weight"), "_at")
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_total") - before) / rest).withColumn("_rank", F.row_number().over(by_cap))
    rows = rows.withColumn("capped", F.col("_cap") / F.col("weight") <= F.col("_level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("_level")), F.when(~F.col("capped"), F.col("_rank"))).over(every)
    target = F.when(F.col("capped"), F.col("_cap")).otherwise(F.col("weight") * level)
    return rows.select("key", "source_size", "n_docs", "weight", target.alias("target"), "capped")


def size_of(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (),
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, shard, taken, and ``row``, a struct of the columns in ``keep``.

    Sources are weighed by ``weights`` in turn, in code point order, null last; their shares add up to all words.
    """
    key = F.struct(F.col(source_col).isNull().alias("unknown"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    base = docs.select(F.col(id_col).alias("id"), key.alias("key"), size_of(F.col(text_col)).alias("size"), mark.alias("mark"), *([F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []))
    sizes = written(base.select("id", "key", "size", "mark"), "mix-sizes")
    rows = base if keep else sizes

    sources = source_targets(sizes, weights, repeats)
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / SHARD_DOCS)).cast("long")
    sources = written(sources.withColumn("shards", shards_of), "mix-sources")
    free = sources.where("not capped").withColumn("_seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words).cast("long"))
    quotas = apportion(free.select("key", "target", "_seats"), ["_seats"], ["key"], "target", "_seats", "blocks").select("key", "blocks")
    plan = sources.join(quotas, "key", "left")

    shard = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.col("shards")
    sharded = sizes.join(sources.select("key", "shards"), "key").withColumn("shard", shard)
    parts = sharded.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).join(plan.select("key", "capped", "blocks"), "key")
    parts = parts.withColumn("_blocks", F.ceil(F.col("shard_size") / block_words).cast("long"))
    given = apportion(parts.where("not capped").select("key", "shard", "shard_size", "_blocks", "blocks"), ["key", "blocks"], ["shard"], "shard_size", "blocks", "_quota")
    quota = given.select("key", "shard", "shard_size", "_blocks", F.least("_quota", F.col("_blocks") * repeats).alias("quota"))
    quota = quota.unionByName(parts.where("capped").select("key", "shard", "shard_size", "_blocks", (F.col("_blocks") * repeats).alias("quota")))
    quota = quota.select("key", "shard", F.when(F.col("_blocks") > 0, F.expr("quota div _blocks")).otherwise(0).alias("full"), F.when(F.col("_blocks") > 0, (F.col("quota") % F.col("_blocks")) * block_words).otherwise(0).alias("extra"))

    stream = W.partitionBy("key", "shard").orderBy("mark", "id", "size")
    placed = rows.join(sources.select("key", "source_size", "target", "shards"), "key").withColumn("shard", shard)
    placed = placed.withColumn("_end", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0))).join(quota, ["key", "shard"])
    start = F.col("_end") - F.col("size")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("_end"), F.col("extra")) - start)
    source = F.when(~F.col("key")["unknown"], F.col("key")["name"])
    return placed.select(F.col("id").alias(id_col), source.alias(source_col), "size", "source_size", "target", "shard", (F.col("full") * F.col("size") + more).cast("long").alias("taken"), *(["row"] if keep else []))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = 0, text_col: str = "text", **more) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken t times in full is t rows, and one whose next
    blocks are taken in part adds a row with the words taken. ``n_chars``, if there, follows the text."""
    mixed = mix(docs, weights, repeats, seed, text_col=text_col, keep=tuple(docs.columns), **more)
    copies = mixed.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_copy") - 1) * F.col("size"))
    text = F.col("row")[text_col]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), words.cast("int")), "")
    whole = words == F.col("size")
    copies = copies.withColumn("_text", F.when(whole, text).otherwise(cut))
    out = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("row")["n_chars"]).otherwise(F.char_length("_text").cast(docs.schema["n_chars"].dataType))
    return copies.select(*(out[c].alias(c) for c in docs.columns))
