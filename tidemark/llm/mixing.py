"""Mixing sources to target weights: hash-random order, prefix sums per source, an exact cut at each budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives each of its words at most so many times.
MAX_EPOCHS = 3


def shares(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources (no_source, source_key, source_size): weight shares of all words, at most ``max_epochs`` times the size.

    Water-filling in closed form: in the order of cap / weight, a source stays at its cap while its cap is below the
    share it would get of what the capped ones before it leave. One row per source: the windows run over the list of
    sources, not over documents.
    """
    by_name, by_ratio = Window.orderBy("no_source", "source_key"), Window.orderBy("ratio", "no_source", "source_key")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    big = "decimal(38,0)"
    place = F.array(*[F.lit(w) for w in weights])
    ranked = (
        sources.withColumn("weight", F.element_at(place, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("given", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("capped", F.col("cap").cast(big) * F.col("weight_left").cast("decimal(18,0)") < F.col("weight").cast("decimal(18,0)") * (F.col("total") - F.col("given")).cast(big))
    )
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    capped_sum = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = ((F.col("total") - capped_sum) * F.col("weight")).cast("double") / open_weight.cast("double")
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("no_source", "source_key", "source_size", "n_docs", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", block_rows: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of every document.

    Input columns: doc_id, text, source; others are ignored, except those named in ``keep`` (carried along). Size is
    the number of words (runs of characters other than ASCII white space; null or empty text: 0). Sources are ordered
    by code point, null last as a source of its own, and weigh 1, 2, 3, repeating. A source's budget is the floor of its
    target: whole epochs of all its documents, then documents in the order of a hash key until the budget is
    spent; the document at the cut gives only the words that are left. Ties of the key are broken by doc_id and size,
    so repeated rows are counted each and reruns agree. An empty table gives an empty result; a source whose texts are
    all empty has target 0.

    A source is cut into blocks of its hash range, so that a hot source is ordered by many tasks; prefix sums
    run within blocks and over block totals. Block length grows with the root of the source's documents, so that
    neither the blocks nor the list of blocks meets in one large task.
    """
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sized = base.stage(docs.select(
        F.col("doc_id"), F.col("source").isNull().alias("no_source"), name.alias("source_key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
    ))
    source = ["no_source", "source_key"]
    targets = base.stage(
        shares(sized.groupBy(*source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_epochs)
        .withColumn("blocks", F.ceil(F.col("n_docs") / F.greatest(F.lit(block_rows), F.ceil(F.sqrt("n_docs")))).cast("long"))
    )
    # the key's first 28 bits place a document in a block of its source's hash range
    place = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    placed = sized.join(F.broadcast(targets) if _few(targets) else targets, source).withColumn("block", F.floor(place * F.col("blocks") / F.lit(float(1 << 28))).cast("long"))
    per_block = placed.groupBy(*source, "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy(*source).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*source, "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy(*source, "block").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("in_block", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*source, "block"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("block_start") - F.col("in_block")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return ordered.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(~F.col("no_source"), F.col("source_key")).alias("source"),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: as many copies of every document as it gives whole times, and at a source's cut a last
    copy with the words that are left (single-spaced). Documents that give no word are not in the mix."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select("doc_id", "text", "source", *[F.col(c).alias(o) for c, o in zip(docs.columns, own, strict=True)])
    planned = mix(named, keep=tuple(own), **options).where("taken > 0").select(*own, "size", "taken")
    copy = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    copies = planned.withColumn("copy", copy).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    text = F.col(own[docs.columns.index("text")])
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") < F.col("size"), first).otherwise(text)
    return copies.select(*[cut.alias(c) if c == "text" else F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


def _few(targets: DataFrame, limit: int = 10_000) -> bool:
    """True if the list of sources is proven short enough to be broadcast; otherwise a join shuffles it."""
    return len(targets.select("no_source").head(limit + 1)) <= limit
