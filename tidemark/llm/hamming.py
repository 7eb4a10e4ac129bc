"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base

BITS = 64


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, code): bit i of the 64-bit code is set where component i + 1 is above zero.

    Components after the 64th are not looked at; missing, null and NaN components leave their bit clear. A null vector
    has no code.
    """
    v = F.col(embedding)
    bits = [F.when((F.get(v, F.lit(i)) > 0) & ~F.isnan(F.get(v, F.lit(i))), F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long") for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(v.isNotNull(), code).alias("code"))


def segment(code: Column, which: Column | int, width: int) -> Column:
    """The ``which``-th segment of a code as a number."""
    mask = F.lit((1 << width) - 1).cast("long")
    if isinstance(which, int):
        return F.shiftrightunsigned(code, which * width).bitwiseAND(mask)
    out = F.lit(None).cast("long")
    for s in range(BITS // width):
        out = F.when(which == s, segment(code, s, width)).otherwise(out)
    return out


def segment_distance(a: Column, b: Column, which: int, width: int) -> Column:
    return F.bit_count(segment(a.bitwiseXOR(b), which, width))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """The ``k`` rows of ``codes`` (id, code) at the least Hamming distance from every query (id, code).

    Codes are cut into equal segments, and each is indexed by its value. Round r looks up, in every segment, all values
    that differ from the query's in exactly r bits. A code whose nearest segment differs in r bits is met
    in round r, in the first such segment only. After round r every code within segments x (r + 1) - 1 bits has been
    met; a query whose kth distance is no larger is finished, the others go on. The last round leaves nothing out.

    Returns query_id, rank, id, distance; ties go to the smaller id. Equal codes are one entry with its k smallest ids; equal
    queries are searched once. Rows without id or code take no part, repeated rows count once, and fewer than
    ``k`` rows give fewer results. Empty inputs give an empty result.
    """
    width = BITS // segments
    rows = base.stage(codes.where("id is not null and code is not null").select("id", "code").distinct())
    by_code = Window.partitionBy("code").orderBy("id")
    entries = base.stage(rows.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k).groupBy("code").agg(F.collect_list("id").alias("ids")))
    index = base.stage(entries.select("code", "ids", F.posexplode(F.array(*[segment(F.col("code"), s, width) for s in range(segments)])).alias("seg", "value")))
    asked = base.stage(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct())
    active = base.stage(asked.select("q").distinct().withColumn("worst", F.lit(BITS)))  # the kth distance so far
    q, code = F.col("q"), F.col("code")
    order = Window.partitionBy("q").orderBy("distance", "id")
    found, finished = None, []
    for radius in range(width + 1):
        probes = active.select("q", "worst", F.posexplode(F.array(*[segment(q, s, width) for s in range(segments)])).alias("seg", "value")).withColumn("bit", F.lit(-1))
        for _ in range(radius):  # flip one more bit, above the last one flipped
            probes = probes.where(F.col("bit") < width - 1).select("q", "worst", "seg", "value", F.explode(F.sequence(F.col("bit") + 1, F.lit(width - 1))).alias("bit"))
            probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
        probes = probes.select("q", "worst", "seg", "value")
        distances = [segment_distance(q, code, s, width) for s in range(segments)]
        here = F.bit_count(q.bitwiseXOR(code)) <= F.col("worst")  # what is farther than k others is not kept
        for s, d in enumerate(distances):
            here = here & F.when(F.col("seg") > s, d > radius).otherwise(d >= radius)
        # the probes are many more than the rows they are made from, so neither side may be broadcast by its estimate
        met = probes.join(index.hint("merge"), ["seg", "value"]).where(here).select("q", F.explode("ids").alias("id"), F.bit_count(q.bitwiseXOR(code)).alias("distance"))
        if found is not None:
            met = met.unionAll(found)
        best = base.stage(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "id", "distance"))
        covered = segments * (radius + 1) - 1
        state = base.stage(best.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(BITS).alias("worst")))
        done = state.where((F.col("worst") <= covered) & (F.col("worst") < BITS)).select("q") if covered < BITS else state.select("q")
        finished.append(best.join(done, "q", "left_semi"))
        active = base.stage(active.select("q").join(done, "q", "left_anti").join(state, "q", "left").select("q", F.coalesce("worst", F.lit(BITS)).alias("worst")))
        found = best.join(active, "q", "left_semi")
        if not active.head(1):
            break
    results = finished[0]
    for more in finished[1:]:
        results = results.unionAll(more)
    last = Window.partitionBy("query_id").orderBy("distance", "id")
    return asked.join(results, "q").withColumn("rank", F.row_number().over(last)).select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
