"""Mixing sources to target token counts by entropy balancing.

Main path: DataFrame functions only. Per source s the rates r of its documents minimise
the (bounded) entropy distance from one copy each, under sum(r * size) = target(s); the
solution is an exponential tilt

    r(d) = MOST / (1 + exp(-lambda(s) * size(d) / mean size(s))),      MOST = 2

and lambda(s) is the root of a convex dual's gradient. One distributed Newton iteration
for all sources at once is a join of the (source, size) histogram with the multipliers and
one aggregation by source; a bracket that shrinks with every step keeps them safe and ends
them. Rates become copies 0, 1 or 2 by error feedback from the largest document to the
smallest, inside hash buckets of about BUCKET documents, so that a source with a third of
all rows is dealt out over many tasks. Rows with one id, size and source are one entry with
a multiplicity there, so a flood of repeated or null ids is no hot bucket. What is then
left of a bucket's words is settled by copies that bring it nearer.

Defined results: a null text or one without words has size 0 and takes 0 words; a null
source is a source of its own (last); without rows, or with no word at all, every target
is 0. Repeated rows count as rows and may get different copies. Entries of one size come in
the order of a hash of their id. Long texts count all their words. Nothing but id, text and
source is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few, forget, parts, save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET = 400
CLOSE = 1e-6


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """rank: 0, 1, ... over all rows in the given order, by range partitions and their offsets."""
    n = parts(df.sparkSession)
    dealt = save(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranked")
    rows = dealt.groupBy("part").agg(F.count("*").alias("in_part"))
    # one row for each partition: a bounded window
    before = rows.withColumn("before", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).drop("in_part")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("inside", inside).join(before, "part").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: rank, source_size. target: the water level times the weight, at most `most` times the size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(most))
    first = sources.agg(F.sum("weight").alias("w"), F.sum("source_size").alias("size")).first()
    total = float(first["size"] or 0) * share
    level, capped = (total / first["w"] if first["w"] else 0.0), -1
    while True:  # every turn caps at least one more source
        over = F.col("weight") * level > F.col("top")
        x = sources.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("n"), F.sum(F.when(over, F.col("top"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if x["n"] == capped or not x["w"]:
            break
        capped, level = x["n"], (total - (x["full"] or 0.0)) / x["w"]
    return sources.withColumn("target", F.least(F.col("top"), F.col("weight") * F.lit(level)))


def _rate(tilt: Column, scaled: Column, full: Column) -> Column:
    return F.when(full, F.lit(MOST)).otherwise(F.lit(MOST) / (1 + F.exp(-tilt * scaled)))


def tilts(hist: DataFrame, sources: DataFrame) -> DataFrame:
    """The multiplier of each source by distributed Newton iterations. hist: key, size, n."""
    full = F.col("target") >= F.col("top") * (1 - 1e-12)
    ratio = F.col("target") / F.col("source_size")
    first = F.when(full | (F.col("source_size") == 0), F.lit(0.0)).otherwise(F.log(ratio / (MOST - ratio)))  # exact where all sizes are equal
    state = sources.select("key", "source_size", "target", full.alias("full"), (F.col("source_size") / F.col("n_docs")).alias("mean"), first.alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (full | (F.col("source_size") == 0)).alias("done"))
    state = save(state, "tilts")
    while True:
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("tilt"), z, F.col("full"))
        sums = (
            hist.join(state.filter(~F.col("done")).select("key", "mean", "tilt", "full"), "key")
            .groupBy("key")
            .agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * z * r * (1 - r / MOST)).alias("slope"))
        )
        new = state.join(sums, "key", "left")
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - off / F.col("slope")
        new = new.withColumns({"off": off, "low2": low, "high2": high, "step": step})
        # beyond the bracket, or without a slope: halve the bracket, first by powers of two
        half = F.when(F.col("high2") == 1e6, F.greatest(F.lit(1.0), F.col("low2") * 2)).when(F.col("low2") == -1e6, F.least(F.lit(-1.0), F.col("high2") * 2)).otherwise((F.col("low2") + F.col("high2")) / 2)
        good = F.col("step").isNotNull() & ~F.isnan("step") & (F.col("step") > F.col("low2")) & (F.col("step") < F.col("high2")) & (F.abs(F.col("step") - F.col("tilt")) <= 4 + F.abs(F.col("tilt")))
        close = (F.abs(F.col("off")) <= CLOSE * F.col("target")) | (F.col("high2") - F.col("low2") <= 1e-13 * (1 + F.abs(F.col("tilt"))))
        done = F.col("done") | F.col("off").isNull() | close
        old, state = state, save(new.select("key", "source_size", "target", "full", "mean", F.when(done, F.col("tilt")).when(good, F.col("step")).otherwise(half).alias("tilt"), F.when(done, F.col("low")).otherwise(F.col("low2")).alias("low"), F.when(done, F.col("high")).otherwise(F.col("high2")).alias("high"), done.alias("done")), "tilts")
        forget(old)
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the `keep` expressions' columns, size, source_size, target, rate, copies, taken."""
    sized = save(docs.select(F.col(id_col).alias("id"), *keep, F.col(source_col).alias("source"), _key(F.col(source_col)).alias("key"), words(F.col(text_col)).alias("size")), "sized")
    extra = [c for c in sized.columns if c not in ("id", "source", "key", "size")]
    hist = sized.groupBy("key", "size").agg(F.count("*").alias("n"))
    by_source = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    order = [F.substring("key", 1, 1).desc(), F.col("key")]  # s... before n
    sources = save(targets(ranked(by_source, order)), "sources")
    hist = save(hist, "sizes")
    state = tilts(hist, sources)
    known = state.select("key", "source_size", "target", "tilt", "mean", "full").join(sources.select("key", "n_docs"), "key")
    hashed = F.xxhash64("id", "size")
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), F.col("full")))
    rated = sized.join(few(known), "key").withColumn("rate", rate)  # broadcast, as long as sources are few: no task holds all rows of one
    marks = [c for c in extra if c != "id"]
    entries = rated.groupBy("key", "id", *marks, "size").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("rate", "n_docs", "source_size", "target")])
    bucket = F.pmod(F.xxhash64("id", "size", *marks, F.lit(7)), F.ceil(F.col("n_docs") / BUCKET))
    row = F.struct((-F.col("size")).alias("by"), hashed.alias("tie"), "id", *marks, "size", "rate", "m")
    # dealt anew: else all buckets of a source would stay in the task that the join by source put them in
    dealt = entries.withColumn("bucket", bucket).repartition(parts(docs.sparkSession), "key", "bucket")
    groups = dealt.groupBy("key", "bucket").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    # error feedback: due and given words so far; of m equal rows some take the floor, some the ceiling of their rate
    kind = f"array<struct<row:{groups.schema['rows'].dataType.elementType.simpleString()},copies:bigint>>"
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("given"), F.array().cast(kind).alias("out"))

    def nearest(words_: Column, size: Column) -> Column:
        return F.when(size > 0, F.ceil(words_ / size - 0.5)).otherwise(F.lit(0)).cast("long")

    def feed(acc: Column, x: Column) -> Column:
        due = acc["due"] + x["rate"] * x["size"] * x["m"]
        least = F.floor(x["rate"]) * x["m"]
        more = F.when(x["rate"] > F.floor(x["rate"]), nearest(due - acc["given"] - least * x["size"], x["size"])).otherwise(F.lit(0)).cast("long")
        copies = least + F.greatest(F.lit(0).cast("long"), F.least(x["m"], more))
        return F.struct(due.alias("due"), (acc["given"] + copies * x["size"]).alias("given"), F.concat(acc["out"], F.array(F.struct(x.alias("row"), copies.alias("copies")))).alias("out"))

    def settle(acc: Column, x: Column) -> Column:
        size = x["row"]["size"]
        copies = F.greatest(F.lit(0).cast("long"), F.least((x["row"]["m"] * int(MOST)).cast("long"), x["copies"] + nearest(acc["left"], size)))
        return F.struct((acc["left"] - (copies - x["copies"]) * size).alias("left"), F.concat(acc["out"], F.array(F.struct(x["row"].alias("row"), copies.alias("copies")))).alias("out"))

    fed = groups.withColumn("fed", F.aggregate("rows", start, feed))
    start = F.struct((F.col("fed.due") - F.col("fed.given")).alias("left"), F.array().cast(kind).alias("out"))
    rows = fed.select("source_size", "target", F.explode(F.aggregate("fed.out", start, settle)["out"]).alias("x")).select("source_size", "target", "x.row", "x.copies")
    # each of the m rows of an entry: the copies, dealt out evenly
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row.m") - 1)))
    copies = F.floor((F.col("copies") + F.col("row.m") - 1 - F.col("k")) / F.col("row.m")).cast("int")
    rows = rows.select("row", "source_size", "target", copies.alias("copies"))
    return rows.select(F.col("row.id").alias("doc_id"), *[F.col(f"row.{c}").alias(c) for c in marks], F.col("row.size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), F.col("row.rate").alias("rate"), "copies", (F.col("copies") * F.col("row.size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs. Rows with the same id and text share the larger number of copies."""
    mark = F.xxhash64(F.col(text_col)).alias("mark")
    copies = mix(docs, id_col, text_col, source_col, keep=(mark,)).groupBy("doc_id", "mark").agg(F.max("copies").alias("copies")).filter("copies > 0").select(F.col("doc_id").alias("mix_id__of_mix"), F.col("mark").alias("mix_mark__of_mix"), F.col("copies").alias("mix_copies__of_mix"))
    out = docs.join(copies, docs[id_col].eqNullSafe(copies["mix_id__of_mix"]) & (F.xxhash64(docs[text_col]) == copies["mix_mark__of_mix"]))
    return out.withColumn("mix_copy__of_mix", F.explode(F.sequence(F.lit(1), F.col("mix_copies__of_mix")))).select(*[docs[c] for c in docs.columns])
