"""The ingest pass as a micro-batch: search, sightings, details, prices, delisting and bookkeeping, published as one.

A pass takes the state of listings and a batch of sightings and gives the state after it. All tables of a pass come out
with one version of the published store, which also names the last batch that is in it, so a batch that is run again
after a loss, at whatever step, changes nothing that is there and misses nothing that isn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources import publish
from marketlens.scratch import folder, stage

LISTINGS = "id long, price long, title string, first_seen timestamp_ntz, last_seen timestamp_ntz, is_active int, delisted_at timestamp_ntz, detailed_at timestamp_ntz"
PRICES = "listing_id long, price long, observed_at timestamp_ntz, batch long"
RUNS = "batch long, started_at timestamp_ntz, ended_at timestamp_ntz, seen long, new long, revived long, price_changes long, details long, active long, unseen long, delisted long, uncovered array<string>, blocked string"


@dataclass
class Rules:
    """What a pass may do: details it reads, days a listing may be unseen, and the share of active ones that may go."""

    details: int = 4500
    days: int = 3
    most_gone: float = 0.3
    shards: tuple[str, ...] = ()


def ingest_pass(listings: DataFrame, batch: DataFrame, pages: DataFrame, number: int, rules: Rules) -> dict[str, DataFrame]:
    """The tables after a pass: listings, and what is added to prices and runs.

    ``batch`` has id, price, at, shard and ok; a row that is not ok is a failed page, which has no listing. ``pages`` has id and
    title. A listing is new at its first sighting; a known one is revived. A price that is seen and differs makes a point.
    Active listings without details get them, longest known first, ``rules.details`` at most. What was unseen for days is
    delisted, but only if every shard of ``rules.shards`` was seen without a failure, and if no more than a share would go.
    """
    batch = stage(batch.select("id", F.col("price").cast("long").alias("price"), F.col("at").cast("timestamp_ntz").alias("at"), "shard", "ok"), "batch")
    seen = batch.where("ok and id is not null").groupBy("id").agg(
        F.min("at").alias("from"), F.max("at").alias("to"), F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("at", "price"))).alias("seen_price")
    )
    ends = batch.agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at")).first()
    now = F.lit(ends.ended_at).cast("timestamp_ntz")

    # Sightings and prices: one full outer join of the state with what was seen.
    o, n = listings.alias("o"), seen.alias("n")
    hit, known = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()
    changed = hit & F.col("seen_price").isNotNull() & ~F.col("o.price").eqNullSafe(F.col("seen_price"))
    merged = o.join(n, F.col("o.id") == F.col("n.id"), "full").select(
        F.coalesce("o.id", "n.id").alias("id"),
        F.coalesce(F.when(hit, F.col("seen_price")), F.col("o.price")).alias("price"),
        "o.title",
        F.coalesce("o.first_seen", "n.from").alias("first_seen"),
        F.coalesce("n.to", "o.last_seen").alias("last_seen"),
        F.when(hit, 1).otherwise(F.col("o.is_active")).alias("is_active"),
        F.when(~hit, F.col("o.delisted_at")).alias("delisted_at"),
        "o.detailed_at",
        changed.alias("_changed"),
        (hit & ~known).alias("_new"),
        (hit & known & (F.col("o.is_active") == 0)).alias("_revived"),
    )
    merged = stage(merged, "merged")

    # Details: the queue is as short as the rule says, so it is ordered by each task's best alone.
    queue = merged.where("is_active = 1 and detailed_at is null").join(pages.select("id"), "id", "left_semi").orderBy("first_seen", "id").limit(rules.details)
    details = queue.select("id").join(pages.select("id", F.col("title").alias("_title")), "id").groupBy("id").agg(F.min("_title").alias("_title")).withColumn("_read", F.lit(True))
    merged = stage(merged.join(details, "id", "left").withColumns({"title": F.coalesce("_title", "title"), "detailed_at": F.when(F.col("_read"), now).otherwise(F.col("detailed_at"))}).drop("_title"), "detailed")

    # Delisting, if the pass has seen all and not too much would go.
    shards = batch.groupBy("shard").agg(F.bool_and("ok").alias("whole"))
    whole = {r.shard for r in shards.where("whole").collect()}  # shards are a short list
    uncovered = sorted(set(rules.shards) - whole)
    unseen = (F.col("is_active") == 1) & (F.col("last_seen") < now - F.expr(f"interval {rules.days} days"))
    counts = merged.agg(
        F.count_if(F.col("is_active") == 1).alias("active"), F.count_if(unseen).alias("unseen"), F.count_if("_new").alias("new"), F.count_if("_revived").alias("revived"), F.count_if("_changed").alias("price_changes"), F.count_if("_read").alias("details")
    ).first()
    share = counts.unseen / counts.active if counts.active else 0.0
    blocked = "shards are missing" if uncovered else "too many would go" if share > rules.most_gone else None
    go = unseen if blocked is None and ends.ended_at is not None else F.lit(False)
    after = merged.withColumns({"delisted_at": F.when(go, now).otherwise(F.col("delisted_at")), "is_active": F.when(go, 0).otherwise(F.col("is_active"))})

    spark = listings.sparkSession
    points = merged.where("_changed").select(F.col("id").alias("listing_id"), "price", F.col("last_seen").alias("observed_at"), F.lit(number).cast("long").alias("batch"))
    run = (number, ends.started_at, ends.ended_at, seen.count(), counts.new, counts.revived, counts.price_changes, counts.details, counts.active, counts.unseen, None if blocked else counts.unseen, uncovered, blocked)
    names = [x.strip().split()[0] for x in LISTINGS.split(",")]
    return {"listings": after.select(*names), "prices": points, "runs": spark.createDataFrame([run], RUNS)}


def apply(root: str, batch: DataFrame, number: int, pages: DataFrame, rules: Rules, step: Callable[[str], None] = lambda _: None) -> bool:
    """Bring a batch into the store, unless it is in it: whether that was needed."""
    spark = batch.sparkSession
    before = publish.newest(spark, root)
    if before is not None and before.meta["batch"] >= number:
        return False
    listings = before.tables["listings"] if before else spark.createDataFrame([], LISTINGS)
    step("begun")
    after = ingest_pass(listings, batch, pages, number, rules)
    publish.publish(spark, root, {"listings": after["listings"]}, {"prices": after["prices"], "runs": after["runs"]}, {"batch": number}, step=step)
    return True


def ingest(sightings: DataFrame, pages: DataFrame, rules: Rules, root: str | None = None, checkpoint: str | None = None) -> str:
    """Run the pass over all that a stream of sightings has now, a trigger a pass; the store's folder."""
    spark = sightings.sparkSession
    root, checkpoint = root or folder(spark, "store"), checkpoint or folder(spark, "state")
    writer = sightings.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda df, i: apply(root, df, i, pages, rules) and None).start().awaitTermination()
    return root
