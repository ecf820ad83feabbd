"""Billing events on a stream: each event once, folded per user into a state that batches are merged into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.operators import billing
from tallyshelf.session import scratch, settle
from tallyshelf.sinks.buckets import BucketLog, BucketTable


def deduplicated(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop redeliveries of an event id that arrive within ``delay`` of the first."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def first_deliveries(batch: DataFrame, ids: BucketLog, number: int) -> DataFrame:
    """The batch's events whose id no batch before had, once each; settled, and their ids logged.

    What is kept is the ids, in hash buckets on disk, so a redelivery may be of any age; a batch opens the
    buckets its own ids fall into. One that is tried again gives the same rows.
    """
    once = settle(billing.once_per_event(batch))
    fresh = settle(once.join(ids.read(once.select("event_id"), number), "event_id", "left_anti"))
    ids.write(fresh.select("event_id"), F.col("event_id"), number)
    return fresh


_EVENT = ("event_id STRING, type STRING, ts TIMESTAMP, user_id STRING, customer_id STRING, subscription_id STRING, status STRING, "
          "price_id STRING, interval STRING, current_period_end TIMESTAMP")
_AT = "STRUCT<ts: TIMESTAMP, event_id: STRING>"
_KINDS = {f: "TIMESTAMP" if f == "current_period_end" else "STRING" for f in billing.FIELDS}
_USER = ("user_id STRING, " + ", ".join(f"{f} {k}, {f}_at {_AT}" for f, k in _KINDS.items())
         + ", updated_at TIMESTAMP, switches ARRAY<STRUCT<ts: TIMESTAMP, event_id: STRING, customer_id: STRING>>")
_OWNER = "name STRING, users ARRAY<STRING>, last_ts TIMESTAMP"


class Entitlements:
    """Entitlement state below one folder.

    Per user: the latest value set of each column and when it was set, and the checkouts at which the user's
    customer changed. Per customer: its users and the time of its newest event. Event ids and events lie in
    hash buckets. A batch reads the state of the users and customers it names, and the ids in its own ids'
    buckets. Only a checkout that comes later than events it tells the owner of makes its user's events be
    read again, out of the buckets of that user's customers.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        path = path.rstrip("/")
        self.spark = spark
        self.users = BucketTable(spark, f"{path}/users", _USER, "user_id", buckets)
        self.owners = BucketTable(spark, f"{path}/owners", _OWNER, "name", buckets)
        self.ids = BucketLog(spark, f"{path}/ids", "event_id STRING", buckets)
        self.log = BucketLog(spark, f"{path}/log", _EVENT, buckets)

    def read(self) -> DataFrame:
        """The entitlement rows; a user of whom only the checkouts are known has none of the values."""
        return self.users.read().filter("updated_at IS NOT NULL").select("user_id", *billing.FIELDS, "updated_at")

    def merge(self, batch: DataFrame, number: int, plans_by_price: dict[str, str] | None = None) -> None:
        """Merge a batch of events; one that is tried again, whole or half done, changes nothing more."""
        if self.users.applied(number):
            return
        with scratch(self.spark):
            fresh = first_deliveries(batch.select(*[c.split()[0] for c in _EVENT.split(", ")]), self.ids, number)
            self.log.write(fresh, _name(), number)
            self._merge(fresh, number, plans_by_price)

    def _merge(self, fresh: DataFrame, number: int, plans: dict[str, str] | None) -> None:
        checkouts = fresh.filter((F.col("type") == billing.CHECKOUT) & F.col("user_id").isNotNull())
        known = settle(self.owners.read_for(fresh.withColumn("name", _name())))
        named = checkouts.select("user_id").unionAll(known.select(F.explode("users"))).distinct()
        state = settle(self.users.read_for(named))
        switches = settle(billing.switches(state.select("user_id", F.inline("switches")).unionByName(
            checkouts.select("user_id", "ts", "event_id", "customer_id"))))

        late = self._reopened(checkouts, switches, number)
        past = self._past(switches.join(late, "user_id"), number)
        # A repeat that was dropped may now follow another customer, so these users' switches are found anew.
        all_checkouts = past.filter(F.col("type") == billing.CHECKOUT).join(late, "user_id", "left_semi")
        switches = settle(switches.join(late, "user_id", "left_anti").unionByName(billing.switches(all_checkouts)))
        owned = billing.ownership(switches)
        ours = settle(billing.changed_fields(billing.with_user(fresh, owned), plans).join(late, "user_id", "left_anti"))
        again = billing.changed_fields(billing.with_user(past, owned).join(late, "user_id", "left_semi"), plans)
        state = state.join(late, "user_id", "left_anti")
        merged = billing.fold_state(billing.as_state(ours).unionByName(state.drop("switches")).unionByName(billing.as_state(again)))
        packed = switches.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "customer_id"))).alias("switches"))
        changed = ours.select("user_id").unionAll(checkouts.select("user_id")).unionAll(late).distinct()
        rows = settle(packed.join(changed, "user_id").join(merged, "user_id", "left"))

        owners = fresh.select(_name().alias("name"), F.when(F.col("type") == billing.CHECKOUT, F.col("user_id")).alias("user"), "ts").unionAll(
            known.select("name", F.explode_outer("users"), "last_ts"))
        # The owners first: with the new ones and the old users, the batch is merged again to the same end.
        owners = settle(owners.groupBy("name").agg(F.array_sort(F.collect_set("user")).alias("users"), F.max("ts").alias("last_ts")))
        self.users.upsert(rows, number)
        self.owners.upsert(owners, number)

    def _reopened(self, checkouts: DataFrame, switches: DataFrame, number: int) -> DataFrame:
        """Users with a new checkout that is older than what was seen of a customer of theirs."""
        theirs = switches.select("user_id", F.coalesce("customer_id", "user_id").alias("name")).distinct()
        before = self.owners.read_for(theirs).join(theirs, "name").groupBy("user_id").agg(F.max("last_ts").alias("last_ts"))
        first = checkouts.groupBy("user_id").agg(F.min("ts").alias("ts"))
        return settle(first.join(before, "user_id").filter(F.col("ts") <= F.col("last_ts")).select("user_id"))

    def _past(self, switches: DataFrame, number: int) -> DataFrame:
        """All events so far, this batch's too, of the customers in some switches."""
        names = settle(switches.select(F.coalesce("customer_id", "user_id").alias("name")).distinct())
        return settle(self.log.read(names, number + 1).withColumn("name", _name()).join(names, "name", "left_semi").drop("name"))


def _name() -> Column:
    """What an event's rows are kept under: its customer, or the user of a checkout without one."""
    return F.coalesce("customer_id", "user_id", F.lit(""))


def maintain_entitlements(events: DataFrame, table: Entitlements, checkpoint: str, *, plans_by_price: dict[str, str] | None = None,
                          trigger: dict | None = None):
    """Keep the entitlement state up to date, batch by batch."""
    writer = events.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, plans_by_price))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
