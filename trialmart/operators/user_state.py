"""A user table that is kept up to date: one new batch of orders at a time (AGG3, AGG5, AGG6).

Kept are the totals of each customer, which merge (count, sum, first and last event,
latest platform), and a log of the orders that count, narrow and only appended to.
A fold looks up the new orders' ids in the log:

* an order not seen before is added to its customer's totals, however late it is;
* a copy that comes after the one that counts changes nothing;
* a copy that should have counted (the earliest does) replaces the other one, and the
  totals of the customers of both are built anew from the log.

Both tables of a fold are written first and published together (``versions``), so a
lost fold leaves the state as it was and can be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import splittable_join
from ..functions.fixed_values import BUSINESS_TZ
from ..sources import versions
from ..sources.storage import stage
from .conform import USER_ORDER_COLUMNS, first_copies, typed_order_rows, valid_amount
from .fact import experiment_window

def _totals(orders: DataFrame) -> DataFrame:
    """The state of the customers of some orders; folded map-side."""
    known = F.when(F.col("origin_platform").isNotNull(), F.struct("event_ts_utc", "order_id"))
    return orders.groupBy("customer_id").agg(
        F.count("*").alias("frequency"),
        F.sum("order_total_amount").alias("monetary"),
        F.min("event_ts_utc").alias("first_order"),
        F.max("event_ts_utc").alias("last_order"),
        F.max(known).alias("platform_at"),
        F.max_by("origin_platform", known).alias("origin_platform"),
    )


def merge_states(one: DataFrame, two: DataFrame) -> DataFrame:
    """The totals of the orders of both, which have no order in common."""
    return one.unionByName(two).groupBy("customer_id").agg(
        F.sum("frequency").alias("frequency"),
        F.sum("monetary").alias("monetary"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.max("platform_at").alias("platform_at"),
        F.max_by("origin_platform", "platform_at").alias("origin_platform"),
    )


class UserState:
    """The state in a folder, for orders of one experiment window."""

    def __init__(
        self, spark: SparkSession, path: str, start: str | Column | None = None, end: str | Column | None = None,
        *, business_tz: str = BUSINESS_TZ, offset_aware: bool = False,
    ):
        self._spark, self._path = spark, path.rstrip("/")
        self._window, self._zone, self._offset_aware = (start, end), business_tz, offset_aware

    def _log(self, folds: list[str], schema) -> DataFrame:
        paths = [f"{self._path}/orders/{f}" for f in folds]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    def _counting(self, orders: DataFrame) -> DataFrame:
        return experiment_window(orders.where(valid_amount()), *self._window)

    def _stored(self, content: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(content["schema"]))
        return self._spark.read.schema(schema).parquet(f"{self._path}/totals/{content['totals']}")

    def totals(self) -> DataFrame:
        """Totals of every customer so far."""
        _, content = versions.latest(self._spark, self._path)
        if not content:
            raise FileNotFoundError(f"no batch has been folded into {self._path}")
        return self._stored(content)

    def fold(self, raw_orders: DataFrame) -> int:
        """Take in a batch of raw orders; the number of the state."""
        number, content = versions.latest(self._spark, self._path)
        folds = content.get("orders", [])
        typed = typed_order_rows(
            raw_orders, self._zone, offset_aware=self._offset_aware, columns=USER_ORDER_COLUMNS
        )
        new = stage(first_copies(typed), "fold_new")
        log = self._log(folds, new.schema)
        ids = new.select("order_id")
        # The log may hold several winners of an id; the earliest is the last one.
        old = first_copies(log.join(ids, "order_id", "left_semi"))
        met = old.withColumn("kept", F.lit(True)).unionByName(new.withColumn("kept", F.lit(False)))
        # The same copy once more has the same columns; then the kept one counts.
        best = first_copies(met.drop("kept"))
        held = old.select("order_id", F.struct(*[c for c in old.columns if c != "order_id"]).alias("old"))
        told = best.withColumn("best", F.struct(*[c for c in old.columns if c != "order_id"])).join(
            held, "order_id", "left"
        )
        changed = stage(
            told.where(F.col("old").isNull() | ~F.col("best").eqNullSafe(F.col("old"))).select(*new.columns, "old"),
            "fold_changed",
        )
        fold = uuid.uuid4().hex
        changed.select(*new.columns).write.parquet(f"{self._path}/orders/{fold}")
        replaced = changed.where("old is not null")
        if replaced.isEmpty():
            state = _totals(self._counting(changed))
            state = merge_states(self._stored(content), state) if content else state
        else:
            log = self._log([*folds, fold], new.schema)
            state = self._with_replaced(self._stored(content), changed, replaced, log)
        state.write.parquet(f"{self._path}/totals/{fold}")
        made = {"orders": [*folds, fold], "totals": fold, "schema": state.schema.json()}
        versions.publish(self._spark, self._path, number + 1, made)
        return number + 1

    def _with_replaced(
        self, state: DataFrame, changed: DataFrame, replaced: DataFrame, log: DataFrame
    ) -> DataFrame:
        both = F.explode(F.array("customer_id", "old.customer_id")).alias("customer_id")
        again = stage(replaced.select(both).distinct(), "fold_again")
        rest = merge_states(
            state.join(again, "customer_id", "left_anti"),
            _totals(self._counting(changed.join(again, "customer_id", "left_anti"))),
        )
        # All copies of every order that one of these customers has had.
        theirs = log.join(again, "customer_id", "left_semi").select("order_id").distinct()
        orders = first_copies(splittable_join(log, theirs, "order_id", "inner"))
        rebuilt = _totals(self._counting(orders).join(again, "customer_id", "left_semi"))
        return rest.unionByName(rebuilt)
