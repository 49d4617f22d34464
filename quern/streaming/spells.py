"""Price spells over a stream, with keyed state: rows may come in any order, and late, until the watermark has passed their
day. A spell is emitted once, when no row that may still come can change it, and its days leave the state.

A series' state is the days that may still change (one entry a day, rows of one day folded as ``timeline.daily`` folds
them), and one summary of the spell that is still open before them, however long it is.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.config import PRICE_EPSILON, SPELL_GAP_DAYS
from quern.sources.shared import ship

#: The state store that timers and several states a key need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY_MS = 86_400_000
_SPELL = "from_date date, to_date date, px double, observed_days long, on_sale int, calendar_days long"


def _fold(days: dict, d: dt.date, px: float, sale: int) -> None:
    old = days.get(d)
    days[d] = (px, sale) if old is None else (min(px, old[0]), max(sale, old[1]))


def _ms(d: dt.date) -> int:
    return (d - dt.date(1970, 1, 1)).days * _DAY_MS


class Spells(StatefulProcessor):
    """One series: rows (d, px, on_sale) in, closed spells out."""

    def __init__(self, keys: Sequence[str], gap: int, epsilon: float):
        self.gap, self.epsilon, self.row = gap, epsilon, Row(*keys, "from_date", "to_date", "px", "observed_days", "on_sale", "calendar_days")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", _ddl([("d", T.DateType()), ("px", T.DoubleType()), ("on_sale", T.IntegerType())]))
        self.open = handle.getValueState("open", _ddl([("from_date", T.DateType()), ("px", T.DoubleType()), ("observed_days", T.LongType()), ("on_sale", T.IntegerType()), ("last_d", T.DateType()), ("last_px", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        now, new = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            if r.d is None or r.px is None or _ms(r.d) <= now:  # too late: its day is settled
                continue
            _fold(new, r.d, r.px, r.on_sale)
        yield from self._settle(key, now, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, now: int, new: dict = MappingProxyType({})) -> Iterator[Row]:
        """Takes the days that can't change any more into the open spell, in order, and gives those that it closes. The
        state is asked for once and written once a call, not for each row: every call to it leaves the worker."""
        held = {}
        for d, px, sale in self.days.get():
            held[d] = (px, sale)
        first = min(held, default=None)
        for d, (px, sale) in new.items():
            _fold(held, d, px, sale)
        days, settled = sorted(held), 0
        if days and _ms(days[0]) > now:  # nothing settles, and the open spell waits for these days
            if new:
                self.days.put([(d, *held[d]) for d in days])
            if days[0] != first:
                self.handle.registerTimer(_ms(days[0]) + 1)
            return
        was = open_ = tuple(found) if (found := self.open.get()) is not None else None
        while settled < len(days) and _ms(days[settled]) <= now:
            d = days[settled]
            px, sale = held[d]
            settled += 1
            if open_ is not None and abs(px - open_[5]) <= self.epsilon and (d - open_[4]).days <= self.gap and sale == open_[3]:
                open_ = (open_[0], open_[1], open_[2] + 1, sale, d, px)
            else:
                if open_ is not None:
                    yield self._row(key, open_)
                open_ = (d, px, 1, sale, d, px)
        days = days[settled:]
        if new or settled:
            self.days.put([(d, *held[d]) for d in days]) if days else self.days.clear()
        if open_ is not None and not days and _ms(open_[4]) + self.gap * _DAY_MS <= now:  # what may come is beyond the gap
            yield self._row(key, open_)
            open_ = None
        if open_ is None and was is not None:
            self.open.clear()
        elif open_ != was:
            self.open.update(open_)
        if days:
            self.handle.registerTimer(_ms(days[0]) + 1)
        elif open_ is not None:
            self.handle.registerTimer(_ms(open_[4]) + self.gap * _DAY_MS + 1)

    def _row(self, key, s: tuple) -> Row:
        return self.row(*key, s[0], s[4], s[1], s[2], s[3], (s[4] - s[0]).days + 1)

    def close(self) -> None:
        pass


def _ddl(fields: list[tuple]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


def spells(rows: DataFrame, keys: Sequence[str], lateness: str = "30 days", gap: int = SPELL_GAP_DAYS, epsilon: float = PRICE_EPSILON) -> DataFrame:
    """(keys, from_date, to_date, px, observed_days, on_sale, calendar_days) of a stream of rows (keys, d date, px, on_sale):
    what ``timeline.spells`` gives of all rows that were not later than ``lateness``. Rows without a day or a price don't
    count; later ones are left out. Append mode; needs RocksDB as the state store (see ``with_state``)."""
    ship(rows.sparkSession)
    timed = rows.select(*keys, "d", F.col("px").cast("double").alias("px"), F.coalesce(F.col("on_sale").cast("int"), F.lit(0)).alias("on_sale"), F.col("d").cast("timestamp").alias("at")).withWatermark("at", lateness)
    kinds = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(_SPELL)])
    return timed.groupBy(*keys).transformWithState(Spells(list(keys), gap, epsilon), kinds, "Append", "EventTime")


def with_state(spark: SparkSession) -> None:
    """Takes RocksDB as the session's state store for streams that begin from now on."""
    spark.conf.set(*PROVIDER)


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed spells to Parquet exactly once; ends when what has arrived is done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
