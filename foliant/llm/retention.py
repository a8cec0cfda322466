"""Retention of clients by the day of their first signup, as two states of knowledge see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import quoted
from foliant.session import stored

CUTOFF = "2024-02-15 00:00:00"
#: A client with more than one part in HOT of the clicks is spread; there are fewer than HOT such clients.
HOT = 1000
#: Values beyond this, and those that are no finite number, count as 0 cents like nulls: their sums fit no long.
MOST_VALUE = 1e13


def cells(clicks: DataFrame, clients: DataFrame, cutoff: str = CUTOFF, hot: int = HOT) -> DataFrame:
    """Cells (state, segment, cohort, period) of users who have clicks in that many days after their start.

    Equal rows, over all columns, count once. Rows without ts or client_id are dropped. A click without click_id arrives
    at arrived_at; one without arrived_at is unknown to state 0. Times with a zone have their days in the session's zone.
    A client_id that `clients` repeats has its smallest segment. Other columns may have any names and types. Empty tables
    give no cells.

    One pass finds both starts of each client by conditional minima, summed on the map side; starts with the segment go to
    the shared folder. Clicks are made distinct and shuffled to the starts by client and a salt, which only clients with
    many clicks have, so that no task has more than about one part in `hot` of them for one client; those of such clients
    without a start go before that shuffle. Sums by state, client
    and period precede those by cell.
    """
    known = _usable(clicks, cutoff)
    signup = F.col("kind_") == "signup"
    starts = known.groupBy("client").agg(
        F.min(F.when(signup & F.col("early"), F.col("at"))).alias("start0"), F.min(F.when(signup, F.col("at"))).alias("start1"), F.count("*").alias("clicks")
    )
    segments = clients.select(F.col("client_id").alias("client"), F.col("segment").alias("segment_"))
    segments = segments.where("client is not null").groupBy("client").agg(F.min("segment_").alias("segment_"))
    starts = starts.join(segments, "client", "left")
    starts = stored(starts.withColumn("segment_", F.coalesce("segment_", F.lit(""))), "starts")

    total = starts.agg(F.sum("clicks")).first()[0] or 0
    pieces = F.ceil(F.col("clicks") * hot / F.lit(max(total, 1))).cast("int")
    many = starts.where(F.col("clicks") * hot > total).select("client", F.when(F.col("start1").isNotNull(), pieces).otherwise(0).alias("pieces"))
    dealt = known.distinct().join(F.broadcast(many), "client", "left").where("coalesce(pieces, 1) > 0")  # `many` has fewer than `hot` rows
    salt = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("click", "at", "cents"), "pieces")).otherwise(0).cast("int")
    dealt = dealt.select("client", salt.alias("salt"), "at", "early", "cents")
    last = F.when(F.col("clicks") * hot > total, pieces - 1).otherwise(0)
    spread = starts.where("start1 is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), last)))

    cohorts = [F.unix_date(F.to_date(f"start{i}")).cast("long") for i in (0, 1)]
    spread = spread.withColumn("moved", F.coalesce(cohorts[0] != cohorts[1], F.lit(False)).cast("long"))
    seen = [F.when(F.col("early") & (F.col("at") >= F.col("start0")), _state(0, cohorts[0])), F.when(F.col("at") >= F.col("start1"), _state(1, cohorts[1]))]
    views = dealt.join(spread.hint("shuffle_merge"), ["client", "salt"]).select("client", "segment_", "moved", "cents", F.explode(F.array_compact(F.array(*seen))).alias("view"))
    views = views.select("client", "segment_", "moved", "cents", "view.*")
    users = views.groupBy("state", "segment_", "cohort", "period", "client", "moved").agg(F.sum("cents").alias("cents"))
    return (
        users.groupBy("state", "segment_", "cohort", "period")
        .agg(F.count("*").alias("users"), F.sum(_crc(F.col("client"))).alias("users_crc32"), F.sum("moved").alias("moved"), F.sum("cents").alias("cents"))
        .withColumnRenamed("segment_", "segment")
    )


def _usable(clicks: DataFrame, cutoff: str) -> DataFrame:
    """Clicks with what the matrix needs of them, and the whole row beside it, by which copies are known."""
    c = F.col
    turn = _crc(c("click_id"))
    arrival = F.when(turn % 3 == 0, c("arrived_at") + F.make_dt_interval((turn % 100).cast("int"))).otherwise(c("arrived_at"))
    early = arrival < F.lit(cutoff).cast(clicks.schema["arrived_at"].dataType)
    value = F.when(F.abs("value") <= MOST_VALUE, F.floor(c("value") * 100 + 0.5))
    rows = clicks.where(c("ts").isNotNull() & c("client_id").isNotNull())
    return rows.select(
        c("click_id").alias("click"), c("client_id").alias("client"), c("ts").alias("at"), c("kind").alias("kind_"), F.coalesce(early, F.lit(False)).alias("early"),
        F.coalesce(value, F.lit(0)).cast("long").alias("cents"), F.struct(*_rest(rows)).alias("whole"),
    )


def _rest(df: DataFrame) -> list[Column]:
    """Columns that copies must agree in and that stand nowhere else in the row, under names that do not clash."""
    return [col.alias(f"c{i}") for i, (col, name) in enumerate(zip(quoted(df), df.columns, strict=True)) if name.lower() not in ("click_id", "client_id", "ts", "kind")]


def _crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def _state(state: int, cohort: Column) -> Column:
    since = F.expr(f"extract(day from (at - start{state}))")
    return F.struct(F.lit(state).alias("state"), cohort.alias("cohort"), since.cast("long").alias("period"))


ORACLE = f"""
with polynomial as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as step),
ids as (
  select id, xor(list_reduce(list_transform(string_split(id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as crc
  from (select click_id as id from clicks union select client_id from clicks), polynomial where id is not null),
known as (
  select client_id, ts, kind, coalesce(floor(100 * case when abs(value) <= {MOST_VALUE:.0f} then value end + 0.5), 0)::bigint as cents,
    coalesce(case when crc % 3 = 0 then arrived_at + to_days((crc % 100)::int) else arrived_at end < timestamp '{CUTOFF}', false) as early
  from (select distinct * from clicks) left join ids on id = click_id where ts is not null and client_id is not null),
states as (select 0 as state, * from known where early union all select 1, * from known),
starts as (select state, client_id, min(ts) as start from states where kind = 'signup' group by all),
moves as (select client_id, count(*) = 2 and min(start::date) <> max(start::date) as moved from starts group by all),
segments as (select client_id, min(segment) as segment from clients group by all),
users as (
  select state, client_id, coalesce(segment, '') as segment, date_diff('day', date '1970-01-01', start::date) as cohort,
    floor((epoch_us(ts) - epoch_us(start)) / 86400000000)::bigint as period, sum(cents)::bigint as cents
  from states join starts using (state, client_id) left join segments using (client_id) where ts >= start group by all)
select state, segment, cohort, period, count(*) as users, sum(crc)::bigint as users_crc32, sum(moved::int)::bigint as moved, sum(cents)::bigint as cents
from users join moves using (client_id) join ids on id = client_id group by all
"""
