"""Credits, claims and lists as new tables made from old ones: each step given again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ledger as L

#: What makes a movement of credits one of its kind.
KEY = ["user_id", "reason", "idem"]
#: Fixed value: characters of a stored error.
ERROR = 400


def granted(ledger: DataFrame, users: DataFrame, period: str, credits: int) -> DataFrame:
    """The ledger with the monthly grant of a period for every user that hasn't it."""
    rows = users.select("user_id", F.lit(credits).cast("long").alias("delta"), F.lit("monthly_grant").alias("reason"), F.lit(period).alias("idem"))
    return L.append_new(ledger, rows, KEY, F.col("user_id"))


def credited(ledger: DataFrame, credits: DataFrame) -> DataFrame:
    """The ledger with credits (user_id, delta, reason, idem) from sources or payments: positive ones, each key once."""
    rows = credits.filter("delta > 0").select("user_id", F.floor(F.col("delta") + 0.5).cast("long").alias("delta"), "reason", "idem")
    return L.append_new(ledger, rows, KEY, F.desc("delta"))


def refunded(ledger: DataFrame, refunds: DataFrame) -> DataFrame:
    """The ledger with every refund (user_id, delta, operation, at) of a positive amount: each is its own movement."""
    rows = refunds.filter("delta > 0").select("user_id", F.col("delta").cast("long").alias("delta"), F.concat(F.lit("refund:"), "operation").alias("reason"), F.concat_ws(":", F.lit("op"), F.col("at").cast("string")).alias("idem"))
    return ledger.unionByName(rows)


def reconciled(ledger: DataFrame, redeemed: DataFrame, now: str) -> DataFrame:
    """The ledger with what redeemed codes (user_id, code, amount, monthly, months, at) are worth by an instant.

    A single grant is one movement; a monthly one is a movement for each month
    from its redemption to that instant, at most `months` of them.
    """
    first = F.trunc("at", "month")
    until = F.least(F.trunc(F.lit(now).cast("date"), "month"), F.when(F.col("months").isNotNull(), F.add_months(first, F.col("months") - 1)).otherwise(F.lit("9999-01-01").cast("date")))
    month = F.explode(F.when(F.col("monthly"), F.when(until >= first, F.sequence(first, until, F.expr("INTERVAL 1 MONTH"))).otherwise(F.array(first))).otherwise(F.array(F.lit(None).cast("date"))))
    rows = redeemed.filter("amount > 0").withColumn("_month", month)
    idem = F.concat_ws(":", F.lit("code"), F.col("code").cast("string"), F.date_format("_month", "yyyy-MM"))
    return credited(ledger, rows.select("user_id", F.col("amount").alias("delta"), F.lit("code").alias("reason"), idem.alias("idem")))


def marked_sent(sends: DataFrame, users: DataFrame, done: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """sends and users after the sends in done (user_id, period_key, transport) went out at an instant."""
    stamp = F.lit(at).cast("timestamp")
    out = sends.join(done.select("user_id", "period_key", F.col("transport").alias("_t")), ["user_id", "period_key"], "left")
    hit = F.col("_t").isNotNull()
    out = out.withColumns({"status": F.when(hit, "sent").otherwise(F.col("status")), "transport": F.when(hit, F.col("_t")).otherwise(F.col("transport")), "sent_at": F.when(hit, stamp).otherwise(F.col("sent_at"))}).select(sends.columns)
    reached = done.select("user_id").distinct().withColumn("_r", F.lit(True))
    who = users.join(reached, "user_id", "left").withColumn("last_sent", F.when(F.col("_r"), stamp).otherwise(F.col("last_sent"))).select(users.columns)
    return out, who


def released(sends: DataFrame, failed: DataFrame, at: str) -> DataFrame:
    """sends with the claims in failed (user_id, period_key, error) given free and one log row each; sent ones stay."""
    hit = failed.select("user_id", "period_key")
    kept = sends.join(hit.withColumn("_f", F.lit(True)), ["user_id", "period_key"], "left").filter(F.col("_f").isNull() | (F.col("status") != "sending")).select(sends.columns)
    stamp = F.unix_millis(F.lit(at).cast("timestamp")).cast("string")
    log = failed.select("user_id", F.concat("period_key", F.lit("#failed:"), stamp).alias("period_key"), F.lit("failed").alias("status"), F.lit(None).cast("string").alias("transport"), F.lit(None).cast("timestamp").alias("sent_at"), F.substring("error", 1, ERROR).alias("error"))
    return L.append_new(kept, log.select(kept.columns), ["user_id", "period_key"], F.col("error"))


def with_frequency(users: DataFrame, wishes: DataFrame) -> DataFrame:
    """users with the frequency each last wished (user_id, frequency, at), if it is one; others keep theirs."""
    last = wishes.filter(F.col("frequency").isin("daily", "weekly", "off")).groupBy("user_id").agg(F.max_by("frequency", F.struct("at", "frequency")).alias("_w"))
    return users.join(last, "user_id", "left").withColumn("frequency", F.coalesce("_w", "frequency")).select(users.columns)


def settled(pending: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending rows that verified users (user_id) claim, and those left: a row is claimed by being taken away, so once."""
    who = verified.select("user_id").distinct()
    return pending.join(who, "user_id", "left_semi"), pending.join(who, "user_id", "left_anti")


def removed(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """lists without the items asked away, of the asking user alone; tickers in any case."""
    gone = asked.select("user_id", F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return lists.join(gone, ["user_id", "ticker"], "left_anti")


def consumed(tokens: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(user_id, hash) of tokens that requests (token, kind) use up at an instant, and the tokens after it.

    A token is good once: of its kind, neither used nor expired.
    """
    want = asked.select(F.sha2("token", 256).alias("hash"), "kind").distinct()
    good = tokens.filter(F.col("used_at").isNull() & (F.col("expires") > F.lit(now).cast("timestamp"))).join(want, ["hash", "kind"], "left_semi")
    stamp = good.select("hash", "kind", F.lit(now).cast("timestamp").alias("_now"))
    after = tokens.join(stamp, ["hash", "kind"], "left").withColumn("used_at", F.coalesce("used_at", F.when(F.col("expires") > F.lit(now).cast("timestamp"), F.col("_now")))).select(tokens.columns)
    return good.select("user_id", "hash"), after


def purchases_of(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """(event_id, id, user_id) of the purchase each event is about: by session, else by our own id, else by payment; none if the event names another account."""
    p = purchases.select("id", "user_id", "payment_id")
    ways = [("session", "payment_id"), ("purchase", "id"), ("payment", "payment_id")]
    found = None
    for place, (mine, theirs) in enumerate(ways):
        hit = events.filter(F.coalesce(mine, F.lit("")) != "").join(p, F.col(mine) == F.col(theirs)).select("event_id", "account", F.lit(place).alias("_place"), "id", "user_id")
        found = hit if found is None else found.unionByName(hit)
    one = found.groupBy("event_id").agg(F.min_by(F.struct("account", "id", "user_id"), F.struct("_place", "id")).alias("x")).select("event_id", "x.*")
    return one.filter((F.coalesce("account", F.lit("")) == "") | (F.col("account") == F.col("user_id").cast("string"))).select("event_id", "id", "user_id")


def stored_analyses(analyses: DataFrame, evidence: DataFrame, new: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyses and their evidence after new ones: an analysis replaces that of its id, with all it cites."""
    kept = analyses.join(new.select("id"), "id", "left_anti")
    old = evidence.join(new.select(F.col("id").alias("analysis_id")), "analysis_id", "left_anti")
    rows = cited.withColumn("id", F.concat_ws(":", "analysis_id", "hash")).dropDuplicates(["id"])
    return kept.unionByName(new), old.unionByName(rows.select(old.columns))


def stored_links(stored: DataFrame, links: DataFrame) -> DataFrame:
    """Corroborations by a hash of what they join: a link found again replaces the one stored."""
    rows = links.withColumn("key", F.concat(F.lit("cor:"), F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("doc_id").cast("string")), 256), 1, 20)))
    return stored.join(rows.select("key"), "key", "left_anti").unionByName(rows.select(stored.columns))


def capped_events(signals: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` signals of each document by strength and id: what is sent on; a signal sent twice counts once."""
    one = signals.dropDuplicates(["signal_id"])
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("strength"), "signal_id"))
    return one.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def fanned_out(events: DataFrame, lists: DataFrame) -> DataFrame:
    """(user_id, signal_id): each event to every user that watches its ticker, once."""
    return events.select("ticker", "signal_id").join(lists.select("user_id", "ticker").distinct(), "ticker").select("user_id", "signal_id").distinct()


def when_given(rows: DataFrame, column: str, start: str | None = None, end: str | None = None, **equal) -> DataFrame:
    """Rows that fit each condition that is given: a range of days and equalities."""
    tests: list[Column] = []
    tests += [F.col(column) >= F.lit(start).cast("date")] if start else []
    tests += [F.col(column) <= F.lit(end).cast("date")] if end else []
    tests += [F.col(c) == v for c, v in equal.items() if v is not None]
    for t in tests:
        rows = rows.filter(t)
    return rows
