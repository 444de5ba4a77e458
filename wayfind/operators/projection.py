"""Catalogue projection: domain events, in order of arrival, folded onto documents.

Channel and owner events name no videos. They meet the videos whose channel (owner) it was at that point of the
order: intervals from the video's own events, an equi-join on channel (owner), and a comparison of order numbers. Ends of reconcile runs concern all videos, but
between two events of a video at most two of them can tell: the first one, and the first of another run. Then
each video's events are folded in order, in one expression. A video's events must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.operators.predicates import eligibility

DOC_FIELDS = ("kind", "channel_id", "channel_handle", "channel_name", "owner_id", "title", "category", "language", "is_sensitive", "published_at")
EVENT = ("video_id", "seq", "type", "doc", "reason", "views", "likes", "handle", "name", "owner", "run_id", "unlisted")


def _intervals(marks: DataFrame, value: str) -> DataFrame:
    """video_id, value, after, until: while a video has the value, by marks (video_id, seq, value)."""
    over = Window.partitionBy("video_id").orderBy("seq")
    return marks.select("video_id", value, F.col("seq").alias("after"), F.coalesce(F.lead("seq").over(over), F.lit(2**62)).alias("until"))


def _reach(events: DataFrame, intervals: DataFrame, key: str, value: str) -> DataFrame:
    """Events with the videos that have the value when they arrive."""
    e, i = events.drop("video_id"), intervals.withColumnRenamed(value, "_v")
    met = e.join(i, (e[key] == i["_v"]) & (e["seq"] > i["after"]) & (e["seq"] <= i["until"]))
    return met.select(*EVENT)


def _mark(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.select("video_id", "seq", value.alias(name))


def next_ends(marks: DataFrame, ends: DataFrame, width: int = 1_000_000) -> DataFrame:
    """video_id, seq, run_id: after each mark (video_id, seq) the first of the ends (seq, run_id), and the first end of another run than that one's.

    Order numbers are cut to buckets of `width`, which are looked through by themselves; what a bucket lacks comes from a
    summary of one row a bucket.
    """
    bucket = F.floor(F.col("seq") / width)
    end = F.struct("seq", "run_id")
    ends = ends.select("seq", "run_id").withColumn("_b", bucket)
    inside = Window.partitionBy("_b").orderBy("seq")
    # backwards, since a frame that runs to the end costs the square of its rows and one that runs from the start does not
    after = Window.partitionBy("_b").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_turn", F.lag(F.lit(1)).over(inside).isNotNull() & ~F.lag(end).over(inside)["run_id"].eqNullSafe(F.col("run_id")))
    ends = ends.withColumn("_other", F.last(F.when(F.col("_turn"), end), ignorenulls=True).over(after))
    # a row a bucket: its first and last end, its first turn, and whether its first end is one
    rows = ends.groupBy("_b").agg(F.min_by(F.struct("seq", "run_id", "_other"), "seq").alias("f"), F.max_by("run_id", "seq").alias("last"), F.min(F.when(F.col("_turn"), end)).alias("turn"))
    every = Window.orderBy("_b")
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turn", F.when(F.lag(F.lit(1)).over(every).isNotNull() & ~F.lag("last").over(every).eqNullSafe(F.col("f.run_id")), F.struct("f.seq", "f.run_id")).otherwise(F.col("turn")))
    rows = rows.withColumns({"next_turn": F.last("turn", ignorenulls=True).over(later), "beyond": F.coalesce(F.col("f._other"), F.last("turn", ignorenulls=True).over(later))})
    rows = rows.select("_b", "f", "beyond", "next_turn")
    both = marks.select("video_id", "seq").withColumns({"_b": bucket, "_e": F.lit(None).cast(T.StructType([*[ends.schema[c] for c in ("seq", "run_id", "_other")]]))})
    both = both.unionByName(ends.select(F.lit(None).cast(marks.schema["video_id"].dataType).alias("video_id"), "seq", "_b", F.struct("seq", "run_id", "_other").alias("_e")))
    found = both.withColumn("_a", F.last("_e", ignorenulls=True).over(after)).filter("_e IS NULL")
    # marks with no end left in their bucket take the next bucket that has some
    every_bucket = both.select("_b").distinct().join(rows, "_b", "left")
    follows = every_bucket.select("_b", F.last(F.when(F.col("f").isNotNull(), F.struct("f", "beyond")), ignorenulls=True).over(later).alias("n"))
    own = found.filter("_a IS NOT NULL").join(rows.select("_b", "next_turn"), "_b", "left")
    own = own.select("video_id", F.explode(F.array_compact(F.array(F.struct("_a.seq", "_a.run_id"), F.coalesce("_a._other", "next_turn")))).alias("e"))
    rest = found.filter("_a IS NULL").join(follows.filter("n IS NOT NULL"), "_b")
    rest = rest.select("video_id", F.explode(F.array_compact(F.array(F.struct("n.f.seq", "n.f.run_id"), F.col("n.beyond")))).alias("e"))
    return own.unionByName(rest).select("video_id", "e.seq", "e.run_id").distinct()


def project_catalogue(docs: DataFrame, events: DataFrame, reconciled: bool = True) -> DataFrame:
    """Documents after the events.

    docs: video_id, DOC_FIELDS, views, likes, eligible, suppressed_reason, reconcile_run_id. events: seq, type,
    video_id, doc (struct of DOC_FIELDS, privacy, state, views, likes), reason, views, likes, channel_id, handle, name,
    owner (of a channel), user_id, unlisted, run_id; fields a type lacks are null; a page event has a row a video.
    An upsert derives eligibility anew, so it revives a suppressed video. Suppressing an unknown video leaves a hidden
    placeholder; statistics of one are ignored. Unlisting an owner hides what is visible, and relisting restores only
    that. The end of a reconcile run hides visible local documents without its stamp.
    """
    blank = {c: F.lit(None).cast(t) for c, t in events.select(*[c for c in EVENT if c != "video_id"]).dtypes}
    own = events.filter(F.col("type").isin("video.upsert", "reconcile.page", "video.suppress", "video.stats")).select(*EVENT)
    start = docs.select("video_id", F.lit(-1).cast("long").alias("seq"), "channel_id", "owner_id")
    placed = own.filter("doc IS NOT NULL")
    channels = _intervals(_mark(placed, F.col("doc.channel_id"), "channel").unionByName(_mark(start, F.col("channel_id"), "channel")), "channel")
    by_channel = _reach(events.filter(F.col("type").isin("channel.upsert", "channel.delete")), channels, "channel_id", "channel")
    moved = by_channel.filter("type = 'channel.upsert'")
    owners = _mark(placed, F.col("doc.owner_id"), "o").unionByName(_mark(start, F.col("owner_id"), "o")).unionByName(_mark(moved, F.col("owner"), "o"))
    by_owner = _reach(events.filter("type = 'user.suppress'"), _intervals(owners, "o"), "user_id", "o")
    rows = own.unionByName(by_channel).unionByName(by_owner)
    if reconciled:
        marks = rows.select("video_id", "seq").unionByName(docs.select("video_id", F.lit(-1).cast(rows.schema["seq"].dataType).alias("seq"))).distinct()
        given = blank | {"seq": F.col("seq"), "type": F.lit("reconcile.end"), "run_id": F.col("run_id")}
        ends = next_ends(marks, events.filter("type = 'reconcile.end'"))
        rows = rows.unionByName(ends.select("video_id", *[given[c].alias(c) for c in EVENT if c != "video_id"]))
    history = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in EVENT if c not in ("video_id", "seq")]))).alias("events"))
    state = F.struct(
        F.lit(True).alias("exists"), *[F.col(c) for c in DOC_FIELDS], F.col("views"), F.col("likes"), F.col("eligible"), F.col("suppressed_reason").alias("reason"), F.col("reconcile_run_id").alias("run_id")
    )
    both = history.join(docs.select("video_id", state.alias("state")), "video_id", "full_outer")
    kinds = dict(docs.dtypes)
    empty = F.struct(
        F.lit(False).alias("exists"), *[F.lit(None).cast(kinds[c]).alias(c) for c in DOC_FIELDS], F.lit(None).cast(kinds["views"]).alias("views"), F.lit(None).cast(kinds["likes"]).alias("likes"),
        F.lit(False).alias("eligible"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast(kinds["reconcile_run_id"]).alias("run_id"),
    )
    fold = F.aggregate(F.coalesce("events", F.array().cast(dict(history.dtypes)["events"])), F.coalesce("state", empty), lambda s, e: _step(s, e, kinds))
    done = both.select("video_id", fold.alias("s")).filter("s.exists")
    return done.select("video_id", *[F.col(f"s.{c}").alias(c) for c in DOC_FIELDS], "s.views", "s.likes", "s.eligible", F.col("s.reason").alias("suppressed_reason"), F.col("s.run_id").alias("reconcile_run_id"))


def _step(s: Column, e: Column, kinds: dict[str, str]) -> Column:
    is_ = lambda *t: e["type"].isin(*t)
    doc = e["doc"]
    ok, why = eligibility(doc["privacy"], doc["state"])
    put, cut, stats = is_("video.upsert", "reconcile.page"), is_("video.suppress"), is_("video.stats") & s["exists"]
    renamed = is_("channel.upsert") & s["exists"]
    hide = is_("user.suppress") & F.coalesce(e["unlisted"], F.lit(False)) & s["eligible"]
    show = is_("user.suppress") & ~F.coalesce(e["unlisted"], F.lit(False)) & (F.coalesce(s["reason"], F.lit("")) == "owner_unlisted")
    lost = is_("reconcile.end") & s["eligible"] & (s["kind"] == "local") & ~s["run_id"].eqNullSafe(e["run_id"])
    gone = is_("channel.delete") & s["exists"]
    blank = cut & ~s["exists"]
    fields = []
    for c in DOC_FIELDS:
        value = F.when(put, doc[c] if c != "kind" else F.coalesce(F.nullif(doc["kind"], F.lit("")), F.lit("local"))).otherwise(s[c])
        if c == "title":
            value = F.when(blank, F.lit("")).otherwise(value)
        if c == "kind":
            value = F.when(blank, F.lit("local")).otherwise(value)
        if c in ("channel_handle", "channel_name", "owner_id"):
            value = F.when(renamed, e[{"channel_handle": "handle", "channel_name": "name", "owner_id": "owner"}[c]]).otherwise(value)
        fields.append(value.cast(kinds[c]).alias(c))
    number = lambda c: F.when(put, doc[c]).when(stats, e[c]).when(blank, F.lit(0)).otherwise(s[c]).cast(kinds[c]).alias(c)
    return F.struct(
        (s["exists"] | put | cut).alias("exists"),
        *fields,
        number("views"),
        number("likes"),
        F.when(put, ok).when(cut | hide | lost | gone, False).when(show, True).otherwise(s["eligible"]).alias("eligible"),
        F.when(put, why).when(cut, e["reason"]).when(gone, "channel_deleted").when(hide, "owner_unlisted").when(lost, "reconcile_orphan").when(show, F.lit(None)).otherwise(s["reason"]).alias("reason"),
        F.when(put, F.coalesce(e["run_id"], s["run_id"])).otherwise(s["run_id"]).cast(kinds["reconcile_run_id"]).alias("run_id"),
    )
