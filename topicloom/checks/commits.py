"""Commits, tags, releases, changed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.checks import standins as S
from topicloom.functions import text as T
from topicloom.operators import asof
from topicloom.sources import commits as G

SQL_RELEASES = """releases as (
  select max(tag) as tag, ts from tags
  where not contains(tag, 'rc') and not contains(tag, '-') and starts_with(tag, 'v') group by ts)"""

SQL_STABLE = f"""{S.SQL_TAGS}, {SQL_RELEASES},
series as (select case when regexp_matches(tag, '^v4\\.[^.]*$') then tag else regexp_extract(tag, '^(.*)\\.[^.]*$', 1) end as series, tag, ts
           from releases),
newest as (select series, max({{'ts': ts, 'tag': tag}}) as n from series group by series),
ranges as (select n.series, t.ts as since, n.n.ts as until from newest n join tags t on t.tag = n.series)"""


def release_asof(spark, sf):
    return asof.with_release(S.commits(spark, sf), S.tags(spark, sf)).select("id", "release")


def describe(spark, sf):
    return asof.describe(S.commits(spark, sf), S.tags(spark, sf)).select("id", "version", "n_since")


def latest_per_major(spark, sf):
    return asof.latest_per_major(S.tags(spark, sf)).select("series", "tag")


def stable_commits(spark, sf):
    return G.stable_commits(S.commits(spark, sf), S.tags(spark, sf)).select("id", "version")


def commit_log(spark, sf):
    """No merges, in a time range, touching any of two directories."""
    log = G.commit_log(
        S.commits(spark, sf),
        S.changed_files(spark, sf),
        since="2024-01-03 00:00:00",
        until="2024-01-20 00:00:00",
        paths=["economy", "old/promo/Brand#1"],
    )
    return log.select("id", T.slash_date(F.col("ts")).alias("date"))


def listed_commits(spark, sf):
    ids = S.changed_files(spark, sf).filter(F.startswith("path", F.lit("old/"))).select("id")
    return G.listed_commits(S.commits(spark, sf), ids).select("id")


def changed_files(spark, sf):
    return G.files_changed(S.changes(spark, sf))


def release_tags(spark, sf):
    """Tags of the hours, those of odd days without a time."""
    day = F.dayofmonth("ts")
    return G.release_tags(S.tags(spark, sf).withColumn("ts", F.when(day % 2 == 0, F.col("ts")))).select("tag")


def merged_list(spark, sf):
    """Corpus source of a list of commits: merges that are listed stay."""
    ids = S.commits(spark, sf).filter("id % 3 = 0").select("id")
    return G.commit_log(G.listed_commits(S.commits(spark, sf), ids), merges=True).select("id", "n_parents")


QUERIES = {
    "release_tags": (release_tags, f"with {S.SQL_TAGS} select tag from tags where day(ts) % 2 = 0"),
    "merged_list": (
        merged_list,
        "select event_id as id, case when event_type = 'error' then 2 else 1 end as n_parents from events where event_id % 3 = 0",
    ),
    "release_asof": (
        release_asof,
        f"""with {S.SQL_TAGS}, {SQL_RELEASES}
select event_id as id, coalesce(tag, 'rc') as release from events e asof left join releases r on e.ts >= r.ts""",
    ),
    "describe": (
        describe,
        f"""with {S.SQL_TAGS}, one as (select ts, max(tag) as tag from tags group by ts)
select event_id as id, tag as version,
       case when tag is not null then row_number() over (partition by o.ts, tag order by e.ts, event_id) end as n_since
from events e asof left join one o on e.ts >= o.ts""",
    ),
    "latest_per_major": (latest_per_major, f"with {SQL_STABLE} select series, n.tag as tag from newest"),
    "stable_commits": (
        stable_commits,
        f"""with {SQL_STABLE}, one as (select ts, max(tag) as tag from tags group by ts),
described as (select event_id as id, e.ts, n_parents, tag as version
              from (select *, case when event_type = 'error' then 2 else 1 end as n_parents from events) e
              asof left join one o on e.ts >= o.ts)
select id, version from described d
where n_parents <= 1 and exists (select 1 from ranges r where d.ts > r.since and d.ts <= r.until)
  and not regexp_matches(coalesce(version, ''), '-rc|-pre')""",
    ),
    "commit_log": (
        commit_log,
        f"""with {S.SQL_FILES}
select event_id as id, strftime(ts, '%Y/%m/%d') as date from events
where event_type <> 'error' and ts > timestamp '2024-01-03' and ts <= timestamp '2024-01-20'
  and event_id in (select id from files where path = 'economy' or starts_with(path, 'economy/')
                   or path = 'old/promo/Brand#1' or starts_with(path, 'old/promo/Brand#1/'))""",
    ),
    "listed_commits": (
        listed_commits,
        f"with {S.SQL_FILES} select event_id as id from events where event_id in (select id from files where starts_with(path, 'old/'))",
    ),
    "changed_files": (changed_files, f"with {S.SQL_FILES} select id, path from files"),
}
