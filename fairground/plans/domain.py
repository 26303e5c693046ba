"""Binds the warehouse tables to the event domain, once for all operators.

Nations are cities, regions countries, suppliers venues, parts events, shipping days
occurrences, first order lines ticket offers. ``DOMAIN_SQL`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses that the public sees.
PUBLIC_STATUSES = ("published", "cancelled", "postponed", "sold_out")


class Domain:
    """Frames of the event domain over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self, only: DataFrame | None = None) -> DataFrame:
        """Order lines, or those of the events of ``only`` (event_id; a page's, so few enough to be broadcast)."""
        rows = self.table("lineitem")
        return rows if only is None else rows.join(F.broadcast(only.select(F.col("event_id").alias("l_partkey"))), "l_partkey", "left_semi")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy for each row: dealt to all cores if its files are fewer."""
        rows, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

    def countries(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("country_name"))

    def cities(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.alias("city_id"),
            F.col("n_name").alias("city_name"),
            F.col("n_regionkey").alias("country_id"),
            ((n * 37) % 121 - 60).cast("double").alias("city_lat"),
            ((n * 71) % 341 - 170).cast("double").alias("city_lon"),
            (n * 7919 % 1000 * 5000).cast("long").alias("population"),
        )

    def venues(self) -> DataFrame:
        s = F.col("s_suppkey")
        near = lambda base, k: F.when(s % 5 != 0, F.col(base) + (s * k % 100 - 50) / F.lit(1000.0))
        return (
            self.table("supplier")
            .join(self.cities(), F.col("s_nationkey") == F.col("city_id"))
            .select(
                s.alias("venue_id"),
                F.col("s_name").alias("venue_name"),
                F.col("s_nationkey").alias("venue_city_id"),
                near("city_lat", 13).alias("venue_lat"),
                near("city_lon", 17).alias("venue_lon"),
                F.when(s % 3 != 0, s * 37 % 900 + 50).alias("venue_capacity"),
                (s % 7 != 0).alias("is_public"),
            )
        )

    def events(self, only: DataFrame | None = None, hosts: bool = True) -> DataFrame:
        """Events, or those of ``only``; without ``hosts`` no order line is read and no venue is told."""
        p = F.col("p_partkey")
        status = F.when(p % 20 == 3, "draft").when(p % 20 == 5, "cancelled").when(p % 20 == 9, "sold_out").when(p % 20 == 11, "postponed").otherwise("published")
        rows = self.table("part")
        if only is not None:
            rows = rows.join(F.broadcast(only.select(F.col("event_id").alias("p_partkey"))), "p_partkey", "left_semi")
        if hosts:
            rows = rows.join(self.lines(only).groupBy(F.col("l_partkey").alias("hosted")).agg(F.min("l_suppkey").alias("host")), p == F.col("hosted"), "left")
        venue = [F.when(p % 11 != 0, F.col("host")).alias("event_venue_id")] if hosts else []
        return rows.select(
            p.alias("event_id"),
            F.concat(F.lit("event-"), p.cast("string")).alias("slug"),
            F.concat_ws(" ", "p_name", "p_brand").alias("title"),
            F.lower("p_type").alias("category_slug"),
            F.split("p_name", " ").alias("genres"),
            (p % 10 == 0).alias("is_free"),
            (p % 3 == 0).alias("is_verified"),
            (p % 50 == 7).alias("is_demo"),
            status.alias("status"),
            *venue,
            (p % 25).cast("int").alias("event_city_id"),
            F.when(p % 6 != 0, p % 4 == 0).alias("wheelchair"),
        )

    def occurrences(self, only: DataFrame | None = None) -> DataFrame:
        e = F.col("event_id")
        days = F.datediff(F.col("starts_at"), F.lit("1992-01-01"))
        return (
            self.lines(only)
            .select(F.col("l_partkey").alias("event_id"), F.col("l_shipdate").alias("starts_at"))
            .distinct()
            .select(
                (e * 100000 + days).alias("occurrence_id"),
                "event_id",
                "starts_at",
                F.when(e % 4 != 0, F.col("starts_at") + F.expr("interval 3 hours")).alias("ends_at"),
                F.when(e % 2 == 0, (e * 7 % 1400 - 700) / F.lit(10.0)).alias("occ_lat"),
                F.when(e % 2 == 0, (e * 11 % 3600 - 1800) / F.lit(10.0)).alias("occ_lon"),
                F.when(e % 4 == 1, e * 31 % 500).alias("occ_capacity"),
            )
        )

    def offers(self, only: DataFrame | None = None) -> DataFrame:
        return (
            self.lines(only)
            .where("l_linenumber = 1")
            .select(
                F.col("l_partkey").alias("event_id"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price_min"),
                F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price_max"),
                (F.col("l_discount") == 0).alias("offer_free"),
                (F.col("l_returnflag") != "N").alias("has_url"),
                (F.col("l_linestatus") == "F").alias("sold_out"),
            )
        )

    def deliveries(self) -> DataFrame:
        """Ad delivery and journey rows from the event stream."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), (k % 10).alias("campaign_id"))


DOMAIN_SQL = """
country as (select r_regionkey as country_id, r_name as country_name from region),
city as (
  select n_nationkey as city_id, n_name as city_name, n_regionkey as country_id,
         cast((n_nationkey * 37) % 121 - 60 as double) as city_lat, cast((n_nationkey * 71) % 341 - 170 as double) as city_lon,
         cast(n_nationkey * 7919 % 1000 * 5000 as bigint) as population
  from nation),
venue as (
  select s_suppkey as venue_id, s_name as venue_name, s_nationkey as venue_city_id,
         case when s_suppkey % 5 <> 0 then city_lat + (s_suppkey * 13 % 100 - 50) / 1000.0::double end as venue_lat,
         case when s_suppkey % 5 <> 0 then city_lon + (s_suppkey * 17 % 100 - 50) / 1000.0::double end as venue_lon,
         case when s_suppkey % 3 <> 0 then s_suppkey * 37 % 900 + 50 end as venue_capacity,
         s_suppkey % 7 <> 0 as is_public
  from supplier join city on city_id = s_nationkey),
event as (
  select p_partkey as event_id, 'event-' || p_partkey as slug, p_name || ' ' || p_brand as title, lower(p_type) as category_slug,
         string_split(p_name, ' ') as genres, p_partkey % 10 = 0 as is_free, p_partkey % 3 = 0 as is_verified,
         p_partkey % 50 = 7 as is_demo,
         case p_partkey % 20 when 3 then 'draft' when 5 then 'cancelled' when 9 then 'sold_out' when 11 then 'postponed' else 'published' end as status,
         case when p_partkey % 11 <> 0 then host end as event_venue_id, cast(p_partkey % 25 as integer) as event_city_id,
         case when p_partkey % 6 <> 0 then p_partkey % 4 = 0 end as wheelchair
  from part left join (select l_partkey, min(l_suppkey) as host from lineitem group by 1) on l_partkey = p_partkey),
occurrence as (
  select event_id * 100000 + date_diff('day', timestamp '1992-01-01', starts_at) as occurrence_id, event_id, starts_at,
         case when event_id % 4 <> 0 then starts_at + interval 3 hour end as ends_at,
         case when event_id % 2 = 0 then (event_id * 7 % 1400 - 700) / 10.0::double end as occ_lat,
         case when event_id % 2 = 0 then (event_id * 11 % 3600 - 1800) / 10.0::double end as occ_lon,
         case when event_id % 4 = 1 then event_id * 31 % 500 end as occ_capacity
  from (select distinct l_partkey as event_id, l_shipdate as starts_at from lineitem)),
offer as (
  select l_partkey as event_id, l_extendedprice * (1 - l_discount) as price_min,
         case when l_returnflag <> 'R' then l_extendedprice end as price_max,
         l_discount = 0 as offer_free, l_returnflag <> 'N' as has_url, l_linestatus = 'F' as sold_out
  from lineitem where l_linenumber = 1),
delivery as (
  select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k,
         cast(json_extract_string(props, '$.k') as bigint) % 10 as campaign_id
  from events),
offer_summary as (
  select event_id, min(case when offer_free then 0 else coalesce(price_min, price_max) end) as offer_from,
         max(case when offer_free then 0 else coalesce(price_max, price_min) end) as offer_to,
         bool_or(offer_free or (has_url and not sold_out)) as offer_tickets
  from offer group by event_id),
point as (
  select o.occurrence_id, o.event_id, e.slug, e.title, e.category_slug, e.genres, o.starts_at, o.ends_at,
         v.venue_id, v.venue_name, v.is_public, c.city_id, c.city_name, c.country_id, e.is_free, e.is_verified, e.is_demo, e.status,
         coalesce(s.offer_from, case when e.is_free then 0 end) as price_from,
         coalesce(s.offer_to, case when e.is_free then 0 end) as price_to,
         coalesce(s.offer_tickets, false) or e.is_free as has_tickets,
         coalesce(o.occ_capacity, v.venue_capacity) as capacity, coalesce(e.wheelchair, false) as wheelchair,
         case when o.occ_lat is not null and o.occ_lon is not null then 'exact'
              when v.venue_lat is not null and v.venue_lon is not null then 'venue' else 'city' end as location_precision,
         coalesce(o.occ_lat, v.venue_lat, c.city_lat) as plain_lat, coalesce(o.occ_lon, v.venue_lon, c.city_lon) as plain_lon,
         coalesce(o.occ_lat, v.venue_lat, c.city_lat + (('0x' || substr(md5(e.event_id::varchar), 1, 2))::int / 255.0::double - 0.5) * 0.012) as latitude,
         coalesce(o.occ_lon, v.venue_lon, c.city_lon + (('0x' || substr(md5(e.event_id::varchar), 3, 2))::int / 255.0::double - 0.5) * 0.018) as longitude
  from occurrence o join event e on e.event_id = o.event_id
  left join venue v on v.venue_id = e.event_venue_id
  left join city c on c.city_id = coalesce(v.venue_city_id, e.event_city_id)
  left join offer_summary s on s.event_id = e.event_id)
"""


def sql(body: str) -> str:
    """``body`` with the domain's relations before it; ``with`` is given."""
    return f"with {DOMAIN_SQL.strip()}{', ' if body.lstrip().startswith('++') else ' '}{body.lstrip().removeprefix('++')}"
