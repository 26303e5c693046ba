"""Further queries: scalars, scores, zones, identities, documents, guards and streams, with their SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, hashes, text, times
from ..operators import discovery, ingest, lanes, scores, taxonomy
from ..streaming import invalidation, runs
from .catalog import RANGE, YEAR, query
from .catalog_work import _JOBS, NOW, _jobs
from .domain import sql

FNV_SQL = "list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


_AXIS = "list_reduce(list_prepend(2166136261::ubigint, list_transform(list_filter(string_split(s_name, ''), lambda c, i: i % 2 = {0}), lambda c: unicode(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(f"select s_suppkey, {FNV_SQL.format('s_name')}::bigint as fnv, md5(s_name) as md5, sha256(s_name) as sha, round(({_AXIS.format(1)} / 4294967295.0::double - 0.5) * 0.012, 12) as d_lat, round(({_AXIS.format(0)} / 4294967295.0::double - 0.5) * 0.018, 12) as d_lon from supplier")
def op_m04_m05_m06_hashes(d):
    name = F.col("s_name")
    return d.table("supplier").select("s_suppkey", hashes.fnv1a(name).alias("fnv"), F.md5(name.cast("binary")).alias("md5"), F.sha2("s_name", 256).alias("sha"), F.round(hashes.coordinate_offset(name, 0), 12).alias("d_lat"), F.round(hashes.coordinate_offset(name, 1), 12).alias("d_lon"))


_LANGS = ("fr", "de", "it", "es", "pt", "nl")
_SAY = " ".join(
    f"when {i} then '{o}' || p_name || '{v}' || case when c is null then '{e}' else replace('{k}', '{{category}}', c) end || case when w is null then '.' else '{a}' || w || '.' end || '{m}'"
    for i, x in enumerate(_LANGS) for o, v, e, k, a, m in [scores.SENTENCES.get(x, scores.SENTENCES["en"])]
)
_LANDS = ("CH", "DE", "XK", "MX", "MA", "QQ")


@query(f"""
with p as (select *, case when p_partkey % 5 <> 0 then lower(p_type) end as c, case when p_partkey % 7 <> 0 then p_brand end as w from part)
select p_partkey, case p_partkey % 4 when 0 then 'cancelled' when 1 then 'sold_out' when 2 then 'postponed' else 'scheduled' end as status,
  case p_partkey % 6 when 0 then 'CHF' when 1 then 'EUR' when 2 then 'EUR' when 3 then 'MXN' when 4 then 'MAD' end as currency, case p_partkey % 6 {_SAY} end as sentence from p""")
def op_f14_f20_f22_f27_normalised(d):
    p = F.col("p_partkey")
    raw = F.when(p % 4 == 0, "Cancelled!").when(p % 4 == 1, "SOLD  OUT").when(p % 4 == 2, "Reporté").otherwise("ok")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), (p % 6 + 1).cast("int"))
    told = scores.sentence(of(_LANGS), F.col("p_name"), F.when(p % 5 != 0, F.lower("p_type")), F.when(p % 7 != 0, F.col("p_brand")))
    return d.table("part").select("p_partkey", scores.normal_status(raw).alias("status"), scores.currency(of(_LANDS)).alias("currency"), told.alias("sentence"))


@query("""
with z as (select o_orderkey, o_orderdate + to_minutes((720 + o_custkey % 480)::int) as ts, case o_custkey % 4 when 0 then 'Europe/Zurich' when 1 then 'America/New_York' when 2 then 'Asia/Tokyo' else 'UTC' end as zone from orders)
select o_orderkey, timezone(zone, timezone('UTC', ts))::date::varchar as local_day, timezone('UTC', timezone(zone, ts)) as instant from z""")
def op_d01_d02_d03_zones(d):
    """A zone that isn't known falls back to the city's, then to UTC, before any conversion."""
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(720 + F.col("o_custkey") % 480).cast("int"))
    k = F.col("o_custkey") % 4
    raw = F.when(k == 0, "Europe/Zurich").when(k == 1, "Nowhere/Land").when(k == 2, "").otherwise("Mars")
    city = F.when(k == 1, "America/New_York").when(k == 2, "Asia/Tokyo").otherwise("also bad")
    rows = d.table("orders").select("o_orderkey", at.alias("ts"), raw.alias("zone"), city.alias("city_zone"))
    zoned = scores.valid_zone(rows, "zone", "city_zone")
    return zoned.select("o_orderkey", F.to_date(F.convert_timezone(F.lit("UTC"), F.col("valid_zone"), F.col("ts"))).cast("string").alias("local_day"), F.convert_timezone(F.col("valid_zone"), F.lit("UTC"), F.col("ts")).alias("instant"))


@query("""
with q as (select p_partkey, least(100, greatest(0, 44 + case when p_size > 10 then 10 else 0 end + 12 + case when p_partkey % 4 <> 0 then 8 else 0 end + case when p_partkey % 2 = 0 then 3 else 0 end - case when p_partkey % 5 = 0 then 8 else 0 end - case when p_partkey % 6 = 0 then 4 else 0 end)) as s,
  least(100, 55 + case when p_partkey % 2 = 0 then 15 else 0 end + case when p_partkey % 3 = 0 then 10 else 0 end + case when p_partkey % 5 = 0 then 8 else 0 end + case when p_partkey % 7 = 0 then 7 else 0 end + case when p_partkey % 11 = 0 then 5 else 0 end) as place from part)
select p_partkey, s::int as score, s < 48 as rejected, place::int as place_score from q""")
def op_m15_m16_m17_quality_variants(d):
    p = F.col("p_partkey")
    some = lambda test: F.when(test, "x")
    none = F.lit(None).cast("string")
    base = taxonomy.event_quality(some(F.col("p_size") > 10), F.lit("x"), some(p % 4 != 0), none, none, none, none, F.lit(False))
    score = scores.adjusted_quality(base, p % 2 == 0, p % 5 == 0, p % 6 == 0)
    return d.table("part").select("p_partkey", score.alias("score"), (score < 48).alias("rejected"), scores.place_quality(p % 2 == 0, p % 3 == 0, p % 5 == 0, p % 7 == 0, p % 11 == 0).alias("place_score"))


@query(sql("""++
ident as (select event_id, 'canonical' as kind, 'c' || event_id % 700 as value, event_id % 13 as seen from event union all select event_id, 'fingerprint', 'f' || event_id % 500, event_id % 7 from event union all select event_id, 'external', 'x' || event_id % 900, event_id % 5 from event),
best as (select kind, value, event_id from ident qualify row_number() over (partition by kind, value order by seen, event_id) = 1)
select o_orderkey as id, coalesce(c.event_id, f.event_id, x.event_id) as event_id from orders
left join best c on c.kind = 'canonical' and c.value = 'c' || o_custkey left join best f on f.kind = 'fingerprint' and f.value = 'f' || (o_orderkey % 800) left join best x on x.kind = 'external' and x.value = 'x' || (o_orderkey % 1100)"""))
def op_j21_r06_three_identities(d):
    e = F.col("event_id")
    kinds = lambda k, n, m: d.events().select("event_id", F.lit(k).alias("kind"), F.concat(F.lit(k[0] if k != "external" else "x"), (e % n).cast("string")).alias("value"), (e % m).alias("seen"))
    ident = kinds("canonical", 700, 13).unionByName(kinds("fingerprint", 500, 7)).unionByName(kinds("external", 900, 5))
    asked = d.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("canonical"), F.concat(F.lit("f"), (F.col("o_orderkey") % 800).cast("string")).alias("fingerprint"), F.concat(F.lit("x"), (F.col("o_orderkey") % 1100).cast("string")).alias("external"))
    return scores.resolve_identity(asked, ident, ["canonical", "fingerprint", "external"]).select("id", "event_id")


@query(sql(f"""++
best as (select event_id, min(price_min) as cheapest from offer where has_url group by 1)
select p.occurrence_id, b.cheapest as ticket_price, count(*) over (partition by p.venue_id) as n_at_venue from point p left join best b using (event_id)"""))
def op_j05_j07_j25_top_ticket(d):
    """A top-1 of each event and a count of each venue joined to the rows, not asked row by row."""
    rows = discovery.points(d, offers=False)
    best = d.offers().where("has_url").groupBy("event_id").agg(F.min("price_min").alias("ticket_price"))
    at_venue = rows.groupBy("venue_id").agg(F.count("*").alias("n_at_venue")).withColumnRenamed("venue_id", "v")
    return rows.join(best, "event_id", "left").join(at_venue, F.col("venue_id").eqNullSafe(F.col("v"))).select("occurrence_id", "ticket_price", "n_at_venue")


@query(sql("""select v.venue_id, '{"id":' || v.venue_id || ',"name":"' || venue_name || '","city":"' || city_name || '"' || case when venue_capacity is not null then ',"capacity":' || venue_capacity else '' end || ',"near":[' || venue_city_id || ',' || country_id || ']}' as document from venue v join city on city_id = venue_city_id"""))
def op_k07_n04_n09_n10_documents(d):
    """JSON documents; absent values are left out."""
    v = d.venues().join(d.cities(), F.col("venue_city_id") == F.col("city_id"))
    doc = F.struct(F.col("venue_id").alias("id"), F.col("venue_name").alias("name"), F.col("city_name").alias("city"), F.col("venue_capacity").alias("capacity"), F.array("venue_city_id", "country_id").alias("near"))
    return v.select("venue_id", F.to_json(doc).alias("document"))


@query("select c_custkey, c_name from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') order by list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD'], c_mktsegment), c_acctbal < 0 desc, c_acctbal desc, c_custkey limit 400")
def op_l09_l10_n03_rank_by_position(d):
    order = F.array(*map(F.lit, ("MACHINERY", "BUILDING", "HOUSEHOLD")))
    rows = d.table("customer").where(F.array_contains(order, F.col("c_mktsegment")))
    return rows.orderBy(F.array_position(order, F.col("c_mktsegment")), (F.col("c_acctbal") < 0).desc(), F.desc("c_acctbal"), "c_custkey").limit(400).select("c_custkey", "c_name")


@query(f"with {_JOBS} select job_id from jobs where error is distinct from 'error 3' and not regexp_matches(domain, '^d[0-9]$') and status in ('failed', 'queued') and (available_at is null or available_at <= {NOW})")
def op_p03_p12_p27_predicates(d):
    j = _jobs(d)
    return j.where(~F.col("error").eqNullSafe("error 3") & ~F.col("domain").rlike("^d[0-9]$") & F.col("status").isin("failed", "queued") & (F.col("available_at").isNull() | (F.col("available_at") <= F.lit(datetime(1998, 6, 1)).cast("timestamp_ntz")))).select("job_id")


#: Hosts, and whether they are public.
_HOSTS = {"10.1.2.3": False, "box.local": False, "172.20.1.1": False, "172.32.1.1": True, "localhost": False, "100.64.0.1": False, "100.128.0.1": True, "192.0.2.9": False, "198.18.0.1": False, "203.0.113.7": False, "224.0.0.1": False, "8.8.8.8": True, "8.8.8.300": False, "site.onion": False, "[::1]": False, "[fe80::1]": False, "[2606:4700::1111]": True, "plain": False, "a..b": False, "A.Example.ORG": True, "x_y.org": False, "": False}


@query(f"""with h as (select * from (values {', '.join(f"({i}, '{h}', {str(f).lower()})" for i, (h, f) in enumerate(_HOSTS.items()))}) t(i, host, public))
select page_id, host, public from pages join h on i = page_id % {len(_HOSTS)}""")
def op_p31_public_hosts(d):
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    return d.table("pages").select("page_id", host.alias("host"), scores.public_host(host).alias("public"))


@query("""
with g as (select o_custkey, list(distinct o_orderstatus order by o_orderstatus) as a, list(distinct o_orderpriority order by o_orderpriority) as b from orders group by 1)
select o_custkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as united, array_to_string(list_slice(b, 1, 2), ',') as part, len(a) as n, a[1] as first from g""")
def op_u03_u05_u06_n05_arrays(d):
    g = d.table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("a"), F.array_sort(F.collect_set("o_orderpriority")).alias("b"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("united"), F.array_join(F.slice("b", 1, 2), ",").alias("part"), F.size("a").cast("long").alias("n"), F.try_element_at("a", F.lit(1)).alias("first"))


_LOCALES = ["fr-CH", "en", "de-CH", "es", "it", "pt-BR", "nl", "pl", "ru", "tr", "id", "ar", "hi", "ja", "ko", "zh", "xx"]
_JUNE = {"fr": "juin", "en": "June", "de": "Juni", "es": "junio", "it": "giugno", "pt": "junho", "nl": "juni", "pl": "czerwiec", "ru": "июнь", "tr": "Haziran", "id": "Juni", "ar": "يونيو", "hi": "जून", "ja": "6月", "ko": "6월", "zh": "六月"}
_quoted = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query(sql(f"""++
f(language, family, phrase) as (values {_quoted(lanes.phrase_rows())}), june(language, month) as (values {_quoted(_JUNE.items())}),
names as (select [{', '.join(f"'{x}'" for x in lanes.FAMILIES)}] as families),
c as (select city_id, city_name, city_name || ', ' || country_name as place, {_LOCALES} as l, floor(date_diff('day', date '1970-01-01', date '1998-06-01') / 7.0)::bigint as week from city join country using (country_id)),
b as (select city_id, place, week, [l[city_id % 17 + 1], l[(city_id + 5) % 17 + 1]] as two, {FNV_SQL.format('city_name')}::bigint as h, {FNV_SQL.format('place')}::bigint as hp from c),
t as (select *, two[(h + week) % 2 + 1] as raw from b),
u as (select *, case when split_part(raw, '-', 1) = 'xx' then 'en' else split_part(raw, '-', 1) end as language, case when raw = 'xx' then 'en' else raw end as locale from t),
q as (select u.*, 'day' as scope, 'general' as family, k + 1 as day from u, range(7) r(k)
  union all select u.*, 'month', families[(hp + week * 8 + k) % 11 + 1], 1 from u, names, range(8) r(k) union all select u.*, 'year', 'festivals', 1 from u)
select city_id, locale, scope, family, replace(replace(replace(replace(phrase, '{{place}}', place), '{{day}}', day::varchar), '{{month}}', month), '{{year}}', '1998') as query from q join f using (language, family) join june using (language)"""))
def op_c06_search_lanes(d):
    n, known = F.col("city_id"), F.array(*map(F.lit, _LOCALES))
    two = F.array(F.element_at(known, n % 17 + 1), F.element_at(known, (n + 5) % 17 + 1))
    cities = d.cities().join(d.countries(), "country_id").select("city_id", "city_name", "country_name", two.alias("locales"))
    return lanes.search_lanes(cities, date(1998, 6, 1))


@query(f"with {_JOBS}, b as (select domain, bool_or(status = 'failed') as open from jobs where campaign_id = 3 group by 1) select domain, coalesce(open, false) as open, count(*) filter (where status = 'queued') as queued from jobs left join b using (domain) group by 1, 2")
def op_a27_breaker_status(d):
    j = _jobs(d)
    opened = j.where("campaign_id = 3").groupBy("domain").agg(F.bool_or(F.col("status") == "failed").alias("open"))
    counts = j.groupBy("domain").agg(F.count_if(F.col("status") == "queued").alias("queued"))
    return counts.join(opened, "domain", "left").select("domain", F.coalesce("open", F.lit(False)).alias("open"), "queued")


@query("select ts::date::varchar as day, count(*) filter (where event_type = 'view') as views, count(*) filter (where event_type = 'error') as errors, count(distinct user_id) as users from events group by 1")
def op_a28_daily_guard(d):
    return d.table("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


@query("with t as (select max(ts) as until from events) select event_id, epoch_ms(until - ts) < 86400000 as last_day from events, t")
def op_s19_j12_singleton(d):
    one = d.table("events").agg(F.max("ts").alias("until"))
    gap = F.unix_millis(F.col("until").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    return d.table("events").crossJoin(F.broadcast(one)).select("event_id", (gap < 86400000).alias("last_day"))


@query("with s as (select event_id, ts::varchar as ts_text, value::varchar as value_text, case when event_id % 9 = 0 then 'bad' else event_id::varchar end as raw from events) select event_id, try_cast(raw as bigint) as id, try_cast(value_text as double) as value from s")
def op_s18_p02_staging(d):
    raw = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("event_id").cast("string"))
    return d.table("events").select("event_id", raw.try_cast("bigint").alias("id"), F.col("value").cast("string").try_cast("double").alias("value"))


@query("""
with r as (select user_id, event_id, floor(epoch(ts))::bigint as sec, row_number() over (partition by user_id order by ts, event_id) as place from events)
select user_id, event_id, max(sec - 600 * place) over (partition by user_id order by place) + 600 * place as slot_s from r""")
def op_t14_spacing(d):
    return runs.spaced_requests(d.table("events"), 600)


def _stream(d):
    return runs.source(d.spark, f"{d.sf_dir}/events.parquet", d.table("events"))


@query("select user_id, sum(case when event_type in ('signup', 'purchase') then 1 when event_type = 'error' then -1 else 0 end)::bigint as net, greatest(0, sum(case when event_type in ('signup', 'purchase') then 1 when event_type = 'error' then -1 else 0 end))::bigint as counter from events group by 1")
def op_t01_t02_k11_stream_counter(d):
    return runs.latest(runs.drain(runs.signed_counter(_stream(d), "user_id"), "complete"), ["user_id"])


@query("select distinct user_id, event_type, ts::date::varchar as day from events")
def op_t04_t13_stream_first_of_day(d):
    return runs.drain(runs.distinct_deliveries(_stream(d)), "append").select("user_id", "event_type", "day")


@query("select time_bucket(interval 15 minute, ts) - to_minutes(15 * k) as window_start, count(*) as n, count(*) filter (where event_type = 'error') as errors from events, range(6) r(k) group by 1")
def op_t12_stream_sliding(d):
    out = runs.latest(runs.drain(runs.sliding_errors(_stream(d)), "update"), ["window_start"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _whole_stream(d):
    """The stream and an end that its watermark reaches, so that all rows come out."""
    return runs.with_end(_stream(d), f"{d.sf_dir}/events.parquet")


@query(None)
def op_t06_stream_breaker(d):
    return runs.drain(runs.circuit_breaker(_whole_stream(d)), "append").where("user_id >= 0")


@query(None)
def op_t03_stream_quota(d):
    """At most 60 of a client's points an hour; an event costs as much as its id says."""
    asked = _whole_stream(d).select("ts", F.when(F.col("user_id") >= 0, F.col("user_id") % 20).otherwise(-1).alias("client"), F.col("event_id").alias("request_id"), (F.col("event_id") % 30).alias("amount"))
    return runs.drain(runs.stream_quota(asked), "append").where("client >= 0").select("request_id", "accepted")


@query("""
with recursive e as (
  select user_id as job_id, event_type = 'purchase' as done, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('purchase', 'error', 'view') and user_id is not null
), run(job_id, n, attempts, until, told, attempts_told, at_ms) as (
  select distinct job_id, 0::bigint, 0, -1::bigint, null::varchar, 0, null::bigint from e
  union all
  select e.job_id, e.n, case when e.done and r.until >= e.us // 1000 then 0 when e.done or r.until >= e.us // 1000 then r.attempts else r.attempts + 1 end,
    case when e.done and r.until >= e.us // 1000 then -1 when e.done or r.until >= e.us // 1000 then r.until else e.us // 1000 + 86400000 end, case when e.done and r.until >= e.us // 1000 then 'done' end, r.attempts, e.us // 1000
  from run r join e on e.job_id = r.job_id and e.n = r.n + 1
), held as (select job_id, attempts, until, min(n) as n from run where until >= 0 group by 1, 2, 3), ended as (select job_id, max(n) as n from e group by 1)
select job_id, attempts_told as attempts, told as outcome, at_ms, null::bigint as available_ms from run where told = 'done'
union all
select h.job_id, h.attempts, 'requeued', h.until, h.until + 1000 * least(300, 5 * pow(2, h.attempts - 1))::bigint from held h
where not exists (select 1 from run r where r.job_id = h.job_id and r.told = 'done' and r.n > h.n and r.at_ms <= h.until)""")
def op_t07_stream_leases(d):
    """Each user is a job: views and errors take its lease for a day, purchases end it."""
    kinds = _whole_stream(d).where(F.col("event_type").isin("purchase", "error", "view"))
    events = kinds.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "done").otherwise("lease").alias("kind"))
    return runs.drain(runs.leases(events, 86_400), "append")


@query(None)
def op_t06_breaker(d):
    return runs.breaker_batch(d.table("events"))


@query(None)
def op_f02_f12_normal_ratio(d):
    """NFC and the longest-blocks ratio of neighbouring venue names."""
    v = d.venues().select("venue_id", "venue_name")
    w = v.select((F.col("venue_id") - 1).alias("venue_id"), F.col("venue_name").alias("next_name"))
    return v.join(w, "venue_id").select("venue_id", hashes.nfc(F.col("venue_name")).alias("name"), hashes.block_ratio(F.col("venue_name"), F.col("next_name")).alias("ratio"))


_WORDS = "' ' || trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) || ' '"
_ALIASES = ", ".join(f"case when contains(w, ' {a} ') then '{g}' end" for a, g in ingest.GENRE_ALIASES)


@query(f"""
with t as (select p_partkey, p_name || case p_partkey % 5 when 0 then ' Hip-Hop / RAP & house' when 1 then ' drum and bass, afro beat' when 2 then ' opera: classique jazz blues rock metal punk indie pop' else '' end as x from part),
l as (select p_partkey, list_filter([{_ALIASES}], lambda v: v is not null) as g from (select p_partkey, {_WORDS} as w from t))
select p_partkey, array_to_string(list_slice(list_filter(g, lambda v, i: list_position(g, v) = i), 1, 8), ',') as genres from l""")
def op_f19_alias_genres(d):
    k = F.col("p_partkey") % 5
    extra = F.when(k == 0, " Hip-Hop / RAP & house").when(k == 1, " drum and bass, afro beat").when(k == 2, " opera: classique jazz blues rock metal punk indie pop").otherwise("")
    return d.table("part").select("p_partkey", F.array_join(ingest.alias_genres(F.concat("p_name", extra)), ",").alias("genres"))


@query(sql("""++
p as (select venue_id, case when venue_id % 2 = 0 then 'es ' else 'FR' end as country, case venue_id % 5 when 0 then null when 1 then 40.4 when 2 then -3.7 when 3 then 28.1 else 95.0 end::double as lat, case venue_id % 5 when 0 then 1.0 when 1 then -3.7 when 2 then 40.4 when 3 then -15.4 else 0.0 end::double as lon from venue),
f as (select *, upper(trim(country)) = 'ES' as spain, coalesce((lat between 35 and 44.5 and lon between -10 and 5) or (lat between 27 and 30 and lon between -19 and -13), false) as ok, coalesce((lon between 35 and 44.5 and lat between -10 and 5) or (lon between 27 and 30 and lat between -19 and -13), false) as turned, coalesce(lat between -90 and 90 and lon between -180 and 180, false) as global from p)
select venue_id, case when (spain and ok) or (not spain and global) then lat when spain and turned then lon end as latitude, case when (spain and ok) or (not spain and global) then lon when spain and turned then lat end as longitude, spain and not ok and turned as swapped, case when spain then ok or turned else global end as valid from f"""))
def op_m20_axis_swap(d):
    v, k = d.venues(), F.col("venue_id") % 5
    lat = F.when(k == 0, None).when(k == 1, 40.4).when(k == 2, -3.7).when(k == 3, 28.1).otherwise(95.0)
    lon = F.when(k == 0, 1.0).when(k == 1, -3.7).when(k == 2, 40.4).when(k == 3, -15.4).otherwise(0.0)
    country = F.when(F.col("venue_id") % 2 == 0, "es ").otherwise("FR")
    return v.select("venue_id", ingest.spanish_pair(country, lat.cast("double"), lon).alias("p")).select("venue_id", "p.*")


@query("""
with c as (select o_orderkey as id, case o_orderkey % 6 when 0 then ' x ' when 1 then 'Menu' else 'Jazz festival ' || o_orderkey end as title,
  case o_orderkey % 5 when 0 then 'soon' when 1 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as start, o_orderdate as d, o_orderkey % 5 as k, o_orderkey % 4 as m, o_orderkey % 3 as n from orders),
s as (select *, least(100, 44 + case when (k = 1) or (k > 1 and m = 1) then 10 else 0 end + case when m <> 0 then 12 else 0 end + case when n <> 0 then 8 else 0 end + case when m = 2 then 8 else 0 end + 4) as base,
  trim(title) as t from c),
q as (select *, greatest(0, least(100, case when t in ('x', 'Menu') then base - 4 else base end + case when m = 3 then 3 else 0 end - case when n = 1 then 8 else 0 end - case when m = 1 then 4 else 0 end))::int as quality from s)
select id, quality, case when length(t) < 3 then 'invalid_title' when t = 'Menu' then 'navigation_or_commerce' when k = 0 then 'invalid_start_date'
  when d < timestamp '1998-05-30' or d > timestamp '1998-06-01' + interval 730 day then 'outside_ingestion_window' when quality < 48 then 'quality_below_threshold:' || quality end as reason,
  case when k <> 0 then d end as starts_at, case when k = 1 then d + interval 1 day when k > 1 and m = 1 then d + interval 2 hour end as ends_at from q""")
def op_c08_normalise_candidates(d):
    key = F.col("o_orderkey")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    k, m, n, at = key % 5, key % 4, key % 3, F.col("o_orderdate")
    rows = d.table("orders").select(
        key.alias("id"),
        F.when(key % 6 == 0, " x ").when(key % 6 == 1, "Menu").otherwise(F.concat(F.lit("Jazz festival "), key.cast("string"))).alias("title"),
        F.when(k == 0, "soon").when(k == 1, F.date_format(at, "yyyy-MM-dd")).otherwise(iso(at)).alias("start"),
        F.when((k > 1) & (m == 1), iso(at + F.expr("interval 2 hours"))).when((k > 1) & (m == 2), iso(at - F.expr("interval 2 hours"))).alias("end"),
        F.when(m != 0, "hall").alias("venue"), F.when(n == 1, "Génève").when(n == 2, "ZÜRICH").alias("city"), F.lit("zurich").alias("source_city"),
        F.when(m == 2, "a description of forty characters or so, really").otherwise("short").alias("description"),
        F.when(m == 1, "https://other.net/x").alias("url"), F.lit("https://site.org/list").alias("page_url"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("tickets"), F.lit("").alias("category"), F.lit(None).cast("string").alias("status"), F.lit(1.0).alias("latitude"), F.lit(None).cast("double").alias("longitude"), (m == 3).alias("structured"),
    )
    return ingest.normalise(rows, datetime(1998, 6, 1)).select("id", "quality", "reason", "starts_at", "ends_at")


@query("""
with t(category, event_categories, defaults, child, child_values) as (values ('music', ['concerts', 'festivals'], ['music'], 'jazz', ['jazz', 'blues']), ('music', ['concerts', 'festivals'], ['music'], 'rock', ['rock']), ('food', ['gastronomy'], ['food', 'markets'], 'wine', ['wine'])),
s as (select c_custkey as user, case c_custkey % 2 when 0 then 'music' else 'food' end as category, case c_custkey % 4 when 0 then ['jazz', 'wine'] when 1 then ['wine'] else []::varchar[] end as children from customer)
select "user", array_to_string(list_sort(any_value(event_categories)), ',') as categories,
  array_to_string(list_sort(case when count(*) filter (where list_contains(children, child)) > 0 then flatten(list(child_values) filter (where list_contains(children, child))) else any_value(defaults) end), ',') as "values"
from s join t using (category) group by 1""")
def op_c03_c04_taxonomy_filters(d):
    rows = [("music", ["concerts", "festivals"], ["music"], "jazz", ["jazz", "blues"]), ("music", ["concerts", "festivals"], ["music"], "rock", ["rock"]), ("food", ["gastronomy"], ["food", "markets"], "wine", ["wine"])]
    tree = d.spark.createDataFrame(rows, "category string, event_categories array<string>, defaults array<string>, child string, child_values array<string>")
    k = F.col("c_custkey")
    chosen = d.table("customer").select(k.alias("user"), F.when(k % 2 == 0, "music").otherwise("food").alias("category"), F.when(k % 4 == 0, F.array(F.lit("jazz"), F.lit("wine"))).when(k % 4 == 1, F.array(F.lit("wine"))).otherwise(F.array().cast("array<string>")).alias("children"))
    out = ingest.expanded_filters(chosen, tree)
    return out.select("user", F.array_join("categories", ",").alias("categories"), F.array_join("values", ",").alias("values"))


@query("""select p_partkey as event_id, case when p_partkey % 3 <> 2 and (p_partkey % 10 = 0 or p_partkey % 7 = 1) then 'stale' else case p_partkey % 3 when 0 then 'machine' when 1 then 'reviewed' else 'missing' end end as translation_status from part""")
def op_t16_stale_translations(d):
    p = F.col("p_partkey")
    before = d.table("part").select(p.alias("event_id"), F.col("p_name").alias("title"), F.when(p % 7 != 1, p).alias("venue"))
    after = d.table("part").select(p.alias("event_id"), F.when(p % 10 == 0, "new").otherwise(F.col("p_name")).alias("title"), p.alias("venue"))
    told = d.table("part").select(p.alias("event_id"), F.when(p % 3 == 0, "machine").when(p % 3 == 1, "reviewed").otherwise("missing").alias("translation_status"))
    return ingest.stale_translations(told, before, after, ["title", "venue"])


@query("""
with link as (select 'venue' as kind, p_partkey % 1500 as id, p_partkey as event_id from part union all select 'organizer', p_partkey % 300, p_partkey from part where p_partkey % 4 > 0 union all select 'performer', p_partkey % 400, p_partkey from part),
c as (select case event_type when 'purchase' then 'venue' when 'view' then 'organizer' when 'click' then 'performer' when 'error' then 'offer' else 'event' end as kind, case when event_type in ('signup', 'error') then event_id else user_id end as id, ts,
  case event_type when 'purchase' then event_id % 3 > 0 when 'view' then event_id % 7 = 0 when 'click' then event_id % 5 = 0 when 'signup' then event_id % 2 = 0 else true end as touches from events),
m as (select event_id, max(ts) as ts from (select id as event_id, ts from c where touches and kind in ('event', 'offer') union all select event_id, ts from c join link using (kind, id) where touches) group by 1),
t as (select p_partkey as event_id, lang as language, case (p_partkey + length(lang)) % 3 when 0 then 'machine' when 1 then 'reviewed' else 'original' end as s, timestamp '2024-01-01' + to_days((p_partkey % 31)::int) as made from part, (values ('de'), ('rm-ch')) v(lang))
select t.event_id, language, case when s <> 'original' and ts >= made then 'stale' else s end as translation_status from t left join m using (event_id)""")
def op_t16_stream_invalidation(d):
    """The event stream as changes of events, offers, venues, organizers and performers, beside the translations of all parts."""
    e, p, kind = F.col("event_id"), F.col("p_partkey"), F.col("event_type")
    told = F.when(kind == "purchase", "venue").when(kind == "view", "organizer").when(kind == "click", "performer").when(kind == "error", "offer").otherwise("event")
    touches = F.when(kind == "purchase", e % 3 > 0).when(kind == "view", e % 7 == 0).when(kind == "click", e % 5 == 0).otherwise(e % 2 == 0)
    field = F.when(told == "event", "title").when(told == "performer", "bio").otherwise("description")
    changes = _stream(d).select(
        told.alias("kind"), F.when(kind.isin("signup", "error"), e).otherwise(F.col("user_id")).alias("id"), "ts",
        F.create_map(field, F.lit("old"), F.lit("rank"), F.lit("1")).alias("before"), F.create_map(field, F.when(touches, "new").otherwise("old"), F.lit("rank"), F.lit("2")).alias("after"),
    )
    parts = d.table("part")
    linked = invalidation.links(parts.select(p.alias("event_id"), (p % 1500).alias("venue_id"), F.when(p % 4 > 0, p % 300).alias("organizer_id")), parts.select(p.alias("event_id"), (p % 400).alias("performer_id")))
    language = F.explode(F.array(F.lit("de"), F.lit("rm-ch")))
    state = (p + F.length("language")) % 3
    made = (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((p % 31).cast("int"))).cast("timestamp")
    translations = parts.select("p_partkey", language.alias("language")).select(p.alias("event_id"), "language", F.when(state == 0, "machine").when(state == 1, "reviewed").otherwise("original").alias("translation_status"), made.alias("updated_at"))
    return invalidation.with_marks(translations, invalidation.follow(changes, linked, translations)).drop("updated_at")


@query(sql("select occurrence_id, title, starts_at from point where status in ('published', 'cancelled', 'postponed', 'sold_out') and starts_at between timestamp '1997-02-07 18:00:00' and timestamp '1997-02-09 23:59:00' order by starts_at, occurrence_id limit 50"))
def op_d07_l01_l02_quick_range(d):
    start, end = times.quick_range("weekend", datetime(1997, 2, 5, 9))
    return discovery.discover(d, discovery.Filters(start=start, end=end, limit=50)).select("occurrence_id", "title", "starts_at")


@query(sql("select occurrence_id, price_from, capacity from point where status in ('published', 'cancelled', 'postponed', 'sold_out') and starts_at between timestamp '1997-01-01' and timestamp '1997-12-31' and (is_free or price_from is not null) and price_from >= 40 and capacity between 201 and 800 order by starts_at, occurrence_id limit 1500"))
def op_m23_c05_m12_bands(d):
    return discovery.discover(d, discovery.from_bands(replace(YEAR, limit=9999), "over-40", "club")).select("occurrence_id", "price_from", "capacity")


@query(sql("""select v.venue_id, venue_name from venue v join city on venue_city_id = city_id where contains(lower(coalesce(venue_name, '')), '_1') or contains(lower(coalesce(city_name, '')), '_1') or contains(lower(coalesce(case when venue_capacity is not null then 'hall_1' end, '')), '_1x')"""))
def op_p22_any_column(d):
    v = d.venues().join(d.cities(), F.col("venue_city_id") == F.col("city_id")).withColumn("note", F.when(F.col("venue_capacity").isNotNull(), "hall_1"))
    return v.where(discovery.any_column_matches(" _1", ["venue_name", "city_name"]) | discovery.any_column_matches("_1X", ["note"])).select("venue_id", "venue_name")


@query(sql("""select e.event_id, round((('0x' || substr(md5(e.event_id::varchar), 1, 2))::int / 255.0::double - 0.5) * 0.012, 9) as d_lat, round((('0x' || substr(md5(e.event_id::varchar), 3, 2))::int / 255.0::double - 0.5) * 0.018, 9) as d_lon, coalesce(s.offer_tickets, false) as tickets from event e left join offer_summary s using (event_id)"""))
def op_m03_m13_a05_jitter(d):
    rows = d.events().join(discovery.offer_summary(d.offers()), "event_id", "left")
    return rows.select("event_id", F.round(geo.jitter(F.col("event_id"), 0, 0.012), 9).alias("d_lat"), F.round(geo.jitter(F.col("event_id"), 1, 0.018), 9).alias("d_lon"), F.coalesce("offer_tickets", F.lit(False)).alias("tickets"))


@query(sql(f"++ p as (select * from point where {RANGE} and latitude between -50.625 and 50.625 and longitude between -22.5 and 112.5) select count(*) as n, count(distinct city_id) as cities, (select max(n) from (select count(*) as n from p group by city_id)) as busiest from p"))
def op_m10_m11_p29_p30_w07_snapped_viewport(d):
    """A moved viewport asks for the same whole cells; a held box that contains it can answer it."""
    box = geo.Viewport(-20.0, -50.0, geo.wrap_longitude(470.0), 50.0).snapped(6)
    assert box.contains(geo.Viewport(-22.0, -50.0, 111.0, 49.0))
    p = discovery.points(d, discovery.Filters(), offers=False).where(box.holds(F.col("latitude"), F.col("longitude")))
    busiest = p.groupBy("city_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("busiest"))
    return p.agg(F.count("*").alias("n"), F.count_distinct("city_id").alias("cities")).crossJoin(F.broadcast(busiest))


@query("""select c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"' || case when c_acctbal > 0 then ',"rating":' || (c_custkey % 5) else '' end || '}' as details from customer""")
def op_n11_n09_whitelist(d):
    """Only listed fields of a JSON document are let through; absent ones are left out."""
    c = d.table("customer")
    raw = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("secret").alias("password"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 5).alias("rating"), F.lit("x").alias("tracker")))
    listed = F.from_json("raw", "name string, segment string, rating bigint")
    return c.select("c_custkey", raw.alias("raw")).select("c_custkey", F.to_json(listed).alias("details"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as opens from events),
s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, session""")
def op_t17_stream_sessions(d):
    """Sessions of users, 30 minutes apart: an extension, as the ids are otherwise given."""
    out = runs.last_batch(runs.drain(runs.user_sessions(_stream(d), delay=None), "complete"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
