"""Queries for resolution in steps, merges, files, limits and positions, with their SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import documents, surface
from ..functions.geo import Viewport
from ..functions.text import fold_sql
from ..operators import discovery, fulltext, identity, merging, ordering, rekeying
from ..sources import web
from ..sources.shared import stored
from ..streaming import runs
from .catalog import FOLD_SQL, MINUTE, RANGE, query
from .domain import sql

_TRI = lambda table, name: f"{table} as (select name, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i::int, 3))))) as g from {name})"
_JACCARD = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::double"

#: Records that come in (events 1, 5, 9, ...) and events that are known (the others), at odd minutes, some without city or venue.
_RECORDS = f"""++
k as (select occurrence_id as id, event_id, title, starts_at + to_minutes(occurrence_id % 40) as "at", case when event_id % 5 <> 0 then city_id end as city_id, case when event_id % 3 <> 0 then venue_id end as venue_id, sha256(title || {MINUTE}) as fingerprint from point where event_id % 4 <> 1),
a as (select occurrence_id as id, event_id, title || case when event_id % 8 = 1 then ' x' else '' end as title, starts_at + to_minutes(occurrence_id % 17) as "at", case when event_id % 7 <> 0 then city_id end as city_id, case when event_id % 9 <> 0 then venue_id end as venue_id,
  's' || event_id % 3 as source, 'x' || event_id % 700 as external_id, sha256(title || {MINUTE}) as fingerprint from point where event_id % 4 = 1),
records as (select 's' || event_id % 3 as source, 'x' || event_id % 900 as external_id, event_id, timestamp '1998-01-01' + to_days((event_id % 50)::int) as seen from event where event_id % 4 = 2)"""
_TITLES = f"""
names as (select distinct {FOLD_SQL.format('title')} as name from (select title from a union all select title from k)),
{_TRI('tri', 'names')},
close as (select x.name as name, y.name as name_2, {_JACCARD.format('x.g', 'y.g')} as titles from tri x, tri y where len(x.g) >= 0.9 * len(y.g) - 1e-6 and len(y.g) >= 0.9 * len(x.g) - 1e-6 and titles >= 0.9),
met as (select a.id, k.id as id_2, k.event_id, titles, abs(floor(epoch(a."at"))::bigint - floor(epoch(k."at"))::bigint) as gap_s
  from a join close c on c.name = {FOLD_SQL.format('a.title')} join k on {FOLD_SQL.format('k.title')} = c.name_2 and abs(epoch(a."at") - epoch(k."at")) <= 900
  where (a.city_id is null or k.city_id is null or a.city_id = k.city_id) and (a.venue_id is null or k.venue_id is null or a.venue_id = k.venue_id))"""


def _records(d):
    p, e = discovery.points(d, offers=False), F.col("event_id")
    later = lambda n: F.col("starts_at") + F.make_dt_interval(mins=(F.col("occurrence_id") % n).cast("int"))
    mark = F.sha2(F.concat("title", F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm")), 256).alias("fingerprint")
    known = p.where(e % 4 != 1).select(F.col("occurrence_id").alias("id"), "event_id", "title", later(40).alias("at"), F.when(e % 5 != 0, F.col("city_id")).alias("city_id"), F.when(e % 3 != 0, F.col("venue_id")).alias("venue_id"), mark)
    asked = p.where(e % 4 == 1).select(
        F.col("occurrence_id").alias("id"), F.concat("title", F.when(e % 8 == 1, " x").otherwise("")).alias("title"), later(17).alias("at"), F.when(e % 7 != 0, F.col("city_id")).alias("city_id"), F.when(e % 9 != 0, F.col("venue_id")).alias("venue_id"),
        F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"), F.concat(F.lit("x"), (e % 700).cast("string")).alias("external_id"), mark,
    )
    seen = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")) + F.make_dt_interval((e % 50).cast("int"))
    records = d.events(hosts=False).where(e % 4 == 2).select(F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"), F.concat(F.lit("x"), (e % 900).cast("string")).alias("external_id"), "event_id", seen.alias("seen"))
    return asked, known, records


@query(sql(f"{_RECORDS}, {_TITLES} select id, id_2, round(titles, 6) as titles, gap_s from met"))
def op_j17_tolerant_pairs(d):
    asked, known, _ = _records(d)
    pairs = identity.tolerant_pairs(asked.select("id", "title", "at", "city_id", "venue_id"), known.select("id", "title", "at", "city_id", "venue_id"))
    return pairs.select("id", "id_2", F.round("titles", 6).alias("titles"), "gap_s")


@query(sql(f"""{_RECORDS}, {_TITLES},
by_id as (select a.id, arg_min(r.event_id, {{'a': -epoch(r.seen), 'b': r.event_id}}) as e from a join records r using (source, external_id) join k on k.event_id = r.event_id and abs(epoch(a."at") - epoch(k."at")) <= 900 group by 1),
by_print as (select fingerprint, min(event_id) as e from k group by 1),
by_title as (select id, arg_min(event_id, {{'a': -round(titles, 6), 'b': gap_s, 'c': event_id}}) as e from met group by 1)
select a.id, coalesce(i.e, p.e, t.e) as event_id, case when i.e is not null then 'id' when p.e is not null then 'fingerprint' when t.e is not null then 'title' end as matched_by
from a left join by_id i on i.id = a.id left join by_print p on p.fingerprint = a.fingerprint left join by_title t on t.id = a.id"""))
def op_r05_match_order(d):
    return identity.resolve_events(*_records(d))


_ADDRESS = "case when {0} % 6 <> 0 then ({0} % 50) || ' Main Street, house ' || ({0} % 7) end"


@query(sql(f"""++
v as (select s_suppkey as venue_id, s_nationkey as city_id, {FOLD_SQL.format('s_name')} as name, {_ADDRESS.format('s_suppkey')} as address from supplier),
a as (select s_suppkey as id, s_nationkey as city_id, 'x' || s_suppkey % 97 as external_id, {FOLD_SQL.format('s_name')} || case s_suppkey % 4 when 0 then '' when 1 then ' a' else ' and more words' end as name, case when s_suppkey % 5 = 0 then 'elsewhere' else coalesce({_ADDRESS.format('s_suppkey')}, 'nowhere') end as address from supplier),
m as (select 'x' || s_suppkey % 97 as external_id, min(s_suppkey + 1) as venue_id from supplier where s_suppkey % 10 = 0 group by 1),
names as (select name from v union select name from a union select coalesce({FOLD_SQL.format('address')}, '') from v union select {FOLD_SQL.format('address')} from a), {_TRI('tri', 'names')},
p as (select a.id, v.venue_id, v.address is null as open, {_JACCARD.format('x.g', 'y.g')} as n, {_JACCARD.format('s.g', 't.g')} as t from a join v on v.city_id = a.city_id join tri x on x.name = a.name join tri y on y.name = v.name join tri s on s.name = coalesce({FOLD_SQL.format('v.address')}, '') join tri t on t.name = {FOLD_SQL.format('a.address')}),
best as (select id, arg_min(venue_id, {{'a': -round(n, 6), 'b': -round(coalesce(t, 0), 6), 'c': venue_id}}) as venue_id from p where n >= 0.88 and (open or t >= 0.55) group by 1)
select a.id, coalesce(m.venue_id, best.venue_id) as venue_id, case when m.venue_id is not null then 'id' when best.venue_id is not null then 'name' end as matched_by from a left join m using (external_id) left join best on best.id = a.id"""))
def op_r12_venue_steps(d):
    s, key = d.table("supplier"), F.col("s_suppkey")
    street = F.when(key % 6 != 0, F.concat((key % 50).cast("string"), F.lit(" Main Street, house "), (key % 7).cast("string")))
    outside = F.concat(F.lit("x"), (key % 97).cast("string")).alias("external_id")
    venues = s.select(key.alias("venue_id"), F.col("s_nationkey").alias("city_id"), F.col("s_name").alias("name"), street.alias("address"))
    name = F.concat("s_name", F.when(key % 4 == 0, "").when(key % 4 == 1, " a").otherwise(" and more words"))
    asked = s.select(key.alias("id"), F.col("s_nationkey").alias("city_id"), outside, name.alias("name"), F.when(key % 5 == 0, "elsewhere").otherwise(F.coalesce(street, F.lit("nowhere"))).alias("address"))
    mapping = s.where(key % 10 == 0).select(outside, (key + 1).alias("venue_id"))
    return identity.resolve_venues(asked, venues, mapping)


@query(sql("""++
c as (select event_id as duplicate, event_id - 1 as event_id from event where event_id % 10 in (2, 3)),
root as (select duplicate, case when duplicate % 10 = 3 then duplicate - 2 else event_id end as event_id from c),
l as (select l_orderkey * 10 + l_linenumber as id, l_partkey as event_id, l_suppkey as venue, l_quantity from lineitem),
child as (select min(id) as id, event_id, venue, count(*) as n from l group by event_id, venue),
moved as (select child.id, coalesce(r.event_id, child.event_id) as event_id, venue, n, r.event_id is null as own from child left join root r on r.duplicate = child.event_id),
kept as (select * from moved where own or event_id in (select event_id from root) qualify own or row_number() over (partition by event_id, venue order by own desc, id) = 1)
select id, event_id, venue, n from kept"""))
def op_r10_merge_children(d):
    """Children of merged duplicates are given to the event that stays, unless it has the like."""
    e = F.col("event_id")
    canonical = d.events(hosts=False).where((e % 10).isin(2, 3)).select(e.alias("duplicate"), F.when(e % 10 == 3, e - 2).otherwise(e - 1).alias("event_id"))
    lines = d.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("venue"))
    children = lines.groupBy("event_id", "venue").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "event_id", "venue", "n")
    return identity.merge_into(canonical, children, "id", ["venue"])


@query(None)
def op_r08_ratio_duplicates(d):
    """Records merged by key, or by longest matching blocks; without SQL, which has no such ratio."""
    p = discovery.points(d, offers=False)
    rows = p.select(F.col("occurrence_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "slug").otherwise(F.col("slug")).alias("slug"), "title", F.col("venue_name").alias("venue"), (F.col("starts_at") + F.make_dt_interval(mins=(F.col("occurrence_id") % 40).cast("int"))).alias("at"))
    return identity.ratio_duplicates(rows.withColumnRenamed("slug", "key"))


def _in_turn(d):
    p, o = discovery.points(d, offers=False), F.col("occurrence_id")
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("slug-"), (F.col("event_id") % 500).cast("string")))
    return p.select(o.alias("id"), key.alias("key"), "title", F.when(o % 5 != 0, F.col("venue_name")).alias("venue"), (F.col("starts_at") + F.make_dt_interval(mins=(o % 40).cast("int"))).alias("at"), (o * 37 % 101).cast("double").alias("quality"))


@query(None)
def op_r07_merge_in_turn(d):
    """Records by time, each beside what was merged so far, with those to be looked at; without SQL, as each outcome rests on those before."""
    return merging.settled(_in_turn(d))


@query(None)
def op_r08_merge_in_turn(d):
    """The same by longest matching blocks and without review; without SQL for the same reason."""
    return merging.settled(_in_turn(d), "blocks").select("id", "entry", "verdict")


_LINKS = {c: (a, b) for c, a, b in (("venue_url", 3, 1), ("ticket_url", 5, 2), ("image_url", 7, 4))}
_STATUS = "case when o_orderkey % 11 = 3 then 'cancelled' when o_orderkey % 13 = 5 then 'postponed' when o_orderkey % 4 > 0 then 'scheduled' end"


def _joined(p, o):
    """What the primary record and another one come to, as a DuckDB struct."""
    agree = f"({p}.c is null or {o}.c is null or {p}.c = {o}.c)"
    longest = lambda f: f"'{f}': case when {p}.{f} is null or length({o}.{f}) > length({p}.{f}) then coalesce({o}.{f}, {p}.{f}) else {p}.{f} end"
    bound = lambda f, g: f"'{f}': case when {agree} then {g}({p}.{f}, {o}.{f}) else {p}.{f} end"
    both = f"list_concat({p}.g, {o}.g)"
    return ", ".join([
        f"{{'q': {p}.q, 'title': {p}.title, 'starts_at': {p}.starts_at", longest("description"), longest("venue"), *[f"'{c}': coalesce({p}.{c}, {o}.{c})" for c in _LINKS],
        bound("lo", "least"), bound("hi", "greatest"), f"'c': coalesce({p}.c, {o}.c)", f"'st': case when {o}.st <> 'scheduled' then {o}.st else {p}.st end", f"'free': {p}.free or {o}.free",
        f"'g': list_filter({both}, lambda x, i: list_position({both}, x) = i)[:8]}}",
    ])


@query(f"""
with r as (select o_custkey as entry, o_orderkey as turn, {{'q': (o_orderkey * 37 % 23)::double, 'title': o_orderpriority || ' ' || o_orderkey, 'starts_at': o_orderdate, 'description': case when o_orderkey % 3 > 0 then o_orderpriority || ' ' || o_orderkey % 10 end, 'venue': case when o_orderkey % 7 > 1 then repeat('v', (o_orderkey % 5 + 1)::int) || o_orderkey % 9 end,
  {", ".join(f"'{c}': case when o_orderkey % {a} = {b} then 'https://x.org/' || o_orderkey end" for c, (a, b) in _LINKS.items())},
  'lo': case when o_orderkey % 5 <> 2 then o_totalprice end, 'hi': case when o_orderkey % 6 <> 1 then o_totalprice * 2 end, 'c': case o_orderkey % 4 when 0 then 'CHF' when 1 then 'EUR' end, 'st': coalesce({_STATUS}, 'scheduled'), 'free': o_orderkey % 17 = 0,
  'g': list_distinct([o_orderstatus, o_orderpriority, 'g' || o_orderkey % 12]).list_sort()}} as x from orders),
m as (select entry, count(*) as n_records, list_reduce(list(x order by turn), lambda s, r: case when r.q > s.q then {_joined("r", "s")} else {_joined("s", "r")} end) as x from r group by entry)
select entry, n_records, x.q as quality, x.title, x.starts_at, x.description, x.venue, {", ".join(f"x.{c}" for c in _LINKS)}, x.lo as price_min, x.hi as price_max, x.c as currency, x.st as status, x.free as is_free, array_to_string(x.g, ',') as genres from m""")
def op_r09_rich_merge(d):
    """A customer's orders as records of one event, by their ids."""
    k, none = F.col("o_orderkey"), F.lit(None)
    digit = lambda n: (k % n).cast("string")
    given = {
        "entry": F.col("o_custkey"), "turn": k, "quality": (k * 37 % 23).cast("double"), "title": F.concat_ws(" ", "o_orderpriority", k.cast("string")), "starts_at": F.col("o_orderdate"), "description": F.when(k % 3 > 0, F.concat_ws(" ", "o_orderpriority", digit(10))),
        "venue": F.when(k % 7 > 1, F.concat(F.repeat(F.lit("v"), (k % 5 + 1).cast("int")), digit(9))), **{c: F.when(k % a == b, F.concat(F.lit("https://x.org/"), k.cast("string"))) for c, (a, b) in _LINKS.items()},
        "price_min": F.when(k % 5 != 2, F.col("o_totalprice")), "price_max": F.when(k % 6 != 1, F.col("o_totalprice") * 2), "currency": F.when(k % 4 == 0, "CHF").when(k % 4 == 1, "EUR"), "status": F.expr(_STATUS), "is_free": k % 17 == 0,
        "genres": F.array_sort(F.array_distinct(F.array("o_orderstatus", "o_orderpriority", F.concat(F.lit("g"), digit(12))))), "warnings": F.array().cast("array<string>"), "performers": none.cast("array<struct<name:string,type:string,image_url:string,is_headliner:boolean>>"),
    }
    rest = {c: none.cast("string") for c in (*merging.LONGEST, *merging.FIRST, "access_notes") if c not in given} | {c: F.lit(False) for c in ("wheelchair", "hearing_loop")}
    out = merging.merged_fields(d.table("orders").select(*[v.alias(c) for c, v in (given | rest).items()]))
    return out.select("entry", "n_records", "quality", "title", "starts_at", "description", "venue", *_LINKS, "price_min", "price_max", "currency", "status", "is_free", F.array_join("genres", ",").alias("genres"))


_WORDS = lambda x: f"list_distinct(list_filter(string_split_regex({fold_sql(f'coalesce({x}, {chr(39) * 2})')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""
with e as (select p_partkey as event_id, p_name || ' ' || p_brand as title, p_type as short, text as body, p_name as genres from part left join documents on doc_id = p_partkey),
t as (select event_id, {_WORDS("title")} as a, {_WORDS("short || ' ' || genres")} as b, {_WORDS("body")} as c from e),
w as (select event_id, a, b, c, list_distinct(list_concat(list_concat(a, b), c)) as every from t),
q as (select p_partkey as query_id, {_WORDS("split_part(p_name, ' ', 2) || ' ' || p_type || ' ' || coalesce(split_part(text, ' ', 3), '') || '  ' || p_type")} as words from part left join documents on doc_id = p_partkey where p_partkey % 20 = 0)
select query_id, event_id, len(words) as n_words, case when list_has_any(words, a) then 'A' when list_has_any(words, b) then 'B' else 'C' end as strongest from q, w where len(words) > 0 and list_has_all(every, words)""")
def op_p09_full_text(d):
    """Parts as events whose descriptions are the documents; each twentieth part asks for words of its name, type and text."""
    p, text = F.col("p_partkey"), d.table("documents").select(F.col("doc_id").alias("p_partkey"), "text")
    rows = d.table("part").join(text, "p_partkey", "left")
    events = rows.select(p.alias("event_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_type").alias("short_description"), F.col("text").alias("description"), F.split("p_name", " ").alias("genres"))
    asked = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type", F.split_part("text", F.lit(" "), F.lit(3)), F.lit(""), "p_type")
    # Splitting texts is heavy for each row, and a small file is one task: it is dealt to all cores, by event, so that the words are counted without another shuffle.
    index = stored(fulltext.postings(events.repartition("event_id")), "postings")
    return fulltext.matches(index, rows.where(p % 20 == 0).select(p.alias("query_id"), asked.alias("text")))


@query(sql("""++
c as (select event_id as duplicate, case event_id % 10 when 2 then event_id - 1 when 3 then event_id - 1 else event_id - 4 end as event_id from event where event_id % 10 in (2, 3, 7)),
root as (select duplicate, duplicate // 10 * 10 + 1 as event_id from c where duplicate % 10 <> 7 union all select duplicate, duplicate // 10 * 10 + 1 from c where duplicate % 10 = 7),
l as (select l_partkey as event_id, l_suppkey % 40 as who, l_shipdate as starts_at, l_orderkey * 10 + l_linenumber as id, l_quantity as n, l_returnflag as flag from lineitem),
one as (select event_id, who, min(id) as id, bool_or(flag = 'R') as head, arg_min(case when n > 20 then n end, id) filter (where n > 20) as low from l group by 1, 2),
act as (select coalesce(r.event_id, o.event_id) as e, who, case when r.event_id is null then 0 else 1 end as moved, o.event_id as source, head, low, id from one o left join root r on r.duplicate = o.event_id),
ev as (select event_id, title, is_free, case when event_id % 3 <> 1 then event_id % 7 end as city, repeat('d', (event_id % 4)::int) || event_id as about, event_id % 90 as quality, genres from event),
em as (select coalesce(r.event_id, v.event_id) as e, case when r.event_id is null then 0 else 1 end as moved, v.* from ev v left join root r on r.duplicate = v.event_id)
select 'performers' as name, e as event_id, who::varchar as key, coalesce(arg_min(bool_or_head, {'m': 0}), false)::varchar || '|' || coalesce(arg_max(lowest, {'m': 0})::varchar, '') || '|' || min(first_id)::varchar as value
from (select e, who, bool_or(head) as bool_or_head, arg_max(low::int, {'m': moved, 's': source, 'i': id}) filter (where low is not null) as lowest, arg_min(id, {'m': moved, 's': source, 'i': id}) as first_id from act group by e, who) group by e, who
union all select 'events', e, '', arg_min(title, {'m': moved, 's': event_id}) || '|' || bool_or(is_free)::varchar || '|' || coalesce(arg_min(city, {'m': moved, 's': event_id}) filter (where city is not null)::varchar, '') || '|' || arg_min(about, {'l': -length(about), 'm': moved, 's': event_id}) || '|' || max(quality)::varchar || '|' || array_to_string(list_sort(list_distinct(flatten(list(genres)))), ',') from em group by e
union all select 'offers', coalesce(r.event_id, l.event_id), '', count(*)::varchar from l left join root r on r.duplicate = l.event_id group by coalesce(r.event_id, l.event_id)"""))
def op_r10_merge_everywhere(d):
    """Chains of duplicates (7 to 3 to 2 to 1 in each ten), and what becomes of events, performers and offers."""
    e, k = F.col("event_id"), F.col("event_id") % 10
    known = d.events(hosts=False)
    canonical = known.where(k.isin(2, 3, 7)).select(e.alias("duplicate"), F.when(k == 7, e - 4).otherwise(e - 1).alias("event_id"))
    events = known.select(
        "event_id", "title", "is_free", F.when(e % 3 != 1, e % 7).alias("city_id"), F.concat(F.repeat(F.lit("d"), (e % 4).cast("int")), e.cast("string")).alias("description"), (e % 90).alias("quality"), "genres",
    )
    lines = d.table("lineitem").select(F.col("l_partkey").alias("event_id"), (F.col("l_suppkey") % 40).alias("performer_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("n"), F.col("l_returnflag").alias("flag"))
    low = F.when(F.col("n") > 20, F.col("n").cast("int"))
    acts = lines.groupBy("event_id", "performer_id").agg(F.min("id").alias("id"), F.bool_or(F.col("flag") == "R").alias("is_headliner"), F.min_by(low, F.when(low.isNotNull(), F.col("id"))).alias("low"))
    rules = {**rekeying.RULES, "performers": rekeying.Rule(("performer_id",), {"is_headliner": "any", "low": "last"}, "id")}
    out = rekeying.merge_everywhere(canonical, {"events": events, "performers": acts, "offers": lines.select("event_id")}, rules)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    value = lambda *cs: F.concat_ws("|", *[text(c) for c in cs])
    return (
        out["performers"].select(F.lit("performers").alias("name"), "event_id", text("performer_id").alias("key"), value("is_headliner", "low", "id").alias("value"))
        .unionByName(out["events"].withColumn("genres", F.array_join(F.array_sort("genres"), ",")).select(F.lit("events").alias("name"), "event_id", F.lit("").alias("key"), value("title", "is_free", "city_id", "description", "quality", "genres").alias("value")))
        .unionByName(out["offers"].groupBy("event_id").agg(F.count("*").cast("string").alias("value")).select(F.lit("offers").alias("name"), "event_id", F.lit("").alias("key"), "value"))
    )


_DELTA = "case when event_type in ('signup', 'purchase') then 1 when event_type = 'error' then -1 else 0 end"


@query(f"""
with s as (select user_id, sum({_DELTA}) over (partition by user_id order by ts, event_id rows unbounded preceding) as s, {_DELTA} as delta from events)
select user_id, sum(delta)::bigint as net, (sum(delta) - least(0, min(s)))::bigint as counter from s group by 1""")
def op_t02_clamped_counter(d):
    e = d.table("events")
    delta = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return ordering.clamped_counters(e.select("user_id", "ts", "event_id", delta.alias("delta")), "user_id", "ts", "event_id")


@query("select o_orderkey, row_number() over (order by o_orderdate, o_totalprice desc, o_orderkey) as position from orders")
def op_w09_global_position(d):
    return ordering.global_position(d.table("orders"), F.col("o_orderdate"), [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "position")


@query("""
select event_id, case event_id % 5 when 0 then 1 when 1 then 3 when 2 then 0 when 3 then 2 else 12 end::int as depth, case event_id % 5 when 0 then 2 when 1 then 6 when 2 then 1 when 3 then 1 + 40 + 1 else 12 end::int as nodes,
  event_id % 5 in (0, 1, 2) as taken from events""")
def op_n12_json_limits(d):
    k, props = F.col("event_id") % 5, F.col("props")
    nested = F.lit("[" * 12 + "]" * 12)
    flat = F.concat(F.lit('{"a": ['), F.array_join(F.array_repeat(F.lit("1"), 40), ","), F.lit("]}"))
    doc = F.when(k == 0, props).when(k == 1, F.concat(F.lit('{"a,[": [1, {"b": "x\\"]}"}, '), F.lit("null]}"))).when(k == 2, F.lit(' "[[[" ')).when(k == 3, flat).otherwise(nested)
    shape = documents.json_shape(F.col("doc"))
    return d.table("events").select("event_id", doc.alias("doc")).select("event_id", shape.alias("s"), documents.within_limits(F.col("doc"), depth=10, nodes=41).alias("taken")).select("event_id", "s.depth", "s.nodes", "taken")


_TAB = "\t"


@query("select left(n_name, 2) as code, n_name as name, n_nationkey * 1000 as population, case when n_nationkey % 2 = 0 then 'de,fr' else '' end as languages, n_nationkey::bigint as geonames_id from nation")
def op_s08_country_file(d):
    """Lines of a country file, made from the nations, with comments between."""
    n = F.col("n_nationkey").cast("string")
    cells = [F.left("n_name", F.lit(2)), F.lit("III"), F.lit("1"), F.lit("F"), F.col("n_name"), F.lit("Capital"), F.lit("12.5"), (F.col("n_nationkey") * 1000).cast("string"), *[F.lit("x")] * 7, F.when(F.col("n_nationkey") % 2 == 0, "de,fr").otherwise(""), n, F.lit(""), F.lit("")]
    lines = d.table("nation").select(F.explode(F.array(F.lit("# a comment"), F.concat_ws(_TAB, *cells), F.lit("short\tline"))).alias("value"))
    return web.parse_countries(lines).select("code", "name", F.col("population").cast("int").alias("population"), F.array_join("languages", ",").alias("languages"), "geonames_id")


@query("select n_nationkey::bigint as geonames_id, n_name as name, (n_nationkey % 90)::double as latitude, n_nationkey * 10::bigint as population, n_nationkey % 3 = 0 as is_capital from nation where n_nationkey % 4 <> 3")
def op_s09_city_archive(d):
    """Lines of a city file in a zip archive, made from the nations of each region."""
    n = F.col("n_nationkey")
    cells = [n.cast("string"), F.col("n_name"), F.col("n_name"), F.lit('a"b,c'), (n % 90).cast("double").cast("string"), F.lit("1.5"), F.when(n % 4 == 3, "H").otherwise("P"), F.when(n % 3 == 0, "PPLC").otherwise("PPL"), F.lit("CH"), F.lit(""), F.lit("GE"), *[F.lit("")] * 3, (n * 10).cast("string"), F.lit(""), F.lit("1"), F.lit("UTC"), F.lit("2026-01-01")]
    files = d.table("nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat_ws(_TAB, *cells)), "\n").alias("text"))

    @F.pandas_udf("binary")
    def zipped(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("cities.txt", text)
            return out.getvalue()

        return texts.map(one)

    return web.parse_cities(web.unzipped_lines(files.select(zipped("text").alias("content")))).select("geonames_id", "name", "latitude", "population", "is_capital")


@query(sql(f"select occurrence_id, title, venue_name, city_name from point where {RANGE} and not is_demo and latitude between -40 and 60 and longitude between -100 and 100 and list_has_any(genres, ['red', 'blue']) and (is_free or price_from is not null) and price_from <= 30000 order by starts_at, occurrence_id limit 60"))
def op_c12_viewport_filters(d):
    """A viewport takes all filters but radius, city and country, which the box stands for."""
    f = discovery.Filters(genres=("red", "blue"), priced_only=True, price_max=30000, city_id=3, country_id=1, latitude=1.0, longitude=1.0, radius_km=5, limit=60)
    return discovery.discover_viewport(d, Viewport(-100, -40, 100, 60), f).select("occurrence_id", "title", "venue_name", "city_name")


@query(None)
def op_t03_weighted_quota(d):
    """Requests of 0 to 24 units against 40 an hour; without SQL, as what is refused uses nothing up."""
    e = d.table("events")
    return runs.weighted_quota(e.select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id"), (F.col("event_id") % 25).cast("int").alias("amount")), hourly=40)


@query(sql(f"""++
r as (select n_nationkey as city, timestamp '1997-01-01' + to_days(n_nationkey) as since from nation)
select r.city, p.occurrence_id, {FOLD_SQL.format('p.title')} as title, substr(trim(regexp_replace({FOLD_SQL.format('p.title')}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 20) as slug
from r join point p on p.city_id = r.city and p.starts_at between r.since and r.since + interval 40 day and p.status in ('published', 'cancelled', 'postponed', 'sold_out')"""))
def op_sql_event_lists(d):
    """The list of each city from its own day on: a table function beside the cities, which becomes a join."""
    surface.register(d.spark, discovery.points(d, offers=False))
    d.table("nation").createOrReplaceTempView("listed_cities")
    return d.spark.sql("""
        select r.city, e.occurrence_id, folded(e.title) as title, slug(e.title, 20) as slug
        from (select n_nationkey as city, timestamp_ntz '1997-01-01 00:00:00' + make_dt_interval(n_nationkey) as since from listed_cities) r,
             lateral events_between(r.since, r.since + interval '40' day, r.city) e""")


@query("""select event_id, '$.k' as path, json_extract_string(props, '$.k') as value from events""")
def op_sql_json_leaves(d):
    """Values of all documents of the event stream, one row each."""
    surface.register(d.spark, discovery.points(d, offers=False))
    d.table("events").createOrReplaceTempView("streamed_events")
    return d.spark.sql("select s.event_id, j.path, j.value from streamed_events s, lateral json_leaves(s.props) j")
