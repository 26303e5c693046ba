"""Records taken one after the other into merged events, and the merged events' fields."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_key
from ..sources.shared import stored
from . import identity
from .graph import linked
from .pairing import Matrix, numbered_letters

HOURS = 4
SETTLED = "id long, entry long, met long, score double, verdict string"


@lru_cache(100_000)
def _grams(text: str) -> frozenset:
    """The bigrams of a text, each with its number among equal ones."""
    seen: Counter = Counter()
    out = []
    for i in range(len(text) - 1):
        g = text[i : i + 2]
        out.append((g, seen[g]))
        seen[g] += 1
    return frozenset(out)


def dice(a: str, b: str, least: float = 0.0) -> float:
    """Dice coefficient of the bigrams of two texts; without bigrams 1 for equal texts, else 0."""
    x, y = _grams(a), _grams(b)
    if not x or not y:
        return float(a == b)
    return 2 * len(x & y) / (len(x) + len(y))


def blocks(a: str, b: str, least: float = 0.0) -> float:
    """Twice the matching blocks over both lengths; 0 where bounds tell that it is under ``least``."""
    m = SequenceMatcher(None, a, b)
    if least and (m.real_quick_ratio() < least or m.quick_ratio() < least):
        return 0.0
    return m.ratio()


class Alike:
    """For each title those met so far that are similar to ``least``, compared once for each two.

    Titles that are no longer live go once they are most of those held, so what is held grows with the live ones.
    """

    def __init__(self, alike: Callable[..., float], least: float, most: int = 2_000) -> None:
        self.alike, self.least, self.most = alike, least, most
        self.known: list[str] = []
        self.held: set[str] = set()
        self.near: dict[str, tuple[int, dict[str, float]]] = {}

    def add(self, title: str, live: dict) -> None:
        if title not in self.held:
            if len(self.known) > max(self.most, 4 * len(live)):
                self.known = [t for t in live if t != title]
                self.held, self.near = set(self.known), {}
            self.known.append(title)
            self.held.add(title)

    def of(self, name: str) -> dict[str, float]:
        """The known titles similar to ``name`` and their similarity, the most similar first, compared with those that are new since."""
        done, found = self.near.get(name, (0, {}))
        if done < len(self.known):
            for title in self.known[done:]:
                value = self.alike(title, name, self.least)
                if value >= self.least:
                    found[title] = value
            found = dict(sorted(found.items(), key=lambda f: -f[1]))
            self.near[name] = (len(self.known), found)
        return found


def block_ratios(sizes: np.ndarray, sizes_2: np.ndarray, shared: np.ndarray, texts: list[str], texts_2: list[str], least: float = 0.85) -> np.ndarray:
    """``blocks`` of texts whose equal letters, ``shared``, allow for ``least``; 0 for others."""
    total = sizes[:, None] + sizes_2[None, :]
    out = np.zeros(total.shape)
    for i, j in zip(*np.nonzero(2 * shared >= (least - 1e-9) * total)):
        out[i, j] = 1.0 if texts[i] == texts_2[j] else SequenceMatcher(None, texts[i], texts_2[j]).ratio()
    return out


@lru_cache(2)
def matrix_of(alike: Callable[..., float]) -> Matrix:
    """The similarities that this process holds; they serve all tasks that it runs."""
    return Matrix() if alike is dice else Matrix(numbered_letters, block_ratios)


def held_first(alike: Callable[..., float], matrix: Matrix) -> Callable[..., float]:
    """``alike`` of two titles, looked up if ``matrix`` holds both; of blocks what could reach 0.85, others may be 0."""

    def look(a: str, b: str, least: float = 0.0) -> float:
        x, y = matrix.codes.get(a), matrix.codes.get(b)
        return alike(a, b, least) if x is None or y is None else matrix.table.item(x, y)

    return look


def taken_in_turn(frames: Iterator[pd.DataFrame], alike: Callable[[str, str], float], review: bool) -> Iterator[pd.DataFrame]:
    """Decides rows that come by root, time and id; an entry is given up once no later row can meet it.

    Only entries of the last four hours are held, by title, with what later rows are compared with. A row meets the entries of
    similar titles alone, and of those only what could still reach a verdict and the best so far.
    """
    width, least = HOURS * 3600.0, 0.78 if review else 0.92
    # Without review a verdict takes titles of (0.92 - 0.45) / 0.55; a margin keeps rounding out of it.
    matrix = matrix_of(alike)
    titles_of, alike = Alike(held_first(alike, matrix), 0.7 if review else 0.85), lru_cache(200_000)(alike)
    root, live, exact, last, made = None, {}, {}, [], 0
    for frame in frames:
        out = []
        names = frame["name"].unique().tolist()  # compared in bulk, as far as the matrix can hold them
        matrix.add(names[: matrix.most])
        for r in frame.itertuples(index=False):
            if r.root != root:
                root, live, exact, last = r.root, {}, {}, []
            if not last or r.at - last[0] > 60:  # once a minute: what lies too far back goes
                last = [r.at]
                live = {t: kept for t, all_ in live.items() if (kept := [e for e in all_ if r.at - e["latest"] <= width + 60])}
                exact = {k: e for k, e in exact.items() if r.at - e["latest"] <= width + 60}
            same = (r.key, r.at // 60)
            best, score = exact.get(same) if r.key is not None else None, None
            verdict = "same" if best else "new"
            if not best:
                for title, titles in titles_of.of(r.name).items():
                    if 0.55 * titles + 0.45 + 1e-9 < max(least, score or 0.0):
                        break  # no further title can reach the best so far, with any time and venue
                    for e in live.get(title, ()):
                        gap = abs(e["at"] - r.at)
                        if gap > width:
                            continue
                        dates = max(0.0, 1 - gap / width)
                        if not review or (e["venue"] and r.venue):
                            if 0.55 * titles + 0.25 * dates + 0.2 < max(least, score or 0.0):
                                continue
                            value = 0.55 * titles + 0.25 * dates + 0.2 * alike(e["place"], r.place)
                        else:
                            value = 0.7 * titles + 0.3 * dates
                        if value > (score or 0.0) or (value == score and e["made"] < best["made"]):
                            best, score = e, value
                if best and score >= 0.92 and abs(best["at"] - r.at) <= 900:
                    verdict = "merge"
                elif best and review and score >= 0.78:
                    verdict = "review"
            met = best["entry"] if best and verdict != "new" else None
            if verdict in ("same", "merge"):
                e, title = best, best["name"]
                longer = (r.venue, r.place) if len(r.venue) > len(e["venue"]) else (e["venue"], e["place"])
                if r.quality > e["quality"]:
                    own = longer if review and len(e["venue"]) > len(r.venue) else (r.venue, r.place)
                    e.update(name=r.name, at=r.at, quality=r.quality, venue=own[0], place=own[1])
                    if e["name"] != title:
                        live[title] = [x for x in live[title] if x is not e]
                        live.setdefault(e["name"], []).append(e)
                        titles_of.add(e["name"], live)
                elif review:
                    e.update(venue=longer[0], place=longer[1])
                e["latest"] = r.at
            else:
                made += 1
                e = {"entry": r.id, "made": made, "name": r.name, "at": r.at, "latest": r.at, "quality": r.quality, "venue": r.venue, "place": r.place}
                live.setdefault(r.name, []).append(e)
                titles_of.add(r.name, live)
            if r.key is not None:
                exact.setdefault(same, e)
            out.append((r.id, e["entry"], met, None if verdict in ("new", "same") else int(score * 1000 + 0.5) / 1000, verdict))
        yield pd.DataFrame(out, columns=["id", "entry", "met", "score", "verdict"]).astype({"met": "Int64", "score": "Float64"})


def settled(records: DataFrame, ratio: str = "dice") -> DataFrame:
    """(id, entry, met, score, verdict): each record, taken by time and id, and the event that it belongs to then.

    A record of an event's key and minute joins it (``same``). Else the events so far that stand within four hours and
    have a title of similarity 0.7 are scored, 0.55 title + 0.25 date + 0.20 venue (0.7 and 0.3 where one has no venue), and the best,
    ties to the earlier event, takes the record in from 0.92 within 15 minutes (``merge``). From 0.78 the record is
    an event of its own that is to be looked at beside ``met`` (``review``), else just ``new``. The better record of a
    merged event, by ``quality``, gives it title and time, and the longer venue stays: later records meet
    what was merged. ``entry`` and ``met`` are the first record's id. ``ratio`` "blocks" compares by longest blocks, has
    no review, counts a missing venue as an empty text and lets the better record give the venue too.

    Columns: id (unique), key, title, venue, at, quality; null titles and venues are empty texts, a null quality is 0, a null key is that
    of no other; rows without a time or id are left out. Titles without Latin letters and digits are alike by bigrams. Records that can't meet are told apart first: texts
    that are similar, directly or by others, are a group, a group's records without a gap of four hours a chain, chains of one key and minute are
    linked, and each component is sorted and streamed past the decisions, which hold the events of the last four hours. No link between two records is a row.
    """
    review = {"dice": True, "blocks": False}[ratio]
    text = normal_key if review else (lambda c: F.lower(c))
    rows = records.where("id is not null and `at` is not null").select(
        F.col("id").cast("long").alias("id"), "key", text(F.coalesce("title", F.lit(""))).alias("name"),
        F.coalesce("venue", F.lit("")).alias("venue"), text(F.coalesce("venue", F.lit(""))).alias("place"),
        (F.unix_micros(F.col("at").cast("timestamp")) / F.lit(1e6)).alias("at"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("quality"),
    )
    rows = stored(rows, "records")  # read for the texts, too
    names = rows.select(F.col("name").alias("key")).distinct()
    if review:
        close = identity.similar_titles(names, 0.7)
    else:
        close = identity.similar_letters(names.withColumnRenamed("key", "name"), (0.92 - 0.45) / 0.55).withColumnsRenamed({"name": "key", "name_2": "key_2"})
    known = identity.grouped(close).withColumnRenamed("key", "name")
    rows = rows.join(known, "name", "left").withColumn("group", F.coalesce("root", F.xxhash64("name"))).drop("root").withColumn("slot", F.floor(F.col("at") / (3600 * HOURS)))
    rows = stored(rows, "grouped")
    # A group's slots are a chain as long as records of two neighbours may meet: told from a row for each slot, whatever it holds.
    spans = rows.groupBy("group", "slot").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    before = Window.partitionBy("group").orderBy("slot")
    apart = (F.col("slot") - F.lag("slot").over(before) > 1) | (F.col("from") - F.lag("to").over(before) > 3600 * HOURS + 1)
    chains = spans.withColumn("begun", F.when(F.coalesce(apart, F.lit(True)), F.col("slot")))
    chains = chains.withColumn("begun", F.last("begun", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(rows.join(chains.select("group", "slot", F.xxhash64("group", "begun").alias("node")), ["group", "slot"]).drop("group", "slot"), "chained")
    # One key and minute is one event, whatever the titles: each chain is linked to the first one.
    spots = rows.where("key is not null").groupBy("key", F.floor(F.col("at") / 60).alias("minute"), "node").agg(F.lit(1).alias("one"))
    first = spots.groupBy("key", "minute").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    same = spots.join(first, ["key", "minute"]).select(F.col("node").alias("u"), "v")
    roots = linked(same)
    ready = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("root", "at", "id", "key", "name", "venue", "place", "quality")
    alike = dice if review else blocks
    return ready.repartition("root").sortWithinPartitions("root", "at", "id").mapInPandas(lambda frames: taken_in_turn(frames, alike, review), SETTLED)


#: Fields of which the longest text stays, and those of which the better record's value stays.
LONGEST = ("description", "venue", "address", "postal_code", "organizer", "age_restriction")
FIRST = ("venue_url", "ticket_url", "image_url", "ends_at", "latitude", "longitude", "external_id")
PRIMARY = ("title", "starts_at")


def merged_fields(records: DataFrame) -> DataFrame:
    """One row for each ``entry``: what its records, taken by ``turn``, come to.

    Of two, the one of higher quality is the primary, at a tie the one so far. Title and start are the primary's; of each text the
    longest stays, ties to the primary; of each link, place and end the primary's, else the other's; of genres the first eight
    and of performers the first hundred, the primary's before the others'; a performer's type and image are the first told, a headliner is
    one if any says so. Prices widen while the currencies agree or one is missing; else the primary's stay. A state
    that isn't ``scheduled`` passes on. Access features are joined by or, of notes the longest stays.

    Columns: entry, turn (unique within the entry), quality, those of LONGEST, FIRST and PRIMARY, price_min, price_max, currency, is_free,
    status, wheelchair, hearing_loop, access_notes, genres and warnings (arrays of texts), performers (an array of name, type, image_url and
    is_headliner). A null or empty text is none, a null quality 0 and a null state scheduled. Nothing is gathered but what stays;
    records of an entry stream through windows of running values.
    """
    before = Window.partitionBy("entry").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("entry").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = records.withColumns({c: empty(c) for c in (*LONGEST, "access_notes", "currency", "status")} | {"quality": F.coalesce(F.col("quality").cast("double"), F.lit(0.0))})
    # A record that is better than all before it becomes the primary when its turn comes.
    rows = rows.withColumn("high", F.coalesce(F.col("quality") > F.max("quality").over(before), F.lit(True)))
    led = F.when(F.col("high"), F.col("currency"))
    held = F.coalesce(F.last(led, ignorenulls=True).over(before), F.first("currency", ignorenulls=True).over(before))
    rows = rows.withColumn("agrees", F.coalesce(F.col("currency") == held, F.lit(True)))
    # Another currency of a new primary starts the prices anew.
    rows = rows.withColumn("span", F.sum((F.col("high") & ~F.col("agrees")).cast("int")).over(so_far))
    rank = F.struct(F.col("high"), F.when(F.col("high"), F.col("turn")).otherwise(-F.col("turn")))
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), rank))
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), rank)))
    odd = F.when(F.col("status") != "scheduled", F.col("status"))
    price = lambda f, c: f(F.when(F.col("high") | F.col("agrees"), F.col(c)))
    prices = rows.groupBy("entry", "span").agg(price(F.min, "price_min").alias("price_min"), price(F.max, "price_max").alias("price_max"))
    prices = prices.groupBy("entry").agg(F.max_by(F.struct("price_min", "price_max"), "span").alias("price"))
    one = rows.groupBy("entry").agg(
        F.count("*").alias("n_records"),
        F.max("quality").alias("quality"),
        *[F.max_by(c, F.when(F.col("high"), F.col("turn"))).alias(c) for c in PRIMARY],
        *[longest(c).alias(c) for c in (*LONGEST, "access_notes")],
        *[given(c).alias(c) for c in (*FIRST, "currency")],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("is_free", "wheelchair", "hearing_loop")],
        F.coalesce(F.max_by(odd, F.when(~F.col("high") & odd.isNotNull(), F.col("turn"))), F.min_by(odd, F.when(odd.isNotNull(), F.col("turn"))), F.lit("scheduled")).alias("status"),
    )
    ranked = rows.withColumn("rank", rank)
    out = one.join(prices, "entry").select("*", "price.*").drop("price")
    for column, most in (("genres", 8), ("warnings", None)):
        out = out.join(_united(ranked, column, most), "entry", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out.join(_performers(ranked), "entry", "left")


def _united(rows: DataFrame, column: str, most: int | None) -> DataFrame:
    """The distinct values of an array, the last primary's first."""
    each = rows.select("entry", "rank", F.posexplode(column).alias("place", "value")).where("value is not null")
    kept = each.groupBy("entry", "value").agg(F.max(F.struct("rank", -F.col("place"))).alias("spot"))
    if most:
        kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("spot")))).where(F.col("n") <= most)
    return kept.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("spot", "value")), asc=False), lambda s: s["value"]).alias(column))


def _performers(rows: DataFrame) -> DataFrame:
    each = rows.select("entry", "rank", F.posexplode("performers").alias("place", "p")).select("entry", F.struct("rank", -F.col("place")).alias("spot"), "p.*", normal_key(F.col("p.name")).alias("key")).where("key <> ''")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("spot"))).alias(c)
    kept = each.groupBy("entry", "key").agg(F.max("spot").alias("spot"), F.max_by("name", "spot").alias("name"), known("type"), known("image_url"), F.coalesce(F.bool_or("is_headliner"), F.lit(False)).alias("is_headliner"))
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("spot")))).where("n <= 100")
    fields = F.struct("name", "type", "image_url", "is_headliner")
    return kept.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", fields.alias("p")))), lambda s: s["p"]).alias("performers"))


def merged_events(records: DataFrame, ratio: str = "dice") -> DataFrame:
    """``merged_fields`` of the events of ``settled``; columns as there, ``id`` for entry and turn, ``at`` for starts_at.

    ``entry`` is the first record's id. For what is to be looked at, see ``settled``.
    """
    told = settled(records.select("id", "key", "title", "venue", "at", "quality"), ratio).select("id", "entry")
    turn = F.struct(F.unix_micros(F.col("at").cast("timestamp")), F.col("id"))
    order = F.row_number().over(Window.partitionBy("entry").orderBy(turn))
    return merged_fields(records.withColumn("starts_at", F.col("at")).join(told, "id").withColumn("turn", order))
