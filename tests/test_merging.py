"""Merging in turn against the same rules record by record in plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from fairground.operators import merging
from pyspark.sql import functions as F

START = datetime(2026, 5, 1, 18)
RECORD = "id long, key string, title string, venue string, `at` timestamp_ntz, quality double"
TITLES = ["jazz night at the lake", "jazz night at the lakes", "jazz nights at the lake", "rock night at the lake", "summer market", "summer markets", "winter market", "x", "", None]
VENUES = ["blue hall", "blue hall north", "red barn", "", None]


def drawn(n, seed):
    rng = random.Random(seed)
    return [
        (i, rng.choice([None, f"k{rng.randrange(n // 3)}"]), rng.choice(TITLES), rng.choice(VENUES), START + timedelta(minutes=rng.choice([0, 1, 5, 14, 16, 60, 241, 700]) + 7 * rng.randrange(4), seconds=rng.randrange(3) * 20), rng.choice([None, 10.0, 50.0, 90.0]))
        for i in range(n)
    ]


def in_turn(rows, alike, review):
    """All events so far are looked at, whatever their time."""
    events, exact, out = [], {}, {}
    for i, key, title, venue, at, quality in sorted(rows, key=lambda r: (r[4], r[0])):
        title, venue, quality = title or "", venue or "", quality or 0
        mark = (key, at.replace(second=0))
        best, score, verdict = exact.get(mark) if key is not None else None, 0.0, "same"
        if best is None:
            verdict = "new"
            for e in events:
                gap = abs((e["at"] - at).total_seconds())
                titles = alike(e["title"], title)
                if gap > 14400 or titles < 0.7:
                    continue
                dates = max(0.0, 1 - gap / 14400)
                whole = 0.7 * titles + 0.3 * dates if review and not (e["venue"] and venue) else 0.55 * titles + 0.25 * dates + 0.2 * alike(e["venue"], venue)
                if whole > score:
                    best, score = e, whole
            if best is not None and score >= 0.92 and abs((best["at"] - at).total_seconds()) <= 900:
                verdict = "merge"
            elif best is not None and review and score >= 0.78:
                verdict = "review"
        met = best["id"] if verdict != "new" else None
        if verdict in ("same", "merge"):
            better = quality > best["quality"]
            one, two = (venue, best["venue"]) if better else (best["venue"], venue)
            if better:
                best.update(title=title, at=at, quality=quality)
            best["venue"] = one if not review or len(two) <= len(one) else two
            event = best
        else:
            event = {"id": i, "title": title, "venue": venue, "at": at, "quality": quality}
            events.append(event)
        if key is not None:
            exact.setdefault(mark, event)
        out[i] = (event["id"], met, round(score, 3) if verdict in ("merge", "review") else None, verdict)
    return out


@pytest.mark.parametrize(("ratio", "alike"), [("dice", merging.dice), ("blocks", merging.blocks)])
def test_records_in_turn_equal_plain_python(spark, ratio, alike):
    seen = set()
    for seed in (0, 1) if ratio == "dice" else (0,):
        rows = drawn(250, seed)
        got = {r.id: (r.entry, r.met, None if r.score is None else round(r.score, 3), r.verdict) for r in merging.settled(spark.createDataFrame(rows, RECORD), ratio).collect()}
        want = in_turn(rows, alike, ratio == "dice")
        assert {i: (e, m, v) for i, (e, m, _, v) in got.items()} == {i: (e, m, v) for i, (e, m, _, v) in want.items()}
        assert all(abs((got[i][2] or 0) - (want[i][2] or 0)) <= 0.0011 for i in want)
        seen |= {v for *_, v in got.values()}
    assert seen == ({"same", "merge", "review", "new"} if ratio == "dice" else {"same", "merge", "new"})


def test_a_chain_meets_what_was_merged(spark):
    # The second is better and gives title and time, so that the third, 20 minutes after the first, joins it.
    rows = [(1, None, "open air film", "park", START, 10.0), (2, None, "open air films", "park", START + timedelta(minutes=10), 90.0), (3, None, "open air films", "park", START + timedelta(minutes=20), 5.0)]
    got = merging.settled(spark.createDataFrame(rows, RECORD)).orderBy("id").collect()
    assert [(r.entry, r.verdict) for r in got] == [(1, "new"), (1, "merge"), (1, "merge")]


def test_nothing_comes_of_nothing(spark):
    assert merging.settled(spark.createDataFrame([], RECORD)).count() == 0
    rows = [(1, "k", "a title", None, None, 1.0), (None, "k", "a title", None, START, 1.0), (2, "k", None, None, START, None)]
    assert [(r.id, r.entry) for r in merging.settled(spark.createDataFrame(rows, RECORD)).collect()] == [(2, 2)]


TEXTS = ("description", "venue", "address", "postal_code", "organizer", "age_restriction")
FIELDS = (
    "entry long, turn int, quality double, title string, starts_at int, " + ", ".join(f"{c} string" for c in TEXTS) + ", venue_url string, ticket_url string, image_url string, ends_at int, latitude double, longitude double, external_id string, "
    "price_min double, price_max double, currency string, is_free boolean, status string, wheelchair boolean, hearing_loop boolean, access_notes string, genres array<string>, warnings array<string>, "
    "performers array<struct<name string, type string, image_url string, is_headliner boolean>>"
)


def field_rows(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a", "bb", "cc", "ddd", "eee"])
    for entry in range(40):
        for turn in range(rng.randrange(1, 8)):
            acts = [(rng.choice(["Ann", "ann", "Bob", "Été", ""]), rng.choice([None, "band"]), rng.choice([None, "i1", "i2"]), rng.choice([True, False])) for _ in range(rng.randrange(4))]
            yield (
                entry, turn, rng.choice([None, 1.0, 2.0, 3.0, 4.0]), f"t{turn}", turn, *[text() for _ in TEXTS], *[rng.choice([None, f"u{turn}"]) for _ in range(3)], rng.choice([None, turn]), rng.choice([None, 1.5]), rng.choice([None, 2.5]), rng.choice([None, f"x{turn}"]),
                rng.choice([None, 1.0, 5.0]), rng.choice([None, 7.0, 9.0]), rng.choice([None, "CHF", "EUR"]), rng.choice([None, True, False]), rng.choice([None, "scheduled", "cancelled", "postponed"]), rng.choice([None, True, False]), False, text(),
                rng.choice([None, [rng.choice("abcdefghijkl") for _ in range(5)]]), rng.choice([[], ["w1"], ["w2", "w1"]]), acts or None,
            )


def folded(left, right):
    better = right["quality"] > left["quality"]
    p, s = (dict(right), left) if better else (dict(left), right)
    for c in (*TEXTS, "access_notes"):
        p[c] = max(p[c], s[c], key=lambda v: len(v or "")) or None
    for c in merging.FIRST:
        p[c] = s[c] if p[c] is None else p[c]
    p["genres"] = list(dict.fromkeys(p["genres"] + s["genres"]))[:8]
    p["warnings"] = list(dict.fromkeys(p["warnings"] + s["warnings"]))
    p["performers"] = acts(p["performers"] + s["performers"])
    if p["currency"] == s["currency"] or not p["currency"] or not s["currency"]:
        for c, f in (("price_min", min), ("price_max", max)):
            p[c] = f((v for v in (p[c], s[c]) if v is not None), default=None)
        p["currency"] = p["currency"] or s["currency"]
    for c in ("is_free", "wheelchair", "hearing_loop"):
        p[c] = bool(p[c] or s[c])
    if s["status"] != "scheduled":
        p["status"] = s["status"]
    p["quality"] = max(p["quality"], s["quality"])
    return p


def acts(all_):
    out = {}
    for name, kind, image, lead in all_:
        key = name.lower().replace("é", "e")
        if key:
            had = out.get(key)
            out[key] = (had[0], had[1] or kind, had[2] or image, had[3] or lead) if had else (name, kind, image, lead)
    return list(out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_fields_equal_a_fold_in_plain_python(spark, seed):
    rows, want = list(field_rows(seed)), {}
    df = spark.createDataFrame(rows, FIELDS)
    for r in rows:
        x = dict(zip(df.columns, r))
        x.update({c: x[c] or None for c in (*TEXTS, "access_notes")}, quality=x["quality"] or 0.0, status=x["status"] or "scheduled", genres=list(dict.fromkeys(x["genres"] or []))[:8], warnings=list(dict.fromkeys(x["warnings"])), performers=acts(x["performers"] or []))
        x.update({c: bool(x[c]) for c in ("is_free", "wheelchair", "hearing_loop")})
        want[x["entry"]] = folded(want[x["entry"]], x) if x["entry"] in want else x
    got = merging.merged_fields(df.orderBy(F.rand(seed))).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.entry]
        assert {c: r[c] for c in w if c not in ("turn", "performers")} == {c: w[c] for c in w if c not in ("turn", "performers")}
        assert [tuple(p) for p in r.performers or []] == w["performers"]


def test_titles_are_compared_once_for_each_two_and_forgotten_titles_go():
    asked = []
    like = merging.Alike(lambda a, b, least: asked.append((a, b)) or merging.dice(a, b), 0.7, most=6)
    live = {t: [] for t in ("jazz night", "jazz nights", "opera")}
    for t in live:
        like.add(t, live)
    for _ in range(50):
        assert set(like.of("jazz night")) == {"jazz night", "jazz nights"} and set(like.of("opera")) == {"opera"}
    assert len(asked) == 6
    for i in range(40):
        live = {f"title {i}": [], "opera": []}
        like.add(f"title {i}", live)
        like.of("opera")
    assert len(like.known) <= 9 and "opera" in like.of("opera")


@pytest.mark.parametrize("ratio", [merging.dice, merging.blocks])
def test_bounds_leave_similarities_as_they_are(ratio):
    texts = ["", "a", "aa", "aaaa", "jazz night", "jazz nights", "night jazz", "opera"]
    for a in texts:
        for b in texts:
            whole = ratio(a, b)
            assert ratio(a, b, 0.8) == whole or ratio(a, b, 0.8) == 0.0 and whole < 0.8
            if ratio is merging.dice:
                x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
                assert whole == (2 * sum((x & y).values()) / (x.total() + y.total()) if x and y else float(a == b))


def test_similar_titles_of_one_slot_are_not_linked_two_by_two(spark, monkeypatch):
    links, linked = [], merging.linked
    monkeypatch.setattr(merging, "linked", lambda edges: links.append(edges.count()) or linked(edges))
    rows = [(i, f"k{i % 290}" if i % 3 == 0 else None, f"jazz night at the lake {i % 60}", "blue hall", START + timedelta(hours=5 * (i // 60), minutes=i % 50), 1.0) for i in range(600)]
    got = merging.settled(spark.createDataFrame(rows, RECORD)).collect()
    assert {r.id: (r.entry, r.verdict) for r in got} == {i: (e, v) for i, (e, _, _, v) in in_turn(rows, merging.dice, True).items()}
    assert sum(links) <= 600  # 61,200 when similar titles of a slot were linked


def test_chains_end_where_nothing_can_meet(spark):
    # 3 h 59 min apart, over the slots' borders, is one chain; a gap of more than four hours ends it.
    rows = [(i, None, "jazz night", "hall", START + timedelta(minutes=m), float(i)) for i, m in enumerate([0, 239, 478, 719, 959, 960])]
    got = {r.id: (r.entry, r.verdict, r.met) for r in merging.settled(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {i: (e, v, m) for i, (e, m, _, v) in in_turn(rows, merging.dice, True).items()}


def test_blocks_of_many_titles_are_told_where_letters_allow_them(monkeypatch):
    asked, plain = [], merging.SequenceMatcher
    monkeypatch.setattr(merging, "SequenceMatcher", lambda *a: asked.append(a) or plain(*a))
    texts = ["", "a", "aa", *[f"{a} {b} {i}" for a in ("jazz", "rock") for b in ("night", "nights") for i in range(20)], "x" * 300, "x" * 299 + "y"]
    matrix = merging.Matrix(merging.numbered_letters, merging.block_ratios)
    matrix.add(texts)
    n, look = len(asked), merging.held_first(merging.blocks, matrix)
    for a in texts:
        for b in texts:
            assert look(a, b, 0.85) == merging.blocks(a, b, 0.85) or max(look(a, b, 0.85), merging.blocks(a, b, 0.85)) < 0.85
    assert n < len(texts) ** 2 / 2 and look("a", "not held", 0.85) == merging.blocks("a", "not held", 0.85)
