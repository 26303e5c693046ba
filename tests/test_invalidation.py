"""Translations that go stale by a stream of changes, against each change in turn in plain Python."""

import random
from datetime import datetime, timedelta

from fairground.streaming import invalidation

CHANGE = "kind string, id long, before map<string,string>, after map<string,string>, ts timestamp"
START = datetime(2026, 5, 1)


def test_a_stream_marks_what_each_change_in_turn_marks(spark, tmp_path):
    rng = random.Random(2)
    fields = {"event": ["title", "tags"], "venue": ["name", "capacity"], "organizer": ["description", "phone"], "performer": ["bio", "image"], "offer": ["price"]}
    changes = []
    for i in range(120):
        kind = rng.choice(list(fields))
        state = lambda kind=kind: {f: rng.choice(["a", "b"]) for f in fields[kind] if rng.random() < 0.9}
        changes.append((kind, rng.choice([None, *range(12)]), state() if i % 10 else None, state(), START + timedelta(hours=i)))
    events = [(e, rng.choice([None, 1, 2]), rng.choice([None, 3, 4])) for e in range(40)]
    acts = [(rng.randrange(12), rng.randrange(40)) for _ in range(30)]
    told = [(e, lang, rng.choice(["machine", "reviewed", "original", "missing", None]), START + timedelta(hours=rng.randrange(130))) for e in range(40) for lang in ("de", "fr")]
    want = {(e, lang): s for e, lang, s, _ in told}
    for kind, i, before, after, ts in changes:
        watched = invalidation.WATCHED.get(kind)
        if i is None or (watched and all((before or {}).get(c) == (after or {}).get(c) for c in watched)):
            continue
        hit = {"venue": lambda i: {e for e, v, _ in events if v == i}, "organizer": lambda i: {e for e, _, o in events if o == i}, "performer": lambda i: {e for p, e in acts if p == i}}.get(kind, lambda i: {i})(i)
        for e, lang, s, at in told:
            if e in hit and s in ("machine", "reviewed") and ts >= at:
                want[e, lang] = "stale"
    for n in range(3):
        spark.createDataFrame(changes[40 * n : 40 * n + 40], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    linked = invalidation.links(spark.createDataFrame(events, "event_id long, venue_id long, organizer_id long"), spark.createDataFrame(acts, "performer_id long, event_id long"))
    translations = spark.createDataFrame(told, "event_id long, language string, translation_status string, updated_at timestamp")
    got = invalidation.with_marks(translations, invalidation.follow(stream, linked, translations))
    assert {(r.event_id, r.language): r.translation_status for r in got.collect()} == want
    assert got.columns == translations.columns and "stale" in want.values()


def test_no_change_marks_nothing(spark, tmp_path):
    spark.createDataFrame([], CHANGE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
    linked = spark.createDataFrame([], "kind string, id long, event_id long")
    told = spark.createDataFrame([(1, "de", "machine", START)], "event_id long, language string, translation_status string, updated_at timestamp")
    marked = invalidation.follow(stream, linked, told)
    assert marked.count() == 0 and invalidation.with_marks(told, marked).collect() == told.collect()
