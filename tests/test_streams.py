import itertools
import random

from helpers import rows
from pyspark.sql import functions as F

from scriptorium.operators.records import Seen, plain_slug
from scriptorium.session import scratch
from scriptorium.streaming import events as X
from scriptorium.streaming import replay as R


def events(spark, data):
    """(step, day and hour, value) as events."""
    made = [(s, f"2024-01-{t:%d %H:00:00}" if not isinstance(t, str) else t, v) for s, t, v in data]
    return spark.createDataFrame(made, "step int, at string, value double").select("step", F.to_timestamp("at").alias("ts"), F.lit("a").alias("event_type"), "value")


def test_late_rows_are_dropped(spark):
    data = [
        (0, "2024-01-01 10:00:00", 1.0),
        (0, "2024-01-05 10:00:00", 2.0),  # the watermark of the next step: the 4th at 10
        (1, "2024-01-02 10:00:00", 4.0),  # its day ended on the 3rd: late
        (1, "2024-01-04 01:00:00", 8.0),  # its day is still open
        (2, "2024-01-01 23:00:00", 16.0),  # the day was closed: late
        (2, "2024-01-09 00:00:00", 32.0),  # closes all but itself
    ]
    got = {(str(r.day)[:10], r.n, r.total) for r in R.closed_windows(lambda e: X.daily_counts(e, "1 day"), events(spark, data), "step").collect()}
    assert got == {("2024-01-01", 1, 1.0), ("2024-01-04", 1, 8.0), ("2024-01-05", 1, 2.0)}


def test_no_window_is_closed(spark):
    got = R.closed_windows(lambda e: X.daily_counts(e, "1 day"), events(spark, [(0, "2024-01-01 10:00:00", 1.0)]), "step")
    assert got.count() == 0 and got.columns == ["day", "event_type", "n", "total"]


def test_kept_set_is_that_of_an_ordered_pass_for_every_split(spark):
    rng = random.Random(4)
    data = [(i, f"i{rng.randrange(9)}", rng.choice(["", "T one", "t-ONE", "two", "three", "four", "…"])) for i in range(30)]
    seen = Seen()
    want = [p for p, i, t in data if seen.admit(i, plain_slug(t))]
    for cuts in ([30], [1, 30], [10, 11, 25, 30]):
        kept, low = R.KeptRecords(spark, scratch(spark, "kept")), 0
        for n, high in enumerate(cuts):
            kept.admit(spark.createDataFrame(data[low:high], "pos bigint, id string, title string"), n)
            low = high
        kept.admit(spark.createDataFrame(data[: cuts[0]], "pos bigint, id string, title string"), 0)  # a replay
        assert sorted(r.pos for r in kept.records().collect()) == want and kept.records().columns == ["pos", "id", "title"]


def test_replays_of_batches_change_nothing(spark):
    changes = [[("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], [("b", None, 4), ("c", 1, 5)], [("a", 9, 6), (None, 7, 7)]]
    made = [spark.createDataFrame(x, "k string, v int, t int") for x in changes]
    want = [("a", 9, 6), ("b", None, 4), ("c", 1, 5), (None, 7, 7)]
    plain = lambda t: sorted(rows(t.rows().select("k", "v", "t")), key=repr)
    for compact_at in (None, 0, 1, 2):
        held = R.MergedTable(spark, scratch(spark, "merged"), ["k"], ["t"])
        for n, x in enumerate(made):
            held.merge(x, n)
            held.merge(x, n)
            if n == compact_at:
                held.compact()
                held.compact()
        for n in itertools.chain(range(3), (1, 0)):
            held.merge(made[n], n)
        assert plain(held) == sorted(want, key=repr), compact_at


def test_unfinished_batches_are_not_read(spark, tmp_path):
    held = R.MergedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"])
    assert held.numbers() == []
    held.merge(spark.createDataFrame([("a", 1)], "k string, t int"), 3)
    (tmp_path / "t" / "batch=4").mkdir()
    assert held.numbers() == [3] and rows(held.rows()) == [("a", 1)]


def test_a_stream_of_changes_with_a_step_sent_twice(spark):
    data = [(0, "a", 1, 1), (0, "a", 5, 0), (1, "a", 2, 2), (1, "b", 3, 3), (2, "b", 4, 4)]
    df = spark.createDataFrame(data, "step int, k string, v int, t int")
    held = R.MergedTable(spark, scratch(spark, "merged"), ["k"], ["t"])
    got = R.merged(df, "step", held, again=0)
    # the step that comes again is a batch of its own, and the latest
    assert sorted(rows(got.select("k", "v", "t"))) == [("a", 1, 1), ("b", 4, 4)] and len(held.numbers()) == 4
