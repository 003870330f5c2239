import datetime

from undertext.streaming import correlate, order
from undertext.streaming.history import ENTRY, History, kept

AT = datetime.datetime(2026, 1, 1)


def at(seconds):
    return AT + datetime.timedelta(seconds=seconds)


class Source:
    """A folder of Parquet files, each of which is a batch of a stream."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def put(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.folder}/part{self.n}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.folder)


def run(df, folder, name):
    """What a stream gives for all that its sources hold by now."""
    df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start(f"{folder}/{name}").awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").collect()


def test_verdicts_in_time_late_missing_and_repeated(spark, tmp_path):
    asked = Source(spark, tmp_path / "asked", "id string, asked timestamp")
    told = Source(spark, tmp_path / "told", "id string, told timestamp, verdict string")
    asked.put(("in time", at(0)), ("late", at(0)), ("missing", at(5)), ("twice", at(5)), ("at the end", at(0)), ("before", at(9)))
    told.put(("in time", at(60), "infected"), ("twice", at(10), "infected"), ("twice", at(20), "clean"), ("at the end", at(120), "infected"), ("before", at(8), "infected"), ("nobody", at(9), "infected"))
    told.put(("late", at(121), "infected"))
    for s in (1000, 2000):
        asked.put((f"tick {s}", at(s)))
        told.put((f"tock {s}", at(s), "clean"))
    got = sorted((r.id, r.verdict) for r in run(correlate.with_deadline(asked.stream(), told.stream()), tmp_path, "answers") if not r.id.startswith("tick"))
    assert got == [("at the end", "infected"), ("before", "clean"), ("in time", "infected"), ("late", "clean"), ("missing", "clean"), ("twice", "infected")]


def test_replayed_only_if_clean(spark):
    rows = [("a", "infected", True), ("b", "clean", True), ("c", "error", True), ("d", None, True), ("e", "infected", False)]
    df = spark.createDataFrame(rows, "id string, verdict string, scannable boolean")
    assert sorted(r.id for r in correlate.replayed(df).collect()) == ["b", "c", "d", "e"]


FRAME = "conn string, seq long, ready timestamp, verdict string"


def test_frames_wait_for_what_was_sent_before(spark, tmp_path):
    frames = Source(spark, tmp_path / "frames", FRAME)
    frames.put(("a", 2, at(0), "clean"), ("a", 3, at(1), "infected"), ("b", 1, at(0), "clean"), (None, 1, at(0), "clean"), ("n", None, at(0), "clean"))
    stream = order.in_order(frames.stream(), seconds=60)
    told = lambda: [(r.conn, r.seq, r.late) for r in sorted(run(stream, tmp_path, "out"), key=lambda r: (r.conn, r.seq))]
    assert told() == [("b", 1, False)]
    frames.put(("a", 1, at(5), "clean"), ("a", 1, at(5), "clean"), ("b", 3, at(6), "clean"))
    assert told() == [("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False)]
    # b's second frame never comes in time: after a minute of event time the gap is given up
    frames.put(("c", 1, at(70), "clean"))
    frames.put(("c", 2, at(200), "clean"))
    frames.put(("c", 3, at(400), "clean"))
    assert ("b", 3, False) in told()
    frames.put(("b", 2, at(401), "clean"), ("b", 4, at(402), "clean"))
    assert told() == [("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("b", 3, False), ("b", 4, False), ("c", 1, False), ("c", 2, False), ("c", 3, False)]


def test_release_times_and_stretches(spark):
    rows = [("a", 1, at(9), "clean"), ("a", 2, at(1), "infected"), ("a", 7, at(3), "clean"), ("a", 8, at(20), "clean"), ("a", 30, at(2), "clean"), ("b", 1, None, "clean"), ("b", 2, at(4), None), (None, 5, at(5), "clean")]
    df = spark.createDataFrame(rows, FRAME)
    want = {("a", 1): at(9), ("a", 2): at(9), ("a", 7): at(9), ("a", 8): at(20), ("a", 30): at(20), ("b", 1): None, ("b", 2): at(4), (None, 5): at(5)}
    for span in (4, 4096):
        assert {(r.conn, r.seq): r.released for r in order.release_times(df, span).collect()} == want
    assert sorted(r.seq for r in order.delivered(df.where("conn = 'a'")).collect()) == [1, 7, 8, 30]


def entry(i, ts):
    return (i, f"f{i}", "txt", "clean", None, None, ts)


def test_history_is_written_once_a_batch_trimmed_and_cleared(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    frame = lambda rows: spark.createDataFrame(rows, ENTRY)
    assert h.current().collect() == []
    h.clear()
    h.append(frame([entry(i, i) for i in range(70)]), 0)
    h.append(frame([entry(100 + i, 50 + i) for i in range(60)]), 1)
    once = h.current().collect()
    h.append(frame([entry(999, 999)]), 1)  # the batch again, with whatever rows
    assert h.current().collect() == once and len(once) == 100
    assert [r.ts for r in once] == sorted((r.ts for r in once), reverse=True) and {r.doc_id for r in once} == {*range(30, 70), *range(100, 160)}
    h.append(frame([entry(1000 + i, 5000) for i in range(150)]), 2)
    assert [r.doc_id for r in h.current().collect()] == list(range(1149, 1049, -1))
    assert h._batches() == [2]
    h.append(frame([]), 3)
    h.clear()
    assert h.current().collect() == []
    h.append(frame([entry(1, 1)]), 3)  # again: was there before the clearing
    assert h.current().collect() == []
    h.append(frame([entry(2, 2)]), 4)
    assert [r.doc_id for r in h.current().collect()] == [2]


def test_history_of_a_stream_is_a_stream_again(spark, tmp_path):
    reports = Source(spark, tmp_path / "reports", ENTRY)
    h = History(spark, str(tmp_path / "h"))
    reports.put(*[entry(i, i) for i in range(120)])
    reports.put(entry(500, 7), entry(501, 1000))

    def go():
        kept(reports.stream(), h, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return [r.doc_id for r in h.current().collect()], sorted(r.doc_id for r in run(h.changes(), tmp_path, "seen"))

    newest, seen = go()
    assert newest == [501, *range(119, 20, -1)] and seen == [*range(20, 120), 500, 501]
    reports.put(entry(502, 2000))
    newest, seen = go()
    assert newest[:2] == [502, 501] and len(newest) == 100 and 502 in seen
