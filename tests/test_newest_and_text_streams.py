"""Newest rows of the stored table by day folders; text logs as streams."""

import random

from pyspark.sql import functions as F

from errorlens.operators import newest as N
from errorlens.sources.logs import day_folders, scan_log_files, write_logs

ROWS = "id long, timestamp timestamp, level string, app_id string, message string"


def table(spark, path, rows):
    from datetime import datetime
    df = spark.createDataFrame([(i, datetime.fromisoformat(t), level, app, f"m{i}") for i, t, level, app in rows], ROWS)
    write_logs(df, path)
    return rows


def want(rows, n, levels=None):
    kept = [r for r in rows if levels is None or r[2] in levels]
    return [r[0] for r in sorted(kept, key=lambda r: (r[1], r[0]), reverse=True)[:n]]


def days_read(df):
    return {r["log_date"] for r in df.select("log_date").distinct().collect()}, df.inputFiles()


def test_newest_rows_open_only_the_days_they_need(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"2024-01-{rng.randint(1, 20):02d} {rng.randint(0, 23):02d}:00:00", rng.choice(["INFO", "ERROR", "FATAL", "WARN"]),
             rng.choice(["a", "b", "c"])) for i in range(400)]
    rows += [(400 + i, "2024-01-25 00:00:00", "INFO", "a") for i in range(60)]       # ties, all in the newest day
    rows += [(500, "2024-01-26 12:00:00", "WARN", "b")]                                # a thin day
    path = table(spark, f"{tmp_path}/t", rows) and f"{tmp_path}/t"
    got = N.recent_stored(spark, path, 1)
    assert [r.id for r in got.collect()] == [500]
    assert all("log_date=2024-01-26" in f for f in got.inputFiles())
    got = N.recent_stored(spark, path, 50)
    assert [r.id for r in got.collect()] == want(rows, 50)
    # the thin day and the next two, none of the others
    assert len({f.split("log_date=")[1][:10] for f in got.inputFiles()}) == 3
    for n, level in ((5, "error"), (100, "fatal"), (1000, "warn")):
        assert [r.id for r in N.by_level_stored(spark, path, level, n).collect()] == want(rows, n, {level.upper()})
    assert [r.id for r in N.capped_scan_stored(spark, path, 30).collect()] == want(rows, 30, {"ERROR", "FATAL"})
    apps = spark.createDataFrame([("a",), ("b",), ("c",), ("none",), (None,), ("a",)], "app_id string")
    newest = {r.app_id: r.id for r in N.latest_error_per_app_stored(spark, path, apps).collect()}
    assert newest == {a: want([r for r in rows if r[3] == a], 1, {"ERROR", "FATAL"})[0] for a in "abc"}


def test_newest_rows_of_no_table(spark, tmp_path):
    assert day_folders(spark, f"{tmp_path}/none") == []
    assert N.recent_stored(spark, f"{tmp_path}/none", 5).count() == 0
    apps = spark.createDataFrame([("a",)], "app_id string")
    assert N.latest_error_per_app_stored(spark, f"{tmp_path}/none", apps).count() == 0


def streamed(spark, tmp_path, logs, batches):
    """Rows of a stream that finds the files of ``batches`` one after the other."""
    import os
    import time
    from errorlens.streaming.log_text import run_until_closed, start_log_stream, stream_log_files
    src = tmp_path / "in"
    for log in logs:
        (src / log).mkdir(parents=True)
    out = f"{tmp_path}/out"
    query = start_log_stream(stream_log_files(spark, str(src), timeout=8), out, f"{tmp_path}/ckpt", "500 milliseconds")
    read = 0
    for batch in batches:
        for log, name, raw in batch:
            (src / log / f".{name}").write_bytes(raw)
            os.rename(src / log / f".{name}", src / log / name)
        read += sum(raw.count(b"\n") + (not raw.endswith(b"\n")) for _, _, raw in batch if raw)
        for _ in range(200):
            if sum(p["numInputRows"] for p in query.recentProgress) >= read:
                break
            time.sleep(0.1)
    run_until_closed(query)
    return spark.read.parquet(out)


def test_a_stream_of_cut_files_equals_the_whole_file(spark, tmp_path):
    head = "2024-01-01 00:00:%02d.000 [m] %s a.B - number %d\n"
    texts = {}
    for k, log in enumerate(("one", "two")):
        lines = ["left over\n"] if k else []
        for i in range(12):
            lines.append(head % (i, "ERROR" if i % 3 else "INFO ", i))
            lines += [f"\tat a.B.c{i}(B.java:{j})\n" for j in range(i % 4)] + (["bad [\n", "\n"] if i == 5 else [])
        lines.insert(7, "2024-02-30 00:00:00.000 [m] INFO  a.B - no such day\n")
        texts[log] = lines
    # cut after any line, inside records too; a file each batch and two in the last
    cuts = {"one": [3, 8, 9, 20], "two": [1, 2, 14, 21]}
    parts = {log: ["".join(x[a:b]).encode() for a, b in zip([0, *cuts[log]], [*cuts[log], len(x)])] for log, x in texts.items()}
    batches = [[(log, f"{k}.log", parts[log][k]) for log in parts] for k in range(4)]
    batches[-1] += [(log, "4.log", parts[log][4]) for log in parts]
    got = streamed(spark, tmp_path, list(texts), batches)
    for log, lines in texts.items():
        (tmp_path / f"{log}.whole").write_text("".join(lines))
    whole = scan_log_files(spark, f"{tmp_path}/*.whole")
    cols = ["kind", "reason", "timestamp", "thread_name", "level", "logger", "message", "stack_trace", "text", "part"]
    rows = lambda df: sorted(map(tuple, df.select(cols).collect()), key=repr)
    assert rows(got) == rows(whole)
    assert got.where("kind = 'reject'").count() == 3
    assert got.where(F.col("stack_trace").contains("bad [")).count() == 2


def test_long_open_records_leave_the_state_in_parts(spark):
    import pandas as pd
    from errorlens.streaming import log_text as S

    class State:
        value = None
        def exists(self): return self.value is not None
        def get(self): return self.value
        def update(self, v): self.value = v
        def clear(self): self.value = None

    class Handle:
        def listTimers(self): return []
        def registerTimer(self, at): pass
        def deleteTimer(self, at): pass

    class Now:
        def getCurrentProcessingTimeInMs(self): return 0

    old, S.STATE_CHARS = S.STATE_CHARS, 100
    try:
        record = S.OpenRecord(1000)
        record.handle, record.open = Handle(), State()
        out, lines = [], [f"line {i}" for i in range(100)]
        pieces = [("f", 0, 0, True, "head")] + [("f", 0, k + 1, False, x) for k, x in enumerate(lines)]
        for k in range(0, len(pieces), 7):
            frame = pd.DataFrame(pieces[k:k + 7], columns=["file", "block", "seq", "headed", "text"])
            out += [r for pdf in record.handleInputRows(("l",), iter([frame]), Now()) for r in pdf.itertuples(index=False)]
            assert len(record.open.value[4] or "") <= 200
        out += [r for pdf in record.handleExpiredTimer(("l",), Now(), None) for r in pdf.itertuples(index=False)]
    finally:
        S.STATE_CHARS = old
    assert [r.part for r in out] == list(range(len(out))) and len(out) > 5
    assert "\n".join(r.text for r in out) == "\n".join(["head", *lines])


def test_a_task_holds_a_bounded_part_of_a_log(monkeypatch):
    """Whole records pass as they come; the other pieces of a log, in any order, are put in place outside of memory."""
    import tracemalloc

    import pandas as pd
    from errorlens.streaming import log_text as S

    class State:
        value = None
        def exists(self): return self.value is not None
        def get(self): return self.value
        def update(self, v): self.value = v

    class Handle:
        def listTimers(self): return []
        def registerTimer(self, at): pass

    class Now:
        def getCurrentProcessingTimeInMs(self): return 0

    monkeypatch.setattr(S, "SPOOL_BYTES", 50_000, raising=False)
    monkeypatch.setattr(S, "BATCH_CHARS", 50_000, raising=False)
    splits, text = 60, lambda k, seq: f"{k}.{seq} é " + "x" * 10_000
    pieces = [(f"f{k:02d}", 0, seq, seq > 0, 0 < seq < 19, (k, seq)) for k in range(splits) for seq in range(20)]
    random.Random(4).shuffle(pieces)
    pulled, kept, all_at = 0, [], ["file", "block", "seq", "part", "headed"]

    def frames():
        nonlocal pulled
        for at in range(0, len(pieces), 20):
            pulled += 1
            yield pd.DataFrame([(*p[:5], text(*p[5])) for p in pieces[at:at + 20]],
                               columns=["file", "block", "seq", "headed", "whole", "text"])

    record = S.OpenRecord(1000)
    record.handle, record.open = Handle(), State()
    tracemalloc.start()
    first = None
    for pdf in record.handleInputRows(("l",), frames(), Now()):
        first = first or pulled
        for *place, t in pdf[[*all_at, "text"]].itertuples(index=False):
            kept.append((*place, len(t), tuple(x.split(" ")[0] for x in t.split("\n"))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first == 1 and peak < 3_000_000   # of 12 MB
    one, n = len(text(0, 1)), lambda k, seq: len(text(k, seq))
    want = [(f"f{k:02d}", 0, seq, 0, True, n(k, seq), (f"{k}.{seq}",)) for k in range(splits) for seq in range(1, 19)]
    # a split's last record goes on in the first lines of the next; the last of all stays open
    want += [(f"f{k:02d}", 0, 19, 0, True, n(k, 19) + 1 + n(k + 1, 0), (f"{k}.19", f"{k + 1}.0")) for k in range(splits - 1)]
    want.append(("f00", 0, 0, 0, False, one, ("0.0",)))
    assert sorted(kept) == sorted(want)
    assert record.open.value[:4] == ("f59", 0, 19, 0) and record.open.value[4] == text(59, 19)


def test_folded_lines_say_which_records_are_whole():
    import pandas as pd
    from errorlens.streaming import log_text as S
    rows = [("l", "a", 0, h, t) for h, t in ((False, "left"), (True, "A"), (False, "a1"), (True, "B"), (True, "C"), (False, "c1"))]
    rows += [("l", "b", 0, h, t) for h, t in ((False, "c2"), (True, "D"))] + [("l", "b", 9, False, "d1")]
    frame = lambda x: pd.DataFrame(x, columns=["log", "file", "block", "is_head", "line"])
    for cut in range(len(rows) + 1):   # batches of Arrow end anywhere
        got = pd.concat(list(S.fold_lines(iter([frame(rows[:cut]), frame(rows[cut:])]))))
        assert [(r.file, r.block, r.seq, r.headed, r.whole, r.text) for r in got.itertuples()] == [
            ("a", 0, 0, False, False, "left"), ("a", 0, 1, True, True, "A\na1"), ("a", 0, 2, True, True, "B"),
            ("a", 0, 3, True, False, "C\nc1"), ("b", 0, 0, False, False, "c2"), ("b", 0, 1, True, False, "D"), ("b", 9, 0, False, False, "d1")]
