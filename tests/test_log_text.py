"""Text logs by byte ranges and as streams."""

import io
import random


from errorlens.sources import log_text as LT

HEADS = ["2024-01-01 00:00:00.000 [a] INFO  x.Y - m", "1999-12-31 23:59:59.999 [", "2024-01-01 00:00:00.000 [b] ERROR z - "]
OTHER = ["", "\tat a.b(C.java:1)", "2024-01-01 00:00:00.000 no bracket", " 2024-01-01 00:00:00.000 [x] a b - c", "\r", "x" * 40]


def plain(raw: bytes) -> list[tuple]:
    """(pos, headed, lines) of a file by its lines."""
    out, pos = [], 0
    for line in raw.split(b"\n"):
        if LT.HEAD.match(b"\n" + line):
            out.append((pos, True, [line]))
        elif out:
            out[-1][2].append(line)
        else:
            out.append((0, False, [line]))
        pos += len(line) + 1
    return out


def text_of(lines: list[bytes]) -> bytes:
    return b"\n".join(x[:-1] if x.endswith(b"\r") else x for x in lines).rstrip(b"\n")


def test_any_ranges_give_each_record_once():
    rng = random.Random(5)
    for _ in range(300):
        lines = [rng.choice(HEADS if rng.random() < 0.4 else OTHER) for _ in range(rng.randint(0, 12))]
        raw = "\n".join(lines).encode() + rng.choice([b"", b"\n"])
        want = [(p, h, text_of(x)) for p, h, x in plain(raw)]
        want = [(p, h, t) for p, h, t in want if t or h]
        cuts = sorted({0, len(raw), *(rng.randint(0, len(raw)) for _ in range(rng.randint(0, 6)))})
        got = []
        for a, b in zip(cuts, cuts[1:]):
            got += [(p, h, t) for p, part, h, t in LT.records(io.BytesIO(raw), a, b, block_bytes=rng.choice([1, 7, 30, 1000])) if part == 0]
        assert got == want, (raw, cuts)


def test_long_records_come_in_parts():
    head, body = HEADS[0].encode(), [b"line %d" % i for i in range(5000)]
    raw = b"\n".join([head, *body, HEADS[2].encode(), b"last"]) + b"\n"
    rows = list(LT.records(io.BytesIO(raw), 0, len(raw), fragment_bytes=1000, block_bytes=300))
    first = [r for r in rows if r[0] == 0]
    assert [r[1] for r in first] == list(range(len(first))) and len(first) > 20
    assert all(len(r[3]) < 1400 for r in first) and first[0][3].startswith(head)
    assert b"\n".join(r[3] for r in first) == b"\n".join([head, *body])
    assert rows[-1][1:] == (0, True, HEADS[2].encode() + b"\nlast")
    assert list(LT.records(io.BytesIO(raw), 500, 900)) == []   # inside the record


def test_the_scan_is_one_pass_without_a_shuffle(spark, tmp_path):
    import __spark_entry__ as E
    from errorlens.sources.logs import read_log_files, scan_log_files
    path = E._log_files(spark, "/root/testdata/sf0.001")
    scan = scan_log_files(spark, path, split_bytes=3000)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("BatchScan") == 1 and "Pandas" not in plan
    cols = ["timestamp", "thread_name", "level", "logger", "message", "stack_trace"]
    got = sorted(map(tuple, scan.where("kind = 'entry'").select(cols).collect()), key=repr)
    whole = sorted(map(tuple, read_log_files(spark, path, how="whole").select(cols).collect()), key=repr)
    assert scan.rdd.getNumPartitions() > 8 and len(got) == 1000 and got == whole


def test_files_folders_patterns_and_packed_files(spark, tmp_path):
    import gzip
    from errorlens.sources.logs import read_log_files, scan_log_files
    line = "2024-01-01 00:00:0%d.000 [m] INFO  a.B - %s\n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_text(line % (1, "one"))
    (tmp_path / "sub" / "b.log").write_text(line % (2, "two"))
    (tmp_path / "_hidden").write_text(line % (3, "three"))
    (tmp_path / "empty.log").write_text("")
    with gzip.open(tmp_path / "c.log.gz", "wt") as f:
        f.write(line % (4, "four") + "\tat x\n")
    got = lambda p: sorted(r["message"] for r in read_log_files(spark, f"{tmp_path}/{p}", split_bytes=10).collect())
    assert got("") == ["four", "one", "two"] and got("*.log") == ["one"] and got("a.log") == ["one"]
    assert read_log_files(spark, f"{tmp_path}/empty.log").count() == 0
    long = "2024-01-01 00:00:01.000 [m] ERROR a.B - long\n" + "\n".join(f"\tat x.y(Z.java:{i})" for i in range(3000)) + "\n"
    (tmp_path / "long.log").write_text(long)
    rows = scan_log_files(spark, f"{tmp_path}/long.log", fragment_bytes=5000).orderBy("part").collect()
    assert [r["kind"] for r in rows] == ["entry"] + ["fragment"] * (len(rows) - 1) and len(rows) > 3
    assert "\n".join([rows[0]["stack_trace"], *(r["text"] for r in rows[1:])]) == long.split("\n", 1)[1].rstrip("\n")


def test_a_line_longer_than_a_part_stays_whole():
    raw = HEADS[0].encode() + b"\n" + b"y" * 5000 + b"\nz\n"
    rows = list(LT.records(io.BytesIO(raw), 0, len(raw), fragment_bytes=100, block_bytes=64))
    assert b"\n".join(r[3] for r in rows) == raw.rstrip(b"\n") and any(b"y" * 5000 in r[3] for r in rows)
