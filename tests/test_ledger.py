"""Model calls with a ledger: answers are kept over runs that fail or stop."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from errorlens.operators.ledger import complete_with_ledger, prompt_key, read_ledger


def counted(folder, model):
    """``model`` leaving one file for each call in ``folder``."""
    os.makedirs(folder, exist_ok=True)

    def call(prompt):
        with open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w"):
            pass
        return model(prompt)
    return call


def calls(folder):
    names = [n.rsplit("-", 1)[0] for n in os.listdir(folder)] if os.path.isdir(folder) else []
    return {n: names.count(n) for n in names}


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")


def test_a_rerun_calls_only_what_is_missing(spark, tmp_path):
    texts = [f"p{i}" for i in range(12)] + ["p0", "p0", None, ""]
    asked, ledger = prompts(spark, texts), f"{tmp_path}/ledger"

    def flaky(p):
        if p in ("p3", "p7"):
            raise ValueError("busy")
        return None if p == "p5" else f"answer {p}"

    got = {r.id: r for r in complete_with_ledger(asked, counted(f"{tmp_path}/one", flaky), ledger, tries=2, calls_per_task=3).collect()}
    assert len(got) == len(texts)
    assert [got[i].response for i in (0, 12, 13)] == ["answer p0"] * 3
    assert got[3].response is None and got[3].error == "ValueError: busy" and got[5].error == "no answer"
    assert got[14].response is None and got[14].error is None and got[15].response == "answer "
    once = calls(f"{tmp_path}/one")
    assert once == {**{f"p{i}": 1 for i in range(12)}, "p3": 2, "p5": 2, "p7": 2, "": 1}

    got = complete_with_ledger(asked, counted(f"{tmp_path}/two", lambda p: f"late {p}"), ledger).collect()
    assert calls(f"{tmp_path}/two") == {"p3": 1, "p5": 1, "p7": 1}
    assert {r.id: r.response for r in got}[3] == "late p3" and all(r.error is None for r in got)
    complete_with_ledger(asked, counted(f"{tmp_path}/three", lambda p: p), ledger).collect()
    assert calls(f"{tmp_path}/three") == {}
    complete_with_ledger(asked, counted(f"{tmp_path}/four", lambda p: p), ledger, model="other").collect()
    assert len(calls(f"{tmp_path}/four")) == 13                 # another model asks anew


def test_tries_end(spark, tmp_path):
    asked, ledger = prompts(spark, ["x"]), f"{tmp_path}/ledger"
    for k in range(4):
        complete_with_ledger(asked, counted(f"{tmp_path}/calls", lambda p: None), ledger, tries=2, give_up=4)
    assert calls(f"{tmp_path}/calls") == {"x": 4}


def test_a_killed_job_keeps_its_answers(spark, tmp_path):
    texts = [f"p{i}" for i in range(40)]
    asked, ledger, stop = prompts(spark, texts), f"{tmp_path}/ledger", f"{tmp_path}/one"

    def dies(p):
        if len(os.listdir(stop)) > 20:
            os._exit(1)                                          # the worker is gone in the middle of a call
        return f"answer {p}"

    with pytest.raises(Exception):
        complete_with_ledger(asked, counted(stop, dies), ledger, calls_per_task=1).collect()
    key = asked.select("prompt", prompt_key("").alias("key"))
    kept = {r.prompt for r in read_ledger(spark, ledger).where(F.col("response").isNotNull()).join(key, "key").collect()}
    assert 0 < len(kept) < 40
    got = complete_with_ledger(asked, counted(f"{tmp_path}/two", lambda p: f"answer {p}"), ledger).collect()
    assert {r.prompt: r.response for r in got} == {t: f"answer {t}" for t in texts}
    assert calls(f"{tmp_path}/two") == {t: 1 for t in texts if t not in kept}
    assert all(calls(stop)[t] == 1 for t in kept)


def test_no_prompts(spark, tmp_path):
    assert complete_with_ledger(prompts(spark, []), lambda p: p, f"{tmp_path}/l").collect() == []
