"""What a task has freed is given back to the system, as idle workers stay beside those of the next stage."""

import resource
from pathlib import Path

import numpy as np
import pyarrow as pa

from bookloom.llm import common, toxicity


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() >> 20


def test_freed_memory_goes_back():
    held = [b"x" * 100_000 for _ in range(2000)]
    pins = held[::500] + held[-1:]  # the heap's end stays in use
    full = resident()
    del held
    common.trim()
    assert full - resident() > 150 and pins


def test_one_python_worker_for_a_task(spark, monkeypatch):
    """Steps in Python that are not parted by a shuffle run in a worker each, and every worker stays for the stages after."""
    kind = type(spark.range(1))
    plans, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or collect(df))
    counts = toxicity.trigram_counts(spark.createDataFrame([(f"word {i}",) for i in range(40)], "text string").repartition(3))
    assert counts.sum() > 0 and plans
    assert all(stage.count("MapInArrow") <= 1 for plan in plans for stage in plan.split("Exchange"))


class Rows:
    """In place of a DataFrame: mapInArrow gives back the function that a task would run."""

    schema = None

    def mapInArrow(self, run, schema):
        return run


def test_trims_when_a_step_has_ended(monkeypatch):
    """The rows that pass come as before, and memory is given back once after the last."""
    said = []
    monkeypatch.setattr(common, "trim", lambda: said.append("trim"))
    step = common.passing(Rows(), "doc_id", np.full(128, 255, np.uint8))
    for batch in step(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2]}), pa.RecordBatch.from_pydict({"doc_id": [3]})])):
        said.append(batch.num_rows)
    assert said == [2, 1, "trim"]


def test_slices_count_both_texts():
    batch = pa.RecordBatch.from_pydict({"a": ["x"] * 6 + [None], "b": ["y" * 9] * 6 + ["z" * 50]})
    assert [s.num_rows for s in common.text_slices(iter([batch]), "a", "b", limit=20)] == [2, 2, 2, 1]
