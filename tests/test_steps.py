"""Streams with state, over several files and a restart in between, against the same steps as one table."""

from loomline.streaming import events as ev
from loomline.streaming import steps as st

STEP = "g string, task string, content string, seq long, page long, tasks long"


def test_published_when_the_last_task_ends(spark, tmp_path):
    first = [("a", "t1", "x", 1, 5, 3), ("a", "t2", "x", 2, 6, 3), ("b", "t1", "x", 3, 7, 1), ("a", "t1", "x", 4, 5, 3)]  # the last one again
    later = [("a", "t2", "other", 5, 6, 3), ("c", "t1", "x", 6, 1, 2)]
    last = [("a", "t3", "y", 7, 8, 3), ("a", "t3", "y", 8, 8, 3), ("b", "t1", "z", 9, 7, 1)]
    own, folder = st.stateful_session(spark), f"file://{tmp_path}/run"

    def run():
        stream = ev.event_stream(own, str(tmp_path / "steps"), spark.createDataFrame([], STEP).schema, 1)
        return sorted(map(tuple, ev.run_to_end(st.publications(stream, ["g"]), folder, reader=spark).collect()))

    write = lambda rows: spark.createDataFrame(rows, STEP).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    write(first)
    write(later)
    so_far = [("a", "mismatch", "t2", 6, 5, 2), ("b", "published", "t1", 7, 3, 1)]
    assert run() == so_far
    assert run() == so_far  # nothing new
    write(last)  # a restart that goes on from the checkpoint
    assert run() == sorted([*so_far, ("a", "published", "t3", 8, 7, 3), ("b", "mismatch", "t1", 7, 9, 1)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != st.PROVIDER


def test_repeats_are_dropped_by_the_mark_of_their_run(spark, tmp_path):
    own, folder = st.stateful_session(spark), f"file://{tmp_path}/run"
    kind = "run long, seq long, said string"

    def run():
        stream = ev.event_stream(own, str(tmp_path / "sent"), spark.createDataFrame([], kind).schema, 1)
        return sorted(map(tuple, ev.run_to_end(st.once_per_run(stream, "run"), folder, reader=spark).collect()))

    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "sent"))
    write([(1, 2, "b"), (1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    write([(1, 2, "b"), (1, 3, "d"), (2, 1, "c")])
    assert run() == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    write([(1, 1, "a"), (1, 3, "d"), (1, 4, "e"), (3, 1, "f")])
    assert run() == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (1, 4, "e"), (2, 1, "c"), (3, 1, "f")]


def test_messages_to_the_state_follow_connections_not_tasks():
    import pandas as pd

    calls = []

    class Held:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, call):
            def run(*args):
                calls.append(f"{self.name}.{call}")
                if call == "get":
                    return iter(self.value or []) if self.name == "done" else self.value
                self.value = [*(self.value or []), *args[0]] if call == "appendList" else args[0]

            return run

    publisher = st.Publisher(["g", "outcome", "task", "page", "at_", "n"])
    publisher.done, publisher.progress = Held("done"), Held("progress")
    step = lambda rows: iter([pd.DataFrame(rows, columns=["task", "content", "seq", "page", "tasks"])])
    assert list(publisher.handleInputRows(("a",), step([(f"t{i}", "x", i, i, 600) for i in range(500)]), None)) == []
    (out,) = publisher.handleInputRows(("a",), step([(f"t{i}", "y" if i == 3 else "x", 1000 + i, i, 600) for i in range(600)]), None)
    assert out.values.tolist() == [["a", "mismatch", "t3", 3, 1003, 500], ["a", "published", "t599", 599, 1599, 600]]
    assert len(calls) <= 8  # more than 1,600 before
