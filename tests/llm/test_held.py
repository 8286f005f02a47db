"""What a worker process keeps between tasks, and when it lets go."""

import time

import pyarrow as pa

from turnloom.llm import common


def test_kept_for_the_same_operator_and_dropped_by_another(monkeypatch):
    task, made = [1], []
    monkeypatch.setattr(common, "_task", lambda: task[0])
    monkeypatch.setattr(common, "_HELD", {})
    batch = pa.RecordBatch.from_pydict({"text": ["a", None]})

    def use(key=7):
        return common.held("thing", key, lambda: made.append(key) or object())

    first = use()
    assert list(common.byte_blocks([batch], "text")) and use() is first
    task[0] = 2
    assert use() is first and list(common.byte_blocks([batch], "text")) and made == [7]
    task[0] = 3     # a task of another operator
    list(common.byte_blocks([batch], "text"))
    assert not common._HELD and use() is not first
    use(8)          # one for a name
    assert list(common._HELD) == [("thing", 8)] and made == [7, 7, 8]


def test_dropped_when_no_task_comes(monkeypatch):
    monkeypatch.setattr(common, "_task", lambda: 1)
    monkeypatch.setattr(common, "_HELD", {})
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.2)
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    common.held("thing", 1, object)
    list(common.byte_blocks([batch], "text"))
    assert common._HELD     # at once another task may ask for it
    running = common.byte_blocks([batch], "text")
    next(running)
    time.sleep(0.5)
    assert common._HELD     # a task is at work
    running.close()
    time.sleep(0.5)
    assert not common._HELD


def test_nothing_is_dropped_outside_tasks(monkeypatch):
    monkeypatch.setattr(common, "_HELD", {})
    value = common.held("thing", 1, object)
    list(common.byte_blocks([], "text"))
    assert common.held("thing", 1, object) is value
