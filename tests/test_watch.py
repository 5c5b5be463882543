"""Changes by state, batches, drained on stop, for one project and for a workspace; the event log and its totals."""

import threading

import pytest
from pyspark.sql import functions as F

from grove.api import Project, Workspace
from grove.operators import change
from grove.streaming.watch import Watcher


def plain_changes(listings, state):
    """listings: {project: [(number, {path: hash})]} in order."""
    out = set()
    for project, rows in listings.items():
        last = dict(state.get(project, {}))
        for number, files in rows:
            out |= {(project, number, p, "deleted" if p not in files else "added" if p not in last else "modified") for p in {*last, *files} if last.get(p) != files.get(p)}
            last = files
    return out


def test_changes_of_several_listings_at_once(spark):
    listings = {
        "a": [(1, {"x": "1", "y": "1"}), (2, {"x": "2", "z": "1"}), (5, {}), (6, {"x": "2", "y": "9"}), (7, {"x": "2", "y": "9"})],
        "b": [(3, {"x": "1"})],
        "c": [(4, {})],
    }
    state = {"a": {"y": "1", "w": "0"}, "c": {"q": "1"}, "silent": {"x": "1"}}
    rows = [(p, n, f, h) for p, each in listings.items() for n, files in each for f, h in [(None, None), *files.items()]]
    before = spark.createDataFrame([(p, f, h) for p, files in state.items() for f, h in files.items()], "project string, path string, hash string")
    df = spark.createDataFrame(rows, "project string, listing long, path string, hash string")
    assert {tuple(r) for r in change.listing_changes(df, before).collect()} == plain_changes(listings, state)
    after = {tuple(r) for r in change.listing_state(df, before).collect()}
    assert after == {("a", "x", "2"), ("a", "y", "9"), ("b", "x", "1"), ("silent", "x", "1")}


@pytest.fixture
def watching(spark, tmp_path):
    running = []

    def make(roots, refresh, **options):
        w = Watcher(spark, str(tmp_path / "watch"), roots, refresh, delay="100 milliseconds", **options).start(poll=False)
        running.append(w)
        return w

    yield make
    for w in running:
        for q in (w._changes, w._batches):
            q.stop()
        spark.streams.removeListener(w.log)


def test_each_event_once_over_a_restart(spark, tmp_path, watching):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("one = 1\n")
    w = watching({"p": str(root)}, lambda p: {})
    steps = [lambda: None, lambda: (root / "a.py").write_text("one = 2\n"), lambda: (root / "a.py").write_text("one = 3\n"), lambda: (root / "a.py").rename(root / "b.py"), lambda: None, lambda: (root / "b.py").unlink()]
    for s in steps[:3]:
        s()
        w.poll()
    for q in (w._changes, w._batches):  # as a process that ends without draining
        q.stop()
    again = watching({"p": str(root)}, lambda p: {})
    assert again.clock == w.clock
    for s in steps[3:]:
        s()
        again.poll()
    got = [(r["path"], r["change"]) for r in again.events().orderBy("listing", "change").collect()]
    assert got == [("a.py", "added"), ("a.py", "modified"), ("a.py", "modified"), ("b.py", "added"), ("a.py", "deleted"), ("b.py", "deleted")]


def test_pending_changes_are_drained_once(spark, tmp_path, watching):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("one = 1\n")
    seen = []
    w = watching({"p": str(root)}, lambda p: seen.append(p) or {"added": 1}, quiet="10 minutes")
    w.poll()
    (root / "b.py").write_text("two = 2\n")
    w.poll()
    w.settle()
    assert seen == []  # the quiet time isn't over
    w.stop()
    assert seen == ["p"]
    events = {r["event"]: r for r in w.log.events().collect()}
    assert events["reindex"]["files_changed"] == 2 and events["stop"]["total_reindexes"] == 1 and events["stop"]["total_files_processed"] == 2
    later = watching({"p": str(root)}, lambda p: seen.append(p) or {}, quiet="10 minutes")
    later.poll()
    later.settle()
    assert seen == ["p"] and later.clock > w.clock
    (root / "c.py").write_text("three = 3\n")
    later.poll()
    later.stop()
    assert seen == ["p", "p"]
    stops = [r for r in later.log.events().where("event = 'stop'").orderBy("at").collect()]
    reindexed = later.log.events().where("event = 'reindex'").agg(F.count("*").alias("n"), F.sum("files_changed").alias("files")).first()
    assert (stops[-1]["total_reindexes"], stops[-1]["total_files_processed"]) == (reindexed["n"], reindexed["files"]) == (2, 3)


def workspace(tmp_path, names):
    (tmp_path / "ws").mkdir()
    for n in names:
        d = tmp_path / "ws" / n
        d.mkdir()
        (d / f"{n}.py").write_text(f"def {n}_first():\n    return 1\n")
        (d / ".grove").mkdir()
        (d / ".grove" / "config.toml").write_text('[project]\nlanguages = ["python"]\n')
    (tmp_path / "ws" / "grove-workspace.toml").write_text('[workspace]\nname = "w"\n' + "".join(f'\n[[workspace.members]]\npath = "{n}"\n' for n in names))
    return str(tmp_path / "ws")


def test_workspace_watch_goes_on_without_a_member(spark, tmp_path):
    root = workspace(tmp_path, ["one", "two", "three"])
    (tmp_path / "ws" / "two" / ".grove" / "config.toml").write_text("this is = = no toml")
    ws = Workspace(spark, root)
    w = ws.watch(poll=False)
    try:
        with pytest.raises(RuntimeError):
            ws.watch(poll=False)
        w.poll()
        assert w.again == {"two"}
        for n in ("one", "three"):
            (tmp_path / "ws" / n / "more.py").write_text(f"def {n}_second():\n    return {n}_first()\n")
        assert w.poll() == 2
    finally:
        w.stop()
    members = ws.members()
    for n in ("one", "three"):
        assert members[n].index.graph().find_symbol(f"{n}_second").count() == 1
    assert members["two"].index.version() is None
    assert {r["project"] for r in w.log.events().where("event = 'error'").select("project").distinct().collect()} == {"two"}
    (tmp_path / "ws" / "two" / ".grove" / "config.toml").write_text('[project]\nlanguages = ["python"]\n')
    again = ws.watch(poll=False)
    again.stop()
    assert members["two"].index.graph().find_symbol("two_first").count() == 1


def test_project_watch_by_itself(spark, tmp_path):
    root = workspace(tmp_path, ["solo"])
    project = Project(spark, f"{root}/solo")
    w = project.watch()
    threading.Event().wait(0.5)
    (tmp_path / "ws" / "solo" / "late.py").write_text("def late():\n    return 2\n")
    w.poll()
    w.stop()
    assert project.index.graph().find_symbol("late").count() == 1 and not (tmp_path / "ws" / "solo" / ".grove" / "watch.lock").exists()
