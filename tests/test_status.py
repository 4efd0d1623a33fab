"""The status of jobs from events in any order."""

import json

from folioscale.plans.session import ship
from folioscale.streaming import status


def test_status_of_jobs_with_late_and_lost_events(spark, tmp_path):
    ship(spark)
    (tmp_path / "in").mkdir()
    at = lambda s: f"2026-05-09T10:{s // 60:02d}:{s % 60:02d}.000Z"

    def put(name, *events):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"doc_id": d, "at": at(s), "stage": stage, "progress": p, "message": stage}) + "\n" for d, s, stage, p in events))
        q = status.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), late_by="20 minutes")
        q.awaitTermination(300)
        return {r.doc_id: (r.status, r.progress) for r in status.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}

    got = put("1", ("fine", 0, "queued", 0), ("fine", 5, "running", 10), ("fine", 2, "running", 5), ("slow", 1, "running", 10), ("lost", 3, "queued", 0), ("bad", 4, "running", 10), ("only", 5, "queued", 0), (None, 1, "queued", 0))
    assert got == {"fine": ("running", 10), "slow": ("running", 10), "lost": ("queued", 0), "bad": ("running", 10), "only": ("queued", 0)}
    # an end without a begin; an end that comes before news of its begin; two ends
    got = put("2", ("lost", 60, "done", 100), ("early", 90, "done", 100), ("bad", 50, "failed", 40), ("bad", 55, "done", 100))
    assert got["lost"] == ("done", 100) and got["bad"] == ("failed", 40)
    got = put("3", ("early", 30, "running", 10), ("fine", 80, "done", 100), ("clock", 2500, "queued", 0))
    assert got["early"] == ("done", 100) and got["fine"] == ("done", 100)
    # all events are past the deadline of the slow one now, so its timer has run out; its end comes too late
    got = put("4", ("slow", 2400, "done", 100), ("clock", 2600, "running", 1))
    assert got["slow"] == ("timed_out", 10) and got["only"] == ("queued", 0) and got["clock"] == ("running", 1)
