import datetime as dt
import json

from signalfold.operators.state import StateTable
from signalfold.streaming import replies


def test_replies_are_taken_once_and_the_latest_followup_stays(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("lead_id", "from_email", "received_at", "due"), r, strict=True))) for r in rows))

    def run():
        stream = replies.once(replies.read_replies(spark, f"file://{tmp_path}/in"))
        replies.keep_followups(stream, table, f"file://{tmp_path}/check").awaitTermination()
        return {r["lead_id"]: r["due"] for r in table.read().collect()}

    table = StateTable(spark, f"file://{tmp_path}/followups", ["lead_id"], "received_at")
    put("1.json", ("a", "X@firm.example", "2024-03-01T10:00:00", "2024-04-01"), ("a", "x@firm.example ", "2024-03-01T10:00:00", "2024-09-09"), ("b", "y@firm.example", "2024-03-01T11:00:00", None), ("c", "", "2024-03-01T11:00:00", "2024-04-01"))
    assert run() in ({"a": dt.date(2024, 4, 1)}, {"a": dt.date(2024, 9, 9)})
    put("2.json", ("a", "x@firm.example", "2024-03-02T10:00:00", "2024-05-01"), ("b", "y@firm.example", "2024-03-02T11:00:00", "2024-05-02"), ("a", "x@firm.example", "2024-03-01T10:00:00", "2024-12-12"))
    assert run() == {"a": dt.date(2024, 5, 1), "b": dt.date(2024, 5, 2)}
