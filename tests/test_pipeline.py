import pytest

from tarnwell.__main__ import main
from tarnwell.plans import pipeline
from tarnwell.sources.tables import load_table, once


def test_steps():
    calls, waits = [], []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("once more")
        return 7

    summary = pipeline.run_steps([("a", lambda: 1), ("b", shaky), ("c", lambda: 2)], skip=["c"], sleep=waits.append)
    assert [(o.step, o.status, o.rows, o.attempts) for o in summary.outcomes] == [("a", "ok", 1, 1), ("b", "ok", 7, 3), ("c", "skipped", 0, 0)] and waits == [1.0, 2.0] and summary.ok
    failed = pipeline.run_steps([("a", lambda: 1 / 0), ("b", lambda: 1)], attempts=2, sleep=waits.append)
    assert [o.status for o in failed.outcomes] == ["failed"] and "ZeroDivisionError" in failed.outcomes[0].error and not failed.ok


def test_pipeline(spark, data, tmp_path):
    documents, blocks = once(load_table(spark, data, "paper_documents"), "id"), once(load_table(spark, data, "paper_blocks").drop("metadata"), "id")
    summary = pipeline.run_pipeline(spark, documents, blocks, str(tmp_path))
    assert summary.ok and [o.status for o in summary.outcomes] == ["ok"] * 3 and summary.outcomes[0].rows >= summary.outcomes[2].rows > 0
    again = pipeline.run_pipeline(spark, documents, blocks, str(tmp_path), skip=["chunk", "embed"])
    assert again.outcomes[2].rows == summary.outcomes[2].rows
    fixed = pipeline.chunk_step(documents, blocks, "fixed")
    assert fixed.select("document_id").distinct().count() == documents.count()


def test_command_line(spark, data, capsys):
    assert main(["list"]) == 0 and "hybrid_search" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", data])
