import pytest

from foliant.llm import tokenfiles, warc


def test_ids_that_do_not_fit_are_refused(spark, monkeypatch):
    import numpy as np

    row = spark.createDataFrame([(1, "a")], "doc_id long, text string").toArrow().to_batches()[0]
    monkeypatch.setattr(tokenfiles, "token_ids", lambda column, tokenizer: (np.array([1 << 16, 2]), np.array([0, 2])))
    monkeypatch.setattr(tokenfiles, "put", lambda path, parts: None)
    monkeypatch.setattr(tokenfiles, "TaskContext", type("T", (), {"get": lambda: type("P", (), {"partitionId": lambda self: 0})()}))
    held = {}
    monkeypatch.setattr(tokenfiles, "written", lambda frame, name: frame)

    class Frame:
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, run, schema):
            held["run"] = run
            raise InterruptedError

    with pytest.raises(InterruptedError):
        tokenfiles.write_tokens(Frame(), "none", "folder")
    with pytest.raises(ValueError):
        list(held["run"](iter([row])))


def test_rules_do_not_pay_for_counts_that_are_there():
    import time

    import pyarrow as pa

    from foliant.llm import quality

    column = pa.array([f"word {k} and more of it" for k in range(400)])
    seen = []

    def asks(name, rejects):
        def rule(t):
            seen.append((name, set(quality.PAID) <= set(t.known), "extra" in t.known))
            t.known["extra"] = True  # what one rule has counted is not there for the next one's measurement
            return rejects(t)

        return rule

    rules = {"free": asks("free", lambda t: t.n_symbols() == 0), "dear": asks("dear", lambda t: (time.sleep(0.02), t.n_symbols() == 0)[1])}
    assert quality.order_rules(column, rules) == ["free", "dear"]
    assert seen == [("free", True, False), ("dear", True, False)]


def test_the_sample_is_spread():
    import pyarrow as pa

    from foliant.llm import quality

    column = pa.array(["good words of the text are here"] * 900 + ["bad"] * 100)
    got = []
    quality.order_rules(column, {"x": lambda t: (got.append(t.rows), t.n_words == 1)[1], "y": lambda t: (got.append(int((t.n_words == 1).sum())), t.n_words == 9)[1]}, sample_bytes=6000)
    assert got[0] < 400 and got[1] > 10
