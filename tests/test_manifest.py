"""Sets of tables are published together or not at all."""

from __future__ import annotations

import pytest

from fluxora.sources import files, manifest


def counts(spark, root, name=None):
    return {t: df.count() for t, df in manifest.read_set(spark, root, name).items()}


def sound(_name, df):
    return ["empty"] if df.isEmpty() else []


def test_a_set_is_whole_or_old(spark, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        manifest.read_set(spark, root)
    with pytest.raises(LookupError):
        manifest.roll_back(spark, root)
    first, _ = manifest.publish_set({"a": spark.range(1), "b": spark.range(2), "c": spark.range(3)}, root, sound)
    old = {"a": 1, "b": 2, "c": 3}
    assert counts(spark, root) == old
    # A table that does not pass, whichever it is.
    for bad in "abc":
        tables = {t: spark.range(0 if t == bad else 9) for t in "abc"}
        assert manifest.publish_set(tables, root, sound) == (None, {bad: ["empty"]})
        assert counts(spark, root) == old
    # A failure between any two tables.
    for broken in "abc":
        def failing(name, df, broken=broken):
            if name == broken:
                raise OSError("connection lost")
            return []

        with pytest.raises(OSError):
            manifest.publish_set({t: spark.range(9) for t in "abc"}, root, failing)
        assert counts(spark, root) == old
    assert len(list((tmp_path / "set" / "a").iterdir())) == 1  # nothing is left behind
    # A failure before the pointer moves.
    second, _ = manifest.publish_set({"b": spark.range(20)}, root, sound)
    assert counts(spark, root) == {"a": 1, "b": 20, "c": 3}
    assert counts(spark, root, first) == old
    assert manifest.roll_back(spark, root) == first
    assert counts(spark, root) == old


def test_pointer_failure_and_conflict(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    manifest.publish_set({"a": spark.range(1), "b": spark.range(2)}, root, sound)
    real = files._replace_file

    def no_pointer(session, path, text):
        if path.endswith(files.POINTER):
            raise OSError("no rename")
        real(session, path, text)

    with monkeypatch.context() as m:
        m.setattr(manifest, "_replace_file", no_pointer)
        with pytest.raises(OSError):
            manifest.publish_set({"a": spark.range(5), "b": spark.range(5)}, root, sound)
    assert counts(spark, root) == {"a": 1, "b": 2}

    def overtaken(name, df):
        if name == "a":
            manifest.publish_set({"b": spark.range(7)}, root, sound)
        return []

    with pytest.raises(manifest.Conflict):
        manifest.publish_set({"a": spark.range(5), "b": spark.range(5)}, root, overtaken)
    assert counts(spark, root) == {"a": 1, "b": 7}


def test_clean_up_keeps_the_last_sets(spark, tmp_path):
    root = str(tmp_path / "set")
    names = [
        manifest.publish_set({"a": spark.range(n), "b": spark.range(1)} if n == 1 else {"a": spark.range(n)}, root, sound)[0]
        for n in (1, 2, 3, 4)
    ]
    gone = manifest.clean_up(spark, root, keep=2)
    assert len(gone) == 4  # two versions of a, two manifests
    assert counts(spark, root) == {"a": 4, "b": 1}
    assert counts(spark, root, names[2]) == {"a": 3, "b": 1}
    assert manifest.clean_up(spark, root, keep=2) == []
    assert manifest.roll_back(spark, root) == names[2]
    with pytest.raises(LookupError):
        manifest.roll_back(spark, root)
    with pytest.raises(ValueError):
        manifest.clean_up(spark, root, keep=0)
