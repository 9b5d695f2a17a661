"""Locks, the guarded split and the feature register."""

import pytest

from sentrymill.operators import governance as g


def test_lock(tmp_path, monkeypatch):
    a, lock = tmp_path / "a.txt", str(tmp_path / "lock.json")
    a.write_text("1")
    g.write_lock(lock, [str(a)])
    g.verify_lock(lock, [str(a)])
    with pytest.raises(PermissionError):
        g.open_split("test", lock)
    monkeypatch.setenv("SENTRYMILL_OPEN_TEST", "1")
    assert [g.open_split("test", lock), g.open_split("test", lock), g.open_split("val", lock)] == [1, 2, 0]
    a.write_text("2")
    with pytest.raises(RuntimeError):
        g.verify_lock(lock, [str(a)])


def test_register():
    total, residuals = g.check_register()
    assert total <= g.STATE_BUDGET and residuals == 21 and len(g.FEATURES) == 28
    with pytest.raises(ValueError):
        g.check_register((*g.FEATURES, g.FEATURES[0]))
    with pytest.raises(ValueError):
        g.align(["a"], ["a", "b"])
    g.added_columns(["a"], ["a", "r_a"], {"r_a"})
    with pytest.raises(ValueError):
        g.added_columns(["a"], ["a", "b"], {"r_a"})
