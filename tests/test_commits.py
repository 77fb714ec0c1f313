"""Two writers on one log of versions."""

import pytest

from codeloom.sources import snapshot


def test_second_change_to_one_base_fails(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert snapshot._publish(spark, folder, "first", 0) == 1
    assert snapshot._publish(spark, folder, "a", 1) == 2
    with pytest.raises(snapshot.ConcurrentCommit):
        snapshot._publish(spark, folder, "b", 1)
    assert snapshot.current_version(spark, folder) == 2
    assert snapshot._publish(spark, folder, "b again", 2) == 3


def test_entry_of_a_dead_writer_is_passed(spark, tmp_path):
    folder = f"file://{tmp_path}"
    snapshot._publish(spark, folder, "first", 0)
    (tmp_path / "log" / "00000002").touch()
    assert snapshot._publish(spark, folder, "next", 1) == 3 and snapshot.current_version(spark, folder) == 3
