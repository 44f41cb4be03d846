import shutil

import pytest

from flowcascade.sources import store


def values(spark, path):
    folder, notes = store.open_version(spark, path)
    return store.read_json(spark, f"{folder}/a"), store.read_json(spark, f"{folder}/b"), notes


def save(spark, path, value):
    def write(folder):
        store.write_json(spark, [value, "a"], f"{folder}/a")
        store.write_json(spark, [value, "b"], f"{folder}/b")
        return {"value": value}
    return store.save_version(spark, path, write)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "saved")


def test_newest_version_is_read(spark, path):
    for value in (1, 2, 3):
        save(spark, path, value)
        assert values(spark, path) == ([value, "a"], [value, "b"], {"value": value})


def test_old_versions_go(spark, path, tmp_path):
    versions = [save(spark, path, i) for i in range(4)]
    for kind in ("versions", "manifests"):
        assert sorted(p.name for p in (tmp_path / "saved" / kind).iterdir()) == versions[2:]


def test_a_save_that_breaks_off_leaves_the_old_version(spark, path):
    save(spark, path, 1)

    def breaks(folder):
        store.write_json(spark, [2, "a"], f"{folder}/a")
        raise OSError("disk full")

    with pytest.raises(OSError):
        store.save_version(spark, path, breaks)
    assert values(spark, path)[2] == {"value": 1}
    save(spark, path, 3)
    assert values(spark, path)[2] == {"value": 3}


def test_a_mix_of_two_saves_is_refused(spark, path):
    first, second = save(spark, path, 1), save(spark, path, 2)
    shutil.rmtree(f"{path}/versions/{second}/a")
    shutil.copytree(f"{path}/versions/{first}/a", f"{path}/versions/{second}/a")
    with pytest.raises(RuntimeError, match="does not fit its manifest.*a/"):
        store.open_version(spark, path)


def test_a_missing_part_is_refused(spark, path):
    version = save(spark, path, 1)
    shutil.rmtree(f"{path}/versions/{version}/b")
    with pytest.raises(RuntimeError, match="does not fit its manifest"):
        store.open_version(spark, path)
    shutil.rmtree(f"{path}/versions/{version}")
    with pytest.raises(RuntimeError, match="incomplete"):
        store.open_version(spark, path)


def test_nothing_saved(spark, path):
    with pytest.raises(RuntimeError, match="nothing was saved"):
        store.open_version(spark, path)
