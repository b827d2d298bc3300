"""Installed paths of whole, corrupt and missing manifests."""

from siltstone.sources import readers


def test_a_corrupt_manifest_is_empty(spark, tmp_path):
    cases = {"fine": '{"files": ["a", "b", "a", null]}', "corrupt": '{"files": ["a"', "other": '{"files": 7}', "list": "[1]"}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    got = {name: sorted(r.path for r in readers.installed_paths(spark, str(tmp_path / name)).collect()) for name in [*cases, "missing"]}
    assert got == {"fine": ["a", "b"], "corrupt": [], "other": [], "list": [], "missing": []}
