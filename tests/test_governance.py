import pytest

from asofgraph import governance as g


def test_hashes_and_addresses(tmp_path):
    assert g.config_hash({"a": 1, "b": [2]}) == g.config_hash({"b": [2], "a": 1})
    with pytest.raises(ValueError):
        g.canonical_json({"a": float("nan")})
    (tmp_path / "x").write_text("1")
    assert list(g.tree_manifest(tmp_path)) == ["x"]
    assert g.require_official_url("https://www.example.org/q", ["www.example.org"], "/q")
    for bad in ("http://www.example.org/", "https://www.example.org.evil.org/", "https://u@www.example.org/", "https://www.example.org:8443/", " https://www.example.org/"):
        with pytest.raises(ValueError):
            g.require_official_url(bad, ["www.example.org"])


def test_registry_appends_once_and_sees_changes(tmp_path):
    registry, entry = g.Registry(tmp_path / "r.csv"), dict.fromkeys(g.REGISTRY_FIELDS, "x")
    registry.append(entry)
    registry.append(entry | {"experiment_id": "y"})
    assert [r["experiment_id"] for r in registry.verify()] == ["x", "y"]
    with pytest.raises(ValueError):
        registry.append(entry)
    (tmp_path / "r.csv").write_text((tmp_path / "r.csv").read_text().replace("y", "z"))
    with pytest.raises(ValueError):
        registry.verify()


def test_freeze_and_phases(tmp_path):
    digest = "a" * 64
    g.freeze(tmp_path / "f.json", "2024-01-01T00:00:00Z", digest, digest, digest, True)
    assert g.authorize_holdout(tmp_path / "f.json", digest, digest, digest)["portfolio_candidate"]
    with pytest.raises(PermissionError):
        g.authorize_holdout(tmp_path / "f.json", "b" * 64, digest, digest)
    ran = []
    phases = {k: (lambda k=k: ran.append(k) or ("COMPLETE" if k < 3 else "INFEASIBLE_DATA")) for k in (1, 2, 3, 4)}
    assert g.run_phases(phases, {1: {"state": "COMPLETE", "key": "k"}}, "k", 4) == ({1: "COMPLETE", 2: "COMPLETE", 3: "INFEASIBLE_DATA"}, 3) and ran == [2, 3]
