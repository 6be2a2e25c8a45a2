import pytest

from linkweave.sources import discover


def test_sizes():
    assert [discover.parse_size(x) for x in ("40k", "1.5m", "7", 12)] == [40_000, 1_500_000, 7, 12]
    assert [discover.size_label(n) for n in (40_000, 1_500_000, 7)] == ["40k", "1.5m", "7"]
    with pytest.raises(ValueError):
        discover.parse_size("many")


def test_find_takes_the_nearest(tmp_path):
    for p in ("a/b/x.tsv", "a/x.tsv", "__MACOSX/x.tsv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    assert discover.find("x.tsv", [str(tmp_path / "none"), str(tmp_path)]) == str(tmp_path / "a/x.tsv")
    with pytest.raises(FileNotFoundError):
        discover.find("y", [str(tmp_path)])
