import os

import pytest

from linkweave import cli

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_once(spark, tmp_path):
    out = str(tmp_path / "o")
    assert cli.run(spark, "agg_count", SF, out) and not cli.run(spark, "agg_count", SF, out)
    assert cli.run(spark, "agg_count", SF, out, as_tsv=True)
    assert spark.read.parquet(str(tmp_path / "o2" / "rows")).count() == 2 if cli.run(spark, "agg_count", SF, str(tmp_path / "o2")) else False


def test_check_exit_codes(spark, tmp_path):
    w = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    records, pool = w("s1.tsv", "entity_id\tx\nS1-1\ta\nS1-2\tb\n"), w("s2.tsv", "entity_id\tx\nS2-1\ta\n")
    good = w("good.tsv", "source1_entity_id\tids\nS1-1\tS2-1\nS1-2\t\n")
    bad = w("bad.tsv", "source1_entity_id\tids\nS1-1\tS2-1,S2-1,S2-9\n")
    assert cli.check(spark, good, good, records, [pool]) == []
    found = dict(cli.check(spark, bad, good, records, [pool]))
    assert found["matches: repeated_id"] == 1 and found["matches: unknown_id"] == 1 and found["matches: missing"] == 1 and "warning: matches outside the candidates" in found
    args = ["check", "--candidates", good, "--records", records, "--pool", pool, "--matches"]
    assert cli.main([*args, good]) == 0 and cli.main([*args, bad]) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_and_compare(spark, tmp_path):
    out = str(tmp_path / "s")
    assert cli.stages(spark, ["agg_count", "met_macro"], SF, out) == [("agg_count", True), ("met_macro", True)]
    assert cli.stages(spark, ["agg_count"], SF, out) == [("agg_count", False)]
    assert cli.compare(spark, f"{out}/agg_count", f"{out}/agg_count") == (0, 0)
