"""Combined pileups: strands, tolerances and probe maps."""

import pytest

from genostrata.sources import tables


def row(pos, strand, valid=10, modified=4, percent=None, code="C", other=0, chrom="chr1"):
    percent = f"{100 * modified / valid:.2f}" if percent is None else percent
    return "\t".join(map(str, [chrom, pos, pos + 1, code, valid, strand, pos, pos + 1, "0,0,0", valid, percent, modified, valid - modified - other, other, 0, 0, 0, 0]))


def text(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_strands_are_pooled(spark):
    sites = tables.combined_bedmethyl(text(spark, ["# head", row(5, "+"), row(5, "-", 30, 1), row(9, "."), row(11, "+", 3, 1), row(12, "-", 8, 0)]))
    probes = tables.probe_positions(text(spark, ["chr1\t5\t6\ta", "chr1\t9\t10\ta", "chr1\t9\t10\tb", "chr1\t11\t12\tc", "chr1\t12\t13\td", "chr1\t99\t100\te"]))
    got = {r["probe"]: (r["modified"], r["valid"], r["fraction"]) for r in tables.combined_probe_fractions(sites, probes).collect()}
    assert got == {"a": (9, 50, 0.18), "b": (4, 10, 0.4), "c": (1, 3, 1 / 3), "d": (0, 8, 0.0)}
    with pytest.raises(Exception, match="outside the probe map"):
        tables.combined_probe_fractions(sites, probes.where("probe <> 'd'")).collect()


@pytest.mark.parametrize(("rows", "says"), [
    ([row(5, "+"), row(5, "+")], "overlap"), ([row(5, "+"), row(5, ".")], "overlap"), ([row(5, "."), row(5, ".")], "overlap"), ([row(5, "*")], "strand"), ([row(5, "+", percent="40.02")], "percentage"), ([row(5, "+", percent="140")], "percentage"), ([row(5, "+", percent="x")], "percentage"),
    ([row(5, "+", code="m")], "code C"), ([row(5, "+", other=1)], "add up"), ([row(-5, "+")], "invalid position"), ([row(5, "+") + "\t1"], "18 columns"), ([row(5, "+").replace("\t6\tC", "\t7\tC")], "invalid position"),
])
def test_what_contradicts_itself_fails(spark, rows, says):
    with pytest.raises(Exception, match=says):
        tables.combined_bedmethyl(text(spark, rows)).collect()


def test_a_percentage_within_tolerance_passes(spark):
    assert tables.combined_bedmethyl(text(spark, [row(5, "+", percent="40.01"), row(6, "-", 3, 1, percent="33.34"), row(7, ".", 10, 0, percent="0")])).count() == 3


@pytest.mark.parametrize(("rows", "says"), [(["chr1\t5\t6\ta", "chr1\t5\t6\ta"], "twice"), (["chr1\t5\t7\ta"], "single base"), (["chr1\t5\t6\ta", "chr2\t5\t6\ta"], "two contigs"), (["chr1\t5\t6"], "single base")])
def test_probe_maps_that_do_not_hold(spark, rows, says):
    with pytest.raises(Exception, match=says):
        tables.probe_positions(text(spark, rows)).collect()
