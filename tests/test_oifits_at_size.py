"""OIFITS files are read in pieces and written as a stream, whatever their size."""

import numpy as np

from fringelake.sources import oifits
from fringelake.sources import oifits_source as source


def test_a_file_is_read_in_pieces_that_hold_every_row_once(spark, tmp_path):
    n = 120_000
    vis2 = {"mjd": np.arange(n) * 1e-3, "u": np.ones(n), "v": np.ones(n), "sta": np.ones((n, 2)), "value": np.arange(2.0 * n).reshape(n, 2), "error": np.ones((n, 2))}
    (tmp_path / "a.fits").write_bytes(oifits.build(np.array([1e-6, 2e-6]), np.array([1e-8, 1e-8]), vis2))
    pieces = source.OifitsReader(str(tmp_path)).partitions()
    assert len(pieces) == 5 and all(sum(b - a for _, a, b in p.spans) * 2 <= source.VALUES for p in pieces)
    source.register(spark)
    rows = spark.read.format("oifits").load(str(tmp_path)).selectExpr("count(*) n", "sum(value) s", "count(distinct row, channel) d", "sum(abs(value - 2 * row - channel)) off").first()
    assert (rows.n, rows.s, rows.d, rows.off) == (2 * n, n * (2 * n - 1.0), 2 * n, 0)


def test_rows_of_one_number_and_rows_without_a_channel_are_written(spark, tmp_path):
    def row(number, channel, mjd, value, kind="amp", flag=False):
        return ("a", kind, "INS", number, channel, 1e-6 + channel * 1e-7, 1e-8, mjd, 0.0, 1.0, 1, 2, -1, 1.0, 2.0, None, None, value, 0.1, flag, "T")

    rows = [row(1, 0, 5.0, 0.1), row(1, 1, 5.0, 0.2), row(1, 0, 6.0, 0.3), row(1, 1, 6.0, 0.4), row(2, 1, 7.0, 0.5), row(2, 1, 7.0, 0.6), row(1, 0, 5.0, 0.7, "phi", True), row(1, 1, 5.0, 0.8, "phi")]
    done = source.write(spark.createDataFrame(rows, source.ROW), str(tmp_path / "out")).collect()
    assert [(r.file, r.rows) for r in done] == [("a.fits", 8)]
    source.register(spark)
    back = spark.read.format("oifits").load(str(tmp_path / "out")).where("value is not null").collect()
    want = sorted((r[1], r[4], r[7], round(r[17], 9), r[19]) for r in rows)
    assert sorted((r.kind, r.channel, r.mjd, round(r.value, 9), r.flag) for r in back) == want
