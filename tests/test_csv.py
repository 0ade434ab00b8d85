"""S1 on hand-made files."""

import pytest

from tallyframe.sources.tables import read_text_csv


def test_quotes_line_feeds_and_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,a\n"S ""A"", B", 1\n"two\nlines",\n')
    got = [tuple(r) for r in read_text_csv(spark, str(tmp_path), ["a", "b"]).collect()]
    assert got == [(" 1", 'S "A", B'), (None, "two\nlines")]


@pytest.mark.parametrize("row", ["1\n", "1,2,3\n"])
def test_ragged_rows_fail(spark, tmp_path, row):
    (tmp_path / "a.csv").write_text("a,b\nx,y\n" + row)
    with pytest.raises(Exception, match="MALFORMED"):
        read_text_csv(spark, str(tmp_path), ["a", "b"]).collect()
