from pathlib import Path

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
SLOW = {"append_reviews", "stream_import_reviews", "stream_score_reviews", "read_reviews_json_array"}
NAMES = sorted(set(entry.oracle_sql()) - SLOW)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert check.compare(spark, FOLDER, name).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
