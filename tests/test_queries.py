"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest

from motion_tables.plans import queries

from .oracle import same

FOLDER = "/root/testdata/sf0.001"
CASES = [(n, p) for p in queries.PARTS for n in p.QUERIES]


@pytest.mark.parametrize("name,part", CASES, ids=[n for n, _ in CASES])
def test_query(spark, name, part):
    if name in part.ORACLE_SQL:
        same(spark, FOLDER, part.QUERIES[name], part.ORACLE_SQL[name])
    else:
        assert part.QUERIES[name](spark, FOLDER).count() > 0
