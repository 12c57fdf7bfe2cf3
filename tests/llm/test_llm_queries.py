"""Every query of the subpackage on the smallest tables; those with SQL against it."""

import pytest
from compare import DATA, differ

from orderloom.llm.queries import R


@pytest.mark.parametrize("name", list(R.queries))
def test_query(spark, name):
    if name in R.sql:
        got, want, why = differ(R.queries[name], R.sql[name], spark, DATA)
        assert not why and got == want, why
    else:
        assert R.queries[name](spark, DATA).count() > 0
