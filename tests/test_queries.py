"""Every registered query of the library against its SQL."""

import pytest

import oracle
from skylark import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = own.queries()[name](spark, SF)
    assert oracle.differences(df, db, own.oracle_sql()[name]) == ""
    # What compares nothing proves nothing.
    assert not df.isEmpty()


def test_simhash_of_words_by_md5(spark):
    import hashlib
    import re

    got = {r.doc_id: r.fp for r in own.queries()["t16_md5_simhash"](spark, SF).collect()}
    rows = oracle.connect(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    for doc, text in rows:
        words = set(re.findall("[a-z]{4,}", text.lower()))
        if not words:
            assert doc not in got
            continue
        bits = [format(int(hashlib.md5(w.encode()).hexdigest()[16:], 16), "064b") for w in words]
        assert got[doc] == "".join("1" if 2 * sum(b[k] == "1" for b in bits) > len(bits) else "0" for k in range(64))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
