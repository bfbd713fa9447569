"""Tag velocity counts every word of every document."""

import re

import oracle
from skylark import queries as own
from test_whole import SF


def test_every_word_of_every_document_is_counted(spark):
    texts = oracle.connect(SF).execute("SELECT text FROM documents WHERE text IS NOT NULL").fetchall()
    tags = {w for (t,) in texts for w in set(re.findall("[a-z]{4,}", t.lower()))}
    got = {r.tag for r in own.queries()["g35_tag_velocity_all"](spark, SF).select("tag").distinct().collect()}
    first = {m.group().lower() for (t,) in texts if (m := re.search("[A-Za-z]{4,}", t))}
    assert got <= tags and len(got - first) > len(first)
