"""Queries over all rows against plain Python versions, on small tables and on sf0.001."""

import math
import re
from urllib.parse import unquote_plus

import oracle
from skylark import queries as own

SF = "/root/testdata/sf0.001"


def stored(spark, folder, **tables):
    """A folder of tables: name=(rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(spark, name, folder):
    return [tuple(r) for r in own.queries()[name](spark, folder).collect()]


def label(v):
    for size, unit in ((1e9, "B"), (1e6, "M")):
        if v >= size:
            return f"R{v / size:.1f}{unit}"
    return f"R{math.floor(v / 1e3)}K" if v >= 1e3 else f"R{math.floor(v)}"


def test_money_labels_of_all_amounts(spark, tmp_path):
    prices = {0: 99999.0, 1: 999999.99, 2: 1250.0, 5: 1450.0, 8: 1350.0, 11: 999999.99, 14: 1000000.0, 17: 2345678.9, 20: 12.0}
    folder = stored(spark, tmp_path, orders=(list(prices.items()), "o_orderkey long, o_totalprice double"))
    assert dict(rows(spark, "t45_money_labels_all", folder)) == {k: label(p * (0.01, 1.0, 1000.0)[k % 3]) for k, p in prices.items()}
    given = oracle.connect(SF).execute("SELECT o_orderkey, o_totalprice FROM orders").fetchall()
    got = dict(rows(spark, "t45_money_labels_all", SF))
    assert got == {k: label(float(p) * (0.01, 1.0, 1000.0)[k % 3]) for k, p in given}
    assert any(x.endswith("M") for x in got.values())


def refined(html):
    plain = re.sub("<[^>]{0,500}>", " ", html)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = plain.replace(entity, char)
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", unquote_plus(plain)).strip(" ")


def test_all_pages_are_refined(spark, tmp_path):
    pages = list(enumerate(["<p>a%20b+c</p>", "50% off, caf%C3%A9+bar", "100%25 %zz %", "plain", "%E9 bad bytes", "1+1 &amp; 2%2B2"]))
    assert dict(rows(spark, "t01_refine_all", stored(spark, tmp_path, pages=(pages, "page_id long, html string")))) == {k: refined(h) for k, h in pages}
    given = oracle.connect(SF).execute("SELECT page_id, html FROM pages").fetchall()
    assert dict(rows(spark, "t01_refine_all", SF)) == {k: refined(h) for k, h in given}


def snippet(text):
    found = re.search("the", text, re.IGNORECASE)
    if not found:
        return None
    at = found.start()
    return (re.split(r"[.\n]", text[:at])[-1] + re.split(r"[.\n]", text[at:])[0]).strip(" ")[:250]


def test_snippets_of_all_documents(spark, tmp_path):
    docs = list(enumerate(["\u0130\u0130\u0130. Of \u0130 THE end. x", "The", "a\U0001f600b. then", "none", "ends in the"]))
    assert dict(rows(spark, "t32_snippets_all", stored(spark, tmp_path, documents=(docs, "doc_id long, text string")))) == {k: s for k, t in docs if (s := snippet(t))}
    given = oracle.connect(SF).execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
    assert dict(rows(spark, "t32_snippets_all", SF)) == {k: s for k, t in given if (s := snippet(t)) is not None}
