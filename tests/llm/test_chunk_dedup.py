"""Exact duplicates against a plain grouping of normalised texts."""

import hashlib
import re

import pytest

from scorekit.llm.chunk_dedup import exact_duplicates

LONG = "alpha beta gamma " * 2000
ROWS = [
    (4, "a  b\tc"), (2, "a b c"), (9, "a b c "), (3, None), (7, ""), (8, " "), (5, LONG), (1, LONG + "x"), (6, LONG.replace(" ", "\n\n")),
    (11, LONG[:9000] + "y" + LONG[9000:]), (12, LONG[:9000] + "z" + LONG[9000:]), (2, "a b c"), (None, "a b c"), (None, "only"), (13, " a"), (14, "\U0001f600" * 5000),
]


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out, seen = [], set()
    for d, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep = min((x for x in groups[norm] if x is not None), default=None)
        kept = d == keep and (norm, d) not in seen
        seen.add((norm, d))
        out.append((d, keep, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_groups(spark, bits):
    """With fingerprints of two bits nearly all chunks collide, and only their content tells them apart."""
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id bigint, text string, recipe string, keep_id int")
    assert sorted(map(tuple, exact_duplicates(df, bits=bits).collect()), key=str) == expected(ROWS)


def test_no_rows(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_group_of_thousands(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('text ', id) END AS text")
    out = exact_duplicates(df)
    assert out.where("group_size = 1000 AND keep_id = 0").count() == 1000 and out.where("kept").count() == 2001
