"""Missing partners of the match table."""

import pytest

from trustframe.operators.deltas import match_check, match_counts

GROUPS = ["corr", "sev"]


def _frames(spark, drop=lambda s, i, c, v: False, extra=()):
    clean = [(s, i, i % 3) for s in "ab" for i in range(3)]
    corrupt = [(s, i, c, v, y) for s, i, y in clean for c in ("blur", "fog") for v in (1, 2) if not drop(s, i, c, v)]
    return spark.createDataFrame([*corrupt, *extra], "scope string, i int, corr string, sev int, lab int"), spark.createDataFrame(clean, "scope string, i int, lab int")


def _rows(df):
    return {(r["scope"], r["corr"], r["sev"]): (r["selected_count"], r["unmatched_count"], r["missing_count"]) for r in df.collect()}


def test_complete(spark):
    corrupt, clean = _frames(spark)
    got = match_check(corrupt, clean, "scope", "i", "lab", GROUPS, strict=True).collect()
    assert len(got) == 8 and all(r["selected_count"] == 3 and r["labels_match"] for r in got)


@pytest.mark.parametrize("case, key, want", [
    (dict(drop=lambda s, i, c, v: (s, i, c, v) == ("a", 1, "fog", 2)), ("a", "fog", 2), (2, 0, 1)),
    (dict(drop=lambda s, i, c, v: (s, c, v) == ("b", "fog", 1)), ("b", "fog", 1), (0, 0, 3)),
    (dict(extra=[("a", 9, "fog", 2, 0)]), ("a", "fog", 2), (3, 1, 0)),
    (dict(extra=[("z", 0, "fog", 2, 0)]), ("z", "fog", 2), (0, 1, 0)),
    (dict(extra=[("a", None, "fog", 2, 0)]), ("a", "fog", 2), (3, 1, 0)),
])
def test_missing_partner(spark, case, key, want):
    corrupt, clean = _frames(spark, **case)
    got = _rows(match_counts(corrupt, clean, "scope", "i", "lab", GROUPS))
    assert got.pop(key) == want and set(got.values()) == {(3, 0, 0)}
    with pytest.raises(Exception, match="too few corrupt rows|without a clean partner"):
        match_check(corrupt, clean, "scope", "i", "lab", GROUPS).collect()
