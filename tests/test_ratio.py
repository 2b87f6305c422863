"""Scores with difflib's ratio, against plain Python over every row of the table."""

import json
from difflib import SequenceMatcher

import pytest

from vergraph.plans import catalog
from vergraph.sources import star

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def devices(spark):
    return [r.asDict() for r in star.entities(spark, SMALL).where("entity_type = 'device'").collect()]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def scorer_a(row, query):
    q, parts, name = query.lower(), query.lower().split(), row["name"].lower()
    text = json.dumps(json.loads(row["content"])).lower() if row["content"] else ""
    score = 3.0 if q in name else 1.5 * sum(w in name for w in parts)
    if text not in ("", "{}"):
        score += 2.0 if q in text else 0.5 * sum(w in text for w in parts)
        score += sum(isinstance(v, str) and q in v.lower() for v in json.loads(row["content"]).values())
    if name == q:
        score *= 2
    near = ratio(name, q)
    return score + (near if near > 0.8 else 0)


def best(scores, limit):
    return sorted(((i, round(s, 9)) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:limit]


def result(spark, name):
    return [(r["id"], r[1]) for r in catalog.queries()[name](spark, SMALL).collect()]


def test_ratio(spark, devices):
    assert dict(result(spark, "str3_ratio")) == {r["id"]: round(ratio(r["name"].lower(), "small ring"), 9) for r in devices}


def test_shared_ranked(spark, devices):
    want = best({r["id"]: scorer_a(r, "smal ring") for r in devices}, 10)
    assert result(spark, "sch2_shared_ranked") == want


def test_names_ranked(spark):
    rows = [r.asDict() for r in star.versions(spark, SMALL).where("name ilike '%user 1%'").collect()]
    newest = sorted(sorted(rows, key=lambda r: (r["id"], r["version"])), key=lambda r: r["created_at"], reverse=True)[:15]
    first = list({r["id"]: r for r in reversed(newest)}.values())
    first = sorted(sorted(first, key=lambda r: r["id"]), key=lambda r: r["created_at"], reverse=True)[:5]
    assert result(spark, "sch9_names_ranked") == best({r["id"]: scorer_a(r, "user 1") for r in first}, 5)


def test_similar(spark, devices):
    from vergraph.operators import similarity

    ref = next(r for r in devices if r["id"] == "part-0")
    a = json.loads(ref["content"])
    scores = {}
    for r in devices:
        b = json.loads(r["content"])
        common, union = set(a) & set(b), set(a) | set(b)
        content = 0.3 * len(common) / max(len(union), 1) + (0.2 * sum(a[k] == b[k] for k in common) / len(common) if common else 0)
        scores[r["id"]] = 0.2 + 0.3 * ratio(ref["name"].lower(), r["name"].lower()) + content
    want = best({i: s for i, s in scores.items() if i != "part-0" and s > 0.1}, len(scores))
    rows = star.entities(spark, SMALL).where("entity_type = 'device'")
    got = [(r["id"], round(r["score"], 9)) for r in similarity.similar_shared(rows, "part-0", 10**6).collect()]
    assert got == want
    assert result(spark, "sim1_shared") == want[: len(result(spark, "sim1_shared"))]
    named = sorted((r for r in devices if r["id"] != "part-0"), key=lambda r: r["id"])[:40]
    got = [(r["id"], round(r["score"], 9)) for r in similarity.similar_by_name_score(rows, "part-0", ref["name"], 40).collect()]
    assert got == best({r["id"]: scorer_a(r, ref["name"]) for r in named}, 40)
