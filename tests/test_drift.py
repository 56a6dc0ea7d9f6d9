"""Drift of random documents against a plain walk over both."""

import json
import random

from spanloom.operators.drift import drift


def document(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {rng.choice("abcd"): document(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 4 and kind < 0.55:
        return [document(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 1, 1.0, 2.5, "1", "x", "", 10**18, 10**18 + 1])


def change(rng, value):
    if rng.random() < 0.15:
        return document(rng, 3)
    if isinstance(value, dict):
        out = {k: change(rng, v) for k, v in value.items() if rng.random() > 0.1}
        return out | ({"new": 1} if rng.random() < 0.2 else {})
    if isinstance(value, list):
        return [change(rng, v) for v in value][: rng.choice([9, 9, 9, 1])]
    return float(value) if value == 1 and value is not True and rng.random() < 0.5 else value


def walk(path, local, remote, found):
    kinds = [("object" if isinstance(v, dict) else "list" if isinstance(v, list) else "value") for v in (local, remote)]
    if kinds[0] != kinds[1]:
        found.append((path, "value_mismatch"))
        if kinds == ["list", "object"]:
            found += [(f"{path}[{i}]", "missing_in_remote") for i in range(len(local))]
    elif kinds[0] == "object":
        for k, v in local.items():
            below = f"{path}.{k}" if path else k
            if k in remote:
                walk(below, v, remote[k], found)
            else:
                found.append((below, "missing_in_remote"))
    elif kinds[0] == "list":
        if len(local) != len(remote):
            found.append((path, "list_length_mismatch"))
        for i, (v, w) in enumerate(zip(local, remote)):
            walk(f"{path}[{i}]", v, w, found)
    else:
        number = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (local, remote))
        if not (local == remote and (number or (type(local) is type(remote)))):
            found.append((path, "value_mismatch"))


def test_random_documents(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(150):
        one = document(rng) if k % 5 else {"a": {"b": {"c": {"d": {"e": [1, {"f": rng.randint(0, 2)}]}}}}}
        pairs.append((f"d{k}", one, change(rng, one) if k % 4 else one))
    local = spark.createDataFrame([(k, json.dumps(a)) for k, a, _ in pairs], "asset string, body string")
    remote = spark.createDataFrame([(k, json.dumps(b)) for k, _, b in pairs] + [("other", "{}")], "asset string, body string")
    want = []
    for k, a, b in pairs:
        found = []
        walk("", a, b, found)
        want += [(k, *f) for f in found]
    assert sorted((r.asset, r.path, r.type) for r in drift(local, remote).collect()) == sorted(want) and len(want) > 50
    assert drift(local, remote.limit(0)).count() == 0 and drift(local.limit(0), remote).count() == 0


def test_unreadable_documents(spark):
    rows = [("bad", "{", '{"a": 1}'), ("both", "{", "}"), ("null", None, "1"), ("same", "{", "{")]
    local = spark.createDataFrame([r[:2] for r in rows], "asset string, body string")
    remote = spark.createDataFrame([(r[0], r[2]) for r in rows], "asset string, body string")
    assert sorted((r.asset, r.path, r.type) for r in drift(local, remote).collect()) == [("bad", "", "value_mismatch")]
