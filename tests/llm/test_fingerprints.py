from __future__ import annotations

import hashlib
import re

import pytest
from evidentia.llm import fingerprints

UNIT = re.compile(rf"[^\n]{{{fingerprints.PARAGRAPH},}}?[.!?](?=\s)|[^\n]+")


def brute(rows):
    """doc -> (n, sha, near_edited, near_next) by sets of paragraphs."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, text) in enumerate(rows):
        own, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        sets = [{p.strip(" ") for p in UNIT.findall(x)} for x in (own, edited, after)]
        near = [2 * len(sets[0] & s) / (len(sets[0]) + len(s)) if sets[0] or s else 1.0 for s in sets[1:]]
        out[k] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


@pytest.mark.parametrize("rows_in_bucket", [3, 500])
def test_against_brute_force(spark, odd_unique, rows_in_bucket, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows_in_bucket)
    got = fingerprints.fingerprint_versions(spark, odd_unique).collect()
    want = brute([(r.doc_id, r.text) for r in odd_unique.collect()])
    assert len(got) == len(want)
    for r in got:
        n, sha, near, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near) and r.near_next == pytest.approx(after)


def test_retries_and_exact_count_agree(spark, odd_unique, monkeypatch):
    want = {r.doc_id: (r.near_edited, r.near_next) for r in fingerprints.fingerprint_versions(spark, odd_unique).collect()}
    monkeypatch.setattr(fingerprints, "ROUNDS", 1)
    assert want == {r.doc_id: (r.near_edited, r.near_next) for r in fingerprints.fingerprint_versions(spark, odd_unique).collect()}
    monkeypatch.setattr(fingerprints, "RETRY_ROUNDS", 1)
    assert want == {r.doc_id: (r.near_edited, r.near_next) for r in fingerprints.fingerprint_versions(spark, odd_unique).collect()}


def test_difference_recovers_the_digests(spark):
    a, b = list(range(1, 60)), list(range(40, 90))
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").selectExpr("transform(a, x -> xxhash64(x)) as a", "transform(b, x -> xxhash64(x)) as b")
    got = df.selectExpr(f"{fingerprints.difference('a', 'b', '64L')} as r", "array_union(array_except(a, b), array_except(b, a)) as want").first()
    assert not got.r.cells and sorted(set(got.r.found)) == sorted(got.want)


def test_odd_rows(spark, odd, none):
    got = fingerprints.fingerprint_versions(spark, odd).collect()
    assert len(got) == odd.count()
    assert len({r.fingerprint for r in got if r.doc_id == 9}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_versions(spark, none).count() == 0
    lone = fingerprints.fingerprint_versions(spark, odd.where("doc_id = 10")).first()
    assert lone.near_next == 1.0


def cells_of(fingerprint):
    n, cells = fingerprint.split(":")
    out = []
    for i in range(0, len(cells), 36):
        c = cells[i : i + 36]
        out.append([int(c[:4], 16), int(c[4:20], 16), int(c[20:], 16)])
    return int(n, 16), out


def test_likeness_follows_from_the_fingerprints(spark):
    """Cells that differ in one digest alone tell it; small edits are told by the returned fingerprints."""
    rows = [(i, "\n".join(f"line {j} of text {i // 2}" for j in range(1, 30)) + f"\nend {i}") for i in range(8)]
    got = sorted(fingerprints.fingerprint_versions(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: -r.doc_id)
    told = 0
    for r, after in zip(got, got[1:], strict=False):
        (n, a), (m, b) = cells_of(r.fingerprint), cells_of(after.fingerprint)
        assert n == r.n_paragraphs and len(a) == 3 * fingerprints.BASE
        assert sum(z[0] for z in a) == 3 * n
        if sum(x != y for x, y in zip(a, b, strict=True)) <= 6:
            told += 1
            assert r.near_next == pytest.approx(2 * 29 / (n + m))
    assert told == 4
