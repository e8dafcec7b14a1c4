from __future__ import annotations

import re

from evidentia.llm import licenses


def grams(line):
    w = re.sub("[^a-z0-9\n]+", " ", "".join(c.lower() if c.isascii() else c for c in line)).split()
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def brute(text):
    lines = (text or "").split("\n")
    units = [grams(u) for u in lines + ([" ".join(lines)] if len(lines) > 1 else [])]
    best = []
    for u in filter(None, units):
        dice = [(-2 * len(u & t) / (len(u) + len(t)), n) for n, t in ((n, grams(x)) for n, x in licenses.TEMPLATES) if 0.8 / 1.2 * len(t) <= len(u) <= 1.2 / 0.8 * len(t)]
        best += [min(dice)] if dice else []
    hits = [b for b in best if b[0] <= -licenses.THRESHOLD]
    return sorted({n for _, n in hits}), min(hits)[1] if hits else None, len(hits)


def test_against_every_template(spark, small, odd, none):
    made = [(i, x) for i, x in enumerate([n for _, n in licenses.TEMPLATES] + ["Text.\nreleased  UNDER the mit   license\nmore", "Released under the MIT Licence terms", "MIT", None, "", "Licensed under CC BY 4.0 or CC BY-NC 4.0", "x " * 50_000])]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string").selectExpr("doc_id + 1000000", "text"))
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = licenses.license_scan(docs).collect()
    assert {r.doc_id: (r.licenses, r.best_license, r.n_units) for r in got} == want
    assert sum(bool(r.licenses) for r in got) > 20
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(none).count() == 0


def windows(text):
    """Licences of all windows of each template's size, compared one by one."""
    w = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in text or "")).split()
    found = []
    for name, notice in licenses.TEMPLATES:
        t, n = grams(notice.replace("\n", " ")), len(re.sub("[^a-z0-9]+", " ", notice.lower()).split())
        for i in range(len(w) - n + 1):
            u = set(zip(w[i : i + n], w[i + 1 : i + n], strict=False))
            dice = 2 * len(u & t) / (len(u) + len(t))
            found += [(-dice, name, i, i + n)] if dice >= licenses.THRESHOLD else []
    hits = [m for m in found if not any(v[:2] < m[:2] and v[2] < m[3] and m[2] < v[3] for v in found)]
    return sorted({m[1] for m in hits}), min(found)[1] if found else None


def test_passages_against_every_window(spark, small, odd, none):
    mit = "Copyright 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction"
    bsd = "All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met: 1."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
    said = "The data set was collected in 2019. Released under the MIT License."
    two = "a b Licensed under CC BY 4.0. c d e f g h\nThis work is licensed under the GNU General Public License,\nversion 2. x y"
    made = [(i, x) for i, x in enumerate([mit, bsd, isc, said, two, None, "", "MIT", "Released under the MIT", *[n for _, n in licenses.TEMPLATES]])]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string").selectExpr("doc_id + 1000000", "text"))
    got = {r.doc_id: (r.licenses, r.best_license) for r in licenses.license_passages(docs).collect()}
    assert got == {r.doc_id: windows(r.text) for r in docs.collect()}
    assert [got[1000000 + i][0] for i in range(5)] == [["MIT"], ["BSD-3-Clause"], ["ISC"], ["MIT"], ["CC-BY-4.0", "GPL-2.0"]]
    assert licenses.license_passages(odd).count() == odd.count() and licenses.license_passages(none).count() == 0
