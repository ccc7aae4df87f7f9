import math
import re
from collections import Counter

from proofbox.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES, scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows):
    out = []
    for d, t in rows:
        w = ws(t)
        places = [(p, x) for phrase, x in PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        more = []
        for line in (t or "").split("\n"):
            have = set(ws(line))
            for text, x in TEMPLATES:
                need = set(text.split())
                if len(need & have) >= math.ceil(CONTAINMENT * len(need) - 1e-9):
                    more.append((len(need & have) / len(need), x))
        labels = lambda xs: ",".join(sorted(set(xs)))
        pos = [p for p, _ in places]
        out.append((d, len(w), len(pos), min(pos, default=None), max(pos, default=None), labels(x for _, x in places), labels([x for _, x in places] + [x for _, x in more]), 1.0 if places else max((s for s, _ in more), default=0.0)))
    return Counter(out)


def test_matches_brute_force(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
    rows = [
        (1, "Released under the MIT License. MIT-license mit, LICENSE"), (2, "Licensed under CC BY-NC 4.0.\ncc\nby"), (3, None), (4, ""), (5, "the MIT licenses and cc bye"),
        (6, f"intro\n{gpl}\nthe end"), (7, gpl.replace("free ", "")), (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (8, "released\nunder the MIT\nlicense"), (8, "x"), (None, "Apache License"), (9, ("word " * 20_000) + "gnu general public license"),
        (10, "Redistribution and use in source and binary forms with or without modification are allowed"), (1, "Released under the MIT License. MIT-license mit, LICENSE"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as label", "1 as h", "3 as pos").repartition(3)
    assert Counter(tuple(r) for r in scan(df).collect()) == brute(rows)


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
