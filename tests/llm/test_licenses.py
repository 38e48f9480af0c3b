import random
import re

from tessera.llm import licenses as lc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_base_against_brute_force(spark):
    rnd = random.Random(2)
    bits = ["CC BY", "cc-by", "cc", "by", "General Public License", "general public", "License", "All rights reserved", "rights", "É漢", "x9", "...", "\n", "𝒳 word"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "cc by cc by"), (302, "cc by cc by"), (303, "a " * 90_000 + "cc by"), (304, "?!")]
    docs = spark.createDataFrame([(*r, "q") for r in rows] + [(None, "All Rights Reserved.", "q")], "doc_id long, text string, label string")
    got = {}
    for r in lc.scanned(docs).collect():
        got[r.doc_id] = r
    assert got[None].base_labels == "reserved" and got[None].score == 1.0
    for i, t in rows:
        w = words(t)
        places = sorted((k, p) for p in lc.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {lc.PHRASES[p] for _, p in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(",")))
    assert lc.scanned(docs).count() == len(rows) + 1 and lc.scanned(docs.limit(0)).count() == 0


def test_templates_with_edits(spark):
    rows = []
    for n, (label, t) in enumerate(lc.TEMPLATES):
        w = t.split()
        rows.append((n, "some prose before. " * 3 + t.title() + ", and more after " * 3, label))
        if len(w) > 12:
            changed = [*w[:6], "really", *w[6:]]
            rows.append((100 + n, "x y z " + " ".join(changed), label))
    rows += [(500, "the license of the house was old and the public stood in the general rain", ""), (501, "licensed under the moon", "")]
    got = {r.doc_id: r for r in lc.scanned(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()}
    for i, _, label in rows:
        assert label in got[i].labels.split(",") and (got[i].score >= lc.COVERAGE or not label), (i, got[i])
    assert got[500].labels == got[501].labels == ""


def test_words_that_change_a_license(spark):
    cc = "see this. This work is licensed under a Creative Commons Attribution{} 4.0 International License. More text"
    rows = [(cc.format(""), "cc-by"), (cc.format("-NonCommercial-ShareAlike"), "cc-by-nc-sa"), (cc.format("-NoDerivatives"), "cc-by-nd"), (cc.format(" Non Commercial No Derivatives"), "cc-by-nc-nd")]
    rows += [(cc.format(" that in no way is for any commercial"), ""), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(None, rows[1][0])], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in lc.scanned(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows] and got[None] == "cc-by-nc-sa"


def test_grants_and_refusals(spark):
    rows = [
        ("Permission is hereby granted, but it is NOT free of charge to any person obtaining a copy of this software and associated documentation files", ""),
        ("This work is not licensed under a Creative Commons Attribution 4.0 International License.", ""),
        ("It was never released under the MIT License, they say.", ""),
        ("Licensed under the GNU Lesser General Public License version 3", "gpl,lgpl"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: Something-Else-1", ""),
        ("You may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
        ("You may use this file except in compliance with the License. You may obtain a copy of the License at", ""),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at https://", "mpl"), ("If a copy of the MPL was distributed with this file, You can obtain one at https://", ""),
        ("This work is not so bad. This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("The above copyright notice and this permission notice shall be included in all copies or portions of the Software", "mit"),
    ]
    got = {r.doc_id: r.labels for r in lc.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows]


def plain_edits(span, wanted):
    cost = lambda w: 1000 + (w in lc.REFUSALS)
    row = [0]
    for t in wanted:
        row.append(row[-1] + cost(t))
    for w in span:
        made = [row[0] + cost(w)]
        for j, t in enumerate(wanted):
            made.append(min(row[j] + (0 if w == t else 1000 + (w in lc.REFUSALS or t in lc.REFUSALS)), row[j + 1] + cost(w), made[-1] + cost(t)))
        row = made
    return row[-1]


def plain_labels(text):
    """Voting and verification, text by text."""
    w, found, k = words(text), set(), lc.K
    for label, template in lc.TEMPLATES:
        t = template.split()
        lines = {}
        for p in range(len(w) - k + 1):
            for a in range(len(t) - k + 1):
                if w[p : p + k] == t[a : a + k]:
                    lines.setdefault(p - a, []).append((p, a))
        bands, last = [], None
        for d in sorted(lines):
            if last is None or d - last > lc.DRIFT:
                bands.append([])
            bands[-1] += lines[d]
            last = d
        family = lc.family_of(label)
        for band in bands:
            ats = {a for _, a in band}
            if len(ats) / (len(t) - k + 1) < lc.COVERAGE:
                continue
            low, high = min(p for p, _ in band) - min(ats), max(p for p, _ in band) + k + len(t) - k - max(ats)
            a, z = low - 2 * lc.DRIFT * (min(ats) > 0), high + 2 * lc.DRIFT * (max(ats) < len(t) - k)
            means = {lc.MEANS[x] for x in w[max(a, 0) : z] if lc.MEANS.get(x, "").startswith(f"{family}:")}
            if family and ",".join(sorted(means)) != lc.changes_of(label, t):
                continue
            e = plain_edits(w[max(low, 0) : high], t)
            if e % 1000 == 0 and e // 1000 <= lc.EDITS * len(t) and not set(w[max(low - lc.BEFORE, 0) : max(low, 0)]) & set(lc.REFUSALS):
                found.add(label)
    return found | {lc.PHRASES[p] for p in lc.PHRASES if f" {p} " in f" {' '.join(w)} "}


def test_voting_and_alignment_against_brute_force(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(220):
        out = []
        for _ in range(rnd.randint(1, 3)):
            t = rnd.choice(lc.TEMPLATES)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                at = rnd.randrange(len(t))
                t = rnd.choice([t[:at] + t[at + 1 :], t[:at] + [rnd.choice(["really", "not", "nc", "lesser", "of", "without"])] + t[at:], t[:at] + [rnd.choice(["it", "no", "commercial"])] + t[at + 1 :]]) or ["x"]
            out += [*[rnd.choice("some prose not before the work is".split()) for _ in range(rnd.randint(0, 9))], *t]
        rows.append((i, " ".join(out)))
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in lc.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == plain_labels(t), t
    assert len(set(map(frozenset, got.values()))) > 20
