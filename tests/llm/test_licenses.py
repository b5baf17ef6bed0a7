"""License scan against windows and sets of words in plain Python."""

import random
import re

import pytest

from codeprism.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rid long, words string, label string"


def plain(rows, templates=li.TEMPLATES, phrases=li.PHRASES, percent=li.CONTAINMENT):
    out = []
    split = lambda t: WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    for i, text in rows:
        w = split(text)
        at, base, found, share = [], set(), set(), 0.0
        for phrase, label in phrases:
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += here
            base |= {label} if here else set()
        for label, t in templates:
            t = split(t)
            g, own = next(g for g in (16, 128, 1024, 8192) if g >= 1.25 * len(t)), set(t)
            best = max(len(own & set(w[k * g : k * g + 2 * g])) for k in range(max(1, -(-len(w) // g) - 1)))
            if 100 * best >= percent * len(own):
                found.add(label)
                share = max(share, best / len(own))
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else share))
    return sorted(out, key=repr)


def found(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "w", "l") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in li.scan(df, **k).collect()), key=repr)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in li.scan(df).collect()), key=repr) == plain([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_planted_templates(spark, percent):
    random.seed(percent)
    filler = lambda n: " ".join(random.choice(["the", "of", "license", "software", "x1", "ñandú", "to", "copy"]) for _ in range(n))
    rows = []
    for k, (_, text) in enumerate(li.TEMPLATES * 4):
        w = text.split()
        for _ in range(random.randint(0, len(w) // 4)):
            w[random.randrange(len(w))] = random.choice(["other", "Änderung", ""])
        rows.append((k, f"{filler(random.randint(0, 700))} {' '.join(w)} {filler(random.randint(0, 90))}"))
    rows += [(900, None), (901, ""), (902, " .,"), (903, "CC by-cc BY, cc by"), (904, "general public License " * 3000), (None, "Released under the MIT License."), (905, li.TEMPLATES[4][1] + "\n" + li.TEMPLATES[0][1])] + [(906, "all rights reserved")] * 2
    assert found(spark, rows, percent=percent) == plain(rows, percent=percent)


def test_known_notices(spark):
    texts = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Released under the MIT License.": "mit", "All rights reserved.": "reserved", "Mit der Lizenz under the License": ""}
    got = {r[0]: (r[6], r[7]) for r in found(spark, list(enumerate(f"some words\n{t}\nmore" for t in texts)))}
    assert [got[i][0] for i in range(len(texts))] == list(texts.values()) and [got[i][1] for i in range(len(texts))] == [1.0] * 5 + [0.0]


def test_edges(spark):
    rows = [(1, "all rights reserved"), (2, "Released under the MIT License")]
    assert found(spark, []) == []
    assert found(spark, rows, templates=(), phrases=li.PHRASES) == plain(rows, templates=())
    with pytest.raises(ValueError, match="longer"):
        li.prepared([("x", "word " * 7000)])
