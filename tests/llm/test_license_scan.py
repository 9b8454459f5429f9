import math
import re

from qualitylens.llm import license_scan as S


def cut(text):
    out = []
    for line in (text or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        if w:
            last = max(0, math.ceil((len(w) - S.SPAN) / S.STEP))
            for k in range(last + 1):
                part = w[k * S.STEP : k * S.STEP + S.SPAN]
                out.append((S.STEP if k < last else len(part), set(S.terms(" ".join(part)))))
    return out


def brute(files):
    vocab = {t for _, n in S.TEMPLATES for t in S.terms(n)}
    texts = [cut(t) for _, _, t in files]
    segments = [x for segs in texts for x in segs]
    df = {v: sum(v in x for _, x in segments) for v in vocab}
    n = len(segments)
    idf = {v: math.log((n + 1) / (df[v] + 1)) + 1 for v in vocab}
    rarest = math.log(n + 1) + 1
    least = S.THRESHOLD**2 / (1 - S.THRESHOLD**2)
    wanted = [(lic, set(S.terms(notice))) for lic, notice in S.TEMPLATES]
    norms = [math.sqrt(sum(idf[t] ** 2 for t in tt)) for _, tt in wanted]

    def best(known, others):
        size = math.sqrt(sum(idf[t] ** 2 for t in known) + others * rarest**2)
        if not size:
            return None
        top = max((round(sum(idf[t] ** 2 for t in known & tt) / (size * norms[j]), 6), -j) for j, (_, tt) in enumerate(wanted))
        return (*top, wanted[-top[1]][0]) if top[0] >= S.THRESHOLD else None

    own, words = {}, {}
    for i, (_, path, _) in enumerate(files):
        segs = [(w, x & vocab, len(x - vocab)) for w, x in texts[i]]
        near = [bool(k) and len(k) >= least * o - 1e-9 for _, k, o in segs]
        units, single = [], 0
        for k, (w, known, others) in enumerate(segs):
            if near[k] and (b := best(known, others)):
                units.append((b[0], -2 * k, b[2], w))
                single += w
            if near[k] and (k == 0 or not near[k - 1]):
                e = k
                while e < len(segs) and near[e]:
                    e += 1
                if e - k > 1 and (b := best(set().union(*(x[1] for x in segs[k:e])), sum(x[2] for x in segs[k:e]))):
                    units.append((b[0], -2 * k - 1, b[2], sum(x[0] for x in segs[k:e])))
        if path is not None and re.search(S.LICENSE_FILE, path) and segs:
            if b := best(set().union(*(x[1] for x in segs)), sum(x[2] for x in segs)):
                units.append((b[0], 1, b[2], 0))
        if units:
            top = max(units)
            own[i], words[i] = (top[0], top[2]), max(single, top[3])
    given = {}
    for i, (_, p, t) in enumerate(files):
        if i in own and p is not None and (re.search(S.LICENSE_FILE, p) or words[i] >= S.FILE_SHARE * len(re.findall(r"[^\x20\x09-\x0D]+", t))):
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            given[d] = min(given.get(d, "~"), own[i][1])
    out = []
    for i, (name, p, _) in enumerate(files):
        if i in own:
            out.append((name, p, own[i][1], own[i][0], "own", None))
            continue
        steps = (p.rsplit("/", 1)[0] if "/" in p else "").split("/") if p is not None else []
        dirs = ["/".join(steps[:k]) for k in range(len(steps), -1, -1)] if p is not None else []
        d = next((d for d in dirs if d in given), None)
        out.append((name, p, given.get(d), None, "none" if d is None else "inherited", d))
    return sorted(out, key=str)


PROSE = "the work of this day is under the sun and the license of poets\nmore words here"
FILES = [
    (1, "a/LICENSE", "Some Project\nReleased under the MIT License.\n" + PROSE),
    (2, "a/b/c.txt", PROSE),
    (3, "a/b/d/e.txt", "// Licensed under the Apache License, Version 2.0 (the License)\n" + PROSE),
    (4, "a/b/d/f.txt", None),
    (5, "a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (6, "a/x.txt", ""),
    (7, "z/x.txt", PROSE), (8, None, PROSE), (9, None, "Licensed under CC BY-NC 4.0."),
    (10, "q/n.txt", "Licensed under CC BY-NC 4.0."), (11, "q/m.txt", PROSE), (12, "top.txt", "é ß " * 2000), (None, "q/r/s.txt", PROSE), (7, "z/x.txt", PROSE),
    (13, "w/LICENSE.md", "no notice at all"), (14, "w/y.txt", "the License"),
    (15, "ab/x.txt", PROSE),
    # a header wrapped over lines, a licence on one line within prose, whole licences
    (16, "h/wrapped.c", "/* Licensed under the Apache\n * License, Version 2.0 (the License);\n * you may not use this file\n * except in compliance\n * with the License. */\nint x = 1;\n" + PROSE),
    (17, "h/long.txt", "words before it " * 30 + S.LICENSES[0][1] + " and words after it" * 30),
    (18, "m/LICENSE", "Copyright (c) 2020 Someone\n\n" + S.LICENSES[3][1].replace(". ", ".\n")), (19, "m/sub/a.txt", PROSE),
    (20, "g/COPYING.txt", S.LICENSES[6][1].replace(", ", ",\n")), (21, "g/b.txt", None),
    (22, "k/unnamed", S.LICENSES[1][1]), (23, "k/c.txt", PROSE),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*f, "x", 1) for f in FILES], "doc_id long, path string, text string, license string, h int")
    got = sorted((tuple(r) for r in S.scan(df).collect()), key=str)
    assert got == brute(FILES)
    assert {r[0]: r[2] for r in got if r[4] == "inherited"} == {2: "MIT", 4: "GPL-3.0", 6: "MIT", 11: "CC-BY-NC-4.0", None: "CC-BY-NC-4.0", 19: "BSD-3-Clause", 21: "GPL-2.0", 23: "ISC"}
    assert {r[0]: r[2] for r in got if r[0] in (16, 17, 18, 20, 22)} == {16: "Apache-2.0", 17: "MIT", 18: "BSD-3-Clause", 20: "GPL-2.0", 22: "ISC"}


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "concat_ws('/', source, lang, doc_id) as path", "text")
    got = sorted((tuple(r) for r in S.scan(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()])
