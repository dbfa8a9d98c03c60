"""The divergence audit against a plain count over all terms and groups."""

from __future__ import annotations

import collections
import random
import re

import pytest

from veladura.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})


def brute(docs, least, top):
    groups, of_lang, docs_of = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        words = TERM.findall((text or "").translate(FOLD))
        groups[lang or "", source or ""].update(words)
        of_lang[lang or ""].update(words)
        docs_of[lang or ""].update(set(words))
    out = []
    for lang in of_lang:
        kept = [t for t, n in docs_of[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(of_lang[lang]), {s: shares(c) for (k, s), c in groups.items() if k == lang}
        for s, own in p.items():
            pairs = sorted((-sum(abs(own[t] - other[t]) for t in kept), x.encode()) for x, other in p.items() if x != s)
            terms = sorted((q[t] - own[t], t.encode()) for t in kept if groups[lang, s][t] and own[t] > q[t])
            out += [(lang, s, part, x.decode(), -v, rank) for part, rows in (("pair", pairs), ("term", terms[:top])) for rank, (v, x) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, held", [(30, 50, 600_000), (4, 3, 20)])
def test_audit_against_brute_force(spark, monkeypatch, least, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SUMMED", held)
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzé"] + ["ÄRGER", "Zorn", "zorn", "日本", "x1y"]
    docs = []
    for _ in range(400):
        k = draw.randrange(4)
        docs.append((" ".join(draw.choices(words, k=draw.randrange(1, 30), weights=[(i + k) % 11 + 1 for i in range(len(words))])), draw.choice(["en", "de"]), f"s{k}"))
    docs += [("same words here", "en", "s9")] * 40 + [(None, "en", "silent"), ("", None, None), ("1 2 3", None, "s1"), ("lonely", "fr", "only"), ("a b", "it", "s1"), ("c d", "it", "s2")]
    frame = spark.createDataFrame([(*d, 1, "?") for d in docs], "text string, lang string, source string, n int, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(frame, least_docs=least, top=top).collect())
    assert got == brute(docs, least, top)
    assert divergence.audit(frame.where("1 = 0")).count() == 0
