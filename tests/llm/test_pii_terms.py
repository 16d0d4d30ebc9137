"""Terms that reveal an entity against plain counting, and texts full of entities."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from framewright.llm import pii
from framewright.session import cut

RNG = random.Random(22)
COMMON = [f"{a}{b}" for a in ("al", "be", "ro", "tu") for b in ("na", "ki", "sam", "dor", "ven")]


def prose(n):
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.9 else f"rare{chr(97 + RNG.randint(0, 25))}{chr(97 + RNG.randint(0, 25))}" for _ in range(n))


TEXTS = [prose(RNG.randint(5, 80)) for _ in range(60)]
TEXTS += [f"{prose(10)} {RNG.choice(['zorblatt', 'quux'])} {RNG.choice(['a.b@c.example.com', 'd@e.example.org', '10.0.0.25'])} {prose(12)}" for _ in range(25)]
TEXTS += [TEXTS[70], None, "", "a@b.example.com", "1.2.3.4 5.6.7.8"]


def plainly(texts, disclosure, smooth):
    """(entity, term, stem) by counting."""
    words, near, shown, size = Counter(), Counter(), defaultdict(set), Counter()
    for text in texts:
        words.update(m[0] for m in pii.WORD.finditer((text or "").lower()))
        for c in pii.contexts(text, pii.base_spans(text)) if text else []:
            terms = tuple(w["term"] for w in c["words"])
            for t in terms:
                near[c["entity"], t] += 1
                shown[c["entity"], t].add(terms)
                size[c["entity"]] += 1
    total = sum(words.values())
    level = lambda both, seen, e, n: math.log(both * seen / (seen + smooth) * total / (size[e] * n)) / math.log(total / size[e])
    out = set()
    for (e, t), both in near.items():
        if size[e] < total and level(both, len(shown[e, t]), e, words[t]) >= disclosure:
            kin = [u for f, u in near if f == e and u[:3] == t[:3]]
            n = sum(c for w, c in words.items() if w[:3] == t[:3])
            bare = level(sum(near[e, u] for u in kin), max(len(shown[e, u]) for u in kin), e, n) >= disclosure
            out.add((e, t, None if bare else t[:3]))
    return out


@pytest.mark.parametrize("disclosure", [0.5, 0.8])
@pytest.mark.parametrize("smooth", [0.0, 1.0, 3.0])
def test_revealing_terms_are_those_of_plain_counts(spark, disclosure, smooth):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(4)
    want = plainly(list(dict.fromkeys(TEXTS)) + [t for i, t in enumerate(TEXTS) if t in TEXTS[:i]], disclosure, smooth)
    got = {tuple(r) for r in pii.revealing(cut(pii.scanned(docs)), disclosure, smooth).collect()}
    assert got == want and (smooth or got)


def test_a_text_full_of_addresses_takes_seconds():
    text = " ".join(f"user{i}@mail.example.com {RNG.choice(COMMON)}" for i in range(30_000))
    begun = time.process_time()
    spans = pii.base_spans(text)
    found = pii.contexts(text, spans)
    assert len(spans) == len(found) == 30_000 and time.process_time() - begun < 20
    assert [w["term"] for w in found[50]["words"]] == [w for w in text.split()[100 - 16 : 100 + 17] if "@" not in w]
