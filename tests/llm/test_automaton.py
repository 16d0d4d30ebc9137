"""The rules run as they are: states by lanes, spans against expressions, long texts without a break."""

import random
import re
import time

import numpy as np
import pytest

from framewright.llm import secret_scan as S

RNG = random.Random(41)
MACHINE = S.compile_rules([p for p, *_ in S.RULES.values()])
SCANNER = S.Scanner(MACHINE, S.RULES)


def by_expression(text):
    out = []
    for k, (_, whole, least) in enumerate(S.RULES.values()):
        out += [(m.start(), m.end(), k) for m in re.finditer(whole, text) if len(m[m.re.groups if m.re.groups > 1 else 0]) >= least]
    return sorted(out)


BITS = ["password", "passwd", "secret", "Token", "api_key", "apikey", ":", "=", "==", ":=", " ", "  ", '"', "'", '"=', "abcdef0123", "AKIA", "AKIAAKIA", "ABCDEFGH12345", "é", "\n", "deadbeef" * 4, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "ghs_" + "a1" * 25, "_", ".", "🙂"]


def test_spans_are_those_of_the_expressions():
    texts = ["".join(RNG.choice(BITS) for _ in range(RNG.randint(0, 25))) for _ in range(6000)]
    texts += ['token=secret"=abcdefgh1234', "secret=token=abcdefghij", "token:=abcdefghijkl", "tokentoken = tokenvalue12", "ghp_" + "a" * 30 + "ghp_" + "b" * 40, None, ""]
    for text, spans in zip(texts, SCANNER.many(texts)):
        assert spans == by_expression(text or ""), text


def test_states_do_not_depend_on_lanes(monkeypatch):
    data = "".join(RNG.choice(BITS) for _ in range(3000)).encode()
    raw, state, want = np.frombuffer(data, np.uint8), 0, []
    for b in data:
        state = int(MACHINE["next"][state, b])
        want.append(state)
    for lane in (1, 7, 256, 1 << 14):
        monkeypatch.setattr(S, "LANE", lane)
        assert S.states_after(raw, MACHINE).tolist() == want
    assert S.states_after(raw[:0], MACHINE).tolist() == []


@pytest.mark.parametrize("text", ["0123456789abcdef" * 125_000, "a" * 2_000_000, "token=" + "Zz9+/" * 400_000, "lorem ipsum dolor " * 110_000, "token " * 330_000])
def test_two_megabytes_without_a_break_take_seconds(text):
    begun = time.process_time()
    assert SCANNER.many([text])[0] == by_expression(text)
    assert time.process_time() - begun < 20


def test_rules_that_cross_lines_are_scanned_text_by_text():
    rules = {"pair": ("a[\nb]+", "a[\nb]+", 3)}
    scanner = S.Scanner(S.compile_rules([p for p, *_ in rules.values()]), rules)
    assert scanner.many(["a\nb", "b a\n", None, "xab\n\nba"]) == [[(0, 3, 0)], [], [], [(1, 6, 0)]]
