"""What the quick searches before each transducer pass over holds nothing to find."""

import random

import pytest

from loomline.llm import pii

PARTS = (
    "ann ann.b a_1 at AT @ [at] ( @ ) &#64; %40 &commat; dot DOT [dot] (.) { . } &#46; %2E host host.org org 10 0 255 . .. - , plus one TWO three "
    "\u017feven s\u0131x S\u0130X five nine eight zero \u043e\u043f\u0435 \uff11 \u200b at\u0301 \u212a +49 123 4.5.6.7 1.2.3.4.5 x"
).split(" ")


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(PARTS) + rng.choice(["", "", " ", " ", "  ", "\t", "\n", "-", ","]) for _ in range(rng.randint(0, 14)))


@pytest.mark.parametrize("seed", range(4))
def test_gates_lose_nothing(monkeypatch, seed):
    made = list(texts(seed, 5000))
    gated = [pii.find(t) for t in made]
    for gate in ("may_spell", "may_hide_dot", "may_hide_at"):
        monkeypatch.setattr(pii, gate, lambda text: True)
    monkeypatch.setattr(pii, "QUAD", pii.re.compile(""))
    assert gated == [pii.find(t) for t in made]
    assert sum(len(base) < len(spans) for base, spans in gated) > 30  # the texts do hold disguises


def test_gates_on_no_text():
    assert pii.find(None) == pii.find("") == ([], [])


def test_letters_that_only_ignored_case_makes_equal():
    said = "\u017feven n\u0131ne S\u0130X one two three four five six"
    assert pii.spelled_digits(said)[:3] == [(0, 6, "7"), (6, 11, "9"), (11, 15, "6")]
    assert pii.find(f"plus {said} now")[1] == [(0, 5 + len(said), 3)]
