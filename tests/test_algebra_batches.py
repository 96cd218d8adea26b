"""Algebra of a batch of formulas is what ``algebra`` gives one by one."""

import numpy as np
import pyarrow as pa

from ionforge.constants import ELEMENTS
from ionforge.functions import composition as comp

ODD = [None, "", "Li", "Li2", "Fe(OH", "Fe()2", "Xx2", "Fe0", "Fe01", "FeO1000001", "Li(Fe2[P(O2)2]3)2", "(Li)", "((Li2))3", "li", "O2 ", "Fe)2(", "[Fe)2", "NaCl" * 300,
       "(" * 13 + "Li" + ")" * 13, "Fe1000000(O1000000)2", "Li1000000", "Be2B4", "CoC2", "Ünd", "2Li", "(2Li)", "Y3Y6"]


def made(rng):
    text = ""
    for _ in range(rng.integers(1, 6)):
        e, n = str(rng.choice(ELEMENTS)), int(rng.integers(0, 30))
        part = e + (str(n) if n else "")
        text += f"({part}O{rng.integers(1, 9)}){rng.integers(1, 9)}" if rng.random() < 0.3 else part
    return text


def test_a_batch_gives_what_formulas_give_alone(rng, monkeypatch):
    formulas = ODD + [made(rng) for _ in range(400)]
    ions = [[None, "Li", "Fe", "Q", ""][i % 5] for i in range(len(formulas))]
    odd, real = [], comp.parse
    monkeypatch.setattr(comp, "parse", lambda t: odd.append(t) or real(t))
    whole = pa.array(formulas)
    found = comp._algebra(whole.slice(3), pa.array(ions).slice(3)).to_pylist()
    assert len(odd) <= len(ODD), "plain formulas are read together"
    found = comp._algebra(whole.slice(0, 3), pa.array(ions).slice(0, 3)).to_pylist() + found
    for text, ion, r in zip(formulas, ions, found):
        assert (r["key"], r["host"], r["loading"], r["fraction"]) == comp.algebra(text, ion), (text, ion)


def test_empty_batches():
    none = pa.array([], pa.string())
    assert comp._algebra(none, none).to_pylist() == []
    assert comp._algebra(pa.array([None, "?"], pa.string()), pa.array([None, "Li"], pa.string())).to_pylist() == [dict.fromkeys(["key", "host", "loading", "fraction"])] * 2
