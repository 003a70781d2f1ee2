"""The short windows of the toxicity features."""

import numpy as np

from lamina.llm import toxicity


def test_peaks_do_not_depend_on_the_place():
    model = toxicity.Model.__new__(toxicity.Model)
    text = np.frombuffer(b"w " * 12 + b"w w", np.uint8)
    for place in range(11):
        gains = np.zeros(14)
        gains[place : place + 2] = 1.0
        gains[12:] = 0.5
        model.ratios = lambda *_, gains=gains: gains.copy()
        got = model.features(text, np.array([0, 24, 27]))
        assert got[0, 2] == 0.5 and got[0, 3] == 0
        assert got[1, 2] == 0.25 and got[1, 3] == 0
    gains[:] = 0
    gains[[0, 1, 3, 4, 5, 6, 9]] = 1.0
    assert model.features(text, np.array([0, 24, 27]))[0, 2:].tolist() == [1.0, 0.5]
