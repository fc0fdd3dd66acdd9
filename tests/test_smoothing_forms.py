"""Smoothing with a choice of form against a plain loop over one series and one form, and on series whose form is known."""

import math

import numpy as np
import pytest

from larder.operators import models as M

SEASON = 7


def plain(y, trend, season, a, b, g):
    """AICc, level, slope, states and squared errors of one form with its constants."""
    phi = {"none": 0.0, "additive": 1.0, "damped": M.DAMPING}[trend]
    first = y[: 2 * SEASON]
    level, slope = sum(first) / len(first), 0.0
    start = [np.mean(first[i::SEASON]) for i in range(SEASON)]
    states = [s - np.mean(start) if season else 0.0 for s in start]
    sse = 0.0
    for t, v in enumerate(y):
        ahead = level + phi * slope
        e = v - ahead - states[t % SEASON]
        sse += e * e
        level, slope = ahead + a * e, phi * slope + b * e
        states[t % SEASON] += g * e
    k = 3 + 2 * (trend != "none") + (trend == "damped") + SEASON * season
    n = len(y)
    return n * math.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1), level, slope, states, sse, phi


def test_against_a_plain_loop():
    rnd = np.random.default_rng(4)
    y = rnd.poisson(5 + 3 * np.sin(np.arange(150) * 2 * np.pi / 7), (3, 150)).astype(float)
    y[1] += 0.1 * np.arange(150)
    for n in (60, 150):
        path, wide, form, aicc = M.selected(y, [n], 10)[0]
        for i in range(3):
            best = None
            for k, (trend, season) in enumerate(M.FORMS):
                for a in M.ALPHA:
                    for b in M.BETA if trend != "none" else (0.0,):
                        for g in M.GAMMA if season else (0.0,):
                            one = plain(y[i, :n].tolist(), trend, season, a, b, g)
                            if best is None or one[0] < best[0][0] - 1e-12:
                                best = one, k, a, b, g
            (want, level, slope, states, sse, phi), k, a, b, g = best
            assert form[i] == k and aicc[i] == pytest.approx(want)
            total, var = 0.0, 1.0
            for h in range(1, 11):
                total += phi**h
                assert path[i, h - 1] == pytest.approx(level + slope * total + states[(n + h - 1) % SEASON])
                assert wide[i, h - 1] == pytest.approx(math.sqrt(sse / n * var))
                var += (a + b * total + g * (h % SEASON == 0)) ** 2


def test_known_forms():
    rnd = np.random.default_rng(1)
    t = np.arange(400)
    week = np.tile([4, -3, 1, 0, -2, 3, -3], 60)[:400]
    y = np.stack([20 + rnd.normal(0, 1, 400), 20 + week + rnd.normal(0, 1, 400), 5 + 0.2 * t + week + rnd.normal(0, 1, 400), 5 + 0.2 * t + rnd.normal(0, 1, 400)])
    path, _, form, _ = M.selected(y, [400], 14)[0]
    found = [M.FORMS[k] for k in form]
    assert found[0] == ("none", False) and found[1] == ("none", True) and found[2] == ("additive", True) and found[3][0] != "none" and not found[3][1]
    assert path[2, 13] == pytest.approx(5 + 0.2 * 413 + week[413 % 7], abs=3)


def test_short_series_and_two_origins_at_once():
    y = np.ones((2, 30))
    one, two = M.selected(y, [3, 30], 5)
    assert one[0].shape == two[0].shape == (2, 5) and np.isfinite(one[0]).all() and two[0] == pytest.approx(np.ones((2, 5)), abs=1e-6)
