"""Plain functions that several test modules share."""

import numpy as np


def unit(rng, n, d):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)
