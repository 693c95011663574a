"""The two-headed network as plain arrays: a shared trunk, a branch for the incident type and one for the severity.

Only what a task needs: the forward pass of a block of rows, and the joint loss with its gradient. Everything that
combines blocks is a Spark job in :mod:`urbanlens.operators.models`.
"""

from __future__ import annotations

from math import prod

import numpy as np

# FIXED VALUES: weights of the two losses.
TYPE_WEIGHT, SEVERITY_WEIGHT = 1.0, 0.5


class Network:
    """Sizes of the layers; parameters travel as one vector."""

    def __init__(self, inputs: int, trunk: tuple[int, ...], type_branch: int, severity_branch: int, types: int, severities: int):
        self.trunk = [inputs, *trunk]
        self.heads = [[self.trunk[-1], type_branch, types], [self.trunk[-1], severity_branch, severities]]

    def shapes(self) -> list[tuple[int, ...]]:
        chains = [self.trunk, *self.heads]
        return [s for c in chains for a, b in zip(c, c[1:], strict=False) for s in ((a, b), (b,))]

    def size(self) -> int:
        return sum(prod(s) for s in self.shapes())

    def first(self, seed: int) -> np.ndarray:
        """Weights by the fan of their layer, biases zero."""
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.uniform(-1, 1, s) * np.sqrt(6.0 / sum(s)) if len(s) == 2 else np.zeros(s)).ravel() for s in self.shapes()])

    def _layers(self, vector: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        parts, at = [], 0
        for s in self.shapes():
            n = prod(s)
            parts.append(vector[at : at + n].reshape(s))
            at += n
        pairs = list(zip(parts[::2], parts[1::2], strict=True))
        t, h = len(self.trunk) - 1, len(self.heads[0]) - 1
        return [pairs[:t], pairs[t : t + h], pairs[t + h :]]

    @staticmethod
    def _chain(x: np.ndarray, layers: list, last: bool, singly: bool = False) -> list[np.ndarray]:
        """The values after each layer; rectified, but for the ``last`` one of a head. ``singly`` multiplies each row by itself."""
        out = [x]
        for i, (w, b) in enumerate(layers):
            z = np.matmul(out[-1][:, None], w)[:, 0] if singly else out[-1] @ w
            z += b
            out.append(z if last and i == len(layers) - 1 else np.maximum(z, 0, out=z))
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = z - z.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    def _forward(self, vector: np.ndarray, x: np.ndarray, singly: bool) -> list[np.ndarray]:
        trunk, *heads = self._layers(vector)
        shared = self._chain(x, trunk, False, singly)[-1]
        return [self._softmax(self._chain(shared, h, True, singly)[-1]) for h in heads]

    def predict(self, vector: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Probabilities of the types and of the severities. A row's are the same to the last bit whatever rows come with
        it: a product of whole matrices rounds otherwise by how many rows there are and where in it a row stands."""
        return self._forward(vector, x, True)

    def losses(self, vector: np.ndarray, x: np.ndarray, labels: list[np.ndarray]) -> list[float]:
        """Summed cross-entropies of both heads."""
        rows = np.arange(len(x))
        return [float(-np.log(np.maximum(p[rows, y], 1e-300)).sum()) for p, y in zip(self._forward(vector, x, False), labels, strict=True)]

    def gradient(self, vector: np.ndarray, x: np.ndarray, labels: list[np.ndarray]) -> tuple[list[float], np.ndarray]:
        """Summed losses, and the gradient of their weighted sum."""
        trunk, *heads = self._layers(vector)
        rows, values = np.arange(len(x)), self._chain(x, trunk, False)
        losses, head_parts, back = [], [], np.zeros_like(values[-1])

        def down(layers: list, values: list[np.ndarray], d: np.ndarray, inputs: bool) -> tuple[list[np.ndarray], np.ndarray]:
            """Gradients of the layers, and of their input if asked for, from that of the last layer before it is rectified."""
            parts = []
            for i in range(len(layers) - 1, -1, -1):
                parts = [values[i].T @ d, d.sum(axis=0), *parts]
                if i or inputs:
                    d = d @ layers[i][0].T
                if i:
                    d *= values[i] > 0
            return parts, d

        for layers, y, weight in zip(heads, labels, (TYPE_WEIGHT, SEVERITY_WEIGHT), strict=True):
            found = self._chain(values[-1], layers, True)
            p = self._softmax(found[-1])
            losses.append(float(-np.log(np.maximum(p[rows, y], 1e-300)).sum()))
            p[rows, y] -= 1
            parts, d = down(layers, found, weight * p, True)
            head_parts += parts
            back += d
        parts, _ = down(trunk, values, back * (values[-1] > 0), False)
        return losses, np.concatenate([g.ravel() for g in parts + head_parts])
