"""The gapped subsequence kernel against its definition, many words at once (op9)."""
import itertools

import numpy as np

from seqframe.llm.toxicity import _codes, _kernel


def by_definition(a, b, order, decay):
    """Every two equal subsequences, each weighed by the characters that it spans in both words."""
    return sum(decay ** (p[-1] - p[0] + 1 + q[-1] - q[0] + 1)
               for p in itertools.combinations(range(len(a)), order) for q in itertools.combinations(range(len(b)), order)
               if all(a[i] == b[j] for i, j in zip(p, q, strict=True)))


def test_kernel_of_many_words():
    words = ["idiot", "id.iot", "ab", "", "stupid", "ttttt", "éid\U0001f600iot", "toidi"]
    for landmark in ("idiot", "tt", "stupid"):
        found = _kernel(_codes(words)[0], _codes([landmark])[0], 3, 0.85)
        assert found.dtype == np.float32
        np.testing.assert_allclose(found, [by_definition(w, landmark, 3, 0.85) for w in words], rtol=1e-5)
    own = _kernel(_codes(words)[0], _codes(words)[0], 3, 0.85)
    np.testing.assert_allclose(own, [by_definition(w, w, 3, 0.85) for w in words], rtol=1e-5)
