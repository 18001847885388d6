"""Every match of a text counts in its toxicity."""

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import toxicity
from evidentia.llm.textscan import Words, slices


def test_later_aimed_insults_count_after_reported_ones():
    texts = ["he said idiot. they said idiot. " + "you idiot. " * 20, "he said idiot. they said idiot. ", "you idiot. " * 3, "you idiot. " * 300]
    ((_, _, data, offsets),) = slices(pa.array(texts, pa.large_string()))
    words = Words(data, offsets, toxicity.LETTERS)
    sums, full, found = toxicity.matches(toxicity.train([], []), words)
    assert full[:, 1].tolist() == [40.0, 0.0, 6.0, 600.0] and full[:, 3].tolist() == pytest.approx([4.0 * toxicity.REPORTED] * 2 + [0.0, 0.0])
    np.testing.assert_allclose(sums[:, 1], 2 * np.log2([21, 1, 4, 301]))
    dense = toxicity._features(sums, full, words.counts())[:, -1]
    assert dense[3] > dense[2] and len(found) == 22 + 2 + 3 + 300
