"""A passage of 51 words is found wherever it begins and however short its words are."""

import random

import numpy as np
import pytest

from tidemark.llm import chunks


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_passages_of_short_words(spark, letters):
    rnd = random.Random(letters)
    said = lambda n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(letters)) for _ in range(n)]
    rows = []
    for k in range(400):  # pairs of documents, the passage at another place in each, at a text's start or end too
        shared = said(51)
        rows += [(2 * k, " ".join(said(k % 40) + shared + said(rnd.randrange(20)))), (2 * k + 1, " ".join(said(rnd.randrange(40)) + shared + said(k % 3 * 7)))]
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in found if r.words >= 28}
    assert [k for k in range(400) if (2 * k + 1, 2 * k) not in pairs] == []


def test_cuts_are_the_same_in_any_company():
    """A text's cuts don't depend on the texts that stand before it in a batch."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60))) for _ in range(50)]
    sliced = lambda some: chunks.Slice(np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0, *map(len, some)]), chunks.SPACED)
    alone = [chunks.cuts(sliced([t]), 10).tolist() for t in texts]
    assert chunks.cuts(sliced(texts), 10).tolist() == sum(alone, [])
