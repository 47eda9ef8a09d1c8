import random
import re

import pytest

from lodestone.operators import retrieval as R


@pytest.mark.parametrize("block", [2, 1000])
def test_quotes_are_found_whatever_their_length_and_white_space(spark, block):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    docs = [" ".join(word() for _ in range(200)) for _ in range(12)] + ["".join(rng.choice("港口大雾停航台风封") for _ in range(400)), None, "", "abcd"]
    quotes = ["abcd", "ab cd", "abc", "", None, "港口大雾", "no such quote in any of these documents"]
    for d in docs[:13]:
        for n in (4, 5, 9, 23, 24, 25, 26, 40, 120):
            at = rng.randrange(len(d) - 150)
            quote = d[at : at + n]
            quotes += [quote, re.sub(r"\s", "", quote), " ".join(re.findall(".{1,5}", quote))]
    bare = lambda t: re.sub(r"\s+", "", t)
    want = set()
    for i, q in enumerate(quotes):
        for k, d in enumerate(docs):
            if q and d and len(bare(q)) >= 4 and bare(q) in bare(d):
                want.add((i, k, d.find(q), d.find(q) + len(q), "exact") if q in d else (i, k, None, None, "whitespace_only"))
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(map(repr, map(tuple, R.locate_quotes(q, d, block).collect()))) == sorted(map(repr, want))
