"""The background model of secrets counts every token of every text."""

import re
from collections import Counter

from vigilog.llm import secrets

ROWS = [(1, "alpha beta " * 400 + "zyzzyva quokka"), (2, None), (3, ""), (4, "password = hunter2hunter2 after"), (4, "one"), (None, "x1y É b")]


def test_word_model_reads_whole_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    pairs = Counter()
    for _, text in ROWS:
        for w in re.findall(r"[A-Za-z0-9+/_=-]+", text or ""):
            pairs.update(zip("^" + w, w + "$", strict=True))
    model = secrets.learn(secrets.extract(docs)).words
    assert model.pair == pairs and model.pair["z", "y"] == 2
    assert all(n == sum(c for (a, _), c in pairs.items() if a == x) for x, n in model.one.items())
