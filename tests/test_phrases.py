"""Telling phrases against a plain pass over all windows."""

import random
import re

from pyspark.sql import functions as F

from attestra.operators import drafts as D


def test_phrases_of_odd_texts(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "echo", "x", "about", "cap", "breach", "source", "backed", "entry", "deadline", "it's", "Omega", "İstanbul", "w" * 47, "naïve", "42"]
    texts = [(rng.choice(["", ".", "; "])).join(rng.choice([" ", "  ", "\n", ", "]) + rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += [None, "", "echo echo echo echo", "echo echo cap echo echo", "source backed entry", "Cap. Breach", "breach breach breach alpha", " ".join(["breach", "breach"] * 30 + ["alpha"])]

    def plain(text):
        found = set()
        for segment in re.split(D.SEGMENT_END, (text or "").lower()):
            w = re.findall(D.PHRASE_WORD, segment)
            for n in (2, 3, 4):
                for p in (w[i : i + n] for i in range(len(w) - n + 1)):
                    s = " ".join(p)
                    if all(len(x) >= 4 and x not in D.PHRASE_STOP_WORDS for x in p) and len(set(p)) > 1 and s not in D.LOW_VALUE_PHRASES and len(s) <= 90:
                        hints = sum(x in D.HINT_WORDS for x in p)
                        found.add((-(5 * n + min(len(s.replace(" ", "")), 40) + 10 * hints + (8 if hints else 0)), s))
        return [(s, -score) for score, s in sorted(found)[:10]]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", D.phrases(F.col("t")).alias("p"))
    assert {r.i: [tuple(x) for x in r.p] for r in rows.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    # windows aren't made as arrays, one interpreted lambda a word
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
