"""What the parts of op4's tables send to each other doesn't grow as parts times parts times runs."""

import random

from quantloom.llm import katz


def test_rare_words_name_only_the_runs_they_are_in(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    data = [(k, " ".join(r.choices(words, k=r.randrange(5, 40))), k % 3 > 0) for k in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, learn boolean").repartition(3)
    p = katz.KatzParams(head=20, run_tokens=200, part_tokens=1000)
    k = katz.fit_unigrams(docs, p)
    first, _ = katz.tables(docs, k, p)
    rows = [x for x in first.collect() if x["what"] == katz._HISTORY and bytes(x["stats"]) == b"w"]
    sent = [katz._columns(bytes(x["data"]), *katz._TAIL) for x in rows]
    events = sum(len(c[0]) for c in sent)
    assert events > 5000 and len({x["part"] for x in rows}) > 5
    assert sum(len(c[5]) for c in sent) <= events and all(set(c[4].tolist()) == set(range(len(c[5]))) == set(range(len(c[6]))) for c in sent)
    # With few words beyond the head there are few parts of them.
    some = katz.KatzParams(head=2990, run_tokens=200, part_tokens=1000)
    assert katz.fit_unigrams(docs, some).tail_parts <= 2 < katz.fit_unigrams(docs, some).parts
