"""Lines above op1's limits go from the texts that the pipeline hands on."""

import random

import corpus_pipeline
from siltstone.llm import quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_frequent_lines_of_one_host_go_from_the_texts(spark):
    own = {i: words(40, i) for i in range(100)}
    spelled = ["All rights reserved", " ALL  rights\treserved ", "all rights reserved"]
    texts = {i: f"{own[i]}\n{spelled[i % 3]}\n\nthe end {i}" if i < 30 else own[i] for i in own}
    rows = [(i, t, "en", "host", len(t)) for i, t in texts.items()] + [(100 + i, texts[i + 1], "en", f"other {i}", 7) for i in range(5)]
    got = {r.doc_id: r for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert len(got) == 105 and got[0].text == texts[0] and all(got[100 + i].text == texts[i + 1] for i in range(5))
    assert all(got[i].text == f"{own[i]}\n\nthe end {i}" for i in range(1, 30)) and all(got[i].text == own[i] for i in range(30, 100))
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert quality_rules.kept_documents(spark.createDataFrame(rows, DOCS)).count() == 105
