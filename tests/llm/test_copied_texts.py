"""Terms that give an address away, in texts that have been copied."""

import pytest

from driftloom.llm import private_data


@pytest.mark.parametrize("copies", [1, 20])
def test_verdicts_do_not_depend_on_copies(spark, copies):
    near = [f"filler{i} word word{i} the zanzibar envoy joe@x.org said thing{i} other{i}" for i in range(6)]
    rest = [f"the word other thing said filler number {i}" for i in range(60)]
    texts = near * copies + rest
    found = private_data.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = {(r.text[s.start : s.stop], s.kind) for r in found for s in r.spans}
    assert ("zanzibar", "removed") in kinds and "said" not in {k for k, _ in kinds}


def test_copies_of_one_text_are_the_evidence_of_one(spark):
    kinds = []
    for copies in (1, 30):
        texts = ["the zanzibar envoy joe@x.org came"] * copies + [f"another word {i}" for i in range(60)]
        found = private_data.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        kinds.append({(s.value, s.kind) for r in found for s in r.spans})
    assert kinds[0] == kinds[1] and ("joe@x.org", "email") in kinds[0]
