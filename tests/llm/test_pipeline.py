"""The pipeline's stages against brute force, one by one, on the smallest table."""

import re

import corpus_pipeline
from allelix.llm import segment_samples
from allelix.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_components, cut_lines, rule_row

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, texts, tmp_path):
    found, rows = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, SF).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or rows.columns == docs.columns
        found.append({r["doc_id"]: r["text"] for r in rows.collect()} if k < 4 else rows)
    # quality
    for i, t in texts.items():
        (_, _, _, _, _, failed), kept = rule_row(t)
        assert (i in found[0]) == kept if kept is not None else not (failed and i in found[0])
    # lines
    seen, want = set(), {}
    for i in sorted(found[0]):
        parts, gone = [], False
        for _, n, chunk in cut_lines(found[0][i]):
            again = n > 1 and chunk in seen
            parts += [] if again else [chunk]
            gone |= again
            if n > 1:
                seen.add(chunk)
        text = "\n".join(parts)
        if not gone or re.search(r"[^\x20\x09-\x0D]", text):
            want[i] = text
    assert found[1] == want
    # near duplicates
    named = brute_components(list(found[1].items()), 5, 80)
    assert found[2] == {i: t for i, t in found[1].items() if named[i][1] == i}
    # decontamination
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in found[2].items() if any(x in t for x in items)}
    assert leaks and not leaks & found[3].keys() and len(found[3]) >= len(found[2]) - len(leaks) - 3
    # segmentations
    best = segment_samples.decoded(found[4].where("sample = 1"), tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["ids"] for r in best} == found[3]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
